"""Registered queries: each applies one operator to the fixture tables. Their SQL is in oracle.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import blocks as B
from ..operators import chunks as C
from ..operators import evaluation as E
from ..operators import points as P
from ..operators import retrieval as R
from ..operators import rules as U
from ..operators import runs as N
from ..operators import sampling as S
from ..session import table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- scalar functions --------------------------------------------------------------------------------


@query
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.token_estimate("text").alias("n_tokens"))


@query
def approx_token_budget(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.approx_tokens("text").alias("approx_tokens"), X.context_tokens("text").alias("context_tokens"))


@query
def breadcrumbs(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_extract("url", "^https?://([^?#]*)", 1)
    return table(spark, sf, "pages").select("page_id", X.breadcrumb(path).alias("breadcrumb"), X.slug(path).alias("slug"))


@query
def clean_notes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.clean_note("html").alias("note"), X.snippet("html").alias("snippet"))


@query
def point_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", P.text_point_id(F.col("source"), F.lit(0), F.col("doc_id").cast("string")).alias("point_id"), P.visual_point_id(F.col("source"), F.col("doc_id")).alias("visual_id"))


@query
def titles_and_numbers(spark: SparkSession, sf: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    numbered = F.concat(F.lit("  "), (F.col("page_id") % 7).cast("string"), F.lit("."), (F.col("page_id") % 3).cast("string"), F.lit("   "), title)
    return table(spark, sf, "pages").select("page_id", X.display_title(numbered).alias("title"), X.heading_number(numbered).alias("number"))


@query
def lists_and_ranges(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    mixed = F.concat_ws(", ", (k % 7).cast("string"), F.lit("x"), (k % 5).cast("string"), (k % 7).cast("string"))
    spec = F.concat((k % 4 + 2).cast("string"), F.lit("-"), (k % 4 + 4).cast("string"), F.lit(",1"))
    pages = X.page_list(F.array().cast("array<int>"), (k % 9).cast("int"), (k % 4).cast("int"))
    return o.select("o_orderkey", F.array_join(X.list_of_ints(mixed), "|").alias("ints"), F.array_join(X.page_ranges(spec), "|").alias("pages"), F.array_join(pages, "|").alias("span"))


@query
def icon_patches(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    original = F.concat(F.lit("Click "), F.col("o_orderpriority"))
    patched = F.when(k % 4 == 0, "No missing icons.").when(k % 4 == 1, "[Icon: gear] !").when(k % 4 == 2, F.concat(F.lit("Click [Icon: gear] "), F.col("o_orderpriority"))).otherwise(F.concat(F.lit("<think>a</think> Tap [icon : x][Icon:]"), F.col("o_orderpriority")))
    patched = X.strip_reasoning(patched)
    return o.select("o_orderkey", X.patch_decision(original, patched).alias("decision"), F.array_join(X.icon_markers(patched), "|").alias("markers"), X.preservation_key(patched).alias("preserved"))


@query
def fuzzy_titles(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("t"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("h"))
    return p.select("page_id", F.round(X.fuzzy_ratio("t", "h"), 6).alias("ratio"))


@query
def token_tails(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", X.token_tail("text", 8).alias("tail"), X.truncated("text", 40).alias("head"))


# --- blocks and chunks ---------------------------------------------------------------------------------


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return B.blocks_from_text(table(spark, sf, "documents")).withColumn("tokens", C.item_cost("text"))


def _chunked(spark: SparkSession, sf: str, max_tokens: int = 120, min_tokens: int = 20) -> DataFrame:
    return C.greedy_chunks(_lines(spark, sf), keys=("doc_id",), order="block_idx", cost="tokens", max_tokens=max_tokens, min_tokens=min_tokens)


@query
def blocks_from_documents(spark: SparkSession, sf: str) -> DataFrame:
    return B.blocks_from_text(table(spark, sf, "documents"))


@query
def greedy_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _chunked(spark, sf).select("doc_id", "block_idx", "chunk_idx")


@query
def greedy_chunks_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return C.overlapping_chunks(B.blocks_from_text(table(spark, sf, "documents")), key="doc_id", order="block_idx", profile=C.Profile(max_tokens=120, overlap_tokens=15, min_tokens=20))


@query
def section_islands(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").withColumn("section_path", F.when(F.col("role") == "system", "").otherwise(F.col("role")))
    return C.section_islands(turns, key="conv_id", order="turn").select("conv_id", "turn", "effective_path", "island")


@query
def chunk_modes(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").withColumn("section_path", F.when(F.col("role") == "system", "sys").otherwise(""))
    return C.resolve_mode(turns, key="conv_id")


@query
def chunk_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return C.roll_up(_chunked(spark, sf), key="doc_id", order="block_idx")


@query
def chunk_profile_stats(spark: SparkSession, sf: str) -> DataFrame:
    return C.profile_stats(C.roll_up(_chunked(spark, sf), key="doc_id", order="block_idx"), 120)


@query
def profile_sweep(spark: SparkSession, sf: str) -> DataFrame:
    parts = [C.profile_stats(C.roll_up(_chunked(spark, sf, n), key="doc_id", order="block_idx"), n).withColumn("profile", F.lit(n)) for n in (60, 240)]
    return parts[0].unionByName(parts[1])


@query
def section_asof(spark: SparkSession, sf: str) -> DataFrame:
    out = B.propagate(table(spark, sf, "events"), keys=("user_id",), event=F.col("event_type") == "signup", value=F.col("event_id"), order=("ts", "event_id"))
    return out.select("event_id", "section")


def _tables(spark: SparkSession, sf: str) -> DataFrame:
    y = (F.col("event_id") % 900).cast("double")
    box = F.struct(F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(100.0).alias("x1"), (y + 50).alias("y1"))
    return table(spark, sf, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("block_idx"), F.floor(F.col("event_id") / 500).cast("int").alias("page_idx"), (F.col("event_type") == "purchase").alias("is_master"), (F.col("event_type") == "view").alias("is_open"), box.alias("box"))


@query
def continuation_groups(spark: SparkSession, sf: str) -> DataFrame:
    return B.continuation_map(_tables(spark, sf))


@query
def continuation_members(spark: SparkSession, sf: str) -> DataFrame:
    return B.continuation_regions(B.continuation_map(_tables(spark, sf))).select("source", "master_idx", F.array_join("members", "|").alias("members"))


@query
def cross_page_tables(spark: SparkSession, sf: str) -> DataFrame:
    t = _tables(spark, sf)
    return N.cross_page_tables(B.continuation_map(t), t)


@query
def outline_path(spark: SparkSession, sf: str) -> DataFrame:
    lines = B.blocks_from_text(table(spark, sf, "documents"))
    outline = lines.select(F.col("doc_id").alias("source"), F.col("block_idx").cast("bigint").alias("outline_index"), (1 + F.char_length("text") % 3).alias("level"), F.col("text").alias("title"))
    return B.outline_paths(outline).select("source", "outline_index", "section_path")


def _headings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf, "pages")
    head, para = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.regexp_extract("html", "<p>([^<]*)", 1)
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    outline = p.select(F.col("page_id").alias("source"), F.lit(0).alias("page_idx"), F.lit(0).alias("outline_index"), F.when(F.col("page_id") % 3 == 0, F.lower(title)).otherwise(title).alias("title"), F.when(F.col("page_id") % 2 == 0, F.col("page_id") % 5 * 50.0).alias("dest_y"))
    block = lambda i, t: F.struct(F.lit(i).alias("block_idx"), F.lit("text").alias("type"), t.alias("text"), F.lit(i * 100.0).alias("y0"))
    blocks = p.select(F.col("page_id").alias("source"), F.lit(0).alias("page_idx"), F.inline(F.array(block(0, para), block(1, head))))
    return outline, blocks


@query
def outline_match_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return B.match_outline(*_headings(spark, sf), fuzzy=False).select("source", "block_idx", "match_type", "confidence")


@query
def outline_match_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    """All tiers, with titles that are misspelt; alike titles are beyond SQL, so a test compares with plain Python."""
    outline, blocks = _headings(spark, sf)
    outline = outline.withColumn("title", F.when(F.col("source") % 4 == 1, F.regexp_replace("title", "e(.)", "$1e")).otherwise(F.col("title")))
    return B.match_outline(outline, blocks).select("source", "block_idx", "match_type", "confidence")


@query
def page_windows(spark: SparkSession, sf: str) -> DataFrame:
    return B.page_windows(table(spark, sf, "lineitem"), key="l_orderkey", page="l_linenumber", size=2)


@query
def nearest_target(spark: SparkSession, sf: str) -> DataFrame:
    def boxed(x, y, w, h):
        return F.struct(x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + w).cast("double").alias("x1"), (y + h).cast("double").alias("y1"))

    k, s = F.col("p_partkey"), F.col("s_suppkey")
    icons = table(spark, sf, "part").select(F.floor(k / 500).alias("source"), (k % 5).alias("page_idx"), k.alias("icon_idx"), boxed(k * 37 % 900, k * 91 % 900, F.lit(20) + F.col("p_size"), F.lit(30)).alias("box")).where(B.is_inline_icon(F.col("box")))
    kind = F.when(s % 3 == 0, "table").when(s % 3 == 1, "list").otherwise("text")
    targets = table(spark, sf, "supplier").select(F.floor(s / 25).alias("source"), (s % 5).alias("page_idx"), s.alias("target_idx"), kind.alias("kind"), (s % 5 == 0).alias("dangling"), boxed(s * 53 % 600, s * 71 % 800, F.lit(300), F.lit(120)).alias("box"))
    return B.link_icons(icons, targets)


@query
def context_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    lines = B.blocks_from_text(table(spark, sf, "documents")).withColumn("tokens", X.approx_tokens("text"))
    return B.context_neighbours(lines, lines.where("char_length(text) < 60"), key="doc_id", budget=160)


@query
def truncated_contexts(spark: SparkSession, sf: str) -> DataFrame:
    lines = B.blocks_from_text(table(spark, sf, "documents"))
    return B.truncated_contexts(lines, lines.where("char_length(text) < 25"), key="doc_id", budget=160)


@query
def region_explode(spark: SparkSession, sf: str) -> DataFrame:
    c = C.roll_up(_chunked(spark, sf), key="doc_id", order="block_idx")
    return c.select("chunk_id", F.posexplode(F.split("block_indices", r"\|")).alias("pos", "b"), "token_count").select("chunk_id", "pos", F.col("b").cast("long").alias("block_idx"), F.when(F.col("pos") == 0, F.col("token_count")).alias("label_tokens"))


@query
def subset_closure(spark: SparkSession, sf: str) -> DataFrame:
    t = _tables(spark, sf)
    kinds = table(spark, sf, "events").select(F.col("event_id").alias("block_idx"), "event_type")
    icons = t.join(kinds.where("event_type = 'click'"), "block_idx").select("source", F.col("block_idx").alias("icon_idx"), (F.col("block_idx") + 1).alias("target_idx"))
    pages = t.join(kinds.where("event_type = 'error'"), "block_idx").select("source", "page_idx").distinct()
    return B.subset_closure(t, pages, B.continuation_map(t), icons)


# --- tags and points --------------------------------------------------------------------------------------


@query
def tag_join(spark: SparkSession, sf: str) -> DataFrame:
    return P.tag(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), on="doc_id")


@query
def tag_stats(spark: SparkSession, sf: str) -> DataFrame:
    return P.tag_stats(P.tag(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), on="doc_id"))


@query
def replace_by_source(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return P.replace_by_source(d, d.where("source IN ('src1', 'src2') AND n_chars > 1000").withColumn("n_chars", F.col("n_chars") + 1), source="source")


@query
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    pick = lambda c: o.where(c).select("o_custkey", "o_orderkey")
    return P.upsert(pick("o_orderstatus = 'F'"), pick("o_orderstatus <> 'F'"), key="o_custkey", order="o_orderkey")


@query
def page_rollup(spark: SparkSession, sf: str) -> DataFrame:
    c = C.roll_up(_chunked(spark, sf), key="doc_id", order="block_idx")
    return P.page_payloads(c.select("doc_id", "chunk_idx", "chunk_id", F.col("token_count").cast("string").alias("section"), F.sequence("page_start", "page_end").alias("pages")), source="doc_id")


@query
def page_batches(spark: SparkSession, sf: str) -> DataFrame:
    return P.batches(table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("n")), key="p_partkey", size=8)


@query
def collection_inspect(spark: SparkSession, sf: str) -> DataFrame:
    return P.inspect(table(spark, sf, "embeddings"), "embedding")


@query
def pending_sources(spark: SparkSession, sf: str) -> DataFrame:
    return P.pending(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])


# --- retrieval -----------------------------------------------------------------------------------------------


def _vector_queries(e: DataFrame) -> DataFrame:
    """Every fiftieth vector asks; all vectors answer."""
    return e.where("vec_id % 50 = 0").select(F.floor(F.col("vec_id") / 50).alias("query_id"), "embedding")


def _dense(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return R.dense_topk(e, _vector_queries(e), k)


def _sparse(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    return R.bm25_topk(table(spark, sf, "documents"), table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), k)


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    return R.fuse({"dense": _dense(spark, sf).withColumnRenamed("vec_id", "id"), "sparse": _sparse(spark, sf).withColumnRenamed("doc_id", "id")})


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    c = _fused(spark, sf).select("query_id", "id", F.round("score", 8).alias("score"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return R.with_tokens(c.join(docs, "id"), "text")


@query
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _dense(spark, sf)


@query
def sparse_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _sparse(spark, sf)


@query
def maxsim_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    tokens = _vector_queries(e).select((F.col("query_id") % 2).alias("query_id"), F.col("query_id").alias("token_idx"), "embedding")
    return R.maxsim_topk(e.select(F.floor(F.col("vec_id") / 10).alias("page_id"), "embedding"), tokens, 10)


@query
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf).select("query_id", "id", *[F.round(c, 8).alias(c) for c in ("dense", "sparse", "visual", "score")])


@query
def route_ablation(spark: SparkSession, sf: str) -> DataFrame:
    # The routes are planned once: each row has a part from each route, and a mode sums the parts of its own.
    fused = _fused(spark, sf)
    modes = ("text", "text-dense-only", "text-sparse-only")
    by_mode = F.array(*[F.struct(F.lit(m).alias("mode"), sum((F.col(r) for r in R.ROUTE_MODES[m]), F.lit(0.0)).alias("score")) for m in modes])
    rows = fused.select("query_id", "id", F.inline(by_mode)).where("score > 0").select(F.struct("mode", "query_id").alias("of"), "id", F.round("score", 8).alias("score"))
    return R.top(rows, 3, by="of", tie="id").select("of.query_id", "id", "score", "rank", "of.mode")


@query
def score_prune(spark: SparkSession, sf: str) -> DataFrame:
    return R.prune(_ranked(spark, sf), ratio=0.2).select("query_id", "id", "score")


@query
def soft_budget(spark: SparkSession, sf: str) -> DataFrame:
    return R.soft_budget(_ranked(spark, sf), top_k=10, budget=2000, order=[F.desc("score"), "id"]).select("query_id", "id", "position", F.col("used_before").cast("long").alias("used_before"))


@query
def context_text(spark: SparkSession, sf: str) -> DataFrame:
    chosen = R.soft_budget(_ranked(spark, sf), top_k=3, budget=1000, order=[F.desc("score"), "id"])
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    block = R.context_block(F.col("source"), F.col("id"), F.col("id"), F.col("source"), F.col("text"), F.lit(0.0))
    return R.context_text(chosen, queries, block=block)


@query
def visual_bonus(spark: SparkSession, sf: str) -> DataFrame:
    direct = _fused(spark, sf).select("query_id", F.lit("s").alias("source"), F.col("id").cast("string").alias("chunk_id"), "dense", "sparse", (F.col("dense") + F.col("sparse")).alias("direct"))
    e = table(spark, sf, "embeddings")
    page = F.floor(F.col("vec_id") / 10).alias("page_idx")
    hits = e.select((F.col("vec_id") % 10).alias("query_id"), F.lit("s").alias("source"), page, (2.5 / (61 + F.floor(F.col("vec_id") / 10))).alias("visual"))
    pages = e.select(F.lit("s").alias("source"), F.col("vec_id").cast("string").alias("chunk_id"), page, (F.col("vec_id") % 3 == 0).alias("listed"), (F.col("vec_id") % 4).alias("here"))
    fit = G.box_alignment(F.lit(True), F.col("listed"), F.col("here"), F.lit(4))
    out = R.with_visual_bonus(direct, hits, pages, alignment=fit)
    return out.select("query_id", "chunk_id", *[F.round(c, 8).alias(c) for c in ("direct", "visual", "score")])


@query
def box_alignment(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_linenumber")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", F.round(G.box_alignment(F.col("l_quantity") > 5, k % 2 == 0, k % 4, k % 4 + k % 3), 6).alias("alignment"))


@query
def image_refs_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select((F.col("page_id") % 5).alias("query_id"), F.floor(F.col("page_id") / 5).alias("rank"), F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("images"))
    return R.image_references(p)


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    patches = e.select(F.floor(F.col("vec_id") / 16).alias("page_id"), (F.col("vec_id") % 16).alias("patch_idx"), "embedding")
    return R.patch_similarity(patches, _vector_queries(e).withColumnRenamed("query_id", "token_idx"), 3)


@query
def patch_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _evidence(spark, sf)


@query
def patch_alignment(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    patches = e.select(F.floor(F.col("vec_id") / 16).alias("page_id"), (F.col("vec_id") % 16).alias("patch_idx"), "embedding")
    boxes = e.select(F.floor(F.col("vec_id") / 16).alias("page_id")).distinct().select("page_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("chunk_idx"))
    x = F.col("chunk_idx") * 300.0
    boxes = boxes.withColumn("box", F.struct(x.alias("x0"), F.lit(0.0).alias("y0"), (x + 350.0).alias("x1"), F.lit(700.0).alias("y1")))
    tokens = _vector_queries(e).withColumnRenamed("query_id", "token_idx")
    return R.align_pages(patches, tokens, boxes, 3, patch=G.patch_box(F.col("patch_idx"), 4, 4), overlap=G.overlap_ratio(F.col("patch"), F.col("box")))


# --- evaluation -----------------------------------------------------------------------------------------------


def _chunk_rows(spark: SparkSession, sf: str, max_tokens: int) -> DataFrame:
    rows = _chunked(spark, sf, max_tokens).groupBy("doc_id", "chunk_idx").agg(F.array_sort(F.collect_list("block_idx")).alias("blocks"), F.array_sort(F.collect_set("page_idx")).alias("pages"), F.sum("tokens").alias("tokens"))
    return rows.withColumn("chunk_id", F.concat_ws("-", F.lit(str(max_tokens)), "doc_id", "chunk_idx"))


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.array(F.concat_ws("-", F.lit("120"), "doc_id", F.lit("0")), F.concat_ws("-", F.lit("120"), "doc_id", F.lit("2")))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), ids.alias("gold"))


@query
def evidence_anchor(spark: SparkSession, sf: str) -> DataFrame:
    a = E.evidence_anchors(_gold(spark, sf), _chunk_rows(spark, sf, 120))
    return a.select("query_id", *[F.array_join(c, "|").alias(c) for c in ("blocks", "pages", "missing")])


@query
def evidence_remap(spark: SparkSession, sf: str) -> DataFrame:
    a = E.evidence_anchors(_gold(spark, sf), _chunk_rows(spark, sf, 120)).withColumn("doc_id", F.col("query_id"))
    new = _chunk_rows(spark, sf, 60)
    found = E.remap_by_blocks(a, new).join(new.select("chunk_id", "chunk_idx", "tokens"), "chunk_id")
    best = E.best_primary(found.select("query_id", "chunk_id", F.lit(0).alias("primary_overlap"), F.col("overlap").alias("evidence_overlap"), F.lit(0).alias("page_overlap"), "tokens", "chunk_idx"))
    n = found.groupBy("query_id").agg(F.count("*").alias("n_chunks"))
    out = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id")).join(n, "query_id", "left").join(best, "query_id", "left")
    return out.select("query_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "primary_chunk_id", E.remap_source(F.coalesce("n_chunks", F.lit(0)), F.lit(0), F.lit(0)).alias("source"))


@query
def snippet_match(spark: SparkSession, sf: str) -> DataFrame:
    return E.snippet_matches(table(spark, sf, "benchmark"), table(spark, sf, "documents"))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return _dense(spark, sf).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("vec_id").alias("id"), "score")


@query
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    q = e.where("vec_id % 50 = 0").select(F.floor(F.col("vec_id") / 50).alias("query_id"), "label")
    # One query has no gold.
    return E.class_metrics(_hits(spark, sf), e.withColumnRenamed("vec_id", "id"), q.where("query_id <> 3"), q)


@query
def retrieval_features(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id")
    h = _hits(spark, sf).select("query_id", "rank", F.col("score").alias("dense"), F.lit(0.0).alias("sparse"), F.when(k % 3 == 0, F.col("score") * 0.7).otherwise(0.0).alias("visual"), (F.col("score") * 0.5).alias("direct"), (k % 13 == 0).alias("is_primary"), (k % 2 == 0).alias("on_gold_page"))
    return E.hit_features(h)


@query
def page_score_spread(spark: SparkSession, sf: str) -> DataFrame:
    return E.page_scores(_hits(spark, sf).withColumn("pages", F.sequence(F.col("id") % 4, F.col("id") % 4 + F.col("id") % 3)))


def _passes(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") % 4).alias("run_id"), F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("pass_id"), F.floor(F.col("l_quantity") / 8).alias("score"), F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).otherwise("").alias("failure"))


@query
def pass_scores(spark: SparkSession, sf: str) -> DataFrame:
    return E.pass_scores(_passes(spark, sf))


@query
def run_score_summary(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("query_id")
    return E.run_summary(E.pass_scores(_passes(spark, sf)).withColumns({"context_tokens": (k % 900 + 100).cast("double"), "total_tokens": F.when(k % 5 > 0, (k % 700 + 200).cast("double"))}))


@query
def answer_summary(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return E.answer_summary(o.select((F.col("o_orderstatus") == "F").cast("long").alias("leaked"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 50).alias("tokens"), (F.col("o_orderkey") % 17).cast("double").alias("latency")))


@query
def archived_contexts(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    old = o.select(F.col("o_orderkey").alias("query_id"), (F.col("o_orderkey") % 7).cast("double").alias("retrieval"))
    return E.rescore_archived(old, o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("query_id"), (F.col("o_orderkey") % 11).cast("double").alias("latency")))


# --- runs -----------------------------------------------------------------------------------------------------


@query
def request_log_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    log = e.select((F.col("user_id") % 10).alias("run_id"), F.when(F.col("event_type") == "view", "ok").when(F.col("event_type") == "click", "read timeout").otherwise(F.col("event_type")).alias("status"), F.when(F.col("event_type") == "signup", "fallback_text").when(F.col("event_type") == "error", "invalid_rejected").alias("decision"), F.round("value", 4).alias("duration"))
    return N.request_summary(log, keys=["run_id"], elapsed=F.lit(600.0))


@query
def checkpoint_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return N.checkpoint_gaps(table(spark, sf, "events"), key="user_id", position="event_id")


@query
def checkpoint_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return N.by_reason(table(spark, sf, "orders"), reason="o_orderpriority", value="o_custkey")


@query
def sample_summary(spark: SparkSession, sf: str) -> DataFrame:
    return N.sample_summary(table(spark, sf, "part"), keys=["p_brand"], value="p_size", bad=F.col("p_partkey") % 9 == 0)


@query
def group_metric(spark: SparkSession, sf: str) -> DataFrame:
    return N.group_metric(table(spark, sf, "orders"), keys=["o_orderpriority", "o_orderstatus"], value="o_custkey")


@query
def best_per_stage(spark: SparkSession, sf: str) -> DataFrame:
    return N.best_per_stage(table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_custkey"), stage="o_orderpriority", value="o_custkey", tie="o_orderkey")


@query
def quality_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return N.quality_by_group(table(spark, sf, "lineitem"), a="l_returnflag", b="l_linenumber", hit=F.col("l_linestatus") == "O", value="l_quantity")


@query
def patch_quality_scores(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    target, missed = k % 6, k % 3
    score = N.patch_quality(target, F.greatest(F.lit(0), target - missed), k % 2, missed, k % 4, k % 11 != 0)
    return table(spark, sf, "part").select("p_partkey", score.alias("quality"))


@query
def early_stop(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("search"), k.alias("step"), F.lit(100).alias("n_requests"), (k % 29 == 0).cast("int").alias("n_errors"), (k % 7).alias("n_timeouts"), (k * 37 % 100 + 50).cast("double").alias("per_minute"), (k % 13 + 1).cast("double").alias("p95"))
    return N.early_stop(rows, key="search", order="step")


@query
def run_grid(spark: SparkSession, sf: str) -> DataFrame:
    return N.run_grid(spark, dpi=[150, 200], concurrency=[1, 2, 4], repeat=[1, 2])


# --- sampling and gold sets ------------------------------------------------------------------------------------


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    text = F.concat(F.when(k % 5 == 0, "[Table: a] ").when(k % 5 == 1, "[Image caption: b] Step 1 ").when(k % 5 == 2, "[Image description: c] ").when(k % 5 == 3, "Step 2 ").otherwise(""), "text")
    return d.select(k.alias("chunk_no"), F.concat(F.col("source"), F.lit("/"), (k % 37).cast("string")).alias("section"), S.query_type(text).alias("query_type"))


@query
def query_typing(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(spark, sf)


@query
def quota_sample(spark: SparkSession, sf: str) -> DataFrame:
    return S.quota_sample(_typed(spark, sf), target=50).select("query_no", "chunk_no", "query_type")


@query
def keyword_topk(spark: SparkSession, sf: str) -> DataFrame:
    return S.keywords(table(spark, sf, "documents"), k=5, stop_words=("that", "this", "with"))


@query
def keyword_groups(spark: SparkSession, sf: str) -> DataFrame:
    return S.keyword_groups(table(spark, sf, "documents"), {"license": ["license", "released under"], "secret": ["token =", "password"], "contact": ["@mail", "+1 ("]})


@query
def systematic_sample(spark: SparkSession, sf: str) -> DataFrame:
    return S.systematic_sample(table(spark, sf, "documents").select("source", "doc_id"), key="source", order="doc_id", size=5)


@query
def question_flags(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return S.question_flags(li.select(F.col("l_orderkey").alias("qa_id"), (F.col("l_suppkey") % 3).alias("pdf"), F.col("l_linenumber").alias("page"), F.when(F.col("l_returnflag") == "R", "table").otherwise("text").alias("modality")))


@query
def qa_integrity(spark: SparkSession, sf: str) -> DataFrame:
    return S.integrity(table(spark, sf, "orders"), {"no_customer": F.col("o_custkey").isNull(), "price": F.col("o_totalprice") <= 0, "priority": ~F.col("o_orderpriority").rlike("^[1-5]-"), "even": F.col("o_orderkey") % 2 == 0})


@query
def support_coverage(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("page_text"))
    return S.support_coverage(table(spark, sf, "benchmark").select("item_id", F.col("text").alias("claim")), pages, on=["item_id"])


# --- rules ------------------------------------------------------------------------------------------------------


@query
def version_model_extract(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", U.version(F.col("source"), F.col("text")).alias("version"), F.array_join(U.models(F.col("text"), r"\b([A-Za-z]{2,6}\.[0-9]{2})@"), "|").alias("models"))


@query
def language_rules(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("doc_id") % 7 == 0, "Manuale utente v2").when(F.col("doc_id") % 7 == 1, "polski_instrukcja").when(F.col("doc_id") % 7 == 2, "guide d'installation").otherwise("doc")
    return table(spark, sf, "documents").select("doc_id", U.language(name, F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).alias("language"))


@query
def doc_type_rules(spark: SparkSession, sf: str) -> DataFrame:
    text = F.lower("text")
    kind = U.cascade(text, [("license", "license"), ("credentials", r"token\s*="), ("contact", "@mail")], "prose")
    topics = U.topics(text, {"license": "license", "version": "version", "public": "public", "token": "secret"})
    return table(spark, sf, "documents").select("doc_id", kind.alias("kind"), F.array_join(topics, "|").alias("topics"), U.target_path(F.col("lang"), kind, F.col("source")).alias("target"))


@query
def anomalies(spark: SparkSession, sf: str) -> DataFrame:
    part, li = table(spark, sf, "part"), table(spark, sf, "lineitem")
    twice = U.collisions(part, "p_name").select(F.lit("collision").alias("kind"), F.col("p_name").alias("key"), "n")
    lost = U.orphans(part.select(F.col("p_partkey").alias("k")), li.select(F.col("l_partkey").alias("k")), "k").select(F.lit("orphan").alias("kind"), F.col("k").cast("string").alias("key"), F.lit(1).cast("long").alias("n"))
    return twice.unionByName(lost)


@query
def decision_overlay(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    by_hand = table(spark, sf, "labels").where("toxic = 1").select("doc_id", F.lit("xx").alias("lang"))
    return U.overlay(d, by_hand, on="doc_id", columns=["lang"])


@query
def layout_summary(spark: SparkSession, sf: str) -> DataFrame:
    return U.layout_summary(table(spark, sf, "documents").withColumn("moves", F.col("n_chars") > 500), by=("lang", "source"))


@query
def content_digest(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("block_idx") == 0, "title").when(F.char_length("text") < 60, "short").otherwise("body")
    return U.content_digest(B.blocks_from_text(table(spark, sf, "documents")), kind, key="doc_id")


from . import more  # noqa: E402, F401  the rest of the queries register themselves
