"""Operators on small literals, sources by round trips, queries against their SQL."""

from __future__ import annotations

import math
import os
import re
import uuid

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import geometry as G
from foliant.functions import text as X
from foliant.operators import blocks as B
from foliant.operators import chunks as C
from foliant.operators import evaluation as E
from foliant.operators import points as P
from foliant.operators import retrieval as R
from foliant.operators import runs as N
from foliant.operators import sampling as S
from foliant.operators import serving as V
from foliant.plans import presets
from foliant.plans.catalog import QUERIES
from foliant.plans.oracle import ORACLE_SQL
from foliant.session import DATA_DIR
from foliant.sources import files
from foliant.streaming import metrics

SF = f"{DATA_DIR}/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# --- functions -------------------------------------------------------------------------------------------


def test_token_counts(spark):
    r = one(spark, X.token_estimate(F.lit("ab_1 c, 日本\u00a0x")), X.token_estimate(F.lit(None).cast("string")), X.approx_tokens(F.lit("日本abcde")), X.context_tokens(F.lit("")))
    assert tuple(r) == (6, 0, 4, 1)


def test_tails_and_truncation():
    assert X.tail_of("one two three", 2) == "two three" and X.tail_of("a b", 5) == "a b" and X.tail_of("a", 0) == ""
    out = X.truncate("x" * 400, 30, from_tail=False)
    assert out.endswith(X.TRUNCATION_MARKER) and X.approx_count(out) <= 31 and X.truncate("abc", 5, from_tail=True) == "abc"


def test_names(spark):
    r = one(spark, X.breadcrumb(F.lit("\\a//b/c.pdf/")), X.source_name(F.lit("/x/source-pdfs/d/e.pdf")), X.source_name(F.lit("/x/e.pdf")), X.heading_number(F.lit(" 2.1\u00a0Title")), X.slug(F.lit("A b_C!")), X.uuid5(F.lit("key")))
    assert tuple(r) == ("a > b > c.pdf", "d/e.pdf", "e.pdf", "2.1", "a-b-c", str(uuid.uuid5(uuid.NAMESPACE_DNS, "key")))


def test_patches(spark):
    f = lambda a, b: X.patch_decision(F.lit(a), F.lit(b))
    assert tuple(one(spark, f("Click", " "), f("Click", "[icon: x] !"), f("Click", "No missing icons."), f("Click", "Click [Icon: x]"), f("", "[Icon: x]"))) == ("empty", "only_icon", "no_missing", "apply", "apply")
    assert one(spark, X.icon_markers(F.lit("a [ICON : b] [Icon:] [Icon: c]")))[0] == ["[Icon: b]", "[Icon: c]"]


def test_notes(spark):
    text = "<b>x</b> [Table caption: no] [Icon: y] " + "word " * 60
    note = one(spark, X.clean_note(F.lit(text)))[0]
    assert note.startswith("x word") and note.endswith("word.") and len(note) <= 221


def test_artifacts(spark):
    files_ = spark.createDataFrame([("/o/a/auto/a_content_list.json",), ("/o/a_content_list.json",), ("/o/b/content_list.json",), ("/o/b/caption_content_list.json",), ("/o/c/x.json",)], "path string")
    got = files.choose_artifact(files_, spark.createDataFrame([("a",), ("b",), ("c",)], "stem string")).collect()
    assert sorted(map(tuple, got)) == [("a", "/o/a_content_list.json"), ("b", "/o/b/content_list.json")]


def test_boxes(spark):
    box = lambda *v: G.box(F.array(*[F.lit(float(x)) for x in v]))
    a, b = box(0, 0, 10, 10), box(5, 5, 15, 15)
    r = one(spark, G.intersection(a, b), G.overlap_ratio(a, b), G.distance(a, box(13, 14, 20, 20)), box(5, 5, 5, 9).isNull(), G.patch_box(F.lit(3), 2, 2)["x0"])
    assert tuple(r) == (25.0, 0.25, 5.0, True, 500.0)


def test_alignment_scores(spark):
    f = lambda covered, listed, here, every: G.box_alignment(F.lit(covered), F.lit(listed), F.lit(here), F.lit(every))
    assert tuple(one(spark, f(True, True, 2, 2), f(True, True, 1, 2), f(False, True, 1, 1), f(True, True, 0, 0), f(True, False, 0, 3))) == (1.0, 0.75, 0.0, 0.65, 0.0)


# --- blocks and chunks ---------------------------------------------------------------------------------------


def test_continuations(spark):
    rows = [("s", 0, 0, (100.0, 500.0, 900.0, 900.0), True, False), ("s", 1, 1, (100.0, 80.0, 900.0, 300.0), False, True), ("s", 2, 1, (100.0, 400.0, 900.0, 500.0), False, True), ("s", 3, 2, (0.0, 0.0, 9.0, 9.0), False, False)]
    df = spark.createDataFrame(rows, "source string, block_idx int, page_idx int, box struct<x0:double,y0:double,x1:double,y1:double>, is_master boolean, is_open boolean")
    assert [tuple(r) for r in B.continuation_map(df).collect()] == [("s", 1, 0)]


def test_outline(spark):
    outline = spark.createDataFrame([("s", 0, 1, "A"), ("s", 1, 3, "B"), ("s", 2, 2, "C"), ("s", 3, 3, "D")], "source string, outline_index bigint, level int, title string")
    assert [r.section_path for r in B.outline_paths(outline).orderBy("outline_index").collect()] == ["A", "A > B", "A > C", "A > C > D"]


def test_outline_tiers(spark):
    o = spark.createDataFrame([("s", 0, 0, "Setup  Guide", None), ("s", 0, 1, "SETUP GUIDE", 100.0), ("s", 0, 2, "Installing the device", None), ("s", 0, 3, "zzz", 500.0), ("s", 9, 4, "none", None)], "source string, page_idx int, outline_index int, title string, dest_y double")
    b = spark.createDataFrame([("s", 0, 0, "text", "Setup Guide", 90.0), ("s", 0, 1, "text", "Installing the devices", 300.0), ("s", 0, 2, "image", "", 500.0)], "source string, page_idx int, block_idx int, type string, text string, y0 double")
    got = {r.outline_index: (r.block_idx, r.match_type, r.confidence) for r in B.match_outline(o, b).collect()}
    assert got == {0: (0, "exact", 0.95), 1: (0, "normalized", 0.98), 2: (1, "fuzzy", 0.85), 3: (2, "page_fallback", 0.78), 4: (None, "unmatched", 0.0)}


def test_overlap_tail():
    texts = ["one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen"]
    chunks = C.fold_chunks([8, 6], texts, C.Profile(max_tokens=10, overlap_tokens=3, min_tokens=1))
    assert [t for _, t in chunks[1]] == ["six seven eight", texts[1]]
    assert len(C.fold_chunks([4, 4, 4], ["a b c d"] * 3, C.Profile(max_tokens=5, overlap_tokens=0, min_tokens=1))) == 3
    with pytest.raises(ValueError):
        C.Profile(mode="page")


def test_fold_without_overlap_is_the_expression(spark):
    lines = B.blocks_from_text(spark.read.parquet(f"{SF}/documents.parquet")).withColumn("tokens", C.item_cost("text"))
    got = {(r.doc_id, r.block_idx): r.chunk_idx for r in C.greedy_chunks(lines, keys=("doc_id",), order="block_idx", cost="tokens", max_tokens=100, min_tokens=30).collect()}
    by = {}
    for r in lines.collect():
        by.setdefault(r.doc_id, []).append(r)
    for doc, own in by.items():
        own.sort(key=lambda r: r.block_idx)
        for n, chunk in enumerate(C.fold_chunks([r.tokens for r in own], [r.text for r in own], C.Profile(max_tokens=100, overlap_tokens=0, min_tokens=30))):
            assert all(got[doc, own[i].block_idx] == n for i, _ in chunk)


def test_context_window_moves_room():
    before, own, after = B.context_window([(0, "ab"), (1, "t" * 8), (2, "c" * 200)], 1, 40)
    assert before == "ab" and own == "t" * 8 and 19 < X.approx_count(after) <= 38 and X.TRUNCATION_MARKER.strip() in after


# --- retrieval and evaluation ----------------------------------------------------------------------------------


def test_fusion(spark):
    route = spark.createDataFrame([(1, 7, 0), (1, 8, 1)], "query_id int, id int, rank int")
    got = {r.id: r.score for r in R.fuse({"visual": route, "dense": route.where("id = 8")}, weights={"visual": 1.5}, rrf_k=60).collect()}
    assert got[7] == pytest.approx(1.5 / 61) and got[8] == pytest.approx(2.5 / 62)


def test_prune_and_budget(spark):
    c = spark.createDataFrame([(1, s, t) for s, t in ((10.0, 6), (8.0, 5), (5.0, 1), (0.0, 1))], "query_id int, score double, tokens int")
    assert [R.prune(c, ratio=x).count() for x in (0, 0.2, 0.5, 1.0)] == [1, 2, 3, 4] and R.prune(c, ratio=0.5, floor=9).count() == 1
    assert [r.score for r in R.soft_budget(c, top_k=5, budget=10, order=[F.desc("score")]).collect()] == [10.0, 8.0]
    assert R.soft_budget(c, top_k=5, budget=0, order=[F.desc("score")]).count() == 4


def test_maxsim(spark):
    p = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0])], "page_id long, embedding array<double>")
    q = spark.createDataFrame([(5, 0, [1.0, 0.0]), (5, 1, [0.0, 2.0])], "query_id long, token_idx long, embedding array<double>")
    assert [(r.page_id, r.score) for r in R.maxsim_topk(p, q, 2).orderBy("rank").collect()] == [(0, 2.0), (1, round(math.sqrt(2), 6))]


def test_maxsim_of_many_tokens(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 2)  # blocks that cut the tokens of a query
    patches = [(i // 3, [math.cos(i), math.sin(i)]) for i in range(12)]
    tokens = [(i // 5, i, [math.cos(7 * i), math.sin(7 * i)]) for i in range(13)]
    want = []
    for q in range(3):
        scores = {page: round(sum(max(x * a + y * b for p, (a, b) in patches if p == page) for i, _, (x, y) in tokens if i == q), 6) for page in range(4)}
        want += [(q, page, s, n) for n, (page, s) in enumerate(sorted(scores.items(), key=lambda z: (-z[1], z[0]))[:3])]
    p = spark.createDataFrame(patches, "page_id long, embedding array<double>")
    q = spark.createDataFrame(tokens, "query_id long, token_idx long, embedding array<double>")
    got = R.maxsim_topk(p, q, 3).select("query_id", "page_id", "score", "rank").collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0], r[3])) == want
    assert R.maxsim_topk(p, q.limit(0), 3).count() == 0


def test_snippets_of_few_words(spark, monkeypatch):
    monkeypatch.setattr(E, "_PIECE", 64)  # texts are hashed in several pieces
    han = "".join(chr(0x4E00 + 37 * i % 5000) for i in range(150))
    url = "https://example.org/" + "/".join(f"part{i}" for i in range(12))
    docs = [(1, han), (2, f"see {url}, or not"), (3, "a" * 90), (4, "one two three four five six seven eight nine ten eleven"), (5, None), (6, "short"), (6, url), (7, "x" + han[30:70]), (8, "\U0001f600" * 41)]
    items = [(10, han[:40]), (11, han[110:]), (12, han[55:99]), (13, han[:39]), (14, url), (15, url[:45]), (16, "a" * 40), (17, "a" * 91), (18, docs[3][1][2:46]), (19, f"see {url}"), (20, None), (21, han[30:70]), (22, han[30:71]), (23, "\U0001f600" * 40)]
    got = E.snippet_matches(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = {(i, d) for i, t in items if t and len(t) >= 40 for d, text in docs if text and t in text}
    assert sorted(map(tuple, got)) == sorted(want)


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 1, 9), (1, 2, 5), (1, 3, 5)], "query_id int, rank int, id int")
    r = E.ranking_metrics(hits, spark.createDataFrame([(1, 5)], "query_id int, id int"), spark.createDataFrame([(1,), (2,)], "query_id int"), ks=(1, 2, 3)).orderBy("query_id").collect()
    assert (r[0].first_rank, r[0].reciprocal_rank, r[0].recall_1, r[0].recall_2, r[0].ndcg_3) == (2, 0.5, 0, 1, round(1 / math.log2(3), 6))
    assert (r[1].first_rank, r[1].recall_3, r[1].ndcg_3) == (None, 0, 0.0)


def test_direct_candidates(spark):
    fused = spark.createDataFrame([(1, 1, 0.25, 0.0), (1, 2, 0.0, 0.15), (1, 3, 0.0, 0.0)], "query_id int, id int, dense double, sparse double")
    points = spark.createDataFrame([(1, "s", "c", False), (2, "s", "c", None), (3, "s", None, True)], "id int, source string, chunk_id string, is_visual_page boolean")
    assert [(r.chunk_id, r.direct) for r in R.direct_candidates(fused, points).collect()] == [("c", 0.4)]


def test_tags(spark):
    chunks = spark.createDataFrame([("a", "old"), ("b", "old")], "source string, version string")
    tags = spark.createDataFrame([("a", None)], "source string, version string")
    assert {r.source: (r.version, r.tagged) for r in P.tag(chunks, tags, on="source").collect()} == {"a": (None, True), "b": (None, False)}
    with pytest.raises(Exception, match="no tags for b"):
        P.tag(chunks, tags, on="source", strict=True).collect()


def test_schema_check(spark):
    with pytest.raises(ValueError, match=r"b: missing.*c: int"):
        P.validate_schema(spark.createDataFrame([], "a int, c int"), {"a": "int", "b": "string", "c": "bigint"})


def test_nearest_rank(spark):
    rows = spark.createDataFrame([(1, float(v)) for v in range(10)] + [(1, None)], "g int, v double")
    assert tuple(N.nearest_rank(rows, keys=["g"], value="v", quantiles={"p50": 0.5, "p95": 0.95}).first()) == (1, 5.0, 9.0)


def test_quotas():
    assert S.quota_sizes(10) == {"text": 3, "operation": 2, "table": 2, "image_ui": 2, "mixed": 1}


# --- sources and streams ---------------------------------------------------------------------------------------


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"t": "x", "n": 1}, {"t": null}]')
    assert [(r.idx, r.t, r.n) for r in files.read_json_array(spark, str(tmp_path / "a.json"), "t string, n int").collect()] == [(0, "x", 1), (1, None, None)]
    (tmp_path / "b.jsonl").write_text('# note\n\n{"t": "y"}\n')
    assert [r.t for r in files.read_json_lines(spark, str(tmp_path / "b.jsonl"), "t string").collect()] == ["y"]
    (tmp_path / "c.jsonl").write_text("{bad\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        files.read_json_lines(spark, str(tmp_path / "c.jsonl"), "t string").collect()
    (tmp_path / "m.txt").write_text("a/b.pdf # first\n\n# none\nc.pdf\n")
    assert [r.relpath for r in files.read_manifest(spark, str(tmp_path / "m.txt")).collect()] == ["a/b.pdf", "c.pdf"]
    df = spark.createDataFrame([("x|y", [1, 2], None)], "b string, a array<int>, c string")
    files.write_csv(df, str(tmp_path / "csv"))
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "csv")).collect()] == [("1|2", "x|y", None)]
    assert [r.line for r in files.markdown(df, ["b", "c"]).collect()] == ["| b | c |", "| --- | --- |", "| x\\|y |  |"]
    assert files.directory_size(spark, str(tmp_path / "m.txt")).first().n_bytes == (tmp_path / "m.txt").stat().st_size


def test_sidecar(spark, tmp_path):
    text = "# c\nversion: 'v1 # x'\ncount: 3 # n\nmodels:\n  - A\n  - \"B\"\ntags: [x, y]\nnone: null\nok: true\n"
    assert files.parse_sidecar(text) == {"version": "v1 # x", "count": 3, "models": ["A", "B"], "tags": ["x", "y"], "none": None, "ok": True}
    (tmp_path / "a.yaml").write_text(text)
    assert {r.key: r.value for r in files.read_sidecars(spark, str(tmp_path / "a.yaml")).collect()}["models"] == "A|B"


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "points")
    files.upsert_points(spark, path, spark.createDataFrame([(1, "a"), (2, "b")], "id int, source string"))
    files.upsert_points(spark, path, spark.createDataFrame([(3, "b")], "id int, source string"))
    assert sorted((r.id, r.source) for r in files.scroll(spark, path, ["id", "source"]).collect()) == [(1, "a"), (3, "b")]


def test_stream(spark, tmp_path):
    log = spark.createDataFrame([("request", "ok", 1.0, m) for m in (0, 1, 9)] + [("request", "error", 3.0, 60)], "kind string, status string, duration double, m int")
    log = log.selectExpr("kind", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m) AS ts", "'r' AS run_id", "status", "duration", "CAST(NULL AS string) AS reason")
    metrics.append(log, str(tmp_path / "log"))
    metrics.drain(metrics.running_summary(metrics.read_stream(spark, str(tmp_path / "log"))), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted((r.n, r.n_ok) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1), (2, 2)]


def test_presets():
    p = presets.resolve("low", {"FOLIANT_FINAL_TOP_K": "7", "FOLIANT_IMAGE_OUTPUT": "yes"})
    assert (p.final_top_k, p.min_score_ratio, p.image_output) == (7, 0.4, True)
    assert presets.stage_slice("section", "index", tagging=False) == ("section", "patch", "caption", "chunk", "index")


# --- queries ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def value(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return x
        return round(float(x), 6) + 0.0 if hasattr(x, "__float__") else str(x)

    return sorted(map(repr, (tuple(map(value, r)) for r in rows)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert plain(df.select(*[f"`{c}`" for c in columns]).collect()) == plain(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and os.path.isdir(SF)


def test_small_rewrites(spark):
    context = "x\n### Nearby Text Before Image\n a \n### Nearby Text After Image\nb"
    r = one(spark, X.context_parts(F.lit(context)), X.usage_count(F.lit('{"total_tokens": "7"}'), "total_tokens"), X.usage_count(F.lit("{}"), "total_tokens"), X.replace_references(F.lit('{"a": ["old.pdf"]}'), {"old.pdf": "new.pdf"}))
    assert tuple(r[0]) == ("a", "", "b") and tuple(r)[1:] == (7, 0, '{"a": ["new.pdf"]}')


def test_paths_of_pages(spark):
    toc = [("s", 0, 1, "A", 1), ("s", 1, 2, "B", 2), ("s", 2, 3, "C", 2), ("s", 3, 2, "D", 4), ("s", 4, 1, "E", 6)]
    outline = spark.createDataFrame(toc, "source string, outline_index int, level int, title string, page int")
    got = {r.page: r.path for r in S.outline_at_page(outline, spark.createDataFrame([("s", p) for p in range(7)], "source string, page int")).collect()}
    want = {}
    for page in range(7):
        active = {}
        for _, _, level, title, at in toc:
            if at <= page:
                active = {k: v for k, v in active.items() if k < level} | {level: title}
        if active:
            want[page] = " > ".join(active[k] for k in sorted(active))
    assert got == want


def test_mixed_and_labelled(spark):
    rows = lambda n, kind: spark.createDataFrame([(i, kind) for i in range(n)], "query_no int, kind string")
    got = S.mixed_set(rows(30, "t"), rows(30, "v"), target=20).orderBy("query_id").collect()
    assert [r.kind for r in got] == ["t"] * 17 + ["v"] * 3 and got[-1].query_id == "full-020"
    runs = spark.createDataFrame([("a", "final"), ("b", "dpi"), ("c", "odd")], "run_id string, stage string")
    none = spark.createDataFrame([("a", 1.0)], "run_id string, mean double")
    assert [r.run_id for r in N.run_table(runs, none, none.withColumnRenamed("mean", "gpu")).collect()] == ["b", "a", "c"]
    assert [(r.run_id, r.label) for r in N.labelled_runs(runs, {"c": "C", "a": "A"}).collect()] == [("c", "C"), ("a", "A")]


# --- what SQL cannot say -----------------------------------------------------------------------------------------


def test_encoders(spark):
    encode = V.hashing_encoder(128)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    x, q = (V.fit_vectors(encode([r.text or "" for r in rows]), 128).astype(float) for rows in (docs, items))
    near = np.round(q @ x.T, 6)
    got = QUERIES["encoded_topk"](spark, SF).collect()
    assert len(got) == 5 * len(items)
    place, ids = {r.item_id: i for i, r in enumerate(items)}, {r.doc_id: i for i, r in enumerate(docs)}
    for r in got:
        row = near[place[r.query_id]]
        assert abs(row[ids[r.vec_id]] - r.score) < 2e-6 and (row > r.score + 2e-6).sum() <= r.rank
    with pytest.raises(ValueError):
        V.fit_vectors(np.zeros((2, 3)), 4)
    assert V.fit_vectors(np.zeros((1, 4)), 2).tolist() == [[0, 0]]
    odd = V.embed(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), lambda: V.hashing_encoder(8), size=8, prefix="q: ").collect()
    assert all(abs(sum(v * v for v in r.embedding) - 1) < 1e-6 for r in odd) and V.embed(spark.createDataFrame([], "text string"), lambda: V.unit_encoder(2), size=2).count() == 0


def test_services(spark, tmp_path):
    waits, calls = [], []

    def send(request):
        calls.append(request)
        if len(calls) < 3:
            raise OSError("busy")
        return {"ok": True}

    assert V.call_with_retries(send, {"a": 1}, sleep=waits.append)[0] == {"ok": True} and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        V.call_with_retries(lambda r: (_ for _ in ()).throw(OSError("down")), {}, sleep=waits.append)
    assert V.model_span(("section", "patch", "caption", "tag"), {"patch": "vl", "caption": "vl", "tag": "text"}, {"tag"}) == {"vl": ("patch", "caption")}
    store = V.Store(spark, str(tmp_path / "store"))
    points = V.Collection("c", dense={"v": 2}, payload={"page_idx": "int"})
    store.ensure(points)
    store.upsert(points, spark.createDataFrame([("1", 0, [1.0, 0.0], "s"), ("2", 0, [0.0, 1.0], "t")], "id string, page_idx int, v array<float>, source string"))
    store.upsert(points, spark.createDataFrame([("3", 0, [1.0, 0.0], "t")], "id string, page_idx int, v array<float>, source string"))
    assert sorted((r.id, r.source) for r in store.read(points).where("id IS NOT NULL").collect()) == [("1", "s"), ("3", "t")]
    with pytest.raises(ValueError, match="page_idx"):
        store.ensure(V.Collection("c", dense={"v": 2}, payload={"page_idx": "string"}))
    value, fell = V.with_fallback(F.lit(None).cast("string"), F.lit("out of memory"), F.lit("x"))
    with pytest.raises(Exception, match="out of memory"):
        one(spark, value, fell)


def test_page_cards_by_hand(spark):
    text = "12\nAn unusual heading\n\nThe quick brown fox jumps over the lazy dog near the river bank. Short one. "
    pages = spark.createDataFrame([("s", 0, text, 0, 1), ("s", 1, None, 0, 0), ("s", 2, "word word word other", 2, 0)], "source string, page_idx int, text string, n_images int, n_drawings int")
    paths = spark.createDataFrame([("s", 0, "A > B")], "source string, page_idx int, path string")
    got = {r.page_idx: r for r in S.page_cards(pages, paths, stop_words=("the", "over")).collect()}
    assert (got[0].title, got[0].modality, got[0].needs_review, got[0].path) == ("An unusual heading", ["text", "diagram"], True, "A > B")
    assert got[0].keywords[:3] == ["unusual", "heading", "quick"] and len(got[0].key_facts) == 1
    assert (got[1].title, got[1].modality, got[1].keywords, got[1].text_chars) == ("Page 2", ["visual"], [], 0)
    assert got[2].keywords == ["word", "other"] and got[2].modality == ["text", "image"]
    cards = QUERIES["page_cards"](spark, SF).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in cards:
        words = re.findall("[a-z][a-z0-9-]{3,}", docs[r.page_idx].lower())
        first = {w: i for i, w in reversed(list(enumerate(words)))}
        assert r.keywords == "|".join(sorted(first, key=lambda w: (-words.count(w), first[w]))[:12]) and r.text_chars == len(docs[r.page_idx])


def test_support_of_visual_questions(spark):
    rows = spark.read.parquet(f"{SF}/part.parquet").collect()
    got = {r.p_partkey: r.support for r in QUERIES["visual_supports"](spark, SF).collect()}
    for r in rows:
        k = r.p_partkey
        facts = [f"The {r.p_name} is here.", f"Size {r.p_size} mm.", f"{r.p_brand} made it."]
        query = f"{r.p_name if k % 2 == 0 else 'what'} {f'it has {r.p_size} mm' if k % 3 == 0 else 'none'}".lower()
        terms = [t for t in dict.fromkeys(re.findall(r"[a-z][a-z0-9-]{2,}|[0-9]+(?:\.[0-9]+)?", query)) if t not in ("the", "is")]
        chosen = [f for f in facts if len(own := [t for t in terms if t in f.lower()]) >= 2 or any(re.fullmatch(r"[0-9.]+", t) or (re.search("[a-z]", t) and re.search("[0-9]", t)) for t in own)]
        assert got[k] == (" ".join(chosen) if chosen else "a summary" if k % 4 == 0 else " ".join(facts))


def test_stratified(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rank = {r.doc_id: (r.h, r.doc_id) for r in docs.select("doc_id", F.xxhash64(F.lit(3), "doc_id").alias("h")).collect()}
    by = {}
    for r in docs.collect():
        by.setdefault(r.lang, []).append(r.doc_id)
    want = {(lang, i) for lang, ids in by.items() for i in sorted(ids, key=rank.get)[:5]}
    assert {(r.lang, r.doc_id) for r in QUERIES["stratified_sample"](spark, SF).collect()} == want


def test_contexts_and_outlines_are_linear(spark):
    """Folds over long documents: a second's work for tens of thousands of blocks."""
    import time

    began = time.perf_counter()
    assert C.greedy_numbers([7] * 200_000, 100, 20)[-1] == 200_000 // 14 - (200_000 % 14 == 0)
    assert B.stacked_paths([1, 2, 3] * 30_000, ["a", "b", "c"] * 30_000)[-1] == "a > b > c"
    blocks = [(i, f"text {i}") for i in range(20_000)]
    assert all(B.context_window(blocks, t, 60)[1] == f"text {t}" for t in range(0, 20_000, 4))
    assert len(B.neighbour_places([5] * 20_000, 10_000, 60)) == 11
    assert time.perf_counter() - began < 20


def test_question_sets(spark):
    part = lambda pdf, n: spark.createDataFrame([(pdf, i, f"{pdf}{i}") for i in n], "pdf string, n int, question string")
    targets = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2)], "pdf string, target int")
    got = S.assemble_questions([part("a", [1, 2]), part("b", [5, 6])], targets, fill=part("a", [7, 8]).unionByName(part("b", [9])).unionByName(part("c", [3])))
    assert [(r.qa_id, r.question) for r in got.orderBy("qa_id").collect()] == [("qa-0001", "a1"), ("qa-0002", "a2"), ("qa-0003", "b5"), ("qa-0004", "b6"), ("qa-0005", "a7"), ("qa-0006", "c3")]


def test_outline_with_all_tiers(spark):
    from foliant.plans.catalog import _headings

    outline, blocks = _headings(spark, SF)
    on_page = {}
    for r in blocks.collect():
        on_page.setdefault(r.source, []).append((r.block_idx, r.text or "", r.y0))
    norm = lambda t: re.sub(r"[\s\xa0]+", " ", t).strip().lower()
    want = {}
    for r in outline.collect():
        title = re.sub("e(.)", r"\1e", r.title) if r.source % 4 == 1 else r.title
        found = []
        for i, text, y in on_page[r.source]:
            tier = 4
            if text.strip():
                tier = 1 if " ".join(text.split()) == " ".join(title.split()) else 2 if norm(text) == norm(title) else 3 if X.similarity(norm(title), norm(text)) >= 0.92 else 4
            away = None if r.dest_y is None else abs(y - r.dest_y)
            found.append((tier, int(tier == 4 and r.dest_y is not None and y < r.dest_y), away is None, away or 0.0, i))
        tier, _, none, away, i = min(found)
        close = not none and away <= 50
        confidence = {1: (0.95, 1.0)[close], 2: (0.95, 0.98)[close], 3: (0.85, 0.88)[close], 4: 0.75 if none else 0.78}[tier]
        want[r.source] = (i, ("exact", "normalized", "fuzzy", "page_fallback")[tier - 1], confidence)
    got = {r.source: (r.block_idx, r.match_type, r.confidence) for r in QUERIES["outline_match_fuzzy"](spark, SF).collect()}
    assert got == want and {v[1] for v in want.values()} >= {"exact", "page_fallback"}


def test_bm25_makes_no_row_for_a_query_and_a_document(spark, monkeypatch):
    """Repeated ids, null and empty texts, letters of any script and queries in several blocks, against plain Python."""
    monkeypatch.setattr(R, "BLOCK_PAIRS", 4)
    texts = [(1, "Ähre b b c"), (1, "c Ähre x b"), (1, "b"), (2, None), (3, ""), (4, "日本 b-c C"), (5, "C c c d"), (6, "zz"), (7, "c b"), (8, "c b")]
    asked = [(1, "b c"), (1, "C ähre"), (2, "d 日本"), (3, "c B"), (4, "none"), (5, None), (6, "b c"), (7, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, query string")
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
    tf = {}
    for i, t in texts:
        for w in words(t):
            tf[i, len(words(t)), w] = tf.get((i, len(words(t)), w), 0) + 1
    df = {w: sum(x[2] == w for x in tf) for _, _, w in tf}
    mean = sum(len(words(t)) for _, t in texts) / len(texts)
    want = []
    for q in {q for q, _ in asked}:
        terms, score = {w for i, t in asked if i == q for w in words(t)}, {}
        for (i, dl, w), n in tf.items():
            if w in terms:
                score[i] = score.get(i, 0) + math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * dl / mean))
        want += [(q, i, round(s, 6), n) for n, (i, s) in enumerate(sorted(score.items(), key=lambda x: (-round(x[1], 6), x[0]))[:3])]
    got = R.bm25_topk(docs, queries, 3)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    # Only the numbers of the queries meet their ids by a join.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert R.bm25_topk(docs, queries.where("query_id > 9"), 3).count() == 0 and R.bm25_topk(docs.where("doc_id > 9"), queries, 3).count() == 0


def test_bm25_adds_up_the_lengths_of_an_id(spark):
    """A document with several lengths is weighed by all of them before a slice is left out."""
    rows = [(i, "b b b b b b b b") for i in range(199)] + [(199, "b c"), (199, "b d d")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = R.bm25_topk(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "b")], "query_id long, query string"), 1)
        assert [r.doc_id for r in got.collect()] == [199]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bm25_bounds_what_leaves_the_tasks(spark, monkeypatch):
    """Documents below the k best of those scored ahead leave no task, and the k best of all stay the same, equal scores too."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d", "e", "f"], rng.integers(1, 40)))) for i in range(2000)]
    rows += [(i + 2000, t) for i, t in rows[:500]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    queries = spark.createDataFrame([(1, "a b"), (2, "c d e"), (3, "none"), (4, "f")], "query_id long, query string")
    want = sorted(map(tuple, R.bm25_topk(docs, queries, 4).collect()))
    sets = {np.array(x, np.int32).tobytes(): n for n, x in enumerate([[0, 1], [2, 3, 4], [5]])}
    left = lambda: R._bm25(docs, list("abcdef"), sets, 4).count()
    before = left()
    monkeypatch.setattr(R, "_MANY", 0, raising=False)
    monkeypatch.setattr(R, "_AHEAD", 2, raising=False)
    assert sorted(map(tuple, R.bm25_topk(docs, queries, 4).collect())) == want and len(want) == 12
    assert 12 <= left() < before / 2


def test_dense_keeps_k_of_a_task(spark, monkeypatch):
    """However many Arrow batches and slices a task has, k rows of each query leave it; a vector that is no number hides no other."""
    monkeypatch.setattr(R, "_CELLS", 30, raising=False)
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(95, 4)), 1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(95, [float("nan")] * 4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    asked = vectors.where("vec_id < 10").withColumnRenamed("vec_id", "query_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        part = R._scan(vectors, asked.collect(), 3)
        assert part.count() == 30
        got = sorted((r.query_id, r["rank"], r.vec_id) for r in R.dense_topk(vectors, asked, 3).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    x = x.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert got == [(i, n, int(v)) for i in range(10) for n, v in enumerate(np.lexsort((np.arange(95), -np.round(x @ x[i], 6)))[:3])]


def test_metrics_of_classes_have_no_row_for_a_gold_item(spark):
    """class_metrics() is ranking_metrics() on all pairs of a query and an item of its classes; its plan has no such pairs."""
    items = spark.createDataFrame([(i, i % 3) for i in range(20)] + [(4, 0), (5, None), (7, 1)], "id int, label int")
    classes = spark.createDataFrame([(1, 0), (1, 1), (2, 2), (3, None), (4, 9)], "query_id int, label int")
    hits = spark.createDataFrame([(q, r, (q * 5 + r) % 20) for q in range(1, 6) for r in range(1, 8)], "query_id int, rank int, id int")
    asked = spark.range(1, 6).select(F.col("id").cast("int").alias("query_id"))
    want = E.ranking_metrics(hits, classes.join(items, "label").select("query_id", "id"), asked)
    assert sorted(map(tuple, E.class_metrics(hits, items, classes, asked).collect())) == sorted(map(tuple, want.collect()))
    assert "labels" in QUERIES["retrieval_metrics"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_alignment_by_page_is_that_of_its_evidence(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(2)
    patches = spark.createDataFrame([(p, i, rng.normal(size=4).round(1).tolist()) for p in range(5) for i in range(p + 1)], "page_id int, patch_idx int, embedding array<float>")
    tokens = spark.createDataFrame([(i, rng.normal(size=4).round(1).tolist()) for i in range(8)], "token_idx int, embedding array<float>")
    boxes = spark.createDataFrame([(p, c, (x, 0.0, x + 350.0, 700.0)) for p in range(6) for c, x in ((0, 0.0), (0, 200.0), (1, 500.0), (2, 990.0))], "page_id int, chunk_idx int, box struct<x0:double,y0:double,x1:double,y1:double>")
    patch, overlap = G.patch_box(F.col("patch_idx"), 4, 4), G.overlap_ratio(F.col("patch"), F.col("box"))
    want = R.align_chunks(R.patch_similarity(patches, tokens, 2).withColumn("patch", patch), boxes, tokens, overlap=overlap)
    got = R.align_pages(patches, tokens, boxes, 2, patch=patch, overlap=overlap)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5
    # No evidence row, of a page and a token, leaves the step that finds it.
    assert "n_evidence" in str(next(x for x in QUERIES["patch_alignment"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in x))


def test_question_ids_beyond_four_places(spark, tmp_path):
    """The registered query as its SQL has it, whose lpad() cuts at four places; the operator's own ids stay apart."""
    spark.range(10_050).select((F.col("id") * 40).alias("doc_id"), F.lit("s").alias("source"), F.lit("de").alias("lang")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["assembled_questions"]).fetchall()
    assert sorted(map(tuple, QUERIES["assembled_questions"](spark, str(tmp_path)).select("pdf", "n", "question", "qa_id").collect())) == sorted(want)
    d = spark.read.parquet(f"{tmp_path}/documents.parquet").select(F.col("source").alias("pdf"), F.col("doc_id").alias("n"), F.lit("Q").alias("question"))
    assert S.assemble_questions([d], d.select("pdf", F.lit(1).alias("target")).distinct(), fill=d.limit(0)).select("qa_id").distinct().count() == 10_050


def test_keywords_shuffle_texts_not_words(spark):
    got = S.keywords(spark.read.parquet(f"{SF}/documents.parquet"), k=5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange") > plan.index("Generate")
    twice = spark.createDataFrame([(1, "alpha beta beta"), (1, "alpha gamma alpha"), (None, "delta")], "doc_id int, text string")
    assert sorted(map(tuple, S.keywords(twice.where("doc_id = 1"), k=2).collect())) == [(1, "alpha", 3, 1), (1, "beta", 2, 2)] and S.keywords(twice, k=2).count() == 3


def test_folds_of_documents_are_cut_small(spark, monkeypatch):
    """No fold starts a group at a time in pandas, and slices and small batches change no row."""
    monkeypatch.setattr(B, "GROUPS_AT_ONCE", 2)
    monkeypatch.setattr(B, "CHARS_AT_ONCE", 50)
    rows = [(d, i, f"text {d} {i}" if i % 4 else None) for d in (1, 2, 3, None, 4) for i in range(9)]
    blocks = spark.createDataFrame(rows, "doc_id int, block_idx int, text string")
    got = B.truncated_contexts(blocks, blocks.where("block_idx = 5"), key="doc_id", budget=60)
    content = lambda d: [(i, t or "") for x, i, t in rows if x == d]
    assert sorted(map(tuple, got.collect())) == [(d, 5, *B.context_window(content(d), 5, 60)) for d in (1, 2, 3, 4)]
    over = C.overlapping_chunks(blocks, key="doc_id", order="block_idx", profile=C.Profile(max_tokens=9, overlap_tokens=3, min_tokens=1))
    want = sum(len(C.fold_chunks([max(1, len(X.PYTHON_TOKEN.findall(t))) for _, t in content(d)], [t for _, t in content(d)], C.Profile(max_tokens=9, overlap_tokens=3, min_tokens=1))) for d in (1, 2, 3, None, 4))
    assert over.count() == want
    assert all("FlatMapGroups" not in x._jdf.queryExecution().optimizedPlan().toString() for x in (got, over))


def test_route_ablation_plans_its_routes_once(spark):
    plan = QUERIES["route_ablation"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # One scan of vectors; of documents their numbers and their scores.
    assert plan.count("MapInArrow") == 3
