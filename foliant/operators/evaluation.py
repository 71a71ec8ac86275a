"""Evaluation: gold remapping, ranking metrics, answer scores and their summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KS = (1, 3, 5, 10)
SNIPPET_CHARS = 40
#: Keys of snippets that are sent to the executors, at most.
BROADCAST_KEYS = 1_000_000
#: Characters of a text that are hashed at once, and the base of the hash.
_PIECE, _BASE = 1 << 18, 0x9E3779B97F4A7C15


def evidence_anchors(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Blocks, pages and missing ids of each query's gold chunks.

    queries has query_id and gold (array of chunk ids); chunks have chunk_id, blocks and pages (arrays).
    """
    gold = queries.select("query_id", F.explode_outer("gold").alias("chunk_id"))
    found = gold.join(chunks.select("chunk_id", "blocks", "pages"), "chunk_id", "left")
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    missing = F.array_sort(F.collect_set(F.when(F.col("blocks").isNull(), F.col("chunk_id"))))
    return found.groupBy("query_id").agg(flat("blocks").alias("blocks"), flat("pages").alias("pages"), missing.alias("missing"))


def remap_by_blocks(anchors: DataFrame, chunks: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """(query_id, chunk_id, overlap) of new chunks that share a block with the anchor."""
    a = anchors.select("query_id", doc, F.explode("blocks").alias("block"))
    c = chunks.select(doc, "chunk_id", F.explode("blocks").alias("block"))
    return a.join(c, [doc, "block"]).groupBy("query_id", doc, "chunk_id").agg(F.count_distinct("block").alias("overlap"))


def _window_minima(text: str) -> np.ndarray:
    """The distinct least gram hashes of all windows of SNIPPET_CHARS characters of text."""
    out = []
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    for at in range(0, len(points) - SNIPPET_CHARS + 1, _PIECE):
        with np.errstate(over="ignore"):
            h, step = {1: points[at : at + _PIECE + SNIPPET_CHARS - 1].astype(np.uint64) + np.uint64(1)}, 1
            while step < 16:
                h[2 * step] = h[step][:-step] * np.uint64(pow(_BASE, step, 1 << 64)) + h[step][step:]
                step *= 2
            grams = h[16][:-4] * np.uint64(pow(_BASE, 4, 1 << 64)) + h[4][16:]
            grams = (grams ^ (grams >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            grams ^= grams >> np.uint64(32)
        for step in (1, 2, 4, 8):
            grams = np.minimum(grams[:-step], grams[step:])
        # Minima of 16 grams, and of 21 from two of them.
        out.append(np.unique(np.minimum(grams[:-5], grams[5:])))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _anchored(rows: DataFrame, known: Broadcast | None = None) -> DataFrame:
    """rows without their last column, a text, and a row for each key of it (of the sorted known ones): see snippet_matches()."""
    names = rows.columns[:-1]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                keys = [_window_minima(t.as_py()) for t in part.column(len(names))]
                if known is not None:
                    keys = [np.intersect1d(k, known.value, assume_unique=True) for k in keys]
                of = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
                found = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(i).take(of) for i in range(len(names))] + [pa.array(found.view(np.int64))], [*names, "key"])

    return rows.mapInArrow(run, f"{kinds}, key long")


def snippet_matches(snippets: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id) where a snippet of SNIPPET_CHARS characters or more is contained in a text.

    Candidates meet on the least hash of a 20-character gram in the snippet's first SNIPPET_CHARS characters;
    a text has the least hash of each window of that length. So each text that holds the snippet meets it,
    with blanks or without, and only what meets is compared. Keys that no snippet has go where the text is
    read, as long as the snippets' keys are few enough to be sent there.
    """
    s = _anchored(snippets.where(F.char_length("text") >= SNIPPET_CHARS).select("item_id", F.col("text").alias("snippet"), F.substring("text", 1, SNIPPET_CHARS).alias("head")))
    wanted = s.select("key").distinct().limit(BROADCAST_KEYS + 1).toArrow().column(0).to_numpy()
    known = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.view(np.uint64))) if len(wanted) <= BROADCAST_KEYS else None
    keys = _anchored(docs.where("text IS NOT NULL").select("doc_id", "text"), known)
    pairs = s.join(keys, "key").select("item_id", "snippet", "doc_id")
    return pairs.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "snippet")).select("item_id", "doc_id").distinct()


def best_primary(candidates: DataFrame) -> DataFrame:
    """The candidate with the most primary, evidence and page overlap, then fewest tokens, lowest index, largest id (I4)."""
    key = F.struct("primary_overlap", "evidence_overlap", "page_overlap", -F.col("tokens"), -F.col("chunk_idx"), "chunk_id")
    return candidates.groupBy("query_id").agg(F.max_by("chunk_id", key).alias("primary_chunk_id"))


def remap_source(by_block: Column, by_snippet: Column, pages: Column) -> Column:
    """Where remapped gold came from."""
    return F.when(by_block > 0, "block_overlap").when(by_snippet > 0, "snippet").when(pages > 0, "page_fallback").otherwise("none")


def ranking_metrics(hits: DataFrame, gold: DataFrame, queries: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Recall, coverage, reciprocal rank and nDCG of each query at each k.

    hits has query_id, rank (from 1) and id; gold has query_id and id; queries lists all query ids. Each
    gold id gains once, at its first rank; queries without hits or gold count with zeros.
    """
    g = gold.select("query_id", "id").distinct()
    n = g.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    return _metrics(hits.join(g, ["query_id", "id"]), n, queries, ks)


def class_metrics(hits: DataFrame, items: DataFrame, classes: DataFrame, queries: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """ranking_metrics() where all items of a query's classes are its gold, without a row for a query and a gold item.

    items has id and label, classes has query_id and label. What is counted of a class is counted once for all its queries.
    """
    own, asked = items.where("label IS NOT NULL").select("id", "label").distinct(), classes.where("label IS NOT NULL").select("query_id", "label").distinct()
    # An item of several classes counts once for a query: under all the classes that it is in.
    kinds = own.groupBy("id").agg(F.sort_array(F.collect_set("label")).alias("labels")).groupBy("labels").agg(F.count("*").alias("n"))
    n = asked.join(kinds.select("labels", "n", F.explode("labels").alias("label")), "label").select("query_id", "labels", "n").distinct().groupBy("query_id").agg(F.sum("n").alias("n_gold"))
    good = hits.join(own, "id").join(asked, ["query_id", "label"], "left_semi")
    return _metrics(good, n, queries, ks)


def _metrics(good: DataFrame, n: DataFrame, queries: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """good has query_id, id and rank of hits that are gold, n the number of gold ids of each query."""
    good = good.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    parts = [F.min("rank").alias("first_rank")]
    for k in ks:
        in_k = F.col("rank") <= k
        parts += [F.count_if(in_k).alias(f"hits_{k}"), F.sum(F.when(in_k, F.log(F.lit(2.0)) / F.log(F.col("rank") + 1.0))).alias(f"dcg_{k}")]
    out = queries.select("query_id").join(n, "query_id", "left").join(good.groupBy("query_id").agg(*parts), "query_id", "left")
    columns = [F.coalesce("n_gold", F.lit(0)).alias("n_gold"), F.col("first_rank").cast("long").alias("first_rank"), F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6).alias("reciprocal_rank")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.greatest(F.lit(1), F.coalesce("n_gold", F.lit(0)))).cast("int")), F.lit(0.0), lambda a, r: a + F.log(F.lit(2.0)) / F.log(r + 1.0))
        found = F.coalesce(f"hits_{k}", F.lit(0))
        columns += [
            (found > 0).cast("int").alias(f"recall_{k}"),
            F.round(F.coalesce(found / F.col("n_gold"), F.lit(0.0)), 6).alias(f"coverage_{k}"),
            F.round(F.coalesce(f"dcg_{k}", F.lit(0.0)) / ideal, 6).alias(f"ndcg_{k}"),
        ]
    return out.select("query_id", *columns)


def primary_gold(explicit: Column, strict: Column, gold: Column) -> Column:
    """The explicit primary chunk, else the first strict one, else the first gold one, sorted."""
    return F.coalesce(F.nullif(explicit, F.lit("")), F.try_element_at(F.array_sort(strict), F.lit(1)), F.try_element_at(F.array_sort(gold), F.lit(1)))


def hit_features(hits: DataFrame) -> DataFrame:
    """Top scores by route, visual hits and two failure flags of each query.

    hits has query_id, rank, dense, sparse, visual, direct, is_primary and on_gold_page.
    """
    first = lambda c, n: F.round(F.max(F.when(F.col("rank") == 1, F.col(c))), n)
    primary = F.max(F.col("is_primary").cast("int"))
    top_visual = F.max(F.when(F.col("rank") == 1, ((F.col("visual") > 0) & (F.col("visual") > F.col("direct"))).cast("int")))
    return hits.groupBy("query_id").agg(
        first("dense", 8).alias("top_dense"), first("sparse", 8).alias("top_sparse"), first("visual", 8).alias("top_visual"), first("direct", 8).alias("top_direct"),
        F.count_if(F.col("visual") > 0).alias("n_visual"),
        (F.max((F.col("on_gold_page") & (F.col("visual") > 0)).cast("int"))).alias("visual_gold_page"),
        (F.max(F.col("on_gold_page").cast("int")) * (1 - primary)).alias("misallocated"),
        (F.coalesce(top_visual, F.lit(0)) * (1 - primary)).alias("visual_overweight"),
    )


def page_scores(hits: DataFrame) -> DataFrame:
    """Scores of hits spread evenly over their pages (K2). hits has query_id, score and pages (array).

    Shares are summed as whole billionths, so that a sum does not depend on the order of rows.
    """
    share = F.floor(F.col("score") / F.size("pages") * 1e9 + 0.5).cast("long")
    rows = hits.where(F.size("pages") > 0).select("query_id", share.alias("s"), F.explode("pages").alias("page_idx"))
    out = rows.groupBy("query_id", "page_idx").agg((F.sum("s") / 1e9).alias("score"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "page_idx")))


def pass_scores(passes: DataFrame) -> DataFrame:
    """Mean, spread and failure types over the review passes of each query (K8).

    passes has run_id, query_id, pass_id (1 to 3), score and failure; scores are held to 0..5.
    """
    held = F.least(F.greatest(F.col("score").cast("double"), F.lit(0.0)), F.lit(5.0))
    rows = passes.withColumn("s", held)
    by_pass = [F.max(F.when(F.col("pass_id") == i, F.col("s"))).alias(f"score_pass_{i}") for i in (1, 2, 3)]
    return rows.groupBy("run_id", "query_id").agg(F.round(F.avg("s"), 6).alias("answer_score"), F.round(F.max("s") - F.min("s"), 6).alias("disagreement"), *by_pass, F.array_join(F.array_sort(F.collect_set(F.nullif("failure", F.lit("")))), "|").alias("failures"))


def run_summary(scored: DataFrame, *, context: str = "context_tokens", total: str = "total_tokens") -> DataFrame:
    """Mean, median and shares of scores, mean tokens and score for a thousand tokens of each run (K9)."""
    share = lambda c: F.round(F.coalesce(F.avg(F.when(F.col("answer_score").isNotNull(), c.cast("double"))), F.lit(0.0)), 4)
    zero = lambda c, n: F.round(F.coalesce(c, F.lit(0.0)), n)
    per = lambda c: zero(F.avg("answer_score") / F.nullif(F.avg(c) / 1000, F.lit(0.0)), 4)
    return scored.groupBy("run_id").agg(
        F.count("*").alias("n_queries"), zero(F.avg("answer_score"), 4).alias("mean_score"), zero(F.median("answer_score"), 4).alias("median_score"),
        share(F.col("answer_score") >= 4).alias("high_rate"), share(F.col("answer_score") <= 2).alias("low_rate"),
        zero(F.avg(total), 2).alias("mean_total_tokens"), zero(F.avg(context), 2).alias("mean_context_tokens"), per(context).alias("retrieval_efficiency"), per(total).alias("answering_efficiency"),
    )


def answer_summary(rows: DataFrame) -> DataFrame:
    """Counts, leaks, missing usage, mean latency and mean tokens over positive counts (K4)."""
    return rows.agg(F.count("*").alias("n"), F.sum("leaked").alias("n_leaked"), F.count_if(F.col("tokens").isNull()).alias("n_missing_usage"), F.round(F.avg("latency"), 6).alias("mean_latency"), F.round(F.avg(F.when(F.col("tokens") > 0, F.col("tokens"))), 6).alias("mean_tokens"))


def rescore_archived(archived: DataFrame, fresh: DataFrame) -> DataFrame:
    """New answers on archived contexts: latency is the archived retrieval and the new answering (K5)."""
    return archived.join(fresh.withColumnRenamed("latency", "answering"), "query_id", "left").select("query_id", "retrieval", F.coalesce("answering", F.lit(0.0)).alias("answering"), (F.col("retrieval") + F.coalesce("answering", F.lit(0.0))).alias("latency"), F.col("answering").isNull().alias("pending"))


def normalized_queries(rows: DataFrame) -> DataFrame:
    """query_id, query, answer and evidence by any of their names (K7)."""
    some = lambda *names: F.coalesce(*[F.col(n) for n in names if n in rows.columns], F.lit(None).cast("string"))
    return rows.select(some("query_id", "id").alias("query_id"), some("query", "question").alias("query"), some("answer", "expected_answer").alias("answer"), some("evidence", "support").alias("evidence"))


def evidence_summary(evidence: Column, limit: int) -> Column:
    """Evidence strings joined by ' ; ', clipped."""
    return F.left(F.array_join(evidence, " ; "), F.lit(limit))
