"""Benchmark runs: request logs, checkpoints, groups, quality scores and search control."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X


def nearest_rank(rows: DataFrame, *, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """The value at place floor((n - 1) * q + 0.5) of each group, counted from zero (L2)."""
    rows = rows.where(F.col(value).isNotNull())
    w = Window.partitionBy(*keys)
    placed = rows.select(*keys, F.col(value).alias("v"), (F.row_number().over(w.orderBy(value)) - 1).alias("i"), F.count("*").over(w).alias("n"))
    return placed.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == F.floor((F.col("n") - 1) * q + 0.5), F.col("v"))).alias(name) for name, q in quantiles.items()])


def request_summary(log: DataFrame, *, keys: list[str], elapsed: Column) -> DataFrame:
    """Counts by status, rate a minute, mean and nearest-rank percentiles of durations (L1).

    log has status, duration, decision and the keys.
    """
    counts = log.groupBy(*keys).agg(
        F.count("*").alias("n_requests"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.coalesce(F.col("status"), F.lit("")) != "ok").alias("n_errors"),
        F.count_if(F.contains(F.lower(F.coalesce("status", F.lit(""))), F.lit("timeout"))).alias("n_timeouts"), F.count_if(F.contains(F.coalesce("decision", F.lit("")), F.lit("fallback"))).alias("n_fallbacks"),
        F.count_if(F.col("decision") == "invalid_rejected").alias("n_rejected"), F.round(F.avg("duration"), 6).alias("mean_duration"),
        F.round(F.when(F.max(elapsed) > 0, F.count("*") / F.max(elapsed) * 60).otherwise(0.0), 6).alias("per_minute"),
    )
    marks = nearest_rank(log, keys=keys, value="duration", quantiles={"p50": 0.5, "p95": 0.95})
    return counts.join(marks, keys, "left")


def checkpoint_gaps(rows: DataFrame, *, key: str, position: str) -> DataFrame:
    """The largest step between sorted positions, the first from zero (L3)."""
    w = Window.partitionBy(key).orderBy(position)
    return rows.select(key, (F.col(position) - F.lag(position, 1, 0).over(w)).alias("gap")).groupBy(key).agg(F.max("gap").alias("max_gap"), F.count("*").alias("n"))


def by_reason(rows: DataFrame, *, reason: str, value: str) -> DataFrame:
    """Count and sum for each reason (L4)."""
    return rows.groupBy(F.coalesce(reason, F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))


def sample_summary(rows: DataFrame, *, keys: list[str], value: str, bad: Column) -> DataFrame:
    """Mean and largest of samples without errors."""
    return rows.where(~bad).groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("max"))


def group_metric(rows: DataFrame, *, keys: list[str], value: str) -> DataFrame:
    """Mean and number of a metric in each group."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean"), F.count("*").alias("n"))


def best_per_stage(rows: DataFrame, *, stage: str, value: str, tie: str) -> DataFrame:
    """The first row of the largest value of each stage."""
    w = Window.partitionBy(stage).orderBy(F.desc(value), tie)
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def quality_by_group(rows: DataFrame, *, a: str, b: str, hit: Column, value: str) -> DataFrame:
    """Count, share and mean by each of two keys on its own: grouping sets."""
    x = rows.select(a, b, hit.cast("int").alias("hit"), F.col(value).alias("v"))
    out = x.groupingSets([[F.col(a)], [F.col(b)]], F.col(a), F.col(b)).agg(F.grouping(a).alias("g"), F.count("*").alias("n"), F.sum("hit").cast("long").alias("hits"), F.round(F.avg("v"), 6).alias("mean"))
    return out.select(F.when(F.col("g") == 0, a).otherwise(b).alias("kind"), F.coalesce(F.col(a).cast("string"), F.col(b).cast("string")).alias("key"), "n", "hits", F.round(F.when(F.col("n") > 0, 100.0 * F.col("hits") / F.col("n")).otherwise(0.0), 6).alias("percent"), "mean")


def patch_quality(target: Column, strict: Column, wrong: Column, missed: Column, false_hits: Column, preserved: Column) -> Column:
    """A score from 0 to 5 from icon counts."""
    base = 5.0 - missed * 2.0 - wrong * 1.5 - false_hits * 1.0
    recall = strict / F.nullif(target, F.lit(0))
    base = F.when((strict == 0) & ((wrong > 0) | (missed > 0)), F.least(base, F.lit(2.0))).when(recall < 0.5, F.least(base, F.lit(2.0))).when(recall < 0.8, F.least(base, F.lit(3.0))).otherwise(base)
    rounded = F.greatest(F.lit(0), F.least(F.lit(5), (base + 0.5).cast("int")))
    none = F.when(false_hits <= 0, 5).when(false_hits == 1, 3).when(false_hits == 2, 2).otherwise(1)
    return F.when(~preserved, 0).when(target <= 0, none).otherwise(rounded)


def early_stop(rows: DataFrame, *, key: str, order: str, timeout_ratio: float = 0.05, drop: float = 0.1, p95_ratio: float = 2.0) -> DataFrame:
    """Whether a search over rising concurrency stops at a row, against the best row before it.

    rows has n_requests, n_errors, n_timeouts, per_minute and p95; the best is that of the highest rate.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(F.struct(F.col("per_minute").alias("rate"), (-F.col(order)).alias("first"), F.col("p95").alias("p95"))).over(before)
    rows = rows.withColumn("best", best)
    reason = (
        F.when(F.col("n_errors") > 0, "errors")
        .when(F.col("n_timeouts") / F.greatest(F.lit(1), "n_requests") > timeout_ratio, "timeouts")
        .when((F.col("best.rate") > 0) & (F.col("per_minute") < F.col("best.rate") * (1 - drop)), "throughput")
        .when((F.col("best.p95") > 0) & (F.col("p95") > F.col("best.p95") * p95_ratio), "latency")
        .otherwise("")
    )
    return rows.select(key, order, reason.alias("reason"), (reason != "").alias("stop"))


def run_grid(spark: SparkSession, **axes: list) -> DataFrame:
    """All combinations of named parameter lists, numbered."""
    names = list(axes)
    rows = [(i, *values) for i, values in enumerate(product(*axes.values()), 1)]
    kinds = {int: "int", float: "double", str: "string", bool: "boolean"}
    return spark.createDataFrame(rows, "run_no int, " + ", ".join(f"{n} {kinds[type(axes[n][0])]}" for n in names))


def cross_page_tables(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that each continued table spans, most first (L15). pairs has source, block_idx, master_idx."""
    spans = pairs.join(pages.select("source", "block_idx", "page_idx"), ["source", "block_idx"]).groupBy("source", "master_idx").agg((F.count_distinct("page_idx") + 1).alias("span_pages"))
    return spans.orderBy(F.desc("span_pages"), "source", "master_idx")


def stratified_sample(rows: DataFrame, *, strata: str, key: str, quota: int, seed: int) -> DataFrame:
    """quota rows of each stratum in the order of a seeded hash."""
    w = Window.partitionBy(strata).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= quota).drop("k")


# The order of the stages of a benchmark.
STAGE_ORDER = ("baseline", "dpi", "quality", "concurrency", "batch-size", "checkpoint", "dpi-confirm", "final")


def run_table(params: DataFrame, summaries: DataFrame, samples: DataFrame, *, on: str = "run_id", stage: str = "stage") -> DataFrame:
    """Parameters, summary and samples of each run, in order of the stages."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STAGE_ORDER)), F.col(stage)), F.lit(0)), F.lit(99))
    return params.join(summaries, on, "left").join(samples, on, "left").orderBy(place, on)


def labelled_runs(rows: DataFrame, labels: dict[str, str], *, on: str = "run_id") -> DataFrame:
    """Named runs with their labels, in order of the labels given."""
    names = rows.sparkSession.createDataFrame([(i, k, v) for i, (k, v) in enumerate(labels.items())], f"place int, {on} string, label string")
    return rows.join(F.broadcast(names), on).orderBy("place").drop("place")


# --- review of patches -----------------------------------------------------------------------------------

# Fixed value: words of an action, which a negative control must not have.
ACTION_WORDS = r"(?i)\b(?:click|tap|press|select|choose|open|double-click|right-click)\b"


def stage_pages(stage: str, main: DataFrame, quality: DataFrame, *, include_quality: bool = False) -> DataFrame:
    """The pages that a stage works on: those for quality, the main ones, or both."""
    if stage == "quality":
        return quality.distinct()
    return main.unionByName(quality).distinct() if include_quality else main.distinct()


def quality_rows(fields: DataFrame, main: DataFrame, quality: DataFrame, *, negatives: int, seed: int = 1) -> DataFrame:
    """Fields of the pages for quality, and a few of main pages without an action word as negative controls.

    fields has source, block_idx, page_idx, field and text; the controls are the first by a seeded hash.
    """
    rows = fields.where(F.btrim("text") != "").withColumn("preview", X.snippet("text", 160))
    keys = ["source", "page_idx"]
    good = rows.join(quality.select(*keys).distinct(), keys, "left_semi").withColumn("sample_label", F.lit("quality_page"))
    other = rows.join(quality.select(*keys).distinct(), keys, "left_anti").join(main.select(*keys).distinct(), keys, "left_semi").where(~F.col("text").rlike(ACTION_WORDS))
    chosen = other.orderBy(F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col("source").cast("string"), F.col("block_idx").cast("string"), "field")), "source", "block_idx", "field").limit(max(0, negatives))
    out = good.unionByName(chosen.withColumn("sample_label", F.lit("negative_control")))
    return out.select("source", "block_idx", "page_idx", (F.col("page_idx") + 1).alias("pdf_page"), "field", "sample_label", "preview")


def review_worklist(samples: DataFrame, runs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Each sample in each run with the field's text before and after it.

    samples has sample_id, block_idx and field; runs has run_id and dpi; before and after have run_id, block_idx,
    field and text. A row for each run is what is wanted, so samples meet runs through the runs' own fields.
    """
    keys = ["run_id", "block_idx", "field"]
    both = before.select(*keys, F.col("text").alias("original_text")).join(after.select(*keys, F.col("text").alias("patched_text")), keys, "full_outer")
    found = samples.join(both, ["block_idx", "field"]).join(F.broadcast(runs), "run_id")
    return found.select("dpi", "run_id", "sample_id", "block_idx", "field", F.coalesce("original_text", F.lit("")).alias("original_text"), F.coalesce("patched_text", F.lit("")).alias("patched_text"))


def backfill_scores(scores: DataFrame, worklist: DataFrame) -> DataFrame:
    """Icon counts with text_preserved and the quality score.

    scores has dpi, sample_id and the counts; worklist has dpi, sample_id and both texts. A row that the
    worklist lacks counts as preserved.
    """
    work = worklist.select("dpi", "sample_id", (X.preservation_key("original_text") == X.preservation_key("patched_text")).alias("same"))
    rows = scores.join(work, ["dpi", "sample_id"], "left").withColumn("text_preserved", F.coalesce("same", F.lit(True)).cast("int")).drop("same")
    score = patch_quality(*[F.col(c) for c in ("target_icons", "strict_hits", "wrong_icons", "missed_targets", "false_positives")], F.col("text_preserved") == 1)
    return rows.withColumn("quality_score", score)


def preservation_rollup(scored: DataFrame) -> DataFrame:
    """Rows, how many did not keep their text, and the mean score."""
    return scored.agg(F.count("*").alias("n_rows"), F.count_if(F.col("text_preserved") == 0).alias("n_not_preserved"), F.round(F.coalesce(F.avg("quality_score"), F.lit(0.0)), 6).alias("mean_score"))
