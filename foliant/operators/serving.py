"""The edges of the engine: encoders, collections, services and the runs that use them."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X
from . import retrieval as R

#: Texts that an encoder gets at once.
ENCODE_BATCH = 64


def unit_encoder(size: int) -> Callable[[list[str]], np.ndarray]:
    """The encoder of a route that is off: the first unit vector for every text (F1)."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        out[:, 0] = 1
        return out

    return encode


def hashing_encoder(size: int) -> Callable[[list[str]], np.ndarray]:
    """Words counted in hashed places: an encoder without a model, for tests and first runs."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                out[i, zlib.crc32(word.encode()) % size] += 1
        return out

    return encode


def fit_vectors(raw: np.ndarray, size: int) -> np.ndarray:
    """Vectors cut to a size and of length one; zero vectors stay zero, shorter ones are an error (F1)."""
    raw = np.asarray(raw, np.float32)
    if raw.ndim != 2 or raw.shape[1] < size:
        raise ValueError(f"the encoder gives {raw.shape} where {size} components are needed")
    raw = raw[:, :size]
    norm = np.linalg.norm(raw, axis=1, keepdims=True)
    return raw / np.where(norm > 0, norm, 1)


def embed(rows: DataFrame, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]], *, size: int, text_col: str = "text", prefix: str = "", batch: int = ENCODE_BATCH) -> DataFrame:
    """rows with the column embedding (array<float>), by an encoder that each task makes once (F1).

    make_encoder is called where the rows are, so a model is loaded there and never sent; prefix stands
    before each text (queries have another than documents). A null text is empty.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_encoder()
        for texts in batches:
            texts = [prefix + (t or "") for t in texts]
            out = [fit_vectors(encode(texts[i : i + batch]), size) for i in range(0, len(texts), batch)]
            yield pd.Series([v for part in out for v in part], dtype=object)

    return rows.withColumn("embedding", run(F.col(text_col)))


# --- collections ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Collection:
    """What a table of points holds (F3): vectors by name and size, multivectors, sparse weights, payload columns."""

    name: str
    dense: dict[str, int] = field(default_factory=dict)
    multi: dict[str, int] = field(default_factory=dict)
    sparse: tuple[str, ...] = ()
    payload: dict[str, str] = field(default_factory=dict)
    partition: str = "source"

    def schema(self) -> str:
        columns = {"id": "string", **self.payload, **dict.fromkeys(self.dense, "array<float>"), **dict.fromkeys(self.multi, "array<array<float>>"), **dict.fromkeys(self.sparse, "map<string,float>")}
        if self.partition not in columns:
            columns[self.partition] = "string"
        return ", ".join(f"{n} {t}" for n, t in columns.items())


class Store:
    """Collections as tables in a folder, one partition for each source (A19): a path takes a server's place."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def ensure(self, collection: Collection) -> None:
        """Make the collection unless it is there; one of another shape is an error."""
        empty = self.spark.createDataFrame([], collection.schema())
        there = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(collection.name))
        fs = there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(there):
            empty.write.parquet(self.path(collection.name))
            return
        have = dict(self.read(collection).dtypes)
        wrong = [f"{n}: {have.get(n, 'missing')} instead of {t}" for n, t in empty.dtypes if have.get(n) != t]
        if wrong:
            raise ValueError("; ".join(wrong))

    def read(self, collection: Collection) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(self.path(collection.name))

    def upsert(self, collection: Collection, points: DataFrame) -> None:
        """Replace the points of the sources that come."""
        from ..sources.files import upsert_points

        upsert_points(self.spark, self.path(collection.name), points, source=collection.partition)


def collection_columns(spark: SparkSession, collection: Collection) -> DataFrame:
    """(place, name, type) of a collection's columns."""
    rows = [(i, *c.split(" ", 1)) for i, c in enumerate(collection.schema().split(", "))]
    return spark.createDataFrame(rows, "place int, name string, type string")


# --- services ----------------------------------------------------------------------------------------------


def call_with_retries(send: Callable[[dict], dict], request: dict, *, tries: int = 3, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> tuple[dict, float]:
    """The answer of a service and the seconds it took; each further try waits longer by pause.

    send is given: a client of a retriever or a model. The last error is raised.
    """
    for n in range(1, tries + 1):
        began = time.perf_counter()
        try:
            return send(request), time.perf_counter() - began
        except Exception:
            if n == tries:
                raise
            sleep(pause * n)
    raise ValueError("tries must be positive")


def call_service(rows: DataFrame, make_send: Callable[[], Callable[[dict], dict]], *, request: str = "request", tries: int = 3, pause: float = 1.0) -> DataFrame:
    """rows with response (JSON), error and latency of a call for each request (JSON).

    A request that fails every time has its error in place of a response and stops no other row.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("response", T.StringType()), T.StructField("error", T.StringType()), T.StructField("latency", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = make_send()
        for pdf in batches:
            out = []
            for text in pdf[request]:
                try:
                    answer, seconds = call_with_retries(send, json.loads(text), tries=tries, pause=pause)
                    out.append((json.dumps(answer, ensure_ascii=False, sort_keys=True), None, seconds))
                except Exception as error:  # what the row reports
                    out.append((None, f"{type(error).__name__}: {error}", None))
            yield pdf.assign(**{c: pd.Series([o[i] for o in out], index=pdf.index, dtype=object if i < 2 else float) for i, c in enumerate(("response", "error", "latency"))})

    return rows.mapInPandas(run, schema)


def with_fallback(result: Column, error: Column, fallback: Column, *, pattern: str = "context|length|token") -> tuple[Column, Column]:
    """(value, fell_back): what a stage made, or its input where it ran over a model's context (Q3). Other errors raise."""
    over = error.isNotNull() & F.lower(error).rlike(pattern)
    value = F.when(error.isNull(), result).when(over, fallback).otherwise(F.raise_error(F.coalesce(error, F.lit("no result"))))
    return value, F.coalesce(over, F.lit(False))


def model_span(stages: tuple[str, ...], needs: dict[str, str], done: set[str] = frozenset()) -> dict[str, tuple[str, str]]:
    """For each model the first and last stage that runs and needs it: between them its server has to be up (Q4)."""
    out: dict[str, tuple[str, str]] = {}
    for stage in stages:
        if stage in needs and stage not in done:
            first, _ = out.get(needs[stage], (stage, stage))
            out[needs[stage]] = (first, stage)
    return out


def messages(system: str, *parts: Column) -> Column:
    """The messages of a model call: what it is to do, then the parts of the user's message."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), "\n\n")))


# --- payloads ----------------------------------------------------------------------------------------------


def payload_boxes(json_text: Column) -> Column:
    """Valid boxes by page of a payload's JSON object; pages that are no number and boxes without an area go."""
    pages = F.from_json(json_text, "map<string,string>")

    def boxes(text: Column) -> Column:
        return F.filter(F.transform(F.from_json(text, "array<array<double>>"), lambda v: F.when((F.size(v) == 4) & (v[2] > v[0]) & (v[3] > v[1]), v)), lambda v: v.isNotNull())

    entries = F.transform(F.map_entries(pages), lambda e: F.struct(e["key"].try_cast("int").alias("page_idx"), boxes(e["value"]).alias("boxes")))
    return F.array_sort(F.filter(entries, lambda e: e["page_idx"].isNotNull() & (F.size(e["boxes"]) > 0)))


def chunk_key(source: Column, chunk_id: Column, record_id: Column, chunk_idx: Column) -> Column:
    """What a candidate is known by: its source and chunk id, else its record, else its place."""
    some = lambda c: F.nullif(F.coalesce(c.cast("string"), F.lit("")), F.lit(""))
    return F.concat_ws("|", F.coalesce(source, F.lit("")), F.coalesce(some(chunk_id), some(record_id), F.concat(F.lit("chunk_idx:"), chunk_idx.cast("string"))))


def visual_pages(points: DataFrame) -> DataFrame:
    """Points that are whole pages."""
    return points.where(F.coalesce("is_visual_page", F.lit(False)))


def naive_alignment(is_visual: Column, page: Column, chunk_pages: Column) -> Column:
    """One where a chunk lies on the page that was hit."""
    return F.when(F.coalesce(is_visual, F.lit(False)) & F.array_contains(chunk_pages, page), 1.0).otherwise(0.0)


def sort_candidates(rows: DataFrame, *, score: str = "score") -> DataFrame:
    """Candidates of each query numbered by score, page, top, left, chunk number and id.

    rows has preferred_page (or null), pages and boxes: an array of (page_idx, x0, y0). The place of a chunk is
    its first box on the preferred page, else on its first page; without one it comes after all others.
    """
    page = F.coalesce("preferred_page", F.array_min("pages"))
    own = F.filter("boxes", lambda b: b["page_idx"] == page)
    place = F.array_min(F.transform(own, lambda b: F.struct(b["y0"].alias("y0"), b["x0"].alias("x0"))))
    far = F.lit(float("inf"))
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "page", "top", "left", "chunk_idx", "chunk_id")
    rows = rows.withColumns({"page": page, "top": F.coalesce(place["y0"], far), "left": F.coalesce(place["x0"], far)})
    return rows.withColumn("position", F.row_number().over(w)).drop("page", "top", "left")


# --- runs --------------------------------------------------------------------------------------------------


def gold_flags(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, n_hits, chunk_hit, page_hit, pages): whether a query's hits hold a gold chunk or page (K3).

    hits has query_id, chunk_id and pages (array); gold has query_id, chunk_ids and pages (arrays).
    """
    found = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.collect_set("chunk_id").alias("chunks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("hit_pages"))
    rows = gold.join(found, "query_id", "left")
    meets = lambda a, b: F.coalesce(F.arrays_overlap(a, b), F.lit(False))
    return rows.select("query_id", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), meets("chunks", "chunk_ids").alias("chunk_hit"), meets("hit_pages", F.col("pages")).alias("page_hit"), F.coalesce("hit_pages", F.array().cast("array<int>")).alias("pages"))


def retrieval_run(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], gold: DataFrame, *, run_id: str, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row for each query of a benchmark run: ranking metrics and the ids of its hits in order.

    retrieve answers all queries by one plan: (query_id, rank from 1, id).
    """
    from .evaluation import ranking_metrics

    hits = retrieve(queries).select("query_id", "rank", "id")
    ranked = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda h: h["id"].cast("string")), "|").alias("hits"))
    rows = ranking_metrics(hits, gold, queries, ks).join(ranked, "query_id", "left")
    return rows.select(F.lit(run_id).alias("run_id"), *[c for c in rows.columns if c != "hits"], F.coalesce("hits", F.lit("")).alias("hits"))


def answering_run(contexts: DataFrame, answers: DataFrame | None, *, run_id: str, context_cap: int = 0, chars_per_token: float = 4.0) -> DataFrame:
    """One row for each query: its context, cut at the cap, and what a model answered to it, if one was asked (K1).

    contexts has query_id, context and n_hits; answers has query_id, answer, usage (JSON) and latency.
    """
    context = F.left("context", F.lit(int(context_cap * chars_per_token))) if context_cap > 0 else F.col("context")
    rows = contexts.select("query_id", "n_hits", context.alias("context"))
    rows = rows.withColumn("context_tokens", X.context_tokens("context", chars_per_token))
    if answers is None:
        made = {"answer": "string", "total_tokens": "int", "latency": "double"}
        return rows.select(F.lit(run_id).alias("run_id"), *rows.columns, *[F.lit(None).cast(t).alias(n) for n, t in made.items()], F.lit("skipped").alias("status"))
    said = answers.select("query_id", X.strip_reasoning("answer").alias("answer"), X.usage_count("usage", "total_tokens").alias("total_tokens"), "latency")
    rows = rows.join(said, "query_id", "left")
    status = F.when(F.col("answer").isNull(), "no_answer").when(F.btrim("answer") == "", "empty").otherwise("ok")
    return rows.select(F.lit(run_id).alias("run_id"), *rows.columns, status.alias("status"))


def baseline_run(answers: DataFrame, *, run_id: str, like: DataFrame) -> DataFrame:
    """Answers that came another way, in the columns of an answering run; what they lack is null (K6)."""
    own = answers.withColumn("run_id", F.lit(run_id))
    return like.limit(0).unionByName(own.select(*[c for c in own.columns if c in like.columns]), allowMissingColumns=True)


def discover_runs(runs: DataFrame, patterns: list[str], *, score: str = "mean_score") -> DataFrame:
    """Runs whose id starts with one of the patterns, best first, those without a score last."""
    chosen = F.lit(False)
    for p in patterns:
        chosen = chosen | F.col("run_id").startswith(p.removesuffix("*"))
    return runs.where(chosen if patterns else F.lit(True)).orderBy(F.desc_nulls_last(score), "run_id")


def encoded_topk(vectors: DataFrame, queries: DataFrame, make_encoder, *, size: int, k: int, prefix: str = "") -> DataFrame:
    """The k nearest points of each query's text (F1, G1)."""
    return R.dense_topk(vectors, embed(queries, make_encoder, size=size, text_col="query", prefix=prefix), k)
