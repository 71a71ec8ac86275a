"""Tags, points and their storage: joins of sidecars, replace by source, page payloads, schema checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import uuid5


def tag(chunks: DataFrame, tags: DataFrame, *, on: str, strict: bool = False) -> DataFrame:
    """Chunks with the tags of their source; tags win over columns of the same name, with nulls too."""
    names = [c for c in tags.columns if c != on]
    base = chunks.drop(*names)
    hit = tags.withColumn("tagged", F.lit(True))
    out = base.join(hit, on, "left").withColumn("tagged", F.coalesce("tagged", F.lit(False)))
    if strict:
        out = out.withColumn("tagged", F.when(F.col("tagged"), True).otherwise(F.raise_error(F.concat(F.lit("no tags for "), F.coalesce(F.col(on).cast("string"), F.lit("null"))))))
    return out


def tag_stats(tagged: DataFrame) -> DataFrame:
    """How many chunks and sources have tags."""
    return tagged.agg(F.count("*").alias("n_chunks"), F.count_if("tagged").alias("n_tagged"))


def text_point_id(source: Column, page: Column, chunk: Column) -> Column:
    """The UUID of a text point."""
    return uuid5(F.concat_ws("::", source, page.cast("string"), chunk))


def visual_point_id(source: Column, page: Column) -> Column:
    return uuid5(F.concat(source, F.lit("::__visual_page__:"), page.cast("string")))


def replace_by_source(store: DataFrame, new: DataFrame, *, source: str, kind: str | None = None) -> DataFrame:
    """The store without points of the new sources (of the same kind), and the new points."""
    keys = [source] + ([kind] if kind else [])
    return store.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upsert(store: DataFrame, new: DataFrame, *, key: str, order: str) -> DataFrame:
    """The last row of each id."""
    rows = store.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("__new"), F.desc(order))
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__new")


def page_payloads(chunks: DataFrame, *, source: str) -> DataFrame:
    """One row for each page with the first chunk's section and the ids of all its chunks in order."""
    rows = chunks.select(source, "chunk_idx", "chunk_id", "section", F.explode("pages").alias("page_idx"))
    return rows.groupBy(source, "page_idx").agg(F.min_by("section", "chunk_idx").alias("section"), F.array_join(F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk_id")))["chunk_id"], "|").alias("chunk_ids_on_page"), F.count("*").alias("n_chunks"))


def batches(rows: DataFrame, *, key: str, size: int) -> DataFrame:
    """First and last of each batch of consecutive numbers from 1 (F8). rows has key and n."""
    starts = F.sequence(F.lit(1), F.col("n").cast("int"), F.lit(size))
    return rows.where("n > 0").select(key, F.posexplode(starts).alias("batch", "first"), "n").select(key, "batch", "first", F.least(F.col("first") + size - 1, F.col("n").cast("int")).alias("last"))


def inspect(store: DataFrame, vector: str) -> DataFrame:
    """Points and the sizes of their vectors."""
    return store.agg(F.count("*").alias("n_points"), F.min(F.size(vector)).alias("min_size"), F.max(F.size(vector)).alias("max_size"))


def validate_schema(store: DataFrame, required: dict[str, str]) -> None:
    """Raise once with all columns that are missing or of another type."""
    have = dict(store.dtypes)
    wrong = [f"{n}: {have.get(n, 'missing')} instead of {t}" for n, t in required.items() if have.get(n) != t]
    if wrong:
        raise ValueError("; ".join(wrong))


def pending(wanted: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """What is not done yet: the resume step of batch stages."""
    return wanted.join(done.select(*on).distinct(), on, "left_anti")
