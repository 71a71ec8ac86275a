"""Line dedup: drop lines that many documents share. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

_SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at either end, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _UPPER.lower())


def _hash(key: Column) -> list[Column]:
    """128 bits: two XXH64 of which the second starts from another state."""
    return [F.xxhash64(key).alias("__h1"), F.xxhash64(F.lit(1), key).alias("__h2")]


def drop_shared_lines(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with kept_text, n_lines and n_dropped; text itself is left as it is.

    Lines are split at \\n; the key of a line is line_key(line). A key of at least min_chars code
    points that at least min_docs documents hold loses all its lines everywhere. Each row is one
    document, so a repeated row counts again; a null or empty text is one empty line, which has an
    empty key and stays; null ids are documents too. Other columns pass through unchanged.

    Two passes over the text make (row key, position, hash) only; counting is partial before its
    shuffle and the text moves once, for reassembly. Hot lines make hot hashes on one side of a
    sort-merge join, which AQE splits, as the other side, one row for each frequent hash, is a table
    of its own in the shared folder.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    row = [F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__t1"), F.xxhash64(F.lit(1), F.col(text_col)).alias("__t2")]
    keys = docs.select(F.explode(F.array_distinct(F.transform(lines, line_key))).alias("__key"))
    frequent = keys.where(F.char_length("__key") >= min_chars).select(*_hash(F.col("__key"))).groupBy("__h1", "__h2").agg(F.count("*").alias("__n")).where(F.col("__n") >= min_docs).select("__h1", "__h2")
    frequent = materialize(frequent, "frequent-lines")
    placed = docs.select(*row, F.posexplode(F.transform(lines, line_key)).alias("__pos", "__key"))
    placed = placed.where(F.char_length("__key") >= min_chars).select("__id", "__t1", "__t2", "__pos", *_hash(F.col("__key")))
    dropped = placed.join(frequent, ["__h1", "__h2"]).groupBy("__id", "__t1", "__t2").agg(F.collect_set("__pos").alias("__gone"))
    left = docs.withColumns({"__l1": F.xxhash64(text_col), "__l2": F.xxhash64(F.lit(1), F.col(text_col))})
    match = left[id_col].eqNullSafe(dropped["__id"]) & (left["__l1"] == dropped["__t1"]) & (left["__l2"] == dropped["__t2"])
    joined = left.join(dropped, match, "left").withColumn("__lines", lines)
    kept = F.when(F.col("__gone").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone")), lambda i: F.get("__lines", i)), "\n")
    )
    out = {"kept_text": kept, "n_lines": F.size("__lines").cast("long"), "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")}
    return joined.select(*[left[c] for c in docs.columns if c not in out], *[c.alias(k) for k, c in out.items()])


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what stays, of each document."""
    out = drop_shared_lines(docs.select("doc_id", "text"), **options)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
