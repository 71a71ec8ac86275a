"""Readers and writers: documents, JSON arrays and lines, CSV, manifests, sidecars, tables and points."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that queries write and read again, in the folder that all machines share.

    That is spark.checkpoint.dir; only a session on one machine may do without it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/foliant-files/{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}-{name}"


def list_documents(spark: SparkSession, root: str, suffix: str = "pdf") -> DataFrame:
    """(path, length) of all files of a kind below root, any case, in order of the lower-case path (A1).

    Contents are not read; an empty result is an error of the action that uses it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*").load(root).select("path", "length")
    return files.where(F.lower("path").endswith("." + suffix)).orderBy(F.lower("path"), "path")


def choose_artifact(files: DataFrame, sources: DataFrame) -> DataFrame:
    """For each source its content file: named after it, or in a folder of its name; least depth, first path (A2).

    files has path; sources have stem. Files of later steps (captions, small icons) are left out.
    """
    name = F.substring_index("path", "/", -1)
    found = files.where(name.endswith("content_list.json") & ~name.contains("small-icon") & ~name.contains("caption"))
    parts = F.split("path", "/")
    named = found.where(name.endswith("_content_list.json")).select("path", F.regexp_replace(name, "_content_list.json$", "").alias("stem"), F.lit(0).alias("score"))
    inside = found.where(name == "content_list.json").select("path", F.explode(F.array_distinct(parts)).alias("stem"), F.lit(1).alias("score"))
    rows = named.unionByName(inside).join(sources.select("stem"), "stem").withColumn("depth", F.size(F.split("path", "/")))
    w = Window.partitionBy("stem").orderBy("score", "depth", "path")
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").select("stem", "path")


STAGES = ("sectioned", "patched", "captioned", "chunked", "tagged")


def stage_path(path: Column, stage: str) -> Column:
    """The path of a stage's output: the stem with the stage's suffix in place of any other (A3)."""
    if stage not in STAGES:
        raise ValueError(f"stage must be one of {STAGES}")
    stem = F.regexp_replace(path, r"(?:_(?:" + "|".join(STAGES) + r"))?\.json$", "")
    return F.concat(stem, F.lit(f"_{stage}.json"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The elements of arrays of objects, one file each, with file and position (A4)."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"array<struct<{schema}>>", {"mode": "FAILFAST"}).alias("x"))
    return rows.select("file", F.posexplode("x").alias("idx", "x")).select("file", "idx", "x.*")


def read_outlines(spark: SparkSession, path: str) -> DataFrame:
    """(source, outline_index, level, title, page) of exported outlines: arrays of objects, a file for each document.

    Documents themselves are not opened here; outline_paths() stacks the titles.
    """
    rows = read_json_array(spark, path, "level int, title string, page int")
    return rows.select(F.substring_index("file", "/", -1).alias("source"), F.col("idx").cast("bigint").alias("outline_index"), "level", "title", "page").where("level > 0 AND trim(title) <> ''")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects by line; blank lines and lines that start with # are left out, bad ones raise (A5)."""
    lines = spark.read.text(path).where(~F.btrim("value").startswith("#") & (F.btrim("value") != ""))
    return lines.select(F.from_json("value", f"struct<{schema}>", {"mode": "FAILFAST"}).alias("x")).select("x.*")


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as text."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*columns) if columns else df


def parse_sidecar(text: str) -> dict[str, object]:
    """A restricted YAML: 'key: value', lists by dashes or in brackets, quotes, null, true, false, integers, comments."""

    def scalar(raw: str):
        raw = raw.strip()
        if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "'\"":
            return raw[1:-1]
        raw = re.sub(r"\s+#.*$", "", raw)
        if raw in ("", "null", "~"):
            return None
        if raw in ("true", "false"):
            return raw == "true"
        if raw.startswith("[") and raw.endswith("]"):
            return [scalar(x) for x in raw[1:-1].split(",") if x.strip()]
        return int(raw) if re.fullmatch(r"-?\d+", raw) else raw

    out: dict[str, object] = {}
    key = None
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if m := re.match(r"\s*-\s+(.*)$", line):
            if key is not None:
                if not isinstance(out[key], list):
                    out[key] = []
                out[key].append(scalar(m[1]))
        elif m := re.match(r"\s*([A-Za-z_][\w-]*)\s*:(.*)$", line):
            key = m[1]
            out[key] = scalar(m[2])
    return out


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value) of all sidecars below a path; lists are joined by '|' (A7)."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = [(f, k, "|".join(map(str, v)) if isinstance(v, list) else None if v is None else str(v)) for f, text in zip(pdf["file"], pdf["value"], strict=True) for k, v in parse_sidecar(text).items()]
            yield pd.DataFrame(rows, columns=["file", "key", "value"])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.mapInPandas(run, "file string, key string, value string")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Relative paths, one a line, without blanks and comments."""
    line = F.btrim(F.regexp_replace("value", r"\s*#.*$", ""))
    return spark.read.text(path).select(line.alias("relpath")).where("relpath <> ''")


def scroll(spark: SparkSession, path: str, columns: list[str], predicate: str = "true") -> DataFrame:
    """A filtered read of points; the filter and the columns reach the scan (A10)."""
    return spark.read.parquet(path).where(predicate).select(*columns)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Objects by line with their keys in order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def combine(frames: list[DataFrame]) -> DataFrame:
    """All rows of several tables with the union of their columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """With a header: the given columns, others left out, or all in order; lists are joined by '|' (A14)."""
    kinds = dict(df.dtypes)
    flat = [F.array_join(c, "|").alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns or sorted(df.columns)]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", "\"").csv(path)


def markdown(df: DataFrame, columns: list[str], *, order: list[str] | None = None) -> DataFrame:
    """(line) of a table in Markdown: two head lines and one for each row, in the order given, else as they come."""
    head = df.sparkSession.createDataFrame([(0, f"| {' | '.join(columns)} |"), (1, "|" + " --- |" * len(columns))], "n int, line string")
    place = F.struct(*order) if order else F.monotonically_increasing_id()
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit(r"\|")), F.lit("")) for c in columns]
    rows = df.select(F.lit(2).alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"), place.alias("place"))
    return head.unionByName(rows, allowMissingColumns=True).orderBy("n", "place").select("line")


def upsert_points(spark: SparkSession, path: str, new: DataFrame, *, source: str = "source") -> None:
    """Replace the points of the new sources in a table partitioned by source; other partitions stay.

    Only partitions of the new sources are written, so the work follows the new points. Rows are gathered by
    source, and AQE deals out a source that is too large for one task.
    """
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        new.hint("rebalance", source).write.mode("overwrite").partitionBy(source).parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def directory_size(spark: SparkSession, path: str) -> DataFrame:
    """Bytes of all files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))
