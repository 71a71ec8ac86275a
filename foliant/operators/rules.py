"""Rules that infer metadata from names and contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cascade(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that is found."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


# How versions are written, the surest way first.
VERSION_PATTERNS = (
    r"(?i)(?:datasheet|data[_ -]?sheet)[_-]?(\d{8})",
    r"(?i)[_ -](\d{8})(?:\.pdf)?$",
    r"(?i)(?:^|[_ -])V(\d+(?:\.\d+){1,4})(?:[_ )\-.]|$)",
    r"(?i)version\s+(\d+(?:\.\d+){1,4})",
    r"(?i)\bV(\d+(?:\.\d+){1,4})\b",
)


def version(name: Column, content: Column, current: Column | None = None) -> Column:
    """By each pattern in turn the name's version, else the content's; else what is known, without a V (O3)."""
    found = [F.nullif(F.regexp_extract(F.coalesce(t, F.lit("")), p, 1), F.lit("")) for p in VERSION_PATTERNS for t in (name, content)]
    return F.coalesce(*found, *([F.nullif(F.regexp_replace(current, "^[Vv]", ""), F.lit(""))] if current is not None else []))


def models(text: Column, pattern: str, most: int = 12) -> Column:
    """Distinct upper-case matches, the first ones."""
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda m: F.upper(m))), F.lit(1), F.lit(most))


# What tells a document's language, in this order; else what is known of it, else English.
LANGUAGE_RULES = (
    ("ko", r"[\x{ac00}-\x{d7af}]"),
    ("ar", r"[\x{0600}-\x{06ff}]|(?i:\barabic\b)"),
    ("fr", r"(?i)\b(?:francais|français|guide d'installation|manuel utilisateur)\b"),
    ("pl", r"(?i)\b(?:polish|polski|instrukcja|użytkownik)\b"),
    ("it", r"(?i)\b(?:italiano|installazione|manuale utente)\b"),
)
#: Characters of the content that are looked at.
LANGUAGE_CHARS = 3000


def language(name: Column, content: Column, current: Column | None = None) -> Column:
    """By script, then by words of one language, else what is known, else English."""
    text = F.concat(F.coalesce(name, F.lit("")), F.lit("\n"), F.left(F.coalesce(content, F.lit("")), F.lit(LANGUAGE_CHARS)))
    known = F.lit(None).cast("string") if current is None else F.nullif(F.btrim(current), F.lit(""))
    out = F.coalesce(known, F.lit("en"))
    for code, pattern in reversed(LANGUAGE_RULES):
        out = F.when(text.rlike(pattern), code).otherwise(out)
    return out


# Kinds of documents by words of path and name, then by words of the content's start.
NAME_RULES = (
    ("security_guide", ("security guide", "security baseline", "hardening guide")),
    ("selection_guide", ("selection guide", "selection manual")),
    ("quick_start_guide", ("quick start", "qsg")),
    ("installation_guide", ("installation", "installazione", "install method", "install guide")),
    ("operation_manual", ("operation manual", "operating manual", "operation guide", "configuration guide", "how to configure")),
    ("user_manual", ("user manual", "user s manual", "user guide")),
    ("datasheet", ("datasheet", "data sheet")),
)
CONTENT_RULES = (("security_guide", ("security recommendation", "security baseline", "hardening guide")),)
DOCUMENT_KINDS = tuple(k for k, _ in NAME_RULES) + ("other",)
CONTENT_CHARS = 900


def plain(text: Column) -> Column:
    """Lower case, with one blank for anything but letters and digits."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def document_type(path: Column, content: Column, current: Column | None = None) -> Column:
    """The kind of a document by its path, else its content, else what is known if it is a kind, else other (O2)."""
    name = plain(path)
    all_of = F.concat_ws(" ", name, plain(F.left(F.coalesce(content, F.lit("")), F.lit(CONTENT_CHARS))))
    known = F.lit("other") if current is None else F.when(current.isin(*DOCUMENT_KINDS), current).otherwise("other")
    out = known
    for text, rules in ((all_of, CONTENT_RULES), (name, NAME_RULES)):
        for kind, words in reversed(rules):
            found = F.lit(False)
            for w in words:
                found = found | F.contains(text, F.lit(w))
            out = F.when(found, kind).otherwise(out)
    return out


def families(text: Column, rules: list[tuple[str, str, str]], *, corrections: dict[str, str] | None = None) -> Column:
    """(families, subfamilies) of all rules (pattern, family, subfamily) that are found, each once, in order.

    corrections takes a family away where another one was found as well: {the one that goes: the one that stays}.
    The rules are the caller's, as they name one maker's products.
    """
    one = lambda i: F.array_distinct(F.array_compact(F.array(*[F.when(text.rlike(r[0]), F.lit(r[i] or None)) for r in rules])))
    own = one(1)
    for gone, kept in (corrections or {}).items():
        own = F.when(F.array_contains(own, kept), F.array_remove(own, gone)).otherwise(own)
    return F.struct(own.alias("families"), one(2).alias("subfamilies"))


def topics(text: Column, rules: dict[str, str], most: int = 14) -> Column:
    """Tags of the substrings that are found, in order of the rules."""
    return F.slice(F.array_compact(F.array(*[F.when(F.contains(text, F.lit(s)), F.lit(t)) for s, t in rules.items()])), F.lit(1), F.lit(most))


def target_path(family: Column, kind: Column, name: Column) -> Column:
    """family/kind/name."""
    return F.concat_ws("/", F.coalesce(family, F.lit("unsorted")), F.coalesce(kind, F.lit("other")), name)


def collisions(rows: DataFrame, key: str) -> DataFrame:
    """Keys that several rows have."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(rows: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Rows without a counterpart."""
    return rows.join(known.select(on), on, "left_anti")


def overlay(rows: DataFrame, decisions: DataFrame, *, on: str, columns: list[str]) -> DataFrame:
    """Rows with what was decided by hand in place of what was inferred."""
    d = decisions.select(on, *[F.col(c).alias(f"__{c}") for c in columns])
    return rows.join(d, on, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def move_plan(rows: DataFrame, outputs: DataFrame) -> DataFrame:
    """Where each document goes, which of its output folders goes with it and what stands in the way.

    rows has current_path, target_path and stem; outputs has stem and folder. Of several folders the
    shortest is taken, then the first.
    """
    folders = outputs.groupBy("stem").agg(F.min(F.struct(F.char_length("folder").alias("n"), F.col("folder").alias("folder")))["folder"].alias("folder"), F.count("*").alias("n_folders"))
    same = Window.partitionBy("target_path")
    out = rows.join(folders, "stem", "left").withColumn("n_same_target", F.count("*").over(same))
    problem = F.when(F.col("n_same_target") > 1, "target_collision").when(F.col("n_folders").isNull(), "missing_output").when(F.col("n_folders") > 1, "multiple_output").otherwise("")
    return out.select("current_path", "target_path", "folder", (F.col("current_path") != F.col("target_path")).alias("moves"), problem.alias("problem"))


def layout_summary(plans: DataFrame, *, by: tuple[str, str] = ("family", "kind")) -> DataFrame:
    """How many documents each family and kind has, and how many move."""
    return plans.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("moves").alias("n_moves"))


def content_digest(blocks: DataFrame, kind: Column, *, key: str, most: int = 2) -> DataFrame:
    """The first texts of each kind of block of a document, in order (O1). blocks has key, block_idx and text."""
    w = Window.partitionBy(key, "kind").orderBy("block_idx")
    rows = blocks.withColumn("kind", kind).withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    return rows.groupBy(key, "kind").agg(F.array_join(F.array_sort(F.collect_list(F.struct("block_idx", "text")))["text"], " / ").alias("digest"))


def review_packets(documents: DataFrame, sidecars: DataFrame, evidence: DataFrame) -> DataFrame:
    """One packet for each document: its sidecar's text, if there is one, and its evidence.

    All have relpath; sidecars has text, evidence has place and snippet.
    """
    found = evidence.groupBy("relpath").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "snippet"))), lambda e: e["snippet"]).alias("evidence"))
    rows = documents.join(sidecars.withColumnRenamed("text", "sidecar"), "relpath", "left").join(found, "relpath", "left")
    return rows.select("relpath", F.substring_index("relpath", "/", -1).alias("filename"), F.col("sidecar").isNotNull().alias("has_sidecar"), F.coalesce("sidecar", F.lit("")).alias("sidecar"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))


def packet_counts(packets: DataFrame) -> DataFrame:
    """Packets, and those without a sidecar or evidence."""
    return packets.agg(F.count("*").alias("n_packets"), F.count_if(~F.col("has_sidecar")).alias("n_without_sidecar"), F.count_if(F.size("evidence") == 0).alias("n_without_evidence"))
