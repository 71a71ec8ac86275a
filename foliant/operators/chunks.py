"""Chunks: section islands, greedy packing under a token budget, overlap, roll-up and statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .blocks import fold_groups

MODES = ("auto", "section", "token")


@dataclass(frozen=True)
class Profile:
    mode: str = "auto"
    max_tokens: int = 1500
    overlap_tokens: int = 150
    min_tokens: int = 150

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if self.max_tokens <= 0 or self.overlap_tokens < 0:
            raise ValueError("max_tokens must be positive and overlap_tokens not negative")

    @property
    def overlap(self) -> int:
        return min(self.overlap_tokens, max(0, self.max_tokens - 1))


def item_cost(text: Column | str) -> Column:
    return F.greatest(F.lit(1).cast("long"), X.token_estimate(text))


def resolve_mode(items: DataFrame, *, key: str, mode: str = "auto") -> DataFrame:
    """auto becomes section where any item has a section path, else token; section without paths is token."""
    any_path = F.max(F.coalesce(F.col("section_path") != "", F.lit(False)))
    return items.groupBy(key).agg(F.when(any_path & F.lit(mode != "token"), "section").otherwise("token").alias("mode"))


def section_islands(items: DataFrame, *, key: str, order: str, path: str = "section_path") -> DataFrame:
    """Items with the number of their run of one section path.

    An item without a path takes the one before it; leading items without one join the first section.
    """
    w = Window.partitionBy(key).orderBy(order)
    own = F.nullif(F.col(path), F.lit(""))
    rest = Window.partitionBy(key).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    effective = F.coalesce(F.last(own, True).over(w), F.first(own, True).over(rest))
    out = items.withColumn("effective_path", effective)
    new = F.coalesce(F.col("effective_path") != F.lag("effective_path").over(w), F.lit(False))
    return out.withColumn("island", F.sum(new.cast("int")).over(w))


def greedy_numbers(costs: list[int], max_tokens: int, min_tokens: int) -> list[int]:
    """The chunk of each item: a new one where the next item would overfill one that is full enough."""
    used, chunk, out = 0, 0, []
    for c in costs:
        if used > 0 and used + c > max_tokens and used >= min_tokens:
            used, chunk = 0, chunk + 1
        used += c
        out.append(chunk)
    return out


def greedy_chunks(items: DataFrame, *, keys: tuple[str, ...], order: str, cost: str, max_tokens: int, min_tokens: int = 0) -> DataFrame:
    """Items with chunk_idx: a new chunk where the next item would overfill one that is full enough.

    The costs of a group are folded in order, many groups in one Arrow batch; texts stay out of it and the work is
    linear in the items.
    """
    group = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("long").alias("c")))).alias("items"))

    @F.pandas_udf("array<int>")
    def run(costs: pd.Series) -> pd.Series:
        return pd.Series([greedy_numbers(c.tolist(), max_tokens, min_tokens) for c in costs], dtype=object)

    numbered = group.withColumn("n", run(F.col("items.c"))).select(*keys, F.explode(F.zip_with("items", "n", lambda x, n: F.struct(x["o"].alias("o"), n.alias("chunk")))).alias("x"))
    return items.join(numbered.select(*keys, F.col("x.o").alias(order), F.col("x.chunk").alias("chunk_idx")), [*keys, order])


def fold_chunks(costs: list[int], texts: list[str], profile: Profile) -> list[list[tuple[int, str]]]:
    """Chunks as lists of (item, text), with whole items and one cut item of overlap in front."""

    def cost(t: str) -> int:
        return max(1, len(X.PYTHON_TOKEN.findall(t)))

    def tail(items: list[tuple[int, str]]) -> list[tuple[int, str]]:
        out, room = [], profile.overlap
        for i, t in reversed(items):
            if room <= 0:
                break
            if cost(t) <= room:
                out.append((i, t))
                room -= cost(t)
                continue
            if part := X.tail_of(t, room):
                out.append((i, part))
            break
        return out[::-1]

    chunks, current, used = [], [], 0
    for i, (c, t) in enumerate(zip(costs, texts, strict=True)):
        if current and used + c > profile.max_tokens and used >= profile.min_tokens:
            chunks.append(current)
            current = tail(current)
            used = sum(cost(x) for _, x in current)
        current = [*current, (i, t)]
        used += c
    return [*chunks, current] if current else chunks


def overlapping_chunks(items: DataFrame, *, key: str, order: str, profile: Profile) -> DataFrame:
    """(key, chunk_idx, first_item, last_item, n_items, content) with overlap."""

    def fold(places: list[int], texts: list[str]) -> Iterator[tuple]:
        costs = [max(1, len(X.PYTHON_TOKEN.findall(t))) for t in texts]
        for n, c in enumerate(fold_chunks(costs, texts, profile)):
            yield n, places[c[0][0]], places[c[-1][0]], len(c), "\n".join(t for _, t in c)

    rows = items.select(key, order, F.coalesce("text", F.lit("")).alias("text"))
    return fold_groups(rows, key, [order, "text"], fold, "chunk_idx int, first_item int, last_item int, n_items int, content string")


def roll_up(items: DataFrame, *, key: str, order: str) -> DataFrame:
    """One row for each chunk: id, span of pages, items and content in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("page_idx").alias("p"), F.col("text").alias("t"))))
    out = items.groupBy(key, "chunk_idx").agg(ordered.alias("x"), F.sum("tokens").alias("token_count"))
    return out.select(
        key, "chunk_idx", F.format_string(f"{key}-%s-chunk-%05d", F.col(key).cast("string"), "chunk_idx").alias("chunk_id"), "token_count",
        F.array_min("x.p").alias("page_start"), F.array_max("x.p").alias("page_end"), F.array_join(F.array_distinct("x.o"), "|").alias("block_indices"), F.array_join("x.t", "\n").alias("content"),
    )


def profile_stats(chunks: DataFrame, max_tokens: int) -> DataFrame:
    """Number, total, mean and largest of chunks and how many are over the budget."""
    return chunks.agg(F.count("*").alias("n_chunks"), F.sum("token_count").alias("total_tokens"), F.round(F.avg("token_count"), 2).alias("mean_tokens"), F.max("token_count").alias("max_tokens"), F.count_if(F.col("token_count") > max_tokens).alias("n_over"))
