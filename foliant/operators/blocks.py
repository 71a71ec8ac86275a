"""Layout blocks: continuation groups, sections, page windows, icon links and context windows."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import text as X

PAGE_LINES = 5
Y_CLOSE, FUZZY_FLOOR, NEXT_PAGE_TOP = 50.0, 0.92, 180.0


def order_of(*keys: str, idx: str = "block_idx"):
    return Window.partitionBy(*keys).orderBy(idx)


def blocks_from_text(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One block for each line; pages of PAGE_LINES lines (A4)."""
    lines = docs.select(F.col(id_col), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("block_idx", "text"))
    return lines.withColumn("page_idx", F.floor(F.col("block_idx") / PAGE_LINES).cast("int"))


def continuation_map(tables: DataFrame, *, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """(keys, block_idx, master_idx) of table blocks that continue the last table with a body.

    tables has is_master (a body that is not blank), is_open (no body, caption, footnote or picture),
    page_idx and box. A block continues the master on its page below it, on a later page near the top.
    """
    w = order_of(*keys)
    last = F.last(F.when(F.col("is_master"), F.struct("block_idx", "page_idx", "box")), True).over(w).alias("m")
    found = tables.select(*keys, "block_idx", "page_idx", "box", "is_open", last).where("is_open AND m IS NOT NULL AND box IS NOT NULL AND m.box IS NOT NULL")
    fits = F.when(F.col("page_idx") < F.col("m.page_idx"), False).when(F.col("page_idx") == F.col("m.page_idx"), F.col("box.y0") >= F.col("m.box.y1")).otherwise(F.col("box.y0") <= NEXT_PAGE_TOP)
    return found.where(fits).select(*keys, "block_idx", F.col("m.block_idx").alias("master_idx"))


def continuation_regions(pairs: DataFrame, *, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """Members of each master in order, as one row."""
    return pairs.groupBy(*keys, "master_idx").agg(F.array_sort(F.collect_list("block_idx")).alias("members"))


def stacked_paths(levels: list[int], titles: list[str]) -> list[str]:
    """Of each entry the first level - 1 titles of the path before, then its own (T4)."""
    path, out = [], []
    for level, title in zip(levels, titles, strict=True):
        path = [*path[: max(0, level - 1)], title]
        out.append(" > ".join("" if t is None else t for t in path))
    return out


#: Groups whose items a worker has as Python objects at once, and characters or rows that it returns at once.
GROUPS_AT_ONCE, CHARS_AT_ONCE, ROWS_AT_ONCE = 64, 1 << 22, 1 << 16


def fold_groups(items: DataFrame, key: str, columns: list[str], fold: Callable[..., Iterator[tuple]], made: str) -> DataFrame:
    """(key, made) of each group: fold gets its columns as lists, in order of the first, and yields rows.

    Many groups come in one Arrow batch, but few at once become Python objects, and rows leave by bounded size.
    """
    group = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in columns])
    out = f"`{key}` {items.schema[key].dataType.simpleString()}, {made}"
    schema = to_arrow_schema(_parse_datatype_string(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            for lo in range(0, batch.num_rows, GROUPS_AT_ONCE):
                for k, *lists in zip(*(c.to_pylist() for c in batch.slice(lo, GROUPS_AT_ONCE).columns), strict=True):
                    for r in fold(*lists):
                        rows.append((k, *r))
                        chars += sum(len(x) for x in r if isinstance(x, str))
                        if chars >= CHARS_AT_ONCE or len(rows) >= ROWS_AT_ONCE:
                            yield batch_of(rows)
                            rows, chars = [], 0
        if rows:
            yield batch_of(rows)

    return group.mapInArrow(run, out)


def outline_paths(outline: DataFrame, *, key: str = "source") -> DataFrame:
    """The path of titles of each outline entry.

    The entries of a document are folded in order, many documents in one Arrow batch: the work is linear in them.
    """
    entries = outline.select(key, F.col("outline_index").cast("bigint").alias("outline_index"), F.col("level").cast("int").alias("level"), "title")

    def fold(index: list[int], levels: list[int], titles: list[str]) -> Iterator[tuple]:
        return zip(index, levels, titles, stacked_paths(levels, titles), strict=True)

    return fold_groups(entries, key, ["outline_index", "level", "title"], fold, "outline_index bigint, level int, title string, section_path string")


def match_outline(outline: DataFrame, blocks: DataFrame, *, keys: tuple[str, ...] = ("source", "page_idx"), fuzzy: bool = True) -> DataFrame:
    """The heading of each outline entry on its page: equal, equal when normalized, alike, or the page's block.

    outline has outline_index, title and dest_y (null if unknown); blocks have block_idx, type, text and y0.
    Of the best tier the block nearest to dest_y is taken, then the first.
    """
    o = outline.select(*keys, "outline_index", "title", "dest_y")
    b = blocks.where(~F.col("type").isin("header", "footer", "page_number")).select(*keys, "block_idx", "type", F.col("text").alias("heading"), "y0")
    pairs = o.join(b, list(keys), "left")
    trim = lambda c: F.btrim(F.regexp_replace(c, "[ \t\r\n]+", " "))
    is_text = (F.col("type") == "text") & (F.btrim("heading") != "")
    alike = X.fuzzy_ratio("title", "heading") >= FUZZY_FLOOR if fuzzy else F.lit(False)
    tier = F.when(is_text & (trim(F.col("heading")) == trim(F.col("title"))), 1).when(is_text & (X.normalized_title("heading") == X.normalized_title("title")), 2).when(is_text & alike, 3).when(F.col("block_idx").isNotNull(), 4).otherwise(5)
    away = F.abs(F.col("y0") - F.col("dest_y"))
    # The page's block: nearest at or below the place, else nearest of all, else the first.
    below = F.when((F.col("tier") == 4) & F.col("dest_y").isNotNull(), (F.col("y0") < F.col("dest_y")).cast("int")).otherwise(0)
    ranked = pairs.withColumn("tier", tier).withColumn("away", away)
    best = Window.partitionBy(*keys, "outline_index").orderBy("tier", below, F.col("away").isNull().cast("int"), "away", "block_idx")
    close = F.coalesce(F.col("away") <= Y_CLOSE, F.lit(False))
    confidence = F.when(F.col("tier") == 1, F.when(close, 1.0).otherwise(0.95)).when(F.col("tier") == 2, F.when(close, 0.98).otherwise(0.95)).when(F.col("tier") == 3, F.when(close, 0.88).otherwise(0.85)).when(F.col("tier") == 4, F.when(F.col("dest_y").isNotNull(), 0.78).otherwise(0.75)).otherwise(0.0)
    names = F.element_at(F.array(*map(F.lit, ("exact", "normalized", "fuzzy", "page_fallback", "unmatched"))), F.col("tier"))
    return ranked.withColumn("k", F.row_number().over(best)).where("k = 1").select(*keys, "outline_index", "block_idx", names.alias("match_type"), confidence.alias("confidence"))


def propagate(blocks: DataFrame, *, keys: tuple[str, ...], event: Column, value: Column, order: tuple[str, ...]) -> DataFrame:
    """Each row with the value of the latest event at or before it in its group (C4)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return blocks.withColumn("section", F.last(F.when(event, value), True).over(w))


def audit_counts(audit: DataFrame) -> DataFrame:
    """How many entries each kind of match has."""
    return audit.groupBy("match_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def page_windows(pages: DataFrame, *, key: str, page: str, size: int) -> DataFrame:
    """Runs of consecutive pages in windows of at most `size` pages."""
    w = Window.partitionBy(key).orderBy(page)
    island = pages.select(key, page).distinct().withColumn("island", F.col(page) - F.row_number().over(w))
    n = F.row_number().over(Window.partitionBy(key, "island").orderBy(page)) - 1
    return island.withColumn("part", F.floor(n / size)).groupBy(key, "island", "part").agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.count("*").alias("n_pages")).drop("island", "part")


def is_inline_icon(box: Column) -> Column:
    """A small picture: both sides up to 80 or an area up to 5000."""
    w, h = box["x1"] - box["x0"], box["y1"] - box["y0"]
    return box.isNotNull() & (((w <= 80) & (h <= 80)) | (w * h <= 5000))


def link_icons(icons: DataFrame, targets: DataFrame, *, keys: tuple[str, ...] = ("source", "page_idx")) -> DataFrame:
    """The target of each icon on its page: the first table around it, else the best by score.

    icons has icon_idx and box; targets have target_idx, kind (text, list or table), dangling (ends with an
    action that names no object) and box.
    """
    t = targets.select(*keys, "target_idx", "kind", "dangling", F.col("box").alias("t"))
    p = icons.select(*keys, "icon_idx", F.col("box").alias("i")).join(t, list(keys))
    i, b = F.col("i"), F.col("t")
    x, y = G.center(i)
    inside = G.contains_point(b, x, y)
    away, up = G.distance(i, b), G.vertical_overlap(i, b)
    h_gap = G.gap(i["x0"], i["x1"], b["x0"], b["x1"])
    dangling = F.col("dangling") & F.col("kind").isin("text", "list")
    table = (F.col("kind") == "table") & (inside | (G.overlap_ratio(i, b) >= 0.5))
    score = away + 0.10 * F.abs(G.center(b)[1] - y) - F.when(inside, 220.0).otherwise(0.0) - F.when(up > 0, 70.0).otherwise(0.0) - F.when((up > 0) & (h_gap <= 80), 90.0).otherwise(0.0) - F.when(dangling, 140.0).otherwise(0.0)
    p = p.select(*keys, "icon_idx", "target_idx", "kind", table.alias("in_table"), F.round(F.when(table, -1000.0 + away).otherwise(score), 6).alias("score"), inside.alias("inside"), dangling.alias("verb"), away.alias("away"), up.alias("up"), h_gap.alias("h_gap"))
    first = Window.partitionBy(*keys, "icon_idx").orderBy(F.desc("in_table"), F.when(F.col("in_table"), F.col("target_idx").cast("double")).otherwise(F.col("score")), "target_idx")
    best = p.withColumn("k", F.row_number().over(first)).where("k = 1")
    accept = F.col("in_table") | F.col("inside") | F.when(F.col("verb"), F.col("away") <= 260).otherwise(((F.col("up") > 0) & (F.col("h_gap") <= 90)) | (F.col("score") <= 130))
    return best.where(accept).select(*keys, "icon_idx", "target_idx", F.col("kind").alias("target_kind"), "score")


def neighbour_places(tokens: list[int], place: int, budget: int) -> list[tuple[int, str]]:
    """(place, side) of a target and of the whole neighbours that fit on either side of it."""
    rest = budget - min(tokens[place], budget // 5)
    out = [(place, "current")]
    for side, room, step in (("before", rest // 2, -1), ("after", rest - rest // 2, 1)):
        i, used = place + step, 0
        while 0 <= i < len(tokens) and used + tokens[i] <= room:
            used += tokens[i]
            out.append((i, side))
            i += step
    return out


def context_neighbours(blocks: DataFrame, targets: DataFrame, *, key: str, budget: int) -> DataFrame:
    """Whole blocks before and after each target within half of what the target leaves of the budget.

    blocks has block_idx and tokens; targets have key and block_idx. The target takes up to a fifth of the budget.
    A document is folded once, many in one Arrow batch: each target looks outwards only as far as its budget goes.
    """
    marked = blocks.select(key, "block_idx", "tokens").join(targets.select(key, "block_idx", F.lit(True).alias("hit")).distinct(), [key, "block_idx"], "left")
    group = marked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block_idx", F.col("tokens").cast("long").alias("tokens"), F.coalesce("hit", F.lit(False)).alias("hit")))).alias("b")).where(F.exists("b", lambda x: x["hit"]))

    @F.pandas_udf("array<struct<target:int,place:int,side:string>>")
    def run(tokens: pd.Series, hits: pd.Series) -> pd.Series:
        out = []
        for t, h in zip(tokens, hits, strict=True):
            t = t.tolist()
            out.append([{"target": i, "place": p, "side": s} for i, hit in enumerate(h.tolist()) if hit for p, s in neighbour_places(t, i, budget)])
        return pd.Series(out, dtype=object)

    near = group.withColumn("n", F.explode(run(F.col("b.tokens"), F.col("b.hit"))))
    own = F.get("b", F.col("n.place"))
    return near.select(key, F.get("b", F.col("n.target"))["block_idx"].alias("target_idx"), own["block_idx"].alias("block_idx"), F.col("n.side").alias("side"), own["tokens"].alias("tokens"))


def context_window(content: list[tuple[int, str]], target: int, budget: int) -> tuple[str, str, str]:
    """(before, target, after) texts of one group in order under a budget, cut at the edges, unused room moved over."""
    place = bisect_left(content, target, key=lambda x: x[0])
    own = X.truncate(content[place][1], budget // 5, from_tail=False)
    rest = budget - X.approx_count(own)

    def take(step: int, room: int, from_tail: bool) -> tuple[list[str], int]:
        out, used, i = [], 0, place + step
        while 0 <= i < len(content):
            text = content[i][1]
            cost = X.approx_count(text) + (1 if out else 0)
            if used + cost > room:
                part = X.truncate(text, room - used - (1 if out else 0), from_tail=from_tail)
                if part:
                    out.append(part)
                    used += X.approx_count(part) + (1 if len(out) > 1 else 0)
                break
            out.append(text)
            used += cost
            i += step
        return out, used

    half = rest // 2
    before, b = take(-1, half, True)
    after, a = take(1, rest - b if b < half else rest - half, False)
    if b >= half and a < rest - half:
        before, b = take(-1, rest - a, True)
    return "\n".join(reversed(before)), own, "\n".join(after)


def truncated_contexts(blocks: DataFrame, targets: DataFrame, *, key: str, budget: int) -> DataFrame:
    """(key, target_idx, before, target, after); a document's texts move once for all its targets."""
    rows = blocks.select(key, "block_idx", "text").join(targets.select(key, "block_idx", F.lit(True).alias("hit")).distinct(), [key, "block_idx"], "left")

    rows = rows.select(key, "block_idx", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("hit", F.lit(False)).alias("hit"))

    def fold(places: list[int], texts: list[str], hits: list[bool]) -> Iterator[tuple]:
        content = list(zip(places, texts, strict=True))
        return ((t, *context_window(content, t, budget)) for t, hit in zip(places, hits, strict=True) if hit)

    return fold_groups(rows, key, ["block_idx", "text", "hit"], fold, "target_idx int, before string, target string, after string")


def patch_fields(blocks: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Fields with text of each block, known ones first, then others of the extras map."""
    fixed = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("field"), F.col(n).alias("text")) for i, n in enumerate(known)])
    extra = F.transform(F.map_entries("extras"), lambda e: F.struct(F.lit(len(known)).alias("pos"), e["key"].alias("field"), e["value"].alias("text")))
    rows = blocks.select("source", "block_idx", F.explode(F.concat(fixed, F.coalesce(extra, F.array().cast("array<struct<pos:int,field:string,text:string>>")))).alias("f"))
    return rows.where("f.text IS NOT NULL AND trim(f.text) <> ''").select("source", "block_idx", "f.pos", "f.field", "f.text")


def subset_closure(blocks: DataFrame, pages: DataFrame, continuations: DataFrame, icons: DataFrame) -> DataFrame:
    """Blocks of the chosen pages with the tables they continue and the targets of their icons."""
    chosen = blocks.join(pages, ["source", "page_idx"], "left_semi").select("source", "block_idx")
    masters = continuations.join(chosen, ["source", "block_idx"], "left_semi").select("source", F.col("master_idx").alias("block_idx"))
    linked = icons.select("source", F.col("icon_idx").alias("block_idx"), "target_idx").join(chosen, ["source", "block_idx"], "left_semi").select("source", F.col("target_idx").alias("block_idx"))
    return chosen.unionByName(masters).unionByName(linked).distinct()

