"""What is added to layout blocks: source fields, patches, captions, crop regions and chunk items.

Blocks have source, block_idx, page_idx, type, box and the text fields of TEXT_FIELDS that their type uses;
list fields are arrays, all others strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import text as X

# The text fields of blocks in the order they are shown, types that carry no text of their own,
# the parts of a full picture description, and the fields that are patched by type.
TEXT_FIELDS = ("text", "list_items", "table_caption", "table_body", "table_footnote", "image_caption", "image_footnote")
IGNORED_TYPES = ("header", "footer", "page_number", "aside_text", "page_footnote", "equation", "seal", "chart")
DESCRIPTION_FIELDS = ("image_description_vlm", "image_answering_policy")
PATCH_FIELDS = {"text": ("text",), "list": ("list_items",), "table": ("table_footnote", "table_body"), "image": ("image_caption", "image_footnote")}
PAGE_MARKS = ("header", "footer", "page_number")


def field_text(blocks: DataFrame, name: str) -> Column:
    """A text field as one string without blanks at its ends: lists are joined by lines, null is empty."""
    if name not in blocks.columns:
        return F.lit("")
    whole = X.join_field(name) if dict(blocks.dtypes)[name].startswith("array") else F.coalesce(F.col(name), F.lit(""))
    return F.btrim(whole, F.lit(" \t\r\n"))


def block_text(blocks: DataFrame) -> Column:
    """All text fields of a block that are not blank, one after the other."""
    texts = F.array(*[field_text(blocks, f) for f in TEXT_FIELDS])
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n")


def context_header(block_idx: Column, page_idx: Column, kind: Column, text: Column, master: Column | None = None) -> Column:
    """A block's text under a line that says where it stands; a continuation names its master (B33). No text, no line."""
    of = F.lit("") if master is None else F.when(master.isNotNull(), F.format_string(", continuation of table block %s, source block %s", master.cast("string"), master.cast("string"))).otherwise("")
    head = F.concat(F.lit("--- [Block "), block_idx.cast("string"), F.lit(", page "), page_idx.cast("string"), F.lit(", type "), kind, of, F.lit("] ---\n"))
    return F.when(text != "", F.concat(head, text)).otherwise("")


def source_metadata(blocks: DataFrame, path: Column, *, root: str | None = None) -> DataFrame:
    """Blocks with source_relpath, source_filename and a breadcrumb down to their section."""
    relpath = X.source_name(path, root)
    section = F.coalesce("section_path", F.array().cast("array<string>"))
    return blocks.withColumns({"source_relpath": relpath, "source_filename": F.substring_index(relpath, "/", -1), "breadcrumb": X.breadcrumb(relpath, section)})


# --- patches -------------------------------------------------------------------------------------------


def apply_patches(fields: DataFrame, answers: DataFrame, *, keys: tuple[str, ...] = ("source", "block_idx", "field")) -> DataFrame:
    """Fields with what their answers make of them: text, patched, checked and the decision.

    fields has keys, text and checked (from an earlier run); answers has keys and answer. A checked field
    keeps its text, one without an answer stays unchecked; an answer that says nothing is missing, is empty or
    is only an icon leaves the text, any other replaces it.
    """
    said = X.strip_reasoning("answer")
    rows = fields.join(answers.select(*keys, "answer"), list(keys), "left")
    decision = F.when(F.col("checked"), "checked_before").when(F.col("answer").isNull(), "pending").when(said == F.col("text"), "same").otherwise(X.patch_decision(F.col("text"), said))
    rows = rows.withColumn("decision", decision).withColumn("patched", F.col("decision") == "apply")
    return rows.select(*keys, F.when(F.col("patched"), said).otherwise(F.col("text")).alias("text"), "patched", (F.col("decision") != "pending").alias("checked"), "decision")


def patch_counts(applied: DataFrame, *, key: str = "source") -> DataFrame:
    """How many fields of each source were patched, left, rejected or are still to do."""
    d = F.col("decision")
    return applied.groupBy(key).agg(F.count("*").alias("n_fields"), F.count_if(d == "apply").alias("n_patched"), F.count_if(d.isin("no_missing", "same")).alias("n_unchanged"), F.count_if(d.isin("only_icon", "empty")).alias("n_rejected"), F.count_if(d == "pending").alias("n_pending"))


# --- captions ------------------------------------------------------------------------------------------


def caption_state(blocks: DataFrame, *, skip_existing: bool = True) -> Column:
    """inline_icon, no_path, existing or candidate of a picture, null of other blocks (C14)."""
    full = F.lit(True)
    for f in DESCRIPTION_FIELDS:
        full = full & (field_text(blocks, f) != "")
    path = F.coalesce(F.col("img_path"), F.lit(""))
    state = F.when(F.coalesce("inline_icon", F.lit(False)), "inline_icon").when(path == "", "no_path")
    state = state.when(full, "existing") if skip_existing else state
    return F.when(F.col("type") == "image", state.otherwise("candidate"))


def caption_candidates(blocks: DataFrame, *, skip_existing: bool = True) -> DataFrame:
    """Pictures that are to be described (C14)."""
    return blocks.where(caption_state(blocks, skip_existing=skip_existing) == "candidate")


def caption_stats(blocks: DataFrame, *, key: str = "source", skip_existing: bool = True, exists: Column | None = None) -> DataFrame:
    """Pictures of each source by what becomes of them, each counted once, and candidates without a file (C17)."""
    rows = blocks.withColumn("state", caption_state(blocks, skip_existing=skip_existing)).where("state IS NOT NULL")
    counts = [F.count_if(F.col("state") == s).alias(n) for s, n in (("inline_icon", "n_inline_icons"), ("no_path", "n_without_path"), ("existing", "n_existing"), ("candidate", "n_candidates"))]
    missing = F.count_if((F.col("state") == "candidate") & ~(F.lit(True) if exists is None else exists)).alias("n_missing_files")
    return rows.groupBy(key).agg(F.count("*").alias("n_images"), *counts, missing)


def caption_worklist(blocks: DataFrame, *, rules: list[tuple[str, str]], contexts: DataFrame | None = None, skip_existing: bool = False) -> DataFrame:
    """A row for each candidate: its type by the rules, a preview of its caption and its context, if given."""
    from .rules import cascade

    caption = F.btrim(F.concat_ws(" ", field_text(blocks, "image_caption"), field_text(blocks, "image_footnote")))
    rows = caption_candidates(blocks.withColumn("caption", caption), skip_existing=skip_existing)
    full = F.lit(True)
    for f in DESCRIPTION_FIELDS:
        full = full & (field_text(rows, f) != "")
    out = rows.select("source", "block_idx", "page_idx", (F.col("page_idx") + 1).alias("pdf_page"), "img_path", cascade(F.lower("caption"), rules, "unclear").alias("image_type"), X.snippet("caption", 160).alias("caption_preview"), full.alias("has_existing_description"))
    return out if contexts is None else out.join(contexts, ["source", "block_idx"], "left")


def context_token_stats(contexts: DataFrame, *, keys: tuple[str, ...] = (), tokens: str = "tokens", budget: int) -> DataFrame:
    """Number, least, nearest-rank percentiles, largest and mean of context sizes, and how many are near the budget."""
    w = Window.partitionBy(*[F.col(k) for k in keys]) if keys else None
    if keys:
        placed = contexts.withColumns({"i": F.row_number().over(w.orderBy(tokens)), "n": F.count("*").over(w)})
        rank = lambda q: F.max(F.when(F.col("i") == F.ceil(F.col("n") * q), F.col(tokens)))
        marks = [rank(q).alias(f"p{int(q * 100)}_tokens") for q in (0.5, 0.9, 0.95)]
    else:
        # One group: a histogram of sizes is small, and its running sum gives every rank.
        sizes = contexts.groupBy(F.col(tokens).alias("v")).agg(F.count("*").alias("c"))
        run = F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        placed = sizes.withColumns({"upto": run, "n": F.sum("c").over(Window.partitionBy())})
        rank = lambda q: F.coalesce(F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * q), F.col("v"))), F.lit(0))
        near = F.coalesce(F.sum(F.when(F.col("v") >= int(budget * 0.95), F.col("c"))), F.lit(0)) if budget > 0 else F.lit(0)
        total = F.coalesce(F.sum("c"), F.lit(0))
        return placed.agg(total.alias("n_contexts"), F.coalesce(F.min("v"), F.lit(0)).alias("min_tokens"), *[rank(q).alias(f"p{int(q * 100)}_tokens") for q in (0.5, 0.9, 0.95)], F.coalesce(F.max("v"), F.lit(0)).alias("max_tokens"), F.round(F.coalesce(F.sum(F.col("v") * F.col("c")) / total, F.lit(0.0)), 6).alias("mean_tokens"), near.alias("n_at_budget"))
    near = F.count_if(F.col(tokens) >= int(budget * 0.95)) if budget > 0 else F.lit(0)
    return placed.groupBy(*keys).agg(F.count("*").alias("n_contexts"), F.min(tokens).alias("min_tokens"), *marks, F.max(tokens).alias("max_tokens"), F.round(F.avg(tokens), 6).alias("mean_tokens"), near.alias("n_at_budget"))


# --- regions -------------------------------------------------------------------------------------------


def footnote_regions(blocks: DataFrame, *, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """(keys, block_idx, page_idx, box): where the footnote of each table is looked for (C11).

    Tables that follow without a block between them (marks of the page apart) and without a footnote of their
    own belong to it. The region goes from the last one's lower edge to the next block below on that page, or
    to the page's end, twelve units wider than the table.
    """
    w = Window.partitionBy(*keys).orderBy("block_idx")
    has_note = field_text(blocks, "table_footnote") != ""
    seen = blocks.where(~F.col("type").isin(*IGNORED_TYPES)).withColumn("stop", (F.col("type") != "table") | has_note)
    # A run ends before the next block that is no table or has a footnote.
    after = Window.partitionBy(*keys).orderBy("block_idx").rowsBetween(1, Window.unboundedFollowing)
    ends = seen.withColumn("until", F.min(F.when(F.col("stop"), F.col("block_idx"))).over(after))
    tables = ends.where("type = 'table'").withColumn("tail", F.last(F.struct("block_idx", "page_idx", "box")).over(Window.partitionBy(*keys, "until").orderBy("block_idx").rowsBetween(0, Window.unboundedFollowing)))
    tables = tables.where("box IS NOT NULL AND tail.box IS NOT NULL").select(*keys, "block_idx", "box", F.col("tail.block_idx").alias("last_idx"), F.col("tail.page_idx").alias("page_idx"), F.col("tail.box.y1").alias("top"))
    # What stands on the same page without a break of pages after the last table.
    pages = blocks.withColumn("turn", F.sum((F.col("page_idx") != F.coalesce(F.lag("page_idx").over(w), F.col("page_idx"))).cast("int")).over(w))
    turns = pages.select(*keys, F.col("block_idx").alias("last_idx"), "turn")
    below = pages.where(~F.col("type").isin(*PAGE_MARKS) & F.col("box").isNotNull()).select(*keys, "turn", F.col("block_idx").alias("next_idx"), F.col("box.y0").alias("next_top"))
    near = tables.join(turns, [*keys, "last_idx"]).join(below, [*keys, "turn"], "left")
    follows = (F.col("next_idx") > F.col("last_idx")) & (F.col("next_top") > F.col("top"))
    first = F.min(F.when(follows, F.struct("next_idx", "next_top")))["next_top"]
    out = near.groupBy(*keys, "block_idx", "page_idx", "box", "top").agg(F.coalesce(first, F.lit(G.GRID)).alias("bottom"))
    box = F.struct(F.greatest(F.lit(0.0), F.col("box.x0") - 12).alias("x0"), F.col("top").alias("y0"), F.least(F.lit(G.GRID), F.col("box.x1") + 12).alias("x1"), F.col("bottom").alias("y1"))
    return out.select(*keys, "block_idx", "page_idx", box.alias("box"))


def body_regions(blocks: DataFrame, continuations: DataFrame, icons: DataFrame, *, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """(keys, block_idx, part_idx, page_idx, box): each table and its continuations, with the table's icons on their page.

    continuations has keys, block_idx and master_idx; icons has keys, target_idx, page_idx and box.
    """
    masters = blocks.where("type = 'table'").select(*keys, F.col("block_idx").alias("master_idx"), F.col("block_idx"))
    members = masters.join(continuations.select(*keys, "block_idx"), [*keys, "block_idx"], "left_anti").unionByName(continuations.select(*keys, "master_idx", "block_idx"))
    parts = members.join(blocks.where("box IS NOT NULL").select(*keys, "block_idx", "page_idx", "box"), [*keys, "block_idx"])
    marks = icons.where("box IS NOT NULL").groupBy(*keys, F.col("target_idx").alias("master_idx"), "page_idx").agg(*[f(f"box.{n}").alias(f"i{n}") for f, n in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    rows = parts.join(marks, [*keys, "master_idx", "page_idx"], "left")
    box = F.struct(*[f(f"box.{n}", F.coalesce(f"i{n}", f"box.{n}")).alias(n) for f, n in ((F.least, "x0"), (F.least, "y0"), (F.greatest, "x1"), (F.greatest, "y1"))])
    return rows.select(*keys, F.col("master_idx").alias("block_idx"), F.col("block_idx").alias("part_idx"), "page_idx", box.alias("box"))


def patch_regions(blocks: DataFrame, fields: DataFrame, continuations: DataFrame, icons: DataFrame, *, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """(keys, page_idx, field, label, box) of all fields that are looked at, and of linked icons.

    fields has keys, block_idx and field. A table's body has a region for each of its parts, its footnote the
    place where it may stand, any other field its block with the icons on its page.
    """
    body = body_regions(blocks, continuations, icons, keys=keys)
    label = lambda *c: F.concat_ws(":", *[x.cast("string") for x in c])
    b = fields.where("field = 'table_body'").join(body, [*keys, "block_idx"])
    b = b.select(*keys, "page_idx", "field", F.when(F.col("part_idx") == F.col("block_idx"), label(F.col("block_idx"), F.col("field"))).otherwise(label(F.col("block_idx"), F.col("field"), F.lit("continuation"))).alias("label"), "box")
    n = fields.where("field = 'table_footnote'").join(footnote_regions(blocks, keys=keys), [*keys, "block_idx"])
    n = n.select(*keys, "page_idx", "field", label(F.col("block_idx"), F.col("field")).alias("label"), "box")
    marks = icons.where("box IS NOT NULL").groupBy(*keys, F.col("target_idx").alias("block_idx"), "page_idx").agg(*[f(f"box.{x}").alias(f"i{x}") for f, x in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    o = fields.where("field NOT IN ('table_body', 'table_footnote')").join(blocks.where("box IS NOT NULL").select(*keys, "block_idx", "page_idx", "box"), [*keys, "block_idx"]).join(marks, [*keys, "block_idx", "page_idx"], "left")
    box = F.struct(*[f(f"box.{x}", F.coalesce(f"i{x}", f"box.{x}")).alias(x) for f, x in ((F.least, "x0"), (F.least, "y0"), (F.greatest, "x1"), (F.greatest, "y1"))])
    o = o.select(*keys, "page_idx", "field", label(F.col("block_idx"), F.col("field")).alias("label"), box.alias("box"))
    i = icons.where("box IS NOT NULL").select(*keys, "page_idx", F.lit("inline_icon").alias("field"), label(F.col("icon_idx"), F.lit("inline-icon")).alias("label"), "box")
    return b.unionByName(n).unionByName(o).unionByName(i)


def caption_regions(neighbours: DataFrame, blocks: DataFrame, *, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """(keys, target_idx, block_idx, field, label, box): each picture and the blocks of its context.

    neighbours has keys, target_idx, block_idx and side (before, current, after).
    """
    places = blocks.where("box IS NOT NULL").select(*keys, "block_idx", "page_idx", "box")
    near = neighbours.select(*keys, "target_idx", "block_idx", F.concat(F.lit("context_"), "side").alias("field"), F.concat_ws(":", F.col("target_idx").cast("string"), "side", F.col("block_idx").cast("string")).alias("label"))
    own = neighbours.select(*keys, "target_idx").distinct().select(*keys, "target_idx", F.col("target_idx").alias("block_idx"), F.lit("caption_target").alias("field"), F.concat(F.col("target_idx").cast("string"), F.lit(":image")).alias("label"))
    return own.unionByName(near).join(places, [*keys, "block_idx"])


def chunk_regions(chunks: DataFrame) -> DataFrame:
    """(chunk_id, page_idx, pos, box, label_tokens): all boxes of chunks; the first one shows the tokens.

    chunks has chunk_id, token_count and boxes: an array of (page_idx, box) in order.
    """
    rows = chunks.select("chunk_id", "token_count", F.posexplode("boxes").alias("pos", "b"))
    return rows.select("chunk_id", "b.page_idx", "pos", "b.box", F.when(F.col("pos") == 0, F.col("token_count")).alias("label_tokens"))


# --- chunk items -----------------------------------------------------------------------------------------


def chunk_items(blocks: DataFrame, continuations: DataFrame | None = None) -> DataFrame:
    """(source, block_idx, page_idx, text, images, tables, section_path): what chunks are made of.

    Pictures and tables are shown by labelled lines; an inline icon's picture is left out, a table that continues
    another is part of that one. Blocks of ignored types, and those without text and picture, make no item.
    """
    rows = blocks if continuations is None else blocks.join(continuations.select("source", "block_idx"), ["source", "block_idx"], "left_anti")
    f = {n: field_text(blocks, n) for n in (*TEXT_FIELDS, *DESCRIPTION_FIELDS)}
    labelled = lambda name, t: F.when(t != "", F.concat(F.lit(f"[{name}: "), t, F.lit("]")))
    image = F.concat_ws("\n", labelled("Image caption", f["image_caption"]), labelled("Image VLM description", f["image_description_vlm"]), labelled("Image footnote", f["image_footnote"]), labelled("Image answering policy", f["image_answering_policy"]))
    table = F.concat_ws("\n", labelled("Table caption", f["table_caption"]), F.nullif(f["table_body"], F.lit("")), labelled("Table footnote", f["table_footnote"]))
    kind, none = F.col("type"), F.array().cast("array<string>")
    text = F.when(kind == "image", image).when(kind == "table", table).when(kind == "list", f["list_items"]).when(kind == "text", f["text"])
    path = F.coalesce(F.col("img_path"), F.lit(""))
    images = F.when((kind == "image") & (path != "") & ~F.coalesce("inline_icon", F.lit(False)), F.array(path)).otherwise(none)
    tables = F.when((kind == "table") & (path != ""), F.array(path)).otherwise(none)
    out = rows.where(kind.isin("image", "table", "list", "text")).select("source", "block_idx", "page_idx", text.alias("text"), images.alias("images"), tables.alias("tables"), "section_path")
    return out.where((F.col("text") != "") | (F.size("images") > 0) | (F.size("tables") > 0))
