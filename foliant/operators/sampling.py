"""Query sets and gold sets: typing, eligibility, templates, quotas, page cards, samples and integrity rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

# The share of each type in a query set and the order of backfilling.
QUOTAS = {"text": 0.30, "operation": 0.25, "table": 0.20, "image_ui": 0.15}
BACKFILL = ("operation", "table", "image_ui", "mixed", "text")


def query_type(text: Column) -> Column:
    """table, else mixed (picture and steps), image_ui, operation or text (M1)."""
    table = F.contains(text, F.lit("[Table caption:")) | F.contains(text, F.lit("[Table:")) | F.contains(text, F.lit("<table"))
    image = text.rlike(r"\[Image (?:caption|VLM description|description):|\[Image with illustration")
    steps = text.rlike(r"\bStep\s+\d+")
    return F.when(table, "table").when(image & steps, "mixed").when(image, "image_ui").when(steps, "operation").otherwise("text")


def quota_sizes(target: int) -> dict[str, int]:
    """How many queries of each type; halves round to even, the rest is mixed."""
    sizes = {k: round(target * v) for k, v in QUOTAS.items()}
    return sizes | {"mixed": target - sum(sizes.values())}


def quota_sample(chunks: DataFrame, *, target: int, order: str = "chunk_no", section: str = "section", kind: str = "query_type") -> DataFrame:
    """The first unseen section of each type up to its quota, at least one of each, then backfill by type.

    Every row is the first of its section or left out; if sections are too few for the target, the
    other rows follow in order. A window with a limit for each type leaves at most target rows of each.
    """
    first = F.row_number().over(Window.partitionBy(section).orderBy(order)) == 1
    rows = chunks.withColumn("repeat", (~first).cast("int"))
    firsts = rows.agg(F.sum(1 - F.col("repeat")).alias("n_first"))
    pool = rows.crossJoin(F.broadcast(firsts)).where((F.col("repeat") == 0) | (F.col("n_first") < target))
    sizes = quota_sizes(target)
    quota = F.create_map(*[F.lit(z) for k, v in sizes.items() for z in (k, max(1, v))])
    place = F.row_number().over(Window.partitionBy(kind).orderBy("repeat", order))
    # Beyond place target no row of a type is ever taken, so the last ranking is over a few rows.
    pool = pool.withColumn("place", place).where(F.col("place") <= target).withColumn("in_quota", F.col("place") <= F.try_element_at(quota, F.col(kind)))
    quota_order = F.array_position(F.array(*map(F.lit, sizes)), F.col(kind))
    back_order = F.array_position(F.array(*map(F.lit, BACKFILL)), F.col(kind))
    turn = F.struct((~F.col("in_quota")).cast("int").alias("a"), F.when(F.col("in_quota"), quota_order).otherwise(back_order).alias("b"), "place")
    ranked = pool.withColumn("query_no", F.row_number().over(Window.orderBy(turn)))
    return ranked.where(F.col("query_no") <= target).drop("repeat", "n_first", "place", "in_quota")


def keywords(docs: DataFrame, *, k: int, id_col: str = "doc_id", text_col: str = "text", stop_words: tuple[str, ...] = ()) -> DataFrame:
    """The k most frequent words of four letters and more of each text, ties by first place."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit("[a-z][a-z0-9-]{3,}"), F.lit(0))
    # Dealt out as texts: all that follows stays where the text is, as rows of words are many times its size.
    rows = docs.select(id_col, text_col).repartition(F.col(id_col)).select(id_col, F.posexplode(words).alias("pos", "word"))
    if stop_words:
        rows = rows.where(~F.col("word").isin(*stop_words))
    counts = rows.groupBy(id_col, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    w = Window.partitionBy(id_col).orderBy(F.desc("n"), "first")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(id_col, "word", "n", "place")


def keyword_groups(docs: DataFrame, groups: dict[str, list[str]], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text with each group one of whose keywords it contains (N5); the rules are part of the plan."""
    text = F.lower(F.coalesce(text_col, F.lit("")))
    hits = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), F.lit(name)) for name, words in groups.items()]
    return docs.select(id_col, F.explode(F.array_compact(F.array(*hits))).alias("group"))


def systematic_sample(rows: DataFrame, *, key: str, order: str, size: int) -> DataFrame:
    """About `size` rows of each group at even steps."""
    w = Window.partitionBy(key)
    placed = rows.withColumn("i", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / size))
    return placed.where((F.col("i") % step == 0) & (F.col("i") / step < size)).drop("i", "n")


def question_flags(evidence: DataFrame) -> DataFrame:
    """Whether the evidence of a question lies on several pages or in several files, or is visual."""
    return evidence.groupBy("qa_id").agg((F.count_distinct("pdf", "page") > 1).alias("several_pages"), (F.count_distinct("pdf") > 1).alias("several_files"), F.max(F.col("modality").isin("image", "drawing", "table")).alias("visual"))


def integrity(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule, one pass for all rules."""
    counts = rows.agg(*[F.count_if(c).alias(name) for name, c in rules.items()], F.count("*").alias("__n"))
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_broken")) for n in rules])
    return counts.select(F.explode(pairs).alias("r"), F.col("__n").alias("n_rows")).select("r.rule", "r.n_broken", "n_rows")


def token_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9][a-z0-9.+/@_-]+"), F.lit(0)))


def support_coverage(claims: DataFrame, pages: DataFrame, *, on: list[str], floor: float = 0.88) -> DataFrame:
    """Share of a claim's distinct words that its page has, and whether that is enough."""
    pairs = claims.join(pages, on).withColumn("c", token_set(F.col("claim"))).withColumn("p", token_set(F.col("page_text")))
    share = F.round(F.when(F.size("c") > 0, F.size(F.array_intersect("c", "p")) / F.size("c")).otherwise(0.0), 6)
    return pairs.select(*on, share.alias("coverage"), (share >= floor).alias("supported"))


def sentences(text: Column) -> Column:
    """Sentences of 45 to 520 characters."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.btrim(s)), lambda s: (F.char_length(s) >= 45) & (F.char_length(s) <= 520))


# Fixed value: the share of questions on pictured pages.
VISUAL_SHARE = 0.15


def mixed_set(text_queries: DataFrame, visual_queries: DataFrame, *, target: int, order: str = "query_no") -> DataFrame:
    """Text queries, then visual ones up to their share, numbered anew (M6)."""
    n_visual = max(0, min(target, round(target * VISUAL_SHARE)))
    w = Window.orderBy(order)
    # Only the first rows of each side are numbered in one place.
    visual = visual_queries.orderBy(order).limit(n_visual).withColumn("k", F.row_number().over(w))
    have = visual.agg(F.count("*").alias("n_visual"))
    text = text_queries.orderBy(order).limit(target).withColumn("k", F.row_number().over(w)).join(F.broadcast(have)).where(F.col("k") <= target - F.col("n_visual")).drop("n_visual")
    both = text.withColumn("turn", F.lit(0)).unionByName(visual.withColumn("turn", F.lit(1)))
    return both.withColumn("query_id", F.format_string("full-%03d", F.row_number().over(Window.orderBy("turn", "k")))).drop("turn", "k")


def outline_at_page(outline: DataFrame, pages: DataFrame, *, key: str = "source") -> DataFrame:
    """The path of each page: of each level the latest entry up to it that no higher level has ended since.

    outline has outline_index, level, title and page; pages have page. An entry holds from its page to the
    next entry of its own or a higher level, so the path is a join of pages with these spans.
    """
    rest = Window.partitionBy(key).orderBy("outline_index").rowsBetween(1, Window.unboundedFollowing)
    later = F.collect_list(F.struct("level", "page")).over(rest)
    until = F.get(F.filter(later, lambda x: x["level"] <= F.col("level")), F.lit(0))["page"]
    spans = outline.withColumn("until", until)
    reach = (F.col("p") >= F.col("page")) & (F.col("until").isNull() | (F.col("p") < F.col("until")))
    found = pages.select(key, F.col("page").alias("p")).distinct().join(spans, key).where(reach)
    # Entries of one level on one page end each other; of what is left each level has one.
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "outline_index", "title"))), lambda x: x["title"]), " > ")
    return found.groupBy(key, F.col("p").alias("page")).agg(path.alias("path"))


# --- query sets ------------------------------------------------------------------------------------------

# Titles that ask no question, the first page that is asked about, the shortest text, and how a
# section's title becomes an action.
NO_QUESTION_TITLES = ("foreword", "contents")
FIRST_PAGE, LEAST_NOTE = 10, 40
ACTIONS = {
    "Configuring ": "configure ", "Adding ": "add ", "Creating ": "create ", "Managing ": "manage ", "Viewing ": "view ", "Searching ": "search ", "Setting ": "set ",
    "Editing ": "edit ", "Importing ": "import ", "Exporting ": "export ", "Enabling ": "enable ", "Disabling ": "disable ", "Installing ": "install ", "Logging ": "log ",
}


def eligible(text: Column, pages: Column, title: Column, chunk_id: Column) -> Column:
    """Whether a chunk can be asked about: it has an id, lies behind the front matter and says enough (M2)."""
    short = (query_type(text) == "text") & (F.char_length(X.clean_note(text, 80)) < LEAST_NOTE)
    front = F.coalesce(F.array_min(pages) < FIRST_PAGE, F.lit(False))
    return ~short & ~front & ~F.lower(F.coalesce(title, F.lit(""))).isin(*NO_QUESTION_TITLES) & (F.coalesce(chunk_id, F.lit("")) != "")


def plain_title(title: Column) -> Column:
    """A section's title without its number."""
    return F.btrim(F.regexp_replace(F.coalesce(title, F.lit("")), r"^\s*[0-9]+(?:\.[0-9]+)*\.?\s+", ""))


def question(text: Column, title: Column) -> Column:
    """A question for a chunk by its type, about its caption, else its section (M3)."""
    kind, subject = query_type(text), plain_title(title)
    named = lambda *patterns: F.coalesce(*[F.nullif(X.label(text, p), F.lit("")) for p in patterns])
    about = lambda found, none: F.coalesce(found, F.nullif(subject, F.lit("")), F.lit(none))
    ask = lambda head, x, tail: F.concat(F.lit(head), x, F.lit(tail))
    action = F.when(subject == "", "How is this operation performed in the manual?")
    for word, verb in ACTIONS.items():
        action = action.when(F.startswith(subject, F.lit(word)), ask(f"How do I {verb}", F.substr(subject, F.lit(len(word) + 1)), "?"))
    action = action.otherwise(ask("How do I use ", subject, "?"))
    table = about(named(r"\[Table caption:\s*([^\]]+)\]", r"\[Table:\s*([^\]]+)\]"), "this table")
    image = about(named(r"\[Image caption:\s*([^\]]+)\]", r"\[Image with illustration:\s*([^\]]+)\]"), "this interface")
    plain = F.when(subject == "", "What information is provided in this section of the manual?").otherwise(ask("What does the manual say about ", subject, "?"))
    return (
        F.when(kind == "table", ask("What parameters or information are described in ", table, "?"))
        .when(kind == "image_ui", ask("What does ", image, " show in the manual?"))
        .when(kind == "mixed", ask("What operation and visual information are described in ", about(F.lit(None).cast("string"), "this section"), "?"))
        .when(kind == "operation", action)
        .otherwise(plain)
    )


def visual_page_queries(images: DataFrame, *, target: int) -> DataFrame:
    """Questions about pictured pages: pages of most pictures first, each page once, then again with other subjects (M5).

    images has page_idx, block_idx, caption, description and section_title (null if there are none). A
    subject is asked about once on a page.
    """
    subject = F.coalesce(F.nullif(X.snippet("caption", 1_000_000), F.lit("")), F.nullif(plain_title(F.col("section_title")), F.lit("")), F.concat(F.lit("page "), (F.col("page_idx") + 1).cast("string")))
    said = lambda c: (F.btrim(F.coalesce(c, F.lit(""))) != "").cast("int")
    rows = images.where(F.col("page_idx") >= FIRST_PAGE).withColumns({"subject": subject, "n_images": F.count("*").over(Window.partitionBy("page_idx")), "richness": said("description") + said("caption")})
    order = [F.desc("n_images"), F.desc("richness"), F.desc("page_idx"), F.asc("block_idx")]
    first = F.row_number().over(Window.partitionBy("page_idx", F.lower("subject")).orderBy(*order))
    rows = rows.withColumn("k", first).where("k = 1").withColumn("again", (F.row_number().over(Window.partitionBy("page_idx").orderBy(*order)) > 1).cast("int"))
    ask = F.when(F.lower("subject").startswith("figure"), F.concat(F.lit("What does "), "subject", F.lit(" show?"))).otherwise(F.concat(F.lit("What visual information is shown in "), "subject", F.lit("?")))
    # Only the first target rows are numbered in one place.
    chosen = rows.orderBy("again", *order).limit(target)
    number = F.row_number().over(Window.orderBy("again", *order))
    return chosen.withColumn("query_id", F.format_string("full-visual-%03d", number)).select("query_id", ask.alias("query"), "page_idx", "block_idx")


def fixed_set(spark: SparkSession, rows: list[tuple[str, str, str, list[int]]]) -> DataFrame:
    """A pilot set that was written by hand: id, query, type and gold pages (M7). The rows are the caller's."""
    return spark.createDataFrame(rows, "query_id string, query string, query_type string, gold_page_indices array<int>")


def query_rows(qa: DataFrame) -> DataFrame:
    """Gold questions as query rows with the distinct pages of their evidence in order.

    qa has n (place), id, question, answer and evidence: an array of (page_idx, pdf); rows without an id get one.
    """
    pages = F.array_sort(F.array_distinct(F.filter(F.transform("evidence", lambda e: e["page_idx"]), lambda p: p.isNotNull())))
    pages = F.coalesce(pages, F.array().cast("array<int>"))
    return qa.select(F.coalesce(F.nullif("id", F.lit("")), F.format_string("qa-%04d", "n")).alias("query_id"), F.coalesce("question", F.lit("")).alias("query"), F.coalesce("answer", F.lit("")).alias("canonical_answer"), pages.alias("gold_page_indices"), F.transform(pages, lambda p: p + 1).alias("gold_page_numbers"))


# --- gold sets -------------------------------------------------------------------------------------------

LEAST_TEXT = 120


def page_cards(pages: DataFrame, paths: DataFrame | None = None, *, excerpt: int = 1200, stop_words: tuple[str, ...] = (), n_keywords: int = 12) -> DataFrame:
    """A card for each page: text length, excerpt, title, path, facts, keywords and modality.

    pages has source, page_idx, text, n_images and n_drawings; paths has source, page_idx and path. The title
    is the first of the first eight lines of 8 to 130 characters that is no number.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.slice(F.filter(F.transform(F.split(text, "\n"), lambda s: X.snippet(s, 1_000_000)), lambda s: s != ""), F.lit(1), F.lit(8))
    titles = F.filter(lines, lambda s: F.char_length(s).between(8, 130) & ~s.rlike(r"^[IVXLC0-9 .-]+$"))
    modality = F.array_compact(F.array(F.when(F.char_length(text) > 0, "text"), F.when(F.col("n_images") > 0, "image"), F.when(F.col("n_drawings") > 0, "diagram")))
    modality = F.when(F.size(modality) == 0, F.array(F.lit("visual"))).otherwise(modality)
    cards = pages.select(
        "source", "page_idx", F.char_length(text).alias("text_chars"), X.snippet(text, excerpt).alias("excerpt"), F.coalesce(F.get(titles, F.lit(0)), F.concat(F.lit("Page "), (F.col("page_idx") + 1).cast("string"))).alias("title"),
        F.slice(sentences(text), F.lit(1), F.lit(8)).alias("key_facts"), modality.alias("modality"), (F.char_length(text) < LEAST_TEXT).alias("needs_review"),
    )
    id_of = F.struct("source", "page_idx")
    words = keywords(pages.select(id_of.alias("__id"), "text"), k=n_keywords, id_col="__id", stop_words=stop_words)
    words = words.groupBy("__id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("keywords")).select("__id.source", "__id.page_idx", "keywords")
    out = cards.join(words, ["source", "page_idx"], "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    return out if paths is None else out.join(paths, ["source", "page_idx"], "left")


def assemble_questions(parts: list[DataFrame], targets: DataFrame, *, fill: DataFrame, least: int = 200) -> DataFrame:
    """Questions of all generators, then of each document what its target still lacks, numbered in order.

    parts have pdf, n (place) and question; the last, fill, is taken from by document up to its target.
    Fewer than least in the end are an error of the data, not of the plan: see integrity().
    """
    done = parts[0].withColumn("part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        done = done.unionByName(p.withColumn("part", F.lit(i)))
    have = done.groupBy("pdf").agg(F.count("*").alias("have"))
    room = targets.join(have, "pdf", "left").select("pdf", F.greatest(F.lit(0), F.col("target") - F.coalesce("have", F.lit(0))).alias("room"))
    more = fill.withColumn("k", F.row_number().over(Window.partitionBy("pdf").orderBy("n"))).join(room, "pdf").where(F.col("k") <= F.col("room")).drop("k", "room")
    out = done.unionByName(more.withColumn("part", F.lit(len(parts))))
    # Question sets are small by their targets; their numbers need one order.
    return out.withColumn("qa_id", F.format_string("qa-%04d", F.row_number().over(Window.orderBy("part", "pdf", "n")))).drop("part")


def visual_support(facts: Column, question: Column, answer: Column, summary: Column, *, stop_words: tuple[str, ...] = (), limit: int = 520) -> Column:
    """The facts of a card that share two terms, a number or an identifier with a question and its answer.

    Without such a fact it is the page's summary, else all facts.
    """
    query = F.lower(F.concat_ws(" ", question, answer))
    terms = F.array_except(F.array_distinct(F.regexp_extract_all(query, F.lit(r"[a-zA-Z][a-zA-Z0-9-]{2,}|[0-9]+(?:\.[0-9]+)?"), F.lit(0))), F.array(*map(F.lit, stop_words)).cast("array<string>"))

    def shared(fact: Column) -> Column:
        own = F.filter(terms, lambda t: F.contains(F.lower(fact), t))
        sure = F.exists(own, lambda t: t.rlike(r"^[0-9]+(?:\.[0-9]+)?$") | (t.rlike("[a-z]") & t.rlike("[0-9]")))
        return (F.size(own) >= 2) | sure

    chosen = F.filter(facts, shared)
    none = F.coalesce(F.nullif(summary, F.lit("")), F.array_join(facts, " "))
    return X.snippet(F.when(F.size(chosen) > 0, F.array_join(chosen, " ")).otherwise(none), limit)
