"""Benchmark decontamination by winnowing: fingerprints of both sides are joined, hits are extended.

A window of the benchmark is window consecutive words. On both sides the least hash of each
window - gram + 1 consecutive grams is kept, so a window that a document and an item share has a kept gram
in common, at the same place in it. A kept gram goes on with the words around it that such windows can
reach; where two meet, the words themselves are compared, outwards from the gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SLICE_BYTES, broadcast_if_few, materialize, slices, text_print

WINDOW_WORDS = 10
GRAM_WORDS = 5
#: Bits of the filter of the benchmark's fingerprints that goes to the executors: 16 for each, within these bounds.
#: A larger benchmark only fills it more, so that more of the documents' fingerprints go to the join.
FILTER_BITS = (1 << 16, 1 << 27)

#: Word bytes, lower-cased A-Z: 0-9, a-z and all bytes of non-ASCII code points.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True

_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.ones(1, np.uint64)
        step = np.uint64(base)
        while len(out) < n:
            out = np.concatenate([out, out * step])
            step = step * step
        return out[:n]


_BYTE_POWERS = _powers(_B1, 1 << 12)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * _MIX
        return h ^ (h >> np.uint64(29))


def split_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends) of the words of raw."""
    raw = _LOWER[raw]
    edge = np.diff(np.concatenate([[False], _WORD[raw], [False]]).view(np.int8))
    return raw, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: equal words have equal hashes; equality is checked where it counts."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    is_word = _WORD[raw]
    within = np.arange(len(raw))[is_word] - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        terms = (raw[is_word].astype(np.uint64) + np.uint64(1)) * _BYTE_POWERS[within % len(_BYTE_POWERS)]
        return _mix(np.add.reduceat(terms, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of n consecutive words from each word; the last n - 1 have none."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(m, np.uint64)
        for i in range(n):
            h = h * np.uint64(_B2) + words[i : i + m]
        return _mix(h)


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions of the rightmost minimum of each window of width hashes, each once."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    m = len(hashes) - width + 1
    least, at = hashes[:m].copy(), np.arange(m)
    for i in range(1, width):
        other = hashes[i : i + m]
        take = other <= least
        least = np.where(take, other, least)
        at = np.where(take, np.arange(i, i + m), at)
    return np.unique(at)


def short_grams(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the items of n words that are too short for a window, apart from that of longer ones' grams."""
    return _mix(grams(words, n) + np.uint64(n))


def filter_places(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each fingerprint in a filter of so many bits, a power of two."""
    with np.errstate(over="ignore"):
        return prints & np.uint64(bits - 1), (prints * np.uint64(_B1)) >> np.uint64(64 - (bits - 1).bit_length())


@dataclass
class Filter:
    """Which fingerprints may be the benchmark's, and of what lengths its short items are."""

    words: np.ndarray
    short: list[int]

    def maybe(self, prints: np.ndarray) -> np.ndarray:
        bits = 64 * len(self.words)
        out = np.ones(len(prints), bool)
        for place in filter_places(prints, bits):
            out &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0
        return out


class _Words:
    """The words of a run of documents, as bytes and as hashes."""

    def __init__(self, raw: np.ndarray):
        raw, self.starts, self.ends = split_words(raw)
        self.hashes = word_hashes(raw, self.starts, self.ends)
        self.data = raw.tobytes()

    def words(self, lo: int, hi: int) -> list[str]:
        return [self.data[s:e].decode(errors="replace") for s, e in zip(self.starts[lo:hi].tolist(), self.ends[lo:hi].tolist(), strict=True)]


def kept_grams(text: _Words, bounds: np.ndarray, window: int, gram: int, short: list[int], known: Filter | None) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, fingerprint, place, words before, words from there on) of the grams that are kept.

    bounds: first word of each document and the end. Of a short length all places are kept.
    """
    last = bounds[1:]
    if len(last):
        lengths = [(n, short_grams(text.hashes, n), None) for n in short]
        g = grams(text.hashes, gram)
        # Windows over the border of two documents may add places, never take one: each window within
        # a document chooses by itself.
        for n, prints, at in [(0, g, winnow(g, window - gram + 1)), *lengths]:
            at = np.arange(len(prints)) if at is None else at
            if known is not None:
                at = at[known.maybe(prints[at])]
            owner = np.searchsorted(last, at, "right")
            ok = at + (n or gram) <= last[np.minimum(owner, len(last) - 1)]
            for p, d in zip(at[ok].tolist(), owner[ok].tolist(), strict=True):
                if n:
                    yield d, int(prints[p].view(np.int64)), p, 0, n
                else:
                    before = min(window - gram, p - int(bounds[d]))
                    yield d, int(prints[p].view(np.int64)), p, before, min(window, int(last[d]) - p)


def _cuts(raw: np.ndarray, window: int, slice_bytes: int) -> Iterator[tuple[np.ndarray, int]]:
    """A long text in pieces (bytes, words that the piece before had already): window - 1 words overlap."""
    at, again = 0, 0
    while len(raw) - at > 2 * slice_bytes:
        cut = at + slice_bytes
        gap = np.flatnonzero(~_WORD[raw[cut : cut + slice_bytes]])
        if not len(gap):
            break
        cut += int(gap[0])
        yield raw[at:cut], again
        _, starts, _ = split_words(raw[at:cut])
        back = min(window - 1, len(starts))
        at, again = (at + int(starts[len(starts) - back]) if back else cut), back
    yield raw[at:], again


_GRAM = pa.struct([("print", pa.int64()), ("place", pa.int64()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])


def _with_grams(rows: DataFrame, window: int, gram: int, short: list[int] | None, known=None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """rows (id, text, ...) with the text replaced by n_words and grams: an array of kept grams.

    before holds the words before the gram, nearest first, after those from its first word on. known is a
    broadcast filter; without it the rows are an item each, and their own length is the only short one.
    """
    names = [c for c in rows.columns if c != "text"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    place = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = known.value if known is not None else None
        for batch in batches:
            n_words, found = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]

            def keep(text: _Words, bounds: np.ndarray, row: int, base: int | None) -> None:
                lengths = want.short if want is not None else [len(text.hashes)] if 0 < len(text.hashes) < window else []
                for d, print_, p, before, after in kept_grams(text, bounds, window, gram, lengths, want):
                    at = p - int(bounds[d]) if base is None else p + base
                    found[row + d].append({"print": print_, "place": at, "before": text.words(p - before, p)[::-1], "after": text.words(p, p + after)})

            for lo, hi, raw, at in slices(batch.column(place), slice_bytes if want is not None else 1):
                if hi - lo == 1 and len(raw) > 4 * slice_bytes:
                    base = 0
                    for piece, again in _cuts(raw, window, slice_bytes):
                        text = _Words(piece)
                        keep(text, np.array([0, len(text.starts)]), lo, base - again)
                        base += len(text.starts) - again
                    n_words[lo] = base
                    continue
                # A zero byte after each document keeps its last word apart from the next one's first.
                spaced = np.zeros(len(raw) + hi - lo, np.uint8)
                spaced[np.arange(len(raw)) + np.repeat(np.arange(hi - lo), np.diff(at))] = raw
                text = _Words(spaced)
                bounds = np.searchsorted(text.starts, at + np.arange(hi - lo + 1))
                n_words[lo:hi] = np.diff(bounds)
                keep(text, bounds, lo, None)
            columns = [c for i, c in enumerate(batch.columns) if i != place]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words), pa.array(found, pa.list_(_GRAM))], [*names, "n_words", "grams"])

    return rows.mapInArrow(run, f"{kinds}, n_words long, grams array<struct<print:long,place:long,before:array<string>,after:array<string>>>")


def _filter(prints: DataFrame, lengths: list[int]) -> Filter:
    """The filter of a table of distinct fingerprints, of a size between the bounds of FILTER_BITS."""
    least, most = FILTER_BITS
    n = prints.count()
    bits = min(most, max(least, 1 << (16 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            place = np.unique(np.concatenate(filter_places(own, bits)))
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], ["word", "bits"])

    rows = prints.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    words = np.zeros(bits // 64, np.uint64)
    # At most bits / 64 rows.
    table = rows.toArrow()
    words[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return Filter(words, lengths)


def _alike(a: str, b: str) -> Column:
    """How many words two arrays have in common from their start on."""
    differ = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    first = F.array_position(differ, F.lit(True))
    return F.when(first > 0, first - 1).otherwise(F.size(differ)).cast("long")


def _covered(runs: Column) -> Column:
    """How many words sorted runs (begin, end) cover."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    step = lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), r["end"] - F.greatest(r["begin"], a["reach"]))).alias("n"), F.greatest(a["reach"], r["end"]).alias("reach"))
    return F.aggregate(runs, start, step, lambda a: a["n"])


def find_overlap(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS, slice_bytes: int = SLICE_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each row of docs.

    Words are runs of 0-9, a-z and non-ASCII code points after A-Z is lower-cased. A window is window
    consecutive words of an item; an item of fewer words, but some, is one window. A document word in
    any occurrence of a window is hit; n_items counts the ids of items with occurring windows and
    items_sha256 is the SHA-256 of those ids, sorted as strings, joined by commas. Null or empty texts
    have no words; items without id are left out; repeated items count once, repeated rows of docs are
    rows like others; an empty benchmark hits nothing.

    The documents are read once. A filter of bounded size holds back nearly all fingerprints that the
    benchmark does not have; the others are joined with its fingerprints by a shuffle, whatever its size.
    Items of the same words are one class, and a class has each pair of fingerprint and surrounding words
    once, so repeated words cost no more than others.
    """
    return _overlap(docs, benchmark, window, gram, slice_bytes, id_col, text_col, item_col, item_text_col)[0]


def _overlap(docs: DataFrame, benchmark: DataFrame, window: int, gram: int, slice_bytes: int, id_col: str, text_col: str, item_col: str, item_text_col: str, keep: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """find_overlap() with the columns keep, and of the rows that are hit those only."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text")).dropna()
    items = items.groupBy("text").agg(F.collect_set("item_id").alias("ids")).withColumn("class", F.sha2("text", 256))
    items = materialize(_with_grams(items.select("class", "ids", "text"), window, gram, None), "items")
    kept = items.select("class", (F.col("n_words") < window).alias("whole"), F.explode("grams").alias("g")).select("class", "whole", F.col("g.print").alias("print"), F.col("g.before").alias("b"), F.col("g.after").alias("a")).distinct()
    kept = materialize(kept, "benchmark-prints")
    lengths = sorted(r[0] for r in items.where(F.col("n_words").between(1, window - 1)).select("n_words").distinct().collect())
    known = docs.sparkSession.sparkContext.broadcast(_filter(kept.select("print").distinct(), lengths))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), *(keep or []), F.col(text_col).alias("text"))
    found = materialize(_with_grams(rows, window, gram, None, known, slice_bytes), "document-prints")
    met = found.select("row", F.explode("grams").alias("g")).select("row", F.col("g.print").alias("print"), F.col("g.place").alias("place"), F.col("g.before").alias("before"), F.col("g.after").alias("after")).join(kept, "print")
    met = met.withColumns({"left": F.when(F.col("whole"), 0).otherwise(_alike("before", "b")), "right": _alike("after", "a")})
    runs = met.where(F.when(F.col("whole"), F.col("right") == F.size("a")).otherwise(F.col("left") + F.col("right") >= window))
    runs = materialize(runs.select("row", "class", (F.col("place") - F.col("left")).alias("begin"), (F.col("place") + F.col("right")).alias("end")).distinct(), "hits")
    words = runs.groupBy("row").agg(_covered(F.array_sort(F.collect_set(F.struct("begin", "end")))).alias("n_hit"))
    ids = runs.select("row", "class").distinct().join(items.select("class", "ids"), "class").groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    hit = words.join(ids, "row")
    out = found.drop("grams").join(hit, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.greatest(F.lit(0), F.coalesce(F.size("ids"), F.lit(0))).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
    return out, found.drop("grams", "n_words").join(runs.select("row").distinct(), "row", "left_semi").drop("row")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS, slice_bytes: int = SLICE_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs without a hit word, with all their columns; see find_overlap().

    A row goes by its own text: rows with the id of a contaminated one and another text stay, as do
    null and empty texts. Only ids and hashes of the texts that go are joined, without moving the
    texts as long as these are few.
    """
    marks = text_print(text_col)
    _, hit = _overlap(docs, benchmark, window, gram, slice_bytes, id_col, text_col, item_col, item_text_col, [m.alias(f"__m{i}") for i, m in enumerate(marks)])
    hit = broadcast_if_few(materialize(hit.select(F.col("doc_id").alias("__hit"), "__m0", "__m1").distinct(), "contaminated"))
    match = docs[id_col].eqNullSafe(hit["__hit"]) & (marks[0] == hit["__m0"]) & (marks[1] == hit["__m1"])
    return docs.join(hit, match, "left_anti")
