"""SimHash near-dedup by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import SLICE_BYTES, broadcast_if_few, materialize, ranges, words_le

SHINGLE_WORDS = 3
RADIUS = 3

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: For each byte, its eight bits as eight bytes of one word, lowest bit first.
_SPREAD = np.array([sum(((v >> i) & 1) << (8 * i) for i in range(8)) for v in range(256)], np.uint64)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many pieces of raw at once, as unsigned 64-bit integers."""
    words, seed64 = words_le(raw), np.uint64(seed)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    with np.errstate(over="ignore"):
        n = lengths.astype(np.uint64)
        h = np.full(len(starts), seed64 + _P5, np.uint64)
        at = starts.astype(np.int64).copy()
        left = lengths.astype(np.int64).copy()
        if len(long := np.flatnonzero(left >= 32)):
            v = [np.full(len(long), x, np.uint64) for x in (seed64 + _P1 + _P2, seed64 + _P2, seed64, seed64 - _P1)]
            live = np.arange(len(long))
            while len(live):
                for k in range(4):
                    v[k][live] = _round(v[k][live], words[at[long[live]] + 8 * k])
                at[long[live]] += 32
                left[long[live]] -= 32
                live = live[left[long[live]] >= 32]
            merged = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                merged = (merged ^ _round(np.uint64(0), x)) * _P1 + _P4
            h[long] = merged
        h += n
        live = np.flatnonzero(left >= 8)
        while len(live):
            h[live] = _rotl(h[live] ^ _round(np.uint64(0), words[at[live]]), 27) * _P1 + _P4
            at[live] += 8
            left[live] -= 8
            live = live[left[live] >= 8]
        live = np.flatnonzero(left >= 4)
        h[live] = _rotl(h[live] ^ ((words[at[live]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        at[live] += 4
        left[live] -= 4
        live = np.flatnonzero(left > 0)
        while len(live):
            h[live] = _rotl(h[live] ^ (padded[at[live]].astype(np.uint64) * _P5), 11) * _P1
            at[live] += 1
            left[live] -= 1
            live = live[left[live] > 0]
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def _bit_counts(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set among the hashes of each document; counts: hashes of each."""
    out = np.zeros((len(counts), 64), np.int64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    # Blocks of at most 255 hashes, so that eight counters fit in one word without a carry.
    blocks = -(-counts[some] // 255)
    first = np.cumsum(counts[some]) - counts[some]
    starts = np.repeat(first, blocks) + 255 * ranges(np.zeros(len(some), np.int64), blocks)
    owner = np.cumsum(blocks) - blocks
    for byte, column in enumerate(h.view(np.uint8).reshape(-1, 8).T):
        sums = np.add.reduceat(_SPREAD[column], starts).view(np.uint8).reshape(-1, 8)
        out[some, 8 * byte : 8 * byte + 8] = np.add.reduceat(sums, owner, axis=0, dtype=np.int64)
    return out


class _Counter:
    """Bit counts of documents, gathered over pieces of bounded size."""

    def __init__(self, shingle_words: int):
        self.k = shingle_words

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(bit counts, number of shingles) of each text; texts are lower-cased, blanks single spaces."""
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        gaps = np.flatnonzero(raw == 32)
        starts = np.concatenate([[0], gaps[:-1] + 1]).astype(np.int64)
        kept = starts < gaps  # an empty text is a gap without a word
        starts, stops = starts[kept], gaps[kept]
        of = np.searchsorted(ends, stops, "left")
        n_words = np.bincount(of, minlength=len(texts))
        n = np.where(n_words >= self.k, n_words - self.k + 1, np.minimum(n_words, 1))
        first = ranges(np.cumsum(n_words) - n_words, n)
        last = first + np.repeat(np.minimum(n_words, self.k), n) - 1
        return _bit_counts(xxh64(raw, starts[first], stops[last] - starts[first]), n), n


def _pieces(text: bytes, k: int, most: int) -> Iterator[bytes]:
    """A long text in pieces that overlap by k - 1 words, so that each shingle is in exactly one."""
    at = 0
    while len(text) - at > most:
        cut = text.find(b" ", at + most)
        if cut < 0:
            break
        back = cut
        for _ in range(k - 1):
            back = text.rfind(b" ", at, back)
        if back <= at:
            break
        yield text[at:cut]
        at = back + 1
    yield text[at:]


def fingerprints(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the SimHash of each row as a signed 64-bit integer. See near_duplicates()."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(shingle_words)
        for batch in batches:
            fps = np.zeros(batch.num_rows, np.uint64)

            def put(rows: list[int], counts: np.ndarray, n: np.ndarray) -> None:
                bits = counts * 2 > n[:, None]
                fps[rows] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]

            rows: list[int] = []
            texts: list[bytes] = []
            size = 0
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                words = b" ".join((text.as_py() or b"").lower().split())
                if len(words) > 4 * SLICE_BYTES:
                    got = [counter.counts([p]) for p in _pieces(words, shingle_words, SLICE_BYTES)]
                    put([i], sum(c for c, _ in got), sum(n for _, n in got))
                    continue
                rows.append(i)
                texts.append(words)
                size += len(words)
                if size > SLICE_BYTES:
                    put(rows, *counter.counts(texts))
                    rows, texts, size = [], [], 0
            if rows:
                put(rows, *counter.counts(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, fp long")


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """2^(radius+1) - 1 masks over the given bits such that any radius bits are all outside one mask.

    Bit i gets a non-zero vector of radius + 1 bits; mask v holds the bits whose vector has an odd
    inner product with v. Any radius vectors span less than the whole space, so some non-zero v is
    orthogonal to all of them: two words that differ in at most radius bits agree under that mask.
    """
    n = 2 ** (radius + 1) - 1
    vectors = [(j % n) + 1 for j in range(len(bits))]
    return [sum(1 << b for b, x in zip(bits, vectors, strict=True) if (x & v).bit_count() & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _star(fps: np.ndarray, radius: int, most: int = 1024) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what is linked among distinct fps, each to the smallest of its piece.

    A large group is split again by covering masks over the bits that vary in it, which keeps each
    linked pair together in some part; few varying bits allow few distinct words, so parts end small.
    """
    if len(fps) < 2:
        return []
    if len(fps) > most:
        vary = int(np.bitwise_or.reduce(fps ^ fps[0]))
        bits = [b for b in range(64) if vary >> b & 1]
        masks = covering_masks(bits, radius)
        if 0 in masks:
            return _pairs(fps, radius)
        out = []
        for mask in masks:
            key = fps & np.uint64(mask)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for part in np.split(fps[order], cuts):
                out += _star(part, radius, most)
        return out
    return _pairs(fps, radius)


def _pairs(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Breadth-first over the group in blocks of memory linear in it; returns star edges."""
    out, rest = [], np.sort(fps.view(np.int64)).view(np.uint64)
    while len(rest) > 1:
        root, rest = rest[:1], rest[1:]
        front, piece = root, []
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for x in front:
                near |= np.bitwise_count(rest ^ x) <= radius
            front, rest = rest[near], rest[~near]
            piece.append(front)
        found = np.concatenate(piece) if piece else front[:0]
        if len(found):
            out.append((np.full(len(found), root[0]), found))
    return out


def links(classes: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """(a, b): edges among the distinct fps of classes that connect exactly what radius links.

    classes has a distinct column fp. Each fp goes to one row for each mask (15 at radius 3) under
    the key fp & mask; rows are dealt and sorted by that key, and each task reads its groups as a
    stream and emits star edges, at most one for each row of a group.
    """
    masks = [_signed(m) for m in covering_masks(list(range(64)), radius)]
    keyed = classes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("mask", "key"))
    dealt = keyed.repartition("mask", "key").sortWithinPartitions("mask", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def groups(table: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            mask, key, fp = table
            cuts = np.flatnonzero((np.diff(mask) != 0) | (np.diff(key) != 0)) + 1
            edges = np.concatenate([[0], cuts, [len(fp)]])
            some = np.flatnonzero(np.diff(edges) > 1)
            pairs = [e for i in some for e in _star(fp[edges[i] : edges[i + 1]].view(np.uint64), radius)]
            if pairs:
                a, b = (np.concatenate([p[k] for p in pairs]).view(np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 0)]
            table = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if not len(table[0]):
                continue
            last = (table[0] == table[0][-1]) & (table[1] == table[1][-1])
            cut = len(last) - int(last.sum())
            held = [x[cut:] for x in table]
            if cut:
                yield from groups([x[:cut] for x in table])
        if len(held[0]):
            yield from groups(held)

    return dealt.select("fp", "mask", "key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs.

    Text is lower-cased in A-Z and split at ASCII white space; shingles are shingle_words words joined
    by a space, repeats included (fewer words: all of them; none, as in null or blank texts: the
    fingerprint is zero and linked like any other). A bit is set if it is set in over half of the
    shingles' XXH64 (seed 42). Rows link at radius or fewer differing bits; component_id is the
    smallest id reachable. Repeated rows are rows like others; a null id is never a component_id
    unless all of a component are null. An empty table gives an empty result.

    Only distinct fingerprints are compared, so exact copies cost one row. Covering masks guarantee
    that each pair within the radius meets in some bucket; fingerprints, links and components stay
    in tables in the shared folder.
    """
    fps = materialize(fingerprints(docs, shingle_words=shingle_words, id_col=id_col, text_col=text_col), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct-fingerprints")
    roots = connected_components(links(classes.select("fp"), radius=radius))
    linked = classes.join(roots, classes["fp"] == roots["node"]).select("fp", "root", "first_id")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = linked.join(least, "root").select(F.col("fp").alias("__fp"), "component_id")
    whole = classes.join(linked, classes["fp"] == linked["__fp"], "left").select(F.col("fp").alias("__fp"), F.coalesce("component_id", "first_id").alias("component_id"))
    whole = materialize(whole, "classes")
    return _spread(fps, whole, classes).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: A fingerprint that more than this share of all rows has is dealt out in pieces of at most that share.
HOT_SHARE = 256


def _spread(fps: DataFrame, whole: DataFrame, classes: DataFrame) -> DataFrame:
    """fps with the component of their class. Rows of a hot fingerprint, of which there are at most HOT_SHARE,
    go to as many pieces of its key as keep each below its share of all rows."""
    total = classes.agg(F.sum("n")).first()[0] or 0
    hot = classes.where(F.col("n") * HOT_SHARE > total).select("fp", F.ceil(F.col("n") * HOT_SHARE / max(1, total)).cast("int").alias("pieces")).collect()
    pieces = lambda fp: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for r in hot for x in r]), fp), F.lit(1)) if hot else F.lit(1)
    left = fps.withColumn("__piece", F.pmod(F.xxhash64("doc_id", F.lit(1)), pieces(F.col("fp"))).cast("int"))
    right = whole.withColumn("__piece", F.explode(F.sequence(F.lit(0), pieces(F.col("__fp")) - 1)))
    return left.join(right, (left["fp"] == right["__fp"]) & (left["__piece"] == right["__piece"]))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs whose id is the smallest of their component; rows with that id all stay.

    Null and blank texts are one component, as they have one fingerprint. Rows with a null id stay if
    their whole component has none. The ids that go are joined without moving the texts as long as they are few.
    """
    found = near_duplicates(docs, id_col=id_col, **options)
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = found.groupBy("doc_id").agg(F.bool_or(first).alias("stays")).where("NOT stays").select(F.col("doc_id").alias("__gone"))
    gone = broadcast_if_few(materialize(gone, "near-copies"))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__gone"]), "left_anti")
