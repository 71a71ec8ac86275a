"""Sequence packing: Karmarkar-Karp multiway differencing of document pieces."""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ranges, slices, words_le

SEQUENCE_TOKENS = 1024
#: Windows that one run of differencing fills.
BUCKET_WINDOWS = 128
#: Where the rest of a document, after its whole windows, is cut; smaller pieces even out windows better.
CUTS = (256, 128, 64, 32, 16)
#: Distinct pieces of text whose ids a worker remembers, some 200 bytes each with what the tokenizer keeps.
CACHE_ENTRIES = 1_000_000
_SLICE = 1 << 20


def difference(sizes: list[int], ways: int) -> list[list[int]]:
    """Karmarkar-Karp differencing: items of these sizes in ways parts with near-equal sums.

    A partial partition is a list of (sum, items) in falling order of sum, less what all its parts
    have in common. The two whose sums spread most are merged with opposing imbalances, largest part
    with smallest, until one is left.
    """
    if not sizes:
        return [[] for _ in range(ways)]
    if ways == 1:
        return [list(range(len(sizes)))]
    # Parts that hold nothing stay implicit: sums has only the leading non-zero ones.
    heap = [(-s, i, [s], [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a, pa_ = heapq.heappop(heap)
        _, _, b, pb = heapq.heappop(heap)
        # Largest meets smallest: what b has goes to a's empty parts first, its rest to a's smallest.
        over = max(0, len(a) + len(b) - ways)
        k, free = len(a) - over, len(b) - over
        sums = a[:k] + [x + y for x, y in zip(a[k:], reversed(b[free:]), strict=True)] + b[:free]
        parts = pa_[:k] + [x + y for x, y in zip(pa_[k:], reversed(pb[free:]), strict=True)] + pb[:free]
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        least = sums[order[-1]] if len(sums) == ways else 0
        sums, parts = [sums[i] - least for i in order], [parts[i] for i in order]
        heapq.heappush(heap, (-sums[0], n, sums, parts))
        n += 1
    parts = heap[0][3]
    return parts + [[] for _ in range(ways - len(parts))]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most capacity: their number rises as long as one is too full."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = difference(sizes, ways)
        if max(sum(sizes[i] for i in p) for p in parts) <= capacity:
            return [p for p in parts if p]
        ways += 1


class Encoder:
    """Token ids of many texts at once, by a byte-level BPE file of the tokenizers library.

    Such a tokenizer never joins what stands before a blank with the blank, so texts fall into pieces
    at each blank after an ASCII character that is none, and at punctuation after an ASCII letter. The
    tokenizer sees each distinct piece once; pieces of up to 32 bytes are remembered in sorted arrays.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.entries = entries
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of each token, whose string has a character for each byte.
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.widths[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        #: Codes of the known pieces, sorted; their bytes as four words; where their ids are in flat.
        self.codes, self.words = np.zeros(0, np.uint64), np.zeros((0, 4), np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each), by the tokenizer."""
        sizes = np.zeros(len(pieces), np.int64)
        parts: list[np.ndarray | None] = [None] * len(pieces)
        # What starts with a blank and ends with another ASCII character can be joined: ids do not cross.
        joint = [i for i, p in enumerate(pieces) if p[0] <= 32 and 32 < p[-1] < 127]
        alone = set(range(len(pieces))).difference(joint)
        for lo in range(0, len(joint), 512):
            own = joint[lo : lo + 512]
            ids = np.array(self.tokenizer.encode(b"".join(pieces[i] for i in own).decode(), add_special_tokens=False).ids, np.uint32)
            at = np.concatenate([[0], np.cumsum(self.widths[ids])])
            cuts = np.cumsum([0] + [len(pieces[i]) for i in own])
            edges = np.searchsorted(at, cuts)
            if at[-1] != cuts[-1] or (at[edges] != cuts).any():  # not a byte-level vocabulary
                alone.update(own)
                continue
            for i, a, b in zip(own, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                parts[i] = ids[a:b]
        rest = sorted(alone)
        for lo in range(0, len(rest), 1024):
            own = rest[lo : lo + 1024]
            for i, e in zip(own, self.tokenizer.encode_batch_fast([pieces[i].decode() for i in own], add_special_tokens=False), strict=True):
                parts[i] = np.array(e.ids, np.uint32)
        sizes[:] = [len(p) for p in parts]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), sizes

    def _keep(self, ids: np.ndarray) -> int:
        """Where the ids are in flat from now on."""
        n = len(self.flat)
        self.flat = np.concatenate([self.flat, ids])
        return n

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); raw holds the texts, at their n + 1 offsets."""
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        solid = (raw > 32) & (raw < 127)
        cut = np.zeros(len(raw), bool)
        cut[1:] = blank[1:] & solid[:-1]
        # After a two-byte letter of U+00C0 to U+07FF, too: no white space is there.
        cut[2:] |= blank[2:] & (raw[1:-1] >= 128) & (raw[1:-1] < 192) & (raw[:-2] >= 0xC3) & (raw[:-2] < 0xE0)
        # Words end before ASCII punctuation, but for what contractions and special tokens hold.
        letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
        point = solid & ~letter & ((raw < 48) | (raw > 57)) & (raw != 39) & (raw != 124)
        cut[1:] |= point[1:] & letter[:-1]
        cut[at[:-1][np.diff(at) > 0]] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.append(starts, len(raw)))
        if len(self.codes) > self.entries or len(self.flat) > 6 * self.entries:
            self._forget()
        data = raw.tobytes()
        begin, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        short = lengths <= 32
        if short.any():
            begin[short], size[short] = self._known(data, words_le(raw), starts[short], lengths[short])
        if not short.all():
            ids, own = self._ids([data[s : s + n] for s, n in zip(starts[~short].tolist(), lengths[~short].tolist(), strict=True)])
            begin[~short], size[~short] = self._keep(ids) + np.cumsum(own) - own, own
        of = np.searchsorted(at, starts, "right") - 1
        return self.flat[ranges(begin, size)], np.bincount(of, size, len(at) - 1).astype(np.int64)

    def _known(self, data: bytes, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in flat, number of ids) of pieces of up to 32 bytes, looked up or learned."""
        mask = np.append((np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1), np.uint64(2**64 - 1))
        held = np.stack([words[np.minimum(starts + 8 * k, len(words) - 1)] & mask[np.clip(lengths - 8 * k, 0, 8)] for k in range(4)], axis=1)
        with np.errstate(over="ignore"):
            code = lengths.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
            for k in range(4):
                code = (code ^ held[:, k]) * np.uint64(0x9E3779B185EBCA87)
                code ^= code >> np.uint64(32)
        codes, first, back = np.unique(code, return_index=True, return_inverse=True)
        if (held[first][back] != held).any() or (lengths[first][back] != lengths).any():
            # Two pieces of one code: each goes by itself this once.
            ids, own = self._ids([data[s : s + n] for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)])
            return self._keep(ids) + np.cumsum(own) - own, own
        place = np.searchsorted(self.codes, codes)
        there = np.minimum(place, max(0, len(self.codes) - 1))
        taken = self.codes[there] == codes if len(self.codes) else np.zeros(len(codes), bool)
        hit = taken.copy()
        hit[taken] = (self.words[there[taken]] == held[first[taken]]).all(axis=1)
        begin, size = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        begin[hit], size[hit] = self.begin[there[hit]], self.size[there[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            at = first[new]
            ids, own = self._ids([data[s : s + n] for s, n in zip(starts[at].tolist(), lengths[at].tolist(), strict=True)])
            begin[new], size[new] = self._keep(ids) + np.cumsum(own) - own, own
            learn = new[~taken[new]]
            self.codes = np.insert(self.codes, place[learn], codes[learn])
            self.words = np.insert(self.words, place[learn], held[first[learn]], axis=0)
            self.begin, self.size = np.insert(self.begin, place[learn], begin[learn]), np.insert(self.size, place[learn], size[learn])
        return begin[back], size[back]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """The encoder of a worker process, which its tasks share."""
    return Encoder(path)


def _rest(length: int) -> list[int]:
    """Lengths of the pieces of what is left after whole windows."""
    out = []
    for size in CUTS:
        n = (length - 1) // size
        out += [size] * n
        length -= size * n
    return [*out, length]


class _Bucket:
    """Pieces that wait for a run of differencing."""

    def __init__(self, capacity: int, number: Iterator[int]):
        self.capacity, self.number = capacity, number
        self.rows: list[tuple] = []
        self.sizes: list[int] = []
        self.total = 0

    def add(self, row: tuple, size: int) -> None:
        self.rows.append(row)
        self.sizes.append(size)
        self.total += size

    def flush(self) -> Iterator[tuple]:
        for part in pack(self.sizes, self.capacity) if self.sizes else []:
            sequence, offset = next(self.number), 0
            for i in sorted(part):
                yield (*self.rows[i], sequence, offset)
                offset += self.sizes[i]
        self.rows, self.sizes, self.total = [], [], 0


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = SEQUENCE_TOKENS, end_id: int = 0, bucket_windows: int = BUCKET_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row for each piece.

    A document is its ids by the tokenizers file at path tokenizer (the same on all executors), without
    special tokens, then end_id; a null or empty text is end_id alone. Whole windows of capacity ids
    are sequences of their own; the rest of each document is cut and Karmarkar-Karp differencing
    spreads bucket_windows windows' worth of pieces over near-equal windows, one more as long as one
    is over capacity. A repeated row is a document like others; null ids pass through; an empty table
    has no piece.

    Each task packs its own rows as a stream, without a shuffle and with one bucket in memory; a
    sequence_id is the task's partition number and a counter, so that a repeated task gives the same.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        number = iter(range(first, first + (1 << 40)))
        encoder = _encoder(tokenizer)
        bucket = _Bucket(capacity, number)
        rows: list[tuple] = []
        id_type = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        for batch in batches:
            id_type = batch.column(0).type
            keys = batch.column(0).to_pylist()
            for lo, hi, raw, at in slices(batch.column(1), _SLICE):
                ids, counts = encoder.encode(raw, at)
                ends = np.cumsum(counts)
                for d in range(hi - lo):
                    own = np.append(ids[ends[d] - counts[d] : ends[d]], np.uint32(end_id)).astype("<u4")
                    total, start = len(own), 0
                    sizes = [capacity] * (total // capacity)
                    if total % capacity:
                        sizes += _rest(total % capacity)
                    for size in sizes:
                        row = (keys[lo + d], start, size, zlib.crc32(own[start : start + size].tobytes()), total)
                        if size == capacity:
                            rows.append((*row, next(number), 0))
                        else:
                            bucket.add(row, size)
                        start += size
                    if bucket.total >= bucket_windows * capacity:
                        rows += bucket.flush()
                    if len(rows) > 20_000:
                        yield batch_of(rows)
                        rows = []
        rows += bucket.flush()
        if rows:
            yield batch_of(rows)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
