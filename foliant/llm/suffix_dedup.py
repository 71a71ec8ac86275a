"""Suffix dedup: remove byte strings that an earlier document has, by a distributed merge sort of suffixes.

A window is a string of `width` bytes. Each window has one anchor: of the grams of GRAM bytes in it, the
one of the smallest hash (the first of equals), so equal windows have the same anchor at the same place.
Windows next to each other that share an anchor make one span. The suffixes that are sorted are those of
spans, from the anchor on; what stands before the anchor goes along. They are sorted by the code of the
anchor (a hash), then by their bytes, so ranges of codes are even buckets without looking at the data.

1. Documents are dealt into parts. Each part sends the codes of its anchors; a code that only one
   document has cannot lie in a shared window.
2. Each part sorts the suffixes of its spans with shared codes, equal ones once: a front-coded run.
3. Runs are exchanged and merged in rounds (Levels): a round merges at most `fan` runs of one range of
   codes by a loser tree and cuts what comes out for the next round. A node of the tree keeps the common
   prefix of its loser with the suffix that went out last, so bytes once compared are not compared again;
   the prefixes that the tree finds are the front code of what goes on. Rows and tasks of a round grow
   with the number of parts, not its square.
4. In the last round the common prefixes decide. Windows that start d bytes before the anchor are equal
   if the suffixes share width - d bytes (a stretch of the sorted order) and the strings before the anchor
   end in the same d bytes (a stretch of their own sorted order). Of each such class the smallest
   document is the owner.
5. Owners go back the way the runs came, to the parts, where documents are rebuilt.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize, ranges, slices, utf8

WIDTH = 50
GRAM = 24
#: Bytes of text of one part of the corpus, and of one numpy step.
PART_BYTES = 8 << 20
_STEP = 1 << 19
#: Runs that one task merges at once, at most.
FAN = 16
#: An anchor with more different spans than this is hot: each of its windows is a suffix of its own.
HOT_SPANS = 1 << 18
#: Codes of anchors have so many bytes, which stand before the suffix where it is sorted.
CODE = 6
_CODES = 1 << 8 * CODE
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * _MIX
        return h ^ (h >> np.uint64(32))


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM = 24 bytes from each place, by doubling; the last GRAM - 1 places have none."""
    with np.errstate(over="ignore"):
        step, size = np.uint64(0x9E3779B97F4A7C15), 1
        h = raw.astype(np.uint64) + np.uint64(1)
        while size < 8:
            h = h[:-size] * step + h[size:]
            step, size = step * step, size * 2
        return _mixed((h[:-16] * step + h[8:-8]) * step + h[16:])


def _codes(hashes: np.ndarray) -> np.ndarray:
    """The code of hashes; two hashes of one code only cost work, never a result."""
    return hashes >> np.uint64(64 - 8 * CODE)


@dataclass
class Spans:
    """First window, number of windows, anchor, code, and a hash that tells different contents apart, of each span."""

    begins: np.ndarray
    counts: np.ndarray
    anchors: np.ndarray
    codes: np.ndarray
    kinds: np.ndarray
    hashes: np.ndarray


def find_spans(raw: np.ndarray, at: np.ndarray, width: int) -> Spans:
    """The spans of texts at the offsets at."""
    none = np.zeros(0, np.int64)
    nothing = Spans(none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64))
    if len(raw) < width:
        return nothing
    hashes = _gram_hashes(raw)
    m = len(raw) - width + 1
    # Place in the low bits, always as many: the first of equal hashes is taken, whatever else raw holds.
    low = np.uint64(4 * _STEP - 1)
    key = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    n, size = width - GRAM + 1, 1
    while size * 2 <= n:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < n:
        key = np.minimum(key[:m], key[n - size : n - size + m])
    anchor = (key[:m] & low).astype(np.int64)
    ok = np.zeros(m, bool)
    full = np.diff(at) >= width
    ok[ranges(at[:-1][full], np.diff(at)[full] - width + 1)] = True
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
    begins = np.flatnonzero(first)
    if not len(begins):
        return nothing
    ends = np.flatnonzero(ok & ~np.append(ok[1:] & ~first[1:], False)) + 1
    a = anchor[begins]
    with np.errstate(over="ignore"):
        kinds = (hashes[begins] * np.uint64(3) + hashes[ends - 1 + width - GRAM]) * np.uint64(128) + (ends - begins).astype(np.uint64)
    # The smallest of some hashes is small: mixed again, codes are even.
    return Spans(begins, ends - begins, a, _codes(_mixed(hashes[a])), kinds, hashes)


def _long_slices(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, place of the first byte in its text): long texts come in overlapping pieces."""
    for lo, _, raw, at in slices(column, _STEP):
        if len(at) == 2 and len(raw) > 4 * _STEP:
            # width - 1 more bytes, so that each window lies whole in one piece.
            for start in range(0, len(raw) - width + 1, _STEP):
                piece = raw[start : start + _STEP + width - 1]
                yield lo, piece, np.array([0, len(piece)]), start
        else:
            yield lo, raw, at, 0


def squeeze(data: bytes) -> bytes:
    return zstandard.compress(data, 3)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.decompress(data)


def small(values: np.ndarray) -> bytes:
    """Integers as differences of the least width that holds them: a digit for the width, the first, the rest."""
    step = np.diff(values)
    kind = next((k for k in ("i1", "<i2", "<i4") if not len(step) or np.abs(step).max() <= np.iinfo(k).max), "<i8")
    return squeeze(kind[-1].encode() + values[:1].astype("<i8").tobytes() + step.astype(kind).tobytes())


def unsmall(data: bytes) -> np.ndarray:
    """What small() has made."""
    data = unsqueeze(data)
    size = int(data[:1])
    return np.cumsum(np.concatenate([np.frombuffer(data[1:9], "<i8"), np.frombuffer(data[9:], f"<i{size}").astype(np.int64)])) if len(data) > 1 else np.zeros(0, np.int64)


def pack_codes(codes: np.ndarray) -> bytes:
    """Sorted codes as differences, byte place by byte place, so that places of small ones vanish."""
    step = np.diff(codes, prepend=np.uint64(0)).astype("<u8")
    return squeeze(step.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_codes(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(unsqueeze(data), np.uint8).reshape(8, -1).T).view("<u8").reshape(-1), dtype=np.uint64)


# --- the way of the exchange --------------------------------------------------------------------------


@dataclass(frozen=True)
class Levels:
    """Rounds of an exchange between parts. A node of level j has q (parts q * fan**j and on, fan**j of them)
    and c (a range of codes, one of fan**j); parts are the nodes of level 0. What node (q, c) has of the
    t-th of its fan ranges goes to node (q // fan, c * fan + t) of the next level."""

    count: int
    fan: int

    @staticmethod
    def of(parts: int, fan: int) -> Levels:
        count = 1
        while fan**count < parts:
            count += 1
        even = 1
        while even**count < parts:
            even += 1
        return Levels(count, even)

    def cuts(self, codes: np.ndarray, level: int, c: int) -> list[tuple[int, int, int]]:
        """(range of the next level, from, to) of the stretches of sorted codes that are not empty."""
        n = self.fan ** (level + 1)
        edges = np.searchsorted(codes, np.array([b * _CODES // n for b in range(c * self.fan, (c + 1) * self.fan + 1)], np.uint64))
        return [(c * self.fan + t, int(i), int(j)) for t, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if j > i]


def _exchange(rows: DataFrame, levels: Levels, meet: Callable, schema: str, verdict_schema: str, back: Callable, name: str) -> DataFrame:
    """The verdicts for the parts on rows (home, q, c, source, ...) that they have made.

    meet(level) merges the rows of a node and keeps, in home rows, what came from where; back hands a
    node's verdicts to where its rows came from. Each table goes when nothing reads it any more.
    """
    made = [rows]
    for level in range(1, levels.count):
        made.append(materialize(made[-1].where("NOT home").groupBy("q", "c").applyInArrow(meet(level), schema), f"{name}-{level}", by="home"))
        discard(made[-2], only="home=false")
    verdicts = materialize(made[-1].where("NOT home").groupBy("q", "c").applyInArrow(meet(levels.count), verdict_schema), f"{name}-verdicts")
    discard(made[-1], only="home=false")
    for level in range(levels.count - 1, 0, -1):
        home, above = made.pop(), verdicts
        verdicts = materialize(home.where("home").groupBy("q", "c").cogroup(above.groupBy("q", "c")).applyInArrow(back, verdict_schema), f"{name}-verdicts")
        discard(home, above)
    return verdicts


# --- codes of anchors ---------------------------------------------------------------------------------

_CODE_SCHEMA = "home boolean, q long, c long, source long, codes binary, many binary, spans binary, ranks binary"
_FLAG_SCHEMA = "q long, c long, digit long, flags binary"
_SHARED, _HOT = 1, 2


def _rows(schema: str, rows: list[dict]) -> pa.Table:
    """A table of dictionaries, in the columns of a schema of plain types; what a row lacks is null."""
    kinds = {"boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields})


def _code_row(c: int, q: int, source: int, codes: np.ndarray, many: np.ndarray, spans: np.ndarray) -> dict:
    return {"home": False, "q": q, "c": c, "source": source, "codes": pack_codes(codes), "many": squeeze(np.packbits(many).tobytes()), "spans": squeeze(np.minimum(spans, 0xFFFFFFFF).astype("<u4").tobytes())}


def _part_codes(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, whether several documents have it, number of different spans) of a part, sorted."""
    codes, ids, kinds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for chunk in table.combine_chunks().to_batches():
        doc_ids = chunk.column("id").to_numpy(zero_copy_only=False)
        for lo, raw, at, _ in _long_slices(chunk.column("text"), width):
            s = find_spans(raw, at, width)
            own = doc_ids[lo + np.searchsorted(at, s.begins, "right") - 1]
            order = np.lexsort((own, s.kinds, s.codes))
            c, k, d = s.codes[order], s.kinds[order], own[order]
            new = np.ones(len(c), bool)
            new[1:] = (c[1:] != c[:-1]) | (k[1:] != k[:-1]) | (d[1:] != d[:-1])
            codes.append(c[new])
            kinds.append(k[new])
            ids.append(d[new])
    codes, ids, kinds = np.concatenate(codes), np.concatenate(ids), np.concatenate(kinds)
    if not len(codes):
        return codes, np.zeros(0, bool), np.zeros(0, np.int64)
    order = np.lexsort((kinds, codes))
    codes, ids, kinds = codes[order], ids[order], kinds[order]
    new = np.concatenate([[True], codes[1:] != codes[:-1]])
    edges = np.flatnonzero(new)
    other = new.copy()
    other[1:] |= kinds[1:] != kinds[:-1]
    return codes[edges], np.maximum.reduceat(ids, edges) != np.minimum.reduceat(ids, edges), np.add.reduceat(other.astype(np.int64), edges)


def _send_codes(width: int, levels: Levels):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        codes, many, spans = _part_codes(table, width)
        rows = [_code_row(b, part // levels.fan, part, codes[i:j], many[i:j], spans[i:j]) for b, i, j in levels.cuts(codes, 0, 0)]
        return _rows(_CODE_SCHEMA, rows)

    return run


def _meet_codes(levels: Levels, hot: int):
    def at(level: int):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            q, c = (k.as_py() for k in key)
            rows = sorted(table.select(["source", "codes", "many", "spans"]).to_pylist(), key=lambda r: r["source"])
            own = [unpack_codes(r["codes"]) for r in rows]
            codes, of = np.unique(np.concatenate(own), return_inverse=True)
            # A document is in one part: what two sources have, two documents have.
            many = np.bincount(of, minlength=len(codes)) > 1
            many[of[np.concatenate([np.unpackbits(np.frombuffer(unsqueeze(r["many"]), np.uint8), count=len(x)) for r, x in zip(rows, own, strict=True)]) > 0]] = True
            spans = np.bincount(of, np.concatenate([np.frombuffer(unsqueeze(r["spans"]), "<u4") for r in rows]), len(codes))
            ranks = np.split(of, np.cumsum([len(x) for x in own])[:-1])
            if level == levels.count:
                flags = (many * _SHARED | (many & (spans > hot)) * _HOT).astype(np.uint8)
                return _rows(_FLAG_SCHEMA, [{"q": r["source"], "c": c // levels.fan, "digit": c, "flags": squeeze(flags[x].tobytes())} for r, x in zip(rows, ranks, strict=True)])
            out = [_code_row(b, q // levels.fan, q, codes[i:j], many[i:j], spans[i:j]) for b, i, j in levels.cuts(codes, level, c)]
            return _rows(_CODE_SCHEMA, out + [{"home": True, "q": q, "c": c, "source": r["source"], "ranks": small(x)} for r, x in zip(rows, ranks, strict=True)])

        return run

    return at


def _joined_flags(table: pa.Table) -> np.ndarray:
    rows = sorted(table.select(["digit", "flags"]).to_pylist(), key=lambda r: r["digit"])
    return np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(unsqueeze(r["flags"]), np.uint8) for r in rows)])


def _flags_back(levels: Levels):
    def run(key: tuple, home: pa.Table, verdicts: pa.Table) -> pa.Table:
        c, flags = key[1].as_py(), _joined_flags(verdicts)
        return _rows(_FLAG_SCHEMA, [{"q": r["source"], "c": c // levels.fan, "digit": c, "flags": squeeze(flags[unsmall(r["ranks"])].tobytes())} for r in home.to_pylist()])

    return run


# --- parts -----------------------------------------------------------------------------------------------


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    """The part of the corpus of each document: a hash of its id."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _with_part(docs: DataFrame, parts: int) -> DataFrame:
    """docs (id, text) with the column q, their part, computed where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part_of(ids, parts)), *batch.columns], ["q", "id", "text"])

    return docs.mapInArrow(run, "q long, id long, text string")


# --- runs -------------------------------------------------------------------------------------------------

_RUN_SCHEMA = "home boolean, q long, c long, source long, prefix binary, length binary, rest binary, before binary, before_length binary, first binary, ranks binary, places binary, ids binary"
_VERDICT_SCHEMA = "q long, c long, digit long, counts binary, lengths binary, owners binary"


class Run:
    """A sorted run that is decoded as it is read: one key (code and suffix) and its common prefix with the one before."""

    __slots__ = ("prefix", "length", "rest", "before", "before_length", "first", "i", "place", "b_place", "key", "left")

    def __init__(self, prefix: bytes, length: bytes, rest: bytes, before: bytes, before_length: bytes, first: list[int]):
        self.prefix, self.length, self.rest, self.before, self.before_length, self.first = prefix, length, rest, before, before_length, first
        self.i, self.place, self.b_place, self.key, self.left = -1, 0, 0, b"", b""

    def next(self) -> int:
        """Go on; the common prefix with the key before, or -1 at the end."""
        self.i = i = self.i + 1
        if i >= len(self.prefix):
            return -1
        shared = self.prefix[i]
        stop = self.place + self.length[i] - shared
        self.key = self.key[:shared] + self.rest[self.place : stop]
        self.place = stop
        stop = self.b_place + self.before_length[i]
        self.left = self.before[self.b_place : stop]
        self.b_place = stop
        return shared


def _common(a: bytes, b: bytes, k: int) -> int:
    """The common prefix of a and b, of which k bytes are known to be equal."""
    n = min(len(a), len(b))
    if a[k:n] == b[k:n]:
        return n
    while n - k > 8:  # halve what holds the first difference
        m = (k + n) >> 1
        if a[k:m] == b[k:m]:
            k = m
        else:
            n = m
    while a[k] == b[k]:
        k += 1
    return k


def merge(runs: list[Run]) -> Iterator[tuple[int, int]]:
    """(run, common prefix with the key that came before) of all keys in order, by a loser tree.

    shared[r] is the common prefix of run r's key with the key that went out last when r was last
    compared on the path; of two runs on one path the one with the longer prefix is smaller, and only if
    they are equal are bytes compared, from there on. Equal keys come in order of run.
    """
    k = 1
    while k < len(runs):
        k *= 2
    shared = [r.next() for r in runs] + [-1] * (k - len(runs))
    live = [s >= 0 for s in shared]
    tree = [0] * k

    def beats(a: int, b: int) -> bool:
        """Whether a goes out before b; the loser keeps its common prefix with the winner."""
        if not live[b]:
            return True
        if not live[a]:
            return False
        if shared[a] != shared[b]:
            return shared[a] > shared[b]
        x, y = runs[a].key, runs[b].key
        n = _common(x, y, shared[a])
        first = a < b if n == len(x) == len(y) else (n == len(x) or (n < len(y) and x[n] < y[n]))
        shared[b if first else a] = n
        return first

    winner = list(range(k))
    size = k
    while size > 1:
        size //= 2
        up = []
        for i in range(size):
            a, b = winner[2 * i], winner[2 * i + 1]
            if beats(a, b):
                up.append(a)
                tree[size + i] = b
            else:
                up.append(b)
                tree[size + i] = a
        winner = up
    top = winner[0]
    while live[top]:
        yield top, shared[top]
        shared[top] = runs[top].next()
        live[top] = shared[top] >= 0
        node = (top + k) >> 1
        while node:
            other = tree[node]
            # Of different prefixes the longer goes out first, without a look at the keys.
            if shared[top] < shared[other] if shared[top] != shared[other] else not beats(top, other):
                top, tree[node] = other, top
            node >>= 1


@dataclass
class Merged:
    """Different contents in order: code and suffix, common prefix with the one before, string before the anchor,
    smallest document; and the place of each run's contents among them."""

    keys: list[bytes]
    shared: list[int]
    lefts: list[bytes]
    first: list[int]
    ranks: list[list[int]]


def merge_contents(runs: list[Run]) -> Merged:
    """Merge the runs, equal contents once."""
    keys, common, lefts, first, ranks = [], [], [], [], [[] for _ in runs]
    same: dict[bytes, int] = {}
    size = -1
    for r, shared in merge(runs):
        run = runs[r]
        key, left = run.key, run.left
        if shared != size or len(key) != size:
            same, size = {}, len(key)
            n = None
        else:
            n = same.get(left)
        if n is None:
            n = same[left] = len(keys)
            keys.append(key)
            common.append(shared)
            lefts.append(left)
            first.append(run.first[run.i])
        elif run.first[run.i] < first[n]:
            first[n] = run.first[run.i]
        ranks[r].append(n)
    return Merged(keys, common, lefts, first, ranks)


def _run_row(q: int, c: int, source: int, prefix: bytes, length: bytes, rest: bytes, before: bytes, before_length: bytes, first: np.ndarray) -> dict:
    data = (prefix, length, rest, before, before_length)
    return {"home": False, "q": q, "c": c, "source": source, "first": small(first)} | {n: squeeze(x) for n, x in zip(("prefix", "length", "rest", "before", "before_length"), data, strict=True)}


def _once(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different rows in order, place of each row among them) of a matrix of bytes."""
    order = np.argsort(rows.view(f"S{rows.shape[1]}").reshape(-1), kind="stable")
    rows = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    of = np.zeros(len(rows), np.int64)
    of[order] = np.cumsum(new) - 1
    return rows[new], of


def _contents(raw: np.ndarray, codes: np.ndarray, begins: np.ndarray, counts: np.ndarray, anchors: np.ndarray, width: int) -> np.ndarray:
    """A row of bytes for each span: code, suffix and its length, string before the anchor and its length."""
    reach = width - GRAM
    before = anchors - begins
    after = counts + width - 1 - before
    padded = np.concatenate([np.zeros(reach, np.uint8), raw, np.zeros(width, np.uint8)])
    out = np.zeros((len(begins), CODE + width + reach + 2), np.uint8)
    out[:, :CODE] = codes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - CODE :]
    step = np.arange(width)
    out[:, CODE : CODE + width] = np.where(step < after[:, None], padded[anchors[:, None] + (step + reach)], 0)
    out[:, CODE + width] = after
    step = np.arange(reach)
    out[:, CODE + width + 1 : -1] = np.where(step >= reach - before[:, None], padded[anchors[:, None] + step], 0)
    out[:, -1] = before
    return out


#: Spans whose bytes are laid out at once.
_ROWS = 1 << 16


def _part_contents(table: pa.Table, codes: np.ndarray, flags: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(different contents in order, content, place and id of each occurrence) of the spans of a part whose codes are shared."""
    contents, of, places, ids = [np.zeros((0, 2 * width + CODE + 2 - GRAM), np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    size = 0
    for chunk in table.combine_chunks().to_batches():
        doc_ids = chunk.column("id").to_numpy(zero_copy_only=False)
        for lo, raw, at, start in _long_slices(chunk.column("text"), width):
            s = find_spans(raw, at, width)
            if not len(s.begins):
                continue
            flag = flags[np.searchsorted(codes, s.codes)]
            cold, hot = flag == _SHARED, flag & _HOT > 0
            # Windows of hot anchors stand for themselves: spans of one window whose anchor is its first byte.
            each = ranges(s.begins[hot], s.counts[hot])
            with np.errstate(over="ignore"):
                own = _codes(_mixed(s.hashes[each] * np.uint64(5) + s.hashes[each + width - GRAM]))
            begins, anchors = np.concatenate([s.begins[cold], each]), np.concatenate([s.anchors[cold], each])
            counts, own = np.concatenate([s.counts[cold], np.ones(len(each), np.int64)]), np.concatenate([s.codes[cold], own])
            for i in range(0, len(begins), _ROWS):
                j = i + _ROWS
                rows, place = _once(_contents(raw, own[i:j], begins[i:j], counts[i:j], anchors[i:j], width))
                contents.append(rows)
                of.append(place + size)
                size += len(rows)
            row = np.searchsorted(at, begins, "right") - 1
            places.append(begins - at[row] + start)
            ids.append(doc_ids[lo + row])
    rows, place = _once(np.concatenate(contents))
    return rows, place[np.concatenate(of)], np.concatenate(places), np.concatenate(ids)


def _part_runs(width: int, levels: Levels):
    """Documents of a part and the flags of its codes to a run, cut for the first round, and where its contents are."""
    reach = width - GRAM

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        part = key[0].as_py()
        if not right.num_rows or not left.num_rows:
            return _rows(_RUN_SCHEMA, [])
        codes, _, _ = _part_codes(left, width)
        rows, of, places, ids = _part_contents(left, codes, _joined_flags(right), width)
        if not len(rows):
            return _rows(_RUN_SCHEMA, [])
        by = np.argsort(of, kind="stable")
        first = np.minimum.reduceat(ids[by], np.searchsorted(of[by], np.arange(len(rows))))
        keys, lengths = rows[:, : CODE + width], rows[:, CODE + width].astype(np.int64) + CODE
        befores, before_lengths = rows[:, CODE + width + 1 : -1], rows[:, -1].astype(np.int64)
        differ = keys[1:] != keys[:-1]
        shared = np.zeros(len(rows), np.int64)
        shared[1:] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), CODE + width), np.minimum(lengths[1:], lengths[:-1]))
        own = np.zeros((len(rows), 8), np.uint8)
        own[:, 8 - CODE :] = keys[:, :CODE]
        out, at = [], np.arange(CODE + width)
        for b, i, j in levels.cuts(own.view(">u8").reshape(-1).astype(np.uint64), 0, 0):
            prefix = shared[i:j].copy()
            prefix[0] = 0
            rest = keys[i:j][(at >= prefix[:, None]) & (at < lengths[i:j, None])].tobytes()
            before = befores[i:j][np.arange(reach) >= reach - before_lengths[i:j, None]].tobytes()
            out.append(_run_row(part // levels.fan, b, part, prefix.astype(np.uint8).tobytes(), lengths[i:j].astype(np.uint8).tobytes(), rest, before, rows[i:j, -1].tobytes(), first[i:j]))
        return _rows(_RUN_SCHEMA, [*out, {"home": True, "q": part, "c": 0, "ranks": small(of), "places": small(places), "ids": small(ids)}])

    return run


def judge(merged: Merged, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretches of each content, windows of each stretch, owner of each): the smallest document of each window.

    A window d bytes before its anchor is the end of length d of the string before it and the first width - d
    bytes of the suffix. Contents that share these suffix bytes are a stretch of the order without a common
    prefix below that; those that share the end are a stretch of the order of the reversed strings before.
    """
    n = len(merged.keys)
    shared = np.array(merged.shared) - CODE
    after, before = np.array([len(k) for k in merged.keys]) - CODE, np.array([len(x) for x in merged.lefts])
    windows, first = before + after - width + 1, np.array(merged.first, np.int64)
    owner = np.repeat(first, windows)
    base = np.cumsum(windows) - windows
    met = np.zeros(n, bool)
    met[1:] = shared[1:] >= GRAM
    met[:-1] |= met[1:]
    rows = np.flatnonzero(met)
    if len(rows):
        reach = width - GRAM
        ends = np.frombuffer(b"".join(merged.lefts[i][::-1].ljust(reach, b"\0") for i in rows.tolist()), np.uint8).reshape(len(rows), reach)
        order = np.argsort(np.ascontiguousarray(ends).view(f"S{reach}").reshape(-1), kind="stable")
        differ = ends[order[1:]] != ends[order[:-1]]
        alike = np.where(differ.any(axis=1), differ.argmax(axis=1), reach)
        after, before, first, base, stretch = after[rows], before[rows], first[rows], base[rows], np.minimum(shared, width)
        end_class = np.zeros(len(rows), np.int64)
        for d in range(reach + 1):
            own = np.flatnonzero((before >= d) & (after >= width - d))
            if not len(own):
                continue
            start_class = np.cumsum(stretch < width - d)[rows]
            end_class[order] = np.concatenate([[0], np.cumsum(alike < d)])
            key = start_class[own] * len(rows) + end_class[own]
            by = np.argsort(key, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(key[by]) != 0]))
            least = np.minimum.reduceat(first[own][by], edges)
            at = own[by]
            owner[base[at] + before[at] - d] = np.repeat(least, np.diff(np.append(edges, len(by))))
    content = np.repeat(np.arange(n), windows)
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (content[1:] != content[:-1])])
    edges = np.flatnonzero(new)
    return np.bincount(content[edges], minlength=n), np.diff(np.append(edges, len(owner))), owner[edges]


def _verdict_row(q: int, c: int, digit: int, counts: np.ndarray, lengths: np.ndarray, owners: np.ndarray) -> dict:
    return {"q": q, "c": c, "digit": digit, "counts": squeeze(counts.astype(np.uint8).tobytes()), "lengths": squeeze(lengths.astype(np.uint8).tobytes()), "owners": small(owners)}


def _verdicts_of(counts: np.ndarray, lengths: np.ndarray, owners: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The verdicts of the contents at the ranks."""
    first = np.cumsum(counts) - counts
    stretch = ranges(first[ranks], counts[ranks])
    return counts[ranks], lengths[stretch], owners[stretch]


def _joined_verdicts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = sorted(table.select(["digit", "counts", "lengths", "owners"]).to_pylist(), key=lambda r: r["digit"])
    none = np.zeros(0, np.int64)
    counts, lengths = (np.concatenate([none, *(np.frombuffer(unsqueeze(r[x]), np.uint8).astype(np.int64) for r in rows)]) for x in ("counts", "lengths"))
    return counts, lengths, np.concatenate([none, *(unsmall(r["owners"]) for r in rows)])


def _meet_runs(width: int, levels: Levels):
    def at(level: int):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            q, c = (k.as_py() for k in key)
            columns = ("prefix", "length", "rest", "before", "before_length")
            rows = sorted(table.select(["source", "first", *columns]).to_pylist(), key=lambda r: r["source"])
            merged = merge_contents([Run(*(unsqueeze(r[x]) for x in columns), unsmall(r["first"]).tolist()) for r in rows])
            ranks = [np.array(x, np.int64) for x in merged.ranks]
            if level == levels.count:
                verdict = judge(merged, width)
                return _rows(_VERDICT_SCHEMA, [_verdict_row(r["source"], c // levels.fan, c, *_verdicts_of(*verdict, x)) for r, x in zip(rows, ranks, strict=True)])
            codes = np.array([int.from_bytes(k[:CODE], "big") for k in merged.keys], np.uint64)
            out, first = [], np.array(merged.first, np.int64)
            for b, i, j in levels.cuts(codes, level, c):
                keys, lefts, prefix = merged.keys[i:j], merged.lefts[i:j], [0, *merged.shared[i + 1 : j]]
                rest = b"".join([k[s:] for k, s in zip(keys, prefix, strict=True)])
                out.append(_run_row(q // levels.fan, b, q, bytes(prefix), bytes(map(len, keys)), rest, b"".join(lefts), bytes(map(len, lefts)), first[i:j]))
            return _rows(_RUN_SCHEMA, out + [{"home": True, "q": q, "c": c, "source": r["source"], "ranks": small(x)} for r, x in zip(rows, ranks, strict=True)])

        return run

    return at


def _verdicts_back(levels: Levels):
    def run(key: tuple, home: pa.Table, verdicts: pa.Table) -> pa.Table:
        c, verdict = key[1].as_py(), _joined_verdicts(verdicts)
        rows = home.select(["source", "ranks"]).to_pylist()
        return _rows(_VERDICT_SCHEMA, [_verdict_row(r["source"], c // levels.fan, c, *_verdicts_of(*verdict, unsmall(r["ranks"]))) for r in rows])

    return run


_REMOVAL_SCHEMA = "q long, ids binary, begins binary, ends binary"


def _removals(width: int):
    """Where a part's contents are and their verdicts to byte ranges, sorted by document and place."""

    def run(key: tuple, home: pa.Table, verdicts: pa.Table) -> pa.Table:
        counts, lengths, owners = _joined_verdicts(verdicts)
        out = []
        for row in home.select(["ranks", "places", "ids"]).to_pylist():
            of, places, ids = (unsmall(row[x]) for x in ("ranks", "places", "ids"))
            first = np.cumsum(counts) - counts
            # Where each stretch starts among the windows of its content.
            before = np.cumsum(lengths) - lengths
            before -= np.repeat(before[first], counts)
            stretch = ranges(first[of], counts[of])
            occurrence = np.repeat(np.arange(len(of)), counts[of])
            gone = owners[stretch] < ids[occurrence]
            stretch, occurrence = stretch[gone], occurrence[gone]
            ids, begin = ids[occurrence], places[occurrence] + before[stretch]
            end = begin + lengths[stretch] + width - 1
            order = np.lexsort((begin, ids))
            out.append({"q": key[0].as_py(), "ids": small(ids[order]), "begins": small(begin[order]), "ends": small(end[order])})
        return _rows(_REMOVAL_SCHEMA, out)

    return run


def _rebuild(keep_text: bool):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        ids, begins, ends = (np.concatenate([none, *map(unsmall, right.column(c).to_pylist())]) for c in ("ids", "begins", "ends"))
        out = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []} | ({"kept": []} if keep_text else {})
        for chunk in left.combine_chunks().to_batches():
            raw, at = utf8(chunk.column("text"))
            for i, doc in enumerate(chunk.column("id").to_pylist()):
                text = raw[at[i] : at[i + 1]].tobytes()
                lo, hi = np.searchsorted(ids, [doc, doc + 1])
                kept, reach, removed, n_spans = [], 0, 0, 0
                start = end = -1
                for b, e in zip(begins[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True):
                    if b > end:  # ranges that touch are one run
                        if end > start:
                            kept.append(text[reach:start])
                            reach, removed, n_spans = end, removed + end - start, n_spans + 1
                        start, end = b, e
                    else:
                        end = max(end, e)
                if end > start:
                    kept.append(text[reach:start])
                    reach, removed, n_spans = end, removed + end - start, n_spans + 1
                kept.append(text[reach:])
                rest = b"".join(kept)
                for name, value in (("doc_id", doc), ("n_bytes", len(text)), ("n_removed", removed), ("n_spans", n_spans), ("kept_sha256", hashlib.sha256(rest).hexdigest())):
                    out[name].append(value)
                if keep_text:
                    out["kept"].append(rest)
        types = {"kept_sha256": pa.string(), "kept": pa.binary()}
        return pa.table({k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()})

    return run


def remove_repeats(docs: DataFrame, *, width: int = WIDTH, part_bytes: int = PART_BYTES, fan: int = FAN, hot_spans: int = HOT_SPANS, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]), a row for each row of docs.

    A text is its UTF-8 bytes (null: none). A byte goes if a string of width bytes that covers it also
    starts in a document of a smaller id, judged on the input. n_spans counts maximal removed runs; kept
    holds the remaining bytes (which may cut a character). width is at least GRAM + 1 and at most 128.
    Rows of one id are one document to each other: nothing of one goes for the other. A row with null id is
    no document: nothing is removed from it and nothing goes for it. Texts under width bytes stay whole; an
    empty table gives an empty result.

    The corpus is dealt into parts of about part_bytes by a hash of the id; each part holds its suffix run,
    equal suffixes once, so the copies of a hot string cost one suffix in each part, and one in all the
    parts that a round has merged. An anchor with more than hot_spans different spans (a run of blanks,
    a ruled line) does not meet in one task: each of its windows is sorted by a code of its own.
    """
    if not GRAM < width <= 128:
        raise ValueError(f"width must be over {GRAM} and at most 128")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = rows.where("id IS NOT NULL")
    total = known.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, math.ceil(total / part_bytes))
    levels = Levels.of(parts, fan)
    placed = _with_part(known, parts)
    codes = placed.groupBy("q").applyInArrow(_send_codes(width, levels), _CODE_SCHEMA)
    flags = _exchange(codes, levels, _meet_codes(levels, hot_spans), _CODE_SCHEMA, _FLAG_SCHEMA, _flags_back(levels), "codes")
    runs = placed.groupBy("q").cogroup(flags.groupBy("q")).applyInArrow(_part_runs(width, levels), _RUN_SCHEMA)
    runs = materialize(runs, "runs-0", by="home")
    verdicts = _exchange(runs, levels, _meet_runs(width, levels), _RUN_SCHEMA, _VERDICT_SCHEMA, _verdicts_back(levels), "runs")
    removals = materialize(runs.where("home").groupBy("q").cogroup(verdicts.groupBy("q")).applyInArrow(_removals(width), _REMOVAL_SCHEMA), "removals")
    discard(flags, runs, verdicts)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    out = placed.groupBy("q").cogroup(removals.groupBy("q")).applyInArrow(_rebuild(keep_text), schema)
    lone = rows.where("id IS NULL").select(
        F.col("id").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), *([F.encode("text", "UTF-8").alias("kept")] if keep_text else []),
    )
    return out.unionByName(lone)
