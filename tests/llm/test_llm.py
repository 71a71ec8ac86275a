"""Operators against brute force, exact round trips and held-out accuracy, with odd inputs."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from foliant.llm import ann, components, decontaminate, html_text, language_id, line_dedup, packing, pii, simhash, suffix_dedup, warc
from foliant.session import DATA_DIR

SF = f"{DATA_DIR}/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, kept_text string"


def odd_docs(spark, n_copies: int = 12):
    """Nulls, empty and long texts, ties, repeated rows and columns with names that operators use."""
    rows = [(1, None), (2, ""), (3, "   \n\t\n"), (None, "a line of nobody\nshared line"), (4, "Wort " * 60_000), (5, "shared line\n\nSHARED LINE  \nown line"), (5, "shared line\n\nSHARED LINE  \nown line"), (6, "日本語 のテキスト "), (7, "x"), (8, "one two")]
    rows += [(100 + i, f"shared line\nown {i}\nand a passage that is quite long, long enough to be found as a repeat in others") for i in range(n_copies)]
    return spark.createDataFrame([(i, t, None, "s", None, "clash", "clash") for i, t in rows], SCHEMA), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- line dedup ------------------------------------------------------------------------------------------


def lines_by_hand(rows, least=10):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    seen = Counter(k for _, t in rows for k in set(map(key, (t or "").split("\n"))) if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if seen[key(s)] < least]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup(spark):
    df, rows = odd_docs(spark)
    assert sorted(map(tuple, line_dedup.digest(df).collect()), key=str) == lines_by_hand(rows)
    real = [(r.doc_id, r.text) for r in docs_of(spark).select("doc_id", "text").collect()]
    assert sorted(map(tuple, line_dedup.digest(docs_of(spark)).collect()), key=str) == lines_by_hand(real)
    assert line_dedup.digest(empty(spark)).count() == 0
    assert line_dedup.drop_shared_lines(df).columns == [c for c in df.columns if c != "kept_text"] + ["kept_text", "n_lines", "n_dropped"]


# --- near duplicates -----------------------------------------------------------------------------------------


def simhash_by_hand(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(ids, fps, radius=3):
    a, root = np.array(fps, np.uint64), list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= radius):
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    least = {}
    for i in range(len(a)):
        if ids[i] is not None:
            least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return [least.get(find(i)) for i in range(len(a))]


def test_xxh64_of_any_length():
    data = np.random.default_rng(0).integers(0, 256, 400, np.uint8)
    starts, lengths = np.arange(100), np.arange(100) * 2
    want = [xxhash.xxh64_intdigest(data[s : s + n].tobytes(), 42) for s, n in zip(starts, lengths, strict=True)]
    assert simhash.xxh64(data, starts, lengths).tolist() == want


def test_simhash(spark):
    for df in (odd_docs(spark)[0], docs_of(spark)):
        rows = df.select("doc_id", "text").collect()
        fps = [simhash_by_hand(r.text) for r in rows]
        want = Counter(zip([r.doc_id for r in rows], [f"{f:016x}" for f in fps], components_by_hand([r.doc_id for r in rows], fps), strict=True))
        assert Counter(map(tuple, simhash.near_duplicates(df).collect())) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_covering_masks_cover():
    rng = np.random.default_rng(1)
    masks = np.array(simhash.covering_masks(list(range(64)), 3), np.uint64)
    for _ in range(2000):
        diff = np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
        assert ((masks & diff) == 0).any()


def test_links_of_dense_groups(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, np.uint64)
    near = {int(b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 6), replace=False)))) for b in base for _ in range(40)}
    dense = {int(base[0]) ^ i for i in range(1500)}  # one bucket with more members than are compared at once
    fps = sorted(near | dense)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    roots = {r.node: r.root for r in components.connected_components(simhash.links(df)).collect()}
    got = [roots.get(simhash._signed(f), simhash._signed(f)) for f in fps]
    want = components_by_hand(list(range(len(fps))), fps)
    assert len(set(got)) == len(set(want)) and len(set(zip(got, want, strict=True))) == len(set(want))


def test_components(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3), (900, 901)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 500 for i in range(500, 560)} | {900: 900, 901: 900}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- decontamination --------------------------------------------------------------------------------------------


def overlap_by_hand(docs, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for p in range(len(w) - k + 1) if w and item is not None else ():
            windows.setdefault(tuple(w[p : p + k]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                if got := windows.get(tuple(w[p : p + k])):
                    hit.update(range(p, p + k))
                    found |= got
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_decontaminate(spark):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bench += [(900, None), (901, ""), (902, "x"), (903, "own line"), (903, "wort wort"), (904, bench[0][1]), (None, "shared line")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    real = docs_of(spark)
    for df in (odd_docs(spark)[0], real):
        docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert Counter(map(tuple, decontaminate.find_overlap(df, items).collect())) == overlap_by_hand(docs, bench)
    assert decontaminate.find_overlap(empty(spark), items).count() == 0
    assert not decontaminate.find_overlap(real, items.limit(0)).where("contaminated").count()


def test_decontaminate_long_texts_and_repeated_words(spark):
    """Texts cut in pieces, many items, and items of one word over and over."""
    rng = np.random.default_rng(5)
    docs = [(1, " ".join(f"w{i % 977}" for i in range(40_000))), (2, "same " * 3000), (3, "ab " * 30), (4, "one two " * 20 + "ab " * 9), (4, "clean"), (5, "語" * 400 + " b c d e f g h i j k")]
    bench = [("a", " ".join(f"w{i % 977}" for i in range(900, 930))), ("b", "same " * 400), ("c", "ab " * 10), ("d", "two one " * 8), ("e", "語" * 400 + " b c d e f g h i j k"), ("f", "w976 w0 w1")]
    bench += [(f"r{i}", " ".join(f"w{rng.integers(977)}" for _ in range(12))) for i in range(3000)] + [(f"s{i}", " ".join(f"w{j % 977}" for j in range(i, i + 14))) for i in range(0, 977, 50)]
    df, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id string, text string")
    want = overlap_by_hand(docs, bench)
    for size in (5000, decontaminate.SLICE_BYTES):
        assert Counter(map(tuple, decontaminate.find_overlap(df, items, slice_bytes=size).collect())) == want
    assert [tuple(r) for r in decontaminate.drop_contaminated(df, items).collect()] == [(4, "clean")]


# --- packing -------------------------------------------------------------------------------------------------------


def check_packing(rows, docs):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids = Counter()
    for e in tokenizer.encode_batch([t or "" for _, t in docs], add_special_tokens=False):
        ids[tuple(e.ids) + (0,)] += 1
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert sum(r.length for r in own) <= 1024
    want = Counter()
    for (doc, _), e in zip(docs, tokenizer.encode_batch([t or "" for _, t in docs], add_special_tokens=False), strict=True):
        want[doc, len(e.ids) + 1] += 1
    assert sum(r.length for r in rows) == sum(n * k for (_, n), k in want.items())
    text_of = {}
    for doc, text in docs:
        text_of.setdefault(doc, np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4"))
    for r in rows:
        own = text_of[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(text_of[r.doc_id]) and r.ids_crc32 == zlib.crc32(own.tobytes())
    sums = [sum(r.length for r in own) for own in by_sequence.values()]
    return sum(0 if n & (n - 1) == 0 else 1024 - n for n in sums) / sum(sums)


def test_packing(spark):
    df, docs = odd_docs(spark)
    check_packing(packing.pack_documents(df, TOKENIZER).collect(), docs)
    real = docs_of(spark)
    rows = [(r.doc_id, r.text) for r in real.select("doc_id", "text").collect()]
    assert check_packing(packing.pack_documents(real, TOKENIZER).collect(), rows) < 0.02
    assert packing.pack_documents(empty(spark), TOKENIZER).count() == 0


def test_encoder_cuts():
    texts = ["don't! it's, x|y", "ok<|endoftext|> a", "", "a  b", "it's  \n\n b ", "é  x  y  z", "a" * 50 + " b", "\u0085 a", "x\x1c y", "日本 語 ", "  ", "×, ÷ x", "1,2.3 4"]
    encoder = packing.Encoder(TOKENIZER)
    for _ in range(2):
        ids, counts = encoder.encode(*next((raw, at) for _, _, raw, at in packing.slices(pa.array(texts), 1 << 20)))
        ends = np.cumsum(counts)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_differencing():
    parts = packing.difference([8, 7, 6, 5, 4], 2)
    assert sorted(i for p in parts for i in p) == [0, 1, 2, 3, 4]
    assert abs(sum([8, 7, 6, 5, 4][i] for i in parts[0]) - sum([8, 7, 6, 5, 4][i] for i in parts[1])) <= 2
    assert len(packing.pack([600, 600, 600], 1024)) == 3  # two windows would do by their sum


# --- language --------------------------------------------------------------------------------------------------------


def test_language(spark):
    df = spark.read.parquet(f"{DATA_DIR}/sf0.01/documents.parquet")
    rows = language_id.predict_languages(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None), (2, "12 345 !"), (3, ""), (4, "Привет, как дела сегодня вечером"), (5, "the thing and the other of it")], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.classify(odd, language_id.fit(df)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and [got[i].rejected for i in (1, 2, 3, 4, 5)] == [True, True, True, True, False]
    assert {r.lang_pred for r in language_id.predict_languages(odd_docs(spark)[0]).collect()} == {"und"}
    assert language_id.predict_languages(empty(spark)).count() == 0


def test_language_counts_of_long_texts():
    """Pieces of a long text have the counts of the whole; texts without blanks and of several bytes a letter too."""
    rng = np.random.default_rng(4)
    for letters in ("abc d,  e", "äöß 中文 ", "xyz"):
        raw = np.frombuffer("".join(letters[i] for i in rng.integers(0, len(letters), 5000)).encode(), np.uint8)
        whole = language_id.count_ngrams(raw, np.array([0, len(raw)]), 256)
        for piece in (7, 100, 4999):
            part = language_id.count_long(raw, 256, piece)
            assert (part[0] == whole[0]).all() and (part[1] == whole[1]).all()


def languages_by_hand(rows, texts, features=language_id.FEATURES):
    """Nearest centroids with dictionaries of n-grams, from the same sample and seeds."""
    grams = lambda t: language_id.count_ngrams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), features)[0][0]
    counts = {lang: np.array([grams(t) for t in own]) for lang, own in rows.items()}
    every = np.concatenate(list(counts.values()))
    weights = [np.log((1 + len(every)) / (1 + n)) + 1 for n in (every > 0).sum(axis=0)]
    vector = lambda c: (v := np.log1p(c) * weights) / np.sqrt((v * v).sum())
    centroids = [(lang, c) for lang, own in sorted(counts.items()) for c in language_id._cluster(np.array([vector(c) for c in own], np.float32), language_id.CENTROIDS)[0]]
    return [max(((float(c @ vector(grams(t))), lang) for lang, c in centroids), key=lambda x: x[0]) for t in texts]


def test_language_against_brute_force(spark):
    """Many small languages, all learned; scores as by hand; noise in Latin letters and an unlearned language go."""
    rng = np.random.default_rng(6)
    words = {f"l{i:03d}": ["".join(chr(97 + c) for c in rng.integers(i % 13, i % 13 + 12, rng.integers(3, 7))) for _ in range(30)] for i in range(60)}
    say = lambda lang, n: " ".join(words[lang][j] for j in rng.integers(0, 30, n))
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 3 != 1][:600]
    train = [(i, say(f"l{n % 60:03d}", 60), f"l{n % 60:03d}") for n, i in enumerate(ids)]
    model = language_id.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.languages == sorted(words)
    texts = [say(f"l{n:03d}", 80) for n in range(60)]
    odd = ["".join(chr(97 + c) for c in rng.integers(0, 26, 3000)), "".join(chr(1072 + c) for c in rng.integers(0, 30, 400))]
    got = language_id.classify(spark.createDataFrame(list(enumerate(texts + odd)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    # The hash of ids orders the sample, on which seeds depend.
    from pyspark.sql import functions as F

    order = {r.id: r.h for r in spark.createDataFrame([(i,) for i in ids], "id long").select("id", F.xxhash64("id", F.lit(11)).alias("h")).collect()}
    by: dict = {}
    for i, t, lang in sorted(train, key=lambda r: order[r[0]]):
        by.setdefault(lang, []).append(t)
    want = languages_by_hand(by, texts)
    assert [r.lang_pred for r in got[:60]] == [w[1] for w in want] and np.allclose([r.score for r in got[:60]], [w[0] for w in want], atol=1e-4)
    assert not any(r.rejected for r in got[:60]) and got[61].rejected
    real = spark.read.parquet(f"{DATA_DIR}/sf0.01/documents.parquet")
    noise = spark.createDataFrame([(1, odd[0]), (2, " ".join(odd[0][i : i + 9] for i in range(0, 3000, 9)))], "doc_id long, text string")
    model = language_id.fit(real)
    assert all(r.rejected for r in language_id.classify(noise, model).collect())
    assert language_id.classify(real.where("lang IS NOT NULL"), model).where("rejected AND text RLIKE '[a-z]{3}'").count() <= 3
    clash = spark.createDataFrame([(1, "the thing and the other", "a", 1.0, True)], "doc_id long, text string, lang_pred string, score double, rejected boolean")
    assert language_id.classify(clash, model).columns == ["doc_id", "text", "lang_pred", "score", "rejected"]


# --- repeated byte strings ---------------------------------------------------------------------------------------------


def repeats_by_hand(docs, width=50):
    first, out = {}, Counter()
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - width + 1) if i is not None else ():
            w = b[p : p + width]
            first[w] = min(i, first.get(w, i))
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1) if i is not None else ():
            if first[b[p : p + width]] < i:
                gone[p : p + width] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out[i, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"part_bytes": 20_000}, {"part_bytes": 50_000, "fan": 3}, {"part_bytes": 100_000, "fan": 4, "hot_spans": 2}, {"hot_spans": 0}])
def test_suffix_dedup(spark, options):
    df, docs = odd_docs(spark, 40)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r[c] for c in columns) for r in suffix_dedup.remove_repeats(df, **options).collect()) == repeats_by_hand(docs)
    real = docs_of(spark)
    docs = [(r.doc_id, r.text) for r in real.select("doc_id", "text").collect()]
    assert Counter(tuple(r[c] for c in columns) for r in suffix_dedup.remove_repeats(real, **options).collect()) == repeats_by_hand(docs)


def test_levels():
    for parts, fan in ((1, 64), (64, 64), (102, 64), (5000, 64), (100, 3)):
        levels = suffix_dedup.Levels.of(parts, fan)
        assert levels.fan <= fan and levels.fan**levels.count >= parts
        codes = np.sort(np.random.default_rng(0).integers(0, suffix_dedup._CODES, 3000).astype(np.uint64))
        pieces, c = [(0, 0, len(codes))], 0
        for level in range(levels.count):
            pieces = [(b, lo + i, lo + j) for c, lo, hi in pieces for b, i, j in levels.cuts(codes[lo:hi], level, c)]
            assert [x[1] for x in pieces] + [len(codes)] == [0] + [x[2] for x in pieces]
    assert suffix_dedup.unpack_codes(suffix_dedup.pack_codes(codes)).tolist() == codes.tolist()


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def lcp(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_loser_tree():
    rng = np.random.default_rng(3)
    strings = [bytes(rng.integers(97, 99, rng.integers(1, 12), np.uint8)) for _ in range(600)]
    for k in (1, 2, 3, 7, 16):
        parts = [sorted(strings[i::k]) for i in range(k)]
        runs = []
        for own in parts:
            prefix = bytes([0] + [lcp(a, b) for a, b in zip(own, own[1:], strict=False)]) if own else b""
            rest = b"".join(x[n:] for x, n in zip(own, prefix, strict=True))
            runs.append(suffix_dedup.Run(prefix, bytes(map(len, own)), rest, b"", bytes(len(own)), [0] * len(own)))
        out, shared = [], []
        for r, n in suffix_dedup.merge(runs):
            out.append(runs[r].key)
            shared.append(n)
        assert out == sorted(strings) and shared[1:] == [lcp(a, b) for a, b in zip(out, out[1:], strict=False)]


# --- archives ------------------------------------------------------------------------------------------------------------


def test_warc(spark):
    fake = "<pre>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Type: x\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n</pre>"
    pages = list(enumerate(["", "a", None, "a", "é" * 50, fake, fake + "Z", "WARC/1.1\r\n", "WARC/1.0\r\nContent-Length: 5\r\n\r\nxx", "b" * 3000, fake * 30, "WARC/1.", "b", "x\nWARC/1.1\r\nContent-Length: 20\r\n\r\n"]))
    pages += [(None, "none"), (50, "none"), (51, "twice"), (51, "twice")]
    df = spark.createDataFrame([(i, h, f"http://x/{i}\r\nX: y", "clash") for i, h in pages], "page_id long, html string, url string, digest string").coalesce(1)
    largest = {}
    for i, h in pages:
        largest[h or ""] = max(i if i is not None else -1, largest.get(h or "", -1))
    want = []
    for i, h in pages:
        body = (h or "").encode()
        other = i != largest[h or ""] and largest[h or ""] >= 0
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if other else "response", largest[h or ""] if other else None))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "4000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = warc.round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
            assert Counter(map(tuple, got)) == Counter(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert warc.round_trip(df.limit(0)).count() == 0
    assert Counter(r.record_type for r in warc.round_trip(df, min_bytes=5).where("payload_bytes < 5").collect()) == Counter(response=7)


# --- neighbours --------------------------------------------------------------------------------------------------------------


def test_ann(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = e.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    q = ids % 20 == 0
    a, b, s = ann.best_of(x[q], ids[q], x, ids, 20)
    want = {(i, j): v for i, j, v in zip(a.tolist(), b.tolist(), s.tolist(), strict=True)}
    got = ann.nearest(e).collect()
    assert len(got) == 20 * q.sum() and sum((r.query_id, r.vec_id) in want for r in got) / len(want) >= 0.9
    assert all(want.get((r.query_id, r.vec_id), r.score) == r.score for r in got)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21)) and own == sorted(own, key=lambda r: (-r.score, r.vec_id))


def test_ann_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [2.0, 0.0]), (7, [1.0, 0.0]), (20, [0.5, 0.5]), (40, None), (None, [1.0, 1.0]), (8, [])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 6, 2.0), (0, 2, 1, 1.0), (0, 3, 7, 1.0), (20, 1, 6, 1.0), (20, 2, 0, 0.5), (20, 3, 1, 0.5)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def neighbours_by_hand(rows, k, every):
    out = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v) and i % every == 0:
            near = out.setdefault(i, {})
            for j, w in rows:
                if j is not None and j != i and w and len(w) == len(v) and all(c is not None and np.isfinite(c) for c in w) and any(w):
                    score = 0.0
                    for a, b in zip(v, w, strict=True):
                        score += a * b
                    near[j] = max(score, near.get(j, score))
    return [(i, n, j, -s) for i, own in sorted(out.items()) for n, (s, j) in enumerate(sorted((-s, j) for j, s in own.items())[:k], 1)]


def test_ann_lengths_and_copies(spark):
    """Several lengths, repeated ids and thousands of equal vectors, of which those of the smallest ids come first."""
    rows = [(i, [1.0, 2.0, -1.0]) for i in range(3000)] + [(i, [float(i % 7), i * i % 101 / 7]) for i in range(5000, 5060)] + [(5020, [9.0, 9.0]), (6000, [1.0]), (6020, [2.0, 2.0, 2.0])]
    few = [r for r in rows if r[0] >= 2900]
    for own in (rows, few):
        got = ann.nearest(spark.createDataFrame(own, "vec_id long, embedding array<double>"), k=5).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == neighbours_by_hand(own, 5, 20)


@pytest.mark.parametrize(("n", "d", "share"), [(20_000, 64, 0.7), (20_000, 6, 0.1)])
def test_ann_recall_and_cost(spark, n, d, share):
    """Recall on unit vectors without structure, and how many of them a query is compared with."""
    rng = np.random.default_rng(d)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(n)
    df = spark.createDataFrame(pa.table({"vec_id": ids, "embedding": list(x)}))
    got = ann.nearest(df, every=100).collect()
    q = ids % 100 == 0
    a, b, _ = ann.best_of(x[q], ids[q], x, ids, 20)
    want = set(zip(a.tolist(), b.tolist(), strict=True))
    assert len(got) == len(want) and sum((r.query_id, r.vec_id) in want for r in got) / len(want) >= 0.9
    forest = ann.Forest([ann.grow(ann.Forest([], 1.0).lift(x), ann.LEAF_ROWS, t) for t in range(ann.TREES)], 1.0)
    rows = ann.valid_vectors(df, "vec_id", "embedding")
    most = ann._calibrate(rows.where("vec_id % 100 = 0"), rows, spark.sparkContext.broadcast(forest), 20, ann.CALIBRATION_RECALL)
    leaves = [tree.leaf_of(forest.lift(x)) for tree in forest.trees]
    seen = [np.isin(leaves[0] * 0 + np.arange(n), np.concatenate([np.flatnonzero(leaves[t] == leaf) for t, leaf in forest.search(np.append(v, 0).astype(np.float32), most)])).sum() for v in x[:20]]
    assert np.mean(seen) < share * n


# --- personal data -----------------------------------------------------------------------------------------------------------


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(digits)) % 10 == 0


def test_pii(spark):
    texts = [
        (1, "mail hein.19@mail5.example.com, ip 172.242.194.228!! card 4111 1111 1111 1111, 4381893557741608. phone +1 (743) 555-3824 ssn 123-45-6789 token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" Mr. John Smith met Frau Müller and г-жа Иванова"),
        (2, None), (3, ""), (4, "version 2.0. and 1.2.3 stay"), (5, "hein.19@mail5.example.com"), (5, "hein.19@mail5.example.com"), (6, "+1 (743) 555-3825 172.242.194.229 Mrs. Jane Smith"),
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, kinds string")
    got = pii.replace_entities(df, "k").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(texts) and by[2].text is None and by[3].text == "" and by[4].text == texts[3][1]
    assert by[1].n_entities == 10 and by[1].kinds == "card,email,ip,name,phone,secret,ssn"
    for lost in ("hein", "172.242", "4111", "743", "6789", "24be", "Smith", "Müller", "Иванова"):
        assert lost not in by[1].text
    mail = re.search(r"mail (\S+@\S+),", by[1].text)[1]
    assert by[5].text == mail and re.fullmatch(r"[a-z]{4}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", mail)
    assert luhn(re.search(r"card ([\d ]+),", by[1].text)[1]) and not luhn(re.search(r", (\d{16})\.", by[1].text)[1])
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", by[1].text) and re.search(r"ssn \d{3}-\d\d-\d{4} token = \"[0-9a-f]{40}\"", by[1].text)
    assert re.search(r"Mr\. [A-Z]\w+ [A-Z]\w+ met Frau [A-Z]\w+ and г-жа [А-Я][а-я]+", by[1].text)
    assert pii.replace_entities(df.limit(0), "k").count() == 0
    assert pii.replace_entities(df, "other").where("doc_id = 5").first().text != mail


def test_pii_whole_names(spark):
    names = [
        "Mr. O'Brien", "Mr. O’Neill", "Frau Müller-Schmidt", "Mr McDonald", "Mr. John F. Kennedy", "Mr. Jean-Luc Picard", "Dr. House", "Prof. Dr. Weber", "Herr Dr. K. Meier",
        "Mr. J. R. R. Tolkien", "Mr. J.R.R. Hobbit", "M. le Mr. Ludwig van Beethoven"[6:], "Mme de la Tour", "Señor Gabriel José García Márquez", "Mr. O'Hara", "Mr. d'Artagnan", "Frau K. Schulz", "г-н Римский-Корсаков", "Mrs. Smith", "Mr. Lee2",
    ]
    df = spark.createDataFrame([(i, f"then {n}, and {n} left; I saw it") for i, n in enumerate(names)], "doc_id long, text string")
    got = [r.text for r in pii.replace_entities(df, "k").orderBy("doc_id").collect()]
    new = [re.fullmatch(r"then (.+), and (.+) left; I saw it", t) for t in got]
    assert all(m and m[1] == m[2] for m in new) and len({m[1] for m in new}) == len(names)
    for name, m in zip(names, new, strict=True):
        title = re.match(r"(?:(?:Mr|Mrs|Dr|Prof|Herr|Frau|Mme|Señor|г-н)\.? )+", name)[0]
        assert m[1].startswith(title) and not set(re.findall(r"\w{2,}", name[len(title) :])) & set(re.findall(r"\w{2,}", m[1][len(title) :]))
        assert re.fullmatch(r"[A-ZА-Я][a-zа-я]+(?: [A-ZА-Я][a-zа-я]+)*", m[1][len(title) :]) and m[1].count(" ") == name.count(" ")
    other = spark.createDataFrame([(1, "Mr. Smith I think"), (2, "Mr. Smith Mrs. Jones"), (3, "a Dr of it, Drive on, Mr. and Mr. x")], "doc_id long, text string")
    a, b, c = (r.text for r in pii.replace_entities(other, "k").orderBy("doc_id").collect())
    assert re.fullmatch(r"Mr\. [A-Z]\w+ I think", a) and re.fullmatch(r"Mr\. [A-Z]\w+ Mrs\. [A-Z]\w+", b) and "Smith" not in a + b and "Jones" not in b
    assert c == "a Dr of it, Drive on, Mr. and Mr. x"


def test_pii_coreference(spark):
    """One person, number or address in several formats: the same surrogate in each one's own format."""
    texts = ["Mr Smith", "Mr. Smith", "Mr John Smith", "Dr. Smith", "a.Hein@X.org", "a.hein@x.org", "+17435553824", "+1 743 555 3824", "+44 20 7946 0958", "+442079460958", "4111-1111-1111-1111", "4111111111111111", "DEADBEEF" * 4, "deadbeef" * 4]
    texts += ["Mr Νίκος Παπάς", "Frau Նարե Սարգսյան", "Mr O’Brien", "Mr O'Brien"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = [r.text for r in pii.replace_entities(df, "k").orderBy("doc_id").collect()]
    assert not set(texts) & set(t)
    family = t[0].removeprefix("Mr ")
    assert t[1] == f"Mr. {family}" and t[2].startswith("Mr ") and t[2].endswith(f" {family}") and t[2].count(" ") == 2 and t[3] == f"Dr. {family}"
    assert t[4].lower() == t[5] and [c.isupper() for c in t[4]] == [c.isupper() for c in texts[4]]
    assert re.sub(r"\D", "", t[6]) == re.sub(r"\D", "", t[7]) and re.fullmatch(r"\+1 \d{3} \d{3} \d{4}", t[7])
    assert re.sub(r"\D", "", t[8]) == re.sub(r"\D", "", t[9]) and re.fullmatch(r"\+44\d{10}", t[9])
    assert t[10].replace("-", "") == t[11] and luhn(t[11]) and t[12].lower() == t[13] and t[12].isupper()
    assert re.fullmatch(r"Mr [Ά-Ω][ά-ώ]+ [Ά-Ω][ά-ώ]+", t[14]) and re.fullmatch(r"Frau [Ա-Ֆ][ա-և]+ [Ա-Ֆ][ա-և]+", t[15]) and t[16] == t[17]


def test_pii_detects_what_is_there(spark):
    """Texts with entities at known places, among others a very long one, against a replacement by hand."""
    rng = np.random.default_rng(11)
    parts = ["plain words 12 and 3.14, ", "user{}@host{}.example.org", "10.{}.{}.7", "+49 30 {}123 4567", "\uffff", "x" * 300, "Herr Krause{} "]
    rows, n_found = [], []
    for i in range(40):
        chosen = [parts[k] for k in rng.integers(0, len(parts), 3000 if i == 0 else 12)]
        text = " ; ".join(p.format(*rng.integers(100, 255, 2)) if "{}" in p else p for p in chosen)
        rows.append((i, re.sub(r"Krause(\d+)", lambda m: "Krause" + "abcdefghij"[int(m[1]) % 10], text)))
        n_found.append(sum("{}" in p for p in chosen))
    got = {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    shape = lambda t: re.sub(r"[a-z]+\d{3}@[a-z]+\d{3}\.[a-z]+\.org|\d+\.\d+\.\d+\.\d+|\+49 \d\d \d{6} \d{4}|Herr \w+", "E", t)
    for i, text in rows:
        assert got[i].n_entities == n_found[i] and shape(got[i].text) == shape(text)
    words = {w for _, t in rows for w in re.findall(r"Krause\w|user\d+@host\d+|\+49 30 \d+", t)}
    assert not any(w in got[i].text for i, _ in rows for w in words)


def test_pii_collisions(spark, monkeypatch):
    values = [f"user{i}@mail.example.com" for i in range(30)]
    df = spark.createDataFrame([(i, f"to {v}") for i, v in enumerate(values)], "doc_id long, text string")
    real = pii.atom_surrogate

    def few(atom, key, attempt):  # first surrogates collide on purpose
        from pyspark.sql import functions as F

        return F.when(attempt == 0, F.concat(F.lit("same"), (F.length(atom) % 2).cast("string"), F.lit("@x.org"))).otherwise(real(atom, key, attempt))

    monkeypatch.setattr(pii, "atom_surrogate", few)
    texts = [r.text for r in pii.replace_entities(df, "k").collect()]
    assert len(set(texts)) == 30 and not set(texts) & {f"to {v}" for v in values}


def test_pii_forms_do_not_run_out(spark):
    """All 26 local parts of one letter at one domain: surrogates have to get longer."""
    values = [f"{c}@x.org" for c in "abcdefghijklmnopqrstuvwxyz"]
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    texts = {r.text for r in pii.replace_entities(df, "k").collect()}
    assert len(texts) == 26 and not texts & set(values)
    many = spark.range(3000).selectExpr("id AS doc_id", "concat('Mr ', initcap(translate(cast(id + 1000 AS STRING), '0123456789', 'abcdefghij')), ' ', initcap(translate(cast(id * 7 + 30000 AS STRING), '0123456789', 'klmnopqrst'))) AS text")
    got = pii.replace_entities(many, "k").selectExpr("count(distinct text) AS n", "min(n_entities) AS least").first()
    assert got.n == 3000 and got.least == 1


def test_digit_permutation(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert df.select(pii.permute_digits(F.col("d"), "k")).distinct().count() == 1000


# --- HTML --------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>one<p>two", "one\n\ntwo"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
        ("<table><tr><th>Name<th>N<tr><td>alpha<td>1<tr><td>be<td>22</table>", "Name   N\nalpha  1\nbe     22"),
        ("<div hidden>no</div><div style='display:none'>no</div>a<script>b</script><!-- c --> <b>d</b>", "a d"),
        ("<pre>  x\n y</pre>", "  x\n y"),
        ("x<br>y &lt;z&gt; 3 < 4", "x\ny <z> 3 < 4"),
        ("</div><b>a</i></b></p>b", "a\n\nb"),
        ("<title>t</title><h1>H</h1>text", "H\n\ntext"),
        ("", ""),
        ("<td>stray</td><li>item", "stray\n- item"),
    ],
)
def test_html(page, text):
    assert html_text.render(html_text.parse(page)) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("a <math><semantics><mrow> <mi> x </mi> <mo>=</mo> <mfrac><mn>1</mn><mn>2</mn></mfrac></mrow><annotation>x=\\frac12</annotation></semantics></math> b", "a x=1 / 2 b"),
        ("a<math display=block><mtext>if  so</mtext><mphantom><mi>q</mi></mphantom></math>b<math hidden><mi>z</mi></math>", "a\nif so\nb"),
        ("a<svg><title>t</title><desc>d</desc><defs><text>no</text></defs><g><text x=1>Sales <tspan>up</tspan></text><text>2024<tspan dy=1>Q1</tspan></text></g><text display=none>no</text>stray<path d='M0'/></svg>b", "a Sales up 2024 Q1 b"),
        ("<svg><title/><foreignObject><p>page</foreignObject></svg> end", "page\n\nend"),
        ("<table><tr><th>A<th>B<th>C<tr><td rowspan=2>1<td>2<td>3<tr><td>4<td>5<tr><td>6<td>7<td>8</table>", "A  B  C\n1  2  3\n   4  5\n6  7  8"),
        ("<table><tbody><tr><td>a<td rowspan=0 colspan=2>b<td>c<tr><td>d<td>e<tr><td>f<td>g<tbody><tr><td>h<td>i<td>j<td>k</table>", "a  b     c\nd        e\nf        g\nh  i  j  k"),
        ("<table><tr><td rowspan=9>a<table><tr><td>x</td></tr></table></td><td>b</td></tr><tr><td>c</td></tr></table>", "a  b\n\nx\n   c"),
    ],
)
def test_html_formulas_drawings_and_spans(page, text):
    assert html_text.render(html_text.parse(page)) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<style>.x{display:none} #y , b.z {visibility:hidden} @media print{p{display:none}}</style><p class='a x'>no<p id=y>no<b class=z>no</b><p>yes<b>yes</b>", "yesyes"),
        ("<style>p{display:none}.k{display:block}</style><p>no<p class=k>yes<p class=k style='display:none'>no", "yes"),
        ("<div style='visibility:hidden'>no <span style='visibility:visible'>yes</span> no</div>z", "yes\nz"),
        ("<table><tr><td>a<td style='visibility:hidden'>bb<td>c<tr><td>d<td>eee<td>f</table>", "a       c\nd  eee  f"),
        ("<table><tr><td>" + "word " * 40 + "<td>end<tr><td>x<td>y</table>", " ".join(["word"] * 16) + "  end\n" + " ".join(["word"] * 16) + "\n" + " ".join(["word"] * 8) + "\nx" + " " * 80 + "y"),
        ("<b><table><td><i>1</b>2</i></table>3", "12\n\n3"),
        ("<p>a<table><tr><td><p>b</p></table></p>c", "a\n\nb\n\nc"),
    ],
)
def test_html_styles_and_cells(page, text):
    assert html_text.render(html_text.parse(page)) == text


def seen_words(page):
    """Words outside of tags of a page that hides nothing."""
    return re.findall(r"\w+", re.sub(r"<[^>]*>", " ", page))


def test_html_keeps_all_words_in_order():
    """Random pages of nested elements: every word comes out, in order but for tables, within a fixed time when nested deeply."""
    rng = np.random.default_rng(9)
    tags = "div p ul ol li span b blockquote dl dd dt h2 section table tr td th tbody pre em".split()
    for _ in range(300):
        page = "".join(f"<{'/' if rng.random() < 0.35 else ''}{tags[rng.integers(len(tags))]}> w{i} " for i in range(rng.integers(1, 60)))
        got = re.findall(r"w\d+", html_text.render(html_text.parse(page)))
        assert sorted(got) == sorted(seen_words(page)) and ("<t" in page or got == seen_words(page))
    import time

    began = time.perf_counter()
    for tag in ("div", "ul><li", "b", "table><tr><td", "blockquote", "p><b"):
        page = f"<{tag}>x " * 50_000 + "</p></td></b>" * 20_000
        text = html_text.render(html_text.parse(page))
        assert text.count("x") == 50_000 and len(text) < 12_000_000
    assert time.perf_counter() - began < 120


def test_html_rows(spark):
    deep = "<div>" * 20_000 + "x"
    df = spark.createDataFrame([(1, None, 0), (2, deep, 0), (2, deep, 0), (None, "<p>a", 0)], "page_id long, html string, title int")
    rows = html_text.extract_text(df).collect()
    assert sorted((str(r.page_id), r.text) for r in rows) == [("1", None), ("2", "x"), ("2", "x"), ("None", "a")]
    assert html_text.extract_text(df.limit(0)).count() == 0


# --- pipeline ----------------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs, kept = docs_of(spark), {}
    names = docs.columns
    for name, stage in pipeline.STAGES:
        before = docs
        docs = pipeline.settle(lambda: stage(spark, before, SF), name)  # noqa: B023
        kept[name] = docs
        if name != "packing":
            assert docs.columns == names and docs.join(before, "doc_id", "left_anti").count() == 0
    lines = kept["language_id"].select("doc_id", "text").collect()
    by_hand = {(i, d) for i, _, _, d in lines_by_hand([(r.doc_id, r.text) for r in lines])}
    assert {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in kept["line_dedup"].collect()} == by_hand
    rows = kept["line_dedup"].select("doc_id", "text").collect()
    roots = components_by_hand([r.doc_id for r in rows], [simhash_by_hand(r.text) for r in rows])
    assert {r.doc_id for r in kept["simhash_dedup"].collect()} == set(roots)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r[0] for r in overlap_by_hand([(r.doc_id, r.text) for r in kept["simhash_dedup"].collect()], bench) if not r[5]}
    assert {r.doc_id for r in kept["decontaminate"].collect()} == clean
    check_packing(kept["packing"].collect(), [(r.doc_id, r.text) for r in kept["decontaminate"].collect()])


def test_stages_on_odd_rows(spark):
    """Each stage by itself on nulls, empty and long texts, repeated rows, clashing columns and no rows at all."""
    import corpus_pipeline as pipeline

    df, rows = odd_docs(spark)
    labelled = spark.createDataFrame([(1000 + i, f"the quick brown fox {i} jumps over the lazy dog again and again", "en", "s", 60, "clash", "clash") for i in range(30)], SCHEMA)
    stages = dict(pipeline.STAGES)
    # Nothing is labelled: nothing is told.
    assert stages["language_id"](spark, df, SF).count() == 0
    kept = stages["language_id"](spark, df.unionByName(labelled), SF)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {1000 + i for i in range(30)} and kept.where("text IS NULL OR trim(text) = ''").count() == 0
    lines = {r.doc_id: r for r in stages["line_dedup"](spark, df, SF).collect()}
    assert lines[1].text is None and lines[2].text == "" and lines[100].text == "own 0" and lines[100].n_chars == 5 and lines[7].n_chars is None
    near = stages["simhash_dedup"](spark, df, SF)
    roots = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert sorted({r.doc_id for r in near.collect()}, key=str) == sorted({i for i, root in roots.items() if i == root}, key=str) and near.where("doc_id = 5").count() == 2
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    twice = df.unionByName(spark.createDataFrame([(7, "so " + bench, None, "s", None, "clash", "clash")], SCHEMA))
    assert sorted((str(r.doc_id), r.text or "") for r in stages["decontaminate"](spark, twice, SF).collect()) == sorted((str(i), t or "") for i, t in rows)
    packed = stages["packing"](spark, df, SF).collect()
    check_packing(packed, [(i, t) for i, t in rows])
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty(spark), SF).count() == 0, name
