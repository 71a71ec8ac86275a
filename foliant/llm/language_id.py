"""Language identification by nearest centroids of TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import SLICE_BYTES, broadcast_if_few, materialize, slices

#: Rows of each language that the classifier is fitted on, at most; all other work is on all rows.
SAMPLE_ROWS = 400
CENTROIDS = 4
FEATURES = 4096
#: A text is rejected below a share of the cosine that FLOOR_QUANTILE of its language's sample falls below. The longer
#: a text, the surer its cosine: from so many letters on the larger share counts, of samples that are as long.
FLOOR_SHARE, LONG_FLOOR_SHARE, FLOOR_QUANTILE = 0.3, 0.6, 0.005
LETTER_CLASSES = (64, 256, 1024)
#: Samples of a length that say what is usual for it.
LEAST_SAMPLES = 20

UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, 0 where it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _chars(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters or 0 of all texts, offsets of the texts in them)."""
    data = raw.tobytes()
    try:
        text = data.decode()
    except UnicodeDecodeError:
        texts = [data[a:b].decode(errors="replace") for a, b in zip(at[:-1], at[1:], strict=True)]
        at = np.cumsum([0, *map(len, texts)])
        text = "".join(texts)
    else:
        at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _letters()[points], at


def _sequence(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters and single zeros for what stands between them, text of each, number of letters of each text)."""
    n = len(at) - 1
    chars, at = _chars(raw, at)
    of = np.repeat(np.arange(n), np.diff(at))
    letters = np.bincount(of[chars > 0], minlength=n)
    keep = np.ones(len(chars), bool)
    keep[1:] = (chars[1:] > 0) | (chars[:-1] > 0) | (of[1:] != of[:-1])
    return chars[keep].astype(np.uint64), of[keep], letters


def _count(c: np.ndarray, of: np.ndarray, n: int, features: int, known: int = 0) -> np.ndarray:
    """Counts of the hashed n-grams of 1 to 3 characters of each text, but for those within the first known ones."""
    counts = np.zeros(n * features, np.int64)
    with np.errstate(over="ignore"):
        for size in (1, 2, 3):
            m = len(c) - size + 1
            if m <= 0:
                break
            h = np.full(m, np.uint64(size) * np.uint64(0x9E3779B97F4A7C15), np.uint64)
            for i in range(size):
                h = (h ^ c[i : i + m]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            inside = of[:m] == of[size - 1 :]
            if size == 1:
                inside &= c > 0
            inside[: max(0, known - size + 1)] = False
            counts += np.bincount(of[:m][inside] * features + (h[inside] % np.uint64(features)).astype(np.int64), minlength=n * features)
    return counts.reshape(n, features)


def count_ngrams(raw: np.ndarray, at: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts of hashed n-grams of 1 to 3 characters, number of letters) of each text.

    Runs of other characters count as one blank, which may start or end an n-gram.
    """
    c, of, letters = _sequence(raw, at)
    return _count(c, of, len(at) - 1, features), letters


def count_long(raw: np.ndarray, features: int, piece: int = 4 * SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """count_ngrams() of one long text, piece by piece; each goes on from the last two characters of the one before."""
    counts, letters, start = np.zeros((1, features), np.int64), np.zeros(1, np.int64), 0
    tail = np.zeros(0, np.uint64)
    while start < len(raw):
        stop = min(len(raw), start + piece)
        while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
            stop += 1
        c, _, n = _sequence(raw[start:stop], np.array([0, stop - start]))
        if len(tail) and len(c) and tail[-1] == 0 and c[0] == 0:
            c = c[1:]
        c = np.concatenate([tail, c])
        counts += _count(c, np.zeros(len(c), np.int64), 1, features, len(tail))
        letters, tail, start = letters + n, c[-2:], stop
    return counts, letters


#: Texts that are counted at once, at most: each has a row of counts, however short it is.
COUNT_ROWS = 256


def _counted(column: pa.Array, features: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, counts, letters); a long text is counted in pieces."""
    for lo, hi, raw, at in slices(column):
        if hi - lo == 1 and len(raw) > 8 * SLICE_BYTES:
            yield lo, hi, *count_long(raw, features)
            continue
        for i in range(0, hi - lo, COUNT_ROWS):
            j = min(i + COUNT_ROWS, hi - lo)
            yield lo + i, lo + j, *count_ngrams(raw[at[i] : at[j]], at[i : j + 1] - at[i], features)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _class_of(letters: np.ndarray) -> np.ndarray:
    return np.searchsorted(LETTER_CLASSES, letters, "right")


@dataclass
class Model:
    """Centroids of unit length, the language of each, the cosine each asks for by length, and the n-grams' weights."""

    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    floor: np.ndarray
    weights: np.ndarray

    def predict(self, counts: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the language, cosine, rejected) of each row."""
        near = vectors(counts, self.weights) @ self.centroids.T
        best = near.argmax(axis=1)
        score = near[np.arange(len(near)), best]
        return self.owner[best], np.clip(score, 0, 1).astype(float), score < self.floor[best, _class_of(letters)]


def vectors(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts).astype(np.float32) * weights)


def _cluster(x: np.ndarray, k: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds: (centroids, number of the centroid of each row)."""
    seeds = [int((x @ x.mean(axis=0)).argmax())]
    while len(seeds) < min(k, len(x)):
        seeds.append(int((x @ x[seeds].T).max(axis=1).argmin()))
    centroids = x[seeds]
    for _ in range(rounds):
        of = (x @ centroids.T).argmax(axis=1)
        centroids = _unit(np.stack([x[of == j].sum(axis=0) if (of == j).any() else centroids[j] for j in range(len(centroids))]))
    return centroids, (x @ centroids.T).argmax(axis=1)


def fit_language(counts: np.ndarray, letters: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, floors by length) of one language's rows, in an order that the caller fixes."""
    x = vectors(counts, weights)
    own, part = _cluster(x, k)
    near = (x * own[part]).sum(axis=1)
    floors = [FLOOR_SHARE * float(np.quantile(near, FLOOR_QUANTILE))]
    for c in range(1, len(LETTER_CLASSES) + 1):
        like = near[_class_of(letters) >= c]
        floors.append(max(floors[-1], LONG_FLOOR_SHARE * float(np.quantile(like, FLOOR_QUANTILE)) if len(like) >= LEAST_SAMPLES else 0.0))
    return own[[j for j in range(len(own)) if (part == j).any()]], np.array(floors)


def held_out(id_col: str) -> Column:
    """Whether the crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS, centroids: int = CENTROIDS, features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of at most sample_rows rows of each language, chosen by a hash of their ids; None without any.

    Rows whose id is null or held out, whose language is null or whose text has no letter are not
    learned from. All languages are learned: each is a task of its own, and the model has some 64 KB of each. Rows
    are counted by language first, so that the sample is thinned before it is dealt.
    """
    labelled = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sizes = materialize(labelled.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    dice = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(11)), "id", F.xxhash64("text"))
    share = F.least(F.lit(1.0), F.lit(3.0 * sample_rows) / F.col("n"))
    sample = labelled.join(broadcast_if_few(sizes), "lang").where(share > dice).withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, c, letters in _counted(batch.column(2), features):
                rows = np.flatnonzero(letters)
                at = pa.array(lo + rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(letters[rows].astype(np.int64)), pa.array([c[i].astype("<i4").tobytes() for i in rows], pa.binary())], ["lang", "k", "letters", "counts"])

    counted = materialize(sample.select("lang", "k", "text").mapInArrow(count, "lang string, k int, letters long, counts binary"), "language-sample")

    def matrix(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, features)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(features, np.int64), 0
        for batch in batches:
            seen, n = seen + (matrix(batch.column(0)) > 0).sum(axis=0), n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, features)), pa.array(np.concatenate([[n], seen]))], ["feature", "n"])

    total = {r["feature"]: r["n"] for r in counted.select("counts").mapInArrow(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    if not total:
        return None
    weights = (np.log((1 + total[-1]) / (1 + np.array([total[i] for i in range(features)]))) + 1).astype(np.float32)

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        own, floor = fit_language(matrix(table.column("counts")), table.column("letters").to_numpy(), weights, centroids)
        return pa.table({"lang": [table.column("lang")[0].as_py()], "centroids": [own.astype("<f4").tobytes()], "floor": [floor.astype("<f8").tobytes()]})

    got = sorted(counted.groupBy("lang").applyInArrow(learn, "lang string, centroids binary, floor binary").collect(), key=lambda r: r["lang"])
    own = [np.frombuffer(r["centroids"], "<f4").reshape(-1, features) for r in got]
    floors = [np.tile(np.frombuffer(r["floor"], "<f8"), (len(c), 1)) for r, c in zip(got, own, strict=True)]
    return Model([r["lang"] for r in got], np.repeat(np.arange(len(got)), [len(c) for c in own]), np.concatenate(own), np.concatenate(floors), weights)


def classify(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected (columns of those names are replaced).

    lang_pred is the language of the nearest centroid by cosine, score that cosine. A text that is null
    or has no letter is 'und' with score 0 and rejected; so is every text without a model. rejected
    also says that the cosine is below the floor of that centroid. A row's other columns are not looked
    at. Rows are read as a stream, without a shuffle.
    """
    made = ["lang_pred", "score", "rejected"]
    base = docs.drop(*made)
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    names_out = [*base.columns, *made]
    place = base.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            n = batch.num_rows
            lang = np.full(n, UNDETERMINED, object)
            score, rejected = np.zeros(n), np.ones(n, bool)
            if m is not None:
                names = np.array(m.languages, object)
                for lo, hi, counts, letters in _counted(batch.column(place), len(m.weights)):
                    own, s, r = m.predict(counts, letters)
                    some = letters > 0
                    lang[lo:hi][some] = names[own[some]]
                    score[lo:hi][some] = s[some]
                    rejected[lo:hi][some] = r[some]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names_out)

    return base.mapInArrow(run, schema)


def predict_languages(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of each row, by a model of the rows not held out."""
    model = fit(docs, **options)
    rows = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    return classify(rows, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns.

    Null texts and texts without a letter go; so do all rows if none has a language to learn from. Rows of
    one text share their fate, whatever their ids.
    """
    out = classify(docs.select("*"), fit(docs, **options)).where(~F.col("rejected"))
    return out.select(*docs.columns)
