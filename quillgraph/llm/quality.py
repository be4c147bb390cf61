"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

The statistics of a sample of labelled texts are written once. Their mean and spread, and the normal
equations of the ridge fit, are sums over partitions of these rows; random Fourier features stand for
a Gaussian kernel. Scores become probabilities by isotonic regression over bins of the training
scores. Then one pass over all whole texts describes and scores them; no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch, prepare
from .words import NOT_SPACE, slices

TRAIN_ROWS = 200_000
SUM_PARTS = 16
FOURIER = 384
BINS = 1000
RIDGE = 1e-3

STATISTICS = (
    "log_words", "word_length", "word_length_spread", "upper", "title_words", "digits", "punctuation", "symbols", "exclamations", "ends_marked",
    "distinct_words", "top_word", "repeated_lines", "line_length", "non_ascii", "log_chars", "distinct_pairs", "short_words", "symbol_words", "stops",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[]^_{|}~\\"]] = True


def statistics(column) -> Iterator[np.ndarray]:
    """One vector of STATISTICS for each text."""
    for part in slices(column):
        raw = part.data
        words = part.words(NOT_SPACE)
        hashes = words.hashes()
        lengths = words.ends - words.starts
        sums = {name: np.r_[0, np.cumsum(t[raw])] for name, t in (("upper", _UPPER), ("digit", _DIGIT), ("punct", _PUNCT), ("symbol", _SYMBOL))}
        for name, byte in (("bang", 33), ("stop", 46), ("line", 10)):
            sums[name] = np.r_[0, np.cumsum(raw == byte)]
        high = np.r_[0, np.cumsum(raw >= 128)]
        last = raw[words.ends - 1] if len(words) else raw[:0]
        marked, title = _PUNCT[last], _UPPER[raw[words.starts]] if len(words) else raw[:0].astype(bool)
        symbol_words = _SYMBOL[last]
        pairs = hashes[:-1] * np.uint64(3) + hashes[1:]
        for i in range(len(part)):
            a, b = int(part.offsets[i]), int(part.offsets[i + 1])
            lo, hi = int(words.first[i]), int(words.first[i + 1])
            size, n = max(1, b - a), hi - lo
            if not n:
                yield np.zeros(len(STATISTICS))
                continue
            count = lambda name: float(sums[name][b] - sums[name][a])  # noqa: B023, E731
            own = lengths[lo:hi]
            distinct, times = np.unique(hashes[lo:hi], return_counts=True)
            breaks = np.flatnonzero(raw[a:b] == 10)
            if len(breaks):
                text = raw[a:b].tobytes().split(b"\n")
                filled = [x for x in text if x]
                repeated = 1 - len(set(filled)) / max(1, len(filled))
            else:
                repeated = 0.0
            yield np.array([
                np.log1p(n), own.mean(), own.std(), count("upper") / size, title[lo:hi].mean(), count("digit") / size, count("punct") / size,
                count("symbol") / size, count("bang") / n, marked[lo:hi].mean(), len(distinct) / n, times.max() / n, repeated,
                np.log1p(size / (1 + len(breaks))), float(high[b] - high[a]) / size, np.log1p(size),
                len(np.unique(pairs[lo : hi - 1])) / max(1, n - 1), (own <= 3).mean(), symbol_words[lo:hi].mean(), count("stop") / n,
            ])


def _describe(batches):
    for batch in batches:
        rows = [s.tobytes() for s in statistics(batch.column("text"))]
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.binary())], [*batch.schema.names[:-1], "x"])


class Fourier:
    """cos(w.x + b) of standardized statistics: products of two approximate a Gaussian kernel of their distance."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, size: int = FOURIER, width: float = 4.0, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = rng.normal(size=(len(mean), size)) / width
        self.b = rng.uniform(0, 2 * np.pi, size)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), z / 10, np.ones((len(x), 1))])


def _stack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _sum_moments(batches):
    n, s, q = 0, np.zeros(len(STATISTICS)), np.zeros(len(STATISTICS))
    for batch in batches:
        if len(batch):
            x = _stack(batch.column("x"))
            n, s, q = n + len(x), s + x.sum(axis=0), q + (x * x).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array([np.r_[n, s, q].tobytes()], pa.binary())], ["sums"])


def _sum_equations(fourier: Fourier):
    def run(batches):
        size = len(fourier.b) + len(fourier.mean) + 1
        gram, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            if len(batch):
                f, y, w = fourier(_stack(batch.column("x"))), batch.column("y").to_numpy(), batch.column("w").to_numpy()
                gram += (f * w[:, None]).T @ f
                right += f.T @ (w * y)
        yield pa.RecordBatch.from_arrays([pa.array([np.r_[gram.ravel(), right].tobytes()], pa.binary())], ["sums"])

    return run


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to values, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else np.zeros(0)


class Model:
    def __init__(self, fourier: Fourier, weights: np.ndarray):
        self.fourier, self.weights = fourier, weights
        self.at, self.levels = np.zeros(1), np.array([0.5])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability, linear between bins; where it is level, the raw score keeps the order."""
        if not self.weights.any():
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        level = np.interp(raw, self.at, self.levels)
        return np.clip(0.9998 * level + 1e-4 * (1 + np.tanh(raw - 0.5)), 0.0, 1.0)


def _with_score(model: Model):
    """(y, raw score) of rows (y, x)."""

    def run(batches):
        for batch in batches:
            raw = model.raw(_stack(batch.column("x"))) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(raw, pa.float64())], ["y", "score"])

    return run


def _score_texts(model: Model, at: int):
    """Rows as they come and the score of their text, column number `at`."""

    def run(batches):
        for batch in batches:
            x = np.array(list(statistics(batch.column(at)))).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x), pa.float64())], [*batch.schema.names, "score"])

    return run


def _total(parts: DataFrame, size: int) -> np.ndarray:
    """Sum of one vector a partition; at most SUM_PARTS of them reach the driver."""
    out = np.zeros(size)
    for row in parts.toLocalIterator():
        out += np.frombuffer(row["sums"], np.float64)
    return out


def sample(docs: DataFrame, labels: DataFrame, train_on: Column, scratch: Scratch, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, y, x) of labelled documents, written in SUM_PARTS parts.

    Beyond max_rows labels, a share of them is chosen by a hash of doc_id before the join, so what
    is broadcast has that bound and only labelled texts are described.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("y")).dropna().filter(train_on)
    n = known.count()
    if n > max_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(known), "doc_id").select("doc_id", "y", "text").mapInArrow(_describe, "doc_id bigint, y double, x binary")
    return scratch.keep(found.repartition(SUM_PARTS, "doc_id"))


def train(rows: DataFrame) -> Model:
    """Fit on rows (y, x); repeated rows count as often as they stand. Without rows every score is 0.5."""
    d = len(STATISTICS)
    moments = _total(rows.select("x").mapInArrow(_sum_moments, "sums binary"), 2 * d + 1)
    seen = max(1.0, moments[0])
    mean = moments[1 : d + 1] / seen
    fourier = Fourier(mean, np.sqrt(np.maximum(0, moments[d + 1 :] / seen - mean**2)))
    size = len(fourier.b) + d + 1
    if not moments[0]:
        return Model(fourier, np.zeros(size))
    balance = rows.agg(F.avg("y")).first()[0]
    heavy = F.when(F.col("y") > 0, F.lit(0.5 / max(balance, 1e-6))).otherwise(F.lit(0.5 / max(1 - balance, 1e-6)))
    weighted = rows.select("x", "y", heavy.alias("w"))
    sums = _total(weighted.mapInArrow(_sum_equations(fourier), "sums binary"), size * size + size)
    gram = sums[: size * size].reshape(size, size)
    gram[np.diag_indices(size)] += RIDGE * seen
    model = Model(fourier, np.linalg.solve(gram, sums[size * size :]))
    scored = rows.select("y", "x").mapInArrow(_with_score(model), "y double, score double")
    bins = scored.groupBy(F.round(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), "score")) * (BINS / 3)).alias("bin")).agg(F.avg("y").alias("y"), F.count("*").alias("n"), F.avg("score").alias("at")).orderBy("bin").collect()
    levels = isotonic(np.array([b["y"] for b in bins]), np.array([float(b["n"]) for b in bins]))
    model.at, model.levels = np.array([b["at"] for b in bins]), levels
    return model


def scored(docs: DataFrame, labels: DataFrame, train_on: Column, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs with their columns as c0, c1 and so on, and `score`: how likely the label is 1, from 0 to 1.

    docs: doc_id and text; labels: doc_id and quality; train_on: which labelled doc_ids to learn
    from. Null and empty texts have all statistics 0 and are scored like any other; rows with a null
    doc_id are scored but not learned from; null labels are not learned from. Without labelled rows
    every score is 0.5. Repeated rows count as often as they stand, and get equal scores. Texts are
    described whole, however long. An empty table gives an empty table.
    """
    spark = prepare(docs.sparkSession)
    model = train(sample(docs, labels, train_on, Scratch(spark, "quality"), max_rows))
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(_score_texts(model, docs.columns.index("text")), T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, train_on: Column, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, score) for each row of docs; other columns are ignored. Edge cases as in scored."""
    return scored(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), labels, train_on, max_rows).select(F.col("c0").alias("doc_id"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, train_on: Column, least: float) -> DataFrame:
    """Rows of docs with a score of at least `least`, columns as given. Edge cases as in scored."""
    found = scored(docs, labels, train_on)
    return found.filter(F.col("score") >= least).drop("score").toDF(*docs.columns)


def held_out() -> Column:
    """Rows that are never learned from; a null doc_id is one of the others, though it has no label to learn."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """quality_scores of documents, learned from labels.quality of rows not held out: a row a document. Edge cases as in scored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
