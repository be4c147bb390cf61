"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword; one linear classifier for each bit is fitted on hashed n-gram
frequencies, and a text gets the language whose codeword its bits are nearest to, bits weighted by
how well they hold on the training rows. Close second places are flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import prepare
from .words import slices

BINS = 4096
TRAIN_ROWS = 4000
BUCKETS = 64


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """A matrix of -1 and 1, a row for each of n languages: all splits for few, far-apart random rows for many."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        bits = [[1 if j == 0 else (1 if (m >> (j - 1)) & 1 else -1) for j in range(n)] for m in range(2 ** (n - 1) - 1)]
        return np.array(bits, dtype=float).T
    rng = np.random.default_rng(seed)
    best, gap = None, -1
    for _ in range(max(10, min(200, 100_000 // n))):
        code = rng.choice([-1.0, 1.0], size=(n, max(15, 10 * int(np.ceil(np.log2(n))))))
        apart = code.shape[1] - code @ code.T
        np.fill_diagonal(apart, np.inf)
        if apart.min() > gap and (np.abs(code.sum(axis=0)) < n).all():
            best, gap = code, apart.min()
    return best


def ngram_features(column, bins: int = BINS) -> Iterator[tuple[np.ndarray, bool]]:
    """For each text, square roots of its hashed 1-, 2- and 3-byte frequencies (unit length), and whether it has a letter."""
    multiply = np.array([2654435761, 2246822519, 3266489917], dtype=np.uint32)
    shift = np.uint32(32 - int(np.log2(bins)))
    for part in slices(column):
        data = part.lower().astype(np.uint32)
        h1 = (data + 1) * multiply[0]
        h2 = (h1[:-1] ^ (data[1:] + 7)) * multiply[1] if len(data) > 1 else h1[:0]
        h3 = (h2[:-1] ^ (data[2:] + 13)) * multiply[2] if len(data) > 2 else h1[:0]
        b1, b2, b3 = h1 >> shift, h2 >> shift, h3 >> shift
        letter = ((data >= 97) & (data <= 122)).astype(np.int64)
        letters = np.r_[0, np.cumsum(letter)]
        for i in range(len(part)):
            lo, hi = int(part.offsets[i]), int(part.offsets[i + 1])
            counts = np.zeros(bins)
            for b, k in ((b1, 0), (b2, 1), (b3, 2)):
                if hi - k > lo:
                    counts += np.bincount(b[lo : hi - k], minlength=bins)
            has_letter = letters[hi] > letters[lo] or any(c.isalpha() for c in part.data[lo:hi].tobytes().decode("utf-8", "replace"))
            x = np.sqrt(counts)
            yield x / max(1e-9, float(np.linalg.norm(x))), has_letter


class OutputCode:
    """The fitted code; x, the training rows, is centred in place to spare the driver a copy."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray, ridge: float = 0.05):
        self.languages = languages if len(x) else []
        self.code = codewords(max(1, len(self.languages)))
        self.trust = np.full(self.code.shape[1], 1 / self.code.shape[1])
        self.mean = x.mean(axis=0, dtype=np.float64).astype(np.float32) if len(x) else np.zeros(BINS, np.float32)
        if not len(x):
            self.weights = np.zeros((BINS, self.code.shape[1]))
            return
        share = 1.0 / np.bincount(y, minlength=len(languages))[y]
        share /= share.mean()
        targets = self.code[y]
        x -= self.mean
        # ridge by its dual: as many unknowns as training rows
        gram = (x @ x.T).astype(np.float64)
        gram[np.diag_indices_from(gram)] += ridge * len(x) / 100 / share
        self.weights = x.T @ np.linalg.solve(gram, targets)
        fits = np.exp(-np.maximum(0, 1 - targets * (x @ self.weights))).T @ share / len(x)
        self.trust = fits / fits.sum()

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, ambiguous) by loss-weighted distance from each codeword; nothing learned, nothing sure."""
        if not self.languages:
            return np.zeros(len(x), int), np.zeros(len(x)), np.ones(len(x), bool)
        margins = (x - self.mean) @ self.weights
        losses = np.stack([np.logaddexp(0, -4 * margins * row) @ self.trust for row in self.code], axis=1)
        if losses.shape[1] == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x), bool)
        likely = np.exp(-4 * (losses - losses.min(axis=1, keepdims=True)))
        likely /= likely.sum(axis=1, keepdims=True)
        ordered = np.sort(likely, axis=1)
        return likely.argmax(axis=1), ordered[:, -1], ordered[:, -1] - ordered[:, -2] < 0.2


def _features(batches):
    for batch in batches:
        rows = [x.astype(np.float16).tobytes() for x, _ in ngram_features(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(rows, pa.binary())], ["lang", "x"])


def _predict(model: OutputCode):
    def run(batches):
        for batch in batches:
            names, scores, doubts = [], [], []
            block, letters = [], []

            def flush():
                if not block:
                    return
                which, score, doubt = model.predict(np.stack(block))
                for w, s, d, letter in zip(which, score, doubt, letters, strict=True):
                    names.append(model.languages[w] if letter and model.languages else "und")
                    scores.append(float(s) if letter else 0.0)
                    doubts.append(bool(d) or not letter)
                block.clear()
                letters.clear()

            for x, letter in ngram_features(batch.column("text")):
                block.append(x)
                letters.append(letter)
                if len(block) == 256:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(doubts, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"]
            )

    return run


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> OutputCode:
    """Fit on at most about `rows` texts (text, lang), the same number of each language, one at least, by rank of a hash of the text.

    A language's texts are dealt to buckets, each of which gives those with its least hashes, so a
    language that is most of the rows is ranked in many tasks. Copies of a text in a language count once,
    before the rank. Null texts and null languages are not learned from; nothing labelled, nothing learned.
    """
    known = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("hash", F.xxhash64("text"))
    texts = known.groupBy("lang", "hash").agg(F.count("*").alias("copies"))
    each = max(1, rows // max(1, known.select("lang").distinct().count()))
    buckets = min(BUCKETS, each)
    w = Window.partitionBy("lang", F.pmod("hash", F.lit(buckets))).orderBy("hash")
    ranked = texts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= -(-each // buckets))
    # about `rows` hashes at most, or one a language
    chosen = known.join(F.broadcast(ranked.select("lang", "hash")), ["lang", "hash"], "left_semi")
    found = chosen.groupBy("lang", "hash").agg(F.min("text").alias("text")).mapInArrow(_features, "lang string, x binary").toArrow()
    pairs = sorted(zip(found["lang"].to_pylist(), found["x"].to_pylist(), strict=True))
    languages = sorted({lang for lang, _ in pairs})
    index = {lang: i for i, lang in enumerate(languages)}
    y = np.array([index[lang] for lang, _ in pairs], dtype=int)
    x = np.empty((len(pairs), BINS), dtype=np.float32)
    for i, (_, row) in enumerate(pairs):
        x[i] = np.frombuffer(row, np.float16)
    del found, pairs
    return OutputCode(languages, x, y)


def identify(docs: DataFrame, model: OutputCode) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for each row of docs.

    docs: doc_id and text; other columns are ignored. Whole texts count, however long. A text that is null or has no letter is `und`
    with score 0 and ambiguous; so is every text when nothing was learned. Equal texts get equal
    results. An empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id bigint, lang_pred string, score double, ambiguous boolean")


def held_out() -> Column:
    """Rows that are never learned from; a null doc_id is one of the others."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """identify of documents, learned from lang of rows not held out: a row a document. Edge cases as in identify and train."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(~held_out()).select("text", "lang"))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
