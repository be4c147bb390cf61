"""Toxic spans by a linear-chain conditional random field; marginals give document scores.

Labels are by document, so words are labelled first: among words and word beginnings that occur in
toxic documents almost only, those that explain the toxic documents are picked greedily (each one
explains two words of as many unexplained documents as possible), and their occurrences in toxic
documents are the toxic words. The chain is fitted to these, and scores every word of every text.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, prepare
from .crf import Chain, Runs
from .words import LETTER_OR_DIGIT, Words, mix, slices

TRAIN_ROWS = 12_000
FEATURES = 4000
PREFIXES = (4, 5, 6)
KINDS = 1 + len(PREFIXES)


def _hashed(words: Words) -> np.ndarray:
    """Hashes of each word and of its beginnings; 0 where the word is no longer than that."""
    out = np.zeros((len(words), KINDS), dtype=np.uint64)
    out[:, 0] = words.hashes()
    ends = words.ends
    for i, k in enumerate(PREFIXES, 1):
        words.ends = np.minimum(ends, words.starts + k)
        out[:, i] = np.where(ends - words.starts > k, mix(words.hashes() + np.uint64(i)), 0)
    words.ends = ends
    return out


def _mentions(batches):
    """(feature, y) once for each document."""
    for batch in batches:
        features, labels = [], []
        for part in slices(batch.column("text")):
            words = part.words(LETTER_OR_DIGIT)
            hashed = _hashed(words)
            for i in range(len(part)):
                own = np.unique(hashed[words.first[i] : words.first[i + 1]])
                features.append(own[own > 0].view(np.int64))
                labels.append(np.full(len(features[-1]), batch.column("y")[part.lo + i].as_py(), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*features, np.zeros(0, np.int64)])), pa.array(np.concatenate([*labels, np.zeros(0, np.int32)]))], ["feature", "y"])


class Lexicon:
    """Features by their hashes, with indexes from 1."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.sort(hashes)
        self.maybe = np.zeros(1 << 18, dtype=bool)
        self.maybe[self.sorted >> np.uint64(46)] = True

    def index(self, hashed: np.ndarray) -> np.ndarray:
        out = np.zeros(hashed.shape, dtype=np.int64)
        some = np.nonzero(self.maybe[hashed >> np.uint64(46)])
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, hashed[some]), len(self.sorted) - 1)
            out[some] = np.where(self.sorted[at] == hashed[some], at + 1, 0)
        return out


def _sequences(lexicon: Lexicon):
    """(y, n, places, features): of each document the words that have a feature."""

    def run(batches):
        for batch in batches:
            rows = []
            for part in slices(batch.column("text")):
                words = part.words(LETTER_OR_DIGIT)
                index = lexicon.index(_hashed(words))
                for i in range(len(part)):
                    own = index[words.first[i] : words.first[i + 1]]
                    places = np.flatnonzero(own.any(axis=1))
                    rows.append((batch.column("y")[part.lo + i].as_py(), len(own), places.astype(np.int32).tobytes(), own[places].astype(np.int32).tobytes()))
            types = {"y": pa.int32(), "n": pa.int32(), "places": pa.binary(), "features": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types.values())], list(types))

    return run


def _explain(documents: list[tuple[np.ndarray, np.ndarray]], least: int) -> set[int]:
    """Features that together cover two words of most toxic documents, each new in at least `least` of them.

    Gains only fall as features are chosen, so a feature is counted again only when it comes first.
    """
    where: dict[int, list[int]] = {}
    for i, (_, features) in enumerate(documents):
        for f in np.unique(features[features > 0]).tolist():
            where.setdefault(f, []).append(i)
    need = np.full(len(documents), 2)
    heap = [(-len(docs), f) for f, docs in where.items()]
    heapq.heapify(heap)
    chosen: set[int] = set()
    while heap:
        f = heapq.heappop(heap)[1]
        gain = int((need[where[f]] > 0).sum())
        if gain < least:
            continue
        if heap and (-gain, f) > heap[0]:
            heapq.heappush(heap, (-gain, f))
        else:
            chosen.add(f)
            need[where[f]] -= 1
    return chosen


def _runs(found: list[tuple[int, int, np.ndarray, np.ndarray]], chosen: np.ndarray) -> Runs:
    """All documents as runs: their words with a feature, labelled, and how many words stand between."""
    end = np.zeros((1, KINDS), dtype=np.int32)
    gaps = np.concatenate([np.diff(np.r_[-1, places, n]) - 1 for _, n, places, _ in found])
    features = np.concatenate([part for _, _, _, own in found for part in (own, end)]).astype(np.int64)
    lengths = np.array([len(places) + 1 for _, _, places, _ in found])
    toxic = np.repeat([y == 1 for y, _, _, _ in found], lengths)
    return Runs(gaps, features, (np.isin(features, chosen).any(axis=1) & toxic).astype(np.int64), lengths)


class Model:
    def __init__(self, lexicon: Lexicon, chain: Chain):
        self.lexicon, self.chain = lexicon, chain


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, rows: int = TRAIN_ROWS, features: int = FEATURES) -> Model:
    """Fit on at most about `rows` labelled documents, a third of them toxic if there are enough.

    features: how many pure words and word beginnings, the most frequent ones, can get a weight.
    The chain is fitted on every word of all of these documents; the driver holds only the words
    with a feature and how many stand between.

    docs: doc_id and text; labels: doc_id and y. Labels are sampled by a hash of doc_id before the
    join, so the sample's bound holds for what is broadcast, and only the sample's texts move.
    """
    known = labels.dropna(subset=["doc_id", "y"]).groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not counts.get(1) or not counts.get(0):
        return Model(Lexicon(np.zeros(0, np.uint64)), Chain(1))
    part = {1: rows / 3 / counts[1], 0: rows * 2 / 3 / counts[0]}
    share = F.when(F.col("y") == 1, F.lit(part[1])).otherwise(F.lit(part[0]))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text <> ''")
    sample = scratch.keep(texts.groupBy("text").agg(F.max("y").alias("y")))
    toxic, clean = sample.filter("y = 1").count(), sample.filter("y = 0").count()
    if not toxic or not clean:
        return Model(Lexicon(np.zeros(0, np.uint64)), Chain(1))
    least = max(2, round(0.003 * toxic))
    # a feature is as pure as its documents, with the two classes weighed alike
    bad, good = F.sum("y"), F.sum(1 - F.col("y"))
    mentions = sample.select("y", "text").mapInArrow(_mentions, "feature bigint, y int")
    counted = mentions.groupBy("feature").agg(bad.alias("bad"), good.alias("good")).filter(F.col("bad") >= least)
    pure = counted.filter(F.col("bad") / toxic >= 99 * F.col("good") / clean)
    top = pure.orderBy(F.desc("bad"), "good", "feature").limit(features).collect()
    lexicon = Lexicon(np.array([r["feature"] for r in top], dtype=np.int64).view(np.uint64))
    found = [
        (r["y"], r["n"], np.frombuffer(r["places"], np.int32), np.frombuffer(r["features"], np.int32).reshape(-1, KINDS))
        for r in sample.select("y", "text").mapInArrow(_sequences(lexicon), "y int, n int, places binary, features binary").toLocalIterator()
    ]
    found.sort(key=lambda r: (r[1], r[2].tobytes(), r[3].tobytes()))
    chosen = np.array(sorted(_explain([(p, f) for y, _, p, f in found if y == 1], least)), dtype=np.int64)
    chain = Chain(len(lexicon.sorted) + 1)
    found = [r for r in found if r[1]]
    if found:
        chain.fit(_runs(found, chosen))
    return Model(lexicon, chain)


def _tag(model: Model):
    def run(batches):
        for batch in batches:
            scores, spans = [], []
            for part in slices(batch.column("text")):
                words = part.words(LETTER_OR_DIGIT)
                starts = np.zeros(len(words), dtype=bool)
                starts[words.first[:-1][words.first[:-1] < len(words)]] = True
                p = model.chain.marginals(model.lexicon.index(_hashed(words)), starts) if len(words) else np.zeros(0)
                none = np.log1p(-np.minimum(np.where(p >= 0.05, p, 0), 1 - 1e-9))
                sums = np.r_[0, np.cumsum(none)]
                scores += (-np.expm1(sums[words.first[1:]] - sums[words.first[:-1]])).tolist()
                hits = np.flatnonzero(p >= 0.5)
                owner = np.searchsorted(words.first, hits, side="right") - 1
                of = {}
                for h, d in zip(hits.tolist(), owner.tolist(), strict=True):
                    of.setdefault(d, []).append(h)
                for d in range(len(part)):
                    out = []
                    if d in of:
                        at = int(part.offsets[d])
                        chars = np.r_[0, np.cumsum((part.data[at : int(part.offsets[d + 1])] & 0xC0) != 0x80)]
                        for h in of[d]:
                            a, b = int(chars[words.starts[h] - at]), int(chars[words.ends[h] - at])
                            if out and h - 1 == last:
                                out[-1]["end"] = b
                            else:
                                out.append({"start": a, "end": b})
                            last = h
                    spans.append(out)
            scores = np.abs(np.clip(scores, 0.0, 1.0))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    return run


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, spans) for each row of docs; spans: code points of toxic words, neighbours joined.

    score is the probability that some word is toxic, of words with a marginal of 0.05 or more.
    docs: doc_id and text; other columns are ignored. Texts are tagged whole, however long, in slices
    of whole texts. A null or wordless text scores 0 without spans; so does every text when nothing was learned. Equal texts get equal results. An empty
    table gives an empty table.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_tag(model), "doc_id bigint, score double, spans array<struct<start:bigint,end:bigint>>")


def held_out() -> Column:
    """Rows that are never learned from; a null doc_id is one of the others, though it has no label to learn."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """tag of documents, learned from labels.toxic of rows not held out: a row a document. Edge cases as in tag and train."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out()).select("doc_id", F.col("toxic").alias("y"))
    model = train(docs, labels, Scratch(prepare(spark), "toxic"))
    found = tag(docs, model)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), spans.alias("spans"))
