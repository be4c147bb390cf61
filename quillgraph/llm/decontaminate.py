"""Benchmark decontamination with an FM-index per shard of the training texts.

A shard is a slice of a partition's texts. Its words that occur in the benchmark get a symbol; runs
of such words, as long as the shortest window at least, form the indexed text (others cannot hold
a window). Backward search through wavelet ranks finds the windows that occur, sampled suffix
positions tell where, and the places merge into spans. Texts are not shuffled. Equal benchmark
texts are one, long ones are cut so that every window is in a piece, and pieces are dealt to blocks
of about BLOCK_BYTES, each collected and broadcast by itself. A task reads a text once and looks for
one block after the other; a benchmark of more than PASS_BYTES takes one more pass over the texts
for each further PASS_BYTES, with what was found so far written between.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch, prepare
from .fm_index import FMIndex
from .words import LETTER_OR_DIGIT, slices

BLOCK_BYTES = 2 << 20
PASS_BYTES = 64 << 20
PIECE_WORDS = 50_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARD_BYTES = 1 << 20

SPAN = "struct<first_word:bigint,end_word:bigint,first_char:bigint,end_char:bigint>"
LEAK = f"struct<n_words:bigint,spans:array<{SPAN}>,items:array<string>>"
_SPAN_ARROW = pa.struct([(c, pa.int64()) for c in ("first_word", "end_word", "first_char", "end_char")])
_LEAK_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_SPAN_ARROW)), ("items", pa.list_(pa.string()))])


class Block:
    """Some benchmark pieces as word hashes, as small as it is broadcast; ids: the items of each piece."""

    def __init__(self, ids: list[list[str]], texts: pa.Array, width: int):
        self.ids, self.width = ids, width
        hashes, sizes = [np.zeros(0, np.uint64)], []
        for part in slices(texts):
            words = part.words(LETTER_OR_DIGIT)
            hashes.append(words.hashes())
            sizes += words.counts().tolist()
        self.hashes, self.sizes = np.concatenate(hashes), np.array(sizes, dtype=np.int64)


class Windows:
    """The windows of a block by length, over a vocabulary of their words; owners: the pieces that have each."""

    def __init__(self, block: Block):
        self.ids = block.ids
        self.vocabulary, symbols = np.unique(block.hashes, return_inverse=True)
        symbols = symbols + 1
        first = np.cumsum(block.sizes) - block.sizes
        self.by_length = []
        for size in np.unique(np.minimum(block.sizes, block.width)):
            if not size:
                continue
            pieces = np.flatnonzero(np.minimum(block.sizes, block.width) == size)
            several = block.sizes[pieces] - size + 1
            owner = np.repeat(pieces, several)
            begin = np.arange(len(owner)) - np.repeat(np.cumsum(several) - several, several) + np.repeat(first[pieces], several)
            rows, which = np.unique(symbols[begin[:, None] + np.arange(size)], axis=0, return_inverse=True)
            order = np.argsort(which.ravel(), kind="stable")
            cuts = np.searchsorted(which.ravel()[order], np.arange(len(rows) + 1))
            self.by_length.append((rows, (owner[order], cuts)))
        self.shortest = min((p.shape[1] for p, _ in self.by_length), default=0)
        # a small table of hash prefixes spares most words the search in the vocabulary
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self.vocabulary >> np.uint64(44)] = True

    def items(self, owners: tuple[np.ndarray, np.ndarray], window: int) -> set[str]:
        owner, cuts = owners
        return {i for piece in np.unique(owner[cuts[window] : cuts[window + 1]]).tolist() for i in self.ids[piece]}

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """1 and up for words of the benchmark, 0 for others."""
        out = np.zeros(len(hashes), dtype=np.int64)
        some = np.flatnonzero(self.maybe[hashes >> np.uint64(44)])
        if len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[some]), len(self.vocabulary) - 1)
            out[some] = np.where(self.vocabulary[at] == hashes[some], at + 1, 0)
        return out


def _occurrences(words, hashes: np.ndarray, windows: Windows) -> list[tuple[np.ndarray, np.ndarray, int, tuple]]:
    """(window index, first word, length, owners by window) of all windows in a shard."""
    symbols = windows.symbols(hashes)
    n = len(symbols)
    known = symbols > 0
    starts = np.zeros(n, dtype=bool)
    starts[words.first[:-1][words.first[:-1] < n]] = True
    begin = np.flatnonzero(known & (starts | ~np.r_[False, known[:-1]]))
    end = np.flatnonzero(known & (np.r_[starts[1:], True] | ~np.r_[known[1:], False])) + 1
    keep = end - begin >= windows.shortest
    begin, length = begin[keep], (end - begin)[keep]
    if not len(begin):
        return []
    # each run and a 0 after it
    first = np.cumsum(length + 1) - (length + 1)
    total = int((length + 1).sum())
    place = np.arange(total) - np.repeat(first, length + 1) + np.repeat(begin, length + 1)
    last = first + length
    text = symbols[np.minimum(place, n - 1)]
    text[last] = 0
    index = FMIndex(text, len(windows.vocabulary) + 1)
    out = []
    for patterns, owners in windows.by_length:
        which, low, high = index.search(patterns)
        if len(which):
            of, places = index.locate(low, high)
            out.append((which[of], place[places], patterns.shape[1], owners))
    return out


def _scan(blocks: list, text_at: int, before_at: int | None):
    """blocks: broadcast Blocks. A worker holds the windows of the latest few."""

    def run(batches):
        held: dict[int, Windows] = {}

        def windows_of(i: int) -> Windows:
            if i not in held:
                while len(held) >= 2:
                    held.pop(next(iter(held)))
                held[i] = Windows(blocks[i].value)
            return held[i]

        for batch in batches:
            n_words, spans, items = [], [], []
            before = batch.column(before_at).to_pylist() if before_at is not None else None
            for part in slices(batch.column(text_at), SHARD_BYTES):
                words = part.words(LETTER_OR_DIGIT)
                hashes = words.hashes()
                n_words += words.counts().tolist()
                of_doc: dict[int, set[str]] = {}
                edges = np.zeros(len(words) + 1, dtype=np.int64)
                for at in range(len(blocks)):
                    windows = windows_of(at)
                    for which, start, size, owners in _occurrences(words, hashes, windows):
                        np.add.at(edges, start, 1)
                        np.add.at(edges, start + size, -1)
                        doc = np.searchsorted(words.first, start, side="right") - 1
                        for d, w in set(zip(doc.tolist(), which.tolist(), strict=True)):
                            of_doc.setdefault(d, set()).update(windows.items(owners, w))
                covered = np.cumsum(edges)[:-1] > 0
                for d in range(len(part)):
                    earlier = before[part.lo + d] if before else None
                    if d not in of_doc and not (earlier and earlier["spans"]):
                        spans.append([])
                        items.append([])
                        continue
                    lo, hi = int(words.first[d]), int(words.first[d + 1])
                    hit = covered[lo:hi].copy()
                    for s in earlier["spans"] if earlier else []:
                        hit[s["first_word"] : s["end_word"]] = True
                    flips = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
                    a, b = flips[::2], flips[1::2]
                    at = int(part.offsets[d])
                    chars = np.cumsum((part.data[at : int(part.offsets[d + 1])] & 0xC0) != 0x80)
                    chars = np.r_[0, chars]
                    c, e = chars[words.starts[lo + a] - at], chars[words.ends[lo + b - 1] - at]
                    spans.append([dict(first_word=int(w), end_word=int(x), first_char=int(y), end_char=int(z)) for w, x, y, z in zip(a, b, c, e, strict=True)])
                    items.append(sorted(of_doc.get(d, set()) | set(earlier["items"] if earlier else ())))
            leak = pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(_SPAN_ARROW)), pa.array(items, pa.list_(pa.string()))], fields=list(_LEAK_ARROW))
            columns = [c for i, c in enumerate(batch.columns) if i != before_at]
            yield pa.RecordBatch.from_arrays([*columns, leak], [*(f"c{i}" for i in range(len(columns))), "leak"])

    return run


def pieces(benchmark: DataFrame, width: int) -> DataFrame:
    """(piece, items): words of equal item texts, in pieces of at most PIECE_WORDS windows each; items: their ids as text."""
    low = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    same = benchmark.groupBy("text").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    words = same.select("items", F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1), F.lit(PIECE_WORDS))
    return words.select("items", "w", F.explode(starts).alias("at")).select(F.array_join(F.slice("w", F.col("at"), F.lit(PIECE_WORDS + width - 1)), " ").alias("piece"), "items")


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES, into: str = "leak") -> DataFrame:
    """docs and one more column `into`: words counted, merged spans of hit words, and the items that occur.

    A window is `width` consecutive words of an item, or the whole of a shorter one. spans hold word
    numbers and code points, ends exclusive; items are item_ids as text, distinct and sorted.

    A null or wordless text has 0 words and no spans; a null or wordless item has no window; an item
    without an id still marks words but is not listed. Texts and items are taken whole, however long.
    An empty benchmark marks nothing. Other columns pass through; `into` must not be one of them.
    """
    spark = prepare(docs.sparkSession)
    if into in docs.columns:
        raise ValueError(f"docs has a column {into}")
    scratch = Scratch(spark, "leaks")
    found = scratch.keep(pieces(benchmark, width))
    size = found.agg(F.coalesce(F.sum(F.octet_length("piece")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    each = max(1, pass_bytes // block_bytes)
    types, at = [f.dataType for f in docs.schema.fields], docs.columns.index("text")
    schema = T.StructType([*(T.StructField(f"c{i}", t) for i, t in enumerate(types)), T.StructField("leak", T._parse_datatype_string(LEAK))])
    out = docs
    for first in range(0, n, each):
        blocks = []
        for block in range(first, min(n, first + each)):
            some = found.filter(F.pmod(F.xxhash64("piece"), F.lit(n)) == block).toArrow()
            blocks.append(spark.sparkContext.broadcast(Block(some["items"].to_pylist(), some["piece"].combine_chunks(), width)))
        plain = scratch.keep(out.toDF(*schema.names)) if first else out
        out = plain.mapInArrow(_scan(blocks, at, len(types) if first else None), schema)
    return out.toDF(*docs.columns, into)


def n_hit(leak: str) -> Column:
    return F.aggregate(f"{leak}.spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end_word"] - s["first_word"])


def without_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The documents that hold no window of the benchmark, columns as given. Edge cases as in find_leaks."""
    into = "leak"
    while into in docs.columns:
        into += "_"
    return find_leaks(docs, benchmark, width, into=into).filter(F.size(F.col(into)["spans"]) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """find_leaks of documents, a row a document. Edge cases as in find_leaks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        F.col("leak.n_words").alias("n_words"),
        n_hit("leak").alias("n_hit"),
        F.size("leak.items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("leak.items")), 256).alias("items_sha256"),
        (F.size("leak.spans") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH lowered AS (
  SELECT 'd' AS side, CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 'b', CAST(item_id AS VARCHAR), text FROM benchmark
), words AS (
  SELECT side, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM lowered
), windows AS (
  SELECT DISTINCT id AS item, unnest(CASE WHEN len(w) < 10 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) END) AS g
  FROM words WHERE side = 'b' AND len(w) > 0
), sized AS (SELECT item, g, len(string_split(g, ' ')) AS n FROM windows),
lengths AS (SELECT DISTINCT n FROM sized),
places AS (
  SELECT id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM words, lengths WHERE side = 'd' AND len(w) >= n
), grams AS (SELECT id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM places),
hits AS (SELECT id, item, i, grams.n FROM grams JOIN sized USING (g)),
hit_words AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY id),
hit_items AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY id)
SELECT CAST(w.id AS BIGINT) AS doc_id, len(w.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit_words USING (id) LEFT JOIN hit_items USING (id) WHERE w.side = 'd'
"""
