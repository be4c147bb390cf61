"""Exact token counts at every prefix of a text, by dynamic programming over byte-pair merges.

The encoding of a prefix is found from those of shorter prefixes: the last token of a prefix is the
longest vocabulary entry that ends there and may follow the last token of the prefix before it (two
tokens may stand together when encoding their joined bytes gives them back). So one pass gives the
count at every prefix, and any question about truncation or budgets is a look-up. Words repeat, so
the counts inside a word are kept in a bounded cache.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, prepare

CACHE_WORDS = 400_000
LONG = 100

#: The splitting pattern of byte-level vocabularies (fixed value), with white space by its Unicode property.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CONTRACTIONS = ("'re", "'ve", "'ll")
_TWO_SPACES = re.compile(r"\s\s")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and others from code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in printable}
    others = (b for b in range(256) if b not in set(printable))
    return table | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixCounter:
    """Counts for a byte-level byte-pair vocabulary in a tokenizers .json file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_of_char()
        raw = lambda token: bytes(to_byte[c] for c in token)
        special = {t["content"] for t in spec.get("added_tokens", ())}
        # numbers follow the order of merges: single bytes, then each merge's token
        self.number = {bytes([b]): b for b in range(256)}
        self.left, self.right = list(range(256)), list(range(256))
        self.joined: dict[tuple[int, int], int] = {}
        for first, second in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            pair = (self.number[raw(first)], self.number[raw(second)])
            self.joined[pair] = self.number[raw(first) + raw(second)] = len(self.left)
            self.left.append(pair[0])
            self.right.append(pair[1])
        self.longest = max(map(len, self.number))
        self.special = sorted(special, key=len, reverse=True)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if special else None
        self.pattern = regex.compile(SPLIT)
        self.spaces = regex.compile(r"\p{White_Space}{2,}")
        self.pairs: dict[tuple[int, int], bool] = {}
        #: Two generations: when the newer is full it becomes the older, so frequent words stay.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _stay(self, a: int, b: int) -> bool:
        """Whether two tokens side by side stay as they are.

        Both are undone along the border, the later made one first. If the pieces at the border
        would have merged before the pieces grew on, the two tokens never come about together.
        """
        joined, left, right = self.joined, self.left, self.right
        limit = 1 << 60
        while True:
            if joined.get((a, b), limit) < limit:
                return False
            if a > b and a >= 256:
                limit, a = a, right[a]
            elif b >= 256:
                limit, b = b + 1, left[b]
            else:
                return True

    def _may_follow(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 4 * CACHE_WORDS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._stay(a, b)
        return known

    def _word(self, word: str) -> list[int]:
        """Tokens at each prefix of a word, by characters."""
        data = word.encode("utf-8")
        n = len(data)
        last, count = [0] * (n + 1), [0] * (n + 1)
        number, may_follow, longest = self.number.get, self._may_follow, self.longest
        for end in range(1, n + 1):
            for begin in range(max(0, end - longest), end):
                token = number(data[begin:end])
                if token is not None and (not begin or may_follow(last[begin], token)):
                    last[end], count[end] = token, count[begin] + 1
                    break
        if word in CONTRACTIONS:
            count[2] = 2  # a quote and a letter are two words until the second letter comes
        if len(word) == n:
            return count[1:]
        return [count[i] for i in range(1, n + 1) if i == n or data[i] & 0xC0 != 0x80]

    def _counted(self, word: str) -> bytes | np.ndarray:
        """Counts at the prefixes of a word: a byte each from the cache, or an array for a long word."""
        counts = self.words.get(word) or self.older.get(word)
        if counts is None:
            found = self._word(word)
            if len(word) > LONG or max(found) > 255:
                return np.array(found, dtype=np.int32)
            counts = bytes(found)
        if len(self.words) >= CACHE_WORDS:
            self.words, self.older = {}, self.words
        self.words[word] = counts
        return counts

    def _plain(self, text: str) -> np.ndarray:
        """Counts at the prefixes of a text without special tokens, from the empty one on."""
        words = self.pattern.findall(text)
        parts = list(map(self.words.get, words))
        long = False
        if None in parts:
            for i, counts in enumerate(parts):
                if counts is None:
                    parts[i] = counts = self._counted(words[i])
                    long |= isinstance(counts, np.ndarray)
        out = np.zeros(len(text) + 1, dtype=np.int32)
        if words:
            if long:
                inside = np.concatenate([p if isinstance(p, np.ndarray) else np.frombuffer(p, np.uint8) for p in parts]).astype(np.int32)
            else:
                inside = np.frombuffer(b"".join(parts), np.uint8)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            whole = inside[np.cumsum(lengths) - 1].astype(np.int32)
            out[1:] = inside + np.repeat(np.cumsum(whole) - whole, lengths)
        for run in self.spaces.finditer(text) if _TWO_SPACES.search(text) else ():
            # a prefix that ends with white space has all of it as one word
            out[run.end()] = out[run.start()] + self._word(run.group())[-1]
        return out

    def counts(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for i from 0 to len(text)."""
        pieces = self.split_special.split(text) if self.split_special else [text]
        if len(pieces) == 1:
            return self._plain(text)
        out, base = [np.zeros(1, np.int32)], 0
        for plain, special in zip(pieces[::2], [*pieces[1::2], ""], strict=True):
            # until its last character comes, a special token is ordinary text
            now = self._plain(plain + special[:-1])[1:] + base
            out.append(now)
            base = int(out[-1][len(plain) - 1] if plain else base)
            if special:
                base += 1
                out.append(np.array([base], np.int32))
        return np.concatenate(out)


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _steps(path: str):
    """(doc_id, n_bytes, n_tokens, n_chars, width, prefix_steps): changes of the count at each code point, of width bytes."""

    def run(batches):
        count = counter(path).counts
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                prefix = count(text or "")
                steps = np.diff(prefix)
                width = 1 if not len(steps) or (steps.min() >= -128 and steps.max() <= 127) else 4
                rows.append((int(prefix[-1]), len(steps), width, steps.astype(f"<i{width}").tobytes()))
            types = {"n_tokens": pa.int64(), "n_chars": pa.int64(), "width": pa.int32(), "prefix_steps": pa.binary()}
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], ["doc_id", "n_bytes", *types])

    return run


def token_prefixes(docs: DataFrame, path: str) -> DataFrame:
    """The prefix table: (doc_id, n_bytes, n_tokens, n_chars, width, prefix_steps) for each row of docs.

    prefix_steps holds the change of the count at each code point, from which read_prefixes gives the
    count at every prefix. Written once, it answers questions on truncation and budgets (prefix_of).

    docs: doc_id and text; other columns are ignored. A null text counts as empty: 0 tokens. Whole
    texts are counted, however long. Each row is counted by itself, repeated ones too. An empty table
    gives an empty table.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.octet_length("text").cast("bigint").alias("n_bytes"))
    return rows.mapInArrow(_steps(path), "doc_id bigint, n_bytes bigint, n_tokens bigint, n_chars bigint, width int, prefix_steps binary")


def read_prefixes(steps: bytes, width: int) -> np.ndarray:
    """The count at every prefix from a stored row."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, f"<i{width}"), dtype=np.int64)])


def _cut(limit: int):
    def run(batches):
        for batch in batches:
            steps, widths = batch.column("prefix_steps").to_pylist(), batch.column("width").to_pylist()
            cuts = [int(np.flatnonzero(read_prefixes(s, w) <= limit)[-1]) for s, w in zip(steps, widths, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(cuts, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "n_chars", "longest_prefix"])

    return run


def prefix_of(table: DataFrame, limit: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_chars, longest_prefix) from a written prefix table, without its texts.

    longest_prefix: code points of the longest prefix of at most `limit` tokens. The steps are read
    of texts over the limit only.
    """
    under = table.filter(F.col("n_tokens") <= limit).select("doc_id", "n_bytes", "n_tokens", "n_chars", F.col("n_chars").alias("longest_prefix"))
    over = table.filter(F.col("n_tokens") > limit).select("doc_id", "n_bytes", "n_tokens", "n_chars", "width", "prefix_steps")
    return under.union(over.mapInArrow(_cut(limit), "doc_id bigint, n_bytes bigint, n_tokens bigint, n_chars bigint, longest_prefix bigint"))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Writes the prefix table of documents and reads counts and the cut at 512 tokens from it: a row a document. Edge cases as in token_prefixes."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = Scratch(prepare(spark), "tokens").keep(token_prefixes(docs, public_tokenizers.path("byte_bpe_50k.json")), compression="zstd")
    return prefix_of(table, 512).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), F.col("longest_prefix").alias("prefix_of_512"))
