"""Exact duplicates by exchange of Golomb-coded fingerprints.

1.  Each input partition keeps a fingerprint of each text (leading bits of its SHA-256).
2.  A partition sends each owner of a fingerprint range its sorted, distinct fingerprints, as
    Golomb-coded gaps and one bit for those that it has more than once: about the logarithm of
    range / count bits each. A text that is a third of all rows is one fingerprint a partition.
3.  An owner answers each partition with a bitmap of the fingerprints seen more than once.
4.  Only the rows that the bitmaps mark are suspects. Their texts, and few others that a sieve of
    bounded size lets through, are shuffled and grouped byte by byte, with partial aggregation
    before the shuffle. Group sizes and the rows that stay come from the suspects; every other row
    is a group of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, prepare
from . import golomb
from .sieve import Sieve

OWNER_ROWS = 1_000_000
_SENT = "owner int, part int, n bigint, bits int, unary binary, rest binary, repeated binary"
_BITMAP = "owner int, part int, duplicates binary"


def _by_owner(values: np.ndarray, owners: int, bits: int) -> list[tuple[int, int, int]]:
    """(owner, begin, end) of sorted fingerprints; owners have equal ranges."""
    cuts = np.searchsorted(values, [(o << bits) // owners for o in range(owners + 1)])
    return [(o, int(a), int(b)) for o, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]


def _send(owners: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        values, counts = np.unique(table.column("fingerprint").to_numpy(), return_counts=True)
        rows = []
        for owner, a, b in _by_owner(values, owners, bits):
            base = (owner << bits) // owners
            rows.append((owner, part, b - a, *golomb.encode(values[a:b] - base, (1 << bits) // owners + 1), np.packbits(counts[a:b] > 1).tobytes()))
        names = ["owner", "part", "n", "bits", "unary", "rest", "repeated"]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(names, types, strict=True))})

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For each sender, a bitmap over its fingerprints in the order sent: seen more than once, here or elsewhere."""
    rows = table.to_pylist()
    lists = [golomb.decode(r["n"], r["bits"], r["unary"], r["rest"]) for r in rows]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    several = values[counts > 1]
    out = []
    for r, own in zip(rows, lists, strict=True):
        repeated = np.unpackbits(np.frombuffer(r["repeated"], np.uint8))[: r["n"]].astype(bool)
        out.append(np.packbits(np.isin(own, several, assume_unique=True) | repeated).tobytes())
    return pa.table({"owner": table.column("owner"), "part": table.column("part"), "duplicates": pa.array(out, pa.binary())})


def _suspects(owners: int, bits: int):
    """The rows of a partition with one more column: whether its bitmaps mark them."""

    def run(rows: pa.Table, bitmaps: pa.Table) -> pa.Table:
        prints = rows.column("fingerprint").to_numpy()
        values = np.unique(prints)
        marked = np.zeros(len(values), dtype=bool)
        by_owner = dict(zip(bitmaps.column("owner").to_pylist(), bitmaps.column("duplicates").to_pylist(), strict=True))
        for owner, a, b in _by_owner(values, owners, bits):
            marked[a:b] = np.unpackbits(np.frombuffer(by_owner[owner], np.uint8))[: b - a]
        return rows.drop_columns(["fingerprint"]).append_column("suspect", pa.array(np.isin(prints, values[marked])))

    return run


def _sha(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))


def _sieve_key(sha: str | Column) -> Column:
    return F.xxhash64(sha)


def _groups(docs: DataFrame, scratch: Scratch, owner_rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sha, part, row, suspect) of every row, and (sha, best, n) of the groups of equal texts; best: doc_id and row that stay."""
    row = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _sha().alias("sha"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.keep(row)
    n = max(2, rows.count())
    owners = max(8, -(-n // owner_rows))
    bits = min(56, math.ceil(math.log2(n)) + 20)
    whole = F.conv(F.substring(F.hex("sha"), 1, 14), 16, 10).cast("bigint")
    prints = rows.select("doc_id", "sha", "part", "row", F.shiftright(whole, 56 - bits).alias("fingerprint"))

    sent = prints.select("part", "fingerprint").groupBy("part").applyInArrow(_send(owners, bits), _SENT)
    bitmaps = sent.groupBy("owner").applyInArrow(_answer, _BITMAP)
    marked = scratch.keep(prints.groupBy("part").cogroup(bitmaps.groupBy("part")).applyInArrow(_suspects(owners, bits), "doc_id bigint, sha binary, part int, row bigint, suspect boolean"))
    scratch.drop(rows)

    # bytes decide: a group is one text, and its digest stands for it only while no other text has it
    suspects = marked.filter("suspect")
    shas = scratch.keep(suspects.select("sha").distinct())
    texts = docs.select(_sha().alias("sha"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    _, near = Sieve(shas.select(_sieve_key("sha"))).split(texts, _sieve_key("sha"))
    equal = near.groupBy("sha", "text").agg(F.count("*").alias("n")).groupBy("sha").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
    best = suspects.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("best"))
    checked = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256"))).otherwise(F.col("best"))
    groups = scratch.keep(equal.filter("n > 1").join(best, "sha").select("sha", checked.alias("best"), "n"))
    return marked, groups


def exact_duplicates(docs: DataFrame, owner_rows: int = OWNER_ROWS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of docs.

    docs: doc_id and text; other columns are ignored. Texts are compared byte by byte, whole; a null
    text counts as empty. keep_id is the largest doc_id of equal texts. Exactly one row of a group
    has kept: of rows that repeat that doc_id too, one. Null doc_ids rank below all others; a group
    of only such rows has a null keep_id and still keeps one. An empty table gives an empty table.
    """
    marked, groups = _groups(docs, Scratch(prepare(docs.sparkSession), "exact"), owner_rows)
    hexed = F.lower(F.hex("sha")).alias("text_sha256")
    alone = marked.filter("NOT suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), hexed)
    # a text that is a third of all rows meets its group once a part, and its rows meet that part's row
    suspects = marked.filter("suspect")
    by_part = suspects.select("sha", "part").distinct().join(groups, "sha")
    several = suspects.join(by_part, ["sha", "part"], "left").select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("row") == F.col("best.row"), F.lit(True)).alias("kept"), hexed,
    )
    return alone.union(several)


def without_copies(docs: DataFrame, owner_rows: int = OWNER_ROWS) -> DataFrame:
    """One document of each group of equal texts, columns as given: that of the largest doc_id.

    Null texts count as empty, null doc_ids rank below all others. Of rows that repeat both doc_id
    and text, the one whose other columns come first as JSON stays, so reruns agree. An empty table
    stays empty. Only rows of groups, and few others, are shuffled.
    """
    scratch = Scratch(prepare(docs.sparkSession), "copies")
    marked, groups = _groups(docs, scratch, owner_rows)
    digest, mark = "sha", "id"
    while digest in docs.columns or mark in docs.columns:
        digest, mark = digest + "_", mark + "_"

    def name(doc_id: str) -> Column:
        return F.coalesce(F.col(doc_id).cast("bigint").cast("string"), F.lit(""))

    suspects = marked.filter("suspect")
    by_part = suspects.select("sha", "part").distinct().join(groups, "sha")
    pairs = suspects.join(by_part, ["sha", "part"]).select(name("doc_id").alias(mark), name("best.doc_id").alias("stays"), F.col("sha").alias(digest)).distinct()
    gone = scratch.keep(pairs.filter(F.col(mark) != F.col("stays")).drop("stays"))
    stay, may_go = Sieve(groups.select(_sieve_key("sha"))).split(docs, _sieve_key(_sha()))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = may_go.select(*columns, name("doc_id").alias(mark), _sha().alias(digest)).join(gone.hint("merge"), [mark, digest], "left_anti")
    order = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text"))))
    one = named.groupBy(mark, digest).agg(F.min_by(F.struct(*columns), F.coalesce(order, F.lit(""))).alias(mark + "_row"))
    return stay.union(one.select(*(F.col(f"`{mark}_row`.`{c}`") for c in docs.columns)))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """exact_duplicates of documents: a row a document, dropped ones too. Nulls, ties, repeats and empty tables as there."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
