"""Near-duplicate documents: MinHash bands, verification on full sets, connected components.

1.  Each text becomes its set of hashed five-word shingles. Texts with the same set form a class,
    which its least row by doc_id and text represents (null ids last). A class has a written number
    of its own; from here on only classes are compared.
2.  A signature of many universal hash minima is cut into bands. Classes that share a band key
    share a bucket.
3.  Every member of a bucket is verified on full sets against the bucket's center, the member with
    most neighbours over all its buckets, and the links found are joined into components by
    large-star and small-star rounds.
4.  Buckets with members of several components are cut into pairs of blocks of bounded size. A task
    compares a pair of blocks by a longer signature, verifies on full sets what may reach the
    threshold (within four standard deviations), most alike first, and skips pairs that are joined
    already. So it gives less links than the blocks have components, never all pairs of a group.
    Blocks of one component alone are not paired. Components are then joined again.

So a group of n copies costs about n verifications, and no pair is skipped for its bucket's size: a
bucket of any size is split into pairs of blocks. Only the texts of classes in shared buckets are
shuffled, and nothing but counts reaches the driver.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import Scratch, prepare
from .shingles import MinHash, jaccard, shingle_sets
from .sieve import Sieve

SKETCH = 1024
BLOCK = 512
#: Shingles of a block, beyond which it is split further; a single longer set is a block of its own size.
BLOCK_SHINGLES = 500_000


def _key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _describe(size: int, hashing: MinHash):
    """(doc_id, text_key, n_shingles, set_key, bands) of each text."""

    def run(batches):
        for batch in batches:
            n, keys, bands = [], [], []
            for s in shingle_sets(batch.column("text"), size):
                n.append(len(s))
                keys.append(_key(s) if len(s) else None)
                bands.append(hashing.band_keys(hashing.signature(s)).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "n_shingles", "set_key", "bands"],
            )

    return run


def _profiles(size: int, hashing: MinHash, sketching: MinHash):
    """(cid, bands, sketch, members) of each candidate; sketch has one byte a hash function."""

    def run(batches):
        for batch in batches:
            rows = []
            for s in shingle_sets(batch.column("text"), size):
                bands = hashing.band_keys(hashing.signature(s)).tobytes() if len(s) else b""
                sketch = (sketching.signature(s) >> np.uint32(7)).astype(np.uint8).tobytes() if len(s) else b""
                rows.append((bands, sketch, s.tobytes()))
            columns = [batch.column("cid"), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(3))]
            yield pa.RecordBatch.from_arrays(columns, ["cid", "bands", "sketch", "members"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep = [
                100 * (n := jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))[0] >= percent * n[1]
                for x, y in zip(batch.column("members_a").to_pylist(), batch.column("members_b").to_pylist(), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _merging(percent: int):
    """Links of a pair of blocks, as pairs of components, that join components not yet joined here.

    A pair of classes is looked at in the first band that the two share.
    """
    chance = 1 / 256
    share = percent / 100
    lowest = share - 4 * math.sqrt(share * (1 - share) / SKETCH)
    least_equal = math.floor(SKETCH * (lowest + (1 - lowest) * chance))

    def run(table: pa.Table) -> pa.Table:
        cid, comp, n, side, band = (table.column(c).to_numpy() for c in ("cid", "component", "n_shingles", "side", "band"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(cid), -1)
        keys = np.frombuffer(b"".join(table.column("bands").to_pylist()), np.uint64).reshape(len(cid), -1)
        left, right = np.flatnonzero(side <= 1), np.flatnonzero(side != 1)
        alike, a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in left:
            j = right[(comp[right] != comp[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
            if side[i] == 0:
                j = j[cid[j] > cid[i]]
            if len(j):
                j = j[(keys[j] == keys[i]).argmax(axis=1) == band[i]]
            if len(j):
                equal = (sketch[j] == sketch[i]).sum(axis=1)
                j, equal = j[equal >= least_equal], equal[equal >= least_equal]
                alike.append(equal)
                a.append(np.full(len(j), i))
                b.append(j)
        alike, a, b = np.concatenate(alike), np.concatenate(a), np.concatenate(b)
        order = np.argsort(-alike, kind="stable")
        members = [np.frombuffer(m, np.uint64) for m in table.column("members").to_pylist()]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        links = []
        for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
            x, y = find(int(comp[i])), find(int(comp[j]))
            if x != y:
                common, union = jaccard(members[i], members[j])
                if 100 * common >= percent * union:
                    root[max(x, y)] = min(x, y)
                    links.append((int(comp[i]), int(comp[j])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def row_key(doc_id: str | Column, text_key: str | Column) -> Column:
    """A hash that stands for a row in a Sieve."""
    return F.xxhash64(doc_id, text_key)


def _found(docs: DataFrame, percent: int, size: int, bands: int, rows: int, block: int) -> DataFrame:
    """near_duplicates with text_key, a digest of the text: doc_id and text_key name a row, repeated rows apart."""

    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "near")
    hashing, sketching = MinHash(bands, rows), MinHash(SKETCH, 1, seed=11)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("text_key"), "text")
    base = scratch.keep(texts.mapInArrow(_describe(size, hashing), "doc_id bigint, text_key string, n_shingles bigint, set_key binary, bands array<bigint>"))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    sets = base.filter("n_shingles > 0").groupBy("set_key").agg(F.min(row).alias("rep"), F.max("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"))
    classes = scratch.keep(sets.withColumn("cid", F.monotonically_increasing_id()))

    # buckets of more than one class
    placed = scratch.keep(classes.select("cid", "n_shingles", F.posexplode("bands").alias("band", "bucket")))
    counts = placed.groupBy("band", "bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = scratch.keep(placed.join(counts, ["band", "bucket"]))
    scratch.drop(placed)
    weights = shared.groupBy("cid").agg(F.sum("n").alias("weight"))
    centers = shared.join(weights, "cid").groupBy("band", "bucket").agg(F.max(F.struct("weight", (-F.col("cid")).alias("turned"))).alias("best"))
    centers = centers.select("band", "bucket", (-F.col("best.turned")).alias("center"))

    # full sets of the classes in them: only their texts are shuffled
    named = classes.select("cid", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"))
    wanted = scratch.keep(named.join(weights.select("cid"), "cid", "left_semi"))
    _, near = Sieve(wanted.select(row_key("rep_id", "rep_key"))).split(texts, row_key("doc_id", "text_key"))
    is_rep = F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_key") == F.col("rep_key"))
    found = near.join(wanted.hint("merge"), is_rep).select("cid", "text")
    profiles = scratch.keep(found.mapInArrow(_profiles(size, hashing, sketching), "cid bigint, bands binary, sketch binary, members binary").dropDuplicates(["cid"]))

    stars = shared.join(centers, ["band", "bucket"]).filter("cid <> center").select(F.col("center").alias("a"), F.col("cid").alias("b")).distinct()
    sets = profiles.select("cid", "members")
    pairs = stars.join(sets.toDF("b", "members_b"), "b").join(sets.toDF("a", "members_a"), "a").select("a", "b", "members_a", "members_b")
    joined = scratch.keep(components(scratch.keep(pairs.mapInArrow(_verify(percent), "a bigint, b bigint")), scratch))

    # buckets that still hold several components, in pairs of blocks
    members = scratch.keep(shared.drop("n").join(joined.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid")))
    groups = members.groupBy("band", "bucket", "component").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("s"), F.bit_xor(F.xxhash64("cid")).alias("who"))
    whole = F.sum("m").alias("m"), F.sum("s").alias("s"), F.bit_xor("who").alias("who")
    mixed = groups.groupBy("band", "bucket").agg(F.max(F.struct("m", "s", "component")).alias("top"), *whole, F.count("*").alias("k")).filter("k > 1")
    # of buckets with the same members the first one is enough: the first that a pair shares is among these
    mixed = mixed.groupBy("m", "s", "who").agg(F.min(F.struct("band", "bucket", "top")).alias("b")).select("m", "s", "b.*")

    def parts(m: Column, s: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(m / block), F.ceil(s / BLOCK_SHINGLES)).cast("int")

    top = F.col("top")
    cuts = mixed.select("band", "bucket", top["component"].alias("main"), parts(top["m"], top["s"]).alias("p"), parts(F.col("m") - top["m"], F.col("s") - top["s"]).alias("q"))
    # blocks of the largest component come first, and meet only the others
    main = F.col("component") == F.col("main")
    own = F.when(main, F.pmod(F.xxhash64("cid"), "p")).otherwise(F.col("p") + F.pmod(F.xxhash64("cid"), "q")).cast("int")
    spread = (
        members.join(cuts, ["band", "bucket"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.when(main, F.col("p")).otherwise(0), F.col("p") + F.col("q") - 1)))
        .select(
            "cid", "component", "n_shingles", "band", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
        )
    )
    more = scratch.keep(spread.join(profiles, "cid").groupBy("band", "bucket", "i", "j").applyInArrow(_merging(percent), "a bigint, b bigint"))
    again = components(more, scratch).toDF("component", "joint")
    alone = classes.join(joined, F.col("cid") == F.col("id"), "left").select("cid", "set_key", "rep", F.coalesce("component", "cid").alias("component"))
    linked = alone.join(again, "component", "left").withColumn("component", F.coalesce("joint", "component")).drop("joint")

    # a component's row is the least of its classes' rows
    linked = scratch.keep(linked)
    heads = linked.groupBy("component").agg(F.min("rep").alias("head"), F.count("*").alias("k")).filter("k > 1").drop("k")
    by_class = linked.join(heads, "component", "left").select("set_key", "rep", F.coalesce("head", "rep").alias("head"))
    out = base.select("doc_id", "text_key", "n_shingles", "set_key").join(by_class, "set_key", "left")
    is_head = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & F.col("text_key").eqNullSafe(F.col("head.text_key"))
    return out.select(
        "doc_id", "text_key", "n_shingles", F.coalesce("rep.doc_id", "doc_id").alias("class_id"), F.coalesce("head.doc_id", "doc_id").alias("component_id"),
        (F.col("head").isNull() | is_head).alias("kept"),
    )


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, bands: int = 26, rows: int = 5, block: int = BLOCK) -> DataFrame:
    """Classes of near-duplicate documents: (doc_id, n_shingles, class_id, component_id, kept).

    docs: doc_id and text; other columns are ignored. Two documents are linked when the Jaccard
    similarity of their shingle sets is at least percent / 100. class_id is the least doc_id with
    the same set, component_id the least one reachable; kept marks that row.

    Null or blank texts have an empty set and are linked with nothing. A text of any length is taken
    whole; its set is held by one task. Rows are told apart by doc_id
    and text, so rows with a null doc_id and rows that share a doc_id but not a text are linked as
    any others. A null doc_id stands last: such a row is kept only where no row with a doc_id is in
    its component, and then the one of the least text digest. Rows that repeat a doc_id and text
    share their result. An empty table gives an empty table.
    """
    return _found(docs, percent, size, bands, rows, block).drop("text_key")


def without_near_copies(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents that near_duplicates keeps, columns as given; nulls, ties and repeats as there.

    Rows go by doc_id and text: null and repeated ids lose their own near copies and nothing else.
    Rows that repeat a doc_id and text stay or go together. Only rows that may go are shuffled.
    """
    scratch = Scratch(prepare(docs.sparkSession), "gone")
    found = _found(docs, percent, 5, 26, 5, BLOCK).filter("NOT kept").select("doc_id", "text_key").distinct()
    gone_id, gone_text = "gone", "gone_text"
    while gone_id in docs.columns or gone_text in docs.columns:
        gone_id, gone_text = gone_id + "_", gone_text + "_"
    gone = scratch.keep(found.toDF(gone_id, gone_text))
    own_id, own_text = F.col("doc_id").cast("bigint"), F.md5("text")
    stay, may_go = Sieve(gone.select(row_key(gone_id, gone_text))).split(docs, row_key(own_id, own_text))
    same = own_id.eqNullSafe(F.col(gone_id)) & (own_text == F.col(gone_text))
    return stay.union(may_go.join(gone.hint("merge"), same, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns)))


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    """near_duplicates of documents at 0.85: a row a document. Nulls, ties, repeats and empty tables as there.

    kept is by doc_id alone, so rows that share the least doc_id of a component all have it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id")


#: The same components over all pairs of sets, without hashing.
OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM sets),
classes AS (SELECT min(doc_id) AS cid, list_sort(s) AS k, any_value(len(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
member AS (SELECT s.doc_id, c.cid FROM sets s JOIN classes c ON list_sort(s.s) = c.k),
items AS (SELECT cid, n, unnest(k) AS g FROM classes),
pairs AS (
  SELECT a.cid AS a, b.cid AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM items a JOIN items b ON a.g = b.g AND a.cid < b.cid GROUP BY 1, 2
), edges AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (na + nb - c)),
sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (
  SELECT cid AS x, cid AS y FROM classes UNION SELECT r.x, s.b FROM reach r JOIN sym s ON r.y = s.a
), comp AS (SELECT x AS cid, min(y) AS c FROM reach GROUP BY x)
SELECT z.doc_id, z.n AS n_shingles, coalesce(c.c, z.doc_id) AS component_id, z.doc_id = coalesce(c.c, z.doc_id) AS kept, coalesce(m.cid, z.doc_id) AS class_id
FROM sizes z LEFT JOIN member m USING (doc_id) LEFT JOIN comp c ON m.cid = c.cid
"""
