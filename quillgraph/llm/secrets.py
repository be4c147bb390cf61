"""Secret scans with linking of multipart credentials (DataFrame operations only).

Each kind of part is one pass of a regular expression over the texts that a cheap test lets
through. The pattern is anchored at the end of the match before (\\G) and skips lazily, so each
piece it yields is a gap and a match, and running sums of lengths give the places. Strong parts
(assignments, access identifiers, hex digests) are reported as they stand. Weak candidates (short
assigned values, short identifiers, mixed key-like words, endpoints) are reported only when an
interval join finds a complementary part within SCOPE code points of the same text. Parts are at
least a few characters long, so a bin of the join holds a bounded number of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch, prepare

SCOPE = 120
BIN = 256

ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{16,})"
KEY = r"([A-Za-z0-9+/]{20,})"
ENDPOINT = r"""(https?://[^\s"'<>]+|[A-Za-z0-9._-]{1,64}@[A-Za-z0-9.-]{1,255})"""

#: Kinds in the order of reports: pattern, and the cheap test that a text with a match passes.
KINDS = {
    "assign": (ASSIGN, "contains(lower(text), 'passw') OR contains(lower(text), 'secret') OR contains(lower(text), 'token') OR contains(lower(text), 'api_key') OR contains(lower(text), 'apikey')"),
    "access": (ACCESS, "contains(text, 'AKIA')"),
    "hex": (HEX, "text RLIKE '[0-9a-f]{16}'"),
    "key": (KEY, "text RLIKE '[A-Za-z0-9+/]{20}' AND text RLIKE '[0-9]'"),
    "endpoint": (ENDPOINT, "contains(text, '@') OR contains(text, '://')"),
}

#: How a match of a kind is reported, by the length n of its group: (condition, name, role, strong).
GRADES = [
    ("kind = 'assign' AND n >= 12", "assign", "secret", True),
    ("kind = 'access' AND n >= 18", "access", "id", True),
    ("kind = 'hex' AND n >= 16", "hex", "secret", True),
    ("kind = 'assign' AND n >= 6", "short", "secret", False),
    ("kind = 'access' AND n >= 10", "partial", "id", False),
    ("kind = 'key' AND mixed", "key", "secret", False),
    ("kind = 'endpoint' AND n >= 6", "endpoint", "endpoint", False),
]
ORDER = [name for _, name, _, _ in GRADES]


def _pieces(kind: str):
    """Matches of a kind in a text: how far each piece reaches, the match's length, its group's, and whether it mixes letters and digits."""
    pattern, test = KINDS[kind]
    flags = "(?s)"
    pieces = F.regexp_extract_all("text", F.lit(rf"\G{flags}.*?(?:{pattern})"), F.lit(0))
    one = F.transform(
        pieces,
        lambda p: F.struct(
            F.length(p).alias("reach"),
            F.length(F.regexp_extract(p, pattern, 0)).alias("length"),
            F.length(F.regexp_extract(p, pattern, 1)).alias("n"),
            (F.regexp_extract(p, pattern, 1).rlike("[0-9]") & F.regexp_extract(p, pattern, 1).rlike("[A-Z]") & F.regexp_extract(p, pattern, 1).rlike("[a-z]")).alias("mixed"),
        ),
    )
    return F.when(F.expr(test), one).otherwise(F.array().cast("array<struct<reach:int,length:int,n:int,mixed:boolean>>"))


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, spans) for each row of docs; spans: array of (start, rank, kind, end, strong), sorted.

    docs: doc_id and text; other columns are ignored. Places are code points, ends exclusive.
    A null or empty text has no spans. Whole texts are scanned, however long. Rows that repeat a doc_id
    are separate rows. An empty table gives an empty table.
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "secrets")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = scratch.keep(texts.select("doc_id", F.monotonically_increasing_id().alias("row"), *(_pieces(k).alias(k) for k in KINDS)))

    each = None
    for kind in KINDS:
        some = rows.select("row", F.lit(kind).alias("kind"), F.posexplode(kind).alias("turn", "p")).select("row", "kind", "turn", "p.*")
        each = some if each is None else each.union(some)
    so_far = Window.partitionBy("row", "kind").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum("reach").over(so_far)).withColumn("start", F.col("end") - F.col("length"))
    grade = None
    for rank, (test, name, role, strong) in enumerate(GRADES):
        value = F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("name"), F.lit(role).alias("role"), F.lit(strong).alias("strong"))
        grade = F.when(F.expr(test), value) if grade is None else grade.when(F.expr(test), value)
    parts = scratch.keep(placed.withColumn("g", grade).filter("g IS NOT NULL").select("row", "start", "end", "g.*"))

    # interval join within bins: a part is held in all bins that it covers, a candidate looks into those within its scope
    bins = F.sequence(F.floor(F.col("start") / BIN), F.floor(F.col("end") / BIN))
    held = parts.select("row", F.explode(bins).alias("bin"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("role").alias("r"))
    weak = parts.filter("NOT strong").withColumn("reach", F.sequence(F.floor((F.col("start") - scope) / BIN), F.floor((F.col("end") + scope) / BIN)))
    near = (F.col("s") <= F.col("end") + scope) & (F.col("e") + scope >= F.col("start")) & (F.col("r") != F.col("role")) & ((F.col("e") <= F.col("start")) | (F.col("s") >= F.col("end")))
    linked = weak.withColumn("bin", F.explode("reach")).drop("reach").join(held.withColumnRenamed("row", "row2").withColumnRenamed("bin", "bin2"), (F.col("row") == F.col("row2")) & (F.col("bin") == F.col("bin2")) & near, "left_semi")
    spans = parts.filter("strong").unionByName(linked.drop("bin").distinct())
    listed = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", F.col("name").alias("kind"), "end", "strong"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,strong:boolean>>")
    return rows.select("row", "doc_id").join(listed, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    """find_secrets of documents, a row a document. Edge cases as in find_secrets."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["strong"])
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def _sql() -> str:
    quoted = {k: p.replace("'", "''") for k, (p, _) in KINDS.items()}
    pieces = " UNION ALL ".join(
        rf"SELECT doc_id, '{k}' AS kind, '(?s).*?(?:{p})' AS whole, unnest(regexp_extract_all(t, '(?s).*?(?:{p})')) AS piece, generate_subscripts(regexp_extract_all(t, '(?s).*?(?:{p})'), 1) AS turn FROM texts"
        for k, p in quoted.items()
    )
    match = "CASE kind " + " ".join(f"WHEN '{k}' THEN regexp_extract(piece, '{p}', 0)" for k, p in quoted.items()) + " END"
    value = "CASE kind " + " ".join(f"WHEN '{k}' THEN regexp_extract(piece, '{p}', 1)" for k, p in quoted.items()) + " END"
    grade = lambda of: "CASE " + " ".join(f"WHEN {t} THEN {of(i, n, r, s)}" for i, (t, n, r, s) in enumerate(GRADES)) + " END"
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
pieces AS ({pieces}),
measured AS (SELECT doc_id, kind, turn, length(piece) AS reach, {match} AS m, {value} AS v FROM pieces),
placed AS (
  SELECT doc_id, kind, length(v) AS n, length(m) AS len, regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AS mixed,
    CAST(sum(reach) OVER (PARTITION BY doc_id, kind ORDER BY turn) AS BIGINT) AS e
  FROM measured
), parts AS (
  SELECT doc_id, e - len AS s, e, {grade(lambda i, n, r, s: i)} AS rank, {grade(lambda i, n, r, s: f"'{n}'")} AS name,
    {grade(lambda i, n, r, s: f"'{r}'")} AS role, {grade(lambda i, n, r, s: str(s).lower())} AS strong
  FROM placed
), kept AS (
  SELECT * FROM parts p WHERE rank IS NOT NULL AND (strong OR EXISTS (
    SELECT 1 FROM parts q WHERE q.rank IS NOT NULL AND q.doc_id = p.doc_id AND q.role <> p.role AND q.s <= p.e + {SCOPE} AND q.e + {SCOPE} >= p.s AND (q.e <= p.s OR q.s >= p.e)))
), listed AS (
  SELECT doc_id, count(*) FILTER (name = 'assign') AS n_assign, count(*) FILTER (name = 'access') AS n_access, count(*) FILTER (name = 'hex') AS n_hex,
    string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (strong) AS base, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM kept GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN listed USING (doc_id)
"""


OP10_SQL = _sql()
