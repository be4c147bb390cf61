"""Repair of conversation structure: the cheapest edits after which roles read (s?(ua)+)?.

Costs of a row follow from the cheapest costs after it, for each of four states. A conversation is cut
into blocks of rows; the state costs are kept at the blocks' borders only, and inside a block at every
square root of its length. Walking forward, each block computes the costs in between again and takes
the ASCII-least edit that keeps to the cheapest total. So a conversation that is a third of all rows is
many blocks: their cost matrices are chained to costs at borders, their ways from each state to the
state they begin in, and each block is walked where it lies.

Only the digest of a whole repaired conversation has to see its lines one after the other: rows are
sorted by conversation and streamed through it, and nothing is gathered.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, prepare

SPACE = " \t\n\x0b\f\r"
BITS = 14  # a block has at most 2 ** BITS rows

#: What edits cost.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. A symbol is 4 * initial + fault.
INITIALS, FAULTS = "sua", ("", "blank", "duplicate", "truncated")
KEEP = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
SUPPLY = (2, 2, 3, 2)  # where a supplied role leads: assistant after u, user elsewhere
NEVER = 1 << 60
END = (0, 2 * INSERT, INSERT, 0)


def _options(symbol: int, after: tuple[int, ...], state: int) -> tuple[int, int | None, int | None]:
    """Costs of deleting, keeping and reroling the row in a state, without inserts before it."""
    initial, fault = divmod(symbol, 4)
    if fault in (1, 2):
        return DELETE + after[state], None, None
    more, kept = CUT_OFF if fault == 3 else 0, KEEP[state][initial]
    return DELETE + after[state], None if kept is None else more + after[kept], REROLE + more + after[SUPPLY[state]]


@lru_cache(maxsize=1 << 16)
def _before(symbol: int, after: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """Costs before a row from those after it, as their least and what is above it."""
    costs = [min(c for c in _options(symbol, after, s) if c is not None) for s in range(4)]
    for _ in range(2):
        costs = [min(c, INSERT + costs[SUPPLY[s]]) for s, c in enumerate(costs)]
    least = min(costs)
    return least, tuple(NEVER if c > NEVER // 2 else c - least for c in costs)


@lru_cache(maxsize=1 << 16)
def _edits(symbol: int, after: tuple[int, ...], state: int) -> tuple[str, int]:
    """The ASCII-least cheapest edits up to and with this row, and the state after it."""
    least, above = _before(symbol, after)
    said = ""
    while True:
        left = least + above[state]
        delete, keep, rerole = _options(symbol, after, state)
        if delete == left:
            return said + "D", state
        if INSERT + least + above[SUPPLY[state]] == left:
            said, state = said + "I", SUPPLY[state]
        elif keep == left:
            return said + "K", KEEP[state][symbol // 4]
        else:
            return said + "R", SUPPLY[state]


def _back(symbols: bytes, after: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    total = 0
    for symbol in reversed(symbols):
        least, after = _before(symbol, after)
        total += least
    return total, after


def matrix(symbols: bytes) -> list[int]:
    """Cheapest cost of a block from each state to each state, row by row."""
    columns = []
    for end in range(4):
        least, above = _back(symbols, tuple(0 if s == end else NEVER for s in range(4)))
        columns.append([NEVER if a >= NEVER // 2 else least + a for a in above])
    return [columns[end][begin] for begin in range(4) for end in range(4)]


def chained(block: list[int], after: list[int]) -> list[int]:
    """Costs before a block from those after it."""
    return [min(block[4 * s + e] + after[e] for e in range(4)) for s in range(4)]


def walk(symbols: bytes, after: tuple[int, ...], state: int) -> tuple[list[str], int]:
    """Each row's edits from a state at the block's begin, and the state at its end.

    Costs are kept at each square root of the length, and computed again between two of these places.
    """
    step = max(1, math.isqrt(len(symbols)))
    places = range(0, len(symbols), step)
    kept, costs = [], _above(after)
    for at in reversed(places):
        kept.append(costs)
        costs = _back(symbols[at : at + step], costs)[1]
    out = []
    for at, costs in zip(places, reversed(kept), strict=True):
        part, afters = symbols[at : at + step], []
        for symbol in reversed(part):
            afters.append(costs)
            costs = _before(symbol, costs)[1]
        for symbol, costs in zip(part, reversed(afters), strict=True):
            said, state = _edits(symbol, costs, state)
            out.append(said)
    return out, state


def _above(costs) -> tuple[int, ...]:
    least = min(costs)
    return tuple(c - least for c in costs)


def tail(state: int) -> str:
    """Inserts after the last row."""
    return "I" * (END[state] // INSERT)


def _symbols(rows: pa.StructScalar) -> bytes:
    return bytes(rows.values.field("symbol").to_pylist())


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, begin, first, last, illegal, costs) of blocks; costs is the block's matrix."""
    for batch in batches:
        symbols = [_symbols(r) for r in batch.column("rows")]
        illegal = [sum(_illegal(a, b) for a, b in zip(s, s[1:], strict=False)) for s in symbols]
        columns = [batch.column("conv_id"), batch.column("begin"), pa.array([s[0] for s in symbols], pa.int32()), pa.array([s[-1] for s in symbols], pa.int32()), pa.array(illegal, pa.int64()), pa.array([matrix(s) for s in symbols], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "begin", "first", "last", "illegal", "costs"])


def _illegal(a: int, b: int) -> bool:
    return (a // 4, b // 4) not in ((0, 1), (1, 2), (2, 1))


def _bordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a conversation's blocks in order: its illegal pairs, its cost, and the costs after each block."""
    for batch in batches:
        illegal, cost, borders = [], [], []
        for blocks in batch.column("blocks"):
            blocks = blocks.as_py()
            illegal.append(sum(b["illegal"] for b in blocks) + sum(_illegal(a["last"], b["first"]) for a, b in zip(blocks, blocks[1:], strict=False)))
            after, found = list(END), []
            for b in reversed(blocks):
                found.append({"begin": b["begin"], "after": after, "alone": len(blocks) == 1})
                after = chained(b["costs"], after)
            cost.append(after[0])
            found[0]["ends"] = True
            borders.append(found[::-1])
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("after", pa.list_(pa.int64())), ("alone", pa.bool_()), ("ends", pa.bool_())]))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(illegal, pa.int64()), pa.array(cost, pa.int64()), pa.array(borders, kind)], ["conv_id", "illegal", "cost", "borders"])


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where a block ends from each state."""
    for batch in batches:
        ends = [[walk(_symbols(r), tuple(a.as_py()), s)[1] for s in range(4)] for r, a in zip(batch.column("rows"), batch.column("after"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("begin"), pa.array(ends, pa.list_(pa.int32()))], ["conv_id", "begin", "ways"])


def _begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each block begins."""
    for batch in batches:
        begins, states = [], []
        for blocks in batch.column("blocks"):
            state = 0
            for b in blocks.as_py():
                begins.append(b["begin"])
                states.append(state)
                state = b["ways"][state]
        yield pa.RecordBatch.from_arrays([pa.array(begins, pa.int64()), pa.array(states, pa.int32())], ["begin", "state"])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's audit, and its rows that lines come of: their place in the order and their edits."""
    line = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("at", pa.int64()), ("edits", pa.string())]))
    for batch in batches:
        audits, lines = [], []
        for rows, after, state, ends in zip(*(batch.column(c) for c in ("rows", "after", "state", "ends")), strict=True):
            said, state = walk(_symbols(rows), tuple(after.as_py()), state.as_py())
            if ends.as_py():
                said[-1] += tail(state)
            audits.append("".join(said))
            lines.append([{k: r[k] for k in ("turn", "role", "digest", "at")} | {"edits": e} for r, e in zip(rows.as_py(), said, strict=True) if e != "D"])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("begin"), pa.array(audits, pa.string()), pa.array(lines, line)], ["conv_id", "begin", "audit", "lines"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's repaired lines, from rows sorted by conversation and order, edits before texts.

    Rows that are equal in all that counts stand together; the one whose text is kept takes it.
    """
    now, state, digest, empty, waiting, key = (), 0, hashlib.sha256(), True, [], None
    done: list[tuple] = []

    def put(data: bytes) -> None:
        nonlocal empty
        if not empty:
            digest.update(b"\n")
        digest.update(data)
        empty = False

    def play(text: str | None, role: str | None) -> None:
        nonlocal state
        for edits in waiting:
            for e in edits:
                name = "assistant" if state == 2 else "user"
                if e == "K":
                    put(f"{role}:{text}".encode())
                    state = KEEP[state][INITIALS.index(role[0])]
                elif e != "D":
                    put(f"{name}:{text if e == 'R' else ''}".encode())
                    state = SUPPLY[state]
        waiting.clear()

    for batch in batches:
        for conv, turn, role, print_, edits, text in zip(*(batch.column(c) for c in ("conv_id", "turn", "role", "digest", "edits", "text")), strict=True):
            conv, own = conv.as_py(), (turn.as_py(), role.as_py(), print_.as_py())
            if (conv,) != now:
                if now:
                    done.append((*now, digest.hexdigest()))
                now, state, digest, empty, key = (conv,), 0, hashlib.sha256(), True, None
            if own != key:
                key = own
                waiting.clear()
            if edits.is_valid:
                waiting.append(edits.as_py())
            elif waiting:
                play(text.as_py(), own[1])
        yield _digests(done)
        done = []
    yield _digests([(*now, digest.hexdigest())] if now else [])


def _digests(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["conv_id", "repaired_sha256"])


def _plain(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; null roles and texts are one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), spaced("role"), spaced("text"))


def damage(messages: DataFrame) -> DataFrame:
    """Messages with faults by crc32 of conv_id:turn, modulo 20 (nulls: one space).

    0 drops a row, 1 empties its text, 2 takes . ! and ? out of it, 3 repeats it, 4 makes its role user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = _plain(messages).withColumn("kind", F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def repair(messages: DataFrame, bits: int = BITS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row a conversation.

    messages: conv_id, turn (whole numbers), role and text; other columns are ignored. Rows go by turn,
    nulls first; rows of one turn by role, then by the digest of their text. A null conv_id is a
    conversation of its own, a null role or text one space. A role's initial is its first character;
    others than s, u and a can't be kept. No rows, no result.
    """
    scratch = Scratch(prepare(messages.sparkSession), "repair")
    rows = _plain(messages)
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    fault = F.when(last == "", 1).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)), F.lit(0)), F.lit(4)) - 1
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    keyed = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    order = ["conv_id", "turn", "role", "digest"]
    slim = keyed.select(*order, (4 * initial + fault).cast("int").alias("symbol")).withColumn("copy", F.monotonically_increasing_id())
    placed = slim.repartitionByRange(*order, "copy").sortWithinPartitions(*order, "copy").drop("copy")
    placed = scratch.keep(placed.withColumn("at", F.monotonically_increasing_id()))

    # the first of equal rows stands, later ones are duplicates
    same = ["conv_id", "role", "digest"]
    first = placed.filter("symbol % 4 <> 1").groupBy(*same).agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = first.select(*(F.col(c).alias(f"first_{c}") for c in same), "first")
    on = [F.col(c).eqNullSafe(F.col(f"first_{c}")) for c in same]
    fault = F.when(F.col("at") > F.col("first"), F.col("symbol") - F.col("symbol") % 4 + 2).otherwise(F.col("symbol")).cast("int")
    coded = placed.join(again, on, "left").withColumn("symbol", fault)
    listed = F.array_sort(F.collect_list(F.struct("at", "symbol", "turn", "role", "digest")))
    blocks = scratch.keep(coded.groupBy("conv_id", F.shiftright("at", bits).alias("run")).agg(listed.alias("rows")).select("conv_id", F.col("rows")[0]["at"].alias("begin"), "rows"))

    conv = "conv_id bigint"
    measured = blocks.mapInArrow(_measured, f"{conv}, begin bigint, first int, last int, illegal bigint, costs array<bigint>")
    folded = measured.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("begin", "first", "last", "illegal", "costs"))).alias("blocks"))
    folded = scratch.keep(folded.mapInArrow(_bordered, f"{conv}, illegal bigint, cost bigint, borders array<struct<begin:bigint,after:array<bigint>,alone:boolean,ends:boolean>>"))
    borders = folded.select(F.explode("borders").alias("b")).select("b.*")
    several = blocks.join(borders.filter("NOT alone"), "begin")
    ways = several.select("conv_id", "begin", "rows", "after").mapInArrow(_ways, f"{conv}, begin bigint, ways array<int>")
    states = ways.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("begin", "ways"))).alias("blocks")).select("blocks").mapInArrow(_begun, "begin bigint, state int")
    known = borders.join(states, "begin", "left").select("begin", "after", F.coalesce("ends", F.lit(False)).alias("ends"), F.coalesce("state", F.lit(0)).alias("state"))
    lines = "array<struct<turn:bigint,role:string,digest:binary,at:bigint,edits:string>>"
    walked = scratch.keep(blocks.join(known, "begin").select("conv_id", "begin", "rows", "after", "state", "ends").mapInArrow(_walked, f"{conv}, begin bigint, audit string, lines {lines}"))
    audits = walked.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "audit"))), lambda x: x["audit"]), "").alias("audit"))

    edits = walked.select("conv_id", F.explode("lines").alias("l")).select("conv_id", "l.*", F.lit(None).cast("string").alias("text"))
    texts = keyed.select("conv_id", "turn", "role", "digest", F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("string").alias("edits"), "text")
    stream = edits.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order, F.col("at").asc_nulls_last())
    digests = stream.select(*order, "edits", "text").mapInArrow(_digested, f"{conv}, repaired_sha256 string")

    marks = [F.sum((F.col("fault") == i).cast("bigint")).alias(name) for i, name in enumerate(FAULTS) if name]
    counts = blocks.select("conv_id", F.explode("rows.symbol").alias("symbol")).withColumn("fault", F.col("symbol") % 4).groupBy("conv_id").agg(*marks)
    turns = placed.select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    parts = counts.unionByName(turns, True).unionByName(folded.select("conv_id", "illegal", "cost"), True).unionByName(audits, True).unionByName(digests, True)
    return _finished(parts)


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _finished(parts: DataFrame) -> DataFrame:
    one = parts.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in (*COLUMNS, "audit", "repaired_sha256")))
    nothing = F.lit(hashlib.sha256().hexdigest())
    return one.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COLUMNS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def repaired_all(messages: DataFrame, damaged: DataFrame, bits: int = BITS) -> DataFrame:
    """repair of damaged messages, with a row of zeros for each conversation of which nothing is left."""
    every = messages.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    return _finished(repair(damaged, bits).unionByName(every, True))


def op13_conversations(spark, sf_dir: str) -> DataFrame:
    """repair of conversations after damage, every original conversation a row. Nulls, ties, repeats and empty tables as there."""
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repaired_all(messages, damage(messages))


#: The same by recursion over rows, backward for costs and forward for edits; states count from 1.
OP13_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
m AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(unicode(x) AS BIGINT)) AS key FROM conversations),
k AS (SELECT m.*, xor(list_reduce(list_prepend(4294967295, key), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM m, crc),
d AS (SELECT g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, count(*) OVER (PARTITION BY g) AS n,
  row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST, copy) AS place, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail,
  CASE role[1] WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 4 END AS c FROM d),
r AS MATERIALIZED (SELECT *, CASE WHEN tail = '' THEN 1 WHEN place > 1 THEN 2 WHEN tail NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(c) OVER (PARTITION BY g ORDER BY i) AS before FROM o),
fixed AS (SELECT [3, 3, 4, 3] AS supply, [[2, 3, NULL, NULL], [NULL, 3, NULL, NULL], [NULL, NULL, 4, NULL], [NULL, 3, NULL, NULL]] AS keep),
b AS (SELECT DISTINCT g, n + 1 AS i, [0, 10, 5, 0] AS v FROM r UNION ALL
  SELECT g, i, list_transform([1, 2, 3, 4], lambda s: least(y[s], 5 + y[supply[s]])) FROM (
    SELECT g, i, supply, list_transform([1, 2, 3, 4], lambda s: least(x[s], 5 + x[supply[s]])) AS y FROM (
      SELECT r.g, r.i, supply, list_transform([1, 2, 3, 4], lambda s: least(2 + v[s], CASE WHEN fault IN (0, 3) THEN CASE WHEN fault = 3 THEN 5 ELSE 0 END + v[keep[s][c]] END, CASE WHEN fault IN (0, 3) THEN CASE WHEN fault = 3 THEN 6 ELSE 1 END + v[supply[s]] END)) AS x
      FROM b JOIN r ON r.g = b.g AND r.i = b.i - 1, fixed))),
f AS (SELECT g, CAST(1 AS BIGINT) AS i, 1 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS lines, true AS more FROM (SELECT DISTINCT g FROM r) UNION ALL
  SELECT g, CASE WHEN e = 'I' OR e = '' THEN i ELSE i + 1 END, CASE e WHEN 'K' THEN keep[s][c] WHEN 'D' THEN s WHEN '' THEN s ELSE supply[s] END, audit || e,
    CASE e WHEN 'K' THEN list_append(lines, role || ':' || text) WHEN 'R' THEN list_append(lines, name || ':' || text) WHEN 'I' THEN list_append(lines, name || ':') ELSE lines END, e <> '' FROM (
    SELECT f.*, supply, keep, r.c, r.role, r.text, CASE WHEN s = 3 THEN 'assistant' ELSE 'user' END AS name,
      CASE WHEN r.i IS NULL THEN CASE WHEN h.v[s] > 0 THEN 'I' ELSE '' END WHEN 2 + w.v[s] = h.v[s] THEN 'D' WHEN 5 + h.v[supply[s]] = h.v[s] THEN 'I'
        WHEN r.fault IN (0, 3) AND CASE WHEN r.fault = 3 THEN 5 ELSE 0 END + w.v[keep[s][r.c]] = h.v[s] THEN 'K' ELSE 'R' END AS e
    FROM f JOIN b h ON h.g = f.g AND h.i = f.i LEFT JOIN b w ON w.g = f.g AND w.i = f.i + 1 LEFT JOIN r ON r.g = f.g AND r.i = f.i, fixed WHERE f.more)),
stats AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (before IS NOT NULL AND (before, c) NOT IN ((1, 2), (2, 3), (3, 2))) AS illegal FROM r GROUP BY g)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(b.v[1], 0) AS BIGINT) AS cost, coalesce(f.audit, '') AS audit, sha256(array_to_string(coalesce(f.lines, []), chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM m) e LEFT JOIN stats USING (g) LEFT JOIN b ON b.g = e.g AND b.i = 1 LEFT JOIN f ON f.g = e.g AND NOT f.more
"""
