"""Texts: chunks, near duplicates, line search, catalogues, Markdown."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import glob_regex
from ..session import Scratch, prepare

#: Sizes of chunks in tokens and the overlap in characters (fixed values).
TARGET, LEAST, MOST, OVERLAP = 500, 100, 1000, 150


def pieces(text: str) -> int:
    """Pieces around white space; an empty text has one."""
    return len(re.split(r"\s+", text))


def tokens(text: str) -> int:
    """1.3 tokens a piece."""
    return math.ceil(pieces(text) * 1.3)


def chunk_text(text: str | None) -> list[str]:
    """Paragraphs gathered to about TARGET tokens, long ones by sentences, each chunk beginning with the end of the one before."""
    chunks: list[str] = []
    now, count = "", 0

    def add(piece: str, glue: str) -> None:
        """count is pieces(now), carried along; white space at a seam is one with the glue."""
        nonlocal now, count
        joint = (count - now[-1:].isspace()) + (pieces(piece) - piece[:1].isspace()) if now else pieces(piece)
        if now.strip() and math.ceil(joint * 1.3) > TARGET:
            chunks.append(now.strip())
            now = now[-OVERLAP:] + glue + piece
            count = pieces(now)
        else:
            now += (glue if now else "") + piece
            count = joint

    for paragraph in re.split(r"\n{2,}", text or ""):
        if not paragraph.strip():
            continue
        if tokens(paragraph) <= MOST:
            add(paragraph, "\n\n")
            continue
        if now.strip():
            chunks.append(now.strip())
        now, count = "", 0
        for sentence in re.split(r"(?<=[.!?])\s+", paragraph):
            add(sentence, " ")
    if now.strip():
        if chunks and tokens(now) < LEAST:
            chunks[-1] += "\n\n" + now.strip()
        else:
            chunks.append(now.strip())
    return chunks


def chunk_documents(docs: DataFrame) -> DataFrame:
    """(id, position, content) of documents (id, text); one document stays in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, p, c) for i, text in zip(batch["id"], batch["text"], strict=True) for p, c in enumerate(chunk_text(text))]
            yield pd.DataFrame(rows, columns=["id", "position", "content"])

    prepare(docs.sparkSession)
    return docs.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(run, "id string, position int, content string")


def document_stats(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, words, tokens, n_chunks, mean_chunk) where words are the pieces around white space."""
    words = F.size(F.split("text", r"\s+", -1))
    counts = chunks.groupBy("id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("chars"))
    rows = docs.select(F.col("id").cast("string").alias("id"), words.alias("words"), F.ceil(words * 1.3).cast("int").alias("tokens")).join(counts, "id", "left")
    return rows.select("id", "words", "tokens", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.floor(F.col("chars") / F.col("n_chunks") + 0.5).cast("bigint").alias("mean_chunk"))


#: Texts, and their tokens together, that a block holds on average; a task compares two blocks.
BLOCK_TEXTS, BLOCK_TOKENS = 2048, 500_000
#: Texts of a block that are compared at once with those of another; copies that stand together; pairs in a batch.
SLICE, COPIES, PAIRS = 128, 512, 250_000
#: Products of single postings that cost as much as a column of a matrix product, as a share of all pairs.
SPARSE = 0.003
#: Whole numbers below this are exact in single precision, sums of them too.
SINGLE = 1 << 24

#: Columns of a block: its words and whether they are rare; features (a word's k-th occurrence in a text, by k) with the bags that have them;
#: counts of the first ones; of each bag its size, sum of squares and number of texts; their ids.
PACKED = {"words": "string", "rare": "boolean", "word": "int", "level": "int", "df": "int", "bags": "int", "counts": "int", "n": "bigint", "q": "bigint", "texts": "int"}


def _packed(table: pa.Table) -> pa.Table:
    """One row of a block from its rows (block, id, w, c, rare); texts of the same tokens are one bag, of at most COPIES texts."""
    table = table.combine_chunks()
    ids, words = (table.column(c).chunk(0).dictionary_encode() for c in ("id", "w"))
    text, code, count = ids.indices.to_numpy(), words.indices.to_numpy(), table.column("c").to_numpy()
    order = np.lexsort((code, text))
    text, code, count = text[order], code[order], count[order]
    ends = np.searchsorted(text, np.arange(len(ids.dictionary)), side="right")
    bag, first, seen = np.empty(len(ends), int), [], {}
    for k, (start, end) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)):
        key = code[start:end].tobytes() + count[start:end].tobytes()
        at, size = seen.get(key, (0, COPIES))
        if size == COPIES:
            at, size = len(first), 0
            first.append(k)
        bag[k], seen[key] = at, (at, size + 1)
    mine = np.isin(text, first)
    owner, code, count = bag[text[mine]], code[mine], count[mine]
    n, q = (np.bincount(owner, w, len(first)).astype(np.int64) for w in (count, count * count))
    level = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    owners, codes, counts = (np.repeat(x, count) for x in (owner, code, count))
    order = np.lexsort((owners, codes, level))
    owners, codes, level, counts = owners[order], codes[order], level[order], counts[order]
    begin = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (level[1:] != level[:-1])]))
    rare = np.empty(len(words.dictionary), bool)
    rare[words.indices.to_numpy()] = table.column("rare").to_numpy()
    found = [words.dictionary, rare, codes[begin], level[begin], np.diff(begin, append=len(codes)), owners, counts[level == 0], n, q, np.bincount(bag)]
    found = [pa.array(x).cast(pa.int32()) if PACKED[c] == "int" else pa.array(x) if isinstance(x, np.ndarray) else x for c, x in zip(PACKED, found, strict=True)]
    found.append(ids.dictionary.take(pa.array(np.argsort(bag, kind="stable"))))
    return pa.table({"block": table.column("block")[:1]} | {c: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for c, x in zip([*PACKED, "ids"], found, strict=True)})


class _Block:
    """A block as arrays."""

    def __init__(self, batch: pa.RecordBatch, row: int, side: str):
        self.block = batch.column(f"{side}block")[row].as_py()
        self.words, self.ids = (batch.column(f"{side}{c}")[row].values for c in ("words", "ids"))
        self.rare, self.word, self.level, self.df, self.bags, self.counts, self.n, self.q, self.texts = (batch.column(f"{side}{c}")[row].values.to_numpy(zero_copy_only=False) for c in list(PACKED)[1:])
        self.ends, self.first = np.cumsum(self.df), np.cumsum(self.texts) - self.texts


def _spans(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each span, one after the other."""
    return np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())


def _products(x: _Block, y: _Block, f: np.ndarray, g: np.ndarray, weighted: int, most: int):
    """A function from a slice of the bags of x to two matrices, sums over the features f of x and g of y, the same ones: of ones, and of products of counts over the first `weighted` features.

    Features of many pairs are columns of a matrix product, the others give one product at a time. No sum exceeds most.
    """
    kind = np.float32 if most < SINGLE else np.float64
    dense = x.df[f].astype(np.int64) * y.df[g] > SPARSE * len(x.n) * len(y.n)

    def matrix(b: _Block, at: np.ndarray, counted: bool) -> np.ndarray:
        out, places = np.zeros((len(b.n), len(at)), kind), _spans(b.ends[at] - b.df[at], b.df[at])
        out[b.bags[places], np.repeat(np.arange(len(at)), b.df[at])] = b.counts[places] if counted else 1
        return out

    first = np.flatnonzero(dense[:weighted])
    factors = [(matrix(x, f[at], counted), matrix(y, g[at], counted).T) for at, counted in ((dense, False), (first, True))]
    weighted -= len(first)
    f, g = f[~dense], g[~dense]
    places, feature = _spans(x.ends[f] - x.df[f], x.df[f]), np.repeat(np.arange(len(f)), x.df[f])
    order = np.lexsort((feature >= weighted, x.bags[places]))
    places, feature = places[order], feature[order]
    bags, counts = x.bags[places], np.where(feature < weighted, x.counts[np.minimum(places, len(x.counts) - 1)], 0).astype(kind)
    begin, many, own, theirs = (y.ends[g] - y.df[g])[feature], y.df[g][feature], bags.astype(np.int64) * len(y.n), y.counts.astype(kind)

    def sums(rows: slice) -> tuple[np.ndarray, np.ndarray]:
        some = slice(*np.searchsorted(bags, [rows.start, rows.stop]))
        there = _spans(begin[some], many[some])
        at = y.bags[there] + np.repeat(own[some] - rows.start * len(y.n), many[some])
        ones, product = (left[rows] @ right for left, right in factors)
        np.add.at(ones.reshape(-1), at, kind(1))
        np.add.at(product.reshape(-1), at, np.repeat(counts[some], many[some]) * theirs[np.minimum(there, len(theirs) - 1)])
        return ones, product

    return sums


def _compared(least: float, rare: bool):
    """(a, b, similarity) of the texts of a block with those of another or the same, from rows of both; rare: of different bags only such as share a rare word."""

    def near(x: _Block, y: _Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Bags of x and y that are near."""
        word = pc.index_in(y.words, x.words).fill_null(-1).to_numpy()[y.word]
        known = np.flatnonzero(word >= 0)
        number = lambda level, word: level.astype(np.int64) << 32 | word
        # by level, so that words come before their further occurrences
        _, f, g = np.intersect1d(number(x.level, x.word), number(y.level[known], word[known]), assume_unique=True, return_indices=True)
        g = known[g]
        ones = np.count_nonzero(x.level[f] == 0)
        shared = _products(x, y, f, g, ones, max(x.q.max(), y.q.max()))
        few = np.flatnonzero(x.rare[x.word[f[:ones]]])
        met = _products(x, y, f[few], g[few], 0, SINGLE - 1) if rare else None
        nx, ny, qx, qy = (z.astype(float) for z in (x.n, y.n, x.q, y.q))
        rough = [z.astype(np.float32) for z in (nx[:, None], ny, 1 / np.sqrt(qx[:, None]), 1 / np.sqrt(qy))]
        for start in range(0, len(nx), SLICE):
            rows = slice(start, start + SLICE)
            m, p = shared(rows)
            # a rough sum first, so that few pairs are looked at closely
            about, cosine = rough[0][rows] + rough[1], p * rough[3]
            about = np.divide(m, about - m, out=about)
            cosine *= rough[2][rows]
            about += cosine
            at = np.flatnonzero(about >= 2 * least - 1e-4)
            a, b = np.divmod(at, len(ny))
            m, p, a = m.reshape(-1)[at].astype(float), p.reshape(-1)[at].astype(float), a + start
            score = (m / (nx[a] + ny[b] - m) + p / np.sqrt(qx[a] * qy[b])) / 2
            fine = (score >= least) & (p > 0)
            if x.block == y.block:
                fine &= a <= b
            if rare:
                fine &= (met(rows)[0].reshape(-1)[at] > 0) | (m == nx[a]) & (m == ny[b])
            yield a[fine], b[fine], score[fine]

    def texts(x: _Block, y: _Block, a: np.ndarray, b: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The pairs of texts that bags stand for."""
        many = x.texts[a].astype(np.int64) * y.texts[b]
        part = np.cumsum(many) // PAIRS
        for k in np.unique(part):
            at = slice(*np.searchsorted(part, [k, k + 1]))
            which, place = np.repeat(np.arange(at.start, at.stop), many[at]), _spans(np.zeros(at.stop - at.start, int), many[at])
            mine, theirs = np.divmod(place, y.texts[b[which]])
            mine, theirs = mine + x.first[a[which]], theirs + y.first[b[which]]
            if x.block == y.block:
                once = mine < theirs
                mine, theirs, which = mine[once], theirs[once], which[once]
            yield pa.RecordBatch.from_pydict({"a": x.ids.take(pa.array(mine)), "b": y.ids.take(pa.array(theirs)), "similarity": pa.array(np.floor(score[which] * 1e6 + 0.5) / 1e6)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, y = _Block(batch, row, ""), _Block(batch, row, "other_")
                for found in near(x, y):
                    yield from texts(x, y, *found)

    return run


def near_duplicates(rows: DataFrame, least: float = 0.5, limit: int | None = None, max_df: int | None = None, texts: int = BLOCK_TEXTS, tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(a, b, similarity): pairs of texts (id, text) whose mean of multiset Jaccard and count cosine is at least `least`.

    Every pair counts, those of texts with the same tokens too. At low thresholds nearly every pair that
    shares a frequent token could be near, so no pair is filtered beforehand: texts fall into blocks, each
    block is written as one row, and a task reads rows of some blocks and some others from that table and
    sums up what their texts share. Nothing is shuffled but the texts, once. Work and pairs are quadratic
    in the number of texts, the disk beside the result holds the texts twice or so, and a task's memory is
    that of two blocks and a slice of their pairs. With max_df, tokens in more texts than that bring no
    different texts together (they still count), which may lose pairs.
    """
    scratch = Scratch(prepare(rows.sparkSession), "near")
    pieces = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}-]+"), lambda w: F.octet_length(w) > 1)
    known = rows.filter("id IS NOT NULL")
    size = known.agg(F.count("*"), F.coalesce(F.sum(F.greatest(F.size(pieces), F.lit(0))), F.lit(0))).first()
    blocks = max(1, math.ceil(size[0] / texts), math.ceil(size[1] / tokens))
    placed = known.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).repartition(blocks, "block")
    bags = placed.select("block", "id", F.explode(pieces).alias("w")).groupBy("block", "id", "w").agg(F.count("*").alias("c"))
    if max_df is None:
        flagged = bags.withColumn("rare", F.lit(True))
    else:
        bags = scratch.keep(bags)
        flagged = bags.join(bags.groupBy("w").agg((F.count("*") <= max_df).alias("rare")), "w").select(*bags.columns, "rare")
    kind = rows.schema["id"].dataType.simpleString()
    packed = scratch.keep(flagged.groupBy("block").applyInArrow(_packed, ", ".join(["block int", *(f"{c} array<{t}>" for c, t in PACKED.items()), f"ids array<{kind}>"])))
    others = packed.toDF(*(f"other_{c}" for c in packed.columns))
    met = packed.join(others.hint("shuffle_replicate_nl"), F.col("block") <= F.col("other_block"))
    scored = met.mapInArrow(_compared(least, max_df is not None), f"a {kind}, b {kind}, similarity double")
    out = scored.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    return out if limit is None else out.orderBy(F.desc("similarity"), "a", "b").limit(limit)


def regex_log_search(files: DataFrame, pattern: str, literal: bool = False, case: bool = False, most: int = 100, width: int = 200, most_bytes: int = 1_000_000) -> DataFrame:
    """(path, line_number, line) of lines that match in files (path, text) of at most most_bytes; lines over 10 * width are skipped, others cut to width."""
    source = re.escape(pattern) if literal else pattern
    lines = files.filter(F.octet_length("text") <= most_bytes).select("path", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).filter((F.length("line") <= 10 * width) & F.col("line").rlike(source if case else f"(?i){source}"))
    cut = F.when(F.length("line") > width, F.concat(F.substring("line", 1, width - 3), F.lit("..."))).otherwise(F.col("line"))
    return lines.select("path", (F.col("n") + 1).alias("line_number"), cut.alias("line")).orderBy("path", "line_number").limit(most)


#: Names that file listings skip (fixed values).
IGNORED = (
    ".git", ".svn", ".hg", ".bzr", "node_modules", "__pycache__", ".venv", "venv", ".env", "env", ".tox", ".nox", ".eggs", "*.egg-info", "site-packages", "dist", "build",
    ".next", ".nuxt", ".output", ".turbo", "target", "out", ".idea", ".vscode", "*.swp", "*.swo", "*~", ".project", ".classpath", ".settings", ".DS_Store", "Thumbs.db", "desktop.ini", "*.lnk",
    "*.log", "*.tmp", "*.temp", "*.bak", "*.cache", ".cache", "logs", ".coverage", "coverage", ".nyc_output", "htmlcov", ".pytest_cache", ".mypy_cache", ".ruff_cache",
)


def path_glob_filter(paths: DataFrame, pattern: str, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    skip = "|".join(glob_regex(g) for g in ignored)
    return paths.filter(F.col("path").rlike(glob_regex(pattern, segments=True)) & ~F.exists(F.split("path", "/"), lambda s: s.rlike(skip)))


def rank_catalog(catalog: DataFrame, query: str, most: int = 5) -> DataFrame:
    """Rows (pos, name, description): select:a,b by name; +word rest by names with word, ranked by hits of rest; else by pattern, names before descriptions."""
    if query.startswith("select:"):
        rows = catalog.filter(F.col("name").isin(*(n.strip() for n in query[7:].split(",")))).withColumn("score", F.lit(0))
    elif query.startswith("+"):
        word, _, rest = query[1:].partition(" ")
        score = F.regexp_count(F.concat_ws(" ", "name", "description"), F.lit(f"(?i){rest.strip()}")) if rest.strip() else F.lit(0)
        rows = catalog.filter(F.lower("name").contains(word.lower())).withColumn("score", score)
    else:
        try:
            re.compile(query)
        except re.error:
            query = re.escape(query)
        name = F.col("name").rlike(f"(?i){query}")
        rows = catalog.filter(F.concat_ws(" ", "name", "description").rlike(f"(?i){query}")).withColumn("score", F.when(name, 2).otherwise(1))
    return rows.orderBy(F.desc("score"), "pos").limit(most)


def search_notes(notes: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Rows (key, value) below a prefix with the text in key or value, whatever the case."""
    hit = F.lower("key").contains(text.lower()) | F.lower("value").contains(text.lower())
    return notes.filter(F.col("key").startswith(prefix) & hit).orderBy("key")


def stratified_split(rows: DataFrame, label: str, key: str, holdout: float, seed: int) -> DataFrame:
    """rows with is_test: in each class max(1, floor(n * holdout)) rows, chosen by a hash of key and seed.

    Rows are sorted over ranges of class and hash; a row's rank is its place in its range and what the
    ranges before hold of its class. So a class of all rows is spread over tasks. A null class is one class.
    """
    scratch = Scratch(prepare(rows.sparkSession), "split")
    names, order = rows.columns, ["_class", "_hash", "_key"]
    hashed = rows.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col(f"`{label}`").alias("_class"), F.md5(F.concat(F.col(f"`{key}`").cast("string"), F.lit(f":{seed}"))).alias("_hash"), F.col(f"`{key}`").alias("_key"))
    placed = scratch.keep(hashed.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = placed.groupBy("_class", "_range").agg(F.count("*").alias("_n"))
    of_class = Window.partitionBy("_class")
    earlier = F.coalesce(F.sum("_n").over(of_class.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sizes.select(F.col("_class").alias("_c"), F.col("_range").alias("_r"), earlier.alias("_before"), F.greatest(F.lit(1), F.floor(F.sum("_n").over(of_class) * holdout)).alias("_quota"))
    ranked = placed.withColumn("_place", F.row_number().over(Window.partitionBy("_class", "_range").orderBy("_hash", "_key")))
    both = ranked.join(before, F.col("_class").eqNullSafe(F.col("_c")) & (F.col("_range") == F.col("_r")))
    return both.select("_row.*", (F.col("_before") + F.col("_place") <= F.col("_quota")).alias("is_test"))


def markdown_cell(column: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(column.cast("string"), F.lit("")), r"\|", r"\\|"), "\n", " ")


def to_markdown_rows(df: DataFrame) -> DataFrame:
    """(line): a pipe-table row for each row; the head is markdown_head(df)."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(markdown_cell(F.col(f"`{c}`")) for c in df.columns)), F.lit(" |")).alias("line"))


def markdown_head(df: DataFrame) -> list[str]:
    return ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]


class _Page(HTMLParser):
    """A page's title and its body as Markdown."""

    SKIP = {"script", "style", "head", "noscript", "template"}
    BLOCK = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "table", "ul", "ol", "form", "figure"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title, self.in_title, self.skip = "", False, 0
        self.links: list[tuple[str, int]] = []
        self.lists: list[int | None] = []

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        elif tag in self.SKIP:
            self.skip += tag != "head"
        elif tag in self.BLOCK:
            self.out.append("\n\n")
            if tag in ("ul", "ol"):
                self.lists.append(0 if tag == "ol" else None)
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
                self.out.append(f"\n{self.lists[-1]}. ")
            else:
                self.out.append("\n- ")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code":
            self.out.append("`")
        elif tag == "tr":
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append("| ")
        elif tag == "a":
            self.links.append((dict(attrs).get("href") or "", len(self.out)))

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag in self.SKIP:
            self.skip = max(0, self.skip - (tag != "head"))
        elif tag in self.BLOCK or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code":
            self.out.append("`")
        elif tag in ("td", "th"):
            self.out.append(" ")
        elif tag == "a" and self.links:
            href, at = self.links.pop()
            text = "".join(self.out[at:]).strip()
            if href and not re.match(r"(?i)(javascript|mailto|tel):", href):
                self.out[at:] = [f"[{text}]({href})"]

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_markdown(html: str | None) -> tuple[str, str]:
    """A page's title and its body as Markdown; a character reference ends with a semicolon, else it is text as it stands."""
    page = _Page()
    page.feed(re.sub(r"&(?!#?\w+;)", "&amp;", html or ""))
    page.close()
    text = re.sub(r"[ \t]+\n", "\n", re.sub(r"\n[ \t]+", "\n", "".join(page.out)))
    return page.title.strip(), re.sub(r"\n{3,}", "\n\n", text).strip()


def pages_to_markdown(pages: DataFrame) -> DataFrame:
    """(page_id, title, markdown) of pages (page_id, html)."""

    @F.pandas_udf("title string, markdown string")
    def convert(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([html_to_markdown(h) for h in html], columns=["title", "markdown"])

    prepare(pages.sparkSession)
    return pages.select("page_id", convert("html").alias("m")).select("page_id", "m.title", "m.markdown")
