"""The ten operators against SQL, brute force, libraries, round trips and held-out labels."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import crf, decontaminate, exact_dedup, fm_index, golomb, language_id, licenses, mixing, near_dedup, quality, queries, secrets, token_counts, toxicity, words
from quillgraph.operators import components
from quillgraph.session import Scratch

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(name, spark, sf_dir, duck, same):
    same(queries.QUERIES[name](spark, sf_dir), queries.SQL[name], duck)


# edge cases: nulls, empty and long texts, repeated rows, empty tables, extra columns


def edge_docs(spark, rows=None):
    long = "word " * 60_000
    base = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 3), (4, "one two", "en", None, 7), (4, "one two", "en", None, 7), (None, "one two", "en", "b", 7), (None, None, None, None, None),
        (5, long, "de", "b", len(long)), (6, long, "de", "b", len(long)), (7, "ümläut straße 日本語 😀 token = \"abcdefghijklmnop\"", "fr", "b", 40), (8, "all rights reserved all rights reserved", "en", "c", 1), (9, "###", "en", "c", 3),
    ]
    df = spark.createDataFrame(base if rows is None else rows, SCHEMA)
    for extra in ("leak", "x", "score", "kept", "id", "sha", "gone", "label", "component", "size"):
        df = df.withColumn(extra, F.lit("clash"))
    return df


def test_edges(spark):
    bench = spark.createDataFrame([(1, "one two"), (2, None), (None, "###"), (3, "")], "item_id bigint, text string")
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (7, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    everything = F.lit(True)
    for rows in (None, []):
        docs = edge_docs(spark, rows)
        n = docs.count()
        plain = docs.select("doc_id", "text", "source", "lang")
        near = near_dedup.near_duplicates(docs)
        exact = exact_dedup.exact_duplicates(docs)
        leaks = decontaminate.find_leaks(plain, bench)
        model = toxicity.train(docs, labels.select("doc_id", F.col("toxic").alias("y")), Scratch(spark, "t"))
        for df in (
            near, exact, leaks, mixing.curriculum(docs), mixing.mix(docs), secrets.find_secrets(docs), token_counts.prefix_of(token_counts.token_prefixes(docs, path), 3), quality.quality_scores(docs, labels, everything),
            toxicity.tag(docs, model), language_id.identify(docs, language_id.train(docs.select("doc_id", "text", "lang"))),
        ):
            assert df.count() == n
        assert licenses.scan(docs).agg(F.sum("copies")).first()[0] == (n or None)
        assert decontaminate.without_leaks(docs, bench).columns == docs.columns
        assert exact_dedup.without_copies(docs).columns == docs.columns
        assert quality.keep_good(docs, labels, everything, 0.5).columns == docs.columns
        if not n:
            continue
        # of 12 rows: null and "" (ids 1, 2, null) are one text, "one two" another, two long ones
        kept = exact.filter("kept").collect()
        assert len(kept) == len({r["text_sha256"] for r in kept}) == 7
        assert exact_dedup.without_copies(docs).count() == 7
        sizes = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact.collect()}
        assert sizes[1] == (2, 3) and sizes[4] == (4, 3) and sizes[5] == (6, 2) and sizes[9] == (9, 1)
        by = {r["doc_id"]: r for r in near.collect()}
        assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[1]["component_id"] == 1 and by[3]["kept"]
        assert by[6]["component_id"] == 5 and not by[6]["kept"] and by[4]["n_shingles"] == 1
        hit = {r["doc_id"]: [tuple(s)[:2] for s in r["leak"]["spans"]] for r in leaks.collect()}
        assert hit[4] == [(0, 2)] and hit[7] == [] and hit[1] == []
        lic = {r["doc_id"]: [s["first_word"] for s in r["spans"] if s["whole"]] for r in licenses.scan(docs).collect()}
        assert lic[8] == [0, 3] and lic[1] == []
        lang = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, language_id.train(docs.select("doc_id", "text", "lang"))).collect()}
        assert lang[1] == lang[2] == lang[9] == "und" and lang[4] in ("de", "en", "fr")
        mixed = mixing.curriculum(docs).collect()
        assert all(r["taken"] <= 2 * r["size"] for r in mixed) and sum(r["size"] for r in mixed if r["doc_id"] == 5) == 60_000


# words


def test_word_kernel():
    rng = random.Random(2)
    texts = ["".join(rng.choice("aB é\n\t.9_日") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", "x" * 5000]
    for alphabet, pattern in ((words.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (words.LETTER_OR_DIGIT, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for column in (pa.array(texts), pa.array(["skip", *texts])[1:]):
            got, known = [], {}
            for part in words.slices(column, 200):
                w = part.words(alphabet)
                h = w.hashes()
                for i in range(len(part)):
                    found = [w.text(j) for j in range(w.first[i], w.first[i + 1])]
                    got.append(found)
                    for j, word in zip(range(w.first[i], w.first[i + 1]), found, strict=True):
                        assert known.setdefault(word, h[j]) == h[j]
            assert got == [re.findall(pattern, (t or "").translate(LOW)) for t in texts]
            assert len(set(known.values())) == len(known)


# 1


def brute_components(docs, percent):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("percent,block", [(85, 1500), (80, 3)])
def test_near_duplicates_brute_force(spark, percent, block):
    rng = random.Random(percent)
    vocabulary = [f"v{i}" for i in range(400)]
    rows = []
    for _ in range(8):
        base = rng.choices(vocabulary, k=rng.randint(3, 120))
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.2 else "  ".join(copy)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), percent=percent, block=block)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(rows, percent)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(60)] + [(300, 300)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "c")).collect()}
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


# 2


def test_fm_index_finds_all():
    rng = np.random.default_rng(1)
    for sigma in (2, 5, 40):
        text = rng.integers(0, sigma, 700)
        text[-1] = 0
        index = fm_index.FMIndex(text, sigma, sample=8)
        for size in (1, 2, 4):
            patterns = np.unique(rng.integers(1, sigma, (60, size)), axis=0)
            which, low, high = index.search(patterns)
            of, places = index.locate(low, high)
            got = sorted(zip(which[of].tolist(), places.tolist(), strict=True))
            want = sorted((p, i) for p, w in enumerate(patterns.tolist()) for i in range(len(text) - size + 1) if text[i : i + size].tolist() == w)
            assert got == want


def test_leaks_in_blocks_and_shards(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = decontaminate.find_leaks(docs, bench).collect()
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    parts = decontaminate.find_leaks(docs, bench, block_bytes=2000, pass_bytes=8000).collect()
    key = lambda r: (r["doc_id"], r["leak"]["n_words"], str(r["leak"]["spans"]), r["leak"]["items"])
    assert sorted(map(key, whole)) == sorted(map(key, parts))
    for r in whole:
        text = docs.filter(F.col("doc_id") == r["doc_id"]).first()["text"] if r["leak"]["spans"] else ""
        for s in r["leak"]["spans"]:
            found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOW))[s["first_word"] : s["end_word"]]
            assert re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text[s["first_char"] : s["end_char"]].translate(LOW)) == found
    clean = {r["doc_id"] for r in decontaminate.without_leaks(docs, bench).collect()}
    assert clean == {r["doc_id"] for r in whole if not r["leak"]["spans"]}


# 3


def test_licenses_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_licenses"](spark, sf_dir).collect()}
    for i, text in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        hits = [(j, t.label) for t in licenses.TEMPLATES if t.base for j in range(len(w)) if w[j : j + len(t.text.split())] == t.text.split()]
        r = got[i]
        starts = [j for j, _ in hits]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(hits), ",".join(sorted({x for _, x in hits})))
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if hits else (None, None)) and 0 <= r["score"] <= 1


def longest_rise(pairs):
    """By comparing each match with all before it."""
    best = [1] * len(pairs)
    for j, (a, p) in enumerate(pairs):
        best[j] = max([1, *(best[i] + 1 for i in range(j) if pairs[i][0] < a and pairs[i][1] < p)])
    return max(best, default=0)


def brute_labels(text, templates):
    """Labels of the method: neighbouring diagonals of matching word pairs, then a window whose matches in order hold enough of the template."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    places = collections.defaultdict(list)
    for i, pair in enumerate(zip(w, w[1:], strict=False)):
        places[pair].append(i)
    labels = set()
    for t in templates:
        own = t.text.split()
        if t.base:
            if any(w[j : j + len(own)] == own for j in range(len(w))):
                labels.add(t.label)
            continue
        matches = [(i, p) for p, pair in enumerate(zip(own, own[1:], strict=False)) for i in places.get(pair, ())]
        diagonals = sorted({i - p for i, p in matches})
        islands, now = [], []
        for d in diagonals:
            if now and d - now[-1] > licenses.GAP:
                islands.append(now)
                now = []
            now.append(d)
        for island in [*islands, now]:
            some = sorted((i, p) for i, p in matches if i - p in island)
            for i, _ in some:
                near = [m for m in some if i <= m[0] and m[0] + 2 - i <= int(licenses.STRETCH * len(own)) + 1]
                if longest_rise(near) >= licenses.COVERAGE * (len(own) - 1):
                    labels.add(t.label)
    return ",".join(sorted(labels))


def test_license_labels_brute_force(spark, sf_dir):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r["labels"] for r in queries.QUERIES["op3_licenses"](spark, sf_dir).collect()}
    assert got == {i: brute_labels(t, licenses.TEMPLATES) for i, t in rows.items()}


def test_license_with_changed_words(spark):
    rng = random.Random(5)
    full = licenses.TEMPLATES[4].text.split()
    long = licenses.Template("long", " ".join(f"t{i}" for i in range(300)))
    templates = (*licenses.TEMPLATES, long, licenses.Template("four", "one two three four", True))
    texts = ["foo Permission is hereby granted, free of charge, to ANY person who is obtaining a copy of software and associated documentation files bar. CC BY cc by"]
    texts += [" ".join(reversed(full)), " ".join(full[12:] + full[:12]), "of this " * 200 + " ".join(full) + " of this" * 200, "one two x three four one two three four"]
    for _ in range(40):
        source = list(rng.choice((full, long.text.split(), licenses.TEMPLATES[5].text.split())))
        for _ in range(rng.randint(0, len(source) // 3)):
            at = rng.randrange(len(source))
            source[at : at + 1] = rng.choice(([], ["new"], [source[at], "new"], [source[rng.randrange(len(source))]]))
        texts.append(" ".join(["pre"] * rng.randint(0, 5) + source + ["post"] * rng.randint(0, 5)))
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), templates).collect()
    for r in got:
        labels = {templates[s["template"]].label for s in r["spans"] if s["whole"]}
        assert ",".join(sorted(labels)) == brute_labels(texts[r["doc_id"]], templates), texts[r["doc_id"]]
    found = {r["doc_id"]: [(templates[s["template"]].label, s["first_word"], s["end_word"]) for s in r["spans"] if s["whole"]] for r in got}
    assert [x for x, *_ in found[0]].count("cc-by") == 2 and found[1] == [] and found[2] == [] and found[3] == [("mit", 400, 400 + len(full))] and found[4] == [("four", 5, 9)]


# 4, 5, 8


def held_out_accuracy(spark, query, label, folder="/root/testdata/sf0.01"):
    found = queries.QUERIES[query](spark, folder)
    return found, spark.read.parquet(f"{folder}/{'documents' if label == 'lang' else 'labels'}.parquet")


def test_quality_held_out(spark):
    found, labels = held_out_accuracy(spark, "op4_quality", "quality")
    rows = found.join(labels, "doc_id").filter("held_out").select(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.min("score"), F.max("score")).first()
    assert rows[0] >= 0.95 and 0 <= rows[1] <= rows[2] <= 1


def test_quality_against_plain_numpy(spark, sf_dir):
    """The whole fit over all labelled rows at once: ridge by least squares, calibration by its quadratic program's conditions."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r["quality"] for r in labels.filter(~quality.held_out()).dropna(subset=["quality"]).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = [i for i in texts if i in known]
    x = np.array(list(quality.statistics(pa.array([texts[i] for i in ids]))))
    y = np.array([float(known[i]) for i in ids])
    fourier = quality.Fourier(x.mean(axis=0), x.std(axis=0))
    f, w = fourier(x), np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    root = np.sqrt(w)[:, None]
    left = np.vstack([f * root, np.sqrt(quality.RIDGE * len(y)) * np.eye(f.shape[1])])
    weights = np.linalg.lstsq(left, np.r_[y * root[:, 0], np.zeros(f.shape[1])], rcond=None)[0]
    raw = f @ weights
    bins = collections.defaultdict(list)
    for r, v in zip(raw, y, strict=True):
        bins[round(max(-1.0, min(2.0, r)) * quality.BINS / 3)].append((r, v))
    keys = sorted(bins)
    at, mean, n = (np.array([g(bins[k]) for k in keys]) for g in (lambda b: np.mean([r for r, _ in b]), lambda b: np.mean([v for _, v in b]), len))
    levels = np.array([max(min(np.average(mean[i : k + 1], weights=n[i : k + 1]) for k in range(j, len(keys))) for i in range(j + 1)) for j in range(len(keys))])  # min-max formula of isotonic regression
    everyone = np.array(list(quality.statistics(pa.array([texts[i] for i in texts]))))
    z = fourier(everyone) @ weights
    want = dict(zip(texts, np.clip(0.9998 * np.interp(z, at, levels) + 1e-4 * (1 + np.tanh(z - 0.5)), 0, 1), strict=True))
    got = {r["doc_id"]: r["score"] for r in queries.QUERIES["op4_quality"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_toxicity_held_out(spark):
    found, labels = held_out_accuracy(spark, "op5_toxicity", "toxic")
    rows = found.join(labels, "doc_id").filter("held_out").select(F.avg((F.col("predicted") == F.col("toxic")).cast("int")), F.min("score"), F.max("score")).first()
    assert rows[0] >= 0.9 and 0 <= rows[1] <= rows[2] <= 1


def test_language_held_out(spark):
    found, docs = held_out_accuracy(spark, "op8_language_id", "lang")
    assert found.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] >= 0.97


def test_language_decoding_by_hand(spark, sf_dir):
    """Predictions from the fitted weights by plain loops over n-grams and codewords."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.train(docs.filter(~language_id.held_out()).select("text", "lang"))
    some = docs.filter("doc_id % 7 = 0").select("doc_id", "text")
    got = {r["doc_id"]: r for r in language_id.identify(some, model).collect()}
    mask, shift = (1 << 32) - 1, 32 - 12
    for i, text in ((r["doc_id"], r["text"]) for r in some.collect()):
        if not any(c.isalpha() for c in text or ""):
            assert got[i]["lang_pred"] == "und"
            continue
        data = [b + 32 if 65 <= b <= 90 else b for b in text.encode()]
        counts = collections.Counter()
        for k in range(len(data)):
            h = ((data[k] + 1) * 2654435761) & mask
            counts[h >> shift] += 1
            if k + 1 < len(data):
                h = ((h ^ (data[k + 1] + 7)) * 2246822519) & mask
                counts[h >> shift] += 1
            if k + 2 < len(data):
                h = ((h ^ (data[k + 2] + 13)) * 3266489917) & mask
                counts[h >> shift] += 1
        total = sum(counts.values())
        x = np.zeros(language_id.BINS)
        for b, c in counts.items():
            x[b] = np.sqrt(c / total)
        margins = [float(sum((x[b] - float(model.mean[b])) * model.weights[b, bit] for b in range(len(x)))) for bit in range(model.code.shape[1])]
        loss = [sum(float(t) * np.log1p(np.exp(-4 * m * c)) for t, m, c in zip(model.trust, margins, row, strict=True)) for row in model.code]
        likely = np.exp(-4 * (np.array(loss) - min(loss)))
        assert got[i]["lang_pred"] == model.languages[int(np.argmin(loss))] and abs(got[i]["score"] - (likely / likely.sum()).max()) < 1e-4


def test_language_sample_of_copies(spark):
    """A text that is most of all rows reaches the driver once."""
    rows = [(f"word {i} der die und", "de") for i in range(50)] + [(f"word {i} the of and", "en") for i in range(50)] + [("the one text of the many copies", "en")] * 5000
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id bigint, text string, lang string")
    model = language_id.train(docs.select("text", "lang"), rows=10_400)
    assert model.languages == ["de", "en"]
    got = {r["text"]: r["lang_pred"] for r in docs.join(language_id.identify(docs, model), "doc_id").collect()}
    assert all(got[t] == x for t, x in rows)


def test_isotonic_and_codes():
    rng = np.random.default_rng(3)
    v, w = rng.random(50), rng.random(50) + 0.1
    fit = quality.isotonic(v, w)
    assert (np.diff(fit) >= -1e-12).all()
    # no small shift of a level lowers the weighted error
    for level in np.unique(fit):
        at = fit == level
        assert abs(((v - fit) * w)[at].sum()) < 1e-9
    for n in (1, 2, 4, 9, 30):
        code = language_id.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n


def test_crf_equals_enumeration():
    rng = np.random.default_rng(5)
    chain = crf.Chain(6)
    chain.weights, chain.edges, chain.first = rng.normal(size=6), rng.normal(size=(2, 2)), 0.3
    features = rng.integers(0, 6, (9, 2))
    starts = np.zeros(9, bool)
    starts[[0, 3, 4]] = True
    got = chain.marginals(features, starts)
    emit = np.log(chain.odds(features))
    for a, b in ((0, 3), (3, 4), (4, 9)):
        total, mass = 0.0, np.zeros(b - a)
        for code in range(2 ** (b - a)):
            s = [(code >> i) & 1 for i in range(b - a)]
            p = np.exp(chain.first * s[0] + sum(emit[a + i] * x for i, x in enumerate(s)) + sum(chain.edges[x, y] for x, y in zip(s, s[1:], strict=False)))
            total += p
            mass += p * np.array(s)
        assert np.allclose(got[a:b], mass / total)


def test_moebius_scan_over_columns():
    rng = np.random.default_rng(6)
    a, b, c, d = rng.random((4, 1000)) + 0.1
    x, want = 1.0, []
    for t in range(1000):
        x = (a[t] * x + b[t]) / (c[t] * x + d[t])
        want.append(x)
    assert np.allclose(crf.moebius_scan(a, b, c, d), want)


def test_crf_learns_spans():
    rng = np.random.default_rng(7)
    features = rng.integers(0, 4, (4000, 1))
    states = (features[:, 0] == 2).astype(int)
    starts = np.zeros(4000, bool)
    starts[::50] = True
    chain = crf.Chain(4)
    chain.fit(crf.Runs.of(features, starts, states * features.any(axis=1)))
    assert ((chain.marginals(features, starts) >= 0.5) == states).mean() > 0.99


# 6


def test_golomb_round_trip():
    rng = np.random.default_rng(8)
    for n, limit in ((0, 10), (1, 1 << 40), (1000, 1 << 44), (500, 501)):
        values = np.sort(rng.choice(limit, n, replace=False) if limit < 1000 else np.unique(rng.integers(0, limit, n)))
        bits, unary, rest = golomb.encode(values, limit)
        assert (golomb.decode(len(values), bits, unary, rest) == values).all()
        if len(values) > 100 and limit > 1 << 40:
            assert 8 * (len(unary) + len(rest)) / len(values) < np.log2(limit / len(values)) + 2.5


def test_exact_with_many_owners(spark):
    rows = [(i, f"text {i % 37}") for i in range(300)]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id int, text string").repartition(7), owner_rows=3).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    for r in got:
        own = groups[f"text {r['doc_id'] % 37}"]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
        assert r["text_sha256"] == hashlib.sha256(f"text {r['doc_id'] % 37}".encode()).hexdigest()


# 7


def test_prefix_counts_equal_library(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    counter = token_counts.counter(path)
    rng = random.Random(10)
    odd = [
        "", "don't we're  they'll 've", "a\n\nb \n c\t\td   ", "x<|endoftext|>y <|endo<|endoftext|><|endoftext|> z", "日本語 テキスト émoji 😀😀!!", "====----    ####" * 3, "\U00013000" * 95 + " end", "z" * 150, "ſ K \x1c\x85c\xa0d ​ f",
        *("".join(rng.choice("ab 'tsrevl\n\t.,1é<|>") for _ in range(40)) for _ in range(40)),
    ]
    for t in odd:
        assert counter.counts(t).tolist() == [count(t[:i]) for i in range(len(t) + 1)], t
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    table = Scratch(spark, "tokens").keep(token_counts.token_prefixes(rows, path))
    for limit in (0, 16, 512):
        longest = {r["doc_id"]: r["longest_prefix"] for r in token_counts.prefix_of(table, limit).collect()}
        for r in table.collect():
            text = texts[r["doc_id"]]
            assert (r["n_tokens"], r["n_bytes"], r["n_chars"]) == (count(text), len(text.encode()), len(text))
            counts = token_counts.read_prefixes(r["prefix_steps"], r["width"])
            cut = longest[r["doc_id"]]
            assert counts[-1] == r["n_tokens"] and counts[cut] <= limit and all(counts[cut + 1 :] > limit)


def test_stored_steps_of_long_drops(spark):
    """A run of one sign whose count falls by much at once still reads back exactly."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["=" * n for n in (1, 63, 64, 65, 128, 1000)] + ["", None, "a b " * 2000]
    rows = token_counts.token_prefixes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), path).collect()
    for r in rows:
        want = token_counts.counter(path).counts(texts[r["doc_id"]] or "")
        assert (token_counts.read_prefixes(r["prefix_steps"], r["width"]) == want).all()


# 9, 10


def test_mix_by_refilling(spark, sf_dir):
    rows = mixing.curriculum(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    size = collections.Counter()
    for r in rows:
        size[r["source"]] += r["size"]
    names = sorted(size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, rest, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(size.values()), set(names)
    while True:
        unit = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > 2 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            rest -= target[s]
        open_ -= over
    target |= {s: unit * weight[s] for s in open_}
    taken = collections.Counter()
    for r in rows:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["taken"] <= 2 * r["size"] and r["source_size"] == size[r["source"]]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) < 1 for s in names)
    # a visit's position is the share of all words that stand before it
    seen, total, density = 0, sum(taken.values()), []
    for r in mixing.training_order(mixing.curriculum(spark.read.parquet(f"{sf_dir}/documents.parquet"))).collect():
        density.append(abs((seen + r["words"] / 2) / total - r["position"]))
        seen += r["words"]
    assert max(density) < 0.15 and sum(density) / len(density) < 0.05
    for r in mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect():
        assert (r["positions"].count(",") + 1 if r["positions"] else 0) == -(-r["taken"] // max(1, r["size"])) or r["positions"].count(",") == 1
    order = mixing.training_order(mixing.curriculum(spark.read.parquet(f"{sf_dir}/documents.parquet"))).collect()
    assert sum(r["words"] for r in order) == sum(taken.values()) and all(a["position"] <= b["position"] for a, b in zip(order, order[1:], strict=False))


@pytest.mark.parametrize("sizes", [[5], [0, 0], [], [100, 1, 1, 1, 1], [7, 50, 3, 900, 20, 4, 1, 0], list(range(1, 200))])
def test_targets_refill(spark, sizes):
    """Targets of many sources, by reference to pouring what full ones leave into the rest."""
    rows = [(f"=s{i:04}", f"s{i:04}", n) for i, n in enumerate(sizes)]
    got = {r["key"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "key string, source string, source_size bigint"), Scratch(spark, "t"), 1.5, (3, 1, 2), (0.5, 0.0, -0.5), 2.0).collect()}
    weight = {k: (3, 1, 2)[i % 3] for i, (k, _, _) in enumerate(rows)}
    size = {k: n for k, _, n in rows}
    want, open_, rest = {}, set(size), 1.5 * sum(sizes)
    while open_:
        unit = rest / sum(weight[k] for k in open_)
        over = {k for k in open_ if unit * weight[k] > 2 * size[k]}
        if not over:
            want |= {k: unit * weight[k] for k in open_}
            break
        for k in over:
            want[k] = 2.0 * size[k]
            rest -= want[k]
        open_ -= over
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_base_secrets_by_finditer(spark):
    """All three base kinds with lengths around their limits, overlaps and neighbours, against plain regular expressions."""
    kinds = [
        ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", re.ASCII), 2, 12),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
    ]
    rng = random.Random(8)
    bits = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "=", ":", ' = "', "': '", " ", "\n", "é", "😀", "AKIA", "xyz", "-._=+/", *("a1" * n for n in (5, 6, 7, 8, 9)), "f" * 15, "0" * 16, "AKIA" + "Z" * 13, "AKIA" + "Q9" * 7, "k" * 11, "k" * 12, "k" * 13]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(400)] + [None, "", "token=token=abcdefghijklmnop", "passwordpassword: aaaaaaaaaaaa"]
    rows = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for r in rows:
        want = sorted((m.start(), at, m.end()) for at, (_, pattern, group, least) in enumerate(kinds) for m in pattern.finditer(texts[r["doc_id"]] or "") if len(m.group(group)) >= least)
        got = [(s["start"], [k for k, *_ in kinds].index(s["kind"]), s["end"]) for s in r["spans"] if s["strong"]]
        assert got == want, texts[r["doc_id"]]


def test_linked_secrets(spark):
    rows = [
        (1, "id AKIAABCDEFGHIJ then token = abcdefg end"), (2, "token = abcdefg alone"), (3, "api_key: 'abc' AKIA" + "Z" * 20 + " mail me@x.org"), (4, "password: token= abcdefghijklmnopq"),
        (5, "x" * 500 + " AKIAABCDEFGHIJ " + "y " * 300 + "secret=abcdefg"), (6, "ü " * 200 + "SECRET=\"0123456789abcdef01\""),
    ]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [k for k, *_ in got[1]] == ["partial", "short"] and got[2] == [] and got[4] == [] and got[5] == []
    assert [k for k, *_ in got[3]] == ["access", "endpoint"]
    assert [(k, rows[5][1][a:b]) for k, a, b in got[6]] == [("assign", 'SECRET="0123456789abcdef01'), ("hex", "0123456789abcdef01")]
    for i, spans in got.items():
        assert all(rows[i - 1][1][a:b].strip() for _, a, b in spans)


@pytest.mark.parametrize("length", [60, 376, 631, 1000, 5000])
def test_secret_after_a_long_part(spark, length):
    long, gap = "aB3" * (length // 3 + 1), " " + "- " * 40
    rows = [(i, "x " * i + long + gap + "AKIAABCDEFGHIJ") for i in range(0, 256, 17)] + [(1000, "AKIAABCDEFGHIJ" + gap + long), (1001, long + " -" * 70 + " AKIAABCDEFGHIJ")]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got.pop(1001) == [] and got.pop(1000) == ["partial", "key"]
    assert len(got) == 16 and all(kinds == ["key", "partial"] for kinds in got.values())


def test_toxicity_learns_from_long_documents(spark):
    short = [(i, f"{i} " + ("calm words here badshort again " * 3 if i % 2 else "calm words here again today " * 3), i % 2) for i in range(40)]
    long = [(100 + i, f"{i} " + "calm words here badlong again " * 42_000, 1) for i in range(3)]
    docs = spark.createDataFrame([r[:2] for r in short + long], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in short + long], "doc_id bigint, y int")
    model = toxicity.train(docs, labels, Scratch(spark, "t"))
    probe = spark.createDataFrame([(1, "calm badlong again"), (2, "calm badshort again"), (3, "calm words again")], "doc_id bigint, text string")
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in toxicity.tag(probe, model).collect()}
    assert spans == {1: [(5, 12)], 2: [(5, 13)], 3: []}


def brute_gradient(chain, features, starts, states):
    """By numerical differences of the log likelihood, summed over all labellings of each sequence."""
    size = len(chain.weights)

    def likelihood(values):
        at = crf.Chain(size)
        at.weights, at.first = values[:size], values[-1]
        at.edges = np.array([[0.0, values[size]], [values[size + 1], values[size + 2]]])
        emit = np.log(at.odds(features))
        heads = [*np.flatnonzero(starts).tolist(), len(starts)]
        out = 0.0
        for a, b in zip(heads, heads[1:], strict=False):
            value = lambda s: at.first * s[0] + emit[a:b] @ np.array(s) + sum(at.edges[x, y] for x, y in zip(s, s[1:], strict=False))  # noqa: B023, E731
            every = [value([(code >> i) & 1 for i in range(b - a)]) for code in range(2 ** (b - a))]
            out += value(states[a:b].tolist()) - np.log(np.exp(every).sum())
        return out

    values = np.r_[chain.weights, chain.edges[0, 1], chain.edges[1, 0], chain.edges[1, 1], chain.first]
    return np.array([(likelihood(values + d) - likelihood(values - d)) / 2e-5 for d in np.eye(len(values)) * 1e-5])


def test_crf_gradient_of_runs():
    rng = np.random.default_rng(3)
    for seed in range(6):
        features = rng.integers(1, 4, (40, 2)) * (rng.random((40, 1)) < 0.4 + 0.1 * seed)
        starts = np.zeros(40, bool)
        starts[[0, 1, 7, 8, 9, 17, 26, 33, 39]] = True
        states = (rng.random(40) < 0.6).astype(int) * features.any(axis=1)
        chain = crf.Chain(4)
        chain.weights, chain.first = rng.normal(size=4), 0.4
        chain.edges = np.array([[0.0, 0.3], [-0.7, 1.1]])
        assert np.allclose(crf.Runs.of(features, starts, states).gradient(chain), brute_gradient(chain, features, starts, states), atol=1e-5)


def test_toxicity_score_by_enumeration(spark):
    """Whole-document scores from the fitted weights, over all labellings of short texts."""
    import itertools

    words_ = ["calm", "again", "badone", "badtwo", "here"]
    rng = random.Random(4)
    rows = [(i, f"n{i} " + " ".join(rng.choices(words_[:2] + words_[4:], k=8) + (["badone", "badtwo"] if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, y int"), Scratch(spark, "t"))
    probe = [(i, " ".join(rng.choices(words_, k=6))) for i in range(30)]
    got = {r["doc_id"]: r["score"] for r in toxicity.tag(spark.createDataFrame(probe, "doc_id bigint, text string"), model).collect()}
    chain = model.chain
    for i, text in probe:
        part = next(iter(words.slices(pa.array([text]))))
        own = part.words(words.LETTER_OR_DIGIT)
        emit = np.log(chain.odds(model.lexicon.index(toxicity._hashed(own))))
        mass, total = np.zeros(6), 0.0
        for s in itertools.product((0, 1), repeat=6):
            p = np.exp(chain.first * s[0] + emit @ np.array(s) + sum(chain.edges[x, y] for x, y in zip(s, s[1:], strict=False)))
            total, mass = total + p, mass + p * np.array(s)
        p = mass / total
        assert abs(got[i] - (1 - np.prod(1 - p[p >= 0.05]))) < 1e-6


def test_near_copies_without_a_common_center(spark):
    """Copies that are each near the base and not near each other, and a chain where only neighbours are near."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for k in range(40):
        copy = list(base)
        for i in rng.sample(range(200), 3):
            copy[i] = f"x{k}.{i}"
        rows.append((1 + k, " ".join(copy)))
    chain = [f"c{i}" for i in range(200)]
    for k in range(30):
        chain[k * 5] = f"y{k}"
        rows.append((100 + k, " ".join(chain)))
    for block in (512, 4):
        for some in (rows, rows[1:]):
            got = near_dedup.near_duplicates(spark.createDataFrame(some, "doc_id bigint, text string").repartition(3), percent=85, block=block)
            assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(some, 85)


def test_links_of_a_block_only_merge():
    """A bucket of n like sets, all in components of their own, gives n - 1 links and not n squared."""
    sets = [np.unique(np.r_[np.arange(400), 1000 + i]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for i in range(60)]
    sketching = near_dedup.MinHash(near_dedup.SKETCH, 1, seed=11)
    sets = [np.sort(s) for s in sets]
    table = pa.table({
        "cid": list(range(60)), "component": list(range(60)), "n_shingles": [len(s) for s in sets], "side": [0] * 60, "band": [0] * 60,
        "sketch": [(sketching.signature(s) >> np.uint32(7)).astype(np.uint8).tobytes() for s in sets], "bands": [np.zeros(1, np.uint64).tobytes()] * 60, "members": [s.tobytes() for s in sets],
    })
    assert near_dedup._merging(85)(table).num_rows == 59


def test_sieve_loses_no_key(spark):
    from quillgraph.llm.sieve import Sieve

    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("a.b"))
    keys = rows.filter("id % 50 = 0").select("`a.b`")
    for bits in (28, 15):
        out, may = Sieve(keys, bits).split(rows, F.col("`a.b`"))
        assert out.columns == rows.columns and out.count() + may.count() == 20_000 and may.filter("id % 50 = 0").count() == 400
        assert bits == 15 or may.count() < 2500


def test_without_copies_ranks_and_repeats(spark):
    rows = [(None, "a", "x"), (-1, "a", "y"), (None, "b", "x"), (None, "b", "w"), (3, "c", "q"), (3, "c", "p"), (2, "c", "o"), (5, None, "m"), (4, "", "m"), (6, "d", "m"), (6, "e", "m")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, extra string").repartition(3)
    got = sorted((tuple(r) for r in exact_dedup.without_copies(docs).collect()), key=str)
    assert got == sorted([(-1, "a", "y"), (None, "b", "w"), (3, "c", "p"), (5, None, "m"), (6, "d", "m"), (6, "e", "m")], key=str)
