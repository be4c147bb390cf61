"""The pipeline's stages, each against what it should keep of its own input."""

import re

from pyspark.sql import functions as F

import pytest

import corpus_pipeline
from quillgraph.llm.mixing import curriculum
from quillgraph.session import Scratch

from .test_llm import LOW, brute_components


def words(text, size):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def test_stages(spark, sf_dir):
    scratch = Scratch(spark, "pipeline-test")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("extra", F.lit("kept"))
    columns = docs.columns
    before = docs.collect()
    bench = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        after = docs.collect()
        if name == "mix":
            assert len(after) == len(before) and sum(r["taken"] for r in after) > 0
            break
        assert docs.columns == columns and set(after) <= set(before)
        ids = {r["doc_id"] for r in after}
        if name == "quality":
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
            right = [(r["doc_id"] in ids) == (r["quality"] == 1) for r in labels]
            assert sum(right) >= 0.9 * len(right)
        if name == "exact_dedup":
            best = {}
            for r in before:
                best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
            assert ids == set(best.values())
        if name == "near_dedup":
            assert ids == {c for _, c in brute_components([(r["doc_id"], r["text"]) for r in before], 80).values()}
        if name == "decontaminate":
            windows = {w for t in bench for w in (words(t, 10) or words(t, len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW)))))}
            sizes = {len(w) for w in windows}
            assert ids == {r["doc_id"] for r in before if not any(windows & words(r["text"], n) for n in sizes)}
        before = after
    assert curriculum(docs.limit(0).select(F.lit(1).alias("doc_id"), F.lit("a").alias("text"), F.lit("s").alias("source"))).count() == 0


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken", "position", "positions"] and out.count() > 0


def test_near_copies_with_null_and_repeated_ids(spark):
    def text(name, n=60, **changed):
        return " ".join(changed.get(f"w{i}", f"{name}{i}") for i in range(n))

    near = {"w30": "other"}
    rows = [
        (None, text("a")), (None, text("a", **near)), (None, text("a", w59="end")),  # near copies without ids: one stays
        (None, text("b")), (9, text("b", **near)),  # the row with an id stays
        (1, text("c")), (2, text("c", **near)), (2, text("d")),  # id 2 is a near copy once, and a text of its own
        (3, text("e")), (3, text("f")), (4, text("e", **near)), (4, text("f", **near)), (4, text("g")),  # both rows of id 3 stay
        (5, text("h")), (5, text("h", **near)),  # near copies of one id: one stays
        (None, None), (None, " "), (6, None), (None, text("i")),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("gone", F.lit("clash"))
    out = corpus_pipeline.keep_one_near(spark, docs.repartition(3), "")
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert out.columns == docs.columns
    several = [r for r in got if r in rows[:3]], [r for r in got if r in rows[13:15]]
    assert [len(s) for s in several] == [1, 1]
    rest = [r for r in got if r not in rows[:3] + rows[13:15]]
    assert sorted(rest, key=str) == sorted([rows[i] for i in (4, 5, 7, 8, 9, 12, 15, 16, 17, 18)], key=str)


CLASH = ("leak", "x", "score", "kept", "id", "sha", "gone", "gone_text", "id_row", "c0", "size", "position", "sieve_page")


@pytest.mark.parametrize("filled", [True, False])
def test_run_over_odd_tables(spark, tmp_path, filled):
    """Nulls in any column, empty and 10 MB texts, repeats, ties, empty tables and clashing names, from end to end."""

    def text(name, n=60, **changed):
        return " ".join(changed.get(f"w{i}", f"{name}{i}") for i in range(n))

    long, flat = " ".join(f"long{i}" for i in range(1_000_000)), "z" * 10_000_000
    leak = text("bench", 14)
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \n ", None), (None, None, None), (4, text("p"), "a"), (4, text("p"), "a"), (None, text("q"), None), (None, text("q"), None), (5, text("p"), None),
        (6, text("p", w30="other"), "b"), (7, long, "b"), (8, flat, "b"), (9, flat, "c"), (10, "before " + leak + " after", "c"), (11, text("r"), "a"), (11, text("s"), "a"),
    ]
    docs = spark.createDataFrame(rows if filled else [], "doc_id bigint, text string, source string")
    for name in CLASH:
        docs = docs.withColumn(name, F.lit("clash"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak), (2, None), (None, ""), (3, leak)] if filled else [], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # one of the empty texts (the one of 2) and the blank one stay; 4 and 5 are one text, 6 is near to it; 10 holds a passage
    want = [2, 3, 5, 7, 9, 11, 11, None] if filled else []
    assert sorted((r["doc_id"] for r in got), key=str) == sorted(want, key=str)
    assert not filled or {r["doc_id"]: r["size"] for r in got}[7] == 1_000_000
