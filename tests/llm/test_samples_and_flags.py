"""What is learned from: no language, many languages, copies; large feature numbers; ids that repeat among near copies."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillgraph.llm import language_id, near_dedup, toxicity, words


def test_no_language_to_learn(spark):
    rows = [(1, "some words", None), (2, None, "en"), (3, "12", None), (4, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for labelled in (docs, docs.limit(0), docs.filter("doc_id = 1")):
        got = language_id.identify(docs, language_id.train(labelled.select("text", "lang"))).collect()
        assert {tuple(r) for r in got} == {(i, "und", 0.0, True) for i, _, _ in rows}


def test_more_languages_than_sampled_rows(spark):
    """Every language gives a row, so each can be predicted."""
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), (F.col("id") % 30).cast("string")).alias("lang"), F.repeat(F.chr(F.lit(97) + F.col("id") % 26), F.lit(5) + F.col("id") % 30).alias("text"))
    model = language_id.train(docs.select("text", "lang"), rows=10)
    assert len(model.languages) == 30 and language_id.identify(docs, model).filter("lang_pred = 'und'").count() == 0
    many = language_id.OutputCode([str(i) for i in range(4500)], np.random.default_rng(1).random((4500, language_id.BINS), dtype=np.float32), np.arange(4500))
    which, score, _ = many.predict(np.zeros((2, language_id.BINS), np.float32))
    assert ((0 <= which) & (which < 4500)).all() and np.isfinite(score).all()


def test_language_of_copies_is_learned(spark):
    """A language whose rows are copies of one text keeps its row, whatever its hash is."""
    for n in range(4):
        rows = [(f"{i} der die und das", "de") for i in range(40)] + [(f"le texte {n} est une copie", "fr")] * 400 + [(f"the one of {i} and the", "en") for i in range(40)]
        docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id bigint, text string, lang string")
        model = language_id.train(docs.select("text", "lang"), rows=9)
        assert model.languages == ["de", "en", "fr"]
        assert language_id.identify(docs.filter("lang = 'fr'"), model).select("lang_pred").distinct().collect() == [("fr",)]


def test_features_beyond_sixteen_bits():
    own = words.hash_words(["zebra"], words.LETTER_OR_DIGIT)
    lexicon = toxicity.Lexicon(np.concatenate([np.arange(1, 40_001, dtype=np.uint64) * np.uint64(1 << 32), own]))
    want = int(np.searchsorted(lexicon.sorted, own[0])) + 1
    batch = pa.RecordBatch.from_arrays([pa.array(["a Zebra"]), pa.array([1], pa.int32())], ["text", "y"])
    for shift in (0, 40_000):
        lexicon.sorted = np.concatenate([np.arange(1, shift + 1, dtype=np.uint64), lexicon.sorted])
        (row,) = next(toxicity._sequences(lexicon)([batch])).to_pylist()
        assert np.frombuffer(row["features"], np.int32).reshape(-1, toxicity.KINDS)[0, 0] == want + shift


def test_kept_goes_by_doc_id(spark, tmp_path):
    """Two near copies with one doc_id both have component_id = doc_id, so both are kept in op1's result."""
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text + " x"), (5, text + " y"), (9, text), (7, "alone"), (None, text + " z"), (None, "none")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = near_dedup.op1_near_dedup(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [("5", "5", True), ("5", "5", True), ("7", "7", True), ("9", "5", False), ("None", "5", False), ("None", "None", True)]
