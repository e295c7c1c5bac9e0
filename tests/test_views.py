from pyspark.sql import functions as F

from quillmill.operators import views


def test_all_spans(spark):
    df = spark.createDataFrame([(s, i) for s, n in ((1, 7), (2, 1)) for i in range(1, n + 1)], "s int, idx int")
    got = sorted(tuple(r) for r in views.candidate_spans(df, ["s"]).collect())
    assert got == [(s, a, b) for s, n in ((1, 7), (2, 1)) for a in range(1, n + 1) for b in range(a, n + 1)]


def test_padding_never_cuts(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [5])], "i int, w array<int>")
    assert [r["p"] for r in df.orderBy("i").select(views.pad_ids(F.col("w"), 3).alias("p")).collect()] == [[1, 2, 3, 4], [5, 0, 0]]


def test_context_query_reaches_the_cap_of_500(spark, tmp_path):
    """A query of 20 tokens and a neighbour of 700 characters."""
    from quillmill.plans import catalogue

    asked, near = " ".join(chr(0x4E00 + i) for i in range(20)), "".join(chr(0x4E00 + i % 100) for i in range(700))
    spark.createDataFrame([(20, "c", "dev", "s", asked, "", "lzh")], "sentence_id int, corpus string, split string, source string, text string, punct string, lang string").write.parquet(f"{tmp_path}/column_corpus.parquet")
    spark.createDataFrame([(1, "b", "p", 1, near, "lzh")], "sent_id bigint, book_id string, path string, pos int, text string, lang string").write.parquet(f"{tmp_path}/sentences.parquet")
    assert len(catalogue.QUERIES["with_exact_context"](spark, str(tmp_path)).collect()[0]["line"].split(" ")) == 500
