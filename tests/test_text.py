import random
import re
import unicodedata

from pyspark.sql import functions as F

from quillmill.operators import text as tx


def one(spark, col, **row):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).select(col.alias("x")).collect()[0]["x"]


def model_keep(t, ends="。！？；\n"):
    parts = re.split(f"([{ends}]+)", t)
    out = []
    for i in range(0, len(parts), 2):
        s = parts[i].strip() + (parts[i + 1] if i + 1 < len(parts) else "")
        if s.strip():
            out.append(s.strip())
    return out


def test_split_matches_model(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab 。！？　；𡨸") for _ in range(rng.randint(0, 20))) for _ in range(500)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.split_keep(F.col("t"), "。！？；").alias("k"), tx.split_drop(F.col("t"), "。！？；").alias("d")).collect()
    for r in rows:
        assert r["k"] == model_keep(texts[r["i"]], "。！？；"), texts[r["i"]]
        assert r["d"] == [x.strip() for x in re.split("[。！？；]+", texts[r["i"]]) if x.strip()]


def test_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a. b")], "id int, text string")
    assert [r["sentence"] for r in tx.split_table(df, ends=".").orderBy("pos").collect()] == ["a.", "b"]
    assert one(spark, tx.collapse_blanks(F.col("t")), t=None) is None
    assert one(spark, tx.collapse_blanks(F.col("t")), t="　a  b\x1c") == "a b"


def test_nfc_and_digits(spark):
    assert one(spark, tx.nfc(F.col("t")), t=unicodedata.normalize("NFD", "Việt")) == "Việt"
    assert one(spark, tx.mask_digits(F.col("t")), t="a1٣") == "a##"


def test_dedup_keeps_first(spark):
    df = spark.createDataFrame([(1, "b", "x"), (2, "a", "x"), (3, "c", None), (4, "d", None), (5, "e", "y")], "id int, path string, text string")
    assert {r["id"] for r in tx.first_of_each(df, "text", "path", "id").collect()} == {2, 3, 5}
    assert tx.first_of_each(df.limit(0), "text", "path").count() == 0


def test_reasons_and_histogram(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abcde"), (3, "abcde"), (4, "x" * 201), (5, None), (6, "y" * 200)], "id int, text string")
    got = {r["id"]: r["reason"] for r in tx.reject_reasons(df, "text", "id").collect()}
    assert got == {1: "too_short", 2: "kept", 3: "duplicate", 4: "too_long", 5: "too_short", 6: "kept"}
    n = spark.createDataFrame([(20,), (19,), (200,)], "n int")
    assert {(r["bucket"], r["n"]) for r in tx.length_histogram(n, "n").collect()} == {("0-20", 1), ("20-50", 1)}


def model_punct(t, marks="，。？", ends="。？"):
    out, sent, cur = [], 0, []
    for ch in t:
        if ch.isspace():
            continue
        if ch in marks:
            if cur and cur[-1][1] == "O":
                cur[-1][1] = ch
                if ch in ends:
                    out += [(sent, i + 1, *x) for i, x in enumerate(cur)]
                    sent, cur = sent + 1, []
        else:
            cur.append([ch, "O"])
    return out + [(sent, i + 1, *x) for i, x in enumerate(cur)]


def test_punct_labels_match_model(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("甲乙丙 ，。？") for _ in range(rng.randint(0, 15))) for _ in range(300)]
    rows = tx.punct_labels(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t", "，。？", "。？").collect()
    got = {}
    for r in rows:
        got.setdefault(r["i"], []).append((r["sent"], r["idx"], r["token"], r["label"]))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == model_punct(t), t


def test_scalars(spark):
    assert one(spark, tx.escape_html(F.col("t")), t="<a&'\">") == "&lt;a&amp;&#x27;&quot;&gt;"
    assert one(spark, tx.key_values(F.col("t")), t="Case=Nom|Num=Sg|_") == {"case": "Nom", "num": "Sg"}
    assert one(spark, tx.edit_similarity(F.col("a"), F.col("b")), a="kitten", b="sitting") == 1 - 3 / 7
    assert one(spark, tx.clamp_score(F.col("t").cast("double")), t="3.2") == 1.0
    assert one(spark, tx.seconds_to_stamp(F.col("t").cast("bigint")), t="86400") == "1970-01-02-00-00-00"
    assert one(spark, tx.stamp_to_seconds(F.col("t")), t="1970-01-02-00-00-00") == 86400
