from pyspark.sql import functions as F

from quillmill.operators import similarity
from quillmill.sources import readers, registry, sinks
from quillmill.streaming import streams


def test_conll_round_trip(spark, tmp_path):
    rows = [(1, 1, "天", "O"), (1, 2, "地", "。"), (2, 1, "玄", "O")]
    df = spark.createDataFrame(rows, "s int, idx int, text string, punct string")
    path = str(tmp_path / "c")
    sinks.write_conll(df, path, ["s"], ["text", "punct"], doc_mark=True, one_file=True)
    got = readers.columns(spark, path + "/*.txt", "0:text,1:punct").orderBy("sent", "idx").collect()
    assert [(r["sent"] + 1, r["idx"], r["text"], r["punct"]) for r in got] == rows


def test_columns_ragged_and_comment(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("# c\nx\tO\ny\n\n\n-DOCSTART-\n\nz\tB\n")
    p = str(tmp_path / "a.tsv")
    assert [(r["text"], r["ner"], r["sent"]) for r in readers.columns(spark, p, "0:text,1:ner", "#").orderBy("sent", "idx").collect()] == [("x", "O", 0), ("y", None, 0), ("z", "B", 1)]
    assert readers.columns(spark, p, "0:text,1:ner", "#", ragged="drop").count() == 2
    assert [r["ner"] for r in readers.columns(spark, p, "0:text,1:ner", "#", ragged="empty").orderBy("sent", "idx").collect()] == ["O", "", "B"]


def test_conllu(spark, tmp_path):
    (tmp_path / "a.conllu").write_text("# t\n1-2\tdu\t_\t_\t_\t_\t_\t_\t_\t_\n1\tThe\tthe\tDET\tDT\tDefinite=Def|PronType=Art\t2\tdet\t_\t_\n2\tcat\tcat\tNOUN\tNN\tNumber=Sing\t0\troot\t_\t_\n\n")
    df = readers.conllu(spark, str(tmp_path / "a.conllu"))
    got = df.orderBy("idx").collect()
    assert [(r["form"], r["head"], r["deprel"]) for r in got] == [("The", 2, "det"), ("cat", 0, "root")] and got[0]["feats"]["definite"] == "Def"
    assert readers.with_root(df).count() == 3


def test_labelled_csv_embeddings_wiki(spark, tmp_path):
    (tmp_path / "l.txt").write_text("__label__a __label__b good text __label__c\nno label\n__label__x \n")
    got = readers.labelled_lines(spark, str(tmp_path / "l.txt")).collect()
    assert [(r["labels"], r["text"]) for r in got] == [(["a", "b"], "good text __label__c")]
    (tmp_path / "c.csv").write_text("t1,t2,l1,l2\na,b,x,\nc,d,,\n")
    assert [(r["labels"], r["text"]) for r in readers.csv_classes(spark, str(tmp_path / "c.csv"), ["t1", "t2"], ["l1", "l2"]).collect()] == [(["x"], "a b")]
    (tmp_path / "e.txt").write_text("2 3\nw 1 2 3\nv 0 0 1\n")
    assert {r["word"]: r["vec"] for r in readers.embeddings(spark, str(tmp_path / "e.txt")).collect()} == {"w": [1, 2, 3], "v": [0, 0, 1]}
    (tmp_path / "w.txt").write_text("Rome|NN|I-LOC is|VB|O\n")
    assert [(r["idx"], r["text"], r["ner"]) for r in readers.wiki_ner(spark, str(tmp_path / "w.txt")).orderBy("idx").collect()] == [(1, "Rome", "I-LOC"), (2, "is", "O")]


def test_text_dir_lines_tsv(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_bytes("天\xff地".encode("utf-8")[:3] + b"\xff" + "地".encode())
    assert readers.text_dir(spark, str(tmp_path / "d")).collect()[0]["text"] == "天地"
    (tmp_path / "s.txt").write_text(" a \n\nb\nc\n")
    assert [r["text"] for r in readers.line_sentences(spark, str(tmp_path / "s.txt"), 2).collect()] == ["a", "b"]
    (tmp_path / "log.tsv").write_text("EPOCH\tF\n1\t_\n2\t0.5\n")
    assert [r["F"] for r in readers.tsv_log(spark, str(tmp_path / "log.tsv")).orderBy("EPOCH").collect()] == [None, "0.5"]
    (tmp_path / "p.tsv").write_text("a b\tr\nonly\n")
    assert sorted((r["cand"], r["wrong"]) for r in readers.retrieval_pairs(spark, str(tmp_path / "p.tsv")).collect()) == [("a b", False), ("only", True)]


def test_parquet_tokens_and_splits(spark, tmp_path):
    p = str(tmp_path / "t.parquet")
    spark.createDataFrame([(0, "a", "O"), (0, "b", None), (1, "c", "X")], "sentence_id int, text string, punct string").coalesce(1).write.parquet(p)
    got = {r["sentence_id"]: [(t["text"], t["punct"]) for t in r["tokens"]] for r in readers.parquet_tokens(spark, p, tags=("punct",)).collect()}
    assert got == {0: [("a", "O"), ("b", "")], 1: [("c", "X")]}
    names = spark.createDataFrame([("x/eng.train",), ("x/eng.testa",), ("x/eng.testb",), ("x/a.gz",)], "p string").select(readers.split_of(F.col("p")).alias("s")).collect()
    assert [r["s"] for r in names] == ["train", "dev", "test", None]
    assert registry.parse_layout("1:text,2:ner") == {1: "text", 2: "ner"} and "conllu" in registry.available()


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT id, CASE WHEN id % 3 = 0 THEN 'same line here' ELSE concat('text number ', id) END AS text, timestamp '2024-03-01' AS at FROM range(9)").coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    s = streams.first_copies(streams.clean(streams.read(spark, src, schema), "text"), "text", "at")
    streams.run(s, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7


def test_conllu_narrow_rows(spark, tmp_path):
    (tmp_path / "a.conllu").write_text("# c\n1\tA\n2\tb\n\n1\tx\tNN\n2-3\tyz\tNN\n\nalone\nword\n\n1\tf\tl\tU\n1.1\te\tl\tU\n")
    got = [(r["sent"], r["idx"], r["form"], r["lemma"], r["upos"]) for r in readers.conllu(spark, str(tmp_path / "a.conllu")).orderBy("sent", "idx").collect()]
    assert got == [(0, 1, "A", None, None), (0, 2, "b", None, None), (1, 1, "x", None, "NN"), (2, 1, "alone", None, None), (2, 2, "word", None, None), (3, 1, "f", "l", "U")]


def test_splits_of_one_file(spark, tmp_path):
    """A file that is read in many splits gives the same sentences."""
    lines = []
    for i in range(400):
        lines += [f"t{i}a\tA{i}", f"t{i}b\tB{i}", *[""] * (1 + i % 3)]
    (tmp_path / "big.txt").write_text("\r\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        got = readers.columns(spark, str(tmp_path / "big.txt"), "0:text,1:tag").orderBy("sent", "idx").collect()
        line = readers.line_sentences(spark, str(tmp_path / "big.txt")).orderBy("line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["sent"], r["idx"], r["text"], r["tag"]) for r in got] == [x for i in range(400) for x in ((i, 1, f"t{i}a", f"A{i}"), (i, 2, f"t{i}b", f"B{i}"))]
    assert [(r["line"], r["text"]) for r in line] == [(i, x) for i, x in enumerate(lines) if x]


def test_reviews_intensity_language_model(spark, tmp_path):
    for name, text in (("train/pos/1.txt", "good\n one"), ("train/neg/2.txt", "bad"), ("test/pos/3.txt", "fine")):
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text(text)
    assert sorted((r["split"], r["labels"][0], r["text"]) for r in readers.reviews(spark, str(tmp_path / "r")).collect()) == [("test", "pos", "fine"), ("train", "neg", "bad"), ("train", "pos", "good one")]
    (tmp_path / "e.txt").write_text("id\ttext\tname\tscore\n1\tso happy\tjoy\t0.5\n2\toh\tjoy\t0.25\n")
    assert sorted((r["labels"][0], r["text"]) for r in readers.intensity(spark, str(tmp_path / "e.txt")).collect()) == [("0.25", "oh"), ("0.5", "so happy")]
    (tmp_path / "lm" / "train").mkdir(parents=True)
    for i in range(2):
        (tmp_path / "lm" / "train" / f"split_{i}.txt").write_text("".join(f"Line {i} {k}\n" for k in range(300)))
    (tmp_path / "lm" / "valid.txt").write_text("Va\nVb\n")
    (tmp_path / "lm" / "test.txt").write_text("Te\n")
    got = readers.language_model(spark, str(tmp_path / "lm"), flip=0.05).orderBy("line").collect()
    train = [r["text"] for r in got if r["split"] == "train"]
    assert len(train) == 600 and sorted(x.lower() for x in train) == sorted(f"line {i} {k}" for i in range(2) for k in range(300)) and train != sorted(train)
    assert 5 < sum(x.isupper() for x in train) < 80 and 5 < sum(x.islower() for x in train) < 80
    assert [r["text"] for r in got if r["split"] == "dev"] == ["Va", "Vb"] and [r["text"] for r in got if r["split"] == "test"] == ["Te"]


def test_resumed_writing(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(100).withColumnRenamed("id", "k")
    assert sinks.write_missing(rows.filter("k < 40"), path, "k") == 40
    assert sinks.write_missing(rows, path, "k") == 60 and sinks.write_missing(rows, path, "k") == 0
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == list(range(100))


def test_index_with_a_size_limit(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "id bigint, text string")
    rows = similarity.index(df, "id", "text", 16)
    sinks.write_index(rows, similarity.bands(rows, "id", 8, 2), str(tmp_path / "i"), {"slots": 16}, most=300)
    stored, banded, notes = similarity.stored_index(spark, str(tmp_path / "i"))
    kept = sorted(r["id"] for r in stored.collect())
    assert kept == list(range(len(kept))) and 10 < len(kept) < 50 and notes == {"slots": "16", "rows": str(len(kept))}
    assert similarity.self_test(stored, banded, "id").collect()[0].asDict() == {"keys": len(kept), "found": len(kept), "least": 8, "most": 8}


def test_configuration_and_stream_restart(spark, tmp_path):
    assert registry.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}, "d": {"x": 1}}) == {"a": {"b": 9, "c": 2}, "d": {"x": 1}}
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    part = lambda a, b: spark.range(a, b).selectExpr("id", "concat('line number ', id) AS text").coalesce(1).write.mode("append").parquet(src)
    part(0, 5)
    schema = spark.read.parquet(src).schema
    go = lambda: streams.run(streams.clean(streams.read(spark, src, schema), "text"), out, ck)
    go()
    part(5, 9)
    go()
    go()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(9))


def test_sentences_of_files_across_ranges(spark, tmp_path):
    """Sentence numbers were a join with a row for each sentence, broadcast by its compressed size."""
    import random

    rng = random.Random(3)
    want = []
    for f in range(5):
        rows = ["" if rng.random() < 0.3 else f"{f}-{i}" for i in range(rng.choice([0, 1, 40, 90]))]
        if f == 3:
            rows = [f"{f}-{i}" for i in range(120)]  # a sentence over several ranges
        (tmp_path / f"f{f}.txt").write_text("\n".join(rows) + "\n")
        sent, inside, idx = -1, False, 0
        for r in rows:
            sent, idx, inside = sent + (bool(r) and not inside), (idx + 1 if inside else 1), bool(r)
            if r:
                want.append((f"f{f}.txt", sent, idx, r))
    got = readers.columns(spark, str(tmp_path), "0:text")
    assert sorted((r["path"].rsplit("/", 1)[-1], r["sent"], r["idx"], r["text"]) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == plan.count("rightHint=(strategy=broadcast)") == 1


def test_conllu_is_written_without_a_join(spark, monkeypatch, tmp_path):
    from quillmill.sources import sinks

    plans = []
    real = sinks._write
    monkeypatch.setattr(sinks, "_write", lambda df, *a: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df, *a)))
    rows = spark.createDataFrame([(1, 1, "a", 0.25), (1, 2, "b", 0.5), (2, 1, "c", 0.75)], "s int, idx int, form string, score double")
    sinks.write_conllu(rows, str(tmp_path / "out"), ["s"], "score")
    assert "Join" not in plans[0]
    text = "\n\n".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert "# Tree score: 0.5\n1\ta" in text and "# Tree score: 0.75\n1\tc" in text
