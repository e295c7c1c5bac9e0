import random

from quillmill.operators import tags

SCHEMA = "s int, idx int, text string, tag string, score double"


def table(spark, sents):
    return spark.createDataFrame([(i, j + 1, w, t, float(p)) for i, sent in enumerate(sents) for j, (w, t, p) in enumerate(sent)], SCHEMA)


WORDS = "Zalando Research is located in Berlin .".split()


def spans(spark, marks, scores=None, **kw):
    sent = [(w, t, (scores or [1.0] * len(WORDS))[i]) for i, (w, t) in enumerate(zip(WORDS, marks, strict=True))]
    return sorted((r["start"], r["stop"], r["tag"], r["text"], r["score"]) for r in tags.spans(table(spark, [sent]), ["s"], **kw).collect())


def test_span_schemes(spark):
    want = [(1, 2, "ORG", "Zalando Research"), (6, 6, "LOC", "Berlin")]
    for marks in (["B-ORG", "E-ORG", "O", "O", "O", "S-LOC", "O"], ["B-ORG", "I-ORG", "O", "O", "O", "B-LOC", "O"], ["I-ORG", "E-ORG", "O", "O", "O", "I-LOC", ""]):
        assert [x[:4] for x in spans(spark, marks)] == want


def test_span_odd_tags(spark):
    assert len(spans(spark, ["I-ORG", "E-ORG", "aux", "verb", "preposition", "I-LOC", "O"])) == 5
    odd = spans(spark, ["I-ORG", "S-LOC", "aux", "B-relation", "E-preposition", "S-LOC", "O"])
    assert len(odd) == 5 and odd[3][2:4] == ("relation", "located in")


def test_span_scores(spark):
    marks, scores = ["B-ORG", "E-ORG", "O", "O", "O", "S-LOC", "O"], [1.0, 0.9, 1, 1, 1, 0.5, 1]
    assert [x[4] for x in spans(spark, marks, scores)] == [0.95, 0.5]
    assert len(spans(spark, marks, scores, min_score=0.6)) == 1
    assert not spans(spark, marks, scores, min_score=0.99)


def test_repair_and_bioes_match_model(spark):
    rng = random.Random(1)
    sents = [[("w", rng.choice(["O", "B-a", "I-a", "B-b", "I-b"]), 1) for _ in range(rng.randint(1, 8))] for _ in range(200)]
    df = table(spark, sents)
    fixed = tags.repair_bio(df, ["s"])
    es = tags.bio_to_bioes(fixed, ["s"])
    got = {(r["s"], r["idx"]): r["tag"] for r in es.collect()}
    for i, sent in enumerate(sents):
        raw, rep = [t for _, t, _ in sent], []
        for j, t in enumerate(raw):
            if t[0] == "I" and (j == 0 or raw[j - 1] == "O" or raw[j - 1][1:] != t[1:]):
                t = "B" + t[1:]
            rep.append(t)
        for j, t in enumerate(rep):
            nxt = j + 1 < len(rep) and rep[j + 1][0] == "I"
            want = t if nxt or t == "O" else ("S" if t[0] == "B" else "E") + t[1:]
            assert got[i, j + 1] == want
    back = {(r["s"], r["idx"]): r["t"] for r in es.select("s", "idx", tags.bioes_to_bio(es.tag).alias("t")).collect()}
    assert back == {(r["s"], r["idx"]): r["tag"] for r in fixed.collect()}


def test_invalid_scheme_unchanged(spark):
    df = table(spark, [[("a", "S-x", 1), ("b", "I-y", 1)]])
    assert [r["tag"] for r in tags.repair_bio(df, ["s"]).orderBy("idx").collect()] == ["S-x", "I-y"]


def test_chunks_and_empty(spark):
    df = table(spark, [[("a", "B-x", 1), ("b", "I-x", 1), ("c", "I-y", 1), ("d", "O", 1), ("e", "E-y", 1)]])
    assert sorted((r["start"], r["stop"], r["kind"]) for r in tags.chunks(df, ["s"], "tag").collect()) == [(1, 2, "x"), (3, 3, "y"), (5, 5, "y")]
    assert tags.chunks(df.limit(0), ["s"], "tag").count() == 0 and tags.spans(df.limit(0), ["s"]).count() == 0


def test_space_after(spark):
    words = ["He", "said", '"', "yes", '"', "(", "no", ")", "."]
    df = table(spark, [[(w, "O", 1) for w in words]])
    got = [r["space_after"] for r in tags.space_after(df, ["s"]).orderBy("idx").collect()]
    assert "".join(w + " " * g for w, g in zip(words, got, strict=True)).strip() == 'He said "yes" (no).'
