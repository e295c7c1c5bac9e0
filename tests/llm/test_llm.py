"""Each operator against brute force on small tables, with nulls, empty tables, ties, repeated rows, hot groups and clashing columns."""

import random
import re
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmill.functions import codepoints as cp
from quillmill.llm import cross_split, groups, layout_copies, leaks, mixture, near_duplicates, one_form, personal_details, pieces, term_counts


def C(t):
    return "".join(ch.lower() for ch in t if unicodedata.category(ch)[0] in "LMN")


def K(t):
    return tuple(sorted(x for x in map(C, re.split("[|｜]", t)) if x)) if re.search("[|｜]", t) else C(t)


def sim(a, b, tenths):
    g = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    x, y = g(C(a)), g(C(b))
    return bool(x | y) and 10 * len(x & y) >= tenths * len(x | y)


def versions(seed, n=160):
    rng = random.Random(seed)
    syl = [c + v for c in "bcdfghklmnprst" for v in "aeiou"]
    words = ["".join(rng.choices(syl, k=rng.randint(1, 3))) for _ in range(150)]
    base = [" ".join(rng.choices(words, k=rng.randint(3, 25))) for _ in range(n // 4)] + ["".join(chr(rng.randint(0x4E00, 0x4F00)) for _ in range(rng.randint(12, 40))) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            i = rng.randrange(len(t))
            k = rng.random()
            if k < 0.4:
                t[i] = rng.choice("xyz天")
            elif k < 0.6:
                t.insert(i, rng.choice("qw地"))
            elif k < 0.8:
                del t[i : i + rng.randint(1, 4)]
            else:
                t = t[i:] + t[:i]
        s = "".join(t)
        out.append(rng.choice([s, s.upper(), s + "!", f"{s} | tail", f"tail|{s}"]))
    return out + [None, "", "short", "a" * 400, "long " * 100]


def pairs_model(rows, tenths):
    ok = [(i, t) for i, t in rows if t is not None and 12 <= len(C(t)) <= 300]
    return {(min(i, j), max(i, j)) for x, (i, a) in enumerate(ok) for j, b in ok[x + 1 :] if i != j and K(a) != K(b) and sim(a, b, tenths)}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = list(enumerate(versions(seed)))
    df = spark.createDataFrame(rows + rows[:20], "sent_id bigint, text string").withColumn("id", F.lit(7)).withColumn("c", F.lit("clash"))
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(df).collect()}
    want = pairs_model(rows, 6)
    assert want and got == want
    group = {r["id"]: r["group"] for r in near_duplicates.version_groups(df).collect()}
    assert set(group) == {i for i, _ in rows} and all(group[a] == group[b] for a, b in want)
    assert all(group[i] == i for i, t in rows if t is None)


def test_near_duplicates_hot_group(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefghijklmnop") for _ in range(60))
    rows = [(i, base[: i % 50] + rng.choice("xyz") + base[i % 50 + 1 :]) for i in range(120)] + [(1000 + i, "".join(rng.choice("qrstuv") for _ in range(50))) for i in range(60)] + [(2000 + i, base) for i in range(40)]
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(spark.createDataFrame(rows, "sent_id bigint, text string")).collect()}
    assert got == pairs_model(rows, 6)
    assert near_duplicates.near_duplicate_pairs(spark.createDataFrame([], "sent_id bigint, text string")).count() == 0


def routed(rows, parts, counts):
    batch = pa.RecordBatch.from_pydict({"rid": list(range(len(rows))), "c": rows})
    blobs = {}
    for out in near_duplicates._route(0.6, parts, counts)(iter([batch])):
        for p, b in zip(out["p"].to_pylist(), out["blob"].to_pylist(), strict=True):
            blobs.setdefault(p, []).append(b)
    return blobs


def pairs_of(blobs):
    found = set()
    for b in blobs:
        part = near_duplicates._Part(b)
        found |= {tuple(sorted((int(part.ids[x >> 32]), int(part.ids[x & 0xFFFFFFFF])))) for x in part.pairs(0.6).tolist()}
    return found


def plain_counts(rows, level=0):
    np = near_duplicates.np
    return near_duplicates.Counts(rows, 0, np.full(near_duplicates.BUCKETS, level, np.uint8), np.zeros(near_duplicates.PIECES, bool), np.zeros(near_duplicates.PIECES, np.int32), np.zeros(near_duplicates.PIECES, bool))


def test_trees_in_parts(spark, monkeypatch):
    """Trees that are built in parts lose nothing, whether they are split before the routing or after it."""
    texts = [t for t in versions(5, 80) if t and 12 <= len(C(t)) <= 300]
    rows = sorted({C(t) for t in texts})
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if sim(rows[i], rows[j], 6)}
    whole = routed(rows, 3, plain_counts(len(rows)))
    assert want and want <= pairs_of(whole.values())
    rest, found = [], set()
    for b in whole.values():
        part = near_duplicates._Part(b)
        rest += [[x] for x in part.split_off(2)]
        found |= {tuple(sorted((int(part.ids[x >> 32]), int(part.ids[x & 0xFFFFFFFF])))) for x in part.pairs(0.6).tolist()}
    assert rest and not want <= found and want <= found | pairs_of(rest)
    df = spark.createDataFrame(list(enumerate(rows)), "rid bigint, c string")
    for cap in (2, 30_000):
        assert want <= {tuple(sorted(r)) for r in near_duplicates.candidates(df, 0.6, per_part=300, cap=cap).collect()}
    monkeypatch.setattr(near_duplicates, "TREE_CAP", 2)
    assert want <= pairs_of(routed(rows, 3, plain_counts(4000, 3)).values())


def test_order_of_runs(monkeypatch):
    """Runs held by one record in some thousands are told from rarer ones; trees split by a count lose nothing."""
    np = near_duplicates.np
    level = near_duplicates.levels_of(np.array([1, 2, 3]), np.array([7, 12, 19]), 40_000, 0)
    assert level[1] == 0 < level[2] <= level[3]
    rows = sorted({C(t) for t in versions(5, 80) if t and 12 <= len(C(t)) <= 300})
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if sim(rows[i], rows[j], 6)}
    size = lambda blobs: sum(len(x) for b in blobs.values() for x in b)
    whole = size(routed(rows, 3, plain_counts(4000, 6)))
    monkeypatch.setattr(near_duplicates, "TREE_CAP", 2)
    split = routed(rows, 3, plain_counts(4000, 6))
    assert size(split) > whole and want <= pairs_of(split.values())


def test_short_versions():
    """The shortest texts, with a change at every place: most of their runs are broken, and no pair is lost."""
    rng = random.Random(8)
    rows, want = [], set()
    for _ in range(15):
        base = rng.sample("abcdefghijklmnopqrstuvwxyz0123456789", rng.randint(12, 20))
        places = [(base[:k], base[k:]) for k in range(len(base))]
        own = sorted({"".join(t) for a, b in places for t in (a + ["天"] + b, a + ["天"] + b[1:], a + b[1:], b + a) if len(t) >= 12})
        want |= {(len(rows) + i, len(rows) + j) for i in range(len(own)) for j in range(i + 1, len(own)) if sim(own[i], own[j], 6)}
        rows += own
    assert len(want) > 2000 and want <= pairs_of(routed(rows, 3, plain_counts(len(rows))).values())


def test_routing_does_not_depend_on_parts():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8))) for _ in range(3000)]
    rows = sorted({"".join(rng.choices(words, k=12))[:90] for _ in range(3000)})
    size = {p: sum(len(x) for b in routed(rows, p, plain_counts(len(rows))).values() for x in b) for p in (1000, 10_000, 100_000)}
    assert size[100_000] < 1.35 * size[1000]


def test_near_duplicates_few_letters(spark):
    """Texts over three letters and periodic ones, where gaps are filled by chance: nothing is lost."""
    rng = random.Random(21)
    rows = []
    for i in range(0, 400, 2):
        base = [rng.choice("abc") for _ in range(rng.randint(14, 60))] if i % 10 else list("abcde" * rng.randint(3, 12))
        t = list(base)
        for _ in range(rng.randint(1, 5)):
            k = rng.randrange(len(t))
            t[k : k + rng.randint(0, 2)] = rng.choice(["a", "b", "xy", ""])
        rows += [(i, "".join(base)), (i + 1, "".join(t))]
    rows += [(1000 + i, "".join(rng.choice("abcdefghij klmnop") for _ in range(40)) + "abcab") for i in range(60)]
    want = pairs_model(rows, 6)
    assert len(want) > 2000
    assert {tuple(r) for r in near_duplicates.near_duplicate_pairs(spark.createDataFrame(rows, "sent_id bigint, text string")).collect()} == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, 500 + i) for i in range(1, 90)]
    got = {r["id"]: r["group"] for r in groups.components(spark.createDataFrame(edges, "id_a bigint, id_b bigint")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert groups.components(spark.createDataFrame([], "id_a bigint, id_b bigint")).count() == 0


def test_cross_split(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["train", "train", "dev", "test", None]), t, "s") for i, t in enumerate(versions(7))]
    df = spark.createDataFrame(rows + rows[:9], "sentence_id int, split string, text string, source string").withColumn("id", F.lit(1)).withColumn("held", F.lit(1))
    ok = [(i, s, t) for i, s, t, _ in rows if s and t is not None and 12 <= len(C(t)) <= 300]
    want = {(i, j) for i, s, a in ok if s != "train" for j, u, b in ok if u == "train" and sim(a, b, 7)}
    found = cross_split.CrossSplit(df)
    got = {(r["id_held"], r["id_train"]) for r in found.pairs().collect()}
    assert want and got == want
    many = cross_split.CrossSplit(df, shard_chars=700)
    assert {(r["id_held"], r["id_train"]) for r in many.pairs().collect()} == want
    train = [C(t) for _, s, t in ok if s == "train"]
    for size in (12, 9):
        covered = {}
        for i, s, t in ok:
            if s != "train":
                c = C(t)
                at = {k + d for k in range(len(c) - size + 1) if any(c[k : k + size] in x for x in train) for d in range(size)}
                covered[i] = (len(at), len(c))
        assert any(0 < a < b for a, b in covered.values())
        for source in (found, many):
            assert {r["id"]: (r["covered"], r["n_chars"]) for r in source.coverage(size).collect()} == covered
    report = cross_split.report(df, found.pairs()).collect()
    assert sum(r["pairs"] for r in report) == len(want) and sum(r["overlapping"] for r in report) == len({i for i, _ in want})
    only = cross_split.report(df, found.pairs(), held=("dev",)).collect()
    assert {r["split"] for r in only} == {"dev"} and sum(r["records"] for r in only) == len({i for i, s, _, _ in rows if s == "dev"})
    assert cross_split.CrossSplit(df.filter("split = 'train'")).pairs().count() == 0
    assert cross_split.CrossSplit(df.filter("split = 'train'")).coverage().count() == 0
    assert cross_split.CrossSplit(df.filter("split <> 'train'")).pairs().count() == 0


def test_cross_split_cut_ends(spark):
    """Short records with cut ends, deletions of two characters and repeats; the first lost its last common segment but one."""
    rng = random.Random(11)
    text = "abcdefghijklmnopqrstuvw"
    rows = [(0, "dev", text), (1, "train", text[1:10] + "x" + text[10:-1])]
    for i in range(2, 700, 2):
        base = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789"[: rng.choice([3, 36])], k=rng.randint(14, 60)))
        t = list(base)
        for _ in range(rng.randint(1, 4)):
            k = rng.randrange(len(t) - 1)
            del t[k : k + 2]
        if rng.random() < 0.5:
            t = t[1:-1]
        if rng.random() < 0.5:
            t.insert(rng.randrange(len(t)), "天")
        rows += [(i, "test", base), (i + 1, "train", "".join(t))]
    ok = [r for r in rows if 12 <= len(C(r[2])) <= 300]
    want = {(i, j) for i, s, a in ok if s != "train" for j, u, b in ok if u == "train" and sim(a, b, 7)}
    df = spark.createDataFrame(rows, "sentence_id int, split string, text string")
    assert (0, 1) in want and len(want) > 50
    assert {(r["id_held"], r["id_train"]) for r in cross_split.CrossSplit(df).pairs().collect()} == want


def test_cross_split_meetings(monkeypatch):
    """Lines over few words meet often; the bitmaps leave hardly more than the pairs to be compared, and all of these."""
    np, cp = cross_split.np, cross_split.cp
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8))) for _ in range(20)]
    held = ["".join(rng.choices(words, k=8)) for _ in range(150)]
    train = ["".join(rng.choices(words, k=8)) for _ in range(250)] + [t[:20] + "天" + t[21:] for t in held[:40]]
    want = {(i, j) for i, a in enumerate(held) for j, b in enumerate(train) if sim(a, b, 7)}
    compared, exact = [], cp.shared_trigrams
    monkeypatch.setattr(cp, "shared_trigrams", lambda a, b: compared.append(len(a[1]) - 1) or exact(a, b))
    pairs = cross_split.Pairs(np.arange(len(held)), *cp.flatten(pa.array(held)), 7)
    got = {x for out in pairs.scan(np.arange(len(train)), *cp.flatten(pa.array(train))) for x in zip(out["held"].tolist(), out["train"].tolist(), strict=True)}
    assert len(want) >= 40 and got == want and sum(compared) < 2 * len(want)


def test_terms(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["a", "b", "", "c" + str(rng.randrange(60)), "天"], k=rng.randint(0, 9)))) for i in range(100)] + [(200, None), (None, "zz")]
    df = spark.createDataFrame(rows + rows[:30], "sentence_id int, text string").withColumn("term", F.lit("x")).withColumn("id", F.lit(1))
    n = {}
    for i, t in rows:
        if i is not None and t is not None:
            terms = [x for x in t.split(" ") if x]
            for x in terms:
                o, s = n.get(x, (0, set()))
                n[x] = (o + 1, s | {i})
    want = {(k, o, len(s), "rare" if len(s) <= 2 else "common" if len(s) * 100 > 500 else None) for k, (o, s) in n.items()}
    assert {tuple(r) for r in term_counts.term_counts(df).collect()} == want
    assert term_counts.term_counts(df.limit(0)).count() == 0
    ids = sorted(r["ident"] for r in term_counts.dictionary(df.select(F.col("text").alias("term")).filter("term IS NOT NULL")).collect())
    assert ids == list(range(len(ids)))


def test_layout_copies(spark):
    texts = ["Title: Alpha Beta|Place: North Hall", "place - north hall ｜ TITLE alpha beta", "title alpha beta place north hall", "Title Alpha Beta Place North Hall!", "other line of text here", None, "", "...", "abcabcabcabc", "bcabcabcabca"]
    rows = list(enumerate(texts)) + [(100 + i, "  Hot   line, number one" + "!" * (i % 9)) for i in range(200)]
    df = spark.createDataFrame(rows + rows[:5], "sent_id bigint, text string").withColumn("id", F.lit(3)).withColumn("n", F.lit(3))
    cls = {}
    for i, t in rows:
        if t is not None and len(C(t)) >= 12:
            cls.setdefault(K(t), []).append(i)
    want = {(min(v), x) for v in cls.values() for x in v if x != min(v)}
    assert {tuple(r) for r in layout_copies.layout_copies(df).collect()} == want
    every = {}
    for i, t in rows:
        if t is not None and C(t):
            every.setdefault(K(t), set()).add(i)
    assert {tuple(r) for r in layout_copies.collapsed(df).collect()} == {(min(v), len(v)) for v in every.values()}
    assert layout_copies.layout_copies(df.limit(0)).count() == 0


def test_one_form(spark):
    rng = random.Random(6)
    pool = [chr(i) for r in (range(0x20, 0x180), range(0x300, 0x345), range(0x300, 0x345), range(0x1100, 0x1113), range(0x1161, 0x1176), range(0x11A8, 0x11C3), range(0xAC00, 0xAC40), range(0x391, 0x3C0), range(0x410, 0x460), range(0x2F00, 0x2F40), range(0xF900, 0xF940), range(0xFF01, 0xFF5F), range(0x200B, 0x2010)) for i in r]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    want = [unicodedata.normalize("NFC", unicodedata.normalize("NFD", "".join(ch if 0xAC00 <= ord(ch) < 0xD7A4 else one_form._form(ord(ch)) for ch in t))) for t in texts]
    assert cp.unflatten(*one_form.canonical(*cp.flatten(pa.array(texts)))).to_pylist() == want
    again = cp.unflatten(*one_form.canonical(*cp.flatten(pa.array(want)))).to_pylist()
    assert again == want
    line = "Một dòng chữ không đổi"
    rows = [(1, line), (2, unicodedata.normalize("NFD", line)), (3, line.replace(" ", " ")), (4, line.upper()), (5, line), (6, line.replace("o", "о").replace("M", "М")), (7, line.replace(" ", "  ")), (8, None), (9, ""), (10, "".join("​" + c for c in line))]
    df = one_form.source(spark.createDataFrame(rows + rows[:3], "i int, t string"), "s", "i", "t")
    same = [1, 2, 3, 5, 6, 10]
    got = {(r["id_a"], r["id_b"]) for r in one_form.look_alike_pairs(df).collect()}
    assert got == {(a, b) for a in same for b in same if a < b and (a, b) != (1, 5)}
    assert {(r["id"], r["group"]) for r in one_form.look_alike_groups(df).collect()} == {(i, 1) for i in same}
    forms = {r["id"]: r["form"] for r in one_form.canonical_texts(df).collect()}
    assert forms[8] is None and forms[9] == "" and len({forms[i] for i in same}) == 1


def test_one_form_table():
    """The table itself, against what Unicode says of each character: widths, accents, compatibility ideographs, blanks."""
    one = lambda t: cp.unflatten(*one_form.canonical(*cp.flatten(pa.array([t])))).to_pylist()[0]
    for i in range(0xFF01, 0xFF5F):
        assert one(chr(i)) == chr(i - 0xFEE0)
    for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        if not unicodedata.decomposition(chr(i)).startswith("<"):
            assert one(chr(i)) == one(unicodedata.normalize("NFD", chr(i))) == unicodedata.normalize("NFC", chr(i))
    for i in (*range(0xF900, 0xFA6E), *range(0x2F00, 0x2FD6)):
        assert one(chr(i)) == unicodedata.normalize("NFKC", chr(i))
    assert one("a\u00a0b\u2007c\u3000d\u200be\ufe0f") == "a b c de"
    assert all(one(k) == v and len(v) == 1 and "LATIN" in unicodedata.name(v) and "LATIN" not in unicodedata.name(k) and k.isupper() <= v.isupper() for k, v in one_form.LOOK_ALIKES.items())
    assert one("Straße\tA\n") == "Straße\tA\n" and one("ªﬁ") == "ªﬁ"


def check_pieces(text, parts, limit, overlap):
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    for (a, b, s), (c, e, _) in zip(parts, parts[1:], strict=False):
        assert c == b - overlap and e > b
    assert all(b - a <= limit and text[a:b] == s for a, b, s in parts)


@pytest.mark.parametrize("size", [4800, 65536])
def test_pieces(spark, size):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abc 天。，.\n𡨸") for _ in range(n)) for n in (301, 900, 5000, 12_345)] + ["x" * 4000, "a b" * 100, "x" * 300, None, "", "w. " * 400]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows + rows[:3], "sent_id bigint, text string").withColumn("id", F.lit(9)).withColumn("start", F.lit(9))
    got = {}
    for r in pieces.split_texts(df, size=size).orderBy("id", "piece_no").collect():
        got.setdefault(r["id"], []).append((r["piece_no"], r["start"], r["stop"], r["piece"]))
    assert set(got) == {i for i, t in rows if t and len(t) > 300}
    for i, parts in got.items():
        assert [p[0] for p in parts] == list(range(1, len(parts) + 1))
        check_pieces(texts[i], [p[1:] for p in parts], 300, 30)
    sentence = "One short sentence here. " * 40
    cut = pieces.split_texts(spark.createDataFrame([(1, sentence)], "sent_id bigint, text string")).orderBy("piece_no").collect()
    assert all(p["piece"].rstrip().endswith(".") for p in cut)
    assert pieces.split_texts(df.limit(0)).count() == 0


def check_files(raw, rows, limit=300, overlap=30):
    """Pieces of a file against its bytes: offsets, texts, overlaps, nothing left out."""
    done = 0
    for k, r in enumerate(rows):
        piece = raw[r["start"] : r["stop"]].decode("utf-8", "surrogateescape")
        assert "".join("\ufffd" if 0xDC80 <= ord(c) < 0xDD00 else c for c in piece) == r["piece"] and len(r["piece"]) <= limit and r["piece_no"] == k + 1
        assert (len(raw[r["start"] : done].decode("utf-8", "surrogateescape")) == overlap) if k else r["start"] == 0
        done = r["stop"]
    assert done == len(raw)


def test_piece_files(spark, tmp_path):
    rng = random.Random(9)
    clean = "".join(rng.choice("abc 天。𡨸\n") for _ in range(30_000)).encode()
    dirty = bytearray(clean)
    for edge in (4800, 9600, 14_400):  # bytes that aren't UTF-8 around the edges of ranges and elsewhere
        for k in range(edge - 6, edge + 6):
            dirty[k] = rng.choice([0xE9, 0x80, 0xFF, 0xF0, 0x41])
    for _ in range(300):
        dirty[rng.randrange(len(dirty))] = rng.choice([0xE9, 0x80, 0xC3, 0xF0])
    files = {"clean.txt": clean, "dirty.txt": bytes(dirty), "bytes.txt": bytes(rng.choice([0x80, 0xBF]) for _ in range(12_000)), "small.txt": b"a b", "empty.txt": b""}
    (tmp_path / "sub").mkdir()
    for name, raw in files.items():
        (tmp_path / "sub" / name).write_bytes(raw)
    got = {}
    for r in pieces.split_files(spark, f"file://{tmp_path}", size=4800, suffix="*.txt").orderBy("piece_no").collect():
        got.setdefault(r["path"].rsplit("/", 1)[-1], []).append(r)
    assert set(got) == set(files) - {"empty.txt"}
    for name, rows in got.items():
        check_files(files[name], rows)


def test_leaks(spark):
    rng = random.Random(10)
    word = lambda n: "".join(rng.choice("abcdefg ") for _ in range(n))
    items = [(i, word(rng.randint(4, 90))) for i in range(30)] + [(90, None), (91, "..."), (92, "ab")]
    docs = []
    for d in range(120):
        i, t = rng.choice(items[:30])
        k = rng.randrange(len(t))
        docs.append((d, word(50) + t[k : k + rng.randint(1, len(t))].upper() + "; " + word(40)))
    docs += [(500, None), (501, ""), (502, items[0][1])]
    want = set()
    for d, t in docs:
        for i, x in items:
            if t is not None and x and C(x):
                c, n = C(x), (len(C(x)) + 1) // 2
                if any(c[k : k + n] in C(t) for k in range(len(c) - n + 1)):
                    want.add((d, i))
    a = spark.createDataFrame(docs + docs[:9], "doc_id bigint, text string").withColumn("id", F.lit(1)).withColumn("item_id", F.lit(1))
    b = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(2))
    found = lambda **k: {(r["doc_id"], r["item_id"]) for r in leaks.leaks(a, b, **k).collect()}
    assert want and found() == want
    assert found(block_chars=300) == want
    near = found(edits=1)
    assert want <= near
    assert leaks.leaks(a, b.limit(0)).count() == 0 and leaks.leaks(a.limit(0), b).count() == 0


def test_leaks_with_edits(spark):
    passage = "thequickbrownfoxjumpsoverthelazydogandrunsaway"
    edited = passage[:8] + "x" + passage[9:18] + passage[19:]
    a = spark.createDataFrame([(1, "zz" + edited[:30]), (2, "zz" + passage[:12])], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    assert leaks.leaks(a, b).count() == 0
    assert [r["doc_id"] for r in leaks.leaks(a, b, edits=2).collect()] == [1]


def test_mixture(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice(["big"] * 8 + ["mid", "mid", "small"]), "word " * rng.randint(1, 30)) for i in range(600)] + [(900, None, "x"), (901, "big", None), (902, "none", "x")]
    targets = [("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.1, 4), ("absent", 0.1, 2)]
    docs = spark.createDataFrame(rows + rows[:20], "doc_id bigint, source string, text string").withColumn("tokens", F.lit(1)).withColumn("key", F.lit(1))
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    mix = mixture.Mixture(docs, t, rows_per_range=50)
    report = {r["source"]: r for r in mix.report().collect()}
    uses = mix.uses().collect()
    total = sum(r["use_tokens"] for r in uses)
    present = 0.9
    for s, share, cap in targets[:3]:
        own = [r for r in uses if r["source"] == s]
        assert abs(sum(r["use_tokens"] for r in own) / total - share / present) < 0.002
        assert max(r["epoch"] for r in own) <= cap and len({(r["doc_id"], r["epoch"]) for r in own}) == len(own)
        assert sum(r["use_tokens"] < r["tokens"] for r in own) <= 1
        assert report[s]["used_tokens"] == sum(r["use_tokens"] for r in own) and report[s]["most_uses"] <= cap
    assert report["absent"]["used_tokens"] == 0
    assert {tuple(r) for r in mixture.Mixture(docs, t, rows_per_range=50).uses().collect()} == {tuple(r) for r in uses}
    fixed = mixture.Mixture(docs, t, total=1000, rows_per_range=50)
    assert {r["source"]: r["used_tokens"] for r in fixed.report().collect()}["big"] == 500
    assert mixture.Mixture(docs.limit(0), t).uses().count() == 0


NOTES = [
    ("Transcribed by Sorris E. Thornmere, write to halrin1961(at)example.org.", {("name", "sorrisethornmere"), ("email", "halrin1961atexampleorg")}),
    ("Reader card: TAMICA COBBGROVE; tel. (206) 555-0193; mail a.b+c@readers.invalid", {("name", "tamicacobbgrove"), ("phone", "2065550193"), ("email", "abcreadersinvalid")}),
    ("藏家住桐沙鎮柳渚巷107弄9號，可致電024 0670 6723。", {("address", "桐沙鎮柳渚巷107弄9號"), ("phone", "02406706723")}),
    ("身分證003568851184279261，尉澹舟具名。", {("id_number", "003568851184279261"), ("name", "尉澹舟")}),
    ("Liên hệ ông Lục Văn Uyển Thư, điện thoại +84 24 0495 1008.", {("name", "lụcvănuyểnthư"), ("phone", "842404951008")}),
    ("Leihgeber wohnt Weidenhofstr. 63, 00784 Neuenlinden, Ausweis-Nr. LQJ58E429.", {("address", "weidenhofstr6300784neuenlinden"), ("id_number", "lqj58e429")}),
    ("À renvoyer : 93 bis, allée du Vieux Moulin, Saint-Autrelle, merci à Lhauttrenne, Thibarot.", {("address", "93bisalléeduvieuxmoulinsaintautrelle"), ("name", "lhauttrennethibarot")}),
    ("Hervain Delatrenne / 941130019150935 / 01 99 00 10 99", {("name", "hervaindelatrenne"), ("id_number", "941130019150935"), ("phone", "0199001099")}),
    ("Cảm ơn chị Khuất Khuê Chi đã đọc lại bản này.", {("name", "khuấtkhuêchi")}),
    ("Wynica Pellmere; 109b Heronpan Row, Eastmouth ZZ2 4QQ; vesory2005@example.net", {("name", "wynicapellmere"), ("address", "109bheronpanroweastmouthzz24qq"), ("email", "vesory2005examplenet")}),
    ("fan Neiflör womir Grüriet der Gaugrie Pfostieklol; Rowon bei 17 Pfereisu.", set()),
    ("架號HV8157-335，葉56至74。Stand 47.67.1847, Los 1505-801. See the tag @traithis. ISBN 000-0-1232-373-0.", set()),
    ("The Silver Gate Reading Room keeps 5533 leaves.", set()),
]


def test_personal_details(spark):
    rows = [(i, t) for i, (t, _) in enumerate(NOTES * 3)] + [(900, None), (901, ""), (902, "plain text, nothing here " * 2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kind", F.lit("x")).withColumn("votes", F.lit(1))
    got = {}
    for r in personal_details.details(df).collect():
        got.setdefault(r["doc_id"], set()).add((r["kind"], r["found"]))
    for i, (_, want) in enumerate(NOTES * 3):
        assert got.get(i, set()) == want, NOTES[i % len(NOTES)][0]
    red = {r["doc_id"]: r["redacted"] for r in personal_details.redacted(df).collect()}
    assert red[0] == "Transcribed by [NAME], write to [EMAIL]." and red[11] == NOTES[11][0] and red[900] is None and red[901] == "" and red[902] == rows[-1][1]
    assert personal_details.details(df.limit(0)).count() == 0


# Notes whose wording isn't in the operator's lists of phrases.
PROBES = [
    ("My name is John Smith and I was here.", {("name", "johnsmith")}),
    ("Please ring Mary Jones on Monday.", {("name", "maryjones")}),
    ("Author: Anna Keller", {("name", "annakeller")}),
    ("Ask for Peter Brown at the desk.", {("name", "peterbrown")}),
    ("Best regards, Alice Cooper", {("name", "alicecooper")}),
    ("Mein Name ist Hans Müller, guten Tag.", {("name", "hansmüller")}),
    ("我叫王小明，你好。", {("name", "王小明")}),
    ("Name: Nguyễn Văn An", {("name", "nguyễnvănan")}),
    ("He lived at 1600 Pennsylvania Ave NW, Washington, DC 20500 for years.", {("address", "1600pennsylvaniaavenwwashingtondc20500")}),
    ("Wir sahen Grüne Felder und der Kleine Teich lag still.", set()),
    ("In May the Upper Valley had 12345678 visitors and 12 Golden Fields.", set()),
    ("See the tag @heron and part 4711-0815-99.", set()),
]


def test_personal_details_in_other_words(spark):
    rows = [(i, t) for i, (t, _) in enumerate(PROBES)] + [(100 + i, t) for i, (t, _) in enumerate(NOTES * 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {}
    for r in personal_details.details(df).collect():
        got.setdefault(r["doc_id"], set()).add((r["kind"], r["found"]))
    for i, (t, want) in enumerate(PROBES):
        assert got.get(i, set()) == want, t
    report = {r["kind"]: r for r in personal_details.report(df).collect()}
    assert all(r["candidates"] == r["accepted"] + r["rejected"] for r in report.values())
    assert report["name"]["rejected"] > 0 and report["phone"]["rejected"] > 0 and all(r["held_out_agreement"] > 0.8 for r in report.values())
    assert personal_details.report(df.limit(0)).count() == 0


def test_em_prefers_agreeing_labelers():
    q = personal_details.estimate([(0, 1 | 1 << 2 | 1 << 4, 900), (0, 1 | 1 << 2, 80), (0, 2 | 2 << 6, 60), (0, 2, 20)])
    assert q[0, 1 | 1 << 2 | 1 << 4] > 0.9 and q[0, 2 | 2 << 6] < 0.5
