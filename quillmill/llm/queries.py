"""Queries of the training-data operators, over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import cross_split, layout_copies, leaks, mixture, near_duplicates, one_form, personal_details, pieces, term_counts
from quillmill.session import folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a training and a dev or test sentence."""
    pairs = cross_split.CrossSplit(table(spark, sf_dir, "column_corpus")).pairs()
    return pairs.select(F.least("id_held", "id_train").alias("id_a"), F.greatest("id_held", "id_train").alias("id_b")).distinct()


_CORE = "regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}]', '', 'g')"
_GRAMS = "list_distinct(list_transform(range(1, length(c) - 1), lambda i: substr(c, i, 3)))"
_P1 = f"""
WITH r AS (SELECT DISTINCT CAST(sentence_id AS BIGINT) AS id, split, {_CORE} AS c FROM column_corpus WHERE text IS NOT NULL AND split IN ('train', 'dev', 'test')),
k AS (SELECT *, {_GRAMS} AS g FROM r WHERE length(c) BETWEEN 12 AND 300), e AS (SELECT id, split, len(g) AS n, unnest(g) AS p FROM k),
m AS (SELECT a.id AS held, b.id AS train, min(a.n) AS na, min(b.n) AS nb, count(*) AS s FROM e a JOIN e b ON a.p = b.p WHERE a.split <> 'train' AND b.split = 'train' GROUP BY a.id, b.id),
pairs AS (SELECT held, train FROM m WHERE 10 * s >= 7 * (na + nb - s))
"""
SQL["p1_found"] = _P1 + "SELECT least(held, train) AS id_a, greatest(held, train) AS id_b FROM pairs"


@query
def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation split and source."""
    df = table(spark, sf_dir, "column_corpus")
    return cross_split.report(df, cross_split.CrossSplit(df).pairs())


SQL["p1_report"] = _P1 + """, h AS (SELECT held AS id, count(*) AS n FROM pairs GROUP BY held), s AS (SELECT CAST(sentence_id AS BIGINT) AS id, min(split) AS split, min(source) AS source FROM column_corpus WHERE split IN ('dev', 'test') GROUP BY sentence_id)
SELECT split, source, count(*) AS records, count(n) AS overlapping, CAST(coalesce(sum(n), 0) AS BIGINT) AS pairs FROM s LEFT JOIN h USING (id) GROUP BY split, source"""


@query
def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each evaluation sentence the training split covers."""
    return cross_split.CrossSplit(table(spark, sf_dir, "column_corpus")).coverage()


SQL["p1_coverage"] = _P1 + """, w AS (SELECT DISTINCT unnest(list_transform(range(1, length(c) - 10), lambda i: substr(c, i, 12))) AS w FROM k WHERE split = 'train'),
h AS (SELECT id, unnest(range(1, length(c) - 10)) AS i, unnest(list_transform(range(1, length(c) - 10), lambda i: substr(c, i, 12))) AS w FROM k WHERE split <> 'train'),
x AS (SELECT DISTINCT id, unnest(range(i, i + 12)) AS at FROM h JOIN w USING (w)), n AS (SELECT id, count(*) AS covered FROM x GROUP BY id)
SELECT id, length(c) AS n_chars, coalesce(covered, 0) AS covered FROM k LEFT JOIN n USING (id) WHERE split <> 'train'"""


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms too rare or too common to be useful."""
    return term_counts.term_counts(table(spark, sf_dir, "column_corpus")).filter("mark IS NOT NULL").select("term", "mark")


_TERMS = """
WITH s AS (SELECT DISTINCT sentence_id, text FROM column_corpus WHERE text IS NOT NULL),
t AS (SELECT sentence_id, unnest(string_split(text, ' ')) AS term FROM s),
c AS (SELECT term, count(*) AS occurrences, count(DISTINCT sentence_id) AS records FROM t WHERE term <> '' GROUP BY term),
m AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records * 100 > 5 * (SELECT count(*) FROM s) THEN 'common' END AS mark FROM c)
"""
SQL["p2_found"] = _TERMS + "SELECT term, mark FROM m WHERE mark IS NOT NULL"


@query
def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms with their counts."""
    return term_counts.term_counts(table(spark, sf_dir, "column_corpus"))


SQL["p2_terms"] = _TERMS + "SELECT term, occurrences, records, mark FROM m"


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of versions among the sentences."""
    return near_duplicates.near_duplicate_pairs(table(spark, sf_dir, "sentences"), tenths=6)


_C = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g')"
_K = f"""CASE WHEN contains(text, '|') OR contains(text, '｜')
  THEN list_sort(list_filter(list_transform(string_split_regex(text, '[|｜]'), lambda f: {_C.format("f")}), lambda f: f <> '')) || ['|']
  ELSE [{_C.format("text")}] END"""


SQL["p3_found"] = f"""
WITH r AS (SELECT DISTINCT sent_id AS id, {_CORE} AS c, {_K} AS key FROM sentences WHERE text IS NOT NULL), k AS (SELECT *, {_GRAMS} AS g FROM r WHERE length(c) BETWEEN 12 AND 300), e AS (SELECT id, len(g) AS n, unnest(g) AS p FROM k),
m AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS s FROM e a JOIN e b ON a.p = b.p AND a.id < b.id WHERE 10 * least(a.n, b.n) >= 6 * greatest(a.n, b.n) GROUP BY a.id, b.id)
SELECT id_a, id_b FROM m JOIN k a ON a.id = id_a JOIN k b ON b.id = id_b WHERE 10 * s >= 6 * (len(a.g) + len(b.g) - s) AND a.key <> b.key"""


@query
def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence with its group of versions."""
    return near_duplicates.version_groups(table(spark, sf_dir, "sentences"))


SQL["p3_groups"] = f"""
WITH RECURSIVE r AS (SELECT DISTINCT sent_id AS id, {_CORE} AS c, {_K} AS key FROM sentences WHERE text IS NOT NULL), k AS (SELECT *, {_GRAMS} AS g, min(id) OVER (PARTITION BY c, key) AS rid FROM r WHERE length(c) BETWEEN 12 AND 300),
e AS (SELECT id, len(g) AS n, unnest(g) AS p FROM k WHERE id = rid),
m AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS s FROM e a JOIN e b ON a.p = b.p AND a.id <> b.id WHERE 10 * least(a.n, b.n) >= 6 * greatest(a.n, b.n) GROUP BY a.id, b.id),
l AS (SELECT id_a, id_b FROM m JOIN k a ON a.id = id_a JOIN k b ON b.id = id_b WHERE 10 * s >= 6 * (len(a.g) + len(b.g) - s) AND a.key <> b.key),
reach AS (SELECT id_a AS id, id_b AS other FROM l UNION SELECT reach.id, l.id_b FROM reach JOIN l ON l.id_a = reach.other), top AS (SELECT id, least(id, min(other)) AS "group" FROM reach GROUP BY id), n AS (SELECT id_a AS id, count(*) AS links FROM l GROUP BY id_a)
SELECT s.sent_id AS id, coalesce(top."group", k.rid, s.sent_id) AS "group", coalesce(n.links, 0) AS links FROM (SELECT DISTINCT sent_id FROM sentences WHERE sent_id IS NOT NULL) s LEFT JOIN k ON k.id = s.sent_id LEFT JOIN top ON top.id = k.rid LEFT JOIN n ON n.id = k.rid"""


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that are another one laid out differently."""
    return layout_copies.layout_copies(table(spark, sf_dir, "sentences"))


SQL["p4_found"] = f"""
WITH s AS (SELECT DISTINCT sent_id, {_K} AS k FROM sentences WHERE length({_C.format("text")}) >= 12),
g AS (SELECT k, min(sent_id) AS keep_id FROM s GROUP BY k)
SELECT keep_id, sent_id AS copy_id FROM s JOIN g USING (k) WHERE sent_id <> keep_id"""


@query
def p4_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence per distinct content, with the number of its copies."""
    return layout_copies.collapsed(table(spark, sf_dir, "sentences"))


SQL["p4_collapsed"] = f"""
WITH s AS (SELECT DISTINCT sent_id, {_K} AS k FROM sentences WHERE length({_C.format("text")}) >= 1)
SELECT min(sent_id) AS keep_id, count(*) AS copies FROM s GROUP BY k"""


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_form.source(table(spark, sf_dir, "sentences"), "sentences", "sent_id", "text").unionByName(one_form.source(table(spark, sf_dir, "column_corpus"), "column_corpus", "sentence_id", "text"))


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that look the same and are stored with other characters."""
    return one_form.look_alike_pairs(_both(spark, sf_dir))


def _form_sql() -> str:
    """The one form by single characters: what Unicode calls wide, narrow or a form of one ideograph, blanks, invisible characters, look-alikes."""
    import unicodedata

    to, gone = {}, []
    for i in (*range(0x80, 0xD800), *range(0xF900, 0x10000)):
        ch, parts = chr(i), unicodedata.decomposition(chr(i)).split()
        if unicodedata.category(ch) == "Zs":
            to[ch] = " "
        elif unicodedata.category(ch) == "Cf" or 0xFE00 <= i < 0xFE10:
            gone.append(ch)
        elif parts[:1] in (["<wide>"], ["<narrow>"]) or parts[:1] == ["<compat>"] and len(parts) == 2 and "CJK UNIFIED" in unicodedata.name(chr(int(parts[1], 16)), ""):
            to[ch] = chr(int(parts[1], 16))
    to |= one_form.LOOK_ALIKES
    quoted = lambda x: "'" + "".join(x).replace("'", "''") + "'"
    return f"nfc_normalize(translate(nfc_normalize(text), {quoted([*to, *gone])}, {quoted(to.values())}))"



SQL["p5_found"] = f"""
WITH t AS (SELECT 'sentences' AS tbl, sent_id AS id, text FROM sentences UNION SELECT 'column_corpus', CAST(sentence_id AS BIGINT), text FROM column_corpus),
f AS (SELECT tbl, id, text, {_form_sql()} AS form FROM t WHERE length({_CORE}) >= 12)
SELECT DISTINCT a.tbl, a.id AS id_a, b.id AS id_b FROM f a JOIN f b ON a.tbl = b.tbl AND a.form = b.form AND a.id < b.id AND a.text <> b.text"""


@query
def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of a class of look-alikes, with the smallest id of the class."""
    return one_form.look_alike_groups(_both(spark, sf_dir))


@query
def p5_one_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of both tables in the one form."""
    return one_form.canonical_texts(_both(spark, sf_dir))


_FORMS = f"""
WITH t AS (SELECT 'sentences' AS tbl, sent_id AS id, text FROM sentences UNION ALL SELECT 'column_corpus', CAST(sentence_id AS BIGINT), text FROM column_corpus), a AS (SELECT tbl, id, text, {_form_sql()} AS form FROM t)
"""
SQL["p5_one_form"] = _FORMS + "SELECT tbl, id, form FROM a"
SQL["p5_groups"] = _FORMS + f""", f AS (SELECT DISTINCT tbl, id, text, form FROM a WHERE length({_CORE}) >= 12), g AS (SELECT tbl, form, min(id) AS "group" FROM f GROUP BY tbl, form HAVING count(DISTINCT text) > 1)
SELECT DISTINCT tbl, id, "group" FROM f JOIN g USING (tbl, form)"""


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that are cut."""
    return pieces.split_texts(table(spark, sf_dir, "sentences")).select(F.col("id").alias("sent_id")).distinct()


SQL["p6_found"] = "SELECT DISTINCT sent_id FROM sentences WHERE length(text) > 300"


@query
def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all long sentences."""
    return pieces.split_texts(table(spark, sf_dir, "sentences")).withColumnRenamed("id", "sent_id")


@query
def p6_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts put together again from their pieces, as md5."""
    own = F.array_sort(F.collect_list(F.struct("piece_no", pieces.own_part().alias("t"))))
    rows = pieces.split_texts(table(spark, sf_dir, "sentences")).groupBy(F.col("id").alias("sent_id")).agg(own.alias("x"), F.count("*").alias("n"), F.max("piece_no").alias("last"), F.max(F.length("piece")).alias("longest"))
    return rows.select("sent_id", F.md5(F.array_join("x.t", "")).alias("text"), (F.col("n") == F.col("last")).alias("numbered"), (F.col("longest") <= 300).alias("bounded"))


SQL["p6_rejoined"] = "SELECT sent_id, md5(min(text)) AS text, true AS numbered, true AS bounded FROM sentences WHERE length(text) > 300 GROUP BY sent_id"


@query
def p6_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each character stands in the pieces of files that hold all documents, without what pieces repeat."""
    path = folder(spark, "document-files")
    table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("text").write.text(path)
    parts = pieces.split_files(spark, path, suffix="*.txt", size=1 << 20)
    return parts.select(F.explode(F.split(pieces.own_part(), "")).alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))


SQL["p6_files"] = "SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text || chr(10), '')) AS ch FROM documents WHERE text IS NOT NULL) WHERE ch <> '' GROUP BY ch"


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a held-out passage in one run."""
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


SQL["p7_found"] = f"""
WITH i AS (SELECT item_id, {_CORE} AS c FROM eval_items WHERE text IS NOT NULL), n AS (SELECT *, (length(c) + 1) // 2 AS n FROM i WHERE c <> ''),
w AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, length(c) - n + 2), lambda j: substr(c, j, n))) AS w FROM n), d AS (SELECT doc_id, {_CORE} AS c FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT doc_id, item_id FROM d JOIN w ON contains(d.c, w.w)"""


@query
def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with up to two edits in the stretch."""
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), edits=2)


@query
def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each use of a document in the mixture."""
    return mixture.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets")).uses()


@query
def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares wanted and reached."""
    return mixture.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets")).report()


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal details of each document."""
    return personal_details.details(table(spark, sf_dir, "documents")).select("doc_id", "kind", "found").distinct()


@query
def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with placeholders for personal details."""
    return personal_details.redacted(table(spark, sf_dir, "documents"))


@query
def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each kind, how many were rejected, and how well held-out documents are foretold."""
    return personal_details.report(table(spark, sf_dir, "documents"))
