"""Readers of annotated corpora.

Files are read line by line, large ones in splits; none is held as one string, but for ``text_dir`` and ``reviews``, whose rows are
whole documents. The order within a file is that of splits and of lines within a split; numbers of lines and sentences are prefix
sums over the whole table, so that no task holds a file.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.operators import sequences as seq
from quillmill.operators import text as tx
from quillmill.operators.ranking import global_rank
from quillmill.session import cut, partitions
from quillmill.sources.registry import parse_layout, register

DOCSTART = "-DOCSTART-"


def _decode(errors: str):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(b: bytes) -> str:
            try:
                return bytes(b).decode("utf-8", "strict")
            except UnicodeDecodeError:
                return bytes(b).decode("latin-1") if errors == "latin-1" else bytes(b).decode("utf-8", "ignore")

        return s.map(one, na_action="ignore")

    return run


@register("text_dir")
def text_dir(spark: SparkSession, path: str, errors: str = "ignore") -> DataFrame:
    """(path, text) of all ``*.txt`` below a folder; bytes that aren't UTF-8 are dropped, or the file is Latin-1 (``errors='latin-1'``)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").option("ignoreCorruptFiles", True).load(path)
    return raw.select("path", _decode(errors)("content").alias("text"))


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, at, value): the lines of all files, and what orders them within a file."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")).alias("at")
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), at, F.regexp_replace("value", "\r$", "").alias("value"))


def _numbered(rows: DataFrame) -> DataFrame:
    """(path, line, value): ``line`` counts from 0 within a file."""
    ranked = global_rank(rows, F.col("path"), F.col("at"), name="__r")
    first = ranked.groupBy("path").agg(F.min("__r").alias("__a"))
    return ranked.join(first, "path").select("path", (F.col("__r") - F.col("__a")).cast("int").alias("line"), "value")


def _sentences(rows: DataFrame) -> DataFrame:
    """(path, at, value, sent): the lines that aren't blank; ``sent`` counts from 0 within a file and rises after blank lines.

    Lines are range-partitioned by file and place, and a sentence is counted at its first line. Where a range goes on with a sentence
    of the one before, it takes one off. A row for each file of a range is sent to the tasks, none for each sentence.
    """
    spark = rows.sparkSession
    wide = rows.select("path", "at", "value", (~F.col("value").rlike(r"(?U)\S")).alias("__b"))
    placed = cut(wide.repartitionByRange(partitions(spark), "path", "at").withColumn("__range", F.spark_partition_id()), "lines")
    w = Window.partitionBy("__range", "path").orderBy("at")
    counted = placed.withColumn("__f", (~F.col("__b") & F.coalesce(F.lag("__b").over(w), F.lit(True))).cast("long"))
    parts = counted.groupBy("__range", "path").agg(F.sum("__f").alias("__n"), F.min_by("__b", "at").alias("__first"), F.max_by("__b", "at").alias("__end"))
    o = Window.partitionBy("path").orderBy("__range")
    goes_on = (~F.col("__first") & ~F.coalesce(F.lag("__end").over(o), F.lit(True))).cast("long")
    before = F.coalesce(F.sum("__n").over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum("__on").over(o.rowsBetween(Window.unboundedPreceding, 0)) - 1
    base = parts.withColumn("__on", goes_on).select("__range", "path", before.alias("__base"))
    total = F.col("__base") + F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return counted.join(F.broadcast(base), ["__range", "path"]).withColumn("sent", total.cast("int")).filter(~F.col("__b")).select("path", "at", "value", "sent")


def _tokens_of(rows: DataFrame) -> DataFrame:
    """Adds ``idx`` from 1 within a sentence."""
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("path", "sent").orderBy("at")))


@register("lines")
def line_sentences(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """(path, line, text): a sentence per line, stripped, blank ones dropped; the first ``limit`` by path and line."""
    rows = _numbered(_lines(spark, path)).select("path", "line", tx.strip(F.col("value")).alias("text")).filter("text <> ''")
    return rows.orderBy("path", "line").limit(limit) if limit else rows


@register("reviews")
def reviews(spark: SparkSession, path: str) -> DataFrame:
    """(split, labels, text) of a folder ``<split>/<label>/*.txt`` with one document per file."""
    parts = F.split("path", "/")
    return text_dir(spark, path).select(F.element_at(parts, -3).alias("split"), F.array(F.element_at(parts, -2)).alias("labels"), tx.collapse_blanks(F.col("text")).alias("text"))


@register("intensity")
def intensity(spark: SparkSession, path: str) -> DataFrame:
    """(labels, text) of lines ``id, text, name, value`` parted by tabs under a header: the value is the label."""
    c = F.split("value", "\t")
    rows = _numbered(_lines(spark, path)).filter("line > 0").filter(F.size(c) >= 4)
    return rows.select(F.array(tx.strip(c[3])).alias("labels"), c[1].alias("text"))


@register("language_model")
def language_model(spark: SparkSession, path: str, seed: str = "1", flip: float = 0.01) -> DataFrame:
    """(split, line, text) of ``train/*``, ``valid.txt`` and ``test.txt``: training lines in random but repeatable order, a share ``flip`` of them in lower and as many in upper case."""
    rows = _numbered(_lines(spark, [path + "/train/*", path + "/*.txt"]))
    name = F.substring_index("path", "/", -1)
    split = F.when(F.element_at(F.split("path", "/"), -2) == "train", "train").when(name.startswith("valid"), "dev").when(name.startswith("test"), "test")
    rows = rows.select(split.alias("split"), "path", "line", "value").filter("split IS NOT NULL")
    h = F.md5(F.concat_ws(":", F.lit(seed), "path", "line"))
    u = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / (1 << 32)
    text = F.when((F.col("split") == "train") & (u < flip), F.lower("value")).when((F.col("split") == "train") & (u >= 1 - flip), F.upper("value")).otherwise(F.col("value"))
    order = F.when(F.col("split") == "train", F.substring(h, 9, 8)).otherwise("")
    return global_rank(rows.select("split", "path", "line", text.alias("text"), order.alias("__o")), F.col("split"), F.col("__o"), F.col("path"), F.col("line")).select("split", F.col("rank").alias("line"), "text")


@register("columns")
def columns(spark: SparkSession, path: str, layout: str = "0:text,1:punct", comment: str | None = None, keep_docstart: bool = False, ragged: str = "null") -> DataFrame:
    """(path, sent, idx, field...) of files with a token per line and blank lines between sentences.

    A row with too few columns: ``null`` leaves the field null, ``empty`` gives an empty string, ``drop`` drops the row.
    """
    fields = parse_layout(layout)
    rows = _lines(spark, path)
    if comment:
        rows = rows.filter(~F.col("value").startswith(comment))
    if not keep_docstart:
        rows = rows.withColumn("value", F.when(F.col("value").startswith(DOCSTART), "").otherwise(F.col("value")))
    rows = _sentences(rows)
    parts = F.split(tx.strip(F.col("value")), r"(?U)\s+")
    rows = rows.withColumn("__c", parts)
    if ragged == "drop":
        rows = rows.filter(F.size("__c") > max(fields))
    cell = lambda i: F.get(F.col("__c"), i)
    return _tokens_of(rows).select("path", "sent", "idx", *[(F.coalesce(cell(i), F.lit("")) if ragged == "empty" else cell(i)).alias(name) for i, name in fields.items()])


@register("conllu")
def conllu(spark: SparkSession, path: str) -> DataFrame:
    """(path, sent, idx, form, lemma, upos, xpos, feats, head, deprel, deps, misc); comments, ranges and empty nodes are dropped. feats is a map.

    A row of two cells is number and form, one of three number, form and tag (upos); of other rows all cells that are there count. A
    row of one cell is a form by itself, numbered by its place.
    """
    rows = _sentences(_lines(spark, path).filter(~F.col("value").startswith("#"))).withColumn("c", F.split("value", "\t+"))
    rows = _tokens_of(rows.filter(~((F.size("c") > 1) & F.col("c")[0].rlike("^[0-9]+[.-][0-9]+$"))))
    g = lambda i: F.get(F.col("c"), i)
    n = F.size("c")
    full = lambda i: F.when(n >= 4, g(i))
    form = F.when(n == 1, g(0)).otherwise(g(1))
    return rows.select("path", "sent", F.coalesce(F.when(n > 1, g(0).try_cast("int")), "idx").alias("idx"), form.alias("form"), full(2).alias("lemma"), F.when(n == 3, g(2)).otherwise(full(3)).alias("upos"), full(4).alias("xpos"), tx.key_values(full(5)).alias("feats"), full(6).try_cast("int").alias("head"), full(7).alias("deprel"), full(8).alias("deps"), full(9).alias("misc"))


def with_root(tokens: DataFrame) -> DataFrame:
    """A root token 0 before each sentence of ``conllu``."""
    none = F.lit("_")
    root = tokens.select("path", "sent").distinct().select("path", "sent", F.lit(0).alias("idx"), F.lit("<ROOT>").alias("form"), none.alias("lemma"), none.alias("upos"), none.alias("xpos"), F.map_from_arrays(F.array(), F.array()).cast("map<string,string>").alias("feats"), F.lit(0).alias("head"), F.lit("root").alias("deprel"), F.lit("0:root").alias("deps"), none.alias("misc"))
    return root.unionByName(tokens)


def labelled(c: Column, mark: str = "__label__") -> Column:
    """``__label__a __label__b text`` as (labels, text): only the labels that lead count; null without label or text."""
    lead = F.regexp_extract(c, rf"^((?:{mark}\S+\s+)+)", 1)
    labels = F.transform(F.regexp_extract_all(lead, F.lit(rf"{mark}(\S+)"), F.lit(1)), lambda x: x)
    body = tx.strip(F.substring(c, F.length(lead) + 1, F.lit(1 << 30)))
    return F.when((lead != "") & (body != ""), F.struct(labels.alias("labels"), body.alias("text")))


@register("labelled")
def labelled_lines(spark: SparkSession, path: str, max_tokens: int = -1, max_chars: int = -1) -> DataFrame:
    """(path, line, labels, text)."""
    rows = _numbered(_lines(spark, path)).withColumn("x", labelled(F.col("value"))).filter("x IS NOT NULL").select("path", "line", "x.labels", "x.text")
    if max_chars > 0:
        rows = rows.withColumn("text", F.substring("text", 1, max_chars))
    return rows.withColumn("text", tx.first_words(F.col("text"), max_tokens)) if max_tokens > 0 else rows


@register("csv_classes")
def csv_classes(spark: SparkSession, path: str, text_cols: list[str], label_cols: list[str], **options) -> DataFrame:
    """(labels, text) of a CSV with a header: text columns joined by a blank, labels that are there; unlabelled rows are dropped."""
    raw = spark.read.options(header=True, **options).csv(path)
    labels = F.filter(F.array(*label_cols), lambda x: x.isNotNull() & (x != ""))
    return raw.select(labels.alias("labels"), F.concat_ws(" ", *text_cols).alias("text")).filter("size(labels) > 0")


@register("parquet_tokens")
def parquet_tokens(spark: SparkSession, path: str, text: str = "text", tags: tuple[str, ...] = ()) -> DataFrame:
    """(sentence_id, tokens array of structs) of a Parquet table with a row per token in file order."""
    raw = spark.read.parquet(path)
    if "sentence_id" not in raw.columns:
        raise ValueError("the table needs a sentence_id")
    rows = raw.select("sentence_id", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (text, *tags)])
    return rows.groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct("f", "i", text, *tags))).alias("x")).select("sentence_id", F.transform("x", lambda t: F.struct(*[t[c].alias(c) for c in (text, *tags)])).alias("tokens"))


@register("json_examples")
def json_examples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_key string, sentences array<array<string>>, ners array<array<array<string>>>, lemmas array<array<string>>").json(path)


@register("embeddings")
def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) of lines ``word v1 ... vn``; a header of two whole numbers at the start of a file is dropped."""
    c = F.split(F.rtrim(F.col("value")), " ")
    header = F.col("value").rlike("^[0-9]+ [0-9]+ *$") & (F.col("_metadata.file_block_start") == 0)
    rows = spark.read.text(path).filter(~header & (F.size(c) > 1))
    return rows.select(c[0].alias("word"), F.slice(c, 2, 1 << 30).cast("array<float>").alias("vec"))


@register("tsv_log")
def tsv_log(spark: SparkSession, path: str) -> DataFrame:
    """A log with a header, ``_`` for null."""
    return spark.read.options(sep="\t", header=True, nullValue="_").csv(path)


@register("wiki_ner")
def wiki_ner(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, idx, text, pos, ner) of lines ``w|pos|ner w|pos|ner``."""
    rows = _numbered(_lines(spark, path)).select("path", "line", F.posexplode(seq.words(F.col("value"))).alias("p", "w"))
    c = F.split("w", r"\|")
    return rows.filter(F.size(c) == 3).select("path", "line", (F.col("p") + 1).alias("idx"), c[0].alias("text"), c[1].alias("pos"), c[2].alias("ner"))


def retrieval_pairs(spark: SparkSession, path: str, words: int = 200) -> DataFrame:
    """(cand, ref, wrong) of a TSV; a line of one field is wrong; candidates are cut to so many words."""
    c = F.split("value", "\t")
    return spark.read.text(path).filter("value <> ''").select(tx.first_words(c[0], words).alias("cand"), F.get(c, 1).alias("ref"), (F.size(c) < 2).alias("wrong"))


def split_of(path: Column) -> Column:
    """train, dev or test by the file name; testa is dev and testb test."""
    name = F.lower(F.substring_index(path, "/", -1))
    return F.when(name.rlike(r"\.(gz|swp|pkl)$"), None).when(name.contains("train"), "train").when(name.contains("dev") | name.contains("testa"), "dev").when(name.contains("test"), "test")
