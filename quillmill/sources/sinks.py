"""Writers. Each writes a folder in parallel; ``one_file`` keeps the order of the key in a single file where a tool needs that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.operators.ranking import running_total
from quillmill.operators.text import BLANKS


def _write(df: DataFrame, path: str, order: list[str], one_file: bool, sep: str = "\n") -> None:
    rows = df.repartition(1) if one_file else df
    rows.sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path, lineSep=sep)


def blocks(tokens: DataFrame, keys: list[str], cols: list[str], sep: str = "\t", doc_mark: bool = False, most: str | None = None) -> DataFrame:
    """(keys, value[, most]): a sentence as lines of columns in the order of idx. Blanks within a cell, which would part it, become ``_``, and so do cells without a value. ``most`` is a column of which the sentence's greatest value is kept."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("_")), BLANKS, "_")
    line = F.concat_ws(sep, *map(cell, cols))
    kept = [most] if most else []
    rows = tokens.select(*keys, *kept, F.struct("idx", line.alias("l")).alias("x")).groupBy(*keys).agg(*[F.max(c).alias(c) for c in kept], F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "\n").alias("value"))
    return rows.withColumn("value", F.concat(F.lit("-DOCSTART-\n\n"), "value")) if doc_mark else rows


def write_conll(tokens: DataFrame, path: str, keys: list[str], cols: list[str], sep: str = "\t", doc_mark: bool = False, one_file: bool = False) -> None:
    """Sentences with a blank line after each."""
    _write(blocks(tokens, keys, cols, sep, doc_mark), path, keys, one_file, "\n\n")


def write_conllu(tokens: DataFrame, path: str, keys: list[str], score: str | None = None, one_file: bool = False) -> None:
    """CoNLL-U with ten columns (idx, form, lemma, upos, xpos, feats, head, deprel, deps, misc; those the table lacks are ``_``), under ``# Tree score`` where a column gives one."""
    cols = ("form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")
    rows = tokens.select(*keys, "idx", *[(F.col(c).cast("string") if c in tokens.columns else F.lit(None).cast("string")).alias(c) for c in cols], *([F.col(score).alias("__s")] if score else []))
    text = blocks(rows, keys, ["idx", *cols], most="__s" if score else None)
    if score:
        text = text.withColumn("value", F.concat(F.lit("# Tree score: "), F.col("__s").cast("string"), F.lit("\n"), F.col("value")))
    _write(text, path, keys, one_file, "\n\n")


def write_missing(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the Parquet folder lacks and gives their number, so that a run that was cut off goes on where it ended.

    Spark's committer makes each append whole or nothing; a second run over the same rows adds none.
    """
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS"))
    before = 0
    if there:
        done = spark.read.parquet(path)
        before = done.count()
        df = df.join(done.select(key).distinct(), key, "left_anti")
    df.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def write_sentences(df: DataFrame, path: str, text: str, order: list[str], one_file: bool = False) -> None:
    _write(df.withColumn("value", F.col(text)), path, order, one_file)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_index(indexed: DataFrame, banded: DataFrame, path: str, notes: dict[str, object] | None = None, most: int | None = None, size: str = "text") -> None:
    """An LSH index: sentences with signatures, bands partitioned by band, and notes such as the number of slots, bands and rows.

    With ``most``, only so many bytes of text are kept, in the order of the key, as a size limit; the notes say how many rows that are.
    """
    key = indexed.columns[0]
    if most is not None:
        upto = running_total(indexed, F.col(key), value=F.octet_length(size), name="__upto").filter(F.col("__upto") <= most).drop("__upto")
        indexed, banded = upto, banded.join(upto.select(key), key, "left_semi")
    write_parquet(indexed, f"{path}/sentences")
    write_parquet(banded, f"{path}/bands", ["band_id"])
    spark = indexed.sparkSession
    rows = {**(notes or {}), "rows": spark.read.parquet(f"{path}/sentences").count()}
    spark.createDataFrame([(k, str(v)) for k, v in rows.items()], "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").options(sep="\t", header=header, nullValue="_").csv(path)
