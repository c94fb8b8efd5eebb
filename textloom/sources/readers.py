"""Readers and writers. Files are read and written by Spark alone, so any store it knows will do."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("content", T.StringType()), T.StructField("createdAt", T.LongType()), T.StructField("updatedAt", T.LongType())])


def parse_lexicon(lines: DataFrame) -> DataFrame:
    """word, freq of lines (value, and `pos` if the order matters) `word<tab>count`. Lines without a tab after their first
    character are skipped; words are trimmed and lower-cased, counts read from their leading digits, else 0. Of equal
    words the one with the greatest pos counts, or the greatest count where there is no pos."""
    rows = lines.where(F.instr("value", F.lit("\t")) > 1)
    number = F.regexp_extract(F.split_part("value", F.lit("\t"), F.lit(2)), r"^\s*([+-]?\d+)", 1)
    rows = rows.select(F.lower(F.trim(F.split_part("value", F.lit("\t"), F.lit(1)))).alias("word"), F.coalesce(number.try_cast("bigint"), F.lit(0)).alias("freq"), *(["pos"] if "pos" in lines.columns else []))
    rows = rows.where("word != ''")
    last = F.max_by("freq", "pos") if "pos" in lines.columns else F.max("freq")
    return rows.groupBy("word").agg(last.alias("freq"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon file. Its order is that of its parts and the offsets in them, as far as Spark numbers them."""
    return parse_lexicon(spark.read.text(path).withColumn("pos", F.monotonically_increasing_id()))


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    lexicon.select(F.concat_ws("\t", "word", F.col("freq").cast("string")).alias("value")).write.text(path)


def parse_word_list(lines: DataFrame) -> DataFrame:
    """word, lower-cased, of lines `word` or `word<tab>...`; blank lines and those that start with # are skipped."""
    word = F.lower(F.trim(F.substring_index("value", "\t", 1)))
    return lines.where(~F.startswith(F.trim("value"), F.lit("#"))).select(word.alias("word")).where("word != ''").distinct()


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_word_list(spark.read.text(path))


def clean_affixes(text: F.Column) -> F.Column:  # type: ignore[name-defined]
    """An affix file's text without its first line that starts with NEEDAFFIX, and without `,1` at the ends of lines."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)\A(.*?)(^|(?<=\n))NEEDAFFIX[^\n]*\n?", "$1"), r"(?m),1$", "")


def read_affixes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(clean_affixes(F.col("value")).alias("text"))


def read_gold_pairs(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """correct, erroneous, error_types of a tab-separated file whose first line is a header whatever it says; values
    are trimmed and rows without either sentence dropped."""
    schema = "correct string, erroneous string, error_types string"
    rows = spark.read.csv(path, schema=schema, sep="\t", header=header, quote="", enforceSchema=True, mode="PERMISSIVE")
    rows = rows.select(*(F.coalesce(F.trim(c), F.lit("")).alias(c) for c in ("correct", "erroneous", "error_types")))
    return rows.where("correct != '' and erroneous != ''")


def import_documents(spark: SparkSession, path: str) -> DataFrame:
    """id, title, content of .md and .txt files, one row each; the title is the file's name without that ending."""
    rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_path").alias("file"))
    rows = rows.where(F.lower("name").rlike(r"\.(md|txt)$"))
    return rows.select(F.sha1("file").alias("id"), F.regexp_replace("name", r"(?i)\.(md|txt)$", "").alias("title"), F.col("value").alias("content"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A store of documents: JSON lines or one JSON array a file. What cannot be read gives no rows."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", T.ArrayType(DOCUMENT)).alias("many"), F.col("value"))
    many = rows.where("many is not null").select(F.inline("many"))
    lines = rows.where("many is null").select(F.explode(F.split("value", "\n")).alias("line")).select(F.from_json("line", DOCUMENT).alias("d")).where("d.id is not null").select("d.*")
    return many.where("id is not null").union(lines)


def write_documents(docs: DataFrame, path: str) -> None:
    docs.select(*DOCUMENT.names).write.mode("overwrite").json(path)


def list_documents(docs: DataFrame) -> DataFrame:
    return docs.orderBy("createdAt", "id")


def get_document(docs: DataFrame, doc_id: str) -> DataFrame:
    return docs.where(F.col("id") == doc_id)


def update_document(docs: DataFrame, doc_id: str, now_ms: int, title: str | None = None, content: str | None = None) -> DataFrame:
    """docs with one document's title or content set and its time of change; others, and all if there is none, stay."""
    own = F.col("id") == doc_id
    out = docs.withColumn("updatedAt", F.when(own, F.lit(now_ms)).otherwise(F.col("updatedAt")))
    for name, value in (("title", title), ("content", content)):
        if value is not None:
            out = out.withColumn(name, F.when(own, F.lit(value)).otherwise(F.col(name)))
    return out


def read_half_matrix(spark: SparkSession, path: str, width: int) -> DataFrame:
    """id, vector (array<float>) of raw files of little-endian half-precision numbers, `width` a row. Subnormal numbers
    keep their value. Files are read as wholes; split a large matrix into files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, body in zip(batch.column("start").to_pylist(), batch.column("content").to_pylist()):
                rows = np.frombuffer(body, "<f2").astype(np.float32).reshape(-1, width)
                for i in range(0, len(rows), 4096):
                    part = rows[i : i + 4096]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), pa.array(part.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(part)) + i + start), lists], names=["id", "vector"])

    files = spark.read.format("binaryFile").load(path)
    from pyspark.sql.window import Window

    sizes = files.select("path", "length").withColumn("start", F.coalesce(F.sum("length").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / (2 * width))
    placed = files.select("path", "content").join(sizes.select("path", F.col("start").cast("bigint").alias("start")), "path")
    return placed.select("start", "content").mapInArrow(decode, "id bigint, vector array<float>")


def line_of(text: F.Column) -> F.Column:  # type: ignore[name-defined]
    """A text as one line: backslash, new line and carriage return as \\\\, \\n and \\r. Null is empty."""
    out = F.coalesce(text, F.lit(""))
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def text_of(line: F.Column) -> F.Column:  # type: ignore[name-defined]
    """Undoes `line_of`: its pieces are read from the left."""
    pieces = F.regexp_extract_all(line, F.lit(r"(\\.|[^\\]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(p == "\\n", "\n").when(p == "\\r", "\r").when(p == "\\\\", "\\").otherwise(p)), "")


def write_text(docs: DataFrame, path: str, column: str = "text") -> None:
    """One line a row, as `line_of` has it, so that nothing is lost."""
    docs.select(line_of(F.col(column)).alias("value")).write.text(path)


def read_text(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """What `write_text` wrote."""
    return spark.read.text(path).select(text_of(F.col("value")).alias(column))


def write_html(docs: DataFrame, path: str, column: str = "html") -> None:
    docs.select(F.concat(F.lit("<p>"), F.regexp_replace(F.coalesce(column, F.lit("")), r"\r?\n", "<br>"), F.lit("</p>")).alias("value")).write.text(path)


def report(metrics: DataFrame) -> DataFrame:
    """metric, value: the columns of a one-row table as rows."""
    return metrics.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in metrics.columns))).alias("m")).select("m.*")
