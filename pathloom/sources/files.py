"""Readers that give tables of JSON documents, and writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("lines", "whole", "parquet", "orc")


def read_documents(spark: SparkSession, path: str | list[str], form: str = "lines", id_col: str = "doc_id", json_col: str = "json") -> DataFrame:
    """Rows (id, json). "lines": a document a line, the id made of file and line; "whole": a document a file, the id its path;
    "parquet" and "orc": tables that have both columns already, of which only these are read.

    The id of a line is its file with a hash of the text, as lines of a split file have no number.
    """
    if form not in FORMATS:
        raise ValueError(f"unknown form {form!r}, not one of {FORMATS}")
    if form in ("parquet", "orc"):
        return spark.read.format(form).load(path).select(id_col, json_col)
    text = spark.read.text(path, wholetext=form == "whole")
    name = F.input_file_name()
    if form == "whole":
        return text.select(name.alias(id_col), F.col("value").alias(json_col))
    return text.where(F.trim("value") != "").select(F.concat(name, F.lit("#"), F.xxhash64("value").cast("string")).alias(id_col), F.col("value").alias(json_col))


def read_document_stream(spark: SparkSession, path: str, schema: str, form: str = "parquet", **options: str) -> DataFrame:
    """The same as a stream: new files of a folder or glob. `schema` is needed as a stream does not look ahead."""
    return spark.readStream.format(form).schema(schema).options(**options).load(path)


def write_results(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Write a result as "parquet", "orc", "json" (one object a line) or, for a single text column, "text".

    VARIANT columns become JSON text where the form has no such type.
    """
    if form != "parquet":
        df = df.withColumns({c: F.to_json(F.col(f"`{c}`")) for c, kind in df.dtypes if kind == "variant"})
    writer = df.write.format(form).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
