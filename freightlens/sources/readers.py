"""Files to rows. Text columns are cast with ``try_cast``: what does not parse is NULL, never an error."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import all_text, columns
from .record_csv import record_csv


def typed(rows: DataFrame, ddl: str) -> DataFrame:
    """All-text rows in the types of ``ddl``; '' and 'null' are missing, absent columns are NULL."""
    have = set(rows.columns)

    def one(name: str, kind: str) -> Column:
        if name not in have:
            return F.lit(None).cast(kind).alias(name)
        text = F.when(~F.col(name).isin("", "null"), F.col(name))
        return (F.try_to_date(text) if kind == "date" else text.try_cast(kind)).alias(name)

    wanted = columns(ddl)
    extra = [c for c in rows.columns if c not in {n for n, _ in wanted}]
    return rows.select(*[one(n, t) for n, t in wanted], *extra)


def read_csv(spark: SparkSession, path: str, ddl: str, **options: str) -> DataFrame:
    """CSV files that share one header, read as text and cast."""
    raw = spark.read.schema(all_text(ddl)).option("header", True).option("mode", "PERMISSIVE").options(**options).csv(path)
    return typed(raw, ddl)


def csv_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, header) of every CSV file below ``path`` that is not empty; only first lines are read."""
    return record_csv(spark, path, mode="headers").load()


def read_csv_by_name(spark: SparkSession, path: str | list[str], ddl: str, id_col: str, multiline: bool = False) -> DataFrame:
    """CSV files whose headers differ from file to file: columns are found by name in each file.

    One scan, see ``record_csv``. Files whose header does not name ``id_col`` are not read here but by ``foreign_csv``.
    """
    raw = record_csv(spark, path, id_col=id_col, multiline=str(multiline)).schema(f"{all_text(ddl)}, file string").load()
    return typed(raw, ddl)


def foreign_csv(spark: SparkSession, path: str | list[str], id_col: str) -> DataFrame:
    """(file, line) of the files that ``read_csv_by_name`` leaves out, for the rejected side output."""
    return record_csv(spark, path, id_col=id_col, mode="foreign").load()


def with_file(rows: DataFrame) -> DataFrame:
    """Rows of a file source with file name and time of last change."""
    return rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("last_modified"))


def with_priority(rows: DataFrame, first: str, file: str = "file") -> DataFrame:
    """0 for rows of the preferred file, 1 for the others: a sort and precedence key."""
    name = F.element_at(F.split(F.col(file), "/"), -1)
    return rows.withColumn("priority", F.when(name.startswith(first), 0).otherwise(1))


def prefer_first(rows: DataFrame, key: str) -> DataFrame:
    """One row per key, from the file with the best priority."""
    rest = [c for c in rows.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct("priority", "file", F.to_json(F.struct(*rest))))
    return rows.groupBy(key).agg(best.alias("r")).select(key, "r.*")


def read_jsonl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).json(path)


def read_json_documents(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """One JSON document per file."""
    return spark.read.schema(ddl).option("multiLine", True).option("recursiveFileLookup", True).json(path)


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """One text per file."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def read_text_any_encoding(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as UTF-8 where valid, else as Latin-1."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(utf8, F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return raw.select(F.col("path").alias("file"), text.alias("content"), utf8.alias("is_utf8"))


def changed_since(spark: SparkSession, path: str, ddl: str, since: str) -> DataFrame:
    """Rows of the CSV files changed after a moment (ISO, session time zone)."""
    raw = spark.read.schema(all_text(ddl)).option("header", True).option("modifiedAfter", since).csv(path)
    return typed(raw, ddl)


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A parquet table, or None while nothing has been written there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
