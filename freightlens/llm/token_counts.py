"""Token counts as rollups maintained by signed deltas.

A batch of changes (inserts, deletes, revised counts) becomes signed amounts that are summed per source,
language and tokenizer version; only these sums are stored, never the documents. Totals are the sum over
all committed batches. A batch is written to a folder of its own attempt and takes effect with a commit record
that names the attempt. Records are only ever added and the latest of a batch counts, so a repeated or half-written
batch counts once and a batch that is committed again is never gone in between.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, stored, table

KEYS = ["source", "lang", "tokenizer"]
CHANGES = "kind string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"
_DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long, batch_id string, attempt string"
_COMMITS = "batch_id string, attempt string, at long"  # at: nanoseconds since the epoch; equal times go by attempt

# tokenizers as patterns whose matches are the tokens
WORDS = r"[^\x09-\x0D\x20]+"
PIECES = r"[A-Za-z]+|[0-9]|[^\x09-\x0D\x20A-Za-z0-9]"


def signed(changes: DataFrame) -> DataFrame:
    """Sums of the signed amounts per key: n_docs and n_tokens to add.

    ``kind`` is insert (adds n_tokens), delete (takes n_tokens away) or revise (replaces old_tokens by
    n_tokens under the same key; a change of key is a delete and an insert). Null counts are 0, null keys
    are a key of their own. Rows of another kind stop the batch.
    """
    n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    kind = F.col("kind")
    docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0)
    tokens = F.when(kind == "insert", n).when(kind == "delete", -n).when(kind == "revise", n - old)
    known = F.coalesce(kind.isin("insert", "delete", "revise"), F.lit(False))
    docs = F.when(known, docs).otherwise(F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null")))).cast("int"))
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))


def commit(changes: DataFrame, path: str, batch_id: str) -> None:
    """Adds a batch to the rollup at ``path``. The same ``batch_id`` again replaces what it said before."""
    spark, attempt = changes.sparkSession, uuid.uuid4().hex
    # a few rows per source: one file is enough, and it is written by one task after the shuffled sums
    delta = signed(changes).withColumn("batch_id", F.lit(batch_id)).withColumn("attempt", F.lit(attempt))
    delta.coalesce(1).write.parquet(f"{path}/deltas/batch_id={batch_id}-{attempt}")
    _record(spark, path, batch_id, attempt)


def _record(spark: SparkSession, path: str, batch_id: str, attempt: str) -> None:
    record = spark.createDataFrame([(batch_id, attempt, time.time_ns())], _COMMITS)
    record.coalesce(1).write.parquet(f"{path}/commits/{batch_id}-{attempt}")


def _read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """All files below a folder; no rows while there is no folder."""
    try:
        return spark.read.schema(ddl).option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """Documents and tokens per key over all committed batches; keys with nothing left are gone.

    A rollup without commits has no rows.
    """
    deltas, commits = _read(spark, f"{path}/deltas", _DELTAS), _read(spark, f"{path}/commits", _COMMITS)
    valid = commits.groupBy("batch_id").agg(F.max_by("attempt", F.struct("at", "attempt")).alias("attempt"))
    sums = deltas.join(valid, ["batch_id", "attempt"], "left_semi").groupBy(*KEYS)
    sums = sums.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return sums.filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Writes the totals as the only batch of a new rollup."""
    base = totals(spark, path).withColumn("batch_id", F.lit("base")).withColumn("attempt", F.lit("base"))
    base.coalesce(1).write.parquet(f"{target}/deltas/batch_id=base")
    _record(spark, target, "base", "base")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, key of the text, and its counts: words, pieces and a guess of the pieces."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.unhex(F.md5(F.concat(F.when(F.col("text").isNull(), "0").otherwise("1"), text))).alias("key"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
        F.regexp_count(text, F.lit(PIECES)).cast("long").alias("pieces"),
        F.ceil(F.length(text) / 4).cast("long").alias("guess"),
    )


def _changes(rows: DataFrame, kind: str, tokenizer: str, n: str, old: str | None = None) -> DataFrame:
    return rows.select(
        F.lit(kind).alias("kind"),
        "source",
        "lang",
        F.lit(tokenizer).alias("tokenizer"),
        F.col(n).alias("n_tokens"),
        (F.col(old) if old else F.lit(None).cast("long")).alias("old_tokens"),
    )


def document_rollup(docs: DataFrame) -> DataFrame:
    """The rollup of a corpus after a history of four batches, one of them delivered twice.

    All documents are inserted under ``words_v1`` and, with a guess of their count, under ``pieces_v2``.
    Then the later copies of equal texts are deleted (the smallest doc_id stays, null ids count as largest;
    rows alike in text and id all stay) and the guesses of the rest are revised to the real counts.
    Null texts are equal to each other and have no tokens. Texts of any length are counted whole, other columns are
    ignored, and no documents give no rows.
    """
    spark = docs.sparkSession
    rows = stored(counted(docs), "token-counts")
    path = f"{shared_folder(spark)}/token-rollup-{uuid.uuid4().hex}"
    # the group key and its smallest id meet by a join; Spark splits the keys that many documents share
    first = rows.groupBy("key").agg(F.min("doc_id").alias("first"))
    marked = stored(rows.join(first, "key").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first"))), "token-marked")
    stay, go = marked.filter("stays"), marked.filter("NOT stays")
    gone = _changes(go, "delete", "words_v1", "words").unionByName(_changes(go, "delete", "pieces_v2", "guess"))
    commit(_changes(rows, "insert", "words_v1", "words"), path, "insert-words")
    commit(_changes(rows, "insert", "pieces_v2", "guess"), path, "insert-pieces")
    commit(gone, path, "delete-copies")
    commit(_changes(stay, "revise", "pieces_v2", "pieces", "guess"), path, "revise-pieces")
    commit(gone, path, "delete-copies")
    return totals(spark, path)


def op5_token_counts(spark, sf_dir):
    return document_rollup(table(spark, sf_dir, "documents"))


OP5_SQL = rf"""
WITH kept AS (SELECT d.* FROM documents d JOIN (SELECT text AS t, min(doc_id) AS first FROM documents GROUP BY text) f
   ON d.text IS NOT DISTINCT FROM f.t AND d.doc_id IS NOT DISTINCT FROM f.first),
 counts AS (
  SELECT source, lang, 'words_v1' AS tokenizer, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) AS n FROM kept
  UNION ALL
  SELECT source, lang, 'pieces_v2', coalesce(len(regexp_extract_all(text, '{PIECES}')), 0) FROM kept)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM counts GROUP BY source, lang, tokenizer
"""
