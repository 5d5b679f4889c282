"""A corpus pipeline of five stages over the ``documents`` table.

Every stage takes what the one before it kept, applies one operator and writes its result to the shared
folder; the next stage reads it from there. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightlens.llm import decontam, jaccard, lines, packing, toxicity
from freightlens.llm.common import quoted, spelled, stored, table, unused


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with the key that the operators give a text, under a free name."""
    name = unused(docs, "text_key")
    return docs.withColumn(name, F.coalesce(F.md5(F.col("text").cast("string")), F.lit("none"))), name


def _same(key: str) -> F.Column:
    return F.col("d.doc_id").cast("long").eqNullSafe(F.col("f.doc_id")) & (F.col(f"d.{key}") == F.col("f.key"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score 0.5 or more) go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.filter(F.col(scored.columns[-1]) < 0.5).select(*quoted(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines keep their first place. A document that loses all of its text goes."""
    left = lines.dedup_lines(docs).filter("n_removed > 0").dropDuplicates(["doc_id", "key"])
    keyed, key = _keyed(docs)
    joined = keyed.alias("d").join(left.alias("f"), _same(key), "left")
    changed = F.col("f.n_removed").isNotNull()
    joined = joined.filter(~changed | (F.col("f.text") != ""))
    text = spelled(docs, "text")
    new = F.when(changed, F.col("f.text")).otherwise(F.col("d.text")).alias(text)
    return joined.select(*[new if c == text else F.col(f"d.{name}") for c, name in zip(docs.columns, quoted(docs), strict=True)])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Null ids come last, of texts under one id the smallest key comes first, and of rows alike in id and text
    one stays. Documents without shingles are in no group.
    """
    keyed, key = _keyed(docs)
    found = stored(jaccard.members(docs), "members")
    rank = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")
    first = found.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min(rank).alias("first"))
    alone = found.filter(F.col("root").isNull()).select("doc_id", "key")
    stay = first.select("first.doc_id", "first.key").unionByName(alone)
    kept = keyed.alias("d").join(stay.alias("f"), _same(key), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).select(*quoted(docs))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is mostly benchmark goes."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of the documents that are left, placed in sequences."""
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("best-fit packing", pack),
]

# a fitted model, a hash-based join and a tokenizer are beyond SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
