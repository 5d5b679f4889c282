"""Texts as overlapping chunks, and the chunk table as an index."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import words

SIZE, OVERLAP = 1000, 200
SEPARATORS = ["\n\n", "\n", ". ", " ", ""]


def chunk_windows(docs: DataFrame, text: str = "content", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Whole text in windows of ``size`` that start every ``size - overlap`` characters."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / F.lit(float(step))) - 1, F.lit(0)).cast("int")
    rows = docs.where(F.length(F.trim(text)) > 0).withColumn("chunk_id", F.explode(F.sequence(F.lit(0), last)))
    piece = F.substring(F.col(text), F.col("chunk_id") * step + 1, F.lit(size))
    return rows.withColumn(text, piece).where(F.length(F.trim(text)) > 0)


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: list[str] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that fits.

    Neighbouring pieces are packed together; the tail of a packed chunk, up to ``overlap``
    characters, opens the next one.
    """

    def pieces(part: str, level: int) -> list[str]:
        sep = separators[level]
        if sep == "":
            return list(part)
        cut = part.split(sep)
        kept = [cut[0]] + [sep + x for x in cut[1:]]
        out = []
        for x in kept:
            out += [x] if len(x) <= size else pieces(x, level + 1)
        return [x for x in out if x]

    out, window, length = [], [], 0
    for piece in pieces(text, 0):
        if length + len(piece) > size and window:
            out.append("".join(window).strip())
            while window and (length > overlap or length + len(piece) > size):
                length -= len(window.pop(0))
        window.append(piece)
        length += len(piece)
    out.append("".join(window).strip())
    return [x for x in out if x]


def chunk_by_separators(docs: DataFrame, text: str = "content", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Separator-aware chunks; rows stay where they are, texts are cut batch by batch."""
    keep = [c for c in docs.columns if c != text]

    def run(batches):
        for pdf in batches:
            pdf["_chunks"] = [list(enumerate(split_text(t or "", size, overlap))) for t in pdf[text]]
            rows = pdf.drop(columns=[text]).explode("_chunks").dropna(subset=["_chunks"])
            if len(rows):
                rows["chunk_id"] = [c[0] for c in rows["_chunks"]]
                rows[text] = [c[1] for c in rows["_chunks"]]
                yield rows[[*keep, "chunk_id", text]]
            else:
                yield pd.DataFrame(columns=[*keep, "chunk_id", text]).astype(object)

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.select(*keep).dtypes)
    return docs.mapInPandas(run, f"{fields}, chunk_id int, `{text}` string")


def listing(chunks: DataFrame) -> DataFrame:
    """What is indexed: key, type, source, time and the first hundred characters."""
    preview = F.when(F.length("content") > 100, F.concat(F.substring("content", 1, 100), F.lit("..."))).otherwise(F.col("content"))
    return chunks.select("doc_id", "chunk_id", F.col("doc_type").alias("type"), F.coalesce("source", F.lit("unknown")).alias("source"), "ts", preview.alias("preview"))


def store_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_type").agg(F.count("*").alias("documents"), F.max("ts").alias("last_refresh"))


def common_words(a: str | Column, b: str | Column) -> Column:
    """Distinct words two texts share."""
    low = lambda x: words(F.lower(F.col(x) if isinstance(x, str) else x))
    return F.array_intersect(low(a), low(b))
