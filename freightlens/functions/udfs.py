"""Escape hatches for logic that has to stay in Python: functions of whole Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.chunks import OVERLAP, SIZE, split_text


def batch_apply(columns: Sequence[str], fn: Callable[[pd.DataFrame], pd.Series], returns: str) -> Column:
    """A vectorised function of a batch as a column; the batch has the named columns."""

    @F.pandas_udf(returns)
    def run(batch: pd.DataFrame) -> pd.Series:
        return fn(batch)

    return run(F.struct(*columns))


def row_apply(columns: Sequence[str], fn: Callable[[dict], object], returns: str) -> Column:
    """A function of a row dict as a column: one Python call per row, the slow way, for logic that no
    batch function expresses."""

    def each(batch: pd.DataFrame) -> pd.Series:
        clean = batch.astype(object).where(batch.notna(), None)
        return pd.Series([fn(r) for r in clean.to_dict("records")])

    return batch_apply(columns, each, returns)


def filter_apply(rows: DataFrame, columns: Sequence[str], fn: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Rows that a vectorised predicate accepts."""
    return rows.where(batch_apply(columns, fn, "boolean"))


@F.udtf(returnType="chunk_id int, chunk string")
class SplitText:
    """Text to chunks as a table function."""

    def eval(self, text: str):
        for i, piece in enumerate(split_text(text or "", SIZE, OVERLAP)):
            yield i, piece


def register_chunker(spark, name: str = "split_text") -> str:
    spark.udtf.register(name, SplitText)
    return name
