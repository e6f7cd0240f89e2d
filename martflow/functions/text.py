"""Splitting search text into words.

``words`` is a column expression and stays in the JVM.  ``word_splitter`` wraps
a function of your own (a dictionary segmenter, say) as an Arrow-batched UDF
with the same shape, and ``register_word_table_function`` offers the table
function form for SQL: ``LATERAL ik_analyze(text) t(word)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType

NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: str | Column) -> Column:
    """Lower-cased runs of letters and digits, in order, repeats kept."""
    spaced = F.regexp_replace(F.lower(text), NOT_WORD, " ")
    return F.array_remove(F.split(spaced, " "), "")


def word_splitter(split: Callable[[str], Iterable[str]]) -> Callable[[Column], Column]:
    """A plug-in segmenter as a column function (``array<string>``)."""

    @F.pandas_udf(ArrayType(StringType()))
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else list(split(t)))

    return apply


def register_word_table_function(spark: SparkSession, name: str = "ik_analyze") -> None:
    """Register the table function; text without words yields no row.

    It is a SQL function over the same expression as ``words``, so it is planned
    as a generator inside the JVM.
    """
    spark.sql(rf"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS TABLE(word STRING)
        RETURN SELECT explode(array_remove(split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' '), ' '), '')) AS word""")
