"""Text embeddings.  A model call is a slot: ``embed`` takes any Arrow batch function.  The stand-in
that needs none is a hashed bag of words, scaled to unit length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(word: Column, dim: int) -> Column:
    """A word's dimension, from its MD5."""
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 6), 16, 10).cast("long"), F.lit(dim))


def hashed_words(df: DataFrame, id_col: str, text_col: str, dim: int) -> DataFrame:
    """(id, dim, weight): unit-length word counts by hashed dimension; texts without words have
    no rows.  One aggregation by row and dimension, with map-side sums."""
    words = F.explode(F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(r"(?U:\w+)"), F.lit(0))).alias("w")
    n = df.select(id_col, words).groupBy(id_col, bucket(F.col("w"), dim).alias("dim")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(id_col)))
    return n.select(id_col, "dim", (F.col("n") / norm).alias("weight"))


def dense(long: DataFrame, id_col: str, dim: int) -> DataFrame:
    """(id, embedding): the long form as arrays."""
    m = long.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("dim", "weight"))).alias("m"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0)))
    return m.select(id_col, cells.alias("embedding"))


def embed(df: DataFrame, text_col: str, model: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """``df`` with an embedding from a model that maps a batch of texts to vectors; an empty text
    is an error, as the model would embed nothing."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            texts = [x or "" for x in s]
            if not all(t.strip() for t in texts):
                raise ValueError("an empty text can't be embedded")
            out: list[list[float]] = []
            for k in range(0, len(texts), batch):
                out += model(texts[k : k + batch])
            yield pd.Series(out)

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn("embedding", F.pandas_udf(run, "array<double>")(text_col))
