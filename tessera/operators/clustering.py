"""k-means over columns of float arrays, and search in inverted lists.

Centres are fitted by Spark's own k-means on a bounded sample of rows; every row is assigned to a list and written to the shared folder, so nothing
is left out of the index.  A search looks at the lists nearest to each probe and ranks their rows by exact cosine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import vectors
from tessera.storage import settle


def _usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows of df whose vector is not null, empty or zero and holds no null or non-finite component."""
    c = F.col(f"`{vector}`")
    sound = F.forall(c, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return df.where(c.isNotNull() & (F.size(c) > 0) & sound & F.exists(c, lambda x: x != 0))


def _lists_of(values: np.ndarray) -> pa.Array:
    """A list a row of the matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _units(column: pa.Array) -> pa.Array:
    return _lists_of(vectors._usable(column, None, "a list's row")[1])


def kmeans(df: DataFrame, vector: str, k: int, sample_rows: int = 100_000, seed: int = 1, rounds: int = 20) -> np.ndarray:
    """Centres of k clusters of the unit vectors (k rows at most), from about `sample_rows` rows."""
    rows = _usable(df, vector).select(F.col(f"`{vector}`").alias("vector"))
    share = min(1.0, sample_rows / max(1, rows.count()))
    few = settle(rows.where(F.rand(seed) < share).limit(2 * sample_rows).select(array_to_vector(_units("vector")).alias("features")), "sample")
    return np.array(KMeans(k=k, seed=seed, maxIter=rounds).fit(few).clusterCenters())


def _nearest_lists(vector: str, centres: np.ndarray, n: int) -> Column:
    """Numbers of the n centres nearest to a vector's unit vector, by distance; the centres, a vector a list, travel with the function."""
    squares = (centres * centres).sum(1)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def near(column: pa.Array) -> pa.Array:
        far = squares - 2 * vectors._usable(column, centres.shape[1], "a list's row")[1] @ centres.T
        return _lists_of(np.argsort(far, axis=1, kind="stable")[:, :n].astype(np.int32))

    return near(f"`{vector}`")


@dataclass(frozen=True)
class InvertedLists:
    """All usable rows with their list's number, and the lists' centres."""

    rows: DataFrame
    centres: np.ndarray
    vector: str


def inverted_lists(df: DataFrame, vector: str, lists: int, sample_rows: int = 100_000, seed: int = 1) -> InvertedLists:
    centres = kmeans(df, vector, lists, sample_rows, seed)
    named = _usable(df, vector).withColumn("__list", F.get(_nearest_lists(vector, centres, 1), F.lit(0)))
    return InvertedLists(settle(named, "lists"), centres, vector)


def search(index: InvertedLists, probes: DataFrame, probe_vector: str, k: int, looked_at: int, suffix: str = "_probe") -> DataFrame:
    """For each probe the k nearest rows of its `looked_at` nearest lists: index columns, probe columns, similarity.

    With all lists looked at the result is exact.  Each list's rows in a task meet the probes that look at it in one matrix product; equal
    similarities rank by the rows' other columns.
    """
    asked = _usable(probes, probe_vector)
    asked = asked.withColumn("__lists", _nearest_lists(probe_vector, index.centres, looked_at))
    return vectors.nearest_in_lists(index.rows, asked, index.vector, probe_vector, k, suffix)
