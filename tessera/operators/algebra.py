"""Linear algebra and quantiles over columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.storage import settle

#: Products and entries a side of a tile of a matrix product, as meant; products worked on at once; most tasks.
TILE_PRODUCTS, TILE_ENTRIES, STEP_PRODUCTS, TASKS = 1 << 24, 1 << 21, 1 << 20, 1024


def _square(df: DataFrame, columns: Sequence[str], cell) -> DataFrame:
    """n rows by n columns, row i and column j being cell(i, j) of a symmetric matrix; one pass over df."""
    n = len(columns)
    one = df.agg(*[cell(i, j).alias(f"m{i}_{j}") for i in range(n) for j in range(i, n)])
    rows = [F.struct(*[F.col(f"m{min(i, j)}_{max(i, j)}").alias(columns[j]) for j in range(n)]) for i in range(n)]
    return one.select(F.inline(F.array(*rows)))


def gramian(df: DataFrame, columns: Sequence[str], demean: Sequence[float] | None = None) -> DataFrame:
    """X'X of the columns, each less its entry of demean; rows with a null count nothing in that entry."""
    if demean is not None and len(demean) != len(columns):
        raise ValueError("demean has an entry a column")
    part = [F.col(f"`{c}`").cast("double") - F.lit(float(demean[i]) if demean is not None else 0.0) for i, c in enumerate(columns)]
    return _square(df, columns, lambda i, j: F.sum(part[i] * part[j]))


def covariance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population covariance of the columns."""
    return _square(df, columns, lambda i, j: F.covar_pop(F.col(f"`{columns[i]}`").cast("double"), F.col(f"`{columns[j]}`").cast("double")))


def approximate_quantile(df: DataFrame, columns: Sequence[str], quantiles: Sequence[float], accuracy: int = 100_000) -> DataFrame:
    """A row a quantile in the given order, a column a column."""
    q = F.array(*[F.lit(float(x)) for x in quantiles])
    one = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), q, accuracy).alias(c) for c in columns])
    return one.select(F.inline(F.arrays_zip(*[F.col(f"`{c}`").alias(c) for c in columns])))


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers from 0 for the values of a column, and the values by number; null is a value."""
    one = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    coded = one.dictionary_encode("encode")
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _values(column: pa.ChunkedArray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Values, and where they are there unless all are."""
    there = column.is_valid().to_numpy()[order] if column.null_count else None
    return column.to_numpy()[order], there


def _multiplied(left: pa.Table, right: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (i, j, v) of the product of (i, k, x) and (k, j, y) rows; some rows of the left at a time, and no more than STEP_PRODUCTS products."""
    (i, i_names), (j, j_names) = _coded(left["i"]), _coded(right["j"])
    k, names = _coded(pa.chunked_array([*left["k"].chunks, *right["k"].chunks], left["k"].type))
    k, l = k[: len(left)], k[len(left) :]
    by_row, by_key = np.argsort(i, kind="stable"), np.argsort(l, kind="stable")
    i, k, (x, x_there) = i[by_row], k[by_row], _values(left["x"], by_row)
    j, (y, y_there), wide = j[by_key], _values(right["y"], by_key), len(j_names)
    count = np.bincount(l, minlength=len(names))
    first, each = np.cumsum(count) - count, count[k]
    before = np.concatenate([[0], np.cumsum(each)])  # products before an entry of the left
    begins = np.searchsorted(i, np.arange(len(i_names) + 1))  # entries before a row of the left

    def products(lo: int, hi: int, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Places, values and presence of the products of entries lo to hi."""
        n = each[lo:hi]
        mine = np.repeat(np.arange(lo, hi), n)
        theirs = np.arange(before[hi] - before[lo]) + np.repeat(first[k[lo:hi]] - before[lo:hi] + before[lo], n)
        there = None
        if x_there is not None or y_there is not None:
            there = (x_there[mine] if x_there is not None else True) & (y_there[theirs] if y_there is not None else True)
        value = x[mine] * y[theirs]
        return (i[mine] - row) * wide + j[theirs], value if there is None else np.where(there, value, 0.0), there

    row = 0
    while row < len(i_names):
        to = max(row + 1, int(np.searchsorted(before[begins], before[begins[row]] + STEP_PRODUCTS, "right")) - 1)
        to = min(to, len(i_names))
        lo, hi, area = begins[row], begins[to], (to - row) * wide
        made = before[hi] - before[lo]
        if made and to > row + 1 and area > 4 * made:
            place, value, there = products(lo, hi, row)
            places, at = np.unique(place, return_inverse=True)
            sums, seen = np.bincount(at, value), None if there is None else np.bincount(at, there)
        elif made:
            hits, sums, seen = np.zeros(area, np.int64), np.zeros(area), None
            while lo < hi:  # one row may have more products than a step
                end = min(hi, max(lo + 1, int(np.searchsorted(before, before[lo] + STEP_PRODUCTS, "right")) - 1))
                place, value, there = products(lo, end, row)
                hits += np.bincount(place, minlength=area)
                sums += np.bincount(place, value, minlength=area)
                if there is not None:
                    seen = np.bincount(place, there, minlength=area) + (0 if seen is None else seen)
                lo = end
            places = np.flatnonzero(hits)
            sums, seen = sums[places], None if seen is None else seen[places]
        if made:
            rows, cols = np.divmod(places, wide)
            yield pa.RecordBatch.from_arrays([i_names.take(pa.array(rows + row)), j_names.take(pa.array(cols)), pa.array(sums, mask=None if seen is None else seen == 0)], schema=schema)
        row = to


def _tiled(a: DataFrame, b: DataFrame, down: int, across: int) -> DataFrame:
    """The product by tiles: each of the `down` parts of the left's rows meets each of the `across` parts of the right's columns in one group."""
    a = a.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    a = a.select((F.pmod(F.xxhash64("i"), F.lit(down)) * across + F.col("part")).alias("tile"), "i", "k", "x")
    b = b.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    b = b.select((F.col("part") * across + F.pmod(F.xxhash64("j"), F.lit(across))).alias("tile"), "k", "j", "y")
    out = T.StructType([a.schema["i"], b.schema["j"], T.StructField("v", T.DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("i", left.schema.field("i").type), ("j", right.schema.field("j").type), ("v", pa.float64())])
        return pa.Table.from_batches(_multiplied(left, right, schema) if len(left) and len(right) else [], schema)

    a, b = (side.repartition(min(down * across, TASKS), "tile") for side in (a, b))
    return a.groupBy("tile").cogroup(b.groupBy("tile")).applyInArrow(run, out)


def matmul(left: DataFrame, right: DataFrame) -> DataFrame:
    """Product of two sparse matrices given as (i, j, v) rows.

    Where there are more products than entries to be moved, tiles of the result are computed whole, each in one task, and no product is shuffled.
    Otherwise, and where products are no doubles or indices are floating or nested, products are made by a join and summed.
    """
    a, b = left.selectExpr("i", "j AS k", "v AS x"), right.selectExpr("i AS k", "j", "v AS y")
    joined = a.join(b, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    kind = a.select("k").union(b.select("k")).schema["k"].dataType
    plain = all(isinstance(t, T.AtomicType) and not isinstance(t, (T.FloatType, T.DoubleType)) for t in (a.schema["i"].dataType, b.schema["j"].dataType, kind))
    if not plain or not all(isinstance(t, T.DoubleType) for t in (a.schema["x"].dataType, b.schema["y"].dataType)):
        return joined
    a, b = (settle(side.withColumn("k", F.col("k").cast(kind)).where("k IS NOT NULL"), "matrix") for side in (a, b))
    pairs = a.groupBy("k").agg(F.count("*").alias("n")).join(b.groupBy("k").agg(F.count("*").alias("m")), "k")
    products, n, m = int(pairs.agg(F.sum(F.col("n").cast("decimal(38,0)") * F.col("m"))).first()[0] or 0), a.count(), b.count()
    tiles = max(1, -(-products // TILE_PRODUCTS))
    down = max(-(-n // TILE_ENTRIES), min(tiles, round((tiles * n / max(1, m)) ** 0.5)), 1)
    across = max(-(-m // TILE_ENTRIES), -(-tiles // down), 1)
    if n * across + m * down <= products:
        return _tiled(a, b, down, across)
    return a.join(b, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, rank) of a graph of (src, dst) edges after some rounds; ranks of nodes without out-edges are spread evenly.

    Edges, out-degrees and nodes are settled once in the shared folder, and of each round what nodes with out-edges give along an edge and what targets
    got.  So a round reads the edges once, joins them with what their sources give, which is broadcast while small, and sums by target.
    """
    edges = settle(edges.select("src", "dst").distinct(), "edges")
    sources = settle(edges.groupBy("src").agg(F.count("*").alias("d")), "sources")
    nodes = settle(sources.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct(), "nodes")
    n = max(1, nodes.count())

    def joined(rows: DataFrame, node: str, got: DataFrame | None, lost: float) -> DataFrame:
        if got is None:
            return rows.withColumn("rank", F.lit(1.0 / n))
        rows = rows.join(got, F.col(node) == F.col("dst"), "left")
        return rows.withColumn("rank", F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / n)))

    got, lost = None, 0.0
    for _ in range(rounds):
        gives = settle(joined(sources, "src", got, lost).select("src", (F.col("rank") / F.col("d")).alias("share")), "gives")
        got = settle(edges.join(gives, "src").groupBy("dst").agg(F.sum("share").alias("got")), "got")
        lost = 1.0 - (got.agg(F.sum("got")).first()[0] or 0.0)
    return joined(nodes, "node", got, lost).select("node", "rank")
