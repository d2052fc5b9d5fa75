"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors have cosine of at least t exactly if they lie within eps = sqrt(2 - 2 t).  Vectors are rotated onto their principal
axes (from a bounded sample; a rotation keeps distances, so the sample affects speed alone), sorted by the grid
cells of width eps on the leading axes, and cut into intervals of equal length.

Boxes come first, vectors after: intervals whose boxes share a grid cell, widened by one, and lie within eps on all box axes are
paired, and a pair stays only if some two of their parts, of PART vectors each, lie within eps as well.  Only then do
vectors move, in the precision they came in.  A remaining pair is halved again and again, skipping distant
parts, and what is left is compared by matrix products in double precision.

An interval is as long as lets all pairs keep the cluster's tasks busy twice over, but for INTERVAL_BYTES at most: each interval is sent as
often as it has near ones, so longer ones move less.

Equal vectors are one row with a count.  A task holds two intervals and returns link counts and
a forest of the links, so its result grows with its vectors, not with their pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import stage
from tessera.llm.components import components

#: Bytes of an interval at most, and vectors at least; vectors of the parts that are multiplied; axes of the grid and of boxes.
INTERVAL_BYTES, INTERVAL, PART, AXES, BOX = 16 << 20, 2048, 512, 4, 12
#: Bytes of vectors that the driver takes to find the axes.
SAMPLE_BYTES = 32 << 20


def _narrow(df: DataFrame, vector: str) -> bool:
    """Whether floats hold the column's components exactly."""
    return df.schema[vector].dataType.elementType.simpleString() in ("float", "tinyint", "smallint")


def cleaned(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, h1, h2, raw, dim): digest, little-endian components and their number of each usable vector; nulls for the others.

    Components are floats where the column holds floats, else doubles.
    """
    narrow = _narrow(df, vector)
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<float>" if narrow else "array<double>").alias("v"))
    code = "<f4" if narrow else "<f8"
    schema = T.StructType([rows.schema["key"], *T.StructType.fromDDL("h1 long, h2 long, raw binary, dim int").fields])

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False)  # null components become NaN
            sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
            ends = np.cumsum(sizes)
            h1, h2, raw, dims = [], [], [], []
            for lo, hi in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                v = flat[lo:hi].astype(code) + np.dtype(code).type(0)
                wide = v.astype("<f8")
                usable = hi > lo and bool(np.isfinite(wide).all()) and 0 < float((scaled := wide / (np.abs(wide).max() or 1)) @ scaled)
                data = v.tobytes() if usable else None
                digest = hashlib.blake2b(data, digest_size=16).digest() if usable else None
                raw.append(data)
                dims.append(hi - lo if usable else None)
                h1.append(int.from_bytes(digest[:8], "little", signed=True) if usable else None)
                h2.append(int.from_bytes(digest[8:], "little", signed=True) if usable else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(raw, pa.binary()), pa.array(dims, pa.int32())], names=schema.names)

    return rows.mapInArrow(run, schema)


def unit(raw: list[bytes], dim: int, code: str) -> np.ndarray:
    """Unit vectors in double precision, shorter ones padded with zeros."""
    out = np.zeros((len(raw), dim))
    for i, r in enumerate(raw):
        v = np.frombuffer(r, code)
        out[i, : len(v)] = v
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def principal_axes(reps: DataFrame, n: int, dim: int, sample: int, code: str) -> np.ndarray:
    """Orthonormal axes by falling variance, from about `sample` vectors by hash, SAMPLE_BYTES at most."""
    sample = max(1, min(sample, SAMPLE_BYTES // (8 * dim)))
    few = reps.where(F.pmod(F.col("h1"), F.lit(1_000_000)) < min(1_000_000, 1_000_000 * sample // n + 1)).select("raw").limit(2 * sample).collect()
    x = unit([bytes(r["raw"]) for r in few], dim, code) if few else np.eye(dim)
    x = x - x.mean(0)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()


def _apart(a: np.ndarray, b: np.ndarray) -> float:
    """Least distance of two boxes (lo, hi)."""
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return math.sqrt(float(gap @ gap))


def _box(y: np.ndarray) -> np.ndarray:
    return np.stack([y.min(0), y.max(0)])


def _near(x, y, rows, cols, eps):
    """Pairs of parts that may hold links, by halving the longer sequence while its boxes are not apart."""
    todo = [(rows, cols)]
    while todo:
        (a, b), (c, d) = todo.pop()
        if _apart(_box(x[a:b]), _box(y[c:d])) > eps:
            continue
        if b - a <= PART and d - c <= PART:
            yield (a, b), (c, d)
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [((a, m), (c, d)), ((m, b), (c, d))]
        else:
            m = (c + d) // 2
            todo += [((a, b), (c, m)), ((a, b), (m, d))]


def _bipartite(mask: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Edges of a forest over the links of mask."""
    used_l, used_r = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    part, ids = mask[np.ix_(used_l, used_r)], left[used_l]
    label = np.arange(len(used_l))
    top = len(used_l)
    while True:
        of_right = np.where(part, label[:, None], top).min(0)
        new = np.where(part, of_right[None, :], top).min(1)
        if (new == label).all():
            break
        label = new
    return np.concatenate([ids, right[used_r]]), np.concatenate([ids[label], ids[of_right]])


def joined(one: tuple, two: tuple, same: bool, axes: np.ndarray, threshold: float):
    """(id, links) and (u, v) of two intervals, each (ids, counts, raw doubles)."""
    eps = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    (ids_a, n_a, a), (ids_b, n_b, b) = one, two
    links_a, links_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    lead = axes[:, :BOX]
    ya, yb = a @ lead, b @ lead
    u, v = [], []
    for (i, j), (k, m) in _near(ya, yb, (0, len(a)), (0, len(b)), eps):
        if same and k < i:
            continue
        cos = a[i:j] @ b[k:m].T
        mask = cos >= threshold
        close = np.argwhere(np.abs(cos - threshold) < 1e-12)
        for p, q in close.tolist():
            mask[p, q] = float(np.dot(a[i + p], b[k + q])) >= threshold
        if same and i == k:
            np.fill_diagonal(mask, False)
        if not mask.any():
            continue
        links_a[i:j] += mask @ n_b[k:m]
        if not (same and i == k):
            links_b[k:m] += n_a[i:j] @ mask
        got = _bipartite(mask, ids_a[i:j], ids_b[k:m])
        u.append(got[0])
        v.append(got[1])
    if same:
        links_a += links_b
        links_b[:] = 0
    return [(ids_a[links_a > 0], links_a[links_a > 0]), (ids_b[links_b > 0], links_b[links_b > 0])], (np.concatenate(u), np.concatenate(v)) if u else None


def _halved_boxes(y: np.ndarray) -> np.ndarray:
    """The box of each part of PART rows: (parts, 2, axes)."""
    return np.stack([_box(y[lo : lo + PART]) for lo in range(0, len(y), PART)])


def _any_near(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether some part of one interval lies within eps of some part of the other."""
    gap = np.maximum(0, np.maximum(a[:, None, 0] - b[None, :, 1], b[None, :, 0] - a[:, None, 1]))
    return bool(((gap * gap).sum(2) <= eps * eps).any())


def near_intervals(boxes: DataFrame, eps: float, axes: int) -> DataFrame:
    """(interval_a, interval_b), a <= b: the pairs that may hold links.  boxes: (interval, lo, hi, parts), a row an interval.

    Intervals meet in the cells of their first axes; the first cell that two share speaks for the pair.
    """
    step, lead = F.lit(eps or 1.0), range(min(AXES, axes))
    low = [F.floor(F.get("lo", F.lit(k)) / step) for k in lead]
    high = [F.floor(F.get("hi", F.lit(k)) / step) + 1 for k in lead]
    spans = boxes.select("interval", "lo", "hi", "parts", *[x.alias(f"from{k}") for k, x in enumerate(low)], *[x.alias(f"to{k}") for k, x in enumerate(high)])
    cells = spans.select("interval", "lo", "hi", *[f"from{k}" for k in lead], *[f"to{k}" for k in lead])
    for k in lead:
        cells = cells.withColumn(f"cell{k}", F.explode(F.sequence(f"from{k}", f"to{k}")))
    a, b = (cells.select(*[f"cell{k}" for k in lead], *[F.col(c).alias(f"{c}_{s}") for c in ("interval", "lo", "hi", *[f"from{k}" for k in lead])]) for s in "ab")
    pairs = a.join(b, [f"cell{k}" for k in lead]).where("interval_a <= interval_b")
    for k in lead:
        pairs = pairs.where(F.col(f"cell{k}") == F.greatest(f"from{k}_a", f"from{k}_b"))
    gap = lambda k: F.greatest(F.lit(0.0), F.get("lo_b", F.lit(k)) - F.get("hi_a", F.lit(k)), F.get("lo_a", F.lit(k)) - F.get("hi_b", F.lit(k)))
    total = sum((gap(k) * gap(k) for k in range(axes)), F.lit(0.0))
    pairs = stage(pairs.where(total <= eps * eps).select("interval_a", "interval_b"), "pairs")
    sides = [boxes.select(F.col("interval").alias(f"interval_{s}"), F.col("parts").alias(f"parts_{s}")) for s in "ab"]
    rows = pairs.join(sides[0], "interval_a").join(sides[1], "interval_b").select("interval_a", "interval_b", "parts_a", "parts_b")

    def run(batches):
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), "<f8").reshape(-1, 2, axes) for c in (2, 3))
                keep.append(_any_near(x, y, eps))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["interval_a", "interval_b"])

    return rows.mapInArrow(run, "interval_a long, interval_b long")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, sample: int = 4096) -> DataFrame:
    """key, n_links (other rows with cosine >= threshold), component_id (smallest key by links), kept; one row for each input row.

    Null, empty and zero vectors and those with a null or non-finite component link with nothing.  Vectors of
    unequal length compare as if padded with zeros.  Repeated rows link with each other, whatever their keys.  A null key is kept unless linked.
    Keys may be of any ordered type; other columns, whatever their names, are not looked at; an empty table gives no rows.
    """
    spark = df.sparkSession
    seen = stage(cleaned(df, key, vector), "vectors")
    usable = seen.where("raw is not null")
    reps = stage(usable.groupBy("h1", "h2").agg(F.min("key").alias("key"), F.count("*").alias("n"), F.first("raw").alias("raw"), F.first("dim").alias("dim")), "unequal")
    total, dim, size = reps.agg(F.count("*"), F.max("dim"), F.max(F.length("raw"))).first()
    dim = dim or 1
    code = "<f4" if _narrow(df, vector) else "<f8"
    axes = principal_axes(reps, max(1, total), dim, sample, code)
    eps = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    lead = min(dim, BOX)
    shared = spark.sparkContext.broadcast(axes)  # dim * dim doubles

    def cells(batches):
        for batch in batches:
            if batch.num_rows:
                y = unit(batch.column(3).to_pylist(), dim, code) @ shared.value[:, : min(dim, AXES)]
                grid = np.floor(y / eps).astype(np.int32)
                more = [pa.array(grid[:, k] if k < grid.shape[1] else np.zeros(len(grid), np.int32)) for k in range(AXES)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more, pa.array(y[:, 0])], names=["h1", "h2", "n", "raw", *[f"c{k}" for k in range(AXES)], "y"])

    order = [f"c{k}" for k in range(AXES)]
    placed = reps.select("h1", "h2", "n", "raw").mapInArrow(cells, "h1 long, h2 long, n long, raw binary, c0 int, c1 int, c2 int, c3 int, y double")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    long = max(INTERVAL, min(INTERVAL_BYTES // max(1, size or 1), -(-total // math.ceil(math.sqrt(4 * tasks)))))
    ordered = placed.repartitionByRange(max(tasks, min(2000, total // long + 1)), *order, "y", "h1", "h2").sortWithinPartitions(*order, "y", "h1", "h2")
    # The place among the written rows names a vector from here on: keys may repeat or be null.
    ordered = stage(ordered.select("h1", "h2", "n", "raw", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("id")), "ordered")
    sizes = ordered.groupBy("pid").agg(F.count("*").alias("c"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ordered.join(sizes.select("pid", "first", before.alias("before")), "pid")
    at = F.col("id") - F.col("first") + F.col("before")
    cut = ranked.select(F.floor(at / long).alias("interval"), at.alias("place"), "id", "n", "raw")

    def bundled(batches):
        held: list = []

        def out():
            ids, n = np.array([h[1] for h in held], "<i8"), np.array([h[2] for h in held], "<i8")
            y = unit([h[3] for h in held], dim, code) @ shared.value[:, :lead]
            box = _box(y)
            data = [h[3] for h in held]
            ends = np.cumsum([len(d) for d in data]).astype("<i8")
            return pa.RecordBatch.from_pydict({"interval": [held[0][0]], "ids": [ids.tobytes()], "counts": [n.tobytes()], "x": [b"".join(data)], "ends": [ends.tobytes()], "lo": [box[0].tolist()], "hi": [box[1].tolist()], "parts": [_halved_boxes(y).tobytes()]})

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3, 4)], strict=True):
                if held and held[0][0] != row[0]:
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    bundle = "interval long, ids binary, counts binary, x binary, ends binary, lo array<double>, hi array<double>, parts binary"
    intervals = stage(cut.repartition("interval").sortWithinPartitions("interval", "place").mapInArrow(bundled, bundle), "intervals")
    pairs = stage(near_intervals(intervals.select("interval", "lo", "hi", "parts"), eps, lead), "near")
    sides = [intervals.select(F.col("interval").alias(f"interval_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "counts", "x", "ends")]) for s in "ab"]
    work = pairs.join(sides[0], "interval_a").join(sides[1], "interval_b")
    work = work.select("interval_a", "interval_b", *[f"{c}_{s}" for s in "ab" for c in ("ids", "counts", "x", "ends")]).repartition(F.xxhash64("interval_a", "interval_b"))

    def compared(batches):
        def part(batch, i, k):
            ids, n, x, ends = (batch.column(c)[i].as_buffer() for c in range(k, k + 4))
            ends = np.frombuffer(ends, "<i8").tolist()
            raw = [x[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]
            return np.frombuffer(ids, "<i8"), np.frombuffer(n, "<i8"), unit(raw, dim, code)

        for batch in batches:
            for i in range(batch.num_rows):
                same = batch.column(0)[i] == batch.column(1)[i]
                links, edges = joined(part(batch, i, 2), part(batch, i, 6), same, shared.value, threshold)
                for ids, n in links:
                    if len(ids):
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.nulls(len(ids), pa.int64())], names=["u", "links", "v"])
                if edges:
                    yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(np.zeros(len(edges[0]), np.int64)), pa.array(edges[1])], names=["u", "links", "v"])

    found = stage(work.mapInArrow(compared, "u long, links long, v long"), "found")
    links = found.where("v is null").groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("links"))
    comp = components(found.where("v is not null").select("u", "v"))
    of = ordered.select("h1", "h2", "id").join(reps.select("h1", "h2", "key", "n"), ["h1", "h2"]).join(links, "id", "left").join(comp, F.col("id") == F.col("node"), "left")
    of = stage(of.select("h1", "h2", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("comp")), "reps")
    least = of.groupBy("comp").agg(F.min("key").alias("component_id"))
    of = of.join(least, "comp").select("h1", "h2", "n_links", "component_id")
    name = F.col("key").alias(key)
    out = seen.where("raw is not null").select("key", "h1", "h2").join(of, ["h1", "h2"])
    linked = out.select(name, F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
    return linked.unionByName(seen.where("raw is null").select(name, F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept")))
