"""Nearest-neighbour joins on columns of float arrays, by exact cosine.

The stream is scanned once, whatever the number of probes.  Probes that fit into one block go to every task at once; more are written to
the shared folder as blocks, which a task takes one after the other for each stretch of its rows.  Matrix products find candidates, which are then
weighed one by one, so that copies are equal wherever they stand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.storage import listed, settle

#: Rows and bytes of a block of probes; bytes of vectors of a stretch of the stream, and of similarities and of pairs looked at together.
BLOCK_ROWS, BLOCK_BYTES, STRETCH_BYTES, SCORE_BYTES = 8192, 64 << 20, 32 << 20, 16 << 20
#: Most answers kept at once.
ANSWERS = 1 << 20
#: More than a matrix product differs from the similarity summed for the pair alone.
SLACK = 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors of the rows, in place; zero stays zero."""
    for lo in range(0, len(x), 4096):
        part = x[lo : lo + 4096]
        top = np.abs(part).max(1, keepdims=True, initial=0)
        part /= np.where(top > 0, top, 1.0)
        norm = np.linalg.norm(part, axis=1, keepdims=True)
        part /= np.where(norm > 0, norm, 1.0)
    return x


def _usable(column: pa.Array, dim: int | None, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that can be compared, and those as unit vectors; lengths that differ are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.array([-1 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
    there = np.flatnonzero(sizes > 0)
    wanted = dim if dim is not None else int(sizes[there[0]]) if len(there) else 0
    if odd := sorted(set(sizes[there].tolist()) - {wanted}):
        raise ValueError(f"{name} has vectors of {odd[0]} components beside such of {wanted}")
    flat = column.take(pa.array(there)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(there), wanted)
    fine = np.isfinite(flat).all(1)  # null components are NaN here
    return there[fine], _unit(flat[fine])


def _comparable(df: DataFrame, vector: str) -> DataFrame:
    c = F.col(f"`{vector}`")
    return df.where(c.isNotNull() & (F.size(c) > 0))


#: Numbers, unit vectors and, a row a probe, the lists looked at.
Block = tuple[np.ndarray, np.ndarray, np.ndarray | None]


def _blocks(probes: DataFrame, vector: str) -> tuple[int, Callable[[], Iterator[Block]]]:
    """The probes' dimension, and what gives a task their blocks.  probes have a number as __probe and may have lists of equal length as __lists."""
    spark, few = probes.sparkSession, _comparable(probes, vector).select("__probe", vector, *[c for c in probes.columns if c == "__lists"])
    n, least, dim = few.agg(F.count("*"), F.min(F.size(vector)), F.max(F.size(vector))).first()
    if not n:
        return 0, lambda: iter(())
    if least != dim:
        raise ValueError(f"{vector} has vectors of {least} components beside such of {dim}")

    def read(table: pa.Table) -> Block:
        at, unit = _usable(table[vector], dim, vector)
        lists = np.stack(table["__lists"].to_numpy()) if "__lists" in table.column_names and len(table) else None
        return table["__probe"].to_numpy()[at], unit, None if lists is None else lists[at]

    parts = max(-(-n // BLOCK_ROWS), -(-n * dim * 8 // BLOCK_BYTES))
    if parts == 1:
        shared = spark.sparkContext.broadcast(read(few.toArrow()))  # BLOCK_BYTES at most
        return dim, lambda: iter([shared.value])
    files = listed(spark, settle(few.repartition(parts), "probes").inputFiles()[0].rpartition("/")[0], ".parquet")

    def opened() -> Iterator[Block]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for file in files:
            system, path = fs.FileSystem.from_uri(file if not file.startswith("file:/") or file.startswith("file://") else "file://" + file.removeprefix("file:"))
            yield read(pq.read_table(path, filesystem=system))

    return dim, opened


def _similarities(a: np.ndarray, rows: np.ndarray, b: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Products of rows of a and b, each summed alone and in one order."""
    out, step = np.empty(len(rows)), max(1, SCORE_BYTES // (16 * max(1, a.shape[1])))
    for lo in range(0, len(rows), step):
        out[lo : lo + step] = (a[rows[lo : lo + step]] * b[cols[lo : lo + step]]).sum(1)
    return out


class _Best:
    """The k best answers of each asker so far, from high to low, lower places first among equals."""

    def __init__(self, askers: int, k: int):
        self.k, self.score, self.place = k, np.full((askers, k), -np.inf), np.full((askers, k), np.iinfo(np.int64).max)

    def add(self, who: np.ndarray, asking: np.ndarray, places: np.ndarray, answers: np.ndarray) -> None:
        """Compare askers `who` with the answers at `places`, a bounded part of the matrix at a time."""
        tall = max(1, min(2048, ANSWERS // (8 * self.k)))
        wide = max(1, SCORE_BYTES // (8 * min(tall, max(1, len(who)))))
        for lo in range(0, len(places), wide):
            for top in range(0, len(who), tall):
                self._part(who[top : top + tall], asking[top : top + tall], places[lo : lo + wide], answers[lo : lo + wide])

    def _part(self, who: np.ndarray, asking: np.ndarray, places: np.ndarray, answers: np.ndarray) -> None:
        score, least = asking @ answers.T, self.score[who, -1]
        if len(places) > self.k and np.isneginf(least).any():
            least = np.maximum(least, np.partition(score, -self.k, axis=1)[:, -self.k])
        rows, cols = np.nonzero(score >= (least - SLACK)[:, None])
        step = max(1, SCORE_BYTES // 64)
        for lo in range(0, len(rows), step):
            self._merge(who, asking, places, answers, rows[lo : lo + step], cols[lo : lo + step])

    def _merge(self, who: np.ndarray, asking: np.ndarray, places: np.ndarray, answers: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> None:
        some, at = np.unique(rows, return_inverse=True)
        mine = who[some]
        at = np.concatenate([np.repeat(np.arange(len(some)), self.k), at])
        score = np.concatenate([self.score[mine].ravel(), _similarities(asking, rows, answers, cols)])
        place = np.concatenate([self.place[mine].ravel(), places[cols]])
        order = np.lexsort((place, -score, at))
        pick = order[np.searchsorted(at[order], np.arange(len(some)))[:, None] + np.arange(self.k)]
        self.score[mine], self.place[mine] = score[pick], place[pick]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Askers, places and similarities."""
        who, at = np.nonzero(self.score > -np.inf)
        return who, self.place[who, at], self.score[who, at]


def _found(stream: DataFrame, vector: str, dim: int, blocks, per_probe: bool, k: int, threshold: float | None) -> DataFrame:
    """Stream rows with __probe and __similarity: all above the threshold, the k best probes of each row, or of each stretch the k best rows of each probe.

    Earlier rows and lower probes come first among equals.  Where the stream has a list as __list, probes meet the rows of their own lists.
    """
    columns = [c for c in stream.columns if c != "__list"]
    at, listed_rows = stream.columns.index(vector), "__list" in stream.columns
    schema = T.StructType([*[stream.schema[c] for c in columns], T.StructField("__probe", T.LongType()), T.StructField("__similarity", T.DoubleType())])
    step = max(1, STRETCH_BYTES // (8 * max(1, dim)))

    def picked(part: pa.RecordBatch, rows: np.ndarray, numbers: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = part.select(columns)
        for lo in range(0, len(rows), step):
            few = slice(lo, lo + step)
            yield pa.RecordBatch.from_arrays([*part.take(pa.array(rows[few])).columns, pa.array(numbers[few].astype(np.int64)), pa.array(score[few])], names=schema.names)

    def nearest_rows(part: pa.RecordBatch, there: np.ndarray, mine: np.ndarray):
        lists = part.column(part.schema.get_field_index("__list")).to_numpy()[there] if listed_rows else None
        for numbers, theirs, looked_at in blocks():
            few = max(1, ANSWERS // k)
            for lo in range(0, len(numbers), few):
                asking, best = theirs[lo : lo + few], _Best(len(theirs[lo : lo + few]), k)
                if lists is None or looked_at is None:
                    best.add(np.arange(len(asking)), asking, np.arange(len(mine)), mine)
                else:
                    for one in np.unique(lists):
                        who, rows = np.flatnonzero((looked_at[lo : lo + few] == one).any(1)), np.flatnonzero(lists == one)
                        best.add(who, asking[who], rows, mine[rows])
                who, rows, score = best.found()
                yield from picked(part, there[rows], numbers[lo + who], score)

    def nearest_probes(part: pa.RecordBatch, there: np.ndarray, mine: np.ndarray):
        few = max(1, ANSWERS // k)
        for lo in range(0, len(mine), few):
            asking, best = mine[lo : lo + few], _Best(len(mine[lo : lo + few]), k)
            for numbers, theirs, _ in blocks():
                best.add(np.arange(len(asking)), asking, numbers, theirs)
            rows, numbers, score = best.found()
            yield from picked(part, there[lo + rows], numbers, score)

    def above(part: pa.RecordBatch, there: np.ndarray, mine: np.ndarray):
        for numbers, theirs, _ in blocks():
            few = max(1, SCORE_BYTES // (8 * max(1, len(numbers))))
            for lo in range(0, len(mine), few):
                score = mine[lo : lo + few] @ theirs.T
                rows, cols = np.nonzero(score >= threshold)
                yield from picked(part, there[rows + lo], numbers[cols], score[rows, cols])

    def stretches(held: list[pa.RecordBatch]):
        for part in pa.Table.from_batches(held).combine_chunks().to_batches():
            there, mine = _usable(part.column(at), dim or None, vector)
            if len(there):
                yield from (above if threshold is not None else nearest_rows if per_probe else nearest_probes)(part, there, mine)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows * max(1, dim) * 8
            if size > STRETCH_BYTES:
                yield from stretches(held)
                held, size = [], 0
        if held:
            yield from stretches(held)

    return stream.mapInArrow(run, schema)


def _joined(stream: DataFrame, probes: DataFrame, vector: str, probe_vector: str, suffix: str, per_probe: bool, k: int, threshold: float | None) -> DataFrame:
    columns, shown = [c for c in stream.columns if c != "__list"], [c for c in probes.columns if c != "__lists"]
    names = {c: c + suffix if c in columns else c for c in shown}
    # Numbers follow the probes' other columns, so that equal similarities rank alike in every run.
    ties = [c for c in shown if c != probe_vector]
    ranked = probes.orderBy(*[F.col(f"`{c}`") for c in ties]) if ties else probes
    numbered = settle(ranked.withColumn("__probe", F.monotonically_increasing_id()), "probes")
    dim, blocks = _blocks(numbered, probe_vector)
    rows, order = _comparable(stream, vector), [F.col(f"`{c}`") for c in columns if c != vector]
    if threshold is None and per_probe and order:
        rows = rows.sortWithinPartitions(*order)
    out = _found(rows, vector, dim, blocks, per_probe, k, threshold)
    if threshold is None and per_probe:
        rank = F.row_number().over(Window.partitionBy("__probe").orderBy(F.desc("__similarity"), *order))
        out = out.withColumn("__rank", rank).where(F.col("__rank") <= k)
    side = numbered.select("__probe", *[F.col(f"`{c}`").alias(names[c]) for c in shown])
    return out.join(side, "__probe").select(*columns, *names.values(), F.col("__similarity").alias("similarity"))


def nearest_to_probes(stream: DataFrame, probes: DataFrame, vector: str, probe_vector: str, k: int = 1, suffix: str = "_probe") -> DataFrame:
    """For each probe its k nearest stream rows: stream columns, probe columns, similarity.

    Vectors that are null, empty or hold a null or non-finite component match nothing; vectors of unequal length are an error that names both lengths.
    """
    return _joined(stream, probes, vector, probe_vector, suffix, True, k, None)


def nearest_in_lists(stream: DataFrame, probes: DataFrame, vector: str, probe_vector: str, k: int = 1, suffix: str = "_probe") -> DataFrame:
    """As `nearest_to_probes`, among the stream rows whose number in __list is one of the probe's array __lists."""
    return _joined(stream, probes, vector, probe_vector, suffix, True, k, None)


def nearest_probes(stream: DataFrame, probes: DataFrame, vector: str, probe_vector: str, k: int = 1, suffix: str = "_probe") -> DataFrame:
    """For each stream row its k nearest probes; vectors as in `nearest_to_probes`."""
    return _joined(stream, probes, vector, probe_vector, suffix, False, k, None)


def within(stream: DataFrame, probes: DataFrame, vector: str, probe_vector: str, threshold: float, suffix: str = "_probe") -> DataFrame:
    """All (stream row, probe) pairs of cosine at least `threshold`; vectors as in `nearest_to_probes`."""
    return _joined(stream, probes, vector, probe_vector, suffix, True, 1, threshold)
