"""Near-duplicate documents by a chosen-path set similarity join.

A document is its set of word shingles.  Equal sets are one entity from the start.  In each of TREES
independent trees, entities branch on minwise values at one or two coordinates that the path chooses
(4/3 on average, one over the least similarity).  Small nodes are then compared exhaustively: entities whose sketches
agree enough are candidates, and every candidate link is confirmed on the full shingle sets.

Links need not all be listed to find components, so settled work is left out early:

1. Each entity of a first-level node finds the one that resembles it most, in blocks of LEAF entities where the node is
   larger, and is tied to the best NEAREST of them.  These are few pairs however large a group of copies is, and confirmed ones make components.
2. A node whose entities are all in one component is done.  A node is small if its pairs across components are at most
   LEAF / 2 for each of its entities: it has at most LEAF entities, or all but LEAF are in one component.
   Other nodes branch again, down to DEPTH, on further minwise values, which only their entities need.
3. Every pair of a small or deepest node that is still in different components is compared, block against block, so that a task
   holds two blocks at most and no pair is lost.

A pair at the least similarity misses one tree with a chance of 0.188, 0.324, 0.428 or 0.509 at depth 1 to 4.  Trees and levels share
no minwise value, so seventeen leave 1.1e-5 unseen at depth 4 (5.5e-7 at depth 3); the sketch filter misses one with
a chance under 1e-5.  Nodes that stop branching early only raise these chances of being seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import arrow_bytes, hash_spans, mix, shingle_hashes, stage, text_slices, word_spans, working
from tessera.llm.components import components

WIDTH, TREES, LEAF, DEPTH, BLOCK = 5, 17, 256, 4, 1024
#: Bytes of text of a vectorised step; a longer text is a step of its own.
SLICE = 512 << 10
#: Minwise values of a set: two for each tree and level, shared with no other.  A node's low five bits are its tree.
LEVEL = 2 * TREES
COORDS = LEVEL * DEPTH
_TREE = np.uint64(31)
#: Trees whose large first-level nodes are searched for nearest partners; others find theirs across components only.
NEAR_TREES = 8
#: Partners of an entity to confirm at first, the most similar ones of all its nodes; step 3 compares with all others.
NEAREST = 3
#: Tasks that share a node's rows where counts are joined to them.
SALTS = 4
#: A sketch has the least hash of each of BINS ranges of hashes, in four bits (0: none).  A candidate's similarity as
#: the sketches estimate it is at most DEVIATIONS standard deviations below the least similarity.
BINS, LEAST, DEVIATIONS = 512, 0.75, 4.5
_RNG = np.random.Generator(np.random.PCG64(8))
_MUL = _RNG.integers(1, 1 << 62, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 62, COORDS, dtype=np.uint64)


def shingle_sets(batch_column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = arrow_bytes(batch_column)
    starts, ends, first = word_spans(data, offsets)
    words = hash_spans(data, starts, ends)
    return [np.unique(shingle_hashes(words[a:b], width)) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _identity(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit id of each set; 0 for an empty one."""
    sums = np.zeros((2, len(sets)), np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            sums[0, i] = mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
            sums[1, i] = mix(s + np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
    sizes = np.array([len(s) for s in sets], np.uint64)
    out = np.where(sizes > 0, mix(sums[0] * np.uint64(31) + mix(sums[1] + sizes)), np.uint64(0))
    return out.view(np.int64)


def minwise(sets: list[np.ndarray], level: int) -> np.ndarray:
    """The level's minwise values of non-empty sets, two a tree."""
    flat = np.concatenate(sets)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.empty((len(sets), LEVEL), np.uint32)
    for k in range(LEVEL):
        at = level * LEVEL + k
        out[:, k] = np.minimum.reduceat(((flat * _MUL[at] + _ADD[at]) >> np.uint64(32)).astype(np.uint32), begin)
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The sketch of each non-empty set, two ranges a byte."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bins = (flat >> np.uint64(55)).astype(np.int64)
    least = np.concatenate([[True], (bins[1:] != bins[:-1]) | (owner[1:] != owner[:-1])])  # sets are sorted
    sketch = np.zeros((len(sets), BINS), np.uint8)
    sketch[owner[least], bins[least]] = (flat[least] >> np.uint64(40)) % np.uint64(15) + np.uint64(1)
    return sketch[:, ::2] | sketch[:, 1::2] << 4


def alike(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of each pair of sketches of sets of the given sizes, and whether the pair is a candidate.

    Of the ranges that either set fills, those where the least hash is in both agree; another fifteenth of the rest that
    both fill agrees by chance and is taken off.  The ranges are a sample of the union without replacement.
    """
    if len(a) * len(b) <= 4096:
        same = ((a[:, None, :] == b[None, :, :]) & (a > 0)[:, None, :]).sum(2)
    else:
        same = np.zeros((len(a), len(b)), np.uint16)
        for k in range(BINS):
            same += (a[:, k][:, None] == b[:, k][None, :]) & (a[:, k] > 0)[:, None]
    fa, fb = (a > 0).astype(np.float32), (b > 0).astype(np.float32)
    both = fa @ fb.T
    either = fa.sum(1)[:, None] + fb.sum(1)[None, :] - both
    share = (same - both / 15) * 15 / 14 / either
    union = (n_a[:, None] + n_b[None, :]) / (1 + LEAST)
    left = np.maximum(0.1, 1 - either / np.maximum(union, 1))
    spread = np.sqrt(LEAST * (1 - LEAST) / either * left + (1 - LEAST) / 15 / either)
    sizes = 4 * np.minimum(n_a[:, None], n_b[None, :]) >= 3 * np.maximum(n_a[:, None], n_b[None, :])
    return share, sizes & (share >= LEAST - DEVIATIONS * spread)



_SET_TYPES = "rid long, sid long, n long, sig binary, sketch binary"


def entities(df: DataFrame, key: str, text: str, keep: list[str]) -> DataFrame:
    """(key, text, kept columns as `rest`, rid, sid, n, sig, sketch) of each row: a number of the row, and id, size, first-level
    minwise values and sketch of its shingle set; sid 0 and no values for empty sets.

    Row numbers hold for one evaluation: the caller writes the rows and reads them back.
    """
    columns = [F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")]
    if keep:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("rest"))
    rows = df.select(*columns)
    more = T.StructType.fromDDL(_SET_TYPES)

    def run(batches):
        working("minhash")
        number = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in text_slices(whole, 1, SLICE):
                sets = shingle_sets(batch.column(1))
                full = [s for s in sets if len(s)]
                sizes = np.array([len(s) for s in sets], np.int64)
                values: list = [[None] * len(sets), [None] * len(sets)]
                if full:
                    for column, found in zip(values, (minwise(full, 0), sketches(full)), strict=True):
                        for i, row in zip(np.flatnonzero(sizes).tolist(), found, strict=True):
                            column[i] = row.tobytes()
                rid = np.arange(number, number + len(sets), dtype=np.int64)
                number += len(sets)
                own = [pa.array(rid), pa.array(_identity(sets)), pa.array(sizes), *[pa.array(v, pa.binary()) for v in values]]
                yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, *more.names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *more.fields]))


def _children(sig: np.ndarray, path: np.ndarray, level: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) of each row of signatures at its path: one of the level's two coordinates, both for a third of the paths.

    The rows of sig hold coordinates from `skip` on.
    """
    draw = mix(path ^ np.uint64(level * 2 + 1))
    pair = level * LEVEL - skip + 2 * (path & _TREE).astype(np.int64)
    turn = (draw & np.uint64(1)).astype(np.int64)
    twice = (draw >> np.uint64(40)) % np.uint64(3) == 0
    rows = np.arange(len(path))
    picked, at = np.concatenate([rows, rows[twice]]), np.concatenate([pair + turn, (pair + 1 - turn)[twice]])
    child = mix(path[picked] ^ mix(sig[picked, at].astype(np.uint64) + ((at + skip).astype(np.uint64) << np.uint64(33)) + np.uint64(1 << 40)))
    return picked, (child & ~_TREE) | (path[picked] & _TREE)


def _root_paths() -> np.ndarray:
    trees = np.arange(TREES, dtype=np.uint64)
    return (mix((trees + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) & ~_TREE) | trees


def _table(column: pa.Array, width: int) -> np.ndarray:
    data, offsets = arrow_bytes(column)
    return np.ascontiguousarray(data).reshape(len(offsets) - 1, width)


def _values(column: pa.Array) -> np.ndarray:
    return _table(column, 4 * LEVEL).view(np.uint32)


def _sketches(column: pa.Array) -> np.ndarray:
    packed = _table(column, BINS // 2)
    out = np.empty((len(packed), BINS), np.uint8)
    out[:, ::2], out[:, 1::2] = packed & 15, packed >> 4
    return out


def _roots(reps: DataFrame) -> DataFrame:
    roots = _root_paths()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sid, sig = batch.column(0).to_numpy(), _values(batch.column(1))
                for root in roots:
                    picked, node = _children(sig, np.full(len(sid), root), 0)
                    yield pa.RecordBatch.from_arrays([pa.array(sid[picked]), pa.array(node.view(np.int64))], names=["sid", "node"])

    return reps.select("sid", "sig").mapInArrow(run, "sid long, node long")


def deeper_values(texts: DataFrame) -> DataFrame:
    """(sid, sig): the minwise values of the levels after the first, of texts (sid, text)."""

    def run(batches):
        working("minhash")
        for whole in batches:
            for batch in text_slices(whole, 1, SLICE):
                sets = shingle_sets(batch.column(1))
                if sets:
                    sig = np.concatenate([minwise(sets, level) for level in range(1, DEPTH)], axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in sig], pa.binary())], names=["sid", "sig"])

    return texts.mapInArrow(run, "sid long, sig binary")


def _branched(rows: DataFrame, values: DataFrame, level: int) -> DataFrame:
    """(sid, comp, node): the children of rows (sid, comp, node), by the level's minwise values."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sid, comp, node = (batch.column(i).to_numpy() for i in range(3))
                sig = _table(batch.column(3), 4 * LEVEL * (DEPTH - 1)).view(np.uint32)
                picked, child = _children(sig, node.view(np.uint64), level, LEVEL)
                yield pa.RecordBatch.from_arrays([pa.array(sid[picked]), pa.array(comp[picked]), pa.array(child.view(np.int64))], names=["sid", "comp", "node"])

    return rows.join(values, "sid").select("sid", "comp", "node", "sig").mapInArrow(run, "sid long, comp long, node long")


def _with_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows and the facts of their nodes; a node's rows are shared by SALTS tasks."""
    salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("sid"), F.lit(SALTS)).cast("int")).join(salted, ["node", "salt"]).drop("salt")


def _grouped(batches, width: int):
    """The rows of each run of equal first columns, as numpy columns, the last the sketches; runs may cross batches."""
    held: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)] + [_sketches(batch.column(width))]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(cols[0])) + 1, [batch.num_rows]])
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            piece = tuple(c[lo:hi] for c in cols)
            if held and held[-1][0][0] != piece[0][0]:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True)) if len(held) > 1 else held[0]
                held = []
            held.append(piece)
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True)) if len(held) > 1 else held[0]


def _flushed(found, names: tuple[str, ...], size: int = 50_000):
    """Batches of about `size` rows of the columns that `found` gives piece by piece."""
    held: list = []
    n = 0
    for piece in found:
        held.append(piece)
        n += len(piece[0])
        if n >= size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)


def _ordered_pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def nearest_pairs(live: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): each entity with the NEAREST best of those that it agrees with most in its nodes (in a block of LEAF of a larger one)."""
    blocks = F.ceil(F.col("c") / LEAF)
    salt = F.pmod(F.xxhash64("sid", "node"), blocks)
    tree = F.col("node").bitwiseAND(F.lit(int(_TREE)))
    rows = live.where((F.col("c") <= LEAF) | (tree < NEAR_TREES)).select(F.xxhash64("node", salt).alias("unit"), "sid")
    rows = rows.join(reps.select("sid", "n", "sketch"), "sid").select("unit", "sid", "n", "sketch").repartition("unit").sortWithinPartitions("unit", "sid")

    def compared(batches):
        working("minhash")
        for _, sid, n, sketch in _grouped(batches, 3):
            for lo in range(0, len(sid), BLOCK):
                part = slice(lo, lo + BLOCK)
                share, candidate = alike(sketch[part], n[part], sketch, n)
                share = np.where(candidate & (sid[part, None] != sid[None, :]), share, -1)
                best = share.argmax(1)
                most = share[np.arange(len(best)), best]
                good = np.flatnonzero(most >= 0)
                if len(good):
                    yield sid[part][good], sid[best[good]], most[good].astype(np.float64)

    found = rows.mapInArrow(lambda b: _flushed(compared(b), ("a", "b", "share")), "a long, b long, share double")
    best = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("share")).alias("less"), "b"))), 1, NEAREST)  # of a few nodes a tree
    return _ordered_pairs(found.groupBy("a").agg(F.explode(best).alias("best")).select("a", "best.b"))


def open_nodes(live: DataFrame, comp: DataFrame, texts: DataFrame) -> DataFrame:
    """(sid, comp, node, c, top): the small and deepest nodes with two components or more; c counts the node's entities,
    top is its largest component if c is above LEAF and all but about LEAF are in it.

    live: (sid, node) of the first level; comp: (node, component); texts: (sid, text) of those in large nodes, at least.
    """
    found = live.join(comp.select(F.col("node").alias("sid"), "component"), "sid", "left")
    rows, done = found.select("sid", F.coalesce("component", "sid").alias("comp"), "node"), None
    for level in range(DEPTH):
        per = rows.groupBy("node", "comp").agg(F.count("*").alias("m"))
        sums = per.groupBy("node").agg(F.sum("m").alias("c"), F.sum(F.col("m") * F.col("m")).alias("squares"), F.count("*").alias("k"), F.max_by("comp", "m").alias("most"))
        few = F.col("c") * F.col("c") - F.col("squares") <= F.col("c") * LEAF
        facts = sums.where("k > 1").select("node", "c", F.when(F.col("c") <= LEAF, F.lit(None)).when(few, F.col("most")).alias("top"), (few | (F.col("c") <= LEAF)).alias("small"))
        mixed = stage(_with_facts(rows, facts).select("sid", "comp", "node", "c", "top", "small"), "nodes")
        last = level == DEPTH - 1
        settled = (mixed if last else mixed.where("small")).drop("small")
        done = settled if done is None else done.unionByName(settled)
        large = mixed.where("not small")
        if last or not large.take(1):
            return done
        if not level:
            values = stage(deeper_values(texts.join(large.select("sid").distinct(), "sid", "left_semi").select("sid", "text")), "values")
        rows = _branched(large.select("sid", "comp", "node"), values, level + 1)


def cross_pairs(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): all candidate pairs of a node of `open_nodes` that lie in different components, each in one node alone.

    A large node with a top component compares the others with each of its blocks; any other large node compares block against block.
    A row knows all nodes of its entity (a few a tree), so that a pair is given by the first of the nodes that it shares.
    """
    places = rows.groupBy("sid").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    facts = reps.select("sid", "n", "sketch").join(places, "sid")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("sid"), blocks).cast("int")
    place = lambda low, high, side: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), side.cast("int").alias("side"))
    every = F.sequence(F.lit(0), blocks - 1)
    beside = F.transform(every, lambda o: place(F.least(own, o), F.greatest(own, o), F.when(own == o, 2).otherwise((own > o).cast("int"))))
    others = F.concat(F.transform(every, lambda o: place(F.lit(-1), o, F.lit(0))), F.array(place(F.lit(-2), F.lit(0), F.lit(2))))
    at = F.when(F.col("top").isNull(), beside).when(F.col("top") == F.col("comp"), F.array(place(F.lit(-1), own, F.lit(1)))).otherwise(others)
    dealt = rows.select("sid", "comp", "node", F.explode(at).alias("at"))
    unit: Column = F.xxhash64("node", "at.low", "at.high")
    dealt = dealt.select(unit.alias("unit"), "node", "sid", "comp", F.col("at.side").alias("side")).join(facts, "sid")
    dealt = dealt.select("unit", "node", "sid", "comp", "side", "n", "nodes", "sketch").repartition("unit").sortWithinPartitions("unit", "sid")

    def compared(batches):
        working("minhash")
        for _, node, sid, comp, side, n, nodes, sketch in _grouped(batches, 7):
            if side[0] == 2:
                x = y = np.arange(len(sid))
            else:
                x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            for lo in range(0, len(x), 256):
                part = x[lo : lo + 256]
                apart = comp[part][:, None] != comp[y][None, :]
                if side[0] == 2:
                    apart &= sid[part][:, None] < sid[y][None, :]
                if apart.any():
                    i, j = np.nonzero(apart & alike(sketch[part], n[part], sketch[y], n[y])[1])
                    i, j = part[i], y[j]
                    first = np.array([np.intersect1d(nodes[p], nodes[q], assume_unique=True)[0] == node[0] for p, q in zip(i.tolist(), j.tolist(), strict=True)], bool)
                    if first.any():
                        yield sid[i[first]], sid[j[first]]

    return _ordered_pairs(dealt.mapInArrow(lambda b: _flushed(compared(b), ("a", "b")), "a long, b long"))


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v) of the pairs whose full sets have 100 * intersection >= 75 * union.  texts: (sid, text)."""
    rows = pairs.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("sid").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches):
        working("minhash")
        last: tuple = (None, None)
        for whole in batches:
            for batch in text_slices(whole, 2, SLICE):
                ids, others = batch.column(0).to_numpy(), shingle_sets(batch.column(3))
                keep = []
                for i in range(batch.num_rows):
                    if last[0] != ids[i]:
                        last = ids[i], shingle_sets(batch.column(2).slice(i, 1))[0]
                    x, y = last[1], others[i]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= 75 * (len(x) + len(y) - both))
                keep = np.array(keep, bool)
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(batch.column(1).to_numpy()[keep])], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def _classes(seen: DataFrame) -> DataFrame:
    """(sid, component_id, first): of each non-empty set the smallest key and the first row of its component.

    First is the row of the smallest key, rows without key coming last, and of the lowest row number among equal ones.
    """
    order = F.struct(F.col("key").isNull().alias("none"), "key", "rid")
    full = seen.where("n > 0").select("key", "rid", "sid", "n", "sig", "sketch")
    reps = stage(full.groupBy("sid").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"), F.min(order).alias("least")), "sets")

    rows = _roots(reps)
    live = stage(_with_facts(rows, rows.groupBy("node").agg(F.count("*").alias("c")).where("c > 1")).select("sid", "node", "c"), "nodes")
    first = stage(nearest_pairs(live, reps), "pairs")
    # Whoever has a candidate anywhere has one in `first` or lies in a large node, so these are all texts that will be needed.
    used = first.select(F.col("a").alias("sid")).unionByName(first.select(F.col("b").alias("sid"))).unionByName(live.where(F.col("c") > LEAF).select("sid"))
    wanted = reps.join(used.distinct(), "sid", "left_semi").select("sid", F.col("least.rid").alias("rid"))
    texts = stage(seen.select("rid", "text").join(wanted, "rid").select("sid", "text"), "texts")
    links = stage(confirmed(first, texts), "links")
    comp = stage(components(links), "components")
    mixed = open_nodes(live.select("sid", "node"), comp, texts)
    more = stage(cross_pairs(mixed, reps).join(first, ["a", "b"], "left_anti"), "pairs")
    if more.take(1):
        comp = stage(components(links.unionByName(stage(confirmed(more, texts), "links"))), "components")
    named = reps.join(comp, reps.sid == comp.node, "left").select(reps.sid, "least", F.coalesce(comp.component, reps.sid).alias("comp"))
    least = named.groupBy("comp").agg(F.min("least").alias("least"))
    return named.select("sid", "comp").join(least, "comp").select("sid", F.col("least.key").alias("component_id"), F.col("least.rid").alias("first"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (smallest key of the linked documents), kept; one row for each input row.

    Null and empty texts have no shingles and link with nothing; very long texts are taken whole, each as a step of its own.
    Rows are told apart by themselves, not by key: rows that share a key, whatever their texts, and rows without key are linked by their
    texts like any others.  Repeated rows share a component and are kept or not together.  A component
    in which no row has a key has no id; its first row is kept.  Ties do not arise: every link counts.
    Keys may be of any ordered type; other columns, whatever their names, are not looked at.  An empty table gives no rows.
    """
    seen = stage(entities(df, key, text, []), "entities")
    rows = seen.select("key", "rid", "sid", "n")
    full = rows.where("n > 0").join(_classes(seen), "sid")
    kept = F.when(F.col("component_id").isNull(), F.col("rid") == F.col("first")).otherwise(F.col("key").eqNullSafe(F.col("component_id")))
    name = F.col("key").alias(key)
    linked = full.select(name, F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
    return linked.unionByName(rows.where("n = 0").select(name, F.col("n").alias("n_shingles"), F.col("key").alias("component_id"), F.lit(True).alias("kept")))


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df's rows, one of each group of linked documents: the one of the smallest key, rows without key coming last.

    Of rows with the same key and the same words one stays; rows of the same key and different texts stay apart.  Rows without a word all stay.
    """
    others = [c for c in df.columns if c not in (key, text)]
    seen = stage(entities(df, key, text, others), "entities")
    firsts = _classes(seen).select(F.col("first").alias("rid")).distinct()
    rows = seen.where("n > 0").join(firsts, "rid", "left_semi").unionByName(seen.where("n = 0"))
    at = {key: F.col("key"), text: F.col("text")} | {c: F.col("rest").getField(c) for c in others}
    return rows.select(*[at[c].alias(c) for c in df.columns])
