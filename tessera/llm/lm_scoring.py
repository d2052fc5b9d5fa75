"""Language-model scoring with an Elias-Fano n-gram trie.

The trie has a level per n-gram length.  Level 1 is the vocabulary (words by 64-bit hash; a word's id is its rank); an entry of
level k is its parent's place on level k-1 times the vocabulary plus a word's id, so the children of a context are
one ascending run.  Keys and the pointers to those runs are Elias-Fano sequences; discounted relative frequencies and
back-off weights are 16-bit logarithms.  All lies in files of the shared folder, a file per level and shard, which scoring tasks map into memory.

The first word's hash decides the shard of an n-gram.  A word that makes up more of the corpus than a shard does is spread over as many
shards as it would fill, by the hash of the word after it, so that frequent words crowd no task or file.

Counts come from all training texts: tasks count their part, send each shard's keys Elias-Fano coded with their
counts, and one task a shard adds them up.  With more than FAN shards, tasks send FAN bundles instead, which others merge and split by shard,
so that the number of rows sent does not grow with tasks times shards.
Probabilities interpolate absolutely discounted frequencies:
P(w | c) = max(count - D, 0) / total + D * successors / total * P(w | shorter c).
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import arrow_bytes, caches, drop_clashing, hash_spans, mix, new_folder, opened, published, stage, text_slices, word_spans, working
from tessera.llm.elias_fano import EliasFano

ORDER, DISCOUNT, SHARD_BYTES, LEAST_SHARDS = 3, 0.75, 24 << 20, 16
#: Bytes of text of a vectorised step of scoring, where every shard costs some calls, whatever is found there, and of counting.
SLICE, COUNTED = 4 << 20, 2 << 20
#: Shards to which a task sends by itself.
FAN = 256
#: Steps of the 16-bit logarithms, n-grams that a counting task holds before it sends them, and that a building one adds up at once.
STEPS, HELD, MERGED = 4096, 1_000_000, 500_000
ADDED = 0.1
END = mix(np.array([0x454E44], np.uint64))[0]
_EF = ("meta", "lows", "highs", "zeros")
#: Files that a worker keeps open, and bytes of those that cannot be mapped.
OPEN_FILES, HELD_BYTES = 4096, 256 << 20
_open: OrderedDict[str, dict | None] = OrderedDict()
caches("lm", _open.clear)


@dataclass(frozen=True)
class Trie:
    """Where its files lie, its order, the entries of level 1 by shard (a number a shard) and the training tokens."""

    folder: str
    order: int
    words: tuple[int, ...]
    tokens: int

    @property
    def vocabulary(self) -> int:
        return sum(self.words)

    @property
    def shift(self) -> int:
        return 64 - (len(self.words).bit_length() - 1)

    def file(self, level: int | str, shard: int) -> str:
        return f"{self.folder}/{level}-{shard}.trie"


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 8) * 8
    top = json.dumps(head).encode()
    top += b" " * (-(len(top) + 8) % 8)
    with published(uri) as out:
        out.write(len(top).to_bytes(8, "little") + top)
        for a in arrays.values():
            raw = np.ascontiguousarray(a).tobytes()
            out.write(raw + b"\0" * (-len(raw) % 8))


def load(uri: str) -> dict[str, np.ndarray]:
    """A file's arrays, mapped into memory where the shared folder is a mounted one, else read."""
    raw = np.asarray(np.memmap(uri.removeprefix("file://"), np.uint8, "r")) if uri.startswith("file://") else np.frombuffer(opened(uri, "rb").read(), np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + size].tobytes())
    return {k: raw[8 + size + at : 8 + size + at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, n, at) in head.items()}


def _bytes(level: dict | None) -> int:
    return 0 if level is None else level["bytes"]


def _level(uri: str) -> dict | None:
    """A file's arrays and sequences; None where there is no such file, as no n-gram fell into the shard."""
    if uri not in _open:
        try:
            a = load(uri)
        except FileNotFoundError:
            a = None
        out = None
        if a is not None:
            out = {k: v for k, v in a.items() if "." not in k}
            for name in {k.split(".")[0] for k in a if "." in k}:
                out[name] = EliasFano({p: a[f"{name}.{p}"] for p in _EF})
            out["bytes"] = 0 if uri.startswith("file://") else sum(v.nbytes for v in a.values())
        _open[uri] = out
        while len(_open) > OPEN_FILES or len(_open) > 1 and sum(map(_bytes, _open.values())) > HELD_BYTES:
            _open.popitem(last=False)
    _open.move_to_end(uri)
    return _open[uri]


def _coded(name: str, values: np.ndarray, bound: int) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in EliasFano.encode(values, bound).items()}


def logs(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.clip(np.rint(-np.log10(p) * STEPS), 0, 65535).astype(np.uint16)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, an END after each text; and each text's first place (one more at the end)."""
    data, offsets = arrow_bytes(column)
    starts, ends, first = word_spans(data, offsets)
    n = len(offsets) - 1
    out = np.full(len(starts) + n, END, np.uint64)
    out[np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(first))] = hash_spans(data, starts, ends)
    return out, first + np.arange(n + 1)


def _by_shard(sorted_shards: np.ndarray):
    if len(sorted_shards):
        cut = np.concatenate([[0], np.flatnonzero(np.diff(sorted_shards)) + 1, [len(sorted_shards)]])
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield int(sorted_shards[lo]), slice(lo, hi)


def _word_shards(trie: Trie, hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(trie.shift)).astype(np.int64) if len(trie.words) > 1 else np.zeros(len(hashes), np.int64)


def look_up(trie: Trie, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Id (-1: not in training), count and back-off weight (1: none yet) of each word."""
    some, back = np.unique(hashes, return_inverse=True)
    ids, counts, weights = np.full(len(some), -1, np.int64), np.zeros(len(some), np.int64), np.ones(len(some))
    base = np.concatenate([[0], np.cumsum(trie.words)])
    for shard, part in _by_shard(_word_shards(trie, some)):
        if trie.words[shard]:
            level = _level(trie.file(1, shard))
            at = level["keys"].find(some[part] - np.uint64(shard << trie.shift if len(trie.words) > 1 else 0))
            ids[part] = np.where(at >= 0, at + base[shard], -1)
            counts[part] = np.where(at >= 0, level["counts"][np.maximum(at, 0)], 0)
            if trie.order > 1 and (more := _level(trie.file("weights", shard))) is not None:  # none where nothing follows a shard's words
                weights[part] = np.where(at >= 0, 10.0 ** (more["backoffs"][np.maximum(at, 0)] / -float(STEPS)), 1.0)
    return ids[back], counts[back], weights[back]


def _pair_shards(trie: Trie, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shard of the n-grams that begin at each word but the last; words above a shard's share are spread by their follower."""
    shards = len(trie.words)
    spread = np.ceil(np.log2(np.maximum(1.0, counts[:-1] * (shards / max(1, trie.tokens))))).astype(np.uint64)
    spread = np.minimum(spread, np.uint64(shards.bit_length() - 1))
    inside = mix(hashes[1:]) & ((np.uint64(1) << spread) - np.uint64(1))
    return (_word_shards(trie, hashes[:-1]) + inside.astype(np.int64)) & (shards - 1)


def _by_query(shard: np.ndarray, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Order by shard, parent and word."""
    word = word + 1
    a, b = int(parent.max()) + 1, int(word.max()) + 1
    if (int(shard.max()) + 1) * a * b < 1 << 63:
        return np.argsort((shard * a + parent) * b + word)
    return np.lexsort((word, parent, shard))


def _children(trie: Trie, level: int, shard: np.ndarray, parent: np.ndarray, word: np.ndarray):
    """Of parents (words' ids on level 2, else places on the level above) and words: the child's place or -1, its frequency, and the
    parent's back-off weight (1: no child, or level 2, where it lies with the words)."""
    at, rel, weight = np.full(len(parent), -1, np.int64), np.zeros(len(parent)), np.ones(len(parent))
    known = np.flatnonzero(parent >= 0)
    if not len(known):
        return at, rel, weight
    vocabulary = trie.vocabulary
    order = known[_by_query(shard[known], parent[known], word[known])]
    for s, part in _by_shard(shard[order]):
        own = _level(trie.file(level, s))
        if own is None:
            continue
        rows = order[part]
        p, w = parent[rows], word[rows]
        fresh = np.concatenate([[True], (p[1:] != p[:-1]) | (w[1:] != w[:-1])])  # equal queries are made once
        group = np.cumsum(fresh) - 1
        p, w = p[fresh], w[fresh]
        # A context is looked up once, whatever follows it.
        heads = np.concatenate([[True], p[1:] != p[:-1]])
        top = p[heads]
        if level == 2:
            top = own["contexts"].find(top.astype(np.uint64))
        live = np.flatnonzero(top >= 0)
        begin, end = np.zeros(len(top), np.int64), np.zeros(len(top), np.int64)
        begin[live], end[live] = (x.astype(np.int64) for x in own["pointers"].spans(top[live]))
        of = np.cumsum(heads) - 1
        back = None if level == 2 else np.where(begin < end, 10.0 ** (own["backoffs"][np.maximum(top, 0)] / -float(STEPS)), 1.0)[of]
        p, begin, end = top[of], begin[of], end[of]
        found = np.full(len(p), -1, np.int64)
        live = np.flatnonzero((begin < end) & (w >= 0))
        found[live] = own["keys"].find(p[live].astype(np.uint64) * np.uint64(vocabulary) + w[live].astype(np.uint64), begin[live], end[live])
        at[rows] = found[group]
        rel[rows] = np.where(found >= 0, 10.0 ** (own["frequencies"][np.maximum(found, 0)] / -float(STEPS)), 0.0)[group]
        if back is not None:
            weight[rows] = back[group]
    return at, rel, weight


def _ngram_keys(trie: Trie, order: int, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, key, last) of every n-gram of `order` words within a text, 2 at least; all levels below the one above are looked at.

    The key is the place of the n-gram's first words, but for two, times the vocabulary plus the last word's id but one; last is the last word's id.
    On level 2 the key is that of both words and last is 0.
    """
    ids, counts, _ = look_up(trie, hashes)
    shard = _pair_shards(trie, hashes, counts)
    position = ids
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for k in range(2, order - 1):
        n = max(0, len(hashes) - k + 1)
        position = _children(trie, k, shard[:n], np.where(text[:n] == text[k - 1 :], position[:n], -1), ids[k - 1 :])[0]
    n = max(0, len(hashes) - order + 1)
    fine = np.flatnonzero((text[:n] == text[order - 1 :]) & (position[:n] >= 0))
    beside = max(1, order - 2)
    keys = position[fine].astype(np.uint64) * np.uint64(trie.vocabulary) + ids[fine + beside].astype(np.uint64)
    return shard[fine], keys, ids[fine + order - 1] if order > 2 else np.zeros(len(fine), np.int64)


def _in_order(keys: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Order by key, then last."""
    order = np.argsort(keys)
    if not last.any():
        return order
    sorted_keys = keys[order]
    rank = np.cumsum(np.concatenate([[0], sorted_keys[1:] != sorted_keys[:-1]]) if len(keys) else np.zeros(0, np.int64))
    rank <<= 32
    rank |= last[order]
    return order[np.argsort(rank)]  # a vocabulary has fewer than 2 ** 32 words


def _added(keys: np.ndarray, last: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = _in_order(keys, last)
    keys, last = keys[order], last[order]
    begins = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (last[1:] != last[:-1])])) if len(keys) else np.zeros(0, np.int64)
    return keys[begins], last[begins], np.add.reduceat(counts[order], begins, dtype=np.int64) if len(keys) else counts


def _narrow(values: np.ndarray) -> bytes:
    """Compressed whole numbers, in four bytes each if they fit."""
    wide = len(values) and int(values.max()) >= 1 << 32
    return (b"8" if wide else b"4") + zlib.compress(values.astype("<u8" if wide else "<u4").tobytes(), 1)


def _widened(data: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), "<u8" if data[:1] == b"8" else "<u4").astype(kind)


def _packed(shard: int, keys: np.ndarray, last: np.ndarray, counts: np.ndarray) -> dict:
    """A row of partial counts; keys do not fall, and several may be equal."""
    coded = EliasFano.encode(keys, int(keys[-1]) + 1)
    return {"shard": shard, **{k: coded[k].tobytes() for k in ("meta", "lows", "highs")}, "last": _narrow(last), "counts": _narrow(counts)}


_PARTIAL = "shard int, meta binary, lows binary, highs binary, last binary, counts binary"
_PARTIAL_ARROW = pa.schema([("shard", pa.int32()), *[(n, pa.binary()) for n in ("meta", "lows", "highs", "last", "counts")]])
_BUNDLE = "bucket int, part int, shards binary, keys binary, last binary, counts binary"
_BUNDLE_ARROW = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), *[(n, pa.binary()) for n in ("shards", "keys", "last", "counts")]])


class _Held:
    """Counts by (shard, key, last) until they are sent."""

    def __init__(self):
        self.pieces, self.size = [], 0

    def add(self, shard: np.ndarray, key: np.ndarray, last: np.ndarray, count: np.ndarray | None = None) -> None:
        """Equal n-grams are brought together by a hash of them; two that share one by chance may stay apart until they meet in their shard."""
        if not len(key):
            return
        order = np.argsort(mix(key ^ mix(last.astype(np.uint64) + np.uint64(1))))
        shard, key, last = shard.astype(np.uint32)[order], key[order], last.astype(np.uint32)[order]
        fresh = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (last[1:] != last[:-1]) | (shard[1:] != shard[:-1])]))
        count = np.diff(np.append(fresh, len(key))) if count is None else np.add.reduceat(count[order], fresh, dtype=np.int64)
        del order
        self.pieces.append((shard[fresh], key[fresh], last[fresh], count.astype(np.uint32) if int(count.max()) < 1 << 32 else count))
        self.size += len(fresh)

    def taken(self) -> tuple[np.ndarray, ...]:
        """All by shard and key, and added up; nothing stays."""
        whole = _Held()
        columns = [np.concatenate(x) for x in zip(*self.pieces, strict=True)]
        self.pieces, self.size = [], 0
        if columns:
            whole.add(*columns)
            del columns
        if not whole.pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(whole.pieces[0][1])
        shard = whole.pieces[0][0][order]
        order = order[np.argsort(shard.astype(np.uint16) if int(shard.max()) < 1 << 16 else shard, kind="stable")]
        return tuple(x[order] for x in whole.pieces[0])


def _by_shards(held: _Held):
    shard, *rest = held.taken()
    for s, part in _by_shard(shard):
        yield pa.RecordBatch.from_pylist([_packed(s, *[x[part] for x in rest])], schema=_PARTIAL_ARROW)


def _partial_counts(texts: DataFrame, trie: Trie | None, order: int, shards: int) -> DataFrame:
    shift = 64 - (shards.bit_length() - 1)
    wide = shards > FAN
    every = max(1, shards // FAN)

    def bundles(held: _Held):
        shard, key, last, count = held.taken()
        part = int.from_bytes(uuid.uuid4().bytes[:4], "little") % every
        for bucket, at in _by_shard(shard // every):
            keys = zlib.compress(np.diff(key[at], prepend=np.uint64(0)), 1)
            row = {"bucket": bucket, "part": part, "shards": _narrow(shard[at]), "keys": keys, "last": _narrow(last[at]), "counts": _narrow(count[at])}
            yield pa.RecordBatch.from_pylist([row], schema=_BUNDLE_ARROW)

    def run(batches):
        working("lm")
        held = _Held()
        for whole in batches:
            for batch in text_slices(whole, 0, COUNTED):
                hashes, first = tokens(batch.column(0))
                if trie is None:
                    owner = (hashes >> np.uint64(shift)).astype(np.int64) if shards > 1 else np.zeros(len(hashes), np.int64)
                    held.add(owner, hashes - (owner.astype(np.uint64) << np.uint64(shift)) if shards > 1 else hashes, np.zeros(len(hashes), np.int64))
                else:
                    held.add(*_ngram_keys(trie, order, hashes, first))
                if held.size > HELD:
                    yield from (bundles if wide else _by_shards)(held)
        if held.size:
            yield from (bundles if wide else _by_shards)(held)

    if not wide:
        return texts.mapInArrow(run, _PARTIAL)

    def split(batches):
        held, at = _Held(), None
        for batch in batches:
            for row in batch.to_pylist():
                if held.size and (at != (row["bucket"], row["part"]) or held.size > HELD):
                    yield from _by_shards(held)
                at = row["bucket"], row["part"]
                keys = np.cumsum(np.frombuffer(zlib.decompress(row["keys"]), "<u8"), dtype=np.uint64)
                held.add(_widened(row["shards"]), keys, _widened(row["last"]), _widened(row["counts"]))
        if held.size:
            yield from _by_shards(held)

    return texts.mapInArrow(run, _BUNDLE).repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(split, _PARTIAL)


def _counts_of(trie: Trie, ids: np.ndarray) -> np.ndarray:
    """Counts of words by ascending id."""
    base = np.concatenate([[0], np.cumsum(trie.words)])
    out = np.zeros(len(ids), np.int64)
    for s, part in _by_shard(np.searchsorted(base, ids, "right") - 1):
        out[part] = _level(trie.file(1, s))["counts"][ids[part] - base[s]]
    return out


def _built(partial: DataFrame, trie: Trie, level: int) -> DataFrame:
    """Adds up each shard's counts and writes its file; (shard, entries, total), and of level 2 also (word, kinds): successors in the shard."""
    vocabulary, shards = trie.vocabulary, len(trie.words)

    def written(shard: int, keys: np.ndarray, last: np.ndarray, counts: np.ndarray):
        tops, kinds = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if level == 1:
            arrays = _coded("keys", keys, int(keys[-1]) + 1) | {"counts": counts.astype(np.int64)}
        else:
            if level > 2:  # the contexts' places, and from them the keys
                fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
                above, word = keys[fresh] // np.uint64(vocabulary), keys[fresh] % np.uint64(vocabulary)
                steps = range(0, len(above), MERGED)
                places = np.concatenate([_children(trie, level - 1, np.full(len(a), shard), a, w)[0] for a, w in ((x[lo : lo + MERGED].astype(np.int64) for x in (above, word)) for lo in steps)])
                if (places < 0).any():
                    raise RuntimeError(f"shard {shard} of level {level - 1} lacks contexts of level {level}")
                keys = places[np.cumsum(fresh) - 1].astype(np.uint64) * np.uint64(vocabulary) + last
                del above, word, places, fresh, last
                order = np.argsort(keys)
                keys, counts = keys[order], counts[order]
                del order
            parents = (keys // np.uint64(vocabulary)).astype(np.int64)
            if level == 2:  # all that follows a word in training is counted with the word itself
                tops, parents = np.unique(parents, return_inverse=True)
                keys = keys - tops[parents].astype(np.uint64) * np.uint64(vocabulary) + parents.astype(np.uint64) * np.uint64(vocabulary)
                n, total = len(tops), _counts_of(trie, tops)
            else:
                n = _level(trie.file(level - 1, shard))["keys"].n
                total = np.bincount(parents, counts, n)
            kinds = np.bincount(parents, minlength=n)
            arrays = _coded("keys", keys, int(keys[-1]) + 1) | _coded("pointers", np.concatenate([[0], np.cumsum(kinds)]), len(keys) + 1)
            arrays |= {"frequencies": logs(np.maximum(counts - DISCOUNT, 1e-9) / total[parents])}
            if level == 2:
                arrays |= _coded("contexts", tops, int(tops[-1]) + 1)
            else:
                arrays |= {"backoffs": logs(np.where(kinds > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0))}
                kinds = kinds[:0]
        save(trie.file(level, shard), arrays)
        one = pa.nulls(len(tops), pa.int64())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "entries": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64()), "word": pa.nulls(1, pa.int64()), "kinds": pa.nulls(1, pa.int64())})
        if len(tops):
            yield pa.RecordBatch.from_pydict({"shard": one.cast(pa.int32()), "entries": one, "total": one, "word": pa.array(tops), "kinds": pa.array(kinds.astype(np.int64))})

    def run(batches):
        working("lm")
        shard, parts, fresh = None, [], 0

        def folded():
            """All parts as one."""
            nonlocal fresh
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            parts.clear()
            parts.append(_added(*columns))
            fresh = 0

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if parts and row["shard"] != shard:
                    folded()
                    yield from written(shard, *parts.pop())
                shard = row["shard"]
                coded = EliasFano({"meta": np.frombuffer(row["meta"], np.int64), "lows": np.frombuffer(row["lows"], np.uint64), "highs": np.frombuffer(row["highs"], np.uint64), "zeros": np.zeros(1, np.uint32)})
                parts.append((coded.all(), _widened(row["last"], np.uint32), _widened(row["counts"], np.uint32 if row["counts"][:1] == b"4" else np.int64)))
                fresh += coded.n
                if fresh > max(MERGED, len(parts[0][0]) // 2):  # half as many again as there are
                    folded()
        if parts:
            folded()
            yield from written(shard, *parts.pop())

    return stage(partial.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, "shard int, entries long, total long, word long, kinds long"), "trie")


def _weighted(trie: Trie, kinds: DataFrame) -> None:
    """Write the back-off weights of the words, from (word, kinds) rows: a file for each shard of level 1."""
    base = np.concatenate([[0], np.cumsum(trie.words)])
    sums = kinds.groupBy("word").agg(F.sum("kinds").alias("kinds"))

    def located(batches):
        for batch in batches:
            word = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array((np.searchsorted(base, word, "right") - 1).astype(np.int32)), batch.column(0), batch.column(1)], names=["shard", "word", "kinds"])

    def run(batches):
        shard, weights = None, None

        def written():
            save(trie.file("weights", shard), {"backoffs": logs(weights)})
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32())})

        for batch in batches:
            own, word, n = (batch.column(i).to_numpy() for i in range(3))
            for s, part in _by_shard(own):
                if s != shard:
                    if shard is not None:
                        yield written()
                    shard, weights, counts = s, np.ones(trie.words[s]), _level(trie.file(1, s))["counts"]
                at = word[part] - base[s]
                weights[at] = DISCOUNT * n[part] / counts[at]
        if shard is not None:
            yield written()

    rows = sums.mapInArrow(located, "shard int, word long, kinds long")
    stage(rows.repartition(len(trie.words), "shard").sortWithinPartitions("shard").mapInArrow(run, "shard int"), "weights")


def train(df: DataFrame, text: str = "text", order: int = ORDER) -> Trie:
    """Build the trie from all of df's texts (null: empty).  Its size, and what is shuffled, grow with the text.

    Texts are counted whole; repeated rows count as often as they are there; an empty table gives a model without words.
    """
    texts = df.select(F.col(f"`{text}`").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 << max(LEAST_SHARDS.bit_length() - 1, (size // SHARD_BYTES).bit_length())
    trie = Trie(new_folder(df.sparkSession, "lm"), 1, (0,) * shards, 0)
    made = {r["shard"]: r for r in _built(_partial_counts(texts, None, 1, shards), trie, 1).where("shard is not null").collect()}  # a row a shard
    trie = Trie(trie.folder, 1, tuple(made[s]["entries"] if s in made else 0 for s in range(shards)), sum(r["total"] for r in made.values()))
    for level in range(2, order + 1):
        built = _built(_partial_counts(texts, trie, level, shards), trie, level)
        if level == 2 and trie.tokens:
            _weighted(trie, built.where("word is not null").select("word", "kinds"))
        trie = Trie(trie.folder, level, trie.words, trie.tokens)
    return trie


def scores(trie: Trie, column: pa.Array) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base_score, score of each text."""
    hashes, first = tokens(column)
    ids, counts, weight = look_up(trie, hashes)
    single = (counts + ADDED) / (trie.tokens + ADDED * (trie.vocabulary + 1))
    p = single.copy()
    position, shard = ids, _pair_shards(trie, hashes, counts)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for k in range(2, trie.order + 1):
        n = max(0, len(hashes) - k + 1)
        if not n:
            break
        inside = text[:n] == text[k - 1 :]
        position, rel, own = _children(trie, k, shard[:n], np.where(inside, position[:n], -1), ids[k - 1 :])
        if k == 2:
            own = np.where(inside, weight[:n], 1.0)
        p[k - 1 :] = rel + own * p[k - 1 :]
    add = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else np.zeros(0)
    return np.diff(first), add((counts > 0).astype(np.int64)), add(np.log10(single)), add(np.log10(p))


def score(df: DataFrame, trie: Trie, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns (all but the text and clashing ones by default), then n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is its end alone; texts of any length are scored whole.  With an empty model every token has probability 1.
    Repeated rows come out alike, an empty table gives no rows, and a kept column named as an output is replaced.
    """
    outputs = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = [c for c in drop_clashing(df, outputs).columns if c != text] if keep is None else keep
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    shared = df.sparkSession.sparkContext.broadcast(trie)  # two numbers a shard
    names = [*keep, *outputs]

    def run(batches):
        working("lm")
        own = shared.value
        for whole in batches:
            for batch in text_slices(whole, len(keep), SLICE):
                n, known, base, full = scores(own, batch.column(len(keep)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), own.tokens)), pa.array(base), pa.array(full)], names=names)

    kinds = [T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *[T.StructField(n, k) for n, k in zip(names[len(keep) :], kinds, strict=True)]]))
