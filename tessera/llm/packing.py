"""Best-fit packing of tokenised documents into sequences by exact-complement hashing.

Which documents have a length does not matter to a packing, so it is planned on counts by length, of which there
are at most `capacity`.  An index holds, for each sum, the pairs of lengths that make it and the longest members of triples that do.
The longest length left opens a sequence; its gap is looked up among single lengths, pairs and triples
under the counts still available, and the combination is used as often as they allow.  Counts only fall, so entries that
they no longer cover leave the index for good.
Where nothing fills the gap exactly, the longest length that fits goes in and the smaller gap is looked up.

Documents then take the plan's slots by their rank within their length.  Ranks come from counts by
(length, salt) and row numbers within, so a length that a third of the documents have is spread out.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import arrow_bytes, caches, hash_spans, stage, text_slices, working

CAPACITY, SEPARATOR = 2048, 0
#: Bytes of a text that are split into words at once, and words whose ids a worker remembers.
SEGMENT, REMEMBERED = 2 << 20, 150_000
_RANK = 1 << 40
_classes: list[np.ndarray] = []
_CUT = re.compile(r"(?<=\S) (?=\S)")
# Fixed value: the public byte-level BPE pre-tokenisation pattern.
PATTERN = regex.compile(r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def _class_table() -> np.ndarray:
    """Of each code point: 0 other, 1 letter, 2 number, 3 white space, 4 the plain space."""
    if not _classes:
        table = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind in "LN":
                table[c] = 1 if kind == "L" else 2
        # Unicode's white space.
        table[[9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B)]] = 3
        table[32] = 4
        _classes.append(table)
    return _classes[0]


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next unused from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceTokenizer:
    """Ids of texts, by one lookup a distinct word of a chunk instead of one run of the tokenizer a word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        self.young: dict[int, bytes] = {}
        self.old: dict[int, bytes] = {}
        self.merges = self._ranked(path)

    @staticmethod
    def _ranked(path: str):
        """The same merges for the faster library, where the file is plain byte-level BPE with ids in merge order; else None."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
        made = [model["vocab"].get(a + b, -1) for a, b in pairs]
        to_byte = {c: b for b, c in _byte_letters().items()}
        own = {t: i for t, i in model["vocab"].items() if all(c in to_byte for c in t)}
        if model.get("type", "BPE") != "BPE" or model.get("byte_fallback") or not made or min(made) < 256 or made != sorted(set(made)) or len(own) < len(made) + 256:
            return None
        import tiktoken

        merged = set(made)
        ranks = {bytes(to_byte[c] for c in t): i for t, i in own.items() if len(t) == 1 or i in merged}
        return tiktoken.Encoding("words", pat_str=PATTERN.pattern, mergeable_ranks=ranks, special_tokens={})

    def _known(self, key: int) -> bytes | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.young[key] = found
        return found

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encoded(self, words: list[str]) -> list[bytes]:
        if self.merges is not None:
            return [array("I", self.merges.encode_ordinary(w)).tobytes() for w in words]
        out = []
        for lo in range(0, len(words), 4096):  # encodings are bulky while they live
            out += [np.array(e.ids, np.uint32).tobytes() for e in self.own.encode_batch_fast(words[lo : lo + 4096], add_special_tokens=False)]
        return out

    def _starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether each code point begins a word of PATTERN; first: the texts' first code points.  Not for apostrophes."""
        kind = _class_table()[points]
        blank = kind >= 3
        before = np.empty_like(kind)
        before[1:] = kind[:-1]
        before[:1] = 9
        opening = np.zeros(len(points) + 1, bool)
        opening[first] = True
        before[opening[:-1]] = 9
        solid_next = np.zeros(len(points), bool)
        solid_next[:-1] = ~blank[1:] & ~opening[1:-1]
        was_blank = (before == 3) | (before == 4)
        return np.where(blank, ~was_blank | solid_next, (before != kind) & (before != 4))

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, and the ids of each text."""
        text = data.tobytes().decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        doc_first = np.searchsorted(at, offsets)
        begins = self._starts(points, doc_first[:-1][doc_first[:-1] < len(points)])
        plain = np.ones(len(offsets) - 1, bool)
        tick = np.flatnonzero(points == 39)
        plain[np.searchsorted(doc_first, tick, "right") - 1] = False
        special = np.zeros(len(plain), bool)
        for token in self.special:
            if token in text:
                for m in re.finditer(re.escape(token), text):
                    special[np.searchsorted(doc_first, m.start(), "right") - 1] = True
        for i in np.flatnonzero(~plain & ~special):  # apostrophes need the pattern itself
            lo, hi = int(doc_first[i]), int(doc_first[i + 1])
            begins[lo:hi] = False
            begins[[lo + m.start() for m in PATTERN.finditer(text[lo:hi])]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(points))
        hashed, where, back = np.unique(hash_spans(data, at[starts], at[ends], _KEYS), return_index=True, return_inverse=True)
        if len(self.young) > REMEMBERED:  # words of the last while stay, whatever else there was
            self.old, self.young = self.young, {}
        known = [self._known(h) for h in hashed.tolist()]
        new = [i for i, k in enumerate(known) if k is None]
        for i, e in zip(new, self._encoded([text[starts[w] : ends[w]] for w in where[new].tolist()]), strict=True):
            known[i] = self.young[int(hashed[i])] = e
        sizes = np.array([len(k) // 4 for k in known], np.int64)
        flat = np.frombuffer(b"".join(known), np.uint32)
        base = np.cumsum(sizes) - sizes
        per = sizes[back]
        stop = np.cumsum(per)
        ids = flat[np.repeat(base[back] - (stop - per), per) + np.arange(int(stop[-1]) if len(stop) else 0)]
        cut = np.concatenate([[0], stop])[np.searchsorted(starts, doc_first)]
        if special.any():
            parts = [self.whole(text[doc_first[i] : doc_first[i + 1]]) if special[i] else ids[cut[i] : cut[i + 1]] for i in range(len(plain))]
            return np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, np.diff(cut)

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, and the ids of each; a text beyond SEGMENT is cut before a single space, where a word begins."""
        data, offsets = arrow_bytes(texts)
        if len(data) <= 2 * SEGMENT or len(offsets) > 2 or any(t in data.tobytes().decode() for t in self.special):
            return self.batch(data, offsets)
        text, at, parts = data.tobytes().decode(), 0, []
        while at < len(text):
            m = _CUT.search(text, at + SEGMENT)
            end = m.start() if m else len(text)
            piece = np.frombuffer(text[at:end].encode(), np.uint8)
            parts.append(self.batch(piece, np.array([0, len(piece)]))[0])
            at = end
        ids = np.concatenate(parts)
        return ids, np.array([len(ids)])


_KEYS = np.random.Generator(np.random.PCG64(50)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_tokenizers: dict[str, PieceTokenizer] = {}
caches("packing", _tokenizers.clear)


def pieces(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of each piece of each document: its ids and the separator, cut only beyond capacity.

    The first piece of a longer document takes what is left over by the others, which are full.
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([rows.schema["key"], *T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long").fields])

    def run(batches):
        working("packing")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if tokenizer not in _tokenizers:
            _tokenizers[tokenizer] = PieceTokenizer(tokenizer)
        own = _tokenizers[tokenizer]
        for whole in batches:
            for batch in text_slices(whole, 1, SEGMENT):
                ids, sizes = own.column(batch.column(1))
                out: list[list] = [[], [], [], [], []]
                at = 0
                for k, n in enumerate(sizes.tolist()):
                    doc = np.append(ids[at : at + n], np.uint32(SEPARATOR)).astype("<u4")
                    at += n
                    lo, piece = 0, 0
                    hi = len(doc) % capacity or capacity
                    while lo < len(doc):
                        for column, v in zip(out, (k, piece, lo, hi - lo, zlib.crc32(doc[lo:hi].tobytes())), strict=True):
                            column.append(v)
                        lo, hi, piece = hi, hi + capacity, piece + 1
                keys = batch.column(0).take(pa.array(out[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:]]], names=schema.names)

    return rows.mapInArrow(run, schema)


class Complements:
    """An index of the lengths still to be packed: pairs of them, and longest members of triples, by their sum."""

    def __init__(self, left: np.ndarray):
        self.left = left
        there = np.flatnonzero(left > 0)
        self.pairs: dict[int, np.ndarray] = {}  # of each sum the longer members, ascending
        self.triples: dict[int, np.ndarray] = {}  # of each sum the longest members, ascending; made when first asked for
        for total in range(2, len(left)):
            long = there[(2 * there >= total) & (there < total)]
            if len(long := long[left[total - long] > 0]):
                self.pairs[total] = long

    def _covered(self, total: int, long: np.ndarray) -> np.ndarray:
        return (self.left[long] > 0) & (self.left[total - long] > (2 * long == total))

    def pair(self, total: int, most: int) -> list[int] | None:
        """The pair of that sum with the longest member, of `most` at most."""
        long = self.pairs.get(total)
        if long is None:
            return None
        long = long[: np.searchsorted(long, most, "right")]
        long = long[self._covered(total, long)]
        return [int(long[-1]), total - int(long[-1])] if len(long) else None

    def fill(self, gap: int) -> list[int] | None:
        """One, two or three lengths that fill the gap exactly under the counts left, the longest first; None if none do."""
        if self.left[gap] > 0:
            return [gap]
        if gap in self.pairs:
            kept = self.pairs[gap][self._covered(gap, self.pairs[gap])]
            if not len(kept):
                del self.pairs[gap]  # counts only fall
            else:
                self.pairs[gap] = kept
                return [int(kept[-1]), gap - int(kept[-1])]
        if gap not in self.triples:
            self.triples[gap] = np.array([a for a in range(-(-gap // 3), gap - 1) if gap - a in self.pairs], np.int64)
        self.triples[gap] = found = self.triples[gap][self.left[self.triples[gap]] > 0]
        for a in found[::-1].tolist():
            self.left[a] -= 1
            two = self.pair(gap - a, a)
            self.left[a] += 1
            if two:
                return [a, *two]
        return None


def complement(left: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three lengths that fill the gap exactly under the counts left, the longest first; None if none do."""
    return Complements(left).fill(gap)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences), covering all counts."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    index, out = Complements(left), []
    top = capacity
    while True:
        while top > 0 and left[top] == 0:
            top -= 1
        if top == 0:
            return out
        found, gap = [top], capacity - top
        left[top] -= 1
        while gap > 0:
            if fill := index.fill(gap):
                found += fill
                for n in fill:
                    left[n] -= 1
                break
            fits = np.flatnonzero(left[1 : gap + 1] > 0)
            if not len(fits):
                break
            best = int(fits[-1]) + 1
            found.append(best)
            left[best] -= 1
            gap -= best
        lengths, times = np.unique(found, return_counts=True)
        often = int((left[lengths] // times).min())  # as often again as the counts allow
        left[lengths] -= often * times
        out.append((found, often + 1))


def slots(planned: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First rank (by length) of each run of slots, with its first sequence and its offset there; sorted."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, often in planned:
        offset = 0
        for n in lengths:
            rows.append((n * _RANK + used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + often
            offset += n
        sequence += often
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def pack(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset; one row a piece.

    A null or empty text is the separator alone; texts of any length are tokenised whole, and only those beyond a sequence are cut.
    Repeated rows are packed as often as they occur, rows that share a key each for itself.  Keys may be of any type; other columns, whatever
    their names, are not looked at.  Among equally long pieces it is their place in the table that decides.  An empty table
    gives no rows.  Only the counts by length (at most `capacity`) reach the driver.
    """
    rows = stage(pieces(df, tokenizer, key, text, capacity).withColumn("at", F.monotonically_increasing_id()), "pieces")
    salts = max(64, rows.count() // 100_000)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(salts)))
    counts = rows.groupBy("length", "salt").agg(F.count("*").alias("c"))
    shared = df.sparkSession.sparkContext.broadcast(slots(plan({r["length"]: r["c"] for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect()}, capacity)))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = counts.select("length", "salt", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "salt").orderBy("at"))
    ranked = rows.withColumn("place", place).join(begins, ["length", "salt"]).select("key", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place") - 1).alias("rank"))

    def placed(batches):
        first, sequence, offset = shared.value
        for batch in batches:
            rank = batch.column(3).to_numpy() * _RANK + batch.column(5).to_numpy()
            i = np.searchsorted(first, rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[i] + rank - first[i]), pa.array(offset[i])], names=schema.names)

    schema = T.StructType([T.StructField(key, rows.schema["key"].dataType), *rows.schema.fields[1:5], *T.StructType.fromDDL("sequence_id long, offset long").fields])
    return ranked.mapInArrow(placed, schema)
