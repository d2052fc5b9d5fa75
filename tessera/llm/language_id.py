"""Language identification by cross-parsing entropy over suffix automata.

Some labelled texts per language become a suffix automaton.  A
text is parsed greedily into the longest stretches found in them; with n
bytes of text, c phrases and N bytes of sample, ``c * log2(N) / n`` estimates the
cross entropy.  The language that needs the fewest bits wins.

Thousands of stretches of text advance together, one table lookup a byte.  A stretch begins as if a phrase did; then the phrase
that the stretch before left open runs on into it until both parses begin a phrase at the same byte, from where they are one.
So the count is that of the whole text parsed from its start.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import CHUNK_BYTES, caches, drop_clashing, text_slices, working

UNDETERMINED = "und"
#: Bytes of a stretch; long texts advance in parallel.
LANE_BYTES = 512
#: Table entries that a worker holds.  The tables of more languages than fit are built anew for each chunk of MANY_BYTES.
TABLE_ENTRIES, MANY_BYTES = 64_000_000, 32 << 20
#: Rounds in which all open phrases run on together.
ROUNDS = 4
_FLAG = np.int32(1 << 30)
#: Bytes of letters: ASCII ones and all of other scripts.
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_tables: OrderedDict[bytes, np.ndarray] = OrderedDict()
caches("language", _tables.clear)


@dataclass(frozen=True)
class LanguageModel:
    """Sample text by language, in code-point order of the language."""

    samples: tuple[tuple[str, bytes], ...]


def fit(df: DataFrame, text: str = "text", lang: str = "lang", docs_per_lang: int = 32, sample_chars: int = 4096) -> LanguageModel:
    """Draw `docs_per_lang` whole texts a language, by hash of the text, from its texts of at most `sample_chars` characters.

    A language without such texts is learned from its shortest one.  These two bounds, and the number of languages, bound the model.

    Rows without label or text are not used, nor are those labelled `und`.  Equal texts of a language count as one, whatever their
    other columns hold; ties of the hash go by text, so that reruns agree.  No rows give a model that finds every text
    undetermined; a language whose texts hold no letter is not learned.
    """
    rows = df.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & (F.length("text") > 0) & (F.col("lang") != UNDETERMINED))
    rows = rows.withColumn("size", F.length("text")).withColumn("h", F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30)))
    fits = F.col("size") <= sample_chars
    facts = rows.groupBy("lang").agg(F.approx_count_distinct(F.when(fits, F.col("h"))).alias("kinds"), F.min("size").alias("least")).collect()  # a row a language
    if not facts:
        return LanguageModel(())
    drawn: Column = F.lit(False)
    for r in sorted(facts, key=lambda r: r["lang"]):
        chance = (1 << 30) * 4 * docs_per_lang // r["kinds"] + 1 if r["kinds"] else 0
        drawn = F.when(F.col("lang") == r["lang"], fits & (F.col("h") < chance) if chance else F.col("size") == r["least"]).otherwise(drawn)
    few = rows.where(drawn).groupBy("lang", "h").agg(F.min("text").alias("text"))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    got = ranked.where(F.col("rank") <= docs_per_lang).orderBy("lang", "rank").collect()  # docs_per_lang rows a language
    alone = {r["lang"] for r in facts if not r["kinds"]}
    samples = []
    for name in sorted(r["lang"] for r in facts):
        whole = normalised([r["text"] for r in got if r["lang"] == name][: 1 if name in alone else None])[0].tobytes()
        if whole:
            samples.append((name, whole))
    return LanguageModel(tuple(samples))


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased UTF-8 bytes of the texts' letters, other stretches being one space; and the bytes of each text."""
    if not texts:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    raw = [t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    solid = _LETTER[data]
    kept = solid.copy()
    kept[:-1] |= solid[1:]  # one space before a letter; none at a text's end
    ends = np.cumsum([len(r) for r in raw])
    kept[ends - 1] = False
    total = np.concatenate([[0], np.cumsum(kept)[ends - 1]])
    return np.where(solid, data, np.uint8(32))[kept], np.diff(total)


def suffix_automaton(symbols) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence, by state; state 0 is the start."""
    go, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in go[at]:
            go[at][c] = new
            at = link[at]
        if at >= 0:
            old = go[at][c]
            if length[old] == length[at] + 1:
                link[new] = old
            else:
                twin = len(go)
                go.append(dict(go[old]))
                length.append(length[at] + 1)
                link.append(link[old])
                while at >= 0 and go[at].get(c) == old:
                    go[at][c] = twin
                    at = link[at]
                link[old] = link[new] = twin
        last = new
    return go


def _classes(model: LanguageModel) -> np.ndarray:
    """A class for each byte: those that occur in a sample, and one for the rest."""
    used = np.zeros(256, bool)
    for _, sample in model.samples:
        used[np.frombuffer(sample, np.uint8)] = True
    classes = np.zeros(256, np.uint8)
    classes[used] = np.arange(1, used.sum() + 1) if used.sum() < 256 else np.arange(256)
    return classes


def _table(sample: bytes, classes: np.ndarray) -> np.ndarray:
    """Transitions between rows (a row's place in the table), flagged where a phrase begins.

    Row 0 stands for "no phrase open": whatever comes begins a phrase.  Row s is the automaton's state s.
    """
    width = int(classes.max()) + 1
    key = classes.tobytes() + sample
    if key not in _tables:
        go = suffix_automaton(classes[np.frombuffer(sample, np.uint8)].tolist())
        first = np.full(width, _FLAG, np.int32)
        for c, s in go[0].items():
            first[c] = np.int32(s * width) | _FLAG
        table = np.repeat(first[None, :], len(go), axis=0)
        sizes = np.fromiter(map(len, go), np.int64, len(go))
        sizes[0] = 0
        table[np.repeat(np.arange(len(go)), sizes), [c for edges in go[1:] for c in edges]] = np.array([t for edges in go[1:] for t in edges.values()], np.int32) * np.int32(width)
        while _tables and table.size + sum(t.size for t in _tables.values()) > TABLE_ENTRIES:
            _tables.popitem(last=False)
        _tables[key] = table.ravel()
    _tables.move_to_end(key)
    return _tables[key]


def _bits(model: LanguageModel) -> np.ndarray:
    """Bits a phrase, by language."""
    return np.array([max(1.0, np.log2(len(sample))) for _, sample in model.samples])


def _fits(model: LanguageModel) -> bool:
    """Whether a worker can hold all tables; an automaton has at most two states a byte."""
    return sum(2 * len(sample) for _, sample in model.samples) * (int(_classes(model).max(initial=0)) + 1) <= TABLE_ENTRIES


def phrase_counts(texts: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each text by language, and its normalised bytes."""
    classes = _classes(model)
    data, sizes = normalised(texts)
    data = classes[data]
    lanes = -(-sizes // LANE_BYTES)
    owner = np.repeat(np.arange(len(texts)), lanes)
    grid = np.zeros((int(lanes.sum()), LANE_BYTES), np.uint8)
    flat, at, begin = grid.reshape(-1), 0, 0
    for n, k in zip(sizes.tolist(), lanes.tolist(), strict=True):
        flat[at : at + n] = data[begin : begin + n]
        at, begin = at + k * LANE_BYTES, begin + n
    filled = np.full(len(owner), LANE_BYTES, np.int64)
    ends = np.cumsum(lanes)[lanes > 0] - 1
    filled[ends] = sizes[lanes > 0] - (lanes[lanes > 0] - 1) * LANE_BYTES
    order = np.argsort(-filled, kind="stable")
    steps = np.ascontiguousarray(grid[order].T).astype(np.int32)
    active = np.searchsorted(-filled[order], -np.arange(LANE_BYTES), "left")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    follows = np.concatenate([owner[1:] == owner[:-1], [False]]) if len(owner) else np.zeros(0, bool)
    after = np.full(len(order), -1)  # by place: where the lane that goes on lies
    after[place[:-1][follows[:-1]]] = place[1:][follows[:-1]]
    counts = np.zeros((len(texts), len(model.samples)), np.int64)
    for k, (_, sample) in enumerate(model.samples):
        per = _parsed(_table(sample, classes), steps, active, after, order)
        counts[:, k] = np.bincount(owner, weights=per[place], minlength=len(texts)).astype(np.int64)
    return counts, sizes


def _parsed(table: np.ndarray, steps: np.ndarray, active: np.ndarray, after: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Phrases that begin in each lane.  steps: byte classes by position and lane, long lanes first; after: the lane that goes on;
    order: the place of a lane in the text.
    """
    lanes = len(after)
    state, begun = np.zeros(lanes, np.int32), np.zeros(steps.shape, bool)
    for j in range(len(steps)):
        n = int(active[j])
        if not n:
            break
        to = table.take(state[:n] + steps[j, :n])
        np.greater_equal(to, _FLAG, out=begun[j, :n])
        np.bitwise_and(to, _FLAG - np.int32(1), out=state[:n])
    left = np.cumsum(begun[::-1], axis=0, dtype=np.int16)[::-1]  # phrases of a lane's own parse from a byte on
    total = left[0].astype(np.int64) if len(steps) else np.zeros(lanes, np.int64)
    alone = state.copy()  # how each lane's own parse leaves it
    go, entering = after[after >= 0], state[after >= 0]
    for _ in range(ROUNDS):  # lanes into which an open phrase runs on
        if not len(go):
            break
        fresh, now, lane = np.zeros(len(go), np.int64), entering.copy(), np.arange(len(go))
        for j in range(len(steps)):
            lane = lane[go[lane] < active[j]]  # lanes that end here are a text's last
            if not len(lane):
                break
            to = table.take(now[lane] + steps[j, go[lane]])
            new = to >= _FLAG
            now[lane] = to & (_FLAG - np.int32(1))
            met = new & begun[j, go[lane]]
            one = lane[met]
            fresh[one] += left[j, go[one]]
            now[one] = alone[go[one]]
            fresh[lane[new & ~met]] += 1
            lane = lane[~met]
        total[go] = fresh
        changed = np.flatnonzero((now != state[go]) & (after[go] >= 0))
        state[go] = now
        go, entering = after[go[changed]], now[changed]
    # What has not met by then, as in texts of one repeated word, is parsed lane after lane.
    waiting = {int(order[lane]): (int(lane), int(s)) for lane, s in zip(go, entering, strict=True)}
    todo = sorted(waiting)
    heapq.heapify(todo)
    flat, flag = memoryview(table), int(_FLAG)
    while todo:
        lane, now = waiting.pop(at := heapq.heappop(todo))
        size, fresh = int(np.searchsorted(-active, -lane, "left")), 0
        for j, (c, own) in enumerate(zip(steps[:size, lane].tolist(), begun[:size, lane].tolist(), strict=True)):
            now = flat[now + c]
            if now >= flag:
                now -= flag
                if own:
                    fresh, now = fresh + int(left[j, lane]), int(alone[lane])
                    break
                fresh += 1
        total[lane] = fresh
        if now != state[lane] and after[lane] >= 0:
            if at + 1 not in waiting:
                heapq.heappush(todo, at + 1)
            waiting[at + 1] = int(after[lane]), now
        state[lane] = now
    return total


def identify(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """df's columns, then lang_pred and score (0 to 1: one less the ratio of the best to the second-best cross entropy).

    Null texts, texts without a letter and all texts under an empty model are `und` with score 0.
    Equal entropies go to the language first in code-point order.  Texts are taken whole, very long ones each as a step of its own.
    Repeated rows come out alike, an empty table gives no rows, other columns pass through and those named as outputs are replaced.
    """
    base = drop_clashing(df, ["lang_pred", "score"])
    at = base.columns.index(text)
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = base.sparkSession.sparkContext.broadcast(model)  # docs_per_lang texts of at most sample_chars for each language

    def run(batches):
        working("language")
        own = shared.value
        names = np.array([n for n, _ in own.samples], object)
        limit = CHUNK_BYTES if _fits(own) else MANY_BYTES
        for whole in batches:
            for batch in text_slices(whole, at, limit):
                texts = batch.column(at).to_pylist()
                lettered = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
                label, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
                if len(names) and lettered:
                    counts, sizes = phrase_counts([texts[i] for i in lettered], own)
                    cost = counts * _bits(own) / sizes[:, None]
                    best = cost.argmin(1)
                    label[lettered] = names[best]
                    if len(names) == 1:
                        score[lettered] = 1.0
                    else:
                        two = np.partition(cost, 1, axis=1)
                        score[lettered] = np.clip(1 - two[:, 0] / two[:, 1], 0, 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    return base.mapInArrow(run, schema)
