import itertools
import random

import fixtures
import numpy as np
import pytest

from tessera.llm import components as components_module
from tessera.llm import embedding_dedup, minhash_dedup
from tessera.llm.components import components


def smallest_reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("few", [0, 500_000])
@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, monkeypatch, shape, few):
    monkeypatch.setattr(components_module, "FEW", few)
    r = random.Random(5)
    edges = {"path": [(i, i + 1) for i in range(300)], "star": [(7, i) for i in range(300)], "random": [(r.randrange(400), r.randrange(400)) for _ in range(250)], "none": []}[shape]
    edges += [(5, 5), (5, 5)] if edges else []
    r.shuffle(edges)
    got = components(spark.createDataFrame(edges, "u long, v long").repartition(6)).collect()
    real = [e for e in edges if e[0] != e[1]]
    want = smallest_reachable({x for e in real for x in e}, real)
    assert {g.node: g.component for g in got} == want and len(got) == len(want)


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset([tuple(words)] if 0 < len(words) < 5 else zip(*[words[k:] for k in range(5)]))


def brute(rows):
    sets = {k: shingles(t) for k, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    return sets, smallest_reachable(sets, links)


def family(seed, copies, edits, n=150):
    r = random.Random(seed)
    base = fixtures.prose(seed, n).split()
    for _ in range(copies):
        words = list(base)
        for _ in range(r.randint(0, edits)):
            words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
        yield " ".join(words)


def test_documents_by_brute_force(spark):
    texts = [t for s in range(12) for t in family(s, 18, 9)] + [t for s in range(20, 26) for t in family(s, 6, 30)]
    texts += ["license text that many share " * 3 + fixtures.prose(s, 60) for s in range(60)] + ["few words", "few  WORDS", "", None, fixtures.prose(77, 30000), fixtures.prose(77, 30000) + " more"]
    rows = list(enumerate(texts))
    random.Random(0).shuffle(rows)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    sets, want = brute(rows)
    assert len(got) == len(rows)
    for g in got:
        assert (g.n_shingles, g.component_id, g.kept) == (len(sets[g.doc_id]), want[g.doc_id], g.doc_id == want[g.doc_id])


def test_large_nodes_are_compared_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    monkeypatch.setattr(minhash_dedup, "LEAF", 8)
    rows = list(enumerate(t for s in range(2) for t in family(s, 70, 22)))
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {g.doc_id: g.component_id for g in got} == brute(rows)[1]


@pytest.mark.parametrize("parts", [1, 2, 3, 5, 8, 13])
def test_rows_are_linked_whatever_their_keys(spark, parts):
    """Repeated keys with different texts, and rows without a key."""
    one, two, three = (list(family(s, 4, 2)) for s in (1, 2, 3))
    rows = [(1, one[0]), (1, two[0]), (5, two[1]), (6, one[1]), (7, two[2]), (None, three[0]), (None, three[1]), (None, one[2]), (9, ""), (9, None)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))
    found = sorted(((g.doc_id, g.component_id, g.kept) for g in got.collect()), key=str)
    want = [(1, 1, True), (1, 1, True), (5, 1, False), (6, 1, False), (7, 1, False), (None, 1, False), (9, 9, True), (9, 9, True)]
    assert [f for f in found if f[:2] != (None, None)] == sorted(want, key=str)
    assert sorted(f[2] for f in found if f[:2] == (None, None)) == [False, True]


def test_one_row_of_each_group_stays(spark):
    one, two, three = (list(family(s, 4, 2)) for s in (1, 2, 3))
    rows = [("b", one[0], 1), ("a", one[1], 2), ("a", two[0], 3), ("c", two[0], 4), (None, one[2], 5), (None, three[0], 6), (None, three[1], 6), ("a", two[0], 3), ("d", "", 7), (None, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, sid int").repartition(4)
    got = minhash_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.sid) for r in got.collect()), key=str) == sorted([("a", 2), ("a", 3), (None, 6), ("d", 7), (None, 8)], key=str)
    assert {r.component_id for r in minhash_dedup.near_duplicates(docs).collect()} == {"a", "d", None}


def test_mixed_nodes_branch_and_settled_ones_do_not(spark, monkeypatch):
    """Copies of one text and many texts around one passage, with nodes far above LEAF."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    monkeypatch.setattr(minhash_dedup, "LEAF", 6)
    passage = fixtures.prose(500, 120)
    texts = list(family(40, 60, 2)) + [passage + " " + fixtures.prose(s, 70) for s in range(60)] + [passage + " " + t for s in range(5) for t in family(s, 5, 9, 60)]
    rows = list(enumerate(texts))
    levels = []
    real = minhash_dedup._branched
    monkeypatch.setattr(minhash_dedup, "_branched", lambda rows, values, level: levels.append((level, rows.select("sid").distinct().count())) or real(rows, values, level))
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {g.doc_id: g.component_id for g in got} == brute(rows)[1]
    assert levels and all(n <= 90 for _, n in levels)  # the sixty copies are one component and do not branch


def test_recall_by_similarity(spark):
    """Each pair is alone with its likes, so that a lost link shows."""
    r, texts, bands = random.Random(11), [], {}
    for i in range(600):
        words = fixtures.prose(1000 + i, 200).split()
        other = list(words)
        for at in r.sample(range(200), i % 12):
            other[at] = f"z{i}x{at}"
        texts += [" ".join(words), " ".join(other)]
    got = {g.doc_id: g.component_id for g in minhash_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    for i in range(0, len(texts), 2):
        a, b = shingles(texts[i]), shingles(texts[i + 1])
        alike = len(a & b) / len(a | b)
        if alike >= 0.75:
            bands.setdefault(int(alike * 20), []).append(got[i] == got[i + 1])
        else:
            assert got[i] != got[i + 1]
    assert len(bands) >= 5 and all(sum(found) >= 0.99 * len(found) for found in bands.values())


def test_pairs_at_the_least_similarity_share_a_deepest_node():
    """Pairs of signatures whose minwise values agree with a chance of 0.75 each, through all levels of all trees."""
    m, n, r = minhash_dedup, 200_000, np.random.default_rng(9)
    seen = np.zeros(n, bool)
    roots = m._root_paths() if hasattr(m, "_root_paths") else m.mix(np.arange(1, m.TREES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    one = r.integers(0, 1 << 32, (n, m.COORDS), dtype=np.uint32)
    two = np.where(r.random((n, m.COORDS), np.float32) < 0.75, one, ~one)
    for root in roots:
        sid, path = np.arange(n), np.full(n, root)
        for level in range(m.DEPTH):
            picked, child = m._children(one[sid], path, level)
            picked_too, child_too = m._children(two[sid], path, level)
            assert (picked == picked_too).all()
            both = child == child_too
            sid, path = sid[picked[both]], child[both]
        seen[sid] = True
    assert (~seen).sum() <= 15  # 2e-5 of them are 4


def test_document_edges(spark):
    docs = fixtures.frame(spark)
    got = minhash_dedup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {g.doc_id: g for g in got}
    assert by[0].component_id == by[1].component_id == by[2].component_id == 0 and not by[2].kept
    assert by[3].n_shingles == 0 and by[3].kept and by[7].component_id == 6 and by[9].component_id == 8
    assert [g.component_id for g in got if g.doc_id is None and g.n_shingles] == [0]
    assert minhash_dedup.near_duplicates(fixtures.empty(spark)).count() == 0


def vectors(seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 16))
    x = [c + r.normal(size=16) * r.choice([0.02, 0.1, 0.25]) for c in centres for _ in range(25)]
    return [v.tolist() for v in [*x, *r.normal(size=(60, 16))]]


def test_vectors_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "INTERVAL", 50)
    monkeypatch.setattr(embedding_dedup, "PART", 16)
    raw = vectors() + [vectors()[0]] * 4 + [[2 * a for a in vectors()[0]]] + [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 0.0], [1.0] + [0.0] * 15, [1e-300] * 16, [1e300] * 16]
    rows = [(i, v, 1) for i, v in enumerate(raw)] + [(None, raw[0], 1)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links long").repartition(4), threshold=0.95).collect()
    assert len(got) == len(rows)
    unit = {}
    for i, v, _ in [*rows[:-1], (10**6, raw[0], 1)]:
        x = np.array([np.nan if a is None else a for a in v or [0.0]])
        x = np.pad(x, (0, 16 - len(x)))
        if np.isfinite(x).all() and np.abs(x).max() > 0:
            x = x / np.abs(x).max()
            unit[i] = x / np.linalg.norm(x)
    links = [(a, b) for a, b in itertools.combinations(unit, 2) if unit[a] @ unit[b] >= 0.95]
    n = {i: 0 for i in unit}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    want = smallest_reachable(unit, links)
    for g in got:
        i = 10**6 if g.vec_id is None else g.vec_id
        assert g.n_links == n.get(i, 0)
        assert g.component_id == want.get(i, g.vec_id)


def test_only_near_intervals_meet(spark, monkeypatch):
    """Clusters far apart: few of all pairs of intervals are left before vectors move."""
    monkeypatch.setattr(embedding_dedup, "INTERVAL", 64)
    monkeypatch.setattr(embedding_dedup, "INTERVAL_BYTES", 64 * 12 * 4)
    monkeypatch.setattr(embedding_dedup, "PART", 16)
    seen, real = [], embedding_dedup.near_intervals

    def counted(boxes, eps, axes):
        out = real(boxes, eps, axes)
        seen.append((boxes.count(), out.count()))
        return out

    monkeypatch.setattr(embedding_dedup, "near_intervals", counted)
    for clusters in (16, 64):
        r = np.random.default_rng(7)
        centres = []
        while len(centres) < clusters:
            c = r.normal(size=12)
            c /= np.linalg.norm(c)
            if all(c @ o < 0.7 for o in centres):
                centres.append(c)
        x = np.concatenate([c + r.normal(size=(64, 12)) * 0.01 for c in centres]).astype(np.float32)
        got = embedding_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4))
        assert {(r.component_id, r.n_links) for r in got.collect()} == {(64 * k, 63) for k in range(clusters)}
    (a, near_a), (b, near_b) = seen
    assert b >= 3 * a and near_a < a * (a + 1) / 4 and near_b < b * (b + 1) / 6


def test_vectors_of_any_key(spark):
    rows = [("b", [1.0, 0.0]), ("a", [1.0, 0.01]), ("a", [0.0, 1.0]), (None, [0.0, 1.0]), (None, [-1.0, 0.0]), (None, None)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id string, embedding array<double>").repartition(3)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == sorted([("a", 1, "a", True), ("a", 1, "a", True), ("b", 1, "a", False), (None, 1, "a", False), (None, 0, None, True), (None, 0, None, True)], key=str)


def test_vector_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(none).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert [(r.n_links, r.component_id == r.vec_id, r.kept) for r in embedding_dedup.near_duplicates(nulls).collect()] == [(0, True, True)] * 2
