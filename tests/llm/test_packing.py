import random
import zlib

import fixtures
import numpy as np
import pyarrow as pa
import public_tokenizers

from tessera.llm import packing as K

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_equal_the_tokenizers():
    own = K.PieceTokenizer(PATH)
    r = random.Random(4)
    alphabet = [*"ab Z1 9'!$\n\t \r  sdmtvelré中  ²½ºٱ१\x1c\x85_-.,—", "'s", "'ll", " '", "<|endoftext|>", "  "]
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 40))) for _ in range(4000)] + ["", None]
    ids, sizes = own.column(pa.array(texts))
    at = 0
    for t, n in zip(texts, sizes.tolist()):
        assert ids[at : at + n].tolist() == own.own.encode(t or "", add_special_tokens=False).ids, t
        at += n


def test_long_text_is_cut_at_words(monkeypatch):
    monkeypatch.setattr(K, "SEGMENT", 1000)
    own, text = K.PieceTokenizer(PATH), fixtures.prose(3, 2000) + "  \n\n x"
    ids, sizes = own.column(pa.array([text]))
    assert ids.tolist() == own.whole(text).tolist()
    assert sizes.tolist() == [len(ids)]


def test_complement_is_exact():
    r = random.Random(0)
    for _ in range(200):
        left = np.zeros(41, np.int64)
        for n in r.choices(range(1, 40), k=6):
            left[n] += 1
        gap = r.randint(2, 40)
        items = [n for n in range(1, 41) for _ in range(left[n])]
        sums = {sum(c) for k in (1, 2, 3) for c in __import__("itertools").combinations(items, k)}
        got = K.complement(left, gap)
        assert (got is not None) == (gap in sums)
        if got:
            assert sum(got) == gap and all(left[n] >= got.count(n) for n in got)


def test_plan_covers_counts_near_the_bound():
    r = random.Random(1)
    counts = {n: r.randint(1, 5) for n in r.sample(range(1, 2049), 700)}
    planned = K.plan(counts)
    used = {}
    for lengths, often in planned:
        assert sum(lengths) <= 2048
        for n in lengths:
            used[n] = used.get(n, 0) + often
    assert used == counts
    total = sum(n * c for n, c in counts.items())
    assert sum(often for _, often in planned) <= -(-total // 2048) * 1.01 + 1


def test_edges(spark):
    docs = fixtures.frame(spark)
    own = K.PieceTokenizer(PATH)
    got = K.pack(docs, PATH).toPandas()
    assert (got.length <= 2048).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.length.cumsum() - g.length == g.offset).all() and g.length.sum() <= 2048
    want = []
    for r in fixtures.rows():
        ids = np.append(own.whole(r[1] or ""), 0).astype("<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(r[0], i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda x: tuple((v is None, v) for v in x)
    have = [(None if k != k else int(k), *map(int, rest)) for k, *rest in got[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist()]
    assert sorted(have, key=key) == sorted(want, key=key)
    assert K.pack(fixtures.empty(spark), PATH).count() == 0
