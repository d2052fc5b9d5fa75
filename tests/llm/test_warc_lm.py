import collections
import hashlib
import io
import math
import zlib

import fixtures
import numpy as np
import pytest

from tessera.llm import lm_scoring, warc
from tessera.llm.elias_fano import EliasFano

HTML = ["<p>" + "a" * 2000, "<p>" + "a" * 2000, "short", "short", None, "", "é" * 700, "é" * 700, "x\r\n\r\nWARC/1.1\r\n\r\ny", "z" * 3_000_000]


def test_warc_round_trip(spark):
    rows = [(i, f"http://x/{i} é\n", h, "d", 1) for i, h in enumerate(HTML)] + [(None, None, HTML[0], "d", 1), (9, "again", HTML[9], "d", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, bytes long").repartition(3)
    manifest = warc.write(pages)
    chunks = warc.read(manifest, chunk=100_000)
    got = warc.index(chunks).collect()
    assert len(got) == len(rows)
    for g in got:
        data = ((HTML[0] if g.page_id is None else HTML[g.page_id]) or "").encode()
        assert (g.payload_bytes, g.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        refers = {0: 1, 6: 7, None: 1}.get(g.page_id)
        assert (g.record_type, g.refers_to) == ("revisit" if refers is not None else "response", refers)
    parts = [r for r in chunks.where("page_id = 9").orderBy("chunk_no").collect()]
    assert max(len(r.data) for r in parts) <= 100_000
    one = sorted({r.chunk_no: bytes(r.data) for r in parts}.items())
    assert b"".join(d for _, d in one) == HTML[9].encode()
    assert chunks.where("page_id = 0 and record_type = 'revisit'").first().data == b""


def test_warc_keys_repeat_and_payloads_are_chunked(spark):
    long = "é" * 300_000
    rows = [("a%41 é", "u", long), ("a%41 é", "u", "x" * 1500), (None, None, long), ("z", "u", long), ("z", "u", long), ("q", None, ""), ("q", None, None), (None, None, None)]
    chunks = warc.read(warc.write(spark.createDataFrame(rows, "page_id string, url string, html string").repartition(3), chunk=50_000), chunk=60_000, key_type="string")
    assert chunks.groupBy("record_id", "chunk_no").count().where("count > 1").count() == 0
    assert chunks.select("record_id").distinct().count() == len(rows)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.index(chunks).collect()), key=str)
    want = [("a%41 é", 600_000, "revisit", "z"), ("a%41 é", 1500, "response", None), (None, 600_000, "revisit", "z"), ("z", 600_000, "response", None), ("z", 600_000, "response", None)]
    assert got == sorted([*want, ("q", 0, "response", None), ("q", 0, "response", None), (None, 0, "response", None)], key=str)
    with pytest.raises(Exception, match="no response"):
        warc.index(chunks.where("page_id is null or page_id <> 'z'")).collect()


def test_warc_payload_must_match_its_header():
    good = warc._head("response", "1", None, hashlib.sha1(b"abc").hexdigest(), 3, None, 3 + len(warc._HTTP)) + warc._HTTP + b"abc\r\n\r\n"
    assert [r["sha1_so_far"] for r in warc.parsed(io.BytesIO(zlib.compress(good, wbits=31)), 10)] == [hashlib.sha1(b"abc").hexdigest()]
    with pytest.raises(ValueError, match="header"):
        list(warc.parsed(io.BytesIO(zlib.compress(good.replace(b"abc", b"abd"), wbits=31)), 10))


def test_warc_edges(spark):
    assert warc.index(warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string")))).count() == 0
    with pytest.raises(ValueError):
        list(warc.parsed(io.BytesIO(zlib.compress(warc._head("response", 1, None, "00" * 20, 5, None, 100) + warc._HTTP, wbits=31)), 10))


@pytest.mark.parametrize("n,bound", [(0, 1), (1, 5), (5, 10), (1000, 1 << 20), (1000, 500), (5000, 1 << 60), (3000, 1 << 30), (4000, 20), (4000, 3)])
def test_elias_fano(n, bound):
    r = np.random.default_rng(n)
    values = np.sort(r.integers(0, bound, n).astype(np.uint64))
    own = EliasFano(EliasFano.encode(values, bound))
    assert (own.all() == values).all()
    assert n == 0 or (own.get(np.arange(n)) == values).all()
    if n > 1:
        one, two = own.spans(np.arange(n - 1))
        assert (one == values[:-1]).all() and (two == values[1:]).all()
    some = np.unique(values)
    own = EliasFano(EliasFano.encode(some, bound))
    asked = np.concatenate([some, r.integers(0, 2 * bound, 400).astype(np.uint64)])
    place = {int(v): i for i, v in enumerate(some)}
    assert own.find(asked).tolist() == [place.get(int(v), -1) for v in asked]


@pytest.mark.parametrize("crowd", [1, 63, 64, 65, 127, 128, 129, 1000])
def test_elias_fano_of_crowded_buckets(crowd):
    """Many values share their high bits, so that runs of ones fill whole words."""
    for ahead in (0, 1, 5, 63, 64):
        values = np.concatenate([np.arange(ahead) << 40, (ahead << 40) + 3 * np.arange(crowd), [1 << 50, (1 << 50) + 7]]).astype(np.uint64)
        own = EliasFano(EliasFano.encode(values, 1 << 51))
        assert own.find(values).tolist() == list(range(len(values))) and (own.find(values + np.uint64(1)) == -1).all()
        begin, end = np.arange(len(values)), np.arange(len(values)) + 1
        assert own.find(values, begin, end).tolist() == begin.tolist() and (own.find(values[:-1], begin[1:], end[1:]) == -1).all()


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_by_brute_force(spark, order):
    docs = fixtures.frame(spark)
    rows = [(r[0], r[1]) for r in fixtures.rows()] + [(1000 + i, fixtures.prose(i % 7, 30 + i)) for i in range(60)] + [(2000, "never seen words"), (2001, "ALPHAbeta alphaBETA")]
    docs = spark.createDataFrame([(a, b, 0.0) for a, b in rows], "doc_id long, text string, score double").repartition(4)
    train = [b for a, b in rows if a is None or a < 2000]
    trie = lm_scoring.train(docs.where("doc_id is null or doc_id < 2000"), order=order)
    texts = [(t or "").encode().lower().split() + [None] for t in train]
    count = [collections.Counter(tuple(w[i : i + k]) for w in texts for i in range(len(w) - k + 1)) for k in range(1, order + 1)]
    total, kinds = collections.Counter(), collections.Counter()
    for k in range(1, order):
        for gram, n in count[k].items():
            total[gram[:-1]] += n
            kinds[gram[:-1]] += 1
    n, v = sum(count[0].values()), len(count[0])
    assert (trie.tokens, trie.vocabulary) == (n, v)
    want = collections.defaultdict(list)
    for a, t in rows:
        w = (t or "").encode().lower().split() + [None]
        base = [math.log10((count[0][(x,)] + 0.1) / (n + 0.1 * (v + 1))) for x in w]
        full = 0.0
        for j in range(len(w)):
            p = 10 ** base[j]
            for k in range(2, order + 1):
                if j - k + 1 >= 0 and total[c := tuple(w[j - k + 1 : j])]:
                    p = max(count[k - 1][(*c, w[j])] - lm_scoring.DISCOUNT, 0) / total[c] + lm_scoring.DISCOUNT * kinds[c] / total[c] * p
            full += math.log10(p)
        want[a, len(w)].append((sum(count[0][(x,)] > 0 for x in w), sum(base), full))
    got = lm_scoring.score(docs, trie, keep=["doc_id"]).collect()
    assert len(got) == len(rows)
    for g in got:
        known, base, full = want[g.doc_id, g.n_tokens][0]
        assert g.n_known == known and g.train_tokens == n
        assert g.base_score == pytest.approx(base, rel=1e-12)
        assert g.score == pytest.approx(full, abs=2e-4 * g.n_tokens)  # half a step of the 16-bit logarithms a factor


def test_query_by_brute_force(spark):
    """Every document of a small table under all training documents' counts."""
    from tessera.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode().lower().split() + [None] for r in queries.documents(spark, sf).collect()}
    train = [w for k, w in texts.items() if zlib.crc32(str(k).encode()) % 10]
    count = [collections.Counter(tuple(w[i : i + k]) for w in train for i in range(len(w) - k + 1)) for k in (1, 2, 3)]
    total, kinds = collections.Counter(), collections.Counter()
    for k in (1, 2):
        for gram, n in count[k].items():
            total[gram[:-1]] += n
            kinds[gram[:-1]] += 1
    n, v = sum(count[0].values()), len(count[0])
    got = queries.op10_lm_scoring(spark, sf).collect()
    assert len(got) == len(texts)
    for g in got:
        w, base, full = texts[g.doc_id], 0.0, 0.0
        for j in range(len(w)):
            p = (count[0][(w[j],)] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            for c in (tuple(w[j - 1 : j]), tuple(w[j - 2 : j])) if j > 1 else (tuple(w[:1]),) if j else ():
                if total[c]:
                    p = max(count[len(c)][(*c, w[j])] - lm_scoring.DISCOUNT, 0) / total[c] + lm_scoring.DISCOUNT * kinds[c] / total[c] * p
            full += math.log10(p)
        assert (g.n_tokens, g.train_tokens, g.n_known) == (len(w), n, sum(count[0][(x,)] > 0 for x in w))
        assert g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 10 == 0)
        assert g.base_score == pytest.approx(base, rel=1e-9) and g.score == pytest.approx(full, abs=3e-4 * g.n_tokens)


def test_frequent_words_are_spread_and_bundles_merged(spark, monkeypatch):
    """Scores do not depend on the number of shards, on how their rows travel, or on a word that makes up half of the corpus."""
    texts = [" ".join(w for x in fixtures.prose(i, 60).split() for w in ("the", x)) for i in range(40)] + ["the the the", "", None, "The"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = []
    for least, fan in ((1, 256), (32, 256), (32, 4)):
        monkeypatch.setattr(lm_scoring, "LEAST_SHARDS", least)
        monkeypatch.setattr(lm_scoring, "FAN", fan)
        trie = lm_scoring.train(docs)
        assert (len(trie.words), trie.order) == (least, 3)
        found.append(sorted((r.doc_id, r.n_known, r.base_score, r.score) for r in lm_scoring.score(docs, trie).collect()))
        if least == 32:
            hashes = lm_scoring.tokens(lm_scoring.pa.array(texts))[0]
            counts = lm_scoring.look_up(trie, hashes)[1]
            assert len(np.unique(lm_scoring._pair_shards(trie, hashes, counts)[counts[:-1] == counts.max()])) >= 12
    assert found[1] == found[2] and [f[:3] for f in found[0]] == [f[:3] for f in found[1]]
    assert np.allclose([f[3] for f in found[0]], [f[3] for f in found[1]])


def test_lm_edges(spark):
    trie = lm_scoring.train(fixtures.empty(spark))
    assert trie.tokens == 0
    rows = lm_scoring.score(fixtures.frame(spark), trie).collect()
    assert len(rows) == len(fixtures.rows()) and all(abs(r.base_score) < 1e-9 and r.n_known == 0 for r in rows)
    assert lm_scoring.score(fixtures.empty(spark), trie).count() == 0
