import zlib

import fixtures
import numpy as np
import pytest

from tessera.llm import language_id as L

SF = "/root/testdata/sf0.01"


def phrases(text: bytes, sample: bytes) -> int:
    """Greedy cross-parsing of a whole text by substring search."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at += size
        n += 1
    return n


def test_phrase_counts_by_brute_force():
    samples = tuple((n, L.normalised([fixtures.prose(i, 200)])[0].tobytes()) for i, n in enumerate("abc"))
    texts = [fixtures.prose(9, 300), "zzz qqq", "Ω alpha", "a", fixtures.prose(1, 50).upper()]
    counts, sizes = L.phrase_counts(texts, L.LanguageModel(samples))
    for i, t in enumerate(texts):
        data = L.normalised([t])[0].tobytes()
        assert sizes[i] == len(data)
        assert counts[i].tolist() == [phrases(data, s) for _, s in samples]


def test_phrases_run_across_stretches(monkeypatch):
    """Stretches much shorter than phrases, texts that copy the sample, and texts of one letter."""
    monkeypatch.setattr(L, "LANE_BYTES", 8)
    sample = fixtures.prose(3, 60)
    samples = tuple((n, L.normalised([t])[0].tobytes()) for n, t in (("a", sample), ("b", "ab" * 40), ("c", "a" * 37)))
    texts = [sample, sample[5:200] + "q" + sample[50:90] + sample[60:70], "a" * 100, "ab" * 90, "ba" * 33 + "zz" + "ab" * 20, "x", "a b c d e f g h i j k"]
    counts, _ = L.phrase_counts(texts, L.LanguageModel(samples))
    for i, t in enumerate(texts):
        assert counts[i].tolist() == [phrases(L.normalised([t])[0].tobytes(), s) for _, s in samples]


def test_more_languages_than_tables_fit(spark, monkeypatch):
    model = L.LanguageModel(tuple((f"l{i:02}", L.normalised([fixtures.prose(i, 40)])[0].tobytes()) for i in range(12)))
    texts = [fixtures.prose(i, 30) for i in range(12)]
    want = L.phrase_counts(texts, model)[0]
    monkeypatch.setattr(L, "TABLE_ENTRIES", 20_000)
    L._tables.clear()
    assert not L._fits(model) and (L.phrase_counts(texts, model)[0] == want).all() and len(L._tables) < 12


def test_keys_have_no_part_in_learning(spark):
    """Rows that share a key, have none, or repeat; a language of one long text; labels alone."""
    rows = [(7, fixtures.prose(i, 30), "aa") for i in range(700)] + [(None, "qux quux corge " * 20 + str(i), "bb") for i in range(300)]
    rows += [(i, "zut alors mon dieu", "cc") for i in range(500)] + [(1, "lorem ipsum dolor " * 3000, "dd"), (2, "lorem ipsum dolor " * 4000, "dd"), (3, "123 456", "ee"), (4, None, "ff")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = L.fit(docs)
    assert [n for n, _ in model.samples] == ["aa", "bb", "cc", "dd"]
    assert dict(model.samples)["cc"] == b" zut alors mon dieu"[1:] and len(dict(model.samples)["dd"]) == 18 * 3000 - 1
    got = {r.lang: r.lang_pred for r in L.identify(docs.where("lang < 'ee'"), model).select("lang", "lang_pred").distinct().collect()}
    assert got == {n: n for n in ("aa", "bb", "cc", "dd")}


def test_normalised_keeps_letters():
    data, sizes = L.normalised(["  Hi, there!! ", "123", "É1x"])
    assert data.tobytes() == b" hi there" + "é x".encode()
    assert sizes.tolist() == [9, 0, 4]


def test_accuracy_on_held_out(spark):
    from tessera.llm.queries import op1_language_id

    got = op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 100
    assert (got.lang == got.lang_pred).mean() > 0.95
    assert got[got.lang.notna()].groupby("lang").apply(lambda g: (g.lang == g.lang_pred).mean()).min() > 0.9
    assert got.score.between(0, 1).all()


def test_query_by_brute_force(spark):
    """Every document of a small table, by substring search in the learned texts."""
    from tessera.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = queries.documents(spark, sf)
    model = L.fit(docs.where(queries.crc_bucket("doc_id", 5) != 0).select("doc_id", "text", "lang"))
    got = {r.doc_id: r for r in queries.op1_language_id(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts) == docs.count()
    for i, text in texts.items():
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        if text is None or not any(map(str.isalpha, text)):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
        elif len(text) <= 2500:  # longer ones take minutes this way
            data = L.normalised([text])[0].tobytes()
            cost = sorted((phrases(data, s) * np.log2(len(s)) / len(data), n) for n, s in model.samples)
            assert got[i].lang_pred == cost[0][1] and got[i].score == pytest.approx(1 - cost[0][0] / cost[1][0])


def test_edges(spark):
    docs = fixtures.frame(spark)
    out = L.identify(docs, L.fit(docs)).collect()
    assert len(out) == docs.count()
    for r in out:
        assert r.lang_pred == ("und" if r.text is None or not any(map(str.isalpha, r.text)) else "en")
        assert 0 <= r.score <= 1
    assert L.identify(docs, L.LanguageModel(())).where("lang_pred <> 'und'").count() == 0
    none = fixtures.empty(spark)
    assert L.fit(none) == L.LanguageModel(())
    assert L.identify(none, L.fit(docs)).count() == 0


def test_fit_is_bounded_and_repeatable(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = L.fit(docs, docs_per_lang=4, sample_chars=1000), L.fit(docs.repartition(7), docs_per_lang=4, sample_chars=1000)
    assert a == b
    assert all(0 < len(s) <= 5000 for _, s in a.samples)


@pytest.mark.parametrize("text", ["abcbc", "aabbabab", "x"])
def test_automaton_knows_all_substrings(text):
    go = L.suffix_automaton(text)
    for i in range(len(text)):
        state = 0
        for c in text[i:]:
            state = go[state][c]
    assert np.all([("y" not in g) for g in go])
