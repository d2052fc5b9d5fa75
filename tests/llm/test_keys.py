"""Every operator on rows whose keys are text, repeat with other texts, or are missing."""

import fixtures

from tessera.llm import embedding_dedup, language_id, lm_scoring, minhash_dedup, mixing, packing, pii, quality, secrets, warc
from tessera.llm.queries import tokenizer_path

TEXTS = [fixtures.prose(1, 60), fixtures.prose(2, 60) + " password=hunter22secret", fixtures.prose(3, 9) + " mail a.b@c.de", "", None, fixtures.prose(1, 60)]
ROWS = [(k, t, "en", "s") for k, t in zip(["a", "a", None, "b", None, "a"], TEXTS, strict=True)]


def found(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_all_rows_come_out_with_their_own_keys(spark):
    docs = spark.createDataFrame(ROWS, "doc_id string, text string, lang string, source string").repartition(3)
    keys = sorted((r[0] for r in ROWS), key=str)
    model, trie = language_id.fit(docs), lm_scoring.train(docs)
    outs = {
        "language": language_id.identify(docs, model),
        "packing": packing.pack(docs, tokenizer_path()).where("piece = 0"),
        "secrets": secrets.scan(docs),
        "pii": pii.scan(docs),
        "quality": quality.measured(docs),
        "mixing": mixing.mix(docs),
        "minhash": minhash_dedup.near_duplicates(docs),
        "lm": lm_scoring.score(docs, trie),
    }
    for name, out in outs.items():
        assert sorted((r.doc_id for r in out.select("doc_id").collect()), key=str) == keys, name
    assert found(outs["secrets"], "doc_id", "n_assign") == found(spark.createDataFrame([(r[0], int("password" in (r[1] or ""))) for r in ROWS], "k string, n long"), "k", "n")
    assert [r.doc_id for r in outs["pii"].where("n_email = 1").collect()] == [None]
    assert [r.doc_id for r in outs["packing"].where("length = 1").orderBy("doc_id").collect()] == [None, "b"]
    # The first and the last row say the same; the second has their key, but other words.
    assert found(minhash_dedup.deduplicated(docs), "doc_id", "text") == sorted({r[:2] for r in ROWS}, key=str)
    scores = found(outs["lm"], "doc_id", "n_tokens")
    assert scores == sorted(((r[0], len((r[1] or "").split()) + 1) for r in ROWS), key=str)


def test_pages_and_vectors_of_text_keys(spark):
    pages = spark.createDataFrame([("p", "u", "x" * 2000), ("p", "u", "y" * 2000), (None, "u", "x" * 2000), ("q", None, None)], "page_id string, url string, html string")
    got = found(warc.index(warc.read(warc.write(pages), key_type="string")), "page_id", "payload_bytes", "record_type", "refers_to")
    assert got == sorted([("p", 2000, "response", None), ("p", 2000, "response", None), (None, 2000, "revisit", "p"), ("q", 0, "response", None)], key=str)
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), (None, [2.0, 0.0])], "vec_id string, embedding array<float>")
    assert found(embedding_dedup.near_duplicates(vectors), "vec_id", "n_links", "component_id") == sorted([("a", 1, "a"), ("a", 0, "a"), (None, 1, "a")], key=str)
