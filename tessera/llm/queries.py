"""The opN_<name> queries, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import embedding_dedup, language_id, lm_scoring, minhash_dedup, mixing, packing, pii, quality, secrets, warc
from tessera.llm.common import crc_bucket


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(crc_bucket("doc_id", 5) != 0))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path())


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir).select("doc_id", "text"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.measured(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.index(warc.read(warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet")), data=False))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    trie = lm_scoring.train(docs.where(crc_bucket("doc_id", 10) != 0))
    found = lm_scoring.score(docs, trie)
    return found.select("doc_id", (crc_bucket("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


OP9_SQL = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN refers IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers AS refers_to
FROM (SELECT page_id, html, CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000
             AND page_id < max(page_id) OVER (PARTITION BY coalesce(html, '')) THEN max(page_id) OVER (PARTITION BY coalesce(html, '')) END AS refers
      FROM pages)
"""


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
 i AS (SELECT r, i, ws[i:i + 4] AS win FROM w, unnest(range(1, len(ws) - 3)) AS q(i)),
 twice AS (SELECT r, i FROM i QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
 covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) AS o(k) GROUP BY r),
 m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
   length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
   coalesce(n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS up, length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) AS letters
   FROM w LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
 NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines
      OR word_chars < 2 * n_words OR word_chars > 40 * n_words OR 2 * up > letters) AS kept
FROM m
"""


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT r, array_to_string(ws[i:i + 4], ' ') AS sh FROM d, unnest(range(1, greatest(len(ws) - 3, 2))) AS q(i) WHERE len(ws) > 0),
 n AS (SELECT d.r, d.doc_id, count(sh) AS n FROM d LEFT JOIN s USING (r) GROUP BY d.r, d.doc_id),
 shared AS (SELECT a.r AS u, b.r AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.r <> b.r GROUP BY a.r, b.r),
 links AS (SELECT u, v FROM shared JOIN n x ON x.r = u JOIN n y ON y.r = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
 reach AS (SELECT r, r AS other FROM n UNION SELECT reach.r, v FROM reach JOIN links ON reach.other = u)
SELECT a.doc_id, a.n AS n_shingles, min(b.doc_id) AS component_id, a.doc_id = min(b.doc_id) AS kept
FROM reach JOIN n a ON a.r = reach.r JOIN n b ON b.r = reach.other GROUP BY a.r, a.doc_id, a.n
"""


OP7_SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
 good AS (SELECT r, v FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
 links AS (SELECT a.r AS u, b.r AS w FROM good a JOIN good b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
 degree AS (SELECT u AS r, count(*) AS n FROM links GROUP BY u),
 reach AS (SELECT r, r AS other FROM e UNION SELECT reach.r, w FROM reach JOIN links ON reach.other = u)
SELECT a.vec_id, coalesce(any_value(n), 0) AS n_links, min(b.vec_id) AS component_id, a.vec_id = min(b.vec_id) AS kept
FROM reach JOIN e a ON a.r = reach.r JOIN e b ON b.r = reach.other LEFT JOIN degree ON degree.r = a.r GROUP BY a.r, a.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_quality": OP5_SQL, "op7_embedding_dedup": OP7_SQL, "op8_minhash_dedup": OP8_SQL, "op9_warc": OP9_SQL}
