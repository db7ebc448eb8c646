"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.chat import chat_digests
from tidemark.llm.common import new_path
from tidemark.llm.decontaminate import contamination
from tidemark.llm.embeddings import embedding_groups
from tidemark.llm.lm import lm_scores
from tidemark.llm.negatives import hard_negatives
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import quality_scores
from tidemark.llm.sharding import PRIME, round_keys, shard_documents
from tidemark.llm.simhash import simhash_groups
from tidemark.llm.substrings import substring_digests
from tidemark.llm.token_files import read_token_files, write_token_files
from tidemark.llm.variants import spelling_variants
from tidemark.llm.warc import read_digests, write_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), folds=5, threshold=0.3)


def op2_lm_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"), folds=10)


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file, as installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2, size=1024)


def op5_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_digests(rows.unionByName(extra))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_token_files(_table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, path, with_ids=False)


def op8_substring_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digests(_table(spark, sf_dir, "documents"), window=13)


def op9_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_pages(_table(spark, sf_dir, "pages"), path, least=0)
    return read_digests(spark, path)


def op10_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(_table(spark, sf_dir, "documents"), shingle=3, budget=2, seed=42)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"), shards=16, seed=11)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"), typo=97, least=5, seen=3, times=2)


def op13_ball_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(_table(spark, sf_dir, "embeddings"), every=50, shift=7, labels=10, scale=256)


QUERIES = {f.__name__: f for f in (op1_quality_gam, op2_lm_backoff, op3_rotation_codes, op4_best_fit_packing, op5_latent_leaks, op6_chat_events, op7_token_files, op8_substring_doubling, op9_warc_source, op10_simhash_trie, op11_feistel_shards, op12_spelling_variants, op13_ball_tree_negatives)}


def _escaped(x: str) -> str:
    for plain, safe in (("\\", "\\e"), ("<s>", "\\ls>"), ("</s>", "\\l/s>"), ("[INST]", "\\bINST]"), ("[/INST]", "\\b/INST]")):
        x = f"replace({x}, '{plain}', '{safe}')"
    return x


#: A turn's marks take 3 + 6 + 7 + 4 characters besides its escaped role and text.
OP6_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, role AS r, text AS t, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) AS told,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, t NULLS FIRST) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(20 + length({_escaped("role")}) + length({_escaped("text")})) AS chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(chars AS BIGINT) AS formatted_chars FROM g
"""

#: Words start after white space; a repeat is judged on the input by its words and the smallest doc_id.
OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(list_filter(regexp_split_to_array(text, '[ \x09-\x0D]+'), lambda x: x <> ''), []) AS ws FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS s
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w)
), l AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s),
r AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM g JOIN l USING (s) WHERE g.doc_id > l.least
), k AS (
  SELECT w.doc_id, u.p, u.word, r.p IS NOT NULL AS gone
  FROM w, LATERAL (SELECT unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p) u
  LEFT JOIN r ON r.doc_id = w.doc_id AND r.p = u.p
)
SELECT w.doc_id, CAST(len(any_value(ws)) AS BIGINT) AS n_words, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id) GROUP BY w.doc_id
"""

#: All pairs, then what links reach; for the small tables that SQL is compared on.
OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON r.vec_id = l.a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1), g AS (SELECT vec_id, min(c) AS c FROM r GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(g.c, vec_id) AS component_id, vec_id = coalesce(g.c, vec_id) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN g USING (vec_id)
"""

#: Five hexadecimal digits of a SHA-1 are four of base 32.
OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT h, min(page_id) AS least FROM p GROUP BY h)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(s, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > least THEN least END AS refers_to
FROM p JOIN f USING (h)
"""

#: Checksums go byte by byte over the table of the reflected polynomial, half a byte at a time. Numbers are permuted by
#: rounds of one row each, and numbers outside are permuted again.
OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, strlen(t), c) - 1 AS r, doc_id, CAST(strlen(t) + 1 AS BIGINT) AS size, c
  FROM (SELECT doc_id, t, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT)),
      lambda c, x: xor(xor(xor(c, x) >> 4, p[1 + (xor(c, x) & 15)]) >> 4, p[1 + (xor(xor(c, x) >> 4, p[1 + (xor(c, x) & 15)]) & 15)]), CAST(4294967295 AS BIGINT))) AS c
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      (SELECT list_transform(range(16), lambda i: list_reduce(range(4), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, i)) AS p))
), n AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a, CAST(ceil(count(*) / ceil(sqrt(count(*)))) AS BIGINT) AS b FROM d),
k(i, p, q, r, s) AS (VALUES {', '.join(f"({i}, {p}, {q}, {r}, {s})" for i, (p, q, r, s) in enumerate(round_keys(11)))}),
w(r, i, x, y) AS (
  SELECT r, 0, r // b, r % b FROM d, n
  UNION ALL
  SELECT w.r, CASE WHEN w.i = 6 THEN 1 ELSE w.i + 1 END, y,
    (x + ((((y * p + q) % {PRIME}) * ((y * p + q) % {PRIME}) + y) % {PRIME} * k.r + k.s) % {PRIME}) % CASE WHEN k.i % 2 = 1 THEN b ELSE a END
  FROM w, n, k WHERE k.i = w.i % 6 AND (w.i < 6 OR x * b + y >= n)
)
SELECT doc_id, size, c AS text_crc32, 'rows' AS law, CAST((x * b + y) % 16 AS INTEGER) AS shard, (x * b + y) // 16 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM d JOIN w USING (r), n WHERE i = 6 AND x * b + y < n
"""

#: All scores of the anchors, for the small tables that SQL is compared on.
OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, p.other AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY anchor_id, p.other ORDER BY s.score DESC, s.other) QUALIFY row_number() OVER w <= 3
"""

ORACLE: dict[str, str] = {
    "op3_rotation_codes": OP3_SQL,
    "op6_chat_events": OP6_SQL,
    "op8_substring_doubling": OP8_SQL,
    "op9_warc_source": OP9_SQL,
    "op11_feistel_shards": OP11_SQL,
    "op13_ball_tree_negatives": OP13_SQL,
}
