"""Registered queries of the subpackage: each applies one operator, with
production parameters, to its whole table and derives the reported columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aqlens.llm import ann, bpe, exact, hosts, infill, langid, packing, passages, pii, quality, secrets, simhash, trie
from aqlens.llm.common import table


# Key of the registered query; a deployment passes its own secret.
PII_KEY = b"registered query"


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids again, report counts and digests."""
    import public_tokenizers

    rank_path, pattern = _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode(table(spark, sf_dir, "documents"), rank_path, pattern)
    return bpe.decode(ids, rank_path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, by verified chunk recipes."""
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document, by pattern and by randomness."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return secrets.scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.as_text("base"), 256).alias("base_sha256"),
        secrets.as_text("spans").alias("spans"),
    )


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page from text, markup, address and host."""
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and the components of those that differ
    in at most 4 bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs, PII_KEY)


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the training fold."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document that repeat an earlier document."""
    return passages.mark_passages(table(spark, sf_dir, "documents"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for filling in the middle, and rebuilt."""
    out = infill.transform(table(spark, sf_dir, "documents"), seed=1, plain_share=10, spm_share=20)
    return infill.restore(out).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and host verdict of every document."""
    return hosts.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of the conversations, rebuilt so that families share beginnings."""
    turned, convs = trie.with_shared_heads(trie.turns(table(spark, sf_dir, "conversations")), family=20, most=4)
    return trie.prefix_trie(turned, convs)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_secrets": op3_secrets,
    "op4_language": op4_language,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_simhash": op6_simhash,
    "op7_surrogates": op7_surrogates,
    "op8_multi_index": op8_multi_index,
    "op9_quality": op9_quality,
    "op10_passages": op10_passages,
    "op11_infill": op11_infill,
    "op12_host_rules": op12_host_rules,
    "op13_prefix_trie": op13_prefix_trie,
}

# Queries that DuckDB can express; the others are tested against brute force.
ORACLE: dict[str, str] = {
    "op2_exact_dedup": """
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
""",
    "op11_infill": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), c AS (
  SELECT doc_id, t, n,
         ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1,
         ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm'
              ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT doc_id, t, n, form, least(c1, c2) AS a, greatest(c1, c2) AS b,
         substr(t, 1, least(c1, c2)) AS pre,
         substr(t, least(c1, c2) + 1, greatest(c1, c2) - least(c1, c2)) AS mid,
         substr(t, greatest(c1, c2) + 1) AS suf
  FROM c
)
SELECT doc_id, n, form,
       CAST(CASE WHEN form <> 'plain' THEN a END AS DOUBLE) AS prefix_chars,
       CAST(CASE WHEN form <> 'plain' THEN b - a END AS DOUBLE) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
""",
    "op12_host_rules": """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM d
), grams AS (
  SELECT rid, u.i AS i, array_to_string(ws[u.i:u.i + 4], ' ') AS g FROM w, unnest(range(1, len(ws) - 3)) AS u(i)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT p.k) AS n FROM twice, unnest(range(i, i + 5)) AS p(k) GROUP BY rid
), f AS (
  SELECT w.rid, doc_id, source, len(ws) AS n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered ON w.rid = covered.rid
), tests AS (
  SELECT source, unnest(['few_words', 'repeats', 'symbols', 'dup_lines', 'word_length']) AS rule,
         unnest([n_words < 10, 100 * n_repeat_words > 20 * n_words, 10 * n_symbols > n_words,
                 100 * n_dup_lines > 30 * n_lines,
                 word_chars < 3 * n_words OR word_chars > 10 * n_words]) AS failed
  FROM f WHERE source IS NOT NULL
), h AS (
  SELECT source, rule, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (failed) AS DOUBLE) AS k
  FROM tests GROUP BY source, rule
), s AS (
  SELECT rule, CAST(count(*) AS DOUBLE) AS hosts, sum(n) AS n, sum(n * n) AS nn, sum(k) AS k, sum(k * k / n) AS kk
  FROM h GROUP BY rule
), v AS (
  SELECT rule, n, k / n AS mean,
         CASE WHEN hosts > 1 AND n > hosts THEN (kk - k * k / n) / (hosts - 1) END AS between_hosts,
         CASE WHEN hosts > 1 AND n > hosts THEN (k - kk) / (n - hosts) END AS within_hosts,
         CASE WHEN hosts > 1 THEN (n - nn / n) / (hosts - 1) END AS size
  FROM s
), r AS (
  SELECT rule, n, mean,
         coalesce((between_hosts - within_hosts) / nullif(between_hosts + (size - 1) * within_hosts, 0), 0) AS rho
  FROM v
), prior AS (
  SELECT rule, mean, greatest(1, least(CASE WHEN rho > 0 THEN (1 - rho) / rho ELSE n END, n)) AS strength FROM r
), bad AS (
  SELECT DISTINCT source FROM h JOIN prior USING (rule) WHERE (k + mean * strength) / (h.n + strength) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND bad.source IS NULL AS kept
FROM f LEFT JOIN bad ON f.source = bad.source
""",
    "op13_prefix_trie": """
WITH o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
           lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))
         ), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM o)
), r AS (
  SELECT convs.c, 0 AS own, o.pos, o.role, o.text FROM convs JOIN o ON o.c = convs.c - convs.c % 20 AND o.pos <= convs.h
  UNION ALL
  SELECT convs.c, 1, o.pos, o.role, o.text FROM convs JOIN o ON o.c = convs.c AND o.pos > convs.h
), p AS (
  SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS depth,
         array_agg(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY c ORDER BY own, pos) AS path
  FROM r
  UNION ALL
  SELECT c, '', '', 0, [] FROM convs
), ends AS (
  SELECT path, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids
  FROM (SELECT c, max_by(path, depth) AS path FROM p GROUP BY c) GROUP BY path
), n AS (
  SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, max(text) AS text FROM p GROUP BY path, depth
), w AS (
  SELECT n.*, (n_convs - 1) * len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS own,
         (SELECT count(*) FROM n AS x WHERE x.depth = n.depth + 1 AND x.path[1:n.depth] = n.path) AS n_children
  FROM n
), s AS (
  SELECT v.path, count(*) FILTER (u.n_children = 0) AS n_leaves, sum(u.own) AS saved
  FROM w AS v JOIN w AS u ON u.depth >= v.depth AND u.path[1:v.depth] = v.path GROUP BY v.path
)
SELECT w.conv_id, w.depth, CAST(up.conv_id AS DOUBLE) AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM w JOIN s ON s.path = w.path
LEFT JOIN w AS up ON up.depth = w.depth - 1 AND up.path = w.path[1:w.depth - 1]
LEFT JOIN ends ON ends.path = w.path
""",
}
