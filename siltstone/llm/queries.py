"""One registered query for each corpus operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark, sf_dir):
    from .decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark, sf_dir):
    from .linededup import line_report

    return line_report(_table(spark, sf_dir, "documents"))


def op3_token_files(spark, sf_dir):
    import public_tokenizers

    from .tokenfile import read_tokens, write_tokens

    manifest = write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(manifest)


def op4_toxicity(spark, sf_dir):
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_edit_fingerprints(spark, sf_dir):
    from .editfp import near_classes, fingerprint_report
    from .shared import cut

    rows = cut(fingerprint_report(_table(spark, sf_dir, "documents")), "edit-fps")
    classes = near_classes(rows.select("doc_id", "fingerprint", "grids"))
    return rows.drop("grids").join(classes.hint("merge"), "fingerprint", "left")


def op6_pii(spark, sf_dir):
    from .pii import personal_data

    return personal_data(_table(spark, sf_dir, "documents"))


def op7_warc(spark, sf_dir):
    from .warc import archive_report, write_archives

    return archive_report(*write_archives(_table(spark, sf_dir, "pages")))


def op8_sentencepiece(spark, sf_dir):
    import public_tokenizers

    from .pieces import encode

    return encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_secrets(spark, sf_dir):
    from .secrets import secrets

    return secrets(_table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark, sf_dir):
    from .simhash import near_components

    return near_components(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark, sf_dir):
    from .trie import prefix_trie

    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark, sf_dir):
    from .negatives import hard_negatives

    return hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_chat_format(spark, sf_dir):
    from .chat import chat_report

    return chat_report(_table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_line_dedup, op3_token_files, op4_toxicity, op5_edit_fingerprints,
        op6_pii, op7_warc, op8_sentencepiece, op9_secrets, op10_simhash_near_dedup,
        op11_prefix_trie, op12_hard_negatives, op13_chat_format,
    )
}

ORACLE_SQL = {
    "op7_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
     q AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS d FROM p),
     r AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS keeper FROM q)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM r""",
    # crc32 bit by bit over the decimal id; a node's key is the concatenated digests of its turns.
    "op11_prefix_trie": r"""
WITH t AS (SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
  c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda b, y: xor(b >> 1, (b & 1) * 3988292384))), 4294967295) % 4 AS h FROM t),
  n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
  r AS (SELECT c.conv_id, pos AS i, d, w FROM c JOIN t ON t.conv_id = base AND pos <= h UNION ALL
    SELECT c.conv_id, pos - h + least(h, coalesce(n.n, 0)), d, w FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h LEFT JOIN n ON n.conv_id = base),
  m AS (SELECT conv_id, 0 AS depth, '' AS k, 0 AS w FROM c UNION ALL SELECT conv_id, i, string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY i), w FROM r),
  l AS (SELECT conv_id, max(depth) AS deepest FROM m GROUP BY conv_id),
  nd AS (SELECT k, depth, left(k, 64 * (depth - 1)::INT) AS up, min(conv_id) AS c, count(*) AS n, max(w) AS w, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = deepest), '') AS ends FROM m JOIN l USING (conv_id) GROUP BY k, depth),
  kids AS (SELECT up AS k, depth - 1 AS depth, count(*) AS n_children FROM nd WHERE depth > 0 GROUP BY ALL),
  full_nodes AS (SELECT nd.*, coalesce(n_children, 0) AS n_children FROM nd LEFT JOIN kids USING (k, depth)),
  sub AS (SELECT a.k, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n - 1) * b.w) AS saved FROM full_nodes a JOIN full_nodes b ON b.depth >= a.depth AND starts_with(b.k, a.k) GROUP BY a.k)
SELECT x.c AS conv_id, x.depth::BIGINT AS depth, p.c AS parent_conv_id, x.n AS n_convs, x.n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM full_nodes x JOIN sub USING (k) LEFT JOIN nd p ON x.depth > 0 AND p.k = x.up AND p.depth = x.depth - 1""",
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5""",
    # The template's marks have fixed lengths; every control string in a text is one character longer.
    "op13_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
  e AS (SELECT *, length(text) + len(regexp_extract_all(text, '<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>|\[\\*ROLE\]|\[\\*/ROLE\]|\[\\*/TURN\]')) AS n,
    length(role) + len(regexp_extract_all(role, '<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>|\[\\*ROLE\]|\[\\*/ROLE\]|\[\\*/TURN\]')) AS r FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(n + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 WHEN 'system' THEN 19 ELSE r + 22 END))::BIGINT AS formatted_chars, 0::BIGINT AS n_rewrites
FROM e GROUP BY conv_id""",
}
