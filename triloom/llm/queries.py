"""Registered queries of the training-data operators, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, langid, lm, mixing, pii, tokencount, urlfilter, vectors

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of texts whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return jaccard.similar_groups(_table(spark, sf_dir, "documents"), words=4, percent=85)


SQL_OP4 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)]) END AS grams FROM w
), g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM c WHERE 100 * shared >= 85 * (na + nb - shared)
), r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT s.doc_id, len(s.grams)::BIGINT AS n_shingles, m.component_id
FROM s JOIN (SELECT id, min(reach) AS component_id FROM r GROUP BY 1) m ON m.id = s.doc_id
"""


#: Rules of the url query, in the operator's own form.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page url judged by the longest fitting rule."""
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"), rules)


SQL_OP1 = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (SELECT page_id, split_part(split_part(rest, '#', 1), '?', 1) AS bare FROM u
), p AS (
  SELECT page_id, translate(split_part(bare, '/', 1), '{UPPER}', '{LOWER}') AS host, substr(bare, length(split_part(bare, '/', 1)) + 1) AS path FROM b
), r(rule, verdict) AS (VALUES {", ".join(f"('{r}', '{v}')" for r, v in URL_RULES)}
), k AS (SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS q FROM r
), m AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM p JOIN k ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY 1
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text by the 32k piece vocabulary."""
    import public_tokenizers

    return tokencount.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every text shares with the benchmark in windows of ten words."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), cut_from=1 << 30)
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL_OP7 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents
), i AS (SELECT item_id, {_WORDS} AS words FROM benchmark
), w AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[p:p + least(10, len(words)) - 1], ' ') AS run
  FROM (SELECT item_id, words, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS p FROM i WHERE len(words) > 0)
), g AS (
  SELECT doc_id, p, n, array_to_string(words[p:p + n - 1], ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM d), (SELECT DISTINCT n FROM w) WHERE p + n - 1 <= len(words)
), m AS (SELECT doc_id, p, n, item_id FROM g JOIN w USING (n, run)
), h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY 1
), t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY 1
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from texts that are not held out."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~held_out), vocabulary)
    found = langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model, vocabulary)
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with a cosine of 0.95 or more."""
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


SQL_OP9 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), r AS (SELECT vec_id AS id, vec_id AS reach FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a
), m AS (SELECT id, min(reach) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT m.id AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.component_id, m.component_id = m.id AS kept FROM m LEFT JOIN n ON n.a = m.id
"""


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibrated probability of every document, and whether it is drawn."""
    found = mixing.probabilities(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return found.select("row.doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "kept")


def _sql_op2(mixture: mixing.Mixture) -> str:
    patterns = [(n, p.replace("'", "''")) for n, p in mixing.TOPICS]
    topic = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in patterns)
    steps, last = [], "c0"
    for d in mixing.DIMENSIONS:
        steps.append(f"t_{d} AS (SELECT {d}, pow(sum(tokens), {mixture.tempers[d]}) / sum(pow(sum(tokens), {mixture.tempers[d]})) OVER () AS target FROM c0 GROUP BY {d})")
    for k in range(mixture.rounds):
        for d in mixing.DIMENSIONS:
            steps.append(f"c{k}_{d} AS MATERIALIZED (SELECT source, lang, topic, tokens, weight * target / sum(weight) OVER (PARTITION BY {d}) AS weight FROM {last} JOIN t_{d} USING ({d}))")
            last = f"c{k}_{d}"
    steps.append("s0 AS (SELECT 0.0::DOUBLE AS scale)")
    for k in range(mixture.calibrations):
        over = "weight / tokens * scale >= 1"
        full = f"sum(CASE WHEN {over} THEN tokens ELSE 0 END)"
        free = f"sum(CASE WHEN {over} THEN 0 ELSE weight END)"
        steps.append(f"s{k + 1} AS MATERIALIZED (SELECT CASE WHEN {free} = 0 THEN any_value(scale) ELSE greatest(0, {mixture.part} * sum(tokens) - {full}) / {free} END AS scale FROM {last}, s{k})")
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, CASE {topic} ELSE '{mixing.OTHER}' END AS topic,
    len(regexp_extract_all(text, '[^ 	-
]+'))::BIGINT AS n_tokens FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents)
), c AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM d GROUP BY 1, 2, 3 HAVING sum(n_tokens) > 0
), c0 AS (SELECT *, tokens / sum(tokens) OVER () AS weight FROM c), {", ".join(steps)
}, p AS (SELECT source, lang, topic, least(1.0, weight / tokens * scale) AS probability FROM {last}, s{mixture.calibrations}
), r AS (SELECT d.*, CASE WHEN n_tokens > 0 THEN coalesce(probability, 0) ELSE 0 END AS probability FROM d LEFT JOIN p USING (source, lang, topic))
SELECT * REPLACE (round(probability, 6) AS probability), ('0x' || substr(md5('{mixture.seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0 < probability AS kept FROM r
"""


SQL_OP2 = _sql_op2(mixing.Mixture())


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: base spans, and all spans that the method finds."""
    found = pii.tag(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=("doc_id",))
    base = F.filter("spans", lambda x: x["base"])
    of = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind))
    counts = [of(k).cast("long").alias(f"n_{k}") for k in pii.KINDS[: pii.BASE]]
    return found.select("row.doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as canonical JSON; user turns count as calls that the next turn answers."""
    return chat.format_chats(_table(spark, sf_dir, "conversations"), implicit="respond")


SQL_OP5 = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS words FROM conversations
), m AS (
  SELECT conv_id, count(*) AS n, string_agg('{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || ',"turn":' || turn || '}', ',' ORDER BY turn) AS list FROM t GROUP BY 1
), a AS (SELECT DISTINCT conv_id, turn - 1 AS turn FROM t WHERE role = 'assistant'
), u AS (SELECT DISTINCT conv_id, turn FROM t WHERE role = 'user'
), c AS (SELECT t.*, a.turn IS NOT NULL AS answered FROM t LEFT JOIN a USING (conv_id, turn) WHERE role = 'user'
), k AS (
  SELECT conv_id, count(*) AS n, sum(answered::INT) AS linked, sum((words < 1)::INT) AS invalid, string_agg('{"after":["turn-' || (turn - 2) || '"],"answered":' || answered || ',"arguments":{"turn":' || turn || ',"words":' || words || '},"errors":[' ||
    CASE WHEN words < 1 THEN '"$.words: out of bounds"' ELSE '' END || '],"id":"turn-' || turn || '","name":"respond","result":' || CASE WHEN answered THEN '"turn ' || (turn + 1) || '"' ELSE 'null' END || ',"turn":' || turn || '}', ',' ORDER BY turn) AS list
  FROM c GROUP BY 1
), x AS (
  SELECT t.conv_id, t.turn, u.turn IS NULL AS orphan, row_number() OVER (PARTITION BY t.conv_id, t.turn) AS k, '{"content":"turn ' || t.turn || '","id":"turn-' || (t.turn - 1) || '","turn":' || t.turn || '}' AS item
  FROM t LEFT JOIN u ON u.conv_id = t.conv_id AND u.turn = t.turn - 1 WHERE t.role = 'assistant'
), o AS (SELECT conv_id, count(*) AS n, string_agg(item, ',' ORDER BY turn) AS list FROM x WHERE orphan GROUP BY 1
), e AS (SELECT conv_id, count(*) AS n, string_agg(item, ',' ORDER BY turn) AS list FROM x WHERE NOT orphan AND k > 1 GROUP BY 1)
SELECT m.conv_id, m.n AS n_messages, coalesce(k.n, 0) AS n_calls, coalesce(k.linked, 0)::BIGINT AS n_linked, coalesce(k.n - k.linked, 0)::BIGINT AS n_unanswered, coalesce(o.n, 0) AS n_orphans, coalesce(e.n, 0) AS n_repeats, coalesce(k.invalid, 0)::BIGINT AS n_invalid,
  '{"conversation":' || m.conv_id || ',"messages":[' || m.list || '],"orphans":[' || coalesce(o.list, '') || '],"repeats":[' || coalesce(e.list, '') || '],"tool_calls":[' || coalesce(k.list, '') || ']}' AS chat
FROM m LEFT JOIN k USING (conv_id) LEFT JOIN o USING (conv_id) LEFT JOIN e USING (conv_id)
"""


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pseudo-log-likelihood of every text under a network trained on all."""
    found = lm.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=("doc_id",))
    return found.select("row.doc_id", "n_words", "log_likelihood", F.col("mean").alias("mean_log_likelihood"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return {
        "op1_url_filter": op1_url_filter,
        "op2_source_mixing": op2_source_mixing,
        "op3_language_id": op3_language_id,
        "op4_ngram_jaccard": op4_ngram_jaccard,
        "op5_chat_format": op5_chat_format,
        "op6_token_counts": op6_token_counts,
        "op7_decontamination": op7_decontamination,
        "op8_personal_data": op8_personal_data,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_lm_score": op10_lm_score,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by name."""
    return {"op1_url_filter": SQL_OP1, "op2_source_mixing": SQL_OP2, "op4_ngram_jaccard": SQL_OP4, "op5_chat_format": SQL_OP5, "op7_decontamination": SQL_OP7, "op9_embedding_dedup": SQL_OP9}
