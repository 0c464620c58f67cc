"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folianta.llm import chat, decontam, exactdedup, licenses, mixing, neardup, pii, sharding, toxicity, warc
from folianta.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40, map_path=sharding.map_path_of(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_conversations(turns.unionByName(chat.probe(spark))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_license_scan, op2_sharding, op3_toxicity, op4_minhash_near_dedup, op5_mixing, op6_pii, op7_benchmark_decontamination, op8_exact_dedup, op9_warc, op10_chat_formatting)
    return {f.__name__: f for f in found}


def _op5_sql() -> str:
    """The raking of ``mixing`` with one step of SQL for each margin of each sweep."""
    dims = mixing.DIMENSIONS
    steps = [
        r"""d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t,
         length(coalesce(text, '')) AS n FROM documents
), r AS (
  SELECT doc_id, source, lang, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens,
    CASE WHEN NOT regexp_matches(t, '[^\x20\x09-\x0D]') THEN 'empty'
         WHEN len(regexp_extract_all(t, '[0-9]')) * 5 > n THEN 'data'
         WHEN len(regexp_extract_all(t, '[A-Z]')) * 4 > n THEN 'shout'
         WHEN (n - length(replace(t, '|', ''))) * 40 > n THEN 'table'
         WHEN n < 200 THEN 'brief' ELSE 'prose' END AS topic FROM d
), cells AS (
  SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM r GROUP BY ALL HAVING sum(tokens) > 0
)""",
    ]
    for d in dims:
        steps.append(f"to_{d} AS (SELECT {d}, pow(t / sum(t) OVER (), {mixing.TEMPER}) AS given FROM (SELECT {d}, sum(tokens) AS t FROM cells GROUP BY {d}))")
    joins = " ".join(f"JOIN (SELECT {d}, given / sum(given) OVER () AS to_{d} FROM to_{d}) USING ({d})" for d in dims)
    steps.append(f"w0 AS (SELECT source, lang, topic, tokens, tokens AS weight, {', '.join(f'to_{d}' for d in dims)} FROM cells {joins})")
    k = 0
    for _ in range(mixing.SWEEPS):
        for d in dims:
            steps.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (weight * to_{d} / sum(weight) OVER (PARTITION BY {d}) AS weight) FROM w{k})")
            k += 1
    steps.append(f"p AS (SELECT source, lang, topic, round(weight / tokens * (SELECT sum(tokens) FROM cells) * {mixing.KEEP}, {mixing.PLACES}) AS p FROM w{k})")
    draw = "CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0"
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, r.source, r.lang, r.topic, tokens, round(least(coalesce(p, 1.0), 1.0), 6) AS probability,
       round(greatest(coalesce(p, 1.0), 1.0), 6) AS weight, {draw} < coalesce(p, 1.0) AS sampled,
       CAST(floor(coalesce(p, 1.0)) AS BIGINT) + CAST({draw} < coalesce(p, 1.0) - floor(coalesce(p, 1.0)) AS BIGINT) AS copies
FROM r LEFT JOIN p ON r.source = p.source AND r.lang = p.lang AND r.topic = p.topic"""


#: Every pair of equal words, by alignment; a window of 13 places with 11 pairs or more is an overlap.
OP7_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), bw AS (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), dt AS (
  SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS pos FROM dw WHERE len(w) >= 13
), bt AS (
  SELECT item_id, unnest(w) AS t, generate_subscripts(w, 1) AS pos FROM bw WHERE len(w) >= 13
), eq AS (
  SELECT DISTINCT doc_id, item_id, dt.pos - bt.pos AS shift, bt.pos AS pos FROM dt JOIN bt ON dt.t = bt.t
), run AS (
  SELECT doc_id, item_id, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY pos RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n FROM eq
), hit AS (
  SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM run WHERE n >= 11 GROUP BY doc_id
)
SELECT d.doc_id, h.items IS NOT NULL AS contaminated, CAST(coalesce(len(h.items), 0) AS BIGINT) AS n_items,
       coalesce(array_to_string(h.items, ','), '') AS items
FROM documents d LEFT JOIN hit h ON d.doc_id = h.doc_id
"""


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), g AS (
  SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.body) AS text_sha256
FROM n JOIN g ON n.body = g.body
"""


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), o AS (
  SELECT d, min(page_id) AS owner FROM p WHERE n >= 100 GROUP BY d
)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN p.page_id > o.owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id > o.owner THEN o.owner END AS refers_to
FROM p LEFT JOIN o ON p.d = o.d AND p.n >= 100
"""


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(regexp_replace(r, '(### |</turn>)', '\\\1', 'g')) + length(regexp_replace(t, '(### |</turn>)', '\\\1', 'g')) + 14 AS n FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
       CAST(sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def _op1_sql() -> str:
    """Every segment against every template, with sets of bigrams as lists."""
    quoted = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, _, text) in enumerate(licenses.TEMPLATES))
    grams = lambda c: f"""list_distinct(CASE WHEN len({c}) < 2 THEN {c} ELSE list_transform(range(1, len({c})), lambda i: {c}[i] || ' ' || {c}[i + 1]) END)"""
    word = r"regexp_extract_all(lower({}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
    low, high = f"g.n >= ceil(t.n * {licenses.DICE} / (2 - {licenses.DICE}) - 1e-9)", f"g.n <= floor(t.n * (2 - {licenses.DICE}) / {licenses.DICE} + 1e-9)"
    return rf"""
WITH tw(i, name, w) AS (SELECT i, name, {word.format("txt")} FROM (VALUES {quoted}) AS v(i, name, txt)),
t AS (SELECT i, name, {grams("w")} AS g, len({grams("w")}) AS n FROM tw),
s AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS seg FROM documents
  UNION ALL SELECT doc_id, unnest(string_split_regex(text, '\n[\x20\x09-\x0D]*\n')) FROM documents
  UNION ALL SELECT doc_id, text FROM documents
), sw AS (SELECT doc_id, {word.format("seg")} AS w FROM s),
g AS (SELECT doc_id, {grams("w")} AS g, len({grams("w")}) AS n FROM sw WHERE len(w) >= 2),
m AS (
  SELECT g.doc_id, t.name, max(2.0 * len(list_intersect(g.g, t.g)) / (g.n + t.n)) AS dice
  FROM g JOIN t ON {low} AND {high} WHERE list_has_any(g.g, t.g) GROUP BY ALL
), k AS (
  SELECT doc_id, count(*) AS n_licenses, string_agg(name || ':' || CAST(CAST(round(dice * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY name) AS licenses
  FROM m WHERE dice >= {licenses.DICE} - 1e-12 GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _op1_sql(), "op5_mixing": _op5_sql(), "op7_benchmark_decontamination": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op9_warc": OP9_SQL, "op10_chat_formatting": OP10_SQL}
