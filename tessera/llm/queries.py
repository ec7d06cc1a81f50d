"""The operators' queries over the given tables, and their SQL twins where SQL can express them.

No twin for op4 and op6 (tokenizers), op5 (compressed sizes), op8 (XXH64) and op12 (places of matches): those are tested
against the libraries and against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import arc, bpe, chat, disclosure, infill, knn, lexical, licenses, mixing, quality, secret_scan, simhash, token_counts
from tessera.llm.common import WORD, table
from tessera.session import ship_package

_OPERATORS = {
    "op1_arc_to_warc": (["pages"], arc.op1),
    "op2_quality_rules": (["documents"], quality.op2),
    "op3_voronoi_top_k": (["embeddings"], knn.op3),
    "op4_bpe_replay": (["documents"], bpe.op4),
    "op5_secret_novelty": (["documents"], secret_scan.op5),
    "op6_token_counts": (["documents"], token_counts.op6),
    "op7_source_mix": (["documents"], mixing.op7),
    "op8_simhash_covering": (["documents"], simhash.op8),
    "op9_license_join": (["documents"], licenses.op9),
    "op10_chat_examples": (["conversations"], chat.op10),
    "op11_ranked_search": (["documents", "benchmark"], lexical.op11),
    "op12_disclosing_terms": (["documents"], disclosure.op12),
    "op13_seekable_infill": (["documents"], infill.op13),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(names: list[str], operator: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return operator(*[table(spark, sf_dir, name) for name in names])

        return run

    return {query: bind(*of) for query, of in _OPERATORS.items()}


ARC_TO_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
         list_aggregate(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT) + 1, 1)), 'string_agg', '') AS payload_digest
  FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS k,
             min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k > 1 THEN least END AS refers_to
FROM n
"""

_LINE_FAILS = rf"""
 (len(regexp_extract_all(line, '{quality.MARKED}')) * 10 > n
  OR (len(regexp_extract_all(line, '{quality.SYMBOLS}')) * 10 > n AND len(regexp_extract_all(line, '{quality.SYMBOLS}')) > 1)
  OR len(list_filter(w, lambda x: x IN ({", ".join(f"'{s}'" for s in quality.SEPARATORS)}))) >= 3
  OR (n > 0 AND n < 3 AND NOT regexp_matches(line, '{quality.CLOSING.replace("'", "''")}'))
  OR (n <= {quality.BOILERPLATE_WORDS} AND regexp_matches(lower(line), '{quality.BOILERPLATE}')))
"""

QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT rid, i, w[i : i + 4] AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, i + unnest(range(0, 5)) AS p FROM hit) GROUP BY rid),
line AS (SELECT rid, line, regexp_extract_all(line, '{WORD}') AS w, len(regexp_extract_all(line, '{WORD}')) AS n
         FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)),
by_doc AS (
  SELECT rid, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dup,
         coalesce(sum(CASE WHEN {_LINE_FAILS} THEN length(array_to_string(w, '')) END), 0) AS lost
  FROM line GROUP BY rid),
c AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '{quality.SYMBOLS}')) AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, lost
  FROM d JOIN by_doc USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.REPEATED} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost <= word_chars * CAST({quality.LOST} AS DOUBLE) AS kept
FROM b
"""

TOP_K = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({knn.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.rid, q.vec_id AS query_id, d.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * d.e[i])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.rid <> d.rid WHERE q.vec_id % {knn.EVERY} = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= {knn.K}
"""

MIX = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS letters,
         (CAST(CAST('0x' || substr(md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), md5(text), 'null')), 1, 13) AS BIGINT) AS DOUBLE)
          + CAST(0.5 AS DOUBLE)) / CAST({int(mixing.UNIT)} AS DOUBLE) AS u
  FROM documents),
k AS (
  SELECT *, -ln(u) / greatest(CAST(1 AS DOUBLE) - abs(CAST(letters AS DOUBLE) / greatest(size, 1) - CAST(5 AS DOUBLE)) / CAST(10 AS DOUBLE),
                              CAST(0.25 AS DOUBLE)) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][(r - 1) % 3 + 1] AS BIGINT) AS weight, {mixing.CAP} * source_size AS cap FROM s),
l AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS ratio,
         (CAST({mixing.SHARE} AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(cap) OVER o, 0) AS DOUBLE))
         / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS level
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level AS common FROM l WHERE ratio >= level ORDER BY ratio, r LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN common IS NULL OR ratio < common THEN CAST(cap AS DOUBLE) ELSE weight * common END AS target
  FROM l LEFT JOIN f ON true),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS complete FROM t),
c AS (
  SELECT doc_id, size, source_size, target, complete,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         + size / CAST(2 AS DOUBLE) AS middle
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST((complete + CASE WHEN middle <= target - complete * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM c
"""

_TEMPLATES = ", ".join(f"('{label}', string_split('{notice}', ' '))" for label, notice in licenses.TEMPLATES)
_PLACES = ", ".join(
    f"list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i : i + {len(p.split()) - 1}] = {p.split()!r}), lambda i: i - 1) AS p{k}"
    for k, p in enumerate(licenses.PHRASES)
)

LICENSES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lower(coalesce(text, '')) AS t FROM documents),
ws AS (SELECT *, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
ps AS (SELECT rid, doc_id, len(w) AS n, {_PLACES} FROM ws),
base AS (
  SELECT rid, doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(p0) + len(p1) + len(p2) AS BIGINT) AS n_base,
         CAST(list_min(p0 || p1 || p2) AS BIGINT) AS first_word, CAST(list_max(p0 || p1 || p2) AS BIGINT) AS last_word,
         list_filter([CASE WHEN len(p0) > 0 THEN 'cc-by' END, CASE WHEN len(p1) > 0 THEN 'gpl' END, CASE WHEN len(p2) > 0 THEN 'reserved' END],
                     lambda x: x IS NOT NULL) AS labels
  FROM ps),
ln AS (
  SELECT rid, i, regexp_extract_all(ls[i], '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT rid, string_split(t, chr(10)) AS ls, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d)),
bl AS (
  SELECT a.rid, a.i, b.i AS j, b.w, sum(len(b.w)) OVER (PARTITION BY a.rid, a.i ORDER BY b.i) AS upto
  FROM ln a JOIN ln b ON b.rid = a.rid AND b.i BETWEEN a.i AND a.i + {licenses.LINES - 1}),
lines AS (SELECT rid, list_distinct(flatten(list(w))) AS words FROM bl WHERE j = i OR upto <= {licenses.BLOCK_WORDS} GROUP BY rid, i),
tpl AS (SELECT label, list_distinct(ws) AS ws FROM (VALUES {_TEMPLATES}) v(label, ws)),
hits AS (
  SELECT rid, label, len(list_intersect(words, ws)) / CAST(len(ws) AS DOUBLE) AS contained
  FROM lines CROSS JOIN tpl WHERE len(list_intersect(words, ws)) >= ceil(CAST({licenses.CONTAINED} AS DOUBLE) * len(ws))),
per AS (SELECT rid, list(DISTINCT label) AS added, max(contained) AS contained FROM hits GROUP BY rid)
SELECT doc_id, n_words, n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(labels || coalesce(added, []))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(contained, CAST(0 AS DOUBLE)) END AS score
FROM base LEFT JOIN per USING (rid)
"""

CHAT = rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {chat.CONTROL_ID}, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '{chat.CONTROL_TEXT}' FROM range(2) x(i)),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
         length(regexp_replace(role, '([\\#<:])', '__', 'g')) + length(regexp_replace(text, '([\\#<])', '__', 'g'))
         + {len(chat.OPEN) + len(chat.COLON) + len(chat.CLOSE)} AS chars
  FROM r),
c AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM n)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
d1 AS (SELECT rid, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
g AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d1),
i AS (SELECT row_number() OVER () AS iid, item_id, {_TERMS} AS w FROM benchmark),
q AS (SELECT iid, item_id, t, count(*) AS times FROM (SELECT iid, item_id, unnest(w) AS t FROM i) GROUP BY ALL),
tf AS (SELECT rid, doc_id, n, t, count(*) AS tf FROM (SELECT rid, doc_id, n, unnest(w) AS t FROM d1) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
wt AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM df, g),
im AS (SELECT rid, doc_id, t, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * n * docs) // terms)))) AS impact
       FROM tf JOIN wt USING (t), g),
s AS (SELECT iid, item_id, rid, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM q JOIN im USING (t) GROUP BY ALL)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS FIRST) AS r FROM s WHERE score > 0) WHERE r <= {lexical.K}
"""

INFILL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('{infill.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
k AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, u,
         CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= {infill.PLAIN_FROM} THEN 'plain'
              WHEN h4 % 100 < {infill.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle,
         array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_arc_to_warc": ARC_TO_WARC,
        "op2_quality_rules": QUALITY,
        "op3_voronoi_top_k": TOP_K,
        "op7_source_mix": MIX,
        "op9_license_join": LICENSES,
        "op10_chat_examples": CHAT,
        "op11_ranked_search": RANKED,
        "op13_seekable_infill": INFILL,
    }
