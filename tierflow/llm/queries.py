"""One query per operator over the given tables, and the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .conversations import audits, damaged
from .decontaminate import decontaminate
from .divergence import LEAST_DOCS as LEAST_TERM_DOCS, MOST_TERMS, SCALE, divergence
from .extraction import extract
from .lines import drop_repeated_chunks
from .mixing import mix
from .nearest import top_k
from .quality import resample
from .rules import BITS, COUNTS, LEAST_DOCS, LEAST_WORDS, MOST_REPEATED_PERCENT, SPREAD, judged
from .simhash import near_duplicates
from .substrings import remove_repeats
from .urls import BLOCK_PER_PAGE, DAMPING, LEAST_MASS, MOST_STEPS, judge
from .warc import round_trip


def op1_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "labels")).select("doc_id", "log_weight", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NORMAL = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH items AS (SELECT item_id, {_NORMAL} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k,
         array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS pattern
  FROM items, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(i) WHERE len(w) > 0),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_NORMAL}, []) AS w FROM documents),
places AS (
  SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS pattern
  FROM docs, (SELECT DISTINCT k FROM windows), unnest(range(1, len(w) - k + 2)) AS t(i)),
hits AS (SELECT r, k, i, item_id FROM places JOIN windows USING (k, pattern)),
words AS (SELECT r, count(DISTINCT i + j) AS n_hit
          FROM hits, unnest(range(0, k)) AS t(j) GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n_items,
                 string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
          FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""


URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), URL_RULES)


_RULES = ", ".join(
    f"('{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}', '{verdict}')"
    for rule, verdict in URL_RULES.items()
)

OP3_SQL = rf"""
WITH RECURSIVE rules(rule, name, start, said) AS (VALUES {_RULES}),
read AS (
  SELECT row_number() OVER () AS r, page_id, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT r, page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(said, length(rule)) AS said
  FROM read LEFT JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)
  GROUP BY ALL),
hosts AS (
  SELECT host, count(*) AS pages, count(*) FILTER (said = 'allow') AS trust,
         count(*) FILTER (said = 'block') AS distrust
  FROM ruled WHERE host <> '' GROUP BY host),
hrefs AS (
  SELECT host AS src, unnest(regexp_extract_all(html,
    '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["'']?\s*([^"''\s>]+)', 1)) AS href
  FROM read WHERE host <> ''),
whole AS (SELECT src, CASE WHEN starts_with(href, '//') THEN 'http:' || href ELSE href END AS href FROM hrefs),
links AS (
  SELECT DISTINCT src, translate(regexp_extract(href, '(?s)^.*?://([^/?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
  FROM whole WHERE regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*://')),
edges AS (SELECT * FROM links WHERE dst <> '' AND dst <> src),
steps AS (
  SELECT 'trust' AS kind, src AS host, dst AS next, {DAMPING} / count(*) OVER (PARTITION BY src) AS part
  FROM edges UNION ALL
  SELECT 'distrust', dst, src, {DAMPING} / count(*) OVER (PARTITION BY dst) FROM edges),
walk(host, kind, step, mass) AS (
  SELECT host, 'trust', 0, trust::DOUBLE FROM hosts WHERE trust > 0 UNION ALL
  SELECT host, 'distrust', 0, distrust::DOUBLE FROM hosts WHERE distrust > 0 UNION ALL
  SELECT next, kind, step + 1, sum(mass * part) FROM walk JOIN steps USING (host, kind)
  WHERE step < {MOST_STEPS} GROUP BY next, kind, step HAVING sum(mass * part) >= {LEAST_MASS}),
mass AS (
  SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS trust,
         coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS distrust
  FROM walk GROUP BY host),
blocked AS (
  SELECT host FROM hosts JOIN mass USING (host)
  WHERE mass.distrust >= {BLOCK_PER_PAGE} * pages AND mass.distrust > mass.trust)
SELECT page_id, host, path, rule,
       coalesce(said, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' END, 'allow') AS verdict
FROM ruled
"""


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


#: Blocks a round takes of each source; other sources share one block.
MIX_WEIGHTS = {"src0": 10, "src1": 8, "src2": 6, "src3": 5, "src4": 4, **{f"src{n}": 3 for n in range(5, 20)}}
MIX_BLOCK_ROWS = 16


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, MIX_WEIGHTS, MIX_BLOCK_ROWS)


_SHARES = ", ".join(f"({n}, '{s}', {w})" for n, (s, w) in enumerate([*MIX_WEIGHTS.items(), ("(other)", 1)]))

OP5_SQL = f"""
WITH RECURSIVE shares(src, name, share) AS (VALUES {_SHARES}),
rows AS (
  SELECT doc_id, source, coalesce(src, {len(MIX_WEIGHTS)}) AS src,
         row_number() OVER (PARTITION BY coalesce(src, {len(MIX_WEIGHTS)})
           ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS n
  FROM documents LEFT JOIN shares ON source = name AND src < {len(MIX_WEIGHTS)}),
sizes AS (
  SELECT src, share, (count(n) + {MIX_BLOCK_ROWS - 1}) // {MIX_BLOCK_ROWS} AS blocks
  FROM shares LEFT JOIN rows USING (src) GROUP BY src, share),
rounds AS (
  SELECT round, src, least(share, greatest(0, blocks - round * share)) AS m,
         sum(least(blocks, round * share)) OVER (PARTITION BY round) AS base
  FROM sizes, (SELECT unnest(range(0, (SELECT max((blocks + share - 1) // share) FROM sizes))) AS round)),
kinds AS (
  SELECT round, any_value(base) AS base, list(m ORDER BY src) AS m, sum(m)::BIGINT AS len
  FROM rounds GROUP BY round),
distinct_kinds AS (SELECT DISTINCT m, len FROM kinds),
fold(m, len, t, done, next) AS (
  SELECT m, len, 0::BIGINT, list_transform(m, lambda x: 0::BIGINT), NULL::BIGINT FROM distinct_kinds
  UNION ALL
  SELECT m, len, t + 1, list_transform(done, lambda d, i: CASE WHEN i = pick THEN d + 1 ELSE d END), pick
  FROM (SELECT *, list_min(list_filter(list_transform(done, lambda d, i:
            CASE WHEN d < m[i] AND d * len // m[i] <= t
                 THEN ((d + 1) * len + m[i] - 1) // m[i] * 1000 + i END),
          lambda x: x IS NOT NULL)) % 1000 AS pick
        FROM fold WHERE t < len)),
slots AS (SELECT m, t - 1 AS slot, next - 1 AS src, done[next] - 1 AS turn FROM fold WHERE t > 0)
SELECT doc_id, source, name AS mix_source, (base + slot)::BIGINT AS block,
       (n % {MIX_BLOCK_ROWS})::INTEGER AS row_in_block,
       ((base + slot) * {MIX_BLOCK_ROWS} + n % {MIX_BLOCK_ROWS})::BIGINT AS position
FROM rows JOIN shares USING (src)
JOIN kinds ON kinds.round = n // {MIX_BLOCK_ROWS} // share
JOIN slots ON slots.m = kinds.m AND slots.src = rows.src AND slots.turn = n // {MIX_BLOCK_ROWS} % share
"""


def op6_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


OP6_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex
  FROM pages),
d AS (
  SELECT *, list_aggregate(list_transform(range(0, 32), lambda i: substr(
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1,
           1)), 'string_agg', '') AS payload_digest
  FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_bytes, hex) AS winner FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM w
"""


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


OP9_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT r, doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS p
  FROM docs, unnest(range(1, len(w) - 18)) AS t(i)),
ranked AS (SELECT r, i, row_number() OVER (PARTITION BY p ORDER BY doc_id, i) AS n FROM windows),
gone AS (
  SELECT r, list(DISTINCT i + j) AS places
  FROM ranked, unnest(range(0, 20)) AS t(j) WHERE n > 1 GROUP BY r),
cut AS (
  SELECT doc_id, len(w) AS n_words, coalesce(len(places), 0) AS n_removed,
         CASE WHEN places IS NULL THEN w
              ELSE list_filter(w, lambda x, i: NOT list_contains(places, i)) END AS kept
  FROM docs LEFT JOIN gone USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM cut
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_chunks(docs)


OP10_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS lines
  FROM documents),
lines AS (
  SELECT r, doc_id, i, lines[i] AS line,
         ('0x' || substr(md5(lines[i]), 1, 8))::BIGINT AS h
  FROM docs, unnest(range(1, len(lines) + 1)) AS t(i)),
ends AS (
  SELECT *, ((31 * coalesce(lag(h) OVER w, 0) + h) % 3 = 0)::INT AS ending
  FROM lines WINDOW w AS (PARTITION BY r ORDER BY i)),
dealt AS (
  SELECT *, coalesce(sum(ending) OVER (PARTITION BY r ORDER BY i
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM ends),
chunks AS (
  SELECT r, doc_id, chunk, string_agg(line, chr(10) ORDER BY i) AS body,
         count(*) AS n, count(*) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]')) AS filled
  FROM dealt GROUP BY ALL),
ranked AS (
  SELECT *, filled >= 2 AND row_number() OVER (
           PARTITION BY body, filled >= 2 ORDER BY doc_id, chunk) > 1 AS gone FROM chunks)
SELECT doc_id, CASE WHEN any_value(text) IS NULL THEN NULL
       ELSE coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (NOT gone), '') END AS text,
       coalesce(sum(n), 0)::BIGINT AS n_lines,
       coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed
FROM docs LEFT JOIN ranked USING (r, doc_id) GROUP BY r, doc_id
"""


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits(damaged(table(spark, sf_dir, "conversations")), absent="absent")


def _move(state: str, cost: str, letter: str, line: str = "''") -> str:
    """SQL for an end of ``state`` with one edit more."""
    return (
        f"{{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}', 'text': {state}.text || {line}}}"
    )


def _way(when: str, state: str, *edit: str) -> str:
    return f"CASE WHEN {when} AND {state} IS NOT NULL THEN {_move(state, *edit)} END"


def _insert(state: str, role: str) -> str:
    return _way("true", state, "2", "I", f"chr(10) || '{role}:'")


def _ways(state: str) -> str:
    """SQL for a state's best end after one more row."""
    to = {"n": [], "s": ["n"], "u": ["n", "s", "a"], "a": ["u"]}[state]
    role = {"u": "user", "a": "assistant"}.get(state)
    ways = [_way("true", f"d.{state}", "3", "D")]
    for before in to:
        keep = f"NOT must AND first = '{state}'"
        ways.append(_way(keep, f"d.{before}", "late", "K", "chr(10) || role || ':' || text"))
        if role:
            ways.append(_way("NOT must", f"d.{before}", "2 + late", "R", f"chr(10) || '{role}:' || text"))
    return f"least({', '.join([*ways, 'NULL'])})"


_EMPTY = "{'cost': 0, 'audit': '', 'text': ''}"

#: Null ids are not told apart from a space here; the given rows have none.
OP11_SQL = rf"""
WITH RECURSIVE bits(n, k, c) AS (
  SELECT n, 0, n FROM (SELECT unnest(range(0, 256)) AS n) UNION ALL
  SELECT n, k + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) FROM bits WHERE k < 8),
crcs AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
told AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
dealt AS (
  SELECT *, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: ord(key[i])::BIGINT),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS kind
  FROM told, crcs),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM dealt, unnest(range(0, CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS c(copy) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM hurt),
seen AS (
  SELECT *, left(role, 1) AS first, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair
  FROM placed),
faults AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate'
                 WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM seen),
rows AS (SELECT *, fault IN ('blank', 'duplicate') AS must, (fault = 'truncated')::INT AS late FROM faults),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS k
  FROM rows GROUP BY conv_id),
ends(conv_id, k, n, s, u, a) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {_EMPTY},
         CASE WHEN false THEN {_EMPTY} END,
         {{'cost': 2, 'audit': 'I', 'text': chr(10) || 'user:'}},
         {{'cost': 4, 'audit': 'II', 'text': chr(10) || 'user:' || chr(10) || 'assistant:'}} FROM told
  UNION ALL
  SELECT conv_id, k, n, s, u, least(a, {_insert("u", "assistant")}) FROM (
    SELECT conv_id, k, n, s, a,
           least(u, {_insert("n", "user")}, {_insert("s", "user")}, {_insert("a", "user")}) AS u
    FROM (SELECT d.conv_id, r.k, {_ways("n")} AS n, {_ways("s")} AS s, {_ways("u")} AS u, {_ways("a")} AS a
          FROM ends d JOIN rows r ON r.conv_id = d.conv_id AND r.k = d.k + 1))),
best AS (
  SELECT ends.conv_id, least(n, a) AS e, gaps, blank, duplicate, truncated, illegal
  FROM ends LEFT JOIN counted USING (conv_id) WHERE ends.k = coalesce(counted.k, 0))
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, e.cost::BIGINT AS cost, e.audit AS audit,
       sha256(e.text[2:]) AS repaired_sha256
FROM best
"""


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *COUNTS, "base_failed", "kept")


_LEVELS = " UNION ALL ".join(
    f"SELECT {n} AS level, {keys}, rate, b, sum(texts) AS texts FROM sketches GROUP BY ALL"
    for n, keys in enumerate(["lang, source", "lang, NULL AS source", "NULL AS lang, NULL AS source"])
)

OP12_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(list_slice(w, i, i + 2), ' ')) AS n
  FROM docs, unnest(range(1, len(w) - 1)) AS t(i)),
again AS (SELECT r, count(DISTINCT i + j) AS n FROM windows, unnest([0, 1, 2]) AS t(j) WHERE n > 1 GROUP BY r),
counts AS (
  SELECT r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines
  FROM docs LEFT JOIN again USING (r)),
judged AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM counts),
passing AS (SELECT * FROM judged WHERE NOT base_failed),
rates AS (
  SELECT r, lang, source, 'symbol_rate' AS rate, 1000 * n_symbols // n_words AS v FROM passing UNION ALL
  SELECT r, lang, source, 'repeat_rate', 1000 * n_repeat_words // n_words FROM passing UNION ALL
  SELECT r, lang, source, 'line_rate', 1000 * n_dup_lines // greatest(n_lines, 1) FROM passing UNION ALL
  SELECT r, lang, source, 'word_length', 100 * word_chars // n_words FROM passing),
sketches AS (
  SELECT lang, source, rate, (v >> greatest(length(bin(v)) - {BITS}, 0)) << greatest(length(bin(v)) - {BITS}, 0) AS b,
         count(*) AS texts FROM rates GROUP BY ALL),
levels AS ({_LEVELS}),
ranked AS (
  SELECT *, b + (1::BIGINT << greatest(length(bin(b)) - {BITS}, 0)) - 1 AS e, sum(texts) OVER w AS total,
         sum(texts) OVER (w ORDER BY b) AS upto
  FROM levels WINDOW w AS (PARTITION BY level, lang, source, rate)),
quartiles AS (
  SELECT level, lang, source, rate, max(total) AS texts, min(b) FILTER (4 * upto >= total) AS quarter,
         min(b) FILTER (2 * upto >= total) AS low, min(e) FILTER (2 * upto >= total) AS high
  FROM ranked GROUP BY ALL),
cuts AS (
  SELECT level, lang, source, rate, texts, high + room AS upper, CASE WHEN rate = 'word_length' THEN low - room ELSE 0 END AS lower
  FROM (SELECT *, {SPREAD} * greatest(high - quarter, CASE rate WHEN 'symbol_rate' THEN 25 WHEN 'word_length' THEN high // 20 ELSE 75 END) AS room
        FROM quartiles)),
failed AS (
  SELECT DISTINCT r FROM rates
  JOIN cuts o ON o.level = 0 AND o.lang IS NOT DISTINCT FROM rates.lang AND o.source IS NOT DISTINCT FROM rates.source AND o.rate = rates.rate
  JOIN cuts l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM rates.lang AND l.rate = rates.rate
  JOIN cuts a ON a.level = 2 AND a.rate = rates.rate
  WHERE NOT v BETWEEN CASE WHEN o.texts >= {LEAST_DOCS} THEN o.lower WHEN l.texts >= {LEAST_DOCS} THEN l.lower ELSE a.lower END
                  AND CASE WHEN o.texts >= {LEAST_DOCS} THEN o.upper WHEN l.texts >= {LEAST_DOCS} THEN l.upper ELSE a.upper END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND r NOT IN (SELECT r FROM failed) AS kept
FROM judged
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_TERM_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT lang, source, any_value(v) AS v, coalesce(sum(n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN langs USING (lang) LEFT JOIN counts USING (lang, source)
  GROUP BY ALL),
shares AS (
  SELECT lang, source, term, coalesce(counts.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(counts.n, 0) + 1)) // (groups.total + groups.v) AS p,
         1 + ({SCALE}::HUGEINT * (kept.n + 1)) // (langs.total + langs.v) AS q
  FROM groups JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN counts USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {MOST_TERMS}
"""


QUERIES = {
    "op1_quality_resampling": op1_quality_resampling,
    "op2_decontamination": op2_decontamination,
    "op3_url_filter": op3_url_filter,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_warc_chunks": op6_warc_chunks,
    "op7_main_text": op7_main_text,
    "op8_mtree_top_k": op8_mtree_top_k,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_quality_rules": op12_quality_rules,
    "op13_source_divergence": op13_source_divergence,
}
ORACLES = {
    "op2_decontamination": OP2_SQL,
    "op3_url_filter": OP3_SQL,
    "op5_source_mixing": OP5_SQL,
    "op6_warc_chunks": OP6_SQL,
    "op8_mtree_top_k": OP8_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op10_line_dedup": OP10_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_quality_rules": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
