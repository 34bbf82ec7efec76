"""The registered corpus queries, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certjobs.llm import chat_format, conversation_repair
from certjobs.llm.common import held_out, read_table, text_of
from certjobs.llm.decontaminate import decontaminate
from certjobs.llm.exact_dedup import exact_dedup
from certjobs.llm.html_text import extract_text
from certjobs.llm.licenses import LEAST, NOTICES, notices, scan_licenses
from certjobs.llm.near_dups import near_duplicates
from certjobs.llm.packing import pack
from certjobs.llm.quality import fit_quality, score_quality
from certjobs.llm.ranked_search import ranked_search
from certjobs.llm.secrets import scan_secrets
from certjobs.llm.substring_dedup import substring_dedup
from certjobs.llm.toxicity import fit_toxicity, score_toxicity


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return exact_dedup(docs, carry=[F.sha2(text_of(), 256).alias("text_sha256")])


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_live", "n_copied")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, owner, 'assign' AS kind, 0 AS ord, 12 AS l,
         regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS a,
         regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS v,
         regexp_split_to_array(t, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?(?:[A-Za-z0-9+/_.=-]+)') AS gap FROM d
  UNION ALL
  SELECT doc_id, owner, 'access', 1, 18, regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_split_to_array(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL
  SELECT doc_id, owner, 'hex', 2, 16, regexp_extract_all(t, '[0-9a-f]+', 0), regexp_extract_all(t, '[0-9a-f]+', 0), regexp_split_to_array(t, '[0-9a-f]+') FROM d
  UNION ALL
  SELECT doc_id, owner, 'opaque', 3, 32, regexp_extract_all(t, '[A-Za-z0-9+/_=-]+', 0), regexp_extract_all(t, '[A-Za-z0-9+/_=-]+', 0), regexp_split_to_array(t, '[A-Za-z0-9+/_=-]+') FROM d
), e AS (
  SELECT doc_id, owner, kind, ord, l, i, a[i] AS a, v[i] AS v, gap[i] AS gap FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM m)
), pos AS (
  SELECT *, sum(length(a) + length(gap)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM e
), s AS (
  SELECT doc_id, owner, kind, ord, CAST(stop - length(a) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, v FROM pos
  WHERE length(v) >= l AND (kind <> 'opaque' OR (regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')))
), f AS (SELECT v, count(DISTINCT owner) AS owners FROM s GROUP BY v),
j AS (SELECT s.*, owners FROM s JOIN f USING (v)),
r AS (
  SELECT doc_id,
         count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (kind <> 'opaque') AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (kind <> 'opaque' OR owners <= 1) AS spans,
         count(*) FILTER (kind <> 'opaque' AND owners <= 1) AS n_live, count(*) FILTER (kind <> 'opaque' AND owners > 1) AS n_copied
  FROM j GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN r USING (doc_id)
"""


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"), notices(spark))


OP5_SQL = (
    "WITH tpl(license_id, text) AS (VALUES "
    + ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(NOTICES.items()))
    + r"""),
tw AS (SELECT license_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM tpl),
tb AS (SELECT license_id, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS t FROM tw),
u AS (SELECT doc_id, unnest(list_distinct(list_concat([coalesce(text, '')], string_split(coalesce(text, ''), chr(10)),
  string_split_regex(coalesce(text, ''), '\n[^A-Za-z0-9]*\n')))) AS unit FROM documents),
uw AS (SELECT doc_id, regexp_extract_all(lower(unit), '[a-z0-9]+') AS w FROM u),
ub AS (SELECT doc_id, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS u FROM uw WHERE len(w) > 1),
h AS (
  SELECT doc_id, license_id, 2.0::DOUBLE * len(list_intersect(u, t)) / (len(u) + len(t)) AS score FROM ub CROSS JOIN tb
), g AS (SELECT * FROM h WHERE score >= """
    + str(LEAST)
    + r""")
SELECT d.doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses, best_license, best_score FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n_matches, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS licenses,
         first(license_id ORDER BY score DESC, license_id) AS best_license, max(score) AS best_score
  FROM g GROUP BY doc_id) USING (doc_id)
"""
)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bn AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM bw))
), hits AS (
  SELECT DISTINCT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw USING (g)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d)),
m AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (g) WHERE least < doc_id),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM p ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT row_number() OVER () AS b, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark
), s AS (SELECT count(*) FILTER (len(w) > 0) AS big_n, sum(len(w))::BIGINT AS big_l FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY ALL),
wt AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, s GROUP BY term, big_n),
m AS (SELECT r, doc_id, 25 + (75 * len(w) * big_n) // big_l AS m FROM d, s WHERE len(w) > 0),
q AS (SELECT b, item_id, term, count(*) AS times FROM b GROUP BY ALL),
x AS (
  SELECT b, item_id, m.r, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN wt USING (term) JOIN m ON m.r = tf.r GROUP BY ALL
), k AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digest(chat_format.format_conversations(chat_format.with_trap(read_table(spark, sf_dir, "conversations"))))


OP12_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '### ', '\m'), '</turn>', '\e')) AS t,
         length(replace(replace(replace(replace(role, '\', '\\'), '### ', '\m'), '</turn>', '\e'), ':', '\c')) AS r FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(t + r + length('### ' || ': ' || '</turn>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(read_table(spark, sf_dir, "conversations"))
    return conversation_repair.digest(conversation_repair.repair_conversations(rows, F.col("present")))


OP13_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), h AS (
  SELECT *, xor(list_reduce([4294967295] || flatten([[(ascii(x) >> b) & 1 FOR b IN range(8)] FOR x IN string_split(k, '')]),
    lambda h, b: xor(h >> 1, CASE WHEN xor(h, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 20 AS kind FROM c
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0
), o AS (
  SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS prev, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, copy)
), f AS (
  SELECT conv_id, i, turn, role, text, left(role, 1) AS r, CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
         WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault, prev IS NOT NULL AND prev || left(role, 1) NOT IN ('su', 'ua', 'au') AS bad FROM o
), step(r, q, nq) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
ins(q, nq, n, said) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 1, 'user:'), (1, 2, 1, 'user:'), (3, 2, 1, 'user:'), (2, 3, 1, 'assistant:'),
  (0, 3, 2, 'user:' || chr(10) || 'assistant:'), (1, 3, 2, 'user:' || chr(10) || 'assistant:'), (2, 2, 2, 'assistant:' || chr(10) || 'user:'), (3, 3, 2, 'user:' || chr(10) || 'assistant:')),
e AS (
  SELECT conv_id, i, q, q AS nq, 2 AS cost, 'D' AS letter, NULL AS said FROM f, range(4) AS s(q)
  UNION ALL SELECT conv_id, i, q, nq, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, 'K', role || ':' || text FROM f JOIN step USING (r) WHERE fault IN ('truncated', 'none')
  UNION ALL SELECT conv_id, i, q, nq, CASE WHEN fault = 'truncated' THEN 6 ELSE 1 END, 'R', CASE step.r WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text FROM f, step WHERE fault IN ('truncated', 'none') AND step.r <> 's'
), best AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0, 'audit': '', 'said': ''} AS b FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT e.conv_id, e.i, e.nq, min({'cost': (b.cost + 5 * n + e.cost)::INT, 'audit': b.audit || repeat('I', n) || letter,
    'said': concat_ws(chr(10), nullif(b.said, ''), nullif(ins.said, ''), e.said)})
  FROM best JOIN ins ON best.q = ins.q JOIN e ON e.conv_id = best.conv_id AND e.i = best.i + 1 AND e.q = ins.nq GROUP BY e.conv_id, e.i, e.nq
), ends AS (SELECT conv_id, max(i) AS i FROM f GROUP BY conv_id),
done AS (
  SELECT conv_id, min({'cost': b.cost + 5 * n, 'audit': b.audit || repeat('I', n), 'said': concat_ws(chr(10), nullif(b.said, ''), nullif(ins.said, ''))}) AS b
  FROM best JOIN ends USING (conv_id, i) JOIN ins USING (q) WHERE ins.nq IN (0, 3) GROUP BY conv_id
), n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal FROM f GROUP BY conv_id
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(b.said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN n USING (conv_id) LEFT JOIN done USING (conv_id)
"""


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_toxicity": op3_toxicity,
    "op4_secrets": op4_secrets,
    "op5_licenses": op5_licenses,
    "op6_decontamination": op6_decontamination,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_html": op10_html,
    "op11_ranked_search": op11_ranked_search,
    "op12_chat_format": op12_chat_format,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op4_secrets": OP4_SQL, "op5_licenses": OP5_SQL, "op6_decontamination": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op11_ranked_search": OP11_SQL, "op12_chat_format": OP12_SQL, "op13_conversation_repair": OP13_SQL}
