"""The registered queries in DuckDB SQL, written from the rules over exploded lines (no arrays of lines, no struct fields).

``BASE`` is a chain of common table expressions; each query is a final SELECT over it.
"""

from __future__ import annotations

#: Fixed values, written here once more so that a wrong table in the library does not pass: the layout's regions by page (x1, y1, x2, y2
#: in hundredths, distinctive_numbers from 73.5 on).
REGIONS = """
1 certificate_number 0 0 20 7 | 1 number_of_shares_box 80 0 100 7 | 1 company_name 8 10 92 26 | 1 registered_office 10 26 90 31
1 authorised_capital 8 31 92 35 | 1 holder_name 10 44 80 53 | 1 shares_and_face_value 8 53 95 64 | 1 issue_date 8 63 75 71
1 distinctive_numbers 5 73.5 45 80 | 1 signatures 50 71 98 92 | 2 transfer_table 0 5 100 100 | 2 transfer_table_header 0 5 100 10
2 column_date 0 0 13 100 | 2 column_transfer_no 13 0 25 100 | 2 column_transferee 25 0 66 100 | 2 column_ledger_folio 66 0 80 100
2 column_signature 80 0 100 100
"""
LAYOUT = {(int(p), name): tuple(float(v) / 100 for v in box) for p, name, *box in (r.split() for r in REGIONS.replace("|", "\n").strip().splitlines())}
#: Number words.
NUMBERS = (
    "zero 0 one 1 two 2 three 3 four 4 five 5 six 6 seven 7 eight 8 nine 9 ten 10 eleven 11 twelve 12 thirteen 13 fourteen 14 fifteen 15 sixteen 16 seventeen 17 "
    "eighteen 18 nineteen 19 twenty 20 thirty 30 forty 40 fifty 50 sixty 60 seventy 70 eighty 80 ninety 90 hundred 100 thousand 1000 lakh 100000 lac 100000 crore 10000000"
)

CONF = "(CAST(0.80 AS DOUBLE) + ({k} % 20) / CAST(100.0 AS DOUBLE))"
NOISE = "' .:;,-_''\"|'"
CERT_RE = r"(?i)CERT(?:IFICATE)?\.?\s*NO\.?\s*[:\-]?\s*([A-Z0-9/\-]{2,20})"
SENTENCE_RE = (
    r"(?i)registered\s+holder.{0,15}?of\s+([A-Z\s]+?)\s+fully\s+paid\s+([A-Za-z()\s]+?)\s+Shares?\s+of\s+Rupees\s+([A-Za-z0-9]+)\s+each"
)
DAY_OF_RE = r"(?i)(this\s+)?(\d{1,2}(?:st|nd|rd|th)?|[A-Za-z]+)\s+day\s+of\s+([A-Za-z]+)\.?,?\s*(\d{4})"
TEXTUAL_RE = r"(?i)(\d{1,2})(?:st|nd|rd|th)?\s+(?:day\s+of\s+)?([A-Za-z]+)\.?,?\s+(\d{4})"

MONTH = (
    "CASE lower({m}) " + " ".join(
        f"WHEN '{name}' THEN {n} WHEN '{name[:3]}' THEN {n}"
        for n, name in enumerate("january february march april may june july august september october november december".split(), 1)
    ) + " WHEN 'sept' THEN 9 END"
)
ORDINAL = (
    "CASE {d} " + " ".join(
        f"WHEN '{w}' THEN {n}" for n, w in enumerate(
            "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth "
            "eighteenth nineteenth twentieth".split(), 1)
    ) + " END"
)


def iso(d: str, m: str, y: str) -> str:
    made = f"try_strptime(({y})::VARCHAR || '-' || ({m})::VARCHAR || '-' || ({d})::VARCHAR, '%Y-%m-%d')"
    return f"CASE WHEN ({y}) BETWEEN 1850 AND 2035 AND ({m}) BETWEEN 1 AND 12 AND ({d}) BETWEEN 1 AND 31 THEN strftime({made}, '%Y-%m-%d') END"


def norm(c: str) -> str:
    return rf"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"


def date(c: str) -> str:
    t = norm(c)
    part = lambda p, g: f"try_cast(nullif(regexp_extract({t}, '{p}', {g}), '') AS INTEGER)"
    i, n = r"(\d{4})-(\d{1,2})-(\d{1,2})", r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})"
    month = MONTH.format(m=f"regexp_extract({t}, '{TEXTUAL_RE}', 2)")
    d, m = part(n, 1), part(n, 2)
    swap = f"({m} > 12 AND {d} <= 12)"
    return (
        f"CASE WHEN regexp_matches({t}, '{i}') THEN {iso(part(i, 3), part(i, 2), part(i, 1))}"
        f" WHEN ({month}) IS NOT NULL THEN {iso(part(TEXTUAL_RE, 1), month, part(TEXTUAL_RE, 3))}"
        f" WHEN regexp_matches({t}, '{n}') THEN {iso(f'(CASE WHEN {swap} THEN {m} ELSE {d} END)', f'(CASE WHEN {swap} THEN {d} ELSE {m} END)', part(n, 3))} END"
    )


def words(c: str) -> str:
    """Number words, by a fold over (total, current, value)."""
    case = "CASE {w} " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in zip(NUMBERS.split()[::2], NUMBERS.split()[1::2], strict=True)) + " END"
    fixed = "lower(translate(upper(x), '01458', 'OIASB'))"
    tokens = f"list_filter(regexp_extract_all(lower({norm(c)}), '[a-z0-9]+'), lambda x: x NOT IN ('and','only','rupees','rs','shares','share'))"
    values = f"list_transform({tokens}, lambda x: coalesce({case.format(w='x')}, {case.format(w=fixed)}))"
    states = f"list_concat([{{'t': 0::BIGINT, 'c': 0::BIGINT, 'v': 0::BIGINT}}], list_transform({values}, lambda x: {{'t': 0::BIGINT, 'c': 0::BIGINT, 'v': x::BIGINT}}))"
    most = 1000
    step = (
        "{'t': CASE WHEN b.v >= " + str(most) + " THEN a.t + (CASE WHEN a.c = 0 THEN 1 ELSE a.c END) * b.v ELSE a.t END, "
        "'c': CASE WHEN b.v >= " + str(most) + " THEN 0 WHEN b.v = 100 THEN (CASE WHEN a.c = 0 THEN 1 ELSE a.c END) * 100 ELSE a.c + b.v END, 'v': b.v}"
    )
    folded = f"list_reduce({states}, lambda a, b: {step})"
    return f"CASE WHEN len({tokens}) > 0 AND len(list_filter({values}, lambda x: x IS NULL)) = 0 THEN ({folded}).t + ({folded}).c END"


def inside(region: str, page: int = 1, tolerance: float = 0.05) -> str:
    x1, y1, x2, y2 = LAYOUT[page, region]
    return f"(cx BETWEEN {x1 - tolerance!r}::DOUBLE AND {x2 + tolerance!r}::DOUBLE AND cy BETWEEN {y1 - tolerance!r}::DOUBLE AND {y2 + tolerance!r}::DOUBLE)"


FRONT = ["THIS IS TO CERTIFY", "CERTIFICATE NO", "CERT NO", "REGISTERED OFFICE", "AUTHORISED CAPITAL", "DISTINCTIVE NUMBERS", "NO OF SHARES"]
LEDGER = ["MEMORANDUM OF TRANSFERS", "MEMORANDUM OF TRANSFER", "TRANSFEREE", "TRANSFEREE''S NAME", "LEDGER FOLIO", "DATE OF TRANSFER"]
_hits = lambda ks: " + ".join(f"contains(label, '{k}')::INT" for k in ks)
NAMES = ["certificate_no", "company_name", "share_holder_name", "date_of_issue", "number_of_shares", "share_type", "face_value", "distinctive_from", "distinctive_to"]
SOURCE = {n: "regex" if n in ("date_of_issue", "number_of_shares", "share_type", "face_value") else "paddleocr" for n in NAMES}
REGION = {
    "certificate_no": "certificate_number", "company_name": "company_name", "share_holder_name": "holder_name", "date_of_issue": "issue_date",
    "number_of_shares": "shares_and_face_value", "share_type": "shares_and_face_value", "face_value": "shares_and_face_value",
    "distinctive_from": "distinctive_numbers", "distinctive_to": "distinctive_numbers",
}
COLS = ["transfer_date", "transfer_no", "transferee_name", "ledger_folio_no", "authorised_signature"]
EDGES = [(0.0, 0.13), (0.13, 0.25), (0.25, 0.66), (0.66, 0.80), (0.80, 1.0)]
_column = (
    "CASE " + " ".join(f"WHEN cx BETWEEN {a}::DOUBLE AND {b}::DOUBLE THEN '{c}'" for c, (a, b) in zip(COLS, EDGES, strict=True))
    + " WHEN cx < 0 AND cx > -1 THEN 'transfer_date' WHEN cx > 1 AND cx < 2 THEN 'authorised_signature' ELSE 'transferee_name' END"
)
_cells = ", ".join(
    f"nullif(trim({norm(f'''string_agg(text, ' ' ORDER BY x1, mid, line_no) FILTER (f = '{c}')''')}, {NOISE}), '') AS {c}, min(conf) FILTER (f = '{c}') AS c{i}"
    for i, c in enumerate(COLS)
)
_csum = " + ".join(["0.0::DOUBLE"] + [f"coalesce(c{i}, 0.0::DOUBLE)" for i in range(5)])
_ccount = " + ".join([f"(c{i} IS NOT NULL)::INT" for i in range(5)] + ["(transfer_date IS NOT NULL AND iso IS NULL)::INT"])
_long = "\n  UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS field_name, {n} AS value, CASE WHEN {n} IS NULL THEN 0.0::DOUBLE ELSE c_{n} END AS confidence, "
    f"CASE WHEN {n} IS NULL THEN 'regex' ELSE '{SOURCE[n]}' END AS source, 1 AS page, '{REGION[n]}' AS region, "
    f"({n} IS NULL OR {'c_' + n + ' < 0.5' if n in ('company_name', 'distinctive_from', 'distinctive_to') else 'false'}) AS needs_review FROM fw"
    for n in NAMES
)
_conf_sum = " + ".join(["0.0::DOUBLE"] + [f"(CASE WHEN {n} IS NULL THEN 0.0::DOUBLE ELSE c_{n} END)" for n in NAMES])
_int = lambda c: rf"(CASE WHEN regexp_matches({c}, '^\s*[+-]?\d+(_\d+)*\s*$') THEN try_cast(replace(trim({c}), '_', '') AS HUGEINT) END)"

BASE = rf"""WITH o AS (
  SELECT o_orderkey AS k, n_name, c_name, o_orderdate, {CONF.format(k='o_orderkey')} AS c,
         ['TEN', 'TWENTY FIVE', 'ONE HUNDRED', 'TWO HUNDRED AND FIFTY', 'ONE LAKH'][o_orderkey % 5 + 1] AS w, [10, 25, 100, 250, 100000][o_orderkey % 5 + 1] AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), front AS (
  SELECT k, 0 AS line_no, CASE WHEN k % 7 = 0 THEN 'faded' ELSE 'Cert.No.OB' || k END AS text, c AS conf, 20 AS x1, 20 AS y1, 200 AS x2, 50 AS y2 FROM o
  UNION ALL SELECT k, 1, n_name || CASE WHEN k % 11 = 0 THEN ' METALS' ELSE ' METALS LTD' END, c, 100, 120, 900, 200 FROM o
  UNION ALL SELECT k, 2, 'THIS IS TO CERTIFY THAT', c, 100, 440, 500, 460 FROM o
  UNION ALL SELECT k, 3, CASE WHEN k % 3 = 0 THEN '1/21' ELSE '' END, c, 100, 470, 150, 490 FROM o
  UNION ALL SELECT k, 4, c_name, c, 100, 490, 600, 510 FROM o
  UNION ALL SELECT k, 5, 'is/are the registered holder(s) of ' || w, c, 100, 540, 700, 560 FROM o
  UNION ALL SELECT k, 6, CASE WHEN k % 13 = 0 THEN 'fully paid Ordinary Equity of Rupees' ELSE 'fully paid Ordinary (Equity) Shares of Rupees ' || CASE WHEN k % 2 = 0 THEN 'Ten' ELSE '100' END || ' each' END, c, 100, 580, 900, 600 FROM o
  UNION ALL SELECT k, 7, CASE k % 3 WHEN 0 THEN 'this Fourteenth day of August 1967' WHEN 1 THEN '14th August 1967' ELSE strftime(o_orderdate, '%d/%m/%Y') END, c, 100, 650, 500, 670 FROM o
  UNION ALL SELECT k, 8, (1000 + k * 10)::VARCHAR, c, 60, 758, 190, 778 FROM o
  UNION ALL SELECT k, 9, (1000 + k * 10 + n - 1 + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END)::VARCHAR, c, 330, 758, 460, 778 FROM o WHERE k % 6 <> 0
), head AS (
  SELECT * FROM (VALUES (0, 'MEMORANDUM OF TRANSFERS', 0.9::DOUBLE, 300, 20, 700, 40), (1, 'Transferee', 0.9::DOUBLE, 300, 60, 500, 80)) AS v(line_no, text, conf, x1, y1, x2, y2)
), item AS (
  SELECT l_orderkey AS k, s_name, l_partkey, l_shipdate,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS r
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
), token AS (
  SELECT k, r, t, 130 + r * CASE WHEN k % 17 = 0 THEN 40 ELSE 50 END AS y, {CONF.format(k='(k + r + t)')} AS conf,
         CASE t WHEN 0 THEN CASE WHEN (k + r) % 9 = 0 THEN 'illegible' ELSE strftime(l_shipdate, '%d/%m/%Y') END WHEN 1 THEN (r + 1)::VARCHAR WHEN 2 THEN s_name
                WHEN 3 THEN 'F' || (l_partkey % 1000) ELSE 'SIGNED' END AS text,
         [20, 150, 300, 680, 850][t + 1] + CASE WHEN t = 3 AND k % 23 = 0 THEN 360 ELSE 0 END AS x1,
         [110, 230, 600, 780, 950][t + 1] + CASE WHEN t = 3 AND k % 23 = 0 THEN 360 ELSE 0 END AS x2
  FROM item CROSS JOIN (SELECT unnest(range(5))::INT AS t) WHERE t = 3 OR (k + r) % 19 <> 0
), has AS (SELECT DISTINCT k FROM item),
ledger AS (
  SELECT k, (2 + r * 5 + t)::INT AS line_no, text, conf, x1, y AS y1, x2, y + 18 AS y2 FROM token
  UNION ALL SELECT o.k, head.* FROM o CROSS JOIN head WHERE o.k IN (FROM has) OR o.k % 2 = 0
), raw AS (
  SELECT k AS doc_id, CASE WHEN k % 10 = 0 THEN 3 ELSE 1 END AS page_no, line_no, text, conf, x1, y1, x2, y2 FROM front
  UNION ALL SELECT k, CASE WHEN k % 10 = 0 THEN 1 ELSE 2 END, line_no, text, conf, x1, y1, x2, y2 FROM ledger
  UNION ALL SELECT k, 2, head.* FROM o CROSS JOIN head WHERE k % 10 = 0
), lines AS (
  SELECT *, ((x1 + x2) / 2.0::DOUBLE) / 1000 AS cx, ((y1 + y2) / 2.0::DOUBLE) / 1000 AS cy, {norm('text')} AS nt, regexp_replace(upper({norm('text')}), '[.:]', '', 'g') AS label FROM raw
), page AS (
  SELECT doc_id, page_no, {norm("string_agg(text, ' ' ORDER BY line_no)")} AS full_text FROM lines GROUP BY doc_id, page_no
), hits AS (
  SELECT doc_id, page_no, {_hits(FRONT)} AS front_hits, {_hits(LEDGER)} AS ledger_hits FROM (SELECT *, regexp_replace(upper(full_text), '[.:]', '', 'g') AS label FROM page)
), typed AS (
  SELECT *, CASE WHEN ledger_hits > 0 AND ledger_hits >= front_hits THEN 'transfer_ledger' WHEN front_hits > 0 THEN 'certificate_front' ELSE 'unknown' END AS page_type FROM hits
), p2 AS (SELECT doc_id, count(*) AS num_pages, min(page_no) FILTER (page_type = 'transfer_ledger') AS page2_no FROM typed GROUP BY doc_id),
routed AS (
  SELECT p2.doc_id, num_pages, min(page_no) FILTER (page2_no IS NULL OR page_no <> page2_no) AS page1_no, any_value(page2_no) AS page2_no FROM p2 JOIN typed USING (doc_id) GROUP BY p2.doc_id, num_pages
), l1 AS (SELECT l.*, row_number() OVER (PARTITION BY l.doc_id ORDER BY line_no) AS rn FROM lines l JOIN routed r ON l.doc_id = r.doc_id AND l.page_no = r.page1_no),
e1 AS (
  SELECT doc_id, arg_min(trim({norm(f"regexp_extract(text, '{CERT_RE}', 1)")}, {NOISE}), line_no) AS certificate_no,
         arg_min(least(1.0, round(conf, 4) + CASE WHEN {inside('certificate_number')} THEN 0.05::DOUBLE ELSE 0 END), line_no) AS c_certificate_no
  FROM l1 WHERE regexp_matches(text, '{CERT_RE}') GROUP BY doc_id
), e2 AS (
  SELECT doc_id, company_name, c_company_name FROM (
    SELECT doc_id, trim(nt, {NOISE}) AS company_name,
           least(1.0, (CASE WHEN label LIKE '%LTD%' OR label LIKE '%LIMITED%' OR label LIKE '%COMPANY%' THEN least(1.0, round(conf, 4) + 0.1::DOUBLE) ELSE round(conf, 4) END)
                 + CASE WHEN {inside('company_name')} THEN 0.05::DOUBLE ELSE 0 END) AS c_company_name,
           row_number() OVER (PARTITION BY doc_id ORDER BY y2 - y1 DESC, line_no) AS place
    FROM l1 WHERE length(label) >= 4 AND cy <= 0.32 AND NOT regexp_matches(label, 'CERT|NO OF SHARES|SHARES|REGISTERED OFFICE|AUTHORISED')) WHERE place = 1
), anchor AS (SELECT doc_id, min(rn) AS a FROM l1 WHERE contains(label, 'CERTIFY THAT') GROUP BY doc_id),
near AS (
  SELECT doc_id, rn, trim({norm(r"regexp_replace(text, '^\s*\d{1,4}\s*/\s*\d{0,4}\s*\|?\s*', '')")}, {NOISE}) AS v,
         contains(label, 'REGISTERED HOLDER') OR contains(label, 'IS/ARE') AS stop, least(1.0, round(conf, 4) + CASE WHEN {inside('holder_name')} THEN 0.05::DOUBLE ELSE 0 END) AS c
  FROM l1 JOIN anchor USING (doc_id) WHERE rn BETWEEN a + 1 AND a + 3 AND label <> ''
), e3 AS (
  SELECT doc_id, arg_min(v, rn) AS share_holder_name, arg_min(c, rn) AS c_share_holder_name FROM near
  WHERE NOT stop AND length(v) >= 3 AND length(regexp_replace(v, '[^\p{{L}}]', '', 'g')) >= 3
    AND rn < coalesce((SELECT min(s.rn) FROM near s WHERE s.doc_id = near.doc_id AND s.stop), 1000000) GROUP BY doc_id
), t1 AS (SELECT doc_id, full_text FROM page JOIN routed USING (doc_id) WHERE page_no = page1_no),
s4 AS (
  SELECT doc_id, regexp_extract(full_text, '{SENTENCE_RE}', 1) AS g1, regexp_extract(full_text, '{SENTENCE_RE}', 2) AS g2, regexp_extract(full_text, '{SENTENCE_RE}', 3) AS g3
  FROM t1 WHERE regexp_matches(full_text, '{SENTENCE_RE}')
), e4 AS (
  SELECT doc_id, ({words('g1')})::VARCHAR AS number_of_shares, nullif({norm('g2')}, '') AS share_type,
         CASE WHEN regexp_matches(g3, '\d') THEN try_cast(regexp_extract(g3, '\d+') AS HUGEINT)::VARCHAR || '.0' ELSE ({words('g3')})::VARCHAR END AS face_value FROM s4
), d5 AS (
  SELECT doc_id, full_text, regexp_matches(full_text, '{DAY_OF_RE}') AS said, lower(regexp_extract(full_text, '{DAY_OF_RE}', 2)) AS d,
         {MONTH.format(m=f"regexp_extract(full_text, '{DAY_OF_RE}', 3)")} AS m, try_cast(nullif(regexp_extract(full_text, '{DAY_OF_RE}', 4), '') AS INTEGER) AS y FROM t1
), n5 AS (SELECT *, coalesce({ORDINAL.format(d='d')}, try_cast(nullif(regexp_extract(d, '^(\d+)(?:st|nd|rd|th)?$', 1), '') AS INTEGER)) AS dd FROM d5),
e5 AS (SELECT doc_id, CASE WHEN said THEN {iso('dd', 'm', 'y')} END AS spoken, {date('full_text')} AS anywhere FROM n5),
d6 AS (
  SELECT doc_id, y1, line_no, conf, regexp_replace(translate(text, 'OQDILZASGTBoqdilzasgtb', '0001124567800011245678'), '[^0-9]', '', 'g') AS digits, regexp_replace(text, '\s', '', 'g') AS solid
  FROM l1 WHERE {inside('distinctive_numbers', 1, 0.02)}
), r6 AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y1, line_no) AS place FROM d6
  WHERE length(digits) >= 3 AND length(solid) > 0 AND length(regexp_replace(solid, '[^0-9]', '', 'g')) >= 0.5 * length(solid)
), e6 AS (
  SELECT doc_id, max(digits) FILTER (place = 1) AS distinctive_from, max(least(1.0, round(conf, 4) * 0.8::DOUBLE)) FILTER (place = 1) AS c_distinctive_from,
         max(digits) FILTER (place = 2) AS distinctive_to, max(least(1.0, round(conf, 4) * 0.8::DOUBLE)) FILTER (place = 2) AS c_distinctive_to FROM r6 GROUP BY doc_id
), fw AS (
  SELECT t1.doc_id, certificate_no, c_certificate_no, company_name, c_company_name, share_holder_name, c_share_holder_name,
         coalesce(spoken, anywhere) AS date_of_issue, CASE WHEN spoken IS NOT NULL THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS c_date_of_issue,
         number_of_shares, 0.75::DOUBLE AS c_number_of_shares, share_type, 0.75::DOUBLE AS c_share_type, face_value, 0.75::DOUBLE AS c_face_value,
         distinctive_from, c_distinctive_from, distinctive_to, c_distinctive_to
  FROM t1 LEFT JOIN e1 USING (doc_id) LEFT JOIN e2 USING (doc_id) LEFT JOIN e3 USING (doc_id) LEFT JOIN e4 USING (doc_id) LEFT JOIN e5 USING (doc_id) LEFT JOIN e6 USING (doc_id)
), fields AS ({_long}),
l2 AS (
  SELECT l.*, (y1 + y2) / 2.0::DOUBLE AS mid, {_column} AS f FROM lines l JOIN routed r ON l.doc_id = r.doc_id AND l.page_no = r.page2_no
  WHERE NOT (cy <= 0.10 OR regexp_matches(label, 'DATE OF|TRANSFER NO|TRANSFEREE|LEDGER|FOLIO|SIGNATURE|AUTHORIS|MEMORANDUM OF TRANSFERS'))
), gaps AS (SELECT *, CASE WHEN cy - lag(cy) OVER (PARTITION BY doc_id ORDER BY mid, line_no) > 0.045 THEN 1 ELSE 0 END AS starts FROM l2),
clustered AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY mid, line_no ROWS UNBOUNDED PRECEDING)::INT AS row_index FROM gaps),
cells AS (SELECT doc_id, row_index, {_cells} FROM clustered GROUP BY doc_id, row_index),
dated AS (SELECT *, CASE WHEN transfer_date IS NOT NULL THEN {date('transfer_date')} END AS iso FROM cells WHERE length(coalesce(transferee_name, '')) >= 2 OR transfer_date IS NOT NULL),
transfers AS (
  SELECT doc_id, row_index, coalesce(iso, transfer_date) AS transfer_date, transfer_no, transferee_name, ledger_folio_no, authorised_signature,
         round(({_csum}) / ({_ccount}), 4) AS confidence, round(({_csum}) / ({_ccount}), 4) < 0.7 OR iso IS NULL AS needs_review FROM dated
), latest AS (
  SELECT doc_id, arg_max(coalesce(transferee_name, ''), row_index) AS holder0, arg_max(coalesce(transfer_date, ''), row_index) AS date0, arg_max(coalesce(ledger_folio_no, ''), row_index) AS folio0
  FROM transfers GROUP BY doc_id
), present AS (SELECT doc_id, nullif(holder0, '') AS present_share_holder_name, nullif(date0, '') AS present_transfer_date, nullif(folio0, '') AS present_folio_no FROM latest),
counts AS (SELECT doc_id, count(*) AS transfer_rows, count(*) FILTER (needs_review) AS transfer_rows_needing_review FROM transfers GROUP BY doc_id),
v AS (
  SELECT *, {_int('number_of_shares')} AS s, {_int('distinctive_from')} AS a, {_int('distinctive_to')} AS b, {date('date_of_issue')} AS issued,
         regexp_matches(coalesce(face_value, ''), '^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$') AS face_ok FROM fw
), outcomes AS (
  SELECT doc_id, 1 AS rule_order, 'number_of_shares_numeric' AS rule_name, s IS NOT NULL AS passed,
         CASE WHEN s IS NOT NULL THEN '' WHEN number_of_shares IS NULL THEN 'Number of shares missing' ELSE 'Number of shares is not a valid integer' END AS message FROM v
  UNION ALL SELECT doc_id, 2, 'face_value_numeric', face_ok, CASE WHEN face_ok THEN '' ELSE 'Face value is not numeric' END FROM v
  UNION ALL SELECT doc_id, 3, 'distinctive_range_order', coalesce(a <= b, false),
         CASE WHEN a <= b THEN '' WHEN a IS NULL OR b IS NULL THEN 'Distinctive numbers missing/unreadable' ELSE 'Distinctive ''From'' is greater than ''To''' END FROM v
  UNION ALL SELECT doc_id, 4, 'distinctive_range_matches_shares', b - a + 1 = s,
         CASE WHEN b - a + 1 = s THEN '' ELSE 'To - From + 1 (' || (b - a + 1) || ') != number_of_shares (' || s || ')' END FROM v WHERE a IS NOT NULL AND b IS NOT NULL AND s IS NOT NULL
  UNION ALL SELECT doc_id, 5, 'date_of_issue_valid', issued IS NOT NULL, CASE WHEN issued IS NOT NULL THEN '' ELSE 'Date of issue missing/unparseable' END FROM v
), status AS (
  SELECT doc_id, CASE WHEN bool_and(passed) THEN 'passed' ELSE 'failed' END AS validation_status,
         coalesce(string_agg(message, '; ' ORDER BY rule_order) FILTER (NOT passed AND message <> ''), '') AS validation_flags FROM outcomes GROUP BY doc_id
), review AS (SELECT doc_id, bool_or(needs_review) AS flagged FROM fields GROUP BY doc_id),
certs AS (
  SELECT fw.doc_id, company_name, share_type, certificate_no, share_holder_name, {_int('number_of_shares')}::INTEGER AS number_of_shares,
         try_cast(face_value AS DOUBLE) AS face_value, distinctive_from, distinctive_to, date_of_issue, fw.doc_id || '.pdf' AS source_file, page1_no AS page_number,
         round(({_conf_sum}) / 9, 4) AS overall_confidence, round(({_conf_sum}) / 9, 4) < 0.7 OR validation_status = 'failed' OR flagged AS needs_review,
         validation_status, validation_flags, present_share_holder_name, present_transfer_date, present_folio_no
  FROM fw JOIN routed USING (doc_id) JOIN status USING (doc_id) JOIN review USING (doc_id) LEFT JOIN present USING (doc_id)
), docs AS (
  SELECT o_orderkey AS doc_id, o_custkey % 40 AS job_id, o_orderkey || '.pdf' AS original_filename,
         CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderkey % 5 = 0 THEN 'processing' ELSE 'pending' END AS status,
         CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'ocr' ELSE 'extraction' END END AS error_stage,
         CASE WHEN o_orderstatus = 'P' THEN 'ValueError' END AS error_type, CASE WHEN o_orderstatus = 'P' THEN 'page ' || (o_orderkey % 3) END AS error_message FROM orders
), job_ids AS (SELECT DISTINCT o_custkey % 40 AS job_id FROM orders),
jobs AS (
  SELECT job_id, 'user' || (job_id % 3) AS owner, CASE job_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'paused' WHEN 2 THEN 'stopped' ELSE 'queued' END AS status
  FROM (SELECT job_id FROM job_ids UNION ALL SELECT job_id + 1000 FROM job_ids WHERE job_id % 8 = 7)
), tally AS (
  SELECT jobs.job_id, owner, jobs.status, count(docs.doc_id) AS total, count(docs.doc_id) FILTER (docs.status = 'done') AS done, count(docs.doc_id) FILTER (docs.status = 'failed') AS failed,
         count(docs.doc_id) FILTER (docs.status IN ('pending', 'processing')) AS waiting FROM jobs LEFT JOIN docs USING (job_id) GROUP BY jobs.job_id, owner, jobs.status
), progress AS (SELECT *, CASE WHEN total = 0 THEN 0 ELSE floor((done + failed) * 100 / total + 0.5)::INT END AS percent FROM tally),
reviews AS (
  SELECT event_id % 500 AS doc_id, ['certificate_no', 'company_name', 'face_value'][event_id % 3 + 1] AS field_name, event_type <> 'view' AS has_value,
         CASE WHEN event_type IN ('click', 'signup', 'purchase') THEN 'v' || (event_id % 11) END AS reviewed_value, 'user' || user_id AS reviewed_by, ts AS reviewed_at FROM events
), lastr AS (SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY doc_id, field_name ORDER BY reviewed_at DESC, reviewed_by DESC, reviewed_value DESC NULLS LAST) = 1),
lastv AS (SELECT * FROM reviews WHERE has_value QUALIFY row_number() OVER (PARTITION BY doc_id, field_name ORDER BY reviewed_at DESC, reviewed_by DESC, reviewed_value DESC NULLS LAST) = 1),
overlay AS (
  SELECT f.*, lastr.reviewed_at IS NOT NULL AS reviewed, lastv.reviewed_value, lastr.reviewed_by, strftime(lastr.reviewed_at, '%Y-%m-%d %H:%M:%S') AS reviewed_at
  FROM fields f LEFT JOIN lastr USING (doc_id, field_name) LEFT JOIN lastv USING (doc_id, field_name)
)
"""
