"""SQL for DuckDB with the same results as ``cardweave.queries``, from the same tables.

The fixtures' lines and tokens are derived here once more, and where a fixture's
geometry makes an operator's result plain (rows are the lines), the SQL says just that.
"""

from __future__ import annotations

from cardweave.functions import constants as C
from cardweave.operators.rows import AUDIT_COMPANIES, AUDIT_JOBS, AUDIT_PLACES, DESIGNATIONS, LABEL_COMPANIES, LABEL_JOBS


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _any(values) -> str:
    """A pattern that finds one of the values as a substring."""
    return "|".join(v.replace(".", "[.]") for v in values)


LINES = """
WITH c AS (SELECT c_custkey::BIGINT AS k FROM customer),
n AS (SELECT k, list_extract(['Ana','Ben','Carla','Dave','Elena','Farid','Grace','Hugo'], (k % 8 + 1)::INT) || ' ' ||
  list_extract(['Moreno','Keller','Tanaka','Okafor','Silva','Novak','Haddad','Lindqvist'], ((k // 8) % 8 + 1)::INT) AS name,
  '+65 9' || lpad(((k * 37) % 1000)::VARCHAR, 3, '0') || ' ' || lpad(((k * 7919) % 10000)::VARCHAR, 4, '0') AS phone FROM c),
contact_lines AS (
  SELECT k AS card_id, 0 AS line_no, CASE WHEN k % 5 = 0 THEN upper(name) ELSE name END AS text FROM n
  UNION ALL SELECT k, 1, list_extract(['Senior Engineer','Sales Manager','Managing Director','Product Designer','Research Analyst','Head of Operations'], (k % 6 + 1)::INT) FROM c
  UNION ALL SELECT k, 2, list_extract(['VERTEX','ORBIT','CEDAR','MARLIN','QUARTZ','SUMMIT','HARBOR'], (k % 7 + 1)::INT) || ' ' || list_extract(['LTD','GMBH','GROUP'], (k % 3 + 1)::INT) FROM c
  UNION ALL SELECT k, 3, 'user' || k::VARCHAR || '@mail' || (k % 10)::VARCHAR || '.' || list_extract(['com','com.sg','co.uk','orgx'], (k % 4 + 1)::INT) FROM c
  UNION ALL SELECT k, 4, CASE WHEN k % 2 = 1 THEN replace(phone, ' ', '') ELSE phone END FROM n WHERE k % 11 <> 0
  UNION ALL SELECT k, 5, (k % 90 + 10)::VARCHAR || ' North Road, Singapore ' || ((k * 131) % 900000 + 100000)::VARCHAR FROM c WHERE k % 7 <> 0)"""

TOKENS = LINES + """,
w AS (SELECT card_id, line_no, text, string_split(text, ' ') AS ws FROM contact_lines),
i AS (SELECT card_id, line_no, ws, unnest(range(0, len(ws))) AS word_no FROM w),
word AS (SELECT card_id, line_no, word_no, list_extract(ws, (word_no + 1)::INT) AS word FROM i),
placed AS (SELECT *, 8.0 * (coalesce(sum(length(word) + 1) OVER (PARTITION BY card_id, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS x,
  (CASE WHEN card_id % 4 = 0 THEN 24 ELSE 30 END * line_no + word_no % 3)::DOUBLE AS y, 0.1 + ((card_id * 31 + line_no * 7 + word_no * 13) % 88) / 100.0 AS s, (card_id + word_no) % 5 = 0 AND (word NOT LIKE '%g%' OR (card_id + line_no + word_no) % 3 <> 0) AS better,
  row_number() OVER (PARTITION BY card_id ORDER BY line_no, word_no) - 1 AS i, count(*) OVER (PARTITION BY card_id) AS m FROM word),
tokens AS (
  SELECT card_id, line_no, word_no, i AS tok_idx, 'normal' AS pass_name, NOT better AS chosen, word AS text, round(s, 4) AS score, x::DOUBLE AS x1, y AS y1, (x + 8.0 * length(word))::DOUBLE AS x2, y + 20.0 AS y2 FROM placed
  UNION ALL
  SELECT card_id, line_no, word_no, i + m, 'bright', better, CASE WHEN (card_id + line_no + word_no) % 3 = 0 THEN replace(word, 'g', 'q') ELSE word END, round(s + CASE WHEN better THEN 0.02 ELSE -0.03 END, 4), (x + 1.0)::DOUBLE, y + 1.0, (x + 1.0 + 8.0 * length(word))::DOUBLE, y + 21.0 FROM placed),
sized AS (SELECT *, greatest(1.0, x2 - x1) AS width, greatest(1.0, x2 - x1) / greatest(1, CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0 THEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) ELSE length(text) END) AS cw FROM tokens),
pairs AS (SELECT a.card_id, a.tok_idx AS a, b.tok_idx AS b, (a.x2 - a.x1 - 1) * 19.0 / (2 * (a.x2 - a.x1) * 20 - (a.x2 - a.x1 - 1) * 19.0) AS iou
  FROM tokens a JOIN tokens b ON a.card_id = b.card_id AND a.line_no = b.line_no AND a.word_no = b.word_no AND a.pass_name = 'normal' AND b.pass_name = 'bright')"""

ALL_LINES = LINES + """,
d AS (SELECT -doc_id - 1 AS card_id, string_split(text, chr(10)) AS ls FROM documents),
d2 AS (SELECT card_id, ls, unnest(range(0, len(ls))) AS line_no FROM d),
all_lines AS (SELECT card_id, line_no, text FROM contact_lines UNION ALL SELECT card_id, line_no, list_extract(ls, (line_no + 1)::INT) FROM d2)"""

TRIMMED = ALL_LINES + f""",
r AS (SELECT card_id, line_no, regexp_extract_all(text, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+') AS rs FROM all_lines WHERE text LIKE '%@%'),
r2 AS (SELECT card_id, line_no, rs, unnest(range(0, len(rs))) AS pos FROM r),
raw AS (SELECT card_id, line_no, pos, lower(rtrim(list_extract(rs, (pos + 1)::INT), '.,;:')) AS m FROM r2),
lab AS (SELECT card_id, line_no, pos, split_part(m, '@', 1) AS loc, list_filter(string_split(ltrim(split_part(m, '@', 2), '.,;:'), '.'), lambda x: x <> '') AS ls FROM raw),
lab2 AS (SELECT *, list_extract(ls, len(ls)::INT) AS final, array_to_string(list_slice(ls, greatest(len(ls) - 1, 1), len(ls)), '.') AS tail2 FROM lab WHERE len(ls) >= 2),
tld AS (SELECT unnest({_list(C.TLDS)}) AS t),
cutl AS (SELECT l.card_id, l.line_no, l.pos, max(length(t)) AS n FROM lab2 l JOIN tld ON starts_with(l.final, t) GROUP BY 1, 2, 3),
fin AS (SELECT l.card_id, l.line_no, l.pos, loc, CASE WHEN list_contains({_list(C.MULTI_TLDS)}, tail2) THEN array_to_string(ls, '.')
   WHEN c.n IS NOT NULL THEN array_to_string(list_append(list_slice(ls, 1, len(ls) - 1), left(final, c.n::INT)), '.')
   WHEN regexp_matches(final, '^[a-z][a-z]') THEN array_to_string(list_append(list_slice(ls, 1, len(ls) - 1), left(final, 2)), '.') END AS dom
  FROM lab2 l LEFT JOIN cutl c ON l.card_id = c.card_id AND l.line_no = c.line_no AND l.pos = c.pos),
ok AS (SELECT card_id, line_no, pos, loc || '@' || dom AS email FROM fin WHERE dom IS NOT NULL AND length(loc) BETWEEN 1 AND 64 AND length(dom) BETWEEN 2 AND 253),
once AS (SELECT *, row_number() OVER (PARTITION BY card_id, email ORDER BY line_no, pos) AS k FROM ok),
em AS (SELECT card_id, email, row_number() OVER (PARTITION BY card_id ORDER BY line_no, pos) AS rank FROM once WHERE k = 1)"""

HARD = """,
hc AS (SELECT c_custkey::BIGINT AS k, c_custkey::VARCHAR AS n, list_extract(['Ana','Ben','Carla','Dave','Elena','Farid','Grace','Hugo'], (c_custkey % 8 + 1)::INT) AS f,
  list_extract(['Moreno','Keller','Tanaka','Okafor','Silva','Novak','Haddad','Lindqvist'], ((c_custkey // 8) % 8 + 1)::INT) AS l, '+65 9' || lpad(((c_custkey::BIGINT * 37) % 10000000)::VARCHAR, 7, '0') AS p FROM customer),
hard_lines AS (
  SELECT k AS card_id, 0 AS line_no, CASE WHEN k % 6 = 0 THEN f WHEN k % 3 = 0 THEN f || ' de ' || l ELSE f || ' ' || l END AS text FROM hc
  UNION ALL SELECT k, 1, CASE WHEN k % 5 <> 0 THEN 'write to user' || n || '@mail' || (k % 10)::VARCHAR || '.com today' ELSE 'Mail: User' || n || '@mail' || (k % 10)::VARCHAR || '.co.uk, or call' END FROM hc
  UNION ALL SELECT k, 2, list_extract(['M A N A G E R', 'Sales Manager.', 'Senior  Engineer,;', 'HEAD 0F SALES'], (k % 4 + 1)::INT) FROM hc
  UNION ALL SELECT k, 3, list_extract(['VERTEX','ORBIT','CEDAR','MARLIN','QUARTZ','SUMMIT','HARBOR'], (k % 7 + 1)::INT) || ' ' || list_extract(['LTD','GMBH','GROUP'], (k % 3 + 1)::INT) || CASE WHEN k % 2 = 0 THEN '.,' ELSE '' END FROM hc
  UNION ALL SELECT k, 4, CASE WHEN k % 3 = 0 THEN p || ' / +44 20' || lpad(((k * 91) % 100000000)::VARCHAR, 8, '0') ELSE p END FROM hc WHERE k % 11 <> 0
  UNION ALL SELECT k, 5, (k % 90 + 10)::VARCHAR || ' North Road, Unit ' || (k % 7)::VARCHAR || ', Singapore ' || ((k * 131) % 900000 + 100000)::VARCHAR FROM hc WHERE k % 7 <> 0
  UNION ALL SELECT k, 6, CASE WHEN k % 2 = 0 THEN 'www.firm' || n || '.com' ELSE 'linkedin.com/in/user-' || n || ' @user' || n END FROM hc
  UNION ALL SELECT k, 7, list_extract(['London SW1A 1AA', '東京都千代田区 100-0001', 'नमस्ते कार्यालय', 'مكتب دبي', 'Toronto M5V 3L9', 'Reno 89501-1234'], (k % 6 + 1)::INT) FROM hc),
both_lines AS (SELECT * FROM contact_lines UNION ALL SELECT -card_id - 1, line_no, text FROM hard_lines)"""

_LETTERS = "length(regexp_replace({0}, '[^A-Za-z]', '', 'g'))"
_ALPHA = _LETTERS + " / greatest(1, length({0}))::DOUBLE"
_DIGITS = "length(regexp_replace({0}, '[^0-9]', '', 'g'))"
_WORDS = "len(string_split({0}, ' '))"
_UPPER = "(regexp_matches({0}, '[A-Z]') AND NOT regexp_matches({0}, '[a-z]'))"
_TITLE = "(NOT regexp_matches({0}, '(^|[^A-Za-z])[a-z]') AND NOT regexp_matches({0}, '[A-Za-z][A-Z]'))"
_CANON = "regexp_replace(translate(lower({0}), 'l|oqsbz', '110g582'), '[^a-z0-9]', '', 'g')"
_CONF = "length(regexp_replace({0}, '[^lI|oqQSBsZz]', '', 'g'))"


#: A token as lines take it.
_WORD_OF = "rtrim(CASE WHEN length(regexp_replace({0}, '[^A-Z]', '', 'g')) >= 0.6 * length(regexp_replace({0}, '[^A-Za-z]', '', 'g')) AND regexp_matches({0}, '[A-Za-z]') THEN translate(trim({0}), '0134578', 'OIEASTB') ELSE trim({0}) END, '.,;:')"


def _hint(values, c="text") -> str:
    return f"regexp_matches(lower({c}), '{_any(values)}')"


_FID = (
    f"(least(length(text), 40) + 18.0 * {_ALPHA.format('text')} - 2.5 * {_CONF.format('text')} - 0.25 * {_DIGITS.format('text')}"
    f" + CASE WHEN {_TITLE.format('text')} OR {_UPPER.format('text')} THEN 3.0 ELSE 0.0 END + CASE WHEN {_hint(C.COMPANY_HINTS)} THEN 1.5 ELSE 0.0 END)"
)
_POSTAL = "regexp_extract(text, '([0-9]{6})$', 1)"

#: Names, companies and titles of the cards, as their rules pick them from the six lines.
CHOSEN = LINES + f""",
v AS (SELECT card_id, line_no, text, row_number() OVER (PARTITION BY card_id ORDER BY line_no) - 1 AS idx FROM contact_lines),
nm0 AS (SELECT *, CASE WHEN {_WORDS.format('text')} IN (2, 3) THEN 30.0 ELSE 12.0 END + CASE WHEN {_TITLE.format('text')} THEN 18.0 ELSE 10.0 END + CASE WHEN idx <= 2 THEN 10.0 ELSE 2.0 END + 15.0 * {_ALPHA.format('text')} AS score
  FROM v WHERE NOT {_hint(C.NAME_REJECTS)} AND {_DIGITS.format('text')} = 0 AND {_WORDS.format('text')} BETWEEN 1 AND 4
   AND NOT {_hint(C.ADDRESS_HINTS)} AND NOT {_hint(C.JOB_HINTS)} AND NOT {_hint(C.COMPANY_HINTS)} AND {_ALPHA.format('text')} >= 0.7),
nm AS (SELECT card_id, text AS name, round(least(0.99, 0.4 + score / 100.0), 6) AS name_confidence FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY score DESC, length(text) DESC, idx) AS k FROM nm0) WHERE k = 1),
co0 AS (SELECT v.*, regexp_matches(upper(v.text), '{_any(C.COMPANY_SUFFIXES)}') AS suffix, {_hint(C.COMPANY_HINTS, 'v.text')} AS hint, {_UPPER.format('v.text')} AS up
  FROM v LEFT JOIN nm USING (card_id) WHERE v.text NOT LIKE '%@%' AND (nm.name IS NULL OR {_CANON.format('v.text')} <> {_CANON.format('nm.name')})
   AND ({_hint(C.COMPANY_HINTS, 'v.text')} OR ({_DIGITS.format('v.text')} = 0 AND (({_UPPER.format('v.text')} AND length(v.text) <= 32) OR ({_WORDS.format('v.text')} BETWEEN 1 AND 4 AND {_ALPHA.format('v.text')} >= 0.55))))),
co1 AS (SELECT *, CASE WHEN hint THEN 28.0 ELSE 8.0 END + CASE WHEN up THEN 18.0 ELSE 9.0 END + CASE WHEN suffix THEN 25.0 ELSE 0.0 END
   - CASE WHEN {_WORDS.format('text')} <= 4 AND NOT regexp_matches(text, '[^A-Za-z .]') AND NOT suffix THEN 15.0 ELSE 0.0 END + CASE WHEN idx <= 2 THEN 8.0 ELSE 3.0 END + 14.0 * {_ALPHA.format('text')} AS score FROM co0),
co AS (SELECT card_id, text AS company, round(least(0.99, 0.35 + score / 100.0), 6) AS company_confidence FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY score DESC, length(text) DESC, idx) AS k FROM co1) WHERE k = 1),
ti0 AS (SELECT *, CASE WHEN {_hint(C.STRONG_JOB_HINTS)} THEN 30.0 ELSE 12.0 END + 8.0 + 10.0 + 15.0 * {_ALPHA.format('text')} AS score FROM v WHERE {_hint(C.JOB_HINTS)}),
ti AS (SELECT card_id, text AS title, round(least(0.99, 0.38 + score / 100.0), 6) AS title_confidence FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY score DESC, idx) AS k FROM ti0) WHERE k = 1)"""

BATCHES = LINES + f""",
rec AS (SELECT card_id, coalesce(max(CASE WHEN line_no = 0 THEN text END), '') AS name, coalesce(max(CASE WHEN line_no = 1 THEN text END), '') AS title, coalesce(max(CASE WHEN line_no = 2 THEN text END), '') AS company,
  coalesce(max(CASE WHEN line_no = 3 THEN text END), '') AS email, coalesce(max(CASE WHEN line_no = 4 THEN text END), '') AS phone, coalesce(max(CASE WHEN line_no = 5 THEN text END), '') AS address FROM contact_lines GROUP BY card_id),
sig AS (SELECT *, {_CANON.format('name')} || '|' || {_CANON.format('company')} || '|' || {_CANON.format('title')} || '|' || {_CANON.format('email')} || '|' || {_CANON.format('phone')} || '||' || {_CANON.format('address')} AS signature FROM rec),
old AS (SELECT * FROM sig WHERE card_id % 2 = 0 OR card_id % 10 = 5), new AS (SELECT * FROM sig WHERE card_id % 2 = 1 OR card_id % 10 = 0)"""

PROFILES = """
WITH c AS (SELECT c_custkey::BIGINT AS k, c_custkey::VARCHAR AS n FROM customer),
p AS (
  SELECT k AS card_id, 0 AS line_no, 'mail user' || n || '@site' || n || '.com' AS text FROM c
  UNION ALL SELECT k, 1, 'www.site' || n || '.com/home' FROM c WHERE k % 3 <> 0 UNION ALL SELECT k, 2, 'blog' || n || '.org/a' FROM c WHERE k % 2 = 0
  UNION ALL SELECT k, 3, 'linkedin.com/in/user-' || n FROM c WHERE k % 4 <> 0 UNION ALL SELECT k, 4, 'see github.com/user' || n FROM c WHERE k % 5 = 0
  UNION ALL SELECT k, 5, 'twitter.com/user' || n FROM c WHERE k % 3 = 1 UNION ALL SELECT k, 6, 'me: @user' || n || ' and @second' || n FROM c WHERE k % 7 < 3)"""

PAGES = """
WITH dl AS (SELECT doc_id AS card_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
dn AS (SELECT card_id, ls, unnest(range(0, len(ls))) AS line_no FROM dl),
dw AS (SELECT card_id, line_no, string_split(list_extract(ls, (line_no + 1)::INT), ' ') AS ws FROM dn WHERE trim(list_extract(ls, (line_no + 1)::INT), ' ') <> ''),
di AS (SELECT card_id, line_no, unnest(ws) AS word, unnest(range(0, len(ws))) AS word_no FROM dw),
dp AS (SELECT *, 96.0 * word_no AS x, 0.1 + ((card_id * 31 + line_no * 7 + word_no * 13) % 88) / 100.0 AS s FROM di),
pt AS (
  SELECT card_id, line_no, (line_no * 65536 + word_no) * 2 AS tok_idx, word AS text, round(s, 4) AS score, x::DOUBLE AS x1, (x + 8.0 * length(word))::DOUBLE AS x2, 30.0 * line_no AS y1 FROM dp WHERE word <> ''
  UNION ALL SELECT card_id, line_no, (line_no * 65536 + word_no) * 2 + 1, CASE WHEN (card_id + line_no + word_no) % 3 = 0 THEN replace(word, 'g', 'q') ELSE word END, round(s + CASE WHEN (card_id + word_no) % 5 = 0 THEN 0.02 ELSE -0.03 END, 4), x + 1.0, x + 1.0 + 8.0 * length(word), 30.0 * line_no + 1 FROM dp WHERE word <> ''),
pk AS (SELECT *, """ + _CANON.format("text") + """ AS canon FROM pt),
pp AS (SELECT a.card_id, a.tok_idx AS a, b.tok_idx AS b, a.score AS sa, b.score AS sb, (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (20 - abs(a.y1 - b.y1)) AS i, (a.x2 - a.x1) * 20 + (b.x2 - b.x1) * 20 AS u
  FROM pk a JOIN pk b ON a.card_id = b.card_id AND a.line_no = b.line_no AND a.canon = b.canon AND a.tok_idx < b.tok_idx AND a.x1 < b.x2 AND b.x1 < a.x2),
po AS (SELECT *, (i / (u - i))::DOUBLE AS iou FROM pp WHERE i / (u - i) >= 0.58)"""

SQL: dict[str, str] = {
    "emails": TRIMMED + " SELECT card_id, rank, email FROM em",
    "emails_by_domain": TRIMMED + " SELECT split_part(email, '@', 2) AS domain, count(*) AS n_cards, min(email) AS first_email FROM em GROUP BY 1",
    "profile_lines": LINES + f"""
SELECT line_no, count(*) AS n_lines, round(avg({_ALPHA.format('text')}), 6) AS alpha, sum({_DIGITS.format('text')})::BIGINT AS digits,
 sum(CASE WHEN {_LETTERS.format('text')} > 0 AND length(regexp_replace(text, '[^A-Z]', '', 'g')) / greatest(1, {_LETTERS.format('text')})::DOUBLE >= 0.6 THEN 1 ELSE 0 END)::BIGINT AS upper_lines,
 sum({_CONF.format('text')})::BIGINT AS confusions, sum({_WORDS.format('text')})::BIGINT AS words, sum(length(text))::BIGINT AS chars, count(DISTINCT {_CANON.format('text')}) AS keys, round(avg({_FID}), 6) AS fidelity
FROM contact_lines GROUP BY line_no""",
    "token_geometry": TOKENS + " SELECT card_id, tok_idx, pass_name, text, score, x1, y1, x2, y2, width, (y1 + y2) / 2 AS cy, round(cw, 6) AS char_width FROM sized",
    "confidence_split": TOKENS + " SELECT pass_name, score >= 0.18 AS seen, score >= 0.45 AS sure, count(*) AS n, round(avg(score), 6) AS mean_score FROM tokens GROUP BY 1, 2, 3",
    "payload_dict_tokens": TOKENS + " SELECT card_id, pass_name, row_number() OVER (PARTITION BY card_id, pass_name ORDER BY tok_idx) - 1 AS tok_idx, text, score, x1, y1, x2, y2 FROM tokens",
    "payload_item_tokens": TOKENS + " SELECT card_id, pass_name, row_number() OVER (PARTITION BY card_id, pass_name ORDER BY tok_idx) - 1 AS tok_idx, text, score, x1, y1, x2, y2 FROM tokens",
    "overlap_pairs": TOKENS + " SELECT card_id, a, b, round(iou, 6) AS iou FROM pairs WHERE iou >= 0.58",
    "token_dedup": TOKENS + " SELECT card_id, tok_idx, pass_name, text, score FROM tokens WHERE chosen",
    "card_stats": TOKENS + " SELECT card_id, count(*) AS n_tokens, median(y2 - y1) AS median_height, round(median(cw), 6) AS median_char, round(stddev_pop(cw), 6) AS sd_char, min(y1) AS y_min, max(y2) AS y_max FROM sized GROUP BY card_id",
    "row_clusters": TOKENS + " SELECT card_id, dense_rank() OVER (PARTITION BY card_id ORDER BY line_no) - 1 AS row_id, tok_idx FROM tokens WHERE chosen",
    "anchor_rows": TOKENS + " SELECT card_id, dense_rank() OVER (PARTITION BY card_id ORDER BY line_no) - 1 AS row_id, tok_idx FROM tokens WHERE chosen",
    "layout_lines": TOKENS + """, l AS (SELECT card_id, line_no, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, max(y2) - min(y1) AS height, string_agg(word, ' ' ORDER BY word_no) AS text FROM (SELECT *, """ + _WORD_OF.format("text") + """ AS word FROM tokens) WHERE chosen GROUP BY card_id, line_no)
SELECT card_id, dense_rank() OVER (PARTITION BY card_id ORDER BY y1) - 1 AS row_id, text, x1, y1, x2, y2, height FROM l""",
    "row_features": LINES + f"""
SELECT card_id, line_no, {_WORDS.format('text')} AS word_count, {_DIGITS.format('text')} > 0 AS has_digit, round({_DIGITS.format('text')} / length(text)::DOUBLE, 6) AS digit_density,
 round(length(regexp_replace(text, '[^,./#@:;-]', '', 'g')) / length(text)::DOUBLE, 6) AS punct_density, round({_ALPHA.format('text')}, 6) AS alpha_density, {_UPPER.format('text')} AS all_caps,
 len(list_filter(string_split(text, ' '), lambda x: regexp_matches(x, '^[A-Z]'))) / {_WORDS.format('text')}::DOUBLE >= 0.6 AS title_case, length(regexp_replace(text, '[^,/|]', '', 'g')) AS separators FROM contact_lines""",
    "row_shapes": LINES + HARD + r"""
SELECT card_id, line_no, regexp_matches(text, '[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,253}[.][A-Za-z]{2,12}') AS is_email, length(regexp_replace(regexp_extract(text, '[+(]?[0-9][0-9\s().-]{5,16}[0-9]'), '[^0-9]', '', 'g')) BETWEEN 7 AND 15 AS is_phone,
 regexp_matches(text, '(?i)(https?://|www[.])[a-z0-9./_%?=&#@-]+|[a-z0-9][a-z0-9_-]*[.][a-z]{2,12}') AS is_web,
 regexp_matches(text, '(?i)\b[0-9]{4,7}\b|\b[a-z]{1,2}[0-9][a-z0-9]?\s*[0-9][a-z]{2}\b|\b[0-9]{3}-[0-9]{4}\b|\b[a-z][0-9][a-z]\s*[0-9][a-z][0-9]\b') AS is_postal,
 regexp_matches(text, '(?i)(^|[\s,|•·])(@[a-z0-9_.]{2,32}|/in/[a-z0-9_-]{3,100}|linkedin[.]com/in/[a-z0-9_-]+|github[.]com/[a-z0-9_-]+|twitter[.]com/[a-z0-9_]+|x[.]com/[a-z0-9_]+|instagram[.]com/[a-z0-9_.]+)|(^|[^A-Za-z0-9])@[a-z0-9_.]{2,32}') AS is_social FROM both_lines""",
    "address_firewall": LINES + HARD + f""",
rg(rank, region, pat) AS (VALUES {", ".join(f"({i}, '{r}', '{p}')" for i, (r, p) in enumerate(C.POSTAL))}),
ph AS (SELECT card_id, line_no, text, (SELECT min(rank) FROM rg WHERE regexp_matches(text, pat)) AS rank, {_hint(C.ADDRESS_HINTS)} AS hint,
  regexp_matches(text, '(^|[^\\w])([+][0-9]{{1,3}}[\\s().-]*)?([(]?[0-9]{{1,4}}[)]?[\\s().-]*){{1,4}}[0-9]{{3,4}}([\\s().-]*[0-9]{{1,4}}){{0,3}}($|[^\\w])') OR contains(text, '+') AS phone FROM both_lines),
fl AS (SELECT ph.*, region, pat, rank IS NOT NULL AND (hint OR NOT phone) AS coded FROM ph LEFT JOIN rg USING (rank))
SELECT card_id, line_no, CASE WHEN coded THEN region END AS region, CASE WHEN coded THEN regexp_extract(text, pat) END AS postal FROM fl WHERE coded OR (hint AND {_ALPHA.format('text')} >= 0.45 AND {_DIGITS.format('text')} >= 1)""",
    "addresses": LINES + f" SELECT card_id, text AS address, 'SG' AS region, {_ALPHA.format('text')} >= 0.45 AS validated FROM contact_lines WHERE line_no = 5",
    "hint_matches": LINES + f" SELECT line_no, " + ", ".join(f"sum(CASE WHEN {_hint(h)} THEN 1 ELSE 0 END)::BIGINT AS {n}" for n, h in (("address", C.ADDRESS_HINTS), ("job", C.JOB_HINTS), ("company", C.COMPANY_HINTS))) + " FROM contact_lines GROUP BY line_no",
    "numbering_plan": f"""
WITH c AS (SELECT c_custkey::BIGINT AS k FROM customer),
n AS (SELECT k AS card_id, CASE WHEN k % 5 = 0 THEN '' ELSE '+' END || ((k * 7) % 999 + 1)::VARCHAR || CASE WHEN k % 3 = 0 THEN ' ' ELSE '-' END || left(lpad(((k * 7919 + 13) % 100000000000)::VARCHAR, 11, '0'), (6 + k % 6)::INT) AS phone FROM c),
d AS (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS d FROM n),
plan(code, region, low, high) AS (VALUES {", ".join(f"('{c}', '{r}', {C.NATIONAL_DIGITS.get(r, (7, 11))[0]}, {C.NATIONAL_DIGITS.get(r, (7, 11))[1]})" for c, r in C.CALLING_CODES.items())}),
fit AS (SELECT card_id, region, '+' || code || ' ' || substr(d, length(code) + 1) AS number, row_number() OVER (PARTITION BY card_id ORDER BY length(code) DESC) AS k FROM d JOIN plan ON starts_with(d, code) AND length(d) - length(code) BETWEEN low AND high WHERE phone LIKE '+%')
SELECT n.card_id, n.phone, fit.region, fit.number FROM n LEFT JOIN fit ON n.card_id = fit.card_id AND fit.k = 1""",
    "best_names": CHOSEN + " SELECT * FROM nm",
    "best_companies": CHOSEN + " SELECT * FROM co",
    "best_titles": CHOSEN + " SELECT * FROM ti",
    "urls": """
WITH u AS (SELECT page_id AS card_id, rtrim(regexp_extract(url, '(?i)(https?://[a-z0-9.-]+[.][a-z]{2,63}(/[A-Za-z0-9_./?%&=+#~-]*)?)', 1), '.,;:') AS a FROM pages),
b AS (SELECT card_id, a, 'https://www.' || regexp_replace(a, '^https?://', '') AS w FROM u WHERE a <> '')
SELECT card_id, 1 AS rank, a AS url FROM b UNION ALL SELECT card_id, 2, w FROM b WHERE lower(a) <> lower(w)""",
    "card_corpus": TOKENS + """, l AS (SELECT card_id, line_no, string_agg(""" + _WORD_OF.format("text") + """, ' ' ORDER BY word_no) AS text, avg(score) AS s FROM tokens WHERE pass_name = 'normal' GROUP BY card_id, line_no)
SELECT card_id, string_agg(text, ' ' ORDER BY line_no) AS corpus, count(*)::INT AS n_lines, round(avg(s), 6) AS confidence FROM l GROUP BY card_id""",
    "candidate_flags": TOKENS + f""", h AS (SELECT *, max(floor(y2)) OVER (PARTITION BY card_id) AS height, lower(text) AS low FROM tokens)
SELECT card_id, tok_idx, text, array_to_string(list_filter([CASE WHEN NOT regexp_full_match(text, '[A-Za-z .''-]+') THEN 'BAD_CHARS' END, CASE WHEN list_contains({_list(AUDIT_JOBS)}, low) THEN 'JOB_KEYWORD' END,
  CASE WHEN list_contains({_list(AUDIT_COMPANIES)}, low) THEN 'COMPANY_KEYWORD' END, CASE WHEN regexp_matches(low, '{_any(AUDIT_PLACES)}') THEN 'ADDRESS_KEYWORD' END, CASE WHEN regexp_matches(low, '[.](com|in|org|net|co[.]in)') THEN 'EMAIL_PATTERN' END], lambda x: x IS NOT NULL), ',') AS flags,
 y1 <= 0.65 * height AS in_zone, CASE WHEN {_UPPER.format('text')} THEN 'CAPS' WHEN regexp_matches(text, '^[A-Z]') THEN 'Title' ELSE 'mixed' END AS caps FROM h""",
    "audit_lines": TOKENS + """ SELECT card_id, dense_rank() OVER (PARTITION BY card_id ORDER BY line_no) - 1 AS row_id, count(*) AS n_tokens, string_agg(text, '' ORDER BY y1, x1) AS joined, round(avg(score), 6) AS confidence,
 nullif(regexp_extract(string_agg(text, '' ORDER BY y1, x1), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}'), '') AS email FROM tokens WHERE pass_name = 'normal' GROUP BY card_id, line_no""",
    "clean_tokens": ALL_LINES + r""", a AS (SELECT card_id, line_no, regexp_replace(regexp_replace(text, '\s+@\s+', '@', 'g'), '\s+[.]\s+', '.', 'g') AS text FROM all_lines WHERE trim(text) <> ''),
b AS (SELECT card_id, line_no, CASE WHEN regexp_matches(text, '^([A-Z]\s+){2,}[A-Z]$') THEN replace(text, ' ', '') ELSE text END AS text FROM a)
SELECT card_id, line_no, regexp_replace(text, '([A-Z]{2,})\s+([A-Z]{2,})', '\1\2', 'g') AS text FROM b""",
    "websites": PROFILES + """, m AS (SELECT card_id, min(CASE WHEN line_no = 1 THEN 1 WHEN line_no = 2 THEN 2 END) AS a FROM p GROUP BY card_id),
w AS (SELECT card_id, line_no, unnest(regexp_extract_all(text, '(?i)((https?://|www[.])[A-Za-z0-9./_%?=&#@-]+|[A-Za-z0-9][A-Za-z0-9_-]*[.][A-Za-z]{2,12}(/[^ ]*)?)', 1)) AS web FROM p WHERE line_no > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY line_no) AS r FROM w WHERE web NOT LIKE '%@%' AND NOT contains(web, 'site' || card_id::VARCHAR || '.com'))
SELECT card_id, web AS website FROM k WHERE r = 1""",
    "social_profiles": PROFILES + """, s AS (SELECT card_id, max(regexp_extract(text, '(linkedin[.]com/in/[a-z0-9-]+)', 1)) AS linkedin, max(regexp_extract(text, '(github[.]com/[a-z0-9-]+)', 1)) AS github, max(regexp_extract(text, '(twitter[.]com/[a-z0-9]+)', 1)) AS t,
  max(CASE WHEN line_no = 6 THEN regexp_extract(text, '(@user[0-9]+)', 1) ELSE '' END) AS a, max(regexp_extract(text, '(@second[0-9]+)', 1)) AS b FROM p GROUP BY card_id)
SELECT card_id, nullif(linkedin, '') AS linkedin, nullif(github, '') AS github, coalesce(nullif(t, ''), nullif(a, '')) AS twitter, CASE WHEN t = '' THEN nullif(b, '') ELSE nullif(a, '') END AS instagram FROM s""",
    "detections": TOKENS + " SELECT 'card' || card_id::VARCHAR || '.png' AS filename, '/in/card' || card_id::VARCHAR || '.png' AS filepath, text, score::DOUBLE AS confidence, x1::INT AS xmin, y1::INT AS ymin, x2::INT AS xmax, y2::INT AS ymax FROM tokens",
    "recognised": "SELECT doc_id::VARCHAR AS label, 'normal' AS pass_name, len(string_split(text, ' ')) AS n_tokens, len(string_split(text, ' ')) - 1 AS last FROM documents WHERE text IS NOT NULL",
    "bundle": "SELECT * FROM (VALUES ('fields', 8), ('records', 1), ('rows', 1)) v(kind, m), LATERAL (SELECT m * count(*) AS n, count(*) AS n_cards FROM customer) c".replace("SELECT *", "SELECT kind, n, n_cards", 1),
    "file_stems": BATCHES + " SELECT card_id, replace(name, ' ', '_') AS stem FROM rec",
    "sparse_vcards": LINES + HARD + """,
r AS (SELECT card_id, max(CASE WHEN line_no = 0 AND card_id % 5 <> 0 THEN text END) AS name, max(CASE WHEN line_no = 2 THEN text END) AS title, max(CASE WHEN line_no = 3 AND card_id % 4 <> 0 THEN text END) AS company, max(CASE WHEN line_no = 1 THEN regexp_extract(text, '[^ ]+@[^ ]+') END) AS email,
  max(CASE WHEN line_no = 4 THEN split_part(text, ' / ', 1) END) AS p1, nullif(max(CASE WHEN line_no = 4 THEN split_part(text, ' / ', 2) END), '') AS p2, max(CASE WHEN line_no = 6 AND card_id % 2 = 0 THEN text END) AS web, max(CASE WHEN line_no = 5 THEN text END) AS address FROM hard_lines GROUP BY card_id)
SELECT card_id, concat_ws(chr(10), 'BEGIN:VCARD', 'VERSION:3.0', 'FN:' || name, CASE WHEN contains(name, ' ') THEN 'N:' || regexp_replace(name, '^[^ ]+ ', '') || ';' || split_part(name, ' ', 1) || ';;;' ELSE 'N:' || name || ';;;;' END, 'ORG:' || company, 'TITLE:' || title,
 'EMAIL;TYPE=INTERNET:' || email, 'TEL;TYPE=VOICE,PREF:' || p1, 'TEL;TYPE=VOICE:' || p2, 'URL:' || web, 'ADR;TYPE=WORK:;;' || replace(address, ', ', '; ') || ';;;;', 'END:VCARD') AS vcard FROM r""",
    "master_merged": BATCHES + " SELECT card_id, '2024_03' AS month, 2 AS run_id, email FROM new UNION ALL SELECT card_id, '2024_03', 1, email FROM old WHERE signature NOT IN (SELECT signature FROM new)",
    "first_emails": LINES + HARD + """, m AS (SELECT card_id, line_no, lower(regexp_extract(text, '[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,253}[.][A-Za-z]{2,12}')) AS m FROM both_lines)
SELECT card_id, arg_min(m, line_no) AS email FROM m WHERE m <> '' GROUP BY card_id""",
    "hard_line_texts": LINES + HARD + f""",
hw AS (SELECT card_id, line_no, string_split(text, ' ') AS ws FROM hard_lines),
hi AS (SELECT card_id, line_no, ws, unnest(range(0, len(ws))) AS word_no FROM hw),
hp AS (SELECT card_id, line_no, word_no, list_extract(ws, (word_no + 1)::INT) AS word, coalesce(list_sum(list_transform(list_slice(ws, 1, word_no::INT), lambda w: length(w) + 1)), 0) AS before FROM hi),
hq AS (SELECT *, CASE WHEN length(word) >= 6 AND (card_id + word_no) % 3 = 0 THEN 2 WHEN length(word) >= 6 AND (card_id + word_no) % 3 = 1 THEN 3 ELSE length(word) END AS cut FROM hp),
ht AS (SELECT card_id, line_no, word_no, 0 AS part, left(word, cut::INT) AS text, 8.0 * before AS x1, 8.0 * (before + cut) AS x2 FROM hq
  UNION ALL SELECT card_id, line_no, word_no, cut, substr(word, (cut + 1)::INT), 8.0 * (before + cut), 8.0 * (before + length(word)) FROM hq WHERE cut < length(word)),
hs AS (SELECT *, {_WORD_OF.format("text")} AS w FROM ht),
hl AS (SELECT *, lag(w) OVER (PARTITION BY card_id, line_no ORDER BY x1, word_no, part) AS b, x1 - lag(x2) OVER (PARTITION BY card_id, line_no ORDER BY x1, word_no, part) AS gap FROM hs WHERE w <> ''),
hg AS (SELECT card_id, line_no, string_agg(CASE WHEN b IS NULL OR (gap <= 0.45 * 8.0 AND (length(w) <= 2 OR length(b) <= 2 OR b LIKE '%-')) THEN '' ELSE ' ' END || w, '' ORDER BY x1, word_no, part) AS t FROM hl GROUP BY card_id, line_no),
hx AS (SELECT card_id, line_no, max(x2)::DOUBLE AS x2 FROM ht GROUP BY card_id, line_no)
SELECT card_id, dense_rank() OVER (PARTITION BY card_id ORDER BY line_no) - 1 AS row_id, rtrim(CASE WHEN regexp_matches(t, '^[^ ]( [^ ])+$') THEN replace(t, ' ', '') ELSE t END, '.,;:') AS text, x2, 20.0::DOUBLE AS height, 8.0::DOUBLE AS char_median FROM hg JOIN hx USING (card_id, line_no)""",
    "social_handles": PROFILES + r""", d AS (SELECT -doc_id - 1 AS card_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), d2 AS (SELECT card_id, unnest(range(0, len(ls))) AS line_no, ls FROM d),
a AS (SELECT card_id, line_no, text FROM p UNION ALL SELECT card_id, line_no, list_extract(ls, (line_no + 1)::INT) FROM d2),
t AS (SELECT card_id, line_no, regexp_extract_all(' ' || text || ' ', '[^\p{L}\p{N}_](@[A-Za-z0-9_.]{2,30})', 1) AS hs FROM a WHERE text LIKE '%@%'),
u AS (SELECT card_id, line_no, hs, unnest(range(0, len(hs))) AS pos FROM t), h AS (SELECT card_id, line_no, pos, list_extract(hs, (pos + 1)::INT) AS handle FROM u),
o AS (SELECT *, row_number() OVER (PARTITION BY card_id, lower(handle) ORDER BY line_no, pos) AS k FROM h)
SELECT card_id, row_number() OVER (PARTITION BY card_id ORDER BY line_no, pos) AS rank, handle, line_no AS row_id FROM o WHERE k = 1""",
    "reading_order": LINES + """
SELECT a.card_id, a.line_no AS src, b.line_no AS dst FROM contact_lines a JOIN contact_lines b ON a.card_id = b.card_id AND a.line_no < b.line_no
WHERE least(length(a.text), length(b.text)) / length(a.text)::DOUBLE >= 0.25""",
    "ancestors": LINES + """,
e AS (SELECT a.card_id, a.line_no AS src, b.line_no AS dst FROM contact_lines a JOIN contact_lines b ON a.card_id = b.card_id AND a.line_no < b.line_no WHERE least(length(a.text), length(b.text)) / length(a.text)::DOUBLE >= 0.25),
h1 AS (SELECT DISTINCT card_id, src AS row_id FROM e WHERE dst = 3),
h2 AS (SELECT DISTINCT e.card_id, e.src AS row_id FROM e JOIN h1 ON e.card_id = h1.card_id AND e.dst = h1.row_id)
SELECT * FROM h1 UNION SELECT * FROM h2""",
    "master_append": BATCHES + " SELECT card_id, '2024_03' AS month, signature FROM new WHERE signature NOT IN (SELECT signature FROM old)",
    "master_upsert": BATCHES + " SELECT card_id, '2024_03' AS month, 2 AS run_id, email FROM new UNION ALL SELECT card_id, '2024_03', 1, email FROM old WHERE signature NOT IN (SELECT signature FROM new)",
    "vcards": BATCHES + """
SELECT card_id, 'BEGIN:VCARD' || chr(10) || 'VERSION:3.0' || chr(10) || 'FN:' || name || chr(10) || 'ORG:' || company || chr(10) || 'TITLE:' || title || chr(10) || 'EMAIL;TYPE=INTERNET:' || email || chr(10)
 || 'TEL;TYPE=VOICE:' || phone || chr(10) || 'URL:' || chr(10) || 'ADR;TYPE=WORK:;;' || address || chr(10) || 'END:VCARD' AS vcard FROM rec""",
    "ink_segments": """
WITH r AS (SELECT l_orderkey // 200 AS page_id, row_number() OVER (PARTITION BY l_orderkey // 200 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS y, l_quantity AS ink FROM lineitem),
o AS (SELECT page_id, y, y - row_number() OVER (PARTITION BY page_id ORDER BY y) AS island FROM r WHERE ink > 25),
e AS (SELECT page_id, max(y) AS last FROM r GROUP BY page_id),
s AS (SELECT page_id, island, min(y) AS a, max(y) AS b FROM o GROUP BY page_id, island HAVING max(y) - min(y) + 1 > 3)
SELECT e.page_id, coalesce(greatest(a - 1, 0), 0) AS top, coalesce(least(b + 1, last), last) AS bottom FROM e LEFT JOIN s ON e.page_id = s.page_id""",
    "flat_labelled": LINES + f""",
l AS (SELECT card_id, line_no, text, regexp_matches(lower(text), '{_any(LABEL_JOBS)}') AS job, regexp_matches(lower(text), '{_any(LABEL_COMPANIES)}') AS firm FROM contact_lines WHERE line_no < 3),
p AS (SELECT card_id, text AS name FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY CASE WHEN {_UPPER.format('text')} THEN 0 ELSE 1 END, line_no) AS k FROM l
  WHERE NOT job AND NOT firm AND ({_UPPER.format('text')} OR NOT regexp_matches(text, '(^| )[^A-Z ]'))) WHERE k = 1),
f AS (SELECT card_id, text AS company FROM (SELECT l.*, row_number() OVER (PARTITION BY l.card_id ORDER BY line_no) AS k FROM l LEFT JOIN p USING (card_id) WHERE (p.name IS NULL OR l.text <> p.name) AND (firm OR NOT job)) WHERE k = 1),
q AS (SELECT card_id, max(CASE WHEN line_no = 3 THEN text END) AS e, max(CASE WHEN line_no = 4 THEN text END) AS p, max(CASE WHEN line_no = 5 THEN text END) AS a FROM contact_lines GROUP BY card_id)
SELECT q.card_id, coalesce(p.name, 'Unknown') AS name, CASE WHEN q.p IS NULL THEN 'N/A' ELSE '+91 ' || right(regexp_replace(q.p, '[^0-9]', '', 'g'), 10) END AS phone, q.e AS email, coalesce(f.company, 'N/A') AS company, CASE WHEN f.company IS NULL THEN '' ELSE coalesce(q.a, '') END AS address
FROM q LEFT JOIN p ON q.card_id = p.card_id LEFT JOIN f ON q.card_id = f.card_id""",
    "line_blocks": LINES + f""",
g AS (SELECT *, lag(line_no) OVER (PARTITION BY card_id ORDER BY line_no) AS pl, lag(text) OVER (PARTITION BY card_id ORDER BY line_no) AS pt FROM contact_lines),
j AS (SELECT *, CASE WHEN pl = line_no - 1 AND text NOT LIKE '%@%' AND pt NOT LIKE '%@%' AND NOT ({_hint(C.COMPANY_HINTS, "pt || ' ' || text")} AND {_hint(C.JOB_HINTS, "pt || ' ' || text")}) THEN 0 ELSE 1 END AS brk FROM g),
b AS (SELECT *, sum(brk) OVER (PARTITION BY card_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) - 1 AS block_id FROM j)
SELECT card_id, block_id, string_agg(text, ' ' ORDER BY line_no) AS text, count(*) AS n_lines FROM b GROUP BY card_id, block_id""",
    "contacts": CHOSEN + """,
q AS (SELECT card_id, max(CASE WHEN line_no = 0 THEN text END) AS n, max(CASE WHEN line_no = 1 THEN text END) AS t, max(CASE WHEN line_no = 3 THEN text END) AS e, max(CASE WHEN line_no = 4 THEN text END) AS p, max(CASE WHEN line_no = 5 THEN text END) AS a FROM contact_lines GROUP BY card_id)
SELECT q.card_id, nm.name, co.company, CASE WHEN q.card_id % 4 = 0 THEN n || ' ' || t ELSE t END AS title, regexp_replace(e, 'orgx$', 'org') AS email, '+65 ' || substr(regexp_replace(p, '[^0-9]', '', 'g'), 3) AS phone,
 NULL::VARCHAR AS website, replace(a, ',', '') AS address, 1.0::DOUBLE AS quality_score, 'GREEN' AS quality_badge FROM q LEFT JOIN nm ON q.card_id = nm.card_id LEFT JOIN co ON q.card_id = co.card_id""",
    "stream_contacts": CHOSEN + """,
q AS (SELECT card_id, max(CASE WHEN line_no = 0 THEN text END) AS n, max(CASE WHEN line_no = 1 THEN text END) AS t, max(CASE WHEN line_no = 3 THEN text END) AS e, max(CASE WHEN line_no = 4 THEN text END) AS p, max(CASE WHEN line_no = 5 THEN text END) AS a FROM contact_lines GROUP BY card_id)
SELECT q.card_id, strftime(DATE '2024-01-10' + (q.card_id % 60)::INT, '%Y_%m') AS month, nm.name, co.company, CASE WHEN q.card_id % 4 = 0 THEN n || ' ' || t ELSE t END AS title, regexp_replace(e, 'orgx$', 'org') AS email, '+65 ' || substr(regexp_replace(p, '[^0-9]', '', 'g'), 3) AS phone,
 NULL::VARCHAR AS website, replace(a, ',', '') AS address, 'GREEN' AS quality_badge FROM q LEFT JOIN nm ON q.card_id = nm.card_id LEFT JOIN co ON q.card_id = co.card_id""",
    "field_table": CHOSEN + """,
q AS (SELECT card_id, max(CASE WHEN line_no = 1 THEN text END) AS t, max(CASE WHEN line_no = 3 THEN text END) AS e, max(CASE WHEN line_no = 4 THEN text END) AS p, max(CASE WHEN line_no = 5 THEN text END) AS a FROM contact_lines GROUP BY card_id),
f AS (SELECT q.card_id, 'title' AS field, t AS value FROM q
UNION ALL SELECT card_id, 'email', regexp_replace(e, 'orgx$', 'org') FROM q
UNION ALL SELECT card_id, 'phone', '+65 ' || substr(regexp_replace(p, '[^0-9]', '', 'g'), 3) FROM q
UNION ALL SELECT card_id, 'website', NULL FROM q
UNION ALL SELECT card_id, 'address', a FROM q
UNION ALL SELECT q.card_id, 'name', nm.name FROM q LEFT JOIN nm ON q.card_id = nm.card_id
UNION ALL SELECT q.card_id, 'company', co.company FROM q LEFT JOIN co ON q.card_id = co.card_id)
SELECT card_id, field, coalesce(value, '') AS value, value IS NOT NULL AS validated FROM f UNION ALL SELECT card_id, 'quality', 'GREEN', true FROM q""",
    "fused_blocks": LINES + """,
g AS (SELECT *, lag(line_no) OVER (PARTITION BY card_id ORDER BY line_no) AS pl FROM contact_lines),
b AS (SELECT *, sum(CASE WHEN pl = line_no - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY card_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) - 1 AS block_id FROM g)
SELECT card_id, block_id, string_agg(text, ' ' ORDER BY line_no) AS text, avg(30.0 * line_no + 10)::DOUBLE AS y_center, max(8.0 * length(text))::DOUBLE AS x2 FROM b GROUP BY card_id, block_id""",
    "row_prominence": LINES + """ SELECT card_id, line_no, 1.0::DOUBLE AS tps, round((line_no - min(line_no) OVER (PARTITION BY card_id)) / (max(line_no) OVER (PARTITION BY card_id) - min(line_no) OVER (PARTITION BY card_id))::DOUBLE, 6) AS pos FROM contact_lines""",
    "stream_first_seen": "SELECT DISTINCT " + _CANON.format("user_id::VARCHAR") + " || '|' || " + _CANON.format("event_type") + " || '|' || strftime(ts, '%Y%m%d') AS signature FROM events",
    "scripts": ALL_LINES + HARD + r""", l AS (SELECT card_id, text FROM all_lines WHERE trim(text) <> '' UNION ALL SELECT card_id + 1000000000, text FROM hard_lines),
sc AS (SELECT card_id, sum(length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g'))) AS cjk, sum(length(regexp_replace(text, '[^\x{0600}-\x{06ff}]', '', 'g'))) AS arabic, sum(length(regexp_replace(text, '[^\x{0900}-\x{097f}]', '', 'g'))) AS devanagari,
  sum(length(regexp_replace(text, '[\x{4e00}-\x{9fff}\x{0600}-\x{06ff}\x{0900}-\x{097f}]|[^\p{L}]', '', 'g'))) AS latin, sum(length(regexp_replace(text, '[^\p{L}]', '', 'g')))::BIGINT AS n_letters FROM l GROUP BY card_id),
s AS (SELECT card_id, n_letters, greatest(latin + cjk + arabic + devanagari, 1) AS total, unnest([{'s': 'latin', 'r': 0, 'n': latin}, {'s': 'cjk', 'r': 1, 'n': cjk}, {'s': 'arabic', 'r': 2, 'n': arabic}, {'s': 'devanagari', 'r': 3, 'n': devanagari}]) AS x FROM sc),
o AS (SELECT card_id, n_letters, total, x.s AS script, x.n AS n, row_number() OVER (PARTITION BY card_id ORDER BY x.n DESC, x.r) AS k FROM s)
SELECT card_id, max(CASE WHEN k = 1 THEN script END) AS primary, coalesce(arg_min(CASE WHEN k > 1 AND n >= 0.15 * total THEN script END, k) , '') AS secondary, any_value(n_letters) AS n_letters FROM o GROUP BY card_id""",
    "page_overlap_pairs": PAGES + " SELECT card_id, a, b, round(iou, 6) AS iou FROM po",
    "page_dedup": PAGES + " SELECT card_id, tok_idx, text, score FROM pk WHERE NOT EXISTS (SELECT 1 FROM po WHERE po.card_id = pk.card_id AND ((po.a = pk.tok_idx AND sb > sa) OR (po.b = pk.tok_idx AND sb <= sa)))",
    "page_reading_order": LINES + HARD + """
SELECT a.card_id, a.line_no AS src, b.line_no AS dst FROM both_lines a JOIN both_lines b ON a.card_id = b.card_id AND a.line_no < b.line_no WHERE least(length(a.text), length(b.text)) / length(a.text)::DOUBLE >= 0.25""",
    "dictionary_hits": """
WITH h AS (SELECT DISTINCT lower(w) AS hint FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark UNION ALL SELECT p_name FROM part) WHERE w <> ''),
d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), l AS (SELECT doc_id, lower(line) AS line FROM d WHERE trim(line, ' ') <> '')
SELECT hint, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM l JOIN h ON contains(line, hint) GROUP BY hint""",
    "table_regions": LINES + HARD + f""",
rg(rank, region, pat) AS (VALUES {", ".join(f"({0 if r in ('SG', 'IN') else i}, '{r}', '{p}')" for i, (r, p) in enumerate(C.POSTAL))}),
f AS (SELECT card_id, line_no, text, region, pat, row_number() OVER (PARTITION BY card_id, line_no ORDER BY rank, region) AS k FROM both_lines JOIN rg ON regexp_matches(text, pat))
SELECT l.card_id, l.line_no, f.region, regexp_extract(f.text, f.pat) AS match FROM both_lines l LEFT JOIN f ON l.card_id = f.card_id AND l.line_no = f.line_no AND k = 1""",
    "descendants": LINES + """,
e AS (SELECT a.card_id, a.line_no AS src, b.line_no AS dst FROM contact_lines a JOIN contact_lines b ON a.card_id = b.card_id AND a.line_no < b.line_no WHERE least(length(a.text), length(b.text)) / length(a.text)::DOUBLE >= 0.25),
h1 AS (SELECT DISTINCT card_id, dst AS row_id FROM e WHERE src = 1), h2 AS (SELECT DISTINCT e.card_id, e.dst AS row_id FROM e JOIN h1 ON e.card_id = h1.card_id AND e.src = h1.row_id)
SELECT * FROM h1 UNION SELECT * FROM h2""",
    "archive_members": """
WITH m AS (SELECT doc_id, doc_id // 200 AS no, doc_id % 2 AS odd, text, row_number() OVER (PARTITION BY doc_id // 200, doc_id % 2 ORDER BY lpad(doc_id::VARCHAR, 12, '0')) - 1 AS i, sum(1 - doc_id % 2) OVER (PARTITION BY doc_id // 200) AS n_even FROM documents WHERE text IS NOT NULL)
SELECT lpad(no::VARCHAR, 8, '0') || '.zip#asset' || CASE WHEN odd = 1 THEN n_even::BIGINT::VARCHAR || '#asset' ELSE '' END || i::VARCHAR AS label, strlen(text)::BIGINT AS n_bytes, sha256(text) AS sha256 FROM m""",
    "recognised_in_sql": "SELECT doc_id::VARCHAR AS label, 'normal' AS pass_name, len(string_split(text, ' ')) AS n_tokens, len(string_split(text, ' ')) - 1 AS last FROM documents WHERE text IS NOT NULL",
    "validated_in_sql": LINES + HARD + f""",
v AS (SELECT *, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / greatest(1, length(text))::DOUBLE AS alpha, length(regexp_replace(text, '[^\\p{{Nd}}]', '', 'g')) AS digits, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS words,
  regexp_matches(text, '\\p{{Lu}}') AND NOT regexp_matches(text, '\\p{{Ll}}') AS up, {_hint(C.ADDRESS_HINTS)} AS ah, {_hint(C.JOB_HINTS)} AS jh, {_hint(C.COMPANY_HINTS)} AS ch, {" OR ".join(f"regexp_matches(text, '{p}')" for _, p in C.POSTAL)} AS postal FROM both_lines)
SELECT card_id, line_no, {_CANON.format("text")} AS key, digits = 0 AND words BETWEEN 1 AND 4 AND NOT ah AND NOT jh AND NOT ch AND alpha >= 0.7 AS name, ch OR (digits = 0 AND ((up AND length(text) <= 32) OR (words BETWEEN 1 AND 4 AND alpha >= 0.55))) AS company, jh AND alpha >= 0.55 AS title,
 regexp_full_match(text, '(?i)[a-z0-9._%+-]{{1,64}}@[a-z0-9.-]+') AND regexp_matches(text, '(?i)@.*[a-z0-9-][.][a-z]{{2}}[a-z0-9-]*$') AS email, digits BETWEEN 7 AND 15 AND NOT postal AS phone, postal OR (alpha >= 0.55 AND digits >= 1) AS address FROM v""",
    "wide_rows": CHOSEN + """,
q AS (SELECT card_id, max(CASE WHEN line_no = 1 THEN text END) AS t, regexp_replace(max(CASE WHEN line_no = 3 THEN text END), 'orgx$', 'org') AS e, '+65 ' || substr(regexp_replace(max(CASE WHEN line_no = 4 THEN text END), '[^0-9]', '', 'g'), 3) AS p, max(CASE WHEN line_no = 5 THEN text END) AS a FROM contact_lines GROUP BY card_id)
SELECT q.card_id, """ + ", ".join(f"coalesce({c}, '—') AS {f}_value, {c} IS NOT NULL AS {f}_validated" for f, c in (("name", "nm.name"), ("company", "co.company"), ("title", "t"), ("email", "e"), ("phone", "p"), ("website", "NULL::VARCHAR"), ("address", "a"))) + ", '100.0%' AS confidence FROM q LEFT JOIN nm ON q.card_id = nm.card_id LEFT JOIN co ON q.card_id = co.card_id",
    "token_audit": TOKENS + f""",
sure AS (SELECT *, lower(text) AS low FROM tokens WHERE score >= 0.45),
g AS (SELECT card_id, count(DISTINCT line_no) AS n_rows, count(DISTINCT CASE WHEN contains(text, '@') THEN line_no END) AS n_mails, round(avg(score), 6) AS confidence, 0::BIGINT AS spaced,
  count(CASE WHEN regexp_full_match(text, '[A-Za-z .''-]+') AND NOT list_contains({_list(AUDIT_JOBS)}, low) AND NOT list_contains({_list(AUDIT_COMPANIES)}, low) AND NOT regexp_matches(low, '{_any(AUDIT_PLACES)}') AND NOT regexp_matches(low, '[.](com|in|org|net|co[.]in)') THEN 1 END) AS n_candidates FROM sure GROUP BY card_id),
split AS (SELECT card_id, count(CASE WHEN score >= 0.45 THEN 1 END) AS kept, count(CASE WHEN score < 0.45 THEN 1 END) AS dropped FROM tokens GROUP BY card_id)
SELECT split.*, n_rows, n_mails, confidence, spaced, n_candidates FROM split LEFT JOIN g ON split.card_id = g.card_id""",
    "layout_roles": LINES + f""",
f AS (SELECT *, {_WORDS.format('text')} AS n, {_DIGITS.format('text')} / length(text)::DOUBLE AS dd, length(regexp_replace(text, '[^,./#@:;-]', '', 'g')) / length(text)::DOUBLE AS pd, {_ALPHA.format('text')} AS ad, {_UPPER.format('text')} AS caps,
  len(list_filter(string_split(text, ' '), lambda x: regexp_matches(x, '^[A-Z]'))) / {_WORDS.format('text')}::DOUBLE >= 0.6 AS title, length(regexp_replace(text, '[^,/|]', '', 'g')) AS seps,
  (line_no - min(line_no) OVER (PARTITION BY card_id)) / (max(line_no) OVER (PARTITION BY card_id) - min(line_no) OVER (PARTITION BY card_id))::DOUBLE AS pos,
  regexp_matches(text, '[A-Za-z0-9._%+-]{{1,64}}@[A-Za-z0-9.-]{{1,253}}[.][A-Za-z]{{2,12}}') AS mail, length(regexp_replace(regexp_extract(text, '[+(]?[0-9][0-9\\s().-]{{5,16}}[0-9]'), '[^0-9]', '', 'g')) BETWEEN 7 AND 15 AS phone, regexp_matches(text, '\\b[0-9]{{4,7}}\\b') AS postal FROM contact_lines),
p AS (SELECT *, 20 + 15 * (1 - pos) + CASE WHEN caps THEN 8 ELSE 0 END + CASE WHEN title THEN 6 ELSE 0 END - CASE WHEN dd > 0 THEN 10 ELSE 0 END + CASE WHEN ad > 0.8 THEN 5 ELSE 0 END + 3 AS prom FROM f),
s AS (SELECT *, CASE WHEN postal THEN 30 ELSE 0 END + CASE WHEN dd > 0.2 THEN 15 ELSE 0 END + CASE WHEN pd > 0.12 THEN 12 ELSE 0 END + CASE WHEN seps >= 2 THEN 10 ELSE 0 END + CASE WHEN pos > 0.6 THEN 8 ELSE 0 END + CASE WHEN n > 4 THEN 5 ELSE 0 END AS address,
  prom - CASE WHEN n NOT BETWEEN 1 AND 5 THEN 15 ELSE 0 END - CASE WHEN pos > 0.5 THEN 12 ELSE 0 END - CASE WHEN dd > 0.05 THEN 20 ELSE 0 END AS name, 0.85 * prom - CASE WHEN n NOT BETWEEN 1 AND 8 THEN 10 ELSE 0 END - CASE WHEN pos > 0.7 THEN 10 ELSE 0 END - CASE WHEN dd > 0 THEN 12 ELSE 0 END AS job,
  0.8 * prom + CASE WHEN caps THEN 10 ELSE 0 END - CASE WHEN n > 8 THEN 8 ELSE 0 END AS company FROM p),
b AS (SELECT *, greatest(address, name, job, company) AS best FROM s)
SELECT card_id, line_no, CASE WHEN mail THEN 'email' WHEN phone THEN 'phone' WHEN best <= 5 THEN 'unknown' WHEN address = best THEN 'address' WHEN name = best THEN 'name' WHEN job = best THEN 'title' ELSE 'company' END AS role, CASE WHEN mail OR phone THEN 100.0 ELSE round(best, 6) END::DOUBLE AS role_score FROM b""",
    "phone_windows": LINES + """,
dg AS (SELECT *, regexp_replace(text, '[^0-9]', '', 'g') AS d, trim(regexp_replace(regexp_replace(text, '[^0-9+()\\\\s./-]', ' ', 'g'), '\\\\s+', ' ', 'g')) AS clean FROM contact_lines WHERE length(regexp_replace(text, '[^0-9]', '', 'g')) >= 7),
m AS (SELECT *, CASE WHEN starts_with(clean, '+') THEN '+' || d ELSE clean END AS norm, length(d) AS n FROM dg),
w AS (SELECT card_id, line_no, substr(d, s::INT, k::INT) AS c FROM m, range(1, 12) a(s), range(7, 16) b(k) WHERE s - 1 + k <= least(n, 15)),
cands AS (SELECT card_id, line_no, c FROM w UNION SELECT card_id, line_no, '+' || c FROM w UNION SELECT card_id, line_no, text FROM m UNION SELECT card_id, line_no, norm FROM m UNION SELECT card_id, line_no, d FROM m WHERE n <= 15 UNION SELECT card_id, line_no, '+' || d FROM m WHERE n <= 15)
SELECT card_id, line_no, count(*) AS n_candidates FROM cands WHERE c <> '' GROUP BY card_id, line_no""",
    "flat_simple": LINES + HARD + f""",
x1 AS (SELECT card_id, line_no, regexp_replace(regexp_replace(text, '\\s+@\\s+', '@', 'g'), '\\s+[.]\\s+', '.', 'g') AS text FROM both_lines),
x2 AS (SELECT card_id, line_no, CASE WHEN regexp_matches(text, '^([A-Z]\\s+){{2,}}[A-Z]$') THEN replace(text, ' ', '') ELSE text END AS text FROM x1),
x AS (SELECT card_id, line_no, regexp_replace(text, '([A-Z]{{2,}})\\s+([A-Z]{{2,}})', '\\1\\2', 'g') AS text FROM x2),
y AS (SELECT *, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS n, regexp_matches(text, '\\p{{Lu}}') AND NOT regexp_matches(text, '\\p{{Ll}}') AS up, NOT regexp_matches(text, '(^|\\P{{L}})\\p{{Ll}}') AND NOT regexp_matches(text, '\\p{{L}}\\p{{Lu}}') AS title FROM x),
np AS (SELECT card_id, line_no, p, unnest(range(0, len(p))) AS i FROM (SELECT card_id, line_no, regexp_extract_all(text, '[+(]?[0-9][0-9\\s().-]{{5,16}}[0-9]') AS p FROM y)),
nq AS (SELECT card_id, line_no, i, regexp_replace(list_extract(p, (i + 1)::INT), '[^0-9]', '', 'g') AS d FROM np WHERE starts_with(trim(list_extract(p, (i + 1)::INT)), '+')),
plan(code, low, high) AS (VALUES {", ".join(f"('{c}', {C.NATIONAL_DIGITS.get(r, (7, 11))[0]}, {C.NATIONAL_DIGITS.get(r, (7, 11))[1]})" for c, r in C.CALLING_CODES.items())}),
nr AS (SELECT card_id, '+' || code || ' ' || substr(d, length(code) + 1) AS phone, row_number() OVER (PARTITION BY card_id ORDER BY line_no, i, length(code) DESC) AS k FROM nq JOIN plan ON starts_with(d, code) AND length(d) - length(code) BETWEEN low AND high),
g AS (SELECT card_id, arg_min(text, line_no) FILTER (WHERE n BETWEEN 2 AND 3 AND (up OR title)) AS name, arg_min(text, line_no) FILTER (WHERE {_hint(DESIGNATIONS)}) AS title, arg_min(text, line_no) FILTER (WHERE {_hint(C.COMPANY_HINTS)} AND NOT contains(text, '@')) AS company,
  arg_min(regexp_extract(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{{2,}}'), line_no) FILTER (WHERE regexp_matches(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{{2,}}')) AS email,
  arg_min(regexp_extract(text, '(https?://)?(www[.])?[a-zA-Z0-9.-]+[.][a-zA-Z]{{2,}}'), line_no) FILTER (WHERE regexp_matches(text, '[a-zA-Z0-9.-]+[.][a-zA-Z]{{2,}}')) AS website,
  arg_min(text, line_no) FILTER (WHERE {_hint(C.ADDRESS_HINTS)} AND regexp_matches(text, '[0-9]') AND NOT contains(text, '@')) AS address FROM y GROUP BY card_id),
z AS (SELECT g.*, phone, NULL::VARCHAR AS linkedin, NULL::VARCHAR AS twitter, (name IS NOT NULL)::INT + (title IS NOT NULL)::INT + (company IS NOT NULL)::INT + (email IS NOT NULL)::INT + (website IS NOT NULL)::INT + (phone IS NOT NULL)::INT + (address IS NOT NULL)::INT AS filled FROM g LEFT JOIN nr ON g.card_id = nr.card_id AND k = 1)
SELECT *, CASE WHEN filled >= 6 THEN 'GREEN' WHEN filled >= 3 THEN 'YELLOW' ELSE 'RED' END AS badge FROM z""",
}


def oracle_sql() -> dict[str, str]:
    return SQL | {"table_plans": SQL["numbering_plan"]}
