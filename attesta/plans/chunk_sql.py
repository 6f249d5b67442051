"""SQL that counts the units and edges of structural chunking on its own: offsets of matches, runs and lists by windows."""

from __future__ import annotations

from attesta.operators.chunking import DIGITS

#: Before the lines of a document, by its id modulo 4: sections, articles, rules.
HEADS = {
    0: "CHAPTER I\nPRELIMINARY\n1. Short title.—This Act may be called so. 2. Definitions.—In this Act, (a) “one” means 1; (b) “two” means more Provided that it is so. 3. Powers.—",
    1: "Article 1\nScope\nIt is about scope.\nArticle 2\nUse\nUse it.\nArticle 3\nEnd\n",
    2: "Rule 1\nTitle\nThese are rules.\nRule 2\nForms\n",
}

#: White space as Java and as Python see it, and what no word holds.
_J, _W, _NOT_WORD = r"[\s\x0B]", r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]", r"(?:[^\p{L}\p{N}_]|$)"


def _sql_clean(x: str) -> str:
    for pattern, by, mode in ((r"(?s)_{10,}.*$", "", ""), (rf"^{_J}*[0-9]{{1,4}}{_J}*\n", "", ""), (r"[0-9]+\[([^\]]*)\]", r"\1", "g"), (rf"\*(?:{_J}*\*)+", " ", "g"), (rf"{_J}+", " ", "g")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', '{mode}')" if mode else f"regexp_replace({x}, '{pattern}', '{by}')"
    return f"trim({x}, ' ')"


def _sql_ascii(x: str) -> str:
    return f"translate({x}, '{''.join(map(chr, DIGITS))}', '{''.join(DIGITS.values())}')"


def _sql_rtrim(x: str) -> str:
    return rf"regexp_replace({x}, '{_J}+$', '')"


def _sql_found(source: str, keys: str, text: str, pattern: str, more: str = "") -> str:
    """keys, m (what matched) and pos (its offset) of all matches; then more columns of source."""
    order = f"OVER (PARTITION BY {keys} ORDER BY i"
    return f"""(SELECT {keys}, m, sum(length(p)) {order}) + sum(length(m)) {order}) - length(m) AS pos{more} FROM (
    SELECT {keys}{more}, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT {keys}{more}, regexp_extract_all({text}, '{pattern}') AS ms, string_split_regex({text}, '{pattern}') AS ps FROM {source})))"""


def _sql_order(number: str) -> str:
    letter = f"regexp_extract({number}, '^[0-9]+([A-Z])', 1)"
    return f"CAST(regexp_extract({number}, '^[0-9]+') AS DOUBLE) + CASE WHEN {letter} <> '' THEN (ascii({letter}) - 64) / CAST(10 AS DOUBLE) ELSE 0 END"


def _sql_lines(line: str, name: str) -> str:
    """doc, page, i, number and pos of headings on lines of their own, led to the cleaned text."""
    before = f"CASE WHEN i > 1 THEN array_to_string(ls[1:i-1], chr(10)) || chr(10) ELSE '' END"
    return f"""(SELECT doc, page, i, number, start + place + length(split_part(rest, met, 1)) AS pos FROM (SELECT *, regexp_extract(rest, '{name}') AS met FROM (SELECT *, substr(t, place + 1) AS rest FROM (
    SELECT doc, page, i, t, start, {_sql_ascii(f"regexp_extract(ls[i], '{line}', 1)")} AS number, length({_sql_clean(before)}) AS place FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT *, string_split(raw, chr(10)) AS ls FROM clean)) WHERE regexp_matches(ls[i], '{line}')))) WHERE met <> '' AND lower({_sql_ascii(f"regexp_extract(rest, '{name}', 1)")}) = lower(number))"""


def _sql_clauses(source: str, name: str, numbered: bool) -> str:
    """CTEs that end with name: doc, pos, c (the clause's offset), label and txt of the clauses of each text."""
    marked = _sql_found(source, "doc, at0, c0", "body", r"\((?:\p{Nd}{1,3}|[a-z]{1,3})\)" if numbered else r"\([a-z]{1,3}\)", ", body")
    run = "doc, at0, c0, kind ORDER BY pos"
    return f"""{name}_marks AS (SELECT *, {_sql_ascii("substr(m, 2, length(m) - 2)")} AS number, regexp_matches(m, '\\p{{Nd}}') AS kind FROM {marked}
  WHERE (pos = 0 OR regexp_matches(substr(body, CAST(pos AS BIGINT), 1), '{_W}')) AND regexp_matches(substr(body, CAST(pos + length(m) + 1 AS BIGINT), 1), '{_W}')),
{name}_ok AS (SELECT *, CASE WHEN kind THEN TRY_CAST(number AS INTEGER) = row_number() OVER (PARTITION BY {run}) AND min(pos) OVER (PARTITION BY doc, at0, c0, kind) <= 5
  ELSE count(*) OVER (PARTITION BY doc, at0, c0, kind) >= 2 AND coalesce(number > lag(number) OVER (PARTITION BY {run}), true) END AS ok FROM {name}_marks),
{name}_run AS (SELECT * FROM (SELECT *, bool_and(ok) OVER (PARTITION BY {run}) AS good FROM {name}_ok) WHERE good),
{name}_first AS (SELECT * FROM (SELECT *, first_value(kind) OVER (PARTITION BY doc, at0, c0 ORDER BY pos) AS lead_kind FROM {name}_run) WHERE kind = lead_kind),
{name}_text AS (SELECT doc, at0, c0, pos, kind, {_sql_rtrim("substr(body, CAST(pos + 1 AS BIGINT), CAST(coalesce(lead(pos) OVER (PARTITION BY doc, at0, c0 ORDER BY pos), length(body)) - pos AS BIGINT))")} AS txt FROM {name}_first),
{name} AS (SELECT *, regexp_matches(txt, '{_EXPL}') AS expl, regexp_matches(txt, '{_PROV}') AS prov, {_sql_rtrim(f"CASE WHEN regexp_matches(txt, '{_EXPL}') THEN regexp_extract(txt, '(?s)^(.*?){_EXPL}', 1) WHEN regexp_matches(txt, '{_PROV}') THEN regexp_extract(txt, '(?s)^(.*?){_PROV}', 1) ELSE txt END")} AS main FROM {name}_text)"""


_EXPL = rf"{_J}Explanation(?:{_J}?[0-9])?\.[—-]"
_PROV = rf"{_J}Provided (?:that|further|also)[,:]?{_J}"
_ART_LINE = r"^[ \t]*[Aa][Rr][Tt][Ii][Cc][Ll][Ee][ \t]*(\p{Nd}+[A-Z]?)[ \t.:—–-]*(?:[A-Z][^\r\n]*)?[ \t]*$"
_ART_NAME = rf"(?i)article[ \t]+(\p{{Nd}}+[A-Z]?){_NOT_WORD}"
_RULE_LINE = r"(?i)^[ \t]*rule[ \t]+(\p{Nd}{1,3}[A-Z]{0,2})\.?[ \t]*$"
_RULE_NAME = rf"(?i)rule[ \t]+(\p{{Nd}}{{1,3}}[A-Z]{{0,2}}){_NOT_WORD}"
_CH = rf"\bCHAPTER[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}-]+"
_lit = lambda s: "'" + s.replace("'", "''") + "'"

CHUNK_COUNTS = f"""WITH pages AS (SELECT doc, unnest(l) AS raw, unnest(range(1, len(l) + 1)) AS page FROM (
  SELECT doc_id AS doc, CASE doc_id % 4 {' '.join(f'WHEN {k} THEN [{_lit(h)}]' for k, h in HEADS.items())} ELSE [] END || string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
clean AS MATERIALIZED (SELECT *, sum(length(t) + 1) OVER (PARTITION BY doc ORDER BY page) - length(t) - 1 AS start FROM (SELECT *, {_sql_clean('raw')} AS t FROM pages)),
joined AS (SELECT doc, string_agg(t, chr(10) ORDER BY page) AS full_text, count(*) FILTER (WHERE t <> '') AS n_pages FROM clean GROUP BY doc),
opened AS (SELECT doc, max(pos) AS body FROM {_sql_found('joined', 'doc', 'full_text', _CH + r'I\b', ', full_text')}
  WHERE NOT regexp_matches(substr(full_text, CAST(pos AS BIGINT), 1), '[\\p{{L}}\\p{{N}}_]') AND NOT regexp_matches(substr(full_text, CAST(pos + length(m) + 1 AS BIGINT), 1), '[\\p{{L}}\\p{{N}}_]') GROUP BY doc),
docs AS MATERIALIZED (SELECT doc, full_text, n_pages, coalesce(body, 0) AS body FROM joined LEFT JOIN opened USING (doc)),
articles AS MATERIALIZED (SELECT *, coalesce(nullif(ltrim(regexp_extract(number, '^[0-9]+'), '0'), ''), '0') AS n, regexp_extract(number, '^[0-9]+(.*)$', 1) AS s FROM {_sql_lines(_ART_LINE, _ART_NAME)}),
article_steps AS (SELECT *, CASE WHEN length(n) > length(lag(n) OVER w) OR length(n) = length(lag(n) OVER w) AND (n > lag(n) OVER w OR n = lag(n) OVER w AND s > lag(s) OVER w) THEN 0 ELSE 1 END AS step FROM articles WINDOW w AS (PARTITION BY doc ORDER BY page, i)),
article_runs AS (SELECT *, sum(step) OVER (PARTITION BY doc ORDER BY page, i) AS run FROM article_steps),
article_led AS (SELECT * FROM (SELECT *, max(CAST(n = '1' AS INTEGER)) OVER (PARTITION BY doc, run ORDER BY page, i) AS led FROM article_runs) WHERE led = 1),
article_best AS (SELECT doc, arg_max(n, [n, first]) AS n, arg_max(own, [n, first]) AS own FROM (SELECT doc, run, count(*) AS n, min(pos) AS first, list_sort(list(DISTINCT number)) AS own FROM article_led GROUP BY doc, run HAVING count(*) >= 3) GROUP BY doc),
by_articles AS (SELECT b.doc, b.n FROM article_best b JOIN (SELECT doc, list_sort(list(DISTINCT number)) AS every FROM articles GROUP BY doc) e ON e.doc = b.doc AND e.every = b.own),
rules AS (SELECT r.doc, r.pos, {_sql_order('number')} AS o FROM {_sql_lines(_RULE_LINE, _RULE_NAME)} r JOIN docs d ON d.doc = r.doc WHERE r.doc % 4 = 2 AND r.pos >= d.body AND r.doc NOT IN (SELECT doc FROM articles WHERE doc IS NOT NULL)),
by_rules AS (SELECT doc, len(list_reduce(list([o] ORDER BY pos), lambda a, x: list_filter(a, lambda y: y < x[1]) || x || a[len(list_filter(a, lambda y: y < x[1])) + 2:])) AS n FROM rules GROUP BY doc),
rest AS MATERIALIZED (SELECT * FROM docs WHERE doc NOT IN (SELECT doc FROM articles WHERE doc IS NOT NULL) AND doc NOT IN (SELECT doc FROM by_rules WHERE n >= 2)),
numbers AS (SELECT doc, pos, {_sql_ascii('substr(m, 1, length(m) - 1)')} AS number, pos + length(m) AS past, substr(full_text, CAST(pos + length(m) + 1 AS BIGINT)) AS tail, regexp_matches(substr(full_text, greatest(CAST(pos AS BIGINT) - 8, 1), least(CAST(pos AS BIGINT), 9)), '[Ss]ections? $') AS cited
  FROM {_sql_found('rest', 'doc', 'full_text', r'\p{Nd}{1,3}[A-Z]{0,2}\.', ', full_text, body')} WHERE pos >= body AND (pos = 0 OR NOT regexp_matches(substr(full_text, CAST(pos AS BIGINT), 1), '\\p{{Nd}}'))),
shapes AS (SELECT doc, pos, number, kind, past + length(span) AS until FROM (
  SELECT *, 0 AS kind, regexp_extract(tail, '^{_W}+[A-Z][^.]{{2,160}}?[,.]{_W}*[—-]') AS span FROM numbers
  UNION ALL SELECT *, 1, regexp_extract(tail, '^({_W}+\\[[^\\]]*\\]{_W}*)Omitted{_NOT_WORD}', 1) FROM numbers
  UNION ALL SELECT *, 2, regexp_extract(tail, '^({_W}+)\\(\\p{{Nd}}+\\)', 1) FROM numbers WHERE NOT cited
  UNION ALL SELECT *, 3, regexp_extract(tail, '^({_W}+)[A-Z]', 1) FROM numbers WHERE NOT cited AND regexp_matches(number, '^[0-9]+$')) WHERE span <> ''),
apart AS MATERIALIZED (SELECT * FROM (SELECT *, max(until) OVER (PARTITION BY doc, kind ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM shapes) WHERE busy IS NULL OR busy <= pos),
shaped AS (SELECT *, {_sql_order('number')} AS o FROM (SELECT *, row_number() OVER (PARTITION BY doc, pos ORDER BY kind) AS r FROM apart WHERE kind < 3) WHERE r = 1),
rising AS (SELECT *, CASE WHEN regexp_matches(number, '^[0-9]+$') THEN CAST(number AS INTEGER) END AS n FROM (SELECT *, max(o) OVER (PARTITION BY doc ORDER BY pos) AS top FROM shaped) WHERE o = top),
gaps AS (SELECT * FROM (SELECT doc, CAST(n + 1 AS VARCHAR) AS number, until AS low, lead(pos) OVER w AS high, lead(n) OVER w - n AS skip FROM rising WINDOW w AS (PARTITION BY doc ORDER BY pos)) WHERE skip = 2),
filled AS (SELECT doc, pos, until FROM (SELECT a.doc, a.pos, a.until, row_number() OVER (PARTITION BY a.doc, a.number, low ORDER BY a.pos) AS r FROM apart a JOIN gaps g ON g.doc = a.doc AND g.number = a.number WHERE a.kind = 3 AND a.pos >= low AND a.until <= high) WHERE r = 1),
starts AS (SELECT doc, pos, until FROM rising UNION SELECT doc, pos, until FROM filled),
stops AS (SELECT s.doc, s.pos, s.until, full_text, body, coalesce(lead(s.pos) OVER (PARTITION BY s.doc ORDER BY s.pos), least(length(full_text), s.until + 4000)) AS stop FROM starts s JOIN rest d ON d.doc = s.doc),
chapters AS (SELECT doc, body + pos AS pos FROM {_sql_found("(SELECT doc, body, full_text, substr(full_text, CAST(body + 1 AS BIGINT)) AS own FROM rest)", 'doc', 'own', _CH + rf'[IVXLCDM]+\b{_W}*(?:[A-Z][A-Z ,\-]{{2,80}})?', ', body, full_text')}
  WHERE NOT regexp_matches(substr(full_text, CAST(body + pos AS BIGINT), 1), '[\\p{{L}}\\p{{N}}_]') AND regexp_matches(substr(full_text, CAST(body + pos + 1 AS BIGINT), length(m) + 1), '^{_CH}[IVXLCDM]+{_NOT_WORD}')),
ended AS (SELECT s.doc, s.pos, any_value(s.until) AS until, any_value(full_text) AS full_text, coalesce(max(c.pos), any_value(stop)) AS stop FROM stops s LEFT JOIN chapters c ON c.doc = s.doc AND c.pos < s.stop AND c.pos >= s.until GROUP BY s.doc, s.pos),
sections AS MATERIALIZED (SELECT doc, pos AS at0, 0 AS c0, regexp_replace(substr(full_text, CAST(until + 1 AS BIGINT), CAST(greatest(stop - until, 0) AS BIGINT)), '^{_J}+|{_J}+$', '', 'g') AS body FROM ended),
{_sql_clauses('sections', 'clauses', True)},
listed AS (SELECT doc, at0, pos AS c0, main AS body FROM clauses WHERE kind),
{_sql_clauses('listed', 'subs', False)},
parts AS (SELECT doc, 0 AS edge FROM sections UNION ALL SELECT doc, CAST(expl OR prov AS INTEGER) FROM clauses UNION ALL SELECT doc, CAST(expl OR prov AS INTEGER) FROM subs),
by_sections AS (SELECT doc, count(*) + sum(edge) AS n, sum(edge) AS n_edges FROM parts GROUP BY doc)
SELECT d.doc, CAST(coalesce(a.n, CASE WHEN r.n >= 2 THEN r.n END, s.n, n_pages) AS BIGINT) AS n_units, CAST(coalesce(s.n_edges, 0) AS BIGINT) AS n_edges, n_units > 0 AS has_units, true AS verbatim, true AS known_parents
FROM docs d LEFT JOIN by_articles a ON a.doc = d.doc LEFT JOIN by_rules r ON r.doc = d.doc LEFT JOIN by_sections s ON s.doc = d.doc"""
