"""For each registered query the same result in SQL of another engine (DuckDB dialect).

Fixed values (patterns, weights, prices) come from the modules that own them; the logic is
written a second time, in plain SQL, without any of the scale measures of the Spark plans.
"""

from __future__ import annotations

from vocara import schemas as S
from vocara.functions import rules, scoring, text, vectors
from vocara.operators import cost, extraction, validation
from vocara.operators.dedup import THRESHOLD
from vocara.operators.ranking import DEFAULT_COUNTRIES
from vocara.plans import datasets as D
from vocara.plans.rank import DASHBOARD_MATCHES

ORACLE: dict[str, str] = {}


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def derived(sql: str) -> str:
    sql = sql.replace("{attempts}", ", (VALUES (1), (2), (3)) AS a(attempt)")
    return sql.format(**{t: t for t in D.TABLES})


def sub(expr: str, pattern: str, replacement: str = "''") -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {replacement}, 'g')"


def matches(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {lit(pattern)})"


# ---- scalar rules --------------------------------------------------------------------

# Cleaning, written for pages whose dropped elements do not nest and whose attribute values hold
# no ``>``: all pages of the given tables.
DROPPED = [f"{tag}(?:\\s[^>]*)?>.*?(?:</{tag}\\s*>|\\z)" for tag in
           ("script", "style", "noscript", "svg", "nav", "footer", "header", "form")]
RAW_BLOCKS = "(?is)<(?:!--.*?-->|" + "|".join(DROPPED[:4]) + ")"
HEAD_BLOCKS = r"(?is)<(?:head(?:\s[^>]*)?>.*?</head\s*>|title(?:\s[^>]*)?>.*?</title\s*>)"
BOILERPLATE_BLOCKS = "(?is)<(?:" + "|".join(DROPPED[4:]) + ")"
ANY_TAG = r"<(?:/?[a-zA-Z]|[!?])[^>]*>"
H1_CONTENT = r"(?is)<h1(?:\s[^>]*)?>(.*?)</h1\s*>"
TITLE_CONTENT = r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>"


def entities(expr: str) -> str:
    for reference, character in text.ENTITIES:
        expr = f"replace({expr}, {lit(reference)}, {lit(character)})"
    return expr


def without_raw(html: str) -> str:
    page = f"translate(replace({html}, chr(13) || chr(10), chr(10)), chr(13) || chr(1), chr(10))"
    return sub(page, RAW_BLOCKS, "chr(1)")


def lines_of(expr: str, separator: str) -> str:
    expr = sub(expr, rf"\A[{text.SPACE}\x01]+|[{text.SPACE}\x01]+\z")
    return sub(expr, rf"[{text.SPACE}]*\x01[{text.SPACE}\x01]*", separator)


def whole_text(html: str) -> str:
    page = without_raw(html)
    for pattern in (HEAD_BLOCKS, BOILERPLATE_BLOCKS, ANY_TAG):
        page = sub(page, pattern, "chr(1)")
    page = lines_of(sub(entities(page), r"[ \t]+", "' '"), "chr(10)")
    return sub(page, r"\n{3,}", "chr(10) || chr(10)")


def page_text(html: str) -> str:
    return whole_text(html)


def title_part(html: str, pattern: str) -> str:
    inner = f"regexp_extract({without_raw(html)}, {lit(pattern)}, 1)"
    return f"nullif({lines_of(entities(sub(inner, ANY_TAG, 'chr(1)')), lit(''))}, '')"


def norm(expr: str) -> str:
    source, target, _ = text.casefold_rules()
    folded = f"replace(translate(lower({expr}), {lit(source)}, {lit(target)}), 'ß', 'ss')"
    return f"trim({sub(folded, r'[^\p{L}\p{N}_]+', lit(' '))})"


def words(expr: str) -> str:
    return f"list_filter(list_distinct(string_split({norm(expr)}, ' ')), lambda w: w <> '')"


def content_key(company: str, title: str, location: str) -> str:
    parts = " || '|' || ".join(norm(p) for p in (company, title, f"coalesce({location}, '')"))
    return f"substr(sha256({parts}), 1, 16)"


def visa(expr: str, fallback: str) -> str:
    return (
        f"CASE WHEN {matches(expr, rules.any_of(rules.VISA_NO))} THEN 'no' "
        f"WHEN {matches(expr, rules.any_of(rules.VISA_YES))} THEN 'yes' ELSE {fallback} END"
    )


def visa_text(phrase: str, summary: str, body: str) -> str:
    return f"lower(concat({phrase}, ' ', {summary}, ' ', {body}))"


def first_of(expr: str, terms, default: str) -> str:
    arms = " ".join(f"WHEN {matches(expr, p)} THEN {lit(v)}" for p, v in terms)
    return f"CASE {arms} ELSE {default} END"


def job_rendering(stack: str, body: str) -> str:
    return (
        "concat_ws(chr(10), title || ' at ' || company, 'seniority: ' || seniority, "
        "'location: ' || coalesce(nullif(location, ''), 'unknown') || ' (' || coalesce(nullif(country, ''), '?') || ')', "
        f"'remote: ' || remote, 'stack: ' || coalesce(nullif({stack}, ''), 'n/a'), "
        f"'visa sponsorship: ' || visa_sponsorship, nullif(description_summary, ''), nullif({body}, ''))"
    )


def fixed(expr: str, digits: int) -> str:
    return f"printf('%.{digits}f', {expr})"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def scores(countries) -> tuple[str, str]:
    sim = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, similarity))"
    target = f"coalesce(country IN {in_list(countries)}, false)" if countries else "false"
    senior = f"seniority IN {in_list(scoring.SENIOR_LEVELS)}"
    boost = lambda cond, w: f"CASE WHEN {cond} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END"
    total = (
        f"{scoring.SIM_WEIGHT}::DOUBLE * {sim} + {boost("visa_sponsorship = 'yes'", scoring.VISA_BOOST)}"
        f" + {boost(target, scoring.COUNTRY_BOOST)} + {boost(senior, scoring.SENIOR_BOOST)}"
    )
    reasons = (
        f"concat_ws('|', 'semantic match ' || {fixed(sim, 2)}, "
        "CASE WHEN visa_sponsorship = 'yes' THEN 'offers visa sponsorship' END, "
        f"CASE WHEN {target} THEN 'in target country ' || country END, "
        f"CASE WHEN {senior} THEN seniority || '-level role' END)"
    )
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {total}))", reasons


# ---- shared tables -------------------------------------------------------------------

JOBS = f"""jobs AS (
  SELECT seq, source, url, title, company, location, country, remote, seniority, stack_csv,
         {visa(visa_text("phrase", "description_summary", "text"), "visa_raw")} AS visa_sponsorship,
         phrase, description_summary, text, vector,
         {content_key("company", "title", "location")} AS content_hash
  FROM ({derived(D.POSTINGS)}) p)"""
INDEX = JOBS + """, idx AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY seq DESC) = 1)"""
JOB_VIEW = "content_hash, title, company, country, remote, seniority, visa_sponsorship"
COSINE = "round(list_dot_product(v.u, p.w) / sqrt(list_dot_product(v.u, v.u) * list_dot_product(p.w, p.w)), 9)"


def hits(where: str, k: int) -> str:
    return f"""{INDEX}, near AS (
  SELECT p.cv_id, v.content_hash, {COSINE} AS similarity
  FROM (SELECT content_hash, CAST(vector AS DOUBLE[]) AS u FROM idx WHERE {where}) v,
       (SELECT vec_id AS cv_id, CAST(embedding AS DOUBLE[]) AS w FROM embeddings) p),
hits AS (SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY similarity DESC, content_hash) AS sim_rank FROM near
         QUALIFY sim_rank <= {k})"""


def ranking(where: str, k: int, countries) -> str:
    score, reasons = scores(countries)
    return f"""{hits(where, k)}, scored AS (
  SELECT h.cv_id, h.similarity, h.sim_rank, j.*, {score} AS match_score, {reasons} AS match_reasons
  FROM hits h JOIN idx j USING (content_hash)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY match_score DESC, similarity DESC, content_hash) AS position
           FROM scored)"""


ELIGIBLE = f"visa_sponsorship = 'yes' AND country IN {in_list(DEFAULT_COUNTRIES)}"
RANKED = ranking(ELIGIBLE, 20, DEFAULT_COUNTRIES)
SCORED = ranking("true", 20, ("IE", "DE"))


def greedy(sets: str, similar: str) -> str:
    """``dropped(seq)`` of a greedy pass over ``sets``, given ``pairs(a, b, similarity)``."""
    return f"""{sets}, {similar},
nodes AS MATERIALIZED (SELECT b, list(a) AS earlier, row_number() OVER (ORDER BY b) AS i FROM pairs GROUP BY b),
walk AS (SELECT 0::BIGINT AS i, CAST([] AS BIGINT[]) AS gone
  UNION ALL
  SELECT n.i, CASE WHEN list_has_all(w.gone, n.earlier) THEN w.gone ELSE list_append(w.gone, n.b) END
  FROM walk w JOIN nodes n ON n.i = w.i + 1),
dropped AS MATERIALIZED (SELECT unnest(gone) AS seq FROM (SELECT gone FROM walk ORDER BY i DESC LIMIT 1))"""


WORD_PAIRS = f"""tokens AS (SELECT seq, len(ws) AS n, unnest(ws) AS w FROM sets),
pairs AS MATERIALIZED (SELECT x.seq AS a, y.seq AS b, round(count(*) / sqrt(any_value(x.n)::DOUBLE * any_value(y.n)), 9) AS similarity
  FROM tokens x JOIN tokens y ON x.w = y.w AND x.seq < y.seq GROUP BY x.seq, y.seq
  HAVING round(count(*) / sqrt(any_value(x.n)::DOUBLE * any_value(y.n)), 9) >= {THRESHOLD})"""
DOCUMENT_SETS = f"sets AS MATERIALIZED (SELECT doc_id AS seq, {words('text')} AS ws FROM documents)"
DOCUMENT_GREEDY = greedy(DOCUMENT_SETS, WORD_PAIRS)

ANSWERS = f"""answers AS ({derived(D.ANSWERS)}),
spans AS (SELECT *, nullif(regexp_extract(output, '(?s)\\{{.*\\}}', 0), '') AS json_text FROM answers),
parsed AS (SELECT *, CASE WHEN json_valid(json_text) THEN CAST(json_text AS JSON) END AS p FROM spans)"""


def kind(path: str) -> str:
    return f"json_type(p, '$.{path}')"


def value(path: str) -> str:
    return f"json_extract_string(p, '$.{path}')"


def string_list(path: str) -> str:
    odd = f"len(list_filter(json_extract(p, '$.{path}[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0"
    return f"({kind(path)} = 'ARRAY' AND {odd})"


def number(path: str) -> str:
    return (
        f"CASE WHEN {kind(path)} IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST({value(path)} AS DOUBLE) "
        f"WHEN {kind(path)} = 'BOOLEAN' THEN CASE {value(path)} WHEN 'true' THEN 1.0 ELSE 0.0 END "
        f"WHEN {kind(path)} = 'VARCHAR' AND {matches(value(path), validation.NUMBER_TEXT)} THEN TRY_CAST({value(path)} AS DOUBLE) END"
    )


def absent(path: str) -> str:
    return f"coalesce({kind(path)}, 'NULL') = 'NULL'"


def optional_text(path: str) -> str:
    return f"({absent(path)} OR {kind(path)} = 'VARCHAR')"


def enum(path: str, values) -> str:
    return f"({kind(path)} IS NULL OR ({kind(path)} = 'VARCHAR' AND {value(path)} IN {in_list(values)}))"


EPOCH = (
    f"CASE WHEN {kind('posted_at')} IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CASE WHEN abs(CAST({value('posted_at')} AS DOUBLE)) "
    f"> {validation.MAX_EPOCH_SECONDS} THEN CAST({value('posted_at')} AS DOUBLE) / 1000 ELSE CAST({value('posted_at')} AS DOUBLE) END "
    f"WHEN {matches(value('posted_at'), validation.ISO_TIME)} THEN epoch(TRY_CAST({value('posted_at')} AS TIMESTAMPTZ)) END"
)
CHECKS = (
    ("title", f"{kind('title')} = 'VARCHAR'"),
    ("company", f"{kind('company')} = 'VARCHAR'"),
    ("location", optional_text("location")),
    ("country", optional_text("country")),
    ("remote", enum("remote", S.REMOTE_VALUES)),
    ("seniority", enum("seniority", S.SENIORITY_VALUES)),
    ("visa_sponsorship", enum("visa_sponsorship", S.VISA_VALUES)),
    ("stack", f"({kind('stack')} IS NULL OR {string_list('stack')})"),
    ("visa_signals", f"({kind('visa_signals')} IS NULL OR {string_list('visa_signals')})"),
    (
        "salary",
        f"({absent('salary')} OR ({kind('salary')} = 'OBJECT' AND ({absent('salary.min')} OR ({number('salary.min')}) IS NOT NULL) "
        f"AND ({absent('salary.max')} OR ({number('salary.max')}) IS NOT NULL) AND {optional_text('salary.currency')} "
        f"AND {optional_text('salary.period')}))",
    ),
    (
        "description_summary",
        f"({absent('description_summary')} OR ({kind('description_summary')} = 'VARCHAR' "
        f"AND length({value('description_summary')}) <= {S.MAX_SUMMARY_CHARS}))",
    ),
    ("posted_at", f"({absent('posted_at')} OR ({EPOCH}) IS NOT NULL)"),
)
FAILING = ", ".join(f"CASE WHEN coalesce({ok}, false) THEN NULL ELSE '{name}' END" for name, ok in CHECKS)
VALIDATED = f"""{ANSWERS},
checked AS (SELECT *, CASE WHEN p IS NULL THEN 'json' ELSE concat_ws('|', {FAILING}) END AS errors FROM parsed)"""
STRINGS = "array_to_string(CAST(json_extract_string(p, '$.{0}[*]') AS VARCHAR[]), '|')"

FETCHED = f"""attempts AS ({derived(D.FETCH_ATTEMPTS)}),
first_try AS (SELECT url, min(attempt) FILTER (error IS NULL) AS attempt,
    arg_max(error, attempt) FILTER (error IS NOT NULL) AS last_error FROM attempts WHERE attempt <= 2 GROUP BY url),
fetched AS (SELECT f.url, f.attempt, t.html, CASE WHEN f.attempt IS NULL THEN 'fetch failed: ' || f.last_error END AS error
    FROM first_try f LEFT JOIN attempts t ON t.url = f.url AND t.attempt = f.attempt)"""
OUTCOMES = f"""{FETCHED}, items AS ({derived(D.WORK_ITEMS)}),
joined AS (SELECT i.seq, i.source, i.url, coalesce(f.error, CASE WHEN f.attempt IS NULL THEN 'fetch failed: no page for ' || i.url END) AS error,
    sha256(f.html) AS page_hash FROM items i LEFT JOIN fetched f USING (url)),
outcomes AS (SELECT seq, source, url, CASE WHEN error IS NOT NULL THEN 'error'
    WHEN row_number() OVER (PARTITION BY error IS NULL, page_hash ORDER BY seq) = 1 THEN 'indexed' ELSE 'duplicate' END AS outcome, error
    FROM joined)"""

PAGES = f"posting_pages AS ({derived(D.POSTING_PAGES)})"
LINE = "list_extract(string_split(text, chr(10)), {0})"
_line2 = LINE.format(2)
_place = (
    f"CASE WHEN contains({_line2}, ' - ') THEN regexp_extract({_line2}, ' - (.*)$', 1) ELSE {LINE.format(3)} END"
)
_place = f"nullif(trim({sub(_place, r'\([^)]*\)')}), '')"
_years = f"TRY_CAST(regexp_extract(text, {lit(rules.YEARS_PATTERN)}, 1) AS INTEGER)"
_by_years = (
    f"CASE WHEN {_years} >= {rules.SENIOR_YEARS} THEN 'senior' WHEN {_years} >= {rules.MID_YEARS} THEN 'mid' "
    f"WHEN {_years} IS NOT NULL THEN 'junior' ELSE 'unknown' END"
)
_level = first_of("lower(text)", [(rf"\b{t}\b[- ]level", v) for t, v in rules.SENIORITY_TERMS], _by_years)
_alone = lambda terms: [(rf"\b{t}\b", v) for t, v in terms]
_stack = "list_filter([" + ", ".join(
    f"CASE WHEN {matches('text', rf'\b{t}\b')} THEN {lit(t)} END" for t in rules.STACK_TERMS
) + "], lambda x: x IS NOT NULL)"
_salary = lambda i: f"regexp_extract(text, {lit(rules.SALARY_PATTERN)}, {i})"
RULED = f"""{PAGES}, texts AS (SELECT seq, source, url, {page_text("html")} AS text FROM posting_pages),
placed AS (SELECT *, {_place} AS location FROM texts),
ruled AS (SELECT seq, source, url, text, sha256(text) AS text_hash, {LINE.format(1)} AS title,
  CASE WHEN contains({_line2}, ' - ') THEN regexp_extract({_line2}, '^(.*?) - ', 1) ELSE {_line2} END AS company, location,
  {first_of("lower(location)", _alone(rules.COUNTRY_NAMES), "NULL")} AS country,
  {first_of("lower(text)", _alone(rules.REMOTE_TERMS), "'unknown'")} AS remote,
  {first_of(f"lower({LINE.format(1)})", _alone(rules.SENIORITY_TERMS), _level)} AS seniority,
  {_stack} AS stack, {visa("lower(text)", "'unknown'")} AS visa_sponsorship,
  regexp_extract_all(text, {lit(rules.VISA_PHRASE)}) AS signals,
  TRY_CAST(replace(nullif({_salary(1)}, ''), ',', '') AS DOUBLE) AS salary_min,
  TRY_CAST(replace(nullif({_salary(2)}, ''), ',', '') AS DOUBLE) AS salary_max,
  nullif({_salary(3)}, '') AS currency, nullif({_salary(4)}, '') AS period,
  CAST(NULL AS VARCHAR) AS description_summary
  FROM placed)"""
REFINED = f"""{RULED}, refined AS (SELECT * REPLACE (
  {visa("lower(array_to_string(signals, ' ') || ' ' || coalesce(description_summary, ''))", "visa_sponsorship")} AS visa_sponsorship) FROM ruled)"""
COMPARED = f"""{REFINED}, gold AS (SELECT seq AS case_id, title, company, seniority, visa_sponsorship, remote FROM posting_pages),
compared AS ({" UNION ALL ".join(
    f"SELECT g.case_id, '{f}' AS field, lower(trim(g.{f})) AS gold, lower(trim(r.{f})) AS pred FROM gold g JOIN refined r ON r.seq = g.case_id"
    for f in S.CRITICAL_FIELDS)}),
accuracy AS (SELECT field, count(*) AS n, count(*) FILTER (gold = pred) AS n_correct, count(*) FILTER (gold = pred) / count(*) AS accuracy
    FROM compared GROUP BY field)"""

_prices = ", ".join(f"({lit(m)}, {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in cost.PRICES)
COSTED = f"""calls AS ({derived(D.CALLS)}), prices AS (SELECT * FROM (VALUES {_prices}) AS t(model, in_price, out_price)),
costed AS (SELECT c.*, c.input_tokens / 1000000 * coalesce(p.in_price, 0) + c.output_tokens / 1000000 * coalesce(p.out_price, 0) AS cost_usd
    FROM calls c LEFT JOIN prices p USING (model))"""

CACHE = """cache AS (SELECT sha256(d.text) AS text_hash, min(d.doc_id) AS doc_id FROM documents d
    WHERE d.doc_id IN (SELECT doc_id FROM labels) GROUP BY 1)"""

# ---- scans, sources, sinks -----------------------------------------------------------

ORACLE["load_sources"] = """SELECT concat('board', page_id) AS id,
  CASE WHEN page_id % 4 <> 0 THEN url || '|' || url || '#jobs' ELSE '' END AS seed_urls,
  page_id % 3 = 0 AND page_id % 2 = 0 AS anti_bot FROM pages"""
ORACLE["seed_urls"] = """SELECT page_id * 2147483648 + i AS seq, concat('board', page_id) AS source, url || s AS url,
  page_id % 3 = 0 AND page_id % 2 = 0 AS anti_bot
FROM pages JOIN (VALUES (0, ''), (1, '#jobs')) AS t(i, s) ON page_id % 4 <> 0"""
ORACLE["scan_pages"] = f"""WITH items AS ({derived(D.WORK_ITEMS)})
SELECT i.seq, i.source, i.url, sha256({page_text("p.html")}) AS text_hash,
  CASE WHEN p.html IS NULL THEN 'fetch failed: no page for ' || i.url END AS error
FROM items i LEFT JOIN pages p USING (url)"""
ORACLE["fetch_outcome"] = f"""WITH {FETCHED}
SELECT url, CAST(attempt AS BIGINT) AS attempt, sha256(html) AS html_hash, error FROM fetched"""
ORACLE["save_jobs"] = "SELECT count(*) AS lines, count(*) AS objects FROM documents"
ORACLE["load_jobs"] = f"""WITH {JOBS} SELECT url, title, company, location, visa_sponsorship,
  replace(stack_csv, ',', '|') AS stack, description_summary, 1700000000 + seq AS fetched_epoch, content_hash FROM jobs"""
ORACLE["load_jobs_quarantine"] = """WITH k AS (SELECT coalesce(doc_id, 0) AS id, ((coalesce(doc_id, 0) % 7) + 7) % 7 AS kind FROM documents)
SELECT CASE WHEN kind = 5 THEN NULL WHEN kind = 3 THEN 'x' ELSE 'https://docs.test/' || CAST(id AS VARCHAR) END AS url,
  CASE kind WHEN 0 THEN NULL WHEN 1 THEN 'title: missing' WHEN 2 THEN 'remote: outside its values'
    WHEN 3 THEN 'url: not a web address' WHEN 4 THEN 'company: missing; source: missing'
    WHEN 5 THEN 'line: not a job object' ELSE 'seniority: outside its values; visa_sponsorship: outside its values' END AS reasons
FROM k"""
ORACLE["load_gold"] = f"""WITH {PAGES} SELECT concat('case', seq) AS case_id, title, company, seniority, visa_sponsorship, remote,
  sha256(html) AS html_hash FROM posting_pages"""
ORACLE["load_cv"] = f"SELECT {norm('text')} AS cv_words FROM benchmark"
ORACLE["cache_lookup"] = f"""WITH {CACHE} SELECT d.doc_id, sha256(d.text) AS text_hash,
  sha256(d.text) IN (SELECT text_hash FROM cache) AS hit FROM documents d"""
ORACLE["cache_store"] = f"""WITH {CACHE}, fresh AS (SELECT sha256(text) AS text_hash, max(doc_id) AS doc_id FROM documents GROUP BY 1)
SELECT sha256(text) AS text_hash, -max(item_id) AS doc_id FROM benchmark WHERE text NOT IN (SELECT text FROM documents) GROUP BY 1
UNION ALL SELECT * FROM fresh"""
ORACLE["cache_store_prefixes"] = ORACLE["cache_store"]
ORACLE["index_upsert"] = f"""WITH {JOBS} SELECT content_hash, seq, title, company, location, visa_sponsorship FROM jobs
QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY seq % 2 DESC, seq DESC) = 1"""
EXPORTED = f"""SELECT company, title, coalesce(country, '') AS country, remote, seniority, visa_sponsorship AS visa,
  {fixed("match_score", 3)} AS match_score, url, source, '' AS posted_at, 'to_apply' AS status FROM ranked"""
ORACLE["export_csv"] = ORACLE["rank_export"] = f"WITH {RANKED} {EXPORTED}"
ORACLE["export_summary"] = f"WITH {RANKED} SELECT count(*) AS rows FROM ranked"

# ---- projections ---------------------------------------------------------------------

ORACLE["clean_pages"] = f"""SELECT page_id, substr(whole, 1, {S.MAX_TEXT_CHARS}) AS text, length(whole) AS whole_chars,
  sha256(whole) AS whole_hash FROM (SELECT page_id, {whole_text("html")} AS whole FROM pages)"""
ORACLE["page_titles"] = f"""SELECT page_id, coalesce({title_part("html", H1_CONTENT)}, {title_part("html", TITLE_CONTENT)}) AS title
FROM pages"""
ORACLE["text_hash"] = "SELECT doc_id, sha256(text) AS text_hash FROM documents"
ORACLE["content_hash"] = f"""SELECT seq, {content_key("company", "title", "location")} AS content_hash,
  {content_key("source", "text", "NULL")} AS text_key FROM ({derived(D.POSTINGS)}) p"""
_csv = "replace(stack_csv, ',', ', ')"
ORACLE["job_text"] = f"WITH {JOBS} SELECT seq, {job_rendering(_csv, "text")} AS job_text FROM jobs"
ORACLE["json_from_output"] = f"""WITH {ANSWERS} SELECT seq, CAST(attempt AS BIGINT) AS attempt, json_text, p IS NOT NULL AS readable FROM parsed"""
_ok = lambda expr: f"CASE WHEN errors = '' THEN {expr} END"
_or_unknown = lambda f: _ok(f"coalesce({value(f)}, 'unknown')")
_strings = lambda f: _ok(f"coalesce({STRINGS.format(f)}, '')")
ORACLE["validate_records"] = f"""WITH {VALIDATED}
SELECT seq, CAST(attempt AS BIGINT) AS attempt, errors, {_ok(value("title"))} AS title, {_ok(value("company"))} AS company,
  {_ok(value("location"))} AS location, {_or_unknown("remote")} AS remote, {_or_unknown("seniority")} AS seniority,
  {_or_unknown("visa_sponsorship")} AS visa_sponsorship, {_strings("stack")} AS stack, {_strings("visa_signals")} AS visa_signals,
  {_ok(number("salary.min"))} AS salary_min, {_ok(number("salary.max"))} AS salary_max, {_ok(value("salary.currency"))} AS currency,
  {_ok(value("description_summary"))} AS description_summary, {_ok(f"CAST(floor({EPOCH}) AS BIGINT)")} AS posted_epoch
FROM checked"""
_t, _c, _l = value("title"), value("company"), value("location")
ORACLE["add_provenance"] = f"""WITH {VALIDATED}
SELECT c.seq, CAST(c.attempt AS BIGINT) AS attempt, {_t} AS title, {_c} AS company, g.source, replace(g.url, 'https://', 'https://www.') AS url,
  CAST(NULL AS VARCHAR) AS external_id, 1700000000 + c.seq AS fetched_epoch, {content_key(_c, _t, _l)} AS content_hash
FROM checked c JOIN ({derived(D.POSTINGS)}) g USING (seq) WHERE c.errors = ''"""
ORACLE["refine_visa"] = f"WITH {JOBS} SELECT seq, visa_sponsorship FROM jobs"
_low = visa_text("phrase", "description_summary", "text")
_evidence = ", ".join(
    f"CASE WHEN {matches(_low, p)} THEN '{label}{i}' END"
    for label, patterns in (("no", rules.VISA_NO), ("yes", rules.VISA_YES))
    for i, p in enumerate(patterns)
)
ORACLE["visa_evidence"] = f"SELECT seq, concat_ws('|', {_evidence}) AS evidence FROM ({derived(D.POSTINGS)}) p"
ORACLE["rule_extract"] = f"""WITH {RULED} SELECT seq, title, company, location, country, remote, seniority,
  array_to_string(stack, '|') AS stack, visa_sponsorship, array_to_string(signals, '|') AS visa_signals,
  salary_min, salary_max, currency, period, description_summary FROM ruled"""
ORACLE["build_requests"] = f"""WITH {CACHE} SELECT sha256(text) AS text_hash, text AS posting_text, true AS has_schema,
  {extraction.MAX_OUTPUT_TOKENS}::BIGINT AS max_tokens
FROM documents WHERE sha256(text) NOT IN (SELECT text_hash FROM cache)
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"""
ORACLE["match_score"] = f"""WITH {SCORED} SELECT cv_id, content_hash, round(match_score, 6) AS match_score,
  visa_sponsorship = 'yes' AS visa_eligible FROM ranked"""
ORACLE["match_reasons"] = f"WITH {SCORED} SELECT cv_id, content_hash, match_reasons FROM ranked"
ORACLE["call_cost"] = f"WITH {COSTED} SELECT run_id, turn, model, round(cost_usd, 9) AS cost_usd FROM costed"
ORACLE["rank_lines"] = f"""WITH {RANKED} SELECT cv_id, position, {fixed("match_score", 2)} || '  ' || title || ' @ ' || company
  || ' (' || coalesce(nullif(country, ''), '?') || ')  [' || replace(match_reasons, '|', ', ') || ']' AS line FROM ranked"""

# ---- filters, index, ranking ---------------------------------------------------------

ORACLE["list_jobs"] = f"""WITH {INDEX} SELECT {JOB_VIEW} FROM idx WHERE country IN ('IE', 'DE') AND seniority = 'senior'
  AND visa_sponsorship = 'yes' ORDER BY content_hash LIMIT 10"""
ORACLE["get_job"] = f"WITH {INDEX} SELECT {JOB_VIEW} FROM idx WHERE content_hash = (SELECT min(content_hash) FROM jobs)"
ORACLE["country_filter"] = f"WITH {INDEX} SELECT {JOB_VIEW} FROM idx WHERE country IN {in_list(DEFAULT_COUNTRIES)}"
ORACLE["visa_filter"] = f"WITH {INDEX} SELECT {JOB_VIEW} FROM idx WHERE visa_sponsorship = 'yes'"
ORACLE["route_outcome"] = f"WITH {FETCHED} SELECT url, CASE WHEN error IS NULL THEN 'ok' ELSE 'end' END AS route FROM fetched"
ORACLE["attach_vectors"] = f"""WITH {JOBS} SELECT seq, content_hash, len(vector) AS dim,
  round(sqrt(list_dot_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[]))), 6) AS norm FROM jobs"""
ORACLE["knn_topk"] = f"""WITH {hits(ELIGIBLE, 20)} SELECT cv_id, content_hash, round(similarity, 6) AS similarity, sim_rank FROM hits"""
ORACLE["rank_batch"] = f"""WITH {RANKED} SELECT cv_id, position, content_hash, title, company, country,
  round(similarity, 6) AS similarity, round(match_score, 6) AS match_score, match_reasons, visa_sponsorship = 'yes' AS visa_eligible
FROM ranked"""
ORACLE["dashboard_matches"] = f"""WITH {ranking("visa_sponsorship = 'yes'", DASHBOARD_MATCHES, None)}
SELECT cv_id, position, content_hash, round(match_score, 6) AS match_score, match_reasons FROM ranked"""
ORACLE["job_count"] = f"WITH {INDEX} SELECT count(*) AS jobs FROM idx"

# ---- de-duplication ------------------------------------------------------------------

ORACLE["dedup_exact"] = f"""WITH {JOBS} SELECT seq, content_hash, title, company, location FROM jobs
QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY seq) = 1"""
ORACLE["dedup_near"] = f"""WITH RECURSIVE {DOCUMENT_GREEDY}
SELECT seq, seq IN (SELECT seq FROM dropped) AS is_duplicate FROM sets"""
ORACLE["near_dup_pairs"] = f"""WITH RECURSIVE {DOCUMENT_GREEDY}
SELECT b AS seq, a AS match_seq, round(similarity, 6) AS similarity FROM pairs
WHERE b IN (SELECT seq FROM dropped) AND a NOT IN (SELECT seq FROM dropped)
QUALIFY row_number() OVER (PARTITION BY b ORDER BY pairs.similarity DESC, a) = 1"""
_vectors = "sets AS (SELECT vec_id AS seq, CAST(embedding AS DOUBLE[]) AS u FROM embeddings)"
_cos = "round(list_dot_product(x.u, y.u) / sqrt(list_dot_product(x.u, x.u) * list_dot_product(y.u, y.u)), 9)"
_vector_pairs = f"pairs AS MATERIALIZED (SELECT x.seq AS a, y.seq AS b FROM sets x JOIN sets y ON x.seq < y.seq WHERE {_cos} >= {{}})"
_moved = """sets AS MATERIALIZED (SELECT 2 * vec_id AS seq, CAST(embedding AS DOUBLE[]) AS u FROM embeddings UNION ALL
SELECT 2 * vec_id + 1, list_prepend(CAST(embedding[1] AS DOUBLE) + (vec_id % 8) * 0.05::DOUBLE, CAST(embedding AS DOUBLE[])[2:]) FROM embeddings)"""
for _name, _sets, _least in (("dedup_near_vectors", _vectors, 0.4), ("dedup_near_cells", _moved, THRESHOLD)):
    ORACLE[_name] = f"""WITH RECURSIVE {greedy(_sets, _vector_pairs.format(_least))}
SELECT seq, seq IN (SELECT seq FROM dropped) AS is_duplicate FROM sets"""

# ---- aggregations --------------------------------------------------------------------

ORACLE["cost_summary"] = f"""WITH {COSTED} SELECT model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost_usd), 6) AS cost_usd FROM costed GROUP BY model"""
ORACLE["ingest_outcomes"] = f"WITH {OUTCOMES} SELECT * FROM outcomes"
ORACLE["ingest_summary"] = f"""WITH {OUTCOMES} SELECT source, count(*) FILTER (outcome = 'indexed') AS indexed,
  count(*) FILTER (outcome = 'duplicate') AS duplicates, count(*) FILTER (outcome = 'error') AS errors FROM outcomes GROUP BY source"""
ORACLE["run_status"] = f"""SELECT run_id, state, round(result, 6) AS result, error FROM ({derived(D.RUN_LOG)}) l
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, entry_id DESC) = 1"""
ORACLE["field_accuracy"] = f"WITH {COMPARED} SELECT field, n, n_correct, round(accuracy, 6) AS accuracy FROM accuracy"
ORACLE["overall_accuracy"] = f"WITH {COMPARED} SELECT round(avg(accuracy), 6) AS overall FROM accuracy"
ORACLE["eval_mistakes"] = f"WITH {COMPARED} SELECT case_id, field, gold, pred FROM compared WHERE gold <> pred"
ORACLE["eval_run"] = f"""WITH {COMPARED} SELECT field, round(accuracy, 6) AS accuracy FROM accuracy
UNION ALL SELECT 'overall', round(avg(accuracy), 6) FROM accuracy"""

# ---- extraction as dataflow ----------------------------------------------------------

ORACLE["first_valid_attempt"] = f"""WITH {VALIDATED},
solved AS (SELECT seq, min(attempt) FILTER (errors = '') AS attempt, max(attempt) AS last_attempt FROM checked GROUP BY seq)
SELECT s.seq, CAST(s.attempt AS BIGINT) AS attempt, CAST(coalesce(s.attempt, s.last_attempt) AS BIGINT) AS attempts,
  CASE WHEN s.attempt IS NOT NULL THEN {_t} END AS title, CASE WHEN s.attempt IS NOT NULL THEN {_c} END AS company,
  CASE WHEN s.attempt IS NULL THEN 'extraction failed: ' || replace(c.errors, '|', ',') END AS error
FROM solved s JOIN checked c ON c.seq = s.seq AND c.attempt = coalesce(s.attempt, s.last_attempt)"""
ORACLE["extract_cascade"] = f"""WITH {VALIDATED},
firsts AS (SELECT *, min(attempt) FILTER (errors = '') OVER (PARTITION BY seq) AS won FROM checked
  QUALIFY dense_rank() OVER (PARTITION BY text ORDER BY seq) = 1)
SELECT sha256(text) AS text_hash, CAST(attempt AS BIGINT) AS attempt, CASE WHEN attempt = 3 THEN 'strong' ELSE 'fast' END AS tier,
  CASE WHEN attempt = 3 THEN 'captured-strong' ELSE 'captured-fast' END AS model, CAST(ceil(length(text) / 4) AS BIGINT) AS input_tokens,
  CAST(ceil(length(output) / 4) AS BIGINT) AS output_tokens, errors
FROM firsts WHERE attempt <= coalesce(won, 3)"""
_bucket = f"CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {vectors.HASHED_DIM}"
ORACLE["embed_text"] = f"""WITH {JOBS}, rendered AS (SELECT seq, {job_rendering(_csv, "text")} AS job_text FROM jobs),
hit AS (SELECT DISTINCT seq, {_bucket} AS pos FROM (SELECT seq, unnest({words("job_text")}) AS w FROM rendered))
SELECT seq, pos, round(1 / sqrt(count(*) OVER (PARTITION BY seq)), 6) AS weight FROM hit"""
_answer = (
    "to_json({'title': title, 'company': company, 'location': location, 'country': country, 'remote': remote, "
    "'seniority': seniority, 'stack': stack, 'salary': CASE WHEN currency IS NOT NULL THEN {'min': salary_min, "
    "'max': salary_max, 'currency': currency, 'period': period} END, 'visa_sponsorship': visa_sponsorship, "
    "'visa_signals': signals, 'description_summary': description_summary})"
)
_mini = next((i, o) for m, i, o in cost.PRICES if m == "gpt-5-mini")
ORACLE["extract_job"] = f"""WITH {REFINED},
billed AS (SELECT seq, CAST(ceil(length(text) / 4) AS BIGINT) AS input_tokens, CAST(ceil(length({_answer}) / 4) AS BIGINT) AS output_tokens
  FROM ruled)
SELECT r.url, r.title, r.company, r.location, r.country, r.remote, r.seniority, array_to_string(r.stack, '|') AS stack,
  r.visa_sponsorship, r.source, {content_key("r.company", "r.title", "r.location")} AS content_hash, CAST(1 AS BIGINT) AS calls,
  b.input_tokens, b.output_tokens,
  round(b.input_tokens / 1000000 * {_mini[0]}::DOUBLE + b.output_tokens / 1000000 * {_mini[1]}::DOUBLE, 9) AS cost_usd
FROM refined r JOIN billed b USING (seq) QUALIFY row_number() OVER (PARTITION BY r.text_hash ORDER BY r.seq) = 1"""
INGESTED = f"""WITH RECURSIVE {REFINED},
origin AS (SELECT *, first_value(seq) OVER (PARTITION BY text_hash ORDER BY seq) AS first_seq FROM refined),
rendered AS (SELECT seq, {job_rendering("array_to_string(stack, ', ')", "text")} AS job_text FROM refined),
{greedy(f"sets AS MATERIALIZED (SELECT o.seq, {words('r.job_text')} AS ws FROM origin o JOIN rendered r ON r.seq = o.first_seq)", WORD_PAIRS)}"""
ORACLE["ingest"] = f"""{INGESTED}
SELECT seq, source, url, CASE WHEN seq IN (SELECT seq FROM dropped) THEN 'duplicate' ELSE 'indexed' END AS outcome,
  CAST(NULL AS VARCHAR) AS error FROM refined
UNION ALL
SELECT seq, source, url, 'error', 'fetch failed: no page for ' || url FROM ({derived(D.WORK_ITEMS)}) w WHERE source = 'lost'"""
_bits = "CAST(array_to_string(list_transform(range({0}), lambda i: CASE WHEN list_contains(list(pos), i) THEN '1' ELSE '0' END), '') AS BIT)"
_score, _reasons = scores(DEFAULT_COUNTRIES)


def marks(name: str, texts: str) -> str:
    """``name(seq, n, bits)``: which places the words of ``texts(seq, t)`` are hashed to."""
    return f"""{name} AS MATERIALIZED (SELECT seq, count(*) AS n, {_bits.format(vectors.HASHED_DIM)} AS bits
  FROM (SELECT DISTINCT seq, {_bucket} AS pos FROM (SELECT seq, unnest({words("t")}) AS w FROM ({texts}))) GROUP BY seq)"""


_alike = "round(bit_count(x.bits & y.bits) / sqrt(x.n::DOUBLE * y.n), 9)"
ORACLE["pages_to_ranks"] = f"""WITH RECURSIVE {REFINED},
origin AS (SELECT *, first_value(seq) OVER (PARTITION BY text_hash ORDER BY seq) AS first_seq FROM refined),
rendered AS (SELECT seq, {job_rendering("array_to_string(stack, ', ')", "text")} AS t FROM origin WHERE seq = first_seq),
{marks("marked", "SELECT seq, t FROM rendered")},
{marks("asked", "SELECT item_id AS seq, text AS t FROM benchmark")},
{greedy("sets AS MATERIALIZED (SELECT o.seq, m.n, m.bits FROM origin o JOIN marked m ON m.seq = o.first_seq)",
        f"pairs AS MATERIALIZED (SELECT x.seq AS a, y.seq AS b, {_alike} AS similarity FROM sets x JOIN sets y ON x.seq < y.seq WHERE {_alike} >= {THRESHOLD})")},
idx AS (SELECT o.*, {content_key("company", "title", "location")} AS content_hash, s.n, s.bits FROM origin o JOIN sets s USING (seq)
  WHERE o.seq NOT IN (SELECT seq FROM dropped) QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY o.seq DESC) = 1),
eligible AS (SELECT * FROM idx WHERE {ELIGIBLE}),
hits AS (SELECT y.seq AS cv_id, x.content_hash, {_alike} AS similarity FROM eligible x, asked y
  QUALIFY row_number() OVER (PARTITION BY cv_id ORDER BY similarity DESC, x.content_hash) <= 20),
scored AS (SELECT h.cv_id, h.similarity, j.*, {_score} AS match_score, {_reasons} AS match_reasons FROM hits h JOIN eligible j USING (content_hash))
SELECT cv_id, row_number() OVER (PARTITION BY cv_id ORDER BY match_score DESC, similarity DESC, content_hash) AS position, content_hash,
  title, company, country, round(similarity, 6) AS similarity, round(match_score, 6) AS match_score, match_reasons FROM scored"""
ORACLE["ingest_stream"] = f"""{INGESTED}
SELECT url, source, CASE WHEN seq IN (SELECT seq FROM dropped) THEN 'duplicate' ELSE 'indexed' END AS outcome,
  CAST(NULL AS VARCHAR) AS error FROM refined"""
ORACLE["ingest_stream_summary"] = f"""{INGESTED}
SELECT count(*) - (SELECT count(*) FROM dropped) AS indexed, (SELECT count(*) FROM dropped) AS duplicates,
  CAST(0 AS BIGINT) AS errors, CAST(3 AS BIGINT) AS batches FROM refined"""
ORACLE["index_upsert_versioned"] = ORACLE["index_upsert"]
ORACLE["get_job_versioned"] = ORACLE["get_job"]
