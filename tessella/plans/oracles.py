"""SQL for queries whose work is greedy or keeps a state: chunking, personal data, the job stream.

DuckDB folds lists (list_reduce), which says what a loop over parts, matches or events does.
"""

from __future__ import annotations

from ..functions import pii, text
from ..streaming import job_stream

_BLANK = "' ' || chr(10) || chr(9)"


def _literal(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" if c in "\n\t" else f"'{c}'" for c in s) or "''"


def chunks_sql(cleaned: str, size: int, overlap: int) -> str:
    """(doc_id, i from 0, n, piece) of the chunks of `cleaned`, a query of (doc_id, cleaned): pieces over `size` are cut
    by one separator after the other and packed greedily."""
    steps = [f"whole AS (SELECT doc_id, cleaned AS t FROM ({cleaned}) WHERE length(cleaned) >= {text.MIN_PAGE})", f"s0 AS (SELECT doc_id, [0] AS place, t AS p FROM whole WHERE length(t) > {size})"]
    for k, separator in enumerate(text.SEPARATORS):
        long = "true" if k == 0 else f"length(p) > {size}"
        if separator:
            sep = _literal(separator)
            start = "{'done': []::VARCHAR[], 'now': x}"
            add = f"CASE WHEN a.now = '' THEN {{'done': a.done, 'now': x.now}} WHEN length(a.now) + {len(separator)} + length(x.now) <= {size} THEN {{'done': a.done, 'now': a.now || {sep} || x.now}} ELSE {{'done': list_append(a.done, a.now), 'now': x.now}} END"
            folded = f"list_reduce(list_transform(string_split(p, {sep}), lambda x: {start}), lambda a, x: {add})"
            cut = f"SELECT doc_id, place, list_append(f.done, f.now) AS l FROM (SELECT doc_id, place, {folded} AS f FROM s{k} WHERE {long})"
        else:
            cut = f"SELECT doc_id, place, list_transform(range((length(p) + {size} - 1) // {size}), lambda i: substr(p, i * {size} + 1, {size})) AS l FROM s{k} WHERE {long}"
        keep = "" if k == 0 else f" UNION ALL SELECT doc_id, list_append(place, 0), p FROM s{k} WHERE length(p) <= {size}"
        steps.append(f"s{k + 1} AS (SELECT doc_id, list_append(place, g) AS place, p FROM (SELECT doc_id, place, generate_subscripts(l, 1) AS g, unnest(l) AS p FROM ({cut})) WHERE p <> ''{keep})")
    last = len(text.SEPARATORS)
    steps.append(f"base AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS i, p FROM (SELECT doc_id, place, trim(p, {_BLANK}) AS p FROM s{last}) WHERE length(p) >= {text.MIN_PIECE})")
    tail = f"right(lag(p) OVER (PARTITION BY doc_id ORDER BY i), {overlap})"
    steps.append(f"pieces AS (SELECT doc_id, i, CASE WHEN i = 0 THEN p ELSE trim({tail} || ' ' || p, {_BLANK}) END AS piece FROM base UNION ALL SELECT doc_id, 0, t FROM whole WHERE length(t) <= {size})")
    return f"WITH {', '.join(steps)} SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id) AS n, piece FROM pieces"


def chunk_rows_sql(cleaned: str) -> str:
    header = "trim(concat_ws(' ', nullif(source, ''), CASE WHEN c.doc_id <> 0 THEN 'p.' || c.doc_id END))"
    return f"""SELECT c.doc_id, d.source, c.n::INT AS n_chunks, c.i::INT AS chunk_index, c.piece AS content, CASE WHEN {header} = '' THEN piece ELSE {header} || chr(10) || piece END AS embed_text
  FROM ({chunks_sql(cleaned, text.CHUNK_SIZE, text.CHUNK_OVERLAP)}) c JOIN documents d ON d.doc_id = c.doc_id"""


def chunk_grid_sql(cleaned: str, candidates: list[tuple[int, int]], quantile) -> str:
    """Statistics of lengths and page tallies for each (size, overlap); quantile(p) is the SQL of a percentile."""
    parts = []
    for size, overlap in candidates:
        rows = chunks_sql(cleaned, size, overlap)
        parts.append(f"""SELECT {size} AS size, {overlap} AS overlap, n, v[1] AS min, floor((v[(n + 1) // 2] + v[(n + 2) // 2]) / 2)::BIGINT AS p50, round_even(list_sum(v)::DOUBLE / n, 1) AS mean, {quantile(90)}, {quantile(99)}, v[n] AS max, over_percent, pages_split, pages_single, pages - pages_split - pages_single AS dropped
    FROM (SELECT count(*) AS n, list(length(piece)::BIGINT ORDER BY length(piece)) AS v, round(100.0::DOUBLE * count(*) FILTER (length(piece) > {size}) / count(*), 1) AS over_percent, count(DISTINCT doc_id) FILTER (n > 1) AS pages_split, count(DISTINCT doc_id) FILTER (n = 1) AS pages_single, (SELECT count(*) FROM documents) AS pages FROM ({rows}))""")
    return " UNION ALL ".join(parts)


# Personal data: digit runs are marked at both ends, which says what look-around would.

_ON, _OFF = "chr(1)", "chr(2)"


def _plain(x: str) -> str:
    return f"replace(replace({x}, {_ON}, ''), {_OFF}, '')"


def _marked_pattern(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_GAP = r"(?:\x02\s*{0}?\s*\x01)?"
_RESIDENT = r"\x01\d{6}" + _GAP.format("[-–—]") + r"[1-8]\d{6}\x02"
_PHONE = r"\x010\d{1,2}" + _GAP.format("[-.)]") + r"\d{3,4}" + _GAP.format("[-.]") + r"\d{4}\x02"
_ACCOUNT = r"\d{2,6}(?:\x02\s*[-–—]\s*\x01\d{2,6}){2,4}"
_NAME = rf"(?:{'|'.join(pii.NAME_LABELS)})\s*[:：]?\s*([가-힣]{{2,5}})"


def _found(texts: str, kind: str, pattern: str, where: str = "true", group: bool = False) -> str:
    """(key, kind, s, e) of a pattern in `texts`, a query of (key, w, m: w with its digit runs marked); the first group
    of it only, which ends the match, if `group`."""
    p = _marked_pattern(pattern)
    n = lambda x: f"list_sum(list_transform({x}, lambda y: length({_plain('y')})))"
    start = f"coalesce({n('g[1:i]')}, 0) + coalesce({n('l[1:i - 1]')}, 0)"
    own = f"length({_plain('l[i]')})"
    inner = f"length({_plain('h[i]')})" if group else own
    first = f"regexp_extract_all(m, {p}, 1) AS h" if group else "NULL AS h"
    refused = " AND NOT (" + " OR ".join(f"starts_with(h[i], '{x}')" for x in pii.NOT_NAMES) + ")" if group else ""
    return f"SELECT key, '{kind}' AS kind, ({start} + {own} - {inner})::INT AS s, ({start} + {own})::INT AS e FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT key, regexp_extract_all(m, {p}) AS l, string_split_regex(m, {p}) AS g, {first} FROM {texts} WHERE {where})) WHERE true{refused}"


def detect_sql(texts: str) -> str:
    """(key, kind, s, e) of all matches in `texts`, a query of (key, w)."""
    marked = f"(SELECT key, w, regexp_replace(w, '(\\d+)', {_ON} || '\\1' || {_OFF}, 'g') AS m FROM {texts})"
    plain = f"(SELECT key, w, w AS m FROM {texts})"
    account = f"regexp_matches(w, '{'|'.join(pii.ACCOUNT_WORDS)}')"
    kinds = [_found(marked, "resident_registration_number", _RESIDENT), _found(marked, "phone_number", _PHONE), _found(plain, "email", pii.EMAIL), _found(marked, "bank_account", _ACCOUNT, account), _found(plain, "name", _NAME, group=True)]
    return " UNION ALL ".join(kinds)


def masked_sql(regions: str) -> str:
    """(key, doc_id, page, region, text, counts: sorted kind=n) of `regions`, a query of (doc_id, page, region, text), as
    each region sees the one before it: of overlapping matches the first by place counts."""
    held = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pii.PLACEHOLDERS.items())
    add = f"CASE WHEN x.s >= a.e THEN {{'s': 0, 'e': x.e, 'kind': a.kind || x.kind || ',', 'text': a.text || substr(x.text, a.e + 1, x.s - a.e) || CASE x.kind {held} END}} ELSE a END"
    return f"""WITH r AS (SELECT row_number() OVER () AS key, *, lag(text) OVER (PARTITION BY doc_id, page ORDER BY region) AS before FROM ({regions})),
  w AS (SELECT key, coalesce(nullif(before, '') || chr(10), '') || coalesce(text, '') AS w, coalesce(length(nullif(before, '')) + 1, 0) AS shift FROM r),
  f AS (SELECT f.key, kind, (s - shift)::INT AS s, (e - shift)::INT AS e FROM ({detect_sql('w')}) f JOIN w USING (key) WHERE s >= shift),
  l AS (SELECT key, list({{'s': s, 'e': e, 'kind': kind, 'text': coalesce(text, '')}} ORDER BY s, e) AS l FROM f JOIN r USING (key) GROUP BY key),
  d AS (SELECT key, list_reduce(list_prepend({{'s': 0, 'e': 0::INT, 'kind': '', 'text': ''}}, l), lambda a, x: {add}) AS a FROM l)
  SELECT r.key, doc_id, page, region, CASE WHEN a IS NULL THEN coalesce(r.text, '') ELSE a.text || substr(coalesce(r.text, ''), a.e + 1) END AS text,
    CASE WHEN a IS NULL THEN []::VARCHAR[] ELSE list_filter(list_transform({sorted(pii.KINDS)}, lambda k: k || '=' || len(list_filter(string_split(a.kind, ','), lambda y: y = k))), lambda z: NOT ends_with(z, '=0')) END AS counts
  FROM r LEFT JOIN d USING (key)"""


# The job stream: a fold of each job's events, then what the watermark does at the end.

_STATUS = {"view": "SUBMIT", "click": "CLAIM", "signup": "HEARTBEAT", "purchase": "SUCCEED"}


def job_states_sql() -> str:
    lease, delay = job_stream.LEASE_SECONDS * 1_000_000, 600 * 1_000_000
    kind = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items())
    late = f"(a.status = 'RUNNING' AND x.us > a.seen + {lease})"
    now, seen = f"CASE WHEN {late} THEN CASE WHEN a.attempt >= {job_stream.MAX_ATTEMPTS} THEN 'FAILED' ELSE 'QUEUED' END ELSE a.status END", f"CASE WHEN {late} THEN a.seen + {lease} ELSE a.seen END"
    held = f"CASE WHEN x.event IN ('HEARTBEAT', 'SUCCEED', 'FAIL') AND ({now}) = 'RUNNING' THEN CASE x.event WHEN 'HEARTBEAT' THEN 'RUNNING' WHEN 'SUCCEED' THEN 'SUCCEEDED' ELSE 'FAILED' END ELSE {now} END"
    step = f"""CASE WHEN x.event = 'SUBMIT' AND a.status = '' THEN {{'status': 'QUEUED', 'attempt': 0, 'seen': x.us, 'event': '', 'us': 0}} WHEN x.event = 'CLAIM' AND ({now}) = 'QUEUED' THEN {{'status': 'RUNNING', 'attempt': a.attempt + 1, 'seen': x.us, 'event': '', 'us': 0}}
    ELSE {{'status': {held}, 'attempt': a.attempt, 'seen': CASE WHEN x.event IN ('HEARTBEAT', 'SUCCEED', 'FAIL') AND ({now}) = 'RUNNING' THEN x.us ELSE {seen} END, 'event': '', 'us': 0}} END"""
    none = "{'status': '', 'attempt': 0, 'seen': 0::BIGINT, 'event': '', 'us': 0::BIGINT}"
    return f"""WITH e AS (SELECT user_id AS job_id, CASE event_type {kind} ELSE 'FAIL' END AS event, epoch_us(ts) AS us, event_id FROM events),
  l AS (SELECT job_id, list({{'status': '', 'attempt': 0, 'seen': 0::BIGINT, 'event': event, 'us': us}} ORDER BY us, event_id) AS l FROM e GROUP BY job_id),
  f AS (SELECT job_id, list_reduce(list_prepend({none}, l), lambda a, x: {step}) AS a FROM l), w AS (SELECT ((max(us) - {delay}) // 1000) AS mark FROM e),
  t AS (SELECT job_id, a.status AS status, a.attempt AS attempt, a.seen AS seen, a.status = 'RUNNING' AND a.seen // 1000 + {lease // 1000} < mark AS ended FROM f, w WHERE a.status <> '')
  SELECT job_id, CASE WHEN ended THEN CASE WHEN attempt >= {job_stream.MAX_ATTEMPTS} THEN 'FAILED' ELSE 'QUEUED' END ELSE status END AS status, attempt::INT AS attempt, make_timestamp(CASE WHEN ended THEN seen + {lease} ELSE seen END) AS "at" FROM t"""
