"""DuckDB equivalents of the registered queries, built from common table expressions."""

from __future__ import annotations

from skald.functions.text import FOLD_FROM, FOLD_TO, STOPWORDS

WEB = """web AS (SELECT CAST(doc_id AS VARCHAR) AS id, left(split_part(coalesce(text, ''), chr(10), 1), 80) AS title,
    'https://' || source || '.example.com/' || lang || '/' || doc_id AS url, left(coalesce(text, ''), 200) AS snippet, coalesce(text, '') AS body, '' AS headings, source,
    CASE WHEN doc_id % 10 = 0 THEN '' ELSE strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') END AS date, lang FROM documents)"""
PARTS = """web AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, 'https://parts.example.com/' || p_partkey AS url, p_type AS snippet, '' AS body, '' AS headings,
    p_brand AS source, '2024-01-01' AS date, 'en' AS lang, 'Port' || (p_partkey % 7) AS m_from, 'Port' || (p_partkey % 5) AS m_to, '2024-03-0' || (p_partkey % 9 + 1) AS m_depart FROM part)"""
TRIPS = """web AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'Flight ticket to city ' ELSE 'Ferry to city ' END || n_nationkey AS title, 'https://trips.example.com/' || n_nationkey AS url,
    CASE WHEN n_nationkey % 3 = 0 THEN 'Hotel near town ' ELSE 'Road to town ' END || n_nationkey AS snippet, '' AS body, '' AS headings, 'region' || n_regionkey AS source, '2024-01-01' AS date, 'en' AS lang FROM nation)"""
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def norm(c: str) -> str:
    folded = f"replace(replace(replace(translate(lower(replace({c}, 'İ', 'i')), '{FOLD_FROM}', '{FOLD_TO}'), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss')"
    return f"regexp_replace({folded}, '[^a-zA-Z0-9]', ' ', 'g')"




def tokens(docs: str, column: str, field: str) -> str:
    """Rows (id, field, pos, token) of one field."""
    if field == "url":
        return f"SELECT id, 'url' AS field, CAST(unnest(range(len(w))) AS INTEGER) AS pos, unnest(w) AS token FROM (SELECT id, list_filter(string_split({norm(column)}, ' '), lambda x: length(x) >= 2) AS w FROM {docs})"
    split = f"SELECT id, lang, list_filter(string_split({norm(column)}, ' '), lambda x: length(x) >= 2 AND NOT (lang = 'en' AND x IN ({_STOP}))) AS w FROM {docs}"
    raw = f"SELECT id, lang, CAST(unnest(range(len(w))) AS INTEGER) AS pos, unnest(w) AS t FROM ({split})"
    first = f"SELECT id, lang, pos, t, CASE WHEN length(t) > 3 AND regexp_matches(t, '(s|x|z|ch|sh)es$') THEN left(t, length(t) - 2) ELSE t END AS a FROM ({raw})"
    second = f"SELECT id, lang, pos, t, CASE WHEN length(a) > 3 AND regexp_matches(a, '[^s]s$') THEN left(a, length(a) - 1) ELSE a END AS s FROM ({first})"
    base = f"SELECT *, CASE WHEN s LIKE '%ing' AND length(s) > 5 THEN left(s, length(s) - 3) WHEN s LIKE '%ed' AND length(s) > 4 THEN left(s, length(s) - 2) END AS b FROM ({second})"
    stem = "CASE WHEN lang <> 'en' OR length(t) <= 3 THEN t WHEN t LIKE '%ies' AND length(t) > 4 THEN left(t, length(t) - 3) || 'y' WHEN t LIKE '%sses' AND length(t) > 4 THEN left(t, length(t) - 2) WHEN b IS NULL THEN s WHEN length(b) >= 2 AND right(b, 1) = left(right(b, 2), 1) THEN left(b, length(b) - 1) ELSE b END"
    return f"SELECT id, '{field}' AS field, pos, {stem} AS token FROM ({base})"


def all_tokens(docs: str = "web") -> str:
    return "tok AS (" + " UNION ALL ".join(tokens(docs, f, f) for f in ("title", "snippet", "body", "url", "headings")) + ")"


TF = """tf AS (SELECT id, token, count(*) FILTER (field = 'title') AS tf_title, count(*) FILTER (field = 'snippet') AS tf_snippet, count(*) FILTER (field = 'body') AS tf_body,
    count(*) FILTER (field = 'url') AS tf_url, count(*) FILTER (field = 'headings') AS tf_headings FROM tok GROUP BY id, token),
    df AS (SELECT token, count(*) AS df FROM tf GROUP BY token)"""


def variants(asked: list[str], synonyms: dict[str, list[str]] | None = None) -> str:
    q = ", ".join(f"('{t}')" for t in asked)
    pairs = ", ".join(f"('{t}', '{s}')" for t in asked for s in (synonyms or {}).get(t, []))
    alias = f" UNION ALL SELECT a, b, 0.8, 3 FROM (VALUES {pairs}) s(a, b)" if pairs else ""
    return f"""q AS (SELECT * FROM (VALUES {q}) v(q_token)),
    pre AS (SELECT q_token, token, CASE WHEN length(q_token) <= 2 THEN 0.4 ELSE 0.7 END AS mult, 1 AS kind FROM q, df WHERE starts_with(token, q_token) AND token <> q_token AND length(q_token) >= 2),
    var AS (SELECT q_token, token, CAST(arg_min(mult, kind) AS DOUBLE) AS mult FROM (SELECT q_token, q_token AS token, 1.0 AS mult, 0 AS kind FROM q UNION ALL SELECT * FROM pre
        UNION ALL SELECT q_token, token, 0.5, 2 FROM q, df WHERE length(q_token) >= 3 AND token <> q_token AND abs(length(token) - length(q_token)) <= 1 AND levenshtein(token, q_token) <= 1 AND q_token NOT IN (SELECT q_token FROM pre){alias}) GROUP BY q_token, token)"""


def search(parsed, docs: str = WEB, settings=None, boost: str = "0.0") -> str:
    """CTEs down to ``res`` (id, score and the document's columns) of one query; ``boost`` is SQL over ``web`` and ``lines``."""
    asked = sorted({*parsed.required, *parsed.optional, *parsed.negated, *parsed.scored}) or [""]
    ins = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs or [""]) + ")"
    if parsed.required:
        cand = f"SELECT id FROM heads WHERE q_token IN {ins(parsed.required)} GROUP BY id HAVING count(DISTINCT q_token) = {len(parsed.required)}"
    elif parsed.optional:
        cand = f"SELECT DISTINCT id FROM heads WHERE q_token IN {ins(parsed.optional)}"
    else:
        cand = "SELECT id FROM web"
    if parsed.negated:
        cand = f"SELECT id FROM ({cand}) WHERE id NOT IN (SELECT id FROM heads WHERE q_token IN {ins(parsed.negated)})"
    priors = (settings.priors if settings else {}) or {}
    prior = "greatest(1.0, 1.0" + "".join(f", CASE WHEN lower(source) LIKE '%{k}' THEN CAST({v} AS DOUBLE) ELSE 1.0 END" for k, v in priors.items()) + ")"
    return f"""WITH {docs}, {all_tokens()}, {TF}, {variants(asked, settings.synonyms if settings else None)},
    heads AS (SELECT id, q_token FROM tf JOIN var USING (token) WHERE tf_title > 0 OR tf_snippet > 0),
    cand AS ({cand}), n AS (SELECT count(*) AS n FROM web),
    w AS (SELECT tf.id, (2.0::DOUBLE * tf_title + 1.0::DOUBLE * tf_snippet + 0.7::DOUBLE * tf_body + 1.2::DOUBLE * tf_url + 1.4::DOUBLE * tf_headings) * ln(1 + n.n / (1 + df)::DOUBLE) * mult AS w
          FROM tf JOIN var USING (token) JOIN df USING (token), n WHERE q_token IN {ins(parsed.scored)} AND tf.id IN (SELECT id FROM cand)),
    sums AS (SELECT id, list_sum(list_sort(list(w))) AS s, list_sum(list_transform(list_sort(list(w)), lambda x: x * x)) AS n FROM w GROUP BY id),
    lines AS (SELECT id, list(' ' || line || ' ') AS lines FROM (SELECT id, field, string_agg(token, ' ' ORDER BY pos) AS line FROM tok GROUP BY id, field) GROUP BY id),
    boost AS (SELECT * FROM (SELECT web.id, {boost} AS b FROM web LEFT JOIN lines USING (id) WHERE web.id IN (SELECT id FROM cand)) WHERE b > 0),
    both_ AS (SELECT coalesce(sums.id, boost.id) AS id, coalesce(s, 0.0) + coalesce(b, 0.0) AS s, coalesce(n, 0.0) AS n FROM sums FULL JOIN boost ON sums.id = boost.id),
    res AS (SELECT web.*, CASE WHEN n > 0 THEN s / sqrt(n) ELSE s END * {prior} AS score, CASE WHEN regexp_full_match(date, '\\d{{4}}-\\d\\d-\\d\\d') THEN try_cast(date AS TIMESTAMP) END AS date_ts FROM both_ JOIN web USING (id))"""


TEXT = "lower(concat_ws(' ', title, snippet, body, url, headings))"
ORDER = "round(score, 9) DESC, id, url"
LATEST = f"date_ts DESC NULLS LAST, {ORDER}"
HIT = "SELECT id, round(score, 6) AS score FROM"


def top(cte: str, n: int = 10, skip: int = 0, where: str = "true", order: str = ORDER, per_source: int | None = None) -> str:
    rows = f"SELECT *, row_number() OVER (PARTITION BY source ORDER BY {order}) AS k FROM res WHERE {where}"
    limit = f"WHERE k <= {per_source}" if per_source else ""
    return f"{cte} {HIT} (SELECT * FROM ({rows}) {limit} ORDER BY {order} LIMIT {n} OFFSET {skip})"


def engine_page(q: str) -> str:
    """The second page of ten of a search over the parts that two uploads left, without a limit per source."""
    from skald.operators.query import parse

    docs = PARTS.replace("p_name AS title", "p_name || CASE WHEN p_partkey % 3 = 0 THEN ' again' ELSE '' END AS title").replace("FROM part)", "FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0)")
    return f"{search(parse(q), docs)} SELECT title, url, source FROM (SELECT * FROM res ORDER BY {ORDER} LIMIT 10 OFFSET 10)"
