"""SQL fragments (DuckDB dialect) mirroring the column expressions, for the oracles."""

from __future__ import annotations

from lexiflow.functions.text import DEFAULT_STOPWORDS, PUNCTUATION, WHITESPACE_RE, strip_class


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP_SQL = "(" + ", ".join(lit(w) for w in DEFAULT_STOPWORDS) + ")"
WS_SQL = lit(WHITESPACE_RE)
PUNCT_LIST_SQL = "[" + ", ".join(lit(c) for c in PUNCTUATION) + "]"


def tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {WS_SQL}), lambda x: length(x) > 0)"


def normalized(expr: str, remove_numbers: bool = True, keep=True) -> str:
    t = f"regexp_replace(lower({expr}), '[^\\x00-\\x7f]', '', 'g')"
    if remove_numbers:
        t = f"regexp_replace({t}, '[0-9]', ' ', 'g')"
    cls = strip_class(keep)
    if cls:
        t = f"regexp_replace({t}, {lit(cls)}, ' ', 'g')"
    return t


def clean_list(expr: str, min_len: int = 2, max_len: int = 15, keep=True,
               remove_numbers: bool = True, stop: bool = True) -> str:
    cond = f"length(x) >= {min_len} AND length(x) <= {max_len}"
    if stop:
        cond += f" AND x NOT IN {STOP_SQL}"
    return (f"list_filter(regexp_split_to_array({normalized(expr, remove_numbers, keep)}, "
            f"{WS_SQL}), lambda x: {cond})")


def clean(expr: str, **kw) -> str:
    return f"array_to_string({clean_list(expr, **kw)}, ' ')"


# Options used for discovery corpora (training-set preprocessing).
TRAIN_OPTS = dict(min_len=2, max_len=40, keep=["-"], remove_numbers=True)


def substring_count(t: str, q: str) -> str:
    return f"((length({t}) - length(replace({t}, {q}, ''))) // length({q}))"


def token_count(t: str, q: str) -> str:
    t2 = f"(' ' || replace({t}, ' ', '  ') || ' ')"
    q2 = f"(' ' || replace({q}, ' ', '  ') || ' ')"
    return substring_count(t2, q2)


def padded_count(t: str, q: str) -> str:
    return substring_count(t, f"(' ' || {q} || ' ')")


# --- shared CTEs ------------------------------------------------------------------

RAW_QUERIES = f"""raw_q AS (
  SELECT DISTINCT unnest(list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])) AS query
  FROM (SELECT {tokens('text')} AS tk FROM benchmark)
)"""

QUERIES = RAW_QUERIES + f""",
queries AS (
  SELECT DISTINCT q AS query, len(string_split(q, ' ')) AS n_tokens
  FROM (SELECT {clean('query', min_len=1, max_len=30, keep=True, remove_numbers=False)} AS q
        FROM raw_q) WHERE q <> ''
)"""

PROFILE = QUERIES + f""",
q_terms AS (SELECT query, unnest(string_split(query, ' ')) AS term FROM queries),
q_chars AS (
  SELECT DISTINCT ch FROM (SELECT unnest(string_split(term, '')) AS ch FROM q_terms)
  WHERE regexp_matches(ch, '^[^\\p{{L}}\\p{{N}} ]$')
),
profile AS (
  SELECT coalesce(bool_or(regexp_matches(term, '[0-9]')), false) AS has_digits,
         min(length(term)) AS min_term_len, max(length(term)) AS max_term_len,
         count(DISTINCT query) AS n_queries,
         (SELECT coalesce(string_agg(ch, '' ORDER BY ch), '') FROM q_chars) AS keep_chars,
         (SELECT '[' || string_agg('\\' || c, '' ORDER BY c) || ']'
            FROM (SELECT unnest({PUNCT_LIST_SQL}) AS c)
           WHERE c NOT IN (SELECT ch FROM q_chars)) AS strip_re
  FROM q_terms
)"""


def search_clean(expr: str) -> str:
    """Search-set cleaning with options read from the one-row ``profile`` CTE (p)."""
    t = f"regexp_replace(lower({expr}), '[^\\x00-\\x7f]', '', 'g')"
    t = f"CASE WHEN p.has_digits THEN {t} ELSE regexp_replace({t}, '[0-9]', ' ', 'g') END"
    t = f"CASE WHEN p.strip_re IS NULL THEN {t} ELSE regexp_replace({t}, p.strip_re, ' ', 'g') END"
    cond = (f"length(x) >= p.min_term_len AND length(x) <= p.max_term_len "
            f"AND x NOT IN {STOP_SQL}")
    return (f"array_to_string(list_filter(regexp_split_to_array({t}, {WS_SQL}), "
            f"lambda x: {cond}), ' ')")


SEARCH_DOCS = PROFILE + f""",
search_docs AS (
  SELECT d.doc_id, {search_clean('d.text')} AS body FROM documents d, profile p
)"""


def hits_cte(mode: str = "token") -> str:
    counter = token_count if mode == "token" else padded_count
    return SEARCH_DOCS + f""",
hits AS (
  SELECT doc_id, 'body' AS field, query, cnt FROM (
    SELECT s.doc_id, q.query, {counter('s.body', 'q.query')} AS cnt
    FROM search_docs s, queries q) WHERE cnt > 0
)"""


MESSAGES = """messages AS (
  SELECT CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS msg_id,
         s.s_name || ' <' || lower(replace(s.s_name, '#', '.')) || '@' || lower(sn.n_name)
           || '.example>' AS "from",
         c.c_name || ' <' || lower(replace(c.c_name, '#', '.')) || '@' || lower(cn.n_name)
           || '.example>' AS comments_to,
         strftime(o.o_orderdate, '%a, %d %b %Y %H:%M:%S') || ' +0000' AS date_raw,
         o.o_orderpriority = '1-URGENT' AS is_target
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation sn ON s.s_nationkey = sn.n_nationkey
  JOIN nation cn ON c.c_nationkey = cn.n_nationkey
)"""
