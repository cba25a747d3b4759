"""DuckDB oracle SQL for the registered queries (same column names as the Spark side)."""

from __future__ import annotations

from lexiflow.plans import sqlfrag as Q

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql.strip()


# --- keyterm search -------------------------------------------------------------------

oracle("keyterm_hits", f"WITH {Q.hits_cte('token')} SELECT doc_id, field, query, cnt FROM hits")
oracle("keyterm_hits_padded",
       f"WITH {Q.hits_cte('padded')} SELECT doc_id, field, query, cnt FROM hits")
oracle("emails_per_query", f"""WITH {Q.hits_cte('token')}
SELECT query, count(DISTINCT doc_id) AS n_texts FROM hits GROUP BY query ORDER BY n_texts, query""")
oracle("prepare_queries", f"WITH {Q.QUERIES} SELECT query, n_tokens FROM queries")
oracle("query_profile", f"""WITH {Q.PROFILE}
SELECT has_digits, min_term_len, max_term_len, n_queries, keep_chars FROM profile""")
oracle("remove_text_without_query", f"""WITH {Q.hits_cte('token')}
SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM hits)""")
oracle("remove_query_without_text", f"""WITH {Q.hits_cte('token')}
SELECT query, n_tokens FROM queries WHERE query IN (SELECT query FROM hits)""")
oracle("text_lengths", f"""WITH {Q.SEARCH_DOCS}
SELECT doc_id, len({Q.tokens('body')}) AS n_tokens, length(body) AS n_chars FROM search_docs""")
oracle("target_set_table", f"""WITH {Q.hits_cte('token')}
SELECT d.doc_id, d.lang AS "msg-lang", d.source AS "msg-source", NULL::VARCHAR AS "msg-reply_to",
       len({Q.tokens('s.body')}) AS body_token_count, h.field, h.query, h.cnt
FROM documents d JOIN search_docs s ON s.doc_id = d.doc_id JOIN hits h ON h.doc_id = d.doc_id""")
oracle("target_headers", f"""WITH {Q.hits_cte('token')}
SELECT lang, source, NULL::VARCHAR AS reply_to FROM documents WHERE doc_id IN (SELECT doc_id FROM hits)""")
oracle("normalize_text", f"""
SELECT doc_id, {Q.clean('text', **Q.TRAIN_OPTS)} AS text_clean FROM documents""")
oracle("raw_keyword_matrix", f"""WITH {Q.RAW_QUERIES},
kw AS (SELECT DISTINCT query AS keyword FROM raw_q WHERE query <> '')
SELECT doc_id, keyword, cnt FROM (
  SELECT d.doc_id, k.keyword, {Q.substring_count('d.text', 'k.keyword')} AS cnt
  FROM documents d, kw k) WHERE cnt > 0""")
oracle("raw_keyword_matrix_pages", f"""WITH {Q.RAW_QUERIES},
kw AS (SELECT DISTINCT query AS keyword FROM raw_q WHERE query <> '')
SELECT doc_id, url, keyword, cnt FROM (
  SELECT d.page_id AS doc_id, d.url, k.keyword, {Q.substring_count('d.html', 'k.keyword')} AS cnt
  FROM pages d, kw k) WHERE cnt > 0""")


# --- corpora / n-grams --------------------------------------------------------------------

DEF = dict(min_len=2, max_len=15, keep=True, remove_numbers=True)


def cleaned(name: str, opts: dict, src: str = "documents", id_expr: str = "doc_id") -> str:
    return f"{name} AS (SELECT {id_expr} AS doc_id, {Q.clean('text', **opts)} AS text_clean FROM {src})"


def grams(name: str, src: str, n: int, col: str = "ngram") -> str:
    if n == 1:
        body = "unnest(tk)"
    else:
        body = (f"unnest(list_transform(range(1, len(tk) - {n} + 2), "
                f"lambda i: array_to_string(tk[i:i + {n - 1}], ' ')))")
    return (f"{name} AS (SELECT doc_id, {body} AS {col} FROM "
            f"(SELECT doc_id, {Q.tokens('lower(text_clean)')} AS tk FROM {src}))")


R_IDS = "r_ids AS (SELECT doc_id FROM labels WHERE quality = 1)"
FR_IDS = "fr_ids AS (SELECT doc_id FROM documents WHERE lang = 'fr')"
NG_BASE = ",\n".join([
    cleaned("docs_def", DEF), R_IDS, FR_IDS,
    "rdocs AS (SELECT * FROM docs_def WHERE doc_id IN (SELECT doc_id FROM r_ids))",
    "offdocs AS (SELECT * FROM docs_def WHERE doc_id IN (SELECT doc_id FROM fr_ids))",
    grams("rgrams", "rdocs", 2),
    "cand AS (SELECT ngram, count(*) AS freq FROM rgrams GROUP BY ngram HAVING count(*) >= 10)",
])

oracle("ngram_frequency", f"WITH {NG_BASE} SELECT ngram, freq FROM cand")
oracle("top_ngrams", f"""WITH {NG_BASE}
SELECT ngram, count(*) AS freq FROM rgrams GROUP BY ngram ORDER BY freq DESC, ngram LIMIT 50""")
oracle("ngrams", f"""WITH {NG_BASE}
SELECT doc_id, array_to_string(list_transform(range(1, len(tk) - 3 + 2),
         lambda i: array_to_string(tk[i:i + 2], ' ')), '|') AS trigrams
FROM (SELECT doc_id, {Q.tokens('text_clean')} AS tk FROM rdocs)""")
oracle("offtopic_filter", f"""WITH {NG_BASE}
SELECT ngram, freq FROM cand
WHERE NOT EXISTS (SELECT 1 FROM offdocs o WHERE contains(o.text_clean, cand.ngram))""")
oracle("offtopic_filter_any", f"""WITH {NG_BASE}
SELECT ngram, freq FROM cand
WHERE (SELECT count(*) FROM offdocs o WHERE contains(o.text_clean, cand.ngram))
      < (SELECT count(*) FROM offdocs)""")
oracle("ngram_difference", f"""WITH {NG_BASE}, {grams('offgrams', 'offdocs', 2)}
SELECT ngram, freq FROM cand WHERE ngram NOT IN (SELECT ngram FROM offgrams)""")
PASSAGE_BIGRAMS = f"""{NG_BASE}, {cleaned('items', DEF, 'benchmark', 'item_id')},
tk AS (SELECT doc_id AS item_id, {Q.tokens('text_clean')} AS w FROM items),
pl AS (SELECT item_id, w, unnest(range(0, len(w) - 1)) AS i FROM tk),
pg AS (SELECT item_id, i AS position, w[i + 1] || ' ' || w[i + 2] AS ngram FROM pl)"""
for _name, _columns in (("indices", "item_id"), ("places", "item_id, position")):
    oracle(f"ngram_difference_{_name}", f"""WITH {PASSAGE_BIGRAMS}
SELECT {_columns} FROM pg
WHERE NOT EXISTS (SELECT 1 FROM offdocs o WHERE contains(o.text_clean, pg.ngram))""")
oracle("verified_ngrams", f"""WITH {NG_BASE},
{cleaned('bench', DEF, 'benchmark', 'item_id')}, {grams('bgrams', 'bench', 2)}
SELECT ngram, freq FROM cand WHERE ngram IN (SELECT ngram FROM bgrams)""")

# --- document-term matrix -------------------------------------------------------------

TR = Q.TRAIN_OPTS


def dtm_ctes(prefix: str, src: str, n: int, min_df, max_df, n_docs_sql: str) -> str:
    lo = f"{min_df}" if isinstance(min_df, int) else f"{min_df} * ({n_docs_sql})"
    hi = f"{max_df}" if isinstance(max_df, int) else f"{max_df} * ({n_docs_sql})"
    return ",\n".join([
        grams(f"{prefix}_g", src, n, "term"),
        f"{prefix}_tc AS (SELECT doc_id, term, count(*) AS cnt FROM {prefix}_g GROUP BY doc_id, term)",
        f"{prefix}_df AS (SELECT term, count(*) AS df FROM {prefix}_tc GROUP BY term)",
        f"{prefix} AS (SELECT doc_id, term, cnt FROM {prefix}_tc WHERE term IN "
        f"(SELECT term FROM {prefix}_df WHERE df >= {lo} AND df <= {hi}))",
    ])


N_DOCS = "SELECT count(*) FROM documents"
DTM_BASE = ",\n".join([
    cleaned("docs_tr", TR), R_IDS,
    "sdocs AS (SELECT * FROM docs_tr WHERE doc_id NOT IN (SELECT doc_id FROM r_ids))",
    dtm_ctes("dtm", "docs_tr", 2, 2, 0.9, N_DOCS),
    dtm_ctes("svoc", "sdocs", 2, 10, 1.0, "SELECT count(*) FROM sdocs"),
])

oracle("doc_term_matrix", f"WITH {DTM_BASE} SELECT doc_id, term, cnt FROM dtm")
oracle("doc_term_matrix_vocab", f"""WITH {DTM_BASE}
SELECT doc_id, term, cnt FROM svoc_tc WHERE term IN (SELECT term FROM svoc)""")
oracle("dtm_subset", f"""WITH {DTM_BASE}
SELECT doc_id, term, cnt FROM dtm WHERE doc_id IN (SELECT doc_id FROM r_ids)""")
oracle("doc_counts", f"""WITH {DTM_BASE}, {dtm_ctes('fullm', 'docs_tr', 2, 1, 1.0, N_DOCS)},
agg AS (SELECT term, count(*) AS df,
               count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM r_ids)) AS df_target
        FROM fullm GROUP BY term)
SELECT v.term, coalesce(a.df, 0) AS df, coalesce(a.df_target, 0) AS df_target
FROM (SELECT DISTINCT term FROM svoc) v LEFT JOIN agg a ON v.term = a.term""")
oracle("term_frequency_corpus", f"""WITH {DTM_BASE}
SELECT term, sum(cnt) / (SELECT sum(cnt) FROM dtm) AS p_cor FROM dtm GROUP BY term""")
oracle("term_frequency_document", f"""WITH {DTM_BASE}
SELECT doc_id, term, cnt / sum(cnt) OVER (PARTITION BY doc_id) AS p_doc FROM dtm""")
oracle("idf", f"""WITH {DTM_BASE}
SELECT term, ln(({N_DOCS}) / (count(DISTINCT doc_id) + 1)) + 1 AS idf FROM dtm GROUP BY term""")

TFIDF = DTM_BASE + ",\n" + dtm_ctes("uni", "docs_tr", 1, 3, 0.95, N_DOCS) + f""",
uni_idf AS (SELECT term, ln((1.0 + ({N_DOCS})) / (count(*) + 1)) + 1 AS idf FROM uni GROUP BY term),
uni_w AS (SELECT u.doc_id, u.term, u.cnt * i.idf AS w FROM uni u JOIN uni_idf i ON u.term = i.term),
tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM uni_w)"""
oracle("tfidf", f"WITH {TFIDF} SELECT doc_id, term, weight FROM tfidf")

# --- ranking ----------------------------------------------------------------------------------

KL_BASE = Q.hits_cte("token") + ",\n" + cleaned("docs_tr", TR) + ",\n" + \
    dtm_ctes("m", "docs_tr", 2, 1, 0.9, N_DOCS) + """,
hit_ids AS (SELECT DISTINCT doc_id FROM hits),
cor_all AS (SELECT term, sum(cnt) AS n_cor, sum(cnt) / (SELECT sum(cnt) FROM m) AS p_cor
            FROM m GROUP BY term),
sub AS (SELECT term, sum(cnt) / (SELECT sum(cnt) FROM m WHERE doc_id IN (SELECT doc_id FROM hit_ids))
          AS p_sub FROM m WHERE doc_id IN (SELECT doc_id FROM hit_ids) GROUP BY term)"""
oracle("kl_terms", f"""WITH {KL_BASE},
cor AS (SELECT * FROM cor_all ORDER BY n_cor DESC, term LIMIT 5000),
j AS (SELECT c.term, 0.5 * coalesce(s.p_sub, 0.0) + 0.5 * c.p_cor AS p, c.p_cor
      FROM cor c LEFT JOIN sub s ON c.term = s.term)
SELECT term, p * log2(p / p_cor) AS score FROM j ORDER BY score DESC, term LIMIT 50""")
oracle("weighted_zone_score", f"""WITH {KL_BASE}
SELECT c.term, 0.7 * coalesce(s.p_sub, 0.0) + (1.0 - 0.7) * c.p_cor AS score
FROM cor_all c LEFT JOIN sub s ON c.term = s.term""")

RANK_BASE = TFIDF + ",\n" + Q.QUERIES + f""",
qterms AS (SELECT DISTINCT unnest({Q.tokens('query')}) AS term FROM queries),
lens AS (SELECT doc_id, len({Q.tokens('text_clean')}) AS n_tokens FROM docs_tr)"""
oracle("rank_tfidf_overlap", f"""WITH {RANK_BASE}
SELECT t.doc_id, sum(t.weight) / any_value(l.n_tokens) AS score
FROM tfidf t JOIN lens l ON t.doc_id = l.doc_id
WHERE t.term IN (SELECT term FROM qterms) GROUP BY t.doc_id""")
oracle("rank_cosine", f"""WITH {RANK_BASE},
qt AS (SELECT query, term, count(*) AS cnt
       FROM (SELECT query, unnest({Q.tokens('query')}) AS term FROM queries) GROUP BY query, term),
qw AS (SELECT qt.query, qt.term, qt.cnt * i.idf AS weight FROM qt JOIN uni_idf i ON qt.term = i.term),
dn AS (SELECT doc_id, sqrt(sum(weight * weight)) AS dn FROM tfidf GROUP BY doc_id),
qn AS (SELECT query, sqrt(sum(weight * weight)) AS qn FROM qw GROUP BY query),
dot AS (SELECT q.query, t.doc_id, sum(t.weight * q.weight) AS dot
        FROM tfidf t JOIN qw q ON t.term = q.term GROUP BY q.query, t.doc_id)
SELECT d.query, d.doc_id, d.dot / (dn.dn * qn.qn) AS score
FROM dot d JOIN dn ON d.doc_id = dn.doc_id JOIN qn ON d.query = qn.query
QUALIFY row_number() OVER (PARTITION BY d.query ORDER BY round(d.dot / (dn.dn * qn.qn), 9) DESC, d.doc_id) <= 50""")


# --- actors ------------------------------------------------------------------------------------

from lexiflow.functions.mail import ADDRESS_RE, NAME_RE, WEEKDAY_RE, YEAR_RE  # noqa: E402
from lexiflow.sources.tables import HOST_RE  # noqa: E402

_SENT_AT = (f"try_strptime(trim(regexp_replace(date_raw, {Q.lit(WEEKDAY_RE)}, '')), "
            f"'%d %b %Y %H:%M:%S %z')")
PARSED = Q.MESSAGES + f""",
parsed AS (
  SELECT *,
    CASE WHEN regexp_extract("from", {Q.lit(ADDRESS_RE)}, 1) <> ''
          AND regexp_extract("from", {Q.lit(ADDRESS_RE)}, 2) <> ''
         THEN regexp_extract("from", {Q.lit(ADDRESS_RE)}, 1) || '@'
              || lower(regexp_extract("from", {Q.lit(ADDRESS_RE)}, 2)) END AS sender_email,
    nullif(lower(regexp_extract("from", {Q.lit(ADDRESS_RE)}, 2)), '') AS sender_domain,
    nullif(lower(regexp_extract(comments_to, {Q.lit(ADDRESS_RE)}, 2)), '') AS receiver_domain,
    {_SENT_AT} AS sent_at,
    CASE WHEN {_SENT_AT} IS NOT NULL AND regexp_extract(date_raw, {Q.lit(YEAR_RE)}, 1) <> ''
         THEN CAST(regexp_extract(date_raw, {Q.lit(YEAR_RE)}, 1) AS INTEGER) END AS sent_year
  FROM messages
)"""

ORG = """org_raw AS (
  SELECT CAST(n.n_nationkey AS INTEGER) AS row_no, ' ' || n.n_name || ' ' AS name,
         n.n_name || ' org' AS full_name, n.n_name AS nationality, r.r_name AS category,
         lower(r.r_name) AS stakeholdergroup,
         lower(n.n_name) || '.example, mail.' || lower(n.n_name) || '.example' AS email_domains,
         CASE WHEN min(n.n_name) OVER (PARTITION BY n.n_regionkey) <> n.n_name
              THEN min(n.n_name) OVER (PARTITION BY n.n_regionkey) END AS subsidiary_of
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
),
org_t AS (
  SELECT row_no, trim(name) AS name, trim(full_name) AS full_name, trim(nationality) AS nationality,
         trim(category) AS category, trim(stakeholdergroup) AS stakeholdergroup,
         trim(email_domains) AS email_domains, trim(subsidiary_of) AS subsidiary_of
  FROM org_raw
),
parents AS (SELECT name AS pname, any_value(nationality) AS pnat FROM org_t GROUP BY name HAVING count(*) = 1),
org_p AS (
  SELECT o.row_no, o.name, o.full_name,
         CASE WHEN p.pname IS NOT NULL THEN p.pnat ELSE o.nationality END AS nationality,
         o.category, o.stakeholdergroup, o.email_domains, o.subsidiary_of
  FROM org_t o LEFT JOIN parents p ON o.subsidiary_of = p.pname
),
org_dim AS (
  SELECT row_no, name, full_name, nationality, category, stakeholdergroup, subsidiary_of,
         CAST(generate_subscripts(string_split(email_domains, ','), 1) - 1 AS INTEGER) AS domain_pos,
         lower(trim(unnest(string_split(email_domains, ',')))) AS domain
  FROM org_p
),
cat_x AS (
  SELECT row_no, domain_pos, domain,
         generate_subscripts(string_split(category, ','), 1) AS cat_pos,
         trim(unnest(string_split(category, ','))) AS category
  FROM org_dim WHERE category IS NOT NULL AND domain IS NOT NULL
),
cat_dim AS (
  SELECT domain, category FROM (
    SELECT domain, category, row_number() OVER (PARTITION BY domain ORDER BY row_no, domain_pos, cat_pos) AS rn
    FROM cat_x WHERE category IS NOT NULL) WHERE rn = 1
),
nat_dim AS (
  SELECT domain, nationality FROM (
    SELECT domain, nationality, row_number() OVER (PARTITION BY domain ORDER BY row_no, domain_pos) AS rn
    FROM org_dim WHERE full_name IS NOT NULL AND nationality IS NOT NULL AND domain IS NOT NULL) WHERE rn = 1
),
shg_dim AS (
  SELECT domain, stakeholdergroup FROM (
    SELECT domain, stakeholdergroup, row_number() OVER (PARTITION BY domain ORDER BY row_no, domain_pos) AS rn
    FROM org_dim WHERE stakeholdergroup IS NOT NULL AND domain IS NOT NULL) WHERE rn = 1
)"""

ENRICHED = PARSED + ",\n" + ORG + """,
enriched AS (
  SELECT p.*, coalesce(trim(c.category), 'Unknown') AS from_category,
         coalesce(trim(s.stakeholdergroup), 'Unknown') AS from_stakeholdergroup,
         coalesce(trim(n.nationality), 'Unknown') AS from_nationality
  FROM parsed p LEFT JOIN cat_dim c ON p.sender_domain = c.domain
  LEFT JOIN shg_dim s ON p.sender_domain = s.domain
  LEFT JOIN nat_dim n ON p.sender_domain = n.domain
),
yrs AS (SELECT min(sent_year) AS lo, max(sent_year) AS hi FROM parsed WHERE sent_at IS NOT NULL),
year_list AS (SELECT CAST(generate_series AS INTEGER) AS year
              FROM generate_series((SELECT lo FROM yrs), (SELECT hi FROM yrs)))"""


def yearly_sql(group_col: str) -> str:
    return f"""WITH {ENRICHED},
grps AS (SELECT DISTINCT {group_col} AS grp FROM enriched),
cnt AS (SELECT {group_col} AS grp, sent_year AS year, count(*) AS n FROM enriched
        WHERE sent_year BETWEEN (SELECT lo FROM yrs) AND (SELECT hi FROM yrs) GROUP BY ALL),
yearly AS (SELECT g.grp, y.year, coalesce(c.n, 0) AS n FROM grps g CROSS JOIN year_list y
           LEFT JOIN cnt c ON c.grp IS NOT DISTINCT FROM g.grp AND c.year = y.year)"""


oracle("parse_address", f"""WITH {Q.MESSAGES}
SELECT msg_id, nullif(trim(regexp_extract("from", {Q.lit(NAME_RE)}, 1)), '') AS sender_name,
       nullif(regexp_extract("from", {Q.lit(ADDRESS_RE)}, 1), '') AS sender_local,
       nullif(lower(regexp_extract("from", {Q.lit(ADDRESS_RE)}, 2)), '') AS sender_domain
FROM messages""")
oracle("parse_mail_date", f"""WITH {PARSED}
SELECT msg_id, CAST(epoch(sent_at) AS BIGINT) AS sent_epoch, sent_year FROM parsed""")
oracle("messages_per_address", f"""WITH {PARSED}
SELECT sender_email AS email, count(*) AS n FROM parsed WHERE sender_email IS NOT NULL
GROUP BY sender_email ORDER BY n DESC, email""")
oracle("member_totals", f"""WITH {PARSED}
SELECT count(*) AS n_messages, count(sender_email) AS n_attributed,
       count(DISTINCT sender_email) AS n_members, count(*) FILTER (WHERE sender_email IS NULL) AS n_unparsable
FROM parsed""")
oracle("most_active_members", f"""WITH {PARSED},
pm AS (SELECT sender_email AS email, count(*) AS n FROM parsed WHERE sender_email IS NOT NULL GROUP BY ALL)
SELECT email, n FROM pm WHERE n > CAST(floor((SELECT quantile_cont(n, 0.9) FROM pm)) AS BIGINT)""")
oracle("messages_per_domain", f"""WITH {PARSED}
SELECT sender_domain AS domain, count(*) AS n FROM parsed WHERE sender_domain IS NOT NULL
GROUP BY ALL ORDER BY n, domain""")
oracle("distinct_domains", f"""WITH {PARSED}
SELECT count(DISTINCT domain) AS n_domains FROM (
  SELECT sender_domain AS domain FROM parsed UNION ALL SELECT receiver_domain FROM parsed)""")
oracle("domain_year_counts", f"""WITH {PARSED}
SELECT sender_domain AS domain, sent_year AS year, count(*) AS n FROM parsed
WHERE sender_domain IS NOT NULL AND sent_year IS NOT NULL GROUP BY ALL""")
oracle("activity_period", f"""WITH {PARSED}
SELECT CAST(epoch(min(sent_at)) AS BIGINT) AS first_epoch, CAST(epoch(max(sent_at)) AS BIGINT) AS last_epoch,
       min(sent_year) AS first_year, max(sent_year) AS last_year
FROM parsed WHERE sent_at IS NOT NULL""")
oracle("crop_by_year", f"""WITH {PARSED}
SELECT msg_id, sent_year FROM parsed WHERE sent_year >= 1996 AND sent_year < 1999""")
oracle("crop_by_domain", f"""WITH {PARSED}
SELECT msg_id, sender_domain FROM parsed WHERE sender_domain IN ('nation_1.example', 'nation_2.example')""")
oracle("trim_all", f"WITH {ORG} SELECT * FROM org_t")
oracle("expand_multi_entries", f"""WITH {ORG}
SELECT row_no, CAST(generate_subscripts(string_split(email_domains, ','), 1) - 1 AS INTEGER) AS domain_pos,
       trim(unnest(string_split(email_domains, ','))) AS email_domains FROM org_t""")
oracle("parent_nationality", f"WITH {ORG} SELECT row_no, name, nationality FROM org_p")
oracle("dropna_subset", f"""WITH {ORG}
SELECT row_no, name, subsidiary_of FROM org_t WHERE subsidiary_of IS NOT NULL""")
oracle("dropna_any", f"""WITH {ORG}
SELECT full_name, nationality, subsidiary_of FROM org_t
WHERE full_name IS NOT NULL AND nationality IS NOT NULL AND subsidiary_of IS NOT NULL""")
oracle("org_dimension", f"""WITH {ORG}
SELECT row_no, domain_pos, domain, name, nationality, category, stakeholdergroup FROM org_dim""")
oracle("map_labels", f"""WITH {ORG}
SELECT d.row_no, d.domain_pos, r.r_name AS nationality
FROM org_dim d LEFT JOIN nation n ON d.nationality = n.n_name LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
oracle("enrich_category", f"WITH {ENRICHED} SELECT msg_id, from_category FROM enriched")
oracle("enrich_stakeholder", f"WITH {ENRICHED} SELECT msg_id, from_stakeholdergroup FROM enriched")
oracle("enrich_nationality", f"WITH {ENRICHED} SELECT msg_id, from_nationality FROM enriched")
oracle("yearly_counts_category", yearly_sql("from_category") + " SELECT grp, year, n FROM yearly")
oracle("yearly_counts_stakeholder", yearly_sql("from_stakeholdergroup") + " SELECT grp, year, n FROM yearly")
oracle("yearly_counts_nation", yearly_sql("from_nationality") + " SELECT grp, year, n FROM yearly")
TARGET_YEARLY = f"""WITH {ENRICHED},
ct AS (SELECT sent_year AS year, count(*) AS n FROM parsed WHERE is_target
       AND sent_year BETWEEN (SELECT lo FROM yrs) AND (SELECT hi FROM yrs) GROUP BY ALL),
ca AS (SELECT sent_year AS year, count(*) AS n FROM parsed
       WHERE sent_year BETWEEN (SELECT lo FROM yrs) AND (SELECT hi FROM yrs) GROUP BY ALL),
yt AS (SELECT y.year, coalesce(ct.n, 0) AS n FROM year_list y LEFT JOIN ct ON y.year = ct.year),
ya AS (SELECT y.year, coalesce(ca.n, 0) AS n FROM year_list y LEFT JOIN ca ON y.year = ca.year)"""
oracle("yearly_counts_target", TARGET_YEARLY + " SELECT year, n FROM yt")
oracle("target_share", TARGET_YEARLY + """
SELECT yt.year, yt.n AS n_t, ya.n AS n_s, CASE WHEN ya.n <> 0 THEN yt.n / ya.n END - 1 AS share
FROM yt JOIN ya ON yt.year = ya.year""")
oracle("group_totals", yearly_sql("from_nationality") + """
SELECT grp, sum(n) AS total FROM yearly GROUP BY grp ORDER BY total, grp""")
oracle("rank_by_last_year", yearly_sql("from_category") + """
SELECT grp, n AS n_last, row_number() OVER (ORDER BY n, grp) AS rank
FROM yearly WHERE year = (SELECT max(year) FROM yearly)""")
oracle("stacked_bands", yearly_sql("from_category") + """,
lastn AS (SELECT grp, n AS n_last FROM yearly WHERE year = (SELECT max(year) FROM yearly))
SELECT y.grp, y.year, y.n,
       sum(y.n) OVER w - y.n AS lower, sum(y.n) OVER w AS upper
FROM yearly y JOIN lastn l ON y.grp IS NOT DISTINCT FROM l.grp
WINDOW w AS (PARTITION BY y.year ORDER BY l.n_last, y.grp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
oracle("split_by_target_set", f"""WITH {Q.hits_cte('token')}
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM hits) THEN 'target' ELSE 'search' END AS side
FROM documents""")
oracle("select_by_id", """
SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
oracle("corpus_union", """WITH r AS (SELECT doc_id, text FROM documents
                                      WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
s AS (SELECT doc_id, text FROM documents WHERE lang = 'en')
SELECT doc_id, 'R' AS origin, length(text) AS n_chars FROM r WHERE doc_id NOT IN (SELECT doc_id FROM s)
UNION ALL SELECT doc_id, 'S', length(text) FROM s""")

# --- threads, pages ---------------------------------------------------------------------------

THREADS = """threads AS (
  SELECT conv_id AS msg_id,
         coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role <> 'system'), '') AS body,
         coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'system'), '') AS attachment,
         count(*) FILTER (WHERE role = 'system') AS n_att
  FROM conversations GROUP BY conv_id
)"""
oracle("attachment_text", f"WITH {THREADS} SELECT msg_id, attachment FROM threads")
oracle("messages_with_attachment", f"WITH {THREADS} SELECT msg_id FROM threads WHERE n_att > 0")
oracle("keyterm_hits_fields", f"""WITH {Q.PROFILE}, {THREADS},
tclean AS (SELECT t.msg_id, {Q.search_clean('t.body')} AS body, {Q.search_clean('t.attachment')} AS attachment
           FROM threads t, profile p),
f AS (SELECT msg_id, 'body' AS field, body AS txt FROM tclean
      UNION ALL SELECT msg_id, 'attachment', attachment FROM tclean)
SELECT msg_id, field, query, cnt FROM (
  SELECT f.msg_id, f.field, q.query, {Q.token_count('f.txt', 'q.query')} AS cnt FROM f, queries q)
WHERE cnt > 0""")
oracle("pages_source", """
SELECT url, length(lower(coalesce(html, ''))) AS n_chars, md5(lower(coalesce(html, ''))) AS text_md5 FROM pages""")
oracle("document_name", f"""
SELECT page_id, string_split(regexp_extract(url, {Q.lit(HOST_RE)}, 1), '.')[2] AS doc_name,
       string_split(url, '/')[-1] AS last_segment FROM pages""")
oracle("assemble_pages", """
SELECT conv_id AS doc_id,
       md5(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role <> 'system'), '')) AS text_md5,
       count(*) FILTER (WHERE role <> 'system') AS n_read, count(*) AS n_total
FROM conversations GROUP BY conv_id""")

# --- graphs -------------------------------------------------------------------------------------

GRAPHS = ENRICHED + """,
dg AS (SELECT sender_domain AS src, receiver_domain AS dst, count(*) AS weight FROM parsed
       WHERE sender_domain IS NOT NULL AND receiver_domain IS NOT NULL GROUP BY ALL),
tg AS (SELECT sender_domain AS src, receiver_domain AS dst, count(*) AS weight FROM parsed
       WHERE is_target AND sender_domain IS NOT NULL AND receiver_domain IS NOT NULL GROUP BY ALL),
fg AS (SELECT src, dst, weight FROM tg WHERE cbrt(weight) >=
         (SELECT min(t) FROM (SELECT cbrt(weight) AS t FROM tg ORDER BY t DESC LIMIT 20))),
per AS (SELECT *, CASE WHEN sent_year >= 1995 AND sent_year < 1998 THEN '1995-1998'
                       WHEN sent_year >= 1998 AND sent_year < 2002 THEN '1998-2002' END AS period
        FROM parsed),
pg AS (SELECT period, sender_domain AS src, receiver_domain AS dst, count(*) AS weight FROM per
       WHERE period IS NOT NULL AND sender_domain IS NOT NULL AND receiver_domain IS NOT NULL GROUP BY ALL),
cpg AS (SELECT t.period, cs.category AS src, cd.category AS dst, sum(t.weight) AS weight
        FROM (SELECT period, sender_domain AS src, receiver_domain AS dst, count(*) AS weight FROM per
              WHERE is_target AND period IS NOT NULL AND sender_domain IS NOT NULL
                AND receiver_domain IS NOT NULL GROUP BY ALL) t
        JOIN cat_dim cs ON t.src = cs.domain JOIN cat_dim cd ON t.dst = cd.domain GROUP BY ALL),
fn AS (SELECT src AS node FROM fg UNION SELECT dst FROM fg)"""


def degree_sql(edges: str) -> str:
    return f"""SELECT node, count(*) / ((SELECT count(*) FROM (SELECT src AS node FROM {edges}
                 UNION SELECT dst FROM {edges})) - 1) AS centrality
FROM (SELECT src AS node FROM {edges} UNION ALL SELECT dst FROM {edges}) GROUP BY node"""


def paths_sql(edges: str) -> str:
    """Distances and numbers of shortest paths of a whole edge table; pn = its nodes."""
    return f""",
pn AS (SELECT src AS node FROM {edges} UNION SELECT dst FROM {edges}),
pe AS (SELECT DISTINCT src, dst FROM {edges} WHERE src <> dst),
reach(s, v, d) AS (SELECT node, node, 0 FROM pn
                   UNION SELECT r.s, e.dst, r.d + 1 FROM reach r JOIN pe e ON r.v = e.src
                   WHERE r.d < (SELECT count(*) FROM pn)),
dist AS (SELECT s, v, min(d) AS d FROM reach GROUP BY s, v),
sp(s, v, d) AS (SELECT node, node, 0 FROM pn
                UNION ALL SELECT p.s, e.dst, p.d + 1 FROM sp p JOIN pe e ON p.v = e.src
                JOIN dist t ON t.s = p.s AND t.v = e.dst AND t.d = p.d + 1),
sigma AS (SELECT s, v, any_value(d) AS d, count(*) AS sg FROM sp GROUP BY s, v)"""


def closeness_sql(edges: str) -> str:
    return f"""{paths_sql(edges)}
SELECT v AS node, CASE WHEN sum(d) > 0 THEN ((count(*) - 1) / sum(d)) * ((count(*) - 1) /
       ((SELECT count(*) FROM pn) - 1)) ELSE 0.0 END AS centrality
FROM dist GROUP BY v"""


def betweenness_sql(edges: str) -> str:
    return f"""{paths_sql(edges)},
pairs AS (SELECT a.v AS node, a.sg * b.sg / c.sg AS part
          FROM sigma a JOIN sigma b ON a.v = b.s JOIN sigma c ON c.s = a.s AND c.v = b.v
          WHERE a.s <> a.v AND b.v <> b.s AND a.s <> b.v AND a.d + b.d = c.d)
SELECT pn.node, coalesce(sum(pairs.part), 0.0) * (CASE WHEN (SELECT count(*) FROM pn) > 2
       THEN 1.0 / (((SELECT count(*) FROM pn) - 1) * ((SELECT count(*) FROM pn) - 2)) ELSE 1.0 END) AS centrality
FROM pn LEFT JOIN pairs ON pn.node = pairs.node GROUP BY pn.node"""


# target messages of the second period, contracted by category and by nationality
CONTRACTED = """,
c2 AS (SELECT src, dst, weight FROM cpg WHERE period = '1998-2002'),
n2 AS (SELECT cs.nationality AS src, cd.nationality AS dst, sum(t.weight) AS weight
       FROM (SELECT sender_domain AS src, receiver_domain AS dst, count(*) AS weight FROM per
             WHERE is_target AND period = '1998-2002' AND sender_domain IS NOT NULL
               AND receiver_domain IS NOT NULL GROUP BY ALL) t
       JOIN nat_dim cs ON t.src = cs.domain JOIN nat_dim cd ON t.dst = cd.domain GROUP BY ALL)"""

oracle("domain_digraph", f"WITH {GRAPHS} SELECT src, dst, weight FROM dg")
oracle("contracted_digraph", f"""WITH {GRAPHS}
SELECT cs.category AS src, cd.category AS dst, sum(dg.weight) AS weight
FROM dg JOIN cat_dim cs ON dg.src = cs.domain JOIN cat_dim cd ON dg.dst = cd.domain GROUP BY ALL""")
oracle("digraph_by_period", f"WITH {GRAPHS} SELECT period, src, dst, weight FROM pg")
oracle("degree_centrality", f"WITH {GRAPHS} {degree_sql('tg')}")
for _kind, _edges in (("contracted", "c2"), ("nation", "n2")):
    oracle(f"{_kind}_degree_centrality", f"WITH {GRAPHS} {CONTRACTED} {degree_sql(_edges)}")
    oracle(f"{_kind}_closeness_centrality", f"WITH RECURSIVE {GRAPHS} {CONTRACTED} {closeness_sql(_edges)}")
    oracle(f"{_kind}_betweenness_centrality", f"WITH RECURSIVE {GRAPHS} {CONTRACTED} {betweenness_sql(_edges)}")
oracle("closeness_centrality", f"WITH RECURSIVE {GRAPHS} {closeness_sql('tg')}")
oracle("betweenness_centrality", f"WITH RECURSIVE {GRAPHS} {betweenness_sql('tg')}")
oracle("out_edges", f"""WITH {GRAPHS},
tn AS (SELECT src AS node FROM tg UNION SELECT dst FROM tg)
SELECT tn.node, count(tg.src) AS n_out FROM tn LEFT JOIN tg ON tn.node = tg.src GROUP BY tn.node""")
oracle("reciprocal_edges", f"""WITH {GRAPHS}
SELECT a.src, a.dst, a.weight, b.src IS NOT NULL AS reciprocal
FROM tg a LEFT JOIN tg b ON a.src = b.dst AND a.dst = b.src""")
oracle("foreground_edges", f"""WITH {GRAPHS},
t AS (SELECT *, cbrt(weight) AS thickness FROM pg),
thr AS (SELECT period, min(thickness) AS thr FROM (
          SELECT period, thickness, row_number() OVER (PARTITION BY period ORDER BY thickness DESC) AS rn FROM t)
        WHERE rn <= 20 GROUP BY period)
SELECT t.period, t.src, t.dst, t.weight, t.thickness, t.thickness >= thr.thr AS foreground
FROM t JOIN thr ON t.period = thr.period""")
oracle("induced_subgraph", f"""WITH {GRAPHS}
SELECT src, dst, weight FROM tg WHERE src IN (SELECT node FROM fn) AND dst IN (SELECT node FROM fn)""")
oracle("edge_thickness", f"WITH {GRAPHS} SELECT period, src, dst, weight, cbrt(weight) AS thickness FROM cpg")
oracle("node_weight", f"""WITH {GRAPHS}
SELECT node, sum(weight) AS node_weight FROM (SELECT src AS node, weight FROM dg
  UNION ALL SELECT dst, weight FROM dg) GROUP BY node""")
oracle("edge_weight_limits", f"""WITH {GRAPHS}
SELECT min(weight) AS w_min, max(weight) AS w_max, cbrt(min(weight)) AS t_min, cbrt(max(weight)) AS t_max FROM cpg""")
oracle("edges_of_node", f"""WITH {GRAPHS}
SELECT src, dst, weight FROM tg WHERE src = (SELECT min(src) FROM fg) OR dst = (SELECT min(src) FROM fg)""")
oracle("edges_excluding", f"""WITH {GRAPHS}
SELECT src, dst, weight FROM tg WHERE (src, dst) NOT IN (SELECT (src, dst) FROM fg)""")


# --- keyword discovery ----------------------------------------------------------------------

DISC = ",\n".join([
    cleaned("docs_tr", TR), R_IDS,
    "rdocs AS (SELECT * FROM docs_tr WHERE doc_id IN (SELECT doc_id FROM r_ids))",
    "sdocs AS (SELECT * FROM docs_tr WHERE doc_id NOT IN (SELECT doc_id FROM r_ids))",
    """r_train AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (
         ORDER BY md5('12345:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM rdocs)
       WHERE rn <= (SELECT CAST(round(count(*) * 1.0) AS BIGINT) FROM rdocs))""",
    """s_train AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (
         ORDER BY md5('12345:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM sdocs)
       WHERE rn <= (SELECT CAST(floor(count(*) * 0.33) AS BIGINT) FROM sdocs))""",
    "train AS (SELECT doc_id, 0 AS label FROM r_train UNION ALL SELECT doc_id, 1 FROM s_train)",
    dtm_ctes("cm", "docs_tr", 2, 1, 1.0, N_DOCS),
    """tc AS (SELECT term, sum(CASE WHEN label = 0 THEN cnt ELSE 0 END) AS n0,
                  sum(CASE WHEN label = 1 THEN cnt ELSE 0 END) AS n1
           FROM cm JOIN train USING (doc_id) GROUP BY term)""",
    """nbp AS (SELECT (SELECT count(DISTINCT term) FROM cm) AS v,
                   (SELECT sum(n0) FROM tc) AS big0, (SELECT sum(n1) FROM tc) AS big1,
                   (SELECT count(*) FROM train WHERE label = 0) AS c0,
                   (SELECT count(*) FROM train WHERE label = 1) AS c1,
                   (SELECT count(*) FROM train) AS n)""",
    """nbs AS (SELECT d.doc_id, coalesce(sum(cm.cnt * ln(coalesce(tc.n0, 0) + 1.0)), 0) AS a0,
                   coalesce(sum(cm.cnt * ln(coalesce(tc.n1, 0) + 1.0)), 0) AS a1,
                   coalesce(sum(cm.cnt), 0) AS len
            FROM sdocs d LEFT JOIN cm ON d.doc_id = cm.doc_id LEFT JOIN tc ON cm.term = tc.term
            GROUP BY d.doc_id)""",
    """votes AS (SELECT s.doc_id, CASE WHEN ln(p.c1 / p.n) + s.a1 - s.len * ln(p.big1 + p.v)
                                      > ln(p.c0 / p.n) + s.a0 - s.len * ln(p.big0 + p.v)
                                 THEN 0 ELSE 1 END AS vote FROM nbs s, nbp p)""",
    "tset AS (SELECT doc_id FROM votes WHERE vote >= 1)",
    dtm_ctes("sm", "sdocs", 2, 10, 1.0, "SELECT count(*) FROM sdocs"),
    """kdc AS (SELECT term, count(*) AS df_s,
                   count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM tset)) AS n_t FROM sm GROUP BY term)""",
    """kp AS (SELECT greatest((SELECT count(*) FROM tset), 1) AS nt,
                  (SELECT count(*) FROM sdocs) - (SELECT count(*) FROM tset) AS nst)""",
    """stats AS (
      SELECT term, n_t, df_s - n_t AS n_st,
             CAST(n_t AS DOUBLE) * 100.0 / kp.nt AS p_t,
             CASE WHEN kp.nst <> 0 THEN CAST(df_s - n_t AS DOUBLE) * 100.0 / kp.nst END AS p_st,
             lgamma(n_t + 1) + lgamma(df_s - n_t + 1) - lgamma(df_s + 2)
             + lgamma(kp.nt - n_t + 1) + lgamma(kp.nst - (df_s - n_t) + 1)
             - lgamma(kp.nt - n_t + kp.nst - (df_s - n_t) + 2) AS ll
      FROM kdc, kp WHERE (SELECT count(*) FROM tset) > 0)""",
    """klr AS (SELECT *, CASE WHEN p_st > p_t THEN 'S\\T' ELSE 'T' END AS category FROM stats)""",
])

oracle("training_split", f"""WITH {DISC}
SELECT doc_id, label, 'train' AS split FROM train
UNION ALL SELECT doc_id, NULL, 'test' FROM sdocs""")
oracle("vote_naive_bayes", f"WITH {DISC} SELECT doc_id, vote FROM votes")
oracle("vote_counts", f"WITH {DISC} SELECT doc_id, vote AS votes FROM votes")
oracle("vote_target_set", f"WITH {DISC} SELECT doc_id, vote >= 1 AS in_target FROM votes")
oracle("klr_keywords_nb", f"""WITH {DISC}
SELECT term, n_t, n_st, p_t, p_st, ll, category FROM klr ORDER BY ll DESC, term""")
oracle("klr_top_keywords", f"""WITH {DISC}
SELECT term, n_t, n_st, p_t, p_st, ll, category FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY ll DESC, term) AS rn FROM klr)
WHERE rn <= 1000""")


# --- sources and sinks -----------------------------------------------------------------------

oracle("documents_roundtrip", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, length(text) AS n_chars, md5(text) AS text_md5 FROM documents""")
oracle("target_set_roundtrip", f"WITH {Q.hits_cte('token')} SELECT doc_id, field, query, cnt FROM hits")
oracle("sink_csv", f"""WITH {PARSED}
SELECT sender_domain AS domain, count(*) AS n FROM parsed WHERE sender_domain IS NOT NULL GROUP BY ALL""")
oracle("domain_year_counts_json", f"""WITH {PARSED}
SELECT sender_domain AS domain, count(*) AS n, sent_year AS year FROM parsed
WHERE sender_domain IS NOT NULL AND sent_year IS NOT NULL GROUP BY ALL""")
oracle("line_list_roundtrip", """
SELECT DISTINCT regexp_replace(unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')), '[\\s\\x0b\\x1c-\\x1f]+$', '') AS line
FROM benchmark""")

oracle("load_queries", f"""WITH {Q.RAW_QUERIES}
SELECT DISTINCT regexp_replace(query, '\\s+$', '') AS query FROM (
  SELECT query FROM raw_q UNION ALL SELECT unnest(string_split(text, chr(10))) FROM benchmark)""")
for _name in ("scan_stopwords", "scan_stopwords_all_words"):
    oracle(_name, f"""SELECT DISTINCT w AS word FROM (
  SELECT unnest({Q.tokens('lower(text)')}) AS w FROM documents) WHERE w <> ''""")
oracle("scan_documents", """
SELECT count(*) AS n_docs, sum(length(text) + 1)::BIGINT AS n_chars FROM benchmark""")
oracle("scan_documents_texts", """
SELECT CAST(item_id AS VARCHAR) AS doc_id, length(text) + 1 AS n_chars, md5(text || chr(10)) AS text_md5 FROM benchmark""")
oracle("document_files", """
SELECT name, row_number() OVER (ORDER BY name) - 1 AS file_index, text_md5
FROM (SELECT concat_ws('-', source, doc_id) AS name, md5(coalesce(text, '')) AS text_md5 FROM documents)""")
oracle("scan_mixed_documents", """
SELECT 'passage' || item_id AS doc_name, md5(text) AS text_md5, 'ok' AS status FROM benchmark
UNION ALL SELECT 'page' || page_id, md5(''), 'unsupported' FROM pages""")
oracle("load_abbreviations", """
SELECT c_name AS query FROM customer UNION SELECT ' ' || c_mktsegment FROM customer UNION SELECT s_name FROM supplier""")
oracle("list_year_counts_json", f"""WITH {PARSED}
SELECT CASE WHEN is_target THEN 'targets' ELSE 'others' END AS list_name, sender_domain AS domain, sent_year AS year, count(*) AS n
FROM parsed WHERE sender_domain IS NOT NULL AND sent_year IS NOT NULL GROUP BY ALL""")
oracle("has_non_alphanumerics", f"""WITH {Q.RAW_QUERIES},
terms AS (SELECT DISTINCT unnest(string_split(query, ' ')) AS term FROM raw_q)
SELECT term, regexp_matches(term, '[0-9]') AS digits, regexp_matches(term, '[^\\p{{L}}\\p{{N}}]') AS others FROM terms""")
oracle("org_csv", f"""WITH {ORG}
SELECT name, full_name, nationality, category, stakeholdergroup, email_domains, subsidiary_of FROM org_raw""")
oracle("read_mbox_lists", f"""WITH {Q.MESSAGES},
named AS (SELECT lower(replace(trim(split_part("from", '<', 1)), '#', '-')) AS list_name, msg_id, date_raw FROM messages)
SELECT * FROM named WHERE list_name IN ('supplier-000000001', 'supplier-000000003', 'supplier-000000007')""")
oracle("read_mbox", f"""WITH {Q.MESSAGES}
SELECT msg_id, "from", comments_to, date_raw, NULL::VARCHAR AS sender, 'Sender: body of ' || msg_id AS body FROM messages""")


oracle("tokenize", f"""SELECT doc_id, len(tk) AS n_tokens, md5(array_to_string(tk, '|')) AS tokens_md5
FROM (SELECT doc_id, {Q.tokens('text')} AS tk FROM documents)""")
oracle("filter_tokens", f"""SELECT doc_id, array_to_string(list_filter(tk, lambda x: length(x) >= 3 AND length(x) <= 9
  AND x NOT IN {Q.STOP_SQL}), '|') AS kept FROM (SELECT doc_id, {Q.tokens('text')} AS tk FROM documents)""")

# --- lemmas and stems --------------------------------------------------------------------------

from lexiflow.functions.stemming import stem_ctes  # noqa: E402
from lexiflow.plans.lemmas import LEMMAS  # noqa: E402

_LEMMA_ROWS = ", ".join(f"({Q.lit(a)}, {Q.lit(b)})" for a, b in LEMMAS.items())


def normal_ctes(source: str, name: str, lemmas: bool = True) -> str:
    """CTEs that end in ``name(surface, normal)``: lemma, then stem, of the tokens (column t) of CTE ``source``."""
    table = f"(VALUES {_LEMMA_ROWS})" if lemmas else "(SELECT NULL, NULL WHERE false)"
    return f"""{name}_l AS (SELECT DISTINCT v.t AS surface, coalesce(l.lemma, v.t) AS term
  FROM {source} v LEFT JOIN {table} l(surface, lemma) ON l.surface = v.t),
{stem_ctes(f'{name}_l', f'{name}_s')},
{name} AS (SELECT surface, stem AS normal FROM {name}_l JOIN {name}_s USING (term))"""


def regrouped(key: str, tokens_of: str, name: str, lemmas: bool = True, out: str = "text") -> str:
    """CTEs that end in ``name(key, out)``: the tokens of ``tokens_of(key, tk)`` by their normal form, joined by blanks."""
    return f"""{name}_t AS (SELECT {key}, unnest(tk) AS t, generate_subscripts(tk, 1) AS i FROM {tokens_of}),
{normal_ctes(f'{name}_t', f'{name}_n', lemmas)},
{name}_j AS (SELECT {key}, string_agg(normal, ' ' ORDER BY i) AS {out} FROM {name}_t JOIN {name}_n ON surface = t GROUP BY {key}),
{name} AS (SELECT s.{key}, coalesce(j.{out}, '') AS {out} FROM {tokens_of} s LEFT JOIN {name}_j j ON j.{key} = s.{key})"""


oracle("stem_vocabulary", f"""WITH {cleaned('docs_def', DEF)},
tk AS (SELECT doc_id, {Q.tokens('text_clean')} AS tk FROM docs_def), {regrouped('doc_id', 'tk', 'st', False, 'stemmed')}
SELECT doc_id, stemmed FROM st""")
oracle("preprocess_corpus", f"""WITH tk AS (SELECT doc_id, {Q.clean_list('text', **TR)} AS tk FROM documents),
{regrouped('doc_id', 'tk', 'st', True, 'text_clean')}
SELECT doc_id, text_clean FROM st""")
oracle("keyterm_hits_stemmed", f"""WITH {Q.RAW_QUERIES},
qtk AS (SELECT query AS raw, {Q.clean_list('query', min_len=1, max_len=30, keep=True, remove_numbers=False)} AS tk FROM raw_q),
{regrouped('raw', 'qtk', 'qs', True, 'query')},
queries AS (SELECT DISTINCT query, len(string_split(query, ' ')) AS n_tokens FROM qs WHERE query <> '')
{Q.SEARCH_DOCS[len(Q.QUERIES):]},
dtk AS (SELECT doc_id, {Q.tokens('body')} AS tk FROM search_docs),
{regrouped('doc_id', 'dtk', 'ds', True, 'body')}
SELECT doc_id, 'body' AS field, query, cnt FROM (
  SELECT s.doc_id, q.query, {Q.token_count('s.body', 'q.query')} AS cnt FROM ds s, queries q) WHERE cnt > 0""")
