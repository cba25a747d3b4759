"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the driver tables (whole tables) through the stand-in builders and
runs the library's operators on them. Column names match the oracle SQL in
``lexiflow.plans.oracles``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.functions import text as T
from lexiflow.operators import keyterms as K
from lexiflow.plans import jobs, standins as S
from lexiflow.plans.lemmas import LEMMAS
from lexiflow.session import materialise_by

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

TRAIN_OPTS = dict(min_len=2, max_len=40, keep_nonalphanumerics=["-"], remove_numbers=True)


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# --- keyterm search -------------------------------------------------------------------

def _search(spark, sf_dir, mode="token"):
    return jobs.keyterm_search(S.corpus(spark, sf_dir), S.raw_keyterms(spark, sf_dir), mode=mode)


@register("keyterm_hits")
def q_keyterm_hits(spark, sf_dir):
    hits, _, _ = _search(spark, sf_dir)
    return hits


@register("keyterm_hits_padded")
def q_keyterm_hits_padded(spark, sf_dir):
    hits, _, _ = _search(spark, sf_dir, mode="padded")
    return hits


@register("emails_per_query")
def q_emails_per_query(spark, sf_dir):
    hits, _, _ = _search(spark, sf_dir)
    return K.texts_per_query(hits)


def _target_table(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return jobs.target_set_table(docs, S.raw_keyterms(spark, sf_dir), ["lang", "source", "reply_to"], id_col="doc_id")


@register("target_set_table")
def q_target_set_table(spark, sf_dir):
    """Target set with headers and lengths, its counts as rows."""
    t = _target_table(spark, sf_dir)
    return t.select("doc_id", "`msg-lang`", "`msg-source`", "`msg-reply_to`", "body_token_count",
                    F.explode("counts").alias("c")).select("*", "c.*").drop("c")


@register("target_headers")
def q_target_headers(spark, sf_dir):
    return jobs.target_headers(_target_table(spark, sf_dir))


@register("prepare_queries")
def q_prepare_queries(spark, sf_dir):
    return K.prepare_queries(S.raw_keyterms(spark, sf_dir))


@register("keyterm_hits_stemmed")
def q_keyterm_hits_stemmed(spark, sf_dir):
    """Keyterm search with lemmas and English stems on both sides."""
    hits, _, _ = jobs.keyterm_search(S.corpus(spark, sf_dir), S.raw_keyterms(spark, sf_dir),
                                     lemmas=LEMMAS, do_stemming=True)
    return hits


@register("preprocess_corpus")
def q_preprocess_corpus(spark, sf_dir):
    """Every text cleaned, lemmatised and stemmed."""
    return jobs.preprocess_corpus(S.corpus(spark, sf_dir), lemmas=LEMMAS, do_stemming=True, **TRAIN_OPTS)


@register("query_profile")
def q_query_profile(spark, sf_dir):
    prof = K.query_profile(K.prepare_queries(S.raw_keyterms(spark, sf_dir)))
    return prof.select("has_digits", "min_term_len", "max_term_len", "n_queries",
                       F.array_join("non_alphanumerics", "").alias("keep_chars"))


@register("remove_text_without_query")
def q_remove_text_without_query(spark, sf_dir):
    hits, _, _ = _search(spark, sf_dir)
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return K.texts_with_query(docs, hits)


@register("remove_query_without_text")
def q_remove_query_without_text(spark, sf_dir):
    hits, queries, _ = _search(spark, sf_dir)
    return K.queries_with_text(queries, hits)


@register("text_lengths")
def q_text_lengths(spark, sf_dir):
    _, _, cleaned = _search(spark, sf_dir)
    return cleaned.select("doc_id", F.size(T.tokenize(F.col("body"))).alias("n_tokens"),
                          F.length("body").alias("n_chars"))


@register("normalize_text")
def q_normalize_text(spark, sf_dir):
    docs = S.corpus(spark, sf_dir)
    return docs.select("doc_id", T.clean_text(F.col("text"), **TRAIN_OPTS).alias("text_clean"))


@register("tokenize")
def q_tokenize(spark, sf_dir):
    docs = S.corpus(spark, sf_dir)
    tokens = T.tokenize("text")
    return docs.select("doc_id", F.size(tokens).alias("n_tokens"), F.md5(F.array_join(tokens, "|")).alias("tokens_md5"))


@register("filter_tokens")
def q_filter_tokens(spark, sf_dir):
    """Tokens of 3 to 9 characters that are no stopwords."""
    tokens = T.filter_tokens(T.tokenize("text"), min_len=3, max_len=9)
    return S.corpus(spark, sf_dir).select("doc_id", F.array_join(tokens, "|").alias("kept"))


@register("raw_keyword_matrix")
def q_raw_keyword_matrix(spark, sf_dir):
    """Raw substring counts of the raw keyterms in the uncleaned text (no padding)."""
    docs = S.corpus(spark, sf_dir)
    kw = S.raw_keyterms(spark, sf_dir).where(F.col("query") != "").distinct()
    return K.raw_keyword_counts(docs, kw)


@register("raw_keyword_matrix_pages")
def q_raw_keyword_matrix_pages(spark, sf_dir):
    """Raw keyword counts of the fetched pages, with the URL of each page."""
    pages = S.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url", F.col("html").alias("text"))
    kw = S.raw_keyterms(spark, sf_dir).where(F.col("query") != "").distinct()
    return K.raw_keyword_counts(pages, kw, keep=["url"])


# --- corpora ------------------------------------------------------------------------------

DEFAULT_OPTS = dict(min_len=2, max_len=15, keep_nonalphanumerics=True, remove_numbers=True)


def reference_ids(spark, sf_dir):
    return S.table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id")


def cleaned_docs(spark, sf_dir, opts=None):
    opts = opts or DEFAULT_OPTS
    return S.corpus(spark, sf_dir).select(
        "doc_id", T.clean_text(F.col("text"), **opts).alias("text_clean"))


def reference_docs(spark, sf_dir, opts=None):
    return cleaned_docs(spark, sf_dir, opts).join(reference_ids(spark, sf_dir), "doc_id", "left_semi")


def search_docs(spark, sf_dir, opts=None):
    return cleaned_docs(spark, sf_dir, opts).join(reference_ids(spark, sf_dir), "doc_id", "left_anti")


def offtopic_docs(spark, sf_dir, opts=None):
    fr = S.table(spark, sf_dir, "documents").where(F.col("lang") == "fr").select("doc_id")
    return cleaned_docs(spark, sf_dir, opts).join(fr, "doc_id", "left_semi")


# --- n-grams --------------------------------------------------------------------------------

from lexiflow.operators import dtm as D  # noqa: E402
from lexiflow.operators import ngrams as NG  # noqa: E402
from lexiflow.operators import ranking as RK  # noqa: E402
from lexiflow.operators.impact import ImpactIndex  # noqa: E402


def _frequent_reference_bigrams(spark, sf_dir):
    return NG.ngram_frequency(reference_docs(spark, sf_dir), n=2, freq_limit=10)


@register("ngram_frequency")
def q_ngram_frequency(spark, sf_dir):
    return _frequent_reference_bigrams(spark, sf_dir)


@register("top_ngrams")
def q_top_ngrams(spark, sf_dir):
    return NG.top_ngrams(NG.ngram_frequency(reference_docs(spark, sf_dir), n=2), 50)


@register("ngrams")
def q_ngrams(spark, sf_dir):
    docs = reference_docs(spark, sf_dir)
    return docs.select("doc_id", F.array_join(T.ngrams(T.tokenize(F.col("text_clean")), 3), "|")
                       .alias("trigrams"))


@register("offtopic_filter")
def q_offtopic_filter(spark, sf_dir):
    return NG.offtopic_filter(_frequent_reference_bigrams(spark, sf_dir),
                              offtopic_docs(spark, sf_dir), mode="absent_from_all")


@register("offtopic_filter_any")
def q_offtopic_filter_any(spark, sf_dir):
    return NG.offtopic_filter(_frequent_reference_bigrams(spark, sf_dir),
                              offtopic_docs(spark, sf_dir), mode="absent_from_any")


@register("ngram_difference")
def q_ngram_difference(spark, sf_dir):
    return NG.ngram_difference(_frequent_reference_bigrams(spark, sf_dir),
                               offtopic_docs(spark, sf_dir), n=2)


def _passage_bigrams(spark, sf_dir):
    tokens = T.tokenize(T.clean_text(F.col("text"), **DEFAULT_OPTS))
    return S.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.ngrams(tokens, 2)).alias("position", "ngram"))


@register("ngram_difference_indices")
def q_ngram_difference_indices(spark, sf_dir):
    """Passage of every two tokens of every benchmark passage that no off-topic text contains, one row each."""
    return NG.ngram_difference(_passage_bigrams(spark, sf_dir), offtopic_docs(spark, sf_dir), mode="substring", index_col="item_id")


@register("ngram_difference_places")
def q_ngram_difference_places(spark, sf_dir):
    """(item_id, position) of every two tokens of every benchmark passage that no off-topic text contains."""
    return NG.ngram_difference(_passage_bigrams(spark, sf_dir), offtopic_docs(spark, sf_dir), mode="substring",
                               index_col=["item_id", "position"])


@register("verified_ngrams")
def q_verified_ngrams(spark, sf_dir):
    bench = S.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("doc_id"), T.clean_text(F.col("text"), **DEFAULT_OPTS).alias("text_clean"))
    curated = NG.explode_ngrams(bench, 2).select("ngram").distinct()
    return NG.verified_ngrams(_frequent_reference_bigrams(spark, sf_dir), curated)


# --- document-term matrix ---------------------------------------------------------------

def _dtm(spark, sf_dir):
    return D.doc_term_matrix(cleaned_docs(spark, sf_dir, TRAIN_OPTS), min_df=2, max_df=0.9)


def _search_vocab(spark, sf_dir, counts=None):
    s = search_docs(spark, sf_dir, TRAIN_OPTS)
    return D.doc_term_matrix(s, min_df=10, max_df=1.0, counts=counts).select("term").distinct()


@register("doc_term_matrix")
def q_doc_term_matrix(spark, sf_dir):
    return _dtm(spark, sf_dir)


@register("doc_term_matrix_vocab")
def q_doc_term_matrix_vocab(spark, sf_dir):
    s = search_docs(spark, sf_dir, TRAIN_OPTS)
    counts = materialise_by(D.term_counts(s), "terms", "doc_id")  # for the vocabulary and for the matrix
    return D.doc_term_matrix(s, vocabulary=_search_vocab(spark, sf_dir, counts), counts=counts)


@register("dtm_subset")
def q_dtm_subset(spark, sf_dir):
    return D.dtm_subset(_dtm(spark, sf_dir), reference_ids(spark, sf_dir))


@register("doc_counts")
def q_doc_counts(spark, sf_dir):
    m = D.doc_term_matrix(cleaned_docs(spark, sf_dir, TRAIN_OPTS), min_df=1, max_df=1.0)
    return D.doc_counts(m, terms=_search_vocab(spark, sf_dir), target_ids=reference_ids(spark, sf_dir))


@register("term_frequency_corpus")
def q_term_frequency_corpus(spark, sf_dir):
    return D.term_frequency_corpus(_dtm(spark, sf_dir))


@register("term_frequency_document")
def q_term_frequency_document(spark, sf_dir):
    return D.term_frequency_document(_dtm(spark, sf_dir))


@register("idf")
def q_idf(spark, sf_dir):
    docs = cleaned_docs(spark, sf_dir, TRAIN_OPTS)
    return D.inverse_document_frequency(_dtm(spark, sf_dir), docs.count())


@register("tfidf")
def q_tfidf(spark, sf_dir):
    return D.tfidf(cleaned_docs(spark, sf_dir, TRAIN_OPTS), n=1, min_df=3, max_df=0.95)


# --- ranking ------------------------------------------------------------------------------

def _hit_doc_ids(spark, sf_dir):
    hits, _, _ = _search(spark, sf_dir)
    return hits.select("doc_id").distinct()


@register("kl_terms")
def q_kl_terms(spark, sf_dir):
    m = D.doc_term_matrix(cleaned_docs(spark, sf_dir, TRAIN_OPTS), min_df=1, max_df=0.9)
    return RK.kl_terms(m, _hit_doc_ids(spark, sf_dir), word_limit=50, alpha=0.5, n_features=5000)


@register("weighted_zone_score")
def q_weighted_zone_score(spark, sf_dir):
    m = D.doc_term_matrix(cleaned_docs(spark, sf_dir, TRAIN_OPTS), min_df=1, max_df=0.9)
    cor = D.term_frequency_corpus(m)
    sub = RK.subset_term_frequency(m, _hit_doc_ids(spark, sf_dir))
    j = cor.join(sub, "term", "left").na.fill(0.0, ["p_sub"])
    return j.select("term", RK.weighted_zone_score("p_sub", "p_cor", 0.7).alias("score"))


def _query_terms_and_tfidf(spark, sf_dir):
    docs = materialise_by(cleaned_docs(spark, sf_dir, TRAIN_OPTS), "cleaned", "doc_id")
    weights = D.tfidf(docs, n=1, min_df=3, max_df=0.95)
    queries = K.prepare_queries(S.raw_keyterms(spark, sf_dir))
    return docs, weights, queries


@register("rank_tfidf_overlap")
def q_rank_tfidf_overlap(spark, sf_dir):
    docs, weights, queries = _query_terms_and_tfidf(spark, sf_dir)
    qterms = queries.select(F.explode(T.tokenize(F.col("query"))).alias("term"))
    lengths = docs.select("doc_id", F.size(T.tokenize(F.col("text_clean"))).alias("n_tokens"))
    return RK.rank_tfidf_overlap(weights, lengths, qterms)


@register("rank_cosine")
def q_rank_cosine(spark, sf_dir):
    docs, weights, queries = _query_terms_and_tfidf(spark, sf_dir)
    index = ImpactIndex(weights, normalised=True)  # tf-idf vectors have length one
    n_docs = docs.count()
    idf = (index.impacts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # exactly the kept terms
           .select("term", (F.log(F.lit(1.0 + n_docs) / (F.col("df") + 1)) + 1).alias("idf")))
    return index.best(RK.query_term_weights(queries, idf), 50)


# --- actors -------------------------------------------------------------------------------

from lexiflow.functions import mail as M  # noqa: E402
from lexiflow.operators import actors as A  # noqa: E402
from lexiflow.operators import graph as G  # noqa: E402
from lexiflow.sources import tables as ST  # noqa: E402

PERIODS = [(1995, 1998), (1998, 2002)]


def parsed_messages(spark, sf_dir):
    return A.parse_messages(S.messages(spark, sf_dir))


def org_dim(spark, sf_dir):
    return A.org_dimension(S.organisations(spark, sf_dir))


def category_dim(spark, sf_dir):
    d = org_dim(spark, sf_dir).select("row_no", "domain_pos", "full_name", "category", "domain")
    d = A.expand_multi_entries(d.na.drop(subset=["category", "domain"]), "category", pos_col="cat_pos")
    return A.first_match(d, "category", order=("row_no", "domain_pos", "cat_pos"))


def nation_dim(spark, sf_dir):
    d = org_dim(spark, sf_dir).select("row_no", "domain_pos", "full_name", "nationality", "domain")
    return A.first_match(d.na.drop(), "nationality")


def stakeholder_dim(spark, sf_dir):
    return A.first_match(org_dim(spark, sf_dir), "stakeholdergroup")


def enriched_messages(spark, sf_dir):
    m = parsed_messages(spark, sf_dir)
    m = A.enrich(m, category_dim(spark, sf_dir), "category", "from_category")
    m = A.enrich(m, stakeholder_dim(spark, sf_dir), "stakeholdergroup", "from_stakeholdergroup")
    return A.enrich(m, nation_dim(spark, sf_dir), "nationality", "from_nationality")


@register("parse_address")
def q_parse_address(spark, sf_dir):
    m = S.messages(spark, sf_dir)
    return m.select("msg_id", M.address_name(F.col("from")).alias("sender_name"),
                    M.address_local(F.col("from")).alias("sender_local"),
                    M.address_domain(F.col("from")).alias("sender_domain"))


@register("parse_mail_date")
def q_parse_mail_date(spark, sf_dir):
    m = parsed_messages(spark, sf_dir)
    return m.select("msg_id", F.unix_timestamp("sent_at").alias("sent_epoch"), "sent_year")


@register("messages_per_address")
def q_messages_per_address(spark, sf_dir):
    return A.messages_per_address(parsed_messages(spark, sf_dir))


@register("member_totals")
def q_member_totals(spark, sf_dir):
    return A.member_totals(parsed_messages(spark, sf_dir))


@register("most_active_members")
def q_most_active_members(spark, sf_dir):
    return A.most_active_members(A.messages_per_address(parsed_messages(spark, sf_dir)))


@register("messages_per_domain")
def q_messages_per_domain(spark, sf_dir):
    return A.messages_per_domain(parsed_messages(spark, sf_dir))


@register("distinct_domains")
def q_distinct_domains(spark, sf_dir):
    return A.distinct_domains(parsed_messages(spark, sf_dir))


@register("domain_year_counts")
def q_domain_year_counts(spark, sf_dir):
    return A.domain_year_counts(parsed_messages(spark, sf_dir))


@register("activity_period")
def q_activity_period(spark, sf_dir):
    p = A.activity_period(parsed_messages(spark, sf_dir))
    return p.select(F.unix_timestamp("first_at").alias("first_epoch"),
                    F.unix_timestamp("last_at").alias("last_epoch"), "first_year", "last_year")


@register("crop_by_year")
def q_crop_by_year(spark, sf_dir):
    return A.crop_by_year(parsed_messages(spark, sf_dir), 1996, 1999).select("msg_id", "sent_year")


@register("crop_by_domain")
def q_crop_by_domain(spark, sf_dir):
    m = A.crop_by_domain(parsed_messages(spark, sf_dir), ["nation_1.example", "nation_2.example"])
    return m.select("msg_id", "sender_domain")


@register("trim_all")
def q_trim_all(spark, sf_dir):
    return A.trim_all(S.organisations(spark, sf_dir))


@register("expand_multi_entries")
def q_expand_multi_entries(spark, sf_dir):
    o = A.trim_all(S.organisations(spark, sf_dir)).select("row_no", "email_domains")
    return A.expand_multi_entries(o, "email_domains", pos_col="domain_pos")


@register("parent_nationality")
def q_parent_nationality(spark, sf_dir):
    o = A.parent_nationality(A.trim_all(S.organisations(spark, sf_dir)))
    return o.select("row_no", "name", "nationality")


@register("dropna_subset")
def q_dropna_subset(spark, sf_dir):
    return A.trim_all(S.organisations(spark, sf_dir)).na.drop(subset=["subsidiary_of"]) \
        .select("row_no", "name", "subsidiary_of")


@register("dropna_any")
def q_dropna_any(spark, sf_dir):
    o = A.trim_all(S.organisations(spark, sf_dir)).select("full_name", "nationality", "subsidiary_of")
    return o.na.drop(how="any")


@register("org_dimension")
def q_org_dimension(spark, sf_dir):
    return org_dim(spark, sf_dir).select("row_no", "domain_pos", "domain", "name", "nationality",
                                         "category", "stakeholdergroup")


@register("map_labels")
def q_map_labels(spark, sf_dir):
    mapping = S.table(spark, sf_dir, "nation").join(
        S.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")) \
        .select(F.col("n_name").alias("key"), F.col("r_name").alias("label"))
    d = org_dim(spark, sf_dir).select("row_no", "domain_pos", "nationality")
    return A.map_labels(d, "nationality", mapping, on_missing="error")


@register("enrich_category")
def q_enrich_category(spark, sf_dir):
    return enriched_messages(spark, sf_dir).select("msg_id", "from_category")


@register("enrich_stakeholder")
def q_enrich_stakeholder(spark, sf_dir):
    return enriched_messages(spark, sf_dir).select("msg_id", "from_stakeholdergroup")


@register("enrich_nationality")
def q_enrich_nationality(spark, sf_dir):
    return enriched_messages(spark, sf_dir).select("msg_id", "from_nationality")


def _yearly(spark, sf_dir, group_col):
    return A.yearly_counts(enriched_messages(spark, sf_dir), group_col)


@register("yearly_counts_category")
def q_yearly_counts_category(spark, sf_dir):
    return _yearly(spark, sf_dir, "from_category")


@register("yearly_counts_stakeholder")
def q_yearly_counts_stakeholder(spark, sf_dir):
    return _yearly(spark, sf_dir, "from_stakeholdergroup")


@register("yearly_counts_nation")
def q_yearly_counts_nation(spark, sf_dir):
    return _yearly(spark, sf_dir, "from_nationality")


def _target_and_all_yearly(spark, sf_dir):
    m = parsed_messages(spark, sf_dir)
    years = A.year_range(A.with_valid_date(m))
    return (A.yearly_counts(m.where(F.col("is_target")), None, years),
            A.yearly_counts(m, None, years))


@register("yearly_counts_target")
def q_yearly_counts_target(spark, sf_dir):
    return _target_and_all_yearly(spark, sf_dir)[0]


@register("target_share")
def q_target_share(spark, sf_dir):
    t, s = _target_and_all_yearly(spark, sf_dir)
    return A.target_share(t, s)


@register("group_totals")
def q_group_totals(spark, sf_dir):
    return A.group_totals(_yearly(spark, sf_dir, "from_nationality"))


@register("rank_by_last_year")
def q_rank_by_last_year(spark, sf_dir):
    return A.rank_by_last_year(_yearly(spark, sf_dir, "from_category"))


@register("stacked_bands")
def q_stacked_bands(spark, sf_dir):
    return A.stacked_bands(_yearly(spark, sf_dir, "from_category"))


@register("split_by_target_set")
def q_split_by_target_set(spark, sf_dir):
    docs = S.corpus(spark, sf_dir).select("doc_id")
    hit_ids = _hit_doc_ids(spark, sf_dir)
    inside = docs.join(hit_ids, "doc_id", "left_semi").withColumn("side", F.lit("target"))
    outside = docs.join(hit_ids, "doc_id", "left_anti").withColumn("side", F.lit("search"))
    return inside.unionByName(outside)


@register("select_by_id")
def q_select_by_id(spark, sf_dir):
    sel = S.table(spark, sf_dir, "labels").where(F.col("toxic") == 1).select("doc_id")
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(sel, "doc_id", "left_semi")


@register("corpus_union")
def q_corpus_union(spark, sf_dir):
    r = S.corpus(spark, sf_dir).join(reference_ids(spark, sf_dir), "doc_id", "left_semi")
    s = S.table(spark, sf_dir, "documents").where(F.col("lang") == "en").select("doc_id", "text")
    u = r.join(s.select("doc_id"), "doc_id", "left_anti").withColumn("origin", F.lit("R")) \
        .unionByName(s.withColumn("origin", F.lit("S")))
    return u.select("doc_id", "origin", F.length("text").alias("n_chars"))


# --- threads, pages -------------------------------------------------------------------------

@register("attachment_text")
def q_attachment_text(spark, sf_dir):
    t = S.threads(spark, sf_dir)
    return t.select("msg_id", F.concat_ws(" ", "attachments").alias("attachment"))


@register("messages_with_attachment")
def q_messages_with_attachment(spark, sf_dir):
    return S.threads(spark, sf_dir).where(F.size("attachments") > 0).select("msg_id")


@register("keyterm_hits_fields")
def q_keyterm_hits_fields(spark, sf_dir):
    t = S.threads(spark, sf_dir).select("msg_id", "body",
                                        F.concat_ws(" ", "attachments").alias("attachment"))
    hits, _, _ = jobs.keyterm_search(t, S.raw_keyterms(spark, sf_dir), id_col="msg_id",
                                     fields={"body": "body", "attachment": "attachment"})
    return hits


@register("pages_source")
def q_pages_source(spark, sf_dir):
    return ST.pages_source(S.table(spark, sf_dir, "pages")).select(
        "url", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@register("document_name")
def q_document_name(spark, sf_dir):
    p = S.table(spark, sf_dir, "pages")
    return p.select("page_id", ST.name_from_url(F.col("url")).alias("doc_name"),
                    ST.name_from_path(F.col("url")).alias("last_segment"))


@register("assemble_pages")
def q_assemble_pages(spark, sf_dir):
    c = S.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text",
        (F.col("role") != "system").alias("ok"))
    a = ST.assemble_pages(c)
    return a.select("doc_id", F.md5("text").alias("text_md5"), "n_read", "n_total")


# --- graphs ------------------------------------------------------------------------------------

def domain_graph(spark, sf_dir):
    return G.digraph(parsed_messages(spark, sf_dir))


def target_graph(spark, sf_dir):
    return G.digraph(parsed_messages(spark, sf_dir).where(F.col("is_target")))


def foreground_graph(spark, sf_dir):
    return G.foreground_edges(target_graph(spark, sf_dir)).where("foreground") \
        .select("src", "dst", "weight")


def contracted_period_graph(spark, sf_dir, dim=None, attr="category"):
    m = G.with_period(parsed_messages(spark, sf_dir).where(F.col("is_target")), PERIODS)
    e = G.digraph(m, by=["period"])
    dim = category_dim(spark, sf_dir) if dim is None else dim
    return G.contract(e, dim.select(F.col("domain").alias("node"), F.col(attr).alias("attr")), by=["period"])


def category_graph(spark, sf_dir):
    """Whole target graph of the second period, contracted by category."""
    return contracted_period_graph(spark, sf_dir).where(F.col("period") == "1998-2002").drop("period")


def nation_graph(spark, sf_dir):
    """Whole target graph of the second period, contracted by nationality."""
    e = contracted_period_graph(spark, sf_dir, nation_dim(spark, sf_dir), "nationality")
    return e.where(F.col("period") == "1998-2002").drop("period")


@register("domain_digraph")
def q_domain_digraph(spark, sf_dir):
    return domain_graph(spark, sf_dir)


@register("contracted_digraph")
def q_contracted_digraph(spark, sf_dir):
    attr = category_dim(spark, sf_dir).select(F.col("domain").alias("node"), F.col("category").alias("attr"))
    return G.contract(domain_graph(spark, sf_dir), attr)


@register("digraph_by_period")
def q_digraph_by_period(spark, sf_dir):
    m = G.with_period(parsed_messages(spark, sf_dir), PERIODS)
    return G.digraph(m, by=["period"])


def _register_centralities(prefix, graph):
    for name, measure in (("degree", G.degree_centrality), ("closeness", G.closeness_centrality),
                          ("betweenness", G.betweenness_centrality)):
        def query(spark, sf_dir, measure=measure):
            return measure(graph(spark, sf_dir)).orderBy(F.desc("centrality"), "node")
        register(f"{prefix}{name}_centrality")(query)


_register_centralities("", target_graph)
_register_centralities("contracted_", category_graph)
_register_centralities("nation_", nation_graph)


@register("out_edges")
def q_out_edges(spark, sf_dir):
    return G.out_edges(target_graph(spark, sf_dir))


@register("reciprocal_edges")
def q_reciprocal_edges(spark, sf_dir):
    return G.reciprocal_edges(target_graph(spark, sf_dir))


@register("foreground_edges")
def q_foreground_edges(spark, sf_dir):
    m = G.with_period(parsed_messages(spark, sf_dir), PERIODS)
    return G.foreground_edges(G.digraph(m, by=["period"]), k=20, by=["period"])


@register("induced_subgraph")
def q_induced_subgraph(spark, sf_dir):
    fg = foreground_graph(spark, sf_dir)
    return G.induced_subgraph(target_graph(spark, sf_dir), G.nodes(fg))


@register("edge_thickness")
def q_edge_thickness(spark, sf_dir):
    return G.edge_thickness(contracted_period_graph(spark, sf_dir))


@register("node_weight")
def q_node_weight(spark, sf_dir):
    return G.node_weight(domain_graph(spark, sf_dir))


@register("edge_weight_limits")
def q_edge_weight_limits(spark, sf_dir):
    return G.edge_weight_limits(contracted_period_graph(spark, sf_dir))


@register("edges_of_node")
def q_edges_of_node(spark, sf_dir):
    fg = foreground_graph(spark, sf_dir)
    first = fg.agg(F.min("src")).first()[0]
    return G.edges_of_node(target_graph(spark, sf_dir), first)


@register("edges_excluding")
def q_edges_excluding(spark, sf_dir):
    return G.edges_excluding(target_graph(spark, sf_dir), foreground_graph(spark, sf_dir))


# --- keyword discovery ---------------------------------------------------------------------

from lexiflow.operators import classifiers as CL  # noqa: E402
from lexiflow.operators import discovery as DS  # noqa: E402


def _discovery_inputs(spark, sf_dir):
    r = reference_docs(spark, sf_dir, TRAIN_OPTS)
    s = search_docs(spark, sf_dir, TRAIN_OPTS)
    corpus = r.join(s.select("doc_id"), "doc_id", "left_anti").unionByName(s)
    dtm = materialise_by(D.doc_term_matrix(corpus, min_df=1, max_df=1.0), "terms", "doc_id")
    train, test_ids = DS.training_split(r, s)
    return r, s, corpus, dtm, train, test_ids


@register("training_split")
def q_training_split(spark, sf_dir):
    _, _, _, _, train, test_ids = _discovery_inputs(spark, sf_dir)
    return (train.withColumn("split", F.lit("train"))
            .unionByName(test_ids.withColumn("label", F.lit(None).cast("int"))
                         .withColumn("split", F.lit("test"))))


def _nb_votes(spark, sf_dir):
    r, s, corpus, dtm, train, test_ids = _discovery_inputs(spark, sf_dir)
    return DS.naive_bayes_vote(train, test_ids, dtm), s


@register("vote_naive_bayes")
def q_vote_naive_bayes(spark, sf_dir):
    return _nb_votes(spark, sf_dir)[0]


@register("vote_counts")
def q_vote_counts(spark, sf_dir):
    return DS.vote_counts([_nb_votes(spark, sf_dir)[0]])


@register("vote_target_set")
def q_vote_target_set(spark, sf_dir):
    return DS.target_set(DS.vote_counts([_nb_votes(spark, sf_dir)[0]]))


def _klr_nb(spark, sf_dir):
    r = reference_docs(spark, sf_dir, TRAIN_OPTS)
    s = search_docs(spark, sf_dir, TRAIN_OPTS)
    return DS.klr_keywords(r, s, classifiers="nbayes")[0]


@register("klr_keywords_nb")
def q_klr_keywords_nb(spark, sf_dir):
    return _klr_nb(spark, sf_dir).orderBy(F.desc("ll"), "term")


@register("klr_top_keywords")
def q_klr_top_keywords(spark, sf_dir):
    return DS.top_keywords(_klr_nb(spark, sf_dir), k=1000)


def _ml_votes(spark, sf_dir, name, **options):
    r, s, corpus, dtm, train, test_ids = _discovery_inputs(spark, sf_dir)
    return CL.vote(name, train, test_ids, dtm, **options)


@register("vote_logit")
def q_vote_logit(spark, sf_dir):
    return _ml_votes(spark, sf_dir, "logit")


@register("vote_svm")
def q_vote_svm(spark, sf_dir):
    return _ml_votes(spark, sf_dir, "SVM")


@register("vote_nearest")
def q_vote_nearest(spark, sf_dir):
    return _ml_votes(spark, sf_dir, "nearest")


@register("vote_tree")
def q_vote_tree(spark, sf_dir):
    return _ml_votes(spark, sf_dir, "tree")


@register("vote_gboost")
def q_vote_gboost(spark, sf_dir):
    return _ml_votes(spark, sf_dir, "gboost")


@register("vote_forest")
def q_vote_forest(spark, sf_dir):
    """200 trees; a node sees one of as many classes of the terms as the root of their number."""
    return _ml_votes(spark, sf_dir, "rf")


@register("vote_counts_several")
def q_vote_counts_several(spark, sf_dir):
    """Votes of Naive Bayes, logit and discriminant summed per document."""
    r, s, corpus, dtm, train, test_ids = _discovery_inputs(spark, sf_dir)
    return DS.vote_counts([CL.vote(name, train, test_ids, dtm) for name in ("nbayes", "logit", "LDA")])


# --- sources and sinks (round trips through the shared checkpoint folder) ------------------

import uuid  # noqa: E402

from lexiflow.session import checkpoint_dir  # noqa: E402
from lexiflow.sources import document_files as DF  # noqa: E402
from lexiflow.sources import files as FS  # noqa: E402
from lexiflow.sources import mbox as MB  # noqa: E402


def scratch_path(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/lexiflow-out/{name}-{uuid.uuid4().hex}"


@register("documents_roundtrip")
def q_documents_roundtrip(spark, sf_dir):
    """Write every document as its own text file, scan the files back."""
    path = scratch_path(spark, "documents")
    DF.save_documents(S.corpus(spark, sf_dir), path, name_col="doc_id")
    return DF.load_documents(spark, path).select(
        F.col("name").alias("doc_id"), F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@register("document_files")
def q_document_files(spark, sf_dir):
    """Documents of each source as files ``<source>_<index>.txt``, their index and text read back."""
    path = scratch_path(spark, "document-files")
    docs = S.table(spark, sf_dir, "documents").select(F.concat_ws("-", "source", "doc_id").alias("doc_name"), "text")
    DF.save_documents(docs, path)
    return DF.load_documents(spark, path).select("name", F.col("index").alias("file_index"), F.md5("text").alias("text_md5"))


@register("target_set_roundtrip")
def q_target_set_roundtrip(spark, sf_dir):
    """Long target-set table (keyterm hits) written as Parquet and read back."""
    hits, _, _ = _search(spark, sf_dir)
    path = scratch_path(spark, "target-set")
    FS.write_table(hits, path)
    return spark.read.parquet(path)


@register("sink_csv")
def q_sink_csv(spark, sf_dir):
    """Actor counts written as CSV with a header and read back with a schema."""
    path = scratch_path(spark, "domains-csv")
    FS.write_table(A.messages_per_domain(parsed_messages(spark, sf_dir)), path, fmt="csv")
    return spark.read.csv(path, header=True, schema="domain string, n bigint")


@register("domain_year_counts_json")
def q_domain_year_counts_json(spark, sf_dir):
    """Per-year result files (JSON, one folder per year) read back."""
    path = scratch_path(spark, "domain-year-json")
    FS.write_table(A.domain_year_counts(parsed_messages(spark, sf_dir)), path, fmt="json",
                   partition_by=["year"])
    return spark.read.schema("domain string, n bigint, year int").json(path)


@register("list_year_counts_json")
def q_list_year_counts_json(spark, sf_dir):
    """Messages per sender domain and year of each list, one nested folder of JSON per list and year, read back."""
    path = scratch_path(spark, "list-year-json")
    m = parsed_messages(spark, sf_dir).withColumn("list_name", F.when(F.col("is_target"), "targets").otherwise("others"))
    counts = A.domain_year_counts(m, by=["list_name"])
    FS.write_table(counts, path, fmt="json", partition_by=["list_name", "year"])
    return spark.read.schema("domain string, n bigint, list_name string, year int").json(path)


@register("klr_keywords")
def q_klr_keywords(spark, sf_dir):
    """Keyword discovery with its default pair of classifiers."""
    return DS.klr_keywords(reference_docs(spark, sf_dir, TRAIN_OPTS), search_docs(spark, sf_dir, TRAIN_OPTS),
                           classifiers=["nbayes", "logit"])[0]


@register("has_non_alphanumerics")
def q_has_non_alphanumerics(spark, sf_dir):
    """Whether each raw keyterm has digits, and characters that are neither letters nor digits."""
    q = S.raw_keyterms(spark, sf_dir).select(F.explode(F.split("query", " ")).alias("term")).distinct()
    return q.select("term", T.has_digits("term").alias("digits"), T.has_non_alphanumerics("term").alias("others"))


@register("vote_discriminant")
def q_vote_discriminant(spark, sf_dir):
    return _ml_votes(spark, sf_dir, "LDA")


@register("stem_vocabulary")
def q_stem_vocabulary(spark, sf_dir):
    """Snowball English stems of every token of the cleaned corpus: the distinct vocabulary is
    stemmed by SQL steps and joined back."""
    from lexiflow.functions.stemming import stem_terms
    from lexiflow.operators import vocabulary as V
    docs = cleaned_docs(spark, sf_dir).select("doc_id", T.tokenize(F.col("text_clean")).alias("tokens"))
    docs = materialise_by(docs, "tokens", "doc_id")  # for the vocabulary and for its join with the tokens
    stems = stem_terms(docs.select(F.explode("tokens").alias("term")))
    out = V.map_vocabulary(docs, stems.withColumnsRenamed({"term": "surface", "stem": "normal"}))
    return out.select("doc_id", F.array_join("tokens", " ").alias("stemmed"))


@register("line_list_roundtrip")
def q_line_list_roundtrip(spark, sf_dir):
    """Benchmark passages written as text lines, read back as a distinct line list."""
    path = scratch_path(spark, "lines")
    S.table(spark, sf_dir, "benchmark").select("text").write.mode("overwrite").text(path)
    return FS.scan_line_list(spark, path)


def _lines_file(spark, df, name):
    """Write a one-column table of strings as text files; returns the folder."""
    path = scratch_path(spark, name)
    df.write.mode("overwrite").text(path)
    return path


@register("load_queries")
def q_load_queries(spark, sf_dir):
    """Raw keyterms and benchmark passages as two line lists, loaded as one query list."""
    a = _lines_file(spark, S.raw_keyterms(spark, sf_dir), "keyterms")
    b = _lines_file(spark, S.table(spark, sf_dir, "benchmark").select(F.col("text").alias("value")), "passages")
    return FS.load_queries(spark, [a, b])


@register("scan_stopwords")
@register("scan_stopwords_all_words")
def q_scan_stopwords(spark, sf_dir):
    """Every distinct word of the documents as a stopword file, read back."""
    words = S.corpus(spark, sf_dir).select(F.explode(T.tokenize(F.lower(F.col("text")))).alias("value")) \
        .where(F.col("value") != "").distinct()
    return FS.scan_stopwords(spark, _lines_file(spark, words, "stopwords"))


@register("scan_documents")
def q_scan_documents(spark, sf_dir):
    """Every benchmark passage as its own text file, scanned with ids from the file names."""
    folder = scratch_path(spark, "passages")
    FS.sink_documents(S.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("doc_id"), "text"), folder)
    back = FS.scan_documents(spark, f"{folder}/*")
    return back.groupBy().agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


@register("scan_documents_texts")
def q_scan_documents_texts(spark, sf_dir):
    """Id, length and MD5 of the text of every file that ``scan_documents`` reads; files are named by id."""
    folder = scratch_path(spark, "passages")
    lines = S.table(spark, sf_dir, "benchmark").select("item_id", F.concat("text", F.lit("\n")).alias("text"))
    DF.save_documents(lines, folder, name_col="item_id")
    back = FS.scan_documents(spark, f"{folder}/*.txt")
    return back.select(F.regexp_extract("doc_id", "^(.*)_[0-9]+$", 1).alias("doc_id"), F.length("text").alias("n_chars"),
                       F.md5("text").alias("text_md5"))


@register("scan_mixed_documents")
def q_scan_mixed_documents(spark, sf_dir):
    """A folder of passages (.txt) and pages (.html): texts of the first, a mark at the others."""
    folder = scratch_path(spark, "mixed")
    passages = S.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("passage"), "item_id").alias("doc_name"), "text")
    pages = S.table(spark, sf_dir, "pages").select(F.concat(F.lit("page"), "page_id").alias("doc_name"), F.col("html").alias("text"))
    DF.save_documents(passages, folder)
    DF.save_documents(pages, folder, mode="append", extension="html")
    back = FS.scan_mixed_documents(spark, folder, "*_*.*")
    return back.select(F.regexp_extract("doc_id", "^(.*)_[0-9]+$", 1).alias("doc_name"), F.md5("text").alias("text_md5"), "status")


@register("load_abbreviations")
def q_load_abbreviations(spark, sf_dir):
    """Abbreviation tables (.csv: customers and their segments) and query lists (.txt: suppliers), each with its preamble."""
    folder = scratch_path(spark, "abbreviations")
    top = "list\n\n\n"
    table = S.table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 100).alias("doc_name")) \
        .agg(F.array_join(F.collect_list(F.concat("c_name", F.lit(", "), "c_mktsegment")), "\n").alias("rows")) \
        .select("doc_name", F.concat(F.lit(top + "Abbreviation, Concept\n"), "rows").alias("text"))  # 100 rows a file
    lines = S.table(spark, sf_dir, "supplier").groupBy(F.floor(F.col("s_suppkey") / 100).alias("doc_name")) \
        .agg(F.array_join(F.collect_list("s_name"), "\n").alias("rows")).select("doc_name", F.concat(F.lit(top), "rows").alias("text"))
    DF.save_documents(table, folder, extension="csv")
    DF.save_documents(lines, folder, mode="append")
    return FS.load_abbreviations(spark, [f"{folder}/*.csv", f"{folder}/*.txt"]).distinct()


@register("org_csv")
def q_org_csv(spark, sf_dir):
    """Organisation table written as CSV (header, quoted comma lists), loaded by header names."""
    path = scratch_path(spark, "orgs")
    o = S.organisations(spark, sf_dir)
    names = {v: k for k, v in FS.ORG_COLUMNS.items()}
    o.select([F.col(c).alias(names[c]) for c in ("category", "name", "email_domains", "full_name", "nationality",
                                                 "subsidiary_of", "stakeholdergroup")]) \
        .write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    return FS.load_organisations(spark, path).drop("row_no")


def _mail_text(m, end):
    """Each message of ``m`` as a record of an mbox archive with the line ends ``end``."""
    lines = [F.lit("From nobody Thu Jan  1 00:00:00 1970"), F.concat(F.lit("From: "), F.col("from")),
             F.concat(F.lit("Comments-To: "), F.col("comments_to")), F.concat(F.lit("Date: "), F.col("date_raw")),
             F.concat(F.lit("Message-ID: "), F.col("msg_id")), F.lit(""), F.concat(F.lit("Sender: body of "), F.col("msg_id"))]
    text = lines[0]
    for line in lines[1:]:
        text = F.concat(text, end, line)
    return F.concat(text, end)


LISTS = ["supplier-000000001", "supplier-000000003", "supplier-000000007"]


@register("read_mbox_lists")
def q_read_mbox_lists(spark, sf_dir):
    """One archive for each supplier (some 600 messages); three of the lists read, headers only."""
    m = S.messages(spark, sf_dir)
    name = F.lower(F.translate(M.address_name(F.col("from")), "#", "-"))
    archives = m.groupBy(name.alias("doc_name")).agg(F.array_join(F.collect_list(_mail_text(m, F.lit("\n"))), "\n").alias("text"))
    path = scratch_path(spark, "mbox-lists")
    DF.save_documents(archives, path, extension="mbox")
    return MB.read_mbox(spark, f"{path}/*.mbox", include_body=False, list_names=LISTS, parts=True) \
        .select("list_name", "msg_id", "date_raw")


@register("read_mbox")
def q_read_mbox(spark, sf_dir):
    """One archive per target flag with every message as mail text, parsed back."""
    m = S.messages(spark, sf_dir)
    end = F.when(F.col("is_target"), F.lit("\r\n")).otherwise(F.lit("\n"))  # CRLF and LF archives
    path = scratch_path(spark, "mbox")
    # the messages' text is many times the tables it is made from
    m.select(_mail_text(m, end).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)
    back = MB.read_mbox(spark, path)
    return back.select("msg_id", "from", "comments_to", "date_raw", "sender", F.trim(F.translate("body", "\r\n", "")).alias("body"))
