"""End-to-end jobs composed from the operators (each returns lazy DataFrames)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.functions.text import DEFAULT_STOPWORDS, clean_text, tokenize
from lexiflow.operators.keyterms import (
    keyterm_hits, prepare_queries, query_profile, search_options,
)


def preprocess_corpus(texts: DataFrame, text_col: str = "text", out_col: str = "text_clean", **options) -> DataFrame:
    """Clean one text column with the options of ``clean_text``; the other columns stay."""
    return texts.select(*[c for c in texts.columns if c != text_col],
                        clean_text(F.col(text_col), **options).alias(out_col))


def keyterm_search(texts: DataFrame, raw_queries: DataFrame, id_col: str = "doc_id",
                   fields: Mapping[str, str] | None = None, mode: str = "token",
                   stopwords: Sequence[str] = DEFAULT_STOPWORDS,
                   legacy_digits: bool = False, query_col: str = "query",
                   lemmas: Mapping[str, str] | None = None, do_stemming: bool = False):
    """Keyterm search over a text table.

    1. clean the raw queries (lengths 1..30, all punctuation kept, digits kept);
    2. derive the search-set cleaning options from the query list (term length range,
       punctuation to keep, digits) - a one-row profile;
    3. clean each text field with those options;
    4. count every query in every field.

    ``lemmas`` and ``do_stemming`` apply to queries and texts alike, after the length
    filter, so that inflected forms of a query term count as the term.

    Returns ``(hits, queries, cleaned)``; ``hits`` is ``(id, field, query, cnt>0)``.
    """
    from lexiflow.session import cut_lineage
    fields = dict(fields or {"body": "text"})
    # the (small) prepared query list is read by several planning actions and the join:
    # materialise it once in the shared checkpoint folder
    queries = cut_lineage(prepare_queries(raw_queries, col=query_col, stopwords=stopwords,
                                          lemmas=lemmas, do_stemming=do_stemming))
    prof = query_profile(queries).first()  # one aggregate row
    opts = search_options(prof, legacy_digits=legacy_digits)
    cleaned = texts.select(
        F.col(id_col),
        *[clean_text(F.col(src), stopwords=stopwords, lemmas=lemmas, do_stemming=do_stemming, **opts).alias(field)
          for field, src in fields.items()])
    hits = keyterm_hits(cleaned, queries, id_col=id_col, fields=list(fields), mode=mode)
    return hits, queries, cleaned


def target_set_table(messages: DataFrame, raw_queries: DataFrame, headers: Sequence[str], id_col: str = "msg_id",
                     fields: Mapping[str, str] | None = None, **options) -> DataFrame:
    """The target set as one row per message with a hit.

    ``id_col``, the headers as ``msg-<header>`` (NULL where a message has none), the length
    of each cleaned field as ``<field>_token_count`` and ``counts``, an array of (field,
    query, cnt) in order. Options are those of :func:`keyterm_search`.
    """
    hits, _, cleaned = keyterm_search(messages, raw_queries, id_col=id_col, fields=fields, **options)
    names = [c for c in cleaned.columns if c != id_col]
    lengths = cleaned.select(id_col, *[F.size(tokenize(F.col(c))).alias(f"{c}_token_count") for c in names])
    counts = hits.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("field", "query", "cnt"))).alias("counts"))
    there = set(messages.columns)
    head = messages.select(id_col, *[(F.col(h) if h in there else F.lit(None).cast("string")).alias(f"msg-{h}")
                                     for h in headers])
    return head.join(lengths, id_col).join(counts, id_col)


def target_headers(target: DataFrame, prefix: str = "msg-") -> DataFrame:
    """The header columns of a target set, without their prefix."""
    return target.select([F.col(f"`{c}`").alias(c[len(prefix):]) for c in target.columns if c.startswith(prefix)])
