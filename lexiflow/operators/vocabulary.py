"""Vocabulary normalisation jobs (lemma / stem re-aimed as joins).

Instead of calling a lemmatiser or stemmer per token, the distinct vocabulary is mapped
once and joined back: a ``(surface, normal)`` table (e.g. a lemma list) or a per-term
function applied to the distinct terms in Arrow batches. Token order is restored from
the position column; unmatched tokens are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.session import small_side


def explode_tokens(docs: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    # outer: no filter on the tokens is inferred, which would compute them once more below a shuffle of the documents
    return docs.select(id_col, F.posexplode_outer(tokens_col).alias("pos", "token")).where(F.col("pos").isNotNull())


def regroup_tokens(long: DataFrame, id_col: str = "doc_id", token_col: str = "token") -> DataFrame:
    """Back to one ordered token array per document (one document's tokens per group)."""
    return long.groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", token_col))), lambda x: x[token_col])
        .alias("tokens"))


def map_vocabulary(docs: DataFrame, mapping: DataFrame, id_col: str = "doc_id",
                   tokens_col: str = "tokens", surface: str = "surface", normal: str = "normal") -> DataFrame:
    """Replace every token found in ``mapping(surface, normal)``; others stay.

    Only tokens that change are looked up; the others stay with their documents if those are few."""
    m = mapping.select(F.col(surface).alias("token"), F.col(normal).alias("_n")).dropDuplicates(["token"])
    m = small_side(m.where(F.col("_n") != F.col("token")), "vocabulary")
    long = explode_tokens(docs, id_col, tokens_col).join(m, "token", "left")
    long = long.select(id_col, "pos", F.coalesce("_n", "token").alias("token"))
    ids = docs.select(id_col)
    out = regroup_tokens(long, id_col)
    return ids.join(out, id_col, "left").select(
        id_col, F.coalesce("tokens", F.array().cast("array<string>")).alias(tokens_col))


def vocabulary_table(docs: DataFrame, fn: Callable[[str], str], tokens_col: str = "tokens") -> DataFrame:
    """``(surface, normal)`` for the distinct vocabulary, ``fn`` applied in Arrow batches
    (one call per distinct term, not per occurrence)."""
    vocab = docs.select(F.explode(tokens_col).alias("surface")).distinct()

    def apply(it):
        for pdf in it:
            pdf["normal"] = [fn(t) for t in pdf["surface"]]
            yield pdf
    return vocab.mapInPandas(apply, "surface string, normal string")


def normalise_vocabulary(docs: DataFrame, fn: Callable[[str], str], id_col: str = "doc_id",
                         tokens_col: str = "tokens") -> DataFrame:
    """Apply a per-term normaliser (stemmer, lemmatiser) through the vocabulary table."""
    return map_vocabulary(docs, vocabulary_table(docs, fn, tokens_col), id_col, tokens_col)
