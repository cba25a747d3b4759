"""n-gram operators: corpus frequency, top-k, vocabulary difference, off-topic filter,
verification filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.functions.text import ngrams, tokenize
from lexiflow.operators.substrings import PhraseSearch
from lexiflow.session import materialise


def explode_ngrams(docs: DataFrame, n: int = 2, id_col: str = "doc_id",
                   text_col: str = "text_clean") -> DataFrame:
    """``(id, ngram)`` one row per occurrence; n-grams never cross document borders."""
    return docs.select(id_col, F.explode(ngrams(tokenize(F.col(text_col)), n)).alias("ngram"))


def ngram_frequency(docs: DataFrame, n: int = 2, freq_limit: int | None = None,
                    id_col: str = "doc_id", text_col: str = "text_clean") -> DataFrame:
    """Occurrences of every n-gram over the corpus, ``freq >= freq_limit`` when given
    (0/None = no limit). Partial aggregation runs before the shuffle."""
    freq = (explode_ngrams(docs, n, id_col, text_col).groupBy("ngram")
            .agg(F.count(F.lit(1)).alias("freq")))
    if freq_limit:
        freq = freq.where(F.col("freq") >= freq_limit)
    return freq


def top_ngrams(freq: DataFrame, word_limit: int) -> DataFrame:
    """The ``word_limit`` most frequent n-grams (ties by n-gram), ascending frequency.
    A top-k report: Spark plans it as TakeOrderedAndProject (per-partition top-k)."""
    top = freq.orderBy(F.desc("freq"), F.asc("ngram")).limit(word_limit)
    return top.orderBy("freq", F.desc("ngram"))


def ngram_difference(candidates: DataFrame, texts: DataFrame, n: int = 2,
                     id_col: str = "doc_id", text_col: str = "text_clean", mode: str = "token",
                     index_col: str | list[str] | None = None) -> DataFrame:
    """Candidate n-grams that occur in none of ``texts``.

    ``mode='token'`` compares whole tokens, ``'substring'`` any part of a text. With
    ``index_col`` (the candidates' place in their list) only the places are returned."""
    if mode == "token":
        present = explode_ngrams(texts, n, id_col, text_col).select("ngram").distinct()
    elif mode == "substring":
        present = substring_containment(candidates, texts, id_col, text_col, ids=False)
    else:
        raise ValueError("mode must be 'token' or 'substring'")
    left = candidates.join(present, "ngram", "left_anti")
    return left if index_col is None else left.select(index_col)


def substring_containment(candidates: DataFrame, texts: DataFrame, id_col: str = "doc_id",
                          text_col: str = "text_clean", ids: bool = True) -> DataFrame:
    """``(ngram, id)`` for every text whose cleaned string contains the n-gram as a plain
    substring (the reference's containment test), without a cross join. Without ``ids``
    only the n-grams that some text contains.

    :class:`PhraseSearch` looks the candidates' end parts up in the distinct tokens by their
    rarest q-gram, and compares runs of tokens only at the positions of the rarer end.
    """
    # the texts are tokenised once, for the pieces and for the runs
    pieces = materialise(texts.select(id_col, tokenize(F.col(text_col)).alias("pieces")), "pieces")
    found = PhraseSearch(pieces, candidates, "ngram", id_col)
    columns = [F.col("phrase").alias("ngram"), *([id_col] if ids else [])]
    return found.in_pieces().select(*columns).unionByName(found.phrase_runs().select(*columns)).distinct()


def offtopic_filter(candidates: DataFrame, offtopic: DataFrame, mode: str = "absent_from_all",
                    id_col: str = "doc_id", text_col: str = "text_clean") -> DataFrame:
    """Drop candidate n-grams found (as substrings) in off-topic texts.

    ``absent_from_all`` (documented intent) keeps n-grams no off-topic text contains;
    ``absent_from_any`` (what the reference's loop does) keeps n-grams missing from at
    least one off-topic text.
    """
    candidates = materialise(candidates, "candidates")  # looked up, and filtered by what is found
    if mode == "absent_from_all":
        return candidates.join(substring_containment(candidates, offtopic, id_col, text_col, ids=False), "ngram", "left_anti")
    if mode == "absent_from_any":
        hits = substring_containment(candidates, offtopic, id_col, text_col)
        n_off = offtopic.count()
        found = hits.groupBy("ngram").agg(F.count(F.lit(1)).alias("n_in"))
        return (candidates.join(found, "ngram", "left")
                .where(F.coalesce("n_in", F.lit(0)) < n_off).drop("n_in"))
    raise ValueError("mode must be 'absent_from_all' or 'absent_from_any'")


def verified_ngrams(machine: DataFrame, curated: DataFrame) -> DataFrame:
    """Keep machine-found n-grams confirmed by a curated list (semi join)."""
    return machine.join(curated.select("ngram").distinct(), "ngram", "left_semi")
