"""Token counts from an exact histogram of encoded lengths.

Documents are counted by encoded length; running sums over the histogram then answer, for
every context limit, how many documents are longer, how many tokens are left when texts
are cut at the limit, and which quantile the limit is. The histogram has a row for each
length that occurs, so its size follows the longest text and not the number of texts.

Running sums are taken in two levels (within blocks of ``BLOCK`` lengths, then over the
blocks), so that no task reads the whole histogram.

Defined cases: null text counts as empty (length 0); repeated rows count each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import written
from lexiflow.llm.tokens import token_table

BLOCK = 1024


def length_histogram(docs: DataFrame, text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """(context_limit, n_docs): documents of each encoded length."""
    return (token_table(docs, text_col, ranks_path).groupBy(F.col("n_tokens").alias("context_limit"))
            .agg(F.count(F.lit(1)).alias("n_docs")))


def token_counts(docs: DataFrame, text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """One row per length that occurs, as a context limit.

    n_docs of that length, n_docs_longer, n_tokens_up_to (in texts that fit), n_tokens_cut
    (total when longer texts are cut at the limit), n_tokens_total and quantile (share of
    the documents that fit). Between two limits the totals are linear in the limit.
    """
    hist = written(length_histogram(docs, text_col, ranks_path)
                   .withColumn("block", F.floor(F.col("context_limit") / BLOCK)), "lengths")
    sums = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.expr("n_docs * context_limit")).alias("t"))
    over = Window.orderBy("block")  # a row for each 1024 lengths
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.select("block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("d", "t")],
                         *[F.sum(c).over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"{c}_all")
                           for c in ("d", "t")])
    inner = Window.partitionBy("block").orderBy("context_limit")
    up_to = {"d": F.sum("n_docs").over(inner) + F.col("d_before"),
             "t": F.sum(F.expr("n_docs * context_limit")).over(inner) + F.col("t_before")}
    return (hist.join(blocks, "block").select("context_limit", "n_docs", "d_all", "t_all",
                                              up_to["d"].alias("d"), up_to["t"].alias("n_tokens_up_to"))
            .select("context_limit", "n_docs", (F.col("d_all") - F.col("d")).alias("n_docs_longer"), "n_tokens_up_to",
                    F.expr("n_tokens_up_to + (d_all - d) * context_limit").alias("n_tokens_cut"),
                    F.col("t_all").alias("n_tokens_total"), (F.col("d") / F.col("d_all")).alias("quantile")))
