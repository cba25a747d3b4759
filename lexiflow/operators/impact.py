"""Impact-ordered index of document vectors and exact top-k retrieval with pruning.

The impact of a term in a document is its weight over the norm of the document. Postings
are cut in blocks of nearly equal impact (``PER_OCTAVE`` levels for each halving), a level
of a frequent term in several by document hash, and each block keeps its largest impact.
A frequent term is therefore many rows that any task may hold, never one list.

Retrieval of the ``k`` documents with the highest ``sum(c_t * impact)`` of a query:

* the k-th largest impact of a term (a lower bound of it comes from the level counts) times
  ``c_t`` is reached by k documents, so the largest of these products over the query's terms
  is a threshold that every wanted document reaches;
* let ``top_t`` be the largest impact of a term and cut the terms in two parts, the first of
  which are open. A wanted document with an open term t has there at least what the
  threshold leaves when all other terms give their most. One without any open term has, for
  some other term, at least ``top_t * threshold / sum(c * top)`` over the terms not open, or
  does not exist if that sum is below the threshold. The level counts tell how many postings
  a cut would read; terms are opened in the order of their frequency, as far as pays best;
* only blocks whose largest impact reaches the term's bound are read, and only their postings
  that do become candidates;
* candidates get all terms of the query by a join on (term, document).

Nothing is dropped that could be wanted; the weights must not be negative.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiflow.session import materialise, own_exchange

BLOCK = 256
PER_OCTAVE = 4
#: Scores are compared with nine decimals; a threshold this much lower keeps all ties.
SLACK = 1e-8


class ImpactIndex:
    """``blocks`` (term, level, block, top, low, n, postings) and ``impacts`` (id, term, impact), both written."""

    def __init__(self, doc_weights: DataFrame, id_col: str = "doc_id", block: int = BLOCK, normalised: bool = False):
        self.id_col = id_col
        rows = doc_weights.where(F.col("weight") > 0).select(id_col, "term", "weight")
        if normalised:
            rows = rows.withColumnRenamed("weight", "impact")
        else:
            norms = rows.groupBy(id_col).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
            rows = rows.join(own_exchange(norms), id_col).select(id_col, "term", (F.col("weight") / F.col("_norm")).alias("impact"))
        self.impacts = materialise(rows, "impacts")
        level = F.floor(-F.log2("impact") * PER_OCTAVE).cast("int")
        levels = self.impacts.withColumn("level", level)
        long_ones = levels.groupBy("term", "level").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block) \
            .select("term", "level", F.ceil(F.col("_n") / block).alias("_cuts"))
        dealt = levels.join(own_exchange(long_ones), ["term", "level"], "left") \
            .withColumn("block", F.coalesce(F.pmod(F.xxhash64(id_col), F.col("_cuts")), F.lit(0)))
        self.blocks = materialise(
            dealt.groupBy("term", "level", "block").agg(
                F.max("impact").alias("top"), F.min("impact").alias("low"), F.count(F.lit(1)).alias("n"),
                F.collect_list(F.struct(id_col, "impact")).alias("postings")), "impact-blocks")  # about BLOCK of them

    def term_levels(self, k: int) -> DataFrame:
        """``(term, df, top, kth, levels)``: frequency, largest impact, one that at least ``k`` documents reach (0 if
        there are not k), and the documents so far (``n``) down to each level, with the level's largest impact."""
        levels = self.blocks.groupBy("term", "level").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.min("low").alias("low"))
        so_far = Window.partitionBy("term").orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return (levels.withColumn("so_far", F.sum("n").over(so_far)).groupBy("term")  # a term has few levels
                .agg(F.sum("n").alias("df"), F.max("top").alias("top"),
                     F.coalesce(F.max(F.when(F.col("so_far") >= k, F.col("low"))), F.lit(0.0)).alias("kth"),
                     F.collect_list(F.struct("top", F.col("so_far").alias("n"))).alias("levels")))

    def query_terms(self, query_weights: DataFrame, k: int) -> DataFrame:
        """``(query, term, c, need)``: the factor of each term and the impact from which its postings matter."""
        positive = query_weights.where(F.col("weight") > 0)
        norms = positive.groupBy("query").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
        terms = positive.join(own_exchange(norms), "query").join(own_exchange(self.term_levels(k)), "term") \
            .withColumn("c", F.col("weight") / F.col("_norm"))
        of_query = terms.groupBy("query").agg(
            (F.max(F.col("c") * F.col("kth")) - SLACK).alias("at"), F.sum(F.col("c") * F.col("top")).alias("most"),
            F.array_sort(F.collect_list(F.struct("df", "term", "c", "top", "levels"))).alias("ts"))
        cuts = of_query.withColumn("cuts", F.expr("""
            transform(filter(sequence(0, size(ts)), i -> i = size(ts) OR i & (i - 1) = 0), i -> named_struct(
                'open', i, 'rest', aggregate(slice(ts, i + 1, size(ts)), 0D, (sum, t) -> sum + t.c * t.top)))"""))
        needs = cuts.withColumn("needs", F.expr("""
            transform(cuts, o -> transform(ts, (t, j) -> CASE WHEN j < o.open THEN (at - most + t.c * t.top) / t.c
                WHEN o.rest < at THEN double('infinity') ELSE t.top * at / o.rest END))"""))
        best = needs.select("query", "ts", F.expr("""
            array_min(transform(needs, x -> named_struct('cost', aggregate(zip_with(ts, x, (t, need) ->
                coalesce(array_max(transform(filter(t.levels, l -> l.top >= need), l -> l.n)), 0L)), 0L, (sum, n) -> sum + n),
                'needs', x))).needs""").alias("needs"))
        return best.select("query", F.explode(F.arrays_zip(F.col("ts").alias("t"), F.col("needs").alias("need"))).alias("z")) \
            .select("query", "z.t.term", "z.t.c", "z.need")

    def candidates(self, query_terms: DataFrame) -> DataFrame:
        """``(query, id)`` pairs that may be among the best."""
        opened = (self.blocks.select("term", "top", "postings").join(own_exchange(query_terms.select("query", "term", "need")), "term")
                  .where(F.col("top") >= F.col("need"))
                  .select("query", "need", F.explode(F.expr("filter(postings, p -> p.impact >= need)")).alias("p")))
        return opened.select("query", F.col(f"p.{self.id_col}").alias(self.id_col)).distinct()

    def best(self, query_weights: DataFrame, k: int) -> DataFrame:
        """``(query, id, score)``: the ``k`` documents of the highest cosine similarity (nine decimals, ties by id)."""
        terms = materialise(self.query_terms(query_weights, k), "query-terms")
        wanted = self.candidates(terms).join(own_exchange(terms.select("query", "term", "c")), "query")
        scored = (self.impacts.join(wanted, [self.id_col, "term"])
                  .groupBy("query", self.id_col).agg(F.sum(F.col("c") * F.col("impact")).alias("score")))
        place = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), F.asc(self.id_col))
        return scored.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= k).drop("_place")
