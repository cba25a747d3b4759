"""Quality classifier: hierarchical empirical Bayes over sites and paths.

A naive Bayes classifier over binned text counts gives each document's own evidence (log
odds). Grouped aggregation of the labels gives the share of good documents of each site
(host) and of each path below it. Sparse sites are shrunk toward the global share and
sparse paths toward their site, with strengths estimated from the spread between groups
(method of moments); the path's posterior is the prior of its documents. A labelled
document never counts in its own prior.

Labels of held-out documents (crc32 of the id as text, modulo 4, is 2) are not used.

Defined cases: null or empty text has zero counts; a null site or path is a group of its
own; without labels every prior is one half and there is no evidence; null labels are
ignored; repeated rows get a row each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import written
from lexiflow.llm.lang_id import held_out
from lexiflow.llm.quality_rules import RULES, rule_counts

BINS = 16
#: Bins for ratios above the limit from which the rule of the ratio calls them bad.
ABOVE = 3
STRENGTH = (1.0, 1000.0)


def _bins() -> Column:
    """Array of one bin number for each count ratio (0 .. BINS - 1): octaves of the ratio over its bad limit."""
    return F.expr("array(" + ", ".join(
        f"cast(greatest(0, least({BINS - 1}, {ABOVE} + floor(-log2(greatest({x}, 0D) / {bad}D + pow(2, {ABOVE - BINS + 1}))))) as int)"
        for _, x, _, bad in RULES) + ")")


def evidence_weights(train: DataFrame) -> dict[tuple[int, int], float]:
    """Log odds of each (ratio, bin) by smoothed counts; at most ratios x bins rows reach the driver."""
    rows = (train.select("label", F.posexplode("bins").alias("f", "b")).groupBy("f", "b")
            .agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).collect())
    total: dict[int, list[int]] = {}
    for r in rows:
        t = total.setdefault(r["f"], [0, 0])
        t[0], t[1] = t[0] + r["good"], t[1] + r["n"] - r["good"]
    return {(r["f"], r["b"]): math.log((r["good"] + 1) / (total[r["f"]][0] + BINS))
            - math.log((r["n"] - r["good"] + 1) / (total[r["f"]][1] + BINS)) for r in rows}


def _strength(groups: DataFrame, mean: Column | float) -> float:
    """Pseudo-count of the prior, from the spread of the groups' shares about their prior means."""
    m = F.lit(mean) if isinstance(mean, float) else mean
    r = groups.select(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - m, 2)).alias("spread"),
        F.sum(m * (1 - m)).alias("within"), F.sum(F.col("n") * m * (1 - m)).alias("scale"),
        F.count(F.lit(1)).alias("k")).first()
    if not r["k"] or not r["scale"]:
        return STRENGTH[0]
    # E[spread] = within + (scale - within) / (1 + strength)
    rho = (r["spread"] - r["within"]) / max(r["scale"] - r["within"], 1e-9)
    return min(STRENGTH[1], max(STRENGTH[0], 1 / rho - 1 if rho > 0 else STRENGTH[1]))


def quality_classifier(docs: DataFrame, labels: DataFrame, site: Column, path: Column, id_col: str = "doc_id",
                       text_col: str = "text", label_col: str = "quality", threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, evidence, p_site, p_path, p_good, kept."""
    named = docs.select(F.struct(F.col(id_col), site.alias("site"), path.alias("path")).alias("key"),
                        F.col(text_col).alias("text"))
    counted = rule_counts(named, "key", "text").select("doc_id.*", _bins().alias("bins"))
    marks = (labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__label_id"))
             .agg(F.max(F.col(label_col).cast("long")).alias("label")))
    rows = counted.withColumn("held_out", held_out(id_col))
    rows = rows.join(marks, F.col(id_col) == F.col("__label_id"), "left").drop("__label_id")
    rows = written(rows.withColumn("label", F.when(~F.col("held_out"), F.col("label"))), "quality")
    train = rows.where("label is not null")
    weights = evidence_weights(train)
    totals = train.agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).first()
    mean = ((totals["good"] or 0) + 0.5) / (totals["n"] + 1)
    paths = written(train.groupBy("site", "path").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")), "paths")
    sites = written(paths.groupBy("site").agg(F.sum("good").alias("site_good"), F.sum("n").alias("site_n")), "sites")
    k_site = _strength(sites.select(F.col("site_good").alias("good"), F.col("site_n").alias("n")), mean)
    same_site = F.col("site").eqNullSafe(F.col("__site"))
    sites = sites.withColumnRenamed("site", "__site")
    site_mean = (F.col("site_good") + mean * k_site) / (F.col("site_n") + k_site)
    k_path = _strength(paths.join(sites, same_site), site_mean)
    paths = paths.select(F.col("site").alias("__psite"), "path", F.col("good").alias("path_good"),
                         F.col("n").alias("path_n")).withColumnRenamed("path", "__path")
    table = F.array(*[F.array(*[F.lit(weights.get((f, b), 0.0)) for b in range(BINS)]) for f in range(len(RULES))])
    evidence = F.aggregate(F.transform("bins", lambda b, f: F.element_at(F.element_at(table, f + 1), b + 1)),
                           F.lit(0.0), lambda a, b: a + b)
    out = (rows.join(sites, same_site, "left")
           .join(paths, F.col("site").eqNullSafe(F.col("__psite")) & F.col("path").eqNullSafe(F.col("__path")), "left"))
    own, one = F.coalesce(F.col("label"), F.lit(0)), F.col("label").isNotNull().cast("long")
    number = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("site_good", "site_n", "path_good", "path_n")}
    p_site = (number["site_good"] - own + mean * k_site) / (number["site_n"] - one + k_site)
    p_path = (number["path_good"] - own + F.col("p_site") * k_path) / (number["path_n"] - one + k_path)
    out = (out.withColumn("evidence", evidence).withColumn("p_site", p_site).withColumn("p_path", p_path)
           .withColumn("p_good", F.expr("1 / (1 + exp(-(evidence + ln(p_path / (1 - p_path)))))")))
    return out.select(F.col(id_col).alias("doc_id"), "held_out", "evidence", "p_site", "p_path", "p_good",
                      (F.col("p_good") >= threshold).alias("kept"))
