"""ln Γ column against math.lgamma and golden keyword log-likelihoods."""

import math

from pyspark.sql import functions as F

from lexiflow.functions.mathx import ln_beta, ln_gamma

# Fixed values from a published keyword table (|T| = 5, |S\T| = 6411; counts are
# the table's percentages back to documents): (n_t, n_st, ll).
GOLDEN = [
    (2, 19, -41.699164553204525),
    (2, 21, -41.97120661732608),
    (1, 10, -45.52813834091168),
]


def test_ln_gamma_matches_math(spark):
    xs = [0.5, 1, 1.5, 2, 3, 7.9, 8, 10, 33.3, 1000, 123456.5]
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = [r[0] for r in df.select(ln_gamma(F.col("x"))).collect()]
    for x, g in zip(xs, got):
        assert abs(g - math.lgamma(x)) < 1e-9 * max(1.0, abs(math.lgamma(x)))


def test_golden_log_likelihood(spark):
    nt, nst = 5, 6411
    df = spark.createDataFrame([(a, b) for a, b, _ in GOLDEN], "n1 long, n0 long")
    ll = ln_beta(F.col("n1") + 1, F.col("n0") + 1) + ln_beta(F.lit(nt) - F.col("n1") + 1,
                                                            F.lit(nst) - F.col("n0") + 1)
    got = [r[0] for r in df.select(ll).collect()]
    for (_, _, want), g in zip(GOLDEN, got):
        assert abs(g - want) < 1e-6
