"""Quality rules combined by weak supervision, all in DataFrame operations.

Each rule votes good (1) or bad (-1) or abstains (0). Expectation-maximisation
estimates how often each rule is right from the counts of the vote patterns of all
documents (at most 3 ** rules patterns, whatever the number of documents), and the
posterior probability of "good" replaces the filter that wants every rule passed.

Defined cases: null or empty text has no words and fails the base rules; repeated rows
and null ids give a row each; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import SPACE_CLASS, words_of, written

WINDOW = 8
LEAST_ON_GOOD = 0.99
#: (rule, share expression, good at or below, bad above); the rule abstains in between.
RULES = (
    ("short", "1.0 / greatest(n_words, 1)", 0.02, 0.05),
    ("symbols", "n_symbols / greatest(n_words, 1)", 0.02, 0.10),
    ("dup_lines", "n_dup_lines / greatest(n_lines, 1)", 0.05, 0.30),
    ("repeats", "n_repeat_words / greatest(n_words, 1)", 0.10, 0.30),
    ("capitals", "n_upper / greatest(n_letters, 1)", 0.15, 0.50),
    ("shouting", "n_shouts / greatest(n_words, 1)", 0.03, 0.20),
    ("long_words", "word_chars / greatest(n_words, 1)", 12.0, 20.0),
    ("few_letters", "1.0 - n_letters / greatest(word_chars, 1)", 0.15, 0.35),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts that the rules read, one row per document.

    Windows of eight words are hashed by doubling (1, 2, 4, 8 words), so each word costs
    a constant number of steps; only texts with a repeated window sort their hashes.
    """
    t = F.coalesce(F.col("__q_text"), F.lit(""))

    def without(regex):
        return F.length(F.regexp_replace(t, regex, ""))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__q_text"))
    rows = rows.select(
        "doc_id", words_of(t).alias("w"),
        without(SPACE_CLASS).cast("long").alias("word_chars"),
        (F.length(t) - without("[#*$%&|<>]+")).cast("long").alias("n_symbols"),
        (F.length(t) - without("[\\p{Lu}]+")).cast("long").alias("n_upper"),
        (F.length(t) - without("[\\p{L}]+")).cast("long").alias("n_letters"),
        (F.length(t) - without("!+")).cast("long").alias("n_shouts"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]")).alias("lines"))
    rows = rows.select(
        "*", F.size("w").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h1")).drop("w", "lines")
    for k in (1, 2, 4):  # h(2k)[i] = hash(h(k)[i], h(k)[i + k])
        rows = rows.withColumn(f"h{2 * k}", F.expr(
            f"zip_with(h{k}, slice(h{k}, {k + 1}, greatest(size(h{k}), 1)), (a, b) -> xxhash64(a, b))")).drop(f"h{k}")
    rows = rows.withColumn("h", F.expr(f"slice(h8, 1, greatest(cast(n_words as int) - {WINDOW - 1}, 0))")).drop("h8")
    # (hash, position) in order of hash; empty where no window repeats
    rows = rows.withColumn("s", F.expr(
        "sort_array(transform(if(size(array_distinct(h)) < size(h), h, slice(h, 1, 0)), (x, i) -> struct(x as h, i as i)))")).drop("h")
    rows = rows.withColumn("e", F.expr(
        "zip_with(s, slice(s, 2, greatest(size(s), 1)), (a, b) -> coalesce(a.h = b.h, false))"))
    rows = rows.withColumn("f", F.expr("concat(array(false), e)"))
    rows = rows.withColumn("p", F.expr(
        "sort_array(transform(filter(arrays_zip(s, e, f), x -> x.s is not null and (x.e or x.f)), x -> x.s.i))")).drop("s", "e", "f")
    return rows.withColumn("n_repeat_words", F.expr(
        f"aggregate(zip_with(p, slice(p, 2, greatest(size(p), 1)), (a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))), 0L, (x, y) -> x + y)")).drop("p")


def votes(counts: DataFrame) -> DataFrame:
    """Add vote_<rule> (1, 0, -1) for each rule."""
    return counts.withColumns({
        f"vote_{name}": F.expr(f"CASE WHEN {x} <= {good} THEN 1 WHEN {x} > {bad} THEN -1 ELSE 0 END")
        for name, x, good, bad in RULES})


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[tuple[float, float]]]:
    """(share of good documents, accuracies of each rule) by EM over counted vote patterns.

    A rule has two accuracies: how often its vote is right on good documents and on bad
    ones; abstentions say nothing. The rules look for defects that good documents seldom
    have, so the first accuracy is at least ``LEAST_ON_GOOD``: a rule that objects more
    often has found bad documents, even if no other rule sees their defect. Pseudo-counts
    anchor the signs (95 of 100 right on good documents, 4 of 10 on bad ones).
    """
    k = len(patterns[0][0]) if patterns else len(RULES)
    prior, acc = 0.85, [(0.95, 0.4)] * k
    for _ in range(rounds):
        good, total = 8.5, 10.0
        right, cast = [[95.0, 4.0] for _ in range(k)], [[100.0, 10.0] for _ in range(k)]
        for vote, n in patterns:
            p = posterior(vote, prior, acc)
            good, total = good + n * p, total + n
            for r, v in enumerate(vote):
                if v:
                    cast[r][0] += n * p
                    cast[r][1] += n * (1 - p)
                    right[r][v < 0] += n * (p if v > 0 else 1 - p)
        prior = min(0.99, max(0.01, good / total))
        acc = [(min(0.999, max(LEAST_ON_GOOD, a[0] / b[0])), min(0.999, max(0.001, a[1] / b[1])))
               for a, b in zip(right, cast)]
    return prior, acc


def weights(acc: tuple[float, float]) -> tuple[float, float]:
    """Log odds for "good" that a rule's good vote and its bad vote add; never against the vote."""
    on_good, on_bad = acc
    return max(0.0, math.log(on_good / (1 - on_bad))), min(0.0, math.log((1 - on_good) / on_bad))


def posterior(vote, prior: float, acc) -> float:
    x = math.log(prior / (1 - prior))
    for v, a in zip(vote, acc):
        if v:
            x += weights(a)[v < 0]
    return 1 / (1 + math.exp(-x))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = 0.5) -> DataFrame:
    """doc_id, n_words and the other counts, base_failed, p_good, kept."""
    names = [f"vote_{r[0]}" for r in RULES]
    voted = written(votes(rule_counts(docs, id_col, text_col)), "votes")
    found = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("__q_n")).collect()  # 3 ** rules rows at most
    prior, acc = estimate(sorted((tuple(r[c] for c in names), r["__q_n"]) for r in found))
    x = F.lit(math.log(prior / (1 - prior)))
    for c, a in zip(names, acc):
        up, down = weights(a)
        x = x + F.when(F.col(c) > 0, F.lit(up)).when(F.col(c) < 0, F.lit(down)).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
    return (voted.withColumn("base_failed", failed).withColumn("p_good", p)
            .withColumn("kept", ~failed & (p >= threshold))
            .select("doc_id", *COUNTS, "base_failed", "kept", "p_good"))
