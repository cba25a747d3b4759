"""The stemmer as SQL equals the plain one, on Spark and on DuckDB."""

import random

import duckdb

from lexiflow.functions import stemming as SQL
from lexiflow.functions import snowball as S
from lexiflow.functions.snowball import stem
from test_snowball import SAMPLES


def words():
    rng = random.Random(4)
    ends = [a for a, _ in S.STEP2 + S.STEP3] + list(S.STEP4) + ["ed", "ing", "eed", "eedly", "ingly", "edly", "s", "'s", "'s'", "'", "ies",
                                                               "ied", "sses", "us", "ss", "y", "e", "l", "ll", "ying", "bly"]
    made = {"".join(rng.choice("aeiouybcdlnrstvwxz") for _ in range(rng.randint(0, 6))) + "".join(rng.sample(ends, rng.randint(0, 2)))
            for _ in range(6000)}
    made |= {"".join(rng.choice("ayY'-9b") for _ in range(rng.randint(1, 8))).lower() for _ in range(800)}
    return sorted(made | set(SAMPLES) | set(S.EXCEPTIONS) | set(S.AFTER_1A) | {f"{p}{e}" for p in S.R1_PREFIXES for e in ends} - {""})


def test_spark_steps_equal_the_plain_stemmer(spark):
    want = {w: stem(w) for w in words() if w}
    frame = spark.createDataFrame([(w,) for w in want] + [(None,)], "w string")
    got = {r.term: r.stem for r in SQL.stem_terms(frame, "w").collect()}
    assert got.pop(None) is None
    assert {w: (got[w], s) for w, s in want.items() if got[w] != s} == {}


def test_duckdb_steps_equal_the_plain_stemmer():
    want = {w: stem(w) for w in words() if w}
    con = duckdb.connect()
    con.execute("CREATE TABLE v(term VARCHAR)")
    con.executemany("INSERT INTO v VALUES (?)", [[w] for w in list(want)[:1500]])
    got = dict(con.execute(f"WITH {SQL.stem_ctes('v')} SELECT term, stem FROM stems").fetchall())
    assert {w: (g, want[w]) for w, g in got.items() if g != want[w]} == {}
