"""Conversation repair against an exhaustive search and a plain version."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from lexiflow.llm import conversation_repair as C
from lexiflow.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
GIVES = "uuau"


def cheapest(rows):
    """(cost, audit) of [(initial, fault)]: whole (cost, audit) pairs are compared."""
    @lru_cache(None)
    def go(i, q, inserts):
        found = []
        if i == len(rows) and q in (0, 3):
            found.append((0, ""))
        if inserts < 4:
            c, a = go(i, STEP[q, GIVES[q]], inserts + 1)
            found.append((c + 3, "I" + a))
        if i < len(rows):
            initial, fault = rows[i]
            c, a = go(i + 1, q, 0)
            found.append((c + 4, "D" + a))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (q, initial) in STEP:
                    c, a = go(i + 1, STEP[q, initial], 0)
                    found.append((c + more, "K" + a))
                c, a = go(i + 1, STEP[q, GIVES[q]], 0)
                found.append((c + more + 3, "R" + a))
        return min(found, default=(10 ** 9, ""))
    for i in range(len(rows), 0, -1):  # from the end, so that no call goes deep
        for q in range(4):
            go(i, q, 0)
    return go(0, 0, 0)


def brute(rows):
    """Rows of the report, from plain Python over all (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        out = convs.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    report = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, letters = set(), []
        for _, role, text in own:
            bare = text.rstrip(SPACES)
            fault = ("blank" if not bare else "duplicate" if (role, text) in seen else
                     "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
            letters.append((role[:1], fault))
        cost, audit = cheapest(tuple(letters))
        q, out, at = 0, [], iter(own)
        for edit in audit:
            if edit == "I":
                role, text = {"u": "user", "a": "assistant"}[GIVES[q]], ""
            else:
                _, role, text = next(at)
                if edit == "D":
                    continue
                role = {"u": "user", "a": "assistant"}[GIVES[q]] if edit == "R" else role
            q = STEP[q, role[0]]
            out.append(f"{role}:{text}")
        turns = {t for t, _, _ in own if t is not None}
        faults = [f for _, f in letters]
        pairs = zip(letters, letters[1:])
        report.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"),
                       faults.count("duplicate"), faults.count("truncated"),
                       sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in pairs), cost, audit,
                       hashlib.sha256("\n".join(out).encode()).hexdigest()))
    return report


def compare(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in C.repair_report(docs).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    return got


def made_up(seed, n=300):
    rng = random.Random(seed)
    roles = ["user"] * 5 + ["assistant"] * 5 + ["system", "tool", "", "usher", None]
    texts = ["Yes.", "No!", "Why?", "cut off", "end. \n", "\x0b", "", None, "é。", "x.\xa0", "a? b"]
    rows = []
    for conv in [*range(n), None]:
        for _ in range(rng.choice((1, 2, 3, 5, 8, 20))):
            rows.append((conv, rng.choice((None, *range(12))), rng.choice(roles), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_report_matches_plain_version(spark, seed):
    rows = made_up(seed)
    got = compare(spark, rows + rows[:40])  # repeated rows are rows
    assert any(not r[7] for r in got) and len({r[7] for r in got}) > 50


def test_every_short_signature_against_all_edit_strings():
    """Costs and audits of all signatures up to 3 letters by trying every edit string."""
    letters = ["s", "u", "a", "o", "U", "A", "x"]
    signatures = ["".join(x) for k in range(4) for x in itertools.product(letters, repeat=k)]
    automaton = C.Automaton()
    for signature in sorted(signatures, key=lambda s: s[::-1]):
        best = None
        for audit in _edit_strings(len(signature)):
            cost, done, at = 0, "", 0
            for e in audit:
                if e == "I":
                    cost, done = cost + 3, done + GIVES[_state(done)]
                    continue
                letter, at = signature[at], at + 1
                if e == "D":
                    cost += 4
                    continue
                if letter == "x":
                    break
                cost += 3 * letter.isupper() + 3 * (e == "R")
                done += GIVES[_state(done)] if e == "R" else letter.lower()
                if _state(done) is None:
                    break
            else:
                if re.fullmatch("(s?(ua)+)?", done) and (best is None or (cost, audit) < best):
                    best = cost, audit
        assert automaton.repair(signature) == best, signature


def _state(done):
    q = 0
    for x in done:
        q = STEP.get((q, x))
        if q is None:
            return None
    return q


def _edit_strings(n):
    slots = [("", "I", "II")] * (n + 1)
    for inserts in itertools.product(*slots):
        for edits in itertools.product("DKR", repeat=n):
            yield "".join(i + e for i, e in zip(inserts, (*edits, "")))


def test_ends_are_shared():
    """Nodes of common ends are built once."""
    rng = random.Random(3)
    tail = "".join(rng.choice("uaUAx") for _ in range(500))
    signatures = sorted({"".join(rng.choice("suax") for _ in range(3)) + tail for _ in range(60)}, key=lambda s: s[::-1])
    automaton = C.Automaton()
    for s in signatures:
        assert automaton.repair(s) == cheapest(tuple((x.lower() if x != "x" else "", {True: "truncated", False: ""}[x.isupper()]
                                                      if x != "x" else "blank") for x in s))
    assert automaton.built <= 500 + 3 * len(signatures)


def test_long_conversation_and_empty_table(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"text {t % 700}.") for t in range(1500)] + [(2, 0, "user", "Hello.")]
    got = compare(spark, rows)
    assert max(len(r[7]) for r in got) > 1300
    assert C.repair_report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert C.repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repaired_rows_follow_the_grammar(spark):
    rows = made_up(9, 60)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("position", C.F.lit("x")).withColumn("step", C.F.lit(1))
    got = C.repair_conversations(docs).collect()
    convs = {}
    for r in sorted(got, key=lambda r: (repr(r.conv_id), r.position)):
        convs.setdefault(r.conv_id, []).append(r.role[:1])
    assert len(convs) > 30
    assert all(re.fullmatch("s?(ua)+", "".join(x)) for x in convs.values())


def test_registered_query_reads_all_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()]
    got = QUERIES["op13_conversation_repair"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))
