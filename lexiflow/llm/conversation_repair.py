"""Conversation structure repair with a suffix-shared automaton.

Every row of a conversation is one letter: its role's initial (s, u, a or another) and
whether it must go (blank, duplicate) or is truncated. The letters of a conversation in
order are its signature. A node of the automaton is a distinct end of a signature; it is
built from the end, so conversations that end alike share their nodes. A node holds, for
each state of the grammar ``(s?(ua)+)?``, the cost to go and the first of the best edits
with a link to the node and state behind it; the links are the best audit suffix, shared
as well. Nodes of equal relative costs and letter are one class, worked out once.

How it runs: signatures are made from rows sorted by conversation and turn that stream
through a task (only counters and one letter a row are kept); equal signatures of all
conversations become one row; the distinct ones, turned round, are dealt out by range and
sorted, so that signatures with a common end follow each other and their shared nodes are
on a stack. Rows meet their audit in a second sorted stream, which hashes the repaired
text as it goes. No task holds the texts of a conversation, however long.

A row is a duplicate unless it is the first of its role and text. The first places are an
aggregation with map-side combining; they enter the sorted stream as marker rows just
before the row they name, so a text repeated in a third of all rows is not gathered.

Defined cases: null conversation, turn, role and text count as one space in the hash, role
and text also in the rows; a null conversation is a conversation; rows of one turn are
ordered by role, then MD5 of the text; repeated rows are rows; conversations without rows
after damage have zeros, an empty audit and the hash of nothing; an empty table gives an
empty result; extra columns are not read. Two texts are equal if their MD5 is.
"""

from __future__ import annotations

import hashlib
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import shuffle_partitions, written

SPACES = " \t\n\x0b\x0c\r"

DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: States of the grammar: 0 nothing yet, 1 after s, 2 after u, 3 after a. Ends are 0 and 3.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FREE = ("u", "u", "a", "u")  # the role that Rerole and Insert give in each state
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
FAR = 1 << 60

#: Letters of a signature: initial (o: any other) as lower case, upper case if truncated, x must go.
GONE = "x"
SIGNATURE = "conv_id long, signature string, gaps long, blank long, duplicate long, truncated long, illegal long"


def _ids() -> list:
    return [F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")]


def damaged(rows: DataFrame, modulus: int = 20) -> DataFrame:
    """Rows after the damage that CRC-32 of ``conv_id:turn`` deals: see the module's contract."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % modulus
    text = F.coalesce("text", space)
    return (rows.select(*_ids(), F.coalesce("role", space).alias("role"), text.alias("text"), kind.alias("kind"))
            .where("kind != 0")
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
                    .otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")))


def _place() -> list:
    """Columns that order the rows of a conversation; equal ones belong to equal rows."""
    return ["conv_id", "turn", "role", "md5"]


def _sorted(rows: DataFrame, *order) -> DataFrame:
    n = shuffle_partitions(rows.sparkSession)
    by = [F.col(c).asc_nulls_first() for c in order]
    return rows.repartition(n, "conv_id").sortWithinPartitions(*by)


def signatures(original: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conversation of ``original``: signature and fault counts of its ``rows``."""
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))  # '' if there is no other character
    marked = rows.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("md5"), last.alias("last"))
    place = _place()
    steps = [F.lit(2).alias("step"), F.when(F.col("last") == "", "b").when(F.col("last").isin(".", "!", "?"), "f")
             .otherwise("t").alias("fault")]
    firsts = (marked.groupBy("conv_id", "role", "md5").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("at"))
              .select("conv_id", F.col("at.turn").alias("turn"), "role", "md5", F.lit(1).alias("step"), F.lit("").alias("fault")))
    heads = original.select(_ids()[0]).distinct().select(
        "conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("md5"), F.lit(0).alias("step"), F.lit("").alias("fault"))
    stream = _sorted(heads.unionByName(firsts).unionByName(marked.select(*place, *steps)), *place, "step")
    names = [x.split()[0] for x in SIGNATURE.split(", ")]

    def run(batches):
        state = None
        for batch in batches:
            done = []
            for conv, turn, role, md5, step, fault in zip(*(batch.column(c).to_pylist() for c in (*place, "step", "fault"))):
                if step == 0:
                    if state is not None:
                        done.append(state.row())
                    state = _Reading(conv)
                elif step == 1:
                    state.first = (turn, role, md5)
                else:
                    state.add(turn, role, md5, fault)
            if done:
                yield _rows(done, names)
        if state is not None:
            yield _rows([state.row()], names)

    return stream.mapInArrow(run, SIGNATURE)


def _rows(rows: list, names: list[str]) -> pa.RecordBatch:
    types = [pa.string() if n in ("signature", "audit", "repaired_sha256") else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


class _Reading:
    """Counters and letters of one conversation, row after row in order."""

    def __init__(self, conv):
        self.conv, self.letters, self.first, self.before = conv, bytearray(), None, None
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, role, md5, fault):
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        new = self.first == (turn, role, md5)  # the marker stands just before the row it names
        self.first = None
        letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if self.before is not None and self.before + letter not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = letter
        if fault == "b":
            self.blank, letter = self.blank + 1, GONE
        elif not new:
            self.duplicate, letter = self.duplicate + 1, GONE
        elif fault == "t":
            self.truncated, letter = self.truncated + 1, letter.upper()
        self.letters += letter.encode()

    def row(self):
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, self.letters.decode(), gaps, self.blank, self.duplicate, self.truncated, self.illegal


class Automaton:
    """Costs and best edits of signatures that come sorted by their reverse.

    ``stack[k]`` is the node of the last k letters of the signature in hand. A node is its
    lowest cost and its class: per state the cost above the lowest and the best edit
    (edit letters up to and with the one that uses up the row, state behind it).
    """

    def __init__(self):
        self.classes: dict = {}
        self.known: dict = {}
        over = self._inserted([0 if q in ENDS else FAR for q in range(4)], [""] * 4, [None] * 4)
        self.stack = [(0, self._class(*over))]
        self.letters = ""
        self.built = 0

    def _class(self, costs, edits):
        key = (tuple(costs), tuple(edits))
        return self.classes.setdefault(key, (len(self.classes), *key))

    @staticmethod
    def _inserted(costs, letters, targets):
        """Costs and edits when rows may be inserted first, as often as it pays."""
        best = list(costs)
        for _ in range(4):
            best = [min(best[q], INSERT + best[NEXT[q][FREE[q]]]) for q in range(4)]
        edits = []
        for q in range(4):
            path, at = "", q
            while True:  # of the cheapest edits the one whose initial is least
                own = letters[at] if costs[at] == best[at] else None
                go = NEXT[at][FREE[at]]
                if INSERT + best[go] == best[at] and (own is None or own > "I"):
                    path, at = path + "I", go
                else:
                    break
            edits.append((path + own, targets[at]))
        return best, edits

    def _behind(self, letter: str, child):
        """(cost over the child's lowest, class) of the node of ``letter`` before a node of class ``child``."""
        number, costs, _ = child
        if (letter, number) not in self.known:
            chosen = []
            for q in range(4):
                options = [(DELETE + costs[q], "D", q)]
                if letter != GONE:
                    extra = TRUNCATED * letter.isupper()
                    if letter.lower() in NEXT[q]:
                        go = NEXT[q][letter.lower()]
                        options.append((extra + costs[go], "K", go))
                    go = NEXT[q][FREE[q]]
                    options.append((REROLE + extra + costs[go], "R", go))
                chosen.append(min(options))
            best, edits = self._inserted(*map(list, zip(*chosen)))
            low = min(best)
            self.known[letter, number] = low, self._class([b - low for b in best], edits)
        return self.known[letter, number]

    def repair(self, signature: str) -> tuple[int, str]:
        """(cost, audit); nodes shared with the signature before are not built again."""
        letters = signature[::-1]
        shared = sum(1 for _ in takewhile(lambda x: x[0] == x[1], zip(letters, self.letters)))
        del self.stack[shared + 1:]
        self.letters = letters
        for letter in letters[shared:]:
            low, kind = self.stack[-1]
            more, kind = self._behind(letter, kind)
            self.stack.append((low + more, kind))
            self.built += 1
        low, kind = self.stack[-1]
        cost, audit, q = low + kind[1][0], [], 0
        for _, kind in reversed(self.stack):
            edit, q = kind[2][q]
            audit.append(edit)
        return cost, "".join(audit)


def repairs(signature_table: DataFrame) -> DataFrame:
    """(signature, cost, audit) of the distinct signatures of all conversations."""
    n = shuffle_partitions(signature_table.sparkSession)
    turned = F.reverse("signature")
    rows = (signature_table.select("signature").distinct().repartitionByRange(n, turned).sortWithinPartitions(turned))

    def run(batches):
        automaton = Automaton()
        for batch in batches:
            got = [(s, *automaton.repair(s)) for s in batch.column(0).to_pylist()]
            if got:
                yield _rows(got, ["signature", "cost", "audit"])

    return rows.mapInArrow(run, "signature string, cost long, audit string")


class _Repair:
    """Turns the rows of one conversation, in order, into those of the repaired one."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _free(self) -> str:
        role = FREE[self.state]
        self.state = NEXT[self.state][role]
        return ROLES[role]

    def inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._free(), ""

    def step(self, role: str, text: str):
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = NEXT[self.state][role[0]]
            yield role, text
        elif edit == "R":
            yield self._free(), text


def _stream(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows in order, each conversation's audit before them (step 0)."""
    body = rows.select(*_place()[:3], F.md5(F.col("text").cast("binary")).alias("md5"), "text", F.lit(1).alias("step"))
    none = F.lit(None).cast("string")
    heads = audits.select("conv_id", F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("md5"),
                          F.col("audit").alias("text"), F.lit(0).alias("step"))
    return _sorted(heads.unionByName(body), "conv_id", "step", "turn", "role", "md5").select("conv_id", "turn", "role", "text", "step")


def repaired_rows(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, position, turn, role, text) of the repaired conversations; inserted rows have no turn."""
    def run(batches):
        conv = repair = None
        position = 0
        for batch in batches:
            out = []
            for c, turn, role, text, step in zip(*(x.to_pylist() for x in batch.columns)):
                if step == 0:
                    if repair is not None:
                        out += [(conv, position + i, None, r, t) for i, (r, t) in enumerate(repair.inserted())]
                    conv, repair, position = c, _Repair(text), 0
                    continue
                for r, t in repair.inserted():
                    out.append((conv, position, None, r, t))
                    position += 1
                for r, t in repair.step(role, text):
                    out.append((conv, position, turn, r, t))
                    position += 1
            if out:
                yield _table(out)
        if repair is not None and (out := [(conv, position + i, None, r, t) for i, (r, t) in enumerate(repair.inserted())]):
            yield _table(out)

    def _table(out):
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                          names=["conv_id", "position", "turn", "role", "text"])

    return _stream(rows, audits).mapInArrow(run, "conv_id long, position long, turn long, role string, text string")


def _hashes(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256), hashed row by row."""
    def run(batches):
        conv = repair = sha = None
        n = 0

        def feed(pairs):
            nonlocal n
            for role, text in pairs:
                sha.update((f"\n{role}:{text}" if n else f"{role}:{text}").encode())
                n += 1

        for batch in batches:
            done = []
            for c, role, text, step in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text", "step"))):
                if step:
                    feed(repair.step(role, text))
                    continue
                if repair is not None:
                    feed(repair.inserted())
                    done.append((conv, sha.hexdigest()))
                conv, repair, sha, n = c, _Repair(text), hashlib.sha256(), 0
            if done:
                yield _rows(done, ["conv_id", "repaired_sha256"])
        if repair is not None:
            feed(repair.inserted())
            yield _rows([(conv, sha.hexdigest())], ["conv_id", "repaired_sha256"])

    return _stream(rows, audits).mapInArrow(run, "conv_id long, repaired_sha256 string")


def audits_of(original: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conversation of ``original``: fault counts, cost and audit of its ``rows``."""
    table = written(signatures(original, rows), "signatures")
    return table.join(repairs(table), "signature").drop("signature")


def repair_conversations(original: DataFrame) -> DataFrame:
    """The repaired rows of conversations that are taken as they are."""
    space = F.lit(" ")
    rows = original.select(*_ids(), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    return repaired_rows(rows, audits_of(original, rows))


def repair_report(original: DataFrame) -> DataFrame:
    """Damage, then one row per conversation: counts, cost, audit and hash of the repaired rows."""
    rows = damaged(original)
    audits = written(audits_of(original, rows), "audits")
    hashes = _hashes(rows, audits)
    return (audits.withColumnRenamed("conv_id", "__conv").join(hashes, F.col("__conv").eqNullSafe(F.col("conv_id")))
            .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
