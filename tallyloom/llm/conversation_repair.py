"""Conversation structure repair: the cheapest edits by scalar big-integer weights.

The weight of a list of edits is one integer. Its high digits are the cost; below them stands a fixed
number of 3-bit digits, one for each edit in order (D, I, K, R are 1 to 4), padded with zeros at the end.
Comparing two such integers compares the costs, then the audits as ASCII strings, so an ordinary
integer-minimum dynamic program over the rows (a DAG whose nodes are row, automaton state and whether the
gap has its insertion) decides everything. Two insertions into one gap never pay: they can be left out
where they close an ``ua``, and a lone ``s`` is cheaper deleted; so a gap has one at most.

Spark damages the rows, judges blank and truncated rows and hashes what duplicates share in plain
column expressions. Then one shuffle by conversation: every row goes twice, once as a few bytes of facts
and once with its text, and the facts of a conversation sort before its texts. A task decides from
the facts, then hashes the texts as they pass by. So a task holds no texts, and of a conversation only its
facts and its audit, which the contract makes one value of the result anyhow; SHA-256 of the whole repaired
conversation reads it in order by definition.

Defined cases: a null role, text, turn or conv_id reads as one space where text is made of it; turns
sort nulls first, rows of one turn by role, then by the MD5 digest of their text, as they were before damage.
Rows without a conv_id are one conversation with a null id. A role that does not begin with s, u or a cannot
be kept. Repeated rows are duplicates like any other. An empty table gives an empty result. Other
columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import table
from tallyloom.llm.conversation_sql import REPAIR_SQL
from tallyloom.llm.registry import query

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
PERIOD = 20
#: Costs: another role, a deletion, an insertion, and what a truncated row that stays costs besides.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the automaton for (s?(ua)+)?: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state that a row of a chosen role leads to, and that role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
LETTERS = ".DIKR"
OUT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def cheapest(facts: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """(cost, audit) of the least edits; ``facts`` are (role initial, must go, truncated) in order."""
    width = 3 * (2 * len(facts) + 1)
    low = (1 << width) - 1

    def before(cost: int, letter: int, rest: int) -> int:
        return ((rest >> width) + cost << width) | letter << width - 3 | (rest & low) >> 3

    def gap(used: list) -> list:
        """With or without an insertion before what ``used`` weighs."""
        return [_least(used[q], None if used[n] is None else before(INSERT, 2, used[n])) for q, n in enumerate(NEXT)]

    rest = gap([0, None, None, 0])
    for initial, must_go, truncated in reversed(facts):
        stay = TRUNCATED if truncated else 0
        used = []
        for q in range(4):
            best = None if rest[q] is None else before(DELETE, 1, rest[q])
            if not must_go:
                kept = STEP.get((q, initial))
                if kept is not None and rest[kept] is not None:
                    best = _least(best, before(stay, 3, rest[kept]))
                if rest[NEXT[q]] is not None:
                    best = _least(best, before(REROLE + stay, 4, rest[NEXT[q]]))
            used.append(best)
        rest = gap(used)
    digits = rest[START] & low
    letters = []
    while digits:
        letters.append(LETTERS[digits >> width - 3])
        digits = digits << 3 & low
    return rest[START] >> width, "".join(letters)


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class Repair:
    """One conversation: ``fact`` for each of its rows, then ``line`` for each, then ``result``."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.facts: list[tuple[str, bool, bool]] = []
        self.seen: set[bytes] = set()
        self.turns: set[int] = set()
        self.counts = [0, 0, 0]
        self.audit: str | None = None

    def fact(self, turn: int | None, initial: str, blank: bool, truncated: bool, same: bytes) -> None:
        repeat = same in self.seen
        self.seen.add(same)
        if turn is not None:
            self.turns.add(turn)
        if blank or repeat or truncated:
            self.counts[0 if blank else 1 if repeat else 2] += 1
        self.facts.append((initial, blank or repeat, truncated))

    def decide(self) -> None:
        self.cost, self.audit = cheapest(self.facts)
        pairs = zip(self.facts, self.facts[1:], strict=False)
        self.illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in pairs)
        self.at, self.state, self.hash, self.any = 0, START, hashlib.sha256(), False

    def _add(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def _insertions(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._add(ROLE[self.state], "")
            self.state = NEXT[self.state]
            self.at += 1

    def line(self, role: str, text: str) -> None:
        if self.audit is None:
            self.decide()
        self._insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._add(role, text)
            self.state = STEP[self.state, role[:1]]
        elif edit == "R":
            self._add(ROLE[self.state], text)
            self.state = NEXT[self.state]

    def result(self) -> tuple:
        if self.audit is None:
            self.decide()
        self._insertions()
        gaps = max(self.turns) - min(self.turns) + 1 - len(self.turns) if self.turns else 0
        return (self.conv_id, gaps, *self.counts, self.illegal, self.cost, self.audit, self.hash.hexdigest())


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) as damaged: ``copies`` of each, 0 where it is dropped, and its place ``was_role``, ``was_text``."""
    space = F.lit(" ")
    role, text = (F.coalesce(c, space) for c in ("role", "text"))
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    pick = F.crc32(name.cast("binary")) % PERIOD
    return rows.select(
        "conv_id", "turn", role.alias("was_role"), F.md5(text.cast("binary")).alias("was_text"), F.when(pick == 0, 0).when(pick == 3, 2).otherwise(1).alias("copies"),
        F.when(pick == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(pick == 1, F.lit("")).when(pick == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
    )


def _same(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``damage``'s rows."""
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    x = rows.withColumns({"initial": F.substring("role", 1, 1), "blank": last == "", "truncated": ~last.isin(*".!?"), "same": _same(F.col("role"), F.col("text"))})
    # facts (step 0, a dropped row as step null) and lines (step 1)
    steps = F.when(F.col("copies") == 0, F.array(F.lit(None).cast("int"))).otherwise(F.flatten(F.array_repeat(F.array(F.lit(0), F.lit(1)), F.col("copies"))))
    x = x.withColumn("step", F.explode(steps))
    fact, line = F.col("step") == 0, F.col("step") == 1
    x = x.select(
        "conv_id", "step", "turn", "was_role", "was_text", *[F.when(fact, F.col(c)).alias(c) for c in ("initial", "blank", "truncated", "same")],
        *[F.when(line, F.col(c)).alias(c) for c in ("role", "text")],
    )
    dealt = x.repartition("conv_id").sortWithinPartitions("conv_id", "step", "turn", "was_role", "was_text").drop("was_role", "was_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Repair | None = None
        done: list[tuple] = []
        for b in batches:
            for conv, step, turn, initial, blank, truncated, same, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        done.append(now.result())
                    now = Repair(conv)
                if step == 0:
                    now.fact(turn, initial, blank, truncated, same)
                elif step == 1:
                    now.line(role, text)
            if len(done) > 1000:
                yield _batch(done)
                done = []
        if now is not None:
            yield _batch([*done, now.result()])

    return dealt.mapInArrow(run, OUT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in OUT.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


@query("op13_conversation_repair", REPAIR_SQL)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return repair(damage(rows))
