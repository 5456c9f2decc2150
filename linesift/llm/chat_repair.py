"""Conversation structure repair: depth-first branch and bound over the edits of a conversation's rows.

A row is kept (free), given another role (2) or deleted (3, a must for blank and repeated rows); an empty turn may be put
in anywhere (2); a truncated row that stays adds 1.  Wanted are the cheapest edits after which the initials of the roles
read ``(s?(ua)+)?``, among equally cheap ones those whose initials (K, R, D, I) come first in ASCII order: the audit.

Rows become letters (role initial, and whether they must go or are truncated), and letters are repaired in blocks of
``BLOCK`` rows.  In a block an explicit stack holds prefixes (row, state, cost, audit).  A prefix is dropped

* if its cost and the suffix's lower bound exceed the incumbents of all states it may end in, or equal them where its
  audit already comes later: the bound counts 3 for each row that must go, 1 for each truncated row, and 1 for each two
  neighbours among the others that can't stand together (an edit of cost 2 or 3 mends two such places at most);
* if the dominance table of its row and state holds a better (cost, audit).

When the stack is empty the incumbents are proved best.  Blocks are joined by their entry and exit states, which is exact:
of two audits of one cost up to one row and state none is the beginning of the other, as each further letter is an
insertion with a cost.  So a conversation of any length is worked off as a stream, holding one block of rows, and for
each of at most four states a cost, an audit and a running checksum of the repaired text.

Duplicates are found beforehand by an aggregate over (conversation, role, checksum of the text).  Rows are then dealt by
conversation and sorted.  A checksum is taken in order, so one task reads a conversation's rows, but it never holds them.

Defined results: a null text or role is one blank, and a null id or turn is written as one blank where it is hashed; rows
with a null id are a conversation; null turns come first, rows of one turn are ordered by role, then text; repeated rows
are duplicates; a conversation that has lost all its rows has zeros, an empty audit and the checksum of an empty text; an
empty table gives an empty result.  Other columns of the input are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows searched together.  Longer blocks give the same result and cost more: prefixes are met again in more orders.
BLOCK = 16
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.  Complete are the first and the last.
FINAL = (0, 3)
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
TURNS = {"u": "user", "a": "assistant"}
#: Neighbours that may stand together.
FITS = frozenset(("su", "ua", "au"))
SPACE = "\x20\t\n\x0b\x0c\r"
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, rows long"


def suffix_bounds(letters: str) -> list[int]:
    """What the rows from each position on cost at least.

    A letter is the initial of a role that may stay (s, u, a, or x for another), upper case if truncated; ``-`` must go.
    """
    out, after = [0] * (len(letters) + 1), ""
    for i in range(len(letters) - 1, -1, -1):
        c = letters[i].lower()
        if c == "-":
            out[i] = out[i + 1] + DELETE
            continue
        clash = bool(after) and c + after not in FITS
        out[i] = out[i + 1] + (CUT_OFF if letters[i].isupper() else 0) + clash
        after = c
    return out


@lru_cache(maxsize=50_000)
def repair_block(letters: str, entry: int, last: bool) -> dict[int, tuple[int, str]]:
    """Best (cost, audit) from state ``entry`` over a block, by exit state.

    The last block of a conversation may end with insertions and has complete exits only.
    """
    n, bound = len(letters), suffix_bounds(letters)
    exits = FINAL if last else (0, 1, 2, 3)
    found: dict[int, tuple[int, str]] = {}
    seen: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        best = seen.get((at, state))
        if best is not None and best < (cost, audit):
            continue  # a better prefix came here since
        least = cost + bound[at]
        if len(found) == len(exits) and all((least, audit) > (c, a[: len(audit)]) for c, a in found.values()):
            continue
        if at == n and state in exits and (state not in found or (cost, audit) < found[state]):
            found[state] = cost, audit
        step = STEPS[state]
        after = []
        if at < n:
            c, extra = letters[at].lower(), CUT_OFF if letters[at].isupper() else 0
            if c in step:
                after.append((at + 1, step[c], cost + extra, audit + "K"))
            if c != "-":
                after += [(at + 1, to, cost + REROLE + extra, audit + "R") for role, to in step.items() if role in TURNS]
            after.append((at + 1, state, cost + DELETE, audit + "D"))
        if at < n or last:
            after += [(at, to, cost + INSERT, audit + "I") for role, to in step.items() if role in TURNS]
        # The cheapest prefix is looked into first: it lies on top of the stack.
        for node in sorted(after, key=lambda x: (-(x[2] + bound[x[0]]), x[0])):
            place, value = (node[0], node[1]), node[2:]
            if place not in seen or value < seen[place]:
                seen[place] = value
                stack.append(node)
    return found


class Repair:
    """The repair of one conversation, row by row."""

    def __init__(self):
        self.best: dict[int, tuple[int, str]] = {0: (0, "")}
        self.sums = {0: (hashlib.sha256(), False)}
        self.rows: list[tuple[str, str, str]] = []  # letter, role, text of the block

    def add(self, letter: str, role: str, text: str) -> None:
        if len(self.rows) >= BLOCK:
            self._work_off(False)
        self.rows.append((letter, role, text))

    def _work_off(self, last: bool) -> None:
        letters = "".join(r[0] for r in self.rows)
        found: dict[int, tuple[int, str, int, str]] = {}
        for entry, (cost, audit) in self.best.items():
            for to, (c, a) in repair_block(letters, entry, last).items():
                new = (cost + c, audit + a, entry, a)
                if to not in found or new[:2] < found[to][:2]:
                    found[to] = new
        if last:
            to = min(found, key=lambda x: found[x][:2])
            found = {to: found[to]}
        sums = {}
        for to, (_, _, entry, a) in found.items():
            digest, any_ = self.sums[entry]
            digest = digest.copy()
            for line in self._repaired(entry, a):
                digest.update(("\n" * any_ + line).encode())
                any_ = True
            sums[to] = digest, any_
        self.best, self.sums, self.rows = {to: x[:2] for to, x in found.items()}, sums, []

    def _repaired(self, state: int, edits: str) -> Iterator[str]:
        """The lines that edits give from a state on.  A role that is put in follows from the state."""
        at = 0
        for e in edits:
            letter, role, text = self.rows[at] if e != "I" else ("", "", "")
            if e != "I":
                at += 1
            if e == "D":
                continue
            if e == "K":
                state = STEPS[state][letter.lower()]
            else:
                state = 3 if state == 2 else 2
                role = TURNS["a" if state == 3 else "u"]
            yield f"{role}:{text}"

    def end(self) -> tuple[int, str, str]:
        self._work_off(True)
        ((to, (cost, audit)),) = self.best.items()
        return cost, audit, self.sums[to][0].hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, lost`` after the damage; a dropped row stays as a mark without content."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = rows.withColumn("_kind", kind)
    rows = rows.withColumn("text", F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))).withColumn("lost", F.col("_kind") == 0)
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    keep = lambda c: F.when(~F.col("lost"), F.col(c)).alias(c)
    return rows.select("conv_id", keep("turn"), keep("role"), keep("text"), "lost", copies.alias("_copy")).drop("_copy")


def first_seen(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_first``: the turn in which a role and text that occur again are first said (null if not repeated).

    Null turns count as earlier than all; ``_null_first`` tells that the first one has none.
    """
    name = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumn("_name", F.when(~F.col("lost"), name))
    again = rows.where(~F.col("lost")).groupBy("conv_id", "_name").agg(F.count("*").alias("_n"), F.min("turn").alias("_first"), F.bool_or(F.col("turn").isNull()).alias("_null_first"))
    again = again.where("_n > 1").select(F.col("conv_id").alias("_conv"), F.col("_name").alias("_again"), "_first", "_null_first")
    return rows.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_name") == F.col("_again")), "left").drop("_conv", "_name", "_again")


def _letter(fault: str, role: str) -> str:
    if fault in ("blank", "duplicate"):
        return "-"
    c = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return c.upper() if fault == "truncated" else c


def repair(conversations: DataFrame, lost: str | None = None, partitions: int | None = None) -> DataFrame:
    """RESULT of rows (conv_id, turn, role, text), one for each conversation.

    Rows that the column ``lost`` marks are not there: they only tell that their conversation has a result.
    """
    gone = F.coalesce(F.col(lost), F.lit(False)) if lost else F.lit(False)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("lost"))
    names = [x.split()[0] for x in RESULT.split(", ")]
    full, ended = re.compile(f"[^{SPACE}]").search, (".", "!", "?")

    def run(batches: Iterator[pa.RecordBatch]):
        out: list[tuple] = []
        state = None

        def close():
            cost, audit, digest = state["repair"].end()
            gaps = state["high"] - state["low"] + 1 - state["turns"] if state["turns"] else 0
            out.append((state["conv"], gaps, state["blank"], state["duplicate"], state["truncated"], state["illegal"], cost, audit, digest, state["rows"]))

        for batch in batches:
            for conv, turn, role, text, lost, first, null_first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state["conv"] != conv:
                    if state is not None:
                        close()
                    state = {"conv": conv, "repair": Repair(), "turns": 0, "low": 0, "high": 0, "last": None, "initial": None, "rows": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                if lost:
                    continue
                state["rows"] += 1
                if turn is not None and (not state["turns"] or state["high"] != turn):
                    if not state["turns"]:
                        state["low"] = turn
                    state["turns"] += 1
                    state["high"] = turn
                here = (turn, role, text)
                # Copies of one turn stand side by side; a copy of an earlier turn is told by that turn.
                twice = here == state["last"] or (null_first is not None and (turn is not None and (null_first or turn > first)))
                state["last"] = here
                said = text.rstrip(SPACE)
                fault = "blank" if not full(said) else "duplicate" if twice else "truncated" if not said.endswith(ended) else ""
                if fault:
                    state[fault] += 1
                if state["initial"] is not None and state["initial"] + role[:1] not in FITS:
                    state["illegal"] += 1
                state["initial"] = role[:1]
                state["repair"].add(_letter(fault, role), role, text)
            if len(out) >= 10_000:
                yield _result(out, names)
                out = []
        if state is not None:
            close()
        if out:
            yield _result(out, names)

    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = first_seen(rows).repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    dealt = dealt.select("conv_id", "turn", "role", "text", "lost", "_first", "_null_first")
    return dealt.mapInArrow(run, RESULT)


def _result(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if x in ("audit", "repaired_sha256") else pa.int64()) for c, x in zip(cols, names, strict=True)], names=names)
