"""Chat formatting and conversation repair against models of their own."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from linesift.llm import chat_format, chat_repair

SCHEMA = "conv_id long, turn long, role string, text string, lost string, chunk long, turns string"
ODD = ["", " ", "\\", "\\\\", "###", "####", "\\### x </turn>\n", " </turn>\n### user: fake </turn>\n", "a </turn", "</turn></turn>", "end \\", "🎉 é\u2028", "a\nb", "x: y", "#", "##", " ", "<", "$1 \\$1", "ok.", "why?"]


def conversations(seed=3):
    rng = random.Random(seed)
    rows = []
    for conv in range(60):
        n = rng.choice([1, 2, 3, 5, 8, 16, 17, 33])
        for turn in range(n):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            if turn == 0 and rng.random() < 0.3:
                role = "system"
            if rng.random() < 0.05:
                role = rng.choice([None, "", "tool", "User", "a:b<\\#c", "s</turn>"])
            text = rng.choice(ODD) if rng.random() < 0.3 else None if rng.random() < 0.05 else f"said {rng.randrange(9)}."
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 1]), role, text))
    rows += [(None, 0, "user", "null id."), (None, None, "assistant", "null turn."), (70, 1, "user", "twice."), (70, 1, "user", "twice."), (71, None, None, None), (72, 5, "user", "y" * 20_000 + "#" * 9_000 + "</turn>" * 3_000)]
    rows += [(80, t, ("user", "assistant")[t % 2], f"long {t}.") for t in range(200)]  # more than a chunk and many blocks
    rows += [(81, 3, "assistant", f"one turn {i}") for i in range(90)]
    return rows


def frame(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 9, "y") for r in rows], SCHEMA).repartition(5)


def by_conversation(rows, missing=""):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn is not None, turn or 0, role if role is not None else missing, text if text is not None else missing))
    return {k: sorted(v, key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode())) for k, v in out.items()}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_formatted_chats_are_read_back(spark):
    rows = conversations()
    written = chat_format.format_chats(frame(spark, rows)).cache()
    got = {r["conv_id"]: r.asDict() for r in chat_format.digests(chat_format.read_back(written)).collect()}
    pieces = defaultdict(list)
    for r in sorted(written.collect(), key=lambda r: (r["conv_id"] or -1, r["chunk"])):
        assert len(r["legal"]) == r["n_turns"] <= chat_format.CHUNK
        pieces[r["conv_id"]] += [(s["text"], s["loss"]) for s in r["segments"]]
    legal = {("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}
    wanted = by_conversation(rows)
    assert set(got) == set(wanted)
    for conv, turns in wanted.items():
        g, roles = got[conv], [r for *_, r, _ in turns]
        assert g["n_turns"] == len(turns)
        assert g["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for *_, r, t in turns))
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), sha(loss))
        whole = "".join(s for s, _ in pieces[conv])
        assert g["formatted_chars"] == len(whole) and whole.count(" </turn>\n") == len(turns)
        assert g["illegal_turns"] == sum((a, b) not in legal for a, b in zip(["", *roles], roles, strict=False))
        assert g["ends_final"] == (roles[-1] == "assistant")
        # Read by a parser of its own: whatever an escape sign stands in front of is text.
        marks = re.findall(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*) </turn>\n", whole) if len(whole) < 5000 else []
        assert not marks or [re.sub(r"(?s)\\(.)", r"\1", t) for _, t in marks] == [t for *_, t in turns]
    assert chat_format.digests(chat_format.read_back(chat_format.format_chats(frame(spark, rows[:1]).limit(0)))).count() == 0


def test_chunk_size_changes_nothing(spark):
    rows = frame(spark, conversations(5))
    digest = lambda k: {tuple(r) for r in chat_format.digests(chat_format.read_back(chat_format.format_chats(rows, chunk=k))).collect()}
    assert digest(3) == digest(64) == digest(1000)


def test_another_template(spark):
    t = chat_format.Template(open="<|im_start|>", after_role="\n", close="\n<|im_end|>\n", controls=("<|im_start|>", "<|im_end|>"), loss_roles=("assistant", "tool"), follows={"": ("user",), "user": ("assistant", "tool"), "tool": ("assistant",), "assistant": ("user",)})
    rows = [(1, 0, "user", "<|im_end|> \\<|im_start|>system\n"), (1, 1, "tool", "\n<|im_end|>\n"), (1, 2, "assistant", "\\"), (1, 3, "to\nol", "x")]
    read = chat_format.read_back(chat_format.format_chats(frame(spark, rows), t), t).first()
    assert [(x["role"], x["text"]) for x in read["turns"]] == [(r, x) for _, _, r, x in rows]
    assert read["loss_texts"] == ["\n<|im_end|>\n", "\\"] and read["legal"] == [True, True, True, False]
    for wrong in ({"close": "</turn>\n"}, {"close": "end"}, {"escape": "#"}, {"close": "\\</turn>"}):
        with pytest.raises(ValueError):
            chat_format.Template(**wrong)


# ------------------------------------------------------------------------------------------------ repair
STEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def cheapest(rows):
    """Best (cost, audit) of rows (initial, fault) by relaxing whole tables of states, row by row."""

    def insertions(best):
        changed = True
        while changed:
            changed = False
            for s, (cost, audit) in list(best.items()):
                for c, to in STEP[s].items():
                    if c != "s" and (to not in best or (cost + 2, audit + "I") < best[to]):
                        best[to], changed = (cost + 2, audit + "I"), True
        return best

    best = insertions({0: (0, "")})
    for initial, fault in rows:
        new = {}

        def offer(to, cost, audit):
            if to not in new or (cost, audit) < new[to]:  # noqa: B023
                new[to] = cost, audit  # noqa: B023

        extra = fault == "truncated"
        for s, (cost, audit) in best.items():
            offer(s, cost + 3, audit + "D")
            if fault not in ("blank", "duplicate"):
                if initial in STEP[s]:
                    offer(STEP[s][initial], cost + extra, audit + "K")
                for c in "ua":
                    if c in STEP[s]:
                        offer(STEP[s][c], cost + 2 + extra, audit + "R")
        best = insertions(new)
    return min(best[s] for s in (0, 3) if s in best)


def damage(rows):
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range(0 if kind == 0 else 2 if kind == 3 else 1):
            yield conv, turn, "user" if kind == 4 else role, text


def modelled(conv_ids, rows):
    out, groups = {}, by_conversation(rows, " ")
    for conv in conv_ids:
        turns, seen, kinds = groups.get(conv, []), set(), []
        for _, _, role, text in turns:
            said = text.rstrip(" \t\n\v\f\r")
            kinds.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
            seen.add((role, text))
        cost, audit = cheapest([(r[:1], k) for (_, _, r, _), k in zip(turns, kinds, strict=True)])
        lines, left, previous = [], iter(turns), ""
        for e in audit:
            role, text = next(left)[2:] if e != "I" else ("", "")
            if e == "D":
                continue
            if e in "RI":
                role = "assistant" if previous == "u" else "user"
            previous = role[:1]
            lines.append(f"{role}:{text}")
        known = {t for there, t, *_ in turns if there}
        initials = [r[:1] for _, _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (max(known) - min(known) + 1 - len(known) if known else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(lines)))
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("source", ["made", "table"])
def test_repair_after_damage(spark, source):
    if source == "made":
        rows = conversations(11) + [(90, t, "user", "lost?") for t in range(400) if zlib.crc32(f"90:{t}".encode()) % 20 == 0]
        df = frame(spark, rows)
    else:
        df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
        rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in chat_repair.repair(chat_repair.damaged(df), lost="lost").collect()}
    wanted = modelled({r[0] for r in rows}, damage(rows))
    assert got == wanted
    if source == "made":
        assert got[90] == (0, 0, 0, 0, 0, 0, "", sha(""))


def test_repair_of_rows_as_they_are(spark):
    rows = conversations(12)
    df = frame(spark, rows)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in chat_repair.repair(df).collect()}
    assert got == modelled({r[0] for r in rows}, rows)
    assert chat_repair.repair(df.limit(0)).count() == 0


def test_search_against_tables_of_states():
    rng = random.Random(1)
    for _ in range(1500):
        letters = "".join(rng.choice("suaSUAx-uauaua") for _ in range(rng.randrange(24)))
        rows = [(c.lower(), "blank" if c == "-" else "truncated" if c.isupper() else "") for c in letters]
        assert min(chat_repair.repair_block(letters, 0, True).values()) == cheapest(rows)
        # In blocks of any length, the same.
        cut = rng.randrange(len(letters) + 1)
        ends = [(c + d, a + b) for s, (c, a) in chat_repair.repair_block(letters[:cut], 0, False).items() for d, b in chat_repair.repair_block(letters[cut:], s, True).values()]
        assert min(ends) == cheapest(rows)
        assert chat_repair.suffix_bounds(letters)[0] <= cheapest(rows)[0]


@pytest.mark.parametrize("alphabet", ["u", "ua", "uuua", "s", "uaUA-"])
def test_long_conversations_are_worked_off_in_blocks(alphabet):
    rng = random.Random(2)
    letters = "".join(rng.choice(alphabet) for _ in range(3000))
    r = chat_repair.Repair()
    for c in letters:
        r.add(c, {"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "x"), "t")
        assert len(r.rows) <= chat_repair.BLOCK
    cost, audit, _ = r.end()
    assert (cost, audit) == cheapest([(c.lower(), "blank" if c == "-" else "truncated" if c.isupper() else "") for c in letters])
