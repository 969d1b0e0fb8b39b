"""Conversation repair against a plain shortest-path search over whole conversations."""

import hashlib
import random
import zlib

import pytest

from netquarry.llm.turns import (
    BEHIND, END, INSERT, NEXT_ROLE, START, SYSTEM, audit_conversations, backwards, damage, relative, repair_conversations, search,
)

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, copy string, audit int, position string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def cheapest(rows, faults):  # recursion is as deep as the conversation
    """The least (cost, letters, lines) from the front, by memo over (row, state)."""
    memo = {}

    def ends(i, state, inserts):
        key = (i, state, inserts)
        if key in memo:
            return memo[key]
        found = []
        if i == len(rows) and state in (START, 3):
            found.append((0, "", ()))
        if inserts < 3:
            cost, letters, lines = ends(i, BEHIND[state], inserts + 1)
            found.append((cost + 3, "I" + letters, (NEXT_ROLE[state] + ":",) + lines))
        if i < len(rows):
            _, role, text = rows[i]
            fault = faults[i]
            steps = [("D", 4, state, ())]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if state == START and role[:1] == "s":
                    steps.append(("K", more, SYSTEM, (f"{role}:{text}",)))
                if role[:1] == NEXT_ROLE[state][0]:
                    steps.append(("K", more, BEHIND[state], (f"{role}:{text}",)))
                steps.append(("R", 3 + more, BEHIND[state], (f"{NEXT_ROLE[state]}:{text}",)))
            for letter, cost, after, line in steps:
                c, letters, lines = ends(i + 1, after, 0)
                found.append((c + cost, letter + letters, line + lines))
        memo[key] = min(found) if found else (10**6, "", ())
        return memo[key]

    return ends(0, START, 0)


def expected(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    out = {}
    for conv, mine in convs.items():
        after = damaged(mine)
        seen, faults = set(), []
        for _, role, text in after:
            bare = text.strip(BLANKS)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            faults.append(fault)
            seen.add((role, text))
        turns = {t for t, _, _ in after if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        cost, audit, lines = cheapest(after, faults)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def made_up(seed, conversations=60):
    rnd, rows = random.Random(seed), []
    texts = ["Yes.", "No", " \t", "", None, "Why?", "Line\nbreak!", "é.", "end. \n"]
    for conv in range(conversations):
        for turn in range(rnd.choice([1, 2, 5, 9, 30])):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((conv if conv else None, rnd.choice([turn, turn, turn, turn + 3, None]), role, rnd.choice(texts)))
    rows += rows[:20]  # repeated rows
    rows += [(1000, t, "ua"[t % 2] + "x", f"long {t}.") for t in range(220)]
    rows.append((2000, 0, "user", "word. " * 200_000))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(5)


def as_dict(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    found = df.collect()
    got = {r["conv_id"]: tuple(r[n] for n in names) for r in found}
    assert len(got) == len(found)
    return got


@pytest.mark.parametrize("chunk_bits", [0, 2, 10])
def test_conversations(spark, chunk_bits):
    rows = made_up(chunk_bits)
    want = expected(rows)
    if chunk_bits == 10:
        assert as_dict(audit_conversations(frame(spark, rows))) == want
    got = as_dict(repair_conversations(damage(frame(spark, rows)), chunk_bits))
    assert got == {k: v for k, v in want.items() if k in got}
    assert all(want[k][5:7] == (0, "") for k in want.keys() - got.keys())


def test_lost_conversation_has_an_empty_row(spark):
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = as_dict(audit_conversations(frame(spark, [(lost, 0, "user", "Hi.")])))
    assert got == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_empty_table(spark):
    assert audit_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_search_forgets_its_guess():
    """A chunk searched from a new vector gives what a search from scratch does, up to a constant."""
    rnd = random.Random(3)
    for _ in range(200):
        kinds = [(rnd.choice("suax"), rnd.choice([None, None, "blank", "truncated"])) for _ in range(rnd.randrange(1, 40))]
        guessed = search(kinds, list(END), None)
        behind = [rnd.randrange(0, 7) for _ in END]
        for _ in END:
            behind = [min(c, INSERT + behind[BEHIND[s]]) for s, c in enumerate(behind)]
        again, fresh = search(kinds, behind, guessed), backwards(kinds, behind)
        assert [relative(c) for c in again] == [relative(c) for c in fresh]
