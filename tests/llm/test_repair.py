"""Repaired conversations against all edit sequences and by chunks of any size."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from lumenveil.llm import repair
from lumenveil.llm.queries import op12_conversation_repair

RIGHT = re.compile(r"(s?(ua)+)?")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def slow(rows: list[tuple]) -> tuple:
    """The contract by trying all edit sequences; rows: (turn, role, text) in order."""
    faults = []
    for k, (_, role, text) in enumerate(rows):
        told = text.strip(SPACE)
        faults.append("blank" if not told else "duplicate" if (role, text) in [r[1:] for r in rows[:k]] else "truncated" if told[-1] not in ".!?" else "")
    best = None

    def go(k: int, cost: int, audit: str, initials: str, out: list[str], inserted: int) -> None:
        nonlocal best
        if best and cost > best[0]:
            return
        if k == len(rows) and RIGHT.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
        if inserted < 3:
            for role in ("user", "assistant"):
                go(k, cost + 2, audit + "I", initials + role[0], [*out, f"{role}:"], inserted + 1)
        if k == len(rows):
            return
        _, role, text = rows[k]
        go(k + 1, cost + 3, audit + "D", initials, out, 0)
        if faults[k] not in ("blank", "duplicate"):
            extra = faults[k] == "truncated"
            go(k + 1, cost + extra, audit + "K", initials + role[:1], [*out, f"{role}:{text}"], 0)
            for other in ("user", "assistant"):
                go(k + 1, cost + 2 + extra, audit + "R", initials + other[0], [*out, f"{other}:{text}"], 0)

    bound = 3 * len(rows)
    best = (bound + 1, "~", [])
    go(0, 0, "", "", [], 0)
    turns = {r[0] for r in rows if r[0] is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest(),
    )


def slow_damage(conv, rows: list[tuple]) -> list[tuple]:
    out = []
    for turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        out += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def conversations(seed: int, number: int) -> dict[int | None, list[tuple]]:
    dice = random.Random(seed)
    texts = ["Yes.", "No", "", " \t ", "What?", "So it is!\n", None, "... ok \x1c", "é"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    return {
        None if conv == 0 else conv: [(None if dice.random() < 0.1 else dice.randrange(12), dice.choice(roles), dice.choice(texts)) for _ in range(dice.randrange(6))] for conv in range(number)
    }


@pytest.mark.parametrize("chunk_rows", [1024, 1])
def test_against_all_edit_sequences(spark, chunk_rows):
    given = {k: v for k, v in conversations(5, 60).items() if v}
    rows = [(conv, *r, "extra") for conv, turns in given.items() for r in turns]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost string").repartition(3)
    damaged, copies = repair.damaged(frame)
    found = repair.repaired(damaged, copies=copies, chunk_rows=chunk_rows).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    assert len(found) == len(given)
    for conv, *told in map(tuple, found):
        assert tuple(told) == slow(slow_damage(conv, given[conv])), (conv, given[conv])


def test_query_equals_its_oracle(same_as_oracle):
    assert same_as_oracle(op12_conversation_repair, repair.ORACLE_SQL)


def test_one_long_conversation_in_chunks(spark):
    dice = random.Random(2)
    rows = [(1, k, dice.choice(["user", "assistant", "system"]), dice.choice([f"Text {k}.", f"text {k}", "again."])) for k in range(3000)] + [(2, 1, "user", "Hm.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    whole = {r.conv_id: tuple(r) for r in repair.repaired(frame, chunk_rows=10_000).collect()}
    assert {r.conv_id: tuple(r) for r in repair.repaired(frame, chunk_rows=16).collect()} == whole
    messages = repair.repaired_messages(frame, chunk_rows=16).filter("conv_id = 1").orderBy("part", "seq", "place").collect()
    assert hashlib.sha256("\n".join(f"{m.role}:{m.text}" for m in messages).encode()).hexdigest() == whole[1][-1]
    assert RIGHT.fullmatch("".join(m.role[0] for m in messages))
    assert whole[2][-3:-1] == (2, "KI")


def test_repeated_rows_and_a_dropped_conversation(spark):
    rows = [(1, 1, "user", "Same.", 3), (1, 1, "assistant", " ", 2), (1, 2, "assistant", "Well.", 1), (2, 1, "user", "Gone.", 0)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int")
    found = {r.conv_id: r for r in repair.repaired(frame, copies=frame["n"]).collect()}
    assert (found[1].blank, found[1].duplicate, found[1].illegal, found[1].cost, found[1].audit) == (2, 2, 3, 12, "DDKDDK")
    assert tuple(found[2])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_text_and_empty_table(spark):
    long = "x " * 1_500_000
    frame = spark.createDataFrame([(1, 1, "user", long), (1, 2, "assistant", "Yes."), (1, 3, "user", long)], "conv_id long, turn long, role string, text string")
    (row,) = repair.repaired(frame).collect()
    assert (row.duplicate, row.truncated, row.cost, row.audit) == (1, 1, 4, "KKD")
    assert repair.repaired(frame.limit(0)).count() == 0


def test_distances_are_those_of_all_paths():
    dice = random.Random(4)
    for _ in range(200):
        free = [(dice.choice("suat"), dice.randrange(2)) for _ in range(dice.randrange(5))]
        dist = repair.distances(free, repair.END)
        slow_dist = [[repair.FAR] * 4 for _ in range(len(free) + 1)]
        slow_dist[-1] = list(repair.END)
        for _ in range(30):  # relax everything until nothing changes
            for place in range(len(free) + 1):
                for state in range(4):
                    for before, source, cost in repair._into(free, place, state):
                        slow_dist[before][source] = min(slow_dist[before][source], slow_dist[place][state] + cost)
        assert dist == slow_dist
