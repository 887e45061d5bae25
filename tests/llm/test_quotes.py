"""Quotation linking against a plain reading of each conversation."""

from __future__ import annotations

import random
import re

import pytest

from lumenveil.llm import quotes

SCHEMA = "conv_id long, turn long, text string"


def parse(text: str | None) -> tuple[list[tuple[int, str]], str]:
    lines = []
    for line in re.split(r"\r?\n", text or ""):
        marks = re.match(r"^(?:[ \t]{0,3}>)+", line)
        depth = marks[0].count(">") if marks else 0
        rest = line[marks.end() :] if marks else line
        lines.append((depth, rest[1:] if marks and rest[:1] == " " else rest))
    own = []
    for i, (depth, rest) in enumerate(lines):
        after = lines[i + 1] if i + 1 < len(lines) else None
        later = lines[i + 2] if i + 2 < len(lines) else None
        quoted = bool(after and (after[0] > 0 or (after[1].strip(" ") == "" and later and later[0] > 0)))
        if depth == 0 and not (re.match(r"(?i)^\s*on\b.{1,200}\bwrote:\s*$", rest) and quoted):
            own.append(rest)
    text = re.sub(r"\n\s*\n\s*\n+", "\n\n", "\n".join(own), flags=re.A)
    return lines, re.sub(r"^\s+|\s+$", "", text, flags=re.A)


def slow(rows: list[tuple[int, int, str | None]]) -> dict[tuple[int, int], tuple]:
    """(own text, reply_to, branch, linked, quoted) of every message."""
    normal = lambda t: re.sub(r"\s+", " ", t, flags=re.A).strip(" ").lower()
    out: dict[tuple[int, int], tuple] = {}
    for conv in {r[0] for r in rows}:
        messages = sorted((t, x) for c, t, x in rows if c == conv)
        units: dict[int, set] = {}
        owns = {}
        for turn, text in messages:
            lines, owns[turn] = parse(text)
            found = {(d, normal(t)) for d, t in lines} | {(0, normal(owns[turn]))}
            written = [(d, t) for d, t in lines if t.strip(" ")]
            start = 0
            for k in range(1, len(written) + 1):
                if k == len(written) or written[k][0] != written[start][0]:
                    if written[start][0] > 0:
                        found.add((written[start][0], normal(" ".join(t for _, t in written[start:k]))))
                    start = k
            units[turn] = {u for u in found if u[1]}
        turns = [t for t, _ in messages]
        reply: dict[int, tuple] = {}
        for turn in turns:
            asked = [u for u in units[turn] if u[0] > 0]
            source = {u: max((t for t in turns if t < turn and (0, u[1]) in units[t]), default=None) for u in asked}
            hits = [u for u in asked if source[u] is not None]
            outer = min((u[0] for u in hits), default=None)
            votes: dict[int, int] = {}
            for u in hits:
                votes[source[u]] = votes.get(source[u], 0) + (len(u[1]) if u[0] == outer else 0)
            before = max((t for t in turns if t < turn), default=None)
            best = max(((v, s) for s, v in votes.items()), default=(0, before))[1]
            reply[turn] = (best, len(hits), len(asked))
        branch: dict[int, int] = {}
        for turn in turns:
            parent = reply[turn][0]
            first = min((t for t in turns if reply[t][0] == parent), default=None)
            branch[turn] = branch[parent] if parent is not None and first == turn else turn
        out |= {(conv, t): (owns[t], reply[t][0], branch[t], reply[t][1], reply[t][2]) for t in turns}
    return out


def talk(dice: random.Random, turns: int) -> list[tuple[int, str]]:
    said: list[tuple[int, str]] = []
    pool = ["yes", "no", "see you then"]
    for turn in range(turns):
        lines = []
        if said and dice.random() < 0.7:
            _, text = said[dice.randrange(max(0, len(said) - 4), len(said))]
            some = text.split("\n")
            if dice.random() < 0.4:
                some = some[:1]
            if dice.random() < 0.5:
                lines.append("On Monday, Ann wrote:")
            lines += [dice.choice(["> ", ">", " > "]) + x.upper() if dice.random() < 0.2 else "> " + x for x in some]
        lines += [dice.choice(pool) if dice.random() < 0.3 else f"word{dice.randrange(1000)} is  {turn}" for _ in range(dice.randint(1, 3))]
        said.append((turn, "\n".join(lines)))
    return said


def result(spark, rows) -> dict:
    messages = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    return {(r.conv_id, r.turn): (r.text, r.reply_to, r.branch, r.linked, r.quoted) for r in quotes.conversations(messages).collect()}


def test_random_conversations(spark, monkeypatch):
    monkeypatch.setattr(quotes, "RANGE", 4)  # several ranges in a conversation
    dice = random.Random(2)
    rows = [(c, t, x) for c in range(12) for t, x in talk(dice, dice.randint(1, 15))]
    assert result(spark, rows) == slow(rows)


def test_nested_quotes_and_reply_order(spark):
    rows = [
        (1, 0, "Shall we meet on Tuesday?\nBring the plan."),
        (1, 1, "> Shall we meet on Tuesday?\nFine with me."),
        (1, 2, "On Tue, B wrote:\n>> Shall we meet on Tuesday?\n> Fine with me.\n\nGood."),
        (1, 3, "> Shall we meet on Tuesday?\n> Bring the plan.\nI cannot."),
    ]
    got = result(spark, rows)
    assert got == slow(rows)
    assert [got[1, t][0] for t in range(4)] == ["Shall we meet on Tuesday?\nBring the plan.", "Fine with me.", "Good.", "I cannot."]
    assert [got[1, t][1] for t in range(4)] == [None, 0, 1, 0]
    assert [got[1, t][2] for t in range(4)] == [0, 0, 0, 3]


def test_defined_cases(spark):
    rows = [
        (1, 0, None, "a"), (1, 0, None, "a"), (1, 1, "", "b"), (1, 2, "> only a quote", "c"), (None, 0, "lost", "d"), (2, None, "> lost", "e"),
        (3, 0, "\n".join(f"line {k}" for k in range(3000)), "f"), (3, 1, "\n".join(f"> line {k}" for k in range(3000)) + "\nall of it", "g"),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, text string, branch string").drop("branch").withColumnRenamed("conv_id", "conv_id")
    got = sorted(map(tuple, quotes.conversations(messages).collect()), key=str)
    assert len(got) == len(rows)
    by_key = {(r[0], r[1]): r for r in got}
    assert by_key[1, 2][2] == "" and by_key[1, 2][3] == 1 and by_key[1, 2][6] == 1
    assert by_key[None, 0][2:] == ("lost", None, None, None, None) and by_key[2, None][2] == ""
    assert by_key[3, 1][2] == "all of it" and by_key[3, 1][3] == 0 and by_key[3, 1][5] == 3001
    assert quotes.conversations(messages.limit(0)).count() == 0


def test_other_columns_are_kept(spark):
    messages = spark.createDataFrame([(1, 0, "a", "own", 5), (1, 1, "> a\nb", "lines", 6)], "conv_id long, turn long, text string, own string, depth int")
    got = quotes.conversations(messages)
    assert got.columns == ["conv_id", "turn", "text", "own", "depth", "reply_to", "branch", "linked", "quoted"]
    assert [(r.own, r.depth) for r in got.orderBy("turn").collect()] == [("own", 5), ("lines", 6)]


def test_a_paragraph_that_was_wrapped_anew_is_linked(spark):
    """One paragraph, or one own passage between quotes, whose line ends have moved."""
    rows = [
        (1, 0, "The first paragraph is\nof two lines.\n\nThe second one has\ntwo lines as well."),
        (1, 1, "Nothing to do with it."),
        (1, 2, "> The second one\n> has two lines as\n> well.\n\nIndeed."),
        (1, 3, "> The first paragraph\n> is of two lines.\n>\n> Never said by\n> anyone.\n\nAnd this."),
        (2, 0, "Where is\nthe key?"),
        (2, 1, "> Where is\n> the key?\nUnder the\n\nmat.\nOn Tue, A wrote:\n> the key?\nAs ever."),
        (2, 2, "No."),
        (2, 3, "On Wed, B wrote:\n> Under\n> the mat.\n> On Tue, A wrote:\n>> the key?\n\nThanks."),
    ]
    got = result(spark, rows)
    assert [got[1, t][1] for t in range(4)] == [None, 0, 0, 0]
    assert [got[2, t][1] for t in range(4)] == [None, 0, 1, 1]
    assert got[1, 2][3] == 1 and got[1, 3][3] == 1
    assert got[2, 3][0] == "Thanks."


def test_columns_of_the_results_names_stay(spark):
    rows = [("c", 1, "first words here", "a", "b"), ("c", 2, "> first words here\nyes", "a", "b"), (None, 3, "x", "a", "b")]
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id string, turn long, text string, reply_to string, branch string"))
    assert got.columns == ["conv_id", "turn", "text", "reply_to", "branch", "_reply_to", "_branch", "linked", "quoted"]
    assert sorted((r.turn, r.reply_to, r._reply_to) for r in got.collect()) == [(1, "a", None), (2, "a", 1), (3, "a", None)]


@pytest.mark.parametrize("marks", [10, 10_000, 1_000_000])
def test_a_line_of_many_marks(spark, marks):
    frame = spark.createDataFrame([(1, 1, "one short answer"), (1, 2, "> " * marks + "one short answer\nmine")], SCHEMA)
    row = quotes.parsed(frame.filter("turn = 2")).selectExpr("lines[0].depth as depth", "lines[0].text as text", "own").first()
    assert tuple(row) == (marks, "one short answer", "mine")
    if marks < 100_000:
        assert {r.turn: r.linked for r in quotes.linked(frame).collect()}[2] > 0


def test_marks_stand_close_together(spark):
    lines = {">  > x": (2, "x"), "    > x": (0, "    > x"), "   >y": (1, "y"), "> >    > z": (2, "   > z"), ">": (1, ""), "\t> >\tt ": (2, "\tt "), "a > b": (0, "a > b"), "": (0, "")}
    frame = spark.createDataFrame([(1, k, t) for k, t in enumerate(lines)], SCHEMA)
    got = {r.turn: (r.depth, r.text) for r in quotes.parsed(frame).selectExpr("turn", "lines[0].depth as depth", "lines[0].text as text").collect()}
    assert [got[k] for k in range(len(lines))] == list(lines.values())


def test_a_million_blanks_in_one_message(spark):
    import time

    begun = time.monotonic()
    frame = spark.createDataFrame([(1, 1, "a" + " " * 1_000_000 + "b" + "\n" * 1000 + " " * 1_000_000)], SCHEMA)
    assert quotes.parsed(frame).first().own == "a" + " " * 1_000_000 + "b"
    assert quotes.conversations(frame).count() == 1
    assert time.monotonic() - begun < 60
