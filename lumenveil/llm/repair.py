"""Repair of damaged conversations along cheapest paths.

A conversation is right if the initials of its roles read ``(s?(ua)+)?``: perhaps a
system message, then user and assistant in turn. Four edits mend it: Keep (cost 0),
Rerole a message to user or assistant (2), Delete (3; blank and repeated messages
must go) and Insert an empty message of user or assistant (2). A message that does
not end a sentence costs 1 more unless it is deleted.

Edits are arcs of a graph of small integer costs: a node is a place between two
messages and a state of the automaton of the rule (start, after s, after u, after
a). Dial's bucket queue finds every node's distance to the end; then the path is
walked forward along tight arcs, taking the least initial where several are tight,
which gives the least audit string of all cheapest ones. A label leads from a state
to one other only, so the walk never has to look ahead.

Rows are sorted by ranges and cut into chunks of bounded size, so that one long
conversation spreads over many tasks. For chunks that are not a whole conversation,
the distances from each state to each state go backward over the conversation as
four numbers a chunk, then the walk's end state of each state goes forward; with
both known, every chunk is walked on its own. Equal rows travel as one with their
number.

Defined cases: a null role or text is one space (so the text is blank); an empty role
has no initial, so a message that keeps it adds nothing to the rule's string; a null turn
comes first; a null conversation is one like others; rows of one turn are taken by
role, then text; a row that is repeated is a duplicate of its first; very long texts
go to chunks of their own; a conversation whose rows all have number 0 has zeros, an
empty audit and the hash of the empty string; an empty table yields no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenveil.session import materialize, shuffle_partitions, temporary_tables

#: Messages and characters of one chunk.
CHUNK_ROWS, CHUNK_CHARS = 1024, 1 << 20
#: Costs of the edits, and what a message without an end adds.
REROLE, DELETE, INSERT, UNENDED = 2, 3, 2, 1
#: Faults, the first of which counts.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing yet, after s, after u, after a. Before a message of user or
#: assistant the state must be among these, and these may end a conversation.
BEFORE = {2: (0, 1, 3), 3: (2,)}
NAMES = {2: "user", 3: "assistant"}
FAR = 1 << 60
END = (0, FAR, FAR, 0)
LEGAL = frozenset({"su", "ua", "au"})


# -- shortest paths -------------------------------------------------------

def distances(free: list[tuple[str, int]], ends: tuple[int, ...]) -> list[list[int]]:
    """[place][state]: least cost to get past all messages and on from the state there.

    free: (initial, extra cost unless deleted) of the messages that may stay; ends:
    what each state costs behind the last one. Settled by Dial's bucket queue: arcs
    cost at most DELETE or REROLE + UNENDED, so a ring of few buckets is enough.
    """
    last = len(free)
    dist = [[FAR] * 4 for _ in range(last + 1)]
    finite = [d for d in ends if d < FAR]
    now, ring = min(finite), max(finite) - min(finite) + max(DELETE, REROLE + UNENDED) + 1
    buckets: list[list[tuple[int, int]]] = [[] for _ in range(ring)]
    waiting = 0
    for state, d in enumerate(ends):
        if d < FAR:
            dist[last][state] = d
            buckets[d % ring].append((last, state))
            waiting += 1
    while waiting:
        bucket = buckets[now % ring]
        while bucket:
            place, state = bucket.pop()
            waiting -= 1
            if dist[place][state] != now:
                continue  # found a shorter way since
            for before, source, cost in _into(free, place, state):
                if now + cost < dist[before][source]:
                    dist[before][source] = now + cost
                    buckets[(now + cost) % ring].append((before, source))
                    waiting += 1
        now += 1
    return dist


def _into(free: list[tuple[str, int]], place: int, state: int) -> Iterator[tuple[int, int, int]]:
    """(place, state, cost) of the arcs that end in a node."""
    for source in BEFORE.get(state, ()):
        yield place, source, INSERT
    if not place:
        return
    initial, extra = free[place - 1]
    yield place - 1, state, DELETE
    if not initial:
        yield place - 1, state, extra
    if state == 1 and initial == "s":
        yield place - 1, 0, extra
    for source in BEFORE.get(state, ()):
        yield place - 1, source, extra + (0 if initial == NAMES[state][0] else REROLE)


def _target(state: int) -> int:
    """The state after the next message of user or assistant."""
    return 3 if state == 2 else 2


def walk(free: list[tuple[str, int]], ends: tuple[int, ...], state: int) -> tuple[list[tuple[int, str, int]], int, int]:
    """(edits, end state, cost): the least audit among the cheapest paths.

    An edit is (place, initial, state after it); place counts the messages before it.
    """
    dist = distances(free, ends)
    place, edits, start = 0, [], state
    while True:
        left, onto = dist[place][state], _target(state)
        here = place < len(free)
        if not here and left == ends[state]:
            return edits, state, dist[0][start] - left
        initial, extra = free[place] if here else ("", 0)
        kept = None  # the state if the message stays as it is
        if here:
            kept = state if not initial else 1 if initial == "s" and state == 0 else onto if initial == NAMES[onto][0] else None
        if here and left == DELETE + dist[place + 1][state]:
            edits.append((place, "D", state))
            place += 1
        elif left == INSERT + dist[place][onto]:
            edits.append((place, "I", onto))
            state = onto
        elif kept is not None and left == extra + dist[place + 1][kept]:
            edits.append((place, "K", kept))
            place, state = place + 1, kept
        else:
            edits.append((place, "R", onto))
            place, state = place + 1, onto


# -- chunks ---------------------------------------------------------------

def _rows(messages: DataFrame, copies: Column, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, n, fault) of every different row; n = 0 names a conversation only."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    stays = copies > 0
    given = messages.select(
        F.col(conv_col).alias("conv"), F.when(stays, F.col(turn_col).cast("long")).alias("turn"),
        F.when(stays, space(role_col)).alias("role"), F.when(stays, space(text_col)).alias("text"), copies.cast("long").alias("n"),
    )
    rows = materialize(given.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n")), "repair-rows")
    keys = [F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(7), "role", "text").alias("k2")]
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    met = rows.filter("n > 0").select("conv", *keys, at.alias("at")).groupBy("conv", "k1", "k2").agg(F.min("at").alias("first"), F.count("*").alias("turns"))
    again = materialize(met.filter("turns > 1").select(F.col("conv").alias("conv_"), F.col("k1").alias("k1_"), F.col("k2").alias("k2_"), "first"), "repair-again")
    same = F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("k1") == F.col("k1_")) & (F.col("k2") == F.col("k2_"))
    later = F.coalesce(at > F.col("first"), F.lit(False))
    return rows.select("*", *keys).join(again, same, "left").select("conv", "turn", "role", "text", "n", later.alias("later"))


def _fault(text: str, later: bool) -> int:
    told = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
    return BLANK if not told else DUPLICATE if later else NONE if told[-1] in ".!?" else TRUNCATED


class _Chunk:
    """Consecutive rows of one conversation."""

    def __init__(self, most_rows: int) -> None:
        self.most_rows = most_rows
        self.roles, self.texts, self.turns, self.numbers, self.faults, self.chars = [], [], [], [], [], 0

    def add(self, turn: int | None, role: str, text: str, n: int, later: bool) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.turns.append(turn)
        self.numbers.append(n)
        self.faults.append(_fault(text, later))
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.roles) >= self.most_rows or self.chars >= CHUNK_CHARS

    def counts(self) -> dict[str, int | None]:
        """What :func:`_summed` adds up."""
        faults, numbers, roles = self.faults, self.numbers, self.roles
        known = [t for t in self.turns if t is not None]
        return {
            "blank": sum(n for f, n in zip(faults, numbers) if f == BLANK),
            "duplicate": sum(n if f == DUPLICATE else n - 1 for f, n in zip(faults, numbers) if f != BLANK),
            "truncated": faults.count(TRUNCATED),
            "illegal": sum(n - 1 for n in numbers) + sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:])),
            "turns": len(set(known)), "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None,
            "first_role": roles[0][:1] if roles else None, "last_role": roles[-1][:1] if roles else None,
        }


def _free(roles: list[str], faults: list[int]) -> list[tuple[str, int]]:
    return [(r[:1], UNENDED if f == TRUNCATED else 0) for r, f in zip(roles, faults) if f in (NONE, TRUNCATED)]


def _steps(free: list[tuple[str, int]]) -> list[int]:
    """[4 * state + end state]: least cost through a chunk."""
    ends = [distances(free, tuple(0 if s == e else FAR for s in range(4)))[0] for e in range(4)]
    return [ends[e][s] for s in range(4) for e in range(4)]


_COUNTS = "blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_role string, last_role string"
_CHUNK = f"part int, seq long, whole boolean, roles array<string>, texts array<string>, numbers array<long>, faults array<int>, steps array<long>, {_COUNTS}"


def _batch(rows: list[dict], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in fields], schema=fields)


def _chunks(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """The chunks of conversations, in the order (conv, part, seq)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([rows.schema["conv"], *T.StructType.fromDDL(_CHUNK)])
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, out, held = TaskContext.get().partitionId(), 0, [], 0
        chunk, now, begun, edge = _Chunk(chunk_rows), None, False, True

        def close(whole: bool) -> None:
            nonlocal seq, chunk, held
            steps = None if whole else _steps(_free(chunk.roles, chunk.faults))
            out.append({"conv": now, "part": part, "seq": seq, "whole": whole, "roles": chunk.roles, "texts": chunk.texts, "numbers": chunk.numbers, "faults": chunk.faults, "steps": steps} | chunk.counts())
            held += chunk.chars + 64
            seq, chunk = seq + 1, _Chunk(chunk_rows)

        for batch in batches:
            for conv, *row in zip(*(column.to_pylist() for column in batch.columns)):
                if not begun or conv != now:
                    if begun:
                        close(not edge)
                        edge = False  # what begins inside a partition is whole unless it is cut
                    now, begun = conv, True
                elif chunk.full():
                    close(False)
                    edge = True
                if row[3]:
                    chunk.add(*row)
            if held >= CHUNK_CHARS:
                yield _batch(out, fields)
                out, held = [], 0
        if begun:
            close(False)
        yield _batch(out, fields)

    order = ["conv", "turn", "role", "text"]
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), "conv", "turn", "role", F.substring("text", 1, 64))
    return dealt.sortWithinPartitions(*order).select(*order, "n", "later").mapInArrow(run, schema)


def _along(rows: DataFrame, down: bool, schema: str, step: Callable) -> DataFrame:
    """mapInArrow over (conv, part, seq, ...) of each conversation in order.

    step(state or None, values) -> (state, output values); all a task holds is the state.
    """
    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, state = None, False, None
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for conv, part, seq, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or conv != now:
                    now, begun, state = conv, True, None
                state, found = step(state, *values)
                for column, value in zip(out, (part, seq, *found)):
                    column.append(value)
            kinds = [pa.int32(), pa.int64(), *(pa.list_(pa.int64()) if "array" in x else pa.int64() for x in schema.split(", ")[2:])]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=names)

    order = [F.col(c).desc() if down else F.col(c) for c in ("part", "seq")]
    return rows.repartition("conv").sortWithinPartitions("conv", *order).mapInArrow(run, schema)


def _before(ends: list[int] | None, steps: list[int]) -> tuple[list[int], tuple[list[int]]]:
    """Distances from behind a chunk to before it."""
    ends = ends or list(END)
    return [min(steps[4 * s + e] + ends[e] for e in range(4)) for s in range(4)], (ends,)


def _through(state: int | None, exits: list[int], ends: list[int]) -> tuple[int, tuple[int, list[int]]]:
    """The state behind a chunk from that before it."""
    return exits[state or 0], (state or 0, ends)


def _plan(chunks: DataFrame) -> DataFrame:
    """(part, seq, state, ends): the states before and the distances behind chunks of cut conversations."""
    cut = chunks.filter("not whole")
    ends = _along(cut.select("conv", "part", "seq", "steps"), True, "part int, seq long, ends array<bigint>", _before)

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for roles, faults, behind in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5))):
                free = _free(roles, faults)
                found.append([walk(free, tuple(behind), s)[1] for s in range(4)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64())), batch.column(5)], names=["conv", "part", "seq", "exits", "ends"])

    schema = T.StructType([chunks.schema["conv"], *T.StructType.fromDDL("part int, seq long, exits array<bigint>, ends array<bigint>")])
    initials = F.transform("roles", lambda r: F.substring(r, 1, 1))
    known = cut.select("part", "seq", "conv", initials.alias("roles"), "faults").join(ends, ["part", "seq"]).select("conv", "part", "seq", "roles", "faults", "ends").mapInArrow(exits, schema)
    return materialize(_along(known, False, "part int, seq long, state bigint, ends array<bigint>", _through), "repair-plan")


def _edited(roles: list[str], texts: list[str], numbers: list[int], faults: list[int], ends: tuple[int, ...], state: int) -> tuple[str, list[tuple[str, str]], int]:
    """(audit, repaired messages, cost) of a chunk; what must go goes before anything is inserted."""
    free = [k for k, f in enumerate(faults) if f in (NONE, TRUNCATED)]
    edits, _, cost = walk(_free(roles, faults), ends, state)
    forced = [0] * (len(free) + 1)  # deletions between the messages that may stay
    place = 0
    for fault, n in zip(faults, numbers):
        if fault in (NONE, TRUNCATED):
            place += 1
            n -= 1
        forced[place] += n
    audit, left, reached = ["D" * forced[0]], [], 0
    for place, edit, after in edits:
        if edit == "I":
            left.append((NAMES[after], ""))
        elif edit != "D":
            k = free[place]
            left.append((roles[k] if edit == "K" else NAMES[after], texts[k]))
        audit.append(edit)
        if edit != "I":
            reached = place + 1
            audit.append("D" * forced[reached])
    return "".join(audit), left, cost + DELETE * sum(forced)


def _walked(chunks: DataFrame) -> DataFrame:
    """The chunks with audit, cost and repaired messages; chunks of cut conversations are planned first."""
    from pyspark.sql.pandas.types import to_arrow_schema

    of = T.StructType.fromDDL(f"part int, seq long, whole boolean, {_COUNTS}, audit string, cost long, messages array<struct<role string, text string>>")
    schema = T.StructType([chunks.schema["conv"], *of])
    fields, kept = to_arrow_schema(schema), [chunks.schema["conv"].name, *of.names[:-3]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            given = zip(*(columns[c].to_pylist() for c in ("roles", "texts", "numbers", "faults", "ends", "state")))
            audit, messages, cost = zip(*(_edited(*row[:4], tuple(row[4] or END), row[5] or 0) for row in given)) if batch.num_rows else ((), (), ())
            made = [pa.array(audit, pa.string()), pa.array(cost, pa.int64()), pa.array([[{"role": r, "text": t} for r, t in m] for m in messages], fields.field("messages").type)]
            yield pa.RecordBatch.from_arrays([*(columns[c].cast(fields.field(c).type) for c in kept), *made], schema=fields)

    whole = chunks.filter("whole").withColumns({"state": F.lit(0).cast("long"), "ends": F.lit(None).cast("array<bigint>")})
    cut = chunks.filter("not whole").join(_plan(chunks), ["part", "seq"])
    return whole.unionByName(cut.select(*whole.columns)).mapInArrow(run, schema)


def _summed(walked: DataFrame) -> DataFrame:
    """One row a conversation; chunks of one pass in order, and none is held."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([walked.schema["conv"], *T.StructType.fromDDL("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")])
    fields, names = to_arrow_schema(schema), walked.columns

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield from (dict(zip(names, row)) for row in zip(*(c.to_pylist() for c in batch.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for _, parts in groupby(chunks(batches), key=lambda c: (c["conv"], c["part"], c["seq"]) if c["whole"] else (c["conv"],)):
            sums, audit, digest, sep = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "turns"), 0), [], hashlib.sha256(), ""
            least = most = role = None
            for c in parts:
                for name in sums:
                    sums[name] += c[name]
                if c["first_role"] is not None:
                    sums["illegal"] += role is not None and role + c["first_role"] not in LEGAL
                    role = c["last_role"]
                if c["first_turn"] is not None:
                    sums["turns"] -= most == c["first_turn"]
                    least, most = c["first_turn"] if least is None else least, c["last_turn"]
                audit.append(c["audit"])
                for m in c["messages"]:
                    digest.update(f"{sep}{m['role']}:{m['text']}".encode())
                    sep = "\n"
            turns = sums.pop("turns")
            out.append(sums | {"conv": c["conv"], "gaps": 0 if least is None else most - least + 1 - turns, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()})
            if len(out) >= 1000:
                yield _batch(out, fields)
                out = []
        yield _batch(out, fields)

    in_order = walked.filter("not whole").repartition("conv").sortWithinPartitions("conv", "part", "seq")
    return walked.filter("whole").mapInArrow(run, schema).unionByName(in_order.mapInArrow(run, schema))


def _prepared(messages: DataFrame, copies: Column | None, chunk_rows: int, **columns: str) -> DataFrame:
    return materialize(_chunks(_rows(messages, F.lit(1) if copies is None else copies, **columns), chunk_rows), "repair-chunks")


def repaired(messages: DataFrame, *, copies: Column | None = None, chunk_rows: int = CHUNK_ROWS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row a conversation.

    copies: how often a row stands in its conversation (default once; 0 for a row
    that only names it). The hash is over ``role:text`` of the repaired messages,
    joined by newlines.
    """
    with temporary_tables(messages.sparkSession):
        chunks = _prepared(messages, copies, chunk_rows, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
        walked = materialize(_walked(chunks), "repair-walked")
    return _summed(walked).withColumnRenamed("conv", conv_col)


def repaired_messages(messages: DataFrame, *, copies: Column | None = None, chunk_rows: int = CHUNK_ROWS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, part, seq, place, role, text): the repaired messages, in this order."""
    chunks = _prepared(messages, copies, chunk_rows, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    return _walked(chunks).select(F.col("conv").alias(conv_col), "part", "seq", F.posexplode("messages").alias("place", "m")).select(conv_col, "part", "seq", "place", "m.*")


# -- planted damage -------------------------------------------------------

def damaged(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, Column]:
    """The rows with planted faults, and how often each then stands.

    Of 20 rows, told by crc32 of ``conv:turn`` (a null is one space), one is dropped,
    one emptied, one loses its ends of sentences, one stands twice and one becomes
    the user's.
    """
    written = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)))
    kind = F.crc32(written.cast("binary")) % 20
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    rows = messages.select(
        F.col(conv_col), F.col(turn_col), F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col(role_col).cast("string"), F.lit(" "))).alias(role_col),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias(text_col),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return rows, F.col("copies")


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _way(of: str, cost: str, edit: str, message: str | None) -> str:
    """A state's record after one more edit: cost, audit, repaired messages."""
    told = f"{of}.r" if message is None else f"list_append({of}.r, {message})"
    return f"struct_pack(c := {of}.c + {cost}, a := {of}.a || '{edit}', r := {told})"


def _inserted(n: str, out: str) -> str:
    """Columns of the states once more insertions are allowed."""
    user = [_way(f"{n}{s}", str(INSERT), "I", "'user:'") for s in BEFORE[2]]
    return f"{n}0 AS {out}0, {n}1 AS {out}1, {_least(f'{n}2', *user)} AS {out}2, {_least(f'{n}3', _way(f'{n}2', str(INSERT), 'I', chr(39) + 'assistant:' + chr(39)))} AS {out}3"


def _stay(of: str, letter: str) -> str:
    cost = f"(extra + CASE WHEN left(role, 1) = '{letter[0]}' THEN 0 ELSE {REROLE} END)"
    role, kept = f"CASE WHEN left(role, 1) = '{letter[0]}' THEN role ELSE '{letter}' END", f"CASE WHEN left(role, 1) = '{letter[0]}' THEN 'K' ELSE 'R' END"
    return f"struct_pack(c := {of}.c + CASE WHEN forced THEN {FAR // 8} ELSE {cost} END, a := {of}.a || {kept}, r := list_append({of}.r, {role} || ':' || text))"


def _silent(of: str) -> str:
    """A message without an initial stays and changes no state."""
    return f"struct_pack(c := {of}.c + CASE WHEN forced OR role <> '' THEN {FAR // 8} ELSE extra END, a := {of}.a || 'K', r := list_append({of}.r, role || ':' || text))"


_FAR_WAY = f"struct_pack(c := {FAR // 8}::BIGINT, a := '', r := []::VARCHAR[])"
_SYSTEM = f"struct_pack(c := s0.c + CASE WHEN forced OR left(role, 1) <> 's' THEN {FAR // 8} ELSE extra END, a := s0.a || 'K', r := list_append(s0.r, role || ':' || text))"
_CRC = "xor(({x})::BIGINT >> 1, 3988292384 * (({x})::BIGINT & 1))".format(x="CASE WHEN o >= 0 THEN xor(c, o) ELSE c END")

#: The same by dynamic programming over whole conversations: for each state the
#: cheapest way to it, of equal costs the least audit.
ORACLE_SQL = f"""
WITH RECURSIVE named AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS written FROM conversations
), coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(written) + 1), lambda i: [ascii(substr(written, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1]))), lambda c, o: {_CRC}), 4294967295) % 20 AS kind
  FROM named
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 0 THEN []::INT[] WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM coded
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS role_before,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen
  FROM damaged
), judged AS (
  SELECT *, regexp_matches(text, '[^\x20\x09-\x0D]') AS told,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last_char FROM placed
), rows AS (
  SELECT *, NOT told AS is_blank, told AND seen > 1 AS is_duplicate, told AND seen = 1 AND last_char NOT IN ('.', '!', '?') AS is_truncated,
    NOT told OR seen > 1 AS forced, CASE WHEN told AND seen = 1 AND last_char NOT IN ('.', '!', '?') THEN {UNENDED} ELSE 0 END AS extra FROM judged
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (WHERE is_blank)::BIGINT AS blank, count(*) FILTER (WHERE is_duplicate)::BIGINT AS duplicate,
    count(*) FILTER (WHERE is_truncated)::BIGINT AS truncated,
    count(*) FILTER (WHERE role_before IS NOT NULL AND left(role_before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, count(*) AS n
  FROM rows GROUP BY conv_id
), start AS (
  SELECT conv_id, 0::BIGINT AS k, struct_pack(c := 0::BIGINT, a := '', r := []::VARCHAR[]) AS n0, {_FAR_WAY} AS n1, {_FAR_WAY} AS n2, {_FAR_WAY} AS n3
  FROM (SELECT DISTINCT conv_id FROM conversations)
), ways AS (
  SELECT conv_id, k, {_inserted("m", "s")} FROM (SELECT conv_id, k, {_inserted("n", "m")} FROM start)
  UNION ALL
  SELECT conv_id, k, {_inserted("m", "s")} FROM (SELECT conv_id, k, {_inserted("n", "m")} FROM (
    SELECT w.conv_id, r.k, {_least(_way("s0", str(DELETE), "D", None), _silent("s0"))} AS n0,
      {_least(_way("s1", str(DELETE), "D", None), _silent("s1"), _SYSTEM)} AS n1,
      {_least(_way("s2", str(DELETE), "D", None), _silent("s2"), *(_stay(f"s{s}", "user") for s in BEFORE[2]))} AS n2,
      {_least(_way("s3", str(DELETE), "D", None), _silent("s3"), _stay("s2", "assistant"))} AS n3
    FROM ways w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.k = w.k + 1))
), best AS (
  SELECT w.conv_id, {_least("s0", "s3")} AS way FROM ways w LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.k = coalesce(c.n, 0)
)
SELECT b.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, b.way.c AS cost, b.way.a AS audit, sha256(array_to_string(b.way.r, chr(10))) AS repaired_sha256
FROM best b LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""
