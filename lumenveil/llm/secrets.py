"""Secret scanning with Spark expressions only.

Base rules find assignments to secret-like names, access keys and long hex
strings. On top of them, candidate strings (long runs of key characters that
hold a letter and a digit) are scored by the Shannon entropy of every window of
fixed width: as the window moves by one character, two counts change and the sum
of c*log2(c) changes with them, so a string costs its length. A candidate is
reported when its best window passes the threshold of its character class,
unless the allow-list suppresses it.

Positions come from the text between matches: the parts left by splitting at a
pattern and the matches themselves, added up in code points.

Defined cases: null text is the empty text, without spans; very long texts are
scanned whole; repeated rows are repeated in the result; an empty table yields
no rows; other columns are kept by :func:`find_secrets`, whatever their names
(if one is called ``spans``, the result has underscores in front).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenveil.llm.textframe import free_name

#: The base rules. (kind, pattern, shortest length of what counts)
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_LEAST = 6
#: Candidates of the entropy rule, and the width of its window.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
WINDOW = 20
#: Character classes in order: (name, pattern of the whole candidate, bits per character).
CLASSES = (("hex", r"^[0-9A-Fa-f]+$", 3.0), ("alphanumeric", r"^[0-9A-Za-z]+$", 3.7), ("base64", r"^[0-9A-Za-z+/_-]+$", 3.9))
#: Matches gathered at a time.
BLOCK = 256
#: Candidates that are no secrets: UUIDs, words joined to paths or slugs, samples.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"^/?(?:[A-Za-z]++[0-9]{0,4}+[/_-]++)++[A-Za-z]*+[0-9]{0,4}+$",
    r"(?i)(example|sample|dummy|placeholder)",
)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often it is used."""
    return F.transform(F.array(value), body)[0]


def _located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>>: all matches of ``pattern``, code points.

    Adding to an array copies it, so matches are gathered in blocks.
    """
    none = F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)")

    def place(parts: Column) -> Column:
        number = F.size(parts["matches"])

        def step(state: Column, i: Column) -> Column:
            start = state["at"] + F.length(F.get(parts["between"], i))
            match = F.get(parts["matches"], i)
            return _let(
                F.struct(start.alias("start"), (start + F.length(match)).alias("end"), match.alias("text")),
                lambda m: F.struct(m["end"].alias("at"), F.concat(state["out"], F.array(m)).alias("out")),
            )

        def block(state: Column, k: Column) -> Column:
            empty = F.struct(state["at"].alias("at"), none.alias("out"))
            some = F.sequence(k * BLOCK, F.least((k + 1) * BLOCK, number) - 1)
            return _let(F.aggregate(some, empty, step), lambda done: F.struct(done["at"].alias("at"), F.concat(state["out"], F.array(done["out"])).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<struct<start:int,end:int,text:string>>>)").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), ((number - 1) / BLOCK).cast("int")), start, block, lambda state: F.flatten(state["out"]))

    return _let(
        F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)),
        lambda matches: F.when(F.size(matches) == 0, none).otherwise(
            _let(F.struct(matches.alias("matches"), F.split(text, pattern, -1).alias("between")), place)
        ),
    )


def window_entropy(text: Column, width: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of ``width`` consecutive characters.

    For ASCII text; 0 where it is shorter than the window.
    """

    def xlogx(c: Column) -> Column:
        return F.when(c <= 1, F.lit(0.0)).otherwise(c * F.log2(c.cast("double")))

    def put(counts: Column, k: Column, change: int) -> Column:
        return F.concat(F.slice(counts, 1, k), F.array(F.get(counts, k) + change), F.slice(counts, k + 2, 128))

    def scan(chars: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            enters = F.ascii(F.get(chars, i))
            leaves = F.when(i >= width, F.ascii(F.get(chars, i - width))).otherwise(-1)

            def enter(move: Column) -> Column:
                old = F.get(state["counts"], move["enters"])
                return F.struct(
                    put(state["counts"], move["enters"], 1).alias("counts"),
                    (state["total"] + xlogx(old + 1) - xlogx(old)).alias("total"),
                    move["leaves"].alias("leaves"),
                )

            def leave(now: Column) -> Column:
                old = F.get(now["counts"], now["leaves"])
                return F.when(
                    now["leaves"] >= 0,
                    F.struct(put(now["counts"], now["leaves"], -1).alias("counts"), (now["total"] - xlogx(old) + xlogx(old - 1)).alias("total")),
                ).otherwise(F.struct(now["counts"].alias("counts"), now["total"].alias("total")))

            def score(now: Column) -> Column:
                bits = F.log2(F.lit(float(width))) - now["total"] / width
                return F.struct(now["counts"].alias("counts"), now["total"].alias("total"), F.when(i >= width - 1, F.greatest(state["best"], bits)).otherwise(state["best"]).alias("best"))

            moved = _let(F.struct(enters.alias("enters"), leaves.alias("leaves")), enter)
            return _let(_let(moved, leave), score)

        zero = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), zero, step, lambda state: state["best"])

    return F.when(F.length(text) < width, F.lit(0.0)).otherwise(_let(F.split(text, ""), scan))


def _typed(spans: Column, kind: str) -> Column:
    return F.transform(
        spans, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["text"].alias("text"))
    )


def find_secrets(docs: DataFrame, *, text_col: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """The given rows with ``spans``, by start and then by kind.

    spans: array<struct<start, rank, end, kind, text>>; rank is the kind's place in
    KINDS. Base spans are never suppressed.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    assign = F.filter(_located(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["text"], ASSIGN, 2)) >= ASSIGN_LEAST)

    def high(m: Column) -> Column:
        least = F.lit(99.0)
        for _, pattern, bits in reversed(CLASSES):
            least = F.when(m["text"].rlike(pattern), F.lit(bits)).otherwise(least)
        benign = F.lit(False)
        for pattern in allowed:
            benign = benign | m["text"].rlike(pattern)
        return F.when(m["text"].rlike("[0-9]") & m["text"].rlike("[A-Za-z]") & ~benign, window_entropy(m["text"]) >= least).otherwise(False)

    entropy = F.filter(_located(text, CANDIDATE), high)
    spans = F.concat(_typed(assign, "assign"), _typed(_located(text, ACCESS), "access"), _typed(_located(text, HEX), "hex"), _typed(entropy, "entropy"))
    return docs.withColumn(free_name("spans", docs.columns), F.array_sort(spans))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
