"""Conversations without quotations, ordered by who replies to whom.

Lines are parsed for nested quote marks; the text after them is normalised
(lower case, single spaces) and hashed, line by line, for every unbroken passage
of one quote level and for every paragraph of it, and so are the lines, paragraphs,
unbroken passages and the whole of each message's own words: a quote that a mail
client has wrapped anew differs in its lines, not in its paragraphs. Lines that
introduce a deeper quote end a paragraph and belong to none. A quoted hash is joined to the latest earlier message of
its conversation with the same hash; the message that supplies most quoted
characters at the outermost level is the one replied to (ties: the latest).
Messages without a linked quote reply to the message before them.

The reply order of a conversation is (branch, turn): a message continues the
branch of the message it replies to if it is the first to reply to that, else
it begins a branch named by its own turn. So a message always follows the one it
replies to, and first replies follow each other without a break.

Joins "to the latest earlier" never pair the rows of a group: turns are dealt in
ranges, a range finds its own latest row by a running window, and the latest of
all earlier ranges is carried in, so a conversation with a third of all rows is
spread over many tasks. Uses Spark expressions only.

Defined cases: null or empty text has neither own words nor quotes; a null
conversation or turn is kept, linked to nothing; repeated (conversation, turn)
rows are kept and linked alike; lines "On ... wrote:" before a quote are dropped
with it, however long; very long texts are parsed whole; an empty table yields no
rows; other columns are kept, and results whose names they have get underscores in
front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenveil.llm.textframe import free_name
from lumenveil.session import discard, materialize

#: Turns in one range.
RANGE = 1024
#: Fixed value: the most blanks before each mark of a quoted line.
MARK_BLANKS = 3
#: Fixed value: a line that introduces a quote.
INTRODUCES = r"(?i)^\s*on\b.+\bwrote:\s*$"


def _latest_before(rows: DataFrame, keys: list[str], value: Column, found: str) -> DataFrame:
    """rows with ``found``: the last non-null ``value`` on earlier turns of a key.

    rows need a column turn; value must be null on the rows that only ask.
    """
    ranged = rows.withColumn("_range", F.floor(F.col("turn") / RANGE)).withColumn("_value", value)
    ends = ranged.groupBy(*keys, "_range").agg(F.max(F.when(F.col("_value").isNotNull(), F.struct("turn", "_value"))).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_range", F.last("_last", ignorenulls=True).over(earlier)["_value"].alias("_carried"))
    inside = Window.partitionBy(*keys, "_range").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = ranged.withColumn("_near", F.last("_value", ignorenulls=True).over(inside))
    joined = near.join(carried, [*keys, "_range"], "left")
    return joined.withColumn(found, F.coalesce("_near", "_carried")).drop("_range", "_value", "_near", "_carried")


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _marks(line: Column) -> Column:
    """The quote marks at the start of a line, with at most MARK_BLANKS blanks before each.

    A run of one character class and a cut, as a repeated group would recurse once a mark.
    """
    run = F.regexp_extract(line, r"^[ \t>]*+", 0)
    marks = F.rtrim(F.split(run, rf"[ \t]{{{MARK_BLANKS + 1}}}", 2)[0], F.lit(" \t"))
    return F.when(line.contains(">"), marks).otherwise("")


def parsed(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """The given rows with lines = array<struct<depth, text>> and own words.

    own: the message without quotes and their introductions.
    """
    marked = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\r?\n"), lambda x: F.struct(x.alias("line"), _marks(x).alias("marks")))
    rest = lambda x: F.substring(x["line"], F.length(x["marks"]) + 1, F.length(x["line"]))
    lines = F.transform(
        marked,
        lambda x: F.struct(
            F.when(x["marks"] == "", 0).otherwise(F.length(x["marks"]) - F.length(F.translate(x["marks"], ">", ""))).alias("depth"),
            F.when(x["marks"] == "", x["line"]).otherwise(F.regexp_replace(rest(x), "^ ", "")).alias("text"),
        ),
    )
    cut = messages.withColumn("lines", lines)
    follows = lambda i: F.coalesce(F.get("lines", i + 1)["depth"] > 0, F.lit(False)) | (
        (F.trim(F.coalesce(F.get("lines", i + 1)["text"], F.lit("x"))) == "") & F.coalesce(F.get("lines", i + 2)["depth"] > 0, F.lit(False))
    )
    own = F.filter("lines", lambda x, i: (x["depth"] == 0) & ~(x["text"].rlike(INTRODUCES) & follows(i)))
    own_text = F.array_join(F.transform(own, lambda x: x["text"]), "\n")
    return cut.withColumn("own", F.btrim(F.regexp_replace(own_text, r"\n\s*\n\s*\n+", "\n\n"), F.lit(" \t\n\x0b\f\r")))


def passages(rows: DataFrame) -> DataFrame:
    """(conv, turn, depth, hash, size): hashed passages of parsed messages.

    depth 0 is a message's own words; each line, paragraph and whole passage counts.
    """
    deeper = lambda x, i: F.coalesce(F.get("lines", i + 1)["depth"] > x["depth"], F.lit(False)) | (
        (F.trim(F.coalesce(F.get("lines", i + 1)["text"], F.lit("x"))) == "") & F.coalesce(F.get("lines", i + 2)["depth"] > x["depth"], F.lit(False))
    )
    placed = F.transform("lines", lambda x, i: F.struct(x["depth"].alias("depth"), x["text"].alias("text"), i.alias("at"), (deeper(x, i) & x["text"].rlike(INTRODUCES)).alias("intro")))
    written = rows.withColumn("written", F.filter(placed, lambda x: F.trim(x["text"]) != "")).withColumn("told", F.filter("written", lambda x: ~x["intro"]))

    def starts(of: str, gaps: bool) -> Column:
        """Where the quote level changes (or lines are left out); the end of the text closes the last passage."""
        same = lambda i: F.get(of, i)["depth"].eqNullSafe(F.get(of, i - 1)["depth"])
        near = lambda i: F.get(of, i)["at"].eqNullSafe(F.get(of, i - 1)["at"] + 1)
        found = F.filter(F.sequence(F.lit(0), F.size(of)), lambda i: ~(same(i) & near(i)) if gaps else ~same(i))
        return F.when(F.size(of) > 0, found).otherwise(F.array(F.lit(0)))

    def runs(of: str, begins: str) -> Column:
        text = lambda at, upto: F.array_join(F.transform(F.slice(of, at + 1, upto - at), lambda x: x["text"]), " ")
        return F.transform(
            F.slice(begins, 1, F.size(begins) - 1),
            lambda at, k: F.struct(F.get(of, at)["depth"].alias("depth"), text(at, F.get(begins, k + 1)).alias("text")),
        )

    own = F.array(F.struct(F.lit(0).alias("depth"), F.col("own").alias("text")))
    whole = F.filter(runs("written", "starts"), lambda x: x["depth"] > 0)
    every = F.concat(F.col("lines"), whole, runs("told", "levels"), runs("told", "paragraphs"), own)
    placed = written.filter("conv is not null and turn is not null").withColumns(
        {"starts": starts("written", False), "levels": starts("told", False), "paragraphs": starts("told", True)}
    )
    found = placed.select("conv", "turn", F.inline(every))
    normal = found.withColumn("text", _normal(F.col("text"))).filter("text <> ''")
    return normal.select("conv", "turn", "depth", F.xxhash64("text").alias("hash"), F.length("text").alias("size")).distinct()


def linked(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """(conv, turn, reply_to, linked, quoted): what each turn replies to.

    linked: how many passages were found in earlier messages; quoted: how many
    quoted passages the turn has. reply_to is null for a first turn.
    """
    rows = parsed(messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).alias("text")))
    units = materialize(passages(rows), "passages")  # read four times below
    asked = units.filter("depth > 0").select("conv", "hash").distinct()
    origins = units.filter("depth = 0").select("conv", "turn", "hash").distinct().join(asked, ["conv", "hash"], "left_semi").withColumn("depth", F.lit(0)).withColumn("size", F.lit(0))
    both = units.filter("depth > 0").unionByName(origins)
    sources = _latest_before(both, ["conv", "hash"], F.when(F.col("depth") == 0, F.col("turn")), "source").filter("depth > 0")
    outer = F.min(F.when(F.col("source").isNotNull(), F.col("depth"))).over(Window.partitionBy("conv", "turn"))
    votes = sources.withColumn("outer", outer)
    per_source = votes.groupBy("conv", "turn", "source").agg(
        F.sum(F.when(F.col("depth") == F.col("outer"), F.col("size")).otherwise(0)).alias("size"), F.count("*").alias("n")
    )
    best = per_source.groupBy("conv", "turn").agg(
        F.max(F.when(F.col("source").isNotNull(), F.struct("size", "source")))["source"].alias("quoted_turn"),
        F.sum(F.when(F.col("source").isNotNull(), F.col("n"))).alias("linked"),
        F.sum("n").alias("quoted"),
    )
    turns = rows.filter("conv is not null and turn is not null").select("conv", "turn").distinct()
    before = _latest_before(turns, ["conv"], F.col("turn"), "before")
    joined = before.join(best, ["conv", "turn"], "left")
    return joined.select(
        "conv", "turn", F.coalesce("quoted_turn", "before").alias("reply_to"), "before",
        F.coalesce("linked", F.lit(0)).cast("long").alias("linked"), F.coalesce("quoted", F.lit(0)).cast("long").alias("quoted"),
    )


def branches(replies: DataFrame) -> DataFrame:
    """replies with ``branch``, by doubling along the first replies.

    Turns that reply to the turn before them run on in one piece; only pieces are
    linked by doubling, so conversations without jumps need no round.
    """
    replies = materialize(replies, "replies")
    first = replies.filter("reply_to is not null").groupBy("conv", F.col("reply_to").alias("parent")).agg(F.min("turn").alias("first"))
    begins = (F.col("before").isNull()) | (F.col("reply_to") != F.col("before"))
    placed = replies.withColumn("_begin", F.when(begins, F.col("turn")))
    placed = _latest_before(placed, ["conv"], F.col("_begin"), "_earlier").withColumn("piece", F.coalesce("_begin", "_earlier")).drop("_begin", "_earlier")
    placed = materialize(placed, "pieces")
    jumps = placed.filter("turn = piece and reply_to is not null").select("conv", "turn", F.col("reply_to").alias("parent"))
    followed = jumps.join(first, ["conv", "parent"]).filter("first = turn").select("conv", "turn", "parent")
    at = placed.select("conv", F.col("turn").alias("parent"), F.col("piece").alias("to"))
    links = materialize(followed.join(at, ["conv", "parent"]).select("conv", F.col("turn").alias("piece"), "to"), "branches")
    while True:
        onward = links.select("conv", F.col("piece").alias("to"), F.col("to").alias("further"))
        longer = links.join(onward, ["conv", "to"], "left")
        if not longer.filter("further is not null").limit(1).count():
            break
        after = materialize(longer.select("conv", "piece", F.coalesce("further", "to").alias("to")), "branches")
        discard(links)
        links = after
    return placed.join(links, ["conv", "piece"], "left").select("conv", "turn", "reply_to", "linked", "quoted", F.coalesce("to", "piece").alias("branch"))


def conversations(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """The given rows without quotes in ``text_col``, and their place.

    Adds reply_to, branch, linked, quoted; sort by (conv_col, branch, turn_col) for
    the reply order.
    """
    placed = branches(linked(messages, conv_col=conv_col, turn_col=turn_col, text_col=text_col))
    rows = messages.select(F.struct("*").alias("row"), F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).alias("text"))
    own = parsed(rows).select("row", "conv", "turn", "own")
    named = own.filter("conv is not null and turn is not null").join(materialize(placed, "places"), ["conv", "turn"], "left")
    unnamed = own.filter("conv is null or turn is null")  # these meet nothing, so they need not be shuffled to meet it
    joined = named.unionByName(unnamed, allowMissingColumns=True)
    place = [F.col(c).alias(free_name(c, messages.columns)) for c in ("reply_to", "branch", "linked", "quoted")]
    return joined.select(F.col("row").withField(f"`{text_col}`", F.col("own")).alias("row"), *place).select("row.*", *(F.col(free_name(c, messages.columns)) for c in ("reply_to", "branch", "linked", "quoted")))
