"""Scalar functions over task, worker and media columns, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two lists of video suffixes.
CLUSTER_SUFFIXES = (".mp4", ".mov", ".avi", ".mkv", ".m4v", ".webm", ".flv", ".wmv", ".ts", ".mts")
BATCH_SUFFIXES = CLUSTER_SUFFIXES + (".m2ts", ".mpg", ".mpeg", ".3gp", ".vob", ".ogv", ".asf")
#: Fixed value: the namespace of name-based UUIDs of URLs.
UUID_URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def server_name(worker: Column) -> Column:
    """Worker id without its numeric slot; ``unassigned`` for null or empty."""
    found = F.regexp_extract(worker, r"^(.+)-slot-([0-9]+)$", 1)
    return F.when(worker.isNull() | (worker == ""), F.lit("unassigned")).when(found == "", worker).otherwise(found)


def base_worker_id(worker: Column) -> Column:
    """Worker id up to its last ``-slot-``, whatever follows."""
    found = F.regexp_extract(worker, r"^(.*)-slot-.*$", 1)
    return F.when(found == "", worker).otherwise(found)


def suffix(path: Column) -> Column:
    """The lower-case file suffix with its dot, or ''."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def output_key(key: Column, source_prefix: str = "source/inbox/", output_prefix: str = "outputs/") -> Column:
    """Where the masked copy of an object goes: same folders, masked_<stem>.mp4."""
    rest = F.when(key.startswith(source_prefix), F.substr(key, F.lit(len(source_prefix) + 1))).otherwise(key)
    folder = F.regexp_extract(rest, r"^(.*/)?[^/]*$", 1)
    stem = F.regexp_replace(basename(rest), r"\.[^.]*$", "")
    return F.concat(F.lit(output_prefix), folder, F.lit("masked_"), stem, F.lit(".mp4"))


def uuid5_url(name: Column) -> Column:
    """The name-based (version 5) UUID of a URL."""
    digest = F.sha1(F.concat(F.unhex(F.lit(UUID_URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*(F.lit(c) for c in "89ab")), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1))
    part = lambda at, n: F.substring(digest, at, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def format_duration(seconds: Column) -> Column:
    """h:mm:ss, or m:ss under an hour; null for null, 0:00 below zero."""
    s = F.when(seconds.isNotNull(), F.greatest(F.floor(seconds), F.lit(0))).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(r))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(r)))


def spoken_duration(seconds: Column) -> Column:
    """``1h 2m 3s`` without leading zero parts."""
    s = F.floor(seconds).cast("long")
    h, m, r = (F.floor(s / 3600)).cast("string"), F.floor(s % 3600 / 60).cast("string"), (s % 60).cast("string")
    return (
        F.when(s >= 3600, F.concat(h, F.lit("h "), m, F.lit("m "), r, F.lit("s"))).when(s >= 60, F.concat(m, F.lit("m "), r, F.lit("s"))).otherwise(F.concat(r, F.lit("s")))
    )


UNITS = ("KiB", "MiB", "GiB", "TiB")


def format_bytes(size: Column, largest: str = "TiB") -> Column:
    """IEC size with one decimal from KiB on, up to the ``largest`` unit."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(UNITS[: UNITS.index(largest) + 1], 1):
        out = F.when(size >= 1024**k, F.concat(F.format_string("%.1f", F.bround(size / 1024**k, 1)), F.lit(f" {unit}"))).otherwise(out)
    return F.when(size.isNull(), F.lit("-")).otherwise(out)


def parse_fps(text: Column, default: float = 25.0) -> Column:
    """``num/den`` or a number; ``default`` where that is not within 1..240."""
    parts = F.split(text, "/")
    number = F.try_divide(F.get(parts, 0).try_cast("double"), F.coalesce(F.get(parts, 1), F.lit("1")).try_cast("double"))
    return F.when(number.between(1, 240), number).otherwise(F.lit(default))


def target_bitrate(width: Column, height: Column, fps: Column, source: Column, per_pixel: float = 0.10) -> Column:
    """max(w*h*fps*per_pixel, 1e6), at most the source's bitrate if that is known."""
    wanted = F.greatest(F.floor(width * height * fps * per_pixel), F.lit(1_000_000)).cast("long")
    return F.when(source > 0, F.least(wanted, source)).otherwise(wanted)


def multiple_of_32(x: Column) -> Column:
    """Rounded half to even to a multiple of 32, at least 32."""
    return F.greatest(F.bround(x / 32) * 32, F.lit(32)).cast("int")


def rotated_size(width: Column, height: Column, rotation: Column) -> Column:
    """struct<width, height, transpose>: the size after undoing the rotation."""
    turned = F.pmod(rotation, F.lit(360))
    side = turned.isin(90, 270)
    code = F.when(turned == 90, "clock").when(turned == 180, "flip").when(turned == 270, "cclock").otherwise("none")
    return F.struct(F.when(side, height).otherwise(width).alias("width"), F.when(side, width).otherwise(height).alias("height"), code.alias("transpose"))


def first_truthy(*values: Column) -> Column:
    """The first value that is neither null nor zero, else 0."""
    return F.coalesce(*(F.nullif(v, F.lit(0)) for v in values), F.lit(0))


def is_true(value: Column, default: bool = False) -> Column:
    """A settings text as boolean."""
    return F.coalesce(F.lower(F.trim(value)).isin("1", "true", "yes", "on"), F.lit(default))


def slots(text: Column, most: int = 16) -> Column:
    """``1,3-5`` as a sorted array of distinct slot numbers within 1..most."""
    ranges = F.transform(
        F.split(text, ","),
        lambda p: F.sequence(F.trim(F.get(F.split(p, "-"), 0)).cast("int"), F.trim(F.coalesce(F.get(F.split(p, "-"), 1), F.get(F.split(p, "-"), 0))).cast("int")),
    )
    return F.array_sort(F.array_distinct(F.filter(F.flatten(ranges), lambda s: s.between(1, most))))


def is_ipv4(text: Column) -> Column:
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return F.coalesce(text.rlike(rf"^{octet}(\.{octet}){{3}}$"), F.lit(False))


def is_ip(text: Column) -> Column:
    """An IPv4 or IPv6 address; the latter may end in an IPv4 one and name a scope."""
    bare = F.regexp_replace(text, r"%[^%/]+$", "")
    tail = F.regexp_extract(bare, r":([0-9.]+\.[0-9.]+)$", 1)
    plain = F.when(is_ipv4(tail), F.concat(F.substring(bare, F.lit(1), F.length(bare) - F.length(tail)), F.lit("0:0"))).otherwise(bare)
    short = plain.contains("::")
    ends = F.split(plain, "::")
    groups = F.flatten(F.transform(F.filter(ends, lambda e: e != ""), lambda e: F.split(e, ":")))
    right = F.forall(groups, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$")) & F.when(short, (F.size(ends) == 2) & (F.size(groups) <= 7)).otherwise(F.size(groups) == 8)
    return is_ipv4(text) | F.coalesce(plain.contains(":") & right, F.lit(False))


def xml_escaped(text: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def sane_duration(text: Column) -> Column:
    """A non-negative finite number, else null."""
    number = text.try_cast("double")
    return F.when((number >= 0) & (number < float("inf")), number)


def fingerprint(*parts: Column) -> Column:
    """Parts joined by | with nulls as empty fields."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def two_eyes(width: Column, height: Column) -> Column:
    """Whether a frame holds two fisheye images side by side."""
    return width >= 2 * height


def statistics_window(start: Column, end: Column, now: float) -> Column:
    """struct<start, end, error> of ISO 8601 texts, in seconds; by default the last three days.

    A time without a zone is of the session's. error tells why a window is refused.
    """
    blank = lambda t: t.isNull() | (t == "")
    seconds = lambda t: F.unix_micros(F.try_to_timestamp(F.regexp_replace(t, "Z$", "+00:00"))) / 1e6
    until = F.when(blank(end), F.lit(float(now))).otherwise(seconds(end))
    since = F.when(blank(start), until - 3 * 86400).otherwise(seconds(start))
    error = F.when(until.isNull() | since.isNull(), "format").when(until <= since, "order").when(until - since > 90 * 86400, "length")
    return F.struct(since.alias("start"), until.alias("end"), error.alias("error"))


def arguments(text: Column, most: int = 128, longest: int = 4096) -> Column:
    """A JSON array of strings, or words with single or double quotes, as an array; null if refused."""
    line = F.trim(text)
    words = F.transform(
        F.regexp_extract_all(line, F.lit(r"""(\"[^\"]*\"|'[^']*'|[^\s\"']+)"""), F.lit(1)),
        lambda w: F.when(w.rlike("^[\"']"), F.substring(w, 2, F.length(w) - 2)).otherwise(w),
    )
    found = F.when(line.startswith("["), F.from_json(line, "array<string>")).otherwise(words)
    return F.when((F.size(found) <= most) & F.forall(found, lambda x: x.isNotNull() & (F.length(x) <= longest)), found)


def host_slot(text: Column, most: int = 16) -> Column:
    """struct<ip, slots> of ``ip=slots``; null unless both are valid."""
    ip, number = F.regexp_extract(text, "^([^=]*)=", 1), F.regexp_extract(text, "=([0-9]+)$", 1).try_cast("int")
    return F.when(is_ip(ip) & number.between(1, most), F.struct(ip.alias("ip"), number.alias("slots")))


def display_hours(seconds: Column) -> Column:
    return F.format_string("%.1f h", F.coalesce(seconds, F.lit(0.0)) / 3600)


def display_worker_hours(value: Column) -> Column:
    """Worker time of an hour of video: minutes below an hour, else hours; a dash for none."""
    minutes = F.format_string("%.0f min", value * 60)
    return F.when(value.isNull() | F.isnan(value), "\u2013").when(value < 1, minutes).otherwise(F.format_string("%.2f h", value))


def frame_number(path: Column) -> Column:
    """The number at the end of a frame file's stem."""
    return F.regexp_extract(basename(path), r"(\d+)\.[^.]*$", 1).try_cast("long")


def column_letters(number: Column) -> Column:
    """Spreadsheet column name of a 1-based number of at most seven letters."""
    start = F.struct(number.cast("long").alias("rest"), F.lit("").alias("name"))

    def step(state: Column, _: Column) -> Column:
        last = F.when(state["rest"] > 0, F.char(65 + (state["rest"] - 1) % 26)).otherwise("")
        return F.struct(F.when(state["rest"] > 0, F.floor((state["rest"] - 1) / 26)).otherwise(0).cast("long").alias("rest"), F.concat(last, state["name"]).alias("name"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, step, lambda state: state["name"])


def column_name(number: int) -> str:
    """Spreadsheet column name of a 1-based number."""
    name = ""
    while number:
        number, rest = divmod(number - 1, 26)
        name = chr(65 + rest) + name
    return name


def event_line(at: Column, event: Column, host: Column, **details: Column) -> Column:
    """A line of an event log: UTC time, event, host, then details as name=JSON by name.

    at: seconds since 1970. A null detail is ``null``.
    """
    # Without a zone, so that the session's zone plays no part.
    moment = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(secs=at.cast("decimal(18,6)"))
    micros = F.date_format(moment, ".SSSSSS")
    time = F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != ".000000", micros).otherwise(""), F.lit("+00:00"))
    bare = lambda c: F.regexp_extract(F.to_json(F.array(c), {"ignoreNullFields": "false"}), r"(?s)^\[(.*)\]$", 1)
    fields = [F.concat(F.lit(f"{name}="), bare(c)) for name, c in sorted(details.items())]
    return F.concat_ws(" ", time, F.concat(F.lit("event="), event), F.concat(F.lit("ip="), host), *fields)
