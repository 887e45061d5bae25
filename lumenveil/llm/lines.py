"""Removal of lines that many sites share, by distinct-site spread.

Every line that is not empty when trimmed is hashed to 128 bits; per hash one
HyperLogLog sketch of the sites is built where the rows are and merged by the
aggregation. Lines whose estimate is clearly at or above the threshold are
boilerplate, clearly lower ones are not, and only lines near the threshold get
an exact count of distinct sites, so the outcome is that of exact counting.

A boilerplate line stays at its first place (least document id, then position),
so a passage that was copied to many sites is not lost from the corpus, and is
removed everywhere else.

Uses Spark expressions only. Defined cases: null text stays null; a null site
counts for nothing; a row with a null id is left as it is; rows with the same id
and text share their outcome; very long texts are split whole; of equal first
places none is another's; an empty table yields no rows; all other columns are
kept, whatever their names, and counts get underscores in front where their names
are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenveil.llm.textframe import free_name
from lumenveil.session import discard, materialize

MIN_SITES = 8
MIN_CHARS = 1
#: log2 of the sketch's registers: a relative standard error of 1.6 %.
SKETCH_BITS = 12
#: Standard errors (and one site) around the threshold that are counted exactly.
NEAR = 5
_LINE = ["line", "line2"]


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_chars: int) -> DataFrame:
    """(id, text_key, site, at, line, line2): hashes of the lines that can be removed."""
    split = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(site_col).cast("string").alias("site"), F.posexplode(F.split(text_col, "\n", -1)).alias("at", "line")
    )
    kept = split.filter(F.length(F.trim("line")) >= min_chars).withColumn("line", F.trim("line"))
    return kept.withColumns({"line": F.xxhash64("line"), "line2": F.xxhash64(F.lit(2), "line")})


def widespread(lines: DataFrame, *, min_sites: int = MIN_SITES) -> DataFrame:
    """(line, line2, keeps), a table: lines on at least ``min_sites`` sites and the place kept."""
    error = NEAR * 1.04 / (1 << SKETCH_BITS) ** 0.5
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    spread = lines.groupBy(*_LINE).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_BITS)).alias("sites"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "at"))).alias("keeps")
    )
    spread = materialize(spread.filter(F.col("sites") >= low), "line-spread")
    near = spread.filter(F.col("sites") < high).select(*_LINE, "keeps")
    counted = lines.join(near.select(*_LINE), _LINE, "left_semi").select(*_LINE, "site").distinct().groupBy(*_LINE).agg(F.count("site").alias("exact"))
    exact = near.join(counted.filter(F.col("exact") >= min_sites), _LINE).select(*_LINE, "keeps")
    found = materialize(spread.filter(F.col("sites") >= high).select(*_LINE, "keeps").unionByName(exact), "widespread")
    discard(spread)
    return found


def without_widespread(
    docs: DataFrame, *, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", counts: bool = False
) -> DataFrame:
    """The given rows with widespread lines removed from ``text_col``.

    counts: add n_lines and n_removed.
    """
    lines = _lines(docs, id_col, text_col, site_col, min_chars)
    spread = widespread(lines, min_sites=min_sites)  # a table: a hot line's rows can then be split among tasks
    placed = lines.filter("id is not null").select("id", "text_key", "at", *_LINE).join(spread, _LINE)
    gone = placed.filter("keeps.id <> id or keeps.at <> at").groupBy("id", "text_key").agg(F.collect_set("at").alias("gone"))
    gone = materialize(gone, "gone-lines")  # likewise for a row that is repeated often
    discard(spread)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"))
    joined = rows.join(gone, ["id", "text_key"], "left")
    text = F.col("row")[text_col]
    stays = F.expr("array_sort(array_except(sequence(0, size(parts) - 1), gone))")
    cut = joined.withColumn("parts", F.split(text, "\n", -1)).withColumn(
        "kept", F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(stays, lambda i: F.get("parts", i)), "\n"))
    )
    out = cut.select(F.col("row").withField(f"`{text_col}`", F.col("kept")).alias("row"), F.coalesce(F.size("parts"), F.lit(0)).alias("n"), F.coalesce(F.size("gone"), F.lit(0)).alias("m"), "text_key", "parts")
    numbers = {"n_lines": F.when(F.col("parts").isNull(), 0).otherwise(F.col("n")), "n_removed": F.greatest("m", F.lit(0))} if counts else {}
    extra = [c.cast("long").alias(free_name(n, docs.columns)) for n, c in numbers.items()]
    return out.select("row.*", *extra)


#: The same outcome in DuckDB, by exact counting alone.
ORACLE_SQL = f"""
WITH split AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents
), placed AS (
  SELECT doc_id, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS place FROM split
), spread AS (
  SELECT trim(line) AS line, min((doc_id, place)) AS keeps FROM placed
  WHERE length(trim(line)) >= {MIN_CHARS}
  GROUP BY trim(line) HAVING count(DISTINCT source) >= {MIN_SITES}
), judged AS (
  SELECT p.doc_id, p.line, p.place, s.line IS NOT NULL AND s.keeps <> (p.doc_id, p.place) AS gone
  FROM placed p LEFT JOIN spread s ON trim(p.line) = s.line
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_md5
FROM judged GROUP BY doc_id
"""
