"""Registered queries over single rules: frames, scores, parsers, listings and defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenveil.functions import boxes, decoding, scalars
from lumenveil.operators import audit, fusion, masking, planner, reports, timeline
from lumenveil.plans.fixtures import view
from lumenveil.plans.operations import _IOU
from lumenveil.plans.queries import _OUTPUT_KEY, _REST, NOW, _by_model, r6, rounded
from lumenveil.plans.registry import query
from lumenveil.session import table
from lumenveil.sources import discovery

# -- frames -----------------------------------------------------------------

_WIDTH, _HEIGHT = 16, 12
#: Value of channel c at (y, x) of frame n; every fifth frame is almost flat.
_PIXEL = "(100 + (x * 13 + y * 29 + c * 31 + n * 7 + x * y) % (CASE WHEN n % 5 = 0 THEN 9 ELSE 120 END))"
_PIXELS = f", px AS (SELECT n_nationkey AS n, y, x, c, {_PIXEL} AS v FROM (SELECT n_nationkey, n_nationkey AS n FROM nation) k, range({_HEIGHT}) a(y), range({_WIDTH}) b(x), range(3) d(c))"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small seeded frames, one for each nation."""
    places = f"sequence(0, {_HEIGHT * _WIDTH * 3 - 1})"
    value = _PIXEL.replace("x * y", "X * Y").replace("x * 13", "X * 13").replace("y * 29", "Y * 29").replace("c * 31", "C * 31").replace("X", f"(int(i / 3) % {_WIDTH})").replace("Y", f"int(i / {3 * _WIDTH})").replace("C * 31", "(i % 3) * 31")
    pixels = f"unhex(array_join(transform({places}, i -> lpad(hex(bigint({value})), 2, '0')), ''))"
    rows = table(spark, sf_dir, "nation").selectExpr("n_nationkey as video_id", "n_nationkey as n")
    return rows.selectExpr("video_id", "bigint(0) as frame_idx", f"{_WIDTH} as width", f"{_HEIGHT} as height", f"{pixels} as pixels")


@query(f"""
{_PIXELS}, s AS (SELECT n, stddev_pop(v) FILTER (c = 0) AS std_b, stddev_pop(v) FILTER (c = 1) AS std_g, stddev_pop(v) FILTER (c = 2) AS std_r FROM px GROUP BY n),
g AS (SELECT n, y, x, sum(v * CASE c WHEN 0 THEN 0.114 WHEN 1 THEN 0.587 ELSE 0.299 END) AS grey FROM px WHERE y >= {int(_HEIGHT * 0.15)} AND y < {int(_HEIGHT * 0.85)} AND x >= {int(_WIDTH * 0.15)} AND x < {int(_WIDTH * 0.85)} GROUP BY n, y, x)
SELECT n AS video_id, round(std_b, 6) AS std_b, round(std_g, 6) AS std_g, round(std_r, 6) AS std_r, std_b < 10 AND std_g < 10 AND std_r < 10 AS corrupt, round(texture, 6) AS texture FROM s JOIN (SELECT n, stddev_pop(CAST(grey AS DOUBLE)) AS texture FROM g GROUP BY n) USING (n)
""")
def frame_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(masking.measured(_frames(spark, sf_dir)).drop("frame_idx"), "std_b", "std_g", "std_r", "texture")


#: The face box of frame n: x1, y1, x2, y2, and what is left of it when expanded and clipped.
_FACE = ("1 + n % 5", "1 + n % 3", "11 + n % 5", "9 + n % 3")
_CELL = "list_filter(range({0} + 1), lambda i: i * ({2} - {1}) // {0} <= {3} - {1})[-1]"


@query(f"""
{_PIXELS}, f AS (SELECT *, greatest(0, 1 + n % 5 - 1) AS x1, greatest(0, 1 + n % 3) AS y1, least({_WIDTH}, 11 + n % 5 + 1) AS x2, least({_HEIGHT}, 9 + n % 3) AS y2 FROM px),
m AS (SELECT *, x >= x1 AND x < x2 AND y >= y1 AND y < y2 AS inside, least(8, x2 - x1) AS nx, least(8, y2 - y1) AS ny FROM f),
t AS (SELECT n, y, x, c, v, inside, CASE WHEN inside THEN len(list_filter(range(1, nx + 1), lambda i: i * (x2 - x1) // nx <= x - x1)) END AS tx, CASE WHEN inside THEN len(list_filter(range(1, ny + 1), lambda i: i * (y2 - y1) // ny <= y - y1)) END AS ty FROM m)
SELECT n AS video_id, CAST((y * {_WIDTH} + x) * 3 + c AS INTEGER) AS place, CAST(CASE WHEN inside THEN round_even(avg(v) OVER (PARTITION BY n, c, tx, ty, inside), 0) ELSE v END AS INTEGER) AS value FROM t
""")
def masked_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir)
    faces = table(spark, sf_dir, "nation").selectExpr("n_nationkey as video_id", "bigint(0) as frame_idx", *(f"{x.replace('n %', 'n_nationkey %')} as {c}" for x, c in zip(_FACE, boxes.SIDES)))
    pixels = masking.masked(frames, faces).select("video_id", F.hex("pixels").alias("pixels"))
    return pixels.select("video_id", F.posexplode(F.expr("transform(sequence(1, length(pixels), 2), i -> int(conv(substring(pixels, i, 2), 16, 10)))")).alias("place", "value"))


@query("SELECT video_id, CAST(greatest(round_even(width / 32, 0) * 32, 32) AS INTEGER) AS input_width, width >= 2 * height AS two_eyes FROM video_info")
def input_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "video_info").select("video_id", scalars.multiple_of_32(F.col("width")).alias("input_width"), scalars.two_eyes(F.col("width"), F.col("height")).alias("two_eyes"))


@query("SELECT video_id, frame_idx, det_id, CAST(trunc(x1 / 0.6) AS INTEGER) AS x1, CAST(trunc(y1 / 0.6) AS INTEGER) AS y1, CAST(trunc(x2 / 0.6) AS INTEGER) AS x2, CAST(trunc(y2 / 0.6) AS INTEGER) AS y2 FROM detections")
def rescaled_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = zip(boxes.SIDES, decoding.rescaled(boxes.box(), F.lit(0.6)))
    return view(spark, sf_dir, "detections").select("video_id", "frame_idx", "det_id", *(c.alias(n) for n, c in sides))


@query("""
, b AS (SELECT video_id, frame_idx, det_id, greatest(x1, 0) AS x1, greatest(y1, 0) AS y1, least(x2, 1000) AS x2, least(y2, 500) AS y2 FROM detections),
g AS (SELECT *, unnest(range(9)) AS k FROM b WHERE x2 - x1 >= 12 AND y2 - y1 >= 12)
SELECT video_id, frame_idx, det_id, CAST(k AS INTEGER) AS nth, round(x1 + (x2 - x1) * (0.12 + 0.76 * (k % 3) / 2), 6) AS x, round(y1 + (y2 - y1) * (0.12 + 0.76 * (k // 3) / 2), 6) AS y FROM g
""")
def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = boxes.grid_points(boxes.box(), F.lit(1000.0), F.lit(500.0))
    placed = view(spark, sf_dir, "detections").select("video_id", "frame_idx", "det_id", F.posexplode(points).alias("nth", "at"))
    return placed.select("video_id", "frame_idx", "det_id", "nth", r6(F.col("at.x")).alias("x"), r6(F.col("at.y")).alias("y"))


@query("""
, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS r FROM patches WHERE len(embedding) > 0), m AS (SELECT *, list_sum(r) / len(r) AS mean FROM v)
SELECT vec_id, round((list_max(r) - mean) / (sqrt(list_sum(list_transform(r, lambda x: (x - mean) * (x - mean))) / len(r)) + 1e-6), 5) AS psr FROM m
""")
def template_psr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "patches").filter("size(embedding) > 0").select("vec_id", F.round(boxes.peak_to_sidelobe(F.col("embedding")), 5).alias("psr"))


# -- scores and matching ----------------------------------------------------


@query("SELECT video_id, frame_idx, det_id FROM detections WHERE det_id % 6 = 0 OR score >= 0.5")
def passing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("det_id") % 6 != 0, F.col("score"))
    return view(spark, sf_dir, "detections").filter(boxes.passes(score, 0.5)).select("video_id", "frame_idx", "det_id")


@query("SELECT video_id, frame_idx, det_id FROM detections WHERE det_id % 4 + 14 IN (15, 16, 14)")
def class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "detections").withColumn("class_id", F.col("det_id") % 4 + 14)
    return fusion.of_classes(rows, (15, 16, 14)).select("video_id", "frame_idx", "det_id")


@query("""
, s AS (SELECT video_id, frame_idx, det_id, CASE WHEN det_id % 5 <> 0 THEN score END AS a, CASE WHEN det_id % 3 <> 0 THEN score - det_id % 4 * 0.012 END AS b, CASE WHEN det_id % 7 <> 0 THEN score - 0.015 - det_id % 2 * 0.01 END AS v FROM detections)
SELECT video_id, frame_idx, det_id, a IS NULL OR b IS NULL OR b + 1e-6 >= a - 0.02 AS dual, v IS NULL OR coalesce(b, a) IS NULL OR v + 1e-6 >= coalesce(b, a) - 0.02 AS verified, coalesce(a > 0 AND b > 0, false) AS required FROM s
""")
def primary_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, score = F.col("det_id"), F.col("score")
    a, b, v = F.when(d % 5 != 0, score), F.when(d % 3 != 0, score - d % 4 * 0.012), F.when(d % 7 != 0, score - 0.015 - d % 2 * 0.01)
    return view(spark, sf_dir, "detections").select(
        "video_id", "frame_idx", "det_id", fusion.dual_scores_consistent(a, b, first_model="yolov8n", second_model="scrfd-10g").alias("dual"),
        fusion.verifier_consistent(a, b, v, first_model="yolov8n", second_model="scrfd-2.5g").alias("verified"), fusion.has_required_scores(a, b, second_model="scrfd-2.5g").alias("required"),
    )


@query("""
, n AS (SELECT *, (x1 + x2) / 2 / 1500 AS cx, (y1 + y2) / 2 / 900 AS cy, greatest(x2 - x1, y2 - y1) AS side FROM jittered)
SELECT a.video_id, a.frame_idx, round(median(a.cx - b.cx), 6) AS disparity, count(*) AS pairs FROM n a JOIN n b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.model = 'A' AND b.model = 'B'
WHERE abs(a.cx - b.cx) <= 0.16 AND abs(a.cy - b.cy) <= 0.08 AND a.side / greatest(b.side, 1) BETWEEN 0.45 AND 2.2 GROUP BY ALL
""")
def stereo_disparity(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = fusion.stereo_cost(boxes.box("l_"), boxes.box("r_"), F.lit(1500), F.lit(900))
    pairs = fusion.pairs_in_frame(*_by_model(spark, sf_dir), cost.isNotNull())
    centre = lambda side: (F.col(f"{side}_x1") + F.col(f"{side}_x2")) / 2 / 1500
    placed = pairs.select(F.col("l_video_id").alias("video_id"), F.col("l_frame_idx").alias("frame_idx"), centre("l").alias("left_x"), centre("r").alias("right_x"))
    return rounded(fusion.stereo_disparity(placed), "disparity")


_WALK = "SELECT l_orderkey % 40 AS video_id, l_orderkey // 40 AS frame_idx, CAST(l_linenumber AS INTEGER) AS det_id, CAST(l_linenumber % 3 * 50 + l_partkey % 20 AS DOUBLE) AS x1, CAST(l_suppkey % 15 AS DOUBLE) AS y1, CAST(l_linenumber % 3 * 50 + l_partkey % 20 + 60 AS DOUBLE) AS x2, CAST(l_suppkey % 15 + 50 AS DOUBLE) AS y2 FROM lineitem"


@query(f"""
, w AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY det_id, x1, y1, x2, y2) AS j FROM ({_WALK})), a AS (SELECT *, frame_idx + 1 AS frame, j AS k FROM w), b AS (SELECT * FROM w),
v AS (SELECT a.video_id, a.frame, a.k, b.j, b.det_id, {_IOU} AS iou FROM a JOIN b ON a.video_id = b.video_id AND a.frame = b.frame_idx),
c AS (SELECT video_id, frame, k, list(j ORDER BY iou DESC, j) FILTER (iou > 0.3) AS wants FROM v GROUP BY ALL),
step AS (SELECT video_id, frame, k, wants[1] AS pick, coalesce(wants[1:1], []) AS used FROM c WHERE k = 1 UNION ALL
 SELECT c.video_id, c.frame, c.k, list_filter(c.wants, lambda x: NOT list_contains(s.used, x))[1], list_concat(s.used, coalesce(list_filter(c.wants, lambda x: NOT list_contains(s.used, x))[1:1], []))
 FROM step s JOIN c ON s.video_id = c.video_id AND s.frame = c.frame AND c.k = s.k + 1)
SELECT s.video_id, s.frame AS frame_idx, a.det_id AS old_id, v.det_id AS new_id, round(v.iou, 6) AS iou FROM step s JOIN a ON s.video_id = a.video_id AND s.frame = a.frame AND s.k = a.k JOIN v ON s.video_id = v.video_id AND s.frame = v.frame AND s.k = v.k AND v.j = s.pick
""", recursive=True)
def adjacent_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    walk = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey % 40 as video_id", "l_orderkey div 40 as frame_idx", "int(l_linenumber) as det_id", "double(l_linenumber % 3 * 50 + l_partkey % 20) as x1", "double(l_suppkey % 15) as y1",
        "double(l_linenumber % 3 * 50 + l_partkey % 20 + 60) as x2", "double(l_suppkey % 15 + 50) as y2",
    )
    return rounded(fusion.adjacent_matches(walk), "iou")


# -- parsers and formats ----------------------------------------------------

_DAY = "strftime(TIMESTAMP '2024-01-01' + to_days(CAST(event_id % 120 AS INTEGER)), '%Y-%m-%d')"
_STARTS = f"CASE event_id % 4 WHEN 0 THEN {_DAY} || 'T06:30:00Z' WHEN 1 THEN {_DAY} || 'T06:30:00+02:00' WHEN 2 THEN 'yesterday' END"


@query(f"""
, w AS (SELECT event_id, event_id % 4 AS k, epoch(TIMESTAMP '2024-01-01' + to_days(CAST(event_id % 120 AS INTEGER))) + 23400 AS s, CASE WHEN event_id % 3 = 0 THEN 1711935000.0 ELSE {NOW} END AS e FROM events),
t AS (SELECT event_id, k, e, CASE k WHEN 0 THEN s WHEN 1 THEN s - 7200 WHEN 3 THEN e - 259200 END AS s FROM w)
SELECT event_id, CAST(s AS DOUBLE) AS start, CAST(e AS DOUBLE) AS "end", CASE WHEN s IS NULL THEN 'format' WHEN e <= s THEN 'order' WHEN e - s > 7776000 THEN 'length' END AS error FROM t
""")
def statistics_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("event_id") % 120).cast("int")), "yyyy-MM-dd")
    k = F.col("event_id") % 4
    start = F.when(k == 0, F.concat(day, F.lit("T06:30:00Z"))).when(k == 1, F.concat(day, F.lit("T06:30:00+02:00"))).when(k == 2, "yesterday")
    end = F.when(F.col("event_id") % 3 == 0, "2024-04-01T01:30:00Z").otherwise("")
    return table(spark, sf_dir, "events").select("event_id", scalars.statistics_window(start, end, NOW).alias("w")).select("event_id", "w.start", "w.end", "w.error")


@query("""
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '--k|' || p_size || '|two words' WHEN 1 THEN 'a|b ' || p_size WHEN 2 THEN '-x|single quotes|y' END AS words FROM part
""")
def argument_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(F.lit("--k "), n, F.lit(' "two words" '))).when(k == 1, F.concat(F.lit('["a", "b '), n, F.lit('"]'))).when(k == 2, " -x 'single quotes'   y").otherwise(F.lit('["a", null]'))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(scalars.arguments(text), "|").alias("words"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 300 < 256 AND s_suppkey % 19 BETWEEN 1 AND 16 AND s_suppkey % 7 <> 0 THEN '10.0.0.' || s_suppkey % 300 END AS ip, CASE WHEN s_suppkey % 300 < 256 AND s_suppkey % 19 BETWEEN 1 AND 16 AND s_suppkey % 7 <> 0 THEN CAST(s_suppkey % 19 AS INTEGER) END AS slots FROM supplier")
def host_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.concat(F.lit("10.0.0."), (k % 300).cast("string"), F.when(k % 7 == 0, "").otherwise("="), (k % 19).cast("string"))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), scalars.host_slot(text).alias("slot")).select("id", "slot.ip", "slot.slots")


@query("""
, e AS (SELECT p_size AS pool, p_partkey AS place, concat('10.0.', p_partkey % 3, '.', p_partkey % 260 // 20, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE '=' END, p_partkey % 18) AS entry, concat('10.0.', p_partkey % 3, '.', p_partkey % 260 // 20) AS ip, p_partkey % 11 = 0 AS broken, p_partkey % 18 AS slots FROM part),
j AS (SELECT *, CASE WHEN broken THEN 'invalid' WHEN slots NOT BETWEEN 1 AND 16 THEN 'slots' END AS problem FROM e), f AS (SELECT *, min(place) FILTER (problem IS NULL) OVER (PARTITION BY pool, ip) AS first FROM j)
SELECT pool, place, entry, CASE WHEN broken THEN '' ELSE ip END AS ip, CASE WHEN NOT broken THEN CAST(slots AS INTEGER) END AS slots, CASE WHEN problem IS NULL AND place > first THEN 'duplicate' ELSE problem END AS problem FROM f
""")
def host_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    entry = F.concat(F.lit("10.0."), (n % 3).cast("string"), F.lit("."), F.floor(n % 260 / 20).cast("string"), F.when(n % 11 == 0, "").otherwise("="), (n % 18).cast("string"))
    return planner.configured(table(spark, sf_dir, "part").select(F.col("p_size").alias("pool"), n.alias("place"), entry.alias("entry")))


@query("SELECT o_orderkey AS id, sha256(concat('token-', CAST(o_orderkey AS VARCHAR))) AS token_hash FROM orders")
def token_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.sha2(F.concat(F.lit("token-"), F.col("o_orderkey").cast("string")), 256).alias("token_hash"))


@query("""
SELECT p_partkey AS id, CASE WHEN n > 702 THEN chr(CAST(65 + (n - 703) // 676 % 26 AS INTEGER)) ELSE '' END || CASE WHEN n > 26 THEN chr(CAST(65 + (n - 27) // 26 % 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INTEGER)) AS letters FROM (SELECT p_partkey, p_partkey % 18278 + 1 AS n FROM part)
""")
def sheet_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), scalars.column_letters(F.col("p_partkey") % 18278 + 1).alias("letters"))


@query("""SELECT p_partkey AS id, replace(replace(replace(replace('<' || p_name || '> & "' || p_size || '"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS cell FROM part""")
def xml_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("<"), "p_name", F.lit('> & "'), F.col("p_size").cast("string"), F.lit('"'))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), scalars.xml_escaped(text).alias("cell"))


@query("""
SELECT p_partkey AS id, printf('%.1f h', CAST(p_size * 437 AS DOUBLE) / 3600) AS hours, CASE WHEN p_partkey % 5 = 0 THEN chr(8211) WHEN p_size < 25 THEN printf('%.0f min', CAST(p_size AS DOUBLE) / 25 * 60) ELSE printf('%.2f h', CAST(p_size AS DOUBLE) / 25) END AS worker_hours FROM part
""")
def display_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    value = F.when(F.col("p_partkey") % 5 != 0, size / 25)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), scalars.display_hours(size * 437).alias("hours"), scalars.display_worker_hours(value).alias("worker_hours"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderkey % 1000 AS DOUBLE) / 8 WHEN 3 THEN 0.0 END AS seconds FROM orders")
def sane_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, ((F.col("o_orderkey") % 1000).cast("double") / 8).cast("string")).when(k == 1, "-4.5").when(k == 2, "n/a").when(k == 3, "0")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), scalars.sane_duration(text).alias("seconds"))


# -- listings and defaults --------------------------------------------------


@query("SELECT o_custkey AS video_id, o_orderkey AS number, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders")
def frame_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    files = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("frames/"), F.col("o_custkey").cast("string"), F.lit("/frame_"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("path"))
    numbered = files.select(F.col("o_custkey").alias("video_id"), scalars.frame_number(F.col("path")).alias("number"))
    return numbered.withColumn("nth", F.row_number().over(Window.partitionBy("video_id").orderBy("number")).cast("long"))


@query("SELECT DISTINCT '10.0.' || n_nationkey % 4 || '.' || n_nationkey + n_nationkey % 2 * 100 AS private_ip FROM nation WHERE n_nationkey % 2 = 1")
def unlisted_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    managed = table(spark, sf_dir, "nation").selectExpr("concat('10.0.', n_nationkey % 4, '.', n_nationkey + n_nationkey % 2 * 100) as private_ip")
    return planner.unlisted(managed, view(spark, sf_dir, "hosts"))


@query("SELECT name, private_ip, status, capacity FROM hosts WHERE private_ip IN (SELECT '10.0.' || n_nationkey % 4 || '.' || n_nationkey FROM nation WHERE n_nationkey % 3 = 0)")
def allowed_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    addresses = table(spark, sf_dir, "nation").filter("n_nationkey % 3 = 0").selectExpr("concat('10.0.', n_nationkey % 4, '.', n_nationkey) as private_ip")
    return planner.allowed(view(spark, sf_dir, "hosts"), addresses)


_MEDIA = "regexp_matches(lower(key), '\\.(mp4|mov)$') AND size > 0 AND NOT starts_with(regexp_extract(key, '([^/]*)$', 1), 'masked_')"


@query(f"SELECT key, size FROM listing WHERE {_MEDIA} AND NOT starts_with(key, 'source/inbox/a')")
def media_outside_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.media(view(spark, sf_dir, "listing"), excluding="source/inbox/a").select("key", "size")


@query(f"SELECT key, {_OUTPUT_KEY} AS output_key FROM (SELECT *, {_REST} FROM listing WHERE {_MEDIA}) WHERE {_OUTPUT_KEY} NOT IN (SELECT key FROM outputs WHERE size > 1024)")
def sized_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.candidates(view(spark, sf_dir, "listing"), view(spark, sf_dir, "outputs"), least_output=1024).select("key", "output_key")


@query("SELECT task_id, n FROM tasks WHERE n % 3 <> 0")
def new_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = view(spark, sf_dir, "tasks").select("task_id", "n")
    return discovery.ingested(tasks, tasks.filter("n % 3 = 0"))


@query("SELECT id, task_id, CASE WHEN task_id = 7 THEN 'ok' ELSE review_type END AS review_type, CASE WHEN task_id = 7 THEN 0 ELSE frame_number END AS frame_number FROM reviews")
def audit_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.updated(view(spark, sf_dir, "reviews"), "task_id", 7, {"review_type": "ok", "frame_number": 0})


@query("SELECT o_orderkey AS run, o_orderkey % 100 AS processed FROM orders WHERE o_orderkey % 100 < 30 AND o_custkey % 10 > 5")
def playback_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").selectExpr("o_orderkey as run", "o_orderkey % 100 as processed", "double(o_custkey % 10) as seconds")
    return runs.filter(reports.incomplete(F.col("processed"), F.lit(100), F.col("seconds"))).select("run", "processed")


@query("""
, p AS (SELECT p_partkey AS key, CAST(p_partkey % 200 AS BIGINT) * p_size * 3000000 AS size FROM part), n AS (SELECT *, unnest(range(1, CASE WHEN size > 5368709120 THEN CAST(ceil(size / 67108864) AS BIGINT) ELSE 1 END + 1)) AS k FROM p)
SELECT key, CAST(k AS INTEGER) AS part_number, (k - 1) * CASE WHEN size > 5368709120 THEN 67108864 ELSE size END AS "offset", least(CASE WHEN size > 5368709120 THEN 67108864 ELSE size END, size - (k - 1) * CASE WHEN size > 5368709120 THEN 67108864 ELSE size END) AS length FROM n
""")
def upload_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.upload_plan(table(spark, sf_dir, "part").selectExpr("p_partkey as key", "bigint(p_partkey % 200) * p_size * 3000000 as size"))


_SCENE = "SELECT c_custkey % 25 AS video_id, CAST({} AS BIGINT) AS frame_idx, {} % 60 BETWEEN 10 AND 18 AS tracked, c_custkey % 7 = 0 AND {} % 60 > 40 AS found FROM customer"


@query(f"""
, f AS ({_SCENE.replace("{}", "(c_custkey // 25 + 1)")}), o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS k FROM f),
a AS (SELECT video_id, frame_idx, k, tracked, found, CASE WHEN tracked THEN 10 ELSE 0 END AS held FROM o WHERE k = 1 UNION ALL
 SELECT o.video_id, o.frame_idx, o.k, o.tracked, o.found, CASE WHEN o.tracked THEN 10 WHEN a.found AND ((a.frame_idx - 1) % CASE WHEN a.held > 0 THEN 2 ELSE 5 END = 0 OR a.frame_idx <= 2) THEN 10 WHEN a.tracked THEN a.held ELSE greatest(a.held - 1, 0) END FROM a JOIN o ON o.video_id = a.video_id AND o.k = a.k + 1),
s AS (SELECT *, (frame_idx - 1) % CASE WHEN held > 0 THEN 2 ELSE 5 END = 0 OR frame_idx <= 2 AS scanned FROM a)
SELECT video_id, frame_idx, held > 0 AS active, scanned, CAST(CASE WHEN scanned AND found THEN 10 WHEN tracked THEN held ELSE greatest(held - 1, 0) END AS INTEGER) AS hold FROM s
""", recursive=True)
def scene_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _SCENE.replace("{}", "(c_custkey div 25 + 1)").replace("FROM customer", "FROM {customer}")
    frames = spark.sql(sql, customer=table(spark, sf_dir, "customer"))
    return timeline.scene_scans(frames, scan=2)


@query("""
SELECT s_suppkey, strftime(make_timestamp(CAST(s_suppkey * 86413 AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00 event=start ip=10.0.0.' || s_nationkey || ' balance=' || CAST(s_suppkey * 3 AS VARCHAR) || ' name="' || s_name || '"' AS line FROM supplier
""")
def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.concat(F.lit("10.0.0."), F.col("s_nationkey"))
    line = scalars.event_line(F.col("s_suppkey") * 86413, F.lit("start"), host, name=F.col("s_name"), balance=F.col("s_suppkey") * 3)
    return table(spark, sf_dir, "supplier").select("s_suppkey", line.alias("line"))
