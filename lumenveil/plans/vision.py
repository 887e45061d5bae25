"""Registered queries over pixels, matched points, key frames and segments."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenveil.functions import boxes
from lumenveil.operators import detectors, fusion, keyframes, leases, lenses, motion, regions, segments, templates, timeline, tracking
from lumenveil.operators.masking import FRAMES
from lumenveil.plans.fixtures import view
from lumenveil.plans.operations import _IOU
from lumenveil.plans.queries import rounded
from lumenveil.plans.registry import query
from lumenveil.session import shuffle_partitions, table

# -- template search ----------------------------------------------------------

_W, _H = 32, 24
#: Grey value at (x, y) of frame f of customer c: a texture that moves by dx, dy; every
#: fourth customer's second frame is another one.
_TEXTURE = "((x + 40 - f * (c % 7 - 3)) * (x + 40 - f * (c % 7 - 3)) * 7 + (y + 40 - f * (c % 5 - 2)) * (y + 40 - f * (c % 5 - 2)) * 13 + (x + 40 - f * (c % 7 - 3)) * (y + 40 - f * (c % 5 - 2)) * (3 + c % 5) + c * 11) % 251"
_VALUE = f"(CASE WHEN f = 1 AND c % 4 = 0 THEN (x * 31 + y * 17 + x * y * c) % 251 ELSE {_TEXTURE} END)"
_BOX = (10, 7, 20, 17)
_INNER = (11, 8, 19, 16)
_N = (_INNER[2] - _INNER[0]) * (_INNER[3] - _INNER[1])


#: Frames that are made at once.
_STACK = 64


def _made(keys: DataFrame, width: int, height: int, images: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Frames of every key. images: n keys -> [n, frames of a key, height, width, 3] bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _STACK):
                some = batch.column(0).slice(at, _STACK).to_numpy(zero_copy_only=False).astype(np.int64)
                made = np.ascontiguousarray(images(some), np.uint8)
                number, size = made.shape[1], height * width * 3
                ends = pa.py_buffer(np.arange(len(some) * number + 1, dtype=np.int32) * size)
                pixels = pa.Array.from_buffers(pa.binary(), len(some) * number, [None, ends, pa.py_buffer(made)])
                sides = [pa.array(np.full(len(pixels), v, np.int32)) for v in (width, height)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, number)), pa.array(np.tile(np.arange(number), len(some))), *sides, pixels], names=["video_id", "frame_idx", "width", "height", "pixels"])

    keys = keys.repartition(shuffle_partitions(keys.sparkSession), keys.columns[0])  # keys are small, frames are not
    return keys.mapInArrow(run, FRAMES)


def _textured(keys: np.ndarray) -> np.ndarray:
    """The pixels of ``_VALUE``."""
    c, f = keys[:, None, None, None], np.arange(2)[:, None, None]
    y, x = np.mgrid[0:_H, 0:_W]
    u, v = x + 40 - f * (c % 7 - 3), y + 40 - f * (c % 5 - 2)
    value = (u * u * 7 + v * v * 13 + u * v * (3 + c % 5) + c * 11) % 251
    value = np.where((f == 1) & (c % 4 == 0), (x * 31 + y * 17 + x * y * c) % 251, value)
    return np.repeat(value.astype(np.uint8)[..., None], 3, axis=-1)


def _textures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two small frames of every customer."""
    return _made(table(spark, sf_dir, "customer").select("c_custkey"), _W, _H, _textured)


@query(f"""
, px AS (SELECT c, f, x, y, {_VALUE} AS v FROM (SELECT c_custkey AS c FROM customer) k, range(2) a(f), range({_W}) b(x), range({_H}) d(y)),
t AS (SELECT c, x - {_INNER[0]} AS tx, y - {_INNER[1]} AS ty, v FROM px WHERE f = 0 AND x BETWEEN {_INNER[0]} AND {_INNER[2] - 1} AND y BETWEEN {_INNER[1]} AND {_INNER[3] - 1}),
o AS (SELECT c, i.x - tx AS ox, i.y - ty AS oy, sum(t.v * i.v)::BIGINT AS st, sum(i.v)::BIGINT AS si, sum(i.v * i.v)::BIGINT AS sii, sum(t.v)::BIGINT AS s, sum(t.v * t.v)::BIGINT AS ss
 FROM t JOIN px i USING (c) WHERE i.f = 1 AND i.x - tx BETWEEN 0 AND {_W - _INNER[2] + _INNER[0]} AND i.y - ty BETWEEN 0 AND {_H - _INNER[3] + _INNER[1]} GROUP BY c, ox, oy),
r AS (SELECT c, ox, oy, ({_N} * sii - si * si)::DOUBLE * ({_N} * ss - s * s)::DOUBLE AS spread, ({_N} * st - s * si)::DOUBLE AS above FROM o),
n AS (SELECT c, ox, oy, CASE WHEN spread > 0 THEN above / sqrt(spread) ELSE 0 END AS v FROM r),
b AS (SELECT c, avg(v) AS mean, stddev_pop(v) AS std, max(v) AS peak FROM n GROUP BY c),
w AS (SELECT c, arg_max({{'x': ox, 'y': oy}}, (v, -oy, -ox)) AS spot FROM n GROUP BY c)
SELECT c AS video_id, 1::BIGINT AS frame_idx, c % 10 AS track_id, spot.x + 4.0::DOUBLE AS x, spot.y + 4.0::DOUBLE AS y, round(peak, 6) AS peak, round((peak - mean) / (std + 1e-6), 4) AS ratio,
 peak >= 0.92 AND (peak - mean) / (std + 1e-6) >= 2 AS found FROM b JOIN w USING (c)
""")
def template_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's box looked for in its next frame."""
    given = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id"), F.lit(0).cast("bigint").alias("frame_idx"), (F.col("c_custkey") % 10).alias("track_id"), *(F.lit(v).alias(s) for s, v in zip(boxes.SIDES, _BOX)))
    found = templates.search(_textures(spark, sf_dir), given)
    return rounded(found, "peak").withColumn("ratio", F.round("ratio", 4))


# -- motion of boxes ------------------------------------------------------------

#: Nine points of customer c's box and where they went: a similarity, every fourth or so
#: astray, some lost, some that do not come back.
_P = {"px": "100 + k % 3 * 20", "py": "50 + k // 3 * 20"}
_A, _B = "(1 + (c % 5 - 2) * 0.01)", "((c % 7 - 3) * 0.01)"
_STRAY = "CASE WHEN (c * 7 + k * 5) % (3 + c % 4) = 0 THEN 12 + k ELSE 0 END"
_LOST = "(c + k * 3) % (2 + c % 12) = 1"


def _points_sql(div: str) -> str:
    px, py = _P["px"], _P["py"].replace("//", div)
    whole = f"CAST({px} AS DOUBLE) AS px, CAST({py} AS DOUBLE) AS py"
    qx = f"CASE WHEN NOT {_LOST} THEN {_A} * px - {_B} * py + c % 11 - 5 + {_B} * 70 - (c % 5 - 2) * 1.2 + {_STRAY} END"
    qy = f"CASE WHEN NOT {_LOST} THEN {_B} * px + {_A} * py + c % 3 - 1 - {_B} * 120 - (c % 5 - 2) * 0.7 END"
    back = "CASE WHEN (c * 3 + k) % 11 = 0 THEN 3 ELSE 0.5 END"
    return f"SELECT *, CASE WHEN qx IS NOT NULL THEN px + {back} END AS rx, CASE WHEN qx IS NOT NULL THEN py END AS ry FROM (SELECT *, {qx} AS qx, {qy} AS qy FROM (SELECT c, k, {whole} FROM points))"


_SIDE = (95.0, 45.0, 145.0, 95.0)
_CORNERS = [(x, y) for x in _SIDE[::2] for y in _SIDE[1::2]]


@query(f"""
, points AS (SELECT c_custkey AS c, k FROM customer, range(9) a(k)), p AS ({_points_sql('//')}),
g AS (SELECT c, k, px, py, qx, qy, count(*) OVER w AS n, median(qx - px) OVER w AS dx, median(qy - py) OVER w AS dy FROM p WHERE qx IS NOT NULL AND (rx - px) * (rx - px) + (ry - py) * (ry - py) <= 4 WINDOW w AS (PARTITION BY c)),
t AS (SELECT * FROM g WHERE n >= 4 AND greatest(abs(dx), abs(dy)) <= 0.3 * 50),
f AS (SELECT a.c, a.k AS i, b.k AS j, a.px, a.py, a.qx, a.qy, ((b.qx - a.qx) * (b.px - a.px) + (b.qy - a.qy) * (b.py - a.py)) / ((b.px - a.px) * (b.px - a.px) + (b.py - a.py) * (b.py - a.py)) AS fr,
 ((b.qy - a.qy) * (b.px - a.px) - (b.qx - a.qx) * (b.py - a.py)) / ((b.px - a.px) * (b.px - a.px) + (b.py - a.py) * (b.py - a.py)) AS fi FROM t a JOIN t b ON a.c = b.c AND a.k < b.k),
v AS (SELECT f.c, i, j, t.k, sqrt(pow(fr * (t.px - f.px) - fi * (t.py - f.py) + f.qx - t.qx, 2) + pow(fi * (t.px - f.px) + fr * (t.py - f.py) + f.qy - t.qy, 2)) <= 3 AS agrees FROM f JOIN t ON f.c = t.c),
s AS (SELECT c, i, j, count(*) FILTER (WHERE agrees) AS agreeing, list(k) FILTER (WHERE agrees) AS ks FROM v GROUP BY c, i, j),
b AS (SELECT c, arg_max({{'n': agreeing, 'ks': ks}}, (agreeing, -i, -j)) AS best FROM s GROUP BY c),
m AS (SELECT t.c, avg(px) AS mpx, avg(py) AS mpy, avg(qx) AS mqx, avg(qy) AS mqy FROM t JOIN b ON t.c = b.c AND list_contains(best.ks, k) GROUP BY t.c),
l AS (SELECT t.c, any_value(m) AS m, sum((px - mpx) * (qx - mqx) + (py - mpy) * (qy - mqy)) / sum(pow(px - mpx, 2) + pow(py - mpy, 2)) AS fr, sum((px - mpx) * (qy - mqy) - (py - mpy) * (qx - mqx)) / sum(pow(px - mpx, 2) + pow(py - mpy, 2)) AS fi
 FROM t JOIN b ON t.c = b.c AND list_contains(best.ks, k) JOIN m ON m.c = t.c GROUP BY t.c),
h AS (SELECT DISTINCT c, n, dx, dy FROM t),
e AS (SELECT h.*, best.n AS agreeing, best.n >= 3 AS fits, [{', '.join(f"fr * ({x} - m.mpx) - fi * ({y} - m.mpy) + m.mqx" for x, y in _CORNERS)}] AS xs, [{', '.join(f"fi * ({x} - m.mpx) + fr * ({y} - m.mpy) + m.mqy" for x, y in _CORNERS)}] AS ys FROM h JOIN b USING (c) JOIN l USING (c))
SELECT c AS video_id, 0::BIGINT AS frame_idx, 1::BIGINT AS track_id, round(CASE WHEN fits THEN list_min(xs) ELSE {_SIDE[0]} + dx END, 4) AS x1, round(CASE WHEN fits THEN list_min(ys) ELSE {_SIDE[1]} + dy END, 4) AS y1,
 round(CASE WHEN fits THEN list_max(xs) ELSE {_SIDE[2]} + dx END, 4) AS x2, round(CASE WHEN fits THEN list_max(ys) ELSE {_SIDE[3]} + dy END, 4) AS y2, CASE WHEN fits THEN 'similarity' ELSE 'shift' END AS kind, n::INT AS points, (CASE WHEN fits THEN agreeing ELSE 0 END)::INT AS agreeing FROM e
""")
def box_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's box moved by nine matched points."""
    customers = table(spark, sf_dir, "customer")
    customers.selectExpr("c_custkey as c", "explode(sequence(0L, 8L)) as k").createOrReplaceTempView("points")
    names = [F.lit(0).cast("bigint").alias("frame_idx"), F.lit(1).cast("bigint").alias("track_id")]
    points = spark.sql(_points_sql("div")).select(F.col("c").alias("video_id"), *names, F.col("k").alias("place"), *(F.col(x).cast("double").alias(x) for x in motion.POINT))
    given = customers.select(F.col("c_custkey").alias("video_id"), *names, *(F.lit(v).alias(s) for s, v in zip(boxes.SIDES, _SIDE)))
    found = motion.moved_boxes(given, points)
    return found.select("video_id", "frame_idx", "track_id", *(F.round(s, 4).alias(s) for s in boxes.SIDES), "kind", "points", "agreeing")


# -- key frames -------------------------------------------------------------------

_FRAME = {"video_id": "event_id // 500", "frame_idx": "event_id % 500 + 1"}
#: Detections k < event_id % 3 of three frames in five, and the motion of targets 0 and 1 in most frames.
_HAS_BOX = "event_id * 7 % 5 < 3 AND event_id // 40 % 3 <> 1"
_FOUND = {"x1": "100 + event_id * 13 % 50 + k * 200", "y1": "60 + event_id * 29 % 40 + k * 10", "x2": "160 + event_id * 13 % 50 + k * 200", "y2": "130 + event_id * 29 % 40 + k * 10", "score": "(event_id * 17 + k * 31) % 97 / 100.0", "points": "event_id * 3 % 20 + 5"}
_MOVED = {"dx": "(event_id * 3 + k) % 60 * 0.75 - 22.5", "dy": "(event_id * 5 + k) % 12 * 0.75 - 4.5", "points": "(event_id * 11 + k * 3) % 27"}


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    div = lambda x: x.replace("//", "div")
    frames = table(spark, sf_dir, "events").selectExpr("event_id", *(f"{div(x)} as {n}" for n, x in _FRAME.items()))
    k = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")
    found = frames.select("*", k).filter(div(f"k < event_id % 3 AND {_HAS_BOX}")).selectExpr("video_id", "frame_idx", "'D' as kind", *(f"cast({x} as {'double' if n == 'score' else 'int'}) as {n}" for n, x in _FOUND.items()))
    moved = frames.select("*", k).filter("k < 2 AND event_id % 6 <> 0").selectExpr("video_id", "frame_idx", "'F' as kind", "k as target", *(f"cast({x} as {'int' if n == 'points' else 'double'}) as {n}" for n, x in _MOVED.items()))
    every = found.unionByName(frames.select("video_id", "frame_idx"), allowMissingColumns=True)
    return every.unionByName(moved, allowMissingColumns=True)


_DUCK_EVIDENCE = f"""
, e AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in _FRAME.items())} FROM events),
d AS (SELECT video_id, frame_idx, {', '.join(f'{x} AS {n}' for n, x in _FOUND.items())} FROM e, range(3) a(k) WHERE k < event_id % 3 AND {_HAS_BOX}),
v AS (SELECT e.video_id, e.frame_idx, [{{'t': k, 'dx': {_MOVED['dx']}, 'dy': {_MOVED['dy']}, 'points': {_MOVED['points']}}} for k in CASE WHEN event_id % 6 <> 0 THEN [0, 1] ELSE [] END] AS moved,
 coalesce((SELECT list({{'x1': x1::INT, 'y1': y1::INT, 'x2': x2::INT, 'y2': y2::INT, 'points': points::INT}} ORDER BY score DESC, x1, y1, x2, y2) FROM d WHERE d.video_id = e.video_id AND d.frame_idx = e.frame_idx), []) AS found FROM e)
"""
_MOVE = "{{'x1': trunc(b.x1 + {m}.dx)::INT, 'y1': trunc(b.y1 + {m}.dy)::INT, 'x2': trunc(b.x2 + {m}.dx)::INT, 'y2': trunc(b.y2 + {m}.dy)::INT, 'points': {p}}}"


@query(f"""
{_DUCK_EVIDENCE}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS k FROM v),
step AS (SELECT video_id, 0::BIGINT AS k, 0::BIGINT AS frame_idx, []::STRUCT(x1 INT, y1 INT, x2 INT, y2 INT, points INT)[] AS held, 0 AS misses, '' AS source FROM (SELECT DISTINCT video_id FROM v)
 UNION ALL
 SELECT video_id, k, frame_idx, CASE WHEN NOT need THEN [{{'x1': CASE WHEN moves THEN trunc(b.x1 + m.dx)::INT ELSE b.x1 END, 'y1': CASE WHEN moves THEN trunc(b.y1 + m.dy)::INT ELSE b.y1 END, 'x2': CASE WHEN moves THEN trunc(b.x2 + m.dx)::INT ELSE b.x2 END, 'y2': CASE WHEN moves THEN trunc(b.y2 + m.dy)::INT ELSE b.y2 END, 'points': b.points}} for z in places] WHEN len(found) > 0 THEN found WHEN grace THEN held ELSE [] END,
  CASE WHEN NOT need THEN misses WHEN len(found) = 0 AND grace THEN misses + 1 ELSE 0 END, CASE WHEN NOT need THEN 'TRK' WHEN len(found) = 0 AND grace THEN 'GRC' ELSE 'DET' END
 FROM (SELECT n.video_id, n.k, n.frame_idx, n.found, n.moved, s.held, s.misses, (n.frame_idx - 1) % 10 = 0 OR len(s.held) = 0 AS need, len(s.held) > 0 AND s.misses < 3 AS grace, range(len(s.held)) AS places FROM step s JOIN n ON n.video_id = s.video_id AND n.k = s.k + 1))
SELECT video_id, frame_idx, (t - 1)::INT AS target, held[t].x1 AS x1, held[t].y1 AS y1, held[t].x2 AS x2, held[t].y2 AS y2, source FROM (SELECT *, unnest(range(1, len(held) + 1)) AS t FROM step)
""".replace("b.", "held[z + 1].").replace("moves", "coalesce(list_filter(moved, lambda q: q.t = z)[1].points >= 4, false)").replace("m.dx", "list_filter(moved, lambda q: q.t = z)[1].dx").replace("m.dy", "list_filter(moved, lambda q: q.t = z)[1].dy"), recursive=True)
def keyframe_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All targets of every video followed between key frames, with the source of each box."""
    return keyframes.followed(_evidence(spark, sf_dir), keyframes.Config(interval=10, grace=3))


def _single_sql(wait: bool) -> str:
    need = "n.frame_idx >= s.due" if wait else "s.box IS NULL OR n.frame_idx % 8 = 1"
    far = "again < 15 OR abs(dx) > 0.5 * greatest(1, moved_box.x2 - moved_box.x1) OR abs(dy) > 0.5 * greatest(1, moved_box.x2 - moved_box.x1)"
    box = "{'x1': trunc(box.x1 + dx)::INT, 'y1': trunc(box.y1 + dy)::INT, 'x2': trunc(box.x2 + dx)::INT, 'y2': trunc(box.y2 + dy)::INT}"
    follows = "NOT need AND box IS NOT NULL AND points >= 8 AND again IS NOT NULL"
    return f"""
{_DUCK_EVIDENCE}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS k, moved[1].dx AS dx, moved[1].dy AS dy, moved[1].points AS again FROM v),
step AS (SELECT video_id, 0::BIGINT AS k, 0::BIGINT AS frame_idx, NULL::STRUCT(x1 INT, y1 INT, x2 INT, y2 INT) AS box, 0 AS points, 0::BIGINT AS due, '' AS source FROM (SELECT DISTINCT video_id FROM v)
 UNION ALL
 SELECT video_id, k, frame_idx, CASE WHEN need AND len(found) > 0 THEN {{'x1': found[1].x1, 'y1': found[1].y1, 'x2': found[1].x2, 'y2': found[1].y2}} WHEN need THEN {"NULL" if wait else "box"} WHEN {follows} AND again >= 8 THEN moved_box ELSE box END,
  CASE WHEN need AND len(found) > 0 THEN found[1].points WHEN {follows} THEN greatest(again, 8) ELSE points END::INT,
  CASE WHEN need THEN frame_idx + 8 WHEN {follows} AND (again < 8 OR {far}) THEN frame_idx + 1 ELSE due END,
  CASE WHEN need AND len(found) > 0 THEN 'DET' WHEN need AND {'false' if wait else 'true'} THEN 'GRC' ELSE 'TRK' END
 FROM (SELECT *, {box} AS moved_box FROM (SELECT n.video_id, n.k, n.frame_idx, n.found, n.dx, n.dy, n.again, s.box, s.points, s.due, {need} AS need FROM step s JOIN n ON n.video_id = s.video_id AND n.k = s.k + 1)))
SELECT video_id, frame_idx, 0 AS target, box.x1 AS x1, box.y1 AS y1, box.x2 AS x2, box.y2 AS y2, source FROM step WHERE k > 0 AND box IS NOT NULL
"""


@query(_single_sql(True), recursive=True)
def keyframe_single_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best box of every video; without a find it goes until the next key frame."""
    return keyframes.followed(_evidence(spark, sf_dir), keyframes.Config(interval=8, on_miss="wait"), keyframes.Single)


@query(_single_sql(False), recursive=True)
def keyframe_single_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best box of every video; without a find it stays."""
    return keyframes.followed(_evidence(spark, sf_dir), keyframes.Config(interval=8, on_miss="hold"), keyframes.Single)


# -- segments -----------------------------------------------------------------------

_LENGTH, _OVERLAP = 2000, 300


@query(f"""
, t AS (SELECT video_id, frame_idx, x1, y1, x2, y2, det_id, unnest(range(greatest((frame_idx - 1) // {_LENGTH}, 0), greatest((frame_idx - 1 + {_OVERLAP}) // {_LENGTH}, 0) + 1)) AS segment, greatest((frame_idx - 1) // {_LENGTH}, 0) AS own FROM jittered),
r AS (SELECT *, det_id + segment % 3 * 10 AS track_id FROM t),
g AS (SELECT a.video_id, b.segment, a.track_id AS i, b.track_id AS j, count(*) AS n FROM r a JOIN r b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.segment = a.own AND b.segment = a.segment + 1 WHERE {_IOU} >= 0.5 GROUP BY 1, 2, 3, 4),
h AS (SELECT video_id, segment, track_id AS j, count(*) AS had FROM r WHERE segment <> own GROUP BY 1, 2, 3),
k AS (SELECT g.*, row_number() OVER (PARTITION BY video_id, segment, i ORDER BY n DESC, j) AS ri, row_number() OVER (PARTITION BY video_id, segment, j ORDER BY n DESC, i) AS rj FROM g JOIN h USING (video_id, segment, j) WHERE n >= 0.5 * had),
l AS (SELECT video_id, segment, j, i FROM k WHERE ri = 1 AND rj = 1),
c AS (SELECT video_id, segment, j AS track_id, segment - 1 AS fs, i AS fi FROM l UNION ALL SELECT c.video_id, c.segment, c.track_id, l.segment - 1, l.i FROM c JOIN l ON l.video_id = c.video_id AND l.segment = c.fs AND l.j = c.fi),
f AS (SELECT video_id, segment, track_id, arg_min({{'s': fs, 'i': fi}}, fs) AS first FROM c GROUP BY 1, 2, 3)
SELECT r.video_id, r.frame_idx, coalesce(first.s, r.segment)::BIGINT AS track_segment, coalesce(first.i, r.track_id)::INT AS track_id, r.x1::INT AS x1, r.y1::INT AS y1, r.x2::INT AS x2, r.y2::INT AS y2 FROM r LEFT JOIN f ON r.video_id = f.video_id AND r.segment = f.segment AND r.track_id = f.track_id WHERE r.segment = r.own
""", recursive=True)
def stitched_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with other names in every segment of a video, stitched over the overlaps."""
    rows = segments.dealt(view(spark, sf_dir, "jittered"), _LENGTH, _OVERLAP).select(
        "video_id", "segment", "frame_idx", (F.col("det_id") + F.col("segment") % 3 * 10).cast("int").alias("track_id"), *(F.col(s).cast("int").alias(s) for s in boxes.SIDES),
        F.lit("track").alias("kind"), F.lit(None).cast("bigint").alias("since_frame"),
    )
    return segments.stitched(rows, _LENGTH).drop("kind", "since_frame")


@query()
def segment_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks of ``track_manager``, every video on many tasks."""
    return segments.track(fusion.dual_consensus(view(spark, sf_dir, "jittered")), length=_LENGTH, overlap=_OVERLAP, config=tracking.TrackConfig())


# -- colour regions ----------------------------------------------------------------

_CW, _CH = 28, 20
#: Channel ch (blue, green, red) of the coloured frame of supplier c: patches of five hues.
_SPOT = "((x // 4 * 7 + y // 3 * 5 + c * 3 + x * y // 16) % 6)"
_COLOURED = f"(CASE WHEN {_SPOT} = 0 THEN 20 + ch * 5 WHEN {_SPOT} = 1 THEN 230 + ch WHEN {_SPOT} = 2 THEN CASE ch WHEN 0 THEN 200 + x ELSE 30 + y END WHEN {_SPOT} = 3 THEN CASE ch WHEN 1 THEN 170 + y ELSE 40 + x END WHEN {_SPOT} = 4 THEN CASE ch WHEN 2 THEN 220 ELSE 15 + x END ELSE CASE ch WHEN 0 THEN 25 + y WHEN 1 THEN 170 + x ELSE 210 END END)"
_HUE = "CASE WHEN hi = lo THEN 0 ELSE ((60 * (CASE WHEN hi = r THEN g - b WHEN hi = g THEN b - r + 2 * (hi - lo) ELSE r - g + 4 * (hi - lo) END) + hi - lo) // (2 * (hi - lo)) % 180 + 180) % 180 END"


def _patches(keys: np.ndarray) -> np.ndarray:
    """The pixels of ``_COLOURED``."""
    c, (y, x) = keys[:, None, None], np.mgrid[0:_CH, 0:_CW]
    spot = (x // 4 * 7 + y // 3 * 5 + c * 3 + x * y // 16) % 6
    of_channel = [
        [20 + ch * 5, 230 + ch, 200 + x if ch == 0 else 30 + y, 170 + y if ch == 1 else 40 + x, 220 if ch == 2 else 15 + x, (25 + y, 170 + x, 210)[ch]] for ch in range(3)
    ]
    return np.stack([np.choose(spot, values) for values in of_channel], axis=-1).astype(np.uint8)[:, None]


def _coloured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small coloured frame of every supplier."""
    return _made(table(spark, sf_dir, "supplier").select("s_suppkey"), _CW, _CH, _patches)


_COLOURS = ("red", "blue", "yellow", "white", "black")


def _in_colour(colour: str) -> str:
    if colour == "black":
        return "hi < 60"
    if colour == "white":
        return "s < 45 AND hi > 195"
    return " OR ".join(f"(h BETWEEN {a} AND {b} AND s >= {s} AND hi >= {v})" for a, b, s, v in regions.RANGES[colour])


@query(f"""
, px AS (SELECT c, x, y, {', '.join(f"{_COLOURED.replace('ch', str(k))} AS {n}" for k, n in enumerate('bgr'))} FROM (SELECT s_suppkey AS c FROM supplier) k, range({_CW}) a(x), range({_CH}) d(y)),
m AS (SELECT *, greatest(b, g, r) AS hi, least(b, g, r) AS lo FROM px), v AS (SELECT c, x, y, hi, {_HUE} AS h, CASE WHEN hi > 0 THEN (510 * (hi - lo) + hi) // (2 * hi) ELSE 0 END AS s FROM m),
k AS ({' UNION ALL '.join(f"SELECT c, '{name}' AS colour, x, y, y * {_CW} + x AS spot FROM v WHERE {_in_colour(name)}" for name in _COLOURS)}),
l AS (SELECT a.c, a.colour, a.spot AS a, b.spot AS b FROM k a JOIN k b ON a.c = b.c AND a.colour = b.colour AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1),
flood AS (SELECT c, colour, spot, spot AS root FROM k UNION SELECT f.c, f.colour, l.b, f.root FROM flood f JOIN l ON f.c = l.c AND f.colour = l.colour AND f.spot = l.a WHERE f.root < l.b),
o AS (SELECT c, colour, spot, min(root) AS root FROM flood GROUP BY 1, 2, 3),
g AS (SELECT c, colour, root, min(spot % {_CW})::INT AS x1, min(spot // {_CW})::INT AS y1, max(spot % {_CW} + 1)::INT AS x2, max(spot // {_CW} + 1)::INT AS y2, count(*)::INT AS area FROM o GROUP BY 1, 2, 3)
SELECT c AS video_id, colour, (row_number() OVER (PARTITION BY c, colour ORDER BY root) - 1)::INT AS region, x1, y1, x2, y2, area FROM g
""", recursive=True)
def colour_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected regions of five colours in a frame of every supplier."""
    return regions.regions_of(_coloured(spark, sf_dir), _COLOURS).select("video_id", "region", "x1", "y1", "x2", "y2", "area", "colour")


# -- leases and silence ----------------------------------------------------------------

@query(f"""
, b AS (SELECT DISTINCT concat('worker-', user_id) AS worker_id, epoch_us(ts) / 1e6 AS "at" FROM events), n AS (SELECT *, coalesce(lead("at") OVER (PARTITION BY worker_id ORDER BY "at"), {1706572800}) AS after FROM b)
SELECT worker_id, "at" AS last_seen, "at" + 30000 AS offline_at FROM n WHERE after - "at" > 30000
""")
def worker_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each time a worker of the event table was silent for more than 30,000 seconds."""
    beats = table(spark, sf_dir, "events").selectExpr("concat('worker-', user_id) as worker_id", "unix_micros(cast(ts as timestamp)) / 1e6 as at")
    return leases.silences(beats, 1706572800.0, 30000.0)


@query("""
, a AS (SELECT concat('task-', user_id) AS task_id, epoch_us(ts) / 1e6 AS "at", CASE WHEN event_id % 13 > 0 THEN concat('reviewer-', event_id % 3) END AS reviewer, CASE event_id % 7 WHEN 0 THEN 'release' WHEN 1 THEN 'renew' WHEN 2 THEN 'renew' ELSE 'claim' END AS action FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY "at", reviewer NULLS FIRST, action) AS k FROM a),
step AS (SELECT task_id, 0::BIGINT AS k, 0::DOUBLE AS "at", ''::VARCHAR AS reviewer, '' AS action, false AS accepted, NULL::VARCHAR AS owner, NULL::DOUBLE AS until FROM (SELECT DISTINCT task_id FROM a)
 UNION ALL
 SELECT task_id, k, "at", reviewer, action, accepted, CASE WHEN NOT accepted THEN live WHEN action = 'release' THEN NULL ELSE reviewer END, CASE WHEN NOT accepted THEN left_until WHEN action = 'release' THEN NULL ELSE "at" + 20000 END
 FROM (SELECT *, reviewer IS NOT NULL AND CASE action WHEN 'claim' THEN live IS NULL OR live = reviewer ELSE coalesce(live = reviewer, false) END AS accepted
  FROM (SELECT n.task_id, n.k, n."at", n.reviewer, n.action, CASE WHEN s.until > n."at" THEN s.owner END AS live, CASE WHEN s.until > n."at" THEN s.until END AS left_until FROM step s JOIN n ON n.task_id = s.task_id AND n.k = s.k + 1)))
SELECT task_id, "at", reviewer, action, accepted, owner, until FROM step WHERE k > 0
""", recursive=True)
def lease_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims, renewals and releases of tasks by reviewers, each judged when it comes."""
    who, what = "case when event_id % 13 > 0 then concat('reviewer-', event_id % 3) end as reviewer", "case event_id % 7 when 0 then 'release' when 1 then 'renew' when 2 then 'renew' else 'claim' end as action"
    actions = table(spark, sf_dir, "events").selectExpr("concat('task-', user_id) as task_id", "unix_micros(cast(ts as timestamp)) / 1e6 as at", who, what)
    return leases.history(actions, 20000.0)


@query("""
, s AS (SELECT video_id, frame_idx, cx, cy, lag(frame_idx) OVER w AS f, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM visibility WHERE visible WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)),
g AS (SELECT video_id, unnest(range(f + 1, frame_idx)) AS frame_idx, f, frame_idx AS e, cx, cy, px, py FROM s WHERE frame_idx - f BETWEEN 2 AND 200),
i AS (SELECT video_id, frame_idx, px + (cx - px) * ((frame_idx - f) / (e - f)) AS x, py + (cy - py) * ((frame_idx - f) / (e - f)) AS y, px + 40 + (cx - px) * ((frame_idx - f) / (e - f)) AS u, py + 50 + (cy - py) * ((frame_idx - f) / (e - f)) AS v FROM g)
SELECT video_id, frame_idx, cx::INT AS x1, cy::INT AS y1, cx::INT + 40 AS x2, cy::INT + 50 AS y2, 'seen' AS source FROM s
UNION ALL SELECT video_id, frame_idx, round_even(x, 0)::INT, round_even(y, 0)::INT, round_even(u, 0)::INT, round_even(v, 0)::INT, 'backfill' FROM i
""")
def filled_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen boxes, and those between two that are not far apart."""
    seen = view(spark, sf_dir, "visibility").filter("visible").selectExpr("video_id", "frame_idx", "cx as x1", "cy as y1", "cx + 40 as x2", "cy + 50 as y2")
    return timeline.filled(seen, 200)


# -- lenses -------------------------------------------------------------------------

_LENS = lenses.LENSES["pico4"]
_FOCAL = max(_CW, _CH) * _LENS.focal
_CAMERA = lenses.camera(_CW, _CH, _LENS)


@query(f"""
, px AS (SELECT c, x, y, ch, {_COLOURED} AS v FROM (SELECT s_suppkey AS c FROM supplier) k, range({_CW}) a(x), range({_CH}) d(y), range(3) e(ch)),
n AS (SELECT x, y, (x - {_CAMERA[1]!r}) / {_CAMERA[0]!r} AS u, (y - {_CAMERA[2]!r}) / {_CAMERA[0]!r} AS v FROM range({_CW}) a(x), range({_CH}) d(y)), r AS (SELECT *, sqrt(u * u + v * v) AS r, atan(sqrt(u * u + v * v)) AS t FROM n),
s AS (SELECT *, CASE WHEN r > 1e-8 THEN t * (1 + {_LENS.k1} * t * t + {_LENS.k2} * t * t * t * t) / r ELSE 1 END AS s FROM r), p AS (SELECT x, y, {_FOCAL!r} * u * s + {_CW / 2} AS sx, {_FOCAL!r} * v * s + {_CH / 2} AS sy FROM s),
w AS (SELECT x, y, floor(sx)::BIGINT + i AS bx, floor(sy)::BIGINT + j AS b_y, CASE i WHEN 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END * CASE j WHEN 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END AS share FROM p, range(2) a(i), range(2) b(j))
SELECT k.c AS video_id, ((w.y * {_CW} + w.x) * 3 + e.ch)::INT AS place, round_even(round(coalesce(sum(share * px.v), 0), 9), 0)::INT AS value
 FROM w, range(3) e(ch), (SELECT s_suppkey AS c FROM supplier) k LEFT JOIN px ON px.c = k.c AND px.x = bx AND px.y = b_y AND px.ch = e.ch GROUP BY k.c, w.x, w.y, e.ch
""")
def undistorted_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coloured frame of every supplier, straightened by a lens model."""
    return _values(lenses.undistorted(_coloured(spark, sf_dir), "pico4", downscale=1))


def _values(frames: DataFrame) -> DataFrame:
    """(video_id, place, value) of every byte of the frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                some = batch.slice(at, 32)
                pixels = some.column(1).to_pylist()
                sizes = [len(p) for p in pixels]
                columns = [np.repeat(some.column(0).to_numpy(zero_copy_only=False), sizes), np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]), np.frombuffer(b"".join(pixels), np.uint8).astype(np.int32)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["video_id", "place", "value"])

    return frames.select("video_id", "pixels").mapInArrow(run, "video_id bigint, place int, value int")


# -- detectors ----------------------------------------------------------------------

_RAW = {
    "index": "l_partkey % 700", "a": "(l_discount * 10 + 0.2)", "b": "(0.4 + l_tax * 7)", "p": "(l_linenumber * 0.25 + 0.5)", "q": "(l_linenumber * 0.125 + 0.75)", "r": "(l_suppkey % 5 * 0.375 + 0.875)", "s": "(l_suppkey % 7 * 0.25 + 1.125)",
}
_HEADS = {"cells": "array(a, b, p * 0.25, q * 0.25, r * 0.5, s * 0.5)", "anchors": "array(a, p, q, r, s)", "boxes": "array(index % 500 + p, index % 300 + q, index % 500 + p + r * 60, index % 300 + q + s * 50, a * 0.6)"}
_RAW_SQL = f"SELECT l_orderkey % 50 AS video_id, l_orderkey AS frame_idx, l_linenumber AS k, 640 + l_orderkey % 4 * 320 AS width, 480 + l_orderkey % 3 * 240 AS height, {', '.join(f'{x} AS {n}' for n, x in _RAW.items())} FROM lineitem"


def _in_frame(size: int) -> str:
    fit = f"least({size}.0 / width, {size}.0 / height)"
    left, top = (f"(({size} - trunc({side} * {fit})::INT) // 2)" for side in ("width", "height"))
    back = lambda v, pad: f"trunc(({v} - {pad}) / {fit})::INT"
    return f"greatest(0, {back('bx1', left)})::DOUBLE AS x1, greatest(0, {back('by1', top)})::DOUBLE AS y1, least(width, {back('bx2', left)})::DOUBLE AS x2, least(height, {back('by2', top)})::DOUBLE AS y2"


_DECODED = {
    "cells": "(index % 20 + p * 0.25) * 16 - exp(r * 0.5) * 8 AS bx1, (index // 20 + q * 0.25) * 16 - exp(s * 0.5) * 8 AS by1, (index % 20 + p * 0.25) * 16 + exp(r * 0.5) * 8 AS bx2, (index // 20 + q * 0.25) * 16 + exp(s * 0.5) * 8 AS by2, sqrt(least(1.0, a) * least(1.0, b)) AS score",
    "anchors": "index // 2 % 20 * 32 - p * 32 AS bx1, index // 2 // 20 * 32 - q * 32 AS by1, index // 2 % 20 * 32 + r * 32 AS bx2, index // 2 // 20 * 32 + s * 32 AS by2, a AS score",
    "boxes": "index % 500 + p AS bx1, index % 300 + q AS by1, index % 500 + p + r * 60 AS bx2, index % 300 + q + s * 50 AS by2, a * 0.6 AS score",
}


@query(f"""
, raw AS ({_RAW_SQL}), {', '.join(f"d_{n} AS (SELECT video_id, frame_idx, index, width, height, {x} FROM raw)" for n, x in _DECODED.items())},
f AS ({' UNION ALL '.join(f"SELECT video_id, frame_idx, index::INT AS det_id, '{n}' AS model, {_in_frame(detectors.REGISTER[n].size)}, score FROM d_{n} WHERE score >= {detectors.REGISTER[n].least_score}" for n in _DECODED)})
SELECT video_id, frame_idx, det_id, model, x1, y1, x2, y2, round(score, 6) AS score FROM f WHERE x2 > x1 AND y2 > y1
""")
def decoded_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw heads of three detectors as boxes in their frames."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem_rows")
    doubles = lambda x: re.sub(r"\b\d+\.\d+\b", r"\g<0>D", x)  # noqa: E731  # exact in binary, where decimals cost ten times as much
    raw = spark.sql(doubles(_RAW_SQL.replace("FROM lineitem", "FROM lineitem_rows")))
    found = [detectors.decoded(raw.withColumn("values", F.expr(doubles(_HEADS[n]))), n) for n in _HEADS]
    return reduce(DataFrame.unionByName, found).withColumn("score", F.round("score", 6))
