"""Fusion of boxes from several detectors, per video and frame.

What a join can say stays a join on (video, frame) with a residual condition;
greedy one-to-one matching, suppression and leader clustering depend on the
order of rows and run over the sorted boxes of a frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenveil.functions import boxes
from lumenveil.operators.runs import Row, over_groups

FRAME = ["video_id", "frame_idx"]
SIDES = list(boxes.SIDES)
#: A total order of a frame's boxes, also where det_id repeats.
ORDER = ["det_id", *SIDES, "score"]
# Thresholds of the fusion rules.
CONSENSUS_IOU = 0.3
CLUSTER_IOU = 0.30
REJECT_COOLDOWN = 5
SCORE_DROP, SCORE_EPSILON = 0.02, 1e-6
VERIFY_MARGIN, VERIFY_RISK = 0.15, 0.35
STEREO_X, STEREO_X_CALIBRATED, STEREO_Y, STEREO_RATIO = 0.16, 0.10, 0.08, (0.45, 2.20)


def _iou(a: Row, b: Row, extra: float = 0.0) -> float:
    w = min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]) + extra
    h = min(a["y2"], b["y2"]) - max(a["y1"], b["y1"]) + extra
    both = max(0.0, w) * max(0.0, h)
    size = lambda r: (r["x2"] - r["x1"] + extra) * (r["y2"] - r["y1"] + extra)
    union = size(a) + size(b) - both
    return both / union if union > 0 else 0.0


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def nms(detections: DataFrame, threshold: float = 0.4, *, inclusive: bool = True, keys: tuple[str, ...] = (*FRAME, "model")) -> DataFrame:
    """The boxes that no better kept box of their frame and model overlaps.

    A box goes when its overlap is above the threshold; ``inclusive`` counts the
    last pixel as part of a box. Ties of score go to the smaller det_id.
    """

    def step(rows: list[Row]) -> list[Row]:
        kept: list[Row] = []
        for row in rows:
            if all(_iou(row, k, float(inclusive)) <= threshold for k in kept):
                kept.append(row)
        return kept

    return over_groups(detections, list(keys), [F.desc_nulls_last("score"), "det_id", *SIDES], step, detections.schema)


def greedy_pairs(left: list[Row], right: list[Row], value, least: float) -> list[tuple[int, int, float]]:
    """Each left row in order takes the best unused right row from ``least`` on."""
    used, pairs = set(), []
    for i, a in enumerate(left):
        best, at = -1.0, -1
        for j, b in enumerate(right):
            if j not in used and (score := value(a, b)) > best:
                best, at = score, j
        if at >= 0 and best >= least:
            used.add(at)
            pairs.append((i, at, best))
    return pairs


def dual_consensus(detections: DataFrame, threshold: float = CONSENSUS_IOU, *, models: tuple[str, str] = ("A", "B")) -> DataFrame:
    """Boxes that both models see, and those of one model alone.

    Returns video_id, frame_idx, box (the first model's), score_a, score_b, iou,
    mean_score and source: ``D`` for a pair, ``S`` for a single box.
    """
    first, second = models

    def step(rows: list[Row]) -> list[Row]:
        a, b = ([r for r in rows if r["model"] == m] for m in (first, second))
        pairs = greedy_pairs(a, b, _iou, threshold)
        place = lambda r: {k: r[k] for k in (*FRAME, *SIDES)}
        mean = lambda x, y: None if x is None or y is None else (x + y) / 2
        out = [place(a[i]) | {"det_a": a[i]["det_id"], "det_b": b[j]["det_id"], "score_a": a[i]["score"], "score_b": b[j]["score"], "iou": v, "mean_score": mean(a[i]["score"], b[j]["score"]), "source": "D"} for i, j, v in pairs]
        single = lambda r, mine, other: place(r) | {f"det_{mine}": r["det_id"], f"det_{other}": None, f"score_{mine}": r["score"], f"score_{other}": None, "iou": None, "mean_score": r["score"], "source": "S"}
        out += [single(r, "a", "b") for i, r in enumerate(a) if i not in {p[0] for p in pairs}]
        return out + [single(r, "b", "a") for j, r in enumerate(b) if j not in {p[1] for p in pairs}]

    schema = _fields(detections, [*FRAME, *SIDES]) + ", det_a int, det_b int, score_a double, score_b double, iou double, mean_score double, source string"
    return over_groups(detections, FRAME, ORDER, step, schema)


def leader_clusters(detections: DataFrame, threshold: float = CLUSTER_IOU, *, least_score: float = 0.30) -> DataFrame:
    """One pass over a frame's boxes: each joins the first cluster it overlaps.

    A cluster is led by its best box and keeps the best score of every model.
    """

    def step(rows: list[Row]) -> list[Row]:
        clusters: list[dict] = []
        for row in rows:
            if row["score"] is None or row["score"] < least_score:
                continue
            own = next((c for c in clusters if _iou(row, c["lead"]) >= threshold), None)
            if own is None:
                clusters.append(own := {"lead": row, "scores": {}, "n": 0})
            if row["score"] > own["lead"]["score"]:
                own["lead"] = row
            own["scores"][row["model"]] = max(row["score"], own["scores"].get(row["model"], 0.0))
            own["n"] += 1
        return [{k: c["lead"][k] for k in (*FRAME, *SIDES, "det_id", "score")} | {"members": c["n"], "scores": c["scores"], "source": "C"} for c in clusters]

    schema = _fields(detections, [*FRAME, *SIDES, "det_id", "score"]) + ", members int, scores map<string, double>, source string"
    return over_groups(detections, FRAME, ORDER, step, schema)


def pairs_in_frame(left: DataFrame, right: DataFrame, condition: Column, kind: str = "inner") -> DataFrame:
    """Boxes of a frame that meet ``condition`` (columns with prefix l_ and r_)."""
    renamed = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns))
    same = (F.col("l_video_id") == F.col("r_video_id")) & (F.col("l_frame_idx") == F.col("r_frame_idx"))
    return renamed(left, "l").join(renamed(right, "r"), same & condition, kind)


def iou_of_pair() -> Column:
    return boxes.iou(boxes.box("l_"), boxes.box("r_"))


def overlapping(left: DataFrame, right: DataFrame, threshold: float, *, keep: bool = True) -> DataFrame:
    """Rows of ``left`` that (do not) overlap any box of ``right`` in their frame."""
    found = pairs_in_frame(left, right, iou_of_pair() >= threshold, "left_semi" if keep else "left_anti")
    return found.select(*(F.col(f"l_{c}").alias(c) for c in left.columns))


def outside_cooldown(candidates: DataFrame, rejected: DataFrame, threshold: float, cooldown: int = REJECT_COOLDOWN) -> DataFrame:
    """Candidates off every place that was rejected in the last ``cooldown`` frames.

    rejected: video_id, eye, frame_idx, box. An anti join on video, eye and blocks
    of frames: a candidate meets the rejections of its block and the one before.
    """
    block = lambda c: F.floor(c / (cooldown + 1))
    b = rejected.select("video_id", "eye", "frame_idx", *SIDES)
    b = b.withColumn("block", F.explode(F.array(block(F.col("frame_idx")), block(F.col("frame_idx")) + 1))).alias("r")
    a = candidates.withColumn("_block", block(F.col("frame_idx"))).alias("c")
    near = boxes.iou(tuple(F.col(f"c.{s}") for s in SIDES), tuple(F.col(f"r.{s}") for s in SIDES)) >= threshold
    same = (F.col("c.video_id") == F.col("r.video_id")) & F.col("c.eye").eqNullSafe(F.col("r.eye")) & (F.col("c._block") == F.col("r.block"))
    lasts = F.col("c.frame_idx").between(F.col("r.frame_idx"), F.col("r.frame_idx") + cooldown)
    return a.join(b, same & lasts & near, "left_anti").drop("_block")


def verified(candidates: DataFrame, verifier: DataFrame, *, keep_score: float = 0.45, threshold: float = 0.25) -> DataFrame:
    """Candidates with a good score, and others that the verifier overlaps."""
    sure = candidates.filter(F.col("score") >= keep_score)
    rest = candidates.filter(~F.coalesce(F.col("score") >= keep_score, F.lit(False)))
    return sure.unionByName(overlapping(rest, verifier, threshold))


def verified_by_size(candidates: DataFrame, verifier: DataFrame, *, width: int, height: int, share: float = 0.05, threshold: float = 0.25) -> DataFrame:
    """Small boxes as they are; larger ones only where the verifier overlaps."""
    small = boxes.area(boxes.box()) < share * width * height
    return candidates.filter(small).unionByName(overlapping(candidates.filter(~small), verifier, threshold))


def scores_consistent(reference: Column, other: Column) -> Column:
    """Whether the second score is at most SCORE_DROP below the first; nulls pass."""
    return reference.isNull() | other.isNull() | (other + SCORE_EPSILON >= reference - SCORE_DROP)


def needs_verification(least_score: Column, risk: Column, threshold: float) -> Column:
    return (least_score < threshold + VERIFY_MARGIN) | (risk >= VERIFY_RISK)


def dual_scores_consistent(first: Column, second: Column, *, first_model: str, second_model: str) -> Column:
    """The rule for a pair of the fast primary detector and the large second one; others pass."""
    if not (first_model.startswith("yolov8") and "scrfd-10g" in second_model):
        return F.lit(True)
    return scores_consistent(first, second)


def verifier_consistent(first: Column, second: Column, verifier: Column, *, first_model: str, second_model: str) -> Column:
    """Whether the verifier's score is near that of the detector it answers for."""
    reference = second if "scrfd-2.5g" in second_model else F.lit(None).cast("double")
    if first_model.startswith("yolov8"):
        reference = F.coalesce(reference, F.when(second.isNull(), first))
    return scores_consistent(reference, verifier)


def has_required_scores(first: Column, second: Column, *, second_model: str) -> Column:
    """A new track needs positive scores of both detectors where the small second one is used."""
    if "scrfd-2.5g" not in second_model:
        return F.lit(True)
    return F.coalesce((first > 0) & (second > 0), F.lit(False))


def of_classes(detections: DataFrame, classes: tuple[int, ...], column: str = "class_id") -> DataFrame:
    """Detections of some classes of a detector."""
    return detections.filter(F.col(column).isin(*classes))


def adjacent_matches(detections: DataFrame, threshold: float = CONSENSUS_IOU) -> DataFrame:
    """(video_id, frame_idx, old_id, new_id, iou): boxes matched to those of the frame before.

    Each old box in order takes the best unused new one above the threshold.
    """
    rows = detections.select(*FRAME, "det_id", *SIDES)
    both = rows.withColumn("old", F.lit(False)).unionByName(rows.withColumn("frame_idx", F.col("frame_idx") + 1).withColumn("old", F.lit(True)))

    def step(found: list[Row]) -> list[Row]:
        old, new = ([r for r in found if r["old"] == mark] for mark in (True, False))
        above = lambda a, b: v if (v := _iou(a, b)) > threshold else -1.0
        return [{**{k: old[i][k] for k in FRAME}, "old_id": old[i]["det_id"], "new_id": new[j]["det_id"], "iou": v} for i, j, v in greedy_pairs(old, new, above, threshold)]

    return over_groups(both, FRAME, ["det_id", *SIDES], step, _fields(detections, FRAME) + ", old_id int, new_id int, iou double")


def stereo_disparity(pairs: DataFrame) -> DataFrame:
    """(video_id, frame_idx, disparity, pairs) of matched boxes: the median of left_x - right_x."""
    return pairs.groupBy(*FRAME).agg(F.median(F.col("left_x") - F.col("right_x")).alias("disparity"), F.count("*").alias("pairs"))


def stereo_cost(left, right, eye_width: Column, height: Column, *, disparity: float = 0.0, calibrated: bool = False) -> Column:
    """Cost of pairing boxes of two eyes; null outside the gates."""
    (lx, ly, ls), (rx, ry, rs) = boxes.normalised(left, eye_width, height), boxes.normalised(right, eye_width, height)
    gate = STEREO_X_CALIBRATED if calibrated else STEREO_X
    dx, dy, ratio = F.abs(lx - rx - disparity), F.abs(ly - ry), ls / F.greatest(rs, F.lit(1.0))
    return F.when((dx <= gate) & (dy <= STEREO_Y) & ratio.between(*STEREO_RATIO), dx / gate + dy / STEREO_Y + F.abs(1.0 - ratio))


def stereo_pairs(costs: DataFrame) -> DataFrame:
    """One-to-one pairs of least cost of (video_id, frame_idx, left_id, right_id, cost)."""

    def step(rows: list[Row]) -> list[Row]:
        left, right, out = set(), set(), []
        for row in rows:
            if row["left_id"] not in left and row["right_id"] not in right:
                left.add(row["left_id"])
                right.add(row["right_id"])
                out.append(row)
        return out

    return over_groups(costs.filter("cost is not null"), FRAME, ["cost", "left_id", "right_id"], step, costs.schema)


def mirrored(detections: DataFrame, eye_width: Column) -> DataFrame:
    """Every box, and once more in the other half of a side-by-side frame."""
    dx = F.when((F.col("x1") + F.col("x2")) / 2 < eye_width, eye_width).otherwise(-eye_width)
    other = detections.withColumns(dict(zip(SIDES, boxes.shifted(boxes.box(), dx))))
    return detections.withColumn("mirror", F.lit(False)).unionByName(other.withColumn("mirror", F.lit(True)))
