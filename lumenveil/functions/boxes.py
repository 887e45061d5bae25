"""Box algebra: intersections over union, filters, risks and interpolation.

Boxes are four columns x1, y1, x2, y2, or structs with these fields.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


def box(prefix: str = "", suffix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{s}{suffix}") for s in SIDES)


def of(struct: Column) -> tuple[Column, ...]:
    return tuple(struct[s] for s in SIDES)


def area(b) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a, b, extra: float = 0.0) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + extra
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + extra
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a, b) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def iou_floored(a, b) -> Column:
    """As :func:`iou`, with areas of at least 1."""
    both = intersection(a, b)
    return both / (F.greatest(area(a), F.lit(1.0)) + F.greatest(area(b), F.lit(1.0)) - both)


def iou_inclusive(a, b) -> Column:
    """As :func:`iou` for boxes whose last pixel belongs to them (+1)."""
    grown = lambda x: (x[2] - x[0] + 1) * (x[3] - x[1] + 1)
    both = intersection(a, b, 1.0)
    return both / (grown(a) + grown(b) - both)


def centre(b) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def longer_side(b) -> Column:
    return F.greatest(b[2] - b[0], b[3] - b[1])


def centre_distance(a, b) -> Column:
    """Distance of the centres over the longer side of the first box (>= 1)."""
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) / F.greatest(longer_side(a), F.lit(1.0))


def expanded(b, share: float, width: Column, height: Column) -> tuple[Column, ...]:
    """Grown by a share of its size on every side, cut to whole pixels and clipped."""
    dx, dy = ((b[2] - b[0]) * share).cast("int"), ((b[3] - b[1]) * share).cast("int")
    clip = lambda v, most: F.greatest(F.lit(0), F.least(v.cast("int"), most.cast("int")))
    return clip(b[0] - dx, width), clip(b[1] - dy, height), clip(b[2] + dx, width), clip(b[3] + dy, height)


def normalised(b, width: Column, height: Column) -> tuple[Column, Column, Column]:
    """Centre as shares of the view, and the longer side in pixels."""
    x, y = centre(b)
    return x / width, y / height, longer_side(b)


def shifted(b, dx: Column) -> tuple[Column, ...]:
    return b[0] + dx, b[1], b[2] + dx, b[3]


def plausible_face(b, width: Column, height: Column) -> Column:
    """At least 15 pixels, at most 12 % of the frame, sides within 1:2."""
    w, h = b[2] - b[0], b[3] - b[1]
    return (w >= 15) & (h >= 15) & (w * h <= 0.12 * width * height) & (w / h >= 0.5) & (w / h <= 2.0)


def passes(score: Column, least: float) -> Column:
    """Whether a score reaches a threshold; an absent score does."""
    return score.isNull() | (score >= least)


def _let(values: dict[str, Column], body) -> Column:
    """``body`` of a struct of values, each computed once."""
    return F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), body)[0]


def _face(landmarks: Column, b) -> dict[str, Column]:
    """Measures of five landmarks (eyes, nose, mouth corners; left first)."""
    left_eye, right_eye, nose, left_mouth, right_mouth = (F.get(landmarks, k) for k in range(5))
    return {
        "w": b[2] - b[0], "h": b[3] - b[1], "nose_x": nose["x"], "nose_y": nose["y"],
        "eyes": right_eye["x"] - left_eye["x"], "mouth": right_mouth["x"] - left_mouth["x"],
        "eye_x": (left_eye["x"] + right_eye["x"]) / 2, "mouth_x": (left_mouth["x"] + right_mouth["x"]) / 2,
        "eye_y": (left_eye["y"] + right_eye["y"]) / 2, "mouth_y": (left_mouth["y"] + right_mouth["y"]) / 2,
        "eye_tilt": F.abs(right_eye["y"] - left_eye["y"]), "mouth_tilt": F.abs(right_mouth["y"] - left_mouth["y"]),
        "least_x": F.least(left_eye["x"], right_eye["x"], left_mouth["x"], right_mouth["x"]),
        "most_x": F.greatest(left_eye["x"], right_eye["x"], left_mouth["x"], right_mouth["x"]),
    }


# Weights and scales of the soft risk, bounds of the hard test.
RISK_WEIGHTS = {"nose": 0.70, "span": 0.20, "vertical": 0.10}
RISK_SCALES = {"corridor": 0.08, "nose": 0.12, "span": 0.35, "vertical": 0.55}
EYE_SPAN, MOUTH_SPAN, EYE_TO_MOUTH, NOSE_RATIO = (0.01, 0.75), (0.03, 0.75), (0.25, 0.70), (0.02, 1.05)
TILT, NOSE_MARGIN, POINT_MARGIN = 0.35, 0.08, 0.15


def landmark_risk(landmarks: Column, b) -> Column:
    """How odd five landmarks look in a box, 0..1; 1 unless there are five.

    Weighs a nose outside the corridor between eyes and mouth, very unequal widths
    of eyes and mouth, and a nose far from half-way between them in height.
    """
    share = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

    def risk(f: Column) -> Column:
        margin = f["w"] * RISK_SCALES["corridor"]
        outside = F.greatest(F.least(f["eye_x"], f["mouth_x"]) - margin - f["nose_x"], f["nose_x"] - F.greatest(f["eye_x"], f["mouth_x"]) - margin, F.lit(0.0)) / f["w"]
        eyes, mouth = F.abs(f["eyes"]) / f["w"], F.abs(f["mouth"]) / f["w"]
        balance = F.least(eyes, mouth) / F.greatest(eyes, mouth, F.lit(1e-6))
        ratio = (f["nose_y"] - f["eye_y"]) / F.greatest(f["mouth_y"] - f["eye_y"], F.lit(1e-6))
        parts = {
            "nose": share(outside / RISK_SCALES["nose"]),
            "span": share((F.lit(RISK_SCALES["span"]) - balance) / RISK_SCALES["span"]),
            "vertical": share(F.abs(ratio - 0.5) / RISK_SCALES["vertical"]),
        }
        return share(sum(RISK_WEIGHTS[k] * v for k, v in parts.items()))

    known = F.coalesce((F.size(landmarks) == 5) & (b[2] > b[0]) & (b[3] > b[1]), F.lit(False))
    return F.when(known, _let(_face(landmarks, b), risk)).otherwise(F.lit(1.0))


def plausible_landmarks(landmarks: Column, b) -> Column:
    """Whether five landmarks can be those of a face in the box."""

    def test(f: Column) -> Column:
        reach = f["mouth_y"] - f["eye_y"]
        return (
            (f["eyes"] > 0) & (f["mouth"] > 0) & (f["eyes"] / f["w"]).between(*EYE_SPAN) & (f["mouth"] / f["w"]).between(*MOUTH_SPAN)
            & (reach >= EYE_TO_MOUTH[0] * f["h"]) & (reach <= EYE_TO_MOUTH[1] * f["h"])
            & (f["eye_tilt"] <= TILT * f["h"]) & (f["mouth_tilt"] <= TILT * f["h"])
            & F.try_divide(f["nose_y"] - f["eye_y"], reach).between(*NOSE_RATIO)
            & f["nose_x"].between(f["least_x"] - NOSE_MARGIN * f["w"], f["most_x"] + NOSE_MARGIN * f["w"])
        )

    w, h = b[2] - b[0], b[3] - b[1]
    near = F.forall(
        landmarks,
        lambda p: p["x"].between(b[0] - POINT_MARGIN * w, b[2] + POINT_MARGIN * w) & p["y"].between(b[1] - POINT_MARGIN * h, b[3] + POINT_MARGIN * h),
    )
    return F.coalesce((F.size(landmarks) == 5) & (w > 0) & (h > 0) & near & _let(_face(landmarks, b), test), F.lit(False))


def interpolated(a, b, share: Column) -> tuple[Column, ...]:
    """Between two boxes at ``share`` (clamped to 0..1), rounded half to even."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return tuple(F.bround(x + (y - x) * t).cast("int") for x, y in zip(a, b))


def hull(points: Column) -> tuple[Column, ...]:
    """The box around an array of struct<x, y>."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def correlation(a: Column, b: Column) -> Column:
    """Cosine of two arrays after taking off their means; 0 if one is constant."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    doubles = lambda x: F.transform(x, lambda v: v.cast("double"))
    centred = lambda x: F.transform(F.array(F.struct(x.alias("v"), mean(x).alias("m"))), lambda s: F.transform(s["v"], lambda v: v - s["m"]))[0]
    pair = F.array(F.struct(centred(doubles(a)).alias("a"), centred(doubles(b)).alias("b")))
    score = lambda s: F.coalesce(F.try_divide(dot(s["a"], s["b"]), F.sqrt(dot(s["a"], s["a"]) * dot(s["b"], s["b"]))), F.lit(0.0))
    return F.transform(pair, score)[0]


def peak_to_sidelobe(response: Column) -> Column:
    """(peak - mean) / (standard deviation + 1e-6) of an array of match responses."""
    n = F.size(response)
    total = lambda of: F.aggregate(response, F.lit(0.0), lambda t, x: t + of(x.cast("double")))
    return _let({"mean": total(lambda x: x) / n}, lambda m: (F.array_max(response) - m["mean"]) / (F.sqrt(total(lambda x: (x - m["mean"]) * (x - m["mean"])) / n) + 1e-6))


def grid_points(b, width: Column, height: Column, n: int = 3, margin: float = 0.12) -> Column:
    """array<struct<x, y>>: n x n points inside a box clipped to the frame; null below 12 pixels."""
    x1, y1, x2, y2 = F.greatest(b[0], F.lit(0)), F.greatest(b[1], F.lit(0)), F.least(b[2], width), F.least(b[3], height)
    at = lambda low, high, k: low + (high - low) * (margin + (1 - 2 * margin) * k / (n - 1))
    points = F.array(*(F.struct(at(x1, x2, i).alias("x"), at(y1, y2, j).alias("y")) for j in range(n) for i in range(n)))
    return F.when((x2 - x1 >= 12) & (y2 - y1 >= 12), points)
