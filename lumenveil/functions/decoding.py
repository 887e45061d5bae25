"""Detector outputs as boxes: anchors, grids, letterboxes and card contours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds and weights of the card test on contours.
CARD_AREA, CARD_ASPECTS, CARD_FILL, CARD_SIDE, CARD_TEXTURE = (0.0015, 0.06), (1.25, 2.0), 0.55, 90, 46
CARD_ASPECT, CARD_SPREAD = 1.586, 0.75
CARD_WEIGHTS = {"aspect": 0.6, "fill": 0.3, "texture": 0.1}


def anchor_grid(inputs: DataFrame, size: str, stride: int, per_cell: int = 2) -> DataFrame:
    """inputs with (anchor, x, y) of the grid of each square input of ``size`` pixels, row by row."""
    side = F.floor(F.col(size) / stride)
    spread = inputs.withColumn("anchor", F.explode(F.sequence(F.lit(0).cast("bigint"), side * side * per_cell - 1)))
    cell = F.floor(F.col("anchor") / per_cell)
    return spread.withColumns({"x": (cell % side * stride).cast("double"), "y": (F.floor(cell / side) * stride).cast("double")})


def box_from_distances(x: Column, y: Column, distances: Column) -> tuple[Column, ...]:
    """Left, top, right and bottom distances from an anchor as a box."""
    left, top, right, bottom = (F.get(distances, k) for k in range(4))
    return x - left, y - top, x + right, y + bottom


def points_from_distances(x: Column, y: Column, distances: Column) -> Column:
    """Pairs of offsets from an anchor as array<struct<x, y>>."""
    return F.transform(F.sequence(F.lit(0), (F.size(distances) / 2).cast("int") - 1), lambda k: F.struct((x + F.get(distances, 2 * k)).alias("x"), (y + F.get(distances, 2 * k + 1)).alias("y")))


def grid_score(cls: Column, obj: Column) -> Column:
    """Geometric mean of two probabilities clipped to 0..1."""
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return F.sqrt(clip(cls) * clip(obj))


def grid_box(index: Column, columns: Column, stride: Column, offsets: Column) -> tuple[Column, ...]:
    """Box of a cell: offsets are (dx, dy, log width, log height) in strides."""
    dx, dy, dw, dh = (F.get(offsets, k) for k in range(4))
    x, y = (index % columns + dx) * stride, (F.floor(index / columns) + dy) * stride
    w, h = F.exp(dw) * stride, F.exp(dh) * stride
    return x - w / 2, y - h / 2, x + w / 2, y + h / 2


def letterbox(width: Column, height: Column, size: int) -> Column:
    """struct<scale, left, top> of a frame fitted into a square."""
    scale = F.least(size / width, size / height)
    pad = lambda side: F.floor((F.lit(size) - (side * scale).cast("int")) / 2)
    return F.struct(scale.alias("scale"), pad(width).alias("left"), pad(height).alias("top"))


def from_letterbox(b, fit: Column, width: Column, height: Column) -> tuple[Column, ...]:
    """A box in the square back in the frame: whole pixels, clipped."""
    x = lambda v: ((v - fit["left"]) / fit["scale"]).cast("int")
    y = lambda v: ((v - fit["top"]) / fit["scale"]).cast("int")
    return F.greatest(F.lit(0), x(b[0])), F.greatest(F.lit(0), y(b[1])), F.least(width, x(b[2])), F.least(height, y(b[3]))


def rescaled(b, scale: Column) -> tuple[Column, ...]:
    """A box found on a smaller copy, in pixels of the frame."""
    return tuple((v / scale).cast("int") for v in b)


def card_like(area: Column, long_side: Column, short_side: Column, fill: Column, texture: Column, width: Column, height: Column) -> Column:
    """Whether a contour can be a card: size, aspect, fill and a calm surface."""
    ratio = F.try_divide(long_side, short_side)
    return F.coalesce(
        (short_side >= 1) & area.between(CARD_AREA[0] * width * height, CARD_AREA[1] * width * height) & ratio.between(*CARD_ASPECTS) & (fill >= CARD_FILL)
        & (long_side >= CARD_SIDE) & (texture <= CARD_TEXTURE),
        F.lit(False),
    )


def card_score(long_side: Column, short_side: Column, fill: Column, texture: Column) -> Column:
    """Weighted closeness to a card, to three places."""
    aspect = 1.0 - F.abs(long_side / short_side - CARD_ASPECT) / CARD_SPREAD
    calm = 1.0 - F.least(texture, F.lit(float(CARD_TEXTURE))) / CARD_TEXTURE
    return F.bround(aspect * CARD_WEIGHTS["aspect"] + fill * CARD_WEIGHTS["fill"] + calm * CARD_WEIGHTS["texture"], 3)
