"""Boxes and keypoints: formats, checks, filters, labels. Flat relations, expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlane.operators.geometry import angle, moved

from .sampling import num

BOX = ("x_min", "y_min", "x_max", "y_max")
#: Per format: internal corners of the columns a, b, c, e; and the columns of internal corners.
TO_INTERNAL = {
    "coco": ("x_min / w", "y_min / h", "(x_min + x_max) / w", "(y_min + y_max) / h"),
    "pascal_voc": ("x_min / w", "y_min / h", "x_max / w", "y_max / h"),
    "yolo": ("x_min - x_max / 2e0", "y_min - y_max / 2e0", "x_min + x_max / 2e0", "y_min + y_max / 2e0"),
    "normalised": ("x_min", "y_min", "x_max", "y_max"),
}
FROM_INTERNAL = {
    "coco": ("x_min * w", "y_min * h", "(x_max - x_min) * w", "(y_max - y_min) * h"),
    "pascal_voc": ("x_min * w", "y_min * h", "x_max * w", "y_max * h"),
    "yolo": ("(x_min + x_max) / 2e0", "(y_min + y_max) / 2e0", "x_max - x_min", "y_max - y_min"),
    "normalised": ("x_min", "y_min", "x_max", "y_max"),
}


def boxes_to_internal(df: DataFrame, fmt: str) -> DataFrame:
    """Columns x_min, y_min, x_max, y_max hold the format's four numbers in its order."""
    return moved(df, **dict(zip(BOX, TO_INTERNAL[fmt])))


def boxes_from_internal(df: DataFrame, fmt: str) -> DataFrame:
    return moved(df, **dict(zip(BOX, FROM_INTERNAL[fmt])))


def boxes_clipped(df: DataFrame) -> DataFrame:
    return moved(df, **{c: f"greatest(0e0, least(1e0, {c}))" for c in BOX})


def box_area(df: DataFrame) -> DataFrame:
    """With area in pixels."""
    return df.withColumn("area", F.expr("(x_max - x_min) * w * (y_max - y_min) * h"))


def boxes_checked(df: DataFrame) -> DataFrame:
    """Fails on a box outside [0, 1] (to 1e-6) or without extent."""
    bad = " or ".join(f"{c} < -1e-6 or {c} > 1.000001e0" for c in BOX)
    return df.withColumn("x_min", F.expr(f"case when {bad} or x_max <= x_min or y_max <= y_min then cast(raise_error(concat('invalid box of sample ', sample_id)) as double) else x_min end"))


@dataclass(frozen=True)
class BoxParams:
    format: str = "normalised"
    min_area: float = 0.0
    min_visibility: float = 0.0
    min_width: float = 0.0
    min_height: float = 0.0
    max_accept_ratio: float | None = None
    check_each_transform: bool = True
    clip: bool = False
    filter_invalid_bboxes: bool = False
    label_fields: tuple = ()

    def __post_init__(self):
        if self.format not in TO_INTERNAL:
            raise ValueError(f"format: {self.format!r} is none of {sorted(TO_INTERNAL)}")
        for name in ("min_area", "min_width", "min_height"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name}: {getattr(self, name)} is negative")
        if not 0 <= self.min_visibility <= 1:
            raise ValueError(f"min_visibility: {self.min_visibility} is not within 0 and 1")
        if self.max_accept_ratio is not None and self.max_accept_ratio < 1:
            raise ValueError(f"max_accept_ratio: {self.max_accept_ratio} is below 1")

    def prepared(self, df: DataFrame) -> DataFrame:
        df = boxes_to_internal(fields_kept(df, self.label_fields), self.format)
        if self.clip:
            df = boxes_clipped(df)
        if self.filter_invalid_bboxes:
            return df.where("x_max > x_min and y_max > y_min and " + " and ".join(f"{c} between 0 and 1" for c in BOX))
        return boxes_checked(df)

    def filtered(self, df: DataFrame) -> DataFrame:
        """Clipped boxes that keep enough area, visibility, width, height and aspect."""
        width, height = "(greatest(0e0, least(1e0, x_max)) - greatest(0e0, least(1e0, x_min))) * w", "(greatest(0e0, least(1e0, y_max)) - greatest(0e0, least(1e0, y_min))) * h"
        full = "(x_max - x_min) * w * (y_max - y_min) * h"
        keep = f"{full} >= 1e-7 and {width} * {height} >= {num(max(self.min_area, 1e-7))} and {width} * {height} >= {num(self.min_visibility)} * {full} and {width} >= {num(self.min_width)} and {height} >= {num(self.min_height)}"
        if self.max_accept_ratio:
            keep += f" and greatest({width} / ({height}), {height} / ({width})) <= {num(self.max_accept_ratio)}"
        return boxes_clipped(df.where(keep))

    def finished(self, df: DataFrame) -> DataFrame:
        return boxes_from_internal(self.filtered(df), self.format)


def keypoints_to_internal(df: DataFrame, degrees: bool = True) -> DataFrame:
    """Missing columns are zero, as each of the formats xy, yx, xya, xys, xyas, xysa, xyz leaves them."""
    for c in ("z", "angle", "scale"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0.0))
    return moved(df, angle=angle("radians(angle)" if degrees else "angle"))


def keypoints_from_internal(df: DataFrame, degrees: bool = True) -> DataFrame:
    return moved(df, angle=f"degrees({angle('angle')})" if degrees else angle("angle"))


#: The columns that a keypoint format shows, in order.
KEYPOINT_FORMATS = {"xy": ("x", "y"), "yx": ("y", "x"), "xya": ("x", "y", "angle"), "xys": ("x", "y", "scale"), "xyas": ("x", "y", "angle", "scale"), "xysa": ("x", "y", "scale", "angle"), "xyz": ("x", "y", "z")}


def keypoints_as(df: DataFrame, fmt: str, degrees: bool = True) -> DataFrame:
    """sample_id, kp_ix, label and the format's array."""
    shown = keypoints_from_internal(df, degrees)
    return shown.select("sample_id", "kp_ix", "label", F.array(*[F.col(c).cast("double") for c in KEYPOINT_FORMATS[fmt]]).alias("keypoint"))


def keypoints_from_arrays(df: DataFrame, fmt: str) -> DataFrame:
    """Columns x, y (and z, angle, scale where the format has them) of the array column keypoint.

    A null array, or one of another length than the format's, fails.
    """
    names = KEYPOINT_FORMATS[fmt]
    at = F.expr(f"case when size(keypoint) = {len(names)} then keypoint else cast(raise_error(concat('keypoint of sample ', sample_id, ' is not {fmt}')) as array<double>) end")
    df = df.withColumn("__k", at)
    return df.withColumns({c: F.col("__k")[i].cast("double") for i, c in enumerate(names)}).drop("__k", "keypoint")


def keypoints_checked(df: DataFrame) -> DataFrame:
    """Fails on a keypoint that is null or not a number, lies outside its sample (to 1e-6 of a pixel) or
    has an angle outside [0, 2 pi) (to 1e-6). Rows without a keypoint at all are not there to fail."""
    inside = " and ".join(f"{c} >= -1e-6 and {c} < {side}" for c, side in (("x", "w"), ("y", "h"), *((("z", "d"),) if "d" in df.columns else ())))
    turn = "angle >= -1e-6 and angle < 6.283185307179586e0 + 1e-6"
    good = f"coalesce({inside} and {turn} and not isnan(x) and not isnan(y), false)"
    return df.withColumn("x", F.expr(f"case when {good} then x else cast(raise_error(concat('invalid keypoint of sample ', sample_id)) as double) end"))


def fields_kept(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """df, which has to have the label fields; any other columns are kept too."""
    if missing := sorted(set(fields) - set(df.columns)):
        raise ValueError(f"no label fields {missing}")
    return df


@dataclass(frozen=True)
class KeypointParams:
    """format: of the array column keypoint where the relation has one, else the columns x, y, z, angle,
    scale are read as they are. label_fields: columns that have to be there; all columns are kept."""

    format: str = "xy"
    remove_invisible: bool = True
    angle_in_degrees: bool = True
    check_each_transform: bool = True
    label_fields: tuple = ()

    def __post_init__(self):
        if self.format not in KEYPOINT_FORMATS:
            raise ValueError(f"format: {self.format!r} is none of {sorted(KEYPOINT_FORMATS)}")

    def prepared(self, df: DataFrame) -> DataFrame:
        df = fields_kept(df, self.label_fields)
        if "keypoint" in df.columns:
            df = keypoints_from_arrays(df, self.format)
            df = keypoints_to_internal(df, self.angle_in_degrees)
            return df if not self.remove_invisible else keypoints_checked(df)
        return keypoints_to_internal(df, self.angle_in_degrees)

    def filtered(self, df: DataFrame) -> DataFrame:
        if not self.remove_invisible:
            return df
        return df.where("x >= 0 and x < w and y >= 0 and y < h" + (" and z >= 0 and z < d" if "d" in df.columns else ""))

    def finished(self, df: DataFrame) -> DataFrame:
        return keypoints_from_internal(self.filtered(df), self.angle_in_degrees)

    def shown(self, df: DataFrame) -> DataFrame:
        """A finished relation with its keypoints as arrays in the format, and its other columns."""
        rest = [c for c in df.columns if c not in ("x", "y", "z", "angle", "scale", "keypoint")]
        return df.select(*rest, F.array(*[F.col(c).cast("double") for c in KEYPOINT_FORMATS[self.format]]).alias("keypoint"))


def labels_encoded(df: DataFrame, label: str = "label") -> DataFrame:
    """With label_id: numbers before strings, each in order, null last. Distinct labels are dealt by ranges
    of this order; a label's number is its place in its range after the sizes of the ranges before."""
    n = f"try_cast({label} as double)"
    order = [F.col(label).isNull(), F.expr(f"{n} is null"), F.expr(n), F.col(label)]
    kinds = df.select(label).distinct().repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    place = Window.partitionBy("__part").orderBy(*order)
    ranked = kinds.withColumn("__n", F.row_number().over(place))
    sizes = ranked.groupBy("__part").agg(F.count("*").alias("size"))
    offsets = sizes.select("__part", (F.sum("size").over(Window.orderBy("__part")) - F.col("size")).alias("__before"))  # a row for each range
    ids = ranked.join(offsets, "__part").select(F.col(label).alias("__label"), (F.col("__n") + F.col("__before") - 1).alias("label_id"))
    return df.join(ids, F.col(label).eqNullSafe(F.col("__label"))).drop("__label")


def labels_decoded(df: DataFrame, ids: DataFrame, label: str = "label") -> DataFrame:
    """ids: label, label_id."""
    return df.drop(label).join(ids, "label_id").drop("label_id")


def boxes_to_masks(boxes: DataFrame) -> DataFrame:
    """sample_id, box_ix, y, x of the pixels of each box (corners truncated, maximum exclusive)."""
    rows = boxes.selectExpr("sample_id", "box_ix", "cast(floor(x_min * w) as int) as x0", "cast(floor(y_min * h) as int) as y0", "cast(floor(x_max * w) as int) as x1", "cast(floor(y_max * h) as int) as y1").where("x1 > x0 and y1 > y0")
    return rows.select("sample_id", "box_ix", F.explode(F.expr("sequence(y0, y1 - 1)")).alias("y"), "x0", "x1").select("sample_id", "box_ix", "y", F.explode(F.expr("sequence(x0, x1 - 1)")).alias("x"))


def masks_to_boxes(pixels: DataFrame, inclusive: bool = False) -> DataFrame:
    """sample_id, box_ix, x_min, y_min, x_max, y_max in pixels; the maximum is exclusive unless inclusive."""
    more = 0 if inclusive else 1
    return pixels.groupBy("sample_id", "box_ix").agg(F.min("x").alias("x_min"), F.min("y").alias("y_min"), (F.max("x") + more).alias("x_max"), (F.max("y") + more).alias("y_max"))


def union_of_boxes(boxes: DataFrame, erosion: float = 0.0) -> DataFrame:
    """sample_id and the corners around all boxes, each box shrunk by the share first."""
    e = num(erosion)
    b = moved(boxes, x_min=f"x_min + (x_max - x_min) * {e} / 2e0", x_max=f"x_max - (x_max - x_min) * {e} / 2e0", y_min=f"y_min + (y_max - y_min) * {e} / 2e0", y_max=f"y_max - (y_max - y_min) * {e} / 2e0")
    return b.groupBy("sample_id").agg(F.min("x_min").alias("x_min"), F.min("y_min").alias("y_min"), F.max("x_max").alias("x_max"), F.max("y_max").alias("y_max"))
