"""Rigid geometry, crops and pads: coordinates are projected, never gathered.

Each operator is a forward map of pixel coordinates (a permutation, a window or a shift), so pixels,
masks, boxes and keypoints move in one projection with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlane.functions.sampling import Draws, num

from .base import Operator, operator, or_old, or_stays, values

PI = "3.141592653589793e0"
TWO_PI = "6.283185307179586e0"


def angle(expression: str) -> str:
    """In [0, 2 pi)."""
    return f"(({expression}) - floor(({expression}) / {TWO_PI}) * {TWO_PI})"


def moved(df: DataFrame, **new: str) -> DataFrame:
    """Columns replaced at once: expressions see the old values."""
    return df.select(*[F.expr(f"cast({new[c]} as {t})").alias(c) if c in new else F.col(c) for c, t in df.dtypes])


#: Per element of the square's symmetry group: new y, new x of pixels; new size; box corners; keypoint x, y, angle.
D4_PIXELS = {
    "e": ("y", "x", False),
    "r90": ("w - 1 - x", "y", True),
    "r180": ("h - 1 - y", "w - 1 - x", False),
    "r270": ("x", "h - 1 - y", True),
    "v": ("h - 1 - y", "x", False),
    "h": ("y", "w - 1 - x", False),
    "t": ("x", "y", True),
    "hvt": ("w - 1 - x", "h - 1 - y", True),
}
D4_BOXES = {
    "e": ("x_min", "y_min", "x_max", "y_max"),
    "r90": ("y_min", "1e0 - x_max", "y_max", "1e0 - x_min"),
    "r180": ("1e0 - x_max", "1e0 - y_max", "1e0 - x_min", "1e0 - y_min"),
    "r270": ("1e0 - y_max", "x_min", "1e0 - y_min", "x_max"),
    "v": ("x_min", "1e0 - y_max", "x_max", "1e0 - y_min"),
    "h": ("1e0 - x_max", "y_min", "1e0 - x_min", "y_max"),
    "t": ("y_min", "x_min", "y_max", "x_max"),
    "hvt": ("1e0 - y_max", "1e0 - x_max", "1e0 - y_min", "1e0 - x_min"),
}
D4_KEYPOINTS = {
    "e": ("x", "y", "angle"),
    "r90": ("y", "w - 1 - x", f"angle - {PI} / 2"),
    "r180": ("w - 1 - x", "h - 1 - y", f"angle + {PI}"),
    "r270": ("h - 1 - y", "x", f"angle + {PI} / 2"),
    "v": ("x", "h - 1 - y", "-angle"),
    "h": ("w - 1 - x", "y", f"{PI} - angle"),
    "t": ("y", "x", f"{PI} / 2 - angle"),
    "hvt": ("h - 1 - y", "w - 1 - x", f"1.5e0 * {PI} - angle"),
}


class Symmetry(Operator):
    """elements: what is drawn from, evenly."""

    elements: tuple = ("e",)
    spatial = True

    def draws(self, d: Draws):
        n = len(self.elements)
        return {} if n == 1 else {"k": f"cast(floor({d.unit('k')} * {n}) as int)"}

    def pick(self, of) -> str:
        if len(self.elements) == 1:
            return of(self.elements[0])
        return f"case p_k {' '.join(f'when {i} then {of(e)}' for i, e in enumerate(self.elements))} end"

    def sizes(self) -> dict[str, str]:
        return {"h": self.pick(lambda e: "w" if D4_PIXELS[e][2] else "h"), "w": self.pick(lambda e: "h" if D4_PIXELS[e][2] else "w")}

    def out_size(self):
        return tuple(self.sizes().values())

    def on_pixels(self, df, channels, top):
        return moved(df, y=self.pick(lambda e: D4_PIXELS[e][0]), x=self.pick(lambda e: D4_PIXELS[e][1]), **self.sizes())

    def on_boxes(self, df):
        new = {c: self.pick(lambda e, i=i: D4_BOXES[e][i]) for i, c in enumerate(("x_min", "y_min", "x_max", "y_max"))}
        return moved(df, **new, **self.sizes())

    def on_keypoints(self, df):
        new = {c: self.pick(lambda e, i=i: D4_KEYPOINTS[e][i]) for i, c in enumerate(("x", "y", "angle"))}
        new["angle"] = angle(new["angle"])
        return moved(df, **new, **self.sizes())


@operator
class HorizontalFlip(Symmetry):
    p: float = 0.5
    elements = ("h",)


@operator
class VerticalFlip(Symmetry):
    p: float = 0.5
    elements = ("v",)


@operator
class Transpose(Symmetry):
    p: float = 0.5
    elements = ("t",)


@operator
class D4(Symmetry):
    p: float = 1.0
    elements = ("e", "r90", "r180", "r270", "v", "hvt", "h", "t")


@operator
class SquareSymmetry(Symmetry):
    p: float = 1.0
    elements = D4.elements


@operator
class RandomRotate90(Symmetry):
    p: float = 1.0
    elements = ("e", "r90", "r180", "r270")


@operator
class TimeReverse(Symmetry):
    p: float = 0.5
    elements = ("h",)


class Window(Operator):
    """Keeps x0 <= x < x1, y0 <= y < y1 (expressions over h, w and the draws) and moves it to 0, 0.

    Boxes are shifted and normalised by the new size; those that fall outside go in a later filter.
    """

    spatial = True
    own = ("pixels", "masks", "boxes", "keypoints")

    def bounds(self) -> tuple[str, str, str, str]:
        raise NotImplementedError

    def out_size(self):
        x0, y0, x1, y1 = self.bounds()
        return f"({y1}) - ({y0})", f"({x1}) - ({x0})"

    def edges(self, df: DataFrame) -> tuple[str, ...]:
        """bounds(), or the whole sample where a gate is closed."""
        return tuple(or_old(df, f"({b})", side) for b, side in zip(self.bounds(), ("0", "0", "w", "h")))

    def on_pixels(self, df, channels, top):
        x0, y0, x1, y1 = self.edges(df)
        kept = df.withColumns({"__x0": F.expr(x0), "__y0": F.expr(y0), "__x1": F.expr(x1), "__y1": F.expr(y1)}).where("x >= __x0 and x < __x1 and y >= __y0 and y < __y1")
        return moved(kept, x="x - __x0", y="y - __y0", w="__x1 - __x0", h="__y1 - __y0").drop("__x0", "__y0", "__x1", "__y1")

    def on_boxes(self, df):
        x0, y0, x1, y1 = self.edges(df)
        nw, nh = f"({x1} - {x0})", f"({y1} - {y0})"
        new = {"x_min": f"(x_min * w - {x0}) / {nw}", "x_max": f"(x_max * w - {x0}) / {nw}", "y_min": f"(y_min * h - {y0}) / {nh}", "y_max": f"(y_max * h - {y0}) / {nh}"}
        return moved(df, **{k: or_old(df, e, k) for k, e in new.items()}, w=nw, h=nh)

    def on_keypoints(self, df):
        x0, y0, x1, y1 = self.edges(df)
        return moved(df, x=f"x - {x0}", y=f"y - {y0}", w=f"{x1} - {x0}", h=f"{y1} - {y0}")


def fits(size: str, side: str) -> str:
    """size, or an error where it is larger than the side."""
    return f"(case when {size} <= {side} then {size} else cast(raise_error('crop larger than the sample') as int) end)"


@operator
class RandomCrop(Window):
    height: int = 4
    width: int = 4
    p: float = 1.0

    def draws(self, d: Draws):
        return {"u": d.unit("u"), "v": d.unit("v")}

    def bounds(self):
        x0, y0 = f"cast(floor((w - {self.width} + 1) * p_u) as int)", f"cast(floor((h - {self.height} + 1) * p_v) as int)"
        return x0, y0, f"{x0} + {fits(str(self.width), 'w')}", f"{y0} + {fits(str(self.height), 'h')}"


@operator
class CenterCrop(Window):
    height: int = 4
    width: int = 4
    p: float = 1.0

    def bounds(self):
        x0, y0 = f"cast(floor((w - {self.width}) / 2) as int)", f"cast(floor((h - {self.height}) / 2) as int)"
        return x0, y0, f"{x0} + {fits(str(self.width), 'w')}", f"{y0} + {fits(str(self.height), 'h')}"


@operator
class Crop(Window):
    x_min: int = 0
    y_min: int = 0
    x_max: int = 1024
    y_max: int = 1024
    p: float = 1.0

    def bounds(self):
        return str(self.x_min), str(self.y_min), f"least({self.x_max}, w)", f"least({self.y_max}, h)"


@operator
class RandomCropFromBorders(Window):
    crop_left: float = 0.1
    crop_right: float = 0.1
    crop_top: float = 0.1
    crop_bottom: float = 0.1
    p: float = 1.0

    def draws(self, d: Draws):
        x0 = d.integer("l", 0, f"cast(floor(w * {num(self.crop_left)}) as int)")
        y0 = d.integer("t", 0, f"cast(floor(h * {num(self.crop_top)}) as int)")
        x1 = d.integer("r", f"greatest(cast(floor(w * (1e0 - {num(self.crop_right)})) as int), {x0} + 1)", "w")
        y1 = d.integer("b", f"greatest(cast(floor(h * (1e0 - {num(self.crop_bottom)})) as int), {y0} + 1)", "h")
        return {"x0": x0, "y0": y0, "x1": f"greatest({x1}, {x0} + 1)", "y1": f"greatest({y1}, {y0} + 1)"}

    def bounds(self):
        return "p_x0", "p_y0", "p_x1", "p_y1"


class AroundColumns(Window):
    """Windows from per-sample columns that were joined to the relations: cx0, cy0, cx1, cy1."""

    def bounds(self):
        return "cx0", "cy0", "cx1", "cy1"


@operator
class RandomCropNearBBox(AroundColumns):
    """Every edge of a given box (columns bx0, by0, bx1, by1 in pixels) moves by a share of its side."""

    max_part_shift: tuple = (0.3, 0.3)
    p: float = 1.0

    def draws(self, d: Draws):
        dx, dy = "(bx1 - bx0)", "(by1 - by0)"
        sx, sy = self.max_part_shift
        x0 = f"greatest(0, cast(floor(bx0 + {dx} * {d.between('x0', -sx, sx)}) as int))"
        y0 = f"greatest(0, cast(floor(by0 + {dy} * {d.between('y0', -sy, sy)}) as int))"
        x1 = f"least(w, cast(floor(bx1 + {dx} * {d.between('x1', -sx, sx)}) as int))"
        y1 = f"least(h, cast(floor(by1 + {dy} * {d.between('y1', -sy, sy)}) as int))"
        return {"x0": x0, "y0": y0, "x1": f"greatest({x1}, {x0} + 1)", "y1": f"greatest({y1}, {y0} + 1)"}

    def bounds(self):
        return "p_x0", "p_y0", "p_x1", "p_y1"


@operator
class BBoxSafeRandomCrop(Window):
    """A window that holds the union of a sample's boxes (columns ux0, uy0, ux1, uy1, normalised;
    null without boxes, then any window)."""

    erosion_rate: float = 0.0
    p: float = 1.0

    def draws(self, d: Draws):
        e = num(self.erosion_rate)
        lo = {a: f"coalesce(u{a}0 + (u{a}1 - u{a}0) * {e} / 2e0, 0.5e0)" for a in "xy"}
        hi = {a: f"coalesce(u{a}1 - (u{a}1 - u{a}0) * {e} / 2e0, 0.5e0)" for a in "xy"}
        out = {}
        for a, side in (("x", "w"), ("y", "h")):
            out[f"{a}0"] = f"cast(floor(greatest(0e0, least(1e0, {lo[a]})) * {d.unit(a + '0')} * {side}) as int)"
            top = f"greatest(0e0, least(1e0, {hi[a]}))"
            out[f"{a}1"] = f"greatest(cast(floor(({top} + (1e0 - {top}) * {d.unit(a + '1')}) * {side} + 0.5e0) as int), {out[f'{a}0']} + 1)"
        return out

    def bounds(self):
        return "p_x0", "p_y0", "least(p_x1, w)", "least(p_y1, h)"


@operator
class AtLeastOneBBoxRandomCrop(Window):
    """A window that meets one of a sample's boxes (columns ox0, oy0, ox1, oy1, normalised; null: any)."""

    height: int = 4
    width: int = 4
    erosion_factor: float = 0.0
    p: float = 1.0

    def draws(self, d: Draws):
        out = {}
        for a, side, size in (("x", "w", self.width), ("y", "h", self.height)):
            keep = num(1 - self.erosion_factor)
            low = f"greatest(0e0, least({side} - {size}, coalesce(o{a}0 * {side} - {size} + (o{a}1 - o{a}0) * {side} * {keep}, 0e0)))"
            high = f"greatest(0e0, least({side} - {size}, coalesce(o{a}1 * {side} - (o{a}1 - o{a}0) * {side} * {keep}, {side} - {size})))"
            out[a] = f"cast(floor(least({low}, {high}) + abs({high} - {low}) * {d.unit(a)} + 0.5e0) as int)"
        return out

    def bounds(self):
        return "p_x", "p_y", f"p_x + {fits(str(self.width), 'w')}", f"p_y + {fits(str(self.height), 'h')}"


@operator
class CropNonEmptyMaskIfExists(Window):
    """A window around a mask pixel (columns mx, my; null where the mask is empty: any window)."""

    height: int = 4
    width: int = 4
    p: float = 1.0

    def draws(self, d: Draws):
        out = {}
        for a, side, size in (("x", "w", self.width), ("y", "h", self.height)):
            any_ = f"cast(floor(({side} - {size} + 1) * {d.unit(a)}) as int)"
            near = f"m{a} - cast(floor({size} * {d.unit(a + 'n')}) as int)"
            out[a] = f"greatest(0, least({side} - {size}, coalesce({near}, {any_})))"
        return out

    def bounds(self):
        return "p_x", "p_y", f"p_x + {self.width}", f"p_y + {self.height}"


def union_of_boxes(boxes: DataFrame) -> DataFrame:
    """(sample_id, ux0, uy0, ux1, uy1), normalised; one aggregation."""
    return boxes.groupBy("sample_id").agg(F.min("x_min").alias("ux0"), F.min("y_min").alias("uy0"), F.max("x_max").alias("ux1"), F.max("y_max").alias("uy1"))


def one_box(boxes: DataFrame, seed: int = 0) -> DataFrame:
    """(sample_id, ox0, oy0, ox1, oy1): one box of each sample, by a seeded order."""
    d = Draws(seed, "one_box")
    key = F.expr(d.unit("pick", "box_ix"))
    one = F.min_by(F.struct("x_min", "y_min", "x_max", "y_max"), F.struct(key, "box_ix"))
    return boxes.groupBy("sample_id").agg(one.alias("b")).select("sample_id", F.col("b.x_min").alias("ox0"), F.col("b.y_min").alias("oy0"), F.col("b.x_max").alias("ox1"), F.col("b.y_max").alias("oy1"))


def one_mask_pixel(masks: DataFrame, seed: int = 0, ignore: tuple = ()) -> DataFrame:
    """(sample_id, mx, my): one non-zero mask pixel of each sample, by a seeded order."""
    d = Draws(seed, "mask_pixel")
    rows = masks.where("v0 <> 0")
    if ignore:
        rows = rows.where(~F.col("v0").isin(*[float(i) for i in ignore]))
    key = F.struct(F.expr(d.unit("pick", "y * 65537 + x")), "y", "x")
    return rows.groupBy("sample_id").agg(F.min_by(F.struct("x", "y"), key).alias("m")).select("sample_id", F.col("m.x").alias("mx"), F.col("m.y").alias("my"))


def reflected(i: str, n: str) -> str:
    """Index of a border that mirrors without repeating the edge, for any distance."""
    period = f"greatest(1, 2 * ({n} - 1))"
    k = f"(((({i}) % {period}) + {period}) % {period})"
    return f"(case when {n} = 1 then 0 when {k} < {n} then {k} else {period} - {k} end)"


class Padded(Operator):
    """Adds left, top, right, bottom rows (expressions); new pixels are fill or mirrored.

    Pixels explode into the places that show them, so borders need no join; a constant border is
    made by the sample's first pixel.
    """

    spatial = True
    own = ("pixels", "masks", "boxes", "keypoints")
    fill = 0.0
    border = "constant"

    def sides(self) -> tuple[str, str, str, str]:
        raise NotImplementedError

    def out_size(self):
        left, above, right, below = self.sides()
        return f"h + ({above}) + ({below})", f"w + ({left}) + ({right})"

    def widths(self, df: DataFrame) -> tuple[str, ...]:
        """sides(), or none where a gate is closed."""
        return tuple(or_old(df, f"({s})", "0") for s in self.sides())

    def on_pixels(self, df, channels, top):
        left, above, right, below = self.widths(df)
        df = df.withColumns({"__l": F.expr(f"cast({left} as int)"), "__t": F.expr(f"cast({above} as int)"), "__w": F.expr(f"cast(w + {left} + {right} as int)"), "__h": F.expr(f"cast(h + {above} + {below} as int)")})
        if self.border == "constant":
            own = "array(named_struct('y', cast(y + __t as int), 'x', cast(x + __l as int), 'own', true))"
            cell = "named_struct('y', cast(floor(i / __w) as int), 'x', cast(i % __w as int), 'own', false)"
            edge = f"filter(transform(sequence(0, __w * __h - 1), i -> {cell}), c -> c.x < __l or c.x >= __l + w or c.y < __t or c.y >= __t + h)"
            out = df.withColumn("__at", F.explode(F.expr(f"case when x = 0 and y = 0 then concat({own}, {edge}) else {own} end")))
            out = out.withColumns({v: F.expr(f"case when __at.own then {v} else {num(float(self.fill))} end") for v in values(channels)})
            out = moved(out, y="__at.y", x="__at.x").drop("__at")
        else:
            # targets t of the source s: t = s + 2k(n - 1) or t = 2k(n - 1) - s, from the border outwards
            def targets(s: str, n: str, before: str, total: str) -> str:
                return f"filter(sequence(0, {total} - 1), t -> {reflected(f't - {before}', n)} = {s})"

            out = df.withColumn("__ty", F.explode(F.expr(targets("y", "h", "__t", "__h")))).withColumn("__tx", F.explode(F.expr(targets("x", "w", "__l", "__w"))))
            out = moved(out, y="__ty", x="__tx").drop("__ty", "__tx")
        return moved(out, h="__h", w="__w").drop("__l", "__t", "__w", "__h")

    def on_masks(self, df, channels, top):
        return self.on_pixels(df, 1, top)

    def tiles(self, df: DataFrame, left: str, above: str, right: str, below: str) -> DataFrame:
        """Mirror images __j, __i around a sample; where a gate is closed, the sample alone."""
        for name, a, b, side in (("__i", left, right, "w"), ("__j", above, below, "h")):
            df = df.withColumn(name, F.explode(F.expr(or_old(df, f"sequence(-1 - cast(floor({a} / {side}) as int), 1 + cast(floor({b} / {side}) as int))", "array(0)"))))
        return df

    def on_boxes(self, df):
        left, above, right, below = self.widths(df)
        nw, nh = f"(w + {left} + {right})", f"(h + {above} + {below})"
        if self.border == "constant":
            new = {"x_min": f"(x_min * w + {left}) / {nw}", "x_max": f"(x_max * w + {left}) / {nw}", "y_min": f"(y_min * h + {above}) / {nh}", "y_max": f"(y_max * h + {above}) / {nh}"}
            return moved(df, **{k: or_old(df, e, k) for k, e in new.items()}, w=nw, h=nh)
        tiles = self.tiles(df, left, above, right, below)
        lo = {"x": "case when abs(__i) % 2 = 1 then 1e0 - x_max else x_min end", "y": "case when abs(__j) % 2 = 1 then 1e0 - y_max else y_min end"}
        hi = {"x": "case when abs(__i) % 2 = 1 then 1e0 - x_min else x_max end", "y": "case when abs(__j) % 2 = 1 then 1e0 - y_min else y_max end"}
        new = {"x_min": f"((({lo['x']}) + __i) * w + {left}) / {nw}", "x_max": f"((({hi['x']}) + __i) * w + {left}) / {nw}", "y_min": f"((({lo['y']}) + __j) * h + {above}) / {nh}", "y_max": f"((({hi['y']}) + __j) * h + {above}) / {nh}"}
        out = moved(tiles, **{k: or_old(df, e, k) for k, e in new.items()}, w=nw, h=nh)
        return out.where(or_stays(df, "x_max > 0 and x_min < 1 and y_max > 0 and y_min < 1")).drop("__i", "__j")

    def on_keypoints(self, df):
        left, above, right, below = self.widths(df)
        nw, nh = f"(w + {left} + {right})", f"(h + {above} + {below})"
        if self.border == "constant":
            return moved(df, x=f"x + {left}", y=f"y + {above}", w=nw, h=nh)
        tiles = self.tiles(df, left, above, right, below)
        a = f"case when abs(__i) % 2 = 1 and abs(__j) % 2 = 1 then angle + {PI} when abs(__i) % 2 = 1 then {PI} - angle when abs(__j) % 2 = 1 then -angle else angle end"
        out = moved(tiles, x=f"(case when abs(__i) % 2 = 1 then w - x else x end) + __i * w + {left}", y=f"(case when abs(__j) % 2 = 1 then h - y else y end) + __j * h + {above}", angle=or_old(df, angle(a), "angle"), w=nw, h=nh)
        return out.where(or_stays(df, "x >= 0 and x < w and y >= 0 and y < h")).drop("__i", "__j")


@operator
class Pad(Padded):
    padding: tuple | int = 0
    fill: float = 0.0
    border: str = "constant"
    p: float = 1.0

    def sides(self):
        q = self.padding
        q = (q, q, q, q) if isinstance(q, int) else (q[0], q[1], q[0], q[1]) if len(q) == 2 else q
        return tuple(map(str, q))


@operator
class PadIfNeeded(Padded):
    min_height: int | None = 16
    min_width: int | None = 16
    pad_height_divisor: int | None = None
    pad_width_divisor: int | None = None
    position: str = "center"
    fill: float = 0.0
    border: str = "constant"
    p: float = 1.0

    def draws(self, d: Draws):
        return {"u": d.unit("u"), "v": d.unit("v")} if self.position == "random" else {}

    def sides(self):
        def total(side: str, least: int | None, divisor: int | None) -> str:
            return f"greatest(0, {least} - {side})" if divisor is None else f"(({divisor} - {side} % {divisor}) % {divisor})"

        x, y = total("w", self.min_width, self.pad_width_divisor), total("h", self.min_height, self.pad_height_divisor)
        part = {
            "center": (f"cast(floor({x} / 2) as int)", f"cast(floor({y} / 2) as int)"),
            "top_left": ("0", "0"),
            "top_right": (x, "0"),
            "bottom_left": ("0", y),
            "bottom_right": (x, y),
            "random": (f"cast(floor(({x} + 1) * p_u) as int)", f"cast(floor(({y} + 1) * p_v) as int)"),
        }[self.position]
        return part[0], part[1], f"({x} - {part[0]})", f"({y} - {part[1]})"


@operator
class CropAndPad(Padded):
    """Sides in pixels (top, right, bottom, left): negative ones cut, positive ones pad; no resize."""

    px: tuple = (-1, 1, 1, -1)
    fill: float = 0.0
    border: str = "constant"
    p: float = 1.0

    def sides(self):
        above, right, below, left = self.px
        return tuple(str(max(0, s)) for s in (left, above, right, below))

    def out_size(self):
        h, w = self.cut().out_size() if self.cut() else ("h", "w")
        left, above, right, below = self.sides()
        return f"{h} + {above} + {below}", f"{w} + {left} + {right}"

    def cut(self) -> Crop | None:
        above, right, below, left = (max(0, -s) for s in self.px)
        return CutBorders(left, above, right, below) if any((above, right, below, left)) else None

    def on_pixels(self, df, channels, top):
        cut = self.cut()
        return super().on_pixels(cut.on_pixels(df, channels, top) if cut else df, channels, top)

    def on_boxes(self, df):
        cut = self.cut()
        return super().on_boxes(cut.on_boxes(df) if cut else df)

    def on_keypoints(self, df):
        cut = self.cut()
        return super().on_keypoints(cut.on_keypoints(df) if cut else df)


@operator
class CutBorders(Window):
    left: int = 0
    above: int = 0
    right: int = 0
    below: int = 0
    p: float = 1.0

    def bounds(self):
        return str(self.left), str(self.above), f"greatest(w - {self.right}, {self.left} + 1)", f"greatest(h - {self.below}, {self.above} + 1)"


@operator
class RandomGridShuffle(Operator):
    """Cells of a grid trade places with cells of the same size, by a seeded order.

    The table of cells is made from literals, so the order is a rank over constants in the row. A box, in
    whole pixels, is cut at the cells' edges and its pieces move with them; pieces that then touch, at a
    corner too, are one box. Boxes of fewer pixels than min_area, or of a smaller share than
    min_visibility of what the box was, go. New boxes keep the box_ix and label of their box.
    """

    grid: tuple = (2, 2)
    min_area: float = 1.0
    min_visibility: float = 0.0
    p: float = 0.5
    spatial = True
    own = ("boxes",)

    def draws(self, d: Draws):
        n = self.grid[0] * self.grid[1]
        return {f"r{i}": d.unit(f"r{i}") for i in range(n)}

    def edges(self, side: str, parts: int) -> list[str]:
        return [f"cast(floor({side} * {i} / {parts}) as int)" for i in range(parts + 1)]

    def target(self) -> dict[str, str]:
        """Of the cell c: the cell whose rank among its equals is c's place among them."""
        rows, cols = self.grid
        ys, xs = self.edges("h", rows), self.edges("w", cols)
        size = {r * cols + c: f"(({ys[r + 1]} - {ys[r]}) * 100000 + ({xs[c + 1]} - {xs[c]}))" for r in range(rows) for c in range(cols)}
        n = rows * cols
        cell = f"({' + '.join(f'(case when y >= {e} then 1 else 0 end)' for e in ys[1:-1]) or '0'}) * {cols} + ({' + '.join(f'(case when x >= {e} then 1 else 0 end)' for e in xs[1:-1]) or '0'})"
        place = {i: " + ".join(f"(case when {size[j]} = {size[i]} then 1 else 0 end)" for j in range(i)) or "0" for i in range(n)}
        rank = {i: " + ".join(f"(case when {size[j]} = {size[i]} and (p_r{j} < p_r{i} or (p_r{j} = p_r{i} and {j} < {i})) then 1 else 0 end)" for j in range(n) if j != i) or "0" for i in range(n)}
        goes = {i: "case " + " ".join(f"when {size[j]} = {size[i]} and ({rank[j]}) = ({place[i]}) then {j}" for j in range(n)) + " end" for i in range(n)}
        y0 = "case {} " + " ".join(f"when {i} then {ys[i // cols]}" for i in range(n)) + " end"
        x0 = "case {} " + " ".join(f"when {i} then {xs[i % cols]}" for i in range(n)) + " end"
        return {"cell": cell, "to": "case __cell " + " ".join(f"when {i} then {g}" for i, g in goes.items()) + " end", "y0": y0, "x0": x0}

    def on_pixels(self, df, channels, top):
        t = self.target()
        df = df.withColumn("__cell", F.expr(t["cell"])).withColumn("__to", F.expr(t["to"]))
        new = {a: f"{a} - ({t[a + '0'].format('__cell')}) + ({t[a + '0'].format('__to')})" for a in "yx"}
        return moved(df, **new).drop("__cell", "__to")

    def on_keypoints(self, df):
        return self.on_pixels(df, 0, 0)

    def on_boxes(self, df):
        rows, cols = self.grid
        n, t = rows * cols, self.target()
        ys, xs = self.edges("h", rows), self.edges("w", cols)
        df = df.withColumns({f"__{a}{k}": F.expr(f"cast(floor({a}_{m} * {side}) as int)") for a, side in (("x", "w"), ("y", "h")) for k, m in enumerate(("min", "max"))})
        to = F.expr(f"transform(sequence(0, {n - 1}), __cell -> {t['to']})")
        df = df.withColumn("__to", to)
        pieces = []
        for i in range(n):
            left, right = f"greatest(__x0, {xs[i % cols]})", f"least(__x1, {xs[i % cols + 1]})"
            above, below = f"greatest(__y0, {ys[i // cols]})", f"least(__y1, {ys[i // cols + 1]})"
            dx, dy = (f"(({t[a + '0'].format(f'__to[{i}]')}) - {e})" for a, e in (("x", xs[i % cols]), ("y", ys[i // cols])))
            pieces.append(f"named_struct('x0', {left} + {dx}, 'y0', {above} + {dy}, 'x1', {right} + {dx}, 'y1', {below} + {dy})")
        df = df.withColumn("__p", F.expr(f"filter(array({', '.join(pieces)}), o -> o.x1 > o.x0 and o.y1 > o.y0)"))
        touch = "__p[i].x0 <= __p[j].x1 and __p[j].x0 <= __p[i].x1 and __p[i].y0 <= __p[j].y1 and __p[j].y0 <= __p[i].y1"
        each = "sequence(0, size(__p) - 1)"
        # every piece takes the least number that it touches, as often as there are pieces
        labels = f"aggregate({each}, {each}, (l, step) -> transform({each}, i -> array_min(transform(filter({each}, j -> {touch}), j -> l[j]))))"
        df = df.withColumn("__l", F.expr(f"case when size(__p) > 0 then {labels} else array() end"))
        of = "filter(transform(__p, (o, i) -> named_struct('o', o, 'l', __l[i])), u -> u.l = g)"
        ends = ", ".join(f"'{a}_{m}', array_{m}(transform({of}, u -> u.o.{a}{k})) / (1e0 * {side})" for k, m in enumerate(("min", "max")) for a, side in (("x", "w"), ("y", "h")))
        area = f"aggregate(transform({of}, u -> (u.o.x1 - u.o.x0) * (u.o.y1 - u.o.y0)), 0, (s, v) -> s + v)"
        made = f"filter(transform(array_distinct(__l), g -> named_struct({ends}, 'area', {area})), m -> m.area >= {num(self.min_area)} and m.area >= {num(self.min_visibility)} * (__x1 - __x0) * (__y1 - __y0))"
        kept = "array(named_struct('x_min', x_min, 'y_min', y_min, 'x_max', x_max, 'y_max', y_max, 'area', 0))"
        out = df.withColumn("__b", F.explode(F.expr(or_old(df, made, kept)))).drop("__p", "__l", "__to", "__x0", "__x1", "__y0", "__y1")
        return moved(out, **{f"{a}_{m}": f"__b.{a}_{m}" for a in "xy" for m in ("min", "max")}).drop("__b")
