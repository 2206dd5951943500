"""Holes: rectangles from the draws, tested in the pixel's own row; objects from masks by joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlane.functions.sampling import STEPS, Draws, mixed, num

from .base import Operator, operator, or_old, or_stays, values
from .geometry import moved

#: With up to so many holes boxes are cut by plain expressions, whose number grows with the square; with more by arrays.
FEW = 4


def apart(condition: str) -> str:
    """The condition as a lambda's result. Spark compiles a projection that has a lambda by itself, in methods of
    a fit size; others become one method with what is around them, and the JVM compiles none beyond 8000 bytes."""
    return f"exists(array({condition}), c -> c)"


class Holes(Operator):
    """holes(): SQL of (x0, y0, x1, y1, exists) for each hole. Pixels inside are filled; keypoints
    inside go; boxes shrink to their visible part or go where too little is left."""

    fill = 0.0
    fill_mask = None
    min_visibility = 0.0
    own = ("boxes", "keypoints")
    unconditional = True

    def holes(self) -> list[tuple[str, str, str, str, str]]:
        raise NotImplementedError

    def inside(self, y: str = "y", x: str = "x") -> str:
        tests = [f"(({e}) and {x} >= {x0} and {x} < {x1} and {y} >= {y0} and {y} < {y1})" for x0, y0, x1, y1, e in self.holes()]
        return "(" + (" or ".join(tests) or "false") + ")"

    def every_draw(self, d: Draws):
        """With fill "random": a number of the sample, from which its pixels' values follow."""
        return self.draws(d) | ({"fill": f"cast(floor({d.unit('fill')} * 1e9) as bigint)"} if self.fill == "random" else {})

    def filled(self, v: str, i: int, top: float) -> str:
        if self.fill == "random":
            return f"floor({mixed(f'(p_fill + y * 65537 + x)', 31 + i)} / {STEPS[-1][1]}e0 * {num(top + (top == 255))})"
        return num(self.fill)

    def on_pixels(self, df, channels, top):
        return df.withColumn("__in", F.expr(self.inside())).withColumns({v: F.expr(f"case when __in then {self.filled(v, i, top)} else {v} end") for i, v in enumerate(values(channels))}).drop("__in")

    def on_masks(self, df, channels, top):
        return df if self.fill_mask is None else df.withColumn("v0", F.expr(f"case when {self.inside()} then {num(self.fill_mask)} else v0 end"))

    def on_keypoints(self, df):
        return df.where(or_stays(df, f"not {self.inside()}"))

    def cuts(self) -> tuple[list[str], list[str]] | None:
        """Coordinates where holes begin and end, across and down; None: any pixel may differ."""
        found = self.holes()
        return [e for h in found for e in (h[0], h[2])], [e for h in found for e in (h[1], h[3])]

    def on_boxes(self, df):
        """Boxes end where their last visible column or row does."""
        columns, types = df.columns, dict(df.dtypes)
        size = {"__x0": "cast(floor(x_min * w) as int)", "__y0": "cast(floor(y_min * h) as int)", "__x1": "cast(ceil(x_max * w) as int)", "__y1": "cast(ceil(y_max * h) as int)"}
        df = df.withColumns({k: F.expr(v) for k, v in size.items()})
        few = self.cuts() is not None and 0 < len(self.holes()) <= FEW and not self.min_visibility
        df, keep, hidden, ends = self.by_edges(df) if few else self.by_cells(df)
        new = {c: or_old(df, f"case when {hidden} then {ends[c]} / (1e0 * {side}) else {c} end", c) for c, side in (("x_min", "w"), ("y_min", "h"), ("x_max", "w"), ("y_max", "h"))}
        row = ", ".join(f"'__{c}', cast({e} as {types[c]})" for c, e in new.items())
        # not where(): the optimizer would copy all that keep is made of into a filter below, once for each place that names it
        df = df.select("*", F.expr(f"inline(case when {or_stays(df, keep)} then array(named_struct({row})) end)"))
        return df.select(*[F.col(f"__{c}").alias(c) if c in new else F.col(c) for c in columns])

    def by_edges(self, df):
        """df with a box's visible columns and rows, and SQL: whether any is, whether any pixel is hidden, the ends.

        The first visible column begins where the box or a hole's right edge does, and so do rows: the
        first of each lie on crossings of these, the last on crossings of the other edges. A column and a
        row each have a number with a bit for every hole that they go through; a crossing is hidden where
        both have the same bit. All of it is plain arithmetic in the row.
        """
        holes = self.holes()
        n = range(len(holes))
        at = {f"__{a}{i}": f"__{a}{i}" for a in "xy" for i in "01"}
        for k, (x0, y0, x1, y1, e) in enumerate(holes):
            within = {f"__x0{k}": ("x", x0), f"__x1{k}": ("x", x1), f"__y0{k}": ("y", y0), f"__y1{k}": ("y", y1)}
            at |= {c: f"case when {e} then cast(least(__{a}1, greatest(__{a}0, {v})) as int) else __{a}0 end" for c, (a, v) in within.items()}
        box = " and ".join(["__x1 > __x0 and __y1 > __y0", *[f"({h[4]}) is not null" for h in holes]])
        df = df.withColumns({k: F.expr(f"coalesce({v}, 0)") for k, v in at.items()} | {"__box": F.expr(apart(box))})
        hidden = " or ".join(f"(__x1{k} > __x0{k} and __y1{k} > __y0{k})" for k in n)
        # the box's own edge first; one bit more for places outside the box, which never counts as seen
        places = {f"{a}{i}": [f"__{a}{i}" + (" - 1" if i else ""), *[f"__{a}{1 - i}{k}" + (" - 1" if i else "") for k in n]] for a in "xy" for i in (0, 1)}
        through = {}
        for name, found in places.items():
            a, (one, two) = name[0], (1 << len(n), 2 << len(n)) if name[0] == "x" else (2 << len(n), 1 << len(n))
            for j, c in enumerate(found):
                bits = [f"case when {c} >= __{a}0{k} and {c} < __{a}1{k} then {1 << k} else 0 end" for k in n]
                through[f"__{name}_{j}"] = " | ".join([f"case when {c} >= __{a}0 and {c} < __{a}1 then {one} else {one + two} end", *bits])
        df = df.withColumns({k: F.expr(v) for k, v in (through | {"__hidden": apart(hidden)}).items()})
        ends = {}
        for a, other in ("xy", "yx"):
            for i, pick in ((0, "least"), (1, "greatest")):
                seen = [" or ".join(f"(__{a}{i}_{j} & __{other}{i}_{m}) = 0" for m in range(len(n) + 1)) for j in range(len(n) + 1)]
                ends[f"__{a}_{i}"] = f"{pick}({', '.join(f'case when {s} then {c} end' for s, c in zip(seen, places[f'{a}{i}']))})" + (" + 1" if i else "")
        df = df.withColumns({k: F.expr(v) for k, v in ends.items()})
        return df, "__box and __x_0 is not null", "__hidden", {"x_min": "__x_0", "y_min": "__y_0", "x_max": "__x_1", "y_max": "__y_1"}

    def by_cells(self, df):
        """The same for any number of holes: their edges cut a box into cells that are wholly seen or
        wholly hidden, so a box costs as many cells as holes, not pixels."""
        cuts, df = self.cuts(), df.where(or_stays(df, "__x1 > __x0 and __y1 > __y0"))
        for a, at in zip("xy", cuts or (None, None)):
            inner = or_old(df, f"sequence(__{a}0, __{a}1)", f"array(__{a}0, __{a}1)") if at is None else f"array(__{a}0, __{a}1, {', '.join(f'cast(least(__{a}1, greatest(__{a}0, coalesce({e}, __{a}0))) as int)' for e in at)})"
            df = df.withColumn(f"__c{a}", F.array_sort(F.array_distinct(F.expr(inner))))
        cells = "flatten(transform(slice(sequence(0, size(__cy)), 1, size(__cy) - 1), i -> transform(slice(sequence(0, size(__cx)), 1, size(__cx) - 1), j -> named_struct('y', __cy[i], 'yy', __cy[i + 1], 'x', __cx[j], 'xx', __cx[j + 1]))))"
        df = df.withColumn("__seen", F.expr(f"filter({cells}, c -> not {self.inside('c.y', 'c.x')})"))
        df = df.withColumn("__left", F.expr("aggregate(__seen, 0, (s, c) -> s + (c.yy - c.y) * (c.xx - c.x))"))
        area = "(__x1 - __x0) * (__y1 - __y0)"
        ends = {"x_min": "array_min(transform(__seen, c -> c.x))", "x_max": "array_max(transform(__seen, c -> c.xx))", "y_min": "array_min(transform(__seen, c -> c.y))", "y_max": "array_max(transform(__seen, c -> c.yy))"}
        return df, f"__left > 0 and __left >= {num(self.min_visibility)} * {area}", f"__left < {area}", ends


def extent(d: Draws, name: str, limits: tuple, side: str) -> str:
    """A size in pixels: whole numbers as they are, else a share of the side."""
    if limits[1] >= 1:
        return f"least({side}, {d.integer(name, int(limits[0]), int(limits[1]))})"
    return f"cast(floor({side} * {d.between(name, *limits)}) as int)"


@operator
class CoarseDropout(Holes):
    num_holes_range: tuple = (1, 2)
    hole_height_range: tuple = (0.1, 0.2)
    hole_width_range: tuple = (0.1, 0.2)
    fill: float | str = 0.0
    fill_mask: float | None = None
    p: float = 0.5

    def draws(self, d: Draws):
        out = {"n": d.integer("n", *self.num_holes_range)}
        for k in range(self.num_holes_range[1]):
            hh, hw = extent(d, f"hh{k}", self.hole_height_range, "h"), extent(d, f"hw{k}", self.hole_width_range, "w")
            y0, x0 = f"cast(floor((h - {hh} + 1) * {d.unit(f'y{k}')}) as int)", f"cast(floor((w - {hw} + 1) * {d.unit(f'x{k}')}) as int)"
            out |= {f"y{k}": y0, f"x{k}": x0, f"yy{k}": f"({y0} + {hh})", f"xx{k}": f"({x0} + {hw})"}
        return out

    def holes(self):
        return [(f"p_x{k}", f"p_y{k}", f"p_xx{k}", f"p_yy{k}", f"p_n > {k}") for k in range(self.num_holes_range[1])]


@operator
class Erasing(Holes):
    """One rectangle of a share of the area; nothing where the aspect cannot fit."""

    scale: tuple = (0.02, 0.33)
    ratio: tuple = (0.3, 3.3)
    fill: float | str = 0.0
    fill_mask: float | None = None
    p: float = 0.5

    def draws(self, d: Draws):
        area, aspect = f"({d.between('area', *self.scale)} * h * w)", d.between("ratio", *self.ratio)
        hh, hw = f"cast(floor(sqrt({area} / {aspect}) + 0.5e0) as int)", f"cast(floor(sqrt({area} * {aspect}) + 0.5e0) as int)"
        y0, x0 = f"cast(floor((h - {hh} + 1) * {d.unit('y')}) as int)", f"cast(floor((w - {hw} + 1) * {d.unit('x')}) as int)"
        return {"y0": y0, "x0": x0, "y1": f"({y0} + {hh})", "x1": f"({x0} + {hw})", "ok": f"({hh} between 1 and h and {hw} between 1 and w)"}

    def holes(self):
        return [("p_x0", "p_y0", "p_x1", "p_y1", "p_ok")]


@operator
class GridDropout(Holes):
    ratio: float = 0.5
    unit: int = 4
    shift_xy: tuple = (0, 0)
    random_offset: bool = True
    fill: float | str = 0.0
    fill_mask: float | None = None
    p: float = 0.5

    def draws(self, d: Draws):
        hole = max(1, min(self.unit - 1, int(self.unit * self.ratio)))
        if self.random_offset:
            return {"dx": d.integer("dx", 0, self.unit - hole), "dy": d.integer("dy", 0, self.unit - hole)}
        return {"dx": str(self.shift_xy[0]), "dy": str(self.shift_xy[1])}

    def cuts(self):
        return None

    def inside(self, y="y", x="x"):
        hole, u = max(1, min(self.unit - 1, int(self.unit * self.ratio))), self.unit
        return f"((cast(floor({x}) as int) - p_dx + {u}) % {u} < {hole} and (cast(floor({y}) as int) - p_dy + {u}) % {u} < {hole})"


@operator
class XYMasking(Holes):
    num_masks_x: int = 1
    num_masks_y: int = 1
    mask_x_length: tuple = (1, 2)
    mask_y_length: tuple = (1, 2)
    fill: float | str = 0.0
    fill_mask: float | None = None
    p: float = 0.5

    def draws(self, d: Draws):
        out = {}
        for a, side, n, length in (("x", "w", self.num_masks_x, self.mask_x_length), ("y", "h", self.num_masks_y, self.mask_y_length)):
            for k in range(n):
                size = f"least({side}, {d.integer(f'l{a}{k}', *length)})"
                start = f"cast(floor(({side} - {size} + 1) * {d.unit(f'{a}{k}')}) as int)"
                out |= {f"{a}{k}": start, f"{a}{a}{k}": f"({start} + {size})"}
        return out

    def holes(self):
        return [(f"p_x{k}", "0", f"p_xx{k}", "h", "true") for k in range(self.num_masks_x)] + [("0", f"p_y{k}", "w", f"p_yy{k}", "true") for k in range(self.num_masks_y)]


@operator
class TimeMasking(Holes):
    time_mask_param: int = 40
    fill: float | str = 0.0
    p: float = 0.5

    def draws(self, d: Draws):
        return XYMasking(num_masks_x=1, num_masks_y=0, mask_x_length=(0, self.time_mask_param)).draws(d)

    def holes(self):
        return [("p_x0", "0", "p_xx0", "h", "true")]


@operator
class FrequencyMasking(Holes):
    freq_mask_param: int = 30
    fill: float | str = 0.0
    p: float = 0.5

    def draws(self, d: Draws):
        return XYMasking(num_masks_x=0, num_masks_y=1, mask_y_length=(0, self.freq_mask_param)).draws(d)

    def holes(self):
        return [("0", "p_y0", "w", "p_yy0", "true")]


@operator
class PixelDropout(Operator):
    dropout_prob: float = 0.01
    per_channel: bool = False
    drop_value: float | None = 0.0
    mask_drop_value: float | None = None
    p: float = 0.5
    own = ("keypoints",)

    def draws(self, d: Draws):
        out = {f"u{i}": d.unit(f"u{i}" if self.per_channel else "u", "cast(floor(y) as int) * 65537 + cast(floor(x) as int)") for i in range(4)}
        return out | ({"r": d.unit("r", "y * 65537 + x")} if self.drop_value is None else {})

    def on_pixels(self, df, channels, top):
        new = f"floor(p_r * {num(top + (top == 255))})" if self.drop_value is None else num(self.drop_value)
        return df.withColumns({v: F.expr(f"case when p_u{i % 4} < {num(self.dropout_prob)} then {new} else {v} end") for i, v in enumerate(values(channels))})

    def on_masks(self, df, channels, top):
        return df if self.mask_drop_value is None else df.withColumn("v0", F.expr(f"case when p_u0 < {num(self.dropout_prob)} then {num(self.mask_drop_value)} else v0 end"))

    def on_keypoints(self, df):
        return df.where(or_stays(df, f"p_u0 >= {num(self.dropout_prob)}"))


@operator
class SaltAndPepper(Operator):
    """A share of each sample's pixels, without replacement: the first by a seeded order."""

    amount: tuple = (0.01, 0.06)
    salt_vs_pepper: tuple = (0.4, 0.6)
    p: float = 0.5

    def draws(self, d: Draws):
        return {"amount": d.between("amount", *self.amount), "salt": d.between("salt", *self.salt_vs_pepper), "u": d.unit("u", "y * 65537 + x")}

    def on_pixels(self, df, channels, top):
        from pyspark.sql import Window

        df = df.withColumn("__n", F.row_number().over(Window.partitionBy("sample_id").orderBy("p_u", "y", "x")))
        hit, salt = "__n <= cast(floor(p_amount * h * w) as int)", "__n <= cast(floor(floor(p_amount * h * w) * p_salt) as int)"
        return df.withColumns({v: F.expr(f"case when {hit} then (case when {salt} then {num(top)} else 0e0 end) else {v} end") for v in values(channels)}).drop("__n")


def objects(masks: DataFrame) -> DataFrame:
    """mask pixels with object: 8-connected regions of equal value, named by their smallest pixel.

    A sample's mask is gathered into one row, and a batch of masks is labelled in a task by rounds of
    the smallest name among neighbours.
    """
    # a sample is one row: the rounds run over its arrays, batch by batch
    from .gather import grouped

    @F.pandas_udf("array<int>")
    def label(a: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for x, hh, ww in zip(a, h, w):
            m = np.reshape(x, (hh, ww))
            name = np.where(m != 0, np.arange(hh * ww).reshape(hh, ww), -1)
            while True:
                new = name.copy()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        ys, yt = slice(max(0, dy), hh + min(0, dy)), slice(max(0, -dy), hh + min(0, -dy))
                        xs, xt = slice(max(0, dx), ww + min(0, dx)), slice(max(0, -dx), ww + min(0, -dx))
                        same = (m[ys, xs] == m[yt, xt]) & (m[yt, xt] != 0)
                        new[yt, xt] = np.where(same, np.minimum(new[yt, xt], name[ys, xs]), new[yt, xt])
                if (new == name).all():
                    break
                name = np.where(new >= 0, new.ravel()[np.maximum(new, 0)], -1)
            out.append(name.ravel().tolist())
        return pd.Series(out)

    rows = grouped(masks.select("sample_id", "h", "w", "y", "x", "v0"), 1).withColumn("o", label("a0", "h", "w"))
    return rows.select("sample_id", "h", "w", F.posexplode("o").alias("i", "object")).selectExpr("sample_id", "h", "w", "cast(floor(i / w) as int) as y", "i % w as x", "object").where("object >= 0")


@operator
class MaskDropout(Operator):
    """Drops drawn objects of the mask from pixels and mask, keypoints on them, and boxes whose
    visible share falls too low. objects: from objects()."""

    objects: DataFrame | None = None
    max_objects: tuple = (1, 1)
    fill: float = 0.0
    fill_mask: float = 0.0
    min_visibility: float = 0.0
    p: float = 0.5

    def chosen(self, d: Draws) -> DataFrame:
        from pyspark.sql import Window

        kinds = self.objects.select("sample_id", "object").distinct()
        order = F.expr(d.unit("pick", "object"))
        ranked = kinds.withColumn("n", F.row_number().over(Window.partitionBy("sample_id").orderBy(order, "object")))
        return self.objects.join(ranked.where(F.expr(f"n <= {d.integer('n', *self.max_objects)}")).select("sample_id", "object"), ["sample_id", "object"], "left_semi").select("sample_id", "y", "x")

    def run(self, frame, seed=0, path="0", forced=False, params=None, when=None):
        from dataclasses import replace

        d = Draws(seed, f"{path}.{self.name}")
        gone = self.chosen(d).withColumn("__gone", F.lit(True))
        if params is not None:
            gone = gone.join(params.rows.where(F.expr(f"{params.column}.applied")).select("sample_id"), "sample_id", "left_semi")
        elif (gate := self.gate(d, forced, when)) is not None:
            gone = gone.where(F.expr(gate))

        def hide(df: DataFrame, names: list[str], fill: float) -> DataFrame:
            out = df.join(gone, ["sample_id", "y", "x"], "left").withColumns({v: F.when(F.col("__gone"), F.lit(float(fill))).otherwise(F.col(v)) for v in names})
            return out.select(*df.columns)

        new = {"pixels": hide(frame.pixels, values(frame.channels), self.fill)}
        if frame.masks is not None:
            new["masks"] = hide(frame.masks, ["v0"], self.fill_mask)
        if frame.keypoints is not None:
            k = frame.keypoints.withColumns({"__ky": F.floor("y").cast("int"), "__kx": F.floor("x").cast("int")})
            g = gone.selectExpr("sample_id", "y as __ky", "x as __kx")
            new["keypoints"] = k.join(g, ["sample_id", "__ky", "__kx"], "left_anti").select(*frame.keypoints.columns)
        if frame.boxes is not None:
            b = frame.boxes.join(gone.selectExpr("sample_id", "y as gy", "x as gx"), "sample_id", "left")
            hit = F.sum(F.expr("case when gx >= x_min * w and gx <= x_max * w and gy >= y_min * h and gy <= y_max * h then 1 else 0 end"))
            left = b.groupBy(*frame.boxes.columns).agg(hit.alias("hit"))
            new["boxes"] = left.where(f"hit = 0 or 1e0 - hit / ((x_max - x_min) * w * (y_max - y_min) * h) > {num(self.min_visibility)}").select(*frame.boxes.columns)
        return replace(frame, **new)


@operator
class ConstrainedCoarseDropout(Holes):
    """Holes inside boxes of some labels: one drawn box per hole from the array column targets
    (structs x_min, y_min, x_max, y_max, normalised), sized as shares of the box."""

    num_holes_range: tuple = (1, 1)
    hole_height_range: tuple = (0.1, 0.1)
    hole_width_range: tuple = (0.1, 0.1)
    fill: float | str = 0.0
    fill_mask: float | None = None
    p: float = 0.5

    def draws(self, d: Draws):
        out = {"n": d.integer("n", *self.num_holes_range)}
        for k in range(self.num_holes_range[1]):
            b = f"get(targets, cast(floor(size(targets) * {d.unit(f'b{k}')}) as int))"
            bw, bh = f"(({b}.x_max - {b}.x_min) * w)", f"(({b}.y_max - {b}.y_min) * h)"
            hw, hh = f"floor({bw} * {d.between(f'hw{k}', *self.hole_width_range)})", f"floor({bh} * {d.between(f'hh{k}', *self.hole_height_range)})"
            x0, y0 = f"floor({b}.x_min * w + ({bw} - {hw}) * {d.unit(f'x{k}')})", f"floor({b}.y_min * h + ({bh} - {hh}) * {d.unit(f'y{k}')})"
            out |= {f"x{k}": x0, f"y{k}": y0, f"xx{k}": f"({x0} + {hw})", f"yy{k}": f"({y0} + {hh})"}
        return out

    def holes(self):
        return [(f"p_x{k}", f"p_y{k}", f"p_xx{k}", f"p_yy{k}", f"p_n > {k} and size(targets) > 0") for k in range(self.num_holes_range[1])]


def dropout_targets(boxes: DataFrame, labels: tuple) -> DataFrame:
    """(sample_id, targets) for ConstrainedCoarseDropout: the boxes with one of the labels."""
    rows = boxes.where(F.col("label").isin(*labels))
    return rows.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("x_min", "y_min", "x_max", "y_max"))).alias("targets"))
