"""Operators on several samples: overlays and mosaics, as equi-joins on the sample."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlane.functions.sampling import Draws, num

from .base import Frame, Operator, operator, values
from .geometry import moved


@operator
class OverlayElements(Operator):
    """Pastes overlays: pixels sample_id, ord, oh, ow, y, x, v0 ..., optional shown (boolean), and
    optional bx, by (the corner where the overlay goes; else it is drawn). Higher ord lies on top."""

    overlays: DataFrame | None = None
    p: float = 0.5

    def run(self, frame, seed=0, path="0", forced=False, params=None, when=None):
        d = Draws(seed, f"{path}.{self.name}")
        names = values(frame.channels)
        sizes = frame.pixels.select("sample_id", "h", "w").distinct()
        o = self.overlays.join(sizes, "sample_id")
        if "shown" in o.columns:
            o = o.where("shown")
        if params is not None:
            o = o.join(params.rows.where(F.expr(f"{params.column}.applied")).select("sample_id"), "sample_id", "left_semi")
        elif (gate := self.gate(d, forced, when)) is not None:
            o = o.where(F.expr(gate))
        x0 = "bx" if "bx" in o.columns else d.integer("x", 0, "greatest(0, w - ow)", "ord")
        y0 = "by" if "by" in o.columns else d.integer("y", 0, "greatest(0, h - oh)", "ord")
        placed = o.select("sample_id", F.expr(f"cast(y + {y0} as int)").alias("y"), F.expr(f"cast(x + {x0} as int)").alias("x"), "ord", F.struct(*names).alias("px"))
        best = placed.groupBy("sample_id", "y", "x").agg(F.max_by("px", "ord").alias("__top"))
        out = frame.pixels.join(best, ["sample_id", "y", "x"], "left")
        out = out.withColumns({v: F.coalesce(F.col(f"__top.{v}"), F.col(v)) for v in names}).select(*frame.pixels.columns)
        return replace(frame, pixels=out)


@operator
class Mosaic(Operator):
    """A canvas of rows x cols cells around a drawn centre; the sample fills the largest cell, items
    the others. Each part is scaled to cover its cell (nearest) and cut at its corner.

    items: a frame whose pixels (and boxes, keypoints) carry item_ix; items of a sample are drawn in
    a seeded order, and the sample itself stands in where there are too few.
    """

    items: Frame | None = None
    grid_yx: tuple = (2, 2)
    target_size: tuple = (8, 8)
    center_range: tuple = (0.3, 0.7)
    p: float = 0.5

    def out_size(self):
        return tuple(map(str, self.target_size))

    def lines(self, d: Draws) -> dict[str, list[str]]:
        """Cell edges on the canvas, per axis: the middle line is the drawn centre."""
        out = {}
        for a, n, size in (("y", self.grid_yx[0], self.target_size[0]), ("x", self.grid_yx[1], self.target_size[1])):
            centre = f"cast(floor({d.between(f'c{a}', *self.center_range)} * {size}) as int)"
            out[a] = ["0"] + [f"greatest(0, least({size}, {centre} + {(k - n / 2) * size / max(1, n):.0f}))" if k != n / 2 else centre for k in range(1, n)] + [str(size)]
        return out

    def cells(self, samples: DataFrame, d: Draws) -> DataFrame:
        """sample_id, cell (0 for the largest), y0, x0, y1, x1."""
        lines = self.lines(d)
        rows, cols = self.grid_yx
        every = ", ".join(f"named_struct('area', -(({lines['y'][r + 1]}) - ({lines['y'][r]})) * (({lines['x'][c + 1]}) - ({lines['x'][c]})), 'n', {r * cols + c}, 'y0', {lines['y'][r]}, 'x0', {lines['x'][c]}, 'y1', {lines['y'][r + 1]}, 'x1', {lines['x'][c + 1]})" for r in range(rows) for c in range(cols))
        cells = samples.select("sample_id", F.posexplode(F.expr(f"array_sort(filter(array({every}), c -> c.area < 0))")).alias("cell", "c"))
        return cells.select("sample_id", "cell", "c.y0", "c.x0", "c.y1", "c.x1")

    def run(self, frame, seed=0, path="0", forced=False, params=None, when=None):
        d = Draws(seed, f"{path}.{self.name}")
        names = values(frame.channels)
        gate = self.gate(d, forced, when) or "true"
        if params is not None:  # recorded gates, as a column of every relation
            frame = frame.each(lambda df, n: df.withColumn("__applied", F.expr(f"coalesce({params.column}.applied, false)")))
            gate = "__applied"
        samples = frame.pixels.where(gate).select("sample_id", "h", "w").distinct()
        cells = self.cells(samples, d)
        order = F.expr(d.unit("item", "item_ix"))
        kinds = self.items.pixels.select("sample_id", "item_ix").distinct()
        from pyspark.sql import Window

        ranked = kinds.withColumn("cell", F.row_number().over(Window.partitionBy("sample_id").orderBy(order, "item_ix")))
        cells = cells.join(ranked, ["sample_id", "cell"], "left").withColumn("item_ix", F.coalesce("item_ix", F.lit(-1)))
        th, tw = self.target_size

        def source(own: DataFrame, theirs: DataFrame) -> DataFrame:
            own = own.drop("__applied")
            return own.withColumn("item_ix", F.lit(-1)).unionByName(theirs.select(*own.columns, F.col("item_ix").cast("int").alias("item_ix")))

        def beside(made: DataFrame, old: DataFrame) -> DataFrame:
            """With the rows of samples that have no mosaic."""
            made = made.select(*[c for c in old.columns if c != "__applied"])
            return made if gate == "true" else made.unionByName(old.where(f"not ({gate})").drop("__applied"))

        px = source(frame.pixels, self.items.pixels).join(cells, ["sample_id", "item_ix"])
        ch, cw = "(y1 - y0)", "(x1 - x0)"
        f = f"greatest({ch} / (1e0 * h), {cw} / (1e0 * w))"
        sh, sw = f"cast(ceil(h * {f}) as int)", f"cast(ceil(w * {f}) as int)"
        # nearest: the targets t with floor(t * side / scaled) = source, within the cell
        span = lambda v, side, scaled, size: f"filter(sequence(cast(floor({v} * {scaled} / (1e0 * {side})) as int), cast(ceil(({v} + 1) * {scaled} / (1e0 * {side})) as int)), t -> cast(floor(t * {side} / (1e0 * {scaled})) as int) = {v} and t < {size})"
        px = px.withColumn("ty", F.explode(F.expr(span("y", "h", sh, ch)))).withColumn("tx", F.explode(F.expr(span("x", "w", sw, cw))))
        made = px.select("sample_id", F.lit(th).alias("h"), F.lit(tw).alias("w"), F.expr("cast(y0 + ty as int)").alias("y"), F.expr("cast(x0 + tx as int)").alias("x"), *names)
        new = {"pixels": beside(made, frame.pixels.select(*made.columns, *[c for c in frame.pixels.columns if c == "__applied"]))}
        if frame.boxes is not None and self.items.boxes is not None:
            b = source(frame.boxes, self.items.boxes).join(cells, ["sample_id", "item_ix"])
            b = moved(b, x_min=f"(least(x1, x0 + x_min * {sw})) / {tw}e0", x_max=f"(least(x1, x0 + x_max * {sw})) / {tw}e0", y_min=f"(least(y1, y0 + y_min * {sh})) / {th}e0", y_max=f"(least(y1, y0 + y_max * {sh})) / {th}e0", h=str(th), w=str(tw))
            new["boxes"] = beside(b.where("x_max > x_min and y_max > y_min"), frame.boxes)
        if frame.keypoints is not None and self.items.keypoints is not None:
            k = source(frame.keypoints, self.items.keypoints).join(cells, ["sample_id", "item_ix"])
            k = moved(k, x=f"x0 + x * {sw} / w", y=f"y0 + y * {sh} / h", scale=f"scale * {f}", h=str(th), w=str(tw)).where("x < x1 and y < y1")
            new["keypoints"] = beside(k, frame.keypoints)
        return replace(frame, **new).each(lambda df, n: df.drop("__applied"))
