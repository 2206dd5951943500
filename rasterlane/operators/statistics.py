"""Operators that need a statistic of the whole sample: histograms, moments, principal axes.

Statistics are aggregations by sample (and channel and value), at most 256 rows per channel, joined
back on the sample and value.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlane.functions import colour
from rasterlane.functions.sampling import Draws, num

from .base import Operator, clipped, operator, or_old, values
from .pointwise import into_space, out_of_space, recoloured, scaled


def histogram(df: DataFrame, channel: str, where: str | None = None) -> DataFrame:
    """(sample_id, v, n)."""
    rows = df.where(where) if where else df
    return rows.groupBy("sample_id", F.floor(channel).cast("int").alias("v")).agg(F.count("*").alias("n"))


def cumulative(hist: DataFrame, *keys: str) -> DataFrame:
    """With cum (up to v), before, total, first (count of the lowest value) and last, by sample and keys."""
    all_ = Window.partitionBy("sample_id", *keys)
    up = all_.orderBy("v")
    out = hist.withColumns({"cum": F.sum("n").over(up), "total": F.sum("n").over(all_), "low": F.min("v").over(all_), "high": F.max("v").over(all_)})
    return out.withColumns({"first": F.max(F.expr("case when v = low then n end")).over(all_), "last": F.max(F.expr("case when v = high then n end")).over(all_)})


def through(df: DataFrame, channel: str, table: DataFrame) -> DataFrame:
    """Values of a channel replaced by table (sample_id, v, new)."""
    t = table.select("sample_id", F.col("v").alias("__v"), F.col("new").cast("double").alias("__new"))
    out = df.withColumn("__v", F.floor(channel).cast("int")).join(t, ["sample_id", "__v"], "left")
    return out.withColumn(channel, F.coalesce("__new", channel)).drop("__v", "__new")


def by_tables(df: DataFrame, names: list[str], where: str | None, table) -> DataFrame:
    """Values of all named columns replaced at once: one histogram of (sample, column, value), one
    table of 256 entries for each sample and column, one join on the sample.

    table: of a histogram (sample_id, ch, v, n) its new values (sample_id, ch, v, new), by windows on
    sample and ch. Samples without an id or a table stay as they are.
    """
    rows = df.where(where) if where else df
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("ch"), F.floor(v).cast("int").alias("v")) for i, v in enumerate(names)]))
    hist = rows.select("sample_id", each.alias("c")).groupBy("sample_id", "c.ch", "c.v").agg(F.count("*").alias("n")).repartition("sample_id")
    entries = F.map_from_entries(F.collect_list(F.struct("v", F.col("new").cast("double").alias("new"))))
    lists = table(hist).where("v between 0 and 255").groupBy("sample_id", "ch").agg(entries.alias("m")).withColumn("t", F.expr("transform(sequence(0, 255), i -> m[i])"))
    tables = lists.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("ch", "t"))).alias("__t"))
    out = df.join(tables, "sample_id", "left")
    return out.withColumns({v: F.expr(f"coalesce(get(__t[{i}], cast(floor({v}) as int)), {v})") for i, v in enumerate(names)}).drop("__t")


@operator
class Equalize(Operator):
    """Histogram equalisation, by channel or of lightness alone, optionally counting only pixels
    where a SQL condition holds."""

    mode: str = "cv"
    by_channels: bool = True
    mask: str | None = None
    p: float = 0.5

    def table(self, hist: DataFrame) -> DataFrame:
        c = cumulative(hist, "ch")
        if self.mode == "cv":
            new = "case when total = first then v else greatest(0e0, rint((cum - first) * (255e0 / (total - first)))) end"
        else:
            step = "floor((total - last) / 255e0)"
            new = f"case when {step} = 0 or low = high then v else least(255e0, floor((cum - n + floor({step} / 2)) / {step})) end"
        return c.withColumn("new", F.expr(f"cast({new} as double)"))

    def on_pixels(self, df, channels, top):
        if self.by_channels:
            return by_tables(df, values(channels), self.mask, self.table)
        df = df.withColumn("__y", F.expr(f"floor({colour.luma('v0', 'v1', 'v2')} + 0.5e0)")).withColumn("__o", F.col("__y"))
        df = by_tables(df, ["__y"], self.mask, self.table)
        return df.withColumns({v: F.expr(clipped(f"({v} + __y - __o)", top)) for v in values(channels)}).drop("__y", "__o")


@operator
class AutoContrast(Operator):
    """Stretches between the bounds that leave cutoff percent of the pixels out at either end."""

    cutoff: float = 0.0
    ignore: int | None = None
    method: str = "cdf"
    p: float = 0.5

    def table(self, hist: DataFrame) -> DataFrame:
        if self.ignore is not None:
            hist = hist.where(f"v <> {self.ignore}")
        c = cumulative(hist, "ch").withColumns({"cut": F.expr(f"total * {num(self.cutoff)} / 100e0"), "above": F.expr("total - cum + n")})
        w = Window.partitionBy("sample_id", "ch")
        c = c.withColumns({"lo": F.min(F.expr("case when cum > cut then v end")).over(w), "hi": F.max(F.expr("case when above > cut then v end")).over(w)})
        c = c.withColumns({"c0": F.min(F.expr("case when v = lo then cum end")).over(w), "c1": F.max(F.expr("case when v = hi then cum end")).over(w)})
        inside = "floor((cum - c0) * 255e0 / (c1 - c0))" if self.method == "cdf" else "floor((v - lo) * 255e0 / (hi - lo))"
        new = f"case when lo is null or hi is null or lo >= hi then v when v < lo then 0 when v > hi then 255 else {inside} end"
        return c.withColumn("new", F.expr(f"cast({new} as double)"))

    def on_pixels(self, df, channels, top):
        return by_tables(df, values(channels), None, self.table)


@operator
class CLAHE(Operator):
    """Clipped histogram equalisation of lightness in tiles; a pixel mixes the tables of the four
    nearest tiles. space: lab or ycrcb, whose first axis is equalised and whose others stay; or luma,
    which colour channels follow in proportion."""

    clip_limit: float = 4.0
    tile_grid_size: tuple = (2, 2)
    space: str = "lab"
    p: float = 0.5
    statistic = True

    def on_pixels(self, df, channels, top):
        if channels >= 3 and self.space != "luma":
            rgb = [f"__rgb{i}" for i in range(3)]
            df = into_space(df.withColumns({c: F.col(v) for c, v in zip(rgb, values(3))}), self.space, top).withColumnsRenamed({"v1": "__v1", "v2": "__v2"})
            df = self.tiled(df, 1, 255.0).withColumnsRenamed({"__v1": "v1", "__v2": "v2"})
            out = out_of_space(df, self.space, top)
            return out.withColumns({v: F.coalesce(v, c) for v, c in zip(values(3), rgb)}).drop(*rgb)
        return self.tiled(df, channels, top)

    def tiled(self, df: DataFrame, channels: int, top: float) -> DataFrame:
        rows, cols = self.tile_grid_size
        grey = colour.luma("v0", "v1", "v2") if channels >= 3 else "v0"
        df = df.withColumns({"__l": F.expr(f"cast(floor({grey} + 0.5e0) as int)"), "__ty": F.expr(f"cast(floor(y * {rows} / h) as int)"), "__tx": F.expr(f"cast(floor(x * {cols} / w) as int)")})
        hist = df.groupBy("sample_id", "__ty", "__tx", "__l").agg(F.count("*").alias("n"))
        w = Window.partitionBy("sample_id", "__ty", "__tx")
        hist = hist.withColumn("total", F.sum("n").over(w)).withColumn("kept", F.expr(f"least(1e0 * n, greatest(1e0, {num(self.clip_limit)} * total / 256e0))"))
        hist = hist.withColumn("spare", F.col("total") - F.sum("kept").over(w)).withColumn("cum", F.sum("kept").over(w.orderBy("__l")))
        # what was clipped is spread over all 256 values; a table has a row for each value that a tile has
        lists = hist.groupBy("sample_id", "__ty", "__tx").agg(F.array_sort(F.collect_list(F.struct(F.col("__l").alias("l"), F.expr("(cum + spare * (__l + 1) / 256e0) * 255e0 / total").alias("new")))).alias("t"), F.min("spare").alias("spare"), F.min("total").alias("total"))
        tables = lists.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct(F.expr(f"__ty * {cols} + __tx"), F.struct("t", "spare", "total")))).alias("__t"))
        df = df.join(tables, "sample_id", "left")
        fy, fx = f"((y + 0.5e0) * {rows} / h - 0.5e0)", f"((x + 0.5e0) * {cols} / w - 0.5e0)"

        def at(ty: str, tx: str) -> str:
            key = f"(greatest(0, least({rows - 1}, {ty})) * {cols} + greatest(0, least({cols - 1}, {tx})))"
            t = f"__t[cast({key} as int)]"
            below = f"aggregate({t}.t, 0e0, (s, r) -> case when r.l <= __l then r.new - {t}.spare * (r.l + 1) / 256e0 * 255e0 / {t}.total else s end)"
            return f"({below} + {t}.spare * (__l + 1) / 256e0 * 255e0 / {t}.total)"

        y0, x0 = f"cast(floor({fy}) as int)", f"cast(floor({fx}) as int)"
        wy, wx = f"({fy} - floor({fy}))", f"({fx} - floor({fx}))"
        mixed = f"((1e0 - {wy}) * ((1e0 - {wx}) * {at(y0, x0)} + {wx} * {at(y0, f'{x0} + 1')}) + {wy} * ((1e0 - {wx}) * {at(f'{y0} + 1', x0)} + {wx} * {at(f'{y0} + 1', f'{x0} + 1')}))"
        df = df.withColumn("__new", F.expr(mixed))
        gain = "(case when __l = 0 then 1e0 else __new / __l end)" if channels >= 3 else None
        out = {v: F.expr(clipped(f"({v} * {gain})" if gain else "__new", top)) for v in values(channels)}
        return df.withColumns(out).drop("__l", "__ty", "__tx", "__t", "__new")


def moments(df: DataFrame, names: tuple[str, ...] = ("v0", "v1", "v2")) -> DataFrame:
    """(sample_id, m0 ..., c00, c01 ...): means and population covariances."""
    out = [F.avg(v).alias(f"m{i}") for i, v in enumerate(names)]
    out += [F.covar_pop(a, b).alias(f"c{i}{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    return df.groupBy("sample_id").agg(*out)


def axes(stats: DataFrame) -> DataFrame:
    """stats with axes: array of (value, x, y, z), largest first. 3 x 3 symmetric eigenproblems, a
    batch of samples at a time."""
    @F.pandas_udf("array<array<double>>")
    def eigen(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series) -> pd.Series:
        m = np.stack([np.stack([a, b, c], 1), np.stack([b, d, e], 1), np.stack([c, e, f], 1)], 1)
        value, vector = np.linalg.eigh(m)
        sign = np.where(vector.sum(axis=1, keepdims=True) < 0, -1, 1)
        vector = vector * sign
        return pd.Series([[[float(value[k, i]), *vector[k, :, i].tolist()] for i in (2, 1, 0)] for k in range(len(m))])

    return stats.withColumn("axes", eigen("c00", "c01", "c02", "c11", "c12", "c22"))


def principal_grey(df: DataFrame, top: float, channels: int) -> DataFrame:
    """Position along the first principal axis, stretched to the full range."""
    stats = axes(moments(df)).select("sample_id", "m0", "m1", "m2", "axes")
    df = df.join(stats, "sample_id", "left").withColumn("__t", F.expr("(v0 - m0) * axes[0][1] + (v1 - m1) * axes[0][2] + (v2 - m2) * axes[0][3]"))
    ends = df.groupBy("sample_id").agg(F.min("__t").alias("__lo"), F.max("__t").alias("__hi"))
    df = df.join(ends, "sample_id", "left").withColumn("__g", F.expr(clipped(f"(case when __hi = __lo then 0e0 else (__t - __lo) / (__hi - __lo) * {num(top)} end)", top)))
    return df.drop("v0", "v1", "v2", "m0", "m1", "m2", "axes", "__t", "__lo", "__hi").withColumns({v: F.col("__g") for v in values(channels)}).drop("__g")


@operator
class FancyPCA(Operator):
    alpha: float = 0.1
    p: float = 0.5

    def draws(self, d: Draws):
        return {f"a{i}": f"({num(self.alpha)} * {d.normal(f'a{i}')})" for i in range(3)}

    def on_pixels(self, df, channels, top):
        unit = df.withColumns({v: F.col(v) / top for v in values(3)})
        stats = axes(moments(unit)).select("sample_id", "axes")
        df = df.join(stats, "sample_id", "left")
        return df.withColumns({v: F.expr(clipped(f"({v} + {num(top)} * ({' + '.join(f'axes[{k}][{i + 1}] * p_a{k} * axes[{k}][0]' for k in range(3))}))", top)) for i, v in enumerate(values(3))}).drop("axes")


class Stain:
    """Optical densities of haematoxylin and eosin: red, green, blue of each."""

    #: Fixed values, under the names that users know them by.
    PRESETS = {
        "ruifrok": ((0.644211, 0.716556, 0.266844), (0.092789, 0.954111, 0.283111)),
        "macenko": ((0.5626, 0.7201, 0.4062), (0.2159, 0.8012, 0.5581)),
        "standard": ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11)),
        "high_contrast": ((0.55, 0.88, 0.11), (0.12, 0.86, 0.49)),
        "h_heavy": ((0.75, 0.61, 0.32), (0.04, 0.93, 0.36)),
        "e_heavy": ((0.60, 0.75, 0.28), (0.17, 0.95, 0.25)),
        "dark": ((0.78, 0.55, 0.28), (0.09, 0.97, 0.21)),
        "light": ((0.57, 0.71, 0.38), (0.15, 0.89, 0.42)),
    }


def factored(density: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Two non-negative unit colours whose non-negative mixtures come nearest to the densities (pixel, 3).

    Lee and Seung's multiplicative updates from the ruifrok preset; haematoxylin, the one that takes
    the larger share of red, comes first.
    """
    colours = np.array(Stain.PRESETS["ruifrok"])
    amounts = np.maximum(density @ (colours / np.linalg.norm(colours, axis=1, keepdims=True)).T, 1e-6)
    for _ in range(rounds):
        amounts = amounts * (density @ colours.T) / (amounts @ (colours @ colours.T) + 1e-6)
        colours = colours * (amounts.T @ density) / ((amounts.T @ amounts) @ colours + 1e-6)
        colours = colours / np.maximum(np.linalg.norm(colours, axis=1, keepdims=True), 1e-6)
    return colours[np.argsort(-colours[:, 0] / np.maximum(colours.sum(axis=1), 1e-9), kind="stable")]


def factors(df: DataFrame) -> DataFrame:
    """(sample_id, __f): factored() of each sample's densities __d0, __d1, __d2, a batch of samples at a time."""

    @F.pandas_udf("array<array<double>>")
    def factor(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([factored(np.stack([x, y, z], 1).astype(float)).tolist() for x, y, z in zip(a, b, c)])

    rows = df.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "__d0", "__d1", "__d2"))).alias("q"))
    return rows.select("sample_id", factor(*[F.expr(f"transform(q, r -> r.__d{i})") for i in range(3)]).alias("__f"))


@operator
class HEStain(Operator):
    """Optical densities are split into two stains, whose amounts are scaled and shifted."""

    method: str = "random_preset"
    preset: str | None = None
    intensity_scale_range: tuple = (0.7, 1.3)
    intensity_shift_range: tuple = (-0.2, 0.2)
    augment_background: bool = False
    p: float = 0.5

    def draws(self, d: Draws):
        out = {f"s{i}": d.between(f"s{i}", *self.intensity_scale_range) for i in range(2)} | {f"t{i}": d.between(f"t{i}", *self.intensity_shift_range) for i in range(2)}
        return out | {"preset": d.integer("preset", 0, len(Stain.PRESETS) - 1) if self.preset is None else "0"}

    def on_pixels(self, df, channels, top):
        df = df.withColumns({f"__d{i}": F.expr(f"-ln(greatest(1e0, {v} * {num(255 / top)}) / 255e0)") for i, v in enumerate(values(3))})
        if self.method == "vahadane":
            df = df.join(factors(df), "sample_id", "left")
            vec = [[f"coalesce(__f[{k}][{i}], {num(Stain.PRESETS['ruifrok'][k][i])})" for i in range(3)] for k in range(2)]
        elif self.method == "macenko":
            # the plane of the two largest axes of the densities; stains are its extreme directions
            stats = axes(moments(df, ("__d0", "__d1", "__d2")).withColumnsRenamed({})).select("sample_id", "axes")
            df = df.join(stats, "sample_id", "left")
            df = df.withColumn("__phi", F.expr("atan2(__d0 * axes[1][1] + __d1 * axes[1][2] + __d2 * axes[1][3], __d0 * axes[0][1] + __d1 * axes[0][2] + __d2 * axes[0][3])"))
            ends = df.where("__d0 + __d1 + __d2 > 0.15").groupBy("sample_id").agg(F.percentile("__phi", F.array(F.lit(0.01), F.lit(0.99))).alias("__e"))
            df = df.join(ends, "sample_id", "left")
            vec = [[f"coalesce(cos(__e[{k}]) * axes[0][{i}] + sin(__e[{k}]) * axes[1][{i}], {num(Stain.PRESETS['ruifrok'][k][i - 1])})" for i in (1, 2, 3)] for k in (1, 0)]
        else:
            names = [self.preset] if self.preset else list(Stain.PRESETS)
            vec = [["case p_preset " + " ".join(f"when {j} then {num(Stain.PRESETS[n][k][i])}" for j, n in enumerate(names)) + f" else {num(Stain.PRESETS[names[0]][k][i])} end" for i in range(3)] for k in range(2)]
        df = df.withColumns({f"__a{k}{i}": F.expr(vec[k][i]) for k in range(2) for i in range(3)})
        dot = lambda a, b: "(" + " + ".join(f"{a}{i} * {b}{i}" for i in range(3)) + ")"
        df = df.withColumns({"__g0": F.expr(f"{dot('__a0', '__a0')} + 1e-6"), "__g1": F.expr(dot("__a0", "__a1")), "__g2": F.expr(f"{dot('__a1', '__a1')} + 1e-6"), "__b0": F.expr(dot("__a0", "__d")), "__b1": F.expr(dot("__a1", "__d"))})
        det = "(__g0 * __g2 - __g1 * __g1)"
        df = df.withColumns({"__c0": F.expr(f"(__b0 * __g2 - __b1 * __g1) / {det}"), "__c1": F.expr(f"(__b1 * __g0 - __b0 * __g1) / {det}")})
        tissue = "true" if self.augment_background else f"{colour.luma('v0', 'v1', 'v2')} < {num(0.85 * top)}"
        df = df.withColumns({f"__c{k}": F.expr(f"case when {tissue} then __c{k} * p_s{k} + p_t{k} else __c{k} end") for k in range(2)})
        out = df.withColumns({v: F.expr(clipped(f"(exp(-(__c0 * __a0{i} + __c1 * __a1{i})) * {num(top)})", top)) for i, v in enumerate(values(3))})
        own = [f"__{n}{k}" for n, m in (("d", 3), ("g", 3), ("b", 2), ("c", 2), ("a0", 3), ("a1", 3)) for k in range(m)]
        return out.drop(*own, "__f", "__phi", "__e", "axes")


def matched(df: DataFrame, reference: DataFrame, v: str) -> DataFrame:
    """(sample_id, v, new): a channel's values at the reference's equal quantiles, by linear interpolation.

    Both cumulative shares are merged in order, and the reference's neighbours come from windows: an
    as-of join on (sample, share) without a range condition.
    """
    a = cumulative(histogram(df, v)).selectExpr("sample_id", "cum / total as q", "v as sv", "cast(null as int) as tv")
    b = cumulative(histogram(reference, v)).selectExpr("sample_id", "cum / total as q", "cast(null as int) as sv", "v as tv")
    both = a.unionByName(b)
    order = Window.partitionBy("sample_id").orderBy("q", F.col("tv").isNull())
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("sample_id").orderBy(F.col("q").desc(), F.col("tv").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    t = F.when(F.col("tv").isNotNull(), F.struct("q", "tv"))
    both = both.withColumns({"lo": F.last(t, ignorenulls=True).over(back), "hi": F.last(t, ignorenulls=True).over(ahead)}).where("sv is not null")
    new = "case when lo is null then hi.tv when hi is null then lo.tv when hi.q = lo.q then lo.tv else lo.tv + (hi.tv - lo.tv) * (q - lo.q) / (hi.q - lo.q) end"
    return both.selectExpr("sample_id", "sv as v", f"cast({new} as double) as new")


def blended(old: str, new: str, top: float) -> str:
    return clipped(f"({old} * (1e0 - p_b) + {new} * p_b)", top)


@operator
class HistogramMatching(Operator):
    """reference: pixels of the same sample ids. space: match axes of lab, ycrcb or hsv instead of channels."""

    reference: DataFrame | None = None
    blend_ratio: tuple = (0.5, 1.0)
    space: str | None = None
    p: float = 0.5

    def draws(self, d: Draws):
        return {"b": d.between("b", *self.blend_ratio)}

    def on_pixels(self, df, channels, top):
        if self.space is None:
            return self.matched_by(df, self.reference, channels, top)
        out = self.matched_by(into_space(df, self.space, top), into_space(self.reference, self.space, top), 3, 255.0)
        return out_of_space(out, self.space, top)

    def matched_by(self, df: DataFrame, reference: DataFrame, channels: int, top: float) -> DataFrame:
        for v in values(channels):
            df = through(df.withColumn("__old", F.col(v)), v, matched(df, reference, v))
            df = df.withColumn(v, F.expr(blended("__old", f"floor({v})", top))).drop("__old")
        return df


@operator
class PixelDistributionAdaptation(Operator):
    """Source colours through the reference's distribution: standard (mean, spread), minmax or pca."""

    reference: DataFrame | None = None
    blend_ratio: tuple = (0.25, 1.0)
    transform_type: str = "pca"
    p: float = 0.5

    def draws(self, d: Draws):
        return {"b": d.between("b", *self.blend_ratio)}

    def on_pixels(self, df, channels, top):
        def stats(x: DataFrame, tag: str) -> DataFrame:
            if self.transform_type == "minmax":
                return x.groupBy("sample_id").agg(*[f(v).alias(f"{tag}{n}{i}") for i, v in enumerate(values(channels)) for n, f in (("lo", F.min), ("hi", F.max))])
            if self.transform_type == "standard":
                return x.groupBy("sample_id").agg(*[f(v).alias(f"{tag}{n}{i}") for i, v in enumerate(values(channels)) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
            return axes(moments(x)).select("sample_id", *[F.col(f"m{i}").alias(f"{tag}m{i}") for i in range(3)], F.col("axes").alias(f"{tag}axes"))

        found = stats(self.reference, "t_").withColumn("__ref", F.lit(True))
        out = df.join(stats(df, "s_"), "sample_id", "left").join(found, "sample_id", "left")
        if self.transform_type == "minmax":
            new = [f"(case when s_hi{i} = s_lo{i} then t_lo{i} else (v{i} - s_lo{i}) / (s_hi{i} - s_lo{i}) * (t_hi{i} - t_lo{i}) + t_lo{i} end)" for i in range(channels)]
        elif self.transform_type == "standard":
            new = [f"(case when s_s{i} = 0 then t_m{i} else (v{i} - s_m{i}) / s_s{i} * t_s{i} + t_m{i} end)" for i in range(channels)]
        else:
            part = [f"(({' + '.join(f'(v{j} - s_m{j}) * s_axes[{k}][{j + 1}]' for j in range(3))}) * (case when s_axes[{k}][0] <= 1e-9 then 0e0 else sqrt(abs(t_axes[{k}][0]) / s_axes[{k}][0]) end))" for k in range(3)]
            out = out.withColumns({f"__k{k}": F.expr(e) for k, e in enumerate(part)})
            new = [f"(t_m{i} + {' + '.join(f'__k{k} * t_axes[{k}][{i + 1}]' for k in range(3))})" for i in range(3)]
        out = out.withColumns({f"v{i}": F.expr(f"case when __ref then {blended(f'v{i}', e, top)} else v{i} end") for i, e in enumerate(new)})
        return out.select(*df.columns)


@operator
class FDA(Operator):
    """Low-frequency amplitudes come from the reference, phases stay. One discrete Fourier transform
    for each sample, of arrays that Spark has gathered and joined."""

    reference: DataFrame | None = None
    beta_limit: tuple = (0.0, 0.1)
    p: float = 0.5
    own = ("pixels",)

    def draws(self, d: Draws):
        return {"beta": d.between("beta", *self.beta_limit)}

    def on_pixels(self, df, channels, top):
        from .gather import grouped, spread

        source = grouped(df, channels)
        target = grouped(self.reference.select("sample_id", "h", "w", "y", "x", *values(channels)), channels).select("sample_id", F.col("h").alias("rh"), F.col("w").alias("rw"), *[F.col(f"a{i}").alias(f"r{i}") for i in range(channels)])

        @F.pandas_udf("array<double>")
        def swap(a: pd.Series, r: pd.Series, h: pd.Series, w: pd.Series, beta: pd.Series) -> pd.Series:
            out = []
            for x, y, hh, ww, b in zip(a, r, h, w, beta):
                s, t = np.fft.fft2(np.reshape(x, (hh, ww))), np.fft.fft2(np.resize(y, (hh, ww)))
                k = int(min(hh, ww) * b)
                fy, fx = np.abs(np.fft.fftfreq(hh, 1 / hh)), np.abs(np.fft.fftfreq(ww, 1 / ww))
                low = (fy[:, None] <= k) & (fx[None] <= k)
                amp = np.where(low, np.abs(t), np.abs(s))
                out.append(np.fft.ifft2(amp * np.exp(1j * np.angle(s))).real.ravel().tolist())
            return pd.Series(out)

        rows = source.join(target, "sample_id", "left")  # a sample without a reference stays as it is
        rows = rows.withColumns({f"r{i}": F.coalesce(f"r{i}", f"a{i}") for i in range(channels)}).withColumn("__beta", F.coalesce("p_beta", F.lit(0.0)))
        rows = rows.withColumns({f"__n{i}": swap(f"a{i}", f"r{i}", "h", "w", "__beta") for i in range(channels)})
        rows = rows.withColumns({f"__n{i}": F.when(F.col("rh").isNull(), F.col(f"a{i}")).otherwise(F.col(f"__n{i}")) for i in range(channels)}).drop("rh", "rw", "__beta", *[f"r{i}" for i in range(channels)])
        return spread(rows, channels, {v: clipped(f"(__n{i}[q.y * w + q.x])", top) for i, v in enumerate(values(channels))}).drop(*[f"__n{i}" for i in range(channels)])


@operator
class Superpixels(Operator):
    """Cells of a grid, refined by assigning pixels to the nearest centre in place and colour; drawn
    cells take their mean. Each round is an aggregation by cell and a choice among nine neighbours."""

    p_replace: tuple = (0.0, 0.1)
    n_segments: tuple = (100, 100)
    compactness: float = 10.0
    rounds: int = 2
    p: float = 0.5

    def draws(self, d: Draws):
        return {"replace": d.between("replace", *self.p_replace), "n": d.integer("n", *self.n_segments), "seed": f"cast(floor({d.unit('seed')} * 1e6) as bigint)"}

    def on_pixels(self, df, channels, top):
        names = values(channels)
        cols = "cast(greatest(1e0, least(1e0 * w, floor(sqrt(p_n * 1e0 * w / h)))) as int)"
        rows = f"cast(greatest(1e0, least(1e0 * h, floor(p_n / {cols}))) as int)"
        df = df.withColumns({"__c": F.expr(cols), "__r": F.expr(rows)}).withColumn("__cell", F.expr("cast(floor(y * __r / h) as int) * __c + cast(floor(x * __c / w) as int)"))
        for _ in range(self.rounds):
            means = df.groupBy("sample_id", "__cell").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"), *[F.avg(v).alias(f"c{v}") for v in names])
            lists = means.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("__cell", F.struct("cy", "cx", *[f"c{v}" for v in names])))).alias("__m"))
            df = df.join(lists, "sample_id", "left")
            near = "filter(flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> __cell + i * __c + j))), c -> __m[c] is not null)"
            far = f"pow(y - __m[c].cy, 2) + pow(x - __m[c].cx, 2) + ({' + '.join(f'pow({v} - __m[c].c{v}, 2)' for v in names)}) / {num(self.compactness**2)}"
            df = df.withColumn("__cell", F.expr(f"array_min(transform({near}, c -> named_struct('d', {far}, 'c', c))).c")).drop("__m")
        means = df.groupBy("sample_id", "__cell").agg(*[F.avg(v).alias(f"c{v}") for v in names])
        df = df.join(means, ["sample_id", "__cell"], "left")
        hit = "((p_seed * 48271 + __cell * 7919 + 12345) % 10007) / 10007e0 < p_replace"
        return df.withColumns({v: F.expr(f"case when {hit} then {clipped(f'(c{v})', top)} else {v} end") for v in names}).drop("__cell", "__c", "__r", *[f"c{v}" for v in names])


#: Blocks that are transformed together: their coefficients stay in a core's cache.
TOGETHER = 256


def cosines(n: int) -> np.ndarray:
    """[place, frequency] of n places."""
    return np.array([[math.cos((2.0 * a + 1.0) * u * math.pi / (2.0 * n)) for u in range(n)] for a in range(n)])


def through_cosines(v: pa.Array, y: pa.Array, x: pa.Array, by: pa.Array, bx: pa.Array, bh: pa.Array, bw: pa.Array, q: pa.Array) -> pa.Array:
    """Values of blocks (lists of pixels by y, x) after their cosine coefficients were rounded for a quality q.

    Blocks that hold the same pixels go together, sums run pixel by pixel and frequency by frequency:
    halves are rounded by what a sum comes to, so its order is part of the result. Blocks without a
    quality get an empty list, blocks with an unknown value unknown ones.
    """
    flat = v.flatten().cast(pa.float64())
    known = np.asarray(flat.is_valid())
    values, quality = flat.fill_null(0.0).to_numpy(zero_copy_only=False), q.fill_null(0.0).to_numpy(zero_copy_only=False)
    size = np.asarray(pc.list_value_length(v))
    first = np.cumsum(size) - size
    top, left, high, wide = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (by, bx, bh, bw))
    ys, xs = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (y, x))
    place = (ys - np.repeat(top * 8, size)) * 8 + xs - np.repeat(left * 8, size)
    out, done = np.zeros(len(values)), np.asarray(q.is_valid())
    for n in np.unique(size[done]):
        rows = np.flatnonzero(done & (size == n))
        at = first[rows, None] + np.arange(n)
        alike, which = np.unique(np.column_stack([high[rows], wide[rows], place[at]]).astype(np.uint8), axis=0, return_inverse=True)
        for g, (h, w, *cells) in enumerate(alike.astype(int)):
            mine = np.flatnonzero(which.ravel() == g)
            for a in range(0, len(mine), TOGETHER):
                some = mine[a : a + TOGETHER]
                with np.errstate(invalid="ignore"):
                    out[at[some]] = rounded_blocks(values[at[some]].T, np.array(cells), h, w, quality[rows[some]]).T
    ends = np.concatenate([[0], np.cumsum(np.where(done, size, 0))]).astype(np.int32)
    kept = np.repeat(done, size)
    whole = np.repeat(np.add.reduceat(np.append(~known, False), first)[: len(size)] == 0, size) if len(size) else known
    return pa.ListArray.from_arrays(ends, pa.array(out[kept], mask=~whole[kept]))


def rounded_blocks(values: np.ndarray, cells: np.ndarray, h: int, w: int, quality: np.ndarray) -> np.ndarray:
    """values: [pixel, block], pixels at cells (8 y + x) of h x w places."""
    cy, cx, count = cosines(h), cosines(w), values.shape[1]
    found, part = np.zeros((h, w, count)), np.empty((h, w, count))
    for v, c in zip(values - 128.0, cells):
        np.multiply((v * cy[c // 8][:, None])[:, None], cx[c % 8][:, None], out=part)
        found += part
    u, v = np.arange(h)[:, None], np.arange(w)[None]
    norm = np.sqrt(np.where(u == 0, 1.0, 2.0) * np.where(v == 0, 1.0, 2.0) / (h * w))[..., None]
    scale = np.where(quality < 50, 5000.0 / quality, 200.0 - 2.0 * quality) / 100.0
    step = np.maximum(1.0, (8.0 + 4.0 * (u + v))[..., None] * scale)
    found = step * np.rint(found * norm / step) * norm
    back = np.zeros((h, w, count))
    for i in range(h):
        for j in range(w):
            np.multiply((found[i, j] * cy[:, i][:, None])[:, None], cx[:, j][:, None], out=part)
            back += part
    return 128.0 + back[cells // 8, cells % 8]


@operator
class ImageCompression(Operator):
    """Loss of a block transform: 8 x 8 cosine coefficients are rounded to steps that grow with
    frequency and fall with quality. Blocks are an aggregation by (sample, block), transformed a batch
    at a time."""

    quality_range: tuple = (99, 100)
    p: float = 0.5
    own = ("pixels",)

    def draws(self, d: Draws):
        return {"q": d.integer("q", *self.quality_range)}

    def on_pixels(self, df, channels, top):
        names = values(channels)
        df = df.withColumns({"__by": F.expr("cast(floor(y / 8) as int)"), "__bx": F.expr("cast(floor(x / 8) as int)")})
        rest = [c for c in df.columns if c not in {"sample_id", "h", "w", "y", "x", "__by", "__bx", *names}]
        blocks = df.groupBy("sample_id", "h", "w", "__by", "__bx").agg(F.sort_array(F.collect_list(F.struct("y", "x", *names))).alias("px"), F.max("y").alias("__my"), F.max("x").alias("__mx"), *[F.min(c).alias(c) for c in rest])
        blocks = blocks.withColumns({"__bh": F.expr("__my - __by * 8 + 1"), "__bw": F.expr("__mx - __bx * 8 + 1")})
        coded = F.arrow_udf(through_cosines, "array<double>")
        quality = or_old(df, "p_q", "null")  # blocks that stay as they are need no result
        blocks = blocks.withColumns({f"__n{i}": coded(f"px.{v}", "px.y", "px.x", "__by", "__bx", "__bh", "__bw", F.expr(f"cast({quality} as double)")) for i, v in enumerate(names)})
        rows = blocks.select("sample_id", "h", "w", *rest, F.inline(F.arrays_zip("px", *[f"__n{i}" for i in range(channels)])))
        return rows.select("sample_id", "h", "w", *rest, "px.y", "px.x", *[F.expr(or_old(df, clipped(f"__n{i}", top), f"px.{v}")).alias(v) for i, v in enumerate(names)])
