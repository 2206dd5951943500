"""Neighbourhoods and resampling: one shuffle on the sample, then higher-order functions on its arrays.

Pixels of a sample are gathered into one array per channel; output pixels read from these arrays by
index. Nothing is multiplied by the kernel's size or joined by coordinate.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlane.functions.sampling import Draws, num

from .base import Operator, clipped, operator, or_old, pair, values
from .geometry import angle, moved, reflected


class Gathered(Operator):
    """What works on samples as rows; spread() leaves samples alone whose gate is closed."""

    own = ("pixels", "masks")


def grouped(df: DataFrame, channels: int) -> DataFrame:
    """One row per sample: sample_id, h, w, a0 ... (row-major), and its other columns (equal for all pixels)."""
    rest = [c for c in df.columns if c not in {"sample_id", "h", "w", "y", "x", *values(channels)}]
    row = F.struct("y", "x", *values(channels))
    rows = df.groupBy("sample_id", "h", "w").agg(F.array_sort(F.collect_list(row)).alias("__px"), *[F.min(c).alias(c) for c in rest])
    return rows.select("sample_id", "h", "w", *rest, *[F.expr(f"transform(__px, r -> r.{v})").alias(f"a{v[1:]}") for v in values(channels)])


def spread(rows: DataFrame, channels: int, cell: dict[str, str], h: str = "h", w: str = "w", bind: tuple[dict[str, str], ...] = ()) -> DataFrame:
    """Pixels of rows with arrays. cell: value of each channel as SQL over q.y, q.x and what bind adds.

    bind: steps of named expressions over q; each step sees the names of the steps before.
    """
    rest = [c for c in rows.columns if c not in {"sample_id", "h", "w", *[f"a{i}" for i in range(channels)]}]
    h, w = or_old(rows, h, "h"), or_old(rows, w, "w")
    cell = {v: or_old(rows, e, f"a{v[1:]}[q.y * w + q.x]") for v, e in cell.items()}
    e, known = f"transform(sequence(0, cast(({h}) * ({w}) as int) - 1), i -> named_struct('y', cast(floor(i / ({w})) as int), 'x', cast(i % ({w}) as int)))", ["y", "x"]
    for step in bind:
        e = f"transform({e}, q -> named_struct({', '.join([f'{chr(39)}{k}{chr(39)}, q.{k}' for k in known] + [f'{chr(39)}{k}{chr(39)}, {v}' for k, v in step.items()])}))"
        known += list(step)
    e = f"transform({e}, q -> named_struct('y', q.y, 'x', q.x, {', '.join(f'{chr(39)}{k}{chr(39)}, cast({v} as double)' for k, v in cell.items())}))"
    return rows.select("sample_id", F.expr(f"cast({h} as int)").alias("h"), F.expr(f"cast({w} as int)").alias("w"), *rest, F.inline(F.expr(e)))


def filtered(df: DataFrame, channels: int, kernel: str, each: str, top: float | None) -> DataFrame:
    """each: SQL over the list n of structs (wt, v) of a pixel's neighbours. kernel: an array of
    structs (dy, dx, wt) as SQL over the sample's columns. Borders mirror."""
    rows = grouped(df, channels).withColumn("__k", F.expr(kernel))
    at = f"{reflected('q.y + k.dy', 'h')} * w + {reflected('q.x + k.dx', 'w')}"
    cell = {}
    for i, v in enumerate(values(channels)):
        e = each.replace("$n", f"transform(__k, k -> named_struct('wt', k.wt, 'v', a{i}[cast({at} as int)]))").replace("$v", f"a{i}[q.y * w + q.x]")
        cell[v] = clipped(f"({e})", top) if top else e
    return spread(rows, channels, cell).drop("__k")


WEIGHTED = "aggregate($n, 0e0, (s, n) -> s + n.wt * n.v)"
#: The same with weights that need not sum to one.
MEAN = "aggregate($n, named_struct('a', 0e0, 'b', 0e0), (s, n) -> named_struct('a', s.a + n.wt * n.v, 'b', s.b + n.wt), s -> s.a / s.b)"


def smoothed(df: DataFrame, channels: int, r: str, sigma: str, each: str, top: float | None) -> DataFrame:
    """A Gaussian of radius r by rows, then by columns. each: SQL over the blurred $b and the old $v."""
    rows = grouped(df, channels).withColumn("__k", F.expr(f"transform(sequence(-cast({r} as int), cast({r} as int)), o -> named_struct('o', o, 'wt', exp(-(o * o) / (2e0 * {sigma} * {sigma}))))"))
    rows = rows.withColumn("__t", F.expr("aggregate(__k, 0e0, (s, k) -> s + k.wt)"))
    for i in range(channels):
        x = reflected("i % w + k.o", "w")
        rows = rows.withColumn(f"__b{i}", F.expr(f"transform(sequence(0, h * w - 1), i -> aggregate(__k, 0e0, (s, k) -> s + k.wt * a{i}[cast(i - i % w + {x} as int)]) / __t)"))
    y, cell = reflected("q.y + k.o", "h"), {}
    for i, v in enumerate(values(channels)):
        blurred = f"(aggregate(__k, 0e0, (s, k) -> s + k.wt * __b{i}[cast({y} * w + q.x as int)]) / __t)"
        e = each.replace("$b", blurred).replace("$v", f"a{i}[q.y * w + q.x]")
        cell[v] = clipped(f"({e})", top) if top else e
    return spread(rows, channels, cell).drop("__k", "__t", *[f"__b{i}" for i in range(channels)])


def box_kernel(k: str) -> str:
    """k x k equal weights; k odd, as SQL."""
    r = f"cast((({k}) - 1) / 2 as int)"
    return f"flatten(transform(sequence(-{r}, {r}), dy -> transform(sequence(-{r}, {r}), dx -> named_struct('dy', dy, 'dx', dx, 'wt', 1e0 / (({k}) * ({k}))))))"


def odd(d: Draws, name: str, limits: tuple) -> str:
    """An odd size of at least 3, evenly from the odd ones within the limits."""
    lo, hi = (max(3, int(x)) | 1 for x in limits)
    return f"({lo} + 2 * {d.integer(name, 0, (hi - lo) // 2)})"


def literal_kernel(rows: list[tuple[int, int, str]]) -> str:
    return "array(" + ", ".join(f"named_struct('dy', {dy}, 'dx', {dx}, 'wt', cast({w} as double))" for dy, dx, w in rows) + ")"


@operator
class Blur(Gathered):
    blur_limit: tuple = (3, 7)
    p: float = 0.5

    def draws(self, d: Draws):
        return {"k": odd(d, "k", self.blur_limit)}

    def on_pixels(self, df, channels, top):
        return filtered(df, channels, box_kernel("p_k"), WEIGHTED, top)


@operator
class MedianBlur(Gathered):
    blur_limit: tuple = (3, 7)
    p: float = 0.5

    def draws(self, d: Draws):
        return {"k": odd(d, "k", self.blur_limit)}

    def on_pixels(self, df, channels, top):
        return filtered(df, channels, box_kernel("p_k"), "array_sort(transform($n, n -> n.v))[cast((p_k * p_k - 1) / 2 as int)]", top)


@operator
class GaussianBlur(Gathered):
    blur_limit: tuple | int = 0
    sigma_limit: tuple = (0.5, 3.0)
    p: float = 0.5

    def draws(self, d: Draws):
        s = d.between("sigma", *self.sigma_limit)
        size = self.blur_limit if isinstance(self.blur_limit, tuple) else (self.blur_limit, self.blur_limit)
        r = f"cast(floor(3.5e0 * {s}) as int)" if size[1] == 0 else f"cast(({odd(d, 'k', size)} - 1) / 2 as int)"
        return {"sigma": s, "r": f"greatest(1, {r})"}

    def on_pixels(self, df, channels, top):
        return smoothed(df, channels, "p_r", "p_sigma", "$b", top)


@operator
class AdvancedBlur(Gathered):
    """A rotated generalised Gaussian with noise on its weights."""

    blur_limit: tuple = (3, 7)
    sigma_x_limit: tuple = (0.2, 1.0)
    sigma_y_limit: tuple = (0.2, 1.0)
    rotate_limit: tuple = (-90, 90)
    beta_limit: tuple = (0.5, 8.0)
    noise_limit: tuple = (0.9, 1.1)
    p: float = 0.5

    def draws(self, d: Draws):
        lo, hi = self.beta_limit
        beta = f"case when {d.unit('side')} < 0.5e0 then {d.between('b0', min(lo, 1), min(1, hi))} else {d.between('b1', max(1, lo), max(1, hi))} end"
        return {"k": odd(d, "k", self.blur_limit), "sx": d.between("sx", *self.sigma_x_limit), "sy": d.between("sy", *self.sigma_y_limit), "a": f"radians({d.between('a', *self.rotate_limit)})", "b": beta, "noise": d.between("noise", 0, 1)}

    def on_pixels(self, df, channels, top):
        lo, hi = self.noise_limit
        r = "cast((p_k - 1) / 2 as int)"
        u, v = "((dx * cos(p_a) + dy * sin(p_a)) / p_sx)", "((dy * cos(p_a) - dx * sin(p_a)) / p_sy)"
        noise = f"({num(lo)} + {num(hi - lo)} * ((cast(floor(p_noise * 1e6) as bigint) * 48271 + (dy + 50) * 7919 + (dx + 50) * 104729) % 10007) / 10007e0)"
        e = f"exp(-0.5e0 * pow({u} * {u} + {v} * {v}, p_b)) * {noise}"
        kernel = f"flatten(transform(sequence(-{r}, {r}), dy -> transform(sequence(-{r}, {r}), dx -> named_struct('dy', dy, 'dx', dx, 'wt', {e}))))"
        return filtered(df, channels, kernel, MEAN, top)


@operator
class MotionBlur(Gathered):
    """A line through the centre at an angle, longer on one side by a direction, as a kernel."""

    blur_limit: tuple = (3, 7)
    angle_range: tuple = (0, 360)
    direction_range: tuple = (-1.0, 1.0)
    p: float = 0.5

    def draws(self, d: Draws):
        return {"k": odd(d, "k", self.blur_limit), "a": f"radians({d.between('a', *self.angle_range)})", "dir": d.between("dir", *self.direction_range)}

    def on_pixels(self, df, channels, top):
        half = "((p_k - 1) / 2e0)"
        t = f"(j / (2e0 * p_k) * {half})"
        keep = f"{t} >= -{half} * (1e0 - greatest(0e0, p_dir)) and {t} <= {half} * (1e0 + least(0e0, p_dir))"
        cells = f"array_distinct(transform(filter(sequence(cast(-2 * p_k as int), cast(2 * p_k as int)), j -> {keep}), j -> named_struct('dy', cast(floor({t} * sin(p_a) + 0.5e0) as int), 'dx', cast(floor({t} * cos(p_a) + 0.5e0) as int))))"
        return filtered(df, channels, f"transform({cells}, c -> named_struct('dy', c.dy, 'dx', c.dx, 'wt', 1e0))", MEAN, top)


@operator
class Defocus(Gathered):
    """A disk whose edge is softened over alias_blur pixels."""

    radius: tuple = (3, 10)
    alias_blur: tuple = (0.1, 0.5)
    p: float = 0.5

    def draws(self, d: Draws):
        return {"r": d.integer("r", *self.radius), "s": d.between("s", *self.alias_blur)}

    def on_pixels(self, df, channels, top):
        e = "1e0 / (1e0 + exp((sqrt(1e0 * dx * dx + dy * dy) - p_r) / p_s))"
        kernel = f"flatten(transform(sequence(-p_r, p_r), dy -> transform(sequence(-p_r, p_r), dx -> named_struct('dy', dy, 'dx', dx, 'wt', {e}))))"
        return filtered(df, channels, kernel, MEAN, top)


@operator
class GlassBlur(Gathered):
    """Gaussian blur, then each pixel takes a random neighbour's value, iterations times, and a blur again."""

    sigma: float = 0.7
    max_delta: int = 4
    iterations: int = 2
    p: float = 0.5

    def draws(self, d: Draws):
        return {"seed": f"cast(floor({d.unit('seed')} * 1e6) as bigint)"}

    def on_pixels(self, df, channels, top):
        r = max(1, int(3.5 * self.sigma))
        blurred = lambda x: smoothed(x, channels, str(r), num(self.sigma), "$b", top)
        df, n = blurred(df), 2 * self.max_delta + 1
        for k in range(self.iterations):
            at = f"(((p_seed + {k * 977}) * 48271 + q.y * 7919 + q.x * 104729) % 2147483647 * 69621 % 1000003)"
            y, x = f"greatest(0, least(h - 1, q.y + cast({at} % {n} as int) - {self.max_delta}))", f"greatest(0, least(w - 1, q.x + cast(floor({at} / {n}) as int) % {n} - {self.max_delta}))"
            df = spread(grouped(df, channels), channels, {v: f"a{i}[cast(({y}) * w + ({x}) as int)]" for i, v in enumerate(values(channels))})
        return blurred(df)


@operator
class Sharpen(Gathered):
    alpha: tuple = (0.2, 0.5)
    lightness: tuple = (0.5, 1.0)
    method: str = "kernel"
    kernel_size: int = 5
    sigma: float = 1.0
    p: float = 0.5

    def draws(self, d: Draws):
        return {"a": d.between("a", *self.alpha), "l": d.between("l", *self.lightness)}

    def on_pixels(self, df, channels, top):
        if self.method == "gaussian":
            return smoothed(df, channels, str(self.kernel_size // 2), num(self.sigma), "$v + p_a * 2e0 * ($v - $b)", top)
        cells = [(dy, dx, "8e0 * p_a + (1e0 - p_a) + p_l * p_a - p_a * 0e0" if dy == dx == 0 else "-1e0 * p_a") for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        return filtered(df, channels, literal_kernel(cells), WEIGHTED, top)


@operator
class Emboss(Gathered):
    alpha: tuple = (0.2, 0.5)
    strength: tuple = (0.2, 0.7)
    p: float = 0.5

    def draws(self, d: Draws):
        return {"a": d.between("a", *self.alpha), "s": d.between("s", *self.strength)}

    def on_pixels(self, df, channels, top):
        base = {(-1, -1): "-1e0 - p_s", (-1, 0): "0e0 - p_s", (-1, 1): "0e0", (0, -1): "0e0 - p_s", (0, 0): "1e0", (0, 1): "p_s", (1, -1): "0e0", (1, 0): "p_s", (1, 1): "1e0 + p_s"}
        cells = [(dy, dx, f"p_a * ({w})" + (" + (1e0 - p_a)" if (dy, dx) == (0, 0) else "")) for (dy, dx), w in base.items()]
        return filtered(df, channels, literal_kernel(cells), WEIGHTED, top)


@operator
class UnsharpMask(Gathered):
    blur_limit: tuple = (3, 7)
    sigma: float = 1.0
    alpha: tuple = (0.2, 0.5)
    threshold: int = 10
    p: float = 0.5

    def draws(self, d: Draws):
        return {"k": odd(d, "k", self.blur_limit), "a": d.between("a", *self.alpha)}

    def on_pixels(self, df, channels, top):
        residual = "($v - $b)"
        return smoothed(df, channels, "(p_k - 1) / 2", num(self.sigma), f"case when abs({residual}) * {num(255 / top)} > {self.threshold} then $v + p_a * {residual} else $v end", top)


@operator
class RingingOvershoot(Gathered):
    """A circular low-pass (jinc) kernel; its Bessel function is the integral of cos(t - x sin t)."""

    blur_limit: tuple = (7, 15)
    cutoff: tuple = (0.7853981633974483, 1.5707963267948966)
    p: float = 0.5

    def draws(self, d: Draws):
        return {"k": odd(d, "k", self.blur_limit), "c": d.between("c", *self.cutoff)}

    def on_pixels(self, df, channels, top):
        r, n = "cast((p_k - 1) / 2 as int)", 48
        rho = "sqrt(1e0 * dx * dx + dy * dy)"
        j1 = f"(aggregate(sequence(0, {n - 1}), 0e0, (s, t) -> s + cos((t + 0.5e0) * 3.141592653589793e0 / {n} - p_c * {rho} * sin((t + 0.5e0) * 3.141592653589793e0 / {n}))) / {n})"
        e = f"case when dx = 0 and dy = 0 then p_c * p_c / (4e0 * 3.141592653589793e0) else p_c * {j1} / (2e0 * 3.141592653589793e0 * {rho}) end"
        kernel = f"flatten(transform(sequence(-{r}, {r}), dy -> transform(sequence(-{r}, {r}), dx -> named_struct('dy', dy, 'dx', dx, 'wt', {e}))))"
        return filtered(df, channels, kernel, MEAN, top)


@operator
class Morphological(Gathered):
    scale: tuple = (2, 3)
    operation: str = "dilation"
    p: float = 0.5
    spatial = True

    def draws(self, d: Draws):
        return {"k": d.integer("k", *self.scale)}

    def on_pixels(self, df, channels, top):
        """An elliptical element of p_k x p_k."""
        r = "(p_k / 2e0)"
        cells = f"filter(flatten(transform(sequence(-cast(floor({r}) as int), cast(floor({r}) as int)), dy -> transform(sequence(-cast(floor({r}) as int), cast(floor({r}) as int)), dx -> named_struct('dy', dy, 'dx', dx, 'wt', 1e0)))), c -> c.dx * c.dx + c.dy * c.dy <= {r} * {r})"
        return filtered(df, channels, cells, f"array_{'max' if self.operation == 'dilation' else 'min'}(transform($n, n -> n.v))", None)

    def on_boxes(self, df):
        by = "floor(p_k / 2e0)" if self.operation == "dilation" else "(-floor(p_k / 2e0))"
        return moved(df, x_min=f"greatest(0e0, x_min - {by} / w)", y_min=f"greatest(0e0, y_min - {by} / h)", x_max=f"least(1e0, x_max + {by} / w)", y_max=f"least(1e0, y_max + {by} / h)")


def remap(df: DataFrame, channels: int, sy: str, sx: str, h: str = "h", w: str = "w", linear: bool = True, border: str = "constant", fill: float = 0.0, bind: tuple[dict[str, str], ...] = (), top: float | None = None, per_channel: list[tuple[str, str]] | None = None) -> DataFrame:
    """Output pixel (q.y, q.x) of an h x w sample shows the source at (sy, sx).

    Nearest takes floor(s + 0.5); linear mixes the four around. Outside is fill, or mirrored.
    """
    steps = [*bind, {"sy": sy, "sx": sx}]
    if per_channel:
        steps.append({f"s{a}{i}": e for i, pair_ in enumerate(per_channel) for a, e in zip("yx", pair_)})

    def tap(i: int, y: str, x: str) -> str:
        if border == "constant":
            return f"(case when {y} >= 0 and {y} < h and {x} >= 0 and {x} < w then a{i}[cast({y} * w + {x} as int)] else {num(fill)} end)"
        return f"a{i}[cast({reflected(y, 'h')} * w + {reflected(x, 'w')} as int)]"

    cell = {}
    for i, v in enumerate(values(channels)):
        y, x = (f"q.sy{i}", f"q.sx{i}") if per_channel else ("q.sy", "q.sx")
        if linear:
            fy, fx = f"cast(floor({y}) as bigint)", f"cast(floor({x}) as bigint)"
            ty, tx = f"({y} - floor({y}))", f"({x} - floor({x}))"
            e = f"((1e0 - {ty}) * ((1e0 - {tx}) * {tap(i, fy, fx)} + {tx} * {tap(i, fy, f'({fx} + 1)')}) + {ty} * ((1e0 - {tx}) * {tap(i, f'({fy} + 1)', fx)} + {tx} * {tap(i, f'({fy} + 1)', f'({fx} + 1)')}))"
            cell[v] = clipped(e, top) if top else e
        else:
            cell[v] = tap(i, f"cast(floor({y} + 0.5e0) as bigint)", f"cast(floor({x} + 0.5e0) as bigint)")
    return spread(grouped(df, channels), channels, cell, h, w, tuple(steps))


#: Ways to resample beside nearest and linear, with the taps on either side (area: as many as it covers).
TAPS = {"cubic": 2, "lanczos": 4, "area": 0}
#: The slope of the cubic at its first zero (fixed value).
CUBIC = -0.75


def weight(kind: str, t: str) -> str:
    """Weight of a tap at distance t."""
    if kind == "cubic":
        a, d = num(CUBIC), f"abs({t})"
        near = f"((({a} + 2e0) * {d} - ({a} + 3e0)) * {d} * {d} + 1e0)"
        return f"(case when {d} <= 1 then {near} when {d} < 2 then ((({a} * {d} - 5e0 * {a}) * {d} + 8e0 * {a}) * {d} - 4e0 * {a}) else 0e0 end)"
    pi = "3.141592653589793e0"
    return f"(case when {t} = 0 then 1e0 when abs({t}) >= 4 then 0e0 else sin({pi} * {t}) * sin({pi} * {t} / 4e0) / ({pi} * {pi} * {t} * {t} / 4e0) end)"


def taps(kind: str, at: str, low: str, high: str, size: str) -> str:
    """Array of (i, wt): the source pixels in [low, high) that output pixel `at` of `size` mixes.

    Beyond the edge the edge repeats. Area shares a pixel out by how much of it an output pixel covers;
    where it enlarges it mixes two pixels by where the output pixel's end lies.
    """
    n = f"(({high}) - ({low}))"
    scale = f"(1e0 * {n} / ({size}))"
    if kind != "area":
        r, s = TAPS[kind], f"(({at} + 0.5e0) * {scale} - 0.5e0)"
        return f"transform(sequence({1 - r}, {r}), k -> named_struct('i', cast(({low}) + greatest(0, least({n} - 1, floor({s}) + k)) as int), 'wt', {weight(kind, f'({s} - floor({s}) - k)')}))"
    a, b = f"({at} * {scale})", f"(({at} + 1) * {scale})"
    down = f"transform(sequence(cast(floor({a}) as int), cast(ceil({b}) as int) - 1), k -> named_struct('i', cast(({low}) + least({n} - 1, k) as int), 'wt', (least(k + 1e0, {b}) - greatest(1e0 * k, {a})) / {scale}))"
    end = f"({at} + 1 - (floor({a}) + 1) / {scale})"
    part = f"(case when {end} <= 0 then 0e0 else {end} - floor({end}) end)"
    up = f"array(named_struct('i', cast(({low}) + floor({a}) as int), 'wt', 1e0 - {part}), named_struct('i', cast(({low}) + least({n} - 1, floor({a}) + 1) as int), 'wt', {part}))"
    return f"(case when {scale} >= 1 then {down} else {up} end)"


def weighed(df: DataFrame, channels: int, kind: str, window: tuple[str, str, str, str], h: str, w: str, top: float) -> DataFrame:
    """Output pixels of an h x w sample as weighted sums over a window (y0, x0, y1, x1): a table of
    weights for its row and one for its column. Sums are taken to six decimals, so their order never shows."""
    y0, x0, y1, x1 = window
    total = lambda t: f"aggregate(q.{t}, 0e0, (s, c) -> s + c.wt)"
    bind = ({"ty": taps(kind, "q.y", y0, y1, h), "tx": taps(kind, "q.x", x0, x1, w)}, {"all": f"{total('ty')} * {total('tx')}"})
    row = lambda i: f"aggregate(q.tx, 0e0, (u, c) -> u + c.wt * a{i}[r.i * w + c.i])"
    cell = {v: clipped(f"round(aggregate(q.ty, 0e0, (s, r) -> s + r.wt * {row(i)}) / q.all, 6)", top) for i, v in enumerate(values(channels))}
    return spread(grouped(df, channels), channels, cell, h, w, bind)


class Resampled(Gathered):
    """Output size out_h, out_w, and the source of each output pixel."""

    spatial = True
    fill = 0.0
    border = "constant"
    linear = True

    def size(self) -> tuple[str, str]:
        return "h", "w"

    def out_size(self):
        return self.size()

    def source(self) -> tuple[str, str]:
        raise NotImplementedError

    def bind(self) -> tuple[dict[str, str], ...]:
        return ()

    def on_pixels(self, df, channels, top):
        h, w = self.size()
        return remap(df, channels, *self.source(), h, w, self.linear, self.border, self.fill, self.bind(), top)

    def on_masks(self, df, channels, top):
        h, w = self.size()
        return remap(df, 1, *self.source(), h, w, False, self.border, 0.0, self.bind())


class FreeForm(Resampled):
    """Warps that only say where an output pixel comes from.

    Where a source point shows is found in two steps. ROUNDS of q <- q - (source(q) - point) / 2 close in
    where the warp does not fold, between pixels and beyond the frame too; the place is taken if its
    source is within CLOSE of the point. Otherwise the point's whole distance map is searched: the output
    pixel whose source is nearest, of ties the first by row and column. Keypoints whose nearest source is
    further than LOST pixels are shown nowhere and go. Boxes become the extent of their corners and the
    middles of their sides, each at its nearest place.
    """

    ROUNDS, CLOSE, LOST = 24, 0.01, 2.0

    def back(self, x: str, y: str) -> str:
        """A struct d (squared distance of its source), y, x of where the source point (x, y) shows."""
        sy, sx = self.source()
        start = f"named_struct('y', cast({y} as double), 'x', cast({x} as double))"
        near = f"aggregate(sequence(1, {self.ROUNDS}), {start}, (q, i) -> named_struct('y', q.y - ({sy} - ({y})) / 2e0, 'x', q.x - ({sx} - ({x})) / 2e0))"
        far = f"(pow({sy} - ({y}), 2) + pow({sx} - ({x}), 2))"
        first = f"transform(array({near}), q -> named_struct('d', {far}, 'y', q.y, 'x', q.x))"
        cell = f"named_struct('d', {far.replace('q.y', '(1e0 * r)').replace('q.x', '(1e0 * k)')}, 'y', 1e0 * r, 'x', 1e0 * k)"
        row = f"aggregate(sequence(0, cast(w as int) - 1), best, (least_, k) -> least(least_, {cell}))"
        every = f"aggregate(sequence(0, cast(h as int) - 1), named_struct('d', cast('infinity' as double), 'y', -1e0, 'x', -1e0), (best, r) -> {row})"
        return f"transform({first}, t -> case when t.d <= {num(self.CLOSE**2)} then t when t.d is null then null else {every} end)[0]"

    def on_keypoints(self, df):
        placed = df.withColumn("__q", F.expr(self.back("x", "y"))).where(f"coalesce(__q.d <= {num(self.LOST**2)}, true)")
        return moved(placed, x="__q.x", y="__q.y").drop("__q")

    def on_boxes(self, df):
        places = [(i, j) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
        at = lambda lo, hi, k, side: f"(({lo} * {2 - k} + {hi} * {k}) / 2e0 * {side} - 0.5e0)"
        points = ", ".join(f"named_struct('x', {at('x_min', 'x_max', i, 'w')}, 'y', {at('y_min', 'y_max', j, 'h')})" for i, j in places)
        df = df.withColumn("__q", F.expr(f"transform(array({points}), o -> {self.back('o.x', 'o.y')})"))
        new = {f"{a}_{n}": f"(array_{n}(transform(__q, q -> q.{a})) + 0.5e0) / {side}" for a, side in (("x", "w"), ("y", "h")) for n in ("min", "max")}
        return moved(df, **new).drop("__q")


class Scaled(Resampled):
    border = "mirror"
    interpolation = None

    def source(self):
        h, w = self.size()
        return f"((q.y + 0.5e0) * h / ({h}) - 0.5e0)", f"((q.x + 0.5e0) * w / ({w}) - 0.5e0)"

    def way(self) -> str:
        """interpolation, or what linear says."""
        found = self.interpolation or ("linear" if self.linear else "nearest")
        if found not in ("nearest", "linear", *TAPS):
            raise ValueError(f"{self.name}: no interpolation {found!r}")
        return found

    def on_pixels(self, df, channels, top):
        h, w = self.size()
        if (way := self.way()) in TAPS:
            return weighed(df, channels, way, ("0", "0", "h", "w"), h, w, top)
        y, x = self.source()
        edge = (f"greatest(0e0, least(h - 1e0, {y}))", f"greatest(0e0, least(w - 1e0, {x}))")
        return remap(df, channels, *edge, h, w, way == "linear", "mirror", 0.0, (), top)

    def on_masks(self, df, channels, top):
        h, w = self.size()
        return remap(df, 1, f"floor(q.y * h / ({h}))", f"floor(q.x * w / ({w}))", h, w, False, "mirror")

    def on_boxes(self, df):
        h, w = self.size()
        return moved(df, h=h, w=w)

    def on_keypoints(self, df):
        h, w = self.size()
        return moved(df, x=f"x * ({w}) / w", y=f"y * ({h}) / h", scale=f"scale * greatest(1e0 * ({w}) / w, 1e0 * ({h}) / h)", h=h, w=w)


@operator
class Resize(Scaled):
    height: int = 4
    width: int = 4
    linear: bool = True
    interpolation: str | None = None  # nearest, linear, cubic, area or lanczos
    p: float = 1.0

    def size(self):
        return str(self.height), str(self.width)


@operator
class RandomScale(Scaled):
    scale_limit: tuple | float = (-0.1, 0.1)
    linear: bool = True
    interpolation: str | None = None  # nearest, linear, cubic, area or lanczos
    p: float = 0.5

    def draws(self, d: Draws):
        return {"s": f"(1e0 + {d.between('s', *pair(self.scale_limit))})"}

    def size(self):
        return "greatest(1, cast(floor(h * p_s) as int))", "greatest(1, cast(floor(w * p_s) as int))"


@operator
class LongestMaxSize(Scaled):
    max_size: int = 1024
    linear: bool = True
    interpolation: str | None = None  # nearest, linear, cubic, area or lanczos
    p: float = 1.0

    def size(self):
        return tuple(f"greatest(1, cast(floor({s} * {self.max_size} / greatest(h, w) + 0.5e0) as int))" for s in "hw")


@operator
class SmallestMaxSize(Scaled):
    max_size: int = 1024
    linear: bool = True
    interpolation: str | None = None  # nearest, linear, cubic, area or lanczos
    p: float = 1.0

    def size(self):
        return tuple(f"greatest(1, cast(floor({s} * {self.max_size} / least(h, w) + 0.5e0) as int))" for s in "hw")


@operator
class Downscale(Gathered):
    scale_range: tuple = (0.25, 0.25)
    p: float = 0.5

    def draws(self, d: Draws):
        return {"s": d.between("s", *self.scale_range)}

    def on_pixels(self, df, channels, top):
        """Nearest down to h * s and up again: both index maps composed."""
        def index(q: str, n: str) -> str:
            small = f"greatest(1, cast(floor({n} * p_s) as int))"
            return f"floor(floor({q} * {small} / {n}) * {n} / {small})"

        return remap(df, channels, index("q.y", "h"), index("q.x", "w"), linear=False)


class CropResized(Resampled):
    """A window p_x0, p_y0, p_x1, p_y1 shown at height x width."""

    border = "mirror"
    interpolation = None

    def on_pixels(self, df, channels, top):
        if (way := Scaled.way(self)) in TAPS:
            return weighed(df, channels, way, ("p_y0", "p_x0", "p_y1", "p_x1"), *self.size(), top)
        return remap(df, channels, *self.source(), *self.size(), way == "linear", self.border, self.fill, self.bind(), top)

    def size(self):
        return str(self.height), str(self.width)

    def source(self):
        y = f"(p_y0 + (q.y + 0.5e0) * (p_y1 - p_y0) / {self.height} - 0.5e0)"
        x = f"(p_x0 + (q.x + 0.5e0) * (p_x1 - p_x0) / {self.width} - 0.5e0)"
        return f"greatest(1e0 * p_y0, least(p_y1 - 1e0, {y}))", f"greatest(1e0 * p_x0, least(p_x1 - 1e0, {x}))"

    def on_boxes(self, df):
        return moved(df, x_min="(x_min * w - p_x0) / (p_x1 - p_x0)", x_max="(x_max * w - p_x0) / (p_x1 - p_x0)", y_min="(y_min * h - p_y0) / (p_y1 - p_y0)", y_max="(y_max * h - p_y0) / (p_y1 - p_y0)", h=str(self.height), w=str(self.width))

    def on_keypoints(self, df):
        fx, fy = f"({self.width}e0 / (p_x1 - p_x0))", f"({self.height}e0 / (p_y1 - p_y0))"
        return moved(df, x=f"(x - p_x0) * {fx}", y=f"(y - p_y0) * {fy}", scale=f"scale * greatest({fx}, {fy})", h=str(self.height), w=str(self.width))


@operator
class RandomSizedCrop(CropResized):
    min_max_height: tuple = (4, 8)
    height: int = 8
    width: int = 8
    w2h_ratio: float = 1.0
    linear: bool = True
    interpolation: str | None = None  # nearest, linear, cubic, area or lanczos
    p: float = 1.0

    def draws(self, d: Draws):
        ch = f"least(h, {d.integer('ch', *self.min_max_height)})"
        cw = f"least(w, cast(floor({ch} * {num(self.w2h_ratio)}) as int))"
        y0, x0 = f"cast(floor((h - {ch} + 1) * {d.unit('y')}) as int)", f"cast(floor((w - {cw} + 1) * {d.unit('x')}) as int)"
        return {"y0": y0, "x0": x0, "y1": f"({y0} + {ch})", "x1": f"({x0} + {cw})"}


@operator
class RandomResizedCrop(CropResized):
    """Ten tries of area and aspect; the first that fits, or else the centre at the nearest aspect."""

    height: int = 8
    width: int = 8
    scale: tuple = (0.08, 1.0)
    ratio: tuple = (0.75, 1.3333333333333333)
    linear: bool = True
    interpolation: str | None = None  # nearest, linear, cubic, area or lanczos
    p: float = 1.0

    def draws(self, d: Draws):
        from math import log

        area = f"({d.between('area', *self.scale, 't')} * h * w)"
        aspect = f"exp({d.between('ratio', log(self.ratio[0]), log(self.ratio[1]), 't')})"
        tries = f"transform(sequence(0, 9), t -> named_struct('cw', cast(floor(sqrt({area} * {aspect}) + 0.5e0) as int), 'ch', cast(floor(sqrt({area} / {aspect}) + 0.5e0) as int)))"
        first = f"filter({tries}, c -> c.cw > 0 and c.cw <= w and c.ch > 0 and c.ch <= h)"
        lo, hi = num(self.ratio[0]), num(self.ratio[1])
        cw = f"coalesce(get({first}, 0).cw, case when 1e0 * w / h > {hi} then cast(floor(h * {hi} + 0.5e0) as int) else w end)"
        ch = f"coalesce(get({first}, 0).ch, case when 1e0 * w / h < {lo} then cast(floor(w / {lo} + 0.5e0) as int) else h end)"
        y0, x0 = f"cast(floor((h - {ch} + 1) * {d.unit('y')}) as int)", f"cast(floor((w - {cw} + 1) * {d.unit('x')}) as int)"
        return {"y0": y0, "x0": x0, "y1": f"({y0} + {ch})", "x1": f"({x0} + {cw})"}


@operator
class RandomSizedBBoxSafeCrop(CropResized):
    """A window that holds the union of the boxes (columns ux0 ...), shown at height x width."""

    height: int = 8
    width: int = 8
    erosion_rate: float = 0.0
    linear: bool = True
    interpolation: str | None = None  # nearest, linear, cubic, area or lanczos
    p: float = 1.0

    def draws(self, d: Draws):
        from .geometry import BBoxSafeRandomCrop

        out = BBoxSafeRandomCrop(erosion_rate=self.erosion_rate).draws(d)
        return out | {"x1": f"least(w, {out['x1']})", "y1": f"least(h, {out['y1']})"}


class Projected(Resampled):
    """Warps by a 3 x 3 matrix: m() maps output to source pixels, forward() source to output."""

    def matrix(self) -> tuple[str, ...]:
        """a, b, c, d, e, f, g, k of source x = (ax + by + c) / (gx + ky + 1), y = (dx + ey + f) / ..."""
        raise NotImplementedError

    def source(self):
        a, b, c, d, e, f, g, k = self.matrix()
        z = f"(({g}) * q.x + ({k}) * q.y + 1e0)"
        return f"((({d}) * q.x + ({e}) * q.y + ({f})) / {z})", f"((({a}) * q.x + ({b}) * q.y + ({c})) / {z})"


class AffineWarp(Projected):
    """Scale, shear, rotation (radians) and shift about the centre, as draws p_sx, p_sy, p_hx, p_hy, p_a, p_tx, p_ty.

    framed: only the part at p_fx, p_fy of size p_fw x p_fh is shown, on the canvas of the sample.
    """

    rotate_method = "largest_box"
    framed = False

    def size(self):
        return ("p_fh", "p_fw") if self.framed else ("h", "w")

    def shown(self, df: DataFrame, x_min: str, y_min: str, x_max: str, y_max: str) -> DataFrame:
        """Boxes at these places of the canvas (pixels), as shares of what is shown."""
        if not self.framed:
            return moved(df, x_min=f"({x_min}) / w", x_max=f"({x_max}) / w", y_min=f"({y_min}) / h", y_max=f"({y_max}) / h")
        return moved(df, x_min=f"(({x_min}) - p_fx) / p_fw", x_max=f"(({x_max}) - p_fx) / p_fw", y_min=f"(({y_min}) - p_fy) / p_fh", y_max=f"(({y_max}) - p_fy) / p_fh", h="p_fh", w="p_fw")

    def forward(self) -> dict[str, str]:
        """Entries of translate * shear * rotate * scale about the centre (linear part)."""
        c, s = "cos(p_a)", "sin(p_a)"
        r = {"a": f"({c} * p_sx)", "b": f"(-{s} * p_sy)", "d": f"({s} * p_sx)", "e": f"({c} * p_sy)"}
        return {"a": f"({r['a']} + p_hx * {r['d']})", "b": f"({r['b']} + p_hx * {r['e']})", "d": f"({r['d']} + p_hy * {r['a']})", "e": f"({r['e']} + p_hy * {r['b']})"}

    def matrix(self):
        m = self.forward()
        det = f"({m['a']} * {m['e']} - {m['b']} * {m['d']})"
        cx, cy = "(w / 2e0 - 0.5e0)", "(h / 2e0 - 0.5e0)"
        a, b, d, e = f"({m['e']} / {det})", f"(-{m['b']} / {det})", f"(-{m['d']} / {det})", f"({m['a']} / {det})"
        left, above = (f"({cx} + p_tx - p_fx)", f"({cy} + p_ty - p_fy)") if self.framed else (f"({cx} + p_tx)", f"({cy} + p_ty)")
        return a, b, f"({cx} - {a} * {left} - {b} * {above})", d, e, f"({cy} - {d} * {left} - {e} * {above})", "0e0", "0e0"

    def point(self, x: str, y: str, cx: str, cy: str) -> tuple[str, str]:
        m = self.forward()
        return f"({m['a']} * ({x} - {cx}) + {m['b']} * ({y} - {cy}) + {cx} + p_tx)", f"({m['d']} * ({x} - {cx}) + {m['e']} * ({y} - {cy}) + {cy} + p_ty)"

    def on_boxes(self, df):
        """Boxes turn about (w / 2, h / 2): the smallest box around their corners, or their ellipse."""
        cx, cy = "(w / 2e0)", "(h / 2e0)"
        if self.rotate_method == "ellipse":
            m = self.forward()
            mx, my = self.point("((x_min + x_max) / 2e0 * w)", "((y_min + y_max) / 2e0 * h)", cx, cy)
            hx, hy = "((x_max - x_min) / 2e0 * w)", "((y_max - y_min) / 2e0 * h)"
            rx, ry = f"sqrt(pow({m['a']} * {hx}, 2) + pow({m['b']} * {hy}, 2))", f"sqrt(pow({m['d']} * {hx}, 2) + pow({m['e']} * {hy}, 2))"
            return self.shown(df, f"{mx} - {rx}", f"{my} - {ry}", f"{mx} + {rx}", f"{my} + {ry}")
        corners = [self.point(f"({x} * w)", f"({y} * h)", cx, cy) for x in ("x_min", "x_max") for y in ("y_min", "y_max")]
        xs, ys = ", ".join(c[0] for c in corners), ", ".join(c[1] for c in corners)
        return self.shown(df, f"least({xs})", f"least({ys})", f"greatest({xs})", f"greatest({ys})")

    def on_keypoints(self, df):
        x, y = self.point("x", "y", "(w / 2e0 - 0.5e0)", "(h / 2e0 - 0.5e0)")
        new = {"x": f"{x} - p_fx", "y": f"{y} - p_fy", "h": "p_fh", "w": "p_fw"} if self.framed else {"x": x, "y": y}
        return moved(df, **new, angle=angle("angle + p_a"), scale="scale * greatest(p_sx, p_sy)")


def inscribed(a: str) -> dict[str, str]:
    """The largest upright rectangle within a sample that has turned by a: corner and size in whole pixels.

    Where the sample is narrow against its turn, two corners lie on its long sides at half its width; else
    all four sides touch, and width and height solve w = W cos + H sin, h = W sin + H cos.
    """
    s, c = f"abs(sin({a}))", f"abs(cos({a}))"
    long, short = "greatest(w, h)", "least(w, h)"
    narrow = f"({short} <= 2e0 * {s} * {c} * {long} or abs({s} - {c}) < 1e-10)"
    part = lambda u, v, first, second: f"(case when {narrow} then 0.5e0 * {short} / (case when w >= h then {first} else {second} end) else ({u} * {c} - {v} * {s}) / ({c} * {c} - {s} * {s}) end)"
    out = {}
    for n, side, size in (("x", "w", part("w", "h", s, c)), ("y", "h", part("h", "w", c, s))):
        low = f"cast(greatest(0e0, floor({side} / 2e0 - {size} / 2e0)) as int)"
        out |= {f"f{n}": low, f"f{side}": f"greatest(1, cast(least(1e0 * {side}, floor({side} / 2e0 + {size} / 2e0)) as int) - {low})"}
    return out


def circumscribed(op: AffineWarp, draws: dict[str, str]) -> dict[str, str]:
    """The canvas that holds the whole warped sample: the least corner (between pixels) and its size."""
    corners = [op.point(x, y, "(w / 2e0 - 0.5e0)", "(h / 2e0 - 0.5e0)") for x in ("0e0", "(w - 1e0)") for y in ("0e0", "(h - 1e0)")]
    out = {}
    for i, (n, side) in enumerate((("x", "w"), ("y", "h"))):
        ends = ", ".join(c[i] for c in corners)
        for k, v in draws.items():
            ends = re.sub(rf"\bp_{k}\b", lambda _, v=v: f"({v})", ends)
        size = f"cast(ceil(greatest({ends}) - least({ends}) + 1e0 - 1e-9) as int)"
        out |= {f"f{n}": f"least({ends})", f"f{side}": size}
    return out


@operator
class Affine(AffineWarp):
    scale: tuple = (1.0, 1.0)
    translate_percent: tuple = (0.0, 0.0)
    translate_px: tuple = (0, 0)
    rotate: tuple | float = (0.0, 0.0)
    shear: tuple | float = (0.0, 0.0)
    keep_ratio: bool = False
    balanced_scale: bool = False
    fit_output: bool = False  # the output holds the whole warped sample
    rotate_method: str = "largest_box"
    border: str = "constant"
    fill: float = 0.0
    linear: bool = True
    p: float = 0.5

    def draws(self, d: Draws):
        lo, hi = self.scale
        def scale(n: str) -> str:
            if self.balanced_scale and lo < 1 < hi:
                return f"(case when {d.unit(n + 'side')} < 0.5e0 then {d.between(n, lo, 1)} else {d.between(n, 1, hi)} end)"
            return d.between(n, lo, hi)

        px, pc = self.translate_px, self.translate_percent
        out = {
            "sx": scale("sx"), "sy": scale("sx" if self.keep_ratio else "sy"),
            "hx": f"tan(radians(-{d.between('hx', *pair(self.shear))}))", "hy": "0e0",
            "a": f"radians({d.between('a', *pair(self.rotate))})",
            "tx": f"(cast({d.integer('tx', *px)} as double) + {d.between('cx', *pc)} * w)", "ty": f"(cast({d.integer('ty', *px)} as double) + {d.between('cy', *pc)} * h)",
        }
        return out | (circumscribed(self, out) if self.fit_output else {})

    @property
    def framed(self):
        return self.fit_output


@operator
class ShiftScaleRotate(AffineWarp):
    shift_limit: tuple | float = (-0.0625, 0.0625)
    scale_limit: tuple | float = (-0.1, 0.1)
    rotate_limit: tuple | float = (-45, 45)
    rotate_method: str = "largest_box"
    border: str = "constant"
    fill: float = 0.0
    linear: bool = True
    p: float = 0.5

    def draws(self, d: Draws):
        s = f"(1e0 + {d.between('s', *pair(self.scale_limit))})"
        return {"sx": s, "sy": s, "hx": "0e0", "hy": "0e0", "a": f"radians({d.between('a', *pair(self.rotate_limit))})", "tx": f"({d.between('tx', *pair(self.shift_limit))} * w)", "ty": f"({d.between('ty', *pair(self.shift_limit))} * h)"}


@operator
class Rotate(AffineWarp):
    limit: tuple | float = (-90, 90)
    rotate_method: str = "largest_box"
    border: str = "constant"
    fill: float = 0.0
    linear: bool = True
    crop_border: bool = False  # only the largest rectangle without a border is shown
    p: float = 0.5

    def draws(self, d: Draws):
        a = f"radians({d.between('a', *pair(self.limit))})"
        return {"sx": "1e0", "sy": "1e0", "hx": "0e0", "hy": "0e0", "a": a, "tx": "0e0", "ty": "0e0"} | (inscribed(a) if self.crop_border else {})

    @property
    def framed(self):
        return self.crop_border


@operator
class SafeRotate(AffineWarp):
    """The rotated sample is scaled to fit its frame."""

    limit: tuple | float = (-90, 90)
    rotate_method: str = "largest_box"
    border: str = "constant"
    fill: float = 0.0
    linear: bool = True
    p: float = 0.5

    def draws(self, d: Draws):
        a = f"radians({d.between('a', *pair(self.limit))})"
        nw, nh = f"floor(h * abs(sin({a})) + w * abs(cos({a})))", f"floor(h * abs(cos({a})) + w * abs(sin({a})))"
        return {"sx": f"(w / {nw})", "sy": f"(h / {nh})", "hx": "0e0", "hy": "0e0", "a": a, "tx": "0e0", "ty": "0e0"}

    def forward(self):
        """Rotation first, then the scale of the frame."""
        c, s = "cos(p_a)", "sin(p_a)"
        return {"a": f"({c} * p_sx)", "b": f"(-{s} * p_sx)", "d": f"({s} * p_sy)", "e": f"({c} * p_sy)"}


@operator
class Perspective(Projected):
    """The quadrilateral of four moved corners fills the frame.

    The matrix from the unit square to a quadrilateral is the closed form of a projective map.
    """

    scale: tuple = (0.05, 0.1)
    border: str = "constant"
    fill: float = 0.0
    linear: bool = True
    p: float = 0.5

    def draws(self, d: Draws):
        s, out = d.between("s", *self.scale), {}
        for i, (fx, fy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1))):
            for a, f, side in (("x", fx, "w"), ("y", fy, "h")):
                off = f"(abs({d.normal(f'{a}{i}')}) * {s} - floor(abs({d.normal(f'{a}{i}')}) * {s} / 0.32e0) * 0.32e0)"
                out[f"{a}{i}"] = f"(({off}) * ({side} - 1))" if f == 0 else f"((1e0 - {off}) * ({side} - 1))"
        return out

    def matrix(self):
        dx1, dx2, sx = "(p_x1 - p_x2)", "(p_x3 - p_x2)", "(p_x0 - p_x1 + p_x2 - p_x3)"
        dy1, dy2, sy = "(p_y1 - p_y2)", "(p_y3 - p_y2)", "(p_y0 - p_y1 + p_y2 - p_y3)"
        den = f"({dx1} * {dy2} - {dx2} * {dy1})"
        g, k = f"(({sx} * {dy2} - {dx2} * {sy}) / {den})", f"(({dx1} * {sy} - {sx} * {dy1}) / {den})"
        mx, my = "greatest(1e0, w - 1e0)", "greatest(1e0, h - 1e0)"
        return (f"((p_x1 - p_x0 + {g} * p_x1) / {mx})", f"((p_x3 - p_x0 + {k} * p_x3) / {my})", "p_x0", f"((p_y1 - p_y0 + {g} * p_y1) / {mx})", f"((p_y3 - p_y0 + {k} * p_y3) / {my})", "p_y0", f"({g} / {mx})", f"({k} / {my})")

    def back(self, x: str, y: str) -> tuple[str, str]:
        """Where a source point shows: the inverse matrix (adjugate)."""
        a, b, c, d, e, f, g, k = self.matrix()
        u = [f"({e} - {f} * {k})", f"({c} * {k} - {b})", f"({b} * {f} - {c} * {e})"]
        v = [f"({f} * {g} - {d})", f"({a} - {c} * {g})", f"({c} * {d} - {a} * {f})"]
        z = [f"({d} * {k} - {e} * {g})", f"({b} * {g} - {a} * {k})", f"({a} * {e} - {b} * {d})"]
        row = lambda r: f"({r[0]} * {x} + {r[1]} * {y} + {r[2]})"
        return f"({row(u)} / {row(z)})", f"({row(v)} / {row(z)})"

    def on_boxes(self, df):
        corners = [self.back(f"({x} * w)", f"({y} * h)") for x in ("x_min", "x_max") for y in ("y_min", "y_max")]
        xs, ys = ", ".join(c[0] for c in corners), ", ".join(c[1] for c in corners)
        return moved(df, x_min=f"least({xs}) / w", x_max=f"greatest({xs}) / w", y_min=f"least({ys}) / h", y_max=f"greatest({ys}) / h")

    def on_keypoints(self, df):
        x, y = self.back("x", "y")
        return moved(df, x=x, y=y)


@operator
class OpticalDistortion(FreeForm):
    distort_limit: tuple | float = (-0.05, 0.05)
    mode: str = "camera"
    border: str = "constant"
    fill: float = 0.0
    linear: bool = True
    p: float = 0.5

    def draws(self, d: Draws):
        return {"k": d.between("k", *pair(self.distort_limit))}

    def source(self):
        if self.mode == "camera":
            u, v = "((q.x - w / 2e0) / w)", "((q.y - h / 2e0) / h)"
            r2 = f"({u} * {u} + {v} * {v})"
            f = f"(1e0 + p_k * {r2} + p_k * {r2} * {r2})"
            return f"({v} * {f} * h + h / 2e0)", f"({u} * {f} * w + w / 2e0)"
        u, v = "(q.x - w / 2e0)", "(q.y - h / 2e0)"
        f = f"(1e0 + p_k * ({u} * {u} + {v} * {v}) / ((w * w + h * h) / 4e0))"
        return f"({v} * {f} + h / 2e0)", f"({u} * {f} + w / 2e0)"


@operator
class ChromaticAberration(Gathered):
    primary_distortion_limit: tuple | float = (-0.02, 0.02)
    secondary_distortion_limit: tuple | float = (-0.05, 0.05)
    mode: str = "green_purple"
    p: float = 0.5

    def draws(self, d: Draws):
        out = {n: d.between(n, *pair(limit)) for i in "rb" for n, limit in ((f"{i}1", self.primary_distortion_limit), (f"{i}2", self.secondary_distortion_limit))}
        sign = {"green_purple": 1, "red_blue": -1}.get(self.mode)
        return out | ({f"b{k}": f"({sign} * sign({out[f'r{k}']}) * abs({out[f'b{k}']}))" for k in (1, 2)} if sign else {})

    def on_pixels(self, df, channels, top):
        u, v = "((q.x - w / 2e0) / w)", "((q.y - h / 2e0) / h)"
        r2 = f"({u} * {u} + {v} * {v})"
        f = [f"(1e0 + p_{c}1 * {r2} + p_{c}2 * {r2} * {r2})" if c else "1e0" for c in ("r", "", "b")]
        maps = [(f"({v} * {x} * h + h / 2e0)", f"({u} * {x} * w + w / 2e0)") for x in f]
        return remap(df, 3, "q.y", "q.x", border="mirror", top=top, per_channel=maps)


@operator
class GridDistortion(FreeForm):
    """Steps of a grid are stretched by random factors; coordinates run linearly within a step."""

    num_steps: int = 5
    distort_limit: tuple | float = (-0.3, 0.3)
    border: str = "constant"
    fill: float = 0.0
    linear: bool = True
    p: float = 0.5

    def draws(self, d: Draws):
        n = self.num_steps
        out = {}
        for a in "xy":
            f = [f"(1e0 + {d.between(f'{a}{i}', *pair(self.distort_limit))})" for i in range(n)]
            total = f"({' + '.join(f)})"
            for i in range(n + 1):
                out[f"{a}{i}"] = f"(({' + '.join(f[:i]) or '0e0'}) / {total})"  # keeps the extent
        return out

    def source(self):
        def at(q: str, side: str, a: str) -> str:
            cut = f"({q} * {self.num_steps}e0 / greatest(1, {side} - 1))"
            cases = " ".join(f"when {cut} < {i + 1} then p_{a}{i} + ({cut} - {i}) * (p_{a}{i + 1} - p_{a}{i})" for i in range(self.num_steps))
            return f"((case {cases} else p_{a}{self.num_steps} end) * ({side} - 1))"

        return at("q.y", "h", "y"), at("q.x", "w", "x")


@operator
class ElasticTransform(FreeForm):
    """Displacements are a sum of random waves of the given smoothness: a Gaussian random field."""

    alpha: float = 1.0
    sigma: float = 2.0
    waves: int = 12
    same_dxdy: bool = False
    border: str = "constant"
    fill: float = 0.0
    linear: bool = True
    p: float = 0.5

    def draws(self, d: Draws):
        out = {}
        for a in "xy":
            n = "x" if self.same_dxdy else a
            for i in range(self.waves):
                out |= {f"{a}u{i}": f"({d.normal(f'{n}u{i}')} / {num(self.sigma)})", f"{a}v{i}": f"({d.normal(f'{n}v{i}')} / {num(self.sigma)})", f"{a}f{i}": d.between(f"{n}f{i}", 0, 6.283185307179586)}
        return out

    def source(self):
        def shift(a: str) -> str:
            return f"({num(self.alpha * (2 / self.waves) ** 0.5)} * ({' + '.join(f'cos(p_{a}u{i} * q.x + p_{a}v{i} * q.y + p_{a}f{i})' for i in range(self.waves))}))"

        return f"(q.y + {shift('y')})", f"(q.x + {shift('x')})"


class ControlPoints(FreeForm):
    """A grid of control points with random shifts p_dx<i>, p_dy<i> (pixels)."""

    def points(self) -> list[tuple[str, str]]:
        raise NotImplementedError

    def weighted(self, weight) -> tuple[str, str]:
        """The shifts, weighted by a function of the squared distance to each point."""
        ws = [weight(f"((q.x - {x}) * (q.x - {x}) + (q.y - {y}) * (q.y - {y}))") for x, y in self.points()]
        total = " + ".join(ws)
        return tuple(f"(q.{a} + ({' + '.join(f'{w} * p_d{a}{i}' for i, w in enumerate(ws))}) / ({total}))" for a in "yx")


@operator
class PiecewiseAffine(ControlPoints):
    scale: tuple = (0.03, 0.05)
    nb_rows: int = 4
    nb_cols: int = 4
    border: str = "constant"
    fill: float = 0.0
    linear: bool = True
    p: float = 0.5

    def draws(self, d: Draws):
        s = f"({d.between('s', *self.scale)} * least(h, w) / 3e0)"
        return {f"d{a}{i}": f"({d.normal(f'{a}{i}')} * {s})" for a in "xy" for i in range(self.nb_rows * self.nb_cols)}

    def points(self):
        return [(f"((w - 1) * {c}e0 / {max(1, self.nb_cols - 1)})", f"((h - 1) * {r}e0 / {max(1, self.nb_rows - 1)})") for r in range(self.nb_rows) for c in range(self.nb_cols)]

    def source(self):
        return self.weighted(lambda d2: f"(1e0 / ({d2} + 1e-6))")


@operator
class ThinPlateSpline(ControlPoints):
    """Control points move at random; the thin-plate solve is for the fixed unit grid, so its inverse
    is made once on the driver and the warp is a linear form in the draws."""

    scale_range: tuple = (0.2, 0.4)
    num_control_points: int = 4
    border: str = "constant"
    fill: float = 0.0
    linear: bool = True
    p: float = 0.5

    def draws(self, d: Draws):
        s = f"({d.between('s', *self.scale_range)} / 10e0)"
        return {f"d{a}{i}": f"({d.normal(f'{a}{i}')} * {s})" for a in "xy" for i in range(self.num_control_points**2)}

    def source(self):
        import numpy as np

        n = self.num_control_points
        grid = np.array([(c / max(1, n - 1), r / max(1, n - 1)) for r in range(n) for c in range(n)])
        d2 = ((grid[:, None] - grid[None]) ** 2).sum(-1)
        k = np.where(d2 > 0, d2 * np.log(d2 + (d2 == 0)), 0) / 2
        q = np.hstack([np.ones((len(grid), 1)), grid])
        system = np.block([[k + 1e-9 * np.eye(len(grid)), q], [q.T, np.zeros((3, 3))]])
        solve = np.linalg.inv(system)[:, : len(grid)]
        u, v = "(q.x / greatest(1e0, w - 1e0))", "(q.y / greatest(1e0, h - 1e0))"
        out = []
        for a, side in (("y", "h"), ("x", "w")):
            coef = [" + ".join(f"{num(c)} * p_d{a}{j}" for j, c in enumerate(row) if abs(c) > 1e-12) or "0e0" for row in solve]
            terms = []
            for (gx, gy), c in zip(grid.tolist(), coef):
                r2 = f"(({u} - {num(gx)}) * ({u} - {num(gx)}) + ({v} - {num(gy)}) * ({v} - {num(gy)}))"
                terms.append(f"({c}) * (case when {r2} > 0 then {r2} * ln({r2}) / 2e0 else 0e0 end)")
            flat = f"({coef[-3]}) + ({coef[-2]}) * {u} + ({coef[-1]}) * {v}"
            out.append(f"(q.{a} + ({' + '.join([*terms, flat])}) * ({side} - 1))")
        return tuple(out)


@operator
class GridElasticDeform(ControlPoints):
    """Corners of a grid's cells move by up to magnitude pixels; cells follow bilinearly."""

    num_grid_xy: tuple = (2, 2)
    magnitude: int = 2
    border: str = "mirror"
    fill: float = 0.0
    linear: bool = True
    p: float = 1.0

    def draws(self, d: Draws):
        cols, rows = self.num_grid_xy
        out = {}
        for r in range(rows + 1):
            for c in range(cols + 1):
                for a, fixed in (("x", c in (0, cols)), ("y", r in (0, rows))):
                    i = r * (cols + 1) + c
                    out[f"d{a}{i}"] = "0e0" if fixed else d.between(f"{a}{i}", -self.magnitude, self.magnitude)
        return out

    def source(self):
        cols, rows = self.num_grid_xy
        u, v = f"(q.x * {cols}e0 / greatest(1, w - 1))", f"(q.y * {rows}e0 / greatest(1, h - 1))"
        hat = lambda t, i: f"greatest(0e0, 1e0 - abs({t} - {i}))"
        return tuple(f"(q.{a} + {' + '.join(f'{hat(u, c)} * {hat(v, r)} * p_d{a}{r * (cols + 1) + c}' for r in range(rows + 1) for c in range(cols + 1))})" for a in "yx")


@operator
class ZoomBlur(Gathered):
    """The mean over zooms 1, 1 + step ... about the centre."""

    max_factor: tuple = (1.0, 1.31)
    step_factor: tuple = (0.01, 0.03)
    p: float = 0.5

    def draws(self, d: Draws):
        return {"max": f"greatest(1e0, {d.between('max', *self.max_factor)})", "step": d.between("step", *self.step_factor)}

    def on_pixels(self, df, channels, top):
        rows = grouped(df, channels)
        zooms = "transform(sequence(0, cast(floor((p_max - 1e0) / p_step) as int)), k -> 1e0 + k * p_step)"
        cell = {}
        for i, v in enumerate(values(channels)):
            y, x = "((q.y - (h - 1) / 2e0) / z + (h - 1) / 2e0)", "((q.x - (w - 1) / 2e0) / z + (w - 1) / 2e0)"
            fy, fx = f"cast(floor({y}) as int)", f"cast(floor({x}) as int)"
            tap = lambda dy, dx, i=i, fy=fy, fx=fx: f"a{i}[least(h - 1, {fy} + {dy}) * w + least(w - 1, {fx} + {dx})]"
            ty, tx = f"({y} - floor({y}))", f"({x} - floor({x}))"
            one = f"((1e0 - {ty}) * ((1e0 - {tx}) * {tap(0, 0)} + {tx} * {tap(0, 1)}) + {ty} * ((1e0 - {tx}) * {tap(1, 0)} + {tx} * {tap(1, 1)}))"
            cell[v] = clipped(f"(aggregate({zooms}, 0e0, (s, z) -> s + {one}) / size({zooms}))", top)
        return spread(rows, channels, cell)
