"""Operators on values alone: a chain of them is one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlane.functions import colour
from rasterlane.functions.sampling import Draws, num

from .base import Operator, clipped, operator, pair, pointwise, values


def scaled(df: DataFrame, top: float) -> DataFrame:
    """With r, g, b in [0, 1]."""
    return df.withColumns({n: F.expr(f"v{i} / {num(top)}") for i, n in enumerate("rgb")})


def recoloured(df: DataFrame, top: float, rgb: list[str]) -> DataFrame:
    return df.withColumns({f"v{i}": F.expr(clipped(f"({e}) * {num(top)}", top)) for i, e in enumerate(rgb)})


def into_space(df: DataFrame, space: str, top: float) -> DataFrame:
    """v0, v1, v2 as the space's axes, each over 0 to 255: lab (L* stretched, a* and b* moved by 128), ycrcb, hsv."""
    a, b, c = colour.SPACES[space][0]("r", "g", "b")
    stretch = {"lab": (f"{a} * 2.55e0", f"{b} + 128e0", f"{c} + 128e0"), "ycrcb": tuple(f"{x} * 255e0" for x in (a, b, c)), "hsv": (f"{a} * 42.5e0", f"{b} * 255e0", f"{c} * 255e0")}[space]
    return scaled(df, top).withColumns({f"v{i}": F.expr(e) for i, e in enumerate(stretch)}).drop("r", "g", "b")


def out_of_space(df: DataFrame, space: str, top: float) -> DataFrame:
    axes = {"lab": ("v0 / 2.55e0", "v1 - 128e0", "v2 - 128e0"), "ycrcb": tuple(f"v{i} / 255e0" for i in range(3)), "hsv": ("v0 / 42.5e0", "v1 / 255e0", "v2 / 255e0")}[space]
    df = df.withColumns({f"__s{i}": F.expr(e) for i, e in enumerate(axes)})
    return recoloured(df, top, colour.SPACES[space][1]("__s0", "__s1", "__s2")).drop("__s0", "__s1", "__s2")


@operator
class NoOp(Operator):
    p: float = 1.0


@operator
class InvertImg(Operator):
    p: float = 0.5

    def on_pixels(self, df, channels, top):
        return pointwise(df, channels, lambda v, i: f"{num(top)} - {v}")


@operator
class Solarize(Operator):
    threshold_range: tuple = (0.5, 0.5)
    p: float = 0.5

    def draws(self, d: Draws):
        return {"t": d.between("t", *self.threshold_range)}

    def on_pixels(self, df, channels, top):
        return pointwise(df, channels, lambda v, i: f"case when {v} >= p_t * {num(top)} then {num(top)} - {v} else {v} end")


@operator
class Posterize(Operator):
    num_bits: tuple | int = 4
    p: float = 0.5

    def draws(self, d: Draws):
        lo, hi = (self.num_bits, self.num_bits) if isinstance(self.num_bits, int) else self.num_bits
        return {"bits": f"cast({d.integer('bits', lo, hi)} as double)"}

    def on_pixels(self, df, channels, top):
        step = "pow(2e0, 8e0 - p_bits)"
        return pointwise(df, channels, lambda v, i: f"floor({v} * {num(255 / top)} / {step}) * {step} * {num(top / 255)}")


@operator
class RandomBrightnessContrast(Operator):
    brightness_limit: tuple | float = (-0.2, 0.2)
    contrast_limit: tuple | float = (-0.2, 0.2)
    brightness_by_max: bool = True
    ensure_safe_range: bool = False
    p: float = 0.5

    def draws(self, d: Draws):
        return {"alpha": f"(1e0 + {d.between('alpha', *pair(self.contrast_limit))})", "beta": d.between("beta", *pair(self.brightness_limit))}

    def on_pixels(self, df, channels, top):
        beta = f"p_beta * {num(top)}"
        if not self.brightness_by_max:
            mean = " + ".join(values(channels))
            means = df.groupBy("sample_id").agg(F.avg(F.expr(f"({mean}) / {channels}")).alias("mean"))
            df, beta = df.join(means, "sample_id", "left"), "p_beta * mean"
        alpha = "p_alpha"
        if self.ensure_safe_range:
            beta = f"greatest(0e0, least({num(top)}, {beta}))"
            alpha = f"least(p_alpha, ({num(top)} - {beta}) / {num(top)})"
        return pointwise(df, channels, lambda v, i: clipped(f"({v} * {alpha} + {beta})", top)).drop("mean")


@operator
class RandomGamma(Operator):
    gamma_limit: tuple = (80, 120)
    p: float = 0.5

    def draws(self, d: Draws):
        return {"gamma": f"({d.between('gamma', *self.gamma_limit)} / 100e0)"}

    def on_pixels(self, df, channels, top):
        cut = "floor" if top == 255 else ""
        return pointwise(df, channels, lambda v, i: f"{cut}(pow({v} / {num(top)}, p_gamma) * {num(top)})")


@operator
class Normalize(Operator):
    mean: tuple = (0.485, 0.456, 0.406)
    std: tuple = (0.229, 0.224, 0.225)
    max_pixel_value: float = 255.0
    normalization: str = "standard"
    p: float = 1.0

    @property
    def statistic(self):
        return self.normalization != "standard"

    def on_pixels(self, df, channels, top):
        if self.normalization == "standard":
            return pointwise(df, channels, lambda v, i: f"({v} / {num(self.max_pixel_value)} - {num(self.mean[i % len(self.mean)])}) / {num(self.std[i % len(self.std)])}")
        names, each = values(channels), "per_channel" in self.normalization
        kind = self.normalization.removesuffix("_per_channel")
        agg = {}
        for i, v in enumerate(names):
            if kind == "image":
                agg |= {f"a{i}": F.avg(v), f"q{i}": F.avg(F.col(v) * F.col(v))}
            else:
                agg |= {f"a{i}": F.min(v), f"q{i}": F.max(v)}
        stats = df.groupBy("sample_id").agg(*[c.alias(k) for k, c in agg.items()])

        def over(x: str, f: str) -> str:
            cols = [f"{x}{i}" for i in range(channels)]
            if f == "avg":
                return f"(({' + '.join(cols)}) / {channels})"
            return f"{f}({', '.join(cols)})" if channels > 1 else cols[0]

        def scale(v: str, i: int) -> str:
            if kind == "image":
                a = f"a{i}" if each else over("a", "avg")
                q = f"q{i}" if each else over("q", "avg")
                return f"({v} - {a}) / (sqrt(greatest(0e0, {q} - {a} * {a})) + 1e-4)"
            lo = f"a{i}" if each else over("a", "least")
            hi = f"q{i}" if each else over("q", "greatest")
            return f"({v} - {lo}) / ({hi} - {lo} + 1e-4)"

        return pointwise(df.join(stats, "sample_id", "left"), channels, scale).drop(*agg)

    def out_top(self, top):
        return 1.0


@operator
class ToFloat(Operator):
    max_value: float | None = None
    p: float = 1.0

    def on_pixels(self, df, channels, top):
        return pointwise(df, channels, lambda v, i: f"{v} / {num(self.max_value or top)}")

    def out_top(self, top):
        return 1.0


@operator
class FromFloat(Operator):
    dtype: str = "uint8"
    max_value: float | None = None
    p: float = 1.0

    def on_pixels(self, df, channels, top):
        most = {"uint8": 255.0, "uint16": 65535.0, "float32": 1.0}[self.dtype]
        return pointwise(df, channels, lambda v, i: clipped(f"({v} * {num(self.max_value or most)})", most))

    def out_top(self, top):
        return {"uint8": 255.0, "uint16": 65535.0, "float32": 1.0}[self.dtype]


@operator
class ToGray(Operator):
    num_output_channels: int = 3
    method: str = "weighted_average"
    p: float = 0.5

    @property
    def statistic(self):
        return self.method == "pca"

    def on_pixels(self, df, channels, top):
        r, g, b = values(3)
        unit = [f"({x} / {num(top)})" for x in (r, g, b)]
        if self.method == "pca":
            from .statistics import principal_grey

            return principal_grey(df, top, self.num_output_channels)
        grey = {
            "weighted_average": colour.luma(r, g, b),
            "from_lab": f"{colour.lightness(*unit)} * {num(top)}",
            "desaturation": f"(greatest({r}, {g}, {b}) + least({r}, {g}, {b})) / 2e0",
            "average": f"({r} + {g} + {b}) / 3e0",
            "max": f"greatest({r}, {g}, {b})",
        }[self.method]
        out = df.withColumn("__grey", F.expr(clipped(f"({grey})", top)))
        return out.drop(*values(channels)).withColumns({v: F.col("__grey") for v in values(self.num_output_channels)}).drop("__grey")

    def out_channels(self, channels):
        return self.num_output_channels


@operator
class ToRGB(Operator):
    num_output_channels: int = 3
    p: float = 1.0

    def on_pixels(self, df, channels, top):
        return df.withColumns({v: F.col("v0") for v in values(self.num_output_channels)[1:]})

    def out_channels(self, channels):
        return self.num_output_channels


@operator
class ToSepia(Operator):
    p: float = 0.5

    #: Sepia tone matrix (fixed values).
    MATRIX = ((0.393, 0.769, 0.189), (0.349, 0.686, 0.168), (0.272, 0.534, 0.131))

    def on_pixels(self, df, channels, top):
        old = df.withColumns({f"o{i}": F.col(v) for i, v in enumerate(values(3))})
        mixed = [" + ".join(f"{num(m)} * o{j}" for j, m in enumerate(row)) for row in self.MATRIX]
        return old.withColumns({f"v{i}": F.expr(clipped(f"({e})", top)) for i, e in enumerate(mixed)}).drop("o0", "o1", "o2")


@operator
class ChannelShuffle(Operator):
    p: float = 0.5

    def draws(self, d: Draws):
        return {"a": d.unit("a"), "b": d.unit("b")}

    def on_pixels(self, df, channels, top):
        # Fisher-Yates over positions; the draws of a sample serve all of its channels
        order = [str(i) for i in range(channels)]
        if channels == 3:
            j = "cast(floor(p_a * 3) as int)"
            k = "cast(floor(p_b * 2) as int)"
            first = f"case {j} when 0 then {{0}} when 1 then {{1}} else {{2}} end"
            rest = (f"case {j} when 0 then {{1}} else {{0}} end", f"case {j} when 2 then {{1}} else {{2}} end")
            picks = [first, f"case {k} when 0 then {rest[0]} else {rest[1]} end", f"case {k} when 0 then {rest[1]} else {rest[0]} end"]
            old = df.withColumns({f"o{i}": F.col(f"v{i}") for i in range(3)})
            return old.withColumns({f"v{i}": F.expr(e.format("o0", "o1", "o2")) for i, e in enumerate(picks)}).drop("o0", "o1", "o2")
        n = len(order)  # the channels in the order of a hash of the draw and their number
        keys = ", ".join(f"named_struct('k', (cast(floor(p_a * 1000003) as bigint) * 48271 + {i + 1} * 7919 * cast(floor(p_b * 1000003) as bigint) + {i}) % 2147483647 * 69621 % 2147483629, 'i', {i}, 'v', v{i})" for i in range(n))
        old = df.withColumn("__s", F.expr(f"array_sort(array({keys}))"))
        return old.withColumns({f"v{i}": F.expr(f"__s[{i}].v") for i in range(n)}).drop("__s")


@operator
class MultiplicativeNoise(Operator):
    multiplier: tuple = (0.9, 1.1)
    per_channel: bool = False
    elementwise: bool = False
    p: float = 0.5

    def draws(self, d: Draws):
        out = {}
        for i in range(4):
            name = f"m{i}" if self.per_channel else "m"
            out[f"m{i}"] = d.between(name, *self.multiplier, "y * 65537 + x") if self.elementwise else d.between(name, *self.multiplier)
        return out

    def on_pixels(self, df, channels, top):
        return pointwise(df, channels, lambda v, i: clipped(f"({v} * p_m{i % 4})", top))


@operator
class AdditiveNoise(Operator):
    """noise_type uniform, gaussian or laplace; spatial_mode constant, per_pixel or shared."""

    noise_type: str = "uniform"
    spatial_mode: str = "constant"
    low: tuple = (-0.1, -0.1, -0.1, -0.1)
    high: tuple = (0.1, 0.1, 0.1, 0.1)
    mean: float = 0.0
    scale: float = 0.1
    p: float = 0.5

    def draws(self, d: Draws):
        within = () if self.spatial_mode == "constant" else ("y * 65537 + x",)
        out = {}
        for i in range(4):
            name = "n" if self.spatial_mode == "shared" else f"n{i}"
            if self.noise_type == "uniform":
                out[f"n{i}"] = d.between(name, self.low[i], self.high[i], *within)
            elif self.noise_type == "gaussian":
                out[f"n{i}"] = f"({num(self.mean)} + {num(self.scale)} * {d.normal(name, *within)})"
            elif self.noise_type == "laplace":
                u = f"({d.unit(name, *within)} - 0.5e0)"
                out[f"n{i}"] = f"({num(self.mean)} - {num(self.scale)} * sign({u}) * ln(1e0 - 2e0 * abs({u}) * 0.999999e0))"
            elif self.noise_type == "beta":  # of two equal shapes: the middle of three uniforms
                u = [d.unit(f"{name}:{k}", *within) for k in range(3)]
                out[f"n{i}"] = f"({num(self.scale)} * ({' + '.join(u)} - greatest({', '.join(u)}) - least({', '.join(u)}) - 0.5e0))"
            else:
                raise ValueError(f"no noise {self.noise_type!r}")
        return out

    def on_pixels(self, df, channels, top):
        return pointwise(df, channels, lambda v, i: clipped(f"({v} + p_n{i % 4} * {num(top)})", top))


@operator
class RGBShift(Operator):
    r_shift_limit: tuple | float = (-20, 20)
    g_shift_limit: tuple | float = (-20, 20)
    b_shift_limit: tuple | float = (-20, 20)
    p: float = 0.5

    def draws(self, d: Draws):
        return {f"s{i}": d.between(f"s{i}", *pair(x)) for i, x in enumerate((self.r_shift_limit, self.g_shift_limit, self.b_shift_limit))}

    def on_pixels(self, df, channels, top):
        unit = top / 255 if top != 255 else 1
        return pointwise(df, 3, lambda v, i: clipped(f"({v} + p_s{i} * {num(unit)})", top))


@operator
class GaussNoise(Operator):
    std_range: tuple = (0.2, 0.44)
    mean_range: tuple = (0.0, 0.0)
    per_channel: bool = True
    p: float = 0.5

    def draws(self, d: Draws):
        out = {"std": d.between("std", *self.std_range), "mean": d.between("mean", *self.mean_range)}
        return out | {f"n{i}": d.normal(f"n{i}" if self.per_channel else "n", "y * 65537 + x") for i in range(4)}

    def on_pixels(self, df, channels, top):
        return pointwise(df, channels, lambda v, i: clipped(f"({v} + (p_mean + p_std * p_n{i % 4}) * {num(top)})", top))


@operator
class ShotNoise(Operator):
    """Photon counts: v^2.2 / scale is a Poisson mean, drawn by its normal limit from LARGE on and by
    inversion below."""

    scale_range: tuple = (0.1, 0.3)
    p: float = 0.5

    LARGE = 12

    def draws(self, d: Draws):
        return {"scale": d.between("scale", *self.scale_range)} | {f"u{i}": d.unit(f"u{i}", "y * 65537 + x") for i in range(4)} | {f"g{i}": d.normal(f"g{i}", "y * 65537 + x") for i in range(4)}

    def on_pixels(self, df, channels, top):
        def count(v: str, i: int) -> str:
            mean = f"(pow({v} / {num(top)}, 2.2e0) / p_scale + 1e-6)"
            # cumulative terms up to 64, where a mean below LARGE has nothing left that a double could show
            step = f"named_struct('n', case when p_u{i % 4} >= s.c then 1e0 * k else s.n end, 't', s.t * {mean} / k, 'c', s.c + s.t * {mean} / k)"
            drawn = f"aggregate(sequence(1, 64), named_struct('n', 0e0, 't', exp(-{mean}), 'c', exp(-{mean})), (s, k) -> {step}, s -> s.n)"
            return f"(case when {mean} < {self.LARGE} then {drawn} else greatest(0e0, floor({mean} + sqrt({mean}) * p_g{i % 4} + 0.5e0)) end)"

        return pointwise(df, channels, lambda v, i: clipped(f"(pow(least(1e0, {count(v, i)} * p_scale), {num(1 / 2.2)}) * {num(top)})", top))


@operator
class HueSaturationValue(Operator):
    hue_shift_limit: tuple | float = (-20, 20)
    sat_shift_limit: tuple | float = (-30, 30)
    val_shift_limit: tuple | float = (-20, 20)
    p: float = 0.5

    def draws(self, d: Draws):
        return {"h": d.between("h", *pair(self.hue_shift_limit)), "s": d.between("s", *pair(self.sat_shift_limit)), "v": d.between("v", *pair(self.val_shift_limit))}

    def on_pixels(self, df, channels, top):
        h, s, v = colour.hsv("r", "g", "b")
        df = scaled(df, top).withColumns({"hh": F.expr(h), "ss": F.expr(s), "vv": F.expr(v)})
        df = df.withColumns({"hh": F.expr("(hh + p_h / 30e0 + 12e0) % 6e0"), "ss": F.expr("case when ss = 0 then 0e0 else greatest(0e0, least(1e0, ss + p_s / 255e0)) end"), "vv": F.expr("greatest(0e0, least(1e0, vv + p_v / 255e0))")})
        return recoloured(df, top, colour.from_hsv("hh", "ss", "vv")).drop("r", "g", "b", "hh", "ss", "vv")


@operator
class ColorJitter(Operator):
    """Factors in a random order, the same for all pixels of a sample."""

    brightness: tuple = (0.8, 1.2)
    contrast: tuple = (0.8, 1.2)
    saturation: tuple = (0.8, 1.2)
    hue: tuple = (-0.5, 0.5)
    p: float = 0.5

    def draws(self, d: Draws):
        return {n: d.between(n, *getattr(self, n)) for n in ("brightness", "contrast", "saturation", "hue")} | {f"o{i}": d.unit(f"o{i}") for i in range(4)}

    def on_pixels(self, df, channels, top):
        grey = colour.luma("v0", "v1", "v2")
        means = df.groupBy("sample_id").agg(F.avg(F.expr(grey)).alias("mean"))
        df = df.join(means, "sample_id", "left")

        def step(df: DataFrame, k: int) -> DataFrame:
            """The change whose draw is the k-th smallest."""
            rank = [" + ".join(f"(case when p_o{j} < p_o{i} or (p_o{j} = p_o{i} and {j} < {i}) then 1 else 0 end)" for j in range(4) if j != i) for i in range(4)]
            turn = f"(case {' '.join(f'when ({r}) = {k} then {i}' for i, r in enumerate(rank))} end)"
            h, s, v = colour.hsv("r", "g", "b")
            df = scaled(df, top).withColumns({"hh": F.expr(f"({h} + 6e0 + 6e0 * p_hue) % 6e0"), "ss": F.expr(s), "vv": F.expr(v), "gg": F.expr(grey)})
            turned = colour.from_hsv("hh", "ss", "vv")
            new = {}
            for i, c in enumerate(values(3)):
                e = f"case {turn} when 0 then {c} * p_brightness when 1 then {c} * p_contrast + mean * (1e0 - p_contrast) when 2 then {c} * p_saturation + gg * (1e0 - p_saturation) else {turned[i]} * {num(top)} end"
                new[c] = F.expr(clipped(f"({e})", top))
            return df.withColumns(new).drop("r", "g", "b", "hh", "ss", "vv", "gg")

        for k in range(4):
            df = step(df, k)
        return df.drop("mean")


@operator
class PlanckianJitter(Operator):
    """Red and blue gains of a black body at a temperature, relative to green.

    The gains follow from Planck's law at the primaries' wavelengths, normalised at 6500 K.
    """

    temperature_limit: tuple = (3000, 15000)
    p: float = 0.5

    #: Wavelengths of red, green and blue in metres, and the second radiation constant (fixed values).
    WAVES, C2 = (610e-9, 550e-9, 465e-9), 1.438776877e-2

    def draws(self, d: Draws):
        return {"t": d.between("t", *self.temperature_limit)}

    def on_pixels(self, df, channels, top):
        def power(wave: float, t: str) -> str:
            return f"(1e0 / (exp({num(self.C2 / wave)} / {t}) - 1e0))"

        green = f"({power(self.WAVES[1], 'p_t')} / {power(self.WAVES[1], '6500e0')})"
        return pointwise(df, 3, lambda v, i: v if i == 1 else clipped(f"({v} * {power(self.WAVES[i], 'p_t')} / {power(self.WAVES[i], '6500e0')} / {green})", top))


@operator
class RandomToneCurve(Operator):
    """A cubic Bezier curve from (0, 0) to (1, 1); its two inner ordinates are drawn."""

    scale: float = 0.1
    per_channel: bool = False
    p: float = 0.5

    def draws(self, d: Draws):
        out = {}
        for i in range(4):
            n = str(i) if self.per_channel else ""
            out[f"a{i}"] = f"greatest(0e0, least(1e0, 0.25e0 + {num(self.scale)} * {d.normal('a' + n)}))"
            out[f"b{i}"] = f"greatest(0e0, least(1e0, 0.75e0 + {num(self.scale)} * {d.normal('b' + n)}))"
        return out

    def on_pixels(self, df, channels, top):
        def curve(v: str, i: int) -> str:
            t = f"({v} / {num(top)})"
            u = f"(1e0 - {t})"
            return clipped(f"((3e0 * {u} * {u} * {t} * p_a{i % 4} + 3e0 * {u} * {t} * {t} * p_b{i % 4} + {t} * {t} * {t}) * {num(top)})", top)

        return pointwise(df, channels, curve)


@operator
class Illumination(Operator):
    mode: str = "linear"
    intensity_range: tuple = (0.01, 0.2)
    effect_type: str = "both"
    angle_range: tuple = (0, 360)
    center_range: tuple = (0.1, 0.9)
    sigma_range: tuple = (0.2, 1.0)
    p: float = 0.5

    def draws(self, d: Draws):
        sign = {"brighten": "1e0", "darken": "(-1e0)", "both": f"(case when {d.unit('sign')} < 0.5e0 then 1e0 else -1e0 end)"}[self.effect_type]
        return {
            "i": f"({d.between('i', *self.intensity_range)} * {sign})",
            "angle": f"radians({d.between('angle', *self.angle_range)})",
            "corner": f"cast(floor({d.unit('corner')} * 4e0) as int)",
            "cx": d.between("cx", *self.center_range),
            "cy": d.between("cy", *self.center_range),
            "sigma": d.between("sigma", *self.sigma_range),
        }

    def on_pixels(self, df, channels, top):
        if self.mode == "linear":
            along = "((x / greatest(1e0, w - 1e0) - 0.5e0) * cos(p_angle) + (y / greatest(1e0, h - 1e0) - 0.5e0) * sin(p_angle))"
            reach = "((abs(cos(p_angle)) + abs(sin(p_angle))) / 2e0)"
            gain = f"(({along} / {reach} + 1e0) / 2e0 * 2e0 * p_i + (1e0 - p_i))"
        elif self.mode == "corner":
            cx, cy = "(case when p_corner in (0, 2) then 0e0 else w - 1e0 end)", "(case when p_corner in (0, 1) then 0e0 else h - 1e0 end)"
            gain = f"(1e0 - p_i * sqrt((x - {cx}) * (x - {cx}) + (y - {cy}) * (y - {cy})) / sqrt(1e0 * h * h + w * w))"
        else:
            s = "(greatest(h, w) * p_sigma)"
            gain = f"(1e0 + p_i * exp(-((x - w * p_cx) * (x - w * p_cx) + (y - h * p_cy) * (y - h * p_cy)) / (2e0 * {s} * {s})))"
        return pointwise(df, channels, lambda v, i: clipped(f"({v} * {gain})", top))


@operator
class Lambda(Operator):
    """User functions per relation: each takes and returns a DataFrame. Named ones can be in a spec."""

    named: str = ""
    image: object = None
    mask: object = None
    bboxes: object = None
    keypoints: object = None
    p: float = 1.0

    #: name -> functions, for specs.
    KNOWN = {}

    def use(self, what: str):
        return getattr(self, what) or self.KNOWN.get(self.named, {}).get(what)

    def on_pixels(self, df, channels, top):
        return self.use("image")(df) if self.use("image") else df

    def on_masks(self, df, channels, top):
        return self.use("mask")(df) if self.use("mask") else df

    def on_boxes(self, df):
        return self.use("bboxes")(df) if self.use("bboxes") else df

    def on_keypoints(self, df):
        return self.use("keypoints")(df) if self.use("keypoints") else df

    def spec(self):
        if not self.named or self.named not in self.KNOWN:
            raise ValueError("a Lambda needs a registered name to be in a spec")
        return {"operator": self.name, "named": self.named, "p": self.p}


@operator
class ChannelDropout(Operator):
    channel_drop_range: tuple = (1, 1)
    fill: float = 0.0
    p: float = 0.5

    def draws(self, d: Draws):
        return {"n": d.integer("n", *self.channel_drop_range)} | {f"r{i}": d.unit(f"r{i}") for i in range(4)}

    def on_pixels(self, df, channels, top):
        def rank(i: int) -> str:
            return " + ".join(f"(case when p_r{j} < p_r{i} or (p_r{j} = p_r{i} and {j} < {i}) then 1 else 0 end)" for j in range(channels) if j != i) or "0"

        return pointwise(df, channels, lambda v, i: f"case when {rank(i)} < p_n then {num(self.fill)} else {v} end")


@operator
class RandomShadow(Operator):
    """Darkens pixels inside random triangles of a region of interest."""

    shadow_roi: tuple = (0.0, 0.5, 1.0, 1.0)
    num_shadows_limit: tuple = (1, 2)
    shadow_intensity_range: tuple = (0.5, 0.5)
    p: float = 0.5

    def draws(self, d: Draws):
        x0, y0, x1, y1 = self.shadow_roi
        out = {"n": d.integer("n", *self.num_shadows_limit), "i": d.between("i", *self.shadow_intensity_range)}
        for k in range(self.num_shadows_limit[1]):
            for j in range(3):
                out |= {f"x{k}{j}": f"({d.between(f'x{k}{j}', x0, x1)} * w)", f"y{k}{j}": f"({d.between(f'y{k}{j}', y0, y1)} * h)"}
        return out

    def on_pixels(self, df, channels, top):
        inside = []
        for k in range(self.num_shadows_limit[1]):
            side = [f"((p_x{k}{b} - p_x{k}{a}) * (y - p_y{k}{a}) - (p_y{k}{b} - p_y{k}{a}) * (x - p_x{k}{a}))" for a, b in ((0, 1), (1, 2), (2, 0))]
            inside.append(f"(p_n > {k} and (({' and '.join(s + ' >= 0' for s in side)}) or ({' and '.join(s + ' <= 0' for s in side)})))")
        return pointwise(df, channels, lambda v, i: f"case when {' or '.join(inside)} then {clipped(f'({v} * (1e0 - p_i))', top)} else {v} end")


@operator
class RandomSnow(Operator):
    """Lightness below a point is amplified."""

    brightness_coeff: float = 2.5
    snow_point_range: tuple = (0.1, 0.3)
    p: float = 0.5

    def draws(self, d: Draws):
        return {"s": d.between("s", *self.snow_point_range)}

    def on_pixels(self, df, channels, top):
        h, light, s = colour.hls("r", "g", "b")
        df = scaled(df, top).withColumns({"hh": F.expr(h), "ll": F.expr(light), "ss": F.expr(s)})
        df = df.withColumn("ll", F.expr(f"least(1e0, case when ll * 255e0 < p_s * 127.5e0 + 85e0 then ll * {num(self.brightness_coeff)} else ll end)"))
        return recoloured(df, top, colour.from_hls("hh", "ll", "ss")).drop("r", "g", "b", "hh", "ll", "ss")


@operator
class ISONoise(Operator):
    """Normal noise on hue and noise on lightness that grows with the lightness' spread."""

    color_shift: tuple = (0.01, 0.05)
    intensity: tuple = (0.1, 0.5)
    p: float = 0.5

    def draws(self, d: Draws):
        at = "y * 65537 + x"
        return {"c": d.between("c", *self.color_shift), "i": d.between("i", *self.intensity), "nh": d.normal("nh", at), "nl": d.normal("nl", at)}

    def on_pixels(self, df, channels, top):
        h, light, s = colour.hls("r", "g", "b")
        df = scaled(df, top).withColumns({"hh": F.expr(h), "ll": F.expr(light), "ss": F.expr(s)})
        spread = df.groupBy("sample_id").agg(F.stddev_pop("ll").alias("spread"))
        df = df.join(spread, "sample_id", "left").withColumns({"hh": F.expr("(hh + p_nh * p_c * 6e0 * p_i + 60e0) % 6e0"), "ll": F.expr("greatest(0e0, least(1e0, ll + p_nl * sqrt(spread) * p_i * 0.1e0 * (1e0 - ll)))")})
        return recoloured(df, top, colour.from_hls("hh", "ll", "ss")).drop("r", "g", "b", "hh", "ll", "ss", "spread")
