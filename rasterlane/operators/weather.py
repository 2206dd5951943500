"""Drawn layers: rain, fog, flare, gravel, spatter, plasma. A layer is a closed form of the pixel's
coordinates and the sample's draws, so nothing is rasterised elsewhere and joined."""

from __future__ import annotations

from rasterlane.functions import colour
from rasterlane.functions.sampling import Draws, num

from .base import Operator, clipped, operator, pointwise, values
from .gather import WEIGHTED, Gathered, box_kernel, filtered
from .pointwise import recoloured, scaled

from pyspark.sql import functions as F


@operator
class RandomRain(Gathered):
    """Slanted drops of one colour, blurred, then the sample is darkened."""

    slant_range: tuple = (-10, 10)
    drop_length: int = 3
    drop_width: int = 1
    drop_color: tuple = (200, 200, 200)
    blur_value: int = 3
    brightness_coefficient: float = 0.7
    drops: int = 8
    p: float = 0.5

    def draws(self, d: Draws):
        out = {"slant": f"radians({d.between('slant', *self.slant_range)})"}
        for k in range(self.drops):
            out |= {f"x{k}": f"floor({d.unit(f'x{k}')} * w)", f"y{k}": f"floor({d.unit(f'y{k}')} * greatest(1, h - {self.drop_length}))"}
        return out

    def on_pixels(self, df, channels, top):
        hit = " or ".join(f"(y >= p_y{k} and y < p_y{k} + {self.drop_length} and abs(x - p_x{k} - (y - p_y{k}) * tan(p_slant)) < {num(self.drop_width / 2 + 0.01)})" for k in range(self.drops))
        df = pointwise(df, channels, lambda v, i: f"case when {hit} then {num(self.drop_color[i % 3] * top / 255)} else {v} end")
        df = filtered(df, channels, box_kernel(str(self.blur_value | 1)), WEIGHTED, top)
        return pointwise(df, channels, lambda v, i: clipped(f"({v} * {num(self.brightness_coefficient)})", top))


@operator
class RandomFog(Gathered):
    """White discs are blended over the sample one after another, then it is blurred."""

    alpha_coef: float = 0.08
    fog_coef_range: tuple = (0.3, 1.0)
    particles: int = 10
    p: float = 0.5

    def draws(self, d: Draws):
        out = {"i": d.between("i", *self.fog_coef_range)}
        for k in range(self.particles):
            out |= {f"x{k}": f"({d.unit(f'x{k}')} * w)", f"y{k}": f"({d.unit(f'y{k}')} * h)", f"r{k}": f"(least(h, w) / 2e0 * {d.between(f'r{k}', 0.3, 1.0)})"}
        return out

    def on_pixels(self, df, channels, top):
        covered = " + ".join(f"(case when (x - p_x{k}) * (x - p_x{k}) + (y - p_y{k}) * (y - p_y{k}) <= p_r{k} * p_r{k} then 1 else 0 end)" for k in range(self.particles))
        kept = f"pow(1e0 - {num(self.alpha_coef)} * p_i, {covered})"
        df = pointwise(df, channels, lambda v, i: f"{v} * {kept} + {num(top)} * (1e0 - {kept})")
        return filtered(df, channels, box_kernel("3"), WEIGHTED, top)


@operator
class RandomSunFlare(Operator):
    """A radial source and circles along a line through it; overlay or screen (physics_based)."""

    flare_roi: tuple = (0.0, 0.0, 1.0, 0.5)
    src_radius: float = 4.0
    src_color: tuple = (255, 255, 255)
    num_flare_circles_range: tuple = (3, 5)
    method: str = "overlay"
    p: float = 0.5

    def draws(self, d: Draws):
        x0, y0, x1, y1 = self.flare_roi
        out = {"x": f"({d.between('x', x0, x1)} * w)", "y": f"({d.between('y', y0, y1)} * h)", "a": d.between("a", 0, 6.283185307179586), "n": d.integer("n", *self.num_flare_circles_range)}
        for k in range(self.num_flare_circles_range[1]):
            out |= {f"d{k}": f"({d.between(f'd{k}', -1, 1)} * greatest(h, w))", f"r{k}": d.between(f"r{k}", 0.5, max(1.0, self.src_radius / 2)), f"t{k}": d.between(f"t{k}", 0.05, 0.2)}
        return out

    def on_pixels(self, df, channels, top):
        glow = f"pow(greatest(0e0, 1e0 - sqrt((x - p_x) * (x - p_x) + (y - p_y) * (y - p_y)) / {num(self.src_radius)}), 2e0)"
        keep = [f"(1e0 - {glow})"]
        for k in range(self.num_flare_circles_range[1]):
            cx, cy = f"(p_x + p_d{k} * cos(p_a))", f"(p_y + p_d{k} * sin(p_a))"
            keep.append(f"(case when p_n > {k} and (x - {cx}) * (x - {cx}) + (y - {cy}) * (y - {cy}) <= p_r{k} * p_r{k} then 1e0 - p_t{k} else 1e0 end)")
        a = f"(1e0 - {' * '.join(keep)})"

        def mixed(v: str, i: int) -> str:
            light = num(self.src_color[i % 3] * top / 255)
            if self.method == "physics_based":
                return clipped(f"({num(top)} - ({num(top)} - {v}) * (1e0 - {a} * {light} / {num(top)}))", top)
            return clipped(f"({v} * (1e0 - {a}) + {light} * {a})", top)

        return pointwise(df, channels, mixed)


@operator
class RandomGravel(Operator):
    """Specks inside random patches get a random lightness."""

    gravel_roi: tuple = (0.1, 0.4, 0.9, 0.9)
    number_of_patches: int = 2
    density: float = 0.3
    p: float = 0.5

    def draws(self, d: Draws):
        x0, y0, x1, y1 = self.gravel_roi
        out = {"u": d.unit("u", "y * 65537 + x"), "l": d.unit("l", "y * 65537 + x")}
        for k in range(self.number_of_patches):
            out |= {f"x{k}": f"({d.between(f'x{k}', x0, x1)} * w)", f"y{k}": f"({d.between(f'y{k}', y0, y1)} * h)", f"s{k}": f"(least(h, w) * {d.between(f's{k}', 0.1, 0.3)})"}
        return out

    def on_pixels(self, df, channels, top):
        h, light, s = colour.hls("r", "g", "b")
        inside = " or ".join(f"(abs(x - p_x{k}) <= p_s{k} and abs(y - p_y{k}) <= p_s{k})" for k in range(self.number_of_patches))
        df = scaled(df, top).withColumns({"hh": F.expr(h), "ll": F.expr(light), "ss": F.expr(s)})
        df = df.withColumn("ll", F.expr(f"case when ({inside}) and p_u < {num(self.density)} then p_l else ll end"))
        return recoloured(df, top, colour.from_hls("hh", "ll", "ss")).drop("r", "g", "b", "hh", "ll", "ss")


def waves(d: Draws, name: str, count: int, sigma: float) -> tuple[dict[str, str], str]:
    """Draws and value (mean 0, variance 1) of a smooth random field."""
    out, terms = {}, []
    for i in range(count):
        out |= {f"{name}u{i}": f"({d.normal(f'{name}u{i}')} / {num(sigma)})", f"{name}v{i}": f"({d.normal(f'{name}v{i}')} / {num(sigma)})", f"{name}f{i}": d.between(f"{name}f{i}", 0, 6.283185307179586)}
        terms.append(f"cos(p_{name}u{i} * x + p_{name}v{i} * y + p_{name}f{i})")
    return out, f"({num((2 / count) ** 0.5)} * ({' + '.join(terms)}))"


@operator
class Spatter(Operator):
    """Where a smooth random layer is above a cut, rain lightens and mud covers."""

    mean: tuple = (0.65, 0.65)
    std: tuple = (0.3, 0.3)
    gauss_sigma: tuple = (2.0, 2.0)
    cutout_threshold: tuple = (0.68, 0.68)
    intensity: tuple = (0.6, 0.6)
    mode: str = "rain"
    color: tuple | None = None
    p: float = 0.5

    def draws(self, d: Draws):
        field, _ = waves(d, "f", 12, sum(self.gauss_sigma) / 2)
        return field | {"mean": d.between("mean", *self.mean), "std": d.between("std", *self.std), "cut": d.between("cut", *self.cutout_threshold), "i": d.between("i", *self.intensity)}

    def on_pixels(self, df, channels, top):
        _, field = waves(Draws(0, ""), "f", 12, 1.0)
        layer = f"(p_mean + p_std * {field})"
        tint = self.color or ((238, 238, 175) if self.mode == "rain" else (20, 42, 63))
        amount = f"(case when {layer} > p_cut then least(1e0, {layer} * p_i) else 0e0 end)"
        if self.mode == "rain":
            return pointwise(df, channels, lambda v, i: clipped(f"({v} + {amount} * {num(tint[i % 3] * top / 255)})", top))
        return pointwise(df, channels, lambda v, i: clipped(f"({v} * (1e0 - {amount}) + {amount} * {num(tint[i % 3] * top / 255)})", top))


class Plasma(Operator):
    """A fractal pattern in [0, 1]: octaves of random waves whose amplitude falls with roughness."""

    OCTAVES = 4

    def pattern_draws(self, d: Draws) -> dict[str, str]:
        out = {}
        for o in range(self.OCTAVES):
            for i in range(3):
                a = d.between(f"a{o}{i}", 0, 6.283185307179586)
                f = num(6.283185307179586 * 2**o)
                out |= {f"u{o}{i}": f"({f} * cos({a}) / greatest(1, w))", f"v{o}{i}": f"({f} * sin({a}) / greatest(1, h))", f"f{o}{i}": d.between(f"f{o}{i}", 0, 6.283185307179586)}
        return out

    def pattern(self) -> str:
        size = [self.roughness**-o for o in range(self.OCTAVES)]
        terms = " + ".join(f"{num(s / 3)} * cos(p_u{o}{i} * x + p_v{o}{i} * y + p_f{o}{i})" for o, s in enumerate(size) for i in range(3))
        return f"(0.5e0 + ({terms}) / {num(2 * sum(size))})"


@operator
class PlasmaBrightnessContrast(Plasma):
    brightness_range: tuple = (-0.3, 0.3)
    contrast_range: tuple = (-0.3, 0.3)
    roughness: float = 3.0
    p: float = 0.5

    def draws(self, d: Draws):
        return self.pattern_draws(d) | {"b": d.between("b", *self.brightness_range), "c": d.between("c", *self.contrast_range)}

    def on_pixels(self, df, channels, top):
        means = df.groupBy("sample_id").agg(F.avg(F.expr(f"({' + '.join(values(channels))}) / {channels}")).alias("mean"))
        p = self.pattern()
        df = df.join(means, "sample_id", "left")
        return pointwise(df, channels, lambda v, i: clipped(f"(({v} + p_b * {p} * {num(top)}) * (1e0 + p_c * {p}) + mean * (1e0 - (1e0 + p_c * {p})))", top)).drop("mean")


@operator
class PlasmaShadow(Plasma):
    shadow_intensity_range: tuple = (0.3, 0.7)
    roughness: float = 3.0
    p: float = 0.5

    def draws(self, d: Draws):
        return self.pattern_draws(d) | {"i": d.between("i", *self.shadow_intensity_range)}

    def on_pixels(self, df, channels, top):
        return pointwise(df, channels, lambda v, i: clipped(f"({v} * (1e0 - p_i * {self.pattern()}))", top))
