"""Colour spaces as SQL expressions over r, g, b, each in [0, 1]."""

from __future__ import annotations

#: Luma weights (fixed values).
LUMA = (0.299, 0.587, 0.114)


def luma(r: str, g: str, b: str) -> str:
    return f"(0.299e0 * {r} + 0.587e0 * {g} + 0.114e0 * {b})"


def hue(r: str, g: str, b: str) -> str:
    """In [0, 6); 0 for greys."""
    hi, lo = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    span = f"({hi} - {lo})"
    return f"(case when {span} = 0 then 0e0 when {hi} = {r} then (({g} - {b}) / {span} + 6e0) % 6e0 when {hi} = {g} then ({b} - {r}) / {span} + 2e0 else ({r} - {g}) / {span} + 4e0 end)"


def hsv(r: str, g: str, b: str) -> tuple[str, str, str]:
    hi, lo = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    return hue(r, g, b), f"(case when {hi} = 0 then 0e0 else ({hi} - {lo}) / {hi} end)", hi


def hls(r: str, g: str, b: str) -> tuple[str, str, str]:
    hi, lo = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    light = f"(({hi} + {lo}) / 2e0)"
    return hue(r, g, b), light, f"(case when {hi} = {lo} then 0e0 when {light} < 0.5e0 then ({hi} - {lo}) / ({hi} + {lo}) else ({hi} - {lo}) / (2e0 - {hi} - {lo}) end)"


def from_hsv(h: str, s: str, v: str) -> list[str]:
    """Channel k is v * (1 - s * clip(min(t, 4 - t), 0, 1)) with t = (n + h) mod 6, n = 5, 3, 1."""
    t = [f"(({n} + {h}) % 6e0)" for n in (5, 3, 1)]
    return [f"({v} * (1e0 - {s} * greatest(0e0, least({x}, 4e0 - {x}, 1e0))))" for x in t]


def from_hls(h: str, light: str, s: str) -> list[str]:
    """Channel k is l - a * max(-1, min(t - 3, 9 - t, 1)), t = (n + 2h) mod 12, n = 0, 8, 4."""
    a = f"({s} * least({light}, 1e0 - {light}))"
    t = [f"(({n} + 2e0 * {h}) % 12e0)" for n in (0, 8, 4)]
    return [f"({light} - {a} * greatest(-1e0, least({x} - 3e0, 9e0 - {x}, 1e0)))" for x in t]


def linear(v: str) -> str:
    """sRGB to linear light."""
    return f"(case when {v} <= 0.04045e0 then {v} / 12.92e0 else pow(({v} + 0.055e0) / 1.055e0, 2.4e0) end)"


def lightness(r: str, g: str, b: str) -> str:
    """CIE L* over 100."""
    y = f"(0.212671e0 * {linear(r)} + 0.71516e0 * {linear(g)} + 0.072169e0 * {linear(b)})"
    return f"((case when {y} > 0.008856e0 then 116e0 * pow({y}, 1e0 / 3e0) - 16e0 else 903.3e0 * {y} end) / 100e0)"


#: sRGB to XYZ by rows, its inverse, and the white point of D65 (fixed values).
XYZ = ((0.412453, 0.35758, 0.180423), (0.212671, 0.71516, 0.072169), (0.019334, 0.119193, 0.950227))
RGB = ((3.240479, -1.53715, -0.498535), (-0.969256, 1.875991, 0.041556), (0.055648, -0.204043, 1.057311))
WHITE = (0.950456, 1.0, 1.088754)
#: Where the cube root gives way to a line, and the line's slope and height (fixed values).
KNEE, SLOPE, HEIGHT = 0.008856, 7.787, 16 / 116


def mixed_by(rows: tuple, parts: tuple[str, str, str]) -> list[str]:
    return ["(" + " + ".join(f"({m:.17g}e0) * {p}" for m, p in zip(row, parts)) + ")" for row in rows]


def gamma(v: str) -> str:
    """Linear light to sRGB."""
    return f"(case when {v} <= 0.0031308e0 then 12.92e0 * {v} else 1.055e0 * pow({v}, 1e0 / 2.4e0) - 0.055e0 end)"


def lab(r: str, g: str, b: str) -> tuple[str, str, str]:
    """CIE L* (0 to 100), a* and b* of sRGB in [0, 1]."""
    f = []
    for x, white in zip(mixed_by(XYZ, (linear(r), linear(g), linear(b))), WHITE):
        t = f"({x} / {white:.17g}e0)"
        f.append(f"(case when {t} > {KNEE}e0 then pow({t}, 1e0 / 3e0) else {SLOPE}e0 * {t} + {HEIGHT:.17g}e0 end)")
    return f"(116e0 * {f[1]} - 16e0)", f"(500e0 * ({f[0]} - {f[1]}))", f"(200e0 * ({f[1]} - {f[2]}))"


def from_lab(light: str, a: str, b: str) -> list[str]:
    """sRGB, not yet cut to [0, 1]."""
    fy = f"(({light} + 16e0) / 116e0)"
    at = [f"({fy} + {a} / 500e0)", fy, f"({fy} - {b} / 200e0)"]
    edge = KNEE ** (1 / 3)
    parts = [f"({w:.17g}e0 * (case when {x} > {edge:.17g}e0 then {x} * {x} * {x} else ({x} - {HEIGHT:.17g}e0) / {SLOPE}e0 end))" for x, w in zip(at, WHITE)]
    return [gamma(x) for x in mixed_by(RGB, tuple(parts))]


def ycrcb(r: str, g: str, b: str) -> tuple[str, str, str]:
    """Luma and the differences of red and blue from it, each in [0, 1]."""
    y = luma(r, g, b)
    return y, f"(({r} - {y}) * 0.713e0 + 0.5e0)", f"(({b} - {y}) * 0.564e0 + 0.5e0)"


def from_ycrcb(y: str, cr: str, cb: str) -> list[str]:
    return [f"({y} + ({cr} - 0.5e0) / 0.713e0)", f"({y} - 0.299e0 / 0.587e0 * ({cr} - 0.5e0) / 0.713e0 - 0.114e0 / 0.587e0 * ({cb} - 0.5e0) / 0.564e0)", f"({y} + ({cb} - 0.5e0) / 0.564e0)"]


#: Name -> (to the space, from it, what takes its first axis to [0, 1]).
SPACES = {"lab": (lab, from_lab, 100.0), "ycrcb": (ycrcb, from_ycrcb, 1.0), "hsv": (hsv, from_hsv, None)}
