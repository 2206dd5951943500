"""Volumes: sample_id, d, h, w, z, y, x, v0 ...; keypoints may carry z."""

from __future__ import annotations

from itertools import permutations, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlane.functions.sampling import Draws, num

from .base import Operator, operator, or_old, values
from .dropout import Holes
from .geometry import fits, moved

AXES = ("z", "y", "x")
SIDES = {"z": "d", "y": "h", "x": "w"}


class Window3D(Operator):
    """start(axis), size(axis): what is kept; larger than the side is an error."""

    spatial = True
    own = ("pixels", "masks", "keypoints")

    def window(self, axis: str) -> tuple[str, str]:
        raise NotImplementedError

    def on_pixels(self, df, channels, top):
        for a in AXES:
            start, size = self.window(a)
            df = moved(df.withColumns({"__s": F.expr(or_old(df, start, "0")), "__n": F.expr(or_old(df, fits(size, SIDES[a]), SIDES[a]))}).where(f"{a} >= __s and {a} < __s + __n"), **{a: f"{a} - __s", SIDES[a]: "__n"}).drop("__s", "__n")
        return df

    def on_keypoints(self, df):
        new = {}
        for a in AXES:
            start, size = self.window(a)
            new |= {a: or_old(df, f"{a} - ({start})", a), SIDES[a]: or_old(df, size, SIDES[a])}
        return moved(df, **new)


@operator
class CenterCrop3D(Window3D):
    size: tuple = (2, 2, 2)
    p: float = 1.0

    def window(self, axis):
        n = self.size[AXES.index(axis)]
        return f"cast(floor(({SIDES[axis]} - {n}) / 2) as int)", str(n)


@operator
class RandomCrop3D(Window3D):
    size: tuple = (2, 2, 2)
    p: float = 1.0

    def draws(self, d: Draws):
        return {f"u{a}": d.unit(a) for a in AXES}

    def window(self, axis):
        n = self.size[AXES.index(axis)]
        return f"cast(floor(({SIDES[axis]} - {n} + 1) * p_u{axis}) as int)", str(n)


class Padded3D(Operator):
    """before(axis), after(axis): new cells are fill, made by the sample's first cell."""

    spatial = True
    own = ("pixels", "masks", "keypoints")
    fill = 0.0

    def sides(self, axis: str) -> tuple[str, str]:
        raise NotImplementedError

    def widths(self, df: DataFrame, axis: str) -> tuple[str, ...]:
        """sides(), or none where a gate is closed."""
        return tuple(or_old(df, f"({s})", "0") for s in self.sides(axis))

    def on_pixels(self, df, channels, top):
        for a in AXES:
            before, after = self.widths(df, a)
            df = df.withColumns({f"__b{a}": F.expr(f"cast({before} as int)"), f"__n{a}": F.expr(f"cast({SIDES[a]} + {before} + {after} as int)")})
        own = f"array(named_struct({', '.join(f'{chr(39)}{a}{chr(39)}, cast({a} + __b{a} as int)' for a in AXES)}, 'own', true))"
        cell = "named_struct('z', cast(floor(i / (__ny * __nx)) as int), 'y', cast(floor(i / __nx) % __ny as int), 'x', cast(i % __nx as int), 'own', false)"
        edge = f"filter(transform(sequence(0, __nz * __ny * __nx - 1), i -> {cell}), c -> {' or '.join(f'c.{a} < __b{a} or c.{a} >= __b{a} + {SIDES[a]}' for a in AXES)})"
        out = df.withColumn("__at", F.explode(F.expr(f"case when z = 0 and y = 0 and x = 0 then concat({own}, {edge}) else {own} end")))
        out = out.withColumns({v: F.expr(f"case when __at.own then {v} else {num(float(self.fill))} end") for v in values(channels)})
        out = moved(out, **{a: f"__at.{a}" for a in AXES}, **{SIDES[a]: f"__n{a}" for a in AXES})
        return out.drop("__at", *[f"__{k}{a}" for a in AXES for k in "bn"])

    def on_keypoints(self, df):
        w = {a: self.widths(df, a) for a in AXES}
        return moved(df, **{a: f"{a} + {w[a][0]}" for a in AXES}, **{SIDES[a]: f"{SIDES[a]} + {w[a][0]} + {w[a][1]}" for a in AXES})


@operator
class Pad3D(Padded3D):
    padding: tuple | int = 1
    fill: float = 0.0
    p: float = 1.0

    def sides(self, axis):
        q = self.padding
        q = (q,) * 6 if isinstance(q, int) else tuple(x for x in q for _ in (0, 1)) if len(q) == 3 else q
        k = 2 * AXES.index(axis)
        return str(q[k]), str(q[k + 1])


@operator
class PadIfNeeded3D(Padded3D):
    min_zyx: tuple | None = (6, 6, 6)
    pad_divisor_zyx: tuple | None = None
    position: str = "center"
    fill: float = 0.0
    p: float = 1.0

    def draws(self, d: Draws):
        return {f"u{a}": d.unit(a) for a in AXES} if self.position == "random" else {}

    def sides(self, axis):
        k, side = AXES.index(axis), SIDES[axis]
        total = f"greatest(0, {self.min_zyx[k]} - {side})" if self.min_zyx else f"(({self.pad_divisor_zyx[k]} - {side} % {self.pad_divisor_zyx[k]}) % {self.pad_divisor_zyx[k]})"
        before = f"cast(floor({total} / 2) as int)" if self.position == "center" else f"cast(floor(({total} + 1) * p_u{axis}) as int)"
        return before, f"({total} - {before})"


@operator
class CoarseDropout3D(Holes):
    num_holes_range: tuple = (1, 1)
    hole_depth_range: tuple = (0.1, 0.2)
    hole_height_range: tuple = (0.1, 0.2)
    hole_width_range: tuple = (0.1, 0.2)
    fill: float | str = 0.0
    fill_mask: float | None = None
    p: float = 0.5

    def draws(self, d: Draws):
        out = {"n": d.integer("n", *self.num_holes_range)}
        for k in range(self.num_holes_range[1]):
            for a, limits in zip(AXES, (self.hole_depth_range, self.hole_height_range, self.hole_width_range)):
                size = f"greatest(1, cast(ceil({SIDES[a]} * {d.between(f's{a}{k}', *limits)}) as int))"
                start = f"cast(floor(({SIDES[a]} - {size} + 1) * {d.unit(f'{a}{k}')}) as int)"
                out |= {f"{a}{k}": start, f"{a}{a}{k}": f"({start} + {size})"}
        return out

    def inside(self, y="y", x="x"):
        return "(" + " or ".join(f"(p_n > {k} and {' and '.join(f'{a} >= p_{a}{k} and {a} < p_{a}{a}{k}' for a in AXES)})" for k in range(self.num_holes_range[1])) + ")"


#: The cube's 48 symmetries: a permutation of the axes and which of them are mirrored.
SYMMETRIES = [(p, m) for p in permutations(range(3)) for m in product((0, 1), repeat=3)]


@operator
class CubicSymmetry(Operator):
    index: int | None = None
    p: float = 1.0
    spatial = True

    def draws(self, d: Draws):
        return {"k": str(self.index) if self.index is not None else f"cast(floor({d.unit('k')} * 48) as int)"}

    def on_pixels(self, df, channels, top):
        def source(axis: int, of) -> str:
            return "case p_k " + " ".join(f"when {i} then {of(p[axis], m[axis])}" for i, (p, m) in enumerate(SYMMETRIES)) + " end"

        new = {a: source(k, lambda s, flip: f"{SIDES[AXES[s]]} - 1 - {AXES[s]}" if flip else AXES[s]) for k, a in enumerate(AXES)}
        sides = {SIDES[a]: source(k, lambda s, flip: SIDES[AXES[s]]) for k, a in enumerate(AXES)}
        return moved(df, **new, **sides)

    def on_keypoints(self, df):
        return self.on_pixels(df, 0, 0)


def volume_rows(df: DataFrame) -> DataFrame:
    return df.select("sample_id", "d", "h", "w", "z", "y", "x", "v0")


