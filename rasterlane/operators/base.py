"""Frames of samples and what every operator is.

A frame holds the relations of its samples. Every row carries the sample's identity and size, so that
an operator's parameters are expressions in the row itself: no join, no shuffle, and pointwise or
rigid operators in a chain become one projection.

    pixels     sample_id, h, w, y, x, v0 ... v<channels - 1>
    volumes    sample_id, d, h, w, z, y, x, v0 ...
    boxes      sample_id, h, w, box_ix, x_min, y_min, x_max, y_max (0 to 1), label
    keypoints  sample_id, h, w, kp_ix, x, y, angle, scale (pixels, radians), label
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields, replace
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlane.functions.sampling import Draws, num

from .arguments import checked

OPERATORS: dict[str, type[Operator]] = {}
KINDS = ("pixels", "masks", "boxes", "keypoints")
#: Whether a row's sample is to change, while an operator that looks after closed gates itself is at work.
GATE = "__gate"


@dataclass(frozen=True)
class Named:
    """A further relation of the samples: a second image, the frames of a clip, boxes of another source.

    kind: pixels, masks, boxes or keypoints. keys: columns that tell a sample's parts apart (the frames of
    a clip): all parts share the sample's draws, and statistics and neighbourhoods are a part's own.
    """

    kind: str
    rows: DataFrame
    keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class Frame:
    pixels: DataFrame | None
    channels: int = 3
    masks: DataFrame | None = None
    boxes: DataFrame | None = None
    keypoints: DataFrame | None = None
    top: float = 255.0  # largest value: 255, or 1 for floating point
    named: dict[str, Named] = field(default_factory=dict)  # their pixels have as many channels

    def relations(self) -> dict[str, DataFrame]:
        found = {n: getattr(self, n) for n in KINDS}
        return {n: df for n, df in found.items() if df is not None} | {n: x.rows for n, x in self.named.items()}

    def each(self, f) -> Frame:
        """f(relation, kind) for all relations, those with names of their own too."""
        return self.each_part(lambda df, kind, keys: f(df, kind))

    def each_part(self, f) -> Frame:
        """The same with the keys of a relation's parts."""
        own = {n: f(getattr(self, n), n, ()) for n in KINDS if getattr(self, n) is not None}
        return replace(self, **own, named={n: replace(x, rows=f(x.rows, x.kind, x.keys)) for n, x in self.named.items()})


class Record(NamedTuple):
    """One operator's recorded draws: a struct column of applied and the draws named, in rows by sample_id."""

    rows: DataFrame
    column: str
    names: tuple[str, ...]


def operator(cls: type[Operator]) -> type[Operator]:
    """Registers a dataclass operator under its snake_case name."""
    cls = dataclass(frozen=True)(cls)
    name = "".join(f"_{c.lower()}" if c.isupper() and i and (not cls.__name__[i - 1].isupper() and not cls.__name__[i - 1].isdigit()) else c.lower() for i, c in enumerate(cls.__name__))
    cls.name = name
    OPERATORS[name] = cls
    return cls


class Operator:
    """p: the share of samples that it is applied to; draws(): its random numbers, by name.

    Subclasses give expressions for what they change: pixel() for values, place() for coordinates,
    or override on_pixels(), on_boxes(), on_keypoints(), which get the draws as columns.
    """

    p: float = 1.0
    name = "operator"
    #: Whether masks follow the pixels (spatial operators) or stay.
    spatial = False
    #: Whether it needs a statistic of the sample, which samples without an id do not have.
    statistic = False
    #: Whether its draws can be made for rows whose gate is closed, too: Spark works out what draws have
    #: in common once only where no condition is around them.
    unconditional = False

    def __post_init__(self):
        checked(self)

    def draws(self, d: Draws) -> dict[str, str]:
        return {}

    def every_draw(self, d: Draws) -> dict[str, str]:
        """draws() and what a family of operators draws beside them."""
        return self.draws(d)

    def out_size(self) -> tuple[str, str]:
        """Height and width of the result, over h, w and the draws (p_<name>)."""
        return "h", "w"

    def on_pixels(self, df: DataFrame, channels: int, top: float) -> DataFrame:
        return df

    def on_masks(self, df: DataFrame, channels: int, top: float) -> DataFrame:
        return self.on_pixels(df, 1, top) if self.spatial else df

    def on_boxes(self, df: DataFrame) -> DataFrame:
        return df

    def on_keypoints(self, df: DataFrame) -> DataFrame:
        return df

    def out_channels(self, channels: int) -> int:
        return channels

    def out_top(self, top: float) -> float:
        return top

    #: Relations for which the operator itself leaves rows alone where the column GATE is false (what
    #: drops, adds or gathers rows has to); for others old values are put back in the same projection.
    own: tuple = ()

    def run(self, frame: Frame, seed: int = 0, path: str = "0", forced: bool = False, params: Record | None = None, when: str | None = None) -> Frame:
        """The frame with this operator applied where its gate opens (everywhere if forced).

        A closed gate is a condition in the row, never a branch of the plan: each relation is read
        once however many operators a plan has. when: a condition that has to hold too. params:
        recorded draws to use instead, in a column that the relations have. Samples without an id,
        and samples that were not recorded, stay as they are.
        """
        d = Draws(seed, f"{path}.{self.name}")
        gate = self.gate(d, forced, when) if params is None else f"coalesce({params.column}.applied, false)"
        named = {f"p_{k}": v if params is None or k not in params.names else f"{params.column}.{k}" for k, v in self.every_draw(d).items()}

        def apply(df: DataFrame, kind: str, keys: tuple[str, ...]) -> DataFrame:
            on = getattr(self, f"on_{kind}")
            if getattr(type(self), on.__name__) is getattr(Operator, on.__name__) and not (kind == "masks" and self.spatial):
                return df  # the relation is not touched, so nothing is drawn for it
            act = (lambda x: on(x, frame.channels if kind == "pixels" else 1, frame.top)) if kind in ("pixels", "masks") else on
            if keys:
                if getattr(self, "reference", None) is not None:
                    raise ValueError(f"{self.name} has one reference for a sample, so it cannot act on parts of samples")
                act = by_parts(act, keys)
            if gate is None:
                return act(df.withColumns({k: F.expr(v) for k, v in named.items()})).drop(*named)
            if gate == "false":
                return df
            draw = lambda x, g: x.withColumns({k: F.expr(v if self.unconditional else f"case when {g} then {v} end") for k, v in named.items()})
            return gated(df, kind, frame, draw, self, act, gate).drop(*named)

        out = frame.each_part(apply)
        return replace(out, channels=self.out_channels(frame.channels), top=self.out_top(frame.top))

    def gate(self, d: Draws, forced: bool, when: str | None = None) -> str | None:
        """The condition under which a sample changes; None where all do."""
        mine = [] if forced or self.p >= 1 else ["false"] if self.p <= 0 else [f"{d.unit('gate')} < {num(self.p)}"]
        if "false" in mine:
            return "false"
        if not mine and (self.statistic or self.every_draw(d)):
            mine = ["sample_id is not null"]
        both = [*([f"({when})"] if when else []), *mine]
        return f"coalesce({' and '.join(both)}, false)" if both else None

    def recorded(self, samples: DataFrame, seed: int = 0, path: str = "0", forced: bool = False, when: str | None = None) -> DataFrame:
        """(sample_id, applied, p_<name> ...): this operator's draws for samples (sample_id, h, w)."""
        d = Draws(seed, f"{path}.{self.name}")
        gate = self.gate(d, forced, when) or "true"
        return samples.select("sample_id", F.expr(gate).alias("applied"), *[F.expr(v).alias(f"p_{k}") for k, v in self.by_sample(d).items()])

    def by_sample(self, d: Draws) -> dict[str, str]:
        """The draws that are one for a sample; those of its pixels follow from the same seed again."""
        return {k: v for k, v in self.every_draw(d).items() if not re.search(r"(?<![\w'.])[xyz](?![\w'(])", v)}

    def spec(self) -> dict:
        return {"operator": self.name, **{f.name: getattr(self, f.name) for f in fields(self)}}


def gated(df: DataFrame, kind: str, frame: Frame, draw, op: Operator, act, gate: str) -> DataFrame:
    """act on the rows of df where gate holds, in one pass: draw adds the draws given a gate column."""
    columns = df.columns
    if kind in op.own:
        return act(draw(df.withColumn(GATE, F.expr(gate)), GATE)).drop(GATE)
    moves = ("d", "h", "w", "z", "y", "x") if kind in ("pixels", "masks") else ("d", "h", "w", "z", "y", "x", "x_min", "y_min", "x_max", "y_max", "angle", "scale")
    kept = [c for c in columns if c in moves and op.spatial] + [c for c in columns if kind in ("pixels", "masks") and not op.spatial and c in values(frame.channels if kind == "pixels" else 1)]
    # an operator inside another's gate (SelectiveChannelTransform) has its own names
    at = next(n for n in range(1000) if f"__was{n}" not in columns)
    was = {f"__was{n}": c for n, c in enumerate(kept, at)}
    shut = f"__shut{at}"
    out = act(draw(df.withColumns({shut: F.expr(f"not ({gate})"), **{o: F.col(c) for o, c in was.items()}}), f"not {shut}"))
    back = {c: F.expr(f"case when {shut} then {o} else {c if c in out.columns else 'null'} end") for o, c in was.items()}
    new = {c: F.expr(f"case when not {shut} then {c} end") for c in out.columns if c not in columns and c.startswith("v") and c[1:].isdigit()}
    return out.withColumns(back | new).drop(shut, *was)


def by_parts(act, keys: tuple[str, ...]):
    """act with every part of a sample as a sample of its own; draws are in the rows by then."""

    def on_parts(df: DataFrame) -> DataFrame:
        out = act(df.withColumn("sample_id", F.struct("sample_id", *keys)).drop(*keys))
        return out.withColumns({k: F.col(f"sample_id.{k}") for k in keys}).withColumn("sample_id", F.col("sample_id.sample_id"))

    return on_parts


def or_old(df: DataFrame, new: str, old: str) -> str:
    """new, or old where df has a gate that is closed."""
    return f"(case when {GATE} then {new} else {old} end)" if GATE in df.columns else new


def or_stays(df: DataFrame, condition: str) -> str:
    """condition, or true where df has a gate that is closed."""
    return f"(not {GATE} or ({condition}))" if GATE in df.columns else condition


def from_spec(spec: dict) -> Operator:
    cls = OPERATORS.get(spec["operator"])
    if cls is None:
        raise ValueError(f"no operator {spec['operator']!r}")
    known = {f.name for f in fields(cls)}
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in spec.items() if k != "operator"}
    if unknown := sorted(set(given) - known):
        raise ValueError(f"{spec['operator']}: unknown arguments {unknown}")
    return cls(**given)


def values(channels: int) -> list[str]:
    return [f"v{i}" for i in range(channels)]


def pointwise(df: DataFrame, channels: int, expression) -> DataFrame:
    """expression(v, channel): the new value as SQL."""
    return df.withColumns({v: F.expr(or_old(df, f"cast({expression(v, i)} as double)", v)) for i, v in enumerate(values(channels))})


def clipped(expression: str, top: float) -> str:
    """Within range; whole numbers (half to even is not needed: floor(x + 0.5)) where top is 255."""
    if top == 255:
        return f"greatest(0e0, least(255e0, floor({expression} + 0.5e0)))"
    return f"greatest(0e0, least({num(top)}, {expression}))"


def pair(value) -> tuple[float, float]:
    """A range from a number a (-a to a) or a pair."""
    return (-abs(value), abs(value)) if isinstance(value, (int, float)) else (float(value[0]), float(value[1]))


def dumps(spec: dict) -> str:
    return json.dumps(spec, sort_keys=True)
