"""Plans of operators: in order, one of, some of, on some channels, and again from recorded draws.

A choice is a hash of the sample, so it is a condition in the relations' own rows: children follow one
another, each with the condition under which it acts. A plan reads its input once however many choices
it has, and needs no shuffle beyond what its operators need. Specs are plain JSON.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlane.functions.annotations import BoxParams, KeypointParams
from rasterlane.functions.sampling import Draws, num
from rasterlane.operators import OPERATORS, Frame, Operator, from_spec
from rasterlane.operators.base import Record, values


def both(*conditions: str | None) -> str | None:
    return " and ".join(f"({c})" for c in conditions if c) or None


class Leaf(NamedTuple):
    """An operator of a plan: where it stands, whether it acts for certain, the condition under which it
    acts, and the channels that it sees (None: all)."""

    path: str
    operator: Operator
    forced: bool
    when: str | None
    channels: tuple[int, ...] | None = None


@dataclass(frozen=True)
class Recording:
    """What a plan drew: a row for each sample, a struct column for each operator.

    rows: sample_id, h, w (after the last operator) and step0 ... (applied, the draws of the sample).
    """

    rows: DataFrame
    steps: dict[str, tuple[str, str, tuple[str, ...]]]  # path -> column, operator, names of the draws
    seed: int

    def record(self, path: str) -> Record:
        column, _, names = self.steps[path]
        return Record(self.rows, column, names)

    def params(self) -> DataFrame:
        """sample_id, step, path, operator, applied, params (JSON of the draws; null where not applied)."""
        every = []
        for n, (path, (column, name, names)) in enumerate(self.steps.items()):
            drawn = F.to_json(F.struct(*[F.col(f"{column}.{k}").alias(k) for k in names])) if names else F.lit("{}")
            applied = F.col(f"{column}.applied")
            every.append(F.struct(F.lit(n).alias("step"), F.lit(path).alias("path"), F.lit(name).alias("operator"), applied.alias("applied"), F.when(applied, drawn).alias("params")))
        return self.rows.select("sample_id", F.explode(F.array(*every)).alias("s")).select("sample_id", "s.*")


@dataclass(frozen=True)
class Plan:
    transforms: tuple = ()
    p: float = 1.0

    def __len__(self):
        return len(self.transforms)

    def __iter__(self):
        return iter(self.transforms)

    def __getitem__(self, i):
        return self.transforms[i]

    def __add__(self, other):
        more = other if isinstance(other, (list, tuple)) else (other,)
        return replace(self, transforms=(*self.transforms, *more))

    def __radd__(self, other):
        more = other if isinstance(other, (list, tuple)) else (other,)
        return replace(self, transforms=(*more, *self.transforms))

    def __sub__(self, cls):
        """Without the first operator of a class."""
        i = next((i for i, t in enumerate(self.transforms) if isinstance(t, cls)), None)
        if i is None:
            raise ValueError(f"no {cls.__name__} in the plan")
        return replace(self, transforms=self.transforms[:i] + self.transforms[i + 1 :])

    def gate(self, d: Draws, forced: bool) -> str | None:
        return None if forced or self.p >= 1 else f"{d.unit('gate')} < {num(self.p)}"

    def steps(self, seed: int, path: str, forced: bool = False, when: str | None = None) -> Iterator[tuple[str, Operator | Plan, bool, str | None]]:
        """(path, child, forced, condition) in the order in which children act."""
        for i, t in enumerate(self.transforms):
            yield f"{path}.{i}", t, False, both(when, self.gate(Draws(seed, f"{path}.{type(self).__name__}"), forced))

    def leaves(self, seed: int, path: str = "0", forced: bool = False, when: str | None = None) -> Iterator[Leaf]:
        """The same of all operators, however deep."""
        for at, t, sure, c in self.steps(seed, path, forced, when):
            if isinstance(t, Operator):
                yield Leaf(at, t, sure, c)
            else:
                yield from t.leaves(seed, at, sure, c)

    def run(self, frame: Frame, seed: int = 0, path: str = "0", forced: bool = False, when: str | None = None, params: Recording | None = None) -> Frame:
        """params: recorded draws to use instead; the relations have their columns."""
        for at, t, sure, c in self.steps(seed, path, forced, when):
            frame = self.after(self.child(t, frame, seed, at, sure, c, params))
        return frame

    def child(self, t, frame: Frame, seed: int, at: str, sure: bool, c: str | None, params: Recording | None) -> Frame:
        if isinstance(t, Operator) and params is not None:
            return t.run(frame, seed, at, params=params.record(at))
        return t.run(frame, seed, at, sure, when=c, **({} if isinstance(t, Operator) else {"params": params}))

    def after(self, frame: Frame) -> Frame:
        """What follows each child."""
        return frame

    def spec(self) -> dict:
        return {"plan": type(self).__name__, "p": self.p, "transforms": [t.spec() for t in self.transforms]}


@dataclass(frozen=True)
class Sequential(Plan):
    p: float = 0.5


@dataclass(frozen=True)
class Compose(Plan):
    """The outermost plan: annotation formats in and out, filters between the operators."""

    boxes: BoxParams | None = None
    keypoints: KeypointParams | None = None
    strict: bool = False
    seed: int = 0
    #: (name, kind) of the named relations that the plan acts on; others pass unchanged, or fail if strict.
    additional_targets: tuple = ()
    #: Whether all pixels and masks of a sample must have one size.
    is_check_shapes: bool = True

    def __call__(self, frame: Frame) -> Frame:
        if self.strict and (unknown := [t for t in self.transforms if not isinstance(t, (Operator, Plan))]):
            raise ValueError(f"not operators: {unknown}")
        known = dict(self.additional_targets)
        if wrong := sorted(n for n, x in frame.named.items() if n in known and x.kind != known[n]):
            raise ValueError(f"relations of another kind than declared: {wrong}")
        others = {n: x for n, x in frame.named.items() if n not in known}
        if self.strict and others:
            raise ValueError(f"relations that are no additional targets: {sorted(others)}")
        frame = replace(frame, named={n: x for n, x in frame.named.items() if n in known})
        if self.is_check_shapes:
            check_shapes(frame)
        out = self.run(self.annotated(frame, "prepared"), self.seed)
        out = self.annotated(out, "finished")
        return replace(out, named=out.named | others)

    def annotated(self, frame: Frame, step: str) -> Frame:
        """A step of the box and keypoint parameters on all relations of these kinds."""
        params = {"boxes": self.boxes, "keypoints": self.keypoints}
        return frame.each(lambda df, kind: getattr(params[kind], step)(df) if params.get(kind) else df)

    def recorded(self, samples: DataFrame) -> Recording:
        """What the plan draws for samples (sample_id, h, w, and columns that its operators name).

        Sizes are followed from operator to operator, so draws that are shares of a side are those of
        the run. Draws of single pixels are not stored: they follow from the seed, the place and the pixel.
        """
        df, steps = samples.withColumns({"h": F.col("h").cast("int"), "w": F.col("w").cast("int")}), {}
        for n, leaf in enumerate(self.leaves(self.seed)):
            op, d = leaf.operator, Draws(self.seed, f"{leaf.path}.{leaf.operator.name}")
            draws = op.by_sample(d)
            df = df.withColumn("__on", F.expr(op.gate(d, leaf.forced, leaf.when) or "true"))
            df = df.withColumns({f"p_{k}": F.expr(f"case when __on then {v} end") for k, v in draws.items()})
            h, w = op.out_size()
            step = F.struct(F.col("__on").alias("applied"), *[F.col(f"p_{k}").alias(k) for k in draws])
            df = df.withColumns({f"step{n}": step, "__h": F.expr(f"cast(case when __on then {h} else h end as int)"), "__w": F.expr(f"cast(case when __on then {w} else w end as int)")})
            df = df.drop("__on", "h", "w", *[f"p_{k}" for k in draws]).withColumnsRenamed({"__h": "h", "__w": "w"})
            steps[leaf.path] = (f"step{n}", op.name, tuple(draws))
        return Recording(df.select("sample_id", "h", "w", *[s[0] for s in steps.values()]), steps, self.seed)

    def after(self, frame):
        params = {"boxes": self.boxes, "keypoints": self.keypoints}
        return frame.each(lambda df, kind: params[kind].filtered(df) if params.get(kind) and params[kind].check_each_transform else df)

    def spec(self):
        out = super().spec() | {"seed": self.seed, "strict": self.strict, "is_check_shapes": self.is_check_shapes}
        if self.additional_targets:
            out["additional_targets"] = [list(x) for x in self.additional_targets]
        return out | {n: vars(getattr(self, n)) for n in ("boxes", "keypoints") if getattr(self, n)}


def check_shapes(frame: Frame) -> None:
    """Fails if two pixel or mask relations give a sample different sizes: one small job over their first pixels."""
    sizes = []
    frame.each(lambda df, kind: sizes.append(df.where("y = 0 and x = 0").select("sample_id", "h", "w")) or df if kind in ("pixels", "masks") else df)
    if len(sizes) < 2 and not any(x.keys for x in frame.named.values()):
        return
    every = sizes[0]
    for more in sizes[1:]:
        every = every.unionByName(more)
    odd = every.where("sample_id is not null").groupBy("sample_id").agg(F.count_distinct(F.struct("h", "w")).alias("n")).where("n > 1").take(1)
    if odd:
        raise ValueError(f"relations differ in the size of sample {odd[0]['sample_id']}")


def choice(d: Draws, weights: list[float]) -> str:
    """Number of the branch: the first whose cumulative weight exceeds one uniform draw; equal weights
    where all are zero."""
    weights = weights if sum(weights) > 0 else [1.0] * len(weights)
    total, at, u = sum(weights), 0.0, d.unit("choice")
    cases = []
    for i, w in enumerate(weights[:-1]):
        at += w / total
        cases.append(f"when {u} < {num(at)} then {i}")
    return f"(case {' '.join(cases)} else {len(weights) - 1} end)" if cases else "0"


@dataclass(frozen=True)
class OneOf(Plan):
    """One child, drawn by the children's p; it is then applied for certain."""

    p: float = 0.5

    def picked(self, d: Draws) -> str:
        return choice(d, [t.p for t in self.transforms])

    def steps(self, seed, path, forced=False, when=None):
        d = Draws(seed, f"{path}.{type(self).__name__}")
        c, gate = self.picked(d), both(when, self.gate(d, forced))
        for i, t in enumerate(self.transforms):
            yield f"{path}.{i}", t, True, both(gate, f"{c} = {i}")

    def run(self, frame, seed=0, path="0", forced=False, when=None, params=None):
        """Children exclude each other, so each takes the frame's channels and range as they came in."""
        out, shapes = frame, set()
        for at, t, sure, c in self.steps(seed, path, forced, when):
            out = self.child(t, replace(out, channels=frame.channels, top=frame.top), seed, at, sure, c, params)
            shapes.add(out.channels)
        if len(shapes) > 1:
            raise ValueError("branches differ in their number of channels")
        return out


@dataclass(frozen=True)
class OneOrOther(OneOf):
    """The first with probability p, else the last."""

    p: float = 0.5

    def steps(self, seed, path, forced=False, when=None):
        first = f"{Draws(seed, f'{path}.OneOrOther').unit('choice')} < {num(self.p)}"
        yield f"{path}.0", self.transforms[0], True, both(when, first)
        yield f"{path}.1", self.transforms[-1], True, both(when, f"not ({first})")


@dataclass(frozen=True)
class SomeOf(Plan):
    """n children in their order, without or with replacement; each keeps its own p."""

    n: int = 1
    replace_: bool = False
    p: float = 1.0

    def rank(self, d: Draws, i: int) -> str:
        """Place of child i in the seeded order."""
        u = [d.unit(f"rank{j}") for j in range(len(self.transforms))]
        return "(" + (" + ".join(f"(case when {u[j]} < {u[i]} or ({u[j]} = {u[i]} and {j} < {i}) then 1 else 0 end)" for j in range(len(u)) if j != i) or "0") + ")"

    def times(self, d: Draws, i: int) -> str:
        """How often child i is drawn."""
        if not self.replace_:
            return f"(case when {self.rank(d, i)} < {self.n} then 1 else 0 end)"
        m = len(self.transforms)
        return "(" + " + ".join(f"(case when cast(floor({d.unit(f'pick{k}')} * {m}) as int) = {i} then 1 else 0 end)" for k in range(self.n)) + ")"

    def steps(self, seed, path, forced=False, when=None):
        d = Draws(seed, f"{path}.{type(self).__name__}")
        gate = both(when, self.gate(d, forced))
        for i, t in enumerate(self.transforms):
            for k in range(self.n if self.replace_ else 1):
                yield f"{path}.{i}.{k}", t, False, both(gate, f"{self.times(d, i)} > {k}")


@dataclass(frozen=True)
class RandomOrder(SomeOf):
    """n children in a drawn order: a position at a time, rows go to the child that is theirs."""

    def steps(self, seed, path, forced=False, when=None):
        d = Draws(seed, f"{path}.{type(self).__name__}")
        m, gate = len(self.transforms), both(when, self.gate(d, forced))
        for k in range(self.n if self.replace_ else min(self.n, m)):
            for i, t in enumerate(self.transforms):
                mine = f"cast(floor({d.unit(f'pick{k}')} * {m}) as int) = {i}" if self.replace_ else f"{self.rank(d, i)} = {k}"
                yield f"{path}.{i}.{k}", t, False, both(gate, mine)


@dataclass(frozen=True)
class SelectiveChannelTransform(Plan):
    """Children see only some channels of the pixels, as if these were the sample; sizes must stay.

    Where a child moves or gathers pixels, only these channels do: they are put back beside the others by
    a join on the place. Otherwise all is done in the row.
    """

    channels: tuple = (0, 1, 2)
    p: float = 1.0

    def leaves(self, seed, path="0", forced=False, when=None):
        for leaf in super().leaves(seed, path, forced, when):
            if leaf.operator.out_size() != ("h", "w"):
                raise ValueError(f"{leaf.operator.name} changes sizes, so it cannot act on some channels alone")
            yield leaf._replace(channels=tuple(self.channels[i] for i in leaf.channels) if leaf.channels else tuple(self.channels))

    def run(self, frame, seed=0, path="0", forced=False, when=None, params=None):
        if any(leaf.operator.spatial or "pixels" in leaf.operator.own for leaf in self.leaves(seed, path, forced, when)):
            keys = ["sample_id", "y", "x"]
            part = frame.pixels.withColumnsRenamed({v: f"keep_{v}" for v in values(frame.channels)}).withColumns({f"v{k}": F.col(f"keep_v{c}") for k, c in enumerate(self.channels)}).drop(*[f"keep_{v}" for v in values(frame.channels)])
            inner = super().run(Frame(part, len(self.channels), top=frame.top), seed, path, forced, when, params)
            new = inner.pixels.select(*keys, *[F.col(f"v{k}").alias(f"new_v{c}") for k, c in enumerate(self.channels)])
            back = frame.pixels.join(new, keys, "left")
            changed = {f"v{c}": F.coalesce(f"new_v{c}", f"v{c}") for c in self.channels}
            return replace(frame, pixels=back.withColumns(changed).select(*frame.pixels.columns))
        others = [v for i, v in enumerate(values(frame.channels)) if i not in self.channels]
        renamed = frame.pixels.withColumnsRenamed({v: f"keep_{v}" for v in values(frame.channels)})
        part = renamed.withColumns({f"v{k}": F.col(f"keep_v{c}") for k, c in enumerate(self.channels)})
        inner = super().run(Frame(part, len(self.channels), top=frame.top), seed, path, forced, when, params)
        back = inner.pixels.withColumns({f"new_v{c}": F.col(f"v{k}") for k, c in enumerate(self.channels)}).drop(*values(len(self.channels)))
        back = back.select(*[c for c in frame.pixels.columns if c not in values(frame.channels)], *[F.col(f"keep_{v}" if v in others else f"new_{v}").alias(v) for v in values(frame.channels)])
        return replace(frame, pixels=back)

    def spec(self):
        return super().spec() | {"channels": list(self.channels)}


@dataclass(frozen=True)
class ReplayCompose(Compose):
    """Replays recorded draws (see Compose.recorded), those of nested plans too, on other relations."""

    def replay(self, frame: Frame, recorded: Recording) -> Frame:
        """The frame as the recorded run would have left it: one join for each relation."""
        columns = [s[0] for s in recorded.steps.values()]
        joined = frame.each(lambda df, n: df.join(recorded.rows.select("sample_id", *columns), "sample_id", "left"))
        return self.run(joined, recorded.seed, params=recorded).each(lambda df, n: df.drop(*columns))


PLANS = {c.__name__: c for c in (Compose, Sequential, OneOf, OneOrOther, SomeOf, RandomOrder, SelectiveChannelTransform, ReplayCompose)}


def to_spec(plan: Plan | Operator) -> dict:
    return plan.spec()


def plan_from_spec(spec: dict) -> Plan | Operator:
    if "plan" not in spec:
        return from_spec(spec)
    if spec["plan"] not in PLANS:
        raise ValueError(f"no plan {spec['plan']!r}")
    cls, more = PLANS[spec["plan"]], {k: v for k, v in spec.items() if k not in ("plan", "transforms", "boxes", "keypoints")}
    more = {k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in more.items()}
    if "boxes" in spec:
        more["boxes"] = BoxParams(**{k: tuple(v) if isinstance(v, list) else v for k, v in spec["boxes"].items()})
    if "keypoints" in spec:
        more["keypoints"] = KeypointParams(**{k: tuple(v) if isinstance(v, list) else v for k, v in spec["keypoints"].items()})
    return cls(transforms=tuple(plan_from_spec(t) for t in spec["transforms"]), **more)


def save(plan: Plan | Operator, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(to_spec(plan), f, indent=1, sort_keys=True)


def load(path: str) -> Plan | Operator:
    with open(path, encoding="utf-8") as f:
        return plan_from_spec(json.load(f))


__all__ = ["OPERATORS", "PLANS", "Compose", "OneOf", "OneOrOther", "Plan", "RandomOrder", "ReplayCompose", "SelectiveChannelTransform", "Sequential", "SomeOf", "load", "plan_from_spec", "save", "to_spec"]
