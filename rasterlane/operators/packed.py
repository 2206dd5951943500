"""Samples as rows: plans over whole images, without a relation of pixels.

A row is sample_id, h, w, c, data (bytes, row-major, channels innermost). Gates, draws, windows, sides
and matrices are the operators' own expressions, evaluated by Spark in the sample's row; sizes are
followed through the plan as columns. What is left is done to the bytes in one Arrow pass, however
many operators a plan has: no shuffle, and a task holds a batch of samples. Results equal those of
the pixel relation. Operators without a kernel here (see KERNELS) need that relation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlane.functions.sampling import Draws

from . import dropout, gather, geometry, pointwise, statistics, volume
from .base import Operator

#: Samples that cross to Python at a time.
AT_ONCE = 64


def whole(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def curve(f):
    """A kernel that looks up f(values 0 to 255, draws, operator); one row, or one for each channel."""

    def kernel(img: np.ndarray, q: dict, op) -> np.ndarray:
        table = f(np.arange(256.0), q, op)
        return table[img] if table.ndim == 1 else np.stack([table[i % len(table)][img[..., i]] for i in range(img.shape[2])], axis=2)

    return kernel


def shifted(x, q, op):
    return np.stack([whole(x + q[f"s{i}"]) for i in range(3)])


def normal(x, q, op):
    return np.stack([((x / op.max_pixel_value - m) / s).astype(np.float32) for m, s in zip(op.mean, op.std)])


def grey(img, q, op):
    luma = 0.299 * img[..., 0] + 0.587 * img[..., 1] + 0.114 * img[..., 2]
    return np.repeat(whole(luma)[..., None], op.num_output_channels, axis=2)


def dropped(img, q, op):
    order = sorted(range(img.shape[2]), key=lambda i: (q[f"r{i}"], i))
    out = img.copy()
    out[..., order[: q["n"]]] = op.fill
    return out


TURNS = {"e": lambda x: x, "h": lambda x: x[:, ::-1], "v": lambda x: x[::-1], "r180": lambda x: x[::-1, ::-1], "t": lambda x: x.transpose(1, 0, 2), "r90": np.rot90, "r270": lambda x: np.rot90(x, 3), "hvt": lambda x: x[::-1, ::-1].transpose(1, 0, 2)}


def turned(img, q, op):
    return TURNS[op.elements[q.get("k", 0)]](img)


def cut(img, q, op):
    return img[q["w1"] : q["w3"], q["w0"] : q["w2"]]


def framed(img, q, op):
    sides = ((q["w1"], q["w3"]), (q["w0"], q["w2"]), (0, 0))
    return np.pad(img, sides, constant_values=int(op.fill)) if op.border == "constant" else np.pad(img, sides, "reflect")


def holed(img, q, op):
    out = img.copy()
    for k in range(len([n for n in q if n.startswith("hole")])):
        x0, y0, x1, y1, there = (q[f"hole{k}"][n] for n in ("x0", "y0", "x1", "y1", "e"))
        if there:
            out[y0:y1, x0:x1] = op.fill
    return out


def by_histogram(f):
    def kernel(img, q, op):
        return np.stack([f(np.bincount(img[..., i].ravel(), minlength=256), op)[img[..., i]] for i in range(img.shape[2])], axis=2)

    return kernel


def level(n: np.ndarray, op) -> np.ndarray:
    first, total = n[np.argmax(n > 0)], n.sum()
    return np.arange(256, dtype=np.uint8) if total == first else np.clip(np.rint((np.cumsum(n) - first) * (255 / (total - first))), 0, 255).astype(np.uint8)


def stretch(n: np.ndarray, op) -> np.ndarray:
    cum, v, cut_ = np.cumsum(n), np.arange(256), n.sum() * op.cutoff / 100
    low, high = v[(n > 0) & (cum > cut_)], v[(n > 0) & (n.sum() - cum + n > cut_)]
    if not len(low) or not len(high) or low[0] >= high[-1]:
        return v.astype(np.uint8)
    lo, hi = low[0], high[-1]
    inside = np.floor((cum - cum[lo]) * 255.0 / (cum[hi] - cum[lo]) if op.method == "cdf" else (v - lo) * 255.0 / (hi - lo))
    return np.where(v < lo, 0, np.where(v > hi, 255, inside)).astype(np.uint8)


def boxed(img, q, op):
    """The mean of k x k, mirrored at the edges: shifted rows and columns are added, sums are looked up."""
    k = q["k"]
    h, w = img.shape[:2]
    x = np.pad(img, ((k // 2, k // 2), (k // 2, k // 2), (0, 0)), "reflect").astype(np.uint16 if k <= 16 else np.uint32)
    rows = x[:h].copy()
    for i in range(1, k):
        rows += x[i : i + h]
    out = rows[:, :w].copy()
    for i in range(1, k):
        out += rows[:, i : i + w]
    sums = np.arange(255 * k * k + 1)
    return ((2 * sums + k * k) // (2 * k * k)).astype(np.uint8).take(out)  # floor(mean + 1/2)


def bilinear(img, sy, sx, border: str, fill: float):
    """img at (sy, sx); beyond the edge fill, or a mirror without the edge repeated."""
    h, w, c = img.shape
    ty, tx = np.floor(sy), np.floor(sx)
    fy, fx = ty.astype(np.int64), tx.astype(np.int64)
    np.subtract(sy, ty, out=ty), np.subtract(sx, tx, out=tx)
    if border == "constant":
        flat = np.full((h + 2, w + 2, c), float(fill))
        flat[1:-1, 1:-1] = img
        ys, xs = ([np.clip(f + d, -1, n) + 1 for d in (0, 1)] for f, n in ((fy, h), (fx, w)))
        wide = w + 2
    else:
        flip = lambda i, n: np.zeros_like(i) if n == 1 else (n - 1) - np.abs((n - 1) - i % (2 * n - 2))
        flat, wide = img.astype(float), w
        ys, xs = ([flip(f + d, n) for d in (0, 1)] for f, n in ((fy, h), (fx, w)))
    flat = flat.reshape(-1, c)
    ty, tx = ty[..., None], tx[..., None]
    rest = 1 - tx

    def row(y):
        y = y * wide
        a = flat.take(y + xs[0], axis=0)
        a *= rest
        b = flat.take(y + xs[1], axis=0)
        b *= tx
        a += b
        return a

    above, below = row(ys[0]), row(ys[1])
    above *= 1 - ty
    below *= ty
    above += below
    return whole(above)


def axis_taps(kind: str, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, weight) of the taps of each of size output pixels over n source pixels; see gather.taps."""
    at, scale = np.arange(size, dtype=float)[:, None], 1.0 * n / size
    if kind != "area":
        r, s = gather.TAPS[kind], (at + 0.5) * scale - 0.5
        i = np.floor(s) + np.arange(1 - r, r + 1)
        t = s - np.floor(s) - np.arange(1 - r, r + 1)
        d = np.abs(t)
        if kind == "cubic":
            a = gather.CUBIC
            wt = np.where(d <= 1, ((a + 2) * d - (a + 3)) * d * d + 1, np.where(d < 2, ((a * d - 5 * a) * d + 8 * a) * d - 4 * a, 0))
        else:
            safe = np.where(t == 0, 1, t)
            wt = np.where(t == 0, 1, np.where(d >= 4, 0, np.sin(np.pi * safe) * np.sin(np.pi * safe / 4) / (np.pi * np.pi * safe * safe / 4)))
    elif scale >= 1:
        a, b = at * scale, (at + 1) * scale
        i = np.floor(a) + np.arange(int((np.ceil(b) - np.floor(a)).max()))
        wt = np.maximum(0, np.minimum(i + 1, b) - np.maximum(i, a)) / scale
    else:
        first = np.floor(at * scale)
        end = at + 1 - (first + 1) / scale
        part = np.where(end <= 0, 0, end - np.floor(end))
        i, wt = np.hstack([first, first + 1]), np.hstack([1 - part, part])
    return np.clip(i, 0, n - 1).astype(np.int64), wt


def weighed(img, kind: str, hh: int, ww: int):
    """Columns first, then rows, a tap at a time."""
    (iy, wy), (ix, wx) = axis_taps(kind, img.shape[0], hh), axis_taps(kind, img.shape[1], ww)
    across = sum(wx[None, :, k, None] * img[:, ix[:, k]] for k in range(ix.shape[1]))
    out = sum(wy[:, None, k, None] * across[iy[:, k]] for k in range(iy.shape[1]))
    return whole(np.round(out / (wy.sum(1)[:, None] * wx.sum(1)[None])[..., None], 6))


def scaled(img, q, op):
    (h, w), hh, ww = img.shape[:2], q["w0"], q["w1"]
    if op.way() in gather.TAPS:
        return weighed(img, op.way(), hh, ww)
    if op.way() == "nearest":
        near = lambda n, size: np.floor(np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1) + 0.5).astype(np.int64)
        return img[near(h, hh)][:, near(w, ww)]
    y, x = np.clip((np.arange(hh) + 0.5) * h / hh - 0.5, 0, h - 1), np.clip((np.arange(ww) + 0.5) * w / ww - 0.5, 0, w - 1)
    fy, fx = np.floor(y).astype(int), np.floor(x).astype(int)
    ty, tx = (y - fy)[:, None, None], (x - fx)[None, :, None]
    a, b = img[fy].astype(float), img[np.minimum(fy + 1, h - 1)].astype(float)
    right = np.minimum(fx + 1, w - 1)
    return whole((1 - ty) * ((1 - tx) * a[:, fx] + tx * a[:, right]) + ty * ((1 - tx) * b[:, fx] + tx * b[:, right]))


def warped(img, q, op):
    y, x = np.mgrid[: q["w8"], : q["w9"]].astype(float)
    a, b, c, d, e, f, g, k = (q[f"w{i}"] for i in range(8))
    z = g * x + k * y + 1
    return bilinear(img, (d * x + e * y + f) / z, (a * x + b * y + c) / z, op.border, op.fill)


def sepia(img, q, op):
    r, g, b = (img[..., i].astype(float) for i in range(3))
    return np.stack([whole(x * r + y * g + z * b) for x, y, z in op.MATRIX], axis=2)


def dealt(img, q, op):
    if img.shape[2] != 3:
        raise ValueError(f"{op.name}: samples as rows have three channels here")
    first = int(q["a"] * 3)
    rest = [i for i in range(3) if i != first]
    return img[..., [first, *(rest[::-1] if int(q["b"] * 2) else rest)]]


def toned(x, q, op):
    t = x / 255
    u = 1 - t
    return np.stack([whole((3 * u * u * t * q[f"a{i}"] + 3 * u * t * t * q[f"b{i}"] + t * t * t) * 255) for i in range(4)])


def hue_shifted(img, q, op):
    """Hue in sixths of a turn; see functions.colour."""
    r, g, b = (img[..., i] / 255 for i in range(3))
    hi, lo = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    span = hi - lo
    safe = np.where(span == 0, 1, span)
    h = np.where(span == 0, 0, np.where(hi == r, ((g - b) / safe + 6) % 6, np.where(hi == g, (b - r) / safe + 2, (r - g) / safe + 4)))
    s = np.where(hi == 0, 0, span / np.where(hi == 0, 1, hi))
    h = (h + q["h"] / 30 + 12) % 6
    s, v = np.where(s == 0, 0, np.clip(s + q["s"] / 255, 0, 1)), np.clip(hi + q["v"] / 255, 0, 1)
    turn = [(n + h) % 6 for n in (5, 3, 1)]
    return np.stack([whole(v * (1 - s * np.maximum(0, np.minimum(np.minimum(t, 4 - t), 1))) * 255) for t in turn], axis=2)


def shifts(img, places: list[tuple[int, int]]) -> np.ndarray:
    """The image moved by each of the places, mirrored at its edges: (place, row, column, channel)."""
    r = max(max(abs(y), abs(x)) for y, x in places)
    h, w = img.shape[:2]
    wide = np.pad(img, ((r, r), (r, r), (0, 0)), "reflect")
    return np.stack([wide[r + y : r + y + h, r + x : r + x + w] for y, x in places])


def medians(img, q, op):
    r = q["k"] // 2
    every = shifts(img, [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1)])
    return np.partition(every, len(every) // 2, axis=0)[len(every) // 2]


def extremes(img, q, op):
    r = q["k"] / 2
    at = range(-int(r), int(r) + 1)
    every = shifts(img, [(y, x) for y in at for x in at if y * y + x * x <= r * r])
    return every.max(axis=0) if op.operation == "dilation" else every.min(axis=0)


def windowed(img, q, op):
    """A window at the operator's size."""
    y0, x0, y1, x1 = (q[n] for n in ("y0", "x0", "y1", "x1"))
    way, hh, ww = gather.Scaled.way(op), op.height, op.width
    if way in gather.TAPS:
        return weighed(img[y0:y1, x0:x1], way, hh, ww)
    y, x = (np.clip(a + (np.arange(n) + 0.5) * (b - a) / n - 0.5, a, b - 1) for a, b, n in ((y0, y1, hh), (x0, x1, ww)))
    if way == "nearest":
        return img[np.floor(y + 0.5).astype(np.int64)][:, np.floor(x + 0.5).astype(np.int64)]
    return bilinear(img, *np.meshgrid(y, x, indexing="ij"), "mirror", 0)


#: Operator class -> kernel(image, draws and expressions of the row, operator).
KERNELS = {
    pointwise.NoOp: lambda img, q, op: img,
    pointwise.InvertImg: curve(lambda x, q, op: whole(255 - x)),
    pointwise.Solarize: curve(lambda x, q, op: whole(np.where(x >= q["t"] * 255, 255 - x, x))),
    pointwise.Posterize: curve(lambda x, q, op: whole(np.floor(x / 2 ** (8 - q["bits"])) * 2 ** (8 - q["bits"]))),
    pointwise.RandomBrightnessContrast: curve(lambda x, q, op: whole(x * q["alpha"] + q["beta"] * 255)),
    pointwise.RandomGamma: curve(lambda x, q, op: np.clip(np.floor((x / 255) ** q["gamma"] * 255), 0, 255).astype(np.uint8)),
    pointwise.RGBShift: curve(shifted),
    pointwise.Normalize: curve(normal),
    pointwise.ToGray: grey,
    pointwise.ToSepia: sepia,
    pointwise.ChannelShuffle: dealt,
    pointwise.RandomToneCurve: curve(toned),
    pointwise.HueSaturationValue: hue_shifted,
    pointwise.ChannelDropout: dropped,
    geometry.Symmetry: turned,
    geometry.Window: cut,
    geometry.Padded: framed,
    dropout.Holes: holed,
    statistics.Equalize: by_histogram(level),
    statistics.AutoContrast: by_histogram(stretch),
    gather.Blur: boxed,
    gather.MedianBlur: medians,
    gather.Morphological: extremes,
    gather.CropResized: windowed,
    gather.Scaled: scaled,
    gather.Projected: warped,
}


def kernel_of(op: Operator):
    found = None if type(op).__module__ == volume.__name__ else next((KERNELS[c] for c in type(op).__mro__ if c in KERNELS), None)
    special = {"brightness_by_max": True, "ensure_safe_range": False, "by_channels": True, "mask": None, "mode": ("cv", "camera"), "ignore": None, "method": ("weighted_average", "cdf", "pil"), "normalization": "standard", "linear": True}
    if isinstance(op, (gather.Scaled, gather.CropResized)):
        gather.Scaled.way(op)
        special.pop("linear")
    odd = [n for n, v in special.items() if hasattr(op, n) and getattr(op, n) not in (v if isinstance(v, tuple) else (v,))]
    if found is None or odd or isinstance(op, geometry.CropAndPad) or getattr(op, "fill", 0) == "random":
        raise ValueError(f"{op.name}: no kernel for samples as rows ({', '.join(odd) or 'use the pixel relation'})")
    return found


def expressions(op: Operator) -> dict[str, str]:
    """What a kernel needs beside the draws, over h, w and the draws."""
    if isinstance(op, geometry.Window):
        return {f"w{i}": f"cast({e} as int)" for i, e in enumerate(op.bounds())}
    if isinstance(op, geometry.Padded):
        return {f"w{i}": e for i, e in enumerate(op.sides())}
    if isinstance(op, dropout.Holes):
        return {f"hole{k}": "named_struct('x0', cast({} as int), 'y0', cast({} as int), 'x1', cast({} as int), 'y1', cast({} as int), 'e', {})".format(*h) for k, h in enumerate(op.holes())}
    if isinstance(op, gather.Scaled):
        return {f"w{i}": e for i, e in enumerate(op.size())}
    if isinstance(op, gather.Projected):
        return {f"w{i}": f"cast({e} as double)" for i, e in enumerate(op.matrix())} | {f"w{i}": f"cast({e} as int)" for i, e in enumerate(op.size(), 8)}
    return {}


def on_channels(kernel, img: np.ndarray, q: dict, op, channels: list[int]) -> np.ndarray:
    """img with the kernel's result in some of its channels."""
    part = kernel(np.ascontiguousarray(img[..., channels]), q, op)
    if part.shape != (*img.shape[:2], len(channels)) or part.dtype != img.dtype:
        raise ValueError(f"{op.name} changes size or type, so it cannot act on some channels alone")
    out = img.copy()
    out[..., channels] = part
    return out


def apply(plan, samples: DataFrame, seed: int = 0, forced: bool = False) -> DataFrame:
    """samples (sample_id, h, w, c, data) through an operator or a plan.

    Draws may name other columns of samples (boxes, mask places); the result has the five alone. data of
    an operator that leaves whole numbers (Normalize, which has to come last) is float32. Null data stays
    null, samples without an id pass unchanged where anything has to be drawn, and an empty table gives
    an empty result. Inside SelectiveChannelTransform a kernel sees and changes those channels alone.
    """
    leaves = [(("0", plan, forced, None, None))] if isinstance(plan, Operator) else list(plan.leaves(seed, "0", forced))
    kernels = [kernel_of(op) for _, op, *_ in leaves]
    df = samples.withColumns({"__h0": F.col("h"), "__w0": F.col("w"), "h": F.col("h").cast("int"), "w": F.col("w").cast("int")})
    steps = []
    for n, (path, op, sure, when, channels) in enumerate(leaves):
        d = Draws(seed, f"{path}.{op.name}")
        gate = op.gate(d, sure, when) or "true"
        draws = op.every_draw(d)
        df = df.withColumn("__on", F.expr(gate)).withColumns({f"p_{k}": F.expr(f"case when __on then {v} end") for k, v in draws.items()})
        h, w = op.out_size()
        more = {k: F.expr(f"case when __on then {e} end") for k, e in expressions(op).items()}
        step = F.when(F.col("__on"), F.struct(*[F.col(f"p_{k}").alias(k) for k in draws], *[e.alias(k) for k, e in more.items()], F.lit(0).alias("__")))
        df = df.withColumns({f"__s{n}": step, "__h": F.expr(f"cast(case when __on then {h} else h end as int)"), "__w": F.expr(f"cast(case when __on then {w} else w end as int)")})
        df = df.drop("__on", "h", "w", *[f"p_{k}" for k in draws]).withColumnsRenamed({"__h": "h", "__w": "w"})
        steps.append((f"__s{n}", op, kernels[n], None if channels is None else list(channels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for a in range(0, whole_batch.num_rows, AT_ONCE):
                yield done(whole_batch.slice(a, AT_ONCE))

    def done(batch: pa.RecordBatch) -> pa.RecordBatch:
        named = dict(zip(batch.schema.names, batch.columns))
        shapes = list(zip(*(named[k].to_pylist() for k in ("__h0", "__w0", "c"))))
        images = [None if raw is None else np.frombuffer(raw, np.uint8).reshape(s) for raw, s in zip((x.as_buffer() if x.is_valid else None for x in named["data"]), shapes)]
        for name, op, kernel, channels in steps:
            images = [img if q is None or img is None else kernel(img, q, op) if channels is None else on_channels(kernel, img, q, op, channels) for img, q in zip(images, named[name].to_pylist())]
        size = [img.shape if img is not None else s for img, s in zip(images, shapes)]
        data = pa.array([None if img is None else memoryview(np.ascontiguousarray(img)).cast("B") for img in images], pa.binary())
        return pa.RecordBatch.from_arrays([named["sample_id"], *[pa.array([s[i] for s in size], pa.int32()) for i in range(3)], data], ["sample_id", "h", "w", "c", "data"])

    kind = samples.schema["sample_id"].dataType.simpleString()
    return df.select("sample_id", "__h0", "__w0", "c", "data", *[s[0] for s in steps]).mapInArrow(run, f"sample_id {kind}, h int, w int, c int, data binary")


def unpacked(samples: DataFrame, channels: int) -> DataFrame:
    """The pixel relation of samples with one byte a value."""
    rows = samples.select("sample_id", "h", "w", "data", F.explode(F.expr("sequence(0, h * w - 1)")).alias("i"))
    byte = "conv(hex(substring(data, i * {c} + {k} + 1, 1)), 16, 10)"
    return rows.select("sample_id", "h", "w", F.expr("cast(floor(i / w) as int)").alias("y"), F.expr("i % w").alias("x"), *[F.expr(f"cast({byte.format(c=channels, k=k)} as double)").alias(f"v{k}") for k in range(channels)])
