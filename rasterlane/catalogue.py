"""Every registered query of the engine's own operators, and SQL that another engine can check.

Images come from `embeddings` (8 x 8, three channels), boxes from `lineitem`, keypoints from `events`,
texts from `documents`. Operators run with p = 1 unless the query is about the gate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlane.functions import annotations as ann
from rasterlane.functions.sampling import Draws
from rasterlane.operators import OPERATORS, Frame, Named, dropout, geometry, packed, pointwise, text
from rasterlane.operators.base import values
from rasterlane.plans import compose
from rasterlane.sources import samples as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PX = """WITH e AS (SELECT vec_id AS sample_id, embedding AS e, unnest(range(64)) AS i FROM embeddings),
g AS (SELECT sample_id, i, greatest(0, least(255, floor((e[i + 1]::DOUBLE + 1) * 127.5))) AS v0, greatest(0, least(255, floor((e[64 - i]::DOUBLE + 1) * 127.5))) AS v1 FROM e),
px AS (SELECT sample_id, 8 AS h, 8 AS w, i // 8 AS y, i % 8 AS x, v0, v1, (v0 + 7 * i) % 256 AS v2 FROM g)
"""
BX = """WITH r AS (SELECT l_orderkey AS sample_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS box_ix,
  ((l_partkey * 37) % 100)::DOUBLE AS bx, ((l_suppkey * 53 + l_linenumber * 11) % 70)::DOUBLE AS yt, l_quantity AS bw, 5 + 100 * l_discount AS bh, l_returnflag AS label FROM lineitem),
b AS (SELECT sample_id, 60 AS h, 90 AS w, box_ix, bx / 90 AS x_min, yt / 60 AS y_min, (bx + bw) / 90 AS x_max, (yt + bh) / 60 AS y_max, label FROM r)
"""
KP = """WITH k AS (SELECT user_id AS sample_id, 60 AS h, 90 AS w, event_id AS kp_ix, ((event_id * 31) % 95)::DOUBLE AS x, ((event_id * 17) % 65)::DOUBLE AS y, (event_id % 360) * 0.017453292519943295e0 AS angle, value AS scale, event_type AS label FROM events)
"""
VOL = PX + ", vx AS (SELECT sample_id, 4 AS d, 4 AS h, 4 AS w, (y * 8 + x) // 16 AS z, (y * 8 + x) // 4 % 4 AS y, (y * 8 + x) % 4 AS x, v0 FROM px)\n"


def shown(df: DataFrame, channels: int = 3, keys: tuple = ("sample_id", "y", "x")) -> DataFrame:
    return df.select(*[F.col(k).cast("long").alias(k) for k in keys], *[F.round(F.col(v).cast("double"), 5).alias(v) for v in values(channels)])


def boxes_shown(df: DataFrame) -> DataFrame:
    return df.select("sample_id", F.col("box_ix").cast("long").alias("box_ix"), *[F.round(c, 6).alias(c) for c in ann.BOX], "label")


def keypoints_shown(df: DataFrame) -> DataFrame:
    return df.select("sample_id", "kp_ix", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("x", "y", "angle", "scale")], "label")


def box_sql(x0: str, y0: str, x1: str, y1: str, where: str = "true", cte: str = BX) -> str:
    return f"{cte} SELECT sample_id, box_ix, round({x0}, 6) AS x_min, round({y0}, 6) AS y_min, round({x1}, 6) AS x_max, round({y1}, 6) AS y_max, label FROM b WHERE {where}"


def pixel_sql(y: str, x: str, v: tuple, where: str = "true", cte: str = PX, source: str = "px") -> str:
    cols = ", ".join(f"round(({e})::DOUBLE, 5) AS v{i}" for i, e in enumerate(v))
    return f"{cte} SELECT sample_id, ({y})::BIGINT AS y, ({x})::BIGINT AS x, {cols} FROM {source} WHERE {where}"


def on_pixels(name: str, sql: str | None = None, query: str | None = None, **args) -> None:
    """Registers an operator over the images."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        px = src.embedding_pixels(spark, sf_dir)
        given = dict(args)
        if given.pop("reference_", False):
            n = px.agg((F.max("sample_id") + 1).alias("n"))
            given["reference"] = px.crossJoin(F.broadcast(n)).withColumn("sample_id", F.expr("(sample_id + n - 1) % n")).drop("n")
        for k, e in given.pop("columns_", {}).items():
            px = px.withColumn(k, F.expr(e))
        op = OPERATORS[name](**({"p": 1.0} | given))
        out = op.run(Frame(px, 3))
        return shown(out.pixels, out.channels)

    QUERIES[query or name] = run
    if sql:
        ORACLE_SQL[query or name] = sql


V = ("v0", "v1", "v2")


def same(f: str) -> tuple:
    return tuple(f.replace("@", v) for v in V)


def clip(e: str) -> str:
    return f"greatest(0, least(255, floor({e} + 0.5)))"


def drawn(name: str, cte: str = PX, source: str = "px", more: dict | None = None, **args) -> str:
    """cte with q: the source with an operator's draws (and more columns) beside it."""
    draws = OPERATORS[name](**({"p": 1.0} | args)).draws(Draws(0, f"0.{name}"))
    extra = "".join(f", {e} AS {k}" for k, e in (more or {}).items())
    return f"{cte}, r AS (SELECT *{extra} FROM {source}), q AS (SELECT *{''.join(f', {e} AS p_{k}' for k, e in draws.items())} FROM r)\n"


def window_sql(name: str, x0: str, y0: str, x1: str, y1: str, more: dict | None = None, **args) -> str:
    """Pixels of a window that moves to 0, 0."""
    return pixel_sql(f"y - {y0}", f"x - {x0}", V, f"x >= {x0} AND x < {x1} AND y >= {y0} AND y < {y1}", drawn(name, more=more, **args), "q")


def taps_sql(cte: str, hh: str, ww: str, sy: str, sx: str, fill: str | None = None) -> str:
    """Each output pixel oy, ox of a sample q (hh x ww) mixes the four sources around (sy, sx); beyond the
    edge lies fill, or nothing does (then sy and sx are within the sample)."""
    per = "s AS (SELECT * FROM q WHERE y = 0 AND x = 0)"
    grid = f"o AS (SELECT *, unnest(range(({ww})::BIGINT)) AS ox FROM (SELECT *, unnest(range(({hh})::BIGINT)) AS oy FROM s))"
    at = f"m AS (SELECT sample_id, oy, ox, ({sy})::DOUBLE AS sy, ({sx})::DOUBLE AS sx FROM o)"
    near = "n AS (SELECT m.*, dy, dx, floor(sy) + dy AS ty, floor(sx) + dx AS tx FROM m, (SELECT unnest([0, 0, 1, 1]) AS dy, unnest([0, 1, 0, 1]) AS dx))"
    tap = lambda i, dy, dx: f"coalesce(max(px.v{i}) FILTER (WHERE dy = {dy} AND dx = {dx}), {fill or 0})"
    row = lambda i, dy: f"((1 - (sx - floor(sx))) * {tap(i, dy, 0)} + (sx - floor(sx)) * {tap(i, dy, 1)})"
    v = ", ".join(f"{clip(f'((1 - (sy - floor(sy))) * {row(i, 0)} + (sy - floor(sy)) * {row(i, 1)})')} AS v{i}" for i in range(3))
    return f"{cte}, {per}, {grid}, {at}, {near}\nSELECT n.sample_id, oy::BIGINT AS y, ox::BIGINT AS x, {v} FROM n LEFT JOIN px ON px.sample_id = n.sample_id AND px.y = n.ty AND px.x = n.tx GROUP BY n.sample_id, oy, ox, sy, sx"


on_pixels("no_op", pixel_sql("y", "x", V))
on_pixels("invert_img", pixel_sql("y", "x", same("255 - @")))
on_pixels("solarize", pixel_sql("y", "x", same("CASE WHEN @ >= 127.5 THEN 255 - @ ELSE @ END")))
on_pixels("posterize", pixel_sql("y", "x", same("floor(@ / 16) * 16")))
on_pixels("random_brightness_contrast", pixel_sql("y", "x", same(clip("@ * 1.2 + 25.5"))), brightness_limit=(0.1, 0.1), contrast_limit=(0.2, 0.2))
on_pixels("random_gamma", pixel_sql("y", "x", same("floor(pow(@ / 255.0, 1.2) * 255)")), gamma_limit=(120, 120))
on_pixels("normalize", pixel_sql("y", "x", ("(v0 / 255.0 - 0.485) / 0.229", "(v1 / 255.0 - 0.456) / 0.224", "(v2 / 255.0 - 0.406) / 0.225")))
on_pixels("normalize", PX + "SELECT sample_id, y::BIGINT AS y, x::BIGINT AS x, " + ", ".join(f"round(({v} - min({v}) OVER s) / (max({v}) OVER s - min({v}) OVER s + 1e-4), 5) AS {v}" for v in V) + " FROM px WINDOW s AS (PARTITION BY sample_id)", "normalize_min_max_per_channel", normalization="min_max_per_channel")
on_pixels("to_float", pixel_sql("y", "x", same("@ / 255.0")))
on_pixels("from_float", pixel_sql("y", "x", same(clip("@ * 0.5"))), max_value=0.5)
on_pixels("to_gray", pixel_sql("y", "x", (clip("0.299 * v0 + 0.587 * v1 + 0.114 * v2"),) * 3))
for m, e in {"average": "(v0 + v1 + v2) / 3.0", "max": "greatest(v0, v1, v2)", "desaturation": "(greatest(v0, v1, v2) + least(v0, v1, v2)) / 2.0"}.items():
    on_pixels("to_gray", pixel_sql("y", "x", (clip(e),) * 3), f"to_gray_{m}", method=m)
on_pixels("to_gray", None, "to_gray_pca", method="pca")
on_pixels("to_gray", None, "to_gray_lab", method="from_lab")
on_pixels("to_rgb", pixel_sql("y", "x", ("v0",) * 3))
on_pixels("to_sepia", pixel_sql("y", "x", tuple(clip(f"{a} * v0 + {b} * v1 + {c} * v2") for a, b, c in ((0.393, 0.769, 0.189), (0.349, 0.686, 0.168), (0.272, 0.534, 0.131)))))
D = Draws
d = D(0, "0.multiplicative_noise")
on_pixels("multiplicative_noise", pixel_sql("y", "x", same(clip(f"@ * {d.between('m', 0.9, 1.1)}"))))
d = D(0, "0.rgbshift")
on_pixels("rgbshift", pixel_sql("y", "x", tuple(clip(f"{v} + {d.between(f's{i}', -20, 20)}") for i, v in enumerate(V))))
d = D(0, "0.channel_dropout")
u = [d.unit(f"r{i}") for i in range(3)]
on_pixels("channel_dropout", pixel_sql("y", "x", tuple(f"CASE WHEN {u[i]} < {u[(i + 1) % 3]} AND {u[i]} < {u[(i + 2) % 3]} THEN 0 ELSE v{i} END" for i in range(3))))
d = D(0, "0.additive_noise")
on_pixels("additive_noise", pixel_sql("y", "x", tuple(clip(f"{v} + {d.between(f'n{i}', -0.1, 0.1)} * 255") for i, v in enumerate(V))))
AT = "y * 65537 + x"
U = [f"({d.unit(f'n{i}', AT)} - 0.5)" for i in range(3)]
B = [[d.unit(f"n{i}:{k}", AT) for k in range(3)] for i in range(3)]
NOISE = {
    "gaussian": [f"0.1 * {d.normal(f'n{i}', AT)}" for i in range(3)],
    "laplace": [f"-0.1 * sign({u}) * ln(1 - 2 * abs({u}) * 0.999999::DOUBLE)" for u in U],
    "beta": [f"0.1 * (list_sort([{', '.join(b)}])[2] - 0.5::DOUBLE)" for b in B],
}
for k, e in NOISE.items():
    on_pixels("additive_noise", pixel_sql("y", "x", tuple(clip(f"v{i} + ({e[i]}) * 255") for i in range(3))), f"additive_noise_{k}", noise_type=k, spatial_mode="per_pixel")
d = D(0, "0.random_tone_curve")
a, b = (f"greatest(0, least(1, {m} + 0.1 * {d.normal(n)}))" for n, m in (("a", 0.25), ("b", 0.75)))
on_pixels("random_tone_curve", pixel_sql("y", "x", same(clip(f"(3 * pow(1 - @ / 255.0, 2) * (@ / 255.0) * {a} + 3 * (1 - @ / 255.0) * pow(@ / 255.0, 2) * {b} + pow(@ / 255.0, 3)) * 255"))))
on_pixels("illumination", pixel_sql("y", "x", same(clip("@ * (1 + 0.1 * exp(-(pow(x - 4, 2) + pow(y - 4, 2)) / (2 * pow(8 * 0.5, 2))))"))), mode="gaussian", intensity_range=(0.1, 0.1), effect_type="brighten", center_range=(0.5, 0.5), sigma_range=(0.5, 0.5))
SLOPE = "(((x / 7.0::DOUBLE - 0.5) * cos(p_angle) + (y / 7.0::DOUBLE - 0.5) * sin(p_angle)) / ((abs(cos(p_angle)) + abs(sin(p_angle))) / 2))"
FAR = "sqrt(pow(x - CASE WHEN p_corner IN (0, 2) THEN 0 ELSE 7 END, 2) + pow(y - CASE WHEN p_corner IN (0, 1) THEN 0 ELSE 7 END, 2)) / sqrt(128.0::DOUBLE)"
for m, e in {"linear": f"(1 - p_i + p_i * ({SLOPE} + 1))", "corner": f"(1 - p_i * {FAR})"}.items():
    on_pixels("illumination", pixel_sql("y", "x", same(clip(f"@ * {e}")), cte=drawn("illumination", mode=m), source="q"), f"illumination_{m}", mode=m)
on_pixels("gauss_noise", pixel_sql("y", "x", tuple(clip(f"v{i} + (p_mean + p_std * p_n{i}) * 255") for i in range(3)), cte=drawn("gauss_noise"), source="q"))
DEALT = "[[0, 1, 2], [0, 2, 1], [1, 0, 2], [1, 2, 0], [2, 0, 1], [2, 1, 0]]"
on_pixels("channel_shuffle", pixel_sql("y", "x", tuple(f"[v0, v1, v2][{DEALT}[2 * floor(p_a * 3)::INT + floor(p_b * 2)::INT + 1][{i + 1}] + 1]" for i in range(3)), cte=drawn("channel_shuffle"), source="q"))
PLANCK = "((1 / (exp(1.438776877e-2 / {w} / {t}) - 1)) / (1 / (exp(1.438776877e-2 / {w} / 6500.0) - 1)))"
GAIN = ["1" if w == "550e-9" else f"{PLANCK.format(w=w, t='p_t')} / {PLANCK.format(w='550e-9', t='p_t')}" for w in ("610e-9", "550e-9", "465e-9")]
on_pixels("planckian_jitter", pixel_sql("y", "x", (clip(f"v0 * {GAIN[0]}"), "v1", clip(f"v2 * {GAIN[2]}")), cte=drawn("planckian_jitter"), source="q"))
CROSS = [f"((p_x{{k}}{b} - p_x{{k}}{a}) * (y - p_y{{k}}{a}) - (p_y{{k}}{b} - p_y{{k}}{a}) * (x - p_x{{k}}{a}))" for a, b in ((0, 1), (1, 2), (2, 0))]
SHADE = " OR ".join(f"(p_n > {k} AND (least({', '.join(CROSS)}) >= 0 OR greatest({', '.join(CROSS)}) <= 0))".format(k=k) for k in (0, 1))
on_pixels("random_shadow", pixel_sql("y", "x", same(f"CASE WHEN {SHADE} THEN {clip('@ * (1 - p_i)')} ELSE @ END"), cte=drawn("random_shadow"), source="q"))
for n in ("shot_noise", "hue_saturation_value", "color_jitter", "random_snow", "isonoise", "fancy_pca", "hestain", "superpixels", "image_compression", "clahe"):
    on_pixels(n)
on_pixels("hestain", None, "hestain_macenko", method="macenko")
on_pixels("hestain", None, "hestain_vahadane", method="vahadane")
#: A preset as plain least squares on the two densities, by Cramer's rule.
STAINS = {"standard": ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11)), "dark": ((0.78, 0.55, 0.28), (0.09, 0.97, 0.21))}
for n, (a, b) in STAINS.items():
    at = lambda x, y: " + ".join(f"{i} * {j}" for i, j in zip(x, y))
    od = [f"(-ln(greatest(1, v{i}) / 255.0::DOUBLE))" for i in range(3)]
    g = [f"({at(a, a)} + 1e-6)::DOUBLE", f"({at(a, b)})::DOUBLE", f"({at(b, b)} + 1e-6)::DOUBLE"]
    amounts = f", k AS (SELECT *, (({at(a, od)}) * {g[2]} - ({at(b, od)}) * {g[1]}) / ({g[0]} * {g[2]} - {g[1]} * {g[1]}) AS c0, (({at(b, od)}) * {g[0]} - ({at(a, od)}) * {g[1]}) / ({g[0]} * {g[2]} - {g[1]} * {g[1]}) AS c1 FROM q)\n"
    back = tuple(clip(f"exp(-((c0 * p_s0 + p_t0) * {a[i]} + (c1 * p_s1 + p_t1) * {b[i]})) * 255") for i in range(3))
    on_pixels("hestain", pixel_sql("y", "x", back, cte=drawn("hestain", preset=n) + amounts, source="k"), f"hestain_{n}", preset=n, augment_background=True)

# rigid geometry
GEOMETRY = {"horizontal_flip": ("y", "7 - x"), "vertical_flip": ("7 - y", "x"), "transpose": ("x", "y"), "time_reverse": ("y", "7 - x")}
for n, (y, x) in GEOMETRY.items():
    on_pixels(n, pixel_sql(y, x, V))
for n, elements in (("d4", geometry.D4.elements), ("square_symmetry", geometry.D4.elements), ("random_rotate90", geometry.RandomRotate90.elements)):
    k = f"cast(floor({D(0, f'0.{n}').unit('k')} * {len(elements)}) as int)"
    to = {"e": ("y", "x"), "r90": ("7 - x", "y"), "r180": ("7 - y", "7 - x"), "r270": ("x", "7 - y"), "v": ("7 - y", "x"), "h": ("y", "7 - x"), "t": ("x", "y"), "hvt": ("7 - x", "7 - y")}
    case = [f"CASE {k} " + " ".join(f"WHEN {i} THEN {to[e][a]}" for i, e in enumerate(elements)) + " END" for a in (0, 1)]
    on_pixels(n, pixel_sql(*case, V))
on_pixels("center_crop", pixel_sql("y - 2", "x - 2", V, "y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5"))
on_pixels("crop", pixel_sql("y - 2", "x - 1", V, "y BETWEEN 2 AND 4 AND x BETWEEN 1 AND 6"), x_min=1, y_min=2, x_max=7, y_max=5)
d = D(0, "0.random_crop")
x0, y0 = f"cast(floor(5 * {d.unit('u')}) as int)", f"cast(floor(5 * {d.unit('v')}) as int)"
on_pixels("random_crop", pixel_sql(f"y - {y0}", f"x - {x0}", V, f"y >= {y0} AND y < {y0} + 4 AND x >= {x0} AND x < {x0} + 4"))
on_pixels("random_crop_from_borders", window_sql("random_crop_from_borders", "p_x0", "p_y0", "p_x1", "p_y1", crop_left=0.3, crop_right=0.3, crop_top=0.3, crop_bottom=0.3), crop_left=0.3, crop_right=0.3, crop_top=0.3, crop_bottom=0.3)
near = {"bx0": "1", "by0": "1", "bx1": "6", "by1": "5"}
on_pixels("random_crop_near_bbox", window_sql("random_crop_near_bbox", "p_x0", "p_y0", "p_x1", "p_y1", near), columns_=near)
union = {"ux0": "0.25e0", "uy0": "0.25e0", "ux1": "0.75e0", "uy1": "0.5e0"}
on_pixels("bbox_safe_random_crop", window_sql("bbox_safe_random_crop", "p_x0", "p_y0", "least(p_x1, 8)", "least(p_y1, 8)", union), columns_=union)
WITHIN = "greatest(p_{a}0, least(p_{a}1 - 1, p_{a}0 + (o{a} + 0.5::DOUBLE) * (p_{a}1 - p_{a}0) / 8 - 0.5))"
on_pixels("random_sized_bbox_safe_crop", taps_sql(drawn("random_sized_bbox_safe_crop", more=union), "8", "8", WITHIN.format(a="y"), WITHIN.format(a="x")), columns_=union)
on_pixels("random_sized_crop", taps_sql(drawn("random_sized_crop"), "8", "8", WITHIN.format(a="y"), WITHIN.format(a="x")))
one = {"o" + k[1:]: e for k, e in union.items()}
on_pixels("at_least_one_bbox_random_crop", window_sql("at_least_one_bbox_random_crop", "p_x", "p_y", "p_x + 4", "p_y + 4", one), columns_=one)
on_pixels("crop_non_empty_mask_if_exists", window_sql("crop_non_empty_mask_if_exists", "p_x", "p_y", "p_x + 4", "p_y + 4", {"mx": "3", "my": "5"}), columns_={"mx": "3", "my": "5"})
PADDED = ", t AS (SELECT DISTINCT sample_id, unnest(range({h})) AS y FROM px), o AS (SELECT sample_id, y, unnest(range({w})) AS x FROM t)\n"
on_pixels("pad", PX + PADDED.format(h=11, w=11) + "SELECT o.sample_id, o.y::BIGINT AS y, o.x::BIGINT AS x, " + ", ".join(f"coalesce({v}, 7.0) AS {v}" for v in V) + " FROM o LEFT JOIN px ON px.sample_id = o.sample_id AND px.y = o.y - 1 AND px.x = o.x - 1", padding=(1, 1, 2, 2), fill=7.0)
on_pixels("pad_if_needed", PX + PADDED.format(h=12, w=11) + "SELECT o.sample_id, o.y::BIGINT AS y, o.x::BIGINT AS x, " + ", ".join(f"coalesce({v}, 0.0) AS {v}" for v in V) + " FROM o LEFT JOIN px ON px.sample_id = o.sample_id AND px.y = o.y - 2 AND px.x = o.x - 1", min_height=12, min_width=11)
MIRROR = "7 - abs(7 - abs({} - 2))"
on_pixels("pad", PX + PADDED.format(h=12, w=12) + f"SELECT o.sample_id, o.y::BIGINT AS y, o.x::BIGINT AS x, v0, v1, v2 FROM o JOIN px ON px.sample_id = o.sample_id AND px.y = {MIRROR.format('o.y')} AND px.x = {MIRROR.format('o.x')}", "pad_mirrored", padding=2, border="mirror")
on_pixels("crop_and_pad", PX + PADDED.format(h=8, w=8) + "SELECT o.sample_id, o.y::BIGINT AS y, o.x::BIGINT AS x, " + ", ".join(f"coalesce({v}, 0.0) AS {v}" for v in V) + " FROM o LEFT JOIN px ON px.sample_id = o.sample_id AND px.y = o.y + 1 AND px.x = o.x + 1 AND px.y >= 1 AND px.x >= 1 AND o.y < 7 AND o.x < 7", px=(-1, 1, 1, -1))
on_pixels("random_grid_shuffle", None)

# neighbourhoods and resampling
OFFSETS = ", n AS (SELECT a.sample_id, a.y, a.x, b.v0, b.v1, b.v2 FROM (SELECT sample_id, y, x, unnest([-1, 0, 1]) AS dy FROM px) a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dx) c JOIN px b ON b.sample_id = a.sample_id AND b.y = 7 - abs(7 - abs(a.y + dy)) AND b.x = 7 - abs(7 - abs(a.x + dx)))\n"
group = " FROM n GROUP BY sample_id, y, x"
on_pixels("blur", PX + OFFSETS + "SELECT sample_id, y::BIGINT AS y, x::BIGINT AS x, " + ", ".join(f"greatest(0, least(255, floor(round(sum({v}) / 9.0, 9) + 0.5))) AS {v}" for v in V) + group, blur_limit=(3, 3))
on_pixels("median_blur", PX + OFFSETS + "SELECT sample_id, y::BIGINT AS y, x::BIGINT AS x, " + ", ".join(f"median({v}) AS {v}" for v in V) + group, blur_limit=(3, 3))
on_pixels("resize", pixel_sql("y // 2", "x // 2", V, "y % 2 = 0 AND x % 2 = 0").replace("y % 2 = 0 AND x % 2 = 0", "y % 2 = 1 AND x % 2 = 1"), "resize_nearest", height=4, width=4, linear=False)
on_pixels("resize", PX + "SELECT sample_id, (y // 2)::BIGINT AS y, (x // 2)::BIGINT AS x, " + ", ".join(f"floor(avg({v}) + 0.5) AS {v}" for v in V) + " FROM px GROUP BY sample_id, y // 2, x // 2", height=4, width=4)
BESIDE = ", n AS (SELECT a.*, b.v0 AS b0, b.v1 AS b1, b.v2 AS b2 FROM (SELECT *, unnest([-1, -1, -1, 0, 0, 0, 1, 1, 1]) AS dy, unnest([-1, 0, 1, -1, 0, 1, -1, 0, 1]) AS dx FROM q) a JOIN px b ON b.sample_id = a.sample_id AND b.y = 7 - abs(7 - abs(a.y + dy)) AND b.x = 7 - abs(7 - abs(a.x + dx)))\n"
SHARP = "sum(b{i} * CASE WHEN dy = 0 AND dx = 0 THEN 8 * p_a + 1 - p_a + p_l * p_a ELSE -p_a END)"
RELIEF = "sum(b{i} * (p_a * CASE WHEN dy = 0 AND dx = 0 THEN 1 WHEN dy = dx THEN dy * (1 + p_s) WHEN dy + dx = 0 THEN 0 ELSE (dy + dx) * p_s END + CASE WHEN dy = 0 AND dx = 0 THEN 1 - p_a ELSE 0 END))"
WIDE = "max(b{i}) FILTER (WHERE dx * dx + dy * dy <= p_k * p_k / 4.0::DOUBLE)"
for n, e in {"sharpen": clip(SHARP), "emboss": clip(RELIEF), "morphological": WIDE}.items():
    on_pixels(n, drawn(n) + BESIDE + "SELECT sample_id, y::BIGINT AS y, x::BIGINT AS x, " + ", ".join(f"{e.format(i=i)} AS v{i}" for i in range(3)) + group)
SIX = "greatest(0, least(7, (o{a} + 0.5::DOUBLE) * 8 / 6 - 0.5))"
CUBED = "CASE WHEN abs(t) <= 1 THEN (1.25::DOUBLE * abs(t) - 2.25) * abs(t) * abs(t) + 1 WHEN abs(t) < 2 THEN ((-0.75::DOUBLE * abs(t) + 3.75) * abs(t) - 6) * abs(t) + 3 ELSE 0 END"
SINC = "CASE WHEN t = 0 THEN 1 WHEN abs(t) >= 4 THEN 0 ELSE sin(pi() * t) * sin(pi() * t / 4) / (pi() * pi() * t * t / 4) END"


def weights_sql(kind: str, n: int) -> str:
    """(o, i, w): the weights of 8 source pixels in each of n."""
    if kind in ("cubic", "lanczos"):
        r = 2 if kind == "cubic" else 4
        every = f"SELECT o, greatest(0, least(7, floor(s) + k)) AS i, {CUBED if kind == 'cubic' else SINC} AS w FROM (SELECT *, s - floor(s) - k AS t FROM (SELECT o, (o + 0.5::DOUBLE) * 8 / {n} - 0.5 AS s, unnest(range({1 - r}, {r + 1})) AS k FROM range({n}) AS r(o)))"
    elif n <= 8:
        every = f"SELECT o, i, greatest(0, least(i + 1, (o + 1) * 8::DOUBLE / {n}) - greatest(i, o * 8::DOUBLE / {n})) AS w FROM range({n}) AS r(o), range(8) AS s(i)"
    else:
        end = f"(o + 1 - (floor(o * 8::DOUBLE / {n}) + 1) * {n} / 8.0::DOUBLE)"
        part = f"CASE WHEN {end} <= 0 THEN 0 ELSE {end} - floor({end}) END"
        every = f"SELECT o, least(7, floor(o * 8::DOUBLE / {n}) + k) AS i, CASE k WHEN 0 THEN 1 - ({part}) ELSE {part} END AS w FROM range({n}) AS r(o), range(2) AS s(k)"
    return f"SELECT o, i, sum(w) AS w, sum(sum(w)) OVER (PARTITION BY o) AS t FROM ({every}) GROUP BY o, i"


def weighed_sql(kind: str, h: int, w: int) -> str:
    v = ", ".join(f"{clip(f'round(sum({v} * a.w * b.w) / (min(a.t) * min(b.t)), 6)')} AS {v}" for v in V)
    return f"{PX}, wy AS ({weights_sql(kind, h)}), wx AS ({weights_sql(kind, w)})\nSELECT sample_id, a.o::BIGINT AS y, b.o::BIGINT AS x, {v} FROM px JOIN wy AS a ON a.i = px.y JOIN wx AS b ON b.i = px.x GROUP BY sample_id, a.o, b.o"


for k in ("area", "cubic", "lanczos"):
    for way, size in (("down", (5, 3)), ("up", (13, 11))):
        on_pixels("resize", weighed_sql(k, *size), f"resize_{k}_{way}", height=size[0], width=size[1], interpolation=k)
for n in ("longest_max_size", "smallest_max_size"):
    on_pixels(n, taps_sql(drawn(n, max_size=6), "6", "6", SIX.format(a="y"), SIX.format(a="x")), max_size=6)
SIDE = "floor(8 * p_s)"
on_pixels("random_scale", taps_sql(drawn("random_scale"), SIDE, SIDE, *[f"greatest(0, least(7, (o{a} + 0.5::DOUBLE) * 8 / {SIDE} - 0.5))" for a in "yx"]))
on_pixels("downscale", PX + "SELECT a.sample_id, a.y::BIGINT AS y, a.x::BIGINT AS x, b.v0, b.v1, b.v2 FROM px a JOIN px b ON b.sample_id = a.sample_id AND b.y = a.y - a.y % 2 AND b.x = a.x - a.x % 2", scale_range=(0.5, 0.5))
TURN = ("3.5 + {z} * (cos(p_a) * (oy - 3.5 - {ty}) - sin(p_a) * (ox - 3.5 - {tx}))", "3.5 + {z} * (cos(p_a) * (ox - 3.5 - {tx}) + sin(p_a) * (oy - 3.5 - {ty}))")
on_pixels("affine", pixel_sql("y", "x", V))
on_pixels("affine", taps_sql(drawn("affine", rotate=(-30, 30), translate_px=(-2, 2)), "8", "8", *[t.format(z=1, ty="p_ty", tx="p_tx") for t in TURN], "0"), "affine_rotated", rotate=(-30, 30), translate_px=(-2, 2))
on_pixels("rotate", taps_sql(drawn("rotate"), "8", "8", *[t.format(z=1, ty=0, tx=0) for t in TURN], "0"))
on_pixels("shift_scale_rotate", taps_sql(drawn("shift_scale_rotate"), "8", "8", *[t.format(z="(1 / p_sx)", ty="p_ty", tx="p_tx") for t in TURN], "0"))
LENS = "(1 + p_k * {r} + p_k * {r} * {r})".format(r="(pow((ox - 4) / 8.0::DOUBLE, 2) + pow((oy - 4) / 8.0::DOUBLE, 2))")
on_pixels("optical_distortion", taps_sql(drawn("optical_distortion"), "8", "8", f"(oy - 4) * {LENS} + 4", f"(ox - 4) * {LENS} + 4", "0"))
for n in ("gaussian_blur", "advanced_blur", "motion_blur", "glass_blur", "unsharp_mask", "random_resized_crop", "safe_rotate", "perspective", "chromatic_aberration", "grid_distortion", "elastic_transform", "piecewise_affine", "thin_plate_spline", "grid_elastic_deform", "zoom_blur"):
    on_pixels(n)
on_pixels("defocus", None, radius=(2, 3))
on_pixels("ringing_overshoot", None, blur_limit=(3, 3))
for n in ("random_rain", "random_fog", "random_sun_flare", "random_gravel", "spatter", "plasma_brightness_contrast", "plasma_shadow"):
    on_pixels(n)

# histograms
HIST = PX + "".join(f", h{i} AS (SELECT sample_id, v, sum(n) OVER (PARTITION BY sample_id ORDER BY v) AS cum, sum(n) OVER (PARTITION BY sample_id) AS total, first_value(n) OVER (PARTITION BY sample_id ORDER BY v) AS f FROM (SELECT sample_id, v{i} AS v, count(*) AS n FROM px GROUP BY ALL))" for i in range(3)) + "\n"
EQ = ", ".join(f"CASE WHEN h{i}.total = h{i}.f THEN h{i}.v ELSE round_even((h{i}.cum - h{i}.f) * (255.0::DOUBLE / (h{i}.total - h{i}.f)), 0) END AS v{i}" for i in range(3))
JOINS = " ".join(f"JOIN h{i} ON h{i}.sample_id = px.sample_id AND h{i}.v = px.v{i}" for i in range(3))
on_pixels("equalize", f"{HIST} SELECT px.sample_id, y::BIGINT AS y, x::BIGINT AS x, {EQ} FROM px {JOINS}")
on_pixels("auto_contrast", PX + "SELECT sample_id, y::BIGINT AS y, x::BIGINT AS x, " + ", ".join(f"CASE WHEN min({v}) OVER s = max({v}) OVER s THEN {v} ELSE floor(({v} - min({v}) OVER s) * 255.0::DOUBLE / (max({v}) OVER s - min({v}) OVER s)) END AS {v}" for v in V) + " FROM px WINDOW s AS (PARTITION BY sample_id)", method="pil")
CDF = PX + "".join(
    f", g{i} AS (SELECT sample_id, v{i} AS v, count(*) AS n FROM px GROUP BY ALL), k{i} AS (SELECT *, sum(n) OVER (PARTITION BY sample_id ORDER BY v) AS cum, sum(n) OVER (PARTITION BY sample_id ORDER BY v DESC) AS above FROM g{i}),"
    f" l{i} AS (SELECT *, min(CASE WHEN cum > 1.28 THEN v END) OVER w AS lo, max(CASE WHEN above > 1.28 THEN v END) OVER w AS hi FROM k{i} WINDOW w AS (PARTITION BY sample_id)),"
    f" h{i} AS (SELECT *, max(CASE WHEN v = lo THEN cum END) OVER w AS c0, max(CASE WHEN v = hi THEN cum END) OVER w AS c1 FROM l{i} WINDOW w AS (PARTITION BY sample_id))"
    for i in range(3)
)
STRETCH = ", ".join(f"CASE WHEN h{i}.lo >= h{i}.hi THEN h{i}.v WHEN h{i}.v < h{i}.lo THEN 0 WHEN h{i}.v > h{i}.hi THEN 255 ELSE floor((h{i}.cum - h{i}.c0) * 255.0::DOUBLE / (h{i}.c1 - h{i}.c0)) END AS v{i}" for i in range(3))
on_pixels("auto_contrast", f"{CDF} SELECT px.sample_id, y::BIGINT AS y, x::BIGINT AS x, {STRETCH} FROM px {JOINS}", "auto_contrast_cdf", cutoff=2.0)
for n in ("histogram_matching", "pixel_distribution_adaptation", "fda"):
    on_pixels(n, None, reference_=True)
MOMENTS = ", s AS (SELECT sample_id, " + ", ".join(f"avg(v{i}) AS m{i}, stddev_pop(v{i}) AS s{i}, min(v{i}) AS l{i}, max(v{i}) AS h{i}" for i in range(3)) + " FROM px GROUP BY sample_id), n AS (SELECT max(sample_id) + 1 AS n FROM px), z AS (SELECT q.*, s.* EXCLUDE (sample_id), " + ", ".join(f"t.{c}{i} AS t{c}{i}" for i in range(3) for c in "mslh") + " FROM q CROSS JOIN n JOIN s ON s.sample_id = q.sample_id JOIN s t ON t.sample_id = (q.sample_id + 1) % n.n)\n"
ADAPTED = {"standard": "CASE WHEN s{i} = 0 THEN tm{i} ELSE (v{i} - m{i}) / s{i} * ts{i} + tm{i} END", "minmax": "CASE WHEN h{i} = l{i} THEN tl{i} ELSE (v{i} - l{i}) / (h{i} - l{i}) * (th{i} - tl{i}) + tl{i} END"}
for k, e in ADAPTED.items():
    mixed = tuple(clip(f"round(v{i} * (1 - p_b) + ({e.format(i=i)}) * p_b, 9)") for i in range(3))
    on_pixels("pixel_distribution_adaptation", pixel_sql("y", "x", mixed, cte=drawn("pixel_distribution_adaptation", transform_type=k) + MOMENTS, source="z"), f"pixel_distribution_adaptation_{k}", reference_=True, transform_type=k)

# holes
d = D(0, "0.coarse_dropout")
holes = [(f"cast(floor(7 * {d.unit(f'y{k}')}) as int)", f"cast(floor(6 * {d.unit(f'x{k}')}) as int)", f"{d.integer('n', 1, 2)} > {k}") for k in range(2)]
inside = " OR ".join(f"({e} AND y >= {y} AND y < {y} + 2 AND x >= {x} AND x < {x} + 3)" for y, x, e in holes)
on_pixels("coarse_dropout", pixel_sql("y", "x", same(f"CASE WHEN {inside} THEN 9 ELSE @ END")), hole_height_range=(2, 2), hole_width_range=(3, 3), fill=9.0)
on_pixels("grid_dropout", pixel_sql("y", "x", same("CASE WHEN y % 4 < 2 AND x % 4 < 2 THEN 0 ELSE @ END")), random_offset=False)
d = D(0, "0.xymasking")
on_pixels("xymasking", pixel_sql("y", "x", same(f"CASE WHEN (x >= cast(floor(7 * {d.unit('x0')}) as int) AND x < cast(floor(7 * {d.unit('x0')}) as int) + 2) OR (y >= cast(floor(7 * {d.unit('y0')}) as int) AND y < cast(floor(7 * {d.unit('y0')}) as int) + 2) THEN 0 ELSE @ END")), mask_x_length=(2, 2), mask_y_length=(2, 2))
d = D(0, "0.pixel_dropout")
on_pixels("pixel_dropout", pixel_sql("y", "x", same(f"CASE WHEN {d.unit('u', 'cast(floor(y) as int) * 65537 + cast(floor(x) as int)')} < 0.1 THEN 0 ELSE @ END")), dropout_prob=0.1)
d = D(0, "0.salt_and_pepper")
rank = f"row_number() OVER (PARTITION BY sample_id ORDER BY {d.unit('u', 'y * 65537 + x')}, y, x)"
on_pixels("salt_and_pepper", PX + f", r AS (SELECT *, {rank} AS n FROM px) SELECT sample_id, y::BIGINT AS y, x::BIGINT AS x, " + ", ".join(f"CASE WHEN n <= 3 THEN 255.0 WHEN n <= 6 THEN 0.0 ELSE {v} END AS {v}" for v in V) + " FROM r", amount=(0.1, 0.1), salt_vs_pepper=(0.5, 0.5))
RECT = "CASE WHEN {e} AND x >= p_x0 AND x < p_{x1} AND y >= p_y0 AND y < p_{y1} THEN 0 ELSE @ END"
on_pixels("time_masking", pixel_sql("y", "x", same("CASE WHEN x >= p_x0 AND x < p_xx0 THEN 0 ELSE @ END"), cte=drawn("time_masking", time_mask_param=3), source="q"), time_mask_param=3)
on_pixels("frequency_masking", pixel_sql("y", "x", same("CASE WHEN y >= p_y0 AND y < p_yy0 THEN 0 ELSE @ END"), cte=drawn("frequency_masking", freq_mask_param=3), source="q"), freq_mask_param=3)
on_pixels("erasing", pixel_sql("y", "x", same(RECT.format(e="p_ok", x1="x1", y1="y1")), cte=drawn("erasing"), source="q"))
on_pixels("constrained_coarse_dropout", None, columns_={"targets": "array(named_struct('x_min', 0.1e0, 'y_min', 0.1e0, 'x_max', 0.9e0, 'y_max', 0.9e0))"}, hole_height_range=(0.3, 0.5), hole_width_range=(0.3, 0.5))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("lambda", pixel_sql("y", "x", same("@ / 2.0")))
def lambda_(spark, sf_dir):
    half = OPERATORS["lambda"](image=lambda df: df.withColumns({v: F.col(v) / 2 for v in V}))
    return shown(half.run(Frame(src.embedding_pixels(spark, sf_dir))).pixels)


@query("mask_dropout")
def mask_dropout(spark, sf_dir):
    masks = src.embedding_masks(spark, sf_dir)
    op = OPERATORS["mask_dropout"](objects=dropout.objects(masks), p=1.0)
    return shown(op.run(Frame(src.embedding_pixels(spark, sf_dir), masks=masks)).pixels)


@query("overlay_elements", PX + ", top AS (SELECT sample_id, y + 2 AS y, x + 3 AS x, 255 - v0 AS o FROM px WHERE y < 3 AND x < 3) SELECT px.sample_id, px.y::BIGINT AS y, px.x::BIGINT AS x, coalesce(o, v0) AS v0, coalesce(o, v1) AS v1, coalesce(o, v2) AS v2 FROM px LEFT JOIN top ON px.sample_id = top.sample_id AND px.y = top.y AND px.x = top.x")
def overlay_elements(spark, sf_dir):
    px = src.embedding_pixels(spark, sf_dir)
    top = px.where("y < 3 and x < 3").selectExpr("sample_id", "0 as ord", "3 as oh", "3 as ow", "y", "x", "255 - v0 as v0", "255 - v0 as v1", "255 - v0 as v2", "3 as bx", "2 as by")
    return shown(OPERATORS["overlay_elements"](overlays=top, p=1.0).run(Frame(px)).pixels)


@query("mosaic")
def mosaic(spark, sf_dir):
    px = src.embedding_pixels(spark, sf_dir)
    items = px.withColumns({v: 255 - F.col(v) for v in V}).withColumn("item_ix", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return shown(OPERATORS["mosaic"](items=Frame(items), p=1.0).run(Frame(px)).pixels)


# samples as rows
def on_rows(name: str, query: str | None = None, **args) -> None:
    """An operator over samples as rows, against the SQL of the same operator over pixels."""
    op = OPERATORS[name](**({"p": 1.0} | args))
    QUERIES[f"rows_{query or name}"] = lambda spark, sf_dir: shown(packed.unpacked(packed.apply(op, src.embedding_images(spark, sf_dir, 8)), 3))
    ORACLE_SQL[f"rows_{query or name}"] = ORACLE_SQL[query or name]


for n in ("invert_img", "solarize", "posterize", "to_gray", "rgbshift", "channel_dropout", "horizontal_flip", "vertical_flip", "transpose", "d4", "random_rotate90", "center_crop", "random_crop", "equalize", "rotate"):
    on_rows(n)
on_rows("random_brightness_contrast", brightness_limit=(0.1, 0.1), contrast_limit=(0.2, 0.2))
on_rows("random_gamma", gamma_limit=(120, 120))
on_rows("pad", padding=(1, 1, 2, 2), fill=7.0)
on_rows("blur", blur_limit=(3, 3))
on_rows("resize", height=4, width=4)
for k in ("area", "cubic", "lanczos"):
    for way, size in (("down", (5, 3)), ("up", (13, 11))):
        on_rows("resize", f"resize_{k}_{way}", height=size[0], width=size[1], interpolation=k)
on_rows("auto_contrast", method="pil")
on_rows("coarse_dropout", hole_height_range=(2, 2), hole_width_range=(3, 3), fill=9.0)


@query("rows_compose", None)
def rows_compose(spark, sf_dir):
    images = src.embedding_images(spark, sf_dir, 8)
    return shown(packed.unpacked(packed.apply(compose.Compose((geometry.HorizontalFlip(p=0.5), geometry.VerticalFlip(p=0.5))), images), 3))


# volumes
def on_volumes(name: str, sql: str | None, **args) -> None:
    def run(spark, sf_dir):
        out = OPERATORS[name](**({"p": 1.0} | args)).run(Frame(src.embedding_volumes(spark, sf_dir), 1))
        return shown(out.pixels, 1, ("sample_id", "z", "y", "x"))

    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


on_volumes("center_crop3d", VOL + "SELECT sample_id, (z - 1)::BIGINT AS z, (y - 1)::BIGINT AS y, (x - 1)::BIGINT AS x, v0 FROM vx WHERE z IN (1, 2) AND y IN (1, 2) AND x IN (1, 2)")


def volume_sql(name: str, z: str, y: str, x: str, where: str = "true", v: str = "v0", more: str = "", source: str = "q", **args) -> str:
    return drawn(name, VOL, "vx", **args) + more + f"SELECT sample_id, ({z})::BIGINT AS z, ({y})::BIGINT AS y, ({x})::BIGINT AS x, round(({v})::DOUBLE, 5) AS v0 FROM {source} WHERE {where}"


START = {a: f"floor(3 * p_u{a})" for a in "zyx"}
on_volumes("random_crop3d", volume_sql("random_crop3d", *[f"{a} - {START[a]}" for a in "zyx"], " AND ".join(f"{a} >= {START[a]} AND {a} < {START[a]} + 2" for a in "zyx")))
BLANK = ", c AS (SELECT DISTINCT sample_id FROM q), o AS (SELECT sample_id, i // 36 AS z, i // 6 % 6 AS y, i % 6 AS x FROM (SELECT sample_id, unnest(range(216)) AS i FROM c)), z AS (SELECT o.sample_id, o.z, o.y, o.x, coalesce(vx.v0, 0) AS v0 FROM o LEFT JOIN vx ON vx.sample_id = o.sample_id AND vx.z = o.z - 1 AND vx.y = o.y - 1 AND vx.x = o.x - 1)\n"
for n in ("pad3d", "pad_if_needed3d"):
    on_volumes(n, volume_sql(n, "z", "y", "x", more=BLANK, source="z"))
on_volumes("coarse_dropout3d", volume_sql("coarse_dropout3d", "z", "y", "x", v="CASE WHEN p_n > 0 AND " + " AND ".join(f"{a} >= p_{a}0 AND {a} < p_{a}{a}0" for a in "zyx") + " THEN 0 ELSE v0 END"))
CUBE = [(p, m) for p in ("zyx", "zxy", "yzx", "yxz", "xzy", "xyz") for m in range(8)]
TO = [f"CASE p_k {' '.join(f'WHEN {j} THEN ' + (f'3 - {p[a]}' if m >> (2 - a) & 1 else p[a]) for j, (p, m) in enumerate(CUBE))} END" for a in range(3)]
on_volumes("cubic_symmetry", volume_sql("cubic_symmetry", *TO))
for n in [o for o in OPERATORS if OPERATORS[o].__module__.endswith(".volume") and o not in QUERIES]:
    on_volumes(n, None)


@query("to_tensor_v2", PX + "SELECT sample_id, 3 AS c, list(v ORDER BY ch, y, x) AS data FROM (SELECT sample_id, y, x, unnest([0, 1, 2]) AS ch, unnest([v0, v1, v2]) AS v FROM px) GROUP BY sample_id")
def to_tensor_v2(spark, sf_dir):
    return src.to_tensor(Frame(src.embedding_pixels(spark, sf_dir))).select("sample_id", "c", "data")


@query("to_tensor_3d", VOL + "SELECT sample_id, 1 AS c, list(v0 ORDER BY z, y, x) AS data FROM vx GROUP BY sample_id")
def to_tensor_3d(spark, sf_dir):
    return src.volume_tensor(src.embedding_volumes(spark, sf_dir)).select("sample_id", "c", "data")


# boxes and keypoints
CX = {c: f"greatest(0, least(1, {c}))" for c in ann.BOX}
CW, CH = f"({CX['x_max']} - {CX['x_min']}) * 90", f"({CX['y_max']} - {CX['y_min']}) * 60"
KEEP = f"{CW} * {CH} >= 20 AND {CW} * {CH} >= 0.5 * ((x_max - x_min) * 90 * (y_max - y_min) * 60) AND (x_max - x_min) * 90 * (y_max - y_min) * 60 >= 1e-7"


def on_boxes(name: str, f, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: boxes_shown(f(src.lineitem_boxes(spark, sf_dir)))
    ORACLE_SQL[name] = sql


on_boxes("box_horizontal_flip", lambda b: OPERATORS["horizontal_flip"](p=1.0).on_boxes(b), box_sql("1 - x_max", "y_min", "1 - x_min", "y_max"))
on_boxes("box_vertical_flip", lambda b: OPERATORS["vertical_flip"](p=1.0).on_boxes(b), box_sql("x_min", "1 - y_max", "x_max", "1 - y_min"))
on_boxes("box_transpose", lambda b: OPERATORS["transpose"](p=1.0).on_boxes(b), box_sql("y_min", "x_min", "y_max", "x_max"))
on_boxes("box_clip", ann.boxes_clipped, box_sql(*CX.values()))
on_boxes("box_filter", lambda b: ann.BoxParams(min_area=20, min_visibility=0.5).filtered(b), box_sql(*CX.values(), KEEP))
on_boxes("box_to_coco", lambda b: ann.boxes_from_internal(b, "coco"), box_sql("x_min * 90", "y_min * 60", "(x_max - x_min) * 90", "(y_max - y_min) * 60"))
on_boxes("box_to_pascal_voc", lambda b: ann.boxes_from_internal(b, "pascal_voc"), box_sql("x_min * 90", "y_min * 60", "x_max * 90", "y_max * 60"))
on_boxes("box_to_yolo", lambda b: ann.boxes_from_internal(b, "yolo"), box_sql("(x_min + x_max) / 2", "(y_min + y_max) / 2", "x_max - x_min", "y_max - y_min"))
on_boxes("box_round_trip_coco", lambda b: ann.boxes_to_internal(ann.boxes_from_internal(b, "coco"), "coco"), box_sql(*ann.BOX))
on_boxes("box_crop", lambda b: OPERATORS["crop"](x_min=10, y_min=5, x_max=70, y_max=45).on_boxes(b), box_sql("(x_min * 90 - 10) / 60", "(y_min * 60 - 5) / 40", "(x_max * 90 - 10) / 60", "(y_max * 60 - 5) / 40"))
on_boxes("box_pad", lambda b: OPERATORS["pad"](padding=(5, 5, 5, 5)).on_boxes(b), box_sql("(x_min * 90 + 5) / 100", "(y_min * 60 + 5) / 70", "(x_max * 90 + 5) / 100", "(y_max * 60 + 5) / 70"))
on_boxes("box_rotate", lambda b: OPERATORS["rotate"](limit=(90, 90), p=1.0).run(Frame(None, 0, boxes=b)).boxes, box_sql("least(45 - (y_min * 60 - 30), 45 - (y_max * 60 - 30)) / 90", "least(30 + (x_min * 90 - 45), 30 + (x_max * 90 - 45)) / 60", "greatest(45 - (y_min * 60 - 30), 45 - (y_max * 60 - 30)) / 90", "greatest(30 + (x_min * 90 - 45), 30 + (x_max * 90 - 45)) / 60"))


@query("box_union", BX + "SELECT sample_id, round(min(x_min), 6) AS x_min, round(min(y_min), 6) AS y_min, round(max(x_max), 6) AS x_max, round(max(y_max), 6) AS y_max FROM b GROUP BY sample_id")
def box_union(spark, sf_dir):
    u = ann.union_of_boxes(src.lineitem_boxes(spark, sf_dir))
    return u.select("sample_id", *[F.round(c, 6).alias(c) for c in ann.BOX])


@query("box_labels_encoded", BX + "SELECT sample_id, box_ix, label, dense_rank() OVER (ORDER BY label) - 1 AS label_id FROM b")
def box_labels_encoded(spark, sf_dir):
    return ann.labels_encoded(src.lineitem_boxes(spark, sf_dir)).select("sample_id", F.col("box_ix").cast("long").alias("box_ix"), "label", F.col("label_id").cast("long").alias("label_id"))


@query("box_mask_round_trip", BX + "SELECT sample_id, box_ix, floor(x_min * 90)::BIGINT AS x_min, floor(y_min * 60)::BIGINT AS y_min, floor(x_max * 90)::BIGINT AS x_max, floor(y_max * 60)::BIGINT AS y_max FROM b WHERE floor(x_max * 90) > floor(x_min * 90) AND floor(y_max * 60) > floor(y_min * 60)")
def box_mask_round_trip(spark, sf_dir):
    out = ann.masks_to_boxes(ann.boxes_to_masks(src.lineitem_boxes(spark, sf_dir)))
    return out.select("sample_id", *[F.col(c).cast("long").alias(c) for c in ("box_ix", *ann.BOX)])


@query("box_coarse_dropout")
def box_coarse_dropout(spark, sf_dir):
    b = ann.BoxParams(min_area=1).filtered(src.lineitem_boxes(spark, sf_dir))
    op = OPERATORS["coarse_dropout"](p=1.0, hole_height_range=(0.2, 0.4), hole_width_range=(0.2, 0.4))
    return boxes_shown(op.run(Frame(None, 0, boxes=b)).boxes)


TAU = "6.283185307179586e0"


def on_keypoints(name: str, f, x: str, y: str, a: str, s: str = "scale", where: str = "true") -> None:
    QUERIES[name] = lambda spark, sf_dir: keypoints_shown(f(src.event_keypoints(spark, sf_dir)))
    ORACLE_SQL[name] = KP + f"SELECT sample_id, kp_ix, round(({x})::DOUBLE, 5) AS x, round(({y})::DOUBLE, 5) AS y, round(({a}) - floor(({a}) / {TAU}) * {TAU}, 5) AS angle, round(({s})::DOUBLE, 5) AS scale, label FROM k WHERE {where}"


on_keypoints("kp_horizontal_flip", lambda k: OPERATORS["horizontal_flip"](p=1.0).on_keypoints(k), "89 - x", "y", "3.141592653589793e0 - angle")
on_keypoints("kp_vertical_flip", lambda k: OPERATORS["vertical_flip"](p=1.0).on_keypoints(k), "x", "59 - y", "-angle")
on_keypoints("kp_transpose", lambda k: OPERATORS["transpose"](p=1.0).on_keypoints(k), "y", "x", "3.141592653589793e0 / 2 - angle")
on_keypoints("kp_filter", lambda k: ann.KeypointParams().filtered(k), "x", "y", "angle", "scale", "x < 90 AND y < 60")
on_keypoints("kp_resize", lambda k: OPERATORS["resize"](height=30, width=180).on_keypoints(k), "x * 2", "y / 2", "angle", "scale * 2")
on_keypoints("kp_crop", lambda k: OPERATORS["crop"](x_min=10, y_min=5, x_max=70, y_max=45).on_keypoints(k), "x - 10", "y - 5", "angle")


@query("kp_degrees_round_trip", KP + "SELECT sample_id, kp_ix, label, [x, y, round(event_id_ % 360, 4)] AS keypoint FROM (SELECT *, kp_ix::DOUBLE AS event_id_ FROM k)")
def kp_degrees_round_trip(spark, sf_dir):
    k = ann.keypoints_as(src.event_keypoints(spark, sf_dir), "xya")
    return k.withColumn("keypoint", F.expr("transform(keypoint, (c, i) -> case when i = 2 then round(c, 4) % 360e0 else c end)"))


d = D(0, "0.coarse_dropout")
KX, KY = f"cast(floor(61 * {d.unit('x0')}) as int)", f"cast(floor(41 * {d.unit('y0')}) as int)"
on_keypoints("kp_coarse_dropout", lambda k: OPERATORS["coarse_dropout"](p=1.0, num_holes_range=(1, 1), hole_height_range=(20, 20), hole_width_range=(30, 30)).run(Frame(None, 0, keypoints=k)).keypoints, "x", "y", "angle", "scale", f"NOT (x >= {KX} AND x < {KX} + 30 AND y >= {KY} AND y < {KY} + 20)")

# plans
FLIPS = (geometry.HorizontalFlip(p=0.5), geometry.VerticalFlip(p=0.5))


def on_plan(name: str, plan, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: shown(plan.run(Frame(src.embedding_pixels(spark, sf_dir))).pixels)
    if sql:
        ORACLE_SQL[name] = sql


def gate(path: str, op: str, p: float = 0.5) -> str:
    return f"{D(0, f'{path}.{op}').unit('gate')} < {p}"


H, VF = gate("0.0", "horizontal_flip"), gate("0.1", "vertical_flip")
on_plan("compose", compose.Compose(FLIPS), pixel_sql(f"CASE WHEN {VF} THEN 7 - y ELSE y END", f"CASE WHEN {H} THEN 7 - x ELSE x END", V))
ORACLE_SQL["rows_compose"] = ORACLE_SQL["compose"]
S = gate("0", "Sequential")
on_plan("compose_sequential", compose.Sequential(FLIPS), pixel_sql(f"CASE WHEN {S} AND {VF} THEN 7 - y ELSE y END", f"CASE WHEN {S} AND {H} THEN 7 - x ELSE x END", V))
C = f"{D(0, '0.OneOf').unit('choice')} < 0.5"
on_plan("compose_one_of", compose.OneOf(FLIPS, p=1.0), pixel_sql(f"CASE WHEN {C} THEN y ELSE 7 - y END", f"CASE WHEN {C} THEN 7 - x ELSE x END", V))
C2 = f"{D(0, '0.OneOrOther').unit('choice')} < 0.5"
on_plan("compose_one_or_other", compose.OneOrOther(FLIPS), pixel_sql(f"CASE WHEN {C2} THEN y ELSE 7 - y END", f"CASE WHEN {C2} THEN 7 - x ELSE x END", V))
SURE = (geometry.HorizontalFlip(p=1.0), geometry.VerticalFlip(p=1.0))
u0, u1 = (D(0, "0.SomeOf").unit(f"rank{i}") for i in range(2))
on_plan("compose_some_of", compose.SomeOf(SURE, n=1), pixel_sql(f"CASE WHEN {u0} <= {u1} THEN y ELSE 7 - y END", f"CASE WHEN {u0} <= {u1} THEN 7 - x ELSE x END", V))
on_plan("compose_random_order", compose.RandomOrder(SURE, n=2), pixel_sql("7 - y", "7 - x", V))
TURNS = (OPERATORS["horizontal_flip"](p=1.0), OPERATORS["transpose"](p=1.0))
u0, u1 = (D(0, "0.RandomOrder").unit(f"rank{i}") for i in range(2))
on_plan("compose_random_order_turns", compose.RandomOrder(TURNS, n=2), pixel_sql(f"CASE WHEN {u0} <= {u1} THEN 7 - x ELSE x END", f"CASE WHEN {u0} <= {u1} THEN y ELSE 7 - y END", V))
on_plan("compose_selective_channel", compose.SelectiveChannelTransform((OPERATORS["invert_img"](p=1.0),), channels=(0, 2)), pixel_sql("y", "x", ("255 - v0", "v1", "255 - v2")))


def named_frame(spark: SparkSession, sf_dir: str) -> Frame:
    """Images, a mask, a second image and clips of two frames, all of the same samples."""
    px = src.embedding_pixels(spark, sf_dir)
    second = px.withColumns({v: 255 - F.col(v) for v in V})
    clip_ = px.withColumn("frame_ix", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("v0", F.expr("case when frame_ix = 1 then v2 else v0 end"))
    return Frame(px, masks=px.drop("v1", "v2").withColumn("v0", F.expr("floor(v0 / 64)")), named={"second": Named("pixels", second), "clip": Named("pixels", clip_, ("frame_ix",))})


NAMED = compose.Compose((OPERATORS["horizontal_flip"](p=0.5), OPERATORS["random_crop"](5, 4), OPERATORS["solarize"](p=0.5)), seed=2, additional_targets=(("second", "pixels"), ("clip", "pixels")), strict=True)
(_, nf, *_), (_, nc, *_), (_, ns, *_) = NAMED.leaves(2)
NAMED_PARTS = " UNION ALL ".join(f"SELECT '{n}' AS relation, {k} AS frame_ix, sample_id, h, w, y, x, {v} AS v0 FROM px" for n, k, v in (("pixels", 0, "v0"), ("masks", 0, "floor(v0 / 64)"), ("second", 0, "255 - v0"), ("clip", 0, "v0"), ("clip", 1, "v2")))
NAMED_SQL = f"""{PX}, n AS ({NAMED_PARTS}),
f AS (SELECT * REPLACE (CASE WHEN {nf.gate(Draws(2, '0.0.horizontal_flip'), False)} THEN 7 - x ELSE x END AS x) FROM n),
c AS (SELECT *, cast(floor(4 * {D(2, '0.1.random_crop').unit('v')}) as int) AS y0, cast(floor(5 * {D(2, '0.1.random_crop').unit('u')}) as int) AS x0, relation <> 'masks' AND {ns.gate(Draws(2, '0.2.solarize'), False)} AS s FROM f)
SELECT relation, frame_ix::BIGINT AS frame_ix, sample_id, (y - y0)::BIGINT AS y, (x - x0)::BIGINT AS x, (CASE WHEN s AND v0 >= 127.5 THEN 255 - v0 ELSE v0 END)::DOUBLE AS v0
FROM c WHERE y >= y0 AND y < y0 + 5 AND x >= x0 AND x < x0 + 4"""


@query("compose_named_relations", NAMED_SQL)
def compose_named_relations(spark, sf_dir):
    """A plan over two images, a mask and clips: one draw for all relations of a sample."""
    out, parts = NAMED(named_frame(spark, sf_dir)), []
    for name, df in out.relations().items():
        ix = F.col("frame_ix") if "frame_ix" in df.columns else F.lit(0)
        parts.append(df.select(F.lit(name).alias("relation"), ix.cast("long").alias("frame_ix"), "sample_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("v0").cast("double").alias("v0")))
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole


SOME = compose.SelectiveChannelTransform((OPERATORS["invert_img"](p=1.0), OPERATORS["horizontal_flip"](p=0.5)), channels=(0, 2))
half = D(0, "0.1.horizontal_flip").unit("gate")
FLIPPED = f"{PX} SELECT px.sample_id, px.y::BIGINT AS y, px.x::BIGINT AS x, 255 - o.v0 AS v0, px.v1, (255 - o.v2)::DOUBLE AS v2 FROM (SELECT *, CASE WHEN {half} < 0.5 THEN 7 - x ELSE x END AS ox FROM px) AS px JOIN px AS o ON o.sample_id = px.sample_id AND o.y = px.y AND o.x = px.ox"
on_plan("compose_selective_channel_flip", SOME, FLIPPED)


@query("rows_compose_selective_channel", FLIPPED)
def rows_compose_selective_channel(spark, sf_dir):
    return shown(packed.unpacked(packed.apply(SOME, src.embedding_images(spark, sf_dir, 8)), 3))


@query("compose_spec_round_trip", ORACLE_SQL["compose_one_of"])
def compose_spec_round_trip(spark, sf_dir):
    plan = compose.plan_from_spec(compose.OneOf(FLIPS, p=1.0).spec())
    return shown(plan.run(Frame(src.embedding_pixels(spark, sf_dir))).pixels)


@query("compose_replay", ORACLE_SQL["compose"])
def compose_replay(spark, sf_dir):
    px = src.embedding_pixels(spark, sf_dir)
    plan = compose.ReplayCompose(FLIPS)
    return shown(plan.replay(Frame(px), plan.recorded(px.select("sample_id", "h", "w").distinct())).pixels)


U4 = {k: D(0, "0.0.random_crop").unit(k) for k in "uv"}


@query("compose_recorded", f"SELECT vec_id AS sample_id, true AS applied, {U4['u']} AS p_u, {U4['v']} AS p_v FROM (SELECT vec_id, vec_id AS sample_id FROM embeddings)")
def compose_recorded(spark, sf_dir):
    px = src.embedding_pixels(spark, sf_dir)
    found = compose.ReplayCompose((geometry.RandomCrop(4, 4),)).recorded(px.select("sample_id", "h", "w").distinct())
    return found.rows.selectExpr("sample_id", "step0.applied", "step0.u as p_u", "step0.v as p_v")


RESIZED = compose.ReplayCompose((geometry.RandomCrop(5, 4, p=0.7), geometry.Pad(padding=(1, 0, 0, 0), p=0.5), OPERATORS["coarse_dropout"](p=1.0, num_holes_range=(1, 1), fill=9.0, hole_height_range=(0.3, 0.6), hole_width_range=(0.3, 0.6))), seed=3)


def resized_sql() -> str:
    """The plan's three operators in turn: window, one column before, a hole that is a share of the size by then."""
    (_, crop, *_), (_, pad, *_), (_, drop, *_) = RESIZED.leaves(3)
    at = [Draws(3, f"0.{i}.{op.name}") for i, op in enumerate((crop, pad, drop))]
    first = drawn_from("px", crop.draws(at[0]), crop.gate(at[0], False))
    second = "SELECT sample_id, 5 AS h, 4 AS w, y - cast(floor((h - 5 + 1) * p_v) as int) AS y, x - cast(floor((w - 4 + 1) * p_u) as int) AS x, v0, v1, v2 FROM a WHERE g AND y >= cast(floor((h - 5 + 1) * p_v) as int) AND y < cast(floor((h - 5 + 1) * p_v) as int) + 5 AND x >= cast(floor((w - 4 + 1) * p_u) as int) AND x < cast(floor((w - 4 + 1) * p_u) as int) + 4 UNION ALL SELECT sample_id, h, w, y, x, v0, v1, v2 FROM a WHERE NOT g"
    third = f"SELECT sample_id, h, w + g::INT AS w, y, x + g::INT AS x, v0, v1, v2 FROM ({drawn_from('b', {}, pad.gate(at[1], False))}) UNION ALL SELECT sample_id, h, w + 1, y, 0, 0, 0, 0 FROM ({drawn_from('b', {}, pad.gate(at[1], False))}) WHERE g AND x = 0"
    last = drawn_from("c", drop.draws(at[2]), "true")
    inside = "y >= p_y0 AND y < p_yy0 AND x >= p_x0 AND x < p_xx0"
    return f"{PX}, a AS ({first}), b AS ({second}), c AS ({third}), d AS ({last})\nSELECT sample_id, y::BIGINT AS y, x::BIGINT AS x, h::BIGINT AS h, w::BIGINT AS w, " + ", ".join(f"CASE WHEN {inside} THEN 9.0 ELSE {v} END AS {v}" for v in V) + " FROM d"


def drawn_from(source: str, draws: dict[str, str], gate: str) -> str:
    return f"SELECT *{''.join(f', {e} AS p_{k}' for k, e in draws.items())}, ({gate}) AS g FROM {source}"


@query("compose_replay_resized", resized_sql())
def compose_replay_resized(spark, sf_dir):
    """Sizes change before an operator whose draws are shares of the side: followed while recording."""
    px = src.embedding_pixels(spark, sf_dir)
    out = RESIZED.replay(Frame(px), RESIZED.recorded(px.select("sample_id", "h", "w").distinct())).pixels
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("sample_id", "y", "x", "h", "w")], *V)


@query("compose_params", resized_sql().partition("SELECT sample_id, y::BIGINT")[0] + "SELECT DISTINCT sample_id, 'coarse_dropout' AS operator, true AS applied, h::BIGINT AS h, w::BIGINT AS w, p_y0::BIGINT AS y0, p_xx0::BIGINT AS xx0 FROM d")
def compose_params(spark, sf_dir):
    """The parameters that a run applied, as a relation, and the sizes that samples end with."""
    px = src.embedding_pixels(spark, sf_dir)
    found = RESIZED.recorded(px.select("sample_id", "h", "w").distinct())
    params = found.params().where("path = '0.2'").select("sample_id", "operator", "applied", F.from_json("params", "y0 long, xx0 long").alias("j"))
    sizes = found.rows.select("sample_id", F.col("h").cast("long").alias("h"), F.col("w").cast("long").alias("w"))
    return params.join(sizes, "sample_id").select("sample_id", "operator", "applied", "h", "w", "j.y0", "j.xx0")


# texts and spectrograms
def documents_as_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id as sample_id", "0 as box_ix", "text")


for what in ("deletion", "swap", "insertion"):
    QUERIES[f"text_{what}"] = lambda spark, sf_dir, what=what: text.TextImage(augmentations=(what,), p=1.0).texts(documents_as_texts(spark, sf_dir)).select("sample_id", "new_text")
QUERIES["text_image"] = lambda spark, sf_dir: text.TextImage(augmentations=(None, "swap", "deletion", "insertion"), fraction_range=(0.5, 1.0), p=0.5).texts(documents_as_texts(spark, sf_dir)).select("sample_id", "box_ix", "change", "new_text")


@query("spectrogram_time_reverse", "WITH t AS (SELECT event_type, hour(ts) AS x, count(*)::DOUBLE AS v0 FROM events GROUP BY ALL) SELECT 0::BIGINT AS sample_id, (dense_rank() OVER (ORDER BY event_type) - 1)::BIGINT AS y, (23 - x)::BIGINT AS x, v0 FROM t")
def spectrogram_time_reverse(spark, sf_dir):
    return shown(OPERATORS["time_reverse"](p=1.0).run(Frame(src.spectrograms(spark, sf_dir), 1)).pixels, 1)


@query("compact_round_trip", pixel_sql("y", "x", V))
def compact_round_trip(spark, sf_dir):
    return shown(src.from_compact(src.to_compact(Frame(src.embedding_pixels(spark, sf_dir))), 3))


@query("equalize_then_flip", f"{HIST} SELECT px.sample_id, y::BIGINT AS y, (7 - x)::BIGINT AS x, {EQ} FROM px {JOINS}")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantise, equalise by histogram, mirror."""
    plan = compose.Compose((OPERATORS["equalize"](p=1.0), geometry.HorizontalFlip(p=1.0)))
    return shown(plan(Frame(src.embedding_pixels(spark, sf_dir))).pixels)


# colour spaces
LINEAR = {c: f"(CASE WHEN {v} / 255 <= 0.04045 THEN {v} / 255 / 12.92 ELSE pow(({v} / 255 + 0.055) / 1.055, 2.4) END)" for c, v in zip("rgb", V)}
XYZ_SQL = {n: f"(({a}::DOUBLE * {LINEAR['r']} + {b}::DOUBLE * {LINEAR['g']} + {c}::DOUBLE * {LINEAR['b']}) / {w}::DOUBLE)" for n, (a, b, c), w in zip("xyz", ((0.412453, 0.35758, 0.180423), (0.212671, 0.71516, 0.072169), (0.019334, 0.119193, 0.950227)), (0.950456, 1.0, 1.088754))}
CURVE = {n: f"(CASE WHEN {e} > 0.008856 THEN pow({e}, 1 / 3.0::DOUBLE) ELSE 7.787::DOUBLE * {e} + 16 / 116.0::DOUBLE END)" for n, e in XYZ_SQL.items()}
LUMA_SQL = "(0.299::DOUBLE * v0 + 0.587::DOUBLE * v1 + 0.114::DOUBLE * v2)"
SPACES_SQL = {
    "lab": (f"(116 * {CURVE['y']} - 16) * 2.55", f"500 * ({CURVE['x']} - {CURVE['y']}) + 128", f"200 * ({CURVE['y']} - {CURVE['z']}) + 128"),
    "ycrcb": (LUMA_SQL, f"(v0 - {LUMA_SQL}) * 0.713 + 127.5", f"(v2 - {LUMA_SQL}) * 0.564 + 127.5"),
}
for n, e in SPACES_SQL.items():
    QUERIES[f"colour_{n}"] = lambda spark, sf_dir, n=n: pointwise.into_space(src.embedding_pixels(spark, sf_dir), n, 255.0).select(*[F.col(k).cast("long").alias(k) for k in ("sample_id", "y", "x")], *[F.round(v, 7).alias(v) for v in V])
    ORACLE_SQL[f"colour_{n}"] = f"{PX} SELECT sample_id, y::BIGINT AS y, x::BIGINT AS x, {', '.join(f'round(({x})::DOUBLE, 7) AS v{i}' for i, x in enumerate(e))} FROM px"
for n in ("lab", "ycrcb", "hsv"):  # there and back: the same values
    QUERIES[f"colour_{n}_round_trip"] = lambda spark, sf_dir, n=n: shown(pointwise.out_of_space(pointwise.into_space(src.embedding_pixels(spark, sf_dir), n, 255.0), n, 255.0))
    ORACLE_SQL[f"colour_{n}_round_trip"] = pixel_sql("y", "x", V)
on_pixels("clahe", None, "clahe_luma", space="luma")
on_pixels("histogram_matching", None, "histogram_matching_lab", reference_=True, space="lab")

# warps with a frame of their own
on_pixels("rotate", taps_sql(drawn("rotate", crop_border=True), "p_fh", "p_fw", *[t.format(z=1, ty=0, tx=0).replace("oy", "(oy + p_fy)").replace("ox", "(ox + p_fx)") for t in TURN], "0"), "rotate_crop_border", crop_border=True)
FIT = {"rotate": (20, 70), "translate_px": (-2, 2), "fit_output": True}
on_pixels("affine", taps_sql(drawn("affine", **FIT), "p_fh", "p_fw", *[t.format(z=1, ty="p_ty", tx="p_tx").replace("oy", "(oy + p_fy)").replace("ox", "(ox + p_fx)") for t in TURN], "0"), "affine_fit_output", **FIT)
#: A turn by 30 degrees of 90 x 60: the rectangle inside is narrow against its turn.
COS30, SIN30 = 0.8660254037844387, 0.49999999999999994
RW, RH = (0.5 * 60 / SIN30, 0.5 * 60 / COS30) if 60 <= 2 * SIN30 * COS30 * 90 else ((90 * COS30 - 60 * SIN30) / (COS30**2 - SIN30**2), (60 * COS30 - 90 * SIN30) / (COS30**2 - SIN30**2))
FX, FY = int(45 - RW / 2), int(30 - RH / 2)
FW, FH = int(45 + RW / 2) - FX, int(30 + RH / 2) - FY
AX = [f"({COS30} * ({x} * 90 - 45) - {SIN30} * ({y} * 60 - 30) + 45)" for x in ("x_min", "x_max") for y in ("y_min", "y_max")]
AY = [f"({SIN30} * ({x} * 90 - 45) + {COS30} * ({y} * 60 - 30) + 30)" for x in ("x_min", "x_max") for y in ("y_min", "y_max")]
on_boxes("box_rotate_crop_border", lambda b: OPERATORS["rotate"](limit=(30, 30), crop_border=True, p=1.0).run(Frame(None, 0, boxes=b)).boxes, box_sql(f"(least({', '.join(AX)}) - {FX}) / {FW}", f"(least({', '.join(AY)}) - {FY}) / {FH}", f"(greatest({', '.join(AX)}) - {FX}) / {FW}", f"(greatest({', '.join(AY)}) - {FY}) / {FH}"))
on_keypoints("kp_rotate_crop_border", lambda k: OPERATORS["rotate"](limit=(30, 30), crop_border=True, p=1.0).run(Frame(None, 0, keypoints=k)).keypoints, f"{COS30} * (x - 44.5) - {SIN30} * (y - 29.5) + 44.5 - {FX}", f"{SIN30} * (x - 44.5) + {COS30} * (y - 29.5) + 29.5 - {FY}", "angle + 0.5235987755982988 - 6.283185307179586 * floor((angle + 0.5235987755982988) / 6.283185307179586)", "scale")


def kp_formats(fmt: str):
    """Keypoints as arrays in a format, through a flip, and as arrays again."""
    params = ann.KeypointParams(fmt, label_fields=("label",))
    names = ann.KEYPOINT_FORMATS[fmt]

    def run(spark, sf_dir):
        k = src.event_keypoints(spark, sf_dir).where("x < w and y < h")
        arrays = k.select("sample_id", "h", "w", "kp_ix", "label", F.array(*[F.col(c).cast("double") for c in names]).alias("keypoint"))
        out = params.shown(compose.Compose((OPERATORS["horizontal_flip"](p=1.0),), keypoints=params)(Frame(None, 0, keypoints=arrays)).keypoints)
        return out.select("sample_id", "kp_ix", "label", *[F.round(F.col("keypoint")[i], 5).alias(f"k{i}") for i in range(len(names))])

    return run


for fmt in ("xy", "yx", "xys"):
    QUERIES[f"kp_format_{fmt}"] = kp_formats(fmt)
    ORACLE_SQL[f"kp_format_{fmt}"] = f"{KP} SELECT sample_id, kp_ix, label, {', '.join(f'round(({dict(x="89 - x", y="y", scale="scale")[c]})::DOUBLE, 5) AS k{i}' for i, c in enumerate(ann.KEYPOINT_FORMATS[fmt]))} FROM k WHERE x < 90 AND y < 60"


def shuffled_boxes_sql() -> str:
    """Pieces of a box in the four cells of 90 x 60, moved; pieces that touch take the least number, three times."""
    r = [D(0, "0.random_grid_shuffle").unit(f"r{i}") for i in range(4)]
    rank = [" + ".join(f"(CASE WHEN {r[k]} < {r[j]} OR ({r[k]} = {r[j]} AND {k} < {j}) THEN 1 ELSE 0 END)" for k in range(4) if k != j) for j in range(4)]
    ranks = "t AS (SELECT sample_id, " + ", ".join(f"{e} AS k{j}" for j, e in enumerate(rank)) + " FROM (SELECT DISTINCT sample_id FROM b))"
    goes = "g AS (SELECT sample_id, c, CASE c WHEN k0 THEN 0 WHEN k1 THEN 1 WHEN k2 THEN 2 ELSE 3 END AS d FROM t, range(4) AS s(c))"
    clipped_ = "n AS (SELECT b.sample_id, box_ix, label, c, d, greatest(floor(x_min * 90), 45 * (c % 2)) AS x0, greatest(floor(y_min * 60), 30 * (c // 2)) AS y0, least(floor(x_max * 90), 45 * (c % 2) + 45) AS x1, least(floor(y_max * 60), 30 * (c // 2) + 30) AS y1 FROM b JOIN g USING (sample_id))"
    moved_ = "l0 AS (SELECT sample_id, box_ix, label, c, c AS l, x0 + 45 * (d % 2 - c % 2) AS x0, x1 + 45 * (d % 2 - c % 2) AS x1, y0 + 30 * (d // 2 - c // 2) AS y0, y1 + 30 * (d // 2 - c // 2) AS y1 FROM n WHERE x1 > x0 AND y1 > y0)"
    step = "l{} AS (SELECT a.sample_id, a.box_ix, a.label, a.c, min(o.l) AS l, a.x0, a.x1, a.y0, a.y1 FROM l{} AS a JOIN l{} AS o ON o.sample_id = a.sample_id AND o.box_ix = a.box_ix AND a.x0 <= o.x1 AND o.x0 <= a.x1 AND a.y0 <= o.y1 AND o.y0 <= a.y1 GROUP BY ALL)"
    return f"{BX}, {ranks}, {goes}, {clipped_}, {moved_}, {', '.join(step.format(i + 1, i, i) for i in range(3))} SELECT sample_id, box_ix, round(min(x0) / 90.0::DOUBLE, 6) AS x_min, round(min(y0) / 60.0::DOUBLE, 6) AS y_min, round(max(x1) / 90.0::DOUBLE, 6) AS x_max, round(max(y1) / 60.0::DOUBLE, 6) AS y_max, label FROM l3 GROUP BY sample_id, box_ix, label, l HAVING sum((x1 - x0) * (y1 - y0)) >= 12"


on_boxes("box_random_grid_shuffle", lambda b: OPERATORS["random_grid_shuffle"](p=1.0, min_area=12.0).run(Frame(None, 0, boxes=b)).boxes, shuffled_boxes_sql())
