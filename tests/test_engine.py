"""Operators against SQL on another engine, identities, plans, replay, specs and streams."""

import math
import os
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from rasterlane import catalogue
from rasterlane.functions.annotations import BoxParams, KeypointParams, boxes_from_internal, boxes_to_internal
from rasterlane.functions.sampling import Draws
from rasterlane.operators import OPERATORS, Frame, Named, packed
from rasterlane.operators.volume import SYMMETRIES
from rasterlane.plans import compose
from rasterlane.sources import samples as src

SF = "/root/testdata/sf0.001"
#: Every query that has SQL; those over samples as rows are compared with the pixel relation below.
CHECKED = [n for n in catalogue.ORACLE_SQL if not n.startswith("rows_")]


def shown(x):
    if hasattr(x, "tolist") and getattr(x, "shape", ()) != ():
        x = x.tolist()
    if isinstance(x, list):
        return tuple(shown(y) for y in x)
    if isinstance(x, (int, float)) or hasattr(x, "dtype"):
        return "nan" if math.isnan(x) else f"{float(x) + 0.0:.4f}"
    return str(x)


def rows(pdf, cols):
    return sorted(tuple(map(shown, r)) for r in pdf[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name[:-8]} as select * from '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, duck, name):
    found, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).fetchdf()
    cols = sorted(found.columns)
    assert cols == sorted(want.columns)
    assert rows(found, cols) == rows(want, cols)


@pytest.fixture(scope="module")
def pixels(spark):
    return src.embedding_pixels(spark, SF).where("sample_id < 4").cache()


def table(frame):
    return sorted(map(tuple, catalogue.shown(frame.pixels, frame.channels).collect()))


def test_identities(pixels):
    start = table(Frame(pixels))
    for name, times in (("horizontal_flip", 2), ("vertical_flip", 2), ("transpose", 2), ("invert_img", 2)):
        frame = Frame(pixels)
        for _ in range(times):
            frame = OPERATORS[name](p=1.0).run(frame)
        assert table(frame) == start, name
    assert len(SYMMETRIES) == len(set(SYMMETRIES)) == 48


def test_a_chain_of_row_operators_needs_no_shuffle(pixels):
    plan = compose.Compose((OPERATORS["horizontal_flip"](), OPERATORS["random_gamma"](), OPERATORS["random_crop"](4, 4), OPERATORS["coarse_dropout"]()))
    text = plan.run(Frame(pixels)).pixels._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text


def test_partitioning_and_order_do_not_matter(pixels):
    plan = compose.Compose((OPERATORS["random_crop"](4, 4), OPERATORS["gauss_noise"](p=1.0), OPERATORS["glass_blur"](p=1.0)))
    assert table(plan.run(Frame(pixels), 3)) == table(plan.run(Frame(pixels.repartition(7, "x")), 3))
    assert table(plan.run(Frame(pixels), 3)) != table(plan.run(Frame(pixels), 4))


def test_gates_open_as_often_as_they_should(spark):
    ids = spark.range(20_000).selectExpr("id as sample_id", "8 as h", "8 as w")
    for p in (0.1, 0.5, 0.9):
        share = OPERATORS["invert_img"](p=p).recorded(ids).agg(F.avg(F.col("applied").cast("int"))).first()[0]
        assert abs(share - p) < 0.02


#: What operators need beyond their defaults on 8 x 8 samples.
ARGUMENTS = {"pad": {"padding": (1, 2)}}


def everything(frame):
    """All rows of all relations, as text."""
    return {n: sorted(str(sorted((k, shown(v) if not isinstance(v, list) else str(v)) for k, v in r.asDict().items())) for r in df.collect()) for n, df in frame.relations().items()}


#: One or more of each way to look after a closed gate.
GATED = ["solarize", "gauss_noise", "to_gray", "d4", "random_crop", "pad", "coarse_dropout", "grid_dropout", "pixel_dropout", "blur", "glass_blur", "random_rain", "affine", "random_scale", "equalize", "image_compression"]


@pytest.mark.parametrize("name", GATED)
def test_a_closed_gate_changes_nothing(spark, pixels, name):
    """Gated samples are as if they alone had gone through, the others as they came."""
    op = OPERATORS[name](**(ARGUMENTS.get(name, {}) | {"p": 0.5}))
    boxes = spark.createDataFrame([(i, 8, 8, k, 0.1 + k / 10, 0.2, 0.7 + k / 5, 0.9, "a") for i in range(4) for k in range(2)], "sample_id long, h int, w int, box_ix int, x_min double, y_min double, x_max double, y_max double, label string")
    keypoints = spark.createDataFrame([(i, 8, 8, k, 1.0 + 2 * k, 6.0 - k, 0.5, 1.0, "a") for i in range(4) for k in range(3)], "sample_id long, h int, w int, kp_ix int, x double, y double, angle double, scale double, label string")
    frame = Frame(pixels, boxes=boxes, keypoints=keypoints, masks=pixels.drop("v1", "v2"))
    gate = op.gate(Draws(1, f"0.{op.name}"), False)
    some, others = frame.each(lambda df, n: df.where(gate)), frame.each(lambda df, n: df.where(f"not ({gate})"))
    want, rest = everything(op.run(some, 1, forced=True)), everything(others)
    found = everything(op.run(frame, 1))
    assert all(found[n] == sorted(want[n] + rest[n]) for n in found), name


def test_plans_read_their_input_once_and_keep_rows_without_an_id(spark, tmp_path):
    src.embedding_pixels(spark, SF).where("sample_id < 6").write.parquet(str(tmp_path / "px"))
    px = spark.read.parquet(str(tmp_path / "px"))
    px = px.withColumn("sample_id", F.expr("nullif(sample_id, 3)"))
    names = ("horizontal_flip", "random_gamma", "invert_img", "blur", "pad", "coarse_dropout", "center_crop", "affine", "transpose", "gauss_noise")
    ten = tuple(OPERATORS[n](**({"p": 0.5} | ({"padding": 2} if n == "pad" else {}))) for n in names)
    plans = [compose.Compose(ten), compose.SomeOf(ten[:4], n=3, replace_=True), compose.RandomOrder(ten[:3], n=3), compose.OneOf((compose.Sequential(ten[:3]), compose.OneOrOther(ten[3:5])), p=0.5)]
    for plan in plans:
        out = plan.run(Frame(px)).pixels
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1, plan
        before, after = px.where("sample_id is null"), out.where("sample_id is null")
        assert table(Frame(after)) == table(Frame(before)) and after.count() == 64


def test_random_order_follows_the_drawn_order(pixels):
    """Children that do not commute: which comes first shows."""
    flip, turn = OPERATORS["horizontal_flip"](p=1.0), OPERATORS["transpose"](p=1.0)
    plan = compose.RandomOrder((flip, turn), n=2)
    first = f"{plan.rank(Draws(5, '0.RandomOrder'), 0)} = 0"
    a = compose.Sequential((flip, turn), p=1.0).run(Frame(pixels.where(first)))
    b = compose.Sequential((turn, flip), p=1.0).run(Frame(pixels.where(f"not ({first})")))
    assert table(plan.run(Frame(pixels), 5)) == sorted(table(a) + table(b)) and table(a) and table(b)


def test_nested_plans_replay(spark, pixels):
    inner = compose.OneOf((compose.Sequential((OPERATORS["vertical_flip"](p=0.5), OPERATORS["random_gamma"](p=0.5)), p=1.0), OPERATORS["random_crop"](4, 4, p=1.0)), p=0.7)
    plan = compose.ReplayCompose((OPERATORS["horizontal_flip"](p=0.5), inner, compose.SomeOf((OPERATORS["invert_img"](p=0.6), OPERATORS["transpose"](p=0.5)), n=1)), seed=4)
    recorded = plan.recorded(pixels.select("sample_id", "h", "w").distinct())
    assert len(recorded.steps) == 6
    assert table(plan.replay(Frame(pixels), recorded)) == table(plan.run(Frame(pixels), 4))
    other = compose.ReplayCompose(plan.transforms, seed=99)
    assert table(other.replay(Frame(pixels), recorded)) == table(plan.run(Frame(pixels), 4))


def test_replay_follows_sizes_with_one_join_for_each_relation(spark, pixels):
    """A crop and a pad before draws that are shares of a side, noise of single pixels, boxes."""
    inner = compose.OneOf((OPERATORS["random_crop"](4, 4), OPERATORS["random_scale"](scale_limit=(0.4, 0.6), p=1.0)), p=0.8)
    plan = compose.ReplayCompose((inner, OPERATORS["coarse_dropout"](p=1.0, hole_height_range=(0.2, 0.7), fill="random"), OPERATORS["gauss_noise"](p=0.7), OPERATORS["pad"](padding=1, p=0.5)), seed=6)
    boxes = spark.createDataFrame([(i, 8, 8, k, 0.1 + k / 10, 0.2, 0.7 + k / 5, 0.9, "a") for i in range(4) for k in range(2)], "sample_id long, h int, w int, box_ix int, x_min double, y_min double, x_max double, y_max double, label string")
    frame = Frame(pixels, boxes=boxes)
    recorded = plan.recorded(spark.range(4).selectExpr("id as sample_id", "8 as h", "8 as w"))
    other = compose.ReplayCompose(plan.transforms, seed=1)
    ran = plan.run(frame, 6)
    assert everything(other.replay(frame, recorded)) == everything(ran)
    ends = {tuple(r) for r in ran.pixels.select("sample_id", "h", "w").distinct().collect()}
    assert {tuple(r) for r in recorded.rows.select("sample_id", "h", "w").collect()} == ends and len({e[1:] for e in ends}) > 1
    rigid = compose.ReplayCompose((OPERATORS["random_crop"](4, 4), OPERATORS["horizontal_flip"](), OPERATORS["coarse_dropout"]()))
    text = rigid.replay(Frame(pixels), rigid.recorded(pixels.select("sample_id", "h", "w"))).pixels._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join") == 1
    params = recorded.params().collect()
    assert len(params) == 4 * len(recorded.steps) and all((r["params"] is not None) == r["applied"] for r in params)
    assert {r["operator"] for r in params} == {"random_crop", "random_scale", "coarse_dropout", "gauss_noise", "pad"}


#: What an operator needs to be made, and columns that its draws name.
NEEDS = {"pad": {"padding": (1, 2)}, "crop": {"x_max": 6, "y_max": 6}, "pad3d": {}, "lambda": {}}
COLUMNS = {"ux0": 0.2, "uy0": 0.2, "ux1": 0.8, "uy1": 0.8, "ox0": 0.2, "oy0": 0.2, "ox1": 0.8, "oy1": 0.8, "bx0": 1.0, "by0": 1.0, "bx1": 6.0, "by1": 6.0, "mx": 3.0, "my": 4.0}
VARIANTS = [("to_gray", {"method": "pca"}), ("normalize", {"normalization": "image"}), ("random_brightness_contrast", {"brightness_by_max": False}), ("hestain", {"method": "macenko"}), ("hestain", {"method": "vahadane"}), ("equalize", {"by_channels": False})]


@pytest.mark.parametrize("p", [0.5, 1.0])
def test_no_operator_touches_or_loses_a_sample_without_an_id(spark, pixels, p):
    """All operators over images and volumes: its rows come out as they went in, beside samples that change."""
    px = pixels.withColumns({k: F.lit(v) for k, v in COLUMNS.items()} | {"targets": F.expr("array(named_struct('x_min', 0.1e0, 'y_min', 0.1e0, 'x_max', 0.9e0, 'y_max', 0.9e0))"), "sample_id": F.expr("nullif(sample_id, 3)")}).cache()
    vol = src.embedding_volumes(spark, SF).where("sample_id < 4").withColumn("sample_id", F.expr("nullif(sample_id, 3)")).cache()
    objects = px.selectExpr("sample_id", "y", "x", "1 as object").where("y < 3")
    tried = 0
    for name, args in [(n, NEEDS.get(n, {})) for n in OPERATORS] + VARIANTS:
        if name in ("text_image", "lambda", "overlay_elements", "mosaic", "to_tensor_v2", "to_tensor3_d"):
            continue
        given = dict(args) | {"p": p}
        fields_ = OPERATORS[name].__dataclass_fields__
        if "reference" in fields_:
            given["reference"] = pixels.withColumn("sample_id", F.expr("(sample_id + 1) % 3"))
        if "objects" in fields_:
            given["objects"] = objects
        solid = type(OPERATORS[name]()).__module__.endswith("volume")
        op = OPERATORS[name](**given)
        if p == 1 and not (op.statistic or (name, args) in VARIANTS):
            continue
        before = vol if solid else px
        out = op.run(Frame(before, 1 if solid else 3), 1)
        keys = [c for c in ("z", "y", "x", "h", "w", "v0") if c in before.columns]
        want = before.where("sample_id is null").select(*keys).collect()
        found = out.pixels.where("sample_id is null").select(*keys).collect()
        assert sorted(tuple(map(shown, r)) for r in found) == sorted(tuple(map(shown, r)) for r in want), name
        tried += 1
    assert tried > (60 if p < 1 else 5)


def test_some_channels_as_rows(spark):
    """Kernels see the chosen channels alone; sizes must stay; columns that draws name are found; no 3-D."""
    images = src.embedding_images(spark, SF, 8).where("sample_id < 12").withColumns({k: F.lit(v) for k, v in COLUMNS.items()}).cache()
    px = src.embedding_pixels(spark, SF).where("sample_id < 12").withColumns({k: F.lit(v) for k, v in COLUMNS.items()}).cache()
    for inner in (("invert_img",), ("horizontal_flip", "random_gamma"), ("equalize", "coarse_dropout", "blur")):
        plan = compose.Compose((compose.SelectiveChannelTransform(tuple(OPERATORS[n](p=0.7) for n in inner), channels=(2, 0), p=0.8), OPERATORS["vertical_flip"](p=0.5)))
        assert table(Frame(packed.unpacked(packed.apply(plan, images, 3), 3))) == table(plan.run(Frame(px), 3)), inner
    for plan in (compose.SelectiveChannelTransform((OPERATORS["random_crop"](4, 4),), channels=(0,)),):
        with pytest.raises(ValueError, match="changes sizes"):
            packed.apply(plan, images)
        with pytest.raises(ValueError, match="changes sizes"):
            plan.run(Frame(px))
    for name in ("bbox_safe_random_crop", "random_crop_near_bbox", "crop_non_empty_mask_if_exists", "at_least_one_bbox_random_crop"):
        op = OPERATORS[name](p=0.6)
        assert table(Frame(packed.unpacked(packed.apply(op, images, 2), 3))) == table(op.run(Frame(px), 2)), name
    target = F.expr("array(named_struct('x_min', 0.1e0, 'y_min', 0.1e0, 'x_max', 0.9e0, 'y_max', 0.9e0))")
    op = OPERATORS["constrained_coarse_dropout"](p=0.6, hole_height_range=(0.3, 0.5), hole_width_range=(0.3, 0.5))
    assert table(Frame(packed.unpacked(packed.apply(op, images.withColumn("targets", target), 2), 3))) == table(op.run(Frame(px.withColumn("targets", target)), 2))
    for name in ("coarse_dropout3d", "center_crop3d"):
        with pytest.raises(ValueError, match="no kernel"):
            packed.apply(OPERATORS[name](), images)
    odd = packed.apply(OPERATORS["random_gamma"](p=1.0), images.withColumn("sample_id", F.expr("nullif(sample_id, 3)"))).where("sample_id is null").first()
    assert odd["data"] == images.where("sample_id = 3").first()["data"]


def test_random_fills_follow_seed_and_place(spark, pixels):
    op = OPERATORS["coarse_dropout"](p=1.0, fill="random", hole_height_range=(4, 4), hole_width_range=(4, 4))
    a, b = (table(op.run(Frame(pixels), 1, path)) for path in ("0", "1"))
    assert a == table(op.run(Frame(pixels), 1, "0")) and a != b and a != table(op.run(Frame(pixels), 2, "0"))


def test_boxes_under_holes_end_where_they_are_last_seen(spark):
    """Against every pixel: holes in plain expressions, more of them in arrays, boxes over the edge, inverted and unknown."""
    ends = [(0.0, 0.0, 1.0, 1.0), (0.1, 0.2, 0.5, 0.4), (0.45, 0.3, 0.8, 0.95), (-0.2, 0.5, 1.3, 0.7), (0.6, 0.1, 0.4, 0.9), (0.5, 0.5, 0.5, 0.6), (0.2, None, 0.9, 0.9)]
    boxes = spark.createDataFrame([(i, 12, 9, k, *e, "a") for i in range(60) for k, e in enumerate(ends)], "sample_id long, h int, w int, box_ix int, x_min double, y_min double, x_max double, y_max double, label string").cache()
    for holes in (1, 2, 4, 6):
        op = OPERATORS["coarse_dropout"](p=1.0, num_holes_range=(1, holes), hole_height_range=(0.3, 0.95), hole_width_range=(0.3, 0.95))
        drawn = boxes.withColumns({f"p_{k}": F.expr(v) for k, v in op.draws(Draws(2, "0.coarse_dropout")).items()})
        want = []
        for r in map(lambda r: r.asDict(), drawn.collect()):
            if r["y_min"] is None:
                continue
            inside = [(r[f"p_x{k}"], r[f"p_y{k}"], r[f"p_xx{k}"], r[f"p_yy{k}"]) for k in range(r["p_n"])]
            every = [(x, y) for x in range(math.floor(r["x_min"] * 9), math.ceil(r["x_max"] * 9)) for y in range(math.floor(r["y_min"] * 12), math.ceil(r["y_max"] * 12))]
            seen = [(x, y) for x, y in every if not any(x0 <= x < x1 and y0 <= y < y1 for x0, y0, x1, y1 in inside)]
            xs, ys = [x for x, _ in seen], [y for _, y in seen]
            if seen:
                cut = (min(xs) / 9, min(ys) / 12, (max(xs) + 1) / 9, (max(ys) + 1) / 12)
                want.append((r["sample_id"], r["box_ix"], *(cut if len(seen) < len(every) else tuple(r[c] for c in ("x_min", "y_min", "x_max", "y_max")))))
        found = op.run(Frame(None, 0, boxes=boxes), 2).boxes.select("sample_id", "box_ix", "x_min", "y_min", "x_max", "y_max")
        assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) < 5 * 60, holes


def test_boxes_under_holes_are_compiled_code(spark):
    """No method beyond the 8000 bytes that the JVM compiles, nothing of the search copied into a filter."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = catalogue.QUERIES["box_coarse_dropout"](spark, SF)._jdf.queryExecution()
        filters = [line for line in plan.optimizedPlan().toString().splitlines() if line.strip().startswith("+- Filter")]
        assert filters and not any("48271" in line or "lambda" in line for line in filters)
        stages = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan.executedPlan())
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
        assert sizes and max(sizes) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def plain_blocks(px, q):
    """{(y, x): value} of a sample's {(y, x): value}, by the definition: sums in order of pixels and of frequencies."""
    out = {}
    for by, bx in {(y // 8, x // 8) for y, x in px}:
        block = sorted((y - 8 * by, x - 8 * bx, v) for (y, x), v in px.items() if (y // 8, x // 8) == (by, bx))
        bh, bw = max(y for y, _, _ in block) + 1, max(x for _, x, _ in block) + 1
        cos = lambda a, u, n: math.cos((2.0 * a + 1.0) * u * math.pi / (2.0 * n))
        scale, coded = (5000.0 / q if q < 50 else 200.0 - 2.0 * q) / 100.0, []
        for u in range(bh):
            for v in range(bw):
                total, norm, step = 0.0, math.sqrt((1.0 if u == 0 else 2.0) * (1.0 if v == 0 else 2.0) / (bh * bw)), max(1.0, (8.0 + 4.0 * (u + v)) * scale)
                for y, x, value in block:
                    total += (value - 128.0) * cos(y, u, bh) * cos(x, v, bw)
                coded.append((u, v, step * round(total * norm / step) * norm))
        for y, x, _ in block:
            total = 0.0
            for u, v, c in coded:
                total += c * cos(y, u, bh) * cos(x, v, bw)
            out[8 * by + y, 8 * bx + x] = max(0.0, min(255.0, math.floor(128.0 + total + 0.5)))
    return out


def test_compression_rounds_cosines_of_blocks(spark):
    """Whole and cut blocks, missing pixels, an unknown value (what it spoils is 255, as before), a sample without an id."""
    sizes = {0: (8, 8), 1: (17, 5), 2: (9, 9), 3: (8, 8), 4: (8, 8), None: (8, 8)}
    rows = [(i, h, w, y, x, float((y * y * 31 + x * 57 + (i or 0) * 13) % 256), 4.0 * ((x + y) % 60), None if (i, y, x) == (4, 2, 2) else 200.0) for i, (h, w) in sizes.items() for y in range(h) for x in range(w) if i != 3 or (y * x) % 5 != 2]
    px = spark.createDataFrame(rows, "sample_id long, h int, w int, y int, x int, v0 double, v1 double, v2 double")
    for q in (30, 99):
        out = OPERATORS["image_compression"](p=1.0, quality_range=(q, q)).run(Frame(px)).pixels
        found = {(r.sample_id, r.y, r.x): (r.v0, r.v1, r.v2) for r in out.collect()}
        assert len(found) == len(rows)
        for i in sizes:
            mine = [r for r in rows if r[0] == i]
            for k in range(3):
                start = {(r[3], r[4]): r[5 + k] for r in mine}
                want = start if i is None else dict.fromkeys(start, 255.0) if None in start.values() else plain_blocks(start, q)
                assert {(y, x): v[k] for (s, y, x), v in found.items() if s == i} == want, (q, i, k)


def test_compression_interprets_nothing_for_each_pixel(spark):
    """Some 25,000 lambda calls for a block and channel made it 40 ms an image."""
    text = catalogue.QUERIES["image_compression"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in text and text.count("Relation") == 1


def test_zero_weights_are_equal_weights(pixels):
    ops = (OPERATORS["invert_img"](p=0.0), OPERATORS["horizontal_flip"](p=0.0))
    assert len(table(compose.OneOf(ops, p=1.0).run(Frame(pixels)))) == pixels.count()


def test_some_of_and_random_order(pixels):
    ops = (OPERATORS["horizontal_flip"](p=1.0), OPERATORS["vertical_flip"](p=1.0), OPERATORS["invert_img"](p=1.0))
    assert table(compose.SomeOf(ops, n=3).run(Frame(pixels))) == table(compose.Sequential(ops, p=1.0).run(Frame(pixels)))
    assert table(compose.RandomOrder(ops, n=3).run(Frame(pixels))) == table(compose.Sequential(ops, p=1.0).run(Frame(pixels)))
    assert len(table(compose.SomeOf(ops, n=2, replace_=True).run(Frame(pixels)))) == pixels.count()


def test_algebra_and_specs(tmp_path, pixels):
    flip, crop = OPERATORS["horizontal_flip"](p=1.0), OPERATORS["center_crop"](4, 4)
    plan = compose.Compose((flip,)) + crop
    assert len(plan) == 2 and len(plan - type(flip)) == 1 and (crop + compose.Compose((flip,)) if hasattr(crop, "__add__") else [crop] + compose.Compose((flip,)))[0] == crop
    full = compose.Compose((compose.OneOf((flip, crop.__class__(6, 6)), p=1.0), OPERATORS["affine"](rotate=(-5, 5))), boxes=BoxParams("coco"), keypoints=KeypointParams())
    compose.save(full, str(tmp_path / "plan.json"))
    back = compose.load(str(tmp_path / "plan.json"))
    assert back == full
    with pytest.raises(ValueError):
        compose.plan_from_spec({"operator": "no_such"})
    with pytest.raises(ValueError):
        compose.plan_from_spec({"operator": "affine", "sizes": 3})


def test_every_operator_has_a_spec_that_comes_back():
    for name, cls in OPERATORS.items():
        if name in ("lambda", "text_image"):
            continue
        assert compose.plan_from_spec({k: v for k, v in cls().spec().items() if v is not None}) == cls(), name


def test_boxes(spark):
    b = spark.createDataFrame([(1, 100, 200, 0, 0.1, 0.2, 0.5, 0.6, "a"), (1, 100, 200, 1, -0.1, 0.0, 0.05, 1.0, "b")], "sample_id long, h int, w int, box_ix int, x_min double, y_min double, x_max double, y_max double, label string")
    for fmt in ("coco", "pascal_voc", "yolo", "normalised"):
        back = boxes_to_internal(boxes_from_internal(b, fmt), fmt).collect()
        assert all(abs(x - y) < 1e-12 for r, s in zip(back, b.collect()) for x, y in zip(r[4:8], s[4:8]))
    assert [r["label"] for r in BoxParams(min_visibility=0.5).filtered(b).collect()] == ["a"]
    assert BoxParams(filter_invalid_bboxes=True).prepared(b).count() == 1
    with pytest.raises(Exception, match="invalid box"):
        BoxParams().prepared(b).collect()
    assert BoxParams(clip=True).prepared(b).count() == 2


def test_crops_larger_than_the_sample_fail(pixels):
    with pytest.raises(Exception, match="crop larger"):
        OPERATORS["center_crop"](9, 9).run(Frame(pixels)).pixels.collect()


def test_compact_rows_and_streams(spark, pixels, tmp_path):
    from rasterlane.streaming import samples as stream

    compact = src.to_compact(Frame(pixels))
    assert table(Frame(src.from_compact(compact, 3))) == table(Frame(pixels))
    compact.write.parquet(str(tmp_path / "in"))
    plan = compose.Compose((OPERATORS["horizontal_flip"](p=0.5), OPERATORS["equalize"](p=1.0)))
    out = []
    q = stream.by_batch(stream.compact_stream(spark, str(tmp_path / "in")), plan, lambda df, n: out.extend(map(tuple, catalogue.shown(df).collect())), str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    assert sorted(out) == table(plan.run(Frame(pixels)))
    rows_ = stream.stateless(stream.compact_stream(spark, str(tmp_path / "in")), compose.Compose((OPERATORS["invert_img"](p=1.0),)))
    q = rows_.writeStream.format("memory").queryName("inverted").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("inverted").count() == pixels.count()


def test_the_entry_without_the_optional_folder():
    """In a Python that cannot find them: the subpackage and the pipeline are hidden, all else is there."""
    import subprocess
    import sys

    code = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("rasterlane.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
from rasterlane import catalogue
assert set(e.queries()) == set(catalogue.QUERIES) and set(e.oracle_sql()) == set(catalogue.ORACLE_SQL) and len(e.queries()) > 200
assert not any(m.startswith("rasterlane.llm") for m in sys.modules)
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


PACKED = [("invert_img", {}), ("solarize", {}), ("posterize", {"num_bits": (2, 6)}), ("random_brightness_contrast", {}), ("random_gamma", {}), ("rgbshift", {}), ("to_gray", {}), ("channel_dropout", {}), ("d4", {}), ("random_rotate90", {}),
    ("random_crop", {"height": 5, "width": 3}), ("center_crop", {}), ("pad", {"padding": (1, 2, 3, 0), "fill": 7.0}), ("pad", {"padding": 3, "border": "mirror"}), ("coarse_dropout", {"fill": 9.0}), ("equalize", {}), ("auto_contrast", {"cutoff": 5.0}), ("auto_contrast", {"method": "pil"}), ("blur", {}), ("resize", {"height": 5, "width": 11}), ("random_scale", {}), ("to_sepia", {}), ("channel_shuffle", {}), ("random_tone_curve", {"per_channel": True}), ("hue_saturation_value", {}), ("median_blur", {"blur_limit": (3, 5)}), ("morphological", {}), ("morphological", {"operation": "erosion", "scale": (3, 5)}), ("random_sized_crop", {}), ("random_resized_crop", {"interpolation": "area"}), ("random_sized_crop", {"linear": False}), ("longest_max_size", {"max_size": 11, "interpolation": "cubic"}), ("rotate", {"crop_border": True}), ("affine", {"rotate": (10, 60), "fit_output": True}), ("rotate", {}), ("perspective", {}), ("affine", {"rotate": (-20, 20), "scale": (0.7, 1.3), "shear": (-9, 9)})]


def test_samples_as_rows_give_the_same_pixels(spark):
    images = src.embedding_images(spark, SF, 8).where("sample_id < 12").cache()
    px = src.embedding_pixels(spark, SF).where("sample_id < 12").cache()
    assert table(Frame(packed.unpacked(images, 3))) == table(Frame(px))
    for name, args in PACKED:
        op = OPERATORS[name](**(args | {"p": 0.6}))
        found = packed.apply(op, images, 2)
        assert table(Frame(packed.unpacked(found, 3))) == table(op.run(Frame(px), 2)), name
    ops = [OPERATORS[n](**({"p": 0.5} | a)) for n, a in (PACKED[0], PACKED[8], PACKED[12], PACKED[10], PACKED[18], PACKED[14])]
    plan = compose.Compose((*ops[:3], compose.OneOf((ops[3], ops[4]), p=0.8), ops[5]))
    out = packed.apply(plan, images, 5)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert table(Frame(packed.unpacked(out, 3))) == table(plan.run(Frame(px), 5)) and "Exchange" not in text and text.count("MapInArrow") <= 2


def test_samples_as_rows_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, 2, 2, 1, bytearray([0, 1, 2, 255])), (None, 1, 1, 1, bytearray([9])), (2, 1, 1, 1, None)], "sample_id long, h int, w int, c int, data binary")
    found = {r["sample_id"]: r["data"] for r in packed.apply(OPERATORS["invert_img"](p=1.0), rows).collect()}
    assert found == {1: bytearray([255, 254, 253, 0]), None: bytearray([246]), 2: None}
    floats = packed.apply(OPERATORS["normalize"](mean=(0.5,), std=(0.5,)), rows.limit(1)).first()
    assert [round(x, 4) for x in struct.unpack("4f", floats["data"])] == [-1.0, -0.9922, -0.9843, 1.0]
    assert packed.apply(OPERATORS["horizontal_flip"](p=0.5), rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no kernel"):
        packed.apply(OPERATORS["clahe"](), rows)


@pytest.mark.parametrize("name", ["optical_distortion", "grid_distortion", "elastic_transform", "piecewise_affine", "thin_plate_spline", "grid_elastic_deform"])
def test_keypoints_follow_free_form_warps(spark, name):
    """The place that a keypoint goes to shows the place that it came from; boxes hold their keypoints."""
    op = OPERATORS[name](p=1.0, **({"sigma": 4.0} if name == "elastic_transform" else {}))  # a field that does not fold
    points = [(i, 40, 60, k, 6.0 + 7 * k, 30.0 - 4 * k, 0.5, 1.0, "a") for i in range(3) for k in range(5)]
    kp = spark.createDataFrame(points, "sample_id long, h int, w int, kp_ix int, x double, y double, angle double, scale double, label string")
    boxes = kp.selectExpr("sample_id", "h", "w", "kp_ix as box_ix", "(x - 2.5) / w as x_min", "(y - 2.5) / h as y_min", "(x + 3.5) / w as x_max", "(y + 3.5) / h as y_max", "label")
    out = op.run(Frame(None, 0, keypoints=kp, boxes=boxes), 1)
    draws = {f"p_{k}": F.expr(v) for k, v in op.draws(Draws(1, f"0.{name}")).items()}
    sy, sx = op.source()
    back = out.keypoints.withColumns(draws).selectExpr("sample_id", "kp_ix", "x as nx", "y as ny", "named_struct('x', x, 'y', y) as q", "h", "w", *draws).selectExpr("sample_id", "kp_ix", "nx", "ny", f"{sx} as sx", f"{sy} as sy")
    want = {(r[0], r[3]): (r[4], r[5]) for r in points}
    rows_ = back.collect()
    assert all(abs(r["sx"] - want[r["sample_id"], r["kp_ix"]][0]) < 0.02 and abs(r["sy"] - want[r["sample_id"], r["kp_ix"]][1]) < 0.02 for r in rows_)
    assert any(abs(r["nx"] - want[r["sample_id"], r["kp_ix"]][0]) > 0.01 for r in rows_)
    held = {(r["sample_id"], r["box_ix"]): r for r in out.boxes.collect()}
    assert all(b["x_min"] * 60 <= r["nx"] + 0.5 <= b["x_max"] * 60 and b["y_min"] * 40 <= r["ny"] + 0.5 <= b["y_max"] * 40 for r in rows_ for b in [held[r["sample_id"], r["kp_ix"]]])


def sources(op, points, seed):
    """(y, x) of the source of every output pixel, by sample: (sample, row, column, 2)."""
    draws = {f"p_{k}": F.expr(v) for k, v in op.draws(Draws(seed, f"0.{op.name}")).items()}
    sy, sx = op.source()
    grid = points.select("sample_id", "h", "w").distinct().withColumns(draws).withColumn("q", F.explode(F.expr("flatten(transform(sequence(0, h - 1), r -> transform(sequence(0, w - 1), k -> named_struct('y', 1e0 * r, 'x', 1e0 * k))))")))
    return {(r["sample_id"], int(r["y"]), int(r["x"])): (r["sy"], r["sx"]) for r in grid.selectExpr("sample_id", "q.y", "q.x", f"{sy} as sy", f"{sx} as sx").collect()}


def test_keypoints_under_folding_fields_go_to_the_nearest_place_or_go(spark):
    """Against the whole distance map in plain Python: no keypoint is placed where its source is not."""
    op = OPERATORS["elastic_transform"](p=1.0, alpha=6.0, sigma=2.0)
    points = [(i, 18, 24, k, 0.7 + 2.3 * k, 16.6 - 1.7 * k, 0.5, 1.0, "a") for i in range(3) for k in range(9)]
    kp = spark.createDataFrame(points, "sample_id long, h int, w int, kp_ix int, x double, y double, angle double, scale double, label string")
    maps = sources(op, kp, 1)
    found = {(r["sample_id"], r["kp_ix"]): r for r in op.run(Frame(None, 0, keypoints=kp), 1).keypoints.collect()}
    back = op.run(Frame(None, 0, keypoints=kp), 1).keypoints
    draws = {f"p_{k}": F.expr(v) for k, v in op.draws(Draws(1, f"0.{op.name}")).items()}
    sy, sx = op.source()
    shown_ = {(r["sample_id"], r["kp_ix"]): (r["sy"], r["sx"]) for r in back.withColumns(draws).withColumn("q", F.expr("named_struct('x', x, 'y', y)")).selectExpr("sample_id", "kp_ix", f"{sy} as sy", f"{sx} as sx").collect()}
    searched = lost = 0
    for i, _, _, k, x, y, *_ in points:
        d, ny, nx = min(((sy_ - y) ** 2 + (sx_ - x) ** 2, r, c) for (s, r, c), (sy_, sx_) in maps.items() if s == i)
        r = found.get((i, k))
        if r is None:
            lost += 1
            assert d > op.LOST**2
            continue
        at = shown_[i, k]
        if math.hypot(at[0] - y, at[1] - x) > op.CLOSE + 1e-9:
            searched += 1
            assert (r["y"], r["x"]) == (ny, nx) and d <= op.LOST**2
    assert searched > 3 and searched + lost < len(points)


def test_named_relations_share_draws_and_parts_keep_apart(spark, pixels):
    """Each frame of a clip comes out as if it were the sample; one scan each; unequal sizes and strangers fail."""
    ops = tuple(OPERATORS[n](**a) for n, a in (("horizontal_flip", {"p": 0.5}), ("equalize", {"p": 0.8}), ("blur", {"p": 0.6}), ("random_crop", {"height": 5, "width": 4}), ("coarse_dropout", {"p": 1.0, "fill": "random"}), ("gauss_noise", {"p": 0.7})))
    plan = compose.Compose(ops, seed=3, strict=True, additional_targets=(("other", "pixels"), ("clip", "pixels")))
    other = pixels.withColumns({f"v{i}": 255 - F.col(f"v{i}") for i in range(3)})
    clip = pixels.withColumn("frame_ix", F.lit(0)).unionByName(other.withColumn("frame_ix", F.lit(1)))
    frame = Frame(pixels, masks=pixels.drop("v1", "v2"), named={"other": Named("pixels", other), "clip": Named("pixels", clip, ("frame_ix",))})
    out = plan(frame)
    alone = {n: table(plan.run(Frame(px), 3)) for n, px in (("pixels", pixels), ("other", other))}
    found = {n: x.rows for n, x in out.named.items()}
    assert table(Frame(out.pixels)) == alone["pixels"] and table(Frame(found["other"])) == alone["other"]
    for i, n in enumerate(("pixels", "other")):
        assert table(Frame(found["clip"].where(f"frame_ix = {i}"))) == alone[n]
    assert set(found["clip"].columns) == set(clip.columns)
    narrow = Named("pixels", other.where("sample_id <> 2 or x < 7").withColumn("w", F.expr("case when sample_id = 2 then 7 else w end")))
    with pytest.raises(ValueError, match="size of sample 2"):
        plan(Frame(pixels, named={"other": narrow}))
    loose = compose.Compose(ops[:1], is_check_shapes=False)
    assert table(Frame(loose(Frame(pixels, named={"stranger": Named("pixels", other)})).named["stranger"].rows)) == table(Frame(other))
    with pytest.raises(ValueError, match="no additional targets"):
        plan(Frame(pixels, named={"stranger": Named("pixels", other)}))
    with pytest.raises(ValueError, match="another kind"):
        plan(Frame(pixels, named={"other": Named("masks", other)}))
    assert compose.plan_from_spec(plan.spec()) == plan


INVALID = [("invert_img", {"p": 1.5}, "p"), ("posterize", {"num_bits": 9}, "num_bits"), ("solarize", {"threshold_range": (0.9, 0.2)}, "threshold_range"), ("random_gamma", {"gamma_limit": (-1, 5)}, "gamma_limit"), ("image_compression", {"quality_range": (0, 90)}, "quality_range"), ("resize", {"height": 0}, "height"), ("resize", {"interpolation": "spline"}, "interpolation"),
    ("pad", {"border": "wrap"}, "border"), ("coarse_dropout", {"num_holes_range": (0, 2)}, "num_holes_range"), ("coarse_dropout", {"hole_height_range": (0.4, 0.1)}, "hole_height_range"), ("morphological", {"operation": "open"}, "operation"), ("blur", {"blur_limit": (-3, 3)}, "blur_limit"), ("random_crop", {"height": 4.5}, "height"),
    ("random_grid_shuffle", {"grid": (0, 2)}, "grid"), ("auto_contrast", {"cutoff": float("nan")}, "cutoff"), ("to_gray", {"num_output_channels": True}, "num_output_channels"), ("histogram_matching", {"blend_ratio": (0.5, 1.5)}, "blend_ratio"), ("gauss_noise", {"std_range": (-0.1, 0.2)}, "std_range"), ("rotate", {"crop_border": 1}, "crop_border")]


@pytest.mark.parametrize(("name", "args", "field_"), INVALID)
def test_invalid_arguments_are_named(name, args, field_):
    """When an operator is made, and from a spec."""
    with pytest.raises(ValueError, match=rf"{name}: {field_} = "):
        OPERATORS[name](**args)
    with pytest.raises(ValueError, match=field_):
        compose.plan_from_spec({"plan": "Compose", "transforms": [{"operator": name, **args}]})
    with pytest.raises((TypeError, ValueError), match="no_such"):
        OPERATORS[name](no_such=1)


def test_annotation_parameters_are_checked(spark):
    for made in (lambda: BoxParams("coc"), lambda: BoxParams(min_visibility=2), lambda: BoxParams(min_area=-1), lambda: KeypointParams("xyzw")):
        with pytest.raises(ValueError):
            made()
    kp = spark.createDataFrame([(1, 10, 20, 0, [3.0, 4.0], "a")], "sample_id long, h int, w int, kp_ix int, keypoint array<double>, label string")
    assert KeypointParams("yx").prepared(kp).first()["x"] == 4.0
    for bad, fmt in (([3.0, 4.0], "xya"), ([30.0, 4.0], "xy"), ([3.0, -4.0], "xy"), ([float("nan"), 4.0], "xy"), ([3.0, None], "xy"), (None, "xy")):
        row = spark.createDataFrame([(1, 10, 20, 0, bad, "a")], kp.schema)
        with pytest.raises(Exception, match="keypoint of sample"):
            KeypointParams(fmt).prepared(row).collect()
    assert KeypointParams("xy", remove_invisible=False).prepared(spark.createDataFrame([(1, 10, 20, 0, [30.0, 4.0], "a")], kp.schema)).first()["x"] == 30.0
    with pytest.raises(ValueError, match="label fields"):
        KeypointParams("xy", label_fields=("class_",)).prepared(kp)
    for fmt, array in (("xyas", [1.0, 2.0, 30.0, 4.0]), ("xysa", [1.0, 2.0, 4.0, 30.0]), ("xyz", [1.0, 2.0, 0.5]), ("xya", [1.0, 2.0, 359.0])):
        p = KeypointParams(fmt, label_fields=("label",))
        df = spark.createDataFrame([(1, 10, 20, 0, array, "a")], kp.schema)
        assert [round(v, 9) for v in p.shown(p.finished(p.prepared(df))).first()["keypoint"]] == array


def test_grid_shuffle_moves_boxes_with_their_pixels(spark):
    """Against masks of the boxes, moved and labelled pixel by pixel."""
    op = OPERATORS["random_grid_shuffle"](grid=(3, 2), p=0.7, min_area=2.0, min_visibility=0.1)
    boxes = spark.createDataFrame([(i, 12, 10, k, a / 10, b / 12, c / 10, e / 12, "a") for i in range(8) for k, (a, b, c, e) in enumerate(((0, 0, 10, 12), (3, 2, 7, 9), (4, 3, 5, 5), (1, 1, 9, 2)))], "sample_id long, h int, w int, box_ix int, x_min double, y_min double, x_max double, y_max double, label string")
    px = boxes.select("sample_id", "h", "w").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("v0", F.expr("y * 10.0 + x"))
    out = op.run(Frame(px, 1, boxes=boxes), 2)
    goes = {}
    for r in out.pixels.collect():
        goes[r["sample_id"], int(r["v0"]) // 10, int(r["v0"]) % 10] = (r["y"], r["x"])
    want = []
    for r in boxes.collect():
        left, top, right, bottom = (round(v) for v in (r["x_min"] * 10, r["y_min"] * 12, r["x_max"] * 10, r["y_max"] * 12))
        cells = {goes[r["sample_id"], y, x] for y in range(top, bottom) for x in range(left, right)}
        still = all(goes[r["sample_id"], y, x] == (y, x) for y in range(12) for x in range(10))
        total = len(cells)
        while cells:
            todo, part = [cells.pop()], []
            while todo:
                y, x = todo.pop()
                part.append((y, x))
                near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & cells
                cells -= near
                todo += near
            if still or len(part) >= 2 and len(part) >= 0.1 * total:
                want.append((r["sample_id"], r["box_ix"], min(x for _, x in part), min(y for y, _ in part), max(x for _, x in part) + 1, max(y for y, _ in part) + 1))
    found = [(r["sample_id"], r["box_ix"], *(round(v, 6) for v in (r["x_min"] * 10, r["y_min"] * 12, r["x_max"] * 10, r["y_max"] * 12))) for r in out.boxes.collect()]
    assert sorted(found) == sorted(want) and len(found) > len({f[:2] for f in found})
