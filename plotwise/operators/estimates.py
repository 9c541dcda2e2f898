"""From single photos and scenes to one estimate a listing: method, bounds, fallback, and what the walls say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import SQFT_PER_M2, clamp
from .robust import fuse_estimates, keep_or_all

#: What a request may name (fixed values).
METHODS = ("multi-view", "single-image")


def choose_method(n_images: Column, requested: Column, mode: Column) -> Column:
    """single-image for one image; else what is asked for; else by mode. A request that names neither is null."""
    asked = F.lower(F.trim(requested))
    by_mode = F.when(mode == "single-image", "single-image").otherwise("multi-view")
    return F.when(n_images <= 1, "single-image").when(requested.isNotNull(), F.when(asked.isin(*METHODS), asked)).otherwise(by_mode)


def fuse_areas(images: DataFrame, key: str, area: str, residual: str, within: float = 0.10) -> DataFrame:
    """One area a key from its images': key, n, estimate, lo, hi; zeros where no image has an area.

    Images with an area above 0 and a residual below `within` count; where none has both, all with an area do.
    """
    some = images.where(F.col(area) > 0)
    good = keep_or_all(some, [key], F.col(residual) < within)
    fused = fuse_estimates(good, [key], area)
    every = images.select(key).distinct().join(fused, key, "left")
    return every.select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "estimate", "lo", "hi")])


def scene_bounds(scenes: DataFrame, images: DataFrame, key: str, area: str, impute: bool = False) -> DataFrame:
    """Estimate and bounds of scenes with visible_m2 and completed_m2 (rect_upper_m2 for the upper bound, if there is one).

    Imputed, the completed room counts, between the visible floor and the upper bound; else the visible floor,
    between it and the areas above 0 of the single images. Returns key, fused_m2, lo_m2, hi_m2.
    """
    own = images.where(F.col(area) > 0).groupBy(key).agg(F.min(area).alias("_lo"), F.max(area).alias("_hi"))
    rows = scenes.join(own, key, "left")
    visible, completed = F.col("visible_m2"), F.col("completed_m2")
    upper = F.coalesce("rect_upper_m2", completed) if "rect_upper_m2" in scenes.columns else completed
    if impute:
        return rows.select(key, completed.alias("fused_m2"), F.least(visible, completed).alias("lo_m2"), F.greatest(upper, completed).alias("hi_m2"))
    return rows.select(key, visible.alias("fused_m2"), F.least(visible, "_lo").alias("lo_m2"), F.greatest(visible, "_hi").alias("hi_m2"))


def listing_estimates(images: DataFrame, scenes: DataFrame, key: str, area: str, residual: str, impute: bool = False) -> DataFrame:
    """One estimate a listing: its scene's where a scene was solved (no reason) from two images or more, else the fused images'.

    Returns key, n_images, method (multi-view, single-image or fallback), area_m2, lo_m2, hi_m2, sqft. A scene that
    failed has a `reason`.
    """
    n = images.groupBy(key).agg(F.count("*").alias("n_images"))
    solved = scene_bounds(scenes.where("reason is null"), images, key, area, impute)
    fused = fuse_areas(images, key, area, residual)
    rows = n.join(fused, key).join(solved, key, "left")
    scene = F.col("fused_m2").isNotNull() & (F.col("n_images") >= 2)
    method = F.when(scene, "multi-view").when(F.col("n_images") == 1, "single-image").otherwise("fallback")
    pick = lambda a, b: F.when(scene, F.col(a)).otherwise(F.col(b))
    value = pick("fused_m2", "estimate")
    return rows.select(key, "n_images", method.alias("method"), value.alias("area_m2"), pick("lo_m2", "lo").alias("lo_m2"), pick("hi_m2", "hi").alias("hi_m2"), (value * SQFT_PER_M2).alias("sqft"))


def fraction(rows: DataFrame, keys: list[str], condition: Column, name: str) -> DataFrame:
    """The share of a group's rows that meet a condition (null counts as not)."""
    return rows.groupBy(*keys).agg((F.count_if(condition).cast("double") / F.count("*")).alias(name))


def containment(x: Column, y: Column, box: dict[str, Column], buffer: float) -> Column:
    """Whether a point lies in a box (x_min, x_max, y_min, y_max) widened by a buffer."""
    return x.between(box["x_min"] - buffer, box["x_max"] + buffer) & y.between(box["y_min"] - buffer, box["y_max"] + buffer)


def beyond_side(side: Column, x: Column, y: Column, at: Column, tolerance: float) -> Column:
    """Whether a point lies outside a room's side by more than a tolerance."""
    return F.when(side == "x_min", x < at - tolerance).when(side == "x_max", x > at + tolerance).when(side == "y_min", y < at - tolerance).when(side == "y_max", y > at + tolerance)


def mean_direction(rows: DataFrame, keys: list[str], columns: tuple[str, str, str]) -> DataFrame:
    """The unit vector of the mean of directions; straight up (0, 0, 1) where they cancel out. Columns: keys, ux, uy, uz."""
    means = rows.groupBy(*keys).agg(*[F.avg(c).alias(f"_{k}") for k, c in zip("xyz", columns)])
    size = F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2 + F.col("_z") ** 2)
    up = {"x": 0.0, "y": 0.0, "z": 1.0}
    return means.select(*keys, *[F.when(size < 1e-9, up[k]).otherwise(F.col(f"_{k}") / size).alias(f"u{k}") for k in "xyz"])


def line_statistics(points: DataFrame, line: str) -> DataFrame:
    """Span (2 to 98 %), height span, mean normal agreement, median distance and number of each line's points.

    Points carry along, height, agreement and dist.
    """
    q = lambda p: F.percentile("along", F.lit(p))
    return points.groupBy(line).agg(F.count("*").alias("n"), (q(0.98) - q(0.02)).alias("span"), (F.max("height") - F.min("height")).alias("height_span"), F.avg("agreement").alias("agreement"), F.percentile("dist", F.lit(0.5)).alias("residual"))


def wall_confidence(n: Column, span: Column, agreement: Column, residual: Column, least: float, within: float) -> Column:
    """How far a wall line is believed, 0 to 1: points 35 %, span 25 %, normals 20 %, residual 20 %."""
    parts = ((0.35, n / (3.0 * least)), (0.25, span / 2.5), (0.20, (agreement - 0.5) / 0.4), (0.20, 1 - residual / within))
    return clamp(reduce(lambda a, b: a + b, [F.lit(w) * clamp(x, 0.0, 1.0) for w, x in parts]), 0.0, 1.0)


def seam_confidence(n: Column, span: Column, violation: Column) -> Column:
    """How far a side that only a seam shows is believed."""
    return clamp(F.lit(0.28) + 0.35 * clamp(n / 400.0, 0.0, 1.0) + 0.25 * clamp(span / 2.5, 0.0, 1.0) - violation, 0.0, 1.0)


def side_score(confidence: Column, seam_points: Column, span: Column, gap: Column, violation: Column) -> Column:
    """What a candidate for a side is worth: long spans and seams help; violations and more than 1.5 m outside the support hurt."""
    return confidence + 0.35 * clamp(seam_points / 250.0, 0.0, 1.0) + 0.20 * clamp(span / 2.5, 0.0, 1.0) - 0.15 * F.greatest(F.lit(0.0), gap - 1.5) - violation


def select_sides(candidates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The best candidate of each side, the first by `order` of equals; candidates carry what side_score() reads."""
    scored = candidates.withColumn("score", side_score(F.col("confidence"), F.col("seam_points"), F.col("span"), F.col("gap"), F.col("violation")))
    best = scored.groupBy(*keys).agg(F.min_by(F.struct(*scored.columns), F.struct(-F.col("score"), F.col(order))).alias("_best"))
    return best.select("_best.*")


#: Gates of a completed layout (fixed values).
LAYOUT = {"high": 0.70, "low": 0.50, "median": 0.07, "p95": 0.18, "camera_low": 0.5, "camera_high": 2.5, "support": 100, "frame": 0.40, "good_frame": 0.55, "violation": 0.03, "contain_low": 0.97, "contain_high": 0.97, "shrink": 0.95}


def layout_reason(c: dict[str, Column], gate: Column, frame: float = LAYOUT["frame"]) -> Column:
    """Why a layout stays with the visible floor, the first reason in the order the steps meet them; null if none holds.

    Columns by name: residual_median, residual_p95, camera_height, n_support, n_lines, concentration, n_missing,
    violation, containment, area, visible, n_real, confidence (of the layout as a whole). `gate` is "ok" or a dimension's reason.
    """
    checks = (
        (c["residual_median"].isNull(), "floor_fit_failed"),
        ((c["residual_median"] > LAYOUT["median"]) | (c["residual_p95"] > LAYOUT["p95"]), "floor_plane_residual_too_high"),
        (~c["camera_height"].between(LAYOUT["camera_low"], LAYOUT["camera_high"]), "camera_height_outside_gate"),
        (c["n_support"] < LAYOUT["support"], "too_few_support_points"),
        (c["n_lines"] < 2, "fewer_than_two_reliable_wall_lines"),
        (c["concentration"] < frame, "weak_manhattan_frame"),
        (c["n_missing"] > 1, "more_than_one_missing_boundary"),
        (c["n_missing"] == 1, "not_enough_boundaries"),
        (gate != "ok", gate),
        (c["violation"] > LAYOUT["violation"], "support_violation_too_high"),
        (c["containment"] < LAYOUT["contain_low"], "support_containment_too_low"),
        (c["area"] < c["visible"] * LAYOUT["shrink"], "completed_area_smaller_than_visible_floor"),
        (c["n_real"] < 3, "fewer_than_three_real_boundaries"),
        (c["confidence"] < LAYOUT["low"], "confidence_too_low"),
    )
    return F.coalesce(*[F.when(test, F.lit(why) if isinstance(why, str) else why) for test, why in checks])


def layout_status(reason: Column, confidence: Column, n_real: Column, n_inferred: Column, n_walls: Column, contain: Column, concentration: Column) -> Column:
    """visible_only where a reason holds; completed with confidence, four seen sides, two of them walls, the support inside and a good frame; else low_confidence_completed."""
    good = (confidence >= LAYOUT["high"]) & (n_inferred == 0) & (n_real == 4) & (n_walls >= 2) & (contain >= LAYOUT["contain_high"]) & (concentration >= LAYOUT["good_frame"])
    return F.when(reason.isNotNull(), "visible_only").when(good, "completed").otherwise("low_confidence_completed")


def layout_confidence(concentration: Column, contain: Column, n_real: Column, n_walls: Column, mean_confidence: Column, n_inferred: Column, cap: float = 0.58) -> Column:
    """The layout's confidence: frame 25 %, containment 25 %, sides 20 %, walls 15 %, the sides' own 15 %, less 20 % an inferred side, which also caps it."""
    unit = lambda x: clamp(x, 0.0, 1.0)
    value = unit(0.25 * unit((concentration - 0.40) / 0.30) + 0.25 * unit((contain - 0.92) / 0.06) + 0.20 * unit(n_real / 4.0) + 0.15 * unit(n_walls / 2.0) + 0.15 * mean_confidence - 0.20 * n_inferred)
    return F.when(n_inferred > 0, F.least(value, F.lit(cap))).otherwise(value)


def affine(x: Column, y: Column, m: list[Column]) -> tuple[Column, Column]:
    """A point under an affine map of six numbers by row."""
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def affine_inverse(m: list[Column]) -> list[Column]:
    """The six numbers of the inverse map; null where the map is all but flat (determinant below 1e-8)."""
    det = m[0] * m[4] - m[1] * m[3]
    inv = F.when(F.abs(det) >= 1e-8, 1 / det)
    a, b, d, e = m[4] * inv, -m[1] * inv, -m[3] * inv, m[0] * inv
    return [a, b, -(a * m[2] + b * m[5]), d, e, -(d * m[2] + e * m[5])]


def pixel_intrinsics(fx: Column, fy: Column, cx: Column, cy: Column, width: Column, height: Column) -> dict[str, Column]:
    """Focal lengths and centre in pixels; values that look like shares of the image (0 to 10, 0 to 2) are scaled by its size."""
    inside = lambda v, top: (v > 0) & (v < top)
    share = inside(fx, 10) & inside(fy, 10) & inside(cx, 2) & inside(cy, 2)
    scaled = lambda v, size: F.when(share, v * size).otherwise(v)
    return {"fx": scaled(fx, width), "fy": scaled(fy, height), "cx": scaled(cx, width), "cy": scaled(cy, height)}


#: Edges of rings that are sent to every task.
MOST_EDGES = 500_000


def inside_ring(points: DataFrame, edges: DataFrame, key: str, ident: str, epsilon: float = 1e-12) -> DataFrame:
    """Points (key, ident, x, y) inside the ring of their key: an odd number of crossings, the divisor kept off 0 by an epsilon.

    Edges are (key, ax, ay, bx, by), one row an edge; a point meets its own ring's edges alone. Up to 500,000 edges in all are
    sent as one array a ring and points are filtered where they are; beyond that points and edges are joined by key. An ident is one point.
    """
    crossed = lambda e: ((e["by"] > F.col("y")) != (e["ay"] > F.col("y"))) & (F.col("x") < (e["ax"] - e["bx"]) * (F.col("y") - e["by"]) / ((e["ay"] - e["by"]) + epsilon) + e["bx"])
    if edges.limit(MOST_EDGES + 1).count() <= MOST_EDGES:
        rings = edges.groupBy(key).agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("_ring"))
        inside = F.size(F.filter("_ring", crossed)) % 2 == 1
        return points.join(F.broadcast(rings), key).where(inside).select(key, ident)
    both = points.join(edges, key).where(crossed({c: F.col(c) for c in ("ax", "ay", "bx", "by")}))
    return both.groupBy(key, ident).agg(F.count("*").alias("_n")).where("_n % 2 = 1").select(key, ident)


# ---- roles of pixels and sides of rooms --------------------------------------------------------------------

SIDES = ("x_min", "x_max", "y_min", "y_max")
#: Distances in metres, least points and confidence of sides that a seam or the support shows (fixed values).
NEAR_SEAM, LEAST_SEAM, FAR_FROM_SUPPORT, OUTSIDE, INFERRED = 0.25, 20, 0.60, 0.15, 0.38


def pixel_role(cls: Column, up: Column, floor: int, wall: int, furniture: tuple[int, ...]) -> Column:
    """floor, wall or furniture by class and by how far the normal points along the floor's (`up`, its product with it); null for neither."""
    return F.when((cls == floor) & (F.abs(up) > 0.70), "floor").when((cls == wall) & (F.abs(up) < 0.40), "wall").when(cls.isin(*furniture), "furniture")


def in_height_band(role: Column, height: Column) -> Column:
    """Whether a pixel's height above the floor suits its role: walls 0.25 to 3.20 m, furniture -0.05 to 2.20 m, ends left out; floors at any height."""
    inside = lambda low, high: (height > low) & (height < high)
    return F.when(role == "wall", inside(0.25, 3.20)).when(role == "furniture", inside(-0.05, 2.20)).otherwise(role == "floor")


def has_depth(columns: tuple[str, str, str] = ("x", "y", "z"), far: float = 30.0) -> Column:
    """Whether a point is finite and its depth between 0.10 m and `far`, ends left out."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))) for c in columns]
    return finite[0] & finite[1] & finite[2] & (F.col(columns[2]) > 0.10) & (F.col(columns[2]) < far)


def finite_depth(rows: DataFrame, columns: tuple[str, str, str] = ("x", "y", "z"), far: float = 30.0) -> DataFrame:
    """Rows of finite points whose depth is between 0.10 m and `far` (30 to fuse views, 40 to match them), ends left out."""
    return rows.where(has_depth(columns, far))


def camera_side(planes: DataFrame) -> DataFrame:
    """Planes (px, py, pz, d, normal of any length) as unit planes with the camera, at the origin, on the positive side; adds camera_height."""
    size = F.sqrt(F.col("px") ** 2 + F.col("py") ** 2 + F.col("pz") ** 2)
    sign = F.when(F.col("d") < 0, -1.0).otherwise(1.0) / size
    kept = [c for c in planes.columns if c not in ("px", "py", "pz", "d")]
    return planes.where(size > 0).select(*kept, *[(F.col(c) * sign).alias(c) for c in ("px", "py", "pz", "d")], (F.abs("d") / size).alias("camera_height"))


def support_extents(support: DataFrame, key: str, trim: float = 0.01) -> DataFrame:
    """key, side, extent, across_low, across_high: where each group's support (x, y) ends on every side, a hundredth at either end left out."""
    ends = support.groupBy(key).agg(*[F.percentile(c, F.lit(q)).alias(f"{c}_{n}") for c in "xy" for n, q in (("min", trim), ("max", 1 - trim))])
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("extent"), *[F.col(f"{'y' if s[0] == 'x' else 'x'}_{n}").alias(f"across_{a}") for n, a in (("min", "low"), ("max", "high"))]) for s in SIDES]))
    return ends.select(key, rows.alias("s")).select(key, "s.*")


def side_violations(sides: DataFrame, support: DataFrame, key: str, also: list[str] | None = None) -> DataFrame:
    """Sides (key, side, at) with `violation`, the share of their group's support beyond them by more than 15 cm. `also` names what else tells rows of one side apart."""
    own = [key, *(also or []), "side"]
    out = beyond_side(F.col("side"), F.col("x"), F.col("y"), F.col("at"), OUTSIDE)
    shares = fraction(sides.select(*own, "at").hint("shuffle_hash").join(support.select(key, "x", "y"), key), own, out, "violation")
    return sides.join(shares, own)


def seam_sides(seams: DataFrame, support: DataFrame, key: str) -> DataFrame:
    """Sides that seams alone show: key, side, at, span, seam_points, violation, confidence.

    A side is where the outermost hundredth of a group's seam points (x, y) begins. It needs 20 seam points within
    25 cm that reach 25 cm along it, the support's end within 60 cm, and at most 3 % of the support beyond it.
    """
    many = seams.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= LEAST_SEAM).select(key)
    enough = seams.join(many.hint("shuffle_hash"), key, "left_semi")
    ends = support_extents(enough, key).select(key, "side", F.col("extent").alias("at"))
    across_x = F.col("side").startswith("x")
    near = ends.hint("shuffle_hash").join(seams.select(key, "x", "y"), key).where(F.abs(F.when(across_x, F.col("x")).otherwise(F.col("y")) - F.col("at")) < NEAR_SEAM)
    along = F.when(across_x, F.col("y")).otherwise(F.col("x"))
    spans = near.withColumn("_t", along).groupBy(key, "side", "at").agg(F.count("*").alias("seam_points"), (F.percentile("_t", F.lit(0.95)) - F.percentile("_t", F.lit(0.05))).alias("span"))
    held = spans.where((F.col("seam_points") >= LEAST_SEAM) & (F.col("span") >= 0.25)).join(support_extents(support, key).select(key, "side", "extent"), [key, "side"])
    held = side_violations(held.where(F.abs(F.col("at") - F.col("extent")) <= FAR_FROM_SUPPORT), support, key).where(F.col("violation") <= LAYOUT["violation"])
    return held.select(key, "side", "at", "span", "seam_points", "violation", seam_confidence(F.col("seam_points"), F.col("span"), F.col("violation")).alias("confidence"))


def infer_missing_side(sides: DataFrame, support: DataFrame, key: str) -> DataFrame:
    """Sides (key, side, at, span, confidence) and, for groups with exactly three, the fourth at the end of the support, marked `inferred`."""
    three = sides.groupBy(key).agg(F.count("*").alias("_n"), F.collect_set("side").alias("_have")).where("_n = 3")
    missing = support_extents(support, key).join(three, key).where(~F.array_contains(F.col("_have"), F.col("side")))
    new = missing.select(key, "side", F.col("extent").alias("at"), (F.col("across_high") - F.col("across_low")).alias("span"), F.lit(INFERRED).alias("confidence"), F.lit(True).alias("inferred"))
    return sides.select(key, "side", "at", "span", "confidence", F.lit(False).alias("inferred")).unionByName(new)
