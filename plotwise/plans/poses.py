"""Registered query of two-view poses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import pose
from .catalogue import _half_up, _query, _t


@_query(f"""WITH g AS (SELECT vec_id % 3 AS pair, count(*) AS n, sum(CASE WHEN vec_id % 5 > 1 THEN 1 ELSE 0 END) AS good FROM embeddings GROUP BY ALL)
SELECT CAST(pair AS BIGINT) AS pair, CASE pair WHEN 2 THEN 'points' ELSE 'camera' END AS method, CAST(good AS BIGINT) AS n_inliers,
{_half_up("CAST(0.1 AS DOUBLE) * (pair + 1)", 4)} AS turn, CAST(0.5 AS DOUBLE) AS tx, CAST(0.25 AS DOUBLE) AS ty, CAST(-0.75 AS DOUBLE) AS tz FROM g WHERE n >= 40""")
def two_view_pose(spark, sf_dir):
    """Poses of a second view, turned by its pair's number, with two matches in five wrong; a pair without a camera goes by its points."""
    key = F.col("vec_id").cast("long")
    share = lambda a, m: (key * a % m).cast("double") / m
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", (key % 3).alias("pair"), (share(37, 101) * 4 - 2).alias("bx"), (share(53, 97) * 3 - 1.5).alias("by"), (share(71, 89) * 4 + 3).alias("bz"))
    angle = (F.col("pair") + 1) * 0.1
    there = rows.select("*", (F.cos(angle) * F.col("bx") + F.sin(angle) * F.col("bz") + 0.5).alias("ax"), (F.col("by") + 0.25).alias("ay"), (F.cos(angle) * F.col("bz") - F.sin(angle) * F.col("bx") - 0.75).alias("az"))
    wrong = F.when(key % 5 <= 1, key % 150 + 60.0).otherwise(0.0)
    seen = there.select("pair", *[(F.lit(500.0) * F.col(f"{s}{c}") / F.col(f"{s}z") + 400 + w).alias(f"{p}{v}") for s, v, w0 in (("a", "0", None), ("b", "1", wrong)) for c, p, w in (("x", "u", F.lit(0.0) if w0 is None else w0), ("y", "v", F.lit(0.0) if w0 is None else -w0 * 1.5))],
                        "ax", "ay", "az", (F.col("bx") + wrong / 50).alias("bx"), "by", "bz", *[F.when(F.col("pair") < 2, x).alias(n) for n, x in (("fx", 500.0), ("fy", 500.0), ("cx", 400.0), ("cy", 400.0))])
    out = pose.two_view_pose(seen, "pair")
    return out.select("pair", "method", "n_inliers", numeric.half_up(F.atan2(F.get("r", F.lit(2)), F.get("r", F.lit(0))), 4).alias("turn"), *[numeric.half_up(F.get("t", F.lit(k)), 4).alias(n) for k, n in enumerate(("tx", "ty", "tz"))])
