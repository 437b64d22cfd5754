"""Comparing laps: best-lap profiles, delta to best, regressions, integrals, gauge scales."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timebase import KEY, by_time, latest


def best_lap_profile(lapped: DataFrame, best: DataFrame, distance: str = "along", key: str = KEY) -> DataFrame:
    """(session, dist, best_time) of the best lap's samples, one row a distance (the earliest)."""
    rows = lapped.join(best.select(key, "lap"), [key, "lap"], "left_semi").where(F.col(distance).isNotNull())
    return rows.groupBy(key, F.col(distance).alias("dist")).agg(F.min("lap_time").alias("best_time"))


def time_at_distance(samples: DataFrame, profile: DataFrame, distance: str = "along", key: str = KEY) -> DataFrame:
    """Adds predicted, the profile's time at each sample's distance: linear between its points, held at both ends.

    Samples and profile pass one window in order of distance: an interpolating as-of join without a join.
    """
    marks = profile.select(key, F.col("dist").alias(distance), F.struct(F.col("dist").alias("d"), F.col("best_time").alias("t")).alias("_p"))
    both = samples.unionByName(marks, allowMissingColumns=True).withColumn("_is", F.col("_p").isNull().cast("int"))
    # a profile point at a sample's own distance counts on both sides
    before = latest(F.col("_p"), key, [distance, "_is"])
    after = latest(F.col("_p"), key, [F.col(distance).desc(), "_is"])
    out = both.withColumns({"_b": before, "_a": after})
    span = F.col("_a.d") - F.col("_b.d")
    linear = F.col("_b.t") + (F.col("_a.t") - F.col("_b.t")) * (F.col(distance) - F.col("_b.d")) / span
    return out.withColumn("predicted", F.coalesce(F.when(span > 0, linear), F.col("_b.t"), F.col("_a.t"))).where("_is = 1").drop("_p", "_is", "_a", "_b")


def delta_to_best(lapped: DataFrame, best: DataFrame, distance: str = "along", key: str = KEY) -> DataFrame:
    """Adds predicted and delta, seconds behind (+) or ahead (-) of the session's best lap at the same distance."""
    out = time_at_distance(lapped, best_lap_profile(lapped, best, distance, key), distance, key)
    return out.withColumn("delta", F.col("lap_time") - F.col("predicted"))


def quadratic_fit(rows: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Least squares y = c + b x + a x^2 per group with r2, from one pass of centred sums; null where it has no solution."""
    valid = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    means = valid.groupBy(*keys).agg(F.avg(x).alias("_m"))
    u, v = F.col(x) - F.col("_m"), F.col(y)
    s = valid.join(means, keys).groupBy(*keys).agg(
        F.first("_m").alias("m"), F.count("*").alias("n"), F.sum(u).alias("s1"), F.sum(u**2).alias("s2"), F.sum(u**3).alias("s3"), F.sum(u**4).alias("s4"),
        F.sum(v).alias("t0"), F.sum(u * v).alias("t1"), F.sum(u**2 * v).alias("t2"), F.sum(v * v).alias("vv"))
    n, s1, s2, s3, s4, t0, t1, t2, m = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4", "t0", "t1", "t2", "m"))

    def det(a, b, c, d, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    whole = det(n, s1, s2, s1, s2, s3, s2, s3, s4)
    s = s.withColumn("_d", F.when(F.abs(whole) > 1e-12 * n * s2 * s4, whole))
    c0 = det(t0, s1, s2, t1, s2, s3, t2, s3, s4) / F.col("_d")
    c1 = det(n, t0, s2, s1, t1, s3, s2, t2, s4) / F.col("_d")
    c2 = det(n, s1, t0, s1, s2, t1, s2, s3, t2) / F.col("_d")
    s = s.withColumns({"_c0": c0, "_c1": c1, "_c2": c2})
    residual = F.col("vv") - F.col("_c0") * t0 - F.col("_c1") * t1 - F.col("_c2") * t2
    total = F.col("vv") - t0 * t0 / n
    return s.select(*keys, "n", (F.col("_c0") - F.col("_c1") * m + F.col("_c2") * m * m).alias("c"), (F.col("_c1") - 2 * F.col("_c2") * m).alias("b"), F.col("_c2").alias("a"), (1 - F.try_divide(residual, total)).alias("r2"))


def polynomial_fit(rows: DataFrame, x: str, y: str, keys: list[str], order: int = 2) -> DataFrame:
    """Least squares of y on the powers of x up to order, per group (no keys: all rows as one).

    (keys, n, coefs, centre, scale, scaled, r2): coefs by rising power of x; scaled by rising power of (x - centre) / scale,
    which stays exact where x is large (engine speeds); r2 null where y is constant. All coefficients are null where the
    x values are too few or too alike for the order. Null and non-finite rows are left out. A null key is a group.

    Two aggregations that combine before their shuffles: centre and scale, then the power sums of the scaled values, whose
    normal equations are solved by square-root-free Cholesky factors in columns.
    """
    if order < 1:
        raise ValueError("order has to be at least 1")
    keys, given = keys or ["_all"], keys
    rows = rows if given else rows.withColumn("_all", F.lit(0))
    finite = (F.abs("_x") < float("inf")) & (F.abs("_y") < float("inf"))
    valid = rows.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where(finite)
    centres = valid.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.avg("_x").alias("_m"), F.avg("_y").alias("_w"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    reach = F.greatest(F.col("_hi") - F.col("_m"), F.col("_m") - F.col("_lo"))
    centres = centres.withColumn("_h", F.when(reach > 0, reach).otherwise(1.0)).drop("_lo", "_hi")
    same = [valid[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    u, v = (F.col("_x") - F.col("_m")) / F.col("_h"), F.col("_y") - F.col("_w")
    powers = [F.lit(1.0)]
    for _ in range(2 * order):
        powers.append(powers[-1] * u)
    s = valid.join(centres, same).groupBy(*keys).agg(
        F.count("*").alias("n"), F.first("_m").alias("_m"), F.first("_w").alias("_w"), F.first("_h").alias("_h"), F.sum(v * v).alias("_vv"),
        *(F.sum(p).alias(f"_s{j}") for j, p in enumerate(powers)), *(F.sum(p * v).alias(f"_t{j}") for j, p in enumerate(powers[: order + 1])))

    size = range(order + 1)
    total = lambda terms: sum(terms, F.lit(0.0))
    for j in size:  # factors: s = l d l'
        pivot = F.col(f"_s{2 * j}") - total(F.col(f"_l{j}_{p}") ** 2 * F.col(f"_d{p}") for p in range(j))
        s = s.withColumn(f"_d{j}", F.when(pivot > 1e-12 * F.col(f"_s{2 * j}"), pivot))
        s = s.withColumns({f"_l{i}_{j}": (F.col(f"_s{i + j}") - total(F.col(f"_l{i}_{p}") * F.col(f"_l{j}_{p}") * F.col(f"_d{p}") for p in range(j))) / F.col(f"_d{j}") for i in size if i > j})
    for j in size:
        s = s.withColumn(f"_z{j}", F.col(f"_t{j}") - total(F.col(f"_l{j}_{p}") * F.col(f"_z{p}") for p in range(j)))
    for j in reversed(size):
        s = s.withColumn(f"_c{j}", F.col(f"_z{j}") / F.col(f"_d{j}") - total(F.col(f"_l{p}_{j}") * F.col(f"_c{p}") for p in size if p > j))
    residual = F.col("_vv") - total(F.col(f"_z{j}") ** 2 / F.col(f"_d{j}") for j in size)
    whole = F.col("_vv") - F.col("_t0") ** 2 / F.col("n")

    # the factors hold null where a pivot vanishes: then no coefficient counts
    solved = F.col(f"_d{order}").isNotNull()
    scaled = [F.col(f"_c{j}") + (F.col("_w") if j == 0 else 0.0) for j in size]
    shift = -F.col("_m") / F.col("_h")  # (x - m) / h = x / h + shift
    plain = [total(scaled[j] * comb(j, i) * F.pow(shift, F.lit(j - i)) for j in size if j >= i) / F.pow("_h", F.lit(i)) for i in size]
    out = s.select(*keys, "n", F.when(solved, F.array(*plain)).alias("coefs"), F.col("_m").alias("centre"), F.col("_h").alias("scale"),
        F.when(solved, F.array(*scaled)).alias("scaled"), F.when(solved & (F.col("_vv") > 0), 1 - F.try_divide(residual, whole)).alias("r2"))
    return out if given else out.drop("_all")


def polynomial_value(coefs: Column, x: Column) -> Column:
    """The polynomial with coefficients by rising power at x; null where either is."""
    return F.when(coefs.isNotNull(), F.aggregate(F.reverse(coefs), F.lit(0.0), lambda a, c: a * x + c))


def integrate(samples: DataFrame, value: str, keys: list[str], key: str = KEY) -> DataFrame:
    """(keys, integral): value times the time to the sample before, summed."""
    step = F.coalesce(F.col("t") - F.lag("t").over(by_time(key)), F.lit(0.0))
    return samples.withColumn("_dt", step).groupBy(*keys).agg(F.sum(F.col(value) * F.col("_dt")).alias("integral"))


def gauge_scale(samples: DataFrame, value: str, quantile: float | None = 0.995, exact: bool = True, key: str = KEY) -> DataFrame:
    """(session, full): the greatest value, or a quantile that spikes don't reach."""
    if quantile is None:
        full = F.max(value)
    else:
        full = F.percentile(value, F.lit(quantile)) if exact else F.percentile_approx(value, quantile)
    return samples.groupBy(key).agg(full.alias("full"))
