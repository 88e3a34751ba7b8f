"""Label calibration, confidence intervals, agreement and consistency."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reports import joined_by_path


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _scores(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = _share(tp, tp + fp), _share(tp, tp + fn)
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", _share(2 * p * r, p + r)).withColumn("support", tp + fn)


def _counts(cases: DataFrame, *keys: str) -> DataFrame:
    e, p = F.coalesce("expected", F.lit(False)), F.coalesce("predicted", F.lit(False))
    return cases.groupBy(*keys).agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"))


def per_label(cases: DataFrame, taxonomy: DataFrame | None = None) -> DataFrame:
    """Counts, precision, recall, F1 and support of each label; a taxonomy (label) adds rows of zeros for labels without cases."""
    counts = _counts(cases, "label")
    if taxonomy is not None:
        counts = taxonomy.join(counts, "label", "left").na.fill(0, ["tp", "fp", "fn"])
    return _scores(counts)


def overall(cases: DataFrame) -> DataFrame:
    """One row: macro means of the labels' scores, and micro scores of pooled counts."""
    macro = per_label(cases).agg(*[F.avg(F.round(c, 6)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    micro = _scores(_counts(cases)).select(*[F.col(c).alias(f"micro_{c}") for c in ("precision", "recall", "f1")])
    return macro.crossJoin(micro)  # one row each


def mean_interval(rows: DataFrame, value: str, *keys: str, confidence: float = 0.95, method: str = "normal") -> DataFrame:
    """Mean and its two-sided interval; a single value is its own interval."""
    if not 0 < confidence < 1 or method not in ("normal", "t"):
        raise ValueError("confidence lies between 0 and 1 and method is normal or t")
    finite = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))
    stats = finite.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    critical: Column = F.lit(NormalDist().inv_cdf(0.5 + confidence / 2))
    if method == "t":
        critical = student_t(F.col("n") - 1, confidence)
    margin = F.coalesce(F.when(F.col("n") > 1, critical * F.col("sd") / F.sqrt("n")), F.lit(0.0))
    return stats.select(*keys, "n", "mean", (F.col("mean") - margin).alias("low"), (F.col("mean") + margin).alias("high"))


def t_quantile(df: int, confidence: float) -> float:
    """Student's t quantile: with t = sqrt(df) tan(a) the distribution is a sum of powers of cos(a), inverted by Newton steps."""
    import math

    def area(a: float) -> float:  # the integral of cos^(df - 1) from 0 to a
        total, m = (a, 0) if (df - 1) % 2 == 0 else (math.sin(a), 1)
        while m < df - 1:
            m += 2
            total = math.cos(a) ** (m - 1) * math.sin(a) / m + (m - 1) / m * total
        return total

    whole = area(math.pi / 2)
    a = math.atan(NormalDist().inv_cdf(0.5 + confidence / 2) / math.sqrt(df))
    low, high = 0.0, math.pi / 2
    for _ in range(200):
        miss = area(a) / whole - confidence
        low, high = (a, high) if miss < 0 else (low, a)
        slope = math.cos(a) ** (df - 1) / whole
        step = a - miss / slope if slope > 0 else math.nan
        new = step if low < step < high else (low + high) / 2
        if abs(new - a) < 1e-15:
            break
        a = new
    return math.sqrt(df) * math.tan(a)


#: Degrees of freedom with a quantile of their own; beyond them a series round the normal quantile is as exact.
T_TABLE = 200


def student_t(df: Column, confidence: float) -> Column:
    """Student's two-sided t quantile of each row's degrees of freedom."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    n = df.cast("double")
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    series = F.lit(z)
    for k, t in enumerate(terms, 1):
        series = series + F.lit(t) / F.pow(n, F.lit(float(k)))
    table = F.array(*[F.lit(t_quantile(k, confidence)) for k in range(1, T_TABLE + 1)])
    return F.coalesce(F.get(table, df.cast("int") - 1), series)


def cases_from_labels(results: DataFrame, expected: DataFrame, predicted: str = "labels") -> DataFrame:
    """case_id, expected and predicted label sets of results (file, source_file, labels) whose file, or else source file, is annotated in expected (path, expected)."""
    return joined_by_path(results, expected, "expected", "inner").select(F.col("file").alias("case_id"), "expected", F.col(predicted).alias("predicted"))


def set_cases(sets: DataFrame) -> DataFrame:
    """One row a case and label of either set, as `per_label` takes them; counted by set algebra."""
    e, p = F.array_distinct("expected"), F.array_distinct("predicted")
    each = lambda labels, ex, pr: F.transform(labels, lambda x: F.struct(x.alias("label"), F.lit(ex).alias("expected"), F.lit(pr).alias("predicted")))
    return sets.select("case_id", F.inline(F.concat(each(F.array_intersect(e, p), True, True), each(F.array_except(p, e), False, True), each(F.array_except(e, p), True, False))))


def variant_metrics(facts: DataFrame, variants: DataFrame, tolerances: dict[str, float]) -> DataFrame:
    """key, name, spread and consistent for each tolerated metric over all variants of a key; a variant without the metric makes it inconsistent.

    facts: key, variant, name, value; variants: key, variant. Tolerances are a few constants.
    """
    names = F.explode(F.map_from_arrays(F.array(*map(F.lit, tolerances)), F.array(*map(F.lit, tolerances.values()))))
    wanted = variants.select("key", "variant", names.alias("name", "tolerance"))
    finite = facts.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))).groupBy("key", "variant", "name").agg(F.max("value").alias("value"))
    j = wanted.join(finite, ["key", "variant", "name"], "left")
    spread = F.max("value") - F.min("value")
    return j.groupBy("key", "name").agg(spread.alias("spread"), F.count_if(F.col("value").isNull()).alias("invalid"), F.max("tolerance").alias("_t")).select("key", "name", "spread", "invalid", F.coalesce((F.col("spread") <= F.col("_t") + 1e-12) & (F.col("invalid") == 0), F.lit(False)).alias("consistent"))


def deviations(rows: DataFrame, key: str, reference: str, tolerance: float) -> DataFrame:
    """key, variant, deviation from the reference variant's value (to 6 digits) and whether it is within the tolerance; null and false without either value."""
    base = rows.where(F.col("variant") == reference).groupBy(key).agg(F.max("value").alias("_base"))
    d = F.col("value") - F.col("_base")
    return rows.join(base, key, "left").select(key, "variant", F.round(d, 6).alias("deviation"), F.coalesce(F.abs(d) <= tolerance + 1e-12, F.lit(False)).alias("within_tolerance"))


def bootstrap_interval(rows: DataFrame, proxy: str, reference: str, cluster: str, rounds: int = 2000, seed: int = 0) -> DataFrame:
    """One row: Pearson's r, bias and mean absolute error with 95 % intervals from a Poisson bootstrap of clusters.

    Each cluster is first summed up in one row, so rounds multiply clusters, not rows; its weight in a round follows from a hash of both.
    """
    import math

    x, y = F.col(proxy).cast("double"), F.col(reference).cast("double")
    sums = {"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y, "a": F.abs(x - y)}
    each = rows.where(x.isNotNull() & y.isNotNull()).groupBy(F.col(cluster).alias("c")).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    uniform = (F.pmod(F.xxhash64("c", "round", F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    weight, mass, total = F.lit(0), math.exp(-1), 0.0
    for k in range(12):  # the Poisson distribution's steps
        total += mass
        weight = weight + F.when(uniform > total, 1).otherwise(0)
        mass /= k + 1
    drawn = each.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds)))).withColumn("w", F.when(F.col("round") == 0, 1).otherwise(weight))
    agg = drawn.groupBy("round").agg(*[F.sum(F.col(k) * F.col("w")).alias(k) for k in sums])
    n, sx, sy = F.col("n"), F.col("x"), F.col("y")
    r = F.try_divide(n * F.col("xy") - sx * sy, F.sqrt((n * F.col("xx") - sx * sx) * (n * F.col("yy") - sy * sy)))
    stats = agg.select("round", r.alias("pearson"), F.try_divide(sx - sy, n).alias("bias"), F.try_divide(F.col("a"), n).alias("mae"))
    out = []
    for c in ("pearson", "bias", "mae"):
        out += [F.max(F.when(F.col("round") == 0, F.col(c))).alias(c), F.percentile(F.when(F.col("round") > 0, F.col(c)), 0.025).alias(f"{c}_low"), F.percentile(F.when(F.col("round") > 0, F.col(c)), 0.975).alias(f"{c}_high")]
    return stats.agg(*out)  # `rounds` rows


def trusted(confidence: Column, low_bound: Column, least: float = 0.7) -> Column:
    """A proxy counts as heuristic unless the lower bound of its correlation reaches `least`."""
    return F.when((confidence == "proxy") & ~F.coalesce(low_bound >= least, F.lit(False)), "heuristic").otherwise(confidence)


def agreement(rows: DataFrame, proxy: str, reference: str, *keys: str) -> DataFrame:
    """Pearson and Spearman correlation (average ranks), mean absolute and squared error and bias of a proxy."""
    both = rows.where(F.col(proxy).isNotNull() & F.col(reference).isNotNull())

    def rank(c: str) -> Column:
        w = Window.partitionBy(*keys).orderBy(c) if keys else Window.orderBy(c)
        ties = Window.partitionBy(*keys, c)
        return F.rank().over(w) + (F.count("*").over(ties) - 1) / 2.0

    ranked = both.withColumn("_p", rank(proxy)).withColumn("_r", rank(reference))
    d = F.col(proxy) - F.col(reference)
    return ranked.groupBy(*keys).agg(F.corr(proxy, reference).alias("pearson"), F.corr("_p", "_r").alias("spearman"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias"), F.count("*").alias("n"))


def consistency(rows: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Spread of each key's variants, and whether it stays within the tolerance with no variant missing."""
    spread = F.max("value") - F.min("value")
    return rows.groupBy(key).agg(spread.alias("spread"), F.count_if(F.col("value").isNull()).alias("invalid")).withColumn("consistent", F.coalesce((F.col("spread") <= tolerance + 1e-12) & (F.col("invalid") == 0), F.lit(False)))
