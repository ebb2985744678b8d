"""Hypothesis tests. Each gives one row, or one for each value of `groups`.

One-sided p-values are upper tails; p-values are null where a test has too few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.prob import FUNCTIONS
from corvane.operators.checks import expr, names
from corvane.operators.order import running

_t, _f, _chi2, _normal, _ks = (FUNCTIONS[f"{x}_cdf"] for x in ("students_t", "fisher_f", "chi_squared", "normal", "kolmogorov"))


def _two_sided_t(out: DataFrame) -> DataFrame:
    ok = F.col("degrees_of_freedom") > 0
    t, df = F.when(ok, F.col("statistic")), F.when(ok, F.col("degrees_of_freedom"))
    return out.withColumn("p_value_one_sided", 1 - _t(t, df)).withColumn("p_value_two_sided", 2 * (1 - _t(F.abs(t), df)))


def t_test_one(df: DataFrame, value, groups=None) -> DataFrame:
    """One-sample t-test of a mean of zero (of differences: the paired test)."""
    x = expr(value).cast("double")
    out = df.groupBy(*names(groups)).agg((F.avg(x) / F.sqrt(F.var_samp(x) / F.count(x))).alias("statistic"), (F.count(x) - 1).cast("double").alias("degrees_of_freedom"))
    return _two_sided_t(out)


def _halves(first, value) -> dict[str, Column]:
    a, x = expr(first), expr(value).cast("double")
    one, two = F.when(a, x), F.when(~a, x)
    return {"n": F.count(one), "m": F.count(two), "mean1": F.avg(one), "mean2": F.avg(two), "v1": F.var_samp(one), "v2": F.var_samp(two)}


def t_test_two_pooled(df: DataFrame, first, value, groups=None) -> DataFrame:
    """Two-sample t-test with equal variances; `first` tells the first sample's rows."""
    made = df.groupBy(*names(groups)).agg(*[v.alias(k) for k, v in _halves(first, value).items()])
    dof = F.col("n") + F.col("m") - 2
    pooled = ((F.col("n") - 1) * F.col("v1") + (F.col("m") - 1) * F.col("v2")) / dof
    t = (F.col("mean1") - F.col("mean2")) / F.sqrt(pooled * (1 / F.col("n") + 1 / F.col("m")))
    return _two_sided_t(made.select(*names(groups), t.alias("statistic"), dof.cast("double").alias("degrees_of_freedom")))


def t_test_two_unpooled(df: DataFrame, first, value, groups=None) -> DataFrame:
    """Welch's t-test."""
    made = df.groupBy(*names(groups)).agg(*[v.alias(k) for k, v in _halves(first, value).items()])
    a, b = F.col("v1") / F.col("n"), F.col("v2") / F.col("m")
    dof = (a + b) * (a + b) / (a * a / (F.col("n") - 1) + b * b / (F.col("m") - 1))
    t = (F.col("mean1") - F.col("mean2")) / F.sqrt(a + b)
    return _two_sided_t(made.select(*names(groups), t.alias("statistic"), dof.alias("degrees_of_freedom")))


def f_test(df: DataFrame, first, value, groups=None) -> DataFrame:
    """F-test of equal variances; the two-sided p-value is twice the smaller tail."""
    made = df.groupBy(*names(groups)).agg(*[v.alias(k) for k, v in _halves(first, value).items()])
    out = made.select(*names(groups), (F.col("v1") / F.col("v2")).alias("statistic"), (F.col("n") - 1).cast("double").alias("df1"), (F.col("m") - 1).cast("double").alias("df2"))
    ok = (F.col("df1") > 0) & (F.col("df2") > 0)
    p = 1 - _f(F.when(ok, F.col("statistic")), F.when(ok, F.col("df1")), F.when(ok, F.col("df2")))
    return out.withColumn("p_value_one_sided", p).withColumn("p_value_two_sided", 2 * F.least(F.col("p_value_one_sided"), 1 - F.col("p_value_one_sided")))


def chi2_gof_test(df: DataFrame, observed, expected=1.0, dof: int | None = None, groups=None) -> DataFrame:
    """Goodness of fit of counts; expected values are scaled to the observed total. phi and C use the number of rows."""
    o = expr(observed).cast("double")
    e = expr(expected).cast("double") if isinstance(expected, str | Column) else F.lit(float(expected))
    made = df.groupBy(*names(groups)).agg(F.sum(o).alias("o"), F.sum(e).alias("e"), F.sum(o * o / e).alias("r"), F.count(o).alias("n"))
    out = made.select(
        *names(groups),
        (F.col("e") / F.col("o") * F.col("r") - F.col("o")).alias("statistic"),
        (F.lit(dof).cast("long") if dof is not None else F.col("n") - 1).alias("df"),
        F.col("n").alias("_n"),
    )
    ok = F.col("df") > 0
    out = out.withColumn("p_value", 1 - _chi2(F.when(ok, F.greatest(F.col("statistic"), F.lit(0.0))), F.when(ok, F.col("df").cast("double"))))
    out = out.withColumn("phi", F.sqrt(F.col("statistic") / F.col("_n"))).withColumn("contingency_coef", F.sqrt(F.col("statistic") / (F.col("_n") + F.col("statistic"))))
    return out.drop("_n")


def chi2_independence(df: DataFrame, row: str, column: str) -> DataFrame:
    """Chi-square test of independence of two columns: one row with statistic, df and p_value."""
    cells = df.groupBy(row, column).count().filter(f"`{row}` IS NOT NULL AND `{column}` IS NOT NULL")
    rows, columns = cells.groupBy(row).agg(F.sum("count").alias("r")), cells.groupBy(column).agg(F.sum("count").alias("c"))
    shape = cells.agg(F.sum("count").alias("n"), F.countDistinct(row).alias("nr"), F.countDistinct(column).alias("nc"))
    joined = cells.join(rows, row).join(columns, column).agg(F.sum(F.col("count") / F.col("r") * (F.col("count") / F.col("c"))).alias("s")).crossJoin(F.broadcast(shape))  # one row by one row
    out = joined.select((F.col("n") * (F.col("s") - 1)).alias("statistic"), ((F.col("nr") - 1) * (F.col("nc") - 1)).alias("df"))
    return out.withColumn("p_value", 1 - _chi2(F.greatest("statistic", F.lit(0.0)), F.col("df").cast("double")))


def ks_test(df: DataFrame, first, value, groups=None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test."""
    groups = names(groups)
    a, x = expr(first), expr(value).cast("double")
    rows = df.select(*groups, x.alias("x"), F.when(a, 1).otherwise(0).cast("long").alias("a"), F.when(~a, 1).otherwise(0).cast("long").alias("b")).filter("x IS NOT NULL")
    counts = rows.groupBy(*groups, "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = running(counts, "x", {"ra": F.col("a"), "rb": F.col("b")}, groups)
    totals = counts.groupBy(*groups).agg(F.sum("a").alias("n"), F.sum("b").alias("m"))
    joined = sums.join(totals, groups) if groups else sums.crossJoin(F.broadcast(totals))  # one row
    gap = F.max(F.abs(F.col("ra") / F.col("n") - F.col("rb") / F.col("m")))
    out = joined.groupBy(*groups).agg(gap.alias("statistic"), F.first("n").alias("n"), F.first("m").alias("m"))
    root = F.sqrt(F.col("n") / (F.col("n") + F.col("m")) * F.col("m"))
    out = out.withColumn("k_statistic", (root + 0.12 + 0.11 / root) * F.col("statistic"))
    return out.select(*groups, "statistic", "k_statistic", (1 - _ks(F.col("k_statistic"))).alias("p_value"))


def _normal_tails(out: DataFrame) -> DataFrame:
    return out.withColumn("p_value_one_sided", 1 - _normal(F.col("statistic"), 0.0, 1.0)).withColumn("p_value_two_sided", 2 * (1 - _normal(F.abs(F.col("statistic")), 0.0, 1.0)))


def mw_test(df: DataFrame, first, value, groups=None) -> DataFrame:
    """Mann-Whitney test: normal approximation, ties get mean ranks, the variance isn't corrected for ties."""
    groups = names(groups)
    a, x = expr(first), expr(value).cast("double")
    rows = df.select(*groups, x.alias("x"), F.when(a, 1).otherwise(0).cast("long").alias("a")).filter("x IS NOT NULL")
    counts = rows.groupBy(*groups, "x").agg(F.sum("a").alias("a"), F.count("*").alias("t"))
    sums = running(counts, "x", {"up": F.col("t")}, groups)
    rank = F.col("up") - (F.col("t") - 1) / 2
    made = sums.groupBy(*groups).agg(F.sum(rank * F.col("a")).alias("r1"), F.sum("a").alias("n"), F.sum(F.col("t") - F.col("a")).alias("m"))
    n, m = F.col("n").cast("double"), F.col("m").cast("double")  # n m (n + m + 1) of some millions of rows is beyond a long
    u1 = n * m + n * (n + 1) / 2 - F.col("r1")
    u2 = n * m - u1
    z = (u2 - n * m / 2) / F.sqrt(n * m * (n + m + 1) / 12)
    return _normal_tails(made.select(*groups, z.alias("statistic"), F.least(u1, u2).alias("u_statistic")))


def wsr_test(df: DataFrame, value, groups=None) -> DataFrame:
    """Wilcoxon signed-rank test of differences; zeros are dropped, ties of |x| get mean ranks."""
    groups = names(groups)
    x = expr(value).cast("double")
    rows = df.select(*groups, F.abs(x).alias("x"), F.when(x > 0, 1).otherwise(0).cast("long").alias("a")).filter("x IS NOT NULL AND x <> 0")
    counts = rows.groupBy(*groups, "x").agg(F.sum("a").alias("a"), F.count("*").alias("t"))
    sums = running(counts, "x", {"up": F.col("t")}, groups)
    rank = F.col("up") - (F.col("t") - 1) / 2
    made = sums.groupBy(*groups).agg(
        F.sum(rank * F.col("a")).alias("rank_sum_pos"),
        F.sum(rank * (F.col("t") - F.col("a"))).alias("rank_sum_neg"),
        F.sum("t").alias("num"),
        F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"),
    )
    n = F.col("num").cast("double")
    z = (F.col("rank_sum_pos") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    out = made.select(*groups, F.least("rank_sum_pos", "rank_sum_neg").alias("statistic_w"), "rank_sum_pos", "rank_sum_neg", "num", z.alias("statistic"))
    return _normal_tails(out).withColumnRenamed("statistic", "z_statistic").withColumnRenamed("statistic_w", "statistic")


def one_way_anova(df: DataFrame, group, value, groups=None) -> DataFrame:
    """One-way analysis of variance."""
    x = expr(value).cast("double")
    parts = df.select(*names(groups), expr(group).alias("g"), x.alias("x")).filter("x IS NOT NULL").groupBy(*names(groups), "g").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("v"))
    total = parts.groupBy(*names(groups)).agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("sq"), F.sum(F.col("n") * F.col("mean")).alias("s")
    )
    between = F.col("sq") - F.col("s") * F.col("s") / F.col("n")
    out = total.select(*names(groups), between.alias("sum_squares_between"), F.col("within").alias("sum_squares_within"), (F.col("k") - 1).cast("double").alias("df_between"), (F.col("n") - F.col("k")).cast("double").alias("df_within"))
    out = out.withColumn("mean_squares_between", F.col("sum_squares_between") / F.col("df_between")).withColumn("mean_squares_within", F.col("sum_squares_within") / F.col("df_within"))
    out = out.withColumn("statistic", F.col("mean_squares_between") / F.col("mean_squares_within"))
    ok = (F.col("df_between") > 0) & (F.col("df_within") > 0)
    return out.withColumn("p_value", 1 - _f(F.when(ok, F.col("statistic")), F.when(ok, F.col("df_between")), F.when(ok, F.col("df_within"))))
