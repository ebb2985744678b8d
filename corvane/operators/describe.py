"""Descriptive statistics: summary, profile, quantiles, correlation, frequent values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.checks import is_numeric, names, need_columns, quoted
from corvane.operators.iteration import stored
from corvane.operators.order import placed, split_points


def _stats(df: DataFrame, columns: list[str], groups: list[str], distinct: bool, quartiles: bool, ntiles: list[float], estimates: bool) -> DataFrame:
    """All aggregates of all columns in one pass, then one row for each column."""
    kinds = {f.name: f.dataType for f in df.schema}
    aggregates, structs = [], []
    points = [0.25, 0.5, 0.75] * quartiles + ntiles
    for i, name in enumerate(columns):
        c, kind = F.col(quoted(name)), kinds[name]
        number = c.cast("double") if is_numeric(kind) else None
        text = isinstance(kind, T.StringType)
        length = F.length(c).cast("double") if text else None
        values = {
            "distinct_values": F.approx_count_distinct(c) if distinct and estimates else F.lit(None).cast("long"),
            "missing_values": F.count(F.when(c.isNull(), 1)),
            "blank_values": F.count(F.when(c.rlike(r"^\W*$"), 1)) if text else F.lit(None).cast("long"),
            "mean": F.avg(number) if number is not None else F.lit(None).cast("double"),
            "variance": F.var_samp(number) if number is not None else F.lit(None).cast("double"),
            "min": F.min(number if number is not None else length if text else F.lit(None).cast("double")),
            "max": F.max(number if number is not None else length if text else F.lit(None).cast("double")),
        }
        if points:
            values["points"] = F.percentile_approx(number, points, 10000) if number is not None and estimates else F.lit(None).cast("array<double>")
        aggregates += [v.alias(f"c{i}_{k}") if k in ("distinct_values", "missing_values", "blank_values", "mean", "variance", "min", "max", "points") else v for k, v in values.items()]
        fields = [F.lit(name).alias("target_column"), F.lit(df.columns.index(name) + 1).alias("column_number"), F.lit(kind.simpleString()).alias("data_type")]
        fields += [F.col(f"c{i}_{k}").alias(k) for k in values]
        structs.append(F.struct(*fields))
    keys = [F.col(quoted(g)).alias(f"g_{k}") for k, g in enumerate(groups)]
    made = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), *aggregates)
    if distinct and not estimates:
        made = _exact_distinct(df, made, columns, keys)
    if points and not estimates:
        made = _exact_points(df, made, {i: n for i, n in enumerate(columns) if is_numeric(kinds[n])}, keys, points)
    made = made.select(*[f"g_{k}" for k in range(len(groups))], "row_count", F.explode(F.array(*structs)).alias("s"))
    out = made.select(
        F.lit(",".join(groups) or None).cast("string").alias("group_by"),
        (F.concat_ws(",", *[F.col(f"g_{k}").cast("string") for k in range(len(groups))]) if groups else F.lit(None).cast("string")).alias("group_by_value"),
        "row_count",
        "s.*",
    )
    if distinct and estimates:
        out = out.withColumn("distinct_values", F.least("distinct_values", "row_count"))
    out = out.withColumn("fraction_missing", F.col("missing_values") / F.col("row_count")).withColumn("fraction_blank", F.col("blank_values") / F.col("row_count"))
    if quartiles or ntiles:
        for k, name in enumerate(["first_quartile", "median", "third_quartile"] * quartiles):
            out = out.withColumn(name, F.get("points", F.lit(k)))
        if ntiles:
            out = out.withColumn("quantile_array", F.slice("points", 1 + 3 * quartiles, len(ntiles)))
        out = out.drop("points")
    return out


def _exact_distinct(df: DataFrame, made: DataFrame, columns: list[str], keys: list) -> DataFrame:
    """Fills in exact distinct counts: a distinct and a count for each column, rather than rows expanded for all of them."""
    own = [f"g_{k}" for k in range(len(keys))]
    for i, name in enumerate(columns):
        c = F.col(quoted(name))
        counts = df.filter(c.isNotNull()).select(*keys, c.alias("_v")).distinct().groupBy(*own).agg(F.count("*").alias("_d"))
        counts = counts.select(*[F.col(g).alias(f"_{g}") for g in own], "_d")
        same = F.lit(True)
        for g in own:
            same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
        made = made.join(counts, same, "left").withColumn(f"c{i}_distinct_values", F.coalesce("_d", F.lit(0))).drop("_d", *[f"_{g}" for g in own])
    return made


def _exact_points(df: DataFrame, made: DataFrame, columns: dict[int, str], keys: list, points: list[float]) -> DataFrame:
    """Fills in exact quantiles, between the two values next to p (n - 1): counts of ranges tell which ranges hold these, and only they are sorted."""
    own = [f"g_{k}" for k in range(len(keys))]
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(points)])
    for at, name in columns.items():
        c = F.col(quoted(name)).cast("double")
        counts = stored(df.filter(c.isNotNull()).groupBy(*keys, c.alias("_v")).agg(F.count("*").alias("_n")))
        ranged = placed(counts, F.col("_v"), split_points(counts, F.col("_v")), "_b")
        ranges = ranged.groupBy(*own, "_b").agg(F.sum("_n").alias("_size"))  # a row for each range
        ranges = ranges.withColumn("_up", F.sum("_size").over(Window.partitionBy(*own).orderBy("_b"))).withColumn("_all", F.sum("_size").over(Window.partitionBy(*own)))
        place = ranges.withColumn("_w", F.explode(wanted)).withColumn("_pos", F.col("_w.p") * (F.col("_all") - 1))
        sides = F.explode(F.array(F.struct(F.floor("_pos").alias("k"), (1 - (F.col("_pos") - F.floor("_pos"))).alias("w")), F.struct(F.ceil("_pos").alias("k"), (F.col("_pos") - F.floor("_pos")).alias("w"))))
        place = place.withColumn("_s", sides).filter((F.col("_s.k") >= F.col("_up") - F.col("_size")) & (F.col("_s.k") < F.col("_up")))
        place = place.select(*[F.col(g).alias(f"_{g}") for g in own], F.col("_b").alias("_at"), F.col("_w.i").alias("_i"), (F.col("_s.k") - F.col("_up") + F.col("_size")).alias("_k"), F.col("_s.w").alias("_share"))
        place = place.groupBy(*[f"_{g}" for g in own], "_at").agg(F.collect_list(F.struct("_i", "_k", "_share")).alias("_places"))
        same = F.col("_b") == F.col("_at")
        for g in own:
            same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
        inside = ranged.join(F.broadcast(place), same).withColumn("_to", F.sum("_n").over(Window.partitionBy(*own, "_b").orderBy("_v")))
        hit = inside.withColumn("_p", F.explode("_places")).filter((F.col("_p._k") < F.col("_to")) & (F.col("_p._k") >= F.col("_to") - F.col("_n")))
        value = hit.groupBy(*own, F.col("_p._i").alias("_i")).agg(F.sum(F.when(F.col("_p._share") == 0, 0.0).otherwise(F.col("_p._share") * F.col("_v"))).alias("_q"))
        found = value.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda e: e["_q"]).alias("_points"))
        found = found.select(*[F.col(g).alias(f"_{g}") for g in own], "_points")
        same = F.lit(True)
        for g in own:
            same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
        made = made.join(found, same, "left").withColumn(f"c{at}_points", F.col("_points")).drop("_points", *[f"_{g}" for g in own])
    return made


def frequent_values(df: DataFrame, columns: list[str], n: int, groups: list[str] = (), estimates: bool = False) -> DataFrame:
    """(group values, target_column, most_frequent_values, mfv_frequencies): the n most frequent values of each column, of equal ones the smaller.

    Columns are counted one by one; with `estimates` sketches of bounded size take the place of counts, in one pass.
    """
    keys = [F.col(quoted(g)).cast("string") for g in groups]
    group = (F.concat_ws(",", *keys) if groups else F.lit(None).cast("string")).alias("group_by_value")
    if estimates:
        tops = [F.expr(f"approx_top_k(CAST({quoted(c)} AS STRING), {n + 1})").alias(f"t{i}") for i, c in enumerate(columns)]
        found = df.groupBy(group).agg(*tops)
        cells = [F.struct(F.lit(c).alias("target_column"), F.transform(F.filter(F.col(f"t{i}"), lambda e: e["item"].isNotNull()), lambda e: F.struct((-e["count"]).alias("k"), e["item"].alias("value"), e["count"].alias("count"))).alias("l")) for i, c in enumerate(columns)]
        lists = found.select("group_by_value", F.explode(F.array(*cells)).alias("s")).select("group_by_value", "s.target_column", F.slice(F.array_sort("s.l"), 1, n).alias("l")).filter(F.size("l") > 0)
    else:
        counts = None
        for c in columns:
            part = df.select(group, F.col(quoted(c)).cast("string").alias("value")).filter("value IS NOT NULL").groupBy("group_by_value", "value").count().withColumn("target_column", F.lit(c))
            counts = part if counts is None else counts.unionByName(part)
        rank = F.row_number().over(Window.partitionBy("group_by_value", "target_column").orderBy(F.desc("count"), "value"))
        top = counts.withColumn("r", rank).filter(F.col("r") <= n)  # Spark cuts each task's groups to n before they are shuffled
        lists = top.groupBy("group_by_value", "target_column").agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), "value", "count"))).alias("l"))
    return lists.select("group_by_value", "target_column", F.col("l.value").alias("most_frequent_values"), F.col("l.count").alias("mfv_frequencies"))


def summary(df: DataFrame, target_cols=None, grouping_cols=None, get_distinct: bool = True, get_quartiles: bool = True, ntile_array: list[float] | None = None, how_many_mfv: int = 10, get_estimates: bool = True) -> DataFrame:
    """One row for each column (and value of a grouping column): counts, moments, quartiles, frequent values.

    `grouping_cols` a, b means: by a, then by b, then over all rows. min and max of a text are those of its length;
    blank is a text without a word character. Estimates use sketches for distinct values and quartiles.
    """
    columns, groups = names(target_cols) or df.columns, names(grouping_cols)
    need_columns(df, *columns, *groups)
    out = None
    for group in [*[[g] for g in groups], []]:
        wanted = [c for c in columns if c not in group]
        part = _stats(df, wanted, group, get_distinct, get_quartiles, list(ntile_array or []), get_estimates)
        if how_many_mfv:
            mfv = frequent_values(df, wanted, how_many_mfv, group, get_estimates)
            part = part.join(mfv, [part["group_by_value"].eqNullSafe(mfv["group_by_value"]), part["target_column"] == mfv["target_column"]], "left").drop(mfv["group_by_value"]).drop(mfv["target_column"])
        out = part if out is None else out.unionByName(part)
    return out


def profile(df: DataFrame, buckets: int | None = None) -> DataFrame:
    """(column_name, data_type, statistic, value) for each column; with `buckets` also histograms and frequent values."""
    kinds = {f.name: f.dataType for f in df.schema}
    pieces = []
    for name, kind in kinds.items():
        c = F.col(quoted(name))
        stats = {"count": F.count(c).cast("string"), "distinct": F.approx_count_distinct(c).cast("string")}
        if is_numeric(kind):
            stats |= {"min": F.min(c).cast("string"), "max": F.max(c).cast("string"), "avg": F.avg(c).cast("string"), "median": F.percentile_approx(c, 0.5).cast("string")}
            if buckets:
                stats["histogram"] = F.to_json(F.histogram_numeric(c.cast("double"), F.lit(buckets)))
        for k, v in stats.items():
            pieces.append((name, kind.simpleString(), k, v))
    row = df.agg(*[v.alias(f"v{i}") for i, (*_, v) in enumerate(pieces)])
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(t).alias("data_type"), F.lit(s).alias("statistic"), F.col(f"v{i}").alias("value")) for i, (n, t, s, _) in enumerate(pieces)])).alias("s")
    out = row.select(cells).select("s.*")
    if buckets:
        simple = [n for n, t in kinds.items() if not isinstance(t, T.ArrayType | T.MapType | T.StructType | T.BinaryType)]
        mfv = frequent_values(df, simple, buckets).select(F.col("target_column").alias("column_name"), F.to_json(F.map_from_arrays("most_frequent_values", "mfv_frequencies")).alias("value"))
        types = F.create_map(*[F.lit(x) for n in simple for x in (n, kinds[n].simpleString())])
        out = out.unionByName(mfv.select("column_name", types[F.col("column_name")].alias("data_type"), F.lit("mfv").alias("statistic"), "value"))
    return out


def profile_full(df: DataFrame, buckets: int = 10) -> DataFrame:
    return profile(df, buckets)


def quantile(df: DataFrame, col_name: str, q: float) -> DataFrame:
    """(quantile): between the floor(n*q)-th value and the next, by the share that n*q exceeds it.

    Places come from counts of ranges: values are narrowed to the two wanted ones without a global sort.
    """
    if not 0 < q < 1:
        raise ValueError("a quantile lies between 0 and 1")
    values = df.select(F.col(quoted(col_name)).cast("double").alias("x")).filter("x IS NOT NULL")
    n = values.count()
    k = int(n * q)
    if k < 1:
        raise ValueError("too few rows for this quantile")
    low, high = _kth(values, k), _kth(values, min(k + 1, n))
    return df.sparkSession.createDataFrame([(low + (n * q - k) * (high - low),)], "quantile double")


def _kth(values: DataFrame, k: int) -> float:
    """The k-th smallest value (from 1), by counting ranges of values and narrowing to the one that holds it."""
    low, high = values.agg(F.min("x"), F.max("x")).first()
    before = 0
    while low < high:
        width = (high - low) / 1024
        if not low < low + width < high:
            break
        bucket = F.least(F.floor((F.col("x") - low) / width), F.lit(1023)).cast("int")
        inside = values.filter((F.col("x") >= low) & (F.col("x") <= high))
        total = before
        for row in inside.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("b").toLocalIterator():
            if total + row.n >= k:
                low, high, before = row.lo, row.hi, total
                break
            total += row.n
    if low == high:
        return low
    # neighbouring doubles
    return low if values.filter((F.col("x") <= low)).count() >= k else high


quantile_big = quantile


def _pairs(df: DataFrame, columns: list[str], f) -> DataFrame:
    """Lower triangle table: column_position, variable, then a column for each variable."""
    aggregates = [f(F.col(quoted(a)).cast("double"), F.col(quoted(b)).cast("double")).alias(f"m_{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns[: i + 1])]
    filled = df.select(*[F.col(quoted(c)).cast("double").alias(c) for c in columns])
    means = filled.agg(*[F.avg(quoted(c)).alias(c) for c in columns]).first()
    row = filled.fillna({c: means[c] for c in columns if means[c] is not None}).agg(*aggregates)
    lines = [F.struct(F.lit(i + 1).alias("column_position"), F.lit(a).alias("variable"), *[(F.col(f"m_{i}_{j}") if j <= i else F.lit(None).cast("double")).alias(b) for j, b in enumerate(columns)]) for i, a in enumerate(columns)]
    return row.select(F.explode(F.array(*lines)).alias("s")).select("s.*")


def _numeric_columns(df: DataFrame, target_cols) -> list[str]:
    wanted = names(target_cols)
    need_columns(df, *wanted)
    found = [f.name for f in df.schema if is_numeric(f.dataType) and (not wanted or f.name in wanted)]
    if not found:
        raise ValueError("no numeric columns")
    return found


def correlation(df: DataFrame, target_cols=None) -> DataFrame:
    """Pearson correlations of the numeric columns; nulls are replaced by the mean."""
    return _pairs(df, _numeric_columns(df, target_cols), F.corr)


def covariance(df: DataFrame, target_cols=None) -> DataFrame:
    """Population covariances of the numeric columns; nulls are replaced by the mean."""
    return _pairs(df, _numeric_columns(df, target_cols), F.covar_pop)


def create_indicator_variables(df: DataFrame, categorical_cols, keep_null: bool = False, max_values: int = 1600) -> DataFrame:
    """The table with a 0/1 column `<col>_<value>` for each value of the given columns.

    With keep_null there is `<col>_NULL`; without, a null gives null indicators.
    """
    columns = names(categorical_cols)
    need_columns(df, *columns)
    new = []
    for name in columns:
        c = F.col(quoted(name))
        values = [r[0] for r in df.select(c).distinct().limit(max_values + 1).toLocalIterator()]
        if len(values) > max_values:
            raise ValueError(f"{name} has more than {max_values} values, a column for each of which a table can't have")
        for v in sorted(x for x in values if x is not None):
            hit = F.when(c == F.lit(v), 1).otherwise(0)
            label = str(v).lower() if isinstance(v, bool) else str(v)
            new.append((F.when(c.isNull(), F.lit(0 if keep_null else None).cast("int")).otherwise(hit)).alias(f"{name}_{label}"))
        if keep_null:
            new.append(F.when(c.isNull(), 1).otherwise(0).alias(f"{name}_NULL"))
    return df.select("*", *new)


def weighted_sample(df: DataFrame, value: str, weight: str, seed: int = 0) -> DataFrame:
    """One row, drawn in proportion to its weight; weights that aren't positive are passed over."""
    w = F.col(quoted(weight)).cast("double")
    keyed = df.filter(w > 0).select(F.col(quoted(value)), (-F.log(1 - F.rand(seed)) / w).alias("_key"))
    return keyed.agg(F.min_by(F.col(quoted(value)), F.col("_key")).alias(value))


def index_weighted_sample(weights, seed: int = 0):
    """Column: an index (from 0) of a weight vector, drawn in proportion to the weights."""
    w = F.transform(F.col(weights) if isinstance(weights, str) else weights, lambda e: F.greatest(e.cast("double"), F.lit(0.0)))
    total = F.aggregate(w, F.lit(0.0), lambda s, e: s + e)
    start = F.struct((F.rand(seed) * total).alias("left"), F.lit(-1).alias("at"), F.lit(0).alias("i"))
    done = F.aggregate(w, start, lambda s, e: F.struct((s["left"] - e).alias("left"), F.when((s["at"] < 0) & (s["left"] < e), s["i"]).otherwise(s["at"]).alias("at"), (s["i"] + 1).alias("i")))
    return done["at"]


def poisson_random(mean: float, seed: int = 0):
    """Column: Poisson deviates, by inversion of a uniform deviate."""
    from corvane.functions.prob import FUNCTIONS

    q = FUNCTIONS["poisson_quantile"](F.rand(seed), mean)
    return q.cast("int")


def gamma_random(alpha: float, seed: int = 0):
    """Column: gamma deviates of scale 1."""
    from corvane.functions.prob import FUNCTIONS

    return FUNCTIONS["gamma_quantile"](F.rand(seed), alpha, 1.0)


def bernoulli_sample(df: DataFrame, wanted: int, seed: int = 0) -> DataFrame:
    """About `wanted` rows, drawn with a margin so that seldom fewer come."""
    n = df.count()
    share = min(1.0, (wanted + 14 + (196 + 28 * wanted) ** 0.5) / n) if n else 1.0
    return df.filter(F.rand(seed) <= share)
