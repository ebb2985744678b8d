"""Registered queries of the library's own operators, with SQL where SQL can express them.

Each query takes (spark, sf_dir). Computed doubles are rounded in the query and in its SQL alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import arrays as A
from corvane.functions import metrics as ME
from corvane.functions import prob as PR
from corvane.functions import sketches as SK
from corvane.functions import stemmer as ST
from corvane.functions import svec as SV
from corvane.operators import checks as CH
from corvane.operators import cluster as CL
from corvane.operators import describe as D
from corvane.operators import factor as FA
from corvane.operators import glm as G
from corvane.operators import hypothesis as H
from corvane.operators import matrix as M
from corvane.operators import patterns as PA
from corvane.operators import penalized as PE
from corvane.operators import regress as R
from corvane.operators import sequence as SQ
from corvane.operators import series as SE
from corvane.operators import survival as SU
from corvane.operators import topics as TO
from corvane.operators import trees as TR
from corvane.plans import fits, laws, properties  # noqa: F401  (they register queries)
from corvane.plans.registry import ORACLE_SQL, QUERIES, query, rounded
from corvane.plans.registry import register as _register
from corvane.plans.registry import table as _t
from corvane.sources import pmml

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinary least squares of the price of a line on quantity and discount, by return flag."""
    return R.linregr_train(_t(spark, sf_dir, "lineitem"), "l_extendedprice", ["1", "l_quantity", "l_discount"], "l_returnflag")[0]


# arrays and metrics over the embeddings: x, and y the vector backwards

_E_SQL = "SELECT vec_id, x, list_reverse(x) AS y FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


def _vectors(spark, sf):
    e = _t(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return e.withColumn("y", F.reverse("x"))


def _scalar(name, expression, sql, digits=6):
    def f(spark, sf):
        return _vectors(spark, sf).select("vec_id", (F.round(expression(), digits) + 0.0).alias("value"))

    _register(name, f, f"SELECT vec_id, round({sql}, {digits}) + 0.0 AS value FROM ({_E_SQL})")


def _array(name, expression, sql):
    """Digest of an array result: its size, first and last element and sum."""

    def f(spark, sf):
        made = _vectors(spark, sf).select("vec_id", expression().cast("array<double>").alias("v"))
        total = F.aggregate("v", F.lit(0.0), lambda s, e: s + e)
        return made.select("vec_id", F.size("v").alias("n"), (F.round(F.col("v")[0], 6) + 0.0).alias("head"), (F.round(F.element_at("v", -1), 6) + 0.0).alias("tail"), (F.round(total, 5) + 0.0).alias("total"))

    _register(name, f, f"SELECT vec_id, len(v) AS n, round(v[1], 6) + 0.0 AS head, round(v[len(v)], 6) + 0.0 AS tail, round(list_sum(v), 5) + 0.0 AS total FROM (SELECT vec_id, {sql} AS v FROM ({_E_SQL}))")


def _pairs(body):
    return f"list_transform(list_zip(x, y), lambda z: {body})"


_SUM = "list_sum(list_transform({}, lambda e: {}))"
_array("array_add", lambda: A.array_add("x", "y"), _pairs("z[1] + z[2]"))
_array("array_sub", lambda: A.array_sub("x", "y"), _pairs("z[1] - z[2]"))
_array("array_mult", lambda: A.array_mult("x", "y"), _pairs("z[1] * z[2]"))
_array("array_div", lambda: A.array_div("x", A.array_scalar_add(A.array_abs("y"), 1.0)), _pairs("z[1] / (abs(z[2]) + 1)"))
_array("array_abs", lambda: A.array_abs("x"), "list_transform(x, lambda e: abs(e))")
_array("array_cos", lambda: A.array_cos("x"), "list_transform(x, lambda e: cos(e))")
_array("array_square", lambda: A.array_square("x"), "list_transform(x, lambda e: e * e)")
_array("array_sqrt", lambda: A.array_sqrt(A.array_abs("x")), "list_transform(x, lambda e: sqrt(abs(e)))")
_array("array_pow", lambda: A.array_pow("x", 3), "list_transform(x, lambda e: e * e * e)")
_array("array_scalar_mult", lambda: A.array_scalar_mult("x", 2.5), "list_transform(x, lambda e: e * 2.5::DOUBLE)")
_array("array_scalar_add", lambda: A.array_scalar_add("x", 0.5), "list_transform(x, lambda e: e + 0.5::DOUBLE)")
_array("array_filter", lambda: A.array_filter("x", 0.0, ">"), "list_filter(x, lambda e: e > 0)")
_array("array_fill", lambda: A.array_fill("x", 2.0), "list_transform(x, lambda e: 2.0::DOUBLE)")
_array("array_of_float", lambda: A.array_of_float(5), "list_transform(range(5), lambda e: 0.0::DOUBLE)")
_array("array_of_bigint", lambda: A.array_of_bigint(4), "list_transform(range(4), lambda e: 0.0::DOUBLE)")
_array("normalize", lambda: A.normalize("x"), "list_transform(x, lambda e: e / sqrt(list_sum(list_transform(x, lambda q: q * q))))")
_array("array_to_1d", lambda: A.array_to_1d(F.array("x", "y")), "list_concat([2.0::DOUBLE, len(x)::DOUBLE], x, y)")
_array("array_to_2d", lambda: A.get_row(A.array_to_2d(A.array_to_1d(F.array("x", "y"))), 2), "y")
_array("get_row", lambda: A.get_row(F.array("x", "y"), 2), "y")
_array("get_col", lambda: A.get_col(F.array("x", "y"), 1), "[x[1], y[1]]")
_array("matrix_column", lambda: A.matrix_column(F.array("x", "y"), 1), "x")
_array("matrix_mem_trans", lambda: A.get_row(A.matrix_mem_trans(F.array("x", "y")), 1), "[x[1], y[1]]")
_array("matrix_mem_mult", lambda: F.flatten(A.matrix_mem_mult(F.array("x"), F.array("y"), True)), f"[list_sum({_pairs('z[1] * z[2]')})]")
_array("array_max_index", lambda: A.array_max_index("x"), "[list_max(x), list_position(x, list_max(x))::DOUBLE]")
_array("array_min_index", lambda: A.array_min_index("x"), "[list_min(x), list_position(x, list_min(x))::DOUBLE]")
_array("utils_normalize_data", lambda: A.normalize_data("x", "y", A.array_fill("x", 2.0)), _pairs("(z[1] - z[2]) / 2"))
_scalar("array_dot", lambda: A.array_dot("x", "y"), f"list_sum({_pairs('z[1] * z[2]')})")
_scalar("array_sum", lambda: A.array_sum("x"), "list_sum(x)")
_scalar("array_sum_big", lambda: A.array_sum_big("x"), "list_sum(x)")
_scalar("array_abs_sum", lambda: A.array_abs_sum("x"), _SUM.format("x", "abs(e)"))
_scalar("array_mean", lambda: A.array_mean("x"), "list_avg(x)")
_scalar("array_stddev", lambda: A.array_stddev("x"), "list_stddev_samp(x)")
_scalar("array_max", lambda: A.array_max("x"), "list_max(x)")
_scalar("array_min", lambda: A.array_min("x"), "list_min(x)")
_scalar("array_contains_all", lambda: A.array_contains_all("x", A.array_mult("x", F.transform("y", lambda e: F.when(e > 0, 1.0).otherwise(0.0)))).cast("double"), "1.0::DOUBLE")
_scalar("array_contains_null", lambda: A.array_contains_null("x").cast("double"), "0.0::DOUBLE")
_scalar("norm1", lambda: ME.norm1("x"), _SUM.format("x", "abs(e)"))
_scalar("norm2", lambda: ME.norm2("x"), f"sqrt({_SUM.format('x', 'e * e')})")
_scalar("dist_norm1", lambda: ME.dist_norm1("x", "y"), f"list_sum({_pairs('abs(z[1] - z[2])')})")
_scalar("dist_norm2", lambda: ME.dist_norm2("x", "y"), "list_distance(x, y)")
_scalar("squared_dist_norm2", lambda: ME.squared_dist_norm2("x", "y"), f"list_sum({_pairs('(z[1] - z[2]) * (z[1] - z[2])')})")
_scalar("dist_inf_norm", lambda: ME.dist_inf_norm("x", "y"), f"list_max({_pairs('abs(z[1] - z[2])')})")
_scalar("dist_pnorm", lambda: ME.dist_pnorm("x", "y", 3.0), f"pow(list_sum({_pairs('pow(abs(z[1] - z[2]), 3)')}), 1.0 / 3)")
_scalar("cosine_similarity", lambda: ME.cosine_similarity("x", "y"), "list_cosine_similarity(x, y)")
_scalar("dist_angle", lambda: ME.dist_angle("x", "y"), "acos(greatest(-1, least(1, list_cosine_similarity(x, y))))", 5)
_XX, _YY, _XY = _SUM.format("x", "e * e"), _SUM.format("y", "e * e"), f"list_sum({_pairs('z[1] * z[2]')})"
_scalar("dist_tanimoto", lambda: ME.dist_tanimoto("x", "y"), f"({_XX} + {_YY} - 2 * {_XY}) / ({_XX} + {_YY} - {_XY})")
_scalar("closest_column", lambda: ME.closest_column(F.array("y", A.array_scalar_mult("x", 2.0), "x"), "x")["column_id"].cast("double"), "CASE WHEN x = y THEN 0.0 ELSE 2.0 END::DOUBLE")
_scalar("closest_columns", lambda: F.aggregate(ME.closest_columns(F.array("y", "x"), "x", 2, "dist_norm2"), F.lit(0.0), lambda s, e: s + e["distance"]), "list_distance(x, y)")
_scalar("relative_error", lambda: CH.vector_relative_error("x", "y"), f"list_distance(x, y) / sqrt({_YY})")


# sparse vectors: x and y with small integers, so that runs of equal values occur

_S_SQL = "SELECT vec_id, list_transform(x, lambda e: floor(e * 3)) AS x, list_transform(y, lambda e: floor(e * 3)) AS y FROM ({})".format(_E_SQL)


def _svec(name, expression, sql, array=True):
    def f(spark, sf):
        v = _vectors(spark, sf).select("vec_id", *[SV.from_array(F.transform(c, lambda e: F.floor(e * 3).cast("double"))).alias(c) for c in "xy"])
        if not array:
            return v.select("vec_id", (F.round(expression().cast("double"), 6) + 0.0).alias("value"))
        made = v.select("vec_id", SV.to_array(expression()).alias("v"))
        return made.select("vec_id", F.size("v").alias("n"), (F.round(F.col("v")[0], 6) + 0.0).alias("head"), (F.round(F.aggregate("v", F.lit(0.0), lambda s, e: s + e), 5) + 0.0).alias("total"))

    if array:
        _register(name, f, f"SELECT vec_id, len(v) AS n, round(v[1], 6) + 0.0 AS head, round(list_sum(v), 5) + 0.0 AS total FROM (SELECT vec_id, {sql} AS v FROM ({_S_SQL}))")
    else:
        _register(name, f, f"SELECT vec_id, round({sql}, 6) + 0.0 AS value FROM ({_S_SQL})")


_svec("svec_plus", lambda: SV.plus("x", "y"), _pairs("z[1] + z[2]"))
_svec("svec_minus", lambda: SV.minus("x", "y"), _pairs("z[1] - z[2]"))
_svec("svec_mult", lambda: SV.mult("x", "y"), _pairs("z[1] * z[2]"))
_svec("svec_div", lambda: SV.div("x", SV.plus(SV.mult("y", "y"), SV.from_scalar(F.lit(1.0)))), _pairs("z[1] / (z[2] * z[2] + 1)"))
_svec("svec_pow", lambda: SV.power("x", SV.from_scalar(F.lit(2.0))), "list_transform(x, lambda e: e * e)")
_svec("svec_concat", lambda: SV.concat("x", "y"), "list_concat(x, y)")
_svec("svec_concat_replicate", lambda: SV.replicate(2, "x"), "list_concat(x, x)")
_svec("svec_reverse", lambda: SV.reverse("x"), "y")
_svec("svec_subvec", lambda: SV.subvec("x", 2, 5), "x[2:5]")
_svec("svec_change", lambda: SV.change("x", 2, SV.subvec("y", 1, 3)), "list_concat(x[1:1], y[1:3], x[5:])")
_svec("svec_append", lambda: SV.append("x", 7.0, 3), "list_concat(x, [7.0, 7.0, 7.0])")
_svec("svec_pivot", lambda: SV.pivot("x", F.lit(4.0)), "list_concat(x, [4.0])")
_svec("svec_log", lambda: SV.log(SV.plus(SV.mult("x", "x"), SV.from_scalar(F.lit(1.0)))), "list_transform(x, lambda e: ln(e * e + 1))")
_svec("svec_lapply", lambda: SV.lapply("abs", "x"), "list_transform(x, lambda e: abs(e))")
_svec("svec_normalize", lambda: SV.normalize("x"), f"list_transform(x, lambda e: CASE WHEN {_XX} = 0 THEN e ELSE e / sqrt({_XX.replace('lambda e: e * e', 'lambda q: q * q')}) END)")
_svec("svec_count", lambda: SV.count("x", "y"), _pairs("z[1] + CASE WHEN z[2] <> 0 THEN 1 ELSE 0 END"))
_svec("svec_from_string", lambda: SV.from_string(SV.to_string("x")), "x")
_svec("svec_nonbase_values", lambda: SV.from_array(F.concat(F.array(F.lit(0.0)), SV.nonbase_values("x", 0.0))), "list_concat([0.0], list_filter(x, lambda e: e <> 0))")
_svec("svec_nonbase_positions", lambda: SV.from_array(F.concat(F.array(F.lit(0.0)), SV.nonbase_positions("x", 0.0).cast("array<double>"))), "list_concat([0.0], list_filter(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN x[i] <> 0 THEN i::DOUBLE ELSE -1 END), lambda e: e > 0))")
_svec("svec_dot", lambda: SV.dot("x", "y"), f"list_sum({_pairs('z[1] * z[2]')})", False)
_svec("svec_elsum", lambda: SV.elsum("x"), "list_sum(x)", False)
_svec("svec_l1norm", lambda: SV.l1norm("x"), _SUM.format("x", "abs(e)"), False)
_svec("svec_l2norm", lambda: SV.l2norm("x"), f"sqrt({_XX})", False)
_svec("l2norm", lambda: SV.l2norm_distance("x", "y"), "list_distance(x, y)", False)
_svec("l1norm", lambda: SV.l1norm_distance("x", "y"), f"list_sum({_pairs('abs(z[1] - z[2])')})", False)
_svec("svec_dimension", lambda: SV.dimension("x"), "len(x)", False)
_svec("svec_proj", lambda: SV.proj("x", 3), "x[3]", False)
_svec("svec_cmp", lambda: SV.compare("x", "y"), "CASE WHEN x < y THEN -1 WHEN x = y THEN 0 ELSE 1 END", False)
_svec("svec_eq", lambda: SV.eq("x", "y").cast("int"), "CASE WHEN x = y THEN 1 ELSE 0 END", False)
_svec("svec_lt", lambda: SV.lt("x", "y").cast("int"), "CASE WHEN x < y THEN 1 ELSE 0 END", False)
_svec("svec_ge", lambda: SV.ge("x", "y").cast("int"), "CASE WHEN x >= y THEN 1 ELSE 0 END", False)
_svec("svec_l2_cmp", lambda: SV.l2_compare("x", "y"), "0", False)
_svec("svec_contains", lambda: SV.contains("x", "x").cast("int"), "1", False)
_svec("svec_eq_non_zero", lambda: SV.eq_non_zero("x", "y").cast("int"), f"CASE WHEN list_sum({_pairs('CASE WHEN z[1] = 0 OR z[2] = 0 OR z[1] = z[2] THEN 0 ELSE 1 END')}) = 0 THEN 1 ELSE 0 END", False)
_svec("svec_median", lambda: SV.median("x"), "list_sort(x)[CAST(floor((len(x) + 1) / 2) AS BIGINT)]", False)
_svec("svec_tanimoto", lambda: SV.tanimoto_distance("x", "y"), f"CASE WHEN {_XX} + {_YY} = {_XY} THEN 0 ELSE 1 - {_XY} / ({_XX} + {_YY} - {_XY}) END", False)
_svec("svec_le", lambda: SV.le("x", "y").cast("int"), "CASE WHEN x <= y THEN 1 ELSE 0 END", False)
_svec("svec_gt", lambda: SV.gt("x", "y").cast("int"), "CASE WHEN x > y THEN 1 ELSE 0 END", False)
_svec("svec_ne", lambda: SV.ne("x", "y").cast("int"), "CASE WHEN x <> y THEN 1 ELSE 0 END", False)
_svec("float8arr_eq", lambda: SV.eq(SV.from_array(SV.to_array("x")), SV.from_array(SV.to_array("y"))).cast("int"), "CASE WHEN x = y THEN 1 ELSE 0 END", False)
_HEAD, _TAIL = _SUM.format("x[1:4]", "e * e"), _SUM.format("x[5:8]", "e * e")
for _name, _sign in (("lt", "<"), ("le", "<="), ("eq", "="), ("ne", "<>"), ("gt", ">"), ("ge", ">=")):
    _test = {"lt": lambda c: c < 0, "le": lambda c: c <= 0, "eq": lambda c: c == 0, "ne": lambda c: c != 0, "gt": lambda c: c > 0, "ge": lambda c: c >= 0}[_name]
    _svec(f"svec_l2_{_name}", lambda f=_test: f(SV.l2_compare(SV.subvec("x", 1, 4), SV.subvec("x", 5, 8))).cast("int"), f"CASE WHEN {_HEAD} {_sign} {_TAIL} THEN 1 ELSE 0 END", False)
for _name, _f, _sign in (("plus", SV.plus, "+"), ("minus", SV.minus, "-"), ("mult", SV.mult, "*"), ("div", SV.div, "/")):
    _second = "(z[2] * z[2] + 1)" if _name == "div" else "z[2]"
    for _left, _right in (("float8arr", "float8arr"), ("float8arr", "svec"), ("svec", "float8arr")):

        def _mixed(f=_f, left=_left, right=_right, div=_name == "div"):
            b = SV.plus(SV.mult("y", "y"), SV.from_scalar(F.lit(1.0))) if div else F.col("y")
            return f(SV.Dense(SV.to_array("x")) if left == "float8arr" else "x", SV.Dense(SV.to_array(b)) if right == "float8arr" else b)

        _svec(f"{_left}_{_name}_{_right}", _mixed, _pairs(f"z[1] {_sign} {_second}"))
for _name, _kind in (("int2", "smallint"), ("int4", "int"), ("int8", "bigint"), ("float4", "float"), ("float8", "double"), ("numeric", "decimal(20,4)")):
    _svec(f"svec_cast_{_name}", lambda k=_kind: SV.from_scalar(F.element_at(SV.to_array("x"), 2).cast(k)), "[x[2]]")
    _svec(f"float8arr_cast_{_name}", lambda k=_kind: SV.from_array(SV.to_array(SV.from_scalar(F.element_at(SV.to_array("y"), 2).cast(k)))), "[y[2]]")
_svec("svec_cast_positions_float8arr", lambda: SV.from_positions(F.array(F.lit(1), F.lit(3)), F.slice(SV.to_array("x"), 1, 2), 5, 0.0), "[x[1], 0, x[2], 0, 0]")
_svec("svec_send", lambda: SV.recv(SV.send("x")), "x")
_svec("svec_recv", lambda: SV.recv(F.encode(F.concat(F.lit("{1,2}:{"), F.element_at(SV.to_array("x"), 1).cast("string"), F.lit(",7}")), "UTF-8")), "[x[1], 7, 7]")
_svec("svec_dmin", lambda: SV.dmin(SV.proj("x", 1), SV.proj("y", 1)), "least(x[1], y[1])", False)
_svec("svec_dmax", lambda: SV.dmax(SV.proj("x", 1), SV.proj("y", 1)), "greatest(x[1], y[1])", False)
_svec("angle", lambda: F.round(SV.angle(SV.plus(SV.mult("x", "x"), SV.from_scalar(F.lit(1.0))), SV.plus(SV.mult("y", "y"), SV.from_scalar(F.lit(2.0)))), 5), "round(acos(least(1, list_cosine_similarity(list_transform(x, lambda e: e * e + 1), list_transform(y, lambda e: e * e + 2)))), 5)", False)
_svec("svec_hash", lambda: (SV.hash_("x") == SV.hash_(SV.from_array(F.reverse(SV.to_array("y"))))).cast("int"), "1", False)


def _by_vector(name, f, sql):
    def g(spark, sf):
        v = _vectors(spark, sf).select("vec_id", *[SV.from_array(F.transform(c, lambda e: F.floor(e * 3).cast("double"))).alias(c) for c in "xy"])
        return f(v.join(_t(spark, sf, "embeddings").select("vec_id", "label"), "vec_id"))

    _register(name, g, sql)


_RUNS = "list_filter(range(1, len(x) + 1), lambda i: i = 1 OR x[i] <> x[i - 1])"
_TEXT_SQL = (
    "SELECT vec_id, '{' || array_to_string(list_transform(range(1, len(s) + 1), lambda k: coalesce(s[k + 1], len(x) + 1) - s[k]), ',') || '}:{' || "
    f"array_to_string(list_transform(s, lambda i: CAST(x[i] AS BIGINT)), ',') || '}}' AS text FROM (SELECT vec_id, x, {_RUNS} AS s FROM ({_S_SQL}))"
)
_by_vector("svec_out", lambda v: v.select("vec_id", SV.to_string("x").alias("text")), _TEXT_SQL)
_by_vector("svec_to_string", lambda v: v.select("vec_id", SV.to_string(SV.from_string(SV.to_string("x"))).alias("text")), _TEXT_SQL)
_by_vector("svec_unnest", lambda v: v.select("vec_id", SV.unnest("x").alias("e")).groupBy("e").agg(F.count("*").alias("n")), f"SELECT e, count(*) AS n FROM (SELECT unnest(x) AS e FROM ({_S_SQL})) GROUP BY e")
_LABELLED = f"(SELECT label, vec_id, x, i - 1 AS p, x[i] AS e FROM ({_S_SQL}) JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id), (SELECT unnest(range(1, 9)) AS i))"
for _name, _f, _q in (("svec_sum", SV.sum_of, "sum(e)"), ("svec_mean", SV.mean_of, "avg(e)"), ("svec_count_nonzero", SV.count_nonzero, "CAST(count(*) FILTER (WHERE e <> 0) AS DOUBLE)")):
    _by_vector(_name, lambda v, f=_f: rounded(v.groupBy("label").agg(f("x", 8).alias("s")).select("label", F.posexplode(SV.to_array("s")).alias("p", "value")), 5), f"SELECT label, p, round({_q}, 5) + 0.0 AS value FROM {_LABELLED} GROUP BY label, p")
_by_vector(
    "svec_agg",
    lambda v: v.groupBy("label").agg(SV.agg_values(SV.proj("x", 1), "vec_id").alias("s")).select("label", F.posexplode(SV.to_array("s")).alias("p", "value")),
    f"SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS p, e AS value FROM {_LABELLED} WHERE p = 0",
)


@query("SELECT conv_id, turn, list_transform(['a', 'and', 'of', 'the', 'to'], lambda t: CAST(len(list_filter(string_split(lower(text), ' '), lambda w: w = t)) AS DOUBLE)) AS counts FROM conversations")
def svec_sfv(spark, sf):
    words = ["a", "and", "of", "the", "to"]
    return _t(spark, sf, "conversations").select("conv_id", "turn", SV.to_array(SV.term_counts(F.array(*map(F.lit, words)), F.split(F.lower("text"), " "))).alias("counts"))


@query("SELECT conv_id, turn, list_sort(string_split(text, ' '))[1] AS first, list_sort(string_split(text, ' '))[-1] AS last FROM conversations")
def svec_sort(spark, sf):
    w = _t(spark, sf, "conversations").select("conv_id", "turn", SV.sort_words(F.split("text", " ")).alias("w"))
    return w.select("conv_id", "turn", F.col("w")[0].alias("first"), F.element_at("w", -1).alias("last"))


# aggregates of arrays, by label

_WIDTH = 8


def _aggregate(name, expression, sql):
    def f(spark, sf):
        made = _vectors(spark, sf).join(_t(spark, sf, "embeddings").select("vec_id", "label"), "vec_id").groupBy("label").agg(expression().alias("v"))
        return made.select("label", F.posexplode("v").alias("p", "value")).select("label", "p", (F.round("value", 5) + 0.0).alias("value"))

    _register(name, f, sql)


_EL = f"(SELECT label, i - 1 AS p, CAST(embedding AS DOUBLE[])[i] AS e FROM embeddings, (SELECT unnest(range(1, {_WIDTH + 1})) AS i))"
for _name, _f, _q in [
    ("sum_arrays", A.sum_arrays, "sum(e)"), ("avg_arrays", A.avg_arrays, "avg(e)"), ("array_element_min", A.array_element_min, "min(e)"), ("array_element_max", A.array_element_max, "max(e)"),
]:
    _aggregate(_name, lambda f=_f: f("x", _WIDTH), f"SELECT label, p, round({_q}, 5) + 0.0 AS value FROM {_EL} GROUP BY label, p")
_aggregate("array_avg", lambda: A.array_avg("x", _WIDTH, True), f"SELECT label, p, round(avg(abs(e)), 5) + 0.0 AS value FROM {_EL} GROUP BY label, p")
_aggregate("utils_var_scales", lambda: A.var_scales("x", _WIDTH)["std"], f"SELECT label, p, round(stddev_pop(e), 5) + 0.0 AS value FROM {_EL} GROUP BY label, p")
_aggregate("crossprod", lambda: A.crossprod("x", "x", 2, 2), "SELECT label, p, round(v, 5) + 0.0 AS value FROM (SELECT label, unnest([sum(a * a), sum(a * b), sum(b * a), sum(b * b)]) AS v, unnest([0, 1, 2, 3]) AS p FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings) GROUP BY label)")
_aggregate("crossprod_sym", lambda: A.crossprod_sym("x", 2), "SELECT label, p, round(v, 5) + 0.0 AS value FROM (SELECT label, unnest([sum(a * a), sum(a * b), sum(b * b)]) AS v, unnest([0, 1, 2]) AS p FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings) GROUP BY label)")
_aggregate("normalized_avg", lambda: A.normalized_avg("x", _WIDTH), f"SELECT label, p, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 5) + 0.0 AS value FROM (SELECT label, i - 1 AS p, avg(x[i] / sqrt({_XX})) AS m FROM (SELECT label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), (SELECT unnest(range(1, 9)) AS i) GROUP BY label, i)")
_aggregate("array_elem_corr_agg", lambda: A.array_elem_corr("x", F.col("vec_id"), _WIDTH), f"SELECT label, p, round(corr(e, vec_id), 5) + 0.0 AS value FROM (SELECT label, vec_id, i - 1 AS p, CAST(embedding AS DOUBLE[])[i] AS e FROM embeddings, (SELECT unnest(range(1, 9)) AS i)) GROUP BY label, p")
_aggregate("array_union", lambda: A.array_union(F.slice("x", 1, 2), "vec_id"), "SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS p, round(CAST(embedding AS DOUBLE[])[i], 5) + 0.0 AS value FROM embeddings, (SELECT unnest([1, 2]) AS i)")
_aggregate("array_agg", lambda: F.array_sort(A.array_agg(F.col("x")[0])), "SELECT label, row_number() OVER (PARTITION BY label ORDER BY e) - 1 AS p, round(e, 5) + 0.0 AS value FROM (SELECT label, CAST(embedding AS DOUBLE[])[1] AS e FROM embeddings)")
_aggregate("matrix_agg", lambda: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", F.slice("x", 1, 2).alias("v")))), lambda e: e["v"])), "SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS p, round(CAST(embedding AS DOUBLE[])[i], 5) + 0.0 AS value FROM embeddings, (SELECT unnest([1, 2]) AS i)")


@query(f"SELECT vec_id, round(unnest([x[1], y[1]]), 6) AS head FROM ({_E_SQL})")
def deconstruct_2d_array(spark, sf):
    return rounded(_vectors(spark, sf).select("vec_id", A.deconstruct_2d_array(F.array("x", "y")).alias("row")).select("vec_id", F.col("row")[0].alias("head")), 6)


_array("index_2d_array", lambda: A.index_2d_array(F.array("x", "y"), 2), "y")


@query("SELECT vec_id, '[1:2, 3:' || vec_id || ']' AS text FROM embeddings")
def array_collapse(spark, sf):
    return _vectors(spark, sf).select("vec_id", A.array_collapse(F.array(F.array(F.lit("1"), F.lit("2")), F.array(F.lit("3"), F.col("vec_id").cast("string")))).alias("text"))


@query("SELECT a.conv_id, a.turn, round(1 - len(list_intersect(a.w, b.w)) * 1.0::DOUBLE / len(list_distinct(list_concat(a.w, b.w))), 6) AS distance FROM (SELECT conv_id, turn, list_distinct(string_split(text, ' ')) AS w FROM conversations) a JOIN (SELECT conv_id, turn, list_distinct(string_split(text, ' ')) AS w FROM conversations) b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn")
def dist_jaccard(spark, sf):
    c = _t(spark, sf, "conversations").select("conv_id", "turn", F.split("text", " ").alias("w"))
    later = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return rounded(c.join(later, ["conv_id", "turn"]).select("conv_id", "turn", ME.dist_jaccard("w", "v").alias("distance")), 6)


@query("SELECT vec_id, array_to_string(list_transform(range(1, 33), lambda i: '0123456789ABCDEF'[1 + ((strpos('0123456789abcdef', a[i]) - 1) | (strpos('0123456789abcdef', b[i]) - 1))]), '') AS bits FROM (SELECT vec_id, md5(CAST(vec_id AS VARCHAR)) AS a, md5(CAST(vec_id + 1 AS VARCHAR)) AS b FROM embeddings)")
def big_or(spark, sf):
    bits = lambda c: F.unhex(F.md5(c.cast("string")))
    v = _t(spark, sf, "embeddings").select("vec_id", bits(F.col("vec_id")).alias("a"), bits(F.col("vec_id") + 1).alias("b"))
    return v.select("vec_id", F.hex(SK.big_or("a", "b")).alias("bits"))


@query("SELECT vec_id, isnan(CASE WHEN vec_id % 3 = 0 THEN 'NaN'::DOUBLE ELSE vec_id END) AS nan FROM embeddings")
def isnan(spark, sf):
    return _t(spark, sf, "embeddings").select("vec_id", F.isnan(F.when(F.col("vec_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("vec_id").cast("double"))).alias("nan"))


# descriptive statistics


@query("SELECT label, round(avg(vec_id), 4) AS mean_id, count(*) AS n FROM embeddings GROUP BY label")
def group_means(spark, sf):
    return rounded(_t(spark, sf, "embeddings").groupBy("label").agg(F.avg("vec_id").alias("mean_id"), F.count("*").alias("n")))


_SUMMARY_SQL = " UNION ALL ".join(
    f"SELECT {g1} AS group_by, {g2} AS group_by_value, count(*) AS row_count, '{c}' AS target_column, count(DISTINCT {c}) AS distinct_values, count(*) - count({c}) AS missing_values, "
    f"round(avg({c}), 4) AS mean, round(var_samp({c}), 4) AS variance, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(quantile_cont({c}, 0.25), 4) AS first_quartile, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS third_quartile FROM lineitem {tail}"
    for c in ("l_quantity", "l_extendedprice", "l_tax")
    for g1, g2, tail in (("'l_returnflag'", "l_returnflag", "GROUP BY l_returnflag"), ("NULL", "NULL", ""))
)


@query(_SUMMARY_SQL)
def summary(spark, sf):
    out = D.summary(_t(spark, sf, "lineitem"), "l_quantity,l_extendedprice,l_tax", "l_returnflag", get_estimates=False, how_many_mfv=0)
    return rounded(out.select("group_by", "group_by_value", "row_count", "target_column", "distinct_values", "missing_values", "mean", "variance", "min", "max", "first_quartile", "median", "third_quartile"))


@query()
def summary_estimates(spark, sf):
    return D.summary(_t(spark, sf, "lineitem"), None, "l_returnflag", ntile_array=[0.1, 0.9])


@query("SELECT 'l_linenumber' AS target_column, list(CAST(v AS VARCHAR) ORDER BY n DESC, v)[1:3] AS most_frequent_values, list(n ORDER BY n DESC, v)[1:3] AS mfv_frequencies FROM (SELECT l_linenumber AS v, count(*) AS n FROM lineitem GROUP BY 1)")
def most_frequent_values(spark, sf):
    return D.frequent_values(_t(spark, sf, "lineitem"), ["l_linenumber"], 3).select("target_column", "most_frequent_values", "mfv_frequencies")


@query()
def profile(spark, sf):
    return D.profile(_t(spark, sf, "orders"))


_ORDER_COLUMNS = {"o_orderkey": 0, "o_custkey": 0, "o_totalprice": 2}


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS count, round(min({c}), 2) AS min, round(max({c}), 2) AS max, round(avg({c}), 2) AS avg FROM orders" for c in _ORDER_COLUMNS))
def profile_of_numbers(spark, sf):
    p = D.profile(_t(spark, sf, "orders").select(*_ORDER_COLUMNS))
    value = lambda s: F.max(F.when(F.col("statistic") == s, F.col("value"))).cast("double")
    return rounded(p.groupBy("column_name").agg(value("count").cast("long").alias("count"), *[value(s).alias(s) for s in ("min", "max", "avg")]), 2)


@query()
def profile_full(spark, sf):
    return D.profile_full(_t(spark, sf, "supplier"), 5)


_Q_SQL = "SELECT round(a[k] + (n * {q} - k) * (a[k + 1] - a[k]), 4) AS quantile FROM (SELECT list(l_extendedprice ORDER BY l_extendedprice) AS a, count(*) AS n, CAST(floor(count(*) * {q}) AS BIGINT) AS k FROM lineitem)"


@query(_Q_SQL.format(q="0.3::DOUBLE"))
def quantile(spark, sf):
    return rounded(D.quantile(_t(spark, sf, "lineitem"), "l_extendedprice", 0.3))


@query(_Q_SQL.format(q="0.9::DOUBLE"))
def quantile_big(spark, sf):
    return rounded(D.quantile_big(_t(spark, sf, "lineitem"), "l_extendedprice", 0.9))


def _triangle(f):
    cols = ["l_quantity", "l_discount", "l_tax"]
    cell = lambda i, j: f"round({f}({cols[i]}, {cols[j]}), 6)" if j <= i else "NULL"
    return " UNION ALL ".join(f"SELECT {i + 1} AS column_position, '{a}' AS variable, " + ", ".join(f"{cell(i, j)} AS {b}" for j, b in enumerate(cols)) + " FROM lineitem" for i, a in enumerate(cols))


@query(_triangle("corr"))
def correlation(spark, sf):
    return rounded(D.correlation(_t(spark, sf, "lineitem"), "l_quantity,l_discount,l_tax"), 6)


@query(_triangle("covar_pop"))
def covariance(spark, sf):
    return rounded(D.covariance(_t(spark, sf, "lineitem"), "l_quantity,l_discount,l_tax"), 6)


@query("SELECT l_orderkey, l_linenumber, l_returnflag, " + ", ".join(f"CASE WHEN l_returnflag = '{v}' THEN 1 ELSE 0 END AS \"l_returnflag_{v}\"" for v in "ANR") + ' , CASE WHEN l_returnflag IS NULL THEN 1 ELSE 0 END AS "l_returnflag_NULL" FROM lineitem')
def create_indicator_variables(spark, sf):
    return D.create_indicator_variables(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", True)


@query("SELECT l_returnflag, min(l_linenumber) AS mode FROM (SELECT l_returnflag, l_linenumber, count(*) AS n, max(count(*)) OVER (PARTITION BY l_returnflag) AS m FROM lineitem GROUP BY 1, 2) WHERE n = m GROUP BY 1")
def mode(spark, sf):
    return _t(spark, sf, "lineitem").groupBy("l_returnflag").agg(CH.mode("l_linenumber").alias("mode"))


@query()
def weighted_sample(spark, sf):
    return D.weighted_sample(_t(spark, sf, "lineitem"), "l_orderkey", "l_quantity", 3)


@query()
def index_weighted_sample(spark, sf):
    return spark.range(1000).select(D.index_weighted_sample(F.array(F.lit(1.0), F.lit(2.0), F.lit(0.0)), 5).alias("i")).groupBy("i").count()


@query()
def poisson_random(spark, sf):
    return spark.range(1000).select(D.poisson_random(2.0, 1).alias("x")).groupBy("x").count()


@query()
def gamma_random(spark, sf):
    return spark.range(100).select("id", D.gamma_random(2.0, 1).alias("x"))


@query("SELECT count(DISTINCT l_linenumber) AS dcount FROM lineitem")
def fmsketch_dcount(spark, sf):
    return SK.exact_or_approx_dcount(_t(spark, sf, "lineitem"), "l_linenumber")


@query("SELECT l_linenumber AS value, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def mfvsketch_top_histogram(spark, sf):
    return SK.mfvsketch_top_histogram(_t(spark, sf, "lineitem"), "l_linenumber", 3)


@query("SELECT l_linenumber AS value, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def mfvsketch_quick_histogram(spark, sf):
    return SK.mfvsketch_quick_histogram(_t(spark, sf, "lineitem"), "l_linenumber", 3)


@query("SELECT count(*) FILTER (WHERE l_linenumber = 3) AS point, count(*) FILTER (WHERE l_linenumber BETWEEN 2 AND 5) AS between_2_5, (SELECT list(l_linenumber ORDER BY l_linenumber)[CAST(ceil(count(*) / 2) AS BIGINT)] FROM lineitem) AS median FROM lineitem")
def cmsketch(spark, sf):
    li = _t(spark, sf, "lineitem")
    s = SK._load(SK.cmsketch(li, "l_linenumber"))
    return spark.createDataFrame([(SK.cmsketch_count(s, 3), SK.cmsketch_rangecount(s, 2, 5), SK.cmsketch_median(s, li.count()))], "point long, between_2_5 long, median int")


def _sketch(name, kind, f, sql):
    _register(name, lambda spark, sf: spark.createDataFrame([(f(SK.cmsketch(_t(spark, sf, "lineitem"), "l_linenumber"), _t(spark, sf, "lineitem").count()),)], f"value {kind}"), sql)


_sketch("cmsketch_count", "long", lambda s, n: SK.cmsketch_count(s, 4), "SELECT count(*) AS value FROM lineitem WHERE l_linenumber = 4")
_sketch("cmsketch_rangecount", "long", lambda s, n: SK.cmsketch_rangecount(s, 3, 6), "SELECT count(*) AS value FROM lineitem WHERE l_linenumber BETWEEN 3 AND 6")
_sketch("cmsketch_centile", "int", lambda s, n: SK.cmsketch_centile(s, 80, n), "SELECT list(l_linenumber ORDER BY l_linenumber)[CAST(ceil(count(*) * 0.8) AS BIGINT)] AS value FROM lineitem")
_sketch("cmsketch_median", "int", lambda s, n: SK.cmsketch_median(s, n), "SELECT list(l_linenumber ORDER BY l_linenumber)[CAST(ceil(count(*) * 0.5) AS BIGINT)] AS value FROM lineitem")


@query("SELECT lo, lo AS hi, (SELECT count(*) FROM lineitem WHERE l_linenumber = lo) AS count FROM (SELECT unnest(range(1, 8)) AS lo)")
def cmsketch_width_histogram(spark, sf):
    return spark.createDataFrame(SK.cmsketch_width_histogram(SK.cmsketch(_t(spark, sf, "lineitem"), "l_linenumber"), 1, 7, 7), "lo long, hi long, count long")


@query()
def cmsketch_depth_histogram(spark, sf):
    return spark.createDataFrame(SK.cmsketch_depth_histogram(SK.cmsketch(_t(spark, sf, "lineitem"), "l_linenumber"), 4), "lo long, hi long, count long")


# hypothesis tests

_HALF = "SELECT count(*) FILTER (WHERE a) AS n, count(*) FILTER (WHERE NOT a) AS m, avg(x) FILTER (WHERE a) AS p, avg(x) FILTER (WHERE NOT a) AS q, var_samp(x) FILTER (WHERE a) AS v, var_samp(x) FILTER (WHERE NOT a) AS w FROM (SELECT l_returnflag = 'A' AS a, l_quantity AS x FROM lineitem)"


def _stat(df):
    return rounded(df.select("statistic"), 5)


@query("SELECT round(avg(x) / sqrt(var_samp(x) / count(x)), 5) AS statistic FROM (SELECT l_quantity - 25.5 AS x FROM lineitem)")
def t_test_one(spark, sf):
    return _stat(H.t_test_one(_t(spark, sf, "lineitem"), "l_quantity - 25.5"))


@query(f"SELECT round((p - q) / sqrt(((n - 1) * v + (m - 1) * w) / (n + m - 2) * (1.0::DOUBLE / n + 1.0::DOUBLE / m)), 5) AS statistic FROM ({_HALF})")
def t_test_two_pooled(spark, sf):
    return _stat(H.t_test_two_pooled(_t(spark, sf, "lineitem"), "l_returnflag = 'A'", "l_quantity"))


@query(f"SELECT round((p - q) / sqrt(v / n + w / m), 5) AS statistic FROM ({_HALF})")
def t_test_two_unpooled(spark, sf):
    return _stat(H.t_test_two_unpooled(_t(spark, sf, "lineitem"), "l_returnflag = 'A'", "l_quantity"))


@query(f"SELECT round(v / w, 5) AS statistic FROM ({_HALF})")
def f_test(spark, sf):
    return _stat(H.f_test(_t(spark, sf, "lineitem"), "l_returnflag = 'A'", "l_quantity"))


@query("SELECT round(sum((o - e) * (o - e) / e), 5) AS statistic, count(*) - 1 AS df FROM (SELECT count(*) AS o, sum(count(*)) OVER () * 1.0::DOUBLE / count(*) OVER () AS e FROM lineitem GROUP BY l_linenumber)")
def chi2_gof_test(spark, sf):
    return rounded(H.chi2_gof_test(_t(spark, sf, "lineitem").groupBy("l_linenumber").count(), "count").select("statistic", "df"), 5)


@query("WITH c AS (SELECT l_returnflag r, l_linestatus s, count(*) o FROM lineitem GROUP BY 1, 2), t AS (SELECT o, sum(o) OVER (PARTITION BY r) * sum(o) OVER (PARTITION BY s) * 1.0::DOUBLE / sum(o) OVER () AS e FROM c) SELECT round(sum((o - e) * (o - e) / e), 5) AS statistic, (SELECT (count(DISTINCT r) - 1) * (count(DISTINCT s) - 1) FROM c) AS df FROM t")
def chi2_independence(spark, sf):
    return rounded(H.chi2_independence(_t(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").select("statistic", "df"), 5)


@query("WITH v AS (SELECT l_quantity x, count(*) FILTER (WHERE l_returnflag = 'A') a, count(*) FILTER (WHERE l_returnflag <> 'A') b FROM lineitem GROUP BY 1) SELECT round(max(abs(ra / n - rb / m)), 5) AS statistic FROM (SELECT sum(a) OVER (ORDER BY x) * 1.0::DOUBLE AS ra, sum(b) OVER (ORDER BY x) * 1.0::DOUBLE AS rb, sum(a) OVER () AS n, sum(b) OVER () AS m FROM v)")
def ks_test(spark, sf):
    return _stat(H.ks_test(_t(spark, sf, "lineitem"), "l_returnflag = 'A'", "l_quantity"))


@query("WITH r AS (SELECT l_returnflag = 'A' AS a, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS k FROM lineitem), s AS (SELECT sum(k) FILTER (WHERE a) AS r1, CAST(count(*) FILTER (WHERE a) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE NOT a) AS DOUBLE) AS m FROM r) SELECT round(((r1 - n * (n + 1) / 2) - n * m / 2) / sqrt(n * m * (n + m + 1) / 12), 5) AS statistic FROM s")
def mw_test(spark, sf):
    return _stat(H.mw_test(_t(spark, sf, "lineitem"), "l_returnflag = 'A'", "l_quantity"))


@query("WITH d AS (SELECT l_quantity - 25 AS x FROM lineitem WHERE l_quantity <> 25), r AS (SELECT x, rank() OVER (ORDER BY abs(x)) + (count(*) OVER (PARTITION BY abs(x)) - 1) / 2.0::DOUBLE AS k FROM d) SELECT round(least(sum(k) FILTER (WHERE x > 0), sum(k) FILTER (WHERE x < 0)), 1) AS statistic, count(*) AS num FROM r")
def wsr_test(spark, sf):
    return rounded(H.wsr_test(_t(spark, sf, "lineitem"), "l_quantity - 25").select("statistic", "num"), 1)


@query("WITH g AS (SELECT l_linenumber, count(*) n, avg(l_quantity) m, var_pop(l_quantity) v FROM lineitem GROUP BY 1), t AS (SELECT avg(l_quantity) AS a FROM lineitem) SELECT round((sum(n * (m - a) * (m - a)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 5) AS statistic FROM g, t")
def one_way_anova(spark, sf):
    return _stat(H.one_way_anova(_t(spark, sf, "lineitem"), "l_linenumber", "l_quantity"))


# matrices: total quantity by supplier class and line number

_M_SQL = "SELECT l_suppkey % 7 + 1 AS r, l_linenumber AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2"


def _matrix(spark, sf):
    return _t(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 7 + 1).cast("long").alias("row_id"), F.col("l_linenumber").cast("long").alias("col_id")).agg(F.sum("l_quantity").alias("val"))


def _entries(df, digits=3):
    return rounded(M.entries(df), digits)


def _mq(name, f, sql, entries=True):
    _register(name, (lambda spark, sf: _entries(f(_matrix(spark, sf)))) if entries else (lambda spark, sf: rounded(f(_matrix(spark, sf)), 3)), sql)


_ENT = f"SELECT r AS row_id, c AS col_id, round(v, 3) AS val FROM ({_M_SQL})"
_mq("matrix_trans", M.trans, f"SELECT c AS row_id, r AS col_id, round(v, 3) AS val FROM ({_M_SQL})")
_mq("matrix_add", lambda m: M.add(m, M.trans(M.trans(m))), f"SELECT r AS row_id, c AS col_id, round(2 * v, 3) AS val FROM ({_M_SQL})")
_mq("matrix_sub", lambda m: M.sub(M.scalar_mult(m, 3.0), m), f"SELECT r AS row_id, c AS col_id, round(2 * v, 3) AS val FROM ({_M_SQL})")
_mq("matrix_scale_and_add", lambda m: M.scale_and_add(m, m, 0.5), f"SELECT r AS row_id, c AS col_id, round(1.5 * v, 3) AS val FROM ({_M_SQL})")
_mq("matrix_elem_mult", lambda m: M.elem_mult(m, m), f"SELECT r AS row_id, c AS col_id, round(v * v, 3) AS val FROM ({_M_SQL})")
_mq("matrix_scalar_mult", lambda m: M.scalar_mult(m, 3.0), f"SELECT r AS row_id, c AS col_id, round(3 * v, 3) AS val FROM ({_M_SQL})")
_PRODUCT = f"SELECT a.r AS row_id, b.r AS col_id, round(sum(a.v * b.v), 3) AS val FROM ({_M_SQL}) a JOIN ({_M_SQL}) b ON a.c = b.c GROUP BY 1, 2"
_mq("matrix_mult", lambda m: M.mult(m, m, trans_b=True), _PRODUCT)
_mq("matrix_square", M.square, _PRODUCT)
_mq("matrix_mult_dense", lambda m: M.mult(M.densify(m), M.densify(m), trans_b=True), _PRODUCT)
_mq("matrix_block_mult", lambda m: M.unblockize(M.block_mult(M.blockize(m, 3, 2), M.block_trans(M.blockize(m, 3, 2)))), _PRODUCT)
_mq("matrix_block_square", lambda m: M.unblockize(M.block_square(M.blockize(m, 3, 2))), _PRODUCT)
_mq("matrix_block_trans", lambda m: M.unblockize(M.block_trans(M.blockize(m, 3, 2))), f"SELECT c AS row_id, r AS col_id, round(v, 3) AS val FROM ({_M_SQL})")
_mq("matrix_blockize", lambda m: M.unblockize(M.blockize(m, 2, 3)), _ENT)
_mq("matrix_densify", lambda m: M.densify(m), _ENT)
_mq("matrix_sparsify", lambda m: M.sparsify(M.densify(m)), _ENT)
_mq("matrix_sum", lambda m: M.sum_(m, 1), f"SELECT c AS col_id, round(sum(v), 3) AS val FROM ({_M_SQL}) GROUP BY 1", False)
_mq("matrix_mean", lambda m: M.mean(m, 2), f"SELECT r AS row_id, round(sum(v) / 7, 3) AS val FROM ({_M_SQL}) GROUP BY 1", False)
_mq("matrix_max", lambda m: M.max_(m, 1), f"SELECT c AS col_id, round(max(v), 3) AS val FROM ({_M_SQL}) GROUP BY 1", False)
_mq("matrix_min", lambda m: M.min_(m, 2), f"SELECT r AS row_id, round(min(v), 3) AS val FROM ({_M_SQL}) GROUP BY 1", False)
_mq("matrix_vec_mult", lambda m: M.vec_mult(m, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]), f"SELECT r AS row_id, round(sum(v * c), 3) AS val FROM ({_M_SQL}) GROUP BY 1", False)
_mq("matrix_extract_row", lambda m: M.extract_row(m, 2), f"SELECT c AS col_id, round(v, 3) AS val FROM ({_M_SQL}) WHERE r = 2", False)
_mq("matrix_extract_col", lambda m: M.extract_col(m, 2), f"SELECT r AS row_id, round(v, 3) AS val FROM ({_M_SQL}) WHERE c = 2", False)
_mq("matrix_extract_diag", M.extract_diag, f"SELECT r AS row_id, round(v, 3) AS val FROM ({_M_SQL}) WHERE r = c", False)
_mq("matrix_ndims", M.ndims_table, f"SELECT max(r) AS rows, max(c) AS cols FROM ({_M_SQL})", False)
_NORMS = ["one", "inf", "max", "fro", "3"]
_register(
    "matrix_norm",
    lambda spark, sf: rounded(spark.createDataFrame([tuple(M.norm(_matrix(spark, sf), k) for k in _NORMS)], "one double, inf double, max double, fro double, p3 double"), 2),
    f"WITH m AS ({_M_SQL}) SELECT (SELECT round(max(s), 2) FROM (SELECT sum(abs(v)) s FROM m GROUP BY c)) AS one, (SELECT round(max(s), 2) FROM (SELECT sum(abs(v)) s FROM m GROUP BY r)) AS inf, round(max(abs(v)), 2) AS max, round(sqrt(sum(v * v)), 2) AS fro, round(pow(sum(pow(abs(v), 3)), 1.0::DOUBLE / 3), 2) AS p3 FROM m",
)
_register("matrix_identity", lambda spark, sf: M.identity(spark, 4), "SELECT i AS row_id, i AS col_id, 1.0::DOUBLE AS val FROM (SELECT unnest(range(1, 5)) AS i)")
_register("matrix_diag", lambda spark, sf: M.diag(spark, [3.0, 2.0]), "SELECT 1 AS row_id, 1 AS col_id, 3.0::DOUBLE AS val UNION ALL SELECT 2, 2, 2.0")
_register("matrix_ones", lambda spark, sf: M.entries(M.ones(spark, 2, 2)), "SELECT r AS row_id, c AS col_id, 1.0::DOUBLE AS val FROM (SELECT unnest([1, 2]) AS r), (SELECT unnest([1, 2]) AS c)")
_register("matrix_zeros", lambda spark, sf: M.entries(M.zeros(spark, 2, 2)), "SELECT r AS row_id, c AS col_id, 0.0::DOUBLE AS val FROM (SELECT unnest([1, 2]) AS r), (SELECT unnest([1, 2]) AS c)")
_register("matrix_random", lambda spark, sf: M.random(spark, 5, 3, "uniform", 1), None)


# regressions

_X = ["1", "l_quantity / 50", "l_discount"]


def _with_class(spark, sf):
    return _t(spark, sf, "lineitem").withColumn("hi", F.col("l_extendedprice") > 35000).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


@query("SELECT l_returnflag, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem GROUP BY 1")
def linregr_train(spark, sf):
    m = R.linregr_train(_t(spark, sf, "lineitem"), "l_extendedprice", ["1", "l_quantity"], "l_returnflag")[0]
    return m.select("l_returnflag", F.round(F.col("coef")[0], 3).alias("intercept"), F.round(F.col("coef")[1], 3).alias("slope"), F.round("r2", 6).alias("r2"), F.col("num_rows_processed").alias("n"))


@query("SELECT l_orderkey, l_linenumber, round(2 + 3 * l_quantity, 4) AS prediction FROM lineitem")
def linregr_predict(spark, sf):
    return rounded(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", R.linregr_predict([2.0, 3.0], F.array(F.lit(1.0), "l_quantity")).alias("prediction")))


@query("SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(-2 + 0.1::DOUBLE * l_quantity))), 6) AS prob, -2 + 0.1::DOUBLE * l_quantity >= 0 AS predicted FROM lineitem")
def logregr_predict(spark, sf):
    x = F.array(F.lit(1.0), "l_quantity")
    return rounded(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", R.logregr_predict_prob([-2.0, 0.1], x).alias("prob"), R.logregr_predict([-2.0, 0.1], x).alias("predicted")), 6)


_rows = {
    "logregr_train_igd": lambda s, f: R.logregr_train(_with_class(s, f), "hi", _X, None, 10, "igd")[0],
    "elastic_net_binomial": lambda s, f: PE.elastic_net_train(_with_class(s, f), "hi", ["l_quantity", "l_discount"], "binomial", 0.5, 0.01, max_iter=10),
    "svm_classification": lambda s, f: PE.svm_classification(_with_class(s, f), "hi", _X, params="max_iter=8"),
    "svm_classification_gaussian": lambda s, f: PE.svm_classification(_with_class(s, f), "hi", _X, "gaussian", "gamma=1.0,n_components=8", params="max_iter=5"),
    "svm_regression": lambda s, f: PE.svm_regression(_t(s, f, "lineitem"), "l_linenumber", _X, params="max_iter=8"),
    "svm_predict": lambda s, f: PE.svm_predict(PE.svm_classification(_with_class(s, f), "hi", _X, params="max_iter=4"), _with_class(s, f), "id", _X),
    "lmf_igd_run": lambda s, f: FA.lmf(_t(s, f, "lineitem"), "l_orderkey", "l_suppkey", "l_quantity", 3, 3)["rmse"],
    "tree_train": lambda s, f: TR.tree_train(_t(s, f, "lineitem"), "l_returnflag", _F, max_depth=3, cp=0.0, max_surrogates=1),
    "tree_train_grouped": lambda s, f: TR.tree_train(_t(s, f, "lineitem"), "l_extendedprice", ["l_quantity", "l_tax"], groups="l_returnflag", max_depth=2, cp=0.001),
    "tree_predict": lambda s, f: TR.tree_predict(TR.tree_train(_with_class(s, f), "l_returnflag", _F, max_depth=3, cp=0.0), _with_class(s, f), "id", "prob"),
    "tree_display": lambda s, f: s.createDataFrame([(TR.tree_display(TR.tree_train(_t(s, f, "lineitem"), "l_linestatus", _F[:2], max_depth=2, cp=0.0), True),)], "dot string"),
    "tree_surr_display": lambda s, f: s.createDataFrame([(TR.tree_surr_display(TR.tree_train(_t(s, f, "lineitem"), "l_linestatus", _F[:2], max_depth=2, cp=0.0, max_surrogates=1)),)], "text string"),
    "forest_train": lambda s, f: _forest(s, f)["summary"],
    "forest_importance": lambda s, f: _forest(s, f)["importance"],
    "forest_predict": lambda s, f: TR.forest_predict(_forest(s, f), _with_class(s, f), "id"),
    "get_tree": lambda s, f: s.createDataFrame([(TR.get_tree(_forest(s, f), 1),)], "text string"),
    "c45_train": lambda s, f: TR.c45_train(_t(s, f, "lineitem"), _F[:2], "l_linestatus", "gainratio", 2),
    "c45_classify": lambda s, f: TR.c45_classify(TR.c45_train(_with_class(s, f), _F[:2], "l_linestatus", max_depth=2), _with_class(s, f), "id"),
    "c45_score": lambda s, f: TR.c45_score(TR.c45_train(_with_class(s, f), _F[:2], "l_linestatus", max_depth=2), _with_class(s, f), "id", "l_linestatus"),
    "c45_genrule": lambda s, f: s.createDataFrame([(r,) for r in TR.c45_genrule(TR.c45_train(_t(s, f, "lineitem"), _F, "l_linestatus", max_depth=2))], "rule string"),
    "rf_score": lambda s, f: TR.rf_score(TR.rf_train(_with_class(s, f), _F, "l_returnflag", 2, max_depth=2), _with_class(s, f), "id", "l_returnflag"),
    "arima_train": lambda s, f: SE.arima_train(_revenue(s, f), "o_orderdate", "v", orders=(1, 1, 1))["model"],
    "arima_residual": lambda s, f: SE.arima_train(_revenue(s, f), "o_orderdate", "v", include_mean=True, orders=(2, 0, 0))["residual"],
    "arima_forecast": lambda s, f: SE.arima_forecast(SE.arima_train(_revenue(s, f), "o_orderdate", "v", orders=(1, 1, 1))["model"], 5),
    "lda_get_topic_desc": lambda s, f: _described(*_lda(s, f)),
    "lda_get_perplexity": lambda s, f: s.createDataFrame([(TO.lda_perplexity(**_lda(s, f)[0]),)], "perplexity double"),
    "lincrf_train": lambda s, f: _crf(s, f)["stats"],
    "vcrf_label": lambda s, f: SQ.vcrf_label(SQ.crf_test_fgen(_segments(s, f).drop("label"), SQ.dictionary(_segments(s, f)), _regexes(s)), _crf(s, f)["weights"], _labels(s)),
    "pmml": lambda s, f: s.createDataFrame([(pmml.regression(flagship(s, f)),)], "pmml string"),
    "pmml_tree": lambda s, f: s.createDataFrame([(pmml.tree(TR.tree_train(_t(s, f, "lineitem"), "l_linestatus", _F[:2], max_depth=2, cp=0.0), "l_linestatus"),)], "pmml string"),
    "pmml_glm": lambda s, f: s.createDataFrame([(pmml.glm(G.glm(_t(s, f, "lineitem"), "l_linenumber", _X, "poisson"), "poisson", "log"),)], "pmml string"),
    "cross_validation": lambda s, f: PA.cross_validation(_t(s, f, "lineitem").select("l_extendedprice", "l_quantity"), lambda d, v: R.linregr_train(d, "l_extendedprice", ["1", f"pow(l_quantity, {v})"])[0].select("coef", F.lit(v).alias("v")).first(), lambda m, d: d.select("l_extendedprice", R.linregr_predict(m.coef, F.array(F.lit(1.0), F.pow("l_quantity", F.lit(m.v)))).alias("p")), lambda t: PA.mse_error(t, "p", "l_extendedprice").first()[0], [1, 2], 2),
}
_F = ["l_quantity", "l_extendedprice", "l_linenumber"]
for _name, _f in _rows.items():
    _register(_name, _f, None)


def _forest(spark, sf):
    return TR.forest_train(_with_class(spark, sf), "l_returnflag", _F, num_trees=3, max_depth=3)


def _revenue(spark, sf):
    return _t(spark, sf, "orders").groupBy("o_orderdate").agg(F.sum("o_totalprice").alias("v"))


def _words(spark, sf):
    return _t(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.split(F.lower("text"), r"\s+").alias("w")))), lambda e: e["w"])).alias("w"))


def _lda_words(spark, sf):
    return PA.term_frequency(_words(spark, sf), "doc_id", "w", True)


def _lda(spark, sf):
    counts, vocabulary = _lda_words(spark, sf)
    return TO.lda_train(counts, vocabulary.count(), 3, 1, 0.1, 0.1, doc="doc_id"), counts, vocabulary


def _described(trained, counts, vocabulary):
    return TO.lda_topic_desc(trained["model"], vocabulary, 3)


def _predicted(trained, counts, vocabulary):
    return _assigned(TO.lda_predict(counts, trained["model"], 2, doc="doc_id"))


def _segments(spark, sf):
    """The words of the benchmark's items, labelled by their length."""
    w = _t(spark, sf, "benchmark").select(F.col("item_id").cast("int").alias("doc_id"), F.split("text", r"\s+").alias("w"))
    w = w.select("doc_id", F.posexplode("w").alias("start_pos", "seg_text"), (F.size("w") - 1).alias("max_pos"))
    return w.withColumn("label", F.least(F.length("seg_text") / 3, F.lit(3)).cast("int"))


def _regexes(spark):
    return spark.createDataFrame([("^[A-Z]", "InitCap"), ("[.,]$", "Stop")], "pattern string, name string")


def _labels(spark):
    return spark.createDataFrame([(i, f"L{i}") for i in range(4)], "id int, label string")


def _crf(spark, sf):
    made = SQ.crf_train_fgen(_segments(spark, sf), _regexes(spark))
    return SQ.lincrf_train(made["features"], made["featureset"], 4, 3)


def _bayes(spark, sf):
    return _with_class(spark, sf).select("id", "l_returnflag", F.array("l_linestatus", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("string")).alias("a"))


_TOKENS = r"SELECT conv_id, unnest(string_split_regex(lower(text), '\s+')) AS word FROM conversations"
_TOPICS = f"SELECT conv_id AS docid, count(*) AS wordcount, count(*) AS assigned FROM ({_TOKENS}) GROUP BY 1"


def _assigned(docs):
    return docs.select("docid", F.col("wordcount").cast("long").alias("wordcount"), F.aggregate("topic_count", F.lit(0).cast("long"), lambda s, e: s + e).alias("assigned"))


_register("lda_train", lambda spark, sf: _assigned(_lda(spark, sf)[0]["output"]), _TOPICS)
_register("lda_predict", lambda spark, sf: _predicted(*_lda(spark, sf)), _TOPICS)
_register(
    "lda_get_word_topic_count",
    lambda spark, sf: TO.lda_word_topic_count(spark, _lda(spark, sf)[0]["model"]).select(F.col("wordid").cast("long").alias("wordid"), F.aggregate("topic_count", F.lit(0).cast("long"), lambda s, e: s + e).alias("n")),
    f"SELECT row_number() OVER (ORDER BY word) - 1 AS wordid, count(*) AS n FROM ({_TOKENS}) GROUP BY word",
)
_register(
    "lda_parse_model",
    lambda spark, sf: TO.lda_parse_model(spark, _lda(spark, sf)[0]["model"]).agg(F.count("*").alias("words"), F.sum(F.aggregate("topic_count", F.lit(0).cast("long"), lambda s, e: s + e)).alias("n")),
    f"SELECT count(DISTINCT word) AS words, count(*) AS n FROM ({_TOKENS})",
)
_register(
    "lda_get_topic_word_count",
    lambda spark, sf: TO.lda_topic_word_count(spark, _lda(spark, sf)[0]["model"]).select(F.posexplode("word_count").alias("wordid", "n")).groupBy("wordid").agg(F.sum("n").alias("n")).select(F.col("wordid").cast("long").alias("wordid"), "n"),
    f"SELECT row_number() OVER (ORDER BY word) - 1 AS wordid, count(*) AS n FROM ({_TOKENS}) GROUP BY word",
)
_register(
    "crf_train_fgen",
    lambda spark, sf: SQ.crf_train_fgen(_segments(spark, sf), _regexes(spark))["featureset"].select("f_name", F.col("prev_label").cast("long").alias("prev_label"), F.col("label").cast("long").alias("label"), "n", F.col("f_index").cast("long").alias("f_index")),
    r"""
WITH s AS (SELECT item_id AS d, unnest(w) AS seg, generate_subscripts(w, 1) - 1 AS p, len(w) - 1 AS last FROM (SELECT item_id, string_split_regex(text, '\s+') AS w FROM benchmark)),
t AS (SELECT *, CASE WHEN regexp_full_match(seg, '[0-9]+') THEN 'DIGIT' ELSE lower(seg) END AS token, CAST(least(floor(len(seg) / 3), 3) AS BIGINT) AS label FROM s),
u AS (SELECT *, lag(label) OVER (PARTITION BY d ORDER BY p) AS prev, count(*) OVER (PARTITION BY token) AS total FROM t),
f AS (
    SELECT 'E.' AS f_name, prev AS prev_label, label FROM u WHERE prev IS NOT NULL UNION ALL SELECT 'S.', -1, label FROM u WHERE p = 0 UNION ALL SELECT 'End.', -1, label FROM u WHERE p = last
    UNION ALL SELECT 'W_' || token, -1, label FROM u UNION ALL SELECT 'U', -1, label FROM u WHERE total <= 1
    UNION ALL SELECT 'R_InitCap', -1, label FROM u WHERE regexp_matches(seg, '^[A-Z]') UNION ALL SELECT 'R_Stop', -1, label FROM u WHERE regexp_matches(seg, '[.,]$')
)
SELECT f_name, prev_label, label, count(*) AS n, row_number() OVER (ORDER BY f_name, prev_label, label) - 1 AS f_index FROM f GROUP BY f_name, prev_label, label
""",
)
_register("stem_token_arr", lambda spark, sf: _t(spark, sf, "documents").select("doc_id", F.size(ST.stem_token_arr(F.split(F.lower("text"), r"\s+"))).alias("n")), r"SELECT doc_id, len(string_split_regex(lower(text), '\s+')) AS n FROM documents")
_register(
    "doc_vectors",
    lambda spark, sf: PA.doc_vectors(_lda_words(spark, sf)[1], "wordid", "word", _words(spark, sf).select("doc_id", F.explode("w").alias("word")), "doc_id", "word").select("doc_id", SV.l1norm("sparse_vector").alias("n"), F.size(SV.nonbase_values("sparse_vector", 0.0)).alias("distinct")),
    f"SELECT conv_id AS doc_id, CAST(count(*) AS DOUBLE) AS n, count(DISTINCT word) AS distinct FROM ({_TOKENS}) GROUP BY 1",
)


# patterns, sets, terms


@query("""
WITH s AS (SELECT user_id, string_agg(CASE WHEN event_type = 'click' THEN 'a' WHEN event_type = 'view' THEN 'b' ELSE '~' END, '' ORDER BY ts, event_id) AS line FROM events GROUP BY 1),
m AS (SELECT user_id, regexp_extract(line, '^(.*)(ab+)', 1) AS head, line FROM s WHERE regexp_matches(line, 'ab+'))
SELECT user_id, len(regexp_extract(line[len(head) + 1:], '^ab+', 0)) AS n FROM m
""")
def path(spark, sf):
    return PA.path(_t(spark, sf, "events"), "user_id", "ts, event_id", "(A)(B)+", {"A": "event_type = 'click'", "B": "event_type = 'view'"}, ["count(*) AS n"])


@query("SELECT o.l_suppkey % 5 AS pre, p.l_suppkey % 5 AS post, count(DISTINCT o.l_orderkey) AS count, round(count(DISTINCT o.l_orderkey) * 1.0::DOUBLE / (SELECT count(DISTINCT l_orderkey) FROM lineitem), 6) AS support FROM lineitem o JOIN lineitem p ON o.l_orderkey = p.l_orderkey AND o.l_suppkey % 5 <> p.l_suppkey % 5 GROUP BY 1, 2")
def assoc_rules(spark, sf):
    li = _t(spark, sf, "lineitem").withColumn("item", F.col("l_suppkey") % 5)
    r = PA.assoc_rules(li, "l_orderkey", "item", 0.000001, 0.0, 2)
    return rounded(r.select(F.col("pre")[0].cast("long").alias("pre"), F.col("post")[0].cast("long").alias("post"), "count", "support"), 6)


@query("SELECT l_returnflag AS class, 1 AS attr, l_linestatus AS value, count(*) AS cnt FROM lineitem GROUP BY 1, 3 UNION ALL SELECT l_returnflag, 2, CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 1, 3")
def create_nb_prepared_data_tables(spark, sf):
    return PA.nb_train(_bayes(spark, sf), "l_returnflag", "a", [3])["feature_probs"].select("class", "attr", "value", "cnt")


@query("SELECT l_returnflag, list(l_linenumber ORDER BY l_linenumber) AS l_linenumber FROM (SELECT l_returnflag, l_linenumber, sum(l_quantity) AS q, max(sum(l_quantity)) OVER (PARTITION BY l_returnflag) AS m FROM lineitem GROUP BY 1, 2) WHERE q = m GROUP BY 1")
def argmax(spark, sf):
    q = _t(spark, sf, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    return PA.argmax(q, ["l_returnflag"], "l_linenumber", "q")


@query("SELECT doc_id, word, count(*) AS count FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY 1, 2")
def term_frequency(spark, sf):
    return PA.term_frequency(_t(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("w")), "doc_id", "w")


@query("SELECT row_number() OVER (ORDER BY word) - 1 AS wordid, word FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM benchmark)")
def vocabulary(spark, sf):
    return PA.term_frequency(_t(spark, sf, "benchmark").select("item_id", F.split("text", " ").alias("w")), "item_id", "w", True)[1]


@query("SELECT f AS _fold, n // 7 + CASE WHEN f < n % 7 THEN 1 ELSE 0 END AS count FROM (SELECT count(*) AS n FROM lineitem), (SELECT unnest(range(7)) AS f)")
def cv_folds(spark, sf):
    return PA.folds(_t(spark, sf, "lineitem"), 7, 1).groupBy("_fold").count()


@query("SELECT round(avg((l_tax - l_discount) * (l_tax - l_discount)), 8) AS mean_squared_error FROM lineitem")
def mse_error(spark, sf):
    return rounded(PA.mse_error(_t(spark, sf, "lineitem"), "l_tax", "l_discount"), 8)


@query("SELECT round(avg(CASE WHEN l_returnflag = 'A' THEN 0.0 ELSE 1.0 END), 6) AS avg_misclassification FROM lineitem")
def misclassification_avg(spark, sf):
    return rounded(PA.misclassification_avg(_t(spark, sf, "lineitem").withColumn("p", F.lit("A")), "p", "l_returnflag"), 6)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 10 THEN 't' ELSE 'f' END AS v FROM lineitem")
def bool_to_text(spark, sf):
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", CH.bool_to_text("l_quantity > 10").alias("v"))


@query("SELECT l_returnflag, p, round(value, 6) AS value FROM (SELECT l_returnflag, unnest(range(7)) AS p, unnest([" + ", ".join(f"sum(CASE WHEN l_linenumber = {i} THEN l_quantity ELSE 0 END) / sum(CASE WHEN l_linenumber < 7 THEN l_quantity ELSE 0 END)" for i in range(7)) + "]) AS value FROM lineitem GROUP BY 1)")
def discrete_distribution_agg(spark, sf):
    d = _t(spark, sf, "lineitem").groupBy("l_returnflag").agg(A.discrete_distribution("l_linenumber", "l_quantity", 7).alias("d"))
    return rounded(d.select("l_returnflag", F.posexplode("d").alias("p", "value")), 6)


@query("SELECT p, q, CASE WHEN p = 0 THEN (SELECT count(*) FROM lineitem WHERE l_linenumber = q) ELSE (SELECT count(*) FROM lineitem WHERE l_suppkey % 3 = q) END AS n FROM (SELECT unnest([0, 0, 0, 1, 1, 1]) AS p, unnest([0, 1, 2, 0, 1, 2]) AS q)")
def vectorized_distribution_agg(spark, sf):
    x = _t(spark, sf, "lineitem").select(F.array("l_linenumber", (F.col("l_suppkey") % 3).cast("int")).alias("x"))
    d = x.agg(A.vectorized_distribution("x", [3, 3]).alias("d")).select(F.posexplode("d").alias("p", "r"))
    return d.select("p", F.posexplode("r").alias("q", "n"))


# probability distributions: closed forms against their formulas

_P = "SELECT DISTINCT l_quantity / 10 AS x FROM lineitem"
_U = "SELECT DISTINCT l_quantity / 51 AS x FROM lineitem"


def _law(name, args, sql, source="x"):
    def f(spark, sf):
        d = _t(spark, sf, "lineitem").select((F.col("l_quantity") / (10 if source == "x" else 51)).alias("x")).distinct()
        return rounded(d.select(F.round("x", 6).alias("x"), PR.FUNCTIONS[name](F.col("x"), *args).alias("p")), 6)

    _register(f"prob_{name}", f, f"SELECT round(x, 6) AS x, round({sql}, 6) AS p FROM ({_P if source == 'x' else _U})" if sql else None)


_law("exponential_cdf", (0.5,), "1 - exp(-0.5::DOUBLE * x)")
_law("exponential_pdf", (0.5,), "0.5::DOUBLE * exp(-0.5::DOUBLE * x)")
_law("exponential_quantile", (0.5,), "-ln(1 - x) / 0.5::DOUBLE", "u")
_law("cauchy_cdf", (1.0, 2.0), "0.5::DOUBLE + atan((x - 1) / 2) / pi()")
_law("cauchy_pdf", (1.0, 2.0), "1 / (pi() * 2 * (1 + (x - 1) * (x - 1) / 4))")
_law("logistic_cdf", (1.0, 2.0), "1 / (1 + exp(-(x - 1) / 2))")
_law("logistic_quantile", (1.0, 2.0), "1 + 2 * ln(x / (1 - x))", "u")
_law("laplace_cdf", (1.0, 2.0), "CASE WHEN x < 1 THEN 0.5::DOUBLE * exp((x - 1) / 2) ELSE 1 - 0.5::DOUBLE * exp(-(x - 1) / 2) END")
_law("laplace_pdf", (1.0, 2.0), "exp(-abs(x - 1) / 2) / 4")
_law("extreme_value_cdf", (1.0, 2.0), "exp(-exp((1 - x) / 2))")
_law("extreme_value_quantile", (1.0, 2.0), "1 - 2 * ln(-ln(x))", "u")
_law("pareto_cdf", (1.0, 2.0), "CASE WHEN x <= 1 THEN 0 ELSE 1 - pow(1 / x, 2) END")
_law("rayleigh_cdf", (2.0,), "1 - exp(-x * x / 8)")
_law("rayleigh_pdf", (2.0,), "x / 4 * exp(-x * x / 8)")
_law("uniform_cdf", (1.0, 4.0), "least(1, greatest(0, (x - 1) / 3))")
_law("uniform_quantile", (1.0, 4.0), "1 + 3 * x", "u")
_law("weibull_cdf", (1.5, 2.0), "1 - exp(-pow(x / 2, 1.5))")
_law("triangular_cdf", (1.0, 2.0, 4.0), "CASE WHEN x <= 1 THEN 0 WHEN x <= 2 THEN (x - 1) * (x - 1) / 3 WHEN x < 4 THEN 1 - (4 - x) * (4 - x) / 6 ELSE 1 END")
_law("bernoulli_cdf", (0.3,), "CASE WHEN x < 1 THEN 0.7 ELSE 1.0 END")
_law("geometric_cdf", (0.3,), "1 - pow(0.7::DOUBLE, floor(x) + 1)")
_law("normal_pdf", (1.0, 2.0), "exp(-(x - 1) * (x - 1) / 8) / (2 * sqrt(2 * pi()))")
_law("chi_squared_cdf", (2.0,), "1 - exp(-x / 2)")
_law("gamma_cdf", (1.0, 2.0), "1 - exp(-x / 2)")
_law("students_t_cdf", (1.0,), "0.5::DOUBLE + atan(x) / pi()")
_law("beta_cdf", (1.0, 3.0), "1 - pow(1 - x, 3)", "u")
_law("fisher_f_cdf", (2.0, 4.0), "1 - pow(1 + x / 2, -2)")
for _name in sorted(PR.FUNCTIONS):
    if f"prob_{_name}" not in QUERIES:
        _n = {"hypergeometric": (5, 10, 30), "non_central_beta": (2.0, 3.0, 1.0), "non_central_f": (3.0, 8.0, 1.0), "triangular": (1.0, 2.0, 4.0), "kolmogorov": (), "bernoulli": (0.4,), "binomial": (10, 0.4), "negative_binomial": (3.0, 0.4)}
        _family = _name.rpartition("_")[0]
        _one = ("chi_squared", "exponential", "geometric", "poisson", "rayleigh", "students_t")
        _args = _n.get(_family, ((0.4,) if _family == "geometric" else (3.0,)) if _family in _one else (1.0, 2.0))
        _unit = _name.endswith("quantile") or "beta" in _family
        _law(_name, _args, None, "u" if _unit else "x")
        if _name in laws.SQL:
            ORACLE_SQL[f"prob_{_name}"] = laws.SQL[_name]


# relational forms that generated SQL of such libraries relies on


@query("SELECT o_orderkey, coalesce(n, 0) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON o_orderkey = l_orderkey")
def left_outer_counts(spark, sf):
    n = _t(spark, sf, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return _t(spark, sf, "orders").select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def anti_join(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey").join(_t(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def group_by_each(spark, sf):
    _t(spark, sf, "lineitem").createOrReplaceTempView("corvane_temp_lineitem")
    return spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS n FROM corvane_temp_lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")


@query("SELECT DISTINCT l_suppkey FROM lineitem EXCEPT SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0")
def set_difference(spark, sf):
    return _t(spark, sf, "lineitem").select("l_suppkey").subtract(_t(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select("s_suppkey"))
