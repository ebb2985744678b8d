"""Cox proportional hazards (Breslow ties), its variances, and the test of proportional hazards.

Risk-set sums are running sums over falling time. Rows are put once into time ranges of about RANGE_CELLS numbers
each; a time of very many rows is a range of its own. A pass adds up every range, and the ranges' suffix totals, a
row a range on the driver, turn the sums into risk-set sums. Rows of one time share theirs, so ranges of a single
time need no more than these totals, however many rows they have; the others are sorted range by range. Strata are
ranges of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.prob import evaluate
from corvane.operators.checks import complete, expr, features, names, options, quoted
from corvane.operators.estimate import floats, group_sums, model_frame, plain, sym_pinv, to_numpy, width_of
from corvane.operators.iteration import cut, stored
from corvane.operators.order import placed, running, split_points
from corvane.operators.regress import _dot, _ratio, _z_two

#: Numbers that the features of a range's rows are; a time of an eighth as many is a range of its own.
RANGE_CELLS = 1 << 19
#: Features up to which a range's sums are plain aggregates.
PLAIN = 16


@dataclass
class _Ranges:
    """Rows (_t, _x, _d, _s: stratum as text, _r: range; higher ranges have later times), ranges of a single time, features."""

    rows: DataFrame
    single: frozenset
    k: int

    def ones(self) -> DataFrame:
        return self.rows.filter(F.col("_r").isin(list(self.single)))

    def others(self, *columns: str) -> DataFrame | None:
        """Rows of ranges of more than one time."""
        rows = self.rows.filter(~F.col("_r").isin(list(self.single))) if self.single else self.rows
        rows = rows.select("_s", "_r", "_t", "_x", "_d", *columns)
        return None if self.single and rows.limit(1).isEmpty() else rows


def _ranged(df: DataFrame, time: str, x, status, strata: list[str], more: dict | None = None) -> _Ranges:
    s = F.concat_ws("\x01", *[expr(c).cast("string") for c in strata]) if strata else F.lit("")
    d = F.lit(True) if status is None else expr(status)
    rows = df.select((expr(time).cast("double") + 0.0).alias("_t"), features(df, x).alias("_x"), d.cast("boolean").alias("_d"), s.alias("_s"), *[expr(e).cast("string").alias(n) for n, e in (more or {}).items()])
    rows = rows.filter(complete(F.col("_t"), F.col("_x")) & F.col("_d").isNotNull())
    k = width_of(rows, F.col("_x"))
    size = max(8, RANGE_CELLS // max(1, k))
    crowded = [r._t for r in rows.groupBy("_t").count().filter(F.col("count") > size // 8).select("_t").toLocalIterator() if np.isfinite(r._t)]
    cuts = sorted({c + 0.0 for c in split_points(rows, F.col("_t"), size) if np.isfinite(c)} | {float(c) for t in crowded for c in (t, np.nextafter(t, np.inf)) if np.isfinite(c)})
    at = {c: i + 1 for i, c in enumerate(cuts)}
    same = F.when(F.size("_x") == k, F.col("_x")).otherwise(F.raise_error(F.lit("feature arrays differ in length")))
    rows = stored(placed(rows.withColumn("_x", same), F.col("_t"), cuts, "_r"))
    return _Ranges(rows, frozenset(at[t] for t in crowded if float(np.nextafter(t, np.inf)) in at), k)


def _sums(ranges: _Ranges, coef: np.ndarray, second: bool = True) -> dict:
    """For each stratum and range the sums of e, x e, of events and their x, (and x x' e)."""
    k = ranges.k
    low = np.tril_indices(k)
    if k <= PLAIN:
        x = [F.col("_x")[i] for i in range(k)]
        e, d = _hazard(coef), F.col("_d").cast("double")
        terms = [e, *[c * e for c in x], d, *[c * d for c in x], *([x[i] * x[j] * e for i, j in zip(*low)] if second else [])]
        made = ranges.rows.groupBy("_s", "_r").agg(*[F.sum(v).alias(f"v{i}") for i, v in enumerate(terms)])
        found = {(r[0], r[1]): np.array(r[2:], float) for r in made.toLocalIterator()}
    else:

        def kernel(key, a):
            e = np.exp(a["x"] @ coef)
            xe = a["x"] * e[:, None]
            return np.concatenate(([e.sum()], xe.sum(0), [a["d"].sum()], a["d"] @ a["x"], (xe.T @ a["x"])[low] if second else []))

        found = group_sums(ranges.rows, ["_s", "_r"], {"x": F.col("_x"), "d": F.col("_d").cast("double")}, kernel)
    if not second:
        return found
    out = {}
    for key, v in found.items():
        square = np.zeros((k, k))
        square[low] = v[2 + 2 * k :]
        out[key] = np.concatenate((v[: 2 + 2 * k], (square + np.tril(square, -1).T).ravel()))
    return out


def _hazard(coef: np.ndarray) -> Column:
    return F.exp(sum((F.col("_x")[i] * float(c) for i, c in enumerate(coef)), F.lit(0.0)))


def _running(values: dict, later: bool) -> dict:
    """For each stratum and range the totals of the ranges before it, or with `later` of those after it."""
    by: dict = {}
    for s, r in values:
        by.setdefault(s, []).append(r)
    out = {}
    for s, held in by.items():
        total = 0.0
        for r in sorted(held, reverse=later):
            out[(s, r)] = total + np.zeros_like(values[(s, r)])
            total = total + values[(s, r)]
    return out


class _Risk:
    """A range's rows by falling time, with risk-set sums of e and x e that include ties."""

    def __init__(self, table: pa.Table, coef: np.ndarray, later: np.ndarray):
        k = len(coef)
        t, x, d = (to_numpy(table[c].combine_chunks()) for c in ("_t", "_x", "_d"))
        self.order = np.argsort(-t, kind="stable")
        self.t, self.x, self.d = t[self.order], x[self.order], d[self.order].astype(bool)
        self.e = np.exp(self.x @ coef)
        last = np.searchsorted(-self.t, -self.t, side="right") - 1  # ties share the sums of their last row
        self.s0 = (later[0] + np.cumsum(self.e))[last]
        self.s1 = (later[1 : 1 + k] + np.cumsum(self.x * self.e[:, None], 0))[last]

    def up(self, v: np.ndarray) -> np.ndarray:
        """Running sums over rising time that include ties."""
        asc = self.t[::-1]
        return np.cumsum(v[::-1], 0)[np.searchsorted(asc, asc, side="right") - 1][::-1]


def _by_range(rows: DataFrame, coef: np.ndarray, later: dict, run: Callable, schema: str) -> DataFrame:
    """run(stratum, range, risk sets, rows) of each range, a row for each or many."""
    shared = rows.sparkSession.sparkContext.broadcast(later)

    def call(key: tuple, table: pa.Table) -> pa.Table:
        s, r = (v.as_py() for v in key)
        return run(s, r, _Risk(table, coef, shared.value[(s, r)]), table)

    return rows.groupBy("_s", "_r").applyInArrow(call, schema)


def _vectors(rows: np.ndarray) -> pa.Array:
    """A matrix as a column of lists."""
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32) if rows.size else np.zeros(len(rows) + 1, np.int32), np.ascontiguousarray(rows, float).ravel())


def _step(ranges: _Ranges, coef: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    k = ranges.k
    sums = _sums(ranges, coef)
    later = _running(sums, True)
    ll, g, h = 0.0, np.zeros(k), np.zeros((k, k))
    for key, v in sums.items():
        n, nx = v[1 + k], v[2 + k : 2 + 2 * k]
        if key[1] in ranges.single and n:
            at = v + later[key]
            m = at[1 : 1 + k] / at[0]
            ll += nx @ coef - n * np.log(at[0])
            g += nx - n * m
            h += n * (at[2 + 2 * k :].reshape(k, k) / at[0] - np.outer(m, m))
    rows = ranges.others()
    if rows is None:
        return ll, g, h
    squares = {key: v[2 + 2 * k :] for key, v in later.items()}
    shared = rows.sparkSession.sparkContext.broadcast(squares)

    def run(s, r, risk: _Risk, table):
        d, x = risk.d, risk.x
        one = np.where(d, 1 / risk.s0, 0)
        m = risk.s1[d] / risk.s0[d, None]
        # of an event's x x' e over its risk set: each row counts for the events up to its time
        own = (x * (risk.e * risk.up(one))[:, None]).T @ x + one.sum() * shared.value[(s, r)].reshape(k, k)
        out = np.concatenate(([(x[d] @ coef - np.log(risk.s0[d])).sum()], (x[d] - m).sum(0), (own - m.T @ m).ravel()))
        return pa.table({"v": _vectors(out[None])})

    first = {key: v[: 1 + k] for key, v in later.items()}
    made = _by_range(rows, coef, first, run, "v array<double>")
    s = np.array(made.agg(*[F.sum(F.col("v")[i]) for i in range(1 + k + k * k)]).first(), float)
    return ll + s[0], g + s[1 : 1 + k], h + s[1 + k :].reshape(k, k)


def coxph_train(df: DataFrame, time: str, x, status: str | None = None, strata=None, optimizer_params=None) -> DataFrame:
    """coef, loglikelihood, std_err, z_stats, p_values, hessian, num_iterations: Newton's method with step halving."""
    opt = options(optimizer_params, {"max_iter": 100, "optimizer": "newton", "tolerance": 1e-8})
    return _cox_table(df, *_cox_fit(_ranged(df, time, x, status, names(strata)), opt))


def _cox_fit(ranges, opt):
    coef, before, i = np.zeros(ranges.k), None, 0
    step = np.zeros(ranges.k)
    for i in range(1, opt["max_iter"] + 1):
        ll, g, h = _step(ranges, coef)
        if before is not None and not ll >= before - 1e-12 * abs(before):  # halve the step
            step = step / 2
            coef = coef - step
            continue
        if before is not None and abs(1 - ll / before if before else ll) <= opt["tolerance"]:
            break
        before = ll
        step = sym_pinv(h)[0] @ g
        coef = coef + step
    return coef, ll, h, i


def _cox_table(df, coef, ll, h, i):
    se = np.sqrt(np.maximum(np.diag(sym_pinv(h)[0]), 0))
    z = _ratio(coef, se)
    row = {"_key": (), "coef": floats(coef), "loglikelihood": float(ll), "std_err": floats(se), "z_stats": floats(z), "p_values": floats(_z_two(z)), "hessian": [floats(r) for r in h], "num_iterations": i}
    return model_frame(df, [], [row], "coef array<double>, loglikelihood double, std_err array<double>, z_stats array<double>, p_values array<double>, hessian array<array<double>>, num_iterations int")


def cox_prop_hazards(df: DataFrame, time: str, x, status: str | None = None) -> DataFrame:
    """The older interface of coxph_train."""
    return coxph_train(df, time, x, status)


def coxph_predict(model: DataFrame, df: DataFrame, id_col: str, x, kind: str = "linear_predictors", reference: list[float] | None = None) -> DataFrame:
    """(id, prediction): linear predictors, risk, or terms (an array), against reference values (the means as a rule)."""
    coef = model.first().coef
    xc = features(df, x)
    if reference is None:
        reference = df.select(xc.alias("x")).agg(*[F.avg(F.col("x")[i]) for i in range(len(coef))]).first()
    centred = F.zip_with(xc, F.array(*[F.lit(float(v)) for v in reference]), lambda a, b: a - b)
    eta = _dot(coef, centred)
    value = {"linear_predictors": eta, "risk": F.exp(eta), "terms": F.zip_with(centred, F.array(*[F.lit(float(c)) for c in coef]), lambda a, b: a * b)}[kind]
    return df.select(F.col(quoted(id_col)), value.alias("prediction"))


def _means(ranges: _Ranges, values: dict) -> DataFrame:
    """(_s, _r, v): a vector for each range of a single time."""
    data = [(*key, v.tolist()) for key, v in values.items() if key[1] in ranges.single]
    return F.broadcast(ranges.rows.sparkSession.createDataFrame(data, "_s string, _r int, v array<double>"))  # a row for each range


def _residual_sums(ranges: _Ranges, coef, cluster: bool):
    """Score residuals of all rows: sums of outer products, by cluster if there are any."""
    k = ranges.k
    sums = _sums(ranges, coef, False)
    later = _running(sums, True)
    rows = ranges.others(*["_c"] if cluster else [])
    base, means = {}, {}  # sums of 1/S0 and S1/S0^2 over events
    for key, v in sums.items():
        if key[1] in ranges.single:
            at = v + later[key]
            means[key] = at[1 : 1 + k] / at[0]
            base[key] = v[1 + k] / at[0] * np.concatenate(([1.0], means[key]))
    if rows is not None:

        def baseline(s, r, risk: _Risk, table):
            one = np.where(risk.d, 1 / risk.s0, 0)
            return pa.table({"_s": pa.array([s]), "_r": pa.array([r], pa.int32()), "v": _vectors(np.concatenate(([one.sum()], (one / risk.s0) @ risk.s1))[None])})

        for r in _by_range(rows, coef, later, baseline, "_s string, _r int, v array<double>").toLocalIterator():
            base[(r._s, r._r)] = np.array(r.v)
    earlier = _running(base, False)
    made = None
    if means:
        at = ranges.ones().join(_means(ranges, {key: np.concatenate((m, earlier[key] + base[key])) for key, m in means.items()}), ["_s", "_r"])
        x, v, d = (lambda i: F.col("_x")[i]), (lambda i: F.col("v")[i]), F.col("_d").cast("double")
        u = F.array(*[d * (x(i) - v(i)) - F.col("_e") * (x(i) * v(k) - v(k + 1 + i)) for i in range(k)])
        made = at.withColumn("_e", _hazard(coef)).select(*["_c"] if cluster else [], u.alias("u"))
    if rows is not None:
        shared = rows.sparkSession.sparkContext.broadcast(earlier)

        def scores(s, r, risk: _Risk, table):
            one = np.where(risk.d, 1 / risk.s0, 0)
            before = shared.value[(s, r)]
            ca, cb = before[0] + risk.up(one), before[1:] + risk.up(one[:, None] * risk.s1 / risk.s0[:, None])
            u = risk.d[:, None] * (risk.x - risk.s1 / risk.s0[:, None]) - risk.e[:, None] * (risk.x * ca[:, None] - cb)
            return pa.table({"_c": table["_c"].take(risk.order), "u": _vectors(u)} if cluster else {"u": _vectors(u)})

        more = _by_range(rows, coef, later, scores, "_c string, u array<double>" if cluster else "u array<double>")
        made = more if made is None else made.unionByName(more)
    if cluster:
        made = made.groupBy("_c").agg(F.array(*[F.sum(F.col("u")[i]) for i in range(k)]).alias("u"))
    outer = made.agg(*[F.sum(F.col("u")[i] * F.col("u")[j]) for i in range(k) for j in range(k)]).first()
    return np.array(outer).reshape(k, k)


def robust_variance_coxph(df: DataFrame, time: str, x, status: str | None = None, strata=None, cluster: str | None = None, optimizer_params=None) -> DataFrame:
    """Huber-White, or with `cluster` cluster-robust, variance of a Cox model: coef, loglikelihood, std_err, robust_se, robust_z, robust_p."""
    opt = options(optimizer_params, {"max_iter": 100, "optimizer": "newton", "tolerance": 1e-8})
    ranges = _ranged(df, time, x, status, names(strata), {"_c": cluster} if cluster else None)
    coef, ll, h, _ = _cox_fit(ranges, opt)
    inv = sym_pinv(h)[0]
    v = inv @ _residual_sums(ranges, coef, bool(cluster)) @ inv
    se = np.sqrt(np.maximum(np.diag(v), 0))
    z = _ratio(coef, se)
    row = {"_key": (), "coef": floats(coef), "loglikelihood": float(ll), "std_err": floats(np.sqrt(np.maximum(np.diag(inv), 0))), "robust_se": floats(se), "robust_z": floats(z), "robust_p": floats(_z_two(z))}
    return model_frame(df, [], [row], "coef array<double>, loglikelihood double, std_err array<double>, robust_se array<double>, robust_z array<double>, robust_p array<double>")


def clustered_variance_coxph(df: DataFrame, time: str, x, cluster: str, status: str | None = None, strata=None, optimizer_params=None) -> DataFrame:
    return robust_variance_coxph(df, time, x, status, strata, cluster, optimizer_params)


def cox_zph(df: DataFrame, time: str, x, status: str | None = None, strata=None, optimizer_params=None) -> DataFrame:
    """(covariate, rho, chi2, p_value): correlation of scaled Schoenfeld residuals with the rank of time."""
    opt = options(optimizer_params, {"max_iter": 100, "optimizer": "newton", "tolerance": 1e-8})
    ranges = _ranged(df, time, x, status, names(strata))
    k = ranges.k
    coef, _, h, _ = _cox_fit(ranges, opt)
    sums = _sums(ranges, coef, False)
    later = _running(sums, True)
    inv = sym_pinv(h)[0]
    rows, res = ranges.others(), None
    means = {key: (v + later[key])[1 : 1 + k] / (v + later[key])[0] for key, v in sums.items() if key[1] in ranges.single}
    if means:
        at = ranges.ones().filter("_d").join(_means(ranges, means), ["_s", "_r"])
        res = at.select(F.col("_t").alias("t"), F.array(*[F.col("_x")[i] - F.col("v")[i] for i in range(k)]).alias("r"))
    if rows is not None:

        def residuals(s, r, risk: _Risk, table):
            return pa.table({"t": pa.array(risk.t[risk.d]), "r": _vectors((risk.x - risk.s1 / risk.s0[:, None])[risk.d])})

        more = _by_range(rows, coef, later, residuals, "t double, r array<double>")
        res = more if res is None else res.unionByName(more)
    m = int(sum(v[1 + k] for v in sums.values()))
    scaled = [sum((F.col("r")[j] * float(inv[i, j] * m) for j in range(k)), F.lit(0.0)) for i in range(k)]
    # by time: all events of a time have one rank, so sums and squares are enough
    by = cut(res.groupBy("t").agg(F.count("*").alias("n"), *[F.sum(s).alias(f"s{i}") for i, s in enumerate(scaled)], *[F.sum(s * s).alias(f"q{i}") for i, s in enumerate(scaled)]))
    g = F.col("up") - (F.col("n") - 1) / 2 - (m + 1) / 2  # less its mean
    ranked = running(by, "t", {"up": F.col("n")}).withColumn("g", g)
    each = [f(f"{c}{i}") for i in range(k) for f, c in ((F.sum, "s"), (F.sum, "q"), (lambda c: F.sum(F.col(c) * F.col("g")), "s"))]
    total = ranked.agg(F.sum(F.col("g") * F.col("g") * F.col("n")), *each).first()
    spread, out = total[0] / m, []
    for i in range(k):
        s, q, sg = (v / m for v in total[1 + 3 * i : 4 + 3 * i])
        deviation = np.sqrt((q - s * s) * spread)
        rho, chi = float(sg / deviation) if deviation > 0 else float("nan"), (sg * m) ** 2 / (inv[i, i] * m * spread * m) if spread > 0 else float("nan")
        out.append((i + 1, plain(rho), plain(float(chi)), plain(float(1 - evaluate("chi_squared", "cdf", np.array(chi), 1)))))
    return df.sparkSession.createDataFrame(out, "covariate int, rho double, chi2 double, p_value double")
