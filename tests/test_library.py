"""Known values and edge cases of the library's operators."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.functions import arrays as A
from corvane.functions import metrics as ME
from corvane.functions import prob, stemmer, svec
from corvane.functions.stemmer import stem
from corvane.operators import checks, cluster, describe, factor, glm, hypothesis, matrix, order, patterns, penalized, regress, sequence, series, survival, topics, trees
from corvane.sources import pmml


def one(df):
    return df.first()


def test_stems():
    pairs = "consistency:consist knightly:knight happily:happili generously:generous running:run hoping:hop agreed:agre caresses:caress ponies:poni ties:tie nationalization:nation rolled:roll hope:hope skies:sky"
    pairs = pairs.replace("hoping:hop", "hoping:hope")
    assert [(a, stem(a)) for a, _ in (p.split(":") for p in pairs.split())] == [tuple(p.split(":")) for p in pairs.split()]


@pytest.mark.parametrize(
    ("family", "what", "x", "args", "value"),
    [
        ("normal", "cdf", 1.96, (0, 1), 0.9750021048517795), ("normal", "quantile", 0.975, (0, 1), 1.959963984540054), ("students_t", "cdf", 2.0, (5,), 0.9490302605850709), ("chi_squared", "quantile", 0.95, (1,), 3.841458820694124),
        ("fisher_f", "cdf", 3.0, (2, 10), 0.904632568359375), ("binomial", "cdf", 3, (10, 0.4), 0.3822806015999999), ("poisson", "pmf", 2, (3,), 0.22404180765538775), ("gamma", "cdf", 3.0, (2, 1.5), 0.5939941502901616),
        ("beta", "cdf", 0.3, (2, 3), 0.3483), ("hypergeometric", "pmf", 2, (5, 10, 30), 0.35998484274345954),
    ],
)
def test_distributions(family, what, x, args, value):
    assert prob.evaluate(family, what, np.array([float(x)]), *args)[0] == pytest.approx(value, rel=1e-8)


def test_distribution_round_trips():
    laws = dict(beta=(2, 3), gamma=(2, 3), inverse_gamma=(3, 2), students_t=(4,), fisher_f=(3, 7), non_central_t=(5, 1), non_central_chi_squared=(3, 2), non_central_f=(3, 8, 2), non_central_beta=(2, 3, 1), lognormal=(0, 1))
    p = np.array([0.05, 0.4, 0.9])
    for family, args in laws.items():
        assert np.allclose(prob.evaluate(family, "cdf", prob.evaluate(family, "quantile", p, *args), *args), p)


def test_bad_parameters_raise():
    with pytest.raises(ValueError):
        prob.evaluate("normal", "cdf", np.array([0.0]), 0, -1)
    with pytest.raises(ValueError):
        prob.evaluate("gamma", "quantile", np.array([1.5]), 1, 1)
    with pytest.raises(ValueError):
        ME.dist_pnorm("x", "y", 0)


def test_arrays_edge_cases(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0]), (None, [1.0])], "x array<double>, y array<double>")
    assert one(df.filter("x IS NULL").select(A.array_add("x", "y")))[0] is None
    with pytest.raises(Exception, match="differ in length"):
        df.filter("x IS NOT NULL").select(A.array_add("x", "y")).collect()
    zero = spark.createDataFrame([([0.0], [0.0])], "x array<double>, y array<double>")
    assert one(zero.select(ME.cosine_similarity("x", "y"), ME.dist_angle("x", "y")))[:] == (-1.0, math.pi)
    sets = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b"])], "x array<string>, y array<string>")
    assert [r[0] for r in sets.select(ME.dist_jaccard("x", "y")).collect()] == [0.0, 1.0, 0.5]


def test_svec_text_and_scalars(spark):
    v = spark.createDataFrame([([1.0, 1.0, 0.0, 2.0],)], "x array<double>").select(svec.from_array("x").alias("a"))
    r = one(v.select(svec.to_string("a"), svec.to_string(svec.plus("a", svec.from_scalar(F.lit(1.0)))), svec.to_string(svec.from_positions(F.array(F.lit(2)), F.array(F.lit(5.0)), 4))))
    assert tuple(r) == ("{2,1,1}:{1,0,2}", "{2,1,1}:{2,1,3}", "{1,1,2}:{0,5,0}")
    with pytest.raises(Exception, match="differ in dimension"):
        v.select(svec.plus("a", svec.from_array(F.array(F.lit(1.0), F.lit(2.0))))).collect()


def points(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = 1 + 2 * x[:, 0] - x[:, 1] + rng.normal(scale=0.3, size=n)
    return x, y, spark.createDataFrame([(i, float(a), float(b), float(c), bool(c > 1), ["p", "q", "r"][i % 3]) for i, (a, b, c) in enumerate(zip(x[:, 0], x[:, 1], y))], "id int, a double, b double, y double, z boolean, g string")


def test_linear_regression(spark):
    x, y, df = points(spark)
    m = one(regress.linregr_train(df, "y", ["1", "a", "b"])[0])
    design = np.column_stack((np.ones(len(y)), x))
    assert np.allclose(m.coef, np.linalg.lstsq(design, y, rcond=None)[0])
    res = y - design @ m.coef
    v = np.linalg.inv(design.T @ design)
    assert np.allclose(m.std_err, np.sqrt(np.diag(v) * (res @ res) / (len(y) - 3)))
    robust = one(regress.robust_variance_linregr(df, "y", ["1", "a", "b"]))
    meat = (design * (res**2)[:, None]).T @ design * len(y) / (len(y) - 3)
    assert np.allclose(robust.std_err, np.sqrt(np.diag(v @ meat @ v)))
    wide = one(regress.linregr_train(df, "y", ["1", "a", "b", *[f"cos({i} * a)" for i in range(1, 15)]])[0])
    design = np.column_stack((np.ones(len(y)), x, *[np.cos(i * x[:, 0]) for i in range(1, 15)]))
    assert np.allclose(wide.coef, np.linalg.lstsq(design, y, rcond=None)[0], atol=1e-6)


def test_null_policy(spark):
    df = spark.createDataFrame([(1.0, 1.0, "a"), (None, 2.0, "a"), (3.0, None, "a"), (2.0, 3.0, "a"), (5.0, 4.0, "a")], "y double, x double, g string")
    m = one(regress.linregr_train(df, "y", ["1", "x"], "g")[0])
    assert (m.num_rows_processed, m.num_missing_rows_skipped) == (3, 2)
    with pytest.raises(checks.ArgumentError):
        regress.linregr_train(df.withColumn("g", F.lit(None).cast("string")), "y", ["1", "x"], "g")


def test_logistic_optimizers_agree(spark):
    _, _, df = points(spark)
    found = [one(regress.logregr_train(df, "z", ["1", "a"], None, n, o, 1e-10)[0]).coef for o, n in (("irls", 20), ("cg", 60))]
    assert np.allclose(found[0], found[1], atol=1e-3)
    binomial = one(glm.glm(df, "z", ["1", "a"], "binomial", "logit"))
    assert np.allclose(binomial.coef, found[0], atol=1e-4)
    two = one(regress.mlogregr_train(df, "z", ["1", "a"], False))
    assert np.allclose(two.coef, found[0], atol=1e-3)


def test_ordinal_with_two_classes_is_logistic(spark):
    _, _, df = points(spark)
    o = one(glm.ordinal(df, "z", ["a"], [False, True]))
    b = one(glm.glm(df, "z", ["1", "a"], "binomial", "logit"))
    assert np.allclose([-o.coef_threshold[0], o.coef_feature[0]], b.coef, atol=1e-3)


def test_elastic_net_limits(spark):
    x, y, df = points(spark)
    free = one(penalized.elastic_net_train(df, "y", ["a", "b"], "gaussian", 0.5, 0.0))
    ols = one(regress.linregr_train(df, "y", ["1", "a", "b"])[0])
    assert np.allclose([free.intercept, *free.coef_all], ols.coef, atol=1e-4)
    assert one(penalized.elastic_net_train(df, "y", ["a", "b"], "gaussian", 1.0, 100.0)).coef_nonzero == []


def test_svm_separates(spark):
    rng = random.Random(0)
    df = spark.createDataFrame([(i, float(s * 2 + rng.gauss(0, 0.3)), "yes" if s > 0 else "no") for i in range(200) for s in (1 if i % 2 else -1,)], "id int, x double, c string")
    m = penalized.svm_classification(df, "c", ["1", "x"], params="max_iter=30")
    p = penalized.svm_predict(m, df, "id", ["1", "x"]).join(df, "id")
    assert p.filter("prediction = c").count() >= 198
    with pytest.raises(ValueError):
        penalized.svm_classification(df.withColumn("c", F.lit("a")), "c", ["x"])


def test_rank_tests(spark):
    df = spark.createDataFrame([(i % 2 == 0, float(v)) for i, v in enumerate([1, 2, 2, 3, 5, 4, 4, 8, 9, 1])], "a boolean, x double")
    r = one(hypothesis.mw_test(df, "a", "x"))
    pairs = [(1 if p < q else 0.5 if p == q else 0) for p in (1, 2, 5, 4, 9) for q in (2, 3, 4, 8, 1)]
    assert r.u_statistic == min(sum(pairs), 25 - sum(pairs))
    k = one(hypothesis.ks_test(df, "a", "x"))
    assert 0 <= k.p_value <= 1 and k.statistic == pytest.approx(0.2)
    assert one(hypothesis.t_test_one(df.limit(1), "x")).p_value_two_sided is None


def test_quantile_as_coded(spark):
    df = spark.createDataFrame([(float(v),) for v in (4, 1, 3, 2, 5)], "x double")
    assert one(describe.quantile(df, "x", 0.5))[0] == 2.5
    with pytest.raises(ValueError):
        describe.quantile(df, "x", 0.1)


def test_summary_counts_blanks(spark):
    df = spark.createDataFrame([("a",), (" ",), (None,), ("bb",)], "s string")
    r = one(describe.summary(df, get_estimates=False))
    assert (r.row_count, r.missing_values, r.blank_values, r.min, r.max, r.distinct_values) == (4, 1, 1, 1.0, 2.0, 3)


def test_matrix_decompositions(spark):
    a = np.arange(12.0).reshape(4, 3) + np.eye(4, 3) * 5
    m = matrix.table(spark, a)
    lu = {k: matrix.collect(v) for k, v in matrix.lu(m).items()}
    assert np.allclose(lu["p"] @ a @ lu["q"], lu["l"] @ lu["u"])
    qr = {k: matrix.collect(v) for k, v in matrix.qr(m).items()}
    assert np.allclose(qr["q"] @ qr["r"], a)
    s = factor.svd(m, 3)
    u, v = matrix.collect(s["u"]), matrix.collect(s["v"])
    d = np.diag([r.val for r in s["s"].orderBy("row_id").collect()])
    assert np.allclose(u @ d @ v.T, a, atol=1e-6)
    with pytest.raises(ValueError):
        matrix.add(m, matrix.trans(m))


def test_path_takes_the_last_match(spark):
    rows = [(1, i, e) for i, e in enumerate("abxab")] + [(2, 0, "b")]
    df = spark.createDataFrame(rows, "u int, t int, e string")
    out, tuples = patterns.path(df, "u", "t", "(A)(B)", "A:=e = 'a', B:=e = 'b'", ["min(t) AS t0", "count(*) AS n"], True)
    assert [tuple(r) for r in out.collect()] == [(1, 3, 2)]
    assert tuples.count() == 2
    with pytest.raises(ValueError):
        patterns.path(df, "u", "t", "A", {"A": "true", "a": "false"}, ["count(*)"])


def test_assoc_rules(spark):
    baskets = [("beer", "chips"), ("beer", "chips", "diapers"), ("beer",), ("chips",)]
    df = spark.createDataFrame([(i, x) for i, b in enumerate(baskets) for x in b], "t int, i string")
    r = {(tuple(x.pre), tuple(x.post)): x for x in patterns.assoc_rules(df, "t", "i", 0.25, 0.5).collect()}
    x = r[(("beer",), ("chips",))]
    assert (x.support, x.confidence) == (0.5, pytest.approx(2 / 3))
    assert r[(("diapers",), ("beer",))].conviction == 0.0


def test_naive_bayes(spark):
    df = spark.createDataFrame([(0, "a", ["1", "x"]), (1, "a", ["1", "y"]), (2, "b", ["2", "x"]), (3, "b", ["2", "x"])], "id int, c string, v array<string>")
    p = {(r.key, r["class"]): r.nb_prob for r in patterns.nb_probs(patterns.nb_train(df, "c", "v"), df, "id", "v").collect()}
    a, b = (3 / 4) * (2 / 4), (1 / 4) * (3 / 4)
    assert p[(0, "a")] == pytest.approx(a / (a + b))


def test_tree_finds_the_split(spark):
    df = spark.createDataFrame([(i, float(i), "lo" if i < 50 else "hi", None if i % 10 == 0 else float(i)) for i in range(100)], "id int, x double, c string, w double")
    t = trees.tree_train(df, "c", ["x"], max_depth=2, min_split=4)
    assert trees.tree_predict(t, df, "id").join(df, "id").filter("prediction = c").count() >= 97
    s = trees.tree_train(df, "c", ["w", "x"], max_depth=1, min_split=4, cp=0.0, max_surrogates=1)
    assert trees.tree_predict(s, df, "id").join(df, "id").filter("prediction = c").count() >= 90
    assert "<TreeModel" in pmml.tree(t, "c") and "digraph" in trees.tree_display(t, True)
    r = trees.tree_train(df, "x", ["w"], max_depth=3, min_split=4, cp=0.0)
    assert one(r).num_leaves >= 4


def test_forest(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 7), "lo" if i < 100 else "hi") for i in range(200)], "id int, x double, n double, c string")
    f = trees.forest_train(df, "c", ["x", "n"], num_trees=5, max_depth=3, num_random_features=2)
    assert one(f["summary"]).oob_error < 0.1
    scores = {r.feature: r.importance for r in f["importance"].collect()}
    assert scores["x"] > scores["n"]


def brute_cox(t, x, d):
    b = np.zeros(x.shape[1])
    for _ in range(30):
        g, h = np.zeros(len(b)), np.zeros((len(b), len(b)))
        for i in np.flatnonzero(d):
            risk = t >= t[i]
            e = np.exp(x[risk] @ b)
            m = e @ x[risk] / e.sum()
            g += x[i] - m
            h += (x[risk] * e[:, None]).T @ x[risk] / e.sum() - np.outer(m, m)
        b = b + np.linalg.solve(h, g)
    return b, np.sqrt(np.diag(np.linalg.inv(h)))


def test_cox(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 2))
    t = np.round(rng.exponential(np.exp(-x[:, 0])), 1)
    d = rng.random(150) < 0.7
    df = spark.createDataFrame([(float(a), float(p), float(q), bool(e)) for a, (p, q), e in zip(t, x, d)], "t double, a double, b double, d boolean")
    m = one(survival.coxph_train(df, "t", ["a", "b"], "d"))
    b, se = brute_cox(t, x, d)
    assert np.allclose(m.coef, b, atol=1e-4) and np.allclose(m.std_err, se, atol=1e-4)


def test_arima_recovers_coefficients(spark):
    rng = np.random.default_rng(0)
    z = np.zeros(2000)
    for i in range(1, 2000):
        z[i] = 0.6 * z[i - 1] + rng.normal()
    m = series.fit_arima(z, 1, 0, 0, True, series.OPTIONS)
    assert m["ar_params"][0] == pytest.approx(0.6, abs=0.06)
    line = spark.createDataFrame([(i, float(3 * i)) for i in range(50)], "t int, v double")
    f = series.arima_forecast(series.arima_train(line, "t", "v", orders=(0, 1, 0))["model"], 3)
    assert f.count() == 3


def test_kmeans_finds_clusters(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([([c + rng.gauss(0, 0.1), -c + rng.gauss(0, 0.1)],) for c in (0, 5, 10) for _ in range(40)] + [(None,), ([float("nan"), 0.0],)], "p array<double>")
    m = one(cluster.kmeanspp(df, "p", 3, seed=2))
    assert sorted(m.cluster_sizes) == [40, 40, 40]
    assert one(cluster.simple_silhouette(df, "p", m.centroids))[0] > 0.9


def test_crf_learns(spark):
    rows = [(i, d, w, k, 2) for d in range(6) for i, (w, k) in enumerate([("the", 0), (["dog", "cat"][d % 2], 1), ("runs", 2)])]
    seg = spark.createDataFrame(rows, "start_pos int, doc_id int, seg_text string, label int, max_pos int")
    rules = spark.createDataFrame([("s$", "plural")], "pattern string, name string")
    made = sequence.crf_train_fgen(seg, rules)
    w = sequence.lincrf_train(made["features"], made["featureset"], 3, 15)["weights"]
    labels = spark.createDataFrame([(i, f"L{i}") for i in range(3)], "id int, label string")
    got = sequence.vcrf_label(sequence.crf_test_fgen(seg.drop("label"), sequence.dictionary(seg), rules), w, labels)
    assert got.join(seg, ["doc_id", "start_pos"]).filter("id = " + "start_pos").count() == 18


def test_linear_solvers_agree(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(6, 6))
    a = a @ a.T + 6 * np.eye(6)
    b = rng.normal(size=6)
    dense = spark.createDataFrame([(i, [float(v) for v in r], float(c)) for i, (r, c) in enumerate(zip(a, b))], "i int, a array<double>, b double")
    x = np.linalg.solve(a, b)
    for optimizer in ("direct", "cg", "bicgstab"):
        assert np.allclose(one(factor.linear_solver_dense(dense, "i", "a", "b", (), optimizer)).solution, x, atol=1e-6)
    lhs = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(6) for j in range(6)], "row_id int, col_id int, val double")
    rhs = dense.selectExpr("i AS row_id", "b AS val")
    assert np.allclose(one(factor.linear_solver_sparse(lhs, rhs, optimizer="cg")).solution, x, atol=1e-6)


def test_options():
    assert checks.options("max_iter=5, tolerance=0.1", {"max_iter": 1, "tolerance": 1.0}) == {"max_iter": 5, "tolerance": 0.1}
    with pytest.raises(checks.ArgumentError):
        checks.options("other=1", {"max_iter": 1})


def test_path_keeps_a_null_partition(spark):
    df = spark.createDataFrame([("u", 1, "a"), ("u", 2, "b"), (None, 1, "a"), (None, 2, "b"), (None, 3, "b"), ("v", 1, "b")], "k string, t int, e string")
    out = patterns.path(df, "k", "t", "(A)(B)+", {"A": "e = 'a'", "B": "e = 'b'"}, ["count(*) AS n"])
    assert {r.k: r.n for r in out.collect()} == {"u": 2, None: 3}


def test_naive_bayes_keeps_rows_with_unseen_values(spark):
    train = spark.createDataFrame([("p", ["x", "1"]), ("p", ["x", "2"]), ("q", ["y", "1"]), ("q", ["y", None]), ("q", None)], "c string, a array<string>")
    model = patterns.nb_train(train, "c", "a")
    assert {r["class"]: (r.class_cnt, r.all_cnt) for r in model["priors"].collect()} == {"p": (2, 3), "q": (1, 3)}
    rows = spark.createDataFrame([(1, ["new", "other"]), (2, ["y", "1"]), (2, ["y", "1"]), (3, ["x", None])], "id int, a array<string>")
    probs = patterns.nb_probs(model, rows, "id", "a").collect()
    assert sorted((r.key, r["class"]) for r in probs) == [(1, "p"), (1, "q"), (2, "p"), (2, "p"), (2, "q"), (2, "q")]
    one_ = {r["class"]: r.nb_prob for r in probs if r.key == 1}
    assert one_["p"] == pytest.approx(2 / 3) and one_["q"] == pytest.approx(1 / 3)
    p, q = (2 / 3) * (1 / 4) * (2 / 4), (1 / 3) * (2 / 3) * (2 / 3)
    assert all(r.nb_prob == pytest.approx((p if r["class"] == "p" else q) / (p + q)) for r in probs if r.key == 2)


@pytest.mark.parametrize("family", ["gaussian", "binomial"])
def test_elastic_net_groups_and_warm_up(spark, family):
    _, _, df = points(spark)
    y = "y" if family == "gaussian" else "z"
    args = (family, 0.5, 0.05)
    whole = {r.g: r for r in penalized.elastic_net_train(df, y, ["a", "b"], *args, tolerance=1e-8, groups="g").collect()}
    for g in "pqr":
        alone = one(penalized.elastic_net_train(df.filter(F.col("g") == g), y, ["a", "b"], *args, tolerance=1e-8))
        assert np.allclose([whole[g].intercept, *whole[g].coef_all], [alone.intercept, *alone.coef_all], atol=1e-5)
    plain = one(penalized.elastic_net_train(df, y, ["a", "b"], *args, tolerance=1e-8))
    for more in ({"warmup": True}, {"warmup": True, "warmup_lambdas": [1.0, 0.2]}, {"use_active_set": True}, {"optimizer": "igd"}):
        other = one(penalized.elastic_net_train(df, y, ["a", "b"], *args, tolerance=1e-8, **more))
        assert np.allclose([plain.intercept, *plain.coef_all], [other.intercept, *other.coef_all], atol=1e-4)


def test_svm_folds_and_eps_table(spark):
    _, _, df = points(spark)
    m = one(penalized.svm_classification(df, "z", ["1", "a", "b"], params={"lambda": [0.001, 5.0], "n_folds": 3, "max_iter": 30}))
    assert [v["lambda"] for v in m.validation] == [0.001, 5.0] and m["lambda"] == 0.001
    assert m.validation[0].mean_score < m.validation[1].mean_score
    fixed = one(penalized.svm_classification(df, "z", ["1", "a", "b"], params={"lambda": 0.001, "max_iter": 30}))
    assert np.allclose(m.coef, fixed.coef) and fixed.validation is None
    eps = spark.createDataFrame([("p", 10.0)], "g string, epsilon double")
    by = {r.g: r for r in penalized.svm_regression(df, "y", ["1", "a", "b"], groups="g", params="max_iter=40", eps_table=eps).collect()}
    assert by["p"].loss == 0 and by["q"].loss > 0
    with pytest.raises(ValueError, match="n_folds"):
        penalized.svm_classification(df, "z", ["1", "a"], params={"lambda": [1.0, 2.0]})


def test_trees_of_groups_grow_together(spark):
    rng = np.random.default_rng(3)
    rows = [(float(x), "low" if (x < 0.3) == (g == "a") else "high", g) for g in "ab" for x in rng.random(300)]
    df = spark.createDataFrame(rows, "x double, c string, g string")
    both = {r.g: trees.Tree.from_json(r.tree) for r in trees.tree_train(df, "c", ["x"], groups="g", max_depth=3).collect()}
    for g, t in both.items():
        assert abs(t.nodes[0].threshold - 0.3) < 0.03 and sum(n.feature >= 0 for n in t.nodes) == 1
        assert t.classes[int(np.argmax(t.nodes[t.nodes[0].left].stats))] == ("low" if g == "a" else "high")


def test_tree_pruned_by_folds(spark):
    rng = np.random.default_rng(5)
    rows = [(float(x), float(z), (1.0 if x > 0.5 else 0.0) + float(rng.normal(scale=0.8))) for x, z in rng.random((600, 2))]
    df = spark.createDataFrame(rows, "x double, z double, y double")
    deep = one(trees.tree_train(df, "y", ["x", "z"], max_depth=6, min_split=10, cp=0.0))
    cut = one(trees.tree_train(df, "y", ["x", "z"], max_depth=6, min_split=10, cp=0.0, n_folds=5))
    assert cut.num_leaves < deep.num_leaves / 3 and cut.cp > 0
    best = min(cut.cv, key=lambda r: r.cv_error_avg)
    assert best.cv_error_avg == pytest.approx(min(r.cv_error_avg for r in cut.cv if r.cp == cut.cp), abs=1e-12)
    assert abs(trees.Tree.from_json(cut.tree).nodes[0].threshold - 0.5) < 0.05


def test_forest_on_a_sample(spark):
    _, _, df = points(spark)
    f = trees.forest_train(df, "z", ["a", "b"], num_trees=5, max_depth=3, sample_ratio=0.5, importance=False)
    assert 100 < f["summary"].first().oob_rows < 260
    with pytest.raises(ValueError, match="sample_ratio"):
        trees.forest_train(df, "z", ["a"], sample_ratio=0.0)


def test_lda_separates_planted_topics(spark):
    rng = np.random.default_rng(2)
    rows = [(f"document-{d}", int(w) + 10 * (d % 3), 1) for d in range(60) for w in rng.integers(0, 10, 40)]
    df = spark.createDataFrame(rows, "docid string, wordid int, count int").groupBy("docid", "wordid").agg(F.sum("count").alias("count"))
    out = topics.lda_train(df, 30, 3, 40, 0.1, 0.1)
    best = {r.docid: int(np.argmax(r.topic_count)) for r in out["output"].collect()}
    groups = [{best[f"document-{d}"] for d in range(k, 60, 3)} for k in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    again = {r.docid: int(np.argmax(r.topic_count)) for r in topics.lda_predict(df, out["model"], 10).collect()}
    assert again == best
    assert topics._stream(1, "document-1").random() != topics._stream(1, "document-2").random()


def test_block_products_are_added_up(spark, monkeypatch):
    a = np.arange(42.0).reshape(6, 7)
    m = matrix.sparsify(matrix.table(spark, a + 1))
    for held in (matrix.HELD, 3):
        monkeypatch.setattr(matrix, "HELD", held)
        got = matrix.unblockize(matrix.block_mult(matrix.blockize(m, 2, 3), matrix.block_trans(matrix.blockize(m, 2, 3))))
        assert np.allclose(matrix.collect(got), (a + 1) @ (a + 1).T)


def test_frequent_values_by_sketch(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("b", 2), ("b", 2), (None, 2), (None, None), ("c", None)], "s string, i int")
    for estimates in (False, True):
        got = {r.target_column: (r.most_frequent_values, r.mfv_frequencies) for r in describe.frequent_values(df, ["s", "i"], 2, estimates=estimates).collect()}
        assert got == {"s": (["a", "b"], [3, 2]), "i": (["2", "1"], [3, 2])}


def test_running_sums_by_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(order, "ROWS", 5)
    df = spark.range(1000).select((F.col("id") % 321).alias("x"))
    got = {r.x: r.n for r in order.running(df, "x", {"n": F.lit(1)}).collect()}
    assert got == {x: sum(1 for i in range(1000) if i % 321 <= x) for x in range(321)}
    assert len(order.split_points(df, F.col("x"), 5)) > 150


def test_svec_binary_form(spark):
    v = spark.createDataFrame([([1.0, 1.0, 0.5],), (None,)], "x array<double>").select(svec.from_array("x").alias("a"))
    assert [r[0] for r in v.select(svec.to_array(svec.recv(svec.send("a")))).collect()] == [[1.0, 1.0, 0.5], None]


def test_vectors_cost_their_entries_only(spark):
    df = spark.createDataFrame([([7, 2_000_000_000, 8], [1.0, 2.0, 1.0])], "p array<long>, v array<double>").select(svec.from_positions("p", "v", 2_000_000_000).alias("s"))
    r = one(df.select("s", svec.nonbase_values("s").alias("v")))
    assert (r.s.n, r.s.v, r.v) == ([6, 2, 1_999_999_991, 1], [0.0, 1.0, 0.0, 2.0], [1.0, 1.0, 2.0])


def test_rank_tests_of_millions_of_rows(spark):
    df = spark.range(4_000_000).select((F.col("id") % 2 == 0).alias("a"), F.when(F.col("id") % 4 < 3, 1.0).otherwise(-1.0).alias("x"))
    r = one(hypothesis.mw_test(df, "a", "x"))
    assert r.u_statistic == 1e12 and abs(r.statistic) == pytest.approx(1e12 / math.sqrt(4e12 * (4e6 + 1) / 12))
    w = one(hypothesis.wsr_test(df, "x"))
    assert w.num == 4_000_000 and w.rank_sum_pos == 3e6 * (4e6 + 1) / 2
    assert w.z_statistic == pytest.approx((w.rank_sum_pos - 4e6 * (4e6 + 1) / 4) / math.sqrt(4e6 * (4e6 + 1) * (8e6 + 1) / 24 - (4e6**3 - 4e6) / 48))


def test_ranges_by_search(spark):
    x = [None, float("-inf"), -1.0, -0.0, 0.0, 0.5, 1.0, 7.0, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    got = [r.k for r in order.placed(df, F.col("x"), [0.0, 1.0, float("inf")], "k").collect()]
    assert got[:9] == [0, 0, 0, 1, 1, 1, 2, 2, 2] and got[9] >= 2
    sums = {str(r.x): r.n for r in order.running(df.withColumn("i", F.lit(1)), "x", {"n": F.col("i")}).collect()}
    assert sums == {"None": 1, "-inf": 2, "-1.0": 3, "-0.0": 5, "0.0": 5, "0.5": 6, "1.0": 7, "7.0": 8, "inf": 9, "nan": 10}


@pytest.mark.parametrize("cells", [64, 1 << 19])
def test_cox_ranges_of_a_single_time(spark, monkeypatch, cells):
    """Crowded times never go to Python as one group, and all ways of adding up give the same model."""
    monkeypatch.setattr(survival, "RANGE_CELLS", cells)
    rng = np.random.default_rng(5)
    n = 240
    x = rng.normal(size=(n, 2))
    t = np.round(rng.exponential(np.exp(-x[:, 0])), 1)
    d, s, c = rng.random(n) < 0.6, rng.integers(0, 2, n), rng.integers(0, 20, n)
    df = spark.createDataFrame([(float(a), float(p), float(q), bool(e), int(g), int(h)) for a, (p, q), e, g, h in zip(t, x, d, s, c)], "t double, a double, b double, d boolean, s int, c int")
    ranges = survival._ranged(df, "t", ["a", "b"], "d", [])
    others = ranges.others().groupBy("_r").count().agg(F.max("count")).first()[0]
    assert bool(ranges.single) == (cells == 64) and (cells > 64 or others <= 32)
    b, se = brute_cox(t, x, d)
    m = one(survival.coxph_train(df, "t", ["a", "b"], "d", None, "tolerance=1e-14"))
    assert np.allclose(m.coef, b, atol=1e-7) and np.allclose(m.std_err, se, atol=1e-7)
    monkeypatch.setattr(survival, "PLAIN", 0)
    assert np.allclose(one(survival.coxph_train(df, "t", ["a", "b"], "d", None, "tolerance=1e-14")).coef, b, atol=1e-7)
    e = np.exp(x @ b)
    u, residuals = np.zeros((n, 2)), []
    for i in np.flatnonzero(d):
        risk = t >= t[i]
        mean = e[risk] @ x[risk] / e[risk].sum()
        u[risk] -= (e[risk] / e[risk].sum())[:, None] * (x[risk] - mean)
        u[i] += x[i] - mean
        residuals.append((t[i], x[i] - mean))
    inv = np.linalg.inv(np.array(m.hessian))
    for cluster, v in (None, u), ("c", np.array([u[c == g].sum(0) for g in range(20)])):
        r = one(survival.robust_variance_coxph(df, "t", ["a", "b"], "d", cluster=cluster, optimizer_params="tolerance=1e-14"))
        assert np.allclose(r.robust_se, np.sqrt(np.diag(inv @ v.T @ v @ inv)), atol=1e-6)
    times = np.array([a for a, _ in residuals])
    rank = np.array([(times < a).sum() + ((times == a).sum() + 1) / 2 for a in times])
    scaled = np.array([v for _, v in residuals]) @ inv
    got = [r.rho for r in survival.cox_zph(df, "t", ["a", "b"], "d", None, "tolerance=1e-14").orderBy("covariate").collect()]
    assert np.allclose(got, [np.corrcoef(scaled[:, i], rank)[0, 1] for i in (0, 1)], atol=1e-6)
    split = survival.coxph_train(df, "t", ["a", "b"], "d", "s", "tolerance=1e-14").first().coef
    monkeypatch.setattr(survival, "RANGE_CELLS", 1 << 22)
    assert np.allclose(split, survival.coxph_train(df, "t", ["a", "b"], "d", "s", "tolerance=1e-14").first().coef, atol=1e-9)


def test_lda_by_chunks(spark, monkeypatch):
    """A task gets the counts of its chunk's words only; words, counts and topics fit together, the perplexity is that of the model."""
    monkeypatch.setattr(topics, "CHUNK", 50)
    rng = np.random.default_rng(4)
    rows = [(d, int(w), 1 + d % 2) for d in range(40) for w in sorted(set(rng.integers(0, 500, 12)))]
    df = spark.createDataFrame(rows, "docid int, wordid int, count int")
    out = topics.lda_train(df, 500, 3, 14, 0.1, 0.1)
    got = out["output"].collect()
    table = np.zeros((500, 3), int)
    for r in got:
        np.add.at(table, (r.words, r.topic_assignment), 1)
    assert (table == out["model"]["counts"]).all() and table.sum() == sum(n for *_, n in rows) and len(got) == 40
    chunks = topics._chunked(topics._prepared(df, 3, 0, "docid", "wordid", "count")).groupBy("chunk").agg(F.size(F.array_distinct(F.flatten(F.collect_list("words")))).alias("n"))
    assert chunks.agg(F.max("n")).first()[0] < 250
    phi = (table + 0.1) / (table.sum(0) + 50)
    ll = sum(np.log(phi[r.words] @ ((np.array(r.topic_count) + 0.1) / (len(r.words) + 0.3))).sum() for r in got)
    assert topics.lda_perplexity(**out) == pytest.approx(np.exp(-ll / table.sum()))
    vocabulary = spark.createDataFrame([(i, f"w{i}") for i in range(500)], "wordid int, word string")
    top = {(r.topicid, r.wordid): r.prob for r in topics.lda_topic_desc(out["model"], vocabulary, 2).collect()}
    assert all(p == pytest.approx(phi[w, k]) and (phi[:, k] > phi[w, k] + 1e-12).sum() < 2 for (k, w), p in top.items())
    assert {r.topicid: r.word_count for r in topics.lda_topic_word_count(spark, out["model"]).collect()} == {k: table[:, k].tolist() for k in range(3)}


def test_stems_of_arrays(spark, monkeypatch):
    """Each distinct word of a piece is stemmed once; nulls and empty arrays stay."""
    rows = [(["running", None, "ponies"], "ponies"), (None, None), ([], ""), (["running"] * 5, "hoping")]
    df = spark.createDataFrame(rows, "w array<string>, t string").coalesce(1)
    got = [(r[0], r[1]) for r in df.select(stemmer.stem_token_arr("w"), stemmer.stem_token("t")).collect()]
    assert got == [(["run", None, "poni"], "poni"), (None, None), ([], ""), (["run"] * 5, "hope")]
    calls = []
    monkeypatch.setattr(stemmer, "stem", lambda w: calls.append(w) or w)
    monkeypatch.setattr(stemmer, "WORDS", 3)
    lists = pa.array([["a", "b"], None, ["a", "a", "a", "c"]])
    assert stemmer._stem_lists(lists).to_pylist() == lists.to_pylist() and stemmer._stem_lists(lists.slice(2)).to_pylist() == [["a", "a", "a", "c"]]
    assert calls == ["a", "b", "a", "c", "a", "c"]


@pytest.mark.parametrize("smoothing", [1.0, 0.0])
def test_naive_bayes_scores_rows_in_place(spark, monkeypatch, smoothing):
    """A small model is sent to all tasks and rows are scored without a shuffle, as by joins to a large one."""
    rng = np.random.default_rng(6)
    rows = [(i % 30, "xyz"[rng.integers(3)], [str(rng.integers(4)), str(rng.integers(3)), f"{rng.normal():.3f}"] if i % 11 else [str(rng.integers(4))]) for i in range(90)]
    rows += [(1, "x", None), (2, "y", ["1", None, "0"])]
    new = spark.createDataFrame([*rows, (77, "x", ["9", "none", "word"]), (78, "x", [])], "k int, c string, a array<string>")
    model = patterns.nb_train(spark.createDataFrame(rows, "k int, c string, a array<string>"), "c", "a", [3], smoothing)
    probs, best = patterns.nb_probs(model, new, "k", "a"), patterns.nb_classify(model, new, "k", "a")
    plan = patterns._nb_scored(model, new, "k", "a")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    got, classes = sorted(map(tuple, probs.collect())), {r.key: r["class"] for r in best.collect()}
    monkeypatch.setattr(patterns, "SENT_ROWS", 0)
    expected = sorted(map(tuple, patterns.nb_probs(model, new, "k", "a").collect()))
    assert [r[:2] for r in got] == [r[:2] for r in expected] and len(got) == 3 * 91
    assert np.allclose([r[2:] for r in got], [r[2:] for r in expected])
    assert classes.keys() == {r[0] for r in got} and classes == {r.key: r["class"] for r in patterns.nb_classify(model, new, "k", "a").collect()}


@pytest.mark.parametrize("optimizer", ["irls", "cg", "igd"])
def test_logistic_sums_need_no_python(spark, monkeypatch, optimizer):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 2)) * (1, 300)
    df = spark.createDataFrame([(bool(rng.random() < 1 / (1 + np.exp(-a + b / 300))), float(a), float(b)) for a, b in x], "y boolean, a double, b double")
    fit = lambda: one(regress.logregr_train(df, "y", ["1", "a", "b"], None, 15, optimizer)[0])
    with monkeypatch.context() as m:
        m.setattr(regress, "iterate", None)
        plain = fit()
    monkeypatch.setattr(regress, "NATIVE", 0)
    kernel = fit()
    assert plain.num_iterations == kernel.num_iterations and plain.log_likelihood == pytest.approx(kernel.log_likelihood)
    assert np.allclose(plain.coef, kernel.coef) and np.allclose(plain.std_err, kernel.std_err)


def test_exact_quartiles_by_ranges(spark, monkeypatch):
    """Quartiles are those of the engine's percentile, without all values of a group in one task."""
    monkeypatch.setattr(order, "ROWS", 7)
    rng = np.random.default_rng(9)
    rows = [("ab"[i % 2] if i % 7 else None, float(np.round(rng.normal(), 1)) if i % 5 else None, int(rng.integers(1000))) for i in range(301)] + [("c", None, 5), ("d", 1.5, 2)]
    df = spark.createDataFrame(rows, "g string, x double, k int")
    out = describe.summary(df, ["x", "k"], "g", ntile_array=[0.0, 0.1, 1.0], how_many_mfv=0, get_estimates=False)
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.group_by, r.group_by_value, r.target_column): (r.first_quartile, r.median, r.third_quartile, r.quantile_array) for r in out.collect()}
    points = [0.25, 0.5, 0.75, 0.0, 0.1, 1.0]
    for c in ("x", "k"):
        for r in df.groupBy("g").agg(F.percentile(c, points).alias("p")).collect() + df.agg(F.lit("all").alias("g"), F.percentile(c, points).alias("p")).collect():
            q = got[(None, None, c) if r.g == "all" else ("g", r.g or "", c)]
            assert r.p is None and q[0] is None if q[3] is None else np.allclose([*q[:3], *q[3]], r.p)


def test_terms_of_whole_documents_need_no_shuffle(spark):
    rows = [(1, ["b", "a", "b", None, "", "b"]), (2, []), (3, None), (None, ["a"]), (5, ["z"])]
    df = spark.createDataFrame(rows, "d int, w array<string>")
    expected = {(1, "a", 1), (1, "b", 3), (1, "", 1), (None, "a", 1), (5, "z", 1)}
    once = patterns.term_frequency(df, "d", "w")
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    assert set(map(tuple, once.collect())) == expected and once.count() == 5
    twice = patterns.term_frequency(df.union(df), "d", "w")
    assert twice.dtypes == once.dtypes
    assert set(map(tuple, twice.collect())) == {(d, w, 2 * n) for d, w, n in expected}
