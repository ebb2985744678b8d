"""Linear-chain conditional random fields: features, training, Viterbi labelling."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.iteration import cut

_DIGITS = r"\d"


def _tokens(segments: DataFrame) -> DataFrame:
    """Segments with digits replaced, and the label before."""
    token = F.when(F.col("seg_text").rlike(r"^[0-9]+$"), F.lit("DIGIT")).otherwise(F.lower("seg_text"))
    w = Window.partitionBy("doc_id").orderBy("start_pos")
    before = F.lag("label").over(w) if "label" in segments.columns else F.lit(None).cast("int")
    return segments.withColumn("token", token).withColumn("prev_label", before)


def dictionary(segments: DataFrame) -> DataFrame:
    """(token, total): how often each token occurs."""
    return _tokens(segments).groupBy("token").agg(F.count("*").alias("total"))


def crf_train_fgen(segments: DataFrame, regexes: DataFrame) -> dict[str, DataFrame]:
    """{features, featureset}: (doc_id, start_pos, f_name, prev_label, label) and the distinct features with ids.

    E. edge, S. start, End. end, W_ word, R_ regex, U unknown (a token that occurs once).
    """
    t = cut(_tokens(segments))
    rules = [(r.pattern, r.name) for r in regexes.toLocalIterator()]  # a short list of patterns
    total = t.groupBy("token").agg(F.count("*").alias("_total"))
    t = t.join(total, "token")
    none = F.lit(-1)
    parts = [
        F.when(F.col("prev_label").isNotNull(), F.struct(F.lit("E.").alias("f_name"), F.col("prev_label").alias("prev_label"))),
        F.when(F.col("start_pos") == 0, F.struct(F.lit("S.").alias("f_name"), none.alias("prev_label"))),
        F.when(F.col("start_pos") == F.col("max_pos"), F.struct(F.lit("End.").alias("f_name"), none.alias("prev_label"))),
        F.struct(F.concat(F.lit("W_"), F.col("token")).alias("f_name"), none.alias("prev_label")),
        F.when(F.col("_total") <= 1, F.struct(F.lit("U").alias("f_name"), none.alias("prev_label"))),
        *[F.when(F.col("seg_text").rlike(p), F.struct(F.lit(f"R_{n}").alias("f_name"), none.alias("prev_label"))) for p, n in rules],
    ]
    found = t.select("doc_id", "start_pos", "max_pos", "label", F.explode(F.array_compact(F.array(*parts))).alias("f")).select("doc_id", "start_pos", "max_pos", "f.f_name", "f.prev_label", "label")
    found = cut(found)
    names = found.groupBy("f_name", "prev_label", "label").agg(F.count("*").alias("n"))
    numbered = cut(names.orderBy("f_name", "prev_label", "label")).withColumn("f_index", F.row_number().over(Window.orderBy("f_name", "prev_label", "label")) - 1)
    return {"features": found, "featureset": numbered}


class Chain:
    """Scores of all label sequences of a document from sparse state features and an edge table."""

    def __init__(self, n_labels: int, features: dict, weights: np.ndarray):
        self.n, self.features, self.w = n_labels, features, weights

    def potentials(self, rows: list[list[str]]):
        """State scores (positions, labels), edge scores (labels, labels), and which features fire."""
        state = np.zeros((len(rows), self.n))
        fired = []
        for i, fs in enumerate(rows):
            for f in fs:
                for label, k in self.features.get(f, ()):
                    state[i, label] += self.w[k]
                    fired.append((i, label, k))
        edge = np.zeros((self.n, self.n))
        for (a, b), k in self.features.get("E.", {}).items():
            edge[a, b] += self.w[k]
        return state, edge, fired


def _logsum(a, axis):
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(state, edge):
    n = len(state)
    a, b = np.zeros_like(state), np.zeros_like(state)
    a[0] = state[0]
    for i in range(1, n):
        a[i] = state[i] + _logsum(a[i - 1][:, None] + edge, 0)
    for i in range(n - 2, -1, -1):
        b[i] = _logsum(edge + (state[i + 1] + b[i + 1])[None], 1)
    z = _logsum(a[-1], 0)
    return a, b, float(z)


def _documents(features: DataFrame) -> DataFrame:
    """A row for each document: per position the label and the names of its state features."""
    states = features.filter("f_name <> 'E.'").groupBy("doc_id", "start_pos", "label").agg(F.collect_list("f_name").alias("f"))
    return states.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", F.col("label").cast("int").alias("label"), "f"))).alias("p"))


def lincrf_train(features: DataFrame, featureset: DataFrame, n_labels: int, max_iterations: int = 20, sigma: float = 10.0, tolerance: float = 1e-4) -> dict[str, DataFrame]:
    """{weights, stats}: the penalised likelihood of all documents, by L-BFGS; each evaluation is one pass."""
    table: dict = {}
    edges = {}
    names = []
    for r in featureset.orderBy("f_index").toLocalIterator():
        names.append((r.f_index, r.f_name, r.prev_label, r.label))
        if r.f_name == "E.":
            edges[(int(r.prev_label), int(r.label))] = r.f_index
        else:
            table.setdefault(r.f_name, []).append((int(r.label), r.f_index))
    table["E."] = edges
    m = len(names)
    docs = cut(_documents(features))
    spark = features.sparkSession
    fixed = spark.sparkContext.broadcast(table)

    def evaluate(w):
        weights = spark.sparkContext.broadcast(w)

        def run(batches):
            g, ll = np.zeros(m), 0.0
            chain = Chain(n_labels, fixed.value, weights.value)
            for pdf in batches:
                for p in pdf.p:
                    y = [r["label"] for r in p]
                    state, edge, fired = chain.potentials([list(r["f"]) for r in p])
                    a, b, z = forward_backward(state, edge)
                    score = sum(state[i, y[i]] for i in range(len(y))) + sum(edge[y[i - 1], y[i]] for i in range(1, len(y)))
                    ll += score - z
                    prob = np.exp(a + b - z)
                    for i, label, k in fired:
                        g[k] += (y[i] == label) - prob[i, label]
                    for i in range(1, len(y)):
                        pair = np.exp(a[i - 1][:, None] + edge + (state[i] + b[i])[None] - z)
                        for (u, v), k in fixed.value["E."].items():
                            g[k] += (y[i - 1] == u and y[i] == v) - pair[u, v]
            at = np.flatnonzero(g)
            yield pd.DataFrame({"k": np.append(at, -1), "v": np.append(g[at], ll)})

        rows = docs.mapInPandas(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
        g = np.zeros(m)
        inside = rows.k >= 0
        g[rows.k[inside].to_numpy(int)] = rows.v[inside]
        ll = float(rows.v[~inside].sum())
        weights.unpersist()
        return -(ll - w @ w / (2 * sigma**2)), -(g - w / sigma**2)

    w, value, it = lbfgs(evaluate, np.zeros(m), max_iterations, tolerance)
    out = [(int(i), f, None if p is None else int(p), int(label), float(w[i])) for i, f, p, label in names]
    return {"weights": spark.createDataFrame(out, "id int, name string, prev_label_id int, label_id int, weight double"), "stats": spark.createDataFrame([(float(-value), it)], "log_likelihood double, num_iterations int")}


def lbfgs(f, x, max_iter: int, tolerance: float, memory: int = 6):
    value, g = f(x)
    pairs: list = []
    it = 0
    for it in range(1, max_iter + 1):
        if np.linalg.norm(g) <= tolerance * max(1, np.linalg.norm(x)):
            break
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            a = s @ q / (y @ s)
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas)):
            q += s * (a - y @ q / (y @ s))
        step, rate = -q, 1.0 if pairs else 1 / max(1.0, np.linalg.norm(g))
        slope = g @ step
        for _ in range(20):
            new, ng = f(x + rate * step)
            if new <= value + 1e-4 * rate * slope:
                break
            rate /= 2
        s, y = rate * step, ng - g
        if s @ y > 1e-12:
            pairs = [*pairs[-memory + 1 :], (s, y)]
        done = abs(value - new) < tolerance * 1e-4 * max(1, abs(value))
        x, value, g = x + s, new, ng
        if done:
            break
    return x, value, it


def viterbi(state: np.ndarray, edge: np.ndarray) -> tuple[list[int], float]:
    """The best label sequence, and its probability among all."""
    n = len(state)
    best, back = state[0].copy(), np.zeros(state.shape, int)
    for i in range(1, n):
        scores = best[:, None] + edge
        back[i] = scores.argmax(0)
        best = scores.max(0) + state[i]
    path = [int(best.argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i][path[-1]]))
    return path[::-1], float(np.exp(best.max() - forward_backward(state, edge)[2]))


def crf_test_fgen(segments: DataFrame, known: DataFrame, regexes: DataFrame) -> DataFrame:
    """(doc_id, start_pos, f): names of the state features of each position of new documents."""
    rules = [(r.pattern, r.name) for r in regexes.toLocalIterator()]
    t = _tokens(segments).join(known.select("token", F.col("total").alias("_total")), "token", "left")
    parts = [
        F.when(F.col("start_pos") == 0, F.lit("S.")), F.when(F.col("start_pos") == F.col("max_pos"), F.lit("End.")), F.concat(F.lit("W_"), F.col("token")),
        F.when(F.coalesce("_total", F.lit(0)) <= 1, F.lit("U")), *[F.when(F.col("seg_text").rlike(p), F.lit(f"R_{n}")) for p, n in rules],
    ]
    return t.select("doc_id", "start_pos", "seg_text", F.array_compact(F.array(*parts)).alias("f"))


def vcrf_label(features: DataFrame, weights: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, start_pos, seg_text, label, id, prob): the best labels of each document."""
    table: dict = {"E.": {}}
    w = []
    for r in weights.toLocalIterator():
        if r.name == "E.":
            table["E."][(int(r.prev_label_id), int(r.label_id))] = len(w)
        else:
            table.setdefault(r.name, []).append((int(r.label_id), len(w)))
        w.append(r.weight)
    n = labels.agg(F.max("id")).first()[0] + 1
    shared = features.sparkSession.sparkContext.broadcast((table, np.array(w)))
    kind = features.schema["doc_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start_pos")
        state, edge, _ = Chain(n, *shared.value).potentials([list(f) for f in pdf.f])
        path, prob = viterbi(state, edge)
        return pd.DataFrame({"doc_id": pdf.doc_id, "start_pos": pdf.start_pos.astype(np.int32), "seg_text": pdf.seg_text, "id": np.array(path, np.int32), "prob": prob})

    made = features.groupBy("doc_id").applyInPandas(run, f"doc_id {kind}, start_pos int, seg_text string, id int, prob double")
    return made.join(labels, "id").select("doc_id", "start_pos", "seg_text", "label", "id", "prob")


def clean_pattern(p: str) -> str:
    """A pattern without anchors that the engine adds."""
    return re.sub(r"^\^|\$$", "", p)
