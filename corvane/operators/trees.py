"""Decision trees and random forests, grown level by level from histograms.

Continuous features are cut into bins at quantiles, categorical ones get a bin for each value, ordered by their
mean response. A level's histograms (node, feature, bin, class or moments) are one pass over the data;
the best split of each node is chosen on the driver from histograms alone. Rows find their node by the tree,
which is broadcast, so no row is ever moved. Cost-complexity pruning and surrogates work on the same sums.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.hashing import unit
from corvane.operators.checks import expr, names, quoted
from corvane.operators.estimate import group_sums

#: Values that a categorical feature may have.
LEVELS = 1024


@dataclass
class Node:
    """A node: its class counts or moments [n, sum, sum of squares], and its split, if any."""

    stats: list[float]
    feature: int = -1
    left_bins: list[int] | None = None  # bins that go left
    threshold: float | None = None
    left: int = -1
    right: int = -1
    depth: int = 0
    gain: float = 0.0
    surrogates: list = field(default_factory=list)
    majority_left: bool = True


@dataclass
class Tree:
    nodes: list[Node]
    features: list[str]
    continuous: list[bool]
    bins: list  # cut points or values, by feature
    classes: list | None

    def route(self, codes: np.ndarray) -> np.ndarray:
        """Leaf of each row; code -1 is null: surrogates decide, then the larger side."""
        at = np.zeros(len(codes), int)
        active = np.arange(len(codes))
        while len(active):
            moved = []
            for k in np.unique(at[active]):
                node = self.nodes[k]
                if node.feature < 0:
                    continue
                rows = active[at[active] == k]
                left = go_left(node, codes[rows])
                at[rows] = np.where(left, node.left, node.right)
                moved.append(rows)
            active = np.concatenate(moved) if moved else np.empty(0, int)
        return at

    def to_json(self) -> str:
        return json.dumps({"nodes": [n.__dict__ for n in self.nodes], "features": self.features, "continuous": self.continuous, "bins": self.bins, "classes": self.classes}, default=_json)

    @staticmethod
    def from_json(text: str) -> Tree:
        d = json.loads(text)
        return Tree([Node(**n) for n in d["nodes"]], d["features"], d["continuous"], d["bins"], d["classes"])


def _json(x):
    return x.item() if isinstance(x, np.generic) else str(x)


def go_left(node: Node, codes: np.ndarray) -> np.ndarray:
    code = codes[:, node.feature]
    out = np.isin(code, node.left_bins)
    gap = code < 0
    for feature, bins, agrees in node.surrogates:
        if not gap.any():
            break
        other = codes[:, feature]
        use = gap & (other >= 0)
        out[use] = np.isin(other[use], bins) == agrees
        gap &= other < 0
    out[gap] = node.majority_left
    return out


def impurity(stats: np.ndarray, criterion: str) -> np.ndarray:
    """Impurity times weight of class counts (last axis), or of moments for mse."""
    if criterion == "mse":
        n = np.maximum(stats[..., 0], 1e-300)
        return np.maximum(stats[..., 2] - stats[..., 1] ** 2 / n, 0)
    n = stats.sum(-1)
    p = stats / np.maximum(n, 1e-300)[..., None]
    if criterion == "gini":
        return n * (1 - (p * p).sum(-1))
    if criterion in ("entropy", "infogain", "gainratio"):
        return -n * np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0).sum(-1)
    return n * (1 - p.max(-1))  # misclassification


def weight_of(stats: np.ndarray, criterion: str):
    return stats[..., 0] if criterion == "mse" else stats.sum(-1)


def _bin(c, cuts: list[float]):
    """How many cut points lie below a value."""
    return F.size(F.filter(F.array(*[F.lit(float(v)) for v in cuts]), lambda s: s < c))


@dataclass
class Encoding:
    """How features become bin codes."""

    features: list[str]
    continuous: list[bool]
    bins: list

    def columns(self) -> list:
        out = []
        for name, cont, b in zip(self.features, self.continuous, self.bins):
            c = expr(name)
            if cont:
                c = c.cast("double")
                code = _bin(c, b) if b else F.lit(0)
            else:
                m = F.create_map(*[F.lit(v) for i, x in enumerate(b) for v in (str(x), i)]) if b else None
                code = F.coalesce(m[c.cast("string")], F.lit(-1)) if m is not None else F.lit(-1)
            out.append(F.when(c.isNull(), F.lit(-1)).otherwise(code).cast("double"))
        return out


def expand(df: DataFrame, features, exclude=()) -> list[str]:
    """'*' stands for all columns but the excluded ones."""
    if features == "*" or features == ["*"]:
        return [c for c in df.columns if c not in set(exclude)]
    return names(features)


def encode(df: DataFrame, features: list[str], bins: int) -> Encoding:
    """Quantile bins of continuous features, values of the others; single-valued features are dropped."""
    kept, cont, cuts = [], [], []
    for name in features:
        kind = df.select(expr(name).alias("v")).schema["v"].dataType
        if isinstance(kind, T.DoubleType | T.FloatType | T.DecimalType):
            q = df.select(expr(name).cast("double").alias("v")).approxQuantile("v", [i / bins for i in range(1, bins)], 0.25 / bins)
            r = df.agg(F.max(expr(name).cast("double"))).first()[0]
            b = sorted({v for v in q if r is not None and v < r})
            if not b:
                continue
            kept.append(name), cont.append(True), cuts.append(b)
        else:
            values = [r[0] for r in df.select(expr(name).cast("string").alias("v")).filter("v IS NOT NULL").distinct().limit(LEVELS + 1).toLocalIterator()]
            if len(values) > LEVELS:
                raise ValueError(f"{name} has more than {LEVELS} values: cast it to double")
            if len(values) < 2:
                continue
            kept.append(name), cont.append(False), cuts.append(sorted(values))
    if not kept:
        raise ValueError("no feature has two values")
    return Encoding(kept, cont, cuts)


def grow(rows: DataFrame, enc: Encoding, classes: list | None, criterion: str, max_depth: int, min_split: float, min_bucket: float, n_trees: int = 1, bootstrap: bool = False, n_random: int | None = None, seed: int = 0, surrogates: int = 0, folds: int = 0) -> list[Tree]:
    """Trees from rows (_x codes, _y class number or value, _w weight, _id, _g group).

    All trees of a forest, of all groups and of all left-out folds grow together, a level in one pass. Without
    bootstrap tree t belongs to group t // (folds + 1), and leaves out fold t % (folds + 1) - 1.
    """
    width = len(classes) if classes is not None else 3
    sizes = [len(b) + 1 if c else len(b) for c, b in zip(enc.continuous, enc.bins)]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    total = int(starts[-1])
    trees = [Tree([], enc.features, enc.continuous, enc.bins, classes) for _ in range(n_trees)]
    columns = {"_x": F.col("_x"), "_y": F.col("_y"), "_w": F.col("_w"), "_id": F.col("_id"), "_g": F.col("_g").cast("double")}
    rng = np.random.default_rng(seed)

    def weights(a, t):
        if bootstrap:
            return a["_w"] * poisson(a["_id"], t, seed)
        group, out = divmod(t, folds + 1)
        return a["_w"] * (a["_g"] == group) * (fold_of(a["_id"], folds, seed) != out - 1 if folds else 1.0)

    def moments(y, w):
        if classes is not None:
            m = np.zeros((len(y), width))
            m[np.arange(len(y)), y.astype(int)] = w
            return m
        return np.stack((w, w * y, w * y * y), axis=1)

    def root_kernel(key, a):
        return np.concatenate([moments(a["_y"], weights(a, t)).sum(axis=0) for t in range(n_trees)])

    first = group_sums(rows, [], columns, root_kernel)
    if not first:
        raise ValueError("no rows to train on")
    for tree, s in zip(trees, first[()].reshape(n_trees, width)):
        tree.nodes.append(Node(s.tolist()))
    frontier = [(t, 0) for t in range(n_trees)]
    for depth in range(max_depth):
        frontier = [(t, k) for t, k in frontier if weight_of(np.array(trees[t].nodes[k].stats), criterion) >= min_split and impurity(np.array(trees[t].nodes[k].stats), criterion) > 1e-9]
        if not frontier:
            break
        place = {f: i for i, f in enumerate(frontier)}

        def kernel(key, a, place=place, frontier=frontier):
            """Histograms [node, bin, moments] of all nodes that may split."""
            out = np.zeros((len(frontier), total, width))
            codes = a["_x"].astype(int)
            for t in sorted({t for t, _ in frontier}):
                w = weights(a, t)
                used = np.flatnonzero(w > 0)
                at = trees[t].route(codes[used])
                slot = np.array([place.get((t, k), -1) for k in range(len(trees[t].nodes))])[at]
                used, slot = used[slot >= 0], slot[slot >= 0]
                if not len(used):
                    continue
                m = moments(a["_y"][used], w[used])
                for f in range(len(enc.features)):
                    c = codes[used, f]
                    good = c >= 0
                    np.add.at(out, (slot[good], starts[f] + c[good]), m[good])
            return out.ravel()

        hist = group_sums(rows, [], columns, kernel)[()].reshape(len(frontier), total, width)
        after = []
        splits = {}
        for (t, k), h in zip(frontier, hist):
            node = trees[t].nodes[k]
            chosen = rng.choice(len(enc.features), n_random, replace=False) if n_random else range(len(enc.features))
            best = best_split(node, h, starts, chosen, enc, criterion, min_bucket)
            if best is None:
                continue
            gain, f, bins, threshold, left, right = best
            nodes = trees[t].nodes
            node.feature, node.left_bins, node.threshold, node.gain = int(f), [int(b) for b in bins], threshold, float(gain)
            node.majority_left = bool(weight_of(left, criterion) >= weight_of(right, criterion))
            # rows with a null go to the larger side
            rest = np.array(node.stats) - left - right
            left, right = (left + rest, right) if node.majority_left else (left, right + rest)
            node.left, node.right = len(nodes), len(nodes) + 1
            nodes += [Node(left.tolist(), depth=depth + 1), Node(right.tolist(), depth=depth + 1)]
            after += [(t, node.left), (t, node.right)]
            splits[(t, k)] = node
        if surrogates and splits:
            find_surrogates(rows, columns, trees, splits, starts, total, enc, surrogates, weights)
        frontier = after
    return trees


def fold_of(ids: np.ndarray, folds: int, seed: int) -> np.ndarray:
    """Fold of each row, by a hash of its id."""
    return np.minimum((unit(ids.astype(np.int64), 15_485_863 + seed) * folds).astype(int), folds - 1)


def poisson(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Bootstrap weight of each row in a tree: a Poisson deviate of mean 1, by a hash of the row's id."""

    u = unit(ids.astype(np.int64), tree * 1_000_003 + seed)
    return np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)]), u).astype(float)


def best_split(node, h, starts, chosen, enc, criterion, min_bucket):
    whole, best = np.array(node.stats), None
    for f in chosen:
        g = h[starts[f] : starts[f + 1]]
        order = np.arange(len(g))
        if not enc.continuous[f]:  # values in order of their mean response, or of the commonest class's share
            n = weight_of(g, criterion)
            mean = g[:, 1] / np.maximum(n, 1e-300) if criterion == "mse" else g[:, int(whole.argmax())] / np.maximum(n, 1e-300)
            order = np.argsort(mean, kind="stable")
            order = order[n[order] > 0]
        if len(order) < 2:
            continue
        left = np.cumsum(g[order], axis=0)[:-1]
        known = g.sum(axis=0)
        right = known - left
        nl, nr = weight_of(left, criterion), weight_of(right, criterion)
        gain = impurity(known, criterion) - impurity(left, criterion) - impurity(right, criterion)
        if criterion == "gainratio":
            p, q = nl / np.maximum(nl + nr, 1e-300), nr / np.maximum(nl + nr, 1e-300)
            with np.errstate(all="ignore"):
                info = -(np.where(p > 0, p * np.log2(p), 0) + np.where(q > 0, q * np.log2(q), 0)) * (nl + nr)
            gain = np.divide(gain, info, out=np.zeros_like(gain), where=info > 1e-12)
        ok = (nl >= min_bucket) & (nr >= min_bucket)
        if not ok.any():
            continue
        i = int(np.argmax(np.where(ok, gain, -np.inf)))
        if gain[i] > 1e-9 and (best is None or gain[i] > best[0] + 1e-12):
            threshold = float(enc.bins[f][i]) if enc.continuous[f] else None
            best = (gain[i], f, order[: i + 1], threshold, left[i], right[i])
    return best


def find_surrogates(rows, columns, trees, splits, starts, total, enc, most, weights):
    """For each split the other features' splits that agree with it most often, beyond following the larger side."""
    keys = list(splits)

    def kernel(key, a):
        """Per split and bin: weight that goes left, and right."""
        out = np.zeros((len(keys), total, 2))
        codes = a["_x"].astype(int)
        for i, (t, k) in enumerate(keys):
            node = splits[(t, k)]
            inside = _inside(trees[t], k, codes)
            inside &= codes[:, node.feature] >= 0
            c = codes[inside]
            w = weights({n: v[inside] for n, v in a.items()}, t)
            side = np.where(np.isin(c[:, node.feature], node.left_bins), 0, 1)
            for f in range(len(enc.features)):
                if f != node.feature:
                    good = c[:, f] >= 0
                    np.add.at(out, (i, starts[f] + c[good, f], side[good]), w[good])
        return out.ravel()

    sums = group_sums(rows, [], columns, kernel)[()].reshape(len(keys), total, 2)
    for s, key in zip(sums, keys):
        node, found = splits[key], []
        for f in range(len(enc.features)):
            g = s[starts[f] : starts[f + 1]]
            if f == node.feature or g.sum() == 0:
                continue
            floor = max(g.sum(axis=0))
            if enc.continuous[f]:
                left = np.cumsum(g, axis=0)
                agree = left[:, 0] + left[-1, 1] - left[:, 1]
                against = left[:, 1] + left[-1, 0] - left[:, 0]
                i, forward = (int(agree.argmax()), True) if agree.max() >= against.max() else (int(against.argmax()), False)
                score, bins = max(agree.max(), against.max()), list(range(i + 1))
            else:
                bins, forward = [int(i) for i in np.flatnonzero(g[:, 0] > g[:, 1])], True
                score = g.max(axis=1).sum()
            if score > floor:
                found.append((float(score), f, bins, forward))
        found.sort(key=lambda x: (-x[0], x[1]))
        node.surrogates = [[f, bins, forward] for _, f, bins, forward in found[:most]]


def _inside(tree: Tree, target: int, codes: np.ndarray) -> np.ndarray:
    """Rows that pass a node."""
    parent = {}
    for i, n in enumerate(tree.nodes):
        if n.feature >= 0:
            parent[n.left], parent[n.right] = (i, True), (i, False)
    out = np.ones(len(codes), bool)
    while target in parent:
        up, is_left = parent[target]
        out &= go_left(tree.nodes[up], codes) == is_left
        target = up
    return out


def pruning_steps(tree: Tree, criterion: str, most: int = 20) -> list[float]:
    """Complexity parameters between which other splits go: 0, and up to `most` spread over those at which one is cut."""
    kind = "mse" if criterion == "mse" else "misclass"
    risk0 = float(impurity(np.array(tree.nodes[0].stats), kind)) or 1.0
    found: set[float] = set()

    def walk(k):
        node = tree.nodes[k]
        own = float(impurity(np.array(node.stats), kind))
        if node.feature < 0:
            return own, 0
        (a, n), (b, m) = walk(node.left), walk(node.right)
        found.add(max((own - a - b) / risk0 / (n + m + 1), 0.0))
        return a + b, n + m + 1

    walk(0)
    edges = np.array(sorted(found))
    between = np.sqrt(np.maximum(edges[:-1], 1e-12) * edges[1:]) if len(edges) > 1 else edges
    return [0.0, *sorted({float(v) for v in between[np.unique(np.linspace(0, len(between) - 1, min(most, len(between))).astype(int))]})] if len(between) else [0.0]


def prune(tree: Tree, cp: float, criterion: str) -> Tree:
    """Cuts splits whose complexity-penalised risk isn't below that of a leaf."""
    risk0 = float(impurity(np.array(tree.nodes[0].stats), "mse" if criterion == "mse" else "misclass")) or 1.0

    def walk(k):
        node = tree.nodes[k]
        own = float(impurity(np.array(node.stats), "mse" if criterion == "mse" else "misclass"))
        if node.feature < 0:
            return own, 0
        (a, n), (b, m) = walk(node.left), walk(node.right)
        if own <= a + b + cp * risk0 * (n + m + 1):
            node.feature = node.left = node.right = -1
            node.left_bins, node.threshold, node.surrogates = None, None, []
            return own, 0
        return a + b, n + m + 1

    walk(0)
    keep, nodes = {}, []

    def copy(k):
        keep[k] = len(nodes)
        nodes.append(tree.nodes[k])
        node = tree.nodes[k]
        if node.feature >= 0:
            left, right = node.left, node.right
            copy(left)
            copy(right)
            node.left, node.right = keep[left], keep[right]

    copy(0)
    return Tree(nodes, tree.features, tree.continuous, tree.bins, tree.classes)


def prepared(df, y, enc, classes, weights, use_nulls):
    from corvane.operators.iteration import cut

    label = F.coalesce(*[F.when(expr(y) == F.lit(c), F.lit(float(i))) for i, c in enumerate(classes)]) if classes is not None else expr(y).cast("double")
    rows = df.select(F.array(*enc.columns()).alias("_x"), label.alias("_y"), (expr(weights).cast("double") if weights else F.lit(1.0)).alias("_w"), F.monotonically_increasing_id().cast("double").alias("_id"), (F.col("_group") if "_group" in df.columns else F.lit(0)).alias("_g")).filter("_y IS NOT NULL")
    if not use_nulls:
        rows = rows.filter(~F.exists("_x", lambda e: e < 0))
    return cut(rows)


def is_classification(df: DataFrame, y: str) -> bool:
    return not isinstance(df.select(expr(y).alias("y")).schema["y"].dataType, T.DoubleType | T.FloatType | T.DecimalType)


def label_values(df, y):
    return sorted(r[0] for r in df.select(expr(y).alias("y")).filter("y IS NOT NULL").distinct().toLocalIterator())


def tree_train(
    df: DataFrame,
    y: str,
    features="*",
    exclude=(),
    split_criterion: str = "gini",
    groups=None,
    weights: str | None = None,
    max_depth: int = 10,
    min_split: int = 20,
    min_bucket: int | None = None,
    num_splits: int = 100,
    cp: float = 0.01,
    max_surrogates: int = 0,
    n_folds: int = 0,
    seed: int = 0,
) -> DataFrame:
    """A tree for each group: group columns, tree (JSON), depth, num_leaves, importance, cp, cv (cp, cv_error_avg, cv_error_stddev).

    A response that isn't a floating-point number is a class. Rows with null features are left out unless
    surrogates are asked for; null group values are left out. Trees of all groups grow together. With `n_folds` of 2 or
    more each tree is pruned by the complexity parameter of at least `cp` whose error on left-out folds is the least.
    """
    groups = names(groups)
    listed = expand(df, features, [*exclude, y, *groups, *([weights] if weights else [])])
    keys = [()]
    if groups:
        table = df.select(*[quoted(g) for g in groups]).dropna().distinct()
        keys = [tuple(r) for r in table.collect()]  # one for each model
        if not keys:
            raise ValueError("no group to train on")
        numbered = df.sparkSession.createDataFrame([(*key, i) for i, key in enumerate(keys)], ", ".join([*[f"{quoted(g)} {df.schema[g].dataType.simpleString()}" for g in groups], "_group int"]))
        df = df.join(F.broadcast(numbered), groups)
    classes = label_values(df, y) if is_classification(df, y) else None
    criterion = "mse" if classes is None else split_criterion
    enc = encode(df, listed, num_splits)
    rows = prepared(df, y, enc, classes, weights, max_surrogates > 0)
    bucket = min_bucket if min_bucket is not None else max(1, min_split // 3)
    folds = n_folds if n_folds >= 2 else 0
    trees = grow(rows, enc, classes, criterion, max_depth, min_split, bucket, n_trees=len(keys) * (folds + 1), seed=seed, surrogates=max_surrogates, folds=folds)
    own = trees[:: folds + 1]
    chosen, tables = [cp] * len(keys), [None] * len(keys)
    if folds:
        steps = [sorted({cp, *[v for v in pruning_steps(t, criterion) if v > cp]}) for t in own]
        tables = _validated(rows, trees, steps, criterion, classes, folds, seed)
        chosen = [min(reversed(t), key=lambda r: r[1])[0] for t in tables]
    out = []
    for key, tree, value, table in zip(keys, own, chosen, tables):
        if value > 0:
            tree = prune(tree, value, criterion)
        leaves = sum(n.feature < 0 for n in tree.nodes)
        importance = [0.0] * len(tree.features)
        for n in tree.nodes:
            if n.feature >= 0:
                importance[n.feature] += n.gain
        out.append((*key, tree.to_json(), max(n.depth for n in tree.nodes), leaves, dict(zip(tree.features, map(float, importance))), float(value), table))
    kinds = [f"{quoted(g)} {df.schema[g].dataType.simpleString()}" for g in groups]
    return df.sparkSession.createDataFrame(out, ", ".join([*kinds, "tree string, tree_depth int, num_leaves int, importance map<string,double>, cp double, cv array<struct<cp:double,cv_error_avg:double,cv_error_stddev:double>>"]))


def _validated(rows: DataFrame, trees: list[Tree], steps: list[list[float]], criterion: str, classes: list | None, folds: int, seed: int) -> list[list[tuple]]:
    """For each group (cp, mean error, its deviation) over the left-out folds of the trees pruned by each step: one pass."""
    pruned = {(g, f, i): prune(Tree.from_json(trees[g * (folds + 1) + f + 1].to_json()), v, criterion) for g, mine in enumerate(steps) for i, v in enumerate(mine) for f in range(folds)}
    places = {k: n for n, k in enumerate(pruned)}
    shared = rows.sparkSession.sparkContext.broadcast(list(pruned.items()))

    def kernel(key, a):
        out = np.zeros((len(places), 2))
        codes, fold = a["_x"].astype(int), fold_of(a["_id"], folds, seed)
        for n, ((g, f, _), tree) in enumerate(shared.value):
            mine = (a["_g"] == g) & (fold == f)
            if mine.any():
                s = np.array([x.stats for x in tree.nodes])[tree.route(codes[mine])]
                y, w = a["_y"][mine], a["_w"][mine]
                wrong = s.argmax(1) != y if classes is not None else (s[:, 1] / np.maximum(s[:, 0], 1e-300) - y) ** 2
                out[n] = (wrong * w).sum(), w.sum()
        return out.ravel()

    columns = {"_x": F.col("_x"), "_y": F.col("_y"), "_w": F.col("_w"), "_id": F.col("_id"), "_g": F.col("_g").cast("double")}
    s = group_sums(rows, [], columns, kernel)[()].reshape(-1, 2)
    error = s[:, 0] / np.maximum(s[:, 1], 1e-300)
    out = []
    for g, mine in enumerate(steps):
        by = [np.array([error[places[g, f, i]] for f in range(folds)]) for i in range(len(mine))]
        out.append([(float(v), float(e.mean()), float(e.std(ddof=1))) for v, e in zip(mine, by)])
    return out


def _predict(df: DataFrame, trees: list[Tree], id_col: str, kind: str) -> DataFrame:
    enc = Encoding(trees[0].features, trees[0].continuous, trees[0].bins)
    classes = trees[0].classes
    shared = df.sparkSession.sparkContext.broadcast(trees)
    rows = df.select(F.col(quoted(id_col)).alias("_key"), F.array(*enc.columns()).alias("_x"))
    key_kind = rows.schema["_key"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            codes = np.vstack(pdf._x).astype(int) if len(pdf) else np.empty((0, len(enc.features)), int)
            if classes is None:
                value = np.mean([np.array([n.stats[1] / max(n.stats[0], 1e-300) for n in t.nodes])[t.route(codes)] for t in shared.value], axis=0)
                yield pd.DataFrame({"key": pdf._key, "value": value})
                continue
            share = np.zeros((len(codes), len(classes)))
            for t in shared.value:
                s = np.array([n.stats for n in t.nodes])[t.route(codes)]
                if len(shared.value) > 1:
                    share[np.arange(len(s)), s.argmax(1)] += 1 / len(shared.value)
                else:
                    share += s / np.maximum(s.sum(1, keepdims=True), 1e-300)
            yield pd.DataFrame({"key": pdf._key, "value": [r.tolist() for r in share]})

    made = rows.mapInPandas(run, f"key {key_kind}, value {'double' if classes is None else 'array<double>'}")
    if classes is None:
        return made.select(F.col("key").alias(id_col), F.col("value").alias("prediction"))
    labels = F.array(*[F.lit(str(c)) for c in classes])
    if kind == "prob":
        return made.select(F.col("key").alias(id_col), *[F.col("value")[i].alias(f"prob_{c}") for i, c in enumerate(classes)])
    return made.select(F.col("key").alias(id_col), labels[F.array_position("value", F.array_max("value")).cast("int") - 1].alias("prediction"))


def tree_predict(model: DataFrame, df: DataFrame, id_col: str, kind: str = "response") -> DataFrame:
    """(id, prediction), or the probabilities of the classes with kind "prob". A model without groups."""
    return _predict(df, [Tree.from_json(model.first().tree)], id_col, kind)


def tree_display(model: DataFrame, dot: bool = False) -> str:
    """The tree as text, or as a dot graph."""
    t = Tree.from_json(model.first().tree)
    return dot_text(t) if dot else plain_text(t)


def _condition(t: Tree, n: Node) -> str:
    name = t.features[n.feature]
    return f"{name} <= {n.threshold:g}" if n.threshold is not None else f"{name} in {{{', '.join(str(t.bins[n.feature][b]) for b in n.left_bins)}}}"


def _label(t: Tree, n: Node) -> str:
    return f"{n.stats[1] / max(n.stats[0], 1e-300):g}" if t.classes is None else str(t.classes[int(np.argmax(n.stats))])


def plain_text(t: Tree, k: int = 0, indent: str = "") -> str:
    n = t.nodes[k]
    stats = ", ".join(f"{s:g}" for s in n.stats)
    if n.feature < 0:
        return f"{indent}({k}) [{stats}] -> {_label(t, n)}\n"
    return f"{indent}({k}) [{stats}] {_condition(t, n)}\n" + plain_text(t, n.left, indent + "   ") + plain_text(t, n.right, indent + "   ")


def dot_text(t: Tree) -> str:
    lines = ["digraph tree {"]
    for k, n in enumerate(t.nodes):
        lines.append(f'  n{k} [label="{_condition(t, n) if n.feature >= 0 else _label(t, n)}"' + (", shape=box" if n.feature < 0 else "") + "];")
        if n.feature >= 0:
            lines += [f'  n{k} -> n{n.left} [label="yes"];', f'  n{k} -> n{n.right} [label="no"];']
    return "\n".join([*lines, "}"])


def tree_surr_display(model: DataFrame) -> str:
    """The surrogate splits of each split."""
    t = Tree.from_json(model.first().tree)
    lines = []
    for k, n in enumerate(t.nodes):
        if n.feature >= 0:
            lines.append(f"({k}) {_condition(t, n)}")
            for f, bins, forward in n.surrogates:
                what = f"<= {t.bins[f][min(max(bins), len(t.bins[f]) - 1)]:g}" if t.continuous[f] else "in {" + ", ".join(str(t.bins[f][b]) for b in bins) + "}"
                lines.append(f"      {t.features[f]} {what}{'' if forward else ' (reversed)'}")
    return "\n".join(lines)


def forest_train(df: DataFrame, y: str, features="*", exclude=(), num_trees: int = 20, num_random_features: int | None = None, importance: bool = True, num_permutations: int = 1, max_depth: int = 10, min_split: int = 20, min_bucket: int | None = None, num_splits: int = 20, seed: int = 0, sample_ratio: float = 1.0) -> dict[str, DataFrame]:
    """{model, summary, importance}: bootstrap by Poisson weights; the error is that of out-of-bag rows (weight 0).

    A `sample_ratio` below 1 trains on that share of the rows, drawn at random.

    Importance of a feature: how much the out-of-bag error grows when its values are exchanged among all rows.
    """
    classes = label_values(df, y) if is_classification(df, y) else None
    listed = expand(df, features, [*exclude, y])
    enc = encode(df, listed, num_splits)
    m = len(enc.features)
    n_random = num_random_features or max(1, int(math.sqrt(m)) if classes is not None else m // 3)
    if not 0 < sample_ratio <= 1:
        raise ValueError("sample_ratio lies in 0..1")
    rows = prepared(df if sample_ratio == 1 else df.sample(sample_ratio, seed), y, enc, classes, None, True)
    bucket = min_bucket if min_bucket is not None else max(1, min_split // 3)
    trees = grow(rows, enc, classes, "mse" if classes is None else "gini", max_depth, min_split, bucket, num_trees, True, min(n_random, m), seed)
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(trees)

    def vote(codes, ids, ts):
        """Sum of votes of the trees for which each row is out of bag."""
        out = np.zeros((len(codes), len(classes) if classes is not None else 1))
        seen = np.zeros(len(codes))
        for t, tree in enumerate(ts):
            oob = poisson(ids, t, seed) == 0
            if not oob.any():
                continue
            s = np.array([n.stats for n in tree.nodes])[tree.route(codes[oob])]
            if classes is not None:
                out[np.flatnonzero(oob), s.argmax(1)] += 1
            else:
                out[oob, 0] += s[:, 1] / np.maximum(s[:, 0], 1e-300)
            seen[oob] += 1
        return out, seen

    sizes = [len(b) + 2 if c else len(b) + 1 for c, b in zip(enc.continuous, enc.bins)]
    marginals = group_sums(rows, [], {"_x": F.col("_x")}, lambda key, a: np.concatenate([np.bincount(a["_x"][:, f].astype(int) + 1, minlength=n) for f, n in enumerate(sizes)]))[()]
    shares = [np.cumsum(v) / v.sum() for v in np.split(marginals, np.cumsum(sizes)[:-1])]

    def drawn(f, ids, p):
        """A feature's values in another order: each row draws from all rows' values, by a hash of its id."""
        return np.searchsorted(shares[f], unit(ids.astype(np.int64), seed + 7919 * (p + 1) + 104729 * f)) - 1

    def error_kernel(key, a):
        """[rows, errors, errors with feature 0 permuted, ...]."""
        codes = a["_x"].astype(int)
        found = []
        for f in range(-1, m if importance else 0):
            wrong = n = 0.0
            for p in range(num_permutations if f >= 0 else 1):
                c = codes
                if f >= 0:
                    c = codes.copy()
                    c[:, f] = drawn(f, a["_id"], p)
                v, seen = vote(c, a["_id"], shared.value)
                ok = seen > 0
                n += ok.sum()
                wrong += (v[ok].argmax(1) != a["_y"][ok]).sum() if classes is not None else ((v[ok, 0] / seen[ok] - a["_y"][ok]) ** 2).sum()
            if f < 0:
                found.append(n)
            found.append(wrong / (num_permutations if f >= 0 else 1))
        return np.array(found)

    s = group_sums(rows, [], {"_x": F.col("_x"), "_y": F.col("_y"), "_id": F.col("_id")}, error_kernel)[()]
    base = s[1] / max(s[0], 1)
    model = spark.createDataFrame([(i + 1, t.to_json()) for i, t in enumerate(trees)], "sample_id int, tree string")
    summary = spark.createDataFrame([(num_trees, int(s[0]), float(base), classes is not None)], "num_trees int, oob_rows long, oob_error double, is_classification boolean")
    scores = [(name, float(s[2 + i] / max(s[0], 1) - base)) for i, name in enumerate(enc.features)] if importance else []
    return {"model": model, "summary": summary, "importance": spark.createDataFrame(scores, "feature string, importance double")}


def forest_predict(model: dict[str, DataFrame], df: DataFrame, id_col: str, kind: str = "response") -> DataFrame:
    """Majority vote (or mean), or shares of votes with kind "prob"."""
    trees = [Tree.from_json(r.tree) for r in model["model"].orderBy("sample_id").toLocalIterator()]
    return _predict(df, trees, id_col, kind)


def get_tree(model: dict[str, DataFrame], sample_id: int, dot: bool = False) -> str:
    t = Tree.from_json(model["model"].filter(F.col("sample_id") == sample_id).first().tree)
    return dot_text(t) if dot else plain_text(t)


def get_tree_surr(model: dict[str, DataFrame], sample_id: int) -> str:
    return tree_surr_display(model["model"].filter(F.col("sample_id") == sample_id))


# the older interfaces


def c45_train(df: DataFrame, features, y: str, split_criterion: str = "infogain", max_depth: int = 10, min_split: int = 2, confidence_level: float = 100.0, missing: str = "explicit") -> DataFrame:
    """C4.5 with infogain, gainratio or gini. missing: "explicit" makes null a value of its own, "ignore" leaves such rows out."""
    listed = names(features)
    used = df
    if missing == "explicit":
        used = df.select("*")
        for c in listed:
            if isinstance(df.schema[c].dataType, T.StringType):
                used = used.withColumn(c, F.coalesce(F.col(quoted(c)), F.lit("(missing)")))
    return tree_train(used, y, listed, (), split_criterion, max_depth=max_depth, min_split=min_split, min_bucket=1, cp=0.0 if confidence_level >= 100 else 1 - confidence_level / 100)


def c45_classify(model: DataFrame, df: DataFrame, id_col: str) -> DataFrame:
    return tree_predict(model, df, id_col)


def c45_score(model: DataFrame, df: DataFrame, id_col: str, y: str) -> DataFrame:
    """(score): share of rows that the tree predicts right."""
    p = tree_predict(model, df, id_col).join(df.select(F.col(quoted(id_col)), expr(y).cast("string").alias("_y")), id_col)
    return p.agg(F.avg(F.when(F.col("prediction") == F.col("_y"), 1.0).otherwise(0.0)).alias("score"))


def c45_genrule(model: DataFrame) -> list[str]:
    """A rule for each leaf."""
    t = Tree.from_json(model.first().tree)
    out = []

    def walk(k, conditions):
        n = t.nodes[k]
        if n.feature < 0:
            out.append(f"IF {' AND '.join(conditions) or 'true'} THEN {_label(t, n)}")
            return
        c = _condition(t, n)
        walk(n.left, [*conditions, c])
        walk(n.right, [*conditions, f"NOT ({c})"])

    walk(0, [])
    return out


def rf_train(df: DataFrame, features, y: str, num_trees: int = 10, features_per_node: int | None = None, max_depth: int = 10, min_split: int = 2, seed: int = 0) -> dict[str, DataFrame]:
    return forest_train(df, y, names(features), (), num_trees, features_per_node, False, 1, max_depth, min_split, 1, seed=seed)


def rf_score(model: dict[str, DataFrame], df: DataFrame, id_col: str, y: str) -> DataFrame:
    p = forest_predict(model, df, id_col).join(df.select(F.col(quoted(id_col)), expr(y).cast("string").alias("_y")), id_col)
    return p.agg(F.avg(F.when(F.col("prediction") == F.col("_y"), 1.0).otherwise(0.0)).alias("score"))


def c45_display(model: DataFrame, max_depth: int | None = None) -> str:
    """The tree as text, down to a depth."""
    t = Tree.from_json(model.first().tree)
    if max_depth is not None:
        for n in t.nodes:
            if n.depth >= max_depth:
                n.feature = -1
    return plain_text(t)


def rf_display(model: dict[str, DataFrame], tree_ids: list[int] | None = None) -> str:
    """Trees of a forest as text; all of them without ids."""
    ids = tree_ids or [r.sample_id for r in model["model"].select("sample_id").orderBy("sample_id").toLocalIterator()]
    return "\n".join(f"tree {i}\n{get_tree(model, i)}" for i in ids)


rf_classify = forest_predict
