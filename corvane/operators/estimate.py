"""Sums over all rows for iterative fits: numpy kernels by partition, sums by group in the JVM.

A fit's state (a few vectors a group) lives on the driver; each iteration is one pass that sends the state
out and adds up what the kernel returns for each group. Groups must therefore be as few as model rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.checks import quoted

#: Groups that a partition sums at a time before it passes partial sums on.
FLUSH = 10_000


def to_numpy(column: pa.Array) -> np.ndarray:
    """A number column as a vector, an array column as a matrix; arrays must have the same length."""
    if pa.types.is_list(column.type):
        n = len(column)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
        if n and len(flat) % n:
            raise ValueError("feature arrays differ in length")
        return flat.reshape(n, -1) if n else flat.reshape(0, 0)
    values = column.to_numpy(zero_copy_only=False)
    return values if values.dtype == object else values.astype(float)


def group_sums(df: DataFrame, groups: list[str], columns: dict[str, Column], kernel: Callable) -> dict[tuple, np.ndarray]:
    """Sum of `kernel(key, arrays)` over all rows, for each group; `arrays` maps names to numpy arrays.

    The kernel is called with some rows of one group at a time and returns a vector whose length is the same
    for all calls of a group.
    """
    keys = [f"_g{i}" for i in range(len(groups))]
    rows = df.select(*[F.col(quoted(g)).alias(k) for g, k in zip(groups, keys)], *[c.alias(n) for n, c in columns.items()])
    kinds = [rows.schema[k].dataType.simpleString() for k in keys]
    fields = list(columns)

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        types = None
        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(k).type for k in keys]
            arrays = {n: to_numpy(batch.column(n)) for n in fields}
            if keys:
                codes: dict[tuple, int] = {}
                code = np.fromiter((codes.setdefault(k, len(codes)) for k in zip(*[batch.column(k).to_pylist() for k in keys])), np.int64, batch.num_rows)
                order = np.argsort(code, kind="stable")
                cuts = np.searchsorted(code[order], np.arange(1, len(codes)))
                parts = list(zip(codes, np.split(order, cuts)))
            else:
                parts = [((), slice(None))]
            for key, index in parts:
                found = np.asarray(kernel(key, {n: a[index] for n, a in arrays.items()}), float)
                held[key] = held[key] + found if key in held else found
            if len(held) > FLUSH:
                yield _rows(held, keys, types)
                held = {}
        if held:
            yield _rows(held, keys, types)

    schema = ", ".join([f"{k} {t}" for k, t in zip(keys, kinds)] + ["pos int", "val double"])
    sums = rows.mapInArrow(run, schema).groupBy(*keys, "pos").agg(F.sum("val").alias("val"))
    out: dict[tuple, dict] = {}
    for r in sums.toLocalIterator():
        out.setdefault(tuple(r[: len(keys)]), {})[r.pos] = r.val
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def _rows(held: dict, keys: list[str], types: list) -> pa.RecordBatch:
    size = [len(v) for v in held.values()]
    which = np.repeat(np.arange(len(held)), size)
    names = list(held)
    columns = [pa.array([names[i][k] for i in which], t) for k, t in enumerate(types)]
    columns += [pa.array(np.concatenate([np.arange(n) for n in size]).astype(np.int32)), pa.array(np.concatenate(list(held.values())))]
    return pa.RecordBatch.from_arrays(columns, names=[*keys, "pos", "val"])


def iterate(df: DataFrame, groups, columns, kernel, start: dict[tuple, dict], step: Callable, max_iter: int) -> dict[tuple, dict]:
    """Passes over the data until each group's state is done.

    `kernel(state, arrays)` sums what `step(state, sums)` needs to give the next state; a state with a
    true "done" takes no further part.
    """
    state = dict(start)
    for _ in range(max_iter):
        going = {k: s for k, s in state.items() if not s.get("done")}
        if not going:
            break
        shared = df.sparkSession.sparkContext.broadcast(going)

        def call(key, arrays, shared=shared):
            s = shared.value.get(key)
            return np.empty(0) if s is None else kernel(s, arrays)

        sums = group_sums(df, groups, columns, call)
        for k in going:
            if k in sums and len(sums[k]):
                state[k] = step(going[k], sums[k])
            else:
                state[k] = going[k] | {"done": True}
        shared.unpersist()
    return state


def tri(k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.tril_indices(k)


def packed(m: np.ndarray) -> np.ndarray:
    return m[np.tril_indices(len(m))]


def unpacked(v: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.tril_indices(k)] = v
    return out + np.tril(out, -1).T


def sym_pinv(a: np.ndarray) -> tuple[np.ndarray, float]:
    """Pseudo-inverse and condition number of a symmetric positive semi-definite matrix."""
    if not np.isfinite(a).all():
        raise ValueError("the design matrix isn't finite")
    w, v = np.linalg.eigh(a)
    keep = w > max(len(a), 1) * np.finfo(float).eps * max(w.max(initial=0), 0)
    inv = (v[:, keep] / w[keep]) @ v[:, keep].T if keep.any() else np.zeros_like(a)
    return inv, float(w.max() / w[keep].min()) if keep.any() and keep.all() else float("inf")


def width_of(df: DataFrame, x: Column) -> int:
    r = df.select(F.size(x).alias("n")).filter("n >= 0").limit(1).first()
    if r is None:
        raise ValueError("no rows to fit")
    return r[0]


def model_frame(df: DataFrame, groups: list[str], rows: list[dict], schema: str) -> DataFrame:
    """A table of models: group columns as in df, then those of the schema."""
    kinds = [f"{quoted(g)} {df.schema[g].dataType.simpleString()}" for g in groups]
    fields = [c.split(" ")[0] for c in schema.split(", ")]
    data = [tuple(r["_key"]) + tuple(plain(r.get(f)) for f in fields) for r in rows]
    return df.sparkSession.createDataFrame(data, ", ".join([*kinds, schema]))


def plain(v):
    """A numpy scalar as a Python number; NaN as null."""
    v = v.item() if isinstance(v, np.generic) else v
    return None if isinstance(v, float) and np.isnan(v) else v


def floats(v) -> list[float] | None:
    return None if v is None else [None if np.isnan(x) else float(x) for x in np.ravel(v)]
