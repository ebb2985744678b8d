"""SQL for model fits: Newton's method written out as common table expressions, matrices inverted by elimination.

Rows are a table `d` of the columns g (group), y, x_0, x_1, ...; parameters are b_0, b_1, ... Sums of the
scores and of the information give the next parameters.
"""

from __future__ import annotations


def inverse(source: str, k: int, keep: list[str]) -> str:
    """Columns v_i_j of the inverse of the matrix a_i_j of each row of `source`, by Gauss-Jordan elimination; `keep` stay."""
    cells = [(i, j) for i in range(k) for j in range(k)]
    kept = ", ".join(keep) + ", " if keep else ""
    sql = f"SELECT {kept}{', '.join(f'CAST(a_{i}_{j} AS DOUBLE) AS a_{i}_{j}' for i, j in cells)}, {', '.join(f'{float(i == j)}::DOUBLE AS v_{i}_{j}' for i, j in cells)} FROM ({source})"
    for p in range(k):
        turn = lambda c: ", ".join(f"{c}_{i}_{j} / a_{p}_{p} AS {c}_{i}_{j}" if i == p else f"{c}_{i}_{j} - a_{i}_{p} * {c}_{p}_{j} / a_{p}_{p} AS {c}_{i}_{j}" for i, j in cells)  # noqa: E731, B023
        sql = f"SELECT {kept}{turn('a')}, {turn('v')} FROM ({sql})"
    return f"SELECT {kept}{', '.join(f'v_{i}_{j}' for i, j in cells)} FROM ({sql})"


def fit(data: str, k: int, let: list[tuple[str, str]], score: list[str], info, start: list[str], steps: int, more: dict[str, str] | None = None) -> str:
    """Common table expressions d (rows), t0, t1, ... (parameters) and f: parameters b_i, inverse information v_i_j, n, and the sums `more`.

    `let` names expressions over a row and the parameters, one after the other; `info(i, j)` is an expression.
    """
    more = {"n": "count(*)"} | (more or {})
    b = [f"b_{i}" for i in range(k)]

    def sums(step: int) -> str:
        rows = f"SELECT d.*, {', '.join(b)} FROM d JOIN t{step} ON d.g IS NOT DISTINCT FROM t{step}.g"
        for name, expression in let:
            rows = f"SELECT *, {expression} AS {name} FROM ({rows})"
        extra = ", ".join(f"{e} AS {n}" for n, e in more.items())
        total = f"{', '.join(f'any_value({x}) AS {x}' for x in b)}, {', '.join(f'sum({e}) AS s_{i}' for i, e in enumerate(score))}, {', '.join(f'sum({info(i, j)}) AS a_{i}_{j}' for i in range(k) for j in range(k))}, {extra}"
        return inverse(f"SELECT g, {total} FROM ({rows}) GROUP BY g", k, ["g", *b, *[f"s_{i}" for i in range(k)], *more])

    parts = [f"d AS MATERIALIZED ({data})", f"t0 AS MATERIALIZED (SELECT g, {', '.join(f'{e} AS b_{i}' for i, e in enumerate(start))} FROM d GROUP BY g)"]
    for n in range(steps):
        moved = ", ".join(f"b_{i} + {' + '.join(f'v_{i}_{j} * s_{j}' for j in range(k))} AS b_{i}" for i in range(k))
        parts.append(f"t{n + 1} AS MATERIALIZED (SELECT g, {moved} FROM ({sums(n)}))")
    parts.append(f"f AS MATERIALIZED ({sums(steps)})")
    return ", ".join(parts)


def rows(columns: dict[str, list[str]], k: int, source: str = "f", keep: str = "g") -> str:
    """One row for each parameter: position p, and the named lists of expressions."""
    lists = ", ".join(f"unnest([{', '.join(e)}]) AS {n}" for n, e in columns.items())
    return f"SELECT {keep}, unnest(range({k})) AS p, {lists} FROM {source}"


def sandwich(k: int, score: list[str], let: list[tuple[str, str]], cluster: str | None = None, scale: str = "1") -> str:
    """Common table expression w: g, b_i, n, and the variances q_i of a sandwich of outer products of scores, by row or cluster."""
    made = "SELECT d.*, f.* EXCLUDE (g) FROM d JOIN f ON d.g IS NOT DISTINCT FROM f.g"
    for name, expression in let:
        made = f"SELECT *, {expression} AS {name} FROM ({made})"
    u = ", ".join(f"{e} AS u_{i}" for i, e in enumerate(score))
    made = f"SELECT g, {u} FROM ({made})" if cluster is None else f"SELECT g, {cluster} AS c, {', '.join(f'sum({e}) AS u_{i}' for i, e in enumerate(score))} FROM ({made}) GROUP BY g, {cluster}"
    meat = f"SELECT g, count(*) AS m, {', '.join(f'sum(u_{i} * u_{j}) AS m_{i}_{j}' for i in range(k) for j in range(k))} FROM ({made}) GROUP BY g"
    var = ", ".join(f"({' + '.join(f'v_{i}_{a} * m_{a}_{b} * v_{b}_{i}' for a in range(k) for b in range(k))}) * {scale} AS q_{i}" for i in range(k))
    return f"w AS (SELECT f.g, m, n, {', '.join(f'b_{i}' for i in range(k))}, {var} FROM f JOIN ({meat}) h ON f.g IS NOT DISTINCT FROM h.g)"


def dot(x: list[str], offset: int = 0) -> str:
    return " + ".join(f"b_{i + offset} * {e}" for i, e in enumerate(x))
