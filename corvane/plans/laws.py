"""SQL of probability laws, from their definitions: sums, series and bisection instead of the library's special functions.

`SQL` has, by function name, a query for the parameters that the catalog takes; x (column `x`) runs over the
distinct quantities over ten, or over 51 where a probability is asked for.
"""

from __future__ import annotations

_X = "SELECT DISTINCT l_quantity / 10 AS x FROM lineitem"
_U = "SELECT DISTINCT l_quantity / 51 AS x FROM lineitem"

SQL: dict[str, str] = {}


def _plain(name: str, expression: str, unit: bool = False) -> None:
    SQL[name] = f"SELECT round(x, 6) AS x, round(CAST({expression} AS DOUBLE), 6) + 0.0 AS p FROM ({_U if unit else _X})"


def _sum(n: str, term: str) -> str:
    """Sum of a term in k for k from 0 to n - 1."""
    return f"list_sum(list_transform(range(CAST({n} AS BIGINT)), lambda k: {term}))"


def _phi(z: str) -> str:
    return f"exp(-({z}) * ({z}) / 2) / sqrt(2 * pi())"


def _normal(z: str) -> str:
    """The normal law's cdf by its power series, which converges everywhere."""
    term = f"exp((2 * k + 1) * ln(abs({z}) + 1e-300::DOUBLE) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))"
    return f"(0.5::DOUBLE + sign({z}) * {_phi(z)} * {_sum('140', term)})"


def _bisected(name: str, cdf, low: float, high: float, outer: str = "{}") -> None:
    """Quantile by 70 halvings of an interval."""
    middle = "((lo + hi) / 2)"
    SQL[name] = (
        f"WITH RECURSIVE s AS (SELECT x, {low}::DOUBLE AS lo, {high}::DOUBLE AS hi, 0 AS n FROM ({_U}) UNION ALL "
        f"SELECT x, CASE WHEN f < x THEN (lo + hi) / 2 ELSE lo END, CASE WHEN f < x THEN hi ELSE (lo + hi) / 2 END, n + 1 FROM (SELECT *, {cdf(middle)} AS f FROM s WHERE n < 70)) "
        f"SELECT round(x, 6) AS x, round({outer.format('lo')}, 6) + 0.0 AS p FROM s WHERE n = 70"
    )


def _discrete(family: str, mass: str, at_integers: bool = False) -> None:
    """pmf, cdf and quantile of a law on 0, 1, ... from its mass at k. Quantiles are rounded down below one half, up from there."""
    at_x = mass.replace("(k", "(x").replace("k)", "x)").replace(" k ", " x ")
    _plain(f"{family}_pmf", f"CASE WHEN x = floor(x) THEN {at_x} ELSE 0 END" if at_integers else at_x)
    _plain(f"{family}_cdf", _sum("floor(x) + 1", mass))
    SQL[f"{family}_quantile"] = (
        f"WITH c AS (SELECT k, sum({mass}) OVER (ORDER BY k) AS f FROM range(100) t(k)), "
        f"q AS (SELECT x, (SELECT min(k) FROM c WHERE f >= x) AS b FROM ({_U})) "
        "SELECT round(x, 6) AS x, CAST(CASE WHEN x < 0.5 AND f > x THEN greatest(b - 1, 0) ELSE b END AS DOUBLE) AS p FROM q JOIN c ON b = k"
    )


_discrete("poisson", "exp((k) * ln(3) - 3 - lgamma(k + 1))")
_discrete("binomial", "exp(lgamma(11) - lgamma(k + 1) - lgamma(greatest(10 - (k), 0) + 1) + (k) * ln(0.4::DOUBLE) + (10 - (k)) * ln(0.6::DOUBLE)) * CASE WHEN (k) > 10 THEN 0 ELSE 1 END")
_discrete("negative_binomial", "exp(lgamma(3 + (k)) - lgamma(3) - lgamma(k + 1) + 3 * ln(0.4::DOUBLE) + (k) * ln(0.6::DOUBLE))")
_LC = "lgamma({0} + 1) - lgamma({1} + 1) - lgamma(greatest({0} - {1}, 0) + 1)"
_discrete("hypergeometric", f"exp({_LC.format('5', '(k)')} + {_LC.format('25', '(10 - least((k), 10))')} - ({_LC.format('30', '10')})) * CASE WHEN (k) > 5 THEN 0 ELSE 1 END", True)
_plain("geometric_pmf", "0.4::DOUBLE * pow(0.6::DOUBLE, x)")
_plain("geometric_quantile", "CASE WHEN x < 0.4 THEN 0 ELSE ln(1 - x) / ln(0.6::DOUBLE) - 1 END", True)
_plain("bernoulli_pmf", "CASE WHEN x = 0 THEN 0.6 WHEN x = 1 THEN 0.4 ELSE 0 END")
_plain("bernoulli_quantile", "CASE WHEN x <= 0.6 THEN 0 ELSE 1 END", True)

_plain("cauchy_quantile", "1 + 2 * tan(pi() * (x - 0.5))", True)
_plain("extreme_value_pdf", "exp((1 - x) / 2 - exp((1 - x) / 2)) / 2")
_plain("laplace_quantile", "CASE WHEN x < 0.5 THEN 1 + 2 * ln(2 * x) ELSE 1 - 2 * ln(2 - 2 * x) END", True)
_plain("logistic_pdf", "exp((1 - x) / 2) / (2 * pow(1 + exp((1 - x) / 2), 2))")
_plain("pareto_pdf", "CASE WHEN x < 1 THEN 0 ELSE 2 / pow(x, 3) END")
_plain("pareto_quantile", "1 / sqrt(1 - x)", True)
_plain("rayleigh_quantile", "sqrt(-18 * ln(1 - x))", True)
_plain("triangular_pdf", "CASE WHEN x < 1 OR x > 4 THEN 0 WHEN x < 2 THEN 2 * (x - 1) / 3 ELSE (4 - x) / 3 END")
_plain("triangular_quantile", "CASE WHEN x < 1.0 / 3 THEN 1 + sqrt(3 * x) ELSE 4 - sqrt(6 * (1 - x)) END", True)
_plain("uniform_pdf", "CASE WHEN x < 1 OR x > 2 THEN 0 ELSE 1 END")
_plain("weibull_pdf", "exp(-x / 2) / 2")
_plain("weibull_quantile", "-2 * ln(1 - x)", True)

_plain("beta_pdf", "2 * (1 - x)", True)
_plain("beta_quantile", "1 - sqrt(1 - x)", True)
_plain("gamma_pdf", "exp(-x / 2) / 2")
_plain("gamma_quantile", "-2 * ln(1 - x)", True)
_plain("inverse_gamma_cdf", "exp(-2 / x)")
_plain("inverse_gamma_pdf", "2 / (x * x) * exp(-2 / x)")
_plain("inverse_gamma_quantile", "-2 / ln(x)", True)
_plain("fisher_f_pdf", "1 / (sqrt(x) * pow(x + 2, 1.5))")
_plain("fisher_f_quantile", "2 * x * x / (1 - x * x)", True)
_plain("chi_squared_pdf", "sqrt(x / (2 * pi())) * exp(-x / 2)")
_bisected("chi_squared_quantile", lambda v: f"2 * {_normal(f'sqrt({v})')} - 1 - sqrt(2 * {v} / pi()) * exp(-{v} / 2)", 0, 60)
_plain("students_t_pdf", "2 / (sqrt(3) * pi() * pow(1 + x * x / 3, 2))")
_bisected("students_t_quantile", lambda v: f"0.5 + ({v} / sqrt(3) / (1 + {v} * {v} / 3) + atan({v} / sqrt(3))) / pi()", -1000, 1000)
_plain("normal_cdf", _normal("((x - 1) / 2)"))
_bisected("normal_quantile", _normal, -6, 6, "1 + 2 * {}")
_plain("lognormal_cdf", _normal("((ln(x) - 1) / 2)"))
_plain("lognormal_pdf", f"{_phi('(ln(x) - 1) / 2')} / (2 * x)")
_bisected("lognormal_quantile", _normal, -6, 6, "exp(1 + 2 * {})")
_plain(
    "kolmogorov_cdf",
    f"CASE WHEN x < 1 THEN sqrt(2 * pi()) / x * {_sum('60', 'exp(-(2 * k + 1) * (2 * k + 1) * pi() * pi() / (8 * x * x))')} "
    f"ELSE 1 - 2 * {_sum('60', 'CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * exp(-2 * (k + 1) * (k + 1) * x * x)')} END",
)

# non-central laws: mixtures of central ones, which are polynomials for these parameters, or closed forms for one degree of freedom
_W = "exp(-0.5::DOUBLE + k * ln(0.5::DOUBLE) - lgamma(k + 1))"


def _ncx2(v: str) -> str:
    return f"{_normal(f'(sqrt({v}) - sqrt(2))')} - {_normal(f'(-sqrt({v}) - sqrt(2))')}"


def _ncb(y: str, a: str, b: int) -> str:
    """Mixture of I_y(a + k, b) for a whole b."""
    rising = ["1", f"({a} + k)", f"({a} + k) * ({a} + 1 + k) / 2", f"({a} + k) * ({a} + 1 + k) * ({a} + 2 + k) / 6"]
    return _sum("50", f"{_W} * pow({y}, {a} + k) * ({' + '.join(f'{r} * pow(1 - {y}, {i})' for i, r in enumerate(rising[:b]))})")


_plain("non_central_chi_squared_pdf", f"({_phi('(sqrt(x) - sqrt(2))')} + {_phi('(sqrt(x) + sqrt(2))')}) / (2 * sqrt(x))")
_plain("non_central_chi_squared_cdf", _ncx2("x"))
_bisected("non_central_chi_squared_quantile", _ncx2, 0, 60)
_plain("non_central_beta_cdf", _ncb("x", "2", 3), True)
_plain("non_central_beta_pdf", _sum("50", f"{_W} * pow(x, 1 + k) * pow(1 - x, 2) * (2 + k) * (3 + k) * (4 + k) / 2"), True)
_bisected("non_central_beta_quantile", lambda v: _ncb(v, "2", 3), 0, 1)
_Y = "(3 * {0} / (3 * {0} + 8))"
_plain("non_central_f_cdf", _ncb(_Y.format("x"), "1.5::DOUBLE", 4))
_plain("non_central_f_pdf", _sum("50", f"{_W} * pow({_Y.format('x')}, 0.5 + k) * pow(1 - {_Y.format('x')}, 3) * (1.5 + k) * (2.5 + k) * (3.5 + k) * (4.5 + k) / 6") + " * 24 / pow(3 * x + 8, 2)")
_bisected("non_central_f_quantile", lambda v: _ncb(_Y.format(v), "1.5::DOUBLE", 4), 0, 1000)


def _nct(t: str) -> str:
    c = f"(1 + ({t}) * ({t}))"
    return f"exp(-2) / pi() * (1 / {c} + 2 * ({t}) / pow({c}, 1.5) * sqrt(2 * pi()) * exp(2 * ({t}) * ({t}) / {c}) * {_normal(f'(2 * ({t}) / sqrt({c}))')})"


_plain("non_central_t_pdf", _nct("x"))
# Simpson's rule in 600 steps
SQL["non_central_t_cdf"] = (
    f"SELECT round(x, 6) AS x, round({_normal('(-2)')} + sum(CASE WHEN i IN (0, 600) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {_nct('x * i / 600')}) * x / 1800, 6) + 0.0 AS p "
    f"FROM ({_X}), range(601) t(i) GROUP BY x"
)
