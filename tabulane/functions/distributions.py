"""Random draws as columns.

A distribution is a builder `fn(draws, params) -> Column`. `draws` hands out reproducible uniforms
(see uniform.py); `params` maps parameter names to Columns. Whatever has a closed form stays in the
JVM; gamma-type draws and discrete tables with per-row parameters run vectorised over Arrow batches.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import Any, Callable, NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulane.functions.uniform import bits_of, draw_hash, hash_group, unit_of


class Draws:
    """Uniforms of one column: the draw number keeps several draws of a row apart.

    Hashes and draws are helper columns in two projections below the value, added and dropped again by
    whoever adds the value: each is computed once however often the value uses it.
    """

    def __init__(self, seed: int, name: str, key: Column, hashing: str = "md5"):
        self.seed, self.name, self.key, self.hashing = seed, name, key, hashing
        self.hashes: dict[str, Column] = {}
        self.draws: dict[str, Column] = {}

    def _bits(self, draw: int) -> Column:
        helper = f"_h{hash_group(draw, self.hashing)}_{self.name}"
        self.hashes[helper] = draw_hash(self.seed, self.name, draw, self.key, self.hashing)
        return bits_of(F.col(f"`{helper}`"), draw, self.hashing)

    def u(self, draw: int = 0) -> Column:
        return self._draw(f"_u{draw}_{self.name}", unit_of(self._bits(draw)))

    def bits(self, draw: int = 0) -> Column:
        return self._draw(f"_b{draw}_{self.name}", self._bits(draw))

    def _draw(self, name: str, value: Column) -> Column:
        self.draws[name] = value
        return F.col(f"`{name}`")

    def normal(self, draw: int = 0) -> Column:
        """Standard normal (Box-Muller) from two uniforms."""
        return F.sqrt(F.lit(-2.0) * F.ln(self.u(draw))) * F.cos(F.lit(2 * math.pi) * self.u(draw + 1))


class Distribution(NamedTuple):
    build: Callable[[Draws, dict[str, Any]], Column]
    required: tuple[str, ...]
    defaults: dict[str, float]
    check: Callable[[dict[str, Column]], Column] | None = None  # condition the parameters must meet
    rule: str = ""



# Arrow-batched draws. The bodies use only what they define, so executors need nothing but numpy.


# The published SplitMix64 generator; the second one spaces the draws of a row.
GOLDEN, SPACING, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _gamma_udf():
    golden, spacing, mix1, mix2 = GOLDEN, SPACING, MIX1, MIX2

    @F.pandas_udf("double")
    def gamma(bits: pd.Series, shape: pd.Series) -> pd.Series:
        """Standard gamma by the Marsaglia-Tsang rejection method, all pending rows at a time."""
        import numpy as np

        state = bits.to_numpy(dtype="float64", na_value=0).astype(np.uint64)
        a = shape.to_numpy(dtype="float64", na_value=np.nan)
        counter = np.uint64(0)

        def unit(rows):  # SplitMix64 seeded per row
            nonlocal counter
            counter = counter + np.uint64(1)
            with np.errstate(over="ignore"):
                z = state[rows] * np.uint64(golden) + counter * np.uint64(spacing)
                z = (z ^ (z >> np.uint64(30))) * np.uint64(mix1)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(mix2)
                z = z ^ (z >> np.uint64(31))
            return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0

        # drawn first: later draws are counted per round, and the rounds of a row do not depend on others
        every = np.arange(len(a))
        small = (a > 0) & (a < 1)
        lift = np.where(small, unit(every) ** (1.0 / np.where(small, a, 1.0)), 1.0)
        boosted = np.where(a < 1, a + 1, a)
        d = boosted - 1.0 / 3.0
        c = 1.0 / np.sqrt(9.0 * d)
        out = np.full(len(a), np.nan)
        rows = np.flatnonzero(a > 0)
        while len(rows):
            x = np.sqrt(-2 * np.log(unit(rows))) * np.cos(2 * np.pi * unit(rows))
            u = unit(rows)
            v = (1 + c[rows] * x) ** 3
            good = v > 0
            safe = np.where(good, v, 1.0)
            good &= np.log(u) < 0.5 * x * x + d[rows] * (1 - safe + np.log(safe))
            out[rows[good]] = d[rows[good]] * v[good]
            rows = rows[~good]
        values = pd.Series(out * lift)
        return values.where(values.notna(), None)

    return gamma


def _count_udf(kind: str):
    @F.pandas_udf("long")
    def count(u: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        """Inverse of a Poisson(a) or binomial(a, b) table, summed from far below the mean.

        What lies below the starting point has a probability under 1e-30.
        """
        import numpy as np

        def lgamma(x):
            """Logarithm of the gamma function for x >= 1: Stirling's series, beyond 10 by x or by steps up to there."""
            x = np.asarray(x, dtype=float)
            steps = np.ones_like(x)
            for _ in range(10):
                low = x < 10
                steps, x = np.where(low, steps * x, steps), np.where(low, x + 1, x)
            y = 1 / (x * x)
            tail = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y * (1 / 1188 - y * (691 / 360360 - y / 156)))))) / x
            return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + tail - np.log(steps)

        u = u.to_numpy(dtype="float64", na_value=np.nan)
        a = a.to_numpy(dtype="float64", na_value=np.nan)
        b = b.to_numpy(dtype="float64", na_value=np.nan)
        known = ~(np.isnan(u) | np.isnan(a) | np.isnan(b))
        with np.errstate(all="ignore"):
            if kind == "poisson":
                mean, sd = a, np.sqrt(a)
            else:
                a = np.trunc(a)
                mean, sd = a * b, np.sqrt(a * b * (1 - b))
            k = np.where(known, np.floor(np.maximum(0, mean - 12 * sd - 12)), 0.0)
            if kind == "poisson":
                logp = np.where(a > 0, -a + k * np.log(np.where(a > 0, a, 1)), 0.0) - np.where(known, lgamma(k + 1), 0)
            else:
                inner = (b > 0) & (b < 1)
                p = np.where(inner, b, 0.5)
                n = np.where(known, a, 1.0)
                logp = lgamma(n + 1) - lgamma(k + 1) - lgamma(np.maximum(n - k, 0) + 1) + k * np.log(p) + (n - k) * np.log1p(-p)
            pmf = np.exp(logp)
            cdf, value = pmf.copy(), k.copy()
            last = mean + 12 * sd + 40
            open_rows = np.flatnonzero(known & (u > cdf))
            while len(open_rows):
                i = open_rows
                k[i] += 1
                step = a[i] / k[i] if kind == "poisson" else (a[i] - k[i] + 1) / k[i] * p[i] / (1 - p[i])
                pmf[i] *= step
                cdf[i] += pmf[i]
                value[i] = k[i]
                end = last[i] if kind == "poisson" else np.minimum(last[i], a[i])
                open_rows = i[(u[i] > cdf[i]) & (k[i] < end)]
            if kind == "binomial":
                value = np.where(b <= 0, 0, np.where(b >= 1, a, value))
            else:
                value = np.where(a == 0, 0, value)
        return pd.Series(value).where(known, None).astype("Int64")

    return count


# builders -----------------------------------------------------------------------------------


def _normal(d, p):
    return p["mu"] + p["sigma"] * d.normal()


def _uniform(d, p):
    return p["low"] + (p["high"] - p["low"]) * d.u()


def _listed(value: Any) -> list:
    """A list as it is, text as its comma-separated items."""
    if isinstance(value, str):
        return [item for item in map(str.strip, value.split(",")) if item]
    return list(value or [])


def parse_categories(params: dict) -> tuple[list[str], list[float]]:
    """Categories and their probabilities, checked."""
    cats, probs = _listed(params.get("categories")), [float(p) for p in _listed(params.get("probs"))]
    if not cats or len(cats) != len(probs):
        raise ValueError("categorical needs as many probs as categories, and at least one")
    if not all(isinstance(c, str) for c in cats):
        raise ValueError("categories must be text")
    if min(probs) < 0 or not math.isclose(math.fsum(probs), 1.0, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError("probs must not be negative and must add up to 1")
    return cats, probs


def _categorical(d, p):
    cats, probs = parse_categories(p)
    u, upto, case = d.u(), 0.0, None
    for cat, prob in list(zip(cats, probs))[:-1]:
        upto += prob
        case = F.when(u < F.lit(upto), F.lit(cat)) if case is None else case.when(u < F.lit(upto), F.lit(cat))
    return F.lit(cats[-1]) if case is None else case.otherwise(F.lit(cats[-1]))


def _bernoulli(d, p):
    return (d.u() < p["p"]).cast("long")


MAX_TABLE_MEAN = 30.0  # a literal Poisson table is used up to this mean


def _poisson(d, p):
    lam = p.get("_literals", {}).get("lam")
    if lam is None or lam > MAX_TABLE_MEAN:
        return _count_udf("poisson")(d.u(), p["lam"], F.lit(0.0))
    upto, pmf, table = 0.0, math.exp(-lam), []
    for k in range(int(lam + 12 * math.sqrt(lam) + 40)):
        upto += pmf
        table.append(upto)
        pmf *= lam / (k + 1)
    # the value is the number of table entries under u
    u = d.u()
    return F.size(F.filter(F.lit(table), lambda c: c < u)).cast("long")


def _exponential(d, p):
    return -p["scale"] * F.ln(d.u())


def _gamma(d, p):
    return _gamma_udf()(d.bits(0), p["shape"]) * p["scale"]


def _beta(d, p):
    gamma = _gamma_udf()
    x, y = gamma(d.bits(0), p["a"]), gamma(d.bits(1), p["b"])
    return x / (x + y)


def _chisquare(d, p):
    return _gamma_udf()(d.bits(0), p["df"] / 2) * 2.0


def _student_t(d, p):
    chi2 = _gamma_udf()(d.bits(2), p["df"] / 2) * 2.0
    return p["loc"] + p["scale"] * d.normal() / F.sqrt(chi2 / p["df"])


def _lognormal(d, p):
    return F.exp(p["mean"] + p["sigma"] * d.normal())


def _binomial(d, p):
    """One uniform draw inverted, whether the number of trials is a literal or a column."""
    return _count_udf("binomial")(d.u(), p["n"], p["p"])


def _triangular(d, p):
    a, c, b, u = p["left"], p["mode"], p["right"], d.u()
    rising = a + F.sqrt(u * (b - a) * (c - a))
    falling = b - F.sqrt((F.lit(1.0) - u) * (b - a) * (b - c))
    return F.when(u * (b - a) < (c - a), rising).otherwise(falling)


def _weibull(d, p):
    return p["scale"] * F.pow(-F.ln(d.u()), F.lit(1.0) / p["a"])


DISTRIBUTIONS: dict[str, Distribution] = {
    "normal": Distribution(_normal, ("mu", "sigma"), {}, lambda p: p["sigma"] >= 0, "sigma >= 0"),
    "uniform": Distribution(_uniform, ("low", "high"), {}, lambda p: p["low"] < p["high"], "low < high"),
    "categorical": Distribution(_categorical, (), {}),
    "bernoulli": Distribution(_bernoulli, ("p",), {}, lambda p: (p["p"] >= 0) & (p["p"] <= 1), "0 <= p <= 1"),
    "poisson": Distribution(_poisson, ("lam",), {}, lambda p: p["lam"] >= 0, "lam >= 0"),
    "exponential": Distribution(_exponential, ("scale",), {}, lambda p: p["scale"] > 0, "scale > 0"),
    "beta": Distribution(_beta, ("a", "b"), {}, lambda p: (p["a"] > 0) & (p["b"] > 0), "a > 0 and b > 0"),
    "gamma": Distribution(_gamma, ("shape", "scale"), {}, lambda p: (p["shape"] > 0) & (p["scale"] > 0), "shape > 0 and scale > 0"),
    "lognormal": Distribution(_lognormal, ("mean", "sigma"), {}, lambda p: p["sigma"] >= 0, "sigma >= 0"),
    "binomial": Distribution(
        _binomial, ("n", "p"), {}, lambda p: (p["n"] >= 1) & (p["p"] >= 0) & (p["p"] <= 1), "n >= 1 and 0 <= p <= 1"
    ),
    "triangular": Distribution(
        _triangular, ("left", "mode", "right"), {}, lambda p: (p["left"] <= p["mode"]) & (p["mode"] <= p["right"]), "left <= mode <= right"
    ),
    "weibull": Distribution(_weibull, ("a",), {"scale": 1.0}, lambda p: (p["a"] > 0) & (p["scale"] > 0), "a > 0 and scale > 0"),
    "chisquare": Distribution(_chisquare, ("df",), {}, lambda p: p["df"] > 0, "df > 0"),
    "student_t": Distribution(
        _student_t, ("df",), {"loc": 0.0, "scale": 1.0}, lambda p: (p["df"] > 0) & (p["scale"] >= 0), "df > 0 and scale >= 0"
    ),
}


# Families named `scipy.<name>`: standard quantile function of u, then loc and scale.

def _standard(quantile: Callable[[Column, dict], Column], shapes: tuple[str, ...], discrete: bool = False, check=None, rule=""):
    def build(d, p):
        z = quantile(d, p)
        return (p["loc"] + z).cast("long") if discrete else p["loc"] + p["scale"] * z

    defaults = {"loc": 0.0} if discrete else {"loc": 0.0, "scale": 1.0}
    return Distribution(build, shapes, defaults, check, rule)


def _half_normal(d, p):
    return F.abs(d.normal())


def _genpareto(d, p):
    c, tail = p["c"], F.lit(1.0) - d.u()
    return F.when(c == 0, -F.ln(tail)).otherwise(F.try_divide(F.pow(tail, -c) - 1.0, c))


def _laplace(d, p):
    u = d.u()
    return F.when(u < 0.5, F.ln(F.lit(2.0) * u)).otherwise(-F.ln(F.lit(2.0) * (F.lit(1.0) - u)))


def _positive(*names):
    def check(p):
        return reduce(lambda a, b: a & b, [p[n] > 0 for n in names])

    return dict(check=check, rule=" and ".join(f"{n} > 0" for n in names))


def _left(d):
    return F.lit(1.0) - d.u()


FAMILIES: dict[str, Distribution] = {
    "norm": _standard(lambda d, p: d.normal(), ()),
    "uniform": _standard(lambda d, p: d.u(), ()),
    "expon": _standard(lambda d, p: -F.ln(_left(d)), ()),
    "pareto": _standard(lambda d, p: F.pow(_left(d), F.lit(-1.0) / p["b"]), ("b",), **_positive("b")),
    "lomax": _standard(lambda d, p: F.pow(_left(d), F.lit(-1.0) / p["c"]) - 1.0, ("c",), **_positive("c")),
    "genpareto": _standard(_genpareto, ("c",)),
    "logistic": _standard(lambda d, p: F.ln(d.u() / _left(d)), ()),
    "laplace": _standard(_laplace, ()),
    "cauchy": _standard(lambda d, p: F.tan(F.lit(math.pi) * (d.u() - 0.5)), ()),
    "gumbel_r": _standard(lambda d, p: -F.ln(-F.ln(d.u())), ()),
    "gumbel_l": _standard(lambda d, p: F.ln(-F.ln(_left(d))), ()),
    "rayleigh": _standard(lambda d, p: F.sqrt(F.lit(-2.0) * F.ln(_left(d))), ()),
    "halfnorm": _standard(_half_normal, ()),
    "powerlaw": _standard(lambda d, p: F.pow(d.u(), F.lit(1.0) / p["a"]), ("a",), **_positive("a")),
    "loguniform": _standard(
        lambda d, p: p["a"] * F.pow(p["b"] / p["a"], d.u()),
        ("a", "b"),
        check=lambda p: (p["a"] > 0) & (p["b"] > p["a"]),
        rule="0 < a < b",
    ),
    "fisk": _standard(lambda d, p: F.pow(d.u() / _left(d), F.lit(1.0) / p["c"]), ("c",), **_positive("c")),
    "weibull_min": _standard(lambda d, p: F.pow(-F.ln(_left(d)), F.lit(1.0) / p["c"]), ("c",), **_positive("c")),
    "weibull_max": _standard(lambda d, p: -F.pow(-F.ln(d.u()), F.lit(1.0) / p["c"]), ("c",), **_positive("c")),
    "arcsine": _standard(lambda d, p: F.pow(F.sin(F.lit(math.pi / 2) * d.u()), F.lit(2.0)), ()),
    "geom": _standard(
        lambda d, p: F.when(p["p"] == 1, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), F.ceil(F.try_divide(F.ln(_left(d)), F.ln(F.lit(1.0) - p["p"]))).cast("double"))),
        ("p",),
        discrete=True,
        check=lambda p: (p["p"] > 0) & (p["p"] <= 1),
        rule="0 < p <= 1",
    ),
    "randint": _standard(
        lambda d, p: p["low"] + F.floor(d.u() * (p["high"] - p["low"])),
        ("low", "high"),
        discrete=True,
        check=lambda p: p["low"] < p["high"],
        rule="low < high",
    ),
}


def _t(d, p):
    return d.normal() / F.sqrt(_gamma_udf()(d.bits(2), p["df"] / 2) * 2.0 / p["df"])


def _poisson_mu(d, p):
    return _poisson(d, {"lam": p["mu"], "_literals": {"lam": p.get("_literals", {}).get("mu")}})


# the same draws as the distributions above, under other parameter names and with loc and scale
FAMILIES.update(
    {
        "gamma": _standard(lambda d, p: _gamma_udf()(d.bits(0), p["a"]), ("a",), **_positive("a")),
        "beta": _standard(_beta, ("a", "b"), **_positive("a", "b")),
        "lognorm": _standard(lambda d, p: F.exp(p["s"] * d.normal()), ("s",), **_positive("s")),
        "t": _standard(_t, ("df",), **_positive("df")),
        "chi2": _standard(_chisquare, ("df",), **_positive("df")),
        "triang": _standard(
            lambda d, p: _triangular(d, {"left": F.lit(0.0), "mode": p["c"], "right": F.lit(1.0)}),
            ("c",),
            check=lambda p: (p["c"] >= 0) & (p["c"] <= 1),
            rule="0 <= c <= 1",
        ),
        "poisson": _standard(_poisson_mu, ("mu",), discrete=True, check=lambda p: p["mu"] >= 0, rule="mu >= 0"),
        "binom": _standard(
            _binomial, ("n", "p"), discrete=True, check=lambda p: (p["n"] >= 1) & (p["p"] >= 0) & (p["p"] <= 1), rule="n >= 1 and 0 <= p <= 1"
        ),
        "bernoulli": _standard(_bernoulli, ("p",), discrete=True, check=lambda p: (p["p"] >= 0) & (p["p"] <= 1), rule="0 <= p <= 1"),
        "halfcauchy": _standard(lambda d, p: F.tan(F.lit(math.pi / 2) * d.u()), ()),
        "halflogistic": _standard(lambda d, p: F.ln((F.lit(1.0) + d.u()) / _left(d)), ()),
        "hypsecant": _standard(lambda d, p: F.ln(F.tan(F.lit(math.pi / 2) * d.u())), ()),
        "genlogistic": _standard(lambda d, p: -F.ln(F.pow(d.u(), F.lit(-1.0) / p["c"]) - 1.0), ("c",), **_positive("c")),
        "gompertz": _standard(lambda d, p: F.ln(F.lit(1.0) - F.ln(_left(d)) / p["c"]), ("c",), **_positive("c")),
        "exponweib": _standard(
            lambda d, p: F.pow(-F.ln(F.lit(1.0) - F.pow(d.u(), F.lit(1.0) / p["a"])), F.lit(1.0) / p["c"]), ("a", "c"), **_positive("a", "c")
        ),
        "burr": _standard(lambda d, p: F.pow(F.pow(d.u(), F.lit(-1.0) / p["d"]) - 1.0, F.lit(-1.0) / p["c"]), ("c", "d"), **_positive("c", "d")),
        "invweibull": _standard(lambda d, p: F.pow(-F.ln(d.u()), F.lit(-1.0) / p["c"]), ("c",), **_positive("c")),
    }
)
DISTRIBUTIONS.update({f"scipy.{name}": dist for name, dist in FAMILIES.items()})


def register_distribution(
    name: str,
    fn: Callable[[Draws, dict[str, Any]], Column],
    required: tuple[str, ...] = (),
    defaults: dict[str, float] | None = None,
    check: Callable[[dict[str, Column]], Column] | None = None,
    rule: str = "",
) -> None:
    """Make `fn(draws, params) -> Column` available as distribution `name`."""
    DISTRIBUTIONS[name] = Distribution(fn, required, defaults or {}, check, rule)
