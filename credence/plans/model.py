"""Declaring models: parameters, priors, linear predictors, likelihoods, and binding to DataFrames.

A predictor is a sum of constants, parameters, ``parameter * "column"`` and ``vector @ "array
column"``.  A compiled model knows which columns it needs and of what kind, checks a DataFrame for
all datasets in one aggregate, and evaluates its log density and gradient in numpy.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import densities, special
from ..functions.moments import mean_of, products_of


class ParameterError(ValueError):
    """A parameter is undeclared, declared twice, or used in a way that isn't possible."""


class InferenceError(ValueError):
    """A model or its data can't be used for inference."""


def _edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def suggestion(name: str, known: Sequence[str], budget: int | None = None) -> str:
    """'; did you mean ...?' for the nearest known name, if it is near enough."""
    budget = min(3, max(1, len(name) // 3)) if budget is None else budget
    near = min(((_edit_distance(name, k), k) for k in known), default=(99, ""))
    return f"; did you mean {near[1]!r}?" if near[0] <= budget else ""


# --- expressions --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Expr:
    """A sum of terms: (kind, parameter or None, column or None, constant)."""

    terms: tuple
    owner: object = None

    def __add__(self, other):
        other = as_expr(other)
        if self.owner is not None and other.owner is not None and self.owner is not other.owner:
            raise ParameterError("the parameters belong to different models")
        return Expr(self.terms + other.terms, self.owner or other.owner)

    __radd__ = __add__


class ParamRef:
    """A declared scalar parameter."""

    def __init__(self, name: str, owner: object):
        self.name, self.owner = name, owner

    def __mul__(self, column):
        if not isinstance(column, str):
            raise ParameterError("a parameter can only be multiplied with a column name")
        return Expr((("coef", self.name, column, 0.0),), self.owner)

    def __matmul__(self, column):
        if not isinstance(column, str):
            raise ParameterError("a vector can only be applied to the name of an array column")
        return Expr((("matvec", self.name, column, 0.0),), self.owner)

    def __add__(self, other):
        return as_expr(self) + other

    __radd__ = __add__


class VectorParamRef(ParamRef):
    """A declared block of parameters, usable with ``@`` alone."""

    def __init__(self, name: str, size: int, owner: object):
        super().__init__(name, owner)
        self.size = size

    def __mul__(self, column):
        raise ParameterError("a vector of parameters is applied with @")

    def __add__(self, other):
        raise ParameterError("a vector of parameters is applied with @")

    __radd__ = __add__


def as_expr(x) -> Expr:
    if isinstance(x, Expr):
        return x
    if isinstance(x, VectorParamRef):
        raise ParameterError("a vector of parameters is applied with @")
    if isinstance(x, ParamRef):
        return Expr((("param", x.name, None, 0.0),), x.owner)
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return Expr((("const", None, None, float(x)),))
    raise ParameterError(f"{type(x).__name__} can't be part of a predictor")


# --- priors and likelihoods ---------------------------------------------------------------------------

#: Transform of each prior's parameter, and the names of its constants.
PRIORS = {
    "normal": ("identity", ("mu", "sigma")), "half_normal": ("exp", ("sigma",)), "exponential": ("exp", ("rate",)), "log_normal": ("exp", ("mu", "sigma")),
    "student_t": ("identity", ("nu", "mu", "sigma")), "uniform": ("bounded", ("lower", "upper")), "gamma": ("exp", ("alpha", "beta")), "beta": ("sigmoid", ("alpha", "beta")),
    "bernoulli": ("identity", ("p",)), "poisson": ("identity", ("lam",)),
}
DISCRETE = ("bernoulli", "poisson")
LIKELIHOODS = ("normal", "bernoulli", "poisson", "exponential", "log_normal", "negative_binomial")


@dataclass(frozen=True)
class Prior:
    name: str
    kind: str
    args: tuple  #: numbers, or names of parameters (normal's alone)
    size: int | None = None  #: of a vector

    @property
    def centred_by(self) -> bool:
        """Whether the value is rebuilt as ``mu + sigma * raw`` from a standard normal."""
        return any(isinstance(a, str) for a in self.args)


@dataclass(frozen=True)
class Likelihood:
    name: str
    kind: str
    terms: tuple
    scale: float | str | None
    key: str


#: Likelihoods with a scale, and of each kind of term, whether it has a parameter and a column.
SCALED = ("normal", "log_normal", "negative_binomial")
TERMS = {"const": (False, False), "param": (True, False), "coef": (True, True), "matvec": (True, True)}


def _number(x, what: str, positive: bool = False) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or positive and x <= 0:
        raise ParameterError(f"{what} must be a {'positive ' if positive else ''}finite number")
    return float(x)


class ModelBuilder:
    def __init__(self):
        self.priors: list[Prior] = []
        self.likelihoods: list[Likelihood] = []

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def _ref(self, x, what: str, positive: bool = False):
        if isinstance(x, ParamRef):
            if x.owner is not self:
                raise ParameterError(f"{x.name!r} belongs to another model")
            return x.name
        return _number(x, what, positive)

    def _add(self, name: str, kind: str, args: tuple, size: int | None = None):
        if not isinstance(name, str) or not name:
            raise ParameterError("a parameter needs a name")
        if any(p.name == name for p in self.priors):
            raise ParameterError(f"{name!r} is declared twice")
        self.priors.append(Prior(name, kind, args, size))
        return VectorParamRef(name, size, self) if size else ParamRef(name, self)

    def normal_prior(self, name, mu, sigma):
        return self._add(name, "normal", (self._ref(mu, "mu"), self._ref(sigma, "sigma", True)))

    def half_normal_prior(self, name, sigma):
        return self._add(name, "half_normal", (_number(sigma, "sigma", True),))

    def exponential_prior(self, name, rate):
        return self._add(name, "exponential", (_number(rate, "rate", True),))

    def log_normal_prior(self, name, mu, sigma):
        return self._add(name, "log_normal", (_number(mu, "mu"), _number(sigma, "sigma", True)))

    def student_t_prior(self, name, nu, mu=0.0, sigma=1.0):
        return self._add(name, "student_t", (_number(nu, "nu", True), _number(mu, "mu"), _number(sigma, "sigma", True)))

    def uniform_prior(self, name, lower=0.0, upper=1.0):
        lower, upper = _number(lower, "lower"), _number(upper, "upper")
        if not lower < upper:
            raise ParameterError("lower must be below upper")
        return self._add(name, "uniform", (lower, upper))

    def gamma_prior(self, name, alpha, beta):
        return self._add(name, "gamma", (_number(alpha, "alpha", True), _number(beta, "beta", True)))

    def beta_prior(self, name, alpha, beta):
        return self._add(name, "beta", (_number(alpha, "alpha", True), _number(beta, "beta", True)))

    def bernoulli_prior(self, name, p=0.5):
        p = _number(p, "p")
        if not 0 <= p <= 1:
            raise ParameterError("p must lie between 0 and 1")
        return self._add(name, "bernoulli", (p,))

    def poisson_prior(self, name, lam):
        return self._add(name, "poisson", (_number(lam, "lam", True),))

    def vector_normal_prior(self, name, n, mu=0.0, sigma=1.0):
        if not isinstance(n, int) or n < 1:
            raise ParameterError("n must be a positive integer")
        return self._add(name, "normal", (_number(mu, "mu"), _number(sigma, "sigma", True)), n)

    def _observe(self, name, kind, expr, scale, key):
        expr = as_expr(expr)
        if expr.owner is not None and expr.owner is not self:
            raise ParameterError("the predictor's parameters belong to another model")
        if any(x.name == name for x in self.likelihoods) or any(x.key == key for x in self.likelihoods):
            raise ParameterError(f"likelihood {name!r} or its column {key!r} occurs twice")
        self.likelihoods.append(Likelihood(name, kind, expr.terms, None if scale is None else self._ref(scale, "scale", True), key))

    def normal_likelihood(self, name, mu_expr, sigma, observed_key):
        self._observe(name, "normal", mu_expr, sigma, observed_key)

    def bernoulli_logit_likelihood(self, name, eta_expr, observed_key):
        self._observe(name, "bernoulli", eta_expr, None, observed_key)

    def poisson_log_likelihood(self, name, eta_expr, observed_key):
        self._observe(name, "poisson", eta_expr, None, observed_key)

    def exponential_likelihood(self, name, eta_expr, observed_key):
        self._observe(name, "exponential", eta_expr, None, observed_key)

    def log_normal_likelihood(self, name, mu_expr, sigma, observed_key):
        self._observe(name, "log_normal", mu_expr, sigma, observed_key)

    def negative_binomial_likelihood(self, name, eta_expr, alpha, observed_key):
        self._observe(name, "negative_binomial", eta_expr, alpha, observed_key)

    def _widths(self, data: DataFrame) -> dict[str, int]:
        """Widths of the array columns that scalar priors are used with, from the data; binding checks every row."""
        scalar = {p.name for p in self.priors if p.size is None}
        columns = list(dict.fromkeys(c for x in self.likelihoods for k, n, c, _ in x.terms if k == "matvec" and n in scalar))
        for c in columns:
            if c not in data.columns:
                raise InferenceError(f"missing matrix {c!r}{suggestion(c, data.columns, 2)}")
        found = data.agg(*[F.max(F.size(c)).alias(c) for c in columns]).first().asDict() if columns else {}
        return {c: w for c, w in found.items() if w and w > 0}

    def compile(self, widths: dict[str, int] | None = None, data: DataFrame | None = None) -> Model:
        """The model; ``widths`` are those of array columns whose parameter is a scalar prior used with @,
        and are taken from ``data`` where they aren't given."""
        if data is not None:
            widths = self._widths(data) | (widths or {})
        known, used = [], {p.name for p in self.priors}
        for p in self.priors:
            for a in p.args:
                if isinstance(a, str) and a not in known:
                    why = "used before its declaration" if a in used else "undeclared" + suggestion(a, known)
                    raise ParameterError(f"{a!r} is {why}")
            known.append(p.name)
        priors = {p.name: p for p in self.priors}
        for like in self.likelihoods:
            for kind, name, column, _ in like.terms:
                if name is not None and name not in priors:
                    raise ParameterError(f"{name!r} is undeclared{suggestion(name, known)}")
                if kind == "matvec" and priors[name].size is None:
                    if priors[name].centred_by or priors[name].kind in DISCRETE:
                        raise ParameterError(f"{name!r} can't become a vector")
                    if not widths or column not in widths:
                        raise ParameterError(f"the width of {column!r} isn't known")
                    priors[name] = Prior(name, priors[name].kind, priors[name].args, widths[column])
        return Model(list(priors.values()), list(self.likelihoods))

    build = compile


@dataclass
class Model:
    """A compiled model."""

    priors: list[Prior]
    likelihoods: list[Likelihood]
    spans: dict[str, tuple[int, int]] = field(init=False)

    VERSION = 1

    def __post_init__(self):
        self.spans, at = {}, 0
        for p in self.priors:
            self.spans[p.name] = (at, at + (p.size or 1))
            at += p.size or 1
        self.n_params = at

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    @property
    def param_names(self) -> list[str]:
        return [n for p in self.priors for n in ([p.name] if p.size is None else [f"{p.name}[{k}]" for k in range(p.size)])]

    @property
    def vector_keys(self) -> list[str]:
        return list(dict.fromkeys(c for x in self.likelihoods for k, _, c, _ in x.terms if k == "coef"))

    @property
    def matrix_keys(self) -> dict[str, int]:
        return {c: self._prior(n).size for x in self.likelihoods for k, n, c, _ in x.terms if k == "matvec"}

    @property
    def observed_keys(self) -> list[str]:
        return [x.key for x in self.likelihoods]

    @property
    def required_keys(self) -> list[str]:
        return list(dict.fromkeys([*self.observed_keys, *self.vector_keys, *self.matrix_keys]))

    @property
    def schema(self) -> T.StructType:
        kind = lambda k: T.ArrayType(T.DoubleType()) if k in self.matrix_keys else T.DoubleType()
        return T.StructType([T.StructField("dataset_id", T.StringType()), *[T.StructField(k, kind(k)) for k in self.required_keys]])

    def _prior(self, name: str) -> Prior:
        return next(p for p in self.priors if p.name == name)

    # --- artifacts

    @property
    def structure_id(self) -> str:
        """A digest of all that makes the model, the same for equal models."""
        return hashlib.sha256(json.dumps(json.loads(self.to_json()), sort_keys=True).encode()).hexdigest()

    def to_json(self) -> str:
        return json.dumps({"version": self.VERSION, "priors": [vars(p) for p in self.priors], "likelihoods": [vars(x) for x in self.likelihoods]}, indent=2)

    @classmethod
    def from_json(cls, text: str) -> Model:
        """A model from its artifact, which is checked as a new model would be."""
        got = json.loads(text)
        if got.get("version") != cls.VERSION:
            raise InferenceError(f"artifact version {got.get('version')!r} isn't supported")
        b = ModelBuilder()
        for p in got["priors"]:
            if p["kind"] not in PRIORS or len(p["args"]) != len(PRIORS[p["kind"]][1]):
                raise InferenceError(f"prior {p['name']!r} is malformed")
            getattr(b, f"{p['kind']}_prior")(p["name"], *[ParamRef(a, b) if isinstance(a, str) else a for a in p["args"]])
            if p["size"] is not None:
                if type(p["size"]) is not int or p["size"] < 1 or b.priors[-1].centred_by or p["kind"] in DISCRETE:
                    raise InferenceError(f"{p['name']!r} can't be a vector of {p['size']!r}")
                b.priors[-1] = Prior(p["name"], p["kind"], b.priors[-1].args, p["size"])
        names = [p.name for p in b.priors]
        for x in got["likelihoods"]:
            if x["kind"] not in LIKELIHOODS:
                raise InferenceError(f"likelihood kind {x['kind']!r} is unknown")
            if (x["scale"] is None) == (x["kind"] in SCALED):
                raise InferenceError(f"likelihood {x['name']!r} has {'no' if x['scale'] is None else 'a'} scale")
            if isinstance(x["scale"], str) and x["scale"] not in names:
                raise InferenceError(f"{x['scale']!r} is undeclared{suggestion(x['scale'], names)}")
            terms = tuple(map(tuple, x["terms"]))
            for t in terms:
                shape = len(t) == 4 and t[0] in TERMS and (isinstance(t[1], str), isinstance(t[2], str)) == TERMS[t[0]]
                if not shape or isinstance(t[3], bool) or not isinstance(t[3], (int, float)) or not math.isfinite(t[3]):
                    raise InferenceError(f"likelihood {x['name']!r} has a malformed term {t!r}")
            scale = ParamRef(x["scale"], b) if isinstance(x["scale"], str) else x["scale"]
            b._observe(x["name"], x["kind"], Expr(terms, b), scale, x["key"])
        return b.compile()

    # --- DataFrames

    def bind(self, df: DataFrame, shared: DataFrame | None = None, strict: bool = True, override: bool = False) -> DataFrame:
        """``df`` with dataset_id and the needed columns alone, after all checks of all datasets in
        one aggregate.  ``shared`` has columns by row_idx that every dataset uses; with ``override`` they
        are defaults, which columns of ``df`` replace, of whatever kind."""
        if shared is not None:
            clash = (set(shared.columns) & set(df.columns)) - {"row_idx"}
            if override:
                shared, clash = shared.drop(*clash), set()
            if clash:
                raise InferenceError(f"{min(clash)!r} is both shared and the dataset's own")
            df = df.join(shared, "row_idx")
        have = {f.name: f.dataType for f in df.schema}
        df = df if "dataset_id" in have else df.withColumn("dataset_id", F.lit("0"))
        for k in self.required_keys:
            kind = "matrix" if k in self.matrix_keys else "observation" if k in self.observed_keys else "vector"
            if k not in have:
                raise InferenceError(f"missing {kind} {k!r}{suggestion(k, list(have), 2)}")
            if isinstance(have[k], T.ArrayType) != (kind == "matrix"):
                raise InferenceError(f"{k!r} must be {'an array' if kind == 'matrix' else 'a number'} column")
        extra = sorted(set(have) - {*self.required_keys, "dataset_id", "dataset_index", "row_idx"})
        if strict and extra:
            raise InferenceError(f"unexpected column {extra[0]!r}{suggestion(extra[0], self.required_keys, 2)}")
        cols = [F.col(k).cast("array<double>" if k in self.matrix_keys else "double").alias(k) for k in self.required_keys]
        bound = df.select(F.col("dataset_id").cast("string").alias("dataset_id"), *cols)
        self._raise_invalid(bound)
        return bound

    def checks(self, bound: DataFrame) -> DataFrame:
        """Counts of violations for each dataset: ``n_obs``, ``finite_<key>``, ``width_<key>``, ``support_<key>``."""
        bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
        count = lambda c: F.sum(F.coalesce(c, F.lit(True)).cast("long"))
        aggs = [F.count("*").alias("n_obs")]
        for k in self.required_keys:
            c = F.col(k)
            if k in self.matrix_keys:
                aggs += [count(c.isNull() | (F.size(c) != self.matrix_keys[k])).alias(f"width_{k}"), count(F.exists(c, bad)).alias(f"finite_{k}")]
            else:
                aggs.append(count(bad(c)).alias(f"finite_{k}"))
        for x in self.likelihoods:
            y = F.col(x.key)
            rule = {"bernoulli": ~y.isin(0.0, 1.0), "exponential": y < 0, "log_normal": y <= 0}
            rule |= dict.fromkeys(("poisson", "negative_binomial"), (y < 0) | (y != F.floor(y)))
            if x.kind in rule:
                aggs.append(count(rule[x.kind]).alias(f"support_{x.key}"))
        return bound.groupBy("dataset_id").agg(*aggs)

    def _raise_invalid(self, bound: DataFrame) -> None:
        checks = self.checks(bound)
        names = [c for c in checks.columns if c not in ("dataset_id", "n_obs")]
        total = 0
        for r in checks.agg(F.count("*").alias("datasets"), *[F.max(F.struct(F.col(f"`{c}`"), "dataset_id")).alias(c) for c in names]).collect():
            total = r["datasets"]
            for c in names:
                if r[c] is not None and r[c][0]:
                    rule, _, key = c.partition("_")
                    what = {"finite": "values that aren't finite", "width": "rows of the wrong width", "support": "values outside the likelihood's support"}[rule]
                    raise InferenceError(f"dataset {r[c][1]!r}: {key!r} has {r[c][0]} {what}")
        if not total:
            raise InferenceError("the data are empty")

    def predictor(self, likelihood: Likelihood, params: dict[str, Column]) -> Column:
        """η as one Column; ``params`` has a Column for each parameter (an array for a vector)."""
        out = None
        for kind, name, column, c in likelihood.terms:
            if kind == "const":
                term = F.lit(c)
            elif kind == "param":
                term = params[name]
            elif kind == "coef":
                term = params[name] * F.col(column)
            else:
                term = F.aggregate(F.zip_with(params[name], F.col(column), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
            out = term if out is None else out + term
        return out

    def log_likelihood(self, likelihood: Likelihood, params: dict[str, Column]) -> Column:
        """Log density of a row."""
        eta, scale = self.predictor(likelihood, params), likelihood.scale
        args = [] if scale is None else [params[scale] if isinstance(scale, str) else F.lit(scale)]
        return densities.LIKELIHOODS[likelihood.kind](likelihood.key, eta, *args)

    # --- sufficient statistics: the design of the Gaussian likelihoods

    @property
    def gaussian(self) -> bool:
        return bool(self.likelihoods) and all(x.kind == "normal" for x in self.likelihoods)

    def design(self, likelihood: Likelihood) -> list[tuple[str | None, str | None, int | None]]:
        """The design's columns: (None, None, None) for 1, (column, None, None), or (array column, None, place)."""
        out: list = [(None, None, None)]
        for kind, _, column, _ in likelihood.terms:
            if kind == "coef" and (column, None, None) not in out:
                out.append((column, None, None))
            elif kind == "matvec":
                out += [(column, None, k) for k in range(self.matrix_keys[column]) if (column, None, k) not in out]
        return out

    def gaussian_stats(self, bound: DataFrame) -> DataFrame:
        """n of each dataset and, for each likelihood, the means ``m<i>`` of the design's columns but the 1, then
        of the response, and their centred products ``s<i>`` (upper triangle); partial ones are made before
        anything is shuffled."""
        aggs = [F.count("*").alias("n")]
        for i, x in enumerate(self.likelihoods):
            cols = [F.col(c) if k is None else F.element_at(F.col(c), k + 1) for c, _, k in self.design(x) if c is not None]
            cols.append(F.col(x.key))
            aggs += [F.array(*[mean_of(c) for c in cols]).alias(f"m{i}"), F.array(*products_of(cols)).alias(f"s{i}")]
        return bound.groupBy("dataset_id").agg(*aggs)


__all__ = ["Expr", "InferenceError", "Likelihood", "Model", "ModelBuilder", "ParamRef", "ParameterError", "Prior", "VectorParamRef", "special"]
