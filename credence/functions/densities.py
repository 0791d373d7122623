"""Log densities of the priors and likelihoods as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .special import col, ln_gamma, softplus

HALF_LN_2PI = 0.5 * math.log(2 * math.pi)


def _never() -> Column:
    return F.lit(float("-inf"))


# --- likelihoods, per row --------------------------------------------------------------------------


def normal(y, mu, sigma) -> Column:
    y, mu, sigma = col(y), col(mu), col(sigma)
    z = (y - mu) / sigma
    return F.lit(-HALF_LN_2PI) - F.log(sigma) - F.lit(0.5) * z * z


def bernoulli_logit(y, eta) -> Column:
    return col(y) * col(eta) - softplus(eta)


def poisson_log(y, eta) -> Column:
    y, eta = col(y), col(eta)
    return y * eta - F.exp(eta) - ln_gamma(y + 1.0)


def exponential_log(y, eta) -> Column:
    y, eta = col(y), col(eta)
    return eta - y * F.exp(eta)


def log_normal(y, mu, sigma) -> Column:
    """Values below 1e-300 count as that."""
    ln_y = F.log(F.greatest(col(y), F.lit(1e-300)))
    z = (ln_y - col(mu)) / col(sigma)
    return F.lit(-HALF_LN_2PI) - F.log(col(sigma)) - ln_y - F.lit(0.5) * z * z


def negative_binomial_log(y, eta, alpha) -> Column:
    y, eta, alpha = col(y), col(eta), col(alpha)
    both = F.log(alpha + F.exp(eta))
    return ln_gamma(y + alpha) - ln_gamma(alpha) - ln_gamma(y + 1.0) + alpha * (F.log(alpha) - both) + y * (eta - both)


LIKELIHOODS = {
    "normal": normal, "bernoulli": bernoulli_logit, "poisson": poisson_log, "exponential": exponential_log,
    "log_normal": log_normal, "negative_binomial": negative_binomial_log,
}


# --- priors on the constrained scale ----------------------------------------------------------------


def half_normal(x, sigma) -> Column:
    x, sigma = col(x), col(sigma)
    z = x / sigma
    return F.when(x >= 0, F.lit(0.5 * math.log(2 / math.pi)) - F.log(sigma) - F.lit(0.5) * z * z).otherwise(_never())


def exponential(x, rate) -> Column:
    x, rate = col(x), col(rate)
    return F.when(x >= 0, F.log(rate) - rate * x).otherwise(_never())


def student_t(x, nu, mu=0.0, sigma=1.0) -> Column:
    x, nu, mu, sigma = col(x), col(nu), col(mu), col(sigma)
    z = (x - mu) / sigma
    scale = ln_gamma((nu + 1.0) / 2.0) - ln_gamma(nu / 2.0) - F.lit(0.5) * F.log(nu * F.lit(math.pi)) - F.log(sigma)
    return scale - (nu + 1.0) / 2.0 * F.log1p(z * z / nu)


def uniform(x, lower, upper) -> Column:
    x, lower, upper = col(x), col(lower), col(upper)
    return F.when((x >= lower) & (x <= upper), -F.log(upper - lower)).otherwise(_never())


def gamma(x, alpha, beta) -> Column:
    x, alpha, beta = col(x), col(alpha), col(beta)
    return F.when(x > 0, alpha * F.log(beta) - ln_gamma(alpha) + (alpha - 1.0) * F.log(x) - beta * x).otherwise(_never())


def beta(x, a, b) -> Column:
    x, a, b = col(x), col(a), col(b)
    inside = ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + (a - 1.0) * F.log(x) + (b - 1.0) * F.log1p(-x)
    return F.when((x > 0) & (x < 1), inside).otherwise(_never())


def bernoulli(x, p) -> Column:
    x, p = col(x), col(p)
    return F.when(x == 1, F.log(p)).when(x == 0, F.log1p(-p)).otherwise(_never())


def poisson(x, lam) -> Column:
    x, lam = col(x), col(lam)
    return F.when(x >= 0, x * F.log(lam) - lam - ln_gamma(x + 1.0)).otherwise(_never())


def inverse_gamma(x, shape, scale) -> Column:
    x, shape, scale = col(x), col(shape), col(scale)
    return F.when(x > 0, shape * F.log(scale) - ln_gamma(shape) - (shape + 1.0) * F.log(x) - scale / x).otherwise(_never())


def log_normal_prior(x, mu, sigma) -> Column:
    return F.when(col(x) > 0, log_normal(x, mu, sigma)).otherwise(_never())


PRIORS = {
    "normal": normal, "half_normal": half_normal, "exponential": exponential, "log_normal": log_normal_prior, "student_t": student_t,
    "uniform": uniform, "gamma": gamma, "beta": beta, "bernoulli": bernoulli, "poisson": poisson, "inverse_gamma": inverse_gamma,
}
