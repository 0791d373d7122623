"""Ready-made models."""

from __future__ import annotations

from collections.abc import Sequence

from .model import Model, ModelBuilder


def hierarchy(groups: Sequence[str], response: str = "y", spread: float = 1.0, noise: float = 1.0, slope: str | None = None) -> Model:
    """Group means around a population mean, one indicator column for each group, and a slope if named.

    Group means are rebuilt from standard normals (non-centred), which samples well where groups are small."""
    b = ModelBuilder()
    mu, tau, sigma = b.normal_prior("mu", 0.0, 5.0), b.half_normal_prior("tau", spread), b.half_normal_prior("sigma", noise)
    eta = sum((b.normal_prior(f"group_{g}", mu, tau) * g for g in groups), 0.0)
    if slope:
        eta = eta + b.normal_prior("beta", 0.0, 5.0) * slope
    b.normal_likelihood("response", eta, sigma, response)
    return b.compile()


def centred_hierarchy(groups: Sequence[str], response: str = "y", scale: float = 2.0, noise: float = 1.0) -> Model:
    """Group means with priors of their own around a population intercept; for groups with many rows."""
    b = ModelBuilder()
    mu, sigma = b.normal_prior("mu", 0.0, 5.0), b.half_normal_prior("sigma", noise)
    eta = mu + 0.0
    for g in groups:
        eta = eta + b.normal_prior(f"offset_{g}", 0.0, scale) * g
    b.normal_likelihood("response", eta, sigma, response)
    return b.compile()
