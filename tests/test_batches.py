import numpy as np

from credence.operators import samplers as H
from credence.plans.queries_models import regression_model


def test_many_chains_step_together_and_draw_as_alone():
    """A task's batch holds 1,000 chains, and none of them draws otherwise for it."""
    assert H.TOGETHER >= 1000
    rng, model = np.random.default_rng(0), regression_model()
    n = np.full(300, 40.0)
    x = rng.normal(size=(300, 40))
    z = np.stack([x, 1 + 0.5 * x + rng.normal(size=(300, 40))], 2)
    mean = z.mean(1)
    cross = np.einsum("dni,dnj->dij", z - mean[:, None], z - mean[:, None])
    seeds = [(42, k) for k in range(300)]
    whole, _ = H.run_chains(H.Target(model, stats=[(n, mean, cross)]), 5, 30, seeds)
    for k in (0, 255, 256, 299):
        one, _ = H.run_chains(H.Target(model, stats=[(n[k : k + 1], mean[k : k + 1], cross[k : k + 1])]), 5, 30, seeds[k : k + 1])
        assert np.allclose(one[0], whole[k], rtol=1e-9)
