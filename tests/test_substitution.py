"""Rates estimated from substitution counts."""

import itertools

import numpy as np
import pytest

from simulate import balanced
from treeloom.config import LineageConfig
from treeloom.kernels import likelihood, parsimony
from treeloom.kernels.tree import parse_newick, robinson_foulds
from treeloom.operators import substitution
from treeloom.plans.engine import reconstruct

#: Frequencies of A, C, G, T, rates of AC, AG, AT, CG, CT, GT.
FREQ, RATES = [0.3, 0.2, 0.15, 0.35], [1.0, 4.0, 0.7, 1.3, 5.0, 1.0]


def _evolved(rng, model, rows, sites, length, shape=None):
    """Letters of a star of ``rows`` sequences under ``model``."""
    start = rng.choice(4, sites, p=model.freq)
    pace = rng.gamma(shape, 1 / shape, sites) if shape else np.ones(sites)
    out = []
    for _ in range(rows):
        p = model.along(np.eye(4)[None], (length * pace)[:, None, None]).transpose(0, 2, 1)[np.arange(sites), start]  # chances of each letter
        out.append("".join("ACGT"[k] for k in (p.cumsum(axis=1) < rng.random(sites)[:, None]).sum(axis=1).clip(0, 3)))
    return out


def test_known_rates_are_recovered(spark):
    """Within a tenth, in two clades at once, the third being of one rate; the fitted model beats equal rates."""
    rng = np.random.default_rng(2)
    known = likelihood.Substitution(np.array(FREQ), (1.0,), np.array(RATES))
    flat = likelihood.Substitution(np.full(4, 0.25))
    data = {1: _evolved(rng, known, 8, 60_000, 0.08), 2: _evolved(rng, known, 5, 60_000, 0.15), 3: _evolved(rng, flat, 6, 40_000, 0.1)}
    rows = spark.createDataFrame([(c, s) for c, seqs in data.items() for s in seqs], "clade_id long, seq string").repartition(6)
    got = {r.clade_id: r.model for r in substitution.estimates(rows).collect()}
    scale = lambda freq, rates: np.array(rates) / (2 * sum(freq[i] * freq[j] * x for (i, j), x in zip(itertools.combinations(range(4), 2), rates, strict=True)))
    for c in (1, 2):
        assert np.allclose(got[c][:4], FREQ, atol=0.01)
        assert np.allclose(got[c][4:10], scale(FREQ, RATES), rtol=0.1)
    assert np.allclose(got[3][4:10], scale([0.25] * 4, [1.0] * 6), rtol=0.1)
    t = parse_newick("((a:0.08,b:0.08):0.0001,c:0.08);")
    t.length[0] = 0.08
    sets = parsimony.state_sets(data[1][:4])
    leaf, root = dict(zip("abc", likelihood.tips(sets[:3]), strict=True)), likelihood.tips(sets[3])
    fit = lambda name, model=None: likelihood.log_likelihood(t, leaf, root, likelihood.substitution(name, data[1], model))
    assert fit("GTR", got[1]) > fit("F81") + 100


def test_the_shape_of_uneven_rates(spark):
    """Very uneven, uneven and even rates, changes that others hide included."""
    rng = np.random.default_rng(3)
    model = likelihood.Substitution(np.full(4, 0.25))
    data = {1: _evolved(rng, model, 6, 30_000, 0.05, 0.3), 2: _evolved(rng, model, 6, 30_000, 0.05, 1.0), 3: _evolved(rng, model, 6, 30_000, 0.05)}
    rows = spark.createDataFrame([(c, s) for c, seqs in data.items() for s in seqs], "clade_id long, seq string")
    shape = {r.clade_id: r.model[10] for r in substitution.estimates(rows).collect()}
    assert 0.15 < shape[1] < 0.6 and 0.5 < shape[2] < 2 and shape[3] > 5  # within a factor of two


def test_odd_counts(spark):
    rows = [(1, "AAAA"), (1, "AAAA"), (2, "----"), (2, "NNNN"), (3, "acgt"), (3, "ACGA"), (4, ""), (5, None)]
    df = spark.createDataFrame(rows, "clade_id long, seq string")
    counts = {r.clade_id: r for r in substitution.substitution_counts(df).collect()}
    assert set(counts) == {1, 3}
    assert (counts[1].AA, counts[1].sites, counts[1].changes) == (4, 4, 0)
    assert (counts[3].AA, counts[3].CC, counts[3].GG, counts[3].TT, counts[3].AT, counts[3].changes, counts[3].changes2) == (1, 1, 1, 0, 1, 1, 1)
    for r in substitution.estimates(df).collect():
        assert len(r.model) == 11 and np.isfinite(r.model).all() and min(r.model) > 0 and np.isclose(sum(r.model[:4]), 1)


@pytest.mark.parametrize("model", ["GTR", "GTRGAMMA"])
def test_engine_under_general_rates(spark, model):
    records, truth = balanced(5, 600)
    out = reconstruct(spark.createDataFrame(records, "name string, seq string"), LineageConfig(method="nj", model=model))
    assert robinson_foulds(parse_newick(out.newick()), parse_newick(truth)) == 0
