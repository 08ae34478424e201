import itertools
import random

import numpy as np
import pytest

from treeloom.config import LineageConfig
from simulate import balanced
from treeloom.kernels import align, distance, likelihood, parsimony
from treeloom.kernels.sample_tree import Model, Placer, build_tree, cut, edit_vocabulary, encode_edits, upper_tree
from treeloom.kernels.tree import Tree, induced, parse_newick, robinson_foulds, to_newick


def test_newick_round_trip():
    text = "((a:1.00000,b:2.00000)x:1.00000,(c:1.00000,'d e':2.00000)y:3.00000)r;"
    assert to_newick(parse_newick(text)) == text
    assert to_newick(parse_newick("(a[note]:1e-3,b);"), lengths=False) == "(a,b);"
    assert to_newick(parse_newick("only;")) == "only;"


def test_deep_chain_needs_no_recursion():
    t = Tree([-1], [None], [0.0])
    v = 0
    for i in range(5000):
        t.add(v, f"t{i}")
        v = t.add(v)
    t.name[v] = "last"
    back = parse_newick(to_newick(t))
    assert len(back.leaves()) == 5001
    assert len(induced(back, {"t0", "t4999"})) == 3


def test_induced_hangs_survivors_on_the_nearest_whole_node():
    t = parse_newick("((a:1,b:2)x:1,(c:1,d:2)y:3)r;")
    assert to_newick(induced(t, {"a", "c", "d"})) == "(a:1.00000,(c:1.00000,d:2.00000)y:3.00000)r;"


def _simulated(depth=4, seed=0):
    records, newick = balanced(depth, 600, seed=seed)
    return records[0][1], [n for n, _ in records[1:]], [s for _, s in records[1:]], parse_newick(newick)


@pytest.mark.parametrize("method", ["mp", "nj", "ml"])
def test_sample_trees_recover_the_truth(method):
    root, names, seqs, truth = _simulated()
    order = random.Random(1).sample(range(len(names)), len(names))
    t = build_tree([names[i] for i in order], [seqs[i] for i in order], root, LineageConfig(method=method))
    assert robinson_foulds(t, truth) == 0


def test_user_builder_is_rooted_at_the_root():
    t = build_tree(["a", "b", "c"], ["A"] * 3, "A", LineageConfig(builder=lambda names, seqs: "((root:1,a:1):1,(b:1,c:1):1);"))
    assert sorted(map(sorted, (s for s in [{"b", "c"}]))) == [["b", "c"]]
    assert robinson_foulds(t, parse_newick("(a,(b,c));")) == 0


def test_neighbor_joining_on_an_additive_matrix():
    t = parse_newick("((a:3,b:2):1,(c:4,(d:1,e:5):2):2);")
    up = lambda v: [] if v < 0 else [v, *up(t.parent[v])]
    leaf = {t.name[v]: v for v in t.leaves()}
    names = [*leaf, "root"]
    far = lambda a, b: sum(t.length[v] for v in set(up(leaf[a])) ^ set(up(leaf[b])))
    top = lambda a: sum(t.length[v] for v in up(leaf[a])) + 1
    d = np.array([[0 if a == b else top(b) if a == "root" else top(a) if b == "root" else far(a, b) for b in names] for a in names], float)
    assert robinson_foulds(distance.neighbor_joining(names, d), t) == 0


def test_insertion_cost_is_the_growth_of_the_parsimony_length():
    rng = np.random.default_rng(0)
    seqs = ["".join(rng.choice(list("ACGT"), 30)) for _ in range(7)]
    sets = parsimony.state_sets(seqs)
    names = list("abcde")
    leaf, root, q = dict(zip(names, sets[:5], strict=True)), sets[5], sets[6]
    t = parsimony.stepwise(names, sets[:5], root)
    base = parsimony.length(t, leaf, root)
    costs = parsimony.insertion_costs(t, leaf, root, q)
    for v in range(len(t)):
        grown = Tree(list(t.parent), list(t.name), list(t.length))
        joint = grown.add(grown.parent[v])
        grown.parent[v] = joint
        grown.add(joint, "q")
        assert parsimony.length(grown.renumbered(), leaf | {"q": q}, root) == base + costs[v]


@pytest.mark.parametrize("placement", ["ML", "MP"])
def test_placement_finds_each_sampled_taxon(placement):
    root, names, seqs, _ = _simulated()
    t = build_tree(names, seqs, root, LineageConfig(method="nj"))
    m = Model(parsimony.with_lengths(t, dict(zip(names, parsimony.state_sets(seqs), strict=True)), parsimony.state_sets([root])[0]), names, seqs, root, None)
    p = Placer(m, LineageConfig(placement=placement), 0, 0)
    assert [m.tree.name[e] for e in p.best(names, seqs)] == names
    assert Placer(m, LineageConfig(placement=placement, careful=3), 0, 0).best(names, seqs) == Placer(m, LineageConfig(placement=placement, careful=3), 0, 0).best(names, seqs)


def test_cut_of_the_worked_example():
    t = parse_newick("((a,b)x,(c,d)y)I;").renumbered()
    at = {t.name[v]: v for v in range(len(t))}
    owner, owned, empty = cut(t, {at["a"]: 1, at["y"]: 3, at["c"]: 1}, 4)
    assert {t.name[v]: n for v, n in owned.items()} == {"a": 1, "y": 4}
    assert [t.name[v] for v in empty] == ["b"]
    assert owner[at["d"]] == at["y"]
    assert len(upper_tree(t, owned, 5, 1)) == 3  # b is pruned, and x with it
    assert cut(t, {}, 2)[1] == {at["x"]: 0, at["y"]: 0}  # at the limit the cut is immediate


def test_edit_vocabulary_and_encoding():
    rows = [["x", "y"], ["x"], ["x", "z", "z"]]
    assert edit_vocabulary(rows, 3) == ["y", "z"]  # x is in every row
    assert edit_vocabulary(rows, 4) == ["x", "y", "z"]
    assert encode_edits(["y"], ["w", "x", "y", "z"]) == "CCTG"
    assert encode_edits([], []) == ""


def test_alignment():
    assert align.to_profile("ACGTTACG", align.profile(["ACGTACG"])) == "ACGTACG"
    assert align.to_profile("ACACG", align.profile(["ACGTACG"])).count("-") == 2
    assert align.to_profile("", align.profile(["ACG"])) == "---"


def test_likelihood_of_the_truth_is_no_worse():
    root, names, seqs, truth = _simulated(3)
    sets = parsimony.state_sets([*seqs, root])
    leaf = dict(zip(names, sets[:-1], strict=True))
    good = parsimony.with_lengths(truth.renumbered(), leaf, sets[-1])
    tips = {n: likelihood.tips(s) for n, s in leaf.items()}
    best = likelihood.log_likelihood(good, tips, likelihood.tips(sets[-1]))
    for a, b in itertools.islice(itertools.combinations(good.leaves(), 2), 6):
        wrong = Tree(list(good.parent), list(good.name), list(good.length))
        wrong.name[a], wrong.name[b] = wrong.name[b], wrong.name[a]
        assert likelihood.log_likelihood(wrong, tips, likelihood.tips(sets[-1])) <= best + 1e-6


def test_config_rejects_what_cannot_run():
    for bad in ({"method": "x"}, {"placement": "XX"}, {"edits": True}, {"max_rounds": 1}, {"unresolved": "?"}, {"subsample": 1}):
        with pytest.raises(ValueError):
            LineageConfig(**bad)
    assert [LineageConfig(model=m).substitution() for m in ("GTR", "GTRCAT", "GTRGAMMA", "F81")] == ["GTR", "GTR+G", "GTR+G", "F81"]
    assert LineageConfig().estimated() and not LineageConfig(placement="MP").estimated() and not LineageConfig(model="JC").estimated()
    assert LineageConfig(method="rapidnjNJ").method == "nj"


#: Frequencies of A, C, G, T, rates of AC, AG, AT, CG, CT, GT, gamma shape.
KNOWN = [0.3, 0.2, 0.15, 0.35, 1.0, 4.0, 0.7, 1.3, 5.0, 1.0, 0.5]


@pytest.mark.parametrize("name", ["JC", "F81", "F81+G", "GTR", "GTR+G"])
def test_likelihoods_of_all_patterns_sum_to_one(name):
    from itertools import product

    model = likelihood.substitution(name, ["AAAC", "AGTA"], KNOWN if name.startswith("GTR") else None)
    assert abs(np.mean(model.rates) - 1) < 1e-12 and abs(model.freq.sum() - 1) < 1e-12
    t = parse_newick("((a:0.1,b:0.3):0.2,c:0.5);")
    t.length[0] = 0.15
    total = 0.0
    for letters in product("ACGT", repeat=4):
        sets = parsimony.state_sets(list(letters))
        leaf = dict(zip("abc", likelihood.tips(sets[:3]), strict=True))
        total += np.exp(likelihood.log_likelihood(t, leaf, likelihood.tips(sets[3]), model))
    assert abs(total - 1) < 1e-9


def test_general_rates():
    """With equal rates the general model is Felsenstein's; with others it is another one, reversible, of one change a unit of time."""
    sets = likelihood.tips(parsimony.state_sets(["ACGT"]))[0]
    plain = likelihood.substitution("F81", ["AACGTT"])
    same = likelihood.Substitution(plain.freq, (1.0,), np.ones(6))
    assert np.allclose(plain.along(sets, 0.3), same.along(sets, 0.3))
    model = likelihood.substitution("GTR", [], KNOWN)
    p = model.along(np.eye(4), 0.2)  # column j: the chance of j after the branch
    assert np.allclose(p.T.sum(axis=1), 1) and np.allclose(model.freq[:, None] * p.T, (model.freq[:, None] * p.T).T)
    small = model.along(np.eye(4), 1e-5).T
    assert np.isclose(model.freq @ (1 - small.diagonal()), 1e-5, rtol=1e-3)
    assert np.allclose(likelihood.gamma_rates(4, 1.0), [0.1369, 0.4768, 1.0, 2.3863], atol=2e-3)
    assert np.isclose(np.mean(likelihood.gamma_rates(4, 0.3)), 1) and np.ptp(likelihood.gamma_rates(4, 50.0)) < 0.5 < np.ptp(likelihood.gamma_rates(4, 0.3))
