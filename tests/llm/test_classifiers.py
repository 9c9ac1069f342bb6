import random

import numpy as np
import pyarrow as pa
import pytest

from resgov.llm import factor_machine as M
from resgov.llm import pu_quality as Q

SF = "/root/testdata/sf0.01"


def area(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    ones = label == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() - 1) / 2) / (ones.sum() * (~ones).sum())


@pytest.mark.parametrize("module,label,least", [(M, "toxic", 0.75), (Q, "quality", 0.95)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scores = module.score(docs, labels).toPandas()
    assert len(scores) == docs.count() and scores.score.between(0, 1).all()
    limit = 0.5 if module is M else 0.3
    assert ((scores.score >= limit).astype(int) == scores.predicted).all()
    both = labels.toPandas().merge(scores[scores.held_out], on="doc_id")
    assert area(both.score.to_numpy(), both[label].to_numpy()) > least


def test_machine_learns_pairs():
    """Toxic only where both words meet: no sum of single weights tells these apart."""
    rng = random.Random(5)
    texts, label = [], []
    for i in range(1200):
        words = [rng.choice(["red", "blue", "tree", "house", "river", "stone", "cloud", "light"]) for _ in range(6)]
        kind = rng.randrange(4)
        words += [["plain"], ["insultword"], ["groupname"], ["insultword", "groupname"]][kind]
        rng.shuffle(words)
        texts.append(" ".join(words))
        label.append(float(kind == 3))
    rows = list(M.buckets(pa.array(texts)))
    machine = M.Machine().fit(rows[:900], np.array(label[:900]))
    got = np.array([machine.margin(r) >= 0 for r in rows[900:]])
    assert (got == (np.array(label[900:]) == 1)).mean() > 0.97
    one = machine.margin(rows[0]) * 0 + machine.bias
    assert np.isfinite(one)


@pytest.mark.parametrize("both", [True, False])
def test_machine_learns_pairs_of_balanced_terms(both):
    """Each of the two words is as common in toxic as in clean texts; only their meeting tells."""
    rng = random.Random(6)
    texts, label = [], []
    for _ in range(2000):
        words = [rng.choice(["red", "blue", "tree", "house", "river", "stone", "cloud", "light"]) for _ in range(6)] + [f"rare{rng.randrange(3000)}"]
        kind = rng.randrange(4)
        words += [["plain"] if both else [], ["insultword"], ["groupname"], ["insultword", "groupname"]][kind]
        rng.shuffle(words)
        texts.append(" ".join(words))
        label.append(float(kind in (0, 3)))
    rows = list(M.buckets(pa.array(texts)))
    machine = M.Machine().fit(rows[:1500], np.array(label[:1500]))
    assert 0 < (machine.slot >= 0).sum() < 60  # the words of the pair, not the chance words
    got = np.array([machine.margin(r) >= 0 for r in rows[1500:]])
    assert (got == (np.array(label[1500:]) == 1)).mean() > 0.95


def test_machine_without_pairs_to_find_keeps_no_chance_words():
    rng = random.Random(7)
    rows = list(M.buckets(pa.array([" ".join(f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(60)) for _ in range(1500)])))
    machine = M.Machine()
    machine.choose(rows, np.array([float(rng.random() < 0.3) for _ in rows]))
    assert (machine.slot >= 0).sum() <= 2


def test_gradients_of_the_machine():
    """Slopes against finite differences of the loss that margin() gives."""
    rng = np.random.default_rng(1)
    machine = M.Machine()
    machine.bias, machine.linear, machine.factors = 0.1, rng.normal(0, 0.3, 12), rng.normal(0, 0.3, (12, M.FACTORS))
    machine.slot[:12] = np.arange(12)
    rows = [rng.choice(12, n, replace=False) for n in (1, 5, 12)]
    label = np.array([1.0, 0.0, 1.0])

    def loss():
        z = np.array([machine.margin(r) for r in rows])
        return (np.log1p(np.exp(z)) - label * z).sum()

    keys, by_weight, by_factor, by_bias = machine.gradients(np.concatenate(rows), np.array([len(r) for r in rows]), label)
    eps = 1e-6
    for i, k in enumerate(keys):
        for array, want in ((machine.linear[k:k + 1], by_weight[i]), (machine.factors[k, 3:4], by_factor[i, 3])):
            array += eps
            up = loss()
            array -= 2 * eps
            down = loss()
            array += eps
            assert (up - down) / (2 * eps) == pytest.approx(want, abs=1e-5)
    machine.bias += eps
    up = loss()
    machine.bias -= 2 * eps
    assert (up - loss()) / (2 * eps) == pytest.approx(by_bias, abs=1e-5)


def test_slopes_of_the_risk():
    """The non-negative risk's slopes against finite differences, on both of its branches."""
    rng = np.random.default_rng(2)
    branches = set()
    for shift, prior in ((0.0, 0.3), (-4.0, 0.9), (2.0, None)):
        zp, zu = rng.normal(1, 1, 40), rng.normal(shift, 1, 60)

        def risk(zp, zu):
            one, zero = lambda z: np.log1p(np.exp(-z)).mean(), lambda z: np.log1p(np.exp(z)).mean()
            if prior is None:
                return one(zp) + zero(zu), True
            rest = zero(zu) - prior * zero(zp)
            return (prior * one(zp) + rest, True) if rest >= 0 else (-rest, False)

        branches.add(risk(zp, zu)[1])
        sigmoid = lambda z: 1 / (1 + np.exp(-z))
        slopes = Q.Network.slopes(sigmoid(zp), sigmoid(zu), prior)
        for z, part in ((zp, slopes[:40]), (zu, slopes[40:])):
            for i in (0, 7, 31):
                z[i] += 1e-6
                up = risk(zp, zu)[0]
                z[i] -= 2e-6
                down = risk(zp, zu)[0]
                z[i] += 1e-6
                assert (up - down) / 2e-6 == pytest.approx(part[i], abs=1e-6)
    assert branches == {True, False}


def test_repeated_rows_are_learnt_from_once(spark):
    """300 repeats of a labelled row on both sides are one training row, and change no score."""
    docs = spark.createDataFrame([(i, f"text number {i} of the set", "en") for i in range(40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    many = docs.unionByName(docs.where("doc_id = 1").crossJoin(spark.range(300)).drop("id"))
    twice = labels.unionByName(labels.where("doc_id = 1").crossJoin(spark.range(300)).drop("id"))
    for size in (1000, 7):
        rows = M.sampled(many, twice, "toxic", 5, size)
        assert rows.count() == rows.select("doc_id").distinct().count() == min(size, M.sampled(docs, labels, "toxic", 5, 1000).count())
    for module in (M, Q):
        one, two = ({(r.doc_id, r.score) for r in module.score(d, x).collect()} for d, x in ((docs, labels), (many, twice)))
        assert one == two


def test_prior_is_estimated():
    rng = np.random.default_rng(1)
    positive, negative = rng.normal(2, 1, (3000, 4)), rng.normal(-2, 1, (3000, 4))
    for share in (0.3, 0.8):
        n = int(2500 * share)
        unlabelled = rng.permutation(np.concatenate([positive[500:500 + n], negative[:2500 - n]]))
        model = Q.Model(positive[:500].copy(), unlabelled)
        assert abs(model.prior - share) < 0.1
        assert area(np.concatenate([model.score(positive[-200:]), model.score(negative[-200:])]), np.repeat([1, 0], 200)) > 0.99


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, None, None), (None, 1, 1), (6, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    empty = labels.limit(0)
    for module in (M, Q):
        for some in (labels, empty):
            rows = module.score(odd, some).collect()
            assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
            assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
        assert module.score(nothing, labels).collect() == []


def test_measures_of_junk():
    clean, shout, junk = Q.measures(pa.array(["the house is old. it stands by the river.", "THE!! HOUSE!! IS!! OLD!!", None]))
    assert shout[20] == 1.0 and clean[20] == 0.0 and not junk.any()
