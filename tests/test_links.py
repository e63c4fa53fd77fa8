"""The graph network, its protocol and its measure against plain Python."""

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow import queries_more
from riskflow.operators import features, graph, links
from riskflow.sources import ledger


def rows_of(spark, arcs):
    day = dt.date(2024, 1, 1)
    rows = [(f"t{k:05}", day + dt.timedelta(days=d), u, v, 1000.0 * (k % 7 + 1), f"transfer {k}") for k, (d, u, v) in enumerate(arcs)]
    df = spark.createDataFrame(rows, "txn_id string, date date, debit_inn string, credit_inn string, amount double, purpose string")
    return features.base(df.withColumns({"debit_amount": F.col("amount"), "credit_amount": F.lit(0.0)}), ("loan",))


@pytest.fixture(scope="module")
def arcs():
    """Two kinds of parties that only transfer within their kind, and odd rows."""
    rng = np.random.default_rng(3)
    out = []
    for day in range(100):
        for _ in range(6):
            kind = int(rng.integers(2))
            u, v = rng.choice(12, 2, replace=False)
            out.append((day, f"{'ab'[kind]}{u}", f"{'ab'[kind]}{v}"))
    return [*out, (3, "a1", "a1"), (4, None, "a2"), (5, "a3", None), (50, None, None)]


@pytest.mark.parametrize("scores", [[0.1, 0.4, 0.4, 0.8, 0.4, 0.1], [0.5] * 6, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [None, 0.2, 0.3, 0.3, 0.2, 0.9]])
def test_ranking_quality(spark, scores):
    labels = [0, 1, 0, 1, 1, 0]
    df = spark.createDataFrame(list(zip(scores, labels, strict=True)), "s double, label int")
    got = links.ranking_quality(df, "s").first()
    known = [(s, y) for s, y in zip(scores, labels, strict=True) if s is not None]
    pairs = [(s, t) for (s, y), (t, z) in itertools.product(known, known) if y == 1 and z == 0]
    area = sum((s > t) + (s == t) / 2 for s, t in pairs) / len(pairs)
    above = {s: [y for t, y in known if t >= s] for s, _ in known}
    precision = sum(sum(above[s]) / len(above[s]) for s, y in known if y) / sum(y for _, y in known)
    assert (got["links"], got["others"]) == (sum(y for _, y in known), sum(1 - y for _, y in known))
    assert math.isclose(got["roc_auc"], area) and math.isclose(got["average_precision"], precision)


def test_ranking_quality_of_nothing(spark):
    one = spark.createDataFrame([(0.5, 1), (0.7, 1)], "s double, label int")
    assert tuple(links.ranking_quality(one, "s").first()) == (2, 0, None, 1.0)
    assert tuple(links.ranking_quality(one.limit(0), "s").first()) == (0, 0, None, None)


def test_no_later_link_leaks(spark, arcs):
    """Changing what comes after the first cut changes no feature of a pair that both asks for."""
    known = [a for a in arcs if a[1] and a[2] and a[1] != a[2]]
    days = sorted(a[0] for a in known)
    cut = np.quantile(days, 0.7)
    later = [(d, v, u) if d > cut else (d, u, v) for d, u, v in arcs if u and v]
    one, two = ({(r["u"], r["v"]): tuple(r[n] for n in graph.LINK_FEATURES) for r in links.temporal_links(rows_of(spark, x)).collect()} for x in (arcs, later))
    both = one.keys() & two.keys()
    assert len(both) > 20 and all(np.allclose(one[k], two[k]) for k in both)


def test_protocol(spark, arcs):
    got = links.temporal_links(rows_of(spark, arcs)).collect()
    ever = {(u, v) for _, u, v in arcs if u and v}
    assert len({(r["part"], r["u"], r["v"]) for r in got}) == len(got)
    assert all(((r["u"], r["v"]) in ever) == (r["label"] == 1) and r["u"] != r["v"] for r in got)
    neighbours = {}
    cut = np.quantile([d for d, u, v in arcs if u and v and u != v], 0.7)
    for d, u, v in arcs:
        if u and v and u != v and d <= cut:
            neighbours.setdefault(u, set()).add(v)
            neighbours.setdefault(v, set()).add(u)
    for r in got:
        a, b = neighbours.get(r["u"], set()), neighbours.get(r["v"], set())
        assert r["common"] == len(a & b) and math.isclose(r["jaccard"], len(a & b) / max(1, len(a | b)))
        assert math.isclose(r["preferential"], math.log1p(len(a) * len(b))) and math.isclose(r["adamic_adar"], sum(1 / math.log(len(neighbours[w])) for w in a & b if len(neighbours[w]) > 1), abs_tol=1e-9)


def test_messages(spark, arcs):
    """Two steps on a small graph with a hub, a pair apart and a node without neighbours, against a matrix."""
    names = ["p", "q"]
    edges = [("hub", f"n{k}") for k in range(9)] + [("n0", "n1"), ("x", "y")]
    nodes = sorted({n for e in edges for n in e} | {"alone"})
    x = {n: (len(n) + k * 0.5, (k * 7) % 5 - 1.0) for k, n in enumerate(nodes)}
    df = spark.createDataFrame([(n, *v) for n, v in x.items()], "inn string, p double, q double")
    got = {r["inn"]: r["x"] for r in links.messages(df, names, graph._arcs(spark.createDataFrame(edges, "u string, v string")), 2).collect()}
    a = np.zeros((len(nodes), len(nodes)))
    for u, v in edges:
        a[nodes.index(u), nodes.index(v)] = a[nodes.index(v), nodes.index(u)] = 1
    a /= np.maximum(a.sum(1, keepdims=True), 1)
    x0 = np.array([x[n] for n in nodes])
    want = np.concatenate((x0, a @ x0, a @ a @ x0), 1)
    assert np.allclose([got[n] for n in nodes], want)


def test_gradients():
    rng = np.random.default_rng(0)
    net = links.LinkNet(width=5, hidden=6, size=4)
    net.start(3, 2, 1)
    a, b, e, label = rng.normal(size=(8, 3)), rng.normal(size=(8, 3)), rng.normal(size=(8, 2)), np.array([1, 0, 1, 1, 0, 1, 0, 0])
    keep = (rng.random((8, 5)) > 0.3) / 0.7
    _, g = net.loss(a, b, e, label, 0.3, 0.5, keep)
    for name, w in net.weights.items():
        flat = w.reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 5)):
            was = flat[i]
            flat[i] = was + 1e-5
            high, _ = net.loss(a, b, e, label, 0.3, 0.5, keep)
            flat[i] = was - 1e-5
            low, _ = net.loss(a, b, e, label, 0.3, 0.5, keep)
            flat[i] = was
            assert abs((high - low) / 2e-5 - g[name].reshape(-1)[i]) < 1e-6, name


def test_the_network_learns_kinds_and_scores_every_pair(spark, arcs):
    df = rows_of(spark, arcs)
    model = links.fit_links(df)
    quality = links.ranking_quality(links.score_links(model, model.given.asked.where("part = 'test'")), "chance").first()
    assert quality["roc_auc"] > 0.8 and quality["average_precision"] > 0.75
    got = links.score_links(model, model.given.pairs).collect()
    assert {(r["u"], r["v"]) for r in got} == {(u, v) for _, u, v in arcs if u and v and u != v} and all(0 < r["chance"] < 1 for r in got)
    pair = got[0]  # as plain numpy has it
    x = {r["inn"]: np.array(r["x"]) for r in model.x.collect()}
    e = links._vectors(spark.createDataFrame([(pair["u"], pair["v"])], "u string, v string"), model.given.before, model.scale)[0].first()["e"]
    za, zb = (model.net.ends(x.get(pair[k], np.zeros(model.width))[None])[1] for k in "uv")
    assert math.isclose(model.net.chances(za, zb, np.array([e]))[0], pair["chance"])


def test_nothing_to_learn(spark):
    df = rows_of(spark, [(k, "a", "b") for k in range(3)] + [(2, "c", "c")])
    assert {r["edge_risk"] for r in links.link_risk(df).collect()} == {0.5}
    assert links.link_risk(df.limit(0)).count() == 0


def test_network_needs_the_table(spark):
    df = features.base(ledger.prepare(ledger.synthetic_ledger(spark, "/root/testdata/sf0.001")), queries_more.STEMS)
    node = graph.node_risk(links.link_risk(df, how=links.Training(epochs=3)))
    assert node.where(~F.col("node_risk").between(0, 1)).count() == 0 and node.count() >= 150
