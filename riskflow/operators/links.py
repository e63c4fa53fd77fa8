"""Which transfers could have been expected: a graph network over parties, and the protocol that trains and measures it.

The features of a pair come from transfers up to the first cut in time, the links to predict from later ones, so nothing of what is to be predicted is known.

1. *Protocol* (``temporal_links``): pairs that transfer after a cut, against as many draws of pairs that never do.
2. *Messages* (``messages``): each party's features, the mean of its neighbours', of theirs, and so on, a join and an aggregation for each step.  The
   weights work on all steps at once (as scalable inception networks do), so they needn't be there when messages are passed.
3. *Network* (``LinkNet``): each end's steps become a vector; both vectors, their product, the pair's history and the link features give the chance of a link.
   Trained in numpy on at most ``sample`` pairs, with messages over a graph that lost a share of its edges and a term that tells the partners in a batch apart.
4. *Scores* (``link_risk``): 1 - p of every directed pair, in Arrow batches.

Rows without a party and transfers to oneself make no links.  Without links before or after the first cut there is nothing to learn: all risks are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.functions import exprs as E
from riskflow.operators import graph

MEASURES = ("log_amount", "is_round_10k", "purpose_len", "purpose_digits_ratio")
PAIR_KEY = ["u", "v"]
#: what features of parties and pairs come from
LOOKED_AT = (*PAIR_KEY, "part", "date", "amount", *MEASURES, "is_round_100k")


def transfers(df: DataFrame) -> DataFrame:
    return df.where("debit_inn is not null and credit_inn is not null and debit_inn <> credit_inn")


def _digits(name: str, salt: str, n: Column) -> Column:
    """A number below ``n`` from a column and a salt, the same in any engine that has md5."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.col(name).cast("string"), F.lit(salt))), 1, 12), 16, 10).cast("long"), n)


def drawn_pairs(nodes: DataFrame, draws: DataFrame, seed: int = 42) -> DataFrame:
    """For each row of ``draws`` (``i``), a pair u, v of different nodes, each drawn alike; draws of the same node twice are left out.
    ``nodes``: inn and id, from 0 on."""
    n = nodes.agg(F.count(F.lit(1)).alias("_n"))  # one row
    draws = draws.crossJoin(F.broadcast(n)).withColumns({k: _digits("i", f"|{k}|{seed}", F.col("_n")) for k in PAIR_KEY})
    for k in PAIR_KEY:
        draws = draws.join(nodes.select(F.col("id").alias(k), F.col("inn").alias(f"_{k}")), k).drop(k).withColumnRenamed(f"_{k}", k)
    return draws.drop("_n").where("u <> v")


@dataclass
class Protocol:
    """``before``: transfers up to the first cut; ``pairs``: all directed pairs ever; ``asked``: part, u, v, label."""

    before: DataFrame
    pairs: DataFrame
    asked: DataFrame


def protocol(df: DataFrame, cuts: tuple[float, float] = (0.7, 0.85), seed: int = 42) -> Protocol:
    """Links of each part after the first cut, and for each a draw (a link's number in its part is what is drawn with) that is dropped if it ever
    is a link, or drawn twice."""
    rows = graph.temporal_split(transfers(df), cuts).withColumnsRenamed({"debit_inn": "u", "credit_inn": "v"})
    rows = E.cut(rows.select(*(c for c in rows.columns if c in LOOKED_AT)))
    pairs = rows.select("u", "v").distinct()
    positive = E.cut(rows.where("part <> 'train'").select("part", "u", "v").distinct())
    nodes = E.cut(graph.node_ids(rows.select(F.col("u").alias("debit_inn"), F.col("v").alias("credit_inn"))))
    counts = positive.groupBy("part").count().collect()  # two rows
    session = df.sparkSession
    draws = session.range(0).select(F.lit("").alias("part"), F.lit("").alias("i"))
    for part, n in sorted(map(tuple, counts)):
        draws = draws.unionByName(session.range(n).select(F.lit(part).alias("part"), F.concat(F.lit(f"{part}|"), F.col("id").cast("string")).alias("i")))
    negative = drawn_pairs(nodes, draws, seed).select("part", "u", "v").distinct().join(pairs, PAIR_KEY, "left_anti")
    asked = positive.withColumn("label", F.lit(1)).unionByName(negative.withColumn("label", F.lit(0)))
    return Protocol(rows.where("part = 'train'"), pairs, asked)


def link_features(asked: DataFrame, before: DataFrame) -> DataFrame:
    """``asked`` with the link features (``graph.LINK_FEATURES``) of its pairs, in either direction, in the graph of the earlier transfers."""
    known = graph.edges(before.withColumnsRenamed({"u": "debit_inn", "v": "credit_inn"}))
    one = asked.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    got = graph.structural_links(before, graph.common_neighbours(one, E.cut(known.select("u", "v"))))
    got = got.withColumnsRenamed({"u": "_u", "v": "_v"})
    both = asked.withColumns({"_u": F.least("u", "v"), "_v": F.greatest("u", "v")})
    return both.join(got, ["_u", "_v"], "left").drop("_u", "_v").na.fill(0.0, ["jaccard"])


@E.tidy
def temporal_links(df: DataFrame, cuts: tuple[float, float] = (0.7, 0.85), seed: int = 42) -> DataFrame:
    """``part`` (valid, test), ``u``, ``v``, ``label`` and the link features of all pairs of the protocol."""
    p = protocol(df, cuts, seed)
    return link_features(p.asked, p.before)


def ranking_quality(scored: DataFrame, score: str, label: str = "label") -> DataFrame:
    """One row: ``links``, ``others``, the area under the ROC curve (ties count half) and the average precision (a threshold at each distinct score).
    From counts of distinct scores; these are dealt by range, so no task sorts all of them.  Rows without score or label don't count; without
    links or others the area is null, without links the precision is."""
    counts = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    ranged = E.cut(counts.repartitionByRange(F.desc("s")).withColumn("_k", F.spark_partition_id()))
    totals = ranged.groupBy("_k").agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))  # a row for each range
    above, all_of = Window.partitionBy(F.lit(0)).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    starts = totals.select("_k", *(F.coalesce(F.sum(f"t{c}").over(above), F.lit(0)).alias(f"_{c}") for c in "pn"), *(F.sum(f"t{c}").over(all_of).alias(f"all_{c}") for c in "pn"))
    inside = Window.partitionBy("_k").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumns({f"in_{c}": F.sum(c).over(inside) for c in "pn"}).join(F.broadcast(starts), "_k")
    p, n = F.col("_p") + F.col("in_p"), F.col("_n") + F.col("in_n")  # with this score or a higher one
    all_p, all_n = F.first("all_p"), F.first("all_n")
    area = F.sum(F.col("n") * (p - F.col("p") / 2)) / (all_p * F.nullif(all_n, F.lit(0)))
    precision = F.sum(F.col("p") * p / (p + n))
    return placed.agg(
        F.coalesce(all_p, F.lit(0)).alias("links"), F.coalesce(all_n, F.lit(0)).alias("others"),
        F.when(all_p > 0, area).alias("roc_auc"), F.when(all_p > 0, precision / all_p).alias("average_precision"),
    )


def standard_nodes(before: DataFrame, measures: tuple[str, ...] = MEASURES) -> tuple[DataFrame, list[str]]:
    """``inn`` and, for each party in the earlier transfers, mean and median of the measures in both roles, the logs of its transfers in each and of its degree; all
    standardised over the parties."""
    named = before.withColumnsRenamed({"u": "debit_inn", "v": "credit_inn"})
    nodes = graph.node_features(named, list(measures))
    counted = named.groupBy(F.col("debit_inn").alias("inn")).agg(F.log1p(F.count(F.lit(1))).alias("out_log")).join(named.groupBy(F.col("credit_inn").alias("inn")).agg(F.log1p(F.count(F.lit(1))).alias("in_log")), "inn", "full_outer")
    degree = graph._arcs(graph.edges(named)).groupBy(F.col("u").alias("inn")).agg(F.log1p(F.count(F.lit(1))).alias("degree_log"))
    nodes = E.cut(nodes.join(counted, "inn", "left").join(degree, "inn", "left").na.fill(0.0))
    names = [c for c in nodes.columns if c != "inn"]
    return E.zscores(nodes, names), names


def messages(nodes: DataFrame, names: list[str], arcs: DataFrame, steps: int = 2) -> DataFrame:
    """``inn`` and ``x``: the node's own features, then those that came after one step, two and so on.  A step takes the mean over all neighbours (0 without
    any).  ``arcs``: u, v in both directions.  Sums are added up before the shuffle, so a hub is no large group."""
    reached = E.cut(nodes.select("inn", F.array(*names).alias("x0")))
    for step in range(1, steps + 1):
        sent = arcs.join(reached.select(F.col("inn").alias("v"), F.col(f"x{step - 1}").alias("m")), "v")
        means = sent.groupBy(F.col("u").alias("inn")).agg(*(F.avg(F.col("m")[k]).alias(f"_{k}") for k in range(len(names))))
        means = means.select("inn", F.array(*(f"_{k}" for k in range(len(names)))).alias("m"))
        reached = E.cut(reached.join(means, "inn", "left").withColumn(f"x{step}", F.coalesce("m", F.array_repeat(F.lit(0.0), len(names)))).drop("m"))
    return reached.select("inn", F.concat(*(f"x{k}" for k in range(steps + 1))).alias("x"))


@dataclass
class LinkNet:
    """Weights, by name.  Arrays of pairs: the ends' messages ``a`` and ``b``, and the pair's own features ``e``."""

    width: int
    hidden: int = 64
    size: int = 32
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, d: int, e: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        shapes = {"w1": (d, self.hidden), "w2": (self.hidden, self.size), "w3": (3 * self.size + e, self.width), "w4": (self.width, 1)}
        self.weights = {k: rng.normal(0, np.sqrt(2 / s[0]), s) for k, s in shapes.items()} | {f"b{k[1]}": np.zeros(s[1]) for k, s in shapes.items()}

    def ends(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.weights["w1"] + self.weights["b1"], 0)
        return h, h @ self.weights["w2"] + self.weights["b2"]

    def chances(self, za: np.ndarray, zb: np.ndarray, e: np.ndarray) -> np.ndarray:
        y = np.concatenate((za, zb, za * zb, e), 1)
        h = np.maximum(y @ self.weights["w3"] + self.weights["b3"], 0)
        return 1 / (1 + np.exp(-np.clip((h @ self.weights["w4"] + self.weights["b4"])[:, 0], -40, 40)))

    def loss(self, a: np.ndarray, b: np.ndarray, e: np.ndarray, label: np.ndarray, contrast: float, heat: float, keep: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Cross entropy, and over the links of a batch that of finding the partner among all ends of links by cosine; with gradients.  ``keep``: dropout."""
        w, n = self.weights, len(label)
        (ha, za), (hb, zb) = self.ends(a), self.ends(b)
        y = np.concatenate((za, zb, za * zb, e), 1)
        raw = y @ w["w3"] + w["b3"]
        gate = (raw > 0) * (1 if keep is None else keep)
        h = raw * gate
        p = 1 / (1 + np.exp(-np.clip((h @ w["w4"] + w["b4"])[:, 0], -40, 40)))
        total = -np.mean(np.where(label == 1, np.log(p + 1e-12), np.log(1 - p + 1e-12)))
        d4 = ((p - label) / n)[:, None]
        g = {"w4": h.T @ d4, "b4": d4.sum(0)}
        d3 = d4 @ w["w4"].T * gate
        g |= {"w3": y.T @ d3, "b3": d3.sum(0)}
        dy, s = d3 @ w["w3"].T, self.size
        da, db = dy[:, :s] + dy[:, 2 * s : 3 * s] * zb, dy[:, s : 2 * s] + dy[:, 2 * s : 3 * s] * za
        linked = np.flatnonzero(label == 1)
        if contrast and len(linked) > 1:
            na, nb = (np.linalg.norm(z[linked], axis=1, keepdims=True) + 1e-9 for z in (za, zb))
            ua, ub = za[linked] / na, zb[linked] / nb
            close = ua @ ub.T / heat
            q = np.exp(close - close.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            total -= contrast * np.mean(np.log(np.diag(q) + 1e-12))
            d = contrast * (q - np.eye(len(linked))) / len(linked) / heat
            dua, dub = d @ ub, d.T @ ua
            da[linked] += (dua - ua * (dua * ua).sum(1, keepdims=True)) / na
            db[linked] += (dub - ub * (dub * ub).sum(1, keepdims=True)) / nb
        d1a, d1b = da @ w["w2"].T * (ha > 0), db @ w["w2"].T * (hb > 0)
        g |= {"w2": ha.T @ da + hb.T @ db, "b2": da.sum(0) + db.sum(0), "w1": a.T @ d1a + b.T @ d1b, "b1": d1a.sum(0) + d1b.sum(0)}
        return float(total), g


def _area(p: np.ndarray, label: np.ndarray) -> float:
    _, at, n = np.unique(p, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(n) - (n - 1) / 2)[at]
    k = int(label.sum())
    return (ranks[label == 1].sum() - k * (k + 1) / 2) / max(1, k * (len(label) - k))


@dataclass
class Training:
    """``sample``: pairs at most, for training and stopping together."""

    sample: int = 20_000
    held: float = 0.2
    epochs: int = 60
    patience: int = 8
    batch: int = 512
    rate: float = 2e-3
    decay: float = 1e-4
    dropout: float = 0.2
    contrast: float = 0.15
    heat: float = 0.2
    steps: int = 2
    drop_edges: float = 0.15
    seed: int = 42


def train(a: np.ndarray, b: np.ndarray, e: np.ndarray, label: np.ndarray, how: Training) -> LinkNet:
    """Adam with a falling rate; the weights with the best area under the curve on a held share stay."""
    rng = np.random.default_rng(how.seed)
    net = LinkNet(width=64)
    net.start(a.shape[1], e.shape[1], how.seed)
    order = rng.permutation(len(label))
    held, rest = np.split(order, [int(how.held * len(order))])
    best, kept, waited = -1.0, {k: v.copy() for k, v in net.weights.items()}, 0
    m1, m2, t = {k: np.zeros_like(v) for k, v in kept.items()}, {k: np.zeros_like(v) for k, v in kept.items()}, 0
    for epoch in range(how.epochs):
        rate = how.rate * (0.05 + 0.95 * (1 + np.cos(np.pi * epoch / how.epochs)) / 2)
        for at in np.array_split(rng.permutation(rest), max(1, len(rest) // how.batch)):
            keep = (rng.random((len(at), net.width)) >= how.dropout) / (1 - how.dropout)
            _, g = net.loss(a[at], b[at], e[at], label[at], how.contrast, how.heat, keep)
            t += 1
            for k, x in net.weights.items():
                d = g[k] + how.decay * x
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.999 * m2[k] + 0.001 * d * d
                x -= rate * m1[k] / (1 - 0.9**t) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
        mine = held if len(held) > 1 and 0 < label[held].sum() < len(held) else rest
        area = _area(net.chances(net.ends(a[mine])[1], net.ends(b[mine])[1], e[mine]), label[mine])
        if area > best + 1e-5:
            best, kept, waited = area, {k: v.copy() for k, v in net.weights.items()}, 0
        else:
            waited += 1
            if waited >= how.patience:
                break
    net.weights = kept
    return net


def _vectors(asked: DataFrame, before: DataFrame, scale: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``asked`` with ``e``, the logs of its link features and the history of the pair and its reverse before the cut; standardised by ``scale`` (by default that of
    ``asked``), which is returned, too."""
    names = [*graph.LINK_FEATURES, *graph.HISTORY]

    @E.tidy
    def described() -> DataFrame:
        named = graph.pair_history(before.withColumnsRenamed({"u": "debit_inn", "v": "credit_inn"})).withColumnsRenamed({"debit_inn": "u", "credit_inn": "v"})
        out = link_features(asked, before).withColumns({n: F.log1p(n) for n in ("common", "adamic_adar", "resource_allocation")})
        return out.join(named, PAIR_KEY, "left").na.fill(0.0, list(graph.HISTORY))

    out = described()
    scale = scale or E.cut(out.agg(*(F.avg(n).alias(f"m_{n}") for n in names), *(F.stddev_pop(n).alias(f"s_{n}") for n in names)))
    z = [F.coalesce((F.col(n) - F.col(f"m_{n}")) / F.nullif(f"s_{n}", F.lit(0.0)), F.lit(0.0)) for n in names]
    return out.crossJoin(F.broadcast(scale)).select(*asked.columns, F.array(*z).alias("e")), scale  # one row


def _with_ends(pairs: DataFrame, nodes: DataFrame, column: str, none: Column) -> DataFrame:
    for end, name in (("u", "a"), ("v", "b")):
        pairs = pairs.join(nodes.select(F.col("inn").alias(end), F.col(column).alias(name)), end, "left").withColumn(name, F.coalesce(name, none))
    return pairs


@dataclass
class LinkModel:
    """A trained network, the parties' messages, the scale of the pairs' features, and what they come from."""

    net: LinkNet | None
    x: DataFrame
    scale: DataFrame | None
    given: Protocol
    width: int


def fit_links(df: DataFrame, cuts: tuple[float, float] = (0.7, 0.85), how: Training | None = None) -> LinkModel:
    """Learn from the links between both cuts.  ``df``: prepared rows with the columns of ``features.base``."""
    how = how or Training()
    given = protocol(df, cuts, how.seed)
    nodes, names = standard_nodes(given.before)
    arcs = E.cut(graph._arcs(graph.edges(given.before.withColumnsRenamed({"u": "debit_inn", "v": "credit_inn"}))))
    full = messages(nodes, names, arcs, how.steps)
    fewer = arcs.where(F.pmod(F.xxhash64(F.least("u", "v"), F.greatest("u", "v"), F.lit(how.seed)), F.lit(1000)) >= int(1000 * how.drop_edges))
    dropped = messages(nodes, names, fewer, how.steps)
    width = len(names) * (how.steps + 1)
    some = given.asked.where("part = 'valid'").orderBy(F.xxhash64("u", "v", "label", F.lit(how.seed)), "u", "v").limit(how.sample)  # so many rows at most reach the driver
    asked, scale = _vectors(E.cut(some), given.before)
    got = _with_ends(asked, dropped, "x", F.array_repeat(F.lit(0.0), width)).orderBy("u", "v", "label").toArrow()
    label = got.column("label").to_numpy()
    if not 0 < label.sum() < len(label):
        return LinkModel(None, full, scale, given, width)
    a, b, e = (np.array(got.column(k).to_pylist(), np.float64).reshape(len(label), -1) for k in "abe")
    return LinkModel(train(a, b, e, label, how), full, scale, given, width)


def score_links(model: LinkModel, asked: DataFrame) -> DataFrame:
    """``asked`` (u, v and more) with ``chance``, that of a link."""
    if model.net is None:
        return asked.withColumn("chance", F.lit(0.5))
    net, size = asked.sparkSession.sparkContext.broadcast(model.net), model.net.size

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            z = net.value.ends(x)[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, size), pa.int32()), pa.array(z.ravel()))], ["inn", "z"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, e = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for k in "abe")
            kept = [n for n in batch.schema.names if n not in "abe"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(net.value.chances(a, b, e))], [*kept, "chance"])

    z = E.cut(model.x.select("inn", "x").mapInArrow(encode, "inn string, z array<double>"))
    nobody = F.array(*(F.lit(float(v)) for v in model.net.ends(np.zeros((1, model.width)))[1][0]))
    ready = _with_ends(_vectors(asked, model.given.before, model.scale)[0], z, "z", nobody)
    fields = ", ".join(f"`{n}` {t}" for n, t in ready.dtypes if n not in "abe")
    return ready.mapInArrow(decode, f"{fields}, chance double")


def link_risk(df: DataFrame, cuts: tuple[float, float] = (0.7, 0.85), how: Training | None = None) -> DataFrame:
    """``u``, ``v`` and ``edge_risk`` (1 - p) of every directed pair that ever transfers."""
    model = fit_links(df, cuts, how)
    return score_links(model, model.given.pairs).select("u", "v", (1 - F.col("chance")).alias("edge_risk"))


def held_out_quality(df: DataFrame, cuts: tuple[float, float] = (0.7, 0.85), how: Training | None = None) -> DataFrame:
    """``ranking_quality`` on the links after the second cut, which training never sees."""
    model = fit_links(df, cuts, how)
    return ranking_quality(score_links(model, E.cut(model.given.asked.where("part = 'test'"))), "chance")
