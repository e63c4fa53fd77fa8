"""The graph of parties: an edge for each unordered pair that transfers money, scored by how few partners it shares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.functions import exprs as E


def edges(df: DataFrame) -> DataFrame:
    """Unordered pairs u < v: number of transfers and their total.  Null parties and self-loops make none."""
    known = df.where("debit_inn is not null and credit_inn is not null and debit_inn <> credit_inn")
    return known.groupBy(F.least("debit_inn", "credit_inn").alias("u"), F.greatest("debit_inn", "credit_inn").alias("v")).agg(F.count(F.lit(1)).alias("txn_count"), F.sum("amount").alias("total_amount"))


def _arcs(pairs: DataFrame) -> DataFrame:
    return pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))


def node_ids(df: DataFrame) -> DataFrame:
    """Each party and its number from 0, in the order of their names; the library itself works with the names."""
    both = df.select(F.col("debit_inn").alias("inn")).union(df.select(F.col("credit_inn").alias("inn"))).where("inn is not null")
    return E.running_counts(both.distinct().withColumn("n", F.lit(1).cast("long")), "inn", "n").select("inn", F.col("below").alias("id"))


def _loops(df: DataFrame) -> DataFrame:
    return df.where("debit_inn is not null and debit_inn = credit_inn").select(F.col("debit_inn").alias("n")).distinct()


LISTED = 1000  # neighbours in a list, about
ROOM = 1 << 21  # neighbours that a task looks up in, about


def _numbered(pairs: DataFrame) -> DataFrame:
    """Each node ``n`` with its degree ``deg`` and a number ``id`` from 0, in the order of degrees."""
    degree = _arcs(pairs).groupBy("u").agg(F.count(F.lit(1)).alias("deg"))
    placed = E.running_counts(degree.select(F.struct("deg", "u").alias("at"), F.lit(1).cast("long").alias("n")), "at", "n")
    return E.cut(placed.select(F.col("at.u").alias("n"), F.col("at.deg").alias("deg"), F.col("below").cast("int").alias("id")))


def common_neighbours(asked: DataFrame, pairs: DataFrame, weighed: bool = True) -> DataFrame:
    """``asked`` (u, v and more) with ``deg_u``, ``deg_v`` in the graph of ``pairs``, ``common`` (nodes next to both ends), and
    the Adamic-Adar and resource-allocation sums over these.

    Nodes are numbers, in the order of their degrees.  The neighbours of the end with the lower number are looked up at the other end: nodes are dealt to parts of about ``ROOM`` neighbours
    each, and a list of neighbours goes once to each part that holds one of the nodes it is asked about, with these, instead of once to each of them.  Lists are of about ``LISTED`` at
    most, so a hub has many.  ``weighed=False`` leaves the two sums out.
    """
    numbered = _numbered(pairs)
    ends = lambda df: E.with_lookup(E.with_lookup(df, numbered.select(F.col("n").alias("u"), F.col("deg").alias("deg_u"), F.col("id").alias("_u")), "u"), numbered.select(F.col("n").alias("v"), F.col("deg").alias("deg_v"), F.col("id").alias("_v")), "v")
    known = ends(asked).na.fill(0, ["deg_u", "deg_v"])
    known = E.cut(known.select(*asked.columns, "deg_u", "deg_v", F.least("_u", "_v").alias("_low"), F.greatest("_u", "_v").alias("_high"), (F.isnotnull("_u") & F.isnotnull("_v")).alias("_met")))
    of_degree = sorted(map(tuple, numbered.groupBy("deg").agg(F.min("id").alias("id")).select("id", "deg").collect()))  # a row for each degree: at most sqrt(2 m) of m pairs
    if not of_degree:
        out = known.drop("_low", "_high", "_met").withColumn("common", F.lit(0).cast("long"))
        return out.withColumns({"adamic_adar": F.lit(0.0), "resource_allocation": F.lit(0.0)}) if weighed else out
    starts, degrees = (np.array(c) for c in zip(*of_degree, strict=True))
    one_way = E.cut(ends(pairs.select("u", "v")).select(F.col("_u").alias("u"), F.col("_v").alias("v")))
    blocks = -(-int(degrees[-1]) // LISTED)
    lists = E.cut(_arcs(one_way).groupBy(F.col("u").alias("node"), F.pmod(F.xxhash64("v"), F.lit(blocks)).alias("block")).agg(F.collect_list("v").alias("near")))
    parts = max(2 * asked.sparkSession.sparkContext.defaultParallelism, -(-2 * one_way.count() // ROOM))
    part = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(parts)).cast("int")
    by_part = known.where("_met").groupBy(F.col("_low").alias("node"), part("_high").alias("part"), F.pmod(F.shiftright(F.xxhash64("_high"), 32), F.lit(blocks)).alias("_chunk"))
    told = by_part.agg(F.collect_list("_high").alias("of")).drop("_chunk").join(lists.drop("block").hint("shuffle_hash"), "node")
    held = lists.select("node", part("node").alias("part"), F.array().cast("array<int>").alias("of"), "near", F.lit(0).alias("kind"))
    dealt = held.unionByName(told.withColumn("kind", F.lit(1))).repartition(parts, "part").sortWithinPartitions("part", "kind")

    found = _look_up(dealt, starts, degrees)
    sums = ("common", "adamic_adar", "resource_allocation") if weighed else ("common",)
    found = found.groupBy("_low", "_high").agg(*(F.sum(c).alias(c) for c in sums))  # a hub's lists are met one by one
    out = known.join(found.hint("shuffle_hash"), ["_low", "_high"], "left").drop("_low", "_high", "_met").na.fill(0, ["common"])
    return out.na.fill(0.0, ["adamic_adar", "resource_allocation"]) if weighed else out


def _look_up(dealt: DataFrame, starts: np.ndarray, degrees: np.ndarray) -> DataFrame:
    """What pairs have in common.  A part has the lists of its nodes (kind 0) before those that are looked up in them (kind 1, with the nodes ``of`` the part they are asked about)."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, gathered, place = None, [], None
        for batch in batches:
            kinds, owners = batch.column("kind").to_numpy(), batch.column("part").to_numpy()
            for rows in np.split(np.arange(batch.num_rows), np.flatnonzero((np.diff(kinds) != 0) | (np.diff(owners) != 0)) + 1):
                if not len(rows):
                    continue
                some = batch.slice(rows[0], len(rows))
                if owners[rows[0]] != at:
                    at, gathered, place = owners[rows[0]], [], None
                if kinds[rows[0]] == 0:
                    gathered.append(_keys(some))
                    continue
                if place is None:
                    place = np.sort(np.concatenate(gathered)) if gathered else np.zeros(0, np.int64)
                    gathered = []
                yield from _met(some, place, starts, degrees)

    return dealt.mapInArrow(look_up, "_low int, _high int, common long, adamic_adar double, resource_allocation double")

def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """A number for each node and neighbour of it."""
    near = batch.column("near")
    return (np.repeat(batch.column("node").to_numpy().astype(np.int64), np.diff(near.offsets.to_numpy())) << 32) | near.flatten().to_numpy()


def _met(batch: pa.RecordBatch, place: np.ndarray, starts: np.ndarray, degrees: np.ndarray, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """For each row's node and each of the nodes ``of`` it is asked about, what of the list ``near`` is in ``place`` (``_keys``) there; about ``most`` look-ups at a time."""
    of, near = batch.column("of"), batch.column("near")
    n_of, n_near = np.diff(of.offsets.to_numpy()), np.diff(near.offsets.to_numpy())
    asked, values = of.flatten().to_numpy().astype(np.int64), near.flatten().to_numpy()
    row = np.repeat(np.arange(batch.num_rows), n_of)  # of each pair
    first, size = (np.cumsum(n_near) - n_near)[row], n_near[row]
    node = batch.column("node").to_numpy()[row]
    for pairs in np.split(np.arange(len(row)), np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1):
        if not len(pairs) or not len(place):
            continue
        own = size[pairs]
        pair = np.repeat(np.arange(len(pairs)), own)
        w = values[np.repeat(first[pairs] - (np.cumsum(own) - own), own) + np.arange(len(pair))]
        key = (asked[pairs][pair] << 32) | w
        hit = place[np.minimum(np.searchsorted(place, key), len(place) - 1)] == key
        pair, deg = pair[hit], degrees[np.searchsorted(starts, w[hit], "right") - 1]
        common = np.bincount(pair, minlength=len(pairs))
        rare = np.where(deg > 1, 1 / np.log(np.maximum(deg, 2)), 0.0)
        sums = [np.bincount(pair, x, len(pairs)) for x in (rare, 1 / deg)]
        some = common > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[some], kind) for x, kind in ((node[pairs], pa.int32()), (asked[pairs], pa.int32()), (common, pa.int64()), (sums[0], pa.float64()), (sums[1], pa.float64()))], ["_low", "_high", "common", "adamic_adar", "resource_allocation"])


def _shared(seen: DataFrame, degree: DataFrame) -> DataFrame:
    """What each pair u, v has in common, from a row for each pair and node ``w`` next to both."""
    return E.with_lookup(seen, degree.withColumnRenamed("u", "w"), "w", "inner").groupBy("u", "v").agg(
        F.count(F.lit(1)).alias("common"), F.sum(F.when(F.col("deg") > 1, 1 / F.log("deg"))).alias("adamic_adar"), F.sum(1 / F.col("deg")).alias("resource_allocation")
    )


@E.tidy
def neighbourhoods(df: DataFrame) -> DataFrame:
    """The edges with their ends' degrees and what both have in common (as ``common_neighbours``), computed once: both scores and the link features lean on it.

    Each edge points from the end with the lower degree to the other, so a node has at most ``sqrt(2 m)`` edges that leave it, which are one list.  A triangle is then met once, as
    what the lists of an edge's ends share, and told to its three edges."""
    pairs = E.cut(edges(df))
    degree = E.cut(_arcs(pairs).groupBy("u").agg(F.count(F.lit(1)).alias("deg")))
    known = E.cut(E.with_lookup(E.with_lookup(pairs, degree.withColumnRenamed("deg", "deg_u"), "u", "inner"), degree.select(F.col("u").alias("v"), F.col("deg").alias("deg_v")), "v", "inner"))
    up = F.struct("deg_u", "u") < F.struct("deg_v", "v")
    place = F.when(up, F.struct(F.col("deg_v").alias("deg"), F.col("v").alias("n"))).otherwise(F.struct(F.col("deg_u").alias("deg"), F.col("u").alias("n")))
    outs = known.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("a"), place.alias("b")).groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("_out"))
    outs = E.cut(outs.select("a", F.col("_out.n").alias("out")))  # in the order that edges point along
    later = outs.select("a", F.posexplode("out").alias("_i", "b"), "out").select("a", "b", F.expr("slice(out, _i + 2, size(out))").alias("later")).where("size(later) > 0")
    # never broadcast: lists in a compressed file are many times as large in the driver's memory, and Spark goes by the file
    met = later.join(outs.select(F.col("a").alias("b"), "out").hint("shuffle_hash"), "b").select("a", "b", F.array_intersect("later", "out").alias("c")).where(F.size("c") > 0)
    seen = lambda x, y, w: F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"), w.alias("w"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    told = met.select("a", "b", F.explode("c").alias("c")).select(F.explode(F.array(seen(a, b, c), seen(a, c, b), seen(b, c, a))).alias("t")).select("t.*")
    shared = _shared(told, degree)
    return known.join(shared, ["u", "v"], "left").na.fill(0, ["common"]).na.fill(0.0, ["adamic_adar", "resource_allocation"])


def edge_scores(df: DataFrame, got: DataFrame | None = None) -> DataFrame:
    """Jaccard of the ends' other neighbours, rarity, and their blend scaled to 0..1.  A self-loop makes a node its own neighbour.
    ``got``: ``neighbourhoods(df)``, if it is there already."""
    got = got if got is not None else neighbourhoods(df)
    loops = _loops(df)
    got = got.join(loops.select(F.col("n").alias("u"), F.lit(1).alias("loop_u")), "u", "left").join(loops.select(F.col("n").alias("v"), F.lit(1).alias("loop_v")), "v", "left")
    # each end leaves the other out; a looped end stays in its own set only
    shared = F.col("common")
    union = (F.col("deg_u") - 1 + F.coalesce("loop_u", F.lit(0))) + (F.col("deg_v") - 1 + F.coalesce("loop_v", F.lit(0))) - shared
    raw = got.withColumn("jaccard", shared / (union + F.lit(1e-6))).withColumn("rarity", 1.0 / (F.col("txn_count") + 1))
    raw = raw.withColumn("raw_score", 0.6 * (1 - F.col("jaccard")) + 0.4 * F.col("rarity"))
    return E.minmax_all(raw, "raw_score", "graph_edge_score", "c").select("u", "v", "txn_count", "total_amount", "jaccard", "rarity", "raw_score", "graph_edge_score")


def node_scores(df: DataFrame, got: DataFrame | None = None) -> DataFrame:
    """Degree (a self-loop adds 2), local clustering, and their blend scaled to 0..1.  ``got``: ``neighbourhoods(df)``."""
    got = got if got is not None else neighbourhoods(df)
    half = got.select(F.explode(F.array("u", "v")).alias("inn"), F.col("common").alias("n"))
    per = half.groupBy("inn").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("links"))
    loops = _loops(df).select(F.col("n").alias("inn"), F.lit(2).alias("loop"))
    per = per.join(loops, "inn", "full_outer").select("inn", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("loop", F.lit(0)).alias("loop"))
    per = per.withColumn("degree", (F.col("k") + F.col("loop")).cast("long"))
    per = per.withColumn("clustering", F.when(F.col("k") > 1, F.col("links") / (F.col("k") * (F.col("k") - 1))).otherwise(0.0))
    per = per.withColumn("raw_score", 0.5 * (1 - F.col("clustering")) + 0.5 / (F.col("degree") + 1))
    return E.minmax_all(E.cut(per), "raw_score", "graph_node_score", "c").select("inn", "degree", "clustering", "raw_score", "graph_node_score")


def enrich(df: DataFrame, edge: DataFrame, node: DataFrame, canonical: bool = True) -> DataFrame:
    """``df`` with the edge's score and the higher of both ends' node scores.  ``canonical`` finds a pair in either direction; otherwise
    only rows whose payer is the pair's first party find it."""
    key = (F.least("debit_inn", "credit_inn"), F.greatest("debit_inn", "credit_inn")) if canonical else (F.col("debit_inn"), F.col("credit_inn"))
    df = df.withColumns({"_u": key[0], "_v": key[1]})
    df = df.join(edge.select(F.col("u").alias("_u"), F.col("v").alias("_v"), "graph_edge_score"), ["_u", "_v"], "left").drop("_u", "_v")
    for role in ("debit", "credit"):
        df = df.join(node.select(F.col("inn").alias(f"{role}_inn"), F.col("graph_node_score").alias(f"_{role}_node")), f"{role}_inn", "left")
    return df.withColumn("graph_node_score", F.greatest("_debit_node", "_credit_node")).drop("_debit_node", "_credit_node")


LINK_FEATURES = ("common", "jaccard", "adamic_adar", "resource_allocation", "preferential")


def structural_links(df: DataFrame, got: DataFrame | None = None, standard: bool = False) -> DataFrame:
    """Link features of each pair: common neighbours, Jaccard, Adamic-Adar, resource allocation, log of the degrees' product; with
    ``standard`` each standardised over all pairs."""
    common = F.col("common")
    out = (got if got is not None else neighbourhoods(df)).select(
        "u", "v", common.alias("common"), (common / (F.col("deg_u") + F.col("deg_v") - common)).alias("jaccard"), "adamic_adar", "resource_allocation",
        F.log1p(F.col("deg_u").cast("double") * F.col("deg_v")).alias("preferential"),
    )
    return E.zscores(E.cut(out), list(LINK_FEATURES)) if standard else out


def pair_aggregates(df: DataFrame) -> DataFrame:
    """Directed pairs: amounts, frequency, roundness, text and recency (mean days between transfers of the pair)."""
    w = Window.partitionBy("debit_inn", "credit_inn").orderBy("date", "txn_id")
    gap = df.withColumn("_gap", F.date_diff("date", F.lag("date").over(w)))
    return gap.where("debit_inn is not null and credit_inn is not null").groupBy("debit_inn", "credit_inn").agg(
        F.avg("log_amount").alias("mean_log"), F.max("log_amount").alias("max_log"), F.count(F.lit(1)).alias("freq"), F.avg("is_round_10k").alias("round_share"),
        F.avg("purpose_len").alias("mean_len"), F.avg(F.coalesce("_gap", F.lit(9999))).alias("mean_gap"),
    )


PAIR_FEATURES = ("mean_log", "max_log", "freq", "round_share", "mean_len", "mean_gap")
HISTORY = ("mean_log", "max_log", "log_freq", "round_share", "round_100k_share", "mean_len", "digits_share", "mean_gap")


def pair_history(df: DataFrame) -> DataFrame:
    """The eight features of a directed pair: mean and highest log of the amounts, log of 1 + the number of transfers, shares of round amounts (10,000 and 100,000),
    mean length and share of digits of the purposes, mean days since the pair's transfer before (9999 for the first)."""
    w = Window.partitionBy("debit_inn", "credit_inn").orderBy("date")  # transfers of a day are none apart, in whatever order
    gap = df.withColumns({"_gap": F.date_diff("date", F.lag("date").over(w)), "_log": F.log1p(F.abs("amount"))})
    return gap.where("debit_inn is not null and credit_inn is not null").groupBy("debit_inn", "credit_inn").agg(
        F.avg("_log").alias("mean_log"), F.max("_log").alias("max_log"), F.log1p(F.count(F.lit(1))).alias("log_freq"), F.avg("is_round_10k").alias("round_share"),
        F.avg("is_round_100k").alias("round_100k_share"), F.avg("purpose_len").cast("double").alias("mean_len"), F.avg("purpose_digits_ratio").alias("digits_share"), F.avg(F.coalesce("_gap", F.lit(9999))).alias("mean_gap"),
    )


def edge_features(asked: DataFrame, df: DataFrame) -> DataFrame:
    """``asked`` (u, v) with ``HISTORY``, zeros where it has no transfers, each standardised over ``asked``."""
    known = pair_history(df).withColumnsRenamed({"debit_inn": "u", "credit_inn": "v"})
    joined = asked.join(known, ["u", "v"], "left").na.fill(0.0, list(HISTORY))
    return E.zscores(E.cut(joined), list(HISTORY))


def node_features(df: DataFrame, names: list[str]) -> DataFrame:
    """Median and mean of numeric columns of every node in each role; 0 where it has no rows in it."""
    parts = []
    for role in ("debit", "credit"):
        aggs = [f(n).alias(f"{role}_{n}_{k}") for n in names for k, f in (("median", lambda c: F.percentile(c, F.lit(0.5))), ("mean", F.avg))]
        parts.append(df.where(F.col(f"{role}_inn").isNotNull()).groupBy(F.col(f"{role}_inn").alias("inn")).agg(*aggs))
    return parts[0].join(parts[1], "inn", "full_outer").na.fill(0.0)


def temporal_split(df: DataFrame, cuts: tuple[float, float] = (0.7, 0.85)) -> DataFrame:
    """Each row's part by date: train up to the first quantile of all dates, valid up to the second, then test."""
    df = E.with_scalars(df, _q=F.percentile(F.unix_date("date"), F.array(*(F.lit(c) for c in cuts))))
    day = F.unix_date("date")
    return df.withColumn("part", F.when(day <= F.col("_q")[0], "train").when(day <= F.col("_q")[1], "valid").otherwise("test")).drop("_q")


def _lowest(df: DataFrame, n: int, seed: int) -> DataFrame:
    """The ``n`` pairs u, v with the lowest hashes.  Counts of 65,536 ranges of hashes give the range to cut in; only its rows are sorted."""
    df = df.withColumn("_h", F.xxhash64("u", "v", F.lit(seed))).withColumn("_k", F.shiftrightunsigned("_h", 48).cast("int"))
    below, cut, some = 0, None, 0
    for k, c in sorted(map(tuple, df.groupBy("_k").count().collect())):
        if below + c > n:
            cut, some = k, n - below
            break
        below += c
    if cut is None:
        return df.drop("_h", "_k")
    at = df.where(F.col("_k") == cut).withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy("_h", "u", "v"))).where(F.col("_r") <= some)
    return df.where(F.col("_k") < cut).unionByName(at.drop("_r")).drop("_h", "_k")


def _drawn(ends: DataFrame, rows: int, seed: int) -> DataFrame:
    """Pairs u < v of ``ends`` (n and its number i, told apart by key): two shuffles by hash, paired by row number within ranges of about 100,000."""
    parts = max(1, rows // 100_000)

    def side(name: str, salt: int) -> DataFrame:
        h = ends.select(F.col("n").alias(name), "key", "i", F.xxhash64("n", "key", "i", F.lit(salt)).alias("h")).withColumn("s", F.pmod("h", F.lit(parts)))
        return h.select("s", name, F.row_number().over(Window.partitionBy("s").orderBy("h", name, "key", "i")).alias("r"))

    both = side("a", seed).join(side("b", seed + 1), ["s", "r"]).where("a <> b")
    return both.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def negative_pairs(df: DataFrame, per_edge: int = 1, seed: int = 42) -> DataFrame:
    """Random pairs of nodes that have no edge, ``per_edge`` for each edge, or all that there are if these are fewer.

    Ends of shuffled edges are paired, so nodes come about as often as they have edges.  What falls on edges, itself or pairs drawn before
    is drawn again; if that gives little (dense cores), all nodes alike.  If at least half of all non-links are wanted, they are listed.
    """
    pairs = E.cut(edges(df).select("u", "v"))  # each round reads it again
    m = pairs.count()
    nodes = E.cut(_arcs(pairs).select(F.col("u").alias("n")).distinct())
    n = nodes.count()
    free = n * (n - 1) // 2 - m
    want = min(per_edge * m, free)
    if 2 * want >= free:
        listed = nodes.select(F.col("n").alias("u")).join(nodes.select(F.col("n").alias("v")), F.col("u") < F.col("v"))  # few: at most 2 per_edge + 1 for each edge
        return _lowest(E.cut(listed.join(pairs, ["u", "v"], "left_anti")), want, seed)
    out, have, by_degree, turn = None, 0, True, 0
    while have < want:
        missing = want - have
        if by_degree:
            rows = 2 * m * per_edge
            ends = _arcs(pairs).select(F.col("u").alias("n"), F.col("v").alias("key"), F.explode(F.sequence(F.lit(1), F.lit(per_edge))).alias("i"))
        else:
            each = -(-2 * missing // n)
            rows = n * each
            ends = nodes.select("n", F.lit("").alias("key"), F.explode(F.sequence(F.lit(1), F.lit(each))).alias("i"))
        fresh = _drawn(ends, rows, seed + 2 * turn).join(pairs, ["u", "v"], "left_anti")
        fresh = E.cut(fresh if out is None else fresh.join(out, ["u", "v"], "left_anti"))
        got = fresh.count()
        fresh = fresh if got <= missing else _lowest(fresh, missing, seed)
        out = fresh if out is None else out.unionByName(fresh)
        have += min(got, missing)
        by_degree, turn = by_degree and 2 * got >= missing, turn + 1
    return pairs.limit(0) if out is None else out


def link_model(df: DataFrame, seed: int = 42) -> DataFrame:
    """Risk of each pair as 1 - p(link): logistic regression on structural features against sampled non-links.  A
    substitute for a graph network, which needs libraries that are not here."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    @E.tidy
    def described() -> DataFrame:
        pairs = E.cut(edges(df).select("u", "v"))
        asked = pairs.withColumn("label", F.lit(1.0)).unionByName(negative_pairs(df, seed=seed).withColumn("label", F.lit(0.0)))
        ends = common_neighbours(asked, pairs, weighed=False)
        common, du, dv = F.col("common"), F.col("deg_u") - F.col("label"), F.col("deg_v") - F.col("label")  # without the pair itself
        return ends.select("u", "v", "label", common.cast("double").alias("common"), (common / F.greatest(du + dv - common, F.lit(1.0))).alias("jaccard"), F.log1p(F.greatest(du, F.lit(0.0)) * F.greatest(dv, F.lit(0.0))).alias("preferential"))

    ready = described()  # the fit reads it again and again
    ready = VectorAssembler(inputCols=["common", "jaccard", "preferential"], outputCol="x", handleInvalid="skip").transform(ready)
    model = LogisticRegression(featuresCol="x", maxIter=30, regParam=0.01).fit(ready)
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(ready.where("label = 1")).withColumn("edge_risk", 1 - vector_to_array("probability")[1])
    return scored.select("u", "v", "edge_risk")


def node_risk(edge_risk: DataFrame) -> DataFrame:
    """Mean risk of the edges at each node."""
    both = edge_risk.select(F.col("u").alias("inn"), "edge_risk").unionByName(edge_risk.select(F.col("v").alias("inn"), "edge_risk"))
    return both.groupBy("inn").agg(F.avg("edge_risk").alias("node_risk"))
