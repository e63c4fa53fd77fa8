"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern: the set of sources that hold them.  Each source asks for its
target, and the cheapest flow routes the patterns' words to these quotas.  Repeating words has convex costs: a pattern's
words are free once, then each doubling of their use costs one more a word.  Within a pattern, seeded documents then carry
what is routed.  Rows of the same document in several sources are rows of one pattern; with ``source`` a row serves only the
quota of its own source, ``max_repeat`` times at most, and what the sources of a pattern take together is what has the costs, so a
source rather repeats documents that the others don't have.

The flow is a maximum flow for each level of the cost in turn, on sums by pattern in the driver.  More than ``max_patterns`` patterns are dealt by
hash to batches of about so many, so the driver holds one batch at a time: each gets the part of every quota that its share of the source's words is, along with what earlier
ones left open.  All patterns keep all their sources and quotas are met as with one batch; the flow is the cheapest for each batch, over all of them nearly so.

Documents with null or empty text have size 0 and are never taken.  A null source is a source of its
own, the last one.  Repeated rows are separate documents; rows with equal ids are taken together, all rows without an id, too.  An empty table
gives an empty result.  Columns of the input pass through, whatever their names; only ``_copies`` is replaced.
"""

from __future__ import annotations

import uuid
from collections import Counter, deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import materialize, shared_dir

SEED = 7
MAX_PATTERNS = 100_000
BROADCAST_BYTES = 32 << 20
SALTS = 16


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: list[float], share: float, max_repeat: float) -> dict[str | None, float]:
    """``share`` of all words dealt by weight; no target above ``max_repeat`` times its source, and what is
    above is dealt again to the others by weight until none is.  Weights go round the sources in
    code point order, null last."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, list(order), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > max_repeat * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = float(max_repeat * sizes[s])
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in over]
    return out


class _Network:
    """Maximum flow (Dinic) whose capacities may grow between runs."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def push(self, start: int, end: int) -> None:
        while True:
            level = [-1] * len(self.out)
            level[start] = 0
            queue = deque([start])
            while queue:
                a = queue.popleft()
                for e in self.out[a]:
                    if self.room[e] and level[self.to[e]] < 0:
                        level[self.to[e]] = level[a] + 1
                        queue.append(self.to[e])
            if level[end] < 0:
                return
            at = [0] * len(self.out)
            path: list[int] = []
            node = start
            while True:
                if node == end:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    path, node = [], start
                    continue
                while at[node] < len(self.out[node]):
                    e = self.out[node][at[node]]
                    if self.room[e] and level[self.to[e]] == level[node] + 1:
                        break
                    at[node] += 1
                else:
                    if not path:
                        break
                    level[node] = -1
                    node = self.to[path.pop() ^ 1]
                    continue
                path.append(e)
                node = self.to[e]


def min_cost_flow(words: dict, limits: dict, quotas: dict, totals: dict | None = None) -> dict:
    """Words routed from patterns to sources: {(pattern, source): words}.

    ``words``: a pattern's words, each counted once; ``limits``: the most that each (pattern, source) may give; ``totals``: the most
    that a pattern may give in all (the sum of its limits by default).  Using a pattern's words up to once is free, each further doubling costs one more a word.
    Costs only stand at the patterns, so a maximum flow at each level of the cost, on top of the last one, is a cheapest flow.
    """
    patterns, sources = list(words), list(quotas)
    place = {p: i for i, p in enumerate(patterns)}
    goal = {s: len(patterns) + i for i, s in enumerate(sources)}
    start, end = len(patterns) + len(sources), len(patterns) + len(sources) + 1
    net = _Network(end + 1)
    supply = {p: net.arc(start, place[p], 0) for p in patterns}
    arcs = {(p, s): net.arc(place[p], goal[s], room) for (p, s), room in limits.items() if s in goal}
    for s in sources:
        net.arc(goal[s], end, quotas[s])
    most = dict.fromkeys(patterns, 0)
    for (p, _), room in limits.items():
        most[p] += room
    most = {p: min(most[p], totals[p]) if totals else most[p] for p in patterns}
    given, level = dict.fromkeys(patterns, 0), 1
    while any(given[p] < most[p] for p in patterns if words[p]):
        for p in patterns:
            now = min(most[p], words[p] * level)
            net.room[supply[p]] += now - given[p]
            given[p] = now
        net.push(start, end)
        level *= 2
    return {key: net.room[e ^ 1] for key, e in arcs.items() if net.room[e ^ 1]}


def shared_by(docs: DataFrame, text_key: str, source: str) -> DataFrame:
    """``docs`` with ``sources``: all sources that hold a row with the same ``text_key``.  Only keys of several sources are joined, and
    each of them is there SALTS times, so a text that very many rows have is dealt to several tasks."""
    name = F.coalesce(F.concat(F.lit("s"), source), F.lit("~"))
    several = docs.groupBy(F.col(text_key).alias("_k")).agg(F.collect_set(name).alias("_all")).where(F.size("_all") > 1)
    several = several.select("_k", "_all", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)), F.lit(SALTS)).cast("int")
    joined = docs.withColumn("_salt", salt).join(several.withColumnRenamed("_salt", "_salt2"), (F.col(text_key) == F.col("_k")) & (F.col("_salt") == F.col("_salt2")), "left")
    back = F.transform("_all", lambda x: F.when(x != "~", F.substring(x, 2, F.length(x))))
    return joined.withColumn("sources", F.coalesce(back, F.array(source))).drop("_k", "_all", "_salt", "_salt2")


def whole_repetitions(routed: dict, cells: dict, max_repeat: int) -> dict:
    """``routed`` with whole repetitions for all cells of a source but the largest, which takes what that leaves or adds: a few
    documents seldom add up to a given number of words, many do."""
    out, largest = dict(routed), {}
    for cell in sorted(cells, key=lambda c: (cells[c], c)):
        largest[cell[1]] = cell
    for cell in sorted(cells, key=lambda c: (-cells[c], c)):
        main, words = largest[cell[1]], cells[cell]
        if cell != main and words:
            rest = out[cell] % words
            rest = rest - words if 2 * rest > words else rest
            if 0 <= out[main] + rest <= max_repeat * cells[main]:
                out[cell] -= rest
                out[main] += rest
    return out


def whole_cells(routed: dict, cells: dict, max_repeat: int) -> dict:
    """``routed`` with whole repetitions for all cells: what a cell leaves or adds goes on to the source's next smaller one."""
    out, over = {}, Counter()
    for cell in sorted(cells, key=lambda c: (-cells[c], c)):
        words, wish = cells[cell], routed[cell] + over[cell[1]]
        out[cell] = min(max_repeat, max(0, (2 * wish + words) // (2 * words))) * words if words else 0
        over[cell[1]] = wish - out[cell]
    return out


def mix(
    docs: DataFrame,
    *,
    size: str,
    sources: str,
    doc_id: str,
    weights: list[float],
    share: float,
    max_repeat: int = 2,
    seed: int = SEED,
    source: str | None = None,
    text_key: str | None = None,
    max_patterns: int = MAX_PATTERNS,
) -> tuple[DataFrame, dict]:
    """``docs`` (``size`` long, ``sources`` array of names, nulls allowed) with ``_copies``, the times that the mix
    takes each document; and the targets by source.

    ``source``: the column with the row's own source; without it a row serves any of its sources.  ``text_key``: what rows of the
    same document have in common (without it each row is a document of its own).

    What a pattern gives a source in whole repetitions takes all its documents; of the rest, the documents with a seeded hash up to the
    limit are taken.  Sums by slice of the hash find the slice in which the words run out, and only the
    documents of this slice are ranked.  The document whose size is next to what is then still missing is
    taken, too, if that comes nearer.  So ``docs`` itself is neither shuffled nor sorted; it is read once more
    with a few numbers for each pattern.
    """
    key = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("~"))
    pattern = F.array_sort(F.array_distinct(F.transform(sources, key)))
    own = key(F.col(source)) if source else F.lit("")
    keyed = docs.select(
        F.struct("*").alias("_row"), F.struct(pattern.alias("of"), own.alias("own")).alias("_cell"), F.col(size).alias("_size"), (F.col(text_key) if text_key else F.lit(None)).alias("_text"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id)), 1).alias("_hash"),
    )
    slim = materialize(keyed.select("_cell", "_hash", F.shiftright("_hash", 51).alias("_slice"), "_size", "_text"))
    by_cell = materialize(slim.where(F.col("_cell.of").isNotNull()).groupBy("_cell").agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("words")))
    if source and text_key:  # each text once
        once = slim.groupBy("_cell.of", "_text").agg(F.max("_size").alias("words")).groupBy("of").agg(F.sum("words").alias("words")).where("of is not null")
    else:
        once = by_cell.groupBy("_cell.of").agg(F.sum("words").alias("words"))
    once = materialize(once)
    name = lambda k: None if k == "~" else k[1:]
    by_source = by_cell.withColumn("_s", F.explode(F.array("_cell.own") if source else F.col("_cell.of"))).groupBy("_s")
    by_source = by_source.agg(F.sum("words").alias("n"), F.max_by("_cell.of", F.struct("words", "_cell")).alias("main")).collect()  # a row for each source
    sizes = {name(r["_s"]): int(r["n"]) for r in by_source}
    wanted = targets(sizes, weights, share, max_repeat)
    spark = docs.sparkSession
    plan_df = _plan(by_cell, once, sizes, {s: int(round(t)) for s, t in wanted.items()}, sorted({tuple(r["main"]) for r in by_source}), bool(source), max_repeat, max_patterns, spark)
    plan_bytes = by_cell.agg(F.sum(F.octet_length(F.concat_ws(",", "_cell.of")) + 24 * F.size("_cell.of") + 200)).first()[0] or 0

    def meet(df: DataFrame, plan: DataFrame, how: str = "inner") -> DataFrame:
        """Rows with what is planned for their cell: broadcast when small, else SALTS times, so a cell of very many rows is dealt by their hash."""
        if plan_bytes <= BROADCAST_BYTES:
            return df.join(F.broadcast(plan), "_cell", how)
        salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return df.withColumn("_salt", F.pmod("_hash", F.lit(SALTS)).cast("int")).join(salted, ["_cell", "_salt"], how).drop("_salt")

    # at most 4096 rows a cell in the sums
    sums = slim.groupBy("_cell", "_slice").agg(F.sum("_size").alias("_words"))
    run = Window.partitionBy("_cell").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_words").over(run), F.lit(0)))
    cut = sums.join(plan_df, "_cell").where((F.col("_rest") > 0) & (F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("_words") > F.col("_rest")))
    cut = materialize(cut.groupBy("_cell").agg(F.min(F.struct("_slice", "_before")).alias("_cut")))
    ranked = meet(slim, plan_df.join(cut, "_cell")).where(F.col("_slice") == F.col("_cut._slice"))
    ranked = ranked.groupBy("_cell", "_hash", "_rest", "_cut").agg(F.sum("_size").alias("_size"))
    order = Window.partitionBy("_cell").orderBy("_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranked.withColumn("_upto", F.col("_cut._before") + F.sum("_size").over(order)).where(F.col("_upto") <= F.col("_rest"))
    limit = ranked.groupBy("_cell").agg(F.max("_hash").alias("_last"), F.max("_upto").alias("_upto"))
    # hashes below the cut slice are in; without a cut all that is asked for is whole repetitions
    bounds = plan_df.join(cut, "_cell", "left").join(limit, "_cell", "left").select(
        "_cell", "_whole", "_rest",
        F.coalesce("_last", F.shiftleft(F.col("_cut._slice"), 51) - 1, F.lit(-1)).alias("_last"),
        (F.col("_rest") - F.coalesce("_upto", "_cut._before", F.lit(0))).alias("_gap"),
    )
    bounds = materialize(bounds)
    more = meet(slim, bounds).where((F.col("_hash") > F.col("_last")) & (F.col("_gap") > 0)).groupBy("_cell", "_hash", "_gap").agg(F.sum("_size").alias("_size"))
    more = more.where((F.col("_size") > 0) & (F.abs(F.col("_gap") - F.col("_size")) < F.col("_gap")))
    more = more.groupBy("_cell").agg(F.min_by("_hash", F.struct(F.abs(F.col("_gap") - F.col("_size")), "_hash")).alias("_more"))
    chosen = materialize(bounds.join(more, "_cell", "left"))
    out = meet(keyed, chosen.select("_cell", "_whole", "_last", "_more"), "left")
    extra = (F.col("_hash") <= F.col("_last")) | F.coalesce(F.col("_hash") == F.col("_more"), F.lit(False))
    # a document is never taken more often than max_repeat, the one that fills the gap included
    copies = F.when(F.col("_size") > 0, F.least(F.coalesce(F.col("_whole") + extra.cast("long"), F.lit(0)), F.lit(max_repeat))).otherwise(0)
    return out.select(*(F.col(f"_row.`{c}`") for c in docs.columns if c != "_copies"), copies.cast("long").alias("_copies")), wanted


def _plan(by_cell: DataFrame, once: DataFrame, sizes: dict, quotas: dict, mains: list[tuple], own: bool, max_repeat: int, max_patterns: int, spark) -> DataFrame:
    """``_whole`` repetitions and ``_rest`` words for each cell, batch by batch.  The patterns with the largest cell of a source (``mains``) are in the
    last batch: they take what whole repetitions of the others leave."""
    n = max(1, -(-once.count() // max_patterns))
    schema = "_cell struct<of:array<string>,own:string>, _whole long, _rest long"
    name = lambda k: None if k == "~" else k[1:]
    path = f"{shared_dir(spark).rstrip('/')}/mix-{uuid.uuid4().hex}"
    if n > 1:
        main = spark.createDataFrame([(list(p), True) for p in mains], "of array<string>, _main boolean")

        def dealt(df: DataFrame) -> DataFrame:
            batch = F.when(F.col("_main"), n - 1).otherwise(F.pmod(F.xxhash64("of"), F.lit(n)))
            return materialize(df.join(F.broadcast(main), "of", "left").withColumn("_batch", batch))  # a row for each source at most

        by_cell, once = dealt(by_cell.withColumn("of", F.col("_cell.of"))), dealt(once)
    room, given = Counter(), Counter()
    for k in range(n):
        mine, texts = (df.where(F.col("_batch") == k) if n > 1 else df for df in (by_cell, once))
        cells = dict(sorted(((tuple(r[0]["of"]), r[0]["own"]), int(r[1])) for r in mine.select("_cell", "words").collect()))
        supply = dict(sorted((tuple(r[0]), int(r[1] or 0)) for r in texts.select("of", "words").collect()))
        limits = {(p, name(s)): max_repeat * words for (p, o), words in cells.items() for s in ([o] if own else p)}
        here = {s for _, s in limits}
        for (_, s), words in limits.items():
            room[s] += words
        open_ = {s: max(0, q * room[s] // max(1, max_repeat * sizes[s]) - given[s]) for s, q in quotas.items() if s in here}
        flow = min_cost_flow(supply, limits, open_, None if own else {p: max_repeat * w for p, w in supply.items()})
        routed = {(p, o): flow.get((p, name(o)), 0) if own else sum(flow.get((p, name(s)), 0) for s in p) for p, o in cells}
        if own:
            routed = (whole_cells if k < n - 1 else whole_repetitions)(routed, cells, max_repeat)
            for (_, o), words in routed.items():
                given[name(o)] += words
        else:
            for (_, s), words in flow.items():
                given[s] += words
        rows = spark.createDataFrame([((list(p), o), routed[p, o] // max(1, words), routed[p, o] % max(1, words)) for (p, o), words in cells.items()], schema)
        if n == 1:
            return rows
        rows.write.parquet(f"{path}/batch={k}")
    return spark.read.schema(schema).parquet(path).select("_cell", "_whole", "_rest")
