"""The whole run: features, layers, fusion with history, review of a sample, knowledge base."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.config import Settings
from riskflow.functions import exprs as E
from riskflow.operators import features, fusion, graph, kb, layers, review
from riskflow.sources import ledger


@dataclass
class Result:
    enriched: DataFrame
    reviews: DataFrame
    stats: DataFrame


Keep = Callable[[DataFrame, str], DataFrame]


def semantic(wide: DataFrame, vectors: DataFrame) -> DataFrame:
    """txn_id with the semantic risk and its rank, from the vectors of purposes (txn_id, vector)."""
    known = wide.select("txn_id", "debit_inn", "credit_inn", "purpose_stopword_high").join(vectors, "txn_id")
    local = layers.local_shift(layers.local_shift(known, "vector", "debit_inn", "_ld"), "vector", "credit_inn", "_lc").withColumn("_local", F.greatest("_ld", "_lc"))
    return layers.semantic_risk(layers.global_outlier(local, "vector", "_out"), "_local", "_out", "purpose_stopword_high").select("txn_id", "semantic_risk_score", "semantic_risk_rank")


def with_layers(df: DataFrame, found: list[DataFrame]) -> DataFrame:
    """``df`` with the scores of layers, each a row for a transaction."""
    for extra in found:
        df = df.join(extra, "txn_id", "left")
    return df


def scored(df: DataFrame, s: Settings = Settings(), history: DataFrame | None = None, svd: bool = True, with_semantic: bool = False, keep: Keep = lambda df, _: E.cut(df)) -> DataFrame:
    """A prepared ledger with features, layer scores and overall risk.  ``keep`` holds what several layers read, so that it is
    computed once.  ``svd``: the global layer sees the vectors of purposes, too; ``with_semantic``: the semantic layer has a part in the blend."""
    df = keep(fusion.one_row_each(df), "ledger")
    wide = keep(features.enrich(df, s.features), "features")
    near = graph.neighbourhoods(df)
    vectors = keep(layers.purpose_vectors(wide), "vectors") if svd or with_semantic else None
    found = [
        layers.individual(features.roles(wide), s.forest),
        layers.global_scores(layers.with_vectors(wide, vectors) if svd else wide),
        layers.time_series(wide, canonical=s.canonical),
    ]
    if with_semantic:
        found.append(semantic(wide, vectors))
    wide = graph.enrich(wide, keep(graph.edge_scores(df, near), "edges"), keep(graph.node_scores(df, near), "nodes"), s.canonical)
    wide = keep(with_layers(wide, [keep(extra, f"layer-{i}") for i, extra in enumerate(found)]), "layers")
    # the behaviour layer's own name is taken by the blend
    return fusion.fuse(wide.withColumnRenamed("behavior_score", "individual_behavior_score"), history, s.fusion)


def run(spark: SparkSession, path: str, store: str, s: Settings = Settings(), client: Callable[[], review.Client] = review.EchoClient) -> Result:
    """Load a statement, score it against the history that the store had before, review a sample, update the store."""
    path = ledger.discover_statement(spark, path)
    kept = kb.Store(spark, store)
    before = kept.read()

    work = f"{store}/work-{uuid.uuid4().hex}"  # of this run: its result reads from there

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    out = keep(scored(ledger.prepare(ledger.load_statement(spark, path)), s, before[1] if before else None, keep=keep), "fused")
    out = keep(fusion.ranked(out), "scored")
    reviews = review.replies(review.chosen(out, s.review), client, s.review)
    kept.write(kb.project(out), lambda long, overall: kb.side_profiles(long, overall, kb=s.kb, s=s.fusion))
    stats = kept.read()
    assert stats is not None
    return Result(review.attach(out, reviews), reviews, stats[1])
