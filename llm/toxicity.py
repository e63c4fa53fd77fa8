"""Toxicity: a convolutional text classifier trained in numpy.

A word (letters and digits, A-Z lower-cased) is the sum of hashed embeddings: of the word itself and of its beginnings of
``PREFIXES`` bytes, so what stems say is learnt from all words that begin with them.  Filters over one, two and
three words, max pooling over the whole text and a logistic output give the score.  Since a filter is linear in
the embeddings, scoring adds up each distinct word's share of each filter instead of multiplying.

The fit uses every labelled text.  Their words go into blocks, dealt to as many tasks as there are ``TASK_BYTES`` of text (``MAX_TASKS`` at most).  In an epoch
each task trains the net on its rows, beginning with the epoch's parameters, and the next epoch begins with the mean of what the tasks changed: of an embedding over the tasks that
changed it.  Changes are added as whole numbers, so their order doesn't matter.  A quarter of the texts
calibrates: the net of the epoch with the least loss on it is kept, training ends after ``PATIENCE`` epochs without a lower one; the language of each text is read from the text itself (language-bitmask filters that learn from the
same rows), and each language with enough cases gets its own threshold, from counts of logits by ``GRAIN``.  The driver gets the net, a row for each bucket, and these counts: all of
bounded size.  A score is the logistic of the
network's output less the threshold, so 0.5 is the threshold in every language.

Null and empty texts have no words and get the score of the bias alone.  Null labels and labels of unknown ids
are ignored; repeated rows count each time.  Without labels of both kinds every score is the share of toxic
labels, kept within 0.001 and 0.999 (0.001 without labels).  An empty table gives an empty result; columns named ``score`` or ``predicted``
are replaced, others pass through.  A very long text is scored as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import settings, whole_pieces, written
from llm.language_id import LanguageFilter
from llm.language_id import fit as fit_language
from llm.words import _LOWER, NOT_ALNUM, Piece, hash_spans, mix, pieces

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 8, 8, (1, 2, 3)
PREFIXES = (5, 6, 7, 8, 9)
TASK_BYTES, MAX_TASKS = 24 << 20, 256
BATCH_BYTES = 4 << 20  # of the batches that tasks get and give while the net is fitted
#: a block is about a megabyte: each is a page, a few are a row group, so neither side holds a whole file
FEW_BLOCKS = {"parquet.block.size": 4 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
#: a file is one task, whatever its size: a task trains on the blocks that were dealt to it
FILE_A_TASK = {"spark.sql.files.maxPartitionBytes": 1 << 40, "spark.sql.files.openCostInBytes": 1 << 40}
FEW_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
LABELS = 1_000_000  # so many labels are broadcast
EPOCHS, PATIENCE = 10, 2
ONE = float(1 << 32)  # changes are added in these parts
GRAIN = 1 / 512
LOSS = -1
NO_WORD = -1


def word_features(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words; the buckets of each (its own, then its beginnings'; BUCKETS where it's shorter); and which of them
    each word is."""
    hashes = piece.hashes()
    words, lead, which = np.unique(hashes, return_index=True, return_inverse=True)
    starts, size = piece.starts[lead], (piece.ends - piece.starts)[lead]
    out = np.full((len(words), 1 + len(PREFIXES)), BUCKETS, np.int32)
    out[:, 0] = words & np.uint64(BUCKETS - 1)
    raw = _LOWER[piece.raw]
    for k, n in enumerate(PREFIXES):
        some = np.flatnonzero(size >= n)
        order = np.argsort(starts[some], kind="stable")
        at = some[order]
        out[at, k + 1] = mix(hash_spans(raw, starts[at], starts[at] + n) + np.uint64(n)) & np.uint64(BUCKETS - 1)
    return words, out, which


def windows(ids: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The ids 0, 1, 2 words on; the last one (no word) beyond a text's end."""
    last = np.repeat(bounds[1:], np.diff(bounds))
    at = np.arange(len(ids))
    padded = np.concatenate((ids, np.full(max(WIDTHS), NO_WORD)))
    return [np.where(at + j < last, padded[at + j], NO_WORD) for j in range(max(WIDTHS))]


@dataclass
class ToxicityNet:
    embedding: np.ndarray  # BUCKETS + 1 rows, the last one zero
    kernels: list[np.ndarray]  # width x DIM x FILTERS
    bias: np.ndarray  # of all filters
    out: np.ndarray
    out_bias: float
    language: LanguageFilter | None = None
    thresholds: dict[int, float] = field(default_factory=dict)
    threshold: float = 0.0

    def tables(self) -> list[list[np.ndarray]]:
        return [[np.ascontiguousarray(self.embedding @ k[j]) for j in range(len(k))] for k in self.kernels]

    def pooled(self, tables: list, features: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each text, before the bias; 0 in texts without words.  ``ids``: the row in
        ``features`` of each word."""
        out = np.zeros((len(bounds) - 1, FILTERS * len(WIDTHS)), np.float32)
        some = np.flatnonzero(np.diff(bounds))
        if len(some):
            shifted = windows(ids, bounds)
            none = np.zeros((1, FILTERS), np.float32)
            for i, table in enumerate(tables):
                total = None
                for j, part in enumerate(table):
                    words = np.concatenate((sum(part.take(features[:, f], 0) for f in range(features.shape[1])), none))  # the last row: no word
                    total = words.take(shifted[j], 0) if total is None else total + words.take(shifted[j], 0)
                out[some, i * FILTERS : (i + 1) * FILTERS] = np.maximum.reduceat(total, bounds[some])
        return out

    def logits(self, tables: list, features: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(tables, features, ids, bounds) + self.bias, 0) @ self.out + self.out_bias

    def scores(self, logits: np.ndarray, languages: np.ndarray) -> np.ndarray:
        shift = np.array([self.thresholds.get(int(k), self.threshold) for k in languages])
        return 1 / (1 + np.exp(-np.clip(logits - shift, -30, 30)))


def constant(share: float) -> ToxicityNet:
    share = min(max(share, 1e-3), 1 - 1e-3)
    return ToxicityNet(np.zeros((BUCKETS + 1, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), np.zeros(FILTERS * len(WIDTHS), np.float32), float(np.log(share / (1 - share))))


@dataclass
class Sample:
    """Texts for training: the features of all distinct words, and the words of each text (``bounds``)."""

    features: np.ndarray
    ids: np.ndarray
    bounds: np.ndarray
    y: np.ndarray

    def part(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The features of the words of some texts, which of them each word is, and the texts' bounds."""
        size = np.diff(self.bounds)[chosen]
        at = np.arange(size.sum()) + np.repeat(self.bounds[:-1][chosen] - (np.cumsum(size) - size), size)
        words, ids = np.unique(self.ids[at], return_inverse=True)
        return self.features[words], ids, np.concatenate(([0], np.cumsum(size)))


def texts_with(sample: Sample, rows: np.ndarray) -> np.ndarray:
    """How many texts of ``rows`` have a word of each bucket: those not toxic, toxic."""
    seen = np.zeros((2, BUCKETS + 1))
    for i in rows.tolist():
        words = np.unique(sample.ids[sample.bounds[i] : sample.bounds[i + 1]])
        seen[int(sample.y[i]), np.unique(sample.features[words])] += 1
    return seen[:, :BUCKETS]


def log_odds(seen: np.ndarray, texts: tuple[int, int]) -> np.ndarray:
    """Smoothed log odds of toxic among the texts that have a word of the bucket."""
    n0, n1 = (max(1, n) for n in texts)
    neg, pos = seen
    return np.log(((pos + 1) / (n1 + 2)) / ((neg + n0 / n1) / (n0 + 2 * n0 / n1))) * np.minimum(1, pos / 3)


def log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0.5, -z, z)).mean()) if len(y) else 0.0


def parameters(net: ToxicityNet) -> list[np.ndarray]:
    return [net.embedding, *net.kernels, net.bias, net.out]


def initial(share: float, odds: np.ndarray, seed: int = 5) -> ToxicityNet:
    """The first dimension of an embedding starts as the bucket's log odds, which gives short training sets a sensible start; all of it is trained."""
    rng = np.random.default_rng(seed)
    net = constant(share)
    net.embedding[:-1] = rng.normal(0, 0.05, (BUCKETS, DIM))
    net.embedding[:-1, 0] += np.clip(odds, -3, 3) / 2
    for k in net.kernels:
        k += rng.normal(0, 0.1, k.shape)
        k[:, 0, :] += rng.uniform(0.1, 0.6, FILTERS) / len(k)
    net.out += rng.uniform(0.05, 0.2, len(net.out))
    net.bias -= 0.5
    return net


class Adam:
    """Steps of Adam on the log loss, with the moments so far."""

    def __init__(self, net: ToxicityNet, rate: float = 0.005):
        self.net, self.rate = net, rate
        self.moment, self.second = [np.zeros_like(p) for p in parameters(net)], [np.zeros_like(p) for p in parameters(net)]
        self.bias_moment, self.step = 0.0, 0

    def run(self, sample: Sample, order: np.ndarray, batch: int = 64) -> None:
        net, rate, params = self.net, self.rate, parameters(self.net)
        for begin in range(0, len(order), batch):
            self.step += 1
            chosen = order[begin : begin + batch]
            features, ids, bounds = sample.part(chosen)
            embedded = np.concatenate((sum(net.embedding.take(features[:, f], 0) for f in range(features.shape[1])), np.zeros((1, DIM), np.float32)))  # the last row: no word
            shifted = windows(ids, bounds)
            pooled = np.zeros((len(chosen), FILTERS * len(WIDTHS)), np.float32)
            top = np.full(pooled.shape, -1)
            for i, k in enumerate(net.kernels):
                total = sum((embedded @ k[j]).take(shifted[j], 0) for j in range(len(k)))
                cols = slice(i * FILTERS, (i + 1) * FILTERS)
                for d, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    if b > a:
                        top[d, cols] = a + total[a:b].argmax(0)
                        pooled[d, cols] = total[top[d, cols], np.arange(FILTERS)]
            hidden = np.maximum(pooled + net.bias, 0)
            z = hidden @ net.out + net.out_bias
            error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - sample.y[chosen]) / len(chosen)).astype(np.float32)
            back = error[:, None] * net.out * (hidden > 0)
            grads = [np.zeros_like(p) for p in params[1:]]
            grads[-2][:], grads[-1][:] = back.sum(0), hidden.T @ error
            g_words = np.zeros((len(embedded), DIM), np.float32)
            for i, k in enumerate(net.kernels):
                at, g = top[:, i * FILTERS : (i + 1) * FILTERS], back[:, i * FILTERS : (i + 1) * FILTERS]
                live = (at >= 0) & (g != 0)
                where, f = at[live], np.nonzero(live)[1]
                for j in range(len(k)):
                    word = shifted[j][where]
                    np.add.at(grads[i][j].T, f, g[live][:, None] * embedded[word])
                    np.add.at(g_words, word, g[live][:, None] * k[j].T[f])
            moved = np.flatnonzero((g_words[:-1] != 0).any(1))
            touched, to = np.unique(features[moved], return_inverse=True)
            g_rows = np.zeros((len(touched), DIM), np.float32)
            np.add.at(g_rows, to.ravel(), np.repeat(g_words[moved], features.shape[1], axis=0))
            c1, c2 = 1 - 0.9**self.step, 1 - 0.999**self.step
            for p, m, v, g in zip(params[1:], self.moment[1:], self.second[1:], grads, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
            m, v = self.moment[0], self.second[0]
            m[touched] += 0.1 * (g_rows - m[touched])
            v[touched] += 0.001 * (g_rows * g_rows - v[touched])
            net.embedding[touched] -= rate * (m[touched] / c1) / (np.sqrt(v[touched] / c2) + 1e-8)
            net.embedding[-1] = 0
            self.bias_moment += 0.1 * (float(error.sum()) - self.bias_moment)
            net.out_bias -= rate * self.bias_moment


def train_net(sample: Sample, rows: np.ndarray, held: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.005, seed: int = 5) -> ToxicityNet:
    """The net of one sample, in this process; of the epoch with the least loss on ``held`` (the last one without these)."""
    y = sample.y
    net = initial(y[rows].mean(), log_odds(texts_with(sample, rows), tuple(int((y[rows] == v).sum()) for v in (0, 1))), seed)
    adam, rng, params = Adam(net, rate), np.random.default_rng(seed), parameters(net)
    best, least = None, np.inf
    kept_out = sample.part(held)
    for _ in range(epochs):
        adam.run(sample, rng.permutation(rows), batch)
        if len(held):
            loss = log_loss(net.logits(net.tables(), *kept_out), y[held])
            if loss < least:
                best, least = ([p.copy() for p in params], net.out_bias), loss
    if best:
        for p, kept in zip(params, best[0], strict=True):
            p[...] = kept
        net.out_bias = best[1]
    return net


def best_threshold(logits: np.ndarray, hits: np.ndarray, n: np.ndarray | None = None) -> float:
    """The logit between two cases that gives the highest F1; of ``n`` cases with a logit, ``hits`` are toxic."""
    order = np.argsort(-logits, kind="stable")
    n = np.ones(len(logits)) if n is None else n
    f1 = 2 * np.cumsum(hits[order]) / (np.cumsum(n[order]) + hits.sum())
    same = np.concatenate((logits[order][1:] == logits[order][:-1], [False]))
    top = int(np.argmax(np.where(same, -1, f1)))
    low = logits[order][top + 1] if top + 1 < len(logits) else logits[order][top] - 1
    return float((logits[order][top] + low) / 2)


def flat(net: ToxicityNet) -> np.ndarray:
    """All parameters as rows of DIM; the embeddings come first."""
    rest = np.concatenate([*(k.ravel() for k in net.kernels), net.bias, net.out, [net.out_bias]])
    return np.concatenate((net.embedding[:-1].astype(float), np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM).astype(float)))


def unflat(values: np.ndarray) -> ToxicityNet:
    net, at, rest = constant(0.5), 0, values[BUCKETS:].ravel()
    net.embedding[:-1] = values[:BUCKETS]
    for p in (*net.kernels, net.bias, net.out):
        p[...] = rest[at : at + p.size].reshape(p.shape)
        at += p.size
    net.out_bias = float(rest[at])
    return net


def rated(docs: DataFrame, labels: DataFrame, rating: str, doc_id: str, text: str, lang: str) -> DataFrame:
    """``rating``, ``text``, ``lang`` and a hash of the id for each label of ``docs``; ``held``: the quarter that calibrates."""
    known = labels.select(F.col(doc_id), F.col(rating).cast("double").alias("rating")).where(F.col(doc_id).isNotNull() & F.col("rating").isNotNull())
    known = F.broadcast(known) if known.count() <= LABELS else known
    spoken = F.col(lang) if lang in docs.columns else F.lit(None).cast("string")
    key = F.xxhash64(F.col(doc_id).cast("string"), F.lit(3))
    return docs.select(F.col(doc_id), F.col(text).alias("text"), spoken.alias("lang")).join(known, doc_id).select((F.col("rating") >= 0.5).cast("int").alias("rating"), "text", "lang", key.alias("key"), (key % 4 == 0).alias("held"))


def blocks(rows: DataFrame, tasks: int, language: LanguageFilter) -> DataFrame:
    """The words of ``rows``, about a megabyte of text a row, in an order by hash of the id that is the same in every run."""
    sent = rows.sparkSession.sparkContext.broadcast(language)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_pieces(batches, "text"):
            for piece in pieces(part.column("text"), NOT_ALNUM):  # one
                _, features, which = word_features(piece)
                held = part.column("held").to_numpy(zero_copy_only=False)
                spoken = np.full(piece.n, -1)
                first = int(held.argmin()) if not held.all() else piece.n  # held rows come first
                if first:
                    spoken[:first] = sent.value.predict(piece.part(0, first))[0]
                out = (part.column("rating").to_numpy().astype(np.int8), held.astype(np.int8), spoken.astype(np.int32), piece.word_bounds.astype(np.int64), which.astype(np.int32), features.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in out], BLOCK)

    dealt = rows.repartition(tasks, "key").sortWithinPartitions(F.desc("held"), "key", "rating", "text")
    return dealt.mapInArrow(run, ", ".join(f"{c} binary" for c in BLOCK))


BLOCK = ["y", "held", "lang", "bounds", "ids", "features"]


def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Sample, np.ndarray, np.ndarray]]:
    """Each block: its texts, which of them are held and their languages."""
    for batch in batches:
        for i in range(batch.num_rows):
            y, held, lang, bounds, ids, features = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in zip(BLOCK, (np.int8, np.int8, np.int32, np.int64, np.int32, np.int32), strict=True))
            yield Sample(features.reshape(-1, 1 + len(PREFIXES)), ids, bounds, y.astype(float)), held.astype(bool), lang


def added(df: DataFrame, fn: Callable, keys: list[str], values: list[str]) -> dict[str, np.ndarray]:
    """Whole numbers that ``fn`` makes of a task's blocks, added up by key, with the number of tasks that had one."""
    made = df.mapInArrow(fn, ", ".join(f"{c} long" for c in (*keys, *values)))
    with settings(df.sparkSession, FILE_A_TASK):
        got = made.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in values), F.count(F.lit(1)).alias("tasks")).orderBy(*keys).toArrow()
    return {c: got.column(c).to_numpy() for c in (*keys, *values, "tasks")}


def longs(names: list[str], *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    step = BATCH_BYTES // (8 * len(names))
    for a in range(0, len(columns[0]), step):
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c[a : a + step]), pa.int64()) for c in columns], names)


DIMS = [f"v{i}" for i in range(DIM)]


def epoch(df: DataFrame, values: np.ndarray, number: int, learn: bool, calibrate: bool) -> tuple[np.ndarray, float]:
    """The parameters after an epoch that begins with ``values``, and the loss of ``values`` on the held texts."""
    sent = df.sparkSession.sparkContext.broadcast(values.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, before = unflat(sent.value), unflat(sent.value)
        tables, adam, rng = before.tables(), Adam(net), np.random.default_rng(number)
        loss, n = 0.0, 0
        for sample, held, _ in samples(batches):
            held = held & calibrate
            if held.any():
                at = np.flatnonzero(held)
                loss, n = loss + log_loss(before.logits(tables, *sample.part(at)), sample.y[at]) * len(at), n + len(at)
            if learn:
                adam.run(sample, rng.permutation(np.flatnonzero(~held)))
        yield from longs(["id", *DIMS], [LOSS], [round(loss * (1 << 20))], [n], *([[0]] * (DIM - 2)))
        change = np.rint((flat(net) - flat(before)) * ONE).astype(np.int64)
        at = np.flatnonzero(change.any(1))
        yield from longs(["id", *DIMS], at, *change[at].T)

    got = added(df, run, ["id"], DIMS)
    change = np.stack([got[c] for c in DIMS], 1).astype(float)
    of_loss = got["id"] == LOSS
    total, n = change[of_loss][0, :2] if of_loss.any() else (0.0, 0)
    values, at = values.copy(), got["id"][~of_loss]
    values[at] += change[~of_loss] / ONE / got["tasks"][~of_loss][:, None]
    sent.unpersist()
    return values, total / (1 << 20) / max(n, 1)


def train(docs: DataFrame, labels: DataFrame, rating: str = "toxic", doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least: int = 20, task_bytes: int = TASK_BYTES) -> ToxicityNet:
    """A net from all labels of ``docs``; ``lang`` teaches the calibration's language filter and may be missing."""
    with settings(docs.sparkSession, FEW_BYTES):
        return fitted(rated(docs, labels, rating, doc_id, text, lang), least, task_bytes)


def fitted(rows: DataFrame, least: int, task_bytes: int) -> ToxicityNet:
    """A net from ``rated`` rows."""
    sizes = rows.groupBy("held").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("toxic"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).collect()  # two rows
    texts = {r["held"]: (r["n"] - r["toxic"], r["toxic"]) for r in sizes}
    clean, toxic = (sum(x[i] for x in texts.values()) for i in (0, 1))
    if not clean or not toxic:
        return constant(toxic / (clean + toxic) if clean + toxic else 0.0)
    calibrate = all(texts.get(h, (0, 0))[i] for h in (False, True) for i in (0, 1))
    learnt = texts[False] if calibrate else (clean, toxic)
    language = fit_language(rows, "text", "lang")
    df = written(blocks(rows, min(MAX_TASKS, 1 + sum(r["size"] for r in sizes) // task_bytes), language), "blocks", **FEW_BLOCKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS))
        for sample, held, _ in samples(batches):
            seen += texts_with(sample, np.flatnonzero(~(held & calibrate)))
        at = np.flatnonzero(seen.any(0))
        yield from longs(["id", "clean", "toxic"], at, *seen[:, at].astype(np.int64))

    got = added(df, count, ["id"], ["clean", "toxic"])
    seen = np.zeros((2, BUCKETS))
    seen[:, got["id"]] = got["clean"], got["toxic"]
    values = flat(initial(learnt[1] / sum(learnt), log_odds(seen, learnt)))
    best, lowest, since = values, np.inf, 0
    for number in range(EPOCHS + (1 if calibrate else 0)):  # a pass tells the loss of the one before
        after, loss = epoch(df, values, number, number < EPOCHS, calibrate)
        if number and calibrate:
            best, lowest, since = (values, loss, 0) if loss < lowest else (best, lowest, since + 1)
            if since == PATIENCE:
                break
        values = after
    net = unflat(best if calibrate else values)
    net.language = language
    if calibrate:
        sent = df.sparkSession.sparkContext.broadcast(net)

        def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, tables = sent.value, sent.value.tables()
            for sample, held, spoken in samples(batches):
                at = np.flatnonzero(held)
                if len(at):
                    z = model.logits(tables, *sample.part(at))
                    yield from longs(["lang", "bin", "n", "hits"], spoken[at], np.floor(np.clip(z, -30, 30) / GRAIN), np.ones(len(at)), sample.y[at])

        got = added(df, logits, ["lang", "bin"], ["n", "hits"])
        z = (got["bin"] + 0.5) * GRAIN
        bins, which = np.unique(got["bin"], return_inverse=True)
        net.threshold = best_threshold((bins + 0.5) * GRAIN, np.bincount(which, got["hits"]), np.bincount(which, got["n"]))
        for k in np.unique(got["lang"]).tolist():
            mine = got["lang"] == k
            hits, n = got["hits"][mine], got["n"][mine]
            if min(hits.sum(), (n - hits).sum()) >= least:
                net.thresholds[k] = best_threshold(z[mine], hits, n)
    return net


def score(docs: DataFrame, net: ToxicityNet, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``score`` (0 to 1) and ``predicted`` (1 if the score is 0.5 or more)."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # of a fixed size
    fields = [f for f in docs.schema.fields if f.name not in (text, "score", "predicted")]
    names = [f.name for f in fields]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tables = sent.value, sent.value.tables()
        for batch in batches:
            for piece in pieces(batch.column(text), NOT_ALNUM):
                rows = batch.slice(piece.first, piece.n)
                which = model.language.predict(piece)[0] if model.language and model.thresholds else np.full(piece.n, -1)
                s = model.scores(model.logits(tables, *word_features(piece)[1:], piece.word_bounds), which)
                yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(run, schema)
