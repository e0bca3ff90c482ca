"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; any documents are the unlabelled ones,
whatever their labels say. A linear classifier over the distinct words of a text
and their four-byte beginnings is fitted in numpy to the class-prior-corrected risk

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])      (l: logistic loss)

where a step goes back up while the second term is negative. Features that three documents of the sample have
take part; a penalty that follows from the sample's size keeps those at 0 that chance explains.

The fit uses at most `positives` and `unlabelled` documents (picked by hash, from
the training fold only, without near copies); the prior is counted over all labelled rows of the fold.
Texts are scored whole. Null and empty texts get the score of no words; other columns are not read, and may have any names.
Without positives every score is 0. Repeated labels of one doc_id count as toxic if one is. Repeated rows are scored
each, and get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

BITS = 20
SCORED = "doc_id long, held_out boolean, score double, predicted int"


def features(words: set[bytes]) -> set[int]:
    """Hashed words and beginnings."""
    mask = (1 << BITS) - 1
    return {zlib.crc32(w) & mask for w in words} | {zlib.crc32(b"^" + w[:4]) & mask for w in words}


def lowered(raw: bytes) -> set[bytes]:
    return set(raw.decode("utf-8", "replace").lower().encode().translate(text.PLAIN).split())


def apart(rows: list[np.ndarray], *, common: float = 0.05, share: float = 0.5) -> list[np.ndarray]:
    """rows without copies and near copies of earlier ones, whose words would count as often as they were copied.

    Each feature that at most `common` of the rows have (two, if that is more) belongs to the first row kept that has it. A row goes if more than `share` of its
    features belong to one other that is not over twice as long.
    """
    seen, index = np.unique(np.concatenate(rows), return_inverse=True)
    rare, owner = np.bincount(index) <= max(2, common * len(rows)), np.full(len(seen), -1)
    kept, at = [], 0
    for row in rows:
        own = index[at : at + len(row)]
        own, at = own[rare[own]], at + len(row)
        known = owner[own]
        known = known[known >= 0]
        if len(known):
            whose, times = np.unique(known, return_counts=True)
            first = int(whose[times.argmax()])
            if times.max() > share * len(own) and len(kept[first]) <= 2 * len(row):
                continue
        owner[own[owner[own] < 0]] = len(kept)
        kept.append(row)
    return kept


class Sample:
    """Positive and unlabelled rows of feature numbers; of the features, those that `least` rows have."""

    def __init__(self, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, *, least: int = 3):
        rows = positive + unlabelled
        self.prior, self.is_p = prior, np.arange(len(rows)) < len(positive)
        self.n_p, self.n_u = len(positive), len(unlabelled)
        seen, index, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
        often = count >= least
        number = np.where(often, np.cumsum(often) - 1, -1)[index]
        doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.doc, self.number = doc[number >= 0], number[number >= 0]
        self.seen, self.share = seen[often], count[often] / len(rows)

    def risk(self, w: np.ndarray) -> tuple[float, float, np.ndarray]:
        """For weights w (the bias last): the two terms of the risk, the second as it is, and the direction to go back from: down the risk, or, where the second term is negative, up that term."""
        g = np.bincount(self.doc, w[self.number], len(self.is_p)) + w[-1]
        s, is_p, prior = 1 / (1 + np.exp(-np.clip(g, -40, 40))), self.is_p, self.prior
        found, missed = np.logaddexp(0, g), np.logaddexp(0, -g)
        first, second = prior * missed[is_p].mean(), found[~is_p].mean() - prior * found[is_p].mean()
        slope = np.where(is_p, -prior * s / self.n_p, s / self.n_u)  # of the second term
        slope = slope + np.where(is_p, prior * (s - 1) / self.n_p, 0) if second >= 0 else -slope
        return float(first), float(second), np.append(np.bincount(self.number, slope[self.doc], len(self.seen)), slope.sum())


    def descend(self, w: np.ndarray, *, steps: int, rate: float, shrink: np.ndarray | float = 0.0, ridge: float = 0.0) -> np.ndarray:
        """w after steps down the risk. shrink: what each weight's absolute value costs; ridge: what squares cost."""
        m1, m2 = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1):
            slope = self.risk(w)[2] + ridge * np.append(w[:-1], 0)
            m1, m2 = 0.9 * m1 + 0.1 * slope, 0.99 * m2 + 0.01 * slope * slope
            pace = rate / np.sqrt(step) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
            w = w - pace * m1 / (1 - 0.9**step)
            w[:-1] = np.sign(w[:-1]) * np.maximum(0, np.abs(w[:-1]) - pace[:-1] * shrink)
        return w

    def only(self, features: np.ndarray) -> Sample:
        """The sample with some of its features."""
        number = np.where(features, np.cumsum(features) - 1, -1)[self.number]
        out = copy(self)
        out.doc, out.number, out.seen, out.share = self.doc[number >= 0], number[number >= 0], self.seen[features], self.share[features]
        return out


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, *, steps: int = 200, rate: float = 0.1, penalty: float = 3.0, ridge: float = 1e-4) -> np.ndarray:
    """The weights of all hashed features, the bias last.

    First a weight's absolute value is penalised by `penalty` times the standard deviation that its slope has where the
    feature says nothing, so that features stay at 0 if they go with either side by chance only. Then the others
    are fitted without that penalty, which makes scores too small. Both run to where the risk is about still: with 60 steps, samples of full size were left in the middle.
    """
    sample = Sample(apart(positive), apart(unlabelled), prior)
    shrink = penalty * prior * np.sqrt(sample.share * (1 - sample.share) / sample.n_p)
    w = sample.descend(np.append(np.zeros(len(sample.seen)), np.log(prior / (1 - prior))), steps=steps, rate=rate, shrink=shrink)
    some = w[:-1] != 0
    sample = sample.only(some)
    w = sample.descend(w[np.append(some, True)], steps=steps, rate=rate, ridge=ridge)
    out = np.zeros((1 << BITS) + 1, np.float32)
    out[sample.seen], out[-1] = w[:-1], w[-1]
    return out


def train(docs: DataFrame, labels: DataFrame, *, positives: int = 3000, unlabelled: int = 9000, fold: Column | None = None, seed: int = 7) -> np.ndarray | None:
    """The weight table, from rows of docs (doc_id, text) and labels (doc_id, toxic) for whose doc_id `fold` holds; None without positives."""
    fold = F.lit(True) if fold is None else fold
    known = labels.where(fold & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("p")).first()
    if not counts["p"]:
        return None
    prior = (counts["p"] + 0.5) / (counts["n"] + 1)
    by_hash = F.xxhash64(F.lit(seed), F.col("doc_id"))
    some = docs.where(fold & F.col("doc_id").isNotNull()).select("doc_id")
    picked = known.where("toxic = 1").select("doc_id").orderBy(by_hash).limit(positives).withColumn("positive", F.lit(True))
    picked = picked.unionByName(some.orderBy(by_hash).limit(unlabelled).withColumn("positive", F.lit(False)))
    # at most positives + unlabelled rows of two small columns
    sample = docs.where(fold).select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("positive", "text")

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.fromiter(features(lowered(x)), np.int32).tobytes() for x in text.as_bytes(batch.column("text"))]
        return pa.record_batch([batch.column("positive"), pa.array(found, pa.binary())], ["positive", "features"])

    rows = sample.mapInArrow(text.batches(hashed), "positive boolean, features binary").toPandas()
    arrays = [np.sort(np.frombuffer(x, np.int32)) for x in rows["features"]]
    pos = [a for a, p in zip(arrays, rows["positive"], strict=True) if p]
    rest = [a for a, p in zip(arrays, rows["positive"], strict=True) if not p]
    if not pos or not rest:
        return None
    by_content = lambda a: a.tobytes()  # noqa: E731  the order of rows must not matter
    return fit(sorted(pos, key=by_content), sorted(rest, key=by_content), prior)


def score(docs: DataFrame, weights: np.ndarray | None, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    if weights is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    table = docs.sparkSession.sparkContext.broadcast(weights)  # 4 MB, whatever the input

    def scored(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = scorer(table.value)
        for batch in them:
            s = rate(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(scored, SCORED)


def scorer(weights: np.ndarray) -> Callable[[pa.Array], np.ndarray]:
    """The scores of a column of texts; it remembers words."""
    mask = (1 << BITS) - 1
    word = text.Memo(lambda x: float(weights[zlib.crc32(x) & mask]), 50_000)
    start = text.Memo(lambda x: float(weights[zlib.crc32(b"^" + x) & mask]), 50_000)

    def rate(column: pa.Array) -> np.ndarray:
        g = np.full(len(column), float(weights[-1]))
        for lo in range(0, len(column), 256):
            for i, raw in enumerate(text.as_bytes(column.slice(lo, 256)), lo):
                words = lowered(raw)
                g[i] += sum(map(word.__getitem__, words)) + sum(map(start.__getitem__, {x[:4] for x in words}))
        return 1 / (1 + np.exp(-np.clip(g, -40, 40)))

    return rate


def reject(docs: DataFrame, weights: np.ndarray | None, threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose text scores `threshold` or more; all columns stay. Only texts go to Python workers, and only scores come back."""
    if weights is None:
        return docs
    table = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def scores(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rate = scorer(table.value)
        for column in columns:
            yield pa.array(rate(column))

    return docs.where(scores(F.col("text").cast("string")) < threshold)


def toxicity(docs: DataFrame, labels: DataFrame, *, modulus: int = 5, **how: object) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs; rows with crc32(doc_id) mod `modulus` = 0 are held out from training."""
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))
    return score(docs, train(docs, labels, fold=rest != 0, **how), F.coalesce(rest == 0, F.lit(False)))
