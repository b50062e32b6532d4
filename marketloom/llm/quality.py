"""Quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's words, its runs of marks and its shapes of words (capitals, digits, marks, a word seen before) are
hashed alone and in pairs into a table of weights; a score is the sparse dot product of a text's
shares, each counted within its kind, with the weights. The weights are learned row by row: each keeps a
sum of gradients and of their squares, and is zero until that sum outgrows its L1 bound.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, widened

#: Bits of the table; labelled rows to learn from, at most about so many; passes over them.
BITS, FIT_ROWS, PASSES = 20, 10_000, 3
#: Step size, its offset, and the L1 and L2 bounds of the updates.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.01, 0.1
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Distinct tokens that a task remembers at most.
MEMO = 200_000

_memo: dict[str, int] = {}
_known = np.zeros((2, MEMO), np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)


def shape(token: str) -> str:
    """A token's kind: marks as they are (at most three); else capitals, digits and length class of the word."""
    if not (token[0].isalnum() or token[0] == "_"):
        return token[:3]
    kind = "9" if any(c.isdigit() for c in token) else "A" if token.isupper() else "Aa" if token[0].isupper() else "a" if token.islower() else "aA"
    return f"{kind}{min(len(token), 24) // 4}"


def _hashes(token: str) -> tuple[int, int]:
    return xxhash.xxh3_64_intdigest(token), xxhash.xxh3_64_intdigest(shape(token), seed=1)


def _hashed(tokens: list[str]) -> np.ndarray:
    """Hashes of the tokens in the first row, of their shapes in the second."""
    numbers = list(map(_memo.get, tokens))
    if None in numbers:
        new = {t for t, k in zip(tokens, numbers) if k is None}
        if len(_memo) + len(new) > MEMO:
            _memo.clear()
            new = set(tokens)
        if len(new) > MEMO:  # a text of more distinct tokens than are remembered
            return np.array([_hashes(t) for t in tokens], np.uint64).T
        for t in new:
            k = _memo[t] = len(_memo)
            _known[:, k] = _hashes(t)
        numbers = [_memo[t] for t in tokens]
    return _known[:, numbers]


def streams(text: str | None, bits: int = BITS) -> list[np.ndarray]:
    """For words, their pairs, shapes, their pairs, and pairs that the text has had before or not: the places in the table of all of them, in order."""
    tokens = TOKEN.findall(text or "")
    if not tokens:
        return []
    hashed = _hashed(tokens)
    shift, out = np.uint64(64 - bits), []
    for h in hashed:
        out += [h * ODD >> shift, ((h[:-1] * ODD ^ h[1:]) * ODD) >> shift]
    again = np.full(len(out[1]), 2)
    again[np.unique(hashed[0][:-1] * ODD ^ hashed[0][1:], return_index=True)[1]] = 1
    return [x for x in (*out, again) if len(x)]


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places and values: the share of each place in its stream, and a constant at place 0; a null or empty text has the constant alone."""
    places, values = [np.zeros(1, np.int64)], [np.ones(1)]
    for stream in streams(text, bits):
        own, counts = np.unique(stream, return_counts=True)
        places.append(own.astype(np.int64))
        values.append(counts / len(stream))
    return np.concatenate(places).astype(np.int32), np.concatenate(values).astype(np.float32)


class Quality:
    """The weights that are not zero, and their places; score() is the probability of label 1."""

    def __init__(self, weights: np.ndarray, bits: int = BITS):
        self.places, self.bits = np.flatnonzero(weights), bits
        self.values = weights[self.places]

    @cached_property
    def table(self) -> np.ndarray:
        table = np.zeros(1 << self.bits)
        table[self.places] = self.values
        return table

    def score(self, text: str | None) -> float:
        logit = self.table[0] + sum(float(self.table[s].mean()) for s in streams(text, self.bits))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


def fit_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, passes: int = PASSES, alpha=ALPHA, beta=BETA, l1=L1, l2=L2) -> np.ndarray:
    """Weights after `passes` over rows (places, values, label): the leader of all linearised losses so far under both bounds, kept as sums z and n."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(at) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(passes):
        for at, x, y in rows:
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) * x
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    return weights(slice(None))


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves remainder 2 by 4; a null id doesn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = FIT_ROWS, doc_id="doc_id", text="text") -> Quality:
    """Learn from the labelled rows that are not held out, at most about max_rows of them, chosen and ordered by a hash of the id.

    Null labels, ids without a text and texts without a label are left out; of repeated labels the highest
    counts. Without any label every score is one half. The same rows give the same model.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("y"))
    n = known.count()
    if n > max_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * max_rows / n))
    # the labels left are about max_rows narrow rows, so they may be broadcast; texts are not moved
    known = known.select(F.col("doc_id").alias("__id"), "y", F.xxhash64("doc_id", F.lit(11)).alias("turn"))
    sample = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(known), "__id").select("text", "y", "turn", F.xxhash64("text").alias("mark"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [features(t) for t in batch.column(0).to_pylist()]
            lists = [pa.array([e[0] for e in each], pa.list_(pa.int32())), pa.array([e[1] for e in each], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *lists], names=["y", "turn", "mark", "places", "values"])

    got = sample.mapInArrow(rows, "y int, turn long, mark long, places array<int>, values array<float>").toArrow().sort_by([("turn", "ascending"), ("mark", "ascending")])
    columns = [got.column(c).combine_chunks() for c in ("places", "values")]
    train = [(p.values.to_numpy(), v.values.to_numpy(), y) for p, v, y in zip(*columns, got.column("y").to_pylist())]
    return Quality(fit_leader(train))


def with_score(docs: DataFrame, model: Quality, text="text", name="score") -> DataFrame:
    """docs with one more column: the score, 0 to 1, of each whole text (a null text counts as empty, a very long one is read whole). Nothing is shuffled."""
    at = docs.columns.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(rows, widened(docs, f"{name} double"))


def score_quality(docs: DataFrame, labels: DataFrame, least: float = 0.7, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from `least` on) for every row; repeated rows stay, an empty table gives no rows, other columns don't matter."""
    model = fit_quality(docs, labels, doc_id=doc_id, text=text)
    scored = with_score(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7, doc_id="doc_id", text="text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least `least`."""
    name = free_name(docs, "score")
    return with_score(docs, fit_quality(docs, labels, doc_id=doc_id, text=text), text, name).filter(F.col(name) >= least).drop(name)
