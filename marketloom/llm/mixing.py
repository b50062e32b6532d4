"""Soft-membership mixing: nonnegative document rates whose expected domain token totals meet targets.

A softmax classifier, fit on a bounded sample of the labelled table, gives each document posteriors p
over domains: high and low quality, each toxic or not. With n tokens, the expected total of domain k under
rates r is the sum of r * n * p_k. Projected gradient finds the rates: least squares of the totals in
the metric of the tokens, where a step changes a rate by a combination of the document's posteriors, so
equal posteriors have equal rates whatever the lengths, and the projection on 0 <= r <= most is a clip of
each rate. The squares are weighted by the inverse of the Gram matrix, sum of n p p', of the documents whose
rates are free to move; a step that doesn't help is shortened, then taken with the Gram matrix of all
documents, with which the full step is safe. Each step is one aggregate over all documents.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stash, widened
from .packing import count_tokens, default_tokenizer
from .toxicity import Toxicity, fit_toxicity, is_held_out

DOMAINS = ("high", "low", "toxic_high", "toxic_low")
#: Shares of the mix's tokens, far from those of the supplied documents (about 0.77, 0.11, 0.10, 0.02).
WEIGHTS = {"high": 0.5, "low": 0.3, "toxic_high": 0.12, "toxic_low": 0.08}
#: At most about so many labelled rows, chosen by a hash of their id, fit the classifier.
FIT_ROWS = 20_000
FEATURES = 12
MAX_STEPS, TOLERANCE, PATIENCE = 120, 1e-5, 6
#: A default total may be reduced to this share of its first value, to be within reach of rates of at most `most`; below, the nearest mix is kept.
LEAST_SHARE, WITHIN = 0.02, 0.97
#: A step takes a task for about so many documents' numbers, not one for each file.
TASK_ROWS = 1_000_000
#: Share of all documents' Gram matrix in a step's weights, beside that of the documents whose rates are free to move.
RIDGE = 0.02


def features(text: str | None, toxic: Toxicity) -> list[float]:
    """The shape of a text, and its score as a toxic one, in FEATURES numbers."""
    t = text or ""
    words = t.split()
    n, c = len(words), len(t)
    lines = [x for x in t.split("\n") if x]
    rough = list(filterfalse(str.isalnum, words))
    upper = sum(map(str.isupper, words))
    ends = len(rough) - sum(map(str.isalnum, [w[-1] for w in rough]))
    odd = len(rough) - sum(map(str.isalnum, [w[-2:-1] for w in rough]))
    same = sum(map(operator.eq, words, words[1:]))
    return [
        math.log1p(n) / 5,
        len(set(words)) / n if n else 1.0,
        c / n / 10 if n else 0.0,
        upper / n if n else 0.0,
        ends / n if n else 0.0,
        odd / n if n else 0.0,
        same / n if n else 0.0,
        len(set(lines)) / len(lines) if lines else 1.0,
        t.count("|") / n if n else 0.0,
        math.log1p(t.count("http") + t.count("@")) / 3,
        1.0 if n == 0 else 0.0,
        max(-4.0, min(4.0, toxic.logit(t))),
    ]


@dataclass(frozen=True)
class DomainModel:
    """Softmax weights over DOMAINS (columns) of standardised features and a bias (rows), and the scorer of one feature."""

    weights: tuple[tuple[float, ...], ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    toxic: Toxicity

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = (x - np.array(self.mean)) / np.array(self.scale)
        z = np.column_stack([z, np.ones(len(z))]) @ np.array(self.weights)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _fit(x: np.ndarray, y: np.ndarray, toxic: Toxicity, ridge: float = 1.0) -> DomainModel:
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    k, d = len(DOMAINS), z.shape[1]
    t, w = np.eye(k)[y], np.zeros((z.shape[1], k))
    for _ in range(60):
        s = z @ w
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = z.T @ (p - t) + ridge * w
        hess = ridge * np.eye(d * k)
        for a in range(k):
            for b in range(k):
                hess[a * d : (a + 1) * d, b * d : (b + 1) * d] += (z * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ z
        step = np.linalg.solve(hess, grad.T.ravel()).reshape(k, d).T
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return DomainModel(tuple(map(tuple, w.tolist())), tuple(mean.tolist()), tuple(scale.tolist()), toxic)


def labelled_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, y): the index of the domain of each labelled document; of repeated labels the higher quality and the toxic one count. Rows without both labels are left out."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return known.select("doc_id", (F.when(F.col("quality") > 0, 0).otherwise(1) + F.when(F.col("toxic") > 0, 2).otherwise(0)).alias("y"))


def fit_domains(docs: DataFrame, labels: DataFrame, max_rows: int = FIT_ROWS, doc_id="doc_id", text="text") -> DomainModel:
    """The classifier, from labelled rows that aren't held out (crc32 of the id). Without labels every posterior is the same."""
    toxic = fit_toxicity(docs, labels, doc_id=doc_id, text=text)
    known = labelled_domains(labels).filter(~is_held_out(F.col("doc_id")))
    n = known.count()
    if n > max_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000)) < int(1e6 * max_rows / n))
    known = known.select(F.col("doc_id").alias("__id"), F.col("y").cast("int").alias("y"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t, toxic) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    # the labels are a bounded sample of narrow rows, so they may be broadcast
    got = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(known), "__id").select("text", "y").mapInArrow(rows, "x array<double>, y int")
    got = sorted(got.collect())
    if not got:
        k = len(DOMAINS)
        return DomainModel(tuple((0.0,) * k for _ in range(FEATURES + 1)), (0.0,) * FEATURES, (1.0,) * FEATURES, toxic)
    return _fit(np.array([r["x"] for r in got]), np.array([r["y"] for r in got]), toxic)


def with_posteriors(docs: DataFrame, model: DomainModel, text="text", tokens="tokens", names=DOMAINS, tokenizer: str | None = None) -> DataFrame:
    """docs with a token count and one posterior column for each domain behind. Very long texts are counted and read whole."""
    at, path = docs.columns.index(text), tokenizer or default_tokenizer()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            p = model.posteriors(np.array([features(t, model.toxic) for t in texts]).reshape(len(texts), FEATURES))
            n = pa.array([count_tokens(t, path) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n, *(pa.array(p[:, k]) for k in range(len(names)))], names=[*batch.schema.names, tokens, *names])

    return docs.mapInArrow(rows, widened(docs, f"{tokens} long, " + ", ".join(f"{n} double" for n in names)))


def posterior_quality(docs: DataFrame, labels: DataFrame, model: DomainModel, doc_id="doc_id", text="text") -> DataFrame:
    """(domain, n, mean_posterior, share, accuracy, log_loss) by true domain on the held-out labelled rows, which no fit has seen: n rows, how often the domain's posterior is the greatest."""
    known = labelled_domains(labels).filter(is_held_out(F.col("doc_id"))).select(F.col("doc_id").alias("__id"), "y")
    rows = with_posteriors(docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")), model).join(known, "__id")
    all_ = F.array(*DOMAINS)
    own = F.element_at(all_, F.col("y") + 1)
    right = (F.array_position(all_, F.array_max(all_)) == F.col("y") + 1).cast("double")
    by_domain = rows.groupBy("y").agg(F.count("*").alias("n"), F.avg(own).alias("mean_posterior"), F.avg(right).alias("accuracy"), F.avg(-F.ln(F.greatest(own, F.lit(1e-12)))).alias("log_loss"))
    return by_domain.select(F.element_at(F.array(*map(F.lit, DOMAINS)), F.col("y") + 1).alias("domain"), "n", "mean_posterior", "accuracy", "log_loss")


@dataclass(frozen=True)
class Rates:
    """A start and, step by step, the change of a rate by each posterior; every step ends inside 0 and most."""

    start: float
    steps: tuple[tuple[float, ...], ...]
    most: float | None
    targets: tuple[float, ...]
    totals: tuple[float, ...]

    @property
    def residual(self) -> float:
        """What the totals miss of the targets, all domains together, as a share of the mix."""
        return sum(abs(a - b) for a, b in zip(self.totals, self.targets)) / max(sum(self.targets), 1e-300)

    def column(self, names=DOMAINS) -> Column:
        return _after(F.lit(self.start), self.steps, self.most, names)


def _after(r: Column, steps, most: float | None, names) -> Column:
    for step in steps:
        r = F.greatest(F.lit(0.0), r - sum((F.lit(c) * F.col(n) for c, n in zip(step, names)), F.lit(0.0)))
        if most is not None:
            r = F.least(F.lit(float(most)), r)
    return r


def fit_rates(members: DataFrame, weights: dict[str, float] = WEIGHTS, total: float | None = None, most: float | None = None, names=DOMAINS, tokens="tokens") -> Rates:
    """Rates for members(tokens, one posterior column for each name).

    total: tokens of the mix; by default the most for which no domain has to be repeated, or, where rates
    of at most `most` can't reach that, what they can: while the fit misses the targets, the plane that parts
    them from all reachable totals bounds the total, down to LEAST_SHARE of the first. Targets that
    no rates reach get the nearest mix that was found; `residual` says how far it is off. Stops at
    TOLERANCE of the total. An empty table gets rate 1.
    """
    k, n = len(names), F.col(tokens).cast("double")
    tasks = max(members.sparkSession.sparkContext.defaultParallelism, members.count() // TASK_ROWS)
    share = np.array([weights.get(a, 0.0) for a in names])
    share = share / share.sum()
    top = math.inf if most is None else most

    def look(steps: tuple, begin: float, pull: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the rates after steps: the totals, the Gram matrix of the documents whose rates are free to move, and the least of pull @ totals of any rates. One aggregate."""

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = np.zeros(k + k * k + 1)
            for batch in batches:
                n, *p = (c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns)
                p = np.column_stack(p)
                r = np.full(len(n), begin)
                for step in steps:
                    r = np.clip(r - p @ np.array(step), 0.0, top)
                free = p * (n * ((r > 0) & (r < top)))[:, None]
                reach = np.minimum(0.0, p @ pull) @ n * (most if most is not None else 0.0)
                got += np.concatenate([(r * n) @ p, (free.T @ p).ravel(), [reach]])
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in got], names=[f"s{i}" for i in range(len(got))])

        sums = members.select(n, *names).coalesce(tasks).mapInArrow(partial, ", ".join(f"s{i} double" for i in range(k + k * k + 1)))
        got = np.array(sums.agg(*(F.sum(c) for c in sums.columns)).first(), float)
        return got[:k], got[k:-1].reshape(k, k), float(got[-1])

    half, gram, _ = look((), min(1.0, top) / 2, np.zeros(k))
    mass = half * 2 / min(1.0, top)
    if mass.sum() <= 0:
        return Rates(1.0, (), most, (0.0,) * k, (0.0,) * k)
    shrinks = total is None and most is not None and (share > 0).all()
    total = total if total is not None else float(min(m / w for m, w in zip(mass, share) if w > 0))
    floor = LEAST_SHARE * total
    start = min(total / mass.sum(), top)
    steps: tuple[tuple[float, ...], ...] = ()
    inverse = np.linalg.pinv(gram)

    def off(x: np.ndarray) -> float:
        """How far totals x are from the targets in the metric of the domains."""
        return math.sqrt(max(0.0, float((x - share * total) @ inverse @ (x - share * total))))

    totals, free, length, plain, slow = mass * start, gram, 1.0, False, 0
    for _ in range(MAX_STEPS):
        if float(np.abs(totals - share * total).sum()) < TOLERANCE * total:
            break
        pull = np.linalg.pinv(gram if plain else free + RIDGE * gram) @ (totals - share * total)
        trial = (*steps, tuple((length * pull).tolist()))
        new_totals, new_free, reach = look(trial, start, pull)
        bound = reach / float(pull @ share) if shrinks and pull @ share < 0 else math.inf
        if floor <= bound < total:  # no rates reach more tokens of this mix
            total, length, plain, slow = WITHIN * bound, 1.0, False, 0
        helped = off(new_totals) / max(off(totals), 1e-300)
        if helped < 0.999:
            steps, totals, free, length, plain, slow = trial, new_totals, new_free, 1.0, False, slow + 1 if helped > 0.9 else 0
        elif not plain or length > 0.1:  # shorter, then along the gradient of all documents, which never leads up
            length, plain = (1.0, True) if not plain and length < 0.1 else (length / 4, plain)
        else:
            slow = PATIENCE
        if slow >= PATIENCE:
            if not shrinks or WITHIN * total < floor:
                break
            total, length, plain, slow = WITHIN * total, 1.0, False, 0
    return Rates(start, steps, most, tuple((share * total).tolist()), tuple(totals.tolist()))


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, total: float | None = None, most: float | None = None, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, tokens, a posterior for each domain, rate, residual (of the whole mix), for every row.

    Null texts count as empty, have one token (the end) and the rate of their posteriors; repeated rows
    stay and each counts; an empty table gives no rows.
    """
    model = fit_domains(docs, labels, doc_id=doc_id, text=text)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    members = stash(with_posteriors(slim, model).drop("text"))
    rates = fit_rates(members, weights, total, most)
    return members.withColumn("rate", rates.column()).withColumn("residual", F.lit(rates.residual))


def mix_documents(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, total: float | None = None, most: float | None = 1.0, least_residual: float | None = None, doc_id="doc_id", text="text") -> DataFrame:
    """Rows of docs, with all their columns, each as often as its rate says: the whole part always, the rest by a hash of id and text.

    With most = 1 no row is repeated. The same rows in give the same rows out. Raises if least_residual
    is given and the rates miss the targets by more.
    """
    model = fit_domains(docs, labels, doc_id=doc_id, text=text)
    names = [free_name(docs, d) for d in DOMAINS]
    tokens, times = free_name(docs, "tokens"), free_name(docs, "times")
    scored = stash(with_posteriors(docs, model, text, tokens, names))  # so that the texts are scored once
    wanted = {name: weights.get(domain, 0.0) for domain, name in zip(DOMAINS, names)}
    rates = fit_rates(scored.select(tokens, *names), wanted, total, most, names, tokens)
    if least_residual is not None and rates.residual > least_residual:
        raise ValueError(f"the mix misses its targets by {rates.residual:.2%}")
    chance = F.pmod(F.xxhash64(F.col(doc_id), F.col(text), F.lit(8)), F.lit(1 << 30)) / float(1 << 30)
    scored = scored.withColumn(times, F.floor(rates.column(names) + chance).cast("int"))
    if most is None or most > 1:
        scored = scored.filter(F.col(times) > 0).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return scored.filter(F.col(times) > 0).drop(tokens, times, *names)
