"""Toxicity by a weighted finite-state pattern grammar.

Words and marks of a clause become symbols. Five weighted transducers, composed, rewrite them: insult
(words and phrases such as "waste of space"), threat (intent, a violent verb and a second person, in either
order), target (a second person before or after an insult), negation (some words on, to a comma at most) and
reported speech (after a verb of speech, or in quotation marks). An arc's weight scales what it
marks. A clause scores its matches; a document the number of matched clauses of each kind, its heaviest
match and their sum. Insult stems are learned from labelled documents next to a short list; a logistic
regression, on documents that the stems were not learned from, makes a probability of it.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_side, stash, widened

#: Word lists of the grammar, by language en, de, fr, es.
INSULTS = """idiot idiots moron morons stupid dumb imbecile loser losers scum trash worthless pathetic disgusting clown bastard filth vermin
dummkopf abschaum trottel arschloch crétin connard salaud imbécile idiota estúpido imbécil escoria cabrón""".split()
HEADS = "piece waste sack load stück haufen tas pedazo montón".split()
LINKS = "of de d' von".split()
OBJECTS = "space skin oxygen garbage crap shit dirt dung dreck scheiße merde mierda basura".split()
VIOLENCE = "kill murder stab strangle hurt shoot beat töten umbringen tuer massacrer matar".split()
INTENT = "i we i'll we'll i'm we're will shall going gonna want must should ich wir werde werden will je nous vais allons yo voy vamos".split()
TARGETS = "you your yours yourself u du dich dir euch dein tu toi te vous ton ti tus usted vosotros".split()
NEGATIONS = "not no never nor isn't aren't don't won't wouldn't cannot can't nicht kein keine nie ne pas jamais nunca tampoco".split()
REPORTS = "said says say called calls quoted claims wrote sagte sagt nannte schrieb dit disait appelle dijo dice llamó escribió".split()
BREAKS = [",", "but", "aber", "sondern", "mais", "pero"]

CLAUSE = re.compile(r"[.!?;\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
SYMBOL = re.compile(WORD.pattern + r"|[,\"“”«»]")
PREFIXES = range(4, 9)
FEATURES = ("insult", "targeted", "negated", "reported", "threat", "heaviest", "total")
#: Weights before any label is seen, bias last; the fit starts from them and is held near them.
PRIOR = (1.0, 1.5, 0.2, 0.2, 2.0, 0.8, 0.5, -3.0)
#: At most so many labelled rows, chosen by a hash of their id, fit the stems and the weights.
FIT_ROWS = 10_000
FLUSH = 200_000
#: Near copies are told by so many minima of their five-word hashes, each under another odd multiplier.
MINIMA = tuple(2 * k * 0x9E3779B97F4A7C15 + 1 & 2**64 - 1 for k in range(4))
#: How sure a stem's share of toxic documents has to be: the deviate of its Wilson bound, chosen by cross-fitted log loss.
SURE = (2.0, 2.8, 3.6)


# --- transducers: step(state, symbol) -> (state, symbol, weight of the arc); a symbol is a letter and its marks, the start state is 0 ---

#: I insult, K head of a phrase, F link, D object, V violent verb, A intent, Y second person, N negation, R verb of speech, Q quotation mark, B break, O other; T threat
CLASSES = (("I", INSULTS), ("K", HEADS), ("F", LINKS), ("D", OBJECTS), ("V", VIOLENCE), ("A", INTENT), ("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("B", BREAKS), ("Q", list("\"“”«»")))
THREAT, PHRASE, MENTION = 2.5, 2.5, 0.3
TARGETED, NEGATED, REPORTED = 1.5, 0.2, 0.4


def insult(state: int, x: str) -> tuple[int, str, float]:
    """A head, a link and an object ("waste of space") make an insult; a listed or learned word is one itself."""
    if x == "K":
        return 1, x, 1.0
    if x == "F" and state == 1:
        return 2, x, 1.0
    if x == "D":
        return 0, "I+" if state == 2 else "O", 1.0
    return (2 if state == 2 and x == "O" else 0), x, 1.0


def threat(state: tuple | int, x: str) -> tuple[tuple, str, float]:
    """Intent and a violent verb with a second person at most 6 words before or 4 after make a threat; the verb alone is a mention."""
    seen, meant, verb = state or (0, 0, 0)
    after = max(0, seen - 1), max(0, meant - 1), max(0, verb - 1)
    if x == "A":
        return (after[0], 5, after[2]), x, 1.0
    if x == "V":
        if seen and meant:
            return after, "T", 1.0
        return (after[0], after[1], 5 if meant else 4), x, 1.0
    if x == "Y":
        return (6, after[1], 0), "T" if verb else x, 1.0 if meant else 0.8
    return after, x, 1.0


def target(state: tuple | int, x: str) -> tuple[tuple, str, float]:
    """An insult at most 5 words after a second person, or 3 before one, is aimed at it."""
    person, waiting = state or (0, 0)
    after = max(0, person - 1), max(0, waiting - 1)
    if x[0] == "I":
        return ((after[0], 0), x + "@", TARGETED) if person else ((0, 4), x, 1.0)
    if x in ("Y", "T"):
        return (6, 0), x + "@" if waiting else x, 1.0
    return after, x, 1.0


def negation(state: int, x: str) -> tuple[int, str, float]:
    """5 words after a negation, but not beyond a break, what matches is negated."""
    if x == "N":
        return 5, x, 1.0
    if x == "B":
        return 0, x, 1.0
    return max(0, state - 1), x + "-" if state else x, NEGATED if state else 1.0


def reported(state: int, x: str) -> tuple[int, str, float]:
    """After a verb of speech (1), or inside quotation marks (2), what matches is someone else's."""
    if x[0] == "R":
        return state | 1, x, 1.0
    if x[0] == "Q":
        return state ^ 2, x, 1.0
    return state, x + '"' if state else x, REPORTED if state else 1.0


class Composed:
    """Transducers in a row, each reading what the one before writes; arcs are composed when first needed and kept."""

    def __init__(self, *steps):
        self.steps, self.arcs, self.start = steps, {}, (0,) * len(steps)

    def __call__(self, state: tuple, x: str) -> tuple[tuple, str, float]:
        arc = self.arcs.get((state, x))
        if arc is None:
            y, weight, after = x, 1.0, []
            for step, s in zip(self.steps, state):
                s, y, w = step(s, y)
                after.append(s)
                weight *= w
            arc = self.arcs[state, x] = tuple(after), y, weight
        return arc


def grammar() -> Composed:
    return Composed(insult, threat, target, negation, reported)


def kind_of(y: str) -> int | None:
    """The feature that counts clauses with this output symbol; None if it is no match."""
    if y[0] not in "ITV" and "@" not in y:
        return None
    return 2 if "-" in y else 3 if '"' in y else 4 if y[0] == "T" else 1 if "@" in y else 0 if y[0] == "I" else None


@dataclass
class Toxicity:
    """Stems with their log-odds ("word" whole, "stem*" as a prefix) and the weights of FEATURES, bias last."""

    stems: dict[str, float]
    weights: tuple[float, ...] = PRIOR
    _machine: tuple | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"stems": self.stems, "weights": self.weights, "_machine": None}

    def machine(self):
        if self._machine is None:
            words = {w: (x, 0.0) for x, ws in reversed(CLASSES) for w in ws}
            words |= {w: ("I", max(0.5, self.stems.get(w, 2.0))) for w in INSULTS}
            prefixes = {}
            for stem, odds in self.stems.items():
                if stem.endswith("*"):
                    prefixes[stem[:-1]] = odds
                else:
                    words[stem] = ("I", odds)
            a = ahocorasick.Automaton()
            for w in {*(w for w, (x, _) in words.items() if x in "IDV"), *prefixes}:
                a.add_word(w, (len(w), w in prefixes))
            a.make_automaton()
            self._machine = a, words, prefixes, grammar()
        return self._machine

    def hit(self, low: str) -> bool:
        """Whether a word that a match can't do without, or a stem at the start of a word, is in the lower-cased text."""
        for end, (n, prefix) in self.machine()[0].iter(low):
            start = end - n + 1
            if (not start or not low[start - 1].isalpha()) and (prefix or end + 1 == len(low) or not low[end + 1].isalpha()):
                return True
        return False

    def features(self, text: str | None) -> list[float]:
        """Clauses by the kinds of their matches (log scale), the heaviest match, the sum of all. Very long texts are read whole, clause by clause."""
        low = (text or "").lower()
        return self.matches(low.replace("’", "'")) if self.hit(low) else [0.0] * len(FEATURES)

    def matches(self, low: str) -> list[float]:
        _, words, prefixes, table = self.machine()
        counts, heaviest, total = [0] * 5, 0.0, 0.0
        for clause in filter(self.hit, CLAUSE.split(low)):
            state, kinds, before = table.start, set(), 0.0
            for w in SYMBOL.findall(clause):
                x, odds = words.get(w, ("O", 0.0))
                if x == "O":
                    found = [prefixes[p] for k in PREFIXES if (p := w[:k]) in prefixes]
                    if found and (odds := max(found)):
                        x = "I"
                state, y, weight = table(state, x)
                if y[0] in "ITV" or "@" in y:
                    base = PHRASE if y[:2] == "I+" else odds if y[0] == "I" else THREAT if y[0] == "T" else MENTION if y[0] == "V" else (TARGETED - 1) * before
                    value = base * weight
                    heaviest, total = max(heaviest, value), total + value
                    kinds.add(kind_of(y))
                    before = base if y[0] == "I" else 0.0
            for k in kinds - {None}:
                counts[k] += 1
        return [*(math.log1p(c) for c in counts), heaviest, math.log1p(total)]

    def logit(self, text: str | None) -> float:
        return max(-30.0, min(30.0, sum(w * x for w, x in zip(self.weights, [*self.features(text), 1.0]))))

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-self.logit(text)))


def units(text: str | None) -> set[str]:
    """The words of a text and their prefixes, each once."""
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) > k}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(counts)
        columns = [[k[0] for k in keys], [k[1] for k in keys], [k[2] for k in keys], [counts[k] for k in keys]]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()))], names=["unit", "half", "toxic", "n"])

    for batch in batches:
        for text, half, toxic in zip(*(batch.column(i).to_pylist() for i in range(3))):
            counts.update((u, half, toxic) for u in units(text))
            if len(counts) > FLUSH:
                yield flush()
    yield flush()


def _with_least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("text", "half", "toxic", "id", *(f"least{k}" for k in range(len(MINIMA))))
    for batch in batches:
        least = []
        for text in batch.column(0).to_pylist():
            words = (text or "").lower().encode().split()
            h = np.array([xxhash.xxh3_64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))], np.uint64)
            least.append([int((h * np.uint64(m)).min() >> np.uint64(1)) for m in MINIMA])
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array([x[k] for x in least], pa.int64()) for k in range(len(MINIMA)))], names=names)


def _stems(rows: list, n_toxic: int, n_clean: int, z: float = 2.8) -> dict[str, float]:
    """Units whose share of toxic documents is over one half even at the Wilson bound; a prefix stands for the longer units under it.

    But where a longer unit has four fifths of a prefix's toxic documents and at most half of its clean ones, the prefix is too wide.
    """
    found, seen = {}, {}
    for unit, t, c in rows:
        n, p = t + c, t / (t + c)
        if n and (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) > 0.5:
            seen[unit] = t, c
            found[unit] = math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
    below = defaultdict(list)
    for unit, own in seen.items():
        word = unit.rstrip("*")
        for k in PREFIXES:
            if k < len(word) or k == len(word) and not unit.endswith("*"):
                below[word[:k] + "*"].append(own)
    kept: dict[str, float] = {}
    for unit in sorted(found, key=lambda u: (len(u.rstrip("*")), u)):
        word, (t0, c0) = unit.rstrip("*"), seen[unit]
        if any(t >= 0.8 * t0 and 2 * c <= c0 and c < c0 for t, c in below[unit]):
            continue
        if not any(word[:k] + "*" in kept for k in PREFIXES if k < len(word) or k == len(word) and not unit.endswith("*")):
            kept[unit] = found[unit]
    return kept


def _fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton's method with a Gaussian prior around PRIOR."""
    w0 = np.array(PRIOR)
    w, x = w0.copy(), np.column_stack([x, np.ones(len(x))]) if len(x) else np.zeros((0, len(PRIOR)))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * (w - w0))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def is_held_out(doc_id):
    """crc32 of the id as text leaves remainder 0 by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = FIT_ROWS, doc_id="doc_id", text="text") -> Toxicity:
    """Learn stems and weights from the labelled rows that are not held out, at most about max_rows of them.

    Null labels, ids without a text and texts without a label are left out; of repeated labels the
    highest counts. Without any label the word lists and PRIOR remain. The same rows give the same model.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = known.count()
    if not n:
        return Toxicity({})
    if n > max_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * max_rows / n))
    known = known.select(F.col("doc_id").alias("__id"), "toxic", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int").alias("half"))
    # the labels are at most max_rows narrow rows, so they may be broadcast; texts are not moved
    sample = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(known), "__id").select("text", "half", "toxic", F.col("__id").cast("long").alias("id"))
    sample = stash(sample.mapInArrow(_with_least, "text string, half int, toxic int, id long, " + ", ".join(f"least{k} long" for k in range(len(MINIMA)))))
    # near copies are no independent evidence: of those that share a least five-word hash, the one of the smallest id counts
    left = sample.drop("text")
    for k in range(len(MINIMA)):
        left = left.groupBy(f"least{k}", "toxic").agg(F.min(F.struct("id", *(c for c in left.columns if c != "id"))).alias("r")).select("r.*")
    train = stash(sample.join(small_side(stash(left.select("id").distinct())), "id", "left_semi").select("text", "half", "toxic"))
    sizes = {(r["half"], r["toxic"]): r["count"] for r in train.groupBy("half", "toxic").count().collect()}
    t = [F.coalesce(F.sum(F.when((F.col("half") == h) & (F.col("toxic") == y), F.col("n"))), F.lit(0)).alias(f"n{h}{y}") for h in (0, 1) for y in (0, 1)]
    counted = train.mapInArrow(_counted, "unit string, half int, toxic int, n long").groupBy("unit").agg(*t)
    # a unit can only pass the bound if most of its documents are toxic; of a bounded sample, so few are left
    rows = counted.filter("2 * n01 > n01 + n00 AND n01 > 2 OR 2 * n11 > n11 + n10 AND n11 > 2 OR 2 * (n01 + n11) > n01 + n11 + n00 + n10 AND n01 + n11 > 2").collect()

    def size(*keys) -> int:
        return sum(sizes.get(k, 0) for k in keys)

    def half(h: int, z: float) -> Toxicity:
        return Toxicity(_stems([(r["unit"], r[f"n{h}1"], r[f"n{h}0"]) for r in rows if r[f"n{h}1"]], size((h, 1)), size((h, 0)), z))

    halves = [[half(h, z) for h in (0, 1)] for z in SURE]

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            x = [[v for pair in halves for v in pair[1 - h].features(s)] for s, h in zip(texts, own)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(2).cast(pa.int32())], names=["x", "y"])

    got = sorted(train.mapInArrow(crossed, "x array<double>, y int").collect())
    x, y = np.array([r["x"] for r in got], float).reshape(len(got), len(SURE), len(FEATURES)), np.array([r["y"] for r in got], float)
    fits = [_fit_weights(x[:, k], y) for k in range(len(SURE))]
    k = min(range(len(SURE)), key=lambda k: _log_loss(x[:, k], y, fits[k]))
    final = _stems([(r["unit"], r["n01"] + r["n11"], r["n00"] + r["n10"]) for r in rows], size((0, 1), (1, 1)), size((0, 0), (1, 0)), SURE[k])
    return Toxicity(final, fits[k])


def _log_loss(x: np.ndarray, y: np.ndarray, weights: tuple[float, ...]) -> float:
    z = np.column_stack([x, np.ones(len(x))]) @ np.array(weights)
    return float(np.logaddexp(0, np.where(y > 0, -z, z)).mean()) if len(y) else 0.0


def with_score(docs: DataFrame, model: Toxicity, text="text", name="score") -> DataFrame:
    """docs with one more column: the score, 0 to 1, of each whole text (a null text counts as empty, a very long one is read whole). Nothing is shuffled."""
    at = docs.columns.index(text)
    schema = widened(docs, f"{name} double")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(rows, schema)


def score_documents(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; repeated rows stay, an empty table gives no rows."""
    model = fit_toxicity(docs, labels, doc_id=doc_id, text=text)
    scored = with_score(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, doc_id="doc_id", text="text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is under threshold."""
    name = free_name(docs, "score")
    return with_score(docs, fit_toxicity(docs, labels, doc_id=doc_id, text=text), text, name).filter(F.col(name) < threshold).drop(name)
