"""Best-fit packing of documents into sequences, improved by exchanges between underfull bins.

Token counts of pieces take few values, so bins of the same lengths form a class and the packing works
on classes: a table of how often each length occurs (at most `capacity` rows, whatever the corpus) is
packed best-fit decreasing, then a local search moves documents and exchanges one for one or two for
one between underfull classes, many bins at once, always increasing the sum of squared fills, until
bins empty or nothing improves. Every piece then finds its place from its rank among pieces of its
length, in a join.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, small_side, stash, widened

CAPACITY, END_ID = 2048, 0
#: A rank takes so many bits beside its length in one number: 2 ** 44 pieces of a length.
RANK_BITS = 44
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(2)
def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers JSON file, with the same ids; its added tokens are the encoding's special tokens.

    In such a vocabulary a token's id is the rank of its merge, which is all that the encoder needs. Raises
    if an added token isn't matched as plain text: takes in spaces, needs word bounds or overlaps another.
    """
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    added = data.get("added_tokens", ())
    special = {t["content"]: t["id"] for t in added}
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")) or any(a != b and a[0] in b for a in special for b in special):
        raise ValueError(f"{path}: added tokens that are not matched as plain text")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in special}
    import public_tokenizers

    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(e: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids of a text, those of added tokens included."""
    return e.encode_to_numpy(text, allowed_special="all")


def count_tokens(text: str | None, path: str) -> int:
    """The number of a text's ids, the end token included."""
    return len(encode(encoder(path), text or "")) + 1


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole pieces of capacity, the first may be shorter."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def cut_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, doc_id="doc_id", text="text") -> DataFrame:
    """PIECES of every row (and ids array<int> if with_ids), with part and nth: the task that made it and its rank there among pieces of its length."""
    path = tokenizer or default_tokenizer()
    names = [f.split()[0] for f in PIECES.split(", ")] + ["part", "nth"] + ["ids"] * with_ids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seen = encoder(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out: list[tuple] = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(own, t or ""), END_ID).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    some = ids[start : start + length]
                    out.append((i, k, start, length, zlib.crc32(some.tobytes()), part, seen[length], *([some] if with_ids else [])))
                    seen[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * len(names), kinds)], names=names)

    schema = f"{PIECES}, part int, nth long" + ", ids array<int>" * with_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, schema)


# --- packing of a table of lengths ------------------------------------------------------------------------------------------


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """Best-fit decreasing: {lengths of a bin, descending: number of such bins}."""
    done: Counter = Counter()
    open_bins: dict[int, Counter] = defaultdict(Counter)  # by room left
    rooms: list[int] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                bin_, many = next(iter(open_bins[room].items()))
            else:
                room, bin_, many = capacity, (), left
            each = min(room // length, left)
            take = min(many, left // each)
            if bin_ or room < capacity:
                open_bins[room][bin_] -= take
                if not open_bins[room][bin_]:
                    del open_bins[room][bin_]
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.remove(room)
            rest, new = room - each * length, bin_ + (length,) * each
            if rest:
                if rest not in open_bins:
                    insort(rooms, rest)
                open_bins[rest][new] += take
            else:
                done[new] += take
            left -= each * take
    for own in open_bins.values():
        done.update(own)
    return done


@lru_cache(100_000)
def _sums(bin_: tuple) -> tuple[np.ndarray, np.ndarray, dict]:
    """Totals of one length of a bin, of two, ascending, and lengths that make each total, one where one does."""
    ones = {(x,): x for x in bin_}
    twos = {(bin_[i], bin_[j]): bin_[i] + bin_[j] for i in range(len(bin_)) for j in range(i + 1, len(bin_))}
    made = {t: k for k, t in [*twos.items(), *ones.items()]}
    return np.unique(list(ones.values())), np.unique(list(twos.values()) or [0])[0 if twos else 1 :], made


def _exchange(a: tuple, b: tuple, capacity: int) -> tuple[tuple, tuple] | None:
    """What a and b become by the exchange that fills bin b most from bin a: a move, one for one, two for one, one for two; None if none does."""
    room, (a1, a2, a_made), (b1, b2, b_made) = capacity - sum(b), _sums(a), _sums(b)
    gain, best = 0, None
    for give, take in ((np.concatenate([a1, a2]), np.concatenate([[0], b1])), (a1, b2)):
        give = np.sort(give)
        at = np.searchsorted(give, take + room, "right") - 1
        gains = np.where(at >= 0, give[at] - take, 0)
        if len(gains) and gains.max() > gain:
            k = int(gains.argmax())
            gain, best = int(gains[k]), (a_made[int(give[at[k]])], b_made[int(take[k])] if take[k] else ())
    if best is None:
        return None
    new_a, new_b = list(a), list(b)
    for x in best[0]:
        new_a.remove(x)
        new_b.append(x)
    for y in best[1]:
        new_b.remove(y)
        new_a.append(y)
    return tuple(sorted(new_a, reverse=True)), tuple(sorted(new_b, reverse=True))


def local_search(bins: Counter, capacity: int = CAPACITY) -> Counter:
    """Exchange between underfull bins, the emptiest against the fullest, until the bins are as few as the tokens allow or nothing improves.

    Every step increases the sum of squared fills, since what it moves goes to the fuller bin, so the
    search ends. Bins of a class take part together.
    """
    bins = Counter(bins)
    tokens = sum(sum(b) * m for b, m in bins.items())
    total, least = sum(bins.values()), -(-tokens // capacity)
    under = sorted((sum(b), b) for b in bins if sum(b) < capacity)
    hopeless: set = set()
    while total > least:
        found = None
        for i, (_, a) in enumerate(under):
            for _, b in reversed(under[i:]):
                if (a, b) not in hopeless and (a != b or bins[a] > 1):
                    if found := _exchange(a, b, capacity):
                        break
                    hopeless.add((a, b))
            if found:
                break
        if not found:
            break
        many = bins[a] // 2 if a == b else min(bins[a], bins[b])
        for old in (a, b):
            bins[old] -= many
            if not bins[old]:
                del bins[old]
                under.remove((sum(old), old))
        for new in found:
            if not new:
                total -= many
                continue
            if new not in bins and sum(new) < capacity:
                insort(under, (sum(new), new))
            bins[new] += many
    return bins


def places(bins: Counter) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, sequence id of the first, offset): where the pieces of each length go, by rank."""
    out, used, base = [], Counter(), 0
    for bin_, many in sorted(bins.items(), reverse=True):
        offset = 0
        for length in bin_:
            out.append((length, used[length], used[length] + many, base, offset))
            used[length] += many
            offset += length
        base += many
    return out


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces(length, part, nth, ...), stashed, with sequence_id and offset instead of part and nth."""
    spark = pieces.sparkSession
    parts = stash(pieces.groupBy("length", "part").agg((F.max("nth") + 1).alias("n")))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    where = np.array(places(local_search(best_fit(counts, capacity), capacity)), np.int64).reshape(-1, 5)
    ranked = pieces.join(small_side(first), ["length", "part"]).withColumn("rank", F.col("first") + F.col("nth")).drop("part", "nth", "first")
    if len(where) > BROADCAST_ROWS:  # bins that differ in their lengths, not documents, decide its size
        table = spark.createDataFrame(pd.DataFrame(where, columns=["own", "lo", "hi", "base", "at"]))
        placed = ranked.join(table, (F.col("length") == F.col("own")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        return placed.withColumn("sequence_id", F.col("base") + F.col("rank") - F.col("lo")).withColumnRenamed("at", "offset").drop("own", "rank", "lo", "hi", "base")
    where = where[np.lexsort((where[:, 1], where[:, 0]))]
    starts, names = where[:, 0] << RANK_BITS | where[:, 1], ranked.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(starts, length << RANK_BITS | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where[at, 3] + rank - where[at, 1]), pa.array(where[at, 4])], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(rows, widened(ranked, "sequence_id long, offset long")).drop("rank")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of each document.

    A null or empty text is its end token alone; repeated rows are packed each; an empty table gives no
    rows. Only lengths and places are shuffled, never texts or ids.
    """
    pieces = stash(cut_documents(docs, tokenizer, capacity, doc_id=doc_id, text=text))
    return pack_pieces(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
