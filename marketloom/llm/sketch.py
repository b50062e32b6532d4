"""Threshold-scaled sketches: every word-shingle hash under a fixed fraction of the hash range is kept.

Sketches of any documents merge by union, and shares of one another can be estimated however unequal
the documents are. A document with shingles but none under the threshold keeps its least hash, so only
texts without words have an empty sketch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import words_of

SHINGLE, FRACTION = 5, 1 / 8
#: Buckets of ids are as many as partitions, or more, of about so many bytes of text; their bounds are a tree in the plan.
MAX_BUCKETS, BUCKET_BYTES = 2048, 64 << 20
PAIR_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_MULTIPLY, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_S = np.uint64(33)


def shingle_hashes(text: str, width: int = SHINGLE, letters: bool = False) -> np.ndarray:
    """Distinct 64-bit hashes of the lower-cased word shingles, ascending; fewer words than width make one shingle, none no hash."""
    words = words_of(text, letters)
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for k in range(width):
        h = h * _MULTIPLY + w[k : len(w) - width + 1 + k]
    h ^= h >> _S
    for m in _MIX:
        h = h * m
        h ^= h >> _S
    return np.unique(h)


def sketch(text: str, fraction: float = FRACTION, width: int = SHINGLE) -> np.ndarray:
    return keep(shingle_hashes(text, width), fraction)


def keep(hashes: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """What a sketch retains of ascending hashes."""
    n = int(np.searchsorted(hashes, np.uint64(min(int(fraction * 2**64), 2**64 - 1))))
    return hashes[: max(n, min(1, len(hashes)))]


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of two documents' shingles together."""
    return keep(np.union1d(a, b), fraction)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has; an empty sketch is contained in any."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness; two empty sketches are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def to_text(a: np.ndarray) -> str:
    """16 hexadecimal digits for each hash, ascending."""
    return a.astype(">u8").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def fingerprint_documents(docs: DataFrame, fraction: float = FRACTION, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, n_chars, fingerprint, hashes array<long>, complete for every row; null texts count as empty, repeated rows stay.

    hashes are the retained ones; complete is false where none is under the threshold, so that the least
    stands in: such a sketch tells equal texts, but no containment.
    """
    limit = np.uint64(min(int(fraction * 2**64), 2**64 - 1))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [sketch(t, fraction) for t in texts]
            columns = [
                batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(map(to_text, found), pa.string()),
                pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64())), pa.array([bool(len(h) and h[0] < limit) for h in found]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "fingerprint", "hashes", "complete"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, "doc_id long, n_chars long, fingerprint string, hashes array<long>, complete boolean")


def merge_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """(by..., hashes): the sketch of all documents of each group together, from fingerprint_documents' columns and the grouping ones.

    The union of the complete sketches, made distinct before the groups are gathered; a group without one has no row.
    """
    rows = sketches.filter("complete").select(*by, F.explode("hashes").alias("h")).distinct()
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list("h")).alias("hashes"))


def containment_column(a: Column, complete: Column, b: Column) -> Column:
    """Estimated share of the shingles behind sketch a (array<long>) that are behind b; null where a isn't complete."""
    return F.when(complete & (F.size(a) > 0), F.size(F.array_intersect(a, b)) / F.size(a))


def _rank(value: Column, bounds: list[int], at: int = 0) -> Column:
    """How many of the ascending bounds are at most value, as a tree of comparisons."""
    if not bounds:
        return F.lit(at)
    mid = len(bounds) // 2
    return F.when(value >= bounds[mid], _rank(value, bounds[mid + 1 :], at + mid + 1)).otherwise(_rank(value, bounds[:mid], at))


def in_order(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """Rows (bucket, ahead, doc_id, text), sorted in each partition, in which every document is followed by the next one by id.

    Buckets are ranges of ids; the first document of a bucket also goes, as ahead, to the end of the one
    before, and that of the first to the last. So texts are shuffled once, nothing is collected but
    the bounds, and no task needs more than a batch of rows at a time. Null ids come first; equal ids
    are ordered by their texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    n = min(MAX_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES))
    found = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(n)], 10 * n).alias("b"), F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    least = None if found["nulls"] else found["least"]
    bounds = sorted({b for b in found["b"] or () if b != found["least"] or found["nulls"]})
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(_rank(F.col("doc_id"), bounds))
    first = F.col("doc_id").isNull() if least is None else F.col("doc_id") == least
    bound = F.coalesce(F.col("doc_id").isin(bounds), F.lit(False)) if bounds else F.lit(False)
    rows = rows.withColumn("bucket", bucket)
    places = F.array(
        F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ahead")),
        F.when(bound, F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(1).alias("ahead"))),
        F.when(first, F.struct(F.lit(len(bounds)).alias("bucket"), F.lit(1).alias("ahead"))),
    )
    rows = rows.select(F.explode(F.filter(places, lambda p: p.isNotNull())).alias("place"), "doc_id", "text").select("place.bucket", "place.ahead", "doc_id", "text")
    slot = F.element_at(F.array(*map(F.lit, _slots(spark, n))), F.col("bucket") + 1)
    return rows.repartition(n, slot).sortWithinPartitions("bucket", "ahead", F.col("doc_id").asc_nulls_first(), "text")


def _slots(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions a number that Spark's hash partitioning puts there, so that each bucket gets a partition of its own."""
    one_of: dict[int, int] = {}
    upto = 0
    while len(one_of) < n:
        ids = spark.range(upto, upto + 16 * n).select(F.col("id").cast("int").alias("i"))
        one_of |= {r["p"]: r["i"] for r in ids.groupBy(F.pmod(F.hash("i"), F.lit(n)).alias("p")).agg(F.min("i").alias("i")).collect()}
        upto += 16 * n
    return [one_of[p] for p in range(n)]


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_edit_and_next(docs: DataFrame, fraction: float = FRACTION, doc_id="doc_id", text="text") -> DataFrame:
    """The columns of PAIR_SCHEMA: each document's sketch against its half-edited text's and the next document's.

    Null texts count as empty; repeated rows stay and follow one another; a single row is followed by
    itself; an empty table gives no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous, out = None, []

        def row(a, b):
            new = edited(a[2], b[2])
            other = sketch(new, fraction)
            out.append((a[1], len(a[2]), hashlib.sha256(new.encode()).hexdigest(), to_text(a[3]), to_text(other), likeness(a[3], other), likeness(a[3], b[3])))

        def flush():
            columns = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in PAIR_SCHEMA.split(", ")])

        for batch in batches:
            for b, ahead, i, t in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if ahead and previous is None:
                    continue
                now = (b, i, t, sketch(t, fraction))
                if previous is not None:
                    row(previous, now)
                previous = None if ahead else now
                if len(out) >= 2000:
                    yield flush()
            if out:
                yield flush()

    return in_order(docs, doc_id, text).mapInArrow(rows, PAIR_SCHEMA)
