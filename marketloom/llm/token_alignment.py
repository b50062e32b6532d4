"""Alignment of two tokenizers' tokens over the same bytes.

Tasks cut their texts into words at single spaces, where both tokenizers always begin a token, and give the
distinct words of some megabytes of text, a chunk, to DuckDB as two tables of byte intervals: an ASOF join finds
the B token under each A token's first byte, a range join those that begin inside it, a window sum over common
ends numbers the groups. A document's figures are sums over its words. Partial counts of id pairs, one row a
chunk and pair, are merged in Spark and joined back by pair, then by chunk: a frequent pair has a row for each
chunk, never one for each document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .packing import default_tokenizer, encoder

#: Bytes of text in a chunk, if no single text has more; characters that are encoded at once.
CHUNK_BYTES, AT_ONCE = 6 << 20, 4_000
#: Distinct words that are given to DuckDB at once; the interval tables of so many stay under about 50 MB.
WORDS_AT_ONCE = 1 << 16
#: A single space between two other characters: no token of either kind goes across its left side.
BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
#: Any white space; where a plain split at spaces would differ from BOUNDARY; words that may not be joined to others.
SPACE = r"[\s\v\x1c-\x1f\x{85}\p{Z}]"
MORE_SPACE, OUTER_SPACE = rf"{SPACE}{{2}}|\A{SPACE}|{SPACE}\z", rf"\A\z|\A{SPACE}|{SPACE}\z"
COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

#: Each A token with the B token under its first byte, and with those that begin inside it: every overlap once.
LINKS_SQL = """
SELECT a.word, a.id AS a, b.id AS b FROM a ASOF JOIN b ON a.lo >= b.lo
UNION ALL
SELECT a.word, a.id, b.id FROM b JOIN a ON b.word = a.word AND b.lo > a.lo AND b.lo < a.hi
"""
#: A token's group is the number of common ends before its own end; A's tokens of a group come before B's.
GROUPS_SQL = """
WITH tokens AS (
  SELECT word, id, hi, 0 AS side, CAST(hi IN (SELECT hi FROM b) AS INT) AS common FROM a UNION ALL SELECT word, id, hi, 1, 0 FROM b
), numbered AS (
  SELECT *, sum(common) OVER (ORDER BY hi, side DESC ROWS UNBOUNDED PRECEDING) - common AS g FROM tokens
)
SELECT word, id, side, CAST(g AS BIGINT) AS g FROM numbered ORDER BY g, side, hi
"""


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Side:
    """A tokenizer: ids of texts that each follow a space, and the bytes of its tokens."""

    def __init__(self, encode, tokens: list[bytes]):
        self.encode, self.tokens = encode, tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)

    def _of(self, words: list[str], first: int, ends: np.ndarray, ids: np.ndarray) -> tuple | None:
        """word, id, lo, hi of the tokens of consecutive words that were encoded together; None if their bytes are not the words'."""
        if b"".join(map(self.tokens.__getitem__, ids.tolist())) != (" " + " ".join(words)).encode():
            return None
        hi = ends[first] - len(words[0].encode()) - 1 + np.cumsum(self.lengths[ids])
        own = ends[first : first + len(words)]
        word = np.searchsorted(own, hi)
        return (first + word, ids, hi - self.lengths[ids], hi) if (hi[np.searchsorted(hi, own)] == own).all() else None

    def intervals(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """word, id, lo, hi of each token of " " + word for all words, bytes counted on from word to word; a word has none if its tokens' bytes are not its own."""
        if not words:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        held = pa.array(words, pa.large_string())
        ends = np.cumsum(pc.binary_length(held).to_numpy() + 1)
        alone = pc.match_substring_regex(held, OUTER_SPACE).to_numpy(zero_copy_only=False)  # such words are encoded alone
        breaks = np.flatnonzero((np.diff(ends // AT_ONCE) > 0) | alone[1:] | alone[:-1]) + 1
        runs = list(zip([0, *breaks.tolist()], [*breaks.tolist(), len(words)]))
        each = self.encode([" ".join(words[i:j]) for i, j in runs])
        if whole := self._of(words, 0, ends, np.concatenate(each)):
            return whole
        out = []
        for (i, j), ids in zip(runs, each):
            if own := self._of(words[i:j], i, ends, ids):
                out.append(own)
            elif j > i + 1:
                out += filter(None, (self._of([words[k]], k, ends, one) for k, one in zip(range(i, j), self.encode(words[i:j]))))
        return tuple(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in out)]) for k in range(4))


@lru_cache(2)
def byte_side(path: str) -> Side:
    """The byte-level BPE of a tokenizers JSON file; strings of its added tokens are plain text."""
    e = encoder(path)
    tokens = [b""] * e.n_vocab
    for i in range(e.n_vocab):
        try:
            tokens[i] = e.decode_single_token_bytes(i)
        except KeyError:
            pass
    return Side(lambda texts: [e.encode_to_numpy(" " + t, allowed_special=set(), disallowed_special=()).astype(np.int64) for t in texts], tokens)


@lru_cache(2)
def piece_side(path: str) -> Side:
    """A sentencepiece model, which adds a space in front; raises if a piece goes on after a space, as words would then not be apart."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any("▁" in p.lstrip("▁") for p in pieces):
        raise ValueError(f"{path}: a piece with a space inside")
    tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return Side(lambda texts: [np.array(ids, np.int64) for ids in model.encode(texts, num_threads=1)], tokens)


def split_words(text: str | None) -> list[str]:
    """The text cut at single spaces, which are left out; joined by spaces they are the text again."""
    return BOUNDARY.split(text) if text else []


def numbered_words(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of the texts; the number of every word of every text; the number of words of each text."""
    held = pa.array(texts, pa.large_string())
    words = pc.split_pattern(pc.fill_null(held, ""), " ")
    if pc.any(odd := pc.fill_null(pc.match_substring_regex(held, MORE_SPACE), False)).as_py():
        split = {i: split_words(texts[i]) for i in pc.indices_nonzero(odd).to_pylist()}
        words = pa.array([split[i] if i in split else w for i, w in enumerate(words.to_pylist())], words.type)
    sizes = np.where(pc.fill_null(pc.equal(pc.binary_length(held), 0), True).to_numpy(zero_copy_only=False), 0, pc.list_value_length(words).to_numpy())
    codes = words.flatten().dictionary_encode()
    kept = np.repeat(sizes > 0, np.maximum(pc.list_value_length(words).to_numpy(), 0))
    return codes.dictionary.to_pylist(), codes.indices.to_numpy()[kept], sizes


def _table(intervals: tuple, good: np.ndarray) -> pa.Table:
    kept = good[intervals[0]]
    return pa.table({n: c[kept].astype(np.int32) for n, c in zip(("word", "id", "lo", "hi"), intervals)})


def _said(word: np.ndarray, ids: np.ndarray, side: np.ndarray, g: np.ndarray) -> list[str]:
    """The text of each word's groups, a1,a2|b1;a3|b2,b3, from its tokens in that order."""
    if not len(ids):
        return []
    mark = np.full(len(ids), 3)
    mark[:-1] = np.where(np.diff(word), 3, np.where(np.diff(g), 2, np.diff(side)))
    names = np.array([str(i) for i in range(int(ids.max()) + 1)], object)
    parts = np.empty(2 * len(ids), object)
    parts[::2], parts[1::2] = names[ids], np.array([",", "|", ";", "\n"], object)[mark]
    return "".join(parts.tolist()).split("\n")[:-1]


def align_words(words: list[str], a_path: str, b_path: str) -> tuple:
    """For each word: valid, n_a, n_b, n_groups, text of its groups; and word, a, b of every link, by word. Some words at a time, which bounds the memory."""
    parts = [_align(words[i : i + WORDS_AT_ONCE], a_path, b_path) for i in range(0, max(1, len(words)), WORDS_AT_ONCE)]
    shifts = [np.full(len(p[5]), i * WORDS_AT_ONCE) for i, p in enumerate(parts)]
    good, n_a, n_b, n_groups = (np.concatenate([p[k] for p in parts]) for k in range(4))
    return good, n_a, n_b, n_groups, [x for p in parts for x in p[4]], np.concatenate([p[5] + s for p, s in zip(parts, shifts)]), *(np.concatenate([p[k] for p in parts]) for k in (6, 7))


def _align(words: list[str], a_path: str, b_path: str) -> tuple:
    sides = [byte_side(a_path).intervals(words), piece_side(b_path).intervals(words)]
    n_a, n_b = (np.bincount(s[0], minlength=len(words)) for s in sides)
    good = (n_a > 0) & (n_b > 0)
    with duckdb.connect(config={"threads": 1}) as con:
        con.register("a", _table(sides[0], good))
        con.register("b", _table(sides[1], good))
        links = con.execute(LINKS_SQL).fetchnumpy()
        word, ids, side, g = con.execute(GROUPS_SQL).fetchnumpy().values()
    n_groups, said = np.bincount(word[np.append(np.diff(g) != 0, True)[: len(g)]], minlength=len(words)), [""] * len(words)
    for w, text in zip(word[np.append(np.diff(word) != 0, True)[: len(word)]].tolist(), _said(word, ids, side, g)):
        said[w] = text
    order = np.argsort(links["word"], kind="stable")
    return good, n_a, n_b, n_groups, said, *(np.asarray(links[k])[order].astype(np.int64) for k in ("word", "a", "b"))


_DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("first", pa.int64()), ("after", pa.int64())]))
_CHUNK = {"chunk": pa.int64(), "docs": _DOCS, "words": pa.binary(), "link_starts": pa.binary(), "links": pa.binary(), "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int64())}
_CHUNK_DDL = (
    "chunk long, docs array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string, first: long, after: long>>, "
    "words binary, link_starts binary, links binary, pairs array<long>, times array<long>"
)


def _packed(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype(np.int32).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int32)


def _sums(values: np.ndarray, words: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each document, the sum of its words' values."""
    run = np.concatenate([[0], np.cumsum(values[words])])
    return run[after] - run[first]


def _chunk_row(chunk: int, ids: list, texts: list, a_path: str, b_path: str) -> pa.RecordBatch:
    index, words, sizes = numbered_words(texts)
    good, n_a, n_b, n_groups, said, link_word, a, b = align_words(index, a_path, b_path)
    after = np.cumsum(sizes)
    whole = _sums(1 - good, words, after - sizes, after) == 0  # a text that one word's bytes spoil has no tokens
    words = words[np.repeat(whole, sizes)].astype(np.int32)
    sizes = np.where(whole, sizes, 0)
    after = np.cumsum(sizes)
    first = after - sizes
    link_starts = np.searchsorted(link_word, np.arange(len(index) + 1))
    pairs, links = np.unique(a << 32 | b, return_inverse=True)
    used = np.bincount(words, minlength=len(index))
    times = np.bincount(links, used[link_word], len(pairs)).astype(np.int64)
    columns = [_sums(v, words, first, after).tolist() for v in (n_a, n_b, n_groups, np.diff(link_starts))]
    digests = [hashlib.sha256(";".join([said[i] for i in words[f:e].tolist()]).encode()).hexdigest() if e > f else "" for f, e in zip(first, after)]
    docs = [dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "first", "after"), x)) for x in zip(ids, *columns, digests, first.tolist(), after.tolist())]
    row = {"chunk": chunk, "docs": docs, "words": _packed(words), "link_starts": _packed(link_starts), "links": _packed(links), "pairs": pairs.tolist(), "times": times.tolist()}
    return pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in _CHUNK.items()], names=list(_CHUNK))


def align_chunks(docs: DataFrame, a_path: str, b_path: str, doc_id="doc_id", text="text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each chunk of documents: their own figures, their words, each word's links as places in the chunk's list of id pairs, and the pairs' counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t or "")
                if size >= chunk_bytes:
                    yield _chunk_row(chunk, ids, texts, a_path, b_path)
                    chunk, ids, texts, size = chunk + 1, [], [], 0
        if ids:
            yield _chunk_row(chunk, ids, texts, a_path, b_path)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, _CHUNK_DDL)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """pair (A id << 32 | B id), n, best: how many links hold each id pair, and whether none of its B id's pairs has more."""
    partial = chunks.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
    totals = stash(partial.filter("n > 0").groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair").bitwiseAND((1 << 32) - 1)
    most = totals.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row for each id of B's vocabulary at most: a bounded table
    return totals.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _finish(left: pa.Table, right: pa.Table) -> pa.Table:
    row = {k: left.column(k)[0].as_py() for k in ("docs", "words", "link_starts", "links")}
    words, starts, links = (_unpacked(row[k]) for k in ("words", "link_starts", "links"))
    size = int(links.max()) + 1 if len(links) else 0
    n, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    at = right.column("at").to_numpy()
    n[at], best[at] = right.column("n").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
    docs = row["docs"]
    first, after = (np.array([d[k] for d in docs], np.int64) for k in ("first", "after"))

    def summed(values: np.ndarray) -> pa.Array:
        run = np.concatenate([[0], np.cumsum(values[links])])
        return pa.array(_sums(run[starts[1:]] - run[starts[:-1]], words, first, after), pa.int64())

    own = [pa.array([d[k] for d in docs], pa.int64()) for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return pa.Table.from_arrays([*own, summed(best), summed(n), pa.array([d["groups_sha256"] for d in docs], pa.string())], names=names)


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, doc_id="doc_id", text="text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """COLUMNS for every row of docs: tokens of A over " " + text and of B over text, their groups, their links and the corpus-wide counts of the links' id pairs.

    A null or empty text, and one that B doesn't give back byte by byte, has zeros and an empty digest.
    Repeated rows count each; very long texts are read whole, one in a chunk; an empty table gives no rows;
    other columns of docs don't matter.
    """
    chunks = stash(align_chunks(docs, a_path or default_tokenizer(), b_path or default_pieces(), doc_id, text, chunk_bytes))
    placed = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "times")).alias("at", "p")).filter("p.times > 0").select("chunk", "at", F.col("p.pairs").alias("pair"))
    counted = placed.join(pair_counts(chunks), "pair").select(F.col("chunk").alias("of"), "at", "n", "best")
    return chunks.select("chunk", "docs", "words", "link_starts", "links").groupBy("chunk").cogroup(counted.groupBy("of")).applyInArrow(_finish, COLUMNS)
