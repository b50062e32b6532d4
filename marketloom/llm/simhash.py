"""SimHash near duplicates: fingerprints linked by a binary-trie self-join.

Two fingerprints with at most `budget` differing bits agree on at least one of budget + 1 blocks of
bits. So the trie is built once for each block, rotated to put it first; its subtrees under a whole block are
the tasks' units, and within them pairs of nodes are traversed together, adding up differing bits and
dropping a pair as soon as the budget is exceeded. Subtrees with many fingerprints are first split into
pairs of deeper nodes by the same rule, in Spark, until none is too large.

A text may have several fingerprints, of differently mixed hashes; texts link if any of them do. That
finds more near copies at the same budget, where a larger budget would make the tries' work grow faster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, settled, small_side, stash, sweep, words_of
from .graph import components
from .sketch import shingle_hashes

WORDS, SEED, BUDGET = 3, 42, 2
#: Subtrees with more fingerprints than this are split; with a budget near STEP splitting multiplies rows and saves little, so they may be larger.
LARGE, LARGE_IF_LOOSE, STEP, DEEPEST = 4096, 65_536, 6, 58
LEAF, FRONTIER, SLICE = 16, 1_000_000, 65_536
#: So many texts of a group are compared with so many in one task; so many that share most with others are compared with all first.
LOT, HUBS = 256, 32
#: Multipliers of a 64-bit mixing function and the step between its streams.
_MIX, _STREAM = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)), 0x9E3779B97F4A7C15


def blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit, width) of budget + 1 blocks."""
    ends = [64 * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _mixed(h: np.ndarray, stream: int) -> np.ndarray:
    """Hashes h for stream 0; for others, hashes of them that are independent for all purposes here."""
    if not stream:
        return h
    h = h + np.uint64(stream * _STREAM % 2**64)
    for shift, by in zip((30, 27), _MIX):
        h = (h ^ (h >> np.uint64(shift))) * by
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str | None, width: int = WORDS, streams: int = 1, letters: bool = False) -> list[bytes]:
    """8 bytes for each stream: a bit is 1 if it is set in over half of the hashes of the text's word shingles, repeats included; no words: zeros.

    Words lie between ASCII white space, A-Z lower-cased; if letters, they are runs of letters and digits.
    """
    words = words_of(text, True) if letters else (text or "").encode().lower().split()
    if not words:
        return [bytes(8)] * streams
    n = max(1, len(words) - width + 1)
    set_ = np.zeros((streams, 64), np.int64)
    for at in range(0, n, SLICE):
        part = range(at, min(n, at + SLICE))
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in part), np.uint64, len(part))
        for k in range(streams):
            bits = np.unpackbits(_mixed(h, k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            set_[k] += bits.sum(0, dtype=np.uint32)
    return [np.packbits(2 * row > n).tobytes() for row in set_]


def text_key(text: Column) -> Column:
    """A 64-bit hash of a whole text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, doc_id="doc_id", text="text", width: int = WORDS, streams: int = 1, letters: bool = False) -> DataFrame:
    """(doc_id, key long, fp long, more array<long>) for every row: the text's hash, the first stream's fingerprint and those of the others."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = b"".join(b"".join(fingerprint(t, width, streams, letters)) for t in batch.column(2).to_pylist())
            fps = np.frombuffer(found, ">i8").astype(np.int64).reshape(-1, streams)
            more = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1, dtype=np.int32) * (streams - 1)), pa.array(fps[:, 1:].ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps[:, 0]), more], names=["doc_id", "key", "fp", "more"])

    rows_in = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    return rows_in.mapInArrow(rows, "doc_id long, key long, fp long, more array<long>")


def _traverse(v: np.ndarray, frontier: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of v (sorted in each node) within the budget, below the node pairs of frontier: rows of a_lo, a_hi, b_lo, b_hi, diff, depth."""
    found_a, found_b, ones = [], [], {}
    stack = [frontier]
    while stack:
        f = stack.pop()
        if len(f) > FRONTIER:
            half = len(f) // 2
            stack += [f[:half], f[half:]]
            continue
        size = (f[:, 1] - f[:, 0]) * (f[:, 3] - f[:, 2])
        leaf = (size <= LEAF) | (f[:, 5] >= 64)
        if leaf.any():
            g, n = f[leaf], size[leaf]
            each = np.repeat(np.arange(len(g)), n)
            k = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            width = (g[:, 3] - g[:, 2])[each]
            a, b = g[each, 0] + k // width, g[each, 2] + k % width
            near = (np.bitwise_count(v[a] ^ v[b]) <= budget) & (a != b)
            found_a.append(a[near])
            found_b.append(b[near])
        f = f[~leaf]
        for depth in np.unique(f[:, 5]):
            if depth not in ones:
                ones[depth] = np.concatenate([[0], np.cumsum((v >> np.uint64(63 - depth)) & np.uint64(1))]).astype(np.int64)
            g, c = f[f[:, 5] == depth], ones[depth]
            a_mid, b_mid = g[:, 1] - (c[g[:, 1]] - c[g[:, 0]]), g[:, 3] - (c[g[:, 3]] - c[g[:, 2]])
            same = (g[:, 0] == g[:, 2]) & (g[:, 1] == g[:, 3])
            below = []
            for a_one in (0, 1):
                for b_one in (0, 1):
                    child = np.column_stack([a_mid if a_one else g[:, 0], g[:, 1] if a_one else a_mid, b_mid if b_one else g[:, 2], g[:, 3] if b_one else b_mid, g[:, 4] + (a_one != b_one), g[:, 5] + 1])
                    if a_one > b_one:
                        child = child[~same]  # of a node with itself, each pair of halves once
                    below.append(child[(child[:, 0] < child[:, 1]) & (child[:, 2] < child[:, 3]) & (child[:, 4] <= budget)])
            stack.append(np.concatenate(below))
            stack = [s for s in stack if len(s)]
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.zeros(0, int), np.zeros(0, int))


def _settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n reaches over the pairs."""
    label = np.arange(n)
    while len(a):
        m = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, m)
        np.minimum.at(label, b, m)
        label = label[label]
        if (label == before).all():
            break
    return label


def _rotate(v: np.ndarray, by: np.ndarray) -> np.ndarray:
    by = by.astype(np.uint64)
    return np.where(by == 0, v, (v << by) | (v >> ((np.uint64(64) - by) % np.uint64(64))))


def _link(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Edges from sorted rows (block, depth, a, b, side, rot): every linked fingerprint with a representative of its part of the subtree."""
    names = ("block", "depth", "a", "b", "side", "rot")

    def solve(t: np.ndarray) -> pa.RecordBatch:
        v = t[:, 5].astype(np.int64).view(np.uint64)
        new = np.concatenate([[True], (t[1:, :4] != t[:-1, :4]).any(1)]) if len(t) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        end = np.concatenate([start[1:], [len(t)]]).astype(np.int64)
        sides = np.concatenate([[0], np.cumsum(t[:, 4])])
        mid = end - (sides[end] - sides[start])
        a, b, depth = t[start, 2], t[start, 3], t[start, 1]
        own = a == b
        f = np.column_stack([start, np.where(own, end, mid), np.where(own, start, mid), end, np.bitwise_count(a ^ b).astype(np.int64), depth])
        f = f[(f[:, 0] < f[:, 1]) & (f[:, 2] < f[:, 3]) & (f[:, 1] - f[:, 0] + f[:, 3] - f[:, 2] > np.where(own, 2, 1))]
        label = _settle(len(v), *_traverse(v, f, budget))
        moved = np.flatnonzero(label != np.arange(len(v)))
        shift = (64 - np.array([s for s, _ in blocks(budget)])[t[moved, 0] % (budget + 1)]) % 64
        back = [_rotate(x, shift).view(np.int64) for x in (v[moved], v[label[moved]])]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (t[moved, 0] // (budget + 1), *back)], names=["stream", "u", "v"])

    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names]).astype(np.int64))
        if sum(map(len, held)) >= 50_000:
            t = np.concatenate(held)
            cut = len(t) - 1
            while cut and (t[cut, :4] == t[cut - 1, :4]).all():
                cut -= 1
            if cut:
                yield solve(t[:cut])
            held = [t[cut:]]
    if held and sum(map(len, held)):
        yield solve(np.concatenate(held))


def _node_pairs(distinct: DataFrame, budget: int) -> DataFrame:
    """Rows (block, depth, a, b, side, rot): each fingerprint under the node pairs whose subtrees one task traverses. Blocks are numbered on from stream to stream."""
    rotated = []
    for k, (first, width) in enumerate(blocks(budget)):
        rot = F.shiftleft("fp", first).bitwiseOR(F.shiftrightunsigned("fp", 64 - first)) if first else F.col("fp")
        rotated.append(F.struct((F.col("stream") * (budget + 1) + k).alias("block"), F.lit(width).alias("depth"), rot.alias("rot")))
    rows = distinct.select(F.explode(F.array(*rotated)).alias("r")).select("r.*")
    node = F.expr("shiftrightunsigned(rot, 64 - depth)")
    rows = rows.select("block", "depth", node.alias("a"), node.alias("b"), F.lit(0).alias("side"), "rot")
    key = ["block", "depth", "a", "b"]
    settled, masks = [], [m for m in range(1 << STEP) if m.bit_count() <= budget]
    most = LARGE if 2 * budget < STEP else LARGE_IF_LOOSE
    while True:
        large = stash(rows.groupBy(*key).count().filter((F.col("count") > most) & (F.col("depth") <= DEEPEST)).drop("count"))
        if large.isEmpty():
            discard(large)
            settled.append(rows)
            break
        few = small_side(large)
        settled.append(rows.join(few, key, "left_anti"))
        heavy = rows.join(few, key, "left_semi").withColumn("own", F.col("a") == F.col("b"))
        heavy = heavy.withColumn("child", F.expr(f"shiftrightunsigned(rot, 64 - depth - {STEP})")).withColumn("m", F.explode(F.array(*map(F.lit, masks))))
        other = F.when(F.col("side") == 0, F.col("b")).otherwise(F.col("a"))
        heavy = heavy.withColumn("t", F.shiftleft(other, STEP).bitwiseOR(F.col("child").bitwiseAND(F.lit((1 << STEP) - 1)).bitwiseXOR(F.col("m"))))
        heavy = heavy.filter(F.bit_count(F.col("child").bitwiseXOR(F.col("t"))) <= budget)
        side = F.when(F.col("own"), (F.col("child") > F.col("t")).cast("int")).otherwise(F.col("side"))
        a, b = F.when(side == 0, F.col("child")).otherwise(F.col("t")), F.when(side == 0, F.col("t")).otherwise(F.col("child"))
        sweep(heavy.sparkSession)
        rows = stash(heavy.select("block", (F.col("depth") + STEP).alias("depth"), a.alias("a"), b.alias("b"), side.alias("side"), "rot"))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def links(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Edges (stream, u, v) over the fingerprints of distinct(stream int, fp) whose components are, in each stream, those of all links of at most budget bits."""
    pairs = _node_pairs(distinct, budget)
    key = ["block", "depth", "a", "b"]
    return pairs.repartition(*key).sortWithinPartitions(*key, "side", "rot").mapInArrow(lambda batches: _link(batches, budget), "stream long, u long, v long").distinct()


def _edges(fps: DataFrame, budget: int, streams: int) -> DataFrame:
    """Edges (u, v) between fingerprints of the first stream: their own links, and those of the other streams by a text that has both fingerprints."""
    own = fps.select(F.lit(0).alias("stream"), "fp").distinct()
    if streams == 1:
        return links(own, budget).select("u", "v")
    others = fps.select("fp", F.posexplode("more").alias("stream", "f")).select((F.col("stream") + 1).alias("stream"), "f", "fp").distinct()
    others = stash(others)
    names = stash(others.groupBy("stream", "f").agg(F.min("fp").alias("name")))
    found = stash(links(own.unionByName(names.select("stream", F.col("f").alias("fp"))), budget))
    shared = others.join(names, ["stream", "f"]).select(F.col("fp").alias("u"), F.col("name").alias("v"))
    u, v = (names.select("stream", F.col("f").alias(c), F.col("name").alias(f"{c}_name")) for c in "uv")
    linked = found.filter("stream > 0").join(u, ["stream", "u"]).join(v, ["stream", "v"]).select(F.col("u_name").alias("u"), F.col("v_name").alias("v"))
    return found.filter("stream = 0").select("u", "v").unionByName(shared).unionByName(linked)


def _rooted(docs: DataFrame, budget: int, doc_id: str, text: str, width: int, streams: int, letters: bool) -> DataFrame:
    """(doc_id, key, fp, root) for every row; root, a fingerprint, names its component."""
    fps = stash(fingerprints(docs, doc_id, text, width, streams, letters))
    roots = stash(components(_edges(fps, budget, streams)).withColumnRenamed("node", "fp"))
    return fps.drop("more").join(small_side(roots), "fp", "left").select("doc_id", "key", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, budget: int = BUDGET, doc_id="doc_id", text="text", width: int = WORDS, streams: int = 1, letters: bool = False) -> DataFrame:
    """doc_id, fp (of the first stream), component_id for every row; component_id is the smallest doc_id reachable over the links.

    Rows link if at most budget bits of their fingerprints of shingles of width words differ, in any stream.
    Null texts count as empty, texts without words have fingerprint zero and are linked like any other;
    very long texts are read whole, in slices; repeated rows stay, each with its component; null ids never
    name a component that has another; an empty table gives no rows. Texts are read once and not shuffled.
    """

    def found() -> DataFrame:
        rows = stash(_rooted(docs, budget, doc_id, text, width, streams, letters))
        named = stash(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")))  # read back, so that a large component's join can be split
        return rows.join(small_side(named), "root").select("doc_id", "fp", "component_id")

    return settled(found)


def fingerprint_text(fp):
    """A long fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: A row by its id and its text's hash, so that texts that share an id are told apart.
ROW = ("doc_id", "key")


def _one_of_each(docs: DataFrame, rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs without the rows that aren't the first of their class, by (id, text hash), nulls last, in rows(doc_id, key, class); of equal rows one stays."""

    def doomed() -> DataFrame:
        distinct = rows.groupBy(*ROW, "class").agg(F.count("*").alias("n"))
        order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("key").alias("key"))
        firsts = stash(distinct.groupBy("class").agg(F.min(order).alias("first"), F.count("*").alias("rows"), F.max("n").alias("most")).filter("rows > 1 OR most > 1"))
        several = distinct.join(small_side(firsts), "class")
        stays = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))
        return several.filter(~stays | (F.col("n") > 1)).select(*ROW, (~stays).alias("gone"))

    found = settled(doomed)
    a, b = free_name(docs, "__id"), free_name(docs, "__key")
    found = small_side(found).withColumnsRenamed({"doc_id": a, "key": b})
    same = docs[doc_id].cast("long").eqNullSafe(F.col(a)) & (text_key(docs[text]) == F.col(b))
    gone, twice = found.filter("gone"), found.filter("NOT gone")
    if twice.isEmpty():
        return docs.join(gone, same, "left_anti")
    return docs.join(found, same, "left_anti").unionByName(docs.join(twice, same, "left_semi").dropDuplicates([doc_id, text]))


def keep_one_of_each(docs: DataFrame, budget: int = BUDGET, doc_id="doc_id", text="text", width: int = WORDS, streams: int = 1) -> DataFrame:
    """The rows of docs, with all their columns, without those whose component has a row of a smaller (doc_id, text hash); of rows with equal id and text one stays."""
    rows = settled(lambda: _rooted(docs, budget, doc_id, text, width, streams, False).withColumnRenamed("root", "class"))
    return _one_of_each(docs, rows, doc_id, text)


# --- links that are checked: exact likeness of the texts of a component of fingerprint links ---------------------------------

MEMBER = "group long, node long, hashes binary"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [shingle_hashes(t or "", letters=True).tobytes() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(hashes, pa.binary())], names=["group", "node", "hashes"])


class _Lot:
    """Sets of shingle hashes, to be compared with others exactly."""

    def __init__(self, sets: list[bytes]):
        own = [np.frombuffer(h, np.uint64) for h in sets]
        self.sizes = np.array([len(h) for h in own], np.int64)
        keys, owners = np.concatenate([*own, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(own)), self.sizes)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]

    def shared(self, h: np.ndarray) -> np.ndarray:
        """How many of the hashes h each set has."""
        lo, hi = np.searchsorted(self.keys, h, "left"), np.searchsorted(self.keys, h, "right")
        n = hi - lo
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return np.bincount(self.owners[at], minlength=len(self.sizes))

    def alike(self, h: np.ndarray, least: float) -> tuple[np.ndarray, float]:
        """Whether each set's Jaccard likeness to h is at least `least` (two empty sets are alike), and the mean share of h that the sets have."""
        both = self.shared(h)
        either = len(h) + self.sizes - both
        return (both >= least * either - 1e-9) & ((both > 0) | (either == 0)), float(both.sum()) / max(1, len(h) * len(self.sizes))


def _labels(sets: list[bytes], least: float) -> np.ndarray:
    """The least index that each set reaches over likeness of at least `least`."""
    lot, label = _Lot(sets), np.arange(len(sets))
    for h in sets:
        if not label.any():
            break  # all are one
        near, _ = lot.alike(np.frombuffer(h, np.uint64), least)
        own = np.unique(label[near])
        label[np.isin(label, own)] = own[0]
    return label


def _group_edges(t: pa.Table, least: float) -> pa.Table:
    """Edges (u, v) of one small group's components."""
    t = t.sort_by("node")
    label = _labels(t["hashes"].to_pylist(), least)
    nodes = t["node"].to_numpy()
    return pa.table({"u": nodes, "v": nodes[label]})


FOUND = "group long, node long, pivot long, score double"


def _against(rows: pa.Table, pivots: pa.Table, least: float) -> pa.Table:
    """For each row one of the pivots of each of their components that it is like, or null; and the mean share of it that the pivots have."""
    pivots = pivots.sort_by("node")
    sets, names = pivots["hashes"].to_pylist(), pivots["node"].to_numpy()
    lot, label = _Lot(sets), _labels(sets, least)
    group, node, pivot, score = [], [], [], []
    for g, i, h in zip(rows["group"].to_pylist(), rows["node"].to_pylist(), rows["hashes"].to_pylist()):
        near, share = lot.alike(np.frombuffer(h, np.uint64), least)
        hit = [int(names[k]) for k in np.unique(label[near])] or [None]
        group += [g] * len(hit)
        node += [i] * len(hit)
        pivot += hit
        score += [share] * len(hit)
    return pa.table({"group": pa.array(group, pa.int64()), "node": pa.array(node, pa.int64()), "pivot": pa.array(pivot, pa.int64()), "score": pa.array(score, pa.float64())})


def _compare(members: DataFrame, pivots: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """FOUND: every member against every pivot of its group, lot by lot."""
    names = members.columns
    lots = sizes.select("group", F.ceil(F.col("n") / LOT).cast("int").alias("lots"))
    blocks_ = pivots.groupBy("group").agg(F.ceil(F.count("*") / LOT).cast("int").alias("blocks"))
    layout = stash(lots.join(blocks_, "group"))
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    dealt = lambda n: F.expr(f"pmod(xxhash64(node), {n})").cast("int")
    left = members.join(small_side(layout), "group").withColumn("lot", dealt("lots")).withColumn("block", every("blocks")).select(*names, "lot", "block")
    right = pivots.join(small_side(layout), "group").withColumn("block", dealt("blocks")).withColumn("lot", every("lots")).select(*names, "lot", "block")
    both = left.groupBy("group", "lot", "block").cogroup(right.groupBy("group", "lot", "block"))
    return both.applyInArrow(lambda a, b: _against(a, b, least), FOUND)


def _large_group_edges(members: DataFrame, sizes: DataFrame, least: float) -> DataFrame | None:
    """Edges (u, v), stashed, or None, whose components are those of all links in groups of more than LOT members(MEMBER, stashed).

    In rounds: pivots are compared with all members of their group, in lots. They are a share of the
    members by hash that doubles with each round, and some that share most with the pivots before, such as a text
    that the others are copies of. Only members outside their group's largest component so far need to be
    pivots: a pair of texts both inside it is linked already. When all others have been pivots, no link is lost.
    """
    noise = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    shares = [1 - 2.0**-k for k in range(31)]
    state = stash(members.select("group", "node", F.lit(0.0).alias("score"), F.lit(False).alias("was"), F.lit(True).alias("outside")))
    edges = None  # each node that has links so far with the least that it reaches
    for turn in range(64):
        waiting = state.filter("outside AND NOT was")
        at = F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / HUBS))).cast("int")
        cuts = waiting.groupBy("group").agg(F.percentile_approx("score", F.array(*map(F.lit, shares)), 10_000)[at].alias("cut")).join(sizes, "group")
        near_hub, in_turn = (F.col("score") > 0) & (F.col("score") >= F.col("cut")), noise < LOT * 2.0**turn / F.col("n")
        chosen = stash(waiting.join(small_side(stash(cuts)), "group").filter(near_hub | in_turn).select("node"))
        if chosen.isEmpty():
            if waiting.isEmpty():
                break
            continue
        pivots = stash(members.join(small_side(chosen), "node", "left_semi"))
        found = stash(_compare(members, pivots, sizes, least))
        discard(pivots)
        new = found.filter("pivot IS NOT NULL AND pivot <> node").select(F.col("node").alias("u"), F.col("pivot").alias("v"))
        roots = stash(components(new if edges is None else new.unionByName(edges)))
        scores = found.groupBy("node").agg((F.max("score") + F.max(noise) * 1e-6).alias("score"))
        now = state.select("group", "node", "was").join(scores, "node").join(small_side(roots), "node", "left")
        now = now.join(small_side(chosen.withColumn("chosen", F.lit(True))), "node", "left")
        now = stash(now.select("group", "node", "score", (F.col("was") | F.coalesce("chosen", F.lit(False))).alias("was"), F.coalesce("root", "node").alias("root")))
        largest = stash(now.groupBy("group", "root").count().groupBy("group").agg(F.max_by("root", F.struct("count", "root")).alias("largest")))
        before, state = state, stash(now.join(small_side(largest), "group").select("group", "node", "score", "was", (F.col("root") != F.col("largest")).alias("outside")))
        for done in (before, found, chosen, now, largest, edges):
            discard(done)
        edges = roots.withColumnsRenamed({"node": "u", "root": "v"})
        edges._stash_path = roots._stash_path
        sweep(state.sparkSession)
    return edges


def checked_links(members: DataFrame, least: float) -> DataFrame:
    """(node, root) of the nodes of members(MEMBER, stashed) that have links: the components, in each group, of likeness of at least `least`."""
    sizes = stash(members.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1"))
    large = sizes.filter(F.col("n") > LOT)
    small = members.join(small_side(sizes), "group").filter(F.col("n") <= LOT).select(*members.columns)
    edges = small.groupBy("group").applyInArrow(lambda t: _group_edges(t, least), "u long, v long")
    if not large.isEmpty():
        large = stash(large)
        more = _large_group_edges(stash(members.join(small_side(large), "group", "left_semi")), large, least)
        edges = edges if more is None else edges.unionByName(more)
    return components(edges)


def keep_unlike(docs: DataFrame, budget: int = BUDGET, least: float = 0.8, doc_id="doc_id", text="text", width: int = WORDS, streams: int = 1) -> DataFrame:
    """The rows of docs, with all their columns, one of each group of near copies: the one of the smallest doc_id.

    Fingerprint links give the candidates; of the texts of one of their components those link whose
    five-word shingles have a Jaccard likeness of at least `least`, compared exactly; the groups are
    the components of such links. Words are runs of letters and digits, lower-cased. Exact copies collapse before the
    comparison. Null texts count as empty, a null id comes after all others, rows of one id with
    different texts are different rows, of rows with equal id and text one stays; an empty table gives no rows.
    """

    def classes() -> DataFrame:
        rows = stash(_rooted(docs, budget, doc_id, text, width, streams, True))
        texts = stash(rows.groupBy("root", "key").agg(F.min("doc_id").alias("id")))  # one row of each text
        several = stash(texts.groupBy("root").count().filter("count > 1").select("root"))
        wanted = stash(texts.join(small_side(several), "root", "left_semi").select(F.col("root").alias("group"), F.col("key").alias("node"), "id"))
        source = docs.select(F.col(doc_id).cast("long").alias("own"), text_key(F.col(text)).alias("own_key"), F.col(text).alias("text"))
        found = source.join(small_side(wanted), F.col("own").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("node")))
        members = stash(found.select("group", "node", "text").mapInArrow(_members, MEMBER).dropDuplicates(["group", "node"]))
        roots = stash(checked_links(members, least).withColumnRenamed("root", "verified"))
        return rows.join(small_side(roots), F.col("key") == F.col("node"), "left").select(*ROW, F.coalesce("verified", "key").alias("class"))

    return _one_of_each(docs, settled(classes), doc_id, text)
