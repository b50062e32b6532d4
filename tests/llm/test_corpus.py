import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from marketloom.llm import common, graph
from marketloom.llm import mixing as M
from marketloom.llm import packing as P
from marketloom.llm import queries as Q
from marketloom.llm import simhash as S

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, rate int"


def brute_components(fps, budget=S.BUDGET):
    """The least index that each reaches over fingerprints, or lists of them of which any may link."""
    root = list(range(len(fps)))
    columns = np.array(fps, np.uint64).reshape(len(fps), -1).T

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero((np.bitwise_count(columns[:, i + 1 :] ^ columns[:, i : i + 1]) <= budget).any(0)):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def close_fingerprints(n, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, 2**64 - 1]
    out = []
    for _ in range(n):
        x = rng.choice(centres)
        for b in rng.sample(range(64), rng.randrange(7)):
            x ^= 1 << b
        out.append(x)
    return out


@pytest.mark.parametrize("large, budget", [(4096, 2), (20, 2), (4096, 5), (60, 3), (4096, 0)])
def test_trie_join_against_brute_force(spark, monkeypatch, large, budget):
    monkeypatch.setattr(S, "LARGE", large)  # if small, subtrees are split again and again
    monkeypatch.setattr(S, "LARGE_IF_LOOSE", large)
    fps = sorted(set(close_fingerprints(700, large + budget)))
    frame = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long").withColumn("stream", F.lit(0))
    roots = {r["node"]: r["root"] for r in graph.components(S.links(frame, budget)).collect()}
    want = brute_components(fps, budget)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    groups, expected = defaultdict(set), defaultdict(set)
    for x, w in zip(signed, want):
        groups[roots.get(x, x)].add(x)
        expected[w].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5), (1001, 1000)], "u long, v long")
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}
    assert graph.components(edges.limit(0)).count() == 0


def test_simhash_query_against_brute_force(spark, small_dir):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect())
    fps = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    got = {r["doc_id"]: r for r in Q.op9_simhash(spark, small_dir).collect()}
    for (i, _), x, c in zip(docs, fps, brute_components(fps)):
        assert got[i]["fingerprint"] == f"{x:016x}" and got[i]["component_id"] == docs[c][0]


def test_dedup_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b c d"), (3, "a b c d"), (7, "A b  c\td"), (5, "other words here now"), (6, " \n")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", 1) for i, t in rows], DOCS)
    kept = S.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5]
    assert S.near_duplicates(docs).count() == len(rows)
    assert S.keep_one_of_each(docs.limit(0)).count() == 0


def edited_copies(n, seed, change):
    """n random texts, and each again with a share of its words replaced; with the Jaccard likeness of their five-word shingles."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(n):
        a = rng.choices(vocabulary, k=rng.randrange(60, 400))
        b = [rng.choice(vocabulary) if rng.random() < change else w for w in a]
        x, y = ({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        out.append((" ".join(a), " ".join(b), len(x & y) / len(x | y)))
    return out


@pytest.mark.parametrize("streams", [1, 3])
def test_streams_against_brute_force(spark, streams):
    texts = [t for a, b, _ in edited_copies(60, streams, 0.03) for t in (a, b)] + ["", None, "a", "a b", "b a", "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    fps = [[int.from_bytes(x, "big") for x in S.fingerprint(t, 2, streams)] for t in texts]
    got = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(docs, 4, width=2, streams=streams).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(fps, 4)


def test_pipeline_links_near_copies_and_no_others(spark):
    close = [c for c in edited_copies(300, 1, 0.015) if c[2] >= 0.8]
    far = [c for c in edited_copies(100, 2, 0.3) if c[2] < 0.4]
    rows = [t for a, b, _ in close + far for t in (a, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", 1) for i, t in enumerate(rows)], DOCS)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    n = 2 * len(close)
    assert len(close) > 150 and sum(i in kept for i in range(1, n, 2)) < 0.1 * len(close)
    assert all(i in kept for i in range(0, n, 2)) and all(i in kept for i in range(n, len(rows)))


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def brute_survivors(rows, groups):
    """Of rows (id, text), ascending, the indexes of the first of each component of checked links between rows of one candidate group."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for k in range(i):
            if groups[i] == groups[k] and len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k]):
                a, b = find(i), find(k)
                root[max(a, b)] = min(a, b)
    return [i for i in range(len(rows)) if find(i) == i]


@pytest.mark.parametrize("lot", [256, 8])
def test_pipeline_keeps_one_of_each_group_of_checked_links(spark, monkeypatch, lot):
    monkeypatch.setattr(S, "LOT", lot)  # if small, groups take several rounds
    rng, rows = random.Random(lot), []
    for f in range(6):
        body = [f"f{f}w{rng.randrange(400)}" for _ in range(300)]
        for _ in range(24):  # from near copies to texts half alike
            change = rng.choice([0.003, 0.01, 0.03])
            rows.append(" ".join(f"x{rng.randrange(9999)}" if rng.random() < change else w for w in body))
    hub = [f"h{rng.randrange(500)}" for _ in range(200)]  # copies that are like their source and not like one another
    rows += [" ".join("y" + w if rng.random() < 0.018 else w for w in hub) for _ in range(30)] + [" ".join(hub)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", 1) for i, t in enumerate(rows)], DOCS)
    groups = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(docs, 4, width=2, streams=corpus_pipeline.STREAMS, letters=True).collect()}
    want = brute_survivors(list(enumerate(rows)), [groups[i] for i in range(len(rows))])
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == want and len(set(groups.values())) < len(want) < len(rows)


def test_a_large_group_of_copies_of_one_source(spark, monkeypatch):
    monkeypatch.setattr(S, "LOT", 16)
    rng = random.Random(9)
    hub = [f"h{rng.randrange(500)}" for _ in range(200)]
    rows = [" ".join("y" + w if rng.random() < 0.018 else w for w in hub) for _ in range(150)] + [" ".join(hub)]
    members = spark.createDataFrame([(7, i, S.shingle_hashes(t, letters=True).tobytes()) for i, t in enumerate(rows)], S.MEMBER)
    roots = {r["node"]: r["root"] for r in S.checked_links(common.stash(members), 0.8).collect()}
    want = brute_survivors(list(enumerate(rows)), [0] * len(rows))
    assert sorted(set(roots.values()) | (set(range(len(rows))) - set(roots))) == want and len(want) < len(rows) / 2


def test_rows_that_share_an_id_are_told_apart(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (1, a), (2, a), (None, b), (None, "other text of its own"), (3, None), (4, ""), (5, "  "), (None, "other text of its own")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", 1) for i, t in rows], DOCS).withColumn("__gone", F.lit(1)).withColumn("key", F.lit(2))
    for keep in (S.keep_one_of_each, lambda d: S.keep_unlike(d, 4, 0.8, width=2, streams=3)):
        got = keep(docs)
        assert got.columns == docs.columns
        assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got.collect()) == [(-1, "other text of its own"), (1, a), (1, b), (3, "")]
        assert keep(docs.limit(0)).count() == 0


def test_long_texts_are_read_whole(spark, monkeypatch):
    words = [f"w{i % 977}" for i in range(5000)]
    whole = S.fingerprint(" ".join(words), 3, 2)
    monkeypatch.setattr(S, "SLICE", 64)
    assert S.fingerprint(" ".join(words), 3, 2) == whole != S.fingerprint(" ".join(words[:2500]), 3, 2)


# --- packing ----------------------------------------------------------------------------------------------------------------


def test_cut():
    assert P.cut(1) == [(0, 1)] and P.cut(2048) == [(0, 2048)] and P.cut(2049) == [(0, 1), (1, 2048)] and P.cut(5000) == [(0, 904), (904, 2048), (2952, 2048)]


@pytest.mark.parametrize("seed", range(6))
def test_search_keeps_the_pieces_and_empties_bins(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([rng.randrange(1, 60), rng.randrange(30, 101), 34, 51]) for _ in range(400))
    first = P.best_fit(counts, 100)
    after = P.local_search(first, 100)
    for bins in (first, after):
        assert Counter(x for b, m in bins.items() for x in b for _ in range(m)) == counts and all(sum(b) <= 100 for b in bins)
    assert -(-sum(k * v for k, v in counts.items()) // 100) <= sum(after.values()) <= sum(first.values())
    square = lambda bins: sum(sum(b) ** 2 * m for b, m in bins.items())
    assert square(after) >= square(first)


def test_exchange_makes_room():
    bins = Counter({(60, 30): 1, (55, 35): 1, (10, 10): 1})
    assert sum(P.local_search(bins, 100).values()) == 2


def check_packing(docs, rows, capacity=P.CAPACITY):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.default_tokenizer())
    bins, by = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        by[r["doc_id"]].append(r)
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    for (i, _), e in zip(docs, t.encode_batch([x or "" for _, x in docs], add_special_tokens=False)):
        ids = np.array([*e.ids, 0], "<u4")
        pieces = sorted(by[i], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in pieces] == P.cut(len(ids), capacity)
        assert [r["ids_crc32"] for r in pieces] == [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in pieces]
    return len(bins), -(-sum(r["length"] for r in rows) // capacity)


def test_packing_of_documents(spark, small_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    n, least = check_packing(docs, Q.op10_packing(spark, small_dir).collect())
    assert n <= least + 1


def test_added_tokens_are_encoded_as_the_tokenizers_library_does(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.default_tokenizer())  # as the file has it: no flag set
    texts = ["ab <|endoftext|> c", "<|endoftext|>", "x<|endoftext|>y  <|endoftext|><|endoftext|>\n\n z", "<|endoftext", "a" * 5000 + "<|endoftext|>" * 3000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = P.cut_documents(frame, with_ids=True).orderBy("doc_id", "piece").collect()
    for i, text in enumerate(texts):
        assert [x for r in rows if r["doc_id"] == i for x in r["ids"]] == [*t.encode(text, add_special_tokens=False).ids, P.END_ID]
    assert 50256 in rows[0]["ids"]


def test_counts_are_those_of_the_ids(small_dir):
    import duckdb

    path = P.default_tokenizer()
    texts = [t for (t,) in duckdb.execute(f"SELECT text FROM '{small_dir}/documents.parquet'").fetchall()] + [None, "", "  a   b\n\n c\t", "it's   ", "x <|endoftext|>  y", "é😀  ü\u00a0\u3000z", "\r\n \r\n", "1 22  333"]
    for t in texts:
        assert P.count_tokens(t, path) == len(P.encode(P.encoder(path), t or "")) + 1


def test_packing_edges(spark):
    docs = [(1, None), (2, ""), (3, "<|endoftext|> x"), (4, "word " * 30_000), (None, "é😀")]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, "x", 1) for i, t in docs], DOCS)
    check_packing(docs, P.pack_documents(frame).collect())
    assert P.pack_documents(frame.unionByName(frame)).count() == 2 * P.pack_documents(frame).count()
    assert P.pack_documents(frame.limit(0)).count() == 0
    ids = P.cut_documents(frame, with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in ids)


# --- mixing -----------------------------------------------------------------------------------------------------------------


def test_rates_meet_targets(spark, small_dir):
    rows = Q.op8_mixing(spark, small_dir)
    s = rows.agg(*(F.sum(F.col("rate") * F.col("tokens") * F.col(d)).alias(d) for d in M.DOMAINS), F.min("rate").alias("least"), F.max("residual").alias("residual")).first()
    total = sum(s[d] for d in M.DOMAINS)
    assert s["least"] >= 0 and s["residual"] < 1e-3 and all(abs(s[d] / total - M.WEIGHTS[d]) < 1e-3 for d in M.DOMAINS)


def members_of(spark, seed, n=400):
    """Tokens and soft posteriors over four domains, mostly of the first two."""
    rng = np.random.default_rng(seed)
    p = np.array([rng.dirichlet(np.where(np.arange(4) == rng.choice(4, p=[0.7, 0.15, 0.1, 0.05]), 20, 0.3)) for _ in range(n)])
    tokens = rng.integers(1, 500, n)
    return tokens, p, spark.createDataFrame([(int(k), *map(float, x)) for k, x in zip(tokens, p)], "tokens long, " + ", ".join(f"{d} double" for d in M.DOMAINS))


@pytest.mark.parametrize("most", [None, 1.0])
@pytest.mark.parametrize("weights", [(0.4, 0.3, 0.2, 0.1), (0.25, 0.25, 0.25, 0.25), (0.1, 0.6, 0.2, 0.1)])
def test_rates_meet_reachable_targets(spark, weights, most):
    tokens, p, members = members_of(spark, 1)
    rates = M.fit_rates(members, dict(zip(M.DOMAINS, weights)), most=most)
    r = np.array([x["r"] for x in members.select(rates.column().alias("r")).collect()])
    assert (r >= 0).all() and (most is None or (r <= most + 1e-12).all()) and rates.residual < 1e-3
    np.testing.assert_allclose((p * tokens[:, None]).T @ r, rates.totals, rtol=1e-9)
    np.testing.assert_allclose(np.array(rates.totals) / sum(rates.totals), weights, atol=1e-3)
    if most:  # what is reachable is found, within a tenth
        best = max(t for t in np.linspace(0.01, 1, 100) if reachable(p, tokens, np.array(weights), t * tokens.sum()))
        assert sum(rates.targets) > 0.9 * best * tokens.sum()


def reachable(p, tokens, share, total):
    """Whether rates between 0 and 1 have these totals: by many projected-gradient steps with momentum, on one machine."""
    a, r = (p * tokens[:, None]).T, np.full(len(p), 0.5)
    w = np.linalg.inv((p * tokens[:, None]).T @ p)
    y, t = r.copy(), 1.0
    for _ in range(3000):
        new = np.clip(y - p @ (w @ (a @ y - share * total)), 0, 1)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, r, t = new + (t - 1) / t2 * (new - r), new, t2
    return np.abs(a @ r - share * total).sum() < 1e-3 * total


def test_nearest_mix_of_targets_out_of_reach(spark):
    tokens, p, members = members_of(spark, 2)
    rates = M.fit_rates(members, {"high": 0.9, "low": 0.1}, most=1.0)
    r = np.array([x["r"] for x in members.select(rates.column().alias("r")).collect()])
    a = (p * tokens[:, None]).T
    w = np.linalg.inv(a @ p)
    loss = lambda x: (d := a @ x - np.array(rates.targets)) @ w @ d
    rng = np.random.default_rng(3)
    assert 0.001 < rates.residual < 0.3
    for _ in range(50):  # no small change of rates inside the bounds comes much nearer
        assert loss(np.clip(r + rng.normal(0, 1e-2, len(r)), 0, 1)) >= 0.9 * loss(r)


def test_posteriors_on_rows_that_no_fit_has_seen(spark, small_dir):
    docs, labels = (common.read_table(spark, f"{small_dir}/../sf0.1", n) for n in ("documents", "labels"))
    model = M.fit_domains(docs, labels)
    got = {r["domain"]: r for r in M.posterior_quality(docs, labels, model).collect()}
    n = sum(r["n"] for r in got.values())
    assert sum(r["accuracy"] * r["n"] for r in got.values()) / n > 0.95 and sum(r["log_loss"] * r["n"] for r in got.values()) / n < 0.15
    assert got["high"]["accuracy"] > 0.98 and got["low"]["accuracy"] > 0.9 and got["toxic_high"]["accuracy"] > 0.9


def test_mixing_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "x y"), (3, "a b c")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", 1) for i, t in rows], DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (3, None, None), (3, 0, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    assert M.mixing_rates(docs, labels).count() == len(rows)
    assert M.mix_documents(docs, labels).columns == docs.columns
    clash = docs.withColumn("high", F.lit(1)).withColumn("tokens", F.lit("x")).withColumn("__r", F.lit(2))
    assert M.mix_documents(clash, labels).columns == clash.columns
    assert M.mix_documents(docs, labels.limit(0), most=None, total=100.0).count() > len(rows)
    assert M.mixing_rates(docs.limit(0), labels).count() == 0 and M.mix_documents(docs.limit(0), labels).count() == 0


# --- pipeline ---------------------------------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, small_dir):
    docs = common.read_table(spark, small_dir, "documents")
    labels = {r["doc_id"]: r["toxic"] for r in common.read_table(spark, small_dir, "labels").collect()}
    columns = docs.columns
    clean = common.stash(corpus_pipeline.toxicity(spark, docs, small_dir))
    assert clean.columns == columns
    left = {r["doc_id"] for r in clean.select("doc_id").collect()}
    assert sum(y == 0 and i not in left for i, y in labels.items()) <= 3
    single = common.stash(corpus_pipeline.near_dedup(spark, clean, small_dir))
    texts = sorted((r["doc_id"], r["text"] or "") for r in clean.collect())
    fps = [[int.from_bytes(x, "big") for x in S.fingerprint(t, corpus_pipeline.WIDTH, corpus_pipeline.STREAMS, True)] for _, t in texts]
    groups = brute_components(fps, corpus_pipeline.NEAR_BITS)
    assert sorted(r["doc_id"] for r in single.collect()) == [texts[i][0] for i in brute_survivors(texts, groups)]
    # recall without the candidates: of all near copies, those that a link of their own or a chain takes out
    everything = brute_survivors(texts, [0] * len(texts))
    assert single.count() - len(everything) <= 0.1 * (len(texts) - len(everything))
    mixed = common.stash(corpus_pipeline.mixing(spark, single, small_dir))
    assert mixed.columns == columns and 0.5 * single.count() < mixed.count() < single.count()
    quality = {r["doc_id"]: r["quality"] for r in common.read_table(spark, small_dir, "labels").collect()}
    tokens = lambda rows, q: sum(len(r["text"] or "") for r in rows if quality.get(r["doc_id"]) == q)
    before, after = single.collect(), mixed.collect()
    assert tokens(after, 0) / tokens(after, 1) < 0.7 * tokens(before, 0) / tokens(before, 1)
    assert mixed.select("doc_id").distinct().count() == mixed.count()
    packed = corpus_pipeline.packing(spark, mixed, small_dir).collect()
    check_packing([(r["doc_id"], r["text"]) for r in mixed.collect()], packed)
    assert len(packed) == corpus_pipeline.run(spark, small_dir).count()


def test_components_of_what_one_forest_holds_take_no_round(spark, monkeypatch):
    """Edges of one task are stars at once; those of several tasks, with repeats and long ways, come out as by one pass over all."""
    stars, rng = [], np.random.default_rng(3)
    monkeypatch.setattr(graph, "_star", lambda *a, own=graph._star: stars.append(1) or own(*a))
    path = spark.createDataFrame([(i, (i + 7) % 3000) for i in (np.arange(2999) * 7 % 3000).tolist()], "u long, v long").coalesce(1)
    assert {r["root"] for r in graph.components(path).collect()} == {0} and not stars
    pairs = [tuple(p) for p in rng.integers(0, 900, (700, 2)).tolist()] * 2
    least = list(range(900))
    for _ in range(900):
        before = list(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "u long, v long").repartition(30)).collect()}
    assert got == {n: least[n] for n in {x for p in pairs if p[0] != p[1] for x in p}}
