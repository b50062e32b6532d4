"""Operators 11 to 13 against brute force, plain versions and held-out rows."""

import hashlib
import json
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketloom.llm import merkle, quality, queries
from marketloom.llm import token_alignment as T
from marketloom.llm.packing import default_tokenizer

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(d, text):
    return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d["doc_id"], d["source"], d["lang"], d["n_chars"], text))


def plain_tree(nodes):
    """(root, siblings before and after each node, level by level), one level at a time."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for j in range(len(nodes)):
            run, k = runs[at[j] // 16], at[j] % 16
            paths[j].append((run[:k], run[k + 1 :]))
            at[j] //= 16
        level = [H(r) for r in runs]
    return level[0], paths


def plain_manifest(docs):
    by = defaultdict(list)
    for d in docs:
        by[d["source"]].append(d)
    for own in by.values():
        own.sort(key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d, d["text"])))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([leaf(d, d["text"]) for d in by[s]]) for s in names}
    root, above = plain_tree([trees[s][0] for s in names]) if names else (None, [])
    lower = str.maketrans(merkle.UPPER, merkle.UPPER.lower())
    out = []
    for s, up in zip(names, above):
        for d, path in zip(by[s], trees[s][1]):
            met = path + up
            changed = d["doc_id"] is not None and d["text"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0
            node = leaf(d, d["text"].translate(lower) if changed else d["text"])
            for a, b in met:
                node = H([*a, node, *b])
            out.append((d["doc_id"], leaf(d, d["text"]), trees[s][0], root, H(x for a, b in met for x in a + b), node, node == root))
    return sorted(out, key=repr)


def written(spark, tmp_path, docs, **tables):
    spark.createDataFrame([tuple(d[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for d in docs], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def doc(i, source, text, lang="en"):
    return {"doc_id": i, "source": source, "lang": lang, "n_chars": len(text or ""), "text": text}


def test_manifest_of_edge_cases(spark, tmp_path):
    docs = [doc(i, "many", f"Text {i} ÄÖ") for i in range(600)]  # more than a block of 256, a last block of 88
    docs += [doc(i, "edge", f"T {i}") for i in range(257)]  # a last block of one leaf
    docs += [doc(7, None, "NULL source"), doc(None, "x", None), doc(None, "x", "b"), doc(3, "x", "a"), doc(3, "x", "a"), doc(3, "x", "B" * 200_000), doc(9, "lone", ""), doc(10, "é", None, None), doc(11, "", "e")]
    got = queries.op11_merkle(spark, written(spark, tmp_path, docs))
    assert got.columns == list(merkle.COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_manifest(docs)


def test_manifest_of_many_sources_few_and_none(spark, tmp_path):
    docs = [doc(i, f"s{i}", f"t{i}") for i in range(40)]
    assert sorted(map(tuple, queries.op11_merkle(spark, written(spark, tmp_path / "a", docs)).collect()), key=repr) == plain_manifest(docs)
    one = [doc(1, "s", "T")]
    row = queries.op11_merkle(spark, written(spark, tmp_path / "b", one)).first()
    assert row["root"] == row["leaf"] == row["subroot"] and row["proof_sha256"] == hashlib.sha256(b"").hexdigest()
    assert queries.op11_merkle(spark, written(spark, tmp_path / "c", [])).count() == 0
    wide = spark.createDataFrame([(1, "s", "l", 1, "T", "n", 5)], DOCS + ", node string, at long")
    assert merkle.manifest(wide).count() == 1


def test_manifest_equals_its_sql(spark, tiny_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tiny_dir}/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(merkle.COLUMNS)} FROM ({queries.ORACLE_SQL['op11_merkle']})").fetchall()
    got = [tuple(r) for r in queries.op11_merkle(spark, tiny_dir).collect()]
    assert sorted(got) == sorted(want) and {r[-1] for r in got} == {True, False}


# --- 12 -------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def plain_tokenizers():
    a = Tokenizer.from_file(default_tokenizer())
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    with open(default_tokenizer(), encoding="utf-8") as f:
        tokens = {i: bytes(byte_of.get(c, 0) for c in t) for t, i in json.load(f)["model"]["vocab"].items()}
    return a, tokens, sentencepiece.SentencePieceProcessor(model_file=T.default_pieces())


def plain_alignment(texts, tools):
    """Ids, groups and links of each text by comparing every token of A with every one of B."""
    a, tokens, b = tools
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        ids, other = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        parts, pieces = [tokens[i] for i in ids], [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in other for p in [b.id_to_piece(i)]]
        if b"".join(parts) != (" " + text).encode() or b"".join(pieces) != (" " + text).encode():
            out.append(None)
            continue
        spans = [[(i, e - len(p), e) for i, p, e in zip(x, q, np.cumsum([len(p) for p in q]).tolist())] for x, q in ((ids, parts), (other, pieces))]
        links = [(x, y) for x, lo, hi in spans[0] for y, lo2, hi2 in spans[1] if lo < hi2 and lo2 < hi]
        ends = sorted({s[2] for s in spans[0]} & {s[2] for s in spans[1]})
        groups, before = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, _, hi in side if before < hi <= e) for side in spans))
            before = e
        out.append((len(ids), len(other), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def plain_rows(ids, texts, tools):
    found = plain_alignment(texts, tools)
    counts = Counter(link for f in found if f for link in f[3])
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(i, f[0], f[1], f[2], len(f[3]), sum(counts[k] == most[k[1]] for k in f[3]), sum(counts[k] for k in f[3]), f[4]) if f else (i, 0, 0, 0, 0, 0, 0, "") for i, f in zip(ids, found)]


ODD = [None, "", " ", "  ", "a", "Hello  world", "\n\ttabs and\n lines \n", "<s>x</s> <|endoftext|> y", "under▁score ok", "naïve café — “quoted” 日本語 🙂🙂", "x" * 700, "a b " * 500, " leading", "trailing ", "tab\t two spaces 　wide", "don't we'll 1234567 3.14", "á ́b", " sep \x1c x", "\r\n", "ﬁ ½ Ⅷ", "a \n b", "<0x41> ▁", "Hello  world"]


def test_alignment_of_edge_cases(spark, plain_tokenizers):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, chunk string").repartition(3)
    for size in (40, T.CHUNK_BYTES):
        got = T.align_documents(docs, chunk_bytes=size)
        assert sorted(map(tuple, got.collect())) == plain_rows(range(len(ODD)), ODD, plain_tokenizers)
    assert T.align_documents(docs.limit(0)).count() == 0
    assert [f.split()[0] for f in T.COLUMNS.split(", ")] == got.columns


def test_alignment_query_equals_brute_force(spark, tiny_dir, plain_tokenizers):
    rows = [r for r in spark.read.parquet(f"{tiny_dir}/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 1500]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, T.align_documents(docs, chunk_bytes=20_000).collect()))
    assert got == sorted(plain_rows([r["doc_id"] for r in rows], [r["text"] for r in rows], plain_tokenizers))
    assert queries.op12_token_alignment(spark, tiny_dir).count() == spark.read.parquet(f"{tiny_dir}/documents.parquet").count()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\t▁é日'1.<>"), max_size=14), max_size=5))
def test_words_put_together_are_the_text(plain_tokenizers, texts):
    words, codes, sizes = T.numbered_words(texts)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for k, t in enumerate(texts):
        assert " ".join(words[c] for c in codes[at[k] : at[k + 1]]) == t
    a, _, b = plain_tokenizers
    for t in texts:
        if t and "▁" not in t:
            split = T.split_words(t)
            assert [i for w in split for i in a.encode(" " + w, add_special_tokens=False).ids] == a.encode(" " + t, add_special_tokens=False).ids
            assert [i for w in split for i in b.encode(w)] == b.encode(t)


# --- 13 -------------------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark, small_dir):
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    got = queries.op13_quality(spark, small_dir)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == spark.read.parquet(f"{small_dir}/documents.parquet").count()
    rows = got.join(labels.dropna(subset=["quality"]), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.95
    again = {r["doc_id"]: r["score"] for r in queries.op13_quality(spark, small_dir).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in rows)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "good words here", "c"), (None, "x" * 300_000, "d"), (5, "!!! ###", "e")], "doc_id long, text string, score string")
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(2, 1), (2, 0), (5, 0), (None, 1), (77, 1)], "doc_id long, quality int")
    assert quality.score_quality(docs, some).count() == 5 and quality.score_quality(docs.limit(0), some).count() == 0
    kept = quality.keep_good(docs, some, least=0.0)
    assert kept.columns == docs.columns and kept.count() == 5


def test_leader_updates_equal_a_plain_version():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(16, 5, replace=False)).astype(np.int32), rng.random(5).astype(np.float32), int(rng.integers(2))) for _ in range(60)]
    got = quality.fit_leader(rows, bits=4, passes=2, alpha=0.5, beta=1.0, l1=0.05, l2=0.1)
    z, n = [0.0] * 16, [0.0] * 16

    def weight(i):
        return 0.0 if abs(z[i]) <= 0.05 else -(z[i] - (0.05 if z[i] > 0 else -0.05)) / ((1.0 + n[i] ** 0.5) / 0.5 + 0.1)

    for _ in range(2):
        for at, x, y in rows:
            w = [weight(i) for i in at]
            p = 1 / (1 + np.exp(-sum(a * float(b) for a, b in zip(w, x))))
            for i, v, own in zip(at, x, w):
                g = (p - y) * float(v)
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5 * own
                n[i] += g * g
    np.testing.assert_allclose(got, [weight(i) for i in range(16)], rtol=1e-5, atol=1e-7)


def test_score_is_a_sparse_dot_product():
    w = np.random.default_rng(1).normal(size=1 << quality.BITS)
    m = quality.Quality(w)
    for text in ("One two two three, THREE!!", "a", "", "Wort " * 50):
        places, values = quality.features(text)
        z = float(sum(w[p] * float(v) for p, v in zip(places, values)))
        assert abs(m.score(text) - 1 / (1 + np.exp(-max(-30, min(30, z))))) < 1e-6
    memo = dict(quality._memo)
    many = " ".join(f"w{i}" for i in range(quality.MEMO + 10))  # more distinct words than are remembered
    assert 0 <= m.score(many) <= 1 and m.score("a") == quality.Quality(w).score("a") and memo
