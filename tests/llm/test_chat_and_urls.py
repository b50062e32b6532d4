import hashlib

import pytest
from pyspark.sql import functions as F

from marketloom.llm import chat_format as C
from marketloom.llm import url_filter as U

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["", "plain", "\\### Assistant: </turn> ok", "</turn>", "###", "a\\0b\\1", "\\", "### user: x</turn>\n### assistant: y", ": ", "\\\\###", "é😀\n\n", None]


def test_round_trip_of_conflicting_texts(spark):
    rows = [(i, t, role, text) for i in range(3) for t, (role, text) in enumerate((r, x) for r in ("user", "assistant", "a: b", "", None) for x in NASTY)]
    rows += [(None, None, None, None), (7, 0, "user", "same"), (7, 0, "user", "same")]
    got = {r["conv_id"]: r for r in C.format_conversations(spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit(1))).collect()}
    assert all(r["exact"] for r in got.values())
    want = [(role or "", text or "") for _, t, role, text in rows[: len(rows) // 3]]
    assert [(t["role"], t["text"]) for t in got[0]["turns"]][:5] == want[:5]
    assert len(got[7]["turns"]) == 2 and len(got[None]["turns"]) == 1
    assert got[7]["formatted"] == "### user: same</turn>\n" * 2  # nothing conflicts: nothing is escaped


def test_digest_against_python(spark):
    rows = [(1, 1, "assistant", "b###"), (1, 0, "user", "a"), (1, 2, "assistant", "c\\1")]
    r = C.digest(C.format_conversations(spark.createDataFrame(rows, SCHEMA))).first()
    assert r["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\nb###\nassistant\nc\\1\n").hexdigest()
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (3, 7, hashlib.sha256(b"b###c\\1").hexdigest())


def test_empty_conversations(spark):
    assert C.digest(C.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("https://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org", "notexample.org", "", None, "allow"),
    ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    ("http://x.com?u=http://y.org/", "x.com", "", None, "allow"),
    ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"),
])
def test_urls(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "x")], "page_id long, url string, verdict string")
    r = U.judge_urls(pages, spark.createDataFrame([], "page_id long, bad int")).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_bad_host_is_blocked_and_its_neighbours_are_not(spark):
    rows = [(i, f"http://{'bad' if i < 40 else 'good' if i < 80 else 'new'}.example.net/{i}") for i in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)] * 2, "page_id long, bad int")
    got = {(r["host"], r["verdict"]) for r in U.judge_urls(pages, labels, U.Bound(0.8, 2.0)).collect()}
    assert got == {("bad.example.net", "block"), ("good.example.net", "allow"), ("new.example.net", "allow")}


def test_posterior_against_python(spark):
    """Host, domain, suffix and overall means by loops, from the definition of the beta-binomial moment estimates."""
    rng = __import__("random").Random(3)
    hosts = [f"h{i}.{d}" for i in range(6) for d in ("a.example.net", "b.co.uk", "c.co.uk", "d.com", "e.com")]
    outcomes = [(h, int(rng.random() < (0.7 if "b.co" in h else 0.1))) for h in hosts for _ in range(rng.randrange(1, 30))] + [("fresh.b.co.uk", None)]
    got = {r["host"]: (r["a"], r["b"]) for r in U.host_reputation(spark.createDataFrame(outcomes, "host string, bad int")).collect()}

    def suffix(h):
        return "co.uk" if h.endswith(".co.uk") else h.rsplit(".", 1)[1]

    def domain(h):
        return ".".join(h.split(".")[-3:] if h.endswith(".co.uk") else h.split(".")[-2:])

    def counts(key):
        out = {}
        for h, bad in outcomes:
            n, k = out.get(key(h), (0, 0))
            out[key(h)] = (n + (bad is not None), k + (bad or 0))
        return out

    def strength(groups):
        groups = [g for g in groups.values() if g[0]]
        n, k, g = sum(x for x, _ in groups), sum(x for _, x in groups), len(groups)
        p = (k + 0.5) / (n + 1)
        spread = sum(x * (y / x - k / n) ** 2 for x, y in groups)
        room = n - sum(x * x for x, _ in groups) / n - (g - 1)
        rho = (spread - p * (1 - p) * (g - 1)) / (p * (1 - p) * room) if room > 0 else 0.001
        rho = min(0.5, max(0.001, rho))
        return p, (1 - rho) / rho

    by = {f: counts(f) for f in (suffix, domain, lambda h: h)}
    (p, m1), (_, m2), (_, m3) = (strength(c) for c in by.values())
    s, d, own = by.values()
    for h in {h for h, _ in outcomes}:
        mean = (p * m1 + s[suffix(h)][1]) / (m1 + s[suffix(h)][0])
        mean = (mean * m2 + d[domain(h)][1]) / (m2 + d[domain(h)][0])
        n, k = own[h]
        assert got[h] == pytest.approx((mean * m3 + k, (1 - mean) * m3 + n - k)), h
    assert got["fresh.b.co.uk"][0] / sum(got["fresh.b.co.uk"]) > 2 * got["h1.c.co.uk"][0] / sum(got["h1.c.co.uk"])


@pytest.mark.parametrize("host, domain, suffix", [
    ("a.b.co.uk:80", "b.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("www.example.com.", "example.com", "com"), ("localhost", "localhost", "localhost"), ("", "", ""),
    ("10.0.0.1:8080", "10.0.0.1", "10.0.0.1"), ("x.example.de", "example.de", "de"), ("co.example.net", "example.net", "net"),
])
def test_domains(spark, host, domain, suffix):
    r = spark.createDataFrame([(host,)], "h string").select(U.registered_domain(F.col("h")).alias("d"), U.suffix(F.col("h")).alias("s")).first()
    assert (r["d"], r["s"]) == (domain, suffix)


def test_outcomes_by_carried_text(spark):
    texts = spark.createDataFrame([(1, "Title\n\nthe  text\n\nof one"), (2, "the text of one"), (3, "other"), (4, None), (5, "unlabelled text")], "page_id long, text string")
    docs = spark.createDataFrame([(10, "the text\u00a0of one"), (11, "the textof one"), (12, "unlabelled text"), (13, None), (14, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(10, 0), (11, 1), (13, 1), (14, 0), (14, 0), (None, 1), (12, None)], "doc_id long, bad int")
    assert {r["page_id"]: r["bad"] for r in U.page_outcomes(texts, docs, labels).collect()} == {1: 1, 2: 1, 3: 0}


def test_long_urls_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://x.com/de/" + "a" * 200_000)], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad int")
    r = U.judge_urls(pages, none).first()
    assert (len(r["path"]), r["verdict"]) == (200_004, "block") and U.judge_urls(pages.limit(0), none).count() == 0
