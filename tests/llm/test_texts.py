import hashlib
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from marketloom.llm import html_text as H
from marketloom.llm import license_scan as L
from marketloom.llm import queries as Q
from marketloom.llm import sketch as K
from marketloom.llm import toxicity as X
from marketloom.llm import transport_stream as T

DOCS = "doc_id long, text string, score string"
EDGES = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (3, "one", None), (None, "null id", "c"), (4, "word " * 60_000, "d"), (5, "é😀 \x00 x", "e")]


# --- transport streams ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 100, 163, 164, 165, 166, 167, 168, 169, 170, 171, 172, 180, 184, 16_383, 16_384, 16_385, 300_000])
def test_stream_round_trip(n):
    data = os.urandom(n)
    got = T.demux(T.mux(data))
    units = got["streams"][T.ES_PID]
    assert b"".join(u["data"] for u in units) == data and got["continuity_errors"] == 0
    assert [u["pts"] for u in units] == [i * T.TICKS for i in range(len(units))]
    assert [u["random_access"] for u in units] == [i % T.RAP_EVERY == 0 for i in range(len(units))]
    assert got["programs"] == {1: {"pmt_pid": T.PMT_PID, "streams": {T.ES_PID: T.STREAM_TYPE}}}


def test_lost_and_repeated_packets():
    packets = [T.mux(b"x" * 2000)[i : i + 188] for i in range(0, len(T.mux(b"x" * 2000)), 188)]
    assert T.demux(b"".join(packets[:5] + packets[6:]))["continuity_errors"] == 1
    again = T.demux(b"".join(packets[:5] + packets[4:]))
    assert again["continuity_errors"] == 0 and again["streams"][T.ES_PID][0]["data"] == b"x" * 2000
    with pytest.raises(ValueError):
        T.demux(b"y" + T.mux(b"x")[1:])


def test_media_digest(spark):
    got = T.media_digest(spark.createDataFrame(EDGES, DOCS)).collect()
    for r, (i, t, _) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)), sorted(EDGES, key=lambda e: (e[0] is None, e[0] or 0))):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert T.media_digest(spark.createDataFrame([], DOCS)).count() == 0


# --- toxicity -------------------------------------------------------------------------------------------------------------


def kinds(text, model=X.Toxicity({})):
    """The kinds of matches in a text."""
    return {name for name, v in zip(X.FEATURES[:5], model.features(text)) if v > 0}


def test_grammar():
    m = X.Toxicity({})
    plain, negated, reported, target = m.features("what an idiot"), m.features("she is not an idiot"), m.features("he said some idiot"), m.features("you are an idiot")
    assert plain[0] > 0 and negated[2] > 0 and reported[3] > 0 and target[1] > 0
    assert negated[5] < plain[5] and reported[5] < plain[5] < target[5]
    assert m.features("you, I will kill")[4] > 0
    assert m.features("I will kill you")[4] > 0
    assert m.features("not now. idiot")[0] > 0  # a clause ends a negation
    assert m.features("idiotic reidiot") == [0.0] * 7 and m.features(None) == [0.0] * 7


@pytest.mark.parametrize("text, found", [
    ("I'm going to kill you tonight", {"threat"}), ("we will hurt you", {"threat"}), ("ich werde dich umbringen", {"threat"}),
    ("I will not kill you", {"negated"}), ("he said he will kill you", {"reported"}), ('"I will kill you" it read', {"reported"}),
    ("they kill time", set()), ("you kill me with laughter", set()),
    ("never mind, you idiot", {"targeted"}), ("idiots like you", {"insult", "targeted"}), ("not an idiot, but a clown", {"negated", "insult"}),
    ("what a waste of space", {"insult"}), ("you are a waste of space", {"targeted"}), ("a waste of time", set()), ("empty space", set()),
    ("du bist ein Trottel", {"targeted"}), ("she called him a moron", {"reported"}), ("he said: you idiot", {"reported"}),
])
def test_clauses(text, found):
    assert kinds(text) == found


def test_composition_is_the_transducers_in_a_row():
    rng, machine = random.Random(2), X.grammar()
    letters = [x for x, _ in X.CLASSES] + ["O"]
    for _ in range(300):
        word = [rng.choice(letters) for _ in range(rng.randrange(1, 15))]
        state, out = machine.start, []
        for x in word:
            state, y, w = machine(state, x)
            out.append((y, w))
        tape = [(x, 1.0) for x in word]
        for step in (X.insult, X.threat, X.target, X.negation, X.reported):
            s, after = 0, []
            for x, w in tape:
                s, y, v = step(s, x)
                after.append((y, w * v))
            tape = after
        assert [y for y, _ in tape] == [y for y, _ in out] and all(abs(a - b) < 1e-12 for (_, a), (_, b) in zip(tape, out))


def test_the_filter_loses_no_match():
    rng = random.Random(6)
    m = X.Toxicity({"réeux*": 3.0, "blorg": 2.0})
    words = [w for _, ws in X.CLASSES for w in ws] + ["réeuxpa", "réeu", "blorg", "blorgs", "and", "x", "idiot's", ".", "1idiot", "é"]
    for _ in range(2000):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(5)))
        assert m.features(text) == m.matches(text.lower()) or not any(m.matches(text.lower())[:5]) and m.hit(text) is False, text


def test_a_prefix_that_clean_words_share_gives_way_to_the_word():
    rows = [("lose*", 99, 12), ("loser", 99, 0), ("stup*", 50, 0), ("stupi*", 50, 0), ("rare*", 3, 0), ("wide*", 60, 50)]
    assert set(X._stems(rows, 300, 3000)) == {"loser", "stup*"}


def test_near_copies_of_a_toxic_text_are_one_witness(spark):
    rng = random.Random(4)
    body = [f"w{i}" for i in range(100)]
    copies = [" ".join(rng.choice(["x", "y", "z"]) if rng.random() < 0.01 else w for w in body) for _ in range(80)]
    clean = [" ".join(f"c{rng.randrange(500)}" for _ in range(60)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(copies + clean)), "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 80).cast("int").alias("toxic"))
    assert X.fit_toxicity(docs, labels).stems == {}


def test_toxicity_held_out_accuracy(spark, small_dir):
    docs, labels = spark.read.parquet(f"{small_dir}/../sf0.1/documents.parquet"), spark.read.parquet(f"{small_dir}/../sf0.1/labels.parquet")
    rows = X.score_documents(docs, labels).join(labels, "doc_id").filter("held_out").select("toxic", "predicted").collect()
    hit = [r["predicted"] for r in rows if r["toxic"]]
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert sum(hit) / len(hit) > 0.9 and sum(clean) / len(clean) < 0.015


def test_toxicity_edges(spark):
    docs = spark.createDataFrame(EDGES, DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = X.score_documents(docs, none).collect()
    assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in got)
    some = spark.createDataFrame([(1, 1, None), (2, 1, 1), (2, 1, 0), (9, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert X.drop_toxic(docs, some).columns == docs.columns
    assert X.score_documents(spark.createDataFrame([], DOCS), some).count() == 0
    assert X.drop_toxic(docs.withColumn("text", F.lit("you worthless scum, you are an idiot")), none).count() == 0


# --- licenses ---------------------------------------------------------------------------------------------------------------


def test_alignment_against_dynamic_programming():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = L.patience_align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= len(L._common(a, b))
    unique = list("abcdefgh")
    assert len(L.patience_align(unique, list("axbcydefgzh"))) == len(L._common(unique, list("axbcydefgzh")))
    assert L.longest_increasing([3, 1, 2, 5, 4, 6]) in ([1, 2, 3, 5], [1, 2, 4, 5])


def test_licenses_found_and_clean_texts_left_alone(spark):
    filler = " ".join(f"w{i}" for i in range(300))
    known = [L.Template.of(n, b) for n, b in L.TEMPLATES.items()]
    for n, body in L.TEMPLATES.items():
        found = L.find_licenses(f"{filler} {body} {filler} {body} {filler}", known)
        assert [f["license"] for f in found] == [n, n], (n, found)  # each occurrence, as itself
        assert all(f["coverage"] == 1.0 for f in found) and found[0]["first_word"] == 300
        assert [f["license"] for f in L.find_licenses(f"{body} {body}", known)] == [n, n], n
        edited = re.sub(r"\bthe\b", "teh", body)  # a few words changed
        assert [f["license"] for f in L.find_licenses(edited, known)] == [n] or len(re.findall(r"\bthe\b", body)) / len(body.split()) > 0.07, n
    assert L.find_licenses(filler, known) == [] and L.find_licenses(None, known) == []
    docs = spark.createDataFrame([*EDGES, (6, L.TEMPLATES["mit"], "x")], "doc_id long, text string, license string")
    got = {r["doc_id"]: r for r in L.scan_licenses(docs).collect()}
    assert got[6]["license"] == "mit" and got[4]["license"] is None and got[1]["coverage"] == 0.0


@pytest.mark.parametrize("text, names", [
    ("Licensed under CC BY 4.0.", ["cc-by-4.0"]), ("Licensed under CC BY-NC 4.0.", ["cc-by-nc-4.0"]), ("Licensed under CC BY-NC-SA 4.0.", ["cc-by-nc-sa-4.0"]),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["cc-by-nc-4.0-statement"]),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", ["cc-by-nd-4.0-statement"]),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["cc-by-4.0-statement"]),
    ("This work is licensed under the GNU General Public License, version 2.", ["gpl-2.0"]),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["lgpl-3.0"]),
    ("This work is licensed under the GNU Affero General Public License, version 3.", ["agpl-3.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3.0"]),
    ("This work is licensed under the GNU General Public License, version 9.", []),
    ("Licensed under the Apache License, Version 1.1.", []), ("Licensed under CC BY-XX 4.0.", ["cc-by-4.0"]), ("Licensed under CC BY 5.0.", []),
])
def test_siblings_are_told_apart(text, names):
    known = [L.Template.of(n, b) for n, b in L.TEMPLATES.items()]
    assert [f["license"] for f in L.find_licenses(f"some words before it. {text} and some behind", known)] == names


def test_a_changed_text_is_not_the_whole_license():
    known = [L.Template.of(n, b) for n, b in L.TEMPLATES.items()]
    body = L.TEMPLATES["mit-text"]
    cut = body.split("THE SOFTWARE IS PROVIDED")[0] + "No promise of any sort is made by whoever wrote it, and nobody answers for what comes of it in court or elsewhere. " * 4
    assert [f["license"] for f in L.find_licenses(cut, known)] == ["mit-grant"]


def test_licenses_against_all_windows():
    """Every window of every width in place of seeds and candidates."""
    rng = random.Random(12)
    bodies = {n: L.TEMPLATES[n] for n in ("mit", "apache-2.0", "cc-by-4.0", "cc-by-nc-4.0", "gpl-3.0", "lgpl-3.0", "bsl-1.0")}
    known = [L.Template.of(n, b) for n, b in bodies.items()]
    for _ in range(40):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += [rng.choice(["the", "license", "version", "under", "x", "by", "4", "0"]) for _ in range(rng.randrange(12))]
            words += [w for w in L.words_of(rng.choice(list(bodies.values()))) if rng.random() > 0.05]
        found = []
        for t in known:
            width = int(len(t.words) / L.MIN_EXPLAINED) + 1
            spans = {(f["first_word"], f["last_word"]): f for lo in range(len(words)) for hi in range(lo + 1, min(len(words), lo + width) + 1) if (f := L.fit(words, lo, hi, t))}
            found += spans.values()
        want, got = L.settle(found), L.find_licenses(" ".join(words), known)
        assert len(got) >= 0.9 * len(want) and {(f["license"], f["first_word"]) for f in got} <= {(f["license"], f["first_word"]) for f in found}
        assert {f["license"] for f in want} == {f["license"] for f in got}, (words, want, got)


def test_repeated_license_words_in_a_long_text():
    known = [L.Template.of(n, b) for n, b in L.TEMPLATES.items()]
    text = "license software permission " * 20_000 + L.TEMPLATES["mit-text"] + " software license" * 10_000
    assert [f["license"] for f in L.find_licenses(text, known)] == ["mit-text"]


# --- sketches ---------------------------------------------------------------------------------------------------------------


def test_sketch_against_sets():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    a = rng.choices(words, k=4000)
    b = a[:2000] + rng.choices(words, k=2000)
    sets = [{" ".join(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b)]
    exact = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    s = [K.sketch(" ".join(x)) for x in (a, b)]
    assert abs(K.likeness(*s) - exact) < 0.06
    assert abs(K.containment(s[0], K.merge(*s)) - 1) < 1e-9
    assert (K.merge(*s) == K.keep(K.np.union1d(*(K.shingle_hashes(" ".join(x)) for x in (a, b))))).all()
    assert (K.from_text(K.to_text(s[0])) == s[0]).all()
    assert len(K.sketch("")) == 0 and len(K.sketch("one two")) == 1 and K.likeness(K.sketch(""), K.sketch("")) == 1.0


@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_next_documents(spark, n):
    rng = random.Random(n)
    docs = [(i * 3, "".join(rng.choice("ab cdé") for _ in range(rng.randrange(40)))) for i in range(n)]
    rng.shuffle(docs)
    got = {r["doc_id"]: r for r in K.compare_with_edit_and_next(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    docs.sort()
    for k, (i, t) in enumerate(docs):
        following = docs[(k + 1) % n][1]
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["near_next"] == K.likeness(K.sketch(t), K.sketch(following))


def test_merging_and_containment_of_very_unequal_documents(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    long = rng.choices(words, k=6000)
    docs = [(0, " ".join(long))] + [(i, " ".join(long[i * 50 : i * 50 + 9])) for i in range(1, 100)] + [(200, " ".join(long[:3000] + rng.choices(words, k=3000))), (201, "")]
    found = K.fingerprint_documents(spark.createDataFrame(docs, "doc_id long, text string"))
    whole = found.filter("doc_id = 0").select(F.col("hashes").alias("all"))
    got = {r["doc_id"]: r["share"] for r in found.crossJoin(whole).select("doc_id", K.containment_column(F.col("hashes"), F.col("complete"), F.col("all")).alias("share")).collect()}
    small = [got[i] for i in range(1, 100)]
    assert set(small) == {None, 1.0} and got[201] is None and abs(got[200] - 0.5) < 0.06  # where a sketch has nothing to tell, it says so
    merged = K.merge_sketches(found.withColumn("side", F.col("doc_id") % 2), "side").collect()
    sets = {r["doc_id"]: set(r["hashes"]) for r in found.filter("complete").collect()}
    for r in merged:
        assert r["hashes"] == sorted(set().union(*(v for i, v in sets.items() if i % 2 == r["side"])))


def test_sketch_edges(spark):
    got = K.compare_with_edit_and_next(spark.createDataFrame(EDGES, DOCS)).collect()
    assert len(got) == len(EDGES) and {r["fingerprint"] for r in got if r["doc_id"] in (1, 2)} == {""}
    assert K.compare_with_edit_and_next(spark.createDataFrame([], DOCS)).count() == 0
    assert K.fingerprint_documents(spark.createDataFrame(EDGES, DOCS)).count() == len(EDGES)


# --- pages ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain &lt;text&gt;", "plain <text>"),
    ("<body><nav>m</nav><article><h1>T &amp; t</h1><p><b>one<br>two<p>three <i>x</i>&#233;</article><footer>f</footer>", "T & t\n\none two\n\nthree xé"),
    ("<article><ul><li>a<li>b</ul><div class='comments'>no</div><aside>no</aside><table><tr><td>x<td>y</table></article>", "a\n\nb\n\nx\n\ny"),
    ("<body><div id=sidebar>no</div><div class='cookie-notice'>no</div><main><p>yes</main><form>no</form>", "yes"),
    ("<body><script>var a = '</p><article>';</script><p>a<!-- <p>no -->b", "ab"),
    ("<article>" * 3000 + "deep", "deep"),
    ('<div class="layout with-sidebar"><article><p>all of it</p></article></div>', "all of it"),
    ('<div id="content" class="no-sidebar"><article><p>all of it</p></article></div>', "all of it"),
    ('<div class="sidebar"><article><p>all of it</p></article></div>', "all of it"),
    ('<article><header class="entry-header"><h1>Title</h1></header><p class="share-price">up</p><section class="related-work"><p>earlier</p></section></article>', "Title\n\nup\n\nearlier"),
    ("<article><p>a</p><div class='ad'>no</div><div class='ad-slot'>no</div><section id='comments'>no</section></article>", "a"),
    ("<article><p>a</p><p hidden>no</p><div style='display: none'>no</div><p>b</p></article>", "a\n\nb"),
    ("<article><p title=it's>first</p><p>that's second</p></article>", "first\n\nthat's second"),
    ('<article><p title="a > b" data-x=\'"\'>x</p><a href=/y?a="b>y</a></article>', "x\n\ny"),
    ("<body><div class='site-footer'>no</div><div class='post'>the longest text of this page</div><div class='comment-list'>no</div></body>", "the longest text of this page"),
    ("<body><div class='page-header'>" + "a long text in an oddly named element " * 3 + "</div><p>b</p></body>", ("a long text in an oddly named element " * 3).strip() + "\n\nb"),
    ("<main><article class='comment'>no</article><p>yes</p></main>", "yes"),
])
def test_main_text(page, text):
    assert H.main_text(page) == text


def test_very_long_pages():
    page = "<article>" + "<p>one two three</p>" * 40_000 + "</article>"
    assert H.main_text(page).count("one two three") == 40_000
    assert H.main_text("<p a='" * 20_000) == "" and len(H.main_text("<p x=" + "y" * 2_000_000 + ">z</p>")) == 1


def test_a_notice_on_few_of_many_pages_goes_and_shared_passages_stay(spark):
    rows = [(i, "http://big.example.net/", f"<article><p>text {i}</p><p>a passage that many share</p>{'<section><p>Our offer ends soon</p></section>' if i % 40 == 0 else ''}</article>") for i in range(400)]
    got = {r["page_id"]: r["text"] for r in H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text {i}\n\na passage that many share" for i in range(400)}


def test_site_templates_are_deleted(spark):
    rows = [(i, f"http://a.example.net/{i}", f"<body><div><p>Welcome to our site</p></div><section><p>text {i}</p><p>more {i}</p></section></body>") for i in range(20)]
    rows += [(100 + i, f"http://b{i}.example.net/", "<body><div><p>Welcome to our site</p></div></body>") for i in range(3)]
    rows += [(200 + i, "http://c.example.net/", "<body><article><p>a copied article</p></article></body>") for i in range(20)]
    got = {r["page_id"]: r["text"] for r in H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x"))).collect()}
    assert got[3] == "text 3\n\nmore 3" and got[100] == "Welcome to our site" and got[200] == "a copied article"
    none = spark.createDataFrame([(1, None, None), (1, None, None)], "page_id long, url string, html string")
    assert [r["text"] for r in H.extract_pages(none).collect()] == ["", ""]
    assert H.extract_pages(none.limit(0)).count() == 0


def test_pages_against_their_markup(spark, small_dir):
    import html
    import re

    for page, got in zip(spark.read.parquet(f"{small_dir}/pages.parquet").orderBy("page_id").collect(), Q.op7_html_text(spark, small_dir).orderBy("page_id").collect()):
        body = page["html"].split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert got["text"] == "\n\n".join(b for b in blocks if b)
