"""Lost packets, licenses beside other sentences, templates found by recurrence."""

import os

import pytest

from marketloom.llm import html_text as H
from marketloom.llm import license_scan as L
from marketloom.llm import queries
from marketloom.llm import transport_stream as M


def packets(stream):
    return [stream[i : i + M.PACKET] for i in range(0, len(stream), M.PACKET)]


def payload_of(stream):
    found = M.demux(stream)
    return b"".join(u["data"] for u in found["streams"][M.ES_PID]), found


def test_every_loss_is_an_error():
    data = os.urandom(100_000)
    every = packets(M.mux(data))
    own = [i for i, p in enumerate(every) if (p[1] & 0x1F) << 8 | p[2] == M.ES_PID]
    for n in range(1, 49):
        for first in (3, 80, 88, 95, 200):
            lost = set(own[first : first + n])
            _, found = payload_of(b"".join(p for i, p in enumerate(every) if i not in lost))
            assert found["continuity_errors"] + found["length_errors"] >= 1, (n, first)
    whole, found = payload_of(b"".join(every))
    assert whole == data and found["continuity_errors"] == found["length_errors"] == 0


def test_a_repeated_packet_is_dropped_only_if_it_is_the_same():
    data = os.urandom(40_000)
    every = packets(M.mux(data))
    again = every[:20] + [every[19]] + every[20:]
    whole, found = payload_of(b"".join(again))
    assert whole == data and found["continuity_errors"] == 0


@pytest.mark.parametrize("n", [0, 1, 64, 160, 165, 166, 167, 168, 169, 170, 176, 184, 16_384, 16_384 * 9 + 5])
def test_round_trip_with_clock(n):
    data = os.urandom(n)
    whole, found = payload_of(M.mux(data))
    units = max(1, -(-n // M.UNIT))
    assert whole == data and found["length_errors"] == 0
    assert found["clocks"] == [i * M.TICKS for i in range(0, units, M.RAP_EVERY)] == [u["pts"] for u in found["streams"][M.ES_PID] if u["random_access"]]


def test_media_columns(spark):
    docs = spark.createDataFrame([(1, "a" * 200_000, 5), (2, None, 6)], "doc_id long, text string, feature int")
    rows = {r["doc_id"]: r for r in M.media_digest(docs).collect()}
    assert rows[1]["timestamps"] == [i * M.TICKS for i in range(13)] and rows[1]["random_access"] == rows[1]["clocks"] == [0, 8 * M.TICKS]
    assert rows[2]["timestamps"] == [0] and rows[2]["n_bytes"] == 0


KNOWN = [L.Template.of(n, t) for n, t in L.TEMPLATES.items()]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Licensed under CC BY 4.0. Zero cost to you.", "cc-by-4.0"),
        ("This library. Released under the MIT License.", "mit"),
        ("Released under the MIT License. Library users are welcome.", "mit"),
        ("Released under the MIT License Zero", None),
        ("Licensed under CC BY 4.0 NC", None),
        ("Licensed under CC BY 4.0-NC", None),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
        ("Our library is released under the MIT License, lesser known.", "mit"),
        (f"Preface. {L._APACHE_BODY} More.", "apache-2.0-body"),
        (f"x {L._MPL_BODY}", "mpl-2.0-body"),
        (L._GNU_BODY.format("License is"), "gpl-2.0-body"),
        (L._GNU_BODY.format("Licenses are"), "lgpl-2.1-body"),
        (L._GPL3_BODY, "gpl-3.0-body"),
    ],
)
def test_neighbouring_words(text, want):
    found = L.find_licenses(text, KNOWN)
    assert [f["license"] for f in found] == ([want] if want else []) and all(f["coverage"] == 1.0 for f in found)


def test_license_scan_of_nothing(spark):
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_recurrence_deletes_what_no_list_names(spark):
    """Without the article tag, the frame of a page is only known by its recurring."""
    page = "<html><body><div class='x1'>Daily Courier of all news</div><div class='main-col'><h1>T{0}</h1><p>Body {0} text goes on here.</p></div><div class='q'>Read also our letters</div></body></html>"
    rows = [(i, f"http://a.org/{i}", page.format(i)) for i in range(6)] + [(10, "http://b.org/1", page.format(77))]
    got = {r["page_id"]: r["text"] for r in H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"T{i}\n\nBody {i} text goes on here." for i in range(6))
    assert got[10].startswith("Daily Courier of all news") and got[10].endswith("Read also our letters")
    assert H.main_text(page.format(0)) != got[0]  # the method changes the text


def test_frames_of_the_supplied_hosts_recur(spark, small_dir):
    """Recurrence alone, without the lists, finds the menus, adverts and footers of hosts with enough pages."""
    pages = spark.read.parquet(f"{small_dir.replace('sf0.01', 'sf0.1')}/pages.parquet")
    templates = {(r["host"], r["key"]): set(r["templates"]) for r in H.site_templates(pages).collect()}
    assert templates
    rows = pages.select("page_id", H.url_host(pages["url"]).alias("host"), H.page_key(pages["html"]).alias("key"), "html").collect()
    changed = [r for r in rows if (r["host"], r["key"]) in templates]
    assert len(changed) >= 200
    tags = set()
    for r in changed[:300]:
        own, nodes = templates[r["host"], r["key"]], H.parse(r["html"])
        hashes = H.subtree_hashes(r["html"], nodes)
        frame = [e for i, e in enumerate(nodes) if hashes.get(i) in own]
        assert frame and all(e.tag not in ("article", "p", "h1") or not e.in_article for e in frame)
        tags |= {e.tag for e in frame}
        plain, less = H.main_text(r["html"], lists=False, nodes=nodes), H.main_text(r["html"], own, lists=False)
        assert len(less) <= len(plain)
    assert {"nav", "div", "footer"} <= tags


@pytest.mark.parametrize("tag", ['div class="cookie-banner"', 'div class="notice"', 'div class="alert"', 'div class="banner"', 'div class="share-buttons"', 'div class="social-links"', 'div class="related-posts"', 'ul class="menu"', 'p class="ad"'])
def test_notices_inside_articles_go(tag):
    name = tag.split()[0]
    inner = "<li>zap</li>" if name == "ul" else "zap"
    assert H.main_text(f"<html><body><article><h1>T</h1><p>one</p><{tag}>{inner}</{name}><p>two</p></article></body></html>") == "T\n\none\n\ntwo"


@pytest.mark.parametrize("tag", ['div class="note"', 'p class="lead"', 'div class="alert-system-overview"', 'ul class="steps"', 'section class="related-work"', 'p class="social"', 'h2 class="banner"'])
def test_text_of_articles_stays(tag):
    name = tag.split()[0]
    inner = "<li>zap</li>" if name == "ul" else "zap"
    assert "zap" in H.main_text(f"<html><body><article><p>one</p><{tag}>{inner}</{name}><p>two</p></article></body></html>")


def test_op7_registered():
    assert "op7_html_text" in queries.QUERIES
