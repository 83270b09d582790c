"""capture quality and soft 404s."""

import random

from pyspark.sql import functions as F

from pagelode.functions import graph
from pagelode.operators import dom, quality
from pagelode.session import stage

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(50)}" for _ in range(n))


def page(text, title="Title", tag="main"):
    return f"<html><head><title>{title}</title></head><body><{tag}>{'<p></p>' * 60}<p>{text}</p></{tag}></body></html>"


def test_scores(spark):
    rows = [("https://a.com/1", page(prose(1))), ("https://a.com/2", page(prose(2), tag="div")), ("https://a.com/3", page(prose(3), "404 | A")),
            ("https://a.com/4", "<html><body></body></html>"), ("https://a.com/5", None), (None, page(prose(4)))]
    pages = frame(spark, rows)
    got = {r.page_id: (r.score, r.findings) for r in quality.capture_quality(pages, dom.dom_nodes(pages)).collect()}
    assert got[0] == got[5] == (1.0, "")
    assert got[1] == (0.9, "no_landmark") and got[2] == (0.5, "not_found")
    assert got[3] == got[4] == (0.0, "blank, thin, no_landmark")
    copies = frame(spark, [(f"https://b.com/{i}", page("Sorry " + prose(5))) for i in range(4)] + rows)
    found = quality.capture_quality(copies, dom.dom_nodes(copies)).filter("copies > 1 and page_id < 4").collect()
    assert [(r.copies, r.host_pages, r.findings, r.score) for r in found] == [(4, 4, "copy", 0.7)] * 4


def test_texts_of_pages_are_made_once(spark):
    pages = frame(spark, [("https://a.com/1", page(prose(1))), (None, "<p> a \u00a0 b</p>")])
    scored = quality.capture_quality(pages, dom.dom_nodes(pages))
    assert "regexp_replace" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert {r.page_id: r.chars for r in scored.collect()}[1] == 2


def test_planted_soft_404s_are_found_and_real_pages_are_not(spark):
    rows = [(f"https://a.com/p{i}", page(prose(i))) for i in range(60)]
    # One stock answer that names what was asked for, so that no two texts are equal; and the same texts once on other hosts.
    stock = [(f"https://a.com/x{i}", page(f"{prose(999, 150)} request {i} items")) for i in range(20)]
    rows += stock + [(f"https://h{i}.com/x", page(f"{prose(999, 150)} request {i} items")) for i in range(5)]
    rows += [("https://a.com/q", page("Page not found")), ("https://c.com/q", None), ("https://c.com/r", None)]
    got = {r.url: r for r in quality.soft_404(frame(spark, rows)).collect()}
    found = {u for u, r in got.items() if r.soft_404}
    assert found >= {u for u, _ in stock} and "https://a.com/q" in found
    assert not found & {u for u, _ in rows[:60] + rows[80:85]}
    assert got["https://a.com/x0"].near == 20 and got["https://a.com/x0"].host_pages == 81
    assert quality.soft_404(frame(spark, rows).filter("page_id < 0")).count() == 0


def test_no_near_link_is_missed_and_unlike_texts_take_no_rounds(spark, monkeypatch):
    rng = random.Random(7)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    # Many unlike fingerprints with equal low bits, and chains of near ones.
    values = {rng.getrandbits(48) << 16 for _ in range(300)}
    for value in sorted(values)[:40]:
        for _ in range(6):
            value ^= sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 5))})
            values.add(value)
    rows = [(i, "ab"[i % 2], signed(v)) for i, v in enumerate(sorted(values))]
    want = {(x, y) for x, h, p in rows for y, g, q in rows if x < y and h == g and ((p ^ q) & ((1 << 64) - 1)).bit_count() <= 3}
    got = [(r.a, r.b) for r in quality.near_links(spark.createDataFrame(rows, "id long, host string, print long")).collect()]
    assert set(got) == want and len(got) == len(want) > 20
    # Texts that are unlike each other once took a round each.
    tables = []
    monkeypatch.setattr(graph, "stage", lambda df, name: tables.append(name) or stage(df, name))
    quality.soft_404(frame(spark, [(f"https://a.com/{i}", page(f"only word{i}")) for i in range(400)]))
    assert len(tables) < 12


def test_fingerprints_follow_the_words(spark):
    texts = spark.createDataFrame([(0, ""), (1, "one two"), (2, "One, TWO!"), (3, "two one")], "id long, text string")
    prints = {r.id: r.print for r in quality.fingerprints(texts).collect()}
    assert prints[0] == 0 and prints[1] == prints[2] != prints[3]
    # The same votes, counted by hand.
    words = spark.createDataFrame([("one",), ("two",), ("one two",)], "w string").select(F.xxhash64("w").alias("h")).collect()
    want = sum(1 << i for i in range(64) if sum((r.h >> i & 1) * 2 - 1 for r in words) > 0)
    assert prints[1] == (want - (1 << 64) if want >> 63 else want)
