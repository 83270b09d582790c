"""Shortest selectors against a plain search over every element."""

import random
import re

from pyspark.sql import functions as F

from pagelode.operators import dom


def tree(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 4)):
        tag = rng.choice(["div", "div", "span", "b"])
        attrs = ""
        if rng.random() < 0.25:
            attrs += f' id="{rng.choice(["a", "b", "c", "1x", "d e"])}{rng.choice(["", "", rng.randrange(99)])}"'
        if rng.random() < 0.2:
            attrs += f" {rng.choice(['data-testid', 'data-test', 'data-cy'])}='{rng.choice(['t', 'q" + chr(34) + r"w', 'back' + chr(92), ''])}'"
        out.append(f"<{tag}{attrs}>{tree(rng, depth + 1) if depth < 4 and rng.random() < 0.7 else ''}</{tag}>")
    return "".join(out)


def brute(rows):
    rows = {r.pos: r for r in rows}
    step, path = {}, {}
    for pos, r in sorted(rows.items()):
        nth = 1 + sum(o.parent_pos == r.parent_pos and o.tag == r.tag for o in rows.values() if o.pos < pos)
        step[pos] = f"{r.tag}:nth-of-type({nth})"
        path[pos] = [pos] + path.get(r.parent_pos, []) if r.tag != "html" else []
    ids = [r.attrs.get("id") for r in rows.values()]

    def own(r):
        name = r.attrs.get("id") or ""
        return "#" + name if re.fullmatch(r"[A-Za-z][\w-]*", name) and ids.count(name) == 1 else None

    def selector(r):
        if own(r):
            return own(r)
        for attr in ("data-testid", "data-test", "data-cy"):
            value = r.attrs.get(attr)
            if value and sum(o.attrs.get(attr) == value for o in rows.values()) == 1:
                return '[%s="%s"]' % (attr, value.replace("\\", "\\\\").replace('"', '\\"'))
        parts = []
        for pos in path[r.pos]:
            if own(rows[pos]):
                return ">".join([own(rows[pos]), *parts])
            parts.insert(0, step[pos])
            same = sum([step[p] for p in path[o]][:len(parts)] == parts[::-1] for o in rows)
            if same == 1 or rows[pos].tag == "body":
                break
        return ">".join(parts)
    return {p: selector(r) for p, r in rows.items() if r.tag != "html"}


def test_equals_a_plain_search(spark):
    rng = random.Random(11)
    htmls = [f"<html><head><title>x</title></head><body>{tree(rng)}</body></html>" for _ in range(12)] + [tree(rng), "<p></p>", ""]
    pages = spark.createDataFrame([(i, "https://a.com/", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    nodes = dom.dom_nodes(pages)
    got = {}
    for r in dom.unique_selectors(nodes, F.lit(True)).collect():
        got.setdefault(r.page_id, {})[r.pos] = r.selector
    by_page = {}
    for r in nodes.collect():
        by_page.setdefault(r.page_id, []).append(r)
    assert {p: brute(rows) for p, rows in by_page.items()} == got
    kinds = [s for page in got.values() for s in page.values()]
    assert sum(s.startswith("#") for s in kinds) > 10 and any("\\\\" in s for s in kinds) and any('\\"' in s for s in kinds)


def test_pages_are_walked_once(spark):
    pages = spark.createDataFrame([(1, "https://a.com/", "<ul><li>a</li><li>b</li></ul>")], "page_id long, url string, html string")
    plan = dom.unique_selectors(dom.dom_nodes(pages), F.lit(True))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
    assert dom.unique_selectors(dom.dom_nodes(pages.filter("page_id < 0")), F.lit(True)).count() == 0
