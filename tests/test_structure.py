"""templates and components over many pages."""

import random

import pytest

from pagelode.functions.graph import components
from pagelode.operators import components as K
from pagelode.operators import dom
from pagelode.operators import templates as T


def pages(spark, htmls, first=0):
    return spark.createDataFrame([(first + i, f"https://a.example.com/{i}", h) for i, h in enumerate(htmls)],
                                 "page_id long, url string, html string")


def elements(spark, htmls):
    return dom.dom_nodes(pages(spark, htmls), with_text=False)


def card(text, kind="card"):
    return f'<div class="{kind} b"><h3>{text}</h3><p><a href="/{text}">{text}</a></p></div>'


def test_components_across_pages(spark):
    rows = [f"<html><body><main>{''.join(card(i * 10 + k) for k in range(i + 1))}</main><ul><li>x</li><li>y</li></ul></body></html>"
            for i in range(4)]
    rows.append(f"<html><body><aside>{card('z')}{card('q', 'card dark')}</aside></body></html>")
    got = {r.signature: r for r in K.component_inventory(elements(spark, rows)).collect()}
    plain = got["div||b.card"]
    assert (plain.size, plain.pages, plain.instances, plain.page_id, plain.variants) == (4, 5, 11, 0, 1)
    # Whole pages recur as one form, whatever the length of their lists; what only occurs inside it has no row of its own.
    assert (got["html||"].pages, got["html||"].instances) == (4, 4)
    assert not {"main||", "h3||", "p||", "ul||", "body||"} & set(got)


def test_children_order_and_repeats_do_not_matter(spark):
    rows = ["<div><b></b><i></i></div>", "<div><i></i><b></b><i></i></div>", "<div><b><i></i></b></div>"]
    hashes = {r.page_id: r.hash for r in K.subtree_hashes(elements(spark, rows)).filter("pos = 0").collect()}
    assert hashes[0] == hashes[1] != hashes[2]


def test_a_component_on_most_pages_and_empty_tables(spark):
    rows = [f"<html><body><p>{i}</p>{'<hr>' * (i % 7)}<nav><a>1</a><a>2</a><b></b></nav></body></html>" for i in range(300)]
    got = {r.signature: r.pages for r in K.component_inventory(elements(spark, rows)).collect()}
    assert got["nav||"] == 300
    none = elements(spark, rows).filter("page_id < 0")
    assert K.component_inventory(none).count() == K.component_pages(none, K.component_inventory(none)).count() == 0


def brute(sets, percent=80):
    label = {k: k for k in sets}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {k: root(k) for k in sets}


def planted(seed, families=12, members=9):
    rng = random.Random(seed)
    out = {}
    for f in range(families):
        base = {f"t{rng.randrange(400)}" for _ in range(40)}
        for m in range(members):
            changed = set(base)
            for _ in range(rng.randrange(6)):
                changed.discard(rng.choice(sorted(changed)))
                changed.add(f"n{rng.randrange(10_000)}")
            out[f * 100 + m] = changed
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_templates_equal_brute_force(spark, seed):
    sets = planted(seed)
    rows = spark.createDataFrame([(k, f"u{k}", sorted(v)) for k, v in sets.items()], "page_id long, url string, shingles array<string>")
    got = {r.page_id: r.template_id for r in T.template_clusters(rows).collect()}
    want = brute(sets)
    linked = [(a, b) for a in want for b in want if a < b and want[a] == want[b]]
    found = [got[a] == got[b] for a, b in linked]
    assert len(linked) > 100 and sum(found) >= 0.9 * len(found)
    # Links are verified, so nothing is joined that brute force keeps apart.
    assert all(want[a] == want[b] for a in got for b in got if a < b and got[a] == got[b])


def test_one_template_on_all_pages_makes_no_pairs(spark):
    rows = [f"<html><body><main><h1>{i}</h1><ul>{'<li><a>x</a></li>' * (i % 5 + 1)}</ul></main></body></html>" for i in range(200)]
    rows += ["<html><body><table><tr><td><form><input><select><option></select></form></td></tr></table></body></html>"] * 3
    clusters = T.template_clusters(T.skeletons(elements(spark, rows)))
    got = sorted((r.template_id, r.pages, r.url) for r in T.templates(clusters).collect())
    assert got == [(0, 200, "https://a.example.com/0"), (200, 3, "https://a.example.com/200")]
    assert T.template_clusters(T.skeletons(elements(spark, rows).filter("page_id < 0"))).count() == 0


def test_graph_components(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(200, 300 + i) for i in range(50)]
    ids = list(range(61)) + [200] + list(range(300, 350)) + [999]
    got = {r.id: r.label for r in components(spark.createDataFrame([(i,) for i in ids], "id long"),
                                             spark.createDataFrame(chain + star + [(5, 5)], "a long, b long")).collect()}
    assert got == {i: 0 if i < 61 else 999 if i == 999 else 200 for i in ids}


def test_forms_of_whole_pages_equal_those_of_element_rows(spark):
    rng = random.Random(3)
    tags = ["div", "p", "li", "ul", "b", "br", "nav"]
    some = lambda: rng.choice(["", ' class="b a"', ' role="list" class=" c a "', " class"])
    rows = ["".join(f"<{rng.choice(tags)}{some()}>" if rng.random() < 0.6 else f"</{rng.choice(tags)}>" for _ in range(40)) for _ in range(60)]
    given = pages(spark, [*rows, "", None]).unionByName(spark.createDataFrame([(None, "u", "<p><b>")], "page_id long, url string, html string"))
    direct, by_rows = K.page_forms(given), K.forms_per_page(dom.dom_nodes(given, with_text=False))
    assert sorted(map(str, direct.select(by_rows.columns).collect())) == sorted(map(str, by_rows.collect()))


def test_component_queries_shuffle_no_elements(spark, tmp_path):
    from pagelode.plans import structure
    plan = structure.QUERIES["f04_components"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan
