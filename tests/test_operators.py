"""Small hand-made tables per operator, against values worked out by hand or by a plain loop."""

import json
import random

from pyspark.sql import functions as F

from pagelode.operators import calls as C
from pagelode.operators import capture, dom, json_tables, links, streams_batch, trees, verify
from pagelode.operators.entities import entity_fields, document_records, relation_edges
from pagelode.sources.readers import read_bundle, read_har, read_trees


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_templates(spark):
    paths = ["/api/models", "/api/users", "/u/1", "/users/1/users/2", "/x/abcdefabcdef", "/s/word1", "/s/word2", "/t/word1", "/",
             "/k/aaaaaaaaaaaaaaaaaaaa", "/k/bbbbbbbbbbbbbbbbbbbb", "/m/list", "/m/v2beta"]
    df = spark.createDataFrame([("h", p) for p in paths], "host string, pathname string")
    got = dict(rows(C.path_templates(df), "pathname", "template"))
    assert got == {
        "/api/models": "/api/models", "/api/users": "/api/users", "/u/1": "/u/{u}", "/users/1/users/2": "/users/{user}/users/{user2}",
        "/x/abcdefabcdef": "/x/{x}", "/s/word1": "/s/{s}", "/s/word2": "/s/{s}", "/t/word1": "/t/word1", "/": "/",
        "/k/aaaaaaaaaaaaaaaaaaaa": "/k/{k}", "/k/bbbbbbbbbbbbbbbbbbbb": "/k/{k}", "/m/list": "/m/list", "/m/v2beta": "/m/{m}"}


def test_schema_merge(spark):
    docs = [("e", '{"a":1,"b":null,"l":[]}'), ("e", '{"a":1.5,"b":{"c":"x"},"l":[1]}'), ("e", '{"a":"t","l":[{"k":true}]}')]
    for order in (docs, docs[::-1]):
        df = spark.createDataFrame(order, "endpoint string, json string")
        got = {r.shape: (r.types, r.required) for r in json_tables.merge_schemas(df, ["endpoint"]).collect()}
        assert got["$.a"] == ("number|string", True) and got["$.b"] == ("null|object", False)
        assert got["$.l"] == ("array", True) and got["$.l[]"] == ("integer|object", False) and got["$.b.c"] == ("string", True)


def test_deep_redaction(spark):
    raw = {"sessionId": {"x": 1}, "a": [[{"apiKey": "k", "v": "eyJhbGciOiJI.abcdef.ghijkl"}]], "e": {}}
    df = spark.createDataFrame([(1, json.dumps(raw))], "id int, json string")
    assert rows(json_tables.redacted_leaves(df, ["id"], value_shapes=True), "path", "value") == [
        ("$.a[0][0].apiKey", "[REDACTED]"), ("$.a[0][0].v", "[REDACTED]"), ("$.sessionId", "[REDACTED]")]
    out = json.loads(df.select(json_tables.redact_json(F.col("json"))).first()[0])
    assert out == {"sessionId": "[REDACTED]", "a": [[{"apiKey": "[REDACTED]", "v": "[REDACTED]"}]], "e": {}}


def test_canonical_json(spark):
    df = spark.createDataFrame([('{"b":[{"z":1,"a":2}],"a":"x"}',), ("nope",)], "t string")
    assert [r[0] for r in df.select(json_tables.canonical_json(F.col("t"))).collect()] == ['{"a":"x","b":[{"a":2,"z":1}]}', None]


def brute_route(ask, routes):
    best = None
    for seq, (op, body, sig) in enumerate(routes):
        score = 1 + (100 if op and op == ask[0] else 0) + (50 if body and body == ask[1] else 0)
        if sig:
            score += 25 if sig == ask[2] else 5 if ask[2] and sig in ask[2] else 0
        elif not ask[2]:
            score += 2
        if best is None or score > best[0]:
            best = (score, seq)
    return best


def test_best_route_equals_scan(spark):
    rng = random.Random(3)
    pick = lambda xs: rng.choice(xs)
    routes = [(pick([None, "A", "B"]), pick(["", "h1", "h2"]), pick(["", "p=1", "p=1&q=2", "q=2", "p=11"])) for _ in range(40)]
    asks = [(pick([None, "A", "C"]), pick(["", "h1", "h3"]), pick(["", "p=1", "p=11", "p=1&q=2&r=3", "q=2", "z=9"])) for _ in range(60)]
    r = spark.createDataFrame([("GET", "/a/{id}", i, *x) for i, x in enumerate(routes)],
                              "method string, template string, route_seq long, op string, body_hash string, query_sig string")
    a = spark.createDataFrame([(i, "GET", "/a/7", *x) for i, x in enumerate(asks)],
                              "request_id long, method string, pathname string, op string, body_hash string, query_sig string")
    got = {x.request_id: (x.score, x.route_seq) for x in C.best_routes(a, r).collect()}
    assert got == {i: brute_route(x, routes) for i, x in enumerate(asks)}


def test_state_fold(spark):
    log = [("r", "1", 1, "create", '{"a":1}'), ("r", "1", 2, "merge", '{"b":2}'), ("r", "1", 3, "delete", None), ("r", "1", 4, "merge", '{"c":3}'),
           ("r", "2", 1, "create", '{"a":1}'), ("r", "2", 2, "replace", '{"z":0}'), ("r", "2", 3, "merge", '{"a":9}'), ("r", "2", 4, "replace", '"x"'),
           ("r", "3", 1, "create", '{"a":1}'), ("r", "3", 2, "create", '{"id":"own"}'), ("r", "4", 1, "create", "{}"), ("r", "4", 2, "delete", None)]
    df = spark.createDataFrame(log, "resource string, id string, seq long, op string, body string")
    assert rows(C.fold_state(df), "id", "field", "value") == [
        ("1", "c", "3"), ("2", "a", "9"), ("2", "z", "0"), ("3", "id", '"own"')]


def test_politeness_equals_loop(spark):
    rng = random.Random(5)
    for delay in (0, 700):
        arrivals = [(rng.choice("ab"), i, rng.randrange(20000)) for i in range(200)]
        df = spark.createDataFrame(arrivals, "host string, seq long, arrival_ms long")
        want, last = {}, {}
        for host, seq, at in sorted(arrivals, key=lambda x: (x[2], x[1])):
            last[host] = max(at, last[host] + delay) if host in last else at
            want[seq] = last[host]
        got = {r.seq: r.slot_ms for r in capture.politeness_schedule(df, delay, 3000).collect()}
        assert got == want


def serial_seeds(edges, seeds, k):
    queued, out = {s for s, _ in seeds}, []
    for s, cat in seeds:
        added = 0
        for dst in edges.get(s, []):
            if added >= k:
                break
            if dst in queued:
                continue
            queued.add(dst)
            out.append((dst, cat))
            added += 1
    return sorted(out)


def test_expand_seeds_equals_serial(spark):
    rng = random.Random(11)
    edges = {f"s{i}": [f"n{rng.randrange(25)}" for _ in range(8)] for i in range(8)}
    seeds = [(f"s{i}", f"c{i % 3}") for i in range(8)]
    e = spark.createDataFrame([(s, d, p) for s, ds in edges.items() for p, d in enumerate(ds)], "src string, dst string, pos int")
    s = spark.createDataFrame([(n, i, c) for i, (n, c) in enumerate(seeds)], "node string, seq long, category string")
    assert rows(links.expand_seeds(e, s, 3, 1), "node", "category") == serial_seeds(edges, seeds, 3)


def test_breadth_first(spark):
    e = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("b", "d", 0), ("c", "d", 0), ("d", "a", 0), ("d", "e", 1)], "src string, dst string, pos int")
    s = spark.createDataFrame([("a", 0)], "node string, seq long")
    assert rows(links.breadth_first(e, s, 2), "node", "depth") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert rows(links.breadth_first(e, s, 2, 2), "node") == [("a",), ("b",)]


def test_stylesheet_budget(spark):
    sizes = [50, 60, 30, 25, 10, 5, 1]
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "seq long, css string")
    used, want = 0, []
    for i, n in enumerate(sizes):
        if used + n <= 100:
            used, want = used + n, want + [(i,)]
    assert rows(streams_batch.stylesheet_budget(df, 100), "seq") == want


HTML = ('<html><body class=x><nav><ul><li><a href="/q">one</a> tail<li role="menuitem"><b>two</ul></nav><p>hi<b>bo<br>ld<p>next</p></zz><img src=q />'
        '<!-- <p>no --><script>var t="</p>"</script><div DATA-x="1 2" disabled title=\'q\'>t&amp;x</div></body>')


def test_dom_walk(spark):
    df = spark.createDataFrame([(1, "http://a.b/", HTML)], "page_id long, url string, html string")
    got = {r.pos: r for r in dom.dom_nodes(df).collect()}
    assert [(r.tag, r.depth, r.parent_pos, r.end_pos) for _, r in sorted(got.items())] == [
        ("html", 0, None, 15), ("body", 1, 0, 15), ("nav", 2, 1, 8), ("ul", 3, 2, 8), ("li", 4, 3, 6), ("a", 5, 4, 6), ("li", 4, 3, 8), ("b", 5, 6, 8),
        ("p", 2, 1, 11), ("b", 3, 8, 11), ("br", 4, 9, 11), ("p", 2, 1, 12), ("img", 2, 1, 13), ("script", 2, 1, 14), ("div", 2, 1, 15)]
    assert got[5].text == "one" and got[4].text == "one tail" and got[10].text == "" and got[14].text == "t&x"
    assert got[14].attrs == {"data-x": "1 2", "disabled": "", "title": "q"} and got[5].landmark == "nav"


def test_dom_cap(spark):
    df = spark.createDataFrame([(1, "http://a.b/", "<i>a</i>" * 10)], "page_id long, url string, html string")
    assert dom.dom_nodes(df, max_elements=4).count() == 4


def test_tree_scores(spark):
    nodes = [(1, i, "li", "x", 0) for i in range(3)] + [(2, 0, "li", "x", 0), (2, 1, "a", "y", 1)]
    df = spark.createDataFrame(nodes, "tree_id long, pos int, role string, name string, depth int")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 1), (8, 9), (1, 9)], "expected_id long, actual_id long")
    assert rows(trees.tree_scores(df, pairs), "expected_id", "actual_id", "score") == [
        (1, 1, 1.0), (1, 2, 0.4), (1, 9, 0.0), (2, 1, 0.4), (8, 9, 1.0)]
    assert rows(trees.tree_surplus(df, pairs).filter("expected_id = 1 and actual_id = 2"), "side", "pos", "role") == [
        ("added", 1, "a"), ("removed", 0, "li"), ("removed", 1, "li")]


def test_fixture_prefix(spark):
    fx = spark.createDataFrame([("f1", "/abc"), ("f2", "/zzz")], "file string, path string")
    routes = spark.createDataFrame([("/",), ("/a",), ("/ab",)], "route string")
    assert sorted((r.file, r.route) for r in verify.attach_fixtures(fx, routes).collect()) == [("f1", "/ab"), ("f2", None)]


def test_entities(spark):
    docs = [("/api/models", 1, "u1", '{"items":[{"name":"n","author":""},{"x":1,"owner":"o"}]}'), ("/api/models/m", 2, "u2", '{"id":"own/m","author":{"login":"z","n":1},"tags":["a"],"deep":{"x":1}}')]
    rec = document_records(spark.createDataFrame(docs, "path string, seq long, url string, json string"))
    assert rows(rec, "type", "id") == [("model", "model-1"), ("model", "n"), ("model", "own/m")]
    assert rows(relation_edges(rec), "src", "dst", "rel") == [
        ("model/model-1", "user/o", "author"), ("model/own/m", "user/own", "author"), ("model/own/m", "user/z", "author")]
    fields = {(r.id, r.field): r.value for r in entity_fields(rec).collect()}
    assert fields[("own/m", "tags")] == '["a"]' and ("own/m", "deep") not in fields and fields[("z", "n")] == "1"


def test_readers(spark, tmp_path):
    har = {"log": {"entries": [{"_resourceType": "xhr", "request": {"method": "POST", "url": "https://A.com/x?q=1", "queryString": [{"name": "q", "value": "1"}]},
                                "response": {"status": 201, "content": {"mimeType": "application/json"}}}, {"request": {"url": "junk"}}]}}
    (tmp_path / "har").mkdir()
    (tmp_path / "har" / "ok.har").write_text(json.dumps(har, indent=1))
    (tmp_path / "har" / "bad.har").write_text("{nope")
    assert rows(read_har(spark, str(tmp_path / "har")), "method", "host", "pathname", "status") == [("POST", "a.com", "/x", 201)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "p.a11y.json").write_text('{"role":"WebArea","children":[{"role":"link","name":" L "}]}')
    (tmp_path / "t" / "q.aria.yaml").write_text('- button "B"\n  - /url: x\n')
    assert rows(read_trees(spark, str(tmp_path / "t")), "role", "name", "depth") == [("button", "B", 0), ("link", "L", 0)]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "1.json").write_text('{"url":"a","label":"first"}\n{"url":"a","label":"second"}\n{"url":"b","label":"x"}\n')
    assert rows(read_bundle(spark, str(tmp_path / "b"), "url string, label string", "url"), "url", "label") == [("a", "first"), ("b", "x")]


def test_api_document_is_one_json_text(spark):
    import json

    from pagelode.sinks.reports import openapi_lines
    operations = spark.createDataFrame([("h", "GET", "/", ""), ("h", "GET", "/a/{id}", "id"), ("h", "POST", "/a/{id}", "id"), ("k", "GET", "/x", "")],
                                       "host string, method string, template string, params string")
    params = spark.createDataFrame([("h", "GET", "/", "page", "integer")], "host string, method string, template string, name string, type string")
    responses = spark.createDataFrame([("h", "GET", "/", 200, "OK"), ("k", "GET", "/x", 404, "no")],
                                      "host string, method string, template string, status int, description string")
    lines = sorted((r.host, r.part, r.template, r.line) for r in openapi_lines(operations, params, responses).collect())
    documents = {host: json.loads("".join(line for h, _, _, line in lines if h == host)) for host in ("h", "k")}
    assert {h: sorted(d["paths"]) for h, d in documents.items()} == {"h": ["/", "/a/{id}"], "k": ["/x"]}
    assert sorted(documents["h"]["paths"]["/a/{id}"]) == ["get", "post"]
    assert documents["h"]["paths"]["/"]["get"]["parameters"][0]["name"] == "page"


def test_attempts_are_all_numbered(spark):
    from pagelode.plans.registry import queries
    from pagelode.sources import adapters as A
    sf = "/root/testdata/sf0.001"
    rows = A.attempts(spark, sf).select("url", "attempt").collect()
    assert len(rows) == A.table(spark, sf, "events").count() == queries()["p02_backoff_all"](spark, sf).count()
    of = {}
    for r in rows:
        of.setdefault(r.url, []).append(r.attempt)
    assert max(map(len, of.values())) > 3 and all(sorted(n) == list(range(len(n))) for n in of.values())


def test_section_rules_stay_with_their_page(spark):
    """Two pages of one URL: a rule is for the links of its own page, and of one place the smaller page counts."""
    pairs = [(1, "https://a.b/s/i", 0, "https://a.b/x"), (1, "https://a.b/s/i", 2, "https://a.b/c"),
             (2, "https://a.b/s/i", 1, "https://a.b/b"), (2, "https://a.b/s/i", 2, "https://a.b/z"), (3, "https://a.b/s/i", 2, "https://a.b/a")]
    found = spark.createDataFrame(pairs, "page_id long, url string, pos int, target string")
    sections = spark.createDataFrame([(1, "s", "https://a.b/s/i", "^/[a-m]"), (2, "s", "https://a.b/s/i", "^/[n-z]"),
                                      (3, "s", "https://a.b/s/i", "^/[a-m]")], "page_id long, section string, index_url string, pattern string")
    assert [r.page_url for r in links.section_pages(found, sections).collect()] == ["https://a.b/c"]
