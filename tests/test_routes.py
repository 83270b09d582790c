"""The best route per request against a linear scan."""

import random
import re

from pagelode.operators import calls as C


def scan(request, routes):
    best = (-1, None)
    for seq, method, template, op, body, want in routes:
        pattern = "^" + re.sub(r"\{[^}]+\}", "[^/]+", template) + "$"
        if method.upper() != request["method"] or not re.search(pattern, request["pathname"]):
            continue
        score = 1 + (100 if op and op == request["op"] else 0) + (50 if body and body == request["body_hash"] else 0)
        asked = request["query_sig"]
        if want:
            score += 25 if want == asked else 5 if asked and want in asked else 0
        elif not asked:
            score += 2
        if score > best[0]:
            best = (score, seq)
    return best


def test_equals_a_linear_scan(spark):
    rng = random.Random(5)

    def sig():
        names = rng.sample(["a", "ba", "cba", "page", "age"], rng.randrange(0, 4))
        return "&".join(f"{n}={rng.choice(['', '1', '12', '2', 'x=y', '1,2'])}" for n in sorted(names))

    routes = [(i, rng.choice(["get", "POST"]), rng.choice(["/u/{id}", "/u/me", "/{x}/list", "/o"]), rng.choice([None, None, "Op1", "Op2"]),
               rng.choice(["", "", "h1", "h2"]), sig()) for i in range(150)]
    asks = [{"request_id": i, "method": rng.choice(["GET", "POST", "PUT"]), "pathname": rng.choice(["/u/7", "/u/me", "/q/list", "/o", "/none/at/all"]),
             "op": rng.choice([None, "Op1", "Op3"]), "body_hash": rng.choice(["", "h1", "h9"]), "query_sig": sig()} for i in range(400)]
    fixture = spark.createDataFrame(routes, "route_seq long, method string, template string, op string, body_hash string, query_sig string")
    requests = spark.createDataFrame([tuple(a.values()) for a in asks],
                                     "request_id long, method string, pathname string, op string, body_hash string, query_sig string")
    got = {r.request_id: (r.score, r.route_seq) for r in C.best_routes(requests, fixture).collect()}
    want = {a["request_id"]: scan(a, routes) for a in asks}
    assert got == {k: v for k, v in want.items() if v[1] is not None}
    assert sum(v[0] % 25 == 6 for v in want.values()) > 5  # parts of a query decide some
    assert C.best_routes(requests.filter("request_id < 0"), fixture).count() == 0
    assert C.best_routes(requests, fixture.filter("route_seq < 0")).count() == 0
