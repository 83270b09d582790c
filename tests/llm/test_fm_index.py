import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelode.llm import fm_index as D
from pagelode.llm.suffix import common_prefixes, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, width=10):
    wanted = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            wanted.setdefault(tuple(w[i:i + width]), set()).add("null" if item is None else str(item))
    out = []
    for key, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(p) for p in wanted}:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i:i + n])) in wanted:
                    hit |= set(range(i, i + n))
                    found |= wanted[p]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(found), digest, bool(hit)))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=200))
def test_suffix_array_and_prefixes(symbols):
    text = np.array([*symbols, 0])
    order, rank = suffix_array(text, 2)
    want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert order.tolist() == want and rank[order].tolist() == list(range(len(text)))
    shared = common_prefixes(text, order, rank)
    for before, here in zip(want, want[1:]):
        n = 0
        while text[before + n] == text[here + n]:
            n += 1
        assert shared[here] == n


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(2, 6), min_size=1, max_size=150), st.integers(1, 4))
def test_search_and_locate(symbols, length):
    text = np.array(symbols)
    index = D.FmIndex(text, sample=5)
    phrases = np.array([[2 + (i // 5 ** j) % 5 for j in range(length)] for i in range(5 ** length)])
    live, low, high = index.search(phrases)
    got = {int(p): sorted(index.locate(np.arange(a, b)).tolist()) for p, a, b in zip(live, low, high)}
    want = {}
    for p, row in enumerate(phrases.tolist()):
        at = [i for i in range(len(symbols) - length + 1) if symbols[i:i + length] == row]
        if at:
            want[p] = at
    assert got == want


def fixture():
    rng = np.random.default_rng(2)
    vocabulary = ["w%d" % i for i in range(30)] + ["né", "ß", "日本"]
    items = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 25))))) for i in range(12)]
    items += [(None, "alpha beta"), (40, "Alpha, BETA!"), (41, None), (42, "..."), (3, "extra item words")]
    docs = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 120))))) for i in range(40)]
    for i in range(0, 40, 3):
        docs[i] = (i, docs[i][1] + "; " + items[i % 12][1].upper() + " - " + docs[i][1])
    docs += [(None, None), (50, ""), (51, "x alpha\n beta y"), (51, "x alpha\n beta y"), (52, items[0][1] + " é " * 50000 + items[1][1])]
    return docs, items


@pytest.mark.parametrize("block_rows", [100_000, 20])
def test_against_brute_force(spark, block_rows):
    docs, items = fixture()
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.decontaminate(frame, bench, block_rows=block_rows).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute(docs, items), key=key)


def test_small_shards_lose_nothing():
    docs, items = fixture()
    rows = [(b" ".join(w.encode() for w in split(t)[i:i + 10]), str(k)) for k, t in items for i in range(max(1, len(split(t)) - 9)) if split(t)]
    phrases = D.Phrases(rows)
    texts = [D.words((t or "").encode()) for _, t in docs[:44]]
    assert set(D.find(texts, phrases)) == set(D.find(texts, phrases, shard=40))


def test_drop_contaminated(spark):
    frame = spark.createDataFrame([(1, "keep this, one two three. and this", "a"), (2, "One two THREE", "b"), (3, None, None), (4, "", "c")],
                                  "doc_id long, text string, source string")
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = {r.doc_id: r.text for r in D.drop_contaminated(frame, bench).collect()}
    assert got == {1: "keep this, . and this", 3: None, 4: ""}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in D.decontaminate(docs, bench).collect()] == [(3, 0, 0)]
    assert D.decontaminate(docs.limit(0), bench).count() == 0
