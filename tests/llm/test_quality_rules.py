from collections import Counter
from math import comb

import numpy as np

from pagelode.llm import quality_rules as Q

SPACES = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words, word = [], ""
    for ch in text + " ":
        if ch in SPACES:
            if word:
                words.append(word)
            word = ""
        else:
            word += ch
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    hit = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 5)}
    lines = text.split("\n")
    dup = sum(1 for i, line in enumerate(lines) if line.strip(SPACES) and line in lines[:i])
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit))


TEXTS = [None, "", "\n\n \n", "a b c d e a b c d e", "a a a a a a a", "x y\nx y\n\nz\nz\nz \n", "# * $ % & | < > héé\xa0wörld\x1cx",
         "one two three four five six one two three four five six seven " * 3, "w " * 4000 + "end", "é" * 3000]


def test_counts_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "en", 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, kept int")
    got = {r.key: tuple(r)[2:7] for r in Q.features(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_exact_tail():
    n, p = 40, 0.1
    want = np.cumsum([comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(n + 1)])
    assert np.allclose(Q.lower_tail(np.arange(n + 1), n, p), np.minimum(want, 1))


def test_choice_is_certified():
    levels, good, bad = np.array([0, 1, 2, 9]), np.array([900, 99, 1, 0]), np.array([0, 0, 0, 50])
    assert Q.choose_cutoff(levels, good, bad, 0.01, 0.01, 10) == 8
    assert Q.choose_cutoff(levels, good // 100, bad, 0.01, 0.01, 10) is None      # too few good documents to prove anything
    assert Q.choose_cutoff(levels, np.array([500, 0, 0, 500]), bad, 0.01, 0.01, 10) is None


def test_rules_catch_junk_and_keep_good(spark):
    rng = np.random.default_rng(1)
    words = ["w%03d" % i for i in range(400)]
    docs, labels = [], []
    for i in range(3000):
        text = " ".join(rng.choice(words, 40))
        junk = i % 10 == 0
        docs.append((i, " ".join(w + "***" for w in text.split()) if junk else text, "en" if i % 3 else None))
        labels.append((i, int(not junk)))
    docs += [(3000, None, "en"), (3001, "", None), (None, "a b c d e f g h i j", "xx"), (None, "a b c d e f g h i j", "xx")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    out = Q.quality_rules(frame, spark.createDataFrame(labels, "doc_id long, quality int"), alpha=0.05).collect()
    assert len(out) == len(docs)
    kept = {r.doc_id: r.kept for r in out if r.doc_id is not None}
    assert all(kept[i] == (i % 10 != 0) for i in range(3000))
    assert not kept[3000] and not kept[3001]
    assert [r.kept for r in out if r.doc_id is None] == [True, True]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert Q.quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
