import hashlib
from collections import Counter

import numpy as np
import pytest

from pagelode.llm import suffix_dedup as S
from pagelode.llm.anchors import anchors


def brute(docs, width):
    raw = [(k, (t or "").encode()) for k, t in docs]
    seen = Counter(t[i:i + width] for _, t in raw for i in range(len(t) - width + 1))
    out = []
    for key, t in raw:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - width + 1):
            if seen[t[i:i + width]] > 1:
                gone[i + 1:i + 1 + width] = True
        kept = bytes(b for b, g in zip(t, gone[1:]) if not g)
        spans = int((np.diff(gone.astype(int)) == 1).sum())
        out.append((key, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def key(row):
    return tuple(map(str, row))


def fixture():
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdé"), 5))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(60), text(14)
    docs = [(i, text(int(rng.integers(1, 150)))) for i in range(60)]
    for i in range(0, 60, 4):
        docs[i] = (i, docs[i][1] + passage[: int(rng.integers(50, len(passage)))] + docs[i][1][:50])
    for i in range(1, 60, 5):
        docs[i] = (i, line + docs[i][1] + line)
    base = text(120)
    for i in range(40):  # near copies of one text, a word apart
        parts = base.split(" ")
        parts[int(rng.integers(0, len(parts)))] = word()
        docs.append((100 + i, " ".join(parts)))
    docs += [(200, "z" * 700), (201, "ab" * 400), (202, "z" * 90), (None, None), (203, ""), (204, base), (204, base), (None, base)]
    return docs


@pytest.mark.parametrize("width", [64, 100])
@pytest.mark.parametrize("shard", [384 << 10, 2000])
def test_against_brute_force(spark, monkeypatch, width, shard):
    monkeypatch.setattr(S, "SHARD", shard)
    monkeypatch.setattr(S, "PART", max(shard, 4000))
    docs = fixture()
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_removed int")
    got = S.suffix_dedup(frame, width=width).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(docs, width), key=key)


def test_every_window_has_one_anchor():
    for _, t in fixture():
        raw = (t or "").encode()
        low, high, _, _ = anchors(raw, 64)
        starts = sorted(p for a, b in zip(low.tolist(), high.tolist()) for p in range(a, b + 1))
        assert starts == list(range(max(0, len(raw) - 63)))


def test_drop_repeats(spark):
    a = "x" * 10 + "é" * 40 + "unique one"
    frame = spark.createDataFrame([(1, a, "s"), (2, "é" * 40 + "other", "s"), (3, None, "s"), (4, "r" * 90, "t"), (5, "r" * 90, "t")],
                                  "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in S.drop_repeats(frame, width=64).collect()}
    assert got == {1: "x" * 10 + "unique one", 2: "other", 3: ""} or got == {1: "x" * 10 + "unique one", 2: "other", 3: None}


def test_empty_table(spark):
    assert S.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
