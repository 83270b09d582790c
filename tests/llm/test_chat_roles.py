import itertools
import zlib

import numpy as np

from pagelode.llm import chat_roles as C


def model(rng):
    return C.Model(rng.random(4) * 9, rng.random((4, 4)) * 9, [rng.random((4, n)) * 9 for n in C.SHAPE])


def lines(rng, n):
    return np.array([[1 if i == 0 else int(rng.integers(0, 2)), *(int(rng.integers(0, k)) for k in C.SHAPE)] for i in range(n)])


def score(m, seen, path):
    emitted = m.emission(seen)
    total = m.first[path[0]] + emitted[0, path[0]]
    for i in range(1, len(path)):
        total += m.steps[seen[i, 0]][path[i - 1], path[i]] + emitted[i, path[i]]
    return total


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(20):
        m, seen = model(rng), lines(rng, 5)
        best = max(itertools.product(range(4), repeat=5), key=lambda p: score(m, seen, p))
        assert abs(score(m, seen, m.decode(seen, None, None)) - score(m, seen, best)) < 1e-9
        # The same over a cut: matrices of the parts, then the parts between the roles at the cut.
        whole = m.transfer(seen[:2], True)[0][:, None] + m.transfer(seen[2:], False)
        assert abs(whole.max() - score(m, seen, best)) < 1e-9
        role = int(whole.max(1).argmax())
        path = [*m.decode(seen[:2], None, role), *m.decode(seen[2:], role, None)]
        assert abs(score(m, seen, path) - score(m, seen, best)) < 1e-9


def test_markers():
    assert C.marker("User: hello")[0] == 2 and C.marker("**Assistant:** hi") == (3, "hi") and C.marker("<|system|>be kind")[0] == 1
    assert C.marker("note: hello") == (0, "note: hello") and C.marker("") == (0, "")


def chats(n, rng):
    out = []
    for c in range(n):
        turns = ["system"] * int(c % 4 == 0)
        turns += ["user", "assistant"] * int(rng.integers(1, 4))
        for t, role in enumerate(turns):
            text = {"system": "follow the rules closely please", "user": "what is this?", "assistant": "a long answer " * 30 + "\n\nand more of it"}[role]
            out.append((c, t, role, text, 1))
    return out


def test_held_out_roles_and_rendering(spark):
    rng = np.random.default_rng(2)
    rows = chats(300, rng)
    rows += [(1000, t, None, text, 1) for t, text in enumerate(["User: one?", "Assistant: two\nthree\nUser: four?"])]
    rows += [(1001, 0, "user", None, 1), (1001, 1, "assistant", "", 1), (None, None, None, "x", 1), (1002, 0, "user", "twice?", 1), (1002, 0, "user", "twice?", 1)]
    # One conversation holds a third of all rows and is cut by many partitions.
    rows += [(2000, t, None, "what is this?" if t % 2 == 0 else "a long answer " * 30 + "\n\nand more of it", 1) for t in range(700)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, predicted int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = C.recover_roles(frame).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = [r for r in out if r.conv_id is not None and r.conv_id < 300 and zlib.crc32(str(r.conv_id).encode()) % 3 == 1]
    assert held and np.mean([r.role == r.predicted for r in held]) > 0.98
    hot = sorted((r.turn, r.predicted, r.begins_turn) for r in out if r.conv_id == 2000)
    assert hot == [(t, "assistant" if t % 2 else "user", True) for t in range(700)]
    marked = [(r.turn, r.segment, r.predicted, r.rendered) for r in sorted((r for r in out if r.conv_id == 1000), key=lambda r: (r.turn, r.segment))]
    assert [m[2] for m in marked] == ["user", "assistant", "user"]
    assert "".join(m[3] for m in marked) == "<|user|>\none?\n<|end|>\n<|assistant|>\ntwo\nthree\n<|end|>\n<|user|>\nfour?\n"
    assert len([r for r in out if r.conv_id == 1002]) == 2 and len([r for r in out if r.conv_id is None]) == 1


def test_empty_table(spark):
    assert C.recover_roles(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
