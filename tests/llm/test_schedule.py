import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pagelode.llm import schedule as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    out = []
    for i in range(600):
        source = [None, "b", "a", "é", "B", "tiny"][i % 5 if i % 97 else 5]
        out.append((i, ("w%d " % i) * ((i * 37) % 400), source))
    return out + [(None, None, "a"), (None, "x y", None), (7, "x y z", "b"), (7, "x y z", "b"), (900, "", "none"), (901, "v " * 30000, "long")]


def goal(docs):
    size = Counter()
    for _, text, source in docs:
        size[source] += len(WORD.findall(text or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        level = (total - sum(2 * size[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and level * weight[s] > 2 * size[s]}
        if not more:
            return size, {s: 2.0 * size[s] if s in full else level * weight[s] for s in order}
        full |= more


def brute_taken(docs, size, target, seed=11):
    """What the first words of each source's shuffled, repeated stream are made of."""
    out, by_source = Counter(), defaultdict(list)
    for i, (key, text, source) in enumerate(docs):
        n = len(WORD.findall(text or ""))
        name = "null" if key is None else str(key)
        by_source[source].append((hashlib.md5(f"{seed}:{name}:{n}".encode()).hexdigest(), i, n))
    for source, items in by_source.items():
        left = int(target[source] + 0.5)
        while left > 0:
            for _, i, n in sorted(items):
                out[i] += min(n, left)
                left -= min(n, left)
                if not left:
                    break
    return out


def test_targets_and_takings(spark):
    docs = rows()
    frame = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, source string, taken int, size int")
    got = S.mixed_documents(frame, block=64).collect()
    size, target = goal(docs)
    taken = brute_taken(docs, size, target)
    want = Counter((k, len(WORD.findall(t or "")), size[s], round(target[s], 6), taken[i]) for i, (k, t, s) in enumerate(docs))
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == want
    assert all(r.taken <= 2 * r["size"] for r in got)
    again = S.mixed_documents(frame.repartition(7), block=64).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_points_and_order(spark):
    got = [r.p for r in spark.range(3000000, 3000100).select(S.point(F.col("id")).alias("p")).collect()]
    assert got == [t * S.GOLDEN % 2 ** S.BITS for t in range(3000000, 3000100)]
    docs = [(i, "w " * 100, "a" if i % 4 else "b") for i in range(400)]
    sized = S.sizes(spark.createDataFrame(docs, "doc_id long, text string, source string")).drop("text")
    sources = S.targets(sized, "source", (3, 1, 2), 1.5, 2.0)
    plan = S.slots(sources, 50).orderBy("slot").collect()
    need = Counter(r.source for r in plan)
    # Low discrepancy: after any number of slots each source has had its share, but for a few.
    seen, total = Counter(), len(plan)
    for i, r in enumerate(plan, 1):
        seen[r.source] += 1
        assert all(abs(seen[s] - need[s] * i / total) < 4 for s in need)
    mixed = S.mix(sized, sources, block=50)
    assert mixed.agg(F.sum("words")).first()[0] == sum(int(r.target + 0.5) for r in sources.collect())
    assert mixed.groupBy("slot").agg(F.sum("words").alias("n")).filter("n > 50").isEmpty()


def test_empty_table(spark):
    assert S.mixed_documents(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    none = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert S.mixed_documents(none).first().taken == 0
