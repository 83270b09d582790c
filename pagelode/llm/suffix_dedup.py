"""Exact removal of long repeated byte strings with suffix arrays per shard.

A window is a string of ``width`` bytes. Equal windows have equal anchors (see ``anchors``), so first the anchors are
counted: one that occurs once has no repeated window. The bytes around the others, sorted into shards by anchor, get a
suffix array by Larsson-Sadakane refinement and common prefixes by Kasai's rule: neighbours that share ``width`` bytes
are repeats. An anchor that is too frequent for one shard is split over several, whose sorted windows are merged by
binary search.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, stage
from .anchors import Hashes, anchors
from .common import arrow_map, small_batches, under_other_names, values
from .fm_index import merged
from .suffix import common_prefixes, suffix_array

# No byte of UTF-8 is 255 or 254.
BETWEEN, END = b"\xff", b"\xfe"
#: Bytes of a shard on average; a shard is worked on in parts of at most ``PART`` bytes.
SHARD, PART = 384 << 10, 1 << 20
#: Contexts with more copies than ``HEAVY`` are marked where they lie, the ``MOST_HEAVY`` most frequent ones at most; the rest is joined.
HEAVY, MOST_HEAVY = 32, 1 << 16


def text_id(text: Column) -> Column:
    """128 bits of the SHA-256 of a text."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def distinct_texts(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``number, id, first_key, copies, low[], high[], gram[], context[]`` of every distinct text of at least ``width`` bytes.

    Anchors are found where the text is read; copies are merged on the map side first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            rows = [(hashlib.sha256(t).digest()[:16], k, *anchors(t, width))
                    for k, t in zip(batch.column(0).to_pylist(), values(batch.column(1)))]
            ids, keys, low, high, gram, context = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.binary()), pa.array(keys, pa.string()),
                 *[pa.array([v.astype(np.int32) for v in c], pa.list_(pa.int32())) for c in (low, high)],
                 *[pa.array([v.view(np.int64) for v in c], pa.list_(pa.int64())) for c in (gram, context)]],
                ["id", "key", "low", "high", "gram", "context"])

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text")).filter(F.octet_length("text") >= width)
    found = arrow_map(rows, run, "id binary, key string, low array<int>, high array<int>, gram array<long>, context array<long>")
    once = found.groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("first_key"),
                                   F.first(F.struct("low", "high", "gram", "context")).alias("a"))
    return stage(once.select(F.monotonically_increasing_id().alias("number"), "id", "first_key", "copies", "a.*"), "dedup-texts")


def repeated_in(contexts: list[bytes], width: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined contexts, start of each, their order of suffixes, and by place: is it a repeated window, is it the first of its kind."""
    joined = BETWEEN.join(contexts) + END
    text = np.frombuffer(joined, np.uint8)
    order, rank = suffix_array(text, 8)
    shared = common_prefixes(text, order, rank)[order] >= width
    again = np.zeros(len(text), bool)
    again[order] = shared | np.append(shared[1:], False)
    head = np.zeros(len(text), bool)
    head[order] = ~shared
    starts = np.cumsum([0] + [len(c) + 1 for c in contexts[:-1]])
    return joined, starts, order, again, head


def _runs(flags: np.ndarray) -> np.ndarray:
    """First and last place of each run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]]).astype(np.int8)))
    return np.stack([edges[::2], edges[1::2] - 1], 1)


#: Rows of a shard: runs of repeated window starts, or (with ``gram``) the kinds of windows of a split anchor, in lists.
FOUND = pa.schema([("number", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("gram", pa.int64()), ("side", pa.int64()),
                   ("numbers", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())),
                   ("checks", pa.list_(pa.int64())), ("opens", pa.list_(pa.bool_()))])
FOUND_SQL = ("number long, low long, high long, gram long, side long, numbers array<long>, starts array<long>, hashes array<long>, "
             "checks array<long>, opens array<boolean>")


def shard_repeats(table: pa.Table, width: int) -> pa.Table:
    """Repeated windows of one shard, from ``number, low, copies, gram, context, split, sides, bytes``.

    Gives runs of window starts (``number, low, high``) of contexts that have no equal. For a split anchor, it also gives the
    hashes of each kind of window, dealt over ``sides`` lists; a kind is open if it has not been found again so far.
    """
    order = np.lexsort((table["context"].to_numpy(), table["gram"].to_numpy()))
    table = table.take(order)
    gram, context = table["gram"].to_numpy(), table["context"].to_numpy()
    table = table.filter(pa.array(np.concatenate([[True], (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])])))
    gram, number, low = (table[c].to_numpy() for c in ("gram", "number", "low"))
    copies, sides, split, texts = table["copies"].to_numpy(), table["sides"].to_numpy(), table["split"][0].as_py(), table["bytes"].to_pylist()
    out: list[tuple] = []
    lists: dict[tuple[int, int], list[tuple]] = {}
    begin = size = last = 0
    cuts = []
    for i in range(len(texts)):  # parts end between anchors
        if i and gram[i] != gram[i - 1]:
            last = i
        if size + len(texts[i]) > PART and last > begin:
            cuts.append((begin, last))
            size = sum(map(len, texts[last:i]))
            begin = last
        size += len(texts[i]) + 1
    cuts.append((begin, len(texts)))
    for begin, end in cuts:
        joined, starts, _, again, head = repeated_in(texts[begin:end], width)
        sums = [Hashes(joined, base) for base in (0, 1)] if split else []
        for i, start in zip(range(begin, end), starts.tolist()):
            windows = len(texts[i]) - width + 1
            here = again[start:start + windows]
            if copies[i] == 1:
                out += [(number[i], low[i] + a, low[i] + b) for a, b in _runs(here).tolist()]
            if split:
                # One row per kind: windows found here are only sent to find others.
                kinds = np.flatnonzero(head[start:start + windows])
                first = start + kinds
                h, v = (s.of(first, first + width, 5).view(np.int64) for s in sums)
                opened = ~here[kinds] & (copies[i] == 1)
                at = h % sides[i]
                for side in np.unique(at).tolist():
                    some = at == side
                    lists.setdefault((int(gram[i]), side), []).append(
                        (np.full(some.sum(), number[i]), low[i] + kinds[some], h[some], v[some], opened[some]))
    rows = [(*r, *[None] * 7) for r in out]
    rows += [(None, None, None, *at, *map(np.concatenate, zip(*parts))) for at, parts in lists.items()]
    columns = list(zip(*rows)) if rows else [()] * len(FOUND)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND)], schema=FOUND)


def merge_shards(table: pa.Table) -> pa.Table:
    """Open windows that another shard of their anchor has as well, found by binary search in the sorted hashes of all."""
    number, start, h, v, opened = (np.concatenate(table[c].to_pylist()) for c in ("numbers", "starts", "hashes", "checks", "opens"))
    order = np.lexsort((v, h))
    ordered, checks = h[order], v[order]
    left, right = np.searchsorted(ordered, h, "left"), np.searchsorted(ordered, h, "right")
    # Each shard sends a kind once, so two rows of one hash are two shards; the second hash must agree as well.
    same = (right - left > 1) & ((checks[left] == v) & (checks[np.minimum(left + 1, len(v) - 1)] == v) | (right - left > 2))
    found = same & opened.astype(bool)
    return pa.table({"number": number[found].astype(np.int64), "low": start[found].astype(np.int64), "high": start[found].astype(np.int64)})


def repeated_contexts(some: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences of contexts that occur again: those of frequent contexts, found in a short list, and all others, not joined yet.

    A passage that is everywhere would send all its occurrences to one task of a join. The list only decides where an
    occurrence is marked, so any length of it gives the same result.
    """
    frequent = kinds.filter(F.col("copies") > HEAVY).orderBy(F.desc("copies"), "gram", "context").limit(MOST_HEAVY)
    known = some.sparkSession.sparkContext.broadcast({(r[0], r[1]) for r in frequent.select("gram", "context").collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = known.value
        for batch in batches:
            found = [pair in heavy for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.bool_())], [*batch.schema.names, "heavy"])

    marked = arrow_map(some.select("gram", "context", "number", "low", "high"), run,
                       "gram long, context long, number long, low int, high int, heavy boolean")
    return marked.filter("heavy").drop("heavy"), marked.filter("not heavy").drop("heavy")


def repeats(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``id, spans``: the merged byte spans of each distinct text that repeated windows cover."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = distinct_texts(docs, key, text, width)
    each = texts.select("number", "copies", F.explode(F.arrays_zip("low", "high", "gram", "context")).alias("a")).select("number", "copies", "a.*")
    frequent = each.groupBy("gram").agg(F.sum("copies").alias("n")).filter("n > 1").select("gram")
    frequent = stage(frequent, "dedup-frequent")
    some = stage(each.join(frequent, "gram"), "dedup-anchors")
    kinds = stage(some.groupBy("gram", "context").agg(F.sum("copies").alias("copies"), F.min(F.struct("number", "low", "high")).alias("r"))
                  .select("gram", "context", "copies", "r.*"), "dedup-contexts")
    size = F.col("high") - F.col("low") + width
    # All windows of a context that occurs again are repeats.
    heavy, others = repeated_contexts(some, kinds)
    again = kinds.filter("copies > 1").select("gram", "context")
    whole = heavy.select("number", "low", "high").unionAll(others.join(again, ["gram", "context"]).select("number", "low", "high"))
    groups = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.sum(size).alias("size")).filter("kinds > 1")
    groups = stage(groups, "dedup-grams")
    small = groups.filter(F.col("size") <= SHARD).agg(F.sum("size")).first()[0] or 0
    n_shards = max(1, math.ceil(small / SHARD))
    split = F.col("size") > SHARD
    placed = kinds.join(groups, "gram").select(
        "number", "low", "high", "gram", "context", "copies", split.alias("split"),
        F.when(split, F.col("gram")).otherwise(F.pmod(F.xxhash64("gram"), F.lit(n_shards))).alias("shard"),
        F.when(split, F.pmod(F.xxhash64("context"), F.ceil(F.col("size") / SHARD))).otherwise(F.lit(0)).alias("part"),
        F.ceil(F.col("size") / SHARD).alias("sides"))
    wanted = placed.groupBy("number").agg(F.collect_list(F.struct("low", "high", "gram", "context", "copies", "split", "shard", "part", "sides")).alias("w"))
    wanted = wanted.join(texts.select("number", "id", "first_key"), "number")
    shards = shard_bytes(docs, key, text, wanted, width)
    found = stage(shards.groupBy("split", "shard", "part").applyInArrow(
        lambda t: shard_repeats(t, width), FOUND_SQL), "dedup-found")
    across = found.filter("gram is not null").groupBy("gram", "side").applyInArrow(merge_shards, "number long, low long, high long")
    runs = (whole.select("number", F.col("low").cast("long"), F.col("high").cast("long"))
            .unionAll(found.filter("gram is null").select("number", "low", "high")).unionAll(across))
    lists = runs.groupBy("number").agg(F.collect_list(F.struct("low", "high")).alias("runs")).join(texts.select("number", "id"), "number")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged([(r["low"], r["high"] + width) for r in runs]) for runs in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.int64()))], ["id", "spans"])

    return stage(arrow_map(lists.select("id", "runs"), join, "id binary, spans array<long>"), "dedup-spans")


def packed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``text`` replaced by ``_id, _n_bytes, _packed``: the text compressed, as it is about to be shuffled."""
    source = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit(""))).drop(text)
    source = source.withColumns({"_id": text_id(F.col("_text")), "_n_bytes": F.octet_length("_text").cast("long")})
    source = source.select(*[c for c in source.columns if c != "_text"], "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text"):
            small = [pa.compress(t, "zstd", asbytes=True) for t in values(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(small, pa.binary())], [*batch.schema.names[:-1], "_packed"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text")
    return arrow_map(source, run, f"{fields}, _packed binary")


def unpack(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, "zstd", asbytes=True) if size else b""


def shard_bytes(docs: DataFrame, key: str, text: str, wanted: DataFrame, width: int) -> DataFrame:
    """One row with its bytes for each context of ``wanted``, cut from one document of each text."""
    names = ("gram", "context", "copies", "shard", "part", "sides")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for data, size, number, wants in zip(*(batch.column(i).to_pylist() for i in range(4))):
                raw = unpack(data, size)
                rows += [(number, w["low"], w["split"], *(w[n] for n in names), raw[w["low"]:w["high"] + width]) for w in wants]
            columns = list(zip(*rows)) if rows else [()] * 10
            kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 6, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["number", "low", "split", *names, "bytes"])

    texts = packed(docs.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_t")).filter(F.octet_length("_t") >= width), "_t")
    joined = texts.join(wanted, (F.col("_id") == F.col("id")) & F.col("_key").eqNullSafe(F.col("first_key")))
    return arrow_map(joined.select("_packed", "_n_bytes", "number", "w"), run,
                     "number long, low long, split boolean, gram long, context long, copies long, shard long, part long, sides long, bytes binary")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 400) -> DataFrame:
    """All columns but ``text``, and ``_n_bytes, _n_removed, _n_spans, _kept``: the bytes that no repeated window covers."""
    rows = packed(docs, text).join(repeats(docs, key, text, width), F.col("_id") == F.col("id"), "left").drop("id", "_id")
    names = [c for c in docs.columns if c != text]
    rows = rows.select(*names, "_n_bytes", "_packed", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, counts, kept = [], [], []
            sizes, data, spans = (batch.column(len(names) + i).to_pylist() for i in range(3))
            for size, small, span in zip(sizes, data, spans):
                raw, span = unpack(small, size), span or []
                edges = [0, *span, size]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                removed.append(size - len(kept[-1]))
                counts.append(len(span) // 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(names) + 1], pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())],
                [*names, "_n_bytes", "_n_removed", "_n_spans", "_kept"])

    fields = "".join(f"`{docs.schema[c].name}` {docs.schema[c].dataType.simpleString()}, " for c in names)
    return arrow_map(rows, run, f"{fields}_n_bytes long, _n_removed long, _n_spans long, _kept binary")


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 400) -> DataFrame:
    """Per document: ``key, n_bytes, n_removed, n_spans, kept_sha256``.

    Every byte that a ``width``-byte string covers which starts anywhere else too is removed; strings are judged on the input
    and never cross documents. Null and empty texts have no bytes; equal texts, repeated rows included, count as copies of each
    other, whatever their keys; other columns are ignored.
    """
    rows = without_repeats(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text", width)
    return rows.select(F.col("key").alias(key), F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"),
                       F.col("_n_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 400) -> DataFrame:
    """``docs`` with its columns, whatever their names, and the bytes that are left as text; if nothing is left, the row goes.

    A character that a span cuts through is left out. A document that had no text stays.
    """
    return under_other_names(docs, lambda rows, key, text: _drop_repeats(rows, key, text, width), key=key, text=text)


def _drop_repeats(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    rows = without_repeats(docs, key, text, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [k.decode("utf-8", "ignore") for k in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(kept, pa.string())], [*batch.schema.names[:-1], "_kept"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_kept")
    cleaned = arrow_map(rows, run, f"{fields}, _kept string").filter((F.col("_n_removed") == 0) | (F.length(F.trim("_kept")) > 0))
    return cleaned.select(*[F.col("_kept").alias(c) if c == text else F.col(c) for c in docs.columns])
