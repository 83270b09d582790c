"""Benchmark decontamination with an FM-index per shard of training text.

A shard's words become symbols. Its suffix array gives the Burrows-Wheeler transform, kept as a wavelet matrix; test phrases
are found by backward search through its ranks, and their places by walking to sampled suffix positions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import arrow_map, small_batches, under_other_names, values
from .suffix import suffix_array

# A-Z become lower case; what is neither a digit, a letter nor part of a character beyond ASCII becomes a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Symbols of a shard at most; the suffix array packs three of its places into one long.
SHARD = (1 << 20) - 2


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class FmIndex:
    """Index of an array of symbols from 1 up; 0 marks the end and 1 is never searched."""

    def __init__(self, text: np.ndarray, sample: int = 16):
        text = np.append(text, 0)
        bits = max(1, int(text.max()).bit_length())
        order, _ = suffix_array(text, bits)
        self.n = len(text)
        self.last = text[order - 1]
        counts = np.bincount(text, minlength=1 << bits)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.sampled = order % sample == 0
        self.places = order[self.sampled]
        self.number = np.cumsum(self.sampled, dtype=np.int32)
        # Wavelet matrix: per bit, from the highest, zeros up to each row; rows go on with zeros first.
        self.levels, row = [], self.last
        for shift in range(bits - 1, -1, -1):
            bit = (row >> shift) & 1
            zeros = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit == 0, out=zeros[1:])
            self.levels.append((shift, zeros))
            row = np.concatenate([row[bit == 0], row[bit == 1]])

    def occurrences(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each row."""
        low, high = np.zeros_like(row), row
        for shift, zeros in self.levels:
            one, none = (symbol >> shift) & 1 == 1, zeros[self.n]
            low = np.where(one, none + low - zeros[low], zeros[low])
            high = np.where(one, none + high - zeros[high], zeros[high])
        return high - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(phrase, low, high)`` of the phrases that occur; ``phrases`` holds one per row, all of one length."""
        live = np.arange(len(phrases))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, column]
            known = symbol < len(self.first) - 1
            live, symbol, low, high = live[known], symbol[known], low[known], high[known]
            low = self.first[symbol] + self.occurrences(symbol, low)
            high = self.first[symbol] + self.occurrences(symbol, high)
            some = low < high
            live, low, high = live[some], low[some], high[some]
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of rows of the index."""
        out, at, live = np.zeros(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        steps = 0
        while len(live):
            done = self.sampled[at]
            out[live[done]] = self.places[self.number[at[done]] - 1] + steps
            live, at = live[~done], at[~done]
            symbol = self.last[at]
            at = self.first[symbol] + self.occurrences(symbol, at)
            steps += 1
        return out


class Phrases:
    """A block of test phrases: their words as symbols and the items each belongs to."""

    def __init__(self, rows: list[tuple[bytes, str]]):
        items: dict[bytes, set[str]] = {}
        for phrase, item in rows:
            items.setdefault(phrase, set()).add(item)
        self.items = list(items.values())
        split = [p.split(b" ") for p in items]
        vocabulary = sorted({w for p in split for w in p})
        self.symbol = {w: i + 2 for i, w in enumerate(vocabulary)}
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(split):
            by_length.setdefault(len(p), []).append(i)
        self.groups = {n: (np.array(ids), np.array([[self.symbol[w] for w in split[i]] for i in ids]))
                       for n, ids in by_length.items()}
        self.shortest, self.longest = min(by_length), max(by_length)


def find(texts: list[list[bytes]], phrases: Phrases, shard: int = SHARD) -> Iterator[tuple[int, int, int, int]]:
    """``(text, first word, word after, phrase)`` of every occurrence in a list of texts, given as words.

    Only runs of words that the phrases know, as long as the shortest phrase, go into shards; runs are kept apart by a symbol
    that no phrase has. A run longer than a shard is cut with an overlap of one word less than the longest phrase.
    """
    parts: list[np.ndarray] = []
    starts: list[tuple[int, int, int]] = []  # place in the shard, text, word
    size = 0

    def flush() -> Iterator[tuple[int, int, int, int]]:
        index = FmIndex(np.concatenate(parts))
        place, text, word = (np.array(c) for c in zip(*starts))
        for length, (ids, rows) in phrases.groups.items():
            live, low, high = index.search(rows)
            counts = high - low
            row = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            at = index.locate(row)
            run = np.searchsorted(place, at, "right") - 1
            first = word[run] + at - place[run]
            yield from zip(text[run].tolist(), first.tolist(), (first + length).tolist(), ids[np.repeat(live, counts)].tolist())

    get = phrases.symbol.get
    for number, text in enumerate(texts):
        ids = np.fromiter((get(w, 1) for w in text), np.int64, len(text))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], ids > 1, [0]]).astype(np.int8)))
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - begin < phrases.shortest:
                continue
            while True:
                stop = min(end, begin + shard - 1)
                if size and size + stop - begin + 1 > shard:
                    yield from flush()
                    parts, starts, size = [], [], 0
                starts.append((size, number, begin))
                parts.append(np.append(ids[begin:stop], 1))
                size += stop - begin + 1
                if stop == end:
                    break
                begin = stop - phrases.longest + 1
    if size:
        yield from flush()


def _hits(texts: list[list[bytes]], phrases: Phrases) -> tuple[list[list[int]], list[list[str]]]:
    """Merged spans ``[start, end, start, end, ...]`` of words, and items, of every text."""
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    for text, first, after, phrase in find(texts, phrases):
        spans[text].append((first, after))
        items[text] |= phrases.items[phrase]
    return [merged(s) for s in spans], [sorted(i) for i in items]


def merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def windows(benchmark: DataFrame, key: str = "item_id", text: str = "text", width: int = 10) -> DataFrame:
    """``window, item``: every ``width`` consecutive words of an item, or all its words if there are fewer but some."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str]] = []
            for item, text in zip(batch.column(0).to_pylist(), values(batch.column(1))):
                w = words(text)
                for i in range(max(1, len(w) - width + 1) if w else 0):
                    out.append((b" ".join(w[i:i + width]).decode(), item))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in (0, 1)], ["window", "item"])

    rows = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("item"), F.col(text).cast("string").alias("text"))
    return arrow_map(rows, run, "window string, item string").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = 10, block_rows: int = 100_000) -> DataFrame:
    """All columns of ``docs`` and ``_n_words, _spans, _items``: merged spans of hit words, and the items that occur.

    The benchmark is taken in blocks of about ``block_rows`` windows, each of which is sent to all tasks; a block needs one
    pass over the texts, in which every task indexes what it reads, shard by shard. With one block, as a rule, no text is
    shuffled or stored; with more, texts are stored under row numbers and the blocks' findings are merged by those.
    """
    spark = docs.sparkSession
    known = stage(windows(benchmark, text=text, width=width), "test-windows")
    n_blocks = max(1, math.ceil(known.count() / block_rows))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    found_type = "_n_words long, _spans array<int>, _items array<string>"

    def one_pass(rows: DataFrame, columns: list[str], block: int) -> DataFrame:
        mine = known.filter(F.pmod(F.xxhash64("window", "item"), F.lit(n_blocks)) == block)
        sent = spark.sparkContext.broadcast([(r.window.encode(), r.item) for r in mine.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(sent.value) if sent.value else None
            for batch in small_batches(batches, "_text"):
                texts = [words(t) for t in values(batch.column(batch.num_columns - 1))]
                spans, items = _hits(texts, phrases) if phrases else ([[]] * len(texts), [[]] * len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array([len(t) for t in texts], pa.int64()),
                     pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                    [*batch.schema.names[:-1], "_n_words", "_spans", "_items"])

        return arrow_map(rows, run, ", ".join([*columns, found_type]))

    source = docs.withColumn("_text", F.col(text).cast("string"))
    if n_blocks == 1:
        return one_pass(source, kept, 0)
    stored = stage(source.withColumn("_row", F.monotonically_increasing_id()), "test-texts")
    parts = [one_pass(stored.select("_row", "_text"), ["_row long"], b) for b in range(n_blocks)]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionAll(part)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged([tuple(s[i:i + 2]) for s in lists for i in range(0, len(s), 2)]) for lists in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int32())), batch.column(3)],
                                             ["_row", "_n_words", "_spans", "_items"])

    merged_rows = arrow_map(together.groupBy("_row").agg(
        F.max("_n_words").alias("_n_words"), F.collect_list("_spans").alias("_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items")), join, f"_row long, {found_type}")
    return stored.drop("_text").join(merged_rows, "_row").drop("_row")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", width: int = 10, **options) -> DataFrame:
    """Per document: ``key, n_words, n_hit, n_items, items_sha256, contaminated``.

    Null and empty texts have no words; an item with null id counts under the name ``null``; repeated items and rows count
    as they are. The digest is of the item ids, sorted as strings and joined by commas (of nothing, if none occurs).
    """
    rows = contamination(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), benchmark, "text", width, **options)
    hit = F.when(F.size("_spans") > 0, F.expr(
        "aggregate(transform(_spans, (v, i) -> if(i % 2 = 1, v, -v)), 0L, (a, v) -> a + v)")).otherwise(F.lit(0).cast("long"))
    return rows.select(F.col("key").alias(key), F.col("_n_words").alias("n_words"), hit.alias("n_hit"),
                       F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
                       (F.size("_spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = 10, **options) -> DataFrame:
    """``docs`` without the words that any test phrase covers, and all columns as they were, whatever their names.

    A document loses the bytes from its first to its last hit word of each span; one that is left without words goes.
    """
    def work(rows: DataFrame, text: str) -> DataFrame:
        return _drop_contaminated(rows, benchmark.withColumnRenamed(own, text), text, width, **options)

    own = text
    return under_other_names(docs, work, text=text)


def _drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str, width: int, **options) -> DataFrame:
    rows = contamination(docs, benchmark, text, width, **options)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    names, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut(t, s) if s else t for t, s in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            keep = pa.array([not s or bool(words(t.encode())) for t, s in zip(texts, batch.column(batch.num_columns - 1).to_pylist())])
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names).filter(keep)

    return arrow_map(rows.select(*docs.columns, "_spans"), run, fields)


def cut(text: str, spans: list[int]) -> str:
    """The text without the words of ``spans`` and what stands between them."""
    raw = text.encode()
    folded = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[0], folded, [0]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    out, last = [], 0
    for first, after in zip(spans[::2], spans[1::2]):
        out.append(raw[last:starts[first]])
        last = ends[after - 1]
    return b"".join([*out, raw[last:]]).decode()
