"""Cross-tokenizer alignment: token-byte incidence matrices, multiplied row by row.

Rows of ``A`` and ``B`` are the tokens of two tokenizers, columns the bytes of the text. ``A @ B.T`` has a value where two
tokens share bytes: the overlap links. Places where both tokenizers end a token cut the tokens into groups; with ``GA`` and
``GB`` (groups by tokens) ``GA.T @ GB`` has a value where two tokens share a group. All of it is additive over chunks of a
text that both tokenizers treat alone, so each distinct chunk of a block of texts is encoded and multiplied once.

What a document says about its links needs counts of the whole corpus. A block of texts keeps a dictionary of its id pairs
(one row per block); only these dictionaries are shuffled, added up and joined back, and the documents of a block meet
them in one group, whose size the block's bytes bound.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import arrow_map, values
from .csr import Csr, product, product_sizes, ranges, tiles, transpose

#: Places where both tokenizers start anew: one blank between two characters that are no white space and no blank mark.
#: Byte-level pre-tokens begin at such a blank, and no piece of the other vocabulary has a blank mark after another character.
SAFE = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
#: Long texts are cut into chunks section by section.
SECTION = 1 << 20
#: Ids of B fit below this; a pair is ``a << PAIR_BITS | b``.
PAIR_BITS = 24


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, and the bytes of each of their ids."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.bytes_a = [self._letters_to_bytes(self.a.id_to_token(i), letters) for i in range(size)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        # Ids as written in groups, each with the mark that may follow it.
        self.written_a, self.written_b = (
            np.array([f"{i}{mark}" for i in range(n) for mark in marks], object)
            for n, marks in ((size, ",|"), (len(self.bytes_b), ",;")))
        self.sizes_a, self.sizes_b = (np.fromiter(map(len, names), np.int64, len(names)) for names in (self.bytes_a, self.bytes_b))
        self.safe = all("▁" not in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))

    @staticmethod
    def _letters_to_bytes(token: str | None, letters: dict[str, int]) -> bytes:
        if token is None:
            return b""
        return bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def chunks(self, text: str) -> Iterator[list[str]]:
        """The text's chunks, section by section; each stands for one blank and itself."""
        start = 0
        while start < len(text):
            cut = SAFE.search(text, start + SECTION) if self.safe else None
            end = cut.start() if cut else len(text)
            part = text[start:end]
            yield SAFE.split(part) if self.safe else [part]
            start = end + 1

    def encode(self, chunks: list[str], batch: int = 10_000) -> tuple[list[list[int]], list[list[int]]]:
        ids_a, ids_b = [], []
        for start in range(0, len(chunks), batch):
            part = chunks[start:start + batch]
            ids_a += [e.ids for e in self.a.encode_batch([" " + c for c in part], add_special_tokens=False)]
            ids_b += self.b.encode(part, num_threads=1)
        return ids_a, ids_b


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Borders of the rows, and all their numbers."""
    ptr = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))]).astype(np.int64)
    return ptr, np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(ptr[-1]))


def _gives_back(ids: list[list[int]], names: list[bytes], sizes: np.ndarray, whole: list[bytes]) -> np.ndarray:
    """Whether the bytes of each row's tokens are the chunk's."""
    ptr, flat = _flat(ids)
    upto = np.concatenate([[0], np.cumsum(sizes[flat])])
    want = np.fromiter(map(len, whole), np.int64, len(whole))
    if (np.diff(upto[ptr]) == want).all() and b"".join(map(names.__getitem__, flat.tolist())) == b"".join(whole):
        return np.ones(len(whole), bool)
    return np.fromiter((b"".join(map(names.__getitem__, row)) == w for row, w in zip(ids, whole)), bool, len(whole))


class Aligned:
    """Chunks as encoded by both tokenizers, with their groups and links.

    ``good`` says whether the bytes of both give the chunk back; others have no tokens. Arrays named ``a_...`` have one
    value per token of A, ``link_...`` one per overlap link; ``*_ptr`` are the chunks' borders in them.
    """

    def __init__(self, tools: Tokenizers, chunks: list[str]):
        ids_a, ids_b = tools.encode(chunks)
        whole = [(" " + c).encode() for c in chunks]
        self.good = (_gives_back(ids_a, tools.bytes_a, tools.sizes_a, whole)
                     & _gives_back(ids_b, tools.bytes_b, tools.sizes_b, whole))
        if not self.good.all():
            ids_a, ids_b, whole = ([x if good else x[:0] for x, good in zip(row, self.good)] for row in (ids_a, ids_b, whole))
        self.tools = tools
        (self.a_ptr, self.a_id), (self.b_ptr, self.b_id) = _flat(ids_a), _flat(ids_b)
        a, b = tiles(tools.sizes_a[self.a_id]), tiles(tools.sizes_b[self.b_id])
        self.overlap = product(a, transpose(b))
        # Groups end where both tokenizers end a token; the group of a token is the number of such ends before its own.
        both = np.zeros(a.columns + 1, bool)
        both[a.indptr[1:]] = True
        other = np.zeros(a.columns + 1, bool)
        other[b.indptr[1:]] = True
        ended = np.cumsum(both & other)
        self.a_group, self.b_group = (ended[m.indptr[1:] - 1] for m in (a, b))
        groups = int(ended[-1])
        self.group_a, self.group_b = (transpose(Csr(np.arange(len(of) + 1), of, np.ones(len(of), np.int64), groups))
                                      for of in (self.a_group, self.b_group))
        self.group_ptr = ended[np.concatenate([[0], np.cumsum(np.fromiter(map(len, whole), np.int64, len(whole)))])]
        self.link_ptr = self.overlap.indptr[self.a_ptr]
        self.pair = (self.a_id[self.overlap.row_of()] << PAIR_BITS) | self.b_id[self.overlap.indices]
        # One row per token of A: the tokens of B that share its group.
        self.shared_sizes = product_sizes(transpose(self.group_a), self.group_b)

    def shared(self) -> Csr:
        """Shared-group links: the group-incidence product."""
        return product(transpose(self.group_a), self.group_b)

    def written_groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2;`` of each chunk."""
        last_a, last_b = (np.concatenate([g[1:] != g[:-1], np.ones(min(len(g), 1), bool)]) for g in (self.a_group, self.b_group))
        pieces = np.concatenate([self.tools.written_a[2 * self.a_id + last_a], self.tools.written_b[2 * self.b_id + last_b]])
        order = np.argsort(np.concatenate([2 * self.a_group, 2 * self.b_group + 1]), kind="stable")
        pieces, ptr = pieces[order].tolist(), (self.a_ptr + self.b_ptr).tolist()
        return ["".join(pieces[a:b]) for a, b in zip(ptr, ptr[1:])]


def blocks_of(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Keys and texts of consecutive rows, about ``block_bytes`` of text at a time; a longer text is alone."""
    for batch in batches:
        texts = values(batch.column(1))
        start = size = 0
        for i, text in enumerate(texts):
            if size and size + len(text) > block_bytes:
                yield batch.column(0).slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(text)
        if start < len(texts):
            yield batch.column(0).slice(start), texts[start:]


def number_chunks(tools: Tokenizers, texts: list[bytes]) -> tuple[list[str], list[np.ndarray]]:
    """The distinct chunks of a block, and each text as their numbers."""
    number: dict[str, int] = defaultdict()
    number.default_factory = number.__len__
    out = []
    for text in texts:
        parts = [np.fromiter(map(number.__getitem__, part), np.int32, len(part)) for part in tools.chunks(text.decode())]
        out.append(np.concatenate(parts) if parts else np.zeros(0, np.int32))
    return list(number), out


def _summed(cell: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order, with the sums of their weights."""
    cells, place = np.unique(cell, return_inverse=True)
    return cells, np.bincount(place, weights=weight, minlength=len(cells)).astype(np.int64)


def _block(tools: Tokenizers, texts: list[bytes]) -> dict[str, object]:
    chunks, docs = number_chunks(tools, texts)
    made = Aligned(tools, chunks)
    fit = [made.good[d].all() for d in docs]
    docs = [d if ok else d[:0] for d, ok in zip(docs, fit)]
    written = made.written_groups()
    hashes = [hashlib.sha256("".join(map(written.__getitem__, d.tolist()))[:-1].encode()).hexdigest() if len(d) else ""
              for d in docs]
    flat = np.concatenate(docs) if docs else np.zeros(0, np.int32)
    ends = np.cumsum([len(d) for d in docs])

    def total(per_chunk: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(per_chunk[flat])])
        return upto[ends] - upto[np.concatenate([[0], ends[:-1]]).astype(np.int64)]

    shared = np.concatenate([[0], np.cumsum(made.shared_sizes)])[made.a_ptr]
    # Documents by chunks, then by the pairs of these chunks: the second sparse product of a block.
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    cell, times = np.unique(doc * max(len(chunks), 1) + flat, return_counts=True)
    doc, chunk = np.divmod(cell, max(len(chunks), 1))
    pairs, place = np.unique(made.pair, return_inverse=True)
    width = np.diff(made.link_ptr)[chunk]
    where = ranges(made.link_ptr[chunk], width)
    cell, times = _summed(np.repeat(doc, width) * max(len(pairs), 1) + place[where], np.repeat(times, width))
    doc, at = np.divmod(cell, max(len(pairs), 1))
    return {
        "n_a": total(np.diff(made.a_ptr)), "n_b": total(np.diff(made.b_ptr)), "n_groups": total(np.diff(made.group_ptr)),
        "n_links": total(np.diff(made.link_ptr)), "n_shared_links": total(np.diff(shared)), "groups_sha256": hashes,
        "ptr": np.searchsorted(doc, np.arange(len(docs) + 1)), "at": at, "times": times,
        "pairs": pairs, "counts": np.bincount(at, weights=times, minlength=len(pairs)).astype(np.int64),
    }


_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_shared_links")


def _lists(ptr: np.ndarray, items: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(items, kind))


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text",
          block_bytes: int = 4 << 20) -> DataFrame:
    """Per document: ``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared_links``.

    ``path_a`` is a byte-level file of the tokenizers library, ``path_b`` a sentencepiece model that puts a blank before each
    text; both lie on every worker. Texts that are null or empty, or that either tokenizer does not give back byte for byte,
    have zeros and an empty ``groups_sha256``. Rows are independent: repeated and null keys stay as they are, other columns
    are left out, an empty table gives an empty result. A pair's count is over all documents; ``n_best`` counts the links
    whose pair is the most frequent of its id of B, ties included. A text without a safe place to cut is encoded whole.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Tokenizers(path_a, path_b)
        first = TaskContext.get().partitionId() << 32
        for number, (keys, texts) in enumerate(blocks_of(batches, block_bytes)):
            made, n = _block(tools, texts), len(texts)
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([keys, pa.nulls(1, keys.type)]), pa.array(np.full(n + 1, first + number)),
                *[pa.concat_arrays([pa.array(made[c], pa.int64()), none]) for c in _COUNTS],
                pa.array([*made["groups_sha256"], None], pa.string()),
                pa.concat_arrays([_lists(made["ptr"], made["at"], pa.int32()), pa.nulls(1, pa.list_(pa.int32()))]),
                pa.concat_arrays([_lists(made["ptr"], made["times"], pa.int64()), pa.nulls(1, pa.list_(pa.int64()))]),
                pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), pa.array([made["pairs"]], pa.list_(pa.int64()))]),
                pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), pa.array([made["counts"]], pa.list_(pa.int64()))]),
            ], ["key", "block", *_COUNTS, "groups_sha256", "at", "times", "pairs", "counts"])

    made = stage(arrow_map(
        rows, cut, f"key {kind.simpleString()}, block long, " + ", ".join(f"{c} long" for c in _COUNTS) +
        ", groups_sha256 string, at array<int>, times array<bigint>, pairs array<bigint>, counts array<bigint>"), "alignment")
    entries = (made.filter(F.col("pairs").isNotNull())
               .select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "entry"))
               .select("block", "at", F.col("entry.pairs").alias("pair"), F.col("entry.counts").alias("n")))
    totals = entries.groupBy("pair").agg(F.sum("n").alias("total"))
    top = (totals.groupBy((F.col("pair") % (1 << PAIR_BITS)).alias("b")).agg(F.max("total").alias("highest")))
    totals = (totals.join(top, F.col("pair") % (1 << PAIR_BITS) == F.col("b"))
              .select("pair", "total", (F.col("total") == F.col("highest")).alias("best")))
    known = entries.join(totals, "pair").select("block", "at", "total", "best")

    def weigh(docs: pa.Table, entries: pa.Table) -> pa.Table:
        size = entries.num_rows
        total, best = np.zeros(size, np.int64), np.zeros(size, bool)
        place = entries["at"].to_numpy()
        total[place], best[place] = entries["total"].to_numpy(), entries["best"].to_numpy()
        at, times = docs["at"].combine_chunks(), docs["times"].combine_chunks()
        ends = np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        place, weight = at.flatten().to_numpy(), times.flatten().to_numpy()
        for name, value in (("n_best", best[place] * weight), ("count_sum", total[place] * weight)):
            upto = np.concatenate([[0], np.cumsum(value)])
            docs = docs.append_column(name, pa.array(upto[ends[1:]] - upto[ends[:-1]], pa.int64()))
        return docs.select([*out])

    out = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared_links"]
    schema = ", ".join(f"{c} " + (kind.simpleString() if c == "key" else "string" if c == "groups_sha256" else "long") for c in out)
    texts = made.filter(F.col("pairs").isNull()).select("key", F.col("block").alias("of"), *_COUNTS, "groups_sha256",
                                                     "at", "times")
    weighed = texts.groupBy("of").cogroup(known.groupBy("block")).applyInArrow(weigh, schema)
    return weighed.withColumnRenamed("key", key)


def links(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", shared: bool = False,
          block_bytes: int = 1 << 20) -> DataFrame:
    """One row per link: ``key, a_index, b_index, a_id, b_id, weight``.

    Overlap links, with the shared bytes as weight; with ``shared``, links between tokens of one group, with weight 1.
    Indices count the tokens of a text from 0. Texts without tokens have no rows (see ``align``).
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Tokenizers(path_a, path_b)
        for keys, texts in blocks_of(batches, block_bytes):
            chunks, numbers = number_chunks(tools, texts)
            made = Aligned(tools, chunks)
            found = made.shared() if shared else made.overlap
            ptr, row = found.indptr[made.a_ptr], found.row_of()
            for i, doc in enumerate(numbers):
                if not len(doc) or not made.good[doc].all():
                    continue
                width = np.diff(ptr)[doc]
                at = ranges(ptr[doc], width)
                before_a, before_b = (np.cumsum(np.diff(p)[doc]) - np.diff(p)[doc] for p in (made.a_ptr, made.b_ptr))
                a, b = row[at], found.indices[at]
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([keys.slice(i, 1)] * len(at)) if len(at) < 2 else keys.take(pa.array(np.full(len(at), i))),
                    pa.array(a + np.repeat(before_a - made.a_ptr[doc], width)),
                    pa.array(b + np.repeat(before_b - made.b_ptr[doc], width)),
                    pa.array(made.a_id[a]), pa.array(made.b_id[b]), pa.array(found.data[at])],
                    ["key", "a_index", "b_index", "a_id", "b_id", "weight"])

    return arrow_map(rows, run, f"key {kind}, a_index long, b_index long, a_id long, b_id long, weight long").withColumnRenamed(
        "key", key)
