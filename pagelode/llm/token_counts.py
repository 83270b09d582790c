"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, by_bytes, values

#: Places where a text can be cut without changing its tokens: one blank between two characters
#: that are not blanks. No piece of the vocabulary has a blank after another character, and the
#: library puts a blank before each text, which stands for the one that the cut takes.
SAFE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")


def _safe_vocabulary(model) -> bool:
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return all("▁" not in piece.lstrip("▁") for piece in pieces)


class Counter:
    """Counts tokens; the counts of recent chunks are kept up to a bound of ``cache_bytes``."""

    def __init__(self, path: str, batch_bytes: int, cache_bytes: int):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cut = SAFE.split if _safe_vocabulary(self.model) else lambda text: [text]
        self.batch_bytes, self.cache_bytes = batch_bytes, cache_bytes
        self.known: dict[str, int] = {}
        self.held = 0

    def _learn(self, chunks: list[str]) -> None:
        sized = [c.encode() for c in chunks]
        for start, end in by_bytes(sized, self.batch_bytes):
            encoded = self.model.encode(chunks[start:end], num_threads=1)
            self.known.update(zip(chunks[start:end], map(len, encoded)))
        self.held += sum(map(len, sized)) + 100 * len(sized)

    def count(self, texts: list[str]) -> list[int]:
        parts = [self.cut(text) for text in texts]
        if self.held > self.cache_bytes:
            self.known, self.held = {}, 0
        new = set().union(*parts).difference(self.known)
        self._learn(sorted(new))
        known = self.known
        return [sum(map(known.__getitem__, part)) if text else 0 for text, part in zip(texts, parts)]


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 4096,
                 batch_bytes: int = 1 << 20, cache_bytes: int = 48 << 20) -> DataFrame:
    """Bytes and tokens of every text: ``key, n_bytes, n_tokens, over_limit``.

    ``path`` is a sentencepiece model on every worker. Texts are encoded whole, in batches of about
    ``batch_bytes``, cut at safe places only (see ``SAFE``); a text without such a place stays whole.
    No begin, end or special tokens. Null and empty texts have 0 bytes and 0 tokens; null keys,
    repeated rows and other columns are carried or ignored, row by row. No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, batch_bytes, cache_bytes)
        for batch in batches:
            raw = values(batch.column(1))
            counts: list[int] = []
            for start, end in by_bytes(raw, batch_bytes):
                counts += counter.count([t.decode() for t in raw[start:end]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(counts, pa.int64())],
                ["key", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    counted = arrow_map(rows, run, f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
