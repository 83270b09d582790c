"""Language identification: scripts narrow the candidates, Viterbi over words labels the spans of a text.

A word's score under a language is the log probability of its character n-grams (1 to 4, with the blanks around a word). The
path through a text's words that has the best sum of scores, less a penalty for each change of language, gives the spans.

The model is fitted on a sample of the learning rows that holds about ``fit_chars`` characters per language, drawn by hash, so
its size has a bound at any size of corpus and it can be sent to every worker; texts are then scored where they lie, without a
shuffle. (A model of all rows, joined with dictionaries of blocks of texts, was tried first: it shuffled every text.)
"""

from __future__ import annotations

import itertools
import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, by_bytes, fold, values
from .csr import ranges

SIZES = (1, 2, 3, 4)
#: Longer words are scored in pieces of this many letters.
PIECE = 32
#: Long texts are read section by section, cut at white space.
SECTION = 1 << 20
SPACE = re.compile(r"\s")
#: A language is a candidate for a script that holds at least this share of its words.
SHARE = 0.01
UNKNOWN = "und"
#: The first code points of stretches of one script, by Unicode blocks.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "NKo"), (0x0800, "Other"), (0x08A0, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"),
    (0x1400, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"),
    (0x1CC0, "Other"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C80, "Greek"), (0x2D00, "Georgian"),
    (0x2D30, "Tifinagh"), (0x2D80, "Ethiopic"), (0x2DE0, "Cyrillic"), (0x2E00, "Other"), (0x2E80, "Han"), (0x3040, "Kana"),
    (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31A0, "Bopomofo"), (0x31C0, "Han"), (0x31F0, "Kana"),
    (0x3200, "Han"), (0xA000, "Yi"), (0xA4D0, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"),
    (0xA800, "Other"), (0xAB30, "Latin"), (0xAB70, "Cherokee"), (0xABC0, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"),
    (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"),
    (0x40000, "Other"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT_OF = np.array([_NAMES.index(name) for _, name in SCRIPTS])
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_SIZE_SHIFT = 60


@lru_cache(1)
def word_pattern() -> re.Pattern:
    """Runs of letters and of marks that follow them."""
    marks, start = [], None
    for point in itertools.chain(range(0x300, min(sys.maxunicode, 0x1F000)), [0]):
        mark = point and unicodedata.category(chr(point))[0] == "M"
        if mark and start is None:
            start = point
        elif not mark and start is not None:
            marks.append(f"{chr(start)}-{chr(last)}")
            start = None
        last = point
    return re.compile(r"[^\W\d_](?:[^\W\d_]|[" + "".join(marks) + "])*")


def script_of(letter: str) -> int:
    return int(_SCRIPT_OF[np.searchsorted(_STARTS, ord(letter), side="right") - 1])


def parts_of(run: str) -> list[tuple[int, int]]:
    """Ranges of a run in one script and of at most ``PIECE`` characters; none where the run has no letter."""
    if not any(map(str.isalpha, run)):
        return []
    if run.isascii():
        borders = [0, len(run)]
    else:
        scripts = []
        for c in run:
            scripts.append(script_of(c) if c.isalpha() or not scripts else scripts[-1])
        borders = [0, *(i for i in range(1, len(run)) if scripts[i] != scripts[i - 1]), len(run)]
    return [(s, min(s + PIECE, b)) for a, b in zip(borders, borders[1:]) for s in range(a, b, PIECE)]


def sections(text: str) -> Iterator[tuple[int, str]]:
    start = 0
    while start < len(text):
        cut = SPACE.search(text, start + SECTION)
        end = cut.start() if cut else len(text)
        yield start, text[start:end]
        start = end


class Words:
    """Distinct words of texts, numbered as they come; a text becomes the sequence of its words' numbers."""

    def __init__(self):
        self.runs: dict[str, int] = defaultdict()
        self.runs.default_factory = self.runs.__len__
        self.numbers: dict[str, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.counts, self.pieces = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts one after the other, and the texts' borders in them."""
        known = len(self.runs)
        find, number = word_pattern().findall, self.runs.__getitem__
        runs, ends = [], [0]
        for text in texts:
            found = [np.fromiter(map(number, part), np.int64, len(part))
                     for part in (find(section) for _, section in sections(text))]
            runs += found
            ends.append(ends[-1] + sum(map(len, found)))
        flat = np.concatenate(runs) if runs else np.zeros(0, np.int64)
        cut = [(parts_of(run), run) for run in itertools.islice(self.runs, known, None)]
        self.pieces = np.concatenate([self.pieces, np.array(
            [self.numbers[run[a:b].lower()] for parts, run in cut for a, b in parts], np.int64)])
        self.counts = np.concatenate([self.counts, np.array([len(parts) for parts, _ in cut], np.int64)])
        width = self.counts[flat]
        upto = np.concatenate([[0], np.cumsum(width)])
        return self.pieces[ranges((np.cumsum(self.counts) - self.counts)[flat], width)], upto[np.array(ends)]


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of words, the word that each is in, and the words' scripts.

    An n-gram is a 63-bit number with its size in the first bits; the blanks around a word belong to it.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    line = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32)
    blank = line == 32
    word_of, blanks = np.cumsum(blank) - 1, np.concatenate([[0], np.cumsum(blank)])
    rolled, wide = np.zeros(len(line), np.uint64), line.astype(np.uint64)
    keys, owners = [], []
    for size in SIZES:
        n = len(line) - size + 1
        if n <= 0:
            break
        rolled = rolled[:n] * _MULTIPLY + wide[size - 1:]
        inner = blanks[size - 1:size - 1 + n] - blanks[1:n + 1] if size > 1 else blank.astype(int)
        at = np.flatnonzero(inner == 0)
        mixed = rolled[at] * _MULTIPLY
        mixed ^= mixed >> np.uint64(31)
        mixed *= _MULTIPLY
        keys.append((mixed >> np.uint64(4)).astype(np.int64) | (size << _SIZE_SHIFT))
        owners.append(word_of[at])
    scripts = _SCRIPT_OF[np.searchsorted(_STARTS, line[np.flatnonzero(blank)[:-1] + 1], side="right") - 1]
    return np.concatenate(keys), np.concatenate(owners), scripts


class Model:
    """Log probabilities of n-grams under each language, and the languages of each script."""

    def __init__(self, languages: list[str], grams: np.ndarray, counts: np.ndarray, smooth: float):
        """``counts``: n-grams by languages, for the sorted ``grams``; numbers of size 0 are scripts."""
        self.languages, size = languages, grams >> _SIZE_SHIFT
        totals = np.stack([counts[size == n].sum(axis=0) for n in (0, *SIZES)])
        kinds = np.bincount(size, minlength=len(SIZES) + 1)[:, None]
        self.grams = grams[size > 0]
        self.log = np.log((counts[size > 0] + smooth) / (totals + smooth * (kinds + 1))[size[size > 0]])
        self.unseen = np.log(smooth / (totals + smooth * (kinds + 1)))
        seen = np.zeros((len(_NAMES), len(languages)))
        seen[grams[size == 0]] = counts[size == 0]
        self.candidate = seen >= np.maximum(SHARE * totals[0], 1)
        self.candidate |= ~self.candidate.any(axis=1, keepdims=True)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of each word under each language; languages that its script rules out have a very low one."""
        keys, owner, scripts = word_grams(words)
        distinct, place = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.grams, distinct), max(len(self.grams) - 1, 0))
        log = np.where((self.grams[at] == distinct)[:, None], self.log[at], self.unseen[distinct >> _SIZE_SHIFT])
        out = np.stack([np.bincount(owner, weights=log[place, k], minlength=len(words)) for k in range(log.shape[1])], axis=1)
        return np.where(self.candidate[scripts], out / len(SIZES), -1e9)


class Labeller:
    """Labels texts; the scores of words seen before are kept up to ``most`` words."""

    def __init__(self, model: Model, penalty: float, most: int = 300_000):
        self.model, self.penalty, self.most = model, penalty, most
        self._forget()

    def _forget(self) -> None:
        self.words, self.scores = Words(), np.zeros((0, len(self.model.languages)))
        self.letters = np.zeros(0, np.int64)

    def label(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language and length of each word, and the texts' borders."""
        if len(self.letters) > self.most:
            self._forget()
        words, ptr = self.words.add(texts)
        new = list(itertools.islice(self.words.numbers, len(self.letters), None))
        if new:
            self.scores = np.concatenate([self.scores, self.model.emissions(new)])
            self.letters = np.concatenate([self.letters, np.fromiter(map(len, new), np.int64, len(new))])
        return viterbi(self.scores, words, ptr, self.penalty), self.letters[words], ptr


def viterbi(emission: np.ndarray, words: np.ndarray, ptr: np.ndarray, penalty: float, segment: int = 4096) -> np.ndarray:
    """The best language of each word: sum of emissions, less ``penalty`` per change; a tie stays.

    All texts advance together, one word a step. Longer ones are cut into segments, and all but a text's first are solved for
    each language that may come before; the segments' borders are then chosen text by text.
    """
    states, labels = emission.shape[1], np.zeros(len(words), np.int64)
    lanes = []
    for d in np.flatnonzero(np.diff(ptr)):
        for at in range(ptr[d], ptr[d + 1], segment):
            size = min(segment, ptr[d + 1] - at)
            lanes += [(at, size, -1, d)] if at == ptr[d] else [(at, size, s, d) for s in range(states)]
    if not lanes:
        return labels
    start, size, before, text = np.array(lanes).T
    order = np.argsort(-size, kind="stable")
    start, size, before, text = start[order], size[order], before[order], text[order]
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # lanes longer than t
    value, switched, best = np.zeros((len(start), states)), [], []
    for t in range(size[0]):
        n = active[t]
        v, here = value[:n], emission[words[start[:n] + t]]
        if t == 0:
            held = np.where((before[:, None] < 0) | (before[:, None] == np.arange(states)), 0.0, -penalty)
            value[:n] = here + held
            switched.append(None), best.append(None)
            continue
        top = v.argmax(axis=1)
        most = v[np.arange(n), top][:, None] - penalty
        change = v < most
        value[:n] = np.where(change, most, v) + here
        switched.append(change), best.append(top.astype(np.int16))
    # Choose lanes and their last states.
    lane_of = {(int(a), int(b)): i for i, (a, b) in enumerate(zip(start, before))}
    chosen, last = [], []
    for d in np.flatnonzero(np.diff(ptr)):
        firsts = list(range(ptr[d], ptr[d + 1], segment))
        total, steps = value[lane_of[firsts[0], -1]], []
        for at in firsts[1:]:
            moved = total[:, None] + np.stack([value[lane_of[at, s]] for s in range(states)])
            steps.append(moved.argmax(axis=0))
            total = moved.max(axis=0)
        state = int(total.argmax())
        for at, step in zip(firsts[:0:-1], steps[::-1]):
            chosen.append(lane_of[at, int(step[state])]), last.append(state)
            state = int(step[state])
        chosen.append(lane_of[firsts[0], -1]), last.append(state)
    order = np.argsort(chosen)
    chosen, state = np.array(chosen)[order], np.array(last)[order]
    many = np.searchsorted(-size[chosen], -np.arange(size[0]), side="left")
    for t in range(size[0] - 1, -1, -1):
        n = many[t]
        lane, now = chosen[:n], state[:n]
        labels[start[lane] + t] = now
        if t:
            state[:n] = np.where(switched[t][lane, now], best[t][lane], now)
    return labels


def fit(docs: DataFrame, text: str, lang: str, learn: Column, fit_chars: int, smooth: float) -> Model | None:
    """The model of a sample of the rows where ``learn`` holds; None if there is nothing to learn.

    Of each language, rows are drawn by hash with the share that gives about ``fit_chars`` characters, and of these, in the
    order of the hash, rows are taken until that many are reached: the sample is at most one text larger.
    """
    rows = (docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
            .select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")))
    measured = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars")).collect()
    if not measured:
        return None
    share = {r.lang: min(1.0, 1.2 * fit_chars / max(r.chars, 1)) for r in measured}
    table = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    place = F.xxhash64("text")
    drawn = rows.withColumn("place", place).filter(
        F.pmod("place", F.lit(1 << 30)) < F.try_element_at(table, F.col("lang")) * float(1 << 30))
    before = Window.partitionBy("lang").orderBy("place", "text").rowsBetween(Window.unboundedPreceding, -1)
    taken = drawn.withColumn("before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).filter(
        F.col("before") < fit_chars).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for code, name in enumerate(sorted(set(batch.column("lang").to_pylist()))):
                words = Words()
                mine = [t for t, x in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()) if x == name]
                flat, _ = words.add(mine)
                times = np.bincount(flat, minlength=len(words.numbers))
                keys, owner, scripts = word_grams(list(words.numbers))
                grams, place = np.unique(np.concatenate([keys, scripts]), return_inverse=True)
                n = np.bincount(place, weights=times[np.concatenate([owner, np.arange(len(scripts))])], minlength=len(grams))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams, pa.int64()),
                                                  pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    found = arrow_map(taken, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not found.num_rows:
        return None
    languages = sorted(set(found["lang"].to_pylist()))
    grams, at = np.unique(found["gram"].to_numpy(), return_inverse=True)
    counts = np.zeros((len(grams), len(languages)))
    number = {name: i for i, name in enumerate(languages)}
    counts[at, [number[x] for x in found["lang"].to_pylist()]] = found["n"].to_numpy()
    return Model(languages, grams, counts, smooth)


def _labelled(docs: DataFrame, key: str, text: str, lang: str, held: Column | None, work: Callable, schema: str,
              penalty: float, smooth: float, fit_chars: int, block_bytes: int) -> DataFrame:
    """``work(keys, held_out, texts, labels, letters, ptr, languages)`` for each block of texts, as arrays of ``schema``."""
    held_out = fold(F.col(key), 4) == 2 if held is None else held
    model = fit(docs, text, lang, ~F.coalesce(held_out, F.lit(False)), fit_chars, smooth)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias("key"), held_out.alias("held_out"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        labeller = Labeller(model, penalty) if model else None
        for batch in batches:
            texts = values(batch.column("text"))
            for start, end in by_bytes(texts, block_bytes):
                part = [t.decode() for t in texts[start:end]]
                labels, letters, ptr = labeller.label(part) if labeller else (np.zeros(0, np.int64),) * 2 + (
                    np.zeros(len(part) + 1, np.int64),)
                own = [batch.column(c).slice(start, end - start) for c in ("key", "held_out")]
                yield pa.RecordBatch.from_arrays(work(*own, part, labels, letters, ptr, model.languages if model else []), names)

    return arrow_map(rows, run, schema.format(kind=kind)).withColumnRenamed("key", key)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", held_out: Column | None = None,
             penalty: float = 6.0, smooth: float = 0.5, fit_chars: int = 4 << 20, block_bytes: int = 2 << 20) -> DataFrame:
    """Per document: ``key, held_out, lang_pred, score``.

    Learned from rows with a language that are not held out (by default crc32 of the key as text, modulo 4, is 2), from about
    ``fit_chars`` characters of each language (see ``fit``); every whole text is labelled. ``lang_pred`` is the language of most
    letters of a text by its labelled spans, the first by name among equals; ``score`` is their share. Texts that are null or
    have no letter get ``und`` and 0, and so does any text if nothing can be learned. A row's language is no input of its
    prediction but through the model. Rows are independent: null and repeated keys stay as they are; other columns are left
    out; an empty table gives an empty result. Languages are taken to be few: their scores lie side by side.
    """
    def work(keys, held, texts, labels, letters, ptr, languages) -> list[pa.Array]:
        n, k = len(texts), max(len(languages), 1)
        text_of = np.repeat(np.arange(n), np.diff(ptr))
        weight = np.bincount(text_of * k + labels, weights=letters, minlength=n * k).reshape(n, k)
        best, total = weight.argmax(axis=1), weight.sum(axis=1)
        score = weight[np.arange(n), best] / np.maximum(total, 1)
        return [keys, held, pa.array([languages[b] if t else UNKNOWN for b, t in zip(best, total)], pa.string()), pa.array(score)]

    return _labelled(docs, key, text, lang, held_out, work, "key {kind}, held_out boolean, lang_pred string, score double",
                     penalty, smooth, fit_chars, block_bytes)


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", held_out: Column | None = None,
          penalty: float = 6.0, smooth: float = 0.5, fit_chars: int = 4 << 20, block_bytes: int = 1 << 20) -> DataFrame:
    """One row per span of one language: ``key, start, end, lang``, in characters of the text from 0, ``end`` not included.

    A span goes from its first word's start to its last word's end. Texts without words have none; see ``identify`` for the rest.
    """
    def work(keys, held, texts, labels, letters, ptr, languages) -> list[pa.Array]:
        rows, out = [], ([], [], [])
        for i, value in enumerate(texts if languages else []):
            places = [(m.start() + a, m.start() + b) for m in word_pattern().finditer(value) for a, b in parts_of(m.group())]
            for label, group in itertools.groupby(zip(places, labels[ptr[i]:ptr[i + 1]].tolist()), lambda x: x[1]):
                group = [place for place, _ in group]
                rows.append(i)
                for column, x in zip(out, (group[0][0], group[-1][1], languages[label])):
                    column.append(x)
        return [keys.take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                pa.array(out[2], pa.string())]

    return _labelled(docs, key, text, lang, held_out, work, "key {kind}, start long, end long, lang string", penalty, smooth,
                     fit_chars, block_bytes)
