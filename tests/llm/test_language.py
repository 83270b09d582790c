import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelode.llm import language
from pagelode.llm.language import Words, identify, parts_of, spans, viterbi, word_grams

WORDS = {
    "de": "der die und nicht mit eine auf werden schon strasse zwischen Wörter",
    "en": "the of and which with this from would though street between words",
    "ru": "и в не на что это быть весь который слово между улица",
}


def prose(lang, n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS[lang].split(), n))


def best_path(emission, penalty):
    paths = itertools.product(range(emission.shape[1]), repeat=len(emission))
    return max(sum(e[s] for e, s in zip(emission, p)) - penalty * sum(a != b for a, b in zip(p, p[1:])) for p in paths)


@pytest.mark.parametrize("segment", [1, 3, 4096])
def test_viterbi_equals_all_paths(segment):
    rng = np.random.default_rng(4)
    emission = rng.normal(size=(9, 3)) * 2
    ptr = np.array([0, 7, 7, 8, 16])
    words = rng.integers(0, 9, 16)
    labels = viterbi(emission, words, ptr, 1.5, segment)
    for a, b in zip(ptr, ptr[1:]):
        if a < b:
            seen, path = emission[words[a:b]], labels[a:b]
            got = sum(seen[np.arange(b - a), path]) - 1.5 * np.count_nonzero(np.diff(path))
            assert abs(got - best_path(seen, 1.5)) < 1e-9


def test_words_and_grams():
    words = Words()
    first, ptr = words.add(["Ab cd-ab, 12 ½ x_y", "", "ab", "словоword漢字", "naïve é"])
    distinct = list(words.numbers)
    assert [distinct[w] for w in first] == ["ab", "cd", "ab", "x", "y", "ab", "слово", "word", "漢字", "naïve", "é"]
    assert ptr.tolist() == [0, 5, 5, 6, 9, 11]
    again, _ = words.add(["new Ab слово"])
    assert [list(words.numbers)[w] for w in again] == ["new", "ab", "слово"]
    keys, owner, scripts = word_grams(distinct)
    for number, word in enumerate(distinct):
        padded = f" {word} "
        want = len(word) + sum(max(0, len(padded) - n + 1) for n in (2, 3, 4))
        assert np.count_nonzero(owner == number) == want
    assert len(set(scripts.tolist())) == 3
    assert parts_of("a" * 70) == [(0, 32), (32, 64), (64, 70)] and parts_of("½") == []


def corpus():
    return [(i, prose(lang, 30, i), lang) for i, lang in enumerate(itertools.islice(itertools.cycle(WORDS), 90))]


def test_mixed_texts_are_cut_into_spans(spark):
    mixed = prose("de", 12, 1) + ". " + prose("ru", 3, 2) + ", " + prose("en", 15, 3)
    docs = spark.createDataFrame(corpus() + [(1000, mixed, None)], "doc_id long, text string, lang string")
    got = sorted(spans(docs).filter("doc_id = 1000").collect(), key=lambda r: r.start)
    assert [r.lang for r in got] == ["de", "ru", "en"]
    assert [mixed[r.start:r.end] for r in got] == [prose("de", 12, 1), prose("ru", 3, 2), prose("en", 15, 3)]


def test_held_out_rows_are_found_and_not_learned(spark):
    rows = corpus()
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    wrong = [(i, t, "xx" if i in held else lang) for i, t, lang in rows]
    docs = spark.createDataFrame([(*r, 1.0, "b") for r in wrong], "doc_id long, text string, lang string, score double, block string")
    got = {r.doc_id: r for r in identify(docs.repartition(3), block_bytes=300).collect()}
    assert {i for i, r in got.items() if r.held_out} == held
    assert all(got[i].lang_pred == lang and 0.5 < got[i].score <= 1 for i, _, lang in rows)


def test_defined_cases(spark):
    rows = corpus() + [(None, prose("en", 9, 5), "en"), (None, prose("en", 9, 5), "en"), (200, None, "en"), (201, "", None),
                       (202, "12 -- ½ !", "de"), (203, "Ελληνικά", None), (204, prose("de", 6000, 6), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by_id[200] == by_id[201] == by_id[202] == ("und", 0.0)
    assert by_id[203][0] in WORDS and by_id[204][0] == "de" and by_id[None][0] == "en"
    assert identify(docs.filter("doc_id < 0")).count() == 0
    unlearned = identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlearned} == {("und", 0.0)}


def test_sections_join_to_the_text(monkeypatch):
    monkeypatch.setattr(language, "SECTION", 10)
    text = "one two  three verylongwordwithoutablank \n four " * 5
    assert "".join(part for _, part in language.sections(text)) == text
    words = Words()
    found, _ = words.add([text])
    assert [list(words.numbers)[w] for w in found] == text.split()


def test_sample_has_a_bound(spark):
    docs = spark.createDataFrame(corpus() * 3, "doc_id long, text string, lang string")
    got = identify(docs, fit_chars=400).collect()
    right = {i: lang for i, _, lang in corpus()}
    assert sum(r.lang_pred == right[r.doc_id] for r in got) > 0.9 * len(got)
    model = language.fit(docs, "text", "lang", F.lit(True), 400, 0.5)
    assert model.languages == ["de", "en", "ru"] and len(model.grams) < 2000
