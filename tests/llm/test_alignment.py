import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pagelode.llm import csr
from pagelode.llm.alignment import _byte_letters, align, links

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  ", "a b", "a  b", " a", "a ", "a\n b \nc", "a\n \nb", "x  y  z", "<s> x </s> <|endoftext|> <0x41>",
         "é ñ　b naïve", "▁a b▁ c", "a ▁b", "tokenization of unhappiness", "x" * 3000, "word " * 3000, "it' s 're we'll",
         "zwei  drei vier\t\tfünf \n six", "🙂 🙂🙂 a\x00b 日本語の文", "same text here", "same text here", "of the of the of the",
         "Schifffahrt internationalization " * 40]


def token_spans(text, model_a, model_b, letters):
    """Ids and byte ends of both tokenizers over the whole text, or None where the bytes differ."""
    whole = (" " + text).encode()
    ids_a = model_a.encode(" " + text, add_special_tokens=False).ids
    ids_b = model_b.encode(text)
    bytes_a = [bytes(letters[c] for c in model_a.id_to_token(i)) for i in ids_a if i != 50256]
    bytes_b = [bytes([int(model_b.id_to_piece(i)[3:5], 16)]) if model_b.is_byte(i) else model_b.id_to_piece(i).replace("▁", " ").encode()
               for i in ids_b]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return None
    return ids_a, np.cumsum([*map(len, bytes_a)]), ids_b, np.cumsum([*map(len, bytes_b)])


def brute(texts):
    model_a, model_b, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), _byte_letters()
    model_a.encode_special_tokens = True
    spans = [token_spans(t, model_a, model_b, letters) if t else None for t in texts]
    overlaps, shared, groups = [], [], []
    for s in spans:
        pairs, together, written = [], [], []
        if s:
            ids_a, ends_a, ids_b, ends_b = s
            starts_a, starts_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
            pairs = [(i, j, int(min(ends_a[i], ends_b[j]) - max(starts_a[i], starts_b[j])))
                     for i in range(len(ids_a)) for j in range(len(ids_b))
                     if starts_a[i] < ends_b[j] and starts_b[j] < ends_a[i]]
            last = 0
            for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
                a = [i for i in range(len(ids_a)) if last < ends_a[i] <= end]
                b = [j for j in range(len(ids_b)) if last < ends_b[j] <= end]
                written.append(",".join(str(ids_a[i]) for i in a) + "|" + ",".join(str(ids_b[j]) for j in b))
                together += [(i, j, 1) for i in a for j in b]
                last = end
        overlaps.append(pairs), shared.append(together), groups.append(written)
    counts = Counter((s[0][i], s[2][j]) for s, pairs in zip(spans, overlaps) if s for i, j, _ in pairs)
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    rows = []
    for s, pairs, together, written in zip(spans, overlaps, shared, groups):
        ids = [(s[0][i], s[2][j]) for i, j, _ in pairs]
        rows.append((len(s[0]) if s else 0, len(s[2]) if s else 0, len(written), len(pairs),
                     sum(counts[p] == highest[p[1]] for p in ids), sum(counts[p] for p in ids),
                     hashlib.sha256(";".join(written).encode()).hexdigest() if s else "", len(together)))
    return rows, overlaps, shared


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared_links")


@pytest.mark.parametrize("block", [200, 1 << 22])
def test_equals_whole_encoding(spark, block):
    # Columns that the operator makes itself are clashing extra columns here.
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_a int, pairs string")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align(docs.repartition(3), A, B, block_bytes=block).collect()}
    assert [got[i] for i in range(len(TEXTS))] == brute(TEXTS)[0]


def test_links(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    _, overlaps, shared = brute(TEXTS)
    for want, flag in ((overlaps, False), (shared, True)):
        got = links(docs, A, B, shared=flag, block_bytes=500).collect()
        assert sorted((r.doc_id, r.a_index, r.b_index, r.weight) for r in got) == sorted(
            (d, *link) for d, found in enumerate(want) for link in found)


def test_long_text_is_cut_only_at_safe_places(spark, monkeypatch):
    import pagelode.llm.alignment as module
    monkeypatch.setattr(module, "SECTION", 64)
    text = "the  quick\n brown ▁fox can't  jump  over \n\n it " * 50
    tools = module.Tokenizers(A, B)
    assert " ".join(c for part in tools.chunks(text) for c in part) == text
    made = module._block(tools, [text.encode()])
    want = brute([text.replace("▁", "")])[0][0]
    assert made["groups_sha256"] == [""]
    assert module._block(tools, [text.replace("▁", "").encode()])["groups_sha256"] == [want[6]]


def test_null_keys_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None), (1, "a b")], "doc_id long, text string")
    got = align(docs, A, B).collect()
    assert sorted((r.doc_id or 0, r.n_links, r.count_sum) for r in got) == [(0, 2, 6), (0, 2, 6), (1, 0, 0), (1, 2, 6)]
    assert align(docs.filter("doc_id > 5"), A, B).count() == 0
    assert links(docs.filter("doc_id > 5"), A, B).count() == 0
    assert align(docs.filter("text is null"), A, B).first().groups_sha256 == ""


def test_products_equal_dense_ones():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x, y = (rng.integers(0, 3, (rng.integers(1, 8), 6)) * rng.integers(0, 2) for _ in range(2))
        made = []
        for m in (x, y.T):
            r, c = np.nonzero(m)
            made.append(csr.Csr(np.searchsorted(r, np.arange(len(m) + 1)), c, m[r, c], m.shape[1]))
        p = csr.product(*made)
        dense = np.zeros((len(x), len(y)), np.int64)
        dense[p.row_of(), p.indices] = p.data
        assert (dense == x @ y.T).all()
        assert (csr.product_sizes(*made) == ((x != 0).astype(int) @ (y.T != 0).sum(1))).all()
