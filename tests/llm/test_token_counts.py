import public_tokenizers
import sentencepiece

from pagelode.llm.token_counts import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  ", "a b", "a  b", " a", "a ", "a\nb c", "<s> x </s>", "é ñ　b", "▁a b▁ c", "a ▁b", "x" * 5000,
         "word " * 30000, "zwei  drei vier\t\tfünf \n six", "🙂 🙂🙂 a\x00b", "same", "same"]


def test_counts_equal_whole_encoding(spark):
    rows = [(i if i != 3 else None, t, 1) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id if r.doc_id is not None else 3, r.n_bytes, r.n_tokens, r.over_limit)
                 for r in token_counts(docs, PATH, batch_bytes=1000, cache_bytes=2000).collect())
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = []
    for i, t in enumerate(TEXTS):
        n = len(model.encode(t or ""))
        want.append((i, len((t or "").encode()), n, n > 4096))
    assert got == want


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
