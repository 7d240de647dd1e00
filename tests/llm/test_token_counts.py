import public_tokenizers
import pytest
import sentencepiece
from tickforge.llm import token_counts as tc

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def whole():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 5), (300, 16), (1000, 100)])
def test_spliced_counts_equal_whole_counts(spark, whole, chunk, overlap):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    texts += ["a" * 3000, "  " * 900 + "x y" * 500, "é▁ ü▁▁ " * 300, "日本語 テキスト" * 200, "\n\t " * 700, " " * 3000,
              "word " * 900 + "x" * 2000 + " end" * 500, "<s> </s> <unk> " * 200]
    counter = tc.PieceCounter(MODEL, chunk, overlap)
    assert counter.provable
    assert counter.count(texts) == [len(x) for x in whole.encode(texts)]


def test_rows(odd, none, whole):
    rows = tc.token_counts(odd, MODEL).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(whole.encode(r.text or ""))) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in rows) and any(r.over_limit for r in rows)
    assert tc.token_counts(none, MODEL).count() == 0


def test_vocabulary_file(odd):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = sorted((str(r.doc_id), r.n_tokens) for r in tc.token_counts(odd, path).collect())
    assert got == sorted((str(r.doc_id), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
