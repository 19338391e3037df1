"""Token counts against the library, with chunks small enough that every kind of seam occurs."""

import random

import public_tokenizers as P
import pytest
import sentencepiece

from versehall.llm import token_counts

MODEL = P.path("piece_bpe_32k.model")
ODD = ["", None, " ", "a", "word " * 3000, "日本語 text 😀 é", "<s> </s> <unk>", "x\x00y ▁z", "same", "same"]
#: runs in which no two chunks need agree, so that overlaps widen and chunks join
RUNS = ["a" * 3000, "ab" * 2000, " " * 3000, "=-" * 1000 + "word " * 300 + "=" * 2000, "日本語😀" * 700, " the the  \n" * 300]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in enumerate(texts)], "doc_id long, text string, row long, text_ long, start long, row_ string")


def test_counts_against_library(spark, library):
    rng = random.Random(5)
    mixed = ["".join(rng.choice("abcdeé日 \n\t.😀 the<s>") for _ in range(rng.randint(300, 3000))) for _ in range(8)]
    mixed += ["".join(rng.choice("ab") for _ in range(2500)) for _ in range(3)]
    texts = ODD + RUNS + mixed
    got = {r.doc_id: r for r in token_counts.count_tokens(docs_of(spark, texts), MODEL, limit=100, chunk=200, overlap=16).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n = len(library.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 100), (i, t and t[:20])


def test_seams_are_widened_and_joined(spark, library):
    """A run whose chunks start out of step has failing seams; a plain text has none."""
    with open(MODEL, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    for text, fails in (("a" * 3000, True), ("plain words in a row " * 100, False)):
        docs = spark.createDataFrame([(0, text, [(k * 203, min((k + 1) * 203, len(text)), 16, 16) for k in range(len(text) // 203)])], f"row long, text string, specs {token_counts._SPEC}")
        seams = token_counts._seams(token_counts._encode(token_counts._cut(docs), model)).cache()
        assert bool(seams.where("fail").count()) is fails
        if fails:
            state = token_counts._widen(seams)
            assert state.where("redo AND over > 16").count() > 0 and state.count() <= seams.count()


def test_keep_and_empty(spark):
    docs = docs_of(spark, ["a b c", "d" * 900])
    got = token_counts.count_tokens(docs, MODEL, keep=("doc_id", "row", "text_", "row_", "start"), chunk=100, overlap=10)
    assert got.columns == ["doc_id", "row", "text_", "row_", "start", "n_bytes", "n_tokens", "over_limit"] and got.count() == 2
    assert token_counts.count_tokens(docs.limit(0), MODEL).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, MODEL, chunk=10, overlap=11)
