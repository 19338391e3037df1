"""The pipeline on a small corpus against its stages worked out one by one without Spark's plans."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.test_text_operators import brute, fill
from versehall.llm import byte_bpe, common, source_mix, surrogates, toxicity

WORD = re.compile(source_mix.WORD)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioubdgklmnrst") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(160):
        words = [word() for _ in range(rng.randint(8, 70))]
        toxic = i % 4 == 0
        if toxic:
            for bad in ("idiot", "moron", "scum"):
                words.insert(rng.randrange(len(words)), bad)
        labels.append((i, int(toxic)))
        if i % 7 == 1:
            words += ["write", "to", f"{word()}.{i}@mail.example.com", "or", "call", f"+1 (282) 555-{1000 + i}"]
        rows.append((i, " ".join(words), "en", f"src{rng.choice([0, 0, 0, 1, 2])}"))
    for i in range(160, 190):  # exact and near copies of clean documents
        words = rows[rng.choice([j for j in range(160) if j % 4])][1].split(" ")
        if i % 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "en", "src1"))
    rows += [(190, None, "en", None), (191, "", "en", "src2"), (None, "no id but text", "en", "src0"), (192, "short", None, "src1"), (192, "short", None, "src1")]
    folder = f"{common.shared_dir(spark)}/corpus"
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_run_against_single_steps(spark, corpus):
    folder, rows = corpus
    got = corpus_pipeline.run(spark, folder).collect()
    # toxicity: the trained scores decide; they must fit what was planted
    scored = toxicity.score(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    left = [(r["doc_id"], r["text"], r["source"]) for r in scored if r["toxicity"] < 0.5]
    planted = {i for i, t, _, _ in rows if t and re.search("idiot|moron|scum", t)}
    kept_ids = {i for i, _, _ in left}
    assert len(planted & kept_ids) <= 2 and len(set(range(160)) - planted - kept_ids) <= 4
    # near-duplicates by comparing all pairs
    groups = brute([(i, t) for i, t, _ in left if i is not None], 80)
    stay = {i: (t, s) for i, t, s in left if i is None or groups[i][1] == i}
    # surrogates keep words and sizes, so the mix can be worked out from the old texts
    sizes = defaultdict(int)
    for t, s in stay.values():
        sizes[s] += len(WORD.findall(t or ""))
    target, taken, times = fill(sizes, (3, 1, 2), 1.5, 2.0), defaultdict(int), Counter(r["doc_id"] for r in got)
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.parse_ranks(open(P.path(corpus_pipeline.RANKS))), special_tokens={})
    for r in got:
        text, source = stay[r["doc_id"]]
        assert r["source"] == source and times[r["doc_id"]] <= 2
        new = want.decode_bytes(r["ids"]).decode()
        assert r["ids"] == want.encode_ordinary(new) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert len(WORD.findall(new)) == len(WORD.findall(text or ""))
        for _, _, kind, value in surrogates.find(text or ""):
            assert value not in new or kind.startswith(("given", "family"))
        if not surrogates.find(text or ""):
            assert new == (text or "")
        taken[source] += len(WORD.findall(new))
    longest = max(len(WORD.findall(t or "")) for t, _ in stay.values())
    assert all(abs(taken[s] - target[s]) <= longest for s in sizes)


def test_stages_return_document_columns(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS size", "'x' AS u", "2.0D AS toxicity", "3 AS id", "4L AS repeats", "5L AS n_entities")
    for empty in (False, True):
        d = docs.limit(0) if empty else docs
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, d, folder)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert (out.count() == 0) == empty
