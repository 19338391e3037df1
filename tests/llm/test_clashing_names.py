"""Every operator on tables that have its internal names as columns of their own."""

import glob
import re

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from versehall.llm import byte_bpe, consensus_html, near_dup, source_mix, surrogates, token_counts, toxicity, warc
from versehall.llm.common import own_path

KEY = b"a key of the tests"
TEXTS = ["Mr. Smith wrote to a@b.org today and then went home", "one two three four five six seven", None, "", "one two three four five six seven"]


def internal_names():
    """Names in the sources that begin with an underscore, and what `unused` is asked for."""
    out = set()
    for path in glob.glob("versehall/llm/*.py") + ["corpus_pipeline.py"]:
        with open(path) as f:
            text = f.read()
        out |= set(re.findall(r'"(_{1,2}[a-z][a-z_]*)"', text))
        out |= {n for call in re.findall(r"unused\(([^)]*)\)", text) for n in re.findall(r'"([a-z_]+)"', call)}
    return sorted(out - {"__main__"})


NAMES = internal_names() + ["size", "u", "source_size", "target", "hit", "id", "key", "map", "node", "row", "start", "block", "conv", "at", "text_hash"]


def clashing(spark, first, schema):
    names = [n for n in dict.fromkeys(NAMES) if n not in schema]
    return spark.createDataFrame(first, schema).select("*", *[F.lit(f"own {n}").alias(n) for n in names]), names


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(TEXTS)]
    return clashing(spark, rows, "doc_id long, text string, lang string, source string, n_chars long")


def untouched(df, names):
    rows = df.collect()
    assert rows and all(r[n] == f"own {n}" for r in rows for n in names if n in df.columns)
    return rows


def test_names_are_found():
    assert {"__size", "__u", "__text", "__source"} & set(NAMES)


def test_source_mix(spark, docs):
    df, names = docs
    got = source_mix.mix(df, prefix="mix_out_")
    assert set(names) <= set(got.columns) and len(untouched(got, names)) == len(TEXTS)
    assert set(df.columns) - {"size", "source_size", "target"} <= set(source_mix.mix(df).columns)


def test_byte_bpe_and_token_counts(spark, docs):
    df, names = docs
    keep = ("doc_id", *names)
    assert len(untouched(byte_bpe.encode_documents(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, keep=keep), names)) == len(TEXTS)
    assert len(untouched(token_counts.count_tokens(df, P.path("piece_bpe_32k.model"), keep=keep, chunk=10, overlap=4), names)) == len(TEXTS)
    bad = df.withColumn("n_tokens", F.lit(1))
    with pytest.raises(ValueError):
        byte_bpe.encode_documents(bad, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, keep=("n_tokens",))


def test_surrogates_and_near_dup(spark, docs):
    df, names = docs
    rows = untouched(surrogates.pseudonymise(df, KEY), names)
    assert len(rows) == len(TEXTS) and "Smith" not in str(rows)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()}[4] == 1


def test_pages(spark):
    df, names = clashing(spark, [(1, "http://h/1", "<p>Some text of a page, long enough to count as such.</p>" * 3), (2, None, None)], "page_id long, url string, html string")
    assert consensus_html.extract(df).count() == 2
    path = own_path(spark, "warc")
    warc.write(df, path)
    assert warc.read(spark, path).count() == 2


def test_pipeline_stages(spark, docs):
    """The stages but the first, which needs a table of labels, one after the other."""
    df, names = docs
    for step in (corpus_pipeline.drop_near_copies, corpus_pipeline.replace_personal_data, corpus_pipeline.mix_sources):
        df = step(spark, df, None)
        assert df.columns == docs[0].columns
        untouched(df, names)
    assert corpus_pipeline.encode(spark, df, None).count() == df.count()


def test_toxicity(spark, docs):
    df, names = docs
    many = df.withColumn("doc_id", F.explode(F.sequence(F.col("doc_id") * 10, F.col("doc_id") * 10 + 9)))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(50)], "doc_id long, quality int, toxic int")
    assert len(untouched(toxicity.score(many, labels), names)) == 50
