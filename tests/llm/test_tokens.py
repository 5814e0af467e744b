"""Encoding against the public tokenizer itself."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm.tokens import default_vocabulary, encode_texts, encoder

SPECIAL = [None, "", " ", "  a  b\n\n c ", "it's 'tis don't 're x's", "!!'s ''ll", "中文 字　　と　x", "a  b   c", "<|endoftext|> x", "x" * 5000, " " * 300 + "y", "🙂🙂 é́ ‍", "1234567890.5\r\n\r\n\tz", "\t\t\n x  y\x0b\x0cz", "\x00\x01ab\x7f"]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", SPECIAL)
def test_special_texts(text, reference):
    assert encoder(default_vocabulary()).encode(text) == reference(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from(list("ab' \n\t.0é中　'st"))), max_size=60))
def test_any_text(reference, text):
    assert encoder(default_vocabulary()).encode(text) == reference(text)


def test_documents(spark, sf_dir, reference):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    got = {r["doc_id"]: r["ids"] for r in encode_texts(df.withColumnRenamed("lang", "ids")).collect()}
    assert got == {k: reference(t) for k, t in texts.items()}


def test_no_documents(spark):
    assert encode_texts(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
