"""Token counts against the library itself."""

from functools import lru_cache

import public_tokenizers
from tokenizers import Tokenizer

from curata.llm import tokens


@lru_cache
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def reference(text):
    return len(library().encode(text or "", add_special_tokens=False).ids)


def test_each_code_point_of_the_fast_path():
    texts = [s for c in range(0x300) for s in (f"a{chr(c)}b", f"  {chr(c)} 1", chr(c) * 3, f"1{chr(c)}{chr(c)}\n x")]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert tokens.count_tokens(texts) == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_whole_tokens_are_single_ids():
    whole = tokens.whole_tokens()
    assert len(whole) > 40_000 and " the" in whole
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    some = sorted(whole)[::97]
    assert all(len(t.encode(w, add_special_tokens=False).ids) == 1 for w in some)


def test_special_strings_nulls_long_and_wide_texts(spark):
    data = [(1, None), (2, ""), (3, "a<|endoftext|>b <|endoftext|>"), (4, "word " * 300_000), (5, "漢字 ́ é 😀‍"),
            (6, "it's  \n\n we'll   <|endoftext|>"), (6, "it's  \n\n we'll   <|endoftext|>"), (None, "x")]
    df = spark.createDataFrame([(i, t, 7) for i, t in data], "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in tokens.token_counts(df).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), n := reference(t), n > 1024) for i, t in data), key=str)
    assert got == want


def test_empty_table(spark):
    assert tokens.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents_agree_with_the_library(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in df.collect()}
    for r in tokens.token_counts(df).collect():
        assert r.n_tokens == reference(text[r.doc_id])
