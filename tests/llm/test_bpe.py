"""The trie encoder against the unmodified tokenizers library."""

import public_tokenizers
import pytest

from llm.conftest import prose
from logloom.llm.bpe import TrieEncoder, bpe_encode

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return TrieEncoder(PATH)


def test_words_sharing_prefixes(encoder, library):
    words = ["the", "then", "there", "therefore", "thermal", "th", "t", "a", "aa", "aaa" * 30, "x" * 5000, "don't", "'s"]
    got = encoder.encode(words)
    assert got == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_odd_texts(encoder, library, odd_texts):
    texts = [t or "" for t in odd_texts] + ["<|startoftext|>a<|endoftext|><|endoftext|>", "ÀÉÎ ﬁ Ǆ", "12,345.67 $$$ ---", prose(3, 3000)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_operator(spark, docs, odd_texts, library):
    rows = [(i, t) for i, t in enumerate(odd_texts)] + [(100, "same text here"), (None, "a b")]
    got = bpe_encode(docs(rows), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["ids"], r["decoded"]) == (ids, library.decode(ids, skip_special_tokens=False))
        assert r["size"] == "x"  # other columns pass through


def test_empty_table(spark, docs):
    assert bpe_encode(docs([]).limit(0), PATH).count() == 0


def test_clashing_output_names(spark, docs):
    from pyspark.sql import functions as F

    df = docs([(1, "Hello")]).withColumn("ids", F.lit("old"))
    r = bpe_encode(df, PATH, decoded="decoded").collect()[0]
    assert r["ids"] == TrieEncoder(PATH).encode(["Hello"])[0]


def test_nothing_encodes_to_nothing(encoder):
    assert encoder.encode(["", " \n\t "]) == [[], []] and encoder.decode([]) == ""
