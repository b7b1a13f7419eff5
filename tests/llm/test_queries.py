"""Queries of this subpackage against SQL, or the operators' contracts, on the smallest driver tables."""

import hashlib
import os
import zlib

import numpy as np
import pytest
from oracle import compare, connect

from llm.test_packing import brute_best_fit
from llm.test_quality import brute_counts
from logloom.llm.queries import ORACLES, QUERIES

DIRECTORY = os.environ.get("LOGLOOM_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="driver tables not present")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    problem, n, *_ = compare(spark, connect(DIRECTORY), QUERIES[name], ORACLES[name], DIRECTORY)
    assert problem is None and n > 0


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DIRECTORY}/documents.parquet").collect()}


def test_op1(spark, texts, tokenizer):
    start = 0
    for r in sorted(QUERIES["op1_wavelet_tokens"](spark, DIRECTORY).collect()):
        ids = np.array([*tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2], np.uint32)
        assert tuple(r) == (r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op2(spark, texts):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIRECTORY}/labels.parquet").collect()}
    got = QUERIES["op2_quality_classifier"](spark, DIRECTORY).collect()
    assert {r["doc_id"] for r in got} == set(texts)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.9


def test_op3(spark, texts, tokenizer):
    got = QUERIES["op3_best_fit_packing"](spark, DIRECTORY).collect()
    lengths = [r["length"] for r in got]
    assert len({r["sequence_id"] for r in got}) == len(brute_best_fit(lengths, 2048))
    for r in got:
        ids = np.array([*tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0], np.uint32)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())


def test_op4(spark, texts):
    for r in QUERIES["op4_quality_rules"](spark, DIRECTORY).collect():
        assert [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == brute_counts(texts[r["doc_id"]])



def test_op11(spark, texts):
    from tokenizers import Tokenizer

    from logloom.llm.queries import WORD_TOKENIZER

    library = Tokenizer.from_file(WORD_TOKENIZER)
    got = QUERIES["op11_bpe_trie"](spark, DIRECTORY).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids),
            hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest(),
        )
