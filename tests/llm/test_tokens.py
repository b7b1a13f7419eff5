import io
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from logloom.checkpoints import scratch_path
from logloom.llm import queries, tokens, wavelet

TEXTS = st.lists(st.text(alphabet="ab é\n\t  　'.!12\x1f\x85漢😀<|endoftext|>", max_size=40), max_size=12)


def test_pieces_equal_the_tokenizer(tokenizer, tokenizer_path, odd_texts):
    small, large = tokens.PieceEncoder(tokenizer_path, max_pieces=50), tokens.PieceEncoder(tokenizer_path)

    @settings(max_examples=150, deadline=None)
    @given(TEXTS)
    def check(rows):
        expected = [e.ids for e in tokenizer.encode_batch(rows, add_special_tokens=False)]
        for encoder in (small, large):
            ids, lengths = encoder.encode(rows)
            assert lengths.tolist() == [len(e) for e in expected]
            assert ids.tolist() == [i for e in expected for i in e]

    check()
    rows = [t or "" for t in odd_texts]
    rows += [rows[7] * 5, (rows[7] + "  \n ") * 5, "é" * 1_100_000 + " a", " ".join(rows[7] for _ in range(4))]
    ids, lengths = large.encode(rows)
    assert ids.tolist() == [i for e in tokenizer.encode_batch(rows, add_special_tokens=False) for i in e.ids]


def test_added_tokens_equal_the_unmodified_tokenizer(tokenizer_path, odd_texts):
    plain = Tokenizer.from_file(tokenizer_path)
    pieces = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "a", " b", "\n", "é"]
    encoder = tokens.PieceEncoder(tokenizer_path, max_pieces=50, special=True)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(pieces), max_size=9).map("".join), max_size=8))
    def check(rows):
        expected = [e.ids for e in plain.encode_batch(rows, add_special_tokens=False)]
        ids, lengths = encoder.encode(rows)
        assert lengths.tolist() == [len(e) for e in expected]
        assert ids.tolist() == [i for e in expected for i in e]

    check()
    rows = [t or "" for t in odd_texts] + [odd_texts[7] * 5 + "<|endoftext|>" + odd_texts[7] * 5, "a <|endoftext|> b"]
    ids, _ = encoder.encode(rows)
    assert ids.tolist() == [i for e in plain.encode_batch(rows, add_special_tokens=False) for i in e.ids]
    assert ids.tolist().count(50256) == 3


def test_queries_take_the_library_default(spark, docs, tokenizer_path, tmp_path):
    text = "one<|endoftext|>two"
    docs([(1, text)], clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    ids = Tokenizer.from_file(tokenizer_path).encode(text, add_special_tokens=False).ids
    crc = lambda end: zlib.crc32(np.array([*ids, end], np.uint32).tobytes())
    (row,) = queries.op1_wavelet_tokens(spark, str(tmp_path)).collect()
    assert (row["n_tokens"], row["ids_crc32"]) == (len(ids) + 1, crc(2))
    packed = [queries.op3_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs([(1, text)]), str(tmp_path))]
    assert [(r["length"], r["ids_crc32"]) for df in packed for r in df.collect()] == [(len(ids) + 1, crc(0))] * 2


def test_wavelet_queries():
    r = random.Random(3)
    for n, top in ((0, 5), (1, 0), (1000, 3), (5000, 50_000), (700, 1)):
        ids = np.array([r.randint(0, top) for _ in range(n)], np.uint32)
        lengths = np.array([n // 2, n - n // 2])
        shard = wavelet.WaveletFile(io.BytesIO(wavelet.build(ids, [None, 7], lengths, block_bits=128)))
        assert shard.ids().tolist() == ids.tolist()
        names, found = shard.documents()
        assert names == [None, 7] and found.tolist() == lengths.tolist()
        for i in range(0, n, 97):
            assert shard.access(i) == ids[i]
            assert shard.rank(int(ids[i]), i) == int((ids[:i] == ids[i]).sum())
        for token in {*ids[:20].tolist(), top + 9}:
            places = np.flatnonzero(ids == token).tolist()
            assert shard.count(token) == len(places)
            assert shard.occurrences(token)[:30] == places[:30] if len(places) <= 40 else shard.select(token, 20) == places[20]


def test_files_hold_all_documents(spark, docs, tokenizer, tokenizer_path, odd_texts):
    rows = [(10 * i, t) for i, t in enumerate(odd_texts)] + [(None, "no id"), (20, "again"), (20, "again")]
    manifest = wavelet.write_shards(docs(rows), scratch_path(spark, "wavelet-test"), tokenizer_path, end_id=2, shard_tokens=5000)
    got = sorted(wavelet.read_documents(manifest, (2,)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    start, expected = 0, {}
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], np.uint32)
        expected.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r["start"] == start
        assert (r["n_tokens"], r["ids_crc32"]) in expected[r["doc_id"]]
        start += r["n_tokens"]
    per_file = {r["shard_path"]: r["token_counts"][2] for r in got}
    assert len(per_file) > 1 and sum(per_file.values()) >= len(rows)


def test_empty_table(spark, docs, tokenizer_path):
    manifest = wavelet.write_shards(docs([]), scratch_path(spark, "wavelet-test"), tokenizer_path)
    assert wavelet.read_documents(manifest).count() == 0
