"""Token counts, token files and the SentencePiece codec against the libraries themselves."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sedimenta.llm import sentencepiece_codec as sp
from sedimenta.llm import token_files as tf
from sedimenta.llm.bpe import Encoder
from sedimenta.llm.common import vocabulary
from sedimenta.llm.token_counts import count_by_overlap, token_counts

BPE, PIECES = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
PARTS = (" ", "  ", "\n", " \n", "\t", "a", "the", "Bc", "'s", "é", "ß", "1", "٣", "!", "<|endoftext|>", "<|endof", "\xa0", "日本", "\x1c", " ", "😀", "ℵ", "▁", "ing")


def mixed_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", " ", "x" * 5000, "ab " * 3000]


ROWS = [(3, "two words"), (1, None), (2, ""), (2, ""), (7, "a  b\n"), (None, "no id"), (5, "Zürich " * 400)]
CLASHING = "doc_id bigint, text string, n_tokens string, id string, start string"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in ROWS], CLASHING)


def test_stretches_give_the_ids_of_the_library():
    encoder, texts = Encoder(BPE, keep=500), mixed_texts(1500, 1)
    for k in range(0, len(texts), 100):
        part = texts[k:k + 100]
        ids, ends = encoder.encode_all(pa.array(part))
        for text, start, end in zip(part, [0, *ends], ends):
            assert ids[start:end].tobytes() == encoder.whole(text), text


def same_as_library(encoder, texts):
    ids, ends = encoder.encode_all(pa.array(texts, pa.string()))
    assert len(ends) == len(texts) and ends[-1] == len(ids)
    for text, start, end in zip(texts, [0, *ends], ends):
        assert ids[start:end].tobytes() == encoder.whole(text), text


def test_borders_beside_every_character():
    encoder = Encoder(BPE, keep=500)
    for code in [*range(0x300), 0x3A9, 0x416, 0x5D0, 0x661, 0x621, 0x1680, 0x180E, 0x2003, 0x2028, 0x2075, 0x3000, 0x30A1, 0x65E5, 0xAC00, 0xFF11, 0x1F600]:
        c = chr(code)
        same_as_library(encoder, [
            f"a{c}b", c, "", f"{c}{c}", f"1{c}2", f" {c}", f"{c} ", f"  {c}x", f"{c}\n {c}", f"!{c}!", f"'{c}'s", f"x'{c}s", f"{c}'re'",
            f"a {c}  {c}é", f"a  {c}<|endoftext|>  b", "s", "'", "s",
        ])


def test_only_distinct_pretokens_reach_the_library(monkeypatch):
    """Stretches between spaces that differ all, of few pre-tokens: each of those is encoded once, none as a whole text."""
    encoder, asked = Encoder(BPE), []
    words = [chr(97 + k // 26) + chr(97 + k % 26) for k in range(400)]
    texts = [f"  if {a},\n    {b}:\n\t{b}'s" for a in words[:200] for b in words[200:]]
    same_as_library(encoder, texts[::400])
    encoder = Encoder(BPE)
    merged = encoder._merged
    monkeypatch.setattr(encoder, "whole", lambda text: pytest.fail(f"encoded whole: {text!r}"))
    monkeypatch.setattr(encoder, "_merged", lambda tokens: (asked.extend(tokens), merged(tokens))[1])
    for k in range(0, len(texts), 10_000):
        encoder.encode_all(pa.array(texts[k:k + 10_000]))
    assert len(asked) == len(set(asked)) < 1000


def test_pretokens_used_last_are_remembered():
    encoder = Encoder(BPE, keep=100)
    for k in range(0, 2000, 50):
        same_as_library(encoder, [f"often word{i} {i}" for i in range(k, k + 50)])
        assert b"often" in encoder._number and len(encoder._number) <= 100 + 2 * 50 + 10


def test_overlaps_count_what_the_whole_text_has():
    encoder = Encoder(BPE)
    for text in mixed_texts(400, 2):
        assert count_by_overlap(encoder.library, text, size=40, overlap=4) == len(encoder.whole(text)) // 4, text


def test_token_counts(docs, spark):
    library = Encoder(BPE).library
    for huge in (65_536, 10):
        got = token_counts(docs, BPE, huge=huge, size=64, overlap=8).collect()
        want = [(i, len((t or "").encode()), n := len(library.encode(t or "").ids), n > 512) for i, t in ROWS]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    pieces = {r.doc_id: r.n_tokens for r in token_counts(docs, PIECES).collect()}
    assert pieces[1] == 0 and pieces[3] == 2
    assert token_counts(docs.limit(0), BPE).collect() == []


def test_variable_length_code_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 70_001):
        numbers = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype("<u4")
        control, data = tf.packed(numbers)
        assert len(control) == -(-n // 4)
        assert (tf.unpacked(control, data, n, step=1000) == numbers).all()


def test_token_files(docs, spark, tmp_path):
    encoder = Encoder(BPE)
    tf.write_token_files(docs, str(tmp_path / "a"), BPE, 2, block_tokens=5)
    got = sorted(tf.read_token_files(spark, str(tmp_path / "a")).collect(), key=lambda r: r["start"])
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [np.frombuffer(encoder.whole(t or ""), "<u4").tolist() + [2] for _, t in order]
    assert [r["id"] for r in got] == [i for i, _ in order]
    assert [r["ids"] for r in got] == ids
    assert [r["start"] for r in got] == [sum(map(len, ids[:k])) for k in range(len(ids))]
    ranks = [r[0] for r in spark.read.parquet(str(tmp_path / "a/ranks")).orderBy("rank").select("id").collect()]
    counts = np.bincount(np.concatenate(ids))
    assert ranks == sorted(np.flatnonzero(counts).tolist(), key=lambda i: (-counts[i], i))
    tf.write_token_files(docs.limit(0), str(tmp_path / "b"), BPE, 2)
    assert tf.read_token_files(spark, str(tmp_path / "b")).collect() == []


def test_op3_on_a_table(spark, sf_dir):
    encoder, start = Encoder(BPE), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tf.op3_token_files(spark, sf_dir).collect()}
    for doc, text in sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()):
        ids = encoder.whole(text) + np.array([2], "<u4").tobytes()
        assert got[doc] == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def test_pieces_and_texts_of_the_library():
    import sentencepiece

    library, codec = sentencepiece.SentencePieceProcessor(model_file=PIECES), sp.Codec(PIECES)
    texts = mixed_texts(1500, 3)
    flat, ends = codec.encode_all(pa.array(texts))
    for text, ids in zip(texts, np.split(flat, ends)):
        assert ids.tolist() == library.encode(text), text
        assert codec.decode(ids) == library.decode(ids.tolist())
        if "▁" not in text:
            assert codec.decode(ids) == text


def test_long_words_do_not_pile_up_in_the_codec():
    import sentencepiece
    import tracemalloc

    library, codec, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), sp.Codec(PIECES, keep=1000), random.Random(5)
    words = ["".join(rng.choices("0123456789abcdefghijklmnopqrstuvwxyz", k=800)) for _ in range(300)]
    tracemalloc.start()
    try:
        for k in range(0, len(words), 10):
            texts = words[k:k + 10]
            flat, ends = codec.encode_all(pa.array(texts))
            assert [ids.tolist() for ids in np.split(flat, ends)[:-1]] == library.encode(texts)
            del flat, ends
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    # 23 MB before the memory of words and pairs was bound by their size
    assert held < 500_000


def test_tokenized_bounds_arrow_batches(spark):
    long = spark.range(40).selectExpr("id AS doc_id", "repeat('two words ', 20000 + int(id)) AS text").coalesce(1)
    try:
        got = sp.tokenized(spark, long, "")
        assert spark.conf.get(sp.BATCH_BYTES) == str(2 * sp.CHARS)
        assert got.count() == 40 and got.select("n_tokens").distinct().count() == 40
        # a bound that the session has stays
        spark.conf.set(sp.BATCH_BYTES, "1000000")
        sp.tokenized(spark, long, "")
        assert spark.conf.get(sp.BATCH_BYTES) == "1000000"
    finally:
        spark.conf.unset(sp.BATCH_BYTES)


def test_unigram_model_by_highest_sum(tmp_path):
    """The same pieces as a unigram model: the library's own Viterbi, up to segmentations of equal score."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = sp.UNIGRAM
    # sums that 32-bit numbers hold exactly
    for p in proto.pieces:
        p.score = max(p.score, -40_000)
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    library, codec = sentencepiece.SentencePieceProcessor(model_file=str(path)), sp.Codec(str(path))
    scores = [p.score for p in proto.pieces]
    texts = [t for t in mixed_texts(300, 4) if len(t) < 1000]
    flat, ends = codec.encode_all(pa.array(texts))
    for text, part in zip(texts, np.split(flat, ends)):
        ids = part.tolist()
        assert codec.decode(np.array(ids)) == library.decode(library.encode(text))
        assert sum(scores[i] for i in ids) == sum(scores[i] for i in library.encode(text)), text


def test_codec_operators(docs, spark):
    coded = sp.encode(docs, PIECES)
    back = sp.decode(coded, PIECES)
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(str((i, t or "")) for i, t in ROWS)
    trip = sp.round_trip(docs, PIECES).collect()
    assert len(trip) == len(ROWS) and all(r.restored for r in trip)
    assert sp.encode(docs.limit(0), PIECES).collect() == []
