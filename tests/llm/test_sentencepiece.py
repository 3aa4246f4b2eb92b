import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from mftlake.llm import sentencepiece_codec as P


@pytest.fixture(scope="module")
def both():
    model = P._model_bytes(P.MODEL)
    return P.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)


ODD = [None, "", " ", "  a  b ", "a▁b", "a▁ b", "▁", "x\0y", "\n\t z", "日本語 😀", "<s> </s> <unk> <0x41>", "a" * 3000, " " * 50, "é́ ﬁ", "﻿q", "�"]


def test_parity_on_odd_texts(both):
    codec, judge = both
    ids, decoded, same, differing = codec.encode(pa.array(ODD, pa.string()))
    assert ids.to_pylist() == [judge.encode(t or "") for t in ODD]
    assert all(same.to_pylist()) and not differing.any()
    assert codec.decode(ids).to_pylist() == [(t or "").replace("▁", " ") for t in ODD]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=5))
def test_parity_and_round_trip(texts):
    codec = P._codec(P._model_bytes(P.MODEL))
    ids, _, same, differing = codec.encode(pa.array(texts, pa.string()))
    assert not differing.any()
    assert ids.to_pylist() == codec_judge(texts)
    assert all(same.to_pylist())


def codec_judge(texts):
    return _judge.encode(texts)


_judge = sentencepiece.SentencePieceProcessor(model_proto=P._model_bytes(P.MODEL))


def test_differences_are_counted_for_their_text_and_change_no_ids(both):
    codec = P.Codec(P._model_bytes(P.MODEL), verify=1)

    class Off:
        def encode(self, chunks, num_threads):
            return [[1, 2, 3] if c == " two" else both[1].encode(c[1:]) for c in chunks]

    codec.judge = Off()
    ids, _, _, differing = codec.encode(pa.array(["one two", "one", "two two", "", None]))
    assert ids.to_pylist() == [both[1].encode(t) for t in ("one two", "one", "two two", "", "")] and differing.tolist() == [1, 0, 2, 0, 0]


def unigram(byte_fallback):
    """A small unigram model made by hand: no training."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    kinds = [("<unk>", 0.0, P.UNKNOWN), ("<s>", 0.0, P.CONTROL), ("</s>", 0.0, P.CONTROL)]
    kinds += [(f"<0x{i:02X}>", 0.0, P.BYTE) for i in range(256)] if byte_fallback else []
    words = ["▁the", "▁a", "▁an", "ing", "at", "ion", "tion", "er", "▁", "th", "in", "▁b", "on", "es", "e", "t", "a", "i", "n", "o", "s", "r", "g", "h", "b", "c", "d", "l"]
    kinds += [(w, -2.0 - 0.37 * i + 0.011 * (i * i % 7), P.NORMAL) for i, w in enumerate(words)]
    for piece, score, kind in kinds:
        m.pieces.add(piece=piece, score=score, type=kind)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.trainer_spec.unk_id, m.trainer_spec.bos_id, m.trainer_spec.eos_id, m.trainer_spec.pad_id = P.UNIGRAM, byte_fallback, 0, 1, 2, -1
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.escape_whitespaces, m.normalizer_spec.remove_extra_whitespaces = True, True, False
    return m.SerializeToString()


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_models(byte_fallback):
    model = unigram(byte_fallback)
    codec, judge = P.Codec(model, verify=1), sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = ["the nation is in a bag", "an ale  on the bench", "", None, "strange zebra quiz", "é😀 the", "tionation thing"]
    ids, _, same, differing = codec.encode(pa.array(texts, pa.string()))
    assert ids.to_pylist() == [judge.encode(t or "") for t in texts] and not differing.any()
    assert all(same.to_pylist()) or not byte_fallback


def test_tables(spark, both):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "null id")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, _ids int")
    coded = P.tokenised(df)
    got = coded.collect()
    assert sorted((str(r["doc_id"]), r["token_ids"]) for r in got) == sorted((str(i), both[1].encode(t or "")) for i, t in rows)
    assert all(r["round_trip"] and not r["n_differing"] and r["n_tokens"] == len(r["token_ids"]) for r in got)
    back = {r["_id"]: r["_text"] for r in P.decode(coded).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in rows}
    assert P.tokenised(df.limit(0)).count() == 0


@pytest.mark.parametrize("made", [P.Codec, P._codec])
def test_every_chunk_is_verified_unless_told_otherwise(both, made):
    codec = made(P._model_bytes(P.MODEL))
    codec.known.clear()
    judge, words = codec.judge, [f"word{i}" for i in range(64)]

    class Off:
        def encode(self, chunks, num_threads):
            return [[0] for _ in chunks]

    try:
        codec.judge = Off()
        _, _, _, differing = codec.encode(pa.array([" ".join(words), "word1", None]))
    finally:
        codec.judge = judge
        codec.known.clear()
        codec.differing.clear()
    assert differing.tolist() == [64, 1, 0]


def test_memory_is_bounded_for_many_distinct_chunks(both, monkeypatch):
    """The libraries get few chunks at a time, and no more than REMEMBERED are kept, however many one call has."""
    monkeypatch.setattr(P, "REMEMBERED", 60_000)
    codec, sizes = P.Codec(P._model_bytes(P.MODEL)), []

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def encode(self, chunks, **options):
            sizes.append(len(chunks))
            return self.inner.encode(chunks, **options)

        def encode_batch_fast(self, chunks, **options):
            sizes.append(len(chunks))
            return self.inner.encode_batch_fast(chunks, **options)

    codec.tokenizer, codec.judge = Counting(codec.tokenizer), Counting(codec.judge)
    text = " ".join(f"{i:x}q" for i in range(70_000))
    ids, _, same, differing = codec.encode(pa.array([text, "one two"]))
    assert max(sizes) <= 5_000 and sum(sizes) == 2 * 70_002
    assert len(codec.known) <= P.REMEMBERED
    assert ids.to_pylist() == both[1].encode([text, "one two"]) and same.to_pylist() == [True, True] and not differing.any()
