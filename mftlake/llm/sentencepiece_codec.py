"""SentencePiece encoding and decoding on the tokenizers library."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick, read

#: where the public vocabularies are; a parameter of everything below
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: bytes of text that are encoded at a time, chunks whose ids a worker remembers, and chunks that go to the libraries at a time; all bound its memory
SLICE_BYTES, REMEMBERED, AT_ONCE = 1 << 20, 240_000, 4_096
#: one chunk in so many is verified against the sentencepiece library: all are, so that differences are counted over whole texts
VERIFIED = 1
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Codec:
    """A SentencePiece model rebuilt for the tokenizers library from its protobuf.

    A text is normalised by the model's own character map, its spaces are escaped as metaspace marks and one is put before it
    where the model says so. As no piece holds a mark after another character, no piece spans the place before a run of
    marks: texts are parted there, and each distinct chunk of a slice is encoded once, in batches, on one thread as a task has one core (TOKENIZERS_PARALLELISM
    says otherwise where it is set). Parity with the sentencepiece
    library is verified on every chunk, or, where ``verify`` says so, on those whose checksum is a multiple of it, and differences are counted; the ids
    are always the tokenizers library's.
    """

    def __init__(self, model: bytes, verify: int = VERIFIED):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto
        from tokenizers import Tokenizer, models, normalizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        spec = proto.ModelProto()
        spec.ParseFromString(model)
        kind, norm = spec.trainer_spec.model_type, spec.normalizer_spec
        pieces = [(p.piece, p.score, p.type) for p in spec.pieces]
        if kind not in (UNIGRAM, BPE) or any(t == USER for *_, t in pieces) or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("unigram and BPE models with escaped leading spaces and no user-defined symbols are supported")
        if any(MARK in p.lstrip(MARK) for p, _, t in pieces if t == NORMAL):
            raise ValueError("a piece holds a metaspace mark after another character")
        vocab = {p: i for i, (p, *_) in enumerate(pieces)}
        self.unknown = next(i for i, (*_, t) in enumerate(pieces) if t == UNKNOWN)
        fallback = spec.trainer_spec.byte_fallback
        if kind == UNIGRAM:
            rebuilt = models.Unigram([(p, s) for p, s, _ in pieces], unk_id=self.unknown, byte_fallback=fallback)
        else:
            ranked = sorted((-s, i, p) for i, (p, s, t) in enumerate(pieces) if t == NORMAL and len(p) > 1)
            formed = {p for p, _, t in pieces if t == NORMAL}
            merges = []
            for _, _, p in ranked:
                parts = [(p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in formed and p[k:] in formed]
                merges += sorted(parts, key=lambda x: (vocab[x[0]], vocab[x[1]]))
            rebuilt = models.BPE(vocab=vocab, merges=merges, unk_token=pieces[self.unknown][0], fuse_unk=True, byte_fallback=fallback)
        self.tokenizer = Tokenizer(rebuilt)
        self.tokenizer.normalizer = normalizers.Replace(" ", MARK)
        self.charsmap = normalizers.Precompiled(norm.precompiled_charsmap) if norm.precompiled_charsmap else None
        self.dummy_prefix, self.squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        # the same model for parity, given chunks that are normalised already
        norm.add_dummy_prefix = norm.remove_extra_whitespaces = False
        norm.precompiled_charsmap = b""
        self.judge = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        surface = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else p.replace(MARK, " ").encode() for p, _, t in pieces]
        surface[self.unknown] = " ⁇ ".encode()
        self.surface = pa.array(surface, pa.binary())
        self.verify = verify
        # ids as the bytes of 32-bit integers
        self.known: dict[str, bytes] = {}
        self.differing: set[str] = set()

    def normalise(self, text: str | None) -> str:
        """What is encoded, with spaces in place of marks."""
        text = text or ""
        if self.charsmap:
            text = self.charsmap.normalize_str(text)
        text = text.replace(MARK, " ")
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        return " " + text if self.dummy_prefix and text else text

    def forget(self) -> None:
        """Forgets what is remembered of chunks."""
        self.known.clear()
        self.differing.clear()

    def _chunk_ids(self, chunks: list[str]) -> list[bytes]:
        new = [c for c in chunks if c not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.forget()
            new = chunks
        for at in range(0, len(new), AT_ONCE):
            part = new[at : at + AT_ONCE]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.known.update((c, array("i", e.ids).tobytes()) for c, e in zip(part, found))
            verified = [c for c in part if zlib.crc32(c.encode()) % self.verify == 0]
            self.differing.update(c for c, ids in zip(verified, self.judge.encode(verified, num_threads=1)) if array("i", ids).tobytes() != self.known[c])
        return [self.known[c] for c in chunks]

    def encode(self, texts: pa.Array) -> tuple[pa.ListArray, pa.Array, pa.Array, np.ndarray]:
        """Ids of each text, the texts decoded from them, whether those equal what was encoded, and how many of a text's chunks differ (of those that are verified)."""
        texts = pc.fill_null(texts, "")
        if self.charsmap or self.squeeze:
            plain = pa.array([self.normalise(t) for t in texts.to_pylist()], pa.string())
        else:
            plain = pc.replace_substring(texts, MARK, " ")
            if self.dummy_prefix:
                plain = pc.if_else(pc.equal(plain, ""), "", pc.binary_join_element_wise(" ", plain, ""))
        n = len(plain)
        if not n:
            return pa.array([], pa.list_(pa.int32())), plain, pa.array([], pa.bool_()), np.zeros(0, np.int64)
        _, offsets, data = plain.buffers()
        ends = np.frombuffer(offsets, np.int32)[plain.offset : plain.offset + n + 1]
        raw = np.frombuffer(data, np.uint8)[: ends[-1]] if data else np.empty(0, np.uint8)
        space = raw == 0x20
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[: ends[0]] = False
        begins[ends[:-1][ends[:-1] < ends[1:]]] = True
        starts = np.flatnonzero(begins).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(np.append(starts, ends[-1]).astype(np.int32).tobytes()), data or pa.py_buffer(b"")])
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        ids = self._chunk_ids(distinct)
        lengths = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        table = pa.ListArray.from_arrays(np.append(0, np.cumsum(lengths)).astype(np.int32), np.frombuffer(b"".join(ids), np.int32))
        flat = table.take(coded.indices).flatten()
        taken = np.append(0, np.cumsum(lengths[coded.indices.to_numpy()], dtype=np.int64))
        bounds = taken[np.searchsorted(starts, ends)].astype(np.int32)
        decoded = self._decode_flat(flat, bounds)
        same = pc.equal(decoded.cast(pa.binary()), plain.cast(pa.binary()))
        differs = np.append(0, np.cumsum(np.fromiter((c in self.differing for c in distinct), np.int64, len(distinct))[coded.indices.to_numpy()]))
        if len(self.known) > REMEMBERED:
            self.forget()
        return pa.ListArray.from_arrays(bounds, flat), decoded, same, np.diff(differs[np.searchsorted(starts, ends)])

    def _decode_flat(self, flat: pa.Array, bounds: np.ndarray) -> pa.Array:
        """Pieces stand one after the other in memory already; a text is where its first begins and its last ends."""
        pieces = self.surface.take(flat)
        _, offsets, data = pieces.buffers()
        at = np.frombuffer(offsets, np.int32)[bounds] if len(flat) else np.zeros(len(bounds), np.int32)
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(at.tobytes()), data or pa.py_buffer(b"")])

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids (null: empty), without the space that was put before them. Bytes that are no UTF-8 become U+FFFD."""
        lists = [x or [] for x in ids.to_pylist()]
        bounds = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32)
        texts = self._decode_flat(pa.array([i for x in lists for i in x], pa.int32()), bounds).to_pylist()
        return pa.array([(t[1:] if self.dummy_prefix and t[:1] == b" " else t).decode("utf-8", "replace") for t in texts], pa.string())


_codecs: dict[int, Codec] = {}


def _codec(model: bytes) -> Codec:
    """One codec a worker process and model."""
    key = hash(model)
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about SLICE_BYTES of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, ``_ids`` (array of int), ``_round_trip`` (decoding gives back the normalised text), ``_differing`` (chunks of
    the text whose ids the sentencepiece library has otherwise; all are verified) of every row of ``df``.

    The driver reads the model from ``model_path`` and ships its bytes, so executors need no such file. Null and empty
    texts have no ids and come back as empty. A metaspace mark in a text is a space to the model and comes back as one. Repeated rows get equal answers; an empty table gives no rows; other columns are not read.
    """
    rows = pick(df, _id=id_col, _text=text_col).withColumn("_text", F.col("_text").cast("string"))
    shipped = df.sparkSession.sparkContext.broadcast(_model_bytes(model_path))
    schema = T.StructType([rows.schema["_id"], T.StructField("_ids", T.ArrayType(T.IntegerType())), T.StructField("_round_trip", T.BooleanType()), T.StructField("_differing", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped.value)
        for whole in batches:
            for batch in _slices(whole, 1):
                ids, _, same, differing = codec.encode(pa.concat_arrays([batch.column(1)]))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, same, pa.array(differing, pa.int64())], names=["_id", "_ids", "_round_trip", "_differing"])
        # the worker lives on, beside the next stage's work
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """``_id`` and ``_text``, decoded from the ids, of every row of ``df``; null ids give an empty text."""
    rows = pick(df, _id=id_col, _ids=ids_col).withColumn("_ids", F.col("_ids").cast("array<int>"))
    shipped = df.sparkSession.sparkContext.broadcast(_model_bytes(model_path))
    schema = T.StructType([rows.schema["_id"], T.StructField("_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), codec.decode(batch.column(1))], names=["_id", "_text"])

    return rows.mapInArrow(run, schema)


def tokenised(df: DataFrame, model_path: str = MODEL) -> DataFrame:
    found = encode(df, model_path)
    return found.select(F.col("_id").alias("doc_id"), F.size("_ids").cast("bigint").alias("n_tokens"), F.col("_ids").alias("token_ids"), F.col("_round_trip").alias("round_trip"), F.col("_differing").alias("n_differing"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(read(spark, sf_dir, "documents"))
