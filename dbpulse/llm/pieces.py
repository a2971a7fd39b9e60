"""SentencePiece models on the tokenizers library: encoding and decoding of whole texts.

The model file is parsed as a protobuf; its normaliser, metaspace marker, piece
scores (unigram) or score-ordered merges (BPE) and byte fallback are rebuilt as
a tokenizers pipeline. Words are encoded in batches, multithreaded by the
library, each distinct word once per task; the pieces of the model say whether
words may be cut out that way. The rebuilt tokenizer is compared with the
original library before it is used. One difference can remain in unigram models:
where segmentations score alike but for rounding, the original library's single
precision may choose another one than the backend's double precision.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, shipped_file, tokenizer_path
from .textvec import buffers, hash_spans, ragged, spans
from .wordcache import WordCache, of_worker

MARK = "▁"
CHUNK = 1 << 21  # bytes of text encoded together
# Piece types and field numbers of the model's protobuf.
UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 2, 3, 4, 5, 6
UNIGRAM_MODEL, BPE_MODEL = 1, 2

#: Texts on which a rebuilt tokenizer must agree with the original library.
PROBES = [
    "", " ", "  ", "a", " a", "a ", "Hello world", "two  blanks   three", "line\nbreak\r\n\ttab", " nbsp em",
    "Ünïcödé straße ﬁ ﬀ Å Å", "日本語テキスト", "emoji 👩‍👩‍👧 🏳️‍🌈", "1234567890 3.14", "%%% *** ###", "▁mark▁ inside", "<s> </s> <unk> <0x41>",
    "aaaaaaaaaaaaaaaaaaaa", "https://example.com/?q=1&x=%20", "\x01\x7f control", "é combining", "x" * 300,
]


@dataclass
class Model:
    kind: int = UNIGRAM_MODEL
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix_marker: bool = False
    unk_surface: str = " ⁇ "

    @property
    def unknown(self) -> int:
        return next(i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message; floats where the wire type is 32 bits."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 5:
            value, at = float(np.frombuffer(data, "<f4", 1, at)[0]), at + 4
        elif wire == 1:
            value, at = data[at : at + 8], at + 8
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"not a model file: wire type {wire}")
        yield key >> 3, value


def parse(data: bytes) -> Model:
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            model.pieces.append((piece[1].decode(), float(piece.get(2, 0.0)), int(piece.get(3, 1))))
        elif number == 2:
            trainer = dict(_fields(value))
            model.kind = int(trainer.get(3, UNIGRAM_MODEL))
            model.byte_fallback = bool(trainer.get(35, 0))
            model.suffix_marker = bool(trainer.get(24, 0))
            model.unk_surface = trainer.get(44, model.unk_surface.encode()).decode()
        elif number == 3:
            rules = dict(_fields(value))
            model.charsmap = rules.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
    if model.kind not in (UNIGRAM_MODEL, BPE_MODEL):
        raise ValueError("only unigram and BPE models are supported")
    if model.suffix_marker or not model.escape or any(t == USER_DEFINED for _, _, t in model.pieces):
        raise ValueError("markers at word ends, unescaped blanks and user-defined pieces are not supported")
    return model


class Backend:
    """A parsed model as a tokenizers pipeline, with cached words and table-driven decoding."""

    def __init__(self, source: str | bytes):
        """``source`` is the model file, or its bytes."""
        from tokenizers import Regex, Tokenizer, models, normalizers

        self.model = m = parse(_model_bytes(source))
        usable = {p: i for i, (p, _, t) in enumerate(m.pieces) if t not in (CONTROL, UNUSED)}
        if m.kind == UNIGRAM_MODEL:
            core = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unknown, m.byte_fallback)
        else:
            core = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(m.pieces)}, merges=_merges(m, usable), unk_token=m.pieces[m.unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback)
        self.tokenizer = Tokenizer(core)
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip(left=True, right=True)]
        self.normalizer = normalizers.Sequence(steps) if steps else None
        # no piece has a marker after another character: then no piece crosses into the next word
        self.by_words = not any(MARK in p.lstrip(MARK) for p in usable)
        self._split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self._cache = WordCache(lambda words: self._encode_words([MARK + w for w in words]))
        self._fold = np.arange(256, dtype=np.uint8)
        self._fold[0], self._fold[32] = 255, 0
        surfaces = [self._surface(i) for i in range(len(m.pieces))]
        self._bytes = np.frombuffer(b"".join(surfaces), np.uint8)
        self._lengths = np.array([len(s) for s in surfaces], np.int64)
        self._starts = np.cumsum(self._lengths) - self._lengths

    def _surface(self, i: int) -> bytes:
        piece, _, kind = self.model.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:-1], 16)])
        if kind == UNKNOWN:
            return self.model.unk_surface.encode()
        return b"" if kind == CONTROL else piece.replace(MARK, " ").encode()

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def marked(self, text: str) -> str:
        """The normalised text with its blanks as markers."""
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        if not text:
            return ""
        return (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        offsets = np.cumsum([0, *map(len, raw)])
        return self.encode_chunk(np.frombuffer(b"".join(raw), np.uint8), offsets)

    def encode_chunk(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a chunk of UTF-8.

        Texts of words with single blanks between them go by cached words; others are marked and split one by one.
        """
        n = len(offsets) - 1
        data = raw.tobytes()
        plain = self.by_words and self.normalizer is None and self.model.dummy_prefix
        odd = np.array([not plain or self._is_odd(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], bool)
        out = [np.zeros(0, np.uint32)] * n
        if len(raw) and not odd.all():
            starts, ends, low = spans(raw, offsets, self._fold)
            first = np.searchsorted(starts, offsets)
            keep = ~np.repeat(odd, np.diff(first))
            starts, ends = starts[keep], ends[keep]
            ids, lengths = self._cache.encode(raw, starts, ends, hash_spans(low, starts, ends))
            at = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, offsets)]
            out = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for i in np.flatnonzero(odd):
            marked = self.marked(data[offsets[i] : offsets[i + 1]].decode())
            parts = self._split.findall(marked) if self.by_words else [marked] if marked else []
            found = [x for at in range(0, len(parts), 20_000) for ids in self._encode_words(parts[at : at + 20_000]) for x in ids]
            out[i] = np.array(found, np.uint32)
        return out

    @staticmethod
    def _is_odd(text: bytes) -> bool:
        return b"  " in text or text[:1] == b" " or text[-1:] == b" " or MARK.encode() in text

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        raw = self._bytes[ragged(self._starts[ids], self._lengths[ids])].tobytes()
        if self.model.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode(errors="replace")

    def verify(self, source: str | bytes, texts: list[str] = PROBES) -> None:
        """Raises unless ids and decoded texts equal the original library's."""
        import sentencepiece

        original = sentencepiece.SentencePieceProcessor(model_proto=_model_bytes(source))
        for text, ids in zip(texts, self.encode(texts), strict=True):
            want = original.encode(text)
            if ids.tolist() != want:
                raise ValueError(f"ids differ from the original library's for {text[:40]!r}")
            if self.decode(ids) != original.decode(want):
                raise ValueError(f"decoded text differs from the original library's for {text[:40]!r}")


def _merges(m: Model, usable: dict[str, int]) -> list[tuple[str, str]]:
    """Every way to make a piece of two others; the better piece's score first, as the scores order the merges."""
    plain = {p for p, i in usable.items() if m.pieces[i][2] == 1}
    found = []
    for p in plain:
        for cut_at in range(1, len(p)):
            left, right = p[:cut_at], p[cut_at:]
            if left in plain and right in plain:
                found.append((-m.pieces[usable[p]][1], usable[left], usable[right], left, right))
    found.sort()
    return [(x[3], x[4]) for x in found]


def _model_bytes(source: str | bytes) -> bytes:
    return source if isinstance(source, bytes) else Path(source).read_bytes()


def _verified(spark: SparkSession, path: str | None):
    """What gives a worker its backend; the model's bytes travel with the job, and parity is checked first."""
    key, data = shipped_file(spark, path or tokenizer_path("piece_bpe_32k.model"))
    of_worker(("verified", key), lambda: Backend(data.value).verify(data.value) or True)
    return lambda: of_worker(("pieces", key), lambda: Backend(data.value))


def _mapped(docs: DataFrame, id_col: str, col: str, kind: str, run, schema: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(col).cast(kind).alias("value")).mapInArrow(run, schema)


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row; a null or empty text has no ids. Other columns are not read; ids may be null or repeat."""
    worker_backend = _verified(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = worker_backend()
        for batch in batches:
            for raw, cuts, at in buffers(batch.column(1), CHUNK):
                ids = backend.encode_chunk(raw, cuts)
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), lists], names=["doc_id", "ids"])

    return _mapped(docs, id_col, text_col, "string", run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row; null or empty ids decode to the empty text, null ids within a list are skipped."""
    worker_backend = _verified(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = worker_backend()
        for batch in batches:
            texts = [backend.decode(np.array([i for i in ids or [] if i is not None], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return _mapped(encoded, id_col, ids_col, "array<int>", run, "doc_id long, text string")


def digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_bytes, decoded_crc32, round_trip) of every row, encoded and decoded in one pass.

    ids_crc32 is over the ids as little-endian unsigned 32-bit numbers; round_trip says whether the decoded text is the text.
    """
    worker_backend = _verified(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = worker_backend()
        for batch in batches:
            for raw, cuts, at in buffers(batch.column(1), CHUNK):
                ids, data = backend.encode_chunk(raw, cuts), raw.tobytes()
                texts = [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                back = [backend.decode(x).encode() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(ids)),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4")) for x in ids], pa.int64()),
                        pa.array([len(x) for x in back], pa.int64()),
                        pa.array([zlib.crc32(x) for x in back], pa.int64()),
                        pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
                    ],
                    names=["doc_id", "n_tokens", "ids_crc32", "decoded_bytes", "decoded_crc32", "round_trip"],
                )

    return _mapped(docs, id_col, text_col, "string", run, "doc_id long, n_tokens long, ids_crc32 long, decoded_bytes long, decoded_crc32 long, round_trip boolean")
