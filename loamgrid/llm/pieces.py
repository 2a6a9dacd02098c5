"""SentencePiece models on the tokenizers library: encode, decode, verify parity.

The model protobuf is read field by field; from it come the normaliser (compiled character map,
extra-space rule, dummy prefix), the metaspace marker, the unigram scores or, for models of the BPE
kind, merges ranked by score, and the byte fallback. Texts are split before each marker run where no
piece of the vocabulary reaches across one; each distinct segment of a worker is encoded once, many
at a time on the library's threads, and compared with the sentencepiece library's own ids: a
difference is reported in ``parity`` of every text that holds the segment.

Defined results: null and empty texts have no ids, decode to an empty text and are in parity;
repeated rows and null ids are encoded like others; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm import tokens
from loamgrid.plans.session import Scratch

MARK = "▁"
_AS_IS = "\U0010ffff"  # in front of segments that are marked already
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = buf[at]
            at += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    while at < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            n = varint()
            value, at = buf[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = buf[at : at + n], at + n
        yield key >> 3, value


class PieceModel:
    """What a ``.model`` file says: pieces, scores, kinds and the normaliser's settings."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, object] = {}
        norm: dict[int, object] = {}
        for n, v in _fields(raw):
            if n == 1:
                f = dict(_fields(v))
                self.pieces.append((f[1].decode(), float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0]), f.get(3, NORMAL)))
            elif n == 2:
                trainer = dict(_fields(v))
            elif n == 3:
                norm = dict(_fields(v))
        if any(k == USER for _, _, k in self.pieces):
            raise ValueError("user-defined pieces, which go before all others, are not supported")
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unk = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.charsmap = norm.get(2, b"")
        self.dummy_prefix, self.squeeze = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        self.splits = not any(MARK in p.lstrip(MARK) for p, _, k in self.pieces if k == NORMAL)

    def tokenizer(self):
        """The bare model as a tokenizers object; it takes normalised, marked text."""
        from tokenizers import Tokenizer, models

        if self.kind == UNIGRAM:
            return Tokenizer(models.Unigram([(p, s) for p, s, _ in self.pieces], self.unk, self.byte_fallback))
        ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        merges = []
        for piece, score, kind in self.pieces:
            if kind == NORMAL:
                cuts = [(piece[:i], piece[i:]) for i in range(1, len(piece))]
                merges += [(-score, ids[a], ids[b], a, b) for a, b in cuts if a in ids and b in ids]
        pairs = [(a, b) for _, _, _, a, b in sorted(merges)]
        return Tokenizer(models.BPE(ids, pairs, unk_token=self.pieces[self.unk][0], fuse_unk=True, byte_fallback=self.byte_fallback))

    def normaliser(self):
        from tokenizers import normalizers

        return normalizers.Precompiled(self.charsmap) if self.charsmap else None


class PieceCodec:
    """Ids of whole texts and back, with each distinct segment encoded and checked once."""

    def __init__(self, path: str, room: int = 700_000):
        import sentencepiece

        with open(path, "rb") as f:
            self.model = PieceModel(f.read())
        self.tok, self.norm, self.room = self.model.tokenizer(), self.model.normaliser(), room
        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[str, bytes] = {}
        self.differ: set[str] = set()
        self.bytes_of = [bytes([int(p[3:-1], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else p.encode() for p, _, k in self.model.pieces]

    def normalise(self, text: str) -> str:
        m = self.model
        if self.norm is not None:
            text = self.norm.normalize_str(text)
        if m.squeeze:
            text = re.sub(" {2,}", " ", text).strip(" ")
        return text

    def segments(self, text: str) -> list[str]:
        """Segments of the normalised text; a marker goes in front of those that do not begin with ``_AS_IS``."""
        if not text:
            return []
        if self.model.splits and self.model.dummy_prefix and "  " not in text and MARK not in text and _AS_IS not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        marked = (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)
        parts = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked) if self.model.splits else [marked]
        return [_AS_IS + p for p in parts]

    def _learn(self, segs: list[str]) -> None:
        marked = [s[1:] if s[:1] == _AS_IS else MARK + s for s in segs]
        own = self.own.encode([x[1:].replace(MARK, " ") if x[0] == MARK else x for x in marked], num_threads=2)
        for s, x, e, theirs in zip(segs, marked, self.tok.encode_batch_fast(marked, add_special_tokens=False), own):
            self.known[s] = np.array(e.ids, np.int32).tobytes()
            # A bare marker or a segment without one has no text of its own to compare with.
            if x[0] == MARK and len(x) > 1 and e.ids != theirs:
                self.differ.add(s)

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether all its segments agree with the sentencepiece library."""
        parts = [self.segments(self.normalise(t)) if t else [] for t in texts]
        every = {s for p in parts for s in p}
        new = [s for s in every if s not in self.known]
        if len(self.known) + len(new) > self.room:
            self.known.clear()
            new = list(every)
        for i in range(0, len(new), 20_000):
            self._learn(new[i : i + 20_000])
        known, differ = self.known, self.differ
        ids = [np.frombuffer(b"".join([known[s] for s in p]), np.int32) for p in parts]
        return ids, [not differ or differ.isdisjoint(p) for p in parts]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        table, mark = self.bytes_of, MARK.encode()
        out = []
        for x in ids:
            text = b"".join([table[i] for i in x.tolist()]).replace(mark, b" ").decode("utf-8", "replace")
            out.append(text[1:] if self.model.dummy_prefix and text[:1] == " " else text)
        return out


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, path: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_tokens, ids_crc32, decoded_bytes, round_trip, parity, and the ids if asked for."""
    schema = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_bytes", pa.int64()), ("round_trip", pa.bool_()), ("parity", pa.bool_()), ("ids", pa.list_(pa.int32()))]
    schema = pa.schema(schema if with_ids else schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part, raw in tokens.chunks(batches):
            texts = [t.decode("utf-8", "replace") if t else "" for t in raw]
            ids, parity = c.encode(texts)
            back = c.decode(ids)
            cols = [
                part.column(0),
                [len(x) for x in ids],
                [zlib.crc32(x.astype("<u4").tobytes()) for x in ids],
                [len(b.encode("utf-8", "replace")) for b in back],
                [b == c.normalise(t).replace(MARK, " ") for b, t in zip(back, texts)],
                parity,
            ]
            cols += [ids] if with_ids else []
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(cols, schema)], schema=schema)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    ddl = "doc_id long, n_tokens long, ids_crc32 long, decoded_bytes long, round_trip boolean, parity boolean" + (", ids array<int>" if with_ids else "")
    return source.mapInArrow(run, ddl)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = [np.array(x or [], np.int32) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(c.decode(ids), pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark, "pieces")
    return s.finish(encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path(), with_ids=False))
