"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read here, field by field: pieces with scores and kinds,
the model type, and the normaliser's settings.  From these the backend is rebuilt:
the normaliser (character map, extra spaces, metaspace marker, dummy prefix), a
unigram model from the scores or a BPE model whose merges are ordered by the
scores, with byte fallback, and the decoder.  Texts are encoded in batches by the
library's threads, each distinct chunk once.  Parity with the SentencePiece
library is verified for every text: where no piece has a marker inside and the model changes nothing but
spaces to markers, a whole text's ids are its chunks' ids, and each distinct chunk is compared;
else whole texts are, so that a difference between the two normalisers is seen.  A text for which they differ
has SentencePiece's ids.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ChunkCache
from .common import table

MARK = "▁"
#: Kinds of pieces in the protobuf.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
BATCH = 256
THREADS = 2
MAX_DIFFER = 100_000


def fields(buffer: bytes):
    """(field number, value) of a protobuf message: ints for varints, bytes for the rest."""
    at = 0

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = buffer[at]
            value |= (byte & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if byte < 0x80:
                return value, at

    while at < len(buffer):
        tag, at = varint(at)
        wire = tag & 7
        if wire == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if wire == 2 else ({1: 8, 5: 4}[wire], at)
            value, at = buffer[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_spaces: bool = True

    @classmethod
    def parse(cls, buffer: bytes) -> PieceModel:
        model = cls([])
        for number, value in fields(buffer):
            if number == 1:
                own = dict(fields(value))
                model.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
            elif number == 2:
                own = dict(fields(value))
                model.kind, model.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif number == 3:
                own = dict(fields(value))
                model.charsmap = own.get(2, b"")
                model.add_dummy_prefix, model.remove_extra_spaces = bool(own.get(3, 1)), bool(own.get(4, 1))
        return model

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, best score first."""
        usable = {p: s for p, s, k in self.pieces if k in (NORMAL, USER_DEFINED)}
        found = [(-s, i, p[:i], p[i:]) for p, s in usable.items() for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
        return [(a, b) for _, _, a, b in sorted(found, key=lambda x: (x[0], x[1]))]

    def splits_at_marks(self) -> bool:
        """Whether no piece has a marker behind another character."""
        return not any(MARK in p.lstrip(MARK) for p, _, k in self.pieces if k in (NORMAL, USER_DEFINED))


def backend(model: PieceModel):
    """(tokenizer for whole texts, tokenizer for normalised chunks) of the tokenizers library."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
    if model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, model.merges(), unk_token=model.pieces[unknown][0] if unknown is not None else None, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip(True, True)]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    whole, chunk = Tokenizer(core), Tokenizer(core)
    whole.normalizer = normalizers.Sequence(steps)
    whole.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + [decoders.Strip(" ", 1, 0)] * model.add_dummy_prefix)
    return whole, chunk


class PieceCodec:
    """Encodes and decodes with one model file; a worker makes one and keeps it."""

    def __init__(self, path: str, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        with open(path, "rb") as f:
            self.model = PieceModel.parse(f.read())
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        self.whole, self.chunk = backend(self.model)
        self.cuts = self.model.splits_at_marks() and self.model.add_dummy_prefix and not (self.model.charsmap or self.model.remove_extra_spaces)
        self.cache = ChunkCache(self._encode_chunks, "<i4")
        #: Chunks in the cache to which the two libraries give different ids.
        self.differ: set[str] = set()
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode()
            for p, _, k in self.model.pieces
        ]

    def normalise(self, text: str) -> str:
        """The text with markers for spaces, as the model sees it."""
        return self.whole.normalizer.normalize_str(text) if self.model.charsmap or self.model.remove_extra_spaces else (MARK + text.replace(" ", MARK) if text else "")

    def _encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Chunks without their first marker."""
        ours = [e.ids for e in self.chunk.encode_batch([MARK + c for c in chunks], add_special_tokens=False)]
        theirs = self.reference.encode([c.replace(MARK, " ") for c in chunks], num_threads=THREADS)
        if "" in chunks:  # a marker alone; as a text of its own it would have none
            theirs[chunks.index("")] = self.reference.encode("x ")[len(self.reference.encode("x")) :]
        self.differ.update(c for c, a, b in zip(chunks, ours, theirs) if a != b)
        return ours

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """ids of each text as little-endian 32-bit integers, and whether both libraries give them."""
        if not self.cuts:
            ours = [e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False)]
            return [(np.asarray(b, "<i4").tobytes(), a == b) for a, b in zip(ours, self.reference.encode(texts, num_threads=THREADS))]
        if len(self.differ) >= MAX_DIFFER:  # the cache must not outlive what is known of its chunks
            self.cache, self.differ = ChunkCache(self._encode_chunks, "<i4"), set()
        chunked = []
        for t in texts:
            if not t:
                chunked.append([])
            elif "  " not in t and t[0] != " " and t[-1] != " " and MARK not in t:
                chunked.append(t.split(" "))
            else:
                chunked.append([c[1:] for c in re.findall(f"{MARK}+[^{MARK}]*", self.normalise(t))])
        ids = self.cache.join(chunked)
        same = [not self.differ or self.differ.isdisjoint(c) for c in chunked]
        odd = [t for t, s in zip(texts, same) if not s]
        theirs = iter(self.reference.encode(odd, num_threads=THREADS) if odd else [])
        return [(x if s else np.asarray(next(theirs), "<i4").tobytes(), s) for x, s in zip(ids, same)]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode(errors="replace")
        return text[1:] if self.model.add_dummy_prefix and text[:1] == " " else text


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_pieces(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ids, n_tokens, ids_crc32, round_trip and parity.

    round_trip: decoding the ids gives the normalised text.  parity: whether the
    rebuilt tokenizer and SentencePiece give the text the same ids; where
    not, the ids are SentencePiece's.
    Null text: as an empty one, no ids.  Very long texts are encoded whole; repeated rows get equal ids, an
    empty table gives an empty result.  Other columns are kept, and those named like
    a result column are replaced.  No shuffle.
    """
    made = ["ids", "n_tokens", "ids_crc32", "round_trip", "parity"]
    kept = [c for c in docs.columns if c != text and c not in made]

    def run(batches):
        c = codec(model)
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                part = b.slice(i, BATCH)
                texts = [t or "" for t in part.column(len(kept)).to_pylist()]
                ids, crc, round_trip, parity = [], [], [], []
                for t, (raw, same) in zip(texts, c.encode(texts)):
                    own = np.frombuffer(raw, "<i4")
                    normal = c.normalise(t).replace(MARK, " ")
                    round_trip.append(c.decode(own) == (normal[1:] if c.model.add_dummy_prefix else normal))
                    parity.append(same)
                    crc.append(zlib.crc32(raw))
                    ids.append(own)
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in range(len(kept))]
                    + [pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64()), pa.array(crc, pa.int64()), pa.array(round_trip), pa.array(parity)],
                    kept + made,
                )

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + ["ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean"])
    return docs.select(*kept, text).mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ids.

    Null ids give null, no ids an empty text; ids of any number are decoded at once, repeated rows to equal texts.  An
    empty table gives an empty result; a column named decoded is replaced.  An id that the model lacks is an error.
    """

    @F.pandas_udf("string")
    def run(column):
        c = codec(model)
        return column.map(lambda x: None if x is None else c.decode(np.asarray(x, "<i4")))

    return encoded.withColumn("decoded", run(ids))


def model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_pieces(docs, model_path()).select("doc_id", "n_tokens", "ids_crc32", "round_trip", "parity")


QUERIES = {"op8_pieces": op8_pieces}
ORACLES = {}
