"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

Texts are encoded once: they are cut where the tokenizer's own pattern cuts them anyway, and
each distinct piece is encoded by the library's model.  The ids are counted over the whole
corpus, and each id is replaced by its rank, so frequent ids take one byte.  The files are
Parquet: the ids by rank, and rows that are blocks in ascending doc_id order: the documents' ids and counts, control bytes
(four 2-bit lengths a byte) and, apart from them, data bytes (1 to 4 a value).
Spark writes and commits the files, so any store and lost executors are no matter.
Decoding looks up each control byte's four lengths in a table, gathers the bytes
with numpy and maps ranks back to ids.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .chunks import split_at_single_spaces
from .common import discard, shared_dir, stage, table

END_ID = 2
#: A block ends with the document that brings it to so many ids.
BLOCK_IDS = 1 << 18
#: Texts encoded at once.
BATCH = 256

#: The four lengths that a control byte stands for.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)

#: Classes of bytes: letters of Latin and Cyrillic writing in UTF-8, digits, signs but the apostrophe, which may begin a contraction, space, line feed, others.
LETTER, DIGIT, SIGN, SPACE, FEED, OTHER = range(6)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 0xC3, 0xC4, 0xC5, 0xD0, 0xD1, *range(0x80, 0xC0)]] = LETTER
_CLASS[[*b"0123456789"]] = DIGIT
_CLASS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = SIGN
_CLASS[0x20], _CLASS[0x0A] = SPACE, FEED
#: Longest piece, in bytes, that is remembered, and the factors of a hash's bytes by place.
MAX_LENGTH = 96
_RANDOM = np.random.default_rng(7).integers(0, 1 << 64, (2, 256), np.uint64) | np.uint64(1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Pieces that a worker remembers before it starts afresh, and places of its hash table.
MAX_KNOWN, PLACES = 600_000, 1 << 21


def cut_at_pattern(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte of each piece, first byte behind it, per text whether the cut holds) of texts in a row, given where they start.

    The tokenizer's byte-level pattern cuts where the class changes; a space belongs to what
    follows.  That holds for texts of the classes above without white space in a row or two letters that aren't any.
    """
    kind = _CLASS[raw]
    white = kind >= SPACE
    new = np.empty(len(raw), bool)
    new[:1] = True
    new[1:] = white[1:] | ((kind[1:] != kind[:-1]) & (kind[:-1] != SPACE))
    new[starts[starts < len(raw)]] = True
    wrong = kind == OTHER
    wrong[1:] |= white[1:] & white[:-1]
    # The signs for multiplication and division stand among the letters.
    wrong[1:] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
    first = np.flatnonzero(new)
    behind = np.append(first[1:], len(raw))
    long = behind - first > MAX_LENGTH
    at_fault = np.append(np.flatnonzero(wrong), first[long])
    holds = np.ones(len(starts), bool)
    holds[np.searchsorted(starts, at_fault, "right") - 1] = False
    return first, behind, holds


class _KnownPieces:
    """ids of pieces by a 64-bit hash of their bytes: a table of open addressing over numpy arrays."""

    def __init__(self, dtype: str):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.keys, self.number = np.zeros(PLACES, np.uint64), np.zeros(PLACES, np.int32)
        self.n = self.used = 0
        self.at, self.size = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int32)
        self.ids = np.zeros(1 << 12, self.dtype)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the hashes' pieces, -1 for unknown ones."""
        out = np.full(len(h), -1, np.int64)
        left, place = np.arange(len(h)), (h % np.uint64(PLACES)).astype(np.int64)
        while len(left):
            held = self.keys[place]
            hit = held == h[left]
            out[left[hit]] = self.number[place[hit]]
            more = ~hit & (held != 0)
            left, place = left[more], (place[more] + 1) % PLACES
        return out

    def add(self, h: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Pieces with distinct unknown hashes, their numbers of ids, and all their ids in a row."""
        number = np.arange(self.n, self.n + len(h))
        for name, values, at in (("at", self.used + np.cumsum(size) - size, self.n), ("size", size, self.n), ("ids", ids, self.used)):
            held = getattr(self, name)
            if at + len(values) > len(held):
                grown = np.zeros(2 * (at + len(values)), held.dtype)
                grown[:at] = held[:at]
                setattr(self, name, held := grown)
            held[at : at + len(values)] = values
        self.n, self.used = self.n + len(h), self.used + len(ids)
        left, place = np.arange(len(h)), (h % np.uint64(PLACES)).astype(np.int64)
        while len(left):
            free = self.keys[place] == 0
            self.keys[place[free]] = h[left[free]]
            won = free & (self.keys[place] == h[left])  # of several for one place the last one
            self.number[place[won]] = number[left[won]]
            left, place = left[~won], (place[~won] + 1) % PLACES


class _ByteForms(dict):
    """The model's characters for a text's, by code point."""

    def __init__(self):
        from tokenizers import pre_tokenizers

        self.level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, code: int) -> str:
        self[code] = out = self.level.pre_tokenize_str(chr(code))[0][0]
        return out


class BytePieces:
    """The worker's byte-level tokenizer.

    Texts are cut as the tokenizer's own pattern cuts them, and the library encodes each distinct piece
    once; a text's ids are its pieces' ids in a row.  Texts that can't be cut here so simply go to the library by chunks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.wide = size > 1 << 16
        self.dtype = "<u4" if self.wide else "<u2"
        self.known, self.forms = _KnownPieces(self.dtype), _ByteForms()
        # Only where the file cuts by the byte-level pattern and changes nothing before it may a text be cut here.
        cut = self.tokenizer.pre_tokenizer
        self.by_piece = self.tokenizer.normalizer is None and type(cut) is pre_tokenizers.ByteLevel and not cut.add_prefix_space
        # Added tokens are found before the pattern; texts that hold one are left to the library.
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        self.by_piece &= not any(" " in t.content or t.lstrip or t.rstrip for t in added)
        # Bytes of each token: the model's characters stand for one byte each.
        self.bytes_of = np.zeros(size, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self, flat: bytes, h: np.ndarray, first: np.ndarray, behind: np.ndarray) -> None:
        """Adds pieces.  Those that begin with a space are encoded in a row, as the pattern cuts there."""
        pieces = [flat[a:b] for a, b in zip(first.tolist(), behind.tolist())]
        spaced = np.array([p[0] == 0x20 and len(p) > 1 for p in pieces], bool)
        if spaced.any():
            row = [p for p, s in zip(pieces, spaced) if s]
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(row).decode()], add_special_tokens=False)[0].ids, np.int64)
            done, upto = np.cumsum(self.bytes_of[ids]), np.cumsum([len(p) for p in row])
            ends = np.searchsorted(done, upto)
            if ends[-1] < len(done) and (done[ends] == upto).all():
                self.known.add(h[spaced], np.diff(ends, prepend=-1), ids)
            else:
                spaced[:] = False
        others = [[t.id for t in self.tokenizer.model.tokenize(p.decode().translate(self.forms))] for p, s in zip(pieces, spaced) if not s]
        self.known.add(h[~spaced], np.array([len(x) for x in others], np.int64), np.array([i for x in others for i in x], np.int64))

    def _plain(self, texts: list[str]) -> list[np.ndarray | None]:
        """ids of the texts that can be cut here, None for others."""
        coded = [b"" if any(a in t for a in self.added) else t.encode(errors="surrogatepass") for t in texts]
        flat = b"".join(coded)
        raw = np.frombuffer(flat, np.uint8)
        sizes = np.array([len(c) for c in coded])
        starts = np.cumsum(sizes) - sizes
        if not len(raw):
            return [np.empty(0, self.dtype) if not t else None for t in texts]
        some = np.flatnonzero(sizes)
        first, behind, cut_holds = cut_at_pattern(raw, starts[some])
        holds = np.array([not t for t in texts])
        holds[some] = cut_holds
        # Pieces of the other texts are left out.
        owner = some[np.searchsorted(starts[some], first, "right") - 1]
        first, behind, owner = (x[holds[owner]] for x in (first, behind, owner))
        if self.known.n >= MAX_KNOWN:
            self.known.clear()
        size = behind - first
        # Bytes of the pieces that are left, with each one's place in its piece.
        begin = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(begin, size)
        byte = raw[np.repeat(first, size) + place]
        h = np.add.reduceat(_RANDOM[0][byte] * _RANDOM[1][place], begin) if len(begin) else np.empty(0, np.uint64)
        h = (h ^ (h >> np.uint64(33))) * _MIX
        h = (h ^ (h >> np.uint64(33))) | np.uint64(1)
        number = self.known.find(h)
        lacking = np.flatnonzero(number < 0)
        if len(lacking):
            new, at = np.unique(h[lacking], return_index=True)
            self._learn(flat, new, first[lacking[at]], behind[lacking[at]])
            number[lacking] = self.known.find(h[lacking])
        n = self.known.size[number].astype(np.int64)
        done = np.cumsum(n)
        ids = self.known.ids[np.repeat(self.known.at[number] - (done - n), n) + np.arange(done[-1] if len(done) else 0)]
        ends = np.append(0, done)[np.searchsorted(owner, np.arange(len(texts)), "right")].tolist()
        begins = [0, *ends[:-1]]
        return [ids[a:b] if ok else None for a, b, ok in zip(begins, ends, holds.tolist())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """ids of each text; of texts that can't be cut here the library encodes those chunks that can't."""
        if not self.by_piece:
            return self._library(texts)
        out = self._plain(texts)
        others = [i for i, ids in enumerate(out) if ids is None]
        chunked = [split_at_single_spaces(texts[i]) if not any(a in texts[i] for a in self.added) else [texts[i]] for i in others]
        parts = [c if k == 0 else " " + c for chunks in chunked for k, c in enumerate(chunks)]
        coded = self._plain(parts) if parts else []
        rest = iter(self._library([p for p, ids in zip(parts, coded) if ids is None]))
        coded = iter([next(rest) if ids is None else ids for ids in coded])
        for i, chunks in zip(others, chunked):
            out[i] = np.concatenate([next(coded) for _ in chunks])
        return out


_encoders: dict[str, BytePieces] = {}


def encoder(path: str) -> BytePieces:
    if path not in _encoders:
        _encoders[path] = BytePieces(path)
    return _encoders[path]


def encode_texts(texts: list[str], path: str, end_id: int = END_ID) -> list[bytes]:
    """ids of each text with the end id, as little-endian unsigned integers of 16 bits, or 32 for a larger vocabulary."""
    own = encoder(path)
    end = np.array([end_id], own.dtype).tobytes()
    return [ids.tobytes() + end for ids in own.encode(texts)]


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of values below 2**32, padded with zeros to a multiple of four."""
    v = np.zeros(-(-len(values) // 4) * 4, "<u4")
    v[: len(values)] = values
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = extra.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes) -> np.ndarray:
    """The values, with the padding."""
    n = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)
    at = np.cumsum(n, dtype=np.int64) - n
    b = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = b[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(n > k)
        out[more] |= b[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id, mark, wide, ids, seen, times): ids as little-endian bytes of 16 or 32 bits each (``wide``); mark is a hash of them.

    A task's last row is no document: its ids are null, ``seen`` and ``times`` are the ids that
    the task's documents hold and how often.
    """
    names = ["doc_id", "mark", "wide", "ids", "seen", "times"]

    def run(batches):
        wide, counts, kind = encoder(path).wide, np.zeros(0, np.int64), None
        for b in batches:
            ids, texts, kind = b.column(0), b.column(1).to_pylist(), b.column(0).type
            for i in range(0, len(texts), BATCH):
                coded = encode_texts([t or "" for t in texts[i : i + BATCH]], path, end_id)
                got = np.bincount(_ids(wide, b"".join(coded)))
                if len(got) > len(counts):
                    counts, got = got, counts
                counts[: len(got)] += got
                mark = np.array([xxh64_intdigest(c) for c in coded], np.uint64).view(np.int64)
                none = pa.nulls(len(coded), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.slice(i, BATCH), pa.array(mark), pa.array([wide] * len(coded), pa.bool_()), pa.array(coded, pa.binary()), none, none], names)
        some = np.flatnonzero(counts)
        if len(some):
            last = [pa.nulls(1, t) for t in (kind, pa.int64(), pa.bool_(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*last, *[pa.array([x], pa.list_(pa.int64())) for x in (some, counts[some])]], names)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, mark long, wide boolean, ids binary, seen array<long>, times array<long>")


def _ids(wide: bool, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if wide else "<u2")


def id_frequencies(encoded: DataFrame) -> DataFrame:
    """(id, n) over all documents, from the tasks' counts."""
    each = F.explode(F.arrays_zip("seen", "times"))
    return encoded.filter("seen IS NOT NULL").select(each.alias("x")).groupBy(F.col("x.seen").alias("id")).agg(F.sum("x.times").alias("n"))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    """Write the token files of ``docs`` under ``path``: ``ids``, the id of each rank, and ``blocks``.

    Columns of a block: shard, block, first (ids before it in its shard), n_ids,
    doc_ids, counts, control, data.  Shards are ranges of doc_id in order; documents of one
    doc_id are ordered by a hash of their ids, so many of them fill several shards.
    """
    encoded = stage(encode_documents(docs, tokenizer, **options), "token-ids")
    ranked = id_frequencies(encoded).orderBy(F.desc("n"), "id").collect()  # no more rows than the vocabulary has
    by_rank = np.array([r.id for r in ranked], "<u4")
    spark = docs.sparkSession
    spark.createDataFrame([(k, r.id, r.n) for k, r in enumerate(ranked)], "rank long, id long, n long").coalesce(1).write.parquet(f"{path}/ids")
    ranks = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, "<u4")
    ranks[by_rank] = np.arange(len(by_rank))
    ranks = spark.sparkContext.broadcast(ranks)
    kind = docs.schema[options.get("doc_id", "doc_id")].dataType.simpleString()

    def blocks(batches):
        shard = TaskContext.get().partitionId()
        block = first = size = 0
        held: list[tuple] = []

        def out():
            n = [len(h[1]) for h in held]
            # Each document starts with a control byte of its own.
            at = np.cumsum([0, *[-(-k // 4) * 4 for k in n]])
            values = np.zeros(at[-1], "<u4")
            for start, h in zip(at.tolist(), held):
                values[start : start + len(h[1])] = h[1]
            values = ranks.value[values]
            for start, k, end in zip(at.tolist(), n, at[1:].tolist()):
                values[start + k : end] = 0
            columns = [[shard], [block], [first], [sum(n)], [[h[0] for h in held]], [n], *[[x] for x in pack(values)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(id_kind), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["shard", "block", "first", "n_ids", "doc_ids", "counts", "control", "data"])

        for b in batches:
            id_kind = b.column(0).type
            for doc_id, wide, raw in zip(*[b.column(i).to_pylist() for i in range(3)]):
                ids = _ids(wide, raw)
                held.append((doc_id, ids))
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield out()
                    block, first, size, held = block + 1, first + size, 0, []
        if held:
            yield out()

    order = [F.col("doc_id").asc_nulls_last(), F.col("mark")]
    encoded.filter("ids IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order, "ids").select("doc_id", "wide", "ids").mapInArrow(
        blocks, f"shard int, block int, first long, n_ids long, doc_ids array<{kind}>, counts array<long>, control binary, data binary"
    ).write.option("compression", "zstd").parquet(f"{path}/blocks")
    discard(encoded)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files under ``path``."""
    files = spark.read.parquet(f"{path}/blocks")
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    # One row per shard.
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.selectExpr("shard", "sum(n) OVER (ORDER BY shard) - n AS before")
    ranked = spark.read.parquet(f"{path}/ids").orderBy("rank").collect()  # no more rows than the vocabulary has
    ids_by_rank = spark.sparkContext.broadcast(np.array([r.id for r in ranked], "<u4"))

    def decode(batches):
        for b in batches:
            for doc_ids, counts, control, data, start in zip(*[b.column(i).to_pylist() for i in range(5)]):
                ids = ids_by_rank.value[unpack(control, data)].astype("<u4")
                at = 0
                rows = []
                for n in counts:
                    own = ids[at : at + n]
                    rows.append((start, n, zlib.crc32(own.tobytes()), own.tolist() if with_ids else None))
                    start, at = start + n, at + -(-n // 4) * 4
                columns = [pa.array(doc_ids, b.column(0).type.value_type)] + [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([r[3] for r in rows], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    placed = files.join(F.broadcast(shards), "shard").select("doc_ids", "counts", "control", "data", (F.col("before") + F.col("first")).alias("start"))
    return placed.mapInArrow(decode, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Write token files of ``docs`` and read them back.

    Null texts are empty and give the end id alone.  Null doc_ids come last; rows with
    equal doc_id stand in order of a hash of their ids, equal rows side by side.  A text of any length is encoded whole and fills
    blocks of its own size.  An
    empty table gives an empty result.  Other columns of ``docs`` aren't used.
    """
    path = path or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer, **options)
    return read_token_files(docs.sparkSession, path)


def op7_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("byte_bpe_50k.json"))
    return token_files(table(spark, sf_dir, "documents"), tokenizer)


QUERIES = {"op7_token_files": op7_token_files}
ORACLES = {}
