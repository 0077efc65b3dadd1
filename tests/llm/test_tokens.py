import random
import zlib


import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from monthmill.llm import pieces, token_files
from monthmill.llm.chunks import split_at_single_spaces

BPE = str(P.path("byte_bpe_50k.json"))
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \nb", "a\n b c", "\n \n a", "x<|endoftext|> y <|endoftext|>", "don't  stop'll", "é ▁ ▁▁a ▁b", "日本 語", "\x1c a\x85 b", "a  b   c", "<s> <unk> <0x0A>", "😀 \t 12 3"]
texts = st.lists(st.text(st.sampled_from(" \n\tabé.1▁' "), max_size=30), max_size=5)


@given(st.lists(st.integers(0, 2**32 - 1), max_size=40))
def test_pack_round_trip(values):
    got = token_files.unpack(*token_files.pack(np.array(values, "<u4")))
    assert got[: len(values)].tolist() == values and not got[len(values) :].any()


@settings(deadline=None, max_examples=200)
@given(texts)
def test_chunked_ids_equal_whole_text_ids(some):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    some = some + ODD
    got = token_files.encode_texts(some, BPE)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [e.ids + [2] for e in t.encode_batch(some, add_special_tokens=False)]
    assert all(" ".join(split_at_single_spaces(x)) == x for x in some)


def brute(docs, end=2):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    out, start = [], 0
    for i, x in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [end], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_equal_brute_force(spark, sf_dir):
    docs = [(i * 7 % 101, x) for i, x in enumerate(ODD * 3)] + [(None, "last"), (1000, None), (1001, "word " * 50_000)]
    got = token_files.token_files(spark.createDataFrame(docs, "doc_id long, text string"), BPE).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute(docs)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, token_files.op7_token_files(spark, sf_dir).collect()), key=lambda r: r[1]) == brute(rows)
    assert token_files.token_files(spark.createDataFrame([], "doc_id long, text string"), BPE).count() == 0


def test_known_pieces_start_afresh(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "MAX_KNOWN", 30)
    monkeypatch.setattr(token_files, "PLACES", 64)
    own, t = token_files.BytePieces(BPE), Tokenizer.from_file(BPE)
    for k in range(40):
        some = [f"alpha beta w{k} w{k % 7} " + "long" * 40, f"alpha, w{k} beta", f"x{k}", "", "it's \tодно слово×2", f"größe {k}÷2"]
        assert [x.tolist() for x in own.encode(some)] == [e.ids for e in t.encode_batch(some, add_special_tokens=False)]
        assert own.known.n < 64


def test_chunk_cache_stays_bounded(monkeypatch):
    from monthmill.llm import chunks

    monkeypatch.setattr(chunks, "MAX_CACHED", 4)
    cache = chunks.ChunkCache(lambda some: [[len(c)] for c in some], "<i4")
    for k in range(30):
        lists = [[f"c{k}", "a", "x" * 100, f"d{k % 3}"], [], ["a"]]
        assert cache.join(lists) == [np.array([len(c) for c in x], "<i4").tobytes() for x in lists]
        assert len(cache.known) < 8 and len(cache.old) < 8 and "x" * 100 not in cache.known


def test_files_can_be_read_alone(spark, tmp_path):
    docs = spark.createDataFrame([(None, f"null {i}") for i in range(60)] + [(i, f"text number {i}") for i in range(20)], "doc_id long, text string").repartition(6)
    token_files.write_token_files(docs, f"file://{tmp_path}/t", BPE)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    got = token_files.read_token_files(spark, f"file://{tmp_path}/t", with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == [*range(20), *[None] * 60]
    assert [t.decode(r.ids[:-1]) for r in got[:20]] == [f"text number {i}" for i in range(20)]
    assert sorted(t.decode(r.ids[:-1]) for r in got[20:]) == sorted(f"null {i}" for i in range(60))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))


def test_repeated_ids(spark):
    got = token_files.token_files(spark.createDataFrame([(1, "a b"), (1, "a b"), (1, None), (0, "c")], "doc_id long, text string"), BPE).collect()
    assert sorted((r.start, r.doc_id) for r in got)[0] == (0, 0) and len(got) == 4 and sum(r.n_tokens for r in got) == 9


def test_pieces_equal_sentencepiece(spark, sf_dir):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(10_000 + i, x) for i, x in enumerate(ODD)] + [(None, None)]
    df = spark.createDataFrame([(i, x, 5) for i, x in docs], "doc_id long, text string, parity int")
    got = pieces.encode_pieces(df, pieces.model_path()).collect()
    text = dict(docs)
    for r in got:
        assert list(r.ids) == sp.encode(text[r.doc_id] or ""), text[r.doc_id]
        assert r.parity and r.n_tokens == len(r.ids)
        assert r.round_trip or pieces.MARK in text[r.doc_id]
    back = pieces.decode_pieces(spark.createDataFrame([(r.doc_id, r.ids) for r in got], "doc_id long, ids array<int>"), pieces.model_path()).collect()
    assert all(r.decoded == (text[r.doc_id] or "").replace(pieces.MARK, " ") for r in back)
    assert pieces.encode_pieces(df.limit(0), pieces.model_path()).count() == 0


@settings(deadline=None, max_examples=200)
@given(texts)
def test_backend_equals_sentencepiece(some):
    c = pieces.codec(pieces.model_path())
    want = c.reference.encode(some + ODD)
    assert [(np.frombuffer(x, "<i4").tolist(), same) for x, same in c.encode(some + ODD)] == [(w, True) for w in want]
    assert [e.ids for e in c.whole.encode_batch(some + ODD)] == want


def test_unigram_backend():
    model = pieces.PieceModel([("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -2.0, 1), ("▁", -3.0, 1), ("ab", -2.5, 1), ("a", -4.0, 1)], pieces.UNIGRAM)
    whole, _ = pieces.backend(model)
    assert whole.encode("ab  b").tokens == ["▁a", "b", "▁", "b"]


def test_protobuf_fields():
    assert list(pieces.fields(b"\x08\x96\x01\x12\x02hi\x1d\x00\x00\x80\x3f")) == [(1, 150), (2, b"hi"), (3, b"\x00\x00\x80?")]
    with pytest.raises(IndexError):
        list(pieces.fields(b"\x08"))


def test_parity_shows_faults_of_the_backend(monkeypatch):
    import pyarrow as pa

    path = pieces.model_path()
    c = pieces.PieceCodec(path)
    monkeypatch.setitem(pieces._codecs, path, c)
    right = c.chunk

    class Wrong:
        ids = [5]

    class Faulty:
        def encode_batch(self, chunks, **options):
            return [Wrong if x == "▁wrong" else y for x, y in zip(chunks, right.encode_batch(chunks, **options))]

    c.chunk = Faulty()
    monkeypatch.setattr(pieces, "MAX_DIFFER", 1)
    texts = [f"{w} text {i}" for i in range(70) for w in ("some", "wrong")]

    class Docs:
        columns = ["text"]
        select = lambda self, *a: self
        mapInArrow = lambda self, run, schema: run

    rows = [r for b in pieces.encode_pieces(Docs(), path)(iter([pa.RecordBatch.from_pydict({"text": texts})])) for r in b.to_pylist()]
    assert [r["parity"] for r in rows] == [not t.startswith("wrong") for t in texts]
    assert [r["ids"] for r in rows] == c.reference.encode(texts)


def with_normaliser(folder, spaces: bool, rule: str | None) -> str:
    """The public model with another normaliser: fields that follow in a protobuf message replace those before."""
    import sentencepiece

    def message(number, value):
        size, head = len(value), bytes([number << 3 | 2])
        out = b""
        while size >= 128:
            out, size = out + bytes([size & 127 | 128]), size >> 7
        return head + out + bytes([size]) + value

    own = bytes([4 << 3, int(spaces)])
    if rule:
        made = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
        own += message(2, dict(pieces.fields(dict(pieces.fields(made))[3]))[2])
    path = folder / f"{rule}-{spaces}.model"
    with open(pieces.model_path(), "rb") as f:
        path.write_bytes(f.read() + message(3, own))
    return str(path)


@pytest.mark.parametrize("spaces, rule", [(True, None), (False, "nmt_nfkc"), (True, "nfkc"), (True, "nmt_nfkc_cf")])
def test_models_that_normalise_have_sentencepieces_ids(tmp_path, spaces, rule):
    c = pieces.PieceCodec(with_normaliser(tmp_path, spaces, rule))
    assert bool(c.model.charsmap) == bool(rule) and c.model.remove_extra_spaces == spaces
    rng = random.Random(3)
    letters = "aB c  ﬁ ｆｕ①²é́​　 \tℌ½ǆ中▁ÅÅ̈"
    some = ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(1500)] + ODD
    want = c.reference.encode(some)
    got = c.encode(some)
    assert [np.frombuffer(x, "<i4").tolist() for x, _ in got] == want
    whole = [e.ids for e in c.whole.encode_batch(some, add_special_tokens=False)]
    assert [same for _, same in got] == [a == b for a, b in zip(whole, want)]
