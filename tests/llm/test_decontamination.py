"""Phrase and proximity matches against a plain search."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from monthmill.llm import decontamination as dec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=10):
    asked = []
    for name, text in items:
        w = words(text)
        k = min(width, len(w))
        asked += [(name, w[s : s + k]) for s in range(len(w) - k + 1) if k]
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for name, window in asked:
            for s in range(len(w) - len(window) + 1):
                if w[s : s + len(window)] == window:
                    hit |= set(range(s, s + len(window)))
                    names.add("" if name is None else str(name))
        out.append((i, len(w), len(hit), len(names), tuple(sorted(names)), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r.item_ids), r.contaminated) for r in df.collect()), key=str)


def frames(spark, docs, items):
    d = spark.createDataFrame([(*x, "a", 1) for x in docs], "doc_id long, text string, shard string, n int").repartition(3)
    return d, spark.createDataFrame([(*x, "b") for x in items], "item_id long, text string, term string")


def planted():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["é1", "Ünd", "中文", "the", "the", "the", "of", "of"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([1, 3, 9, 10, 11, 14, 30])))) for i in range(25)]
    items += [(30, "the the the the the the the the the the the the"), (31, ""), (32, None), (33, " .,- "), (None, "quite unlike anything"), (7, items[3][1]), (40, items[4][1]), (3, items[3][1])]
    docs = []
    for i in range(120):
        w = some(rng.choice([0, 1, 5, 30, 200]))
        for _ in range(rng.choice([0, 0, 1, 3])):
            v = words(rng.choice(items)[1])
            cut = v[rng.randrange(3) : len(v) - rng.randrange(3)]
            at = rng.randrange(len(w) + 1)
            w[at:at] = cut
        docs.append((i % 100, rng.choice([" ", ", ", "\n", "\u0000"]).join(w).replace("w1", "W1")))
    docs += [(200, None), (201, ""), (202, " "), (None, "the " * 50), (203, "x " * 20_000 + items[0][1] + " y" * 20_000), (204, "quite unlike"), (205, "anything")]
    return docs, items


def test_equals_brute_force(spark, monkeypatch):
    docs, items = planted()
    assert any(r[2] for r in brute(docs, items))
    for limit in (dec.SHARD_BYTES, 500):  # shards of one or a few documents too
        monkeypatch.setattr(dec, "SHARD_BYTES", limit)
        assert rows(dec.contamination(*frames(spark, docs, items))) == brute(docs, items)


def test_stretches_of_long_items(spark, monkeypatch):
    monkeypatch.setattr(dec, "STRETCH", 4)
    docs, items = planted()
    assert rows(dec.contamination(*frames(spark, docs, items), width=6)) == brute(docs, items, 6)


def test_no_match_crosses_documents(spark):
    docs, items = [(1, "a b c"), (2, "d e f"), (3, "a b c d e f")], [(9, "a b c d e f")]
    d, i = frames(spark, docs, items)
    assert rows(dec.contamination(d.coalesce(1), i)) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = planted()
    d, i = frames(spark, docs[:20], items)
    assert rows(dec.contamination(d.limit(0), i)) == []
    assert rows(dec.contamination(d, i.limit(0))) == brute(docs[:20], [])


def test_proximity(spark):
    item = "one two three four five"
    docs = [(1, "x " + item + " y"), (2, "one two uh three four five"), (3, "one two uh uh three four five"), (4, "two one three four five"), (5, "one one two two three four four five"), (6, "one two three four"), (7, "one two three uh four five one two three four five")]
    d, i = frames(spark, docs, [(1, item), (2, item)])
    got = sorted((r.doc_id, r.item_id, r.start, r.stop, r.exact) for r in dec.matches(d, i, slack=1).collect())
    want = [(1, 1, 6, True), (2, 0, 6, False), (7, 0, 6, False), (7, 6, 11, True)]
    assert got == sorted((doc, name, a, b, e) for doc, a, b, e in want for name in (1, 2))
    spread = {r.doc_id: r.n_near for r in dec.contamination(d, i, slack=2).collect()}
    assert spread == {1: 0, 2: 2, 3: 2, 4: 0, 5: 2, 6: 0, 7: 2}


def test_digest_of_the_query(spark, tmp_path):
    docs, items = planted()
    d, i = frames(spark, docs, items)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    i.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(map(tuple, dec.op12_decontamination(spark, str(tmp_path)).collect()), key=str)
    want = [(*r[:4], hashlib.sha256(",".join(r[4]).encode()).hexdigest(), r[5]) for r in brute(docs, items)]
    assert got == sorted(want, key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9 .é\x00~中 ", max_size=12)), max_size=6), st.integers(0, 3))
def test_words_of_a_batch(texts, skip):
    counts, flat = dec.split_words(pa.array(texts, pa.string())[skip:])
    want = [words(t) for t in texts[skip:]]
    assert counts.tolist() == [len(w) for w in want] and flat.to_pylist() == [x for w in want for x in w]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=50))
def test_lists_are_read_back(values):
    values = np.unique(np.array(values))
    raw, size = dec.packed(np.diff(values, prepend=0))
    assert size.sum() == len(raw) and dec.unpacked(raw.tobytes()).tolist() == values.tolist()
