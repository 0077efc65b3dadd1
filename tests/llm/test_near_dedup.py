import random

import numpy as np

from monthmill.llm import near_dedup as nd
from monthmill.llm.components import connected_components


def brute(docs, width=4, percent=80):
    sets, parent = {}, {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets[i] = s
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    holders = {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    shared = {}
    for h in holders.values():
        for k, a in enumerate(h):
            for b in h[k + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def check(docs, got):
    want = brute(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_table_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").collect()]
    check(docs, nd.op2_near_dedup(spark, sf_dir.replace("0.001", "0.01")).collect())


def test_groups_and_chains(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    docs, i = [], 0
    for _ in range(12):  # chains: each document differs a little from the one before
        w = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(15):
            docs.append((i, " ".join(w)))
            w = list(w)
            w[rng.randrange(120)] = rng.choice(vocabulary)
            w[rng.randrange(120)] = rng.choice(vocabulary)
            i += 1
    for _ in range(5):  # stars around a text that comes last
        base = [rng.choice(vocabulary) for _ in range(100)]
        for _ in range(30):
            w = list(base)
            for _ in range(3):
                w[rng.randrange(100)] = rng.choice(vocabulary)
            docs.append((i, " ".join(w)))
            i += 1
        docs.append((i, " ".join(base)))
        i += 1
    docs += [(i, None), (i + 1, ""), (i + 2, "a B"), (i + 3, "A  b"), (i + 4, " \n "), (i + 5, "a b c d"), (i + 6, "a b c d e")]
    rng.shuffle(docs)
    df = spark.createDataFrame([(a, b, a) for a, b in docs], "doc_id long, text string, component_id long")
    check(docs, nd.near_duplicates(df, width=4).collect())
    kept = nd.one_of_each(df, width=4).collect()
    assert sorted(r.doc_id for r in kept) == sorted(k for k, v in brute(docs).items() if k == v[1])


def test_nulls_repeats_empty(spark):
    long = " ".join(f"x{i}" for i in range(50))
    df = spark.createDataFrame([(None, long), (5, long), (3, long), (3, long), (7, "other text of five words"), (7, long)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.component_id, r.kept) for r in nd.near_duplicates(df).collect()), key=str)
    assert got == sorted([(-1, None, True), (5, 3, False), (3, 3, True), (3, 3, True), (7, 3, False), (7, 3, False)], key=str)
    assert nd.near_duplicates(df.limit(0)).count() == 0
    assert nd.one_of_each(df).count() == 2


def test_drifted_copies_meet_across_components(spark):
    """Edited copies of one text around the threshold, of several lengths: pairs that only the rarest shingles bring together."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    docs = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randrange(2, 9)):
            k = rng.randrange(len(w))
            if rng.random() < 0.4:
                w[k] = f"n{rng.randrange(25)}"
            elif rng.random() < 0.5:
                del w[k]
            else:
                w.insert(k, f"m{rng.randrange(25)}")
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(docs, nd.near_duplicates(df, width=4).collect())


def test_sketch_concentration():
    rng = np.random.default_rng(0)
    for n in (1, 3, 50, 5000):
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        s = nd.sketches([x])[0]
        assert (s >> np.uint64(32)).max() < 2 * nd.BINS
        assert (nd.sketches([rng.permutation(x), x[:1]])[0] == s).all()
    a = rng.integers(0, 2**63, 1200).astype(np.uint64)
    got = [(nd.sketches([a[:1000]]) == nd.sketches([a[100:1100]])).mean()]
    assert abs(got[0] - 900 / 1100) < 0.08


def test_hashed_words_and_sets(monkeypatch):
    texts = ["A b\tC\x0bd", None, "", " \n", "one", "Ünï Ünï ünï \u2003x\x1cy", "a b c d", "a  B c D ", "b a", "x" * 300 + " y"]
    for step in (1, 7, 1 << 21):
        monkeypatch.setattr(nd, "STEP_BYTES", step)
        flat, seen = b"\n".join((t or "").encode() for t in texts), {}
        h, start = nd.word_hashes(np.frombuffer(flat, np.uint8))
        words = flat.lower().split()
        assert len(h) == len(words)
        for w, x, at in zip(words, h.tolist(), start.tolist()):
            assert flat[at : at + len(w)].lower() == w and seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)
        sets = [tuple(s.tolist()) for s in nd.shingle_sets(texts, 4)]
        assert [len(s) for s in sets] == [1, 0, 0, 0, 1, 1, 1, 1, 1, 1]
        assert sets[0] == sets[6] == sets[7] and len(set(sets)) == 6


def test_batches_cover_every_text_once():
    texts = ["x" * n for n in (0, 5, 1 << 23, 1, 1)] + [None] * 2000
    parts = list(nd.batches_of(texts))
    assert [i for p in parts for i in range(p.start, p.stop)] == list(range(len(texts)))
    assert all(p.stop - p.start <= nd.BATCH for p in parts) and not list(nd.batches_of([]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)] + [(1000, 1000 + i) for i in range(50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[40] == 0 and got[300] == 100 and got[1049] == 1000 and len(got) == 41 + 3 + 50
