"""URL filter, line frequency, mixing, toxicity and embeddings: fixtures with nulls, ties, repeats and empty tables."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthmill.llm import embedding_dedup, line_frequency, mixing, toxicity, url_filter

ENTRIES = url_filter.RULES + url_filter.LISTED


def brute_url(url, entries=ENTRIES):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
    host = host.translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))
    best = {}
    for h, p, v, is_rule in entries:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best[is_rule] = max(best.get(is_rule, ((-1, -1), "", "")), ((len(h + p), len(h)), h + p, v))
    rule, listed = best.get(True), best.get(False)
    return host, path, rule and rule[1], rule[2] if rule else listed[2] if listed else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://ORG/", "http://x.org", "https://a.b.Example.org/es/1?x#y", "http://example.org/en/123", "http://notexample.org/en/1",
    "ftp://é.example.com/fr/ü", "http://com/de/", "http://a..com/de/x/../y", "x://ads-track.example.com/a", "http://ads-track.example.com/de/", "http://u@h.org:80/p", "a://b://org/",
]


@pytest.mark.parametrize("most", [url_filter.MAX_ENTRIES, 3])
def test_urls_equal_brute_force(spark, most):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    entries = spark.createDataFrame(ENTRIES, "host string, path string, verdict string, is_rule boolean")
    got = url_filter.judge(pages, entries, max_entries=most).collect()
    assert len(got) == len(URLS) * 2
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute_url(r.url), r.url
    assert url_filter.judge(pages.limit(0), entries, max_entries=most).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, entries.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("most", [url_filter.MAX_ENTRIES, 1])
def test_clashing_repeated_and_null_entries(spark, most):
    entries = [
        ("org", "/", "block", False), ("ORG", "/", "allow", True), ("a.org", "/x", "allow", True), ("a.org", "/x", "block", True), ("a.org", "/x", "block", True),
        ("net", None, "block", False), (None, "/", "block", True), ("com", "/", None, True), ("com", "/", "block", None), ("b.net", "/" + "p" * 300, "allow", True), ("", "/q", "block", True),
    ]
    urls = ["http://a.org/x", "http://a.org/y", "http://c.net/", "http://com/", "http://b.net/" + "p" * 301, "http://b.net/p", "http:///q", None]
    df = spark.createDataFrame(entries, "host string, path string, verdict string, is_rule boolean")
    pages = spark.createDataFrame([(u, "kept") for u in urls], "url string, _found string")
    got = {r.url: (r.rule, r.verdict, r["_found"]) for r in url_filter.judge(pages, df, max_entries=most).collect()}
    known = [(h.lower(), p or "", v, r) for h, p, v, r in entries if h is not None and v is not None and r is not None]
    assert got == {u: (*brute_url(u, known)[2:], "kept") for u in urls}
    assert got["http://a.org/x"][:2] == ("a.org/x", "block") and got["http://a.org/y"][:2] == ("org/", "allow") and got["http://c.net/"][1] == "block"


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "xxh64_intdigest", lambda k: 7)
    index = url_filter.open_index(url_filter.build_index(list(ENTRIES), str(tmp_path)))
    assert url_filter.probe(["x.example.org", "a.net"], ["/en/1", "/"], index) == [("example.org/en/1", "block", None), (None, None, None)]


def brute_lines(docs, min_docs, share):
    words = lambda t: t.encode().split()
    norm = lambda x: "".join("0" if c in "0123456789" else c for c in b" ".join(words(x)).decode()).lower()
    holders, hosts = {}, {}
    for _, h, t in docs:
        t = t or ""
        hosts.setdefault(h, set()).add(t)
        for x in t.split("\n"):
            if words(x):
                holders.setdefault((h, norm(x)), set()).add(t)
    out = []
    for i, h, t in docs:
        t = t or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lost = sum(len(words(x)) for x in lines if len(holders[h, norm(x)]) >= max(min_docs, share * len(hosts[h])))
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        out.append((i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed, lost, not failed and lost <= 0.5 * len(w)))
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa a# $b é 12".split())
    common = ["Read more on page 12", "all  rights\treserved here", "x"]
    docs = [(i, rng.choice(["h1", "h1", "h2", None]), "\n".join([" ".join(word() for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(1, 6))] + rng.sample(common, rng.randrange(0, 3)))) for i in range(120)]
    docs += [(200, "h1", None), (201, "h1", ""), (202, None, "a a a a a a a"), (203, "h1", docs[0][2]), (203, "h1", docs[0][2]), (None, "h2", "a b c d e f g h i j k a b c d e"), (204, "h9", "\n \n\t\n"), (205, "h2", "w " * 30_000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, text string, kept int")
    got = line_frequency.line_frequency(df, min_docs=5).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_lines(docs, 5, line_frequency.HOST_SHARE), key=str)
    assert line_frequency.line_frequency(df.limit(0)).count() == 0


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        t = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > 3 * sizes[s]]
        if not over:
            return fixed | t
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mix(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice(["a", "b", "b", "b", "b", "c", None]), "w " * rng.choice([1, 5, 40, 41, 42, 300])) for i in range(900)]
    docs += [(1000, "a", None), (1001, "z", ""), (None, "a", "x y"), (1002, "tiny", "x"), (5, docs[5][1], docs[5][2])]
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, source string, text string, target double")
    got = mixing.mix(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str)
    assert len(got) == len(docs)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.copies in (0, 1, 2, 3) and r.taken == r.copies * r.size
    want = brute_targets(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 301, s
    rows = mixing.repeat_by_mix(df)
    assert rows.columns == df.columns and rows.count() == sum(r.copies for r in got)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.repeat_by_mix(df.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(df.filter("doc_id = 1000")).collect()} == {0}


def test_mix_of_repeated_rows(spark):
    rows = [(7, "a", "w " * 10)] * 50 + [(1000 + i, "b", "w " * 10) for i in range(150)] + [(None, "c", f"x{i % 5} y")for i in range(60)]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, source string, text string, _copies string")
    for parts in (1, 5):
        got = mixing.mix(df.repartition(parts)).collect()
        taken, target = Counter(), {}
        for r in got:
            taken[r.source] += r.taken
            target[r.source] = r.target
            assert 0 <= r.copies <= 3
        assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 10 for s in taken), (taken, target)
        assert max(r.copies for r in got if r.source == "a") - min(r.copies for r in got if r.source == "a") <= 1
    out = mixing.repeat_by_mix(df).collect()
    assert Counter(r.source for r in out) == Counter({s: n for s in "abc" if (n := sum(r.copies for r in got if r.source == s))})
    assert {r["_copies"] for r in out} == {"kept"} and set(map(tuple, out)) <= {(*r, "kept") for r in rows}
    again = mixing.repeat_by_mix(df.repartition(9)).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)


def test_table_is_rounded_as_a_plain_loop_does(spark, sf_dir):
    """The same blocks and draws, folded in Python."""
    units = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", F.struct("doc_id", mixing.n_words(F.col("text")).alias("size")).alias("key"), F.lit(0.37).alias("f")).filter("key.size > 0")
    got = {(r.source, r.key.doc_id): r.x for r in mixing.pivotal_round(units, block=16, seed=3).collect()}
    level, want, depth = {(r.source, r.key.doc_id): (r.key["size"], 0.37) for r in units.collect()}, {}, 0
    while True:
        df = spark.createDataFrame([(s, i, z) for (s, i), (z, _) in level.items()], "source string, doc_id long, size long").withColumn("key", F.struct("doc_id", "size"))
        counts = Counter(s for s, _ in level)
        drawn = df.select("source", "doc_id", mixing.uniform(F.col("key"), F.col("source"), F.lit(depth), F.lit(3)).alias("u"), F.xxhash64("key", F.lit(depth), F.lit(3)).alias("h")).collect()
        blocks = {}
        for r in drawn:
            blocks.setdefault((r.source, r.h % -(-counts[r.source] // 16)), []).append((level[r.source, r.doc_id][0], r.doc_id, level[r.source, r.doc_id][1], r.u))
        left = {}
        for (s, _), entries in blocks.items():
            held = None
            for z, i, f, u in sorted(entries, reverse=True):
                if held is None:
                    held = [z, i, f]
                    continue
                up, down = min((1 - held[2]) * held[0], f * z), min(held[2] * held[0], (1 - f) * z)
                moved = up if u < down / (up + down) else -down
                a, b = held[2] + moved / held[0], f - moved / z
                whole = lambda x: x < mixing.EPS or x > 1 - mixing.EPS
                if whole(a):
                    want[s, held[1]] = round(a)
                if whole(b):
                    want[s, i] = round(b)
                held = None if whole(a) and whole(b) else [z, i, b] if whole(a) else [held[0], held[1], a]
            if held:
                left[s, held[1]] = (held[0], held[2])
        if max(Counter(s for s, _ in left).values(), default=0) <= 1:
            want |= {k: int(f >= 0.5) for k, (_, f) in left.items()}
            break
        level, depth = left, depth + 1
    assert got == want


def test_pivotal_inclusion_is_fair(spark):
    units = spark.range(400).select(F.lit("s").alias("source"), F.struct(F.col("id").alias("doc_id"), (F.col("id") % 9 + 1).alias("size")).alias("key"), F.lit(0.3).alias("f"))
    picked = Counter()
    for seed in range(6):
        got = mixing.pivotal_round(units, block=16, seed=seed).collect()
        assert len(got) == 400
        picked.update(r.key.doc_id for r in got if r.x == 1)
        assert abs(sum(r.key["size"] * (r.x - 0.3) for r in got)) <= 10
    assert abs(sum(picked.values()) / 2400 - 0.3) < 0.05


def test_toxicity_folding_and_exceptions():
    lexicon = toxicity.Lexicon({" trash ": 5.0, " idio": 4.0, " clown ": 3.0})
    a = lexicon.automaton()
    assert toxicity.match("Such TR4SH!", a)[0] == toxicity.match("such trаsh", a)[0] == 5.0  # a digit; a Cyrillic letter
    assert toxicity.match("an 1d1otic id", a)[0] == 4.0
    assert toxicity.match("put it into the trash can, clown fish", a)[0] == 0.0
    assert toxicity.match("trashy", a)[0] == 0.0 and toxicity.match("", a) == (0.0, 0.0)
    short, long = toxicity.match("trash", a)[1], toxicity.match("trash " + "word " * 99, a)[1]
    assert short > long > 0


def test_signs_between_letters():
    a = toxicity.Lexicon({" idiot ": 5.0, " bitch ": 4.0, " stupid ": 3.0}).automaton()
    assert toxicity.match("an id!ot", a)[0] == 5.0 and toxicity.match("b|tch", a)[0] == 4.0 and toxicity.match("s+upid!", a)[0] == 3.0
    assert toxicity.match("idiot! stupid| idiot+", a)[0] == 13.0 and toxicity.fold("yes!") == " yes "


def toxic_fixture():
    rng = random.Random(11)
    plain = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    docs, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        bad = i % 4 == 0
        if bad:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["zonk", "zonkers", "Gr0mp", "flarb!"]))
        elif i % 9 == 1:
            words.insert(2, "zonk board")  # always behind the same word
            words[1] = "harmless"
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def naive_fold(text):
    """Character by character, without tables."""
    import unicodedata

    out = ""
    for k, c in enumerate(text):
        if c in "!|+" and 0 < k < len(text) - 1 and text[k - 1].isalpha() and text[k + 1].isalpha():
            c = {"!": "i", "|": "i", "+": "t"}[c]
        c = toxicity.SUBSTITUTES.get(c, c)
        if c not in "äöüß":
            c = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        c = "".join(toxicity.HOMOGLYPHS.get(x, toxicity.SUBSTITUTES.get(x, x)) for x in c)
        out += c if c.isalpha() else " "
    return out.split()


def naive_total(text, lexicon):
    folded = " " + " ".join(naive_fold(text)) + " "
    spared = [(k, k + len(p)) for e in lexicon.exceptions for p in [f" {' '.join(naive_fold(e))} "] if p not in lexicon.weights for k in range(len(folded)) if folded.startswith(p, k)]
    best = {}
    for entry, w in lexicon.weights.items():
        for k in range(len(folded)):
            if folded.startswith(entry, k):
                best[k] = max(best.get(k, 0.0), w)
    return sum(w for k, w in best.items() if not any(a <= k < b for a, b in spared)), max(1, len(folded.split()))


def test_toxicity_equals_brute_force(spark):
    """Weights, exceptions and scores by plain loops."""
    docs, labels = toxic_fixture()
    df = spark.createDataFrame([(*d, "kept") for d in docs], "doc_id long, text string, _m string").repartition(5)
    lexicon = toxicity.learn(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    flag = {i: t for i, t in labels if zlib.crc32(str(i).encode()) % 5}
    fit = [(naive_fold(t), flag[i], t) for i, t in docs if i in flag]
    n = Counter(f for _, f, _ in fit)
    before, holders, clean = {}, {}, Counter()
    for w, f, t in fit:
        for k, x in enumerate(w):
            for e in {f" {x} ", *[f" {x[:m]}" for m in toxicity.PREFIXES if m < len(x)]}:
                if f:
                    before.setdefault(e, set()).add(w[k - 1] if k else "")
                    holders.setdefault(e, set()).add(t)
        clean.update({e for x in w for e in {f" {x} ", *[f" {x[:m]}" for m in toxicity.PREFIXES if m < len(x)]}} if not f else ())
    want = {}
    for e in holders:
        support = min(len(before[e]), len(holders[e]))
        weight = np.log((support + 0.5) / (n[1] + 1)) - np.log((clean[e] + 0.5) / (n[0] + 1))
        if support >= toxicity.MIN_SUPPORT and weight >= toxicity.MIN_WEIGHT:
            want[e] = weight
    assert lexicon.weights.keys() == want.keys() and all(abs(lexicon.weights[e] - want[e]) < 1e-9 for e in want) and " zonkers " in want
    pairs = {0: Counter(), 1: Counter()}
    for w, f, _ in fit:
        hit = {k for k, x in enumerate(w) if any(f" {x} ".startswith(e) for e in want)}
        pairs[f].update({f"{w[i]} {w[i + 1]}" for k in hit for i in (k - 1, k) if 0 <= i < len(w) - 1})
    assert set(lexicon.exceptions[len(toxicity.EXCEPTIONS) :]) == {p for p, c in pairs[0].items() if c >= toxicity.MIN_CLEAN and not pairs[1][p]}
    odd = [(900, None), (901, ""), (902, "zonk " * 5000), (902, "zonk " * 5000), (903, "id!ot ZÖNK zоnk gr0mp")]
    got = toxicity.score_toxicity(spark.createDataFrame([(*d, "kept") for d in docs + odd], "doc_id long, text string, _m string"), lexicon).collect()
    assert len(got) == len(docs) + len(odd) and {r["_m"] for r in got} == {"kept"}
    b, s, d = lexicon.coefficients
    for r in got:
        total, words = naive_total(r.text or "", lexicon) if len(r.text or "") < 5000 else (5000 * max(w for e, w in want.items() if " zonk ".startswith(e)), 5000)
        x = b + s * np.log1p(total) + d * np.log1p(100 * total / words)
        assert r.score == pytest.approx(1 / (1 + np.exp(-x)), abs=1e-9) and r.predicted == (r.score >= 0.5)


def test_toxicity_of_repeated_ids_is_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    assert sorted(map(tuple, toxicity.fit_rows(docs, labels).collect())) == [("b", 0), ("text 0", 1)]


def test_toxicity_held_out_accuracy(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    got = toxicity.op6_toxicity(spark, big).join(labels, "doc_id").filter("held_out").collect()
    toxic = [r for r in got if r.toxic == 1]
    clean = [r for r in got if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(None, "idiot text", 1), (1, None, 2), (2, "", 3), (2, "", 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(None, None, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(docs, labels)
    got = toxicity.score_toxicity(docs, lexicon).collect()
    assert len(got) == 4 and all(r.predicted == 0 for r in got)
    assert toxicity.score_toxicity(docs.limit(0), lexicon).count() == 0


def brute_links(rows, threshold=0.98):
    v, parent = [], list(range(len(rows)))
    for i, e, label in rows:
        ok = e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e) and label is not None
        v.append(np.array(e, float) / np.abs(e).max() if ok else None)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if v[a] is not None and v[b] is not None and rows[a][2] == rows[b][2] and len(v[a]) == len(v[b]):
                if v[a] @ v[b] / (np.linalg.norm(v[a]) * np.linalg.norm(v[b])) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    parent[root(a)] = root(b)
            if rows[a][0] is not None and rows[a][0] == rows[b][0]:
                parent[root(a)] = root(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root(k)] = min(least.get(root(k), r[0]), r[0])
    return [(r[0], links[k], c := least.get(root(k)), r[0] == c) for k, r in enumerate(rows)]


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    rng = np.random.default_rng(2)
    rows, base = [], rng.normal(size=(6, 8))
    for i in range(150):
        e = base[rng.integers(6)] + rng.normal(size=8) * rng.choice([0.02, 0.15, 0.6])
        rows.append((i, [float(x) for x in e], int(rng.integers(3))))
    rows += [(200, None, 1), (201, [0.0] * 8, 1), (202, [1.0, None] + [0.0] * 6, 1), (203, [float("nan")] * 8, 1), (204, [float("inf")] * 8, 1), (205, rows[0][1], None), (206, [], 1)]
    rows += [(220, [1e-200, 2e-200], 1), (221, [1e200, 2e200], 1), (222, [5e-324, 0.0], 1), (223, [3.0], 1), (224, [1e-9], 1), (225, [-1.0], 1), (226, [0.0, 5e-324], 1)]
    rows += [(300 + k, rows[7][1], rows[7][2]) for k in range(20)]  # copies of one vector
    rows += [(None, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (210, [1.0, 2.0], 1), (211, [2.0, 4.0], 1), (212, [-1.0, -2.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, kept string")
    for least in (10_000, 8):  # without and with fitted axes
        monkeypatch.setattr(embedding_dedup, "MIN_FIT", least)
        got = embedding_dedup.embedding_duplicates(df).collect()
        assert sorted(map(tuple, got), key=str) == sorted(brute_links(rows), key=str)
    assert embedding_dedup.embedding_duplicates(df.limit(0)).count() == 0


def test_long_vectors_over_several_partitions(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 4)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3, 4096)).astype(np.float32)
    rows = [(i, (base[i % 3] + rng.normal(size=4096).astype(np.float32) * (0.05 if i % 5 else 0.4)).astype(np.float32).tolist(), i % 2) for i in range(40)]
    rows += [(100 + i, base[i % 3][:4000].tolist(), i % 2) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = embedding_dedup.embedding_duplicates(df).collect()
    assert sorted(map(tuple, got)) == sorted(brute_links(rows)) and sum(r.n_links for r in got) > 100


def test_boilerplate_lines_are_removed(spark):
    from monthmill.llm import line_frequency as lf

    foot = "Share this page 12 times"
    texts = {i: f"own words of text {'abcdefghijkl'[i]} here\n{foot.replace('12', str(i))}\n\n  {foot}\nand an end {'abcdefghijkl'[i]}" for i in range(12)}
    texts |= {20: None, 21: "", 22: foot, 23: "no such line\n\n", 24: texts[3]}
    df = spark.createDataFrame([(i, "a", t) for i, t in texts.items()] + [(30, "b", foot)], "doc_id long, source string, text string")
    got = {r.doc_id: (r.clean_text, r.removed_words) for r in lf.line_frequency(df).collect()}
    want = {i: (f"own words of text {'abcdefghijkl'[i]} here\n\nand an end {'abcdefghijkl'[i]}", 10) for i in range(12)}
    assert got == want | {20: (None, 0), 21: ("", 0), 22: ("", 5), 23: ("no such line\n\n", 0), 24: want[3], 30: (foot, 0)}


def test_indents_and_carriage_returns_are_one_line(spark):
    texts = ["\tfoo bar", "foo bar\r", "foo bar", " foo \t bar ", "FOO  bar\x0b"]
    docs = spark.createDataFrame([(i, "h", f"{x}\nown line {chr(97 + i) * 3} of this text with more words than the rest") for i, x in enumerate(texts)], "doc_id long, source string, text string")
    got = {r.doc_id: r.clean_text for r in line_frequency.line_frequency(docs, min_docs=5, host_share=0.02).collect()}
    assert all("foo" not in x.lower() and "own line" in x for x in got.values()), got


def test_many_matches_and_exceptions_take_no_longer():
    import time

    lexicon = toxicity.Lexicon(weights={" bad ": 1.0}, exceptions=["bad hair day"], coefficients=[0.0, 1.0, 1.0])
    text = "bad hair day bad " * 60_000
    began = time.perf_counter()
    total, _ = toxicity.match(text, lexicon.automaton())
    assert total == 60_000 and time.perf_counter() - began < 5


@pytest.mark.parametrize("most", [url_filter.MAX_ENTRIES, 1])
def test_other_verdicts_are_no_entries(spark, most):
    entries = spark.createDataFrame([("org", "/", "deny", True), ("org", "/a", "BLOCK", False), ("net", "/", "block", True), ("com", "/", "allow", True)], "host string, path string, verdict string, is_rule boolean")
    pages = spark.createDataFrame([("http://x.org/a",), ("http://x.net/a",), ("http://x.com/",)], "url string")
    assert [tuple(r) for r in url_filter.judge(pages, entries, max_entries=most).select("url", "rule", "verdict").orderBy("url").collect()] == [
        ("http://x.com/", "com/", "allow"), ("http://x.net/a", "net/", "block"), ("http://x.org/a", None, "allow"),
    ]
