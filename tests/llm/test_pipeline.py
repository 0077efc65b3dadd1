"""Each stage against brute force on its own input: real documents, near copies, and rows with nulls, empty and very long texts, repeats."""

import math
import re
from collections import Counter

import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F
from test_near_dedup import brute as near_groups
from test_pii import RE, ok
from test_rules import brute_targets, naive_total

from monthmill.llm import mixing, pieces, pii, toxicity
from monthmill.llm.common import stage

LONG = " ".join(f"long{i % 700}x{i // 700}" for i in range(20_000))
ODD = [
    (None, None, None, None, None), (None, "a text without an id but with words", "en", "s", 5), (9_000_001, None, "en", None, None), (9_000_002, "", None, "s", 0), (9_000_003, LONG, "en", "s", len(LONG)),
    (9_000_004, LONG + " and an end", "en", None, None), (9_000_005, "write to x.y@example.org or +49 (30) 1234 5678", "de", "s", 7), (9_000_006, "the same row twice, five words and more", "en", "s", 1),
    (9_000_006, "the same row twice, five words and more", "en", "s", 1), (9_000_007, " \n ", "en", "s", 3),
]


def base_redacted(text):
    """``text`` with the base kinds' spans replaced; overlapping ones become one, named after the first."""
    spans = sorted((m.start(), -m.end(), k) for k, r in RE.items() for m in re.finditer(r, text) if ok(k, m[0]))
    out, at = "", 0
    for a, b, k in spans:
        if a >= at:
            out += text[at:a] + f"<{k.upper()}>"
        at = max(at, -b)
    return out + text[at:]


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    odd = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    docs = stage(docs.unionByName(odd.select(*[F.col(c).cast(docs.schema[c].dataType) for c in columns])), "documents")
    given, schema = {}, docs.schema
    for name, function in corpus_pipeline.STAGES:
        given[name] = docs.collect()
        docs = stage(function(spark, docs, sf_dir), name)
        assert name == "pieces" or docs.columns == columns
        if name == "toxicity":
            lexicon = toxicity.learn(spark.createDataFrame(given[name], schema), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    b, s, d = lexicon.coefficients
    clean = []
    for r in given["toxicity"]:
        text = r.text or ""
        total, words = (0.0, 1) if len(text) > 50_000 else naive_total(text, lexicon)
        if b + s * math.log1p(total) + d * math.log1p(100 * total / words) < 0:
            clean.append(r)
    assert Counter(clean) == Counter(given["near_dedup"])

    groups = near_groups([(r.doc_id, r.text) for r in given["near_dedup"] if r.doc_id is not None], width=5)
    kept = {i for i, (_, root) in groups.items() if i == root}
    assert Counter(r.doc_id for r in given["pii"]) == Counter([*kept, *[None for r in given["near_dedup"] if r.doc_id is None]])
    assert set(given["pii"]) <= set(given["near_dedup"]) and len(kept) < len(groups)

    before = {r.doc_id: r for r in given["pii"] if r.doc_id is not None}
    extra = {r.doc_id: r.spans for r in pii.op10_pii_of(spark.createDataFrame(given["pii"], schema)).collect()}
    assert len(given["mixing"]) == len(given["pii"])
    for r in given["mixing"]:
        old = before.get(r.doc_id)
        if old is not None:
            assert (r.source, r.lang) == (old.source, old.lang)
            if old.text is None or not re.search("iban|ssn|secret", extra[r.doc_id]):
                assert r.text == (None if old.text is None else base_redacted(old.text))
            assert r.n_chars == (old.n_chars if r.text is None else len(r.text))

    size = lambda t: len((t or "").encode().split())
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in given["mixing"]:
        sizes[r.source] += size(r.text)
        longest[r.source] = max(longest[r.source], size(r.text))
    for r in given["pieces"]:
        taken[r.source] += size(r.text)
    for source, target in brute_targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= longest[source], source
    assert set(given["pieces"]) <= set(given["mixing"]) and max(Counter(given["pieces"]).values()) <= mixing.MAX_COPIES

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = Counter((r.doc_id, tuple(sp.encode(r.text or ""))) for r in given["pieces"])
    got = docs.collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want and all(r.parity for r in got)


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
        assert docs.count() == 0, name
