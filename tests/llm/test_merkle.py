"""Merkle manifests against a plain recursive version."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from monthmill.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    return sha(*[field(v) for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def climb(nodes):
    """(root, per leaf its (left, right) per level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            start = a // 16 * 16
            paths[i].append(("".join(nodes[start:a]), "".join(nodes[a + 1 : start + 16])))
        at = [a // 16 for a in at]
        nodes = [sha(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute(docs):
    first = lambda v: (v is not None, v)  # noqa: E731  null before everything
    sources = {}
    for d in docs:
        sources.setdefault(d["source"], []).append(d)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in order:
        sources[s].sort(key=lambda d: (*map(first, [d["doc_id"]]), leaf(d, d["text"])))
        made[s] = climb([leaf(d, d["text"]) for d in sources[s]])
    root, tops = climb([made[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for d, own in zip(sources[s], made[s][1]):
            path = own + top
            text = d["text"]
            if d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(d, text)
            for left, right in path:
                node = sha(left, node, right)
            out.append((d["doc_id"], leaf(d, d["text"]), made[s][0], root, sha(*[x + y for x, y in path]), node, node == root))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _no string, g int"


def judged(spark, tmp_path, docs):
    spark.createDataFrame([tuple(d.get(c) for c in ("doc_id", "text", "lang", "source", "n_chars")) + ("x", 1) for d in docs], SCHEMA).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = merkle.op11_merkle(spark, str(tmp_path)).collect()
    return sorted(map(tuple, got), key=str)


def doc(i, source, text="Some Text", lang="en", n=3):
    return {"doc_id": i, "source": source, "text": text, "lang": lang, "n_chars": n}


def test_equals_brute_force(spark, tmp_path):
    docs = [doc(i, "hot", f"Text Number {i} " + "É" * (i % 3)) for i in range(4353)]  # four levels, the last runs hold one node
    docs += [doc(i, None, None if i % 2 else "") for i in range(17)] + [doc(-3, ""), doc(10**12, "zé"), doc(5, "Z", "A" * 300_000)]
    docs += [doc(7, "one"), doc(7, "one"), doc(7, "one", "other"), doc(None, "one", None, None, None), doc(None, None)]
    docs += [doc(i, f"s{i % 300}") for i in range(600)]  # more sources than a subtree holds
    assert judged(spark, tmp_path, docs) == sorted(brute(docs), key=str)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_sizes_at_the_edges_of_levels(spark, tmp_path, n):
    docs = [doc(i, "s", f"T{i}") for i in range(n)]
    assert judged(spark, tmp_path, docs) == sorted(brute(docs), key=str)


def test_empty_table(spark, tmp_path):
    assert judged(spark, tmp_path, []) == []


def test_only_every_second_level_is_stored(spark):
    leaves = spark.range(5000).select(F.lit("s").alias("source"), F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    made = merkle.build_manifest(leaves, "source", "doc_id")
    assert [level.agg(F.sum(F.size("nodes"))).first()[0] for level in made.levels] == [5000, 20]
    found = merkle.proofs(made).withColumn("top", merkle.fold(F.col("leaf"), F.col("path")))
    assert found.filter(F.col("top") != made.root.first()[0]).count() == 0 and found.count() == 5000
    wrong = found.withColumn("top", merkle.fold(F.reverse("leaf"), F.col("path")))
    assert wrong.filter(F.col("top") == made.root.first()[0]).count() == 0
