"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: compatibility forms, look-alike letters of other scripts,
digits and signs that stand for letters, lower case; all that isn't a letter becomes
one space.  The lexicon is learned from labelled rows: whole words and beginnings
of words, each weighted by the log odds of the toxic rows that hold it.  Rows of a
group of copies repeat their words in the same surroundings, so an entry's support
is the number of toxic texts or of different words before it, whichever is less.

A text's matches outside exception phrases add up their weights; the sum and the
sum by length go into a logistic score fitted on the same rows.  Exception phrases are
learned too: a lexicon word with the word before or behind it, where that pair stands in
several clean rows and in no toxic one.  A few fixed ones stand beside them.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

#: Look-alikes of Latin letters in Cyrillic and Greek (fixed values).
HOMOGLYPHS = dict(zip("асеорхуіјѕԁһԛԝкмнтвгαεικνορτυχωβ", "aceopxyijsdhqwkmhtbraeiknoptuxwb"))
#: Digits and signs that stand for letters (fixed values); the last ones only between letters, as they end sentences too.
SUBSTITUTES = dict(zip("0134578@$€", "oieastbase"))
BETWEEN_LETTERS = dict(zip("!|+", "iit"))
_BETWEEN = re.compile(r"(?<=[^\W\d_])[!|+](?=[^\W\d_])")
#: Harmless phrases that hold a word of the lexicon (fixed values).
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clownfish", "white trash bag", "pond scum", "oxymoron")
#: Labelled rows that the lexicon and the score are learned from: those with the smallest hashes.
FIT_ROWS = 20_000
PREFIXES = (4, 5, 6, 7)
MIN_SUPPORT = 4
MIN_WEIGHT = 3.0
#: Clean rows that make a pair of words an exception.
MIN_CLEAN = 4
FOLDS, HELD_OUT = 5, 0


class _Fold(dict):
    """A translation table filled as characters turn up."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        c = SUBSTITUTES.get(c, c)
        c = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower() if c not in "äöüß" else c
        c = "".join(HOMOGLYPHS.get(x, SUBSTITUTES.get(x, x)) for x in c)
        self[code] = out = c if c.isalpha() else " "
        return out


_fold = _Fold()


def fold(text: str) -> str:
    """Folded words between single spaces, with a space at either end."""
    if any(c in text for c in BETWEEN_LETTERS):
        text = _BETWEEN.sub(lambda m: BETWEEN_LETTERS[m[0]], text)
    return f" {' '.join(text.translate(_fold).split())} "


def terms(word: str) -> list[str]:
    """Lexicon candidates of a folded word: a leading space marks the start of a word, a trailing one its end."""
    return [f" {word} "] + [f" {word[:n]}" for n in PREFIXES if n < len(word)]


@dataclass
class Lexicon:
    """Weights of folded entries and the score's coefficients (bias, of the sum, of the sum by length)."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, float, float] = (-4.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            a.add_word(entry, (len(entry), w))
        for phrase in self.exceptions:
            entry = fold(phrase)
            if entry not in self.weights:
                a.add_word(entry, (len(entry), None))
        if len(a):
            a.make_automaton()
        return a


def match(text: str, automaton) -> tuple[float, float]:
    """(sum of weights, sum by hundred words); of the matches at one word only the heaviest counts."""
    folded = fold(text)
    if not len(automaton):
        return 0.0, 0.0
    spared, at = [], {}
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        elif weight > at.get(start, 0.0):
            at[start] = weight
    spared.sort()
    begins, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
    # The phrases that begin up to a match cover it if the farthest of them reaches beyond its start.
    total = sum(w for s, w in at.items() if not (k := bisect_right(begins, s)) or reach[k - 1] <= s)
    return total, 100.0 * total / max(1, folded.count(" ") - 1)


def features(total, density) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(density)], axis=1)


def score(total, density, coefficients) -> np.ndarray:
    return 1 / (1 + np.exp(-features(np.asarray(total, float), np.asarray(density, float)) @ np.array(coefficients)))


def fold_of(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def fit_rows(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled rows outside the held-out fold, those of smallest hash."""
    some = (
        labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("_id").isNotNull() & F.col("toxic").isNotNull() & (fold_of(F.col("_id")) != HELD_OUT))
        .groupBy("_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(most)
    )
    # Rows that repeat an id are one: at most ``most`` texts.
    held = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id"))
    return held.groupBy("_id", "toxic").agg(F.coalesce(F.min("text"), F.lit("")).alias("text")).select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Lexicon:
    """A lexicon from labelled rows.  Without a toxic row it is empty and scores everything low.

    A null doc_id or flag is no label; an id with several flags is toxic if one says so; of several
    rows of an id the first text counts.  Empty tables give an empty lexicon.
    """
    rows = fit_rows(docs, labels, most).persist()
    counts = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)

    def in_toxic(batches):
        for b in batches:
            seen = []
            for text in b.column(0).to_pylist():
                before, doc, own = "", zlib.crc32(text.encode()), set()
                for word in fold(text).split():
                    h = zlib.crc32(before.encode())
                    own.update((t, h, doc) for t in terms(word))
                    before = word
                seen += own
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in seen], pa.string())] + [pa.array([x[k] for x in seen], pa.int64()) for k in (1, 2)], ["term", "before", "doc"])

    def in_clean(batches):
        for b in batches:
            n: dict[str, int] = {}
            for text in b.column(0).to_pylist():
                for t in {t for w in set(fold(text).split()) for t in terms(w)}:
                    n[t] = n.get(t, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["term", "n"])

    support = (
        rows.filter("toxic = 1").select("text").mapInArrow(in_toxic, "term string, before long, doc long")
        .groupBy("term").agg(F.countDistinct("before").alias("b"), F.countDistinct("doc").alias("d"))
        .select("term", F.least("b", "d").alias("n_toxic")).filter(F.col("n_toxic") >= MIN_SUPPORT)
    )
    against = rows.filter("toxic = 0").select("text").mapInArrow(in_clean, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_clean"))
    weight = F.log((F.col("n_toxic") + 0.5) / (toxic + 1.0)) - F.log((F.coalesce("n_clean", F.lit(0)) + 0.5) / (clean + 1.0))
    found = (
        support.join(against, "term", "left").withColumn("weight", weight).filter(F.col("weight") >= MIN_WEIGHT)
        .select("term", "weight").orderBy("term").collect()  # terms of at most ``most`` texts
    )
    lexicon = Lexicon({r.term: r.weight for r in found})
    if found:
        lexicon.exceptions = EXCEPTIONS + learned_exceptions(rows, lexicon)
    got = matches(rows, lexicon).select("total", "density", "toxic").toPandas()  # at most ``most`` rows of three numbers
    rows.unpersist()
    if toxic and clean:
        lexicon.coefficients = tuple(fit_logistic(features(got.total.to_numpy(), got.density.to_numpy()), got.toxic.to_numpy()))
    return lexicon


def learned_exceptions(rows: DataFrame, lexicon: Lexicon) -> tuple[str, ...]:
    """Pairs of words around a lexicon word that MIN_CLEAN clean rows hold and no toxic one."""

    def pairs(batches):
        automaton = lexicon.automaton()
        for b in batches:
            seen = []
            for text, flag in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                folded, own = fold(text), set()
                for end, (size, weight) in automaton.iter(folded):
                    if weight is not None:
                        at = end - size + 2  # behind the space that marks the start of the word
                        before, word, behind = folded[:at].rsplit(" ", 2)[-2], *(folded[at:].split(" ", 2) + [""])[:2]
                        own |= {f"{before} {word}"} if before else set()
                        own |= {f"{word} {behind}"} if behind else set()
                seen += [(p, flag) for p in own]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in seen], pa.string()), pa.array([f for _, f in seen], pa.int32())], ["pair", "toxic"])

    found = rows.select("text", "toxic").mapInArrow(pairs, "pair string, toxic int").groupBy("pair").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("bad"))
    return tuple(r.pair for r in found.filter((F.col("clean") >= MIN_CLEAN) & (F.col("bad") == 0)).orderBy("pair").collect())


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton's method with a ridge on all but the bias."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
    return w


def matches(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``docs`` with total and density."""

    def run(parts):
        automaton = lexicon.automaton()
        for column in parts:
            yield pd.DataFrame([match(t, automaton) for t in column.fillna("")], columns=["total", "density"], dtype=float)

    found, own = F.pandas_udf(run, "total double, density double", F.PandasUDFType.SCALAR_ITER), fresh("match")
    return docs.withColumn(own, found(F.col(text))).withColumns({c: F.col(f"{own}.{c}") for c in ("total", "density")}).drop(own)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``.

    Null text is an empty text: no match, a low score.  Only the text is an input of
    the score, so repeated rows get equal ones, whatever their doc_id; an empty table gives an empty
    result.  A text of any length is scored whole, in time that grows with it and its matches.  Columns named like a
    result column are replaced.  No shuffle.
    """
    bias, by_sum, by_density = lexicon.coefficients

    def run(parts):
        automaton = lexicon.automaton()
        for column in parts:
            got = np.array([match(t, automaton) for t in column.fillna("")]).reshape(-1, 2)
            yield pd.Series(score(got[:, 0], got[:, 1], (bias, by_sum, by_density)))

    scored = F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)
    out = docs.withColumn("score", scored(F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, lexicon).select("doc_id", (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", "predicted")


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES = {}
