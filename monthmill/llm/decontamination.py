"""Benchmark decontamination by a distributed positional inverted index.

The index is cut by document: each batch of a task is one or more shards, and a shard holds,
for every word of its documents, the places where it stands, as differences in
variable-length bytes.  A query asks for windows of consecutive words of items.  Words
that items hold are counted over the whole index, and each window starts from its rarest
one: only shards that hold that word look at the window.  There the other words'
lists, rarest first and moved by their offsets, are intersected with the places left, which
are few after the second word.  Matches are exact phrases, or, with ``slack``, windows
whose words stand in their order with some others between them.

Words are compared as words, not as hashes.  Places are numbers within a shard, and no
match crosses from one document into the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh, stage, table

WIDTH = 10
#: Bytes of a shard's texts, if not one document has more.
SHARD_BYTES = 12 << 20
#: Windows of a stretch: long items are asked for in pieces that overlap by a window less one word.
STRETCH = 1000
#: Parts that a word's shards are dealt to when they meet the windows that start from it.
SALTS = 16

#: Separators become blanks, A-Z lower case; bytes of characters beyond ASCII stay.
_LETTERS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of words per text, all words in a row); null: none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.int64), pa.array([], pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    raw = np.frombuffer((raw.to_pybytes() if raw else b"")[at[0] : at[-1]].translate(_LETTERS), np.uint8)
    at = at - at[0]
    word = raw != 32
    # A word begins behind a blank or where its text begins, and ends before a blank or where its text ends.
    texts_held = at[:-1] < at[1:]
    firsts, lasts = at[:-1][texts_held], at[1:][texts_held] - 1
    edge = word.copy()
    edge[1:] &= ~word[:-1]
    edge[firsts] = word[firsts]
    begins = np.flatnonzero(edge)
    edge = word.copy()
    edge[:-1] &= ~word[1:]
    edge[lasts] = word[lasts]
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(edge) + 1 - begins)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(raw[word]))
    return np.diff(np.searchsorted(begins, at)), words


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, number of bytes per value): seven bits a byte, lowest first, the high bit on all but the last."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 5):
        size += values >= 1 << (7 * k)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        has = size > k
        out[at[has] + k] = (values[has] >> (7 * k)) & 127 | np.where(size[has] > k + 1, 128, 0)
    return out, size


def unpacked(raw: bytes) -> np.ndarray:
    """The places of a list: running sums of its differences."""
    b = np.frombuffer(raw, np.uint8)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    shift = 7 * (np.arange(len(b)) - np.repeat(first, last - first + 1))
    return np.cumsum(np.add.reduceat((b & 127).astype(np.int64) << shift, first))


def postings(words: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """(distinct words, places of each, their lists) of the words of a shard."""
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy()
    keys = np.sort(codes.astype(np.int64) << 32 | np.arange(len(codes)))
    place, code = keys & 0xFFFFFFFF, keys >> 32
    steps = np.diff(place, prepend=0)
    heads = np.flatnonzero(np.diff(code, prepend=-1))
    steps[heads] = place[heads]
    data, size = packed(steps)
    ends = np.concatenate([[0], np.cumsum(np.add.reduceat(size, heads))]) if len(heads) else np.zeros(1, np.int64)
    lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
    return coded.dictionary, np.diff(heads, append=len(keys)), lists


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index as a table of the shared folder: (shard, no, id, term, n, places).

    A document is a row without term (no: its number in the shard, n: its words), a word of
    a shard a row without no (n: how often it stands there).  Null and empty texts are
    documents without words; other columns aren't used.  A text is never cut, however long: a shard holds one at least.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def index(batches):
        shard = TaskContext.get().partitionId() << 32
        for b in batches:
            before = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
            start = 0
            while start < b.num_rows:
                end = max(start + 1, int(np.searchsorted(before, before[start] + SHARD_BYTES, "right")) - 1)
                counts, words = split_words(b.column(1)[start:end])
                terms, n, lists = postings(words)
                part, size = b.column(0)[start:end], end - start
                none = lambda k, t: pa.nulls(k, t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, shard)), pa.array(np.arange(size, dtype=np.int32)), part, none(size, pa.string()), pa.array(counts), none(size, pa.binary())], names
                )
                for k in range(0, len(terms), 1 << 17):
                    cut = slice(k, k + (1 << 17))
                    held = len(terms[cut])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(held, shard)), none(held, pa.int32()), none(held, part.type), terms[cut].cast(pa.string()), pa.array(n[cut]), lists[cut].cast(pa.binary())], names
                    )
                shard, start = shard + 1, end

    names = ["shard", "no", "id", "term", "n", "places"]
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    return stage(rows.mapInArrow(index, f"shard long, no int, id {kind}, term string, n long, places binary"), "positions")


def item_words(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, words, class): equal word lists are one class; items without words aren't asked for."""
    kind = items.schema[item_id].dataType.simpleString()

    def cut(batches):
        for b in batches:
            counts, words = split_words(b.column(1))
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, words.cast(pa.string()))], ["item_id", "words"])

    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, f"item_id {kind}, words array<string>")
    return rows.filter(F.size("words") > 0).withColumn("class", F.sha2(F.array_join("words", " "), 256))


def _stretches(items: DataFrame, held: DataFrame, width: int) -> DataFrame:
    """(class, base, words, width, anchors): a stretch's windows by the place of their rarest word; windows with a word that no document holds are gone."""
    classes = items.groupBy("class").agg(F.first("words").alias("words")).withColumn("width", F.least(F.lit(width), F.size("words")))
    bases = F.sequence(F.lit(0), F.size("words") - F.col("width"), F.lit(STRETCH))
    cut = classes.withColumn("base", F.explode(bases)).withColumn("words", F.slice("words", F.col("base") + 1, F.col("width") + (STRETCH - 1)))
    places = cut.select("class", "base", F.posexplode("words").alias("i", "term"))
    counted = places.join(held.groupBy("term").agg(F.sum("n").alias("df")), "term", "left")
    counted = counted.groupBy("class", "base").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("df", F.lit(0)).alias("df")))), lambda x: x.df).alias("df"))

    def rarest(s):
        own = F.slice("df", s + 1, F.col("width"))
        return F.struct(F.when(F.array_min(own) > 0, s + F.array_position(own, F.array_min(own)).cast("int") - 1).alias("i"), s.alias("s"))

    starts = F.transform(F.sequence(F.lit(0), F.size("words") - F.col("width")), rarest)
    windows = cut.join(counted, ["class", "base"]).withColumn("w", F.explode(starts)).filter("w.i IS NOT NULL")
    return windows.select("class", "base", "words", "width", "w.i", "w.s").groupBy("class", "base", "i").agg(
        F.first("words").alias("words"), F.first("width").alias("width"), F.array_sort(F.collect_list("s")).alias("starts")
    )


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    return (at < len(ordered)) & (ordered[np.minimum(at, len(ordered) - 1)] == values)


def exact(lists: list[np.ndarray], i: int, starts: np.ndarray, width: int) -> np.ndarray:
    """(place, place behind) of the windows that begin at ``starts`` of a stretch and hold its word ``i``."""
    base = lists[i] - i
    open_ = np.ones((len(base), len(starts)), bool)
    asked = range(int(starts.min()), int(starts.max()) + width)
    for j in sorted((j for j in asked if j != i), key=lambda j: len(lists[j])):
        covers = (starts <= j) & (j < starts + width)
        open_[:, covers] &= among(base + j, lists[j])[:, None]
        some = open_.any(axis=1)
        if not some.all():
            base, open_ = base[some], open_[some]
        if not len(base):
            break
    c, s = np.nonzero(open_)
    first = base[c] + starts[s]
    return np.stack([first, first + width], axis=1)


def near(lists: list[np.ndarray], i: int, starts: np.ndarray, width: int, slack: int) -> np.ndarray:
    """(place, place behind) of windows whose words stand in order with up to ``slack`` other places between them, the shortest round each place of word ``i``."""
    found = [np.empty((0, 2), np.int64)]
    for s in starts.tolist():
        first = last = lists[i]
        for j in range(i + 1, s + width):  # the next place of each later word, then the last one of each earlier word
            at = np.searchsorted(lists[j], last, "right")
            has = at < len(lists[j])
            first, last = first[has], lists[j][at[has]]
            close = last - first <= j - i + slack
            first, last = first[close], last[close]
        for j in range(i - 1, s - 1, -1):
            at = np.searchsorted(lists[j], first, "left") - 1
            has = at >= 0
            first, last = lists[j][at[has]], last[has]
            close = last - first <= s + width - 1 - j + slack
            first, last = first[close], last[close]
        found.append(np.stack([first, last + 1], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def merged(spans: np.ndarray) -> np.ndarray:
    """(group, start, end) rows with overlapping ones of a group made one."""
    spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    heads = np.ones(len(spans), bool)
    heads[1:] = (spans[1:, 0] != spans[:-1, 0]) | (spans[1:, 1] >= spans[:-1, 2])  # equally wide ones end as they begin
    at = np.flatnonzero(heads)
    return np.stack([spans[at, 0], spans[at, 1], np.maximum.reduceat(spans[:, 2], at)], axis=1) if len(at) else spans


_SPANS = pa.struct([("class", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("exact", pa.bool_())])
_OUT = pa.schema([("shard", pa.int64()), ("no", pa.int32()), ("n_hit", pa.int64()), ("spans", pa.list_(_SPANS))])


def _in_shard(slack: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return _OUT.empty_table()
        is_doc = pc.is_null(left["term"])
        sizes = left.filter(is_doc).sort_by("no")["n"].to_numpy()
        ends = np.cumsum(sizes)
        raw = left.filter(pc.invert(is_doc))
        where = dict(zip(raw["term"].to_pylist(), range(raw.num_rows)))
        places, opened = raw["places"], {}

        def list_of(term):
            if term not in opened:
                opened[term] = unpacked(places[where[term]].as_py()) if term in where else np.empty(0, np.int64)
            return opened[term]

        names, found = [], []
        for row in right.select(["class", "i", "words", "width", "starts"]).to_pylist():
            starts, width, i = np.array(row["starts"]), row["width"], row["i"]
            lists = [np.empty(0, np.int64)] * len(row["words"])
            for j in range(int(starts.min()), int(starts.max()) + width):
                lists[j] = list_of(row["words"][j])
            sure = exact(lists, i, starts, width)
            more = [(sure, True)]
            if slack:
                spread = near(lists, i, starts, width, slack)
                more.append((spread[spread[:, 1] - spread[:, 0] > width], False))
            for spans, is_exact in more:
                if len(spans):
                    spans = spans[np.searchsorted(ends, spans[:, 0], "right") == np.searchsorted(ends, spans[:, 1] - 1, "right")]
                    found.append(np.column_stack([np.full(len(spans), len(names)), spans, np.full(len(spans), is_exact)]))
            names.append(row["class"])
        found = np.concatenate(found) if found else np.empty((0, 4), np.int64)
        if not len(found):
            return _OUT.empty_table()
        kinds, which = np.unique(np.array(names), return_inverse=True)
        found[:, 0] = which[found[:, 0]]
        # Overlapping exact windows of a class are one span, unless a document ends between them.
        doc = np.searchsorted(ends, found[:, 1], "right")
        sure = found[:, 3] == 1
        whole = merged(np.column_stack([found[sure, 0] * len(ends) + doc[sure], found[sure, 1:3]]))
        loose = np.unique(found[~sure, :3], axis=0)
        cls = np.concatenate([whole[:, 0] // len(ends), loose[:, 0]])
        first, behind = np.concatenate([whole[:, 1], loose[:, 1]]), np.concatenate([whole[:, 2], loose[:, 2]])
        is_exact = np.arange(len(cls)) < len(whole)
        doc = np.searchsorted(ends, first, "right")
        order = np.lexsort((behind, first, cls, doc))
        cls, first, behind, is_exact, doc = cls[order], first[order], behind[order], is_exact[order], doc[order]
        hit = np.zeros(int(ends[-1]) + 1, np.int64)
        np.add.at(hit, first[is_exact], 1)
        np.add.at(hit, behind[is_exact], -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(hit)[:-1] > 0)])
        docs, heads = np.unique(doc, return_index=True)
        begin = ends[docs] - sizes[docs]
        own = ends[doc] - sizes[doc]
        spans = pa.StructArray.from_arrays([pa.array(kinds[cls], pa.string()), pa.array(first - own), pa.array(behind - own), pa.array(is_exact)], fields=list(_SPANS))
        lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(doc)), pa.int32()), spans)
        shard = left["shard"][0].as_py()
        return pa.Table.from_arrays([pa.array([shard] * len(docs), pa.int64()), pa.array(docs, pa.int32()), pa.array(covered[ends[docs]] - covered[begin]), lists], schema=_OUT)

    return run


def phrase_matches(index: DataFrame, items: DataFrame, width: int = WIDTH, slack: int = 0) -> DataFrame:
    """(shard, no, n_hit, spans) of the documents that hold windows of ``items`` (rows of ``item_words``).

    A span is (class, start, stop, exact) in words of the document, stop exclusive: overlapping
    exact windows of a class are one span; with ``slack``, windows whose words stand in order with 1 to
    ``slack`` other words between them are spans that aren't exact.  n_hit counts words inside exact spans.
    An item of fewer words than ``width`` is one window.
    """
    terms = items.select(F.explode("words").alias("term")).distinct()
    held = stage(index.filter("term IS NOT NULL").join(terms, "term", "left_semi").select("shard", "no", "term", "n", "places"), "asked-positions")
    stretches = stage(_stretches(items, held, width), "stretches")
    salted = stretches.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("term", F.get("words", F.col("i")))
    where = held.select("term", "shard", F.pmod(F.hash("shard"), F.lit(SALTS)).alias("salt"))
    asked = where.join(salted, ["term", "salt"]).select("shard", "class", "i", "words", "width", "starts")
    shards = index.filter("term IS NULL").select("shard", "no", "term", "n", "places").union(held)
    found = shards.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_in_shard(slack), "shard long, no int, n_hit long, spans array<struct<class:string,start:long,stop:long,exact:boolean>>")
    return stage(found, "phrases", drop=[held, stretches])


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, slack: int = 0) -> DataFrame:
    """(doc_id, item_id, start, stop, exact) per document and span; items of the same words have rows of their own.  See ``contamination`` for odd rows."""
    index = build_index(docs, doc_id, text)
    asked = stage(item_words(items, item_id, item_text), "items")
    spans = phrase_matches(index, asked, width, slack).select("shard", "no", F.explode("spans").alias("s")).select("shard", "no", "s.*")
    ids = index.filter("term IS NULL").select("shard", "no", F.col("id").alias("doc_id"))
    out = spans.join(ids, ["shard", "no"]).join(asked.select("class", "item_id").distinct(), "class").select("doc_id", "item_id", "start", "stop", "exact")
    return stage(out, "matches", drop=[index, asked])


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, slack: int = 0) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, item_ids, contaminated, n_near) per row of ``docs``.

    n_hit: words inside an exact window of an item; item_ids: the items of those windows as sorted strings;
    n_near: items found by proximity (0 without ``slack``), which contaminate nothing.
    A null or empty text, or one without words, has none and is clean; so is everything if ``items`` is empty.  Rows that repeat a
    doc_id are documents of their own.  Items that repeat an id are one item with the windows of all its rows; a null
    id counts as one item and is named as an empty string.  Other columns aren't used.
    """
    index = build_index(docs, doc_id, text)
    asked = stage(item_words(items, item_id, item_text), "items")
    found = phrase_matches(index, asked, width, slack)
    named = asked.select("class", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name")).distinct()
    kinds = found.select("shard", "no", F.explode("spans").alias("s")).groupBy("shard", "no", "s.class").agg(F.bool_or("s.exact").alias("exact"), F.bool_or(~F.col("s.exact")).alias("near"))
    ids = kinds.join(named, "class").groupBy("shard", "no").agg(
        F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("name")))).alias("item_ids"), F.count_distinct(F.when(F.col("near"), F.col("name"))).alias("n_near")
    )
    own = fresh("id")
    rows = index.filter("term IS NULL").select("shard", "no", F.col("id").alias(own), F.col("n").alias("n_words"))
    out = rows.join(found.select("shard", "no", "n_hit"), ["shard", "no"], "left").join(ids, ["shard", "no"], "left")
    none = F.array().cast("array<string>")
    out = out.select(
        F.col(own).alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )
    out = stage(out, "contamination", drop=[index, asked])
    discard(found)
    return out


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op12_decontamination": op12_decontamination}
_W = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES = {
    "op12_decontamination": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_W}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_W}, []) AS w FROM benchmark),
asked AS (
  SELECT DISTINCT item_id, least({WIDTH}, len(w)) AS k, array_to_string(w[s:s + least({WIDTH}, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least({WIDTH}, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
held AS (
  SELECT r, s, k, array_to_string(w[s:s + k - 1], ' ') AS phrase
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM asked) WHERE len(w) >= k)),
found AS (SELECT r, s, k, item_id FROM held JOIN asked USING (k, phrase)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT r, s, k FROM found)) GROUP BY 1),
ids AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), '') AS i FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)"""
}
