"""URL filter: a sorted array of 64-bit digests, memory-mapped by every executor.

A list entry is a host and a path prefix with a verdict.  It fits its host and all
subdomains where the url's path starts with the entry's; the longest fitting entry
wins.  The entries' xxhash64 keys are one sorted array in a file that Spark ships
to the executors once.  A url's possible entries are its host's suffixes joined
with those prefixes of its path that have the length of some entry's path; their
digests are probed by one vectorised binary search a batch, and a hit counts only
if the stored string equals the probed one.

A list above ``max_entries`` isn't shipped: it is joined by digest and string,
which no single machine has to hold.  Both ways give the same results.  Of entries with
the same host, path and kind (rule or listed), block wins.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from functools import cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_hexdigest, xxh64_intdigest

from .common import fresh, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Entries (host, path, verdict, is a rule).  The rules are given; the others are the method's own list.
RULES = (
    ("org", "/", "allow", True),
    ("example.org", "/es/", "block", True),
    ("example.org", "/en/1", "block", True),
    ("com", "/fr/", "allow", True),
    ("com", "/de/", "block", True),
)
#: Hosts of advertising and tracking services, which serve no texts (fixed values).
LISTED_HOSTS = """
doubleclick.net googlesyndication.com googleadservices.com google-analytics.com googletagmanager.com googletagservices.com adservice.google.com
adnxs.com taboola.com outbrain.com criteo.com criteo.net rubiconproject.com pubmatic.com openx.net casalemedia.com
advertising.com adsrvr.org amazon-adsystem.com bidswitch.net smartadserver.com adform.net moatads.com serving-sys.com
scorecardresearch.com quantserve.com hotjar.com mixpanel.com segment.io chartbeat.com newrelic.com optimizely.com
zedo.com revcontent.com mgid.com propellerads.com popads.net adcash.com exoclick.com juicyads.com
trafficjunky.net adroll.com mathtag.com bluekai.com krxd.net demdex.net everesttech.net omtrdc.net
yieldmo.com sharethrough.com triplelift.com spotxchange.com teads.tv contextweb.com lijit.com sovrn.com
media.net undertone.com tribalfusion.com adtechus.com flashtalking.com ads-track.example.com
""".split()
LISTED = tuple((h, "/", "block", False) for h in LISTED_HOSTS)
DEFAULT_VERDICT = "allow"
#: A list up to this many entries is collected and shipped as a file.
MAX_ENTRIES = 500_000

_open: dict[str, tuple] = {}


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    """What follows the first ://, else null."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def key_of(host: str, path: str) -> str:
    """NUL keeps host and path apart: ("a.b", "c") and ("a.bc", "") differ."""
    return f"{host}\0{path}"


def build_index(entries: list[tuple], folder: str) -> str:
    """Write the digest file, named by its content: counts, sorted digests, offsets of the strings, flags, path lengths, strings.

    Flags: 1 a rule, 2 it blocks, 4 a listed entry, 8 it blocks.
    """
    flags: dict[str, int] = {}
    for host, path, verdict, is_rule in entries:
        if host is not None and verdict is not None and is_rule is not None:
            k = key_of(host.translate(str.maketrans(UPPER, LOWER)), path or "")
            flags[k] = flags.get(k, 0) | (1 if is_rule else 4) | ((2 if is_rule else 8) if verdict == "block" else 0)
    keyed = sorted((xxh64_intdigest(k), k.encode(errors="surrogatepass"), f, len(k.partition("\0")[2])) for k, f in flags.items())
    strings = [k for _, k, _, _ in keyed]
    lengths = sorted({n for *_, n in keyed})
    parts = [
        np.array([len(keyed), len(lengths)], "<i8"),
        np.array([d for d, *_ in keyed], "<u8"),
        np.cumsum([0, *map(len, strings)]).astype("<i8"),
        np.array(lengths, "<i8"),
        np.array([f for _, _, f, _ in keyed], "<u1"),
    ]
    content = b"".join(p.tobytes() for p in parts) + b"".join(strings)
    path = os.path.join(folder, f"url-digests-{xxh3_128_hexdigest(content)}.bin")
    with open(path, "wb") as f:
        f.write(content)
    return path


def open_index(path: str) -> tuple:
    """Memory-mapped (digests, offsets, path lengths, flags, strings)."""
    if path not in _open:
        n, m = np.fromfile(path, "<i8", 2)
        at = 16
        got = []
        for kind, count in (("<u8", n), ("<i8", n + 1), ("<i8", m), ("<u1", n)):
            got.append(np.memmap(path, kind, "r", at, (int(count),)) if count else np.empty(0, kind))
            at += int(count) * np.dtype(kind).itemsize
        size = os.path.getsize(path) - at
        got.append(np.memmap(path, "<u1", "r", at, (size,)) if size else np.empty(0, "<u1"))
        _open[path] = tuple(got)
    return _open[path]


def candidates(host: str, path: str, lengths) -> list[str]:
    suffixes = [host] + [host[i + 1 :] for i, c in enumerate(host) if c == "."]
    prefixes = [path[:n] for n in lengths if n <= len(path)]
    return [key_of(s, p) for s in suffixes for p in prefixes]


def probe(hosts, paths, index: tuple) -> list[tuple]:
    """For each (host, path): the longest fitting rule and its verdict, and the longest listed entry's verdict, each or None."""
    digests, offsets, lengths, flags, strings = index
    tried = [candidates(h, p, lengths.tolist()) for h, p in zip(hosts, paths)]
    flat = [k for ks in tried for k in ks]
    keys = np.fromiter((xxh64_intdigest(k) for k in flat), "<u8", len(flat))
    first = np.searchsorted(digests, keys, "left")
    last = np.searchsorted(digests, keys, "right")
    best: list[list] = [[None, None] for _ in tried]
    row_of = np.repeat(np.arange(len(tried)), [len(ks) for ks in tried])
    for i in np.flatnonzero(last > first):
        k = flat[i].encode(errors="surrogatepass")
        for j in range(first[i], last[i]):  # equal digests of different strings stand side by side
            if bytes(strings[offsets[j] : offsets[j + 1]]) == k:
                host, path = flat[i].split("\0", 1)
                for kind, there, blocks in ((0, 1, 2), (1, 4, 8)):
                    new = (len(host) + len(path), len(host), host + path, "block" if flags[j] & blocks else "allow")
                    held = best[row_of[i]][kind]
                    if flags[j] & there and (held is None or new[:2] > held[:2]):
                        best[row_of[i]][kind] = new
    return [(r and r[2], r and r[3], m and m[3]) for r, m in best]


def judge(pages: DataFrame, entries: DataFrame, url: str = "url", max_entries: int = MAX_ENTRIES) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``entries``: host, path, verdict (allow or block), is_rule.  A fitting rule wins
    over the method's own entries; without either the verdict is ``allow``.  Among
    fitting entries the longest wins, then the one with the longer host; of repeated ones block
    wins.  An entry whose host or kind is null, or whose verdict isn't allow or block, is none; a null path fits every path.  A url that
    is null or has no ``://`` has empty host and path and fits nothing.  Repeated pages get
    equal results, an empty table an empty one.  Columns
    of ``pages`` named like a result column are replaced.  No shuffle of ``pages`` unless the list is long.
    """
    spark = pages.sparkSession
    parsed = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    entries = entries.select("host", "path", "verdict", "is_rule").filter(F.col("verdict").isin("allow", "block"))
    rows = entries.limit(max_entries + 1).collect()
    if len(rows) > max_entries:
        return _judge_by_join(parsed, entries)
    name = os.path.basename(local := build_index([tuple(r) for r in rows], _index_folder()))
    if (sent := (spark.sparkContext.applicationId, name)) not in _sent:
        spark.sparkContext.addFile(local)
        _sent.add(sent)

    @F.pandas_udf("rule string, rule_verdict string, listed string")
    def look_up(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        found = probe(host.tolist(), path.tolist(), open_index(SparkFiles.get(name)))
        return pd.DataFrame(found, columns=["rule", "rule_verdict", "listed"], dtype=object)

    return _decided(parsed, look_up("host", "path"))


_sent: set[tuple[str, str]] = set()


@cache
def _index_folder() -> str:
    """Where the driver keeps index files for executors to fetch; equal lists share a file, and the folder goes with the driver."""
    folder = tempfile.mkdtemp(prefix="url-index-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _decided(pages: DataFrame, found: Column) -> DataFrame:
    own = fresh("found")
    verdict = F.coalesce(f"{own}.rule_verdict", f"{own}.listed", F.lit(DEFAULT_VERDICT))
    return pages.withColumn(own, found).withColumns({"rule": F.col(f"{own}.rule"), "verdict": verdict}).drop(own)


def _judge_by_join(parsed: DataFrame, entries: DataFrame) -> DataFrame:
    """The same for a list too long to ship: distinct (host, path) are joined to it by digest and string.

    A url's host suffixes meet the path lengths that the list has for them, so nothing of the list goes through the driver.
    """
    listed = entries.filter("host IS NOT NULL AND verdict IS NOT NULL AND is_rule IS NOT NULL").select(F.translate("host", UPPER, LOWER).alias("s"), F.coalesce("path", F.lit("")).alias("prefix"), "verdict", "is_rule")
    # Block sorts behind allow.
    listed = listed.groupBy("s", "prefix", "is_rule").agg(F.max("verdict").alias("verdict"))
    lengths = listed.select("s", F.length("prefix").alias("n")).distinct()
    keyed = listed.withColumn("key", F.concat_ws("\0", "s", "prefix")).withColumn("digest", F.xxhash64("key"))
    pairs = parsed.select("host", "path").distinct()
    parts = F.split("host", "\\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    tried = (
        pairs.withColumn("s", F.explode(suffixes)).join(lengths, "s").filter("n <= length(path)")
        .select("host", "path", F.concat_ws("\0", "s", F.substring("path", F.lit(1), F.col("n"))).alias("key")).withColumn("digest", F.xxhash64("key"))
    )
    entry, size = F.concat("s", "prefix"), F.struct(F.length(F.concat("s", "prefix")), F.length("s"))
    best = lambda c, rule: F.max_by(c, F.when(F.col("is_rule") == rule, size))
    found = (
        tried.join(keyed, ["digest", "key"]).groupBy("host", "path")
        .agg(best(entry, True).alias("rule"), best(F.col("verdict"), True).alias("rule_verdict"), best(F.col("verdict"), False).alias("listed"))
        .select(F.col("host").alias(h := fresh("host")), F.col("path").alias(p := fresh("path")), F.struct("rule", "rule_verdict", "listed").alias(f := fresh("entry")))
    )
    joined = parsed.join(found, (F.col("host") == F.col(h)) & (F.col("path") == F.col(p)), "left")
    return _decided(joined, F.col(f)).drop(h, p, f)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame(RULES + LISTED, "host string, path string, verdict string, is_rule boolean")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), entries).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    lists = {True: RULES, False: LISTED}
    fit = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = lambda rule: sorted(lists[rule], key=lambda e: -len(e[0] + e[1]))
    case = lambda rule, what: "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{what(h, p, v)}'" for h, p, v, _ in longest(rule)) + " END"
    return f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
s AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r)
SELECT page_id, host, path, {case(True, lambda h, p, v: h + p)} AS rule,
       coalesce({case(True, lambda h, p, v: v)}, {case(False, lambda h, p, v: v)}, '{DEFAULT_VERDICT}') AS verdict FROM s"""


QUERIES = {"op1_url_filter": op1_url_filter}
ORACLES = {"op1_url_filter": _sql()}
