"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Header lines (those with a cue such as "license" or "copyright"), alone and with the lines
next to them, are taken from the whole text; files that are licence files by name, or whose
text consists of such lines or holds the phrases of a licence, are also compared as a whole, with
full licence texts (``license_texts``).  An SPDX tag is taken as it says.  Each distinct segment is scored once: its terms are
weighted by the templates' inverse document frequencies and joined to the
templates' terms, both of fixed size.  A file without a licence of its own inherits that of the
nearest directory above it that holds a licence file.  All of it is DataFrame
expressions and joins.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, let, n_words, stage, table

GNU = (
    ("GPL", "", "2.0", "June 1991"),
    ("GPL", "", "3.0", "29 June 2007"),
    ("LGPL", "Lesser ", "2.1", "February 1999"),
    ("LGPL", "Lesser ", "3.0", "29 June 2007"),
    ("AGPL", "Affero ", "3.0", "19 November 2007"),
)
GNU_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License "
    "as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
#: Licence statements (fixed values).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
    # Standard headers and headings, which run over several lines.
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    *((f"{short}-{v}", f"GNU {long}General Public License Version {v.removesuffix('.0')}, {date}") for short, long, v, date in GNU),
    *((f"{short}-{v}", GNU_NOTICE.format(long, v.removesuffix(".0"))) for short, long, v, _ in GNU),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
)
CUE = (
    r"(?i)licen[sc]e|copyright|all rights reserved|public domain|permission is hereby|redistribution and use|spdx"
    r"|free software|general public|mozilla public|source code form|creative commons"
)
#: A header is a line with a cue and up to so many lines after it, up to the next one without a term.
HEADER_LINES = 6
#: What a text must hold to be compared with whole licences, if its name doesn't tell.
WHOLE_CUE = r"(?i)permission is hereby granted|redistribution and use in source|terms and conditions|mozilla public license|unencumbered software|cc0 1\.0 universal"
SPDX = r"(?i)^\W*SPDX-License-Identifier:\s*([A-Za-z0-9.+()][A-Za-z0-9.+() -]*?)\s*(?:[*#%-]+[/>)]?)?\s*$"
FILE_NAME = r"(?i)^(?:licen[sc]e|copying|unlicense|notice)(?:[.-][^/]*)?$"
TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
THRESHOLD = 0.8
#: Long legal texts share most of their common words.
WHOLE_THRESHOLD = 0.9


#: Holders and years, which are left out of whole comparisons.
COPYRIGHT_LINE = r"(?im)^.*\bcopyright (?:\(c\)|©|[0-9]{4}).*$"


def _whole_templates() -> tuple[tuple[str, str], ...]:
    texts = {f.name.removesuffix(".txt"): re.sub(COPYRIGHT_LINE, "", f.read_text()) for f in (resources.files(__package__) / "license_texts").iterdir() if f.name.endswith(".txt")}
    # The AGPL is the GPL but for its name and section 13.
    texts["AGPL-3.0"] = re.sub(r"(?i)GNU (General Public)", r"GNU Affero \1", texts["GPL-3.0"])
    return tuple((name.partition("_")[0], text) for name, text in sorted(texts.items()))


WHOLE_TEMPLATES = _whole_templates()


def _idf(templates=TEMPLATES) -> tuple[dict[str, float], float]:
    df = Counter(t for _, text in templates for t in set(re.findall(TERM, text.lower())))
    n = len(templates)
    return {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items()}, math.log(1 + n) + 1


IDF, UNSEEN_IDF = _idf()
WHOLE_IDF, WHOLE_UNSEEN_IDF = _idf(WHOLE_TEMPLATES)


def template_weights(templates=TEMPLATES, idf=IDF) -> list[tuple[int, str, str, float]]:
    """(template, license, term, weight) with weights of length 1 a template."""
    rows = []
    for i, (name, text) in enumerate(templates):
        tf = Counter(re.findall(TERM, text.lower()))
        norm = math.sqrt(sum((c * idf[t]) ** 2 for t, c in tf.items()))
        rows += [(i, name, t, c * idf[t] / norm) for t, c in tf.items()]
    return rows


def score_segments(segments: DataFrame, whole: bool = False) -> DataFrame:
    """(sid, seg) distinct texts -> (sid, license, cosine) of the best template at its threshold or more.

    whole: the templates are whole licences, and lines that name a copyright holder are left out.
    Terms carry the segment's number, not its text.
    """
    spark = segments.sparkSession
    templates, idf_of, unseen, threshold = (WHOLE_TEMPLATES, WHOLE_IDF, WHOLE_UNSEEN_IDF, WHOLE_THRESHOLD) if whole else (TEMPLATES, IDF, UNSEEN_IDF, THRESHOLD)
    weights = F.broadcast(spark.createDataFrame(template_weights(templates, idf_of), "template int, license string, term string, weight double"))
    idf = F.broadcast(spark.createDataFrame(sorted(idf_of.items()), "term string, idf double"))
    compared = F.regexp_replace("seg", COPYRIGHT_LINE, "") if whole else F.col("seg")
    # Very long segments explode into their terms, so counts are combined before the exchange.
    terms = (
        segments.select("sid", F.explode(F.regexp_extract_all(F.lower(compared), F.lit(TERM), F.lit(0))).alias("term"))
        .groupBy("sid", "term").agg(F.count(F.lit(1)).alias("tf"))
        .join(idf, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    )
    norms = terms.groupBy("sid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = terms.join(weights, "term").groupBy("sid", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, "sid").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).filter(F.col("cosine") >= threshold)
    best = F.max_by(F.struct("license", "cosine"), F.struct("cosine", -F.col("template")))
    return scored.groupBy("sid").agg(best.alias("b")).select("sid", "b.license", "b.cosine")


def declared(segments: DataFrame) -> DataFrame:
    """(sid, seg) lines with an SPDX tag -> (sid, license, cosine 1): the known name, whatever its -only, -or-later or case, else as it stands."""
    names = {name.lower(): name for name, _ in TEMPLATES + WHOLE_TEMPLATES}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    tag = F.regexp_extract("seg", SPDX, 1)
    plain = F.regexp_replace(F.lower(tag), r"(?:-only|-or-later|\+)$", "")
    return segments.filter(F.col("seg").rlike(SPDX)).select("sid", F.coalesce(known[plain], tag).alias("license"), F.lit(1.0).alias("cosine"))


def header_blocks(text: Column) -> Column:
    """Each line with a cue joined with the next ones, 2 to HEADER_LINES lines, without crossing a line that has no term."""

    def of_lines(x: Column) -> Column:
        def at(line: Column, i: Column) -> Column:
            near = F.slice(x, i + 1, F.lit(HEADER_LINES))
            gap = F.array_position(F.transform(near, lambda y: y.rlike("[A-Za-z0-9]")), F.lit(False))
            full = F.when(gap > 0, gap.cast("int") - 1).otherwise(F.size(near))
            blocks = F.transform(F.sequence(F.lit(2), F.greatest(full, F.lit(2))), lambda k: F.array_join(F.slice(near, F.lit(1), k), "\n"))
            return F.when(line.rlike(CUE) & (full >= 2), blocks).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.transform(x, at))

    return F.when(text.rlike(CUE), let(F.split(text, "\n", -1), of_lines)).otherwise(F.array().cast("array<string>"))


def ancestors(directory: Column) -> Column:
    """The directory and those above it, nearest first, with the root ""."""
    parts = F.split(directory, "/", -1)
    n = F.size(parts)
    up = F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.concat(up, F.array(F.lit(""))))


def scan_licenses(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``files`` with own_license, cosine, license and inherited_from.

    own_license: of the best header line (or whole licence file), ties by the order of
    the templates.  A licence file is one named so (LICENSE, COPYING, ...) that names a licence, or one whose
    whole text is a licence.  license: the own one, else that of the nearest directory above with
    a licence file; where a directory has several, the most frequent, then the first by
    name.  A text of any length is cut into segments and compared whole too.  A null or wordless text has no licence of its own and may inherit; a null
    path inherits nothing.  Repeated rows get equal results and columns named like a
    result column are replaced.  An empty table gives an empty result.
    """
    # Helper columns get names that no caller has; the given ones are renamed back at the end.
    given = {c: fresh(f"c{k}") for k, c in enumerate(files.columns)}
    files, path, text = files.select(*[F.col(c).alias(n) for c, n in given.items()]), given[path], given[text]
    cols = [n for c, n in given.items() if c not in ("own_license", "cosine", "license", "inherited_from")]
    t, p = F.coalesce(F.col(text), F.lit("")), F.col(path)
    base = F.regexp_extract(p, "([^/]*)$", 1)
    lines = F.when(t.rlike(CUE), F.transform(F.filter(F.split(t, "\n", -1), lambda x: x.rlike(CUE)), lambda x: F.trim(x))).otherwise(F.array().cast("array<string>"))
    by_name = F.coalesce(base.rlike(FILE_NAME), F.lit(False))
    header_words = F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + n_words(x))
    whole = by_name | ((F.size(lines) > 0) & (2 * header_words >= n_words(t))) | t.rlike(WHOLE_CUE)
    keyed = files.select(*cols, F.coalesce(F.regexp_extract(p, "^(.*)/[^/]*$", 1), F.lit("")).alias("_dir"), p.isNotNull().alias("_has_path"), lines.alias("_lines"), whole.alias("_whole"), by_name.alias("_named"))
    keyed = keyed.withColumn("_segs", F.array_distinct(F.concat("_lines", header_blocks(F.coalesce(F.col(text), F.lit(""))), F.when(F.col("_whole"), F.array(t)).otherwise(F.array().cast("array<string>")))))
    # Files with a candidate segment are few; each gets a key of its own content and path.
    key = F.sha2(F.concat_ws("\0", F.coalesce(p, F.lit("\1")), F.array_join("_segs", "\0")), 256)
    keyed = keyed.withColumn("_key", F.when(F.size("_segs") > 0, key)).withColumn("_text", F.when(F.col("_whole"), t))
    some = keyed.filter("_key IS NOT NULL").select("_key", "_dir", "_has_path", "_named", "_segs", "_text").dropDuplicates(["_key"])
    each = F.explode(F.transform("_segs", lambda x: F.struct(F.md5(x.cast("binary")).alias("sid"), x.alias("seg"), F.coalesce(x == F.col("_text"), F.lit(False)).alias("entire"))))
    segs = stage(some.select("_key", "_dir", "_has_path", "_named", each.alias("s")).select("_key", "_dir", "_has_path", "_named", "s.*"), "segments")
    distinct = segs.select("sid", "seg").dropDuplicates(["sid"])
    parts = score_segments(distinct).unionByName(declared(distinct)).groupBy("sid").agg(F.max(F.struct("cosine", "license")).alias("b"))
    texts = score_segments(segs.filter("entire").select("sid", "seg").dropDuplicates(["sid"]), whole=True).withColumn("full", F.lit(True))
    scored = stage(texts.unionByName(parts.select("sid", "b.license", "b.cosine", F.lit(False).alias("full"))), "scored")
    found = segs.drop("seg").join(scored, "sid").filter("NOT full OR entire")
    # A whole licence says more than the headers in it.
    best = F.max_by(F.struct("license", "cosine"), F.struct(F.col("full"), F.col("cosine"), F.col("license")))
    own = found.groupBy("_key").agg(best.alias("b")).select("_key", F.col("b.license").alias("own_license"), "b.cosine")
    holders = found.filter("_has_path AND (_named OR entire)").groupBy("_key", "_dir").agg(best.alias("b")).groupBy("_dir", F.col("b.license").alias("license")).agg(F.count(F.lit(1)).alias("n"))
    holders = holders.groupBy("_dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "license")).alias("b")).select(F.col("_dir").alias("above"), F.col("b.license").alias("dir_license"))
    # Directories, not files, look for the nearest one above.
    above = (
        keyed.filter("_has_path").select("_dir").distinct()
        .select("_dir", F.posexplode(ancestors(F.col("_dir"))).alias("depth", "above"))
        .join(holders, "above").groupBy("_dir").agg(F.min(F.struct("depth", "above", "dir_license")).alias("b"))
        .select("_dir", F.col("b.above").alias("above"), "b.dir_license")
    )
    # Files without a segment are most; numbers of their own keep them from meeting in one task.
    spread = F.coalesce("_key", F.concat(F.lit("-"), F.pmod(F.monotonically_increasing_id(), F.lit(8192))))
    out = keyed.select(*cols, "_dir", "_has_path", spread.alias("_key")).join(own, "_key", "left").join(above, "_dir", "left")
    inherits = F.col("own_license").isNull() & F.col("_has_path")
    return out.select(
        *[F.col(n).alias(c) for c, n in given.items() if n in cols], "own_license", "cosine",
        F.coalesce("own_license", F.when(F.col("_has_path"), F.col("dir_license"))).alias("license"),
        F.when(inherits, F.col("above")).alias("inherited_from"),
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source/lang/doc_id div 100/doc_id, those with an SPDX tag or a line that speaks of a licence as LICENSE.doc_id."""
    docs = table(spark, sf_dir, "documents")
    named = F.when(F.coalesce("text", F.lit("")).rlike(r"(?i)\blicen[sc]ed? under\b|spdx-license|\blicense\."), F.lit("LICENSE.")).otherwise(F.lit(""))
    place = F.concat_ws("/", "source", "lang", F.expr("doc_id div 100").cast("string"), F.concat(named, F.col("doc_id").cast("string")))
    return scan_licenses(docs.select("doc_id", place.alias("path"), "text")).select("doc_id", "path", "own_license", "cosine", "license", "inherited_from")


QUERIES = {"op9_licenses": op9_licenses}
ORACLES = {}
