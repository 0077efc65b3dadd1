import math
import re
from collections import Counter
from pathlib import Path

from monthmill.llm import licenses as li


def cosine(text):
    tf = Counter(re.findall(li.TERM, text.lower()))
    norm = math.sqrt(sum((c * li.IDF.get(t, li.UNSEEN_IDF)) ** 2 for t, c in tf.items())) or 1
    best = (0.0, 1, "")
    rows = li.template_weights()
    for i, (name, _) in enumerate(li.TEMPLATES):
        c = round(sum(w * tf[t] * li.IDF[t] for k, _, t, w in rows if k == i) / norm, 9)
        best = max(best, (c, -i, name))
    return best


def brute(files):
    own, holders = {}, {}
    for p, t in files:
        t = t or ""
        lines = [x.strip(" ") for x in t.split("\n") if re.search(li.CUE, x)]
        words = lambda x: len(x.encode().split())
        name = (p or "").rpartition("/")[2]
        whole = bool(re.search(li.FILE_NAME, name)) or (lines and 2 * sum(map(words, lines)) >= words(t))
        got = [cosine(x) for x in lines + [t] * bool(whole)]
        got = [(c, n) for c, _, n in got if c >= li.THRESHOLD]
        own[p, t] = max(got, default=(None, None))[::-1]
        named = bool(re.search(li.FILE_NAME, name))
        if whole and p is not None and (named and own[p, t][0] or cosine(t)[0] >= li.THRESHOLD):
            holders.setdefault(p.rpartition("/")[0], Counter())[own[p, t][0] if named else cosine(t)[2]] += 1
    out = []
    for p, t in files:
        name, c = own[p, t or ""]
        from_dir = None
        if name is None and p is not None:
            d = p.rpartition("/")[0]
            while True:
                if d in holders:
                    from_dir = d
                    name = min(holders[d].items(), key=lambda x: (-x[1], x[0]))[0]
                    break
                if d == "":
                    break
                d = d.rpartition("/")[0]
        out.append((p, own[p, t or ""][0], c, name, from_dir))
    return out


FILES = [
    ("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code\nno words"), ("a/b/c/y.py", "# Licensed under the Apache License, Version 2.0.\nprint()"),
    ("a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/d/z.py", None), ("a/b/q.py", ""), ("e/f.py", "plain"),
    ("e/license.md", "nothing of the kind"), (None, "All rights reserved."), (None, "free text"), ("top.py", "x"), ("a/b/x.py", "code\nno words"),
    ("g/1", "Licensed under CC BY-NC 4.0."), ("g/2", "Licensed under CC BY 4.0."), ("g/3", "text"), ("é/ü", "copyright " * 3000),
]


def rows(df):
    return sorted(((r.path, r.own_license, r.cosine, r.license, r.inherited_from) for r in df.collect()), key=str)


def test_columns_of_the_caller_are_kept(spark):
    df = spark.createDataFrame([("a/LICENSE", "MIT License", 1, 2, "k"), ("a/b/x", "code", 3, 4, "l")], "path string, text string, _dir int, _key int, license string")
    got = {r.path: r for r in li.scan_licenses(df).collect()}
    assert got["a/LICENSE"]["_dir"] == 1 and got["a/b/x"]["_key"] == 4 and got["a/b/x"].license == "MIT" and got["a/b/x"].inherited_from == "a"


def test_equals_brute_force(spark, sf_dir):
    df = spark.createDataFrame([(p, t, 1) for p, t in FILES], "path string, text string, license int")
    assert rows(li.scan_licenses(df)) == sorted(brute(FILES), key=str)
    big = sf_dir.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet").collect()
    named = lambda t: "LICENSE." * bool(re.search(r"(?i)\blicen[sc]ed? under\b|spdx-license|\blicense\.", t or ""))
    files = [(f"{r.source}/{r.lang}/{r.doc_id // 100}/{named(r.text)}{r.doc_id}", r.text) for r in docs]
    got = rows(li.op9_licenses(spark, big))
    assert got == sorted(brute(files), key=str) and sum(r[4] is not None for r in got) > 0
    assert li.scan_licenses(df.limit(0)).count() == 0


def full(name, holder="Copyright (c) 2021 Jane Roe"):
    return holder + "\n\n" + (Path(li.__file__).parent / "license_texts" / f"{name}.txt").read_text()


def test_full_licences_and_headers(spark):
    notice = li.GNU_NOTICE.format("", "3").split()
    wrapped = "\n".join("# " + " ".join(notice[i : i + 12]) for i in range(0, len(notice), 12))
    apache = '/*\n * Licensed under the Apache License, Version 2.0 (the "License");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n */'
    want = {
        ("m/LICENSE", "MIT License\n\n" + full("MIT")): "MIT", ("m/src/x.py", "code"): "MIT",
        ("a/LICENSE.txt", full("Apache-2.0")): "Apache-2.0", ("a/x.py", "code"): "Apache-2.0",
        ("g/COPYING", full("GPL-3.0")): "GPL-3.0", ("g/x.py", "code"): "GPL-3.0",
        ("h/COPYING", full("GPL-2.0")): "GPL-2.0", ("h/x.py", "code"): "GPL-2.0",
        ("b/LICENSE", full("BSD-3-Clause")): "BSD-3-Clause", ("b/x.py", "code"): "BSD-3-Clause",
        ("c/legal", full("MIT")): "MIT", ("c/x.py", "code"): "MIT",
        ("l/COPYING.LESSER", full("LGPL-3.0")): "LGPL-3.0", ("l/x.py", "code"): "LGPL-3.0",
        ("q/LICENSE", "a licence of our own, ask for permission before use"): None, ("q/x.py", "code"): None,
        ("s/1", "# SPDX-License-Identifier: MIT\ncode"): "MIT", ("s/2", "/* SPDX-License-Identifier: GPL-2.0-or-later */"): "GPL-2.0",
        ("s/3", "// SPDX-License-Identifier: MIT OR Apache-2.0"): "MIT OR Apache-2.0",
        ("t/1", apache + "\ncode"): "Apache-2.0", ("t/2", wrapped + "\n\ncode"): "GPL-3.0",
        ("t/3", "code\n     GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\ncode"): "GPL-3.0",
    }
    df = spark.createDataFrame(list(want), "path string, text string")
    got = {r.path: (r.license, r.inherited_from) for r in li.scan_licenses(df).collect()}
    assert got == {p: (name, p.split("/")[0] if t == "code" and name else None) for (p, t), name in want.items()}
