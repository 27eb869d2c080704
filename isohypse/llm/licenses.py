"""License scans (1), in DataFrame functions only.

Texts are cut into words; a shingle is WORDS of them in a row. Windows of SPAN words begin at every
STEP-th word, so whatever stands in SPAN - STEP + 1 words in a row lies whole in some window. A window's
signature has BANDS least values of its shingles' hashes, each hashed again with the band's number, a band each. Two
windows of Jaccard similarity s meet in some band with probability 1 - (1 - s)^BANDS: 0.99996 for a notice of five
words, the shortest here, in a window (3 / 7), 0.999996 for an altered one (4 of 5 shingles, 1 / 2). Windows that agree
on a band are candidates, and a window matches if it has CONTAINED of the template window's shingles, by exact count.
Windows without any shingle of a template can't agree on a band; they are left out before.

A template of at most SPAN - STEP + 1 words is one window; a longer one has a window at each word. Windows
only say where to look: a match needs CONTAINED of the whole template's distinct shingles, by exact count, in
one passage of the document, which is 1 / CONTAINED times as long as the template, SPAN words at least. Licenses
differ in a word or two, so all shingles of a template's name (what braces enclose in it) have to be in that passage: another
version, and a variant that isn't in the list, match nothing. Notices that licenses share have a label of their own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

WORDS, SPAN, STEP, BANDS, CONTAINED = 3, 9, 3, 18, 0.8

# Fixed notices of public licenses, as commonly written. What braces enclose names the license.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the {Apache License, Version 2.0}.",
        'Licensed under the {Apache License, Version 2.0} (the "License"); you may not use this file except in compliance with the License.',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "MIT": [
        "Released under the {MIT License}.",
        "Licensed under the {MIT License}.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY',
    ],
    "GPL-3.0": [
        "This work is licensed under the {GNU General Public License, version 3}.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU General Public License as published by the Free Software Foundation, either version 3 of the License}",
    ],
    # the same in all versions
    "GPL": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "CC-BY-NC-4.0": [
        "Licensed under {CC BY-NC 4.0}.",
        "This work is licensed under a {Creative Commons Attribution-NonCommercial 4.0 International} License.",
    ],
    "CC-BY-4.0": ["Licensed under {CC BY 4.0}.", "This work is licensed under a {Creative Commons Attribution 4.0 International} License."],
    "CC-BY-SA-4.0": ["Licensed under {CC BY-SA 4.0}.", "This work is licensed under a {Creative Commons Attribution-ShareAlike 4.0 International} License."],
    "BSD-3-Clause": ["Licensed under the {BSD 3-Clause License}."],
    # the same for two and three clauses
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2.0}."],
}


#: Lower-cased words of letters, digits and dots between digits.
_SPLIT = r"filter(split(regexp_replace(lower(text), r'[^\p{L}\p{N}.]+|\.(?!\p{N})|(?<!\p{N})\.', ' '), ' '), z -> z <> '')"


def _let(value: str, name: str, body: str) -> str:
    """`body` with `name` bound to `value`, which is computed once; a column of another projection might be computed at each use."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _shingles(words: str) -> str:
    """Hashes of the shingles at all places of the array `words`; the whole of a shorter one."""
    each = ", ".join(f"{words}[i + {k}]" for k in range(WORDS))
    return f"case when size({words}) >= {WORDS} then transform(sequence(0, size({words}) - {WORDS}), i -> xxhash64({each})) when size({words}) > 0 then array(xxhash64(array_join({words}, ' '))) else cast(array() as array<bigint>) end"


_BANDS = f"transform(sequence(0, {BANDS - 1}), b -> array_min(transform(ws, x -> xxhash64(b, x))))"


def names(text: str) -> list[str]:
    """What braces enclose in a template; with the words before it where it has fewer than a shingle."""
    out = []
    for m in re.finditer(r"\{([^}]*)\}", text):
        short = WORDS - len(re.findall(r"[\w.]+", m[1]))
        out.append(" ".join([*(text[: m.start()].split()[-short:] if short > 0 else []), m[1]]))
    return out


def templates(spark, table: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """license, template, n_words, ts (the template's distinct shingles), must (its names'), window, ws (the window's), bands."""
    rows = [(name, i, text, names(text)) for name, texts in table.items() for i, text in enumerate(texts)]
    t = spark.createDataFrame(rows, "license string, template int, text string, names array<string>").withColumn("w", F.expr(_SPLIT))
    of_name = _let(_SPLIT.replace("lower(text)", "lower(called)"), "u", _shingles("u"))
    t = t.withColumn("must", F.expr(f"array_distinct(flatten(transform(names, called -> {of_name})))"))
    t = t.withColumn("n_words", F.size("w")).withColumn("ts", F.expr(f"array_distinct({_let('w', 'u', _shingles('u'))})"))
    whole = SPAN - STEP + 1
    t = t.withColumn("p", F.explode(F.expr(f"sequence(0, greatest(0, case when size(w) <= {whole} then 0 else size(w) - {whole} end))"))).withColumn("v", F.expr(f"slice(w, p + 1, {whole})"))
    t = t.withColumn("ws", F.expr(f"array_distinct({_let('v', 'u', _shingles('u'))})"))
    return t.select("license", "template", "n_words", "ts", "must", F.col("p").alias("window"), "ws", F.expr(_BANDS).alias("bands"))


def scan(docs: DataFrame, table: dict[str, list[str]] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license, template, n_windows, first_word, containment: a row for each document and template that matches.

    containment is the share of the whole template's shingles that the best passage with the template's name has. n_windows counts
    the document's windows that match in passages with CONTAINED of them, first_word is the first such
    window's place in words. Null, empty and wordless texts match nothing; rows that repeat a doc_id count
    together, and a null doc_id comes back null. Other columns are ignored; no documents give no rows. The
    templates are a fixed list, so their table is broadcast.
    """
    spark = docs.sparkSession
    index = materialize(templates(spark, table), "templates")
    shingles = sorted({v for r in index.select("ts").distinct().collect() for v in r["ts"]})  # fixed by the list above
    count = SPAN - WORDS + 1
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    # a window with some template's shingle goes on; the join then asks for the same band
    known = ", ".join(f"{v}L" if v > -(2**63) else "-9223372036854775808L" for v in shingles)
    cut = f"transform(sequence(0, greatest(0, size(s) - {count} + {STEP} - 1), {STEP}), p -> struct(p, slice(s, p + 1, {count}) as ws))"
    hits = f"case when exists(s, x -> x in ({known})) then filter({cut}, c -> exists(c.ws, x -> x in ({known}))) end"
    found = docs.select("doc_id", F.expr(_let(_SPLIT, "w", _let(_shingles("w"), "s", f"struct(s, {hits} as hits)"))).alias("x"))
    found = found.select("doc_id", "x.s", "x.hits").where("size(hits) > 0")
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()), "license-hits")
    banded = found.select("row", F.explode("hits").alias("x")).select("row", "x.p", "x.ws").select("row", "p", "ws", F.posexplode(F.expr(_BANDS)).alias("b", "v"))
    of = index.select("license", "template", F.col("ws").alias("ts"), F.posexplode("bands").alias("b", "v"))
    pairs = banded.join(F.broadcast(of), ["b", "v"])
    exact = pairs.where(F.size(F.array_intersect("ts", "ws")) >= CONTAINED * F.size("ts"))
    seen = exact.groupBy("row", "license", "template").agg(F.collect_set("p").alias("ps"))
    # the whole template, in the documents that have windows of it
    whole = index.where("window = 0").select("license", "template", "n_words", "ts", "must").withColumn("span", F.expr(f"greatest({SPAN}, cast(ceil(n_words / {CONTAINED}D) as int))"))
    full = seen.join(found.select("row", "doc_id", "s"), "row").join(F.broadcast(whole), ["license", "template"])
    part = _let(f"slice(s, a + 1, greatest(1, span - {WORDS - 1}))", "part", "struct(a, size(array_intersect(ts, part)) / size(ts) as c, size(array_except(must, part)) = 0 as named)")
    full = full.withColumn("at", F.expr(f"transform(filter(sequence(0, size(s) - 1), a -> array_contains(ts, s[a])), a -> {part})"))
    full = full.withColumn("good", F.expr(f"filter(at, x -> x.c >= {CONTAINED}D and x.named)")).where("size(good) > 0")
    # windows that a good passage touches, a multiple of STEP each
    touched = f"array_distinct(flatten(transform(good, x -> sequence(greatest(0, x.a - {SPAN - STEP}) div {STEP} * {STEP}, (x.a + span - 1) div {STEP} * {STEP}, {STEP}))))"
    full = full.select("doc_id", "license", "template", F.expr(f"array_intersect(ps, transform({touched}, x -> cast(x as int)))").alias("ps"), F.expr("array_max(good.c)").alias("c"))
    return full.groupBy("doc_id", "license", "template").agg(F.sum(F.size("ps")).cast("long").alias("n_windows"), F.min(F.array_min("ps")).alias("first_word"), F.max("c").alias("containment"))
