"""License scans: MinHash over overlapping windows retrieves templates, shingle containment verifies.

Words are runs of a-z and 0-9 of the lower-cased text; shingles are five words.  Templates fall into
length classes; for each class, texts are cut into windows of twice its length that start at every
half of it.  A template matches a window that holds at least 80 % of its shingles.  Such a window has a
least Jaccard similarity J to the template that follows from both numbers of shingles (a short template
fills little of its window), and its class takes so many one-row bands that (1 - J) ** bands <= MISS.

The band values of all templates are an index: a window goes on only if one of its own is in that set (a hash
lookup for each band), and only then is it held against the templates that share the band.
All is one projection over column expressions: no join and no shuffle.  Templates are literals; more than
BLOCK of them are looked for block by block.  Only windows around a cue word are looked at: cues are
chosen so that less than 80 % of a template's shingles lack one, so a match can't miss them.

Cases: null and empty texts match nothing; words shorter than a template match nothing; a template of less
than five words has no shingle and matches nothing; texts of any
length are scanned whole; repeated rows get a row each; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

SHINGLE, PERCENT, MISS, BLOCK = 5, 80, 1e-7, 500

#: Public license notices (fixed values).
TEMPLATES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-2-clause": "Licensed under the BSD 2-Clause License.",
    "bsd-3-clause": "Licensed under the BSD 3-Clause License.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-nd-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc-by-nc-nd-4.0-short": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nc-sa-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-sa-4.0-short": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nd-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nd-4.0-short": "Licensed under CC BY-ND 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-sa-4.0-short": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0-short": "Licensed under CC0 1.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "mit-short": "Licensed under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def length_class(n_words: int) -> int:
    """The least power of two that is not below the number of words."""
    return max(8, 1 << (n_words - 1).bit_length())


def bands_for(words: list[str]) -> int:
    """So many bands that a matching window of this template's class is missed with probability MISS at most."""
    n = len({tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)})
    need = -(-PERCENT * n // 100)
    least = need / (2 * length_class(len(words)) - SHINGLE + 1 + n - need) if n else 1
    return 1 if least >= 1 else math.ceil(math.log(MISS) / math.log(1 - least))


def cue_words(templates: dict[str, str], percent: int = PERCENT) -> list[str]:
    """Words of which every matching window holds one."""
    cues: set[str] = set()
    for text in templates.values():
        w = words_of(text)
        sh = {tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}
        need = max(1, -(-percent * len(sh) // 100))
        while len(bare := [s for s in sh if not cues & set(s)]) >= need:
            tally: dict[str, int] = {}
            for s in bare:
                for x in set(s):
                    tally[x] = tally.get(x, 0) + 1
            # long words are rare in running text
            cues.add(max(tally, key=lambda x: (min(len(x), 7), tally[x], x)))
    return sorted(cues)


def _hashes(words: str) -> Column:
    """Distinct shingle hashes of an array of words."""
    parts = ", ".join(f"{words}[i + {k}]" for k in range(SHINGLE))
    return F.expr(f"if(size({words}) < {SHINGLE}, cast(array() as array<bigint>), array_distinct(transform(sequence(0, size({words}) - {SHINGLE}), i -> xxhash64({parts}))))")


def _signature(hashes: str, bands: str) -> str:
    return f"transform(sequence(1, {bands}), b -> array_min(transform({hashes}, h -> xxhash64(h, b))))"


def _template_rows(spark: SparkSession, templates: dict[str, str]) -> list:
    """Name, class, bands of the class, shingle hashes and signature of each template; at most BLOCK rows."""
    words = {n: words_of(t) for n, t in sorted(templates.items())}
    bands: dict[int, int] = {}
    for w in words.values():
        c = length_class(len(w))
        bands[c] = max(bands.get(c, 1), bands_for(w))
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c := length_class(len(w))).alias("cls"), F.lit(bands[c]).alias("bands"), F.array(*map(F.lit, w)).alias("w")) for n, w in words.items()])
    df = spark.range(1).select(F.explode(rows).alias("t")).select("t.*").withColumn("sh", _hashes("w")).withColumn("sig", F.expr(_signature("sh", "bands")))
    return df.select("name", "cls", "bands", "sh", "sig").collect()


def _found(df: DataFrame, known: list, cues: list[str], name: str) -> DataFrame:
    """Adds ``name``, the names of the templates ``known`` found in the text ``_t``."""
    longs = lambda x: ", ".join(f"{v}L" if v != -(2**63) else "cast('-9223372036854775808' as bigint)" for v in x)
    structs = "array(" + ", ".join(f"named_struct('name', '{r.name}', 'cls', {r.cls}, 'sh', array({longs(r.sh)}), 'sig', array({longs(r.sig)}))" for r in known) + ")"
    index = longs(sorted({v for r in known for v in r.sig}))
    in_cues = ", ".join(f"'{c}'" for c in cues)
    df = df.withColumn("_w", F.expr(f"if(_t rlike '{'|'.join(cues)}', filter(split(_t, '[^a-z0-9]+'), x -> x <> ''), null)"))
    df = df.withColumn("_p", F.expr(f"filter(transform(_w, (x, i) -> if(x in ({in_cues}), i, -1)), i -> i >= 0)"))
    windows = []
    for c, bands in sorted({(r.cls, r.bands) for r in known}):
        width, step = 2 * c, c // 2
        first = f"greatest(0, cast(ceil((p - {width - 1}) / {step}) as int)) * {step}"
        windows.append(f"transform(array_distinct(flatten(transform(_p, p -> sequence({first}, cast(p div {step} as int) * {step}, {step})))), s -> named_struct('cls', {c}, 'bands', {bands}, 'w', slice(_w, s + 1, {width})))")
    df = df.withColumn("_win", F.expr(f"if(size(_p) > 0, concat({', '.join(windows)}), null)")).drop("_w", "_p")
    parts = ", ".join(f"x.w[i + {k}]" for k in range(SHINGLE))
    df = df.withColumn("_win", F.expr(f"transform(filter(_win, x -> size(x.w) >= {SHINGLE}), x -> named_struct('cls', x.cls, 'bands', x.bands, 'sh', array_distinct(transform(sequence(0, size(x.w) - {SHINGLE}), i -> xxhash64({parts})))))"))
    df = df.withColumn("_win", F.expr(f"transform(_win, x -> named_struct('cls', x.cls, 'sh', x.sh, 'sig', {_signature('x.sh', 'x.bands')}))"))
    df = df.withColumn("_win", F.expr(f"filter(_win, x -> exists(x.sig, s -> s in ({index})))"))
    retrieved = "t.cls = x.cls and exists(zip_with(x.sig, t.sig, (a, b) -> a = b), e -> e)"
    verified = f"100 * size(array_intersect(x.sh, t.sh)) >= {PERCENT} * size(t.sh)"
    return df.withColumn(name, F.expr(f"array_distinct(flatten(transform(_win, x -> transform(filter({structs}, t -> {retrieved} and {verified}), t -> t.name))))")).drop("_win")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row: id and the sorted names of the templates found in the text."""
    templates = {n: t for n, t in sorted((TEMPLATES if templates is None else templates).items()) if len(words_of(t)) >= SHINGLE}
    none = F.expr("cast(array() as array<string>)")
    df = docs.select(F.col(id_col).alias("_id"), F.lower(text_or_empty(text_col)).alias("_t"))
    names = list(templates)
    found = []
    for k in range(0, len(names), block):
        part = {n: templates[n] for n in names[k : k + block]}
        found.append(f"_f{k}")
        df = _found(df, _template_rows(docs.sparkSession, part), cue_words(part), found[-1])
    every = F.array_sort(F.concat(*[F.coalesce(F.col(f), none) for f in found])) if found else none
    return df.select(F.col("_id").alias(id_col), every.alias("licenses"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))


def brute_force(text: str | None, templates: dict[str, str] | None = None) -> list[str]:
    """All windows against all templates, for tests."""
    w, out = words_of(text or ""), []
    for name, t in (TEMPLATES if templates is None else templates).items():
        tw = words_of(t)
        want = {tuple(tw[i : i + SHINGLE]) for i in range(len(tw) - SHINGLE + 1)}
        if not want:
            continue
        c = length_class(len(tw))
        for s in range(0, len(w), c // 2):
            win = w[s : s + 2 * c]
            have = {tuple(win[i : i + SHINGLE]) for i in range(len(win) - SHINGLE + 1)}
            if 100 * len(have & want) >= PERCENT * len(want):
                out.append(name)
                break
    return sorted(out)
