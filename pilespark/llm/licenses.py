"""Licence notices in documents, by Dice coefficient over word bigrams, with DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public licence notices, as (licence, notice).
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Least Dice coefficient, in millionths.
LEAST_PPM = 800_000

#: Runs of lines, for notices that are wrapped: a run begins with a line that one of these words is in (lower case), or up to
#: BEFORE lines above it, and has 2 to RUN_LINES lines of RUN_CHARS characters at most, nine times the longest template
#: or more, where size bounds prune what has few repeated words.
CUES, BEFORE, RUN_LINES, RUN_CHARS = "licen[cs]e|permission|redistribut|copyright|public domain", 2, 12, 4096


def normal_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip().split(" ")


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


#: (licence, notice number, bigrams) of each template.
TEMPLATES = tuple((name, i, bigrams(normal_words(text))) for i, (name, text) in enumerate(NOTICES))


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit_bigrams(text: Column) -> Column:
    """Distinct word bigrams of a text in lower case, other characters than a-z and 0-9 being gaps."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")
    return let(words, lambda w: F.array_distinct(F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))))


def runs(lines: Column) -> Column:
    """The runs of lines that may hold a wrapped notice, each as one text; a run of all lines is left to the whole text."""
    n = F.size(lines)
    cues = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.lower(F.get(lines, i)).rlike(CUES))
    starts = F.array_distinct(F.flatten(F.transform(cues, lambda i: F.sequence(F.greatest(i - BEFORE, F.lit(0)), i))))
    each = lambda s: F.transform(F.sequence(F.lit(2), F.least(F.lit(RUN_LINES), n - s)), lambda k: F.slice(lines, s + 1, k))
    found = F.flatten(F.transform(F.filter(starts, lambda s: n - s >= 2), each))
    chars = lambda r: F.aggregate(r, F.size(r) - 1, lambda total, x: total + F.length(x))
    return F.transform(F.filter(found, lambda r: (F.size(r) < n) & (chars(r) <= RUN_CHARS)), lambda r: F.array_join(r, "\n"))


def matches(found: Column, least_ppm: int) -> Column:
    """array<struct<template, ppm>> of the templates that a unit's bigrams come near enough.

    The coefficient 2 |A & B| / (|A| + |B|) reaches t only if the smaller side is at least t / (2 - t) of the larger;
    templates out of these bounds are not intersected.
    """
    none = F.array().cast("array<struct<template:int,ppm:bigint>>")

    def held_against(i: int, b: list[str]) -> Column:
        size = F.size(found).cast("long")
        within = (size * (2_000_000 - least_ppm) >= len(b) * least_ppm) & (size * least_ppm <= len(b) * (2_000_000 - least_ppm))
        shared = F.size(F.array_intersect(found, F.array(*map(F.lit, b)))).cast("long")
        one = F.struct(F.lit(i).alias("template"), F.expr("0L").alias("ppm"))
        ppm = lambda n: F.floor(n * 2_000_000 / (size + len(b)))
        return F.when(within, let(ppm(shared), lambda x: F.when(x >= least_ppm, F.array(one.withField("ppm", x))).otherwise(none))).otherwise(none)

    return F.concat(*(held_against(i, b) for _, i, b in TEMPLATES))


def license_scan(docs: DataFrame, least_ppm: int = LEAST_PPM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, template, best_ppm, n_units, n_runs: the licence notices in each whole document.

    Units are the lines of a text and, if it has several, the whole text; for wrapped notices there are runs of lines
    around cue words, too. Their distinct word bigrams are held against each template whose size is within bounds. A unit
    or run counts for the template of its highest coefficient (ties: the first), if that reaches the least. A row is a
    document and a template: the best coefficient in millionths, how many units, and how many runs. A notice within a
    longer line is not found. Null and empty texts match nothing; rows that repeat an id are one document; rows with a
    null id are one document with a null id. Other columns are not read.
    """
    lines = F.split("text", "\n", -1)
    plain = lambda x: F.when(F.size(x) > 1, F.array_append(x, F.array_join(x, "\n"))).otherwise(x)
    marked = lambda x, run: F.transform(x, lambda u: F.struct(u.alias("unit"), F.lit(run).alias("run")))
    units = F.when(F.lower("text").rlike(CUES), let(lines, lambda x: F.concat(marked(plain(x), False), marked(runs(x), True)))).otherwise(let(lines, lambda x: marked(plain(x), False)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    each = rows.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.unit", "u.run")
    best_of = lambda found: F.array_max(F.transform(found, lambda m: F.struct(m["ppm"].alias("ppm"), (-m["template"]).alias("order"))))
    near = each.select("doc_id", "run", let(unit_bigrams(F.col("unit")), lambda b: best_of(matches(b, least_ppm))).alias("m")).where("m is not null")
    best = near.groupBy("doc_id", (-F.col("m.order")).alias("template")).agg(F.max("m.ppm").alias("best_ppm"), F.count_if(~F.col("run")).alias("n_units"), F.count_if("run").alias("n_runs"))
    return best.select("doc_id", F.element_at(F.array(*(F.lit(n) for n, _, _ in TEMPLATES)), F.col("template") + 1).alias("license"), "template", "best_ppm", "n_units", "n_runs")


def oracle() -> str:
    """The same over `documents`, in DuckDB's SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(n)}, {i}, [{', '.join(map(quoted, b))}])" for n, i, b in TEMPLATES)
    return f"""
        with t(license, template, b) as (values {values}),
        lines as (select doc_id, text, string_split(text, chr(10)) as l from documents where text is not null),
        cues as (select doc_id, l, list_filter(range(0, len(l)), lambda i: regexp_matches(lower(l[i + 1]), '{CUES}')) as c from lines where regexp_matches(lower(text), '{CUES}')),
        starts as (select doc_id, l, unnest(list_distinct(flatten(list_transform(c, lambda i: range(greatest(i - {BEFORE}, 0), i + 1))))) as s from cues),
        cut as (select doc_id, l, s, unnest(range(2, least({RUN_LINES}, len(l) - s) + 1)) as k from starts),
        runs as (select doc_id, array_to_string(l[s + 1:s + k], chr(10)) as unit from cut where k < len(l)),
        units as (
            select doc_id, unnest(case when len(l) > 1 then list_append(l, text) else l end) as unit, false as run from lines
            union all select doc_id, unit, true from runs where length(unit) <= {RUN_CHARS}),
        words as (select doc_id, run, row_number() over () as u, string_split(trim(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g')), ' ') as w from units),
        grams as (select doc_id, run, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as a from words),
        met as (
            select doc_id, run, u, license, template, len(list_intersect(a, b)) * 2000000 // (len(a) + len(b)) as ppm
            from grams join t on len(a) * {2_000_000 - LEAST_PPM} >= len(b) * {LEAST_PPM} and len(a) * {LEAST_PPM} <= len(b) * {2_000_000 - LEAST_PPM}),
        best as (select * from met where ppm >= {LEAST_PPM} qualify row_number() over (partition by u order by ppm desc, template) = 1)
        select doc_id, license, cast(template as int) as template, cast(max(ppm) as bigint) as best_ppm, count(*) filter (not run) as n_units, count(*) filter (run) as n_runs
        from best group by doc_id, license, template
    """
