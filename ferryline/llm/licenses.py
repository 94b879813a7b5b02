"""License scans: passages compared with license templates by their word bigrams.

Passages are the lines and the paragraphs of a text. Letters are lowered, all but letters
and digits is one space, and two sets of word bigrams are compared by the Dice coefficient
``2 |A & B| / (|A| + |B|)``. It reaches a threshold ``t`` only where the sizes are within a
factor of ``(2 - t) / t``, so most passages are never compared with any template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.llm.common import set_aside

# Notices as their licenses ask for them, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this"
        " file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and"
                " related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files (the \"Software\"), to deal in the Software"
        " without restriction, including without limitation the rights to use, copy, modify,"
        " merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
        " permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License,"
                " v. 2.0."),
]

#: Everything that is neither a letter, a digit nor the end of a line.
_OTHER = r"[^\p{L}\p{N}\n]+"


def _bigrams(words: Column) -> Column:
    """The distinct pairs of neighbouring words."""
    # slice() counts from 1; of a list with fewer than two words nothing is left.
    pairs = F.transform(
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda word, i: F.concat(F.get(words, i), F.lit(" "), word),
    )
    return F.array_distinct(pairs)


def _tokens(passage: Column) -> Column:
    blank, empty = F.lit(" "), F.lit("")
    return F.array_remove(F.split(F.replace(passage, F.lit("\n"), blank), " "), empty)


def _templates(templates: list[tuple[str, str]], threshold: float) -> Column:
    made = []
    for place, (name, text) in enumerate(templates):
        words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        pairs = sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})
        low, high = (f(threshold, len(pairs)) for f in (smallest, largest))
        made.append(
            F.struct(
                F.lit(place).alias("place"),
                F.lit(name).alias("license"),
                F.array(*map(F.lit, pairs)).alias("pairs"),
                F.lit(low).alias("low"),
                F.lit(high).alias("high"),
            )
        )
    return F.array(*made)


def smallest(threshold: float, size: int) -> float:
    """Fewest bigrams that can reach the threshold against ``size`` of them."""
    return size * threshold / (2 - threshold)


def largest(threshold: float, size: int) -> float:
    """Most bigrams that can reach the threshold against ``size`` of them."""
    return size * (2 - threshold) / threshold


def scan_licenses(
    documents: DataFrame,
    *,
    templates: list[tuple[str, str]] | None = None,
    threshold: float = 0.8,
    text: str = "text",
) -> DataFrame:
    """Add ``licenses``, an array of structs: every passage that matches a template.

    Each has ``passage`` (normalised), ``license`` and ``dice``, of the template that is most
    alike; of equals the first in the list. A passage counts once however often it is
    repeated in the document. Null and empty texts, and texts without two words in a
    passage, have an empty array. A column named ``licenses`` is replaced.
    """
    templates = TEMPLATES if templates is None else templates
    rows, columns = set_aside(documents.drop("licenses"), (text,))
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), _OTHER, " ")
    sizes = [
        len(set(zip(w, w[1:], strict=False)))
        for w in ("".join(c if c.isalnum() else " " for c in t.lower()).split() for _, t in templates)
    ]
    if not templates:
        raise ValueError("no template to compare with")
    least, most = smallest(threshold, min(sizes)), largest(threshold, max(sizes))

    def compare(pairs: Column) -> Column:
        near = F.filter(
            F.col("_templates"),
            lambda t: (t["low"] <= F.size(pairs)) & (t["high"] >= F.size(pairs)),
        )
        scored = F.transform(
            near,
            lambda t: F.struct(
                (
                    2.0
                    * F.size(F.array_intersect(pairs, t["pairs"]))
                    / (F.size(pairs) + F.size(t["pairs"]))
                ).alias("dice"),
                (-t["place"]).alias("before"),
                t["license"].alias("license"),
            ),
        )
        return F.array_max(F.filter(scored, lambda s: s["dice"] >= threshold))

    passages = F.array_distinct(
        F.concat(F.split("_plain", r"\n"), F.split("_plain", r"\n[ \n]*\n"))
    )
    # Each step is a list of its own: inside a lambda nothing is computed once and shared.
    tokens = F.transform(
        "_passages", lambda p: F.struct(p.alias("passage"), _tokens(p).alias("words"))
    )
    # Words bound the bigrams before any is made: all of them but one from above, and the
    # distinct ones but one from below, since each but the first ends some bigram.
    possible = F.filter(
        tokens,
        lambda p: (F.size(p["words"]) - 1 >= F.lit(least))
        & (F.size(F.array_distinct(p["words"])) - 1 <= F.lit(most)),
    )
    tokens = F.transform(
        possible,
        lambda p: F.struct(p["passage"].alias("passage"), _bigrams(p["words"]).alias("pairs")),
    )
    within = F.filter(
        tokens, lambda p: (F.size(p["pairs"]) >= F.lit(least)) & (F.size(p["pairs"]) <= F.lit(most))
    )
    scored = F.transform(
        within, lambda p: F.struct(p["passage"].alias("passage"), compare(p["pairs"]).alias("best"))
    )
    licenses = F.transform(
        F.filter(scored, lambda p: p["best"].isNotNull()),
        lambda p: F.struct(
            F.trim(p["passage"]).alias("passage"),
            p["best"]["license"].alias("license"),
            p["best"]["dice"].alias("dice"),
        ),
    )
    return (
        rows.withColumn("_plain", plain)
        .withColumn("_passages", passages)
        .withColumn("_templates", _templates(templates, threshold))
        .withColumn("licenses", licenses)
        .select(*columns, "licenses")
    )


def license_report(documents: DataFrame, **options: object) -> DataFrame:
    """One row for each document: how many passages match, and the best of them.

    Of equal matches the passage that sorts first. ``license`` and ``dice`` are null where
    nothing matches; ``dice`` is rounded to six digits.
    """
    found = scan_licenses(documents, **options).select("doc_id", "licenses")
    first = F.array_min(
        F.transform(
            "licenses",
            lambda m: F.struct((-m["dice"]).alias("d"), m["passage"].alias("p"), m["license"].alias("l")),
        )
    )
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_matches"),
        first["l"].alias("license"),
        first["p"].alias("passage"),
        F.round(-first["d"], 6).alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda m: m["license"]))), ",").alias("all_licenses"),
    )


def sql(templates: list[tuple[str, str]] | None = None, threshold: float = 0.8) -> str:
    """The report in DuckDB's SQL, by a join of passages and templates."""
    templates = TEMPLATES if templates is None else templates
    quoted = ", ".join(
        f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')"
        for i, (name, text) in enumerate(templates)
    )
    pairs = (
        "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    )
    words = "[x for x in string_split_regex({0}, '[ \\n]') if x <> '']"
    plain = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    return f"""
    WITH t AS (
      SELECT place, license, {pairs} AS pairs FROM (
        SELECT place, license, {words.format(plain.format("body"))} AS w
        FROM (VALUES {quoted}) v(place, license, body))),
    d AS (SELECT doc_id, {plain.format("coalesce(text, '')")} AS plain FROM documents),
    p AS (
      SELECT DISTINCT doc_id, passage FROM (
        SELECT doc_id, unnest(string_split_regex(plain, '\\n')) AS passage FROM d
        UNION ALL
        SELECT doc_id, unnest(string_split_regex(plain, '\\n[ \\n]*\\n')) FROM d)),
    b AS (SELECT doc_id, passage, {pairs} AS pairs
          FROM (SELECT doc_id, passage, {words.format("passage")} AS w FROM p)),
    m AS (
      SELECT doc_id, trim(passage, ' ') AS passage, license, place,
             2.0::DOUBLE * len(list_intersect(b.pairs, t.pairs)) / (len(b.pairs) + len(t.pairs)) AS dice
      FROM b JOIN t ON len(b.pairs) BETWEEN len(t.pairs) * {threshold} / (2 - {threshold})
                                        AND len(t.pairs) * (2 - {threshold}) / {threshold}),
    best AS (
      SELECT doc_id, passage, first(license ORDER BY dice DESC, place) AS license, max(dice) AS dice
      FROM m WHERE dice >= {threshold} GROUP BY doc_id, passage),
    n AS (
      SELECT doc_id, count(*) AS n_matches,
             first(license ORDER BY dice DESC, passage) AS license,
             first(passage ORDER BY dice DESC, passage) AS passage, round(max(dice), 6) AS dice,
             string_agg(DISTINCT license, ',' ORDER BY license) AS all_licenses
      FROM best GROUP BY doc_id)
    SELECT doc_id, coalesce(n_matches, 0) AS n_matches, license, passage, dice,
           coalesce(all_licenses, '') AS all_licenses
    FROM documents LEFT JOIN n USING (doc_id)"""
