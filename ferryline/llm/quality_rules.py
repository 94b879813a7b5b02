"""Quality rules: counts of a text, and how far its make-up is from that of its language.

Two histograms of a document, of the classes of its characters and of the common words of
its language, are compared with those of all documents of the language by Jensen-Shannon
distance (base 2, so between 0 and 1). A histogram of a short text says little: below a
minimum of characters or words a document is not judged by it, and a language that has too
little text in all is no reference.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.llm.common import SPACE, set_aside, words

# Frequent short words of each language.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem".split(),
    "en": "the of and to in a is that for it as was with be by on".split(),
    "es": "de la que el en y a los del se las por un para con no".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par".split(),
}

#: Classes of characters that are counted one by one; space, and all the rest, come beside them.
CLASSES = {
    "upper": r"\p{Lu}",
    "digit": r"\p{Nd}",
    "symbol": r"#*$%&|<>",
    "stop": r".,;:!?'()\"-",
}

#: Words of a window that counts as repeated; a power of two.
WINDOW = 8


@dataclass(frozen=True)
class Limits:
    """Where the method rejects, and the least it needs to judge.

    ``class_distance`` and ``word_distance`` are the largest distances of a good document.
    """

    class_distance: float = 0.33
    word_distance: float = 0.30
    min_chars: int = 200
    min_words: int = 80
    min_reference_words: int = 1000
    common_words: dict[str, list[str]] = field(default_factory=lambda: COMMON_WORDS)


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _lists(common_words: dict[str, list[str]]) -> Column:
    """The common words of a document's language; null without any."""
    chosen = F.lit(None).cast("array<string>")
    for lang, listed in sorted(common_words.items()):
        chosen = F.when(F.col("lang") == lang, F.array(*map(F.lit, listed))).otherwise(chosen)
    return chosen


def _most_words(limits: Limits) -> int:
    return max((len(listed) for listed in limits.common_words.values()), default=0)


def with_counts(documents: DataFrame, limits: Limits) -> DataFrame:
    """Add ``_words`` and the counts of both histograms, a column for each.

    Classes: ``_upper`` and so on, ``_space``, ``_chars`` of any class. Words: ``_w0`` and so on
    by their place in the language's list, null beyond its end, ``_plain`` for all words.
    """
    every = "".join(CLASSES.values())
    counted = documents.withColumns(
        {
            "_words": words(F.col("text")),
            "_chars": F.length(_text()).cast("long"),
            # One pass over the text leaves the few characters that are told apart below.
            "_marks": F.regexp_replace(_text(), f"[^{every}]++", ""),
            "_list": _lists(limits.common_words),
        }
    )
    # Taking one word out of a list is one pass over it. In a lambda, since the code generated
    # for so many columns is too long to be compiled.
    common = F.transform(
        "_list", lambda w: (F.size("_words") - F.size(F.array_remove("_words", w))).cast("long")
    )
    marks = {
        f"_{name}": F.length(F.regexp_replace("_marks", f"[^{members}]+", "")).cast("long")
        for name, members in CLASSES.items()
    }
    counted = counted.withColumns(
        marks
        | {
            "_space": F.col("_chars") - F.length(F.array_join("_words", "")),
            "_common": common,
            "_plain": F.size("_words").cast("long"),
            "_listed": F.col("_list").isNotNull(),
        }
    )
    counts = {f"_w{k}": F.get("_common", F.lit(k)) for k in range(_most_words(limits))}
    return counted.withColumns(counts).drop("_marks", "_list", "_common")


def _class_columns() -> list[str]:
    return [*[f"_{name}" for name in CLASSES], "_space"]


def _histograms(limits: Limits) -> dict[str, Column]:
    """The columns of :func:`with_counts` as two arrays, all the rest at the end of each."""
    classes = [F.col(c) for c in _class_columns()]
    common = [F.coalesce(f"_w{k}", F.lit(0).cast("long")) for k in range(_most_words(limits))]
    return {
        "_classes": F.array(*classes, F.col("_chars") - sum(classes, F.lit(0))),
        "_commons": F.array(*common, F.col("_plain") - sum(common, F.lit(0))),
    }


def language_references(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Both histograms, summed over all documents of each language with a word list.

    Columns ``lang, class_sums, class_total, word_sums, word_total``: as many rows as languages
    listed in ``limits``, so small whatever the number of documents.
    """
    made = with_counts(documents.select("text", "lang"), limits).where("_listed")
    counts = [
        *_class_columns(), "_chars",
        *[f"_w{k}" for k in range(_most_words(limits))], "_plain",
    ]
    sums = made.groupBy("lang").agg(*[F.sum(c).alias(c) for c in counts])
    made = {"class_sums": "_classes", "word_sums": "_commons"}
    arrays = _histograms(limits)
    return sums.select(
        "lang",
        *[arrays[column].alias(name) for name, column in made.items()],
        F.col("_chars").alias("class_total"),
        F.col("_plain").alias("word_total"),
    )


def jensen_shannon(left: Column, of: Column, right: Column, among: Column) -> Column:
    """Distance of two arrays of counts that sum to ``of`` and ``among``, neither of them 0."""

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    shares = F.zip_with(
        left,
        right,
        lambda a, b: F.struct(
            (a / of).alias("p"), (b / among).alias("q"), ((a / of + b / among) / 2).alias("m")
        ),
    )
    parts = F.transform(shares, lambda s: (part(s["p"], s["m"]) + part(s["q"], s["m"])) / 2)
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def _with_windows(rows: DataFrame) -> DataFrame:
    """Add ``_windows``, a hash of 64 bits for each window of WINDOW words of ``_words``.

    Hashes of words become hashes of two, of four and of eight in a row: each step is
    one look at a neighbour, where hashing windows as such would look at every word eight times.
    """
    rows = rows.withColumn("_windows", F.transform("_words", lambda w: F.xxhash64(w)))
    step = 1
    while step < WINDOW:
        after = F.lit(step)
        joined = F.transform(
            "_windows", lambda h, i: F.xxhash64(h, F.get("_windows", i + after))
        )
        rows, step = rows.withColumn("_windows", joined), step * 2
    count = F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0))
    return rows.withColumn("_windows", F.slice("_windows", F.lit(1), count))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash is not unique. Sorting brings equal ones together."""
    return F.sort_array(
        F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))
    )


def with_base(documents: DataFrame) -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and ``base_failed``.

    Needs the columns of :func:`with_counts`. No text counts as an empty one.
    """
    zero = F.lit(0).cast("long")
    lines = F.filter(
        F.split(_text(), r"\n"), lambda line: line.rlike(f"[^{SPACE}]")
    )
    listed = _with_windows(documents.withColumn("_lines", lines))
    unique = F.size(F.array_distinct("_windows")) == F.size("_windows")
    listed = listed.withColumn("_placed", F.when(~unique, _covered(F.col("_windows"))))
    # Places of windows that have an equal neighbour in sorted order, then in text order.
    at = F.transform(
        F.filter(
            "_placed",
            lambda p, i: (p["h"] == F.get("_placed", i - 1)["h"])
            | (p["h"] == F.get("_placed", i + 1)["h"]),
        ),
        lambda p: p["i"],
    )
    listed = listed.withColumn("_at", F.sort_array(at))
    steps = F.transform(
        "_at",
        lambda p, i: F.least(
            F.lit(WINDOW).cast("long"),
            F.coalesce(F.get("_at", i + 1) - p, F.lit(WINDOW).cast("long")),
        ),
    )
    counted = listed.withColumns(
        {
            "n_words": F.col("_plain"),
            "word_chars": F.col("_chars") - F.col("_space"),
            "n_symbols": F.col("_symbol"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(F.aggregate(steps, zero, lambda a, n: a + n), zero),
        }
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).drop(
        "_words", "_lines", "_windows", "_placed", "_at"
    )


#: What :func:`judge` adds.
VERDICT = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "base_failed", "class_distance", "word_distance", "kept",
]


def judge(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Add the columns of :data:`VERDICT`; all rows stay.

    ``kept`` is false where the base rules fail or a distance is beyond its limit. A distance is
    null, and then nothing is held against the document, where the text is too short, the
    language has no word list, or too little text of the language exists. Null texts are
    empty, null languages unknown. Columns of the same names are replaced. Repeated rows are judged
    alike; an empty table gives no rows.
    """
    documents, columns = set_aside(documents.drop(*VERDICT), ("text", "lang"))
    references = language_references(documents, limits)
    # At most one row for each language that has a word list, which is a parameter.
    counted = with_base(with_counts(documents, limits)).withColumns(_histograms(limits))
    rows = counted.join(
        F.broadcast(references.withColumnRenamed("lang", "_lang")),
        F.col("lang") == F.col("_lang"),
        "left",
    )
    enough = F.col("word_total") >= limits.min_reference_words
    long_enough = (F.col("_chars") >= limits.min_chars) & (F.col("_chars") > 0)
    many_words = (F.col("n_words") >= limits.min_words) & (F.col("_plain") > 0)
    classes = [F.col(c) for c in ("_classes", "_chars", "class_sums", "class_total")]
    common = [F.col(c) for c in ("_commons", "_plain", "word_sums", "word_total")]
    rows = rows.withColumns(
        {
            "class_distance": F.when(enough & long_enough, jensen_shannon(*classes)),
            "word_distance": F.when(enough & many_words, jensen_shannon(*common)),
        }
    )
    far = (F.col("class_distance") > limits.class_distance) | (
        F.col("word_distance") > limits.word_distance
    )
    kept = ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))
    # far is null if one distance is null and the other within its limit: not far then.
    judged = rows.withColumn("kept", kept).select(*columns, *VERDICT)
    # The figures are of use by themselves. Besides, filters are not pushed below them: one on
    # the verdict would be spelt out in terms of the text, and all work done many times over.
    return judged.observe(
        f"quality_rules_{uuid.uuid4().hex}",
        F.count(F.lit(1)).alias("judged"),
        F.count_if("kept").alias("kept"),
    )


def report(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The verdict on each document, distances rounded to six digits."""
    found = judge(documents.select("doc_id", "text", "lang"), limits)
    distances = {c: F.round(c, 6) for c in ("class_distance", "word_distance")}
    return found.withColumns(distances).select("doc_id", *VERDICT)


def sql(limits: Limits = Limits()) -> str:
    """The report in DuckDB's SQL."""
    def quoted(pattern: str) -> str:
        return pattern.replace("'", "''")

    t = "coalesce(text, '')"
    lists = ", ".join(
        "('{}', [{}])".format(lang, ", ".join(f"'{w}'" for w in listed))
        for lang, listed in sorted(limits.common_words.items())
    )
    counts = ", ".join(
        "length(regexp_replace({}, '[^{}]+', '', 'g'))".format(t, quoted(m))
        for m in [*CLASSES.values(), SPACE]
    )

    def distance(a: str, b: str) -> str:
        p, q = (f"({x}[i] / list_sum({x})::DOUBLE)" for x in (a, b))
        m = f"(({p} + {q}) / 2)"
        part = "CASE WHEN {0} > 0 THEN {0} * log2({0} / {1}) ELSE 0 END"
        return (
            f"sqrt(greatest(list_sum([({part.format(p, m)} + {part.format(q, m)}) / 2 "
            f"for i in range(1, len({a}) + 1)]), 0))"
        )

    split = f"[w for w in string_split_regex({{0}}, '[{SPACE}]+') if w <> '']"
    return f"""
    WITH lists AS (SELECT * FROM (VALUES {lists}) v(lang, listed)),
    d AS (
      SELECT doc_id, lang, listed, {t} AS t, length({t}) AS chars, [{counts}] AS c,
             {split.format(t)} AS w
      FROM documents LEFT JOIN lists USING (lang)),
    h AS (
      SELECT *, c || [chars - list_sum(c)] AS classes,
             [len(list_filter(w, lambda x: x = y)) for y in listed] AS commons0
      FROM d),
    f AS (SELECT *, CASE WHEN listed IS NOT NULL
                    THEN commons0 || [len(w) - list_sum(commons0)] END AS commons FROM h),
    refs AS (
      SELECT lang, list(class_sum ORDER BY i) FILTER (kind = 'c') AS class_sums,
             list(class_sum ORDER BY i) FILTER (kind = 'w') AS word_sums
      FROM (SELECT lang, kind, i, sum(n) AS class_sum FROM (
              SELECT lang, 'c' AS kind, unnest(classes) AS n, unnest(range(len(classes))) AS i
              FROM f WHERE listed IS NOT NULL
              UNION ALL
              SELECT lang, 'w', unnest(commons), unnest(range(len(commons)))
              FROM f WHERE listed IS NOT NULL) GROUP BY lang, kind, i)
      GROUP BY lang),
    win AS (
      SELECT doc_id, i, list_slice(w, i, i + {WINDOW - 1}) AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM f)),
    twice AS (
      SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next
      FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
    rep AS (SELECT doc_id, sum(least({WINDOW}, coalesce(next - i, {WINDOW}))) AS n_repeat_words
            FROM twice GROUP BY doc_id),
    b AS (
      SELECT f.*, len(w) AS n_words, chars - c[5] AS word_chars, c[3] AS n_symbols,
             len([l for l in string_split(t, chr(10)) if regexp_matches(l, '[^{SPACE}]')])
               - len(list_distinct([l for l in string_split(t, chr(10))
                                    if regexp_matches(l, '[^{SPACE}]')])) AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             class_sums, word_sums
      FROM f LEFT JOIN rep USING (doc_id) LEFT JOIN refs ON refs.lang = f.lang),
    s AS (
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
             n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             CASE WHEN list_sum(word_sums) >= {limits.min_reference_words}
                   AND chars >= {limits.min_chars}
                  THEN {distance("classes", "class_sums")} END AS class_distance,
             CASE WHEN list_sum(word_sums) >= {limits.min_reference_words}
                   AND n_words >= {limits.min_words} AND len(w) > 0
                  THEN {distance("commons", "word_sums")} END AS word_distance
      FROM b)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance,
           NOT base_failed AND NOT coalesce(class_distance > {limits.class_distance}
             OR word_distance > {limits.word_distance}, false) AS kept
    FROM s"""
