"""Spelling variants against a comparison of all words with all."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ferryline.llm import queries, spelling

SMALL = spelling.Settings(cell=400, leaf=3, held=50)


def plain_words(documents):
    counts = Counter()
    for doc_id, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    """By all pairs that share a beginning or an end, as near words of six letters and more do."""
    halves = {}
    for w in words:
        for key in {(0, w[:3]), (1, w[-3:])}:
            halves.setdefault(key, []).append(w)
    out, forms = {}, {}
    for w, n in words.items():
        others = {o for key in ((0, w[:3]), (1, w[-3:])) for o in halves[key] if near(w, o)}
        best = min(others, key=lambda o: (-words[o], o), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * n else None
        out[w] = len(others)
    rows = set()
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.add((w, forms[w], root, n, out[w], None if forms[w] is None else words[forms[w]]))
    return rows


def found(rows):
    listed = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows.collect()]
    assert len(listed) == len(set(listed))
    return set(listed)


def family(draw, many, alphabet="abcdeé"):
    """Words and what a few edits make of them."""
    words = {}
    for _ in range(many):
        word = "".join(draw.choice(alphabet) for _ in range(draw.randint(6, 12)))
        for _ in range(draw.randint(1, 6)):
            words[word] = draw.choice([5, 6, 25, 30, 125, 700, 5000])
            at = draw.randrange(len(word))
            word = draw.choice([word[:at] + word[at + 1 :], word[:at] + draw.choice(alphabet) + word[at:],
                                word[:at] + draw.choice(alphabet) + word[at + 1 :]])
    return {w: n for w, n in words.items() if len(w) >= 6}


@pytest.mark.parametrize("settings", [SMALL, spelling.Settings()])
def test_families(spark, settings):
    words = family(random.Random(1), 500) | {"x" * 3000: 9, "x" * 3001: 50, "aaaaaa": 5, "aaaaab": 25, "aaaabb": 125}
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(spelling.variants(rows, settings)) == plain_variants(words)


def test_many_of_the_same_letters(spark):
    """Words with equal letter counts cannot be parted by any cut: blocks and parts do that."""
    draw = random.Random(2)
    words = {}
    for _ in range(1500):
        letters = list(draw.choice(["aabbcc", "aabbccd"]))
        draw.shuffle(letters)
        words["".join(letters)] = draw.choice([5, 25, 130])
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(spelling.variants(rows, SMALL)) == plain_variants(words)


def test_odd_rows(spark, documents):
    rows = documents(
        (None, "Colour colour COLOUR colour colour"), (1, None), (2, ""), (2, "color " * 3), (2, "color " * 30),
        (3, "straße STRASSE straße straße straße straße naïveté " * 9), (4, "Éclair éclair " * 9), (4, "x" * 5000 + " ·×÷"),
        *[(i, "colours " * 3) for i in range(5, 400)],
    )
    plain = plain_variants(plain_words([(r.doc_id, r.text) for r in rows.collect()]))
    assert found(spelling.spelling_variants(rows)) == plain
    assert found(spelling.spelling_variants(rows.select("*", F.lit(1).alias("word"), F.lit(2).alias("n")), SMALL)) == plain
    assert spelling.spelling_variants(rows.limit(0)).count() == 0


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    expected = plain_variants(plain_words([(r.doc_id, r.text) for r in rows]))
    assert found(queries.op12_spelling(spark, sf_dir)) == expected
