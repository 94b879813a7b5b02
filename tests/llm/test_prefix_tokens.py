"""Prefix counts against the library, prefix by prefix."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from ferryline.llm import prefix_tokens, queries

KINDS = ("abcde ", "aeiouths  ", " \n\t.,-ab", "abcABC0123456789 .", "éèüößñ²a.", "中文的是不 a", "ﬁ\x00​😀a ▁", "=- ", "thean ")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECES))


@pytest.fixture(scope="module")
def counter():
    return prefix_tokens.Counter(prefix_tokens.read_vocabulary(public_tokenizers.path(queries.PIECES)))


def texts(seed, many, longest=60):
    draw = random.Random(seed)
    for _ in range(many):
        kind = draw.choice(KINDS)
        yield "".join(draw.choice(kind) for _ in range(draw.randint(1, longest)))


def test_every_prefix(library, counter):
    for text in texts(1, 250):
        found = np.concatenate([*counter.prefixes(text)]).tolist()
        assert found == [len(library.encode(text[:i])) for i in range(1, len(text) + 1)], text


def test_whole_texts(library, counter, monkeypatch):
    given = [*texts(2, 1500, 200), "ab" * 30_000, " " * 5000, "word " * 20_000, "<s> </s> <unk> <0x0A>", "x" * 49 + " y"]
    for block in (prefix_tokens.BLOCK, 7):
        monkeypatch.setattr(prefix_tokens, "BLOCK", block)
        for text in given:
            assert int([*counter.prefixes(text)][-1][-1]) == len(library.encode(text))


def test_what_is_remembered_does_not_matter(counter, monkeypatch):
    given = [*texts(3, 300)]
    before = [int([*counter.prefixes(t)][-1][-1]) for t in given]
    monkeypatch.setattr(prefix_tokens, "REMEMBERED", 3)
    monkeypatch.setattr(prefix_tokens, "PAIRS", 2)
    assert [int([*counter.prefixes(t)][-1][-1]) for t in given] == before


def test_questions(spark, documents, library):
    given = [*texts(4, 40), "", None]
    rows = documents(*enumerate(given))
    pieces = prefix_tokens.share_vocabulary(spark, public_tokenizers.path(queries.PIECES))
    counts = F.col("prefix_tokens")
    asked = prefix_tokens.prefix_counts(rows, pieces).select(
        "doc_id",
        counts,
        prefix_tokens.tokens_of_prefix(counts, F.lit(7)).alias("cut"),
        prefix_tokens.longest_within(counts, F.lit(5)).alias("within"),
    )
    for row in asked.collect():
        text = given[row.doc_id] or ""
        plain = [len(library.encode(text[:i])) for i in range(len(text) + 1)]
        assert row.prefix_tokens == plain
        assert row.cut == plain[min(7, len(text))]
        assert row.within == max(i for i, n in enumerate(plain) if n <= 5)
    for row in prefix_tokens.counted(rows, pieces, 5).collect():
        text = given[row.doc_id] or ""
        plain = [len(library.encode(text[:i])) for i in range(len(text) + 1)]
        within = max(i for i, n in enumerate(plain) if n <= 5)
        assert row[1:] == (len(text.encode()), plain[-1], plain[-1] > 5, within)


def test_odd_rows(spark, documents):
    pieces = prefix_tokens.share_vocabulary(spark, public_tokenizers.path(queries.PIECES))
    rows = documents((None, "a b"), (1, None), (2, ""), (2, ""), (2, "a b"))
    found = sorted(tuple(r)[1:4] for r in prefix_tokens.counted(rows, pieces).collect())
    assert found == [(0, 0, False)] * 3 + [(3, 2, False)] * 2
    assert prefix_tokens.counted(rows.limit(0), pieces).count() == 0
    clash = rows.select("*", F.lit(1).alias("prefix_tokens"), F.lit(2).alias("n_tokens"))
    found = prefix_tokens.prefix_counts(clash, pieces)
    assert sorted(found.columns) == sorted(clash.columns)
    assert {tuple(r.prefix_tokens) for r in found.collect()} == {(0,), (0, 1, 2, 2)}


def test_query(spark, sf_dir, library):
    found = {r.doc_id: r for r in queries.op11_prefix_tokens(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(found) == len(rows)
    for row in rows:
        text, made = row.text or "", found[row.doc_id]
        n = len(library.encode(text))
        assert (made.n_bytes, made.n_tokens, made.over_limit) == (len(text.encode()), n, n > 4096)
        assert len(library.encode(text[: made.kept_chars])) <= 4096
        assert made.kept_chars == len(text) or made.over_limit
