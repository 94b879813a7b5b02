"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import math
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ferryline.llm import (
    bpe,
    caps,
    licenses,
    linking,
    minhash,
    mixing,
    quality_rules,
    sharding,
    subword,
    suffix_tree,
    warc,
)
from ferryline.llm.common import Scratch

WORDS = [f"w{i}" for i in range(400)]


def prose(seed, size):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(size))


@pytest.fixture(scope="module")
def odd(documents):
    """One of each odd row, and a few ordinary ones."""
    return documents(
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (None, prose(1, 30), "en", "a"),
        (5, prose(2, 60), "en", "a"),
        (6, prose(2, 60), "en", "a"),
        (6, prose(2, 60), "en", "a"),
        (7, prose(3, 40), None, None),
        (8, prose(4, 20_000), "xx", "b"),
        (9, "é" * 3000, "fr", "b"),
        (10, "one", "en", "b"),
    )


def clashing(rows):
    """With columns named like what the operators add or use inside."""
    names = ["kept", "ids", "score", "licenses", "_words", "_chars", "shard", "epoch", "_block", "n_words"]
    return rows.withColumns({name: F.lit(f"own {name}") for name in names})


# ------------------------------------------------------------------ archives


def test_derivatives_of_a_coded_page():
    import gzip

    body = gzip.compress("<html><title>A &amp; B</title><p>café<script>x</p></script></html>".encode("latin-1"))
    chunked = b"%x\r\n%s\r\n0\r\n\r\n" % (len(body), body)
    head = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n"
        b"Content-Encoding: gzip\r\nTransfer-Encoding: chunked\r\nX-Own: 1\r\n\r\n"
    )
    source = {"record_id": "<urn:x>", "target_uri": "http://h/p", "date": "d", "block": head + chunked}
    meta, text = warc.derived(source)
    assert text["block"].decode() == "A & B\ncafé"
    assert "source-header: X-Own: 1" in meta["block"].decode()
    assert meta["refers_to"] == text["refers_to"] == "<urn:x>"
    assert text["source_payload_digest"] == warc.digest(chunked)
    joined = warc.serialised(meta) + warc.serialised(text)
    back = list(warc.parsed(joined))
    assert [b["block"] for b in back] == [meta["block"], text["block"]]
    assert [b["headers"]["WARC-Refers-To"] for b in back] == ["<urn:x>"] * 2
    assert [b["headers"]["WARC-Block-Digest"] for b in back] == [warc.digest(b["block"]) for b in back]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>t</title><body><p>all of the text</p>", "all of the text"),
        ("<head><script>'<body>'</script><meta></head>a<head>b", "a\nb"),
        ("<head><title>t</title><p>a</p>", "t\na"),
        ("<header>a</header><head-line>b</head-line>", "a\nb"),
        ("a <svg width='1'/> b <svg><text>no</text></svg> c", "a b c"),
        ("a <svg-icon>b</svg-icon> c <svg>no</svg>", "a b c"),
        ("a <svg> b <template> c <noscript> d <math> e <svg> f", "a b c d e f"),
        ("a <template data=x/>no</template> b", "a b"),
        ("a<script>'<!--'</script>b<style>/*<!--*/</style>c", "a b c"),
        ("a<!-- <script> -->b<!-->c<!--no", "abc"),
        ("a<script/>no</script>b<style>no", "a b"),
    ],
)
def test_markup_that_ends_early_or_not_at_all(page, text):
    assert warc.plain_text(warc.visible(page)) == text


def test_links_stand_where_the_head_is_left_open():
    head = b"HTTP/1.1 200 OK\r\nContent-Type: %s\r\n\r\n<head><script src='s'/><body><a href='/x'>y</a>"
    for kind, text in ((b"application/xhtml+xml", "y"), (b"text/html", "")):
        source = {"record_id": "<r>", "target_uri": "http://h/p", "date": "d", "block": head % kind}
        meta, made = warc.derived(source)
        assert made["block"].decode() == text
        assert ("outlink: http://h/x" in meta["block"].decode()) == bool(text)


def test_odd_pages(spark):
    rows = [(1, None, None), (None, "http://a", ""), (3, "http://[", "<p>" + "x" * 200_000), (4, "u", "a<b <!-- open"), (4, "u", "a<b <!-- open")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.page_derivatives(pages.withColumn("block", F.lit("own"))).collect()
    texts = sorted((r.page_id or 0, r.block) for r in found if r.record_type == "conversion")
    assert [len(t) for _, t in texts] == [0, 0, 200_000, 1, 1]
    assert warc.page_derivatives(pages.limit(0)).count() == 0


def test_a_picture_has_metadata_alone(spark):
    block = bytearray(b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89")
    rows = [("<r>", "u", "d", block), (None, "u", "d", block), ("<s>", "u", "d", None)]
    given = spark.createDataFrame(rows, "record_id string, target_uri string, date string, block binary")
    found = warc.with_archive_bytes(warc.derive(given), compress=False).collect()
    assert [r.record_type for r in found] == ["metadata"]
    assert bytes(found[0].warc).startswith(b"WARC/1.1\r\n")


# ------------------------------------------------------------------ suffix tree


def plain_tree(texts, alphabet):
    """The tree by dictionaries, one context at a time."""
    settings = alphabet.settings
    least = max(1.0, settings.least_part * alphabet.tokens)
    listed = [[alphabet.symbol(w) for w in [*t.lower().split(), suffix_tree.END]] for t in texts]
    size = alphabet.size
    root = [(c + 0.5) / (sum(alphabet.counts) + 0.5 * size) for c in alphabet.counts]
    kept = {(): root}

    def state(context):
        while context not in kept:
            context = context[1:]
        return context

    for length in range(1, settings.depth + 1):
        made = {}
        for symbols in listed:
            for i in range(length, len(symbols)):
                made.setdefault(tuple(symbols[i - length : i]), []).append(symbols[i])
        level = {}
        for context, after in made.items():
            whole = sum(s[i : i + length] == list(context) for s in listed for i in range(len(s)))
            if whole < least:
                continue
            counts = {x: after.count(x) for x in set(after)}
            suffix = kept[state(context[1:])]
            seen, total = len(counts), len(after)
            gain = sum(
                n * math.log((n - 1 + seen * suffix[x]) / (total - 1 + seen) / suffix[x])
                for x, n in counts.items()
            )
            if gain / total >= settings.least_gain:
                level[context] = [
                    (counts.get(x, 0) + seen * suffix[x]) / (total + seen) for x in range(size)
                ]
        kept |= level
    return listed, kept, state


def test_tree_is_that_of_dictionaries(spark):
    rng, texts = random.Random(5), []
    for _ in range(30):
        words, last = [], "a"
        for _ in range(60):
            last = {"a": "b", "b": rng.choice("cd")}.get(last, rng.choice("abcdefgh"))
            words.append(last)
        texts.append(" ".join(words).encode())
    settings = suffix_tree.Settings(depth=3, least_part=0.01, forms=4)
    frame = spark.createDataFrame([(bytearray(t),) for t in texts], "text binary").repartition(3)
    with Scratch(spark) as scratch:
        words = scratch.keep(suffix_tree.word_counts(frame, settings), "words")
        alphabet = suffix_tree.read_alphabet(frame, words, settings)
        tree = suffix_tree.grow(frame, alphabet)
    listed, kept, state = plain_tree(texts, alphabet)
    assert len(kept) == 1 + sum(map(len, tree.keys)) > 5
    for symbols in listed:
        made = tree.log10(np.array(symbols), np.zeros(len(symbols), np.int64))
        for i, symbol in enumerate(symbols):
            context = state(tuple(symbols[max(0, i - 3) : i]))
            assert made[i] == pytest.approx(math.log10(kept[context][symbol]), abs=1e-5)
    assert np.allclose((10 ** tree.logs.astype(float)).sum(1), 1, atol=1e-4)


def test_scores_are_those_of_the_tree_in_memory(documents):
    """Scores from the tables, held-out texts and unseen pairs included, over several blocks."""
    rng, rows = random.Random(6), []
    for i in range(200):
        words, last = [], "a"
        for _ in range(rng.randrange(1, 120)):
            last = {"a": "b", "b": rng.choice("cd"), "d": "a" if words[-2:-1] == ["b"] else "e"}.get(
                last, rng.choice(["a", "b", "d", "e", "f", f"x{rng.randrange(400)}"])
            )
            words.append(last)
        rows.append((i, " ".join(words)))
    frame = documents(*rows).repartition(3)
    learned = frame.where(~suffix_tree.held_out()).select(F.col("text").cast("binary"))
    with Scratch(frame.sparkSession) as scratch:
        words = scratch.keep(suffix_tree.word_counts(learned, suffix_tree.Settings(forms=16)), "words")
        tokens = words.agg(F.sum("n")).first()[0]
        settings = suffix_tree.Settings(least_count=20, least_part=20 / tokens, forms=16, block_tokens=1500)
        alphabet = suffix_tree.read_alphabet(learned, words, settings)
        tree = suffix_tree.grow(learned, alphabet)
        counts = {r.key: r.n for r in words.collect()}
    assert [len(k) > 3 for k in tree.keys] == [True] * 3
    found = {r.doc_id: r.score for r in suffix_tree.scores(frame, settings).collect()}
    for i, text in rows:
        listed = [*text.encode().split(), suffix_tree.END]
        symbols = np.array([alphabet.symbol(w) for w in listed])
        score = tree.log10(symbols, np.zeros(len(symbols), np.int64)).sum()
        for word, symbol in zip(listed, symbols, strict=True):
            if word not in alphabet.frequent:
                total = alphabet.counts[symbol] + 0.5 * (alphabet.form_words[symbol - len(alphabet.frequent)] + 1)
                score += math.log10((counts.get(suffix_tree.word_key(word), 0) + 0.5) / total)
        assert found[i] == pytest.approx(score, rel=1e-5)


def test_symbols_and_contexts_grow_with_the_texts(documents):
    """Words and contexts far below 1/2000 of all tokens are learned from if they are there often enough."""
    filler = [(i, prose(i, 1000)) for i in range(300)]
    rare = [(1000 + i, "qx zzq " * 2) for i in range(40)]
    found = {r.doc_id: r for r in suffix_tree.scores(documents(*filler, *rare)).collect()}
    assert found[1000].train_tokens > 200_000
    # After "qx" comes "zzq" alone.
    assert found[1000].score > found[1000].base_score + 4


def test_contexts_in_parts_are_those_of_one_bucket(documents):
    """What follows a frequent context is dealt to several buckets without a change to the scores."""
    rng, rows = random.Random(8), []
    for i in range(60):
        rows.append((i, " ".join(f"w{int(rng.paretovariate(0.5)) % 300}" for _ in range(200))))
    frame = documents(*rows).repartition(3)
    settings = [suffix_tree.Settings(block_tokens=2000, part_tokens=n) for n in (100, 10**9)]
    dealt, whole = ({r.doc_id: r.score for r in suffix_tree.scores(frame, s).collect()} for s in settings)
    assert dealt == pytest.approx(whole, rel=1e-6)


def test_tables_of_the_tree_are_small(documents, monkeypatch):
    """What is kept at once, of long texts with many different pairs, in bytes for each token."""
    held, peaks, keep, drop = {}, [0], Scratch.keep, Scratch.drop

    def kept(self, rows, name):
        made = keep(self, rows, name)
        files = Path(f"{self.folder}/{name}".removeprefix("file:")).rglob("*.parquet")
        held[name] = sum(f.stat().st_size for f in files)
        peaks.append(sum(held.values()))
        return made

    def dropped(self, name):
        held.pop(name)
        drop(self, name)

    monkeypatch.setattr(Scratch, "keep", kept)
    monkeypatch.setattr(Scratch, "drop", dropped)
    rng, rows = random.Random(7), []
    for i in range(400):
        rows.append((i, " ".join(f"w{int(rng.paretovariate(0.4)) % 3000}" for _ in range(1000))))
    found = suffix_tree.scores(documents(*rows)).collect()
    assert 0 < max(peaks) < 6 * sum(r.n_tokens for r in found)


def test_odd_texts_are_scored(odd):
    found = suffix_tree.scores(clashing(odd)).collect()
    assert len(found) == 11
    by_id = {r.doc_id: r for r in found}
    assert [by_id[i].n_tokens for i in (1, 2, 3, 10)] == [1, 1, 1, 2]
    assert by_id[8].n_tokens == 20_001
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    assert suffix_tree.scores(odd.limit(0)).count() == 0


# ------------------------------------------------------------------ near duplicates


def jaccard(a, b):
    return len(a & b) / len(a | b)


def plain_components(sets, percent):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    listed = sorted(sets)
    for x, i in enumerate(listed):
        for j in listed[x + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in sets}


def shingles(text):
    words = (text or "").lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_sketches_estimate():
    rng = np.random.default_rng(1)
    for size, shared in ((1, 1), (3, 2), (50, 40), (3000, 2400)):
        a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        b = np.concatenate([a[:shared], rng.integers(0, 1 << 63, size - shared, dtype=np.uint64)])
        one, other = minhash.sketch(a, 512), minhash.sketch(b, 512)
        assert (one < np.iinfo(np.uint64).max).all()
        assert abs((one == other).mean() - shared / (2 * size - shared)) < 0.11
    assert len(minhash.sketch(np.empty(0, np.uint64), 512)) == 0


def test_near_groups_by_brute_force(documents, monkeypatch):
    """Groups whose members are far from some and near to others, cut into tiny cells."""
    monkeypatch.setattr(linking, "HALF", 8)
    rng, rows = random.Random(3), []
    for group in range(4):
        base = prose(group, 220).split()
        for copy in range(25):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((group * 100 + copy, " ".join(words)))
    rows += [(1000 + i, prose(50 + i, 100)) for i in range(20)]
    found = minhash.near_duplicates(documents(*rows)).collect()
    expected = plain_components({i: shingles(t) for i, t in rows}, 85)
    assert {r.doc_id: r.component_id for r in found} == expected
    assert 25 < len(set(expected.values())) < len(rows)


def test_pairs_of_a_large_group_never_become_rows(documents, monkeypatch):
    """Near copies that mostly stay below the threshold: tables of pairs grow with the group, not with its square."""
    rng, made, keep = random.Random(5), {}, Scratch.keep

    def counted(self, rows, name):
        out = keep(self, rows, name)
        if out.columns == ["a", "b"]:
            made[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    base, rows = prose(900, 200).split(), []
    for i in range(500):
        words = list(base)
        for place in rng.sample(range(200), 4):
            words[place] = f"x{i}y{place}"
        rows.append((i, " ".join(words)))
    found = minhash.near_duplicates(documents(*rows), corpus_pipeline.NEAR).collect()
    expected = plain_components({i: shingles(t) for i, t in rows}, corpus_pipeline.NEAR.similar)
    assert {r.doc_id: r.component_id for r in found} == expected
    assert 100 < len(set(expected.values())) < len(rows)
    assert made and max(made.values()) < 2 * len(rows)


def test_odd_texts_are_linked_with_nothing(odd):
    found = minhash.near_duplicates(clashing(odd)).collect()
    assert len(found) == 11
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in found)
    assert [g for g in got if g[0] in (1, 2, 3)] == [(i, 0, i, True) for i in (1, 2, 3)]
    assert [g[2:] for g in got if g[0] in (5, 6)] == [(5, True), (5, False), (5, False)]
    assert got[0][2:] == (None, True)
    assert [g[1:] for g in got if g[0] == 10] == [(1, 10, True)]
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)]
    pairs += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)] + [(7, 7)]
    with Scratch(spark) as scratch:
        given = spark.createDataFrame(pairs, "a long, b long")
        found = {r.id: r.component for r in linking.components(given, scratch).collect()}
    known = {i: i for p in pairs if p[0] != p[1] for i in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a != b and known[a] != known[b]:
                known[a] = known[b] = min(known[a], known[b])
                changed = True
    assert found == known


# ------------------------------------------------------------------ rules and licenses


def test_odd_texts_are_judged(odd):
    found = quality_rules.judge(clashing(odd))
    assert found.columns.count("kept") == 1 and "_words" in found.columns
    rows = found.collect()
    assert len(rows) == 11 and {r._words for r in rows} == {"own _words"}
    assert [r.n_words for r in sorted(rows, key=lambda r: r.doc_id or 0) if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    assert all(not r.kept for r in rows if r.n_words < 20)
    assert quality_rules.judge(odd.limit(0)).count() == 0


def test_repeated_windows(documents):
    base = [f"u{i}" for i in range(30)]
    text = " ".join(base[:10] + ["x"] + base[1:9] + ["y"] + base[10:])
    row = quality_rules.judge(documents((1, text, "en"))).first()
    assert row.n_repeat_words == 16
    row = quality_rules.judge(documents((1, " ".join(["a"] * 40) + "\nb\nb\n\n\n", "en"))).first()
    assert (row.n_repeat_words, row.n_dup_lines) == (40, 1)


def test_licenses(odd, documents):
    texts = documents(
        (1, "Prose.\nReleased under the MIT license\nmore"),
        (2, "permission is hereby granted, free of charge, to any person\nobtaining a copy of this software"),
        (3, "\n".join(licenses.TEMPLATES[13][1].replace(",", ",\n").split("\n"))),
        (4, "Licensed under some other terms altogether and nothing more than that"),
    )
    found = {r.doc_id: r for r in licenses.license_report(texts).collect()}
    assert (found[1].license, found[1].dice, found[1].passage) == ("MIT", 1.0, "released under the mit license")
    assert found[2].n_matches == 0 and found[4].n_matches == 0
    assert (found[3].license, found[3].dice) == ("MIT", 1.0)
    both = licenses.scan_licenses(clashing(odd))
    assert both.count() == 11 and dict(both.dtypes)["licenses"].startswith("array<struct")
    assert licenses.license_report(odd.limit(0)).count() == 0


# ------------------------------------------------------------------ shards


def test_matrix_sums_and_law():
    rng = random.Random(4)
    for _ in range(50):
        sent = [rng.randrange(0, 40) for _ in range(6)]
        received = sharding.shard_sizes(sum(sent), 5)
        matrix = sharding.communication_matrix(sent, received, rng.randrange(10**6))
        assert [sum(r) for r in matrix] == sent and [sum(c) for c in zip(*matrix, strict=True)] == received
    good, bad, draws = 7, 12, 8
    drawn = [sharding.hypergeometric(rng, good, bad, draws) for _ in range(20_000)]
    for k in range(8):
        share = math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws)
        assert drawn.count(k) / 20_000 == pytest.approx(share, abs=0.015)
    assert sharding.hypergeometric(rng, 10**10, 10**10, 10**6) == pytest.approx(5 * 10**5, rel=0.02)


def test_odd_rows_are_dealt(odd):
    found = sharding.shuffle_to_shards(
        clashing(odd), by=["doc_id", "text"], shards=4, block_rows=3, cell_rows=2
    ).collect()
    assert sorted(map(len, [[r for r in found if r.shard == s] for s in range(4)])) == [2, 3, 3, 3]
    assert {(r.shard, r.slot) for r in found} == {(s, i) for s, n in zip(range(4), (3, 3, 3, 2), strict=True) for i in range(n)}
    assert {r.epoch for r in found} == {"own epoch"}
    assert sharding.sharded_documents(odd.limit(0)).count() == 0


# ------------------------------------------------------------------ encoding


def test_long_runs_round_trip(spark, odd):
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 256, b"aaaa": 257, b"ab": 258, b"\xc3\xa9": 259}
    shared = bpe.share_vocabulary(spark, ranks)
    assert bpe.merge(b"aaaaa", ranks, 4) == [257, 97]
    assert bpe.merge(b"aab", ranks, 4) == [256, 98]
    found = bpe.decode(bpe.encode(clashing(odd), shared, r"\S+|\s+"), shared).collect()
    assert len(found) == 11
    for row in found:
        assert bytes(row.decoded) == (row.text or "").encode()
        assert row.score == "own score"
    assert [len(r.ids) for r in found if r.doc_id == 9] == [3000]
    assert bpe.encode(odd.limit(0), shared, r"\S+").count() == 0


def test_forgetting_changes_nothing(monkeypatch):
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abab": 257}
    texts = [" ".join(random.Random(i).choice(["ab", "abab", "b", f"a{i}b"]) for _ in range(50)) for i in range(20)]

    def run():
        made, encode = bytearray(), bpe.encoder(ranks, r"\S+|\s+", {"young": {}, "old": {}})
        for text in texts:
            encode(text, made)
        return made

    whole = run()
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    assert run() == whole


def test_tree_merges_as_the_plain_rule_does():
    rng = random.Random(6)
    ranks = {bytes([i]): i for i in range(256)}
    while len(ranks) < 700:
        a, b = rng.choice(list(ranks)), rng.choice(list(ranks))
        if set(a + b) <= set(b"abc") and len(a + b) <= 9:
            ranks.setdefault(a + b, len(ranks))
    for length in [*[rng.randrange(1, 60) for _ in range(200)], 300, 700]:
        piece = bytes(rng.choice(b"abc") for _ in range(length))
        parts = [bytes([c]) for c in piece]
        while piece not in ranks:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not pairs:
                break
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        expected = [ranks[piece]] if piece in ranks else [ranks[p] for p in parts]
        assert bpe.merge(piece, ranks, 9) == expected


# ------------------------------------------------------------------ mixing


def sources(documents, sizes, words=20):
    rows = [(s * 1000 + i, prose(s * 1000 + i, words), "en", f"s{s}") for s, n in enumerate(sizes) for i in range(n)]
    return documents(*rows)


def test_weights_meet_the_targets(documents):
    docs = sources(documents, [400, 40, 20])
    shares = np.array([400, 40, 20]) / 460

    def run(**target):
        found = mixing.mixture(docs, target=mixing.Target(**target), block_tokens=1000).collect()
        weights = {r.source: r.weight for r in found}
        assert sum(weights.values()) == pytest.approx(1)
        for source, weight in weights.items():
            drawn = sum(r.n_tokens for r in found if r.source == source)
            assert drawn == pytest.approx(weight * 9200, abs=160)
        return np.array([weights[f"s{i}"] for i in range(3)]), {r.exponent for r in found}.pop()

    weights, _ = run(entropy=0.9, repetition=None)
    assert -(weights * np.log(weights)).sum() / np.log(3) == pytest.approx(0.9, abs=1e-6)
    weights, _ = run(entropy=0.99, repetition=3.0)
    assert (weights / shares).max() == pytest.approx(3, abs=1e-6)
    assert run(entropy=None)[1] == 1


def test_epochs_are_whole_before_another_begins(documents):
    docs = sources(documents, [300, 10])
    found = mixing.mixture(docs, target=mixing.Target(entropy=0.95, repetition=None)).collect()
    small = [r for r in found if r.source == "s1"]
    last = max(r.epoch for r in small)
    assert last >= 5
    for epoch in range(last):
        assert len({r.doc_id for r in small if r.epoch == epoch}) == 10


def test_odd_rows_are_mixed(odd):
    natural = mixing.Target(entropy=None)
    found = mixing.mixture(clashing(odd), target=natural).collect()
    assert {r.doc_id for r in found} == {None, 5, 6, 7, 8, 9, 10}
    docs = mixing.mixed_documents(clashing(odd), target=natural)
    assert docs.columns == clashing(odd).columns
    assert docs.count() == len(found) == 8
    assert mixing.mixture(odd.limit(0)).count() == 0


# ------------------------------------------------------------------ vectors


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_caps_find_what_brute_force_finds(spark, monkeypatch):
    monkeypatch.setattr(linking, "HALF", 16)
    rng, rows = np.random.default_rng(3), []
    for group in range(6):
        base = rng.standard_normal(24)
        for copy in range(40 if group == 0 else 6):
            noisy = base + rng.standard_normal(24) * np.linalg.norm(base) * rng.choice([0, 0.01, 0.02, 0.028])
            rows.append((len(rows), [float(x) for x in noisy.astype(np.float32)], group % 2))
    for _ in range(150):
        rows.append((len(rows), [float(x) for x in rng.standard_normal(24).astype(np.float32)], len(rows) % 2))
    matrix = np.array([r[1] for r in rows])
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    labels = np.array([r[2] for r in rows])
    linked = (matrix @ matrix.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    roots = caps._roots(linked, np.arange(len(rows)))
    found = {r.vec_id: r for r in caps.near_vectors(vectors(spark, rows)).collect()}
    assert [found[i].n_links for i in range(len(rows))] == linked.sum(1).tolist()
    assert [found[i].component_id for i in range(len(rows))] == roots.tolist()


def test_best_directions_are_exact():
    rng, settings = np.random.default_rng(1), caps.Settings(listed=10, blocks=3, least_words=6)
    points = rng.standard_normal((20, 7))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    rotation, code = caps.codes(7, 6, settings)
    every = np.array([(i, j, k) for i in range(6) for j in range(6) for k in range(6)])
    whole = np.concatenate([code[b, every[:, b]] for b in range(3)], 1)
    scores = np.pad(points, ((0, 0), (0, 2))) @ rotation @ whole.T
    best = np.sort(np.argsort(-scores, 1)[:, :10], 1)
    assert (np.sort(caps.directions(points, 6, settings), 1) == best).all()


def test_odd_vectors_are_linked_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None),
        (6, [1.0, 0.0], None), (7, None, 1), (8, [0.0, 0.0], 1), (9, [1.0, nan], 1), (10, [1.0, inf], 1),
        (11, [1.0, None], 1), (12, [], 1), (13, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (14, [-1.0, 0.0], 1),
    ]
    table = vectors(spark, rows)
    found = caps.near_vectors(table.withColumn("bucket", F.lit("own"))).collect()
    assert len(found) == len(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found}
    assert got.pop(None) == (0, None, True)
    assert [got.pop(i) for i in (1, 2, 3)] == [(2, 1, True), (2, 1, False), (2, 1, False)]
    assert got == {i: (0, i, True) for i in got}
    assert caps.near_vectors(table.limit(0)).count() == 0


# ------------------------------------------------------------------ classifier


def test_odd_texts_get_a_score(spark, odd):
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, 0), (7, 0, 0), (8, None, 0), (None, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    model = subword.fit(odd, labels)
    found = subword.score(clashing(odd), model)
    assert dict(found.dtypes)["score"] == "double" and found.columns.count("score") == 1
    rows = found.collect()
    assert len(rows) == 11 and {r.ids for r in rows} == {"own ids"}
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    empty = subword.scores(odd, labels.limit(0)).collect()
    assert {r.score for r in empty} == {0.5}
    assert subword.scores(odd.limit(0), labels).count() == 0


def test_repeats_are_counted():
    codes = np.array([1, 1, 1, 1, 2, 2, 3])
    assert subword.repeats(codes, np.array([0, 0, 2, 3, 7, 7])).tolist() == [0, 1, 0, 1, 0]
    assert subword.repeats(np.empty(0, int), np.array([0, 0])).tolist() == [0]


def test_words_are_hashed_together_as_one_by_one(monkeypatch):
    weights = np.arange(1 << 16) * 7 + 1
    words = [b"a", b"<", b"<<>>", b"\x00", b"\x00" * 3, b"\xff\xfe", b"\xf0\x9f\x98", b"\xed\xa0\x80z", b"x" * 999]
    words += [w.encode() for w in ("é", "日本語テキスト", "😀" * 5, "é😀a日" * 300, "e\u0301\ufffd", "plain")]
    valid = [w for w in words if w.decode("utf-8", "ignore").encode() == w]
    for settings in (subword.Settings(), subword.Settings(shortest=1, longest=2), subword.Settings(longest=6, rows=1000)):
        rows = {w: subword.features(w, settings) for w in words}
        for piece in (3, 64, subword.PIECE):
            monkeypatch.setattr(subword, "PIECE", piece)
            for given in (words, words[::-1], valid, [b"a"], []):
                sums, counts = subword.word_sums(given, weights, settings)
                assert sums.tolist() == [weights[rows[w]].sum() for w in given]
                assert counts.tolist() == [len(rows[w]) for w in given]


def test_classifier_scores_without_calls_for_each_ngram():
    """Also, equal texts have equal scores wherever they lie, and the score is that of the features."""
    rng = np.random.default_rng(3)
    settings = subword.Settings()
    model = subword.Model(rng.normal(size=settings.rows).astype(np.float32), 0.1, settings)
    words = ["".join(rng.choice(list("abcdefé"), rng.integers(3, 14))) for _ in range(3000)]
    texts = [" ".join(words[i : i + 30]).encode() for i in range(0, 3000, 30)]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    rate = model.scorer()
    sys.setprofile(count)
    try:
        found = rate(pa.array(texts * 2, pa.binary()))
    finally:
        sys.setprofile(None)
    assert calls < 6 * len(words)
    assert found[:100].tolist() == found[100:].tolist()
    for text, score in zip(texts, found, strict=False):
        rows = np.concatenate([subword.features(w, settings) for w in text.split()])
        odds = model.weights[rows].astype(float).sum() / max(len(rows), settings.least) + model.bias
        assert score == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-6)
    strong = subword.Model(np.full(settings.rows, 1e9, np.float32), -1e9 + 2, settings).scorer()
    assert strong(pa.array([texts[0] * 1000, b""], pa.binary())) == pytest.approx([1 / (1 + math.exp(-2)), 0], abs=1e-6)


# ------------------------------------------------------------------ pipeline


def test_stages_in_order(spark, sf_dir, tmp_path):
    """Each stage does what its operator says, to all that the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = ({r.doc_id for r in d.select("doc_id").collect()} for d in (docs, out))
        assert after <= before
        seen.append((name, before, after))
        if place < 4:
            assert out.columns == columns
            docs = out
    kept = {r.doc_id for r in quality_rules.report(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("kept").collect()}
    assert seen[0][2] == kept
    sets = {r.doc_id: shingles(r.text) for r in spark.read.parquet(str(tmp_path / "quality_classifier")).collect()}
    groups = plain_components(sets, corpus_pipeline.NEAR.similar)
    assert seen[2][2] == {i for i, g in groups.items() if i == g}
    assert out.count() == docs.count()
    assert corpus_pipeline.run(spark, sf_dir).count() == out.count()


def test_stage_links_at_four_fifths(spark, documents, sf_dir):
    """Pairs from 0.80 to 0.85 are one document to the stage, those below are two."""
    rows, similar = [], {}
    for i in range(60):
        words = prose(700 + i, 200).split()
        other = [*words[: 200 - 18 - i % 8], *(f"x{i}y{j}" for j in range(18 + i % 8))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        similar[i] = jaccard(shingles(rows[-2][1]), shingles(rows[-1][1]))
    assert any(0.8 <= s < 0.85 for s in similar.values()) and any(s < 0.8 for s in similar.values())
    left = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, documents(*rows), sf_dir).collect()}
    assert left == {2 * i for i in similar} | {2 * i + 1 for i, s in similar.items() if s < 0.8}
    near = corpus_pipeline.NEAR
    assert (1 - (near.similar / 100) ** near.rows) ** near.bands < 1e-9


def test_one_id_with_several_texts(spark, documents, sf_dir):
    """A document is linked by any of its texts, none of which is lost."""
    one, other = prose(801, 120), prose(802, 120)
    near = [" ".join(t.split()[:-2] + ["changed", "end"]) for t in (one, other)]
    rows = documents((1, one), (1, other), (1, one), (2, near[0]), (3, near[1]), (4, prose(803, 120)), (None, one))
    found = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(rows).collect()}
    assert found == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (None, None, True)}
    left = corpus_pipeline.near_duplicate_stage(spark, rows, sf_dir).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == sorted([(0, one), (1, one), (1, other), (4, prose(803, 120))])


def test_stages_take_odd_rows(spark, odd, sf_dir):
    for name, stage in corpus_pipeline.STAGES[:4]:
        for given in (clashing(odd), clashing(odd).limit(0)):
            out = stage(spark, given, sf_dir)
            assert out.columns == given.columns, name
            assert out.count() <= given.count() * 2
    for given in (clashing(odd), clashing(odd).limit(0)):
        assert corpus_pipeline.encoding_stage(spark, given, sf_dir).count() == given.count()
    left = corpus_pipeline.near_duplicate_stage(spark, odd, sf_dir)
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 5, 7, 8, 9, 10]


def test_hashes_are_those_of_the_words():
    hashes, ends = minhash.word_hashes(pa.array([b"A b", None, b"a"], pa.binary()))
    assert ends.tolist() == [0, 2, 2, 3] and hashes[0] == hashes[2] != hashes[1]
    assert suffix_tree.form(b"word", suffix_tree.Settings()) == zlib.crc32(b"ord") % 512
