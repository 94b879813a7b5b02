"""The registered queries against their SQL, or against what they must hold."""

import hashlib
import math
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
from comparison import connect, differences
from ferryline.llm import bpe, queries, warc


def rows_of(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").collect()


def test_all_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    rows = entry.queries()[name](spark, sf_dir)
    found = connect(sf_dir).execute(entry.oracle_sql()[name])
    assert differences(rows.collect(), rows.columns, found) == ""


def test_derivatives(spark, sf_dir):
    found = queries.op1_warc_derivatives(spark, sf_dir).collect()
    pages = {p.page_id: p for p in rows_of(spark, sf_dir, "pages")}
    kinds = Counter(r.record_type for r in found)
    assert kinds == {"metadata": len(pages), "conversion": len(pages)}
    for record in found:
        page = pages[record.page_id]
        assert record.target_uri == page.url
        assert record.block_digest == warc.digest(record.block.encode())
        assert record.source_payload_digest == warc.digest(page.html.encode())
        assert f"WARC-Refers-To: {record.refers_to}\r\n" in record.headers
        assert "<" not in record.block or record.record_type == "metadata" or "&lt;" in page.html


def test_suffix_tree_base_and_gain(spark, sf_dir):
    found = {r.doc_id: r for r in queries.op2_suffix_tree(spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in rows_of(spark, sf_dir, "documents")}
    assert found.keys() == texts.keys()

    def tokens(text):
        return [*(text or "").encode().lower().split(), b"\n"]

    def out(doc_id):
        return zlib.crc32(str(doc_id).encode()) % 5 == 1

    counts = Counter(t for d, text in texts.items() if not out(d) for t in tokens(text))
    total = sum(counts.values())
    for doc_id, text in texts.items():
        row, listed = found[doc_id], tokens(text)
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (len(counts) + 1))) for t in listed)
        assert (row.held_out, row.n_tokens) == (out(doc_id), len(listed))
        assert row.n_known == sum(t in counts for t in listed)
        assert row.train_tokens == total
        assert row.base_score == pytest.approx(base, rel=1e-9)
    unseen = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_shards(spark, sf_dir):
    found = queries.op5_shuffle_shards(spark, sf_dir).collect()
    texts = {r.doc_id: r.text.encode() for r in rows_of(spark, sf_dir, "documents")}
    assert {r.doc_id for r in found} == texts.keys() and len(found) == len(texts)
    assert all(r.size == len(texts[r.doc_id]) + 1 for r in found)
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in found)
    sizes = Counter(r.shard for r in found)
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, size in sizes.items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(size))
    assert {(r.law, r.grown_shard) for r in found} == {("rows", None)}


def test_encoding(spark, sf_dir):
    ranks = bpe.read_ranks(public_tokenizers.path(queries.RANKS))
    known = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    texts = {r.doc_id: r.text for r in rows_of(spark, sf_dir, "documents")}
    found = queries.op6_bpe(spark, sf_dir).collect()
    assert {r.doc_id for r in found} == texts.keys()
    for row in found:
        ids = known.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_mixture(spark, sf_dir):
    found = queries.op7_mixture(spark, sf_dir).collect()
    texts = {r.doc_id: r for r in rows_of(spark, sf_dir, "documents")}
    total = sum(len(r.text.split()) for r in texts.values())
    assert all(r.n_tokens == len(texts[r.doc_id].text.split()) for r in found)
    assert len({(r.doc_id, r.epoch) for r in found}) == len(found)
    assert sum(r.n_tokens for r in found) == pytest.approx(total, rel=0.1)


def test_classifier_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"  # enough labels to tell
    found = {r.doc_id: r for r in queries.op10_subword_quality(spark, sf_dir).collect()}
    assert found.keys() == {r.doc_id for r in rows_of(spark, sf_dir, "documents")}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in found.items())
    labels = [r for r in rows_of(spark, sf_dir, "labels") if found[r.doc_id].held_out]
    right = sum(found[r.doc_id].predicted == r.quality for r in labels)
    assert right / len(labels) >= 0.95
