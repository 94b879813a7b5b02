"""Scoring texts by a probabilistic suffix tree with contexts of variable length.

A word that is there a least number of times is a symbol of its own, any other goes by its form, a
hash of its ending. A context of one more symbol becomes a candidate if it is there that often itself, so
symbols and contexts grow with the corpus. It is kept if its next-symbol distribution diverges from that
of the longest suffix kept before it; the test is the gain in log-likelihood for one token, each
token left out of the counts it is scored by. Distributions are smoothed with those of that
suffix, by as many pseudo-counts as different symbols were seen. A text is scored by the longest
kept suffix at each place, and a word of a form by its share in the form.

Texts are coded in blocks, made where they are read. Level by level a block sends its distinct pairs of a context and
the next symbol to the buckets of their contexts, each with the probability the shorter levels give it; a bucket has all pairs of
its contexts, decides which are kept, and gives back the new probabilities in the order in which the pairs came.
What follows a context that is there very often is dealt to several buckets, whose sums are added first. :func:`grow` makes the same tree in memory, for small alphabets; the tests hold the tables against it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.llm.common import Scratch, in_parts, opened, settled, share
from ferryline.llm.minhash import mixed

#: The end of a text; no word, since it is white space.
END = b"\n"

_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """``least_count`` : how often a word must be there to be a symbol, and symbols to be a context.

    ``least_part`` : the same as a part of all tokens, for the tree in memory alone.
    ``forms`` : classes of the words that are no symbols.
    ``least_gain`` : nats for one token by which a context must do better than its suffix.
    ``block_tokens`` : tokens of a block of documents, about.
    ``part_tokens`` : how often a context may be there before what follows it is dealt to several buckets.
    """

    depth: int = 3
    least_count: int = 32
    least_part: float = 5e-4
    forms: int = 512
    ending: int = 3
    least_gain: float = 0.005
    block_tokens: int = 1_000_000
    part_tokens: int = 4_000_000


def word_key(word: bytes) -> int:
    """64 bits that stand for a word; signed, as Spark has them."""
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def form(word: bytes, settings: Settings) -> int:
    """The class of a word by its ending."""
    return zlib.crc32(word[-settings.ending :]) % settings.forms


def split_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Tokens of all texts as places in the list of distinct ones, and the text of each."""
    listed: list[bytes] = []
    lengths = []
    for text in texts:
        tokens = (text.as_py() or b"").lower().split()
        tokens.append(END)
        listed += tokens
        lengths.append(len(tokens))
    coded = pa.array(listed, pa.binary()).dictionary_encode()
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return coded.indices.to_numpy(zero_copy_only=False), owner, coded.dictionary.to_pylist()


@dataclass
class Alphabet:
    """Symbols: the frequent words, then the forms. ``counts`` of both in the training tokens.

    ``form_words`` : how many different words of each form there are.
    """

    frequent: dict[bytes, int]
    counts: np.ndarray
    form_words: np.ndarray
    tokens: int
    words: int
    settings: Settings

    @property
    def size(self) -> int:
        return len(self.counts)

    def symbol(self, word: bytes) -> int:
        known = self.frequent.get(word)
        return len(self.frequent) + form(word, self.settings) if known is None else known

    def symbols(self, distinct: list[bytes]) -> np.ndarray:
        return np.fromiter((self.symbol(w) for w in distinct), np.int64, len(distinct))


@dataclass
class Tree:
    """Kept contexts of each length as sorted numbers in base ``alphabet.size``, and for each the
    row of its log10 probabilities; row 0 is the root's."""

    alphabet: Alphabet
    logs: np.ndarray
    keys: list[np.ndarray] = field(default_factory=list)
    rows: list[np.ndarray] = field(default_factory=list)

    def states(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The row of the longest kept suffix before each token."""
        found = np.zeros(len(symbols), np.int64)
        for length, (keys, rows) in enumerate(zip(self.keys, self.rows, strict=True), 1):
            if not len(keys):
                continue
            places, numbers = contexts(symbols, owner, length, self.alphabet.size)
            at, known = look_up(keys, numbers)
            found[places[known]] = rows[at[known]]
        return found

    def log10(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """log10 of the probability of each symbol where it stands."""
        return self.logs[self.states(symbols, owner), symbols].astype(np.float64)


def contexts(
    symbols: np.ndarray, owner: np.ndarray, length: int, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """Places with ``length`` symbols of the same text before them, and those as a number."""
    places = np.arange(length, len(symbols))
    places = places[owner[places] == owner[places - length]]
    numbers = np.zeros(len(places), np.int64)
    for back in range(length, 0, -1):
        numbers = numbers * size + symbols[places - back]
    return places, numbers


def look_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sorted keys each is, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def held_out() -> Column:
    """The fifth that is not learned from; a null id is learned from."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return F.coalesce(remainder == 1, F.lit(False))


def word_counts(texts: DataFrame, settings: Settings) -> DataFrame:
    """``key, form, n`` of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in in_parts(whole, "text")):
            codes, _, distinct = split_texts(batch.column(0))
            counts = np.bincount(codes, minlength=len(distinct))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([word_key(w) for w in distinct], pa.int64()),
                    pa.array([form(w, settings) for w in distinct], pa.int32()),
                    pa.array(counts, pa.int64()),
                ],
                names=["key", "form", "n"],
            )

    counted = texts.mapInArrow(run, "key long, form int, n long")
    return counted.groupBy("key", "form").agg(F.sum("n").alias("n"))


def frequent_words(texts: DataFrame, keys: list[int]) -> list[bytes]:
    """The words behind a bounded list of keys."""
    wanted = np.sort(np.array(keys, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        for batch in (part for whole in batches for part in in_parts(whole, "text")):
            _, _, distinct = split_texts(batch.column(0))
            made = np.array([word_key(w) for w in distinct], np.int64)
            _, known = look_up(wanted, made)
            new = {distinct[i] for i in np.flatnonzero(known)} - told
            told |= new
            yield pa.RecordBatch.from_arrays([pa.array(sorted(new), pa.binary())], names=["word"])

    if not len(wanted):
        return []
    found = texts.mapInArrow(run, "word binary").distinct()
    return sorted(found.toArrow()["word"].to_pylist())


def read_alphabet(texts: DataFrame, words: DataFrame, settings: Settings) -> Alphabet:
    """The symbols, from the counts of all words. Gathers at most ``1 / least_part`` words."""
    tokens, distinct = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    tokens = tokens or 0
    often = words.where(F.col("n") >= max(1, settings.least_part * tokens))
    counts = {r.key: r.n for r in often.select("key", "n").collect()}
    listed = frequent_words(texts, list(counts))
    rare = words.where(F.col("n") < max(1, settings.least_part * tokens))
    by_form = rare.groupBy("form").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))
    form_counts = np.zeros(settings.forms, np.int64)
    form_words = np.zeros(settings.forms, np.int64)
    for row in by_form.collect():
        form_counts[row.form], form_words[row.form] = row.n, row.words
    own = np.array([counts[word_key(w)] for w in listed], np.int64)
    return Alphabet(
        {w: i for i, w in enumerate(listed)},
        np.concatenate([own, form_counts]),
        form_words,
        int(tokens),
        int(distinct),
        settings,
    )


def followers(texts: DataFrame, alphabet: Alphabet, length: int, keys: np.ndarray) -> np.ndarray:
    """How often each symbol follows each context: a row for each of the sorted ``keys``."""
    size = alphabet.size
    shared = share(texts.sparkSession, (alphabet, keys))  # bounded by the settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, listed = opened(shared)
        sums = np.zeros(len(listed) * own.size, np.int64)
        for batch in (part for whole in batches for part in in_parts(whole, "text")):
            codes, owner, distinct = split_texts(batch.column(0))
            symbols = own.symbols(distinct)[codes]
            places, numbers = contexts(symbols, owner, length, own.size)
            at, known = look_up(listed, numbers)
            pairs = at[known] * own.size + symbols[places[known]]
            sums += np.bincount(pairs, minlength=len(sums))
        seen = np.flatnonzero(sums)
        for start in range(0, len(seen), 100_000):
            part = seen[start : start + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sums[part])], names=["pair", "n"])

    found = texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    gathered = found.toArrow()
    counts = np.zeros(len(keys) * size, np.int64)
    counts[gathered["pair"].to_numpy()] = gathered["n"].to_numpy()
    return counts.reshape(len(keys), size)


def smoothed(counts: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Counts with as many pseudo-counts, dealt out as by the suffix, as symbols were seen."""
    seen = np.maximum((counts > 0).sum(1, keepdims=True), 1)
    return (counts + seen * suffix) / (counts.sum(1, keepdims=True) + seen)


def gains(counts: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Mean log of the ratio to the suffix over all tokens, each left out where it is scored."""
    seen = np.maximum((counts > 0).sum(1, keepdims=True), 1)
    total = counts.sum(1, keepdims=True)
    without = (np.maximum(counts - 1, 0) + seen * suffix) / np.maximum(total - 1 + seen, 1)
    ratios = np.where(counts > 0, counts * np.log(without / suffix), 0.0)
    return ratios.sum(1) / np.maximum(total[:, 0], 1)


def grow(texts: DataFrame, alphabet: Alphabet) -> Tree:
    """The tree, level by level; each level is one pass over the texts."""
    settings, size = alphabet.settings, alphabet.size
    least = max(1.0, settings.least_part * alphabet.tokens)
    root = (alphabet.counts + 0.5) / (alphabet.counts.sum() + 0.5 * size)
    tables, tree = [root[None, :]], Tree(alphabet, np.empty(0))
    end = alphabet.frequent.get(END, -1)
    keys = np.flatnonzero(alphabet.counts >= least)
    keys = keys[keys != end]
    for length in range(1, settings.depth + 1):
        if not len(keys) or not alphabet.tokens:
            break
        counts = followers(texts, alphabet, length, keys)
        # The longest kept suffix of a context is the state its own last symbols lead to.
        behind = np.zeros(len(keys), np.int64)
        for shorter, (kept, rows) in enumerate(zip(tree.keys, tree.rows, strict=True), 1):
            if len(kept):
                at, known = look_up(kept, keys % size**shorter)
                behind[known] = rows[at[known]]
        suffix = np.concatenate(tables)[behind]
        good = (gains(counts, suffix) >= settings.least_gain) & (counts.sum(1) > 0)
        made = sum(map(len, tables))
        tree.keys.append(keys[good])
        tree.rows.append(made + np.arange(good.sum()))
        tables.append(smoothed(counts[good], suffix[good]))
        # Contexts of the next level are the frequent continuations of this one.
        context, symbol = np.nonzero(counts >= least)
        longer = keys[context] * size + symbol
        keys = np.sort(longer[symbol != end])
    tree.logs = np.log10(np.concatenate(tables)).astype(np.float32)
    return tree


@dataclass(frozen=True)
class Totals:
    """What all tasks need of the counts; bounded by the number of forms."""

    tokens: int
    words: int
    symbols: int
    form_counts: np.ndarray
    form_words: np.ndarray
    settings: Settings


_TEXTS = (
    "block long, doc_id array<long>, held_out array<boolean>, sizes array<int>, codes binary,"
    " keys array<long>, forms array<int>"
)
_WORDS = "bucket long, block long, keys array<long>, forms array<int>, n array<int>"
_COUNTS = "block long, bucket long, symbols array<long>, n array<long>, form_n array<long>, form_words array<long>"
_CODED = (
    "block long, level int, doc_id array<long>, held_out array<boolean>, sizes array<int>, n_known array<long>,"
    " base_score array<double>, score array<double>, codes binary, symbols array<long>, n array<long>,"
    " going_on binary, values array<float>, p binary, parts binary"
)
_PAIRS = "bucket long, block long, contexts array<long>, runs array<int>, next {0}, n array<int>, q array<float>"
_MERGED = "bucket long, context long, total long, seen long, n array<long>, q array<float>"
_VERDICTS = "bucket long, context long, total long, seen long, kept boolean"
_ANSWERS = "block long, bucket long, seen array<long>, total array<long>, n binary, most long"
_SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double,"
    " train_tokens long"
)
#: Bytes of a token and its space, about, for the size of a block.
_TOKEN_BYTES = 6


def packed(numbers: np.ndarray, width: int = 4) -> bytes:
    """Numbers of at most ``width`` bytes, byte plane by byte plane, compressed."""
    planes = numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(given: bytes, count: int, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(given, width * count, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def ranked(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes by falling frequency, and the old code of each new one."""
    order = np.argsort(-np.bincount(codes, minlength=size), kind="stable")
    place = np.empty(size, np.int64)
    place[order] = np.arange(size)
    return place[codes], order


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list for each two neighbouring offsets."""
    whole = pa.list_(pa.field("element", kind))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind), type=whole)


def single(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return lists(values, np.array([0, len(values)]), kind)


def flat(column: pa.ChunkedArray) -> np.ndarray:
    """The elements of all lists of a column."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def dealt(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of sorted buckets, and the offsets of their runs."""
    starts = np.flatnonzero(np.diff(buckets, prepend=-1))
    return buckets[starts], np.append(starts, len(buckets))


def bucket_of(numbers: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(numbers.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def text_blocks(documents: DataFrame, settings: Settings) -> DataFrame:
    """Texts as numbers in a list of the words of their block; a row for each block.

    ``documents`` has ``doc_id, held_out, text`` (bytes). Blocks are made where the rows are read, of
    neighbouring rows whatever their ids.
    """
    most = _TOKEN_BYTES * settings.block_tokens

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for part in (part for whole in batches for part in in_parts(whole, "text", max(1, most // 8))):
            held.append(part)
            size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            size += part.num_rows
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, rows in enumerate(gathered(batches)):
            if not rows.num_rows:
                continue
            codes, owner, distinct = split_texts(rows["text"].combine_chunks())
            codes, order = ranked(codes, len(distinct))
            distinct = [distinct[i] for i in order]
            every = pa.array([0, rows.num_rows], pa.int32())
            ids, out = (rows[c].combine_chunks() for c in ("doc_id", "held_out"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([first + number], pa.int64()),
                    pa.ListArray.from_arrays(every, ids, type=pa.list_(pa.field("element", pa.int64()))),
                    pa.ListArray.from_arrays(every, out, type=pa.list_(pa.field("element", pa.bool_()))),
                    single(np.bincount(owner, minlength=rows.num_rows), pa.int32()),
                    pa.array([packed(codes)], pa.binary()),
                    single(np.array([word_key(w) for w in distinct], np.int64), pa.int64()),
                    single(np.array([form(w, settings) for w in distinct], np.int32), pa.int32()),
                ],
                names=["block", "doc_id", "held_out", "sizes", "codes", "keys", "forms"],
            )

    return documents.select("doc_id", "held_out", "text").mapInArrow(run, _TEXTS)


def word_order(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a block sends its words, and the bucket of each then."""
    made = bucket_of(keys, buckets)
    order = np.argsort(made, kind="stable")
    return order, made[order]


def ask_words(blocks: DataFrame, buckets: int) -> DataFrame:
    """The words of each block, with how often its training texts have them, for each bucket of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                keys, forms, sizes = (flat(row[c]) for c in ("keys", "forms", "sizes"))
                learned = np.repeat(~flat(row["held_out"]).astype(bool), sizes)
                codes = unpacked(row["codes"][0].as_py(), len(learned))
                counts = np.bincount(codes[learned], minlength=len(keys))
                order, made = word_order(keys, buckets)
                targets, offsets = dealt(made)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(targets),
                        pa.array(np.full(len(targets), row["block"][0].as_py(), np.int64)),
                        lists(keys[order], offsets, pa.int64()),
                        lists(forms[order], offsets, pa.int32()),
                        lists(counts[order], offsets, pa.int32()),
                    ],
                    names=["bucket", "block", "keys", "forms", "n"],
                )

    return blocks.select("block", "held_out", "sizes", "codes", "keys", "forms").mapInArrow(run, _WORDS)


def count_words(asked: DataFrame, buckets: int, settings: Settings) -> DataFrame:
    """What blocks get back for their words, and a row without a block with the sums of each bucket.

    ``symbols`` : the number of a frequent word, or the form of another. ``n`` : how often the
    training texts have the word. In the rows of sums ``n`` has tokens, distinct words and
    frequent ones, ``form_n`` and ``form_words`` the tokens and words of each form.
    """

    def run(rows: pa.Table) -> pa.Table:
        keys, forms, counts = (flat(rows[c]) for c in ("keys", "forms", "n"))
        bucket = rows["bucket"][0].as_py()
        listed, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        n = np.bincount(inverse, counts, minlength=len(listed)).astype(np.int64)
        often, symbols = n >= settings.least_count, forms[first].astype(np.int64)
        rare = ~often & (n > 0)
        by_form = [np.bincount(symbols[rare], w, minlength=settings.forms) for w in (n[rare], None)]
        symbols[often] = settings.forms + bucket + buckets * np.arange(often.sum())
        sums = np.array([n.sum(), (n > 0).sum(), often.sum()])
        offsets = rows["keys"].combine_chunks().offsets.to_numpy()
        offsets = offsets - offsets[0]
        lists_of = pa.list_(pa.field("element", pa.int64()))
        blanks = pa.nulls(rows.num_rows, lists_of)
        answers = [
            rows["block"].combine_chunks(),
            rows["bucket"].combine_chunks(),
            lists(symbols[inverse], offsets, pa.int64()),
            lists(n[inverse], offsets, pa.int64()),
            blanks,
            blanks,
        ]
        totals = [
            pa.nulls(1, pa.int64()),
            pa.array([bucket], pa.int64()),
            pa.nulls(1, lists_of),
            single(sums, pa.int64()),
            *(single(x.astype(np.int64), pa.int64()) for x in by_form),
        ]
        names = ["block", "bucket", "symbols", "n", "form_n", "form_words"]
        return pa.concat_tables([pa.table(answers, names=names), pa.table(totals, names=names)])

    return asked.groupBy("bucket").applyInArrow(run, _COUNTS)


def read_totals(counts: DataFrame, settings: Settings) -> Totals:
    """Sums over the buckets; gathers one row for each form."""
    sums = counts.where("block IS NULL")
    tokens, distinct, often = sums.agg(*(F.sum(F.col("n")[i]) for i in range(3))).first()
    forms = sums.select(F.posexplode(F.arrays_zip("form_n", "form_words")).alias("form", "sums"))
    by_form = forms.groupBy("form").agg(F.sum("sums.form_n").alias("n"), F.sum("sums.form_words").alias("words"))
    form_n, form_words = np.zeros(settings.forms, np.int64), np.zeros(settings.forms, np.int64)
    for row in by_form.collect():
        form_n[row.form], form_words[row.form] = row.n, row.words
    return Totals(tokens or 0, distinct or 0, (often or 0) + settings.forms, form_n, form_words, settings)


def coded(blocks: DataFrame, counts: DataFrame, buckets: int, totals: Totals) -> DataFrame:
    """Blocks with their words as symbols, and what single words tell of each text.

    ``codes`` are numbers in ``symbols``, of which the training texts have ``n``. ``score`` is what is settled of
    the scores: at first the shares of words in their forms. From level 2 on ``going_on`` has a bit for each
    place that a context of that level comes before; ``p`` (numbers in ``values``) and ``parts`` are of those.
    """
    shared = share(blocks.sparkSession, totals)  # bounded by the settings

    def run(rows: pa.Table, given: pa.Table) -> pa.Table:
        totals = opened(shared)
        settings = totals.settings
        sizes, keys, forms = (flat(rows[c]) for c in ("sizes", "keys", "forms"))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        codes = unpacked(rows["codes"][0].as_py(), len(owner))
        given = given.sort_by("bucket")
        order, _ = word_order(keys, buckets)
        symbols, known = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        symbols[order], known[order] = flat(given["symbols"]), flat(given["n"])
        base = np.log10((known + 0.5) / (totals.tokens + 0.5 * (totals.words + 1)))
        rare = symbols < settings.forms
        total = totals.form_counts[forms[rare]] + 0.5 * (totals.form_words[forms[rare]] + 1)
        part, often = np.zeros(len(keys)), known.copy()
        part[rare] = np.log10((known[rare] + 0.5) / total)
        often[rare] = totals.form_counts[forms[rare]]

        def summed(values: np.ndarray) -> np.ndarray:
            return np.bincount(owner, values[codes], minlength=len(sizes))

        listed, first, inverse = np.unique(symbols, return_index=True, return_inverse=True)
        new, by_rank = ranked(inverse[codes], len(listed))
        return pa.table(
            {
                "block": rows["block"],
                "level": pa.array([1], pa.int32()),
                "doc_id": rows["doc_id"],
                "held_out": rows["held_out"],
                "sizes": rows["sizes"],
                "n_known": single(summed(known > 0).astype(np.int64), pa.int64()),
                "base_score": single(summed(base), pa.float64()),
                "score": single(summed(part), pa.float64()),
                "codes": pa.array([packed(new)], pa.binary()),
                "symbols": single(listed[by_rank], pa.int64()),
                "n": single(often[first][by_rank], pa.int64()),
                "going_on": pa.nulls(1, pa.binary()),
                "values": pa.nulls(1, pa.list_(pa.field("element", pa.float32()))),
                "p": pa.nulls(1, pa.binary()),
                "parts": pa.nulls(1, pa.binary()),
            }
        )

    answers = counts.where("block IS NOT NULL").select("block", "bucket", "symbols", "n")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _CODED)


def windows_at(listed: np.ndarray, codes: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """A number for the ``length`` symbols before each place."""
    made = listed[codes[places - length]].view(np.uint64)
    with np.errstate(over="ignore"):
        for back in range(length - 1, 0, -1):
            given = listed[codes[places - back]].view(np.uint64)
            made = mixed(mixed(made + np.uint64(length - back + 1)) * _ODD + given)
    return made.view(np.int64)


def parts_of(n: np.ndarray, settings: Settings) -> np.ndarray:
    """Into how many parts what follows a context is dealt; none if it is too rare to be one."""
    return np.where(n < settings.least_count, 0, -(-n // settings.part_tokens))


@dataclass
class Sent:
    """The distinct pairs of a block in the order in which they are sent; ``rank`` is that of each place.

    ``starts`` : where the next context or part of one begins.
    """

    places: np.ndarray
    rank: np.ndarray
    buckets: np.ndarray
    contexts: np.ndarray
    next: np.ndarray
    first: np.ndarray
    starts: np.ndarray

    def runs(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.buckets)))


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one of each distinct key, by rising keys, and the rank of every key among them."""
    size = len(keys)
    bits = size.bit_length()
    if keys.min(initial=0) >= 0 and int(keys.max(initial=0)) < 1 << (63 - bits):
        # One number for a key and its place: sorting them is much faster than sorting by the keys.
        made = np.sort(keys << bits | np.arange(size))
        in_order, order = made >> bits, made & ((1 << bits) - 1)
    else:
        order = np.argsort(keys)
        in_order = keys[order]
    new = np.ones(size, bool)
    new[1:] = in_order[1:] != in_order[:-1]
    rank = np.empty(size, np.int64)
    rank[order] = np.cumsum(new) - 1
    return order[new], rank


class Block:
    """The places of a block: for each the probability of its symbol by the levels so far, and into how many
    parts the context that ends there is dealt."""

    def __init__(self, row: pa.Table, totals: Totals, buckets: int):
        self.row, self.buckets, self.settings = row, buckets, totals.settings
        sizes, self.listed, n = (flat(row[c]) for c in ("sizes", "symbols", "n"))
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.learned = np.repeat(~flat(row["held_out"]).astype(bool), sizes)
        self.codes = unpacked(row["codes"][0].as_py(), len(self.owner))
        self.level = row["level"][0].as_py()
        if self.level == 1:
            self.p = ((n + 0.5) / (totals.tokens + 0.5 * totals.symbols))[self.codes]
            self.parts = parts_of(n, self.settings)[self.codes]
        else:
            going_on = np.unpackbits(np.frombuffer(row["going_on"][0].as_py(), np.uint8), count=len(self.owner))
            places = np.flatnonzero(going_on)
            self.p = np.ones(len(self.owner))
            self.p[places] = flat(row["values"])[unpacked(row["p"][0].as_py(), len(places))]
            self.parts = np.zeros(len(self.owner), np.int64)
            self.parts[places - 1] = unpacked(row["parts"][0].as_py(), len(places))

    def follows(self) -> np.ndarray:
        """The places that a context of this level comes before."""
        places = self.level + np.flatnonzero(self.parts[self.level - 1 : -1] > 0)
        return places[self.owner[places] == self.owner[places - self.level]]

    def sent(self, least_parts: int = 1) -> Sent:
        """Pairs of a context and the next symbol, by bucket and context.

        A bucket has all that follows a context, or one part of it by the next symbol.
        """
        places = self.follows()
        if least_parts > 1:
            places = places[self.parts[places - 1] >= least_parts]
        # The contexts by numbers of their own in the block, before the pairs.
        size, numbers = len(self.listed), self.codes[places - self.level]
        one_of = None
        for back in range(self.level - 1, 0, -1):
            one_of, numbers = grouped(numbers * size + self.codes[places - back])
        if one_of is None:
            one_of, numbers = grouped(numbers)
        first, rank = grouped(numbers * size + self.codes[places])
        of_context, first = numbers[first], places[first]
        contexts = windows_at(self.listed, self.codes, places[one_of], self.level)
        parts, following = self.parts[first - 1], self.listed[self.codes[first]]
        salt = np.where(parts > 1, following % np.maximum(parts, 1), 0)
        with np.errstate(over="ignore"):
            salted = mixed(contexts.view(np.uint64))[of_context] + salt.view(np.uint64)
        made = bucket_of(salted.view(np.int64), self.buckets)
        # Small numbers are sorted by their digits.
        order = np.argsort(made.astype(np.uint16) if self.buckets < 1 << 16 else made, kind="stable")
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        made, contexts = made[order], contexts[of_context[order]]
        changes = (np.diff(contexts, prepend=0) != 0) | (np.diff(made, prepend=-1) != 0)
        changes[:1] = True
        starts = np.flatnonzero(changes)
        return Sent(places, at[rank], made, contexts, following[order], first[order], starts)

    def asked(self, sent: Sent, wide: bool) -> pa.RecordBatch:
        """A row for each bucket that pairs go to."""
        size = len(sent.buckets)
        n = np.bincount(sent.rank, self.learned[sent.places], minlength=size)
        targets, offsets = dealt(sent.buckets)
        of_runs = np.searchsorted(sent.starts, offsets)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(targets, pa.int64()),
                pa.array(np.full(len(targets), self.row["block"][0].as_py(), np.int64)),
                lists(sent.contexts[sent.starts], of_runs, pa.int64()),
                lists(sent.runs(), of_runs, pa.int32()),
                lists(sent.next, offsets, pa.int64() if wide else pa.int32()),
                lists(n.astype(np.int32), offsets, pa.int32()),
                lists(self.p[sent.first].astype(np.float32), offsets, pa.float32()),
            ],
            names=["bucket", "block", "contexts", "runs", "next", "n", "q"],
        )

    def go_on(self, given: pa.Table) -> pa.Table:
        """The row of the block for the next level, by the answers to what was sent.

        It adds to the scores what is settled: all places that no context of the next level comes before.
        """
        sent = self.sent()
        given = given.sort_by("bucket")
        _, offsets = dealt(sent.buckets)
        n = np.empty(len(sent.buckets), np.int64)
        for i, counts in enumerate(given["n"]):
            n[offsets[i] : offsets[i + 1]] = unpacked(counts.as_py(), offsets[i + 1] - offsets[i], 8)
        seen, total = (np.repeat(flat(given[c]), sent.runs()) for c in ("seen", "total"))
        q = self.p[sent.first]
        p = np.where(seen > 0, (n + seen * q) / np.maximum(total + seen, 1), q)
        self.p[sent.places] = p[sent.rank]
        self.parts = np.zeros(len(self.owner), np.int64)
        self.parts[sent.places] = parts_of(n, self.settings)[sent.rank]
        self.level += 1
        places = self.follows() if self.level <= self.settings.depth else np.empty(0, np.int64)
        going_on = np.zeros(len(self.owner), bool)
        going_on[places] = True
        rows = len(self.row["sizes"][0])
        done = np.bincount(self.owner, np.where(going_on, 0.0, np.log10(self.p)), minlength=rows)
        p = self.p[places].astype(np.float32)
        one_of, codes = grouped(p.view(np.int32).astype(np.int64))
        codes, order = ranked(codes, len(one_of))
        kept = {
            "level": pa.array([self.level], pa.int32()),
            "score": single(flat(self.row["score"]) + done, pa.float64()),
            "going_on": pa.array([np.packbits(going_on).tobytes()], pa.binary()),
            "values": single(p[one_of][order], pa.float32()),
            "p": pa.array([packed(codes)], pa.binary()),
            "parts": pa.array([packed(self.parts[places - 1])], pa.binary()),
        }
        if self.level > self.settings.depth:
            kept["codes"] = pa.array([b""], pa.binary())
        return pa.table({c: kept.get(c, self.row[c]) for c in self.row.column_names})


def opened_blocks(
    batches: Iterator[pa.RecordBatch], totals: Totals, buckets: int
) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(pa.Table.from_batches([batch.slice(i, 1)]), totals, buckets)


def ask_pairs(blocks: DataFrame, totals: Totals, buckets: int, least_parts: int = 1) -> DataFrame:
    """The pairs of all blocks, for the buckets of their contexts."""
    shared = share(blocks.sparkSession, totals)  # bounded by the settings
    wide = totals.settings.forms + 4 * totals.symbols + buckets >= 1 << 31

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in opened_blocks(batches, opened(shared), buckets):
            yield block.asked(block.sent(least_parts), wide)

    return blocks.mapInArrow(run, _PAIRS.format("array<long>" if wide else "array<int>"))


def next_blocks(blocks: DataFrame, answers: DataFrame, totals: Totals, buckets: int) -> DataFrame:
    """The blocks after the answers to what they asked."""
    shared = share(blocks.sparkSession, totals)  # bounded by the settings

    def run(row: pa.Table, given: pa.Table) -> pa.Table:
        return Block(row, opened(shared), buckets).go_on(given)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _CODED)


@dataclass
class Merged:
    """The distinct pairs of a bucket by context: their counts and probabilities by the suffix of the context."""

    contexts: np.ndarray
    of_context: np.ndarray
    n: np.ndarray
    q: np.ndarray
    inverse: np.ndarray


def merged(rows: pa.Table) -> Merged:
    sent, runs = flat(rows["contexts"]), flat(rows["runs"])
    following, n, q = (flat(rows[c]) for c in ("next", "n", "q"))
    one_of, numbers = grouped(sent)
    size = int(following.max(initial=0)) + 1
    first, inverse = grouped(np.repeat(numbers, runs) * size + following)
    n = np.bincount(inverse, n, minlength=len(first)).astype(np.int64)
    of_context = np.repeat(numbers, runs)[first]
    return Merged(sent[one_of], of_context, n, q[first].astype(np.float64), inverse)


def part_sums(asked: DataFrame) -> DataFrame:
    """``bucket, context, total, seen, n, q`` : a row for each part of a context."""

    def run(rows: pa.Table) -> pa.Table:
        made = merged(rows)
        size = len(made.contexts)
        order = np.argsort(made.of_context, kind="stable")
        offsets = np.searchsorted(made.of_context[order], np.arange(size + 1))
        total = np.bincount(made.of_context, made.n, minlength=size).astype(np.int64)
        return pa.table(
            {
                "bucket": pa.array(np.full(size, rows["bucket"][0].as_py(), np.int64)),
                "context": pa.array(made.contexts),
                "total": pa.array(total),
                "seen": pa.array(np.bincount(made.of_context, made.n > 0, minlength=size).astype(np.int64)),
                "n": lists(made.n[order], offsets, pa.int64()),
                "q": lists(made.q[order].astype(np.float32), offsets, pa.float32()),
            }
        )

    return asked.groupBy("bucket").applyInArrow(run, _MERGED)


def verdicts(sums: DataFrame, settings: Settings) -> DataFrame:
    """For each part of a context what all its parts tell: ``total``, ``seen`` and whether it is kept."""
    whole = sums.groupBy("context").agg(F.sum("total").alias("total"), F.sum("seen").alias("seen"))
    total, seen = F.col("total"), F.col("seen")

    def gain(n: Column, q: Column) -> Column:
        q = q.cast("double")
        without = (n - 1 + seen * q) / F.greatest(total - 1 + seen, F.lit(1))
        return F.when(n > 0, n * F.log(without / q)).otherwise(0.0)

    parts = sums.select("context", "n", "q").join(whole, "context")
    added = F.aggregate(F.zip_with("n", "q", gain), F.lit(0.0), lambda a, b: a + b)
    gains_of = parts.select("context", "total", "seen", added.alias("gain"))
    kept = gains_of.groupBy("context").agg(
        F.first("total").alias("total"),
        F.first("seen").alias("seen"),
        (F.sum("gain") / F.first("total") >= settings.least_gain).alias("kept"),
    )
    return sums.select("bucket", "context").join(kept, "context").select("bucket", "context", "total", "seen", "kept")


def answer_pairs(asked: DataFrame, split: DataFrame, settings: Settings) -> DataFrame:
    """What blocks get back, in the order in which they asked.

    ``seen`` and ``total`` of each context, 0 if it is not kept, and how often there is each pair; ``most`` is the
    largest of these. ``split`` are the verdicts on contexts that are dealt into parts.
    """

    def run(rows: pa.Table, split: pa.Table) -> pa.Table:
        made = merged(rows)
        n, q, of_context, size = made.n, made.q, made.of_context, len(made.contexts)
        total = np.bincount(of_context, n, minlength=size)
        seen = np.bincount(of_context, n > 0, minlength=size).astype(np.float64)
        at = np.searchsorted(made.contexts, split["context"].to_numpy())
        total[at], seen[at] = split["total"].to_numpy(), split["seen"].to_numpy()
        behind = seen[of_context] * q
        without = (np.maximum(n - 1, 0) + behind) / np.maximum(total + seen - 1, 1)[of_context]
        ratios = np.where(n > 0, n * np.log(np.where(n > 0, without, q) / q), 0.0)
        gain = np.bincount(of_context, ratios, minlength=size) / np.maximum(total, 1)
        kept = (gain >= settings.least_gain) & (total > 0)
        kept[at] = split["kept"].to_numpy(zero_copy_only=False)
        # What each block asked for, by the contexts and pairs of the whole bucket.
        whole = {c: rows[c].combine_chunks() for c in ("contexts", "next")}
        offsets = {c: x.offsets.to_numpy() - x.offsets[0].as_py() for c, x in whole.items()}
        asked = np.searchsorted(made.contexts, flat(rows["contexts"]))
        each = n[made.inverse]
        of_row = list(zip(offsets["next"][:-1], offsets["next"][1:], strict=True))
        return pa.table(
            {
                "block": rows["block"],
                "bucket": rows["bucket"],
                "seen": lists(np.where(kept, seen, 0).astype(np.int64)[asked], offsets["contexts"], pa.int64()),
                "total": lists(np.where(kept, total, 0).astype(np.int64)[asked], offsets["contexts"], pa.int64()),
                "n": pa.array([packed(each[a:b], 8) for a, b in of_row], pa.binary()),
                "most": pa.array([each[a:b].max() for a, b in of_row], pa.int64()),
            }
        )

    return asked.groupBy("bucket").cogroup(split.groupBy("bucket")).applyInArrow(run, _ANSWERS)


def scores_of(blocks: DataFrame, totals: Totals, buckets: int) -> DataFrame:
    """A row for each document, of blocks with or without places that are not settled."""
    shared = share(blocks.sparkSession, totals)  # bounded by the settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = opened(shared)
        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                score = flat(row["score"])
                if row["level"][0].as_py() == 1:
                    block = Block(row, totals, buckets)
                    score = score + np.bincount(block.owner, np.log10(block.p), minlength=len(score))
                ids, out, sizes, known, base = (
                    row[c].combine_chunks().flatten()
                    for c in ("doc_id", "held_out", "sizes", "n_known", "base_score")
                )
                tokens = pa.array(np.full(len(score), totals.tokens, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids, out, sizes.cast(pa.int64()), known, base, pa.array(score), tokens],
                    names=[c.split()[0] for c in _SCORES.split(", ")],
                )

    return blocks.mapInArrow(run, _SCORES)


def scores(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each document: its log10 probability by the tree and by single words.

    Learns from the documents that are not held out. A null text is an empty one: its one
    token is the end. Repeated rows are learned from and scored as often as they are there. Without
    any document to learn from every word counts as unknown. Other columns are not looked at.
    """
    spark = documents.sparkSession
    rows = documents.select(
        F.col("doc_id").cast("long"),
        held_out().alias("held_out"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )

    def step(rows: DataFrame, name: str) -> DataFrame:
        # Shuffled files that nothing refers to go when the driver collects its garbage.
        spark._jvm.System.gc()
        return scratch.keep(rows, name)

    with Scratch(spark) as scratch:
        texts = step(text_blocks(rows, settings), "texts")
        size = texts.select(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
        buckets = max(1, math.ceil((size.agg(F.sum("n")).first()[0] or 0) / settings.block_tokens))
        counts = step(count_words(ask_words(texts, buckets), buckets, settings), "counts")
        totals = read_totals(counts, settings)
        blocks = step(coded(texts, counts, buckets, totals), "blocks-1")
        scratch.drop("texts")
        scratch.drop("counts")
        n = F.array_max(F.when(F.size("n") > 0, F.col("n")))
        most = blocks.agg(F.max(n)).first()[0] or 0
        for level in range(1, settings.depth + 1 if totals.tokens else 1):
            split = spark.createDataFrame([], _VERDICTS)
            if most > settings.part_tokens:
                sums = step(part_sums(ask_pairs(blocks, totals, buckets, least_parts=2)), f"sums-{level}")
                split = step(verdicts(sums, settings), f"split-{level}")
                scratch.drop(f"sums-{level}")
            asked = ask_pairs(blocks, totals, buckets)
            answers = step(answer_pairs(asked, split, settings), f"answers-{level}")
            most = answers.agg(F.max("most")).first()[0] or 0
            blocks = step(next_blocks(blocks, answers, totals, buckets), f"blocks-{level + 1}")
            scratch.drop(f"answers-{level}")
            scratch.drop(f"blocks-{level}")
        return settled(scores_of(blocks, totals, buckets))
