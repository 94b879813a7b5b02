"""A quality classifier: averaged vectors of words and character n-grams, and a softmax.

Every word and every n-gram of its characters (the word between ``<`` and ``>``) has a
learned vector in a table of hashed rows, and so have all pairs of a word and itself together; a
document is the mean of its vectors, padded with zeros if it is short, and a softmax over the
classes is trained on it by stochastic gradient descent in numpy. After training a feature counts
only through its projection on the difference of the two classes, so what is shipped to score
a corpus is one number for each row of the table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.llm.common import in_parts, opened, set_aside, share

#: Distinct words a task remembers at most: memory only, never the result.
REMEMBERED = 300_000

#: Bytes of words whose n-grams are hashed at once: memory only, never the result.
PIECE = 1 << 16


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the labelled rows that are learned from, taken by a hash of their id.

    ``least`` : features of a document at least; a text of few words tells little.
    """

    rows: int = 1 << 16
    width: int = 8
    shortest: int = 3
    longest: int = 4
    epochs: int = 8
    rate: float = 1.0
    least: int = 60
    max_rows: int = 6000
    threshold: float = 0.3
    seed: int = 1


def features(word: bytes, settings: Settings) -> list[int]:
    """Rows of a word and of its character n-grams."""
    marked = "<" + word.decode("utf-8", "replace") + ">"
    found = [marked]
    for size in range(settings.shortest, settings.longest + 1):
        found += [marked[i : i + size] for i in range(len(marked) - size + 1)]
    return [zlib.crc32(f.encode("utf-8", "replace")) % settings.rows for f in found]


def twice(settings: Settings) -> int:
    """The row of a word that follows itself; no n-gram has white space in it."""
    return zlib.crc32(b"< >") % settings.rows


def _crc_table() -> np.ndarray:
    """What a CRC-32 turns to by one byte, see :func:`_fed`."""
    values = np.arange(256)
    for _ in range(8):
        values = (values >> 1) ^ (values & 1) * 0xEDB88320
    return values


CRC_TABLE = _crc_table()


def _fed(crcs: np.ndarray, octets: np.ndarray) -> np.ndarray:
    """Unfinished (inverted) CRC-32s, each fed one more byte."""
    return CRC_TABLE[(crcs ^ octets) & 0xFF] ^ (crcs >> 8)


def word_sums(
    words: list[bytes], weights: np.ndarray, settings: Settings
) -> tuple[np.ndarray, np.ndarray]:
    """For each word the sum of ``weights`` (integers) over its :func:`features`, and their number.

    All words are hashed together: n-grams that start at one character grow by a character at a time.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = b"<" + b"><".join(words) + b">"
    try:
        joined.decode()
    except UnicodeDecodeError:
        words = [w.decode("utf-8", "replace").encode() for w in words]
        joined = b"<" + b"><".join(words) + b">"
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)
    starts = np.concatenate([[0], stops[:-1]])
    opening = zlib.crc32(b"<")
    whole = np.fromiter((zlib.crc32(w, opening) for w in words), np.int64, len(words))
    whole = _fed(whole ^ 0xFFFFFFFF, ord(">")) ^ 0xFFFFFFFF
    sums, counts = weights[whole % settings.rows], np.ones(len(words), np.int64)
    beyond = 4 * settings.longest  # bytes that the n-grams of a piece reach into the next at most
    octets = np.frombuffer(joined + bytes(beyond), np.uint8)
    for begin in range(0, len(joined), PIECE):
        end = min(begin + PIECE, len(joined))
        piece = octets[begin : end + beyond]
        at = np.flatnonzero((piece & 0xC0) != 0x80)  # characters
        sizes = np.diff(at)
        n = int(np.searchsorted(at, end - begin))
        if not n:
            continue
        first, last = np.searchsorted(stops, [begin, end - 1], side="right")
        held = slice(first, last + 1)
        edges = np.searchsorted(at[:n], np.maximum(starts[held] - begin, 0))
        limits = np.repeat(stops[held] - begin, np.diff(edges, append=n))
        crcs = np.full(n, 0xFFFFFFFF)
        found, number = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for size in range(1, settings.longest + 1):
            here, wide = at[size - 1 : size - 1 + n], sizes[size - 1 : size - 1 + n]
            crcs = _fed(crcs, piece[here])
            for k in range(1, 4):
                longer = np.flatnonzero(wide > k)
                if not len(longer):
                    break
                crcs[longer] = _fed(crcs[longer], piece[here[longer] + k])
            if size >= settings.shortest:
                inside = at[size : size + n] <= limits
                found[1:] += weights[(crcs ^ 0xFFFFFFFF) % settings.rows] * inside
                number[1:] += inside
        np.cumsum(found, out=found)
        np.cumsum(number, out=number)
        until = np.append(edges[1:], n)
        sums[held] += found[until] - found[edges]
        counts[held] += number[until] - number[edges]
    return sums, counts


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of all texts as places in the list of distinct ones, and where each text ends."""
    listed: list[bytes] = []
    ends = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        listed += (text.as_py() or b"").split()
        ends[i + 1] = len(listed)
    coded = pa.array(listed, pa.binary()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), ends, coded.dictionary.to_pylist()


def repeats(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many words of each text follow an equal one."""
    same = np.zeros(len(codes) + 1, np.int64)
    if len(codes):
        equal = codes[1:] == codes[:-1]
        first = ends[1:-1]  # the first word of a text follows none
        equal[first[(first > 0) & (first < len(codes))] - 1] = False
        np.cumsum(equal, out=same[2:])
    return same[ends[1:]] - same[ends[:-1]]


@dataclass
class Model:
    """A trained classifier: ``weights`` of all rows and a ``bias``, for the log of the odds."""

    weights: np.ndarray
    bias: float
    settings: Settings

    def scorer(self) -> Callable[[pa.Array], np.ndarray]:
        """A function from texts (as bytes) to probabilities of class 1."""
        # Whole numbers, whose sum has no order; that of a text of 2 GB, the longest, fits 63 bits.
        sizes = self.settings.longest - self.settings.shortest + 1
        one = 2.0 ** (31 - math.frexp(float(np.abs(self.weights).max()) * (sizes + 2))[1])
        weights = np.rint(self.weights.astype(np.float64) * one).astype(np.int64)

        def score(texts: pa.Array) -> np.ndarray:
            codes, ends, distinct = _tokens(texts)
            sums = np.zeros(len(codes) + 1, np.int64)
            counts = np.zeros(len(codes) + 1, np.int64)
            of_words, numbers = word_sums(distinct, weights, self.settings)
            np.cumsum(of_words[codes], out=sums[1:])
            np.cumsum(numbers[codes], out=counts[1:])
            total = sums[ends[1:]] - sums[ends[:-1]]
            number = counts[ends[1:]] - counts[ends[:-1]]
            same = repeats(codes, ends)
            total += same * weights[twice(self.settings)]
            odds = total / one / np.maximum(number + same, self.settings.least) + self.bias
            return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

        return score


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], settings: Settings) -> Model:
    """Fit on (rows, shares, label) of documents; the shares of a document sum to 1 at most.

    Without examples every score is 0.5; with one class alone, near that class's.
    """
    rng = np.random.default_rng(settings.seed)
    table = rng.uniform(-1, 1, (settings.rows, settings.width)) / settings.width
    output, bias = np.zeros((2, settings.width)), np.zeros(2)
    steps, done = settings.epochs * len(examples), 0
    for _ in range(settings.epochs):
        for place in rng.permutation(len(examples)):
            rows, shares, label = examples[place]
            rate = settings.rate * (1 - done / steps)
            done += 1
            mean = shares @ table[rows]
            scores = output @ mean + bias
            odds = np.exp(scores - scores.max())
            error = odds / odds.sum()
            error[label] -= 1
            back = error @ output
            output -= rate * np.outer(error, mean)
            bias -= rate * error
            table[rows] -= (rate * shares)[:, None] * back
    weights = (table @ (output[1] - output[0])).astype(np.float32)
    return Model(weights, float(bias[1] - bias[0]), settings)


def labelled_sample(documents: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """``text, label`` of at most ``max_rows`` labelled documents outside the held-out fifth.

    A document with differing labels counts by the largest; one that is there twice is used
    once. The sample goes by a hash of the id, so it does not depend on the order of rows.
    """
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(settings.seed)), "doc_id")
        .limit(settings.max_rows)
    )
    found = documents.select("doc_id", F.col("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Train on the labelled sample; its features are made by Spark and gathered, no texts."""
    sample = labelled_sample(documents, labels, settings)
    coded = sample.select("doc_id", "label", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            ids, marks, texts = batch.columns
            rows, shares = [], []
            for text in texts:
                every: list[int] = []
                words = (text.as_py() or b"").split()
                again = sum(a == b for a, b in zip(words, words[1:], strict=False))
                for word in words:
                    if word not in known:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[word] = features(word, settings)
                    every += known[word]
                every += [twice(settings)] * again
                distinct, counts = np.unique(np.array(every, np.int32), return_counts=True)
                rows.append(distinct)
                shares.append((counts / max(len(every), settings.least)).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [ids, marks, pa.array(rows, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
                names=["doc_id", "label", "rows", "shares"],
            )

    made = coded.mapInArrow(run, "doc_id long, label int, rows array<int>, shares array<float>")
    gathered = made.toArrow().sort_by("doc_id")
    examples = [
        (rows.values.to_numpy(), shares.values.to_numpy().astype(np.float64), label.as_py())
        for rows, shares, label in zip(
            gathered["rows"], gathered["shares"], gathered["label"], strict=True
        )
    ]
    return train(examples, settings)


def score(documents: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """Add ``score``, the probability of class 1, and ``predicted``; all rows stay.

    Only the text is looked at, the whole of it. A text that is null or has no words gets the
    score of the bias alone. Columns of these names are replaced.
    """
    rows = documents.drop("score", "predicted").withColumn("score", F.col(text).cast("binary"))
    rows, columns = set_aside(rows, ("score",))
    names = [c for c in rows.columns if c != "score"]
    shared = share(documents.sparkSession, model)  # of a fixed size
    schema = rows.drop("score").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = opened(shared).scorer()
        for batch in (part for whole in batches for part in in_parts(whole, "score")):
            found = rate(batch.column(batch.schema.get_field_index("score")))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found)], names=[*names, "score"])

    made = rows.mapInArrow(run, schema).select(*columns)
    return made.withColumn("predicted", (F.col("score") >= model.settings.threshold).cast("int"))


def scores(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each document, by a model that the labels outside the held-out fifth train."""
    model = fit(documents, labels, settings)
    narrow = documents.select("doc_id", held_out().alias("held_out"), "text")
    return score(narrow, model).drop("text")
