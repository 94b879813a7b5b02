"""Grouping of spelling variants: words one edit apart, found by k-d trees over letter counts.

One replaced code point takes one count down and another up, one more code point takes one count up, so
the counts of two near words are at most two apart, letter by letter added up. Words of one length are a point set.
It is cut by counts of single letters, first into cells that are worked on apart, then in each cell into a tree; a
word looks into the boxes that its ball of one or two reaches, in its own length and the one above, and what
it finds there is held against it letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.llm.common import Scratch, in_parts, opened, settled, share

_RUNS = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@dataclass(frozen=True)
class Settings:
    """Of a word: its least length in code points and least count. ``ratio``: how many times as often its form is there.

    ``cell`` is the bytes of words that are worked on together, ``leaf`` the words of a leaf of the tree,
    ``held`` the distinct words that a task counts before it hands them on.
    """

    length: int = 6
    count: int = 5
    ratio: int = 5
    every: int = 199
    cell: int = 200_000
    leaf: int = 24
    held: int = 200_000


def occurrences(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``word, n``: the words of all texts, damaged by the checksum of ``doc_id:word``, counted in part.

    Where 199 divides the checksum, the code point at the checksum modulo the length is taken out. A null id is written
    as nothing, a null text has no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in (part for whole in batches for part in in_parts(whole, "text")):
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = data.as_py().decode("utf-8", "replace")
                head = f"{'' if doc_id is None else doc_id}:".encode()
                start = zlib.crc32(head)
                found = Counter(_RUNS.findall(text.translate(_LOWER)))
                for word, n in found.items():
                    h = zlib.crc32(word.encode(), start)
                    if h % settings.every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= settings.length:
                        counts[word] += n
                if len(counts) >= settings.held:
                    yield _counted(counts)
                    counts = Counter()
        yield _counted(counts)

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    return documents.select("doc_id", text).mapInArrow(run, "word string, n long")


def _counted(counts: Counter[str]) -> pa.RecordBatch:
    columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["word", "n"])


def word_counts(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``word, n`` of all words that are there often enough."""
    counted = occurrences(documents, settings).groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= settings.count)


# ------------------------------------------------------------------ cells


#: By word length, the letters and counts that cut it into cells: bit i of a cell's number tells whether the count of
#: the i-th letter is above the i-th number.
Cuts = dict[int, list[tuple[int, int]]]


def _codes(words: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of code points, none of which is above 255."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def _cells(codes: np.ndarray, cuts: list[tuple[int, int]], step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words and the cells, cut so, that near words may be in which are longer by ``step``, 0 or 1.

    First of all each word with the cell of its own counts.
    """
    number = np.zeros(len(codes), np.int64)
    ups, downs = [], []
    for i, (letter, most) in enumerate(cuts):
        counts = (codes == letter).sum(1)
        number += (counts > most).astype(np.int64) << i
        ups.append((1 << i, counts == most))
        # A letter less only where another takes its place.
        downs.append((1 << i, (counts == most + 1) & (step == 0)))
    everywhere = np.arange(len(codes))
    yield everywhere, number
    for up, across in ups:
        yield everywhere[across], number[across] + up
    for down, back in downs:
        yield everywhere[back], number[back] - down
        for up, across in ups:
            both = across & back
            yield everywhere[both], number[both] + up - down


def choose_cuts(words: DataFrame, settings: Settings) -> Cuts:
    """Cuts for lengths whose words do not fit one cell, by exact counts of words with so many of a letter.

    What comes to the driver has a row for each such length, letter and small count, however many words there are: lengths
    that fit one cell, as all long ones do, have none.
    """
    size = F.length("word")
    sizes = words.groupBy(size.alias("length")).agg(F.count(F.lit(1)).alias("words"))
    large = sizes.where(F.col("words") * F.col("length") > settings.cell)
    total = {r.length: r.words for r in large.collect()}
    having: dict[int, Counter] = {length: Counter() for length in total}
    if not total:
        return {}
    letters = words.withColumn("length", size).where(F.col("length").isin(*total))
    letters = letters.select("length", "word", F.explode(F.array_distinct(F.split("word", ""))).alias("letter"))
    times = F.length("word") - F.length(F.replace("word", F.col("letter"), F.lit("")))
    counted = letters.where("letter <> ''").select("length", "letter", F.least(times, F.lit(3)).alias("times"))
    for row in counted.groupBy("length", "letter", "times").agg(F.count(F.lit(1)).alias("words")).collect():
        for most in range(row.times):
            having[row.length][ord(row.letter), most] += row.words
    cuts = {}
    for length, n in total.items():
        wanted = int(np.ceil(np.log2(n * length / settings.cell))) + 1
        even = sorted(having[length].items(), key=lambda item: (abs(2 * item[1] - n), item[0]))
        cuts[length] = [cut for cut, _ in even[:wanted]]
    return cuts


def placed(words: DataFrame, cuts: Cuts) -> DataFrame:
    """Each word once in its own cell, and as a question in every cell where near words of its length or one more may be.

    ``word, n``, the ``length`` and number ``cell`` of the cell, and ``asks``.
    """
    shared = share(words.sparkSession, cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = opened(shared)
        for batch in batches:
            given, counts = batch.column(0).to_pylist(), batch.column(1)
            sizes = np.fromiter(map(len, given), np.int32, len(given))
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                codes = _codes([given[i] for i in at], size)
                found = []
                for step in (0, 1):
                    for turn, (places, cells) in enumerate(_cells(codes, cuts.get(size + step, []), step)):
                        asked = [(size + step, True, places, cells)]
                        found += [(size, False, places, cells), *asked] if not turn and not step else asked
                for length, asks, places, cells in found:
                    rows, n = pa.array(at[places]), len(places)
                    columns = [batch.column(0).take(rows), counts.take(rows)]
                    columns += [pa.array(np.full(n, length, np.int32)), pa.array(cells), pa.array(np.full(n, asks))]
                    yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "length", "cell", "asks"])

    return words.mapInArrow(run, "word string, n long, length int, cell long, asks boolean")


def in_blocks(rows: DataFrame, settings: Settings) -> DataFrame:
    """Cells dealt into blocks of a bounded size, by which to group: ``length, cell, block, part``.

    The words of a cell go to blocks and its questions to parts by a hash; each part meets each block once.
    """
    size = F.col("length").cast("long")
    sizes = rows.groupBy("length", "cell").agg(
        F.ceil(F.sum(F.when(F.col("asks"), 0).otherwise(size)) / (2 * settings.cell)).alias("blocks"),
        F.ceil(F.sum(F.when(F.col("asks"), size).otherwise(0)) / (8 * settings.cell)).alias("parts"),
    )
    # Cells without words of their own, or that no one asks in, have nothing to find.
    dealt = rows.join(sizes.where("blocks > 0 AND parts > 0"), ["length", "cell"])
    place, asks = F.xxhash64("word"), F.col("asks")

    def share_of(column: str, one: bool) -> Column:
        last = F.col(column) - 1
        own = F.pmod(place, F.col(column))
        return F.explode(F.sequence(*[F.when(asks == F.lit(one), own).otherwise(x) for x in (F.lit(0), last)]))

    dealt = dealt.withColumn("block", share_of("blocks", False)).withColumn("part", share_of("parts", True))
    return dealt.select("word", "n", "length", "asks", "cell", "block", "part")


# ------------------------------------------------------------------ the tree of a cell


class _Tree:
    """A k-d tree over the letter counts of words of one length, made as far as questions reach."""

    def __init__(self, codes: np.ndarray, leaf: int):
        self._codes, self._leaf = codes, leaf
        self._letters = np.unique(codes)
        self._counts = self._of(codes)

    def _of(self, codes: np.ndarray) -> np.ndarray:
        if not len(self._letters):
            return np.zeros((len(codes), 0), np.int32)
        return np.stack([(codes == letter).sum(1, dtype=np.int32) for letter in self._letters], 1)

    def near(self, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of questions and of words that are one edit apart; questions are as long, or one letter shorter."""
        reach = 2 if asked.shape[1] == self._codes.shape[1] else 1
        counts = self._of(asked)
        # Letters that no word has are as far from every box as they are many.
        away = asked.shape[1] - counts.sum(1)
        everyone = np.flatnonzero(away <= reach)
        bounds = [(0, self._codes.shape[1])] * len(self._letters)
        stack = [(np.arange(len(self._codes)), everyone, away[everyone], bounds)]
        while stack:
            own, asking, far, bounds = stack.pop()
            if not len(asking):
                continue
            split = self._split(own) if len(own) > self._leaf else None
            if split is None:
                yield from self._compare(own, asking, asked)
                continue
            dim, most = split
            low, high = bounds[dim]
            count, above = counts[asking, dim], self._counts[own, dim] > most
            before = np.maximum(0, np.maximum(low - count, count - high))
            for side, (least, greatest) in ((~above, (low, most)), (above, (most + 1, high))):
                now = far - before + np.maximum(0, np.maximum(least - count, count - greatest))
                reached = now <= reach
                box = [*bounds[:dim], (least, greatest), *bounds[dim + 1 :]]
                stack.append((own[side], asking[reached], now[reached], box))

    def _split(self, own: np.ndarray) -> tuple[int, int] | None:
        """The letter and count that part words most evenly; none if all counts are the same."""
        counts = self._counts[own]
        best = None
        for most in range(3):
            above = (counts > most).sum(0)
            dim = int(np.abs(2 * above - len(own)).argmin())
            if 0 < above[dim] < len(own):
                off = abs(2 * int(above[dim]) - len(own))
                best = min(best or (off, dim, most), (off, dim, most))
        if best is None:
            spread = np.flatnonzero(counts.min(0) < counts.max(0))
            return (int(spread[0]), int(counts[:, spread[0]].min())) if len(spread) else None
        return best[1:]

    def _compare(self, own: np.ndarray, asking: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Letter by letter, so many at a time that little is held."""
        length, shorter = self._codes.shape[1], asked.shape[1]
        most = max(1, 4_000_000 // length)
        wide = max(1, min(len(own), most))
        for left in range(0, len(own), wide):
            words = self._codes[own[left : left + wide]][None]
            tall = max(1, most // wide)
            for top in range(0, len(asking), tall):
                rows = asked[asking[top : top + tall]][:, None]
                if shorter == length:
                    hits = (rows != words).sum(2) == 1
                else:
                    head = np.logical_and.accumulate(rows == words[..., :-1], 2).sum(2)
                    tail = np.logical_and.accumulate((rows == words[..., 1:])[..., ::-1], 2).sum(2)
                    hits = head + tail >= shorter
                asks, holds = np.nonzero(hits)
                if len(asks):
                    yield asking[top + asks], own[left + holds]


def _found(rows: pa.Table, settings: Settings) -> pa.Table:
    """Of one block: for each word that found near ones, or was found by shorter ones, how many and the best."""
    words, counts = rows["word"].to_pylist(), rows["n"].to_pylist()
    asks, length = rows["asks"].to_numpy(), rows["length"][0].as_py()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    holding = np.flatnonzero(~asks)
    best: dict[str, list] = {}

    def met(word: str, other: str, n: int) -> None:
        known = best.get(word)
        if known is None:
            best[word] = [1, n, other]
            return
        known[0] += 1
        if (-n, other) < (-known[1], known[2]):
            known[1:] = n, other

    if len(holding):
        tree = _Tree(_codes([words[i] for i in holding], length), settings.leaf)
        for size in (length, length - 1):
            asking = np.flatnonzero(asks & (sizes == size))
            if not len(asking):
                continue
            for one, other in tree.near(_codes([words[i] for i in asking], size)):
                for i, j in zip(asking[one].tolist(), holding[other].tolist(), strict=True):
                    met(words[i], words[j], counts[j])
                    if size < length:
                        met(words[j], words[i], counts[i])
    columns = [list(best), *([found[k] for found in best.values()] for k in range(3))]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.table({c: pa.array(v, k) for c, v, k in zip(("word", "near", "n", "best"), columns, kinds, strict=True)})


# ------------------------------------------------------------------ forms


def variants(words: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each of distinct words ``word, n``.

    Words are near if one inserted, deleted or replaced code point tells them apart. The form is the near word that is there
    most often (of equal ones the first in code-point order) if that is at least ``ratio`` times as often as the word
    itself, else null; the root is where the forms lead in the end. Code points are at most 255, and no word is empty.
    No pair is lost: a word asks in every cell that its edits can lead to.
    """
    with Scratch(words.sparkSession) as scratch:
        words = scratch.keep(words.select("word", F.col("n").cast("long")), "words")
        rows = scratch.keep(placed(words, choose_cuts(words, settings)), "placed")
        blocks = in_blocks(rows, settings).groupBy("length", "cell", "block", "part")
        met = blocks.applyInArrow(
            lambda given: _found(given, settings), "word string, near long, n long, best string"
        )
        best = met.groupBy("word").agg(
            F.sum("near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "best")).alias("first")
        )
        far = -F.col("first.n") >= settings.ratio * F.col("n")
        found = words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(far, F.col("first.best")).alias("form"),
            F.when(far, -F.col("first.n")).alias("form_n"),
        )
        found = scratch.keep(found, "found")
        # Forms are ever more frequent, so there are no circles; each round doubles how far a word has come.
        ways = scratch.keep(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "ways-0")
        turn = 0
        while True:
            on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
            moved = ways.join(on, "root", "left")
            ways = moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
            turn += 1
            ways = scratch.keep(ways, f"ways-{turn}")
            if ways.where("moved").isEmpty():
                break
        ways = ways.drop("moved")
        done = found.join(ways, "word", "left").withColumn("root", F.coalesce("root", "word"))
        return settled(done.select("word", "form", "root", "n", "n_near", "form_n"))


def spelling_variants(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """:func:`variants` of the words of ``documents`` (``doc_id``, ``text``); see :func:`word_counts`."""
    return variants(word_counts(documents, settings), settings)
