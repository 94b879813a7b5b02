"""Exact token counts at every prefix of a text, by dynamic programming over its characters.

A text of merged pieces has one encoding, and any two neighbours in it are what the two alone
would be merged to. So the last token of a prefix is the one token that ends there and
stands rightly behind the last token of the prefix before it, and the count of a prefix is one more than
that of the prefix before its last token. Each prefix is settled once, with a look at the tokens that end there.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline.llm.common import in_parts, opened, set_aside, share

# Fixed value: what the library writes for a space.
GAP = "▁"

#: Chunks whose counts a task remembers, twice so many at most, and the longest of them (at most 63 characters, for
#: whose counts a byte will do); pairs of pieces that it remembers. Memory against time; results do not depend on it.
REMEMBERED, LONGEST, PAIRS = 200_000, 48, 500_000

#: Chunks of a text that are put together at once.
BLOCK = 200_000


@dataclass
class Vocabulary:
    """Pieces of a merging model by score, those that merging reaches, and the characters that no piece joins to others."""

    scores: dict[str, float]
    reached: list[str]
    apart: str


def merged(text: str, scores: dict[str, float], edge: int = 0) -> list[str]:
    """The pieces of a short text: the best pair first, of equal ones the leftmost.

    With ``edge``, nothing as soon as a piece spans the end of the first ``edge`` characters.
    """
    parts, none = list(text), float("-inf")
    pairs = [scores.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs and (best := max(pairs)) > none:
        at = pairs.index(best)
        if at < edge:
            # So many parts lie before the edge.
            edge -= 1
            if at == edge:
                return []
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = scores.get(parts[at - 1] + parts[at], none)
        if at < len(pairs):
            pairs[at] = scores.get(parts[at] + parts[at + 1], none)
    return parts


def read_vocabulary(path: str) -> Vocabulary:
    """The pieces of a ``.model`` file whose rules this module follows.

    That is merging with byte fallback, no normalisation, spaces kept and one put in front.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    scores = {model.id_to_piece(i): model.get_score(i) for i in ids if not any(f(i) for f in special)}
    if model.encode(" ﬁ ", out_type=str) != [GAP * 2, "ﬁ", GAP] or not any(map(model.is_byte, ids)):
        raise ValueError("the model normalises texts or has no bytes to fall back to")
    if any(GAP in piece.lstrip(GAP) for piece in scores):
        raise ValueError("a piece spans words")
    reached = [piece for piece in scores if merged(piece, scores) == [piece]]
    joins = {pair for piece in scores for pair in zip(piece, piece[1:], strict=False)}
    known = {*"".join(scores), *map(chr, range(32))} - {GAP}
    apart = {c for c in known if unicodedata.category(c)[0] not in "LM"}
    while True:
        bound = {x for a, b in joins for x, y in ((a, b), (b, a)) if x in apart and y not in apart and y != GAP}
        if not bound:
            break
        apart -= bound
    return Vocabulary(scores, reached, "".join(sorted(apart)))


class Counter:
    """Counts at every prefix of texts, for one task.

    Chunks, between which no piece reaches, are counted by themselves: a word with the spaces before it, or
    a run of the characters in ``apart``.
    """

    def __init__(self, vocabulary: Vocabulary):
        self._scores, self._pieces = vocabulary.scores, ["", *vocabulary.reached]
        # What ends where is found by one walk over the characters.
        found = ahocorasick.Automaton()
        for token, piece in enumerate(self._pieces[1:], 1):
            found.add_word(piece, (len(piece), token))
        found.make_automaton()
        self._ending = found.iter
        self._pairs: dict[int, bool] = {}
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        plain = "".join(c for c in vocabulary.apart if c.isascii())
        # A small class is matched faster, and will do where none of the rarer characters is there to be joined.
        self._rare = frozenset(vocabulary.apart) - set(plain)
        self._few, self._all = (
            re.compile(f"{GAP}*[^{GAP}{x}]+|{GAP}*[{x}]+|{GAP}+") for x in map(re.escape, (plain, vocabulary.apart))
        )

    def _follows(self, before: int, token: int) -> bool:
        """Whether two pieces side by side stay as they are."""
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        pair = [self._pieces[before], self._pieces[token]]
        found = merged("".join(pair), self._scores, len(pair[0])) == pair
        self._pairs[before << 32 | token] = found
        return found

    def chunk(self, chunk: str) -> list[int]:
        """The token counts of all prefixes of a chunk, from one character on."""
        # By prefix: its last token, 0 for none or for a character that goes by its bytes.
        last, counts, done = [0] * (len(chunk) + 1), [0] * (len(chunk) + 1), 0
        known = self._pairs.get
        for at, (length, token) in self._ending(chunk):
            if at < done:
                continue
            if done < at:
                self._by_bytes(chunk, counts, done, at)
            before = last[at + 1 - length]
            if before:
                stays = known(before << 32 | token)
                if not (self._follows(before, token) if stays is None else stays):
                    continue
            done = at + 1
            last[done], counts[done] = token, counts[done - length] + 1
        self._by_bytes(chunk, counts, done, len(chunk))
        return counts[1:]

    def _by_bytes(self, chunk: str, counts: list[int], start: int, end: int) -> None:
        """Characters that are no piece: nothing is merged across them."""
        for i in range(start, end):
            counts[i + 1] = counts[i] + len(chunk[i].encode("utf-8"))

    def _counted(self, chunk: str) -> bytes:
        """The counts of a short chunk, a byte each."""
        found = self._young.get(chunk) or self._old.get(chunk) or bytes(self.chunk(chunk))
        if len(self._young) >= REMEMBERED:
            self._old, self._young = self._young, {}
        self._young[chunk] = found
        return found

    def prefixes(self, text: str) -> Iterator[np.ndarray]:
        """Token counts of the prefixes of one, two, ... characters, in blocks."""
        if not text:
            return
        # The gap in front is no character of the text, but of the first chunk.
        spaced, skip, total = GAP + text.replace(" ", GAP), 1, 0
        for chunks in self._blocks(spaced):
            if isinstance(chunks, str):
                flat = total + np.array(self.chunk(chunks), np.int64)
            else:
                known = self._young.get
                parts = [known(c) or self._counted(c) for c in chunks]
                flat = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
                sizes = np.fromiter(map(len, parts), np.int64, len(parts))
                ends = flat[np.cumsum(sizes) - 1]
                flat += np.repeat(total + np.cumsum(ends) - ends, sizes)
            total = int(flat[-1])
            yield flat[skip:]
            skip = 0

    def _blocks(self, spaced: str) -> Iterator[list[str] | str]:
        """Lists of short chunks, and long ones by themselves."""
        split = self._few if self._rare.isdisjoint(spaced) else self._all
        if len(spaced) <= BLOCK:
            found = split.findall(spaced)
            if max(map(len, found)) <= LONGEST:
                yield found
                return
        chunks: list[str] = []
        for match in split.finditer(spaced):
            chunk = match[0]
            if len(chunk) > LONGEST or len(chunks) == BLOCK:
                if chunks:
                    yield chunks
                chunks = []
            if len(chunk) > LONGEST:
                yield chunk
            else:
                chunks.append(chunk)
        if chunks:
            yield chunks


def share_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The pieces on all executors: their number is that of the file, whatever the data."""
    return share(spark, read_vocabulary(path))


def prefix_counts(
    rows: DataFrame, vocabulary: Broadcast, *, text: str = "text", counts: str = "prefix_tokens"
) -> DataFrame:
    """Add ``counts``, for each text the token counts of its prefixes of 0, 1, 2, ... code points.

    Null is taken for an empty text, whose list is [0]. A column named like ``counts`` is replaced; others
    stay, whatever their names. Nothing moves between tasks. See :func:`tokens_of_prefix` and
    :func:`longest_within` for questions to the list.
    """
    given = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows, columns = set_aside(rows.drop(counts).withColumn(counts, given), (counts,))
    rest = [c for c in rows.columns if c != counts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(opened(vocabulary))
        for batch in (part for whole in batches for part in in_parts(whole, counts, 1_000_000)):
            kept = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            lists, ends = [], [0]
            for data in batch.column(batch.schema.get_field_index(counts)):
                found = [np.zeros(1, np.int64), *counter.prefixes(data.as_py().decode("utf-8", "replace"))]
                lists += found
                ends.append(ends[-1] + sum(map(len, found)))
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept, made], names=[*rest, counts])

    schema = T.StructType([*[rows.schema[c] for c in rest], T.StructField(counts, T.ArrayType(T.LongType()))])
    return rows.mapInArrow(run, schema).select(*columns)


def tokens_of_prefix(counts: Column, chars: Column) -> Column:
    """Tokens of a text cut after ``chars`` code points; those of the whole if it is shorter."""
    return F.element_at(counts, F.least(chars.cast("int"), F.size(counts) - 1) + 1)


def longest_within(counts: Column, budget: Column) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens.

    Counts are no steady climb: a character can join two tokens to one.
    """
    fitting = F.transform(F.reverse(counts), lambda n: n <= budget)
    return F.size(counts) - F.array_position(fitting, F.lit(True))


def counted(documents: DataFrame, vocabulary: Broadcast, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, kept_chars`` for each row of ``documents``.

    The last of a text's prefix counts, and the longest prefix within the limit, in code points; the counts
    themselves stay in the task. A null text is an empty one: no bytes, no tokens. Ids may be null or repeat,
    rows stay as many as they are; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(opened(vocabulary))
        for batch in (part for whole in batches for part in in_parts(whole, "text")):
            sizes, tokens, kept = [], [], []
            for data in batch.column(1):
                raw, total, seen, within = data.as_py(), 0, 0, 0
                for block in counter.prefixes(raw.decode("utf-8", "replace")):
                    fits = np.flatnonzero(block <= limit)
                    within = seen + int(fits[-1]) + 1 if len(fits) else within
                    seen, total = seen + len(block), int(block[-1])
                sizes.append(len(raw))
                tokens.append(total)
                kept.append(within)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                    pa.array(kept, pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "kept_chars"],
            )

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    narrow = documents.select(F.col("doc_id").cast("long"), text)
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, kept_chars long"
    return narrow.mapInArrow(run, schema)
