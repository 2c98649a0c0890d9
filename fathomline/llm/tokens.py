"""Encoding of a corpus with a public byte-level BPE vocabulary by corpus-level merge replay.

A task never encodes text after text.  It collects the distinct words of its batch, lays them out as one chain of byte
symbols, builds an inverted index from symbol pair to positions in that chain and applies the merges of the vocabulary in
rank order.  A merge touches the positions listed under its pair and the pairs of their direct neighbours, nothing else.
The ids of each text are then put together from those of its words, so no word is shuffled and every text is whole.
"""

from __future__ import annotations

import heapq
import itertools
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the pattern that cuts text into words before the merges.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_KNOWN_WORDS = 400_000  # words a worker remembers; beyond it starts anew, which costs time and changes no result


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class MergeReplay:
    """The merges of a vocabulary, replayed over many words at once."""

    def __init__(self, vocabulary: str) -> None:
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_ids = [0] * 256
        for char, byte in _byte_alphabet().items():
            self.byte_ids[byte] = vocab[char]
        #: (left id, right id) -> (rank, merged id)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.words = regex.compile(WORD_PATTERN)
        self.known: dict[str, tuple[int, ...]] = {}

    def replay(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each word."""
        byte_ids, merges = self.byte_ids, self.merges
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        symbols: list[int] = []
        starts: list[int] = []
        for w in raw:
            starts.append(len(symbols))
            symbols.extend([byte_ids[b] for b in w])
            symbols.append(-1)  # no pair reaches over the end of a word
        n = len(symbols)
        following = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        index: dict[tuple[int, int], list[int]] = {}
        for at, pair in enumerate(zip(symbols, symbols[1:])):
            if pair in merges:
                index.setdefault(pair, []).append(at)
        queue = [(merges[p][0], p) for p in index]
        heapq.heapify(queue)
        while queue:
            _, pair = heapq.heappop(queue)
            places = index.pop(pair, None)
            if places is None:
                continue
            left, right = pair
            merged = merges[pair][1]
            places.sort()  # overlapping pairs are merged from the left
            for at in places:
                if symbols[at] != left:
                    continue
                nxt = following[at]
                if symbols[nxt] != right:
                    continue
                symbols[at], symbols[nxt] = merged, -2
                after = following[nxt]
                following[at] = after
                before[after] = at
                prior = before[at]
                if prior >= 0:
                    p = (symbols[prior], merged)
                    if p in merges:
                        if p not in index:
                            index[p] = []
                            heapq.heappush(queue, (merges[p][0], p))
                        index[p].append(prior)
                p = (merged, symbols[after])
                if p in merges:
                    if p not in index:
                        index[p] = []
                        heapq.heappush(queue, (merges[p][0], p))
                    index[p].append(at)
        return [tuple([s for s in symbols[a : a + len(w)] if s >= 0]) for a, w in zip(starts, raw)]

    def encode(self, texts: Iterable[str | None]) -> Iterator[list[tuple[int, ...]]]:
        """For each text the ids of its words in order; nothing for null and empty texts."""
        cut = [self.words.findall(t) if t else [] for t in texts]
        if len(self.known) > _KNOWN_WORDS:
            self.known.clear()
        known = self.known
        new = list({w for words in cut for w in words if w not in known})
        known.update(zip(new, self.replay(new)))
        for words in cut:
            yield [known[w] for w in words]


@lru_cache(maxsize=2)
def replayer(vocabulary: str) -> MergeReplay:
    return MergeReplay(vocabulary)


def _ship(spark: SparkSession, vocabulary: str) -> None:
    """Hand the vocabulary file to the workers, which need not have it; done once per session."""
    if os.path.exists(vocabulary):
        spark.sparkContext.addFile(os.path.realpath(vocabulary))


def _shipped(vocabulary: str) -> str:
    """Where a worker finds the vocabulary: the file that was sent, else the path itself."""
    sent = SparkFiles.get(os.path.basename(os.path.realpath(vocabulary)))
    return sent if os.path.exists(sent) else vocabulary


def _texts(column: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a batch in portions of bounded size, so that a few very long ones do not pile up."""
    portion: list[str | None] = []
    size = 0
    for value in column:
        text = value.as_py()
        portion.append(text)
        size += len(text or "")
        if size > 8_000_000:
            yield portion
            portion, size = [], 0
    if portion:
        yield portion


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (list of integers, no special tokens) of every row.

    Null and empty texts get an empty list; blank texts are encoded like any other; the strings of special tokens are
    ordinary text.  Repeated keys stay repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = replayer(_shipped(vocabulary))
        for batch in batches:
            done = 0
            for texts in _texts(batch.column(1)):
                offsets, flat = [0], []
                for words in coder.encode(texts):
                    flat.extend(itertools.chain.from_iterable(words))
                    offsets.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.asarray(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), ids], names=[key, "ids"])
                done += len(texts)

    _ship(df.sparkSession, vocabulary)
    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def count_tokens(df: DataFrame, columns: list[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``columns`` and ``tokens`` (bigint) of every row, counted by the same encoding; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = replayer(_shipped(vocabulary))
        for batch in batches:
            counts: list[int] = []
            for texts in _texts(batch.column(len(columns))):
                counts.extend(sum(map(len, words)) for words in coder.encode(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(counts, pa.int64())], names=[*columns, "tokens"])

    _ship(df.sparkSession, vocabulary)
    kinds = dict(df.dtypes)
    return df.select(*columns, F.col(text)).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", tokens bigint")
