"""Token ids of texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import spread

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits a text into words before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rank of a pair that doesn't merge.
NEVER = np.int32(2**31 - 1)
#: Widths of the padded matrices; longer words are merged one at a time.
WIDTHS = (2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256)
#: Cells of one padded matrix, and words a worker remembers.
CELLS, REMEMBERED = 1 << 20, 400_000


def _letters() -> dict[str, int]:
    """Letter of each byte in the vocabulary file: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merges of a vocabulary in an open-addressing hash table of flat arrays: pair of ids -> rank and merged id."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, byte_ids: np.ndarray):
        self.byte_ids = byte_ids.astype(np.int32)
        self.bits = max(4, int(2 * len(left)).bit_length() + 1)
        slots = 1 << self.bits
        self.keys = np.full(slots, -1, dtype=np.int64)
        self.ranks = np.full(slots, NEVER, dtype=np.int32)
        self.ids = np.full(slots, -1, dtype=np.int32)
        keys = (left.astype(np.int64) << 32) | right
        waiting, at = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(waiting):
            self.probes += 1
            free = self.keys[at] < 0
            first = np.zeros(len(waiting), dtype=bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            slot, which = at[put], waiting[put]
            self.keys[slot], self.ranks[slot], self.ids[slot] = keys[which], which, merged[which]
            waiting, at = waiting[~put], (at[~put] + 1) & (slots - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; :data:`NEVER` and -1 without a merge. Ids below 0 are padding."""
        keys = (left.astype(np.int64) << 32) | right
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        held = self.keys[at]
        rank, merged = np.where(held == keys, self.ranks[at], NEVER), np.where(held == keys, self.ids[at], -1)
        open_ = np.flatnonzero((held != keys) & (held != -1) & (keys != -2))
        for _ in range(self.probes):
            if not len(open_):
                break
            at_open = (at[open_] + 1) & (len(self.keys) - 1)
            at[open_] = at_open
            held = self.keys[at_open]
            hit = held == keys[open_]
            rank[open_[hit]], merged[open_[hit]] = self.ranks[at_open[hit]], self.ids[at_open[hit]]
            open_ = open_[~hit & (held != -1)]
        return rank, merged

    @classmethod
    def load(cls, path: str) -> Merges:
        """From the JSON file of a byte-level BPE."""
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        column = lambda get: np.array([vocab[get(p)] for p in pairs], dtype=np.int64)
        byte_ids = np.zeros(256, dtype=np.int64)
        for letter, byte in _letters().items():
            byte_ids[byte] = vocab[letter]
        return cls(column(lambda p: p[0]), column(lambda p: p[1]), column(lambda p: p[0] + p[1]), byte_ids)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, by padded matrices of words of about equal length."""
        out: list[list[int]] = [[]] * len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        bucket = np.searchsorted(WIDTHS, lengths)
        order = np.lexsort((lengths, bucket))
        edges = np.searchsorted(bucket[order], np.arange(len(WIDTHS) + 2))
        for b, width in enumerate(WIDTHS):
            rows = order[edges[b] : edges[b + 1]]
            step = max(1, CELLS // width)
            for i in range(0, len(rows), step):
                chosen = rows[i : i + step]
                for row, ids in zip(chosen, self._matrix([words[r] for r in chosen], width), strict=True):
                    out[row] = ids
        for row in order[edges[len(WIDTHS)] :]:
            out[row] = self._long(words[row])
        return out

    def _matrix(self, words: list[bytes], width: int) -> list[list[int]]:
        """Each round every row merges its leftmost pair of least rank; rows lose one cell then, rows without a merge leave."""
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        tokens = np.where(np.arange(width) < lengths[:, None], self.byte_ids[raw], np.int32(-1))
        ranks, merged = (x.reshape(len(words), width - 1) for x in self.look(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()))
        out: list[list[int]] = [[]] * len(words)
        rows = np.arange(len(words))
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), dtype=np.int64)
            goes_on = ranks[np.arange(len(rows)), at] < NEVER if ranks.shape[1] else np.zeros(len(rows), dtype=bool)
            if not goes_on.all():
                done = ~goes_on
                for row, ids in zip(rows[done].tolist(), tokens[done].tolist(), strict=True):
                    cut = ids.index(-1) if ids[-1] < 0 else len(ids)
                    out[row] = ids[:cut]
                rows, tokens, ranks, merged, at = rows[goes_on], tokens[goes_on], ranks[goes_on], merged[goes_on], at[goes_on]
                if not len(rows):
                    break
            n, w = tokens.shape
            line = np.arange(n)
            tokens[line, at] = merged[line, at]
            keep = np.ones((n, w), dtype=bool)
            keep[line, at + 1] = False
            tokens = tokens[keep].reshape(n, w - 1)
            keep = np.ones((n, w - 1), dtype=bool)
            keep[line, at] = False
            ranks, merged = ranks[keep].reshape(n, w - 2), merged[keep].reshape(n, w - 2)
            for side in (-1, 0):  # the pairs that now begin or end with the merged token
                place = at + side
                ok = (place >= 0) & (place < w - 2)
                r, p = line[ok], place[ok]
                ranks[r, p], merged[r, p] = self.look(tokens[r, p], tokens[r, p + 1])
        return out

    def _long(self, word: bytes) -> list[int]:
        """One long word. All pairs of the least rank merge in one round, from the left and without overlap; as merges of a
        new token always rank higher, this gives what merging the leftmost of them at a time gives."""
        tokens = self.byte_ids[np.frombuffer(word, dtype=np.uint8)]
        ranks, merged = self.look(tokens[:-1], tokens[1:])
        while len(ranks):
            least = ranks.min()
            if least == NEVER:
                break
            at = np.flatnonzero(ranks == least)
            if len(at) > 1:
                new_run = np.concatenate(([True], np.diff(at) > 1))
                start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            tokens = tokens.copy()
            tokens[at] = merged[at]
            keep = np.ones(len(tokens), dtype=bool)
            keep[at + 1] = False
            tokens, ranks, merged = tokens[keep], ranks[keep[1:]], merged[keep[1:]]
            now = at - np.arange(len(at))
            near = np.unique(np.concatenate((now - 1, now)))
            near = near[(near >= 0) & (near < len(tokens) - 1)]
            ranks[near], merged[near] = self.look(tokens[near], tokens[near + 1])
        return tokens.tolist()


class Encoder:
    """Texts to ids in one worker; remembers the words it has met, up to :data:`REMEMBERED`."""

    def __init__(self, merges: Merges):
        import regex

        self.find = regex.compile(PATTERN).findall
        self.merges = merges
        self.known: dict[str, list[int]] = {}

    def _split(self, texts: list[str | None]) -> list[list[str]]:
        split = [self.find(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({w for words in split for w in words}.difference(self.known))
        self.known.update(zip(new, self.merges.encode_words([w.encode("utf-8") for w in new]), strict=True))
        return split

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        known = self.known
        out = []
        for words in self._split(texts):
            ids: list[int] = []
            for w in words:
                ids += known[w]
            out.append(ids)
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        split = self._split(texts)
        size = {w: len(ids) for w, ids in self.known.items()}
        return [sum(map(size.__getitem__, words)) for words in split]


_ENCODERS: dict[int, Encoder] = {}


def _worker(shared) -> Encoder:
    """One encoder per worker process and broadcast vocabulary."""
    merges = shared.value
    if id(merges) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[id(merges)] = Encoder(merges)
    return _ENCODERS[id(merges)]


def _slices(texts: pa.ChunkedArray | pa.Array, most_bytes: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a few MB each, so that a batch of very long texts isn't held split at once."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most_bytes:
            yield start, i
            start, held = i, 0
        held += int(size)
    if start < len(sizes):
        yield start, len(sizes)


def _texts(df: DataFrame, text: str, extra: list[str], tokenizers: str, vocabulary: str):
    merges = Merges.load(os.path.join(tokenizers, f"{vocabulary}.json"))
    shared = df.sparkSession.sparkContext.broadcast(merges)
    return spread(df.select(*extra, text), *extra), shared


def token_ids(df: DataFrame, key: str, text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """``key, ids``: the token ids of each text, taken exactly as it stands, without special tokens; one row per input row.

    Null and empty texts give an empty list; strings that look like special tokens are ordinary text. Texts are never cut.
    Repeated rows and null keys are kept. ``vocabulary`` names a JSON file of a byte-level BPE in the folder ``tokenizers``, read on
    the driver and broadcast (its size doesn't depend on the data).

    Words that a worker hasn't met are merged together: sorted into padded matrices by length, each row merges its leftmost
    pair of least rank per round, pairs are looked up in a hash table of flat arrays, and rows shrink or leave after
    every round. No shuffle, unless the input has fewer partitions than the cluster has cores.
    """
    rows, shared = _texts(df, text, [key], tokenizers, vocabulary)
    key_field = rows.schema[key]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(shared)
        for batch in batches:
            for start, end in _slices(batch.column(1)):
                lists = encoder.encode(batch.column(1).slice(start, end - start).to_pylist())
                offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))))).astype(np.int32)
                flat = np.fromiter((x for ids in lists for x in ids), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    return rows.mapInArrow(kernel, f"`{key}` {key_field.dataType.simpleString()}, ids array<int>")


def token_counts(df: DataFrame, keys: list[str], text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """``keys`` and ``tokens``, the number of ids :func:`token_ids` gives; one row per input row."""
    rows, shared = _texts(df, text, keys, tokenizers, vocabulary)
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(shared)
        for batch in batches:
            at = batch.num_columns - 1
            counts = [n for start, end in _slices(batch.column(at)) for n in encoder.count(batch.column(at).slice(start, end - start).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(counts, pa.int64())], names=[*keys, "tokens"])

    return rows.mapInArrow(kernel, f"{schema}, tokens long")
