"""Word-removal samples of one text at a time, in numpy: which words each keeps, and how a linear
model scores what is left (L1, L2).

The masks are those of ``explain.perturbations``: ``Draw`` follows Spark's ``xxhash64(key, sample, word, seed)``
byte by byte.  ``TermTable`` holds the parameters of a linear model as a tree of words (a term's nodes are its
first word, its first two, ...), so that an n-gram which only a removal brings together is found as well.
A text's samples are handled ``FLAGS`` flags at a time, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FLAGS = 1 << 20  # (sample, token) flags of a text that are handled at a time, about
CELLS = 1 << 22  # cells of a table of the pairs of a text's words, at most
U = np.uint64
P1, P2, P3, P4, P5 = (U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                     0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(h: np.ndarray, by: int) -> np.ndarray:
    return (h << U(by)) | (h >> U(64 - by))


def _last(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * P2
    h = (h ^ (h >> U(29))) * P3
    return h ^ (h >> U(32))


def hash_int(x, seed: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of an int (its lower 32 bits, as uint64) on top of ``seed``."""
    return _last(_turn((seed + (P5 + U(4))) ^ (x * P1), 23) * P2 + P3)


def _word(k: np.ndarray) -> np.ndarray:
    return _turn(k * P2, 31) * P1


def hash_long(x, seed: np.ndarray) -> np.ndarray:
    return _last(_turn((seed + (P5 + U(8))) ^ _word(x), 27) * P1 + P4)


def hash_bytes(raw: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Hashes (strings x seeds) of strings of one length, the rows of ``raw``."""
    n, size = raw.shape
    longs = np.ascontiguousarray(raw[:, :size // 8 * 8]).view("<u8").astype(U)[:, :, None]  # strings x places x 1
    seed, at = seed[None, :], 0
    if size >= 32:
        v = [seed + P1 + P2, seed + P2, seed, seed - P1]
        while at + 4 <= longs.shape[1]:
            v = [_turn(x + longs[:, at + i] * P2, 31) * P1 for i, x in enumerate(v)]
            at += 4
        h = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
        for x in v:
            h = (h ^ _word(x)) * P1 + P4
    else:
        h = np.repeat(seed + P5, n, axis=0)
    h = h + U(size)
    for i in range(at, longs.shape[1]):
        h = _turn(h ^ _word(longs[:, i]), 27) * P1 + P4
    at = size // 8 * 8
    if size & 4:
        four = np.ascontiguousarray(raw[:, at:at + 4]).view("<u4").astype(U)
        h = _turn(h ^ (four * P1), 23) * P2 + P3
        at += 4
    for i in range(at, size):
        h = _turn(h ^ (raw[:, i:i + 1].astype(U) * P5), 11) * P1
    return _last(h)


class Draw:
    """The samples of one text of the distinct ``words``; ``hashed_key`` is Spark's ``xxhash64`` of its key."""

    def __init__(self, hashed_key: int, words: pa.Array, num_samples: int, seed: int):
        self.num, self.size = num_samples, len(words)
        small = -(1 << 31) <= seed < 1 << 31  # a literal of Spark is an int where that holds it
        self.seed = np.array([seed & (0xFFFFFFFF if small else 0xFFFFFFFFFFFFFFFF)], U)
        self._hashed = hash_int if small else hash_long
        self.base = hash_int(np.arange(num_samples, dtype=U), np.array([hashed_key], np.int64).view(U))
        drawn = self._seeded(self.base).view(np.int64)
        # how many words go: uniform in [1, size], none in the intact sample 0
        self.gone = np.where(np.arange(num_samples) == 0, 0, 1 + drawn % max(1, self.size))
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + self.size + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] else np.zeros(0, np.uint8)
        sizes = np.diff(offsets)
        self.order = np.argsort(sizes, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(sizes[self.order], prepend=-1)), self.size)
        self.groups = [(a, b, data[offsets[self.order[a:b], None] + np.arange(sizes[self.order[a]])])
                       for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _seeded(self, h: np.ndarray) -> np.ndarray:
        return self._hashed(self.seed, h)

    def kept(self, start: int, stop: int) -> np.ndarray:
        """(samples x words) flags of the samples ``start:stop``."""
        h = np.empty((self.size, stop - start), U)
        for a, b, raw in self.groups:
            h[self.order[a:b]] = self._seeded(hash_bytes(raw, self.base[start:stop]))
        h = np.ascontiguousarray(h.view(np.int64).T)
        gone = self.gone[start:stop]
        limit = np.sort(h, axis=1)[np.arange(len(h)), np.maximum(gone - 1, 0)]
        return (h > limit[:, None]) | (gone == 0)[:, None]


class TermTable:
    """Terms of ``n_min`` to ``n_max`` words with the sums of ``idf * coef`` and of ``idf * idf`` of their rows."""

    def __init__(self, table: pa.Table, n_min: int, n_max: int, max_length: int | None = None):
        self.n_min, self.n_max, self.max_length = n_min, n_max, max_length
        lists = pc.split_pattern(table.column("term").combine_chunks().cast(pa.string()), " ")
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        use = (sizes >= n_min) & (sizes <= n_max)
        lists, sizes = lists.filter(pa.array(use)), sizes[use]
        dot, square = (table.column(c).to_numpy()[use] for c in ("dot", "square"))
        encoded = lists.flatten().dictionary_encode()
        self.words = encoded.dictionary
        code, first = encoded.indices.to_numpy().astype(np.int64), np.cumsum(sizes) - sizes
        v = max(1, len(self.words))
        self.keys: list[np.ndarray] = []  # of level n: first n - 1 words' node * words + n-th word, sorted; a node is a place
        self.dot, self.square, self.whole = [], [], []
        node = np.zeros(len(sizes), np.int64)
        for n in range(1, n_max + 1):
            long = np.flatnonzero(sizes >= n)
            key = node[long] * v + code[first[long] + n - 1]
            keys = np.arange(v) if n == 1 else np.unique(key)  # of one word: its number
            node[long] = at = np.searchsorted(keys, key)
            own = sizes[long] == n
            values = [np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys), bool)]
            values[0][at[own]], values[1][at[own]], values[2][at[own]] = dot[long[own]], square[long[own]], True
            self.keys.append(keys)
            for held, value in zip((self.dot, self.square, self.whole), values):
                held.append(value)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The words' numbers in this table, -1 for those it does not hold."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)

    def _nodes(self, n: int, code: np.ndarray, parents: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams ``code`` (place among ``parents`` * words + word of the text): place among those that the
        table holds (-1: none), and the nodes of these."""
        size = len(number)
        if len(parents) * size <= CELLS:
            there = np.zeros(len(parents) * size, bool)
            there[code] = True
            known = np.flatnonzero(there)
        else:
            known, code = np.unique(code, return_inverse=True)
        parent, word = parents[known // size], number[known % size]
        key = np.where((parent >= 0) & (word >= 0), parent * max(1, len(self.words)) + word, -1)
        keys = self.keys[n - 1]
        at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        found = keys[at] == key if len(keys) else np.zeros(len(key), bool)
        place = np.where(found, np.cumsum(found) - 1, -1)
        if len(parents) * size <= CELLS:
            table = np.empty(len(parents) * size, np.int64)
            table[known] = place
            place = table
        return place[code], at[found]

    def sums(self, kept: np.ndarray, at: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per sample the sums of ``w * coef`` and ``w * w``, w = (1 + ln(tf)) * idf, over the n-grams of the tokens
        ``at`` (places in the text's words, of these ``number``) that the sample keeps."""
        samples, size = kept.shape
        there = np.flatnonzero(kept[:, at])
        row = there // max(1, len(at))
        word = at[there - row * len(at)]
        if self.max_length is not None:
            short = np.arange(len(row)) - np.searchsorted(row, np.arange(samples))[row] < self.max_length
            row, word = row[short], word[short]
        dot, square = np.zeros(samples), np.zeros(samples)
        start, place, nodes = np.arange(len(row)), word, number
        for n in range(1, self.n_max + 1):
            if n > 1:
                start, place = start[place >= 0], place[place >= 0]
                fits = start + n - 1 < len(row)
                start, place = start[fits], place[fits]
                same = row[start + n - 1] == row[start]
                start, place = start[same], place[same]
                place, nodes = self._nodes(n, place * size + word[start + n - 1], nodes, number)
            if n == 1 and self.max_length is None:  # all places of a word go or stay together
                if self.n_min == 1 and len(self.dot[0]):
                    tf = np.where(nodes >= 0, 1.0 + np.log(np.bincount(at, minlength=size)), 0.0)
                    dot += kept @ (tf * self.dot[0][nodes])
                    square += kept @ (tf * tf * self.square[0][nodes])
            elif n >= self.n_min:
                held = np.append((nodes >= 0) & self.whole[n - 1][nodes] if len(self.whole[n - 1]) else np.zeros(len(nodes), bool), False)
                use = held[place]
                key = np.sort(row[start[use]] * max(1, len(nodes)) + place[use])
                new = np.flatnonzero(np.diff(key, prepend=-1))
                of, gram = np.divmod(key[new], max(1, len(nodes)))
                tf = 1.0 + np.log(np.diff(new, append=len(key)))
                dot += np.bincount(of, tf * self.dot[n - 1][nodes[gram]], samples)
                square += np.bincount(of, tf * tf * self.square[n - 1][nodes[gram]], samples)
        return dot, square


def distinct_tokens(tokens: pa.ListArray) -> tuple[pa.Array, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The words of all texts, and per text its distinct words (places there, in order of first occurrence) and
    of each token the place among these."""
    encoded = tokens.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy().astype(np.int64)
    ends = tokens.offsets.to_numpy().astype(np.int64)
    ends -= ends[0]

    def texts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            own, first, at = np.unique(codes[a:b], return_index=True, return_inverse=True)
            order = np.argsort(first)
            back = np.empty(len(own), np.int64)
            back[order] = np.arange(len(own))
            yield own[order], back[at]

    return encoded.dictionary, texts()
