"""Packing: vector bin packing by the dot-product heuristic.

A sequence has three limits that hold at once: tokens, segments and loss-bearing
tokens.  Each task streams its documents.  Whole sequences are cut off long
documents first; the remainders form a bounded pool of items (tokens, 1 segment,
loss tokens).  An open sequence takes, among the items that fit in every
dimension, the one whose demand has the largest dot product with the room that
is left (both scaled by the limits); when none fits whole, one is cut to the
gap.  What a task has left at its end goes into sequences whose lengths are
powers of two, which need no padding.

Null and empty texts give the single end id; an empty table gives no pieces;
repeated rows are packed one by one; other columns are ignored.  Loss-bearing
tokens are all of a document's tokens unless ``loss`` names a column with the
share of them (0 to 1; null counts as 1).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import kernels as K
from glossa.llm.token_counts import _SPACES, PieceIds, _ids, _text, drops_spaces, load

END_ID = 1
POOL = 2048
_OUT = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
        "loss_tokens long")


class _Packer:
    """One task's open pool; ``add`` and ``finish`` return placed pieces."""

    def __init__(self, task: int, tokens: int, segments: int, loss: int):
        self.limits = np.array([tokens, segments, loss], np.int64)
        self.next_id = task << 33
        self.items: list[list] = []  # [key, ids, total, start, share of loss]
        self.out: list[tuple] = []

    def add(self, key, ids: np.ndarray, share: float) -> None:
        most = int(self.limits[0] if share <= 0 else min(self.limits[0], int(self.limits[2] / share)))
        item = [key, ids, len(ids), 0, share]
        while item[2] - item[3] >= most:
            self._place(item, most, self.next_id, 0)
            self.next_id += 1
        if item[3] < item[2]:
            self.items.append(item)

    def _loss(self, n, share):
        return np.ceil(n * share).astype(np.int64) if isinstance(n, np.ndarray) else int(np.ceil(n * share))

    def _place(self, item: list, length: int, seq: int, offset: int) -> None:
        key, ids, total, start, share = item
        part = ids[start:start + length]
        self.out.append((key, start, length, zlib.crc32(part.tobytes()), total, seq, offset, self._loss(length, share)))
        item[3] += length

    def pack(self, leave: int) -> None:
        """Close full sequences until at most ``leave`` items are left."""
        scale = 1.0 / self.limits
        while len(self.items) > leave:
            size = np.array([x[2] - x[3] for x in self.items], np.int64)
            share = np.array([x[4] for x in self.items])
            need = np.stack([size, np.ones_like(size), self._loss(size, share)])
            live = np.ones(len(size), bool)
            while live.sum() > leave and size[live].sum() >= self.limits[0]:
                room, offset = self.limits.copy(), 0
                while room[0] > 0 and room[1] > 0 and live.any():
                    fits = live & (need <= room[:, None]).all(axis=0)
                    score = (room * scale * scale) @ need
                    if fits.any() and not (room[1] == 1 and (size[live] >= room[0]).any()):
                        i = int(np.where(fits, score, -1.0).argmax())
                        take = int(size[i])
                    else:  # cut the largest item to the gap
                        i = int(np.where(live, size, -1).argmax())
                        take = int(min(size[i], room[0]))
                        while take and self._loss(take, share[i]) > room[2]:
                            take = min(take - 1, int(room[2] / share[i]))
                    if not take:
                        break
                    self._place(self.items[i], take, self.next_id, offset)
                    offset += take
                    room -= np.array([take, 1, self._loss(take, share[i])])
                    size[i] -= take
                    need[0, i], need[2, i] = size[i], self._loss(int(size[i]), share[i])
                    live[i] = size[i] > 0
                self.next_id += 1
            before = len(self.items)
            self.items = [x for x in self.items if x[3] < x[2]]
            if len(self.items) == before or sum(x[2] - x[3] for x in self.items) < self.limits[0]:
                break

    def finish(self) -> None:
        """Place what is left in sequences of power-of-two lengths."""
        self.pack(0)
        while self.items:
            by_size = sorted(self.items, key=lambda x: x[3] - x[2])[:int(self.limits[1])]
            reach = min(sum(x[2] - x[3] for x in by_size), int(self.limits[0]))
            size = 1 << (reach.bit_length() - 1) if reach < self.limits[0] else int(self.limits[0])
            plan = self._fill(by_size, size)
            while size > 1 and sum(self._loss(n, x[4]) for x, n in plan) > self.limits[2]:
                size >>= 1
                plan = self._fill(by_size, size)
            offset = 0
            for x, n in plan:
                self._place(x, n, self.next_id, offset)
                offset += n
            self.next_id += 1
            self.items = [x for x in self.items if x[3] < x[2]]

    @staticmethod
    def _fill(items: list[list], size: int) -> list[tuple[list, int]]:
        plan = []
        for x in items:
            n = min(x[2] - x[3], size)
            if n:
                plan.append((x, n))
                size -= n
        return plan

    def drain(self) -> list[tuple]:
        got, self.out = self.out, []
        return got


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", max_tokens: int = 2048,
                   max_segments: int = 64, max_loss: int | None = None, loss: str | None = None,
                   end_id: int = END_ID) -> DataFrame:
    """One row per placed piece: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens)."""
    names = [key, *(x.split()[0] for x in _OUT.split(", "))]
    kind = docs.schema[key].dataType.simpleString()
    top = max_loss or max_tokens

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok = load(tokenizer)
        pieces = PieceIds(tok) if drops_spaces(tok) else None
        packer = _Packer(TaskContext.get().partitionId(), max_tokens, max_segments, top)
        key_type = None

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], key_type)] + [pa.array(c, pa.int64()) for c in cols[1:]],
                                              names=names)

        for batch in K.slices(batches):
            key_type = batch.schema.field(0).type
            flat_ids, rows = _batch_ids(batch.column(1), tok, pieces, end_id)
            shares = batch.column(2).fill_null(1.0).to_numpy(zero_copy_only=False)
            for i, k in enumerate(batch.column(0).to_pylist()):
                packer.add(k, flat_ids[rows[i]:rows[i + 1]].copy(), min(1.0, max(0.0, float(shares[i]))))
                if len(packer.items) >= POOL:
                    packer.pack(POOL // 2)
            if packer.out:
                yield emit(packer.drain())
        packer.finish()
        if packer.out:
            yield emit(packer.drain())

    share = F.col(loss).cast("double") if loss else F.lit(1.0)
    own = docs.select(F.col(key).alias(key), _text(text).alias("_text"), share.alias("_share"))
    return own.mapInArrow(pack, f"`{key}` {kind}, {_OUT}")


def _batch_ids(texts: pa.Array, tok, pieces: PieceIds | None, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows, each row ended by ``end_id``, and the rows' offsets."""
    n = len(texts)
    if pieces is None:
        got = [np.array([*_ids(tok, t or ""), end_id], "<u4") for t in texts.to_pylist()]
        return np.concatenate(got), np.concatenate([[0], np.cumsum([len(x) for x in got])])
    data, at = K.flat(texts)
    starts, ends, rows = K.words(data, at, _SPACES)
    of_piece, pool, which = pieces.of(data, starts, ends) if len(starts) else (
        np.zeros(1, np.int64), np.zeros(0, "<u4"), np.zeros(0, np.int64))
    sizes = np.diff(of_piece)[which]
    sums = np.concatenate([[0], np.cumsum(sizes)])
    out_rows = sums[rows] + np.arange(n + 1)
    out = np.full(int(sums[-1]) + n, end_id, "<u4")
    place = np.ones(len(out), bool)
    place[out_rows[1:] - 1] = False
    out[place] = pool[K.ragged(of_piece[which], sizes)]
    return out, out_rows
