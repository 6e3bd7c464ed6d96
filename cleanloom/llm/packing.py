"""Vector bin packing of examples under limits on tokens, segments and loss-bearing tokens.

The dot-product heuristic fills one sequence at a time: of the waiting pieces that fit in all three
dimensions it takes the one whose demand has the largest dot product with what is left of the sequence,
both as shares of the limits. An example's first ids are its prompt and bear no loss, nor does its end id; the others do.
Examples may be cut: whole sequences, of as many loss-bearing ids as a sequence may hold and of prompt for the rest, come off
long ones first, and when no waiting piece fits, the one that has most to give is cut to fill the sequence. Each partition packs
on its own, with a bounded number of waiting pieces, so no row moves. Pieces that cannot fill a sequence (the last ones of a
partition, or where the limits on segments or loss leave nothing that fits) are dealt into sequences whose lengths are
powers of two, which need no padding.

Defined results: a null or empty text is one example with the end id alone; each id of each row lies in exactly one
piece, whatever the text's length; rows that repeat are examples of their own; of pieces with equal scores the one that has waited
in the lower place is taken; ids of sequences are unique and otherwise without meaning; an empty table gives no pieces; other
columns aren't looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import _shared as sh
from . import bpe

#: Pieces that wait in a partition, at most.
WAITING = 1024
#: Of an example's ids, those that are its prompt.
PROMPT_SHARE = 0.25
SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, loss_tokens bigint, sequence_id bigint, offset bigint"


class Piece(NamedTuple):
    """Ids of an example from `start` on; of the example's `total` ids those from `low` to `high` bear loss."""

    key: Any
    total: int
    low: int
    high: int
    start: int
    ids: np.ndarray

    def loss(self) -> int:
        return max(0, min(self.start + len(self.ids), self.high) - max(self.start, self.low))

    def part(self, start: int, end: int) -> Piece:
        return self._replace(start=start, ids=self.ids[start - self.start : end - self.start])

    def cut(self, room: int, loss_room: int) -> tuple[Piece, Piece | None]:
        """The longest piece from the start on within both rooms, and the rest."""
        end = self.start + min(len(self.ids), room)
        first = max(self.start, self.low)
        if min(end, self.high) - first > loss_room:
            end = first + loss_room
        last = self.start + len(self.ids)
        return self.part(self.start, end), self.part(end, last) if end < last else None


class Packer:
    """Packs pieces into sequences; rows are the results."""

    def __init__(self, tokens: int, segments: int, loss: int, first_sequence: int, waiting: int = WAITING) -> None:
        self.limits, self.sequence, self.most = (tokens, segments, min(loss, tokens)), first_sequence, waiting
        self.waiting: list[Piece] = []
        #: Of each waiting piece its ids, its loss-bearing ids, and its ids before the first of these.
        self.size = np.zeros((3, waiting + 1), np.int64)
        self.rows: list[tuple] = []

    def add(self, key, ids: np.ndarray, low: int, high: int) -> None:
        """Takes an example; its ids from low to high bear loss."""
        tokens, segments, loss = self.limits
        whole = Piece(key, len(ids), low, high, 0, ids)
        if len(ids) <= tokens and whole.loss() <= loss:
            self._wait(whole)
            return
        start, answer, prompt = 0, low, tokens - loss
        while high - answer >= loss and low - start >= prompt and segments > (prompt > 0):
            self._put([whole.part(*x) for x in ((start, start + prompt), (answer, answer + loss)) if x[0] < x[1]])
            start, answer = start + prompt, answer + loss
        while low - start >= tokens:
            self._put([whole.part(start, start + tokens)])
            start += tokens
        for a, b in [(start, len(ids))] if answer == low else [(start, low), (answer, len(ids))]:
            rest = whole.part(a, b) if a < b else None
            while rest:
                piece, rest = rest.cut(tokens, loss)
                self._wait(piece)

    def _wait(self, piece: Piece) -> None:
        # A copy, so that a piece that waits doesn't hold the ids of others.
        self._place(len(self.waiting), piece._replace(ids=piece.ids.copy()))
        if len(self.waiting) >= self.most:
            self._fill()

    def _place(self, k: int, piece: Piece) -> None:
        self.waiting[k:k + 1] = [piece]
        self.size[:, k] = len(piece.ids), piece.loss(), min(max(0, piece.low - piece.start), len(piece.ids))

    def _take(self, k: int) -> Piece:
        """Takes waiting piece k; the last one moves to its place."""
        piece, last = self.waiting[k], self.waiting.pop()
        if k < len(self.waiting):
            self.waiting[k] = last
            self.size[:, k] = self.size[:, len(self.waiting)]
        return piece

    def _fill(self) -> None:
        """Fills one sequence from what waits."""
        tokens, segments, loss = self.limits
        chosen, left, loss_left = [], tokens, loss
        while self.waiting and left and len(chosen) < segments:
            size, bears, before = self.size[:, : len(self.waiting)]
            score = size * (left / tokens**2) + bears * (loss_left / loss**2) + (segments - len(chosen)) / segments**2
            score[(size > left) | (bears > loss_left)] = -1
            k = int(score.argmax())
            if score[k] < 0:  # none fits
                gives = np.minimum(np.where(bears > 0, before + loss_left, size), left)
                k = int(gives.argmax())
                if gives[k] <= 0:
                    break
                piece, rest = self.waiting[k].cut(left, loss_left)
                self._place(k, rest)
            else:
                piece = self._take(k)
            chosen.append(piece)
            left -= len(piece.ids)
            loss_left -= piece.loss()
        if left:
            self._deal(chosen)
        else:
            self._put(chosen)

    def _put(self, pieces: list[Piece]) -> None:
        offset = 0
        for p in pieces:
            n = len(p.ids)
            self.rows.append((p.key, p.start, n, zlib.crc32(p.ids), p.total, p.loss(), self.sequence, offset))
            offset += n
        self.sequence += 1

    def finish(self) -> None:
        while self.waiting:
            self._fill()

    def _deal(self, pieces: list[Piece]) -> None:
        """Puts pieces that don't fill a sequence into sequences of powers of two."""
        left = sum(len(p.ids) for p in pieces)
        pieces = pieces[::-1]
        while left:
            room, own = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                piece, rest = pieces.pop().cut(room, room)
                own.append(piece)
                room -= len(piece.ids)
                if rest:
                    pieces.append(rest)
            self._put(own)

    def flush(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _batch(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    names = ["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", bears_loss_col: str | None = None, end_id: int = 1, max_tokens: int = 2048, max_segments: int = 64, max_loss: int = 1792, prompt_share: float = PROMPT_SHARE) -> DataFrame:
    """A row for each piece of each row's ids (of its text, then end_id): doc_id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset.

    prompt_share: of the ids of a text, so many of the first (rounded down) bear no loss. bears_loss_col: a boolean column; no id of a
    row where it is false or null bears loss. None: all rows' do.
    """
    columns = [id_col, text_col, *([bears_loss_col] if bears_loss_col else [])]
    if max_tokens < 1 or max_segments < 1 or max_loss < 1:
        raise ValueError("limits are 1 at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.from_json(vocabulary)
        packer = Packer(max_tokens, max_segments, max_loss, TaskContext.get().partitionId() << 33)
        kind = pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            for part in sh.slices(batch, 1, bpe.SLICE_BYTES):
                ids, counts = encoder(part.column(1))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, np.uint32(end_id)).astype("<u4", copy=False)
                ends += np.arange(1, len(ends) + 1)
                low = np.floor(counts * prompt_share).astype(np.int64)
                if bears_loss_col:
                    low = np.where(pc_true(part.column(2)), low, counts)
                for key, end, n, a in zip(part.column(0).to_pylist(), ends.tolist(), counts.tolist(), low.tolist(), strict=True):
                    packer.add(key, ids[end - n - 1 : end], a, n)
                yield _batch(packer.flush(), kind)
        packer.finish()
        yield _batch(packer.flush(), kind)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(*columns).mapInArrow(sh.frugal(run, "bpe"), f"doc_id {kind}, {SCHEMA}")


def pc_true(column: pa.Array) -> np.ndarray:
    return column.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
