"""Sum-of-squares online packing of token sequences.

A document's ids are cut into full windows and one rest.  Rests arrive online:
with N[h] the number of open windows filled to level h, a rest of size s goes
to the level (an empty window counts as level 0) that makes the sum of squares
of all N[h] smallest, so open windows stay spread over the levels and nearly
every later rest finds a partner that closes one.  Full windows don't count.

Each task packs its own input partition in one pass: encoding and packing need
no shuffle, and a lost executor repeats only its tasks.  The level array has
``window`` entries.  Open windows are emptied into each other (documents may
be cut freely) when more than ``MOST_OPEN`` are open, and at the task's end; the
one window then left is cut at powers of two, which need no padding.

Defined cases: a null text is the empty text (one end id); repeated rows and null
keys are packed like any other; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import key_and_text, lean
from .tokens import encoder, tokenizer_path, with_end

WINDOW = 1024
#: Open windows a task keeps at most: bounds its memory (16 MB of ids) and the search.
MOST_OPEN = 4096
END_ID = 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: A piece in an open window: doc_id, start, ids as bytes, tokens of its document.
Piece = tuple[int | None, int, bytes, int]


class LevelArray:
    """Open windows by fill level, with their number per level in an array."""

    def __init__(self, window: int):
        self.window, self.open = window, 0
        self.count = np.zeros(window, np.int64)
        self.held: list[list[list[Piece]]] = [[] for _ in range(window)]

    def best(self, size: int) -> int:
        """The level whose use for ``size`` keeps the sum of squares least.

        Moving a window from level h to h + s changes the sum by
        2 (N[h + s] - N[h]) + 2; opening one adds 2 N[s] + 1; closing one at
        h = window - s takes off 2 N[h] - 1.  Ties go to the fullest level."""
        n, w = self.count, self.window
        gain = 2 * (n[size:] - n[:w - size]) + 2
        gain[n[:w - size] == 0] = np.iinfo(np.int64).max
        gain[0] = 2 * n[size] + 1
        h = len(gain) - 1 - int(np.argmin(gain[::-1]))
        close = w - size
        return close if n[close] and 1 - 2 * n[close] <= gain[h] else h

    def place(self, size: int, piece: Piece) -> list[Piece] | None:
        """Put a piece of under a window; the window's pieces if that fills it."""
        level = self.best(size)
        if level:
            pieces = self.held[level].pop()
            self.count[level] -= 1
            self.open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        self.held[level + size].append(pieces)
        self.count[level + size] += 1
        self.open += 1
        return None

    def emptied(self) -> list[Piece]:
        """The pieces of all open windows, which are closed."""
        out = [p for level in self.held for pieces in level for p in pieces]
        self.__init__(self.window)
        return out


def refill(pieces: list[Piece], window: int, width: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Cut pieces freely into full windows; and what is left."""
    full: list[list[Piece]] = []
    now: list[Piece] = []
    room = window
    for doc, start, ids, total in pieces:
        while ids:
            part = ids[:room * width]
            now.append((doc, start, part, total))
            start, ids, room = start + len(part) // width, ids[len(part):], room - len(part) // width
            if not room:
                full.append(now)
                now, room = [], window
    return full, now


def power_windows(pieces: list[Piece], window: int, width: int) -> list[list[Piece]]:
    """Sequences whose lengths are powers of two, from under a window of ids."""
    out, left = [], sum(len(p[2]) for p in pieces) // width
    while left:
        size = 1 << (left.bit_length() - 1)
        full, now = refill(pieces, size, width)
        out.append(full[0])
        pieces, left = [p for part in [*full[1:], now] for p in part], left - size
    return out


def _packer(path: str, window: int):
    width = 4

    def run(batches):
        from pyspark import TaskContext

        enc, levels, step = encoder(path, width), LevelArray(window), window * width
        serial = TaskContext.get().partitionId() << 40
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        out: list[list] = [[] for _ in names]

        def close(pieces: list[Piece]) -> None:
            nonlocal serial
            at = 0
            for doc, start, ids, total in pieces:
                n = len(ids) // width
                for column, v in zip(out, (doc, start, n, zlib.crc32(ids), total, serial, at), strict=True):
                    column.append(v)
                at += n
            serial += 1

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)
            for c in out:
                c.clear()
            return batch

        for b in batches:
            for k in range(0, b.num_rows, 2048):
                some = b.slice(k, 2048)
                ids, counts = enc.batch(some.column(1))
                raw, begin = with_end(ids, counts, END_ID).tobytes(), 0
                for doc, total in zip(some.column(0).to_pylist(), (counts + 1).tolist(), strict=True):
                    end, whole = begin + total * width, begin + total * width // step * step
                    for at in range(begin, whole, step):
                        close([(doc, (at - begin) // width, raw[at:at + step], total)])
                    if whole < end:
                        done = levels.place((end - whole) // width, (doc, (whole - begin) // width, raw[whole:end], total))
                        if done:
                            close(done)
                    begin = end
                if levels.open > MOST_OPEN:
                    full, rest = refill(levels.emptied(), window, width)
                    for pieces in full:
                        close(pieces)
                    if rest:
                        held = sum(len(p[2]) for p in rest) // width
                        levels.held[held].append(rest)
                        levels.count[held] += 1
                        levels.open += 1
            if out[0]:
                yield flush()
        full, rest = refill(levels.emptied(), window, width)
        for pieces in [*full, *power_windows(rest, window, width)]:
            close(pieces)
        yield flush()

    return run


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A sequence shorter than ``window`` has a power of two as its length."""
    return key_and_text(docs, key, text).mapInArrow(lean(_packer(path or tokenizer_path(), window)), SCHEMA)
