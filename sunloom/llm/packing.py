"""Packing token sequences: full windows are cut off, the tails are dealt out by Karmarkar-Karp multiway differencing."""
from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sunloom.llm.bpe import PieceMemo
from sunloom.llm.common import batches_of, ids_and_text, lean

WINDOW = 1024
#: tails are cut into parts of at most this many tokens, which lets the differencing end near equal sums
PART = 256
#: tails that are packed together
TAILS = 256
BATCH_BYTES = 2 << 20
#: bytes of pieces and ids that a worker remembers between batches and tasks
REMEMBERED_BYTES = 128 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


#: one space in front of characters that are no white space and whose class is the same in every Unicode version
_SPACED = re.compile(r" [\x21-\x7e¡-ɏ]+").fullmatch


class LibraryBpe(PieceMemo):
    """Ids of new pieces from the `tokenizers` library, many pieces to a call."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        super().__init__({t.content: i for i, t in self._library.get_added_tokens_decoder().items()})
        import numpy as np

        size = self._library.get_vocab_size()
        # in the byte alphabet a leading space is written Ġ
        self._opens = np.array([(self._library.id_to_token(i) or "").startswith("Ġ") for i in range(size)])

    def room(self) -> int:
        return REMEMBERED_BYTES

    def _learn(self, new: set[str]) -> None:
        import numpy as np

        # together such pieces are a text in which each begins at a token that opens with the space
        joined, alone = [], []
        for piece in new:
            (joined if _SPACED(piece) else alone).append(piece)
        calls = [joined[i : i + 512] for i in range(0, len(joined), 512)]
        found = self._library.encode_batch_fast(["".join(c) for c in calls] + alone, add_special_tokens=False)
        for pieces, encoding in zip(calls, found, strict=False):
            ids = np.array(encoding.ids, dtype="<u4")
            starts = np.flatnonzero(self._opens[ids])
            raw, ends = ids.tobytes(), np.append(starts[1:], len(ids)) * 4
            for piece, a, b in zip(pieces, (starts * 4).tolist(), ends.tolist(), strict=True):
                self.pieces[piece] = raw[a:b]
        for piece, encoding in zip(alone, found[len(calls) :], strict=True):
            self.pieces[piece] = np.array(encoding.ids, dtype="<u4").tobytes()


def differencing(sizes: list[int], windows: int) -> list[tuple[int, tuple[int, ...]]]:
    """(sum, indices) of each non-empty window after multiway differencing.

    Every size begins as a partition of its own, with all windows but one empty. The two partitions with the widest spreads
    are merged, the largest sums of one onto the smallest of the other, until one is left.
    """
    heap = [(-size, k, [(size, (k,))]) for k, size in enumerate(sizes)]
    heapq.heapify(heap)
    for turn in range(len(sizes), 2 * len(sizes) - 1):
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        free = min(len(a), windows - len(b))  # so many of a's largest sums meet empty windows of b
        small = b[::-1]
        met = len(a) - free
        merged = a[:free] + [(x + y, p + q) for (x, p), (y, q) in zip(a[free:], small, strict=False)] + small[met:]
        merged.sort(reverse=True)
        spread = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, turn, merged))
    return heap[0][2] if heap else []


def near_equal_windows(sizes: list[int], capacity: int) -> list[tuple[int, ...]]:
    """Indices by window: the least window count that holds the total, raised while a window exceeds the capacity."""
    windows = -(-sum(sizes) // capacity)
    while True:
        found = differencing(sizes, windows)
        if not found or found[0][0] <= capacity:
            return [members for _, members in found]
        windows += 1


def packed(docs: DataFrame, path: str, window: int = WINDOW, part: int = PART, tails: int = TAILS, with_ids: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids).

    A document is the ids of its whole text (null: empty) and the id 0. Windows full of one document are sequences of
    their own; the tails of every `tails` documents of a task are cut into parts and packed together, so no document
    meets a shuffle and no task holds more than those tails. sequence_id is the task's number and a count in it, so a task
    that is run again gives its own rows again. Repeated rows and null ids are packed like others; no rows, no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = loaded(path)
        first = TaskContext.get().partitionId() << 36
        used = 0
        rows: list[tuple] = []
        waiting: list[tuple[int | None, int, int, bytes]] = []  # doc_id, start, doc_tokens, ids of a part
        held = 0

        def close() -> None:
            nonlocal used, held
            for members in near_equal_windows([len(w[3]) // 4 for w in waiting], window):
                offset = 0
                for k in members:
                    doc, start, total, ids = waiting[k]
                    rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, first + used, offset, ids if with_ids else None))
                    offset += len(ids) // 4
                used += 1
            waiting.clear()
            held = 0

        for batch in batches_of(batches, 1, BATCH_BYTES):
            for doc, ids in zip(batch.column(0).to_pylist(), library.encode_texts(batch.column(1).to_pylist()), strict=True):
                ids += b"\0\0\0\0"
                total = len(ids) // 4
                full = total // window * window
                for start in range(0, full, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    rows.append((doc, start, window, zlib.crc32(piece), total, first + used, 0, piece if with_ids else None))
                    used += 1
                for start in range(full, total, part):
                    waiting.append((doc, start, total, ids[4 * start : 4 * min(start + part, total)]))
                held += full < total
                if held >= tails:
                    close()
            if rows:
                yield _batch(rows)
                rows = []
        close()
        if rows:
            yield _batch(rows)

    out = ids_and_text(docs, key, text).mapInArrow(lean(run), SCHEMA)
    return out if with_ids else out.drop("ids")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.binary()]
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


_LOADED: dict[str, LibraryBpe] = {}


def loaded(path: str) -> LibraryBpe:
    """One per worker process, with what it remembers: bounded in bytes, so that the worker's other work has room."""
    if path not in _LOADED:
        _LOADED[path] = LibraryBpe(path)
    return _LOADED[path]
