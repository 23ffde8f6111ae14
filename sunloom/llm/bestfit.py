"""Best-fit packing in levels: tasks pack their own documents, bins that stay underfull are items of the next, coarser level."""
from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunloom.llm.common import batches_of, ids_and_text, lean, written

WINDOW = 4096
#: a bin with at most this many free places is emitted as it is
SLACK = 32
#: tails of documents that a task packs together
CHUNK = 65_536
#: underfull bins that one group of a level packs together
GROUP = 100_000
#: groups of a level that make one group of the next
FAN = 8
#: a level that saves less than this share of its bins is the last one
LEAST_SAVED = 0.001
BATCH_BYTES = 2 << 20
#: bytes of words and ids that a worker remembers between batches and tasks
REMEMBERED_BYTES = 96 << 20
#: about what two short objects and their place in a dict take besides their content
_ENTRY_BYTES = 200
#: words of letters that stay one lower-case letter each: the library makes one run of tokens of them, closed by a word end
_PLAIN_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: such a word between ASCII marks (no apostrophe: it may take letters with it), which are runs of tokens of their own
_MARKED_WORD = re.compile("([!-&(-/:-@[-`{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)").fullmatch
_END = b"\x01\0\0\0"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, fill int"
MOVES = "bin long, parent long, shift long, fill int, grp long"


class WordBpe:
    """Ids of whole texts by the `tokenizers` library, found once per word while its memory lasts.

    For vocabularies that drop white space and never let a token cross it: the words between spaces and line feeds are then
    encoded alone, special tokens among them as the library does by default. `fits` says whether a file is of that kind.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        size = self._library.get_vocab_size()
        self._closes = np.array([(self._library.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        # the library finds these strings before it cuts words
        self._strings = [t.content for t in self._library.get_added_tokens_decoder().values()]
        probe = self._library.encode("A À", add_special_tokens=False).ids
        self._folds = probe == self._library.encode("a à", add_special_tokens=False).ids
        self._room = remembered
        self._used = 0
        self._ids: dict[str, bytes] = {"": b""}

    @staticmethod
    def fits(path: str) -> bool:
        """No token holds white space, words are closed by a mark, and a space between two words changes neither."""
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        ids = lambda text: library.encode(text, add_special_tokens=False).ids
        probes = ["a", "Won't", "été", "12", "#*", "ab12,", "日本", "\u0301x", *(t.content for t in library.get_added_tokens_decoder().values())]
        return all(ids(x + gap + y) == ids(x) + ids(y) for x in probes for y in probes for gap in (" ", "\n", "  \n "))

    def _special(self, text: str) -> bool:
        return any(x in text for x in self._strings)

    def _folded(self, text: str) -> str:
        """The text in lower case where that is sure to give the same ids: one byte to a character, no special string arises."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        lower = text.lower()
        return text if self._special(lower) else lower

    def _learn(self, new: set[str], special: bool) -> None:
        """Add the ids of new words; one between marks is put together from the word and the marks."""
        import numpy as np

        ids = self._ids
        plain, other, marked = [], [], []
        for word in new:
            if (word.isascii() and word.isalpha()) or _PLAIN_WORD(word):
                plain.append(word)
            elif (found := _MARKED_WORD(word)) and not (special and self._special(word)):
                marked.append((word, *found.groups()))
            else:
                other.append(word)
        parts = {x for _, *found in marked for x in found if x not in ids and x not in new}
        for part in parts:
            (plain if _PLAIN_WORD(part) else other).append(part)
        calls = [plain[i : i + 512] for i in range(0, len(plain), 512)]
        found = self._library.encode_batch_fast([" ".join(c) for c in calls] + other, add_special_tokens=False)
        held = 0
        for words, encoding in zip(calls, found, strict=False):
            tokens = np.array(encoding.ids, dtype="<u4")
            ends = (np.flatnonzero(self._closes[tokens]) + 1) * 4
            raw, start = tokens.tobytes(), 0
            held += len(raw)
            for word, end in zip(words, ends.tolist(), strict=True):
                ids[word] = raw[start:end]
                start = end
        for word, encoding in zip(other, found[len(calls) :], strict=True):
            ids[word] = raw = np.array(encoding.ids, dtype="<u4").tobytes()
            held += len(raw)
        for word, before, inner, after in marked:
            ids[word] = raw = ids[before] + ids[inner] + ids[after]
            held += len(raw)
        self._used += held + sum(map(len, new)) + sum(map(len, parts)) + _ENTRY_BYTES * (len(new) + len(parts))

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if self._folds:
            texts = list(map(self._folded, texts))
        cut = [text.replace("\n", " ").split(" ") for text in texts]
        if self._used > self._room:
            # words that this batch has again are the frequent ones
            again = {w for words in cut for w in words} & self._ids.keys()
            self._ids = {"": b""} | {w: self._ids[w] for w in again}
            self._used = sum(_ENTRY_BYTES + len(w) + len(x) for w, x in self._ids.items())
        # one look-up a word: in a large memory it costs more than anything done with the ids afterwards
        held = [list(map(self._ids.get, words)) for words in cut]
        gaps = [[k for k, ids in enumerate(found) if ids is None] for found in held]
        new = {words[k] for words, gone in zip(cut, gaps, strict=True) for k in gone}
        if new:
            self._learn(new, any(map(self._special, texts)))
        for words, found, gone in zip(cut, held, gaps, strict=True):
            for k in gone:
                found[k] = self._ids[words[k]]
        return [b"".join(found) for found in held]


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One per worker process, with the words it remembers: the next task neither reads the file nor learns them again."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def best_fit(sizes: list[int], window: int) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, its place in the bin, fill of each bin): largest items first, each into the fullest bin that takes it.

    Equal sizes keep their order. Open bins are listed by free places; a number whose bits say which lists hold any gives the
    tightest one at once.
    """
    free: dict[int, list[int]] = {}
    some = 0
    bins, places, fills = [0] * len(sizes), [0] * len(sizes), []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size = sizes[k]
        roomy = some >> size
        if roomy:
            room = size + (roomy & -roomy).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                some ^= 1 << room
        else:
            b, room = len(fills), window
            fills.append(0)
        bins[k], places[k] = b, fills[b]
        fills[b] += size
        if size < room:
            free.setdefault(room - size, []).append(b)
            some |= 1 << (room - size)
    return bins, places, fills


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def local_bins(docs: DataFrame, path: str, window: int, chunk: int) -> DataFrame:
    """Level 0, one row per piece: every task encodes its documents and packs their tails, `chunk` of them at a time.

    A bin's number is the task's number and a count in it; `fill` is what the whole bin holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(path)
        made = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        tails: list[tuple] = []

        def pack() -> None:
            nonlocal made
            bins, places, fills = best_fit([t[3] for t in tails], window)
            rows.extend((*t, made + b, at, fills[b]) for t, b, at in zip(tails, bins, places, strict=True))
            made += len(fills)
            tails.clear()

        for batch in batches_of(batches, 1, BATCH_BYTES):
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode_texts(batch.column(1).to_pylist()), strict=True):
                ids += _END
                total = len(ids) // 4
                for piece, start in enumerate(range(0, total, window)):
                    part = ids[4 * start : 4 * (start + window)]
                    row = (doc, piece, start, len(part) // 4, zlib.crc32(part))
                    if row[3] == window:
                        rows.append((*row, made, 0, window))
                        made += 1
                    else:
                        tails.append(row)
                if len(tails) >= chunk:
                    pack()
            if rows:
                yield _columns(rows, PIECES)
                rows.clear()
        pack()
        if rows:
            yield _columns(rows, PIECES)

    return docs.mapInArrow(lean(run), PIECES)


def merge_level(bins: DataFrame, window: int) -> DataFrame:
    """One level over rows (bin, fill, grp): the bins of a group are items of bins of their own.

    Returns where each went: (bin, parent, shift, fill of the parent, grp). The parent is named after the bin at its start.
    """

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by("bin")
        names, sizes = table.column("bin").to_pylist(), table.column("fill").to_pylist()
        group = table.column("grp")[0].as_py()
        at, places, fills = best_fit(sizes, window)
        first = {b: names[k] for k, (b, p) in enumerate(zip(at, places, strict=True)) if p == 0}
        return pa.Table.from_batches([_columns([(names[k], first[b], places[k], fills[b], group) for k, b in enumerate(at)], MOVES)])

    return bins.groupBy("grp").applyInArrow(place, MOVES)


def merged(bins: DataFrame, window: int, slack: int, group: int, fan: int) -> DataFrame | None:
    """(bin, sequence_id, shift) of every underfull bin (bin, fill) after all levels; None if there is nothing to merge.

    Groups are drawn by hash, so each sees all sizes, and are as many as keep a group near `group` bins; `fan` groups make
    one of the next level. The last level is one group, or one that finds next to nothing to join.
    """
    count = bins.count()
    if count < 2:
        return None
    groups = 1
    while groups * group < count:
        groups *= fan
    moves: list[DataFrame] = []
    while True:
        dealt = bins.select("bin", "fill", F.pmod(F.xxhash64("bin", F.lit(len(moves))), F.lit(groups)).alias("grp"))
        level = written(merge_level(dealt, window), "bin-moves")
        moves.append(level)
        bins = level.filter((F.col("shift") == 0) & (F.col("fill") < window - slack)).select(F.col("parent").alias("bin"), "fill")
        left = bins.count()
        if groups == 1 or left > (1 - LEAST_SAVED) * count:
            break
        count, fewer = left, max(1, groups // fan)
        while fewer * group < count:
            fewer *= fan
        groups = min(groups, fewer)
    last = moves[-1].select("bin", F.col("parent").alias("sequence_id"), "shift")
    for level in reversed(moves[:-1]):
        above = last.select(F.col("bin").alias("parent"), "sequence_id", F.col("shift").alias("more"))
        last = level.join(above, "parent", "left").select(
            "bin", F.coalesce("sequence_id", "parent").alias("sequence_id"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")
        )
    return last


def best_fit_packed(
    docs: DataFrame, path: str, window: int = WINDOW, slack: int = SLACK, chunk: int = CHUNK, group: int = GROUP, fan: int = FAN, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece of a document: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A document is the ids of its whole text (null: empty) and the id 1. Only one longer than the window is cut, into full
    windows and a last piece. Every task packs the last pieces of its documents by best fit; bins with at most `slack` free
    places are sequences, the others are items of the next level, whole, until one group of bins is left.

    Texts meet no shuffle; levels move (number, fill) pairs. No task holds more than `chunk` pieces or about `group` bins. All
    rows are packed: repeated rows and null ids like others, no rows give no pieces. Equal sizes are packed in the order
    they arrive, so which documents share a sequence depends on the files' order; other columns are not read. A
    vocabulary whose tokens may cross white space is refused.
    """
    if not WordBpe.fits(path):
        raise ValueError(f"{path}: tokens depend on white space, words cannot be encoded alone")
    pieces = written(local_bins(ids_and_text(docs, key, text), path, window, chunk), "bins")
    underfull = F.col("fill") < window - slack
    moves = merged(pieces.filter(underfull & (F.col("place") == 0)).select("bin", "fill"), window, slack, group, fan)
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if moves is None:
        return pieces.select(*out, F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    done = pieces.filter(~underfull).select(*out, F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    moved = pieces.filter(underfull).join(moves, "bin").select(*out, "sequence_id", (F.col("place") + F.col("shift")).alias("offset"))
    return done.unionByName(moved)
