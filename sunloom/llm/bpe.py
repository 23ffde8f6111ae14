"""Byte-level BPE by walking the trie of distinct words: the state of a prefix is its last token, shared by all words below it."""
from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from sunloom.llm.common import batches_of, ids_and_text, lean

#: bytes of pieces, and of words, that a worker remembers between batches; beyond it keeps those of the batch at hand
REMEMBERED_BYTES = 64 << 20
#: about what two short objects and their place in a dict take besides their content
ENTRY_BYTES = 200
#: pairs of tokens of which a worker remembers whether they stay apart
REMEMBERED_PAIRS = 600_000
BATCH_BYTES = 4 << 20
#: characters whose class is the same in every Unicode version; other pieces are cut by the library itself
STEADY = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*").fullmatch
_LOOSE_SPACE = re.compile(r"\s | \s").search
_SPACE = re.compile(r"(?<!\s) (?!\s)")


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in the vocabulary file: printable Latin-1 stands for itself, the rest is moved up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(moved)}


def entry_bytes(memo: dict, names) -> int:
    """About what these names and their ids take in a memo."""
    return sum(map(len, names)) + sum(map(len, map(memo.__getitem__, names))) + ENTRY_BYTES * len(names)


class PieceMemo:
    """Cuts texts at spaces that always begin a pre-token and remembers the ids of the pieces; a subclass encodes new ones."""

    def __init__(self, special: dict[str, int]):
        self.special = special
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.forget()

    def forget(self) -> None:
        """Give back what was remembered: a worker may go on to other work."""
        self.pieces: dict[str, bytes] = {}
        self._held = 0

    def room(self) -> int:
        """Bytes of pieces to remember."""
        return REMEMBERED_BYTES

    def _learn(self, new: set[str]) -> None:
        raise NotImplementedError

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text, as little-endian 32-bit integers; strings of special tokens are those tokens."""
        cut: list[list] = []
        for text in texts:
            parts: list = []
            for k, stretch in enumerate(self._special.split(text) if self._special else (text,)):
                if k % 2:
                    parts.append(self.special[stretch].to_bytes(4, "little"))
                elif stretch:
                    # a space between two other characters always begins a pre-token
                    first, *rest = _SPACE.split(stretch) if _LOOSE_SPACE(stretch) else stretch.split(" ")
                    parts.append((first, [" " + p for p in rest]))
            cut.append(parts)
        if self._held > self.room():
            # pieces that this batch has again are the frequent ones
            again = {p for parts in cut for x in parts if type(x) is tuple for p in (x[0], *x[1])} & self.pieces.keys()
            self.pieces = {p: self.pieces[p] for p in again}
            self._held = entry_bytes(self.pieces, again)
        # one look-up a piece: in a large memory it costs more than anything done with the ids afterwards
        pieces = self.pieces
        held, gaps = [], []
        new: set[str] = set()
        for parts in cut:
            found: list = []
            for x in parts:
                if type(x) is tuple:
                    names = [x[0], *x[1]] if x[0] else x[1]
                    known = list(map(pieces.get, names))
                    gone = [k for k, ids in enumerate(known) if ids is None]
                    if gone:
                        missed = [names[k] for k in gone]
                        new.update(missed)
                        gaps.append((known, gone, missed))
                    found.append(known)
                else:
                    found.append((x,))
            held.append(found)
        if new:
            self._learn(new)
            self._held += entry_bytes(pieces, new)
        for known, gone, missed in gaps:
            for k, name in zip(gone, missed, strict=True):
                known[k] = pieces[name]
        return [b"".join(found[0]) if len(found) == 1 else b"".join(chain.from_iterable(found)) for found in held]


class TrieBpe(PieceMemo):
    """Encoder and decoder for the vocabulary and merges of a byte-level BPE file of the `tokenizers` library."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.bytes_of: dict[int, bytes] = {i: t for t, i in self.ids.items()}
        super().__init__({t["content"]: t["id"] for t in spec["added_tokens"]})
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            left, right = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            a, b = self.ids[left], self.ids[right]
            self.rank[a, b] = r
            self.parts.setdefault(self.ids[left + right], (a, b, r))
        self.longest = max(map(len, self.ids))
        self._edges: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self.usable = {t: i for t, i in self.ids.items() if self._builds_itself(i)}
        self._cut = regex.compile(public_tokenizers.PATTERN).findall
        self._library = Tokenizer.from_file(path)

    def forget(self) -> None:
        super().forget()
        self.words: dict[str, bytes] = {}
        self._held_words = 0
        self._allowed: dict[int, bool] = {}

    def _builds_itself(self, token: int) -> bool:
        """A token that its own bytes never merge into cannot be part of an encoding."""
        if len(self.bytes_of[token]) == 1:
            return True
        if token not in self.parts:
            return False
        a, b, r = self.parts[token]
        return self._builds_itself(a) and self._builds_itself(b) and self._first_crossing(a, b) == r

    def _edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """Tokens that stand at an edge of `token` while it is being merged, each with the rank of the merge that ends it."""
        if (known := self._edges.get((token, right))) is None:
            known, ends = [(token, 1 << 60)], token
            while ends in self.parts:
                a, b, r = self.parts[ends]
                ends = b if right else a
                known.append((ends, r))
            self._edges[token, right] = known
        return known

    def _first_crossing(self, a: int, b: int) -> int | None:
        """Rank of the first merge over the border of two neighbours; None if they stay apart.

        Of equal ranks the leftmost merge goes first: inside `a` that one comes before the border, inside `b` after it.
        """
        found = None
        for x, x_ends in self._edge(a, True):
            for y, y_ends in self._edge(b, False):
                r = self.rank.get((x, y))
                if r is not None and r < x_ends and r <= y_ends and (found is None or r < found):
                    found = r
        return found

    def _stay_apart(self, a: int, b: int) -> bool:
        key = a << 20 | b
        if (known := self._allowed.get(key)) is None:
            if len(self._allowed) >= REMEMBERED_PAIRS:
                self._allowed.clear()
            known = self._allowed[key] = self._first_crossing(a, b) is None
        return known

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(word, its ids as little-endian 32-bit integers) for distinct words.

        Sorted words visit their trie depth first; `last` is the path from the root, with the last token of the encoding of
        every prefix on it. The last token of a longer prefix is the one suffix token that stays apart from the last token
        of what is before it: found once per trie node, whatever the number of words below.
        """
        usable, longest, apart, allowed, length = self.usable, self.longest, self._stay_apart, self._allowed, {}
        path, last = b"", [-1]
        for word in sorted(words):
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for start in range(end - 1, max(0, end - longest) - 1, -1):
                    token = usable.get(word[start:end])
                    if token is None:
                        continue
                    if start == 0:
                        break
                    before = last[start]
                    fits = allowed.get(before << 20 | token)
                    if fits or (fits is None and apart(before, token)):
                        break
                else:
                    raise ValueError(f"no token ends the prefix {word[:end]!r}")
                last.append(token)
            path = word
            ids, at = array("I"), len(word)
            while at:
                token = last[at]
                ids.append(token)
                size = length.get(token)
                if size is None:
                    size = length[token] = len(self.bytes_of[token])
                at -= size
            ids.reverse()
            yield word, ids.tobytes()

    def _cut_piece(self, piece: str) -> list[str]:
        if STEADY(piece):
            return self._cut(piece)
        return [piece[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(piece)]

    def _learn(self, new: set[str]) -> None:
        """Encode the pieces of a batch that are not remembered."""
        cut = {p: self._cut_piece(p) for p in new}
        words = {w for ws in cut.values() for w in ws} - self.words.keys()
        if self._held_words > REMEMBERED_BYTES:
            self.words = {w: self.words[w] for ws in cut.values() for w in ws if w in self.words}
            self._held_words = entry_bytes(self.words, self.words.keys())
        plain = {w.encode(): w for w in words}
        for word, ids in self.encode_words(plain):
            self.words[plain[word]] = ids
        self._held_words += entry_bytes(self.words, words)
        known = self.words
        for p, ws in cut.items():
            self.pieces[p] = known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws])

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters, special tokens their strings."""
        numbers = array("I")
        numbers.frombytes(ids)
        return b"".join(map(self.bytes_of.__getitem__, numbers)).decode("utf-8", "replace")


_LOADED: dict[str, TrieBpe] = {}


def loaded(path: str) -> TrieBpe:
    """One encoder per worker process, with what it remembers: bounded in bytes."""
    if path not in _LOADED:
        _LOADED[path] = TrieBpe(path)
    return _LOADED[path]


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids binary) of every row: the whole text, null as empty, ids as little-endian 32-bit integers.

    Row by row in Arrow batches, no shuffle; repeated rows and null ids come out as they went in. `path` is the place of the
    vocabulary on the workers. A worker holds a few MB of text and about twice `REMEMBERED_BYTES` of words and
    pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches_of(batches, 1, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bpe.encode_texts(batch.column(1).to_pylist()), pa.binary())], ["doc_id", "ids"])

    return ids_and_text(docs, key, text).mapInArrow(lean(run), "doc_id long, ids binary")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches_of(batches, 1, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or b"") for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode again, and digest both, in one pass over each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches_of(batches, 1, BATCH_BYTES):
            ids = bpe.encode_texts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return ids_and_text(docs, key, text).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
