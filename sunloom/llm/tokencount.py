"""Token counts without token ids: pieces are counted once per distinct pre-token and joined to each document's frequencies.

The vocabulary has no piece in which a space follows another character, so its merges never cross the border before a run of
spaces: a text's count is the sum over its pre-tokens (a run of spaces and what follows it up to the next).
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunloom.llm.common import batches_of, ids_and_text, lean, written

#: the character that stands for a space in the vocabulary
SPACE = "▁".encode()
_RUN = re.compile(SPACE + b"(?:" + SPACE + b")*(?:(?!" + SPACE + b").)*", re.DOTALL)
#: distinct pre-tokens that a task counts before it hands them on
HELD = 400_000
#: the commonest pre-tokens whose counts every worker gets (10 bytes each); the others are joined by a shuffle
KNOWN = 1_000_000
BATCH_BYTES = 4 << 20


def pre_tokens(text: str) -> list[bytes]:
    """The pre-tokens of a text, each without the first of its spaces; a text that is not empty has one put in front."""
    data = text.encode()
    if not data:
        return []
    if SPACE not in data:
        parts = data.split(b" ")
        if b"" not in parts:
            return parts
    return [run[len(SPACE) :] for run in _RUN.findall(SPACE + data.replace(b" ", SPACE))]


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_counts(model, words: list[bytes]) -> list[int]:
    """Pieces of each pre-token. The model puts the missing space in front again; of nothing it would make nothing."""
    return [len(ids) if word else 1 for word, ids in zip(words, model.encode([w.decode() for w in words], num_threads=1), strict=True)]


def counted_pre_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(hash, n, pieces) of every distinct pre-token of all texts: n times found, made of so many pieces."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return batch

        for batch in batches_of(batches, 1, BATCH_BYTES):
            for text in batch.column(1).to_pylist():
                found.update(pre_tokens(text))
            if len(found) >= HELD:
                yield out()
        if found:
            yield out()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches_of(batches, 0, 256 << 10):
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([_hash(w) for w in words], pa.int64()), batch.column(1), pa.array(piece_counts(model, words), pa.int64())], ["hash", "n", "pieces"])

    words = docs.mapInArrow(lean(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.mapInArrow(lean(pieces), "hash long, n long, pieces long")


def commonest(pieces: DataFrame, most: int = KNOWN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and piece counts of the pre-tokens found often enough that there are at most `most` of them."""
    # how many pre-tokens are found so often: as many rows as there are different frequencies, so by powers above a thousand
    step = F.when(F.col("n") < 1000, F.col("n")).otherwise(F.floor(1000 + 100 * F.log2(F.col("n") / 1000)).cast("long"))
    total, least = 0, None
    for r in pieces.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rows = pieces.filter(step >= least).select("hash", "pieces").toArrow()
    hashes, counts = (rows.column(k).to_numpy() for k in range(2))
    order = np.argsort(hashes)
    return hashes[order], counts[order].astype(np.int16 if not len(counts) or counts.max() < 1 << 15 else np.int64)


def _frequencies(docs: DataFrame, known: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """A row (row, doc_id, n_bytes, null, tokens of known pre-tokens) per document, and a row (row, null, null, hash, times) for
    each of its other pre-tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # at most KNOWN entries of 10 to 16 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = shared.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches_of(batches, 1, BATCH_BYTES):
            times = [Counter(pre_tokens(t)) for t in batch.column(1).to_pylist()]
            place = {w: k for k, w in enumerate(set().union(*times))}
            h = np.fromiter(map(_hash, place), np.int64, len(place))
            worth = np.full(len(h), -1, np.int64)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                here = hashes[at] == h
                worth[here] = counts[at[here]]
            rare: list[np.ndarray] = []
            sums = []
            for k, c in enumerate(times):
                index = np.fromiter(map(place.__getitem__, c), np.int64, len(c))
                n = np.fromiter(c.values(), np.int64, len(c))
                w = worth[index]
                sums.append(int(np.dot(w, n) + n[w < 0].sum()))
                lone = w < 0
                rare.append(np.stack([np.full(int(lone.sum()), row + k), h[index[lone]], n[lone]]))
            docs_here, (rows, words, n) = len(times), np.concatenate(rare, axis=1) if rare else np.empty((3, 0), np.int64)
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(range(row, row + docs_here), pa.int64()), pa.array(rows)]), pa.concat_arrays([batch.column(0), none]),
                pa.concat_arrays([batch.column(2), none]), pa.concat_arrays([pa.nulls(docs_here, pa.int64()), pa.array(words)]),
                pa.concat_arrays([pa.array(sums, pa.int64()), pa.array(n)]),
            ], ["row", "doc_id", "n_bytes", "hash", "n"])
            row += docs_here

    rows = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(lean(run), "row long, doc_id long, n_bytes long, hash long, n long")


def token_counts(docs: DataFrame, path: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; n_tokens is what the model gives for the whole text.

    `path` is a sentencepiece model without pieces that hold a space after another character. A null text is empty: no bytes,
    no tokens. Repeated rows and null ids are counted row by row; an empty table gives an empty result. Pre-tokens meet
    by 64-bit hashes. Frequencies and piece counts of the corpus are aggregated with a partial sum in each task; only the rarer
    pre-tokens of a document are shuffled.
    """
    rows = ids_and_text(docs, key, text)
    pieces = written(counted_pre_tokens(rows, path), "pre-tokens")
    found = written(_frequencies(rows, commonest(pieces)), "frequencies")
    rare = found.filter("hash is not null").select("row", "hash", "n")
    added = rare.join(pieces.select("hash", "pieces"), "hash").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("added"))
    whole = found.filter("hash is null").join(added, "row", "left").withColumn("n_tokens", F.col("n") + F.coalesce("added", F.lit(0)))
    return whole.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
