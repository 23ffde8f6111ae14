"""Similarity join on sets of word n-grams: rare-first prefixes with length, positional and suffix filters, verified once.

How the work is laid out:

1. `signatures`: every text becomes the set of its hashed n-grams; rows keep only its size and a 64-bit key of the set, so equal
   sets are one class from here on. N-grams that fill a share of all texts are listed on the side (a bounded list).
2. `shared_grams`: classes send their n-grams, packed and sorted, to buckets of the hash space. A bucket counts in how many
   classes each n-gram is and answers only for those in two or more: no other n-gram can be part of an intersection.
3. Per class, its shared n-grams in rare-first order. N-grams of one class only come first in that order and match nothing, so
   the prefix is what the rest of it reaches into the shared ones; most classes end here.
4. Prefix n-grams are joined. First rounds link each class with one central class of its prefix lists, which settles groups of
   near copies in as many pairs as they have members. Then the classes of a list that are still apart from its largest
   part are held against the list in blocks of bounded size, and only pairs whose prefixes agree enough come out.
5. Pairs pass the length, positional and suffix filters, are made distinct and verified by intersecting the shared n-grams.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunloom.llm.common import batches_of, ids_and_text, lean, scratch_path, written
from sunloom.llm.components import components

BATCH_BYTES = 4 << 20
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: n-grams are known by 48 bits of their hash from step 2 on
GRAM_BITS = 48
#: n-grams that a task packs together, and that a bucket holds on average
CHUNK_GRAMS = 1 << 21
BUCKET_GRAMS = 3 << 20
#: rows of a prefix list that are compared at a time
BLOCK_ROWS = 1024
#: n-grams in more classes than this come last in an order of their own
MOST_CLASSES = (1 << 15) - 1
#: fixed pivots of the suffix filter: the hash space in so many ranges
RANGES = 16


@dataclass(frozen=True)
class JoinConfig:
    words: int = 5
    #: two sets link when 100 * intersection >= percent * union
    percent: int = 75
    #: an n-gram in at least this share of all classes is common: it is kept out of the buckets
    common_share: float = 0.005

    def least_shared(self, n):
        """Of a set of n, so many n-grams must be shared for any link."""
        return -(-self.percent * n // 100)

    def links(self, inter, n, m):
        return (100 + self.percent) * inter >= self.percent * (n + m)


def gram_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; of the whole sequence if it is shorter; empty without words."""
    import xxhash

    parts = (text or "").encode().translate(LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    span = min(words, len(parts))
    mixed = np.full(len(parts) - span + 1, span if span < words else 0, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(span):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : len(parts) - span + 1 + k]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def key_of(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _chunks(batches: Iterator[pa.RecordBatch], config: JoinConfig, meta: list | None):
    """Groups of classes of a task: (keys, sizes, grams of 48 bits sorted, index of the class of each)."""
    keys: list[int] = []
    sets: list[np.ndarray] = []
    seen: set[int] = set()
    held = 0

    def packed():
        sizes = np.array([len(s) for s in sets], np.uint32)
        grams = np.concatenate(sets) >> np.uint64(64 - GRAM_BITS)
        owner = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
        order = np.argsort(grams, kind="stable")
        return np.array(keys, np.int64), sizes, grams[order], owner[order]

    for batch in batches_of(batches, 1, BATCH_BYTES):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            grams = gram_set(text, config.words)
            key = key_of(grams)
            if meta is not None:
                meta.append((doc, key, len(grams)))
            if len(grams) and key not in seen:
                seen.add(key)
                keys.append(key)
                sets.append(grams)
                held += len(grams)
            if held >= CHUNK_GRAMS:
                yield packed()
                keys, sets, seen, held = [], [], set(), 0
    if sets:
        yield packed()
    elif meta:
        yield None


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(values)))


def signatures(docs: DataFrame, config: JoinConfig) -> DataFrame:
    """(common, doc_id, key, n): a row per document (common false), and rows (true, null, n-gram, classes) of a task's common n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meta: list[tuple] = []
        for chunk in _chunks(batches, config, meta):
            rows = [(False, *m) for m in meta]
            meta.clear()
            if chunk is not None:
                keys, _, grams, _ = chunk
                starts, counts = _runs(grams)
                often = counts >= max(8, config.common_share * len(keys) / 2)
                rows += [(True, None, g, c) for g, c in zip(grams[starts[often]].tolist(), counts[often].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.bool_(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["common", "doc_id", "key", "n"])

    return docs.mapInArrow(lean(run), "common boolean, doc_id long, key long, n long")


def _steps(grams: np.ndarray, base: int) -> bytes:
    """Sorted 48-bit values as differences from `base`: 4 bytes each, or 8 where one is too large."""
    steps = np.diff(grams.astype(np.int64), prepend=np.int64(base))
    return steps.astype(np.uint32 if not len(steps) or steps.max() < 1 << 32 else np.uint64).tobytes()


def _grams(steps: bytes, n: int, base: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, np.uint64 if n and len(steps) == 8 * n else np.uint32).astype(np.int64)) + base


def _short(index: np.ndarray, most: int) -> bytes:
    return index.astype(np.uint16 if most <= 1 << 16 else np.uint32).tobytes()


def _index(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if n and len(raw) == 2 * n else np.uint32).astype(np.int64)


def _base(bucket: int, buckets: int) -> int:
    return -((-bucket << GRAM_BITS) // buckets)


PACKED = [("place", pa.int32()), ("n_grams", pa.int64()), ("keys", pa.binary()), ("sizes", pa.binary()), ("owner", pa.binary()), ("steps", pa.binary()), ("classes", pa.binary())]
PACKED_DDL = "place int, n_grams long, keys binary, sizes binary, owner binary, steps binary, classes binary"


def _pack(place: int, keys, sizes, owner, grams, base: int, classes) -> tuple:
    used, local = np.unique(owner, return_inverse=True)
    return place, len(grams), keys[used].tobytes(), sizes[used].astype(np.uint32).tobytes(), _short(local, len(used)), _steps(grams, base), classes.astype(np.uint32).tobytes()


def _packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), PACKED, strict=True)], [n for n, _ in PACKED])


def _unpack(table: pa.Table, base: int):
    """(grams, keys, sizes, classes) of all postings of a group's rows."""
    out: list[tuple] = []
    for row in table.select([n for n, _ in PACKED]).to_batches():
        for n, keys, sizes, owner, steps, classes in zip(*[row.column(k).to_pylist() for k in range(1, 7)], strict=True):
            at = _index(owner, n)
            out.append((_grams(steps, n, base), np.frombuffer(keys, np.int64)[at], np.frombuffer(sizes, np.uint32)[at], np.frombuffer(classes, np.uint32)))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def shared_grams(docs: DataFrame, config: JoinConfig, buckets: int, common: np.ndarray, common_classes: np.ndarray) -> DataFrame:
    """(key, n, grams): classes of which enough n-grams are shared, those as 8-byte integers (classes, n-gram): sorted, they are
    in rare-first order.

    Common n-grams do not travel through a bucket: their order is known beforehand, and a class sends its own to where its
    answers arrive.
    """
    listed = docs.sparkSession.sparkContext.broadcast((common, common_classes))  # at most ~ 2 / common_share average texts

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, hot_classes = listed.value
        for keys, sizes, grams, owner in _chunks(batches, config, None):
            rows = []
            if len(hot):
                at = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
                is_hot = hot[at] == grams
                mine, whose = grams[is_hot], owner[is_hot]
                dest = keys[whose] % buckets
                order = np.lexsort((mine, dest))
                starts, counts = _runs(dest[order])
                for a, c in zip(starts.tolist(), counts.tolist(), strict=True):
                    part = order[a : a + c]
                    rows.append(_pack(buckets + int(dest[part[0]]), keys, sizes, whose[part], mine[part], 0, hot_classes[at[is_hot][part]]))
                grams, owner = grams[~is_hot], owner[~is_hot]
            edges = np.searchsorted(grams, np.array([_base(b, buckets) for b in range(buckets + 1)], np.uint64))
            for b in range(buckets):
                a, z = int(edges[b]), int(edges[b + 1])
                if a < z:
                    rows.append(_pack(b, keys, sizes, owner[a:z], grams[a:z], _base(b, buckets), np.empty(0, np.uint32)))
                if sum(len(r[4]) + len(r[5]) for r in rows[-8:]) > 8 << 20 or len(rows) >= 256:
                    yield _packed_batch(rows)
                    rows = []
            if rows:
                yield _packed_batch(rows)

    def answer(table: pa.Table) -> pa.Table:
        place = table.column("place")[0].as_py()
        if place >= buckets:  # common n-grams: only handed on
            return table.set_column(0, "place", pa.array([place - buckets] * table.num_rows, pa.int32()))
        grams, keys, sizes, _ = _unpack(table, _base(place, buckets))
        order = np.argsort(grams, kind="stable")
        starts, counts = _runs(grams[order])
        order = order[np.repeat(counts > 1, counts)]
        order = order[np.lexsort((keys[order], grams[order]))]
        grams, keys, sizes = grams[order], keys[order], sizes[order]
        # a class that several tasks have seen counts once
        first = np.append(True, (grams[1:] != grams[:-1]) | (keys[1:] != keys[:-1])) if len(grams) else np.empty(0, bool)
        grams, keys, sizes = grams[first], keys[first], sizes[first]
        starts, counts = _runs(grams)
        classes = np.repeat(counts, counts)
        shared = classes > 1
        grams, keys, sizes, classes = grams[shared], keys[shared], sizes[shared], classes[shared]
        dest = keys % buckets
        order = np.lexsort((grams, dest))
        rows = []
        starts, counts = _runs(dest[order])
        for a, c in zip(starts.tolist(), counts.tolist(), strict=True):
            part = order[a : a + c]
            names, owner = np.unique(keys[part], return_inverse=True)
            size = np.zeros(len(names), np.uint32)
            size[owner] = sizes[part]
            rows.append((int(dest[part[0]]), c, names.tobytes(), size.tobytes(), _short(owner, len(names)), _steps(grams[part], 0), classes[part].astype(np.uint32).tobytes()))
        return pa.Table.from_batches([_packed_batch(rows)] if rows else [], pa.schema(PACKED))

    def gather(table: pa.Table) -> pa.Table:
        grams, keys, sizes, classes = _unpack(table, 0)
        grams |= np.minimum(classes, MOST_CLASSES).astype(np.int64) << GRAM_BITS
        order = np.lexsort((grams, keys))
        grams, keys, sizes = grams[order], keys[order], sizes[order]
        # common n-grams of a class arrive from every task that saw it
        again = np.append(False, (grams[1:] == grams[:-1]) & (keys[1:] == keys[:-1]))
        grams, keys, sizes = grams[~again], keys[~again], sizes[~again]
        starts, counts = _runs(keys)
        enough = counts >= config.least_shared(sizes[starts].astype(np.int64))
        starts, counts = starts[enough], counts[enough]
        return pa.table({
            "key": pa.array(keys[starts], pa.int64()), "n": pa.array(sizes[starts].astype(np.int64), pa.int64()),
            "grams": pa.array([grams[a : a + c].tobytes() for a, c in zip(starts.tolist(), counts.tolist(), strict=True)], pa.binary()),
        })

    sent = docs.mapInArrow(lean(send), PACKED_DDL)
    answered = sent.groupBy("place").applyInArrow(lean(answer), PACKED_DDL)
    return answered.groupBy("place").applyInArrow(lean(gather), "key long, n long, grams binary")


def prefixes(shared: DataFrame, config: JoinConfig) -> DataFrame:
    """(gram, key, n, own): the shared n-grams in each class's prefix, which follow its `own` ones in rare-first order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, n, raw in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                own = n - len(raw) // 8
                count = n - config.least_shared(n) + 1 - own
                out.append((np.frombuffer(raw, np.int64, count), np.full(count, key), np.full(count, n), np.full(count, own)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], ["gram", "key", "n", "own"])

    return shared.select("key", "n", "grams").mapInArrow(lean(run), "gram long, key long, n long, own long")


def prefix_lists(shared: DataFrame, config: JoinConfig) -> DataFrame:
    """Rows of `prefixes` whose n-gram several classes have; of n-grams with the very same classes only one is left.

    N-grams of one passage mostly have the same classes and would only give the same pairs again. Classes of a list are
    told from others by their number and two exclusive-ors of hashes.
    """
    posts = written(prefixes(shared, config), "prefixes")
    same = [F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    lists = posts.groupBy("gram").agg(F.count(F.lit(1)).alias("members"), *same).filter("members > 1")
    kept = lists.groupBy("members", "x1", "x2").agg(F.min("gram").alias("gram")).select("gram")
    return written(posts.join(written(kept, "lists"), "gram"), "prefix-lists")


def _ranges(shared: DataFrame) -> DataFrame:
    """(key, own, ranges): n-grams that no other class has, and the counts of the shared ones by range of the hash space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, own, ranges = [], [], []
            for key, n, raw in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                grams = np.frombuffer(raw, np.int64) & ((1 << GRAM_BITS) - 1)
                keys.append(key)
                own.append(n - len(grams))
                ranges.append(np.bincount(grams >> (GRAM_BITS - 4), minlength=RANGES).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(own, pa.int64()), pa.array(ranges, pa.list_(pa.int32()))], ["key", "own", "ranges"])

    return shared.select("key", "n", "grams").mapInArrow(lean(run), "key long, own long, ranges array<int>")


def filtered(pairs: DataFrame, ranges: DataFrame, config: JoinConfig) -> DataFrame:
    """Pairs (a, b, n_a, n_b) that the suffix filter leaves.

    Linked sets differ in at most n_a + n_b - 2 * (least intersection) n-grams. They differ in all n-grams that only one class
    has, and in each range of the hash space by no less than the difference of the counts.
    """
    pairs = written(pairs, "pairs")
    a, b = (ranges.select(F.col("key").alias(x), F.col("own").alias(f"own_{x}"), F.col("ranges").alias(f"ranges_{x}")) for x in "ab")
    apart = F.aggregate(F.zip_with("ranges_a", "ranges_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    least = F.ceil(config.percent * (F.col("n_a") + F.col("n_b")) / (100 + config.percent))
    kept = pairs.join(a, "a").join(b, "b").filter(F.col("own_a") + F.col("own_b") + apart <= F.col("n_a") + F.col("n_b") - 2 * least)
    return kept.select("a", "b", "n_a", "n_b")


def verified(pairs: DataFrame, shared: DataFrame, config: JoinConfig) -> DataFrame:
    """(a, b, inter) of the pairs that link. All common n-grams of two classes are among their shared ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, n_a, n_b, x, y in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                inter = len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True))
                if config.links(inter, n_a, n_b):
                    rows.append((a, b, inter))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["a", "b", "inter"])

    # written, so that few pairs are known to be few and the sets stay where they are
    pairs = written(pairs, "pairs")
    a, b = (shared.select(F.col("key").alias(x), F.col("grams").alias(f"grams_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "grams_a", "grams_b").mapInArrow(lean(run), "a long, b long, inter long")


def _near_enough(n: str, m: str, config: JoinConfig):
    """Length filter."""
    return (100 * F.least(n, m) >= config.percent * F.greatest(n, m))


def _pivot_links(posts: DataFrame, shared: DataFrame, sizes: DataFrame, ranges: DataFrame, config: JoinConfig) -> DataFrame:
    """Verified links of each class of `posts` (gram, key, n, own) with one central class of its lists.

    The class with the smallest share of own n-grams stands for a list: in a group of near copies it is the one that most
    resemble. Of the classes that stand for its lists, each class is held against the one that most of them agree on.
    """
    central = F.struct((F.col("own") / F.col("n")).alias("share"), "key")
    lists = posts.groupBy("gram").agg(F.min(central).alias("c"), F.count(F.lit(1)).alias("members")).filter("members > 1").select("gram", F.col("c.key").alias("b"))
    agreed = posts.join(written(lists, "lists"), "gram").filter("key <> b").groupBy("key", "b").agg(F.count(F.lit(1)).alias("votes"), F.max("n").alias("n"))
    agreed = agreed.join(sizes, "b").filter(_near_enough("n", "n_b", config))
    best = agreed.groupBy("key").agg(F.max_by(F.struct("b", "n", "n_b"), F.struct("votes", -F.col("b"))).alias("best"))
    pairs = best.select(F.col("key").alias("a"), "best.b", F.col("best.n").alias("n_a"), "best.n_b")
    return written(verified(filtered(pairs, ranges, config), shared, config), "links")


def _open_lists(posts: DataFrame, links: DataFrame) -> DataFrame:
    """Lists that links do not connect yet: (gram, key, n, own, root, main, size, minor); main is the root of a list's largest part."""
    groups = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = written(posts.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "placed")
    parts = placed.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("members"))
    main = parts.groupBy("gram").agg(F.max(F.struct("members", "root")).alias("most"), F.sum("members").alias("size"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    main = main.select("gram", F.col("most.root").alias("main"), "size", (F.col("size") - F.col("most.members")).alias("minor"))
    return written(placed.join(written(main, "main-parts"), "gram"), "open-lists")


#: distinct n-grams of two blocks that are counted at a time
SLICE_GRAMS = 4096


def agreeing(x: list[tuple], y: list[tuple], config: JoinConfig) -> list[tuple]:
    """Pairs (a, b, n_a, n_b) of two blocks of a list, rows (key, n, own, root, in_main, prefix), whose intersection can be large
    enough.

    Positional filter over whole prefixes: up to the end of the shorter-reaching prefix all common n-grams are counted, and
    what follows cannot add more than either set has left. Pairs that links connect already, and one of both orders of a
    pair outside the main part, are left out.
    """
    tokens = [r[5] for r in x] + [r[5] for r in y]
    names, at = np.unique(np.concatenate(tokens), return_inverse=True)
    rows = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    order = np.argsort(at, kind="stable")
    at, rows = at[order], rows[order]
    common = np.zeros((len(x), len(y)), np.float32)
    # so many n-grams at a time: however long prefixes are, the matrices stay of one size
    for first in range(0, len(names), SLICE_GRAMS):
        a, z = np.searchsorted(at, (first, first + SLICE_GRAMS))
        has = np.zeros((len(tokens), min(SLICE_GRAMS, len(names) - first)), np.float32)
        has[rows[a:z], at[a:z] - first] = 1
        common += has[: len(x)] @ has[len(x) :].T
    key, n, own, root, in_main = (np.array([r[k] for r in x + y]) for k in range(5))
    cut = len(x)
    ends = np.array([t[-1] for t in tokens])
    seen_x = np.array([np.searchsorted(t, ends[cut:], side="right") for t in tokens[:cut]])
    seen_y = np.array([np.searchsorted(t, ends[:cut], side="right") for t in tokens[cut:]]).T
    left = np.minimum((n - own)[:cut, None] - seen_x, (n - own)[None, cut:] - seen_y)
    both = n[:cut, None] + n[None, cut:]
    keep = (common > 0) & ((100 + config.percent) * (common.astype(np.int64) + left) >= config.percent * both)
    keep &= (root[:cut, None] != root[None, cut:]) & (in_main[None, cut:] | (key[:cut, None] < key[None, cut:]))
    keep &= 100 * np.minimum(n[:cut, None], n[None, cut:]) >= config.percent * np.maximum(n[:cut, None], n[None, cut:])
    return [(min((key[i], n[i]), (key[cut + j], n[cut + j])), max((key[i], n[i]), (key[cut + j], n[cut + j]))) for i, j in np.argwhere(keep)]


def _block_pairs(open_lists: DataFrame, shared: DataFrame, config: JoinConfig) -> DataFrame:
    """Distinct pairs (a, b, n_a, n_b) that the prefixes of open lists leave.

    The classes outside a list's main part are dealt into blocks, and so are all its classes; a block of either kind meets
    every block of the other, so that no task holds more than two blocks however long a list is.
    """

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n, raw = (batch.column(k).to_pylist() for k in range(3))
            heads = [r[: 8 * (m - config.least_shared(m) + 1 - (m - len(r) // 8))] for m, r in zip(n, raw, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(heads, pa.binary())], ["key", "prefix"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        blocks: tuple[list[tuple], list[tuple]] = ([], [])
        found: list[tuple] = []

        def close() -> None:
            if blocks[0] and blocks[1]:
                found.extend(agreeing(*blocks, config))
            blocks[0].clear()
            blocks[1].clear()

        def out() -> pa.RecordBatch:
            rows = [(int(a), int(b), int(n), int(m)) for (a, n), (b, m) in found]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["a", "b", "n_a", "n_b"])

        for batch in batches:
            for gram, i, j, small, key, n, own, root, in_main, head in zip(*[batch.column(k).to_pylist() for k in range(10)], strict=True):
                if (gram, i, j) != group:
                    close()
                    group = (gram, i, j)
                blocks[0 if small else 1].append((key, n, own, root, in_main, np.frombuffer(head, np.int64)))
                if len(found) >= 100_000:
                    yield out()
        close()
        if found:
            yield out()

    heads = shared.select("key", "n", "grams").mapInArrow(lean(prefix), "key long, prefix binary")
    rows = open_lists.join(heads, "key").withColumn("in_main", F.col("root") == F.col("main"))
    deal = lambda size: F.pmod(F.xxhash64("key", F.lit(1)), F.ceil(size / BLOCK_ROWS)).cast("int")
    every = lambda size: F.sequence(F.lit(0), F.ceil(size / BLOCK_ROWS).cast("int") - 1)
    columns = ["key", "n", "own", "root", "in_main", "prefix"]
    small = rows.filter(~F.col("in_main")).select("gram", deal(F.col("minor")).alias("i"), F.explode(every(F.col("size"))).alias("j"), F.lit(True).alias("small"), *columns)
    large = rows.select("gram", F.explode(every(F.col("minor"))).alias("i"), deal(F.col("size")).alias("j"), F.lit(False).alias("small"), *columns)
    dealt = small.unionByName(large).repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j")
    return dealt.mapInArrow(lean(compare), "a long, b long, n_a long, n_b long").distinct()


def candidate_links(shared: DataFrame, config: JoinConfig) -> DataFrame:
    """Verified links (a, b, inter) between classes, enough of them to connect whatever is connected."""
    posts = prefix_lists(shared, config)
    ranges = written(_ranges(shared), "ranges")
    sizes = shared.select(F.col("key").alias("b"), F.col("n").alias("n_b"))
    links = _pivot_links(posts, shared, sizes, ranges, config)
    # what the first central classes leave may have centres of its own
    apart = _open_lists(posts, links).filter("root <> main").select("gram", "key", "n", "own")
    links = links.unionByName(_pivot_links(apart, shared, sizes, ranges, config))
    pairs = _block_pairs(_open_lists(posts, links), shared, config)
    return links.unionByName(written(verified(filtered(pairs, ranges, config), shared, config), "links"))


def ngram_components(docs: DataFrame, config: JoinConfig = JoinConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for every row.

    class_id is the smallest doc_id with the same set, component_id the smallest reachable by links, itself included. Links are
    those of the exact similarity join; between sets that links already connect not every pair is looked at. A null, empty or
    blank text has no n-grams and links with nothing, other blank texts included. Rows that share a doc_id count as one
    document of several texts; a row without id takes the component of its text, null if it is alone. An empty table gives
    an empty result. Sets are told apart by 64-bit keys and 48-bit n-gram hashes: at 10^8 distinct texts the odds that any two
    sets share a key are about 1 in 4000, and a wrong count in a verified pair is rarer than one in 10^8 pairs.
    """
    spark = docs.sparkSession
    rows = ids_and_text(docs, key, text)
    signed = written(signatures(rows, config), "signatures")
    meta = signed.filter("not common").select("doc_id", "key", F.col("n").alias("n_shingles"))
    classes = written(meta.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.max("n_shingles").alias("n_shingles")), "classes")
    total = classes.agg(F.sum("n_shingles").alias("grams"), F.count(F.lit(1)).alias("classes")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total["grams"] or 0) // BUCKET_GRAMS))
    # bounded: an average text's n-grams times 1 / common_share
    often = signed.filter("common").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(64, config.common_share * total["classes"])).orderBy("key").collect()
    common, common_classes = np.array([r["key"] for r in often], np.int64), np.array([r["n"] for r in often], np.uint32)
    shared = written(shared_grams(rows, config, buckets, common.astype(np.uint64), common_classes), "shared-grams")
    links = candidate_links(shared, config)
    ids = classes.filter("class_id is not null").select("key", "class_id")
    named = links.join(ids.select(F.col("key").alias("a"), F.col("class_id").alias("u")), "a").join(ids.select(F.col("key").alias("b"), F.col("class_id").alias("v")), "b").select("u", "v")
    groups = components(named).select(F.col("node").alias("class_id"), F.col("root").alias("component_id"))
    found = written(classes.select("key", "class_id").join(groups, "class_id", "left"), "class-components")
    joined = meta.join(found, "key", "left")
    alone = F.col("n_shingles") == 0
    own = F.when(alone, F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", F.coalesce(own, F.col("class_id")).alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component_id", "class_id", "doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, config: JoinConfig = JoinConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one document of each component, that with the smallest id; all columns as they were. Rows without id stay."""
    dropped = ngram_components(docs, config, key, text).filter("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    here = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").cast("long").alias("id"))
    return here.join(written(dropped, "dropped"), "id", "left_anti").select("row.*")
