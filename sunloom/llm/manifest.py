"""A Merkle manifest of a dataset: ternary trees of document digests per source below a tree of sources, proofs by octopus multiproof.

A leaf partition is an aligned block of 3^depth leaves of a large source, or a run of small sources next to each other. It knows
its leaves; of everything else its proofs need only the nodes beside the borders of what it can derive, level by level. It lists
their coordinates, fetches each once, derives the shared interior nodes, and expands the proofs of its leaves locally.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.llm.common import written

#: children of a node
FAN = 3
#: levels that a leaf partition derives on its own: 729 leaves
DEPTH = 6
#: the tree whose leaves are the sources' roots; a source's own tree goes by the source's place in the order
SOURCES = -1

_HASH = hashlib.sha256


def joined(digests: list[str]) -> str:
    return _HASH("".join(digests).encode()).hexdigest()


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, tampered): digests of every row as 32 bytes; `tampered` only where tampering changes the text."""
    col = lambda name: F.col(f"`{name}`")
    key, text = col("doc_id").cast("long"), col("text").cast("string")
    digest = lambda body: F.unhex(F.sha2(F.concat(field(key), field(col("source")), field(col("lang")), field(col("n_chars")), field(body)).cast("binary"), 256))
    struck = (F.crc32(key.cast("string").cast("binary")) % 2 == 0) & text.contains("\n")
    return docs.select(
        col("source").cast("string").alias("source"), key.alias("doc_id"), digest(text).alias("leaf"),
        F.when(struck, digest(F.replace(text, F.lit("\n"), F.lit("")))).alias("tampered"),
    )


NUMBERED = "part int, seg long, at long, i long, source string, doc_id long, leaf binary, tampered binary"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count the rows of a sorted task: which source of the task, place in it, place in the task."""
    part, i, seg, at, last = TaskContext.get().partitionId(), 0, -1, 0, None
    for batch in batches:
        segs, ats = [], []
        for source in batch.column(0).to_pylist():
            if seg < 0 or source != last:
                seg, at, last = seg + 1, 0, source
            segs.append(seg)
            ats.append(at)
            at += 1
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * n, pa.int32()), pa.array(segs, pa.int64()), pa.array(ats, pa.int64()), pa.array(range(i, i + n), pa.int64()), *batch.columns], [c.split(" ")[0] for c in NUMBERED.split(", ")]
        )
        i += n


@dataclass(frozen=True)
class Placed:
    """Leaves with their places: (unit, block, rank, pos, doc_id, leaf, tampered); (unit, block) names the leaf partition."""

    rows: DataFrame
    sources: int


def placed(leaves: DataFrame, depth: int) -> Placed:
    """Order leaves by source, doc_id and digest (nulls first) and find every leaf's place in its source without gathering one.

    Tasks hold ranges of the order and number their own rows. One row per task goes to the driver, which adds up where each
    begins: a source may span any number of tasks, and a task any number of sources.
    """
    spark = leaves.sparkSession
    order = [F.col(c).asc_nulls_first() for c in ("source", "doc_id", "leaf")]
    ranged = written(leaves, "leaves").repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = written(ranged.select("source", "doc_id", "leaf", "tampered").mapInArrow(_number, NUMBERED), "numbered")
    sizes = numbered.groupBy("part", "seg").agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source"))
    tasks = sizes.groupBy("part").agg(
        F.max("seg").alias("last"), F.sum("n").alias("rows"), F.max_by("n", "seg").alias("n"),
        F.min_by("source", "seg").alias("head"), F.max_by("source", "seg").alias("tail"),
    )
    bases, rank, run, start, offset, before = [], -1, 0, 0, 0, None
    for r in tasks.orderBy("part").collect():  # bounded: one row per task
        goes_on = rank >= 0 and r["head"] == before
        first = rank if goes_on else rank + 1
        pos = run if goes_on else 0
        begun = start if goes_on else offset
        bases.append((r["part"], first, pos, begun, offset))
        rank = first + r["last"]
        run, start = (pos + r["n"], begun) if r["last"] == 0 else (r["n"], offset + r["rows"] - r["n"])
        offset += r["rows"]
        before = r["tail"]
    # bounded: one row per task
    known = F.broadcast(spark.createDataFrame(bases, "part int, first_rank long, first_pos long, first_start long, offset long"))
    opening = F.col("seg") == 0
    pos = F.col("at") + F.when(opening, F.col("first_pos")).otherwise(0)
    start = F.when(opening, F.col("first_start")).otherwise(F.col("offset") + F.col("i") - F.col("at"))
    leaves_per_block = FAN**depth
    rows = numbered.join(known, "part").select((F.col("first_rank") + F.col("seg")).alias("rank"), pos.alias("pos"), start.alias("start"), "doc_id", "leaf", "tampered")
    block = F.expr(f"pos div {leaves_per_block}")
    # first blocks of sources that begin near each other share a partition: fewer than two blocks of leaves
    unit = F.when(block == 0, F.expr(f"start div {leaves_per_block}")).otherwise(F.col("rank"))
    return Placed(rows.select(unit.alias("unit"), block.alias("block"), "rank", "pos", "doc_id", "leaf", "tampered"), rank + 1)


def shrink(nodes: list[str]) -> list[str]:
    """The next level: every three consecutive nodes, the last run fewer, become their digest."""
    return [joined(nodes[k : k + FAN]) for k in range(0, len(nodes), FAN)]


def spans(table: pa.Table, column: str) -> Iterator[tuple[int, pa.Table]]:
    """Consecutive stretches of a sorted table with one value in `column`."""
    values = table.column(column).to_pylist()
    start = 0
    for k in range(1, len(values) + 1):
        if k == len(values) or values[k] != values[start]:
            yield values[start], table.slice(start, k - start)
            start = k


SEGMENTS = "unit long, block long, rank long, n long, done boolean, digest string"


def leaf_blocks(rows: DataFrame, depth: int) -> DataFrame:
    """What every leaf partition derives alone, one row per source in it: the source's root (`done`) or the block's top node."""

    def derive(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rank", "ascending"), ("pos", "ascending")])
        unit, block = table.column("unit")[0].as_py(), table.column("block")[0].as_py()
        out = []
        for rank, leaves in spans(table, "rank"):
            nodes = [x.hex() for x in leaves.column("leaf").to_pylist()]
            n, done = len(nodes), block == 0 and len(nodes) < FAN**depth
            for _ in range(depth):
                if done and len(nodes) == 1:
                    break
                nodes = shrink(nodes)
            out.append((unit, block, rank, n, done, nodes[0]))
        return _table(out, SEGMENTS)

    return rows.select("unit", "block", "rank", "pos", "leaf").groupBy("unit", "block").applyInArrow(derive, SEGMENTS)


NODES = "tree long, level int, idx long, digest string, state int"
INNER, GOES_ON, TOP = 0, 1, 2


def upper_levels(nodes: DataFrame, level: int, depth: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """All nodes from rows (tree, idx, digest) of one level upwards: ([(tree, level, idx, digest)], [(tree, digest of its top)]).

    A pass takes aligned blocks of 3^depth neighbours `depth` levels up; there are as many passes as the largest tree needs.
    """
    block_size = FAN**depth

    def climber(level: int):
        def climb(table: pa.Table) -> pa.Table:
            table = table.sort_by("idx")
            tree, first, row = table.column("tree")[0].as_py(), table.column("idx")[0].as_py(), table.column("digest").to_pylist()
            alone, up, out = first == 0 and len(row) < block_size, level, []
            while up < level + depth and not (alone and len(row) == 1):
                out += [(tree, up, first + k, x, INNER) for k, x in enumerate(row)]
                row, first, up = shrink(row), first // FAN, up + 1
            out.append((tree, up, first, row[0], TOP if alone else GOES_ON))
            return _table(out, NODES)

        return climb

    store, tops = [], []
    while not nodes.isEmpty():
        blocks = nodes.withColumn("block", F.expr(f"idx div {block_size}"))
        found = written(blocks.groupBy("tree", "block").applyInArrow(climber(level), NODES), "nodes")
        store.append(found.filter(F.col("state") == INNER).drop("state"))
        tops.append(found.filter(F.col("state") == TOP).select("tree", "digest"))
        nodes = found.filter(F.col("state") == GOES_ON).select("tree", "idx", "digest")
        level += depth
    return store, tops


def missing(first: int, last: int, size: int) -> Iterator[tuple[int, int]]:
    """(level, index) of the nodes that a run [first, last) of a tree's `size` leaves lacks to derive the top.

    A level's known run is widened to whole families; what that adds is missing, all above it can be derived.
    """
    level = 0
    while size > 1:
        low, high = first // FAN * FAN, min(-(-last // FAN) * FAN, size)
        yield from ((level, k) for k in (*range(low, first), *range(last, high)))
        first, last, size, level = low // FAN, -(-high // FAN), -(-size // FAN), level + 1


WANTED = "unit long, block long, tree long, level int, idx long"


def coordinates(segments: DataFrame, sources: int, depth: int) -> DataFrame:
    """The nodes every leaf partition has to fetch, each once, and a row (rank, level -1, size) for each of its sources."""

    def union(table: pa.Table) -> pa.Table:
        unit, block = table.column("unit")[0].as_py(), table.column("block")[0].as_py()
        ranks, counts, sizes = (table.column(c).to_pylist() for c in ("rank", "n", "size"))
        out = []
        for rank, n, size in zip(ranks, counts, sizes, strict=True):
            out.append((unit, block, rank, -1, size))
            first = block * FAN**depth
            out += [(unit, block, rank, level, k) for level, k in missing(first, first + n, size)]
        out += [(unit, block, SOURCES, level, k) for level, k in missing(min(ranks), max(ranks) + 1, sources)]
        return _table(out, WANTED)

    sizes = segments.groupBy("rank").agg(F.sum("n").alias("size"))
    return segments.select("unit", "block", "rank", "n").join(sizes, "rank").groupBy("unit", "block").applyInArrow(union, WANTED)


@dataclass(frozen=True)
class Manifest:
    """The trees of a dataset: leaves with places, nodes (tree, level, idx, digest) above the leaf partitions, the one root."""

    leaves: DataFrame
    segments: DataFrame
    nodes: DataFrame
    sources: int
    root: str | None
    depth: int


def build(docs: DataFrame, depth: int = DEPTH) -> Manifest:
    """Hash every row and build the trees; the root of an empty table is None."""
    at = placed(leaf_rows(docs), depth)
    segments = written(leaf_blocks(at.rows, depth), "segments")
    inner, tops = upper_levels(segments.filter(~F.col("done")).select(F.col("rank").alias("tree"), F.col("block").alias("idx"), "digest"), depth, depth)
    subroots = segments.filter("done").select("rank", "digest")
    for top in tops:
        subroots = subroots.unionByName(top.withColumnRenamed("tree", "rank"))
    outer, root = upper_levels(subroots.select(F.lit(SOURCES).cast("long").alias("tree"), F.col("rank").alias("idx"), "digest"), 0, depth)
    nodes = docs.sparkSession.createDataFrame([], "tree long, level int, idx long, digest string")
    for part in inner + outer:
        nodes = nodes.unionByName(part)
    found = [r["digest"] for part in root for r in part.collect()]  # one row
    return Manifest(at.rows, segments, nodes, at.sources, found[0] if found else None, depth)


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _climb(tree: int, first: int, nodes: list[str], size: int, fetched: dict) -> tuple[list[tuple[int, list[str]]], str]:
    """([(index of the first node, nodes in whole families) of each level], top) from a known run and the fetched nodes."""
    levels, level = [], 0
    while size > 1:
        last = first + len(nodes)
        low, high = first // FAN * FAN, min(-(-last // FAN) * FAN, size)
        row = [fetched[tree, level, k] for k in range(low, first)] + nodes + [fetched[tree, level, k] for k in range(last, high)]
        levels.append((low, row))
        nodes, first, size, level = shrink(row), low // FAN, -(-size // FAN), level + 1
    return levels, nodes[0]


def _path(levels: list[tuple[int, list[str]]], idx: int) -> list[tuple[str, str]]:
    """(siblings to the left, siblings to the right) of a leaf's ancestors, level by level."""
    path = []
    for low, row in levels:
        k = idx - low
        begins = k // FAN * FAN
        path.append(("".join(row[begins:k]), "".join(row[k + 1 : begins + FAN])))
        idx //= FAN
    return path


def proofs(manifest: Manifest, siblings: bool = False) -> DataFrame:
    """Every leaf with its root, the digest of its proof and the root that its tampered row folds to; `proof` on request.

    A leaf partition meets its fetched nodes in one co-grouped shuffle; it holds fewer than 2 · 3^depth leaves and a few
    nodes per level. Rows with equal source and doc_id are ordered by digest, so identical rows are leaves of their own;
    a row without doc_id is first in its source and never tampered with. An empty table gives no rows.
    """
    spark, root, sources, depth = manifest.leaves.sparkSession, manifest.root, manifest.sources, manifest.depth
    schema = PROOFS + (", proof array<string>" if siblings else "")
    if root is None:
        return spark.createDataFrame([], schema)

    def expand(leaves: pa.Table, nodes: pa.Table) -> pa.Table:
        leaves = leaves.sort_by([("rank", "ascending"), ("pos", "ascending")])
        fetched, size = {}, {}
        for tree, level, idx, digest in zip(*(nodes.column(c).to_pylist() for c in ("tree", "level", "idx", "digest")), strict=True):
            if level < 0:
                size[tree] = idx
            else:
                fetched[tree, level, idx] = digest
        inner = []
        for rank, rows in spans(leaves, "rank"):
            own = [x.hex() for x in rows.column("leaf").to_pylist()]
            first = rows.column("pos")[0].as_py()
            inner.append((rank, first, own, rows, *_climb(rank, first, own, size[rank], fetched)))
        outer, _ = _climb(SOURCES, inner[0][0], [top for *_, top in inner], sources, fetched)
        out = []
        for rank, first, own, rows, levels, subroot in inner:
            above = _path(outer, rank)
            shared: dict[int, tuple[list[tuple[str, str]], str]] = {}
            for k, (leaf, doc, tampered) in enumerate(zip(own, rows.column("doc_id").to_pylist(), rows.column("tampered").to_pylist(), strict=True)):
                idx = first + k
                family = idx // FAN
                if family not in shared:
                    # the rest of the way is the same for a family
                    rest = _path(levels[1:], family) + above
                    shared = {family: (rest, "".join(a + b for a, b in rest))}
                rest, text = shared[family]
                beside = _path(levels[:1], idx)
                folded = tampered.hex() if tampered is not None else leaf
                for left, right in beside + rest:
                    folded = _HASH((left + folded + right).encode()).hexdigest()
                proof = "".join(a + b for a, b in beside) + text
                row = (doc, leaf, subroot, root, _HASH(proof.encode()).hexdigest(), folded, folded == root)
                out.append((*row, [proof[i : i + 64] for i in range(0, len(proof), 64)]) if siblings else row)
        return _table(out, schema)

    wanted = written(coordinates(manifest.segments, sources, depth), "coordinates")
    found = wanted.filter("level >= 0").join(manifest.nodes, ["tree", "level", "idx"])
    fetched = found.unionByName(wanted.filter("level < 0").withColumn("digest", F.lit(None).cast("string")))
    return manifest.leaves.groupBy("unit", "block").cogroup(fetched.groupBy("unit", "block")).applyInArrow(expand, schema)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.table({n: pa.array(c, _KINDS[t]) for c, (n, t) in zip(columns, fields, strict=True)})


def manifest_proofs(docs: DataFrame, depth: int = DEPTH, siblings: bool = False) -> DataFrame:
    """Build the trees over doc_id, source, lang, n_chars and text of every row and prove each leaf; other columns are not read."""
    return proofs(build(docs, depth), siblings)
