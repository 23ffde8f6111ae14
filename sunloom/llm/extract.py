"""Main text of web pages by a tree-structured model: blocks are nodes, sum-product gives each its probability of content."""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.llm.common import batches_of
from sunloom.llm.pagetree import Block, labelled_page, parse

BATCH_BYTES = 4 << 20
#: labelled pages that a model is learned from by default
LABELLED_PAGES = 2000


#: what a block can be: something around the article, a part of the page that is not content, content
OUTER, OTHER, CONTENT = range(3)
STATES = range(3)


LISTS = frozenset(("ul", "ol"))
#: elements that sites give names to
GROUPS = frozenset("div section main article aside header footer nav form".split())


def features(blocks: list[Block], runs: list[tuple[int, str]]) -> list[list[tuple[str, str]]]:
    """(kind, value) of what the model sees of each block by itself.

    A list is seen as a whole: its items say the same thing again, so their tags, lengths and links count once, as the list's.
    """
    chars, linked = [b.chars for b in blocks], [b.linked for b in blocks]
    for k in range(len(blocks) - 1, 0, -1):
        # text goes up to the innermost list around it
        if blocks[k].tag not in LISTS:
            chars[blocks[k].parent] += chars[k]
            linked[blocks[k].parent] += linked[k]
    listed = [False] * len(blocks)
    out: list[list[tuple[str, str]]] = [[]]
    for k, b in enumerate(blocks[1:], 1):
        up = blocks[b.parent]
        listed[k] = listed[b.parent] or up.tag in LISTS
        seen = [("mark", m) for m in b.marks]
        if not listed[k]:
            if not seen and b.tag in GROUPS:
                seen.append(("nameless", b.tag))
            seen.append(("tag", b.tag))
        if b.tag in LISTS:
            n, m = chars[k], linked[k]
            seen.append(("list", f"{0 if not n else min(4, 1 + int(math.log10(n) * 1.5))} {int(4 * m / n) if n else 0}"))
        elif not listed[k]:
            seen.append(("chars", str(0 if not b.chars else min(4, 1 + int(math.log10(b.chars) * 1.5)))))
            if b.chars:
                seen.append(("linked", str(int(4 * b.linked / b.chars))))
                seen.append(("ended", str(runs[b.texts[-1]][1][-1:] in ".!?\u2026:;")))
        out.append(seen)
    return out


#: siblings that look the same count in full up to this many, then the k-th by ALIKE / k: they say little that is new
ALIKE = 3


def weights(blocks: list[Block], seen: list[list[tuple[str, str]]]) -> list[float]:
    """How much the features of each block count."""
    met: Counter = Counter()
    out = []
    for b, own in zip(blocks, seen, strict=True):
        key = (b.parent, *own)
        met[key] += 1
        out.append(min(1.0, ALIKE / met[key]))
    return out


@dataclass(frozen=True)
class TreeModel:
    """Potentials of (state of the parent, state of the child): by the pair alone, and by each feature of the child."""

    pair: tuple[tuple[float, ...], ...]
    feature: dict[tuple[str, str], tuple[tuple[float, ...], ...]]


def states(blocks: list[Block]) -> list[int]:
    """States of labelled blocks: what is not content but holds content is around it."""
    found = [CONTENT if b.label else OTHER for b in blocks]
    for k in range(len(blocks) - 1, 0, -1):
        p = blocks[k].parent
        if found[k] in (CONTENT, OUTER) and found[p] == OTHER:
            found[p] = OUTER
    found[0] = OUTER
    return found


def _observations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for page in batch.column(0).to_pylist():
            blocks, runs = parse(page or "")
            known = states(blocks)
            seen = features(blocks, runs)
            for k, b in enumerate(blocks[1:], 1):
                pair = 3 * known[b.parent] + known[k]
                found["pair", "", pair] += 1
                for kind, value in seen[k]:
                    found[kind, value, pair] += 1
        columns = list(zip(*found, strict=True)) if found else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(list(found.values()), pa.int64())], ["kind", "value", "pair", "n"])


def train(labelled: DataFrame, html: str = "html") -> TreeModel:
    """Learn from pages whose elements carry data-content="1" or "0" (others are like their parent).

    Spark sums the counts of features by the states of parent and child; what comes to the driver is a row for each feature
    value and pair of states, whatever the number of pages.
    """
    rows = labelled.select(html).mapInArrow(_observations, "kind string, value string, pair int, n long").groupBy("kind", "value", "pair").agg(F.sum("n").alias("n")).collect()
    count: Counter = Counter({(r["kind"], r["value"], r["pair"]): r["n"] for r in rows})
    values: dict[str, set[str]] = {}
    total: Counter = Counter()
    for (kind, value, pair), n in count.items():
        values.setdefault(kind, set()).add(value)
        total[kind, pair] += n
    nodes = [count["pair", "", pair] for pair in range(9)]
    table = tuple(tuple((nodes[3 * p + c] + 0.1) / (sum(nodes[3 * p : 3 * p + 3]) + 0.3) for c in STATES) for p in STATES)
    feature = {}
    for kind, known in values.items():
        if kind == "pair":
            continue
        for value in known:
            everywhere = sum(count[kind, value, q] for q in range(9)) / sum(total[kind, q] for q in range(9))
            # a block has any number of marks, so they count against all blocks; what is rare leans to the general share
            of = nodes if kind == "mark" else [total[kind, q] for q in range(9)]
            feature[kind, value] = tuple(tuple((count[kind, value, 3 * p + c] + 2 * everywhere) / (of[3 * p + c] + 2) for c in STATES) for p in STATES)
    return TreeModel(table, feature)


def labelled_pages(spark: SparkSession, n: int = LABELLED_PAGES, first_seed: int = 0) -> DataFrame:
    """Made-up labelled pages of many layouts: (seed, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(seeds, pa.int64()), pa.array([labelled_page(s) for s in seeds])], ["seed", "html"])

    return spark.range(first_seed, first_seed + n, 1, 8).mapInArrow(run, "seed long, html string")


def content_marginals(blocks: list[Block], runs: list[tuple[int, str]], model: TreeModel) -> list[float]:
    """Probability of content for each block by sum-product: messages from the leaves to the root, then back down."""
    n = len(blocks)
    potential: list[list[list[float]]] = [[]]
    seen = features(blocks, runs)
    for own_features, weight in zip(seen[1:], weights(blocks, seen)[1:], strict=True):
        own = [list(row) for row in model.pair]
        for f in own_features:
            known = model.feature.get(f)
            if known is not None:
                if weight < 1:
                    known = [[x**weight for x in row] for row in known]
                for row, factor in zip(own, known, strict=True):
                    row[0] *= factor[0]
                    row[1] *= factor[1]
                    row[2] *= factor[2]
        potential.append(own)
    below = [[1.0, 1.0, 1.0] for _ in range(n)]  # what a block's children say, by its state
    message: list[list[float]] = [[1.0, 1.0, 1.0]] * n  # what a block says to its parent, by the parent's state
    for k in range(n - 1, 0, -1):
        x, y, z = below[k]
        said = [row[0] * x + row[1] * y + row[2] * z for row in potential[k]]
        scale = sum(said)
        message[k] = said = [v / scale for v in said]
        up = below[blocks[k].parent]
        x, y, z = (u * v for u, v in zip(up, said, strict=True))
        scale = x + y + z
        up[0], up[1], up[2] = x / scale, y / scale, z / scale
    # a page as a whole is around its article
    belief = [[0.98, 0.01, 0.01]] + [[0.0] * 3] * (n - 1)
    top = [b * v for b, v in zip(belief[0], below[0], strict=True)]
    belief[0] = [v / sum(top) for v in top]
    for k in range(1, n):
        above = belief[blocks[k].parent]
        # the parent's belief without what this block told it
        rest = [v / m if m > 1e-280 else 0.0 for v, m in zip(above, message[k], strict=True)]
        own = potential[k]
        down = [below[k][c] * (rest[0] * own[0][c] + rest[1] * own[1][c] + rest[2] * own[2][c]) for c in STATES]
        scale = sum(down) or 1.0
        belief[k] = [v / scale for v in down]
    return [b[CONTENT] for b in belief]


def main_text(page: str | None, model: TreeModel) -> str:
    """Text runs of content blocks in page order, joined by a line feed; empty if there are none. Text without any block element
    is all content."""
    blocks, runs = parse(page or "")
    if not runs:
        return ""
    if len(blocks) == 1:
        return "\n".join(text for _, text in runs)
    belief = content_marginals(blocks, runs, model)
    return "\n".join(text for at, text in runs if belief[at] > 0.5)


def extracted(pages: DataFrame, model: TreeModel, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row, from the whole page.

    A null or empty page has an empty text. Pages are read one at a time in Arrow batches of a few MB, without a shuffle;
    repeated rows and null ids or urls come out as they went in.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a number for each feature name of the labelled pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 2, BATCH_BYTES):
            texts = [main_text(p, shared.value) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
