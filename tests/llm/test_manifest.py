"""The manifest against a plain Python tree, with leaf partitions of all sizes; the query's SQL twin runs with all others."""
import hashlib
import random
import zlib

import pytest
from test_operators_small import rows

from sunloom.llm.manifest import build, manifest_proofs, missing, proofs

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, rank string, unit int, leaf string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(doc, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n_chars, text)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def way(levels, idx):
    for row in levels[:-1]:
        run = range(idx // 3 * 3, min(idx // 3 * 3 + 3, len(row)))
        yield "".join(row[k] for k in run if k < idx), "".join(row[k] for k in run if k > idx)
        idx //= 3


def plain(docs):
    by = {}
    for doc, text, lang, source, n_chars in docs:
        by.setdefault(source, []).append(((doc is not None, doc or 0), leaf_of(doc, source, lang, n_chars, text), doc, text, lang, n_chars))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[1] for x in sorted(by[s], key=lambda x: x[:2])]) for s in names}
    top = levels_of([trees[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for k, (_, leaf, doc, text, lang, n_chars) in enumerate(sorted(by[s], key=lambda x: x[:2])):
            steps = [*way(trees[s], k), *way(top, place)]
            even = doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0
            folded = leaf_of(doc, s, lang, n_chars, text.replace("\n", "") if even and text is not None else text)
            for left, right in steps:
                folded = sha(left + folded + right)
            out.append((str(doc), leaf, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), folded, folded == top[-1][0]))
    return sorted(out)


def result(df):
    return sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in rows(df))


def frame(spark, docs, parts=5):
    return spark.createDataFrame([(*d, "clash", 3, "clash") for d in docs], COLUMNS).repartition(parts)


def odd_docs():
    rng = random.Random(2)
    names = [None, "", "a", "Z", "é", "\U0001f600", "￿", "-"]
    docs = [(k, rng.choice(["x\ny", "plain", "", None, "long " * 20000]), rng.choice(["en", None]), rng.choice([*names, "hot", "hot", "hot"]), rng.choice([None, k])) for k in range(150)]
    docs += [(None, "no\nid", "en", "hot", 1), (None, "no\nid 2", "en", None, 1), (3, "again", "en", "hot", 2)]
    # repeated rows, one id with two texts
    return docs + docs[:5] + [(7, "same", "en", "a", 1)] * 4 + [(k, "single\n", "en", f"own {k}", 1) for k in range(40)]


@pytest.mark.parametrize("depth", [1, 2, 3, 6])
def test_proofs_equal_a_plain_tree(spark, depth):
    docs = odd_docs()
    want = plain(docs)
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)
    assert result(manifest_proofs(frame(spark, docs), depth)) == want


@pytest.mark.parametrize("count", [1, 2, 3, 4, 9, 10, 27, 28, 81, 82])
def test_one_source_of_every_shape(spark, count):
    docs = [(k, f"t{k}\n", "en", "s", k) for k in range(count)]
    assert result(manifest_proofs(frame(spark, docs, 3), 1)) == plain(docs)


def test_many_sources_of_one_row(spark):
    docs = [(k, "t\n", "en", f"s{k:04}", k) for k in range(300)]
    assert result(manifest_proofs(frame(spark, docs), 2)) == plain(docs)


def test_empty_table(spark):
    empty = frame(spark, odd_docs()[:1]).limit(0)
    assert build(empty).root is None
    out = manifest_proofs(empty)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and out.count() == 0


def test_siblings_fold_to_the_root(spark):
    docs = [(k, "t", "en", "s" if k % 3 else f"u{k}", k) for k in range(100)]
    made = build(frame(spark, docs), 2)
    got = rows(proofs(made, siblings=True))
    want = {r[0]: r for r in plain(docs)}
    for r in got:
        assert sha("".join(r["proof"])) == r["proof_sha256"] == want[str(r["doc_id"])][4]
    # the stored nodes are those above the partitions only
    assert {r["level"] for r in made.nodes.filter("tree >= 0").select("level").distinct().collect()} <= {2, 3, 4}


@pytest.mark.parametrize("size", [1, 2, 5, 27, 31])
def test_missing_nodes_are_the_least_that_suffice(size):
    """By brute force: siblings of ancestors that hold no known leaf, whose own siblings are not needed above."""

    def widths():
        n, out = size, [size]
        while n > 1:
            n = -(-n // 3)
            out.append(n)
        return out

    sizes = widths()
    for first in range(size):
        for last in range(first + 1, size + 1):
            want = set()
            for level in range(len(sizes) - 1):
                held = {k // 3**level for k in range(first, last)}
                family = {k for h in held for k in range(h // 3 * 3, min(h // 3 * 3 + 3, sizes[level]))}
                want |= {(level, k) for k in family - held}
            got = list(missing(first, last, size))
            assert len(got) == len(set(got)) and set(got) == want
