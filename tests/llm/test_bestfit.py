"""Best-fit packing in levels against the library's ids and plain best fit over everything."""
import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators_small import rows

import __spark_entry__ as entry

WORDS = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def check_pieces(got, texts, window=4096):
    """Whole texts, each id in one piece, sequences without gaps; returns the number of sequences."""
    tok = library()
    want = []
    for doc, text in texts:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), window)):
            part = ids[start : start + window]
            want.append((doc, piece, start, len(part), zlib.crc32(array("I", part).tobytes())))
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=order) == sorted(want, key=order)
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= window
    return len(held)


def test_words_are_encoded_as_the_library_does(odd_texts):
    import numpy as np

    from sunloom.llm.bestfit import WordBpe

    odd = [t or "" for t in odd_texts] + [
        "İstanbul Σας ΑΣ", "á ́b ë", "<|endoftext|>x<|ENDOFTEXT|> #<|startoftext|>.", "x\x0by\x0cz　w v\x85q", "'s 's' it's\n'd 12ab3 #a's. (b)", "ª µ ß ẞ ﬁ",
    ]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in library().encode_batch(odd, add_special_tokens=False)]
    for room in (0, 1 << 30):
        encoder = WordBpe(WORDS, room)
        assert encoder.encode_texts(odd) == want
        assert [encoder.encode_texts([t])[0] for t in odd] == want
    # a small memory is emptied before each batch but for what that batch has again
    small = WordBpe(WORDS, 0)
    for text in ("the cat", "the dog", "the end"):
        small.encode_texts([text])
    assert set(small._ids) == {"", "the", "end"}


def test_a_vocabulary_that_minds_white_space_is_refused(spark, docs_of):
    from sunloom.llm.bestfit import best_fit_packed

    with pytest.raises(ValueError, match="white space"):
        best_fit_packed(docs_of([(1, "a")]), public_tokenizers.path("byte_bpe_50k.json"))


def test_best_fit_takes_the_tightest_bin():
    from sunloom.llm.bestfit import best_fit

    assert best_fit([], 10) == ([], [], [])
    # 7 | 6: then 3 fills the first, 4 the second
    assert best_fit([3, 7, 4, 6], 10) == ([0, 0, 1, 1], [7, 0, 6, 0], [10, 10])
    rng = random.Random(3)
    for _ in range(50):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 200))]
        bins, places, fills = best_fit(sizes, 100)
        # brute force: the fullest bin that takes the item
        full: list[int] = []
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            fit = [f for f in full if f + sizes[k] <= 100]
            if fit:
                full[full.index(max(fit))] += sizes[k]
            else:
                full.append(sizes[k])
        assert sorted(full) == sorted(fills) and max(fills) <= 100
        assert all(places[k] + s <= fills[bins[k]] for k, s in enumerate(sizes))


@pytest.mark.parametrize("levels", [{}, {"chunk": 3, "group": 2, "fan": 2}, {"chunk": 1, "group": 1, "fan": 4, "slack": 0}])
def test_pieces_and_sequences(spark, docs_of, odd_texts, levels):
    from sunloom.llm.bestfit import best_fit_packed

    rng = random.Random(8)
    texts = [(k, t) for k, t in enumerate(odd_texts)] + [(100 + k, " ".join(["word"] * rng.randint(0, 3000))) for k in range(60)]
    texts += [(None, "no id"), (7, "again"), (7, "again"), (200, "w " * 4095), (201, "w " * 4096), (202, "w " * 9000)]
    docs = docs_of(texts).withColumns({"sequence_id": F.lit("clash"), "bin": F.lit(1), "offset": F.lit(None)}).repartition(4)
    got = rows(best_fit_packed(docs, WORDS, **levels))
    sequences = check_pieces(got, texts)
    if not levels:
        assert sequences <= -(-sum(r["length"] for r in got) // 4096) + 1


def test_empty_and_single(spark, docs_of):
    from sunloom.llm.bestfit import best_fit_packed

    empty = best_fit_packed(docs_of([]), WORDS)
    assert empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and empty.count() == 0
    assert [(r["length"], r["offset"]) for r in rows(best_fit_packed(docs_of([(1, None)]), WORDS))] == [(1, 0)]


def test_levels_join_what_tasks_left(spark):
    """2500 + 1500 never share a task; the levels bring them together."""
    from sunloom.llm.bestfit import merged

    bins = spark.createDataFrame([(k, 2500 if k % 2 else 1500) for k in range(400)], "bin long, fill int")
    for group, fan in ((1000, 8), (50, 2)):
        moves = rows(merged(bins, 4096, 32, group, fan))
        assert sorted(m["bin"] for m in moves) == list(range(400))
        # groups are drawn by hash, so a few of each size may be left over
        assert len({m["sequence_id"] for m in moves}) <= (200 if group == 1000 else 215)
        assert all(m["shift"] == 0 or m["sequence_id"] != m["bin"] for m in moves)
    # bins that fit nowhere stay as they are, in however many groups
    large = spark.range(300).select(F.col("id").alias("bin"), F.lit(2100).alias("fill"))
    assert len({m["sequence_id"] for m in rows(merged(large, 4096, 32, 40, 2))}) == 300
    assert merged(large.limit(1), 4096, 32, 40, 2) is None


def test_query_is_near_plain_best_fit(spark):
    from sunloom.llm.bestfit import best_fit

    texts = [(r["doc_id"], r["text"]) for r in rows(spark.read.parquet(f"{SF}/documents.parquet"))]
    got = rows(entry.queries()["op11_best_fit_packing"](spark, SF))
    sequences = check_pieces(got, texts)
    full = sum(r["length"] == 4096 for r in got)
    plain = len(best_fit([r["length"] for r in got if r["length"] < 4096], 4096)[2])
    assert sequences <= full + plain * 1.01 + 1


def test_encoder_of_a_worker_outlives_the_task():
    from sunloom.llm.bestfit import loaded

    first = loaded(WORDS)
    want = first.encode_texts(["some words that stay"])
    assert loaded(WORDS) is first and "words" in first._ids and loaded(WORDS).encode_texts(["some words that stay"]) == want


def test_known_words_are_looked_up_once():
    import public_tokenizers

    from sunloom.llm.bestfit import WordBpe

    class Counted(dict):
        asked = 0

        def get(self, *args):
            Counted.asked += 1
            return super().get(*args)

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

        def __contains__(self, key):
            Counted.asked += 1
            return super().__contains__(key)

    encoder = WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["a few words, and (some) words again", "", "été  and\nmore"]
    first = encoder.encode_texts(texts)
    encoder._ids = Counted(encoder._ids)
    assert encoder.encode_texts(texts) == first and Counted.asked == sum(len(t.replace("\n", " ").split(" ")) for t in texts)
