"""Language by compression: each language's commonest words are a zstandard raw-content dictionary; the smallest result wins."""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sunloom.llm.common import lean, written

UNDETERMINED = "und"
#: ASCII characters other than letters become spaces; the rest of Unicode stays
_PLAIN = {i: " " for i in range(128) if not chr(i).isalpha()}


def has_letter(text: str) -> bool:
    """Letters are the characters of the Unicode categories L*: no digits, number forms or marks."""
    import regex

    return regex.search(r"\p{L}", text) is not None


@dataclass(frozen=True)
class LanguageConfig:
    #: labelled documents per language that the dictionaries are learned from (those with the smallest hashes)
    docs_per_language: int = 2000
    dictionary_bytes: int = 110 * 1024
    level: int = 6
    block_bytes: int = 4000
    #: below this share of saved bytes between the best and the second language a text is rejected
    least_margin: float = 0.02


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries by language, the commonest language of the sample first: it wins ties."""

    dictionaries: tuple[tuple[str, bytes], ...]
    config: LanguageConfig = LanguageConfig()


def plain_words(text: str) -> list[str]:
    """The words of a text in lower case, ASCII digits and marks taken for white space: the plain text that is compressed."""
    return text.lower().translate(_PLAIN).split()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(set(plain_words(text or "")))  # documents with the word
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])


def train(docs: DataFrame, config: LanguageConfig = LanguageConfig(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from at most `docs_per_language` rows of each non-null language: a bounded sample by hash of the id."""
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).filter("lang is not null and text is not null and k is not null")
    hashed = rows.select("lang", "k", F.xxhash64("k").alias("h"))
    # by its count, a language first keeps about four times the rows it may use, so that no ranking is larger
    share = F.ceil(4 * config.docs_per_language * (1 << 20) / F.col("count"))
    drawn = hashed.join(written(hashed.groupBy("lang").count(), "languages"), "lang").filter(F.pmod(F.xxhash64("k", F.lit(1)), F.lit(1 << 20)) < share)
    first = Window.partitionBy("lang").orderBy("h", "k")
    chosen = drawn.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= config.docs_per_language)
    # bounded: at most docs_per_language ids for each language
    chosen = F.broadcast(chosen.select("lang", "k"))
    sample = rows.join(chosen, ["lang", "k"], "left_semi").select("lang", "text")
    counts = sample.mapInArrow(lean(_word_counts), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("nth") <= config.dictionary_bytes // 4)
    weight: Counter = Counter()
    words: dict[str, list[tuple[int, str]]] = {}
    for r in ranked.select("lang", "word", "n", "nth").toLocalIterator():
        words.setdefault(r["lang"], []).append((r["nth"], r["word"]))
        weight[r["lang"]] += r["n"]
    made = []
    for name in sorted(words, key=lambda k: (-weight[k], k)):
        taken, size = [], 2
        for _, w in sorted(words[name]):
            size += len(w.encode()) + 1
            if size > config.dictionary_bytes:
                break
            taken.append(w)
        # the end of a dictionary is the cheapest to point at: the commonest words go there
        made.append((name, (" " + " ".join(reversed(taken)) + " ").encode()))
    return LanguageModel(tuple(made), config)


class Classifier:
    def __init__(self, model: LanguageModel):
        import zstandard

        self.config = model.config
        self.languages = [name for name, _ in model.dictionaries]
        self.compressors = []  # made once a task
        for _, content in model.dictionaries:
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=self.config.level)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=shared, level=self.config.level, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)"""
        if not self.languages or not text or not has_letter(text):
            return UNDETERMINED, 0.0, True
        data = (" " + " ".join(plain_words(text)) + " ").encode()
        blocks = [data[i : i + self.config.block_bytes] for i in range(0, len(data), self.config.block_bytes)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = [s for k, s in enumerate(sizes) if k != best]
        score = 1 - sizes[best] / min(others) if others else 1.0
        return self.languages[best], score, score < self.config.least_margin


VERDICT = "struct<lang_pred: string, score: double, rejected: boolean>"


def classify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """(row, language): the rows of `docs`, untouched in one struct, and their (lang_pred, score, rejected).

    The whole plain text is compressed, in blocks, with each dictionary; score is the share of bytes that the best one saves
    over the second. Null or letterless text, and any text where nothing was learned, is `und` with score 0 and rejected; with
    one known language every other text has score 1. Equal sizes go to the language with more words in the sample, then by
    name, and are rejected as their margin is 0. Repeated rows get equal verdicts, no rows none. Only texts go to Python.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: dictionary_bytes for each language

    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decide = Classifier(shared.value)
        for texts in batches:
            names, scores, rejected = zip(*map(decide, texts.to_pylist()), strict=True) if len(texts) else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["lang_pred", "score", "rejected"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), F.arrow_udf(predicted, VERDICT, F.ArrowUDFType.SCALAR_ITER)(F.col(f"`{text}`").cast("string")).alias("language"))


def held_out(key: str = "doc_id"):
    """crc32 of the id as text leaves remainder 0 by 5; a row without id is always held out."""
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def language_verdict(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row; learned from the rows that are not held out."""
    model = train(docs.filter(~held_out()), config)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text"))
    return classify(rows, model).select("row.doc_id", "row.held_out", "language.*")


def keep_known_languages(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """`docs` without the rejected rows, all columns as they were."""
    model = train(docs.filter(~held_out()), config)
    return classify(docs, model).filter(~F.col("language.rejected")).select("row.*")
