"""Quality rules, line first: judge every line, take the failing ones out, then reject the texts that lose too much."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.llm.common import BLANKS, ids_and_text, words_of

#: fixed values: phrases of notices that sites put below or beside an article
NOTICES = (
    "all rights reserved", "cookie policy", "cookies", "privacy policy", "terms of use", "terms of service", "javascript",
    "lorem ipsum", "licensed under", "released under", "subscribe", "sign in", "log in", "read more", "click here",
)
#: one of these beside such a phrase makes a line a notice
NOTICE_SIGNS = (
    "\u00a9", "\\(c\\)", "copyright", "https?:", "www\\.", "licen[cs]es?", "cc by", "public domain", "newsletter", "dolor", "we use", "by using", "continuing",
    "(?:our|this) (?:web)?site", "your (?:browser|account|e-?mail|inbox|consent|preferences|password)",
)
_BLANK = r"[ \t\x0B\f\r]"
SYMBOLS = "#*$%&|<>"
#: characters that end a sentence, in any script
ENDS = (
    "!.?\u0589\u061d-\u061f\u06d4\u0700-\u0702\u07f9\u0837\u0839\u083d\u083e\u0964\u0965\u104a\u104b\u1362\u1367\u1368\u166e\u1735"
    "\u1736\u17d4\u17d5\u1803\u1809\u1944\u1945\u1aa8-\u1aab\u1b4e\u1b4f\u1b5a\u1b5b\u1b5e\u1b5f\u1b7d-\u1b7f\u1c3b\u1c3c\u1c7e\u1c7f"
    "\u2025\u2026\u203c\u203d\u2047-\u2049\u2cf9-\u2cfb\u2e2e\u2e3c\u2e53\u2e54\u2e60\u2e61\u3002\ua4ff\ua60e\ua60f\ua6f3\ua6f7\ua876"
    "\ua877\ua8ce\ua8cf\ua92f\ua9c8\ua9c9\uaa5d-\uaa5f\uaaf0\uaaf1\uabeb\ufe12\ufe15\ufe16\ufe52\ufe56\ufe57\uff01\uff0e\uff1f\uff61"
)


@dataclass(frozen=True)
class LineRules:
    min_words: int = 50
    most_repeated_pct: int = 50
    most_symbols_per_100_words: int = 30
    unended_words: int = 5
    notice_words: int = 30
    most_lost_pct: int = 30
    notice_alone_words: int = 3
    wrap_columns: int = 120


def _without(text: Column, characters: str) -> Column:
    """Plain replacements, one per character: far cheaper than `translate` on long texts."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _symbols(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(_without(text, SYMBOLS))).cast("long")


def _ended(text: Column) -> Column:
    return text.rlike(f"[{ENDS}]")


def _solid(line: Column) -> Column:
    return line.rlike(r"[^ \t\n\x0B\f\r]")


def _phrase(*choices: str) -> str:
    return rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(choices)})(?![\p{{L}}\p{{N}}])"


def _words(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def line_fails(line: Column, rules: LineRules = LineRules()) -> Column:
    """True for a line of noise or navigation, for shouting, for a short notice: a phrase of NOTICES that is nearly all of the line, or
    stands beside a second one or a sign of NOTICE_SIGNS."""
    words = _words(line)
    noise = 100 * _symbols(line) > rules.most_symbols_per_100_words * words
    shouting = ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}.*\p{Lu}") & (words > 1)
    one = _phrase(*NOTICES)
    signs = "|".join(x if x[0] in "\u00a9\\" else _phrase(x) if x[-1] not in ":." else rf"(?<![\p{{L}}\p{{N}}]){x}" for x in NOTICE_SIGNS)
    second = (words <= rules.notice_alone_words) | line.rlike(f"(?is){one}.*{one}") | line.rlike(f"(?iu){signs}")
    notice = (words <= rules.notice_words) & line.rlike(f"(?i){one}") & second
    return noise | shouting | notice


def _with_unended(rows: DataFrame, rules: LineRules) -> DataFrame:
    """Adds unended: lines of many words in paragraphs without a sentence end; null for texts whose lines all have one.

    A paragraph is a line with those that go on from it. The next line goes on if this one does not stop at a sentence end and it
    begins with a letter that is not a capital, or if its first word had no place here: in lines between two blank ones that are
    no wider than `wrap_columns`. A line that stands in several paragraphs is unended if all of them are.
    """
    doubtful = lambda line: ~_ended(line) & (_words(line) >= rules.unended_words)
    stretches = F.transform(F.split("text", rf"\n(?:{_BLANK}*\n)+"), lambda stretch: F.split(stretch, "\n"))
    wide = lambda line: F.when(_solid(line), F.length(line))
    wide_ones = lambda lines: F.struct(lines.alias("lines"), F.array_max(F.transform(lines, wide)).alias("widest"))
    rows = rows.withColumn("stretches", F.when(F.exists("lines", doubtful), F.transform(stretches, wide_ones)))

    def glued(line: Column, after: Column, widest: Column) -> Column:
        first = F.length(F.regexp_extract(after, rf"^{_BLANK}*([^ \t\x0B\f\r]+)", 1))
        full = (widest <= rules.wrap_columns) & (first > 0) & (F.length(line) + 1 + first > widest)
        on = ~line.rlike(rf"[{ENDS}][\p{{Pe}}\p{{Pf}}\"']*{_BLANK}*$") & (after.rlike(rf"^{_BLANK}*[\p{{Ll}}\p{{Lo}}]") | full)
        return F.when(~_solid(line), "").otherwise(F.concat(line, F.when(on, "\n").otherwise("\n\n")))

    # no line holds a line feed, so two of them part paragraphs
    together = lambda x: F.array_join(F.transform(x["lines"], lambda line, i: glued(line, F.get(x["lines"], i + 1), x["widest"])), "")
    rows = rows.withColumn("paragraphs", F.flatten(F.transform("stretches", lambda x: F.split(together(x), "\n\n"))))
    of = lambda keep: F.flatten(F.transform(F.filter("paragraphs", keep), lambda p: F.split(p, "\n")))
    never = F.filter(of(lambda p: ~_ended(p)), lambda line: _words(line) >= rules.unended_words)
    return rows.withColumn("unended", F.array_except(never, of(_ended))).drop("stretches", "paragraphs")


def _measured(rows: DataFrame) -> DataFrame:
    """Adds lines, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to (carry, text), one projection per step.

    n_repeat_words: words in a 3-word window found twice or more in the text. Windows are hashed and sorted with their
    positions, so that equal ones are neighbours; the positions of repeated ones are walked in order, each adding the words
    that the one before has not covered. A text without repeated windows skips the sort.
    """
    text = F.col("text")
    rows = rows.select("carry", "text", words_of(text).alias("w"), F.filter(F.split(text, "\n"), lambda s: s.rlike("[^ \\t\\n\\x0B\\f\\r]")).alias("lines"))
    # the last two positions start no window and are cut off
    windows = F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    rows = rows.withColumn("windows", F.slice(windows, F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))))
    in_order = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("s", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), in_order))
    all_but_one = F.greatest(F.size("s") - 1, F.lit(0))
    twins = F.zip_with(F.slice("s", F.lit(1), all_but_one), F.slice("s", F.lit(2), all_but_one), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    rows = rows.withColumn("at", F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda p: p.isNotNull())))))
    added = F.zip_with("at", F.slice("at", F.lit(2), F.size("at")), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    none = F.lit(0).cast("long")
    return rows.select(
        "carry", "text", "lines", F.size("w").cast("long").alias("n_words"), F.length(_without(text, BLANKS)).cast("long").alias("word_chars"),
        _symbols(text).alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(added, none, lambda s, x: s + x), none).alias("n_repeat_words"),
    )


def _judged(rows: DataFrame, rules: LineRules) -> DataFrame:
    rows = _with_unended(_measured(rows), rules).withColumn("once", F.coalesce(F.array_except("lines", "unended"), F.array_distinct("lines")))
    rows = rows.withColumn("left", F.filter("once", lambda line: ~line_fails(line, rules)))
    size = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    rows = rows.withColumn("all_chars", size("lines")).withColumn("lost_chars", F.col("all_chars") - size("left"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.most_repeated_pct * F.col("n_words")))
    # a filter on the verdict must not be moved below the arrays it is made of: they would be built anew inside every lambda;
    # a row number, which is never negative, keeps it above
    rows = rows.withColumn("mark", F.monotonically_increasing_id())
    return rows.withColumn("kept", (F.col("mark") >= 0) & ~F.col("base_failed") & (100 * F.col("lost_chars") <= rules.most_lost_pct * F.col("all_chars"))).withColumn("cleaned", F.array_join("left", "\n"))


def quality_verdict(docs: DataFrame, rules: LineRules = LineRules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Verdict on every document, with the lines that are left.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long), base_failed, lost_chars (code
    points of removed lines), cleaned (the lines left, joined by a line feed), kept. Lines that fail `line_fails`, are
    unended or equal an earlier line of the text are removed. A null, empty or blank text has no words, fails the base rule and is not kept;
    repeated rows and null ids are judged like any other; an empty table gives an empty result.
    One pass over the rows: no shuffle, no Python.
    """
    rows = ids_and_text(docs, key, text).select(F.col("doc_id").alias("carry"), "text")
    return _judged(rows, rules).select(F.col("carry").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "cleaned", "kept")


def clean_documents(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """`docs` with failing lines taken out of `text` and rejected rows left out; `n_chars`, where there is one, follows the text.

    Nothing is joined back, so repeated or null ids and further columns of any name pass through.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("carry"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    out = []
    for c in docs.columns:
        if c == text:
            out.append(F.col("cleaned").alias(c))
        elif c == "n_chars":
            out.append(F.length("cleaned").cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col("carry").getField(c).alias(c))
    return _judged(rows, rules).filter("kept").select(*out)
