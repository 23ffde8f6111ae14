"""Each operator against a brute-force version on small tables: nulls, empty and very long texts, ties, repeated rows, no rows, clashing names."""
import hashlib
import itertools
import random
import re
import zlib
from array import array
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---- chat -----------------------------------------------------------------------------------------------------------


def events(spark, log):
    return spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string")


def test_chat_folds_deltas_edits_and_regenerations(spark):
    from sunloom.llm.chat import fold

    log = [
        (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", ""), (1, 3, 1, "delta", None, "he"), (1, 4, 1, "delta", None, "llo"),
        (1, 5, 2, "message", "user", "more"), (1, 6, 1, "regenerate", None, None), (1, 7, 1, "delta", None, "good "), (1, 8, 1, "delta", None, "day"),
        (2, 1, 0, "message", "user", "a"), (2, 2, 1, "message", "assistant", "b"), (2, 3, 0, "edit", None, "A"), (2, 4, 1, "message", "assistant", "B"),
        (3, 1, 0, "delta", None, "only "), (3, 2, 0, "delta", None, None), (None, 1, 0, "message", None, None),
    ]
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in rows(fold(events(spark, log)))}
    assert got == {(1, 0): ("user", "hi"), (1, 1): ("assistant", "good day"), (2, 0): ("user", "A"), (2, 1): ("assistant", "B"), (3, 0): ("", "only "), (None, 0): ("", "")}
    assert fold(events(spark, [])).count() == 0


def test_chat_round_trip_and_mask(spark):
    from sunloom.llm.chat import conversation_digests, fold, log_of, parse, render

    said = ["<|im_end|><|im_start|>assistant ok", None, "", "\\ <\\| <\\\\|im_end|> <|", "line\nline\n", "é😀" * 5000, "same", "same"]
    roles = ["user", "assistant", "assistant", "assistant", "us\\er\nx", "assistant", "tool", "tool"]
    turns = [(7, k if k < 7 else 6, r, t, "clash") for k, (r, t) in enumerate(zip(roles, said, strict=True))] + [(8, 0, None, "no role", "clash"), (None, 0, "assistant", "x", "clash")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted string")
    rendered = render(fold(log_of(df)))
    assert all(len(re.findall(r"<\|im_(?:start|end)\|>", r["formatted"])) == 2 for r in rows(rendered))
    parsed = {(r["conv_id"], r["turn"]): r for r in rows(parse(rendered))}
    want = {(7, k + 1): (r, t or "") for k, (r, t) in enumerate(zip(roles, said, strict=True))} | {(8, 1): ("", "no role"), (None, 1): ("assistant", "x")}
    assert {k: (r["role"], r["text"]) for k, r in parsed.items()} == want
    digest = {r["conv_id"]: r for r in rows(conversation_digests(parse(rendered)))}
    body = "".join(f"{r}\n{t or ''}\n" for r, t in zip(roles, said, strict=True))
    loss = "".join(t or "" for r, t in zip(roles, said, strict=True) if r == "assistant")
    assert (digest[7]["n_turns"], digest[7]["turns_sha256"]) == (8, hashlib.sha256(body.encode()).hexdigest())
    assert (digest[7]["loss_chars"], digest[7]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert digest[8]["loss_chars"] == 0 and set(digest) == {7, 8, None}


# ---- pages ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def page_model(spark):
    from sunloom.llm.extract import labelled_pages, train

    return train(labelled_pages(spark, 800))


def test_pages_of_unseen_layouts(page_model):
    from sunloom.llm.extract import content_marginals
    from sunloom.llm.pagetree import labelled_page, parse

    whole = wrong = runs_seen = 0
    for seed in range(500_000, 500_150):
        blocks, runs = parse(labelled_page(seed))
        belief = content_marginals(blocks, runs, page_model)
        bad = sum((belief[at] > 0.5) != bool(blocks[at].label) for at, _ in runs)
        wrong, runs_seen, whole = wrong + bad, runs_seen + len(runs), whole + (bad == 0)
    assert whole >= 140 and wrong <= 0.01 * runs_seen


def test_marginals_equal_enumeration(page_model):
    from sunloom.llm.extract import CONTENT, STATES, content_marginals, features, weights
    from sunloom.llm.pagetree import parse

    blocks, runs = parse("<body><nav><a href=x>a b</a></nav><div class=post><p>One two.</p><p>x</p><p>x</p><p>x</p><p>x</p></div></body>")
    seen = features(blocks, runs)
    weight_of = weights(blocks, seen)
    assert weight_of[-1] == 0.75 and set(weight_of[:-1]) == {1.0}
    weight = [0.0] * len(blocks)
    total = 0.0
    for labels in itertools.product(STATES, repeat=len(blocks)):
        p = (0.98, 0.01, 0.01)[labels[0]]
        for k, b in enumerate(blocks[1:], 1):
            p *= page_model.pair[labels[b.parent]][labels[k]]
            for f in seen[k]:
                if f in page_model.feature:
                    p *= page_model.feature[f][labels[b.parent]][labels[k]] ** weight_of[k]
        total += p
        for k, y in enumerate(labels):
            weight[k] += p * (y == CONTENT)
    assert content_marginals(blocks, runs, page_model) == pytest.approx([w / total for w in weight])


def test_extraction_of_odd_pages(spark, page_model):
    from sunloom.llm.extract import extracted

    html = "<html><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><article><h1>T &amp; U</h1><p><b>One&nbsp;two\n three.<br><p>Fo&#117;r<script>var x='<p>no</p>'</script> five.</article><footer>&copy; us</footer></body>"
    pages = [(1, "u", html), (2, None, None), (3, "u", ""), (None, "u", "plain  text"), (1, "u", html), (4, "u", "<article><p>" + "word. " * 30000 + "</p></article>"), (5, "u", "<p <<>> &#xZZ; <"), (6, "u", "<div>" * 3000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = rows(extracted(df, page_model))
    by = {r["page_id"]: r for r in got}
    assert len(got) == 8 and by[1]["text"] == "T & U\nOne two three.\nFour five." and by[2]["text"] == by[3]["text"] == ""
    assert by[None]["text"] == "plain text" and by[4]["n_chars"] == 6 * 30000 - 1 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert extracted(df.limit(0), page_model).count() == 0


ELEMENTS = {
    **{f"h{n}": (f"<h{n}>A heading</h{n}>", ["A heading"]) for n in range(1, 7)},
    "ol": ("<ol><li>first thing<li>second thing</ol>", ["first thing", "second thing"]),
    "ol of sentences": ("<ol><li>Do this first.</li><li>Then do that.</li></ol>", ["Do this first.", "Then do that."]),
    "ul": ("<ul><li>one item</li><li>another</li></ul>", ["one item", "another"]),
    "ul of links": ("<ul><li><a href='/a'>A link</a></li><li><a href='/b'>Another link</a></li><li><a href='/c'>Third</a></li></ul>", ["A link", "Another link", "Third"]),
    "one item": ("<ul><li>only item</ul>", ["only item"]),
    "dl": ("<dl><dt>Term<dd>What it means.<dt>Other<dd>Something else</dl>", ["Term", "What it means.", "Other", "Something else"]),
    "pre": ("<pre><code>x = 1\n  y = 2</code></pre>", ["x = 1 y = 2"]),
    "figure": ("<figure><img src=x><figcaption>A caption</figcaption></figure>", ["A caption"]),
    "details": ("<details><summary>More on it</summary><p>Hidden at first, still text.</p></details>", ["More on it", "Hidden at first, still text."]),
    "section": ("<section><h2>Part two</h2><p>It goes on here.</p><section><h3>Deeper</h3><p>And on.</p></section></section>", ["Part two", "It goes on here.", "Deeper", "And on."]),
    "blockquote": ("<blockquote>Somebody said so</blockquote>", ["Somebody said so"]),
    "table": ("<table><tr><th>Name<th>Size</tr><tr><td>a<td>12</tr></table>", ["Name", "Size", "a", "12"]),
    "div": ("<div>Plain words in a div.</div>", ["Plain words in a div."]),
    "address": ("<address>Some street 5</address>", ["Some street 5"]),
    "hr": ("<hr>", []),
}


@pytest.fixture(scope="module")
def full_model(spark):
    from sunloom.llm.extract import labelled_pages, train

    return train(labelled_pages(spark))


@pytest.mark.parametrize("name", ELEMENTS)
@pytest.mark.parametrize("around", ["<article>{}</article>", "<div class=post>{}</div>", "<main id=content><div class='entry-content'>{}</div></main>"])
def test_every_element_of_an_article_stays(full_model, name, around):
    from sunloom.llm.extract import main_text

    element, lines = ELEMENTS[name]
    before, after = "The first paragraph says something at length, and ends.", "The last paragraph closes the matter for good."
    nav = "<nav><h2>Pages</h2><ul><li><a href=/>Home</a></li><li><a href=/x>About us</a></li><li><a href=/y>Contact</a></li></ul></nav>"
    inside = around.format(f"<h1>Title of it</h1><p>{before}</p>{element}<p>{after}</p>")
    page = f"<html><head><title>x</title></head><body>{nav}{inside}<aside class=sidebar><h3>Popular</h3><ul><li><a href=/p>Other post</a></ul></aside><footer>&copy; Somebody</footer></body></html>"
    assert main_text(page, full_model).split("\n") == ["Title of it", before, *lines, after]


@pytest.mark.parametrize("page", [
    "<p>" + "<a " * 350_000, "<p>" + '<a "' * 250_000, "<a " * 300_000 + '">"', "<div>" * 4000 + "</x></b>" * 100_000, "<b><div>" + "<i>" * 100_000 + "</b>" * 100_000,
    "<div>" * 100_000 + "<li>" * 100_000, "<div>" * 200_000, "<script>" + "</script " * 100_000, "<!--" * 250_000, "<" * 1_000_000, "<table>" * 50_000 + "<td>" * 50_000 + "<tr>" * 50_000,
], ids=lambda p: p[:12])
def test_broken_markup_takes_linear_time(page):
    import time

    from sunloom.llm.pagetree import parse

    start = time.process_time()
    parse(page)
    assert time.process_time() - start < 4


def test_unfinished_tags_and_quotes():
    from sunloom.llm.pagetree import parse

    text = lambda page: [t for _, t in parse(page)[1]]
    assert text("<p>a <b c=\"d>\">e</b> f</p>") == ["a e f"]
    assert text("<p>one <i x=\"y>two</i> three") == ["one two three"]
    assert text("<p>1 < 2 and <3 but a<b") == ["1 < 2 and <3 but a<b"]
    assert text("<p>a</b></x>b</p>c") == ["ab", "c"]


def test_pages_with_optional_tags_left_out(page_model):
    from sunloom.llm.extract import main_text

    article = "<article><p>One sentence of the article here.</p><p>Another sentence, with <math><mi>x</mi><mo>=</mo><mn>2</mn></math> in it.</p></article>"
    want = "One sentence of the article here.\nAnother sentence, with x=2 in it."
    for page in (
        f"<html><head><title>x</title></head><body>{article}</body></html>", f"<html><head><title>x</title><body>{article}", f"<html><head><title>x</title>{article}",
        f"<head><meta charset=utf-8><link href=x><script>var a='<p>';</script>\n<noscript>y</noscript><style>p{{}}</style><template><p>z</p></template>{article}",
        f"<html><title>x</title><body>{article}</body></html>", f"<title>x</title>{article}", f"<head><img src=x>{article}",
    ):
        assert main_text(page, page_model) == want, page
    assert main_text("<head><title>x</title>\n Only <b>text</b>.", page_model) == "Only text."
    assert main_text("<head><title>x</title><a href=y>Only</a> text.", page_model) == "Only text."


# ---- packing and BPE ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def library_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_packing_places_every_token_once(docs_of, odd_texts, library):
    from sunloom.llm.packing import packed

    texts = odd_texts + [f"text number {k} " * (k % 90) for k in range(300)]
    docs = docs_of([*enumerate(texts), (3, "again"), (None, "no id")]).withColumn("offset", F.lit("clash")).coalesce(2)
    got = rows(packed(docs, BPE))
    by = {}
    for r in sorted(got, key=lambda r: r["start"]):
        by.setdefault((r["doc_id"], r["doc_tokens"], None if r["doc_id"] != 3 else None), []).append(r)
    for k, text in enumerate(texts):
        if k == 3:
            continue
        ids = array("I", library_ids(library, text) + [0]).tobytes()
        pieces = by[k, len(ids) // 4, None]
        assert b"".join(bytes(p["ids"]) for p in pieces) == ids
        assert all(p["ids_crc32"] == zlib.crc32(p["ids"]) and p["length"] == len(p["ids"]) // 4 for p in pieces)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    tokens = sum(r["length"] for r in got)
    assert 1024 * len(sequences) <= 1.03 * tokens + 2 * 1024
    assert packed(docs.limit(0), BPE).count() == 0


def test_differencing_keeps_all_and_balances():
    from sunloom.llm.packing import near_equal_windows

    rng = random.Random(2)
    for n in (0, 1, 2, 3, 50, 300):
        sizes = [rng.randint(1, 256) for _ in range(n)]
        windows = near_equal_windows(sizes, 1024)
        assert sorted(k for w in windows for k in w) == list(range(n))
        loads = [sum(sizes[k] for k in w) for w in windows]
        assert all(x <= 1024 for x in loads) and (n < 300 or max(loads) - min(loads) < 100)
    assert sorted(near_equal_windows([1000, 1000, 30], 1024)) == [(0,), (1,), (2,)] or len(near_equal_windows([1000, 1000, 30], 1024)) == 3
    assert [len(w) for w in near_equal_windows([512, 512], 1024)] == [2]


def test_bpe_equals_the_library(docs_of, odd_texts, library):
    from sunloom.llm.bpe import decoded, encoded, round_trip

    rng = random.Random(1)
    letters = ["a", "b", " ", "  ", "\n", "é", "'s", "'", "<|", "|>", "<|endoftext|>", "1", "日", "\xa0", "\x85", ".", "!!", "th", "ing", "😀", "aaa"]
    texts = odd_texts + ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(400)]
    docs = docs_of([*enumerate(texts), (None, "no id"), (0, None)]).withColumn("ids", F.lit("clash"))
    want = {k: array("I", library_ids(library, t)).tobytes() for k, t in enumerate(texts)}
    ids = encoded(docs, BPE)
    assert all(bytes(r["ids"]) == want[r["doc_id"]] for r in rows(ids) if r["doc_id"] is not None)
    assert all(r["text"] == (texts[r["doc_id"]] or "") for r in rows(decoded(ids, BPE)) if r["doc_id"] is not None)
    got = rows(round_trip(docs, BPE))
    assert len(got) == len(texts) + 2
    for r in got:
        if r["doc_id"] is not None:
            assert r["n_tokens"] == len(want[r["doc_id"]]) // 4 and r["ids_sha256"] == hashlib.sha256(want[r["doc_id"]]).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    assert round_trip(docs.limit(0), BPE).count() == 0


def test_bpe_forgets_and_goes_on(monkeypatch, library):
    from sunloom.llm import bpe

    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 10_000)
    monkeypatch.setattr(bpe, "REMEMBERED_PAIRS", 50)
    coder = bpe.TrieBpe(BPE)
    texts = [" ".join(f"w{k}x{j}" for j in range(20)) for k in range(30)]
    got = [coder.encode_texts([t])[0] for t in texts for _ in range(2)]
    assert got == [array("I", library_ids(library, t)).tobytes() for t in texts for _ in range(2)]
    assert coder.decode(b"\xff\x00\x00\x00") == library.decode([255], skip_special_tokens=False)


def test_token_counts_equal_the_library(docs_of, odd_texts, monkeypatch):
    import sentencepiece

    from sunloom.llm import tokencount

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert not any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
    docs = docs_of([*enumerate(odd_texts), (7, "again"), (None, "no id")]).withColumn("n_tokens", F.lit("clash"))
    full = tokencount.commonest
    for most in (1_000_000, 3, 0):
        monkeypatch.setattr(tokencount, "commonest", lambda p, most=most: full(p, most))
        got = rows(tokencount.token_counts(docs, PIECES))
        want = Counter((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in [*enumerate(odd_texts), (7, "again"), (None, "no id")])
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)
    assert tokencount.token_counts(docs.limit(0), PIECES).count() == 0


# ---- archives -------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    from sunloom.llm.warc import read_archives, records, write_archives

    big = "<p>é</p>" * 200
    pages = [(1, "u/1", big), (5, "u/5\r\nx: y%", big), (3, None, big), (9, "u", "small"), (8, "u", "small"), (2, "u", None), (4, "u", ""), (6, "u", "x" * 300000), (None, "u", big), (5, "u/5", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = f"file://{tmp_path}/a"
    write_archives(records(df), path, roll_bytes=1000)
    got = rows(read_archives(spark, path))
    assert len(got) == len(pages)
    for r in got:
        same = [p for p in pages if p[0] == r["page_id"]]
        data = (same[0][2] or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest()) and r["url"] in [p[1] for p in same]
        stored = data != big.encode() or r["page_id"] == 5
        assert (r["record_type"], r["refers_to"], r["payload"]) == (("response", None, data) if stored else ("revisit", 5, None))
    assert all(r["payload"] is None for r in rows(read_archives(spark, path, payload=False)))
    empty = f"file://{tmp_path}/b"
    write_archives(records(df.limit(0)), empty)
    assert read_archives(spark, empty).count() == 0


def test_broken_archives_are_noticed():
    import io

    from sunloom.llm.warc import BrokenArchive, decode_record, encode_record, members

    data = b"payload " * 50
    one = encode_record(1, "u", data, hashlib.sha1(data).hexdigest(), None, "1970-01-01T00:00:00Z")
    raw = next(members(io.BytesIO(one + one)))
    assert len(list(members(io.BytesIO(one + one)))) == 2 and decode_record(raw)[-1] == data
    for bad in (raw.replace(b"payload payload", b"payload pAyload", 1), raw[:-1], raw.replace(b"Content-Length: 4", b"Content-Length: 5"), b"x" + raw):
        with pytest.raises((BrokenArchive, KeyError)):
            decode_record(bad)
    for cut in (one[:-3], one + one[:20], b"no gzip"):
        with pytest.raises(BrokenArchive):
            list(members(io.BytesIO(cut)))


# ---- cleaning, copies, language -------------------------------------------------------------------------------------


def test_quality_on_odd_rows(docs_of, odd_texts):
    from sunloom.llm.quality import clean_documents, quality_verdict

    good = ". ".join(" ".join(f"word{k}{j}" for j in range(9)) for k in range(10)) + "."
    page = good + "\nHome | About | Terms | Contact | Help | More\nAll rights reserved.\n" + good.replace("word", "term")
    docs = docs_of([*enumerate(odd_texts), (100, good), (101, page), (101, page), (None, good)]).withColumn("cleaned", F.lit("clash")).withColumn("carry", F.lit(1))
    got = {r["doc_id"]: r for r in rows(quality_verdict(docs))}
    assert got[100]["kept"] and got[101]["kept"] and got[101]["cleaned"] == good + "\n" + good.replace("word", "term")
    for k, text in enumerate(odd_texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(windows)
        covered = {i + d for i, t in enumerate(windows) if n[t] > 1 for d in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[k][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[k]["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    kept = clean_documents(docs)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in rows(kept)) >= Counter([100, 101, 101, None])
    assert all(r["n_chars"] == len(r["text"]) for r in rows(kept))
    assert quality_verdict(docs.limit(0)).count() == 0


def test_quality_keeps_wrapped_prose_and_plain_uses_of_notice_words(docs_of):
    import textwrap

    from sunloom.llm.quality import quality_verdict

    def prose(n, end=".", noun="Word"):
        return " ".join(" ".join(f"{noun if j % 4 == 3 else 'term'}{k}x{j}" for j in range(14)).capitalize() + end for k in range(n))

    wrapped = textwrap.fill(prose(20), 72)
    assert sum("." not in x for x in wrapped.split("\n")) > 10
    scripts = ["\n".join(prose(6).replace(".", e).split(f"{e} ")) + e for e in "\u0964\u06d4\u061f\uff01\uff1f"]
    plain = ["We design in wood, and they catalog in ink.", "The film was released under another title in 1950.", "She baked cookies for the whole school on Friday."]
    notices = ["All rights reserved.", "Released under the MIT License.", "Click here to read more", "We use cookies to improve things.", "\u00a9 2020 Someone, all rights reserved."]
    menu = "home about contact help more\nnews sports weather world local\nHome and garden and much besides"
    docs = [wrapped, *scripts, "\n".join([prose(9), *plain]), "\n".join([prose(9), *notices]), prose(9) + "\n\n" + menu, textwrap.fill(prose(12), 60) + "\n\n" + textwrap.fill(prose(5, noun="Thing"), 60)]
    got = [r["cleaned"] for r in sorted(rows(quality_verdict(docs_of(enumerate(docs)))), key=lambda r: r["doc_id"]) if r["kept"]]
    assert len(got) == len(docs)
    assert got[:7] == docs[:7] and got[7] == prose(9) == got[8] and got[9] == docs[9].replace("\n\n", "\n")


def test_quality_equals_its_sql_on_wrapped_signed_and_foreign_lines(docs_of):
    import random
    import textwrap

    import duckdb

    from sunloom.llm.quality import quality_verdict
    from sunloom.llm.queries import QUALITY_SQL

    rng = random.Random(7)
    ends = list("!.?\u0964\u06d4\u061f\uff01\u3002\u2026")
    odd = ["", "  ", "\t", "HOME NEWS SPORT", "# * | < >", "cookies cookie policy", "We use cookies here, and cookies there", "sign in", "Sign in or log in at any later time",
           "design in the catalog inn released", "read more at https://x.org", "\u00a9 someone, all rights reserved by others", "Home about contact help news", "home about contact help news",
           "\u4e2d\u6587 \u5b57 \u5b57 \u5b57 \u5b57", "a line that ends.\u2028", 'he said "well then we go.") ', "five words and\rone return", "x" * 130 + " long lines of many words"]

    def sentence():
        words = ["".join(rng.choices("abcde\u0434\u4e2d\u00e9", k=rng.randint(1, 9))) for _ in range(rng.randint(3, 18))]
        return " ".join(words).capitalize() + rng.choice([*ends, *ends, "", ",", '."'])

    texts = []
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 9)):
            prose = " ".join(sentence() for _ in range(rng.randint(1, 6)))
            parts.append(textwrap.fill(prose, rng.choice([30, 60, 100, 119, 200])) if rng.random() < 0.7 else rng.choice(odd))
        texts.append("".join(p + rng.choice(["\n", "\n\n", "\n \n"]) for p in parts))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = quality_verdict(docs_of(enumerate(texts))).select(*columns, "lost_chars").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = con.execute(QUALITY_SQL.replace("SELECT doc_id, n_words, word_chars", "SELECT doc_id, lost_chars, n_words, word_chars")).fetchdf()
    want = {int(r.doc_id): (*[int(r[c]) for c in columns[1:]], int(r.lost_chars)) for _, r in want.iterrows()}
    mine = {r.doc_id: (*[int(r[c]) for c in columns[1:]], r.lost_chars) for r in got}
    assert {i: (mine[i], want[i], texts[i]) for i in mine if mine[i] != want[i]} == {}
    assert 30 < sum(r.kept for r in got) < 270


def test_one_long_line_does_not_change_how_other_paragraphs_are_read(docs_of):
    import textwrap

    from sunloom.llm.quality import quality_verdict

    prose = " ".join(" ".join(f"Name{k}x{j}" for j in range(14)) + "." for k in range(12))
    wrapped = textwrap.fill(prose, 72)
    long = " ".join(f"Other{j}" for j in range(40)) + "."
    got = {r.doc_id: r for r in quality_verdict(docs_of([(1, wrapped), (2, wrapped + "\n\n" + long)])).collect()}
    assert got[1].lost_chars == got[2].lost_chars == 0 and got[1].kept and got[2].kept


def test_exact_copies(spark, docs_of):
    from sunloom.llm.common import scratch_path
    from sunloom.llm.exact import DigestIndex, drop_exact_duplicates, exact_duplicates

    data = [(1, "a"), (9, "a"), (4, "a"), (2, None), (3, ""), (5, "b"), (5, "b"), (None, "c"), (None, "c"), (6, "d" * 200000), (7, "a ")]
    docs = docs_of(data).withColumn("keep_id", F.lit("clash"))
    got = rows(exact_duplicates(docs))
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == Counter(
        [(1, 9, 3, False), (9, 9, 3, True), (4, 9, 3, False), (2, 3, 2, False), (3, 3, 2, True), (5, 5, 2, True), (5, 5, 2, False), (None, None, 2, True), (None, None, 2, False), (6, 6, 1, True), (7, 7, 1, True)]
    )
    assert {r["text_sha256"] for r in got if r["doc_id"] == 2} == {hashlib.sha256(b"").hexdigest()}
    left = drop_exact_duplicates(docs)
    assert left.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in rows(left)) == Counter([(9, "a"), (3, ""), (5, "b"), (None, "c"), (6, "d" * 200000), (7, "a ")])
    assert exact_duplicates(docs.limit(0)).count() == 0 and drop_exact_duplicates(docs.limit(0)).count() == 0
    path = scratch_path(spark, "index")
    index = DigestIndex(spark, path, 4)
    assert exact_duplicates(docs_of([(10, "x"), (11, "y")]), index).filter("kept").count() == 2
    again = DigestIndex(spark, path, 4)  # the table is found where it was left
    late = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in rows(exact_duplicates(docs_of([(20, "x"), (21, "z")]), again))}
    assert late == {20: (10, False), 21: (21, True)} and again.rows().count() == 3


def test_index_keeps_its_buckets(spark, docs_of):
    from sunloom.llm.common import scratch_path
    from sunloom.llm.exact import DigestIndex, exact_duplicates

    path, texts = scratch_path(spark, "index"), [(k, f"text {k}") for k in range(40)]
    assert exact_duplicates(docs_of(texts), DigestIndex(spark, path, 4)).filter("kept").count() == 40
    for buckets in (8, 3, 1):
        again = DigestIndex(spark, path, buckets)
        assert again.buckets == 4
        got = rows(exact_duplicates(docs_of([(100 + k, t) for k, t in texts]), again))
        assert len(got) == 40 and not any(r["kept"] for r in got) and {r["keep_id"] for r in got} == set(range(40))
    assert DigestIndex(spark, path, 2).rows().count() == 40


def test_index_is_not_shuffled(spark, docs_of):
    from sunloom.llm.common import scratch_path
    from sunloom.llm.exact import DigestIndex, sign

    index = DigestIndex(spark, scratch_path(spark, "index"), 4)
    index.add(sign(docs_of([(1, "a"), (2, "b")])))
    batch = sign(docs_of([(3, "c")])).groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
    plan = batch.hint("merge").join(index.rows(), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


def test_language_on_odd_rows(spark, docs_of, odd_texts):
    from sunloom.llm.langid import keep_known_languages, language_verdict

    rng = random.Random(4)
    made = {"en": ["the", "ing", "th", "and"], "fr": ["eau", "que", "é", "ou"]}
    word = lambda k: "".join(rng.choices(made[k], k=3))
    data = [(k, " ".join(word(lang) for _ in range(60)), lang, 0) for k in range(300) for lang in [("en", "fr")[k % 2]]]
    data += [(1000 + k, t, None, 0) for k, t in enumerate(odd_texts)] + [(None, "the ing", "en", 0), (1, data[1][1], "fr", 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, n_chars long").withColumn("score", F.lit("clash"))
    got = rows(language_verdict(docs))
    assert len(got) == len(data) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["lang_pred"] == ("en", "fr")[k % 2] and not by[k]["rejected"] for k in range(300))
    assert all(by[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(300))
    for k, t in enumerate(odd_texts):
        assert (by[1000 + k]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))
    kept = keep_known_languages(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in rows(kept)} >= set(range(300))
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in rows(language_verdict(nothing))} == {"und"} and language_verdict(docs.limit(0)).count() == 0


def test_only_letters_make_a_language(spark):
    from sunloom.llm.langid import Classifier, LanguageModel, has_letter

    marks = ["½ ² ③", "Ⅷ ①", "\u0301\u0308", "12 #*", "१२३", "_", "", " \n"]
    assert not any(map(has_letter, marks)) and all(map(has_letter, ["a", "1a", "日", "ª", "ʰ", "\u01c5", "½é"]))
    decide = Classifier(LanguageModel((("en", b" the and of "), ("fr", b" le la et "))))
    assert {decide(t) for t in [*marks, None]} == {("und", 0.0, True)}


def test_language_is_that_of_the_whole_text():
    """Against a plain version: every block of the whole plain text, with every dictionary."""
    import zstandard

    from sunloom.llm.langid import Classifier, LanguageModel

    model = LanguageModel((("en", b" " + b" ".join(b"the and of was ing tion".split() * 40) + b" "), ("fr", b" " + b" ".join(b"le la et que eau des".split() * 40) + b" ")))
    decide = Classifier(model)
    rng = random.Random(9)
    c = model.config
    for _ in range(30):
        text = " ".join(rng.choice(["The", "and", "of,", "was", "la", "et", "QUE", "42"]) for _ in range(rng.randint(1, 4000)))
        data = (" " + " ".join("".join(x if x.isalpha() or ord(x) > 127 else " " for x in text.lower()).split()) + " ").encode()
        size = {}
        for name, words in model.dictionaries:
            d = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            z = zstandard.ZstdCompressor(dict_data=d, level=c.level, write_content_size=False, write_checksum=False, write_dict_id=False)
            size[name] = sum(len(z.compress(data[i : i + c.block_bytes])) for i in range(0, len(data), c.block_bytes))
        best = min(size, key=lambda n: (size[n], n))
        score = 1 - size[best] / max(size.values())
        assert decide(text)[:2] == (best, score)
    # long text of one language with a varied minority of the other keeps its language: it is weighed by text
    mostly = "the and of was " * 2000 + " ".join(f"la{k} et" for k in range(300))
    assert decide(mostly)[0] == "en"


def test_filters_leave_columns_of_any_name_alone(spark, docs_of):
    """Columns named like those the operators make inside."""
    from sunloom.llm.exact import drop_exact_duplicates
    from sunloom.llm.langid import keep_known_languages
    from sunloom.llm.ngram_join import drop_near_duplicates
    from sunloom.llm.quality import clean_documents

    texts = [(k, f"the quick brown fox number {k} jumps over the lazy dog again and again.") for k in range(6)] + [(6, "the quick brown fox number 1 jumps over the lazy dog again and again.")]
    names = ["row", "language", "id", "digest", "kept", "copies", "__id", "__sha", "__dropped", "__language", "doc", "key", "n", "carry", "component_id", "keep_id", "score"]
    docs = docs_of(texts).withColumns({n: F.concat(F.lit(f"{n} of "), F.col("doc_id")) for n in names})
    for keep in (drop_exact_duplicates, keep_known_languages, drop_near_duplicates, clean_documents):
        out = keep(docs)
        assert out.columns == docs.columns
        for r in rows(out):
            assert all(r[n] == f"{n} of {r['doc_id']}" for n in names)
    assert {r["doc_id"] for r in rows(drop_exact_duplicates(docs))} == {0, 2, 3, 4, 5, 6}


# ---- near copies ----------------------------------------------------------------------------------------------------


def brute_components(texts, percent=75):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed, n):
    """Chains, stars and borderline pairs around the threshold, with passages that many texts share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randint(1, 4)))
    passages = [[word() for _ in range(rng.randint(6, 25))] for _ in range(4)]
    bases = [[word() for _ in range(rng.randint(3, 120))] for _ in range(max(1, n // 8))]
    out = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 2)] = [word() for _ in range(rng.randint(0, 2))]
        if rng.random() < 0.3:
            w += rng.choice(passages)
        if rng.random() < 0.1:
            w = [x for p in rng.choices(passages, k=3) for x in p]
        out.append((i, " ".join(w).upper() if rng.random() < 0.1 else "\n".join([" ".join(w[:7]), " ".join(w[7:])])))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ngram_join_equals_all_pairs(docs_of, seed, monkeypatch):
    from sunloom.llm import ngram_join

    monkeypatch.setattr(ngram_join, "CHUNK_GRAMS", 500)  # many chunks, so that classes meet across them
    texts = near_copies(seed, 240)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(ngram_join.ngram_components(docs_of(texts).repartition(5)))}
    assert got == brute_components(texts)


def test_ngram_join_on_odd_rows(docs_of, odd_texts):
    from sunloom.llm.ngram_join import drop_near_duplicates, ngram_components

    texts = [*enumerate(odd_texts), (50, "one two three"), (51, "ONE two\tthree"), (52, "one two three four")]
    docs = docs_of([*texts, (50, "one two three"), (None, "one two three"), (None, "lone text of a row without id")]).withColumn("key", F.lit("clash"))
    got = rows(ngram_components(docs))
    want = brute_components(texts)
    assert len(got) == len(texts) + 3
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert sorted((r["component_id"] is None, r["component_id"]) for r in got if r["doc_id"] is None) == [(False, 50), (True, None)]
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in rows(left)} == {i for i, (_, c) in want.items() if i == c} | {None}
    assert ngram_components(docs.limit(0)).count() == 0 and drop_near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    from sunloom.llm.components import components

    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(300, 299), (299, 300), (5, 5)]
    got = {r["node"]: r["root"] for r in rows(components(spark.createDataFrame(links, "u long, v long")))}
    assert got == {k: 100 for k in range(100, 161)} | {k: 7 for k in [7, *range(200, 260)]} | {299: 299, 300: 299}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
