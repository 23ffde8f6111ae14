"""The pipeline against plain Python stages, and the queries against the library and brute force on the smallest tables."""
from array import array
from collections import Counter

import public_tokenizers
from test_operators_small import brute_components, rows

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
    assert all(n in entry.oracle_sql() for n in names if n.split("_")[0] in {"op1", "op4", "op6", "op7", "op9", "op12", "op13"})


def test_pipeline_equals_plain_stages(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from sunloom.llm.langid import language_verdict
    from sunloom.llm.quality import quality_verdict

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "exact_dedup", "near_dedup", "packing"]
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
    known = {r["doc_id"] for r in rows(language_verdict(docs)) if not r["rejected"]}
    clean = {r["doc_id"]: r["cleaned"] for r in rows(quality_verdict(docs)) if r["kept"] and r["doc_id"] in known}
    last = {}
    for i in sorted(clean):
        last[clean[i]] = i
    single = {i: t for t, i in last.items()}
    near = brute_components(single.items())
    kept = {i: single[i] for i, (_, c) in near.items() if i == c}
    assert {r["doc_id"]: r["text"] for r in rows(out)} == kept
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = Counter()
    for r in rows(corpus_pipeline.run(spark, SF)):
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert got == {(i, n): n for i, t in kept.items() for n in [len(library.encode(t, add_special_tokens=False).ids) + 1]}


def test_bpe_query_equals_the_library(spark):
    import hashlib

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in rows(spark.read.parquet(f"{SF}/documents.parquet"))}
    for r in rows(entry.queries()["op8_bpe"](spark, SF)):
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest())


def test_token_count_query_equals_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in rows(spark.read.parquet(f"{SF}/documents.parquet"))}
    for r in rows(entry.queries()["op5_token_counts"](spark, SF)):
        assert (r["n_bytes"], r["n_tokens"]) == (len(texts[r["doc_id"]].encode()), len(model.encode(texts[r["doc_id"]])))


def test_page_query_equals_the_article(spark):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in rows(spark.read.parquet(f"{SF}/pages.parquet"))}
    for r in rows(entry.queries()["op2_html_extract"](spark, SF)):
        article = re.search(r"<article[^>]*>(.*?)</article>", pages[r["page_id"]], re.DOTALL)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_language_query_on_held_out_rows(spark):
    lang = {r["doc_id"]: r["lang"] for r in rows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))}
    held = [r for r in rows(entry.queries()["op10_language_id"](spark, "/root/testdata/sf0.01")) if r["held_out"]]
    assert len(held) > 100 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)
