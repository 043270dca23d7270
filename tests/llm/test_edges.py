"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pathlib

import pytest
from pyspark.sql import functions as F

from priceloom.llm import bpe_counts, capture_index, common, compression_bands, content_chunks, jaccard_join, line_crf, site_templates, source_mix, string_tiling, template_tree

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
PROSE = " ".join(WORDS[i * 7 % 24] + str(i % 5 or "") for i in range(60))
SCHEMA = "doc_id bigint, text string, source string, kept string, N_WORDS int, copies int, template string"
ROWS = [
    (1, PROSE, "a", "x", 1, 1, "t"),
    (1, PROSE, "a", "x", 1, 1, "t"),
    (2, PROSE + " tail", "a", None, 1, 1, None),
    (3, None, None, "x", None, None, None),
    (None, PROSE, None, "x", 1, 1, "t"),
    (4, "", "b", "x", 1, 1, "t"),
    (5, "word\n" * 4_000, "b", "x", 1, 1, "t"),
    (6, "x" * 300_000, "b", "x", 1, 1, "t"),
    (7, "é 漢字 😀\n\t \x00 ünïcode", "b", "x", 1, 1, "t"),
    (8, " \n \n", "c", "x", 1, 1, "t"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, " ".join(PROSE.split()[10:40])), (2, None), (3, ""), (None, "one two")], "item_id bigint, text string")


def test_compression_bands(docs, none):
    rows = compression_bands.compression_bands(docs)
    assert [c.lower() for c in rows.columns].count("n_words") == 1 and rows.columns[:3] == ["doc_id", "text", "source"]
    got = {r["doc_id"]: r for r in rows.collect()}
    assert len(rows.collect()) == len(ROWS)
    assert got[3]["n_words"] == 0 and got[3]["base_failed"] and not got[3]["kept"]
    assert got[4]["ratio"] == 0.0 and got[5]["n_dup_lines"] == 3_999 and not got[5]["kept"]
    assert compression_bands.compression_bands(none).count() == 0


def test_token_counts(docs, none):
    got = {r["doc_id"]: r for r in bpe_counts.token_counts(docs).collect()}
    assert got[3]["n_tokens"] == got[4]["n_tokens"] == 0 and got[6]["n_bytes"] == 300_000 and got[5]["over_limit"]
    assert bpe_counts.token_counts(none).count() == 0


def test_source_mix(docs, none):
    rows = source_mix.mix_sources(docs)
    assert rows.count() == len(ROWS)
    got = rows.collect()
    assert all(r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in got)
    assert {r["source"] for r in got} == {"a", "b", "c", None}
    assert sorted(map(str, got)) == sorted(map(str, source_mix.mix_sources(docs).collect()))
    assert source_mix.mix_sources(none).count() == 0
    plan = source_mix.mix_plan(docs)
    mixed = source_mix.mixed_documents(docs, plan)
    assert mixed.columns.count("copies") == 1 and mixed.columns[:3] == ["doc_id", "text", "source"]
    assert sorted((str(r["doc_id"]), r["copies"]) for r in mixed.collect()) == sorted((str(r["doc_id"]), r["copies"]) for r in got if r["copies"])
    assert source_mix.mixed_documents(none, source_mix.mix_plan(none)).count() == 0


def test_content_chunks(docs, none):
    spans = content_chunks.repeated_spans(docs)
    pairs = {(r["doc_id"], r["first_doc_id"]) for r in spans.collect()}
    assert any(a in (1, 2) for a, _ in pairs)
    cut = content_chunks.without_spans(docs, spans)
    assert cut.columns == docs.columns and cut.count() == len(ROWS)
    assert {r["doc_id"]: r["text"] for r in cut.collect()}[3] is None
    assert content_chunks.repeated_spans(none).count() == 0


def test_template_tree(docs, none):
    rows = template_tree.dedup_lines(docs, min_docs=2)
    got = {r["doc_id"]: r for r in rows.collect()}
    assert rows.count() == len(ROWS) and got[3]["text"] is None and got[3]["n_lines"] == 0 and got[4]["n_lines"] == 1
    assert got[5]["text"] == ROWS[6][1]
    assert template_tree.dedup_lines(none).count() == 0


def test_jaccard_join(docs, none):
    rows = jaccard_join.jaccard_components(docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows.collect()}
    assert rows.count() == len(ROWS)
    assert got[1][1] == got[2][1] == got[None][1] == 1
    assert got[3] == (0, 3) and got[4] == (0, 4) and got[8] == (0, 8) and got[5][0] == 1 and got[6][0] == 1
    assert jaccard_join.jaccard_components(none).count() == 0


def test_string_tiling(docs, none, items):
    bad = string_tiling.contaminated(docs, items).collect()
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in bad) == [("1", 1), ("1", 1), ("2", 1), ("None", 1)]
    left = string_tiling.decontaminated(docs, items)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {3, 4, 5, 6, 7, 8}
    assert string_tiling.contaminated(none, items).count() == 0 and string_tiling.contaminated(docs, items.limit(0)).count() == 0


def test_line_crf(docs, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 0), (6, 0), (7, 0), (None, 1), (8, None)], "doc_id bigint, quality int")
    model = line_crf.train(docs, labels)
    rows = line_crf.score_quality(docs, model)
    got = {r["doc_id"]: r for r in rows.collect()}
    assert rows.count() == len(ROWS) and got[3]["score"] == got[4]["score"] == got[8]["score"] == 0.0
    assert all(0 <= r["score"] <= 1 for r in got.values()) and not got[None]["held_out"]
    assert line_crf.score_quality(none, model).count() == 0
    assert line_crf.train(docs, labels.limit(0)) == 0.5 and line_crf.train(docs, labels.where("quality = 1")) == 1.0


def test_site_templates(spark):
    pages = [(i, f"http://h.example/{i}", f"<div class=x><ul><li>home<li>about</ul></div><p>page {i} &amp; more</p>", "t") for i in range(8)]
    pages += [(20, None, None, None), (21, "no url", "", None), (20, None, None, None), (22, "http://h.example/a", "<p>" * 2000 + "a < b <b>c", None)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, text string")
    rows = site_templates.main_text(df)
    got = {r["page_id"]: r for r in rows.collect()}
    assert rows.count() == len(pages) and rows.columns.count("text") == 1
    assert got[3]["text"] == "page 3 & more" and got[20]["text"] == "" and got[22]["text"] == "a < b c" and got[22]["n_chars"] == 7
    assert site_templates.main_text(df.limit(0)).count() == 0


def test_site_templates_write_hosts_only_where_many(spark, monkeypatch):
    pages = [(i, f"http://h{i % 3}.example/{i}", f"<ul><li>home {i % 3}<li>about</ul><p>page {i}</p>") for i in range(30)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    texts = lambda: {r["page_id"]: r["text"] for r in site_templates.main_text(df).collect()}
    tables = lambda: set(pathlib.Path(common.shared_dir(spark).removeprefix("file:")).glob("pages-*/*-hosts"))
    before = tables()
    want = {i: f"page {i}" for i in range(30)}
    assert texts() == want and tables() == before
    monkeypatch.setattr(site_templates, "BROADCAST_HOSTS", 2)
    assert texts() == want and len(tables()) == len(before) + 1


def test_capture_index(spark):
    trap = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    pages = [(3, "http://b.example/x?y#z", trap), (1, "http://b.example/x", trap), (1, "http://b.example/x", trap), (2, None, None), (4, "", ""), (None, "http://c.example", "é"), (5, "http://a b\n.example/", "long" * 50_000)]
    rows = capture_index.archived_pages(spark.createDataFrame(pages, "page_id bigint, url string, html string"))
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows.collect()}
    assert rows.count() == len(pages)
    n = len(trap.encode())
    assert got == {(3, "revisit", 1, n), (1, "response", None, n), (2, "response", None, 0), (4, "revisit", 2, 0), (None, "response", None, 2), (5, "response", None, 200_000)}
    assert capture_index.archived_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    assert rows.where(F.length("payload_digest") != 32).count() == 0
