"""Cases that an operator once left out."""

import random

import pytest

import corpus_pipeline
from priceloom.llm import capture_index, compression_bands, content_chunks, site_templates, source_mix, string_tiling, template_tree

DATA = "/root/testdata/sf0.001"


def test_long_lines_recur_from_two_documents_and_short_ones_by_their_count(spark):
    rng = random.Random(31)
    fill = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(n))
    long, medium = fill(52), fill(12)
    docs = [f"{fill(25)}\n{long} on day {i}" if i < 2 else f"{fill(25)}\n{medium}\n \n" if i < 9 else f"{fill(25)}\nLes.\nAnd  ornd.\n{'ab' if i < 18 else 'cd'}" for i in range(30)]
    got = {r["doc_id"]: r for r in template_tree.dedup_lines(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")).collect()}
    for i, text in enumerate(docs):
        lines = text.split("\n")
        want = lines[:1] if i == 1 else [*lines[:1], lines[3]] if 9 < i < 19 else lines[:1] if i > 19 else lines
        if i == 18:
            want = [lines[0], "cd"]
        if i == 19:
            want = [lines[0]]
        assert got[i]["text"].split("\n") == want, i


def test_the_end_of_a_text_is_held_against_the_chunk_band(spark):
    rng = random.Random(32)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(700)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))[:n]
    noise = "".join(chr(rng.randint(33, 126)) for _ in range(4000))
    texts = [prose(4096) + noise, noise + prose(4096), prose(8096), prose(8192), prose(4095)]
    rows = compression_bands.compression_bands(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), bands=((1 << 62, 0.0, 99.0),), chunk_band=(1.4, 9.0)).collect()
    got = {r["doc_id"]: (r["n_chunks"], r["n_bad_chunks"], r["kept"]) for r in rows}
    assert got == {0: (2, 1, False), 1: (2, 1, False), 2: (2, 0, True), 3: (2, 0, True), 4: (0, 0, True)}


def test_urls_that_end_in_wide_spaces_are_found(spark):
    ends = ["\u00a0", "\u0085", "\u3000", "\u2003", " ", "\t"]
    pages = spark.createDataFrame([(i, f"http://a.example/p{i}{e}", f"<p>{i}</p>") for i, e in enumerate(ends)], "page_id bigint, url string, html string")
    assert {r["page_id"] for r in capture_index.archived_pages(pages).collect()} == set(range(len(ends)))


def test_blocks_under_different_articles_are_cut_and_copies_of_one_article_stay(spark):
    page = lambda own, notice: f"<body><article><p>{own}</p>{notice}</article></body>"
    rows = [(i, "http://a.example/", page(f"own {i}", "<p>plain notice</p><ul><li>advert</li></ul>")) for i in range(6)]
    rows += [(10 + i, "http://b.example/", page("one story", "<p>told often</p>")) for i in range(6)]
    rows += [(100 + i, "http://c.example/", page(f"own {i}", "<p>section notice</p>" if i < 60 else "")) for i in range(260)]
    got = {r["page_id"]: r["text"] for r in site_templates.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"own {i % 100}" if i < 6 else "one story\ntold often" if i < 100 else f"own {i - 100}" for i, _, _ in rows}


def test_every_passage_of_51_words_keeps_a_span():
    rng = random.Random(33)
    kinds = [
        lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))),
        lambda: rng.choice("ab"),
        lambda: "la",
        lambda: rng.choice(("one", "two", "three")),
    ]
    fill = lambda: " ".join(kinds[0]() for _ in range(rng.randint(1, 40)))
    for k in range(4000):
        passage = " ".join(kinds[k % 4]() for _ in range(51))
        cuts = []
        for _ in range(2):
            head = fill() + " "
            ends = content_chunks.chunk_ends(f"{head}{passage} {fill()}".encode()) - len(head)
            cuts.append({int(e) for e in ends if 0 <= e <= len(passage)})
        run, most = [], 0
        for e in sorted(cuts[0] | cuts[1]):
            run = [*run, e] if e in cuts[0] and e in cuts[1] else []
            most = max(most, len(passage[run[0] : run[-1]].split()) if run else 0)
        assert most >= content_chunks.MIN_SPAN_WORDS, (k, passage)


def test_repeats_without_blanks_are_spans(spark):
    rng = random.Random(34)
    han = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(n))
    passage = han(250)
    texts = [han(rng.randint(50, 200)) + passage + han(rng.randint(50, 200)) for _ in range(8)] + [han(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["doc_id"] for r in content_chunks.repeated_spans(df).collect()} == set(range(1, 8))


def test_repeated_rows_and_plain_runs(spark):
    """Spans equal those of a plain comparison of all runs of chunks; a repeated row changes nothing."""
    rng = random.Random(35)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    fill = lambda n: " ".join(word() for _ in range(n))
    shared, few = [fill(rng.randint(30, 70)) for _ in range(6)], fill(18)
    texts = [" ".join(x for k in range(3) for x in (fill(rng.randint(0, 25)), rng.choice(shared))) for _ in range(40)] + [f"{fill(60)} {few} {fill(60)}" for _ in range(2)]
    rows = [(i // 2, t) for i, t in enumerate(texts[:10])] + list(enumerate(texts, 100))

    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    hashes = {(r["doc_id"], r["text"]): r["h"] for r in df.selectExpr("doc_id", "text", "xxhash64(text) h").collect()}
    by_hash = {(d, h): t for (d, t), h in hashes.items()}
    seen, want = {}, set()
    for key, text in sorted(hashes, key=lambda r: (r[0], hashes[r])):
        blob, spans = text.encode(), []
        ends = [0, *content_chunks.chunk_ends(blob).tolist()]
        for k in range(max(1, len(ends) - content_chunks.RUN)):
            a, b = ends[k], ends[min(k + content_chunks.RUN, len(ends) - 1)]
            if seen.setdefault(blob[a:b], (key, text, k)) == (key, text, k):
                continue
            if spans and spans[-1][2] == k - 1:
                spans[-1][1:] = b, k
            else:
                spans.append([a, b, k])
        want |= {(key, text, a, b) for a, b, _ in spans if len(blob[a:b].split()) >= 24 or b - a >= 256}
    for times in (1, 2):
        got = content_chunks.repeated_spans(spark.createDataFrame(rows * times, "doc_id bigint, text string")).collect()
        assert {(r["doc_id"], by_hash[r["doc_id"], r["text_hash"]], r["start"], r["stop"]) for r in got} == want and len(got) == len(want)
    assert want and not any(d in (140, 141) for d, *_ in want)


def test_repeats_of_an_id_are_told_apart_whatever_the_order(spark):
    """Rows of one id with different texts: the same result in any order, and near its target; bins hold about equal shares."""
    rng = random.Random(36)
    rows = [(7 if i < 60 else i, " ".join(["w"] * rng.randint(1, 20)) + f" t{i}", "a" if i % 3 else "b") for i in range(900)]
    results = []
    for k in range(3):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(k + 1)
        mixed = source_mix.mixed_documents(df, source_mix.mix_plan(df))
        results.append(sorted((r["doc_id"], r["text"], r["copies"]) for r in mixed.collect()))
        assert sorted(r["copies"] for r in source_mix.mix_sources(df).where("copies > 0").collect()) == sorted(r[2] for r in results[-1])
    assert results[0] == results[1] == results[2]


def test_pipeline_keeps_one_of_equal_rows(spark):
    """Equal rows, null ids and texts, empty tables and a further column through every stage."""
    text = " ".join(f"{'abcdefgh'[i % 8]}word{i}x" for i in range(120))
    rows = [(1, text, "en", "s", len(text), 1)] * 3 + [(2, text, "en", "s", len(text), 2), (None, text, "en", None, len(text), 3), (3, None, "en", "s", None, 4), (4, "", None, "s", 0, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, COPIES int")
    kept = corpus_pipeline.near_duplicates(spark, docs, DATA)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4"] and kept.columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, DATA)
        assert [c.lower() for c in after.columns].count("copies") == 1 and after.count() <= len(rows)
        assert stage(spark, docs.limit(0), DATA).count() == 0
    mixed = corpus_pipeline.source_mix(spark, kept, DATA).collect()
    assert all(r["taken"] == 0 for r in mixed if r["doc_id"] != 1) and {r["doc_id"] for r in mixed} <= {1, 3, 4}


def test_short_items_are_found_whole(spark):
    docs = spark.createDataFrame([(1, "so The Quick Fox ran"), (2, "the quick red fox")], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, "the quick fox"), (8, "")], "item_id bigint, text string")
    assert [(r["doc_id"], r["item_id"], r["coverage"]) for r in string_tiling.contaminated(docs, items).collect()] == [(1, 9, 1.0)]


def test_archives_are_scanned_by_small_ranges(tmp_path):
    html = ["x" * n for n in (0, 5, 3_000_000, 40)]
    record = lambda i, h: f"WARC/1.1\r\nWARC-Record-ID: <urn:page:{i}>\r\nX-Long: {'y' * (9000 if i == 1 else 1)}\r\nContent-Length: {len(h)}\r\n\r\n{h}\r\n\r\n"
    data = "".join(record(i, h) for i, h in enumerate(html)).encode()
    sizes = []
    read = lambda count, offset: sizes.append(count) or data[offset : offset + count]
    got = list(capture_index.scan_archive(read, len(data)))
    assert [capture_index.page_number(h["warc-record-id"]) for *_, h in got] == [0, 1, 2, 3] and sum(n for _, n, _ in got) == len(data)
    assert max(sizes) <= capture_index.WINDOW_BYTES


def test_line_dedup_is_the_same_by_broadcast_and_by_shuffle(spark, monkeypatch):
    rng = random.Random(33)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    long = " ".join(word() for _ in range(30))
    docs = [(i, f"{word()} {word()} {word()} {word()}\norder {i} was shipped from {word()} today\nLes.\n{long if i % 3 else word()}") for i in range(24)]
    df = spark.createDataFrame([*docs, docs[5], (None, docs[6][1]), (99, None)], "doc_id bigint, text string")
    rows = lambda **options: sorted(map(repr, template_tree.dedup_lines(df, **options).collect()))
    sent = rows()
    monkeypatch.setattr(template_tree, "BROADCAST_TEMPLATES", 0)
    assert rows(broadcast_leaves=0) == sent
    assert any("n_dropped=3" in r for r in sent)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>story</p></article><div id=comments><ol class='comment-list'><li class='comment'><article class='comment-body'><p>reader hi</article></ol></div>", "story"),
        ("<article><p>story</p></article><aside><article><p>related teaser</article></aside>", "story"),
        ("<article><p>story</p></article><footer><article>foot article</article></footer>", "story"),
        ("<nav><main><p>menu</main></nav><p>story</p>", "story"),
        ("<article><p>a long enough story<p class='comment'>first!</p><blockquote class='comment'>second!</blockquote><p class='ad'>buy</p></article>", "a long enough story"),
        ("<article><h2 class='header'>part</h2><p>a story<ul><li class='comment-item'>hi</li></ul></article>", "part\na story"),
        ("<form id=frame><header>top</header><article><h1>t</h1><p>story</p><div class=ad>buy</div></article></form>", "t\nstory"),
        ("<article><p>story</p><form><p>your name</p></form></article><form class=search><p>find</p></form>", "story"),
        ("<p class='comment'>all there is</p>", "all there is"),
        ("<article class='comment'>all there is</article>", "all there is"),
    ],
)
def test_cut_elements_win_over_what_is_inside(page, text):
    assert site_templates.extract(site_templates.understood(site_templates.parse(page)), set()) == text
