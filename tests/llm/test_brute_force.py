"""Each operator against a plain version on a small sample of the tables, or on generated cases."""

import base64
import hashlib
import html
import json
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from priceloom.llm import bpe_counts, compression_bands, content_chunks, jaccard_join, line_crf, site_templates, source_mix, string_tiling, template_tree
from priceloom.llm import capture_index
from priceloom.llm.common import word_hashes

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_word_hashes_split_like_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\n\t漢 ") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    hashes, _, _, first = word_hashes([t.encode() for t in texts])
    seen = {}
    for t, a, b in zip(texts, first[:-1], first[1:]):
        assert len(WORD.findall(t)) == b - a
        for w, h in zip(WORD.findall(t), hashes[a:b].tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_compression_base_counts():
    rng = random.Random(2)
    for _ in range(60):
        text = " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 120)))
        words = WORD.findall(text)
        grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        inside = {i + k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(8)}
        assert compression_bands.repeated_words(word_hashes([text.encode()])[0]) == len(inside)
    assert compression_bands.duplicate_lines(b"a\n\na\n \nb\na") == 2


def test_token_counts_equal_the_library():
    path = bpe_counts.public_tokenizers.path(bpe_counts.MODEL)
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), bpe_counts.piece_model(path)
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "the", " ", "  ", "\n", "é", "▁", "①", "漢", "<s>", "1", "23", "ing", "\t", "—", "x" * 70]) for _ in range(rng.randint(0, 25)))
        assert model.count(text) == len(library.encode(text)), text


def test_jaccard_components(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 150))] for _ in range(25)]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    docs = []
    for b in base:
        for _ in range(rng.randint(1, 9)):
            d = list(b)
            for _ in range(rng.randint(0, 5)):
                d[rng.randrange(len(d))] = rng.choice(vocabulary)
            docs.append(" ".join(d[: rng.randint(len(d) * 3 // 4, len(d))]))
    docs += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(10, 40))]) for _ in range(60)]
    rng.shuffle(docs)
    sets = []
    for t in docs:
        w = words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), root(i)) for i in range(len(docs))}


def test_prefix_signatures_meet():
    """Any two sets at the threshold share a signature, inner for the smaller one, whatever the token counts."""
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        universe = rng.choice(1 << 40, 3 * n, replace=False).astype(np.uint64)
        counts = rng.choice([2, 5, 17, 900], len(universe))
        m = int(np.ceil(n * rng.uniform(0.75, 1)))
        shared = next((s for s in range(m + 1) if 100 * s >= 75 * (n + m - s)), None)
        if shared is None or shared > m:
            continue
        x = np.arange(n)
        y = np.concatenate((rng.choice(n, shared, replace=False), n + np.arange(m - shared)))
        sides = []
        for s in (x, y):
            order = s[np.lexsort((universe[s], counts[s]))]
            sides.append(jaccard_join.prefix_signatures(len(s), counts[order], universe[order]))
        inner = set(sides[1][0][sides[1][1]].tolist())
        assert inner & set(sides[0][0].tolist()), (n, m, shared)


def test_greedy_tiles():
    item = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    doc = [7, 8, 9, 10, 11, 12, 0, 0, 1, 2, 3, 4, 5, 6]
    tiles = string_tiling.greedy_tiles(item, doc, bytearray(len(doc)))
    assert sorted(tiles) == [(6, 0, 8), (6, 6, 0)]
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 40))] for _ in range(2))
        tiles = string_tiling.greedy_tiles(a, b, bytearray(len(b)), 3)
        used_a = [i + k for n, i, _ in tiles for k in range(n)]
        used_b = [j + k for n, _, j in tiles for k in range(n)]
        assert len(set(used_a)) == len(used_a) and len(set(used_b)) == len(used_b)
        assert all(a[i : i + n] == b[j : j + n] and n >= 3 for n, i, j in tiles)
        longest = max((k for i in range(len(a)) for j in range(len(b)) for k in range(min(len(a) - i, len(b) - j) + 1) if a[i : i + k] == b[j : j + k]), default=0)
        assert max((t[0] for t in tiles), default=0) == (longest if longest >= 3 else 0)


def test_reordered_benchmark_passages_are_caught(spark):
    rng = random.Random(7)
    item = [f"q{i}" for i in range(40)]
    mixed = " ".join([*item[20:], *(f"z{rng.randint(0, 99)}" for _ in range(50)), *item[:20]]).upper()
    docs = spark.createDataFrame([(1, mixed), (2, " ".join(item[:15])), (3, "clean text of its own words")], "doc_id bigint, text string")
    got = string_tiling.contaminated(docs, spark.createDataFrame([(9, " ".join(item))], "item_id bigint, text string")).collect()
    assert [(r["doc_id"], r["n_tiles"], r["coverage"]) for r in got] == [(1, 2, 1.0)]


def test_chunks_resist_insertions(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{rng.randint(0, 9999)}" for _ in range(60))
    fill = lambda n: " ".join(f"f{rng.randint(0, 10**6)}" for _ in range(n))
    texts = [f"{fill(rng.randint(1, 30))} {passage} {fill(rng.randint(1, 30))}" for _ in range(12)] + [fill(80) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = content_chunks.repeated_spans(df)
    assert {r["doc_id"] for r in spans.collect()} == set(range(1, 12))
    left = {r["doc_id"]: r["text"] for r in content_chunks.without_spans(df, spans).collect()}
    assert left[0] == texts[0] and left[20] == texts[20]
    assert all(len(left[i].split()) <= len(texts[i].split()) - 24 for i in range(1, 12))
    for t in texts:
        ends = content_chunks.chunk_ends(t.encode())
        assert ends[-1] == len(t.encode()) and (np.diff(ends, prepend=0) > 0).all()


def test_gear_hash_is_the_rolling_one():
    data = np.frombuffer(random.Random(9).randbytes(500), np.uint8)
    h, rolled = 0, []
    for b in data:
        h = ((h << 1) + int(content_chunks._GEAR[b])) & 0xFFFF
        rolled.append(h)
    assert content_chunks.gear_hashes(data).tolist() == rolled


def test_templates_generalise_fields(spark):
    lines = [f"order {i} shipped to customer {chr(97 + i)}x on day {i}" for i in range(12)]
    docs = [(i, f"own line number {'abcdefghijkl'[i] * 3} of this text\n{line}\nanother {i} thing") for i, line in enumerate(lines)]
    got = {r["doc_id"]: r for r in template_tree.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got[0]["n_dropped"] == 0 and all("shipped" not in got[i]["text"] for i in range(1, 12))


def test_line_crf_marginals():
    rng = np.random.default_rng(10)
    emit, moves = rng.normal(size=7), rng.normal(size=(2, 2))
    first = np.array([0, 3, 3, 7])
    p, _ = line_crf.forward_backward(emit, moves, first)
    for a, b in ((0, 3), (3, 7)):
        weights = {}
        for code in range(2 ** (b - a)):
            y = [(code >> k) & 1 for k in range(b - a)]
            weights[tuple(y)] = np.exp(sum(emit[a + k] * y[k] for k in range(b - a)) + sum(moves[y[k], y[k + 1]] for k in range(b - a - 1)))
        total = sum(weights.values())
        assert np.allclose(p[a:b], [sum(w for y, w in weights.items() if y[k]) / total for k in range(b - a)])


def test_line_crf_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = line_crf.score_quality(docs.select("doc_id", "text"), line_crf.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_main_text_of_the_tables(spark):
    rows = site_templates.main_text(spark.read.parquet(f"{DATA}/pages.parquet")).collect()
    for r in rows:
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = re.split("\n\n", re.sub(r"<(/?b|br)>", " ", re.sub(r"</?(p|h1)>", "\n\n", article)))
        assert r["text"] == "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<header>h</header><main><header><h1>T</h1></header><p>a<br>b <i>c</i>d<div id='comments'><p>c</p></div></main><aside>s</aside>", "T\na b cd"),
        ("<div class='cookie-notice'>n</div><p>x<form>f</form><script>'</p>'</script><table><tr><td>1<td>2</table><div class=sidebar>s</div>", "x\n1\n2"),
        ("<article class='comment'><p>c</p></article><article><p>a &lt; b&nbsp;c</p></article>", "a < b c"),
        ("text <b>bold", "text bold"),
        ("<div id=page class='has-sidebar'><p>Real article text</p></div>", "Real article text"),
        ("<div class='search-results-page'><p>Real</p><div class='sidebar box'>s</div></div>", "Real"),
        ("<main><section id='search'><h2>Search algorithms</h2><p>They look.</p></section></main>", "Search algorithms\nThey look."),
        ("<article><p>One.</p><p class='related-work'>Two.</p></article>", "One.\nTwo."),
        ("<article><div class='entry-header'><h1>Title</h1></div><p>One.</p></article>", "Title\nOne."),
        ("<article><div class='header'><h1>Title</h1></div><p>Short.</p><div id='comments'><p>A much longer word of a reader.</p></div></article>", "Title\nShort."),
        ("<div class='sidebar'><p>all that there is</p></div>", "all that there is"),
        ("<p>a < b <a href='x>y'>c</a> <i x=1 y>d</i></p>", "a < b c d"),
    ],
)
def test_extraction_cases(page, text):
    assert site_templates.extract(site_templates.understood(site_templates.parse(page)), set()) == text


def test_archives_round_trip(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    archives = capture_index.new_path(spark, "archives")
    capture_index.write_archives(pages, archives)
    index = capture_index.build_index(spark, archives, block_lines=7)
    keys = pages.select(capture_index.url_key(pages["url"]).alias("url_key")).distinct()
    read = {r["page_id"]: r for r in capture_index.read_records(capture_index.written(capture_index.lookup(index, keys), "found")).collect()}
    rows = pages.collect()
    assert len(read) == len(rows)
    for r in rows:
        assert bytes(read[r["page_id"]]["payload"]) == r["html"].encode()
        assert read[r["page_id"]]["payload_digest"] == base64.b32encode(hashlib.sha1(r["html"].encode()).digest()).decode()


def test_a_lookup_holds_the_directory_of_one_range_at_a_time(tmp_path, monkeypatch):
    rng = random.Random(6)
    keys = sorted("".join(rng.choice("ab,)/") for _ in range(rng.randint(0, 4))) for _ in range(600))
    blocks = [keys[i : i + 5] for i in range(0, len(keys), 5)]
    parts, reads = [], []
    for part in range(0, len(blocks), 8):
        path = tmp_path / str(part)
        path.write_text("\n".join(json.dumps([b[0], b[-1], str(part + i)]) for i, b in enumerate(blocks[part : part + 8])))
        parts.append((blocks[part][0], blocks[min(part + 7, len(blocks) - 1)][-1], part, str(path)))
    whole = capture_index.opened
    monkeypatch.setattr(capture_index, "opened", lambda path: reads.append(path) or whole(path))
    directory = capture_index.Directory(parts)
    for key in sorted({*keys, "0", "zz", "a)(", ""}):
        assert [int(n) for _, n in directory.blocks(key)] == [i for i, b in enumerate(blocks) if b[0] <= key <= b[-1]]
        assert len(directory.held[1]) <= 8 if directory.held else True
    assert len(reads) <= 2 * len(parts)  # one key may stand in several ranges


def test_records_are_read_in_tasks_of_bounded_bytes(spark, monkeypatch):
    monkeypatch.setattr(capture_index, "READ_BYTES", 4_000)
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", "x" * 1_000) for i in range(64)], "page_id bigint, url string, html string")
    archives = capture_index.new_path(spark, "archives")
    capture_index.write_archives(pages.withColumn("html", F.concat("html", F.col("page_id").cast("string"))), archives)
    index = capture_index.build_index(spark, archives)
    found = capture_index.written(capture_index.lookup(index, pages.select(capture_index.url_key(F.col("url")).alias("url_key"))), "found")
    total = found.agg(F.sum("length")).first()[0]
    records = capture_index.read_records(found)
    assert records.rdd.getNumPartitions() == -(-total // 4_000) and records.count() == 64


def test_mix_reaches_its_targets(spark):
    rng = random.Random(11)
    docs = [(i, " ".join(["w"] * rng.randint(1, 30)), rng.choice("aaaaabc")) for i in range(3000)]
    rows = source_mix.mix_sources(spark.createDataFrame(docs, "doc_id bigint, text string, source string")).collect()
    for s in "abc":
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 30 and own[0]["target"] <= 3 * own[0]["source_size"]
    assert abs(sum({r["source"]: r["target"] for r in rows}.values()) - sum(r["size"] for r in rows)) < 1e-6


def test_mix_weights_change_the_odds(spark):
    docs = [(i, "w w w", s, float(i % 2 * 3 + 1)) for i in range(4000) for s in ["a" if i % 4 else "b"]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, weight double")
    rows = source_mix.mix_sources(df, weights=(1, 9), weight_col="weight").where("source = 'a'").collect()
    light, heavy = (np.mean([r["copies"] for r in rows if r["doc_id"] % 2 == k]) for k in (0, 1))
    assert 2.5 < heavy / light < 6


def test_jaccard_join_of_one_hot_passage_and_chains(spark):
    """A bucket of many unlinked sets, repeated rows, and links that only the last step finds equal the plain join of all pairs."""
    rng = random.Random(41)
    vocabulary = [f"v{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    docs = [" ".join([*passage, *(rng.choice(vocabulary) for _ in range(rng.randint(8, 40)))]) for _ in range(150)]
    chain = [rng.choice(vocabulary) for _ in range(80)]
    for i in range(60):
        chain = list(chain)
        chain[rng.randrange(80)] = rng.choice(vocabulary)
        docs.append(" ".join(chain))
    docs += rng.choices(docs, k=60)
    rng.shuffle(docs)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(words_of, docs)]
    component = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if component[i] != component[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((component[i], component[j]))
                component = [low if c == high else c for c in component]
    for rounds in (0, 3):
        got = jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"), star_rounds=rounds).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(component))


@pytest.mark.parametrize("unit", ["<i>", "<a ", "<p><article><i></p>", '<a x=">" ', "<a x='>' \"", "<!-- ", "<div><div></p>", "<span>", "</b>", "<script>", "<li><i>", "< "])
def test_hostile_pages_take_time_in_proportion(unit):
    def seconds(size):
        page = unit * (size // len(unit))
        began = time.process_time()
        site_templates.extract(site_templates.understood(site_templates.parse(page)), set())
        return time.process_time() - began

    assert seconds(1_000_000) < 8


def test_template_counts_equal_plain_ones(spark):
    """Subtree counts per host against a plain count over all pages, and hinted blocks from 2 pages on."""
    rng = random.Random(42)
    rows = []
    for i in range(120):
        host = f"h{i % 3}.example"
        blocks = "".join(f"<p>{b}</p>" for b in rng.sample("abcdefghij", 4))
        hinted = f"<p class='notice'>{'seen twice' if i in (3, 9) else i}</p>"
        rows.append((i, f"http://{host}/{i}", f"<body>{blocks}{hinted}<p>own {i}</p></body>"))
    got = {r["page_id"]: r["text"].split("\n") for r in site_templates.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    counts = Counter((u.split("/")[2], b) for _, u, h in rows for b in set(re.findall(r"<p>([a-j])</p>", h)))
    for i, u, h in rows:
        host = u.split("/")[2]
        want = [b for b in re.findall(r"<p>([a-j])</p>", h) if counts[host, b] < max(5, 0.3 * 40)]
        assert got[i] == [*want, *([] if i in (3, 9) else [str(i)]), f"own {i}"], i
