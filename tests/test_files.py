"""Readers of many files and writers of parts of a table."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from priceloom.sources import files

HEAD = "week_start,banner,page_number,offer_index_on_page,raw_offer_text,raw_product_text,verified_raw_product_text,advertised_price,original_advertised_price,verified_advertised_price,layout_type,review_reasons\n"


def card(week, text, price, banner="Vons", page=1, index=1):
    return f"{week},{banner},{page},{index},{text},,,{price},,,,\n"


def write(path, *lines, at=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(HEAD + "".join(lines))
    if at:
        os.utime(path, (at, at))


@pytest.mark.parametrize("packed", ["1", "134217728"])
def test_first_cards_stay_whatever_the_file_sizes(spark, tmp_path, packed):
    long = "y" * 130
    write(tmp_path / "a/raw_offer_cards.csv", card("2026-07-08", "x", 1), card("2026-07-08", "x", 2), card("", "x", 9), card("2026-07-08", "x", 3, banner="Other"))
    write(tmp_path / "b/raw_offer_cards.csv", card("2026-07-08", "x", 4), card("2026-07-15", "x", 5), card("2026-07-08", long + "1", 6), card("2026-07-08", long + "2", 7, banner=" VONS "))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", packed)
    rows = files.read_raw_cards(spark, str(tmp_path / "*/raw_offer_cards.csv"), "vons")
    assert sorted(r["advertised_price"] for r in rows.collect()) == ["1", "5", "6"]
    spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_the_newest_file_of_a_week(spark, tmp_path):
    write(tmp_path / "vons 7-15/raw_offer_cards.csv", card("2026-07-15", "old", 1), at=1_000_000)
    write(tmp_path / "vons 7-15 again/raw_offer_cards.csv", card("2026-07-15", "new", 2), at=2_000_000)
    write(tmp_path / "vons july/raw_offer_cards.csv", card("2026-07-22", "named otherwise", 3), at=3_000_000)
    paths = str(tmp_path / "*/raw_offer_cards.csv")
    text = lambda *week: [r["raw_offer_text"] for r in files.newest_cards(spark, paths, dt.date(*week)).collect()]
    assert text(2026, 7, 15) == ["new"] and text(2026, 7, 22) == ["named otherwise"] and text(2026, 8, 5) == []


def test_offer_history_of_several_files(spark, tmp_path):
    head = ",".join(files.OFFER_STRINGS) + "\n"
    row = lambda **x: ",".join(str(x.get(c, "")) for c in files.OFFER_STRINGS) + "\n"
    (tmp_path / "1.csv").write_text(head + row(split_item_id="a", banner="vons", advertised_price=1) + row(split_product_text="x", banner="vons", advertised_price=2) + row(split_product_text="beer", banner="vons"))
    (tmp_path / "2.csv").write_text(head + row(split_item_id="a", banner="vons", advertised_price=3) + row(split_product_text="x", banner="vons", advertised_price=2) + row(split_item_id="b", banner="other"))
    rows = files.read_offer_history(spark, [str(tmp_path / "1.csv"), str(tmp_path / "2.csv")], "Vons", F.col("split_product_text") == "beer")
    assert sorted((r["split_item_id"] or "", r["advertised_price"]) for r in rows.collect()) == [("", "2"), ("a", "1")]


def test_faulty_cases_fail_the_load(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    load = lambda: files.read_cases(spark, str(path), "id string, text string, want string", "id", ["text"], {"want": ["accept", "reject"]})
    path.write_text('# comment\n\n{"id": "a", "text": "x", "want": "accept"}\n{"id": "b", "text": "y", "want": "reject"}\n')
    assert [tuple(r) for r in load().orderBy("id").collect()] == [("a", "x", "accept"), ("b", "y", "reject")]
    for line, fault in (('{"id": "a", "text": "z", "want": "accept"}', "a: repeated id"), ('{"id": "c", "text": " ", "want": "accept"}', "c: missing text"), ('{"id": "c", "text": "z", "want": "maybe"}', "c: bad want"), ("{oops", "no JSON"), ('{"text": "z", "want": "accept"}', "missing id")):
        path.write_text('{"id": "a", "text": "x", "want": "accept"}\n' + line + "\n")
        with pytest.raises(ValueError, match=fault):
            load()


def test_only_touched_partitions_are_replaced(spark, tmp_path):
    path, schema = str(tmp_path / "table"), "id int, price double, region string"
    rows = lambda *x: spark.createDataFrame(x, schema)
    table = lambda: sorted((r["region"] or "", r["id"] or 0, r["price"]) for r in spark.read.schema(schema).parquet(path).collect())
    files.upsert_partitions(spark, path, rows((1, 1.0, "a"), (2, 2.0, "a"), (1, 3.0, "b"), (None, 4.0, "b")), ["id", "region"], ["region"])
    modified = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(f"{path}/region=a") for f in fs}
    for _ in range(2):
        files.upsert_partitions(spark, path, rows((None, 5.0, "b"), (7, 7.0, "c")), ["id", "region"], ["region"])
        assert table() == [("a", 1, 1.0), ("a", 2, 2.0), ("b", 0, 5.0), ("b", 1, 3.0), ("c", 7, 7.0)]
    assert modified == {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(f"{path}/region=a") for f in fs}
    files.cache_observations(rows((9, 9.0, "c")), path)
    files.cache_observations(rows((9, 9.0, "c")), path)
    assert table()[-1] == ("c", 9, 9.0) and len(table()) == 5
    assert files.observations(spark, path, "nowhere", None, region="c").count() == 1
