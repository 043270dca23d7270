"""Stages keep clean documents, take effect and hand on the columns of documents; SQL and Spark agree where SQL exists."""

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from priceloom.llm import queries
from priceloom.llm.string_tiling import normalized

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, DATA)
        if name != "source_mix":
            assert after.columns == columns
        left = {r["doc_id"] for r in after.collect()}
        assert left and left <= ids
        if name == "decontamination":
            plain = lambda x: f" {' '.join(normalized(x.encode()).decode().split())} "
            items = [plain(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert ids - left == {r["doc_id"] for r in docs.collect() if any(i in plain(r["text"]) for i in items)}
            planted = docs.limit(1).select("doc_id", "lang", "source", "n_chars").crossJoin(spark.read.parquet(f"{DATA}/benchmark.parquet").limit(1).select("text")).select(columns)
            assert stage(spark, planted, DATA).count() == 0
        if name == "near_duplicates":
            assert stage(spark, after, DATA).count() == len(left)
        docs, ids = after, left
    assert "copies" in docs.columns and "text" in docs.columns


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want, got = con.execute(queries.ORACLES[name]).df(), queries.QUERIES[name](spark, DATA).toPandas()
    order = lambda df: df[sorted(df.columns)].sort_values("vec_id" if "vec_id" in df else "doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)
