import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from tarnwork.llm import near_dedup, packing, quality_rules, secret_scan
from tarnwork.llm.queries import CAPACITY, oracle_sql, queries, vocabulary
from tests.llm.conftest import SF


def test_every_query_is_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 14)} <= {x.split("_")[0] + "_" for x in names}
    assert "pipeline" in names and set(oracle_sql()) <= names


def test_pipeline_is_its_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = quality_rules.keep_good(docs, quality_rules.learn(docs, labels)).cache()
    first = near_dedup.keep_first(good).cache()
    masked = secret_scan.redact(first)
    assert good.columns == first.columns == masked.columns == docs.columns
    assert 0 < first.count() < good.count() < docs.count()
    expected = packing.packed_digest(masked, vocabulary("word_bpe_49k.json"), 1, CAPACITY)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, SF)
    assert sorted(got.select(*key).collect()) == sorted(expected.select(*key).collect())
    assert [name for name, _ in corpus_pipeline.STAGES][1] == "near-dedup" and len(corpus_pipeline.STAGES) == 4


@pytest.mark.parametrize("name", ["op2_warc", "op8_near_dedup", "op12_source_divergence"])
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    rows = con.sql(oracle_sql()[name])
    got = queries()[name](spark, SF).select(*rows.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows.fetchall()))
