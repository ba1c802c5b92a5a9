"""The pipeline and the registered queries on the smallest tables."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import TABLES, compare
from shiftledger.llm import queries, secrets
from shiftledger.llm.common import BATCH_BYTES, saved, small_batches

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    result = compare(spark, con, SF, name, queries.SQL.get(name))
    assert result.startswith("ok" if name in queries.SQL else "rows only"), result


def test_stages_keep_what_they_should(spark, docs_of):
    from helpers import prose, sentences

    good = [(k, sentences(k, 200), f"s{k % 3}") for k in range(30)]
    near = [(100 + k, good[k][1] + " tail", "s0") for k in range(5)]
    bad = [(200, None, "s1"), (201, "", "s1"), (202, " ".join(f"{w}###" for w in prose(1, 90)), None), (203, "short text", "s1")]
    secret = [(300, sentences(77, 100) + " password=abcdefgh1", None)]
    docs = docs_of(good + near + bad + secret)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {i for i, _ in seen["quality rules"]} == {*range(30), *range(100, 105), 300}
    assert {i for i, _ in seen["near-duplicates"]} == {*range(30), 300}
    assert dict(seen["secrets"])[300].endswith(" [assign]") and len(seen["secrets"]) == 31
    assert 1.3 * 31 < len(seen["source mix"]) < 1.7 * 31
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, SF).filter(F.col("piece") == 0)
    assert pieces.count() == len(seen["source mix"])


def test_stages_without_rows(spark, docs_of):
    docs = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame([], stage(spark, docs, SF).schema)
    assert "sequence_id" in docs.columns


def test_run_masks_every_secret(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    masked = corpus_pipeline.mask_secrets(spark, docs, SF)
    assert masked.count() == docs.count()
    assert masked.filter(F.size(secrets.spans("text", secrets.BASE)) > 0).isEmpty()
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_batches_that_go_to_python_are_bounded_in_bytes(spark):
    setting, sizes = "spark.sql.execution.arrow.maxBytesPerBatch", "n bigint, bytes bigint"
    old = spark.conf.get(setting)
    texts = spark.range(4000, numPartitions=1).select(F.repeat(F.lit("word "), 1000).alias("text"))

    def measured(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    try:
        spark.conf.set(setting, "67108864b")
        got = saved(texts.mapInArrow(measured, sizes), "sizes").collect()
        assert sum(r.n for r in got) == 4000 and max(r.bytes for r in got) < BATCH_BYTES + 100_000
        for was, then in (("1000000", "1000000"), ("900k", "900k"), ("64m", f"{BATCH_BYTES}b"), ("1g", f"{BATCH_BYTES}b")):
            spark.conf.set(setting, was)
            small_batches(spark)
            assert spark.conf.get(setting) == then
    finally:
        spark.conf.set(setting, old)
