import pyarrow as pa
from pyspark.sql import functions as F

from weftline.llm import text
from weftline.llm.text import in_parts


def cut(texts, size):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])
    parts = list(in_parts(batch, 1, size))
    assert [x for p in parts for x in p.to_pylist()] == batch.to_pylist()
    return [p.num_rows for p in parts]


def test_parts_keep_all_rows_and_stay_small():
    assert cut(["aa", "bb", "cc", "dd", "e"], 4) == [2, 2, 1]


def test_parts_of_long_null_and_empty_texts():
    assert cut([None, "x" * 50, "", None, "yy"], 4) == [1, 1, 3]
    assert cut([None, None, ""], 4) == [3]
    assert cut([], 4) == []


def test_hash_bound_finds_the_least_hashes_again(spark):
    df = spark.range(5000).select("id", F.xxhash64("id").alias("h"))
    least = sorted(r.h for r in df.collect())[:100]
    assert sorted(r.h for r in text.least_hashes(df, 100).collect()) == least
    assert sorted(r.h for r in df.where(F.col("h") <= text.hash_bound(df, 100)).collect()) == least
    assert df.where(F.col("h") <= text.hash_bound(df, 10_000)).count() == 5000
