import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.llm import quality


def brute(text):
    text = text or ""
    w = text.encode().split()
    win = {}
    for i in range(len(w) - 4):
        win.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for at in win.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(lines)


def test_op1_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op1_quality(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cursor = con.execute(quality.SQL)
    assert got.columns == [c[0] for c in cursor.description]
    assert sorted(map(tuple, got.collect())) == sorted(cursor.fetchall())


def test_op1_edges_against_brute_force(spark):
    texts = [None, "", " \n\t", "a b c d e a b c d e", "x " * 20000, "é|ü\x0bq\x0cw\r\nrow\nrow\n \n", "one two three four five six " * 3 + "seven", "  a b 🙂🙂", "A!! B!! " * 9]
    rows = [(i, t, "mine") for i, t in enumerate(texts)] + [(None, "a b c", None), (1, "", "again"), (1, "", "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = [tuple(r) for r in quality.judge(docs).collect()]
    want = [(i, *brute(t)) for i, t, _ in rows]
    key = lambda r: tuple((x is None, x or 0) for x in r[:7])
    assert sorted((r[:7] for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r[7] == (r[1] < 10 or 100 * r[5] > 20 * r[1]) and not (r[7] and r[8])
    assert quality.keep(docs).columns == docs.columns
    assert quality.judge(docs.limit(0)).count() == 0


def test_order_does_not_change_the_verdict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two = (
        docs.select("doc_id", quality.verdict(quality.base(F.col("text")), F.col("text"), order).alias("k")).where("k").count() for order in (list(quality.RULES), list(quality.RULES)[::-1])
    )
    assert one == two == quality.keep(docs).count()


def test_main_path_runs_no_python(spark):
    plan = quality.op1_quality(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
