import re

from pyspark.sql import functions as F

from weftline.llm import licenses


def brute(rows):
    """Best exact containment over the same windows, without any retrieval."""
    out = {}
    sets = {}
    for name, t in licenses.TEMPLATES.items():
        w = licenses.plain_words(t)
        sets[name] = list(dict.fromkeys(tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    for doc, text in rows:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        s = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        for name, t in sets.items():
            if not set(s) & set(t):
                continue
            m = len(t)
            step = max(1, m // 8)
            for k in range(0, len(s), step):
                c = len(set(t) & set(s[k : k + m + step - 1])) / m
                if c >= 0.8 and (c, -k) > out.get((doc, name), (0, 0)):
                    out[doc, name] = (c, -k)
    return {(doc, name): (c, -k) for (doc, name), (c, k) in out.items()}


def found(df):
    return {(r.id, r.license): (r.containment, r.place) for r in df.collect()}


def test_op3_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    t = licenses.TEMPLATES
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "é " * 30000 + t["MIT-permission"] + " ü" * 50), (10**6 + 3, t["BSD"].upper().replace(",", "\n//")), (10**6 + 4, "license only")]
    rows += [(10**6 + 5, t["GPL-notice"].replace("Software Foundation", "Beer Foundation")), (10**6 + 6, "the " + t["Apache-2.0-header"] + " " + t["MPL-2.0"]), (None, t["MIT"]), (10**6 + 7, t["MIT"]), (10**6 + 7, t["MIT"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash"))
    got = found(licenses.scan(docs))
    assert got == brute(rows)
    assert len(got) > 20 and (10**6 + 5, "GPL-notice") in got and (None, "MIT") in got
    assert licenses.scan(docs.limit(0)).count() == 0


def test_anchor_words_are_in_every_possible_match():
    words = set(licenses.anchors(licenses.TEMPLATES))
    for t in licenses.TEMPLATES.values():
        w = licenses.plain_words(t)
        shingles = [w[i : i + 5] for i in range(len(w) - 4)]
        assert sum(not words & set(s) for s in shingles) < 0.8 * len(shingles)


def test_main_path_runs_no_python(spark):
    plan = licenses.op3_licenses(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_op3_equals_its_sql_and_long_texts_stay_linear(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    got = licenses.op3_licenses(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(licenses.SQL).fetchall())
    rows = [(None, f"{k} words " + licenses.TEMPLATES["MIT-permission"]) for k in range(3)] + [(7, "x " * 300_000 + "Released under the MIT License " * 2000 + "Licensed under CC BY 4.0 y"), (7, "Licensed under CC BY 4.0")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))).collect()
    assert sorted(r.license for r in got if r.id is None) == ["MIT-permission"] * 3
    assert sorted((r.license, r.place) for r in got if r.id == 7) == [("CC-BY-4.0", 0), ("CC-BY-4.0", 310_000), ("MIT", 300_000)]
