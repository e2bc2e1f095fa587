"""Quality rules as a short-circuit cascade, with built-in functions only.

Base figures come first. Further rules each reject a document; their cost and
selectivity are measured on a bounded sample, and they run in the order of
rejections per cost, each only where the ones before it passed. The order never
changes the verdict, only its cost.

Null and empty texts have no words and fail the base rule. Texts are read whole;
repeated rows are judged alike; an empty table gives an empty table, and an empty
sample leaves the rules in the order written. No document is shuffled: every figure
is computed within its row, the sample is drawn row by row where the rows are. Windows of words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.text import SPACE, let, words
from weftline.sources.shared import written

WINDOW = 5
#: Rows of the sample, about.
SAMPLE_ROWS = 512
MIN_WORDS = 10
#: The columns that base() adds; a document's own columns of these names are not touched.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _covered(places: Column) -> Column:
    """Words covered by windows that start at these ascending places."""
    steps = F.transform(places, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1), x + WINDOW) - x))
    return F.aggregate(steps, F.lit(0).cast("int"), lambda a, x: a + x)


def _repeat_words(w: Column) -> Column:
    heads = F.slice(w, 1, F.greatest(F.lit(0), F.size(w) - (WINDOW - 1)))
    hashes = F.transform(heads, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, WINDOW))))

    def repeated(h: Column) -> Column:
        def places(s: Column) -> Column:
            same = lambda x, k: x["h"] == F.get(s, k)["h"]
            hit = F.filter(s, lambda x, k: F.coalesce(same(x, k + 1), F.lit(False)) | F.coalesce(same(x, k - 1), F.lit(False)))
            return F.sort_array(F.transform(hit, lambda x: x["i"]))

        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(ordered, lambda s: let(places(s), _covered))

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(h)))


def base(text: Column, least: int = 0) -> Column:
    """A struct of the BASE figures, as longs; texts of fewer words than least are not searched for repeats (0 then)."""
    text = F.coalesce(text, F.lit(""))
    from_words = let(words(text), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("c"), F.when(F.size(w) >= least, _repeat_words(w)).otherwise(F.lit(0)).alias("r")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    from_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    figures = (from_words["n"], from_words["c"], symbols, from_lines["d"], from_words["r"], from_lines["n"])
    return F.struct(*(x.cast("long").alias(n) for n, x in zip(BASE, figures, strict=True)))


def base_failed(b: Column) -> Column:
    return (b["n_words"] < MIN_WORDS) | (100 * b["n_repeat_words"] > 20 * b["n_words"])


#: name: rejects(base figures, text).
RULES: dict[str, Callable[[Column, Column], Column]] = {
    "symbols": lambda b, t: 10 * b["n_symbols"] > b["n_words"],
    "word_length": lambda b, t: (b["word_chars"] < 2 * b["n_words"]) | (b["word_chars"] > 15 * b["n_words"]),
    "repeated_lines": lambda b, t: 2 * b["n_dup_lines"] > b["n_lines"],
    "few_letters": lambda b, t: 2 * F.length(F.regexp_replace(t, "[^\\p{L}]+", "")) < b["word_chars"],
    "upper_case": lambda b, t: 10 * F.length(F.regexp_replace(t, "[^\\p{Lu}]+", "")) > 7 * F.length(F.regexp_replace(t, "[^\\p{L}]+", "")),
}


def ordered_rules(docs: DataFrame, text_col: str = "text") -> list[str]:
    """Names of RULES by rejections per second, measured on about SAMPLE_ROWS rows from all over docs (all of fewer)."""
    share = SAMPLE_ROWS / max(1, docs.count())
    sample = docs.select(F.coalesce(docs[text_col], F.lit("")).alias("text")).where(F.lit(True) if share >= 1 else F.rand(42) < share)
    sample = written(docs.sparkSession, sample.select("text", base(F.col("text")).alias("b")), "sample")

    def timed(rejects: Column) -> tuple[int, float]:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            n = sample.agg(F.count_if(rejects)).first()[0]
            best = min(best, time.perf_counter() - began)
        return n, best

    _, floor = timed(F.col("text").isNull() & F.col("b").isNull())
    rates = {}
    for name, rule in RULES.items():
        rejected, took = timed(rule(F.col("b"), F.col("text")))
        rates[name] = rejected / max(took - floor, 1e-3)
    return sorted(RULES, key=lambda k: -rates[k])


def verdict(b: Column, text: Column, order: list[str]) -> Column:
    """Whether a document stays: nested conditions, so a later rule runs only if all before it passed."""
    text = F.coalesce(text, F.lit(""))
    rest = reduce(lambda inner, name: F.when(RULES[name](b, text), F.lit(False)).otherwise(inner), reversed(order), F.lit(True))
    return F.when(base_failed(b), F.lit(False)).otherwise(rest)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the BASE figures, base_failed, kept) for every row of docs."""
    order = ordered_rules(docs, text_col)
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), base(docs[text_col]).alias("b"))
    b = F.col("b")
    return src.select("id", *(b[n].alias(n) for n in BASE), base_failed(b).alias("base_failed"), verdict(b, F.col("text"), order).alias("kept"))


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns."""
    order = ordered_rules(docs, text_col)
    row = F.struct(*(docs[c] for c in docs.columns))
    packed = docs.select(row.alias("d"), base(docs[text_col], MIN_WORDS).alias("b"))
    return packed.where(verdict(F.col("b"), F.col("d")[text_col], order)).select("d.*")


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


_WORD = "[^\\x20\\x09-\\x0D]"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, COALESCE(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '{_WORD}+') AS ws, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '{_WORD}')] AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4] AS s
      FROM (SELECT rid, ws, UNNEST(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5)),
p AS (SELECT rid, i, COALESCE(LEAD(i) OVER (PARTITION BY rid ORDER BY i) - i, 5) AS step
      FROM (SELECT rid, i, COUNT(*) OVER (PARTITION BY rid, s) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, SUM(LEAST(5, step)) AS n FROM p GROUP BY rid),
f AS (SELECT d.doc_id, d.t, len(w.ws) AS n_words, length(array_to_string(w.ws, '')) AS word_chars,
      length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      len(w.ls) - len(list_distinct(w.ls)) AS n_dup_lines, COALESCE(r.n, 0) AS n_repeat_words, len(w.ls) AS n_lines,
      length(regexp_replace(d.t, '[^\pL]', '', 'g')) AS letters, length(regexp_replace(d.t, '[^\p{{Lu}}]', '', 'g')) AS uppers
      FROM d JOIN w USING (rid) LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_lines AS BIGINT) AS n_lines, base_failed,
NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_dup_lines > n_lines
     OR 2 * letters < word_chars OR 10 * uppers > 7 * letters) AS kept
FROM b
"""
