"""A corpus from documents: quality rules, near-duplicates, secrets, a mix of sources, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of documents, whatever further columns they
have and however these are named. Null and empty texts go in the first stage; in a
stage of its own each counts as a text without words. Texts are read whole, however
long. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import mixing, pieces, quality, secrets, simhash
from weftline.sources.shared import drop_between, mark, written


def _keys(doc_id, key, **more) -> list:
    """Key columns without nulls, so that a grouping and a join by them share one shuffle."""
    found = [doc_id.isNull().alias("no_id"), F.coalesce(doc_id.cast("long"), F.lit(0).cast("long")).alias("id"), key.alias("key")]
    return found + [x for n, c in more.items() for x in (c.isNull().alias(f"no_{n}"), F.coalesce(c.cast("string"), F.lit("")).alias(n))]


def _one_of_each(docs: DataFrame, keys: list) -> DataFrame:
    """keys and d: a row of docs, packed in d, for each distinct value of keys.

    Rows that repeat are folded before the shuffle, so many of them never meet in a task.
    """
    packed = docs.select(*keys, F.struct(*(docs[c] for c in docs.columns)).alias("d"))
    return packed.groupBy(*packed.columns[:-1]).agg(F.first("d").alias("d"))


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go; null and empty texts fail, repeated rows are judged alike."""
    return quality.keep(docs)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that of its least id, of several texts under that id the one with the least hash.

    Rows of one id and text become one. Documents without an id stay only where no other of
    their component has one, and then one of them.
    """
    rank = F.struct(*_keys(F.col("id"), F.col("key")))
    keepers = simhash.classes(docs).groupBy("root").agg(F.min(rank).alias("k")).select("k.*")
    return _one_of_each(docs, _keys(docs.doc_id, F.xxhash64(docs.text))).join(keepers, ["no_id", "id", "key"], "left_semi").select("d.*")


def secret_scan(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; n_chars, where there is such a column, follows the text. Null texts stay null."""
    clean = secrets.redact(docs, secrets.train(docs))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def source_mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows alike in id, source and text count together: one stands for all
    of their copies. Texts without words are never taken."""
    mix = mixing.mix(docs)
    names = ["no_id", "id", "key", "no_source", "source"]
    times = mix.where("copies > 0").select(*_keys(F.col("id"), F.col("key"), source=F.col("source")), "copies").groupBy(*names).agg(F.sum("copies").alias("copies"))
    one = _one_of_each(docs, _keys(docs.doc_id, F.xxhash64(docs.text), source=docs.source))
    return one.join(times, names).select("d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("d.*")


def token_ids(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether decoding them gives the text back, of every row; null and empty texts have no ids."""
    ids = pieces.encode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return ids.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", "restored")


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("secret scan", secret_scan), ("source mix", source_mix), ("token ids", token_ids)]


def run(spark, sf_dir: str) -> DataFrame:
    """All stages in a row. Once a stage's result is written, the tables that it was made from are dropped."""
    docs, first = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            last = mark()
            docs = written(spark, docs, f"stage{i}")
            drop_between(spark, first, last)
            first = last
    return docs


ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
