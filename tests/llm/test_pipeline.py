import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from tests.llm.test_quality import brute as brute_quality
from tests.llm.test_secrets_toxicity import ASSIGN
from tests.llm.test_simhash_records_mixing import brute_components, brute_fingerprint
from weftline.llm import mixing, secrets

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if i < 4:
            assert docs.columns == out[0].columns
            docs = corpus_pipeline.written(spark, docs, "test")
        out.append(docs)
    return [d.collect() for d in out]


def test_near_duplicates_leave_one_of_each_component(stages):
    before, after = stages[1], stages[2]
    component = brute_components([r.doc_id for r in before], [brute_fingerprint(r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(set(component))
    assert Counter(after) == Counter(r for r, c in zip(before, component) if r.doc_id == c)


def test_quality_stage_keeps_what_the_rules_keep(stages):
    from weftline.llm import quality

    kept = {r.doc_id for r in stages[1]}
    for r in stages[0]:
        n, _, _, _, rep, _ = brute_quality(r.text)
        if n < 10 or 100 * rep > 20 * n:
            assert r.doc_id not in kept
    assert 0.6 * len(stages[0]) < len(kept) < len(stages[0]) and quality.BASE


def test_secrets_are_gone_and_clean_documents_untouched(stages):
    before, after = {r.doc_id: r for r in stages[2]}, {r.doc_id: r for r in stages[3]}
    assert before.keys() == after.keys()
    for i, r in after.items():
        spans = secrets.spans_of([before[i].text], None)[0]
        assert not [m for m in ASSIGN.finditer(r.text) if len(m[2]) >= 8]
        assert r.n_chars == len(r.text)
        if not spans and "[SECRET]" not in r.text:
            assert r == before[i]


def test_mix_follows_its_targets(stages):
    before, after = stages[3], stages[4]
    size = lambda r: len((r.text or "").encode().split())
    have, got = defaultdict(int), defaultdict(int)
    for r in before:
        have[r.source] += size(r)
    for r in after:
        got[r.source] += size(r)
    names = sorted(have, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([have[s] for s in names], [1 + i % 3 for i in range(len(names))], sum(have.values()))
    assert all(abs(got[s] - g) <= 2 for s, g in zip(names, goal))
    assert max(Counter(r.doc_id for r in after).values()) <= 3 and set(after) <= set(before)


def test_token_ids_equal_the_library(stages):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((r.doc_id, tuple(model.encode(r.text or ""))) for r in stages[4])
    assert Counter((r.doc_id, tuple(r.ids)) for r in stages[5]) == want
    assert all(r.n_tokens == len(r.ids) and r.restored for r in stages[5])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXT = "an bee can do each for good he is just kind"
OTHER = "zoo yes xi we van up to so run quit put"


def test_near_duplicates_with_null_and_repeated_ids(spark):
    for rows, kept in (
        ([(None, TEXT), (1, TEXT), (None, OTHER)], [(1, TEXT), (None, OTHER)]),
        ([(None, TEXT), (None, TEXT.upper())], 1),
        ([(1, TEXT), (5, TEXT), (5, OTHER)], [(1, TEXT), (5, OTHER)]),
        ([(0, OTHER), (None, TEXT), (0, TEXT), (0, TEXT)], [(0, OTHER), (0, TEXT)]),
        ([(None, None), (None, ""), (None, None)], 1),
    ):
        docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA)
        got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
        assert len(got) == kept and set(got) <= set(rows) if isinstance(kept, int) else Counter(got) == Counter(kept), rows


def test_stages_with_clashing_columns_nulls_repeats_and_long_texts(spark):
    rng = random.Random(4)
    long = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(40_000))
    clash = ["id", "copies", "rows", "key", "_key", "_n", "d", "b", "fp", "root", "component_id", "size", "h", "no_id", "by_source", "col", "k", "grp", "n_words", "spans", "label"]
    texts = [(1, TEXT), (1, TEXT), (None, OTHER), (2, None), (3, ""), (4, long), (5, "password = abcdefgh123 " + OTHER[4:] + " m n"), (5, "password = abcdefgh123 " + OTHER[4:] + " m n")]
    rows = [(i, t, "en", None if i == 4 else "s", len(t or ""), *(f"{c}{n}" for c in clash)) for n, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", {c} string" for c in clash))
    out = {name: stage(spark, docs, SF).collect() for name, stage in corpus_pipeline.STAGES}
    own = docs.collect()
    kept = out["quality rules"]
    assert all(list(r.asDict()) == docs.columns for name in list(out)[:4] for r in out[name])
    assert set(kept) <= set(own) and {r.doc_id for r in kept} == {1, None, 4, 5} and len(kept) == 6
    near = out["near-duplicates"]
    assert set(near) <= set(own) and sorted((r.doc_id is None, r.doc_id or 0) for r in near) == [(False, 1), (False, 2), (False, 4), (False, 5), (True, 0)]
    scanned = out["secret scan"]
    assert len(scanned) == 8 and [r.text for r in scanned if r.doc_id == 5] == ["[SECRET] " + OTHER[4:] + " m n"] * 2
    assert all(r.n_chars == len(r.text or "") for r in scanned) and [r.text for r in scanned if r.doc_id == 4] == [long]
    mixed = out["source mix"]
    assert set(mixed) <= set(own) and {r.doc_id for r in mixed} <= {1, None, 4, 5}
    got = Counter((r.doc_id, r.text, r.source) for r in mixed)
    want = {(r.id, r.source): 0 for r in mixing.mix(docs).collect()}
    for r in mixing.mix(docs).collect():
        want[r.id, r.source] += r.copies
    assert {(i, s): n for (i, _, s), n in got.items()} == {k: n for k, n in want.items() if n}
    assert len(out["token ids"]) == 8 and all(r.restored for r in out["token ids"])


def test_stages_take_nulls_repeats_and_empty_tables(spark):
    rows = [(1, TEXT, "en", "s", 21), (1, TEXT, "en", "s", 21), (None, OTHER, None, None, None), (2, None, None, None, None), (3, "", "en", "s", 0)]
    for some, left in ((rows, 3), ([], 0)):
        docs = spark.createDataFrame(some, SCHEMA)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, spark.createDataFrame(some, SCHEMA), SF).count() <= 2 * len(some)
            docs = stage(spark, docs, SF)
        assert docs.count() <= left
