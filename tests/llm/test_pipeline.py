"""The pipeline's stages one after the other, each held against what its operator decides."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from genesieve.llm import near_duplicates
from genesieve.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copy = docs.where("doc_id = 4").withColumn("doc_id", F.lit(70_000).cast("long"))
    empty = docs.where("doc_id = 5").withColumn("doc_id", F.lit(70_001).cast("long")).withColumn("text", F.lit(None).cast("string"))
    nameless = docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))
    docs = docs.unionByName(copy).unionByName(copy).unionByName(empty).unionByName(nameless)
    docs = docs.withColumn("row", F.lit("r")).withColumn("kept", F.lit(True)).withColumn("size", F.col("doc_id"))
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        after[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name == "line_dedup":
            checked = near_duplicates.near_duplicates(docs).where("kept").select("doc_id").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after["quality_rules"]}
    assert all(r.text == before[r.doc_id] for r in after["quality_rules"])
    clean = [i for i, q in labels.items() if q == 1 and len((before.get(i) or "").split()) >= 60]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean) and 70_001 not in kept
    lines = {r.doc_id: r for r in after["line_dedup"]}
    assert set(lines) == kept
    assert all(set(r.text.split("\n")) <= set(before[i].split("\n")) | {""} and r.n_chars == len(r.text) for i, r in lines.items())
    assert lines[70_000].text != before[70_000]
    assert Counter(r.doc_id for r in after["minhash_near_dedup"]) == Counter(r.doc_id for r in checked)
    mixed = Counter(r.doc_id for r in after["source_mixing"])
    assert set(mixed) <= {r.doc_id for r in after["minhash_near_dedup"]} and 2 in mixed.values()
    tokens = Counter()
    for r in after["best_fit_packing"]:
        tokens[r.sequence_id] += r.length
    assert max(tokens.values()) <= 2048 and {r.doc_id for r in after["best_fit_packing"]} == set(mixed)


def test_empty_input_passes_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        assert docs.collect() == []


def long_text(seed, words=120):
    return " ".join(f"{w}" for w in ("the house", "a river", "of stone", "many trees", "and then", "we walked")) + " " + " ".join(
        f"word{seed}x{k}" for k in range(words))


def test_rows_that_share_an_id_lose_no_text(spark):
    a, b = long_text(1), long_text(2)
    rows = [(1, a), (2, a), (2, b), (3, b), (7, None), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, a), (2, b), (7, None), (None, a), (None, a)])
    # one id with two sets, the first of which has an earlier near copy: the other one stays
    near = a.replace("word1x60", "other")
    rows = [(1, near), (2, a), (2, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], docs.schema)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, near), (2, b)])


def test_mix_repeats_each_text_as_taken(spark):
    # five equal rows of an id beside others: the copies that the mix takes of them are shared out
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "a b c d"), (1, "other words of one"), (2, "e f"), (3, None)] + [(10 + k, "x y z " * 5) for k in range(9)]
    docs = spark.createDataFrame([(i, t, "en", "s" if i < 5 else "t", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    from genesieve.llm import mixing

    want = Counter()
    for r in mixing.mix_documents(docs).collect():
        if r["taken"]:
            want[r.doc_id, r["print"]] += r.taken // r.size
    out = corpus_pipeline.mix_sources(spark, docs, SF).withColumn("print", F.xxhash64("text"))
    assert Counter((r.doc_id, r["print"]) for r in out.collect()) == want and sum(want.values()) > len(rows)


def test_columns_of_any_name_pass(spark):
    names = ("__gone", "__doc", "__print", "__copy", "__times", "__id", "row", "id", "print", "gone", "lines", "times", "total", "turn", "kept", "of")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.withColumns({n: F.lit(n) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.columns, written(stage(spark, docs, SF), name)
        assert docs.columns == before
        assert docs.where(" OR ".join(f"`{n}` <> '{n}'" for n in names)).count() == 0 and docs.count()
