"""The pipeline's stages, one after the other, against what each promises."""

from collections import defaultdict

import corpus_pipeline
from wavelath.llm import near_dedup, quality_rules, secrets
from wavelath.llm.common import staged

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    df = spark.read.parquet(f"{DIR}/documents.parquet")
    names, after = df.columns, []
    for name, stage in corpus_pipeline.STAGES:
        after.append(staged(stage(spark, after[-1] if after else df, DIR), "t"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after[-1].columns == names
    rules, near, clean, mixed, packed = after
    kept = {r["doc_id"] for r in quality_rules.report(df).where("kept").collect()}
    assert {r["doc_id"] for r in rules.collect()} == kept
    classes = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(rules).collect()}
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(set(classes.values()))
    assert clean.count() == near.count() and secrets.report(clean).where("spans <> ''").count() == 0
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    times = defaultdict(int)
    for r in mixed.collect():
        assert texts[r["doc_id"]] == r["text"]
        times[r["doc_id"]] += 1
    assert max(times.values()) <= 3
    pieces = defaultdict(int)
    for r in packed.collect():
        pieces[r["doc_id"], r["start"]] += 1
    assert {d: n for (d, s), n in pieces.items() if s == 0} == dict(times)
    assert corpus_pipeline.run(spark, DIR).count() > 0


def test_stages_of_nothing(spark):
    df = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        df = staged(stage(spark, df, DIR), "t")
        assert df.count() == 0
