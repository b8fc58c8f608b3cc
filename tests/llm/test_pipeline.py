"""The corpus pipeline against its stages' brute-force rules on a small corpus."""

import corpus_pipeline
from barspark.llm import decontaminate
from tests.llm.test_models import corpus  # noqa: F401  (fixture)
from tests.llm.test_ngram_join import brute


def test_stages(spark, corpus):  # noqa: F811
    path, rows, toxic, leaks = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = docs
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.cut(stage(spark, kept, path), name)
        sizes.append(kept.count())
        ids = [r.doc_id for r in kept.select("doc_id").collect()]
        if name != "sharding":
            assert kept.columns == columns
        if name == "toxicity":
            assert len(set(ids) & toxic) <= 3 and len(set(range(700)) - toxic - set(ids)) <= 3
            before = kept.collect()
        if name == "ngram_join":
            assert sorted(map(str, ids)) == sorted({c for _, n, c in brute(before, 5, 80) if n} | {str(r.doc_id) for r in before if not (r.text or "").strip()})
            left = set(ids)
        if name == "decontamination":
            assert set(ids) == left - set(leaks)
            words = {r.doc_id: len((r.text or "").split()) for r in kept.collect()}
        if name == "mixing":
            assert set(ids) <= set(words) and max(ids.count(i) for i in set(ids)) <= 2
            assert abs(sum(words[i] for i in ids) - 1.5 * sum(words.values())) <= max(words.values()) * 2
            mixed = sorted(map(str, ids))
    assert sorted(map(str, ids)) == mixed and kept.columns == [*columns, "size", "law", "shard", "slot"]
    assert corpus_pipeline.run(spark, path).count() == sizes[-1]
    assert decontaminate.find_leaks(kept, spark.read.parquet(f"{path}/benchmark.parquet")).where("size(leaks) > 0").count() == 0
