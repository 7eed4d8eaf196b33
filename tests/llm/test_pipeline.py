"""The pipeline stage by stage on a small table, and its registration."""

import corpus_pipeline
from lithoframe.llm import registry

DIR = "/root/testdata/sf0.001"


def test_stages_and_queries_are_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "secret_scan", "best_fit_packing"]
    names = list(registry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and len(names) == 10


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, sizes, texts = docs.columns, [docs.count()], None
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if i < 4:
            assert docs.columns == columns
            texts = [r.text or "" for r in docs.collect()]
    assert sizes[0] >= sizes[1] > 0.9 * sizes[0] and sizes[1] > sizes[2] == sizes[3] == sizes[4]
    assert not any("token = \"" in t for t in texts)
    seen, again = set(), 0
    for t in texts:
        w = t.split()
        own = {tuple(w[k : k + 51]) for k in range(len(w) - 50)}
        again += bool(own & seen)
        seen |= own
    assert again == 0
    packed = docs.toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048 and set(packed.groupby("sequence_id").offset.min()) == {0}
    assert packed.doc_id.nunique() == sizes[4]
