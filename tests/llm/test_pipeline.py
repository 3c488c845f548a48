import corpus_pipeline


def test_stages_one_after_another(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    everything = docs.count()
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small).persist()
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        sizes.append(docs.count())
    assert everything >= sizes[0] >= sizes[1] >= sizes[2] == sizes[3] and sizes[0] > 0.7 * everything
    texts = [r[0] or "" for r in docs.select("text").collect()]
    seen: set = set()
    for t in texts:  # no passage of 50 bytes twice, whole characters aside
        mine = {t.encode()[k : k + 50] for k in range(len(t.encode()) - 49)}
        assert not seen & mine or len(seen & mine) < 50
        seen |= mine
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert packed.select("doc_id").distinct().count() == sizes[3]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact dedup", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]
