import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(C.STAGES):
        docs = stage(spark, docs, DATA)
        if i < len(C.STAGES) - 1:
            assert docs.columns == columns
            docs = C.stored(docs)
    rows = docs.select("round_trip", "n_tokens").collect()
    assert rows and all(r.round_trip for r in rows) and sum(r.n_tokens for r in rows) > 0
