import public_tokenizers
import tiktoken

import corpus_pipeline
from tidemark.llm import bpe, mixing, quality, simhash


def test_stages_match_the_operators(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    frame = spark.createDataFrame(docs, spark.read.parquet(f"{d}/documents.parquet").schema)
    model = quality.train(frame, spark.read.parquet(f"{d}/labels.parquet"))
    import numpy as np

    left = [r for r in docs if model.scores(np.stack([quality.features(r.text)]))[0] >= quality.THRESHOLD]
    seen = {}
    for r in sorted(left, key=lambda r: r.doc_id):
        fp = simhash.fingerprint(r.text, 5)
        near = [f for f in seen if bin(f ^ fp).count("1") <= 4]
        for f in near:
            seen[fp] = seen[f]
        seen.setdefault(fp, r.doc_id)
    left = [r for r in left if seen[simhash.fingerprint(r.text, 5)] == r.doc_id]
    kept = mixing.sample(spark.createDataFrame(left, frame.schema)).collect()
    with open(bpe.public_vocabulary()[0], "rb") as f:
        theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(f.read()), special_tokens={})
    want = {r.doc_id: theirs.encode_ordinary(r.text or "") for r in kept}
    got = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id: list(r.ids) for r in got} == want and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    assert 0 < len(want) < len(docs)


def test_all_but_the_last_keep_the_columns(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns
