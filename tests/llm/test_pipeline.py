from collections import Counter, defaultdict
from itertools import count

from pyspark.sql import Row

import corpus_pipeline
from copperleaf.llm import quality

from .test_jaccard import brute as near
from .test_lines import brute as line_brute
from .test_packing import whole
from .test_secrets import brute as secret_brute


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    now = {r.doc_id: r for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, spark.createDataFrame(list(now.values()), docs.schema), sf)
        assert docs.columns == columns
        out = docs.collect()
        after = {r.doc_id: r for r in out}
        assert len(after) == len(out)
        if name == "quality_rules":
            want = {k for k, r in now.items() if quality.measure(r.text, defaultdict(count().__next__), quality.COVERAGE, quality.LINE_COVERAGE)[6]}
            assert set(after) == want
        if name == "line_dedup":
            gone = line_brute([(k, r.text) for k, r in now.items()])
            left = {k: "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone.get(k, ())) for k, r in now.items()}
            assert {k: r.text for k, r in after.items()} == {k: t for k, t in left.items() if t.strip() or k not in gone}
        if name == "ngram_jaccard":
            assert set(after) == {k for k, (_, c) in near([(k, r.text) for k, r in now.items()]).items() if c == k}
        if name == "secret_scans":
            assert set(after) == set(now)
            # this table has no secrets, so some are planted in the same documents
            secret = {k: f"{r.text}\npassword: hunter2{k:08d} end" for k, r in now.items() if k % 3 == 0}
            planted = spark.createDataFrame([Row(**r.asDict() | {"text": secret.get(k, r.text)}) for k, r in now.items()], docs.schema)
            masked = {r.doc_id: r for r in stage(spark, planted, sf).collect()}
            assert set(masked) == set(now) and secret and all(secret_brute(t) for t in secret.values())
            assert not any(secret_brute(r.text) for r in masked.values())
            for k, r in masked.items():
                assert r.text == (after[k].text + "\n[SECRET] end" if k in secret else after[k].text)
                assert k not in secret or r.n_chars == len(r.text)
        kept.append(len(out))
        now = after
    assert kept[0] > kept[2] > 50
    rows = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(list(now.values()), docs.schema), sf).collect()
    assert whole(rows, {k: r.text for k, r in now.items()}) < 0.08
    again = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.ids_crc32 for r in again) == Counter(r.ids_crc32 for r in rows)
