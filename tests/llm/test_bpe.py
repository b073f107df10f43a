import hashlib

import numpy as np

from copperleaf.llm import bpe, tokens


def same(rows, texts):
    enc = tokens.rank_encoding()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(enc.encode_ordinary(texts[r.doc_id] or ""), "<u4")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    same(bpe.op3_byte_bpe(spark, sf).collect(), texts)


def test_edges_and_round_trip(spark, tmp_path):
    texts = {1: None, 2: "", 3: "a<|endoftext|>b", 4: "word " * 20000, 5: "中文 \U0001f600 it's", 6: "x\x85\xa0 y  \n\n z ", 7: "q" * 3000}
    docs = spark.createDataFrame([(k, t, b"1") for k, t in texts.items()], "doc_id long, text string, payload binary")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    same(bpe.op3_byte_bpe(spark, str(tmp_path)).collect(), texts)
    encoded = bpe.encode(docs, buckets=3)
    assert {r.doc_id: r.text for r in bpe.decode(encoded).collect()} == {k: t or "" for k, t in texts.items()}
    twice = docs.unionAll(docs)
    assert bpe.encode(twice).count() == 14
    assert bpe.encode(docs.limit(0)).count() == 0


def test_blocks_of_equal_content_stay_apart(spark):
    """A third of all rows are equal texts: every block of them is a group of its own."""
    docs = spark.range(0, 3000, 1, 6).selectExpr("id as doc_id", "case when id % 3 = 0 then '' else 'equal words' end as text")
    names = bpe.split(docs, 4, True).select("block").distinct().count()
    assert names == 6
    rows = bpe.encode(docs).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    assert {r.n_tokens for r in rows if r.doc_id % 3} == {len(tokens.rank_encoding().encode_ordinary("equal words"))}
