import random

import numpy as np
import pytest
import sentencepiece

from copperleaf.llm import counts

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=counts.MODEL)


def of(texts):
    return [len(x) for x in LIBRARY.encode([t or "" for t in texts])]


def odd(n=600):
    r = random.Random(5)
    out = ["", None, " ", "   ", "▁▁ ▁", "a" * 27, " " * 1000, "a" * 5001, "\x00\x01", "ab\ncd\r\n", "𝒳𝒴", "<s></s><unk><0x41>", "日本語テキスト梦", "ﷺ", "é"]
    letters = ["ab ", "abcdefghij", "the quick  ", "▁ aе́", "\n\t =-_*#", "0123456789.,", "".join(chr(r.randrange(32, 0x3000)) for _ in range(40))]
    return out + ["".join(r.choice(r.choice(letters) if mixed else own) for _ in range(r.choice([1, 3, 10, 40, 200]))) for _ in range(n) for own in [r.choice(letters)] for mixed in [r.random() < 0.3]]


@pytest.mark.parametrize("size", [counts.SLICE, 7])
def test_odd_texts_against_the_library(size):
    assert counts.token_counts(odd(), size=size).tolist() == of(odd())


def test_long_texts():
    r = random.Random(6)
    texts = ["etaoinshr" * 30000, "".join(r.choice("etaoinshr") for _ in range(100000)), " " * 200001, "x\n" * 50000]
    assert counts.token_counts(texts).tolist() == of(texts)


def test_sequences_of_equal_hash_are_merged_on_their_own(monkeypatch):
    """A hash that is the same for all: every pre-token differs from the one that stands for it."""
    texts = odd(60)
    unique = np.unique
    monkeypatch.setattr(counts.np, "unique", lambda x, **k: unique(np.zeros_like(x), **k))
    assert counts.token_counts(texts).tolist() == of(texts)


def test_query_against_the_library(spark, sf):
    rows = counts.op13_token_counts(spark, sf).orderBy("doc_id", "n_tokens").collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d.doc_id, len((d.text or "").encode()), n, n > 4096) for d, n in zip(docs, of([d.text for d in docs]), strict=True))
    assert [tuple(r) for r in rows] == want


def test_nulls_repeats_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "two words", 5, "x"), (1, "two words", 6, "y"), (2, None, 7, None), (None, "", 8, "z")], "doc_id long, text string, n_tokens int, n_bytes string")
    got = sorted(map(tuple, counts.counted(df, limit=2).collect()), key=repr)
    n = of(["two words"])[0]
    assert got == sorted([(1, 9, n, n > 2), (1, 9, n, n > 2), (2, 0, 0, False), (None, 0, 0, False)], key=repr)
    assert counts.counted(df.limit(0)).count() == 0


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "unigram.model"
    path.write_bytes(bytes([10, 4, 10, 2]) + b"ab" + bytes([18, 2, 24, 1]))
    with pytest.raises(ValueError):
        counts.Vocabulary(str(path))
