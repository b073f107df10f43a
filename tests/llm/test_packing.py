import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

from copperleaf.llm import packing, tokens


def whole(rows, texts):
    tk = Tokenizer.from_file(tokens.VOCABULARY)
    ids = {k: np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for k, t in texts.items()}
    cut, held = defaultdict(list), defaultdict(list)
    for r in rows:
        x = ids[r.doc_id]
        assert r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes())
        cut[r.doc_id].append((r.start, r.length))
        held[r.sequence_id].append((r.offset, r.length))
    for k, x in ids.items():
        assert sum(n for _, n in cut[k]) == len(x)
        assert [s for s, _ in sorted(cut[k])] == [sum(n for _, n in sorted(cut[k])[:i]) for i in range(len(cut[k]))]
    for x in held.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= packing.WINDOW
    total = [sum(n for _, n in x) for x in held.values()]
    return 1 - sum(total) / sum(t if t & (t - 1) == 0 else packing.WINDOW for t in total)


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert whole(packing.op5_packing(spark, sf).collect(), texts) < 0.05


def test_buckets(spark, sf, monkeypatch):
    """Many buckets, each with a share of the plan."""
    monkeypatch.setattr(packing, "BUCKET", 60)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    assert whole(packing.pack(df).collect(), texts) < 0.15
    same = spark.createDataFrame([(None, "a b c")] * 500, "doc_id long, text string")
    rows = packing.pack(same).collect()
    used = defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    assert len(rows) == 500 and max(used.values()) <= packing.WINDOW and len(used) < 30


def test_edges(spark):
    texts = {1: None, 2: "", 3: "a<|endoftext|>b", 4: "word " * 5000, 5: "中文 \U0001f600 it's", 6: "x\x85\xa0 y"}
    docs = spark.createDataFrame([(k, t, 7) for k, t in texts.items()], "doc_id long, text string, start long")
    whole(packing.pack(docs).collect(), texts)
    assert packing.pack(docs.limit(0)).count() == 0
    assert packing.pack(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")).count() == 2


def test_sequences_hold_their_tokens(spark):
    texts = {1: None, 2: "", 3: "word " * 5000, 4: "中文 it's", **{k: f"text {k} " * k for k in range(5, 60)}}
    rows = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    tk, held, used = Tokenizer.from_file(tokens.VOCABULARY), {}, defaultdict(int)
    for r in rows:
        assert (r.sequence is None) == (r.offset > 0)
        if r.offset == 0:
            held[r.sequence_id] = np.frombuffer(r.sequence, "<u4")
    for r in rows:
        ids = [*tk.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, packing.END]
        assert held[r.sequence_id][r.offset : r.offset + r.length].tolist() == ids[r.start : r.start + r.length]
        used[r.sequence_id] += r.length
    assert all((x[used[k] :] == packing.END).all() for k, x in held.items())
    assert all(len(x) == (used[k] if used[k] & (used[k] - 1) == 0 else packing.WINDOW) for k, x in held.items())


def test_sequences_of_a_power_of_two_are_not_padded(spark):
    for n in (1, 512, 513, 1024):
        docs = spark.createDataFrame([(1, " a" * (n - 1))], "doc_id long, text string")
        [r] = packing.pack(docs).collect()
        assert (r.length, len(r.sequence)) == (n, 4 * (1024 if n == 513 else n))


def test_characters_of_latin_texts_are_of_one_kind_in_both_files():
    """The pattern looks at kinds of characters (letters, numbers, white space, the apostrophe with its letters) and at
    whether neighbours are of one kind. All 256 characters and all pairs of them, between letters, are split alike, so texts
    of them are."""
    before, find = Tokenizer.from_file(tokens.VOCABULARY).pre_tokenizer, regex.compile(public_tokenizers.PATTERN).findall
    for a in map(chr, range(256)):
        for b in map(chr, range(256)):
            text = f"x{a}{b}s "
            assert [text[i:j] for _, (i, j) in before.pre_tokenize_str(text)] == find(text)


def test_rank_file_splits_latin_like_the_vocabulary():
    rng, tk = random.Random(3), Tokenizer.from_file(tokens.VOCABULARY)
    for _ in range(300):
        text = "".join(chr(rng.randrange(256)) if rng.random() < 0.3 else rng.choice("ab 's1\n\t.") for _ in range(60))
        assert tokens.vocabulary_ids(text).tolist() == tk.encode(text, add_special_tokens=False).ids


def test_least_squares_and_plan():
    rng = np.random.default_rng(1)
    a, x = rng.random((12, 30)), np.maximum(rng.normal(size=30), 0)
    assert np.abs(a @ packing.least_squares(a, a @ x) - a @ x).max() < 1e-6
    h = rng.integers(0, 400, packing.UNITS + 1)
    h[0] = 0
    steps, used = packing.plan(h), np.zeros_like(h)
    for c, n in steps:
        assert sum(c) <= packing.UNITS
        for u in c:
            used[u] += n
    assert (used == h).all()
    assert h @ np.arange(len(h)) / (packing.UNITS * sum(n for _, n in steps)) > 0.97
