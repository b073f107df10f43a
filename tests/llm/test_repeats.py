import random

import pytest

from copperleaf.llm import common, repeats


def brute(rows):
    """Words of each document that lie in a run of 50 that another document has."""
    words = {k: (t or "").encode().split() for k, t in rows}
    having = {}
    for k, w in words.items():
        for i in range(len(w) - repeats.LEAST + 1):
            having.setdefault(tuple(w[i : i + repeats.LEAST]), set()).add(k)
    return {k: {i + j for i in range(len(w) - repeats.LEAST + 1) if len(having[tuple(w[i : i + repeats.LEAST])]) > 1 for j in range(repeats.LEAST)} for k, w in words.items()}


def words_in(rows, ids):
    out = {k: set() for k in ids}
    for r in rows:
        out[r.doc_id] |= set(range(r.start, r.end))
        assert r.end - r.start >= repeats.LEAST and r.partner != r.doc_id
    return out


@pytest.mark.parametrize("hot, bits", [(1 << 14, 1 << 27), (3, 1 << 27), (1 << 14, 0)])
def test_planted_passages(spark, monkeypatch, hot, bits):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(common, "MOST_BITS", bits)
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passages = [text(n) for n in (50, 51, 60, 90, 200, 700)]
    rows = [(0, None), (1, ""), (2, text(49)), (3, text(400))]
    for k in range(4, 60):
        rows.append((k, " ".join(x for p in rng.sample(passages, rng.randrange(0, 3)) for x in (text(rng.randrange(0, 80)), p, text(rng.randrange(0, 80))))))
    rows += [(60, rows[10][1]), (61, "same word " * 300), (62, text(70) + " " + "same word " * 40), (63, " ".join([passages[3]] * 3))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    found = repeats.spans(docs).collect()
    got, want = words_in(found, dict(rows)), brute(rows)
    for k, w in want.items():
        assert w == got[k], k
    left = {r.doc_id: r.text for r in repeats.without_repeats(docs).collect()}
    assert left[3] == rows[3][1] and len(left[60].split()) < len(rows[10][1].split())
    assert repeats.spans(docs.limit(0)).count() == 0
    assert repeats.spans(docs.selectExpr("cast(null as bigint) as doc_id", "text")).count() == 0


@pytest.mark.parametrize("hot", [1 << 14, 2])
def test_passages_that_need_words_to_their_left(spark, monkeypatch, hot):
    """Others that share most of a passage stand between the two documents that share the whole of it."""
    monkeypatch.setattr(repeats, "HOT", hot)
    rng, rows = random.Random(4), []
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    for n in (50, 52, 56, 60) * 5:
        p = text(n)
        rows += [(len(rows) + i, f"{text(30)} {p} {text(30)}") for i in range(2)]
        rows += [(len(rows) + i, f"{text(30)} {' '.join(p.split()[-49:])} {text(30)}") for i in range(20)]
    got = words_in(repeats.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect(), dict(rows))
    assert got == brute(rows)


def test_a_copy_of_each_passage_is_left(spark):
    """Document 2 shares overlapping passages with a smaller and with a larger document."""
    words = [f"w{i}" for i in range(120)]
    rows = [(1, words[:60]), (2, words), (3, words[50:])]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    left = {r.doc_id: (r.text or "").split() for r in repeats.without_repeats(docs).collect()}
    assert left == {1: words[:60], 2: words[60:], 3: []}


@pytest.mark.parametrize("hot", [1 << 14, 1])
def test_rows_of_one_doc_id_are_told_apart(spark, monkeypatch, hot):
    """Only the row that holds the passage loses it, not another text of its doc_id."""
    monkeypatch.setattr(repeats, "HOT", hot)
    passage, other = " ".join(f"p{i}" for i in range(60)), " ".join(f"o{i}" for i in range(100))
    rows = [(1, passage), (7, f"begin {passage} end"), (7, other), (7, None), (7, f"begin {passage} end"), (7, f"{other} again {passage}")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, text_hash string")
    left = sorted((r.doc_id, r.text or "") for r in repeats.without_repeats(docs).collect())
    assert left == sorted([(1, passage), (7, "begin end"), (7, other), (7, ""), (7, "begin end"), (7, f"{other} again")])
    spans = {(r.doc_id, r.start, r.end, r.partner, r.text_hash) for r in repeats.spans(docs).collect()}
    hashes = [common.text_hash(t) for _, t in rows]
    assert spans == {(1, 0, 60, 7, hashes[0]), (7, 1, 61, 1, hashes[1]), (7, 101, 161, 1, hashes[5])}


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {k: set() for k, _ in rows}
    for r in repeats.op8_suffix_array(spark, sf).collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    want = brute(rows)
    assert sum(map(len, want.values())) > 1000
    assert got == want
