import random
import re

import duckdb

from copperleaf.llm import jaccard

from .test_lines import roots_of


def brute(rows):
    sets, by_token = {}, {}
    for k, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        for x in sets[k]:
            by_token.setdefault(x, []).append(k)
    links = set()
    for k, s in sets.items():
        for m in {m for x in s for m in by_token[x] if m < k}:
            both = len(s & sets[m])
            if 100 * both >= 75 * (len(s) + len(sets[m]) - both):
                links.add((m, k))
    root = roots_of(sorted(links))
    return {k: (len(s), root.get(k, k)) for k, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(jaccard.op9_ngram_jaccard(spark, sf)) == brute(rows)


def test_against_sql(sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rows = con.sql("SELECT doc_id, text FROM documents").fetchall()
    assert {k: (n, c) for k, n, c in con.sql(jaccard.SQL).fetchall()} == brute(rows)


def test_sets_of_equal_number_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 0, 7, 1, 3, None), (2, 0, 7, 2, 3, None), (3, 0, 8, 1, 3, None), (4, 0, 7, 2, 3, None)], "doc_id long, h long, node long, check long, n long, tokens binary")
    node = {r.doc_id: r.node for r in jaccard.told_apart(rows).collect()}
    assert node[1] == 7 and node[3] == 8 and node[2] == node[4] != 7
    clear = rows.where("doc_id <> 1")
    assert jaccard.told_apart(clear) is clear


def test_near_copies_of_many(spark, monkeypatch):
    """A low bound makes most tokens of the large groups frequent, so that pairs are indexed."""
    monkeypatch.setattr(jaccard, "FREQUENT", 5)
    monkeypatch.setattr(jaccard, "MANY", 0)  # so that leaders go on before blocks
    monkeypatch.setattr(jaccard, "LARGE", 10)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(8)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "one two three"), (6, "É x"), (7, "é x")]
    for size, n in ((30, 60), (130, 40), (12, 25), (400, 12)):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(n):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, size // 12))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w[rng.randrange(3) :])))
    common = " ".join(f"c{i}" for i in range(30))
    rows += [(len(rows) + i, common + " " + " ".join(f"u{i}_{j}" for j in range(rng.randrange(4, 60)))) for i in range(60)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    assert got(jaccard.classes(docs)) == brute(rows)


def test_texts_with_passages_added_or_cut_off(spark):
    """Groups of two: a token that only one of them indexes may be common all the same."""
    rng, rows = random.Random(12), []
    for k in range(150):
        own = [f"p{k}_{i}" for i in range(rng.randrange(30, 200))]
        n = len(own) - 4
        more = [f"q{k}_{i}" for i in range(int(n / rng.uniform(0.75, 0.85)) - n)]
        at = rng.randrange(len(more) + 1)
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(more[:at] + own + more[at:]))]
    want = brute(rows)
    assert sum(c != k for k, (_, c) in want.items()) > 140
    assert got(jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 1), (1, "a b c d e f g", 1), (2, "x " * 5000, 1)], "doc_id long, text string, n int")
    assert jaccard.classes(docs).count() == 3
    assert jaccard.classes(docs.limit(0)).count() == 0
    assert jaccard.keep_one(docs.selectExpr("cast(null as bigint) as doc_id", "text", "n")).count() == 3
    assert sorted(r.doc_id for r in jaccard.keep_one(docs.unionAll(docs.selectExpr("doc_id + 5", "text", "n"))).collect()) == [1, 1, 2]
