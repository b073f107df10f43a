import random
from collections import defaultdict

import pytest

from copperleaf.llm import components, lines


def roots_of(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {x: top(x) for x in list(up)}


def shingles(x):
    return {x[i : i + 8] for i in range(len(x) - 7)}


def jaccard(x, y):
    x, y = shingles(x), shingles(y)
    return len(x & y) / len(x | y)


def brute(rows):
    """Numbers of the lines that go, for each document."""
    seen = sorted({(k, i, x) for k, t in rows for i, x in lines.worded(t)})
    distinct = sorted({x for _, _, x in seen})
    having = defaultdict(list)
    links = []
    for n, x in enumerate(distinct):
        grams = shingles(x)
        for m in {m for g in grams for m in having[g]}:
            if jaccard(x, distinct[m]) >= lines.LIKE:
                links.append((n, m))
        for g in grams:
            having[g].append(n)
    root, number = roots_of(links), {x: n for n, x in enumerate(distinct)}
    first, out = {}, defaultdict(list)
    for k, i, x in seen:
        c = root.get(number[x], number[x])
        if first.setdefault(c, (k, i)) != (k, i):
            out[k].append(i)
    return out


@pytest.mark.parametrize("least_hub", [1000, 20])
def test_components(spark, monkeypatch, least_hub):
    monkeypatch.setattr(components, "LEAST_HUB", least_hub)
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: v for k, v in roots_of(edges).items() if any(k in e and e[0] != e[1] for e in edges)}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_agree_with_similarity():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    hit = n = 0
    for _ in range(200):
        a = [word() for _ in range(60)]
        b = [*a[:30], word(), *a[31:]]
        x, y = " ".join(a), " ".join(b)
        if jaccard(x, y) >= lines.LIKE:
            n += 1
            k = lines.signatures([x, y, "unrelated text, longer than eight characters"])
            hit += bool((k[:, 0] == k[:, 1]).any())
            assert not (k[:, 0] == k[:, 2]).any()
    assert n > 150 and hit / n > 0.98


def test_shingles_are_numbered_exactly():
    rng = random.Random(11)
    for alphabet in ("abc ", "".join(map(chr, range(32, 1200))), "".join(map(chr, range(0x4E00, 0x9E00))) + "\U0001f600"):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(8, 90))) for _ in range(60)]
        texts += [t[: rng.randrange(8, len(t) + 1)] for t in texts]
        number, begin = lines.shingled(texts)
        sets = [set(number[a:z].tolist()) for a, z in zip(begin, begin[1:])]
        for x, s in zip(texts, sets):
            assert len(s) == len(shingles(x))
            assert all(len(s & t) == len(shingles(x) & shingles(y)) for y, t in zip(texts, sets))


def test_lines_of_equal_first_hash_stay_apart(spark):
    own = spark.createDataFrame([(1, 0, 0, 7, 1), (1, 0, 1, 7, 2), (2, 0, 0, 7, 2), (2, 0, 1, 8, 5), (3, 0, 0, 8, 6), (3, 0, 1, None, None)], "doc_id long, h long, n long, line long, check long")
    roots = spark.createDataFrame([(7, 1, 7), (8, 5, 7)], "line long, check long, root long")
    groups = defaultdict(set)
    for r in lines.classed(own, roots).collect():
        groups[r["class"], r.side].add((r.doc_id, r.n))
    assert sorted(map(sorted, groups.values())) == [[(1, 0), (2, 1)], [(1, 1), (2, 0)], [(3, 0)]]


def test_rows_of_equal_doc_id(spark, tmp_path):
    rows = [(1, "first text\nshared line"), (1, "other text\nshared line"), (1, "other text\nshared line"), (None, "shared line")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = sorted(map(tuple, lines.op10_line_dedup(spark, str(tmp_path)).collect()), key=repr)
    assert len(out) == 4 and (None, 1, 0, "") in out
    assert sorted(r[3] for r in out if r[0]) == ["", "1", "1"] or sorted(r[3] for r in out if r[0]) == ["", "", "1"]


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows)
    out = lines.op10_line_dedup(spark, sf).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        assert r.n_lines == len(lines.worded(texts[r.doc_id]))
        assert r.dropped == ",".join(map(str, sorted(want[r.doc_id])))
        assert r.n_dropped == len(want[r.doc_id])


def test_lines_of_one_template(spark, monkeypatch):
    """Pairs of lines that are alike, while all lines share most of their text and so their buckets."""
    rng = random.Random(10)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    base, rows = "x" + word(198) + "x", []
    for k in range(150):
        own = base + word(40)
        rows += [(2 * k, own + word(3) + "x"), (2 * k + 1, own + word(3) + "y")]
    want = brute(rows)
    assert len(want) >= 150
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for large, block in ((64, 50), (10**6, 256)):
        monkeypatch.setattr(lines, "LARGE", large)
        monkeypatch.setattr(lines, "BLOCK", block)
        assert {r.doc_id: r.lines for r in lines.dropped(docs).collect()} == want


def test_dedup(spark):
    long = "a line that is long enough to be compared with others by its shingles, and so on for a while, up to here"
    rows = [
        (1, f"{long}\n\nsecond line\n  ", 0, "x"),
        (2, f"intro of two\n{long}!\nsecond line", 0, None),
        (3, None, 0, "x"),
        (4, "", 0, "x"),
        (5, "second line\nsecond line", 0, "x"),
        (6, "é own line\nsecond line", 0, "x"),
        (6, "é own line\nsecond line", 0, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, line string")
    out = sorted(tuple(r) for r in lines.dedup(docs).collect() if r.doc_id not in (3, 4))
    assert out == [(1, rows[0][1], 0, "x"), (2, "intro of two", 12, None), (6, "é own line", 10, "x"), (6, "é own line", 10, "x")]
    assert {r.doc_id: r.text for r in lines.dedup(docs).where("doc_id in (3, 4)").collect()} == {3: None, 4: ""}
    assert lines.dedup(docs.limit(0)).count() == 0
    nameless = docs.selectExpr("cast(null as bigint) as doc_id", "text", "n_chars", "line")
    assert lines.dedup(nameless).count() == len(rows)
