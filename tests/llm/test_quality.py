import re
from collections import Counter, defaultdict
from itertools import count

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from copperleaf.llm import quality

WS = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WS.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def figures(text):
    return quality.measure(text, defaultdict(count().__next__), quality.COVERAGE, quality.LINE_COVERAGE)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\n\t\x0b\x1c\x85#|", max_size=120))
def test_figures_of_any_text(text):
    assert figures(text)[:6] == brute(text)


def test_long_and_odd_texts():
    for text in (None, "", "one", "x " * 5000, " ".join(f"w{i}" for i in range(3000)), "same line\n" * 400):
        assert figures(text)[:6] == brute(text)


def test_coverage_of_a_repeated_passage():
    passage = " ".join(f"p{i:03}" for i in range(40))
    rest = " ".join(f"r{i:03}" for i in range(20))
    shares = figures(f"{passage} {rest} {passage}")[8]
    assert all(abs(s - 0.4) < 1e-9 for s in shares)
    assert not figures(f"{passage} {rest} {passage}")[6]
    assert figures(f"{passage} {rest}")[6]


def test_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = quality.op2_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:7] == brute(texts[r.doc_id])


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want, out = con.sql(quality.SQL), quality.op2_quality_rules(spark, sf)
    assert sorted(out.columns) == sorted(want.columns)
    assert sorted(map(tuple, out.select(*want.columns).collect())) == sorted(want.fetchall())


def test_line_coverage_counts_characters():
    text = "é" * 30 + "\n" + "a" * 60 + "\n" + "é" * 30
    assert abs(figures(text)[7] - 0.25) < 1e-9


def test_keep_good_keeps_columns(spark):
    good = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, good, "a", 2.5), (1, good, None, None), (2, "short", "a", 1.0), (3, None, "a", 1.0)], "doc_id long, text string, kept string, n_words double")
    out = quality.keep_good(docs)
    assert out.schema == docs.schema
    assert sorted(r.doc_id for r in out.collect()) == [1, 1]
    assert quality.keep_good(docs.limit(0)).count() == 0
