import duckdb

from copperleaf.llm import chat


def rows(turns):
    out = {}
    for c, t, role, text in turns:
        out.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in out.items()}


def brute(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    show = lambda x: "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in x)
    return n, show(a[:n]), show(a[n:]), show(b[n:])


def test_prefix_and_masks(spark):
    data = [
        (0, 0, "system", "s"), (0, 1, "user", "q"), (0, 2, "assistant", "yes"),
        (1, 1, "user", "q"), (1, 0, "system", "s"), (1, 2, "assistant", "no"), (1, 3, "user", "é"),
        (2, 0, "user", "same"), (3, 0, "user", "same"),
        (4, 0, None, None), (5, 0, "user", ""),
        (6, None, "user", "alone"),
    ]
    turns = spark.createDataFrame([(*x, 1) for x in data], "conv_id long, turn long, role string, text string, turns int")
    own = rows(data)
    pairs = spark.createDataFrame([(0, 1), (2, 3), (4, 5), (6, 7)], "chosen long, rejected long")
    out = {r.chosen: r for r in chat.preferences(turns, pairs).collect()}
    assert set(out) == {0, 2, 4}
    for k, r in out.items():
        assert (r.n_common, r.prompt, r.chosen_completion, r.rejected_completion) == brute(own[k], own[k + 1])
    assert [(m.start, m.end, m["mask"]) for m in out[0].rejected_masks] == [(14, 25, 1), (25 + 9, 44, 0)]
    text = out[0].rejected_completion
    assert text[14:25] == "no\n<|end|>\n" and text[34:44] == "é\n<|end|>\n"
    assert chat.preferences(turns.limit(0), pairs).count() == 0


def test_pairs_of_a_table(spark):
    data = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (1, 0, "user", "r"), (1, 1, "assistant", "b"), (1, 2, "user", "s"), (5, 0, "user", "only")]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    out = {r.chosen: r for r in chat.formatted(chat.answered_otherwise(turns)).collect()}
    show = lambda r, t: f"<|{r}|>\n{t}\n<|end|>\n"
    assert (out[0].n_common, out[0].prompt, out[0].chosen_completion, out[0].rejected_completion) == (1, show("user", "q"), show("assistant", "a"), show("assistant", "b"))
    assert (out[1].n_common, out[1].rejected_completion) == (1, show("assistant", "") + show("user", "s"))
    assert (out[5].n_common, out[5].chosen_completion, out[5].rejected_completion) == (1, "", "")


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.sql(chat.SQL)
    out = chat.op4_chat_formatting(spark, sf)
    assert sorted(out.columns) == sorted(want.columns)
    got = out.select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    assert any(r.n_common and r.prompt and r.rejected_completion for r in got)
