import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb

from copperleaf.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            own[c].append(((n is not None, n or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    ended = defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        s = tuple(own.get(int(c / 20) * 20, [])[:h] + ts[h:])
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ended[s].append(c)
    out, parents = [], {q[:-1] for q in members if q}
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if q not in parents]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ids = ",".join(map(str, sorted(ended.get(p, []))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children), len(leaves), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(df):
    nodes, pieces = trie.trie(trie.shared_beginnings(trie.gathered(df)))
    out = nodes.join(trie.digests(pieces), "node", "left").fillna({"ends_sha256": hashlib.sha256().hexdigest()})
    return sorted(map(tuple, out.select(*COLUMNS).collect()), key=repr)


SCHEMA = "conv_id long, turn long, role string, text string, node int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.sql(trie.SQL)
    df = trie.op11_prefix_trie(spark, sf)
    assert sorted(df.columns) == sorted(COLUMNS) == sorted(want.columns)
    assert dict(df.dtypes) == {c: "bigint" for c in COLUMNS[:-1]} | {"ends_sha256": "string"}
    assert sorted(map(tuple, df.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_sql_agrees_with_brute_force(sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    con.sql("CREATE TABLE few AS SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -5, NULL, NULL, 'a b' UNION ALL SELECT -5, 2, 'user', NULL")
    want = brute(con.sql("SELECT * FROM few").fetchall())
    assert sorted(con.sql(trie.SQL.replace("FROM conversations", "FROM few")).fetchall(), key=repr) == want


def test_copies_prefixes_ties_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    r = random.Random(8)
    rows = []
    for c in [*range(120), -3, 400, 421]:
        if c == 60:
            continue  # its group has no first conversation
        kind = r.randrange(6)
        if kind < 2:
            rows += [(c, i, "user", ["hello there", "a  b\tc", ""][i]) for i in range(3)][: r.randrange(1, 4)]
        elif kind == 2:
            rows += [(c, r.choice([None, 1, 2]), r.choice([None, "", "user"]), r.choice([None, "x y", "z"])) for _ in range(r.randrange(1, 6))]
        else:
            rows += [(c, i, r.choice(["user", "assistant"]), r.choice(["one", "one two"])) for i in range(r.randrange(1, 5))]
    rows += [(None, 1, "user", "nobody")]
    rows += [(7, 50 + i, "user", f"long {i}") for i in range(300)]
    rows += [(20, 9, "user", "twice")] * 2
    assert run(frame(spark, rows)) == brute(rows)


def test_role_and_text_do_not_run_together(spark):
    rows = [(0, 0, "ab", "c"), (20, 0, "a", "bc"), (40, 0, "ab", "c")]
    assert run(frame(spark, rows)) == brute(rows)


def test_empty_table(spark):
    assert run(frame(spark, [(1, 1, "a", "b")]).limit(0)) == []
    assert len(run(frame(spark, [(0, 1, "a", "b")]))) == 2


def test_ends_are_sorted_pieces(spark):
    rows = [(c, 0, "user", "same") for c in range(0, 2000, 20)]
    _, pieces = trie.trie(trie.gathered(frame(spark, rows)))
    got = sorted((r.ids for r in pieces.collect()))
    assert [i for ids in got for i in ids] == list(range(0, 2000, 20))
