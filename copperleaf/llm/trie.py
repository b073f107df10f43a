"""Operator 11, the prefix trie of conversations by whole-sequence collapse.

Conversations are sequences of turns (role, text); a node of the trie is a distinct sequence of first turns. Turns
become digests before they are shuffled, and a sequence is known by the 128-bit hashes of all its prefixes, one
after the other (SHA-256 over the digests so far). Identical conversations are grouped into weighted sequences (how
many, the smallest conv_id) beside a list of the conversations that end there. A distinct set of the proper prefixes
is anti-joined to find the leaves, the sequences that no other continues. All else are sums over the prefixes of
the weighted sequences, a row for each prefix, added up before they are shuffled: members, leaves below, children.

Tokens saved below a node are (members - 1) * words, summed over its subtree: the words of all members from that depth
on, less those of its distinct nodes. Distinct nodes are counted once, for the sequence that holds the smallest conv_id
of the node. Such a sequence owns all of its nodes from some depth on, so both terms are sums of the rest of its words.

A first turn or a whole conversation may be shared by a third of all rows: its prefixes are added up in each task. A
list of the ends of one sequence is sorted by range over all tasks and kept in pieces of PIECE ids; children are joined with
their parent from written tables, so Spark can split the children of one node. A conversation is one row of digests.

Defined results: turns are ordered by number, null first, ties by role and text; null roles and texts count as
empty; rows without a conv_id take no part; a remainder has the sign of the conv_id, as in SQL; repeated rows are turns of
their own; a conversation with no turns left is a member of the root and ends there; an empty table gives no rows, not even the root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, table

WORD = r"[^\x20\x09-\x0D]+"
#: Ids in a piece of a list of ends.
PIECE = 1 << 14
#: Turns that conversations may take over from the first of their group, and conversations in a group.
SHARED, GROUP = 4, 20
NOTHING = hashlib.sha256().digest()[:16]
TURNS = "array<struct<digest: binary, words: bigint>>"


def texted(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest, words of all turns; nobody's turns are left out."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    own = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return own.select("*", digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def gathered(turns: DataFrame) -> DataFrame:
    """conv_id, turns (digest and words of each, in order). Only digests are shuffled. Texts order the turns of the
    conversations where a number has different turns: those conversations are read again."""
    every = texted(turns)
    in_order = lambda df, *by: df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*by, "digest", "words"))).alias("turns"))
    own = cut(in_order(every, "turn"))
    pair = lambda i: F.get("turns", i)
    tied = own.where(F.exists(F.sequence(F.lit(1), F.size("turns")), lambda i: pair(i)["digest"].isNotNull() & pair(i)["turn"].eqNullSafe(pair(i - 1)["turn"]) & (pair(i)["digest"] != pair(i - 1)["digest"])))
    bare = lambda df: df.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))
    ids = cut(tied.select("conv_id"))
    if ids.isEmpty():
        return bare(own)
    again = every.join(ids, "conv_id", "left_semi")
    return bare(own.join(ids, "conv_id", "left_anti")).unionByName(bare(in_order(again, "turn", "role", "text")))


def shared_beginnings(own: DataFrame, group: int = GROUP, most: int = SHARED) -> DataFrame:
    """Conversations of gathered(), each begun with the first crc32(conv_id) % most turns of the first of its group in place
    of as many of its own."""
    n = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    first = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, most - 1).alias("begin"))
    both = own.withColumn("first", F.col("conv_id") - F.col("conv_id") % group).join(first, "first", "left")
    begin = F.slice(F.coalesce("begin", F.array().cast(TURNS)), F.lit(1), n)
    return both.select("conv_id", F.concat(begin, F.slice("turns", n + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


STEP = "struct<node: binary, parent: binary, words: bigint, rest: bigint>"


def prefixed(conversations: DataFrame) -> DataFrame:
    """conv_id, node (the whole sequence), steps: for each prefix from the root on its hash, that of its parent, the words of
    its last turn, and the words from that turn on to the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, steps = [], []
            for turns in b.column(1).to_pylist():
                chain, rest = hashlib.sha256(), sum(t["words"] for t in turns)
                own = [{"node": NOTHING, "parent": None, "words": 0, "rest": rest}]
                for t in turns:
                    chain.update(t["digest"])
                    own.append({"node": chain.copy().digest()[:16], "parent": own[-1]["node"], "words": t["words"], "rest": rest})
                    rest -= t["words"]
                nodes.append(own[-1]["node"])
                steps.append(own)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.binary()), pa.array(steps, kind)], ["conv_id", "node", "steps"])

    kind = pa.list_(pa.struct([("node", pa.binary()), ("parent", pa.binary()), ("words", pa.int64()), ("rest", pa.int64())]))
    return conversations.select("conv_id", "turns").mapInArrow(run, f"conv_id long, node binary, steps array<{STEP}>")


def collapsed(sequences: DataFrame) -> DataFrame:
    """node, n, conv_id (the smallest), steps: a row for each distinct one of prefixed()."""
    return sequences.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.first("steps").alias("steps"))


def ends(sequences: DataFrame, piece: int = PIECE) -> DataFrame:
    """node, ids: for each distinct sequence the conversations that end there, ascending, in sorted pieces that follow
    one another by their first ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], ["node", "ids"])

        for b in batches:
            done: list[tuple[bytes, list[int]]] = []
            for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and (n != node or len(ids) >= piece):
                    done.append((node, ids))
                    ids = []
                node = n
                ids.append(c)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.list_(pa.int64()))], ["node", "ids"])
        if ids:
            yield out()

    by = ["node", "conv_id"]
    dealt = sequences.select(*by).repartitionByRange(partitions(sequences.sparkSession), *by).sortWithinPartitions(*by)
    return dealt.mapInArrow(run, "node binary, ids array<long>")


def trie(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends() of the trie over conversations (conv_id, turns: the digest and words of each).

    Nodes: node (hash), parent, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens."""
    every = cut(prefixed(conversations))
    sequences = cut(collapsed(every))
    # leaves: whole sequences that are no proper prefix of another
    inner = sequences.select(F.explode(F.slice("steps", F.lit(1), F.size("steps") - 1)).alias("s")).select("s.node").distinct()
    continued = cut(sequences.select("node").join(inner, "node", "left_semi"))
    leaves = sequences.join(continued, "node", "left_anti").withColumn("leaf", F.lit(1))
    weighted = leaves.unionByName(sequences.join(continued, "node", "left_semi").withColumn("leaf", F.lit(0)))
    step = lambda df, *more: df.select(*more, F.posexplode("steps").alias("depth", "s"))
    nodes = cut(
        step(weighted, "n", "conv_id", "leaf")
        .select("n", "conv_id", "leaf", F.col("depth").cast("long").alias("depth"), "s.*")
        .groupBy("node", "depth", "parent")
        .agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum(F.col("n") * F.col("rest")).alias("said"))
    )
    # the depth from which on a sequence has the smallest conv_id of its nodes
    owned = nodes.groupBy("conv_id").agg(F.min("depth").cast("int").alias("from"))
    with_depth = sequences.select("conv_id", "steps").join(owned, "conv_id", "left")
    left = with_depth.select("steps", F.coalesce(F.get("steps", F.col("from"))["rest"], F.lit(0)).alias("own"))
    once = step(left, "own").select("s.node", F.least("own", "s.rest").alias("x")).groupBy("node").agg(F.sum("x").alias("once"))
    children = nodes.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "node")
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(once, "node").join(children, "node", "left").select(
        "node", "parent", "conv_id", "depth", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", (F.col("said") - F.col("once")).alias("saved_tokens")
    )
    return cut(out).join(parents, "parent", "left"), ends(every)


def digests(pieces: DataFrame) -> DataFrame:
    """node, ends_sha256 of ends(): the pieces of a node are read one after the other as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, chain = None, None
        for b in batches:
            done = []
            for n, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                text = ",".join(map(str, ids))
                if n != node:
                    if chain is not None:
                        done.append((node, chain.hexdigest()))
                    node, chain = n, hashlib.sha256(text.encode())
                else:
                    chain.update(b"," + text.encode())
            yield rows(done)
        if chain is not None:
            yield rows([(node, chain.hexdigest())])

    def rows(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["node", "ends_sha256"])

    first = pieces.select("node", F.get("ids", F.lit(0)).alias("first"), "ids")
    return first.repartition(partitions(pieces.sparkSession), "node").sortWithinPartitions("node", "first").mapInArrow(run, "node binary, ends_sha256 string")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, pieces = trie(shared_beginnings(gathered(table(spark, sf_dir, "conversations"))))
    out = nodes.join(digests(pieces), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))
    return out.select(*(F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), "ends_sha256")


#: crc32 is reduced over each byte followed by eight shifts; 3988292384 is its polynomial.
SQL = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
    strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT c, xor(list_reduce(flatten(list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda k: [CAST(ascii(substr(CAST(c AS VARCHAR), k, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(4294967295 AS BIGINT)), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT c.c, t.i, t.said, t.words FROM c JOIN t ON t.c = c.c - c.c % 20 AND t.i <= c.h
  UNION ALL SELECT c.c, t.i + 1000000, t.said, t.words FROM c JOIN t ON t.c = c.c AND t.i > c.h),
s AS (SELECT c, i, words, row_number() OVER (PARTITION BY c ORDER BY i) AS depth, said FROM r),
p AS (
  SELECT c, depth, words, sha256(string_agg(sha256(said), '') OVER (PARTITION BY c ORDER BY depth)) AS node FROM s
  UNION ALL SELECT c, 0, 0, 'root' FROM c),
e AS (SELECT c, depth, words, node, lag(node) OVER (PARTITION BY c ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY c) AS ended FROM p),
n AS (
  SELECT node, any_value(parent) AS parent, min(c) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ended), '')) AS ends_sha256
  FROM e GROUP BY node),
k AS (SELECT n.*, coalesce(m, 0) AS n_children FROM n LEFT JOIN (SELECT parent AS node, count(*) AS m FROM n WHERE parent IS NOT NULL GROUP BY parent) USING (node)),
a AS (SELECT DISTINCT u.node AS top, v.node AS node FROM e u JOIN e v ON u.c = v.c AND u.depth <= v.depth),
b AS (SELECT top AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM a JOIN k USING (node) GROUP BY top)
SELECT k.conv_id, CAST(k.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, k.n_convs, CAST(k.n_children AS BIGINT) AS n_children, b.n_leaves,
  CAST(b.saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
FROM k JOIN b USING (node) LEFT JOIN n q ON q.node = k.parent
"""

QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLES = {"op11_prefix_trie": SQL}
