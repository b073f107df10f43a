"""Operator 9, n-gram Jaccard join: token-combination prefixes, then exact verification.

A document's set holds the 64-bit hashes of its distinct 5-word shingles; equal sets are one node. Tokens are ordered
rare class first, by hash within a class. Two nodes with 100 * |x & y| >= 75 * |x | y| share a token in the first
p = n - ceil(3n/4) + 1 of each. Rare tokens there are indexed singly. A node whose first p tokens reach into the
frequent class is extended by m tokens; if it shares no rare token with a partner, both share m + 1 frequent tokens
there, so with m hash classes of tokens two of them are in one class: pairs of one class are indexed (k = 2). m
depends on the size only; sizes of partners differ by a factor of 4/3 at most, so each node indexes pairs for the size
step of its own and the next one.

Sets are made once and written to the shared folder. Which tokens are frequent (FREQUENT nodes or more, counted once in
a task) is counted in two passes: the first p tokens by hash of every node, then, of nodes that have frequent ones there,
those that may move up into their place. A third pass counts the rare tokens of the prefixes. Any class would give the same result; this one keeps index groups small. The
class reaches the tasks as a bitmap whose size is bounded: where it would grow beyond that, only more frequent tokens
are in it. A second bitmap keeps tokens that one node alone indexes out of the shuffle, as long as their number allows
one. A node's number is a 64-bit hash of its set; sets of one number and another second hash are told apart.

In each index group the nodes are ranked, those with the fewest rare tokens first. The first one meets all others of
the group, the links are verified and united, and it leaves the group: it has met everyone there. Groups whose nodes are
one component by then are done, which is what becomes of the near copies of one text however many they are. In small
groups that are still open, nodes meet the members of other components. In large ones (more than LARGE nodes) what is left
outside the group's largest component is compared with the group in blocks of bounded size, which give a spanning forest
of their links instead of pairs. Where that would be very many blocks, another node outside leads first, as long as that
halves them. Nothing is
capped: no pair that could link two components is left untested. Before sets are compared, their sizes and then counts
of their tokens by hash range bound the overlap, at a sixteenth of the bytes.

Defined results: null, empty and wordless texts have an empty set and are linked with nothing; with fewer than five
words the whole sequence is the one shingle; repeated rows stay rows, equal texts are one component; an empty table
gives no rows; other columns are ignored by classes() and kept by keep_one().
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_BITS, PER_KEY, Marks, blocks, cut, discard, parted, partitions, repeated, small_batches, table, tallied, text_hash
from .components import components

WORDS = 5
FREQUENT = 24
SEEN = 1 << 18
#: Groups of more nodes are compared in blocks of about BLOCK nodes, COLUMNS tokens at once.
LARGE, BLOCK, COLUMNS = 64, 256, 4096
#: A further round of leaders is worth it where more pairs of blocks than MANY would be compared, while it leaves a share
#: of SHRINKS of them or less.
MANY, SHRINKS = 4096, 0.5
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, known: WordHashes) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space alone
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), 1)], np.uint64) if len(h) else h
    out = h[: len(h) - WORDS + 1]
    for k in range(1, WORDS):
        out = out * MIX + h[k : len(h) - WORDS + 1 + k]
    return np.unique(mixed(out))


def node_of(tokens: np.ndarray, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), seed) - (1 << 63)


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), node and check (hashes of the set), n (its size) of every row; tokens (the set, eight
    bytes each), null where the task has met the node before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in blocks(batches, "text", 2 << 20):
            known, out = WordHashes(), []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens = shingles(text, known)
                node, check, raw = node_of(tokens), node_of(tokens, 1), None
                if node ^ check not in seen and len(tokens):
                    seen.add(node ^ check)
                    raw = tokens.tobytes()
                out.append((key, text_hash(text), node, check, len(tokens), raw))
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (*[pa.int64()] * 5, pa.binary()), strict=True)], ["doc_id", "h", "node", "check", "n", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, h long, node long, check long, n long, tokens binary")


def told_apart(rows: DataFrame) -> DataFrame:
    """rows, where nodes of one number and different second hashes get numbers of their own. Hardly ever are there any."""
    clash = cut(rows.groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi").select("node", "lo"))
    if clash.isEmpty():
        return rows
    own = F.when(F.col("check") > F.col("lo"), F.xxhash64("node", "check")).otherwise(F.col("node"))
    return cut(rows.join(clash, "node", "left").withColumn("node", own).select(*rows.columns))


def tokens_in(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a column of sets, one set after the other, and where each set begins (one entry more than sets)."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].tobytes(), np.uint64), (ends - ends[0]) // 8


def places(chosen: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each chosen token, how many chosen ones come before it in its set (others: any number)."""
    before = np.cumsum(chosen) - chosen
    n = np.diff(begin)
    return before - np.repeat(before[np.minimum(begin[:-1], len(before) - 1)], n)


def prefix_size(n: np.ndarray) -> np.ndarray:
    return n - (3 * n + 3) // 4 + 1


def first_of(kind: np.ndarray, begin: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The tokens of a kind that are among the first `most` ones of it in their set."""
    return kind & (places(kind, begin) < np.repeat(most, np.diff(begin)))


def moving_up(tokens: np.ndarray, begin: np.ndarray, frequent: Marks) -> np.ndarray:
    """Tokens that may come into a prefix for frequent ones there, twice as many as those."""
    n, rare = np.diff(begin), ~frequent.of(tokens)
    of, p = np.repeat(np.arange(len(n)), n), prefix_size(n)
    first = first_of(np.ones(len(tokens), bool), begin, p)
    lost = np.bincount(of[first & ~rare], minlength=len(n))
    return first_of(rare, begin, (p + lost) * (lost > 0)) & ~first


def prefixes(rows: DataFrame, chosen: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """key, n: the chosen ones of the tokens of all nodes, tallied. Nodes of one or two tokens have only equal partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys() -> Iterator[np.ndarray]:
            for b in blocks(batches, "tokens", 1 << 20):
                tokens, begin = tokens_in(b.column(0))
                n = np.diff(begin)
                yield tokens[chosen(tokens, begin) & np.repeat(n > 2, n)]

        yield from tallied(keys())

    return rows.select("tokens").where("tokens is not null").mapInArrow(run, "key long, n long")


def bound_of(counts: DataFrame) -> int:
    """FREQUENT, or the least power of two beyond it that leaves no more tokens than a bitmap holds."""
    sizes = counts.where(F.col("n") >= FREQUENT).groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect()  # 64 rows
    bound = FREQUENT
    while sum(r["count"] for r in sizes if 2 << r.power > bound) * PER_KEY > MOST_BITS:
        bound = 1 << bound.bit_length()
    return bound


def token_classes(rows: DataFrame) -> tuple[Marks, Marks]:
    """The frequent class, and the rare tokens that two nodes or more index."""
    often = lambda counts: counts.where(F.col("n") >= bound_of(counts)).select("key")
    first = repeated(prefixes(rows, lambda _, begin: first_of(np.ones(begin[-1], bool), begin, prefix_size(np.diff(begin)))), FREQUENT)
    some = Marks(cut(often(first)))
    more = repeated(prefixes(rows, lambda tokens, begin: moving_up(tokens, begin, some)), FREQUENT)
    frequent = Marks(cut(often(first.unionAll(more))))
    twice = repeated(prefixes(rows, lambda tokens, begin: first_of(~frequent.of(tokens), begin, prefix_size(np.diff(begin)))))
    return frequent, Marks(twice.select("key"))


def size_step(n: int) -> int:
    return int(math.log(n) / math.log(1.34))


def pair_keys(tokens: np.ndarray, step: int, classes: int) -> np.ndarray:
    """Keys of the pairs of one class."""
    c = (mixed(tokens) % np.uint64(classes)).astype(np.int64)
    order = np.argsort(c, kind="stable")
    t, c = tokens[order], c[order]
    out, d = [], 1
    while d < len(t) and (same := c[d:] == c[:-d]).any():
        out.append(mixed(t[:-d][same] * MIX + t[d:][same] + np.uint64(step)))
        d += 1
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def index(rows: DataFrame, frequent: Marks, twice: Marks) -> DataFrame:
    """key, rank, node, n, rare (rare tokens of its prefix): groups of two or more nodes, ranked from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "tokens", 1 << 20):
            tokens, begin = tokens_in(b.column(2))
            n = np.diff(begin)
            of, p = np.repeat(np.arange(len(n)), n), prefix_size(n)
            rare = ~frequent.of(tokens)
            first = rare & (places(rare, begin) < p[of]) & (n > 2)[of]  # partners of one or two tokens are equal
            single = first & twice.of(tokens)
            keys, owners = [tokens[single]], [of[single]]
            n_rare = np.bincount(of[rare], minlength=len(n))
            for i in np.flatnonzero((n_rare < p) & (n > 2)).tolist():
                often = tokens[begin[i] : begin[i + 1]][~rare[begin[i] : begin[i + 1]]]
                for step in (size_step(n[i]), size_step(n[i]) + 1):
                    classes = max(1, round(1.34**step / 8))
                    keys.append(pair_keys(often[: p[i] - n_rare[i] + classes], step, classes))
                    owners.append(np.full(len(keys[-1]), i))
            owner = np.concatenate(owners)
            in_prefix = np.bincount(of[first], minlength=len(n))
            columns = [np.concatenate(keys).view(np.int64), None, n[owner].astype(np.int32), in_prefix[owner].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)) if c is None else pa.array(c) for c in columns], ["key", "node", "n", "rare"])

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key, rare, node. A group's first row waits for a second one."""
        held: list[np.ndarray] | None = None  # the last row, as arrays
        rank0, told = 0, True  # its rank, and whether it has been sent
        for b in batches:
            if not b.num_rows:
                continue
            c = [x.to_numpy() for x in b.columns]
            if held is not None:
                c = [np.concatenate([h, x]) for h, x in zip(held, c, strict=True)]
            key, node = c[0], c[1]
            new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))  # copies of one node follow one another
            c = [x[new] for x in c]
            key = c[0]
            begin = np.append(True, key[1:] != key[:-1])
            at = np.arange(len(key))
            first = np.maximum.accumulate(np.where(begin, at, 0))
            rank = at - first + 1
            if held is not None:
                rank += np.where(first == 0, rank0 - 1, 0)
            last = np.append(key[1:] != key[:-1], False)
            send = ~(begin & (last | (at == len(key) - 1)))  # not rows that are alone, or may be
            if held is not None:
                send[0] = not told and len(key) > 1 and key[1] == key[0]
            held, rank0 = [x[-1:] for x in c], int(rank[-1])
            told = bool(send[-1]) or (told and len(key) == 1)
            rows = [c[0], rank.astype(np.int32), *c[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(x[send]) for x in rows], ["key", "rank", "node", "n", "rare"])

    keyed = rows.select("node", "n", "tokens").where("tokens is not null").mapInArrow(run, "key long, node long, n int, rare int")
    dealt = keyed.repartition(2 * partitions(rows.sparkSession), "key").sortWithinPartitions("key", "rare", "node")
    return dealt.mapInArrow(ranked, "key long, rank int, node long, n int, rare int")


def of_nodes(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, tokens of the nodes in wanted (one column, written by cut()) and, where bits are shared, of some others."""
    marks = Marks(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(marks.of(b.column(0).to_numpy())))

    return rows.select("node", "tokens").where("tokens is not null").mapInArrow(run, "node long, tokens binary")


def profile(tokens: np.ndarray) -> bytes:
    """How many tokens lie in each of a power of two of equal ranges, two on average; empty where a byte can't hold it."""
    width = max(3, (len(tokens) - 1).bit_length() - 1)
    n = np.bincount((tokens >> np.uint64(64 - width)).astype(np.int64), minlength=1 << width)
    return n.astype(np.uint8).tobytes() if n.max(initial=0) < 256 else b""


def profiles(sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "tokens", 1 << 20):
            tokens, begin = tokens_in(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([profile(tokens[a:z]) for a, z in zip(begin[:-1], begin[1:], strict=True)], pa.binary()), pa.array(np.diff(begin))], ["node", "profile", "n"])

    return sets.mapInArrow(run, "node long, profile binary, n long")


def enough(both: int, n: int) -> bool:
    """Whether `both` common tokens of two sets of n in all are a Jaccard similarity of 0.75 or more."""
    return 175 * both >= 75 * n


def possible(a: bytes, b: bytes, n: int) -> bool:
    """Whether profiles leave room for enough common tokens."""
    if not a or not b:
        return True
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    k = min(len(x), len(y))
    return enough(int(np.minimum(x.reshape(k, -1).sum(1), y.reshape(k, -1).sum(1)).sum()), n)


def joined(pairs: DataFrame, facts: DataFrame, *names: str) -> DataFrame:
    """pairs a, b with the facts of both."""
    own = facts.groupBy("node").agg(*(F.first(x).alias(x) for x in names))
    side = lambda k: own.select(F.col("node").alias(k), *(F.col(x).alias(f"{k}_{x}") for x in names))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *(f"{k}_{x}" for x in names for k in "ab"))


def plausible(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [possible(*x[:2], x[2] + x[3]) for x in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return joined(pairs, facts, "profile", "n").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, at), (y, bt) = tokens_in(batch.column(2)), tokens_in(batch.column(3))
            keep = [enough(len(np.intersect1d(x[at[i] : at[i + 1]], y[bt[i] : bt[i + 1]], assume_unique=True)), at[i + 1] - at[i] + bt[i + 1] - bt[i]) for i in range(batch.num_rows)]
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return joined(pairs, sets, "tokens").mapInArrow(run, "a long, b long")


def forest(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, alike: Callable[[np.ndarray, np.ndarray], np.ndarray] = lambda both, n: 175 * both >= 75 * n) -> list[tuple[int, int]]:
    """Of the links between the sets numbered in left and those in right, enough to connect what they connect. alike: of
    counts of common tokens and of tokens in all."""
    n = np.array([len(x) for x in sets])
    of = np.repeat(np.arange(len(sets)), n)
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # of tokens that two sets or more have
    of, token = of[times[token] > 1], number[token[times[token] > 1]]
    both = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, int(token.max(initial=-1)) + 1, COLUMNS):
        here = (token >= k) & (token < k + COLUMNS)
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[of[here], token[here] - k] = 1
        both += has[left] @ has[right].T
    up = list(range(len(sets)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(alike(both.astype(np.float64), n[left][:, None] + n[right])), strict=True):
        x, y = top(left[i]), top(right[j])
        if x != y:
            up[x] = y
            out.append((int(left[i]), int(right[j])))
    return out


def of_large_groups(large: DataFrame, rows: DataFrame) -> DataFrame:
    """a, b: links that connect the linked nodes of large groups. large: key, node, outside (whether the node is outside the
    group's largest component). Every two blocks, one of nodes outside and one of all, are compared in a task of their own,
    set by set, by a product of matrices; only the links of a spanning forest leave the task."""
    size = large.groupBy("key").agg(*(F.expr(f"cast(({n} - 1) div {BLOCK} + 1 as int)").alias(k) for k, n in (("lefts", "count_if(outside)"), ("rights", "count(*)"))), F.sum(F.xxhash64("node", "outside").cast("decimal(38,0)")).alias("same"), F.count(F.lit(1)).alias("all"))
    size = size.dropDuplicates(["same", "all"]).drop("same", "all")  # groups of the same nodes are compared once
    wanted = cut(large.select("node").distinct())
    sets = of_nodes(rows, wanted).groupBy("node").agg(F.first("tokens").alias("tokens"))
    own = large.join(size, "key")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = own.where("outside").select("key", part("lefts").alias("i"), every("rights").alias("j"), F.lit(True).alias("left"), "node")
    right = own.select("key", every("lefts").alias("i"), part("rights").alias("j"), F.lit(False).alias("left"), "node")
    met = left.unionAll(right).join(sets, "node")

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        tokens, begin = tokens_in(t["tokens"].chunk(0))
        sets = [tokens[x:y] for x, y in zip(begin[:-1], begin[1:], strict=True)]
        side, node = t["left"].to_numpy(), t["node"].to_numpy()
        found = np.array(forest(sets, np.flatnonzero(side), np.flatnonzero(~side)), np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([pa.array(node[found[:, 0]]), pa.array(node[found[:, 1]])], ["a", "b"])

    return met.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").where("a <> b")


def still_open(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of groups with their root, of groups that hold several components."""
    own = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = own.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return cut(own.join(several, "key", "left_semi"))


def outsiders(large: DataFrame) -> DataFrame:
    """The rows of large groups (see still_open()) with outside."""
    of = large.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("main"))
    return cut(large.join(of, "key").withColumn("outside", F.col("root") != F.col("main")).drop("main"))


def block_pairs(large: DataFrame) -> int:
    """About how many pairs of blocks of_large_groups() would compare."""
    n = large.groupBy("key").agg(F.expr(f"ceil(count_if(outside) / {BLOCK}) * ceil(count(*) / {BLOCK})").alias("n"))
    return n.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def linked(rows: DataFrame) -> DataFrame:
    """node, root: nodes that are linked with another one. rows: see stored()."""
    indexed = cut(index(rows, *token_classes(rows)))
    size = indexed.groupBy("key").agg(F.max("rank").alias("size"))
    groups = cut(indexed.join(size, "key"))
    discard(indexed)
    facts = cut(profiles(of_nodes(rows, cut(groups.select("node").distinct()))))
    near = F.expr("175L * least(n, l_n) >= 75L * (n + l_n)")
    as_leader = [F.col(c).alias(f"l_{c}") for c in ("node", "n", "root")]

    def tested(met: DataFrame) -> DataFrame:
        """a, b: the linked ones among pairs of rows of one group."""
        pairs = cut(met.where((F.col("root") != F.col("l_root")) & near).select(F.least("node", "l_node").alias("a"), F.greatest("node", "l_node").alias("b")).distinct())
        likely = cut(plausible(pairs, facts))
        ends = cut(likely.select("a").unionAll(likely.select("b")).distinct())
        out = cut(verified(likely, of_nodes(rows, ends)))
        discard(pairs, likely, ends)
        return out

    with_root = groups.withColumn("root", F.col("node"))
    links = tested(with_root.where("rank = 1").select("key", *as_leader).join(with_root.where("rank > 1"), "key"))
    roots = cut(components(links))
    own = still_open(groups.where("rank > 1"), roots)

    small = own.where(F.col("size") <= LARGE)
    more = small.select("key", F.col("rank").alias("l_rank"), *as_leader).join(small, "key").where("rank > l_rank")
    links = links.unionAll(tested(more))

    large, before = outsiders(own.where(F.col("size") > LARGE)), math.inf
    while MANY < (work := block_pairs(large)) <= SHRINKS * before:
        before = work
        leads = large.where("outside").groupBy("key").agg(F.min_by(F.struct("node", "n", "root"), F.struct("rank", "node")).alias("lead"))
        leads = cut(leads.select("key", *(F.col(f"lead.{c}").alias(f"l_{c}") for c in ("node", "n", "root"))))
        links = links.unionAll(tested(large.join(leads, "key")))
        roots = cut(components(links))
        others = large.join(leads, (large["key"] == leads["key"]) & (large["node"] == leads["l_node"]), "left_anti").drop("root", "outside")
        large = outsiders(still_open(others, roots))
    if work:
        links = links.unionAll(cut(of_large_groups(large.select("key", "node", "outside"), rows)))
    roots = cut(components(cut(links)))
    discard(groups, own, facts, large)
    return roots


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, h, n_shingles, component_id of every row."""
    with small_batches(docs.sparkSession, "4m"):  # sets are large rows
        rows = told_apart(cut(stored(docs)))
        roots = linked(rows)
    rows = rows.select("doc_id", "h", "node", F.col("n").alias("n_shingles"))
    classed = rows.join(roots, "node", "left").withColumn("class", F.coalesce("root", "node"))
    least = classed.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    out = classed.join(cut(least), "class", "left")  # written, so that a class of many documents can be split
    return out.select("doc_id", "h", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is their component's smallest one; all columns are kept."""
    gone = cut(classes(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"), F.col("h").alias("__gone_h")).distinct())
    others, concerned = parted(docs, gone.select("__gone_h"))
    left = concerned.join(gone, (F.col("doc_id") == F.col("__gone")) & (F.col("__h") == F.col("__gone_h")), "left_anti")
    return others.unionAll(left.drop("__h"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("h")


#: Shingles compared whole, links from all shared ones, components by walking them.
SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM t WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS n FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM b JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * b.n >= 75 * (x.n + y.n - b.n)),
m AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
c AS (SELECT doc_id AS a, doc_id AS z FROM n UNION SELECT c.a, m.v FROM c JOIN m ON c.z = m.u),
r AS (SELECT a, min(z) AS least FROM c GROUP BY a)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(r.least, t.doc_id) AS component_id FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN r ON r.a = t.doc_id
"""

QUERIES = {"op9_ngram_jaccard": op9_ngram_jaccard}
ORACLES = {"op9_ngram_jaccard": SQL}
