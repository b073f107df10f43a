"""Operator 13, token counts by rank-synchronous array merging.

A block of texts becomes one array of characters. It is cut between two characters wherever no piece of the vocabulary
holds both side by side: no merge can reach over such a place, so what lies between two cuts, a pre-token, is counted
alone. The distinct pre-tokens of a block are held as one ragged array of symbols; in every round the pair of lowest rank of each
pre-token is applied, in all pre-tokens at once, until none has a pair left. What survives is counted: a symbol of the
vocabulary is one token, a character outside it as many as its bytes.

The rounds apply merges in the order of the library's queue: by rank, then from left to right. All places of a
pre-token's lowest pair are applied in one round unless one of them makes a pair that comes before the places to its
right (pieces of equal rank, such as those of several spaces); then only the first is, and what is left of a longer
pre-token is merged pair by pair from a heap, so that no text takes time in the square of its length. Pre-tokens are grouped by a hash and compared with the one that stands for them; where
they differ they are merged on their own.

Rows stay where they are: nothing is shuffled, whatever share of the rows a source or a text has. Blocks hold BLOCK bytes
of text, one longer text excepted, which is worked on in slices of SLICE characters that end at cuts.

Defined results: a null or empty text has no bytes and no tokens; repeated rows are counted row by row; an empty table
gives no rows; a text of any length is counted whole; other columns are ignored. Byte-pair models with byte fallback and
without user-defined or unused pieces are counted, others refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIMIT = 4096
#: Bytes of text in a block, and characters in a slice.
BLOCK, SLICE = 2 << 20, 1 << 21
#: Symbols from which on a pre-token whose merges must go one by one leaves the rounds.
LONG = 32
#: The rank of no pair.
NONE = np.int32(2**31 - 1)
SPACE = "▁"
#: Types of pieces in a model file (fixed values of the format), and the number of its byte-pair type.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PAIRS = 2


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message of the model file."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, raw[at : at + size]
        at += size


class Vocabulary:
    """A model file as arrays. Symbols are numbered: first the characters of all pieces, then the longer pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        pieces, trainer, normalizer = [], {}, {}
        for field, value in fields(raw):
            if field == 1:
                own = dict(fields(value))
                pieces.append((own[1].decode(), float(np.frombuffer(own.get(2, b"\0" * 4), "<f4")[0]), own.get(3, NORMAL)))
            elif field in (2, 3):
                (trainer if field == 2 else normalizer).update(fields(value))
        kinds = {kind for *_, kind in pieces}
        if trainer.get(3, 1) != PAIRS or BYTE not in kinds or kinds & {USER, UNUSED}:
            raise ValueError(f"{path} is no byte-pair model with byte fallback and without user-defined or unused pieces")
        self.path = path
        self.plain = normalizer.get(1) == b"identity" and not normalizer.get(2) and normalizer.get(3, 1) == 1 and normalizer.get(4, 1) == 0 and normalizer.get(5, 1) == 1
        score = {p: s for p, s, kind in pieces if kind == NORMAL}
        letters = sorted({c for p in score for c in p})
        number = {c: i for i, c in enumerate(letters)} | {p: len(letters) + i for i, p in enumerate(p for p in score if len(p) > 1)}
        self.n_letters = n = len(letters)
        self.letter = np.full(0x110000, -1, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(n)
        #: Tokens of a symbol that survives.
        self.cost = np.ones(len(number), np.int64)
        self.cost[:n] = [1 if c in score else len(c.encode()) for c in letters]
        place = {s: i for i, s in enumerate(sorted(set(score.values()), reverse=True))}
        found = []
        for p, s in score.items():
            if len(p) > 1:
                found += [(number[p[:i]], number[p[i:]], place[s], number[p]) for i in range(1, len(p)) if p[:i] in number and p[i:] in number]
        left, right, ranks, made = np.array(found, np.int64).reshape(-1, 4).T
        order = np.argsort(left * len(number) + right)
        self.keys, self.ranks, self.made = (left * len(number) + right)[order], ranks[order].astype(np.int32), made[order].astype(np.int32)
        side = np.zeros(n * n, bool)
        for p in score:
            own = self.letter[[ord(c) for c in p]].astype(np.int64)
            side[own[:-1] * n + own[1:]] = True
        self.side = np.packbits(side, bitorder="little")

    def normalized(self, text: str) -> str:
        if self.plain:
            return SPACE + text.replace(" ", SPACE) if text else ""
        return _library(self.path).normalize(text)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs of symbols."""
        key = left.astype(np.int64) * len(self.cost) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there = self.keys[at] == key
        return np.where(there, self.ranks[at], NONE), np.where(there, self.made[at], 0)

    @cached_property
    def table(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))

    def joined(self, symbols: np.ndarray) -> np.ndarray:
        """For each two neighbours, whether some piece holds both side by side."""
        left, right = symbols[:-1], symbols[1:]
        key = np.where((left < 0) | (right < 0), 0, left.astype(np.int64) * self.n_letters + right)
        return ((self.side[key >> 3] >> (key & 7).astype(np.uint8)) & 1).astype(bool) & (left >= 0) & (right >= 0)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=1)
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def one_by_one(symbols: list[int], own: Vocabulary) -> list[int]:
    """What is left of one sequence when its pairs are merged in the order of a heap."""
    n, pair, heap = len(symbols), own.table.get, []
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (found := pair(symbols[i] * len(own.cost) + symbols[j])):
            heappush(heap, (found[0], i, symbols[i], symbols[j], found[1]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, left, right, made = heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue  # one of them was merged since
        symbols[i], symbols[j], after[i] = made, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [s for s in symbols if s >= 0]


def surviving(symbols: np.ndarray, sizes: np.ndarray, own: Vocabulary) -> np.ndarray:
    """How many tokens each sequence of a ragged array ends with. sizes: its numbers of symbols, none 0."""
    out, n = np.zeros(len(sizes), np.int64), len(sizes)
    sequence = np.repeat(np.arange(n), sizes)
    rank, made = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int32)

    def renew(at: np.ndarray) -> None:
        at = at[at + 1 < len(symbols)]
        inner = sequence[at] == sequence[at + 1]
        r, m = own.pairs(symbols[at], symbols[at + 1])
        rank[at], made[at] = np.where(inner, r, NONE), m

    renew(np.arange(len(symbols)))
    while len(symbols):
        starts = np.flatnonzero(np.diff(sequence, prepend=-1))
        length, low = np.diff(starts, append=len(symbols)), np.minimum.reduceat(rank, starts)
        if (low == NONE).any():
            ready = np.repeat(low == NONE, length)
            out += np.bincount(sequence[ready], own.cost[symbols[ready]], n).astype(np.int64)
            symbols, sequence, rank, made = (x[~ready] for x in (symbols, sequence, rank, made))
            continue
        hit = np.flatnonzero(rank == np.repeat(low, length))
        k = np.arange(len(hit))
        run = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) != 1, k, 0))
        hit = hit[(k - run) % 2 == 0]  # of pairs that overlap, the first, third, ...
        first = np.diff(sequence[hit], prepend=-1) != 0
        if not first.all():
            new, which = made[hit], np.cumsum(first) - 1
            left = np.where(np.diff(hit, prepend=-3) == 2, np.concatenate([[0], new[:-1]]), symbols[hit - 1])
            after = np.minimum(hit + 2, len(symbols) - 1)
            before = np.where((hit > 0) & (sequence[hit - 1] == sequence[hit]), own.pairs(left, new)[0], NONE)
            behind = np.where((after == hit + 2) & (sequence[after] == sequence[hit]), own.pairs(new, symbols[after])[0], NONE)
            early = np.zeros(int(which[-1]) + 1, bool)
            early[which[np.minimum(before, behind) <= rank[hit]]] = True
            slow = early & (length >= LONG)
            if slow.any():
                for begin, size in zip(starts[slow].tolist(), length[slow].tolist(), strict=True):
                    out[sequence[begin]] = own.cost[one_by_one(symbols[begin : begin + size].tolist(), own)].sum()
                leave = np.repeat(slow, length)
                symbols, sequence, rank, made = (x[~leave] for x in (symbols, sequence, rank, made))
                continue
            hit = hit[first | ~early[which]]
        symbols[hit] = made[hit]
        rank[hit] = NONE
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        symbols, sequence, rank, made = (x[keep] for x in (symbols, sequence, rank, made))
        at = hit - np.arange(len(hit))
        rank[at] = NONE
        before = at[at > 0] - 1
        renew(np.concatenate([at, before[sequence[before] == sequence[before + 1]]]))
    return out


def sequence_tokens(symbols: np.ndarray, starts: np.ndarray, own: Vocabulary) -> np.ndarray:
    """Tokens of each sequence of characters; those that occur several times are merged once."""
    sizes = np.diff(starts, append=len(symbols))
    if not len(sizes):
        return sizes
    place = np.arange(len(symbols)) - np.repeat(starts, sizes)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
        hashes = np.add.reduceat((symbols.astype(np.uint64) + np.uint64(1)) * power[place], starts)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    like = first[which]  # the sequence that stands for each
    equal = sizes == sizes[like]
    same = symbols[np.minimum(np.repeat(starts[like], sizes) + place, len(symbols) - 1)] == symbols
    equal &= np.logical_and.reduceat(same, starts)
    alone = np.concatenate([first, np.flatnonzero(~equal)])
    n = sizes[alone]
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[alone], n)
    tokens = surviving(symbols[at], n, own)
    out = tokens[which]
    out[alone[len(first) :]] = tokens[len(first) :]
    return out


def slice_tokens(codes: np.ndarray, breaks: np.ndarray, own: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """First character and tokens of each pre-token. breaks: whether a text begins at each character."""
    symbols = own.letter[codes]
    starts = np.flatnonzero(np.concatenate([[True], ~own.joined(symbols)]) | breaks)
    sizes = np.diff(starts, append=len(codes))
    out = np.empty(len(starts), np.int64)
    single = sizes == 1
    lone, code = symbols[starts[single]], codes[starts[single]]
    out[single] = np.where(lone < 0, 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF), own.cost[np.maximum(lone, 0)])
    inside = np.repeat(~single, sizes)
    n = sizes[~single]
    out[~single] = sequence_tokens(symbols[inside], np.cumsum(n) - n, own)
    return starts, out


def token_counts(texts: list[str | None], path: str = MODEL, size: int = SLICE) -> np.ndarray:
    """Tokens of each text."""
    own = vocabulary(path)
    texts = [own.normalized(t or "") for t in texts]
    ends = np.cumsum([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    breaks = np.zeros(len(codes) + 1, bool)
    breaks[ends - [len(t) for t in texts]] = True
    out, a, step = np.zeros(len(texts), np.int64), 0, size
    while a < len(codes):
        b = min(a + step, len(codes))
        if b < len(codes):  # back to the last cut
            free = ~own.joined(own.letter[codes[a : b + 1]]) | breaks[a + 1 : b + 1]
            if not free.any():
                step *= 2
                continue
            b = a + 1 + int(np.flatnonzero(free)[-1])
        starts, n = slice_tokens(codes[a:b], breaks[a:b], own)
        out += np.bincount(np.searchsorted(ends, a + starts, side="right"), n, len(texts)).astype(np.int64)
        a, step = b, size
    return out


def counted(docs: DataFrame, key: str = "doc_id", path: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            n_bytes = pa.compute.coalesce(pa.compute.binary_length(b.column(1)), 0).cast(pa.int64())
            n = token_counts(b.column(1).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([b.column(0), n_bytes, pa.array(n), pa.array(n > limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(key).cast("long").alias(key), "text").mapInArrow(run, f"`{key}` long, n_bytes long, n_tokens long, over_limit boolean")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(table(spark, sf_dir, "documents"))


QUERIES = {"op13_token_counts": op13_token_counts}
ORACLES: dict[str, str] = {}
