"""Operator 1, secret scans, by DataFrame functions alone.

Base patterns give spans of three kinds: assign, access and hex. A span is a whole match, in code points, its end
exclusive. To these the method adds spans of kind markov: tokens that two character Markov models, one of random
strings and one of ordinary identifiers, tell apart by their log-likelihood ratio. Both are trained from labelled
samples: the values that base patterns found are the random strings, other tokens the identifiers. The sample is the
SAMPLE_ROWS documents of the smallest hash of doc_id, a bound that does not depend on the size of the input; the
models are at most (K+1)^2 counts. Spans of kind markov never overlap base spans.

Spark has no search that returns positions: they come from the lengths of the matches and of the pieces between them,
summed up in one pass. Lists that grow in a pass do so in pieces of STEP spans, so that the work follows the number of
matches, not its square. Every text is scanned alone, so the only shuffles are those of the bounded sample.

Defined results: a null or empty text has no spans; an empty table gives no rows; without labelled samples the models
are uniform and nothing is added; repeated rows are scanned row by row; other columns are left alone by redact().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import smallest, table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"  # AKIA[A-Z0-9]+ of 16 or more: no later start in the run of a failing match can be longer
HEX = "[0-9a-f]{32,}"  # [0-9a-f]+ takes whole runs, so the same spans
KINDS = ("assign", "access", "hex", "markov")
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
WORD = "[A-Za-z0-9+/_=-]{3,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
K = len(ALPHABET)
SAMPLE_ROWS = 2048
BACKOFF = 20
#: Natural logarithm of the odds that must be overcome: one random token in a million.
PRIOR = math.log(1e6)
UNIT = 1000  # log ratios are whole thousandths, so that sums don't depend on their order
STEP = 64
SPAN = "struct<s:int,k:int,e:int>"


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def start(**fields: Column) -> Column:
    """What a pass begins with: own fields, and a list of spans as `few` (the last ones) and `many` (full pieces before)."""
    return F.struct(*(x.alias(k) for k, x in fields.items()), none().alias("few"), F.array().cast(f"array<array<{SPAN}>>").alias("many"))


def grown(acc: Column, span: Column, wanted: Column, **fields: Column) -> Column:
    """The next state of a pass, with span at the end of its list where it is wanted."""
    full = F.size(acc["few"]) >= STEP
    few = F.when(wanted, F.concat(F.when(full, none()).otherwise(acc["few"]), F.array(span))).otherwise(acc["few"])
    many = F.when(wanted & full, F.array_append(acc["many"], acc["few"])).otherwise(acc["many"])
    return F.struct(*(x.alias(k) for k, x in fields.items()), few.alias("few"), many.alias("many"))


def span(s: Column, k: Column, e: Column) -> Column:
    return F.struct(s.cast("int").alias("s"), k.cast("int").alias("k"), e.cast("int").alias("e"))


def found(text: Column, pattern: str, kind: int, whole: str, second: str | None = None, least: int = 0) -> Column:
    """array<SPAN> of the leftmost non-overlapping matches. whole: the column of the matches; second: that of their
    groups 2, which must have the length `least`."""
    wide = F.zip_with(F.split(text, pattern, -1), whole, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("own")))
    if second:
        wide = F.zip_with(wide, second, lambda x, v: F.struct(x["gap"].alias("gap"), x["own"].alias("own"), (F.length(v) >= least).alias("fine")))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        fine = x["own"].isNotNull()  # the last piece has no match after it
        return grown(acc, span(s, F.lit(kind), s + x["own"]), fine & x["fine"] if second else fine, at=s + x["own"])

    spans = F.aggregate(wide, start(at=F.lit(0)), step, lambda acc: F.flatten(F.array_append(acc["many"], acc["few"])))
    return F.when(F.size(whole) > 0, spans).otherwise(none())


def numbers(token: Column) -> Column:
    """array<int>: each character's number in ALPHABET, from 1; 0 stands for a character outside."""
    known = [ALPHABET.find(chr(c)) + 1 for c in range(128)]
    table = F.split(F.lit(",".join(map(str, known))), ",").cast("array<int>")  # folded into one literal
    return F.transform(F.split(token, ""), lambda c: F.coalesce(F.get(table, F.ascii(c)), F.lit(0)))


def steps(token: Column) -> Column:
    """array<int>: the number of each character pair of a token."""
    x = numbers(token)
    pairs = F.zip_with(x, F.slice(x, F.lit(2), F.greatest(F.length(token) - 1, F.lit(0))), lambda a, b: a * (K + 1) + b)
    return F.filter(pairs, lambda p: p.isNotNull())


def samples(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """token, random: labelled tokens of the `rows` documents of smallest hash. Assigned values, keys and hexadecimal runs are random."""
    own = smallest(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), rows, "doc_id", "text")
    cleared = F.col("text")
    for p in (ASSIGN, ACCESS, HEX):
        cleared = F.regexp_replace(cleared, p, " ")
    taken = F.concat(
        F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda x: F.length(x) >= 8),
        F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all("text", F.lit(HEX), F.lit(0)),
    )
    words = F.regexp_extract_all(cleared, F.lit(WORD), F.lit(0))
    return own.select(F.explode(taken).alias("token"), F.lit(True).alias("random")).unionAll(own.select(F.explode(words).alias("token"), F.lit(False).alias("random")))


def train(tokens: DataFrame) -> list[int]:
    """(K+1)^2 log-likelihood ratios of character pairs, in thousandths.

    A pair's probability is its share after its first character, smoothed by BACKOFF times the share of the second
    character alone (add-one), so that characters rare among identifiers count even after a first character not seen.
    """
    counts = tokens.select("random", F.explode(steps(F.col("token"))).alias("pair")).groupBy("random", "pair").count().collect()
    size = K + 1
    n = {True: [0] * size * size, False: [0] * size * size}
    for random, pair, c in counts:
        n[random][pair] = c
    logs = {}
    for x, own in n.items():
        alone = [sum(own[b::size]) + 1 for b in range(size)]
        share = [c / sum(alone) for c in alone]
        logs[x] = [math.log((own[a * size + b] + BACKOFF * share[b]) / (sum(own[a * size : (a + 1) * size]) + BACKOFF)) for a in range(size) for b in range(size)]
    return [round(UNIT * (r - o)) for r, o in zip(logs[True], logs[False], strict=True)]


def llr(token: Column, model: list[int]) -> Column:
    """The sum of a token's ratios, in one pass over its characters."""
    weights = F.split(F.lit(",".join(map(str, model))), ",").cast("array<bigint>")
    first = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).cast("bigint").alias("sum"))
    step = lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.coalesce(F.get(weights, acc["last"] * (K + 1) + c), F.lit(0).cast("bigint"))).alias("sum"))
    return F.aggregate(numbers(token), first, step, lambda acc: acc["sum"])


def free(base: str, more: str) -> Column:
    """The spans of more (sorted, apart from each other) that overlap none of base (sorted). One pass over both in order:
    a span of more is held until the next one, or a base span that begins before its end."""
    nothing = F.lit(None).cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        held, own = acc["held"], x["k"] == 3
        kept = F.when(held["e"] > x["s"], nothing).otherwise(held)
        return grown(
            acc, held, own & held.isNotNull(),
            reach=F.when(own, acc["reach"]).otherwise(F.greatest(acc["reach"], x["e"])),
            held=F.when(own, F.when(x["s"] >= acc["reach"], x)).otherwise(kept),
        )

    rest = lambda acc: F.when(acc["held"].isNotNull(), F.array(acc["held"])).otherwise(none())
    every = F.sort_array(F.concat(base, more))
    out = F.aggregate(every, start(reach=F.lit(0), held=nothing), step, lambda acc: F.concat(F.flatten(acc["many"]), acc["few"], rest(acc)))
    return F.when(F.size(more) > 0, out).otherwise(none())


def scan(docs: DataFrame, model: list[int] | None = None, prior: float = PRIOR) -> DataFrame:
    """docs with __base, array<SPAN> in order, and __added, the same for spans of kind markov."""
    model = train(samples(docs)) if model is None else model
    text = F.coalesce("text", F.lit(""))
    every = lambda p, group: F.regexp_extract_all(text, F.lit(p), F.lit(group))
    # columns of their own, so that every text is searched once for each
    out = docs.withColumns({"__m0": every(ASSIGN, 0), "__v0": every(ASSIGN, 2), "__m1": every(ACCESS, 0), "__m2": every(HEX, 0), "__m3": every(TOKEN, 0)})
    spans = {"__s0": found(text, ASSIGN, 0, "__m0", "__v0", 8), "__s1": found(text, ACCESS, 1, "__m1"), "__s2": found(text, HEX, 2, "__m2")}
    more = F.filter(found(text, TOKEN, 3, "__m3"), lambda _, i: llr(F.get("__m3", i), model) > round(UNIT * prior))
    out = out.withColumns(spans | {"__more": F.when(F.size("__m3") > 0, more).otherwise(none())})
    out = out.withColumn("__base", F.sort_array(F.concat("__s0", "__s1", "__s2")))
    return out.withColumn("__added", free("__base", "__more")).select(*docs.columns, "__base", "__added")


def said(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def merged(spans: str) -> Column:
    """array<array<SPAN>>: sorted spans, those that overlap as one, in pieces of STEP."""

    def step(acc: Column, x: Column) -> Column:
        held = acc["held"]
        apart = x["s"] >= held["e"]
        wider = span(held["s"], held["k"], F.greatest(held["e"], x["e"]))
        return grown(acc, held, held.isNotNull() & apart, held=F.when(held.isNull() | apart, x).otherwise(wider))

    last = lambda acc: F.concat(acc["few"], F.array(acc["held"]))
    return F.aggregate(spans, start(held=F.lit(None).cast(SPAN)), step, lambda acc: F.array_append(acc["many"], last(acc)))


def redact(docs: DataFrame, mask: str = "[SECRET]", model: list[int] | None = None) -> DataFrame:
    """docs, with every span of text replaced by mask (overlapping spans by one) and n_chars counted anew where it is a column."""
    out = scan(docs, model).withColumn("__all", F.sort_array(F.concat("__base", "__added")))
    out = out.withColumn("__pieces", F.when(F.size("__all") > 0, merged("__all")))
    end = lambda i: F.coalesce(F.element_at(F.get("__pieces", i), -1)["e"], F.lit(0))
    cuts = F.transform("__pieces", lambda p, i: F.struct(end(i - 1).alias("at"), p.alias("spans"), F.substring(F.col("text"), end(i - 1) + 1, end(i) - end(i - 1)).alias("own")))

    def masked(c: Column) -> Column:
        before = lambda i: F.coalesce(F.get(c["spans"], i - 1)["e"], c["at"])
        return F.array_join(F.transform(c["spans"], lambda x, i: F.concat(F.substring(c["own"], before(i) - c["at"] + 1, x["s"] - before(i)), F.lit(mask))), "")

    tail = F.substring(F.col("text"), end(F.size("__pieces") - 1) + 1, F.length("text"))
    out = out.withColumn("text", F.when(F.size("__all") > 0, F.concat(F.array_join(F.transform(cuts, masked), ""), tail)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("__base", lambda x: x["k"] == k)).cast("long")
    return out.select(
        "doc_id",
        *(n(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(said(F.col("__base")), 256).alias("base_sha256"),
        said(F.sort_array(F.concat("__base", "__added"))).alias("spans"),
        F.size("__added").cast("long").alias("n_markov"),
    )


QUERIES = {"op1_secret_scans": op1_secret_scans}
ORACLES: dict[str, str] = {}
