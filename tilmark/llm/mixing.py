"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

Targets: sources in code-point order (null last) weigh WEIGHTS, repeating, and share all words by weight; a
target stops at MAX_REPEATS times its source's size and the excess is reshared by weight (water filling).

Blocks: a document's key is a digest of its id and text. The leading hex digits of the key deal a source's documents
into blocks, in an order that has nothing to do with the documents: the blocks are permuted by construction.
A source's stream is its blocks in order, repeated. Its quota is the number of leading blocks of the stream that hold round(target)
words; the last of them, the edge block, is laid out by key and cut at the exact word.

Tree: the quotas are split recursively between halves of the output shards. At every node a multivariate-hypergeometric
draw says how many of each source's blocks go to the left half: source after source, a hypergeometric draw by inversion, with a uniform number that
is a digest of SEED, the node and the source. So every shard gets an exact number of blocks in random composition.
A shard draws its quota of a source from the source's stream after those of the shards before it: draws are disjoint. Words are
taken by shards alone: what no shard draws is not taken. In a shard, draws are ordered by a digest.

Data: one pass over the texts writes (key, source, size); all sums come from that narrow table. What is
collected has one row per source, the unit that weights are given for. Only rows of edge blocks (BLOCK_ROWS per source, or a millionth of the
source) and a source's blocks in two steps of at most 16^3 rows meet in a window. Texts are shuffled only where documents are laid out by shard.

Defined cases: null texts have size 0 and nothing is taken of them; a null source is a source; without words all
targets are 0; repeated rows with equal id and text share one place in the order, in any sequence; very long texts are
documents like others, one of which may be the edge; an empty table gives an empty result; input columns may have any names, but
in mix_documents with named=True columns named mix_shard and mix_order are replaced.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilmark.llm.runtime import written

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BLOCK_ROWS = 16
MAX_DIGITS = 5
SHARDS = 8
SEED = 20240229
SPREAD = 12  # deviations round the mean within which a draw lies
BROADCAST_SOURCES = 10_000
MAX_PARTS = 131_072
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def mix_key(key: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def targets(sizes: list[int], weights: list[int], repeats: int = MAX_REPEATS) -> list[float]:
    """Water filling: min(weight * level, repeats * size) with the level at which all words are shared."""
    total = sum(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (repeats * sizes[i] / weights[i], i))
    capped, weight, level = 0, sum(weights), 0.0
    for i in order:
        level = (total - capped) / weight
        if level <= repeats * sizes[i] / weights[i]:
            break
        capped += repeats * sizes[i]
        weight -= weights[i]
    return [min(w * level, float(repeats * s)) for s, w in zip(sizes, weights, strict=True)]


def uniform(seed: int, node: int, source: int) -> float:
    """A number in [0, 1): 52 bits of a digest."""
    return int(hashlib.md5(f"{seed}:{node}:{source}".encode()).hexdigest()[:13], 16) / 2**52


def draw_range(own: int, everything: int, wanted: int) -> tuple[int, int]:
    """First and last number of own items that a draw of `wanted` of `everything` is looked for in."""
    mean = wanted * own / everything
    reach = SPREAD * math.sqrt(wanted * own / everything + 1)
    return max(0, wanted - (everything - own), math.floor(mean - reach)), min(own, wanted, math.ceil(mean + reach))


def hypergeometric(u: float, own: int, everything: int, wanted: int) -> int:
    """How many of `own` items are among `wanted` that are drawn from `everything`: the smallest number whose cumulated
    probability reaches u. Any sizes; work grows with the root of the mean."""
    if not own or not wanted:
        return 0
    low, high = draw_range(own, everything, wanted)
    k, rest = np.arange(low, high, dtype=np.float64), everything - own
    steps = np.log((own - k) * (wanted - k)) - np.log((k + 1) * (rest - wanted + k + 1))  # from each probability to the next
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    upto = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.count_nonzero(upto < u * upto[-1]))


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """quotas[s] blocks of each source over shards: an array (source, shard) whose rows sum to the quotas and whose
    columns are equal to within one, drawn by recursive halving. Nodes are numbered 1, then 2n and 2n + 1 below n."""
    total = sum(quotas)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    out = np.zeros((len(quotas), shards), np.int64)

    def split(node: int, own: list[int], a: int, b: int) -> None:
        if b - a == 1:
            out[:, a] = own
            return
        middle = (a + b) // 2
        want, rest = sum(room[a:middle]), sum(own)
        left = []
        for s, q in enumerate(own):
            left.append(hypergeometric(uniform(seed, node, s), q, rest, want))
            rest -= q
            want -= left[-1]
        split(2 * node, left, a, middle)
        split(2 * node + 1, [q - x for q, x in zip(own, left, strict=True)], middle, b)

    split(1, list(quotas), 0, shards)
    return out


PLAN = "__of string, __total long, __target double, __digits int, __whole long, __rest long, __edge long, __before long, __upto array<long>"


@dataclass
class Mix:
    """The plan of one mix. sources has a row per source: its words, target, hex digits of a block, whole rounds, words
    of the last round, edge block, words before that, and how many blocks of its stream go to the shards up to each."""

    sources: DataFrame
    narrow: DataFrame
    small: bool
    shards: int
    bytes: int

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows with __source, __size and __key get their source's plan and their block."""
        plan = F.broadcast(self.sources) if self.small else self.sources
        joined = rows.join(plan, rows["__source"].eqNullSafe(plan["__of"]), "inner").drop("__of")
        block = F.when(F.col("__digits") == 0, F.lit(0)).otherwise(F.conv(F.expr("substr(__key, 1, __digits)"), 16, 10).cast("long"))
        return joined.withColumn("__block", block.cast("long"))

    def drawn(self, rows: DataFrame) -> DataFrame:
        """rows (with __source, __size, __key) plus the plan's columns, __draws: for each shard the rounds of the stream in which it draws the
        row's block and the words that it takes then, and __taken, the sum of these words."""
        placed = self.placed(rows)
        before = Window.partitionBy("__source").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
        start = F.col("__before") + F.coalesce(F.sum("__size").over(before), F.lit(0))
        part = F.greatest(F.lit(0), F.least(F.col("__size"), F.col("__rest") - start))
        at_edge = F.col("__block") == F.col("__edge")
        inner = placed.filter(~at_edge).withColumn("__part", F.lit(0).cast("long"))
        both = inner.unionByName(placed.filter(at_edge).withColumn("__part", part))
        blocks = F.pow(F.lit(16), F.col("__digits")).cast("long")
        rounds = F.filter(F.sequence(F.lit(0).cast("long"), F.col("__whole")), lambda e: e * blocks + F.col("__block") < F.get("__upto", F.lit(self.shards - 1)))
        words = lambda e: F.when((e < F.col("__whole")) | (F.col("__block") < F.col("__edge")), F.col("__size")).otherwise(F.col("__part"))
        shard = lambda e: F.size(F.filter("__upto", lambda upto: upto <= e * blocks + F.col("__block")))
        draws = F.transform(rounds, lambda e: F.struct(e.alias("round"), shard(e).alias("shard"), words(e).alias("words")))
        with_draws = both.withColumn("__draws", draws)
        return with_draws.withColumn("__taken", F.aggregate("__draws", F.lit(0).cast("long"), lambda total, d: total + d["words"]))


def plan_mix(texts: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> Mix:
    spark = texts.sparkSession
    own = texts.select(F.col(key).alias("__id"), F.col(source).alias("__source"), F.col(text).alias("__text"))
    sizes_of = {"__size": word_count(F.col("__text")), "__key": mix_key(F.col("__id"), F.col("__text")), "__bytes": F.coalesce(F.octet_length("__text"), F.lit(0)).cast("long")}
    narrow = written(own.withColumns(sizes_of).drop("__text"), "mix")
    stats = narrow.groupBy("__source").agg(F.sum("__size").alias("size"), F.count("*").alias("rows"), F.sum("__bytes").alias("bytes")).collect()
    total = sum(r["bytes"] for r in stats)
    stats.sort(key=lambda r: (r["__source"] is None, r["__source"] or ""))
    sizes = [r["size"] for r in stats]
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(stats))])
    rows = []
    for r, goal in zip(stats, goals, strict=True):
        quota = math.floor(goal + 0.5)
        digits = next(d for d in range(MAX_DIGITS + 1) if d == MAX_DIGITS or BLOCK_ROWS * 16**d >= r["rows"])
        whole = quota // r["size"] if r["size"] else 0
        rows.append((r["__source"], r["size"], goal, digits, whole, quota - whole * r["size"]))
    small = len(rows) <= BROADCAST_SOURCES
    first = Mix(spark.createDataFrame(rows, PLAN.split(", __edge")[0]), narrow, small, shards, total)
    found = {r["__source"]: (r["__block"], r["before"]) for r in _edges(first.placed(narrow)).collect()}
    edge = [found.get(r[0], (0, 0)) for r in rows]
    blocks = [r[4] * 16 ** r[3] + (e[0] + 1 if r[5] else 0) for r, e in zip(rows, edge, strict=True)]
    split = np.cumsum(split_quotas(blocks, shards, seed), axis=1) if rows else np.zeros((0, shards), np.int64)
    full = [(*r, *e, split[i].tolist()) for i, (r, e) in enumerate(zip(rows, edge, strict=True))]
    return Mix(spark.createDataFrame(full, PLAN), narrow, small, shards, total)


def _edges(placed: DataFrame) -> DataFrame:
    """(__source, __block, before): the block of the last round in which a source's words reach __rest, and the words before it. Groups of blocks
    are summed first, so that no window holds all blocks of a source."""
    own = placed.filter("__rest > 0").withColumn("__group", F.floor(F.col("__block") / 16 ** (MAX_DIGITS // 2)))
    sums = written(own.groupBy("__source", "__group", "__block", "__rest").agg(F.sum("__size").alias("words")), "blocks")

    def reached(rows: DataFrame, order: str) -> DataFrame:
        running = Window.partitionBy("__source").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = rows.withColumn("upto", F.sum("words").over(running)).filter(F.col("upto") >= F.col("__rest"))
        return upto.groupBy("__source").agg(F.min(F.struct(order, "words", "upto")).alias("e")).select("__source", f"e.{order}", (F.col("e.upto") - F.col("e.words")).alias("before"))

    group = reached(sums.groupBy("__source", "__group", "__rest").agg(F.sum("words").alias("words")), "__group")
    named = group.select(F.col("__source").alias("of"), F.col("__group").alias("g"), F.col("before").alias("earlier"))
    inside = sums.join(named, sums["__source"].eqNullSafe(named["of"]) & (sums["__group"] == named["g"]))
    within = inside.withColumn("__rest", F.col("__rest") - F.col("earlier"))
    last = reached(within, "__block")
    return last.join(named, last["__source"].eqNullSafe(named["of"])).select("__source", "__block", (F.col("before") + F.col("earlier")).alias("before"))


def mix_words(texts: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per input row: the key, size, source_size, target of its source, taken words, and by_shard: the words that each
    shard draws, whose sum taken is."""
    mix = plan_mix(texts, key, text, source, shards, seed=seed)
    drawn = mix.drawn(mix.narrow)
    words = lambda j: F.aggregate("__draws", F.lit(0).cast("long"), lambda total, d: total + F.when(d["shard"] == j, d["words"]).otherwise(0))
    by_shard = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), words)
    named = {"__id": key, "__size": "size", "__total": "source_size", "__target": "target", "__taken": "taken"}
    return drawn.select(*[F.col(c).alias(n) for c, n in named.items()], by_shard.alias("by_shard"))


def mix_documents(texts: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, named: bool = True, seed: int = SEED) -> DataFrame:
    """The drawn documents, all input columns, laid out by shard and in a shard by the local order: each as often as shards draw
    it whole, the cut one if at least half of it is drawn. With named=True also mix_shard and mix_order."""
    columns = texts.columns
    held = texts.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"))
    field = lambda c: F.col("__row").getField(c)
    mix = plan_mix(texts, key, text, source, shards, seed=seed)
    ready = held.withColumns({"__source": field(source), "__size": word_count(field(text)), "__key": mix_key(field(key), field(text))})
    each = mix.drawn(ready).select("__row", "__size", "__key", F.explode("__draws").alias("__draw"))
    each = each.filter((F.col("__draw.words") > 0) & (2 * F.col("__draw.words") >= F.col("__size")))
    order = F.md5(F.concat(F.col("__key"), F.lit(":"), F.col("__draw.round").cast("string")))
    each = each.select("__row", F.col("__draw.shard").alias("mix_shard"), order.alias("mix_order"))
    laid = by_local_order(each, shards, max(1, min(MAX_PARTS, mix.bytes // part_bytes(texts.sparkSession)) // shards))
    kept = [field(c).alias(c) for c in columns if not named or c not in ("mix_shard", "mix_order")]
    return laid.select(*kept, *(["mix_shard", "mix_order"] if named else []))


def part_bytes(spark: SparkSession) -> int:
    """Bytes of text in a partition of a shard: what the session advises for a shuffle partition."""
    advised = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
    return max(1, spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(advised))


def by_local_order(rows: DataFrame, shards: int, parts: int) -> DataFrame:
    """rows with mix_shard and mix_order in shards * parts partitions: each is one range of one shard's order,
    sorted. The order is a digest, so ranges of it are even."""
    part = F.floor(F.conv(F.substring("mix_order", 1, 8), 16, 10).cast("long") * parts / F.lit(1 << 32)).cast("int")
    dealt = rows.withColumn("__part", F.col("mix_shard").cast("int") * parts + part).repartitionById(shards * parts, "__part")
    return dealt.sortWithinPartitions("mix_shard", "mix_order").drop("__part")
