"""A uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one block, the unit whose counts per shard are drawn and whose rows are permuted together.
BLOCK = 1 << 16
#: Rows of one page, the unit of a shard that one task permutes; small tables have more and smaller pages.
PAGE = 1 << 14
_LOCAL = 33  # bits of a row's place in monotonically_increasing_id


def hypergeometric(u: float, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` drawn without replacement are good: the ``u``-quantile of the law, counted outward from
    its mode. Takes about as many steps as the standard deviation, whatever the size of the numbers."""
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)

    def choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    up = down = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    above = below = mode
    u -= up
    while u >= 0 and (above < high or below > low) and up + down > 1e-25:
        if above < high:
            up *= (good - above) * (draws - above) / ((above + 1) * (bad - draws + above + 1))
            above += 1
            u -= up
            if u < 0:
                return above
        else:
            up = 0.0
        if below > low:
            down *= below * (bad - draws + below) / ((good - below + 1) * (draws - below + 1))
            below -= 1
            u -= down
            if u < 0:
                return below
        else:
            down = 0.0
    return mode


class Matrix:
    """How many rows of each block go to each shard: a multivariate hypergeometric law with the rows of the blocks and the
    sizes of the shards as margins.

    The blocks are halved again and again; every half draws its part of each shard with a generator of its own, so that any
    task computes the row of a block, the same one, from the sizes of the blocks alone.
    """

    def __init__(self, sizes: list[int], shards: int, seed: int):
        self.before = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])
        total = int(self.before[-1])
        self.shards = [total // shards + (k < total % shards) for k in range(shards)]
        self.seed = seed
        self.left = functools.lru_cache(1 << 16)(self._left)

    def _left(self, low: int, high: int, have: tuple[int, ...]) -> tuple[int, ...]:
        """What the first half of the blocks ``low`` to ``high`` takes of ``have``."""
        draws = int(self.before[(low + high) // 2] - self.before[low])
        rest, out = sum(have), []
        uniform = np.random.default_rng([self.seed, 0, low, high]).random(len(have))
        for u, good in zip(uniform.tolist(), have):
            rest -= good
            out.append(hypergeometric(u, good, rest, draws))
            draws -= out[-1]
        return tuple(out)

    def row(self, block: int) -> tuple[int, ...]:
        low, high, have = 0, len(self.before) - 1, tuple(self.shards)
        while high - low > 1:
            left, middle = self.left(low, high, have), (low + high) // 2
            if block < middle:
                high, have = middle, left
            else:
                low, have = middle, tuple(h - x for h, x in zip(have, left))
        return have


class Labels:
    """Shard and rank of every row, block by block. The rank orders the rows of a shard."""

    def __init__(self, blocks: np.ndarray, sizes: np.ndarray, shards: int, seed: int):
        order = np.argsort(blocks)
        self.blocks, self.sizes, self.seed = blocks[order], sizes[order], seed
        self.matrix = Matrix(self.sizes.tolist(), shards, seed)
        self.block = functools.lru_cache(8)(self._block)

    def __reduce__(self):
        return Labels, (self.blocks, self.sizes, len(self.matrix.shards), self.seed)

    def _block(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        counts = self.matrix.row(at)
        labels = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        ranks = np.random.default_rng([self.seed, 2, at]).integers(0, 1 << 62, len(labels), np.int64)
        return np.random.default_rng([self.seed, 1, at]).permutation(labels), ranks

    def __call__(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shard, rank = np.zeros(len(places), np.int32), np.zeros(len(places), np.int64)
        block, local = places // BLOCK, places % BLOCK
        for one in np.unique(block).tolist():
            at = int(np.searchsorted(self.blocks, one))
            mine = block == one
            if at == len(self.blocks) or self.blocks[at] != one or local[mine].max() >= self.sizes[at]:
                raise ValueError("the table gave other partitions when it was read again: write it first")
            labels, ranks = self.block(at)
            shard[mine], rank[mine] = labels[local[mine]], ranks[local[mine]]
        return shard, rank


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 0) -> DataFrame:
    """Writes the rows, with all their columns, ``shard`` and ``slot``, in one folder per shard; gives the table back.

    A uniformly random order of all rows, cut into shards whose sizes differ by at most one. The rows of each partition
    are counted first (only counts per block of 65 536 rows reach the driver and the tasks: 16 bytes a block). Each
    block draws how many of its rows go to each shard (``Matrix``) and deals these numbers out by a random permutation of
    its own rows. The rows are exchanged by shard and page, a page being an equal stretch of the random 64-bit ranks
    that the rows bring along; one task permutes a page locally, by rank, and its slots begin after those of earlier
    pages. How many pages there are does not change a row's slot. All draws follow from ``seed`` and places in partitions, so that
    a lost task gives the same rows again; a table that is dealt to partitions anew when it is read again is refused.

    Nulls, empty and repeated rows, equal or null ids are rows like any other; equal texts are not kept together (with
    counts at most one apart they cannot be). An empty table gives no rows. Columns named ``shard`` or ``slot`` are replaced.
    """
    spark = docs.sparkSession
    place = F.monotonically_increasing_id().alias("__place")
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    counted = docs.select(place).groupBy(F.shiftright("__place", 16).alias("block")).count().toPandas()
    labels = Labels(counted["block"].to_numpy(np.int64), counted["count"].to_numpy(np.int64), shards, seed)
    largest = max(labels.matrix.shards)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pages = max(-(-largest // PAGE), -(-tasks // shards))
    shared = spark.sparkContext.broadcast(labels)

    def dealer(begins: Broadcast | None):
        @F.pandas_udf("shard int, page int, rank long, begin long")
        def deal(places: pd.Series) -> pd.DataFrame:
            shard, rank = shared.value(places.to_numpy(np.int64))
            page = (rank >> 31) * pages >> 31
            return pd.DataFrame({"shard": shard, "page": page.astype(np.int32), "rank": rank,
                                 "begin": begins.value[shard, page] if begins else 0})
        return deal("__place").alias("__to")

    told = docs.select(place).select(dealer(None)).groupBy("__to.shard", "__to.page").count().toPandas()
    offsets = np.zeros((shards, pages + 1), np.int64)
    offsets[told["shard"].to_numpy(np.int64), told["page"].to_numpy(np.int64) + 1] = told["count"]
    offsets = np.cumsum(offsets, axis=1)
    if offsets[:, -1].tolist() != labels.matrix.shards:
        raise ValueError("the table gave other rows when it was read again: write it first")
    rows = docs.select(*kept, place).select("*", dealer(spark.sparkContext.broadcast(offsets)))
    shard, page, begin = (F.col(f"__to.{c}") for c in ("shard", "page", "begin"))
    rows = rows.repartitionById(shards * pages, shard * pages + page).sortWithinPartitions("__to.rank", "__place")
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _LOCAL) - 1))
    rows = rows.select(*kept, shard.alias("shard"), (begin + number).alias("slot"))
    rows.write.partitionBy("shard").parquet(path)
    return spark.read.schema(rows.select(*kept, "slot", "shard").schema).parquet(path)
