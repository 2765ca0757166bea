"""Row positions, exact hash cut-offs, exact quantiles and running totals without a one-task sort.

A DataFrame has no row position. Everything here takes an explicit order that ends in a unique key,
and brings to the driver only counts per partition, per hash prefix or per bracket.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoal.functions.columns import col
from shoal.session import materialize

_LOCAL_MASK = (1 << 33) - 1
# Sketches per job: wider aggregates leave whole-stage code generation.
COLUMNS_PER_JOB = 25
# Values that the quantiles of all columns may bring to the driver together.
FETCHED = 1_000_000


def _as_columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def row_index(
    df: DataFrame,
    order_by: Sequence[str | Column],
    index: str = "row_index",
    keys: Sequence[str] = (),
    partitions: int | None = None,
    copies: str | None = None,
) -> DataFrame:
    """Global 0-based position under ``order_by``; with ``keys`` the position inside each key.

    One range shuffle, written once. Rows are numbered inside their range partition and shifted by the
    number of rows in earlier partitions (one collected row per partition). With ``keys`` the rows of each run of
    equal keys are numbered where they were sorted, and only the first run of a partition is shifted, by the rows that
    earlier partitions hold of its key (two collected rows per partition): no key is shuffled or joined again. There
    a row may stand for as many equal ones as its column ``copies`` says, and gets the position of the first.
    """
    spark = df.sparkSession
    order = [*_as_columns(keys), *_as_columns(order_by)]
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    if keys:
        schema = T.StructType([*df.schema.fields, *_PLACE])
        placed = materialize(ranged.select(*df.columns).mapInArrow(_number_runs(list(keys), copies), schema), "index")
        size = (F.col(copies) if copies else F.lit(1)).cast("long").alias("__size")
        ends = placed.where("(__run = 0 AND __loc = 0) OR __last").select(*_PLACE.names, *keys, size).collect()
        shift = spark.createDataFrame(_carried(ends, list(keys)), "__part int, __shift long")
        number = F.col("__loc") + F.when(F.col("__run") == 0, F.col("__shift")).otherwise(0)
        return placed.join(F.broadcast(shift), "__part").select(*df.columns, number.alias(index))
    placed = ranged.withColumn("__mid", F.monotonically_increasing_id()).select(
        *df.columns,
        F.shiftright("__mid", 33).cast("int").alias("__part"),
        F.col("__mid").bitwiseAND(F.lit(_LOCAL_MASK)).alias("__loc"),
    )
    placed = materialize(placed, "index")
    sizes = sorted((r["__part"], r["count"]) for r in placed.groupBy("__part").count().collect())
    offsets, total = [], 0
    for part, size in sizes:
        offsets.append((part, total))
        total += size
    shift = spark.createDataFrame(offsets, "__part int, __shift long")
    out = placed.join(F.broadcast(shift), "__part").withColumn(index, F.col("__loc") + F.col("__shift"))
    return out.select(*df.columns, index)


_PLACE = T.StructType().add("__part", T.IntegerType()).add("__run", T.LongType()).add("__loc", T.LongType()).add("__last", T.BooleanType())


def _number_runs(keys: list[str], copies: str | None = None):
    """Adds to sorted rows: partition, number of the run of equal keys, place in the run, whether it is the last row.

    With ``copies`` a row takes as many places as that column says."""
    def differs(one: pa.Array, two: pa.Array) -> np.ndarray:
        unlike = pc.not_equal(one, two)
        if pa.types.is_floating(one.type):
            unlike = pc.and_not(unlike, pc.and_(pc.is_nan(one), pc.is_nan(two)))
        return pc.if_else(pc.is_null(unlike), pc.xor(pc.is_null(one), pc.is_null(two)), unlike).to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, place, before, held = TaskContext.get().partitionId(), 0, 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for key in keys:
                column = batch[key]
                new[1:] |= differs(column[1:], column[:-1])
                new[0] |= before is not None and bool(differs(column[:1], before[key])[0])
            runs = np.cumsum(new) + number
            size = batch[copies].to_numpy().astype(np.int64) if copies else np.ones(batch.num_rows, np.int64)
            at = np.cumsum(size) - size
            loc = at - np.maximum.accumulate(np.where(new, at, -place))  # a run that goes on began ``place`` rows before
            number, place = int(runs[-1]), int(loc[-1] + size[-1])
            before = {key: batch[key][-1:] for key in keys}
            if held is not None:
                yield held
            last = np.zeros(batch.num_rows, bool)
            held = pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(runs.astype(np.int64)),
                 pa.array(loc.astype(np.int64)), pa.array(last)], [*batch.schema.names, *_PLACE.names])
        if held is not None:
            ends = np.zeros(held.num_rows, bool)
            ends[-1] = True
            yield held.set_column(held.num_columns - 1, "__last", pa.array(ends))
    return run


def _carried(ends: list, keys: list[str]) -> list[tuple[int, int]]:
    """Rows that earlier partitions hold of the first key of each partition."""
    def same(a: tuple, b: tuple | None) -> bool:
        return b is not None and all(x == y or (x != x and y != y) for x, y in zip(a, b))

    shifts, before, rows = [], None, 0
    for _, both in itertools.groupby(sorted(ends, key=lambda r: (r["__part"], r["__run"], r["__loc"])), lambda r: r["__part"]):
        first, *rest = both
        last = rest[-1] if rest else first
        shift = rows if same(tuple(first[k] for k in keys), before) else 0
        shifts.append((first["__part"], shift))
        before = tuple(last[k] for k in keys)
        rows = last["__loc"] + last["__size"] + (shift if last["__run"] == 0 else 0)
    return shifts


def hash_key(seed: int, *keys: str) -> Column:
    """``md5(seed|key...)`` as hex text: a reproducible random order, equal in any engine. A null part is a zero byte."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys]))


def uniform(seed: int, *parts: Column | str) -> Column:
    """A reproducible number in (0, 1): the first 13 digits of ``md5(seed|part...)``, equal in any engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("\0")) for c in _as_columns(parts)])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def standard_normal(seed: int, *parts: Column | str) -> Column:
    """Box-Muller on two hashed uniforms: noise that depends only on seed and row key."""
    radius = F.sqrt(-2.0 * F.log(uniform(seed, F.lit("r"), *_as_columns(parts))))
    return radius * F.cos(2.0 * 3.141592653589793 * uniform(seed, F.lit("a"), *_as_columns(parts)))


def hash_cutoffs(
    df: DataFrame,
    hashed: Column,
    ranks: dict[object, list[int]],
    group: Column | None = None,
    keep: int = 4096,
    ties: bool = False,
) -> dict[object, list]:
    """The hash values that stand at given ranks, so that ``hash < cutoff`` keeps exactly ``rank`` rows.

    Counts per three-digit prefix find the prefix that holds a rank; the same again inside it, until at
    most ``keep`` hashes are left to fetch. Reads only the key columns and shuffles only counts.
    ``ranks`` maps each group (``None`` without ``group``) to its ranks; a rank at or beyond the group's
    size yields ``None`` (no cutoff). With ``ties`` a cutoff is (hash, rows of this very hash that still belong
    below it); without, equal hashes at a cutoff raise.
    """
    base = df.select((group if group is not None else F.lit(None).cast("string")).alias("g"), hashed.alias("h"))
    found: dict[tuple, str | None] = {}
    wanted = {(g, r): ("", r) for g, rs in ranks.items() for r in rs}  # target -> (prefix, rank inside it)
    while wanted:
        length = len(next(iter(wanted.values()))[0])
        counts = _restrict(base, wanted).groupBy("g", F.substring("h", 1, length + 3).alias("p")).count().collect()
        sizes: dict[tuple, list] = {}
        for row in sorted(counts, key=lambda r: r["p"]):
            sizes.setdefault((row["g"], row["p"][:length]), []).append((row["p"], row["count"]))
        narrowed, small = {}, {}
        for target, (prefix, rank) in wanted.items():
            for p, n in sizes.get((target[0], prefix), []):
                if rank < n:
                    (small if n <= keep or length + 3 >= 30 else narrowed)[target] = (p, rank)
                    break
                rank -= n
            else:
                found[target] = None
        if small:
            hashes: dict[tuple, list] = {}
            plen = length + 3
            for row in _restrict(base, small).groupBy("g", "h").count().collect():  # equal keys are one row
                hashes.setdefault((row["g"], row["h"][:plen]), []).append((row["h"], row["count"]))
            for target, (p, rank) in small.items():
                for value, n in sorted(hashes[(target[0], p)]):
                    if rank < n:
                        break
                    rank -= n
                if rank and not ties:
                    raise ValueError("equal keys at a cutoff")
                found[target] = (value, rank) if ties else value
        wanted = narrowed
    return {g: [found[(g, r)] for r in rs] for g, rs in ranks.items()}


def _restrict(base: DataFrame, wanted: dict) -> DataFrame:
    clauses = {(g, p) for (g, _), (p, _) in wanted.items()}
    if any(p == "" for _, p in clauses):
        return base
    test = F.lit(False)
    for g, p in clauses:
        test = test | (F.col("g").eqNullSafe(F.lit(g)) & F.col("h").startswith(p))
    return base.where(test)


def below(hashed: Column, cutoff: str | None) -> Column:
    return F.lit(True) if cutoff is None else hashed < F.lit(cutoff)


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    keep: int = 10_000,
    accuracy: int = 10_000,
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles, exact at any size; NaN counts as missing.

    A sketch brackets each order statistic. One pass over all columns then counts the values between the ends of
    the brackets and brings those of brackets that can hold at most ``keep`` rows (fewer with very many columns, so
    that the driver's share is bounded); wider brackets are sketched again. No rows are shuffled.
    """
    columns = list(columns)
    numbers = df.select(*[
        F.nanvl(col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    share = max(20, min(keep, FETCHED // max(1, len(columns) * len(probabilities))))
    slack = 3.0 / accuracy
    ends = [(max(0.0, p - slack), min(1.0, p + slack)) for p in probabilities]
    points = F.array(*[F.lit(x) for pair in ends for x in pair])
    sizes, brackets = [], {}  # (column, rank) -> (low, high, rows that the bracket was sketched from)
    for part in _parts(range(len(columns)), COLUMNS_PER_JOB):
        row = numbers.agg(*[F.count(f"c{i}").alias(f"n{i}") for i in part], *[
            F.percentile_approx(f"c{i}", points, accuracy).alias(f"s{i}") for i in part]).first()
        for i in part:
            n, sketch = row[f"n{i}"], row[f"s{i}"]
            sizes.append(n)
            for j, p in enumerate(probabilities if n else ()):
                for rank in _neighbours(n, p):
                    brackets[(i, rank)] = (None, None, 0) if n <= share else (sketch[2 * j], sketch[2 * j + 1], n)
    found = _order_statistics(numbers, brackets, share, accuracy)
    out: dict[str, list[float | None]] = {c: [] for c in columns}
    for i, c in enumerate(columns):
        for p in probabilities:
            if not sizes[i]:
                out[c].append(None)
                continue
            low, high = _neighbours(sizes[i], p)
            part = (sizes[i] - 1) * p - low
            out[c].append(found[(i, low)] if part == 0 else found[(i, low)] * (1 - part) + found[(i, high)] * part)
    return out


def _neighbours(n: int, p: float) -> tuple[int, int]:
    """The ranks between which the quantile lies."""
    low = int((n - 1) * p)
    return low, min(low + 1, n - 1)


def _parts(items: Sequence, size: int) -> Iterator[Sequence]:
    for start in range(0, len(items), size):
        yield items[start : start + size]


def _order_statistics(numbers: DataFrame, brackets: dict, share: int, accuracy: int) -> dict[tuple[int, int], float]:
    """Value at each (column, rank).

    The ends of a column's brackets cut its values into zones: 2j lies below the j-th end, 2j + 1 is the end itself.
    """
    found: dict[tuple[int, int], float] = {}
    while brackets:
        edges: dict[int, list[float]] = {}
        for (i, _), (low, high, _) in brackets.items():
            edges.setdefault(i, []).extend(e for e in (low, high) if e is not None)
        edges = {i: sorted(set(e)) for i, e in edges.items()}
        wanted: dict[int, set[int]] = {i: set() for i in edges}
        for (i, _), (low, high, rows) in brackets.items():
            if 8 * rows <= share * accuracy:  # both ends are off by 4 / accuracy at most: slack and the sketch's error
                first = 0 if low is None else 2 * edges[i].index(low) + 2
                last = 2 * len(edges[i]) if high is None else 2 * edges[i].index(high)
                wanted[i].update(range(first, last + 1, 2))
        counts: dict[int, dict[int, int]] = {i: {} for i in edges}
        values: dict[tuple[int, int], list] = {}
        at = list(edges)
        zones = numbers.select(*[f"c{i}" for i in at]).mapInArrow(
            _zone_counts(at, [np.array(edges[i]) for i in at], [sorted(wanted[i]) for i in at]),
            "c int, zone int, v double, n long")
        for i, zone, v, n in zones.groupBy("c", "zone", "v").agg(F.sum("n").alias("n")).collect():
            if v is None:
                counts[i][zone] = n
            else:
                values.setdefault((i, zone), []).append((v, n))
        wide: dict[tuple, list] = {}  # targets in the same zone share its sketch
        for i, rank in brackets:
            before = 0
            for zone in range(2 * len(edges[i]) + 1):
                n = counts[i].get(zone, 0)
                if rank < before + n:
                    break
                before += n
            if zone % 2:
                found[(i, rank)] = edges[i][zone // 2]
            elif zone in wanted[i]:
                for v, n in sorted(values[(i, zone)]):
                    before += n
                    if rank < before:
                        found[(i, rank)] = v
                        break
            else:
                low = edges[i][zone // 2 - 1] if zone else None
                high = edges[i][zone // 2] if zone < 2 * len(edges[i]) else None
                wide.setdefault((i, low, high, n), []).append((rank, (rank - before + 0.5) / n))
        brackets = {}
        for part in _parts([*wide.items()], COLUMNS_PER_JOB):
            brackets |= _narrowed(numbers, part, share, accuracy)
    return found


def _narrowed(numbers: DataFrame, wide: Sequence, share: int, accuracy: int) -> dict:
    """Closer brackets around ranks from a sketch of the values inside the present ones."""
    slack, inner, sketches, out = 3.0 / accuracy, [], [], {}
    some = F.lit(False)
    for k, ((i, low, high, _), ranks) in enumerate(wide):
        inside = F.col(f"c{i}").isNotNull()
        if low is not None:
            inside = inside & (F.col(f"c{i}") > F.lit(low))
        if high is not None:
            inside = inside & (F.col(f"c{i}") < F.lit(high))
        some = some | inside
        points = [F.lit(x) for _, at in ranks for x in (max(0.0, at - slack), min(1.0, at + slack))]
        inner.append(F.when(inside, F.col(f"c{i}")).alias(f"v{k}"))
        sketches.append(F.percentile_approx(f"v{k}", F.array(*points), accuracy).alias(f"s{k}"))
    # a sketch interprets its argument for every row: only rows inside a bracket reach it, with the choice already made
    row = numbers.where(some).select(*inner).agg(*sketches).first()
    for k, ((i, low, high, n), ranks) in enumerate(wide):
        for j, (rank, _) in enumerate(ranks):
            out[(i, rank)] = (low, high, 0) if n <= share else (row[f"s{k}"][2 * j], row[f"s{k}"][2 * j + 1], n)
    return out


def _zone_counts(at: Sequence[int], edges: Sequence[np.ndarray], wanted: Sequence[Sequence[int]]):
    """Rows per column and zone of a task (``v`` null), and the different values of the wanted zones per batch."""

    def rows(i, zone, v, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), i), pa.int32()), pa.array(zone, pa.int32()),
             pa.nulls(len(n), pa.float64()) if v is None else pa.array(v, pa.float64()), pa.array(n, pa.int64())],
            ["c", "zone", "v", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(2 * len(e) + 1, np.int64) for e in edges]
        ends = [np.append(e, np.nan) for e in edges]
        asked = [np.isin(np.arange(2 * len(e) + 1), w) for e, w in zip(edges, wanted)]
        for batch in batches:
            for k, column in enumerate(batch.columns):
                x = column.drop_null().to_numpy(zero_copy_only=False)
                below = np.searchsorted(edges[k], x, "left")
                zone = 2 * below + (ends[k][below] == x)
                totals[k] += np.bincount(zone, minlength=len(totals[k]))
                if wanted[k]:
                    held = asked[k][zone]
                    v, first, n = np.unique(x[held], return_index=True, return_counts=True)
                    if len(v):
                        yield rows(at[k], zone[held][first], v, n)
        for k, total in enumerate(totals):
            zone = np.flatnonzero(total)
            if len(zone):
                yield rows(at[k], zone, None, total[zone])

    return run


def _block_offsets(df: DataFrame, keys: Sequence[str], index: str, sums: dict[str, Column], block: int) -> DataFrame:
    """Sums over all earlier blocks of ``block`` rows of the same key."""
    by = [*keys, "__block"]
    totals = df.groupBy(*keys, F.floor(F.col(index) / block).alias("__block")).agg(
        *[F.sum(e).alias(f"__t_{n}") for n, e in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *by, *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in sums])


def block_totals(
    df: DataFrame, keys: Sequence[str], index: str, running: dict[str, Column],
    sliding: dict[str, Column] | None = None, width: int = 1, block: int = 100_000,
) -> DataFrame:
    """Inclusive running sums and sums over the last ``width`` rows, per key along ``index`` (0-based).

    The rows of a key are cut into blocks, so no task holds a key however many rows it has. A block carries
    the ``width - 1`` rows before it as context for the sliding sums; the running sums get the total of the
    earlier blocks, which are fewer than the rows by the factor ``block``.
    """
    block = max(block, width)
    sliding = sliding or {}
    at = F.col(index)
    mine = F.floor(at / block)
    here = F.struct(mine.alias("b"), F.lit(True).alias("own"))
    ahead = F.struct((mine + 1).alias("b"), F.lit(False).alias("own"))
    places = F.when((at % block > block - width) & F.lit(bool(sliding)), F.array(here, ahead)).otherwise(F.array(here))
    copied = df.withColumn("__place", F.explode(places)).select(
        *df.columns, F.col("__place.b").alias("__block"), F.col("__place.own").alias("__own"))
    inside = Window.partitionBy(*keys, "__block").orderBy(index)
    last, upto = inside.rowsBetween(-(width - 1), 0), inside.rowsBetween(Window.unboundedPreceding, 0)
    local = copied.select(
        "*", *[F.sum(F.when(F.col("__own"), e)).over(upto).alias(f"__l_{n}") for n, e in running.items()],
        *[F.sum(e).over(last).alias(n) for n, e in sliding.items()]).where("__own")
    if not running:
        return local.select(*df.columns, *sliding)
    offsets = _block_offsets(df, keys, index, running, block)
    joined = local.join(offsets, [*keys, "__block"])
    return joined.select(*df.columns, *sliding, *[(F.col(f"__l_{n}") + F.col(f"__b_{n}")).alias(n) for n in running])
