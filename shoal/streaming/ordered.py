"""Rows of a stream in their order: a small machine per key that sees them so, however they arrive."""

from __future__ import annotations

import bisect
import itertools
import operator
import pickle
import zlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Output rows of one data frame.
PIECE = 10_000
#: Fixed value: waiting rows from which on a value of the state store is full. Neighbouring stretches with fewer share one.
TOGETHER = 2000
#: Fixed value, part of every checkpoint: groups of keys of a stream with event time; no more tasks than these work on it.
BUCKETS = 1024
#: Fixed value: machines of a group that are saved together on average. Beyond it their slots are doubled.
FULL = 256


class Machine:
    """What is known of one key. Subclasses hold a few numbers, whatever the number of rows."""

    def load(self, *saved) -> None:
        """Take the state up again that ``dump`` gave."""

    def dump(self) -> tuple:
        raise NotImplementedError

    def feed(self, at: int, *row) -> list[tuple]:
        """The next row in order; what follows from it."""
        raise NotImplementedError

    def until(self, at: int) -> list[tuple]:
        """Time has come to ``at`` without a row; what follows from that."""
        return []

    def due(self) -> int | None:
        """When ``until`` has something to tell, if no row comes."""
        return None

    def end(self) -> list[tuple]:
        """The rows of a batch are over."""
        return []


class InOrder(StatefulProcessor):
    """Buffers rows in map state by stretches of ``width`` and hands them on in the order of their columns.

    Without ``timed`` a group is a key, and the rows of a micro-batch are ordered among themselves; up to ``PIECE`` of them are
    ordered as they are, without a call of the state store. With ``timed`` a group is a bucket of keys, a row's last column is
    its key, and it waits until the watermark has come to its time; a timer at the earliest waiting row, or at the time that a
    machine asks for, wakes the bucket. So the calls of the state store follow the buckets, not the keys. Rows come from the
    iterator piece by piece and are held a few stretches at a time, so memory does not follow a key's rows; of the machines it
    holds the slots that a bucket's rows or timers wake.
    """

    def __init__(self, names: Sequence[str], rows: str, state: str, out: Sequence[str], make: Callable[[], Machine], width: int,
                 timed: bool):
        self.names, self.row_type, self.state_type, self.out = list(names), rows, state, list(out)
        self.make, self.width, self.timed = make, width, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        rows = "binary" if self.timed else f"array<struct<{self.row_type}>>"
        self.waiting = handle.getMapState("waiting", "stretch long, piece long", f"rows {rows}")
        if self.timed:
            self.saved = handle.getMapState("saved", "slot int", f"machines array<struct<{self.state_type}>>")
            self.known = handle.getValueState("known", "pieces long, timer long, due array<long>")
        else:
            self.saved = handle.getValueState("saved", self.state_type)
            self.pieces = handle.getValueState("pieces", "n long")

    def _told(self, key: tuple, found: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        while piece := list(itertools.islice(found, PIECE)):
            yield pd.DataFrame([(*key, *x) for x in piece], columns=self.out, dtype=object)

    def _cells(self, batch: pd.DataFrame) -> list[tuple]:
        return list(zip(*[[None if x != x else x for x in batch[c].tolist()] for c in self.names]))

    def _keep(self, rows: list[tuple], number: int, together: int = TOGETHER) -> int:
        """Buffers rows, which are in the order of their times; the number of the next piece."""
        begin = 0
        while begin < len(rows):
            end = begin + max(1, together)
            if end < len(rows):  # not within a stretch
                end = bisect.bisect_left(rows, (rows[end - 1][0] // self.width + 1) * self.width, lo=end, key=_time)
            held = rows[begin:end]
            self.waiting.updateValue((held[0][0] // self.width, number), (pickle.dumps(held) if self.timed else held,))
            begin, number = end, number + 1
        return number

    def _buffered(self, pieces: Iterator[list[tuple]], number: int) -> tuple[int, int | None]:
        """Buffers pieces of rows; the number of the next one and the earliest time. The more pieces come, the fewer rows of
        each are read at a time."""
        first = None
        for turn, cells in enumerate(pieces, 1):
            cells = sorted(cells, key=_time)
            number = self._keep(cells, number, TOGETHER // turn)
            if cells and (first is None or cells[0][0] < first):
                first = cells[0][0]
        return number, first

    def _taken(self, upto: int | None, rest: list[tuple], ahead: list[tuple]) -> Iterator[list[tuple]]:
        """All waiting rows up to a time, in order, some at a time. Pieces are read as their first stretch comes. ``rest`` gets
        the later rows of these, which wait no more, and ``ahead`` the pieces that are not read."""
        held: list[tuple] = []
        keys = sorted(tuple(k) for k in self.waiting.keys())
        last = len(keys) if upto is None else bisect.bisect_right(keys, upto // self.width, key=_time)
        for stretch, members in itertools.groupby(keys[:last], _time):
            cut = bisect.bisect_left(held, stretch * self.width, key=_time)  # no piece to come has a row before its stretch
            yield held[:cut]
            held = held[cut:]
            for k in members:
                value = self.waiting.getValue(k)[0]
                held += pickle.loads(value) if self.timed else [tuple(r) for r in value]
            held = _in_order(held)
        if last == len(keys):
            self.waiting.clear()
        else:
            for k in keys[:last]:
                self.waiting.removeKey(k)
        cut = len(held) if upto is None else bisect.bisect_right(held, upto, key=_time)
        yield held[:cut]
        rest += held[cut:]
        ahead += keys[last:]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pieces = (self._cells(batch) for batch in rows)
        if self.timed:
            number, timer, due = self.known.get() or (0, None, [])
            number, first = self._buffered(pieces, number)
            if first is not None and (timer is None or first < timer):
                timer = self._wake_at(first, timer)
            self.known.update((number, timer, due))
            return
        few: list[tuple] = []
        for cells in pieces:
            few += cells
            if len(few) > PIECE:
                number, _ = self._buffered(itertools.chain([few], pieces), (self.pieces.get() or (0,))[0])
                self.pieces.update((number,))
                taken = itertools.chain.from_iterable(self._taken(None, [], []))
                break
        else:  # nothing waits from batch to batch: what one frame holds needs no buffer
            taken = iter(_in_order(few))
        machine = self.make()
        if self.saved.exists():
            machine.load(*self.saved.get())
        fed = (x for row in taken for x in (*machine.until(row[0]), *machine.feed(*row)))
        yield from self._told(key, itertools.chain(fed, machine.end()))
        self.saved.update(machine.dump())

    def _wake_at(self, at: int | None, before: int | None) -> int | None:
        if at != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if at is not None:
                self.handle.registerTimer(at)
        return at

    def _load(self, slot: int, machines: dict[object, Machine]) -> None:
        for name, *state in self.saved.getValue((slot,))[0]:
            machines[name] = self.make()
            machines[name].load(*state)

    def _save(self, machines: dict[object, Machine], loaded: set[int], due: list[int | None]) -> list[int | None]:
        """Saves the machines of the loaded slots; when the machines of each slot ask to be woken. Slots that are too full are
        doubled, for which all are loaded."""
        due = list(due) or [None]
        slots = len(due)
        if len(machines) > FULL * len(loaded):
            for slot in set(range(slots)) - loaded:
                self._load(slot, machines)
            while len(machines) > FULL * slots:
                slots *= 2
            loaded, due = set(range(slots)), [None] * slots
        shares: dict[int, list] = {slot: [] for slot in loaded}
        for name, machine in machines.items():
            shares[_slot(name, slots)].append((name, machine))
        for slot, share in shares.items():
            self.saved.updateValue((slot,), ([(name, *machine.dump()) for name, machine in share],))
            due[slot] = min((at for _, machine in share if (at := machine.due()) is not None), default=None)
        return due

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, (number, timer, due) = timerValues.getCurrentWatermarkInMs(), self.known.get()
        if timer == expiredTimerInfo.getExpiryTimeInMs():
            timer = None  # Spark removes a timer that has fired
        rest: list[tuple] = []
        ahead: list[tuple] = []
        machines: dict[object, Machine] = {}
        loaded: set[int] = set()

        def load(slot: int) -> None:
            loaded.add(slot)
            if due:
                self._load(slot, machines)

        def told() -> Iterator[list[tuple]]:
            for rows in self._taken(now, rest, ahead):
                found = []
                for row in rows:
                    name = row[-1]
                    if (machine := machines.get(name)) is None:
                        if (slot := _slot(name, len(due) or 1)) not in loaded:
                            load(slot)
                        machine = machines.setdefault(name, self.make())
                    found += [(name, *x) for x in machine.until(row[0])]
                    found += [(name, *x) for x in machine.feed(*row[:-1])]
                yield found
            for slot, at in enumerate(due):
                if slot not in loaded and at is not None and at <= now:
                    load(slot)
            yield [(name, *x) for name, machine in machines.items() for x in machine.until(now)]

        yield from self._told((), itertools.chain.from_iterable(told()))
        due = self._save(machines, loaded, due) if loaded else due
        times = [k[0] * self.width for k in ahead] + [r[0] for r in rest[:1]] + [at for at in due if at is not None]
        timer = self._wake_at(max(min(times), now + 1) if times else None, timer)
        self.known.update((self._keep(rest, number), timer, due))

    def close(self) -> None:
        pass


def _slot(name: object, slots: int) -> int:
    return zlib.crc32(str(name).encode()) % slots


_time = operator.itemgetter(0)


def _order(row: tuple) -> tuple:
    return tuple((x is not None, x) for x in row)


def _in_order(rows: list[tuple]) -> list[tuple]:
    try:
        return sorted(rows)
    except TypeError:  # nulls come first
        return sorted(rows, key=_order)


def use_rocksdb(spark: SparkSession) -> None:
    """States of ``transformWithState`` need this store; other stateful queries work on it as well."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def in_order(
    stream: DataFrame, key: Column, columns: dict[str, tuple[Column, str]], state: str, out: str, make: Callable[[], Machine],
    width: int, event_time: str | None = None, delay: str = "10 minutes",
) -> DataFrame:
    """What a machine per key tells of the rows of a stream in the order of ``columns`` (name: expression and type).

    The first column is a whole number and gives the order, the others break ties. ``out`` are the columns of the result, the
    key first. With ``event_time`` rows wait until the watermark, ``delay`` behind the latest row, has come to them: the first
    column must then be that time in milliseconds. Rows that come after the watermark are dropped by Spark, which counts them
    (``late_rows``). Without it only the rows of a micro-batch are put in order; keys and times must not be null.
    """
    use_rocksdb(stream.sparkSession)
    names, group = list(columns), "key"
    chosen = [key.alias("key"), *[e.cast(t).alias(n) for n, (e, t) in columns.items()]]
    if event_time:
        stream = stream.withWatermark(event_time, delay)
        names, group, state = [*names, "key"], "bucket", f"{out.split(', ')[0]}, {state}"
        chosen += [F.col(event_time).alias("event_time"), F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")]
    processor = InOrder(names, ", ".join(f"{n}: {t}" for n, (_, t) in columns.items()), state,
                        [x.split()[0] for x in out.split(", ")], make, width, bool(event_time))
    return stream.select(*chosen).groupBy(group).transformWithStateInPandas(
        processor, out, "append", "EventTime" if event_time else "None")


def late_rows(progress: Sequence) -> int:
    """Rows that came after the watermark, from the progress of a query (see ``run_available``)."""
    return sum(op.numRowsDroppedByWatermark for p in progress for op in p.stateOperators)
