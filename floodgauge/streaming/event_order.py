"""Keyed state machines that see the rows of a key in event-time order, in whatever order they arrive.

Rows wait in the key's state until the watermark has passed them; no earlier row can be accepted from then on, so they are sorted and handed to the
machine. A timer at the earliest waiting row, or at the machine's own due time, wakes a key that gets no more rows. So the result does not depend on how the input is
cut into micro-batches. Rows that are not newer than the watermark of the micro-batch before are late; Spark drops and counts them. Rows newer than the last
watermark are still waiting when a stream ends.

Keys are dealt by hash over ``BUCKETS`` states, as calling Python for a state costs far more than the few rows that a key of many has in a micro-batch. A state holds, for all its keys, the
rows of the allowed lateness and what the machine keeps; it is written anew when any of its keys gets rows or is due. All rows of a key in a micro-batch pass through one
task, which holds them as columns of plain numbers and codes of repeated values, and its state compressed, as Spark hands the state on anew with every batch of rows. They are sorted by time in
parts of ``PART`` and put in order by ranges of time, of about ``RANGE`` rows; they reach the machine, and its output leaves, in slices of ``SLICE``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from itertools import chain
from typing import Any, NamedTuple, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "held binary"
SLICE, RANGE, PART, BUCKETS = 10_000, 50_000, 100_000, 512
Columns = dict[str, np.ndarray]


class Coded(NamedTuple):
    """A column of objects that repeat; code -1 is a missing value."""

    codes: np.ndarray
    values: np.ndarray


Part = dict[str, np.ndarray | Coded]


class Machine(Protocol):
    """``kept`` is what the machine remembers of a key: a value of plain Python, or None. Output is columns by name, as arrays or lists, or None."""

    def step(self, key: tuple, kept: Any, rows: Columns) -> tuple[Any, dict | None]:
        """Takes the next rows of the key, in order; they may be some of those that are ready."""

    def due(self, kept: Any) -> int | None:
        """Microsecond after which ``expire`` has something to do without further rows."""

    def expire(self, key: tuple, kept: Any, now: int) -> tuple[Any, dict | None]:
        """Called once every row up to ``now`` has been seen and ``due`` is not later."""


def micros(times: np.ndarray) -> np.ndarray:
    return times.astype("datetime64[us]").astype(np.int64)


def _coded(column: np.ndarray) -> np.ndarray | Coded:
    if column.dtype != object:
        return column
    try:
        codes, values = pd.factorize(column)
    except TypeError:  # lists and the like
        return column
    return Coded(codes.astype(np.min_scalar_type(-max(1, len(values)))), values) if 2 * len(values) <= len(column) else column


def _plain_column(column: np.ndarray | Coded, a: int = 0, b: int | None = None) -> np.ndarray:
    return np.concatenate([column.values, np.array([None], object)])[column.codes[a:b]] if isinstance(column, Coded) else column[a:b]


def _part(columns: list[Columns | Part], ts: str, begins: list[int]) -> Part:
    """The rows of all, from these places on, by time. The columns are taken out of where they come from, one after the other."""
    joined = lambda c: np.concatenate([_plain_column(p.pop(c), a) for p, a in zip(columns, begins)])
    names = [c for c in columns[0] if c != ts]
    times = joined(ts)
    order = np.argsort(micros(times), kind="stable")
    return {ts: times[order]} | {c: _coded(joined(c)[order]) for c in names}


def _ranges(parts: list[Part], ts: str, now: int) -> Iterator[Columns | list[int]]:
    """The rows up to ``now`` by ranges of time; last, for each part, the place where the others begin."""
    sample = np.sort(np.concatenate([(m := micros(p[ts][::100]))[m <= now] for p in parts]))
    # Rows of the same moment stay together.
    cuts = [*np.unique(sample[:: max(1, RANGE // 100)][1:]).tolist(), now]
    places = [[0, *np.searchsorted(micros(p[ts]), cuts, "right").tolist()] for p in parts]
    for k in range(len(cuts)):
        chosen = [(p, at[k], at[k + 1]) for p, at in zip(parts, places) if at[k + 1] > at[k]]
        if chosen:
            yield {c: np.concatenate([_plain_column(p[c], a, b) for p, a, b in chosen]) for c in parts[0]}
    yield [at[-1] for at in places]


def _parts(blocks: Iterator[pd.DataFrame], ts: str) -> Iterator[Part]:
    held, size = [], 0
    for b in blocks:
        if len(b):
            # Columns may be views of what Spark has read, the state at its side included; copies let go of it.
            held.append({c: b[c].to_numpy(copy=True) for c in b.columns if c != "_bucket"})
            size += len(b)
            if size >= PART:
                yield _part(held, ts, [0] * len(held))
                held, size = [], 0
    if held:
        yield _part(held, ts, [0] * len(held))


def _squeezed(value: Any) -> tuple[int, bytes]:
    plain = pickle.dumps(value, protocol=5)
    return len(plain), pa.compress(plain, codec="zstd", asbytes=True)


def _unsqueezed(size: int, squeezed: bytes) -> Any:
    return pickle.loads(pa.decompress(squeezed, decompressed_size=size, codec="zstd"))


def _dumped(kept: dict, rest: Part) -> bytes:
    """The columns are taken out of ``rest``, one after the other."""
    return pickle.dumps((_squeezed(kept), {c: _squeezed(rest.pop(c)) for c in list(rest)}), protocol=5)


def _loaded(held: bytes) -> tuple[dict, Part]:
    kept, rest = pickle.loads(held)
    return _unsqueezed(*kept), {c: _unsqueezed(*v) for c, v in rest.items()}


def _sorted(keys: list[np.ndarray]) -> np.ndarray:
    """Places in the order of the keys, missing values last."""
    if any(k.dtype == object for k in keys):
        return pd.DataFrame(dict(enumerate(keys))).sort_values(list(range(len(keys))), kind="stable").index.to_numpy()
    return np.lexsort(keys[::-1])


def _by_key(columns: list[np.ndarray]) -> np.ndarray:
    """Numbers that are the same where the keys are; a missing value is a key."""
    found = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        part, seen = pd.factorize(c, use_na_sentinel=False)
        found = pd.factorize(found * len(seen) + part)[0]
    return found


def _table(found: list[dict]) -> pd.DataFrame:
    whole = {}
    for c in found[0]:
        pieces = [f[c] for f in found]
        whole[c] = np.concatenate(pieces) if all(isinstance(p, np.ndarray) for p in pieces) else list(chain.from_iterable(pieces))
    return pd.DataFrame(whole)


def _plain(value: Any) -> Any:
    value = value.item() if isinstance(value, np.generic) else value
    return None if value != value else value


def _stepped(machine: Machine, keys: Sequence[str], ts: str, order: Sequence[str], kept: dict, rows: Columns, now: int) -> Iterator[dict | None]:
    """Output of the ready rows; ``kept`` is brought up to date."""
    moment = micros(rows[ts])
    ready = np.flatnonzero(moment <= now)
    group = _by_key([rows[c][ready] for c in keys])
    place = _sorted([group, moment[ready], *(rows[c][ready] for c in order)])
    ready, group = ready[place], group[place]
    ends = np.flatnonzero(np.diff(group, append=-1)) + 1
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
        key = tuple(_plain(rows[c][ready[a]]) for c in keys)
        for low in range(a, b, SLICE):
            these = ready[low : min(low + SLICE, b)]
            kept[key], out = machine.step(key, kept.get(key), {c: v[these] for c, v in rows.items()})
            yield out


def _found(machine: Machine, keys: Sequence[str], ts: str, order: Sequence[str], kept: dict, rows: Columns | None, now: int) -> Iterator[dict | None]:
    """Output of the ready rows and of what is due; ``kept`` is brought up to date."""
    if rows is not None:
        yield from _stepped(machine, keys, ts, order, kept, rows, now)
    for key, value in list(kept.items()):
        due = machine.due(value) if value is not None else None
        if due is not None and due <= now:
            value, out = machine.expire(key, value, now)
            yield out
        if value is None:
            del kept[key]
        else:
            kept[key] = value


def _update(machine: Machine, keys: Sequence[str], ts: str, order: Sequence[str]):
    def run(bucket: Any, blocks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, rest = _loaded(state.get[0]) if state.exists else ({}, {})
        parts, begins = [rest] if rest else [], []
        rest = {}
        if not state.hasTimedOut:
            parts += _parts(blocks, ts)
        now = max(0, state.getCurrentWatermarkMs()) * 1000

        def found() -> Iterator[dict | None]:
            for rows in _ranges(parts, ts, now) if parts else ():
                if isinstance(rows, dict):
                    yield from _stepped(machine, keys, ts, order, kept, rows, now)
                else:
                    begins.extend(rows)
            yield from _found(machine, keys, ts, order, kept, None, now)

        held, size = [], 0
        for out in found():
            if out is not None:
                held.append(out)
                size += len(next(iter(out.values())))
                if size >= SLICE:
                    yield _table(held)
                    held, size = [], 0
        if size:
            yield _table(held)
        later = [(p, a) for p, a in zip(parts, begins) if a < len(p[ts])]
        parts.clear()
        if later:
            rest = _part([p for p, _ in later], ts, [a for _, a in later])
        later.clear()
        times = [t for t in map(machine.due, kept.values()) if t is not None]
        if rest:
            times.append(int(micros(rest[ts][:1])[0]))
        if not kept and not times:
            if state.exists:
                state.remove()
            return
        state.update((_dumped(kept, rest),))
        if times:
            state.setTimeoutTimestamp(max(min(times) // 1000, now // 1000 + 1))

    return run


def in_event_order(rows: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], machine: Machine, output: str, buckets: int = BUCKETS) -> DataFrame:
    """Output of the machine over the rows of each key; ``rows`` has a watermark on ``ts``, and ``order`` sorts rows of the same instant."""
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    return dealt.groupBy("_bucket").applyInPandasWithState(_update(machine, list(keys), ts, list(order)), output, STATE, "append", GroupStateTimeout.EventTimeTimeout)
