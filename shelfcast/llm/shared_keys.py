"""How many keys of each set occur in no other set: a lossless first filter of similarity joins.

All keys of all sets are dealt out by hash range, but packed: one row carries, for a run of sets and one hash
range, the keys as 32-bit numbers (the range is the rest of the key). Keys that several sets of a run hold are
sent once, so a key in a third of all sets costs one number per run. Two different keys that look alike only
make a set look less unique, never more; so does a run that a repeated task cuts differently.

A run is named by a hash of its ids, its partition and its place in it: runs whose ids or sums agree stay apart, and a
repeated task gives its runs the same names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from shelfcast.llm.words import mix

RUN_KEYS = 1_500_000  # keys packed together by a task
RUN_SETS = 60_000  # sets are numbered in 16 bits
RANGE_KEYS = 6_000_000  # keys per hash range, on average

_PACKED = "range int, run long, ids binary, sizes binary, sets binary, counts binary, keys binary, common binary"

SetsOf = Callable[[pa.RecordBatch], Iterator[tuple[int | None, np.ndarray]]]


def run_number(ids: np.ndarray, partition: int, place: int) -> int:
    """Name of the run of sets ``ids`` that is the ``place``-th of its partition."""
    text = np.array([partition, place], np.int64).tobytes() + ids.tobytes()
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _pack(run: list[tuple[int, np.ndarray]], ranges: int, place: int) -> pa.RecordBatch:
    ids = np.array([i for i, _ in run], np.int64)
    sizes = np.array([len(k) for _, k in run], np.int64)
    keys = np.concatenate([k for _, k in run]) if run else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(run), dtype=np.uint16), sizes)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[1:] == keys[:-1]
    common = keys[same[1:] & ~same[:-1]]  # the first of several
    alone = ~same[1:] & ~same[:-1]
    keys, owner = keys[alone], owner[alone]
    context = TaskContext.get()
    number = run_number(ids, context.partitionId() if context else 0, place)

    def range_of(values: np.ndarray) -> np.ndarray:
        return (((values >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)

    def low(values: np.ndarray) -> bytes:
        return (mix(values) >> np.uint64(32)).astype(np.uint32).tobytes()

    places, common_places = range_of(keys), range_of(common)
    rows: list[tuple] = []
    for r in np.unique(np.concatenate([np.zeros(1, np.int64), places, common_places])).tolist():
        a, b = np.searchsorted(places, [r, r + 1])
        by_set = np.argsort(owner[a:b], kind="stable")
        sets, counts = np.unique(owner[a:b], return_counts=True)
        shared = common[slice(*np.searchsorted(common_places, [r, r + 1]))]
        head = (ids.tobytes(), sizes.astype(np.uint32).tobytes()) if r == 0 else (b"", b"")
        rows.append(
            (r, number, *head, sets.tobytes(), counts.astype(np.uint32).tobytes(), low(keys[a:b][by_set]), low(shared))
        )
    names = [c.split()[0] for c in _PACKED.split(", ")]
    types = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names)


def _packer(sets_of: SetsOf, ranges: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[tuple[int, np.ndarray]] = []
        keys = place = 0
        for batch in batches:
            for set_id, values in sets_of(batch):
                if set_id is None or not len(values):
                    continue
                run.append((set_id, values))
                keys += len(values)
                if keys >= RUN_KEYS or len(run) >= RUN_SETS:
                    yield _pack(run, ranges, place)
                    run, keys, place = [], 0, place + 1
        if run:
            yield _pack(run, ranges, place)

    return pack


def _count_range(table: pa.Table) -> pa.Table:
    """Of one hash range: per run and set, the keys that no other set has."""
    columns = {c: table.column(c).to_pylist() for c in ("counts", "keys", "common")}
    own = [np.frombuffer(b, np.uint32) for b in columns["keys"]]
    shared = [np.frombuffer(b, np.uint32) for b in columns["common"]]
    every = np.sort(np.concatenate([*own, *shared, *shared]))  # a shared key counts twice
    first = np.r_[True, every[1:] != every[:-1]]
    single = every[first & np.r_[first[1:], True]]
    unique = []
    for keys, counts in zip(own, columns["counts"]):
        place = np.minimum(np.searchsorted(single, keys), max(len(single) - 1, 0))
        hit = single[place] == keys if len(single) else np.zeros(len(keys), bool)
        ends = np.cumsum(np.frombuffer(counts, np.uint32).astype(np.int64))
        total = np.r_[0, np.cumsum(hit)]
        unique.append((total[ends] - total[np.r_[0, ends[:-1]]] if len(ends) else np.zeros(0)).astype(np.uint32).tobytes())
    return table.select(["run", "ids", "sizes", "sets"]).append_column("unique", pa.array(unique, pa.binary()))


def _sum_run(table: pa.Table) -> pa.Table:
    rows = list(zip(*(table.column(c).to_pylist() for c in ("ids", "sizes", "sets", "unique"))))
    ids = np.concatenate([np.frombuffer(row[0], np.int64) for row in rows])
    sizes = np.concatenate([np.frombuffer(row[1], np.uint32) for row in rows])
    total = np.zeros(len(ids), np.int64)
    for _, _, sets, unique in rows:
        if len(ids):
            total[np.frombuffer(sets, np.uint16)] += np.frombuffer(unique, np.uint32)
    return pa.table({"id": ids, "size": sizes.astype(np.int64), "n_unique": total})


def unique_key_counts(frame: DataFrame, sets_of: SetsOf, n_keys: int) -> DataFrame:
    """(id, size, n_unique) of every non-empty set with an id; ``n_keys`` is about the number of all keys."""
    ranges = max(1, -(-n_keys // RANGE_KEYS))
    packed = frame.mapInArrow(_packer(sets_of, ranges), _PACKED)
    counted = packed.groupBy("range").applyInArrow(
        _count_range, "run long, ids binary, sizes binary, sets binary, unique binary"
    )
    return counted.groupBy("run").applyInArrow(_sum_run, "id long, size long, n_unique long")
