"""Best-fit packing by bin completion over the histogram of lengths.

Pieces of one length are interchangeable, so the packing is decided on counts by length (at most
``size`` rows, whatever the corpus) and then dealt to the pieces by rank:

1. Each text is encoded and cut into pieces; counts are taken by (length, bucket).
2. The driver fills sequences of a histogram. The incumbent is best-fit decreasing on groups of equal
   sequences. Bin completion takes the largest length left, enumerates fillings of the room beside it
   (longer first, so a filling that is dominated by one already seen never replaces it), and branches
   over the best three, at any depth; a branch ends when its waste so far passes what the incumbent
   allows. It stops at the lower bound or after NODES nodes, and the better plan is kept.
3. A plan is a list of (filling, times). The pieces of a length are ranked (bucket offset plus row
   number inside the bucket) and take the places of that length in the order of the plan.

Defined results: a null or empty text is one piece holding the end id; repeated doc_ids are packed as
separate documents; no rows give no pieces. Columns beyond doc_id and text are not used.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktl.llm.common import table, written
from sparktl.llm.tokens import binaries, id_runs

SIZE = 4096
NODES = 20_000
TRIES = 400
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, file: str = "word_bpe_49k.json", end_id: int = 1, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids, cut only where longer than size."""

    def cut(ids: np.ndarray, rows: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        parts = -(-counts // size)
        piece = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = piece * size
        length = np.minimum(np.repeat(counts, parts) - start, size)
        ends = 4 * np.cumsum(length)
        raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        crc = [zlib.crc32(raw[a:b]) for a, b in zip((ends - 4 * length).tolist(), ends.tolist())]
        columns = [rows.take(pa.array(np.repeat(np.arange(len(counts)), parts))), pa.array(piece.astype("<i4")), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays(columns + [binaries(ids, length)] * keep_ids, names + ["ids"] * keep_ids)

    return id_runs(docs, file, end_id, False, cut, PIECES + ", ids binary" * keep_ids)


Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def best_fit(histogram: dict[int, int], size: int) -> Plan:
    """Best-fit decreasing, on groups of sequences that hold the same lengths."""
    groups: dict[int, list[list]] = {}  # room left -> [lengths, sequences]
    rooms: list[int] = []
    done: Counter = Counter()

    def put(filling: tuple, room: int, times: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append([filling, times])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = min(size // length, left)
                put((length,) * each, size - each * length, left // each)
                left -= left // each * each
                continue
            room = rooms[at]
            filling, times = groups[room][-1]
            each = min(room // length, left)
            now = min(times, left // each)
            groups[room][-1][1] -= now
            if times == now:
                groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            put(filling + (length,) * each, room - each * length, now)
            left -= now * each
    for found in groups.values():
        for filling, times in found:
            done[tuple(sorted(Counter(filling).items(), reverse=True))] += times
    return list(done.items())


def fillings(lengths: list[int], left: dict[int, int], room: int, waste: int, tries: int) -> list[tuple[int, tuple[int, ...]]]:
    """Up to three undominated fillings of the room, least waste first. lengths: ascending, all with left > 0."""
    found: list[tuple[int, tuple[int, ...]]] = []
    best = waste + 1
    stack: list[tuple[int, int, tuple[int, ...]]] = [(room, len(lengths), ())]
    while stack and tries:
        room_left, top, taken = stack.pop()
        tries -= 1
        at = min(top, bisect_left(lengths, room_left + 1))
        if at == 0:
            if room_left < best:
                best = room_left
                found.append((room_left, taken))
                if not best:
                    break
            continue
        # the next choice below this one is tried after it
        length = lengths[at - 1]
        stack.append((room_left, at - 1, taken))
        if taken.count(length) < left[length]:
            stack.append((room_left - length, at, (*taken, length)))
    return sorted(found)[:3]


def bin_completion(histogram: dict[int, int], size: int, most: int, nodes: int, tries: int) -> Plan | None:
    """A plan of at most ``most`` sequences, or None if the search ends without one."""
    spare = most * size - sum(k * n for k, n in histogram.items())
    left, lengths = dict(histogram), sorted(histogram)
    # the steps taken, each with the fillings still to try in its place: a stack, as plans have thousands of steps
    trail: list[tuple[Counter, int, int, int, list]] = []

    def take(longest: int, options: list[tuple[int, tuple[int, ...]]]) -> None:
        nonlocal spare
        (waste, taken), *rest = options
        need = Counter(taken)
        need[longest] += 1
        times = min(left[x] // n for x, n in need.items())
        if waste:
            times = min(times, spare // waste)
        for x, n in need.items():
            left[x] -= n * times
            if not left[x]:
                del left[x], lengths[bisect_left(lengths, x)]
        spare -= waste * times
        trail.append((need, times, waste, longest, rest if waste else []))

    def undo() -> tuple[int, list]:
        nonlocal spare
        need, times, waste, longest, rest = trail.pop()
        for x, n in need.items():
            if x not in left:
                insort(lengths, x)
            left[x] = left.get(x, 0) + n * times
        spare += waste * times
        return longest, rest

    while lengths:
        nodes -= 1
        if nodes < 0 or spare < 0:
            return None
        longest = lengths[-1]
        left[longest] -= 1
        if not left[longest]:
            lengths.pop()
        options = fillings(lengths, left, size - longest, spare, tries)
        left[longest] += 1
        if left[longest] == 1:
            lengths.append(longest)
        while not options:
            if not trail:
                return None
            longest, options = undo()
        take(longest, options)
    return [(tuple(sorted(need.items(), reverse=True)), times) for need, times, *_ in trail]


def planned(histogram: dict[int, int], size: int = SIZE, nodes: int = NODES, tries: int = TRIES) -> Plan:
    """The plan with fewer sequences of best-fit decreasing and bin completion."""
    full = [(((size, 1),), histogram[size])] if size in histogram else []
    histogram = {k: n for k, n in histogram.items() if k != size}
    if not histogram:
        return full
    incumbent = best_fit(histogram, size)
    count = lambda plan: sum(n for _, n in plan)
    least = max(-(-sum(k * n for k, n in histogram.items()) // size), sum(n for k, n in histogram.items() if 2 * k > size))
    while count(incumbent) > least:
        # first try for the bound, then for one sequence less than the incumbent
        better = bin_completion(histogram, size, least, nodes, tries) or bin_completion(histogram, size, count(incumbent) - 1, nodes, tries)
        if better is None:
            break
        incumbent = better
        if count(better) > least and nodes < 100:
            break
        nodes //= 4
    return full + incumbent


def places(plan: Plan) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, places in a sequence, first offset), ranks ascending."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter = Counter()
    sequence = 0
    for filling, times in plan:
        at = 0
        for length, n in filling:
            out.setdefault(length, []).append((ranks[length], sequence, n, at))
            ranks[length] += n * times
            at += n * length
        sequence += times
    return {k: np.array(v, "<i8") for k, v in out.items()}


def pack(parts: DataFrame, size: int = SIZE, nodes: int = NODES) -> DataFrame:
    """parts (length and any columns that order it: doc_id, piece, start) with sequence_id and offset.

    parts is read twice: give it written to storage.
    """
    spark = parts.sparkSession
    total = parts.count()
    buckets = max(64, -(-total // 500_000))
    marked = parts.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = written(marked.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")), "pack-counts")
    # One row a length: at most ``size`` rows come to the driver.
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}
    if len(histogram) > size:
        raise ValueError(f"lengths must be from 1 to {size}")
    dealt = spark.sparkContext.broadcast(places(planned(histogram, size, nodes)))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")
    offsets = counts.select("length", "_bucket", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start")) - 1
    ranked = marked.join(offsets, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + inside)
    ranked = ranked.select(*parts.columns, "_rank")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(rank), "<i8"), np.zeros(len(rank), "<i8")
            for one in np.unique(length):
                mine = np.flatnonzero(length == one)
                rows = dealt.value[int(one)]
                row = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1]
                k = rank[mine] - row[:, 0]
                sequence[mine] = row[:, 1] + k // row[:, 2]
                offset[mine] = row[:, 3] + k % row[:, 2] * one
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(deal, f"{fields}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids binary, length): the packed ids themselves; packed must hold ids. At most size ids a group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(F.transform(parts, lambda x: x["ids"]), F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"), F.sum("length").alias("length"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark, table(spark, sf_dir, "documents"), sf_dir)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of all documents with their sequences and places."""
    out = pack(written(pieces(docs.select("doc_id", "text")), "pack-pieces"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
