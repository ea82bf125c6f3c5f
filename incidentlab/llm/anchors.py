"""Sampled positions for exact matching of fixed-length strings of codes (bytes or words).

Every window of W codes is represented by the smallest hash among its runs of k codes. Equal windows
have equal representatives, wherever they stand, and neighbouring windows mostly share one, so that a
text of n codes has about 2n / (W - k + 2) runs of windows. Only runs whose representative occurs
again anywhere can hold a repeated window; the others are unique and drop out in the first round.

``find`` gives, for each remaining run, which of its windows occur earlier. Runs equal as a whole are
ranked first: all but the first are repeated throughout. Firsts that share their representative with
other firsts are compared window by window, in groups of bounded size (``compare``); representatives
with too many of them are compared by an aggregation over window hashes instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

CHUNK = 1 << 20
#: Windows of one run: their flags fit a 64-bit mask.
MOST = 32
_BASE = 0x9E3779B97F4A7C15
_ROOT = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers: shifts and odd factors."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _powers[:] = [np.concatenate(([np.uint64(1)], np.cumprod(
            np.full(size - 1, b, np.uint64), dtype=np.uint64))) for b in (_BASE, _ROOT)]
    return _powers[0], _powers[1]


class Prefixes:
    """Hashes of any part of a sequence of codes, in constant time."""

    def __init__(self, codes: np.ndarray) -> None:
        up, self.down = powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[:len(codes)], dtype=np.uint64, out=self.sums[1:])

    def parts(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def raw_bytes(body: bytes) -> np.ndarray:
    return np.frombuffer(body, np.uint8)


def word_codes(body: bytes) -> np.ndarray:
    """A hash for each word; the text is read in chunks that end between words."""
    out, at = [], 0
    raw = np.frombuffer(body, np.uint8)
    while at < len(raw):
        end = min(len(raw), at + CHUNK)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        part = raw[at:end]
        space = np.concatenate(([True], _SPACE[part], [True]))
        edges = np.flatnonzero(space[1:] != space[:-1])
        out.append(Prefixes(BYTE_CODES[part]).parts(edges[::2], edges[1::2]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Windows:
    """What is compared: windows of ``size`` units (bytes, or words as 64-bit hashes). ``within``:
    a window may repeat one of its own document."""

    size: int
    gram: int
    units: Callable[[bytes], np.ndarray]
    within: bool

    def read(self, text: str | None) -> np.ndarray:
        return self.units((text or "").encode())


def codes_of(units: np.ndarray) -> np.ndarray:
    return BYTE_CODES[units] if units.dtype == np.uint8 else units


def representatives(units: np.ndarray, spec: Windows) -> Iterator[tuple]:
    """(place of the chunk, hashes of its parts, representative of each of its windows, first window
    of each stretch with one representative), chunk by chunk."""
    size, span = spec.size, spec.size - spec.gram + 1
    for at in range(0, max(0, len(units) - size + 1), CHUNK):
        part = codes_of(units[at:at + CHUNK + size - 1])
        hashes = Prefixes(part)
        least, reach = hashes.grams(spec.gram), 1
        n = len(part) - size + 1
        while reach * 2 <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        least = np.minimum(least[:n], least[span - reach:span - reach + n])
        yield at, hashes, least, np.concatenate(
            ([0], np.flatnonzero(least[1:] != least[:-1]) + 1))


def runs(units: np.ndarray, spec: Windows) -> Iterator[tuple]:
    """Arrays (key, start, count, whole, again) of the runs of a text, chunk by chunk: the
    representative, the first window, how many follow with it, the hash of all they cover, and
    whether two windows of the run are equal (None where that does not count)."""
    size = spec.size
    for at, hashes, least, start in representatives(units, spec):
        count = np.diff(np.concatenate((start, [len(least)])))
        if count.max() > MOST:
            pieces = -(-count // MOST)
            first = np.repeat(np.cumsum(pieces) - pieces, pieces)
            within = (np.arange(pieces.sum()) - first) * MOST
            count = np.minimum(np.repeat(count, pieces) - within, MOST)
            start = np.repeat(start, pieces) + within
        again = None
        if spec.within:
            again = np.zeros(len(start), bool)
            whole, owner = hashes.grams(size), np.repeat(np.arange(len(start)), count)
            for d in range(1, int(count.max())):
                same = (whole[d:] == whole[:-d]) & (owner[d:] == owner[:-d])
                again[owner[:-d][same]] = True
        whole = hashes.parts(start, start + count + size - 1) + count.astype(np.uint64)
        yield least[start], start + at, count, whole, again


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def _keys(docs: DataFrame, spec: Windows) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(0):
                units = spec.read(value.as_py())
                if spec.within:
                    found += [np.repeat(key, again + 1) for key, _, _, _, again in runs(units, spec)]
                elif len(units) >= spec.size:
                    found.append(np.unique(np.concatenate([
                        least[start] for _, _, least, start in representatives(units, spec)])))
            if found:
                yield pa.RecordBatch.from_arrays([_long(np.concatenate(found))], ["key"])

    return docs.select("text").mapInArrow(emit, "key long")


def _runs(docs: DataFrame, spec: Windows) -> DataFrame:
    names = ["key", "whole", "id", "row", "start", "count", *(["again"] if spec.within else [])]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[] for _ in names[1:]]
            for i, value in enumerate(batch.column(2)):
                for key, start, count, whole, again in runs(spec.read(value.as_py()), spec):
                    for out, x in zip(found, (key, whole, np.full(len(key), i), start, count,
                                              again)):
                        out.append(x)
            if not found[0]:
                continue
            key, whole, own, start, count, *again = map(np.concatenate, found)
            own = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [_long(key), _long(whole), batch.column(0).take(own), batch.column(1).take(own),
                 pa.array(start, pa.int32()), pa.array(count, pa.int16()), *map(pa.array, again)],
                names)

    return docs.select("id", "row", "text").mapInArrow(
        emit, "key long, whole long, id long, row int, start int, count smallint"
              + ", again boolean" * spec.within)


def _contexts(docs: DataFrame, firsts: DataFrame, spec: Windows) -> DataFrame:
    """The units that the runs in ``firsts`` cover, from their texts."""
    wanted = firsts.groupBy("id", "row").agg(F.collect_list(F.struct(
        "key", "whole", "start", "count", "hot")).alias("runs"))
    texts = docs.join(wanted.hint("shuffle_hash"), ["id", "row"]).select("id", "text", "runs")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                units = spec.read(batch.column(1)[i].as_py())
                own = pa.RecordBatch.from_struct_array(batch.column(2)[i].values)
                starts, counts = (own.column(c).to_numpy() for c in ("start", "count"))
                yield pa.RecordBatch.from_arrays(
                    [own.column("key"), own.column("whole"),
                     batch.column(0).take(pa.array(np.full(len(starts), i))),
                     own.column("start"), own.column("count"), own.column("hot"),
                     pa.array([units[s:s + c + spec.size - 1].tobytes()
                               for s, c in zip(starts, counts)], pa.binary())],
                    ["key", "whole", "id", "start", "count", "hot", "units"])

    return texts.mapInArrow(
        emit, "key long, whole long, id long, start int, count smallint, hot boolean, units binary")


#: (units of all rows in one array, first window's place of each row, windows of each row) to an
#: array of numbers, one for each window in order, equal where the windows are equal.
Compare = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _flags(contexts: DataFrame, spec: Windows, compare: Compare, groups: int) -> DataFrame:
    """whole, mask: the windows of a first run that occur earlier in another one (or in itself)."""
    kind = spec.units(b"").dtype

    def judge(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        counts = rows.column("count").to_numpy().astype(np.int64)
        lengths = counts + spec.size - 1
        units = np.frombuffer(b"".join(rows.column("units").to_pylist()), kind)
        places = np.cumsum(lengths) - lengths
        strings = compare(units, places, counts)
        owner = np.repeat(np.arange(len(counts)), counts)
        j = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        ids = rows.column("id").to_numpy()[owner]
        starts = rows.column("start").to_numpy()[owner] + j if spec.within else np.zeros_like(j)
        order = np.lexsort((starts, ids, strings))
        head = np.concatenate(([True], strings[order][1:] != strings[order][:-1]))
        first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        later = (ids[order] > ids[first]) | (starts[order] > starts[first])
        mask = np.zeros(len(counts), np.int64)
        hit = order[later]
        np.bitwise_or.at(mask, owner[hit], np.int64(1) << j[hit])
        return pa.table({"whole": rows.column("whole"), "mask": pa.array(mask)})

    dealt = contexts.where(~F.col("hot")).withColumn(
        "deal", F.pmod(F.xxhash64("key"), F.lit(groups)))
    near = dealt.groupBy("deal").applyInArrow(judge, "whole long, mask long")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column(batch.schema.get_field_index("count")).to_numpy()
            bodies = batch.column(batch.schema.get_field_index("units"))
            hashes = [Prefixes(codes_of(np.frombuffer(b.as_py(), kind))).grams(spec.size)
                      for b in bodies]
            own = pa.array(np.repeat(np.arange(len(counts)), counts))
            j = np.concatenate([np.arange(c) for c in counts]) if len(counts) else counts
            at = batch.column(batch.schema.get_field_index("start")).take(own).to_numpy() + j
            yield pa.RecordBatch.from_arrays(
                [_long(np.concatenate(hashes)) if hashes else pa.array([], pa.int64()),
                 batch.column(batch.schema.get_field_index("whole")).take(own),
                 batch.column(batch.schema.get_field_index("id")).take(own),
                 _long(at if spec.within else np.zeros_like(at)), _long(j)],
                ["string", "whole", "id", "at", "j"])

    many = contexts.where("hot").select("whole", "id", "start", "count", "units").mapInArrow(
        explode, "string long, whole long, id long, at long, j long")
    first = stage(many.groupBy("string").agg(F.min(F.struct("id", "at")).alias("first")))
    far = many.join(first, "string").where(F.struct("id", "at") > F.col("first")).groupBy(
        "whole").agg(F.bit_or(F.expr("shiftleft(1L, cast(j AS int))")).alias("mask"))
    return near.where("mask <> 0").unionAll(far)


def find(docs: DataFrame, spec: Windows, compare: Compare, group_rows: int = 10000) -> DataFrame:
    """Rows (id, row, start, count, mask) of the runs with windows that occur earlier: mask -1
    stands for all ``count`` windows from ``start`` on, else bit j for the window at start + j.

    ``docs`` has id (long), row (a short hash that tells apart rows with one id) and text.
    """
    counts = _keys(docs, spec).groupBy("key").agg(F.count("*").alias("n"))
    repeated = stage(counts.where("n > 1").select("key"))
    left = stage(_runs(docs, spec).join(repeated.hint("shuffle_hash"), "key", "left_semi"))
    # rank whole runs: the first of each is the one that is looked at further
    again = F.max("again") if spec.within else F.lit(False)
    firsts = stage(left.groupBy("whole").agg(
        F.min(F.struct("id", "start", "row")).alias("first"), F.min("key").alias("key"),
        F.max("count").alias("count"), again.alias("again"), F.count("*").alias("n")))
    # aggregates are written before they are joined back: both sides of a join are then plain
    # shuffles, which can be split at a key that a third of all runs share
    shared = firsts.groupBy("key").agg(F.count("*").alias("m"), F.max("again").alias("any"))
    shared = stage(shared.where(F.col("any") | (F.col("m") > 1)).select(
        "key", (F.col("m") > group_rows).alias("hot")))
    open_ = firsts.join(shared, "key").select(
        "key", "whole", "first.id", "first.row", "first.start", "count", "hot")
    contexts = stage(_contexts(docs, open_, spec))
    groups = max(1, -(-contexts.count() // group_rows))
    masks = stage(_flags(contexts, spec, compare, groups))
    judged = firsts.join(masks.groupBy("whole").agg(F.bit_or("mask").alias("mask")), "whole",
                         "left").where("n > 1 OR mask IS NOT NULL")
    judged = stage(judged.select("whole", "first", "mask"))
    own = F.struct("id", "start") if spec.within else F.struct("id")
    head = F.struct("first.id", "first.start") if spec.within else F.struct("first.id")
    mask = F.when(own > head, F.lit(-1).cast("long")).otherwise(F.coalesce("mask", F.lit(0)))
    return left.join(judged, "whole").select(
        "id", "row", "start", "count", mask.alias("mask")).where("mask <> 0")


def prepare(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Rows as ``find`` takes them. A null id is larger than all others."""
    return docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit((1 << 63) - 1)).alias("id"),
        docs[id_col].alias("own_id"), docs[text].alias("text")).withColumn(
        "row", F.hash(F.coalesce("text", F.lit("\0null"))))


def marked(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Each row of ``docs`` with the runs found in it (null if none)."""
    per_row = found.groupBy("id", "row").agg(
        F.collect_list(F.struct("start", "count", "mask")).alias("runs"))
    return docs.join(per_row.hint("shuffle_hash"), ["id", "row"], "left").select(
        "own_id", "text", "runs")


def cover(length: int, runs_found: pa.Scalar, size: int) -> np.ndarray:
    """Which of ``length`` codes lie in a window that the runs mark."""
    edge = np.zeros(length + 1, np.int64)
    if runs_found.is_valid:
        table = pa.RecordBatch.from_struct_array(runs_found.values)
        start, count, mask = (table.column(c).to_numpy() for c in ("start", "count", "mask"))
        j = np.arange(MOST)
        # -1 has all bits set; only those of real windows count
        bits = ((mask[:, None] >> j) & 1).astype(bool) & (j < count[:, None])
        at = (start[:, None].astype(np.int64) + j)[bits]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size, -1)
    return np.cumsum(edge[:-1]) > 0
