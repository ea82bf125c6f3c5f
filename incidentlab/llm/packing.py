"""Token sequences of bounded length by hierarchical residual packing.

Every text is tokenized once; texts longer than a sequence are cut into pieces whose first takes the
remainder. Pieces are dealt over groups of bounded size. Each group packs best-fit in decreasing
order, emits its nearly full bins and hands the others on as items of the next, smaller round, until
one group is left or merging no longer helps. Only ids, lengths and checksums move.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


@dataclass(frozen=True)
class Packing:
    """Parameters. ``group_rows`` bounds the memory of one best-fit task."""

    length: int = 1024
    end_id: int = 2
    slack: int = 8  # a bin with at most so many free places is nearly full
    group_rows: int = 65536
    fan_in: int = 8
    tokenizer: str = public_tokenizers.path("byte_bpe_50k.json")
    ranks: str | None = public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Texts that both libraries cut at the same places whatever their Unicode tables.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ſ]*")
_loaded: dict = {}


def encoder(tokenizer: str, ranks: str | None):
    """Text to ids of the tokenizer file, without special tokens added. With ``ranks``, the same
    vocabulary in the other library's format encodes plain Latin texts: the ids are the same at a
    third of the time. A text that names a special token always takes the tokenizer file."""
    if (tokenizer, ranks) not in _loaded:
        with open(tokenizer) as file:
            special = [t["content"] for t in json.load(file)["added_tokens"]]
        fast, loaded = None, []
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                     mergeable_ranks=merges, special_tokens={})

        def encode(text: str) -> list[int]:
            if fast and _PLAIN.fullmatch(text) and not any(s in text for s in special):
                return fast.encode_ordinary(text)
            if not loaded:  # most workers never need it
                from tokenizers import Tokenizer

                loaded.append(Tokenizer.from_file(tokenizer))
            return loaded[0].encode(text, add_special_tokens=False).ids

        _loaded[tokenizer, ranks] = encode
    return _loaded[tokenizer, ranks]


def pieces(docs: DataFrame, how: Packing = Packing(), id_col: str = "doc_id",
           text: str = "text") -> DataFrame:
    """``row`` (unique), id, piece, start, length and ids_crc32 of every piece.

    A null text counts as empty: it is one piece that holds the end id only. Null ids, repeated ids
    and repeated rows are pieces of their own. Other columns are ignored. No rows give no pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(how.tokenizer, how.ranks), TaskContext.get().partitionId()
        row = task << 40
        for batch in batches:
            own, piece, start, length, crc = [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                ids = np.array([*encode(value.as_py() or ""), how.end_id], "<u4")
                at = np.arange(len(ids) % how.length, len(ids) + 1, how.length)
                at = at if at[0] == 0 else np.concatenate(([0], at))
                for k in range(len(at) - 1):
                    part = ids[at[k]:at[k + 1]]
                    own.append(i)
                    piece.append(k)
                    start.append(at[k])
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            rows = np.arange(row, row + len(own))
            row += len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), batch.column(0).take(pa.array(own, pa.int64())),
                 pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["row", "id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text].alias("text")).mapInArrow(
        cut, f"row long, id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each size, and what each bin holds: best fit in decreasing order. Open
    bins are kept by free places, and a bit mask of the free places in use finds the best one."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(length + 1)]
    mask, filled = 0, []
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b = length, len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += size
        left = room - size
        if left:
            free[left].append(b)
            mask |= 1 << left
    return bins, offsets, filled


def _round(items: DataFrame, number: int, groups: int, how: Packing) -> DataFrame:
    """Pack the items (bins of the round before) of each group. ``bin`` numbers are new."""

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        item, offset, held = (rows.column(c).to_numpy() for c in ("bin", "offset", "held"))
        _, first, own = np.unique(item, return_index=True, return_inverse=True)
        bins, at, filled = best_fit(held[first], how.length)
        base = (number << 44) + (key[0].as_py() << 20)
        new = {"bin": base + bins[own], "offset": offset + at[own],
               "held": np.array(filled, np.int64)[bins[own]]}
        for name, values in new.items():
            rows = rows.set_column(rows.column_names.index(name), name, pa.array(values))
        return rows.drop_columns(["deal"])

    dealt = items.withColumn("deal", F.pmod(F.xxhash64("bin", F.lit(number)), F.lit(groups)))
    return dealt.groupBy("deal").applyInArrow(pack, items.schema)


def pack(docs: DataFrame, how: Packing = Packing(), id_col: str = "doc_id",
         text: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset. Offsets within
    a sequence have no gaps. Cases of missing or repeated values are those of ``pieces``."""
    cut = stage(pieces(docs, how, id_col, text))
    items = cut.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
                       F.col("row").alias("bin"), F.lit(0).cast("long").alias("offset"),
                       F.col("length").alias("held"))
    count, groups, number, emitted = items.count(), 0, 0, []
    while True:
        wanted = max(1, -(-count // how.group_rows))
        groups = max(wanted, groups // how.fan_in)
        number += 1
        packed = stage(_round(items, number, groups, how))
        nearly = F.col("held") >= how.length - how.slack
        left = packed.where(~nearly).agg(F.count_distinct("bin")).first()[0]
        if groups == 1 or left > 0.98 * count:
            emitted.append(packed)
            break
        emitted.append(packed.where(nearly))
        items, count = packed.where(~nearly), left
    out = emitted[0]
    for more in emitted[1:]:
        out = out.unionAll(more)
    return out.select(id_col, "piece", "start", "length", "ids_crc32",
                      F.col("bin").alias("sequence_id"), "offset")
