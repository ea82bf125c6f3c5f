"""Alignment of the tokens of two tokenizers by token-byte incidence matrices.

A matrix has a row per token and a column per byte of the text, with a one where the token holds the
byte. The product of A with the transpose of B, row by row, has an entry wherever two tokens
overlap: the number of bytes they share. A second pair of matrices has a column per group, the
stretches between neighbouring places where tokens of both sides end; its product links all tokens
of a group. Matrices are kept as row bounds and column numbers (CSR), and products are made in
blocks of rows of bounded work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks, subwords
from .common import stage


@dataclass(frozen=True)
class Tokenizers:
    """Files of A (byte-level) and B (pieces), and bytes of text worked on at a time."""

    a: str = public_tokenizers.path("byte_bpe_50k.json")
    a_ranks: str | None = public_tokenizers.path("byte_bpe_50k.tiktoken")
    a_pattern: str = public_tokenizers.PATTERN
    b: str = public_tokenizers.path("piece_bpe_32k.model")
    slice_bytes: int = 2 << 20


@dataclass
class Csr:
    """A matrix of zeros and ones: the columns of row i are indices[bounds[i]:bounds[i + 1]]."""

    bounds: np.ndarray
    indices: np.ndarray
    columns: int

    def transposed(self) -> Csr:
        counts = np.bincount(self.indices, minlength=self.columns)
        rows = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        order = np.argsort(self.indices, kind="stable")
        return Csr(np.concatenate(([0], np.cumsum(counts))), rows[order], len(self.bounds) - 1)

    def times_vector(self, vector: np.ndarray) -> np.ndarray:
        return chunks.row_sums(self.bounds, vector[self.indices])


def held_bytes(lengths: np.ndarray) -> Csr:
    """Incidence of tokens that stand one after the other, and their bytes."""
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    return Csr(bounds, np.arange(bounds[-1]), int(bounds[-1]))


def product(left: Csr, right: Csr, work: int = 1 << 20
            ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, column and value of the entries of ``left`` times ``right``, in order, in blocks.

    A row of the product is the sum of those rows of ``right`` that the row of ``left`` names
    (Gustavson). A block takes as many rows as need at most ``work`` additions, or one."""
    size = np.diff(right.bounds)
    cost = np.concatenate(([0], np.cumsum(size[left.indices])))[left.bounds]
    at, rows = 0, len(left.bounds) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(cost, cost[at] + work, "right")) - 1)
        named = left.indices[left.bounds[at]:left.bounds[end]]
        own = np.repeat(np.arange(at, end), np.diff(left.bounds[at:end + 1]))
        count = size[named]
        place = np.cumsum(count) - count
        take = np.repeat(right.bounds[named] - place, count) + np.arange(int(count.sum()))
        key = np.repeat(own, count) * right.columns + right.indices[take]
        if len(key):
            if (key[1:] < key[:-1]).any():
                key = np.sort(key)
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            value = np.diff(np.concatenate((first, [len(key)])))
            yield key[first] // right.columns, key[first] % right.columns, value
        at = end


@dataclass
class Sides:
    """Both tokenizations of the texts of a slice that have tokens, one text after the other."""

    valid: np.ndarray  # rows of the slice
    a: np.ndarray
    b: np.ndarray
    a_bytes: np.ndarray
    b_bytes: np.ndarray
    n_a: np.ndarray  # tokens of each valid text
    n_b: np.ndarray

    def groups(self) -> tuple[np.ndarray, np.ndarray, int]:
        """The group of every token of A and of B, and how many there are."""
        end_a, end_b = np.cumsum(self.a_bytes), np.cumsum(self.b_bytes)
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        return np.searchsorted(both, end_a), np.searchsorted(both, end_b), len(both)

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return product(held_bytes(self.a_bytes), held_bytes(self.b_bytes).transposed())

    def shared_groups(self) -> tuple[Csr, Csr]:
        """The factors of the links between tokens of one group."""
        of_a, of_b, count = self.groups()
        left, right = (Csr(np.arange(len(g) + 1), g, count) for g in (of_a, of_b))
        return left, right.transposed()


_spellings: dict = {}


def tokenize(texts: list[str | None], how: Tokenizers) -> Sides:
    """Tokens of space + text. A text has none if it is null or empty or if the bytes of the
    tokens of either side differ from it."""
    encode_a = subwords.byte_level(how.a, how.a_ranks, how.a_pattern)
    encode_b = subwords.pieces(how.b)
    if how not in _spellings:
        spelt = subwords.byte_level_spelling(how.a), subwords.piece_spelling(how.b)
        _spellings[how] = [(s, np.array([len(x) for x in s])) for s in spelt]
    (spell_a, size_a), (spell_b, size_b) = _spellings[how]
    valid, a, b = [], [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        whole = " " + text
        body = whole.encode()
        own_b = encode_b(text)
        if b"".join([spell_b[t] for t in own_b]) != body:
            continue
        own_a = encode_a(whole)
        if b"".join([spell_a[t] for t in own_a]) != body:
            continue
        valid.append(i)
        a.append(np.array(own_a, np.int64))
        b.append(np.array(own_b, np.int64))
    none = [np.zeros(0, np.int64)]
    all_a, all_b = np.concatenate(a or none), np.concatenate(b or none)
    return Sides(np.array(valid, np.int64), all_a, all_b, size_a[all_a], size_b[all_b],
                 np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64))


def _group_texts(sides: Sides, of_a: np.ndarray, of_b: np.ndarray) -> list[bytes]:
    """Per text `a1,a2|b1;a3|b2,b3`: ids of each group, both sides, groups in order."""
    # behind a token: a comma, after the last A of a group a bar, after the last B a semicolon
    last_a = np.concatenate((of_a[1:] != of_a[:-1], [True])) if len(of_a) else np.zeros(0, bool)
    last_b = np.concatenate((of_b[1:] != of_b[:-1], [True])) if len(of_b) else np.zeros(0, bool)
    place = np.empty(len(of_a) + len(of_b), np.int64)
    at_a = np.arange(len(of_a)) + np.searchsorted(of_b, of_a, "left")
    at_b = np.arange(len(of_b)) + np.searchsorted(of_a, of_b, "right")
    place[at_a] = sides.a * 3 + last_a
    place[at_b] = sides.b * 3 + 2 * last_b
    if "written" not in _spellings:
        _spellings["written"] = [f"{i}{mark}".encode() for i in range(1 << 16) for mark in ",|;"]
    written = _spellings["written"]
    ends = np.cumsum(sides.n_a + sides.n_b).tolist()
    out, at = [], 0
    for end in ends:
        out.append(b"".join([written[k] for k in place[at:end].tolist()])[:-1])
        at = end
    return out


_STATISTICS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")


def _pass(docs: DataFrame, how: Tokenizers, id_col: str, text: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = chunks.Numbers()
        for part in chunks.in_slices(batches, 1, how.slice_bytes):
            yield from _slice(part, int(numbers.take()[0]), how)

    return docs.select(docs[id_col].alias("id"), docs[text].alias("text")).mapInArrow(
        work, f"chunk long, local array<int>, times array<int>, id {kind}, {', '.join(f'{s} long' for s in _STATISTICS)}, "
              f"groups_sha256 string, {chunks.VOCABULARY.format(key='long')}")


def _slice(part: pa.RecordBatch, chunk: int, how: Tokenizers) -> Iterator[pa.RecordBatch]:
    count = part.num_rows
    sides = tokenize(part.column(1).to_pylist(), how)
    of_a, of_b, _ = sides.groups()
    text_a = np.repeat(sides.valid, sides.n_a)
    pairs, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j, _ in sides.overlaps():
        pairs.append(sides.a[i] << 16 | sides.b[j])
        owners.append(text_a[i])
    pair, owner = np.concatenate(pairs), np.concatenate(owners)
    keys, local, totals = np.unique(pair, return_inverse=True, return_counts=True)
    codes, times = chunks.sparse(owner, local, count)
    left, right = sides.shared_groups()
    shared = left.times_vector(np.diff(right.bounds)[:left.columns])
    stats = {s: np.zeros(count, np.int64) for s in _STATISTICS}
    stats["n_a"][sides.valid], stats["n_b"][sides.valid] = sides.n_a, sides.n_b
    stats["n_links"] = np.bincount(owner, minlength=count)
    stats["n_shared"] = np.bincount(text_a, weights=shared, minlength=count).astype(np.int64)
    first = np.concatenate(([True], of_a[1:] != of_a[:-1])) if len(of_a) else np.zeros(0, bool)
    stats["n_groups"] = np.bincount(text_a[first], minlength=count)
    digests = [""] * count
    for i, own in zip(sides.valid.tolist(), _group_texts(sides, of_a, of_b)):
        digests[i] = hashlib.sha256(own).hexdigest()
    names = ["chunk", "local", "times", "id", *_STATISTICS, "groups_sha256", "keys", "totals"]
    lists = pa.list_(pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(count, chunk)), codes, times, part.column(0),
         *[pa.array(stats[s], pa.int64()) for s in _STATISTICS], pa.array(digests, pa.string()),
         pa.nulls(count, lists), pa.nulls(count, lists)], names)
    yield pa.RecordBatch.from_arrays(
        [pa.array([chunk]), pa.nulls(1, codes.type), pa.nulls(1, times.type),
         pa.nulls(1, part.column(0).type),
         *[pa.nulls(1, pa.int64())] * len(_STATISTICS), pa.nulls(1, pa.string()),
         pa.array([keys], lists), pa.array([totals], lists)], names)


def align(docs: DataFrame, how: Tokenizers = Tokenizers(), id_col: str = "doc_id",
          text: str = "text") -> DataFrame:
    """Per row: the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links`` (overlapping tokens),
    ``n_best`` (links whose pair of ids is the most frequent one of its B id in the corpus, ties
    included), ``count_sum`` (over the links, how many links of the corpus have the same pair),
    ``groups_sha256`` and ``n_shared`` (pairs of tokens in one group).

    Null and empty texts, and texts that one side does not spell byte by byte, have no tokens:
    zeros and an empty digest. Null ids are kept; repeated rows are rows of their own and count
    as often in the corpus; other columns are ignored; no rows give no rows.
    """
    table = stage(_pass(docs, how, id_col, text))
    counts = stage(chunks.corpus_counts(table))
    side_b = F.col("key").bitwiseAND(F.lit(0xFFFF))
    best = stage(counts.groupBy(side_b.alias("b")).agg(F.max("n").alias("most")))
    values = stage(counts.join(best, side_b == best["b"]).select(
        "key", "n", (F.col("n") == F.col("most")).alias("best")))
    keep = ["id", *_STATISTICS, "groups_sha256", "local", "times"]
    kind = docs.schema[id_col].dataType.simpleString()

    def finish(own: pa.Table, found: pa.Table) -> pa.Table:
        (local, bounds), (times, _) = (chunks.flat(own.column(c)) for c in ("local", "times"))
        n, best = (found.column(c).to_numpy().astype(np.int64) for c in ("n", "best"))
        sums = chunks.row_sums(bounds, times * n[local])
        hits = chunks.row_sums(bounds, times * best[local])
        out = {c: own.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")}
        return pa.table(out | {"n_best": hits, "count_sum": sums,
                               "groups_sha256": own.column("groups_sha256"),
                               "n_shared": own.column("n_shared")})

    return chunks.answer(
        table, values, keep, finish,
        f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, "
        "count_sum long, groups_sha256 string, n_shared long").withColumnRenamed("id", id_col)


def links(docs: DataFrame, how: Tokenizers = Tokenizers(), kind: str = "overlap",
          id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The links themselves: id, ``row`` (tells apart rows with one id), ``a_at`` and ``b_at``
    (numbers of the tokens in their text), ``a``, ``b`` (their ids) and ``weight``: for kind
    "overlap" the bytes that two tokens share, for "group" 1 for any two tokens of one group."""
    if kind not in ("overlap", "group"):
        raise ValueError(f"unknown kind of links {kind!r}")
    schema = (f"id {docs.schema[id_col].dataType.simpleString()}, row long, a_at long, b_at long, "
              "a int, b int, weight long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = chunks.Numbers()
        for part in chunks.in_slices(batches, 1, how.slice_bytes):
            sides = tokenize(part.column(1).to_pylist(), how)
            rows = numbers.take(part.num_rows)
            owner = np.repeat(np.arange(len(sides.valid)), sides.n_a)
            first_a, first_b = (np.cumsum(n) - n for n in (sides.n_a, sides.n_b))
            found = sides.overlaps() if kind == "overlap" else product(*sides.shared_groups())
            for i, j, weight in found:
                own = sides.valid[owner[i]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(own)), pa.array(rows[own]),
                     pa.array(i - first_a[owner[i]]), pa.array(j - first_b[owner[i]]),
                     pa.array(sides.a[i], pa.int32()), pa.array(sides.b[j], pa.int32()),
                     pa.array(weight, pa.int64())],
                    ["id", "row", "a_at", "b_at", "a", "b", "weight"])

    out = docs.select(docs[id_col].alias("id"), docs[text].alias("text")).mapInArrow(work, schema)
    return out.withColumnRenamed("id", id_col)
