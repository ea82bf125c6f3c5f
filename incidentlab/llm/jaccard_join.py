"""Exact Jaccard join of shingle sets with block-skip index lists and set relations.

Equal sets are one node. A first filter tells which sets can link at all. By "blocks", the sorted
hashes of a set are cut into one block more than two linked sets of its size differ in, so that such
sets agree in a whole block. By "prefix", they share one of the first shingles in the order of the
hashes, and more of them the more are looked at; this suits shingles that seldom repeat by chance.
The sets left are indexed in the order of
rarity among them: two that link share one of the first shingles of each in any global order. Index
lists are cut into blocks by set size; blocks too far apart, and entries whose positions leave too
little to share, are skipped.
Within a list, answers are derived from those of similar sets: every set is first compared with a
leader, the one with the fewest shingles of its own, and sets already connected are not compared
again. Two sets with a common leader differ by just what their differences from it do not share, so
these small differences are joined in place of the sets. Pairs that remain are verified on whole texts, and components spread over the links by least labels.
No step lists all pairs of a group.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import Prefixes, mix, word_codes
from .common import stage, text_key

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@dataclass(frozen=True)
class Join:
    """Parameters. Two sets link if 100 * common >= percent * union. ``filter`` and ``leaders``
    (rounds that compare each list with one of its sets) change the speed only."""

    words: int = 3
    percent: int = 90
    filter: str = "blocks"
    leaders: int = 3


def shingles(text: str | None, how: Join) -> np.ndarray:
    """Sorted distinct hashes of the runs of words; a shorter text is one run as a whole."""
    codes = word_codes((text or "").encode().translate(_LOWER))
    if not len(codes):
        return codes
    hashes = Prefixes(codes)
    if len(codes) < how.words:
        return mix(hashes.grams(len(codes)) + np.uint64(len(codes)))
    return np.unique(hashes.grams(how.words))


def prefix_length(n: int, how: Join) -> tuple[int, int]:
    """Shingles to look at, and how many of them a linked partner has at least: it lacks no more
    than 100 - ``percent`` in a hundred of all."""
    lacks = n - -(-n * how.percent // 100)
    length = min(n, lacks + lacks // 2 + 1)
    return length, length - lacks


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _size_class(n: int, how: Join) -> int:
    """Classes so wide that two linked sets are in one class or in neighbouring ones."""
    return int(math.log(n) / math.log(100 / how.percent) + 1e-9)


def block_keys(own: np.ndarray, how: Join) -> np.ndarray:
    """Hashes of the blocks of a sorted set, for pairs whose smaller set is of its own class or of
    the class below. Of sets of class c and up, at most d shingles differ; of d + 1 blocks one at
    least is the same in both."""
    out = []
    scrambled = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(own), dtype=np.uint64)))
    high = own >> np.uint64(32)
    own_class = _size_class(len(own), how)
    for c in {own_class, max(0, own_class - 1)}:
        largest = math.floor((100 / how.percent) ** (c + 1) + 1)  # of the smaller set
        total = largest + largest * 100 // how.percent
        blocks = total * (100 - how.percent) // (100 + how.percent) + 1
        at = np.searchsorted(high * np.uint64(blocks) >> np.uint64(32), np.arange(blocks + 1))
        number = np.arange(blocks, dtype=np.uint64) + np.uint64(c << 32)
        out.append(mix(scrambled[at[1:]] - scrambled[at[:-1]] + mix(number)))
    return np.concatenate(out)


def _sets(docs: DataFrame, how: Join) -> DataFrame:
    """id, row, n, two hashes of the set, the keys of the first filter and how many of them a set
    must share to be looked at further."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, one, two, needs, keys, ends = [], [], [], [], [], [0]
            for value in batch.column(2):
                own = shingles(value.as_py(), how)
                size.append(len(own))
                one.append(own.sum(dtype=np.uint64))
                two.append(np.bitwise_xor.reduce(mix(own)) if len(own) else np.uint64(0))
                need = 1
                if len(own) and how.filter == "blocks":
                    own = block_keys(own, how)
                elif len(own):
                    length, need = prefix_length(len(own), how)
                    own = own[:length]
                needs.append(need)
                keys.append(own)
                ends.append(ends[-1] + len(own))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int32()),
                 pa.array(_signed(np.array(one, np.uint64))),
                 pa.array(_signed(np.array(two, np.uint64))), pa.array(needs, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_signed(flat)))],
                ["id", "row", "n", "h1", "h2", "need", "keys"])

    return docs.mapInArrow(
        emit, "id long, row long, n int, h1 long, h2 long, need int, keys array<long>")


def _packed(docs: DataFrame) -> DataFrame:
    """id and compressed text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(
                    [zlib.compress((v.as_py() or "").encode(), 1) for v in batch.column(2)],
                    pa.binary())], ["id", "row", "packed"])

    return docs.mapInArrow(emit, "id long, row long, packed binary")


def _lists(texts: DataFrame, how: Join) -> DataFrame:
    """Index entries (shingle, id, n, pos) of the sets of ``texts``, in the order of rarity among
    them. Shingles of one set only come first; they take positions but no entry."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = shingles(zlib.decompress(batch.column(1)[i].as_py()).decode(), how)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.full(len(own), i))),
                     pa.array(np.full(len(own), len(own), np.int32)), pa.array(_signed(own))],
                    ["id", "n", "shingle"])

    full = texts.select("id", "packed").mapInArrow(emit, "id long, n int, shingle long")
    often = stage(full.groupBy("shingle").agg(F.count("*").alias("m")).where("m > 1"))
    both = full.join(often.hint("shuffle_hash"), "shingle")
    per_set = both.groupBy("id").agg(F.first("n").alias("n"), F.sort_array(
        F.collect_list(F.struct("m", "shingle"))).alias("common"))
    own = F.col("n") - F.size("common")
    first = F.col("n") - F.ceil(F.col("n") * how.percent / 100 - 1e-9).cast("int") + 1
    head = per_set.where(first > own).select(
        "id", "n", own.alias("own"), F.slice("common", F.lit(1), first - own).alias("head"))
    return head.select("id", "n", "own", F.posexplode("head").alias("i", "entry")).select(
        F.col("entry.shingle").alias("shingle"), "id", "n", (F.col("own") + F.col("i")).alias("pos"))


def _verify(pairs: DataFrame, texts: DataFrame, how: Join) -> DataFrame:
    """a, b, apart (size of the symmetric difference) and linked of each pair of ids."""
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("packed").alias("right")), "b")
    both = both.join(texts.select(F.col("id").alias("a"), F.col("packed").alias("left")), "a")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, np.zeros(0, np.uint64)
        for batch in batches:
            apart, linked = [], []
            for a, left, right in zip(batch.column(0).to_pylist(), batch.column(2),
                                      batch.column(3)):
                if a != at:
                    at = a
                    known = shingles(zlib.decompress(left.as_py()).decode(), how)
                other = shingles(zlib.decompress(right.as_py()).decode(), how)
                common = int(_among(other, known).sum())
                union = len(known) + len(other) - common
                apart.append(union - common)
                linked.append(100 * common >= how.percent * union)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(apart, pa.int32()),
                 pa.array(linked, pa.bool_())], ["a", "b", "apart", "linked"])

    return both.select("a", "b", "left", "right").mapInArrow(
        compare, "a long, b long, apart int, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """id, label of all ids in ``links`` (a, b): the least id that each is connected with.

    Every round takes the least label among a node's own and its neighbours' and then follows labels
    of labels, so that chains shrink by powers of two. Rounds are written tables.
    """
    edges = stage(links.select("a", "b").unionAll(links.select(
        F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stage(edges.groupBy(F.col("a").alias("id")).agg(
        F.least("id", F.min("b")).alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(
            F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select(
            "id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("beyond"))
        new = stage(step.join(jump, "label", "left").select(
            "id", "old", F.least("label", F.coalesce("beyond", "label")).alias("label")))
        labels = new.select("id", "label")
        if new.where(F.col("old") != F.col("label")).isEmpty():
            return labels


def _least_apart(total: Column, how: Join) -> Column:
    """The largest symmetric difference of two linked sets of that total size."""
    return F.floor(total * (100 - how.percent) / (100 + how.percent) + 1e-9)


def link(docs: DataFrame, how: Join = Join(), id_col: str = "doc_id",
         text: str = "text") -> DataFrame:
    """id, n_shingles and component_id (the least id reachable over links) of each row.

    Texts without words and null texts have no shingles and link with nothing. Rows with one id are
    one document: they share a component. Rows without an id take no part and have the null
    component. Repeated rows have equal results; other columns are ignored; no rows give no rows.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text].alias("text"))
    rows = rows.withColumn("row", text_key()).select("id", "row", "text")
    sets = stage(_sets(rows, how))
    known = sets.where("id IS NOT NULL AND n > 0")
    # one node for equal sets, by a number of its own, as several sets may have one id; up to the
    # labels, ids are these numbers. A row of the least id gives the text
    nodes = stage(known.groupBy("n", "h1", "h2").agg(F.min(F.struct("id", "row")).alias("first"))
                  .withColumn("node", F.monotonically_increasing_id()))
    firsts = nodes.select(F.col("first.id").alias("id"), F.col("first.row").alias("row"), "node")
    heads = known.dropDuplicates(["id", "row"]).join(firsts, ["id", "row"])
    entries = heads.select(F.col("node").alias("id"), "need", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    wanted = entries.join(stage(shared.select("key")).hint("shuffle_hash"), "key",
                          "left_semi").groupBy("id").agg(
        F.count("*").alias("m"), F.max("need").alias("need")).where("m >= need").select("id")
    wanted = stage(firsts.join(wanted.withColumnRenamed("id", "node"), "node", "left_semi"))
    texts = stage(_packed(rows).join(wanted.hint("shuffle_hash"), ["id", "row"])
                  .dropDuplicates(["node"]).select(F.col("node").alias("id"), "packed"))
    lists = stage(_lists(texts, how))

    checked = labels = None
    for number in range(how.leaders):
        open_ = stage(_open(lists, labels))
        order = F.struct("pos", F.xxhash64("id", F.lit(number)), "id", "n", "label")
        leaders = stage(open_.groupBy("shingle").agg(F.min(order).alias("first")).select(
            "shingle", F.col("first.id").alias("a"), F.col("first.n").alias("na"),
            F.col("first.label").alias("la"), F.col("first.pos").alias("pa")))
        pairs = open_.join(leaders, "shingle").where(
            (F.col("label") != F.col("la"))
            & (100 * F.least("n", "na") >= how.percent * F.greatest("n", "na"))
            & (F.col("pos") + F.col("pa") <= _least_apart(F.col("n") + F.col("na"), how)))
        pairs = pairs.select("a", F.col("id").alias("b")).distinct()
        if checked is not None:
            pairs = _not_in(pairs, checked)
        found = stage(_verify(pairs, texts, how))
        checked = found if checked is None else checked.unionAll(found)
        if found.isEmpty():
            break
        labels = components(checked.where("linked"))
    checked = stage(checked)
    pairs = _not_in(_remaining(lists, texts, labels, checked, how), checked)
    links = stage(_verify(pairs, texts, how).where("linked"))
    if not links.isEmpty():
        labels = components(checked.where("linked").select("a", "b").unionAll(
            links.select("a", "b")))
    if labels is None:
        labels = firsts.select(F.col("node").alias("id"), F.col("node").alias("label")).limit(0)

    # rows with one id join the components of all their sets
    named = known.join(nodes, ["n", "h1", "h2"]).select("id", "node")
    named = named.join(labels.withColumnRenamed("id", "node"), "node", "left").select(
        "id", F.coalesce("label", "node").alias("label"))
    several = stage(named.groupBy("id").agg(
        F.min("label").alias("least"), F.max("label").alias("most")))
    if not several.where("least <> most").isEmpty():
        more = named.join(several.where("least <> most"), "id").select(
            F.col("label").alias("a"), F.col("least").alias("b")).where("a <> b")
        roots = components(more).select(F.col("id").alias("label"), F.col("label").alias("root"))
        several = stage(named.join(roots, "label", "left").groupBy("id").agg(
            F.min(F.coalesce("root", "label")).alias("least")))
    least = stage(several.groupBy("least").agg(F.min("id").alias("first")))
    found = several.join(least, "least").select("id", "first")
    return sets.join(found, "id", "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("first", "id").alias("component_id"))


def _open(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Index entries of the lists whose sets are not all connected yet. Aggregates are written
    before they are joined back: plain shuffles on both sides can be split at a hot shingle."""
    if labels is None:
        return lists.withColumn("label", F.col("id"))
    named = stage(lists.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")))
    mixed = stage(named.groupBy("shingle").agg(
        F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most"))
    return named.join(mixed.select("shingle"), "shingle", "left_semi")


def _not_in(pairs: DataFrame, checked: DataFrame) -> DataFrame:
    """Pairs not compared yet, in either order."""
    turned = checked.select("a", "b").unionAll(checked.select(
        F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(turned, ["a", "b"], "left_anti")


def _remaining(lists: DataFrame, texts: DataFrame, labels: DataFrame | None, checked: DataFrame,
               how: Join) -> DataFrame:
    """Pairs of sets that no relation decides: not connected yet, of fitting sizes and positions.
    Sets with a common leader meet in the lists of their differences from it, all others in the
    lists of their shingles."""
    votes = stage(checked.groupBy("a").agg(F.count("*").alias("votes")))
    leaders = checked.join(votes, "a").groupBy(F.col("b").alias("id")).agg(
        F.max(F.struct("votes", "a")).alias("first")).select("id", F.col("first.a").alias("leader"))
    entries = stage(_open(lists, labels).join(leaders, "id", "left"))
    led = stage(entries.where("leader IS NOT NULL").select("id", "label", "leader").distinct())
    apart = stage(_apart_lists(led, texts, how))
    same = _meet(apart, ["leader", "shingle"], F.lit(True), how)
    other = _meet(entries, ["shingle"], ~F.col("leader_a").eqNullSafe(F.col("leader_b"))
                  | F.col("leader_a").isNull(), how)
    return same.unionAll(other).distinct()


def _meet(entries: DataFrame, keys: list[str], condition: Column, how: Join) -> DataFrame:
    """Pairs (a, b) of sets of one list. Lists are cut into blocks of sizes; each entry meets those
    of its own block and of the next larger one."""
    block = F.floor(F.log("n") / math.log(100 / how.percent) + 1e-9).cast("int")
    entries = entries.withColumn("block", block)
    left = entries.select(*[F.col(c).alias(f"{c}_a") for c in entries.columns])
    right = entries.withColumn("block", F.explode(F.array("block", F.col("block") + 1)))
    right = right.select(*[F.col(c).alias(f"{c}_b") for c in right.columns])
    on = F.lit(True)
    for key in [*keys, "block"]:
        on = on & (F.col(f"{key}_a") == F.col(f"{key}_b"))
    met = left.join(right, on & (F.col("label_a") != F.col("label_b")))
    limit = _least_apart(F.col("n_a") + F.col("n_b"), how)
    kept = met.where(condition & (F.col("id_a") != F.col("id_b"))
                     & (100 * F.least("n_a", "n_b") >= how.percent * F.greatest("n_a", "n_b"))
                     & (F.col("pos_a") + F.col("pos_b") <= limit))
    return kept.select(F.least("id_a", "id_b").alias("a"),
                       F.greatest("id_a", "id_b").alias("b")).distinct()


def _apart_lists(led: DataFrame, texts: DataFrame, how: Join) -> DataFrame:
    """Index entries (leader, shingle, id, n, pos, label) of each set's difference from its leader,
    in the order of rarity among the sets with that leader. Of two sets, what stands before their
    first common entry is in one of them only, so positions bound how much they differ."""
    both = led.join(texts.select("id", F.col("packed").alias("right")), "id").join(
        texts.select(F.col("id").alias("leader"), F.col("packed").alias("left")), "leader")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, np.zeros(0, np.uint64)
        for batch in batches:
            leaders = batch.column(0).to_pylist()
            for i in range(batch.num_rows):
                if leaders[i] != at:
                    at = leaders[i]
                    known = shingles(zlib.decompress(batch.column(3)[i].as_py()).decode(), how)
                own = shingles(zlib.decompress(batch.column(4)[i].as_py()).decode(), how)
                only = np.setxor1d(own, known, assume_unique=True)
                same = pa.array(np.full(len(only), i))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(same) for c in (0, 1, 2)],
                     pa.array(np.full(len(only), len(own), np.int32)),
                     pa.array(np.full(len(only), len(only), np.int32)), pa.array(_signed(only))],
                    ["leader", "id", "label", "n", "size", "shingle"])

    full = both.select("leader", "id", "label", "left", "right").mapInArrow(
        emit, "leader long, id long, label long, n int, size int, shingle long")
    often = stage(full.groupBy("leader", "shingle").agg(F.count("*").alias("m")).where("m > 1"))
    per_set = full.join(often, ["leader", "shingle"]).groupBy("leader", "id", "label").agg(
        F.first("n").alias("n"), F.first("size").alias("size"),
        F.sort_array(F.collect_list(F.struct("m", "shingle"))).alias("common"))
    own = F.col("size") - F.size("common")
    most = _least_apart(F.col("n") * (1 + 100 / how.percent), how).cast("int") + 1
    head = per_set.where(most > own).select(
        "leader", "id", "label", "n", own.alias("own"),
        F.slice("common", F.lit(1), most - own).alias("head"))
    return head.select("leader", "id", "label", "n", "own", F.posexplode("head").alias("i", "entry")
                       ).select("leader", F.col("entry.shingle").alias("shingle"), "id", "n",
                                (F.col("own") + F.col("i")).alias("pos"), "label")
