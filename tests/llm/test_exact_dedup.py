from collections import Counter

import numpy as np
import pytest
from brute import LAST, dedup_bytes, dedup_words, join_sets

from incidentlab.llm import anchors, jaccard_join, substring_trees, suffix_dedup


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def by_id(rows, expected):
    return Counter((i, *expected[LAST if i is None else i, t or ""]) for i, t in rows)


def got(df, *columns):
    return Counter(tuple(r) for r in df.select("doc_id", *columns).collect())


@pytest.mark.parametrize("limit", [10000, 3])
def test_suffix_dedup(edge_docs, monkeypatch, limit):
    find = anchors.find  # a small limit sends groups the way of very frequent strings
    monkeypatch.setattr(anchors, "find", lambda *a: find(*a, group_rows=limit))
    rows = pairs(edge_docs)
    columns = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got(suffix_dedup.remove(edge_docs), *columns) == by_id(rows, dedup_bytes(rows))


@pytest.mark.parametrize("limit", [10000, 3])
def test_substring_trees(edge_docs, monkeypatch, limit):
    find = anchors.find
    monkeypatch.setattr(anchors, "find", lambda *a: find(*a, group_rows=limit))
    rows = pairs(edge_docs)
    columns = ("n_words", "n_removed", "kept_sha256")
    assert got(substring_trees.remove(edge_docs), *columns) == by_id(rows, dedup_words(rows))


@pytest.mark.parametrize(("words", "percent", "first"), [
    (3, 90, "blocks"), (5, 80, "prefix"), (1, 50, "blocks"), (1, 50, "prefix")])
def test_jaccard_join(edge_docs, words, percent, first):
    rows = pairs(edge_docs)
    want = join_sets(rows, words, percent)
    how = jaccard_join.Join(words=words, percent=percent, filter=first)
    result = jaccard_join.link(edge_docs, how)
    assert got(result, "n_shingles", "component_id") == Counter(
        (i, *want[i, t]) for i, t in rows)


@pytest.mark.parametrize("first", ["blocks", "prefix"])
def test_jaccard_texts_under_one_id(spark, first):
    """Each of the texts under one id links with its own near copies."""
    def text(k, tail=""):
        return " ".join(f"t{k}w{j}" for j in range(50)) + tail

    rows = [(1, text(0)), (1, text(1)), (1, text(2)), (1, text(2)), (5, text(0, " x")),
            (6, text(1, " y")), (7, text(2, " z")), (8, text(3)), (9, text(3)), (9, text(4)),
            (-3, text(4, " a")), (20, text(5)), (None, text(0))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = join_sets(rows, 3, 90)
    assert {want[i, t][1] for i, t in rows if i in (1, 5, 6, 7)} == {1} and want[8, text(3)][1] == -3
    result = jaccard_join.link(docs, jaccard_join.Join(filter=first))
    assert got(result, "n_shingles", "component_id") == Counter((i, *want[i, t]) for i, t in rows)


@pytest.mark.parametrize("first", ["blocks", "prefix"])
@pytest.mark.parametrize("percent", [60, 90])
def test_jaccard_chains(spark, percent, first):
    """Sets that differ step by step: components reach beyond single links."""
    rows = [(100 - i, " ".join(f"w{i + j}" for j in range(40))) for i in range(0, 60)]
    rows += [(200 + i, " ".join(f"w{i * 9 + j}" for j in range(60))) for i in range(0, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = join_sets(rows, 3, percent)
    result = jaccard_join.link(docs, jaccard_join.Join(
        words=3, percent=percent, filter=first, leaders=1))
    assert got(result, "n_shingles", "component_id") == Counter(
        (i, *want[i, t]) for i, t in rows)


def test_against_brute_force_on_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 120")
    rows = pairs(docs)
    assert got(suffix_dedup.remove(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") \
        == by_id(rows, dedup_bytes(rows))
    want = join_sets(rows, 5, 80)
    result = jaccard_join.link(docs, jaccard_join.Join(words=5, percent=80, filter="prefix"))
    assert got(result, "n_shingles", "component_id") == Counter((i, *want[i, t]) for i, t in rows)


def test_no_rows(no_docs):
    assert suffix_dedup.remove(no_docs).collect() == []
    assert substring_trees.remove(no_docs).collect() == []
    assert jaccard_join.link(no_docs).collect() == []


def test_ranks_and_nodes_agree_with_strings():
    rng = np.random.default_rng(0)
    for size in (1, 3, 8, 9, 20, 50):
        units = rng.integers(0, 2, 400).astype(np.uint8)
        counts = np.array([5, 1, 9, 30, 20])
        places = np.array([0, 60, 61, 130, 260])
        starts = np.concatenate([np.arange(p, p + c) for p, c in zip(places, counts)])
        strings = [units[s:s + size].tobytes() for s in starts]
        same = np.array([[a == b for a in strings] for b in strings])
        for found in (suffix_dedup.ranks_by_doubling(units, places, counts, size),
                      substring_trees.deep_nodes(units.astype(np.uint64), places, counts, size)):
            assert (same == (found[:, None] == found[None, :])).all()


def test_long_texts_are_read_in_chunks(monkeypatch):
    rng = np.random.default_rng(1)
    body = bytes(rng.choice(list(b"abcd  \n"), 5000).tolist())
    whole = anchors.word_codes(body)
    monkeypatch.setattr(anchors, "CHUNK", 64)
    assert (anchors.word_codes(body) == whole).all() and len(whole) == len(body.split())
    spec = anchors.Windows(20, 8, anchors.word_codes, within=True)
    found = [x for part in anchors.runs(whole, spec) for x in zip(*part[1:3])]
    assert sum(c for _, c in found) == len(whole) - 19
