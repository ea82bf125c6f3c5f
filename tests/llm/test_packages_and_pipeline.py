import hashlib
import io
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import join_sets
from pyspark.sql import functions as F

import corpus_pipeline
from incidentlab.llm import decontaminate, langid, packing, pii, warc
from incidentlab.llm.common import shared_folder


# ---- archives

def test_round_trip(spark):
    big = "é" * 600
    rows = [(1, "u", big), (5, "u", big), (5, "u", big), (3, None, big), (None, "u", big), (7, "u", None),
            (8, "u", ""), (9, "u", "small"), (10, "u\r\nx: y", "small"), (11, "u", "x" * 200000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn(
        "digest", F.lit("clash"))
    got = Counter(tuple(r) for r in warc.round_trip(spark, pages).collect())
    want = Counter()
    for i, _, h in rows:
        body = (h or "").encode()
        other = h == big and i != 5
        want[i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if other else "response",
             5 if other else None] += 1
    assert got == want
    assert warc.round_trip(spark, pages.limit(0)).collect() == []


def test_payloads_come_back(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = warc.read_archives(warc.write_archives(pages), payload=True).collect()
    want = {str(r.page_id): (r.url, r.html) for r in pages.collect()}
    assert {r.page_id: (r.url, r.payload.decode()) for r in records} == want


def make_zip():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\5\6 a comment that looks like an end record" + bytes(30)
        for name in ("a", "dir/é", "c"):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as member:
                member.write(name.encode() * 100)
    return out.getvalue()


@pytest.mark.parametrize("wide", [False, True])
def test_directories(monkeypatch, wide):
    if wide:  # the writer then uses 64-bit fields and the ZIP64 end record
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    body = make_zip()
    assert (b"PK\6\6" in body) == wide
    file = io.BytesIO(body)
    found = warc.members(file, len(body))
    assert [m.name for m in found] == ["a", "dir/é", "c"]
    for m in found:
        at = warc.data_offset(file, m)
        assert body[at:at + m.size] == m.name.encode() * 100


def make_package(path, parts, indexes):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for name, body in (parts | indexes).items():
            z.writestr(zipfile.ZipInfo(name), body)
    return path.stat().st_size


def test_all_archives_and_indexes_of_a_package(spark, tmp_path):
    import gzip
    import json

    records = [gzip.compress(warc.make_record(i, "u", b"x%d" % i, hashlib.sha1(b"x%d" % i).hexdigest(),
                                              None)) for i in range(4)]
    parts = {"archive/a.warc.gz": records[0] + records[1], "archive/b.warc.gz": records[2],
             "archive/c.warc.gz": records[3]}

    def entry(name, offset, n):
        return json.dumps({"filename": name, "offset": offset, "length": len(records[n])})

    first = "\n".join((entry("a.warc.gz", 0, 0), entry("a.warc.gz", len(records[0]), 1)))
    second = "org,x)/ 2020 " + entry("b.warc.gz", 0, 2) + "\n" + entry("archive/c.warc.gz", 0, 3)
    path = tmp_path / "p.wacz"
    size = make_package(path, parts, {"indexes/1.jsonl": first, "indexes/2.cdxj": second})
    packages = spark.createDataFrame([(str(tmp_path), str(path), size)],
                                     "folder string, path string, size long")
    assert sorted(r.page_id for r in warc.read_archives(packages).collect()) == list("0123")
    size = make_package(path, parts, {"indexes/1.jsonl": first})
    with open(path, "rb") as file, pytest.raises(ValueError, match="without index entries: b.warc.gz"):
        warc.places(file, size)


def test_what_is_no_package():
    with pytest.raises(ValueError, match="end of central directory"):
        warc.members(io.BytesIO(b"x" * 100), 100)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "b" * 100)
    with pytest.raises(ValueError, match="stored"):
        warc.data_offset(out, warc.members(out, len(out.getvalue()))[0])


# ---- packing

def check_sequences(rows, length):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(by_sequence)


@pytest.mark.parametrize("group_rows", [65536, 64])
def test_packing(spark, sf_dir, group_rows):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    how = packing.Packing(group_rows=group_rows)
    rows = packing.pack(docs, how).collect()
    used = check_sequences(rows, how.length)
    assert used <= sum(r.length for r in rows) / how.length * 1.02 + 2
    tokenizer = Tokenizer.from_file(how.tokenizer)
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for d in docs.collect():
        ids = np.array(tokenizer.encode(d.text, add_special_tokens=False).ids + [2], "<u4")
        own = sorted(pieces.pop(d.doc_id), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert sum(r.length for r in own) == len(ids)
        assert len(own) == 1 or all(r.length == how.length for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    assert not pieces


def test_packing_edges(edge_docs, no_docs):
    rows = packing.pack(edge_docs).collect()
    check_sequences(rows, 1024)
    firsts = Counter(r.doc_id for r in rows if r.piece == 0)
    assert firsts == Counter(r.doc_id for r in edge_docs.select("doc_id").collect())
    empty = [r for r in rows if r.doc_id in (1, 2)]
    crc = zlib.crc32(np.array([2], "<u4").tobytes())
    assert [(r.length, r.ids_crc32) for r in empty] == [(1, crc)] * 2
    assert packing.pack(no_docs).collect() == []


def test_large_items_do_not_merge(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(
        F.lit("a "), 600).alias("text"))
    rows = packing.pack(docs, packing.Packing(group_rows=50)).collect()
    assert check_sequences(rows, 1024) == 500


def test_both_tokenizers_give_the_same_ids():
    from tokenizers import Tokenizer

    how = packing.Packing()
    encode, file = packing.encoder(how.tokenizer, how.ranks), Tokenizer.from_file(how.tokenizer)
    for text in ("", " ", "a  b\n\n c\t", "don't we'll I'M", "naïve Über façon ñ ß Ÿ", "x" * 3000,
                 "1234567 12.5%", "   mixed", "漢字 😀", "a<|endoftext|>b", "\r\n \r\n",
                 "¡Hola! ¿qué?", "\x0b\x0c\x1c"):
        assert encode(text) == file.encode(text, add_special_tokens=False).ids, text


# ---- pipeline

def test_pipeline_against_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "jaccard_join", "decontamination", "pii", "best_fit_packing"]
    predicted = {r.doc_id: r for r in langid.predict(docs, langid.train(
        docs, learn=~langid.held_out("doc_id"))).collect()}
    rows = {i: r.text for i, r in predicted.items()
            if r.lang_pred != "und" and r.score >= corpus_pipeline.MIN_SCORE}
    groups = join_sets(list(rows.items()), 5, 80)
    rows = {i: t for i, t in rows.items() if groups[i, t][1] == i}
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    items = decontaminate.Items([(b.item_id, b.text) for b in bench])
    rows = {i: t for i, t in rows.items() if not items.find(t)}
    rows = dict(zip(rows, pii.masker()(list(rows.values()))))
    how = packing.Packing()
    encode = packing.encoder(how.tokenizer, how.ranks)
    want = {i: len(encode(t)) + 1 for i, t in rows.items()}
    result = corpus_pipeline.run(spark, sf_dir).collect()
    got = Counter()
    for r in result:
        got[r.doc_id] += r.length
    assert dict(got) == want
    check_sequences(result, how.length)
    assert len(want) < docs.count()


def test_pipeline_stages_on_edges(spark, edge_docs, no_docs, sf_dir):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (edge_docs.select(*columns), no_docs.select(*columns)):
        for _, step in corpus_pipeline.STAGES[:-1]:
            docs = step(spark, docs, sf_dir)
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()


def test_folder_is_the_sessions(spark):
    assert shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    assert shared_folder(spark) != shared_folder(spark)
