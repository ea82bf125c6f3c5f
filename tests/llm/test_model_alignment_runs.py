"""Operators 11 to 13 against plain versions of their contracts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from incidentlab.llm import alignment, attention_lm, chunks, periodic_runs, subwords, words

WORD = re.compile("[^\x20\x09-\x0d]+")
SMALL = attention_lm.Lm(sample_texts=300, steps=60, epochs=1, slice_bytes=1 << 16)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- words

def test_words_equal_the_pattern():
    import pyarrow as pa

    texts = [None, "", " a\tb\x0bc ", "é ü  x\ny", "A", "b A\r\n", "\n", "z" * 5000]
    column = pa.array(["skipped", *texts])[1:]
    found = words.split(column, lower=True)
    lowered = [re.sub("[A-Z]", lambda m: m.group().lower(), t or "") for t in texts]
    want = [WORD.findall(t) for t in lowered]
    assert found.counts.tolist() == [len(w) for w in want]
    codes, listed = found.encoded()
    assert [listed[c].as_py().decode() for c in codes.tolist()] == sum(want, [])
    data, at = found.joined(np.arange(len(codes))[::-1])
    assert data.decode() == "".join(w + " " for w in reversed(sum(want, []))) and at[-1] == len(data)
    assert list(words.slices(column, 10))[-1] == (7, 8)
    assert [i for lo, hi in words.slices(column, 10) for i in range(lo, hi)] == list(range(8))


# ---- periodic runs

def plain_runs(w):
    found = {}
    for p in range(1, len(w) // 3 + 1):
        i = 0
        while i + p < len(w):
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i - start + p >= max(24, 3 * p):
                found.setdefault((start, i + p), p)
            i += 1
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = [(0, n, 1)] if n > 3000 and len(set(w)) == 1 else plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *numbers, sha("".join("%d,%d,%d\n" % r for r in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
               "collapsed_sha256"]


def test_runs_on_hard_rows(edge_docs, edge_rows):
    want = Counter(plain_row(r[0], r[1]) for r in edge_rows)
    for size in (100, 4 << 20):
        got = periodic_runs.analyse(edge_docs, periodic_runs.Runs(slice_bytes=size), planted=True)
        assert Counter(tuple(r) for r in got.select(*RUN_COLUMNS).collect()) == want


def test_runs_of_planted_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 4000")
    want = {plain_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    rows = periodic_runs.analyse(docs, planted=True).collect()
    assert {tuple(r[c] for c in RUN_COLUMNS) for r in rows} == want
    assert sum(r.n_runs > 0 for r in rows) > 10
    for r in rows:
        assert sha(r.collapsed) == r.collapsed_sha256 and len(r.runs) == r.n_runs


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 4)):
            w = []
            for _ in range(rng.randint(0, 5)):
                unit = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(1, 12))]
                w += unit * rng.randint(1, 9) + unit[:rng.randint(0, len(unit))]
                w += [rng.randrange(3) for _ in range(rng.choice([0, 0, 9]))]
            texts.append(w)
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
        codes = np.array(sum(texts, []), np.int64)
        got = [tuple(r) for r in periodic_runs.find(codes, owner).tolist()]
        want, at = [], 0
        for w in texts:
            want += [(s + at, s + at + n, p) for s, n, p in plain_runs(w)]
            at += len(w)
        assert got == want


def test_branching_squares_are_all_of_them():
    rng = random.Random(6)
    for _ in range(60):
        w = [rng.randrange(2) for _ in range(rng.randint(2, 40))]
        rank, open_ = periodic_runs._first_ranks(np.array(w))
        starts, periods = periodic_runs.branching_squares(periodic_runs.SuffixArray([rank], open_))
        want = {(i, p) for p in range(1, len(w) // 2 + 1) for i in range(len(w) - 2 * p + 1)
                if w[i:i + p] == w[i + p:i + 2 * p]
                and (i + 2 * p == len(w) or w[i + 2 * p] != w[i + p])}
        assert set(zip(starts.tolist(), periods.tolist())) == want


def test_no_documents(no_docs):
    for made in (periodic_runs.analyse(no_docs), alignment.align(no_docs),
                 attention_lm.score(no_docs, SMALL)):
        assert made.collect() == []


# ---- alignment

HOW = alignment.Tokenizers()


def plain_alignment(rows):
    encode_a, encode_b = subwords.byte_level(HOW.a), subwords.pieces(HOW.b)
    spell_a, spell_b = subwords.byte_level_spelling(HOW.a), subwords.piece_spelling(HOW.b)
    links, rest = [], []
    for _, text in rows:
        links.append([])
        rest.append((0, 0, 0, ""))
        if not text:
            continue
        whole = (" " + text).encode()
        sides = []
        for ids, spell in ((encode_a(" " + text), spell_a), (encode_b(text), spell_b)):
            at, side = 0, []
            for t in ids:
                side.append((at, at + len(spell[t]), t))
                at += len(spell[t])
            sides.append(side)
            if b"".join(spell[t] for t in ids) != whole:
                break
        else:
            a, b = sides
            groups = []
            for end in sorted({e for _, e, _ in a} & {e for _, e, _ in b}):
                start = groups[-1][0] if groups else 0
                own_a, own_b = ([x for x in s if start < x[1] <= end] for s in sides)
                groups.append((end, own_a, own_b))
                links[-1] += [(x[2], y[2]) for x in own_a for y in own_b
                              if x[0] < y[1] and y[0] < x[1]]
            text = ";".join(",".join(str(x[2]) for x in p) + "|" + ",".join(str(y[2]) for y in q)
                            for _, p, q in groups)
            rest[-1] = len(a), len(b), len(groups), sha(text)
    count = Counter(x for own in links for x in own)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(row[0], *r[:3], len(own), sum(count[x] == most[x[1]] for x in own),
             sum(count[x] for x in own), r[3]) for row, r, own in zip(rows, rest, links)]


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def spelt(spark, edge_rows):
    more = [(30, "<|endoftext|> and </s> are text"), (31, "two  spaces\nand ▁ a mark"),
            (32, "​zero ﬁ width"), (33, "naïve 漢字かな 😀😀 " * 20)]
    rows = [(r[0], (r[1] or "")[:3000] if r[1] is not None else None) for r in edge_rows] + more
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_alignment_equals_plain_version(spelt):
    rows, docs = spelt
    want = Counter(plain_alignment(rows))
    assert sum(r[1] > 0 for r in want) > 10 and sum(r[1] == 0 for r in want) > 3
    for size in (1, 2 << 20):
        got = alignment.align(docs, alignment.Tokenizers(slice_bytes=size))
        assert Counter(tuple(r[c] for c in ALIGNED) for r in got.collect()) == want


def test_links_and_their_counts(spelt):
    docs = spelt[1].where("doc_id IN (4, 16, 33)")
    stats = {r.doc_id: r for r in alignment.align(docs).collect()}
    overlap, group = (Counter(r.doc_id for r in alignment.links(docs, kind=k).collect())
                      for k in ("overlap", "group"))
    assert overlap == {i: r.n_links for i, r in stats.items() if r.n_links}
    assert group == {i: r.n_shared for i, r in stats.items() if r.n_shared}
    with pytest.raises(ValueError):
        alignment.links(docs, kind="other")


def test_products_equal_dense_ones():
    rng = np.random.default_rng(3)
    for _ in range(30):
        left, right = (rng.random(s) < 0.3 for s in ((9, 12), (12, 7)))
        made = [alignment.Csr(np.concatenate(([0], np.cumsum(m.sum(axis=1)))), np.nonzero(m)[1],
                              m.shape[1]) for m in (left, right)]
        dense = left.astype(int) @ right.astype(int)
        for work in (1, 1000):
            got = np.zeros_like(dense)
            for i, j, value in alignment.product(*made, work):
                got[i, j] = value
            assert (got == dense).all()
        back = made[1].transposed()
        turned = np.zeros((7, 12), bool)
        turned[np.repeat(np.arange(7), np.diff(back.bounds)), back.indices] = True
        assert (turned == right.T).all()


def test_codes_survive_packing():
    import pyarrow as pa

    rows = [[], [0, 127, 128], [1 << 14, (1 << 14) - 1, 1 << 21, (1 << 31) - 1], [5] * 200, []]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    made = chunks.packed(np.array(sum(rows, []), np.int64), bounds)
    codes, back = chunks.unpacked(pa.chunked_array([made]))
    assert codes.tolist() == sum(rows, []) and back.tolist() == bounds.tolist()


# ---- language model

def plain_base(rows, folds=7, fold=2):
    def lower(t):
        return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")

    count, tokens = Counter(), []
    for doc_id, text in rows:
        tokens.append([*WORD.findall(lower(text)), None])
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds != fold:
            count.update(tokens[-1])
    n, v = sum(count.values()), len(count)
    return [(i, i is not None and zlib.crc32(str(i).encode()) % folds == fold, len(own),
             sum(count[w] > 0 for w in own), n,
             round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), 5))
            for (i, _), own in zip(rows, tokens)]


def test_base_scores(edge_docs, edge_rows):
    got = attention_lm.score(edge_docs, SMALL).collect()
    assert Counter((*r[:5], round(r.base_score, 5)) for r in got) == Counter(
        plain_base([(r[0], r[1]) for r in edge_rows]))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_held_out_texts_gain_from_the_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    rows = attention_lm.score(docs).collect()
    encode, end = subwords.byte_level(attention_lm.Lm().tokenizer), attention_lm.Lm().end
    texts = {r.doc_id: [*encode(" " + " ".join(WORD.findall(r.text.lower()))), end]
             for r in docs.select("doc_id", "text").collect()}
    count = Counter(t for r in rows if not r.held_out for t in texts[r.doc_id])
    total = sum(count.values()) + end + 1
    held = [r for r in rows if r.held_out]
    plain = sum(math.log10((count[t] + 1) / total) for r in held for t in texts[r.doc_id])
    base, model = sum(r.base_score for r in held), sum(r.score for r in held)
    # far better than the counts of subwords, and near those of whole words, for which all
    # unknown words together are as likely as one
    assert len(held) > 100 and model > 0.8 * plain and model > 1.08 * base


def test_words_have_the_ids_of_the_tokenizer():
    how = attention_lm.Lm()
    plain = subwords.byte_level(how.tokenizer)
    keys = ["the", "ümlaut", "漢字", "a\xa0b", "\xa0", "end.,", attention_lm.END_KEY.decode(), "it's", "😀x"]
    ids, bounds = attention_lm.word_ids([k.encode() for k in keys], how)
    for i, key in enumerate(keys):
        want = [how.end] if key == " " else plain(" " + key)
        assert ids[bounds[i]:bounds[i + 1]].tolist() == want
    codes, ends = np.array([2, 0, 0, 6, 6, 1, 6]), np.array([0, 4, 5, 7])
    texts = attention_lm.gather(ids, bounds, codes, ends)[1:]
    assert [t.tolist() for t in texts] == [
        sum((ids[bounds[c]:bounds[c + 1]].tolist() for c in own), [])
        for own in ([2, 0, 0, 6], [6], [1, 6])]


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    how = attention_lm.Lm(vocabulary=60, singles=20, known=30, buckets=8, groups=4, widest=4,
                          marks=10, steps=30, block=6, before=3, width=8, hidden=8)
    texts = [np.append(np.cumsum(rng.integers(0, 3, rng.integers(0, 40))) % 60, how.end)
             for _ in range(80)]
    pairs = [attention_lm.windows(t, how) for t in texts]
    counts = np.bincount(np.concatenate(texts), minlength=how.ids)
    return attention_lm.fit(np.concatenate([x for x, _ in pairs]),
                            np.concatenate([y for _, y in pairs]), counts, how), texts


def test_probabilities_sum_to_one(model):
    fitted, texts = model
    how, scorer = fitted.how, attention_lm.Scorer(fitted)
    x, _ = attention_lm.windows(max(texts, key=len), how)
    every = np.arange(how.ids)
    y = np.full((how.ids, how.block), -1)
    y[:, how.block - 1] = every
    value = scorer.scores(np.repeat(x[1:2], how.ids, axis=0), y)[:, -1]
    assert np.exp(value).sum() == pytest.approx(1, abs=1e-4)


def test_scores_are_causal_and_cover_each_token_once(model):
    fitted, texts = model
    how, scorer = fitted.how, attention_lm.Scorer(fitted)
    text = max(texts, key=len)
    x, y = attention_lm.windows(text, how)
    assert [t for t in y.reshape(-1).tolist() if t >= 0] == text.tolist()
    value = scorer.scores(x, y).reshape(-1)[:len(text)]
    changed = text.copy()
    changed[12:-1] = (changed[12:-1] + 7) % 60
    other = scorer.scores(*attention_lm.windows(changed, how)).reshape(-1)
    assert value[:12] == pytest.approx(other[:12], abs=1e-5)
    assert scorer.texts([text, text[-1:], text])[[0, 2]] == pytest.approx(
        [value.sum() / np.log(10)] * 2, rel=1e-5)


def test_gradients_match_differences(model):
    fitted, texts = model
    how, p = fitted.how, {k: v.astype(np.float64) for k, v in fitted.params.items()}
    x, y = attention_lm.windows(max(texts, key=len), how)
    truth = np.where(y >= 0, fitted.class_of[np.maximum(y, 0)], -1)
    inputs = fitted.input_of[x]
    _, g = attention_lm.gradients(p, inputs, truth, fitted.bounds, how)
    rng = np.random.default_rng(2)
    for name, value in p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in value.shape)
            kept, ends = value[at], []
            for step in (1e-4, -1e-4):
                value[at] = kept + step
                ends.append(attention_lm.gradients(p, inputs, truth, fitted.bounds, how)[0])
            value[at] = kept
            assert (ends[0] - ends[1]) / 2e-4 == pytest.approx(g[name][at], abs=2e-4)


def test_a_training_step_does_no_work_that_it_drops(model):
    fitted, texts = model
    how, p, bounds = fitted.how, fitted.params, fitted.bounds
    assert attention_lm._mask(how) is attention_lm._mask(how)
    pairs = [attention_lm.windows(t, how) for t in texts]
    x, truth = fitted.rows(*(np.concatenate(v) for v in zip(*pairs)))
    loss, want = attention_lm.gradients(p, x, truth, bounds, how)
    none, got = attention_lm.gradients(p, x, truth, bounds, how, losses=False)
    assert loss > 0 and none == 0
    assert all((got[name] == want[name]).all() for name in want)
    # each target adds its group's shares to the biases of the classes, less one at its own class,
    # also where some groups have one row, or none
    for rows in (slice(0, 1), slice(0, len(x)), slice(0, 0)):
        used = truth[rows][truth[rows] >= 0]
        _, g = attention_lm.gradients(p, x[rows], truth[rows], bounds, how, losses=False)
        sums = np.add.reduceat(g["class_bias"], bounds[:-1])
        assert sums == pytest.approx(np.zeros(len(sums)), abs=1e-5)
        seen = np.isin(np.searchsorted(bounds, np.arange(bounds[-1]), "right"),
                       np.searchsorted(bounds, used, "right"))
        assert (g["class_bias"][~seen] == 0).all() and np.isfinite(g["class"]).all()


def test_the_model_learns_from_every_text(spark):
    # few texts hold a word pair, and a sample of one text in hundreds does not show it
    rng = np.random.default_rng(3)
    word = ["alpha", "bravo", "delta", "gamma", "omega", "sigma", "theta", "kappa"]
    rows = [(i, " ".join(rng.choice(word, 60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    how = attention_lm.Lm(sample_texts=1, per_text=1, steps=5, epochs=1, slice_bytes=1 << 14)
    table = attention_lm.read(docs, how, "doc_id", "text").cache()
    counts = attention_lm.subword_counts(chunks.corpus_counts(table), how)
    learned = [i for i, _ in rows if zlib.crc32(str(i).encode()) % how.folds != how.fold]
    found = attention_lm.neighbours(table, counts, how)
    # each id has a neighbour before it; the ends have none behind
    seen = {r.id: sum(n for _, n in r.near) for r in found.collect()}
    assert sum(seen.values()) == 2 * counts.sum() - len(learned)
    assert seen[how.end] == len(learned)
    of_id = attention_lm.clusters(found, counts, how)
    assert set(np.flatnonzero(of_id < how.groups)) == {i for i, n in seen.items() if n >= 4}
    none = np.zeros((0, how.window), np.int64), np.zeros((0, how.block), np.int64)
    start = attention_lm.fit(*none, counts, how, of_id)
    model = attention_lm.pass_over(table, start)
    texts = [t for r in table.where(chunks.IS_VOCABULARY).select("chunk").collect()
             for t in attention_lm.texts_of(attention_lm.learned(table).where(
                 f"chunk = {r.chunk}").drop("chunk").toArrow())]
    assert sum(map(len, texts)) == counts.sum()
    before, after = (attention_lm.Scorer(m).texts(texts).sum() for m in (start, model))
    assert after > before
    again = attention_lm.pass_over(table, start)
    assert all((again.params[k] == v).all() for k, v in model.params.items())
