import itertools
import random
import re
import time
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow.parquet as pq
import pytest
from brute import personal_data, quality_counts
from pyspark.sql import functions as F

from incidentlab.llm import decontaminate, html_text, langid, pii, quality_rules


def keyed(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# ---- quality rules

def test_quality_counts(edge_docs):
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = Counter()
    for r in edge_docs.collect():
        own = quality_counts(r.text)
        want[(r.doc_id, *own, own[0] < 10 or 100 * own[4] > 20 * own[0])] += 1
    result = quality_rules.judge(edge_docs)
    assert keyed(result, "doc_id", *counts, "base_failed") == want
    assert result.where("base_failed AND kept").isEmpty()


def test_quality_verdict_separates_junk(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = quality_rules.judge(docs).where("NOT base_failed").join(
        spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    rows = {(r.quality, r.kept): r.n for r in judged.groupBy("quality", "kept").agg(
        F.count("*").alias("n")).collect()}
    assert rows.get((1, False), 0) == 0
    assert rows.get((0, False), 0) >= 0.6 * sum(n for (q, _), n in rows.items() if q == 0)


def test_words_without_function_words_are_judged(spark):
    """A long text of words that no list holds is far from texts of the language; a short one and
    an empty table have no verdict."""
    plain = "the {0} of a {0}b was in the {0}c and it is {0}d on by the {0}e".format
    docs = [(i, " ".join(plain(f"w{i}x{j}") for j in range(30)), "en") for i in range(40)]
    docs += [(100, " ".join(f"q{j}z" for j in range(400)), "en"),
             (101, " ".join(f"q{j}z" for j in range(40)), "en"), (102, "", "en"), (103, None, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.judge(table).collect()}
    assert not got[100].kept and not got[100].base_failed and got[100].word_distance > 0.5
    assert got[101].kept and got[101].word_distance is None
    assert all(got[i].kept for i in range(40))
    assert not got[102].kept and not got[103].kept
    assert quality_rules.judge(table.limit(0)).isEmpty()


def test_divergence_is_jensen_shannon(spark):
    p, q = np.array([3.0, 0, 5, 2]), np.array([1.0, 4, 0, 7])
    a, b = p / p.sum(), q / q.sum()
    m = (a + b) / 2

    def kl(x):
        return sum(v * np.log2(v / w) for v, w in zip(x, m) if v > 0)

    got = spark.range(1).select(quality_rules._divergence(
        F.lit(p.tolist()), F.lit(q.tolist())).alias("d")).first().d
    assert got == pytest.approx(np.sqrt((kl(a) + kl(b)) / 2))


def test_quality_stays_in_the_engine(edge_docs):
    plan = quality_rules.judge(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---- personal data

def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    for alphabet in ("12 3.4-@a+(b)._", "0123456789 -+.", "a@.b-%é 1"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            assert pii.base_spans(text) == personal_data(text), text


def test_long_runs_are_read_once():
    for text in ("a" * 300000 + " @", "1" * 300000, "1." * 100000, "+" + "(" * 200000):
        pii.base_spans(text)


def test_field_on_held_out_rows():
    field = pii.train(pii.labelled_table())
    rows = pii.labelled_table(copies=3, seed=77)
    found = pii.field_spans(field, [t for t, _ in rows])
    want = [[s for s in spans if pii._valid(s[0], t[s[1]:s[2]])] for t, spans in rows]
    assert np.mean([a == b for a, b in zip(found, want)]) >= 0.95


#: Sentences whose words, and many of whose forms, are not in the labelled table.
UNSEEN_TEMPLATES = (
    "do not hesitate to phone [phone:(###) ###-####] anytime",
    "voice mail [phone:###-###-####] (24h)", "doctor [phone:0## #######] or nurse",
    "Praxis [phone:0###/#######] sowie", "Mobil: [phone:01## #######],",
    "joindre [phone:0# ## ## ## ##] svp", "teléfono [phone:9## ### ###] de",
    "helpline [phone:0#### ######].", "toll free [phone:1-###-###-####] call",
    "pager [phone:###.###.####] number", "(office [phone:0## #######])",
    "charge [card:4### #### #### ###] twice", "debit [card:4###-####-####-####] blocked",
    "Karte Nr. [card:37## ###### #####] gesperrt", "carte bleue [card:37#############] perdue",
    "router [ip:fe80::#:##] lost", "peer [ip:2001:db8:##::#] joined",
    "dns [ip:2001:0db8:####:####:0000:8a2e:0370:7334] ok",
    "bounce from [email:postmaster@localhost] again", "copied to [email:ops##@buildhost] too",
    "the year 20## had ### days", "about ##,### visitors in ####", "paragraph ##(#) of act ####",
    "won ##:## and lost ##:##", "measured #.### grams in ## trials", "from ##:##:## to ##:##:##",
    "ticket ####### closed", "part ##-####-# in box ##", "item @ #.## each",
    "block ## row ## seat ##", "sha ##b#c##a#e#f##a#b#c##d#e ok", "grid ####.## by ####.##",
    "size ### x ### px", "isbn ###-#-####-####-#",
)


def test_field_on_templates_it_has_not_seen(sf_dir):
    """Values in sentences of their own, each in the middle of prose of the documents."""
    texts = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist()
    prose = [w for t in texts for w in (t or "").split()[:50] if w.isalpha()]
    field, rng = pii.train(pii.labelled_table()), random.Random(2)
    drawn = [row for t in UNSEEN_TEMPLATES for row in itertools.islice(
        (r for _ in range(400) for r in pii.labelled_table(1, rng.random(), (t,))
         if all(pii._valid(k, r[0][a:b]) for k, a, b in r[1])), 4)]
    assert len(drawn) == 4 * len(UNSEEN_TEMPLATES)
    right = wanted = given = 0
    for text, spans in drawn:
        before = " ".join(rng.choices(prose, k=12)) + " "
        whole = before + text + " " + " ".join(rng.choices(prose, k=12))
        base = pii.base_spans(whole)
        found = {s for s in pii.field_spans(field, [whole])[0] if s not in base}
        want = {(k, a + len(before), b + len(before)) for k, a, b in spans} - set(base)
        right, wanted, given = right + len(found & want), wanted + len(want), given + len(found)
    assert right >= 0.8 * wanted
    assert right >= 0.95 * given


def test_spans_open_and_close_their_brackets():
    for text, value in (("(030 1234567)", "030 1234567"), ("(030) 1234567", "(030) 1234567"),
                        ("030 1234567),", "030 1234567"), ("((030) 1234567).", "(030) 1234567"),
                        ("(030", "030"), ("()", "")):
        a, b = pii._trimmed(text, 0, len(text))
        assert text[a:b] == value
    assert pii._trimmed("(" * 300000 + "7", 0, 300001) == (300000, 300001)


def test_values_at_any_place_of_a_run_of_numbers():
    field = pii.train(pii.labelled_table())
    for value in ("tel. (555) 123-4567 today", "le 01 23 45 67 89 avant",
                  "amex 37## ###### ##### paid"):
        if "#" in value:
            value = next(v for v in (value.replace("37##", "3782").replace("######", "822463", 1)
                                     .replace("#####", f"1{n:04d}") for n in range(10000))
                         if pii.luhn(pii._digits(v)))
        for before in range(66):
            text = "row 12 " * (before // 2) + "12 " * (before % 2) + value + " row 12" * 40
            spans = {text[a:b] for _, a, b in pii.field_spans(field, [text])[0]}
            assert any(s in value and sum(c.isdigit() for c in s) == sum(c.isdigit() for c in value)
                       for s in spans), (before, value, spans)


def test_segments_of_one_run_give_the_labels_of_the_whole(monkeypatch):
    field, rng, rows = pii.train(pii.labelled_table()), random.Random(9), pii.labelled_table(1)
    values = [text[a:b] for text, spans in rows for _, a, b in spans]
    texts = [" ".join(f"{rng.choice(('tel.', 'row', 'fax'))} {rng.choice(values)}" for _ in range(90))
             for _ in range(10)]
    assert any(more for _, more in pii.segments(texts[0]))
    cut = pii.field_spans(field, texts, batch=3)
    monkeypatch.setattr(pii, "SEGMENT", 10**6)
    assert cut == pii.field_spans(field, texts)


def test_added_spans_meet_no_other():
    rng = random.Random(6)
    for _ in range(2000):
        known = [(a, a + rng.randrange(1, 9)) for a in rng.sample(range(60), rng.randrange(6))]
        more = sorted((a, a + rng.randrange(1, 9)) for a in rng.sample(range(60), rng.randrange(6)))
        taken, want = pii._Taken(iter(known)), list(known)
        for a, b in more:
            free = not any(a < e and s < b for s, e in want)
            assert taken.free(a, b) == free
            if free:
                want.append((a, b))


def test_many_numbers_take_linear_time():
    field = pii.train(pii.labelled_table())
    times = []
    for n in (4000, 16000):
        text = " ".join(f"tel. 030 {i % 9}{i:06d} office" for i in range(n))
        start = time.process_time()
        _, spans = pii.find(field, [text])[0]
        times.append(time.process_time() - start)
        assert len(spans) > n / 2
    assert times[1] < 8 * times[0]


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(4)
    n = len(pii.LABELS)
    field = pii.Field({"a": 0, "b": 1}, rng.normal(size=(3, n)), rng.normal(size=(n, n)))
    legal = pii._legal()
    for names in ([["a"]], [["a"], ["b"]], [["b"], ["x"], ["a"]]):
        best, top = None, -np.inf
        for path in np.ndindex(*[n] * len(names)):
            if pii.LABELS[path[0]][0] == "I":
                continue
            score = sum(field.emit[[field.index.get(f, 2) for f in fs], y].sum()
                        for fs, y in zip(names, path))
            score += sum(field.move[a, b] + legal[a, b] for a, b in zip(path, path[1:]))
            if score > top:
                best, top = list(path), score
        assert pii.viterbi(field, [names, [["a"]]])[0] == best


def test_detect_and_mask(spark, edge_docs, no_docs):
    text = "write a.b@c-d.org or +1 (017) 555-7713, server 10.0.0.1, tel. 030 1234567 office"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (3, "plain")],
                                 "doc_id long, text string")
    rows = pii.detect(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter([1, 1, None, 2, 3])
    first = next(r for r in rows if r.doc_id == 1)
    assert (first.n_email, first.n_ip, first.n_card, first.n_phone) == (1, 1, 0, 1)
    assert len(first.spans.split(",")) == 4
    masked, nothing = pii.masker()([text, None])
    assert nothing is None and masked.count("<") == 4 and "555" not in masked
    assert pii.detect(edge_docs).count() == edge_docs.count()
    assert pii.detect(no_docs).collect() == []


# ---- language

def test_language_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.join(langid.identify(docs), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_never_reads_the_label_of_what_it_predicts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hidden = docs.withColumn("lang", F.when(~langid.held_out("doc_id"), F.col("lang")))
    columns = ("doc_id", "lang_pred", "score")
    assert keyed(langid.identify(docs), *columns) == keyed(langid.identify(hidden), *columns)


def test_language_edges(edge_docs, no_docs):
    rows = langid.identify(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        if r.doc_id in (1, 2, 3, 22):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred in ("en", "de")
    assert langid.identify(no_docs).collect() == []
    plain = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(plain).collect()} == {"und"}


def test_every_label_is_learned(spark):
    """More labels than any list of the most frequent ones would hold, the last of them rare."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(100 * k + i, " ".join(letters[k % 26] + letters[(k // 26 + j) % 26] for j in range(9)),
             f"l{k:02}") for k in range(70) for i in range(2 if k == 69 else 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.Net(steps=1)
    assert langid.train(docs, net).langs == [f"l{k:02}" for k in range(70)]
    assert len(langid.train(docs, replace(net, sample_rows=100)).langs) == 69


def test_windows_hold_every_byte():
    net = langid.Net()
    for n in (0, 1, 124, 125, 126, 128, 129, 1000):
        body = bytes(i % 250 + 1 for i in range(n))
        windows = langid._windows(body, net)
        grams = {bytes(body[i:i + 4]) for i in range(n - 3)}
        assert grams <= {bytes(w[i:i + 4]) for w in windows for i in range(len(w) - 3)}


# ---- benchmark passages

def words(text):
    return re.findall(r"\w+", text.lower())


def best_window(text, item, k=5):
    a, b = words(text), words(item)
    k, n = min(k, len(b)), min(len(a), len(b))
    own = Counter(tuple(b[j:j + k]) for j in range(len(b) - k + 1))
    top = 0.0
    for s in range(len(a) - n + 1):
        win = Counter(tuple(a[j:j + k]) for j in range(s, s + n - k + 1))
        common = sum((own & win).values())
        top = max(top, common / max(1, sum(own.values()) + sum(win.values()) - common))
    return top


def test_contamination_against_all_windows(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(80)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((3, 12, 30, 45)))))
             for i in range(25)]
    items += [(25, items[0][1]), (26, None), (27, ""), (28, "?!")]
    docs = []
    for i in range(120):
        body = [rng.choice(vocabulary) for _ in range(60)]
        passage = words(rng.choice(items[:25])[1])
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            passage[rng.randrange(len(passage))] = "changed"
        at = rng.randrange(60)
        docs.append((i, " ".join(body[:at] + passage + body[at:]).title()))
    docs += [(500, None), (501, ""), (None, items[3][1]), (502, items[5][1][:-2])]
    want = {(d, i) for d, t in docs for i, x in items if t and x and words(x)
            and best_window(t, x) >= 0.8}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for how in (decontaminate.Match(), decontaminate.Match(block_bytes=300),
                decontaminate.Match(block_items=2)):
        rows = decontaminate.matches(frame, bench, how).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want
    texts = dict(docs)
    for r in rows:
        passage = texts[r.doc_id][r.start:r.end]
        assert best_window(passage, dict(items)[r.item_id]) == pytest.approx(r.similarity)
    kept = {r.doc_id for r in decontaminate.clean(frame, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_index_holds_all_within_the_radius_and_little_else():
    rng, how = np.random.default_rng(4), decontaminate.Match()
    size = decontaminate._Size(
        60, [(i, rng.integers(1, 1 << 40, 60).astype(np.uint64)) for i in range(200)], how)
    for i in range(200):
        near = size.prints[i].copy()
        for bit in rng.choice(16 * how.blocks, how.radius, replace=False):
            near[bit // 16] ^= np.uint16(1 << bit % 16)
        for prints in (near[None], np.stack([near, near])):
            windows, found = size.candidates(prints)
            assert [w for w, j in zip(windows, found) if j == i] == list(range(len(prints)))
    far = rng.integers(0, 1 << 16, (500, how.blocks)).astype(np.uint16)
    assert len(size.candidates(far)[0]) == 0
    free = replace(how, radius=16 * how.blocks)  # what the look-up alone lets through
    size.how = free
    assert len(size.candidates(far)[0]) < 0.05 * 500 * 200


def test_radius_holds_windows_of_the_similarity():
    rng, how, seen = np.random.default_rng(5), decontaminate.Match(), 0
    for _ in range(400):
        item = rng.integers(1, 1 << 40, 60).astype(np.uint64)
        window = item.copy()
        window[rng.integers(0, 60, rng.integers(1, 4))] = rng.integers(1 << 41, 1 << 42)
        a, b = (decontaminate._shingles(x, how.shingle) for x in (item, window))
        common = len(set(a.tolist()) & set(b.tolist()))
        if common / (2 * len(a) - common) >= how.similarity:
            x, y = decontaminate._fingerprints(np.stack(
                [decontaminate._signs(s, how.blocks).sum(axis=0) for s in (a, b)]))
            assert np.bitwise_count(x ^ y).sum() <= how.radius
            seen += 1
    assert seen > 50


def test_contamination_edges(edge_docs, no_docs, spark):
    bench = spark.createDataFrame([(1, "zzz yyy xxx www vvv uuu")], "item_id long, text string")
    assert decontaminate.matches(edge_docs, bench).collect() == []
    assert decontaminate.clean(edge_docs, bench).count() == edge_docs.count()
    assert decontaminate.matches(edge_docs, bench.limit(0)).collect() == []
    assert decontaminate.matches(no_docs, bench).collect() == []


# ---- pages

PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><header>Site name</header>
<div id="main-menu"><a href=x>one</a> <a>two</a></div><div class="cookie-notice">We use cookies</div>
{body}<form>Name <input></form><aside>Aside words</aside>
<section id="comments"><p>A reader's comment that is as long as any paragraph of the article is,
and longer.</p></section><footer>Foot</footer></body></html>"""
LONG = "A paragraph with enough words to be told from what stands around it on the page. "


def test_article_and_plain_layouts():
    inner = (f"<h1>Head &amp; line</h1><p>{LONG}<b>bo</b>ld\n  text<p>Short.<ul><li>item a<li>item b"
             f"</ul><table><tr><td>c1<td>c2</table><script>x()</script><p>{LONG * 2}</p>"
             "<div class='ad'>Buy</div>")
    want = " ".join(("Head & line", (LONG + "bold text"), "Short.", "item a", "item b", "c1", "c2",
                     (LONG * 2).strip()))
    for body in (f"<article>{inner}</article>", f"<main>{inner}</main>",
                 f"<div class='content'>{inner}</div>"):
        assert html_text.main_text(PAGE.format(body=body)) == want


def test_layout_words_on_the_article():
    body = (f"<main class='with-sidebar'><div class='article-header'><h1>Title</h1></div><p>{LONG}</p>"
            f"<article class='comment'><p>{LONG}</p></article><div class='share-bar'>Share</div></main>")
    assert html_text.main_text(PAGE.format(body=body)) == "Title " + LONG.strip()


@pytest.mark.parametrize("name", [
    "content has-sidebar", "no-sidebar", "site-with-header", "comments-open", "content sidebar-left",
    "share-enabled"])
def test_articles_in_marked_wrappers(name):
    want = "Title " + LONG.strip()
    inner = f"<h1>Title</h1><p>{LONG}</p>"
    for body in (f"<article>{inner}</article>", f"<main>{inner}</main>"):
        page = f"<div class='{name}'>{body}<div class='sidebar'><p>{LONG}</p></div></div>"
        assert html_text.main_text(PAGE.format(body=page)) == want
    page = f"<div class='{name}'>{inner}<p>{LONG * 5}</p></div>"
    assert html_text.main_text(PAGE.format(body=page)) == want + " " + (LONG * 5).strip()


def test_boilerplate_wrappers_with_articles_stay_out():
    body = (f"<div id='comments'><article><p>{LONG * 3}</p></article></div>"
            f"<div class='related'><article>{LONG * 3}</article></div>")
    for own in (f"<article><p>{LONG}</p></article>", f"<div class='content'><p>{LONG}</p></div>"):
        assert html_text.main_text(PAGE.format(body=own + body)) == LONG.strip()
    assert html_text.main_text("<div class='cookie-notice'>We use cookies</div>") == ""


@pytest.mark.parametrize("title", ["Search", "Social media", "Related work", "Notice", "Menu", "Form"])
def test_ids_made_from_headings(title):
    name = title.lower().replace(" ", "-")
    want = f"Top {LONG.strip()} {title} {LONG.strip()}"
    for part in (f"<h2 id='{name}'>{title}</h2><p>{LONG}</p>",
                 f"<h2><span id='{name}'>{title}</span></h2><p>{LONG}</p>",
                 f"<section id='{name}'><h2>{title}</h2><p>{LONG}</p></section>"):
        body = (f"<article><h1>Top</h1><p>{LONG}</p>{part}"
                f"<section id='comments'><h2>Comments</h2><p>{LONG}</p></section></article>")
        assert html_text.main_text(PAGE.format(body=body)) == want


@pytest.mark.parametrize("page, want", [
    (f"<form id='aspnetForm'><nav><a>one</a></nav><article><p>{LONG * 3}</p></article></form>", LONG * 3),
    (f"<form id='aspnetForm'><div><p>{LONG * 3}</p></div></form>", LONG * 3),
    (f"<nav><a href=x>one</a><article><p>{LONG}</p></article>", LONG),
    (f"<nav>Menu</nav><form>Name<input></form><article><p>{LONG}</p></article>", LONG),
    (f"<article><p><a class='related'>See it</a> {LONG}</p></article>", "See it " + LONG),
    (f"<article><p>{LONG}<span class='ad'>Buy</span></p><a class='share'>Share</a></article>", LONG),
    ("<article><pre><code>x <span class='hljs-comment'># note</span> <span class='token comment'>y"
     f"</span></code></pre><p>{LONG}</p></article>", "x # note y " + LONG)])
def test_forms_menus_and_inline_words(page, want):
    assert html_text.main_text(page) == want.strip()


def test_clusters_choose_the_regions():
    """Without two clusters, everything would be one region."""
    teasers = "".join(f"<article><a href=x{i}>Teaser number {i}</a></article>" for i in range(4))
    links = "".join(f"<div><a href=y{i}>Elsewhere {i}</a></div>" for i in range(6))
    text = f"<p>{LONG * 4}</p><p>{LONG * 3}</p>"
    off = html_text.Extraction(apart=float("inf"))
    for page in (f"{teasers}<div>{text}</div>{links}", f"{links}<div>{text}</div>{links}",
                 f"{teasers}<article>{text}</article>{links}"):
        assert html_text.main_text(page) == (LONG * 7).strip()
        assert html_text.main_text(page, off) != (LONG * 7).strip()


def test_deep_pages_take_linear_memory():
    import tracemalloc

    for page in ("<div>" * 100000 + "deep", "<div class='menu'>" * 20000 + "deep " * 100,
                 "<div>" * 50000 + "</b>" * 50000 + "<li>x" * 50000):
        tracemalloc.start()
        assert html_text.main_text(page)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 400 * len(page)


def test_pages_of_the_table(spark, sf_dir):
    import html

    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        article = re.sub(r"</?(p|br|h1)\b[^>]*>", " ", article)
        article = html.unescape(re.sub(r"<[^>]*>", "", article))
        assert html_text.main_text(r.html) == " ".join(article.split())


def test_page_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>a"), (3, "u", "no markup"), (3, "u", "no markup"),
            (4, "u", "<" * 50000), (5, "u", "<div>" * 3000 + "deep"), (6, "u", "</p></div><b>&#x41;")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn(
        "text", F.lit("clash"))
    got = {(r.page_id, r.text) for r in html_text.extract(pages).collect()}
    assert {(1, ""), (2, ""), (None, "a"), (3, "no markup"), (5, "deep"), (6, "A")} <= got
    assert html_text.extract(pages.limit(0)).collect() == []
