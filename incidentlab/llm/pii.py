"""Personal data in texts: fixed patterns, and a linear-chain conditional random field.

Patterns give the base spans. The random field reads words around digits and @ signs by their
shapes, is trained on a small labelled table and decoded by Viterbi over batches of segments in
numpy. Its spans are added where they meet no base span; base spans always stay.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# ---- base patterns, each in one pass over the text

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from each @: its local part is the run of allowed characters before
    it, which no other @ interrupts, so that long runs are read once."""
    free, at = 0, text.find("@")
    while at >= 0:
        host = _DOMAIN.match(text, at + 1) if at + 1 < len(text) else None
        local = text[free:at]
        size = len(local) - len(local.rstrip(_LOCAL))
        if host and size:
            yield "email", at - size, host.end()
            free = host.end()
        else:
            free = at + 1
        at = text.find("@", free)


def _ips(text: str) -> Iterator[Span]:
    """Within a run of numbers joined by points, matches are its successive groups of four."""
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            own = parts[k:k + 4]
            size = sum(map(len, own)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in own):
                yield "ip", at, at + size
            at += size + 1


def base_spans(text: str) -> list[Span]:
    """Base spans by kind as listed, then by start."""
    if not _TRIGGER.search(text):
        return []
    out = list(_emails(text)) + list(_ips(text))
    for m in _CARD.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() < 64 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# ---- the labelled table

#: Sentences with marked spans; # is a digit. They stand for the ways such values are written.
TEMPLATES = (
    "tel. [phone:0## #######] office", "call [phone:(###) ###-####] today",
    "phone [phone:###-###-####] or mail", "Telefon [phone:0##/#######] bitte",
    "fon: [phone:(0##) ### ## ##].", "mobile [phone:0#### ######] only",
    "appelez le [phone:0# ## ## ## ##] avant", "tél [phone:0#.##.##.##.##] ou",
    "llame al [phone:9## ### ###] hoy", "fax [phone:###.###.####] and",
    "reach me at [phone:1-###-###-####] please", "whatsapp [phone:+## ### #######] now",
    "the of [phone:+# (###) ###-####] and in", "ring [phone:(+##) ### ######] at",
    "amex [card:37## ###### #####] paid", "card number [card:37#############] expires",
    "visa [card:4###-####-####-####] expires", "karte [card:################] und",
    "the and [card:################] of the", "carte [card:#### #### #### ####] pour",
    "server [ip:2001:db8::#:##] answered", "host [ip:fe80::#a#b:##ff:fe##:####] up",
    "from [ip:2001:0db8:85a3:0000:0000:8a2e:0370:####] to", "login from [ip:10.#.##.##] at",
    "und [ip:##.###.##.##] im", "mail [email:root@localhost] for help",
    "write to [email:user##@mailhost] now", "the [email:is.##@mail#.example.com] and of",
    "order ######## was shipped", "invoice no. ####-### of", "on 20##-0#-1# at 1#:## we",
    "version #.#.# of the", "licensed under CC BY-NC 4.0. and", "License, version 3. The",
    "page ### of ###", "total ##.## euro for # pieces", "in 20## and 19## the",
    "token = \"#a##b#c###d#e##f#a#bc#d##e#f##a#bc#d##e#\" the",
    "key ##a#f#e#######b#c#d#e#f##a#b of", "room ### on floor #", "isbn 978-#-##-######-# print",
    "serial ##-####-##-#### in", "the #### of and", "row ## | ### | #### | ##",
    "### words and ## lines", "sku ###-##-#### stock", "lot ####### batch ##### done",
    "#,###,### people in ####", "§ ## abs. # satz #", "a #.## percent rise", "follow @user## there",
    "@media print and @##", "price @ ##.## each", "1#:##:## elapsed ### ms", "ratio ##:## in ####",
    "reference ########## of the file", "id ############ in the", "case ##/#### und der",
)


def labelled_table(copies: int = 8, seed: float = 5,
                   templates: tuple[str, ...] = TEMPLATES) -> list[tuple[str, list[Span]]]:
    """The default training table: each template with ``copies`` draws of its digits."""
    rng, rows = random.Random(seed), []
    for template in templates:
        for _ in range(copies):
            filled = re.sub("#", lambda _: rng.choice("0123456789"), template)
            text, spans, at = "", [], 0
            for m in re.finditer(r"\[(\w+):(.*?)\](?=[ .,)]|$)", filled):
                text += filled[at:m.start()]
                spans.append((m.group(1), len(text), len(text) + len(m.group(2))))
                text += m.group(2)
                at = m.end()
            rows.append((text + filled[at:], spans))
    return rows


# ---- words, segments and features

_WORD = re.compile(r"\S+")
_EDGE = ".,;:!?\"'*#$%&|<>=[]{}"
#: Groups of hexadecimal digits between colons, with an empty group or a letter: not a time of day.
_GROUPS = re.compile(r"(?=.*(?:::|[a-f]))[0-9a-f]{0,4}(?::[0-9a-f]{0,4}){2,7}")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Words on each side of a word with a digit or @ that its segment takes in.
CONTEXT = 2
#: Words of one segment; a longer run of numbers goes on in the next one.
SEGMENT = 64
#: Words that two segments of one run share. Labels are taken over where both agree, near the middle.
OVERLAP = 32


def segments(text: str) -> Iterator[tuple[list[tuple[int, int]], bool]]:
    """Places of words around digits and @ signs, and whether the run goes on in the next segment.
    Words elsewhere carry no label but O."""
    words: list[tuple[int, int]] = []
    wanted = -1
    for m in _WORD.finditer(text):
        words.append(m.span())
        if _TRIGGER.search(text, *m.span()):
            wanted = len(words) + CONTEXT
        elif wanted < 0:
            del words[:-CONTEXT]
        if len(words) == wanted:
            yield words, False
            words, wanted = words[-CONTEXT:], -1
        elif wanted > 0 and len(words) >= SEGMENT:
            yield words, True
            wanted -= len(words) - OVERLAP
            words = words[-OVERLAP:]
    if wanted > 0:
        yield words, False


def _take_over(old: list[int], new: list[int]) -> int:
    """From which of the shared words on the later segment's labels count: the one nearest to the
    middle where no span goes on, in both if possible with one label."""

    def rank(k: int) -> tuple:
        a, b = LABELS[old[k]], LABELS[new[k]]
        return a[0] == "I" or b[0] == "I", a != b, abs(k - len(old) // 2)

    return min(range(len(old)), key=rank)


def _shape(word: str) -> str:
    return re.sub(r"[^\W\d_]", "a", re.sub("[0-9]", "9", word.lower()))


def features(words: list[str]) -> list[list[str]]:
    """Names of what holds at each word: its shape, long and short, and its neighbours."""
    bare = [w.strip(_EDGE)[:48] for w in words]
    shapes = [_shape(w) for w in bare]
    short = [re.sub(r"(.)\1+", r"\1", s) for s in shapes]
    lower = [w.lower().strip("().,;:!?")[:16] if not _TRIGGER.search(w) else "9" for w in bare]
    out = []
    for i, word in enumerate(bare):
        n = sum(c in "0123456789" for c in word)
        before = short[i - 1] if i else "^"
        after = short[i + 1] if i + 1 < len(words) else "$"
        out.append([
            "bias", "s=" + shapes[i][:24], "c=" + short[i][:24], f"n={min(n, 20)}",
            "w-=" + (lower[i - 1] if i else "^"), "w+=" + (lower[i + 1] if i + 1 < len(words)
                                                            else "$"),
            "w=" + lower[i], "c-=" + before[:16] + "/" + short[i][:16],
            "c+=" + short[i][:16] + "/" + after[:16], "hex" if n and re.fullmatch(
                "[0-9a-f]{12,}", word.lower()) and not word.isdigit() else "nohex",
            "groups" if _GROUPS.fullmatch(word.lower()) else "nogroups",
        ])
    return out


# ---- the random field

@dataclass
class Field:
    """Weights of feature and label, of label after label, and the features' numbers."""

    index: dict[str, int]
    emit: np.ndarray
    move: np.ndarray


def _legal() -> np.ndarray:
    """Added to transitions: a span goes on only after its beginning or its inside."""
    bad = np.zeros((len(LABELS), len(LABELS)))
    for j, label in enumerate(LABELS):
        if label[0] == "I":
            bad[:, j] = -1e4
            bad[[LABELS.index("B-" + label[2:]), j], j] = 0
    return bad


def _codes(text: str, spans: list[Span], words: list[tuple[int, int]]) -> list[int]:
    out = []
    for a, b in words:
        label = "O"
        for kind, s, e in spans:
            if a < e and s < b:
                label = ("B-" if a <= s else "I-") + kind
        out.append(LABELS.index(label))
    return out


def train(rows: list[tuple[str, list[Span]]], epochs: int = 15, rate: float = 0.3,
          decay: float = 1e-4, seed: int = 3) -> Field:
    """Maximum likelihood by Adagrad over the labelled rows (a small table, whole on the driver)."""
    index: dict[str, int] = {}
    data = []
    for text, spans in rows:
        for words, _ in segments(text):
            names = features([text[a:b] for a, b in words])
            data.append(([[index.setdefault(f, len(index)) for f in fs] for fs in names],
                         _codes(text, spans, words)))
    n, legal = len(LABELS), _legal()
    emit, move = np.zeros((len(index) + 1, n)), np.zeros((n, n))
    squares = [np.full_like(emit, 1e-8), np.full_like(move, 1e-8)]
    first = np.array([-1e4 if x[0] == "I" else 0.0 for x in LABELS])
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(data)
        for rows_, truth in data:
            scores = np.array([emit[f].sum(axis=0) for f in rows_])
            scores[0] += first
            trans = move + legal
            size = len(truth)
            alpha, beta = scores.copy(), np.zeros_like(scores)
            for t in range(1, size):
                alpha[t] += _logsum(alpha[t - 1][:, None] + trans, 0)
            for t in range(size - 2, -1, -1):
                beta[t] = _logsum(trans + (scores[t + 1] + beta[t + 1])[None, :], 1)
            total = _logsum(alpha[-1][:, None], 0)[0]
            grad = np.exp(alpha + beta - total)
            grad_move = np.zeros_like(move)
            for t in range(1, size):
                grad_move += np.exp(alpha[t - 1][:, None] + trans
                                    + (scores[t] + beta[t])[None, :] - total)
                grad_move[truth[t - 1], truth[t]] -= 1
            grad[np.arange(size), truth] -= 1
            squares[1] += grad_move**2
            move -= rate * (grad_move + decay * move) / np.sqrt(squares[1])
            for t, fs in enumerate(rows_):
                squares[0][fs] += grad[t]**2
                emit[fs] -= rate * (grad[t] + decay * emit[fs]) / np.sqrt(squares[0][fs])
    return Field(index, emit, move)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def viterbi(field: Field, batch: list[list[list[str]]]) -> list[list[int]]:
    """Best labels of each segment; segments of a batch go through the steps together."""
    longest, n, unknown = max(map(len, batch)), len(LABELS), len(field.index)
    scores = np.zeros((len(batch), longest, n))
    for i, names in enumerate(batch):
        for t, fs in enumerate(names):
            scores[i, t] = field.emit[[field.index.get(f, unknown) for f in fs]].sum(axis=0)
    trans = field.move + _legal()
    best = scores[:, 0] + np.array([-1e4 if x[0] == "I" else 0.0 for x in LABELS])
    sizes = np.array([len(x) for x in batch])
    back = np.zeros((longest, len(batch), n), np.int64)
    for t in range(1, longest):
        paths = best[:, :, None] + trans[None]
        back[t] = paths.argmax(axis=1)
        new = np.take_along_axis(paths, back[t][:, None], 1)[:, 0] + scores[:, t]
        best = np.where((sizes > t)[:, None], new, best)
    last = best.argmax(axis=1)
    out = []
    for i, size in enumerate(sizes):
        labels = [int(last[i])]
        for t in range(size - 1, 0, -1):
            labels.append(int(back[t, i, labels[-1]]))
        out.append(labels[::-1])
    return out


def _valid(kind: str, value: str) -> bool:
    digits = _digits(value)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and re.fullmatch(r"[0-9+() ./-]+", value) is not None
    if kind == "ip":
        return value.count(":") >= 2 and re.fullmatch("[0-9A-Fa-f:]+", value) is not None
    return 1 <= value.find("@") < len(value) - 1


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A span without marks at its edges and without brackets that it does not open and close
    itself, or that enclose the whole of it."""
    open_, partner = [], {}
    for i in range(a, b):
        if text[i] == "(":
            open_.append(i)
        elif text[i] == ")" and open_:
            partner[i] = open_.pop()
            partner[partner[i]] = i
    while a < b:
        if text[b - 1] in _EDGE or text[b - 1] == ")" and b - 1 not in partner:
            b -= 1
        elif text[a] in _EDGE or text[a] == "(" and a not in partner:
            a += 1
        elif text[a] == "(" and partner[a] == b - 1:
            a, b = a + 1, b - 1
        else:
            break
    return a, b


def field_spans(field: Field, texts: list[str], batch: int = 512) -> list[list[Span]]:
    """Valid spans that the random field finds in each text."""
    out: list[list[Span]] = [[] for _ in texts]
    waiting: list[tuple[int, list[tuple[int, int]], bool]] = []
    run: tuple[list, list] | None = None  # words and labels of a run that goes on

    def flush() -> None:
        nonlocal run
        if not waiting:
            return
        named = [features([texts[i][a:b] for a, b in words]) for i, words, _ in waiting]
        for (i, words, more), labels in zip(waiting, viterbi(field, named)):
            if run is not None:
                k = _take_over(run[1][-OVERLAP:], labels[:OVERLAP])
                run[0][k - OVERLAP:], run[1][k - OVERLAP:] = words[k:], labels[k:]
                words, labels = run
            run = (words, labels) if more else None
            if more:
                continue
            text, t = texts[i], 0
            while t < len(labels):
                kind, end = LABELS[labels[t]][2:], t + 1
                if not kind:
                    t = end
                    continue
                while end < len(labels) and LABELS[labels[end]] == "I-" + kind:
                    end += 1
                a, b = _trimmed(text, words[t][0], words[end - 1][1])
                if a < b and _valid(kind, text[a:b]):
                    out[i].append((kind, a, b))
                t = end
        waiting.clear()

    for i, text in enumerate(texts):
        if _TRIGGER.search(text):
            for words, more in segments(text):
                waiting.append((i, words, more))
                if len(waiting) >= batch:
                    flush()
    flush()
    return out


class _Taken:
    """Places that spans cover: those known at first, joined where they overlap, and those taken
    since, which come in the order of their starts."""

    def __init__(self, places: Iterator[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.last = 0
        for a, b in sorted(places):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        """Whether nothing covers a part of it; if so it is taken."""
        k = bisect.bisect_left(self.starts, b)
        if a < self.last or (k and self.ends[k - 1] > a):
            return False
        self.last = b
        return True


def find(field: Field, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """For each text the base spans and all spans, by kind as listed, then by start."""
    result = []
    for text, more in zip(texts, field_spans(field, texts)):
        base = base_spans(text)
        spans, taken = set(base), _Taken((a, b) for _, a, b in base)
        for kind, a, b in more:
            if taken.free(a, b):
                spans.add((kind, a, b))
        result.append((base, sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return result


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
           labelled: list[tuple[str, list[Span]]] | None = None) -> DataFrame:
    """Per row: id, base counts by kind, the base spans' digest and all spans.

    A null text is empty and has no spans. Null ids and repeated rows stay; other columns are
    ignored. No rows give no rows. Texts of any length are read whole.
    """
    field = train(labelled or labelled_table())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [v or "" for v in batch.column(1).to_pylist()]
            found = find(field, texts)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64())
                      for k in KINDS]
            digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digests, pa.string()),
                 pa.array([joined(spans) for _, spans in found], pa.string())],
                [id_col, *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text].alias("text")).mapInArrow(
        read, f"`{id_col}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS)
        + ", base_sha256 string, spans string")


def masker(labelled: list[tuple[str, list[Span]]] | None = None) -> Callable[[list], list]:
    """A function that writes a placeholder like <EMAIL> over every span of its texts."""
    field = train(labelled or labelled_table())

    def mask(texts: list[str | None]) -> list[str | None]:
        out = []
        for text, (_, spans) in zip(texts, find(field, [t or "" for t in texts])):
            parts, at = [], 0
            for a, b, kind in sorted((a, b, k) for k, a, b in spans):
                if b <= at:
                    continue
                parts += [text[at:max(a, at)], f"<{kind.upper()}>"]
                at = b
            out.append(text if not spans else "".join([*parts, text[at:]]))
        return out

    return mask
