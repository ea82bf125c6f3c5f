"""Plain versions of the contracts, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
LAST = 2**63 - 1


def ordered(rows):
    """(id, text) pairs by id, null ids last, each distinct pair once."""
    return sorted({(LAST if i is None else i, t or "") for i, t in rows})


def dedup_bytes(rows, size=50):
    first = {}
    for i, text in ordered(rows):
        body = text.encode()
        for p in range(len(body) - size + 1):
            first.setdefault(body[p:p + size], i)
    out = {}
    for i, text in ordered(rows):
        body = text.encode()
        gone = bytearray(len(body))
        for p in range(len(body) - size + 1):
            if first[body[p:p + size]] < i:
                gone[p:p + size] = b"\1" * size
        kept = bytes(b for b, g in zip(body, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i, text] = (len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def dedup_words(rows, depth=20):
    first = {}
    for i, text in ordered(rows):
        words = WORD.findall(text)
        for p in range(len(words) - depth + 1):
            key = tuple(words[p:p + depth])
            first[key] = min(first.get(key, (i, p)), (i, p))
    out = {}
    for i, text in ordered(rows):
        words = WORD.findall(text)
        gone = set()
        for p in range(len(words) - depth + 1):
            if first[tuple(words[p:p + depth])] < (i, p):
                gone.update(range(p, p + depth))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[i, text] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingle_set(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[j:j + k]) for j in range(len(words) - k + 1))


def join_sets(rows, k, percent):
    """(id, text) to (set size, least id reachable); rows with one id are one document."""
    sets = {(i, t): shingle_set(t, k) for i, t in rows if i is not None}
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    lists = defaultdict(list)
    for node, own in sets.items():
        for s in own:
            lists[s].append(node)
    for node, own in sets.items():
        shared = Counter(n for s in own for n in lists[s])
        for other, common in shared.items():
            if 100 * common >= percent * (len(own) + len(sets[other]) - common):
                a, b = root(node[0]), root(other[0])
                parent[max(a, b)] = min(a, b)
    out = {node: (len(own), root(node[0])) for node, own in sets.items()}
    for i, t in rows:
        if i is None:
            out[i, t] = (len(shingle_set(t, k)), None)
    return out


def quality_counts(text, k=5):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + k]) for i in range(len(words) - k + 1)]
    often = Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(k)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(repeated))


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))
               for i, c in enumerate(reversed(digits))) % 10 == 0


def personal_data(text):
    found = [("email", m) for m in
             re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m))
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [(kind, m.start(), m.end()) for kind, m in found]
