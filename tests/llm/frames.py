"""Documents with every odd case at once, and plain-Python counterparts of the operators."""

from __future__ import annotations

import re
from collections import defaultdict

LONG = " ".join(f"word{i % 997} tail{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))

ROWS = [
    (None, f"a row without an id but with words enough to count {PASSAGE}", "en", "s", None),
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t \n", "en", None, 5),
    (4, LONG, "en", "s", len(LONG)),
    (5, f"one text of several lines\nand {PASSAGE}\nthe end of it all comes here", "en", "s", 1),
    (5, f"one text of several lines\nand {PASSAGE}\nthe end of it all comes here", "en", "s", 1),
    (5, "the same id with another text, which is longer than some", "en", "s", 1),
    (6, f"one text of several lines\nand {PASSAGE}\nthe end of it all comes here", "de", "t", 1),
    (7, f"other words first, then {PASSAGE} and then other words", "de", "t", 1),
    (8, "zażółć gęślą jaźń 日本語 😀 \x00 é ﬁn", "de", "t", 1),
    (9, "x" * 5000, None, "t", 1),
]
NAMES = ["id", "th", "row", "raw", "n", "label", "shard", "gone"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)


def odd(spark):
    """Odd rows, with extra columns named as the operators name theirs."""
    return spark.createDataFrame([(*r, *NAMES) for r in ROWS], SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def kept_words(docs, size=20):
    """doc_id -> words left, for unique ids."""
    first, out = {}, {}
    for id_, text in sorted(docs):
        w = words(text)
        gone = set()
        for s in range(len(w) - size + 1):
            window = tuple(w[s: s + size])
            if window in first:
                gone.update(range(s, s + size))
            else:
                first[window] = (id_, s)
        out[id_] = [x for i, x in enumerate(w) if i not in gone]
    return out


def shingle_groups(docs, size=5, percent=80):
    """doc_id -> smallest doc_id of its group."""
    sets = {}
    for id_, text in docs:
        w = words(lower(text))
        sets[id_] = {tuple(w[i: i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    at = defaultdict(list)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sorted(sets):
        shared = defaultdict(int)
        for x in sets[a]:
            for b in at[x]:
                shared[b] += 1
            at[x].append(a)
        for b, both in shared.items():
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: root(i) for i in sets}


def line_tokens(line):
    return {w for w in re.split(r"[ \t\n\x0b\f\r]+", line.lower()) if w}


def repeated_lines(docs, percent=80):
    """(doc_id, line) of lines similar to an earlier one."""
    at, sets, out = defaultdict(list), [], set()
    for id_, text in sorted(docs):
        for number, line in enumerate((text or "").split("\n")):
            s = line_tokens(line)
            if not s:
                continue
            shared = defaultdict(int)
            for w in s:
                for k in at[w]:
                    shared[k] += 1
                at[w].append(len(sets))
            if any(100 * n >= percent * (len(s) + len(sets[k]) - n) for k, n in shared.items()):
                out.add((id_, number))
            sets.append(s)
    return out


def hit_words(text, items, window=10):
    """(words, hit words, item ids with a window in the text)."""
    pick = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w, hit, found = pick(text), set(), set()
    for item, content in items:
        x = pick(content)
        size = min(len(x), window)
        windows = {tuple(x[i: i + size]) for i in range(len(x) - size + 1)} if x else set()
        for s in range(len(w) - size + 1 if size else 0):
            if tuple(w[s: s + size]) in windows:
                hit.update(range(s, s + size))
                found.add(item)
    return len(w), len(hit), found
