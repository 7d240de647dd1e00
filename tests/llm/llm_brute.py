"""Plain single-process versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

_LAST = (1 << 63) - 1
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_key(line):
    return line.strip(" \t\n\x0b\f\r").translate(_LOWER)


def lines_after(rows):
    """(doc_id, n_lines, n_dropped, text) of each row of (doc_id, text)."""
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k, d = line_key(line), _LAST if i is None else i
            if len(k) >= 10:
                first[k] = min(first.get(k, d), d)
    out = []
    for i, t in rows:
        lines, d = (t or "").split("\n"), _LAST if i is None else i
        kept = [x for x in lines if len(line_key(x)) < 10 or first[line_key(x)] >= d]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def shingles(text, k=5):
    ws = WORD.findall((text or "").translate(_LOWER))
    return {tuple(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def near_groups(rows, percent=80):
    """(doc_id, n_shingles, component_id) of each row of (doc_id, text)."""
    ids = [_LAST if i is None else i for i, _ in rows]
    sets = [shingles(t) for _, t in rows]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    back = lambda x: None if x == _LAST else x
    return [(i, len(s), back(find(d) if s else d)) for (i, _), s, d in zip(rows, sets, ids, strict=True)]


def without_repeats(texts, least):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter()
    for b in data:
        seen.update(b[i:i + least] for i in range(len(b) - least + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - least + 1):
            if seen[b[i:i + least]] > 1:
                gone[i:i + least] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((len(b), int(gone.sum()), int((edges == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def best_substring_edits(item: bytes, text: bytes) -> int:
    """Least edits between ``item`` and any stretch of ``text``."""
    row = np.zeros(len(text) + 1, dtype=np.int64)
    t, lane = np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    for i, c in enumerate(item):
        step = np.append(i + 1, np.minimum(row[:-1] + (t != c), row[1:] + 1))
        row = np.minimum.accumulate(step - lane) + lane
    return int(row.min())
