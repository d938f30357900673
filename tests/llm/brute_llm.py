"""Plain versions of the llm operators."""

from __future__ import annotations

import re
import unicodedata


def experience_words(row):
    parts = [row["last_error"]] + [x for r in row["memory_records"] or [] for x in (r["error_signature"], r["root_cause"])]
    return frozenset(re.findall("[a-z0-9]+", " ".join(p for p in parts if p).lower()))


def near_pairs(records, threshold=0.65, least=10):
    """records: (id, words)."""
    sets = sorted({(i, w) for i, w in records if len(w) >= least}, key=lambda x: x[0])
    out = set()
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if i != j and len(a & b) >= threshold * len(a | b) - 1e-9:
                out.add((min(i, j), max(i, j)))
    return out


def text_words(text):
    s = unicodedata.normalize("NFKD", text or "")
    s = "".join(c for c in s if not unicodedata.combining(c)).casefold()
    return re.findall(r"[^\W_]+", s)


def leaks(docs, items, m=12):
    windows = {}
    for i, t in items:
        w = text_words(t)
        for k in range(len(w) - m + 1):
            windows.setdefault(tuple(w[k : k + m]), set()).add(i)
    out = set()
    for d, t in docs:
        w = text_words(t)
        for k in range(len(w) - m + 1):
            out |= {(d, i) for i in windows.get(tuple(w[k : k + m]), ())}
    return out
