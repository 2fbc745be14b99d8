"""Plain versions of the operators' results, for small inputs."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def near_components(rows, words, num=80, den=100):
    """{doc_id: (set size, component)} by comparing all pairs that share a shingle."""
    sets = {}
    for doc, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[doc] = {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for doc in sorted(sets):
        for gram in sets[doc]:
            holders.setdefault(gram, []).append(doc)
    for doc in sorted(sets):
        for other, common in Counter(e for g in sets[doc] for e in holders[g] if e > doc).items():
            if den * common >= num * (len(sets[doc]) + len(sets[other]) - common):
                a, b = root(doc), root(other)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in sets}


def repeated_lines(rows, least):
    """{doc_id: removed line numbers}: lines of any run of at least ``least`` words that stands earlier without overlap."""
    seen, gone = {}, {}
    for doc, text in sorted(rows):
        lines = [(i, x.strip(" \t\r\v\f"), len(WORD.findall(x))) for i, x in enumerate((text or "").split("\n"))]
        lines = [x for x in lines if x[2]]
        gone[doc] = set()
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += lines[b][2]
                if total >= least:
                    first = seen.setdefault(tuple(x[1] for x in lines[a:b + 1]), (doc, lines[b][0]))
                    if first[0] != doc or lines[a][0] > first[1]:
                        gone[doc] |= set(range(lines[a][0], lines[b][0] + 1))
    return gone


def rule_counts(text):
    """word count, word characters, symbols, repeated lines and words in repeated five-word windows of one text."""
    text = text or ""
    words = WORD.findall(text)
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": again, "n_repeat_words": len(covered)}


def base_spans(text):
    """kind:start:end of the base secret patterns, written with the plain patterns."""
    found = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text or "", re.I | re.A):
        if len(m.group(2)) >= 8:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, name, pattern, least in ((1, "access", "AKIA[A-Z0-9]+", 16), (2, "hex", "[0-9a-f]+", 32)):
        for m in re.finditer(pattern, text or ""):
            if m.end() - m.start() >= least:
                found.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]
