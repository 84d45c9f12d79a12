"""Slow and plain versions of the operators, and odd tables to run both on."""

from __future__ import annotations

import re
from collections import Counter

import xxhash

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}

PASSAGE = " ".join(f"shared{i}" for i in range(30))
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
TEXTS = [
    None, "", " \t\n ", "One", "One two", "one TWO", "a b c d e", "\n\n", "x\n\nx\n x \nX",
    PASSAGE, f"head {PASSAGE} tail", f"other start {PASSAGE} and an end {PASSAGE}", f"{PASSAGE}\n{PASSAGE}",
    "É ÀÇ é  ▁ ▁▁ 漢字 😀 \u00a0 \u3000", "the the the " * 40, "line one\nline two\nline one\n",
    "LINE ONE\n\tline two  ", LONG, LONG, LONG[:-2] + "changed end", "a\u0000b", "###$$$ %%% &&& " * 20,
]


def odd_rows(copies: int = 12) -> list[tuple]:
    rows = [(i * 3, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [(1000 + i, "copied text of several words\nshared line\nand more", "fr", "src0", 50) for i in range(copies)]
    rows += [(2000 + i, f"shared line\nown line {i} " + " ".join(f"v{i}{j}" for j in range(20)), None, None, None) for i in range(copies)]
    return rows


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def line_key(line: str) -> str:
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def without_frequent_lines(rows: list[tuple], min_docs: int) -> list[tuple]:
    counts = Counter(k for _, t in rows for k in {line_key(x) for x in (t or "").split("\n")})
    result = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not line_key(x) or counts[line_key(x)] < min_docs]
        result.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return result


def simhash(text: str | None) -> int:
    found = words((text or "").translate(LOWER))
    shingles = [" ".join(found[i : i + 3]) for i in range(max(len(found) - 2, 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints: list[int], distance: int = 3) -> list[int]:
    """For each place the first place that links reach."""
    root = list(range(len(prints)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def without_repeats(rows: list[tuple], window: int = 13) -> list[tuple]:
    first: dict[tuple, int] = {}
    for doc, text in rows:
        found = words(text)
        for i in range(len(found) - window + 1):
            key = tuple(found[i : i + window])
            first[key] = min(first.get(key, doc), doc)
    result = []
    for doc, text in rows:
        found = words(text)
        gone = [False] * len(found)
        for i in range(len(found) - window + 1):
            if first[tuple(found[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        result.append((doc, len(found), sum(gone), " ".join(w for w, g in zip(found, gone, strict=True) if not g)))
    return result


def rule_counts(text: str | None) -> tuple:
    found, lines = words(text), (text or "").split("\n")
    windows = Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
    repeated = set()
    for i in range(len(found) - 2):
        if windows[tuple(found[i : i + 3])] > 1:
            repeated |= {i, i + 1, i + 2}
    dup = sum(1 for i, x in enumerate(lines) if words(x) and x in lines[:i])
    return (
        len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated),
        len(found) < 50 or 100 * len(repeated) > 50 * len(found),
    )
