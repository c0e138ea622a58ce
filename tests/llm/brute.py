"""Plain versions of the operators, and small texts with the awkward cases."""

import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")
NASTY = [
    None, "", " ", "\n", "\n\n", "a", "a b", "a b c", "a b c d", "A B c D e", "x\n x\nx\n\nx", "é ü ß ñ", "日本 語 テ キスト", "a b c\x1cd", "a\r\nb\r\nb\r\n", "tab\tsep\x0bv\x0cf",
    "the end. the end. the end. the end.", "a a a a a a a a a", "#*$ %&| <> #", "🙂🙂 🙂 word", "word " * 300, "same text here for ties", "same text here for ties", " lead", "trail ", "  two  spaces  ", "x" * 5000, "1" * 3000, "<|endoftext|> and <|startoftext|>", "a\x00b c",
]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def quality_counts(t):
    t = t or ""
    w = WORD.findall(t)
    three = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i in range(len(w) - 2):
        if three[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered)
