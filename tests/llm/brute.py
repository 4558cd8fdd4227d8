"""Plain versions of what the operators must give."""

import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def lower(text):
    return (text or "").translate(UPPER)


def simhash(text, width=3):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(ids, fps, radius=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            r = find(i)
            least[r] = min(least.get(r, x), x)
    return [least.get(find(i)) for i in range(len(ids))]


def kept_lines(docs, least=10):
    """{doc_id: (lines, dropped, kept text)} of (doc_id, text) with distinct doc_ids."""
    blanks = " \t\n\x0b\x0c\r"
    key = lambda line: lower(line.strip(blanks))
    where = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            where.setdefault(key(line), set()).add(doc)
    out = {}
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(where[key(x)]) < 2 or min(where[key(x)]) == doc]
        out[doc] = len(lines), len(lines) - len(kept), "\n".join(kept)
    return out


def edits(item, text):
    """Fewest edits of the item to occur in the text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for ch in text:
        new = [0]
        for i, a in enumerate(item):
            new.append(min(row[i] + (a != ch), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best
