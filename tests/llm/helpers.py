"""Plain versions of what the operators do, and small tables with awkward rows."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def docs(spark, rows):
    """Rows (doc_id, text) or (doc_id, text, source) as a documents table."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCS)


AWKWARD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three four"), (6, "one two three four"),
    (7, "x" * 300_000), (8, "word " * 60_000), (None, "one two three four"), (9, "Ünï cödé   words here now"), (4, "one"),
]
