"""Brute-force versions and small tables."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return set()
    return {tuple(words)} if len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def components(rows, percent=75):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def contamination(text, items, span=10):
    """(n_words, n_hit, sorted item ids) by sliding every window over every place."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    words, hit, found = cut(text), set(), set()
    for item_id, item in items:
        w = cut(item)
        n = min(len(w), span)
        for i in range(len(w) - n + 1 if w else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(item_id))
    return len(words), len(hit), sorted(found)


def awkward():
    """Nulls, empty and very long texts, ties, repeated rows."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
    return [
        (1, "one two three four five six seven", "en", "s", 33),
        (2, "One two THREE four five six seven", "en", "s", 33),
        (3, "one two three", "en", "s", 13),
        (4, "", "en", "s", 0),
        (5, None, None, None, None),
        (6, "  \n\t ", "fr", "s", 5),
        (7, long, "en", "s", len(long)),
        (8, long + " tail", "en", "s", len(long) + 5),
        (None, "no id here at all, but some words", "de", None, 10),
        (9, "repeat me twice please, thank you so much", "en", "s", 10),
        (9, "repeat me twice please, thank you so much", "en", "s", 10),
        (10, "Zeichen: äöü ßéñ 数字 😀 mixed", "de", "s", 20),
        (11, "!!! ??? ...", "en", "s", 11),
    ]
