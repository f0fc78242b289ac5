"""Small tables with every odd case, and what they should give, worked out by brute force."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h long, grp string, kept boolean, `__best` int"


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def prose(rng: random.Random, n: int, vocabulary: int = 3000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def texts(seed: int = 1) -> list[str | None]:
    """Null, empty, white space, very short and very long texts, copies, near copies, shared passages, text that repeats itself."""
    rng = random.Random(seed)
    out: list[str | None] = [None, "", " \t\n\x0b\f\r ", "one", "One two", "a\xa0b c\u2003d", "\u00e9t\u00e9 na\u00efve \u4e2d\u6587 \U0001f600!", "x " * 90, "so it goes " * 30]
    base = [prose(rng, rng.randrange(20, 300)) for _ in range(25)]
    out += base + base[:6]
    for b in base[:12]:  # near copies: a few words differ
        w = b.split()
        for i in rng.sample(range(len(w)), max(1, len(w) // rng.choice((15, 40, 90)))):
            w[i] = f"n{rng.randrange(99)}"
        out.append("  ".join(w).upper() if rng.random() < 0.5 else "\n".join(w))
    for n in (34, 35, 36, 49, 50, 60):  # passages in two documents, at all places
        p = prose(rng, n)
        out += [f"{p} {prose(rng, 40)}", f"{prose(rng, 30)} {p}", f"{prose(rng, 5)} {p} {prose(rng, 5)}"]
    out.append(prose(rng, 30_000, 20_000))
    chain = prose(rng, 120).split()  # each is like the next one only
    for i in range(6):
        out.append(" ".join([f"c{j}" for j in range(4 * i)] + chain[4 * i :]))
    return out


def rows(seed: int = 1) -> list[tuple]:
    t = texts(seed)
    out = [(i, x, ["en", "fr", None][i % 3], [None, "a", "b", "b", "b", "long name"][i % 6], None if x is None else len(x), 7, 1, "g", None, 3) for i, x in enumerate(t)]
    return out + out[10:13]  # repeated rows


def repeated_words(items: list[tuple[int, str | None]], length: int) -> list[tuple[int, int, int, str]]:
    """(id, words, removed, kept joined) by listing every window."""
    seen: dict[tuple[str, ...], int] = {}
    split = [(i, words(t)) for i, t in items]
    for _, w in split:
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - length + 1):
            if seen[tuple(w[s : s + length])] > 1:
                gone.update(range(s, s + length))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def shingle_set(text: str | None, k: int) -> frozenset:
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = words(low)
    return frozenset([tuple(w)] if 0 < len(w) < k else (tuple(w[i : i + k]) for i in range(len(w) - k + 1)))


def components(ids: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(items: dict[int, str | None], k: int, percent: int) -> dict[int, tuple[int, int]]:
    """id: (size of its set, component) by comparing all pairs."""
    sets = {i: shingle_set(t, k) for i, t in items.items()}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) if sets[a] for b in ids[x + 1 :] if sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components(ids, links)
    return {i: (len(sets[i]), comp[i]) for i in ids}
