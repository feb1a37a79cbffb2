"""Min-max hashing near-duplicates against all pairs."""
import random
import re
from itertools import combinations

import numpy as np

from ticketlens.llm import linking, minhash


def word_set(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(ws[i:i + 4]) for i in range(max(len(ws) - 3, 1))} if ws else set()


def plain(rows, percent=80):
    """rows (id, text) -> rows (id, size, component, kept)."""
    sets = [word_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
            m = len(a & b)
            if 100 * m >= percent * (len(a) + len(b) - m):
                up[find(i)] = find(j)
    of = {}
    for i, (d, _) in enumerate(rows):
        of.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in of[find(i)] if x is not None]
        c = min(ids) if ids else None
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def got(df, **how):
    return sorted((tuple(r) for r in minhash.near_duplicates(df, **how).collect()), key=repr)


def variants(rng, words, n, change):
    """Texts of which each differs from the last in ``change`` words."""
    out = [list(words)]
    for _ in range(n - 1):
        new = list(out[-1])
        for at in rng.sample(range(len(new)), change):
            new[at] = f"v{rng.randrange(10 ** 6)}"
        out.append(new)
    return [" ".join(w) for w in out]


def test_given_documents_match_all_pairs(spark, small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.select("doc_id", "text").collect()]
    want = plain(rows)
    assert got(small_docs) == want and sum(not r[3] for r in want) > 10


def test_chains_of_near_copies_and_borderline_pairs(spark, docs_of):
    rng = random.Random(3)
    texts = []
    for size, change in ((40, 1), (60, 2), (25, 1), (200, 6), (12, 1)):  # alike to the next, not to all
        texts += variants(rng, [f"a{rng.randrange(3000)}" for _ in range(size)], 25, change)
    texts += [" ".join(f"b{rng.randrange(500)}" for _ in range(30)) for _ in range(50)]
    rng.shuffle(texts)
    want = plain(list(enumerate(texts)))
    assert got(docs_of(texts, 5)) == want
    assert 20 < len({r[2] for r in want}) < len(texts) - 20


def test_nulls_short_and_long_texts_ties_repeated_rows_and_clashing_names(spark, docs_of):
    long = " ".join(f"w{i % 50021}" for i in range(120_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one\x0btwo"), (6, "one two three"), (7, "one two three four"),
            (8, "ONE two three four"), (8, "one two three four"), (8, "other text here now again"), (None, "one two three four"),
            (None, "alone among the null ids"), (None, "alone among the null ids"), (None, None), (9, long), (10, long + " end"),
            (11, "Été a b c d"), (12, "été a b c d"), (0, "other text here now again")]
    docs = docs_of(rows).selectExpr("*", "1 as n", "'k' as key", "2 as row", "3 as kept", "4 as component_id", "5 as bands")
    assert got(docs) == plain(rows)
    assert got(docs.limit(0)) == []
    assert got(docs_of([(1, None), (2, "")])) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_large_buckets_take_longer_bands_and_blocks(spark, docs_of, monkeypatch):
    rng = random.Random(8)
    frame = [f"f{i}" for i in range(24)]
    texts = []
    for i in range(120):  # one frame, names that differ: a similarity of about 0.6, some of 0.8 and more
        ws = list(frame)
        ws[5], ws[15] = f"n{rng.randrange(25)}", f"m{rng.randrange(25)}"
        texts.append(" ".join(ws))
    want = plain(list(enumerate(texts)))
    assert 2 < len({r[2] for r in want}) < 119
    for small, hub in ((1 << 19, 1000), (300, 7), (60, 3)):
        monkeypatch.setattr(linking, "SMALL", small)
        monkeypatch.setattr(linking, "HUB", hub)
        assert got(docs_of(texts)) == want


def test_bands_are_as_many_as_the_recall_needs():
    assert linking.bands_for(80, 4) == 18 and linking.bands_for(80, 1, 0.99) == 3
    rng = np.random.default_rng(1)
    hits = np.zeros(2)
    for _ in range(400):
        u = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        a, b, c = u[:80], np.concatenate([u[10:80], u[80:]]), rng.integers(0, 1 << 63, 80, dtype=np.uint64)
        v = linking.min_max_bands(np.concatenate([a, b, c]), np.array([0, 80, 160]), 18, 4)
        hits += (v[0] == v[1]).any(), (v[0] == v[2]).any()
    assert hits[0] >= 396 and hits[1] == 0  # a similarity of 7/9
