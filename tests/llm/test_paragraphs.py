"""Repeated paragraphs against brute force over all pairs."""
import random
from itertools import combinations

from pyspark.sql import functions as F

from ticketlens.llm import linking
from ticketlens.llm import paragraphs as pg


def plain(rows, least, similarity=.8):
    """{(doc, line): kept (doc, line)} of all occurrences in components of two or more."""
    occ = []
    for doc, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            ws = line.encode().lower().split()
            if len(ws) >= least:
                k = min(5, len(ws))
                occ.append(((doc is None, doc or 0), i, frozenset(tuple(ws[j:j + k]) for j in range(len(ws) - k + 1)),
                            tuple(ws)))
    up = list(range(len(occ)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in combinations(range(len(occ)), 2):
        x, y = occ[a], occ[b]
        if x[3] == y[3] or min(len(x[3]), len(y[3])) >= 5 and len(x[2] & y[2]) >= similarity * len(x[2] | y[2]):
            up[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for i in range(len(occ)):
        groups.setdefault(find(i), []).append(occ[i][:2])
    return {o: min(g) for g in groups.values() if len(g) > 1 for o in g}


def as_map(df):
    return {((r.doc_id is None, r.doc_id or 0), r.line): ((r.kept_doc_id is None, r.kept_doc_id or 0), r.kept_line)
            for r in df.collect()}


def texts(seed, n=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(4))
    bases = [[word() for _ in range(r.randint(8, 60))] for _ in range(25)]
    out = []
    for i in range(n):
        lines = []
        for _ in range(r.randint(1, 4)):
            ws = list(r.choice(bases)) if r.random() < .6 else [word() for _ in range(30)]
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                ws[r.randrange(len(ws))] = word()
            lines.append(" ".join(ws))
        out.append((i, "\n".join(lines)))
    return out


def test_tuned_bands():
    bands, rows = pg.tune()
    assert 1 - (1 - .8 ** rows) ** bands >= .999


def test_matches_brute_force(docs_of):
    rows = texts(1)
    assert as_map(pg.repeated(docs_of(rows), min_words=8)) == plain(rows, 8)


def test_large_buckets_are_split(docs_of, monkeypatch):
    monkeypatch.setattr(linking, "SMALL", 300)
    monkeypatch.setattr(linking, "HUB", 8)
    r = random.Random(9)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(60):  # near copies of near copies, few of them alike enough
        ws = list(base)
        for _ in range(r.choice([1, 2, 3])):
            ws[r.randrange(40)] = f"x{r.randrange(10 ** 6)}"
        rows.append((i, " ".join(ws)))
    assert as_map(pg.repeated(docs_of(rows))) == plain(rows, 20)


def test_spans_and_removal(docs_of):
    line = "Ein langer Absatz, der mehr als nur ein paar Wörter hat und der in vielen Texten wieder und wieder steht, wörtlich."
    rows = [(3, f"kurz\n{line}\nkurz"), (2, f"{line.upper()}\nx"), (7, line), (None, f"a\n{line}"), (5, None), (6, ""),
            (8, line + " " + "lang " * 50000), (9, "allein"), (9, "allein"), (7, line)]
    df = docs_of(rows).withColumn("removed", F.lit("clash")).withColumn("line", F.lit(-1))
    got = pg.repeated(df, min_words=15).collect()
    by = {r.doc_id: r for r in got}
    low = [(d, (t or "").lower()) for d, t in rows]
    assert {r.doc_id for r in got} <= {2, 3, 7, None} and len(got) >= 4 and low
    assert not by[3].removed or by[3].kept_doc_id == 2
    assert rows[0][1][by[3].start:by[3].stop] == line and by[3].line == 1
    assert pg.repeated(df.limit(0)).collect() == []


def test_real_rows(small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    assert as_map(pg.repeated(small_docs)) == plain(rows, pg.MIN_WORDS)
