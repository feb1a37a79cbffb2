"""Repeated runs of words against brute force over all runs."""
import random

import corpus_pipeline as cp
from ticketlens.llm import paragraphs, passages as ps


def plain_words(rows, gone, least):
    """{(doc, word)} that an equal, earlier run of ``least`` words covers; runs
    inside a line that is gone or of one word over and over do not count."""
    first, out = {}, set()
    for doc, text in sorted((r for r in rows if r[1]), key=lambda r: (r[0] is None, r[0])):
        words = [(w, i) for i, line in enumerate(text.encode().lower().split(b"\n")) for w in line.split()]
        for p in range(len(words) - least + 1):
            some = words[p:p + least]
            if some[0][1] == some[-1][1] and (doc, some[0][1]) in gone:
                continue
            if len({w for w, _ in some}) == 1:
                continue
            at = first.setdefault(tuple(w for w, _ in some), (doc, p))
            if at[0] != doc or p >= at[1] + least:
                out |= {(doc, p + i) for i in range(least)}
    return out


def covered(found, texts):
    out = set()
    for r in found:
        before = len(texts[r.doc_id][:r.start].split())
        part = texts[r.doc_id][r.start:r.stop].split()
        assert len(part) == r.n_words
        out |= {(r.doc_id, before + i) for i in range(len(part))}
    return out


def words(r, n):
    return " ".join("".join(r.choice("abcdefgäß") for _ in range(6)) for _ in range(n))


def test_passage_in_the_middle_of_one_line_documents(docs_of):
    r = random.Random(5)
    passage = words(r, 60)
    rows = [(i, f"{words(r, 70 + i)} {passage} {words(r, 90)}") for i in range(4)]
    assert paragraphs.repeated(docs_of(rows)).count() == 0
    got = {x.doc_id: x for x in ps.repeated_passages(docs_of(rows)).collect()}
    assert sorted(got) == [0, 1, 2, 3] and not got[0].removed
    for i in (0, 1, 2, 3):
        x = got[i]
        assert rows[i][1][x.start:x.stop] == passage and x.n_words == 60 and x.removed == (i > 0)
        assert (x.kept_doc_id, x.kept_line, x.occurrences) == (0, 0, 4)
    out = {x.doc_id: x for x in ps.without_passages(docs_of(rows)).collect()}
    assert out[0].text == rows[0][1] and out[0].passages_removed == 0
    for i in (1, 2, 3):
        assert out[i].text == rows[i][1].replace(passage + " ", "") and out[i].passages_removed == 1


def test_passage_in_short_lines_and_wrapped_otherwise(docs_of):
    r = random.Random(6)
    ws = words(r, 45).split()
    wrap = lambda n: "\n".join(" ".join(ws[i:i + n]) for i in range(0, 45, n))
    rows = [(1, "head a\n" + wrap(7) + "\ntail a"), (2, wrap(7) + "\n\nend b"), (3, "head c\n" + wrap(11).upper() + " last c")]
    rows = [(d, t.replace("Ä", "ä").replace("SS", "ß")) for d, t in rows]
    out = {x.doc_id: x.text for x in ps.without_passages(docs_of(rows)).collect()}
    assert out == {1: rows[0][1], 2: "\nend b", 3: "head c\nlast c"}


def test_matches_brute_force(docs_of):
    r = random.Random(7)
    bases = [words(r, r.randint(5, 60)).split() for _ in range(12)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(r.randint(1, 6)):
            ws = list(r.choice(bases)) if r.random() < .6 else words(r, 15).split()
            ws = ws[r.choice([0, 0, 3]):]
            if r.random() < .3:
                ws[r.randrange(len(ws))] = "changed"
            text += ws
        rows.append((i, "".join(w + r.choice([" "] * 12 + ["\n", "  ", "\n\n"]) for w in text)))
    rows += [(90, "la " * 100), (91, "la " * 30 + "\nother " * 3), (92, None), (93, ""), (94, "la la"), (95, "la le " * 50)]
    df = docs_of(rows)
    texts = {d: t or "" for d, t in rows}
    for similarity in (0.99, 0.8):
        how = {"min_words": 9, "similarity": similarity}
        lines = paragraphs.repeated(df, **how).collect()
        got = ps.repeated_passages(df, **how).collect()
        is_line = {(x.doc_id, x.start, x.stop) for x in lines}
        spans = [x for x in got if (x.doc_id, x.start, x.stop) not in is_line]
        lines = [x for x in lines if x.removed]
        want = plain_words(rows, {(x.doc_id, x.line) for x in lines}, 9)
        whole = covered(lines, texts)
        gone = covered([x for x in got if x.removed], texts)
        lost = (want | whole) - gone  # ends of passages whose anchors stand first in a shorter one
        assert len(want - whole) > 300 and whole <= gone and len(lost) < len(want) / 50
        more = gone - want - whole  # changed words between equal runs, few and never alone
        assert not more if similarity == 0.99 else 0 < len(more) < len(gone) / 20
        assert all((d, i - 1) in gone and (d, i + 1) in gone for d, i in more)
        assert all(x.occurrences > 1 for x in spans)
    left = {x.doc_id: (x.text or "").split() for x in ps.without_passages(df, **how).collect()}
    for d, t in texts.items():
        assert left[d] == [w for i, w in enumerate(t.split()) if (d, i) not in gone]


def test_near_copies_inside_longer_lines(docs_of):
    r = random.Random(12)
    p = words(r, 120).split()
    other = list(p)
    other[40], other[80] = "changed", "changed2"  # 102 of 126 shingles are shared
    short = list(p[:60])
    short[19], short[40] = "x1", "x2"  # too unlike as a whole: only the equal runs of 20 words
    shifted = p[:50] + ["more", "words"] + p[51:]
    rows = [(1, f"{words(r, 40)} {' '.join(p)} {words(r, 40)}"), (2, f"{words(r, 33)} {' '.join(other)} {words(r, 9)}"),
            (3, f"{words(r, 35)} {' '.join(short)} {words(r, 9)}"), (4, f"{words(r, 21)} {' '.join(shifted)} {words(r, 3)}")]
    got = {x.doc_id: x for x in ps.repeated_passages(docs_of(rows)).where("removed").collect()}
    assert rows[1][1][got[2].start:got[2].stop].split() == other and got[2].kept_doc_id == 1
    assert rows[3][1][got[4].start:got[4].stop].split() == shifted
    left = {x.doc_id: x.text.split() for x in ps.without_passages(docs_of(rows)).collect()}
    assert len(left[2]) == 42 and len(left[4]) == 24
    assert [w for w in left[3] if w in short] == ["x1", *p[:19], "x2"] or [w for w in left[3] if w in short] == [*p[:19], "x1", "x2", *p[41:60]]


def test_periods_and_many_copies_of_them(docs_of):
    long = "very long story " * 3000
    rows = [(1, long), (2, "begin " + long + "end"), (3, "other " * 400), (4, long + long)]
    got = {x.doc_id: x for x in ps.repeated_passages(docs_of(rows)).where("removed").collect()}
    assert set(got) == {1, 2, 4} - {d for d in (1, 2, 4) if d not in got}
    left = {x.doc_id: x.text.split() for x in ps.without_passages(docs_of(rows)).collect()}
    assert 20 <= len(left[1]) < 45 and len(left[2]) <= 30 and len(left[4]) == 0 and len(left[3]) == 400


def test_null_ids_repeated_rows_and_empty_tables(docs_of):
    r = random.Random(8)
    p = words(r, 30)
    x, y, z, a = (words(r, 40) for _ in range(4))
    rows = [(None, f"{x} {p} {y}"), (7, f"{p} {z}"), (7, f"{p} {z}"), (8, f"{a} {p}")]
    df = docs_of(rows)
    out = sorted((d.doc_id is None, d.doc_id or 0, d.text) for d in ps.without_passages(df).collect())
    assert out == [(False, 7, f"{p} {z}"), (False, 7, f"{p} {z}"), (False, 8, a), (True, 0, f"{x} {y}")]
    assert ps.repeated_passages(df.limit(0)).collect() == [] and ps.without_passages(df.limit(0)).collect() == []


def test_pipeline_cuts_passages_that_fill_no_line(spark, docs_of, sf_small):
    r = random.Random(10)
    ws = words(r, 54).split()
    verse = "\n".join(" ".join(ws[i:i + 9]) for i in range(0, 54, 9))
    a, b, c, d = (words(r, 80) for _ in range(4))
    rows = [(1, f"{a} {' '.join(ws)} {b}"), (2, f"{c} {' '.join(ws)} {d}"), (3, f"first\n{verse}\nlast"), (4, verse)]
    df = docs_of(rows)
    out = cp.cut_repeats(spark, df, sf_small)
    assert out.dtypes == df.dtypes
    got = {x.doc_id: (x.text, x.n_chars) for x in out.collect()}
    want = {1: rows[0][1], 2: f"{c} {d}", 3: "first\nlast"}
    assert got == {k: (t, len(t)) for k, t in want.items()}
