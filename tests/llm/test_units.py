"""The pass over the texts that lines and runs of words share."""
import random
import re
from hashlib import md5

import numpy as np
import pyarrow as pa

from ticketlens.llm import paragraphs, passages


def test_texts_are_cut_into_words_once(docs_of, monkeypatch):
    calls = []
    for module in (passages, paragraphs):
        monkeypatch.setattr(module, "units", lambda *a, f=paragraphs.units: calls.append(a) or f(*a))
    passage = " ".join(f"w{i}" for i in range(40))
    df = docs_of([passage, f"one two {passage} three", f"{passage}\nfour", None, ""])
    assert passages.repeated_passages(df).where("removed").count() == 2 and len(calls) == 1


def test_shared_pass_against_plain_forms():
    r = random.Random(8)
    texts = ["\n".join(" ".join(r.choice("Ab cé dd ☃ f").strip() or "x" for _ in range(r.choice((0, 3, 25, 60)))) for _ in range(4)) for _ in range(60)]
    texts[7], texts[9] = None, ""
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(range(60), pa.int64()), pa.array(texts)],
                                       names=["row", "doc_id", "text"])
    bands, rows = paragraphs.tune()
    out = pa.Table.from_batches(paragraphs._units(20, bands, rows, passages._of(20))([batch])).to_pylist()
    lines = {(o["doc_id"], o["line"]): o for o in out if o["key"]}
    wanted = {(d, i): x for d, t in enumerate(texts) for i, x in enumerate((t or "").split("\n")) if len(x.split()) >= 20}
    assert set(lines) == set(wanted)
    for place, x in wanted.items():
        ws = x.encode().lower().split()
        s = paragraphs._windows(paragraphs.word_hashes(ws), paragraphs.SHINGLE)
        values = []
        for band in range(bands):
            v = np.array([band], dtype=np.uint64)
            for j in range(band * rows, (band + 1) * rows):
                least = paragraphs._mix(s * paragraphs._FACTORS[j % 59] + paragraphs._ADDS[j]).min()
                v = paragraphs._mix(v * paragraphs._FACTORS[62] + least)
            values.append(int(v.view(np.int64)[0]))
        o = lines[place]
        assert o["bands"] == values and o["n_words"] == len(ws) and texts[place[0]][o["start"]:o["stop"]] == x
    anchors = {o["doc_id"]: (o["h"], o["at"]) for o in out if not o["key"]}
    for d, t in enumerate(texts):
        h = paragraphs.word_hashes((t or "").encode().lower().split())
        at, v = passages._anchors(h, np.zeros(len(h), dtype=np.int64), 20)
        assert anchors.get(d, ([], [])) == (v.view(np.int64).tolist(), at.tolist())


def test_rows_are_given_out_together():
    line = " ".join(f"w{i}" for i in range(30))
    key = md5(line.encode()).digest()
    sets = pa.RecordBatch.from_arrays([pa.array([line] * 50), pa.array([[{"line": 0, "key": key}]] * 50)], names=["text", "wanted"])
    out = list(paragraphs._sets([sets]))
    assert len(out) == 1 and out[0].num_rows == 50 and len(set(map(tuple, out[0].column(1).to_pylist()))) == 1
    asked = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(range(50)), pa.array([line] * 50),
                                        pa.array([[{"side": False, "b": 3}, {"side": True, "b": 5}]] * 50)],
                                       names=["row", "doc_id", "text", "wanted"])
    out = list(passages._borders(10)([asked]))
    assert len(out) == 1 and out[0].num_rows == 100
    assert out[0].column(5).to_pylist()[0] == [9, 6, 3, 0] and len(out[0].column(4).to_pylist()[1]) == 10


def test_places_against_a_scan():
    for text in ("", " a  bé\n\tcç\x0bd ", "x", "é", "\n\n", "a b c\x1cd", "☃ ☃\n☃"):
        start, stop, line = passages._places(text.encode())
        words = [(m.start(), m.end(), text.count("\n", 0, m.start())) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        assert list(zip(start.tolist(), stop.tolist(), line.tolist())) == words
