"""Hand-worked golden rows for the rule operators (label map, priority, gate, text)."""


from ticketlens import constants as K
from ticketlens.functions import arrays as A
from ticketlens.functions import text as H
from ticketlens.operators import labels as L


def test_priority_golden_rows(spark):
    rows = [
        ("card_arrival", "When will my card come?", "Card Services", "P2-Medium"),
        ("card_arrival", "My card was STOLEN", "Card Services", "P0-Critical"),
        ("exchange_rate", "transfer failed", "Fees & Charges", "P1-High"),
        ("exchange_rate", "fraud, and the card was declined", "Fees & Charges", "P0-Critical"),
        ("passcode_forgotten", "help", "Account Access", "P1-High"),
        ("age_limit", "it was not mentioned anywhere", "Account Management", "P0-Critical"),
        ("getting_spare_card", "hello", "General Inquiry", "P3-Low"),
        ("terminate_account", None, "Account Management", "P3-Low"),
    ]
    df = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)],
                               "ticket_id long, label_name string, text string")
    out = L.assign_priority(L.map_labels(df)).orderBy("ticket_id").collect()
    assert [(r.category, r.priority) for r in out] == [(r[2], r[3]) for r in rows]


def test_oos_and_unmapped(spark):
    a = spark.createDataFrame([(1, "hello", "getting_spare_card"), (2, "x", "card_arrival")],
                              "ticket_id long, text string, label_name string")
    b = spark.createDataFrame([(-1, "what movies are playing", "oos")], "ticket_id long, text string, label_name string")
    out = {r.ticket_id: (r.category, r.priority) for r in L.assign_priority(L.consolidate(a, b)).collect()}
    assert out[-1] == ("General Inquiry", "P3-Low")
    assert out[1] == ("General Inquiry", "P3-Low")
    assert [r.label_name for r in L.unmapped_labels(a).collect()] == ["getting_spare_card"]


def test_confidence_gate(spark):
    df = spark.createDataFrame([("Payment Issues", 0.85), ("Payment Issues", 0.4512), ("Unknown name", 0.99)],
                               "category string, category_confidence double")
    out = L.confidence_gate(df).collect()
    got = {(r.category, r.category_confidence): (r.review_status, r.review_reason, r.routing_team) for r in out}
    assert got[("Payment Issues", 0.85)] == ("auto_routed", None, "Payments Team")
    assert got[("Payment Issues", 0.4512)] == ("needs_human_review", "Low confidence (45.1% < 85% threshold)",
                                               "Human Review Queue")
    assert got[("Unknown name", 0.99)] == ("auto_routed", None, "General Support Team")


def test_replace_chain_and_words(spark):
    df = spark.createDataFrame([("Transfer to bank card",), ("  a  b ",), ("",), (" ",)], "text string")
    out = df.select(H.replace_chain("text", K.DRIFT_REPLACEMENTS, K.DRIFT_SUFFIX).alias("r"),
                    H.word_count("text").alias("n")).collect()
    assert out[0].r == ("UPI transaction via app to fintech platform virtual wallet please help me with this "
                        "issue as soon as possible")
    assert [r.n for r in out[1:]] == [2, 0, 0]


def test_preview_and_strip(spark):
    df = spark.createDataFrame([("x" * 101,), ("short",), ("  pad \t",)], "text string")
    out = df.select(H.preview("text").alias("p"), H.strip("text").alias("s")).collect()
    assert out[0].p == "x" * 100 + "..." and out[1].p == "short"
    assert out[2].s == "pad"


def test_softmax_argmax(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([1000.0, 1000.0, 999.0],)], "a array<double>")
    out = df.select(A.softmax("a").alias("p"), A.argmax("a").alias("i")).collect()
    assert out[0].p == [0.5, 0.5] and out[0].i == 0
    assert abs(sum(out[1].p) - 1.0) < 1e-12 and out[1].i == 0


def test_tokens_and_ngrams(spark):
    df = spark.createDataFrame([("Café crème, a b2 über_x!",)], "text string")
    r = df.select(H.tokens("text").alias("t"), H.ngrams_1_2(H.tokens("text")).alias("g")).first()
    assert r.t == ["cafe", "creme", "b2", "uber_x"]
    assert r.g == r.t + ["cafe creme", "creme b2", "b2 uber_x"]


def test_sla(spark):
    import datetime as dt
    df = spark.createDataFrame([("P0-Critical", dt.datetime(2024, 1, 1, 10, 0), dt.datetime(2024, 1, 1, 10, 20))],
                               "priority string, opened timestamp_ntz, handled timestamp_ntz")
    r = L.priority_sla(df, opened_col="opened", handled_col="handled").first()
    assert (r.sla_label, r.sla_minutes) == ("Immediate Response", 15)
    assert r.sla_deadline == dt.datetime(2024, 1, 1, 10, 15) and r.sla_breached


def test_keyword_regex_path_equals_substring_semantics(spark):
    texts = ["I didn't authorize this", "Locked Out again", "not mentioned", "a.b*c", "fine", None,
             "can't pay", "scam? (maybe)"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    long_list = K.P0_KEYWORDS + K.P1_KEYWORDS + ["a.b*c", "(maybe)"]
    got = [r.hit for r in df.select(H.contains_any("text", long_list).alias("hit")).collect()]
    want = [None if t is None else any(k in t.lower() for k in long_list) for t in texts]
    assert got == want


def test_accents_follow_the_normal_form_for_every_character(spark):
    import unicodedata

    from ticketlens.functions import text as H

    def want(t):
        return "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x))
    chars = [chr(c) for c in range(0x80, 0x30000)
             if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    rows = ["Ａbc ﬁnance", "éa", None] + ["x" + "y".join(chars[i:i + 300]) for i in range(0, len(chars), 300)]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    got = {r.i: r.o for r in df.select("i", H.strip_accents("t").alias("o")).collect()}
    assert got == {i: None if t is None else want(t) for i, t in enumerate(rows)}
    assert df.where("i = 0").select(H.tokens("t").alias("k")).first().k == ["abc", "finance"]


def test_percent_is_that_of_the_binary_value(spark):
    import random

    from ticketlens.functions import text as H
    r = random.Random(1)
    xs = [0.3045, 0.4515, 0.6525, 0.0005, 0.0, 1.0] + [round(r.random(), k) for k in (3, 4, 5, 17) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "c double")
    for row in df.select("c", H.low_confidence_reason("c", 0.85).alias("m")).collect():
        assert row.m == f"Low confidence ({row.c:.1%} < 85% threshold)"
