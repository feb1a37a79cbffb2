"""Tokens and folding (H12-H14): made once a text, looked up only where needed."""

from ticketlens.functions import text as H


def test_folding_by_need(spark):
    texts = ["plain ascii", "Crème brûlée", "ﬁn ½ 각 é", "naïve ﬂow", "日本 é", "áb", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.x for r in df.select(H.strip_accents("t").alias("x")).collect()]
    import unicodedata
    assert got == [t if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in texts]


def test_terms_are_made_once(spark, sf_small):
    """The tokens of a text stand once in the plan, not once for each use."""
    from ticketlens.plans.q_features import h13_h14_tokens
    plan = h13_h14_tokens(spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("{2,}") == 1
