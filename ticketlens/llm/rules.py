"""Quality rules: measures of a text and a learned decision list, all as Spark
expressions.

The list is learned by sequential covering.  A rule is a conjunction of
thresholds on the measures; it is grown on two thirds of a bounded labelled
sample (the condition with the best information gain next), pruned on the
rest (last conditions go while that does not lower its worth), kept if it is
precise enough there, and the documents that it covers leave the sample for
the next rule.  Only counts per measure and threshold reach the driver.  The
list becomes one ordered conditional expression.

Null texts have no words.  Texts of any length are measured whole, in time
n log n.  Repeated rows are treated alike.  Without labels of both classes the
list is empty and only the base rule decides.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm.common import WORD, labelled_sample, read, written

#: Labelled documents learned from, at most; thresholds tried per measure.
SAMPLE, CUTS = 6000, 32
SYMBOLS = "#*$%&|<>"
MEASURES = ("symbol_share", "upper_share", "dup_line_share", "repeat_share", "word_length", "distinct_share", "n_words")
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _shift(array: Column | str, start: int, length: Column) -> Column:
    return F.slice(array, F.lit(start), F.greatest(length, F.lit(0)))


def _hash2(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))


def _once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and new columns that are computed once a row: the generator
    keeps the optimizer from copying an array's expression to each of its uses."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def measure(df: DataFrame, text: str = "text", keep: list[str] | None = None, window: int = 5) -> DataFrame:
    """``keep`` columns plus the base counts and the other measures.

    ``n_repeat_words`` counts the words in 5-word windows found twice or more
    in the text: windows are hashed (64 bits), equal ones are neighbours once
    sorted, and the places of the repeated ones, sorted, cover their words.
    """
    assert window == 5
    keep = [c for c in df.columns if c != text] if keep is None else keep
    new = {*_BASE, *MEASURES, "base_failed"}
    keep = [c for c in keep if c not in new]
    d = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__t"))
    spaces = "\t\n\x0b\x0c\r"
    d = _once(d, [*keep, "__t"],
              __w=F.array_remove(F.split(F.translate("__t", spaces, "     "), " "), ""),
              __l=F.filter(F.split("__t", "\n"), lambda x: x.rlike(WORD)), __n=F.length("__t"))
    d = _once(d, keep, n_words=F.size("__w").cast("long"), __size=F.size("__w"),
              word_chars=F.length(F.translate("__t", " " + spaces, "")).cast("long"),
              n_symbols=(F.col("__n") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long"),
              __u=F.regexp_count("__t", F.lit(r"\p{Lu}")), __nl=F.size("__l"),
              n_dup_lines=(F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
              __h=F.transform("__w", lambda w: F.xxhash64(w)))
    keep_ = [*keep, "n_words", "word_chars", "n_symbols", "__u", "__nl", "n_dup_lines"]
    n = F.col("__size")
    two = _hash2(_shift("__h", 1, n - 1), _shift("__h", 2, n - 1))
    four = _hash2(_shift(two, 1, n - 3), _shift(two, 3, n - 3))
    five = _hash2(_shift(four, 1, n - 4), _shift("__h", 5, n - 4))
    d = _once(d, keep_, __d=F.size(F.array_distinct("__h")), __h5=five)
    keep_ += ["__d"]
    d = _once(d, keep_, __s=F.when(F.size(F.array_distinct("__h5")) < F.size("__h5"), F.sort_array(
        F.transform("__h5", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    n, no = F.size("__s"), F.array(F.lit(False))
    same = F.zip_with(_shift("__s", 1, n - 1), _shift("__s", 2, n - 1), lambda a, b: a["h"] == b["h"])
    repeated = F.zip_with(F.concat(no, same), F.concat(same, no), lambda a, b: a | b)
    d = _once(d, keep_, __p=F.when(F.col("__s").isNotNull(), F.sort_array(F.array_compact(
        F.zip_with("__s", repeated, lambda s, f: F.when(f, s["i"]))))))
    n = F.size("__p")
    gaps = F.zip_with(_shift("__p", 1, n - 1), _shift("__p", 2, n - 1), lambda a, b: F.least(b - a, F.lit(5)))
    covered = F.aggregate(gaps, F.lit(5), lambda a, x: a + x)
    d = _once(d, keep_, n_repeat_words=F.coalesce(F.when(F.col("__p").isNotNull(), covered), F.lit(0)).cast("long"))
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return d.select(
        *keep, *_BASE,
        (F.col("n_symbols") / chars).alias("symbol_share"), (F.col("__u") / chars).alias("upper_share"),
        (F.col("n_dup_lines") / F.greatest("__nl", F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / n).alias("repeat_share"), (F.col("word_chars") / n).alias("word_length"),
        (F.col("__d") / n).alias("distinct_share"),
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"))


Condition = tuple[str, str, float]  # measure, "<=" or ">", threshold


def _holds(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for m, op, cut in rule:
        out = out & ((F.col(m) <= cut) if op == "<=" else (F.col(m) > cut))
    return out


def _worth(p: float, n: float) -> float:
    return (p - n) / (p + n) if p + n else -1.0


def _grow(rows: DataFrame, cuts: dict[str, list[float]], most: int) -> list[Condition]:
    """Adds the condition with the best gain until no document of the other class is covered."""
    rule: list[Condition] = []
    while len(rule) < most:
        bins = F.array(*[F.struct(F.lit(m).alias("m"), sum((F.when(F.col(m) > c, 1).otherwise(0) for c in cuts[m]),
                                                           F.lit(0)).alias("b")) for m in MEASURES])
        got = (rows.where(_holds(rule)).select("y", "weight", F.inline(bins)).groupBy("m", "b")
               .agg(F.sum(F.when(F.col("y") == 0, F.col("weight")).otherwise(0.0)).alias("p"),
                    F.sum(F.when(F.col("y") == 1, F.col("weight")).otherwise(0.0)).alias("n")).collect())
        by = {(r["m"], r["b"]): (r["p"], r["n"]) for r in got}
        first = [v for (m, _), v in by.items() if m == MEASURES[0]]  # each measure counts every row once
        p0, n0 = sum(v[0] for v in first), sum(v[1] for v in first)
        if p0 <= 0 or n0 <= 0:
            break
        best = (1e-9, None)
        for m in MEASURES:
            p = n = 0.0
            for b, cut in enumerate(cuts[m]):
                x = by.get((m, b), (0.0, 0.0))
                p, n = p + x[0], n + x[1]
                for op, a, c in (("<=", p, n), (">", p0 - p, n0 - n)):
                    if a > 0:
                        best = max(best, (a * (log2(a / (a + max(c, 0.0))) - log2(p0 / (p0 + n0))), (m, op, cut)),
                                   key=lambda t: t[0])
        if best[1] is None or best[1] in rule:
            break
        rule.append(best[1])
    return rule


def _prune(rows: DataFrame, rule: list[Condition]) -> tuple[list[Condition], float, float]:
    """The beginning of the rule that is worth most on the pruning rows, and what it covers there."""
    sums = []
    for k in range(1, len(rule) + 1):
        hit = _holds(rule[:k])
        sums += [F.sum(F.when(hit & (F.col("y") == y), F.col("weight")).otherwise(0.0)) for y in (0, 1)]
    got = [x or 0.0 for x in rows.agg(*sums).first()]
    best = max(range(len(rule)), key=lambda k: (_worth(got[2 * k], got[2 * k + 1]), -k))
    return rule[:best + 1], got[2 * best], got[2 * best + 1]


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
          sample: int = SAMPLE, rules: int = 8, conditions: int = 3, precision: float = 0.9) -> list[list[Condition]]:
    """An ordered list of rules for documents to reject (label 0)."""
    marked = labels.where(F.col(label).isin(0, 1))
    totals = {r[label]: r["n"] for r in marked.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return []
    rows = labelled_sample(docs, marked, label, F.lit(True), sample, 14, doc_id, text)
    rows = measure(rows, "text", [doc_id, "y"]).where(~F.col("base_failed"))
    rows = written(rows.withColumn("prune", F.pmod(F.xxhash64(doc_id, F.lit(6)), F.lit(3)) == 0), "measures")
    have = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(have) < 2:
        return []
    # the sample is evened out over the classes; weights undo that
    rows = rows.withColumn("weight", F.when(F.col("y") == 0, totals[0] / have[0]).otherwise(totals[1] / have[1]))
    shares = [(i + .5) / CUTS for i in range(CUTS)]
    got = rows.agg(*[F.percentile_approx(m, shares, 10000).alias(m) for m in MEASURES]).first()
    values = {m: sorted({float(x) for x in got[m]}) for m in MEASURES}
    cuts = {m: [(a + b) / 2 for a, b in zip(v, v[1:])] for m, v in values.items()}  # half-way, not on a value
    out: list[list[Condition]] = []
    while len(out) < rules:
        rule = _grow(rows.where(~F.col("prune")), cuts, conditions)
        if not rule:
            break
        rule, p, n = _prune(rows.where("prune"), rule)
        if (p + 1) / (p + n + 2) < precision:
            break
        out.append(rule)
        rows = rows.where(~_holds(rule))
    return out


def decision(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that rejects a measured document, else null."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        out = F.when(_holds(rules[k - 1]), F.lit(k)).otherwise(out)
    return out


def apply(df: DataFrame, rules: list[list[Condition]], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The measures plus ``rule`` (int, null if none) and ``kept``."""
    d = measure(df, text, keep).drop("rule", "kept").withColumn("rule", decision(rules))
    return d.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    rules = learn(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))
    return apply(docs, rules).select("doc_id", *_BASE, "base_failed", "kept", "rule")
