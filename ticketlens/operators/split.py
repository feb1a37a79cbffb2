"""Stratified splitting, seeded sampling and class weights.

Exact stratified split without a hot task
-----------------------------------------
A per-class ``row_number()`` window would put a whole class in one task --
fatal when one class holds a third of 100 TB.  ``exact_group_rank`` keeps
the same result but splits every class into hash buckets:

1. order key = md5("<seed>:<id>") (uniform, deterministic), tie-break id;
2. bucket   = first ``bucket_digits`` hex digits of that key, so bucket
   order agrees with key order;
3. counts per (class, bucket) -- a map-side-combined aggregate, tiny;
4. offset of a bucket = rows of the same class in earlier buckets
   (window over the tiny count table, broadcast back);
5. rank = offset + row_number() within (class, bucket).

Every window partition holds about ``n_class / 16**bucket_digits`` rows.
No sampling is involved, so re-running a lost task gives the same ranks.
``stratified_split`` needs only the rows at its cuts: it ranks the buckets
that hold one and compares all other rows with the boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens import constants as K
from ticketlens.session import stored

SPLIT_NAMES = ("train", "val", "test")
#: Classes up to which the table of boundaries is broadcast.
MAX_BROADCAST_CLASSES = 50_000


def seeded_key(id_col, seed: int = K.SPLIT_SEED) -> Column:
    """md5 of ``"<seed>:<id>"`` as lowercase hex."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def exact_group_rank(df: DataFrame, group_cols, id_col: str, seed: int = K.SPLIT_SEED,
                     bucket_digits: int = 3, rank_col: str = "_rank",
                     size_col: str = "_group_rows") -> DataFrame:
    """1-based rank within each group by (seeded hash, id), plus the group size."""
    group_cols = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    keyed = (df.withColumn("_key", seeded_key(id_col, seed))
               .withColumn("_bucket", F.substring("_key", 1, bucket_digits)))
    counts = keyed.groupBy(*group_cols, "_bucket").agg(F.count(F.lit(1)).alias("_bn"))
    w_off = Window.partitionBy(*group_cols).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*group_cols)
    offsets = (counts.withColumn("_offset", F.coalesce(F.sum("_bn").over(w_off), F.lit(0)))
                     .withColumn(size_col, F.sum("_bn").over(w_all))
                     .drop("_bn"))
    # One row per (group, bucket): bounded by groups x 16**digits, so the
    # broadcast size is known before running.
    w_local = Window.partitionBy(*group_cols, "_bucket").orderBy("_key", id_col)
    ranked = keyed.withColumn("_local", F.row_number().over(w_local))
    out = ranked.join(F.broadcast(offsets), [*group_cols, "_bucket"], "inner")
    return (out.withColumn(rank_col, (F.col("_offset") + F.col("_local")).cast("long"))
               .drop("_key", "_bucket", "_local", "_offset"))


def _ppm(x: float) -> int:
    return int(round(x * 1_000_000))


def split_cuts(ratios) -> list[int]:
    """Cumulative cut points in parts per million (exact integer rounding)."""
    cuts, acc = [], 0
    for r in ratios[:-1]:
        acc += _ppm(r)
        cuts.append(acc)
    return cuts


def class_boundaries(df: DataFrame, by: str, id_col: str, ratios=K.SPLIT_RATIOS, seed: int = K.SPLIT_SEED,
                     bucket_digits: int = 3) -> DataFrame:
    """``(by, cuts)``: per class the last (key, id) of each part, in the order of
    the cuts (null where a part is empty), by exact rank.

    Counts per (class, bucket) tell which bucket holds a cut; only those
    buckets' rows, without their text, are ranked."""
    keyed = df.select(F.col(by).alias("_c"), F.col(id_col).alias("_id"), seeded_key(id_col, seed).alias("_key"))
    keyed = keyed.withColumn("_bucket", F.substring("_key", 1, bucket_digits))
    counts = keyed.groupBy("_c", "_bucket").agg(F.count(F.lit(1)).alias("_bn"))
    before = Window.partitionBy("_c").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = (counts.withColumn("_off", F.coalesce(F.sum("_bn").over(before), F.lit(0)))
              .withColumn("_n", F.sum("_bn").over(Window.partitionBy("_c"))))
    bounds = F.array(*[F.struct(F.lit(k).alias("_k"), F.expr(f"(_n * {cut} + 500000) div 1000000").alias("_b"))
                       for k, cut in enumerate(split_cuts(ratios))])
    held = (counts.select("_c", "_bucket", "_off", "_bn", F.inline(bounds))
            .where((F.col("_off") < F.col("_b")) & (F.col("_b") <= F.col("_off") + F.col("_bn")))
            .select(F.col("_c").alias("_hc"), F.col("_bucket").alias("_hb"), "_k", (F.col("_b") - F.col("_off")).alias("_at")))
    here = keyed["_c"].eqNullSafe(held["_hc"]) & (keyed["_bucket"] == held["_hb"])
    near = keyed.join(held.select("_hc", "_hb").distinct(), here, "left_semi")
    rank = F.row_number().over(Window.partitionBy("_c", "_bucket").orderBy("_key", "_id"))
    near = near.withColumn("_rank", rank)
    here = near["_c"].eqNullSafe(held["_hc"]) & (near["_bucket"] == held["_hb"]) & (near["_rank"] == held["_at"])
    found = near.join(held, here).select("_c", "_k", F.struct("_key", "_id").alias("_last"))
    last = [F.max(F.when(F.col("_k") == k, F.col("_last"))).alias(f"_cut{k}") for k in range(len(ratios) - 1)]
    return found.groupBy("_c").agg(*last)


def stratified_split(df: DataFrame, by: str, id_col: str, ratios=K.SPLIT_RATIOS,
                     seed: int = K.SPLIT_SEED, names=SPLIT_NAMES,
                     bucket_digits: int = 3) -> DataFrame:
    """Exact per-class proportions; cut k of a class of n rows is round(n * cum_ratio_k).

    Rows are compared with their class's boundaries, a row per class, so no
    text is shuffled or sorted; rows that share an id share a split."""
    cuts = stored(class_boundaries(df, by, id_col, ratios, seed, bucket_digits), "boundaries")
    if cuts.count() <= MAX_BROADCAST_CLASSES:
        cuts = F.broadcast(cuts)
    mine = F.struct(seeded_key(id_col, seed).alias("_key"), F.col(id_col).alias("_id"))
    out = df.withColumn("_mine", mine)
    out = out.join(cuts, out[by].eqNullSafe(cuts["_c"]), "left")
    expr = F
    for k in range(len(ratios) - 1):
        expr = expr.when(F.col("_mine") <= F.col(f"_cut{k}"), F.lit(names[k]))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], expr.otherwise(F.lit(names[len(ratios) - 1])).alias("split"))


def hash_split(df: DataFrame, id_col: str, ratios=K.SPLIT_RATIOS, seed: int = K.SPLIT_SEED,
               names=SPLIT_NAMES) -> DataFrame:
    """E1, streaming-friendly form: a row's split depends only on its own id.

    No shuffle and no per-class counts; class proportions hold in
    expectation instead of exactly.
    """
    u = F.conv(F.substring(seeded_key(id_col, seed), 1, 8), 16, 10).cast("long")
    expr = None
    for cut, name in zip(split_cuts(ratios), names):
        bound = F.lit(int(cut * (1 << 32) // 1_000_000))
        expr = F.when(u < bound, F.lit(name)) if expr is None else expr.when(u < bound, F.lit(name))
    return df.withColumn("split", expr.otherwise(F.lit(names[len(ratios) - 1])))


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = K.SPLIT_SEED) -> DataFrame:
    """E5: exactly ``n`` rows chosen by seeded hash order (a top-n, not a full sort)."""
    return (df.withColumn("_key", seeded_key(id_col, seed))
              .orderBy("_key", id_col).limit(n).drop("_key"))


def split_sizes(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows per split and share of all rows in percent."""
    c = df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6))


def split_check(df: DataFrame, id_col: str, split_col: str = "split") -> DataFrame:
    """One row -- total, rows per split, ids in more than one split."""
    per_id = df.groupBy(id_col).agg(F.countDistinct(split_col).alias("_k"), F.count(F.lit(1)).alias("_c"))
    overlap = per_id.agg(F.count_if(F.col("_k") > 1).alias("ids_in_many_splits"),
                         F.count(F.lit(1)).alias("distinct_ids"))
    sizes = df.agg(F.count(F.lit(1)).alias("n_total"),
                   *[F.count_if(F.col(split_col) == s).alias(f"n_{s}") for s in SPLIT_NAMES])
    o = overlap.select(F.struct("ids_in_many_splits", "distinct_ids")).scalar()
    return sizes.select("*", o["ids_in_many_splits"].alias("ids_in_many_splits"),
                        o["distinct_ids"].alias("distinct_ids"))


def category_share_by_split(df: DataFrame, class_col: str = "category",
                            split_col: str = "split") -> DataFrame:
    """Per class, its share (percent) of each split; pivot with listed values."""
    counts = df.groupBy(class_col).pivot(split_col, list(SPLIT_NAMES)).count().na.fill(0)
    w = Window.partitionBy()  # over the per-class count table only
    return counts.select(class_col, *[
        F.round(F.col(s) * 100.0 / F.sum(s).over(w), 6).alias(f"{s}_pct") for s in SPLIT_NAMES])


def balanced_class_weights(df: DataFrame, label_col: str) -> DataFrame:
    """N / (k * n_c) over the classes present."""
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_class"))
    w = Window.partitionBy()
    return c.withColumn("weight", F.sum("n_class").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_class")))


def inverse_frequency_weights(df: DataFrame, label_col: str, num_classes: int) -> DataFrame:
    """(1 / max(n_c, 1)) normalised to sum to k; absent classes count as 1."""
    spark = df.sparkSession
    classes = spark.range(num_classes).select(F.col("id").cast("int").alias(label_col))
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_class"))
    full = F.broadcast(classes).join(c, label_col, "left").na.fill(0, ["n_class"])
    inv = 1.0 / F.greatest(F.col("n_class"), F.lit(1))
    w = Window.partitionBy()
    return (full.withColumn("_inv", inv)
                .withColumn("weight", F.round(F.col("_inv") / F.sum("_inv").over(w) * num_classes, 9))
                .drop("_inv"))
