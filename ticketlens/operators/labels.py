"""Label consolidation, priority rules and routing lookups.

All lookups are equi-joins against dimension tables built from fixed,
bounded dictionaries, so broadcasting them is safe at any data size: the
hint is applied only to frames this module builds itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketlens import constants as K
from ticketlens.functions.text import contains_any


MAX_BROADCAST_ENTRIES = 50_000


def dimension(spark: SparkSession, mapping, key: str, value: str,
              key_type: str = "string", value_type: str = "string") -> DataFrame:
    """A lookup table from a dict or a list of pairs, broadcast while it has at
    most ``MAX_BROADCAST_ENTRIES`` of them and joined by shuffle beyond."""
    items = list(mapping.items()) if isinstance(mapping, dict) else list(mapping)
    df = spark.createDataFrame(items, f"{key} {key_type}, {value} {value_type}")
    return F.broadcast(df) if len(items) <= MAX_BROADCAST_ENTRIES else df


def id_dimension(spark: SparkSession, names, name_col: str, id_col: str) -> DataFrame:
    """Name -> 0-based position."""
    return dimension(spark, [(n, i) for i, n in enumerate(names)], name_col, id_col,
                     value_type="int")


def map_labels(df: DataFrame, label_map=None, label_col: str = "label_name",
               default: str | None = K.DEFAULT_CATEGORY, out_col: str = "category") -> DataFrame:
    """C1 + B5: raw label -> category by broadcast left join; unmapped -> default."""
    spark = df.sparkSession
    dim = dimension(spark, label_map or K.LABEL_TO_CATEGORY, "_lbl", "_cat")
    out = df.join(dim, df[label_col] == dim["_lbl"], "left").drop("_lbl")
    val = F.col("_cat") if default is None else F.coalesce(F.col("_cat"), F.lit(default))
    return out.withColumn(out_col, val).drop("_cat")


def unmapped_labels(df: DataFrame, label_map=None, label_col: str = "label_name") -> DataFrame:
    """Distinct raw labels with no category (anti join against the map)."""
    spark = df.sparkSession
    dim = dimension(spark, label_map or K.LABEL_TO_CATEGORY, "_lbl", "_cat")
    return (df.select(label_col).join(dim, F.col(label_col) == dim["_lbl"], "left_anti")
            .distinct())


def consolidate(corpus_a: DataFrame, oos_tickets: DataFrame, label_map=None) -> DataFrame:
    """C1 + B5 + G1: labelled tickets plus out-of-scope rows, all with a category."""
    mapped = map_labels(corpus_a, label_map)
    oos = oos_tickets.withColumn("category", F.lit(K.DEFAULT_CATEGORY))
    return mapped.unionByName(oos)


def priority_expr(text: Column, category: Column, spark: SparkSession | None = None,
                  p0=K.P0_KEYWORDS, p1=K.P1_KEYWORDS, base_map=None) -> Column:
    """B7 as one expression: P0 keyword > P1 keyword > category's base priority.

    The base map is tiny and fixed, so it is inlined as a CASE expression
    (no join at all); null text falls through to the base priority.
    """
    base_map = base_map or K.CATEGORY_TO_PRIORITY
    base = None
    for cat, pri in base_map.items():
        base = (F.when(category == cat, F.lit(pri)) if base is None
                else base.when(category == cat, F.lit(pri)))
    base = base.otherwise(F.lit(None).cast("string"))
    return (F.when(F.coalesce(contains_any(text, p0), F.lit(False)), F.lit(K.PRIORITIES[0]))
            .when(F.coalesce(contains_any(text, p1), F.lit(False)), F.lit(K.PRIORITIES[1]))
            .otherwise(base))


def assign_priority(df: DataFrame, p0=K.P0_KEYWORDS, p1=K.P1_KEYWORDS, base_map=None,
                    text_col: str = "text", category_col: str = "category") -> DataFrame:
    """B7 + C2: add ``priority``."""
    return df.withColumn("priority", priority_expr(F.col(text_col), F.col(category_col),
                                                   p0=p0, p1=p1, base_map=base_map))


def add_ids(df: DataFrame, categories=K.CATEGORIES, priorities=K.PRIORITIES) -> DataFrame:
    """Category -> id and priority -> id by broadcast joins on fixed dimensions."""
    spark = df.sparkSession
    cat = id_dimension(spark, categories, "category", "category_id")
    pri = id_dimension(spark, priorities, "priority", "priority_id")
    return df.join(cat, "category", "left").join(pri, "priority", "left")


def id_to_name(df: DataFrame, id_col: str, out_col: str, names) -> DataFrame:
    """C4: id -> name by broadcast join."""
    spark = df.sparkSession
    dim = dimension(spark, [(i, n) for i, n in enumerate(names)], "_id", out_col,
                    key_type="int")
    return df.join(dim, df[id_col] == dim["_id"], "left").drop("_id")


def dense_ids(df: DataFrame, name_col: str, id_col: str) -> DataFrame:
    """Distinct names with a dense 0-based id in sorted-name order, by
    positions in ranges (no task sorts all names)."""
    from ticketlens.operators.ordering import ranked
    names = df.select(name_col).where(F.col(name_col).isNotNull()).distinct()
    return ranked(names, [F.asc(name_col)], "_rank").select(name_col, (F.col("_rank") - 1).cast("int").alias(id_col))


def route_team(df: DataFrame, category_col: str = "category", out_col: str = "routing_team",
               team_map=None, fallback: str = K.FALLBACK_TEAM) -> DataFrame:
    """Category -> team, unknown categories to the fallback team."""
    spark = df.sparkSession
    dim = dimension(spark, team_map or K.CATEGORY_TO_TEAM, "_rt_cat", "_rt_team")
    out = df.join(dim, df[category_col] == dim["_rt_cat"], "left").drop("_rt_cat")
    return out.withColumn(out_col, F.coalesce(F.col("_rt_team"), F.lit(fallback))).drop("_rt_team")


def sla_dimension(spark: SparkSession, sla=None) -> DataFrame:
    sla = sla or K.PRIORITY_SLA
    rows = [(p, label, int(minutes)) for p, (label, minutes) in sla.items()]
    return F.broadcast(spark.createDataFrame(
        rows, "priority string, sla_label string, sla_minutes int"))


def priority_sla(df: DataFrame, priority_col: str = "priority", opened_col: str | None = None,
                 handled_col: str | None = None, sla=None) -> DataFrame:
    """SLA label and target; with timestamps, a deadline and a breach flag."""
    spark = df.sparkSession
    dim = sla_dimension(spark, sla).withColumnRenamed("priority", "_pri")
    out = df.join(dim, df[priority_col] == dim["_pri"], "left").drop("_pri")
    if opened_col:
        out = out.withColumn(
            "sla_deadline",
            F.col(opened_col) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("sla_minutes")))
        if handled_col:
            out = out.withColumn("sla_breached", F.col(handled_col) > F.col("sla_deadline"))
    return out


def confidence_gate(df: DataFrame, conf_col: str = "category_confidence",
                    category_col: str = "category", threshold: float = K.AUTO_ROUTE_THRESHOLD,
                    team_map=None) -> DataFrame:
    """Below the threshold -> human review with a reason; else the category's team.

    The comparison uses the unrounded confidence.
    """
    df = route_team(df, category_col, "_team", team_map)
    low = F.col(conf_col) < F.lit(float(threshold))
    from ticketlens.functions.text import low_confidence_reason
    return (df.withColumn("review_status", F.when(low, F.lit(K.STATUS_REVIEW))
                          .otherwise(F.lit(K.STATUS_AUTO)))
              .withColumn("review_reason", F.when(low, low_confidence_reason(conf_col, threshold))
                          .otherwise(F.lit(None).cast("string")))
              .withColumn("routing_team", F.when(low, F.lit(K.REVIEW_TEAM)).otherwise(F.col("_team")))
              .drop("_team"))
