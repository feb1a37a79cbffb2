"""Catalogue: splitting, set checks and class weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens import constants as K
from ticketlens.operators import split as S
from ticketlens.plans import fixtures as FX
from ticketlens.plans import oracle as O
from ticketlens.plans.registry import query

R = 6
SPLIT = O.split_cte()


@query("e1_stratified_split", O.with_tickets(
    "SELECT ticket_id, category_id, split FROM split_tickets", SPLIT))
def e1_stratified_split(spark, sf_dir):
    return FX.split_tickets(spark, sf_dir).select("ticket_id", "category_id", "split")


@query("d12_split_sizes", O.with_tickets(f"""
SELECT split, n, round(n * 100.0 / sum(n) OVER (), {R}) AS pct
FROM (SELECT split, count(*) AS n FROM split_tickets GROUP BY split) s""", SPLIT))
def d12_split_sizes(spark, sf_dir):
    return S.split_sizes(FX.split_tickets(spark, sf_dir))


@query("d11_category_share_by_split", O.with_tickets(f"""
SELECT category,
       round(count_if(split = 'train') * 100.0 / sum(count_if(split = 'train')) OVER (), {R}) AS train_pct,
       round(count_if(split = 'val') * 100.0 / sum(count_if(split = 'val')) OVER (), {R}) AS val_pct,
       round(count_if(split = 'test') * 100.0 / sum(count_if(split = 'test')) OVER (), {R}) AS test_pct
FROM split_tickets GROUP BY category""", SPLIT))
def d11_category_share_by_split(spark, sf_dir):
    return S.category_share_by_split(FX.split_tickets(spark, sf_dir))


@query("g4_split_check", O.with_tickets("""
SELECT count(*) AS n_total, count_if(split = 'train') AS n_train, count_if(split = 'val') AS n_val,
       count_if(split = 'test') AS n_test,
       (SELECT count(*) FROM (SELECT ticket_id FROM split_tickets GROUP BY ticket_id
                              HAVING count(DISTINCT split) > 1) x) AS ids_in_many_splits,
       (SELECT count(DISTINCT ticket_id) FROM split_tickets) AS distinct_ids
FROM split_tickets""", SPLIT))
def g4_split_check(spark, sf_dir):
    return S.split_check(FX.split_tickets(spark, sf_dir), "ticket_id")


@query("g3_label_set_equality", O.with_tickets(f"""
SELECT (SELECT count(*) FROM (SELECT category FROM tickets EXCEPT SELECT name FROM cat_names) a) AS only_in_data,
       (SELECT count(*) FROM (SELECT name FROM cat_names EXCEPT SELECT category FROM tickets) b) AS only_in_dimension""",
    O.cat_names_cte()))
def g3_label_set_equality(spark, sf_dir):
    """The categories in the data equal the fixed category set (EXCEPT both ways)."""
    # distinct first: the set comparison then runs on the (tiny) aggregated set
    t = FX.tickets(spark, sf_dir).select("category").distinct()
    dim = spark.createDataFrame([(c,) for c in K.CATEGORIES], "category string")
    a = t.subtract(dim).agg(F.count(F.lit(1)).alias("only_in_data"))
    b = dim.subtract(t).agg(F.count(F.lit(1)).alias("only_in_dimension"))
    return a.select("only_in_data", b.scalar().alias("only_in_dimension"))


@query("g2_distinct_labels", O.with_tickets("SELECT DISTINCT label_name, category FROM tickets"))
def g2_distinct_labels(spark, sf_dir):
    return FX.tickets(spark, sf_dir).select("label_name", "category").distinct()


@query("d14_balanced_class_weights", O.with_tickets("""
SELECT 'category' AS head, category_id AS class_id, n_class,
       round(sum(n_class) OVER () / (count(*) OVER () * n_class), 9) AS weight
FROM (SELECT category_id, count(*) AS n_class FROM split_tickets WHERE split = 'train' GROUP BY 1) c
UNION ALL
SELECT 'priority', priority_id, n_class,
       round(sum(n_class) OVER () / (count(*) OVER () * n_class), 9)
FROM (SELECT priority_id, count(*) AS n_class FROM split_tickets WHERE split = 'train' GROUP BY 1) p""", SPLIT))
def d14_balanced_class_weights(spark, sf_dir):
    train = FX.split_tickets(spark, sf_dir).filter(F.col("split") == "train")
    c = S.balanced_class_weights(train, "category_id").select(
        F.lit("category").alias("head"), F.col("category_id").alias("class_id"), "n_class", F.round("weight", 9).alias("weight"))
    p = S.balanced_class_weights(train, "priority_id").select(
        F.lit("priority").alias("head"), F.col("priority_id").alias("class_id"), "n_class",
        F.round("weight", 9).alias("weight"))
    return c.unionByName(p)


@query("d15_inverse_frequency_weights", O.with_tickets("""
SELECT class_id AS category_id, n_class,
       round((1.0 / greatest(n_class, 1)) / sum(1.0 / greatest(n_class, 1)) OVER () * 10, 9) AS weight
FROM (SELECT r.class_id, coalesce(c.n, 0) AS n_class
      FROM range(10) r(class_id)
      LEFT JOIN (SELECT category_id, count(*) AS n FROM split_tickets
                 WHERE split = 'train' GROUP BY 1) c
      ON r.class_id = c.category_id) x""", SPLIT))
def d15_inverse_frequency_weights(spark, sf_dir):
    """D15 on the training split."""
    train = FX.split_tickets(spark, sf_dir).filter(F.col("split") == "train")
    out = S.inverse_frequency_weights(train, "category_id", len(K.CATEGORIES))
    return out.select(F.col("category_id").cast("long"), "n_class", "weight")
