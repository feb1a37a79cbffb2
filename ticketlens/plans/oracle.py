"""DuckDB text for the oracle side, built from the same parameters as the
Spark side (``plans.fixtures``), so the two can never drift apart silently.
"""

from __future__ import annotations

from ticketlens import constants as K
from ticketlens.operators.split import split_cuts
from ticketlens.plans import fixtures as FX

WS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else repr(v) for v in r) + ")"
                     for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS _v({', '.join(cols)}))"


def any_keyword(col: str, kws) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), {q(k.lower())})" for k in kws) + ")"


def case_map(col: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {col} = {q(k)} THEN {q(v) if isinstance(v, str) else v}"
                     for k, v in mapping.items())
    return f"(CASE {whens} ELSE {default} END)"


def word_count(col: str) -> str:
    return (f"CAST(CASE WHEN {col} IS NULL THEN NULL ELSE "
            f"len(list_filter(regexp_split_to_array({col}, '{WS}+'), lambda w: w <> '')) END AS INTEGER)")


def strip(col: str) -> str:
    return f"regexp_replace({col}, '^{WS}+|{WS}+$', '', 'g')"


CORPUS_B = f"""corpus_b AS (
  SELECT item_id AS item_key, CAST(NULL AS BIGINT) AS turn, text, {q(K.OUT_OF_SCOPE_LABEL)} AS intent_name FROM benchmark
  UNION ALL
  SELECT conv_id AS item_key, turn, text, 'user_turn' AS intent_name
  FROM conversations WHERE role = 'user')"""


def tickets_cte(label_map=None, p0=None, p1=None) -> str:
    """CTEs ``corpus_b`` and ``tickets`` (consolidated, prioritised, with ids)."""
    label_map = label_map or FX.FIXTURE_LABEL_MAP
    p0 = p0 or FX.FIXTURE_P0
    p1 = p1 or FX.FIXTURE_P1
    cat_ids = {c: i for i, c in enumerate(K.CATEGORIES)}
    pri_ids = {p: i for i, p in enumerate(K.PRIORITIES)}
    return f"""{CORPUS_B},
label_dim AS {values(label_map.items(), ['label_name', 'category'])},
consolidated AS (
  SELECT d.doc_id AS ticket_id, d.text, d.source AS label_name,
         coalesce(m.category, {q(K.DEFAULT_CATEGORY)}) AS category
  FROM documents d LEFT JOIN label_dim m ON d.source = m.label_name
  UNION ALL
  SELECT -item_key - 1, text, intent_name, {q(K.DEFAULT_CATEGORY)}
  FROM corpus_b WHERE intent_name = {q(K.OUT_OF_SCOPE_LABEL)}),
prioritised AS (
  SELECT *, CASE WHEN {any_keyword('text', p0)} THEN {q(K.PRIORITIES[0])}
                 WHEN {any_keyword('text', p1)} THEN {q(K.PRIORITIES[1])}
                 ELSE {case_map('category', K.CATEGORY_TO_PRIORITY)} END AS priority
  FROM consolidated),
tickets AS (
  SELECT ticket_id, text, label_name, category,
         CAST({case_map('category', cat_ids)} AS INTEGER) AS category_id,
         priority, CAST({case_map('priority', pri_ids)} AS INTEGER) AS priority_id
  FROM prioritised)"""


PREDICTIONS = """predictions AS (
  SELECT *,
    CASE WHEN h1 >= 200 AND h1 % 7 <> 0 THEN category_id
         ELSE CAST((category_id + 1 + abs(ticket_id) % 9) % 10 AS INTEGER) END AS pred_category_id,
    (3000 + h1 * 7) / 10000.0 AS category_confidence,
    CASE WHEN h2 >= 150 AND h2 % 11 <> 0 THEN priority_id
         ELSE CAST((priority_id + 1 + abs(ticket_id) % 3) % 4 AS INTEGER) END AS pred_priority_id,
    (2500 + h2 * 7) / 10000.0 AS priority_confidence
  FROM (SELECT *, abs(ticket_id * 7919 + 13) % 1000 AS h1,
               abs(ticket_id * 104729 + 7) % 1000 AS h2 FROM tickets) _p)"""


def split_cte(source: str = "tickets", by: str = "category_id", id_col: str = "ticket_id",
              ratios=K.SPLIT_RATIOS, seed: int = K.SPLIT_SEED, name: str = "split_tickets") -> str:
    c1, c2 = split_cuts(ratios)
    return f"""{name} AS (
  SELECT * EXCLUDE (_rn, _n),
    CASE WHEN _rn <= (_n * {c1} + 500000) // 1000000 THEN 'train'
         WHEN _rn <= (_n * {c2} + 500000) // 1000000 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5('{seed}:' || {id_col}), {id_col}) AS _rn,
               count(*) OVER (PARTITION BY {by}) AS _n FROM {source}) _s)"""


def cat_names_cte() -> str:
    return "cat_names AS " + values([(i, c) for i, c in enumerate(K.CATEGORIES)],
                                    ["id", "name"])


def with_tickets(body: str, *extra: str) -> str:
    ctes = [tickets_cte(), *extra]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def with_predictions(body: str, *extra: str) -> str:
    return with_tickets(body, PREDICTIONS, *extra)
