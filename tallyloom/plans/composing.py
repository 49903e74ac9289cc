"""The whole dataset as a query, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import composition
from tallyloom.operators.bridge import BRIDGE_FIELDS
from tallyloom.plans.queries import _ORD, _SEG, _ST
from tallyloom.sources.tables import order_statements, segments, statements

QUARTER = ["company", "q_ord"]


def dataset_parts(spark: SparkSession, sf_dir: str) -> composition.Parts:
    """Statements of lines as candidates, without costs in some quarters; orders beside them as the fallback."""
    r3, q = composition._rounded, F.col("q_ord")
    own = statements(spark, sf_dir)
    cells = F.array(
        F.struct(F.lit("revenue").alias("field"), F.col("revenue").alias("value")), F.struct(F.lit("cost").alias("field"), F.when(q % 3 != 0, F.col("cost")).alias("value")),
        F.struct(F.lit("opex").alias("field"), F.when(q % 5 == 0, r3(F.col("revenue") * 2)).otherwise(F.col("tax")).alias("value")), F.struct(F.lit("net").alias("field"), F.when(q % 4 != 0, r3(F.col("revenue") * 0.2)).alias("value")), F.struct(F.lit("tax").alias("field"), F.col("tax").alias("value")),
    )
    told = own.select(*QUARTER, F.inline(cells)).filter("value IS NOT NULL")
    candidates = told.select(*QUARTER, "field", "value", F.lit("lines").alias("source"), F.lit(0).alias("source_order"), F.lit(5).alias("priority"), F.lit(True).alias("has_url"), F.lit(True).alias("has_date"), F.lit(False).alias("has_flags"))
    null = F.lit(None).cast("double")
    second = own.join(order_statements(spark, sf_dir).select(*QUARTER, F.col("revenue").alias("ordered")), QUARTER, "full_outer")
    revenue = F.coalesce("revenue", "ordered")
    fields = {"revenue": revenue, "cost": r3(revenue * 0.55), "gross": r3(revenue - r3(revenue * 0.55)), "op_income": r3(revenue * 0.3), "pretax": F.when(q % 2 == 0, r3(revenue * 0.28))}
    fallback = second.select(*QUARTER, *(fields.get(f, null).alias(f) for f in BRIDGE_FIELDS), F.lit("orders").alias("source"))
    overrides = own.filter("q_ord % 11 = 0").select(*QUARTER, F.lit("net").alias("field"), F.lit(1.5).alias("value"))
    rates = own.filter("company >= 10").select(*QUARTER, (1 + F.col("company") / 64).alias("rate"))
    return {"candidates": candidates, "segments": segments(spark, sf_dir), "fallback": fallback, "overrides": overrides, "rates": rates}


def company_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composition.dataset(dataset_parts(spark, sf_dir))


QUERIES = {"company_dataset": company_dataset}


def _r3(x: str) -> str:
    return f"(floor(({x}) * 1000 + 0.5) / 1000)"


_LOWER = ("sgna", "rnd", "other_opex", "opex", "op_income", "non_op", "pretax", "tax", "net")
_DERIVED = {"gross": "revenue - cost", "cost": "revenue - gross", "opex": "gross - op_income", "op_income": "gross - opex", "pretax": "net + tax", "net": "pretax - tax", "tax": "pretax - net"}


def _derive(table: str) -> str:
    part = lambda fields: ", ".join(f"coalesce({f}, {_r3(_DERIVED[f])}) AS {f}" for f in fields)
    return f"SELECT * REPLACE ({part(list(_DERIVED)[2:])}) FROM (SELECT * REPLACE ({part(['gross', 'cost'])}) FROM {table})"


_alike = lambda f, least, part: f"coalesce(abs(p.{f} - f.{f}) <= greatest({least}, greatest(abs(p.{f}), abs(f.{f})) * {part}), true)"
_far = lambda f, part, more: f"coalesce(abs(p.{f} - f.{f}) > greatest(1.2, abs(f.{f}) * {part} + {more}), false)"
_swap = lambda f: f"CASE WHEN whole{' OR stage' if f in _LOWER else ''} THEN coalesce(f_{f}, {f}) ELSE coalesce({f}, f_{f}) END AS {f}"
_NULL = "NULL::DOUBLE AS "
ORACLE_SQL = {
    "company_dataset": f"""WITH {_ST}, {_ORD}, {_SEG},
        s0 AS (SELECT company, q_ord, revenue, CASE WHEN q_ord % 3 <> 0 THEN cost END AS cost, {_NULL}gross, {_NULL}sgna, {_NULL}rnd, {_NULL}other_opex, CASE WHEN q_ord % 5 = 0 THEN {_r3('revenue * 2')} ELSE tax END AS opex, {_NULL}op_income, {_NULL}non_op, {_NULL}pretax, tax, CASE WHEN q_ord % 4 <> 0 THEN {_r3('revenue * 0.2::DOUBLE')} END AS net FROM st),
        s1 AS ({_derive('s0')}),
        g AS (SELECT company, q_ord, {_r3('sum(value)')} AS segment_sum, count(*) AS n_segments FROM seg GROUP BY 1, 2),
        p AS (SELECT * FROM s1 LEFT JOIN g USING (company, q_ord)),
        b AS (SELECT company, q_ord, coalesce(st.revenue, ord.revenue) AS revenue FROM st FULL JOIN ord USING (company, q_ord)),
        f AS (SELECT company, q_ord, revenue, {_r3('revenue * 0.55::DOUBLE')} AS cost, {_r3('revenue - ' + _r3('revenue * 0.55::DOUBLE'))} AS gross, {_NULL}sgna, {_NULL}rnd, {_NULL}other_opex, {_NULL}opex, {_r3('revenue * 0.3::DOUBLE')} AS op_income, {_NULL}non_op, CASE WHEN q_ord % 2 = 0 THEN {_r3('revenue * 0.28::DOUBLE')} END AS pretax, {_NULL}tax, {_NULL}net FROM b),
        m AS (SELECT company, q_ord, {', '.join(f'p.{f}' for f in BRIDGE_FIELDS)}, {', '.join(f'f.{f} AS f_{f}' for f in BRIDGE_FIELDS)}, p.revenue IS NOT NULL AS own,
            p.revenue IS NOT NULL AND f.revenue IS NOT NULL AND p.cost IS NULL AND p.gross IS NULL AND f.cost IS NOT NULL AND f.gross IS NOT NULL AND (coalesce(p.opex > p.revenue + 0.25, false) OR coalesce(coalesce(segment_sum, 0) > p.revenue + greatest(0.25, p.revenue * 0.08), false)) AS whole,
            p.revenue IS NOT NULL AND f.revenue IS NOT NULL AND {_alike('revenue', 0.12, 0.006)} AND {_alike('gross', 0.12, 0.008)} AND {_alike('pretax', 0.18, 0.012)} AND {_alike('tax', 0.18, 0.02)} AND {_alike('net', 0.18, 0.012)}
                AND coalesce(abs(f.opex - greatest(f.gross - f.op_income, 0)) <= greatest(0.35, f.gross * 0.03), false) AND ({_far('opex', 0.24, 0)} OR {_far('op_income', 0.24, 0.4)} OR {_far('non_op', 0.4, 0.4)}) AS stage FROM p FULL JOIN f USING (company, q_ord)),
        n AS (SELECT company, q_ord, {', '.join(map(_swap, BRIDGE_FIELDS))}, CASE WHEN stage THEN 'official+operating-stage-fallback' WHEN whole THEN 'official+financial-fallback' WHEN own THEN 'official' ELSE 'orders' END AS source FROM m),
        n1 AS ({_derive('n')}), n2 AS (SELECT * FROM n1 LEFT JOIN g USING (company, q_ord)),
        c AS (SELECT *, coalesce(greatest(cost, gross, opex, op_income, pretax, net) > revenue * 1.18::DOUBLE, false) AND revenue > 0 AS cleared FROM n2),
        c1 AS (SELECT * REPLACE ({', '.join(f'CASE WHEN NOT cleared THEN {f} END AS {f}' for f in BRIDGE_FIELDS if f != 'revenue')}) FROM c),
        o AS (SELECT c1.* REPLACE (CASE WHEN st.company IS NOT NULL AND c1.q_ord % 11 = 0 THEN 1.5::DOUBLE ELSE net END AS net), CASE WHEN st.company >= 10 THEN 1 + st.company / 64 ELSE 1 END AS rate FROM c1 LEFT JOIN st ON st.company = c1.company AND st.q_ord = c1.q_ord),
        y AS (SELECT *, {_r3('revenue * rate')} AS display_revenue, max(revenue) OVER (PARTITION BY company ORDER BY q_ord RANGE BETWEEN 4 PRECEDING AND 4 PRECEDING) AS before FROM o)
        SELECT * EXCLUDE (before, rate), CASE WHEN before > 0 AND revenue > 0 THEN {_r3('(revenue / before - 1) * 100')} END AS revenue_yoy,
            'missing-required:' || nullif(array_to_string(list_filter([CASE WHEN revenue IS NULL THEN 'revenue' END, CASE WHEN op_income IS NULL THEN 'op_income' END, CASE WHEN net IS NULL THEN 'net' END], lambda x: x IS NOT NULL), ','), '') AS issues,
            CASE WHEN n_segments > 0 THEN 'explicit' ELSE 'none' END AS segments_mode, CASE WHEN revenue > 0 THEN {_r3('segment_sum / revenue')} END AS segment_share FROM y""",
}
