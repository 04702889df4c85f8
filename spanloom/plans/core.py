"""Queries of the core operators, with the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.functions.chrom import resolve
from spanloom.operators.periods import periods_and_gaps
from spanloom.session import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = resolve(table(spark, folder, "some_intervals"), table(spark, folder, "chroms"))
    return periods_and_gaps(rows, ["panel_id", "chrom"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p4_found": p4_found}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": """WITH n AS (SELECT chrom, lower(trim(chrom, ' ' || chr(9))) AS k FROM chroms UNION SELECT chrom, lower(trim(alt_name, ' ' || chr(9))) FROM chroms),
i AS (SELECT panel_id, n.chrom, start AS s, "end" AS e FROM some_intervals JOIN n ON lower(trim(chr, ' ' || chr(9))) = n.k WHERE "end" > start),
m AS (SELECT *, max(e) OVER (PARTITION BY panel_id, chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM i),
f AS (SELECT *, sum(CASE WHEN s <= pe THEN 0 ELSE 1 END) OVER (PARTITION BY panel_id, chrom ORDER BY s, e, pe NULLS FIRST ROWS UNBOUNDED PRECEDING) AS g FROM m),
p AS (SELECT panel_id, chrom, g, min(s) AS a, max(e) AS b FROM f GROUP BY ALL),
x AS (SELECT *, lead(a) OVER (PARTITION BY panel_id, chrom ORDER BY a) AS nx FROM p)
SELECT panel_id, chrom, 'period' AS kind, a AS from_base, b AS to_base FROM x UNION ALL SELECT panel_id, chrom, 'gap', b, nx FROM x WHERE nx IS NOT NULL""",
    }
