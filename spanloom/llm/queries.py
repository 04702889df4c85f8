"""Queries of the training-data operators, with the SQL that gives the same result where SQL can."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.chrom import BLANKS, resolve, spelling
from spanloom.llm import cross_split, group_split, leaks, mixture, quantiles, reading, runs, tokens
from spanloom.session import checkpoint, table

TRACK_KEY = ["track_id", "chrom", "start", "end", "value", "run_day"]
PCTS, SUMMARY = (20, 50, 80), (5, 20, 50, 80, 95)


def split_name(split: Column) -> Column:
    """train, validation or test, however spelled; null for anything else."""
    s = spelling(split)
    return F.when(s.startswith("val"), "validation").when(s.isin("train", "test"), s)


def _day_sketch(spark: SparkSession, folder: str) -> DataFrame:
    steps = table(spark, folder, "track_intervals").where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("chrom").isNotNull())
    return quantiles.sketch(steps.select(*TRACK_KEY).distinct(), "value", ["chrom", "run_day"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return quantiles.outlying_days(_day_sketch(spark, folder), "chrom", "run_day", PCTS)


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Median and other percentiles per chromosome, from the days' sketches."""
    merged = quantiles.merge(_day_sketch(spark, folder), ["chrom"])
    found = quantiles.percentiles(merged, ["chrom"], SUMMARY)
    return found.withColumns({f"p{p}": F.round(f"p{p}", 6) for p in SUMMARY})


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.collapse_runs(table(spark, folder, "track_intervals"), min_rows=3)
    return found.select("track_id", "chrom", "run_start", "run_end", "n_rows")


def p2_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All runs, single rows included, with their length."""
    found = runs.collapse_runs(table(spark, folder, "track_intervals"))
    return found.select("track_id", "chrom", "run_start", "run_end", "n_rows", (F.col("run_end") - F.col("run_start")).alias("n_bases"))


def _panel_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = resolve(table(spark, folder, "some_intervals"), table(spark, folder, "chroms"))
    return rows.select(F.col("interval_id").alias("id"), F.col("chrom").alias("key"), F.col("start").alias("s"), F.col("end").alias("e"), split_name(F.col("split")).alias("split"), F.lower(F.btrim("source", F.lit(BLANKS))).alias("source"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = cross_split.row_pairs(_panel_rows(spark, folder))
    return pairs.select(F.least("train_id", "held_id").alias("interval_id_a"), F.greatest("train_id", "held_id").alias("interval_id_b"))


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out rows with a partner in train, per split and source."""
    return cross_split.leak_counts(_panel_rows(spark, folder))


def _chrom_components(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling of a sequence, with the least one of its component."""
    chroms = table(spark, folder, "chroms")
    return group_split.named_by_least(group_split.components(chroms.select(spelling(F.col("chrom")).alias("u"), spelling(F.col("alt_name")).alias("v"))))


def _with_component(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "some_intervals").withColumn("vertex", spelling(F.col("chr")))
    return rows.join(_chrom_components(spark, folder), "vertex", "left")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = _with_component(spark, folder).select("interval_id", "component", split_name(F.col("split")).alias("split"))
    return group_split.misplaced(rows, "component", "split").select("interval_id")


def p5_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Chromosomes given to splits: target and reached share of rows."""
    rows, targets = _with_component(spark, folder), table(spark, folder, "split_targets")
    weights = rows.where(F.col("component").isNotNull()).groupBy("component").agg(F.count(F.lit(1)).alias("weight"))
    given = group_split.split_components(weights, targets)
    reached = given.groupBy("split_name").agg(F.count(F.lit(1)).alias("n_components"), F.sum("weight").alias("n_rows"))
    return targets.join(reached, "split_name", "left").na.fill(0, ["n_components", "n_rows"])


def p5_assigned(spark: SparkSession, folder: str) -> DataFrame:
    """Every row with its split; rows that name no chromosome are components of their own, weighed one each."""
    rows, targets = _with_component(spark, folder), table(spark, folder, "split_targets")
    rows = rows.select("interval_id", F.coalesce("component", F.concat(F.lit("row="), F.col("interval_id").cast("string"))).alias("component"))
    weights = rows.groupBy("component").agg(F.count(F.lit(1)).alias("weight"))
    return rows.join(group_split.split_components(weights, targets).select("component", "split_name"), "component").select("interval_id", "split_name")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    items, documents = table(spark, folder, "eval_items"), table(spark, folder, "documents")
    return leaks.leak_report(leaks.leaked_items(documents, items), items, documents)


def p6_checked(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the pairs of each suite: its number of items, that each pair is given once, of known items and documents with text."""
    items, documents = table(spark, folder, "eval_items").select("item_id", "suite", "passage"), table(spark, folder, "documents").where(F.length("text") > 0)
    pairs = leaks.leaked_items(documents, items.select("item_id", "passage")).groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.join(documents.select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    per_item = pairs.groupBy("item_id").agg(F.every(F.col("n") == 1).alias("once"), F.every(F.coalesce("known", F.lit(False))).alias("known"))
    met = items.select("item_id", "suite").join(per_item, "item_id", "full").groupBy("suite")
    return met.agg(F.count_distinct("item_id").alias("n_items"), F.every(F.coalesce("once", F.lit(True))).alias("once"), F.every(F.coalesce("known", F.lit(True))).alias("known"))


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of all documents, written once as the mixture reads them several times."""
    return checkpoint(tokens.token_sizes(table(spark, folder, "documents")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources whose slots in the mixture can't all be filled; their number of tokens confirms it."""
    return mixture.fallen_short(_sizes(spark, folder), table(spark, folder, "mix_targets")).select("source")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.shares(_sizes(spark, folder), table(spark, folder, "mix_targets"))


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mixture(_sizes(spark, folder), table(spark, folder, "mix_targets"))


def p7_checked(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the mixture of each source."""
    return mixture.checked(_sizes(spark, folder), table(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = reading.fit(documents, table(spark, folder, "reading_labels"))
    return reading.predict(documents, model).select("doc_id", F.col("reading_level").cast("bigint").alias("reading_level"))


def p8_profile(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = reading.fit(documents, table(spark, folder, "reading_labels"))
    return reading.profile(reading.predict(documents, model))


def p8_checked(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the levels: each document once, none without text, levels of the scale, words known or not within the words."""
    documents = table(spark, folder, "documents")
    levels = reading.predict(documents, reading.fit(documents, table(spark, folder, "reading_labels")))
    met = levels.join(documents.select("doc_id", (F.length("text") > 0).alias("spoken")), "doc_id", "left").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.every(F.coalesce("spoken", F.lit(False))).alias("spoken"), F.every(F.col("reading_level").between(1, 4) & F.col("n_known").between(0, F.col("n_words"))).alias("fit"))
    return met.agg(F.every(F.col("n") == 1).alias("once"), F.every("spoken").alias("with_text"), F.every("fit").alias("on_scale"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p1_percentiles, p2_found, p2_runs, p3_found, p3_counts, p5_found, p5_shares, p5_assigned, p6_found, p6_report, p6_checked, p7_found, p7_shares, p7_mixture, p7_checked, p8_found, p8_profile, p8_checked]
    return {f.__name__: f for f in found}


_NAMES = """n AS (SELECT chrom, lower(trim(chrom, ' ' || chr(9))) AS k FROM chroms UNION SELECT chrom, lower(trim(alt_name, ' ' || chr(9))) FROM chroms)"""
_SPLIT = """CASE WHEN lower(trim(split, ' ' || chr(9))) LIKE 'val%' THEN 'validation' WHEN lower(trim(split, ' ' || chr(9))) IN ('train', 'test') THEN lower(trim(split, ' ' || chr(9))) END"""
_RUNS = """WITH u AS (SELECT DISTINCT track_id, chrom, start, "end", value, run_day FROM track_intervals
  WHERE track_id IS NOT NULL AND chrom IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)),
f AS (SELECT *, CASE WHEN start <= lag("end") OVER w + 5 AND abs(CAST(value AS DOUBLE) - CAST(lag(value) OVER w AS DOUBLE)) <= 0.01 THEN 0 ELSE 1 END AS new
  FROM u WINDOW w AS (PARTITION BY track_id, chrom ORDER BY start, "end", value)),
r AS (SELECT *, sum(new) OVER (PARTITION BY track_id, chrom ORDER BY start, "end", value ROWS UNBOUNDED PRECEDING) AS run FROM f),
g AS (SELECT track_id, chrom, run, min(start) AS run_start, max("end") AS run_end, count(*) AS n_rows FROM r GROUP BY ALL)"""
_PANEL = f"""WITH {_NAMES}, i AS (SELECT interval_id AS id, n.chrom, start AS s, "end" AS e, {_SPLIT} AS split, lower(trim(source, ' ' || chr(9))) AS source
  FROM some_intervals JOIN n ON lower(trim(chr, ' ' || chr(9))) = n.k WHERE "end" > start),
t AS (SELECT * FROM i WHERE split = 'train'), h AS (SELECT * FROM i WHERE split <> 'train'),
p AS (SELECT t.id AS t_id, h.id AS h_id FROM t JOIN h ON t.chrom = h.chrom AND t.s < h.e AND h.s < t.e
  WHERE 10 * (least(t.e, h.e) - greatest(t.s, h.s)) >= 9 * greatest(t.e - t.s, h.e - h.s))"""


_SPLITS = f"""WITH c2 AS (SELECT lower(trim(chrom, ' ' || chr(9))) AS a, lower(trim(alt_name, ' ' || chr(9))) AS b FROM chroms),
nm AS (SELECT a AS k, least(a, b) AS component FROM c2 UNION SELECT b, least(a, b) FROM c2),
rw AS (SELECT interval_id, component FROM some_intervals LEFT JOIN nm ON lower(trim(chr, ' ' || chr(9))) = nm.k),
cw AS (SELECT %s AS component, count(*) AS weight FROM rw WHERE %s GROUP BY 1),
co AS (SELECT component, weight, coalesce(sum(weight) OVER (ORDER BY -floor(ln(weight) / ln(1.02)), md5(component) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER () AS total FROM cw),
bd AS (SELECT split_name, sum(target_share) OVER (ORDER BY target_share DESC, split_name) / sum(target_share) OVER () AS hi FROM split_targets WHERE target_share > 0),
gv AS (SELECT component, weight, coalesce((SELECT arg_min(split_name, hi) FROM bd WHERE hi > (before + weight / 2) / total), (SELECT arg_max(split_name, hi) FROM bd)) AS split_name FROM co)"""
_OWN = "coalesce(component, concat('row=', interval_id))"


def _bucketed() -> str:
    """Percentiles per chromosome: the value of the rank, then the middle of its bucket."""
    g = (1 + quantiles.ACCURACY) / (1 - quantiles.ACCURACY)
    at = ", ".join(f"l[CAST(floor({p / 100.0!r} * (n - 1)) AS BIGINT) + 1] AS v{p}" for p in SUMMARY)
    mid = ", ".join(f"round(CASE WHEN v{p} = 0 THEN 0.0 ELSE sign(v{p}) * exp(ceil(ln(abs(v{p})) / {math.log(g)!r}) * {math.log(g)!r}) * {2 / (1 + g)!r} END, 6) AS p{p}" for p in SUMMARY)
    return f"""WITH u AS (SELECT DISTINCT track_id, chrom, start, "end", value, run_day FROM track_intervals WHERE chrom IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)),
s AS (SELECT chrom, count(*) AS n, list_sort(list(CAST(value AS DOUBLE))) AS l FROM u GROUP BY chrom), v AS (SELECT chrom, n, {at} FROM s)
SELECT chrom, n AS n_values, {mid} FROM v"""


def oracle_sql() -> dict[str, str]:
    """p1_found takes exact percentiles; p7_found takes characters for tokens: no case lies near the limits of either.

    The pN_checked queries state what must hold of any result, as SQL can neither clean texts, count tokens nor draw.
    """
    return {
        "p1_found": """WITH u AS (SELECT DISTINCT track_id, chrom, start, "end", value, run_day FROM track_intervals WHERE chrom IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)),
a AS (SELECT chrom, quantile_disc(value, [0.2, 0.5, 0.8]) AS q FROM u GROUP BY chrom),
d AS (SELECT chrom, run_day, count(*) AS n, quantile_disc(value, [0.2, 0.5, 0.8]) AS q FROM u GROUP BY chrom, run_day),
l AS (SELECT d.chrom, run_day, n, unnest([20, 50, 80]) AS pct, unnest(d.q) AS dv, unnest(a.q) AS av FROM d JOIN a ON d.chrom = a.chrom)
SELECT chrom, run_day, pct FROM l WHERE n >= 60 AND (dv >= 2 * av OR dv <= av / 2)""",
        "p1_percentiles": _bucketed(),
        "p2_found": f"{_RUNS} SELECT track_id, chrom, run_start, run_end, n_rows FROM g WHERE n_rows >= 3",
        "p2_runs": f"{_RUNS} SELECT track_id, chrom, run_start, run_end, n_rows, run_end - run_start AS n_bases FROM g",
        "p3_found": f"{_PANEL} SELECT least(t_id, h_id) AS interval_id_a, greatest(t_id, h_id) AS interval_id_b FROM p",
        "p3_counts": f"""{_PANEL}, c AS (SELECT h_id, count(*) AS links FROM p GROUP BY h_id)
SELECT split, source, count(*) AS n_held, count(links) AS n_leaked, CAST(coalesce(sum(links), 0) AS BIGINT) AS n_pairs FROM h LEFT JOIN c ON h.id = c.h_id GROUP BY split, source""",
        "p5_found": f"""WITH {_NAMES}, i AS (SELECT interval_id, n.chrom, {_SPLIT} AS split FROM some_intervals JOIN n ON lower(trim(chr, ' ' || chr(9))) = n.k),
c AS (SELECT chrom, split, count(*) AS n FROM i WHERE split IS NOT NULL GROUP BY ALL), m AS (SELECT chrom, arg_min(split, (-n, split)) AS top FROM c GROUP BY chrom)
SELECT interval_id FROM i JOIN m ON i.chrom = m.chrom WHERE i.split <> m.top""",
        "p5_shares": _SPLITS % ("component", "component IS NOT NULL") + """, g AS (SELECT split_name, count(*) AS n_components, CAST(sum(weight) AS BIGINT) AS n_rows FROM gv GROUP BY split_name)
SELECT t.split_name, target_share, coalesce(n_components, 0) AS n_components, coalesce(n_rows, 0) AS n_rows FROM split_targets t LEFT JOIN g ON t.split_name = g.split_name""",
        "p5_assigned": _SPLITS % (_OWN, "true") + f" SELECT interval_id, split_name FROM rw JOIN gv ON gv.component = {_OWN.replace('component', 'rw.component')}",
        "p6_checked": "SELECT suite, count(DISTINCT item_id) AS n_items, true AS once, true AS known FROM eval_items GROUP BY suite",
        "p8_checked": "SELECT true AS once, true AS with_text, true AS on_scale",
        "p7_checked": "SELECT source, true AS tokens_once, true AS within_repeats, true AS near_target FROM mix_targets",
        "p7_found": """WITH d AS (SELECT lower(trim(source, ' ' || chr(9))) AS k, sum(length(text)) AS n FROM documents GROUP BY 1),
m AS (SELECT t.*, coalesce(d.n, 0) AS n FROM mix_targets t LEFT JOIN d ON d.k = lower(trim(t.source, ' ' || chr(9))))
SELECT source FROM m WHERE n * max_repeats < target_share * (SELECT sum(n) FROM m)""",
    }
