"""Queries: agreement over many values and over ratings in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.operators import alpha, kappa, long_form
from accordant.plans.alpha_queries import RUN, TRAIN_SQL
from accordant.plans.registry import query
from accordant.plans.tables import RATERS, RATINGS, facts, table

# --- prices as ratings: nearly as many values as rows ------------------------------------

_SPREAD = {"rater_a": (7919, 11, 1001, 500, 8), "rater_b": (104729, 37, 2003, 900, 6), "rater_c": (15485863, 5, 4001, 2100, 4), "model_pred": (31, 17, 1503, 700, 0)}


def _price(factor: int, offset: int, modulus: int, shift: int, gap: int) -> str:
    spot = f"(item_id * {factor} + {offset})"
    return f"CASE WHEN {spot} % 97 < {gap} THEN NULL ELSE y + {spot} % {modulus} - {shift} END"


PRICES_SQL = f"""
pb AS (SELECT o_orderkey AS item_id, o_orderstatus AS status, CAST(floor(o_totalprice) AS BIGINT) + 5000 AS y FROM orders),
pr AS (SELECT item_id, status, {', '.join(f'{_price(*s)} AS {name}' for name, s in _SPREAD.items())} FROM pb)"""


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as items whose price three raters and a model estimate; one status holds half of them."""
    base = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("status"), (F.floor("o_totalprice") + 5000).alias("y")
    )
    return base.select("item_id", "status", *[F.expr(_price(*s)).alias(name) for name, s in _SPREAD.items()])


def _long_sql(source: str, columns: list[str], keys: str, extra: str = "", value: str = "{c}") -> str:
    return " UNION ALL ".join(f"SELECT {keys}, item_id, '{c}' AS rater, {value.format(c=c)} AS v{extra} FROM {source} WHERE {c} IS NOT NULL" for c in columns)


def _alpha_sql(long: str, keys: str, level: str) -> str:
    """CTEs ending in ``al(keys, n_items, n_values, alpha)`` from ``long(keys, item_id, rater, v)``.

    Sums of whole numbers are exact here, whatever their order.
    """
    score = {"interval": "2 * v", "ordinal": "2 * sum(k) OVER (PARTITION BY {keys} ORDER BY v) - k", "ratio": "0", "nominal": "0"}[level].format(keys=keys)
    if level in ("interval", "ordinal"):
        observed = "sum(CAST((m * ss - s1 * s1) AS DOUBLE) / (m - 1)) / 2"
        expected = "CAST(sum(k) * sum(CAST(k * s AS HUGEINT) * s) - sum(CAST(k * s AS HUGEINT)) * sum(CAST(k * s AS HUGEINT)) AS DOUBLE) / 2"
        tail = f"""
ob AS (SELECT {keys}, {observed} AS o FROM (SELECT {keys}, item_id, max(m) AS m, sum(CAST(s AS HUGEINT)) AS s1, sum(CAST(s AS HUGEINT) * s) AS ss FROM sh JOIN sc USING ({keys}, v) GROUP BY ALL) GROUP BY ALL),
ex AS (SELECT {keys}, {expected} AS e FROM sc GROUP BY ALL)"""
    else:
        distance = "CASE WHEN x.v = y.v THEN 0.0 ELSE 1.0 END" if level == "nominal" else "CASE WHEN x.v = y.v THEN 0.0 ELSE pow(CAST(x.v - y.v AS DOUBLE) / (x.v + y.v), 2) END"
        tail = f"""
ob AS (SELECT {keys}, sum({distance} / (x.m - 1)) AS o FROM sh x JOIN sh y USING ({keys}, item_id) GROUP BY {keys}),
ex AS (SELECT {keys}, sum(CAST(x.k * y.k AS DOUBLE) * {distance}) AS e FROM sc x JOIN sc y USING ({keys}) GROUP BY {keys})"""
    return f"""
sz AS (SELECT *, count(*) OVER (PARTITION BY {keys}, item_id) AS m FROM {long}),
sh AS (SELECT * FROM sz WHERE m > 1),
mg AS (SELECT {keys}, v, count(*) AS k FROM sh GROUP BY ALL),
sc AS (SELECT {keys}, v, k, {score} AS s FROM mg),{tail},
tt AS (SELECT {keys}, CAST(sum(k) AS BIGINT) AS t, count(*) AS n_values FROM sc GROUP BY ALL),
ni AS (SELECT {keys}, count(DISTINCT item_id) AS n_items FROM {long} GROUP BY ALL),
al AS (SELECT {keys}, n_items, n_values, 1 - (t - 1) * o / nullif(e, 0) AS alpha FROM ni JOIN tt USING ({keys}) JOIN ob USING ({keys}) JOIN ex USING ({keys}))"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.round(f.name, 9) for f in df.schema.fields if f.dataType.typeName() == "double"})


def _wide_query(level: str):
    # The ratio level compares all pairs of values; its prices are in hundreds.
    value = "{c} // 100" if level == "ratio" else "{c}"
    sql = f"""WITH {PRICES_SQL}, lg AS ({_long_sql('pr', RATERS, 'status', value=value)}), {_alpha_sql('lg', 'status', level)}
    SELECT status, n_items, n_values, round(alpha, 9) AS alpha FROM al"""

    def run(spark, sf):
        rows = long_form.to_long(prices(spark, sf), RATERS, ["status"], "item_id")
        if level == "ratio":
            rows = rows.withColumn("value", F.floor(F.col("value") / 100))
        return _rounded(long_form.alpha_long(rows, level, ["status"]))

    return sql, run


for _level in ("interval", "ordinal", "ratio"):
    _text, _fn = _wide_query(_level)
    query(f"alpha_{_level}_wide", _text)(_fn)


_PANEL_SEATS = alpha.human_and_model_panels(RATINGS)
_PANELS_SQL = " UNION ALL ".join(f"SELECT '{p}' AS panel, status, item_id, v FROM lg WHERE rater IN ({', '.join(repr(c) for c in cols)})" for p, cols in _PANEL_SEATS.items())


@query(
    "alpha_panels_wide",
    f"""WITH {PRICES_SQL}, lg AS ({_long_sql('pr', RATINGS.columns, 'status')}), pl AS ({_PANELS_SQL}), {_alpha_sql('pl', 'status, panel', 'interval')}
    SELECT status, round(max(alpha) FILTER (WHERE panel = 'human'), 9) AS alpha_human, round(avg(alpha) FILTER (WHERE panel <> 'human'), 9) AS alpha_model,
    round(avg(alpha) FILTER (WHERE panel <> 'human') - max(alpha) FILTER (WHERE panel = 'human'), 9) AS difference FROM al GROUP BY status""",
)
def alpha_panels_wide(spark, sf):
    rows = long_form.to_long(prices(spark, sf), RATINGS.columns, ["status"], "item_id")
    table_ = long_form.panel_alphas_long(rows, _PANEL_SEATS, "interval", ["status"])
    return _rounded(alpha.compare_panels(table_, ["status"]))


# --- kappa without a label list -----------------------------------------------------------

_BANDS = "CAST(floor({c} / 10000) AS BIGINT)"
_WEIGHTS = {"unweighted": (None, "CASE WHEN i = j THEN 0 ELSE 1 END"), "linear": ("linear", "abs(i - j)"), "quadratic": ("quadratic", "(i - j) * (i - j)")}


def _kappa_sql(keys: str, source: str, weight: str, out: str) -> str:
    """CTEs ending in ``out(keys, n_rows, n_equal, kappa)`` from ``source(keys, a, b)``: all pairs of labels."""
    return f"""
{out}c AS (SELECT {keys}, a, b, count(*) AS n FROM {source} GROUP BY ALL),
{out}d AS (SELECT {keys}, v, row_number() OVER (PARTITION BY {keys} ORDER BY v) AS p FROM (SELECT {keys}, a AS v FROM {out}c UNION SELECT {keys}, b FROM {out}c)),
{out}p AS (SELECT c.*, x.p AS i, y.p AS j FROM {out}c c JOIN {out}d x ON {_same(keys, 'c', 'x')} AND c.a = x.v JOIN {out}d y ON {_same(keys, 'c', 'y')} AND c.b = y.v),
{out}o AS (SELECT {keys}, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN i = j THEN n ELSE 0 END) AS BIGINT) AS n_equal, sum(n * ({weight})) AS o FROM {out}p GROUP BY ALL),
{out}r AS (SELECT {keys}, i, sum(n) AS r FROM {out}p GROUP BY ALL),
{out}s AS (SELECT {keys}, j, sum(n) AS c FROM {out}p GROUP BY ALL),
{out}e AS (SELECT {keys}, sum(CAST(r AS DOUBLE) * CAST(c AS DOUBLE) * ({weight})) AS e FROM {out}r JOIN {out}s USING ({keys}) GROUP BY ALL),
{out} AS (SELECT {keys}, n_rows, n_equal, 1 - CAST(o AS DOUBLE) * CAST(n_rows AS DOUBLE) / nullif(e, 0) AS kappa FROM {out}o JOIN {out}e USING ({keys}))"""


def _same(keys: str, left: str, right: str) -> str:
    return " AND ".join(f"{left}.{k.strip()} = {right}.{k.strip()}" for k in keys.split(","))


@query(
    "kappa_open_domain",
    f"""WITH {PRICES_SQL}, kb AS (SELECT status, {_BANDS.format(c='rater_a')} AS a, {_BANDS.format(c='rater_b')} AS b FROM pr WHERE rater_a IS NOT NULL AND rater_b IS NOT NULL),
    {', '.join(_kappa_sql('status', 'kb', sql, f'k_{name}') for name, (_, sql) in _WEIGHTS.items())}
    {' UNION ALL '.join(f"SELECT status, '{name}' AS weights, n_rows, n_equal, round(kappa, 9) AS kappa FROM k_{name}" for name in _WEIGHTS)}""",
)
def kappa_open_domain(spark, sf):
    """Price bands of two raters; which bands occur is not known beforehand."""
    bands = prices(spark, sf).where("rater_a is not null and rater_b is not null")
    counts = bands.select("status", F.floor(F.col("rater_a") / 10000).alias("a"), F.floor(F.col("rater_b") / 10000).alias("b"))
    counts = counts.groupBy("status", "a", "b").agg(F.count("*").alias("n"))
    parts = [kappa.open_kappas(counts, ["status"], w).withColumn("weights", F.lit(name)) for name, (w, _) in _WEIGHTS.items()]
    return _rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


# --- many raters ----------------------------------------------------------------------------

# Every item is rated by some of 40 people; the first 50 items by all of them.
CROWD = 40
_VOICE = "(item_id * 7919 + r * 104729 + 11) % 101"
_SAID = f"CASE WHEN {_VOICE} < 70 THEN y WHEN {_VOICE} < 90 THEN (y + 1) % 5 ELSE (y + 3) % 5 END"
_ASKED = f"(item_id <= 50 OR (item_id * 31 + r * 17) % {CROWD} < 4)"

CROWD_SQL = f"""
cb AS (SELECT o_orderkey AS item_id, o_orderstatus AS status, CAST(floor(o_totalprice) AS BIGINT) % 5 AS y FROM orders),
cr AS (SELECT status, item_id, concat('r', r) AS rater, {_SAID} AS v FROM cb CROSS JOIN (SELECT unnest(generate_series(1, {CROWD})) AS r) WHERE {_ASKED}),
cg AS (SELECT status, item_id, CASE WHEN item_id % 13 <> 0 THEN CASE WHEN item_id % 7 < 5 THEN y ELSE (y + 1) % 5 END END AS v FROM cb)"""


def _crowd_base(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("status"), (F.floor("o_totalprice") % 5).alias("y"))


def crowd(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings of 40 people in long form; some items have all of them."""
    asked = _crowd_base(spark, sf).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(CROWD)))).where(_ASKED)
    return asked.select("status", F.col("item_id").alias("item"), F.concat(F.lit("r"), F.col("r").cast("string")).alias("rater"), F.expr(_SAID).alias("value"))


def guesses(spark: SparkSession, sf: str) -> DataFrame:
    """A model's label per item, missing for some."""
    guess = F.expr("CASE WHEN item_id % 13 <> 0 THEN CASE WHEN item_id % 7 < 5 THEN y ELSE (y + 1) % 5 END END")
    return _crowd_base(spark, sf).select("status", F.col("item_id").alias("item"), guess.alias("value"))


@query(
    "alpha_long",
    f"WITH {CROWD_SQL}, {_alpha_sql('cr', 'status', 'nominal')} SELECT status, n_items, n_values, round(alpha, 9) AS alpha FROM al",
)
def alpha_long(spark, sf):
    return _rounded(long_form.alpha_long(crowd(spark, sf), "nominal", ["status"]))


@query(
    "kappa_long",
    f"""WITH {CROWD_SQL}, cp AS (SELECT status, x.rater AS rater_1, y.rater AS rater_2, x.v AS a, y.v AS b FROM cr x JOIN cr y USING (status, item_id) WHERE x.rater < y.rater),
    {_kappa_sql('status, rater_1, rater_2', 'cp', _WEIGHTS['quadratic'][1], 'k')} SELECT status, rater_1, rater_2, n_rows, n_equal, round(kappa, 9) AS kappa FROM k""",
)
def kappa_long(spark, sf):
    return _rounded(long_form.kappa_long(crowd(spark, sf), ["status"], "quadratic"))


@query(
    "alt_long",
    f"""WITH {CROWD_SQL}, am AS (SELECT *, count(*) OVER (PARTITION BY status, item_id) AS m, count(*) OVER (PARTITION BY status, item_id, v) AS k FROM cr),
    aw AS (SELECT am.*, (SELECT count(*) FROM cr x WHERE x.status = am.status AND x.item_id = am.item_id AND x.rater <> am.rater AND x.v = cg.v) AS f, k - 1 AS h
      FROM am JOIN cg USING (status, item_id) WHERE m >= 3)
    SELECT status, rater, count(*) AS n, CAST(sum(CASE WHEN f >= h THEN 1 ELSE 0 END) AS BIGINT) AS wins_f, CAST(sum(CASE WHEN h >= f THEN 1 ELSE 0 END) AS BIGINT) AS wins_h,
    CAST(sum(CASE WHEN f > h THEN -1 WHEN h > f THEN 1 ELSE 0 END) AS BIGINT) AS sum_d, CAST(sum(CASE WHEN f <> h THEN 1 ELSE 0 END) AS BIGINT) AS sum_d2 FROM aw GROUP BY ALL""",
)
def alt_long(spark, sf):
    return long_form.wins_long(crowd(spark, sf), guesses(spark, sf), ["status"]).drop("skipped")


# --- the wide forms give the same -------------------------------------------------------------

_R = ", ".join(RUN)


@query(
    "alpha_long_runs",
    f"""WITH {TRAIN_SQL}, lg AS ({_long_sql('tr', RATERS, _R)}), {_alpha_sql('lg', _R, 'ordinal')} SELECT {_R}, n_items, n_values, round(alpha, 9) AS alpha FROM al""",
)
def alpha_long_runs(spark, sf):
    rows = facts(spark, sf).where("split = 'train'")
    return _rounded(long_form.alpha_long(long_form.to_long(rows, RATERS, RUN, "item_id"), "ordinal", RUN))
