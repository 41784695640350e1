"""Boosted trees, their importances and curves (M5, M7, M8) against trees that SQL grows."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.adapters import r, rounded, table
from contract.registry import check, sql
from tidewire.plans import trees as M

FEATURES = ("l_quantity", "l_discount", "l_tax", "l_extendedprice")
SETTINGS = M.preset("multi", trees=2, rate=0.5, depth=2, row_sample=1.0, column_sample=1.0, l1=3.0)

_LINES = """line_rows as materialized (
  select l_orderkey, l_linenumber as line, case when l_orderkey % 10 < 7 then 'train' when l_orderkey % 10 < 9 then 'val' else 'test' end as split,
    l_extendedprice::double / 1e4 * (1 - l_discount::double) * (1 + l_tax::double) as y, """ + ", ".join(f"{c}::double as {c}" for c in FEATURES) + " from lineitem)"


def _grown() -> list[str]:
    """CTEs that grow the trees greedily: every cut of every feature is tried at every node."""
    places = ", ".join(f"{i} / {M.BINS}.0" for i in range(1, M.BINS))
    cuts = " union all ".join(
        f"select {n} as feature, unnest(list_distinct(quantile_cont({c}, [{places}]))) as cut from line_rows where split = 'train'"
        for n, c in enumerate(FEATURES)
    )
    value = "case feature " + " ".join(f"when {n} then {c}" for n, c in enumerate(FEATURES)) + " end"
    ctes = [
        _LINES,
        f"cuts as materialized ({cuts})",
        "t0 as materialized (select *, (avg(y) filter (split = 'train') over ())::float::double as margin, 0 as node from line_rows)",
    ]
    score = f"pow(greatest(abs({{0}}) - {SETTINGS.l1}, 0), 2) / ({{1}} + {SETTINGS.l2})"
    for t in range(SETTINGS.trees):
        rows = f"t{t}"
        for level in range(SETTINGS.depth):
            name = f"s{t}_{level}"
            ctes.append(f"""{name}_all as (
  select node, feature, cut, sum(margin - y) as g, count(*) as h,
    coalesce(sum(margin - y) filter ({value} <= cut), 0) as gl, count(*) filter ({value} <= cut) as hl
  from {rows}, cuts where split = 'train' group by node, feature, cut)""")
            gain = f"{score.format('gl', 'hl')} + {score.format('g - gl', 'h - hl')} - {score.format('g', 'h')}"
            ctes.append(f"""{name} as materialized (
  select node, feature, cut, h, {gain} as gain from {name}_all
  where hl >= {SETTINGS.min_rows} and h - hl >= {SETTINGS.min_rows} and {gain} > 0
  qualify row_number() over (partition by node order by round({gain}, 9) desc, feature, cut) = 1)""")
            right = f"coalesce(({value} > cut)::int, 0)"
            ctes.append(f"t{t}_{level} as materialized (select l.* replace (2 * l.node + {right} as node) from {rows} l left join {name} s using (node))")
            rows = f"t{t}_{level}"
        leaf = f"-{SETTINGS.rate} * sign(g) * greatest(abs(g) - {SETTINGS.l1}, 0) / (h + {SETTINGS.l2})"
        ctes.append(f"leaf{t} as (select node, {leaf} as step from (select node, sum(margin - y) as g, count(*) as h from {rows} where split = 'train' group by node))")
        ctes.append(f"t{t + 1} as materialized (select l.* replace (margin + coalesce(step, 0) as margin, 0 as node) from {rows} l left join leaf{t} using (node))")
    return ctes


GROWN = _grown()
_LAST = SETTINGS.trees
_FITTED: dict[tuple[str, str], tuple] = {}


def fitted(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        part = F.col("l_orderkey") % 10
        rows = table(spark, sf_dir, "lineitem").select(
            "l_orderkey", F.col("l_linenumber").alias("line"),
            F.when(part < 7, "train").when(part < 9, "val").otherwise("test").alias("split"),
            *[F.col(c).cast("double").alias(c) for c in FEATURES],
        ).withColumn("charge", F.expr("l_extendedprice / 1e4D * (1 - l_discount) * (1 + l_tax)"))
        _FITTED[key] = rows, M.fit_trees(rows, FEATURES, SETTINGS, "charge")
    return _FITTED[key]


@check("m5_first_trees", sql(f"select l_orderkey, line, {r('margin', 'y_hat')} from t{_LAST} where split = 'test'", *GROWN))
def _(spark, sf_dir):
    rows, model = fitted(spark, sf_dir)
    scored = M.predict(model, rows.filter("split = 'test'"), FEATURES, "charge")
    return rounded(scored.select("l_orderkey", "line", "y_hat"))


_SPLITS = " union all ".join(f"select feature, gain, h from s{t}_{level}" for t in range(_LAST) for level in range(SETTINGS.depth))


@check("m7_first_gains", sql(
    f"""select name as feature, {r('coalesce(avg(gain), 0) / sum(coalesce(avg(gain), 0)) over ()', 'importance')}, 'technical' as grp,
        count(gain) as splits, {r('coalesce(sum(gain), 0)', 'total_gain')}, coalesce(sum(h), 0)::double as cover
        from (select unnest({list(FEATURES)}) as name, unnest(range({len(FEATURES)})) as feature) left join ({_SPLITS}) using (feature)
        group by name""", *GROWN))
def _(spark, sf_dir):
    return rounded(M.feature_importance(fitted(spark, sf_dir)[1], FEATURES))


@check("m8_first_rounds", sql(" union all ".join(
    f"""select {t} as iteration, split as part, {r('sqrt(avg(pow(margin - y, 2)))', 'rmse')}, {r('avg(abs(margin - y))', 'mae')}
        from t{t} where split <> 'test' group by split""" for t in range(1, _LAST + 1)), *GROWN))
def _(spark, sf_dir):
    return rounded(M.training_curve(fitted(spark, sf_dir)[1]))
