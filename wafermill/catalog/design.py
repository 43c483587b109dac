"""Queries over design-space tables."""

from pyspark.sql import functions as F

from wafermill.catalog import query
from wafermill.catalog.adapters import VIEWS, run_sql, view, with_views
from wafermill.operators import coverage, design

GRIDS = """
SELECT p_partkey AS plan, CAST(p_size % 4 + 1 AS INTEGER) AS n0, CAST(p_partkey % 5 + 1 AS INTEGER) AS n1, CAST(p_partkey % 3 + 1 AS INTEGER) AS n2, p_size AS base FROM {part}
"""


@query(
    "grid_sweep",
    with_views(g=GRIDS) + """
SELECT plan, (i0 * n1 + i1) * n2 + i2 AS "index", CAST(base + i0 AS DOUBLE) AS width, CAST(i1 AS DOUBLE) AS length, CAST(i2 + CAST(0.5 AS DOUBLE) AS DOUBLE) AS ratio
FROM g, LATERAL (SELECT unnest(range(n0)) AS i0), LATERAL (SELECT unnest(range(n1)) AS i1), LATERAL (SELECT unnest(range(n2)) AS i2)""",
)
def _(spark, sf):
    rows = run_sql(spark, sf, GRIDS).select(
        "plan",
        F.transform(F.sequence(F.lit(0), F.col("n0") - 1), lambda i: (F.col("base") + i).cast("double")).alias("width"),
        F.transform(F.sequence(F.lit(0), F.col("n1") - 1), lambda i: i.cast("double")).alias("length"),
        F.transform(F.sequence(F.lit(0), F.col("n2") - 1), lambda i: i + 0.5).alias("ratio"),
    )
    return design.grid_sweep(rows, ["plan"], ["width", "length", "ratio"])


SPECS = """
SELECT concat('f', p_partkey % 500) AS family, concat('a', p_partkey) AS axis, p_size / CAST(4 AS DOUBLE) AS min, p_size / CAST(4 AS DOUBLE) + p_size % 7 AS max,
       CASE WHEN p_partkey % 2 = 0 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END AS step, CAST(p_partkey % 2 + 1 AS INTEGER) AS count FROM {part}
"""


@query(
    "inventory_levels",
    with_views(s=SPECS) + """
, n AS (SELECT *, CASE WHEN step = 0.25 THEN round((max - min) * 4) ELSE round((max - min) * 5) END + 1 AS k FROM s)
SELECT family, axis, count, CAST(k AS INTEGER) AS n_levels, round(min + i * step, 6) AS level FROM n, LATERAL (SELECT unnest(range(CAST(k AS BIGINT))) AS i)""",
)
def _(spark, sf):
    got = design.inventory_levels(run_sql(spark, sf, SPECS))
    return got.select("family", "axis", "count", "n_levels", F.explode("levels").alias("level")).withColumn("level", F.round("level", 6))


@query(
    "grid_size",
    with_views(s=SPECS) + """
, n AS (SELECT *, CASE WHEN step = 0.25 THEN round((max - min) * 4) ELSE round((max - min) * 5) END + 1 AS k FROM s)
SELECT family, round(product(CAST(k AS DOUBLE) ** count)) AS grid_size FROM n GROUP BY family""",
)
def _(spark, sf):
    return design.grid_size(design.inventory_levels(run_sql(spark, sf, SPECS))).select("family", F.round("grid_size").alias("grid_size"))


BUDGETS = """
SELECT c_custkey AS plan, k AS idx, CAST(floor(abs(c_acctbal)) AS BIGINT) AS total, CAST((c_custkey * (k + 3)) % 6 + 1 AS INTEGER) AS dims
FROM {customer} {each k 5}
"""
SPLIT = """
r AS (SELECT *, {total} * (dims / CAST(sum(dims) OVER (PARTITION BY plan{more}) AS DOUBLE)) AS raw FROM {src}),
fl AS (SELECT *, CAST(floor(raw) AS BIGINT) AS low, raw - floor(raw) AS frac FROM r),
rk AS (SELECT *, {total} - sum(low) OVER (PARTITION BY plan{more}) AS rest, row_number() OVER (PARTITION BY plan{more} ORDER BY frac DESC, idx DESC) AS rn FROM fl),
split AS (SELECT *, low + CASE WHEN rn <= rest THEN 1 ELSE 0 END AS budget FROM rk)
"""


@query(
    "allocate_budget",
    with_views(b=BUDGETS)[:-1] + "," + SPLIT.format(total="total", more="", src="b") + "SELECT plan, idx, budget FROM split",
)
def _(spark, sf):
    got = design.allocate_budget(run_sql(spark, sf, BUDGETS), ["plan"], "total", "dims", "idx")
    return got.select("plan", "idx", "budget")


SEARCH = """
SELECT s_suppkey AS plan, k AS idx, CAST(floor(abs(s_acctbal)) AS BIGINT) AS start, CAST(k + 1 AS INTEGER) AS dims, CAST(s_suppkey % 3 + 2 AS INTEGER) AS s1, CAST(s_suppkey % 2 * 3 + 2 AS INTEGER) AS s2
FROM {supplier} {each k 2}
"""


@query(
    "find_valid_budget",
    with_views(b=SEARCH)[:-1] + ", t AS (SELECT b.*, start + i AS n_total FROM b CROSS JOIN range(2000) g(i)),"
    + SPLIT.format(total="n_total", more=", n_total", src="t")
    + ", ok AS (SELECT plan, n_total FROM split GROUP BY plan, n_total HAVING bool_and(budget % s1 = 0 AND (idx > 0 OR budget % s2 = 0))) SELECT plan, min(n_total) AS n_total FROM ok GROUP BY plan",
)
def _(spark, sf):
    rows = run_sql(spark, sf, SEARCH).withColumn(
        "levels", F.when(F.col("idx") == 0, F.array("s1", "s2")).otherwise(F.array("s1"))
    )
    return design.find_valid_budget(rows, "plan", "start", "dims", "idx", "levels")


RUNTIMES = """
SELECT o_custkey AS plan, o_orderkey AS family, CAST(o_orderkey % 14 + 1 AS INTEGER) AS dims, o_totalprice / 10000 + 1 AS seconds FROM {orders}
"""


@query(
    "runtime_budget",
    with_views(r=RUNTIMES) + """
SELECT plan, family, round(CAST(26 * 8 * 3600 AS DOUBLE) / (CAST(1.2 AS DOUBLE) * sum(dims) OVER (PARTITION BY plan)) * dims / seconds, 6) AS n_samples FROM r""",
)
def _(spark, sf):
    got = design.runtime_budget(run_sql(spark, sf, RUNTIMES), ["plan"], 26, 8, 1.2)
    return got.select("plan", "family", F.round("n_samples", 6).alias("n_samples"))


PLANS = """
SELECT concat('p', s_suppkey) AS pcell, concat('x', k) AS axis, CAST(s_suppkey * 7 % 40 + 3 AS INTEGER) AS n FROM {supplier} {each k 2}
"""
UNIT = "CAST('0x' || substr(md5({x}), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE)"
LHS = """
, i AS (SELECT p.*, i AS sample_id FROM p, LATERAL (SELECT unnest(range(n)) AS i)),
k AS (SELECT *, row_number() OVER (PARTITION BY pcell, axis ORDER BY md5(concat_ws(':', '{seed}', pcell, axis, sample_id)), sample_id) AS perm FROM i),
lhs AS (SELECT pcell, axis, n, sample_id, (perm - 1 + """ + UNIT.format(x="concat_ws(':', '{seed}u', pcell, axis, sample_id)") + """) / n AS u FROM k)
"""


@query("latin_hypercube", with_views(p=PLANS)[:-1] + LHS.format(seed="42") + "SELECT pcell, axis, sample_id, round(u, 9) AS u FROM lhs")
def _(spark, sf):
    got = design.latin_hypercube(run_sql(spark, sf, PLANS), ["pcell"], "axis", "n", "42")
    return got.select("pcell", "axis", "sample_id", F.round("u", 9).alias("u"))


CANDIDATES = """
SELECT concat('p', s_suppkey) AS pcell, CAST(c AS INTEGER) AS candidate, concat('x', k) AS axis, CAST(s_suppkey * 3 % 15 + 4 AS INTEGER) AS n
FROM {supplier} {each k 2} {each c 4}
"""
CAND_LHS = """
, i AS (SELECT p.*, i AS sample_id FROM p, LATERAL (SELECT unnest(range(n)) AS i)),
k AS (SELECT *, row_number() OVER (PARTITION BY pcell, candidate, axis ORDER BY md5(concat_ws(':', '7', pcell, candidate, axis, sample_id)), sample_id) AS perm FROM i),
lhs AS (SELECT pcell, candidate, axis, sample_id, (perm - 1 + """ + UNIT.format(x="concat_ws(':', '7u', pcell, candidate, axis, sample_id)") + """) / n AS u FROM k),
w AS (SELECT pcell, candidate, sample_id, max(u) FILTER (axis = 'x0') AS x0, max(u) FILTER (axis = 'x1') AS x1 FROM lhs GROUP BY ALL),
d AS (SELECT a.pcell, a.candidate, min(sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2)) AS m FROM w a JOIN w b ON a.pcell = b.pcell AND a.candidate = b.candidate AND a.sample_id < b.sample_id GROUP BY ALL)
"""


@query(
    "maximin_select",
    with_views(p=CANDIDATES)[:-1] + CAND_LHS + "SELECT w.pcell, w.candidate, sample_id, round(x0, 9) AS x0, round(x1, 9) AS x1 FROM w JOIN (SELECT pcell, arg_max(candidate, (m, -candidate)) AS best FROM d GROUP BY pcell) b ON b.pcell = w.pcell AND b.best = w.candidate",
)
def _(spark, sf):
    from wafermill.session import cut_lineage

    got = design.latin_hypercube(run_sql(spark, sf, CANDIDATES), ["pcell", "candidate"], "axis", "n", "7")
    wide = cut_lineage(got.groupBy("pcell", "candidate", "sample_id").agg(
        *[F.max(F.when(F.col("axis") == a, F.col("u"))).alias(a) for a in ("x0", "x1")]
    ))
    near = coverage.min_pairwise_distance(wide, ["pcell", "candidate"], "sample_id", ["x0", "x1"])
    best = design.maximin_select(wide, "pcell", "candidate", near)
    return best.select("pcell", "candidate", "sample_id", F.round("x0", 9).alias("x0"), F.round("x1", 9).alias("x1"))


INT_PLANS = """
SELECT concat('p', s_suppkey) AS pcell, concat('x', k) AS axis, CAST(s_suppkey * 7 % 40 + 3 AS INTEGER) AS n, CAST(1 AS INTEGER) AS min, CAST(s_suppkey % 5 + k + 1 AS INTEGER) AS max
FROM {supplier} {each k 2}
"""
LEVELS = """
, i AS (SELECT p.*, i AS sample_id, md5(concat_ws(':', '{seed}', pcell, axis, i)) AS t FROM p, LATERAL (SELECT unnest(range(n)) AS i)),
k AS (SELECT *, row_number() OVER (PARTITION BY pcell, axis ORDER BY t, sample_id) - 1 AS perm FROM i)
"""


@query(
    "balanced_int_levels",
    with_views(p=INT_PLANS)[:-1] + LEVELS.format(seed="5") + """
SELECT pcell, axis, sample_id, CAST(min + CASE WHEN n % (max - min + 1) = 0 THEN perm % (max - min + 1) ELSE CAST('0x' || substr(t, 1, 13) AS BIGINT) % (max - min + 1) END AS INTEGER) AS level FROM k""",
)
def _(spark, sf):
    got = design.balanced_int_levels(run_sql(spark, sf, INT_PLANS), ["pcell"], "axis", "n", "5")
    return got.select("pcell", "axis", "sample_id", "level")


@query(
    "balanced_cat_levels",
    with_views(p=INT_PLANS)[:-1] + LEVELS.format(seed="6") + """
SELECT pcell, axis, sample_id, ['nmos', 'pmos', 'both'][1 + CAST(CASE WHEN n % 3 = 0 THEN perm % 3 ELSE CAST('0x' || substr(t, 1, 13) AS BIGINT) % 3 END AS INTEGER)] AS level FROM k""",
)
def _(spark, sf):
    plans = run_sql(spark, sf, INT_PLANS).withColumn("levels", F.array(F.lit("nmos"), F.lit("pmos"), F.lit("both")))
    return design.balanced_cat_levels(plans, ["pcell"], "axis", "n", "6").select("pcell", "axis", "sample_id", "level")


@query(
    "scale_to_spec",
    with_views(p=INT_PLANS)[:-1] + LHS.format(seed="9") + "SELECT l.pcell, l.axis, sample_id, round(u * (p.max - p.min) + p.min, 9) AS value FROM lhs l JOIN p ON p.pcell = l.pcell AND p.axis = l.axis",
)
def _(spark, sf):
    plans = run_sql(spark, sf, INT_PLANS)
    points = design.latin_hypercube(plans.select("pcell", "axis", "n"), ["pcell"], "axis", "n", "9")
    got = design.scale_to_spec(points, plans, ["pcell", "axis"])
    return got.select("pcell", "axis", "sample_id", F.round("value", 9).alias("value"))


AXES = [("width", 0), ("width", 1), ("length", 0), ("length", 1)]
AXES += [(a, 0) for a in ("fingers", "multipliers", "numcols", "mim_cap_rows", "rmult", "with_antenna_diode_on_diffinputs")]
AXES += [s for spots in design.COMPOSITES.values() for s in spots]
AXES = list(dict.fromkeys(AXES))


def _value(axis, pos):
    k = AXES.index((axis, pos))
    return f"((sample_id * {7 * k + 3}) % 13)"


def _array(*spots):
    return "[" + ", ".join(f"CAST({_value(*s)} AS DOUBLE)" for s in spots) + "]"


@query(
    "assemble_samples",
    with_views("results") + f"""
SELECT pcell, sample_id,
  CASE WHEN pcell IN ('fvf', 'txgate', 'lvcm') THEN {_array(('width', 0), ('width', 1))} WHEN pcell <> 'opamp' THEN {_array(('width', 0))} END AS width,
  CASE WHEN pcell IN ('fvf', 'txgate') THEN {_array(('length', 0), ('length', 1))} WHEN pcell <> 'opamp' THEN {_array(('length', 0))} END AS length,
  CASE WHEN pcell IN ('fvf', 'txgate', 'lvcm') THEN concat({_value('fingers', 0)}, ',', {_value('fingers', 0)}) WHEN pcell = 'diff_pair' THEN CAST({_value('fingers', 0)} AS VARCHAR) END AS fingers,
  CASE WHEN pcell IN ('fvf', 'txgate', 'lvcm') THEN concat({_value('multipliers', 0)}, ',', {_value('multipliers', 0)}) END AS multipliers,
  CASE WHEN pcell = 'current_mirror' THEN CAST({_value('numcols', 0)} AS INTEGER) END AS numcols,
  CASE WHEN pcell = 'diff_pair' THEN sample_id % 4 = 3 END AS n_or_p_fet,
  CASE WHEN pcell = 'opamp' THEN false END AS add_output_stage,
""" + ",\n".join(
        f"CASE WHEN pcell = 'opamp' THEN {_array(*spots)} END AS {out}" for out, spots in design.COMPOSITES.items()
    ) + f""",
  CASE WHEN pcell = 'opamp' THEN CAST({_value('mim_cap_rows', 0)} AS INTEGER) END AS mim_cap_rows,
  CASE WHEN pcell = 'opamp' THEN CAST({_value('rmult', 0)} AS INTEGER) END AS rmult,
  CASE WHEN pcell = 'opamp' THEN CASE WHEN {_value('with_antenna_diode_on_diffinputs', 0)} = 1 THEN 0 ELSE CAST({_value('with_antenna_diode_on_diffinputs', 0)} AS INTEGER) END END AS with_antenna_diode_on_diffinputs
FROM results""",
)
def _(spark, sf):
    rows = view(spark, sf, "results").select("pcell", "sample_id")
    spots = F.array(*[
        F.struct(F.lit(a).alias("axis"), F.lit(p).alias("pos"),
                 ((F.col("sample_id") * (7 * k + 3)) % 13).cast("double").alias("value"), F.lit(None).cast("string").alias("text"))
        for k, (a, p) in enumerate(AXES)
    ], *[
        F.struct(F.lit(a).alias("axis"), F.lit(0).alias("pos"), F.lit(None).cast("double").alias("value"), t.alias("text"))
        for a, t in (("type", F.when(F.col("sample_id") % 4 == 3, "nmos").otherwise("pmos")), ("add_output_stage", F.lit("false")))
    ])
    long = rows.select("pcell", "sample_id", F.explode(spots).alias("s")).select("pcell", "sample_id", "s.*")
    got = design.assemble_samples(long)
    return got.withColumn("fingers", F.array_join("fingers", ",")).withColumn("multipliers", F.array_join("multipliers", ","))


# The 18 values of a sweep row in the order of the vector, as SQL over orders.
_FIRST, _HALF, _LAST = "CAST(o_orderkey % 10 + 1 AS DOUBLE)", "CAST(o_orderkey % 10 + 1 AS DOUBLE) / 2", "CAST(o_custkey AS DOUBLE)"
SWEEP_SQL = [
    *[_FIRST, _HALF] * 4, "CAST(o_orderkey % 3 AS DOUBLE)", _FIRST, _HALF, _FIRST, _FIRST, _FIRST, _LAST, _FIRST, _FIRST, _LAST,
]


@query("params_to_vector", f"SELECT o_orderkey, [{', '.join(SWEEP_SQL)}] AS params FROM orders")
def _(spark, sf):
    return design.params_to_vector(_sweep_rows(spark, sf)).select("o_orderkey", "params")


def _sweep_rows(spark, sf):
    rows = run_sql(spark, sf, "SELECT o_orderkey, o_custkey FROM {orders}")
    first, last = (F.col("o_orderkey") % 10 + 1).cast("double"), F.col("o_custkey").cast("double")
    pair = F.array(first, first / 2)
    return rows.select(
        "o_orderkey", pair.alias("input_pair_params"), pair.alias("fvf_shunt_params"), pair.alias("local_current_bias_params"),
        pair.alias("diff_pair_load_params"), (F.col("o_orderkey") % 3).alias("ratio"), pair.alias("current_mirror_params"),
        F.array(first, first, first, last).alias("resistor_params"), F.array(first, first, last).alias("global_current_bias_params"),
    )


_MISSING = "CAST(-987.654321 AS DOUBLE)"
_BACK = [f"CASE WHEN o_orderkey % 10 = 0 THEN {_MISSING} ELSE {v} END" for v in SWEEP_SQL]


@query(
    "vector_to_params",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN -987 ELSE CAST(o_orderkey % 3 AS INTEGER) END AS ratio, "
    + ", ".join(f"[{', '.join(_BACK[i:j])}] AS {n}" for n, i, j in [
        ("input_pair_params", 0, 2), ("fvf_shunt_params", 2, 4), ("local_current_bias_params", 4, 6), ("diff_pair_load_params", 6, 8),
        ("current_mirror_params", 9, 11), ("resistor_params", 11, 15), ("global_current_bias_params", 15, 18),
    ])
    + ", " + ", ".join(f'{"CAST(o_orderkey % 7 AS DOUBLE)" if n == "ugb" else _MISSING} AS "{n}"' for n in design.RESULT_NAMES)
    + " FROM orders",
)
def _(spark, sf):
    vectors = design.params_to_vector(_sweep_rows(spark, sf))
    vectors = vectors.withColumn("params", F.when(F.col("o_orderkey") % 10 != 0, F.col("params")))
    named = vectors.select("*", *[
        (F.col("o_orderkey") % 7 if n == "ugb" else F.lit(None)).cast("double").alias(n) for n in design.RESULT_NAMES
    ])
    return design.vector_to_results(design.results_to_vector(design.vector_to_params(named, "params")), "results")


VIEWS["samples"] = """
SELECT o_orderkey AS sample_id, o_orderkey % 6 AS family, CAST(o_custkey % 40 AS DOUBLE) / 2 AS w0, CAST(o_custkey % 37 AS DOUBLE) / 4 AS w1,
       CAST(o_orderkey % 41 AS DOUBLE) / 8 AS l0, CAST(o_orderkey % 43 AS DOUBLE) / 8 AS l1, o_orderkey % 5 AS f0, o_custkey % 5 AS f1, o_orderkey % 2 AS m0
FROM {orders}
"""


def _samples(spark, sf):
    return view(spark, sf, "samples").select(
        "sample_id", "family", F.array("w0", "w1").alias("width"), F.array("l0", "l1").alias("length"),
        F.array("f0", "f1").alias("fingers"), F.array("m0", "m0").alias("multipliers"),
    )


@query(
    "param_summary",
    with_views("samples") + """
SELECT family, min(w0) AS min_width_0, max(w0) AS max_width_0, min(w1) AS min_width_1, max(w1) AS max_width_1, min(l0) AS min_length_0, max(l0) AS max_length_0,
       min(l1) AS min_length_1, max(l1) AS max_length_1, count(DISTINCT (f0, f1)) AS finger_combinations, count(DISTINCT (m0, m0)) AS multiplier_combinations FROM samples GROUP BY family""",
)
def _(spark, sf):
    return design.param_summary(_samples(spark, sf), ["family"])


@query("param_examples", with_views("samples") + "SELECT sample_id, [w0, w1] AS width, [l0, l1] AS length FROM samples ORDER BY sample_id LIMIT 3")
def _(spark, sf):
    return design.param_examples(_samples(spark, sf), "sample_id").select("sample_id", "width", "length")


MEASURED = """
SELECT o_orderkey AS sample_id, CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_custkey % 90 AS DOUBLE) END AS phaseMargin, CAST(o_orderkey AS DOUBLE) AS ugb, o_totalprice AS area FROM {orders}
"""


@query(
    "failed_phase_filter",
    with_views(m=MEASURED) + """
SELECT sample_id, CASE WHEN phaseMargin >= 60 THEN ugb END AS ugb, CASE WHEN phaseMargin >= 60 THEN phaseMargin END AS "phaseMargin", CASE WHEN phaseMargin >= 60 THEN area END AS area FROM m""",
)
def _(spark, sf):
    return design.failed_phase_filter(run_sql(spark, sf, MEASURED))
