"""Design-space tables: grids, Latin hypercubes, balanced levels, budgets, records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wafermill.functions.columns import digest_int, digest_unit
from wafermill.plans.attach import attach
from wafermill.plans.expand import numbered_rows
from wafermill.plans.ranks import hash_rank
from wafermill.session import cut_lineage

SENTINEL = -987.654321

# The named parts of the 18 sweep parameters, with their lengths.
PARAMETER_PARTS = {
    "input_pair_params": 2, "fvf_shunt_params": 2, "local_current_bias_params": 2, "diff_pair_load_params": 2,
    "ratio": 1, "current_mirror_params": 2, "resistor_params": 4, "global_current_bias_params": 3,
}
# The 11 results in vector order.
RESULT_NAMES = [
    "ugb", "dcGain", "phaseMargin", "Ibias1", "Ibias2", "area", "power", "noise", "bw_3db", "rise_slew", "fall_slew",
]
# The level lists of the full sweep, one list of choices per part and place.
SWEEP_CHOICES = {
    "input_pair_params": ([3, 4, 5], [1.7, 2, 2.3]),
    "fvf_shunt_params": ([2.5, 2.75, 3], [0.8, 1, 1.2]),
    "local_current_bias_params": ([3.5, 3.75, 4], [2.5, 3, 3.5]),
    "diff_pair_load_params": ([7, 8, 9, 10], [1]),
    "ratio": ([1, 2],),
    "current_mirror_params": ([2, 2.25, 2.5], [1]),
    "resistor_params": ([0.5, 0.6, 0.7], [2.8, 3, 3.2], [4], [4]),
    "global_current_bias_params": ([8.3], [1.4, 1.8, 2.2, 2.6, 3], [2]),
}


def grid_sweep(levels: DataFrame, by: list[str], axes: list[str]) -> DataFrame:
    """Full cross product of the level lists of each plan, as numbered rows.

    ``levels`` has one array column per axis. No join is made: row k of a plan is decoded
    from k digit by digit, the last axis running fastest, so a plan of any size is spread
    evenly.
    """
    total = reduce(lambda a, b: a * b, [F.size(a).cast("long") for a in axes])
    rows = numbered_rows(levels, total, "index", by)
    columns, stride = [], F.lit(1).cast("long")
    for axis in reversed(axes):
        place = F.pmod(F.floor(F.col("index") / stride), F.size(axis).cast("long")).cast("int") + 1
        columns.insert(0, F.element_at(axis, place).alias(axis))
        stride = stride * F.size(axis).cast("long")
    return rows.select(*by, "index", *columns)


def full_sweep(spark: SparkSession) -> DataFrame:
    """The built-in sweep of all parts: one 18-value vector per design."""
    lists = {f"{part}_{i}": [float(v) for v in choice] for part, choices in SWEEP_CHOICES.items() for i, choice in enumerate(choices)}
    one = spark.range(1).select(F.lit(0).alias("plan"), *[F.array(*[F.lit(v) for v in vs]).alias(n) for n, vs in lists.items()])
    grid = grid_sweep(one, ["plan"], list(lists))
    return grid.select("index", F.array(*lists).alias("params"))


def inventory_levels(specs: DataFrame) -> DataFrame:
    """Level lists of ``(family, axis, min, max, step, count)`` rows, both ends included."""
    low, high, step = (F.col(c).cast("decimal(18,6)") for c in ("min", "max", "step"))
    n = F.floor((high - low) / step).cast("int") + 1
    levels = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (low + i * step).cast("double"))
    return specs.select("family", "axis", "count", n.alias("n_levels"), levels.alias("levels"))


def grid_size(levels: DataFrame) -> DataFrame:
    """Number of grid points per family: product of level counts to the power of copies."""
    points = F.pow(F.col("n_levels").cast("double"), F.col("count").cast("double"))
    return levels.groupBy("family").agg(F.product(points).alias("grid_size"))


def allocate_budget(dims: DataFrame, by: list[str], total: str, weight: str, order: str) -> DataFrame:
    """Largest-remainder split of ``total`` over the families of a plan by ``weight``.

    Ties in the fraction go to the larger ``order``. A plan has as many rows as it has
    families.
    """
    whole = Window.partitionBy(*by)
    share = F.col(total) * (F.col(weight) / F.sum(weight).over(whole))
    parts = dims.withColumn("_raw", share).withColumn("_floor", F.floor("_raw").cast("long"))
    parts = parts.withColumn("_frac", F.col("_raw") - F.col("_floor"))
    rest = F.col(total) - F.sum("_floor").over(whole)
    rank = F.row_number().over(whole.orderBy(F.col("_frac").desc(), F.col(order).desc()))
    parts = parts.withColumn("_rest", rest).withColumn("_rank", rank)
    return parts.withColumn(
        "budget", F.col("_floor") + F.when(F.col("_rank") <= F.col("_rest"), 1).otherwise(0)
    ).drop("_raw", "_floor", "_frac", "_rest", "_rank")


def find_valid_budget(
    dims: DataFrame, plan: str, start: str, weight: str, order: str, levels: str, max_search: int = 10000
) -> DataFrame:
    """Smallest total >= ``start`` whose split is divisible by every level count.

    Totals are tried in growing blocks, and only plans without an answer go on, so the
    work stays near the answer. A plan without one in ``max_search`` steps is an error.
    """
    open_plans = cut_lineage(dims)
    found, low = None, 0
    for high in [h for h in (64, 1024, 4096) if h < max_search] + [max_search]:
        tried = numbered_rows(open_plans, F.lit(high - low), "_step", [plan])
        tried = tried.withColumn("n_total", (F.col(start) + F.col("_step") + low).cast("long"))
        split = allocate_budget(tried, [plan, "n_total"], "n_total", weight, order)
        good = F.forall(levels, lambda s: F.col("budget") % s == 0)
        valid = split.groupBy(plan, "n_total").agg(F.bool_and(good).alias("ok")).where("ok")
        hits = cut_lineage(valid.groupBy(plan).agg(F.min("n_total").alias("n_total")))
        found = hits if found is None else found.union(hits)
        open_plans = cut_lineage(open_plans.join(hits, plan, "left_anti"))
        low = high
        if open_plans.isEmpty():
            return found
    raise ValueError("no valid total found")


def runtime_budget(families: DataFrame, by: list[str], cores: float, hours: float, overhead: float) -> DataFrame:
    """Samples per family: (C*H*3600)/(O*sum d) * d_p/T_p, with ``dims`` and ``seconds``."""
    total = families.groupBy(*by).agg(F.sum("dims").alias("_all"))
    budget = F.lit(cores * hours * 3600.0) / (F.lit(overhead) * F.col("_all")) * F.col("dims") / F.col("seconds")
    return attach(families, total, by).withColumn("n_samples", budget).drop("_all")


def _token(seed: Column | str, *parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", seed, *parts))


def latin_hypercube(plans: DataFrame, keys: list[str], axis: str, n: str, seed: str) -> DataFrame:
    """n points per key and axis, one in each of n equal cells, in seeded random order.

    ``plans`` has one row per key and axis. The permutation is the rank of a digest, so it
    is the same on every run and needs no sort of a whole axis.
    """
    rows = numbered_rows(plans, F.col(n), "sample_id", [*keys, axis])
    token = _token(F.lit(seed), *keys, axis, "sample_id")
    ranked = hash_rank(rows.withColumn("_token", token), [*keys, axis], "_token", ["sample_id"], "_perm")
    jitter = digest_unit(_token(F.lit(f"{seed}u"), *keys, axis, "sample_id"))
    return ranked.withColumn("u", (F.col("_perm") - 1 + jitter) / F.col(n)).drop("_token", "_perm")


def maximin_select(candidates: DataFrame, key: str, candidate: str, distances: DataFrame) -> DataFrame:
    """Of several designs per key keep the one with the largest smallest distance.

    ``distances`` is (key, candidate, min_distance). The designs are built in parallel
    instead of improving one by swaps, which gives other points with the same goal.
    Ties go to the smaller candidate.
    """
    best = distances.groupBy(key).agg(
        F.max_by(candidate, F.struct("min_distance", (-F.col(candidate)).alias("c"))).alias("_best")
    )
    return attach(candidates, best, [key]).where(F.col(candidate) == F.col("_best")).drop("_best")


def balanced_levels(plans: DataFrame, keys: list[str], axis: str, n: str, size: Column, seed: str, strict: bool) -> DataFrame:
    """Level positions 0..size-1, each n/size times, in seeded random order.

    Where n is not a multiple of the size: an error when ``strict``, else every position is
    drawn on its own.
    """
    rows = numbered_rows(plans, F.col(n), "sample_id", [*keys, axis])
    rows = rows.withColumn("_token", _token(F.lit(seed), *keys, axis, "sample_id"))
    ranked = hash_rank(rows, [*keys, axis], "_token", ["sample_id"], "_perm")
    even = F.col(n) % size == 0
    message = F.concat(F.lit("sample count is not a multiple of the level count on axis "), F.col(axis))
    other = F.raise_error(message).cast("long") if strict else digest_int(F.col("_token")) % size
    position = F.when(even, (F.col("_perm") - 1) % size).otherwise(other)
    return ranked.withColumn("_level", position.cast("int")).drop("_token", "_perm")


def balanced_int_levels(plans: DataFrame, keys: list[str], axis: str, n: str, seed: str, strict: bool = False) -> DataFrame:
    """Whole-number levels from ``min`` to ``max``, each used equally often."""
    placed = balanced_levels(plans, keys, axis, n, F.col("max") - F.col("min") + 1, seed, strict)
    return placed.withColumn("level", (F.col("min") + F.col("_level")).cast("int")).drop("_level")


def balanced_cat_levels(plans: DataFrame, keys: list[str], axis: str, n: str, seed: str, strict: bool = False) -> DataFrame:
    """Choices from the array ``levels``, each used equally often."""
    placed = balanced_levels(plans, keys, axis, n, F.size("levels"), seed, strict)
    return placed.withColumn("level", F.element_at("levels", F.col("_level") + 1)).drop("_level")


def scale_to_spec(points: DataFrame, specs: DataFrame, on: list[str]) -> DataFrame:
    """Unit values to the range of their axis: u * (max - min) + min."""
    scaled = attach(points, specs.select(*on, F.col("min").alias("_lo"), F.col("max").alias("_hi")), on)
    return scaled.withColumn("value", F.col("u") * (F.col("_hi") - F.col("_lo")) + F.col("_lo")).drop("_lo", "_hi")


# The composite parameters of the two-stage family; a number is the place
# inside one continuous axis, the other entries are axes of their own.
COMPOSITES = {
    "half_diffpair_params": [("half_diffpair_params_w", 0), ("half_diffpair_params_l", 0), ("half_diffpair_fingers", 0)],
    "diffpair_bias": [("diffpair_bias_w", 0), ("diffpair_bias_l", 0), ("diffpair_bias_fingers", 0)],
    "half_common_source_params": [
        ("half_common_source_params_w", 0), ("half_common_source_params_l", 0),
        ("half_common_source_fingers", 0), ("half_common_source_mults", 0),
    ],
    "half_common_source_bias": [
        ("half_common_source_bias_w", 0), ("half_common_source_bias_l", 0),
        ("half_common_source_bias_fingers", 0), ("half_common_source_bias_mults", 0),
    ],
    "output_stage_params": [("output_stage_params", 0), ("output_stage_params", 1), ("output_stage_fingers", 0)],
    "output_stage_bias": [("output_stage_bias", 0), ("output_stage_bias", 1), ("output_stage_bias_fingers", 0)],
    "half_pload": [("half_pload_w", 0), ("half_pload_l", 0), ("half_pload_fingers", 0)],
    "mim_cap_size": [("mim_cap_size", 0), ("mim_cap_size", 1)],
}
PAIRED = ["fvf", "txgate"]
SCALAR = ["current_mirror", "diff_pair"]


def assemble_samples(long: DataFrame) -> DataFrame:
    """One record per sample from rows (pcell, sample_id, axis, pos, value, text).

    Numbers come in ``value``, category choices in ``text``. Scalars are arrays of one
    element, so all families share one schema; columns a family has not are null.
    """
    wanted = [("width", 0), ("width", 1), ("length", 0), ("length", 1)]
    wanted += [(a, 0) for a in ("fingers", "multipliers", "numcols", "mim_cap_rows", "rmult", "with_antenna_diode_on_diffinputs")]
    wanted += [spot for spots in COMPOSITES.values() for spot in spots]
    wanted = list(dict.fromkeys(wanted))
    name = {spot: f"{spot[0]}__{spot[1]}" for spot in wanted}
    picks = [
        F.max(F.when((F.col("axis") == axis) & (F.col("pos") == pos), F.col("value"))).alias(name[(axis, pos)])
        for axis, pos in wanted
    ]
    # Choices become booleans here, so that the aggregate stays a hash aggregate.
    choices = {"type": "nmos", "add_output_stage": "true"}
    picks += [F.max(F.when(F.col("axis") == a, F.col("text") == yes)).alias(f"{a}__yes") for a, yes in choices.items()]
    wide = long.groupBy("pcell", "sample_id").agg(*picks)
    family = F.col("pcell")
    paired, scalar = family.isin(PAIRED), family.isin(SCALAR)
    lvcm, opamp = family == "lvcm", family == "opamp"

    def at(axis: str, pos: int = 0) -> Column:
        return F.col(name[(axis, pos)])

    def whole(axis: str) -> Column:
        return at(axis).cast("int")

    both = paired | lvcm
    antenna = whole("with_antenna_diode_on_diffinputs")
    return wide.select(
        "pcell",
        "sample_id",
        F.when(both, F.array(at("width"), at("width", 1))).when(scalar, F.array(at("width"))).alias("width"),
        F.when(paired, F.array(at("length"), at("length", 1))).when(scalar | lvcm, F.array(at("length"))).alias("length"),
        F.when(both, F.array(whole("fingers"), whole("fingers"))).when(family == "diff_pair", F.array(whole("fingers"))).alias("fingers"),
        F.when(both, F.array(whole("multipliers"), whole("multipliers"))).alias("multipliers"),
        F.when(family == "current_mirror", whole("numcols")).alias("numcols"),
        F.when(family == "diff_pair", F.col("type__yes")).alias("n_or_p_fet"),
        F.when(opamp, F.col("add_output_stage__yes")).alias("add_output_stage"),
        *[F.when(opamp, F.array(*[at(*s) for s in spots])).alias(out) for out, spots in COMPOSITES.items()],
        F.when(opamp, whole("mim_cap_rows")).alias("mim_cap_rows"),
        F.when(opamp, whole("rmult")).alias("rmult"),
        F.when(opamp, F.when(antenna == 1, 0).otherwise(antenna)).alias("with_antenna_diode_on_diffinputs"),
    )


def params_to_vector(df: DataFrame, out: str = "params") -> DataFrame:
    """Named parameter columns (arrays; ratio a number) to one array of 18 doubles."""
    parts = [
        F.array(F.col(n).cast("double")) if size == 1 else F.col(n).cast("array<double>")
        for n, size in PARAMETER_PARTS.items()
    ]
    vector = F.concat(*parts)
    return df.withColumn(out, _sized(vector, 18)).drop(*PARAMETER_PARTS)


def _sized(vector: Column, size: int) -> Column:
    message = F.lit(f"vector should have length {size}")
    return F.when(F.size(vector) == size, vector).otherwise(F.raise_error(message).cast("array<double>"))


def vector_to_params(df: DataFrame, vector: str) -> DataFrame:
    """An array of 18 doubles to named columns; null gives the sentinel, a wrong length an error."""
    whole = F.coalesce(F.col(vector), F.array_repeat(F.lit(SENTINEL), 18))
    whole = _sized(whole, 18)
    columns, place = [], 1
    for n, size in PARAMETER_PARTS.items():
        columns.append((F.element_at(whole, place).cast("int") if size == 1 else F.slice(whole, place, size)).alias(n))
        place += size
    return df.select("*", *columns).drop(vector)


def vector_to_results(df: DataFrame, vector: str) -> DataFrame:
    """An array of 11 doubles to the named results."""
    whole = _sized(F.coalesce(F.col(vector), F.array_repeat(F.lit(SENTINEL), 11)), 11)
    return df.select("*", *[F.element_at(whole, i + 1).alias(n) for i, n in enumerate(RESULT_NAMES)]).drop(vector)


def results_to_vector(df: DataFrame, out: str = "results") -> DataFrame:
    """The named results to one array; missing values become the sentinel."""
    parts = [F.coalesce(F.col(n).cast("double"), F.lit(SENTINEL)) for n in RESULT_NAMES]
    return df.withColumn(out, F.array(*parts)).drop(*RESULT_NAMES)


def param_summary(samples: DataFrame, by: list[str]) -> DataFrame:
    """Ranges of both widths and lengths, and distinct finger and multiplier combinations."""
    ends = []
    for axis in ("width", "length"):
        for i in (0, 1):
            value = F.get(axis, F.lit(i))
            ends += [F.min(value).alias(f"min_{axis}_{i}"), F.max(value).alias(f"max_{axis}_{i}")]
    return samples.groupBy(*by).agg(
        *ends,
        F.count_distinct("fingers").alias("finger_combinations"),
        F.count_distinct("multipliers").alias("multiplier_combinations"),
    )


def param_examples(samples: DataFrame, order: str, n: int = 3) -> DataFrame:
    """The first samples by ``order``: a top-k, never a full sort."""
    return samples.orderBy(order).limit(n)


def failed_phase_filter(results: DataFrame, margin: float = 60.0) -> DataFrame:
    """Blank every result of a design whose phase margin is low or missing."""
    good = F.col("phaseMargin") >= margin
    rest = [c for c in results.columns if c not in RESULT_NAMES]
    return results.select(*rest, *[F.when(good, F.col(c)).alias(c) for c in RESULT_NAMES if c in results.columns])
