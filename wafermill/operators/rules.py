"""Layer rules and layer maps as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wafermill.functions.columns import FLOAT_PATTERN, strip
from wafermill.plans.attach import attach

ROUTABLE = "met|active|poly"


def csv_cells(line: Column) -> Column:
    """Cells of one CSV line; quotes around a cell are dropped."""
    parts = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    return F.transform(parts, lambda c: F.regexp_replace(c, r'^"(.*)"$', "$1"))


def rule_sheet_to_long(lines: DataFrame) -> DataFrame:
    """Rule sheets ``(sheet, row_no, line)`` to one row per rule.

    Row 0 names the layers, rows 1 and 2 are labels, then three rows share the layer name
    of their first row. A cell reads ``prefix,name=value``; the value is a number or a
    tuple of whole numbers. ``problem`` tells cells to repair: ``no comma``, ``no value``
    or ``bad number``. A rule named twice in a group keeps its last cell.
    """
    cells = lines.select("sheet", "row_no", csv_cells(F.col("line")).alias("cells"))
    heads = cells.where("row_no = 0").select(
        "sheet", F.posexplode("cells").alias("col", "glayer2")
    ).where("col > 0")
    # Three rows at most meet here, so the list is bounded by the format.
    groups = (
        cells.where("row_no >= 3")
        .groupBy("sheet", F.floor((F.col("row_no") - 3) / 3).alias("grp"))
        .agg(F.sort_array(F.collect_list(F.struct("row_no", "cells"))).alias("rows"))
        .select("sheet", "grp", F.col("rows")[0]["cells"][0].alias("glayer1"), F.explode("rows").alias("r"))
    )
    body = groups.select("sheet", "grp", "glayer1", F.col("r.row_no"), F.posexplode("r.cells").alias("col", "cell"))
    body = body.where("col > 0 AND cell <> ''")
    flat = F.replace("cell", F.lit(" "), F.lit(""))
    rule = F.when(F.contains(flat, F.lit(",")), F.regexp_extract(flat, r"^[^,]*,(.*)$", 1)).otherwise(flat)
    parts = F.split(rule, "=", -1)
    value = F.when(F.size(parts) == 2, parts[1])
    is_tuple = F.contains(value, F.lit(","))
    number = F.when(~is_tuple & value.rlike(FLOAT_PATTERN), value.try_cast("double"))
    problem = (
        F.when(~F.contains("cell", F.lit(",")), "no comma")
        .when(F.size(parts) != 2, "no value")
        .when(~is_tuple & number.isNull(), "bad number")
    )
    named = attach(body, heads, ["sheet", "col"]).select(
        "sheet", "grp", "glayer1", "glayer2", "row_no", parts[0].alias("rule"),
        F.struct(
            number.alias("value"),
            F.when(is_tuple, F.regexp_replace(value, "[()]", "")).alias("text_value"),
            problem.alias("problem"),
        ).alias("got"),
    )
    return (
        named.groupBy("sheet", "grp", "glayer1", "glayer2", "rule")
        .agg(F.max_by("got", "row_no").alias("got"))
        .select("sheet", "glayer1", "glayer2", "rule", "got.*")
    )


def rules_long(nested: DataFrame, rules: str, *keep: str) -> DataFrame:
    """Maps layer -> layer -> rule -> value as rows; null and empty maps give none."""
    one = nested.select(*keep, F.explode(rules).alias("glayer1", "_m"))
    two = one.select(*keep, "glayer1", F.explode("_m").alias("glayer2", "_m"))
    return two.select(*keep, "glayer1", "glayer2", F.explode("_m").alias("rule", "value"))


def _rule_maps(rules: DataFrame) -> DataFrame:
    """Rules of a pair as a map. Of a rule given twice for a pair the larger, stricter value holds."""
    once = rules.groupBy("pdk", "glayer1", "glayer2", "rule").agg(F.max("value").alias("value"))
    return once.groupBy("pdk", "glayer1", "glayer2").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "value"))).alias("rules")
    )


def rule_lookup(pairs: DataFrame, rules: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``rules`` (name -> value) for each (pdk, glayer1, glayer2).

    The pair is tried as given, then swapped; a null second layer means the first one.
    ``strict`` raises an error when there is no rule, else ``rules`` is null.
    """
    maps = _rule_maps(rules)
    asked = pairs.withColumn("glayer2", F.coalesce("glayer2", "glayer1"))
    straight = attach(asked, maps.withColumnRenamed("rules", "_straight"), ["pdk", "glayer1", "glayer2"], "left")
    turned = maps.select(
        "pdk", F.col("glayer2").alias("glayer1"), F.col("glayer1").alias("glayer2"), F.col("rules").alias("_turned")
    )
    both = attach(straight, turned, ["pdk", "glayer1", "glayer2"], "left")
    found = F.coalesce("_straight", "_turned")
    if strict:
        message = F.concat(F.lit("no rules found between "), "glayer1", F.lit(" and "), "glayer2")
        found = F.when(found.isNull(), F.raise_error(message).cast("map<string,double>")).otherwise(found)
    return both.withColumn("rules", found).drop("_straight", "_turned")


def snap_up(value: Column, grid: Column | float, steps: int = 2) -> Column:
    """Round away from zero to ``steps`` times the grid, in decimals; grid 0 means 0.001."""
    exact = value.cast("decimal(24,9)")
    base = (F.lit(grid) if isinstance(grid, (int, float)) else grid).cast("decimal(18,6)")
    step = (F.when(base == 0, F.lit("0.0005").cast("decimal(18,6)")).otherwise(base) * F.lit(steps)).cast("decimal(18,6)")
    return (F.signum(exact) * F.ceil(F.abs(exact) / step) * step).cast("decimal(24,6)")


def max_separation(rules: DataFrame, layers: list[str] | int, grid: float) -> DataFrame:
    """Largest ``min_separation`` over the metals up to a level, or over a layer list."""
    names = [f"met{i}" for i in range(1, layers + 1)] if isinstance(layers, int) else layers
    own = rules.where((F.col("glayer1") == F.col("glayer2")) & F.col("glayer1").isin(names))
    return (
        own.where(F.col("rule") == "min_separation")
        .groupBy("pdk")
        .agg(F.max("value").alias("_max"))
        .select("pdk", snap_up(F.col("_max"), grid).alias("max_separation"))
    )


def resolve_layer(wanted: DataFrame, glayers: DataFrame, layers: DataFrame) -> DataFrame:
    """Generic layer to (number, datatype), directly or by the technology layer name."""
    mapped = attach(wanted, glayers.select("pdk", "glayer", "layer_name", F.col("number").alias("_n"), F.col("datatype").alias("_d")), ["pdk", "glayer"], "left")
    named = attach(mapped, layers.select("pdk", "layer_name", "number", "datatype"), ["pdk", "layer_name"], "left")
    return named.select(
        *wanted.columns,
        F.coalesce("_n", "number").alias("number"),
        F.coalesce("_d", "datatype").alias("datatype"),
    )


def reverse_layer(tuples: DataFrame, glayers: DataFrame, layers: DataFrame) -> DataFrame:
    """(number, datatype) to the generic layer; of several the last mapping wins.

    Unknown tuples get null. Direct mappings go before those by layer name.
    """
    direct = glayers.where("number IS NOT NULL").groupBy("pdk", "number", "datatype").agg(
        F.max_by("glayer", "ord").alias("_direct")
    )
    last_name = layers.groupBy("pdk", "number", "datatype").agg(F.max_by("layer_name", "ord").alias("layer_name"))
    by_name = glayers.where("layer_name IS NOT NULL").groupBy("pdk", "layer_name").agg(
        F.max_by("glayer", "ord").alias("_named")
    )
    named = last_name.join(by_name, ["pdk", "layer_name"]).drop("layer_name")
    keys = ["pdk", "number", "datatype"]
    both = attach(attach(tuples, direct, keys, "left"), named, keys, "left")
    return both.select(*tuples.columns, F.coalesce("_direct", "_named").alias("glayer"))


def missing_layers(required: DataFrame, glayers: DataFrame, valid: list[str]) -> DataFrame:
    """Required layers without a mapping, and mapped layers outside the valid list."""
    lacking = required.select("pdk", "glayer").distinct().join(
        glayers.select("pdk", "glayer").distinct(), ["pdk", "glayer"], "left_anti"
    )
    odd = glayers.where(~F.col("glayer").isin(valid)).select("pdk", "glayer").distinct()
    return lacking.withColumn("problem", F.lit("not mapped")).union(odd.withColumn("problem", F.lit("not valid")))


def routable_layers(layers: DataFrame) -> DataFrame:
    """Layers whose name contains met, active or poly."""
    return layers.where(F.col("glayer").rlike(ROUTABLE))


def rule_graph_edges(rules: DataFrame) -> DataFrame:
    """One edge per rule between two layers, with a class by the rule's name."""
    name = F.col("rule")
    kind = (
        F.when(F.contains(name, F.lit("min_separ")), "separation")
        .when(F.contains(name, F.lit("min_enclos")), "enclosure")
        .when(F.contains(name, F.lit("width")), "width")
        .otherwise("other")
    )
    return rules.select("pdk", "glayer1", "glayer2", "rule", kind.alias("edge_class"))
