"""Netlist tables. Lines have ``(path, line_no, line)``, continuations already glued."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wafermill.functions.columns import strip, tokens
from wafermill.plans.attach import attach, null_safe_join
from wafermill.plans.components import connected_components
from wafermill.plans.expand import numbered_rows
from wafermill.plans.ranks import range_rank
from wafermill.plans.scan import LINES_PER_CHUNK, carry_forward
from wafermill.session import cut_lineage


def _is_header(line: Column) -> Column:
    return F.lower(line).startswith(".subckt")


def subcircuits(lines: DataFrame) -> DataFrame:
    """Subcircuit headers as ``(path, line_no, subckt, pins)``; pins keep their order."""
    parts = tokens(F.col("line"))
    pins = F.filter(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), lambda p: ~F.contains(p, F.lit("=")))
    return lines.where(_is_header(F.col("line"))).select(
        "path", "line_no", F.try_element_at(parts, F.lit(2)).alias("subckt"), pins.alias("pins")
    )


def netlist_instances(lines: DataFrame, chunk: int = LINES_PER_CHUNK) -> DataFrame:
    """Instance lines with their subcircuit, nets, model and ``k=v`` parameters.

    The header is carried forward to the instances below it; lines after ``.ends`` belong
    to no subcircuit, and comments and directives are no instances.
    """
    rows = lines.withColumn("line", strip("line"))
    header, ends = _is_header(F.col("line")), F.lower("line").startswith(".ends")
    name = F.when(header, F.coalesce(F.try_element_at(tokens(F.col("line")), F.lit(2)), F.lit(""))).when(ends, "")
    rows = carry_forward(rows, ["path"], "line_no", {"_subckt": name}, chunk)
    rows = rows.where(F.col("line").rlike("^[A-Za-z]")).withColumn("_p", tokens(F.col("line")))
    plain = F.filter("_p", lambda p: ~F.contains(p, F.lit("=")))
    pairs = F.filter("_p", lambda p: F.contains(p, F.lit("=")))
    # Of a parameter given twice the last one holds; a value may contain further equal signs.
    key = lambda p: F.substring_index(p, "=", 1)
    final = F.filter(
        pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: key(later) == key(p))
    )
    params = F.map_from_entries(
        F.transform(final, lambda p: F.struct(key(p), F.substr(p, F.length(key(p)) + 2)))
    )
    return rows.withColumn("_w", plain).select(
        "path",
        "line_no",
        F.when(F.col("_subckt") != "", F.col("_subckt")).alias("subckt"),
        F.col("_w")[0].alias("inst"),
        F.slice("_w", 2, F.greatest(F.size("_w") - 2, F.lit(0))).alias("nets"),
        F.element_at("_w", -1).alias("model"),
        params.alias("params"),
    )


def netlist_name(lines: DataFrame) -> DataFrame:
    """Token after the first line that holds ``subckt``; default ``Netlist``."""
    named = lines.where(F.contains("line", F.lit("subckt")))
    first = named.groupBy("path").agg(F.min_by("line", "line_no").alias("_first"))
    name = F.coalesce(F.try_element_at(F.split("_first", " "), F.lit(2)), F.lit("Netlist"))
    return null_safe_join(lines.select("path").distinct(), first, ["path"], "left").select("path", name.alias("circuit_name"))


def top_design_name(lines: DataFrame) -> DataFrame:
    """Name on the last ``.ends`` line of each file, null when that line is bare."""
    text = strip("line")
    ends = lines.where(text.startswith(".ends"))
    last = ends.groupBy("path").agg(F.max_by(text, "line_no").alias("_last"))
    top = F.try_element_at(tokens(F.col("_last")), F.lit(2))
    return null_safe_join(lines.select("path").distinct(), last, ["path"], "left").select("path", top.alias("top"))


def connection_table(instances: DataFrame, subckts: DataFrame) -> DataFrame:
    """Instance pin -> net, by position in the child's pin list.

    The pin lists are joined whole, one row per instance, and taken apart afterwards.
    """
    children = subckts.select("path", F.col("subckt").alias("child"), "pins")
    both = attach(instances.withColumnRenamed("model", "child"), children, ["path", "child"])
    n = F.least(F.size("nets"), F.size("pins"))
    pairs = F.arrays_zip(F.slice("pins", 1, n).alias("pin"), F.slice("nets", 1, n).alias("net"))
    flat = both.select("path", "line_no", "subckt", "inst", "child", F.posexplode(pairs).alias("pos", "p"))
    return flat.select("path", "line_no", "subckt", "inst", "child", "pos", F.col("p")["pin"].alias("pin"), F.col("p")["net"].alias("net"))


def normalise_netlist_lines(
    lines: DataFrame,
    models: list[tuple[str, str]],
    header_hints: list[str],
    header: str,
    drop_parasitics: bool = False,
    micron_units: bool = False,
) -> DataFrame:
    """Comment out, rename and rewrite netlist lines.

    Models are renamed in the order given, and a line with a new model name starts with
    ``M``. A line with all hints (any case) becomes ``header``. Floating lines, and with
    ``drop_parasitics`` also R and C lines, are commented out; that option also drops the
    ad, as, ps and pd values. ``micron_units`` puts ``u`` behind bare ``w=`` and ``l=``.
    """
    line = F.rtrim(F.col("line"))
    low = F.lower(strip("line"))
    long_enough = F.length(low) > 1
    new = line
    for old, name in models:
        new = F.replace(new, F.lit(old), F.lit(name))
    renamed = F.lit(False)
    for _, name in models:
        renamed = renamed | F.contains(new, F.lit(name))
    new = F.when(long_enough & renamed, F.concat(F.lit("M"), F.substr(new, F.lit(2)))).when(long_enough, new).otherwise(line)
    if header_hints:
        hinted = F.lit(True)
        for h in header_hints:
            hinted = hinted & F.contains(low, F.lit(h.lower()))
        new = F.when(hinted, F.lit(header)).otherwise(new)
    off = F.contains(low, F.lit("floating"))
    if drop_parasitics:
        off = off | F.left(low, F.lit(1)).isin("c", "r")
    new = F.when(off, F.concat(F.lit("* "), new)).otherwise(new)
    if drop_parasitics:
        for key in ("ad", "as", "ps", "pd"):
            new = F.regexp_replace(new, key + r"=(\S*)", "")
    if micron_units:
        for key in ("w", "l"):
            new = F.regexp_replace(new, "(" + key + r"=)([0-9.]+)(\s|$)", "$1$2u$3")
    return lines.withColumn("line", new)


def device_totals(edges: DataFrame) -> DataFrame:
    """Instances of every descendant below every ancestor, multiplied along the paths.

    Edges are ``(parent, child, n)``. Each level is one join and one aggregate that merges
    equal (ancestor, node) pairs, so shared blocks do not multiply the work. A hierarchy
    may have any depth; a block that holds itself is an error.
    """
    base = cut_lineage(edges.groupBy("parent", "child").agg(F.sum("n").alias("n")))
    front = base.select(F.col("parent").alias("ancestor"), F.col("child").alias("node"), "n")
    total = front
    while True:
        if not front.where(F.col("ancestor").eqNullSafe(F.col("node"))).isEmpty():
            raise RuntimeError("loop in the hierarchy")
        step = base.select(F.col("parent").alias("node"), F.col("child").alias("_c"), F.col("n").alias("_n"))
        front = cut_lineage(
            front.join(step, "node")
            .groupBy("ancestor", F.col("_c").alias("node"))
            .agg(F.sum(F.col("n") * F.col("_n")).alias("n"))
        )
        if front.isEmpty():
            return total.groupBy("ancestor", "node").agg(F.sum("n").alias("n"))
        total = total.union(front)


def expand_hierarchy(edges: DataFrame, top: str) -> DataFrame:
    """Every subcircuit reached from ``top`` with its path, depth and count on that path.

    The edges are written out once, as every level reads them. A hierarchy may have any depth;
    a block that holds itself is an error.
    """
    edges = cut_lineage(edges)
    step = edges.select(F.col("parent").alias("_p"), "child", F.col("n").alias("_n"))
    front = edges.where(F.col("parent") == top).select(
        F.col("child").alias("node"), F.concat(F.lit(top + "/"), F.col("child")).alias("path"), "n", F.lit(1).alias("depth"),
        F.array(F.lit(top), "child").alias("_line"),
    )
    found = front
    while True:
        if not front.where(F.size(F.array_distinct("_line")) < F.size("_line")).isEmpty():
            raise RuntimeError("loop in the hierarchy")
        front = cut_lineage(
            front.join(step, front["node"] == step["_p"]).select(
                F.col("child").alias("node"), F.concat("path", F.lit("/"), F.col("child")).alias("path"),
                (F.col("n") * F.col("_n")).alias("n"), (F.col("depth") + 1).alias("depth"), F.array_append("_line", F.col("child")).alias("_line"),
            )
        )
        if front.isEmpty():
            return found.drop("_line")
        found = found.union(front)


def device_rows(devices: DataFrame, *keep: str) -> DataFrame:
    """One row per effective device: fingers x multipliers mains, then the dummies.

    ``devices`` has fingers, multipliers, dummies (0 to 2 per multiplier), width, length.
    """
    mains = (F.col("fingers") * F.col("multipliers")).cast("long")
    both = mains + (F.col("dummies") * F.col("multipliers")).cast("long")
    rows = numbered_rows(devices, both, "_i", list(keep))
    main = F.col("_i") < mains
    return rows.select(
        *keep,
        F.when(main, F.concat(F.lit("XMAIN"), F.col("_i") + 1)).otherwise(F.concat(F.lit("XDUMMY"), F.col("_i") - mains + 1)).alias("inst"),
        F.when(main, "D G S B").otherwise("B B B B").alias("nets"),
        "length",
        "width",
    )


def unique_subcircuits(definitions: DataFrame) -> DataFrame:
    """Each definition text once; other texts under a used name get _1, _2, ...

    ``definitions`` has (netlist, name, text, pos); the order is that of first appearance.
    """
    once = definitions.groupBy("netlist", "name", "text").agg(F.min("pos").alias("first"))
    ranked = range_rank(once, ["netlist", "name"], [F.col("first").asc(), F.col("text").asc()], "_nth")
    new = F.when(F.col("_nth") == 1, F.col("name")).otherwise(F.concat("name", F.lit("_"), F.col("_nth") - 1))
    return ranked.select("netlist", "name", "text", "first", new.alias("unique_name"))


def global_nodes(own: DataFrame, children: DataFrame) -> DataFrame:
    """Distinct global nodes of a netlist and of its direct children.

    ``own`` has (netlist, node), ``children`` has (netlist, child).
    """
    below = children.join(own.select(F.col("netlist").alias("child"), "node"), "child").select("netlist", "node")
    return own.select("netlist", "node").union(below).distinct()


def name_wires(pairs: DataFrame) -> DataFrame:
    """A wire name for every pin in ``pairs`` (netlist, pin_a, pin_b).

    Pins joined directly or through others share ``wire{k}``; k counts from 0 in the order
    of the smallest pin of each wire. Where two finished wires meet they become one; a
    one-pass naming would keep them apart.
    """
    edges = pairs.select("netlist", F.col("pin_a").alias("u"), F.col("pin_b").alias("v"))
    labels = connected_components(edges, ["netlist"])
    alone = edges.where("u = v").select("netlist", F.col("u").alias("node"), F.col("v").alias("label"))
    alone = null_safe_join(alone.distinct(), labels.select("netlist", "node"), ["netlist", "node"], "left_anti")
    labels = labels.union(alone)
    order = range_rank(labels.select("netlist", "label").distinct(), ["netlist"], [F.col("label").asc()], "_k")
    return null_safe_join(labels, order, ["netlist", "label"]).select(
        "netlist", F.col("node").alias("pin"), F.concat(F.lit("wire"), F.col("_k") - 1).alias("wire")
    )


def render_subcircuits(globals_: DataFrame, headers: DataFrame, instances: DataFrame) -> DataFrame:
    """Netlist text as ordered lines ``(netlist, part, def_no, line_no, line)``.

    Part 0 is the global directive, part 1 the definitions in order. A definition is its
    header, its instance lines and its end line; no definition is put together in memory,
    so the size of a subcircuit is not limited. Sort by the first four columns to write.

    ``headers``: (netlist, def_no, name, pins array); ``instances``: (netlist, def_no,
    line_no >= 0, inst, nets array, model).
    """
    heads = headers.select(
        "netlist", "def_no",
        F.explode(F.array(
            F.struct(F.lit(-1).cast("long").alias("line_no"), F.concat(F.lit(".subckt "), "name", F.lit(" "), F.array_join("pins", " ")).alias("line")),
            F.struct(F.lit(2**62).alias("line_no"), F.concat(F.lit(".ends "), "name").alias("line")),
        )).alias("l"),
    ).select("netlist", F.lit(1).alias("part"), "def_no", "l.line_no", "l.line")
    body = instances.select(
        "netlist", F.lit(1).alias("part"), "def_no", "line_no",
        F.concat_ws(" ", F.concat(F.lit("X"), "inst"), F.array_join("nets", " "), "model").alias("line"),
    )
    # Global nodes are supplies: a handful per netlist.
    tops = globals_.groupBy("netlist").agg(F.array_sort(F.collect_set("node")).alias("nodes")).select(
        "netlist", F.lit(0).alias("part"), F.lit(0).cast("long").alias("def_no"), F.lit(0).cast("long").alias("line_no"),
        F.concat(F.lit(".global "), F.array_join("nodes", " ")).alias("line"),
    )
    return tops.union(heads).union(body)


def write_netlists(rendered: DataFrame, path: str) -> None:
    """Rendered lines as text files, one folder per netlist, in order."""
    order = ["netlist", "part", "def_no", "line_no"]
    (
        rendered.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("netlist", "line").write.partitionBy("netlist").text(path)
    )
