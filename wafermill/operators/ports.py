"""Port tables: ``(component, port_id, name, cx, cy, width, orientation)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wafermill.functions.columns import strip
from wafermill.plans.attach import attach, null_safe_join
from wafermill.plans.ranks import range_rank
from wafermill.session import cut_lineage

# Direction words by first letter, west to south as 1 to 4.
DIRECTIONS = {1: ["l", "w", "1"], 2: ["u", "n", "2"], 3: ["r", "e", "3"], 4: ["d", "s", "4"]}
EDGE_NAMES = ["e1", "e2", "e3", "e4"]


def port_tree(ports: DataFrame) -> DataFrame:
    """Every prefix of a ``_`` separated name as an edge parent -> child path."""
    parts = F.split("name", "_", -1)
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "_"))
    step = ports.select("component", F.posexplode(paths).alias("depth", "path"), parts.alias("parts"))
    return step.select(
        "component",
        "depth",
        F.when(F.col("depth") > 0, F.array_join(F.slice("parts", 1, F.col("depth")), "_")).otherwise("").alias("parent"),
        F.element_at("parts", F.col("depth") + 1).alias("child"),
        "path",
    ).distinct()


def port_ls(tree: DataFrame, path: str = "") -> DataFrame:
    """Children of ``path`` in each component; ``known`` is false where it does not exist."""
    here = F.col("parent") == path
    listed = tree.groupBy("component").agg(
        F.bool_or(F.lit(path == "") | (F.col("path") == path)).alias("known"),
    )
    children = tree.where(here).select("component", "child").distinct()
    return null_safe_join(listed, children, ["component"], "left")


def compass(angle: Column) -> Column:
    """E, N, W or S of an angle in degrees; null counts as 0."""
    a = F.round(F.pmod(F.coalesce(angle, F.lit(0)).cast("double"), F.lit(360.0)))
    return F.when((a <= 45) | (a >= 315), "E").when(a <= 135, "N").when(a <= 225, "W").otherwise("S")


def rename_by_orientation(ports: DataFrame) -> DataFrame:
    """Replace the last part of each name by the letter of its direction.

    The names e1..e4 become the bare letter. A name without an underscore is an error.
    """
    letter = compass(F.col("orientation"))
    name = F.col("name")
    wrong = F.raise_error(F.concat(F.lit("port name must contain an underscore: "), name)).cast("string")
    renamed = (
        F.when(name.isin(EDGE_NAMES), letter)
        .when(F.contains(name, F.lit("_")), F.concat(F.regexp_extract(name, r"^(.*_)[^_]*$", 1), letter))
        .otherwise(wrong)
    )
    return ports.withColumn("name", renamed)


def append_orientation(ports: DataFrame) -> DataFrame:
    """Append ``_`` and the letter where the angle is exactly 0, 90, 180 or 270."""
    angle = F.col("orientation")
    letter = F.when(angle == 0, "E").when(angle == 90, "N").when(angle == 180, "W").when(angle == 270, "S")
    return ports.withColumn("name", F.coalesce(F.concat("name", F.lit("_"), letter), "name"))


def rename_by_list(ports: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The first keyword contained in a name gives the new name, numbered from the second hit.

    Hits are numbered per component and keyword in port order by a range sort, so a
    component with a third of all ports is numbered by many tasks.
    """
    hit = F.lit(None).cast("int")
    for i, (keyword, _) in reversed(list(enumerate(pairs))):
        hit = F.when(F.contains("name", F.lit(keyword)), F.lit(i)).otherwise(hit)
    marked = ports.withColumn("_hit", hit)
    names = F.array(*[F.lit(new) for _, new in pairs])
    renamed = range_rank(marked.where("_hit IS NOT NULL"), ["component", "_hit"], [F.col("port_id").asc()], "_nth")
    suffix = F.when(F.col("_nth") == 1, "").otherwise((F.col("_nth") - 1).cast("string"))
    renamed = renamed.withColumn("name", F.concat(F.element_at(names, F.col("_hit") + 1), suffix)).drop("_nth")
    return renamed.select(*marked.columns).union(marked.where("_hit IS NULL")).drop("_hit")


def replace_prefix(ports: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """For each (old, new) in order, names that start with old get new once.

    Later pairs see earlier results. Of two ports with one name the later port stays.
    """
    name = F.col("name")
    for old, new in pairs:
        name = F.when(name.startswith(old), F.concat(F.lit(new), F.substr(name, F.lit(len(old) + 1)))).otherwise(name)
    rest = [c for c in ports.columns if c not in ("component", "name")]
    return (
        ports.withColumn("name", name)
        .groupBy("component", "name")
        .agg(F.max_by(F.struct(*rest), "port_id").alias("_p"))
        .select("component", "name", "_p.*")
    )


def drop_prefix(ports: DataFrame, prefix: str) -> DataFrame:
    """Ports whose name does not start with ``prefix``."""
    return ports.where(~F.col("name").startswith(prefix))


def private_copies(ports: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """All ports plus ``_private`` copies of those under any of the paths (default all)."""
    under = F.lit(True)
    if paths is not None:
        under = F.lit(False)
        for p in paths:
            under = under | F.col("name").startswith(p)
    names = F.when(under, F.array("name", F.concat("name", F.lit("_private")))).otherwise(F.array("name"))
    return ports.withColumn("name", F.explode(names))


def direction_number(text: Column) -> Column:
    """1 = W, 2 = N, 3 = E, 4 = S by the first letter or digit; null when unknown."""
    first = F.left(F.lower(strip(text)), F.lit(1))
    number = F.lit(None).cast("int")
    for value, letters in DIRECTIONS.items():
        number = F.when(first.isin(letters), value).otherwise(number)
    return number


def signed_angle(angle: Column) -> Column:
    """Angle rounded (halves to even) and brought into (-180, 180]."""
    a = F.pmod(F.bround(angle.cast("double")), F.lit(360.0)).cast("int")
    return F.when(a > 180, a - 360).otherwise(a)


def letter_angle(text: Column) -> Column:
    """0, 90, 180 or 270 of a direction word by its first letter."""
    number = direction_number(text)
    return F.when(number == 1, 180).when(number == 2, 90).when(number == 3, 0).when(number == 4, 270)


def angle_letter(angle: Column) -> Column:
    """E, N, W or S of a whole angle by quarter turns."""
    turn = F.floor(F.pmod(angle.cast("int"), F.lit(360)) / 90).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in "ENWS"]), turn + 1)


def normalise_direction(df: DataFrame, text: str, angle: str) -> DataFrame:
    """Direction number and angle of a word, signed angle and letter of an angle."""
    return (
        df.withColumn("direction", direction_number(F.col(text)))
        .withColumn("word_angle", letter_angle(F.col(text)))
        .withColumn("signed_angle", signed_angle(F.col(angle)))
        .withColumn("letter", angle_letter(F.col(angle)))
    )


def parallel_inline_pairs(pairs: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Flags for given port pairs with a_/b_ columns cx, cy and orientation.

    Parallel: the same axis. Inline: parallel, and the coordinate across the axis equal
    within the tolerance.
    """
    a, b = F.abs(signed_angle(F.col("a_orientation"))), F.abs(signed_angle(F.col("b_orientation")))
    parallel = (a == b) | ((a == 180) & (b == 0)) | ((a == 0) & (b == 180))
    apart = F.when(a == 90, F.abs(F.col("a_cx") - F.col("b_cx"))).otherwise(F.abs(F.col("a_cy") - F.col("b_cy")))
    return pairs.withColumn("parallel", parallel).withColumn("inline", parallel & (apart <= tolerance))


#: Ports of a bucket that one task pairs; a fuller bucket is dealt to several.
PER_BUCKET = 2000


def find_inline_pairs(ports: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """All pairs of ports of a component that are parallel and inline within the tolerance.

    ``ports`` has (component, port_id, cx, cy, orientation); returns (component, a_id, b_id) with
    ``a_id < b_id`` and the signed ``angle`` of both without its sign. Ports off the four directions
    have no pairs (:func:`port_checks` names them), nor have those with a null place.

    A band join: the coordinate across the axis falls into buckets as wide as the tolerance, and a port
    meets the bucket of its own and the next one. The ports of a bucket with many (a long row of
    ports) are dealt to parts by their id, and the others are sent to every part.
    """
    width = F.lit(max(tolerance, 1e-9) * 1.001)
    angle = F.abs(signed_angle(F.col("orientation")))
    straight = F.pmod(F.bround(F.col("orientation").cast("double")), F.lit(90.0)) == 0
    across = F.when(angle == 90, F.col("cx")).otherwise(F.col("cy")).cast("double")
    rows = ports.where(straight).select(
        "component", "port_id", (angle == 90).alias("upright"), across.alias("at"), F.when(angle == 90, angle).otherwise(0).alias("angle")
    )
    rows = cut_lineage(rows.where("at IS NOT NULL").withColumn("bucket", F.floor(F.col("at") / width)))
    key = ["component", "upright", "bucket"]
    parts = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / PER_BUCKET).cast("int").alias("parts")).where("parts > 1")
    dealt = attach(rows, parts, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    there = dealt.select(*key, F.pmod(F.xxhash64("port_id"), F.col("parts")).alias("part"), F.col("port_id").alias("b_id"), F.col("at").alias("b_at"))
    # A pair is looked for in the bucket of either; from the lower bucket only, or by id in the same.
    here = rows.withColumn("_own", F.col("bucket")).withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)))
    here = attach(here, parts, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    met = null_safe_join(here.withColumn("part", F.col("part").cast("long")), there, [*key, "part"])
    near = ~(F.least("at", "b_at") < F.greatest("at", "b_at") - tolerance)
    once = (F.col("_own") < F.col("bucket")) | (F.col("port_id") < F.col("b_id"))
    return met.where(near & once).select(
        "component", F.least("port_id", "b_id").alias("a_id"), F.greatest("port_id", "b_id").alias("b_id"), "angle"
    )


def port_checks(ports: DataFrame) -> DataFrame:
    """Ports off the four directions, and ports stored under another name than their own."""
    kinds = F.array_compact(
        F.array(
            F.when(F.pmod(F.bround(F.col("orientation").cast("double")), F.lit(90.0)) != 0, "not manhattan"),
            F.when(F.col("key") != F.col("name"), "key differs from name"),
        )
    )
    return ports.select("component", "port_id", F.explode(kinds).alias("problem"))


def perpendicular_checks(pairs: DataFrame) -> DataFrame:
    """Given pairs whose directions do not differ by 90 or 270 degrees."""
    turn = F.abs(F.bround(F.col("a_orientation").cast("double")) - F.bround(F.col("b_orientation").cast("double")))
    return pairs.where(~turn.isin(90.0, 270.0)).withColumn("problem", F.lit("not perpendicular"))


def device_pin(name: Column) -> Column:
    """``device_pin`` from the parts of a port name; of several the last one counts."""
    parts = F.split(name, "_", -1)

    def last(wanted: list[str]) -> Column:
        return F.coalesce(F.try_element_at(F.filter(parts, lambda p: p.isin(wanted)), F.lit(-1)), F.lit(""))

    return F.concat(last(["A", "B"]), F.lit("_"), last(["source", "drain", "gate"]))


def route_matches(pairs: DataFrame, name1: str, name2: str, pin1: str, pin2: str) -> DataFrame:
    """Flag pairs that join the two wanted pins in either order."""
    a, b = device_pin(F.col(name1)), device_pin(F.col(name2))
    either = ((a == pin1) & (b == pin2)) | ((b == pin1) & (a == pin2))
    return pairs.withColumn("pin_a", a).withColumn("pin_b", b).withColumn("matches", either)
