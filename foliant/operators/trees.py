"""JSON of any depth as rows, and rows as JSON again (N10, N11): a level of all values at a time, so that depth costs rounds, not recursion.

A node is a row: the keys of its value, ``path`` (where it stands, as an array of positions), ``name`` (in an object, or null), ``shown`` (the path as text),
``kind`` (object, array or other) and ``json`` (of what is neither)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written

#: Names of the sides of a box, fields that a chunk gets where it has none, and the greatest number of a box in thousandths.
SIDES, DEFAULTS, MOST = ("left", "top", "right", "bottom"), {"parent_order": "null", "atomic_lines": "[]", "row": "null", "col": "null", "rowspan": "null", "colspan": "null"}, 1000
#: Fixed value: what is said of a box out of order.
OUT_OF_ORDER = " must have left < right and top < bottom"
#: Levels beyond which a value is refused.
DEEPEST = 100


def nodes(values: DataFrame, keys: list[str], column: str) -> DataFrame:
    """All nodes of a VARIANT column, level by level, each of which is written before the next one is made. Members of objects are in the order of their names, as VARIANT keeps them."""
    kind = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), "object").when(F.schema_of_variant(v).startswith("ARRAY"), "array").otherwise("other")
    level = values.where(F.col(column).isNotNull()).select(*keys, F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("name"), F.lit("$").alias("shown"), kind(F.col(column)).alias("kind"), F.col(column).alias("value"))
    found, depth = [level], 0
    while not (inner := level.where("kind <> 'other'")).isEmpty():
        depth += 1
        if depth > DEEPEST:
            raise ValueError(f"values are more than {DEEPEST} levels deep")
        named = F.map_entries(F.try_variant_get("value", "$", "map<string,variant>"))
        plain = F.transform(F.try_variant_get(F.col("value"), "$", "array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
        children = inner.select(*keys, "path", "shown", F.posexplode(F.when(F.col("kind") == "object", named).otherwise(plain)).alias("i", "child"))
        shown = F.concat("shown", F.when(F.col("child.key").isNotNull(), F.concat(F.lit("."), "child.key")).otherwise(F.concat(F.lit("["), F.col("i").cast("string"), F.lit("]"))))
        level = written(children.select(*keys, F.concat("path", F.array("i")).alias("path"), F.col("child.key").alias("name"), shown.alias("shown"), kind(F.col("child.value")).alias("kind"), F.col("child.value").alias("value")), "nodes")
        found.append(level)
    return reduce(DataFrame.unionByName, found).select(*keys, "path", "name", "shown", "kind", F.when(F.col("kind") == "other", F.to_json("value")).alias("json"))


def parent(path: Column | str = "path") -> Column:
    return F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))


def rebuilt(tree: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, json``: the values that nodes stand for, from the deepest level up. Members come in the order of their positions."""
    deepest = tree.agg(F.max(F.size("path"))).first()[0] or 0
    level = tree.where(F.size("path") == deepest)
    quoted = F.expr("if(name is null, null, substring(to_json(array(name)), 2, length(to_json(array(name))) - 2))")
    for depth in range(deepest, 0, -1):
        member = F.struct(F.element_at("path", -1).alias("i"), F.concat(F.coalesce(F.concat(quoted, F.lit(":")), F.lit("")), "json").alias("text"))
        inside = level.groupBy(*keys, parent().alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(member)), lambda m: m["text"]), ",").alias("inside"))
        above = tree.where(F.size("path") == depth - 1).join(inside, [*keys, "path"], "left")
        body = F.coalesce("inside", F.lit(""))
        level = above.withColumn("json", F.when(F.col("kind") == "object", F.concat(F.lit("{"), body, F.lit("}"))).when(F.col("kind") == "array", F.concat(F.lit("["), body, F.lit("]"))).otherwise(F.col("json"))).drop("inside")
    if not deepest:
        level = level.withColumn("json", F.when(F.col("kind") == "object", "{}").when(F.col("kind") == "array", "[]").otherwise(F.col("json")))
    return level.select(*keys, "json")


def _boxes(tree: DataFrame, keys: list[str]) -> DataFrame:
    """Objects with four numbers as sides: ``path`` and these."""
    sides = tree.where(F.col("name").isin(*SIDES) & (F.col("kind") == "other") & F.col("json").rlike(r"^-?[0-9]"))
    one = sides.groupBy(*keys, parent().alias("path")).agg(*[F.max(F.when(F.col("name") == s, F.col("json").cast("double"))).alias(s) for s in SIDES])
    return one.where(reduce(Column.__and__, [F.col(s).isNotNull() for s in SIDES]))


def geometry_errors(tree: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, error``: the first box, in the order of the text, whose sides are out of order."""
    bad = _boxes(tree, keys).where((F.col("left") >= F.col("right")) | (F.col("top") >= F.col("bottom")))
    at = bad.join(tree.select(*keys, "path", "shown"), [*keys, "path"])
    return at.groupBy(*keys).agg(F.concat(F.min_by("shown", "path"), F.lit(OUT_OF_ORDER)).alias("error"))


def normalized(tree: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes with boxes in thousandths made shares, at any depth, and with the fields that chunks of a draft lack.

    A box counts in thousandths if one of its numbers is over 1 and all are from 0 to 1000. A chunk is an object in the array ``chunks`` of the root; its Markdown is its
    text where it has none. Numbers become shares by a join on the box; values without boxes meet no row of it."""
    lowest, highest = F.least(*SIDES), F.greatest(*SIDES)
    wide = _boxes(tree, keys).where((highest > 1) & (lowest >= 0) & (highest <= MOST)).select(*keys, F.col("path").alias("of"), F.lit(True).alias("wide"))
    side = F.col("name").isin(*SIDES) & (F.col("kind") == "other")
    met = tree.withColumn("of", F.when(side, parent())).join(wide, [*keys, "of"], "left")
    shares = met.withColumn("json", F.when(F.col("wide"), (F.col("json").cast("double") / MOST).cast("string")).otherwise(F.col("json"))).select(*tree.columns)
    root = tree.where((F.size("path") == 1) & (F.col("name") == "chunks") & (F.col("kind") == "array")).select(*keys, F.col("path").alias("chunks"))
    chunk = tree.where((F.size("path") == 2) & (F.col("kind") == "object")).withColumn("chunks", parent()).join(root, [*keys, "chunks"]).select(*keys, "path", "shown")
    fields = tree.where(F.size("path") == 3).select(*keys, parent().alias("path"), "name", F.when(F.col("kind") == "other", F.col("json")).alias("json"))
    has = chunk.join(fields, [*keys, "path"], "left").groupBy(*keys, "path", "shown").agg(F.collect_set("name").alias("names"), F.max(F.when(F.col("name") == "text", F.col("json"))).alias("text"), F.count("name").alias("n"))
    given = [F.struct(F.lit("markdown").alias("name"), F.coalesce(F.when(F.col("text").startswith('"'), F.col("text")), F.concat(F.lit('"'), F.coalesce("text", F.lit("")), F.lit('"'))).alias("json"))]
    given += [F.struct(F.lit(k).alias("name"), F.lit(v).alias("json")) for k, v in DEFAULTS.items()]
    lacking = F.filter(F.array(*given), lambda g: ~F.array_contains("names", g["name"]))
    more = has.select(*keys, "path", "shown", "n", F.posexplode(lacking).alias("i", "g"))
    kind = F.when(F.col("g.json") == "[]", "array").otherwise("other")
    added = more.select(*keys, F.concat("path", F.array((F.col("n") + F.col("i")).cast("int"))).alias("path"), F.col("g.name").alias("name"), F.concat("shown", F.lit("."), "g.name").alias("shown"), kind.alias("kind"), F.when(kind == "other", F.col("g.json")).alias("json"))
    return shares.unionByName(added)
