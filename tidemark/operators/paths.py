"""Trees of path components: interning, assembly by pointer doubling, lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import schemas
from tidemark.functions.text import joined, normal_path
from tidemark.operators.numbering import numbered
from tidemark.sources.shared import written


def prefixes(path: Column) -> Column:
    """All prefixes of a normal path, shortest first."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: joined(F.slice(parts, F.lit(1), n)))).otherwise(F.array().cast("array<string>"))


def tree_of(paths: DataFrame) -> DataFrame:
    """One node (id, parent_id, name, path) per distinct prefix.

    An id is a hash of the path, so that tasks number nodes without meeting.
    """
    nodes = paths.select(F.explode(prefixes(normal_path(F.col("path")))).alias("path")).distinct()
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return nodes.select(
        F.xxhash64("path").alias("id"),
        F.when(parent != "", F.xxhash64(parent)).alias("parent_id"),
        F.substring_index("path", "/", -1).alias("name"),
        "path",
    )


def intern(names: DataFrame, name: str = "name") -> DataFrame:
    """One (id, name) per distinct name, numbered in the order of the names."""
    distinct = names.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct()
    return numbered(distinct, F.col("name"), "id").select(F.col("id").cast("long").alias("id"), "name")


def interned(known: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """The (id, name) rows that ``names`` adds to a dictionary ``known``; old ids stay as they are.

    Names that are not known yet are numbered on from the greatest id, in their
    own order, by ranges. Null is no name; an empty dictionary starts at 1.
    """
    fresh = names.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct().join(known.select("name"), "name", "left_anti")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return numbered(fresh, F.col("name"), "id").select((F.col("id") + top).cast("long").alias("id"), "name")


def intern_into(path: str, names: DataFrame, batch: int, name: str = "name") -> DataFrame:
    """The dictionary in the folder ``path`` after a batch of names: all its (id, name) rows.

    Every batch adds a part under its own number and reads only those before it,
    so a batch that runs twice writes the same part again. Batches come one at a
    time, in the order of their numbers, 0 first.
    """
    spark, schema = names.sparkSession, "id long, name string, batch int"
    spark.createDataFrame([], schema).write.partitionBy("batch").mode("append").parquet(path)
    parts = spark.read.schema(schema).parquet(path)
    added = interned(parts.where(F.col("batch") < batch).select("id", "name"), names, name)
    added.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return spark.read.schema(schema).parquet(path).where(F.col("batch") <= batch).select("id", "name")


#: Up to so many wanted ids are walked up, level by level.
FEW = 10_000


def _walked_up(files: DataFrame, wanted: list[int], depth: int) -> DataFrame:
    """(id, path) of at most ``FEW`` ids: each level asks the tree for the ids not met yet, by one filter that reaches its scan.

    A level asks for no more ids than are wanted, and what comes back is one row
    an id, so the driver holds at most ``FEW`` rows a level.
    """
    nodes, met = files.select("id", "parent_id", "name"), {}
    ask = set(wanted)
    for _ in range(depth):
        if not ask:
            break
        rows = nodes.where(F.col("id").isin(sorted(ask))).collect()
        met |= {r["id"]: (r["parent_id"], r["name"]) for r in rows}
        ask = {r["parent_id"] for r in rows} - met.keys() - {None}
    paths = []
    for id_ in set(wanted):
        parts, at = [], id_
        while at in met and len(parts) < depth:
            at, name = met[at]
            parts.append(name)
        paths.append((id_, parts[::-1]))
    told = files.sparkSession.createDataFrame(paths, "id long, parts array<string>")
    return told.select("id", F.when(F.size("parts") > 0, joined(F.col("parts"))).otherwise("").alias("path"))


def lookup(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, id) of each distinct path of ``wanted``, found from the root down.

    Every distinct prefix of the wanted paths is looked up once, at its own level,
    under the id that its parent was found by: a level joins its prefixes alone,
    and what lies under a missing one is not looked for. A path whose components
    are not all in ``files`` (id, parent_id, name), that has none, or more than the
    deepest allowed, has a null id.
    """
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    rows = written(wanted.select("path").distinct().select("path", parts.alias("parts")), "lookup")
    fit = rows.where((F.size("parts") > 0) & (F.size("parts") <= schemas.MAX_DEPTH))
    each = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.struct(n.alias("level"), F.slice("parts", F.lit(1), n).alias("prefix")))
    steps = written(fit.select(F.explode(each).alias("s")).select("s.*").distinct(), "prefixes")
    levels = steps.agg(F.max("level")).first()[0] or 0
    nodes = files.select(F.col("parent_id").alias("_up"), F.col("name").alias("_name"), F.col("id").alias("_id"))
    above = files.sparkSession.createDataFrame([([], None)], "prefix array<string>, id long")
    found = []
    for level in range(1, levels + 1):
        here = steps.where(F.col("level") == level).select("prefix", F.slice("prefix", 1, level - 1).alias("_over"), F.get("prefix", F.lit(level - 1)).alias("_last"))
        under = here.join(above.select(F.col("prefix").alias("_over"), F.col("id").alias("_at")), "_over")
        # Roots have no parent id; those of deeper levels are compared.
        top, same = level == 1, F.col("_last") == F.col("_name")
        met = under.join(nodes.where(F.col("_up").isNull() if top else F.col("_up").isNotNull()), same if top else same & (F.col("_at") == F.col("_up")))
        above = written(met.select("prefix", F.col("_id").alias("id")), "found")
        found.append(above)
    if not found:
        return rows.select("path", F.lit(None).cast("long").alias("id"))
    every = reduce(DataFrame.unionByName, found).withColumnRenamed("prefix", "parts")
    return rows.join(every, "parts", "left").select("path", "id")


def resolve(files: DataFrame, wanted: DataFrame | None = None, depth: int = schemas.MAX_DEPTH) -> DataFrame:
    """(id, path) of each node of ``files`` (id, parent_id, name), or of the ``wanted`` ids.

    Pointer doubling: each round joins every node's half-built suffix to that of
    its pointer, so ``depth`` components take log2(depth) joins. A missing
    parent ends the path; a cycle ends at ``depth`` components; a wanted id that
    is not in the tree has the empty path. Rounds end early once no pointer is
    left, and each is written to the shared folder. A few wanted ids (as many as
    a page has) are walked up instead, so that only their ancestors are carried.
    """
    if wanted is not None:
        wanted = written(wanted.select("id"), "wanted")
        few = wanted.limit(FEW + 1).collect()
        if len(few) <= FEW:
            paths = _walked_up(files, [r["id"] for r in few if r["id"] is not None], depth)
            return wanted.join(F.broadcast(paths), "id", "left").select("id", F.coalesce("path", F.lit("")).alias("path"))
    steps = files.select("id", F.col("parent_id").alias("up"), F.array("name").alias("parts"))
    reached = 1
    while reached < depth:
        above = steps.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("parts").alias("more"))
        grown = steps.join(above, "up", "left")
        steps = grown.select("id", F.col("next").alias("up"), F.concat(F.coalesce("more", F.array().cast("array<string>")), "parts").alias("parts"))
        steps = written(steps, "paths")
        reached *= 2
        if steps.where("up IS NOT NULL").isEmpty():
            break
    paths = steps.select("id", joined(F.col("parts")).alias("path"))
    if wanted is None:
        return paths
    return wanted.select("id").join(paths, "id", "left").select("id", F.coalesce("path", F.lit("")).alias("path"))


def missing_chain(paths: DataFrame, tree: DataFrame) -> DataFrame:
    """Nodes that must be added so that every ancestor of the paths exists."""
    return tree_of(paths).join(tree.select("path"), "path", "left_anti")


def owning_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """``paths`` with the longest root that holds each path by whole components.

    Every prefix of a distinct path is looked up in the roots by an equi-join, so
    the work grows with the depth of paths and not with the number of roots.
    Rows that repeat a path each get its root.
    """
    ups = paths.select("path").distinct().withColumn("_up", F.explode(F.concat(F.array(F.lit("/")), prefixes(F.col("path")))))
    found = ups.join(roots.select(F.col("root").alias("_up")).distinct(), "_up")
    best = found.groupBy("path").agg(F.max_by("_up", F.length("_up")).alias("root"))
    return paths.join(best, "path", "left").select(*paths.columns, "root")


def live_first(files: DataFrame, keys: tuple[str, ...] = ("parent_id", "name")) -> DataFrame:
    """Per key the live row, else the newest tombstone."""
    order = Window.partitionBy(*keys).orderBy(F.col("deleted_at").isNull().desc(), F.col("deleted_at").desc(), F.col("id"))
    return files.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def child_of(files: DataFrame, parent: int | None, name: str) -> DataFrame:
    """Rows under a parent by name; a null parent (a root) matches null."""
    return files.where(F.col("parent_id").eqNullSafe(F.lit(parent).cast("long")) & (F.col("name") == name))
