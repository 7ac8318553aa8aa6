"""Directory roll-ups, hot paths and the call graph.

A tree is a flat table keyed by folder path; '' is the root. Prefix joins are written as equi-joins on each path's few
ancestors, suffix joins as equi-joins on the last name segment with the exact predicate beside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.stats import components_once, prefixes

MAX_EXPORTS = 5


def folders(path: Column) -> Column:
    """The root and every ancestor folder of a file path."""
    return F.concat(F.array(F.lit("")), prefixes(path))


def directory_rollup(components: DataFrame, focus: str = "") -> DataFrame:
    """(path, depth, components, own_components, files): each folder with what lies under it at any depth. With a focus
    only folders whose path begins with it stay, at a slash or not, as the contract has it. Counts are combined per file
    before ancestors are exploded."""
    c = components_once(components).filter("file is not null")
    per_file = c.groupBy("file").agg(F.count("*").alias("n"))
    x = per_file.withColumn("path", F.explode(folders(F.col("file"))))
    own = F.col("path") == F.regexp_replace(F.regexp_extract("file", r"^(.*/)?[^/]*$", 1), "/$", "")
    x = x.groupBy("path").agg(F.sum("n").alias("components"), F.sum(F.when(own, F.col("n")).otherwise(0)).alias("own_components"), F.count("*").alias("files"))
    x = x.withColumn("depth", F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/"))))
    return x.filter(F.col("path").startswith(focus)) if focus else x


def prune_to_depth(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.filter(F.col("depth") <= depth)


def smart_prune(nodes: DataFrame, max_depth: int, threshold: int) -> DataFrame:
    """Folders all of whose ancestors expand: an ancestor expands if its depth is below 2 or it holds at least `threshold`
    components; nothing lies deeper than `max_depth`."""
    opens = nodes.select(F.col("path").alias("up"), ((F.col("depth") < 2) | (F.col("components") >= threshold)).alias("opens"))
    kept = nodes.filter(F.col("depth") <= max_depth)
    up = kept.select("path", F.explode(folders(F.col("path"))).alias("up")).filter("up <> path")
    closed = up.join(opens.filter("not opens"), "up").select("path").distinct()
    return kept.join(closed, "path", "left_anti")


def directory_exports(components: DataFrame, limit: int = MAX_EXPORTS) -> DataFrame:
    """(path, exports): the first exported names of each folder's own files, by file and line."""
    c = components_once(components).filter("exported and name is not null and file is not null")
    c = c.withColumn("path", F.regexp_replace(F.regexp_extract("file", r"^(.*/)?[^/]*$", 1), "/$", ""))
    w = Window.partitionBy("path").orderBy("file", "start_line", "id")
    c = c.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= limit)
    return c.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("exports"))


def directory_activity(files: DataFrame, now) -> DataFrame:
    """(path, changed_30d, changed_90d, commits, last_change, class): activity of everything under each folder. A folder is
    hot with five or more files changed in 30 days, active with one, recent with one in 90."""
    day = lambda n: F.col("last_modified") >= F.lit(now) - F.make_dt_interval(F.lit(n))
    x = files.withColumn("path", F.explode(folders(F.col("file_path"))))
    x = x.groupBy("path").agg(
        F.count_if(day(30)).alias("changed_30d"), F.count_if(day(90)).alias("changed_90d"), F.sum("commit_count").alias("commits"), F.max("last_modified").alias("last_change")
    )
    kind = F.when(F.col("changed_30d") >= 5, "hot").when(F.col("changed_30d") >= 1, "active").when(F.col("changed_90d") >= 1, "recent").otherwise("quiet")
    return x.withColumn("class", kind)


def call_edges(components: DataFrame) -> DataFrame:
    """(caller_id, caller_file, caller_name, callee_name, callee_file, line): one row per call that a component makes."""
    c = components_once(components).select("id", "file", "name", F.explode("callees").alias("c"))
    return c.select(
        F.col("id").alias("caller_id"), F.col("file").alias("caller_file"), F.col("name").alias("caller_name"),
        F.col("c.name").alias("callee_name"), F.col("c.file").alias("callee_file"), F.col("c.line").alias("line"),
    )


def hot_paths(components: DataFrame, limit: int = 10) -> DataFrame:
    """Files most referred to by resolved calls, with the first component of each. Only counts are shuffled."""
    n = call_edges(components).filter("callee_file is not null").groupBy(F.col("callee_file").alias("file")).agg(F.count("*").alias("refs"))
    top = n.orderBy(F.desc("refs"), "file").limit(limit)
    first = components_once(components).groupBy("file").agg(F.min_by("name", F.struct("start_line", "id")).alias("component"))
    return top.join(first, "file", "left")


def last_segment(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def callers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, target, caller_id, line): calls whose callee is the target, ends in '.target', or is the target's own
    last part, for targets (id, name). An equi-join on the last segment; a hot name is left to the skew join of adaptive
    execution. The target itself isn't its caller; another component of its name may be."""
    t = targets.select(F.col("id").alias("target_id"), F.col("name").alias("target")).distinct().withColumn("_k", last_segment(F.col("target")))
    e = edges.filter("callee_name is not null").withColumn("_k", last_segment(F.col("callee_name")))
    hit = (F.col("callee_name") == F.col("target")) | F.col("callee_name").endswith(F.concat(F.lit("."), "target")) | F.col("target").endswith(F.concat(F.lit("."), "callee_name"))
    x = e.join(t, "_k").filter(hit & (F.col("caller_id") != F.col("target_id")))
    return x.groupBy("target_id", "target", "caller_id").agg(F.min("line").alias("line"))


def callees(components: DataFrame, names: DataFrame, limit: int = 20) -> DataFrame:
    """(id, callee_name, callee_file, line, position): the first calls of the components that are best matches of a name:
    those of that name, or else ending in '.name'."""
    n = names.select(F.col("name").alias("wanted")).distinct().withColumn("_k", last_segment(F.col("wanted")))
    c = components_once(components).withColumn("_k", last_segment(F.col("name")))
    x = c.join(n, "_k").filter((F.col("name") == F.col("wanted")) | F.col("name").endswith(F.concat(F.lit("."), "wanted")))
    best = x.groupBy("wanted").agg(F.min_by(F.struct("id", "callees"), F.struct((F.col("name") != F.col("wanted")), "id")).alias("b"))
    y = best.select("wanted", "b.id", F.posexplode(F.slice(F.coalesce("b.callees", F.array()), 1, limit)).alias("position", "c"))
    return y.select("wanted", "id", "position", F.col("c.name").alias("callee_name"), F.col("c.file").alias("callee_file"), F.col("c.line").alias("line"))


def import_counts(components: DataFrame) -> DataFrame:
    """(import, files): in how many files each module is imported, relative imports left out."""
    c = components_once(components).select("file", F.explode("imports").alias("module")).filter(~F.col("module").startswith("."))
    return c.distinct().groupBy("module").agg(F.count("*").alias("files"))


def ordered_tree(nodes: DataFrame) -> DataFrame:
    """(path, parent, position): every folder among its siblings by name, letters before case."""
    name = F.substring_index("path", "/", -1)
    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.lit(""))
    x = nodes.filter("path <> ''").select("path", parent.alias("parent"), name.alias("name"))
    w = Window.partitionBy("parent").orderBy(F.lower("name"), "name")  # the children of one folder
    return x.select("path", "parent", F.row_number().over(w).alias("position"))


def with_activity(nodes: DataFrame, activity: DataFrame) -> DataFrame:
    """The folders of a tree with the activity of what lies under them; 0 and null where nothing is known."""
    x = nodes.join(activity.select("path", "changed_30d", "changed_90d", "last_change"), "path", "left")
    return x.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("changed_30d", "changed_90d")})


def commit_activity(changes: DataFrame, now, most: int = 100) -> DataFrame:
    """(path, changed_30d, changed_90d, last_change): commits that touched a file under each folder, counted over the
    newest `most` of them within 90 days. changes: (commit, path, ts). A commit counts once a folder."""
    x = changes.filter("path is not null and ts is not null").withColumn("folder", F.explode(folders(F.col("path"))))
    near = F.col("ts") >= F.lit(now) - F.make_dt_interval(F.lit(90))
    x = x.filter(near & (F.col("ts") <= F.lit(now))).groupBy(F.col("folder").alias("path"), "commit").agg(F.max("ts").alias("ts"))
    w = Window.partitionBy("path").orderBy(F.desc("ts"), "commit")
    x = x.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)
    month = F.col("ts") >= F.lit(now) - F.make_dt_interval(F.lit(30))
    return x.groupBy("path").agg(F.count_if(month).alias("changed_30d"), F.count("*").alias("changed_90d"), F.max("ts").alias("last_change"))
