"""Assemblies: the reference graph, dense ids, project statistics and federation.

Edges: from_assembly, to_assembly.  Assemblies: pos, assembly_name, project_path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symdex.functions.text import fold_case

from .numbering import dense

MOST = 100
# Assemblies that stand for lists of names.
LOOSE = ("MSBuildFiles", "TypeScriptFiles")
PSEUDO = ("MSBuildProperties", "MSBuildItems", "MSBuildTargets", "MSBuildTasks", "GuidAssembly")


def known_edges(edges: DataFrame, assemblies: DataFrame) -> DataFrame:
    """Edges to assemblies that are indexed, as (assembly, referenced_by)."""
    known = assemblies.select(F.col("pos").alias("to_assembly"))
    return edges.join(known, "to_assembly").select(F.col("to_assembly").alias("assembly"), F.col("from_assembly").alias("referenced_by"))


def referencing_count(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("to_assembly").alias("assembly")).agg(F.count("*").alias("n"))


def top_referenced(counts: DataFrame, assemblies: DataFrame, most: int = MOST) -> DataFrame:
    """The most referenced assemblies, ties by name."""
    named = counts.join(assemblies.select(F.col("pos").alias("assembly"), "assembly_name"), "assembly")
    return named.orderBy(F.desc("n"), fold_case(F.col("assembly_name")), "assembly").limit(most).select("assembly_name", "n")


def referencing_lists(edges: DataFrame) -> DataFrame:
    """(assembly, referrers) for assemblies with 1 to 99 of them; no longer list is ever built."""
    few = referencing_count(edges).where(F.col("n").between(1, MOST - 1)).select("assembly")
    own = edges.withColumnRenamed("to_assembly", "assembly").join(few, "assembly")
    return own.groupBy("assembly").agg(F.array_sort(F.collect_list("from_assembly")).alias("referrers"))


def normalize_ids(assemblies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assemblies with project_key, projects): projects are numbered in the order of their paths, -1 for none.

    Equal paths get separate numbers.
    """
    paths = assemblies.where(F.coalesce(F.col("project_path"), F.lit("")) != "")
    projects = dense(paths.select("pos", "project_path", fold_case(F.col("project_path")).alias("path_key")), ["path_key", "pos"], "project_key")
    keyed = assemblies.join(projects.select("pos", "project_key"), "pos", "left").withColumn("project_key", F.coalesce("project_key", F.lit(-1).cast("long")))
    return keyed, projects.select("project_key", "project_path")


def assembly_numbers(assemblies: DataFrame) -> DataFrame:
    """Each assembly's place in the sorted list."""
    return dense(assemblies.withColumn("key", fold_case(F.col("assembly_name"))), ["key", "assembly_name", "pos"], "assembly_number").drop("key")


def project_assembly(assemblies: DataFrame) -> DataFrame:
    """(project_path, assembly_name): the last assembly of a project wins."""
    return assemblies.where("project_path is not null").groupBy("project_path").agg(F.max_by("assembly_name", "pos").alias("assembly_name"))


def project_stats(documents: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Per project: documents, lines, characters, and the symbols, types and public types declared in it.

    documents: project, n_lines, n_chars.  declared: project, is_type, is_public; without it no such columns are made.
    """
    out = documents.groupBy("project").agg(F.count("*").alias("documents"), F.sum("n_lines").alias("lines"), F.sum("n_chars").alias("chars"))
    if declared is None:
        return out
    kinds = {"symbols": F.lit(True), "types": F.col("is_type"), "public_types": F.col("is_type") & F.col("is_public")}
    counts = declared.groupBy("project").agg(*(F.count_if(k).alias(name) for name, k in kinds.items()))
    return out.join(counts, "project", "left").fillna(0, list(kinds))


def aggregate_stats(stats: DataFrame) -> DataFrame:
    """One row: how many projects there are, and the totals of all that ``project_stats`` counts in them."""
    totals = [F.coalesce(F.sum(x), F.lit(0).cast("long")).alias(x) for x in ("documents", "lines", "chars", "symbols", "types", "public_types")]
    return stats.agg(F.count("*").alias("projects"), *totals)


def unique_file_names(types: DataFrame) -> DataFrame:
    """types with ``file``: the name, and from the second type of one folder and name on a running number behind it.  types: folder, name, seq."""
    from .numbering import within

    n = F.col("__n") - 1
    return within(types, ["folder", "name"], ["seq"], "__n").withColumn("file", F.when(n > 0, F.concat("name", n.cast("string"))).otherwise(F.col("name"))).drop("__n")


def loose_files(pages: DataFrame) -> DataFrame:
    """(project, name, path): files that belong to no project, from the pages below the folders of the pseudo-projects; path without ".html".

    pages: path, with backslashes, from the root of the index.
    """
    project = F.substring_index("path", "\\", 1)
    inside = F.substring(F.col("path"), F.length(project) + 2, F.length("path"))
    own = pages.where(project.isin(*LOOSE) & F.lower("path").endswith(".html") & (inside != "")).select(project.alias("project"), F.expr("substring(path, 1, length(path) - 5)").alias("path"))
    return own.select("project", F.substring_index("path", "\\", -1).alias("name"), "path")


def used_references(edges: DataFrame) -> DataFrame:
    """Distinct targets other than the assembly itself and the pseudo assemblies."""
    return edges.where((F.col("from_assembly") != F.col("to_assembly")) & ~F.col("to_assembly").cast("string").isin(*PSEUDO)).select("from_assembly", "to_assembly").distinct()


def sorted_references(references: DataFrame) -> DataFrame:
    """One name for each key, whatever its case, in order."""
    return references.groupBy(fold_case(F.col("name")).alias("key")).agg(F.min("name").alias("name")).orderBy("key")


def linked_references(references: DataFrame, assemblies: DataFrame, used: DataFrame, federation: DataFrame) -> DataFrame:
    """state of each reference: federated, then link if in the solution and used, else disabled."""
    a = assemblies.select(F.col("assembly_name").alias("name"), F.lit(True).alias("known"))
    u = used.select("name", F.lit(True).alias("is_used")).distinct()
    f = first_server(references.select("name").distinct(), federation)
    out = references.join(a, "name", "left").join(u, "name", "left").join(f, "name", "left")
    linked = F.coalesce(F.col("known"), F.lit(False)) & F.coalesce(F.col("is_used"), F.lit(False))
    return out.select("name", F.when(F.col("server") >= 0, "federated").when(linked, "link").otherwise("disabled").alias("state"))


def first_server(names: DataFrame, federation: DataFrame) -> DataFrame:
    """(name, server): the first server that has an assembly, -1 for none."""
    f = federation.groupBy("assembly_key").agg(F.min("server").alias("server"))
    return names.withColumn("assembly_key", fold_case("name")).join(f, "assembly_key", "left").select("name", F.coalesce("server", F.lit(-1)).alias("server"))


def external_references(references: DataFrame, listed: DataFrame, solution: DataFrame, federation: DataFrame) -> DataFrame:
    """References that no list, solution or server has; the last path of a name wins."""
    out = references
    for other in (listed, solution):
        out = out.join(other.select("name"), "name", "left_anti")
    out = out.join(federation.select(F.col("assembly_key").alias("k")), fold_case("name") == F.col("k"), "left_anti")
    return out.groupBy("name").agg(F.max_by("path", "seq").alias("path"))


def duplicates(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def first_wins(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def custom_order(assemblies: DataFrame, order: DataFrame) -> DataFrame:
    """Assemblies with n: listed ones by their place in the list, then the others by name, from 0."""
    o = order.select("assembly_name", "place")
    placed = assemblies.join(o, "assembly_name", "left").withColumn("unlisted", F.col("place").isNull())
    return dense(placed, ["unlisted", "place", "assembly_name", "pos"], "n").drop("unlisted")


def union_files(*files: DataFrame) -> DataFrame:
    """(file_key): files of several lists, each once whatever its case.  files: path."""
    keys = [f.select(fold_case(F.col("path")).alias("file_key")) for f in files]
    out = keys[0]
    for k in keys[1:]:
        out = out.unionByName(k)
    return out.distinct()


def pair_events(starts: DataFrame, commands: DataFrame) -> DataFrame:
    """Start events with the command events of the same target and project; of several commands of a pair each counts.

    starts: target, project and more; commands: target, project, command.  A start without a project or target has no pair.
    """
    return starts.join(commands.select("target", "project", "command"), ["target", "project"])


def match_server_path(paths: DataFrame, mappings: DataFrame) -> DataFrame:
    """(path, server_path): the first mapping whose key begins the path, whatever the case; none for build folders.

    mappings: place, key, value.  Each distinct path is cut to the lengths that keys have, of which there are no more than letters in the longest one, and its
    beginnings are joined with the keys, so the work doesn't grow with the number of mappings.
    """
    c = F.col
    rules = mappings.where("key is not null").groupBy(fold_case("key").alias("key")).agg(F.min(F.struct("place", "value")).alias("rule"))
    lengths = rules.agg(F.collect_set(F.length("key")).alias("lengths"))
    folded = paths.where("path is not null").select("path").distinct().withColumn("folded", fold_case("path")).where(~c("folded").contains("\\OBJ\\"))
    tried = folded.crossJoin(F.broadcast(lengths)).withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("path")))).select("path", "n", F.expr("substring(folded, 1, n)").alias("key"))
    first = tried.join(rules, "key").groupBy("path").agg(F.min(F.struct("rule.place", "rule.value", "n")).alias("x"))
    first = first.select(c("path").alias("p"), F.concat("x.value", F.expr("substring(path, x.n + 1)")).alias("server_path"))
    return paths.join(first, c("path") == c("p"), "left").select("path", "server_path")


def is_test_project(references: DataFrame, markers: tuple[str, ...]) -> DataFrame:
    """(project, is_test): whether a reference names a test framework."""
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.lower("name").endswith(m.lower())
    return references.groupBy("project").agg(F.bool_or(hit).alias("is_test"))
