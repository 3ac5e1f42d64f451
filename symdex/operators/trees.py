"""Trees as relations: namespaces, folders, outlines, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symdex.functions.text import fold_case
from symdex.sources.storage import stored


#: Nodes below one from which it is found by a broadcast.
CROWD = 50_000


def prefixes(parts: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.slice(parts, F.lit(1), i))


def preorder(nodes: DataFrame, path: str = "path") -> DataFrame:
    """Adds place (from 0), depth and size to the nodes of a tree: their order from the top down, levels above, and nodes in their subtree.

    path: sort keys from the root to the node itself, one path for each node.  Arrays are ordered element by element and a shorter one comes first, which
    is the order of the tree, so places are dense numbers of sorted ranges; a node adds one to each node above it, itself included.
    """
    from .numbering import dense

    placed = dense(nodes.withColumn("depth", F.size(path)), [path], "place")  # written, so the nodes aren't made again for the sizes
    size = placed.select(F.explode(prefixes(F.col(path))).alias("__above")).groupBy("__above").agg(F.count("*").alias("size"))
    return placed.join(size, F.col(path) == F.col("__above")).drop("__above")


def _sort_key(kind: Column | str, name: Column) -> Column:
    """Key of a node among its siblings: by kind, then by name whatever its case."""
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, fold_case(name))


def namespace_tree(types: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(place, depth, size, title, type_id) of namespaces and types in the order of their tree.

    types: namespace, name, id, seq.  A type and a namespace of one name, whatever the case, are one node; the first that needs the node gives it its title, a
    type's with "{" before it, by which types come behind namespaces; the last type of a node is its type_id.
    """
    c = F.col
    parts = F.filter(F.split("namespace", r"\."), lambda p: p != "")
    whole = F.concat(parts, F.array("name"))
    each = types.select("id", "seq", F.posexplode(prefixes(whole)).alias("i", "names"), F.size(whole).alias("n"))
    last = F.element_at("names", -1)
    leaf = c("i") == c("n") - 1
    each = each.select(F.transform("names", fold_case).alias("key"), F.struct("seq", "i").alias("at"), F.when(leaf, F.concat(F.lit("{"), last)).otherwise(last).alias("title"), F.when(leaf, F.struct("seq", "id")).alias("type"))
    nodes = stored(each.groupBy("key").agg(F.min_by("title", "at").alias("title"), F.max("type").alias("type")), "nodes")
    own = nodes.select(c("key").alias("of"), fold_case(c("title")).alias("sort_key"), "title", "type")
    # A node has its own title at hand.  The few that very many nodes lie below are broadcast, as each of them would be one task's; the others are joined.
    above = nodes.select("key", F.posexplode(prefixes(F.slice("key", F.lit(1), F.size("key") - 1))).alias("i", "above"))
    many = above.groupBy("above").agg(F.count("*").alias("n")).where(c("n") > crowd)
    top = own.join(many, c("of") == c("above"), "left_semi").select("of", "sort_key")
    met = above.join(F.broadcast(top), c("above") == c("of"), "left")
    rest = met.where("of is null").select("key", "i", "above").join(own.select("of", "sort_key").hint("merge"), c("above") == c("of"))
    steps = met.where("of is not null").select("key", "i", "sort_key", F.lit(None).alias("node")).unionByName(rest.select("key", "i", "sort_key", F.lit(None).alias("node")))
    steps = steps.unionByName(own.select(c("of").alias("key"), (F.size("of") - 1).alias("i"), "sort_key", F.struct("title", "type").alias("node")))
    path = F.transform(F.array_sort(F.collect_list(F.struct("i", "sort_key"))), lambda s: s["sort_key"])
    paths = steps.groupBy("key").agg(path.alias("path"), F.max_by("node", "i").alias("node"))
    return preorder(paths.select("path", "node.*")).select("place", "depth", "size", "title", c("type.id").alias("type_id"))


def solution_explorer(projects: DataFrame, documents: DataFrame) -> DataFrame:
    """(place, depth, size, kind, name): one tree of solution folders, projects in them, and the folders and documents of each project.

    projects: project, folders (names from the root); documents: project, path (folders and the document's name).  Folders come before projects and documents, each
    by name whatever the case; folders whose names differ by case alone are one, with the smallest name.  Documents of unknown projects are left out.
    """
    c = F.col
    step = lambda kind, x: F.struct(_sort_key(kind, x).alias("key"), F.lit(kind).alias("kind"), x.alias("name"))
    own = projects.select("project", F.concat(F.transform("folders", lambda f: step("0", f)), F.array(step("1", c("project")))).alias("steps"))
    inside = F.concat(F.transform(F.slice("path", F.lit(1), F.size("path") - 1), lambda f: step("0", f)), F.array(step("2", F.element_at("path", -1))))
    below = documents.where(F.size("path") > 0).select("project", inside.alias("inside")).join(own, "project").select(F.concat("steps", "inside").alias("steps"))
    steps = own.select("steps").unionByName(below).select(F.explode(prefixes(c("steps"))).alias("steps"))
    last = F.element_at("steps", -1)
    # documents and projects keep their very names apart; folders are one whatever the case
    key = F.transform("steps", lambda s: F.when(s["kind"] == "0", s["key"]).otherwise(F.concat(s["key"], F.lit("\0"), s["name"])))
    nodes = steps.groupBy(key.alias("path")).agg(F.min(last["name"]).alias("name"), F.min(last["kind"]).alias("kind"))
    kind = F.when(c("kind") == "0", "folder").when(c("kind") == "1", "project").otherwise("document")
    return preorder(nodes).select("place", "depth", "size", kind.alias("kind"), "name")


def folder_tree(paths: DataFrame) -> DataFrame:
    """(folder, depth, files): every folder above a file, and how many files are right in it.  paths: path with backslashes."""
    parts = F.split("path", r"\\")
    above = F.slice(parts, F.lit(1), F.size(parts) - 1)
    rows = paths.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(above)), lambda i: F.struct(F.array_join(F.slice(above, F.lit(1), i), "\\").alias("folder"), i.alias("depth"), (i == F.size(above)).cast("int").alias("own")))).alias("x"))
    return rows.groupBy(F.col("x.folder").alias("folder"), F.col("x.depth").alias("depth")).agg(F.sum("x.own").alias("files"))


def sort_explorer(items: DataFrame) -> DataFrame:
    """(folder, place, name): items of each folder by name, whatever the case; rows stay flat, however many a folder has."""
    from .numbering import within

    return within(items.select("folder", "name").withColumn("key", fold_case("name")), ["folder"], ["key", "name"], "place").select("folder", "place", "name")


def document_outline(symbols: DataFrame) -> DataFrame:
    """(doc, place, id, glyph_depth) of declarations in the order of a document."""
    from .numbering import within

    own = symbols.where(F.length("id") == 16).select("doc", "position", "id", F.concat_ws(",", F.col("glyph").cast("string"), F.col("depth").cast("string")).alias("glyph_depth"))
    return within(own, ["doc"], ["position"], "place").select("doc", "place", "id", "glyph_depth")


def split_by_first_letter(ids: DataFrame) -> DataFrame:
    return ids.groupBy(F.substring("id", 1, 1).alias("letter")).agg(F.count("*").alias("n"))


def min_unique_prefix(strings: DataFrame) -> DataFrame:
    """n: the shortest prefix length that keeps all values apart, no longer than the first value; 0 if that is empty.

    strings: seq, value.  Only neighbours in sorted order can share the longest prefix; they meet by their numbers in that order, so
    no task gets more than its share, whatever the values begin with.
    """
    from .numbering import dense

    sorted_ = dense(strings.select("seq", "value"), ["value", "seq"], "n")
    before = sorted_.select((F.col("n") + 1).alias("n"), F.col("value").alias("before"))
    n = F.least(F.length("value"), F.length("before"))
    common = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda m, i: F.when((m == i - 1) & (i <= n) & (F.substring(F.col("value"), i, F.lit(1)) == F.substring(F.col("before"), i, F.lit(1))), i).otherwise(m))
    near = sorted_.join(before, "n", "left")
    all_ = near.agg(F.min_by("value", "seq").alias("first"), F.max(F.when(F.col("before").isNotNull(), common)).alias("m"), F.coalesce(F.bool_or(F.col("value") == F.col("before")), F.lit(False)).alias("same"))
    size = F.length("first")
    return all_.select(F.when(F.coalesce(size, F.lit(0)) == 0, 0).when(F.col("same"), size).otherwise(F.least(F.coalesce("m", F.lit(0)) + 1, size)).cast("int").alias("n"))


def pair_frequency(strings: DataFrame) -> DataFrame:
    """(pair, n): character pairs at even offsets of ASCII strings; a last odd character pairs with an end mark."""
    from symdex.functions.text import is_ascii

    v = F.col("value")
    at = F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1)), F.lit(2))
    pairs = F.transform(at, lambda i: F.rpad(F.substring(v, i, F.lit(2)), 2, "\x7f"))
    return strings.where(is_ascii(v) & (F.length(v) > 0)).select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
