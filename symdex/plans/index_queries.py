"""The index as it is built and kept: versions, incremental facts, places in the sorted names, trees, chains of links, names of assemblies."""

from __future__ import annotations

from pyspark.sql import functions as F

from symdex.operators import chains, graph, positions, references as rf, trees
from symdex.sources import buildfiles, legacy, snapshots, storage

from .binding import ASM, KEYED, REFS, SHORT, SYM, assemblies, dealt, fences, keyed_assemblies, long, query, references, symbols, table

c = F.col


# --- places of prefix ranges


_ASKED = "qs AS (SELECT DISTINCT word FROM (SELECT lower(substring(name, 1, 1 + CAST(key AS INT) % 7)) AS word FROM sym UNION ALL SELECT concat(substring(name, 1, 3), '~') FROM sym UNION ALL SELECT name FROM sym UNION ALL SELECT ''))"


@query("prefix_bounds", f"WITH {SYM}, {_ASKED}, ks AS (SELECT upper(name) AS k, count(*) AS n FROM sym GROUP BY 1), ev AS (SELECT word, upper(word) AS k, 0 AS kind, 0 AS n FROM qs UNION ALL SELECT word, concat(upper(word), chr(1114111)), 1, 0 FROM qs UNION ALL SELECT NULL, k, 2, n FROM ks), ps AS (SELECT word, kind, CAST(coalesce(sum(n) OVER (ORDER BY k, kind, word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM ev) SELECT word, max(CASE WHEN kind = 0 THEN before END) AS low, max(CASE WHEN kind = 1 THEN before END) - 1 AS high FROM ps WHERE kind < 2 GROUP BY word")
def prefix_bounds(spark, d):
    """Ranges of the beginnings of all names, of beginnings that no name has, of all whole names, and of nothing."""
    s = symbols(spark, d)
    n = (c("key") % 7 + 1).cast("int")
    words = s.select(F.explode(F.array(F.lower(F.substring("name", F.lit(1), n)), F.concat(F.substring("name", 1, 3), F.lit("~")), c("name"), F.lit(""))).alias("word"))
    return positions.bounds(s, words)


_ROWS = "(SELECT 'red' AS word UNION ALL SELECT 'SMALL' UNION ALL SELECT 'coldx' UNION ALL SELECT '')"


@query("prefix_positions", f"WITH {SYM}, b AS (SELECT word, (SELECT count(*) FROM sym WHERE upper(name) < upper(word)) AS low, (SELECT count(*) FROM sym WHERE starts_with(upper(name), upper(word))) AS n FROM {_ROWS}) SELECT word, low, low + n - 1 AS high, key, pos FROM b LEFT JOIN sym ON pos BETWEEN low AND low + n - 1")
def prefix_positions(spark, d):
    """Ranges of a few words from the fences, and the rows at these places."""
    s, fence = symbols(spark, d), fences(spark, d)
    out = None
    for word in ("red", "SMALL", "coldx", ""):
        low, high = positions.bounds_of(s, fence, word)
        one = spark.range(1).select(F.lit(word).alias("word"), F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high"))
        one = one.join(positions.slice_of(s, low, high).select("key", "pos"), F.lit(True), "left")
        out = one if out is None else out.unionByName(one)
    return out


# --- versions and incremental facts


_KINDS = ("guids", "properties", "items", "targets", "tasks")


def _relations(spark, d):
    """Everything that a server loads, in the order it does."""
    keyed, projects = graph.normalize_ids(assemblies(spark, d))
    p = table(spark, d, "part")
    names = p.select((c("p_partkey") % 5).alias("k"), c("p_name").alias("name")).distinct()
    of = {"projects": projects.select(long("project_key").alias("pos"), c("project_path").alias("name")), "assemblies": keyed.select(long("pos").alias("pos"), c("assembly_name").alias("name")), "symbols": symbols(spark, d).select("pos", "name")}
    return of | {kind: names.where(c("k") == i).select(F.lit(0).cast("long").alias("pos"), "name") for i, kind in enumerate(_KINDS)}


_LOADED = [("projects", "SELECT project_key AS pos, project_path AS name FROM proj"), ("assemblies", "SELECT pos, assembly_name AS name FROM asm"), ("symbols", "SELECT pos, name FROM sym"), *((k, f"SELECT DISTINCT 0 AS pos, p_name AS name FROM part WHERE p_partkey % 5 = {i}") for i, k in enumerate(_KINDS))]


@query("load_index", f"WITH {KEYED}, {SYM} " + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS place, '{name}' AS relation, CAST(pos AS BIGINT) AS pos, name FROM ({sql})" for i, (name, sql) in enumerate(_LOADED)))
def load_index(spark, d):
    """A version with half of the relations, then one with all; a reader gets all relations of the last."""
    root = storage.fresh(spark, "index")
    relations = _relations(spark, d)
    snapshots.publish(spark, root, {k: relations[k] for k in list(relations)[:2]})
    snapshots.publish(spark, root, relations)
    snapshots.retire(spark, root, keep=1)
    out = None
    for i, (name, df) in enumerate(snapshots.load(spark, root).items()):
        one = df.select(F.lit(i).cast("long").alias("place"), F.lit(name).alias("relation"), "pos", "name")
        out = one if out is None else out.unionByName(one)
    return out


@query("sink_references", f"WITH {REFS} SELECT to_id % 16 AS to_assembly, from_assembly % 9 AS project, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines, CAST(sum(seq % 1009) AS BIGINT) AS seqs FROM refs GROUP BY ALL")
def sink_references(spark, d):
    """Three runs over parts of the projects, one of them over projects that had other facts before, then the table by target."""
    kept, path = storage.fresh(spark, "facts"), storage.fresh(spark, "references")
    refs = references(spark, d).drop("l_shipdate").withColumns({"to_assembly": c("to_id") % 16, "from_assembly": c("from_assembly") % 9})
    legacy.append_references(refs.where("from_assembly < 6 and line < 4"), kept)
    legacy.append_references(refs.where("from_assembly >= 6"), kept)
    legacy.append_references(refs.where("from_assembly < 6"), kept)
    legacy.write_references(spark.read.parquet(kept), path)
    back = spark.read.parquet(path)
    return back.groupBy(long("to_assembly").alias("to_assembly"), c("from_assembly").alias("project")).agg(F.count("*").alias("n"), long(F.sum("line")).alias("lines"), F.sum(c("seq") % 1009).alias("seqs"))


# --- chains of links


_PARENT = """par AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 40 = 1 THEN NULL WHEN p_partkey % 97 = 0 THEN p_partkey + 1000000000 WHEN p_partkey % 103 = 8 THEN p_partkey + 1 ELSE p_partkey - 1 END AS parent, CASE WHEN p_partkey % 3 = 0 THEN 'namespace' ELSE 'class' END AS kind FROM part)"""


@query("symbol_depth", f"WITH RECURSIVE {_PARENT}, up AS (SELECT c.id, c.kind, p.id AS parent FROM par c LEFT JOIN par p ON c.parent = p.id), dp AS (SELECT id, kind, CAST(0 AS BIGINT) AS depth FROM up WHERE parent IS NULL UNION ALL SELECT up.id, up.kind, depth + CASE WHEN dp.kind = 'namespace' THEN 0 ELSE 1 END FROM up JOIN dp ON up.parent = dp.id) SELECT up.id, depth FROM up LEFT JOIN dp ON up.id = dp.id")
def symbol_depth(spark, d):
    """Parents 39 levels deep; some parents are unknown, and some symbols contain each other."""
    k = c("p_partkey")
    parent = F.when(k % 40 == 1, None).when(k % 97 == 0, k + 1000000000).when(k % 103 == 8, k + 1).otherwise(k - 1)
    return chains.symbol_depth(table(spark, d, "part").select(k.alias("id"), parent.alias("parent"), F.when(k % 3 == 0, "namespace").otherwise("class").alias("kind")))


_MOVES = "mv AS (SELECT p_partkey // 25 AS type, p_partkey % 25 AS a, (p_partkey + 1) % 25 AS b FROM part WHERE p_partkey % 7 <> 0 OR (p_partkey // 25) % 5 = 0)"


@query("resolve_symbol", f"WITH RECURSIVE {_MOVES}, el AS (SELECT m.type, m.a, m.b AS e FROM mv m LEFT JOIN mv n ON m.type = n.type AND m.b = n.a WHERE n.type IS NULL UNION ALL SELECT m.type, m.a, e FROM mv m JOIN el ON m.type = el.type AND m.b = el.a) SELECT l_orderkey AS o, l_linenumber AS l, l_partkey // 25 AS type, CASE WHEN mv.a IS NULL THEN l_partkey % 25 ELSE el.e END AS resolved FROM lineitem LEFT JOIN mv ON mv.type = l_partkey // 25 AND mv.a = l_partkey % 25 LEFT JOIN el ON el.type = mv.type AND el.a = mv.a")
def resolve_symbol(spark, d):
    """References to types that have been moved from assembly to assembly, up to 24 times, and in every fifth type round and round."""
    k = c("p_partkey")
    moves = table(spark, d, "part").where("p_partkey % 7 <> 0 or floor(p_partkey / 25) % 5 = 0").select(F.floor(k / 25).alias("type"), (k % 25).alias("assembly"), ((k + 1) % 25).alias("to_assembly"))
    refs = table(spark, d, "lineitem").select(c("l_orderkey").alias("o"), c("l_linenumber").alias("l"), F.floor(c("l_partkey") / 25).alias("type"), (c("l_partkey") % 25).alias("assembly"))
    return chains.forwarded(refs, moves).select("o", "l", "type", "resolved")


# --- trees


_TYPES = """ty AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 5 = 0 THEN concat(replace(p_brand, '#', '.'), '.', replace(p_name, ' ', '')) WHEN p_size % 2 = 0 THEN concat(lower(replace(p_brand, '#', '.')), '..Sub') ELSE replace(p_brand, '#', '.') END AS namespace, CASE WHEN p_partkey % 11 = 0 THEN lower(p_type) ELSE replace(p_name, ' ', '') END AS name, CAST(p_partkey AS VARCHAR) AS id FROM part),
st AS (SELECT seq, id, list_concat(list_filter(string_split(namespace, '.'), lambda p: p <> ''), [name]) AS w FROM ty), ns AS (SELECT seq, id, unnest(range(1, len(w) + 1)) AS i, w FROM st),
oc AS (SELECT seq, i, [upper(x) for x in w[1:i]] AS k, CASE WHEN i = len(w) THEN concat('{', w[i]) ELSE w[i] END AS title, CASE WHEN i = len(w) THEN id END AS id FROM ns),
nd AS (SELECT k, list(title ORDER BY seq, i)[1] AS title, list(id ORDER BY seq) FILTER (id IS NOT NULL) AS ids FROM oc GROUP BY k),
up AS (SELECT k, unnest(range(1, len(k) + 1)) AS i FROM nd), pt AS (SELECT up.k, list(upper(a.title) ORDER BY i) AS path FROM up JOIN nd a ON a.k = up.k[1:i] GROUP BY up.k),
sz AS (SELECT k[1:i] AS k, count(*) AS size FROM up GROUP BY 1)"""


@query("namespace_tree", f"WITH {_TYPES} SELECT row_number() OVER (ORDER BY path) - 1 AS place, CAST(len(path) AS BIGINT) AS depth, size, title, ids[-1] AS type_id FROM nd JOIN pt USING (k) JOIN sz USING (k)")
def namespace_tree(spark, d):
    """Some namespaces have the name of a type, and names differ in their case."""
    k, plain, brand = c("p_partkey"), F.replace(c("p_name"), F.lit(" "), F.lit("")), F.replace(c("p_brand"), F.lit("#"), F.lit("."))
    ns = F.when(k % 5 == 0, F.concat(brand, F.lit("."), plain)).when(c("p_size") % 2 == 0, F.concat(F.lower(brand), F.lit("..Sub"))).otherwise(brand)
    types = dealt(spark, d, "part", table(spark, d, "part"), "p_partkey", part=SHORT).select(ns.alias("namespace"), F.when(k % 11 == 0, F.lower("p_type")).otherwise(plain).alias("name"), k.cast("string").alias("id"), k.alias("seq"))
    return trees.namespace_tree(types).withColumn("depth", long("depth"))


_EXPLORER = f"""{ASM}, pr AS (SELECT assembly_name AS project, CASE WHEN project_path IS NULL THEN [] WHEN pos % 2 = 0 THEN [upper(split_part(project_path, chr(92), 1)), split_part(project_path, chr(92), 2)] ELSE [split_part(project_path, chr(92), 1), split_part(project_path, chr(92), 2)] END AS f FROM asm),
dc AS (SELECT concat('Supplier#', lpad(CAST(doc_id % 40 + 1 AS VARCHAR), 9, '0')) AS project, source, lang, CASE WHEN doc_id % 2 = 0 THEN concat('doc', doc_id) ELSE concat('DOC', doc_id) END AS doc FROM documents),
wy AS (SELECT list_concat([struct_pack(k := concat('0', upper(x)), t := '0', n := x) for x in f], [struct_pack(k := concat('1', upper(project), chr(1), project), t := '1', n := project)]) AS w, project FROM pr),
al AS (SELECT w FROM wy UNION ALL SELECT list_concat(w, [struct_pack(k := concat('0', upper(source)), t := '0', n := source), struct_pack(k := concat('0', upper(lang)), t := '0', n := lang), struct_pack(k := concat('2', upper(doc), chr(1), doc), t := '2', n := doc)]) FROM dc JOIN wy USING (project)),
ex AS (SELECT w[1:i] AS w FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM al)), nd AS (SELECT [x.k for x in w] AS path, min(w[-1].n) AS name, min(w[-1].t) AS t FROM ex GROUP BY 1),
sz AS (SELECT path[1:i] AS path, count(*) AS size FROM (SELECT path, unnest(range(1, len(path) + 1)) AS i FROM nd) GROUP BY 1)"""


@query("solution_explorer", f"WITH {_EXPLORER} SELECT row_number() OVER (ORDER BY path) - 1 AS place, CAST(len(path) AS BIGINT) AS depth, size, CASE t WHEN '0' THEN 'folder' WHEN '1' THEN 'project' ELSE 'document' END AS kind, name FROM nd JOIN sz USING (path)")
def solution_explorer(spark, d):
    """Regions and nations as solution folders, suppliers as projects, and the documents of forty of them by source and language."""
    part = lambda i: F.get(F.split("project_path", r"\\"), F.lit(i))
    folders = F.when(c("project_path").isNull(), F.array().cast("array<string>")).when(c("pos") % 2 == 0, F.array(F.upper(part(0)), part(1))).otherwise(F.array(part(0), part(1)))
    projects = assemblies(spark, d).select(c("assembly_name").alias("project"), folders.alias("folders"))
    k = c("doc_id")
    name = F.concat(F.when(k % 2 == 0, "doc").otherwise("DOC"), k.cast("string"))
    docs = table(spark, d, "documents").select(F.concat(F.lit("Supplier#"), F.lpad((k % 40 + 1).cast("string"), 9, "0")).alias("project"), F.array("source", "lang", name).alias("path"))
    return trees.solution_explorer(projects, docs).withColumn("depth", long("depth"))


# --- names of assemblies


@query("assembly_name_regex", "SELECT p_partkey AS k, CASE p_partkey % 8 WHEN 0 THEN replace(p_name, ' ', '.') WHEN 1 THEN replace(p_brand, '#', '.') WHEN 2 THEN p_name WHEN 3 THEN concat(p_brand, ' ', p_brand, '.', p_type) WHEN 4 THEN concat(p_type, p_partkey) WHEN 5 THEN concat('x', p_type, p_partkey) ELSE concat(p_type, p_partkey) END AS name, CASE p_partkey % 8 WHEN 0 THEN 'pattern' WHEN 1 THEN 'pattern' WHEN 2 THEN 'element' WHEN 3 THEN 'property' WHEN 5 THEN 'property' ELSE 'file' END AS way FROM part")
def assembly_name_regex(spark, d):
    """Each of the ways to a name; properties that are assigned twice, name each other, or are not there."""
    k = c("p_partkey")
    t = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    name, brand, kind = c("p_name"), c("p_brand"), c("p_type")
    old = '<Project xmlns="http://schemas.microsoft.com/developer/msbuild/2003"><PropertyGroup>'
    end = "</PropertyGroup></Project>"
    texts = (
        t(old, "<AssemblyName>", F.replace(name, F.lit(" "), F.lit(".")), "</AssemblyName>", end),
        t(old, "<RootNamespace>", F.replace(brand, F.lit("#"), F.lit(".")), "</RootNamespace><AssemblyName>$(RootNamespace)</AssemblyName>", end),
        t(old, "<AssemblyName Condition=\"'a'\">first one</AssemblyName></PropertyGroup><PropertyGroup Label=\"b\"><AssemblyName>", name, "</AssemblyName><!-- <AssemblyName>third one</AssemblyName> -->", end),
        t("<Project>\n<PropertyGroup>\n<Base>", brand, "</Base>\n<Kind>none</Kind><Kind>", kind, "</Kind>\n<AssemblyName Condition=\"c\">$(base) $(Base).$(KIND)</AssemblyName>\n<Base>later</Base>", end),
        t("<Project><PropertyGroup><A>$(B)</A><B>$(A)</B><AssemblyName Condition=\"c\">$(A)$(B)</AssemblyName>", end),
        t("<Project><PropertyGroup><AssemblyName Condition=\"c\">x$(MSBuildProjectName)</AssemblyName>", end),
        t("<Project Sdk=\"s\"/>"),
        t("MZ binary <AssemblyName>no</AssemblyName>"),
    )
    xml = F.get(F.array(*texts), (k % 8).cast("int"))
    path = t("c:\\src\\", brand, "/", kind, k.cast("string"), F.when(k % 8 == 7, ".DLL").otherwise(".csproj"))
    files = table(spark, d, "part").select(k.alias("k"), path.alias("file"), xml.alias("text"))
    found = buildfiles.assembly_names(files.select("file", "text"))
    return files.select("k", "file").join(found, "file").select("k", "name", "way")
