"""Build files, scripts, XML pages, addresses and codecs over the bound tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from symdex.functions import huffman as hf, routes as rt
from symdex.operators import frontends as fe
from symdex.sources import buildfiles

from .binding import SHORT, dealt, long, query, table

c = F.col


def _text(*parts: str | Column) -> Column:
    """Columns and, in quotes, plain texts one after the other."""
    return F.concat(*(F.lit(p[1:]) if isinstance(p, str) and p[:1] == "'" else p for p in parts))


def _part(spark, d):
    k = c("p_partkey")
    return table(spark, d, "part").select(k.alias("k"), k.cast("string").alias("n"), F.substring(F.md5(k.cast("string")), 1, 16).alias("id"), F.replace("p_brand", F.lit("#"), F.lit(".")).alias("brand"), "p_name", "p_type", "p_size")


_PART = "p AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS n, substring(md5(CAST(p_partkey AS VARCHAR)), 1, 16) AS id, replace(p_brand, '#', '.') AS brand, p_name, p_type, p_size FROM part)"


# --- addresses


@query(
    "route_hash",
    f"""WITH {_PART} SELECT k, CASE k % 14 WHEN 4 THEN concat('/', brand, '/a b', n, '.cs.html#l', n) WHEN 5 THEN concat('/', brand, '/f.vb.html#', id) WHEN 6 THEN concat('/', brand, '/f.cs.html#', id)
WHEN 9 THEN concat('/MSBuildFiles/x', n, '.targets.html#l3') WHEN 10 THEN concat('/', brand, '/f.cs.html#l7') END AS content,
CASE k % 14 WHEN 0 THEN concat('/MSBuildProperties/R/', p_name, '.html') WHEN 1 THEN concat('/MSBuildItems/R/', p_name, '.html') WHEN 2 THEN '/mscorlib/R/EmptyArrayAllocation.html'
WHEN 4 THEN concat('/', brand, '/ProjectExplorer.html') WHEN 5 THEN concat('/', brand, '/ProjectExplorer.html') WHEN 6 THEN concat('/', brand, '/R/', id, '.html') WHEN 7 THEN concat('/', brand, '/ProjectExplorer.html')
WHEN 8 THEN concat('/', brand, '/namespaces.html') WHEN 10 THEN concat('/', brand, '/ProjectExplorer.html') WHEN 11 THEN concat('/', brand, '/ProjectExplorer.html') WHEN 12 THEN concat('/', brand, '/namespaces.html') WHEN 13 THEN '/' END AS navigation,
CASE WHEN k % 14 = 3 THEN p_name END AS search FROM p""",
)
def route_hash(spark, d):
    forms = [
        _text("'MSBuildProperty=", c("p_name")), _text("'msbuilditem=", c("p_name")), _text("'emptyArrayAllocation"), _text("'q=", F.replace("p_name", F.lit(" "), F.lit("%20"))),
        _text(c("brand"), "'/a%20b", c("n"), "'.cs,", c("n")), _text(c("brand"), "'/f.vb,", c("id")), _text(c("brand"), "'/f.cs,", c("id"), "',references"), c("brand"),
        _text(c("brand"), "',namespaces"), _text("'MSBuildFiles/x", c("n"), "'.targets,3"), _text(c("brand"), "'/f.cs.html#7"), _text("'/", c("brand"), "'/"), _text(c("brand"), "'%2cnamespaces"), F.lit(""),
    ]
    anchors = _part(spark, d).select("k", F.get(F.array(*forms), (c("k") % 14).cast("int")).alias("anchor"))
    return rt.routes(anchors).select("k", "content", "navigation", "search")


@query(
    "client_url_helpers",
    f"WITH {_PART} SELECT k, concat(replace(p_name, ' ', '%20'), '/f(', n, ')%C3%A9%2Bx') AS file, concat('l', n) AS line, id AS symbol, concat(',', n) AS shown, CASE WHEN k % 2 = 0 THEN 'csproj' ELSE 'txt' END AS extension, k % 2 = 0 AS is_file, concat(n, ',b%2c') AS comma FROM p",
)
def client_url_helpers(spark, d):
    name = _text(c("p_name"), "'.x.", F.when(c("k") % 2 == 0, "CSPROJ").otherwise("txt"))
    return _part(spark, d).select(
        "k", rt.displayed_file(_text(c("p_name"), "'/f(", c("n"), "')é+x.HTML")).alias("file"), rt.safe_line(c("n")).alias("line"), rt.safe_line(c("id")).alias("symbol"),
        rt.displayed_line(_text("'#l", c("n"))).alias("shown"), rt.extension(name).alias("extension"), rt.is_file(_text(name, "'.html")).alias("is_file"), rt.decode_comma(_text(c("n"), "'%2cb%2c")).alias("comma"),
    )


# --- build files

# A build file; # stands for the part's number.
_XML = """<Project>
<PropertyGroup>
<P#>$(Root#.Length)x</P#>
<MyDependsOn>A#;$(B);C</MyDependsOn>
</PropertyGroup>
<ItemGroup>
<Compile Include='@(I#->x)'/>
<None Include='%(q)'/>
</ItemGroup>
<Target Name='T#' DependsOnTargets='X; Y#'>
<Message Text='t'/>
<CallTarget Targets='Z'/>
<Csc>
<Output ItemName='O#'/>
</Csc>
</Target>
<UsingTask TaskName='a.Task#' AssemblyFile='b\\Lib.dll'/>
"""


@query(
    "msbuild_refs",
    f"""WITH {_PART}, r(line, kind, a, numbered, to_assembly) AS (VALUES (3, 11, 'P', true, 'MSBuildProperties'), (3, 12, 'Root', true, 'MSBuildProperties'), (4, 11, 'MyDependsOn', false, 'MSBuildProperties'), (4, 16, 'A', true, 'MSBuildTargets'),
(4, 12, 'B', false, 'MSBuildProperties'), (4, 16, 'C', false, 'MSBuildTargets'), (7, 14, 'I', true, 'MSBuildItems'), (8, 13, 'None', false, 'MSBuildItems'), (10, 15, 'T', true, 'MSBuildTargets'), (10, 16, 'X', false, 'MSBuildTargets'),
(10, 16, 'Y', true, 'MSBuildTargets'), (11, 18, 'Message', false, 'MSBuildTasks'), (12, 18, 'CallTarget', false, 'MSBuildTasks'), (12, 16, 'Z', false, 'MSBuildTargets'), (13, 18, 'Csc', false, 'MSBuildTasks'), (14, 13, 'O', true, 'MSBuildItems'), (17, 17, 'Task', true, 'MSBuildTasks'))
SELECT n AS file, CAST(line AS BIGINT) AS line, CAST(kind AS BIGINT) AS kind, CASE WHEN numbered THEN concat(a, n) ELSE a END AS name, to_assembly FROM p, r
UNION ALL SELECT n, 17, 5, substring(md5(concat('T:a.Task', n)), 1, 16), 'Lib' FROM p""",
)
def msbuild_refs(spark, d):
    """Each part has a build file; the last element is left open, so the rest of a broken file doesn't matter."""
    files = dealt(spark, d, "part", _part(spark, d), "k", part=SHORT).select(c("n").alias("file"), F.replace(F.lit(_XML), F.lit("#"), c("n")).alias("text"))
    out = fe.build_references(buildfiles.xml_nodes(files))
    return out.select("file", "line", long("kind").alias("kind"), "name", "to_assembly")


@query("scan_sln", "SELECT p_partkey AS file, p_name AS name, concat(p_brand, chr(92), 'a.csproj') AS path, upper(md5(CAST(p_partkey AS VARCHAR))) AS id, 'FAE0' AS kind FROM part")
def scan_sln(spark, d):
    k = c("p_partkey")
    line = _text("'Project(\"{fae0}\") = \"", c("p_name"), "'\", \"", c("p_brand"), "'\\a.csproj\", \"{", F.md5(k.cast("string")), "'}\"")
    folder = _text("'Project(\"{2150}\") = \"", c("p_name"), "'\", \"", c("p_type"), "'\", \"{", F.md5(k.cast("string")), "'}\"")
    lines = table(spark, d, "part").select(k.alias("file"), F.explode(F.array(line, folder, F.lit("EndProject"), F.lit("Global"))).alias("value"))
    return buildfiles.scan_solution(lines)


@query("scan_slnx", "SELECT p_partkey AS file, concat('src/', p_name, '.csproj') AS path FROM part UNION ALL SELECT p_partkey, concat('test/', p_type, '.vbproj') FROM part WHERE p_partkey % 3 <> 0")
def scan_slnx(spark, d):
    """A solution in XML for each part, with a project in a folder and one outside; the dependencies of a project aren't projects."""
    k = c("p_partkey")
    xml = _text("'<Solution><Folder Name=\"/src/\"><Project Path=\"src/", c("p_name"), "'.csproj\"><BuildDependency Project=\"x\"/><Project Path=\"inner\"/></Project><File Path=\"a.txt\"/></Folder>", F.when(k % 3 != 0, _text("'<Project Path=\"test/", c("p_type"), "'.vbproj\"/>")).otherwise("<Project/>"), "'</Solution>")
    nodes = buildfiles.xml_nodes(dealt(spark, d, "part", table(spark, d, "part"), "p_partkey", part=SHORT).select(k.cast("string").alias("file"), xml.alias("text")))
    return buildfiles.scan_solution_xml(nodes).select(long("file").alias("file"), "path")


@query("scan_list_file", "SELECT concat(p_name, '.csproj') AS value FROM part WHERE p_partkey % 3 <> 0")
def scan_list_file(spark, d):
    v = _text(c("p_name"), "'.csproj")
    lines = table(spark, d, "part").select(F.when(c("p_partkey") % 3 == 0, " ").when(c("p_partkey") % 3 == 1, _text("' \"", v, "'\"")).otherwise(v).alias("value"))
    return buildfiles.scan_list(lines)


# --- scripts and XML


def _ranges(spark, d):
    """Parts as ranges of a script: a variable in every seventh, links to the part before it in the file."""
    p = _part(spark, d)
    kind = F.when(c("k") % 7 == 0, "variable").when(c("k") % 7 == 1, "class").when(c("k") % 7 == 2, "?")
    link = F.when(c("k") % 5 != 0, F.array(F.struct(_text("'s", (c("k") % 60).cast("string")).alias("symbol_id"), F.lit("f.ts").alias("source_file"))))
    return p.select(
        (c("k") % 4).alias("file"), c("k").alias("seq"), F.when(kind.isNotNull(), _text("'d", c("n"))).alias("definition_id"), kind.alias("definition_kind"), _text("'\"", F.substring("p_name", 1, 3), "'\"").alias("search_string"),
        _text(c("brand"), "';", c("p_name")).alias("full_name"), link.alias("hyperlinks"), F.lit("b<").alias("text"), c("p_size").cast("long").alias("line_number"), F.lit(4).alias("column"), F.lit("  a b<c ").alias("line_text"),
    )


@query("ts_decls", f"WITH {_PART} SELECT k % 4 AS file, k AS seq, substring(p_name, 1, 3) AS name, substring(md5(concat('d', n)), 1, 16) AS id, CASE k % 7 WHEN 1 THEN 'class' ELSE '?' END AS kind, concat(brand, ':', p_name) AS description, CAST(CASE k % 7 WHEN 1 THEN 0 ELSE 195 END AS BIGINT) AS glyph FROM p WHERE k % 7 IN (1, 2)")
def ts_decls(spark, d):
    return fe.script_declarations(_ranges(spark, d)).withColumn("glyph", long("glyph"))


@query("ts_refs", f"WITH {_PART} SELECT k % 4 AS file, k AS seq, substring(md5(concat('s', k % 60)), 1, 16) AS to_symbol, 'b<' AS to_name, CAST(p_size + 1 AS BIGINT) AS line, 'a b&lt;c' AS line_text, CAST(2 AS BIGINT) AS col_start, CAST(7 AS BIGINT) AS col_end FROM p WHERE k % 7 <> 0 AND k % 5 <> 0")
def ts_refs(spark, d):
    return fe.script_references(_ranges(spark, d)).select("file", "seq", "to_symbol", "to_name", "line", "line_text", long("col_start").alias("col_start"), long("col_end").alias("col_end"))


_MARKED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')"
_XML_ENTITY = "&(?:#[0-9]+|#x[0-9A-Fa-f]+|[A-Za-z_:][A-Za-z0-9._:-]*);"
_XML_OPENS = r"<(?:/?(?:[A-Za-z_:]|[^\x00-\x7F])|!)"
_XML_TOKEN = rf"""(?s)<!--.*?(?:-->|\z)|<!\[CDATA\[.*?(?:\]\]>|\z)|<\?.*?(?:\?>|\z)|{_XML_OPENS}(?:[^<>"'']|"[^<"]*"|''[^<'']*'')*>|{_XML_OPENS}[^<>]*>|{_XML_ENTITY}|[^<&]+|[<&]"""
_XML_IN_TAG = r"""=[ \t\r\n]*(?:"[^"]*"?|''[^'']*''?|[^ \t\r\n"''=]+)?|"[^"]*"?|''[^'']*''?|[ \t\r\n]+|[^ \t\r\n"''=]+"""
_XML_SQL = rf"""WITH p AS (SELECT page_id AS doc, coalesce(html, '') AS html FROM pages),
t AS (SELECT doc, unnest(range(len(m))) AS i, unnest(m) AS tok FROM (SELECT doc, regexp_extract_all(html, '{_XML_TOKEN}') AS m FROM p)),
k AS (SELECT *, length(tok) AS n, CASE WHEN tok LIKE '<!--%' THEN 'XmlComment' WHEN tok LIKE '<![CDATA[%' THEN 'XmlCDataSection' WHEN regexp_matches(tok, '^<\?xml(?:[ \t\r\n]|\?>)') THEN 'declaration'
  WHEN tok LIKE '<?%' THEN 'XmlProcessingInstruction' WHEN tok LIKE '<_%' THEN 'tag' WHEN tok LIKE '&_%' THEN 'XmlEntityReference' ELSE '' END AS kind FROM t),
o AS (SELECT *, CASE kind WHEN 'XmlComment' THEN '<!--' WHEN 'XmlCDataSection' THEN '<![CDATA[' WHEN 'tag' THEN regexp_extract(tok, '^<[/!]?') WHEN '' THEN '' WHEN 'XmlEntityReference' THEN '' ELSE '<?' END AS a,
  CASE WHEN kind IN ('tag', 'declaration', 'XmlProcessingInstruction') THEN regexp_extract(tok, '^<[/!?]?([^ \t\r\n/<>"''=?]*)', 1) ELSE '' END AS b FROM k),
q AS (SELECT *, substring(tok, length(a) + length(b) + 1) AS r FROM o),
z AS (SELECT *, CASE kind WHEN 'XmlComment' THEN regexp_extract(r, '-->$') WHEN 'XmlCDataSection' THEN regexp_extract(r, '\]\]>$') WHEN 'tag' THEN regexp_extract(r, '/?>$') WHEN '' THEN '' WHEN 'XmlEntityReference' THEN '' ELSE regexp_extract(r, '\?>$') END AS z FROM q),
d AS (SELECT doc, i, kind, a, b, substring(r, 1, length(r) - length(z)) AS body, z FROM z),
g AS (SELECT doc, i, unnest(range(len(m))) AS j, unnest(m) AS piece FROM (SELECT doc, i, regexp_extract_all(body, '{_XML_IN_TAG}') AS m FROM d WHERE kind IN ('tag', 'declaration'))),
h AS (SELECT *, regexp_extract(piece, '^=[ \t\r\n]*') AS e, regexp_matches(piece, '^[="'']') AS valued FROM g),
v AS (SELECT *, regexp_extract(substring(piece, length(e) + 1), '^["'']') AS q1, substring(piece, length(e) + 1) AS s FROM h WHERE valued),
f AS (SELECT *, CASE WHEN q1 <> '' AND length(s) > 1 AND right(s, 1) = q1 THEN q1 ELSE '' END AS q2 FROM v),
u AS (SELECT *, substring(s, length(q1) + 1, length(s) - length(q1) - length(q2)) AS s0 FROM f),
e AS (SELECT doc, i, j, unnest(range(len(s2))) AS y, unnest(s2) AS part, unnest(list_concat(s1, [''])) AS ref FROM (SELECT *, string_split_regex(s0, '{_XML_ENTITY}') AS s2, regexp_extract_all(s0, '{_XML_ENTITY}') AS s1 FROM u)),
x AS (SELECT doc, -1 AS i, 0 AS j, 0 AS y, '' AS s, NULL AS class FROM p
  UNION ALL SELECT doc, i, -2, 0, a, 'XmlDelimiter' FROM d UNION ALL SELECT doc, i, -1, 0, b, 'XmlName' FROM d UNION ALL SELECT doc, i, 0, 0, body, nullif(kind, '') FROM d WHERE kind NOT IN ('tag', 'declaration')
  UNION ALL SELECT doc, i, j, 0, piece, CASE WHEN regexp_matches(piece, '^[ \t\r\n]') THEN NULL ELSE 'XmlAttributeName' END FROM h WHERE NOT valued
  UNION ALL SELECT doc, i, j, -3, substring(e, 1, 1), 'XmlDelimiter' FROM v UNION ALL SELECT doc, i, j, -2, substring(e, 2), NULL FROM v UNION ALL SELECT doc, i, j, -1, q1, 'XmlAttributeQuotes' FROM v
  UNION ALL SELECT doc, i, j, 2 * y, part, 'XmlAttributeValue' FROM e UNION ALL SELECT doc, i, j, 2 * y + 1, ref, 'XmlEntityReference' FROM e
  UNION ALL SELECT doc, i, j, 1000000000000, q2, 'XmlAttributeQuotes' FROM f UNION ALL SELECT doc, i, 1000000000000, 0, z, 'XmlDelimiter' FROM d),
w AS (SELECT doc, s, class, sum(length(s)) OVER (PARTITION BY doc ORDER BY i, j, y) - length(s) AS start FROM x WHERE i < 0 OR s <> ''),
l AS (SELECT doc, unnest(range(len(m))) AS j, unnest(m) AS piece FROM (SELECT doc, regexp_extract_all(concat(html, chr(10)), '[^\r\n]*[\r\n]') AS m FROM p)),
c AS (SELECT doc, j, length(piece) AS n, CASE WHEN right(piece, 1) = chr(10) OR lead(piece) OVER (PARTITION BY doc ORDER BY j) = chr(13) THEN 1 ELSE 0 END AS counts FROM l),
n AS (SELECT coalesce(doc, -1) AS of, n - 1 AS line_length, sum(n) OVER o - n AS line_start, sum(counts) OVER o - counts AS line FROM c WINDOW o AS (PARTITION BY doc ORDER BY j)),
m AS (SELECT *, CASE class WHEN 'XmlAttributeName' THEN 'xan' WHEN 'XmlAttributeValue' THEN 'xav' WHEN 'XmlCDataSection' THEN 'xcs' WHEN 'XmlComment' THEN 'c' WHEN 'XmlDelimiter' THEN 'xd' WHEN 'XmlEntityReference' THEN 'xer'
  WHEN 'XmlName' THEN 'xn' WHEN 'XmlProcessingInstruction' THEN 'xpi' END AS mark, replace({_MARKED.format('s')}, concat(chr(10), chr(13)), concat(chr(10), ' ', chr(13))) AS safe FROM w ASOF JOIN n ON coalesce(w.doc, -1) = n.of AND w.start >= n.line_start)
SELECT doc, string_agg(CASE WHEN mark IS NULL THEN safe ELSE concat('<span class=', chr(34), mark, chr(34), '>', safe, '</span>') END, '' ORDER BY start) AS html,
  coalesce(string_agg(CASE WHEN class IS NOT NULL THEN concat_ws(':', start, length(s), line, start - line_start, line_length, class) END, ',' ORDER BY start), '') AS ranges FROM m GROUP BY doc"""


@query("xml_pipeline", _XML_SQL)
def xml_pipeline(spark, d):
    """Every page, of any size, with its markup classified and marked, and its classified ranges with line and column; the text between them are the gaps."""
    docs = dealt(spark, d, "pages", table(spark, d, "pages").select(c("page_id").alias("doc"), F.coalesce("html", F.lit("")).alias("text")), "doc")
    return fe.xml_marked(fe.xml_ranges(fe.xml_spans(docs), docs, None), docs)


@query("xml_class", "SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'xan' WHEN 1 THEN 'xav' WHEN 2 THEN 'c' WHEN 3 THEN 'xpi' END AS xml, CASE p_partkey % 5 WHEN 0 THEN 'k' WHEN 1 THEN 't' WHEN 2 THEN 't' WHEN 3 THEN 's' END AS script FROM part")
def xml_class(spark, d):
    of = lambda *x: F.get(F.array(*map(F.lit, x)), (c("p_partkey") % 5).cast("int"))
    xml = fe.xml_class(of("XmlAttributeName", "XmlAttributeValue", "XmlComment", "XmlProcessingInstruction", "XmlText"))
    return table(spark, d, "part").select(c("p_partkey").alias("k"), xml.alias("xml"), fe.script_class(of("keyword", "type alias name", "module name", "string", "number")).alias("script"))


# --- declarations


@query("implicit_ctor_rows", f"WITH {_PART} SELECT id, brand AS file, k AS \"offset\" FROM p UNION ALL SELECT substring(md5(concat(n, '.ctor')), 1, 16), brand, 0 FROM p WHERE k % 3 = 0")
def implicit_ctor_rows(spark, d):
    constructor = F.when(c("k") % 3 == 0, F.substring(F.md5(_text(c("n"), "'.ctor")), 1, 16))
    return fe.with_implicit_constructors(_part(spark, d).select("id", c("brand").alias("file"), c("k").alias("offset"), constructor.alias("constructor_id")))


@query("override_impl_refs", f"WITH {_PART}, o AS (SELECT * FROM p WHERE k % 4 IN (0, 1, 2) AND k % 5 <> 0) SELECT id AS member_id, CAST(3 AS BIGINT) AS kind, brand AS to_assembly, 'base' AS to_id FROM o WHERE k % 3 = 0 UNION ALL SELECT id, 4, brand, 'i1' FROM o UNION ALL SELECT id, 4, p_type, 'i2' FROM o")
def override_impl_refs(spark, d):
    link = lambda a, i: F.struct(a.alias("assembly"), F.lit(i).alias("id"))
    kind = F.get(F.array(*map(F.lit, ("Method", "Property", "Event", "NamedType"))), (c("k") % 4).cast("int"))
    over = F.when(c("k") % 3 == 0, F.array(link(c("brand"), "base"), link(c("p_type"), "other")))
    members = _part(spark, d).select(c("id").alias("member_id"), kind.alias("member_kind"), (c("k") % 5 == 0).alias("is_static"), over.alias("overridden"), F.array(link(c("brand"), "i1"), link(c("p_type"), "i2")).alias("implemented"))
    return fe.member_references(members).withColumn("kind", long("kind"))


@query("empty_array_alloc", f"WITH {_PART} SELECT n AS file, k AS line, CAST(10 AS BIGINT) AS kind, 'mscorlib' AS to_assembly, 'EmptyArrayAllocation' AS to_id FROM p WHERE k % 3 <> 0 AND k % 6 IN (2, 4)")
def empty_array_alloc(spark, d):
    k = c("k")
    omitted = k % 6 == 4
    rows = _part(spark, d).select(c("n").alias("file"), k.alias("line"), F.when(k % 3 == 0, 2).otherwise(1).alias("ranks"), F.lit(1).alias("sizes"), F.when(~omitted, F.when(k % 6 == 2, 0).otherwise(3)).alias("size"), omitted.alias("omitted"), F.when(omitted, 0).alias("elements"))
    return fe.empty_arrays(rows).withColumn("kind", long("kind"))


# --- codec


@query("huffman_codec", "SELECT p_partkey AS k, CASE WHEN p_partkey % 9 = 0 THEN concat(p_name, 'é') ELSE p_name END AS text, p_partkey % 9 = 0 AS plain FROM part")
def huffman_codec(spark, d):
    """A code is built of the names, written and read again; texts are compressed and uncompressed with it."""
    rows = table(spark, d, "part").select(c("p_partkey").alias("k"), F.when(c("p_partkey") % 9 == 0, _text(c("p_name"), "'é")).otherwise(c("p_name")).alias("value"))
    tree = hf.Tree.from_bytes(hf.build(rows).to_bytes())
    packed = rows.select("k", hf.compress(tree, c("value")).alias("data"))
    return packed.select("k", hf.uncompress(tree, c("data")).alias("text"), (F.substring("data", 1, 1) == F.lit(b"\xff")).alias("plain"))
