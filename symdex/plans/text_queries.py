"""Text, path, id and interval functions, and plugins, over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from symdex.functions import expressions, ids, paths as pt, symbols as sy, text
from symdex.operators import plugins, spans as sp
from symdex.sources import legacy, storage

from .binding import ASM, SQL, assemblies, dealt, long, query, table

c = F.col


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _pages(spark, d):
    return table(spark, d, "pages").select("page_id", "html")


# --- ids and codecs


@query("symbol_id", "SELECT doc_id, substring(md5(replace(concat('M:#ctor', doc_id), '#ctor', 'ctor')), 1, 16) AS id, substring(md5(concat('M:x', ':', doc_id)), 1, 16) AS local_id FROM documents")
def symbol_id(spark, d):
    k = c("doc_id").cast("string")
    return _docs(spark, d).select("doc_id", ids.symbol_id(F.concat(F.lit("M:#ctor"), k)).alias("id"), ids.local_id(F.lit("M:x"), k).alias("local_id"))


_HEX = "h AS (SELECT doc_id, substring(md5(CAST(doc_id AS VARCHAR)), 1, 16) AS h FROM documents), r AS (SELECT *, concat(substring(h, 15, 2), substring(h, 13, 2), substring(h, 11, 2), substring(h, 9, 2), substring(h, 7, 2), substring(h, 5, 2), substring(h, 3, 2), substring(h, 1, 2)) AS b FROM h)"


@query("id_to_ulong", f"WITH {_HEX} SELECT doc_id, h, CAST(CAST(concat('0x', b) AS UBIGINT) AS VARCHAR) AS number FROM r")
def id_to_ulong(spark, d):
    x = _docs(spark, d).select("doc_id", ids.symbol_id(c("doc_id").cast("string")).alias("h"))
    return x.select("doc_id", "h", ids.hex_to_number(c("h")).cast("string").alias("number"))


@query("ulong_to_hex", f"WITH {_HEX} SELECT doc_id, h FROM r")
def ulong_to_hex(spark, d):
    x = _docs(spark, d).select("doc_id", ids.hex_to_number(ids.symbol_id(c("doc_id").cast("string"))).alias("n"))
    return x.select("doc_id", ids.number_to_hex(c("n")).alias("h"))


@query("hex_to_ulong", "SELECT doc_id, doc_id % 2 = 0 AS valid FROM documents")
def hex_to_ulong(spark, d):
    """Anything but 16 hex digits is no id."""
    h = F.when(c("doc_id") % 2 == 0, F.substring(F.md5("text"), 1, 16)).when(c("doc_id") % 3 == 0, "xyz").otherwise(F.md5("text"))
    return _docs(spark, d).select("doc_id", ids.hex_to_number(h).isNotNull().alias("valid"))


@query("bytes_to_hex", "SELECT doc_id, lower(hex(encode(text))) AS h FROM documents")
def bytes_to_hex(spark, d):
    return _docs(spark, d).select("doc_id", ids.bytes_to_hex(c("text").cast("binary")).alias("h"))


@query("hex_to_bytes", "SELECT doc_id, text AS t FROM documents")
def hex_to_bytes(spark, d):
    return _docs(spark, d).select("doc_id", F.decode(ids.hex_to_bytes(ids.bytes_to_hex(c("text").cast("binary"))), "UTF-8").alias("t"))


@query("varint7", "SELECT o_orderkey AS k, o_orderkey * 99991 % 4294967296 AS n, CAST(CASE WHEN o_orderkey * 99991 % 4294967296 < 128 THEN 1 WHEN o_orderkey * 99991 % 4294967296 < 16384 THEN 2 WHEN o_orderkey * 99991 % 4294967296 < 2097152 THEN 3 WHEN o_orderkey * 99991 % 4294967296 < 268435456 THEN 4 ELSE 5 END AS BIGINT) AS size FROM orders")
def varint7(spark, d):
    n = (c("o_orderkey") * 99991) % 4294967296
    x = table(spark, d, "orders").select(c("o_orderkey").alias("k"), ids.varint(n).alias("b"))
    return x.select("k", ids.varint_value(c("b")).alias("n"), long(F.length("b")).alias("size"))


# --- text


_ESCAPE = "replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query("html_escape", f"SELECT page_id, md5({_ESCAPE.format(x='html')}) AS html FROM pages")
def html_escape(spark, d):
    return _pages(spark, d).select("page_id", F.md5(text.html_escape(c("html"))).alias("html"))


@query("html_escape_offsets", f"WITH p AS (SELECT page_id, trim(html, ' ') AS t FROM pages) SELECT page_id, {_ESCAPE.format(x='t')} AS html, CAST(length({_ESCAPE.format(x='substring(t, 1, 5)')}) AS BIGINT) AS new_start, CAST(length({_ESCAPE.format(x='substring(t, 1, 30)')}) AS BIGINT) AS new_end FROM p")
def html_escape_offsets(spark, d):
    x = _pages(spark, d).select("page_id", text.html_escape_offsets(c("html"), F.lit(5), F.lit(30)).alias("e"))
    return x.select("page_id", "e.html", long("e.new_start").alias("new_start"), long("e.new_end").alias("new_end"))


@query("url_encode", "SELECT p_partkey AS k, replace(replace(concat(p_brand, ' (', p_name, ')'), '#', '%23'), ' ', '+') AS x FROM part")
def url_encode(spark, d):
    return table(spark, d, "part").select(c("p_partkey").alias("k"), text.url_encode(F.concat("p_brand", F.lit(" ("), "p_name", F.lit(")"))).alias("x"))


@query("escape_semicolons", "SELECT page_id, translate(html, concat(';', chr(13), chr(10)), ':  ') AS x FROM pages")
def escape_semicolons(spark, d):
    return _pages(spark, d).select("page_id", text.escape_semicolons(c("html")).alias("x"))


@query("format_thousands", "SELECT o_orderkey AS k, format('{:,}', o_orderkey * 1237) AS x FROM orders")
def format_thousands(spark, d):
    return table(spark, d, "orders").select(c("o_orderkey").alias("k"), text.format_thousands(c("o_orderkey") * 1237).alias("x"))


@query("line_lengths", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), e AS (SELECT doc_id, unnest(p) AS x, unnest(range(len(p))) AS i, len(p) AS n FROM l) SELECT doc_id, string_agg(CAST(length(x) + CASE WHEN i < n - 1 THEN 1 ELSE 0 END AS VARCHAR), ',' ORDER BY i) AS lengths FROM e GROUP BY doc_id")
def line_lengths(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(F.transform(text.line_lengths(c("text")), lambda n: n.cast("string")), ",").alias("lengths"))


@query("line_number", "SELECT doc_id, CAST(length(b) - length(replace(b, chr(10), '')) AS BIGINT) AS line FROM (SELECT doc_id, substring(text, 1, length(text) * 3 // 4) AS b FROM documents)")
def line_number(spark, d):
    """Of the place at three quarters of each text."""
    at = F.floor(F.length("text") * 3 / 4).cast("int")
    return _docs(spark, d).select("doc_id", long(text.line_number(c("text"), at)).alias("line"))


@query("line_from_position", "WITH p AS (SELECT doc_id, length(text) * 3 // 4 AS k, text FROM documents), q AS (SELECT doc_id, k, string_split(substring(text, 1, k), chr(10))[-1] AS l, string_split(substring(text, k + 1), chr(10))[1] AS r FROM p) SELECT doc_id, CAST(k - length(l) AS BIGINT) AS start, CAST(length(l) + length(r) AS BIGINT) AS length FROM q")
def line_from_position(spark, d):
    at = F.floor(F.length("text") * 3 / 4).cast("int")
    x = _docs(spark, d).select("doc_id", text.line_from_position(c("text"), at).alias("l"))
    return x.select("doc_id", long("l.start").alias("start"), long("l.length").alias("length"))


@query("split_semicolons", "SELECT page_id, array_to_string(regexp_extract_all(html, '[ \\t\\r\\n]+|;|[^; \\t\\r\\n]+'), '|') AS parts FROM pages")
def split_semicolons(spark, d):
    return _pages(spark, d).select("page_id", F.array_join(text.split_semicolons(c("html")), "|").alias("parts"))


@query("split_expressions", "SELECT page_id, concat('a|$(b|$(c', page_id, ')|)|@(i,|x)') AS parts FROM pages")
def split_expressions(spark, d):
    t = F.concat(F.lit("a$(b$(c"), c("page_id").cast("string"), F.lit("))@(i,x)"))
    return _pages(spark, d).select("page_id", F.array_join(expressions.split_expressions(t), "|").alias("parts"))


@query("expression_refs", "SELECT page_id, 'property' AS kind, concat('P', page_id) AS name FROM pages UNION ALL SELECT page_id, 'item', 'I' FROM pages")
def expression_refs(spark, d):
    t = F.concat(F.lit("x $(P"), c("page_id").cast("string"), F.lit(".Length) @(I->'%(F)') @(J%K)"))
    return expressions.expression_refs(_pages(spark, d).select("page_id", t.alias("text"))).select("page_id", "kind", "name")


@query("guid_detect", "WITH m AS (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS m FROM documents) SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN concat_ws('-', substring(m, 1, 8), substring(m, 9, 4), substring(m, 13, 4), substring(m, 17, 4), substring(m, 21, 12)) END AS guid FROM m")
def guid_detect(spark, d):
    m = F.md5(c("doc_id").cast("string"))
    part = lambda a, n: F.substring(m, a, n)
    hyphens = F.upper(F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)))
    k = c("doc_id") % 4
    literal = F.when(k == 0, F.concat(F.lit('"'), m, F.lit('"'))).when(k == 1, F.concat(F.lit('@"{'), hyphens, F.lit('}"'))).when(k == 2, hyphens).otherwise(F.concat(F.lit("z"), m))
    return _docs(spark, d).select("doc_id", text.guid(literal).alias("guid"))


@query("namespace_of", "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(p_type, '.', p_brand) END AS namespace FROM part")
def namespace_of(spark, d):
    x = F.when(c("p_partkey") % 3 == 0, c("p_name")).otherwise(F.concat_ws(".", "p_type", "p_brand", "p_name"))
    return table(spark, d, "part").select(c("p_partkey").alias("k"), text.namespace_of(x).alias("namespace"))


@query("last_part", "SELECT p_partkey AS k, p_name AS last FROM part")
def last_part(spark, d):
    return table(spark, d, "part").select(c("p_partkey").alias("k"), text.last_part(F.concat_ws(".", "p_type", "p_brand", "p_name")).alias("last"))


@query("is_ascii", "SELECT doc_id, regexp_full_match(text, '[ -~]*') AS ascii FROM documents")
def is_ascii(spark, d):
    return _docs(spark, d).select("doc_id", text.is_ascii(c("text")).alias("ascii"))


@query("cap_large_file", "SELECT 'documents' AS source, doc_id AS id, len(string_split(text, chr(10))) > 30000 AS plain, length(text) > 1000000 AS plain_xml FROM documents UNION ALL SELECT 'pages', page_id, len(string_split(html, chr(10))) > 30000, length(html) > 1000000 FROM pages UNION ALL SELECT 'site', nation, sum(lines) > 30000, sum(chars) > 1000000 FROM (SELECT page_id % 25 AS nation, 300 * (len(string_split(html, chr(10))) - 1) AS lines, 300 * length(html) AS chars FROM pages) GROUP BY nation")
def cap_large_file(spark, d):
    """Lines and characters of every text, and of sites of which each page is there 300 times."""
    def of(source: str, rows, key: str, body: str):
        return rows.select(F.lit(source).alias("source"), long(key).alias("id"), long(F.size(F.split(body, "\n"))).alias("lines"), long(F.length(body)).alias("chars"))

    pages = of("site", _pages(spark, d), "page_id", "html")
    sites = pages.groupBy("source", (c("id") % 25).alias("id")).agg(F.sum((c("lines") - 1) * 300).alias("lines"), F.sum(c("chars") * 300).alias("chars"))
    every = of("documents", _docs(spark, d), "doc_id", "text").unionByName(of("pages", _pages(spark, d), "page_id", "html")).unionByName(sites)
    return every.select("source", "id", text.cap_large_file(c("lines")).alias("plain"), text.cap_large_xml(c("chars")).alias("plain_xml"))


@query("trim_compiler_exe", "SELECT p_partkey AS k, concat('/t:', p_name) AS arguments FROM part")
def trim_compiler_exe(spark, d):
    line = F.concat(F.lit("c:\\bin\\"), F.when(c("p_partkey") % 2 == 0, "CSC.exe ").otherwise("vbc.EXE "), F.lit("/t:"), "p_name")
    return table(spark, d, "part").select(c("p_partkey").alias("k"), text.trim_compiler_exe(line).alias("arguments"))


@query("parse_server_path", "SELECT p_partkey AS k, p_brand AS \"from\", p_name AS \"to\" FROM part")
def parse_server_path(spark, d):
    k = c("p_partkey") % 3
    x = F.when(k == 0, F.concat_ws("=", "p_brand", "p_name")).when(k == 1, F.concat(F.lit('"'), "p_brand", F.lit("="), "p_name", F.lit('"'))).otherwise(F.concat(F.lit('"'), "p_brand", F.lit('"="'), "p_name", F.lit('"')))
    return table(spark, d, "part").select(c("p_partkey").alias("k"), text.server_path(x).alias("s")).select("k", "s.*")


# --- paths


_PATHS = f"{ASM}, pa AS (SELECT pos, concat('c:', chr(92), project_path) AS path, string_split(project_path, chr(92)) AS p FROM asm WHERE project_path IS NOT NULL)"


def _paths(spark, d):
    a = assemblies(spark, d).where("project_path is not null")
    return a.select("pos", F.concat(F.lit("c:\\"), "project_path").alias("path"), F.split("project_path", r"\\").alias("p"))


_FROM_ASIA = "CASE WHEN p[1] = 'ASIA' THEN CASE WHEN p[2] = 'NATION_2' THEN p[3] ELSE concat('..', chr(92), p[2], chr(92), p[3]) END ELSE concat('..', chr(92), '..', chr(92), p[1], chr(92), p[2], chr(92), p[3]) END"


@query("relative_to_folder", f"WITH {_PATHS} SELECT pos, {_FROM_ASIA} AS relative FROM pa")
def relative_to_folder(spark, d):
    return _paths(spark, d).select("pos", pt.relative_to_folder(c("path"), F.lit("c:\\Asia\\NATION_2\\")).alias("relative"))


@query("relative_to_file", f"WITH {_PATHS} SELECT pos, {_FROM_ASIA} AS relative FROM pa")
def relative_to_file(spark, d):
    return _paths(spark, d).select("pos", pt.relative_to_file(c("path"), F.lit("c:\\asia\\NATION_2\\x.cs")).alias("relative"))


@query("relative_to_root", f"WITH {_PATHS} SELECT pos, '../../' AS up FROM pa")
def relative_to_root(spark, d):
    return _paths(spark, d).select("pos", pt.relative_to_root(c("path"), F.lit("c:")).alias("up"))


@query("path_in_cone", f"WITH {_PATHS} SELECT pos, CASE WHEN p[1] = 'ASIA' THEN path ELSE concat('c:', chr(92), 'asia', chr(92), p[1], chr(92), p[2], chr(92), p[3]) END AS path FROM pa")
def path_in_cone(spark, d):
    return _paths(spark, d).select("pos", pt.path_in_cone(F.lit("c:\\asia"), c("path")).alias("path"))


@query("is_or_contains", f"WITH {_PATHS} SELECT pos, p[1] = 'ASIA' AS inside FROM pa")
def is_or_contains(spark, d):
    return _paths(spark, d).select("pos", pt.is_or_contains(F.lit("C:\\asia"), c("path")).alias("inside"))


@query("sanitize_folder", "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'current' WHEN 1 THEN 'parent' WHEN 2 THEN p_name ELSE concat(p_name, '_x') END AS folder FROM part")
def sanitize_folder(spark, d):
    k = c("p_partkey") % 4
    x = F.when(k == 0, ".").when(k == 1, "..").when(k == 2, F.concat("p_name", F.lit(":"))).otherwise(F.concat("p_name", F.lit("|x")))
    return table(spark, d, "part").select(c("p_partkey").alias("k"), pt.sanitize_folder(x).alias("folder"))


@query("sanitize_file", "SELECT p_partkey AS k, concat(p_name, '__', p_brand) AS file FROM part")
def sanitize_file(spark, d):
    return table(spark, d, "part").select(c("p_partkey").alias("k"), pt.sanitize_file(F.concat("p_name", F.lit(":*"), "p_brand")).alias("file"))


@query("strip_ext", f"WITH {_PATHS} SELECT pos, substring(path, 1, length(path) - 7) AS path FROM pa")
def strip_ext(spark, d):
    return _paths(spark, d).select("pos", pt.strip_extension(c("path")).alias("path"))


@query("relative_file_in_project", f"WITH {_PATHS} SELECT pos, concat(p[1], chr(92), 'parent', chr(92), p[3]) AS path FROM pa")
def relative_file_in_project(spark, d):
    return _paths(spark, d).select("pos", pt.relative_in_project(F.array(F.get("p", F.lit(0)), F.lit("..")), F.get("p", F.lit(2))).alias("path"))


@query("display_link", "SELECT o_orderkey AS k, CASE WHEN o_custkey % 2 = 0 THEN concat('../d/f', o_custkey, '.html#', o_orderkey) ELSE concat('../../a/d/f', o_custkey, '.html#', o_orderkey) END AS url FROM orders")
def display_link(spark, d):
    path = F.concat(F.lit("d\\f"), c("o_custkey").cast("string"))
    return table(spark, d, "orders").select(c("o_orderkey").alias("k"), pt.display_link(F.lit("a"), F.when(c("o_custkey") % 2 == 0, "a").otherwise("b"), path, c("o_orderkey")).alias("url"))


@query("mapped_url", f"WITH {_PATHS} SELECT pos, concat('c', chr(92), 'bin_', chr(92), replace(p[1], ' ', ''), '.html') AS url FROM pa")
def mapped_url(spark, d):
    return _paths(spark, d).select("pos", pt.mapped_url(F.concat(F.lit("c:\\bin\\"), F.get("p", F.lit(0)))).alias("url"))


@query("folder_chain", "SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN concat(p_type, '/', replace(p_name, ' ', '_')) END AS folders FROM part")
def folder_chain(spark, d):
    name = F.when(c("p_partkey") % 2 == 0, F.replace(c("p_name"), F.lit(" "), F.lit("_"))).otherwise(F.concat(F.lit("<"), "p_name", F.lit(">")))
    return table(spark, d, "part").select(c("p_partkey").alias("k"), F.array_join(pt.folder_chain(F.concat_ws(".", "p_type", name)), "/").alias("folders"))


# --- icons and names


@query("symbol_name", "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN concat(p_brand, ' .ctor') WHEN p_partkey % 3 = 1 THEN p_name ELSE p_type END AS name FROM part")
def symbol_name(spark, d):
    k = c("p_partkey") % 3
    return table(spark, d, "part").select(c("p_partkey").alias("k"), sy.symbol_name(F.when(k == 0, ".ctor").when(k == 1, c("p_name")), c("p_brand"), c("p_type")).alias("name"))


@query("glyph_number", "WITH w(i, kind, g, kinds) AS (VALUES (0, 'class', 0, 1), (1, 'constant', 6, 1), (2, 'delegate', 12, 1), (3, 'enum', 18, 1), (4, 'enum member', 24, 0), (5, 'event', 30, 1), (6, 'field', 42, 1), (7, 'interface', 48, 1), (8, 'method', 72, 1), (9, 'module', 84, 1), (10, 'namespace', 90, 0), (11, 'operator', 96, 0), (12, 'property', 102, 1), (13, 'struct', 108, 1), (14, 'type parameter', 126, 0), (15, 'local', 138, 0), (16, 'extension method', 220, 2), (17, 'label', 150, 0), (18, 'other', NULL, 1)), x AS (SELECT p_partkey AS k, p_size % 5 AS a, kind, g, kinds FROM part JOIN w ON p_partkey % 19 = i) SELECT k, CAST(g + CASE WHEN kinds = 0 OR a NOT IN (1, 2, 3) THEN 0 WHEN a = 1 THEN 3 - kinds ELSE a + 1 END AS BIGINT) AS glyph, CASE WHEN kind IN ('class', 'delegate', 'enum', 'event', 'interface', 'method', 'property', 'struct', 'field') THEN kind WHEN kind IN ('constant', 'enum member') THEN 'field' WHEN kind = 'extension method' AND a <> 2 THEN 'method' ELSE 'symbol' END AS read_back FROM x")
def glyph_number(spark, d):
    """Icons of symbols of every kind and accessibility, and the kind that a search takes them for."""
    kinds = ("class", "constant", "delegate", "enum", "enum member", "event", "field", "interface", "method", "module", "namespace", "operator", "property", "struct", "type parameter", "local", "extension method", "label", "other")
    kind = F.get(F.array(*map(F.lit, kinds)), (c("p_partkey") % len(kinds)).cast("int"))
    access = F.get(F.array(*map(F.lit, ("public", "internal", "protected", "private"))), (c("p_size") % 5).cast("int"))
    glyph = sy.glyph_number(kind, access)
    return table(spark, d, "part").select(c("p_partkey").alias("k"), long(glyph).alias("glyph"), sy.glyph_to_kind(glyph).alias("read_back"))


@query("glyph_keyword", "WITH w(g, word) AS (VALUES (0, 'class'), (6, 'constant'), (12, 'delegate'), (18, 'enum'), (24, 'enum member'), (30, 'event'), (36, 'exception'), (42, 'field'), (48, 'interface'), (54, 'macro'), (60, 'map'), (66, 'map item'), (72, 'method'), (78, 'overload'), (84, 'module'), (90, 'namespace'), (96, 'operator'), (102, 'property'), (108, 'struct'), (114, 'type parameter'), (150, 'module')) SELECT p_partkey AS k, coalesce(word, 'symbol') AS word FROM part LEFT JOIN w ON (p_partkey % 240) - (p_partkey % 240) % 6 = g")
def glyph_keyword(spark, d):
    return table(spark, d, "part").select(c("p_partkey").alias("k"), sy.glyph_keyword((c("p_partkey") % 240).cast("int")).alias("word"))


@query("glyph_for_extension", "SELECT p_partkey AS k, CAST(CASE p_partkey % 4 WHEN 0 THEN 196 WHEN 1 THEN 195 WHEN 2 THEN 228 ELSE 227 END AS BIGINT) AS glyph FROM part")
def glyph_for_extension(spark, d):
    name = F.concat("p_name", F.element_at(F.array(*map(F.lit, (".CS", ".vb", ".ts", ".txt"))), (c("p_partkey") % 4 + 1).cast("int")))
    return table(spark, d, "part").select(c("p_partkey").alias("k"), long(sy.glyph_for_extension(name)).alias("glyph"))


@query("glyph_for_ts_kind", "SELECT p_partkey AS k, CAST(CASE p_partkey % 4 WHEN 0 THEN 42 WHEN 1 THEN 72 WHEN 2 THEN 48 ELSE 195 END AS BIGINT) AS glyph FROM part")
def glyph_for_ts_kind(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("variable", "constructor", "interface", "?"))), (c("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select(c("p_partkey").alias("k"), long(sy.glyph_for_script_kind(kind)).alias("glyph"))


# --- spans: the words of conversations, with spans inside them, at their starts and across the blank behind them


_KEYWORDS = ("the", "of", "and", "this", "de", "der", "la", "que", "in", "is", "that")
_WORDS = f"""wd AS (SELECT conv_id * 1000 + turn AS doc, coalesce(text, '') AS t FROM conversations),
tk AS (SELECT doc, unnest(string_split(t, ' ')) AS word, unnest(range(len(string_split(t, ' ')))) AS i FROM wd),
pl AS (SELECT doc, i, word, CAST(sum(length(word) + 1) OVER (PARTITION BY doc ORDER BY i) AS BIGINT) - length(word) - 1 AS place, lead(word) OVER (PARTITION BY doc ORDER BY i) AS after FROM tk),
sp AS (SELECT doc, i * 4 AS seq, place AS start, length(word) AS length, CASE WHEN word IN {_KEYWORDS} THEN 'keyword' WHEN regexp_matches(word, '^[A-ZÀ-Þ]') THEN 'class name' WHEN regexp_matches(word, '[.,]$') THEN 'comment' ELSE 'odd' END AS class, word AS text FROM pl WHERE word <> ''
  UNION ALL SELECT doc, i * 4 + 1, place + 1, 3, CASE WHEN i % 2 = 0 THEN 'comment' ELSE 'number' END, substring(word, 2, 3) FROM pl WHERE length(word) >= 6
  UNION ALL SELECT doc, i * 4 + 2, place, 2, 'string', substring(word, 1, 2) FROM pl WHERE length(word) >= 4 AND i % 3 = 0
  UNION ALL SELECT doc, i * 4 + 3, place + length(word) // 2, length(word) - length(word) // 2 + 2, 'keyword', concat(substring(word, length(word) // 2 + 1), ' ', substring(after, 1, 1)) FROM pl WHERE word <> '' AND after <> '' AND i % 4 = 1),
ln AS (SELECT doc, length(t) + 9 AS n FROM wd)"""


def _conversations(spark, d):
    """Texts dealt by document before spans are made of them, so only texts are shuffled."""
    texts = table(spark, d, "conversations").select((c("conv_id") * 1000 + c("turn")).alias("doc"), F.coalesce("text", F.lit("")).alias("t"))
    return dealt(spark, d, "conversations", texts, "doc")


def _words(spark, d):
    """(spans, documents): each word, a part inside long words, the first letters of some words, and spans that reach into the next word."""
    from pyspark.sql import Window

    texts = _conversations(spark, d)
    order = Window.partitionBy("doc").orderBy("i")
    words = texts.select("doc", F.posexplode(F.split("t", " ")).alias("i", "word")).withColumn("i", long("i"))
    n = F.length("word").cast("long")
    words = words.withColumns({"n": n, "at": F.sum(n + 1).over(order) - n - 1, "after": F.lead("word").over(order)})
    w, half = c("word"), F.floor(c("n") / 2)
    kind = F.when(w.isin(*_KEYWORDS), "keyword").when(w.rlike("^[A-ZÀ-Þ]"), "class name").when(w.rlike("[.,]$"), "comment").otherwise("odd")

    def span(more: int, start, length, class_, text_):
        return F.struct((c("i") * 4 + more).alias("seq"), long(start).alias("start"), long(length).alias("length"), class_.alias("class"), text_.alias("text"))

    across = F.concat(F.substring(w, half.cast("int") + 1, F.length(w)), F.lit(" "), F.substring("after", 1, 1))
    each = F.array(
        F.when(c("n") > 0, span(0, c("at"), c("n"), kind, w)),
        F.when(c("n") >= 6, span(1, c("at") + 1, F.lit(3), F.when(c("i") % 2 == 0, "comment").otherwise("number"), F.substring(w, 2, 3))),
        F.when((c("n") >= 4) & (c("i") % 3 == 0), span(2, c("at"), F.lit(2), F.lit("string"), F.substring(w, 1, 2))),
        F.when((c("n") > 0) & (c("after") != "") & (c("i") % 4 == 1), span(3, c("at") + half, c("n") - half + 2, F.lit("keyword"), across)),
    )
    spans = words.select("doc", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("doc", "x.*")
    return spans, texts.select("doc", (F.length("t") + 9).cast("long").alias("n"))


_GAPS = """la AS (SELECT *, start + length AS stop, lag(start + length, 1, 0) OVER (PARTITION BY doc ORDER BY start, seq) AS last FROM {s}), te AS (SELECT doc, list(stop ORDER BY start, seq)[-1] AS e FROM la GROUP BY doc),
ga AS (SELECT doc, start, length, class FROM {s} UNION ALL SELECT doc, last, start - last, NULL FROM la WHERE start > last UNION ALL SELECT ln.doc, coalesce(e, 0), n - coalesce(e, 0), NULL FROM ln LEFT JOIN te USING (doc) WHERE n > coalesce(e, 0))"""


def _gapped(df):
    return df.select("doc", "start", long("length").alias("length"), "class")


@query("fill_gaps", f"WITH {_WORDS}, {_GAPS.format(s='sp')} SELECT doc, start, CAST(length AS BIGINT) AS length, class FROM ga")
def fill_gaps(spark, d):
    return _gapped(sp.fill_gaps(*_words(spark, d)))


@query("fill_gaps_dedup", f"WITH {_WORDS}, {_GAPS.format(s='sp')} SELECT doc, start, CAST(length AS BIGINT) AS length, class FROM ga")
def fill_gaps_dedup(spark, d):
    """Every span is there twice; the second of two equal ones goes."""
    spans, docs = _words(spark, d)
    twice = spans.withColumn("seq", c("seq") * 2).unionByName(spans.withColumn("seq", c("seq") * 2 + 1))
    return _gapped(sp.fill_gaps_dedup(twice, docs))


@query("concat_ranges", f"WITH {_WORDS} SELECT doc, start, false AS semantic FROM sp UNION ALL SELECT doc, start, true FROM sp WHERE class = 'comment'")
def concat_ranges(spark, d):
    spans, _ = _words(spark, d)
    return sp.concat_ranges(spans, spans.where("class = 'comment'")).select("doc", "start", "semantic")


@query("distinct_points", f"WITH {_WORDS} SELECT DISTINCT doc, p AS point FROM (SELECT doc, start AS p FROM sp UNION ALL SELECT doc, start + length FROM sp)")
def distinct_points(spark, d):
    return sp.distinct_points(_words(spark, d)[0])


_SPLIT = """po AS (SELECT DISTINCT doc, p FROM (SELECT doc, start AS p FROM {s} UNION ALL SELECT doc, start + length FROM {s})), cu AS (SELECT x.doc, x.seq, x.class, x.semantic, p FROM {s} x JOIN po ON x.doc = po.doc AND p >= start AND p <= start + length),
nx AS (SELECT doc, seq, class, semantic, p AS start, CAST(lead(p) OVER w - p AS BIGINT) AS length, row_number() OVER w AS piece, count(*) OVER (PARTITION BY doc, seq) - 1 AS pieces FROM cu WINDOW w AS (PARTITION BY doc, seq ORDER BY p)), pc AS (SELECT * FROM nx WHERE length IS NOT NULL)"""
_CUT = f"WITH {_WORDS}, fl AS (SELECT *, false AS semantic FROM sp), {_SPLIT.format(s='fl')}"


def _pieces(spark, d):
    return sp.split_intervals(_words(spark, d)[0].withColumn("semantic", F.lit(False)))


@query("split_intervals", f"{_CUT} SELECT doc, seq, start, length FROM pc")
def split_intervals(spark, d):
    return _pieces(spark, d).select("doc", "seq", "start", long("length").alias("length"))


@query("resolve_overlaps", f"{_CUT}, best AS (SELECT doc, start, max(CASE WHEN class <> 'comment' THEN seq END) AS plain, min(seq) AS first FROM pc GROUP BY doc, start) SELECT pc.doc, pc.start, pc.length, pc.class FROM best JOIN pc ON pc.doc = best.doc AND pc.start = best.start AND pc.seq = coalesce(plain, first)")
def resolve_overlaps(spark, d):
    """Of pieces with one start the last that is no comment stays, or else the first."""
    return _gapped(sp.resolve_overlaps(_pieces(spark, d)))


_BOTH = """bo AS (SELECT doc, seq, start, length, class, false AS semantic FROM sp UNION ALL SELECT doc, seq + 1073741824, start, length, 'type', true FROM sp WHERE class = 'class name')"""
_FOLD = """CASE WHEN a.semantic AND NOT b.semantic THEN struct_pack(length := b.length, class := a.class, semantic := b.semantic) WHEN b.semantic AND NOT a.semantic THEN struct_pack(length := a.length, class := b.class, semantic := a.semantic) WHEN b.class = 'comment' THEN a ELSE b END"""


@query("prepare_ranges", f"WITH {_WORDS}, {_BOTH}, {_SPLIT.format(s='bo')}, fd AS (SELECT doc, start, list(struct_pack(length := length, class := class, semantic := semantic AND pieces = 1) ORDER BY seq, piece) AS run FROM pc GROUP BY doc, start), rs AS (SELECT doc, 0 AS seq, start, x.length AS length, x.class AS class FROM (SELECT doc, start, list_reduce(run, lambda a, b: {_FOLD}) AS x FROM fd)), {_GAPS.format(s='rs')} SELECT doc, start, CAST(length AS BIGINT) AS length, class FROM ga")
def prepare_ranges(spark, d):
    """Pieces and gaps of every text, with their classes; names of classes are also found by the second analysis."""
    spans, docs = _words(spark, d)
    return _gapped(sp.prepare_ranges(spans, spans.where("class = 'class name'").withColumn("class", F.lit("type")), docs))


@query("merge_islands", f"WITH {_WORDS}, m AS (SELECT *, class = 'keyword' AND text NOT IN {sp.APART} AS m FROM sp), i AS (SELECT *, CASE WHEN m AND lag(m) OVER w THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY doc ORDER BY start, seq)), g AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY start, seq) AS island FROM i) SELECT doc, min(start) AS start, CAST(list(start + length ORDER BY start, seq)[-1] - min(start) AS BIGINT) AS length FROM g GROUP BY doc, island")
def merge_islands(spark, d):
    return sp.merge_islands(_words(spark, d)[0]).select("doc", "start", long("length").alias("length"))


@query("map_classification", f"WITH {_WORDS} SELECT doc, start, CASE class WHEN 'keyword' THEN 'k' WHEN 'comment' THEN 'c' WHEN 'class name' THEN 't' WHEN 'string' THEN 's' ELSE 'unknownClassification' END AS class FROM sp WHERE class <> 'number'")
def map_classification(spark, d):
    return sp.map_class(_words(spark, d)[0]).select("doc", "start", "class")


@query("filter_classification", f"WITH {_WORDS} SELECT doc, start FROM sp WHERE class NOT IN ('keyword', 'comment', 'odd')")
def filter_classification(spark, d):
    k = c("class")
    spans = _words(spark, d)[0].withColumn("class", F.when(k == "keyword", "static symbol").when(k == "comment", "string - escape character").when(k == "odd", "regex - text").otherwise(k))
    return sp.filter_class(spans).select("doc", "start")


_LOCALS = f"WITH {_WORDS}, f AS (SELECT doc, text AS symbol, min(start) AS p FROM sp WHERE class IN ('odd', 'class name') GROUP BY ALL) SELECT doc, symbol, row_number() OVER (PARTITION BY doc ORDER BY p) - 1 AS local_id FROM f"


@query("local_ids", _LOCALS)
def local_ids(spark, d):
    """Plain and capitalised words stand for symbols."""
    words = _words(spark, d)[0].where("class in ('odd', 'class name')")
    return sp.local_ids(words.select("doc", c("text").alias("symbol"), c("start").alias("position"))).withColumn("local_id", long("local_id"))


@query("highlight_spans", f"SELECT doc, symbol, concat('r', local_id, ' r') AS css FROM ({_LOCALS})")
def highlight_spans(spark, d):
    return sp.highlight_class(local_ids(spark, d)).select("doc", "symbol", "css")


_KIND_OF = "CASE (start + doc) % 10 WHEN 0 THEN 'Namespace' WHEN 1 THEN 'Field' WHEN 2 THEN 'Property' WHEN 3 THEN 'Method' WHEN 4 THEN 'Constructor' WHEN 5 THEN 'NamedType' WHEN 6 THEN 'Alias' WHEN 7 THEN 'Parameter' WHEN 8 THEN 'Local' END"
_CLASS_OF = "CASE (start // 2 + seq) % 9 WHEN 0 THEN 'i' WHEN 1 THEN 't' WHEN 2 THEN 'k' WHEN 3 THEN 's' WHEN 4 THEN 'punctuation' WHEN 5 THEN 'c' WHEN 6 THEN 'unknownClassification' WHEN 7 THEN 'prep' END"


@query("css_class", f"WITH {_WORDS}, x AS (SELECT doc, seq, text, {_CLASS_OF} AS class, {_KIND_OF} AS kind FROM sp), y AS (SELECT *, CASE WHEN kind IN ('NamedType', 'Alias') THEN 't' WHEN kind = 'Namespace' THEN 'n' WHEN kind IN ('Field', 'Property', 'Method', 'Constructor') THEN lower(kind) END AS adds, class IN ('i', 't') OR (text IN ('this', 'base', 'var', 'new', 'New', 'partial', 'Partial', '[') AND class IN ('c', 'prep')) AS bound FROM x) SELECT doc, seq, CASE WHEN class = 'punctuation' THEN NULL WHEN bound AND NOT (text = 'this' AND kind IS NOT DISTINCT FROM 'Parameter') AND adds IS NOT NULL THEN concat(class, ' ', adds) ELSE class END AS css FROM y")
def css_class(spark, d):
    """All pairs of classes and kinds, over the words of conversations."""
    def of(k, *values):
        return F.get(F.array(*map(F.lit, values)), k.cast("int"))

    kind = of((c("start") + c("doc")) % 10, "Namespace", "Field", "Property", "Method", "Constructor", "NamedType", "Alias", "Parameter", "Local", None)
    mark = of((F.floor(c("start") / 2) + c("seq")) % 9, "i", "t", "k", "s", "punctuation", "c", "unknownClassification", "prep", None)
    return sp.css_classes(_words(spark, d)[0].withColumns({"class": mark, "kind": kind})).select("doc", "seq", "css")


_ESC = "replace(replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;'), chr(10) || chr(13), chr(10) || ' ' || chr(13))"
_PREPARED = f"{_BOTH}, {_SPLIT.format(s='bo')}, fd AS (SELECT doc, start, list(struct_pack(length := length, class := class, semantic := semantic AND pieces = 1) ORDER BY seq, piece) AS run FROM pc GROUP BY doc, start), rs AS (SELECT doc, 0 AS seq, start, x.length AS length, x.class AS class FROM (SELECT doc, start, list_reduce(run, lambda a, b: {_FOLD}) AS x FROM fd)), {_GAPS.format(s='rs')}"


@query("sink_html", f"WITH {_WORDS.replace('length(t) + 9', 'length(t)')}, {_PREPARED}, tx AS (SELECT doc, class, start, {_ESC.format('substring(t, start + 1, length)')} AS body FROM ga JOIN wd USING (doc)) SELECT doc, string_agg(CASE WHEN class IS NULL THEN body ELSE concat('<span class=', chr(34), class, chr(34), '>', body, '</span>') END, '' ORDER BY start) AS html FROM tx GROUP BY doc")
def sink_html(spark, d):
    """Pages of conversations in chunks of 100 letters, written and read again, each text's chunks one after the other."""
    spans, docs = _words(spark, d)
    ranges = sp.prepare_ranges(spans, spans.where("class = 'class name'").withColumn("class", F.lit("type")), docs.withColumn("n", c("n") - 9))
    path = storage.fresh(spark, "pages")
    sp.html_chunks(ranges, _conversations(spark, d).withColumnRenamed("t", "text"), 100).sortWithinPartitions("doc", "chunk").write.parquet(path)
    back = dealt(spark, d, "conversations", spark.read.parquet(path), "doc")
    return back.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "html"))), lambda x: x["html"]), "").alias("html"))


# --- plugins and formats: checked by rows and by tests


@query("text_visitor", "SELECT doc_id AS file, line, upper(substring(t, 1, 1)) AS glyph FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents WHERE doc_id % 2 = 0) WHERE regexp_full_match(substring(t, 1, 1), '[A-Za-z]')")
def text_visitor(spark, d):
    """Visitors see every line of every document."""
    reg = plugins.Registry(denied=("other",))
    reg.add(plugins.Plugin("first", lambda t, file, line: t[0].upper() if t and int(file) % 2 == 0 and t[0].isascii() and t[0].isalpha() else None))
    reg.add(plugins.Plugin("other", lambda t, file, line: "x"))
    lines = _docs(spark, d).select(c("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return reg.visit_lines(lines.select("file", (c("at") + 1).cast("long").alias("line"), "text")).select("file", "line", "glyph")


@query("plugin_isolation", "SELECT doc_id AS file FROM documents WHERE doc_id % 3 <> 0")
def plugin_isolation(spark, d):
    """A visitor that fails on some lines answers on the others."""
    reg = plugins.Registry()
    reg.add(plugins.Plugin("fragile", lambda t, file, line: str(1 // (int(file) % 3)) and "ok"))
    lines = _docs(spark, d).select(c("doc_id").alias("file"), F.lit(1).cast("long").alias("line"), "text")
    return reg.visit_lines(lines).select("file")


@query("symbol_visitor", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN concat('C', p_name) ELSE concat('M', p_brand) END AS answer FROM part WHERE p_size % 5 <> 0")
def symbol_visitor(spark, d):
    reg = plugins.Registry()
    reg.add(plugins.Plugin("names", symbol_visitor={"class": lambda n, x: "C" + n, "method": lambda n, x: "M" + x}))
    kind = F.when(c("p_size") % 5 == 0, "field").when(c("p_size") % 2 == 0, "class").otherwise("method")
    return reg.visit_symbols(table(spark, d, "part").select(c("p_partkey").alias("id"), kind.alias("kind"), c("p_name").alias("name"), c("p_brand").alias("description"))).select("id", "answer")


@query("plugin_registry", "SELECT doc_id, concat('<', doc_id, '>') AS x FROM documents")
def plugin_registry(spark, d):
    reg = plugins.Registry(settings={"mark": {"left": "<"}})
    kept: dict[str, str] = {}
    reg.add(plugins.Plugin("mark", lambda t, file, line: f"{kept['left']}{file}>", start=kept.update))
    reg.register(spark)
    return _docs(spark, d).select("doc_id", F.call_function("mark", c("text"), c("doc_id").cast("string"), F.lit(1)).alias("x"))


@query("plugin_config_group", "SELECT concat('plugin', p_size) AS plugin, string_agg(concat(p_name, '=', v), '|' ORDER BY p_name) AS settings FROM (SELECT p_size, p_name, max_by(concat(p_brand, CASE WHEN p_partkey % 3 = 0 THEN '=x:y' ELSE '' END), p_partkey) AS v FROM part WHERE p_partkey % 5 <> 0 GROUP BY ALL) GROUP BY p_size")
def plugin_config_group(spark, d):
    """Settings that come again, hold the signs that divide them, or have no plugin."""
    k = c("p_partkey")
    value = F.concat(F.when(k % 5 != 0, F.concat(F.lit("plugin"), c("p_size").cast("string"), F.lit(":"))).otherwise(""), "p_name", F.lit("="), "p_brand", F.when((k % 3 == 0) & (k % 5 != 0), "=x:y").otherwise(""))
    g = plugins.config_groups(table(spark, d, "part").select(k.alias("seq"), value.alias("value")))
    return g.select("plugin", F.array_join(F.transform(F.map_entries("settings"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("settings"))


@query("sniff_pe", "SELECT p_partkey AS k, p_partkey % 4 < 2 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AS managed FROM part")
def sniff_pe(spark, d):
    """Images for 32 and 64 bits whose header lies at different places, with and without a runtime header; some are cut short or aren't images."""
    k = c("p_partkey")
    gap = (k % 50 + 64).cast("int")
    start = F.concat(F.when(k % 7 == 0, "4D5B").otherwise("4D5A"), F.lit("00" * 58), F.lpad(F.hex(gap + 64), 2, "0"), F.lit("000000"), F.repeat(F.lit("00"), gap))
    wide = k % 2 == 0
    header = F.concat(F.lit("50450000" + "00" * 20), F.when(wide, "0B02").otherwise("0B01"), F.repeat(F.lit("00"), F.when(wide, 110).otherwise(94)), F.lit("00" * 112), F.when(k % 4 < 2, "00200000").otherwise("00000000"), F.lit("00" * 4))
    image = F.when(k % 11 == 0, start).when(k % 13 == 0, F.concat(start, F.lit("50450000"))).otherwise(F.concat(start, header))
    return table(spark, d, "part").select(k.alias("k"), legacy.is_managed(F.unhex(image)).alias("managed"))


@query("scan_symbol_index", "SELECT p_partkey % 7 AS assembly_number, p_name AS name, substring(md5(CAST(p_partkey AS VARCHAR)), 1, 16) AS symbol_id, p_type AS description, CAST(p_size AS BIGINT) AS glyph FROM part")
def scan_symbol_index(spark, d):
    """Binary tables are written, one for each partition, and read again from their files."""
    path = storage.fresh(spark, "binary")
    p = table(spark, d, "part").select((c("p_partkey") % 7).alias("assembly_number"), c("p_name").alias("name"), F.substring(F.md5(c("p_partkey").cast("string")), 1, 16).alias("symbol_id"), c("p_type").alias("description"), c("p_size").alias("glyph"))
    legacy.write_symbol_index(p, path)
    back = legacy.scan_symbol_index(spark, path, packed=True)
    return back.select(long("assembly_number").alias("assembly_number"), "name", "symbol_id", c("description").cast("string").alias("description"), long("glyph").alias("glyph"))


@query("scan_tsjson", "SELECT concat('f', p_partkey) AS file, CAST(p_size AS BIGINT) AS start, CAST(1 AS BIGINT) AS length, 'k' AS classification FROM part")
def scan_tsjson(spark, d):
    """Analysed files are written as lines of JSON and read again; result and error notes beside them are left out."""
    path = storage.fresh(spark, "analysed")
    span = F.struct(c("p_size").alias("start"), F.lit(1).alias("length"), F.lit("k").alias("classification"))
    table(spark, d, "part").select(F.concat(F.lit("f"), c("p_partkey").cast("string")).alias("fileName"), F.array(span).alias("syntacticClassifications")).write.json(path)
    x = legacy.scan_analyzed(spark, path, lines=True).select(c("fileName").alias("file"), F.explode("syntacticClassifications").alias("s"))
    return x.select("file", long("s.start").alias("start"), long("s.length").alias("length"), "s.classification")


@query("append_references_stream", "SELECT l_suppkey % 5 AS to_assembly, count(*) AS n FROM lineitem GROUP BY ALL")
def append_references_stream(spark, d):
    from symdex.streaming.references import append_references

    source, target = storage.fresh(spark, "incoming"), storage.fresh(spark, "facts")
    table(spark, d, "lineitem").select((c("l_suppkey") % 5).alias("to_assembly"), "l_partkey").write.parquet(source)
    append_references(spark, source, "to_assembly long, l_partkey long", target, storage.fresh(spark, "progress")).awaitTermination()
    return spark.read.schema("l_partkey long, to_assembly long, batch long").parquet(target).groupBy("to_assembly").agg(F.count("*").alias("n"))
