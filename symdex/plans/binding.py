"""The engine's relations made of the benchmark tables, in Spark and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symdex.functions.ids import symbol_id
from symdex.functions.symbols import glyph_to_kind, kind_rank, pick
from symdex.functions.text import fold_case
from symdex.operators.graph import normalize_ids
from symdex.operators import positions
from symdex.operators.numbering import dense
from symdex.sources.storage import exists, file_system, fresh

GLYPHS = {"ECONOMY": 0, "LARGE": 6, "MEDIUM": 48, "PROMO": 72, "SMALL": 102, "STANDARD": 108}
FLAGS = {"AF": 0, "AO": 2, "RF": 3, "RO": 5, "NF": 6, "NO": 8}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its operator's name, with its SQL."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files that one part of it should have where a task makes many rows of each of its rows.
PART = 1 << 20
#: The same for tables of short rows on each of which much work is done: few of their files would keep few cores busy.
SHORT = 1 << 17


def dealt(spark: SparkSession, d: str, name: str, rows: DataFrame, *keys: str, part: int = PART) -> DataFrame:
    """Rows made of a table, dealt by keys into parts whose number grows with its files, so what a task holds and does doesn't grow with the table.

    What is made of them by these keys, however many rows that are, is neither shuffled again nor joined over the network.
    """
    fs, where = file_system(spark, f"{d}/{name}.parquet")
    parts = -(-fs.getContentSummary(where).getLength() // part)
    return rows.repartition(max(parts, spark.sparkContext.defaultParallelism), *keys)


def long(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("long")


def assemblies(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.when(F.col("s_suppkey") % 5 != 0, F.concat("r_name", F.lit("\\"), "n_name", F.lit("\\"), "s_name", F.lit(".csproj")))
    return s.select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("assembly_name"), path.alias("project_path"), fold_case("s_name").alias("assembly_key"))


def keyed_assemblies(spark: SparkSession, d: str) -> DataFrame:
    return normalize_ids(assemblies(spark, d))[0]


def _suppliers(spark: SparkSession, d: str) -> Column:
    """How many there are, as a scalar subquery: nothing runs while a plan is made."""
    return table(spark, d, "supplier").agg(F.count("*")).scalar()


def bare_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols without their place in the index."""
    n = _suppliers(spark, d)
    c = F.col
    plain = F.replace(c("p_name"), F.lit(" "), F.lit(""))
    p = table(spark, d, "part").withColumn("name", F.when(c("p_partkey") % 3 == 0, F.upper(plain)).otherwise(plain))
    p = p.withColumn("glyph", pick(c("p_type"), GLYPHS, 0))
    return p.select(
        c("p_partkey").alias("key"), "name", fold_case("name").alias("name_key"), (c("p_partkey") % n).alias("assembly_number"), "glyph", kind_rank(glyph_to_kind(c("glyph"))).alias("kind_rank"),
        F.concat(F.replace(c("p_brand"), F.lit("#"), F.lit(".")), F.lit("."), "name", F.lit("("), "p_type", F.lit(")")).alias("description"),
        symbol_id(F.concat(F.lit("T:"), "p_brand", F.lit("."), "p_name", F.lit(":"), c("p_partkey").cast("string"))).alias("symbol_id"),
    )


#: Serving tables that this session has written: what they were made of, and where they are.
_SERVING: dict[tuple, str] = {}


def _files(spark: SparkSession, path: str) -> tuple:
    """Names, times and sizes of a table's files, from one listing of its folder."""
    fs, where = file_system(spark, path)
    return tuple(sorted((s.getPath().toString(), s.getModificationTime(), s.getLen()) for s in fs.listStatus(where)))


def serving(spark: SparkSession, d: str) -> str:
    """Folder of the sorted serving table and its fences, written once for a folder of tables, as an index is, so that each query only reads it."""
    key = (spark.sparkContext.applicationId, *(_files(spark, f"{d}/{name}.parquet") for name in ("part", "supplier")))
    if key not in _SERVING or not exists(spark, _SERVING[key]):
        order = ["name_key", "kind_rank", "name", "assembly_number", "key"]
        path = fresh(spark, "symbols")
        dense(bare_symbols(spark, d), order, "pos").sortWithinPartitions("pos").write.parquet(f"{path}/rows")  # already dealt by ranges of the order
        positions.fences(spark.read.parquet(f"{path}/rows")).sort("first").write.parquet(f"{path}/fences")
        _SERVING[key] = path
    return _SERVING[key]


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """Rows are sorted by name in files of name ranges; a prefix, or a range of places, reads few row groups."""
    return spark.read.parquet(f"{serving(spark, d)}/rows")


def fences(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{serving(spark, d)}/fences")


def references(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    li = table(spark, d, "lineitem")
    name = F.when(c("l_linenumber") == 1, "this").when(c("l_linenumber") == 2, "var").otherwise(F.concat(F.lit("n"), (c("l_orderkey") % 10).cast("string")))
    start = c("l_quantity").cast("int")
    return li.select(
        c("l_partkey").alias("to_id"), c("l_suppkey").alias("from_assembly"), c("l_orderkey").alias("file"), c("l_linenumber").cast("long").alias("line"),
        pick(F.concat("l_returnflag", "l_linestatus"), FLAGS, 8).alias("kind"), start.alias("col_start"), (start + 1 + c("l_linenumber")).alias("col_end"), name.alias("to_name"),
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("seq"), "l_shipdate",
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    n = _suppliers(spark, d)
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("from_assembly"), (F.col("l_partkey") % n).alias("to_assembly")).distinct()


def locations(spark: SparkSession, d: str) -> DataFrame:
    """(id, file, offset); ids are 16 hex digits.  Numbers are made distinct before they are made ids and names."""
    places = table(spark, d, "lineitem").select("l_partkey", (F.col("l_orderkey") % 50).alias("offset")).distinct()
    file = F.concat(F.lit("f"), F.lpad(F.col("offset").cast("string"), 2, "0"), F.lit(".cs"))
    return places.select(symbol_id(F.col("l_partkey").cast("string")).alias("id"), file.alias("file"), "offset")


ASM = "asm AS (SELECT s_suppkey AS pos, s_name AS assembly_name, CASE WHEN s_suppkey % 5 <> 0 THEN concat(r_name, chr(92), n_name, chr(92), s_name, '.csproj') END AS project_path FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
KEYED = ASM + """,
proj AS (SELECT pos, project_path, row_number() OVER (ORDER BY upper(project_path), pos) - 1 AS project_key FROM asm WHERE project_path IS NOT NULL),
keyed AS (SELECT asm.*, coalesce(project_key, -1) AS project_key FROM asm LEFT JOIN proj USING (pos))"""
SYM = """sym0 AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN upper(replace(p_name, ' ', '')) ELSE replace(p_name, ' ', '') END AS name, p_partkey % (SELECT count(*) FROM supplier) AS assembly_number,
  CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'LARGE' THEN 6 WHEN 'MEDIUM' THEN 48 WHEN 'PROMO' THEN 72 WHEN 'SMALL' THEN 102 WHEN 'STANDARD' THEN 108 END AS glyph,
  CASE p_type WHEN 'ECONOMY' THEN 'class' WHEN 'LARGE' THEN 'field' WHEN 'MEDIUM' THEN 'interface' WHEN 'PROMO' THEN 'method' WHEN 'SMALL' THEN 'property' WHEN 'STANDARD' THEN 'struct' END AS kind,
  CASE p_type WHEN 'LARGE' THEN 3 WHEN 'PROMO' THEN 2 WHEN 'SMALL' THEN 2 ELSE 1 END AS kind_rank, p_brand, p_type,
  substring(md5(concat('T:', p_brand, '.', p_name, ':', p_partkey)), 1, 16) AS symbol_id FROM part),
sym AS (SELECT *, concat(replace(p_brand, '#', '.'), '.', name, '(', p_type, ')') AS description, row_number() OVER (ORDER BY upper(name), kind_rank, name, assembly_number, key) - 1 AS pos FROM sym0)"""
REFS = """refs AS (SELECT l_partkey AS to_id, l_suppkey AS from_assembly, l_orderkey AS file, CAST(l_linenumber AS BIGINT) AS line,
  CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 0 WHEN 'AO' THEN 2 WHEN 'RF' THEN 3 WHEN 'RO' THEN 5 WHEN 'NF' THEN 6 ELSE 8 END AS kind, CAST(l_quantity AS INT) AS col_start, CAST(l_quantity AS INT) + 1 + l_linenumber AS col_end,
  CASE l_linenumber WHEN 1 THEN 'this' WHEN 2 THEN 'var' ELSE concat('n', l_orderkey % 10) END AS to_name, l_orderkey * 10 + l_linenumber AS seq, l_shipdate FROM lineitem)"""
EDGES = "edges AS (SELECT DISTINCT l_suppkey AS from_assembly, l_partkey % (SELECT count(*) FROM supplier) AS to_assembly FROM lineitem)"
LOCS = "locs AS (SELECT DISTINCT substring(md5(CAST(l_partkey AS VARCHAR)), 1, 16) AS id, concat('f', lpad(CAST(l_orderkey % 50 AS VARCHAR), 2, '0'), '.cs') AS file, l_orderkey % 50 AS \"offset\" FROM lineitem)"
