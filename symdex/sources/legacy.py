"""Text formats of the index, and a binary symbol table.

``lines`` gives the lines of files with their numbers; the ``parse_*`` functions turn such rows (file, line, value) into relations, and
the ``*_lines`` functions make text of relations.  Files are small (one for each assembly), so each is one row until it is cut.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symdex.functions.text import escape_semicolons, fold_case

from .storage import file_system


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, from line 0."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\r?\n\z", "").alias("value"))
    return whole.where("value <> ''").select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))


def folder_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same for a list that was written in sorted parts: all files of a folder as one, numbered on in the order of their names.

    Only the parts' sizes, of which there are as many as the writer had partitions, are summed in one place.
    """
    own = lines(spark, path)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = own.groupBy("file").agg((F.max("line") + 1).alias("n"))
    starts = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return own.join(F.broadcast(starts), "file").select(F.lit(path).alias("file"), (F.col("line") + F.col("before")).alias("line"), "value")


def write_lines(rows: DataFrame, path: str) -> None:
    """rows: value.  Sorted rows are written in parts whose names keep the order; ``folder_lines`` reads them as one list."""
    rows.select("value").write.text(path)


def _number(x: Column, otherwise: int = 0) -> Column:
    return F.coalesce(x.try_cast("long"), F.lit(otherwise).cast("long"))


def parse_assemblies(rows: DataFrame) -> DataFrame:
    """``name;projectKey;referencingCount``."""
    p = F.split("value", ";")
    return rows.select(F.col("line").alias("pos"), p[0].alias("assembly_name"), _number(F.get(p, F.lit(1)), -1).alias("project_key"), _number(F.get(p, F.lit(2))).alias("referencing_count"))


def assembly_lines(assemblies: DataFrame) -> DataFrame:
    return assemblies.select(F.concat_ws(";", "assembly_name", "project_key", "referencing_count").alias("value"))


def parse_projects(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("line").alias("project_key"), F.col("value").alias("project_path"))


def parse_declarations(rows: DataFrame) -> DataFrame:
    """``name;id;kind;description;glyph``; other numbers of fields are dropped, a bad glyph is 0, the last of an id wins."""
    p = F.split("value", ";")
    own = rows.where(F.size(p) == 5).select("file", "line", p[0].alias("name"), p[1].alias("id"), p[2].alias("kind"), p[3].alias("description"), _number(p[4]).alias("glyph"))
    return own.groupBy("file", "id").agg(F.max_by(F.struct("name", "kind", "description", "glyph"), "line").alias("s")).select("file", "id", "s.*")


def declaration_lines(symbols: DataFrame) -> DataFrame:
    """Sorted by name and id."""
    return symbols.orderBy("name", "id").select(F.concat_ws(";", "name", "id", "kind", escape_semicolons(F.col("description")), F.col("glyph").cast("string")).alias("value"))


def parse_references(rows: DataFrame) -> DataFrame:
    """Two lines a record: ``fromAssembly;url;localPath;line;start;end[;kind]`` and the text of the line."""
    pairs = rows.groupBy("file", F.floor(F.col("line") / 2).alias("record")).agg(F.min_by("value", "line").alias("head"), F.max_by("value", "line").alias("line_text"))
    p = F.split("head", ";")
    n = lambda i: _number(F.get(p, F.lit(i)))
    return pairs.where(F.size(p).isin(6, 7)).select(
        "file", "record", p[0].alias("from_assembly"), p[1].alias("url"), p[2].alias("local_path"), n(3).alias("line"), n(4).alias("col_start"), n(5).alias("col_end"), n(6).alias("kind"), "line_text"
    )


def reference_lines(refs: DataFrame) -> DataFrame:
    head = F.concat_ws(";", "from_assembly", "url", "local_path", "line", "col_start", "col_end", "kind")
    return refs.select("to_id", F.concat(head, F.lit("\n"), F.col("line_text")).alias("value"))


def write_references(refs: DataFrame, path: str) -> None:
    """The fact table by target assembly, and in it by target.

    Rows are dealt by ranges of target and place, so a much used target is spread over several files and tasks.
    """
    places = [x for x in ("from_assembly", "file", "line", "seq") if x in refs.columns]
    refs.repartitionByRange("to_assembly", "to_id", *places).sortWithinPartitions("to_assembly", "to_id").write.partitionBy("to_assembly").parquet(path)


def append_references(refs: DataFrame, path: str, project: str = "from_assembly") -> None:
    """Add the facts of a run to a fact table that is kept by project.

    The facts of each project in refs replace those that an earlier run wrote for it, those of other projects stay; so a run can be repeated, and a number of
    runs over parts of a solution give what one run over all of it gives.  Rows are dealt by ranges of project and target, so that a large project or a much used
    target has several files, each of a narrow range of targets.
    """
    places = [x for x in ("to_assembly", "to_id", "file", "line", "seq") if x in refs.columns]
    dealt = refs.withColumn("project", F.col(project)).repartitionByRange("project", *places).sortWithinPartitions("project", *places)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(path)


def forget_projects(spark: SparkSession, path: str, projects: list[str]) -> None:
    """Delete the facts of projects that a run found without any."""
    for name in projects:
        fs, where = file_system(spark, f"{path}/project={name}")
        fs.delete(where, True)


def discover(spark: SparkSession, path: str) -> DataFrame:
    """(project): the assemblies that an index holds references for, from the names of its folders; no row is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.select(F.regexp_extract("path", "/to_assembly=([^/]*)/", 1).alias("project")).where("project <> ''").distinct()


def parse_members(rows: DataFrame) -> DataFrame:
    """``id;assembly;id``; the last of an id wins for base members, interface members form a set."""
    p = F.split("value", ";")
    return rows.where(F.size(p) == 3).select("file", "line", p[0].alias("member_id"), p[1].alias("base_assembly"), p[2].alias("base_id"))


def base_members(members: DataFrame) -> DataFrame:
    return members.groupBy("file", "member_id").agg(F.max_by(F.struct("base_assembly", "base_id"), "line").alias("s")).select("file", "member_id", "s.*")


def interface_members(members: DataFrame) -> DataFrame:
    return members.select("file", "member_id", "base_assembly", "base_id").distinct()


INFO = ("ProjectSourcePath", "DocumentCount", "LinesOfCode", "BytesOfCode", "DeclaredSymbols", "DeclaredTypes", "PublicTypes")


def parse_project_info(rows: DataFrame) -> DataFrame:
    """``key=value``: the first of a key wins, a missing text is empty, a bad number 0."""
    key, value = F.regexp_extract("value", "^([^=]*)=", 1), F.regexp_extract("value", "^[^=]*=(.*)$", 1)
    first = rows.where(F.col("value").contains("=")).groupBy("file", key.alias("key")).agg(F.min_by(value, "line").alias("v"))
    wide = first.groupBy("file").pivot("key", list(INFO)).agg(F.first("v"))
    return wide.select("file", F.coalesce(INFO[0], F.lit("")).alias(INFO[0]), *(_number(F.col(k)).alias(k) for k in INFO[1:]))


def parse_declaration_map(rows: DataFrame) -> DataFrame:
    """``=id`` and then ``file;offset`` lines.

    A file is one row of text before it is cut, and each assembly has files of its own, so a window over a file holds no more than a task has read.
    """
    head = F.col("value").startswith("=")
    w = Window.partitionBy("file").orderBy("line")
    own = rows.withColumn("id", F.last(F.when(head, F.substring("value", 2, 1 << 20)), ignorenulls=True).over(w)).where(~head & F.col("id").isNotNull())
    p = F.split("value", ";")
    return own.select("file", "id", p[0].alias("path"), _number(F.get(p, F.lit(1))).alias("offset"))


def parse_names(rows: DataFrame) -> DataFrame:
    """One name a line, up to a semicolon."""
    return rows.select("file", F.substring_index("value", ";", 1).alias("name"))


def federation(rows: DataFrame, servers: DataFrame) -> DataFrame:
    """(server, assembly_key) from lists of assemblies; servers: file, server."""
    return parse_names(rows).join(servers, "file").select("server", fold_case("name").alias("assembly_key")).distinct()


def pending(names: DataFrame, processed: DataFrame) -> DataFrame:
    """Names that aren't processed yet, whatever the case."""
    done = processed.select(fold_case("name").alias("k")).distinct()
    return names.join(done, fold_case("name") == F.col("k"), "left_anti")


def parse_invocations(rows: DataFrame) -> DataFrame:
    """Three lines a record: project path, output path, arguments."""
    n = F.pmod(F.col("line"), F.lit(3))
    at = lambda k: F.max(F.when(n == k, F.col("value")))
    return rows.groupBy("file", F.floor(F.col("line") / 3).alias("record")).agg(at(0).alias("project_path"), at(1).alias("output_path"), at(2).alias("arguments"))


def pending_invocations(invocations: DataFrame, processed: DataFrame) -> DataFrame:
    named = invocations.where("coalesce(project_path, '') <> '' and coalesce(arguments, '') <> ''").withColumn("name", F.col("project_path"))
    return pending(named, processed).select("project_path", "output_path", "arguments").distinct()


def names_of(refs: DataFrame, assembly: str) -> DataFrame:
    """Names in the list that a pseudo assembly stands for."""
    return refs.where(F.col("to_assembly") == assembly).select(F.col("to_symbol").alias("name")).distinct().withColumn("name_key", fold_case("name"))


def write_index(symbols: DataFrame, path: str) -> bool:
    """The serving table, sorted and dealt by name so that a prefix reads few row groups; nothing is written for no rows."""
    if symbols.isEmpty():
        return False
    symbols.repartitionByRange("name_key", "kind_rank", "name", "assembly_number").sortWithinPartitions("name_key", "kind_rank", "name", "assembly_number").write.parquet(path)
    return True


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# Binary symbol table: int32 count, then for each symbol its assembly number, name, id, description and icon.


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def pack_symbols(rows: list[tuple[int, str, str, bytes, int]]) -> bytes:
    """(assembly_number, name, id as 16 hex digits, description bytes, glyph)."""
    out = [struct.pack("<i", len(rows))]
    for assembly, name, key, description, glyph in rows:
        raw = name.encode()
        out += [_varint(assembly), _varint(len(raw)), raw, bytes.fromhex(key), _varint(len(description)), description, _varint(glyph)]
    return b"".join(out)


def unpack_symbols(data: bytes) -> Iterator[tuple[int, str, str, bytes, int]]:
    at = 4

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 0x7F) << shift
            if b < 0x80:
                return n
            shift += 7

    def chunk(size: int) -> bytes:
        nonlocal at
        at += size
        return data[at - size : at]

    for _ in range(struct.unpack_from("<i", data)[0]):
        yield number(), chunk(number()).decode(), chunk(8).hex(), chunk(number()), number()


def scan_symbol_index(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Symbols of binary tables, files of a folder or (packed) rows that ``write_symbol_index`` has written; each is read by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(file, i, *x) for i, x in enumerate(unpack_symbols(bytes(content)))]
                yield pd.DataFrame(rows, columns=["file", "pos", "assembly_number", "name", "symbol_id", "description", "glyph"])

    files = spark.read.parquet(path) if packed else spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInPandas(run, "file string, pos long, assembly_number int, name string, symbol_id string, description binary, glyph int")


def write_symbol_index(symbols: DataFrame, path: str, rows: int = 100_000) -> None:
    """Binary tables of up to ``rows`` symbols, as rows (path, content) in Parquet: each is bounded, and no task writes files by itself.

    symbols: assembly_number, name, symbol_id, description, glyph.
    """
    names = ["assembly_number", "name", "symbol_id", "description", "glyph"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), rows):
                part = batch.iloc[i : i + rows]
                values = zip(*(part[n].tolist() for n in names), strict=True)
                yield pd.DataFrame({"path": [f"{part['symbol_id'].iloc[0]}.bin"], "content": [pack_symbols([(a, n, k, t.encode(), g) for a, n, k, t, g in values])]})

    symbols.select(*names).mapInPandas(run, "path string, content binary").write.parquet(path)


def is_managed(content: Column) -> Column:
    """Whether a file is a managed program image: PE header, known magic and a runtime header entry."""

    def number(at: Column, size: int) -> Column:
        part = F.hex(F.substring(content, at + 1, F.lit(size)))
        order = F.concat(*(F.substring(part, 2 * i + 1, 2) for i in reversed(range(size))))
        return F.conv(order, 16, 10).cast("long")

    pe = number(F.lit(0x3C), 4)
    magic = number(pe + 24, 2)
    table = pe + 24 + F.when(magic == 0x20B, 112).otherwise(96)
    shape = (F.length(content) > 0x40) & (F.substring(content, 1, 2) == F.lit(b"MZ")) & (F.substring(content, pe + 1, F.lit(4)) == F.lit(b"PE\0\0"))
    return F.coalesce(shape & magic.isin(0x10B, 0x20B) & (number(table + 14 * 8, 4) != 0), F.lit(False))


ANALYZED = "fileName string, syntacticClassifications array<struct<start: int, length: int, classification: string>>, semanticClassifications array<struct<start: int, length: int, classification: string>>, references string"


def scan_analyzed(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Analysed script files, one JSON object each, or with ``lines`` one on each line, so that large files can be cut."""
    found = spark.read.schema(ANALYZED).json(path, multiLine=not lines).select("*", F.col("_metadata.file_name").alias("source"))
    return found.where(~F.col("source").isin("ok.json", "error.json"))
