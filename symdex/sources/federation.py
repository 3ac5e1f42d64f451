"""Lists of assemblies that other servers have, read by one task for each server."""

from __future__ import annotations

import os
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from symdex.functions.text import fold_case

# Fixed value: the name of a server's list.
LIST = "Assemblies.txt"
SCHEMA = "server int, name string, note string"
TIMEOUT = 30


def listed(address: str) -> Iterator[str]:
    """Lines of a server's list: below a web address, in a file, or in the parts of a folder (a shared mount) in the order of their names."""
    parsed = urlparse(address)
    if parsed.scheme in ("http", "https"):
        with urllib.request.urlopen(f"{address.rstrip('/')}/{LIST}", timeout=TIMEOUT) as answer:
            for line in answer:
                yield line.decode("utf-8-sig").rstrip("\r\n")
        return
    path = parsed.path if parsed.scheme == "file" else address
    files = [path]
    if os.path.isdir(path):
        own = os.path.join(path, LIST)
        files = [own] if os.path.exists(own) else [os.path.join(path, f) for f in sorted(os.listdir(path)) if f.startswith("part-")]
    for file in files:
        with open(file, encoding="utf-8-sig") as f:
            for line in f:
                yield line.rstrip("\r\n")


class _Server(InputPartition):
    def __init__(self, number: int, address: str):
        super().__init__(number)
        self.address = address


class _Reader(DataSourceReader):
    def __init__(self, addresses: list[str]):
        self.addresses = addresses

    def partitions(self) -> list[_Server]:
        return [_Server(i, a) for i, a in enumerate(self.addresses)]

    def read(self, partition: _Server) -> Iterator[tuple]:
        try:
            for line in listed(partition.address):
                name = line.partition(";")[0]
                if name:
                    yield partition.value, name, None
        except OSError as e:  # a server that can't be reached has no assemblies
            yield partition.value, None, f"{type(e).__name__}: {partition.address}"


class Federation(DataSource):
    """Format ``federation``: option ``servers`` holds the addresses, one on a line; a server's number is its place."""

    @classmethod
    def name(cls) -> str:
        return "federation"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader([a for a in self.options.get("servers", "").split("\n") if a])


def scan(spark: SparkSession, addresses: list[str]) -> DataFrame:
    """(server, name, note): the assemblies of each server, and a note for each one that isn't there or breaks off."""
    spark.dataSource.register(Federation)
    if not addresses:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.format("federation").option("servers", "\n".join(addresses)).load()


def keys(found: DataFrame) -> DataFrame:
    """(server, assembly_key): each assembly once whatever its case."""
    return found.where("name is not null").select("server", fold_case(F.col("name")).alias("assembly_key")).distinct()
