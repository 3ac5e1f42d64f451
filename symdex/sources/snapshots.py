"""Versions of a set of relations that readers see as a whole.

``publish`` writes all relations of a version to a folder of its own and then adds one small manifest, by a rename that fails if that version
exists.  Readers take the relations that the last manifest names: a build that fails leaves the version before readable, and nobody sees half of
one.  Old versions stay until ``retire`` deletes them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .storage import file_system


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, path = file_system(spark, f"{root}/versions")
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:1].isdigit())


def publish(spark: SparkSession, root: str, relations: dict[str, DataFrame]) -> int:
    """Write a version and switch to it; its number.  The order of the relations is kept."""
    folder = f"{root}/data/{uuid.uuid4().hex}"
    listed = []
    for name, df in relations.items():
        df.write.parquet(f"{folder}/{name}")
        listed.append({"name": name, "path": f"{folder}/{name}", "schema": df.schema.jsonValue()})
    text = json.dumps(listed).encode()
    while True:
        number = max(versions(spark, root), default=0) + 1
        fs, written = file_system(spark, f"{root}/versions/.{uuid.uuid4().hex}")
        out = fs.create(written, True)
        out.write(text, 0, len(text))
        out.close()
        _, final = file_system(spark, f"{root}/versions/{number:012d}.json")
        if not fs.exists(final) and fs.rename(written, final):
            return number
        fs.delete(written, False)  # another build was faster


def manifest(spark: SparkSession, root: str, version: int) -> list[dict]:
    return json.loads(spark.read.text(f"{root}/versions/{version:012d}.json", wholetext=True).first()["value"])


def load(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The relations of a version, or of the last one, in the order they were published; none without a version."""
    known = versions(spark, root)
    if version is None and not known:
        return {}
    listed = manifest(spark, root, version or known[-1])
    return {x["name"]: spark.read.schema(StructType.fromJson(x["schema"])).parquet(x["path"]) for x in listed}


def retire(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Delete all versions but the last ``keep``; the numbers of those that went.  The manifest goes first."""
    old = versions(spark, root)[:-keep]
    for number in old:
        listed = manifest(spark, root, number)
        fs, path = file_system(spark, f"{root}/versions/{number:012d}.json")
        fs.delete(path, False)
        for x in listed:
            fs, path = file_system(spark, x["path"])
            fs.delete(path, True)
    return old
