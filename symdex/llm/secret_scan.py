"""Secret scans with an incremental blob ledger.

Every version of every path is a blob, addressed by the SHA-256 of its text.  The ledger holds one row for each blob and scan: the rules
(name and version) it was scanned with, and what they found.  A scan looks only at pairs of blob and rule version that the ledger doesn't
have, once for each blob however many paths and versions hold it; findings are then joined back to all paths.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import find
from .support import stored

_KEYWORDS = "(?i:password|passwd|secret|token|api_?key)"
_ASSIGN = _KEYWORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""

#: Rule -> (version, pattern, group that the least length holds for, least length).  A new version is scanned anew.
BASE = ("assign", "access", "hex")
RULES: dict[str, tuple[int, str, int, int]] = {
    "assign": (1, _ASSIGN, 1, 12),
    "access": (1, r"AKIA[A-Z0-9]++", 0, 18),
    "hex": (1, r"(?<![0-9a-f])[0-9a-f]{16,}+", 0, 16),
    "private_key": (1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    "signed_token": (1, r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++", 0, 1),
    "prefixed": (1, r"(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+)", 0, 1),
}
FOUND = "array<struct<start: int, rank: int, stop: int, kind: string>>"


def quick(text: Column, rule: str) -> Column:
    """A cheap condition that every text with a match of the rule fulfils."""
    return {
        "assign": lambda: text.rlike(_KEYWORDS + r"""["']?\x20*[:=]"""),
        "access": lambda: text.contains("AKIA"),
        "hex": lambda: text.rlike("[0-9a-f]{16}"),
        "private_key": lambda: text.contains("PRIVATE KEY-----"),
        "signed_token": lambda: text.contains("eyJ"),
        "prefixed": lambda: text.contains("gh") & text.rlike("gh[pousr]_") | text.contains("xox"),
    }.get(rule, lambda: F.lit(True))()


def scan(text: Column, todo: Column, rules: dict[str, tuple[int, str, int, int]]) -> Column:
    """What the rules of ``todo`` (name@version) find, by start, then by rule."""
    def of_rule(rank: int, name: str) -> Column:
        version, pattern, group, least = rules[name]
        spans = find(text, pattern, F.array_contains(todo, f"{name}@{version}") & quick(text, name), group)
        long = F.filter(spans, lambda s: F.length(s["value"]) >= least)
        return F.transform(long, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(name).alias("kind")))

    each = [of_rule(rank, name) for rank, name in enumerate(rules)]
    return F.array_sort(F.concat(*each)).cast(FOUND)


def versions(documents: DataFrame, path: str = "doc_id") -> DataFrame:
    """(path, blob, text); a null text is the empty blob."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col(path).alias("path"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))


def unseen(history: DataFrame, ledger: DataFrame | None, rules: dict) -> DataFrame:
    """(blob, path, todo): each blob with one path that holds it, and the rule versions it has not been scanned with."""
    wanted = F.array(*(F.lit(f"{name}@{rule[0]}") for name, rule in rules.items()))
    blobs = history.groupBy("blob").agg(F.min("path").alias("path")).withColumn("todo", wanted)
    if ledger is None:
        return blobs
    seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    left = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except("todo", F.coalesce("seen", F.array().cast("array<string>"))))
    return left.where(F.size("todo") > 0).drop("seen")


def scanned(history: DataFrame, ledger: DataFrame | None = None, rules: dict | None = None) -> DataFrame:
    """New rows of the ledger: (blob, rules, found)."""
    rules = rules or RULES
    todo = unseen(history, ledger, rules).select(F.col("blob").alias("b"), F.col("path").alias("p"), "todo")
    # only blobs without a path fall on a null key; they are few (one for each such blob)
    text = history.join(todo.hint("shuffle_hash"), (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("p"))).select("blob", "todo", "text")
    return text.select("blob", F.col("todo").alias("rules"), scan(F.col("text"), F.col("todo"), rules).alias("found"))


def by_path(history: DataFrame, ledger: DataFrame) -> DataFrame:
    """(path, blob, found): findings of each version of each path."""
    found = ledger.where(F.size("found") > 0).select(F.col("blob").alias("b"), "found")
    none = F.array().cast(FOUND)
    return history.select("path", "blob").join(found, F.col("blob") == F.col("b"), "left").select("path", "blob", F.coalesce("found", none).alias("found"))


def report(documents: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Counts of the base kinds per document, the digest of their spans, and all spans as kind:start:stop.

    A null text is the empty blob and has none.  Repeated rows are reported each by itself.  ledger: what earlier scans have found; without one every
    distinct text is scanned.
    """
    history = versions(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    new = stored(scanned(history, ledger).dropDuplicates(["blob"]), "ledger")
    whole = new if ledger is None else merged(ledger, new)
    out = by_path(history, whole)
    told = lambda f: F.array_join(F.transform(f, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return out.select(F.col("path").alias("doc_id"), *(count(k) for k in BASE), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))


def merged(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each blob: findings of the newest scan of each rule."""
    both = ledger.withColumn("scan", F.lit(0)).unionByName(new.withColumn("scan", F.lit(1)))
    rule = F.split("rule", "@")
    each = both.select("blob", "scan", "found", F.explode("rules").alias("rule"))
    each = each.select("blob", F.struct("scan", rule[1].cast("int").alias("version")).alias("age"), rule[0].alias("kind"), F.expr("filter(found, f -> f.kind = split(rule, '@')[0])").alias("found"), "rule")
    last = each.groupBy("blob", "kind").agg(F.max_by("found", "age").alias("found"), F.max_by("rule", "age").alias("rule"))
    return last.groupBy("blob").agg(F.collect_list("rule").alias("rules"), F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
