"""Symbol search: prefix lookup on a materialised key, filters, truncation, ranking and grouping.

Symbols: pos, name, name_key, assembly_number, glyph, symbol_id, description, and after ``decode`` also assembly_name,
project_path and kind.  ``name_key`` is the folded name (``text.fold_case``), so a prefix reaches the Parquet scan as StringStartsWith.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symdex.functions import querylang
from symdex.functions.symbols import TYPES, glyph_to_kind, kind_rank, match_level, weight
from symdex.functions.text import fold_case, folded, html_escape, url_encode

from .numbering import dense

MOST = 100
#: Order of the hits of a query.
ORDER = ("match_level", "kind_rank", "name", "assembly_number", "description", "pos", "reading")
#: Queries that are taken over all symbols at once.
QUERY_BLOCK = 1000


def prefix_search(names: DataFrame, word: str, key: str = "name_key") -> DataFrame:
    """Rows whose name starts with a word, whatever the case; all rows for an empty word."""
    return names.where(F.col(key).startswith(folded(word))) if word else names


def find_item(names: DataFrame, word: str, key: str = "name_key", order: str = "pos") -> DataFrame:
    """The first row in index order that starts with a word, if any."""
    return prefix_search(names, word, key).orderBy(order).limit(1)


def verbatim_filter(names: DataFrame, term: str, name: str = "name") -> DataFrame:
    return names.where(F.length(name) == len(term))


def filter_kind(kind: Column, kinds: Column) -> Column:
    """Any of the kinds; ``type`` stands for all kinds of types; no kinds: everything."""
    return (F.size(kinds) == 0) | F.array_contains(kinds, kind) | (F.array_contains(kinds, "type") & kind.isin(*TYPES))


def _holds(x: Column, part: Column) -> Column:
    return fold_case(F.coalesce(x, F.lit(""))).contains(fold_case(part))


def filter_path(project: Column, paths: Column) -> Column:
    return F.forall(paths, lambda p: _holds(project, p))


def filter_words(name: Column, assembly: Column, project: Column, words: Column) -> Column:
    return F.forall(words, lambda w: _holds(name, w) | _holds(assembly, w) | _holds(project, w))


def filter_namespace(description: Column, namespace: Column) -> Column:
    return _holds(F.substring_index(description, "(", 1), namespace)


def filter_assembly(assembly: Column, dotted: Column) -> Column:
    return (F.size(dotted) == 0) | F.exists(dotted, lambda d: _holds(assembly, d))


def filter_dotted(assembly: Column, description: Column, namespace: Column, dotted: Column) -> Column:
    """Without a namespace any dotted term may name assembly or namespace; with one, both must fit."""
    inside = F.exists(dotted, lambda d: filter_namespace(description, d))
    return F.when(namespace.isNull(), filter_assembly(assembly, dotted) | inside).otherwise(filter_assembly(assembly, dotted) & filter_namespace(description, namespace))


def decode(symbols: DataFrame, assemblies: DataFrame) -> DataFrame:
    """Adds assembly_name and project_path by the assembly's number, and kind by the icon; unknown numbers give null.

    Catalyst broadcasts the assemblies where their size allows it.
    """
    a = assemblies.select(F.col("pos").alias("assembly_number"), "assembly_name", "project_path")
    return symbols.join(a, "assembly_number", "left").withColumn("kind", glyph_to_kind(F.col("glyph")))


def candidates(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """Symbols that each interpretation's core is a prefix of; cores aren't empty.

    Queries are joined on the first three characters of their cores; shorter cores, which dotted terms can have, on as many as they
    have.  A stem that very many symbols have is split by Spark, as symbols are the streamed side of these joins.
    """
    q = queries.withColumn("core_key", fold_case("core")).withColumn("stem", F.substring("core_key", 1, 3))
    found = None
    for n in (1, 2, 3):
        one = symbols.withColumn("stem", F.substring("name_key", 1, n)).join(q.where(F.length("stem") == n), "stem")
        one = one.where(F.col("name_key").startswith(F.col("core_key"))).drop("stem", "core_key")
        found = one if found is None else found.unionByName(one)
    return found


def passes(q: Callable[[str], Column], empty: frozenset[str] = frozenset()) -> Column:
    """Whether a decoded symbol passes all filters of a query's interpretation; q: its column of a name.

    empty: parts of the interpretation that are known to be empty; filters that have nothing else to go by are left out.
    """
    c = F.col
    filters = (
        ({"verbatim"}, lambda: ~q("verbatim") | (F.length("name") == F.length(q("core")))),
        ({"kinds"}, lambda: filter_kind(c("kind"), q("kinds"))),
        ({"paths"}, lambda: filter_path(c("project_path"), q("paths"))),
        ({"words"}, lambda: filter_words(c("name"), c("assembly_name"), c("project_path"), q("words"))),
        ({"dotted", "namespace"}, lambda: filter_dotted(c("assembly_name"), c("description"), q("namespace"), q("dotted"))),
    )
    out = F.lit(True)
    for parts, test in filters:
        if not parts <= empty:
            out = out & test()
    return out


def hits_without_core(decoded: DataFrame, queries: DataFrame) -> DataFrame:
    """Decoded symbols that pass the filters of queries whose core is empty, which every name begins with.

    Such queries go along with the symbols as an array of ``QUERY_BLOCK`` at most at a time; only those that a symbol passes are made rows.
    """
    blocks = -(-queries.count() // QUERY_BLOCK)
    found = decoded.where("false").withColumns({k: F.lit(None).cast(t) for k, t in queries.dtypes})
    for i in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id", "reading"), F.lit(blocks)) == i).agg(F.collect_list(F.struct(*queries.columns)).alias("block"))
        passed = F.filter("block", lambda q: passes(lambda name: q[name]))
        found = found.unionByName(decoded.crossJoin(F.broadcast(part)).withColumn("q", F.explode(passed)).select(*decoded.columns, "q.*"))
    return found


def all_hits(symbols: DataFrame, assemblies: DataFrame, queries: DataFrame) -> DataFrame:
    """Every symbol that each interpretation (``querylang.parsed``) finds, neither cut nor ranked.

    The results of a query's interpretations are a bag: a symbol that two of them find is there twice.
    """
    hits = decode(candidates(symbols, queries.where("core <> ''")), assemblies).where(passes(F.col))
    return hits.unionByName(hits_without_core(decode(symbols, assemblies), queries.where("core = ''")))


def find_symbols(symbols: DataFrame, assemblies: DataFrame, queries: DataFrame, most: int = MOST) -> DataFrame:
    """The hits of all interpretations of all queries, each interpretation's cut to ``most`` in index order, then ranked."""
    cut = Window.partitionBy("query_id", "reading").orderBy("pos")
    hits = all_hits(symbols, assemblies, queries)
    return ranked(hits.withColumn("n", F.row_number().over(cut)).where(F.col("n") <= most).drop("n"))


def ranked(hits: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Adds match_level, kind_rank, weight and rank (from 1) within each query."""
    return _placed(weighed(hits), by)


def weighed(hits: DataFrame) -> DataFrame:
    """Adds match_level, kind_rank and weight."""
    c = F.col
    hits = hits.withColumn("match_level", match_level(c("name"), c("core"))).withColumn("kind_rank", kind_rank(c("kind")))
    return hits.withColumn("weight", weight(c("match_level"), c("kind_rank")))


def _placed(hits: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*ORDER)))


def ranked_range(hits: DataFrame) -> DataFrame:
    """The same for the hits of one query, of which there may be any number: sorted by ranges and numbered on from range to range."""
    return dense(weighed(hits), [*ORDER], "rank").withColumn("rank", F.col("rank") + 1)


def potential_raw(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, potential): size of the prefix range of the last interpretation whose range isn't empty."""
    n = candidates(symbols, queries.where("core <> ''")).groupBy("query_id", "reading").agg(F.count("*").alias("n"))
    n = n.unionByName(queries.where("core = ''").select("query_id", "reading").crossJoin(F.broadcast(symbols.agg(F.count("*").alias("n")).where("n > 0"))))
    return n.groupBy("query_id").agg(F.max_by("n", "reading").alias("potential"))


def group_results(hits: DataFrame, referencing: DataFrame) -> DataFrame:
    """(query_id, place, assembly_number, assembly_weight, references, symbols): groups by lightest symbol, most references, first rank."""
    g = hits.groupBy("query_id", "assembly_number").agg(
        F.min("weight").alias("assembly_weight"), F.min("rank").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]).alias("symbols")
    )
    g = g.join(referencing.select(F.col("assembly").alias("assembly_number"), F.col("n").alias("references")), "assembly_number", "left").withColumn("references", F.coalesce("references", F.lit(0).cast("long")))
    order = Window.partitionBy("query_id").orderBy("assembly_weight", F.desc("references"), "first")
    return g.withColumn("place", F.row_number().over(order))


def result_count(hits: DataFrame, potential: DataFrame) -> DataFrame:
    """(query_id, shown, message) with the size of the prefix range where the cut was reached."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("shown")).join(potential, "query_id", "left")
    total = F.greatest("shown", F.coalesce("potential", F.lit(0)))
    text = F.when(F.col("shown") >= MOST, F.format_string("Displaying top %d results out of %d", F.lit(MOST).cast("long"), total)).otherwise(F.format_string("%d results found", "shown"))
    return n.select("query_id", "shown", text.alias("message"))


def top_k(names: DataFrame, word: str, most: int = MOST, order: str = "pos") -> DataFrame:
    """The first ``most`` rows of a prefix range in index order, as a top-k of each partition and then of these."""
    return prefix_search(names, word).orderBy(order).limit(most)


def find_assemblies(assemblies: DataFrame, term: str | None, default_to_all: bool = False) -> DataFrame:
    """Assemblies with a project by prefix (exact length if quoted), 100 at most; without a term all or none."""
    listed = assemblies.where(F.col("project_key") != -1)
    if not term:
        return listed if default_to_all else listed.limit(0)
    quoted = len(term) > 1 and term[0] == term[-1] == '"'
    bare = term[1:-1] if quoted else term
    found = prefix_search(listed, bare, "assembly_key")
    return (verbatim_filter(found, bare, "assembly_name") if quoted else found).orderBy("pos").limit(MOST)


def find_projects(projects: DataFrame, assemblies: DataFrame, term: str) -> DataFrame:
    """Projects by prefix of their path with the last assembly of each."""
    last = assemblies.where(F.col("project_key") != -1).groupBy("project_key").agg(F.max_by("assembly_name", "pos").alias("assembly_name"))
    return prefix_search(projects, term, "project_name_key").join(last, "project_key").orderBy("project_key").limit(MOST)


def find_guids(names: DataFrame, term: str) -> DataFrame:
    return prefix_search(names, term.lstrip("{(").rstrip("})")).orderBy("name").limit(MOST)


def find_in_list(names: DataFrame, category: str, term: str | None, default_to_all: bool = False) -> DataFrame:
    """Build properties, items, targets or tasks by prefix; without a term all or none."""
    own = names.where(F.col("category") == category)
    if not term:
        return own if default_to_all else own.limit(0)
    return prefix_search(own, term).orderBy("name").limit(MOST)


def lookup_symbol_url(symbols: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, url) for 16 hex digits or the text that they are the hash of; the last symbol with an id wins."""
    from symdex.functions.ids import symbol_id
    from symdex.functions.symbols import url

    last = symbols.groupBy("symbol_id").agg(F.max_by("assembly_name", "pos").alias("assembly_name"))
    key = F.when(F.col("asked").rlike("^[0-9A-Fa-f]{16}$"), F.lower("asked")).otherwise(symbol_id(F.col("asked")))
    return asked.withColumn("symbol_id", key).join(last, "symbol_id").select("asked", url(F.col("assembly_name"), F.col("symbol_id")).alias("url"))


def no_hit_links(queries: DataFrame, found: DataFrame, bases: tuple[str, ...]) -> DataFrame:
    """(query_id, link): for each query without hits the addresses to search on at.  queries: query_id, query; found: the query_id of those with hits."""
    term = html_escape(url_encode(F.col("query")))
    without = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return without.select("query_id", F.explode(F.array(*(F.concat(F.lit(b), term) for b in bases))).alias("link"))


def usage(requests: DataFrame) -> DataFrame:
    """(user_key, n): requests of each user, whatever the case of the name.  requests: user."""
    return requests.groupBy(F.lower("user").alias("user_key")).agg(F.count("*").alias("n"))


def search(symbols: DataFrame, assemblies: DataFrame, text: str, most: int = MOST) -> DataFrame:
    """One query, from its text to ranked symbols.

    Its interpretations (a few) are made on the driver, so that each core is a literal prefix in the scan of the symbols and each cut is a
    top-k, without a join with the queries.  Assemblies are joined with the cut, and before it only where a filter asks for them.
    """
    spark = symbols.sparkSession
    readings = querylang.parsed(querylang.rows(spark, text))
    types = dict(readings.dtypes)
    found = None
    for r in readings.collect():
        empty = frozenset(k for k in types if not r[k])
        early = not {"paths", "words", "dotted", "namespace"} <= empty
        hits = prefix_search(symbols, r["core"])
        hits = decode(hits, assemblies) if early else hits.withColumn("kind", glyph_to_kind(F.col("glyph")))
        hits = weighed(hits.withColumns({k: _literal(r[k], types[k]) for k in types}).where(passes(F.col, empty)))
        hits = hits.orderBy("pos").limit(most)
        hits = hits if early else decode(hits, assemblies)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = weighed(decode(symbols, assemblies).withColumns({k: F.lit(None).cast(t) for k, t in types.items()})).limit(0)
    return _placed(found).orderBy("rank")


def _literal(value, kind: str) -> Column:
    return (F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)).cast(kind)
