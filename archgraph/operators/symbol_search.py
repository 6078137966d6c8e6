"""Substring search over symbol names with a trigram index.

The index posts every symbol under the distinct trigrams of its lower-cased
qualified name, padded at the end, so that each place of a name begins one. A
query of three letters or more meets the postings of its rarest trigrams only,
and only symbols in all of them are compared with the query. A shorter query
meets the postings of the trigrams that begin with it. Symbols that cannot
match are never paired with a query.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.functions.text import contains_ignoring_case, strip
from archgraph.operators.topk import top_k
from archgraph.schemas import SEARCHABLE_TYPES
from archgraph.session import materialize

# Fixed value: default number of rows.
SEARCH_LIMIT = 20
GRAM = 3
# Of a query's trigrams, the rarest that are intersected.
INTERSECTED = 3

_PAD = "\x00" * (GRAM - 1)


class SymbolIndex(NamedTuple):
    names: DataFrame  # repo_id, uid and the columns shown
    postings: DataFrame  # repo_id, gram, uid
    grams: DataFrame  # repo_id, gram, n (symbols posted)


def _grams(text: Column, last: Column) -> Column:
    """Distinct trigrams of a text that begin at the places 1 to ``last``."""
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda place: F.substr(text, place, F.lit(GRAM))))


def symbol_index(nodes: DataFrame) -> SymbolIndex:
    """The index of all searchable symbols, as written tables."""
    names = materialize(
        nodes.filter(F.col("symbol_type").isin(*SEARCHABLE_TYPES)).select(
            "repo_id", "uid", "symbol_type", "name", "qualified_name", "file_path", "start_line"),
        "symbol-names")
    low = F.lower("qualified_name")
    grams = _grams(F.concat(low, F.lit(_PAD)), F.length(low))
    postings = materialize(names.select("repo_id", F.explode(grams).alias("gram"), "uid").sortWithinPartitions("repo_id", "gram"), "symbol-grams")
    counted = materialize(postings.groupBy("repo_id", "gram").agg(F.count("*").alias("n")), "gram-counts")
    return SymbolIndex(names, postings, counted)


def candidates(asked: DataFrame, index: SymbolIndex) -> DataFrame:
    """Symbols that can match: query_id, repo_id, uid. ``asked`` has query_id, repo_id and the lower-cased ``part``."""
    key = ["query_id", "repo_id"]
    long = asked.filter(F.length("part") >= GRAM)
    own = long.select(*key, F.explode(_grams(F.col("part"), F.length("part") - (GRAM - 1))).alias("gram"))
    counted = own.join(index.grams, ["repo_id", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = materialize(top_k(counted, key, [F.col("n"), F.col("gram")], INTERSECTED), "rarest-grams")
    # A trigram that no symbol has leaves its query without a candidate.
    wanted = rarest.groupBy(*key).agg(F.count("*").alias("wanted"), F.min("n").alias("least")).filter(F.col("least") > 0)
    met = (
        index.postings.join(rarest.select(*key, "gram").join(wanted.select(*key), key, "left_semi"), ["repo_id", "gram"])
        .groupBy(*key, "uid").agg(F.count("*").alias("met"))
    )
    in_all = met.join(wanted, key).filter(F.col("met") == F.col("wanted")).select(*key, "uid")
    short = asked.filter(F.length("part") < GRAM)
    begins = F.explode(F.array(*[F.substr("gram", F.lit(1), F.lit(n)) for n in range(1, GRAM)])).alias("part")
    begun = materialize(index.grams.select("repo_id", "gram", begins).distinct().join(short, ["repo_id", "part"]).select(*key, "gram"), "short-grams")
    return in_all.unionByName(index.postings.join(begun, ["repo_id", "gram"]).select(*key, "uid").distinct())


def search_symbols(nodes: DataFrame, queries: DataFrame, limit: int = SEARCH_LIMIT, index: SymbolIndex | None = None) -> DataFrame:
    """Case-insensitive substring search; queries are (query_id, repo_id, query).

    Shortest names first. Blank queries find nothing. ``index`` is that of the
    nodes; without one it is built first.
    """
    index = symbol_index(nodes) if index is None else index
    asked = materialize(
        queries.select("query_id", "repo_id", strip(F.col("query")).alias("query")).filter(F.col("query") != "")
        .withColumn("part", F.lower("query")).distinct(),
        "asked-symbols")
    found = candidates(asked.select("query_id", "repo_id", "part").distinct(), index).join(asked.drop("part"), ["query_id", "repo_id"])
    matches = found.join(index.names, ["repo_id", "uid"]).filter(contains_ignoring_case(F.col("qualified_name"), F.col("query")))
    return top_k(matches, ["query_id"], [F.length("qualified_name"), F.col("uid")], limit)
