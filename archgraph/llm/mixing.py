"""Mixing of sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source is expected in the mix as often as the source's
target asks for. The expected copies are summed up in an order of the source's
documents, one offset per source, random but fixed by the seed, is added, and a
document is emitted once for every integer that its stretch of the sum crosses.
Documents stand in that order by size, first every other one upwards and then
the rest downwards: the sample is spread evenly over sizes, and what the way up
takes too much the way down makes up for, so words stay close to the target.

Null and empty texts have size 0. A null source is a source of its own, the
last in order. Repeated rows are separate documents. Without any words all
targets are 0 and nothing is taken. An input column that has the name of a
result column is replaced by it.
"""

from pyspark.sql import functions as F

from archgraph.llm.order import whole_row, with_position, written_in_order
from archgraph.session import materialize

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 20240229
_STEPS = 1 << 24  # copies and offsets are counted in this fraction of a document, in whole numbers

WORD = r"[^\x20\x09-\x0D]+"


def words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized, weights=WEIGHTS, most_copies=MOST_COPIES):
    """One row per source: ``source``, ``source_docs``, ``source_size``, ``target``, ``source_start``.

    ``sized`` has ``source`` and ``size``. Weights repeat over the sources in
    code point order, nulls last, and share out all words. A target stops at
    ``most_copies`` times its source's words and the excess is shared again by
    weight. The share per unit of weight only rises, so the sharing is a loop
    over one number; its table has one row per source and stays distributed.
    """
    totals = sized.groupBy("source").agg(F.count(F.lit(1)).alias("source_docs"), F.sum("size").alias("source_size"))
    ordered = written_in_order(totals, [F.col("source").asc_nulls_last()], "sources")
    turn = F.pmod("source_number", F.lit(len(weights))) + 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int"))
    limit = F.col("source_size") * float(most_copies)
    sources = materialize(with_position(ordered, "source_number").select("*", weight.alias("weight"), limit.alias("limit")), "weighted-sources")

    total, unit = float(sources.agg(F.sum("source_size")).first()[0] or 0), 0.0
    while total:
        open_ = F.col("limit") > F.col("weight") * F.lit(unit)
        row = sources.agg(
            F.coalesce(F.sum(F.when(~open_, F.col("limit"))), F.lit(0.0)), F.sum(F.when(open_, F.col("weight")))
        ).first()
        raised = (total - row[0]) / row[1] if row[1] else unit
        if raised <= unit * (1 + 1e-12):
            break
        unit = raised
    target = F.least(F.col("limit"), F.col("weight") * F.lit(unit))
    return sources.select("source", "source_docs", "source_size", target.alias("target"))


def mix_sources(docs, source="source", text="text", id_column="doc_id", keep=None, weights=WEIGHTS, most_copies=MOST_COPIES, seed=SEED):
    """All documents with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (copies times size).

    ``keep`` names the columns of ``docs`` to carry; default all.
    """
    kept = docs.columns if keep is None else list(keep)
    tie = F.xxhash64(*[F.col(f"`{name}`") for name in docs.columns])
    sized = docs.select(
        whole_row(docs.select(*[f"`{name}`" for name in kept])).alias("row"),
        F.col(f"`{source}`").alias("source"), words(F.col(f"`{text}`")).alias("size"),
        F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(f"`{id_column}`").cast("string"))).alias("draw"), tie.alias("tie"),
    )
    keys = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("draw").asc(), F.col("tie").asc()]
    ordered = written_in_order(sized, keys, "mix-order")
    targets = materialize(source_targets(ordered, weights, most_copies), "targets")
    first = materialize(_first_positions(with_position(ordered, "position")), "source-starts")
    sources = targets.alias("t").join(first.alias("f"), F.col("t.source").eqNullSafe(F.col("f.source")))
    sources = materialize(sources.select("t.*", "f.source_first"), "source-plan")

    each = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.lit(float(_STEPS)))).otherwise(F.lit(0))
    each = F.least(each.cast("long"), F.lit(most_copies * _STEPS))
    drawn = F.md5(F.concat_ws("-", F.lit(str(seed)), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))))
    offset = F.conv(F.substring(drawn, 1, 6), 16, 10).cast("long")
    plan = sources.select(F.col("source").alias("of"), "source_docs", "source_size", "target", "source_first", each.alias("each"), offset.alias("offset"))
    rank = F.col("position") - F.col("source_first")
    back = F.col("source_docs") - 1 - F.floor(rank / 2)
    place = F.when(rank % 2 == 0, F.floor(rank / 2)).otherwise(back)
    crossed = F.floor((F.col("offset") + F.col("each") * (place + 1)) / F.lit(_STEPS)) - F.floor((F.col("offset") + F.col("each") * place) / F.lit(_STEPS))
    mixed = with_position(ordered, "position").join(plan, F.col("source").eqNullSafe(F.col("of")))
    own = ("size", "source_size", "target", "copies", "taken")
    return mixed.withColumn("copies", crossed.cast("long")).withColumn("taken", F.col("copies") * F.col("size")).select(
        *[F.col("row").getField(name).alias(name) for name in kept if name not in own], *own
    )


def _first_positions(positioned):
    return positioned.groupBy("source").agg(F.min("position").alias("source_first"))


def take_copies(mixed, columns):
    """The rows of the mix: every document as often as it was taken."""
    return mixed.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
