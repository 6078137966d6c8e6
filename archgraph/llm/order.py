"""Places of rows in one total order, without a task that sees all of them."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from archgraph.session import materialize

_PART_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def shuffle_width(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written_in_order(df, keys, label, place="place_key"):
    """Range-partition ``df`` by ``keys``, sort each part, and write it with a key that rises in that order.

    ``keys`` are sort columns that tell rows apart (rows equal in all of them
    must be interchangeable). The written key holds the part and the row's
    number in it.
    """
    parts = shuffle_width(df.sparkSession)
    ordered = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return materialize(ordered.withColumn(place, F.monotonically_increasing_id()), label)


def part_of(place="place_key"):
    return F.shiftright(F.col(place), _PART_BITS)


def number_in_part(place="place_key"):
    return F.col(place).bitwiseAND(F.lit((1 << _PART_BITS) - 1))


def with_position(written, position, place="place_key"):
    """Add the row's number (from 0) in the total order; the table of part sizes has one row per part."""
    sizes = written.groupBy(part_of(place).alias("order_part")).agg(F.count(F.lit(1)).alias("part_rows"))
    before = F.coalesce(F.sum("part_rows").over(Window.orderBy("order_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(sizes.select("order_part", before.alias("part_start")), "part-starts")
    joined = written.withColumn("order_part", part_of(place)).join(starts, "order_part")
    return joined.withColumn(position, F.col("part_start") + number_in_part(place)).drop("order_part", "part_start", place)


def whole_row(df):
    """All columns of ``df`` as one struct, so that an operator's own column names cannot clash with them."""
    return F.struct(*[F.col(f"`{name}`") for name in df.columns])
