"""Dataset operators: identifiers, integrity joins, unions, splits, parameter statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_id(s: Column) -> Column:
    """Trailing digits as an integer, 0 where there are none or they do not fit."""
    return F.coalesce(F.nullif(F.regexp_extract(s, r"(\d+)$", 1), F.lit("")).try_cast("int"), F.lit(0))


def parse_delimited(lines: DataFrame, column: str, sep: str | None = None) -> DataFrame:
    """``mesh_id, p`` from lines of an id and four numbers; without ``sep``, runs of blanks part
    the fields. An id may be a number or text ending in digits. Lines of another width are errors."""
    parts = F.split(F.trim(column), r"\s+" if sep is None else rf"\s*{sep}\s*")
    parts = F.when(F.size(parts) == 5, parts).otherwise(F.raise_error(F.concat(F.lit("expected 5 fields: "), F.col(column))).cast("array<string>"))
    return lines.select(parts.alias("f")).select(trailing_id(F.col("f")[0]).alias("mesh_id"), F.transform(F.slice("f", 2, 4), lambda x: x.cast("double")).alias("p"))


def integrity_join(left: DataFrame, right: DataFrame, key: str, right_key: str) -> DataFrame:
    """Left rows with a ``matched`` flag; several right rows of a key do not multiply them."""
    keys = right.select(F.col(right_key).alias("_k")).distinct()
    return left.join(keys, F.col(key) == F.col("_k"), "left").withColumn("matched", F.col("_k").isNotNull()).drop("_k")


def union_batches(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.withColumn("batch", F.lit(1)).unionByName(second.withColumn("batch", F.lit(2)))


def last_by_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key in the given order; a maximum of structs, so it pre-aggregates."""
    rest = [c for c in rows.columns if c != key and c not in order]
    best = rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("r"))
    return best.select(key, *(F.col(f"r.{c}").alias(c) for c in (*order, *rest)))


def positional_split(rows: DataFrame, order: str, held: int = 8) -> DataFrame:
    """``split``: the last ``held`` rows by ``order`` are test, the ``held`` before them val, the rest
    train. Only the top 2 x ``held`` rows are ordered (a distributed top-k)."""
    top = rows.select(order).orderBy(F.col(order).desc()).limit(2 * held)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col(order).desc()))).withColumnRenamed(order, "_o")
    split = F.when(F.col("rank") <= held, "test").when(F.col("rank").isNotNull(), "val").otherwise("train")
    return rows.join(F.broadcast(top), F.col(order) == F.col("_o"), "left").withColumn("split", split).drop("_o", "rank")


def first_row(rows: DataFrame, order: str) -> DataFrame:
    return rows.orderBy(order).limit(1)


def parameter_statistics(rows: DataFrame, vector: str, size: int) -> DataFrame:
    """``dim, mean, std`` (sample deviation) of the first ``size`` components."""
    wide = rows.agg(*(f(F.col(vector)[i].cast("double")).alias(f"{n}{i}") for i in range(size) for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(i + 1).alias("dim"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std")) for i in range(size)))))


def standardise(rows: DataFrame, vector: str, size: int) -> DataFrame:
    """``p``: standardised components; a deviation under single-precision epsilon counts as 1."""
    wide = rows.agg(*(f(F.col(vector)[i].cast("double")).alias(f"{n}{i}") for i in range(size) for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    z = F.array(*((F.col(vector)[i].cast("double") - F.col(f"m{i}")) / F.when(F.col(f"s{i}") < 1.1920929e-7, F.lit(1.0)).otherwise(F.col(f"s{i}")) for i in range(size)))
    return rows.join(F.broadcast(wide)).withColumn("p", z).drop(*wide.columns)  # one row, joined to all


def prefix_xor(rows: DataFrame, by: list[str], order: list[str], flag: Column) -> DataFrame:
    """``state``: parity of the flags up to and including the row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("state", (F.sum(flag.cast("long")).over(w) % 2))


def counts_and_offsets(rows: DataFrame, by: str, bin_col: str) -> DataFrame:
    """``n`` rows of each bin and the 1-based ``first`` position of the bin in bin order."""
    n = rows.groupBy(by, bin_col).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, 0)
    return n.withColumn("first", F.sum("n").over(w) - F.col("n") + 1)


def running_best(rows: DataFrame, by: list[str], order: list[str], loss: str) -> DataFrame:
    """``best`` so far and whether the row is strictly better than all before it."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("best", F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("improved", before.isNull() | (F.col(loss) < before))
