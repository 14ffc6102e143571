"""A set of ids as a bitmap of bounded size, for telling early which rows cannot matter to a join.

The bitmap never decides a result: rows that it lets through still meet the join. Its size follows the set up to a fixed
bound; beyond it more rows pass in vain and the join does the work. The bitmap is a table of 64-bit words that is broadcast,
so the test is a hash join inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 524,288 words, about 20 MB as a table.
MOST_BITS = 1 << 25


def only_maybe(df: DataFrame, column: str, ids: DataFrame, id_column: str, rows: int, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows of df that may be in ids, rows that surely are not). rows: the number of ids, about."""
    bits = 1 << 12
    while bits < min(most_bits, 16 * rows):
        bits *= 2
    cell = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))
    words = ids.select(cell(id_column).alias("_cell")).groupBy(F.shiftright("_cell", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_cell % 64 as int)))").alias("_bits"))
    words = F.broadcast(words)
    hit = (F.shiftright(cell(column), 6) == F.col("_word")) & (F.col("_bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (cell(column) % 64).cast("int"))) != 0)
    return df.join(words, hit, "left_semi"), df.join(words, hit, "left_anti")
