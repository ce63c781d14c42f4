"""Validation, splits, dedup and sampling of examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from graphprep.operators.builders import settled
from graphprep.schema import SPLITS
from graphprep.sources.scratch import scratch


def violations(examples: DataFrame) -> DataFrame:
    """Add violations, the names of the rules that an example breaks: ids, edges and pointers must fit together."""
    examples = settled(examples, "nodes", "edges", "output")
    n = F.size("nodes")
    ids = F.col("nodes.id")
    src, dst = F.col("edges.src"), F.col("edges.dst")
    null_in = lambda values: F.exists(values, lambda v: v.isNull())
    rules = {
        "V1_missing_part": F.col("nodes").isNull() | F.col("edges").isNull() | F.col("output").isNull(),
        "V2_node_field": null_in(ids) | null_in(F.col("nodes.type")) | null_in(F.col("nodes.label")),
        "V3_repeated_id": F.size(F.array_distinct(ids)) < n,
        "V4_ids_not_contiguous": (n == 0) | (F.array_min(ids) != 0) | (F.array_max(ids) != n - 1),
        # Least and largest leave nulls out, and are null of nothing.
        "V5_edge_end": null_in(src) | null_in(dst) | F.coalesce(F.least(F.array_min(src), F.array_min(dst)) < 0, F.lit(False)) | F.coalesce(F.greatest(F.array_max(src), F.array_max(dst)) >= n, F.lit(False)),
        "V6_edge_type": null_in(F.col("edges.type")),
        # Distinct numbers and strings are found by hashing, distinct structs by comparing all with all. Where no hashes are equal no
        # edges are; names are made only where some are.
        "V7_repeated_edge": F.when(F.size(F.array_distinct(F.transform("edges", lambda e: F.xxhash64(e)))) < F.size("edges"), F.size(F.array_distinct(F.transform("edges", lambda e: F.concat_ws("/", e["src"].cast("string"), e["dst"].cast("string"), e["type"])))) < F.size("edges")),
        "V8_pointer_range": F.coalesce(F.array_min("output.pointer") < 0, F.lit(False)) | F.coalesce(F.array_max("output.pointer") >= n, F.lit(False)),
    }
    return settled(examples.withColumn("violations", F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(name)) for name, r in rules.items()]))), "violations")


def percent(seed: str, key: Column) -> Column:
    """A number from 0 to 99 that seed and key decide."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key.cast("string"))), 1, 8), 16, 10).cast("bigint") % 100).cast("int")


def split_of(key: Column, shares: tuple[int, int, int] = (80, 10, 10), seed: str = "split") -> Column:
    """train, valid or test by a hash of the key, in these percentages."""
    if sum(shares) != 100:
        raise ValueError("shares must add up to 100")
    p = percent(seed, key)
    return F.when(p < shares[0], SPLITS[0]).when(p < shares[0] + shares[1], SPLITS[1]).otherwise(SPLITS[2])


def two_way_split(key: Column, is_test: Column, train: int = 80, seed: str = "two") -> Column:
    """Rows given as test stay test; of the others `train` per cent are train, the rest valid."""
    return F.when(is_test, SPLITS[2]).when(percent(seed, key) < train, SPLITS[0]).otherwise(SPLITS[1])


def content_hash(examples: DataFrame) -> DataFrame:
    """Add content_hash, an MD5 over nodes, edges in any order and output; provenance, split and ids do not count.

    Labels and tokens are escaped, so a line break between entries and a tab between fields cannot be part of them. Edges
    count by two 64-bit hashes each, folded, and by their number.
    """
    examples = settled(examples, "nodes", "edges", "output")
    # A field of all entries after the other: lists are joined as they are, without a lambda that makes a string for each entry.
    listed = lambda array, *fields: F.concat_ws("\t", *[F.array_join(F.col(f"{array}.{f}").cast("array<string>"), "\n", "\r") for f in fields])
    nodes = listed("nodes", "id", "type", "label", "is_repair_candidate")
    output = listed("output", "kind", "token", "pointer", "class")
    fold = lambda seed: F.aggregate("edges", F.lit(0).cast("long"), lambda s, e: s.bitwiseXOR(F.xxhash64(F.lit(seed), e)))
    return examples.withColumn("content_hash", F.md5(F.concat_ws("\f", nodes, fold(0).cast("string"), fold(1).cast("string"), F.size("edges").cast("string"), output)))


def first_of_each(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row for each value of `by`, the first in a total order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def split_rank(split: Column) -> Column:
    return F.when(split == "train", 0).when(split == "valid", 1).otherwise(2)


def oversample(rows: DataFrame, weight: Column, key: Column, seed: str = "copies") -> DataFrame:
    """floor(weight) copies of each row and one more with the remaining probability, decided by 52 bits of a hash of the key."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key.cast("string"))), 1, 13), 16, 10).cast("double")
    more = F.when(draw < (weight - F.floor(weight)) * float(1 << 52), 1).otherwise(0)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.floor(weight) + more).cast("int"))))


#: Rows that one task numbers.
TASK_ROWS = 500_000
#: Ranges that are sent to all executors; more of them meet the rows in a shuffle.
SENT_RANGES = 100_000


def numbered(rows: DataFrame, by: list[str], order: str, out: str, most: int = TASK_ROWS) -> DataFrame:
    """Number the rows of each group from 0 in the order of a column, ties in any order, with no task holding a whole group.

    A group of more than `most` rows is cut into 255 ranges of equal width, a range that still has more into 255 of its own, and so
    on; rows of one value are cut by a hash of the row. Ranges follow one another, so that their counts give each its first
    number. Rows that are equal in all columns stay together. Groups are counted when this is called, and again once for each level of
    ranges. The column must be a number other than NaN, the same whenever rows are read; null comes first.
    """
    spark, own = rows.sparkSession, rows.columns
    tie = F.xxhash64(*[c for c, t in rows.dtypes if "map<" not in t])
    x = F.col(order).cast("double")
    found = rows.withColumns({"_tie": tie, "_path": F.lit("")})
    stats = [F.count(F.lit(1)).alias("_n"), F.min(x).alias("_lo"), F.max(x).alias("_hi")]
    level, large = 0, found.groupBy(*by, "_path").agg(*stats).where(F.col("_n") > most)
    while level < 16:
        place = scratch(spark, "ranges")
        large.write.parquet(place)
        large = spark.read.schema(large.schema).parquet(place)
        many = large.count()
        if not many:
            break
        cells = large.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_path").alias("_cell"), "_lo", "_hi")
        same = F.col("_path") == F.col("_cell")
        for i, c in enumerate(by):
            same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
        byte = F.shiftrightunsigned("_tie", 8 * (level % 8)) % 256
        width = F.col("_hi") - F.col("_lo")
        part = F.when(x.isNull() & F.col("_lo").isNotNull(), 0).when(width > 0, 1 + F.floor((x - F.col("_lo")) / width * 254)).otherwise(1 + F.pmod(byte, F.lit(255)))
        cut = F.concat("_path", F.lpad(F.hex(part.cast("long")), 2, "0"))
        found = found.join(F.broadcast(cells) if many <= SENT_RANGES else cells, same, "left").select(*own, "_tie", F.when(F.col("_cell").isNotNull(), cut).otherwise(F.col("_path")).alias("_path"))
        level += 1
        large = found.where(F.length("_path") == 2 * level).groupBy(*by, "_path").agg(*stats).where(F.col("_n") > most)
    if not level:
        return rows.withColumn(out, (F.row_number().over(Window.partitionBy(*by, F.lit(0)).orderBy(order)) - 1).cast("bigint"))
    counts = found.groupBy(*by, "_path").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by, F.lit(0)).orderBy("_path")) - F.col("_n")  # a row for each range
    first = counts.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_path").alias("_cell"), before.alias("_first"))
    same = F.col("_path") == F.col("_cell")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    inside = F.row_number().over(Window.partitionBy(*by, "_path").orderBy(order, "_tie")) - 1
    return found.withColumn("_in", inside).join(first, same).select(*own, (F.col("_first") + F.col("_in")).cast("bigint").alias(out))


def batches(rows: DataFrame, by: list[str], order: str, size: int, drop_remainder: bool) -> DataFrame:
    """Number the batches of `size` rows within each group, in the order of a column."""
    out = numbered(rows, by, order, "_at").withColumn("batch", F.floor(F.col("_at") / size).cast("bigint"))
    if drop_remainder:
        whole = rows.groupBy(*by).agg(F.floor(F.count(F.lit(1)) / size).cast("bigint").alias("_whole"))
        out = out.join(whole, by).where(F.col("batch") < F.col("_whole")).drop("_whole")
    return out.drop("_at")


def count_while(rows: DataFrame, name: str, **conditions: Column) -> tuple[DataFrame, Observation]:
    """Rows with counters that fill as they are written: how many there are (all) and how many meet each condition.

    Costs no pass of its own. Read Observation.get after an action.
    """
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("all"), *[F.count_if(c).alias(n) for n, c in conditions.items()]), seen


def of_task(examples: DataFrame, task: str, split_kept: tuple[str, ...] = SPLITS) -> DataFrame:
    """Examples of one task in the given splits."""
    return examples.where((F.col("task") == task) & F.col("split").isin(*split_kept))
