"""Bounded samples of different texts, for what is learnt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hashes are compared as numbers of 63 bits, so a share can be as small as a sample of any table needs.
SPAN = 1 << 63


def cut_of(want: int, n: int) -> int:
    """Greatest hash that is taken, so that of ``n`` different texts about 2 ``want`` and some are."""
    return SPAN - 1 if 2 * want + 64 >= n else SPAN * (2 * want + 64) // n


def distinct_sample(rows: DataFrame, key: str, most: int, label: str | None = None, equal: bool = False) -> DataFrame:
    """Rows with different values of ``key`` (and label), each once: all, or if there are more than about ``most``, that many, the least by a hash of the key.

    ``label``: each label gets a part of ``most``, the same for all if ``equal``, else by its texts, but a twentieth of an equal part at least, so none vanishes.
    How often a text occurs has no influence.  Null keys are left out.  Only texts whose hash is below a cut are shuffled, some more than twice the sample.
    """
    rows = rows.where(F.col(key).isNotNull())
    group = F.coalesce(F.col(label).cast("string"), F.lit("")) if label else F.lit("")
    coded = rows.withColumns({"_group": group, "_code": F.shiftrightunsigned(F.xxhash64(key), 1)})
    known = {r["_group"]: r["n"] for r in coded.groupBy("_group").agg(F.approx_count_distinct("_code").alias("n")).collect()}  # a row for each label
    total = sum(known.values())
    if total > most:
        part = most / len(known)
        want = {g: max(1, int(part if equal else max(most * n / total, part / 20))) for g, n in known.items()}
        pairs = [F.lit(x) for g, n in sorted(known.items()) for x in (g, cut_of(want[g], n))]
        coded = coded.where(F.col("_code") <= F.element_at(F.create_map(*pairs), F.col("_group")))
        wanted = F.element_at(F.create_map(*[F.lit(x) for g in sorted(want) for x in (g, want[g])]), F.col("_group"))
        coded = coded.dropDuplicates([key, "_group"]).withColumn("_rank", F.row_number().over(Window.partitionBy("_group").orderBy("_code", key))).where(F.col("_rank") <= wanted)
    else:
        coded = coded.dropDuplicates([key, "_group"])
    return coded.select(*rows.columns)
