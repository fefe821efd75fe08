"""Line deduplication by content-defined chunks of lines.

A rolling hash over the hashes of lines, two lines wide, runs through every text.  A
boundary falls wherever that hash has occurred nowhere before (its first place, the
least by doc_id, text and position, is this one), or was first seen at a place that
does not continue the one before it in the same document.  So boundaries follow from
content alone and do not move when a passage is shifted, and the chunks between them
are the longest runs of lines that one earlier document, its source, holds as one run.
Boundaries by a class of the hash, the usual way, run the first and last chunk of a
passage into the lines around it, so they miss most passages of 2 to 5 lines.

A chunk grows line by line with its source, over a single unlike window between two
like ones, as all lines are matched there.  Where chunks overlap, each line goes with
the longest, and between two that touch, the first line of the later one stays.  The
bytes of what is left are compared with those of the source.  A line that is a source
of a chunk never goes: what goes is, in every document, runs of two or more lines, each
of which stands whole in one document of the result.

All steps are DataFrame expressions.  Hashes of all windows are shuffled, then the
repeated places only; texts of chunks meet those of their sources in a join that can
be split where one source has many chunks.  Documents meet short lists of line numbers
by a broadcast while these take few bytes, counted before, else by a shuffle.

Defined results: a null text stays null with 0 lines; an empty text is one
empty line; rows with equal doc_id and equal text are one occurrence and get
the same result, as do rows with a null doc_id and equal text; a chunk whose
hashes are equal but whose bytes differ stays; a single line between lines
that are its own stays.  Input columns are kept inside the struct ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decontaminate import let
from ..plans.scratch import Scratch

#: Bytes of a table of lists that documents meet by a broadcast: each number counts as 64, identifiers as their letters.
BROADCAST_BYTES = 32 << 20


def _windows(text: Column) -> Column:
    """Array of the rolling hashes of each two neighbouring lines of a text, in order."""

    def rolled(hashes):
        n = F.size(hashes) - 1
        return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 2, n), lambda a, b: F.shiftleft(a, 1).bitwiseOR(F.shiftrightunsigned(a, 63)).bitwiseXOR(b))

    return let(F.transform(F.split(text, "\n", -1), lambda x: F.xxhash64(x)), rolled)


def _met(docs: DataFrame, listed: DataFrame, entry: Column, name: str, how: str) -> DataFrame:
    """Documents (doc_id, text_code) with the array ``name`` of the different entries that ``listed`` has for them."""
    size = listed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.col("doc_id").cast("string"))), F.lit(0)).alias("b")).first()
    lists = listed.groupBy(F.col("doc_id").alias("its_id"), F.col("text_code").alias("its_code")).agg(F.collect_set(entry).alias(name))
    small = 64 * size["n"] + size["b"] <= BROADCAST_BYTES
    met = docs.join(F.broadcast(lists) if small else lists, (docs.text_code == F.col("its_code")) & docs.doc_id.eqNullSafe(F.col("its_id")), how)
    return met.drop("its_id", "its_code")


def _chunks(repeats: DataFrame) -> DataFrame:
    """Of repeated windows with their first places: chunks (doc_id, text_code, lo, hi, s_id, s_code, s_lo), lines lo to hi. No two touch."""
    along = ["doc_id", "text_code", "s_id", "s_code", "shift"]
    shifted = repeats.withColumn("shift", F.col("no") - F.col("s_no"))
    order = Window.partitionBy(*along).orderBy("no")
    # a gap of one window has all its lines matched by the windows around it
    fresh = shifted.withColumn("fresh", (F.coalesce(F.col("no") - F.lag("no").over(order), F.lit(3)) > 2).cast("int"))
    runs = fresh.withColumn("run", F.sum("fresh").over(order)).groupBy(*along, "run").agg(F.min("no").alias("lo"), (F.max("no") + 1).alias("hi"))

    best = F.max(F.struct((F.col("hi") - F.col("lo")).alias("size"), (-F.col("lo")).alias("back"), "s_id", "s_code", "shift")).alias("best")
    lines = runs.withColumn("line", F.explode(F.sequence("lo", "hi"))).groupBy("doc_id", "text_code", "line").agg(best)
    within = Window.partitionBy("doc_id", "text_code").orderBy("line")
    # pieces: neighbouring lines of one run, two at least
    goes_on = (F.lag("line").over(within) == F.col("line") - 1) & (F.lag("best.back").over(within) == F.col("best.back"))
    lines = lines.withColumn("piece", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(within))
    lines = lines.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "text_code", "piece"))).where("many > 1")
    touches = (F.lag("line").over(within) == F.col("line") - 1) & (F.lag("piece").over(within) != F.col("piece"))
    lines = lines.withColumn("touches", F.coalesce(touches, F.lit(False))).where("not touches")
    chunks = lines.groupBy("doc_id", "text_code", "piece").agg(F.min("line").alias("lo"), F.max("line").alias("hi"), F.first("best").alias("best"))
    return chunks.where("hi > lo").select("doc_id", "text_code", "lo", "hi", "best.s_id", "best.s_code", (F.col("lo") - F.col("best.shift")).alias("s_lo"))


def _spelt(lines: Column, name: str) -> Column:
    """The entries of the array ``name`` (lo, n, ...), each with its lines as ``passage``."""
    return let(lines, lambda c: F.transform(name, lambda x: x.withField("passage", F.array_join(F.slice(c, x["lo"] + 1, x["n"]), "\n"))))


def remove_repeated_passages(docs: DataFrame) -> DataFrame:
    """Columns row (struct of the input's columns), text (what stays), n_lines, n_removed (lines)."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", F.xxhash64("text").alias("text_code"))
    light = packed.where("text is not null").select("doc_id", "text_code", "text")
    lines = F.split("text", "\n", -1)

    windows = light.select("doc_id", "text_code", F.posexplode(_windows(F.col("text"))).alias("no", "code"))
    place = F.struct("doc_id", "text_code", "no")
    first = windows.groupBy("code").agg(F.count(F.lit(1)).alias("k"), F.min(place).alias("first")).where("k > 1").select("code", "first")
    repeats = windows.join(scratch.save(first, "first"), "code").where(~place.eqNullSafe(F.col("first")))
    repeats = repeats.select("doc_id", "text_code", "no", F.col("first.doc_id").alias("s_id"), F.col("first.text_code").alias("s_code"), F.col("first.no").alias("s_no"))
    chunks = scratch.save(_chunks(repeats).withColumn("n", F.col("hi") - F.col("lo") + 1), "chunks")

    own = _met(light, chunks, F.struct("lo", "n", "s_id", "s_code", "s_lo"), "own", "inner")
    own = own.select("doc_id", "text_code", F.explode(_spelt(lines, "own")).alias("x")).select("doc_id", "text_code", "x.*")
    sources = chunks.select(F.col("s_id").alias("doc_id"), F.col("s_code").alias("text_code"), F.col("s_lo").alias("lo"), "n").distinct()
    sources = _met(light, scratch.save(sources, "sources"), F.struct("lo", "n"), "held", "inner")
    sources = sources.select("doc_id", "text_code", F.explode(_spelt(lines, "held")).alias("x"))
    sources = sources.groupBy(F.col("doc_id").alias("h_id"), F.col("text_code").alias("h_code"), F.col("x.lo").alias("h_lo"), F.col("x.n").alias("h_n")).agg(F.first("x.passage").alias("source"))
    same = F.col("s_id").eqNullSafe(F.col("h_id")) & (F.col("s_code") == F.col("h_code")) & (F.col("s_lo") == F.col("h_lo")) & (F.col("n") == F.col("h_n"))
    verified = scratch.save(own.join(scratch.save(sources, "passages"), same).where("passage = source").select("doc_id", "text_code", "lo", "n", "s_id", "s_code", "s_lo"), "verified")

    goes = verified.select("doc_id", "text_code", F.explode(F.expr("sequence(lo, lo + n - 1)")).alias("line"), F.lit(False).alias("stays"))
    stays = verified.select(F.col("s_id").alias("doc_id"), F.col("s_code").alias("text_code"), F.explode(F.expr("sequence(s_lo, s_lo + n - 1)")).alias("line"), F.lit(True).alias("stays"))
    gone = goes.union(stays).groupBy("doc_id", "text_code", "line").agg(F.max("stays").alias("stays")).where("not stays").drop("stays")
    gone = scratch.save(gone, "gone")

    def alone(a):
        """Lines of which neither neighbour goes stay."""
        return F.filter(a, lambda k, i: (F.get(a, i - 1) == k - 1) | (F.get(a, i + 1) == k + 1))

    def without(c):
        goes = let(F.sort_array("gone"), alone)
        stays = F.array_except(F.sequence(F.lit(0), F.size(c) - 1), goes)
        return let(stays, lambda s: F.struct(F.array_join(F.transform(s, lambda k: F.get(c, k)), "\n").alias("text"), (F.size(c) - F.size(s)).cast("long").alias("lost")))

    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    left = F.when(F.col("gone").isNotNull(), let(lines, without))
    return _met(packed, gone, F.col("line"), "gone", "left").select("row", "text", n.alias("n_lines"), left.alias("left")).select(
        "row", F.when(F.col("left").isNull(), F.col("text")).otherwise(F.col("left.text")).alias("text"), "n_lines", F.coalesce("left.lost", F.lit(0).cast("long")).alias("n_removed")
    )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated_passages(docs).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "text")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents),
k0 AS (SELECT doc_id, unnest(range(1, len(ls))) AS k, ls FROM d),
w AS (SELECT doc_id, k, ls[k] || chr(10) || ls[k + 1] AS pair FROM k0),
f AS (SELECT doc_id, k, first_value(doc_id) OVER o AS s, first_value(k) OVER o AS sk FROM w WINDOW o AS (PARTITION BY pair ORDER BY doc_id, k)),
c AS (SELECT doc_id, k, s, k - sk AS shift FROM f WHERE doc_id <> s OR k <> sk),
g AS (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id, s, shift ORDER BY k) <= 2 THEN 0 ELSE 1 END AS fresh FROM c),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, s, shift ORDER BY k) AS run FROM g),
r AS (SELECT doc_id, s, shift, min(k) AS lo, max(k) + 1 AS hi FROM h GROUP BY doc_id, s, shift, run),
l AS (SELECT doc_id, s, shift, lo, hi, unnest(range(lo, hi + 1)) AS line FROM r),
m AS (SELECT doc_id, s, shift, lo, line FROM l QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY hi - lo DESC, lo) = 1),
t AS (SELECT *, CASE WHEN lag(line) OVER o = line - 1 AND lag(lo) OVER o = lo THEN 0 ELSE 1 END AS begins FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY line)),
u AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY line) AS piece FROM t),
q AS (SELECT * FROM u QUALIFY count(*) OVER (PARTITION BY doc_id, piece) > 1),
e AS (SELECT * FROM q WINDOW o AS (PARTITION BY doc_id ORDER BY line) QUALIFY NOT coalesce(lag(line) OVER o = line - 1 AND lag(piece) OVER o <> piece, false)),
v AS (SELECT doc_id, min(line) AS lo, max(line) AS hi, any_value(s) AS s, any_value(shift) AS shift FROM e GROUP BY doc_id, piece HAVING max(line) > min(line)),
x AS (SELECT doc_id, unnest(range(lo, hi + 1)) AS line, false AS stays FROM v UNION ALL SELECT s, unnest(range(lo - shift, hi - shift + 1)), true FROM v),
y AS (SELECT doc_id, line FROM x GROUP BY doc_id, line HAVING NOT bool_or(stays)),
z AS (SELECT doc_id, line FROM (SELECT *, lag(line) OVER o AS a, lead(line) OVER o AS b FROM y WINDOW o AS (PARTITION BY doc_id ORDER BY line)) WHERE a = line - 1 OR b = line + 1),
n AS (SELECT doc_id, list(line) AS gone FROM z GROUP BY doc_id)
SELECT d.doc_id, len(ls)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  CASE WHEN gone IS NULL THEN d.text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ls[i]), chr(10)) END AS text
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
"""
