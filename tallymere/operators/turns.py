"""Rows of a batch that share keys, taken into the store as if one after another.

No group is handled in one task.  A round takes a guess of which entity each row
went to, derives from it which values each row changed and so which keys every
entity had at any time, and finds the entities of all rows anew, by joins.  A guess
that a round does not change is the result of taking the rows in turn, as each
row rests on right ones before it; a round makes at least the first wrong row right.

The entity that a row finds is the least of those that have its key at its turn.
Entities can lose a key, so times are cut into spans of powers of eight: an interval
goes to the few spans that make it up, a row asks the one span of each size that it lies in.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

BASE = 8


def _numbered(frame: DataFrame, scratch: Scratch, name: str, *order: Column) -> tuple[DataFrame, int]:
    """The rows with their number (pos) from 0 in an order, and how many there are. What is collected is a count for each partition."""
    rows = scratch.save(frame.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    offsets, total = [], 0
    for p, n in sorted(tuple(r) for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1))).collect()):
        offsets.append((p, total - (p << 33)))
        total += n
    known = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_part long, _more long"))
    return rows.join(known, part == F.col("_part")).withColumn("pos", F.col("_at") + F.col("_more")).drop("_at", "_part", "_more"), total


def least_alive(intervals: DataFrame, asks: DataFrame, most: int) -> DataFrame:
    """Of asks (key, pos, ...) with an interval (key, start, end, eid; start <= pos < end, null for no end) the least eid of these. Places are from 0 to ``most``."""
    levels = max(1, math.ceil(math.log(most + 2, BASE)))
    rows, spans = intervals.withColumn("end", F.coalesce("end", F.lit(BASE**levels))), []

    def run(lo: str, hi: str, level: int) -> Column:
        return F.expr(f"if({lo} < {hi}, transform(sequence({lo}, {hi} - 1), x -> struct({level} as level, x as span)), array())")

    for k in range(levels + 1):
        size = BASE**k
        lo, hi = f"((start + {size - 1}) div {size})", f"(end div {size})"
        if k == levels:
            spans.append(run(lo, hi, k))
            continue
        # what lies in no whole span of the next size
        left, right = f"((start + {size * BASE - 1}) div {size * BASE} * {BASE})", f"(end div {size * BASE} * {BASE})"
        spans.append(F.when(F.expr(f"{left} < {right}"), F.concat(run(lo, left, k), run(right, hi, k))).otherwise(run(lo, hi, k)))
    spans = [s.cast("array<struct<level:int,span:bigint>>") for s in spans]
    held = rows.select("key", "eid", F.explode(F.concat(*spans)).alias("s")).groupBy("key", "s.level", "s.span").agg(F.min("eid").alias("eid"))
    own = F.array(*[F.struct(F.lit(k).alias("level"), F.expr(f"pos div {BASE**k}").alias("span")) for k in range(levels + 1)])
    met = asks.withColumn("s", F.explode(own)).select(*asks.columns, "s.level", "s.span").join(held, ["key", "level", "span"])
    return met.groupBy(*asks.columns).agg(F.min("eid").alias("eid"))


def _marks(schema, watched: tuple[str, ...]) -> Column:
    """What a row says of watched fields: field, name (of a document's part, too), its value as text, and whether it is an empty text, which only a new entity takes."""
    parts = []
    for f in watched:
        if f != "documents":
            text = schema[f].dataType.simpleString() == "string"
            mark = F.struct(F.lit(f).alias("field"), F.lit(f).alias("name"), F.to_json(F.struct(f)).alias("text"), (F.col(f) == "" if text else F.lit(False)).alias("blank"))
            parts.append(F.when(F.col(f).isNotNull(), F.array(mark)).otherwise(F.array()))
            continue

        def of(entry: Column) -> Column:
            mark = lambda name, text, blank: F.struct(F.lit("documents").alias("field"), F.concat(F.lit(f"documents/{name}/"), entry["key"]).alias("name"), text.alias("text"), blank.alias("blank"))
            own = [F.when(entry["value"][x.name].isNotNull(), mark(x.name, F.to_json(F.struct(entry["value"][x.name].alias("x"))), entry["value"][x.name] == "" if x.dataType.simpleString() == "string" else F.lit(False))) for x in schema["documents"].dataType.valueType.fields]
            return F.filter(F.array(mark("", F.lit(""), F.lit(False)), *own), lambda x: x.isNotNull())

        parts.append(F.when(F.col(f).isNotNull(), F.flatten(F.transform(F.map_entries(f), of))).otherwise(F.array()))
    kind = "array<struct<field:string,name:string,text:string,blank:boolean>>"
    return F.concat(*[p.cast(kind) for p in parts])


def _changes(rows: DataFrame) -> DataFrame:
    """Of rows in turn (eid, pos, made, marks) those that changed their entity: eid, pos and the fields."""
    said = rows.select("eid", "pos", "made", F.explode("marks").alias("m")).where("made or not m.blank")
    before = F.lag("m.text").over(Window.partitionBy("eid", "m.name").orderBy("pos"))
    changed = said.withColumn("before", before).where(~F.col("made") & ~F.col("before").eqNullSafe(F.col("m.text")))
    return changed.groupBy("eid", "pos").agg(F.collect_set("m.field").alias("fields"))


def _round(light: DataFrame, guess: DataFrame, held: DataFrame, total: int) -> DataFrame:
    """Rows (pos) with their entity anew (eid), the slug of those that make one (made_slug), and whether either moved. Stored entities are ``held``."""
    rows = light.join(guess, "pos").withColumn("made", F.col("eid") == F.col("pos"))
    both = rows.select("eid", "pos", "made", "marks", "isin", "symbol", "made_slug").unionByName(held)
    told = both.select("eid", "pos", "made", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("isin", "symbol")])).alias("k")).where("coalesce(k.value, '') <> ''")
    written = told.where("made").unionByName(told.where("not made").join(_changes(both).select("eid", "pos"), ["eid", "pos"], "left_semi"))
    turn = Window.partitionBy("eid", "k.kind").orderBy("pos")
    steps = written.withColumn("before", F.lag("k.value").over(turn)).where(~F.col("before").eqNullSafe(F.col("k.value")))
    # a row sees what those before it wrote
    key = lambda kind, value: F.concat(kind, F.lit("="), value).alias("key")
    intervals = steps.select(key(F.col("k.kind"), F.col("k.value")), (F.col("pos") + 1).alias("start"), (F.lead("pos").over(turn) + 1).alias("end"), "eid")
    slugs = both.where("made and coalesce(made_slug, '') <> ''").select(key(F.lit("slug"), F.col("made_slug")), (F.col("pos") + 1).alias("start"), F.lit(None).cast("long").alias("end"), "eid")
    asks = rows.select("pos", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("isin", "symbol", "slug")])).alias("k")).where("coalesce(k.value, '') <> ''")
    found = least_alive(intervals.union(slugs), asks.select("pos", "k.kind", key(F.col("k.kind"), F.col("k.value"))), total)
    found = found.groupBy("pos").agg(*[F.min(F.when(F.col("kind") == k, F.col("eid"))).alias(f"by_{k}") for k in ("isin", "symbol", "slug")])
    now = F.coalesce("by_isin", "by_symbol", F.when(F.coalesce("company_name", F.lit("")) != "", F.col("by_slug")), "pos")
    tail = F.coalesce(F.when(F.col("symbol") != "", F.col("symbol")), F.substring("isin", -4, 4), F.lit(""))
    own = F.when(F.col("by_slug").isNull(), F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.regexp_replace(F.lower(tail), "[^a-z0-9]+", "")))
    out = rows.withColumnRenamed("made_slug", "was").drop("made").join(found, "pos", "left").withColumn("now", now).withColumn("made_slug", F.when(F.col("now") == F.col("pos"), own))
    return out.select("pos", F.col("now").alias("eid"), "made_slug", ((F.col("now") != F.col("eid")) | ~F.col("was").eqNullSafe(F.col("made_slug"))).alias("moved"))


def _state(rows: DataFrame, columns: list[str], texts: set[str], now: str) -> DataFrame:
    """Entities of their rows in turn (eid, pos, made, entity_slug, fields of a change or null, and the columns)."""
    rows = rows.withColumn("on", F.col("made") | F.col("fields").isNotNull())
    last = lambda c, test: F.max_by(F.when(test, F.col(c)), F.when(test, F.col("pos")))

    def value(c: str) -> Column:
        if c == "slug":
            return F.max("entity_slug")
        if c == "created_at":
            return F.max(F.when(F.col("made"), F.col(c)))
        if c == "updated_at":
            return F.when(F.max(F.col("fields").isNotNull()), F.lit(now)).otherwise(F.max(F.when(F.col("made"), F.col(c))))
        if c == "gmp":
            return F.min_by(F.when(F.col("on"), F.col(c)), F.when(F.col("on") & F.col(c).isNotNull(), F.col("pos")))
        if c == "documents":
            return F.max_by(F.when(F.col("made"), F.col(c)), F.when(F.col("made"), F.col("pos")))
        present = F.col(c).isNotNull() & (F.col(c) != "" if c in texts else F.lit(True))
        return last(c, (F.lit(True) if c == "sources" else F.col("on")) & (F.col("made") | present) & F.col(c).isNotNull())

    out = rows.groupBy("eid").agg(*[value(c).alias(c) for c in columns], F.max(F.col("fields").isNotNull()).alias("_updated"))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    for c in ("documents", "sources", "raw_sources"):
        if c not in columns:
            continue
        entries = rows.where("true" if c == "sources" else "on").select("eid", "pos", "made", F.explode(c).alias("k", "v"))
        if c == "documents":
            given = lambda f: F.col(f"v.{f.name}").isNotNull() & (F.col("made") | (F.col(f"v.{f.name}") != "" if f.dataType.simpleString() == "string" else F.lit(True)))
            entry = F.struct(*[last(f"v.{f.name}", given(f)).alias(f.name) for f in kinds[c].valueType.fields])
        else:
            entry = F.max_by("v", "pos")
        # few kinds and sources to an entity
        maps = entries.groupBy("eid", "k").agg(entry.alias("v")).groupBy("eid").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_map"))
        none = F.when(F.col("_updated"), F.map_from_arrays(F.array(), F.array()).cast(kinds[c])).otherwise(F.col(c)) if c == "documents" else F.col(c)
        out = out.join(maps, "eid", "left").withColumn(c, F.coalesce(F.col("_map").cast(kinds[c]), none)).drop("_map")
    return out.select(*columns)


def take_in_turn(stored: DataFrame, batch: DataFrame, place: str, columns: list[str], texts: set[str], watched: tuple[str, ...], now: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """New state of the stored entities, and actions (slug, action, changes), of the rows of a batch in the order of ``place`` (then _row), each of which sees what those before it wrote."""
    rows, total = _numbered(batch.select(*columns, "_row", F.col(place).alias("_place")), scratch, "turns", F.col("_place").asc_nulls_last(), F.col("_row"))
    marks = _marks(stored.schema, watched).alias("marks")
    light = scratch.save(rows.select("pos", "isin", "symbol", "slug", "company_name", marks), "turns-light")
    held, known = _numbered(stored.select(*columns), scratch, "turns-stored", F.col("slug"))
    # stored entities come before those that rows make
    held = held.withColumn("eid", F.col("pos") - known).withColumn("pos", F.lit(-1).cast("long")).withColumn("made", F.lit(True))
    old = scratch.save(held.select("eid", "pos", "made", marks, "isin", "symbol", F.col("slug").alias("made_slug")), "turns-held")
    guess, turn = light.select("pos", F.col("pos").alias("eid"), F.col("slug").alias("made_slug")), 0
    while True:
        turn += 1
        guess = scratch.save(_round(light, guess, old, total), f"turn-{turn}")
        if turn > 1:
            scratch.drop(f"turn-{turn - 1}")
        if guess.where("moved").isEmpty():
            break
        guess = guess.drop("moved")
    guess = guess.drop("moved")
    slugs = guess.where("made_slug is not null").select("eid", F.col("made_slug").alias("entity_slug")).union(old.select("eid", "made_slug"))
    seen = light.select("pos", "marks").join(guess, "pos").select("eid", "pos", (F.col("eid") == F.col("pos")).alias("made"), "marks").unionByName(old.select("eid", "pos", "made", "marks"))
    changes = scratch.save(_changes(seen), "turns-changes")
    done = guess.select("pos", "eid").join(slugs, "eid").join(changes.drop("eid"), "pos", "left").withColumn("made", F.col("eid") == F.col("pos"))
    done = scratch.save(done, "turns-done")
    ordered = F.filter(F.array(*[F.lit(f) for f in watched]), lambda x: F.array_contains("fields", x))
    action = F.when(F.col("made"), "new").when(F.col("fields").isNull(), "unchanged").otherwise("updated")
    actions = done.select(F.col("entity_slug").alias("slug"), action.alias("action"), F.coalesce(ordered, F.array().cast("array<string>")).alias("changes"))
    none = F.lit(None).cast("array<string>").alias("fields")
    whole = rows.select("pos", *columns).join(done, "pos").unionByName(held.withColumn("entity_slug", F.col("slug")).select("pos", *columns, "eid", "entity_slug", none, "made"))
    return scratch.save(_state(whole, columns, texts, now), "turns-state"), actions
