"""The entity table: resolution, upsert with change detection, deletes, logs.

A store is a Parquet table.  Writes make a new version from the state and the
incoming rows; nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import filled
from ..plans.graph import components
from ..plans.scratch import Scratch
from .turns import take_in_turn

WATCHED = ("status", "price_band", "lot_size", "issue_size", "listing_date", "bidding_start", "bidding_end", "issue_price", "documents", "subscription")
MAPS = ("documents",)
JOB_EVENT = "job_id string, type string, ord bigint, at string, event string, msg string"


def resolve(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds stored_slug: the stored entity with the same isin, else symbol, else slug; null if none. Keys of the store are unique by their first slug."""
    text = lambda key: F.concat(F.lit("="), key)
    by = lambda key: stored.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(text(key).alias("_key")).agg(F.min("slug").alias(f"_{key}"))
    out = incoming
    for key in ("isin", "symbol"):
        # rows without a key find nothing; a text of their own keeps them out of one task
        own = F.when(F.coalesce(F.col(key), F.lit("")) != "", text(key)).otherwise(F.concat(F.lit("-"), "slug"))
        out = out.withColumn("_key", own).join(by(key), "_key", "left").drop("_key")
    slugs = stored.select(F.col("slug").alias("_slug")).distinct()
    out = out.join(slugs, out["slug"] == F.col("_slug"), "left")
    found = F.coalesce("_isin", "_symbol", F.when(filled(F.col("company_name")).isNotNull(), F.col("_slug")))
    return out.withColumn("stored_slug", found).drop("_isin", "_symbol", "_slug")


def prefer_incoming(old: Column, new: Column, text: bool = False) -> Column:
    """The incoming value unless it is missing; 0 and false are values, '' is not. Structs count as wholes."""
    return F.coalesce(filled(new) if text else new, old)


def merge_documents(old: Column, new: Column) -> Column:
    """By document type, the incoming url and source over the stored ones; what processing added is kept."""
    pick = lambda a, b, f: F.coalesce(filled(b[f]), a[f])
    merged = lambda k, a, b: F.struct(
        pick(a, b, "url").alias("url"), pick(a, b, "source").alias("source"), pick(a, b, "status").alias("status"),
        pick(a, b, "markdown_url").alias("markdown_url"), F.coalesce(b["page_hashes"], a["page_hashes"]).alias("page_hashes"),
    )
    return F.map_zip_with(F.coalesce(old, F.create_map().cast("map<string,struct<url:string,source:string,status:string,markdown_url:string,page_hashes:array<string>>>")), F.coalesce(new, old), merged)


def _plain(c: Column, name: str) -> Column:
    return F.array_sort(F.map_entries(c)) if name in MAPS else c


def changed_fields(old: str, new: str, fields: tuple[str, ...] = WATCHED) -> Column:
    """Names of the watched fields that differ between two structs, in order."""
    names = [F.when(~_plain(F.col(f"{old}.{f}"), f).eqNullSafe(_plain(F.col(f"{new}.{f}"), f)), F.lit(f)) for f in fields]
    return F.filter(F.array(*names), lambda x: x.isNotNull())


def merge_into(old: str, new: str, columns: list[str], texts: set[str]) -> Column:
    """Struct of the merged entity: scalars prefer incoming, documents deep, sources and payloads by key, premium and creation as stored."""
    o, n = (lambda c: F.col(f"{old}.{c}")), (lambda c: F.col(f"{new}.{c}"))
    parts = []
    for c in columns:
        if c == "slug":
            value = o(c)
        elif c == "documents":
            value = merge_documents(o(c), n(c))
        elif c in ("sources", "raw_sources"):
            value = F.when(o(c).isNull() | n(c).isNull(), F.coalesce(o(c), n(c))).otherwise(F.map_concat(F.map_filter(o(c), lambda k, v: ~F.map_contains_key(n(c), k)), n(c)))
        elif c == "gmp":
            value = F.coalesce(o(c), n(c))
        elif c == "created_at":
            value = F.coalesce(o(c), n(c))
        else:
            value = prefer_incoming(o(c), n(c), c in texts)
        parts.append(value.alias(c))
    return F.struct(*parts)


def _crowded(stored: DataFrame, incoming: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame] | None:
    """Incoming rows (_row) and stored entities (slug) by group (part), of groups that hold several incoming rows, or one without a name."""
    value = lambda kind, c: F.xxhash64(F.lit(kind), F.col(c))
    keys = F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) != "", value(c, c)) for c in ("isin", "symbol", "slug")])
    linked = lambda frame, kind, own: frame.select(value(kind, own).alias("a"), F.explode(keys).alias("b")).where("b is not null")
    new = scratch.save(linked(incoming, "row", "_row"), "incoming-keys")
    old = linked(stored, "stored", "slug")
    # where no key has two rows and no stored entity is met by two, every group has one row, and groups need not be found
    several = lambda pairs, by, of: not pairs.groupBy(by).agg(F.min(of).alias("least"), F.max(of).alias("most")).where("least <> most").isEmpty()
    meets = old.join(new.withColumnRenamed("a", "row"), "b").select("a", "row")
    unnamed = F.coalesce(F.col("company_name"), F.lit("")) == ""
    if not several(new, "b", "a") and not several(meets, "a", "row") and incoming.where(unnamed).isEmpty():
        return None
    met = old.join(new.select("b").distinct(), "b", "left_semi").select("a").distinct()
    groups = scratch.save(components(new.union(old.join(met, "a", "left_semi")), scratch, "upsert"), "groups")
    nameless = (F.coalesce(F.col("company_name"), F.lit("")) == "").alias("nameless")
    rows = incoming.select("_row", nameless, value("row", "_row").alias("node")).join(groups, "node")
    crowded = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.max("nameless").alias("nameless")).where("n > 1 or nameless").select("component")
    crowded = scratch.save(crowded, "crowded")
    if crowded.isEmpty():
        return None
    part = F.col("component").alias("part")
    ours = rows.join(crowded, "component").select("_row", part)
    theirs = stored.select("slug", value("stored", "slug").alias("node")).join(groups, "node").join(crowded, "component").select("slug", part)
    return ours, theirs


def upsert(stored: DataFrame, incoming: DataFrame, now: str, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """New state, and actions (slug, action, changes), of a batch of entities.

    Without a change in a watched field only ``sources`` is written.  Rows that share no identifier, symbol or slug with another row
    of the batch, directly or through stored entities, meet the store by joins.  Those that do are taken in turn,
    by the column ``order`` (else by slug), and each sees what those before it wrote (``turns``).  A row without a
    name never takes a stored slug; its own gets its symbol or the end of its isin as a suffix.
    """
    scratch = Scratch(stored.sparkSession, "upsert")
    both, turned = _met_and_turned(stored, prepared(incoming, now, scratch), now, order, scratch)
    state, actions = both.select("state.*"), both.where("action is not null").select(F.col("key").alias("slug"), "action", "changes")
    return (state, actions) if turned is None else (state.unionByName(turned[0]), actions.unionByName(turned[1]))


def upsert_fresh(stored: DataFrame, batch: DataFrame, now: str, order: str | None, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """As upsert, of a prepared batch: the entities that it makes or changes, without those that stay as they were, and the actions. What is returned reads no stored entity."""
    both, turned = _met_and_turned(stored, batch, now, order, scratch)
    stays = F.to_json("state").eqNullSafe(F.to_json("old"))
    told = scratch.save(both.where("action is not null").select(F.col("key").alias("slug"), "action", "changes", F.when(~stays, F.col("state")).alias("state")), "told")
    fresh, actions = told.where("state is not null").select("state.*"), told.select("slug", "action", "changes")
    if turned is None:
        return fresh, actions
    was = stored.join(turned[0].select("slug"), "slug", "left_semi").select("slug", F.to_json(F.struct(*stored.columns)).alias("was"))
    more = turned[0].join(was, "slug", "left").where(~F.to_json(F.struct(*stored.columns)).eqNullSafe(F.col("was"))).drop("was")
    return scratch.save(fresh.unionByName(more), "fresh"), actions.unionByName(turned[1])


def prepared(incoming: DataFrame, now: str, scratch: Scratch) -> DataFrame:
    """A batch as it is taken: saved, with the time of creation and a number of each row (_row)."""
    return scratch.save(incoming.withColumn("created_at", F.lit(now)).withColumn("_row", F.monotonically_increasing_id()), "batch")


def _met_and_turned(stored: DataFrame, batch: DataFrame, now: str, order: str | None, scratch: Scratch) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """Rows that share no key with others, met with the store (``_met``), and of those that do state and actions, if there are any."""
    columns = stored.columns
    texts = {f.name for f in stored.schema.fields if f.dataType.simpleString() == "string"}
    crowded = _crowded(stored, batch, scratch)
    if crowded is None:
        return _met(stored, batch, columns, texts, now), None
    ours, theirs = crowded
    alone = _met(stored.join(theirs, "slug", "left_anti").select(*columns), batch.join(ours, "_row", "left_anti"), columns, texts, now)
    return alone, take_in_turn(stored.join(theirs.select("slug"), "slug", "left_semi"), batch.join(ours.select("_row"), "_row"), order or "slug", columns, texts, WATCHED, now, scratch)


def _entity_of(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Columns _row, stored_slug: the stored entities that ``resolve`` gives to rows, of those that have one. Only a row's number and the key that it has move."""
    has = lambda key: F.coalesce(F.col(key), F.lit("")) != ""
    found = fresh.where(filled(F.col("company_name")).isNotNull()).select("_row", "slug").join(stored.select("slug").distinct(), "slug").select("_row", F.lit(2).alias("place"), "slug")
    for place, key in enumerate(("isin", "symbol")):
        first = stored.where(has(key)).groupBy(key).agg(F.min("slug").alias("slug"))
        found = found.union(fresh.where(has(key)).select("_row", key).join(first, key).select("_row", F.lit(place), "slug"))
    return found.groupBy("_row").agg(F.min(F.struct("place", "slug"))["slug"].alias("stored_slug"))


def _met(stored: DataFrame, fresh: DataFrame, columns: list[str], texts: set[str], now: str) -> DataFrame:
    """Entities and rows that each have an entity or a new slug of their own: key, old, state, changes, and action, null without a row. Rows find their entity by their keys alone, and move whole only then."""
    found = fresh.join(_entity_of(fresh, stored), "_row", "left").select(F.coalesce("stored_slug", "slug").alias("key"), F.struct(*[F.col(c) for c in columns]).alias("new"))
    old = stored.select(F.col("slug").alias("key"), F.struct(*columns).alias("old"))
    both = old.join(found, "key", "full").withColumn("merged", F.when(F.col("old").isNull(), F.col("new")).when(F.col("new").isNotNull(), merge_into("old", "new", columns, texts)))
    both = both.withColumn("changes", F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), changed_fields("old", "merged")).otherwise(F.array().cast("array<string>")))
    action = F.when(F.col("new").isNull(), None).when(F.col("old").isNull(), "new").when(F.size("changes") == 0, "unchanged").otherwise("updated")
    both = both.withColumn("action", action)
    touched = F.struct(*[(F.col("merged.sources") if c == "sources" else F.col(f"old.{c}")).alias(c) for c in columns])
    written = F.struct(*[(F.lit(now) if c == "updated_at" else F.col(f"merged.{c}")).alias(c) for c in columns])
    state = F.when(F.col("action").isNull(), F.col("old")).when(F.col("action") == "new", F.col("new")).when(F.col("action") == "unchanged", touched).otherwise(written)
    return both.select("key", "old", state.alias("state"), "changes", "action")


def tally(actions: DataFrame) -> DataFrame:
    """One row: new, updated, unchanged."""
    return actions.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("new", "updated", "unchanged")])


def delete_cascade(entities: DataFrame, history: DataFrame, slugs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given slugs."""
    return entities.join(slugs, "slug", "left_anti"), history.join(slugs, "slug", "left_anti")


def append_error(errors: Column, error: Column, most: int = 5) -> Column:
    """Error log with one more entry, of which the last ``most`` stay."""
    grown = F.concat(F.coalesce(errors, F.array()), F.array(error))
    return F.slice(grown, F.greatest(F.lit(1), F.size(grown) - most + 1), F.lit(most))


class TrackedRun:
    """Appends the events of one job to a table of events (see job_states) in a folder, row by row as they happen.

    ``clock`` gives the time of an event as text.  An event is a file of one row, so a job's log survives the driver.
    """

    def __init__(self, spark: SparkSession, folder: str, job_id: str, kind: str, clock: Callable[[], str]):
        self.spark, self.folder, self.job_id, self.kind, self.clock, self.ord = spark, folder, job_id, kind, clock, 0

    def add(self, event: str, msg: str | None = None) -> None:
        row = (self.job_id, self.kind, self.ord, self.clock(), event, msg)
        self.spark.createDataFrame([row], JOB_EVENT).coalesce(1).write.mode("append").parquet(self.folder)
        self.ord += 1

    def log(self, msg: str) -> None:
        self.add("log", msg)


def tracked(spark: SparkSession, folder: str, job_id: str, kind: str, work: Callable[[TrackedRun], object], clock: Callable[[], str]) -> object:
    """What ``work`` returns, with events around it: running, its logs, and completed or failed. Its error is raised again."""
    run = TrackedRun(spark, folder, job_id, kind, clock)
    run.add("running")
    try:
        out = work(run)
    except Exception as error:
        run.add("failed", str(error))
        raise
    run.add("completed")
    return out


def job_states(events: DataFrame) -> DataFrame:
    """Jobs from their events (job_id, type, ord, at, event, msg): the last status, ordered log, and times."""
    log = F.array_sort(F.collect_list(F.when(F.col("event") == "log", F.struct("ord", "at", "msg"))))
    state = F.max_by(F.when(F.col("event") != "log", F.col("event")), F.when(F.col("event") != "log", F.col("ord")))
    ended = F.max(F.when(F.col("event").isin("completed", "failed"), F.col("at")))
    begun = F.min("at")
    return events.groupBy("job_id", "type").agg(
        F.coalesce(state, F.lit("running")).alias("status"), F.transform(log, lambda x: F.struct(x["at"], x["msg"])).alias("logs"),
        begun.alias("created_at"), ended.alias("finished_at"),
        (F.unix_millis(F.to_timestamp(ended)) - F.unix_millis(F.to_timestamp(begun))).alias("duration_ms"),
    )


def last_jobs(jobs: DataFrame, most: int = 20, kind: str | None = None, status: str | None = None) -> DataFrame:
    """The latest jobs without logs, at most 100."""
    if kind:
        jobs = jobs.where(F.col("type") == kind)
    if status:
        jobs = jobs.where(F.col("status") == status)
    return jobs.drop("logs", "params").orderBy(F.col("created_at").desc(), "job_id").limit(min(100, most))


def get_job(jobs: DataFrame, job_id) -> DataFrame:
    """One job with its log; no row for an unknown identifier."""
    return jobs.where(F.col("job_id") == F.lit(job_id))


def latest(frame: DataFrame, key: str, *order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return frame.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
