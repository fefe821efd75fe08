"""Upserts, whole runs, listings, premiums and series."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tallymere.operators import buckets, listing, scrape, series, store
from tallymere.plans import feeds
from tallymere.plans.catalog import NOW, TODAY
from tallymere.plans.scratch import Scratch
from tallymere.streaming.ingest import ingest, version

SCHEMA = (
    "slug string, isin string, symbol string, company_name string, display_name string, status string, issue_type string, price_band struct<min:double,max:double>, lot_size double, "
    "issue_size double, issue_price double, bidding_start string, bidding_end string, listing_date string, sector string, subscription struct<retail:double>, gmp struct<value:double>, "
    "documents map<string,struct<url:string,source:string,status:string,markdown_url:string,page_hashes:array<string>>>, sources map<string,struct<last_fetched:string,url:string>>, "
    "raw_sources map<string,string>, updated_at string, created_at string"
)
TEXTS = {x.split()[0] for x in SCHEMA.split(", ") if x.endswith(" string")}


def entity(slug, **more):
    row = {"slug": slug, "company_name": slug.title(), "sources": {"nse": {"last_fetched": "t"}}, "raw_sources": {"nse": "p"}, "documents": {}, "updated_at": "old", "created_at": "old"}
    return row | more


def frame(spark, rows, schema=SCHEMA):
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "x string")
    return lines.select(F.from_json("x", kind).alias("s")).select("s.*")


def listed(state):
    return sorted(json.dumps(json.loads(r[0]), sort_keys=True) for r in state.select(F.to_json(F.struct(*sorted(state.columns)))).collect())


def test_upsert_by_joins(spark):
    old = [entity("a", isin="I1", status="open", price_band={"min": 1.0, "max": 2.0}, documents={"rhp": {"url": "u", "status": "done", "markdown_url": "m", "page_hashes": ["h"]}}, sector="x"), entity("b", symbol="S2"), entity("c")]
    new = [entity("other", isin="I1", status="closed", price_band={}, documents={"rhp": {"url": "u2", "source": "nse"}}, sector=""), entity("c", sector="ignored", sources={"groww": {"last_fetched": "t2"}}), entity("d")]
    state, actions = store.upsert(frame(spark, old), frame(spark, new).drop("created_at"), "now")
    assert sorted((r["slug"], r["action"], tuple(r["changes"])) for r in actions.collect()) == [("a", "updated", ("status", "price_band", "documents")), ("c", "unchanged", ()), ("d", "new", ())]
    by = {r["slug"]: r.asDict(True) for r in state.collect()}
    assert set(by) == {"a", "b", "c", "d"}
    assert by["a"]["documents"]["rhp"] == {"url": "u2", "source": "nse", "status": "done", "markdown_url": "m", "page_hashes": ["h"]} and by["a"]["price_band"] == {"min": None, "max": None}
    assert (by["a"]["sector"], by["a"]["created_at"], by["a"]["updated_at"]) == ("x", "old", "now")
    assert by["c"]["sector"] is None and set(by["c"]["sources"]) == {"nse", "groww"} and by["d"]["created_at"] == "now"


def test_rows_of_a_batch_see_those_before(spark):
    new = [entity("x", isin="I1", status="open", ord=1), entity("x", isin="I2", status="closed", ord=2), entity("y", isin="I2", ord=3), entity("unknown-ipo", company_name=None, symbol="AB-1", ord=4), entity("unknown-ipo", company_name=None, isin="INE0042", ord=5)]
    state, actions = store.upsert(frame(spark, []), frame(spark, new, SCHEMA + ", ord long").drop("created_at"), "now", order="ord")
    assert sorted((r["slug"], r["action"]) for r in actions.collect()) == [("unknown-ipo", "new"), ("unknown-ipo-0042", "new"), ("x", "new"), ("x", "unchanged"), ("x", "updated")]
    assert {r["slug"]: r["isin"] for r in state.collect()} == {"x": "I2", "unknown-ipo": None, "unknown-ipo-0042": "INE0042"}


def plain_upsert(old, new, now):
    """Rows one after another into a list of entities, by a rule for each field."""
    union = lambda a, b: {**(a or {}), **(b or {})} if a is not None or b is not None else None
    stored_first = lambda a, b: b if a is None else a

    def documents(a, b):
        a, b = a or {}, b or {}
        given = {kind: {k: v for k, v in doc.items() if v not in (None, "")} for kind, doc in b.items()}
        return {kind: {**a.get(kind, {}), **given.get(kind, {})} for kind in [*a, *b]}

    rules = {"slug": stored_first, "gmp": stored_first, "created_at": stored_first, "sources": union, "raw_sources": union, "documents": documents}
    value = lambda a, b, text: a if b is None or (text and b == "") else b
    entities, done = sorted(({**x} for x in old), key=lambda x: x["slug"]), []
    for row in new:
        hits = [[e for e in entities if row.get(k) and e.get(k) == row[k]] for k in ("isin", "symbol")]
        hits.append([e for e in entities if e["slug"] == row["slug"] and row.get("company_name")])
        own = next((h[0] for h in hits if h), None)
        if own is None:
            taken = any(e["slug"] == row["slug"] for e in entities)
            tail = "".join(c for c in (row.get("symbol") or row.get("isin", "")[-4:]).lower() if c.isalnum())
            own = {**row, "slug": f"{row['slug']}-{tail}" if taken else row["slug"], "created_at": now}
            entities.append(own)
            done.append((own["slug"], "new", []))
            continue
        names = {*own, *row}
        after = {n: rules[n](own.get(n), row.get(n)) if n in rules else value(own.get(n), row.get(n), n in TEXTS) for n in names}
        watched = "status price_band lot_size issue_size listing_date bidding_start bidding_end issue_price documents subscription".split()
        changes = [n for n in watched if (after.get(n) or None) != (own.get(n) or None)]
        own.update({**after, "updated_at": now} if changes else {"sources": after["sources"]})
        done.append((own["slug"], "updated" if changes else "unchanged", changes))
    return entities, done


@pytest.mark.parametrize("seed", [1, 2])
def test_upsert_equals_a_sequential_one(spark, seed):
    r = random.Random(seed)

    def some(i, n):
        row = entity(f"e{r.randint(0, n)}", status=r.choice(["open", "closed"]), sources={r.choice("ab"): {"last_fetched": f"t{i}"}}, raw_sources={"nse": f"p{i}"})
        row |= {"isin": f"I{i}"} if r.random() < 0.4 else {}
        row |= {"symbol": f"S{r.randint(0, 2 * n)}"} if r.random() < 0.3 else {}
        return row | {"sector": r.choice(["", "x", "y"]), "documents": {k: {"url": f"u{r.randint(0, 1)}"} for k in r.sample(["rhp", "drhp"], r.randint(0, 2))}}

    old = list({row["slug"]: row | {"symbol": f"T{k}"} for k, row in enumerate(some(i, 20) for i in range(20))}.values())
    new = [some(i, 40) | {"ord": i} for i in range(45)]
    state, actions = store.upsert(frame(spark, old), frame(spark, new, SCHEMA + ", ord long").drop("created_at").repartition(3), "now", order="ord")
    expected, done = plain_upsert(old, [{k: v for k, v in row.items() if k != "ord"} for row in new], "now")
    assert sorted((x["slug"], x["action"], list(x["changes"])) for x in actions.collect()) == sorted(done)
    assert listed(state) == listed(frame(spark, expected))


def files(path):
    return {str(f): (f.stat().st_mtime_ns, f.stat().st_size) for f in path.rglob("part-*")}


def test_buckets_equal_the_whole_store_and_stay_where_untouched(spark, tmp_path):
    old = [entity(f"e{i}", isin=f"I{i}", symbol=f"S{i}" if i % 2 else None, status="open") for i in range(60)]
    one = buckets.BucketStore(spark, str(tmp_path / "store"), SCHEMA, buckets=8)
    assert one.entities().count() == 0
    one.upsert(frame(spark, old).drop("created_at"), "t0")
    state, _ = store.upsert(frame(spark, []), frame(spark, old).drop("created_at"), "t0")
    assert listed(one.entities()) == listed(state)
    before = files(tmp_path / "store")
    # by isin, by symbol, by slug, one that takes another isin, one that is new, and two of one key
    batch = [entity("x", isin="I3", status="closed"), entity("y", symbol="S5", status="closed"), entity("e7", isin="I700", status="closed"), entity("new", isin="N1"), entity("z", isin="I700", sector="s"), entity("e8", isin="I8", status="open")]
    batch = [row | {"ord": i} for i, row in enumerate(batch)]
    incoming = frame(spark, batch, SCHEMA + ", ord long").drop("created_at")
    whole = state.persist()
    state, actions = store.upsert(whole, incoming, "t1", order="ord")
    rows = lambda a: sorted((x["slug"], x["action"], tuple(x["changes"])) for x in a.collect())
    assert rows(one.upsert(incoming, "t1", order="ord")) == rows(actions)
    assert listed(one.entities()) == listed(state)
    after = files(tmp_path / "store")
    folder = lambda f: "/".join(f.split("/")[-3:-1])
    changed = {folder(f) for f in before.keys() ^ after.keys()}
    entities = {f for f in changed if f.startswith("entities")}
    assert 0 < len(entities) <= 5 and len({folder(f) for f in after if "/entities/" in f}) == 8
    assert all(after[f] == before[f] for f in before if folder(f) not in changed)
    # keys that changed lead to the entity from then on, former ones no more
    state, actions = store.upsert(state.persist(), frame(spark, [entity("q", isin="I700", status="listed"), entity("p", isin="I7", status="listed")]).drop("created_at"), "t2")
    assert rows(one.upsert(frame(spark, [entity("q", isin="I700", status="listed"), entity("p", isin="I7", status="listed")]).drop("created_at"), "t2")) == rows(actions)
    assert listed(one.entities()) == listed(state)
    whole.unpersist()


def test_a_batch_for_buckets_saves_whole_rows_twice(spark, tmp_path, monkeypatch):
    """The batch, and what it makes or changes; they were saved six times."""
    one = buckets.BucketStore(spark, str(tmp_path / "store"), SCHEMA, buckets=4)
    one.upsert(frame(spark, [entity(f"e{i}", isin=f"I{i}", status="open") for i in range(12)]).drop("created_at"), "t0")
    batch = frame(spark, [entity(f"e{i}", isin=f"I{i}", status="open" if i % 2 else "closed") for i in range(12)] + [entity("x", isin="I99")]).drop("created_at")
    state, actions = store.upsert(one.entities(), batch, "t1")
    expected = listed(state), sorted((r["slug"], r["action"]) for r in actions.collect())
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, rows, name, *more: saved.append((name, rows.count() if "raw_sources" in rows.schema.simpleString() else 0)) or save(self, rows, name, *more))
    done = one.upsert(batch, "t1")
    assert (listed(one.entities()), sorted((r["slug"], r["action"]) for r in done.collect())) == expected
    assert [name for name, rows in saved if rows] == ["batch", "told"] and not list((tmp_path / "store").glob(".next-*"))


def test_a_run_twice_changes_nothing(spark, small):
    landing = feeds.feeds(spark, small)
    first = scrape.run_feeds(landing, None, NOW, TODAY, sources=("upstox", "nse", "groww", "zerodha", "bourse"))
    assert [tuple(x) for x in first.errors.collect()] == [("bourse", "unknown source")]
    assert {x["source"]: x["records"] for x in first.counts.collect()} == {"upstox": 50, "nse": 50, "groww": 50, "zerodha": 50, "bourse": 0}
    n = first.merged.first()
    assert n["records"] == 200 and 0 < n["listed_dropped"] < n["masters"] < 200
    state = first.state.persist()
    assert state.count() == state.select("slug").distinct().count() == first.actions.where("action = 'new'").count()
    again = scrape.run_feeds(landing, state, NOW, TODAY)
    assert again.state.count() == state.count() and again.actions.where("action = 'new'").count() == 0
    dry = scrape.run_feeds(landing, state, NOW, TODAY, sources=["nse"], dry_run=True)
    assert dry.state is None and dry.entities.count() > 0
    cards = [x["slug"] for p in range(1, 9) for x in listing.list_entities(state, page=p, limit=25).collect()]
    assert sorted(cards) == sorted(x["slug"] for x in state.select("slug").collect())
    state.unpersist()


def test_stream_of_landing_files(spark, small, tmp_path):
    rows = [(s, f) for s, f in feeds.feeds(spark, small).items()]
    landing, base = tmp_path / "landing", str(tmp_path / "store")
    for part in range(2):
        for s, f in rows:
            f.where(f"ord % 16 >= {8 * part} and ord % 16 < {8 * part + 8}").select(F.lit(s).alias("source"), "ord", "payload").write.mode("append").json(str(landing))
        ingest(spark, str(landing), base, str(tmp_path / "checkpoint"), lambda: NOW, lambda: TODAY).awaitTermination()
    one, two = (spark.read.parquet(version(base, k)) for k in (0, 1))
    assert one.join(two, "slug", "left_anti").count() == 0 and two.count() > one.count() > 0


def test_counts_from_footers_read_no_rows(spark, small, capsys):
    out = listing.estimate(spark, f"{small}/lineitem.parquet")
    assert out.first()["ipos"] == spark.read.parquet(f"{small}/lineitem.parquet").count()
    capsys.readouterr()
    out.explain()
    plan = capsys.readouterr().out
    assert "PushedAggregation: [COUNT(*)]" in plan
    assert "parquet" in (spark.conf.get("spark.sql.sources.useV1SourceList") or "")  # the caller's session stays as it was


def test_tables_of_a_scope_go_with_it(spark):
    from tallymere.plans.scratch import Scratch, scope

    kept = Scratch(spark, "kept").save(spark.range(3).toDF("n"), "t")
    with scope(spark):
        inside = Scratch(spark, "inside")
        assert inside.save(spark.range(3).toDF("n"), "t").count() == 3
    assert kept.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(f"{inside.path}/t").count()


def test_premium_run(spark):
    rows = [entity("hexagon", company_name="Hexagon Nutrition Ltd", status="open"), entity("zero", company_name="Zero Premium", status="upcoming"), entity("done", company_name="Done Deal", status="listed"), entity("none", company_name="Completely Unrelated", status="open")]
    entries = spark.createDataFrame([(1, "Hexagon Nutrition", 8.0, 45.0, None), (2, "Zero Premium", 0.0, 10.0, None)], "ord long, company_name string, gmp double, price double, gmp_percent double")
    hits, skipped = listing.premium_run(frame(spark, rows), entries, "now", slugs=["hexagon", "zero", "done", "none"])
    assert [(r["slug"], r["value"], r["percentage"]) for r in hits.collect()] == [("hexagon", 8.0, 17.78)]
    assert {r["slug"]: r["reason"] for r in skipped.collect()} == {"zero": "no GMP found", "none": "no GMP found", "done": "status listed — no live GMP"}
    written = {r["slug"]: r["gmp"] for r in listing.with_premium(frame(spark, rows).withColumn("gmp", F.lit(None).cast("struct<value:double,percentage:double,source:string,updated_at:string>")), hits, "now").collect()}
    assert written["hexagon"]["value"] == 8.0 and written["zero"] is None


def test_historical(spark):
    candles = spark.createDataFrame([("a", 0, "2026-06-14", 60.0, 62.0, 59.0, 61.0), ("a", 1, "2026-06-12", 48.0, 52.0, 46.0, 50.0), ("a", 2, "2026-06-13", 50.0, 61.0, 50.0, 60.0)], "isin string, ord int, date string, open double, high double, low double, close double")
    out = series.historical(candles, "isin", F.lit(45.0)).first()
    assert tuple(out) == ("a", 48.0, 52.0, 46.0, 61.0, 6.67, "2026-06-14")
    assert series.historical(candles.where("ord > 9"), "isin", F.lit(45.0)).count() == 0
    rows = [entity("a", isin="a", status="listed", listing_date="2026-06-12", issue_price=45.0), entity("b", isin="b", status="listed", listing_date="29-MAY-2026")]
    blocks, skipped = listing.historical_run(frame(spark, rows), candles, since="2026-06-01")
    assert [r["slug"] for r in blocks.collect()] == ["a"] and [r["slug"] for r in skipped.collect()] == ["b"]


def test_every_query_has_rows(spark, small):
    import __spark_entry__

    oracles = __spark_entry__.oracle_sql()
    assert set(oracles) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_rows_without_keys_are_spread_when_they_are_resolved(spark):
    """With their null as key, all of them were one task's."""
    incoming = spark.range(400).selectExpr("concat('s', id) slug", "cast(null as string) isin", "if(id = 7, 'K', '') symbol", "'c' company_name")
    stored = spark.createDataFrame([("t", "I", "K"), ("s9", "", None)], "slug string, isin string, symbol string")
    met = store.resolve(incoming, stored)
    assert {(r["slug"], r["stored_slug"]) for r in met.where("stored_slug is not null").collect()} == {("s7", "t"), ("s9", "s9")} and met.count() == 400
    assert "_key" in met._jdf.queryExecution().optimizedPlan().toString() and "(isin#" not in str([x for x in met._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join LeftOuter" in x])


def test_the_least_entity_that_has_a_key_at_a_time(spark):
    from tallymere.operators.turns import least_alive

    r = random.Random(5)
    intervals = [(r.choice("ab"), s := r.randint(0, 600), r.choice([None, s + r.randint(1, 90)]) if r.random() < 0.3 else s + r.randint(1, 90), r.randint(-50, 600)) for _ in range(60)]
    asks = [(k, pos) for k in "abc" for pos in range(0, 700, 3)]
    out = least_alive(spark.createDataFrame(intervals, "key string, start long, end long, eid long"), spark.createDataFrame(asks, "key string, pos long"), 700)
    alive = {(k, p): [e for key, s, t, e in intervals if key == k and s <= p and (t is None or p < t)] for k, p in asks}
    assert {(x["key"], x["pos"]): x["eid"] for x in out.collect()} == {at: min(own) for at, own in alive.items() if own}


def test_rows_of_one_key_are_no_one_task(spark, monkeypatch):
    """A group that shares keys was folded whole by one Python worker."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", None)
    old = [entity("a", isin="I1", symbol="S"), entity("b", symbol="S"), entity("c", documents={"rhp": {"url": ""}})]
    new = [entity("p", isin="I1", symbol="T", status="open"), entity("q", symbol="S", status="open"), entity("r", symbol="T", status="open"), entity("c", documents={"rhp": {"url": "u"}, "drhp": {}}), entity("c", company_name=None), entity("c", sector="")]
    rows = [row | {"ord": i} for i, row in enumerate(new)]
    state, actions = store.upsert(frame(spark, old), frame(spark, rows, SCHEMA + ", ord long").drop("created_at"), "now", order="ord")
    expected, done = plain_upsert(old, new, "now")
    assert sorted((x["slug"], x["action"], list(x["changes"])) for x in actions.collect()) == sorted(done)
    assert listed(state) == listed(frame(spark, expected))
