"""Registered queries that save and read again, and those of terminals and loading, each with the same in SQL."""

from __future__ import annotations

import datetime as dt
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.catalogue import query
from sedge.errors import ConcurrencyError, SedgeError
from sedge.model.build import ModelConfig
from sedge.model.converters import Converter
from sedge.plugins import Plugin, SoftDelete, Timestamps
from sedge.sources.tables import MemoryTables, VersionedTables
from sedge.workspace import Record, Workspace


def geography(behaviour: str = "cascade") -> ModelConfig:
    """Regions and their nations, with a delete behaviour; a region's name guards against stale updates."""
    m = ModelConfig()
    r = m.entity("Region").table("region").key("id")
    r.property("id").column("r_regionkey")
    r.property("name").column("r_name").of_type("string").concurrency_token()
    n = m.entity("Nation").table("nation").key("id")
    for p, c in {"id": "n_nationkey", "name": "n_name", "regionId": "n_regionkey"}.items():
        n.property(p).column(c)
    r.has_many("nations", "Nation").with_one("region").foreign_key("regionId").on_delete(behaviour)
    return m


def stored(w: Workspace, config: ModelConfig, plugins: list[Plugin] | None = None, **changes: Callable[[DataFrame], DataFrame]) -> Callable[[], Workspace]:
    """Workspaces over a new versioned store with a copy of the entities' tables, in the folder that executors share."""
    model = Workspace(w.spark, None, config, plugins=plugins or []).model
    shared = w.spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="sedge-")
    store = VersionedTables(w.spark, f"{shared.removeprefix('file://')}/store-{uuid.uuid4().hex}", model)
    for e in model.entities:
        rows = w.tables.read(e)
        store.replace(e, changes.get(e.name, lambda x: x)(rows))
    return lambda: Workspace(w.spark, store, model, plugins=plugins or [])


def regions(w: Workspace) -> DataFrame:
    return w.set("Region").to_df().select(F.col("r_regionkey").cast("long").alias("regionkey"), F.col("r_name").alias("name"))


def nations(w: Workspace) -> DataFrame:
    return w.set("Nation").to_df().select(F.col("n_nationkey").cast("long").alias("nationkey"), F.col("n_regionkey").cast("long").alias("regionkey"))


@query("SELECT r_regionkey::BIGINT AS regionkey, r_name AS name FROM region UNION ALL SELECT max(r_regionkey) + 1, 'ATLANTIS' FROM region UNION ALL SELECT max(r_regionkey) + 2, 'LEMURIA' FROM region")
def save_insert(w):
    new = stored(w, geography())
    first = new()
    added = first.set("Region").add(Record(id=None, name="ATLANTIS"))
    first.set("Region").add(Record(id=None, name="LEMURIA"))
    assert first.save_changes() == 2 and added.id is not None
    return regions(new())


@query("SELECT r_regionkey::BIGINT AS regionkey, CASE WHEN r_regionkey = 2 THEN 'CHANGED' ELSE r_name END AS name FROM region")
def save_update(w):
    new = stored(w, geography())
    first = new()
    first.set("Region").find(2).name = "CHANGED"
    assert first.save_changes() == 1
    return regions(new())


@query("SELECT n_nationkey::BIGINT AS nationkey, n_regionkey::BIGINT AS regionkey FROM nation WHERE n_regionkey <> 1")
def save_delete_cascade(w):
    new = stored(w, geography("cascade"))
    first = new()
    first.set("Region").remove(first.set("Region").find(1))
    first.save_changes()
    assert new().set("Region").find(1) is None
    return nations(new())


@query("SELECT n_nationkey::BIGINT AS nationkey, nullif(n_regionkey, 1)::BIGINT AS regionkey FROM nation")
def save_delete_set_null(w):
    new = stored(w, geography("set_null"))
    first = new()
    first.set("Region").remove(first.set("Region").find(1))
    first.save_changes()
    return nations(new())


@query("SELECT n_nationkey::BIGINT AS nationkey, n_regionkey::BIGINT AS regionkey, true AS refused FROM nation")
def save_delete_restrict(w):
    new = stored(w, geography("restrict"))
    first, refused = new(), False
    first.set("Region").remove(first.set("Region").find(1))
    try:
        first.save_changes()
    except SedgeError:
        refused = True
    return nations(new()).withColumn("refused", F.lit(refused))


@query("SELECT r_regionkey::BIGINT AS regionkey, CASE WHEN r_regionkey = 3 THEN 'FIRST' ELSE r_name END AS name, true AS refused FROM region")
def save_stale_update(w):
    """The second of two who read the same row fails, and nothing it changed is kept."""
    new = stored(w, geography())
    a, b, refused = new(), new(), False
    x, y = a.set("Region").find(3), b.set("Region").find(3)
    x.name, y.name = "FIRST", "SECOND"
    a.save_changes()
    b.set("Region").add(Record(id=None, name="LOST"))
    try:
        b.save_changes()
    except ConcurrencyError:
        refused = True
    return regions(new()).withColumn("refused", F.lit(refused))


@query("SELECT r_regionkey::BIGINT AS regionkey, CASE WHEN r_regionkey >= 3 THEN 'FAR' ELSE r_name END AS name FROM region")
def bulk_update_store(w):
    new = stored(w, geography())
    assert new().set("Region").where(lambda r: r.id >= 3).update({"name": "FAR"}) == 2
    return regions(new())


@query("SELECT n_nationkey::BIGINT AS nationkey, n_regionkey::BIGINT AS regionkey FROM nation WHERE NOT (n_name LIKE 'NATION_1%')")
def bulk_delete_store(w):
    new = stored(w, geography("no_action"))
    new().set("Nation").where(lambda n: n.name.starts_with("NATION_1")).delete()
    return nations(new())


@query("SELECT r_regionkey::BIGINT AS regionkey, CASE WHEN r_regionkey IN (1, 5) THEN '2024-01-02 03:04:05' END AS updated FROM (SELECT r_regionkey FROM region UNION SELECT 5)")
def timestamps_saved(w):
    """Insert and update are stamped, untouched rows are not."""
    stamps = Timestamps(clock=lambda: dt.datetime(2024, 1, 2, 3, 4, 5))
    config = geography()
    del config.entities["Nation"]
    config.entities["Region"].navs.clear()
    empty = lambda x: x.withColumns({c: F.lit(None).cast("timestamp_ntz") for c in ("createdAt", "updatedAt")})
    new = stored(w, config, [stamps], Region=empty)
    first = new()
    first.set("Region").add(Record(id=None, name="ATLANTIS"))
    first.set("Region").find(1).name = "CHANGED"
    first.save_changes()
    return new().set("Region").to_df().select(F.col("r_regionkey").cast("long").alias("regionkey"), F.date_format("updatedAt", "yyyy-MM-dd HH:mm:ss").alias("updated"))


@query("SELECT r_regionkey::BIGINT AS regionkey, r_regionkey = 4 AS deleted FROM region")
def soft_delete_saved(w):
    """Removing sets the flag; the row stays in the table and out of queries."""
    config = geography()
    del config.entities["Nation"]
    config.entities["Region"].navs.clear()
    config.entities["Region"].property("isDeleted").of_type("boolean")
    new = stored(w, config, [SoftDelete()], Region=lambda x: x.withColumn("isDeleted", F.lit(False)))
    first = new()
    first.set("Region").remove(first.set("Region").find(4))
    first.save_changes()
    assert new().set("Region").where(lambda r: r.id == 4).any() is False
    after = new()
    return after.tables.read(after.model.entity("Region")).select(F.col("r_regionkey").cast("long").alias("regionkey"), F.col("isDeleted").alias("deleted"))


@query(
    "SELECT 'first' AS what, (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)::BIGINT AS value "
    "UNION ALL SELECT 'first_or_none', -1 UNION ALL SELECT 'single', (SELECT r_regionkey FROM region WHERE r_name = 'ASIA') "
    "UNION ALL SELECT 'find', (SELECT c_nationkey FROM customer WHERE c_custkey = 7) UNION ALL SELECT 'any', 1 UNION ALL SELECT 'none', 0 "
    "UNION ALL SELECT 'to_list', (SELECT sum(s_suppkey) FROM supplier) UNION ALL SELECT 'page', (SELECT count(*) FROM nation)"
)
def terminals(w):
    orders = w.set("Order").as_no_tracking()
    last = orders.where(lambda o: o.total < -1).first_or_none()
    rows = [
        ("first", orders.where(lambda o: o.status == "F").order_by_desc("total").then_by("id").first().id),
        ("first_or_none", -1 if last is None else last.id),
        ("single", w.set("Region").where(lambda r: r.name == "ASIA").single().id),
        ("find", w.set("Customer").find(7).nationId),
        ("any", int(orders.where(lambda o: o.total > 1000).any())),
        ("none", int(orders.where(lambda o: o.total < -1).any())),
        ("to_list", sum(s.id for s in w.set("Supplier").to_list())),
        ("page", w.set("Nation").order_by("id").to_page(2, 10).total),
    ]
    return w.spark.createDataFrame(rows, "what string, value long")


@query("SELECT c_custkey AS custkey, n_name AS nation, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def several_includes(w):
    df = w.set("Customer").include("nation").include("orders").to_df()
    return df.select(F.col("c_custkey").alias("custkey"), F.col("nation.n_name").alias("nation"), F.size("orders").cast("long").alias("orders"))


@query("SELECT n_nationkey::BIGINT AS nationkey, n_regionkey::BIGINT AS regionkey FROM nation WHERE n_regionkey = 2")
def explicit_load(w):
    """Rows behind one object's collection, as its query and as loaded objects."""
    region = w.set("Region").find(2)
    lazy = w.entry(region).collection("nations")
    rows = [(n.id, n.regionId) for n in lazy.load()]
    assert len(rows) == lazy.query().count() == len(region.nations)
    return w.spark.createDataFrame(rows, "nationkey long, regionkey long")


@query("SELECT c_custkey AS custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
def owned_path(w):
    m = ModelConfig()
    e = m.entity("Customer").table("customer").key("id")
    e.property("id").column("c_custkey")
    e.owns_one("account", "Account")
    m.entity("Account").property("segment")
    m.configure("Account").property("balance")
    rows = w.tables.read(w.model.entity("Customer")).withColumnsRenamed({"c_mktsegment": "account_segment", "c_acctbal": "account_balance"})
    w = Workspace(w.spark, MemoryTables(w.spark).seed("customer", rows), m)
    return w.set("Customer").where(lambda c: (c.account.segment == "BUILDING") & (c.account.balance > 5000)).select(lambda c: {"custkey": c.id}).to_df()


@query("SELECT event_id AS id FROM events WHERE props = '{\"k\": 5}'")
def converter_json_filter(w):
    """A structure goes through a JSON converter before it meets the column."""
    m = ModelConfig()
    e = m.entity("Event").table("events").key("id")
    e.property("id").column("event_id")
    e.property("props").convert("document")
    w = Workspace(w.spark, w.tables, m, converters=[Converter("document", json.dumps, json.loads)])
    return w.set("Event").where(lambda e: e.props == {"k": 5}).select(lambda e: {"id": e.id}).to_df()


@query("SELECT o_orderkey AS orderkey FROM orders WHERE nullif(o_orderstatus, 'P') IS NULL")
def filter_is_null_some(w):
    rows = w.tables.read(w.model.entity("Order")).withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    w = Workspace(w.spark, MemoryTables(w.spark).seed("orders", rows), w.model)
    return w.set("Order").where(lambda o: o.status.is_null()).select(lambda o: {"orderkey": o.id}).to_df()
