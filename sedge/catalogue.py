"""The registered queries over the driver's tables, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions.expr import Item
from sedge.model.build import ModelConfig
from sedge.model.converters import Converter
from sedge.plugins import SoftDelete, Tenancy
from sedge.sources.tables import MemoryTables, ParquetTables
from sedge.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def model(filtered: bool = False) -> ModelConfig:
    """The driver's tables as entities."""
    m = ModelConfig()

    def entity(kind: str, where: str, keys: list[str], /, **columns: str):
        e = m.entity(kind).table(where).key(*keys)
        for p, c in columns.items():
            e.property(p).column(c)
        return e

    region = entity("Region", "region", ["id"], id="r_regionkey", name="r_name")
    nation = entity("Nation", "nation", ["id"], id="n_nationkey", name="n_name", regionId="n_regionkey")
    customer = entity("Customer", "customer", ["id"], id="c_custkey", name="c_name", nationId="c_nationkey", balance="c_acctbal", segment="c_mktsegment")
    entity("Supplier", "supplier", ["id"], id="s_suppkey", name="s_name", nationId="s_nationkey", balance="s_acctbal").has_one("nation", "Nation").with_many("suppliers").foreign_key("nationId")
    part = entity("Part", "part", ["id"], id="p_partkey", name="p_name", brand="p_brand", type="p_type", size="p_size", price="p_retailprice")
    order = entity("Order", "orders", ["id"], id="o_orderkey", customerId="o_custkey", status="o_orderstatus", total="o_totalprice", date="o_orderdate", priority="o_orderpriority")
    line = entity("Line", "lineitem", [], orderId="l_orderkey", partId="l_partkey", supplierId="l_suppkey", number="l_linenumber", quantity="l_quantity", price="l_extendedprice", discount="l_discount", tax="l_tax", returned="l_returnflag", status="l_linestatus", shipped="l_shipdate")
    entity("Event", "events", ["id"], id="event_id", at="ts", userId="user_id", kind="event_type", value="value", props="props").property("props").convert("json")
    document = entity("Document", "documents", ["id"], id="doc_id", text="text", lang="lang", source="source", chars="n_chars")
    entity("Label", "labels", ["id"], id="doc_id", quality="quality", toxic="toxic").has_one("document", "Document").with_one("label").foreign_key("id")
    turn = entity("Turn", "conversations", ["conversation", "turn"], conversation="conv_id", turn="turn", role="role", text="text")
    region.has_many("nations", "Nation").with_one("region").foreign_key("regionId")
    nation.has_many("customers", "Customer").with_one("nation").foreign_key("nationId")
    customer.has_many("orders", "Order").with_one("customer").foreign_key("customerId")
    order.has_many("lines", "Line").with_one("order").foreign_key("orderId")
    line.has_one("part", "Part").foreign_key("partId")
    line.has_one("supplier", "Supplier").foreign_key("supplierId")
    part.has_many("suppliers", "Supplier").with_many("parts", "Line")
    turn.has_many("twins", "Turn").foreign_key("conversation", "turn")
    document.property("lang")
    if filtered:
        customer.query_filter(lambda c: c.balance > 0)
    return m


def roles() -> ModelConfig:
    """Two entities on one table, told apart by its role column."""
    m = ModelConfig()
    for name, role in (("UserTurn", "user"), ("AssistantTurn", "assistant")):
        e = m.entity(name).table("conversations").key("conversation", "turn").discriminator("role", role)
        for p, c in {"conversation": "conv_id", "turn": "turn", "text": "text"}.items():
            e.property(p).column(c)
    return m


def tables(spark: SparkSession, sf_dir: str, filtered: bool = False, **more) -> Workspace:
    return Workspace(spark, ParquetTables(spark, sf_dir), model(filtered), **more)


def query(sql: str, filtered: bool = False, name: str | None = None):
    """Registers a function of a workspace under its name with its SQL."""

    def put(f):
        QUERIES[name or f.__name__] = lambda spark, sf_dir: f(tables(spark, sf_dir, filtered))
        SQL[name or f.__name__] = sql
        return f

    return put


def predicate(name: str, entity: str, table: str, key: str, where, sql: str) -> None:
    """A query that keeps the keys of rows a condition holds for."""
    QUERIES[name] = lambda spark, sf_dir: tables(spark, sf_dir).set(entity).where(where).select(lambda x: {key.split("_", 1)[1] if "_" in key else key: _by_column(entity, key, x)}).to_df()
    SQL[name] = f"SELECT {key} AS {key.split('_', 1)[1] if '_' in key else key} FROM {table} WHERE {sql}"


def _by_column(entity: str, column: str, x: Item) -> Item:
    props = model().entities[entity].properties
    return x[next(p for p, c in props.items() if c.said.get("column") == column)]


for _name, _entity, _table, _key, _where, _sql in (
    ("filter_eq", "Customer", "customer", "c_custkey", lambda c: c.segment == "BUILDING", "c_mktsegment = 'BUILDING'"),
    ("filter_neq", "Customer", "customer", "c_custkey", lambda c: c.segment != "BUILDING", "c_mktsegment <> 'BUILDING'"),
    ("filter_ordered_ops", "Order", "orders", "o_orderkey", lambda o: (o.total > 100000) & (o.total <= 200000) & (o.customerId >= 10) & (o.priority < "5"), "o_totalprice > 100000 AND o_totalprice <= 200000 AND o_custkey >= 10 AND o_orderpriority < '5'"),
    ("filter_between", "Part", "part", "p_partkey", lambda p: p.size.between(10, 20), "p_size BETWEEN 10 AND 20"),
    ("filter_in", "Order", "orders", "o_orderkey", lambda o: o.status.is_in(["F", "P"]), "o_orderstatus IN ('F', 'P')"),
    ("filter_in_empty", "Order", "orders", "o_orderkey", lambda o: o.status.is_in([]), "false"),
    ("filter_is_null", "Customer", "customer", "c_custkey", lambda c: c.name.is_null(), "c_name IS NULL"),
    ("filter_not_null", "Customer", "customer", "c_custkey", lambda c: c.name.is_not_null(), "c_name IS NOT NULL"),
    ("like_starts", "Order", "orders", "o_orderkey", lambda o: o.priority.starts_with("1-"), "starts_with(o_orderpriority, '1-')"),
    ("like_ends", "Order", "orders", "o_orderkey", lambda o: o.priority.ends_with("LOW"), "ends_with(o_orderpriority, 'LOW')"),
    ("like_contains", "Part", "part", "p_partkey", lambda p: p.type.contains("E"), "contains(p_type, 'E')"),
    ("like_raw", "Customer", "customer", "c_custkey", lambda c: c.segment.like("%U_L%"), "c_mktsegment LIKE '%U_L%'"),
    ("logic_and_or_not", "Order", "orders", "o_orderkey", lambda o: ~((o.status == "F") | (o.total < 50000)) & (o.priority != "5-LOW"), "NOT (o_orderstatus = 'F' OR o_totalprice < 50000) AND o_orderpriority <> '5-LOW'"),
    ("lower_eq", "Customer", "customer", "c_custkey", lambda c: c.segment.lower() == "machinery", "lower(c_mktsegment) = 'machinery'"),
    ("upper_eq", "Document", "documents", "doc_id", lambda d: d.lang.upper() == "DE", "upper(lang) = 'DE'"),
    ("nav_any", "Order", "orders", "o_orderkey", lambda o: o.lines.any(), "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    ("nav_any_pred", "Customer", "customer", "c_custkey", lambda c: c.orders.any(lambda o: (o.status == "P") & (o.priority == "1-URGENT")), "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')"),
    ("nav_all", "Customer", "customer", "c_custkey", lambda c: c.orders.all(lambda o: o.total > 20000), "NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT (o_totalprice > 20000))"),
    ("nav_none", "Order", "orders", "o_orderkey", lambda o: ~o.lines.any(), "NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    ("nav_count_ge", "Customer", "customer", "c_custkey", lambda c: c.orders.count() >= 12, "(SELECT count(*) FROM orders WHERE o_custkey = c_custkey) >= 12"),
    ("nav_any_nested", "Customer", "customer", "c_custkey", lambda c: c.orders.any(lambda o: (o.status == "F") & o.lines.any(lambda n: (n.returned == "R") & (n.quantity > 49))), "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 49))"),
    ("nav_any_or_scalar", "Customer", "customer", "c_custkey", lambda c: (c.balance > 9000) | c.orders.any(lambda o: o.total > 400000), "c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    ("to_one_path_filter", "Customer", "customer", "c_custkey", lambda c: c.nation.region.name == "ASIA", "(SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = c_nationkey) = 'ASIA'"),
    ("many_to_many_any", "Part", "part", "p_partkey", lambda p: p.suppliers.any(lambda s: s.balance < -500), "EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = p_partkey AND s_acctbal < -500)"),
    ("one_to_one_none", "Document", "documents", "doc_id", lambda d: d.label.toxic == 1, "(SELECT toxic FROM labels l WHERE l.doc_id = documents.doc_id) = 1"),
):
    predicate(_name, _entity, _table, _key, _where, _sql)


@query("SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, l_tax AS tax, l_discount AS discount FROM lineitem WHERE l_tax > l_discount")
def col_to_col(w):
    return w.set("Line").where(lambda x: x.tax > x.discount).select(lambda x: {"orderkey": x.orderId, "linenumber": x.number, "tax": x.tax, "discount": x.discount}).to_df()


@query("SELECT o_orderkey AS orderkey, o_orderdate AS orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def date_range(w):
    import datetime as dt

    return w.set("Order").where(lambda o: (o.date >= dt.datetime(1997, 1, 1)) & (o.date < dt.datetime(1998, 1, 1))).select(lambda o: {"orderkey": o.id, "orderdate": o.date}).to_df()


@query("SELECT o_orderkey AS orderkey, o_totalprice AS total FROM orders WHERE o_totalprice > 200000 AND starts_with(o_orderpriority, '1-') ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(w):
    """The flagship: urgent orders of high value."""
    return w.set("Order").where(lambda o: (o.total > 200000) & o.priority.starts_with("1-")).order_by_desc("total").then_by("id").take(20).select(lambda o: {"orderkey": o.id, "total": o.total}).to_df()


@query("SELECT c_custkey AS custkey, c_mktsegment AS segment FROM customer ORDER BY c_mktsegment, c_nationkey DESC, c_custkey")
def order_then(w):
    """Over all customers, so that the first key changes."""
    return w.set("Customer").order_by("segment").then_by_desc("nationId").then_by("id").select(lambda c: {"custkey": c.id, "segment": c.segment}).to_df()


@query("SELECT c_custkey AS custkey, n_name AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey > 12) ON c_nationkey = n_nationkey ORDER BY n_name DESC NULLS LAST, c_custkey")
def order_desc_nulls(w):
    """Over all customers, so that nulls come in at any size."""
    m = model()
    m.entities["Nation"].query_filter(lambda n: n.id > 12)
    w = Workspace(w.spark, w.tables, m)
    return w.set("Customer").order_by_desc("nation.name").then_by("id").select(lambda c: {"custkey": c.id, "nation": c.nation.name}).to_df()


@query("SELECT p_partkey AS partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 50 OFFSET 30")
def skip_take(w):
    return w.set("Part").order_by("price").then_by("id").skip(30).take(50).select(lambda p: {"partkey": p.id}).to_df()


@query("SELECT DISTINCT p_brand AS brand, p_size AS size FROM part ORDER BY brand, size")
def distinct_projection(w):
    return w.set("Part").select(lambda p: {"brand": p.brand, "size": p.size}).distinct().order_by("brand").then_by("size").to_df()


@query("SELECT s_name AS label, s_acctbal AS money FROM supplier")
def projection_alias(w):
    return w.set("Supplier").select(lambda s: {"label": s.name, "money": s.balance}).to_df()


@query("SELECT c_custkey AS custkey, upper(c_name) AS loud, lower(c_mktsegment) AS quiet FROM customer")
def projection_computed_upper(w):
    return w.set("Customer").select(lambda c: {"custkey": c.id, "loud": c.name.upper(), "quiet": c.segment.lower()}).to_df()


for _name, _sql in (("agg_count", "count(*)"), ("agg_sum", "round(sum(o_totalprice), 2)"), ("agg_avg", "round(avg(o_totalprice), 4)"), ("agg_min", "min(o_totalprice)"), ("agg_max", "max(o_totalprice)")):
    kind = _name[4:]
    QUERIES[_name] = lambda spark, sf_dir, k=kind: tables(spark, sf_dir).set("Order").agg_df(k, None if k == "count" else "total").select((F.round("value", {"sum": 2, "avg": 4}[k]) if k in ("sum", "avg") else F.col("value")).alias("value"))
    SQL[_name] = f"SELECT {_sql} AS value FROM orders"


@query("SELECT round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderstatus = 'F'")
def agg_filtered(w):
    return w.set("Order").where(lambda o: o.status == "F").agg_df("sum", "total").select(F.round("value", 2).alias("value"))


@query("SELECT count(*) AS value FROM (SELECT DISTINCT p_brand, p_type FROM part)")
def agg_distinct(w):
    return w.set("Part").select(lambda p: {"brand": p.brand, "type": p.type}).distinct().agg_df("count")


@query("SELECT c_custkey AS custkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'", filtered=True)
def query_filter(w):
    return w.set("Customer").where(lambda c: c.segment == "BUILDING").select(lambda c: {"custkey": c.id}).to_df()


@query("SELECT c_custkey AS custkey FROM customer WHERE c_mktsegment = 'BUILDING'", filtered=True)
def ignore_query_filter(w):
    return w.set("Customer").ignore_query_filters().where(lambda c: c.segment == "BUILDING").select(lambda c: {"custkey": c.id}).to_df()


@query("SELECT n_nationkey AS nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 0) AS customers FROM nation", filtered=True)
def nav_count_filtered(w):
    return w.set("Nation").select(lambda n: {"nationkey": n.id, "customers": n.customers.count()}).to_df()


@query("SELECT c_custkey AS custkey, c_acctbal AS balance FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal < 1000")
def tenant_filter_projected(w):
    m = model()
    m.entities["Customer"].property("tenantId").column("c_mktsegment")
    del m.entities["Customer"].properties["segment"]
    for n in [n for n in m.entities if n != "Customer"]:
        del m.entities[n]
    m.entities["Customer"].navs.clear()
    w = Workspace(w.spark, w.tables, m, plugins=[Tenancy(lambda: "MACHINERY")])
    return w.set("Customer").where(lambda c: c.balance < 1000).select(lambda c: {"custkey": c.id, "balance": c.balance}).to_df()


@query("SELECT o_orderkey AS orderkey FROM orders WHERE NOT (o_orderstatus = 'F') AND o_totalprice > 250000")
def soft_delete_view(w):
    m = ModelConfig()
    e = m.entity("Order").table("orders").key("id")
    for p, c in (("id", "o_orderkey"), ("total", "o_totalprice"), ("isDeleted", "gone")):
        e.property(p).column(c)
    rows = w.tables.read(w.model.entity("Order")).withColumn("gone", F.col("o_orderstatus") == "F")
    w = Workspace(w.spark, MemoryTables(w.spark).seed("orders", rows), m, plugins=[SoftDelete()])
    return w.set("Order").where(lambda o: o.total > 250000).select(lambda o: {"orderkey": o.id}).to_df()


@query("SELECT conv_id AS conversation, turn, length(text) AS n FROM conversations WHERE role = 'assistant'")
def discriminator_view(w):
    w = Workspace(w.spark, w.tables, roles())
    return w.set("AssistantTurn").to_df().select(F.col("conv_id").alias("conversation"), "turn", F.length("text").cast("long").alias("n"))


@query("SELECT c_custkey AS custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders FROM customer")
def nav_count_projected(w):
    return w.set("Customer").select(lambda c: {"custkey": c.id, "orders": c.orders.count()}).to_df()


@query("SELECT s_suppkey AS suppkey, n_name AS nation, r_name AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def include_reference(w):
    df = w.set("Supplier").include("nation").then_include("region").to_df()
    return df.select(F.col("s_suppkey").alias("suppkey"), F.col("nation.n_name").alias("nation"), F.col("nation.region.r_name").alias("region"))


@query("SELECT c_custkey AS custkey, count(o_orderkey) AS n, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS ids FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def include_collection(w):
    df = w.set("Customer").include("orders").to_df()
    return df.select(F.col("c_custkey").alias("custkey"), F.size("orders").cast("long").alias("n"), F.array_join(F.transform("orders", lambda o: o["o_orderkey"].cast("string")), ",").alias("ids"))


@query("SELECT c_custkey AS custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def include_filtered(w):
    df = w.set("Customer").include("orders", where=lambda o: o.status == "P").to_df()
    return df.select(F.col("c_custkey").alias("custkey"), F.size("orders").cast("long").alias("n"))


@query("SELECT c_custkey AS custkey, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS lines FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey")
def then_include_counts(w):
    df = w.set("Customer").include("orders").then_include("lines").to_df()
    return df.select(F.col("c_custkey").alias("custkey"), F.size("orders").cast("long").alias("orders"), F.aggregate("orders", F.lit(0).cast("long"), lambda a, o: a + F.size(o["lines"])).alias("lines"))


@query("SELECT p_partkey AS partkey, count(s_suppkey) AS n FROM part LEFT JOIN (SELECT * FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) ON l_partkey = p_partkey GROUP BY p_partkey")
def include_many_to_many(w):
    df = w.set("Part").include("suppliers").to_df()
    return df.select(F.col("p_partkey").alias("partkey"), F.size("suppliers").cast("long").alias("n"))


@query("SELECT conv_id AS conversation, turn, 1::BIGINT AS n FROM conversations")
def composite_key_include(w):
    df = w.set("Turn").include("twins").to_df()
    return df.select(F.col("conv_id").alias("conversation"), "turn", F.size("twins").cast("long").alias("n"))


@query("SELECT o_orderkey AS orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_items(w):
    return w.set("Order").where(lambda o: o.status == "P").order_by_desc("total").then_by("id").skip(50).take(25).select(lambda o: {"orderkey": o.id}).to_df()


@query("SELECT count(*) AS value FROM orders WHERE o_orderstatus = 'P'")
def page_total(w):
    return w.set("Order").where(lambda o: o.status == "P").skip(50).take(25).agg_df("count")


@query("SELECT o_orderkey AS orderkey, o_totalprice AS total FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'O'")
def raw_sql_param(w):
    orders = w.tables.read(w.model.entity("Order"))
    return w.set("Order").from_sql("SELECT * FROM {orders} WHERE o_totalprice > :least", {"orders": orders}, least=300000).where(lambda o: o.status == "O").select(lambda o: {"orderkey": o.id, "total": o.total}).to_df()


@query("SELECT event_id AS id FROM events WHERE event_type = 'click' AND value > 50")
def converter_filter(w):
    """A constant goes through the property's converter before it meets the column."""
    m = ModelConfig()
    e = m.entity("Event").table("events").key("id")
    e.property("id").column("event_id")
    e.property("kind").column("event_type").convert("shout")
    e.property("value")
    w = Workspace(w.spark, w.tables, m, converters=[Converter("shout", str.lower, str.upper)])
    return w.set("Event").where(lambda x: (x.kind == "CLICK") & (x.value > 50)).select(lambda x: {"id": x.id}).to_df()


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def merge_update_view(w):
    return w.set("Customer").where(lambda c: c.balance < 0).updated_df({"balance": 0.0})


@query("SELECT * FROM part WHERE NOT (p_size < 10)")
def delete_anti_view(w):
    return w.set("Part").where(lambda p: p.size < 10).remaining_df()
