"""The query catalogue: every registered query with its oracle SQL.

Each query runs over whole tables; limits appear only where they are the
feature (pages, top-k, first rows). Every order has a unique last column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardloom.functions.hashing import key_id, shard_number, string_hash
from shardloom.functions.regions import REGIONS, closest_region
from shardloom.functions.text import natural_key
from shardloom.operators import dml, fanout, ids, migrate, stats
from shardloom.operators.coordinator import Coordinator
from shardloom.operators.mapping import Mapping
from shardloom.operators.strategies import Allocation, Location, round_robin, size_filter
from shardloom.plans.engine import Config, Engine
from shardloom.sources.folders import scratch
from shardloom.sources.cache import Cache, Lookups
from shardloom.sources.kv import MemoryKV

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SHARDS = ["shard-0", "shard-1", "shard-2", "shard-3"]
GEO = {"db-wnam": Location("wnam", 3), "db-enam": Location("enam", 2), "db-weur": Location("weur", 2), "db-apac": Location("apac", 2), "db-oc": Location("oc", 1)}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle where SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def placed(spark: SparkSession, d: str, table: str, key: str) -> DataFrame:
    """A table with ``_shard`` by the hash of a key."""
    return read(spark, d, table).withColumn("_shard", Allocation(SHARDS).column(F.col(key).cast("string")))


# oracle side


def h31(key: str) -> str:
    """The 31-polynomial hash, signed, of a text in the basic plane."""
    r = f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split({key}, ''), lambda x: unicode(x)::BIGINT)), lambda a, b: (a * 31 + b) % 4294967296)"
    return f"(SELECT CASE WHEN r >= 2147483648 THEN r - 4294967296 ELSE r END FROM (SELECT {r} AS r))"


def shard(key: str, n: int = 4) -> str:
    return f"('shard-' || CAST(abs({h31(key)}) % {n} AS VARCHAR))"


def p(table: str, key: str) -> str:
    return f"(SELECT *, {shard(f'CAST({key} AS VARCHAR)')} AS _shard FROM {table})"


ORDERS, CUSTOMERS = p("orders", "o_orderkey"), p("customer", "c_custkey")
SHARD_LIST = "(VALUES ('shard-0'), ('shard-1'), ('shard-2'), ('shard-3')) AS s(shard)"

# routing


@query(f"SELECT _shard AS shard, count(*) AS n FROM (SELECT {shard('c_name')} AS _shard FROM customer) GROUP BY 1")
def hash_route_counts(spark, d):
    c = read(spark, d, "customer")
    return c.select(Allocation(SHARDS).column("c_name").alias("shard")).groupBy("shard").agg(F.count("*").alias("n"))


@query(f"SELECT c_custkey, CAST({h31('c_name')} AS BIGINT) AS h, CAST(abs({h31('c_name')}) % 7 AS INTEGER) AS i FROM customer")
def string_hashes(spark, d):
    return read(spark, d, "customer").select("c_custkey", string_hash("c_name").alias("h"), shard_number("c_name", 7).alias("i"))


@query("SELECT c_custkey, sha256(c_name) AS key_id FROM customer")
def key_sha256(spark, d):
    return read(spark, d, "customer").select("c_custkey", key_id("c_name").alias("key_id"))


@query(f"SELECT c_name AS key, sha256(c_name) AS key_id, {shard('c_name')} AS shard FROM customer")
def shard_assignment(spark, d):
    c = read(spark, d, "customer")
    return c.select(F.col("c_name").alias("key"), key_id("c_name").alias("key_id"), Allocation(SHARDS).column("c_name").alias("shard"))


_SCORES = "SELECT t.code AS target, s.name, sqrt((t.lat - r.lat) * (t.lat - r.lat) + (t.lon - r.lon) * (t.lon - r.lon)) - s.pri * 0.1 AS score FROM regions t, geo s JOIN regions r ON r.code = s.code"
_REGIONS = "regions(code, lat, lon) AS (VALUES " + ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in REGIONS.items()) + ")"
_GEO = "geo(name, code, pri) AS (VALUES " + ", ".join(f"('{k}', '{v.region}', {v.priority}::DOUBLE)" for k, v in GEO.items()) + ")"


@query(f"WITH {_REGIONS}, {_GEO}, sc AS ({_SCORES}) SELECT target, name AS shard FROM sc QUALIFY score - min(score) OVER (PARTITION BY target) < 0.01")
def location_route(spark, d):
    rows = [(t, s) for t in REGIONS for s in Allocation(list(GEO), "location", t, GEO).nearest()]
    return spark.createDataFrame(rows, "target string, shard string")


@query(
    f"WITH {_REGIONS}, {_GEO}, sc AS ({_SCORES}), best AS (SELECT target, name FROM sc QUALIFY score - min(score) OVER (PARTITION BY target) < 0.01),"
    " c AS (SELECT *, (ARRAY['wnam','enam','weur','eeur','apac','oc','me','af'])[1 + c_nationkey % 8] AS target FROM customer)"
    " SELECT c_custkey, target, name AS shard FROM c JOIN best USING (target)"
)
def location_of_rows(spark, d):
    """Row-wise location routing: each row's own region, by a lookup in the eight winners."""
    c = read(spark, d, "customer").withColumn("target", F.get(F.array(*map(F.lit, REGIONS)), (F.col("c_nationkey") % 8).cast("int")))
    out = None
    for t in REGIONS:
        own = Allocation(list(GEO), "location", t, GEO).column("c_name")
        out = F.when(F.col("target") == t, own) if out is None else out.when(F.col("target") == t, own)
    return c.select("c_custkey", "target", out.alias("shard"))


_CASES = "('US','NA','CA',''), ('US','NA','NY',''), ('CA','NA','',''), ('MX','NA','','America/Los_Angeles'), ('DE','EU','',''), ('GB','EU','',''), ('RU','EU','',''), ('JP','AS','',''), ('PK','AS','',''), ('AF','AS','',''), ('AU','OC','',''), ('TR','AS','',''), ('KE','AF','',''), ('EG','AF','',''), ('KZ','AS','',''), ('BR','SA','',''), ('FK','SA','',''), ('JM','NA','',''), ('XX','XX','',''), ('','','','')"


@query(
    f"SELECT country, CASE WHEN country = '' THEN 'wnam' WHEN country IN ('US','CA','MX') THEN CASE WHEN state IN ('CA') OR zone <> '' THEN 'wnam' ELSE 'enam' END"
    " WHEN country IN ('GB') THEN 'weur' WHEN country IN ('DE','RU','KZ') THEN 'eeur' WHEN country IN ('JP','PK','AF') THEN 'apac' WHEN country = 'AU' THEN 'oc'"
    f" WHEN country = 'TR' THEN 'me' WHEN continent = 'AF' THEN 'af' WHEN continent = 'SA' OR country = 'JM' THEN 'enam' ELSE 'wnam' END AS region, state FROM (VALUES {_CASES}) t(country, continent, state, zone)"
)
def geo_region(spark, d):
    t = spark.sql(f"SELECT * FROM VALUES {_CASES} AS t(country, continent, state, zone)")
    return t.select("country", closest_region(F.col("country"), F.col("continent"), F.col("state"), F.col("zone")).alias("region"), "state")


@query("SELECT o_orderkey, 'shard-' || CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 4 AS VARCHAR) AS shard FROM orders")
def round_robin_insert(spark, d):
    return round_robin(read(spark, d, "orders"), SHARDS, "o_orderkey").select("o_orderkey", F.col("_shard").alias("shard"))


@query(None)
def random_strategy(spark, d):
    c = read(spark, d, "customer").withColumn("_shard", Allocation(SHARDS, "random").column("c_name"))
    return c.groupBy(F.col("_shard").alias("shard")).agg(F.count("*").alias("n"))


@query(f"WITH {_REGIONS}, {_GEO}, sc AS ({_SCORES}) SELECT o_orderkey, {shard('CAST(o_orderkey AS VARCHAR)', 5)} AS read_shard, 'shard-' || (SELECT CAST(list_position(['db-wnam','db-enam','db-weur','db-apac','db-oc'], arg_min(name, score)) - 1 AS VARCHAR) FROM sc WHERE target = 'eeur') AS write_shard FROM orders")
def mixed_strategy(spark, d):
    names = [f"shard-{i}" for i in range(5)]
    places = dict(zip(names, GEO.values(), strict=True))
    a = Allocation(names, {"read": "hash", "write": "location"}, "eeur", places)
    key = F.col("o_orderkey").cast("string")
    return read(spark, d, "orders").select("o_orderkey", a.column(key, "read").alias("read_shard"), a.column(key, "write").alias("write_shard"))


@query(f"WITH c AS (SELECT _shard AS shard, count(*) AS n FROM {ORDERS} GROUP BY 1), k AS (SELECT shard FROM c WHERE n < (SELECT avg(n) FROM c)) SELECT shard FROM c WHERE shard IN (SELECT shard FROM k) OR NOT EXISTS (SELECT 1 FROM k)")
def size_filtered_shards(spark, d):
    c = {r.shard: float(r["count"]) for r in fanout.counts(placed(spark, d, "orders", "o_orderkey"), SHARDS).collect()}
    keep = size_filter(SHARDS, c, sum(c.values()) / len(c))
    return spark.createDataFrame([(s,) for s in keep], "shard string")


@query(
    f"WITH {_REGIONS}, {_GEO}, sc AS ({_SCORES}), best AS (SELECT target, name FROM sc QUALIFY score - min(score) OVER (PARTITION BY target) < 0.01)"
    " SELECT s.strategy, t.target, CASE WHEN s.strategy = 'location' THEN name ELSE (ARRAY['db-wnam','db-enam','db-weur','db-apac','db-oc'])[CAST(1 + abs(" + h31("'user-123'") + ") % 5 AS INTEGER)] END AS shard"
    " FROM (VALUES ('hash'), ('location')) s(strategy), (SELECT DISTINCT code AS target FROM regions) t JOIN best USING (target)"
)
def location_strategy_matrix(spark, d):
    rows = [(s, t) for s in ("hash", "location") for t in REGIONS]
    df = spark.createDataFrame(rows, "strategy string, target string")
    out = F.lit(None).cast("string")
    for s, t in rows:
        out = F.when((F.col("strategy") == s) & (F.col("target") == t), Allocation(list(GEO), s, t, GEO).column(F.lit("user-123"))).otherwise(out)
    return df.withColumn("shard", out)


# fan-out


@query(f"SELECT _shard, o_orderkey, o_totalprice FROM {ORDERS} QUALIFY row_number() OVER (PARTITION BY _shard ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def per_shard_topk(spark, d):
    o = placed(spark, d, "orders", "o_orderkey")
    return fanout.per_shard_top(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("_shard", "o_orderkey", "o_totalprice")


@query(f"SELECT _shard, o_orderkey, o_totalprice FROM {ORDERS} WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY _shard ORDER BY o_totalprice, o_orderkey) <= 4")
def all_shards_sql(spark, d):
    """The same statement with LIMIT on every shard, in one plan."""
    t = {"orders": placed(spark, d, "orders", "o_orderkey")}
    return fanout.all_shards_sql(spark, t, SHARDS, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = ? ORDER BY o_totalprice, o_orderkey LIMIT ?", ["F", 4]).select("_shard", "o_orderkey", "o_totalprice")


@query("SELECT shard AS _shard, min(o_orderkey) AS o_orderkey FROM " + SHARD_LIST + f" LEFT JOIN {ORDERS} o ON o._shard = shard GROUP BY 1")
def first_per_shard(spark, d):
    o = placed(spark, d, "orders", "o_orderkey")
    first = fanout.per_shard_top(o, [F.col("o_orderkey")], 1).select("_shard", "o_orderkey")
    return spark.createDataFrame([(s,) for s in SHARDS], "_shard string").join(first, "_shard", "left")


@query(f"SELECT o_orderkey, o_totalprice, _shard FROM {ORDERS} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20")
def global_page(spark, d):
    o = placed(spark, d, "orders", "o_orderkey")
    return fanout.global_rows(o, by=[*fanout.order("o_totalprice", "desc"), F.col("o_orderkey")], offset=20, limit=20).select("o_orderkey", "o_totalprice", "_shard")


@query(f"SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderpriority LIKE '1%') AS total FROM {ORDERS} WHERE o_orderpriority LIKE '1%' ORDER BY o_totalprice, o_orderkey LIMIT 15 OFFSET 5")
def global_filter_sort_total(spark, d):
    o = placed(spark, d, "orders", "o_orderkey")
    where = F.col("o_orderpriority").startswith("1")
    rows = fanout.global_rows(o, where, [*fanout.order("o_totalprice"), F.col("o_orderkey")], 5, 15)
    return rows.join(F.broadcast(fanout.total(o, where))).select("o_orderkey", "o_totalprice", "total")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1 OFFSET 3")
def first_global(spark, d):
    o = placed(spark, d, "orders", "o_orderkey")
    return fanout.global_rows(o, by=[F.col("o_totalprice"), F.col("o_orderkey")], offset=3, limit=1).select("o_orderkey")


@query("SELECT c_custkey, (SELECT count(*) FROM customer) AS total, 2 AS page, 25 AS \"limit\", CAST(ceil((SELECT count(*) FROM customer) / 25.0) AS BIGINT) AS pages FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 25")
def paginate_pages(spark, d):
    c = placed(spark, d, "customer", "c_custkey")
    return fanout.paginate(c, by=[F.col("c_custkey")], page=2, limit=25).select("c_custkey", "total", "page", "limit", "pages")


@query("SELECT c_name, regexp_replace(regexp_replace(c_name, '([0-9]+)', '00000000000000000000\\1', 'g'), '0*([0-9]{20})$', '\\1', 'g') AS k FROM customer")
def natural_sort_key(spark, d):
    return read(spark, d, "customer").select("c_name", natural_key(F.col("c_name")).alias("k"))


@query(f"SELECT shard, count(o_orderkey) AS n, (SELECT count(*) FROM orders) AS total FROM {SHARD_LIST} LEFT JOIN {ORDERS} o ON o._shard = shard GROUP BY 1")
def count_all_shards(spark, d):
    o = placed(spark, d, "orders", "o_orderkey")
    c = fanout.counts(o, SHARDS)
    return c.join(F.broadcast(c.agg(F.sum("count").alias("total")))).select("shard", F.col("count").alias("n"), "total")


@query("SELECT greatest(coalesce(max(o_orderkey), 0), 0) AS max_id, greatest(coalesce(max(o_orderkey), 0), 0) + 1 AS next_id FROM orders")
def max_and_next_id(spark, d):
    m = ids.max_across(placed(spark, d, "orders", "o_orderkey"), "o_orderkey")
    return m.select("max_id", (F.col("max_id") + 1).alias("next_id"))


@query("SELECT p_partkey, 1000 + row_number() OVER (ORDER BY p_partkey) - 1 AS id FROM part")
def bulk_ids(spark, d):
    return ids.assign_ids(read(spark, d, "part").select("p_partkey"), "p_partkey", 1000)


@query(f"WITH c AS (SELECT shard, count(o_orderkey) AS n FROM {SHARD_LIST} LEFT JOIN {ORDERS} o ON o._shard = shard GROUP BY 1) SELECT shard, n, round(100.0 * n / (SELECT sum(n) FROM c), 4)::DOUBLE AS load, round((SELECT max(n)::DOUBLE / nullif(min(n), 0) FROM c), 4) AS ratio FROM c")
def shard_balance(spark, d):
    return stats.balance(placed(spark, d, "orders", "o_orderkey"), SHARDS).withColumnRenamed("count", "n")


# mapping


def _mapping(spark: SparkSession, d: str) -> tuple[DataFrame, Mapping]:
    c = placed(spark, d, "customer", "c_custkey")
    return c, Mapping.build(c, "c_custkey", aliases=["c_name"])


@query(f"SELECT _shard AS shard, count(*) * 4 AS keys_stored, count(*) * 2 AS keys_distinct FROM {CUSTOMERS} GROUP BY 1")
def mapping_counts(spark, d):
    _, m = _mapping(spark, d)
    stored = m.counts().withColumnRenamed("count", "keys_stored")
    return stored.join(m.counts(True).withColumnRenamed("count", "keys_distinct"), "shard")


@query(f"SELECT key FROM (SELECT sha256(CAST(c_custkey AS VARCHAR)) AS key, _shard FROM {CUSTOMERS} UNION ALL SELECT sha256('c_name:' || c_name), _shard FROM {CUSTOMERS}) WHERE _shard = 'shard-2'")
def keys_for_shard(spark, d):
    return _mapping(spark, d)[1].keys_for_shard("shard-2")


@query(f"SELECT s.shard, count(k) AS n FROM {SHARD_LIST} LEFT JOIN (SELECT _shard, c_custkey AS k FROM {CUSTOMERS} UNION ALL SELECT _shard, c_custkey FROM {CUSTOMERS}) c ON c._shard = s.shard GROUP BY 1")
def shard_stats(spark, d):
    m = _mapping(spark, d)[1].counts(True)
    return spark.createDataFrame([(s,) for s in SHARDS], "shard string").join(m, "shard", "left").select("shard", F.coalesce("count", F.lit(0)).alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000007'")
def lookup_key_first(spark, d):
    """A record found by its alias: the alias is mapped, so only its shard is read."""
    c, m = _mapping(spark, d)
    shard_ = m.get("c_name:Customer#000000007")
    return fanout.lookup(c, shard_, F.col("c_name") == "Customer#000000007", SHARDS).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7")
def lookup_key_all(spark, d):
    """A key that is not mapped falls back to all shards."""
    o = placed(spark, d, "orders", "o_orderkey")
    return fanout.lookup(o, None, F.col("o_custkey") == 7, SHARDS).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey = 11")
def resilient_read(spark, d):
    """A stale mapping (to a shard that lacks the record) falls back to a global scan."""
    c, m = _mapping(spark, d)
    right = m.get("11")
    stale = m.update("11", next(s for s in SHARDS if s != right))
    return fanout.lookup(c, stale.get("11"), F.col("c_custkey") == 11, SHARDS).select("c_custkey", "c_acctbal")


@query(f"SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'shard-0' ELSE {shard('CAST(c_custkey AS VARCHAR)')} END AS shard, c_mktsegment <> 'BUILDING' AS is_new FROM customer")
def route_batch(spark, d):
    """Bulk routing: mapped keys keep their shard, the others are allocated."""
    c = read(spark, d, "customer")
    known = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("key"), F.lit("shard-0").alias("shard"))
    m = Mapping.empty(spark).set_batch(known)
    return m.route(c, "c_custkey", Allocation(SHARDS)).select("c_custkey", F.col("_shard").alias("shard"), F.col("_new").alias("is_new"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_mktsegment <> 'MACHINERY'")
def migrate_unmapped(spark, d):
    c = read(spark, d, "customer")
    m = Mapping.build(c.where("c_mktsegment = 'MACHINERY'").withColumn("_shard", F.lit("shard-1")), "c_custkey")
    return m.unmapped(c, "c_custkey").select(F.col("c_custkey").cast("string").alias("key"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS key FROM part")
def discover_keys(spark, d):
    return migrate.discover_keys(read(spark, d, "part"), "p_partkey")


@query("SELECT 'part' AS name, count(*) AS records, 0::BIGINT AS nulls, CAST(count(*) - count(DISTINCT p_partkey) AS BIGINT) AS repeats FROM part UNION ALL SELECT 'names', (SELECT count(*) FROM part), 0, (SELECT count(*) FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1))")
def validate_tables(spark, d):
    t = read(spark, d, "part")
    a = migrate.validate_frame(t, "p_partkey").select(F.lit("part").alias("name"), "records", "nulls", "repeats")
    return a.union(migrate.validate_frame(t, "p_name").select(F.lit("names"), "records", "nulls", "repeats"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'shard-3' ELSE _shard END AS shard FROM {ORDERS}")
def reassign(spark, d):
    o = placed(spark, d, "orders", "o_orderkey")
    moves = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("key"), F.lit("shard-3").alias("shard"))
    return dml.reassign(o, "o_orderkey", moves).select("o_orderkey", F.col("_shard").alias("shard"))


@query(f"SELECT conv_id, turn, {shard('CAST(conv_id AS VARCHAR)')} AS shard FROM conversations")
def conversation_routing(spark, d):
    return placed(spark, d, "conversations", "conv_id").select("conv_id", "turn", F.col("_shard").alias("shard"))


# selects


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE (p_size > 30 OR p_retailprice < 950) AND NOT (p_brand = 'Brand#11') AND p_size BETWEEN 5 AND 45 AND p_size IN (7, 12, 33, 40, 44)")
def where_compound(spark, d):
    return placed(spark, d, "part", "p_partkey").where("(p_size > 30 OR p_retailprice < 950) AND NOT (p_brand = 'Brand#11') AND p_size BETWEEN 5 AND 45 AND p_size IN (7, 12, 33, 40, 44)").select("p_partkey", "p_brand", "p_size")


@query("SELECT event_id FROM events WHERE nullif(event_type, 'click') IS NULL OR nullif(event_type, 'click') <> 'view'")
def where_null(spark, d):
    return read(spark, d, "events").withColumn("t", F.expr("nullif(event_type, 'click')")).where("t IS NULL OR t <> 'view'").select("event_id")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%E_%' AND p_type NOT ILIKE '%steel%'")
def where_like(spark, d):
    return read(spark, d, "part").where("p_name ILIKE '%E_%' AND p_type NOT ILIKE '%steel%'").select("p_partkey", "p_name")


@query("SELECT s_suppkey, coalesce(nullif(s_name, 'x'), '-') AS a, lower(s_name) AS b, upper(s_name) AS c, CAST(length(s_name) AS INTEGER) AS d, abs(s_acctbal) AS e, s_acctbal / nullif(s_nationkey, 0) AS f, s_suppkey * 2 - 1 AS g FROM supplier")
def scalars(spark, d):
    return read(spark, d, "supplier").selectExpr("s_suppkey", "ifnull(nullif(s_name, 'x'), '-') AS a", "lower(s_name) AS b", "upper(s_name) AS c", "length(s_name) AS d", "abs(s_acctbal) AS e", "try_divide(s_acctbal, s_nationkey) AS f", "s_suppkey * 2 - 1 AS g")


@query("SELECT count(*) AS n, count(DISTINCT l_suppkey) AS supps, min(l_quantity) AS lo, max(l_quantity) AS hi, round(sum(l_extendedprice), 2) AS total, round(avg(l_discount), 6) AS mean FROM lineitem")
def agg_global(spark, d):
    return read(spark, d, "lineitem").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("supps"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.round(F.avg("l_discount"), 6).alias("mean"))


@query("SELECT coalesce(max(o_orderkey), 0) + 1 AS nxt, count(*) AS n FROM orders WHERE o_orderstatus = 'P'")
def agg_filtered(spark, d):
    return read(spark, d, "orders").where("o_orderstatus = 'P'").selectExpr("coalesce(max(o_orderkey), 0) + 1 AS nxt", "count(*) AS n")


@query("SELECT coalesce(max(o_orderkey), 0) + 1 AS nxt, count(*) AS n FROM orders WHERE o_orderkey < 0")
def agg_empty(spark, d):
    return read(spark, d, "orders").where("o_orderkey < 0").selectExpr("coalesce(max(o_orderkey), 0) + 1 AS nxt", "count(*) AS n")


@query("SELECT event_id, t FROM (SELECT event_id, nullif(event_type, 'click') AS t FROM events) ORDER BY t ASC NULLS LAST, event_id LIMIT 50 OFFSET 10")
def order_nulls_asc(spark, d):
    e = read(spark, d, "events").selectExpr("event_id", "nullif(event_type, 'click') AS t")
    return fanout.global_rows(e, by=[*fanout.order("t"), F.col("event_id")], offset=10, limit=50)


@query("SELECT event_id, t FROM (SELECT event_id, nullif(event_type, 'click') AS t FROM events) ORDER BY t DESC NULLS FIRST, event_id LIMIT 50")
def order_nulls_desc(spark, d):
    e = read(spark, d, "events").selectExpr("event_id", "nullif(event_type, 'click') AS t")
    return fanout.global_rows(e, by=[*fanout.order("t", "desc"), F.col("event_id")], limit=50)


# pass-through SQL


@query("SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")
def join_left(spark, d):
    """Orders are summed before the join, so that it moves a row per customer."""
    o = read(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    c = read(spark, d, "customer").select("c_custkey")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))


@query(f"SELECT o_orderkey, c_name, o._shard AS shard FROM {ORDERS} o JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000")
def join_inner(spark, d):
    o, c = placed(spark, d, "orders", "o_orderkey").where("o_totalprice > 400000"), read(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", F.col("_shard").alias("shard"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def join_semi(spark, d):
    o = read(spark, d, "orders").where("o_totalprice > 450000")
    return read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def join_anti(spark, d):
    o = read(spark, d, "orders").where("o_totalprice > 450000")
    return read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1, 2 HAVING count(*) > 100")
def group_by_having(spark, d):
    return read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")).where("n > 100")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, d):
    return read(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, r FROM (SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS r FROM orders) WHERE r <= 2")
def window_rank(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return read(spark, d, "orders").withColumn("r", F.row_number().over(w)).where("r <= 2").select("o_orderkey", "r")


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def union_all(spark, d):
    return read(spark, d, "nation").select(F.col("n_name").alias("name")).union(read(spark, d, "region").select("r_name"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, d):
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(read(spark, d, "supplier").select("s_nationkey"))


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 450000")
def except_(spark, d):
    o = read(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("k")).subtract(o.where("o_totalprice > 450000").select("o_custkey"))


@query("SELECT DISTINCT p_brand, p_size FROM part")
def distinct(spark, d):
    return read(spark, d, "part").select("p_brand", "p_size").distinct()


# changes: the table's state, or the affected rows


def _old(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


def _new(spark: SparkSession, d: str) -> DataFrame:
    """As many rows again, whose keys are shifted so that some meet old ones."""
    return read(spark, d, "orders").selectExpr("o_orderkey + 5000 AS o_orderkey", "o_custkey", "o_totalprice + 1 AS o_totalprice", "'N' AS o_orderstatus")


_OLD = "o AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders)"
_NEW = "n AS (SELECT o_orderkey + 5000 AS o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice, 'N' AS o_orderstatus FROM orders)"


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders UNION ALL SELECT -o_orderkey - 5001, o_custkey, NULL, 'N' FROM orders")
def insert_rows(spark, d):
    new = _new(spark, d).selectExpr("-o_orderkey - 1 AS o_orderkey", "o_custkey", "o_orderstatus")
    return dml.insert(_old(spark, d), new, ["o_orderkey"]).table


@query(f"WITH {_OLD}, {_NEW} SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT * FROM n")
def insert_or_replace(spark, d):
    return dml.insert(_old(spark, d), _new(spark, d), ["o_orderkey"], "replace").table


@query(f"WITH {_OLD}, {_NEW} SELECT * FROM o UNION ALL SELECT * FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)")
def insert_or_ignore(spark, d):
    return dml.insert(_old(spark, d), _new(spark, d), ["o_orderkey"], "ignore").table


@query(f"WITH {_OLD}, {_NEW} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(o.o_custkey, n.o_custkey) AS o_custkey, CASE WHEN o.o_orderkey IS NULL OR n.o_orderkey IS NULL THEN coalesce(o.o_totalprice, n.o_totalprice) ELSE o.o_totalprice + n.o_totalprice END AS o_totalprice, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus FROM o FULL JOIN n USING (o_orderkey)")
def upsert_update(spark, d):
    return dml.upsert(_old(spark, d), _new(spark, d), ["o_orderkey"], {"o_totalprice": "o_totalprice + excluded.o_totalprice", "o_orderstatus": "excluded.o_orderstatus"}).table


_K1, _K2 = "nullif(o_orderstatus, 'F') IS NULL", "nullif(o_orderpriority, '1-URGENT') IS NULL"


@query(
    f"WITH a AS (SELECT CASE WHEN {_K1} THEN NULL ELSE o_orderkey END AS k, max(o_totalprice) AS v FROM orders GROUP BY 1), b AS (SELECT CASE WHEN {_K2} THEN NULL ELSE o_orderkey END AS k, max(o_totalprice) + 1 AS v FROM orders GROUP BY 1)"
    " SELECT CASE WHEN b.i IS NULL THEN a.k ELSE b.k END AS k, coalesce(b.v, a.v) AS v FROM (SELECT *, 1 AS i FROM a) a FULL JOIN (SELECT *, 1 AS i FROM b) b ON a.k IS NOT DISTINCT FROM b.k"
)
def upsert_null_keys(spark, d):
    o = read(spark, d, "orders")
    old = o.selectExpr(f"CASE WHEN {_K1} THEN NULL ELSE o_orderkey END AS k", "o_totalprice AS v").groupBy("k").agg(F.max("v").alias("v"))
    new = o.selectExpr(f"CASE WHEN {_K2} THEN NULL ELSE o_orderkey END AS k", "o_totalprice + 1 AS v")
    return dml.upsert(old, new, ["k"]).table


@query(f"WITH {_OLD}, {_NEW} SELECT * FROM o UNION ALL SELECT * FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)")
def upsert_nothing(spark, d):
    return dml.upsert(_old(spark, d), _new(spark, d), ["o_orderkey"], []).table


@query(f"WITH {_OLD} SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 + o_custkey ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM o")
def update_expr(spark, d):
    return dml.update(_old(spark, d), {"o_custkey": "o_custkey + 1", "o_totalprice": "o_totalprice * 2 + o_custkey"}, "o_orderstatus = 'F'").table


@query(f"WITH {_OLD} SELECT * FROM o WHERE NOT coalesce(nullif(o_orderstatus, 'P') = 'F', false)")
def delete_where(spark, d):
    return dml.delete(_old(spark, d), "nullif(o_orderstatus, 'P') = 'F'").table


@query(f"WITH {_OLD} SELECT o_orderkey, o_totalprice * 1.5 AS price FROM o WHERE o_orderstatus = 'O'")
def update_returning(spark, d):
    return dml.update(_old(spark, d), {"o_totalprice": "o_totalprice * 1.5D"}, "o_orderstatus = 'O'").returning(["o_orderkey", "o_totalprice AS price"])


@query(f"WITH {_OLD} SELECT o_orderkey FROM o WHERE o_totalprice > 200000")
def delete_returning(spark, d):
    return dml.delete(_old(spark, d), "o_totalprice > 200000").returning(["o_orderkey"])


# stored tables, catalog and introspection


def _stored(spark: SparkSession, d: str, table: str, key: str) -> Engine:
    e = Engine(spark, Config(SHARDS, scratch(spark)))
    e.store.create(table, read(spark, d, table).schema, key)
    e.store.append(table, placed(spark, d, table, key))
    return e


@query(f"SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal, c_mktsegment, _shard FROM {CUSTOMERS} WHERE c_mktsegment <> 'BUILDING'")
def stored_changes(spark, d):
    """Statements on every shard of a stored table, each a new version of the shards it touched."""
    e = _stored(spark, d, "customer", "c_custkey")
    for sql, args in (("UPDATE customer SET c_acctbal = 0 WHERE c_acctbal < ?", [0]), ("DELETE FROM customer WHERE c_mktsegment = ?", ["BUILDING"])):
        done = e.run_all_shards(sql, args)
        if not done.success:
            raise RuntimeError(done.error)
    return e.table("customer")


@query(f"SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'moved' ELSE 'stayed' END AS state FROM customer WHERE _shard_of = 'shard-1' OR c_custkey = 7".replace("FROM customer", f"FROM (SELECT *, {shard('CAST(c_custkey AS VARCHAR)')} AS _shard_of FROM customer)"))
def stored_reassign(spark, d):
    """One record moved to shard-1 in the files and in the mapping."""
    e = _stored(spark, d, "customer", "c_custkey")
    e.mapping = Mapping.build(e.table("customer"), "c_custkey")
    e.reassign("7", "shard-1", "customer", "c_custkey")
    return fanout.shard_frame(e.table("customer"), "shard-1").select("c_custkey", F.when(F.col("c_custkey") == 7, "moved").otherwise("stayed").alias("state"))


@query("SELECT * FROM (VALUES (0, 'r_regionkey', 'int', 0, 1), (1, 'r_name', 'string', 0, 0)) t(cid, name, type, \"notnull\", pk)")
def table_info(spark, d):
    return _stored(spark, d, "region", "r_regionkey").store.info("region")


@query("SELECT 'nation' AS name")
def catalog_tables(spark, d):
    e = _stored(spark, d, "nation", "n_nationkey")
    return spark.createDataFrame([(t,) for t in e.list_tables()], "name string")


@query()
def shard_sizes(spark, d):
    """Bytes of each shard's files."""
    return stats.sizes(_stored(spark, d, "orders", "o_orderkey").table("orders"))


@query()
def explain_plan(spark, d):
    """The formatted plan of a query on one shard."""
    e = _stored(spark, d, "nation", "n_nationkey")
    return spark.createDataFrame([(s, p) for s, p in e.explain_all("SELECT count(*) FROM nation").items()], "shard string, plan string")


@query("SELECT count(*) AS n, count(*) AS again FROM orders")
def cached_read(spark, d):
    """A count read through the cache; the second read doesn't run a job."""
    cache = Cache(MemoryKV())
    n = [cache.cached("orders", lambda: read(spark, d, "orders").count(), 60) for _ in range(2)]
    return spark.createDataFrame([tuple(n)], "n long, again long")


@query("SELECT 'n_name' AS namespace, n_name AS key, CAST(n_nationkey AS VARCHAR) AS value FROM nation")
def lookup_namespace(spark, d):
    """A secondary lookup table beside the mapping."""
    look = Lookups(MemoryKV())
    rows = read(spark, d, "nation").collect()  # 25 rows by definition
    for r in rows:
        look.set("n_name", r.n_name, str(r.n_nationkey))
    return spark.createDataFrame([("n_name", r.n_name, look.get("n_name", r.n_name)) for r in rows], "namespace string, key string, value string")


@query("SELECT row_number() OVER (ORDER BY k) - 1 AS k, 'shard-' || CAST((row_number() OVER (ORDER BY k) - 1) % 4 AS VARCHAR) AS shard, 100 + row_number() OVER (ORDER BY k) - 1 AS id FROM generate_series(0, 11) t(k)")
def coordinator_allocation(spark, d):
    """Round-robin allocation and a sequence by the central coordinator."""
    c = Coordinator(strategy="round-robin")
    for s in SHARDS:
        c.add_shard(s)
    return spark.createDataFrame([(k, c.allocate(f"k{k}"), c.sequence("orders", 100)) for k in range(12)], "k long, shard string, id long")
