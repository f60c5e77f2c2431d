"""Queries that go through an engine, a mapping or a coordinator, with their oracle SQL.

Tables of 25 rows or fewer are changed row by row; larger ones in bulk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.errors import EngineError
from shardloom.functions import idents
from shardloom.operators import fanout, migrate
from shardloom.operators.coordinator import Coordinator
from shardloom.operators.mapping import Mapping
from shardloom.operators.strategies import Allocation, round_robin
from shardloom.plans import active, builders, sqlfront
from shardloom.plans.catalogue import CUSTOMERS, GEO, ORDERS, SHARD_LIST, SHARDS, _stored, placed, query, read, shard
from shardloom.plans.engine import Config, Engine
from shardloom.sources import connectors, folders
from shardloom.sources.cache import Cache, Lookups
from shardloom.sources.databases import ClientDatabase, is_sql_database
from shardloom.sources.kv import ClientKV, MemoryKV, all_keys, is_kv_store

NATION_SHARD = shard("CAST(n_nationkey AS VARCHAR)")
NATIONS = f"(SELECT *, {NATION_SHARD} AS _shard FROM nation)"


def nations(spark, d) -> list:
    return read(spark, d, "nation").collect()  # 25 rows by definition


def keyed(spark, d) -> Engine:
    """The nations in an engine, with their keys mapped."""
    e = _stored(spark, d, "nation", "n_nationkey")
    e.mapping = Mapping.build(e.table("nation"), "n_nationkey")
    return e


def frame(spark, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# sources


@query("SELECT n_nationkey, n_name, f.kind FROM nation, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) f(kind)")
def file_formats(spark, d):
    """A table written and read back in every file format, by its path alone."""
    n, out = read(spark, d, "nation"), None
    for kind in ("csv", "json", "orc", "parquet"):
        path = f"{folders.scratch(spark)}.{kind}"
        n.select(F.col("n_nationkey").cast("string").alias("k"), F.col("n_name").alias("v")).write.format(kind).save(path)
        back = connectors.as_shard(spark, path).toDF("k", "v")
        back = back.select(F.col("k").cast("int").alias("n_nationkey"), F.col("v").alias("n_name"), F.lit(kind).alias("kind"))
        out = back if out is None else out.unionByName(back)
    return out


@query("SELECT c_custkey % 3 AS part, CASE c_custkey % 3 WHEN 0 THEN 'db-primary' WHEN 1 THEN 'db-east' ELSE 'db-west' END AS shard, count(*) AS n FROM customer GROUP BY ALL")
def engine_from_env(spark, d):
    """An engine made of whatever an environment binds; keys are mapped to where they are."""
    c = read(spark, d, "customer")
    env = {"DB": c.where("c_custkey % 3 = 0"), "DB_EAST": c.where("c_custkey % 3 = 1"), "db-west": c.where("c_custkey % 3 = 2"), "KV": MemoryKV(), "OTHER": 1}
    e = Engine.from_env(spark, env, table="customer", key="c_custkey")
    return e.table("customer").groupBy((F.col("c_custkey") % 3).alias("part"), F.col("_shard").alias("shard")).agg(F.count("*").alias("n"))


@query(f"SELECT _shard AS shard, count(*) AS n FROM {ORDERS} GROUP BY 1")
def in_memory_engine(spark, d):
    """A bulk load into an engine that names no folder."""
    e = Engine.in_memory(spark, SHARDS)
    e.load("orders", read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return e.table("orders").groupBy(F.col("_shard").alias("shard")).agg(F.count("*").alias("n"))


@query("SELECT 'n:' || n_name AS key, CAST(n_regionkey AS VARCHAR) AS value, s.store FROM nation, (VALUES ('memory'), ('client')) s(store) WHERE n_nationkey % 5 <> 0")
def kv_stores(spark, d):
    """Put, delete, list and get in the engine's own store and in a wrapped client."""

    class Client:
        def __init__(self):
            self.held = {}

        def get(self, k):
            return self.held.get(k)

        def set(self, k, v):
            self.held[k] = v

        def delete(self, k):
            self.held.pop(k, None)

        def keys(self, pattern="*"):
            return list(self.held)

    out = []
    for name, kv in (("memory", MemoryKV()), ("client", ClientKV(Client()))):
        kv.put("other", "x")
        for r in nations(spark, d):
            kv.put(f"n:{r.n_name}", str(r.n_regionkey))
            if r.n_nationkey % 5 == 0:
                kv.delete(f"n:{r.n_name}")
        out += [(k, kv.get(k), name) for k in all_keys(kv, "n:")]
    return frame(spark, out, "key string, value string, store string")


@query("SELECT * FROM (VALUES ('frame', 'frame', false), ('store', 'none', true), ('number', 'none', false), ('path', 'frame', false)) t(source, kind, is_kv)")
def source_kinds(spark, d):
    """What counts as a shard's source and what as a key-value store."""
    given = {"frame": read(spark, d, "region"), "store": MemoryKV(), "number": 7, "path": f"{d}/region.parquet"}
    return frame(spark, [(k, "none" if connectors.as_shard(spark, v) is None else "frame", bool(is_kv_store(v))) for k, v in given.items()], "source string, kind string, is_kv boolean")


@query("SELECT n_nationkey AS k, n_name || CASE WHEN n_nationkey = 3 THEN '!' ELSE '' END AS v, c.client FROM nation, (VALUES ('connection'), ('query')) c(client) WHERE n_nationkey <> 4")
def database_clients(spark, d):
    """A connection and a client with numbered placeholders, under one shape."""
    import sqlite3

    class Client:
        """Answers as (rows, fields), and changes by a summary."""

        def __init__(self):
            self.held = sqlite3.connect(":memory:")

        def query(self, sql, args):
            for i in range(len(args), 0, -1):
                sql = sql.replace(f"${i}", f"?{i}")
            cursor = self.held.execute(sql, args)
            names = [c[0] for c in cursor.description or ()]
            return ([dict(zip(names, r)) for r in cursor], names) if names else {"affectedRows": cursor.rowcount, "insertId": cursor.lastrowid}  # noqa: B905

    out = []
    for name, db in (("connection", ClientDatabase(sqlite3.connect(":memory:"))), ("query", ClientDatabase(Client(), "numeric"))):
        db.run("CREATE TABLE n (k INTEGER PRIMARY KEY, v TEXT)")
        for r in nations(spark, d):
            if db.run("INSERT INTO n VALUES (?, ?)", [r.n_nationkey, r.n_name]).changes != 1:
                raise RuntimeError(name)
        if db.run("UPDATE n SET v = v || '!' WHERE k = ?", [3]).changes != 1 or db.first("SELECT v FROM n WHERE k = ? AND v <> '?'", [99]) is not None or not is_sql_database(db):
            raise RuntimeError(name)
        db.run("DELETE FROM n WHERE k = ?", [4])
        out += [(r["k"], r["v"], name) for r in db.all("SELECT * FROM n")]
    return frame(spark, out, "k int, v string, client string")


@query("SELECT 4::BIGINT AS given, n_name AS name FROM nation WHERE n_nationkey = 0")
def statement_inputs(spark, d):
    """A statement as text, with its values, as a dict, and as an object that makes one."""

    class Built:
        def to_query(self):
            return {"text": "SELECT n_name FROM nation WHERE n_nationkey = ?", "values": [0]}

    e, sql = keyed(spark, d), "SELECT n_name FROM nation WHERE n_nationkey = ?"
    got = [e.first("0", sql, [0]), e.first("0", (sql, [0])), e.first("0", {"sql": sql, "params": [0]}), e.first("0", Built())]
    return frame(spark, [(len(got), n) for n in {r.n_name for r in got}], "given long, name string")


# routing

_STATEMENTS = {
    "SELECT 1": "read", "select * from t": "read", "  WITH a AS (SELECT 1) SELECT * FROM a": "read", "PRAGMA table_info(t)": "read", "EXPLAIN SELECT 1": "read",
    "INSERT INTO t VALUES (1)": "write", "update t set a = 1": "write", "DELETE FROM t": "write", "CREATE TABLE t (a INTEGER)": "write", "-- note": "write",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _STATEMENTS.items()) + ") t(statement, operation)")
def statement_operations(spark, d):
    return frame(spark, [(s, idents.operation(s)) for s in _STATEMENTS], "statement string, operation string")


_GEO_NAMES = ", ".join(f"'{s}'" for s in GEO)


@query(f"SELECT c_custkey, ([{_GEO_NAMES}])[1 + CAST(replace({shard('c_name', 5)}, 'shard-', '') AS INTEGER)] AS shard FROM customer")
def location_without_target(spark, d):
    """Without a target region, location falls back to the hash over all shards."""
    return read(spark, d, "customer").select("c_custkey", Allocation(list(GEO), "location", None, GEO).column("c_name").alias("shard"))


@query("SELECT count(*) AS n, 4::BIGINT AS shards, true AS even FROM orders")
def random_strategy_balance(spark, d):
    """Random placement: every row has a shard, all shards are used, each within six standard errors of a quarter."""
    rows = read(spark, d, "orders").select(Allocation(SHARDS, "random").column(F.col("o_orderkey").cast("string")).alias("shard"))
    by = rows.groupBy("shard").agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("n"), F.count("*").alias("shards"), F.max("n").alias("hi"), F.min("n").alias("lo"))
    off = 6 * F.sqrt(F.col("n") * 0.25 * 0.75)
    return total.select("n", "shards", ((F.col("hi") <= F.col("n") / 4 + off) & (F.col("lo") >= F.col("n") / 4 - off)).alias("even"))


@query("SELECT r_regionkey + 1 AS id, 'shard-' || CAST(r_regionkey % 4 AS VARCHAR) AS shard, r_name AS name, 'shard-' || CAST(r_regionkey % 4 AS VARCHAR) AS mapped FROM region")
def insert_generated_ids(spark, d):
    """Rows without an id, dealt in turn: ids are generated over all shards and mapped to where the row went."""
    e = Engine(spark, Config(SHARDS, folders.scratch(spark), "round-robin"))
    e.create_schema("CREATE TABLE r (id INTEGER PRIMARY KEY AUTOINCREMENT, name TEXT NOT NULL)")
    names = [r.r_name for r in read(spark, d, "region").orderBy("r_regionkey").collect()]  # five rows by definition
    done = [e.insert("INSERT INTO r (name) VALUES (?)", [n]) for n in names]
    mapped = frame(spark, [(g["id"], e.mapping.get(str(g["id"]))) for g in done], "id long, mapped string")
    return e.table("r").join(mapped, "id").select("id", F.col("_shard").alias("shard"), "name", "mapped")


@query("SELECT n_nationkey, 'shard-1' AS shard FROM nation WHERE n_nationkey = 3")
def insert_on_a_shard(spark, d):
    e = Engine(spark, Config(SHARDS, folders.scratch(spark)))
    e.create_schema("CREATE TABLE n (id INTEGER PRIMARY KEY, name TEXT)")
    got = e.insert("INSERT INTO n (id, name) VALUES (?, ?)", [3, "x"], shard="shard-1")
    return frame(spark, [(got["id"], e.mapping.get("3"))], "n_nationkey int, shard string")


# mapping


def _set(spark, d) -> Mapping:
    """Every nation set by itself, with two further keys."""
    m = Mapping.empty(spark)
    for r in nations(spark, d):
        m = m.set(str(r.n_nationkey), SHARDS[r.n_regionkey % 4], [f"name:{r.n_name}", f"code:{r.n_nationkey}"])
    return m


_KEYS = "(SELECT n_nationkey, n_regionkey, unnest([CAST(n_nationkey AS VARCHAR), 'name:' || n_name, 'code:' || CAST(n_nationkey AS VARCHAR)]) AS k FROM nation)"


@query(f"SELECT sha256(k) AS key_id, 'shard-' || CAST(n_regionkey % 4 AS VARCHAR) AS shard, sha256(CAST(n_nationkey AS VARCHAR)) AS group_id FROM {_KEYS}")
def mapping_set(spark, d):
    return _set(spark, d).keys.select("key_id", "shard", "group_id")


@query(f"SELECT sha256(k) AS key_id, CASE WHEN n_nationkey % 4 = 1 THEN 'shard-9' ELSE 'shard-' || CAST(n_regionkey % 4 AS VARCHAR) END AS shard FROM {_KEYS}")
def mapping_update(spark, d):
    """Any key of a record moves all of them."""
    m = _set(spark, d).materialise()
    for r in nations(spark, d):
        if r.n_nationkey % 4 == 1:
            m = m.update(f"name:{r.n_name}", "shard-9")
    return m.keys.select("key_id", "shard")


@query(f"SELECT sha256(k) AS key_id FROM {_KEYS} WHERE n_nationkey % 3 <> 0")
def mapping_delete(spark, d):
    """Any key of a record forgets all of them; unknown keys change nothing."""
    m = _set(spark, d).materialise().delete("unknown")
    for r in nations(spark, d):
        if r.n_nationkey % 3 == 0:
            m = m.delete(f"code:{r.n_nationkey}")
    return m.keys.select("key_id")


@query("SELECT sha256('region:' || CAST(n_nationkey AS VARCHAR)) AS key_id, 'shard-' || CAST(n_regionkey % 4 AS VARCHAR) AS shard FROM nation")
def mapping_add_lookup_keys(spark, d):
    m = _set(spark, d)
    for r in nations(spark, d):
        m = m.add_lookup_keys(f"name:{r.n_name}", [f"region:{r.n_nationkey}"])
    new = frame(spark, [(str(r.n_nationkey),) for r in nations(spark, d)], "k string").select(F.sha2(F.concat(F.lit("region:"), "k"), 256).alias("key_id"))
    return m.keys.join(new, "key_id", "left_semi").select("key_id", "shard")


@query("SELECT unnest(['7', 'code:7', 'name:' || n_name]) AS key FROM nation WHERE n_nationkey = 7")
def mapping_lookup_keys(spark, d):
    """All keys of one record, by any of them, where keys are kept in clear."""
    m = Mapping.empty(spark, hashed=False)
    for r in nations(spark, d):
        m = m.set(str(r.n_nationkey), "s", [f"name:{r.n_name}", f"code:{r.n_nationkey}"])
    return m.lookup_keys("code:7").select("key")


@query("SELECT 75::BIGINT AS before, 0::BIGINT AS after, CAST(NULL AS VARCHAR) AS found")
def mapping_cleared(spark, d):
    e = Engine(spark, Config(SHARDS, folders.scratch(spark)))
    e.mapping = _set(spark, d)
    n = e.mapping.keys.count()
    e.flush()
    return frame(spark, [(n, e.mapping.keys.count(), e.mapping.get("7"))], "before long, after long, found string")


@query("SELECT * FROM (VALUES ('shard-0', 0), ('shard-1', 1), ('shard-2', 2), ('shard-3', 3), ('new-1', 4), ('new-2', 5)) t(shard, place)")
def known_shards(spark, d):
    e = Engine(spark, Config(SHARDS, folders.scratch(spark)))
    for s in ("new-1", "shard-2", "new-2", "new-1"):
        e.add_known_shard(s)
    return frame(spark, [(s, i) for i, s in enumerate(e.known_shards())], "shard string, place int")


@query(f"SELECT s.shard, CAST(CASE WHEN s.shard = 'shard-2' THEN 0 ELSE coalesce(n, 0) END AS BIGINT) AS n, s.shard <> 'shard-2' AS success FROM {SHARD_LIST} LEFT JOIN (SELECT _shard, count(*) AS n FROM {ORDERS} GROUP BY 1) o ON o._shard = s.shard")
def merged_outcomes(spark, d):
    """A job per shard on a small pool; one shard's failure stays its own."""
    o = placed(spark, d, "orders", "o_orderkey")

    def run(s):
        if s == "shard-2":
            raise ValueError("down")
        return [fanout.shard_frame(o, s).count()]

    return frame(spark, [(x.shard, x.rows[0] if x.success else 0, x.success) for x in fanout.isolated(SHARDS, run, 2).outcomes], "shard string, n long, success boolean")


# keyed and shard statements


@query("SELECT n_nationkey, n_name, n_regionkey * 10 AS n_regionkey FROM nation WHERE n_nationkey % 2 = 0")
def keyed_statements(spark, d):
    """run changes a record through its key, first reads it, all reads it with others of its shard."""
    e = keyed(spark, d)
    out = []
    for r in (r for r in nations(spark, d) if r.n_nationkey % 2 == 0):
        k = str(r.n_nationkey)
        e.run(k, "UPDATE nation SET n_regionkey = n_regionkey * 10 WHERE n_nationkey = ?", [r.n_nationkey])
        row = e.first(k, "SELECT * FROM nation WHERE n_nationkey = ?", [r.n_nationkey])
        out.append((row.n_nationkey, row.n_name, row.n_regionkey))
    return frame(spark, out, "n_nationkey int, n_name string, n_regionkey int")


@query(f"SELECT n_nationkey, _shard AS shard, (SELECT min(m.n_name) FROM {NATIONS} m WHERE m._shard = n._shard) AS first FROM {NATIONS} n")
def shard_statements(spark, d):
    """run, all and first of a named shard."""
    e, out = keyed(spark, d), []
    for s in SHARDS:
        first = e.first_shard(s, "SELECT n_name FROM nation ORDER BY n_name")
        out += [(r.n_nationkey, s, first.n_name) for r in e.all_shard(s, "SELECT n_nationkey FROM nation").rows]
        if e.all_shard(s, "SELECT * FROM nowhere").success or len(e.run_shard(s, "SELECT * FROM nation").rows) != e.count_shard(s, "nation"):
            raise RuntimeError(s)
    return frame(spark, out, "n_nationkey int, shard string, first string")


@query("SELECT n_nationkey, n_name, 'first' AS how FROM nation WHERE n_nationkey IN (3, 9) UNION ALL SELECT n_nationkey, n_name || '!', 'run' FROM nation WHERE n_nationkey = 9")
def prepared_statements(spark, d):
    """Nothing runs before run, all or first; bind gives new values to the same statement."""
    e, out = keyed(spark, d), []
    for k in (3, 9):
        row = e.prepare(str(k), "SELECT * FROM nation WHERE n_nationkey = ?").bind(k).first()
        out.append((row.n_nationkey, row.n_name, "first"))
    change = e.prepare("9", "UPDATE nation SET n_name = n_name || ? WHERE n_nationkey = ?")
    if e.prepare("9", "SELECT n_name FROM nation WHERE n_nationkey = ?").bind(9).first("n_name").endswith("!"):
        raise RuntimeError("ran too early")
    change.bind("!", 9).run()
    row = e.prepare("9", "SELECT * FROM nation WHERE n_nationkey = 9").all().rows[0]
    return frame(spark, [*out, (row.n_nationkey, row.n_name, "run")], "n_nationkey int, n_name string, how string")


@query("SELECT * FROM (VALUES (NULL::DOUBLE, 20, 0), (-3.0, 1, 0), (2.9, 2, 2), (7.0, 7, 7)) t(given, \"limit\", \"offset\")")
def page_options(spark, d):
    """Limits and offsets: whole, not negative, and a default where none (or none that is finite) is given."""
    rows = [(g, fanout.whole(g, 20, 1), fanout.whole(g, 0)) for g in (None, -3.0, 2.9, 7.0)]
    if fanout.whole(float("inf"), 20, 1) != 20:
        raise RuntimeError("infinite limit")
    return frame(spark, rows, "given double, limit int, offset int")


@query("SELECT * FROM (VALUES (0, 'bob'), (1, 'Éclair'), (2, 'item2'), (3, 'Item3'), (4, 'item10'), (5, 'Zoé')) t(place, name)")
def default_sort(spark, d):
    """Texts sort by natural order over all shards, minding neither case nor accents."""
    e = Engine(spark, Config(SHARDS, folders.scratch(spark)))
    names = ["Item3", "bob", "item10", "item2", "Zoé", "Éclair"]
    e.load("t", frame(spark, [(str(i), n) for i, n in enumerate(names)], "id string, name string"), "id")
    return frame(spark, [(i, r.name) for i, r in enumerate(e.all_global("SELECT * FROM t", sort_by="name")["results"])], "place int, name string")


@query(f"SELECT _shard AS shard, count(*) AS n, (SELECT count(*) FROM nation) AS total FROM {NATIONS} GROUP BY 1")
def count_per_shard(spark, d):
    """Counts of a key's shard, of each shard and of all."""
    e = keyed(spark, d)
    total = e.count_all("nation")["total"]
    if e.count("7", "nation") != e.count_shard(e.mapping.get("7"), "nation"):
        raise RuntimeError("count of a key's shard")
    return frame(spark, [(s, e.count_shard(s, "nation"), total) for s in SHARDS if e.count_shard(s, "nation")], "shard string, n long, total long")


@query(f"SELECT shard, shard IN (SELECT _shard FROM {ORDERS}) AS has_bytes, true AS sums FROM {SHARD_LIST}")
def size_getters(spark, d):
    """Bytes of a shard, of a key's shard and of all, from file listings."""
    e = _stored(spark, d, "orders", "o_orderkey")
    e.mapping = e.mapping.set("1", "shard-0")
    sums = e.total_size() == sum(e.size_of_shard(s) for s in SHARDS) and e.size_for_key("1") == e.size_of_shard("shard-0")
    return frame(spark, [(s, e.size_of_shard(s) > 0, sums) for s in SHARDS], "shard string, has_bytes boolean, sums boolean")


@query("SELECT max(o_orderkey) + 1 AS next, max(o_orderkey) + 500 AS above, max(o_orderkey) + 1 AS reserved, max(o_orderkey) + 2 AS after FROM orders")
def next_ids(spark, d):
    """The next id over all shards, a least one, and ids that a coordinator reserves."""
    e = _stored(spark, d, "orders", "o_orderkey")
    top = e.next_id("orders", "o_orderkey")
    above = e.next_id("orders", "o_orderkey", top + 499)
    e.coordinator = Coordinator()
    return frame(spark, [(top, above, e.next_id("orders", "o_orderkey"), e.next_id("orders", "o_orderkey"))], "next long, above long, reserved long, after long")


@query("SELECT count(*) AS n, 'shard-0' AS shard FROM nation")
def current_engine(spark, d):
    """One engine made current, replaced within a block, and forgotten."""
    a = active.initialize(spark, Config(SHARDS[:1], folders.scratch(spark)))
    a.load("nation", read(spark, d, "nation"), "n_nationkey")
    with active.scoped(Engine(spark, Config(["other"], folders.scratch(spark)))):
        inner = active.active_config().shards
    n, shards = active.current().count_all("nation")["total"], active.active_config().shards
    active.reset()
    if inner != ["other"] or active.is_initialized():
        raise RuntimeError("current engine")
    return frame(spark, [(n, shards[0])], "n long, shard string")


@query(f"SELECT shard, m.mode, true AS told FROM {SHARD_LIST}, (VALUES ('query-plan'), ('raw'), ('analyze')) m(mode)")
def explain_modes(spark, d):
    """The formatted plan, all stages of planning, and the plan as it ran, per shard: each names the pruned shard."""
    e, out = _stored(spark, d, "nation", "n_nationkey"), []
    marks = {"query-plan": "PartitionFilters", "raw": "Parsed Logical Plan", "analyze": "AdaptiveSparkPlan"}
    for mode, mark in marks.items():
        plans = e.explain_all("SELECT count(*) FROM nation", mode=mode)
        out += [(s, mode, mark in p and s in p) for s, p in plans.items()]
    return frame(spark, out, "shard string, mode string, told boolean")


# schema


@query("SELECT * FROM (VALUES ('a', 0, 'id', 1), ('a', 1, 'n', 0), ('b', 0, 'k', 1), ('b', 1, 'v', 0)) t(\"table\", cid, name, pk)")
def schema_script(spark, d):
    """A script of several statements, applied once by version and once by itself."""
    e = Engine(spark, Config(SHARDS, folders.scratch(spark)))
    script = "CREATE TABLE a (id TEXT PRIMARY KEY, n INTEGER); -- first; one\nCREATE TABLE IF NOT EXISTS b (k TEXT, v REAL, PRIMARY KEY (k)); CREATE INDEX by_n ON a (n DESC)"
    if not e.ensure_schema(script, version="1") or e.ensure_schema(script, version="1") or e.ensure_schema(script, once=True):
        raise RuntimeError("applied twice")
    return frame(spark, [(t, r.cid, r.name, r.pk) for t in e.list_tables() for r in e.store.info(t).collect()], "table string, cid int, name string, pk int")


@query("SELECT * FROM (VALUES ('a', true), ('b', false), ('c', false)) t(\"table\", \"exists\")")
def schema_dropped(spark, d):
    e = Engine(spark, Config(SHARDS, folders.scratch(spark)))
    e.create_schema("CREATE TABLE a (id TEXT); CREATE TABLE b (id TEXT)")
    e.run_shard("shard-0", "DROP TABLE IF EXISTS b")
    e.drop_schema("c")
    return frame(spark, [(t, e.schema_exists(t)) for t in "abc"], "table string, exists boolean")


@query("SELECT * FROM (VALUES ('idx_customer_c_custkey', 'made'), ('by_segment', 'refused'), ('few', 'made'), ('nope', 'refused')) t(name, state)")
def indexes(spark, d):
    """Unique indexes are checked over all rows, or over those of their condition."""
    e, out = _stored(spark, d, "customer", "c_custkey"), []
    for name, columns, more in ((None, "c_custkey", {}), ("by_segment", "c_mktsegment", {}), ("few", ["c_mktsegment"], {"condition": "c_custkey = 1"}), ("nope", "no_column", {})):
        try:
            out.append((e.index("customer", columns, name=name, unique=True, **more), "made"))
        except EngineError:
            out.append((name, "refused"))
    return frame(spark, out, "name string, state string")


@query("SELECT * FROM (VALUES (1::BIGINT, 2::BIGINT, 2::BIGINT, 3::BIGINT)) t(first, after_one, removed, after_all)")
def cache_invalidated(spark, d):
    cache, calls = Cache(MemoryKV()), []
    get = lambda k: cache.cached(k, lambda: calls.append(1) or len(calls))
    one = (get("c:a"), get("c:b"), cache.invalidate("c:"), get("c:a"))
    return frame(spark, [one], "first long, after_one long, removed long, after_all long")


@query("SELECT n_name AS key, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) END AS value FROM nation")
def lookup_deleted(spark, d):
    look, out = Lookups(MemoryKV()), []
    for r in nations(spark, d):
        look.set("n", r.n_name, str(r.n_nationkey))
        if r.n_nationkey % 2:
            look.delete("n", r.n_name)
        out.append((r.n_name, look.get("n", r.n_name)))
    return frame(spark, out, "key string, value string")


# statement builders

_BUILT = {
    "insert": "INSERT INTO `t` (`a`, `b`) VALUES (?, ?)", "replace": "INSERT OR REPLACE INTO `t` (`a`) VALUES (?)", "ignore": "INSERT OR IGNORE INTO `t` (`a`) VALUES (?) RETURNING `a`",
    "update": "UPDATE `t` SET `a` = ? WHERE `b` IS NULL AND `c` = ?", "delete": "DELETE FROM `t` WHERE `a` = ?", "upsert": "INSERT INTO `t` (`a`, `b`) VALUES (?, ?) ON CONFLICT (`a`) DO UPDATE SET `b` = excluded.`b`",
    "nothing": "INSERT INTO `t` (`a`) VALUES (?) ON CONFLICT (`a`) DO NOTHING", "index": "CREATE UNIQUE INDEX IF NOT EXISTS `idx_t_a` ON `t` (`a` COLLATE NOCASE DESC) WHERE a > 1", "quote": "`a`.`b_1`",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _BUILT.items()) + ") t(kind, statement)")
def built_statements(spark, d):
    rows = {
        "insert": builders.insert("t", {"a": 1, "b": None, "c": builders.ABSENT}).sql,
        "replace": builders.insert("t", {"a": 1}, replace=True).sql,
        "ignore": builders.insert("t", {"a": 1}, ignore=True, returning="a").sql,
        "update": builders.update("t", {"a": 1}, {"b": None, "c": 2}).sql,
        "delete": builders.delete("t", {"a": 1}).sql,
        "upsert": builders.upsert("t", {"a": 1, "b": 2}, ["a"]).sql,
        "nothing": builders.upsert("t", {"a": 1}, ["a"]).sql,
        "index": builders.index("t", [{"name": "a", "collate": "NOCASE", "order": "desc"}], unique=True, condition=" a > 1 ")[0],
        "quote": idents.quote("a.b_1"),
    }
    return frame(spark, list(rows.items()), "kind string, statement string")


@query("SELECT * FROM (VALUES ('empty where', 'EMPTY_WHERE'), ('name', 'INVALID_IDENTIFIER'), ('collation', 'INVALID_IDENTIFIER'), ('order', 'INVALID_IDENTIFIER'), ('values', 'BINDINGS_MISMATCH')) t(what, code)")
def refused_statements(spark, d):
    """Unsafe or empty parts are refused before any statement is made."""
    tries = {
        "empty where": lambda: builders.delete("t", {}),
        "name": lambda: builders.insert("t; DROP TABLE t", {"a": 1}),
        "collation": lambda: builders.index("t", [{"name": "a", "collate": "NOCASE); --"}]),
        "order": lambda: builders.index("t", [{"name": "a", "order": "DESC; --"}]),
        "values": lambda: sqlfront.bind("SELECT ?, '?'", [1, 2]),
    }
    out = []
    for what, f in tries.items():
        try:
            f()
        except EngineError as x:
            out.append((what, x.code))
    return frame(spark, out, "what string, code string")


@query("SELECT * FROM (VALUES (0, 'SELECT $1, ''?'' FROM t WHERE a = $2 -- ?'), (1, 'SELECT 1')) t(place, statement)")
def numbered_placeholders(spark, d):
    """Placeholders as numbers, for databases that want them so."""
    given = ["SELECT ?, '?' FROM t WHERE a = ? -- ?", "SELECT 1"]
    return frame(spark, [(i, idents.numbered(s)) for i, s in enumerate(given)], "place int, statement string")


# objects


@query("SELECT n_nationkey, CASE WHEN n_nationkey IN (4, 8) THEN 'patched' WHEN n_nationkey = 6 THEN 'upserted' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 2 THEN 99 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey NOT IN (10, 12) UNION ALL SELECT 100, 'new', 1 UNION ALL SELECT 101, 'given back', NULL UNION ALL SELECT 102, 'upserted', 5")
def object_crud(spark, d):
    """Insert, update, patch, delete and upsert plain values through their keys."""
    e, t = keyed(spark, d), "nation"
    e.insert_into("100", t, {"n_nationkey": 100, "n_name": "new", "n_regionkey": 1})
    if e.insert_returning("101", t, {"n_nationkey": 101, "n_name": "given back", "n_regionkey": None}, "n_nationkey").n_name != "given back":
        raise RuntimeError("insert_returning")
    e.update_row("2", t, {"n_regionkey": 99}, {"n_nationkey": 2})
    for k in ("4", "8"):
        e.patch(k, t, {"n_name": "patched"}, "n_nationkey")
    e.delete_row("10", t, {"n_nationkey": 10})
    e.delete_by_id("12", t, "n_nationkey")
    e.upsert("6", t, {"n_nationkey": 6, "n_name": "upserted", "n_regionkey": 0}, ["n_nationkey"], ["n_name"])
    e.upsert("102", t, {"n_nationkey": 102, "n_name": "upserted", "n_regionkey": 5}, ["n_nationkey"])
    return e.table(t).drop("_shard")


# statements on tables


@query("SELECT * FROM (VALUES (1::BIGINT, 7::BIGINT, 'a, (b)', true), (2, 8, 'x', true), (3, 7, NULL, true)) t(id, v, s, stamped)")
def column_rules(spark, d):
    """Defaults, values that must be given, and generated numbers."""
    e = Engine(spark, Config(SHARDS, folders.scratch(spark)))
    e.create_schema("CREATE TABLE t (id INTEGER PRIMARY KEY AUTOINCREMENT, v INTEGER NOT NULL DEFAULT 7, s TEXT DEFAULT 'a, (b)', at TIMESTAMP DEFAULT CURRENT_TIMESTAMP, need TEXT NOT NULL)")
    run = lambda sql: e.run_shard("shard-0", sql)
    run("INSERT INTO t (need) VALUES ('n')")
    run("INSERT INTO t (v, s, need) VALUES (8, 'x', 'n')")
    run("INSERT INTO t (id, s, need) VALUES (NULL, NULL, 'n')")
    for sql in ("INSERT INTO t (v) VALUES (1)", "INSERT INTO t (v, need) VALUES (NULL, 'n')", "UPDATE t SET need = NULL"):
        try:
            run(sql)
            raise RuntimeError(sql)
        except EngineError as x:
            if x.code != "CONSTRAINT_FAILED":
                raise
    return e.table("t").select("id", "v", "s", F.col("at").isNotNull().alias("stamped"))


@query("SELECT * FROM (VALUES ('insert', 2, 2::BIGINT), ('ignore', 0, NULL), ('update', 1, NULL), ('none', 0, NULL), ('delete', 2, NULL)) t(kind, changes, last_id)")
def change_counts(spark, d):
    e = Engine(spark, Config(SHARDS, folders.scratch(spark)))
    e.create_schema("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT)")
    done = {"insert": "INSERT INTO t VALUES (1, 'a'), (2, 'b')", "ignore": "INSERT OR IGNORE INTO t VALUES (2, 'c')", "update": "UPDATE t SET v = 'z' WHERE id = 1", "none": "UPDATE t SET v = 'z' WHERE id = 9", "delete": "DELETE FROM t"}
    out = [(k, (r := e.run_shard("shard-0", sql)).changes, r.last_id) for k, sql in done.items()]
    return frame(spark, out, "kind string, changes int, last_id long")


@query("SELECT 1 AS id, 'Alice n name' AS name UNION ALL SELECT 2, 'name'")
def conflict_text(spark, d):
    """Names of columns inside texts are texts."""
    e = Engine(spark, Config(SHARDS, folders.scratch(spark)))
    e.create_schema("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)")
    e.run_shard("shard-0", "INSERT INTO t VALUES (1, 'Alice')")
    e.run_shard("shard-0", "INSERT INTO t VALUES (1, 'x'), (2, 'name') ON CONFLICT (id) DO UPDATE SET name = concat(name, ' n name')")
    return e.table("t").select(F.col("id").cast("int").alias("id"), "name")


@query(f"SELECT c_custkey, _shard AS shard FROM {CUSTOMERS} WHERE c_name ILIKE 'customer#%1' AND c_mktsegment NOT ILIKE 'b%'")
def sql_like(spark, d):
    """LIKE minds no case; text in quotes that says LIKE is text."""
    e = _stored(spark, d, "customer", "c_custkey")
    return e.everywhere("SELECT c_custkey FROM customer WHERE c_name LIKE 'customer#%1' AND c_mktsegment NOT LIKE 'b%' AND ' LIKE ' = ?", [" LIKE "]).withColumnRenamed("_shard", "shard")


@query("SELECT n_nationkey, n_name AS \"a name\", CAST(NULL AS DOUBLE) AS none, n_regionkey / 4 AS part, 'it''s \"q\"' AS q FROM nation")
def sql_identifiers(spark, d):
    """Names in double quotes are columns; a division by zero is null."""
    e = _stored(spark, d, "nation", "n_nationkey")
    return e.everywhere("SELECT \"n_nationkey\", \"n_name\" AS \"a name\", n_regionkey / 0 AS none, n_regionkey / 4 AS part, ? AS q FROM \"nation\"", ["it's \"q\""]).drop("_shard")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY _shard ORDER BY o_orderkey) AS i FROM " + ORDERS + ") WHERE i BETWEEN 4 AND 8")
def sql_limit_offset(spark, d):
    """LIMIT a, b on every shard: b rows after a."""
    return _stored(spark, d, "orders", "o_orderkey").everywhere("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3, 5").drop("_shard")


@query("WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS customers, CAST(sum(n) AS BIGINT) AS orders FROM big")
def sql_with(spark, d):
    """WITH, a subquery and literals in one statement over a single shard."""
    e = Engine(spark, Config(["all"], folders.scratch(spark)))
    e.load("orders", read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return e.query("all", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > ?) SELECT count(*) AS customers, sum(n) AS orders FROM big", [1])


@query("SELECT * FROM (VALUES (1, 1::BIGINT, 1.5::DOUBLE, 'it''s', true, NULL::VARCHAR, DATE '2024-02-29')) t(i, l, f, s, b, n, d)")
def sql_literals(spark, d):
    import datetime

    e = Engine(spark, Config(["all"], folders.scratch(spark)))
    df = e.query("all", "SELECT ? AS i, CAST(? AS BIGINT) AS l, ? AS f, ? AS s, ? AS b, ? AS n, ? AS d", [1, 1, 1.5, "it's", True, None, datetime.date(2024, 2, 29)])
    return df.withColumn("n", F.col("n").cast("string"))


@query("SELECT * FROM (VALUES ('index', 'by_name', 'nation'), ('table', 'nation', 'nation'), ('table', 't', 't')) t(type, name, tbl_name)")
def sql_catalog(spark, d):
    """The catalog as a table of its own."""
    e = _stored(spark, d, "nation", "n_nationkey")
    e.create_schema("CREATE TABLE t (id TEXT); CREATE INDEX by_name ON nation (n_name)")
    return e.query("shard-0", "SELECT type, name, tbl_name FROM sqlite_master WHERE sql LIKE 'create%'")


@query("SELECT * FROM (VALUES ('page_size', 4096::BIGINT, 1::BIGINT), ('page_count', 1, 1), ('foreign_keys', 0, 0)) t(name, value, n)")
def sql_pragmas(spark, d):
    e = _stored(spark, d, "region", "r_regionkey")
    out = []
    for name in ("page_size", "page_count", "foreign_keys"):
        rows = e.run_shard("shard-0", f"PRAGMA {name}").rows
        value = rows[0][0] if rows else 0
        out.append((name, min(value, 1) if name == "page_count" else value, len(rows)))
    return frame(spark, out, "name string, value long, n long")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey % 2 = 1")
def staged_random_change(spark, d):
    """What a statement returns is what it stored, even where its values are random."""
    e = _stored(spark, d, "nation", "n_nationkey")
    for s in SHARDS:
        got = e.run_shard(s, "UPDATE nation SET n_name = uuid() WHERE n_nationkey % 2 = 0 RETURNING n_nationkey, n_name").rows
        have = {r.n_nationkey: r.n_name for r in e.all_shard(s, "SELECT * FROM nation").rows}
        if any(have[r.n_nationkey] != r.n_name for r in got):
            raise RuntimeError(s)
        e.run_shard(s, "DELETE FROM nation WHERE n_nationkey % 2 = 0")
    return e.table("nation").drop("_shard")


# coordinator


@query("SELECT * FROM (VALUES ('a', 5::BIGINT), ('b', 0), ('d', 3)) t(shard, n)")
def coordinator_counts(spark, d):
    """Shards are added and removed, counters set, raised and lowered; the state outlives the coordinator."""
    kv = MemoryKV()
    c = Coordinator(kv)
    for s in "abcd":
        c.add_shard(s)
    c.set_count("a", 4)
    c.change_count("a", 1)
    c.change_count("b", -7)
    c.change_count("d", 3)
    c.change_count("unknown", 3)
    c.remove_shard("c")
    again = Coordinator(kv)
    return frame(spark, [(s, again.stats[s]["count"]) for s in again.shards], "shard string, n long")


@query("SELECT 'OK' AS health, 0 AS shards, 1::BIGINT AS sequence")
def coordinator_flushed(spark, d):
    c = Coordinator(MemoryKV(), "round-robin")
    c.add_shard("a")
    c.sequence("t", 50)
    c.flush()
    return frame(spark, [(c.health(), len(c.shards), c.sequence("t"))], "health string, shards int, sequence long")


# onboarding


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name FROM customer")
def discover_records(spark, d):
    """Keys with the alias columns that the table has."""
    return migrate.discover_records(read(spark, d, "customer").withColumnRenamed("c_name", "name"), "c_custkey")


@query("SELECT c_name AS key, 'shard-' || CAST((row_number() OVER (ORDER BY c_name) - 1) % 4 AS VARCHAR) AS shard FROM customer")
def mappings_for_keys(spark, d):
    return migrate.mappings_for(read(spark, d, "customer").select(F.col("c_name").alias("key")), Allocation(SHARDS, "round-robin"))


@query("SELECT n_name AS primary_key, 'shard-2' AS shard_name, true AS needed, false AS still FROM nation")
def integrated_database(spark, d):
    """Existing tables mapped where they are, with a marker table; a table without the key is an issue."""
    e = Engine(spark, Config(SHARDS, folders.scratch(spark)))
    t = read(spark, d, "nation").withColumnRenamed("n_name", "id")
    needed = migrate.migration_needed(t, e.mapping)
    out = e.integrate({"nation": t, "bad": read(spark, d, "region")}, "shard-2", marker=True)
    if len(out.issues) != 1 or out.records != t.count():
        raise RuntimeError(str(out.issues))
    still = migrate.migration_needed(t, e.mapping)
    return e.table(e.MARKER).select("primary_key", "shard_name", F.lit(needed).alias("needed"), F.lit(still).alias("still"))


@query(f"SELECT sha256(CAST(n_nationkey AS VARCHAR)) AS key_id, _shard AS shard FROM {NATIONS}")
def background_migration(spark, d):
    """Unmapped keys of a stored table mapped in the background, once until the cache is cleared."""
    e = _stored(spark, d, "nation", "n_nationkey")
    first = e.auto_migrate("nation", "n_nationkey").result(300)
    same = e.auto_migrate("nation", "n_nationkey").result(300)
    e.clear_migration_caches()
    if (first, same, e.auto_migrate("nation", "n_nationkey", background=False).result(300)) != (25, 25, 0):
        raise RuntimeError("migrated again")
    return e.mapping.keys.select("key_id", "shard")


@query("SELECT o_orderkey, 'shard-' || CAST((row_number() OVER (ORDER BY o_orderkey) + 1) % 4 AS VARCHAR) AS shard FROM orders")
def round_robin_from(spark, d):
    """Turns that go on from an earlier count."""
    return round_robin(read(spark, d, "orders"), SHARDS, "o_orderkey", start=2).select("o_orderkey", F.col("_shard").alias("shard"))
