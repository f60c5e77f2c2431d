import pytest
from pyspark.sql import functions as F

from shardloom.errors import EngineError
from shardloom.operators import dml, fanout, ids
from shardloom.operators.coordinator import Coordinator
from shardloom.operators.mapping import Mapping
from shardloom.operators.strategies import Allocation
from shardloom.plans.engine import Config, Engine
from shardloom.sources import connectors
from shardloom.sources.cache import Cache, Lookups
from shardloom.sources.databases import STYLES, ClientDatabase, read_database
from shardloom.sources.kv import ClientKV, MemoryKV, all_keys, get_json, is_kv_store
from shardloom.sources.tables import TableStore
from shardloom.streaming.routed import routed, write_routed

SHARDS = ["s0", "s1", "s2"]


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, Config(SHARDS, f"file://{tmp_path}/db"))


def raises(code, f, *a, **k):
    with pytest.raises(EngineError) as e:
        f(*a, **k)
    assert e.value.code == code


def test_keyed_crud(engine):
    engine.create_schema("CREATE TABLE users (id TEXT PRIMARY KEY, name TEXT, score INTEGER); -- done\n")
    assert engine.run("u1", "INSERT INTO users (id, name, score) VALUES (?, ?, ?)", ["u1", "O'Neil", 5]).changes == 1
    assert engine.first("u1", "SELECT * FROM users WHERE id = ?", ["u1"]).asDict() == {"id": "u1", "name": "O'Neil", "score": 5}
    assert engine.run("u1", "UPDATE users SET score = score + 1 WHERE id = ? RETURNING score", ["u1"]).rows[0].score == 6
    raises("CONSTRAINT_FAILED", engine.run, "u1", "INSERT INTO users (id) VALUES ('u1')")
    assert engine.run("u1", "INSERT OR IGNORE INTO users (id, name) VALUES ('u1', 'x')").changes == 0
    engine.upsert("u1", "users", {"id": "u1", "name": "new", "score": 1}, ["id"], ["name"])
    assert engine.first("u1", "SELECT name, score FROM users")[:] == ("new", 6)
    assert engine.insert_returning("u2", "users", {"id": "u2", "score": None}).id == "u2"
    engine.patch("u2", "users", {"score": 7})
    assert engine.first("u2", "SELECT score FROM users WHERE id = 'u2'").score == 7
    assert engine.count_all("users")["total"] == 2
    shard = engine.mapping.get("u2")
    assert engine.delete_by_id("u2", "users").changes == 1
    assert engine.count_all("users")["total"] == 1 and (shard == engine.mapping.get("u1") or engine.count_shard(shard, "users") == 0)
    raises("QUERY_FAILED", engine.run, "u1", "SELECT * FROM nowhere")
    raises("SHARD_NOT_FOUND", engine.run_shard, "zz", "SELECT 1")
    assert not engine.all_shard("s0", "SELECT * FROM nowhere").success


def test_load_fan_out_and_pages(engine, spark):
    rows = [(f"k{i}", i % 5, i) for i in range(40)]
    engine.load("t", spark.createDataFrame(rows, "id string, grp int, score long"), "id")
    want = {k: Allocation(SHARDS) for k, *_ in rows}
    assert len(want) == 40 and engine.count_all("t")["total"] == 40
    assert sorted(r.score for r in engine.run_all_shards("SELECT * FROM t").rows) == list(range(40))
    top = engine.all_global("SELECT id, score FROM t", sort_by="score", direction="desc", offset=1, limit=2, include_total=True)
    assert [r.score for r in top["results"]] == [38, 37] and top["total"] == 40
    page = engine.paginate("SELECT * FROM t WHERE grp = ?", [1], page=2, limit=3, sort_by="score")
    assert [r.score for r in page["results"]] == [16, 21, 26] and (page["total"], page["pages"]) == (8, 3)
    assert engine.paginate("SELECT * FROM t WHERE grp = 99")["pages"] == 0
    assert engine.first_global("SELECT * FROM t", sort_by="score", offset=4).score == 4
    assert len(engine.first_all_shards("SELECT * FROM t ORDER BY score LIMIT 1")) == 3
    assert engine.everywhere("SELECT * FROM t ORDER BY score LIMIT 2").count() == 6
    assert engine.all_by_lookup("unmapped", "SELECT * FROM t WHERE id = 'k3'")[0].score == 3
    assert engine.mapping.get("unmapped") is None
    assert engine.first_resilient("stranger", "SELECT * FROM t WHERE id = 'k9'").score == 9
    assert engine.next_id("t", "score") == 40 and engine.next_id("t", "score", 100) == 100
    assert "Scan" in engine.explain("s0", "SELECT * FROM t") and engine.total_size() > 0
    assert sum(r["count"] for r in engine.shard_stats().collect()) >= 40
    engine.load("t", spark.createDataFrame([("k40", 0, 40)], "id string, grp int, score long"), "id")
    assert engine.count_all("t")["total"] == 41


def test_partial_failure_keeps_other_rows():
    def run(shard):
        if shard == "s1":
            raise ValueError("down")
        return [shard]

    m = fanout.isolated(SHARDS, run)
    assert m.rows == ["s0", "s2"] and not m.success and m.error == "down" and [o.success for o in m.outcomes] == [True, False, True]


def test_reassign_and_emptied_shards(engine, spark):
    engine.load("t", spark.createDataFrame([("a", 1)], "id string, v int"), "id")
    now = engine.mapping.get("a")
    to = next(s for s in SHARDS if s != now)
    engine.reassign("a", to, "t")
    assert engine.count_shard(now, "t") == 0 and engine.count_shard(to, "t") == 1 and engine.mapping.get("a") == to
    raises("MAPPING_NOT_FOUND", engine.reassign, "zz", to, "t")
    raises("SHARD_NOT_FOUND", engine.reassign, "a", "zz", "t")
    assert engine.run_shard(to, "DELETE FROM t").changes == 1 and engine.count_all("t")["total"] == 0


def test_generated_ids_round_robin(spark, tmp_path):
    e = Engine(spark, Config(SHARDS, f"file://{tmp_path}/db", "round-robin"))
    e.create_schema("CREATE TABLE tickets (id INTEGER PRIMARY KEY, s TEXT)")
    got = [e.insert("INSERT INTO tickets (s) VALUES (?)", [x]) for x in "abc"]
    assert [g["id"] for g in got] == [1, 2, 3] and [g["shard"] for g in got] == SHARDS and e.mapping.get("2") == "s1"


def test_schema_helpers(engine):
    assert engine.ensure_schema("CREATE TABLE a (id TEXT PRIMARY KEY, x INTEGER)", version="v1") and not engine.ensure_schema("CREATE TABLE a (id TEXT)", version="v1")
    assert engine.schema_exists("a") and engine.list_tables() == ["a"]
    engine.run_shard("s0", "INSERT INTO a VALUES ('p', 1), ('q', 1)")
    assert [(r.name, r.pk) for r in engine.run_shard("s0", "PRAGMA table_info(a)").rows] == [("id", 1), ("x", 0)]
    assert engine.index("a", "id", unique=True) == "idx_a_id"
    raises("CONSTRAINT_FAILED", engine.index, "a", "x", unique=True)
    raises("INVALID_INDEX_COLUMNS", engine.index, "a", "nope")
    engine.create_schema("CREATE INDEX by_x ON a (x)")
    engine.optimize("a")
    assert engine.count_all("a")["total"] == 2
    engine.create_schema("CREATE TABLE IF NOT EXISTS a (id TEXT)")
    assert engine.count_all("a")["total"] == 2  # never emptied
    engine.drop_schema("a", "never")
    assert not engine.schema_exists("a")
    raises("SCHEMA_MIGRATION_FAILED", engine.create_schema, "SELEC 1")


def test_null_order_aggregates_and_scalars(spark):
    u = spark.createDataFrame([("a", 30), ("b", 20), ("c", 25), ("d", None)], "id string, age int").withColumn("_shard", F.lit("s0"))
    assert [r.id for r in fanout.global_rows(u, by=[F.col("age")], limit=2).collect()] == ["d", "b"]
    assert [r.id for r in fanout.global_rows(u, by=fanout.order("age", "desc"), offset=2, limit=2).collect()] == ["c", "b"]
    assert [r.id for r in fanout.global_rows(u, by=fanout.order("age")).collect()] == ["b", "c", "a", "d"]
    v = u.where("age in (30, 20) or id = 'x'").union(spark.createDataFrame([("z", 10, "s1")], "id string, age int, _shard string"))
    r = v.selectExpr("count(*) n", "min(age) lo", "max(age) hi", "sum(age) s", "avg(age) m").head()
    assert tuple(r) == (3, 10, 30, 60, 20.0)
    t = spark.createDataFrame([(1,), (5,), (3,)], "id int")
    assert ids.next_id(t) == 6 and ids.next_id(t.limit(0)) == 1 and ids.next_id(t, least=float("nan")) == 6
    assert fanout.whole(float("inf"), 50) == 50 and fanout.whole(-3, 0) == 0 and fanout.whole(2.9, None) == 2


def test_changes(spark):
    old = spark.createDataFrame([("a", 5), (None, 1)], "id string, n int")
    new = spark.createDataFrame([("a", 7, 1), ("a", 9, 2), (None, 3, 1), ("b", 1, 1)], "id string, n int, _seq int")
    up = dml.upsert(old, new, ["id"], {"n": "n + excluded.n"}, order="_seq")
    assert sorted((str(r.id), r.n) for r in up.table.collect()) == [("None", 4), ("a", 14), ("b", 1)] and up.affected.count() == 3
    assert sorted(r.n for r in dml.delete(old, "id = 'a'").table.collect()) == [1]
    assert dml.update(old, {"n": "n * 10", "id": "concat(id, n)"}, "n > 1").returning(["id", "n"]).collect()[0][:] == ("a5", 50)
    raises("EMPTY_WHERE", dml.delete, old, None)
    raises("EMPTY_UPDATE", dml.update, old, {})
    raises("INVALID_IDENTIFIER", dml.insert, old, new, ["id"])
    raises("CONSTRAINT_FAILED", dml.insert, old, new.where("id = 'b'").drop("_seq").union(new.where("id = 'b'").drop("_seq")), ["id"])


def test_mapping_groups(spark):
    m = Mapping.empty(spark)
    for i, s in ((1, "db-a"), (2, "db-a"), (3, "db-b")):
        m = m.set(f"user-{i}", s, [f"email:{i}", f"name:{i}"])
    assert {r.shard: r["count"] for r in m.counts().collect()} == {"db-a": 12, "db-b": 6}
    assert {r.shard: r["count"] for r in m.counts(True).collect()} == {"db-a": 6, "db-b": 3}
    m = m.update("email:1", "db-b").add_lookup_keys("user-3", ["phone:3"])
    assert m.get("user-1") == m.get("name:1") == m.get("phone:3") == "db-b" and m.lookup_keys("phone:3").count() == 4
    m = m.delete("name:2").delete("unknown")
    assert m.get("user-2") is None and m.keys_for_shard("db-a").count() == 0
    plain = Mapping.empty(spark, hashed=False).set("k", "s", ["l"])
    assert sorted(r.key for r in plain.lookup_keys("l").collect()) == ["k", "l"]
    raises("MAPPING_NOT_FOUND", m.update, "nobody", "s")


def test_coordinator():
    kv = MemoryKV()
    c = Coordinator(kv, "round-robin")
    raises("NO_SHARDS", c.allocate, "k")
    for s in SHARDS:
        c.add_shard(s)
    assert [c.allocate("k") for _ in range(4)] == ["s0", "s1", "s2", "s0"]
    assert c.allocate("k", strategy="hash") == c.allocate("k", strategy="hash")
    c.set_count("s1", 5)
    c.change_count("s1", -9)
    assert c.stats["s1"]["count"] == 0
    assert [c.sequence("t"), c.sequence("t", 10), c.sequence("t", 3, n=5), c.sequence("t")] == [1, 10, 11, 16]
    assert Coordinator(kv).sequence("t") == 17
    c.remove_shard("s0")
    assert c.shards == ["s1", "s2"]
    raises("BAD_REQUEST", c.set_count, "s1", "x")
    c.flush()
    assert c.shards == [] and c.health() == "OK"


def test_kv_cache_lookups(spark, tmp_path):
    now = [100.0]
    kv = MemoryKV(lambda: now[0])
    cache, calls = Cache(kv, lambda: now[0]), []
    fetch = lambda: calls.append(1) or {"v": len(calls)}
    assert [cache.cached("c:a", fetch, 10), cache.cached("c:a", fetch, 10)] == [{"v": 1}] * 2
    now[0] += 11
    assert cache.cached("c:a", fetch, 10) == {"v": 2}
    kv.put("c:b", "not json")
    assert cache.cached("c:b", fetch) == {"v": 3} and cache.invalidate("c:") == 2 and len(kv) == 0
    for i in range(2500):
        kv.put(f"k{i:04}", str(i))
    assert len(all_keys(kv, "k")) == 2500 and kv.list("k", limit=2)["cursor"] == "k0001"
    kv.save(spark, f"{tmp_path}/kv")
    assert MemoryKV.load(spark, f"{tmp_path}/kv").get("k0007") == "7"
    look = Lookups(kv)
    look.set("email", "a@b", "u1")
    assert look.get("email", "a@b") == "u1"
    look.delete("email", "a@b")
    assert look.get("email", "a@b") is None and is_kv_store(kv) and not is_kv_store(3)
    kv.put("bad", "{")
    raises("KV_JSON_PARSE_FAILED", get_json, kv, "bad")

    class Client:
        def __init__(self):
            self.d = {}

        def getItem(self, k):
            return self.d.get(k)

        def setItem(self, k, v, ttl=None):
            self.d[k] = v

        def removeItem(self, k):
            self.d.pop(k, None)

        def getKeys(self, prefix):
            return list(self.d)

    wrapped = ClientKV(Client())
    wrapped.put("p:1", "x", 5)
    assert wrapped.get("p:1") == "x" and wrapped.list("p:") == {"keys": ["p:1"], "complete": True, "cursor": None}
    raises("NO_KV", ClientKV, object())


def test_table_versions_and_conflict(spark, tmp_path):
    a, b = (TableStore(spark, f"file://{tmp_path}/db") for _ in range(2))
    a.create("t", "id long", "id")
    rows = spark.range(10).withColumn("_shard", F.when(F.col("id") < 5, "x").otherwise("y"))
    a.append("t", rows)
    v = a._version("t")
    a.replace("t", rows.where("false"), ["x"])
    assert sorted(r.id for r in b.read("t").collect()) == list(range(5, 10)) and b.read("t", v).count() == 10
    with pytest.raises(EngineError) as e:
        b._publish("t", v, b.manifest("t"))
    assert e.value.code == "CONFLICT"
    a.append("t", rows, label="b1")
    a.append("t", rows, label="b1")
    assert b.read("t").count() == 15
    assert "PartitionFilters: [isnotnull(_shard" in b.read("t").where("_shard = 'y'")._jdf.queryExecution().toString()
    assert b.tables() == ["t"] and [r.name for r in b.info("t").collect()] == ["id"]


def test_onboarding(engine, spark):
    t = spark.createDataFrame([("1", "a@x"), ("2", None)], "id string, email string")
    bad = spark.createDataFrame([("m",)], "message string")
    dry = engine.integrate({"users": t, "logs": bad}, "s1", alias_keys=True, dry_run=True)
    assert dry.success and dry.tables == ["users"] and dry.records == 2 and len(dry.issues) == 1 and engine.mapping.get("1") is None
    engine.integrate({"users": t}, "s1", alias_keys=True)
    assert engine.mapping.get("email:a@x") == engine.mapping.get("2") == "s1"
    from shardloom.operators import migrate

    assert not migrate.migration_needed(t, engine.mapping) and migrate.validate(t.limit(0)).issues == ["table is empty"]
    more = spark.createDataFrame([("9", None)], t.schema)
    assert migrate.auto_migrate(more, engine.mapping, "s2").get("9") == "s2"
    assert {r.shard for r in migrate.mappings_for(spark.createDataFrame([("a",), ("b",), ("c",)], "key string"), Allocation(SHARDS, "round-robin")).collect()} == set(SHARDS)
    raises("DISCOVERY_FAILED", migrate.discover_keys, bad)


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "id int")
    df.write.parquet(f"{tmp_path}/p.parquet")
    env = {"DB": df, "DB_EAST": f"{tmp_path}/p.parquet", "db-west": df, "KV": df, "OTHER": df, "DB_BAD": 7}
    found = connectors.discover(spark, env)
    assert list(found) == ["db-primary", "db-east", "db-west"] and connectors.unite(found).count() == 3
    raises("NO_SHARDS", connectors.discover, spark, {"X": df})
    o = connectors.jdbc_options("postgres", "h", "d", 5432, user="u")
    assert o == {"url": "jdbc:postgresql://h:5432/d", "driver": "org.postgresql.Driver", "user": "u"}


def test_stream_is_routed_once(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.range(20).selectExpr("cast(id as string) id").write.parquet(src)
    stream = spark.readStream.schema("id string").parquet(src)
    assert routed(stream, "id", Allocation(SHARDS)).isStreaming
    store = TableStore(spark, f"file://{tmp_path}/db")
    store.create("t", "id string", "id")
    for _ in range(2):
        write_routed(stream, store, "t", "id", Allocation(SHARDS), f"{tmp_path}/ck").awaitTermination()
    assert store.read("t").count() == 20


def test_a_database_is_read_in_ranges(spark, tmp_path):
    import sqlite3

    path = f"{tmp_path}/x.db"
    c = sqlite3.connect(path)
    c.execute("CREATE TABLE t (id INTEGER, name TEXT)")
    c.executemany("INSERT INTO t VALUES (?, ?)", [*((i, f"n{i}") for i in range(-5, 95)), (None, "none")])
    c.commit()
    c.close()
    for split in (None, ("id", 0, 80, 4), ("id", 0, 0, 1)):
        df = read_database(spark, lambda: sqlite3.connect(path), "t", "id long, name string", split)
        assert df.count() == 101 and {r.name for r in df.where("id is null").collect()} == {"none"}
    raises("INVALID_IDENTIFIER", read_database, spark, None, "t; DROP", "id long")
    raises("NO_SHARDS", ClientDatabase, object())
    assert STYLES["format"]("SELECT '?%' FROM t WHERE a LIKE ? AND b % 2 = 1") == "SELECT '?%%' FROM t WHERE a LIKE %s AND b %% 2 = 1"
