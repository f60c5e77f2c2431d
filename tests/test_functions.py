import pytest
from pyspark.sql import functions as F

from shardloom.errors import EngineError
from shardloom.functions import hashing, idents, regions, text
from shardloom.operators.strategies import Allocation, Location, rank, round_robin, size_filter
from shardloom.plans import builders, sqlfront

HASHES = {"user-123": -267697872, "email:jane@example.com": -718237943, "": 0, "Customer#000000001": 478928364, "polygenelubricants": -2147483648, "naïve": 104710475, "x😀y": 58534910}


def test_string_hash(spark):
    df = spark.createDataFrame([(k,) for k in HASHES], "k string")
    got = {r.k: (r.h, r.i) for r in df.select("k", hashing.string_hash("k").alias("h"), hashing.shard_number("k", 7).alias("i")).collect()}
    for k, h in HASHES.items():
        assert got[k] == (h, abs(h) % 7) and hashing.string_hash_of(k) == h and hashing.shard_number_of(k, 7) == abs(h) % 7


def test_key_id(spark):
    got = spark.range(1).select(hashing.key_id(F.lit("é")).alias("a"), hashing.key_id(F.lit("é"), False).alias("b")).head()
    assert got.a == hashing.key_id_of("é") and got.b == "é"


@pytest.mark.parametrize(("sql", "kind"), [("select 1", "read"), ("  WITH x AS (SELECT 1) DELETE", "read"), ("-- c\nSELECT 1", "write"), ("(SELECT 1)", "write"), ("pragma x", "read"), ("insert into t", "write")])
def test_operation(sql, kind):
    assert idents.operation(sql) == kind


def test_identifiers():
    assert idents.quote(" a.b_1 ") == "`a`.`b_1`"
    for bad in ("", "a b", "1a", "a.", "a;drop", 'a"b'):
        with pytest.raises(EngineError) as e:
            idents.quote(bad)
        assert e.value.code == "INVALID_IDENTIFIER"


def test_split_and_arity():
    assert idents.split_statements("a; -- c;\n b ';' ; /* ; */ ;c") == ["a", "b ';'", "c"]
    assert idents.placeholders("a = ? AND b = '?' -- ?\n AND c = ?") == 2
    with pytest.raises(EngineError) as e:
        idents.check_arity("?", [])
    assert e.value.code == "BINDINGS_MISMATCH"


def test_regions(spark):
    assert regions.distance("wnam", "wnam") == 0 and regions.distance("weur", "eeur") == pytest.approx(13.5706, abs=1e-3)
    rows = [("US", None, "California CA", None, "wnam"), ("US", None, "NY", "America/New_York", "enam"), ("PK", "AS", None, None, "apac"), ("PS", "AS", None, None, "me"), ("NG", "AF", None, None, "af"), ("KZ", "AS", None, None, "eeur"), (None, None, None, None, "wnam"), ("ZZ", "SA", None, None, "enam")]
    df = spark.createDataFrame(rows, "c string, k string, s string, z string, want string")
    assert all(r.got == r.want for r in df.select("want", regions.closest_region(F.col("c"), F.col("k"), F.col("s"), F.col("z")).alias("got")).collect())


def test_natural_order(spark):
    df = spark.createDataFrame([("a10",), ("a2",), ("B1",), ("á2b",)], "s string")
    assert [r.s for r in df.orderBy(text.natural_order(F.col("s"))).collect()] == ["a2", "á2b", "a10", "B1"]
    assert spark.range(1).select(text.number(F.lit("1.5")).alias("a"), text.number(F.lit("x")).alias("b")).head()[:] == (1.5, None)


def test_strategies(spark):
    a = Allocation(["a", "b"], {"read": "hash", "write": "location"}, "weur", {"a": Location("oc"), "b": Location("eeur", 0)})
    assert a.resolve("read") == "hash" and a.resolve("write") == "location" and a.nearest() == ["b"]
    assert Allocation(["a"], {"read": "random"}).resolve("write") == "random" and Allocation(["a"]).resolve() == "hash"
    tie = Allocation(["a", "b", "c"], "location", "me", {"a": Location("me", 2), "b": Location("me", 2), "c": Location("me", 1)})
    assert tie.nearest() == ["a", "b"]
    df = spark.range(100).withColumn("k", F.col("id").cast("string"))
    assert df.select(Allocation(["a", "b"], "random").column("k").alias("s")).distinct().count() == 2
    rr = round_robin(df, ["x", "y", "z"], "id", start=1).collect()
    assert all(r._shard == "xyz"[(r.id + 1) % 3] for r in rr)
    with pytest.raises(EngineError):
        Allocation([]).column("k")


def test_rank_is_dense(spark):
    df = spark.range(0, 5000, 3).repartition(7)
    assert sorted((r.id, r._rank) for r in rank(df, "id").collect()) == [(3 * i, i) for i in range(1667)]
    names = [None, "", *(f"Kunde é#{i:05}" for i in range(0, 900, 7)), "Kunde é#", "Z"]
    for pool in (names, names[2:-2]):
        s = spark.createDataFrame([(x,) for x in reversed(pool)], "s string")
        want = sorted(pool, key=lambda x: (x is not None, (x or "").encode()))
        assert [r.s for r in sorted(rank(s, "s").collect(), key=lambda r: r._rank)] == want
    assert rank(s.limit(0), "s").count() == 0


def test_size_filter():
    s = ["a", "b", "c"]
    assert size_filter(s, {"a": 1, "b": 9, "c": None}, 5) == ["a"]
    assert size_filter(s, {"a": 9, "b": 9}, 5) == s and size_filter(s, {}, None) == s and size_filter(s, {"a": 1}, float("inf")) == s


def test_builders():
    assert builders.insert("t", {"a": 1, "b": None, "c": builders.ABSENT}) == ("INSERT INTO `t` (`a`, `b`) VALUES (?, ?)", [1, None])
    assert builders.insert("t", {"a": 1}, replace=True, ignore=True, returning=True).sql == "INSERT OR REPLACE INTO `t` (`a`) VALUES (?) RETURNING *"
    assert builders.update("t", {"a": 1}, {"b": None, "c": 2}) == ("UPDATE `t` SET `a` = ? WHERE `b` IS NULL AND `c` = ?", [1, 2])
    assert builders.upsert("t", {"a": 1, "b": 2}, ["a"]).sql.endswith("ON CONFLICT (`a`) DO UPDATE SET `b` = excluded.`b`")
    assert builders.upsert("t", {"a": 1}, ["a"]).sql.endswith("DO NOTHING")
    assert builders.index("my t".replace(" ", "_"), ["A", {"name": "b", "order": "DESC", "collate": "NOCASE"}], unique=True, condition=" x > 1 ")[0] == "CREATE UNIQUE INDEX IF NOT EXISTS `idx_my_t_a_b` ON `my_t` (`A`, `b` COLLATE NOCASE DESC) WHERE x > 1"
    for f, code in ((lambda: builders.insert("t", {}), "EMPTY_INSERT"), (lambda: builders.update("t", {}, {"a": 1}), "EMPTY_UPDATE"), (lambda: builders.delete("t", {}), "EMPTY_WHERE"), (lambda: builders.upsert("t", {"a": 1}, []), "EMPTY_CONFLICT"), (lambda: builders.index("t", []), "INVALID_INDEX_COLUMNS")):
        with pytest.raises(EngineError) as e:
            f()
        assert e.value.code == code


def test_statement_parts():
    s = sqlfront.parse(sqlfront.bind("INSERT OR IGNORE INTO t (a, b) VALUES (?, 'x, y') ON CONFLICT (a) DO UPDATE SET b = excluded.b, c = coalesce(c, 0) + 1 RETURNING a, b AS z", ["it's ?"]))
    assert (s.kind, s.table, s.columns, s.conflict, s.keys) == ("insert", "t", ["a", "b"], "update", ["a"])
    assert s.sets == {"b": "excluded.b", "c": "coalesce(c, 0) + 1"} and s.returning == ["a", "b AS z"] and s.body == "VALUES ('it\\'s ?', 'x, y')"
    u = sqlfront.parse("UPDATE t SET n = n + 1, s = 'where' WHERE id = 'a' AND (x IN (SELECT y FROM z WHERE q)) RETURNING *;")
    assert u.sets == {"n": "n + 1", "s": "'where'"} and u.where == "id = 'a' AND (x IN (SELECT y FROM z WHERE q))" and u.returning == ["*"]
    assert sqlfront.parse("DELETE FROM t").where is None and sqlfront.parse("SELECT 1").kind == "query"
    c = sqlfront.parse("CREATE TABLE IF NOT EXISTS t (id TEXT PRIMARY KEY, n INTEGER DEFAULT 0, g REAL, FOREIGN KEY (n) REFERENCES u(id))")
    assert sqlfront.table_schema(c.columns) == ("`id` string, `n` bigint, `g` double", "id")
