"""Projects in the embedded database that ships with Spark."""

import datetime

import pytest
from pyspark.sql import functions as F

from strandplan.operators import projects
from strandplan.sources.database import Conflict, ProjectTable

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
DAY = datetime.datetime(2024, 5, 1, 12)


@pytest.fixture
def store(spark, tmp_path):
    table = ProjectTable(spark, f"jdbc:derby:{tmp_path}/db;create=true", driver=DRIVER)
    with table._statement() as s:
        s.execute('CREATE TABLE "Project" ("id" VARCHAR(40) PRIMARY KEY, "name" VARCHAR(99) NOT NULL, "user_id" INT, "updated_at" TIMESTAMP, "layers" VARCHAR(999))')
        for n in range(50):
            s.execute(f"""INSERT INTO "Project" VALUES ('id{n:02d}', 'it''s {n}', {n % 3}, TIMESTAMP('2024-05-01 12:00:00'), NULL)""")
    return table


def names(store):
    return {r.id: r["name"] for r in store.read().collect()}


def test_reads_in_parts_and_pushes_down(store):
    for parts in (1, 4, 60):
        found = store.read(parts)
        assert found.rdd.getNumPartitions() == (parts if parts < 50 else 50) and len(names(store)) == 50
        assert sorted(r.id for r in found.collect()) == [f"id{n:02d}" for n in range(50)]
    sizes = store.read(4).groupBy(F.spark_partition_id()).count().collect()
    assert {r["count"] for r in sizes} <= {12, 13}
    plan = store.read(4).where("user_id = 1").select("id")._jdf.queryExecution().toString()
    assert "PushedFilters: [*IsNotNull(user_id), *EqualTo(user_id,1)]" in plan and "ReadSchema: struct<id:string>" in plan
    assert [r.id for r in projects.page(store.read(3), F.lit(1), 1, 2).collect()] == ["id04", "id07"]


def test_saves_all_or_nothing(spark, store):
    seen = store.read().withColumn("seen", F.col("updated_at"))
    changes = spark.createDataFrame([("id03", ["name"], "new", None), ("id04", ["layers"], "kept", "[1]"), ("id05", ["name", "layers"], "both", None)], "id string, set array<string>, name string, layers string")
    rows = projects.updated(seen.where("id IN ('id03', 'id04', 'id05')"), changes, ["name", "layers"]).withColumn("updated_at", F.lit(DAY + datetime.timedelta(days=1)))
    rows = rows.unionByName(spark.createDataFrame([("x", "fresh", 9, DAY, None, None)], "id string, name string, user_id int, updated_at timestamp, layers string, seen timestamp"))
    store.save(rows, seen.where("id IN ('id10', 'id11')").select("id", "seen"))
    got = {r.id: r for r in store.read().collect()}
    assert len(got) == 49 and "id10" not in got and got["x"].user_id == 9
    assert (got["id03"].name, got["id04"].name, got["id04"].layers, got["id05"].name) == ("new", "it's 4", "[1]", "both")
    before = names(store)
    stale = seen.where("id = 'id20'").withColumn("seen", F.lit(DAY - datetime.timedelta(days=9))).withColumn("name", F.lit("lost"))
    good = seen.where("id = 'id21'").withColumn("name", F.lit("lost too"))
    gone = spark.createDataFrame([("id10", "late", 1, DAY, None, DAY)], rows.schema)
    taken = spark.createDataFrame([("x", "again", 1, DAY, None, None)], rows.schema)
    for bad in (stale, gone, taken):
        with pytest.raises(Conflict):
            store.save(good.unionByName(bad))
    with pytest.raises(Exception, match="."):
        store.save(good.unionByName(seen.where("id = 'id22'").withColumn("name", F.lit(None).cast("string"))))
    assert names(store) == before
    with store._statement() as s:
        assert store._values(s, "SELECT count(*) FROM SYS.SYSTABLES WHERE TABLETYPE = 'T'") == [1]
