import pytest
from pyspark.sql import functions as F

from laurel.operators import counting, dedup, gates, graph, match
from laurel.sources import files, snapshots
from laurel.streaming import rounds


def test_official_is_never_more_than_physical(spark, sf):
    from laurel.plans.domain import official_vs_physical

    assert official_vs_physical(spark, sf).where("official > physical").isEmpty()


def test_survivors_keep_conflicts_and_are_stable(spark):
    rows = spark.createDataFrame([(1, "a", 1, "x", None), (2, "a", 1, None, "y"), (3, "b", 1, "x", None), (4, "b", 1, "z", None), (5, None, 1, "q", None), (6, None, 1, "q", None)], "id long, k string, g int, u string, v string")
    once = dedup.survivors(rows, ["k", "g"], ["u", "v"], "id")
    assert sorted(map(tuple, once.collect()), key=str) == sorted([("a", 1, 1, "x", "y"), ("b", 1, 3, "x", None), ("b", 1, 4, "z", None), (None, 1, 5, "q", None)], key=str)
    twice = dedup.survivors(once, ["k", "g"], ["u", "v"], "id")
    assert sorted(map(tuple, twice.collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


def test_chain_is_not_a_safe_component(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (11, 12), (10, 12), (20, 21)], "a long, b long")
    found = {r.component: r.status for r in graph.safe_components(links).collect()}
    assert found == {1: "INCOMPLETE", 10: "ACCEPTED", 20: "ACCEPTED"}
    assert graph.safe_components(links, most=2).where("status = 'TOO_LARGE'").count() == 2


def test_long_chain_is_one_component(spark):
    chain = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert [tuple(r) for r in graph.components(chain).select("component").distinct().collect()] == [(0,)]


def test_best_of_prefers_the_better_medal(spark):
    rows = spark.createDataFrame([(1, 1, "Silver", 4, None), (2, 1, "Gold", 9, "c"), (3, 1, None, 2, "d")], "id long, p int, medal string, place int, club string")
    assert tuple(dedup.best_of(rows, ["p"], "medal", "place", ["club"], "id").first()) == (1, 1, "Gold", 2, "c")


def test_corrections_check_the_old_value(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    good = spark.createDataFrame([(1, "a", "b"), (2, None, "c")], "id long, old string, new string")
    assert [r.v for r in dedup.corrected(rows, good, "id", "v").orderBy("id").collect()] == ["b", "c"]
    with pytest.raises(Exception, match="not as expected"):
        dedup.corrected(rows, good.withColumn("old", F.lit("z")), "id", "v").collect()


def test_gates_stop(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(gates.GateError, match="key"):
        gates.enforce(gates.report([gates.unique(df, "key", ["k"]), gates.row_count(df, "rows", 2)]))


def test_prioritized_takes_the_first_step_only(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, "b")], "id int, n string")
    found = match.prioritized(rows, [F.col("n") == "b", F.col("n").contains("b")], "id")
    assert [(r.id, r.step) for r in found.collect()] == [(2, 0)]
    assert match.prioritized(rows, [F.col("n") == "zz"], "id").isEmpty()


def test_stratified_sample_is_stable(spark, sf):
    rows = spark.read.parquet(f"{sf}/customer.parquet").select("c_mktsegment", "c_custkey")
    a = counting.stratified_sample(rows, ["c_mktsegment"], "c_custkey", 3, 1).collect()
    b = counting.stratified_sample(rows.repartition(7), ["c_mktsegment"], "c_custkey", 3, 1).collect()
    assert sorted(a) == sorted(b)


def test_snapshots_restore_and_switch(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}/s", ["k"])
    v1 = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    v2 = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "k int, v string")
    store.full(v1, "one")
    store.differential(v2, "two", "one")
    assert store.verified("one", v1) and store.verified("two", v2) and not store.verified("two", v1)
    assert store.switch("one") is None and store.switch("two") == "one" and store.current() == "two"
    assert [r.name for r in store.inventory().collect()] == ["one", "two"]
    assert store.beyond(1).count() == 0  # the base of a kept snapshot stays
    assert {(r.k, r.change) for r in snapshots.difference(v1, v2, ["k"]).collect()} == {(2, "CHANGED"), (3, "REMOVED"), (4, "ADDED")}


def test_text_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes('﻿id,name\r\n19.0,"a ""b"", c"\r\nNA,\r\n'.encode())
    rows = files.read_text_csv(spark, f"file://{path}").collect()
    assert [tuple(r) for r in rows] == [("19.0", 'a "b", c'), ("NA", "")]
    path.write_bytes("id,name\n1,caf\xe9 €\n".encode("cp1252"))
    assert files.detect_encoding(spark, f"file://{path}") == "cp1252"
    assert files.read_text_csv(spark, f"file://{path}").first().name == "café €"
    path.write_text("id,id\n1,2\n")
    with pytest.raises(ValueError, match="repeated"):
        files.read_text_csv(spark, f"file://{path}")
    path.write_text("id,name\n1,2,3\n")
    with pytest.raises(Exception):
        files.read_text_csv(spark, f"file://{path}").collect()


def test_manifest(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.txt").write_text("y")
    then = spark.createDataFrame(files.hashes(spark, f"file://{tmp_path}").collect())
    (tmp_path / "a.txt").write_text("z")
    (tmp_path / "b.txt").unlink()
    (tmp_path / "c.txt").write_text("new")
    found = files.compared(files.hashes(spark, f"file://{tmp_path}"), then)
    assert {(r.file, r.status) for r in found.collect()} == {("a.txt", "MISMATCH"), ("b.txt", "MISSING"), ("c.txt", "NOT_IN_MANIFEST")}


def test_stream_appends_each_key_once(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    spark.range(10).write.parquet(f"file://{source}/1")
    spark.range(5, 15).write.parquet(f"file://{source}/2")
    stream = spark.readStream.schema("id long").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"file://{source}")
    query = rounds.upserting(stream, f"file://{target}", ["id"], f"file://{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(f"file://{target}").collect()) == list(range(15))


def test_streamed_windows(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"file://{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/e")
    query = rounds.tumbling(stream, "ts", "1 hour", ["event_type"], "1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("w").agg(F.sum("n")).first()[0] == events.count()


def test_event_alias_candidates_of_differing_names(spark):
    from laurel.operators import aliases

    rows = [
        (1, "100 metres, Men", "Athletics", "Track"),
        (2, "Men's 100 metres", "Athletics", "Track"),
        (3, "Men's 100 metres Olympic", "Athletics", "Track"),
        (4, "100 metres, Men", "Athletics", "Road"),
        (5, "100 metres, Women", "Athletics", "Track"),
        (6, "Sabre, Team, Men", "Fencing", None),
        (7, "Sabre, Men", "Fencing", None),
        (8, "Sabre, Individual, Masters, Three Hits, Men", "Fencing", None),
        (9, "100 metres", "Athletics", "Track"),
        (10, "100 metres, Men", "Athletics", "Track"),
    ]
    events = spark.createDataFrame(rows, "id long, name string, sport string, discipline string")
    got = {(r.a, r.b): r["class"] for r in aliases.event_candidates(events, ["sport", "discipline"]).collect()}
    assert got == {(1, 2): "AUTO", (1, 3): "AUTO", (2, 3): "AUTO", (2, 10): "AUTO", (3, 10): "AUTO", (6, 7): "REVIEW"}


def test_people_alias_candidates_by_context(spark):
    from laurel.operators import aliases

    rows = [
        (1, "Ana Silva", "1950-01-01"),
        (2, "Ana Maria Silva", None),
        (3, "Jon Smith", None),
        (4, "John Smith", None),
        (5, "Lee Ho", "1960-01-01"),
        (6, "Lee Ho Jun", "1961-01-01"),
        (7, "Bo Li", None),
        (8, "Bo Li Wang", None),
        (9, "Bo Li Chen", None),
        (10, "Pele", None),
        (11, "Pele Santos", None),
        (12, "Ana Silva", None),
    ]
    people = spark.createDataFrame(rows, "id long, name string, born string")
    at = [(i, "1972" if i < 12 else "1976", "X" if i < 7 else "Y", None) for i, _, _ in rows]
    contexts = spark.createDataFrame(at + at[:2], "id long, edition string, noc string, team string")
    got = {(r.a, r.b): r["class"] for r in aliases.people_candidates(people, contexts, ["edition", "noc", "team"]).collect()}
    assert got == {(1, 2): "AUTO", (3, 4): "AUTO", (5, 6): "AMBIGUOUS", (7, 8): "AMBIGUOUS", (7, 9): "AMBIGUOUS"}
