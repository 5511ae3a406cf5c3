"""Rule engine, id validation (insert and update), stream validation, ingestion."""

import os
import shutil
import tempfile

from pyspark.sql import functions as F

from tessera.operators import quality as Q
from tessera.sources import io
from tessera.streaming.validate import validate_stream


def test_rule_engine_null_passes(spark):
    df = spark.createDataFrame([(1, "Actif", 20), (2, "Bad", None), (3, None, 40)], "id int, s string, age int")
    rules = [Q.in_list("s", ["Actif", "Desactive"]), Q.Rule("age", F.col("age").between(16, 30)),
             *Q.not_null("s")]
    got = {r.rule: r.n_violations for r in Q.check(df, rules, "t").collect()}
    assert got == {"in_list:s": 1, "age": 1, "not_null:s": 1}
    detail = {(r.id, r.rule) for r in Q.violations(df, rules, ["id"]).collect()}
    assert detail == {(2, "in_list:s"), (3, "age"), (3, "not_null:s")}


def test_unique_and_fk(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None)], "k int, v string")
    u = Q.check_unique(df, ["k"], "t").first()
    assert (u.n_duplicate_keys, u.n_rows_in_duplicates) == (1, 2)
    parent = spark.createDataFrame([("a",)], "v string")
    assert Q.check_fk(df, parent, ["v"], ["v"], "t->p").first().n_violations == 1  # NULL child key passes


def test_id_validation_insert_and_update(spark):
    mirror = spark.createDataFrame([("AB1",), ("CD2",)], "cin string")
    rows = spark.createDataFrame([(1, None), (2, "AB1"), (3, "ZZ999999")], "id int, jeune_cin string")
    got = {r.id: (r.accepted, r.message) for r in Q.validate_ids(rows, mirror).collect()}
    assert got[1] == (True, None) and got[2] == (True, None)
    assert got[3] == (False, Q.REJECT_MESSAGE)
    old = spark.createDataFrame([(1, "AB1"), (2, "AB1"), (3, None), (4, "AB1")], "id int, jeune_cin string")
    new = spark.createDataFrame([(1, "AB1"), (2, "XX0"), (3, "CD2"), (4, None)], "id int, jeune_cin string")
    ch = {r.id: r.accepted for r in Q.validate_changes(old, new, "id", mirror).collect()}
    assert ch == {2: False, 3: True}  # unchanged and cleared ids are not checked


def test_stream_validation(spark):
    d = tempfile.mkdtemp(prefix="tessera-test-", dir="/tmp")
    src = os.path.join(d, "in")
    spark.createDataFrame([(1, "AB1"), (2, None), (3, "NOPE")], "id int, jeune_cin string").write.parquet(src)
    mirror = spark.createDataFrame([("AB1",)], "cin string")
    stream = spark.readStream.schema("id int, jeune_cin string").parquet(src)
    ok, ko = validate_stream(spark, stream, mirror, out_dir=os.path.join(d, "out"))
    assert sorted(r.id for r in spark.read.parquet(ok).collect()) == [1, 2]
    rej = spark.read.parquet(ko).collect()
    assert [r.id for r in rej] == [3] and rej[0].message == Q.REJECT_MESSAGE


def test_ingest_rejects_and_positions(spark):
    d = tempfile.mkdtemp(prefix="tessera-test-", dir="/tmp")
    path = os.path.join(d, "extract.csv")
    with open(path, "w") as f:
        f.write("k,price\n1,10.50\n2,abc\n3,7.25\n4,not-a-number\n5,1.00\n")
    good, bad = io.ingest(spark, path, io.T.StructType([io.T.StructField("k", io.T.LongType()),
                                                         io.T.StructField("price", io.T.DecimalType(10, 2))]),
                          header=True)
    assert sorted((r.id, r.k) for r in good.collect()) == [(1, 1), (3, 3), (5, 5)]
    assert sorted(r.id for r in bad.collect()) == [2, 4]


def test_reload_is_idempotent(spark):
    base = tempfile.mkdtemp(prefix="tessera-test-", dir="/tmp")
    t = {"x": spark.range(10).withColumn("v", F.col("id") * 2)}
    io.reload(t, base, "r1")
    io.reload(t, base, "r2")
    assert io.current(spark, base).endswith("r2")
    a, b = spark.read.parquet(f"{base}/r1/x"), spark.read.parquet(f"{base}/r2/x")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_jdbc_options_carry_a_query_as_derived_table():
    from tessera.sources.io import jdbc_read_options
    o = jdbc_read_options("jdbc:x", "SELECT 1", {"partitionColumn": "id", "numPartitions": 4})
    assert o == {"url": "jdbc:x", "partitionColumn": "id", "numPartitions": "4", "dbtable": "(SELECT 1) q"}


def test_reload_moves_to_the_highest_pointer(spark):
    from tessera.sources import io
    base = io.scratch(spark, "pointer")
    for run in ("b", "a"):
        io.reload({"t": spark.range(3)}, base, run)
        assert io.current(spark, base) == f"{base}/{run}"


def test_failed_load_raises_with_its_log(spark):
    import pytest
    from pyspark.sql import functions as F
    from tessera.sources import io
    bad = spark.range(1).withColumn("x", F.raise_error(F.lit("no")))
    with pytest.raises(io.LoadError) as e:
        io.observed_sink(bad, io.scratch(spark, "bad"), "t", "s")
    assert e.value.log.first()["statut"] == "ERREUR"


def test_stream_rejects_events_of_unknown_users(spark):
    import __spark_entry__ as E
    from tests.conftest import SF0001
    d = tempfile.mkdtemp(prefix="tessera-test-", dir="/tmp")
    for f in os.listdir(SF0001):
        if f != "events.parquet":
            os.symlink(os.path.join(SF0001, f), os.path.join(d, f))
    ev = spark.read.parquet(f"{SF0001}/events.parquet")
    few = ev.orderBy("event_id").limit(5)
    lost = few.limit(1).withColumn("event_id", F.lit(-1).cast(ev.schema["event_id"].dataType)) \
        .withColumn("user_id", F.lit(-5).cast(ev.schema["user_id"].dataType))
    none = lost.withColumn("event_id", F.lit(-2).cast(ev.schema["event_id"].dataType)) \
        .withColumn("user_id", F.lit(None).cast(ev.schema["user_id"].dataType))
    parts = tempfile.mkdtemp(prefix="tessera-test-", dir="/tmp")
    few.unionByName(lost).unionByName(none).coalesce(1).write.mode("overwrite").parquet(parts)
    shutil.copy(next(os.path.join(parts, f) for f in os.listdir(parts) if f.endswith(".parquet")), os.path.join(d, "events.parquet"))
    got = {r["event_id"]: r for r in E.queries()["q_stream_cin_validation"](spark, d).collect()}
    assert len(got) == 7
    for i in (-1, -2):
        assert (got[i]["accepted"], got[i]["message"], got[i]["jeune_cin"]) == (False, Q.REJECT_MESSAGE, None)


def test_foreign_keys_are_counted_together_in_one_shuffle(spark):
    parent = spark.createDataFrame([(i, f"k{i}") for i in range(50)], "id long, code string")
    child = spark.createDataFrame([(i, i % 60, None if i % 3 == 0 else f"k{i % 55}", 1) for i in range(600)] + [(900 + i, 7, "k1", 2) for i in range(300)],
                                  "id long, p int, c string, part int")
    grand = spark.createDataFrame([(i, i % 4) for i in (0, 1, 5000, 5001, 5002)], "child_id long, part long")
    empty = parent.limit(0)
    frames = {"parent": parent, "child": child, "grand": grand, "none": empty}
    keys = [Q.ForeignKey("child->parent", "child", ["p"], "parent", ["id"]), Q.ForeignKey("child->code", "child", ["c"], "parent", ["code"]),
            Q.ForeignKey("grand->child", "grand", ["child_id"], "child", ["id"]), Q.ForeignKey("grand->pair", "grand", ["child_id", "part"], "child", ["id", "part"]),
            Q.ForeignKey("child->none", "child", ["p"], "none", ["id"]), Q.ForeignKey("none->parent", "none", ["id"], "parent", ["id"])]
    out = Q.check_fks(frames, keys)
    got = {r["relationship"]: r["n_violations"] for r in out.collect()}
    assert got == {"child->parent": 100, "child->code": sum(1 for i in range(600) if i % 3 and i % 55 >= 50), "grand->child": 3,
                   "grand->pair": 4, "child->none": 900, "none->parent": 0}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Union") == 1
    # one exchange of keys, then one row per parent
    assert sum("hashpartitioning(parent" in x and "key" in x for x in out._jdf.queryExecution().executedPlan().toString().splitlines()) <= 2


def test_foreign_keys_read_lines_joined_once_and_keys_counted_by_column(spark):
    import __spark_entry__ as E
    from tessera.plans.context import Ctx
    from tests.conftest import SF0001
    c = Ctx(spark, SF0001)
    before = {f: getattr(c.stg, f)() for f in ("operation", "solde")}
    kept = Ctx(spark, SF0001).stg
    kept.keep_lines()
    for f, df in before.items():
        assert getattr(kept, f)().dtypes == df.dtypes
        assert sorted(map(tuple, getattr(kept, f)().collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    # offers and regions are small by their making: the facts are not shuffled for them
    assert c.a.fait_operations()._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") >= 3
    plan = E.queries()["q_fk_violations"](spark, SF0001)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("l_partkey" in x or "l_suppkey" in x for x in plan.splitlines() if "Relation [" not in x)
    assert plan.count("Aggregate [_k") >= 25                 # one a relationship of one column
    assert "concat_ws" in plan


def test_foreign_keys_of_hot_and_missing_keys(spark):
    parent = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id int")
    child = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7L WHEN id % 3 = 1 THEN 1L ELSE NULL END AS p", "CAST(id % 2 AS string) AS q")
    two = spark.createDataFrame([(1, "0"), (7, "1")], "p long, q string")
    keys = [Q.ForeignKey("hot", "child", ["p"], "parent", ["id"]), Q.ForeignKey("pair", "child", ["p", "q"], "two", ["p", "q"]),
            Q.ForeignKey("back", "parent", ["id"], "child", ["p"])]
    got = {r["relationship"]: r["n_violations"] for r in Q.check_fks({"parent": parent, "child": child, "two": two}, keys).collect()}
    assert got == {"hot": 1000, "pair": 1000, "back": 1}


def test_stream_of_updates_resumes_and_checks_only_changes(spark, tmp_path):
    import datetime as dt

    from tessera.streaming.validate import validate_updates
    mirror = spark.createDataFrame([("A",), ("B",)], "cin string")
    schema = "event_id long, id long, ts timestamp, known boolean, jeune_cin string"
    at = lambda m: dt.datetime(2001, 1, 1, 0, m)

    def arrive(rows):
        spark.createDataFrame([(e, i, at(e), k, c) for e, i, k, c in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        ok, ko = validate_updates(spark, stream, mirror, f"{tmp_path}/out", known_col="known")
        good = {r.event_id: r.changed for r in spark.read.parquet(ok).collect()}
        bad = {r.event_id: (r.changed, r.message) for r in spark.read.parquet(ko).collect()}
        return good, bad

    # person 1 keeps A, then takes an unknown id; person 2 starts with one that is not in the mirror
    good, bad = arrive([(1, 1, True, "A"), (2, 1, True, "A"), (3, 2, True, "X"), (4, None, False, None), (5, 3, True, None)])
    assert good == {1: True, 2: False, 5: False} and set(bad) == {3, 4} and all(m == Q.REJECT_MESSAGE for _, m in bad.values())
    # after a restart: an event again, an unchanged unknown id that passes unchecked, changes to and from NULL
    good, bad = arrive([(2, 1, True, "A"), (6, 2, True, "X"), (7, 1, True, None), (8, 1, True, "A"), (9, 1, True, "Y"), (10, 3, True, "B")])
    assert good == {1: True, 2: False, 5: False, 6: False, 7: False, 8: True, 10: True}
    assert set(bad) == {3, 4, 9} and bad[9] == (True, Q.REJECT_MESSAGE)
    n = spark.read.parquet(f"{tmp_path}/out/accepted").count() + spark.read.parquet(f"{tmp_path}/out/rejected").count()
    assert n == 10                                                      # each event in one sink


def test_keys_survive_reloads(spark, tmp_path):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "source_id long")
    load = lambda f: {r[0]: r[1] for r in io.load_keys(spark, f, str(tmp_path), "source_id", "k").collect()}
    assert load(ids(10, 30, 20, 20, None)) == {10: 1, 20: 2, 30: 3}
    assert load(ids(5, 10, 25, 30)) == {10: 1, 20: 2, 30: 3, 5: 4, 25: 5}      # 20 has left and keeps its key
    assert load(ids(20, 1)) == {10: 1, 20: 2, 30: 3, 5: 4, 25: 5, 1: 6}
    assert load(ids()) == {10: 1, 20: 2, 30: 3, 5: 4, 25: 5, 1: 6}


def test_log_accumulates_and_keeps_failed_loads(spark, tmp_path):
    import pytest
    df = spark.range(7)
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        passes.add(1)
        yield from batches
    once = df.coalesce(1).mapInArrow(counted, "id long")
    base = str(tmp_path)
    io.observed_sink(once, f"{base}/t", "t", "staging", log_base=base, source_rows=spark.range(9))
    assert passes.value == 1                                            # the frame is computed once
    broken = df.select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(io.LoadError) as failed:
        io.observed_sink(broken, f"{base}/u", "u", "staging", log_base=base)
    assert failed.value.log.first().statut == "ERREUR"
    io.observed_sink(df, f"{base}/t", "t", "staging", log_base=base)
    log = [(r.n, r.nom_table, r.nb_lignes_source, r.nb_lignes_insert, r.statut) for r in io.read_log(spark, base).orderBy("n").collect()]
    assert log == [(1, "t", 9, 7, "OK"), (2, "u", 0, 0, "ERREUR"), (3, "t", 7, 7, "OK")]
    assert io.read_log(spark, f"{base}/none").count() == 0


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    from tessera.plans.q_io import bucketed_profile
    dim = spark.createDataFrame([(i, "F" if i % 2 else "M") for i in range(1, 41)], "beneficiaire_id long, genre string")
    ops = spark.createDataFrame([(i % 30 + 1, 2.5) for i in range(300)], "beneficiaire_id long, montant_reduction double")
    solde = spark.createDataFrame([(i % 7 + 1, 10.0) for i in range(70)], "beneficiaire_id long, credit_initial double")
    t = {n: io.bucketed(df, f"{n}_{os.path.basename(tmp_path).replace('-', '_')}", "beneficiaire_id", 4, str(tmp_path))
         for n, df in (("dim_beneficiaire", dim), ("fait_operations", ops), ("fait_solde", solde))}
    out = bucketed_profile(t)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
    got = {r[0]: tuple(r)[1:] for r in out.collect()}
    assert len(got) == 40 and got[1] == ("F", 10, 25.0, 100.0) and got[40] == ("M", 0, 0.0, 0.0)


def test_unique_keys_of_many_rows_are_counted_in_tasks_by_their_number(spark, monkeypatch):
    from tessera.operators import keys
    monkeypatch.setattr(keys, "TASK_ROWS", 50)
    df = spark.range(1000).select((F.col("id") % 990).alias("k"), F.lit("x").alias("v"))
    got = Q.check_unique(df, ["k"], "t", rows=1000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(k") == 1 and "20)" in plan.split("hashpartitioning(k")[1].splitlines()[0]
    assert (got.first().n_duplicate_keys, got.first().n_rows_in_duplicates) == (10, 20)
    few = Q.check_unique(df, ["k"], "t", rows=100)      # the cores take all of it: left to Spark
    assert "REPARTITION_BY_NUM" not in few._jdf.queryExecution().executedPlan().toString()
    assert few.first().n_duplicate_keys == 10
