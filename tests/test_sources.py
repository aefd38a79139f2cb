import os

from pyspark.sql import functions as F

from spindrift.sources import parameters as P
from spindrift.sources import schemas, sinks, synth, tables, workdir

SF = "/root/testdata/sf0.001"


def near(share, wanted, n):
    return abs(share - wanted) < 4 * (wanted * (1 - wanted) / n) ** 0.5


def test_generated_members_follow_the_weights(spark):
    n = 20000
    df = synth.members(spark, n, "2024-06-01")
    assert not schemas.missing_columns(df, schemas.MEMBERS)
    tiers = {r[0]: r[1] / n for r in df.groupBy("membership_tier").count().collect()}
    for tier, share in {"Platinum": 0.05, "Gold": 0.10, "Silver": 0.15, "Bronze": 0.20, "Basic": 0.50}.items():
        assert near(tiers[tier], share, n)
    ages = df.agg(F.min("age"), F.max("age"), F.min("lifetime_spend"), F.max("total_cruises")).first()
    assert (ages[0], ages[1], ages[3]) == (21, 80, 20) and ages[2] >= 1000
    assert schemas.unlisted_values(df, schemas.MEMBER_ENUMS).count() == 0
    assert df.exceptAll(synth.members(spark, n, "2024-06-01").repartition(13)).count() == 0


def test_generated_sessions(spark):
    n = 20000
    df = synth.plays(spark, n, 500, "2024-06-01")
    assert schemas.duplicate_keys(df, ["play_id"]).count() == 0
    assert schemas.orphans(df, synth.members(spark, 500, "2024-06-01"), "member_id").count() == 0
    times = {r[0]: r[1] / n for r in df.groupBy("time_of_day").count().collect()}
    for label, share in {"Morning": 0.1, "Afternoon": 0.225, "Evening": 0.371, "Night": 0.304}.items():
        assert near(times[label], share, n)
    assert df.where("total_wagered <> num_spins * bet_per_spin * denomination").count() == 0
    assert df.where("net_result <> total_won - total_wagered").count() == 0
    assert df.where("total_won > 1.1 * total_wagered + 0.01 or total_won < 0.85 * total_wagered - 0.01").count() == 0


def test_weights_add_up_to_a_hundred(spark):
    sums = P.ship_weights(spark).groupBy("ship_name").agg(F.sum("weight").alias("w")).collect()
    assert len(sums) == 8 and all(r["w"] == 100 for r in sums)


def test_writers(spark, tmp_path):
    one, two = (spark.range(n).withColumn("k", F.col("id") % 2) for n in (5, 3))
    path = str(tmp_path / "t")
    assert sinks.replace_table(one, path, ["k"]).count() == 5
    assert sinks.snapshot_once(two, path).count() == 5
    assert sinks.append(two, str(tmp_path / "a")).count() == 3
    assert sinks.append(two, str(tmp_path / "a")).count() == 6
    assert sinks.refresh(two, path).count() == 3
    assert sinks.create_view(spark, two, "v_two").count() == 3
    assert sinks.rows_as_json(two.where("id = 1")).first()[0] == '{"id":1,"k":1}'


def test_shared_folder_comes_from_the_session(spark, tmp_path, monkeypatch):
    # the real setting is fixed at session start; any session setting behaves the same
    monkeypatch.setattr(workdir, "SETTING", "spindrift.test.dir")
    spark.conf.set(workdir.SETTING, str(tmp_path))
    try:
        assert workdir.shared_dir(spark) == str(tmp_path)
        stored = workdir.materialise(spark.range(4), "x")
        assert stored.count() == 4 and any(n.startswith("x-") for n in os.listdir(tmp_path))
    finally:
        spark.conf.unset(workdir.SETTING)


def test_views_have_the_declared_types(spark):
    assert not schemas.missing_columns(tables.members(spark, SF), schemas.MEMBERS)
    wanted = [f for f in schemas.PLAYS.fields if f.name != "play_id"]
    actual = {f.name: f.dataType for f in tables.plays(spark, SF).schema.fields}
    assert all(actual[f.name] == f.dataType for f in wanted)
    plays = tables.plays(spark, SF)
    tables.register_views(spark, SF)
    assert spark.sql("SELECT count(*) FROM slot_play_history").first()[0] == plays.count()
