"""Training, scoring, generation, sinks and the streaming index.

Every model has the documented production size, and training reads the whole tables.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from spindrift.functions.numeric import round_half_up
from spindrift.ml import estimators as E
from spindrift.ml import multi_output, scoring, store, train
from spindrift.operators import evaluation
from spindrift.plans import mix, voyage
from spindrift.registry.base import query, rounded, with_views
from spindrift.registry.marts import AS_OF, DAILY, MIX_SQL, daily_mart, encoded, win_rate_training
from spindrift.sources import parameters as P
from spindrift.sources import sinks, synth, tables, workdir
from spindrift.streaming import index_refresh

def sessions_once(spark, sf):
    """The sessions, joined and written once for the marks and the scores of a query."""
    return workdir.materialise(tables.plays(spark, sf), "sessions")


def sides_once(spark, sf, plays):
    """Every session as the session forest needs it, with its side of the split, written once."""
    return workdir.materialise(train.session_sides(train.session_rows(plays, tables.members(spark, sf)), list(tables.PLAY_KEY)), "session-sides")


def input_marks(spark, sf, plays=None):
    """Marks of the sessions and the members, for queries that need several models of them."""
    return [store.mark(tables.plays(spark, sf) if plays is None else plays), store.mark(tables.members(spark, sf))]


def encoded_once(spark, sf, plays=None):
    """The encoded members, written once for all fits and scores of a query."""
    return workdir.materialise(encoded(spark, sf, plays), "encoded")


def session_model(spark, sf, marks, sessions=None):
    """The stored session forest of the sessions and members with these marks; fitted first if there is none.

    The trees draw by the place of a row, so without ``sessions`` the fit joins the tables itself.
    """

    def fit():
        rows = train.session_rows(tables.plays(spark, sf), tables.members(spark, sf)) if sessions is None else sessions
        return store.Fit(train.session_fit(rows, list(tables.PLAY_KEY), E.FOREST), rows, comment="forest on session context")

    return store.fitted(spark, "session_denomination", marks, E.FOREST, fit)


def member_model(spark, sf, target, algorithm, rows=None, marks=None):
    """A stored model of the encoded members (``rows``, if they are at hand); fitted first if there is none."""
    trees = E.BOOSTED if algorithm == "boosted" else E.FOREST
    rows = encoded(spark, sf) if rows is None else rows
    inputs = marks or [tables.plays(spark, sf), tables.members(spark, sf)]

    def fit():
        return store.Fit(train.member_fit(rows, target, algorithm, trees), rows, comment=f"{algorithm} on member features")

    return store.fitted(spark, f"member_{target}_{algorithm}", inputs, trees, fit)


def win_rate_model(spark, sf, rows=None, marks=None):
    rows = win_rate_training(spark, sf) if rows is None else rows
    return store.fitted(spark, "ship_win_rate", marks or [tables.plays(spark, sf)], E.FOREST, lambda: store.Fit(train.win_rate_fit(rows, E.FOREST), rows, comment="forest on ship days"))


def win_rate_regression_model(spark, sf):
    rows = win_rate_training(spark, sf)
    return store.fitted(spark, "ship_win_rate_regression", [tables.plays(spark, sf)], E.BOOSTED, lambda: store.Fit(train.win_rate_regression_fit(rows, E.BOOSTED), rows, comment="boosting on ship days"))


def voyages(spark, sf):
    return voyage.training(tables.plays(spark, sf), tables.members(spark, sf), mix.Groups())


def voyage_model(spark, sf):
    inputs = [tables.plays(spark, sf), tables.members(spark, sf)]

    def fit():
        rows = workdir.materialise(voyages(spark, sf), "voyages")
        return store.Fit(train.voyage_fit(rows, E.BOOSTED), rows, comment="boosting on voyages")

    return store.fitted(spark, "voyage_profit", inputs, E.BOOSTED, fit)


def demand_model(spark, sf, rows):
    """Demand shares of all denominations, of all ships and without each of them."""
    return store.fitted(spark, "bank_demand", [rows], E.DEMAND_BOOSTED, lambda: store.Fit(multi_output.fit(rows, E.DEMAND_BOOSTED, "ship_name"), rows, comment="boosting on ship months"))


@query("ml06_forest_session_denomination")
def forest_confusion(spark, sf):
    plays = sessions_once(spark, sf)
    model = session_model(spark, sf, input_marks(spark, sf, plays))
    scored = train.session_test(model, train.session_rows(plays, tables.members(spark, sf)), list(tables.PLAY_KEY))
    return evaluation.confusion(scored, "denomination", "predicted")


@query("ml07_boosted_bet_category")
def boosted_bet(spark, sf):
    scored = train.member_test(member_model(spark, sf, "bet", "boosted"), encoded(spark, sf), "bet")
    return evaluation.confusion(scored, "target", "predicted")


@query("ml08_win_rate_classifier")
def win_rate_confusion(spark, sf):
    scored = train.win_rate_test(win_rate_model(spark, sf), win_rate_training(spark, sf))
    return evaluation.confusion(scored, "win_rate_category", "predicted")


@query("ml09_voyage_profit_regression")
def voyage_regression(spark, sf):
    scored = train.voyage_test(voyage_model(spark, sf), voyages(spark, sf))
    return evaluation.regression_metrics(scored, "total_profit", "prediction", by=("ship_name",))


@query("ml10_win_rate_regression")
def win_rate_regression(spark, sf):
    scored = train.win_rate_regression_test(win_rate_regression_model(spark, sf), win_rate_training(spark, sf))
    return evaluation.regression_metrics(scored, "win_rate_pct", "prediction", by=("ship_name",))


def _monthly_demand(spark, sf):
    rows = multi_output.monthly_demand(tables.plays(spark, sf, games=False), tables.members(spark, sf))
    return workdir.materialise(rows, "monthly-demand")


@query("ml11_demand_shares")
def demand_shares(spark, sf):
    rows = _monthly_demand(spark, sf)
    return multi_output.predict(demand_model(spark, sf, rows), rows, ["ship_name", "month"])


@query("ml12_leave_one_ship_out")
def leave_one_ship_out(spark, sf):
    rows = _monthly_demand(spark, sf)
    folds = multi_output.leave_one_group_out(demand_model(spark, sf, rows), rows, "ship_name")
    return evaluation.regression_metrics(
        multi_output.errors_by_target(folds), "actual", "predicted", by=("target",)
    )


@query("ml14_feature_importance")
def feature_importance(spark, sf):
    model = member_model(spark, sf, "bet", "forest")
    return E.importance(model)


@query("top05_important_features")
def important_features(spark, sf):
    model = member_model(spark, sf, "bet", "forest")
    return E.importance(model).limit(15)


@query("ml15_test_predictions")
def test_predictions(spark, sf):
    rows = encoded_once(spark, sf)
    scored = train.member_test(member_model(spark, sf, "denomination", "forest", rows), rows, "denomination")
    return scored.select("member_id", "target", "predicted")


@query("ml16_class_probabilities")
def class_probabilities(spark, sf):
    rows = encoded_once(spark, sf)
    model = member_model(spark, sf, "denomination", "forest", rows)
    scored = train.member_test(model, rows, "denomination")
    return E.probabilities(scored, "member_id", E.labels_of(model))


@query("ml17_score_members")
def score_members(spark, sf):
    rows, marks = encoded_once(spark, sf), input_marks(spark, sf)
    models = {t: member_model(spark, sf, t, "forest", rows, marks) for t in ("denomination", "bet")}
    ids = tables.read(spark, sf, "events").select(F.col("user_id").alias("member_id")).distinct()
    return scoring.score_members(models, rows, ids)


@query("ml18_score_members_in_context")
def score_in_context(spark, sf):
    plays = sessions_once(spark, sf)
    model = session_model(spark, sf, input_marks(spark, sf, plays))
    ids = tables.read(spark, sf, "events").select(F.col("user_id").alias("member_id")).distinct()
    return scoring.score_members_in_context(
        model,
        tables.members(spark, sf),
        plays,
        ids,
        AS_OF,
        list(tables.PLAY_KEY),
        "STANDARD",
    )


@query("ml19_what_if")
def what_if(spark, sf):
    """Every combination of ship, game type and tier that occurs, for its average guest."""
    plays = sessions_once(spark, sf)
    model = session_model(spark, sf, input_marks(spark, sf, plays))
    keys = ["ship_name", "game_type", "membership_tier", "gender", "risk_appetite", "income_bracket"]
    rows = train.session_rows(plays, tables.members(spark, sf))
    requests = rows.groupBy(*keys).agg(
        F.max("play_month").alias("play_month"),
        F.max("dow_mon0").alias("dow_mon0"),
        F.max("is_weekend").alias("is_weekend"),
        F.round(F.avg("age")).alias("age"),
        F.round(F.avg("total_cruises")).alias("total_cruises"),
    )
    named = requests.withColumn("request_id", F.concat_ws("|", *keys))
    return scoring.score_what_if(model, named, "request_id").select("request_id", "predicted")


def _ship_day_requests(spark, sf):
    return (
        daily_mart(spark, sf)
        .groupBy("ship_name", "dow_sun0")
        .agg(F.max("sessions").alias("sessions"), F.max("unique_players").alias("unique_players"))
        .withColumn("request_id", F.concat_ws(":", "ship_name", F.col("dow_sun0").cast("string")))
    )


@query(
    "ml20_ship_day_features",
    DAILY
    + f""", r AS (SELECT ship_name, dow_sun0, max(sessions) AS sessions, max(unique_players) AS unique_players FROM daily GROUP BY ALL)
    SELECT ship_name || ':' || dow_sun0 AS request_id, CAST(ascii(right(ship_name, 1)) - 65 AS INTEGER) AS ship_encoded,
      CAST(month(DATE '{AS_OF}') AS INTEGER) AS month_num, sessions, unique_players,
      {rounded('sessions * 250.0::DOUBLE * 4.2::DOUBLE * 0.5::DOUBLE', 4)} AS daily_wagered,
      round(sessions * 0.3::DOUBLE) AS night_sessions, round(sessions * 0.37::DOUBLE) AS evening_sessions,
      round(sessions * 0.25::DOUBLE) AS progressive_sessions FROM r""",
)
def ship_day_features(spark, sf):
    rows = scoring.ship_day_features(_ship_day_requests(spark, sf), AS_OF)
    return rows.select(
        "request_id",
        "ship_encoded",
        "month_num",
        "sessions",
        "unique_players",
        round_half_up(F.col("daily_wagered"), 4).alias("daily_wagered"),
        "night_sessions",
        "evening_sessions",
        "progressive_sessions",
    )


@query("ml20_score_ship_days")
def score_ship_days(spark, sf):
    model = win_rate_model(spark, sf)
    return scoring.score_ship_days(model, _ship_day_requests(spark, sf), AS_OF)


# --- generation: one generated row per row of an input table --------------------------------


@query("gen01_members")
def generated_members(spark, sf):
    ids = tables.members(spark, sf).select(F.col("member_id").alias("id"))
    return synth.member_rows(ids, AS_OF)


@query("gen02_sessions")
def generated_sessions(spark, sf):
    ids = tables.read(spark, sf, "lineitem").select(
        F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("id")
    )
    return synth.play_rows(ids, tables.members(spark, sf).count(), AS_OF)


# --- sinks: written to the shared folder and read back --------------------------------------

_SHIP_MONTHS = """SELECT ship_name, CAST(date_trunc('month', play_date) AS DATE) AS month, count(*) AS sessions
  FROM plays GROUP BY ALL"""


def _ship_months(spark, sf):
    return (
        tables.plays(spark, sf, games=False)
        .groupBy("ship_name", F.trunc("play_date", "MM").alias("month"))
        .agg(F.count("*").alias("sessions"))
    )


@query("snk01_replace_table", with_views("plays") + _SHIP_MONTHS)
def replace_table(spark, sf):
    path = workdir.fresh_path(spark, "replace")
    return sinks.replace_table(_ship_months(spark, sf), path, ["ship_name"])


@query("snk02_snapshot_once", with_views("plays") + _SHIP_MONTHS)
def snapshot_once(spark, sf):
    path = workdir.fresh_path(spark, "snapshot")
    rows = _ship_months(spark, sf)
    sinks.snapshot_once(rows, path)
    return sinks.snapshot_once(rows.where("sessions < 0"), path)


@query("snk03_append", with_views("plays") + f"SELECT * FROM ({_SHIP_MONTHS}) UNION ALL SELECT * FROM ({_SHIP_MONTHS})")
def append_rows(spark, sf):
    path = workdir.fresh_path(spark, "append")
    rows = _ship_months(spark, sf)
    sinks.append(rows, path)
    return sinks.append(rows, path)


@query("snk04_refresh", with_views("plays") + f"SELECT * FROM ({_SHIP_MONTHS}) WHERE sessions > 10")
def refresh(spark, sf):
    path = workdir.fresh_path(spark, "refresh")
    rows = _ship_months(spark, sf)
    sinks.refresh(rows, path)
    return sinks.refresh(rows.where("sessions > 10"), path)


@query("snk06_view", with_views("plays") + "SELECT ship_name, count(*) AS sessions FROM plays GROUP BY ship_name")
def view(spark, sf):
    sinks.create_view(spark, tables.plays(spark, sf), "slot_play_history")
    return spark.sql("SELECT ship_name, count(*) AS sessions FROM slot_play_history GROUP BY ship_name")


# --- streaming -------------------------------------------------------------------------------


@query(
    "ret04_refreshed_index",
    r"""WITH toks AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents)
    SELECT doc_id, count(DISTINCT term) AS terms, count(*) AS occurrences FROM toks WHERE term <> '' GROUP BY doc_id""",
)
def refreshed_index(spark, sf):
    """The index as the file stream builds it from the documents table."""
    path = workdir.fresh_path(spark, "index")
    raw = tables.read(spark, sf, "documents").schema

    def as_policies(df):
        return df.select(
            F.col("doc_id").alias("policy_id"),
            F.col("lang").alias("category"),
            F.col("source").alias("title"),
            F.col("text").alias("content"),
            *[c for c in df.columns if c == index_refresh.ARRIVED],
        )

    stream = index_refresh.start(
        spark, f"{sf}/documents*.parquet", raw, f"{path}/data", f"{path}/progress", prepare=as_policies
    )
    stream.awaitTermination()
    index = index_refresh.read_index(spark, f"{path}/data")
    return index.postings.groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("occurrences"))


@query(
    "ret04_changed_and_withdrawn",
    r"""WITH kept AS (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN text || ' amended' ELSE text END AS text FROM documents WHERE doc_id % 3 <> 2),
    toks AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM kept)
    SELECT doc_id, count(DISTINCT term) AS terms, count(*) AS occurrences,
      CASE WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END AS written_in FROM toks WHERE term <> '' GROUP BY doc_id""",
)
def changed_and_withdrawn(spark, sf):
    """All documents come again: a third unchanged, a third amended and a third withdrawn."""
    path = workdir.fresh_path(spark, "index")
    docs = tables.policies(spark, sf)
    index_refresh.apply_batch(docs, 0, path)
    kind = F.col("policy_id") % 3
    again = docs.withColumns({"content": F.when(kind == 1, F.concat("content", F.lit(" amended"))).otherwise(F.col("content")), "withdrawn": kind == 2})
    index_refresh.apply_batch(again, 1, path)
    written = spark.read.schema(index_refresh.POSTINGS).parquet(f"{path}/postings").groupBy("doc_id").agg(F.max("batch").cast("int").alias("written_in"))
    index = index_refresh.read_index(spark, path)
    counted = index.postings.groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("occurrences"))
    return counted.join(written, "doc_id")


# --- label codes, model versions, profile joins and row exports ------------------------------


@query(
    "ml01_label_codes",
    with_views("plays")
    + """, s AS (SELECT ship_name AS label, dense_rank() OVER (ORDER BY ship_name) - 1 AS code FROM (SELECT DISTINCT ship_name FROM plays)),
    d AS (SELECT denomination, dense_rank() OVER (ORDER BY denomination) - 1 AS code FROM (SELECT DISTINCT denomination FROM plays))
    SELECT 'ship_name' AS column_name, p.ship_name AS label, CAST(s.code AS DOUBLE) AS code, count(*) AS sessions
      FROM plays p JOIN s ON s.label = p.ship_name GROUP BY ALL
    UNION ALL SELECT 'denomination', CAST(p.denomination AS VARCHAR), CAST(d.code AS DOUBLE), count(*)
      FROM plays p JOIN d USING (denomination) GROUP BY ALL""",
)
def label_codes(spark, sf):
    """Codes as the models use them: ships alphabetically, denominations by value."""
    from pyspark.ml.feature import StringIndexer, StringIndexerModel

    rows = tables.plays(spark, sf).select("ship_name", F.col("denomination").cast("string").alias("price"))
    ships = StringIndexer(inputCol="ship_name", outputCol="ship_code", stringOrderType="alphabetAsc", handleInvalid="keep").fit(rows)
    prices = StringIndexerModel.from_labels(
        E.class_labels(rows, "price", numeric=True), inputCol="price", outputCol="price_code", handleInvalid="keep"
    )
    coded = prices.transform(ships.transform(rows))
    pairs = F.array(
        F.struct(F.lit("ship_name").alias("column_name"), F.col("ship_name").alias("label"), F.col("ship_code").alias("code")),
        F.struct(F.lit("denomination").alias("column_name"), F.col("price").alias("label"), F.col("price_code").alias("code")),
    )
    counted = coded.groupBy("ship_name", "ship_code", "price", "price_code").agg(F.count("*").alias("n"))
    return (
        counted.select("n", F.explode(pairs).alias("p"))
        .groupBy("p.column_name", "p.label", "p.code")
        .agg(F.sum("n").alias("sessions"))
    )


@query("snk09_model_versions")
def model_versions(spark, sf):
    """Train, store and list models by name."""
    root = workdir.fresh_path(spark, "model-store")
    inputs = {"win_rate": workdir.materialise(win_rate_training(spark, sf), "win-rate")}
    for version, seed in (("V1", E.FOREST.seed), ("V2", E.FOREST.seed + 1)):
        train.train("win_rate", inputs, root, replace(E.FOREST, seed=seed), version)
    return store.versions(spark, root).select("name", "version", "comment", "signature")


_PROFILE_SQL = (
    with_views("members", "plays")
    + f""", monthly AS (SELECT *, CAST(date_trunc('month', play_date) AS DATE) AS month FROM plays),
    m AS (SELECT ship_name, month, {MIX_SQL} FROM monthly JOIN members USING (member_id) GROUP BY ship_name, month),
    n AS (SELECT ship_name, month, count(DISTINCT member_id) AS unique_players, """
    + ", ".join(
        rounded(f"count(*) FILTER (denomination = {d}) * 100.0::DOUBLE / count(*)", 6) + f" AS {t}"
        for d, t in zip(P.DENOMINATIONS, multi_output.TARGETS, strict=True)
    )
    + " FROM monthly GROUP BY ship_name, month) SELECT * FROM m JOIN n USING (ship_name, month)"
)


@query("jon13_profile_with_shares", _PROFILE_SQL)
def profile_with_shares(spark, sf):
    """Mix, players and all nine demand shares of every ship and month."""
    rows = multi_output.monthly_demand(tables.plays(spark, sf, games=False), tables.members(spark, sf))
    return rows.withColumns({t: round_half_up(F.col(t), 6) for t in multi_output.TARGETS})


@query(
    "src05_rows_as_json",
    with_views("plays")
    + """SELECT '{"ship_name":"' || ship_name || '","sessions":' || count(*) || '}' AS "row" FROM plays GROUP BY ship_name""",
)
def rows_as_json(spark, sf):
    counted = tables.plays(spark, sf).groupBy("ship_name").agg(F.count("*").alias("sessions"))
    return sinks.rows_as_json(counted)


@query(
    "ml05_random_split",
    with_views("members")
    + """SELECT CASE WHEN u < 0.8 THEN 'TRAIN' ELSE 'TEST' END AS split, count(*) AS n FROM (
      SELECT CAST(CAST('0x' || substr(md5('42:' || CAST(member_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
      FROM members) GROUP BY 1""",
)
def random_split(spark, sf):
    from spindrift.functions.numeric import uniform

    drawn = tables.members(spark, sf).select(uniform("member_id", salt="42").alias("u"))
    side = F.when(F.col("u") < 0.8, "TRAIN").otherwise("TEST").alias("split")
    return drawn.groupBy(side).agg(F.count("*").alias("n"))
