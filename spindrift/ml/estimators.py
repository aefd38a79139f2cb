"""Model definitions.

Encoders are part of each model, so scoring always uses the codes of training. Tree
counts and depths are arguments; the defaults are the documented production sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.ml import boosting, forest
from spindrift.ml.boosting import BINS, Boosted, Trees
from spindrift.ml.forest import Forest
from spindrift.sources import workdir

FOREST = Trees(rounds=100, depth=15, min_rows=5)
BOOSTED = Trees(rounds=200, depth=5)
DEMAND_BOOSTED = Trees(rounds=200, depth=4)

# fixed values: inputs of the session-level denomination model
SESSION_CATEGORIES = ("ship_name", "game_type", "gender", "membership_tier", "risk_appetite", "income_bracket")
SESSION_NUMBERS = ("play_month", "dow_mon0", "is_weekend", "age", "total_cruises")
# fixed values: inputs of the voyage profit model
VOYAGE_NUMBERS = (
    "departure_month",
    "departure_dow_sun0",
    "voyage_duration",
    "avg_passenger_age",
    "ratio_male_per_player",
    "ratio_high_tier_per_player",
    "ratio_high_income_per_player",
    "ratio_high_risk_per_player",
    "avg_cruises",
    "avg_lifetime_spend",
    "avg_daily_players",
)


def class_labels(df: DataFrame, label: str, numeric: bool) -> list[str]:
    """Distinct label values in order, as an indexer finds them; numeric labels are ordered as numbers."""
    text = df.select(F.col(label).cast("string").alias("v")).where("v is not null")
    found = list(StringIndexer(inputCol="v", outputCol="code", stringOrderType="alphabetAsc").fit(text).labels)
    return sorted(found, key=float) if numeric else found


def bins(known: Sequence[Sequence[str]]) -> int:
    """Bins for the trees: one per value of the widest category and one for unseen values."""
    return max([BINS, *(len(labels) + 1 for labels in known)])


def prepared(df: DataFrame, categories: Sequence[str], numbers: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Categories as text, numbers as double with NULL replaced by 0."""
    text = [F.col(c).cast("string").alias(c) for c in categories]
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numbers]
    rest = [c for c in keep if c not in categories and c not in numbers]
    return df.select(*text, *values, *rest)


def fit_classifier(
    train: DataFrame,
    label: str,
    categories: Sequence[str] = (),
    numbers: Sequence[str] = (),
    trees: Trees = FOREST,
    numeric_label: bool = False,
) -> Forest:
    """Multiclass forest (``boosting.fit`` is the boosted classifier).

    The training frame is written once to the shared folder, because indexing and split finding
    read it again; each row is stored with the number from which the trees draw.
    """
    rows = prepared(train.withColumn("label_text", F.col(label).cast("string")), categories, numbers, ["label_text"])
    stored = workdir.materialise(rows.withColumn("draw", F.xxhash64(F.monotonically_increasing_id())), f"train-{label}")
    labels = class_labels(stored, "label_text", numeric_label)
    known = []
    if categories:
        codes = [f"{c}_code" for c in categories]
        indexer = StringIndexer(inputCols=list(categories), outputCols=codes, stringOrderType="alphabetAsc", handleInvalid="keep")
        known = [list(found) for found in indexer.fit(stored).labelsArray]
    return forest.fit(stored, "label_text", labels, categories, known, numbers, trees, bins(known))


def apply(model: Forest | Boosted, df: DataFrame, categories: Sequence[str], numbers: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Score a frame: ``predicted`` (class), ``prediction`` and ``probability``, as the model has them;
    ``keep`` columns travel along."""
    if isinstance(model, Boosted):
        scored = boosting.predict(model, df, "_scores")
        kept = [c for c in keep if c not in ("predicted", "prediction", "probability")]
        if model.kind == boosting.SQUARED:
            return scored.select(*kept, F.get("_scores", F.lit(0)).alias("prediction"))
        return _answers(scored, model.outputs, kept)
    clean = df.withColumns(
        {
            **{c: F.col(c).cast("string") for c in categories},
            **{c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers},
        }
    )
    extra = ("predicted", "prediction", "probability")
    return _answers(forest.predict(model, clean, "_scores"), model.outputs, [c for c in keep if c not in extra])


def _answers(scored: DataFrame, outputs: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """The most likely class (the first of equal ones), its code and all probabilities from ``_scores``."""
    best = F.array_position("_scores", F.array_max("_scores")).cast("int")
    names = F.array(*[F.lit(c) for c in outputs])
    return scored.select(*kept, F.element_at(names, best).alias("predicted"), (best - 1).cast("double").alias("prediction"), F.col("_scores").alias("probability"))


def importance(model: Forest | Boosted) -> DataFrame:
    """Feature importance, largest first: each feature's share of what splits have saved."""
    values = list(model.importance().items())
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(values, "feature string, score double").orderBy(F.desc("score"), "feature")


def probabilities(scored: DataFrame, key: str, labels: Sequence[str]) -> DataFrame:
    """One row per key and class with the class probability (missing = 0)."""
    array = F.col("probability")
    if not isinstance(scored.schema["probability"].dataType, T.ArrayType):
        array = vector_to_array("probability")
    cells = F.transform(
        F.array(*[F.lit(x) for x in labels]),
        lambda name, i: F.struct(name.alias("label"), F.coalesce(F.get(array, i), F.lit(0.0)).alias("p")),
    )
    return scored.select(key, F.explode(cells).alias("cell")).select(
        key, F.col("cell.label").alias("label"), F.col("cell.p").alias("probability")
    )


def labels_of(model: Forest | Boosted) -> list[str]:
    return list(model.outputs)
