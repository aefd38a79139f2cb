"""Stored models: a fresh folder for every version, made visible by one manifest that is written last.

Readers only list manifests, so a writer that dies leaves nothing behind that anyone would load, and
storing a version again never touches what is published. A manifest may carry the fingerprint of the
training input, by which a query finds the model that was fitted on these very rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.ml.boosting import Boosted
from spindrift.ml.forest import Forest
from spindrift.sources import workdir

MANIFEST = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("comment", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("signature", T.StringType()),
        T.StructField("saved_at", T.TimestampType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("path", T.StringType()),
    ]
)
FOREST, BOOSTED = "forest", "boosted"
Model = Forest | Boosted


@dataclass(frozen=True)
class Fit:
    """What is stored of a fit."""

    model: Model
    sample: DataFrame
    metrics: Mapping[str, float] | None = None
    comment: str = ""


def _write_model(spark: SparkSession, model: Model, path: str) -> str:
    if isinstance(model, Boosted):
        spark.createDataFrame([(bytearray(model.to_bytes()),)], "model binary").coalesce(1).write.parquet(path)
        return BOOSTED
    parts = [(i, bytearray(p)) for i, p in enumerate(model.to_parts())]
    spark.createDataFrame(parts, "part int, model binary").write.parquet(path)
    return FOREST


def _read_model(spark: SparkSession, kind: str, path: str) -> Model:
    if kind == BOOSTED:
        return Boosted.from_bytes(bytes(spark.read.parquet(path).first()["model"]))
    parts = spark.read.parquet(path).collect()
    return Forest.from_parts([bytes(r["model"]) for r in sorted(parts, key=lambda r: r["part"])])


def _write_manifest(spark: SparkSession, path: str, entry: dict) -> None:
    """A hidden file first, then its name: readers see a whole manifest or none."""
    folder, _, name = path.rpartition("/")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    part, final = hadoop(f"{folder}/_{name}"), hadoop(path)
    files = final.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(part)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    if not files.rename(part, final):
        raise OSError(f"cannot publish {path}")


def save(
    model: Model,
    root: str,
    name: str,
    version: str,
    sample: DataFrame,
    metrics: Mapping[str, float] | None = None,
    comment: str = "",
    fingerprint: str = "",
) -> None:
    """Write the model to a folder of its own, then publish it. The signature is the schema of a sample input."""
    spark = sample.sparkSession
    key = uuid.uuid4().hex
    path = f"{root}/models/{name}/{key}"
    kind = _write_model(spark, model, path)
    entry = {
        "name": name,
        "version": version,
        "comment": comment,
        "metrics": {k: float(v) for k, v in (metrics or {}).items() if v is not None},
        "signature": json.dumps({f.name: f.dataType.simpleString() for f in sample.schema.fields}),
        "saved_at": datetime.now(timezone.utc).isoformat(timespec="microseconds"),
        "fingerprint": fingerprint,
        "kind": kind,
        "path": path,
    }
    _write_manifest(spark, f"{root}/manifests/{key}.json", entry)


def _manifests(spark: SparkSession, root: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifests")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{root}/manifests")


def versions(spark: SparkSession, root: str) -> DataFrame:
    """Newest record of every published (name, version)."""
    rest = [c for c in MANIFEST.names if c not in ("name", "version")]
    newest = F.max_by(F.struct(*rest), F.struct("saved_at", "path"))
    return _manifests(spark, root).groupBy("name", "version").agg(newest.alias("r")).select("name", "version", "r.*")


def load(root: str, name: str, version: str) -> Model:
    spark = SparkSession.getActiveSession()
    found = versions(spark, root).where((F.col("name") == name) & (F.col("version") == version)).first()
    if found is None:
        raise LookupError(f"no published model {name} {version}")
    return _read_model(spark, found["kind"], found["path"])


def mark(df: DataFrame) -> str:
    """Schema, count and two sums of row hashes of an input, for several fits on it."""
    row = F.struct("*")
    sums = [F.sum(h.cast("decimal(20,0)")).cast("string") for h in (F.xxhash64(row), F.hash(row))]
    return json.dumps([df.schema.simpleString(), *map(str, df.agg(F.count("*"), *sums).first())])


def fingerprint(inputs: Sequence[DataFrame | str], settings: object) -> str:
    """Digest of the inputs (frames, or their marks) and the settings of a fit."""
    marks = [repr(settings), *[df if isinstance(df, str) else mark(df) for df in inputs]]
    return hashlib.sha256("\n".join(marks).encode()).hexdigest()


def shared_root(spark: SparkSession) -> str:
    return f"{workdir.shared_dir(spark)}/model-store"


def fitted(spark: SparkSession, name: str, inputs: Sequence[DataFrame | str], settings: object, fit: Callable[[], Fit], root: str | None = None) -> Model:
    """The published model of this name that was fitted on these inputs with these settings; it is
    fitted and published first if there is none, so changed rows under the same path are seen."""
    root = root or shared_root(spark)
    key = fingerprint(inputs, settings)
    same = (F.col("name") == name) & (F.col("fingerprint") == key)
    found = versions(spark, root).where(same).orderBy(F.desc("saved_at")).first()
    if found is not None:
        return _read_model(spark, found["kind"], found["path"])
    made = fit()
    save(made.model, root, name, key[:12], made.sample, made.metrics, made.comment, key)
    return made.model
