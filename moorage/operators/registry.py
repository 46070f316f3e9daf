"""A model registry kept as tables: versions, metrics, parameters and importances."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorage.operators.models import Fitted

_MODELS = """name string, version int, path string, kind string, label string, start_time timestamp_ntz,
end_time timestamp_ntz, features array<string>, features_number int, remove_outliers boolean,
scaling boolean, params map<string,string>"""
_METRICS = "name string, version int, metric string, value double"
_IMPORTANCES = "name string, version int, feature string, importance double"


@dataclass(frozen=True)
class ModelInfo:
    """What is kept about the training of a model; the feature count follows the feature list."""

    start_time: datetime
    end_time: datetime
    features: list[str]
    features_number: int | None = None
    remove_outliers: bool = False
    scaling: bool = False

    def __post_init__(self):
        if self.features_number is None:
            object.__setattr__(self, "features_number", len(self.features))


def newest_versions(models: DataFrame) -> DataFrame:
    """Highest version number per model name, compared as numbers."""
    number = F.col("version").cast("int")
    return models.groupBy("name").agg(F.max(number).alias("version"), F.count(F.lit(1)).alias("versions"))


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    path, files = _file_system(spark, folder)
    if not files.exists(path):
        return []
    names = [f.getPath().getName() for f in files.listStatus(path)]
    return [n for n in names if not n.startswith(".")]


def _made(spark: SparkSession, path: str) -> bool:
    """Make an empty file; false where it was there already. Of several that try, one makes it."""
    hadoop, files = _file_system(spark, path)
    files.mkdirs(hadoop.getParent())
    if files.getUri().getScheme() == "file":
        # Hadoop's local file system looks first and writes then; the operating system does both at once.
        try:
            os.close(os.open(hadoop.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True
    try:
        files.create(hadoop, False).close()
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in str(error.java_exception):
            raise
        return False
    return True


class Registry:
    """Tables and model files under one folder all executors see.

    The row in ``models`` is written last: a version without it does not exist.  Several jobs may write at a time, also
    under one name: a job claims the version it writes by making a file that nobody made before.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        hadoop, files = _file_system(self.spark, path)
        if not files.exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def models(self) -> DataFrame:
        return self._table("models", _MODELS)

    def metrics(self) -> DataFrame:
        return self._table("metrics", _METRICS)

    def importances(self) -> DataFrame:
        return self._table("importances", _IMPORTANCES)

    def _claim(self, name: str) -> int:
        """The next version of a name, which no other writer has or will get.

        Claims of jobs that died are not given again, so version numbers may have gaps.
        """
        folder = f"{self.root}/claims/{name}"
        known = newest_versions(self.models().where(F.col("name") == name)).first()
        version = 1 + max([known["version"] if known else 0, *map(int, _names(self.spark, folder))])
        while not _made(self.spark, f"{folder}/{version}"):
            version += 1
        return version

    def append(
        self, fitted: Fitted, *, info: ModelInfo, metrics: dict[str, float | None], importances: DataFrame
    ) -> int:
        """Store a fitted pipeline, scaler included, as the next version of its name."""
        version = self._claim(fitted.name)
        path = f"{self.root}/artifacts/{fitted.name}/{version}"
        fitted.pipeline.write().save(path)
        values = [(fitted.name, version, m, v) for m, v in metrics.items()]
        self._put("metrics", fitted.name, version, self.spark.createDataFrame(values, _METRICS))
        self._put("importances", fitted.name, version, importances)
        row = (
            fitted.name,
            version,
            path,
            fitted.kind,
            fitted.label,
            info.start_time,
            info.end_time,
            info.features,
            info.features_number,
            info.remove_outliers,
            info.scaling,
            {k: json.dumps(v) for k, v in fitted.params.items()},
        )
        self._put("models", fitted.name, version, self.spark.createDataFrame([row], _MODELS))
        return version

    def _put(self, table: str, name: str, version: int, rows: DataFrame) -> None:
        """Write the rows of one version as a partition, so that a repeated attempt replaces them."""
        kept = [c for c in rows.columns if c not in ("name", "version")]
        where = f"{self.root}/{table}/name={name}/version={version}"
        rows.select(*kept).coalesce(1).write.mode("overwrite").parquet(where)

    def find(self, name: str, version: str | int = "latest"):
        """The registered row of a model.

        A name with a single version answers whatever was asked; otherwise 'latest' or a number,
        which may come as text.
        """
        rows = self.models().where(F.col("name") == name)
        known = newest_versions(rows).first()
        if known is None:
            raise ValueError(f"model {name!r} not found")
        wanted = known["version"] if known["versions"] == 1 or version == "latest" else int(version)
        found = rows.where(F.col("version") == wanted).first()
        if found is None:
            raise ValueError(f"version {version} of model {name!r} not found")
        return found

    def load(self, name: str, version: str | int = "latest") -> tuple[PipelineModel, list[str]]:
        """(pipeline, features in training order)."""
        row = self.find(name, version)
        stages = PipelineModel.load(row["path"])
        return stages, [f for f in row["features"] if f != row["label"]]
