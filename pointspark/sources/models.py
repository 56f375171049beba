"""Model configurations and the model catalogue."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.functions.scalar import model_block, model_is_efficient, model_resolution_cm, model_url


@dataclass
class ModelConfig:
    """A model's block and resolution; three positive values of ``custom_resolution`` replace the configured ones."""

    size: tuple[int, int, int]
    resolution: tuple[float, float, float]
    num_classes: int = 2
    kind: str = ""
    title: str = ""
    extra: dict = field(default_factory=dict)

    def with_resolution(self, custom: tuple[float, float, float] | None) -> ModelConfig:
        use = custom is not None and all(c > 0 for c in custom)
        return ModelConfig(self.size, tuple(custom) if use else self.resolution, self.num_classes, self.kind, self.title, self.extra)


def parse_config(text: str) -> ModelConfig:
    """Raises ``ValueError`` on a configuration without a block or a resolution; classes default to 2."""
    try:
        raw = json.loads(text)
        model = dict(raw["model"])
        size, resolution = tuple(model.pop("voxel_number_in_block")), tuple(model.pop("voxel_resolution_in_meter"))
    except (KeyError, TypeError, json.JSONDecodeError) as e:
        raise ValueError(f"bad model configuration: {e!r}") from e
    return ModelConfig(size, resolution, int(model.pop("num_classes", 2)), model.pop("type", ""), raw.get("title", ""), model)


def read_config(spark: SparkSession, path: str) -> ModelConfig:
    """From any store that Spark reads; a configuration is one small document."""
    return parse_config("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).limit(1).collect()))


def load_weights(spark: SparkSession, path: str, most: int = 1 << 30) -> bytes:
    """A network's file, from any store that Spark reads; ``ValueError`` beyond ``most`` bytes."""
    files = spark.read.format("binaryFile").load(path)
    found = files.select("length").limit(2).collect()
    if len(found) != 1 or found[0]["length"] > most:
        raise ValueError(f"{path} must be one file of at most {most} bytes")
    return bytes(files.select("content").first()["content"])


def model_catalog(spark: SparkSession, names: list[str], downloaded: set[str] = frozenset(), base_url: str = "") -> DataFrame:
    """``name, downloaded, resolution_cm, block, efficient, url`` per model."""
    rows = spark.createDataFrame([(n, n in downloaded) for n in names], "name string, downloaded boolean")
    n = F.regexp_replace("name", r"\(.*$", "")
    return rows.select("name", "downloaded", model_resolution_cm(n).alias("resolution_cm"), model_block(n).alias("block"), model_is_efficient(F.col("name")).alias("efficient"), model_url(base_url, F.col("name")).alias("url"))
