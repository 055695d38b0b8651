"""Layer catalog and the registry of layer loaders."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, kind string, label string, url string, visible boolean, style map<string,string>"


class Catalog:
    """Catalog rows (id, kind, label, url, visible, ...) with fallbacks."""

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "Catalog":
        """From a {layers: [...]} document; a missing file is an empty catalog."""
        from .sinks import AnalysisException

        try:
            doc = spark.read.schema(f"layers array<struct<{_struct()}>>").option("multiLine", True).json(path)
            return cls(doc.select(F.explode("layers").alias("l")).select("l.*"))
        except AnalysisException:
            return cls(spark.createDataFrame([], SCHEMA))

    def resolve(self, layer_id: str, default: str) -> str:
        row = self.df.where(F.col("id") == layer_id).select("url").limit(1).collect()
        return row[0]["url"] if row and row[0]["url"] else default

    def resolve_all(self, requests: DataFrame) -> DataFrame:
        """``requests`` (id, default_url) with the catalog's url or the default."""
        got = requests.join(self.df.select("id", "url"), "id", "left")
        return got.withColumn("url", F.coalesce("url", "default_url"))


def _struct() -> str:
    return ", ".join(p.strip().replace(" ", ":", 1) for p in SCHEMA.split(", "))


@dataclass
class Layer:
    layer_id: str
    loader: Callable[..., DataFrame]
    transforms: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    meta: dict = field(default_factory=dict)

    def build(self, *args, **kw) -> DataFrame:
        df = self.loader(*args, **kw)
        for t in self.transforms:
            df = df.transform(t)
        return df


class LayerRegistry:
    """Named loaders with their chain of DataFrame transforms."""

    def __init__(self) -> None:
        self.layers: dict[str, Layer] = {}

    def register(self, layer_id: str, loader, transforms=(), meta=None) -> Layer:
        if layer_id in self.layers:
            raise ValueError(f"layer {layer_id} is already registered")
        layer = self.layers[layer_id] = Layer(layer_id, loader, list(transforms), dict(meta or {}))
        return layer

    def build(self, layer_id: str, *args, **kw) -> DataFrame:
        return self.layers[layer_id].build(*args, **kw)

    def describe(self, spark: SparkSession) -> DataFrame:
        rows = [(i, str(l.meta.get("group", "other")), bool(l.meta.get("visible", False))) for i, l in self.layers.items()]
        return spark.createDataFrame(rows, "layer_id string, grp string, visible boolean")
