"""Models made of other models, saved as plain metadata and one folder per part."""

from __future__ import annotations

import json

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, types as T


def load_any(spark: SparkSession, path: str):
    """The model saved at ``path``, of whatever class its metadata names."""
    return DefaultParamsReader.loadParamsInstance(path, spark)


class Composite(Model, MLWritable, MLReadable):
    """A model with named parts (models, or none), tables, and plain values that JSON can hold.

    A subclass lists them and builds itself from them; saving, loading, nesting and a place in a ``PipelineModel`` come with that.
    """

    def parts(self) -> dict[str, object]:
        return {}

    def plain(self) -> dict:
        return {}

    def tables(self) -> dict[str, DataFrame]:
        """What is too large for the metadata."""
        return {}

    @classmethod
    def rebuilt(cls, parts: dict[str, object], plain: dict) -> Composite:
        return cls(**parts, **plain)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: Composite):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        present = {name: part for name, part in self.instance.parts().items() if part is not None}
        absent = [name for name in self.instance.parts() if name not in present]
        more = {"plain": self.instance.plain(), "present": list(present), "absent": absent,
                "tables": {name: table.schema.json() for name, table in self.instance.tables().items()}}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata=more)
        for name, part in present.items():
            part.write().save(f"{path}/parts/{name}")
        for name, table in self.instance.tables().items():
            table.write.parquet(f"{path}/tables/{name}")


class _Reader(MLReader):
    def __init__(self, cls: type[Composite]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> Composite:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        parts = {name: load_any(self.sparkSession, f"{path}/parts/{name}") for name in meta["present"]}
        tables = {name: self.sparkSession.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(f"{path}/tables/{name}")
                  for name, schema in meta["tables"].items()}
        out = self.cls.rebuilt({**parts, **tables, **dict.fromkeys(meta["absent"])}, meta["plain"])
        out._resetUid(meta["uid"])
        return out
