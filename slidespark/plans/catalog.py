"""The catalog of datasets: one table row per dataset and channel, looked up by name, and the transforms between datasets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidespark.functions.geometry import IDENTITY, Matrix, invert, is_identity


@dataclass
class Dataset:
    key: str
    path: str
    frame: DataFrame
    kind: str = "image"
    channels: list[str] = field(default_factory=list)
    resolution: float = 1.0
    transform: Matrix = IDENTITY
    fixed: bool = False
    scene: int | None = None

    def find_channel(self, name: str) -> int | None:
        """Exact match, else the first channel that contains the name."""
        if name in self.channels:
            return self.channels.index(name)
        return next((k for k, c in enumerate(self.channels) if name in c), None)

    def channel_index(self, name: str) -> int:
        return self.channels.index(name) if name in self.channels else -1

    @property
    def is_identity(self) -> bool:
        return is_identity(self.transform)


def find_channels(names: DataFrame, wanted: str) -> DataFrame:
    """dataset_key, channel_id of the channel called so in each dataset of names (dataset_key, channel_id, name): the exact match,
    else the first that contains it; datasets without one are left out."""
    exact = F.min(F.when(F.col("name") == wanted, F.col("channel_id")))
    part = F.min(F.when(F.col("name").contains(wanted), F.col("channel_id")))
    return names.groupBy("dataset_key").agg(F.coalesce(exact, part).alias("channel_id")).where("channel_id IS NOT NULL")


def dataset_key(path: str, scene: int | None = None) -> str:
    import hashlib

    name = path.rstrip("/").rsplit("/", 1)[-1]
    key = f"{name}-{hashlib.sha1(path.encode()).hexdigest()[:3]}"
    return key if scene is None else f"Scene={scene}; {key}"


class Catalog:
    """Datasets by key, in the order they were added."""

    def __init__(self) -> None:
        self.datasets: dict[str, Dataset] = {}

    def add(self, dataset: Dataset) -> str:
        self.datasets[dataset.key] = dataset
        return dataset.key

    def remove(self, key: str) -> None:
        self.datasets.pop(key, None)

    def remove_path(self, path: str) -> None:
        for key in [k for k, d in self.datasets.items() if d.path == path]:
            del self.datasets[key]

    def for_path(self, path: str) -> list[Dataset]:
        return [d for d in self.datasets.values() if d.path == path]

    def names(self, *kinds: str) -> list[str]:
        return [k for k, d in self.datasets.items() if not kinds or "all" in kinds or d.kind in kinds]

    def channel_names(self, *kinds: str) -> list[str]:
        return [f"{c} | {k}" for k in self.names(*kinds) for c in self.datasets[k].channels]

    def channel(self, full: str) -> tuple[Dataset, int]:
        """Dataset and channel number of 'channel | key'."""
        name, _, key = full.rpartition(" | ")
        return self.datasets[key], self.datasets[key].channels.index(name)

    @property
    def resolution(self) -> float:
        return min((d.resolution for d in self.datasets.values()), default=1.0)

    def channels(self, spark) -> DataFrame:
        """dataset_key, channel_id, name as a table."""
        rows = [(k, i, c) for k, d in self.datasets.items() for i, c in enumerate(d.channels)]
        return spark.createDataFrame(rows, "dataset_key string, channel_id int, name string")

    def views(self) -> list[str]:
        """Register each dataset's table under a name that SQL can use."""
        out = []
        for k, d in self.datasets.items():
            out.append("".join(c if c.isalnum() else "_" for c in k))
            d.frame.createOrReplaceTempView(out[-1])
        return out

    def pixels(self) -> DataFrame | None:
        """All image datasets in one table with their keys."""
        out = None
        for k in self.names("image"):
            part = self.datasets[k].frame.withColumn("dataset_key", F.lit(k))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out


class Transforms:
    """Named matrices; every one is also there the other way round."""

    def __init__(self) -> None:
        self.matrices: dict[str, Matrix] = {"Identity": IDENTITY}

    def add(self, name: str, matrix: Matrix) -> None:
        self.matrices[name], self.matrices[f"{name} (inverse)"] = matrix, invert(matrix)

    def remove(self, name: str) -> None:
        for n in (name, f"{name} (inverse)"):
            self.matrices.pop(n, None)


def merged_names(names: list[list[str]], keys: list[str] | None = None, ids: list[list[int] | None] | None = None, n: int | None = None) -> list[str]:
    """Channel names of merged images, a selection of each, with their images' names if given; a wrong number is an error."""
    out = []
    for k, own in enumerate(names):
        picked = own if ids is None or ids[k] is None else [own[i] for i in ids[k]]
        out += [f"{c} - {keys[k]}" if keys else c for c in picked]
    if n is not None and len(out) != n:
        raise ValueError(f"{len(out)} channel names for {n} channels")
    return out


#: Integer and float types by the largest number each can hold.
TYPE_ORDER = ("int8", "uint8", "int16", "uint16", "int32", "uint32", "int64", "uint64", "float32", "float64")


def merged_dtype(dtypes: list[str], as_uint8: bool = False) -> str:
    """The type with the largest maximum, the first of equals; uint8 on demand."""
    return "uint8" if as_uint8 else max(dtypes, key=TYPE_ORDER.index)


def export_name(stem: str, op: str, **at) -> str:
    """File name of an export."""
    if op == "crop":
        return f"{stem}_x={at['left']}-{at['right']}_y={at['top']}-{at['bottom']}"
    if op == "mask":
        return f"{stem}_{at['hash']}"
    if op == "scene":
        return f"{stem}_scene={at['scene']:02d}"
    if op == "combine":
        return f"{stem}-{at['func']}.ome.tiff"
    if op == "merge":
        return f"{stem}_merged-registered"
    if op == "stitch":
        return f"{stem}_merged.ome.tiff"
    if op == "transform":
        return f"{stem}_ds={at['target']}.{at['fmt']}"
    raise ValueError(f"no export {op!r}")
