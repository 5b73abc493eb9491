"""What the operators of this subpackage share."""

from __future__ import annotations

import os
import pickle
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace.session import cut_lineage
from foretrace.sources.writers import scratch_path

#: ASCII white space as bytes; ``bytes.split()`` and ``bytes.strip()`` use just these.
WHITE = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def struct_udf(schema: str, prepare: Callable, row: Callable):
    """An Arrow-batched column function: ``prepare()`` once per task, then ``row(state, text) -> tuple`` per value.

    ``schema`` names the fields of the returned struct, apart by ", " (none inside a type). A null text reaches ``row`` as None.
    """
    fields = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        state = prepare()
        for texts in batches:
            out = [row(state, text) for text in texts]
            yield pd.DataFrame.from_records(out, columns=fields)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, schema)


class BoundedCache(dict):
    """A memo of at most ``limit`` entries that starts anew when full; a missing key is computed by ``make``."""

    def __init__(self, make: Callable, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def build_parts(rows: DataFrame, part: str, make: Callable[[pa.Table], object], label: str) -> list[str]:
    """The paths of what ``make`` gives for the rows of each ``part``, in the order of the parts.

    A part is made by one task, which writes it to the shared folder; the driver gets the paths alone. Parts must be of
    bounded size. A task that runs again writes another file, and only the file of the run that ended is named.
    """
    root = scratch_path(rows.sparkSession, label)

    def build(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        path = f"{root}/{key[0].as_py()}-{uuid.uuid4().hex[:12]}"
        system, inner = fs.FileSystem.from_uri(path)
        system.create_dir(os.path.dirname(inner), recursive=True)
        with system.open_output_stream(inner, compression=None) as out:
            out.write(pickle.dumps(make(found)))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "path": [path]})

    made = rows.groupBy(part).applyInArrow(build, "part bigint, path string")
    return [r["path"] for r in sorted(made.collect(), key=lambda r: r["part"])]


_held: tuple[str, object] = ("", None)


def load_part(path: str) -> object:
    """What a path of ``build_parts`` names; a worker holds the last one."""
    global _held
    if _held[0] != path:
        _held = ("", None)
        system, inner = fs.FileSystem.from_uri(path)
        with system.open_input_stream(inner, compression=None) as source:
            _held = (path, pickle.loads(source.read()))
    return _held[1]


__all__ = ["WHITE", "BoundedCache", "build_parts", "cut_lineage", "load_part", "struct_udf", "table"]
