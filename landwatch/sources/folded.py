"""Logs in generations, with a base that stands for the closed ones.

A folded table is written to ``table/generation=<n>/<date>=...``. Compaction opens the next
generation, folds the base and the closed generations into a new base, and then publishes a
pointer to it. Readers merge that base with the generations since. A pointer is a new file
with the next version as its name, so nothing is replaced: a compaction that dies leaves the
last pointer valid, and of two at the same time one fails to publish.

The last closed generation stays among those that readers merge until the next compaction,
since a writer may have opened it before it was closed; folding it twice changes nothing.
Compactions must therefore lie further apart than the longest write.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession

from landwatch.session import path_exists

#: Folded tables and the store whose pointer they follow.
STORE_OF = {"schema_snapshots": "heads", "drift_events": "drift", "drift_event_updates": "drift"}


@dataclass(frozen=True)
class Pointer:
    """``base``: path of the folded state, if any; ``generation``: where writers append;
    ``tail``: the first generation that readers merge with the base."""

    version: int = 0
    base: str | None = None
    generation: int = 0
    tail: int = 0


def _folder(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _pointers(root: str, store: str) -> str:
    return f"{root.rstrip('/')}/_{store}/pointers"


def read_pointer(spark: SparkSession, root: str, store: str) -> Pointer:
    """The newest readable pointer; one whose writer died before its end is passed over."""
    path = _pointers(root, store)
    if not path_exists(spark, path):
        return Pointer()
    folder, fs = _folder(spark, path)
    to_text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString
    for status in sorted(fs.listStatus(folder), key=lambda s: s.getPath().getName(), reverse=True):
        stream = fs.open(status.getPath())
        try:
            return Pointer(**json.loads(to_text(stream, "UTF-8")))
        except ValueError:
            continue
        finally:
            stream.close()
    return Pointer()


def publish(spark: SparkSession, root: str, store: str, pointer: Pointer) -> None:
    """Make ``pointer`` the newest; fails if its version exists already."""
    path, fs = _folder(spark, f"{_pointers(root, store)}/{pointer.version:012d}.json")
    stream = fs.create(path, False)
    try:
        stream.write(bytearray(json.dumps(asdict(pointer)).encode()))
    finally:
        stream.close()


def generations(spark: SparkSession, path: str, first: int, last: int) -> list[str]:
    """Folders of the generations ``first`` to ``last`` that hold anything."""
    return [p for p in (f"{path}/generation={g}" for g in range(first, last + 1)) if path_exists(spark, p)]


def open_generation(spark: SparkSession, root: str, store: str) -> tuple[Pointer, Pointer]:
    """Close the present generation: (what was before, what holds while the closed one is folded)."""
    before = read_pointer(spark, root, store)
    during = Pointer(before.version + 1, before.base, before.generation + 1, before.tail)
    publish(spark, root, store, during)
    return before, during


def new_base(root: str, store: str) -> str:
    return f"{root.rstrip('/')}/_{store}/base-{uuid.uuid4().hex}"


def close_generation(spark: SparkSession, root: str, store: str, before: Pointer, during: Pointer, base: str) -> Pointer:
    """Publish the new base; the generation just folded stays in the tail for writers that were late."""
    after = Pointer(during.version + 1, base, during.generation, before.generation)
    publish(spark, root, store, after)
    return after
