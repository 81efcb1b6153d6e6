"""The index on disk: immutable Parquet snapshots and a pointer to the current one.

Readers pin the snapshot that the pointer names, so they never wait; one writer at a
time holds a lock file, writes a new snapshot and swaps the pointer, all or nothing.
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import re
import shutil
import threading
import time
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from codelode import schema
from codelode.operators import reconcile, vectors

_POINTER, _METADATA, _LOCK = "CURRENT", "metadata.json", ".write.lock"
METADATA_VERSION = 2
#: Paths of a lookup that are named to Parquet; more are joined.
NAMED = 1_000
_SNAPSHOT = T.StructType([T.StructField("id", T.StringType()), *schema.SYMBOL.fields, T.StructField("embed_hash", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
_threads: dict[str, threading.RLock] = defaultdict(threading.RLock)


class IndexError_(RuntimeError):
    """An index that cannot be read."""


class LockedError(RuntimeError):
    """Another process holds the lock."""


class Store:
    def __init__(self, spark: SparkSession, db: str | Path) -> None:
        if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", str(db)):
            raise ValueError(f"{db}: an index is kept in a folder that the driver and all executors mount")
        self.spark, self.db = spark, Path(db).resolve()

    def exists(self) -> bool:
        return self.db.is_dir() and any(self.db.iterdir())

    def version(self) -> int | None:
        try:
            return int((self.db / _POINTER).read_text())
        except FileNotFoundError:
            return None
        except ValueError as e:
            raise IndexError_(f"damaged pointer in {self.db}") from e

    def _path(self, kind: str, version: int) -> str:
        return f"file://{self.db}/{kind}-v{version}"  # never the default file system's

    def symbols(self) -> DataFrame:
        """The current snapshot: id, the symbol columns, embed_hash and embedding."""
        version = self.version()
        if version is None or not (self.db / f"symbols-v{version}").is_dir():
            raise IndexError_(f"no readable index at {self.db}")
        return self.spark.read.schema(_SNAPSHOT).parquet(self._path("symbols", version))

    def summary(self) -> DataFrame:
        """One row: documents, files, languages and about how many names, from the summary that was written with the snapshot."""
        version = self.version()
        if version is None or not (self.db / f"summary-v{version}").is_dir():
            return reconcile.merged(reconcile.by_language(self.symbols()))
        return reconcile.merged(self.spark.read.parquet(self._path("summary", version)))

    def of_files(self, paths: DataFrame) -> DataFrame:
        """The symbols of some files (file_path): a semi-join, for which few paths are named to Parquet's filters."""
        few = [r[0] for r in paths.select("file_path").distinct().limit(NAMED + 1).collect()]
        rows = self.symbols().select(*_SNAPSHOT.fieldNames())
        return rows.filter(F.col("file_path").isin(few)) if len(few) <= NAMED else rows.join(paths.select("file_path"), rows["file_path"] == paths["file_path"], "left_semi")

    def optimize(self) -> vectors.Lists:
        """Lays the current snapshot's vectors out by centroids, beside it; a later snapshot needs its own."""
        with self.writing():
            rows = self.symbols().select("id", "embedding")
            return vectors.write_lists(rows, self._path("vectors", self.version()), id="id", vector="embedding")

    def nearest(self, query: list[float], k: int) -> DataFrame | None:
        """(id, dense_similarity) of the k best symbols, from the layout; None if there is none."""
        version = self.version()
        if version is None or not (self.db / f"vectors-v{version}" / "lists" / "_SUCCESS").exists():
            return None
        return vectors.topk(self.spark, self._path("vectors", version), query, k, id="id", vector="embedding")

    def files(self) -> DataFrame:
        """rel and sha1 of the files that were walked."""
        version = self.version()
        if version is None or not (self.db / f"files-v{version}").is_dir():
            raise IndexError_(f"no readable index at {self.db}")
        return self.spark.read.parquet(self._path("files", version))

    def metadata(self) -> dict | None:
        """The metadata, or None if there is none that reads as such."""
        try:
            known = json.loads((self.db / _METADATA).read_text(encoding="utf-8"))
        except (OSError, ValueError):
            return None
        return known if isinstance(known, dict) else None

    def newest(self) -> float | None:
        """The last time that a file of the index changed; the folder's own time if it has none."""
        if not self.db.exists():
            return None
        return max((p.stat().st_mtime for p in self.db.rglob("*") if p.is_file()), default=self.db.stat().st_mtime)

    @contextlib.contextmanager
    def writing(self) -> Iterator[None]:
        """Holds this process's and the file's lock; LockedError if another process writes."""
        with _threads[str(self.db)]:
            self.db.mkdir(parents=True, exist_ok=True)
            with open(self.db / _LOCK, "w") as lock:
                try:
                    fcntl.flock(lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
                except OSError as e:
                    raise LockedError(f"{self.db} is being written by another process") from e
                yield

    def is_locked(self) -> bool:
        try:
            with open(self.db / _LOCK) as lock:
                fcntl.flock(lock, fcntl.LOCK_SH | fcntl.LOCK_NB)
        except FileNotFoundError:
            return False
        except OSError:
            return True
        return False

    def commit(self, symbols: DataFrame, files: DataFrame, metadata: dict) -> None:
        """Writes both tables as the next version and makes it current; older versions but the last one go."""
        known = [int(p.name.rpartition("-v")[2]) for p in self.db.glob("*-v*") if p.name.rpartition("-v")[2].isdigit()]
        version = max(known, default=0) + 1
        ordered = symbols.repartitionByRange("language", "file_path").sortWithinPartitions("language", "file_path", "start_line")
        skipping = {f"parquet.bloom.filter.enabled#{c}": "true" for c in ("id", "file_path")}
        ordered.write.options(**skipping).partitionBy("language").parquet(self._path("symbols", version))
        files.write.parquet(self._path("files", version))
        written = self.spark.read.schema(_SNAPSHOT).parquet(self._path("symbols", version))
        reconcile.by_language(written).coalesce(1).write.parquet(self._path("summary", version))
        self._replace(_METADATA, json.dumps(metadata | {"version": METADATA_VERSION, "indexed_at": time.time()}, indent=2, sort_keys=True))
        self._replace(_POINTER, str(version))
        for p in self.db.glob("*-v*"):
            if p.name.rpartition("-v")[2].isdigit() and int(p.name.rpartition("-v")[2]) < version - 1:
                shutil.rmtree(p, ignore_errors=True)

    def _replace(self, name: str, text: str) -> None:
        new = self.db / f"{name}.new"
        new.write_text(text, encoding="utf-8")
        os.replace(new, self.db / name)

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        """df, computed once and read back from a folder of the index that the next call replaces."""
        path = f"file://{self.db}/stage-{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def unstage(self) -> None:
        for p in self.db.glob("stage-*"):
            shutil.rmtree(p, ignore_errors=True)

    def dimension(self) -> int | None:
        row = self.symbols().select(F.size("embedding")).first()
        return row[0] if row else None
