"""The engine: index a tree, query the index, tell its state."""

from __future__ import annotations

import json
import os
import platform
import time
from collections.abc import Callable
from importlib.metadata import PackageNotFoundError, version
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelode import __version__, schema
from codelode.functions import text as X
from codelode.functions.embed import Embedder, HashEmbedder, dot
from codelode.operators import code, reconcile, search, sections
from codelode.operators.vectors import described
from codelode.ship import ship
from codelode.sources import scan
from codelode.sources.store import IndexError_, LockedError, Store


class UnsafeRootError(ValueError):
    """A root that is the home folder or holds it."""


def check_root(root: str | Path, force: bool = False, home: Path | None = None) -> Path:
    path, home = Path(root).resolve(), (home or Path.home()).resolve()
    if not force and (path == home or path in home.parents):
        raise UnsafeRootError(f"{path} is or holds the home folder; pass force to index it")
    return path


#: What the engine runs on, and the package that named models need.
PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy", "sentence-transformers")


def installed_package(name: str) -> dict:
    """Whether a distribution is installed, and which version."""
    try:
        return {"installed": True, "version": version(name)}
    except PackageNotFoundError:
        return {"installed": False, "version": None}


class Engine:
    """installed: the languages whose files are read (None: all)."""

    def __init__(self, spark: SparkSession, embedder: Embedder | None = None, installed: frozenset[str] | None = None) -> None:
        self.spark, self.embedder, self.installed = ship(spark), embedder or HashEmbedder(), installed

    def _db(self, root: str | Path | None, db: str | Path | None) -> Path:
        return Path(db).resolve() if db else Path(root or os.getcwd()).resolve() / schema.INDEX_DIR

    def extract(self, files: DataFrame, definitions: bool = False) -> DataFrame:
        """Symbols with ids of files (rel, content), before equal keys are merged."""
        read = scan.decoded(files)
        languages = {lang for lang in schema.LANGUAGES if self.installed is None or lang in self.installed}
        out = code.code_symbols(read.filter(scan.has_extension(schema.extensions(False, frozenset(languages)), "file_path")))
        if definitions:
            for lang, carve in (("yaml", sections.yaml_sections), ("markdown", sections.markdown_sections), ("msbuild", sections.msbuild_sections)):
                out = out.unionByName(carve(read.filter(scan.has_extension(set(schema.DEFINITIONS[lang]), "file_path"))))
        return reconcile.with_ids(out)

    def index(self, path: str | Path, db: str | Path | None = None, *, reset: bool = False, definitions: bool = False, force: bool = False, log: Callable[[str], None] | None = None) -> dict:
        """Makes the index of a tree what the tree holds now: keys are upserted, those gone are deleted.

        Vectors of symbols whose embedded text has not changed are kept.  The change is all or nothing.
        """
        root = check_root(path, force)
        store = Store(self.spark, self._db(root, db))
        exts = schema.extensions(definitions, self.installed)
        with store.writing():
            began = time.time()
            files = store.staged(scan.candidates(self.spark, str(root), exts, content=True), "files")
            if log:
                log(f"{files.count()} files in {', '.join(r[0] for r in scan.coverage(files, schema.registry(self.spark), self.installed).select('language').collect()) or 'no language'}")
            extracted = store.staged(self.extract(files, definitions), "symbols")
            now = reconcile.last_wins(extracted).drop("seq").withColumn("embed_hash", F.sha1(X.embed_text().cast("binary")))
            old = None
            if not reset and store.version() is not None:
                old = store.symbols()
                dimension = store.dimension()
                if dimension not in (None, self.embedder.dimension):
                    raise ValueError(f"the index holds vectors of {dimension} entries, the embedder makes {self.embedder.dimension}; pass reset")
                kept = now.join(old.select("id", "embed_hash", "embedding"), ["id", "embed_hash"], "left")
                fresh = kept.filter("embedding is null").drop("embedding")
                kept = kept.filter("embedding is not null")
                vectors = kept.unionByName(fresh.withColumn("embedding", self.embedder.column(X.embed_text())))
            else:
                vectors = now.withColumn("embedding", self.embedder.column(X.embed_text()))
            vectors = store.staged(vectors.select("id", *schema.SYMBOL_COLUMNS, "embed_hash", "embedding"), "vectors")
            listed = files.select("rel", F.sha1("content").alias("sha1"))
            changes = {} if old is None else {r[0]: r[1] for r in reconcile.diff(old, vectors).groupBy("change").count().collect()}
            n_files, n_symbols = files.count(), extracted.count()
            store.commit(vectors, listed, {"root": str(root), "indexed_extensions": sorted(exts), "definitions": definitions, "dimension": self.embedder.dimension})
            store.unstage()
        return {"status": "ok", "indexed_files": n_files, "indexed_symbols": n_symbols, "dimension": self.embedder.dimension, "db": str(store.db), "deleted": changes.get("deleted", 0), "updated": changes.get("updated", 0), "elapsed_seconds": round(time.time() - began, 2)}

    def optimize(self, db: str | Path | None = None, *, root: str | Path | None = None) -> dict:
        """Makes the layout that queries without a filter search; exact, and for the current snapshot only."""
        return json.loads(described(Store(self.spark, self._db(root, db)).optimize()))

    def hits(self, text: str, db: str | Path | None = None, *, root: str | Path | None = None, top: int = search.TOP, candidates: int = search.CANDIDATES, filter: str | None = None, kind: str | None = None, lang: str | None = None, w_dense: float = search.DENSE_WEIGHT, w_lexical: float = search.LEXICAL_WEIGHT) -> DataFrame:
        sql = search.build_filter(filter, kind, lang)  # before the index is touched
        store, vector = Store(self.spark, self._db(root, db)), self.embedder.query(text)
        rows = store.symbols()
        if sql is None and top >= 0 and candidates >= 0 and (pool := store.nearest(vector, max(top, candidates))) is not None:
            rows = rows.join(F.broadcast(pool.select("id")), "id", "left_semi")  # the pool, which the layout finds without a look at the rest
        return search.hybrid_query(rows, dot(F.col("embedding"), vector), text, top=top, candidates=candidates, sql_filter=sql, w_dense=w_dense, w_lexical=w_lexical)

    def query(self, text: str, db: str | Path | None = None, *, root: str | Path | None = None, tokens: bool = False, **options) -> dict:
        """The payload of a query: its filter, its hits and, if asked for, the report on saved tokens."""
        hits = self.hits(text, db, root=root, **options)
        rows = [r.asDict() for r in hits.orderBy("rank").collect()]
        out = {"query": text, "filter": search.build_filter(options.get("filter"), options.get("kind"), options.get("lang")), "results": rows}
        if tokens:
            out["token_report"] = self.token_report(rows, root or os.getcwd())
        return out

    def token_report(self, rows: list[dict], root: str | Path) -> dict:
        """The report for hits that were collected; their files are read anew."""
        read = []
        for path in dict.fromkeys(r["file_path"] for r in rows):
            try:
                read.append((path, (Path(root) / path).read_text(encoding="utf-8", errors="replace"), False))
            except FileNotFoundError:
                continue
            except OSError:
                read.append((path, None, True))
        hits = self.spark.createDataFrame([(r["rank"], r["file_path"], r["symbol_name"], r["code_content"]) for r in rows], "rank int, file_path string, symbol_name string, code_content string")
        files = self.spark.createDataFrame(read, "file_path string, text string, unreadable boolean")
        whole = search.token_files(hits, files).orderBy("file_path").collect()
        return search.token_savings(hits, files).first().asDict() | {
            "results": [r.asDict() for r in search.token_rows(hits).orderBy("rank").collect()],
            "files": [{"file_path": r["file_path"], "full_file_tokens": r["full_file_tokens"]} for r in whole if r["reason"] is None],
            "unavailable_files": [{"file_path": r["file_path"], "reason": r["reason"]} for r in whole if r["reason"]],
        }

    def is_stale(self, root: str | Path, store: Store) -> bool:
        """Whether the tree has changed since the index was made; contents are only hashed if nothing cheaper tells."""
        meta = store.metadata()
        if meta is None:
            return True
        last = meta["indexed_at"] if isinstance(meta.get("indexed_at"), (int, float)) else store.newest()
        definitions = meta.get("definitions") is True
        can = schema.extensions(definitions, self.installed)
        known = set(meta["indexed_extensions"]) if isinstance(meta.get("indexed_extensions"), list) else None
        indexed = store.files()
        every = schema.extensions(definitions) | can | (known or set())
        listing = scan.candidates(self.spark, str(root), every)
        cheap = reconcile.stale_flags(listing.select("rel", F.lit(None).cast("string").alias("sha1"), "mtime"), indexed, float(last), can, known)
        if cheap.filter("newer or new_extension or deleted or added").limit(1).count():
            return True
        disk = scan.candidates(self.spark, str(root), every, content=True).select("rel", F.sha1("content").alias("sha1"), "mtime")
        return bool(reconcile.is_stale(reconcile.stale_flags(disk, indexed, float(last), can, known)).first()[0])

    def missing_grammars(self, root: str | Path) -> list[dict]:
        if self.installed is None:
            return []
        listing = scan.candidates(self.spark, str(Path(root).resolve()), schema.extensions(False))
        found = scan.coverage(listing, schema.registry(self.spark), self.installed).filter("not installed and install_hint is not null")
        return [r.asDict() for r in found.drop("installed").collect()]

    def status(self, db: str | Path | None = None, root: str | Path | None = None) -> dict:
        """Counts are zero without an index, and null with an error if it cannot be read."""
        store = Store(self.spark, self._db(root, db))
        out = {"exists": store.exists(), "db_path": str(store.db), "indexed_files": 0, "indexed_symbols": 0, "dimension": None, "languages": [], "last_indexed_at": None, "stale": None, "missing_grammars": [], "error": None}
        if not out["exists"]:
            return out
        try:
            summary = store.summary().first()
            out |= {"indexed_files": summary["files"], "indexed_symbols": summary["documents"], "dimension": store.dimension(), "languages": [x for x in (summary["languages"] or "").split(",") if x]}
            out["last_indexed_at"] = (store.metadata() or {}).get("indexed_at") or store.newest()
            if root:
                out |= {"stale": self.is_stale(Path(root).resolve(), store), "missing_grammars": self.missing_grammars(root)}
        except (IndexError_, OSError) as e:
            out |= {"indexed_files": None, "indexed_symbols": None, "error": str(e)}
        return out

    def doctor(self, db: str | Path | None = None, root: str | Path | None = None) -> dict:
        """One report of the installation, the index and its locks, and the editors' configuration."""
        from codelode.bootstrap import probe_server_lock, read_configs

        top = Path(root or os.getcwd()).resolve()
        store = Store(self.spark, self._db(top, db))
        return {
            "status": "ok",
            "workspace": {"root": str(top), "db_path": str(store.db)},
            "install": {"version": __version__, "module": str(Path(__file__).resolve().parent), "python_version": platform.python_version(), "languages": sorted(self.installed or schema.LANGUAGES), "packages": {name: installed_package(name) for name in PACKAGES}},
            "index": (index := self.status(store.db, top)),
            "locks": {"serve": probe_server_lock(store.db), "index": {"readable": index["exists"] and not index["error"], "locked": store.is_locked(), "error": index["error"]}},
            "harness": {"mcp_configs": read_configs(top)},
        }


__all__ = ["Engine", "IndexError_", "LockedError", "UnsafeRootError", "check_root"]
