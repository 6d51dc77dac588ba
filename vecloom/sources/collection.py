"""Collections on shared storage: versioned Parquet tables of records, deleted ids, side vectors, sparse features, indexes and blobs.

A write makes new files and then the next manifest, manifests/<number>.json, which names the tables of that version; readers follow the largest
number. A manifest is written beside and renamed to its number by an atomic rename that fails where the number is taken. So there is always a
whole version to read, a job that loses executors or fails leaves the last one, and of two writers that started from one version
the later gets an error in place of undoing the other's work.
"""

from __future__ import annotations

import json
import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import ann, fusion, mutations, search, sparse, text
from ..operators.rerank import rerank
from ..plans.where import apply_where

NAME = re.compile(r"(?!.*\.\.)[A-Za-z0-9._-]{1,128}\Z")


class ConflictError(RuntimeError):
    """Another writer made a version since this one was read."""


def checked_name(name: str) -> str:
    if not NAME.match(name):
        raise ValueError(f"not a name: {name!r}")
    return name


class Storage:
    """Small files and folders by Hadoop's file system, so that any shared storage works."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark.sparkContext._jvm

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def put(self, path: str, text_: str) -> bool:
        """Written beside and renamed, so that a reader sees all of it or nothing; False, and nothing written, if the file exists."""
        fs, p = self._at(path)
        side = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}")
        out = fs.create(side, True)
        out.write(bytearray(text_.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(side), fs.makeQualified(p), none)
        except Exception:
            fs.delete(side, False)
            if fs.exists(p):
                return False
            raise
        return True

    def get(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]


EMPTY = {"dim": None, "records": [], "deleted": None, "next": 0, "vectors": {}, "sparse": [], "indexes": {}, "blobs": [], "version": 0}


class Collection:
    """Records (id string or int, vector array<float>, fields) with soft deletion."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.storage = spark, path.rstrip("/"), Storage(spark)

    # --- versions ---------------------------------------------------------------------------------------------------

    @property
    def manifest(self) -> dict:
        numbers = [n for n in self.storage.names(f"{self.path}/manifests") if n.endswith(".json")]
        if not numbers:
            raise KeyError(self.path)
        return EMPTY | json.loads(self.storage.get(f"{self.path}/manifests/{max(numbers)}"))

    @classmethod
    def create(cls, spark: SparkSession, path: str, dim: int | None = None) -> Collection:
        out = cls(spark, path)
        if not out.storage.put(f"{out.path}/manifests/{0:012d}.json", json.dumps(EMPTY | {"dim": dim})):
            raise ValueError("the collection exists")
        return out

    def _commit(self, before: dict, **changes) -> dict:
        """The version after `before`, with changes; an error if there is one already."""
        after = before | changes | {"version": before["version"] + 1}
        if not self.storage.put(f"{self.path}/manifests/{after['version']:012d}.json", json.dumps(after)):
            raise ConflictError(f"version {after['version']} was written by another writer")
        return after

    def _write(self, df: DataFrame) -> str:
        name = f"part-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{n}" for n in names])

    # --- tables -----------------------------------------------------------------------------------------------------

    def records(self, m: dict | None = None) -> DataFrame:
        """All rows, deleted ones included, with their insertion number _seq."""
        names = (m or self.manifest)["records"]
        if not names:
            raise ValueError("the collection is empty")
        return self._read(names)

    def deleted(self, m: dict | None = None) -> DataFrame:
        m = m or self.manifest
        return self._read([m["deleted"]]) if m["deleted"] else self.records(m).select("id").limit(0)

    def live(self, m: dict | None = None) -> DataFrame:
        m = m or self.manifest
        return mutations.compact(self.records(m), self.deleted(m))

    def vectors(self, field: str, m: dict | None = None) -> DataFrame:
        return self._read((m or self.manifest)["vectors"][field])

    def list_fields(self) -> list[str]:
        return sorted(c for c in self.records().columns if c not in ("id", "vector", "_seq"))

    def exists(self, id_) -> bool:
        return not self.records().where(F.col("id") == id_).isEmpty()

    def stats(self) -> dict:
        """rows (deleted ones included), deleted, live, max_id, dim, fields and named vectors."""
        m = self.manifest
        if not m["records"]:
            return {"rows": 0, "deleted": 0, "live": 0, "max_id": None, "dim": m["dim"], "fields": [], "vectors": []}
        row, gone = self.records(m).agg(F.count(F.lit(1)), F.max("id")).first(), self.deleted(m).count()
        return {"rows": row[0], "deleted": gone, "live": row[0] - gone, "max_id": row[1], "dim": m["dim"], "fields": self.list_fields(), "vectors": sorted(m["vectors"])}

    # --- writes -----------------------------------------------------------------------------------------------------

    def _appended(self, m: dict, rows: DataFrame) -> dict:
        """The changes of the manifest that append rows."""
        if "vector" not in rows.columns:
            if rows.isEmpty():
                return {}
            raise ValueError("new rows need vectors")
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("d"), F.count("id").alias("ids"), F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi")).first()
        if not seen.n:
            return {}
        if seen.d < seen.n or seen.ids < seen.n:
            raise ValueError("ids are repeated or null")
        if seen.lo != seen.hi or m["dim"] not in (None, seen.lo):
            raise ValueError("a vector has another dimension")
        if m["records"] and not rows.select("id").join(self.records(m).select("id"), "id", "left_semi").isEmpty():
            raise ValueError("an id exists already")
        # Numbers ascend by partition and row; gaps do no harm.
        name = self._write(rows.withColumn("_seq", F.monotonically_increasing_id() + m["next"]))
        last = self._read([name]).agg(F.max("_seq")).first()[0]
        return {"dim": seen.lo, "records": [*m["records"], name], "next": last + 1}

    def add(self, rows: DataFrame) -> int:
        """Appends rows (id, vector, fields); ids must be new and unique, vectors of one dimension."""
        m = self.manifest
        if changes := self._appended(m, rows):
            self._commit(m, **changes)
        return rows.count()

    def add_records(self, vectors=None, documents: list[str] | None = None, embed=None, ids: list | None = None, fields: list[dict] | None = None) -> list:
        """Appends records of the driver's memory; without ids they get max id + 1 and on. Vectors come from documents by embed where there are none."""
        if vectors is None:
            if documents is None or embed is None:
                raise ValueError("vectors, or documents and an embedding, are needed")
            vectors = embed(documents)
        vectors = np.asarray(vectors, np.float32)
        if vectors.ndim != 2 or any(x is not None and len(x) != len(vectors) for x in (documents, ids, fields)):
            raise ValueError("as many ids, documents and fields as vectors are needed")
        if ids is None:
            first = (self.stats()["max_id"] if self.manifest["records"] else None) or 0
            first = first + 1 if self.manifest["records"] else 0
            ids = list(range(first, first + len(vectors)))
        if any(isinstance(i, bool) or not (isinstance(i, int) and i >= 0 or isinstance(i, str) and i) for i in ids):
            raise ValueError("ids are numbers from 0, or texts that aren't empty")
        rows = pd.DataFrame([{**({"document": documents[n]} if documents else {}), **(fields[n] if fields else {})} for n in range(len(vectors))])
        rows.insert(0, "id", ids)
        rows.insert(1, "vector", [v.tolist() for v in vectors])
        df = self.spark.createDataFrame(rows).withColumn("vector", F.col("vector").cast("array<float>"))
        self.add(df)
        return ids

    def add_arrow(self, table) -> int:
        """Appends a pyarrow Table of id, vector and fields."""
        return self.add(self.spark.createDataFrame(table).withColumn("vector", F.col("vector").cast("array<float>")))

    def session(self) -> InsertSession:
        """A context that gathers writes and makes one version of them; an exception drops them."""
        return InsertSession(self)

    def upsert(self, rows: DataFrame) -> None:
        """Replaces rows of known ids (columns that rows lacks keep their values) and appends others, in one version; revives deleted ids."""
        m = self.manifest
        base = self.records(m)
        fresh = rows.join(base.select("id"), "id", "left_anti")
        merged = mutations.upsert(base, rows.join(base.select("id"), "id", "left_semi"), "id")
        name, gone = self._write(merged), self._write(mutations.restore(self.deleted(m), rows))
        after = m | {"records": [name], "deleted": gone}
        self._commit(m, **(after | self._appended(after, fresh) | {"version": m["version"]}))

    def update(self, rows: DataFrame) -> None:
        """Changes columns of known ids; an unknown id is an error."""
        m = self.manifest
        name = self._write(mutations.update(self.records(m), rows))
        self._commit(m, records=[name])

    def delete(self, ids: DataFrame) -> None:
        m = self.manifest
        self._commit(m, deleted=self._write(mutations.delete(self.deleted(m), ids, self.records(m))))

    def restore(self, ids: DataFrame) -> None:
        m = self.manifest
        self._commit(m, deleted=self._write(mutations.restore(self.deleted(m), ids)))

    def compact(self) -> int:
        """Drops deleted rows for good, with their named vectors and sparse features, and indexes, which are then to be built anew; gives their number.

        Files that no table of the new version needs are removed, and with them older versions."""
        m = self.manifest
        gone, n = self.deleted(m), self.deleted(m).count()
        kept = {f: [self._write(self.vectors(f, m).join(gone, "id", "left_anti"))] for f in m["vectors"]}
        features = [self._write(self._read(m["sparse"]).join(gone, "id", "left_anti"))] if m["sparse"] else []
        after = self._commit(m, records=[self._write(self.live(m))], deleted=None, vectors=kept, sparse=features, indexes={})
        wanted = {*after["records"], *features, *after["blobs"], *(x for xs in kept.values() for x in xs)}
        for name in self.storage.names(self.path):
            if name.startswith(("part-", "index-")) and name not in wanted:
                self.storage.delete(f"{self.path}/{name}")
        for name in self.storage.names(f"{self.path}/manifests"):
            if name.endswith(".json") and int(name[:-5]) < after["version"]:
                self.storage.delete(f"{self.path}/manifests/{name}")
        return n

    def add_vectors(self, field: str, rows: DataFrame) -> None:
        """A named vector field: (id, vector) rows of known ids, each at most once."""
        checked_name(field)
        if field == "default":
            raise ValueError("default is the record's own vector")
        m = self.manifest
        have = m["vectors"].get(field, [])
        if rows.select("id").join(self.records(m).select("id"), "id", "left_semi").distinct().count() < rows.count():
            raise ValueError("ids are unknown or repeated")
        if have and not rows.select("id").join(self.vectors(field, m).select("id"), "id", "left_semi").isEmpty():
            raise ValueError("an id has this vector already")
        self._commit(m, vectors=m["vectors"] | {field: [*have, self._write(rows.select("id", "vector"))]})

    def update_vectors(self, field: str, rows: DataFrame) -> None:
        """Replaces named vectors; an id without one is an error."""
        m = self.manifest
        name = self._write(mutations.update(self.vectors(field, m), rows.select("id", "vector")))
        self._commit(m, vectors=m["vectors"] | {field: [name]})

    def drop_vectors(self, field: str) -> None:
        m = self.manifest
        if field not in m["vectors"]:
            raise KeyError(field)
        self._commit(m, vectors={f: x for f, x in m["vectors"].items() if f != field})

    def add_sparse(self, rows: DataFrame) -> None:
        """Sparse features (id, idx, val) of known ids; values of one id and index add up."""
        m = self.manifest
        if not rows.select("id").distinct().join(self.records(m).select("id"), "id", "left_anti").isEmpty():
            raise ValueError("an id is unknown")
        self._commit(m, sparse=[*m["sparse"], self._write(sparse.normalise(rows))])

    # --- reads ------------------------------------------------------------------------------------------------------

    def query(self, where: str | None = None, ids: DataFrame | None = None, fields: list[str] | None = None) -> DataFrame:
        """Rows by filter, else by ids (an unknown one is an error), else none; deleted rows show, as in head and tail."""
        out = search.query(self.records(), where, ids)
        return out.select("id", *fields) if fields else out

    def head(self, n: int) -> DataFrame:
        return search.head(self.records(), n, "_seq")

    def tail(self, n: int) -> DataFrame:
        return search.tail(self.records(), n, "_seq")

    def read(self, ids: list) -> DataFrame:
        """Rows with vectors and fields in the order of ids; an unknown id is an error."""
        return search.gather(self.records(), ids)

    def _gone(self, m: dict) -> DataFrame | None:
        return self.deleted(m) if m["deleted"] else None

    def _searched(self, m: dict, field: str | None) -> DataFrame:
        """Rows with the vectors of a field."""
        rows = self.records(m)
        return rows if field in (None, "default") else rows.drop("vector").join(self.vectors(field, m), "id")

    def _with_fields(self, found: DataFrame, m: dict, fields: list[str] | None, largest_first: bool) -> DataFrame:
        if not fields:
            return found
        s = F.round("score", 9)
        return found.join(self.records(m).select("id", *fields), "id").orderBy(s.desc() if largest_first else s.asc(), "id")

    def search(self, vector, k: int = 10, metric: str = "ip", where: str | None = None, fields: list[str] | None = None, filter_ids: DataFrame | None = None, field: str | None = None, approx: bool = False, eps: float = 1e-4, reranker=None, use_index: bool = True, nprobe: int | None = None) -> DataFrame:
        """The k nearest live rows, by the record's vector or a named one. An index of that field and metric is used if there is one,
        no filter is given and it has all rows; else all rows are scanned."""
        m = self.manifest
        about = m["indexes"].get(field or "default")
        if approx:
            found = search.approx_topk(self._searched(m, field), vector, k, metric, eps, where=where, deleted=self._gone(m))
        elif use_index and about and not where and filter_ids is None and ann.parse_mode(about["mode"]).metric == search.resolve(metric) and about["records"] == self._source_of(m, field):
            options = about["options"] | ({"nprobe": nprobe} if nprobe else {})
            found = ann.searched(ann.Cells.open(self.spark, f"{self.path}/{about['name']}"), self.spark, about["mode"], vector, k, deleted=self._gone(m), **options)
        else:
            found = search.topk(self._searched(m, field), vector, k, metric, where, self._gone(m), filter_ids)
        found = self._with_fields(found, m, fields, not search.ascending(metric))
        return found if reranker is None else rerank(found, vector, reranker, k)

    def batch_search(self, queries: DataFrame, k: int = 10, metric: str = "ip", where: str | None = None, field: str | None = None) -> DataFrame:
        """query_id, rank, id, score of the live rows nearest to each (query_id, query)."""
        m = self.manifest
        return search.batch_topk(self._searched(m, field), queries, k, metric, where, self._gone(m))

    def search_range(self, vector, threshold: float, metric: str = "l2", max_results: int = 1000, where: str | None = None, field: str | None = None) -> DataFrame:
        m = self.manifest
        return search.range_search(self._searched(m, field), vector, threshold, metric, max_results, where, self._gone(m))

    def bm25_search(self, words: str, k: int = 10, text_fields: list[str] | None = None, where: str | None = None, seeding: str = "all", fields: list[str] | None = None, reranker=None) -> DataFrame:
        """Over the given fields, or all that are texts."""
        m = self.manifest
        rows = self.records(m)
        found = text.bm25(rows, words, k, text_fields or [c for c, kind in rows.dtypes if kind == "string" and c != "id"], where, self._gone(m), seeding)
        found = self._with_fields(found, m, fields, True)
        return found if reranker is None else rerank(found, words, reranker, k)

    def sparse_search(self, query: dict[int, float], k: int = 10, where: str | None = None) -> DataFrame:
        m = self.manifest
        allowed = apply_where(self.records(m), where).select("id") if where else None
        return sparse.sparse_topk(self._read(m["sparse"]).groupBy("id", "idx").agg(F.sum("val").alias("val")), query, k, allowed, self._gone(m))

    def hybrid_search(self, vector=None, words: str | None = None, features: dict[int, float] | None = None, k: int = 10, candidates: int | None = None, metric: str = "ip", where: str | None = None, how: str = "rrf", weights: tuple[float, float, float] = (1.0, 1.0, 1.0), text_fields: list[str] | None = None, fields: list[str] | None = None, reranker=None) -> DataFrame:
        """Fuses the legs that are asked for; each gives `candidates` rows, max(4 k, 50) by default."""
        n = candidates or max(4 * k, 50)
        if n < k:
            raise ValueError("fewer candidates than results")
        legs = []
        if vector is not None:
            legs.append((self.search(vector, n, metric, where, use_index=False), weights[0], search.ascending(metric)))
        if words is not None:
            legs.append((self.bm25_search(words, n, text_fields, where), weights[1], False))
        if features is not None:
            legs.append((self.sparse_search(features, n, where), weights[2], False))
        if not legs:
            raise ValueError("a vector, words or features are needed")
        found = self._with_fields(fusion.fuse(legs, k, how), self.manifest, fields, True)
        return found if reranker is None else rerank(found, words if words is not None else vector, reranker, k)

    # --- indexes ----------------------------------------------------------------------------------------------------

    def _source_of(self, m: dict, field: str | None) -> list[str]:
        return m["records"] if field in (None, "default") else m["vectors"][field]

    def build_index(self, mode: str, field: str = "default", **options) -> None:
        """A stored index of the field's vectors, replacing an older one; flat modes have none."""
        m, parsed = self.manifest, ann.parse_mode(mode)
        if parsed.family == "FLAT" or parsed.metric in ann.BINARY:
            return self.remove_index(field)
        name = f"index-{uuid.uuid4().hex}"
        ann.build_mode(self._searched(m, field), mode, f"{self.path}/{name}", **options)
        self._commit(m, indexes=m["indexes"] | {field: {"name": name, "mode": mode, "options": options, "records": self._source_of(m, field)}})
        return None

    def remove_index(self, field: str = "default") -> None:
        m = self.manifest
        if field in m["indexes"]:
            self._commit(m, indexes={f: x for f, x in m["indexes"].items() if f != field})

    def sync_index(self, field: str = "default") -> None:
        """Brings an index up to date: rows of tables added since are inserted; after other changes it is built anew."""
        m = self.manifest
        about, now = m["indexes"][field], self._source_of(m, field)
        if about["records"] == now:
            return
        if now[: len(about["records"])] != about["records"]:
            self.build_index(about["mode"], field, **about["options"])
            return
        index = ann.Cells.open(self.spark, f"{self.path}/{about['name']}")
        new = self._read(now[len(about["records"]) :]).select("id", "vector")
        index.insert(new.join(index.rows(self.spark).select("id").distinct(), "id", "left_anti"))  # an insert that failed half way is taken up
        self._commit(m, indexes=m["indexes"] | {field: about | {"records": now}})

    # --- copies -----------------------------------------------------------------------------------------------------

    def export_to(self, path: str) -> None:
        """Live rows as JSON lines, with a count."""
        rows = self.live()
        rows.write.json(f"{path}/records")
        self.storage.put(f"{path}/export.json", json.dumps({"rows": self.spark.read.json(f"{path}/records").count(), "schema": rows.schema.json()}))

    def import_from(self, path: str) -> int:
        """Rows of an export into an empty collection; the count must fit."""
        if self.manifest["records"]:
            raise ValueError("the collection isn't empty")
        about = json.loads(self.storage.get(f"{path}/export.json"))
        rows = self.spark.read.schema(StructType.fromJson(json.loads(about["schema"]))).json(f"{path}/records").drop("_seq")
        if rows.count() != about["rows"]:
            raise OSError("the export isn't whole")
        return self.add(rows)

    def snapshot_to(self, path: str) -> None:
        """A copy with its own manifest; indexes are left out."""
        m = self.manifest
        out = Collection(self.spark, path)
        copy = lambda names: [out._write(self._read([n])) for n in names]
        changes = {"records": copy(m["records"]), "deleted": copy([m["deleted"]])[0] if m["deleted"] else None, "vectors": {f: copy(ns) for f, ns in m["vectors"].items()}, "sparse": copy(m["sparse"]), "blobs": copy(m["blobs"]), "indexes": {}, "version": 0}
        if not out.storage.put(f"{out.path}/manifests/{0:012d}.json", json.dumps(m | changes)):
            raise ValueError("the collection exists")

    @classmethod
    def restore_from(cls, spark: SparkSession, snapshot: str, path: str) -> Collection:
        """A new collection from a snapshot."""
        cls(spark, snapshot).snapshot_to(path)
        return cls(spark, path)

    # --- blobs ------------------------------------------------------------------------------------------------------

    def put_blobs(self, blobs: DataFrame) -> None:
        """(key, value binary) rows; a key's newest value counts, null deletes it."""
        m = self.manifest
        rows = blobs.select(F.col("key").cast("string").alias("key"), F.col("value").cast("binary").alias("value"), F.lit(m["version"]).alias("_v"))
        if rows.groupBy("key").count().where("count > 1 or key is null").count():
            raise ValueError("keys are repeated or null")
        self._commit(m, blobs=[*m["blobs"], self._write(rows)])

    def put_blob(self, key: str, value: bytes | None) -> None:
        self.put_blobs(self.spark.createDataFrame([(key, value)], "key string, value binary"))

    def delete_blob(self, key: str) -> None:
        self.blob(key)
        self.put_blob(key, None)

    def blobs(self) -> DataFrame:
        """key, value of what isn't deleted."""
        names = self.manifest["blobs"]
        if not names:
            return self.spark.createDataFrame([], "key string, value binary")
        best = self._read(names).groupBy("key").agg(F.max_by(F.struct("value"), "_v").alias("b"))
        return best.select("key", "b.value").where("value is not null")

    def blob(self, key: str, start: int = 0, size: int | None = None) -> bytes:
        """A blob, or a byte range of it; only the range comes to the driver."""
        rows = self.blobs().where(F.col("key") == key)
        got = rows.select(F.expr(f"substring(value, {int(start) + 1})") if size is None else F.substring("value", start + 1, size)).first()
        if got is None:
            raise KeyError(key)
        return bytes(got[0])


class InsertSession:
    """Gathers additions of a collection; leaving the context makes one version of them, an exception drops them."""

    def __init__(self, collection: Collection):
        self.collection, self.pending = collection, []

    def __enter__(self) -> InsertSession:
        return self

    def add(self, rows: DataFrame) -> None:
        self.pending.append(rows)

    def add_records(self, ids: list, vectors, fields: list[dict] | None = None) -> None:
        rows = [{"id": i, "vector": [float(x) for x in v], **(fields[n] if fields else {})} for n, (i, v) in enumerate(zip(ids, vectors, strict=True))]
        self.pending.append(self.collection.spark.createDataFrame(pd.DataFrame(rows)).withColumn("vector", F.col("vector").cast("array<float>")))

    def flush(self) -> None:
        """Makes a version of what is gathered so far."""
        if self.pending:
            every = self.pending[0]
            for rows in self.pending[1:]:
                every = every.unionByName(rows, allowMissingColumns=True)
            self.collection.add(every)
        self.pending = []

    commit = flush

    def rollback(self) -> None:
        self.pending = []

    def __exit__(self, kind, value, trace) -> None:
        self.rollback() if kind else self.commit()


class Database:
    """Collections under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.storage = spark, path.rstrip("/"), Storage(spark)

    def create(self, name: str, dim: int | None = None) -> Collection:
        return Collection.create(self.spark, f"{self.path}/{checked_name(name)}", dim)

    def open(self, name: str) -> Collection:
        if name not in self.list():
            raise KeyError(name)
        return Collection(self.spark, f"{self.path}/{name}")

    def list(self) -> list[str]:
        return [n for n in self.storage.names(self.path) if self.storage.exists(f"{self.path}/{n}/manifests")]

    def drop(self, name: str) -> None:
        self.storage.delete(f"{self.path}/{checked_name(name)}")

    def snapshot_to(self, path: str) -> None:
        for name in self.list():
            self.open(name).snapshot_to(f"{path.rstrip('/')}/{name}")

    @classmethod
    def restore_from(cls, spark: SparkSession, snapshot: str, path: str) -> Database:
        cls(spark, snapshot).snapshot_to(path)
        return cls(spark, path)


def blob_range(blobs: DataFrame, key: str, start: int, size: int) -> DataFrame:
    """A byte range of a (key, value) table's value."""
    return blobs.where(F.col("key") == key).select("key", F.substring("value", start + 1, size).alias("value"))


def embed_documents(docs: DataFrame, embed, text: str = "text", vec: str = "vector") -> DataFrame:
    """Adds vectors by a callable from a list of texts to a 2-D array, a batch at a time."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        got = np.asarray(embed(texts.fillna("").tolist()), np.float32)
        if got.ndim != 2 or len(got) != len(texts):
            raise ValueError("the embedding doesn't give a row for each text")
        return pd.Series(list(got))

    return docs.withColumn(vec, run(F.col(text)))
