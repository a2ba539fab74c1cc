"""An index as a sequence of snapshots, replaced document by document.

Rows of each table lie in partitions by collection and bucket (a hash of the document). A commit writes the partitions of the documents that it
replaces anew, into a folder of its own, and then a manifest: which folder holds each partition. All other partitions stay where
they are. The manifest appears under the next version's name by one rename that fails if the name is taken: readers see the old
snapshot or the new one, of two writers one fails, and a write that breaks off leaves nothing that a reader sees.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16  # of each collection
PLACE = ("collection", "bucket")
_OWN: dict[str, str] = {}


class Conflict(RuntimeError):
    """Another writer has made this version."""


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a temporary folder on a single machine that has none."""
    set_ = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not set_ and app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="spark-index-", dir="/tmp")
    return (set_ or _OWN[app]).rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table under the shared folder: a small result of much work that is read more than once."""
    spark, path = df.sparkSession, f"{shared_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def latest(spark: SparkSession, path: str) -> int:
    """The newest version of the index at path; 0 if there is none."""
    where, fs = _files(spark, f"{path}/manifests")
    if not fs.exists(where):
        return 0
    return max((int(f.getPath().getName()) for f in fs.listStatus(where) if f.getPath().getName().isdigit()), default=0)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """What version (the newest, if none is given) of the index consists of: version, revisions by collection, tables with schema and parts."""
    version = latest(spark, path) if version is None else version
    if not version:
        return {"version": 0, "revisions": {}, "tables": {}}
    where, fs = _files(spark, f"{path}/manifests/{version:012d}")
    stream = fs.open(where)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, new: dict) -> None:
    jvm = spark.sparkContext._jvm
    final = f"{path}/manifests/{new['version']:012d}"
    draft, fs = _files(spark, f"{path}/manifests/draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:  # without options a rename does not overwrite
        context.rename(draft, jvm.org.apache.hadoop.fs.Path(final), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(jvm.org.apache.hadoop.fs.Path(final)):
            raise Conflict(f"version {new['version']} exists") from e
        raise


def read(spark: SparkSession, path: str, name: str, version: int | None = None, collections: list[str] | None = None) -> DataFrame:
    """A table of the index as of a version; of some collections only, if they are named."""
    return _rows(spark, path, manifest(spark, path, version)["tables"][name], lambda place: collections is None or place.split("/")[0] in collections)


def _rows(spark: SparkSession, path: str, table: dict, wanted) -> DataFrame:
    schema = StructType.fromJson(table["schema"])
    by_folder: dict[str, list[str]] = {}
    for place, (folder, _) in table["parts"].items():
        if wanted(place):
            collection, bucket = place.split("/")
            by_folder.setdefault(folder, []).append(f"{path}/{folder}/collection={collection}/bucket={bucket}")
    out = None
    for folder, parts in by_folder.items():
        df = spark.read.schema(schema).option("basePath", f"{path}/{folder}").parquet(*parts)
        out = df if out is None else out.unionByName(df)
    return spark.createDataFrame([], schema) if out is None else out


def replace_documents(path: str, documents: DataFrame, tables: dict[str, DataFrame], expected: int | None = None, limits: dict[str, int] | None = None, known: DataFrame | None = None) -> int:
    """Makes the next version, in which the rows of documents (collection, document) in all tables are those of tables (each with collection and document,
    which are not null); documents without rows go. Returns the version.

    expected: the version that the caller has read (else the newest); if another writer has gone on from it, Conflict is raised. limits: the most rows that a table may
    have; above, ValueError. known: registered documents (collection, document); a document outside raises KeyError. In all three cases readers keep the
    old version.
    """
    spark = documents.sparkSession
    old = manifest(spark, path, expected)
    documents = documents.select("collection", "document").distinct()
    if known is not None and (lost := documents.join(known, ["collection", "document"], "left_anti").head()):
        raise KeyError(lost["document"])
    bucket = F.pmod(F.xxhash64("document"), F.lit(BUCKETS)).cast("int")
    touched = {f"{r['collection']}/{r['bucket']}" for r in documents.select("collection", bucket.alias("bucket")).distinct().collect()}  # as many as partitions at most
    folder, made = f"data/{uuid.uuid4().hex}", {}
    for name in {**old["tables"], **tables}:
        before, new = old["tables"].get(name), tables.get(name)
        kept = None
        if before:
            kept = _rows(spark, path, before, lambda place: place in touched).join(documents, ["collection", "document"], "left_anti").drop("bucket")
        rows = new if kept is None else kept if new is None else kept.unionByName(new)
        rows = rows.withColumn("bucket", bucket)
        rows = rows.select(*[c for c in rows.columns if c not in PLACE], *PLACE)
        # one writer for each partition: a document's rows are few, a partition's bounded by the number of buckets
        rows.repartition(*PLACE).sortWithinPartitions(*PLACE).write.partitionBy(*PLACE).parquet(f"{path}/{folder}/{name}")
        parts = {k: v for k, v in (before or {"parts": {}})["parts"].items() if k not in touched}
        schema = before["schema"] if before else rows.schema.jsonValue()
        written = spark.read.schema(StructType.fromJson(schema)).parquet(f"{path}/{folder}/{name}").groupBy(*PLACE).count().collect()
        parts |= {f"{r['collection']}/{r['bucket']}": [f"{folder}/{name}", r["count"]] for r in written}
        made[name] = {"schema": schema, "parts": parts}
    for name, most in (limits or {}).items():
        if sum(n for _, n in made[name]["parts"].values()) > most:
            raise ValueError(f"{name} exceeds {most} rows")
    revisions = dict(old["revisions"])
    for c in {place.split("/")[0] for place in touched}:
        revisions[c] = revisions.get(c, 0) + 1
    version = old["version"] + 1
    _publish(spark, path, {"version": version, "revisions": revisions, "tables": made})
    return version


def rows_of(spark: SparkSession, path: str, name: str, version: int | None = None) -> int:
    """How many rows a table has, by the manifest alone."""
    return sum(n for _, n in manifest(spark, path, version)["tables"][name]["parts"].values())
