"""Stores on parquet: full rewrites, resumable upserts, staged imports, record files and copies between databases."""

from __future__ import annotations

import atexit
import contextlib
import graphlib
import hashlib
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def file_state(spark: SparkSession, path: str) -> str:
    """A fingerprint of a table's files by their names, sizes and times."""
    fs, p, _ = _fs(spark, path)
    files, found = fs.listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def _rename_over(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file over another in one step, so that readers see the old or the new one."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs, p, make = _fs(spark, target)
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(make(source)), fs.makeQualified(p), options)


def write_manifest(spark: SparkSession, path: str, data: dict) -> None:
    """A JSON file that appears whole or not at all: written beside, then renamed over the one before."""
    fs, _, make = _fs(spark, path)
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    out = fs.create(make(beside), True)
    out.write(bytearray(json.dumps(data, sort_keys=True).encode()))
    out.close()
    _rename_over(spark, beside, path)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    if not exists(spark, path):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def settle(spark: SparkSession, path: str) -> None:
    """Puts back the version before, where a replacement was cut short between its two renames."""
    fs, p, make = _fs(spark, path)
    if not fs.exists(p):
        before = fs.globStatus(make(f"{path}.*.before")) or []
        for x in sorted(before, key=lambda f: f.getModificationTime(), reverse=True)[:1]:
            fs.rename(x.getPath(), p)


def replace(df: DataFrame, path: str, *partitions: str) -> None:
    """The whole table rewritten beside, then moved into place; the version before is deleted last.

    A table of several files cannot be renamed over another in one step: a crash between the two renames leaves the version
    before under another name, which settle() (and the next replace()) puts back.
    """
    spark = df.sparkSession
    fs, p, make = _fs(spark, path)
    settle(spark, path)
    staged, before = f"{path}.{uuid.uuid4().hex}.staged", make(f"{path}.{uuid.uuid4().hex}.before")
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(staged)
    old = fs.exists(p)
    if old and not fs.rename(p, before):
        raise OSError(f"could not set {path} aside")
    if not fs.rename(make(staged), p):
        if old:
            fs.rename(before, p)
        raise OSError(f"could not put {path} in place")
    if old:
        fs.delete(before, True)


def upsert(wanted: DataFrame, path: str, key: str, payload: str, embed, contract: dict | None = None, whole: bool = False) -> int:
    """Appends the rows whose key does not stand with this payload now, after embed(rows); a rerun continues where one
    broke off. Returns how many rows were pending. Readers take the newest row of a key (see current()). One writer at a time:
    of two at once both append, and the later row of a key counts.

    contract: settings (model, size, corpus) that a store keeps for its life; another one, or rows without one, is refused.
    whole: wanted is all there should be, so other keys are marked as gone. What stands is counted before the contract is
    marked ready.
    """
    spark = wanted.sparkSession
    there, note = exists(spark, path), f"{path}.contract.json"
    if contract is not None:
        known = read_manifest(spark, note)
        if there and known is None:
            raise ValueError("the store has rows but no contract")
        if known and known["contract"] != contract:
            raise ValueError("the store was made under another contract")
        write_manifest(spark, note, {"contract": contract, "status": "building"})
    stands = current(spark, path, key).select(key, payload) if there else None
    pending = wanted.join(stands, [key, payload], "left_anti") if there else wanted
    n = pending.count()
    stamp = F.current_timestamp()
    if n:
        embed(pending).withColumns({"_written": stamp, "_gone": F.lit(False)}).write.mode("append").parquet(path)
    if whole and there:
        gone = stands.join(wanted.select(key), key, "left_anti").select(key)
        if gone.take(1):
            gone.withColumns({"_written": stamp, "_gone": F.lit(True)}).write.mode("append").parquet(path)
    if contract is not None:
        rows = current(spark, path, key) if exists(spark, path) else None
        held = rows.join(wanted.select(key, payload), [key, payload], "left_semi").count() if rows is not None else 0
        expected = wanted.select(key).distinct().count()
        if held != expected or (whole and rows is not None and rows.count() != expected):
            raise RuntimeError(f"{held} of {expected} rows stand in the store")
        write_manifest(spark, note, {"contract": contract, "status": "ready", "count": held})
    return n


def current(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest row of every key that is not gone."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    newest = F.max_by(F.struct(*rows.columns), "_written").alias("r")
    return rows.groupBy(F.col(key).alias("_key")).agg(newest).select("r.*").where("not _gone").drop("_written", "_gone")


_TEMPORARY: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a local session gets one of its own;
    on a cluster that is an error, since executors do not see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="abacora-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def temporary(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, deleted by discard(), or else when the program ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _TEMPORARY[path] = spark
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """A frame that is read several times, written to a temporary() path: cuts lineage, survives lost executors."""
    path = temporary(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(frame: DataFrame | str) -> None:
    """Deletes what written() wrote, or a temporary path, once nothing that is still to be computed reads it."""
    path = frame if isinstance(frame, str) else frame.__dict__.get("_written_to")
    spark = _TEMPORARY.pop(path, None)
    if spark is not None:
        fs, p, _ = _fs(spark, path)
        fs.delete(p, True)


@atexit.register
def _discard_all() -> None:
    for path in list(_TEMPORARY):
        with contextlib.suppress(Exception):  # the session may be gone
            discard(path)


def ingest(spark: SparkSession, manifest_path: str, fingerprint: str, build, force: bool = False) -> str:
    """Skips when the fingerprint of settings and sources is the stored one and the index is ready, else rebuilds."""
    before = read_manifest(spark, manifest_path)
    if not force and before and before.get("fingerprint") == fingerprint and before.get("status") == "ready":
        return "skipped"
    write_manifest(spark, manifest_path, {"fingerprint": fingerprint, "status": "building"})
    build()
    write_manifest(spark, manifest_path, {"fingerprint": fingerprint, "status": "ready"})
    return "built"


def copy_tables(read, write, tables: list[str], coerce: dict[str, str] | None = None) -> dict[str, int]:
    """Tables in the given (foreign key) order from one store to another, with the columns both have.

    read(name) and write.target(name) give frames, write.append(df, name) writes one. A target with rows is refused, and
    counts are compared after each table.
    """
    done = {}
    for name in tables:
        source, target = read(name), write.target(name)
        if target.take(1):
            raise ValueError(f"{name} is not empty")
        columns = [c for c in target.columns if c in source.columns]
        rows = source.select(*(F.col(c).cast((coerce or {}).get(c, dict(target.dtypes)[c])).alias(c) for c in columns))
        expected = rows.count()
        write.append(rows, name)
        found = write.target(name).count()
        if found != expected:
            raise RuntimeError(f"{name}: {found} of {expected} rows arrived")
        done[name] = found
    return done


class Jdbc:
    """One side of copy_tables() over JDBC; url and properties are the caller's, also the driver's jar."""

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str] | None = None, key: str | None = None, bounds: tuple[int, int, int] | None = None):
        """key and bounds (low, high, partitions): tables are read in ranges of this column."""
        self.spark, self.url, self.properties, self.key, self.bounds = spark, url, properties or {}, key, bounds

    def __call__(self, name: str) -> DataFrame:
        if self.key and self.bounds:
            low, high, parts = self.bounds
            return self.spark.read.jdbc(self.url, name, column=self.key, lowerBound=low, upperBound=high, numPartitions=parts, properties=self.properties)
        return self.spark.read.jdbc(self.url, name, properties=self.properties)

    target = __call__

    def append(self, df: DataFrame, name: str) -> None:
        df.write.jdbc(self.url, name, mode="append", properties=self.properties)

    @contextlib.contextmanager
    def connection(self):
        """A connection of the driver's JVM, for what no frame can say."""
        jvm = self.spark.sparkContext._jvm
        properties = jvm.java.util.Properties()
        for k, v in self.properties.items():
            properties.setProperty(k, v)
        made = jvm.java.sql.DriverManager.getConnection(self.url, properties)
        try:
            yield made
        finally:
            made.close()

    def execute(self, *statements: str) -> None:
        """Statements in one transaction."""
        with self.connection() as c:
            c.setAutoCommit(False)
            try:
                for text in statements:
                    s = c.createStatement()
                    s.execute(text)
                    s.close()
                c.commit()
            except BaseException:
                c.rollback()
                raise

    def in_order(self, tables: list[str]) -> list[str]:
        """The tables so that each comes behind those its foreign keys name, by the database's own catalogue."""
        names, needs = {t.upper(): t for t in tables}, {}
        with self.connection() as c:
            for upper, t in names.items():
                needs[t] = set()
                for name in {t, upper, t.lower()}:
                    keys = c.getMetaData().getImportedKeys(None, None, name)
                    while keys.next():
                        parent = names.get(keys.getString("PKTABLE_NAME").upper())
                        needs[t] |= {parent} - {None, t}
                    keys.close()
        try:
            return list(graphlib.TopologicalSorter(needs).static_order())
        except graphlib.CycleError as e:
            raise ValueError(f"foreign keys go round: {e.args[1]}") from e

    def restart(self, name: str, column: str = "id") -> int:
        """Sets an identity column's next value behind its largest one, and returns it."""
        after = int(self(name).agg(F.max(column)).first()[0] or 0) + 1
        self.execute(f"ALTER TABLE {name} ALTER COLUMN {column} RESTART WITH {after}")
        return after

    @staticmethod
    def sequence_reset(name: str, column: str = "id") -> str:
        """The same for a PostgreSQL serial column, whose sequence is an object of its own; to be given to execute()."""
        return f"SELECT setval(pg_get_serial_sequence('{name}', '{column}'), COALESCE((SELECT MAX({column}) FROM {name}), 0) + 1, false)"


def migrate(source: Jdbc, target: Jdbc, tables: list[str], identities: dict[str, str] | None = None, coerce: dict[str, str] | None = None) -> dict[str, int]:
    """Tables from one database to another in the order of the target's foreign keys, counted one by one; then identity
    columns (table: column) go on behind the copied ones. All targets must be empty before the first is written."""
    order = target.in_order(tables)
    for name in order:
        if target(name).take(1):
            raise ValueError(f"{name} is not empty")
    done = copy_tables(source, target, order, coerce)
    for name, column in (identities or {}).items():
        target.restart(name, column)
    return done


def preflight(vectors: DataFrame, size: int, column: str = "embedding") -> dict[str, int]:
    """How many vectors have another size, a component that is not finite, or only zeros."""
    e, inf = F.col(column), F.lit(float("inf"))
    row = vectors.agg(
        F.count_if(F.coalesce(F.size(e) != size, F.lit(True))).alias("wrong_size"),
        F.count_if(F.coalesce(F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf)), F.lit(False))).alias("not_finite"),
        F.count_if(F.coalesce(~F.exists(e, lambda x: x != 0), F.lit(False))).alias("zero"),
    ).first()
    return row.asDict()


def copy_vectors(source: DataFrame, path: str, size: int, column: str = "embedding") -> int:
    """Vectors written as a whole after a preflight without findings, and counted; raises ValueError or RuntimeError otherwise.
    From a service, see paged.copy_pages()."""
    found = preflight(source, size, column)
    if any(found.values()):
        raise ValueError(f"vectors refused: {found}")
    expected = source.count()
    replace(source, path)
    n = source.sparkSession.read.parquet(path).count()
    if n != expected:
        raise RuntimeError(f"{n} of {expected} vectors arrived")
    return n


def load_records(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Records of JSON lines, of a key that repeats the last by its text; lines that do not fit are refused."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    kept = written(rows, "records")
    if kept.where("_corrupt_record is not null").take(1):
        raise ValueError("a line is no record of this schema")
    own = kept.drop("_corrupt_record")
    return own.groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(*own.columns)).alias("r")).select("r.*")


def write_records(df: DataFrame, path: str) -> None:
    """Records as JSON lines."""
    df.write.mode("overwrite").json(path)
