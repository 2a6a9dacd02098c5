"""Size-tiered shards with a versioned manifest, with DataFrame operations only.

``append`` writes arrivals as small immutable Parquet shards. ``compact`` groups shards of one size
tier (tiers grow by ``fan_in``) into merges of up to ``target`` bytes, and writes each merge as one
file. Every change is a new manifest version: one Parquet file of shards (path, rows, bytes, tier, id
range), written aside and renamed to its number with ``Rename.NONE``, which on HDFS is one atomic
step that fails if the name exists; so one of two writers wins and the other has changed nothing that
readers see. (An object store needs a committer with the same promise.) Readers take the newest
version; old shards stay until ``vacuum``.

A merge plan of one round holds ``MAX_MERGES * MAX_RUN`` shards at most, so it may be broadcast;
what is left waits for the next round, and rounds go on until no tier has a run. A run is ready with
``fan_in`` shards, or with fewer that together are near the target. The manifest has one row of some
hundred bytes for each ``target`` bytes of data, and windows over it are dealt to slots of about
``SLOT`` shards.

Defined results: all rows and columns stay as they are, whatever the columns' names, nulls and
repeated rows included; an empty arrival commits a version without new shards, and a version without
shards is read as an empty table with the columns of the first arrival. Arrivals whose columns differ
from those raise.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loamgrid.plans.session import Scratch

MAX_MERGES, MAX_RUN, SLOT = 2000, 64, 20_000
_SHARD = "path string, bytes long, rows long, tier int, low long, high long, generation int"


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, id_col: str = "doc_id", target: int = 128 << 20, fan_in: int = 4, base: int = 1 << 20):
        self.spark, self.root, self.id_col = spark, root, id_col
        self.target, self.fan_in, self.base = target, fan_in, base
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    # Versions -------------------------------------------------------------------------------

    def version(self) -> int:
        """The newest committed version, 0 before any."""
        at = self._path(f"{self.root}/manifest")
        if not self._fs.exists(at):
            return 0
        names = [x.getPath().getName() for x in self._fs.listStatus(at)]
        return max([0, *(int(n[1:9]) for n in names if n.startswith("v"))])

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if not v:
            return self.spark.createDataFrame([], _SHARD)
        return self.spark.read.schema(_SHARD).parquet(f"{self.root}/manifest/v{v:08d}.parquet")

    def commit(self, shards: DataFrame, after: int) -> int:
        """Makes ``shards`` version ``after + 1``; fails if that number is taken."""
        aside = f"{self.root}/pending/{uuid.uuid4().hex}"
        shards.select(*[x.split()[0] for x in _SHARD.split(", ")]).coalesce(1).write.parquet(aside)
        files = [x.getPath() for x in self._fs.listStatus(self._path(aside)) if x.getPath().getName().endswith(".parquet")]
        if not self._rename(files[0], f"{self.root}/manifest/v{after + 1:08d}.parquet"):
            raise RuntimeError(f"version {after + 1} was committed by another writer")
        self._fs.delete(self._path(aside), True)
        return after + 1

    def _rename(self, file, to: str) -> bool:
        """Gives a file a name that must be free; false if it is taken."""
        hadoop, to = self.spark._jvm.org.apache.hadoop.fs, self._path(to)
        self._fs.mkdirs(to.getParent())
        option = getattr(hadoop, "Options$Rename")
        none = self.spark._sc._gateway.new_array(option, 1)
        none[0] = option.NONE
        try:
            hadoop.FileContext.getFileContext(to.toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(file), self._fs.makeQualified(to), none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    def schema(self, arrivals: DataFrame | None = None) -> StructType:
        """The columns of the first arrival, which ``arrivals`` sets if there was none before."""
        at = f"{self.root}/schema/first.json"
        if arrivals is not None and not self._fs.exists(self._path(at)):
            aside = f"{self.root}/pending/{uuid.uuid4().hex}.json"
            out = self._fs.create(self._path(aside))
            out.write(bytearray(arrivals.schema.json().encode()))
            out.close()
            self._rename(self._path(aside), at)
        return StructType.fromJson(json.loads(self.spark.read.text(at, wholetext=True).first()[0]))

    # Writing --------------------------------------------------------------------------------

    def _tier(self, size: Column) -> Column:
        return F.greatest(F.lit(0), F.floor(F.log(float(self.fan_in), F.greatest(size, F.lit(1)) / self.base))).cast("int")

    def _described(self, at: str, generation: int) -> DataFrame:
        """Manifest rows of the files just written to ``at``, from their own metadata and ids."""
        rows = self.spark.read.schema(self.schema()).parquet(at)
        rows = rows.select(rows[self.id_col].cast("long").alias("i"), rows.metadataColumn("_metadata").alias("m"))
        files = rows.groupBy(F.col("m.file_path").alias("path"), F.col("m.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("rows"), F.min("i").alias("low"), F.max("i").alias("high"))
        return files.withColumn("tier", self._tier(F.col("bytes"))).withColumn("generation", F.lit(generation))

    def append(self, arrivals: DataFrame) -> int:
        """Writes ``arrivals`` as small shards, one per task, and commits them."""
        v, at, known = self.version(), f"{self.root}/data/{uuid.uuid4().hex}", self.schema(arrivals)
        kinds = lambda t: sorted((f.name, f.dataType.simpleString()) for f in t)
        if kinds(known) != kinds(arrivals.schema):
            raise ValueError("the columns differ from those of the first arrival")
        arrivals.write.option("compression", "zstd").parquet(at)
        return self.commit(self.manifest(v).unionByName(self._described(at, 0)), v)

    def plan(self, shards: DataFrame) -> DataFrame:
        """(path, merge): runs of similar shards, small tiers first, up to the target size each."""
        small = shards.filter(F.col("bytes") < self.target * 0.75)
        slots = 1 + small.count() // SLOT
        small = small.withColumn("slot", F.pmod(F.xxhash64("path"), F.lit(slots)))
        of = ["tier", "slot"]
        by = Window.partitionBy(*of).orderBy("low", "path")
        # A run ends at the target size; a tier holds as many shards as its sizes allow, and one row each.
        run = small.withColumn("run", F.floor((F.sum("bytes").over(by) - F.col("bytes") / 2) / self.target))
        # Very small shards: a run is also cut at MAX_RUN shards, so that a round's plan is bounded and always taken whole.
        part = F.floor((F.row_number().over(Window.partitionBy(*of, "run").orderBy("low", "path")) - 1) / MAX_RUN)
        of = [*of, "run", "part"]
        whole = Window.partitionBy(*of)
        sized = run.withColumn("part", part).withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("size", F.sum("bytes").over(whole))
        # The last run of a tier waits for more shards unless it is near the target already.
        ready = sized.filter((F.col("n") >= self.fan_in) | ((F.col("n") > 1) & (F.col("size") >= self.target * 0.75)))
        merge = ready.withColumn("merge", F.dense_rank().over(Window.orderBy(*of)) - 1)  # one row a shard: see above
        return merge.filter(F.col("merge") < MAX_MERGES).select("path", F.col("merge").cast("int").alias("merge"), "generation")

    def compact(self) -> int:
        """One round of merges and its version; the same version if no run is ready."""
        v = self.version()
        shards = self.manifest(v)
        plan = self.plan(shards).persist()
        merges, paths, generation = plan.agg(F.countDistinct("merge"), F.count("path"), F.max("generation")).first()
        if not merges:
            plan.unpersist()
            return v
        at = f"{self.root}/data/{uuid.uuid4().hex}"
        taken = [r["path"] for r in plan.select("path").collect()]  # file names of one bounded round
        # The whole row travels as one column, so no name of the caller's can clash.
        rows = self.spark.read.schema(self.schema()).parquet(*taken)
        rows = rows.select(F.struct("*").alias("row"), rows.metadataColumn("_metadata").getField("file_path").alias("path"))
        placed = rows.join(F.broadcast(plan.select("path", "merge")), "path")
        placed.repartitionById(merges, F.col("merge")).select("row.*").write.option("compression", "zstd").parquet(at)
        kept = shards.join(plan.select("path"), "path", "left_anti")
        out = self.commit(kept.unionByName(self._described(at, generation + 1)), v)
        plan.unpersist()
        return out

    def compact_all(self) -> int:
        """Rounds of ``compact`` until nothing is ready; each round lessens the number of shards."""
        while True:
            before = self.version()
            if self.compact() == before:
                return before

    # Reading --------------------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version. Spark keeps the list of a table's files on the driver, and so does this."""
        paths = [r["path"] for r in self.manifest(version).select("path").toLocalIterator()]
        return self.spark.read.schema(self.schema()).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema())

    def vacuum(self) -> int:
        """Deletes files that the newest version does not name; returns how many."""
        tail = lambda path: tuple(path.split("/")[-2:])  # noqa: E731  folder and file: schemes are spelt in several ways
        live = {tail(r["path"]) for r in self.manifest().select("path").toLocalIterator()}
        gone, at = 0, self._path(f"{self.root}/data")
        for d in self._fs.listStatus(at) if self._fs.exists(at) else []:
            for f in self._fs.listStatus(d.getPath()):
                name = f.getPath().toString()
                if name.endswith(".parquet") and tail(name) not in live:
                    self._fs.delete(f.getPath(), False)
                    gone += 1
        return gone


#: Arrivals of the query; together they are the whole table.
ARRIVALS = 3


def op1_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends ``documents`` in several arrivals, compacts, and reads the committed version back: a digest per row."""
    s = Scratch(spark, "shards")
    store = ShardStore(spark, s.path("store"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    of = F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))
    for k in range(ARRIVALS):
        store.append(docs.filter(of == k))
    store.compact_all()
    store.vacuum()
    out = store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("text_bytes"), F.sha2("text", 256).alias("text_sha256"))
    return s.finish(out)


ORACLE = {"op1_tiered_shards": "SELECT doc_id, lang, source, n_chars, CAST(strlen(text) AS BIGINT) AS text_bytes, sha256(text) AS text_sha256 FROM documents"}
