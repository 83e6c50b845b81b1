"""A store of stages: tables that a run has finished, so that the run goes on where it was stopped.

A stage writes its tables to a folder of its own and is finished by one atomic
rename of a manifest, which names the folder, the tables and their schemas, and a key
over the stage's version and the keys of the stages before it. What a run that was
killed has left without a manifest is never read, and ``sweep`` takes it away. A stage
whose key has changed is built anew, and so are all behind it.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import fixed
from quillon.plans import views as V
from quillon.registry import query
from quillon.sources.tables import new_folder

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    """``build`` makes tables of the tables of all stages before; ``version`` stands for all else that it depends on."""

    name: str
    build: Callable[[Tables], Tables]
    version: str = ""


class StageStore:
    """The stages of one run below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, run: str):
        if not re.fullmatch(fixed.KEY_PATTERNS["run_id"].strip("^$"), run):
            raise ValueError(f"bad name of a run: {run!r}")
        self.spark, self.folder = spark, f"{root.rstrip('/')}/{run}"
        self._jvm = spark.sparkContext._jvm
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _manifest(self, name: str) -> str:
        return f"{self.folder}/manifests/{name}.json"

    def manifest(self, name: str) -> dict | None:
        """What a finished stage says of itself; None if it isn't finished, or the manifest can't be read."""
        path = self._path(self._manifest(name))
        if not self._files.exists(path):
            return None
        stream = self._files.open(path)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except ValueError:
            return None
        return found if isinstance(found, dict) and {"key", "folder", "tables"} <= set(found) else None

    def _commit(self, name: str, manifest: dict) -> None:
        """Write beside, then rename over: readers see the old manifest or the new one."""
        beside = self._path(f"{self._manifest(name)}.{uuid.uuid4().hex}")
        stream = self._files.create(beside, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        target = self._path(self._manifest(name))
        self._files.delete(target, False)
        if not self._files.rename(beside, target):
            raise OSError(f"stage {name} could not be finished")

    def _read(self, manifest: dict) -> Tables:
        schemas = {t: T.StructType.fromJson(s) for t, s in manifest["tables"].items()}
        return {t: self.spark.read.schema(s).parquet(f"{self.folder}/{manifest['folder']}/{t}") for t, s in schemas.items()}

    def run(self, stages: Iterable[Stage]) -> tuple[Tables, list[str]]:
        """The tables of all stages, and the names of those that were built now; the others were read."""
        tables: Tables = {}
        built, key = [], ""
        for stage in stages:
            key = hashlib.sha256(json.dumps([key, stage.name, stage.version]).encode()).hexdigest()
            manifest = self.manifest(stage.name)
            if not manifest or manifest["key"] != key:
                manifest = self._build(stage, key, tables)
                built.append(stage.name)
            own = self._read(manifest)
            if double := set(own) & set(tables):
                raise ValueError(f"stage {stage.name} makes {', '.join(sorted(double))} again")
            tables |= own
        return tables, built

    def _build(self, stage: Stage, key: str, before: Tables) -> dict:
        folder = f"{stage.name}-{uuid.uuid4().hex}"
        schemas = {}
        for name, table in stage.build(dict(before)).items():
            table.write.parquet(f"{self.folder}/{folder}/{name}")
            schemas[name] = json.loads(table.schema.json())
        manifest = {"key": key, "folder": folder, "tables": schemas}
        self._commit(stage.name, manifest)
        return manifest

    def sweep(self) -> list[str]:
        """Delete folders that no manifest names; call it while no run writes."""
        if not self._files.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(self.folder))]
        done = self._path(f"{self.folder}/manifests")
        finished = [s.getPath().getName() for s in self._files.listStatus(done)] if self._files.exists(done) else []
        kept = {m["folder"] for f in finished if f.endswith(".json") and (m := self.manifest(f[:-5]))}
        gone = sorted(n for n in names if n != "manifests" and n not in kept)
        for name in gone:
            self._files.delete(self._path(f"{self.folder}/{name}"), True)
        return gone


@query("store_stages", "", """WITH f AS (SELECT o_custkey AS repo, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS failed FROM orders GROUP BY 1)
SELECT repo, n, CASE WHEN failed * 2 >= n THEN 'fail' WHEN failed > 0 THEN 'partial' ELSE 'pass' END AS verdict, 'evaluate' AS built FROM f""")
def store_stages(spark, sf_dir):
    """Two stages, the second of which fails at first: the rerun reads the first stage's table and builds the second only."""
    store, tries = StageStore(spark, new_folder(spark, "stages"), "run-1"), []

    def facts(before: Tables) -> Tables:
        orders = V.table(spark, sf_dir, "orders")
        return {"facts": orders.groupBy(F.col("o_custkey").alias("repo")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"))}

    def verdicts(before: Tables) -> Tables:
        tries.append(1)
        if len(tries) == 1:
            raise RuntimeError("stopped")
        verdict = F.when(F.col("failed") * 2 >= F.col("n"), "fail").when(F.col("failed") > 0, "partial").otherwise("pass")
        return {"verdicts": before["facts"].select("repo", "n", verdict.alias("verdict"))}

    stages = [Stage("facts", facts), Stage("evaluate", verdicts)]
    try:
        store.run(stages)
    except RuntimeError:
        pass
    tables, built = store.run(stages)
    return tables["verdicts"].withColumn("built", F.lit(",".join(built)))
