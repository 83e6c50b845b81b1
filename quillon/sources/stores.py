"""File profiles, content hashes, caches, jobs and quotas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import exprs as E
from quillon.functions import fixed
from quillon.plans import views as V
from quillon.registry import query


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, content) of all regular files below ``root`` but for .git, by Spark's binary reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.filter(~F.col("path").contains("/.git/")).select(F.regexp_replace("path", "^.*?" + root.rstrip("/").replace("file://", "") + "/", "").alias("path"), F.col("length").alias("size"), "content")


def profile_files(files: DataFrame, largest: int = 2_000_000) -> DataFrame:
    """(path, size, sha256, loc, is_binary, too_large, readable); files that are too large are neither hashed nor read."""
    large = F.col("size") > largest
    binary = F.instr(F.substring("text", 1, 8192), "\0") > 0
    return files.select("path", "size", F.when(~large, F.sha2("text", 256)).alias("sha256"), F.when(large, 0).otherwise(F.size(E.split_lines(F.col("text")))).cast("int").alias("loc"), (~large & binary).alias("is_binary"), large.alias("too_large")).withColumn("readable", ~F.col("is_binary") & ~F.col("too_large"))


@query("src_file_profile", "files", r"""SELECT path, size, CASE WHEN size <= 2000000 THEN sha256(text) END AS sha256, CASE WHEN size > 2000000 THEN 0 ELSE len(string_split_regex(text, '\r\n|\n|\r')) END::INTEGER AS loc, false AS is_binary, size > 2000000 AS too_large, size <= 2000000 AS readable FROM files""")
def src_file_profile(spark, sf_dir):
    return profile_files(V.files(spark, sf_dir))


def content_id(files: DataFrame, *keys: str) -> DataFrame:
    """The first 40 hex digits of a hash over the sorted paths and file hashes of each key; texts are hashed before they are gathered.

    A key is one snapshot, which the limits on reading keep to 30 000 lines of a path and a hash.
    """
    line = F.concat(F.col("path"), F.lit("|"), F.sha2("text", 256), F.lit("\n"))
    return files.select(*keys, line.alias("line")).groupBy(*keys).agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), ""), 256), 1, 40).alias("content_id"))


@query("src_content_id", "files", "SELECT split_part(path, '/', 2) AS source, substr(sha256(string_agg(path || '|' || sha256(text) || chr(10), '' ORDER BY path)), 1, 40) AS content_id FROM files GROUP BY 1")
def src_content_id(spark, sf_dir):
    return content_id(V.files(spark, sf_dir).withColumn("source", F.split_part("path", F.lit("/"), F.lit(2))), "source")


@query("src_lines", "lines", "SELECT path, line_no, length(line) AS n FROM lines")
def src_lines(spark, sf_dir):
    return V.lines(spark, sf_dir).select("path", "line_no", F.length("line").alias("n"))


def language_of(path: Column) -> Column:
    """By name, then Dockerfile forms, then suffix; null if unknown."""
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    return F.coalesce(E.choose(name, fixed.NAME_LANGUAGES), F.when(name.rlike(r"^Dockerfile\.|.\.Dockerfile$"), "dockerfile"), E.choose(suffix, fixed.SUFFIX_LANGUAGES))


@query("src_language", "files", r"""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'dockerfile' WHEN doc_id % 14 = 0 THEN 'make' ELSE language END AS language FROM files""")
def src_language(spark, sf_dir):
    path = F.when(F.col("doc_id") % 9 == 0, F.concat("path", F.lit("/Dockerfile.dev"))).when(F.col("doc_id") % 14 == 0, F.concat("path", F.lit("/Makefile"))).otherwise(F.col("path"))
    return V.files(spark, sf_dir).select("doc_id", language_of(path).alias("language"))


def snippet_hash(text: Column, start: Column, end: Column, most: int = 60) -> Column:
    """SHA-256 of a range of lines, clipped to the file and ``most`` lines, without trailing spaces."""
    lines = E.split_lines(text)
    last = F.least(end, start + most - 1, F.size(lines))
    return F.sha2(F.array_join(F.transform(F.slice(lines, start, F.greatest(F.lit(0), last - start + 1)), lambda x: F.rtrim(x)), "\n"), 256)


@query("fn_snippet_hash", "files", r"""SELECT path, sha256(array_to_string(list_transform(p[s:least(s + 9, len(p))], lambda x: rtrim(x, ' ')), chr(10))) AS h FROM (SELECT path, string_split_regex(text, '\r\n|\n|\r') AS p, (doc_id % 3 + 1)::INTEGER AS s FROM files) WHERE s <= len(p)""")
def fn_snippet_hash(spark, sf_dir):
    s = (F.col("doc_id") % 3 + 1).cast("int")
    return V.files(spark, sf_dir).filter(s <= F.size(E.split_lines(F.col("text")))).select("path", snippet_hash(F.col("text"), s, s + 9).alias("h"))


def cache_lookup(entries: DataFrame, now: Column) -> DataFrame:
    """The latest live entry of each (namespace, key); an expired latest entry is a miss."""
    last = entries.groupBy("namespace", "key").agg(F.max(F.struct("ord", "value", "expires_at")).alias("x")).select("namespace", "key", "x.value", "x.expires_at")
    return last.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now)).drop("expires_at")


@query("store_cache_lookup", "", """SELECT namespace, key, value FROM (SELECT event_type AS namespace, user_id AS key, event_id AS value, CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 3 DAY END AS expires_at,
row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-31')""")
def store_cache_lookup(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("namespace"), F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("ord"), F.col("event_id").alias("value"), F.when(F.col("event_id") % 3 != 0, F.expr("ts + INTERVAL 3 DAYS")).alias("expires_at"))
    return cache_lookup(rows, F.lit("2024-01-31").cast("timestamp"))


@query("store_jobs_by_key", "", "SELECT event_id, user_id FROM events WHERE user_id = 8 AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts")
def store_jobs_by_key(spark, sf_dir):
    """Jobs of a key since a time; both conditions reach the scan."""
    return V.table(spark, sf_dir, "events").filter("user_id = 8 AND ts >= TIMESTAMP '2024-01-10'").orderBy("ts").select("event_id", "user_id")


def quota(jobs: DataFrame, since: Column, daily: int, concurrent: int) -> DataFrame:
    """(key, recent, active, allowed) by key over the last day."""
    counts = jobs.filter(F.col("ts") >= since).groupBy("key").agg(F.count("*").alias("recent"), F.count_if(F.col("state").isin("queued", "running")).alias("active"))
    return counts.withColumn("allowed", (F.col("recent") < daily) & (F.col("active") < concurrent))


@query("store_quota", "", """SELECT key, recent, active, recent < 4 AND active < 2 AS allowed FROM (SELECT user_id AS key, count(*) AS recent, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS active FROM events WHERE ts >= TIMESTAMP '2024-01-30' GROUP BY 1)""")
def store_quota(spark, sf_dir):
    state = F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "view", "running").otherwise("done")
    jobs = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", state.alias("state"))
    return quota(jobs, F.lit("2024-01-30").cast("timestamp"), 4, 2)


def _artifact(spark: SparkSession, root: str, run: str, name: str):
    """The Hadoop file system and path of a run's artifact; names are checked, so that none leads out of its folder."""
    for kind, value in (("run_id", run), ("artifact", name)):
        if not re.fullmatch(fixed.KEY_PATTERNS[kind], value):
            raise ValueError(f"invalid {kind}: {value!r}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{run}/{name}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def put_artifact(spark: SparkSession, root: str, run: str, name: str, data: bytes) -> None:
    """Store bytes under a run; they appear whole or not at all."""
    fs, path = _artifact(spark, root, run, name)
    part = path.suffix(".part")
    out = fs.create(part, True)
    out.write(bytearray(data))
    out.close()
    fs.delete(path, False)
    fs.rename(part, path)


def get_artifact(spark: SparkSession, root: str, run: str, name: str) -> bytes | None:
    """The bytes, or None if there are none."""
    fs, path = _artifact(spark, root, run, name)
    if not fs.exists(path):
        return None
    return bytes(spark.read.format("binaryFile").load(path.toString()).select("content").first()[0])


def list_artifacts(spark: SparkSession, root: str, run: str) -> list[str]:
    """The names of a run's artifacts, in order."""
    fs, path = _artifact(spark, root, run, "x")
    folder = path.getParent()
    return sorted(s.getPath().getName() for s in fs.listStatus(folder) if not s.getPath().getName().endswith(".part")) if fs.exists(folder) else []
