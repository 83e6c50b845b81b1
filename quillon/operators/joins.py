"""Joins by interval, pattern, prefix, ancestor folder and containment, as equi-joins wherever a key can be found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans import views as V
from quillon.registry import query


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def overlap_join(left: DataFrame, right: DataFrame, width: int = 64) -> DataFrame:
    """Pairs of (path, start, end) rows that overlap: equal path and bin, then the exact test.

    Each row goes to every bin of ``width`` lines that it touches; a pair counts in
    the first bin both touch, so none repeats and no path becomes one hot key.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(s / width), F.floor(e / width)))
    a = left.withColumn("bin", bins(F.col("start"), F.col("end")))
    b = right.select("path", F.col("start").alias("r_start"), F.col("end").alias("r_end"), *[c for c in right.columns if c not in ("path", "start", "end")]).withColumn("bin", bins(F.col("r_start"), F.col("r_end")))
    hit = overlaps(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")) & (F.col("bin") == F.greatest(F.floor(F.col("start") / width), F.floor(F.col("r_start") / width)))
    return a.join(b, ["path", "bin"]).filter(hit).drop("bin")


def count_overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """The left rows that overlap any right one, with the number ``n`` of those; equal ranges of either side are joined once, by their count."""
    ranges = ["path", "start", "end"]
    counted = right.groupBy(*ranges).agg(F.count("*").alias("n"))
    return left.join(overlap_join(left.select(*ranges).distinct(), counted).groupBy(*ranges).agg(F.sum("n").alias("n")), ranges)


@query("join_range_overlap", "findings", """SELECT a.run, a.check_id, count(*) AS n_changed FROM (SELECT run, check_id, path_no AS path, start_line AS s, start_line + 10 AS e FROM findings) a
JOIN (SELECT o_orderkey % 50 AS path, o_custkey % 97 + 1 AS s, o_custkey % 97 + 1 + o_orderkey % 30 AS e FROM orders) c ON a.path = c.path AND a.s <= c.e AND c.s <= a.e GROUP BY 1, 2""")
def join_range_overlap(spark, sf_dir):
    cited = V.findings(spark, sf_dir).select("run", "check_id", F.col("path_no").cast("long").alias("path"), F.col("start_line").cast("long").alias("start"), (F.col("start_line") + 10).cast("long").alias("end"))
    start = F.col("o_custkey") % 97 + 1
    changed = V.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("path"), start.alias("start"), (start + F.col("o_orderkey") % 30).alias("end"))
    return count_overlaps(cited, changed).select("run", "check_id", F.col("n").alias("n_changed"))


def first_line_match(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(path, pattern, line_no): the first line of each path that each pattern matches; patterns are few and go into one pass."""
    return lines.select("path", *(F.when(F.col("line").rlike(p), F.col("line_no")).alias(n) for n, p in patterns.items())).groupBy("path").agg(*(F.min(n).alias(n) for n in patterns)).unpivot(["path"], list(patterns), "pattern", "line_no").filter("line_no IS NOT NULL")


@query("join_first_line_match", "lines", """SELECT path, pattern, min(line_no) AS line_no FROM lines JOIN (VALUES ('token', 'token = "[0-9a-f]+"'), ('license', 'MIT|Apache'), ('digit', '[0-9]{6,}')) p(pattern, re) ON regexp_matches(line, re) GROUP BY 1, 2""")
def join_first_line_match(spark, sf_dir):
    return first_line_match(V.lines(spark, sf_dir), {"token": 'token = "[0-9a-f]+"', "license": "MIT|Apache", "digit": "[0-9]{6,}"})


def prefix_join(names: DataFrame, prefixes: DataFrame, ends: str = r"[./-]") -> DataFrame:
    """(name, prefix) where the name is the prefix or goes on with a separator: every prefix of the name is a key."""
    parts = F.split(F.lower("name"), f"(?={ends})")
    tried = names.withColumn("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), ""))))
    return tried.join(prefixes.withColumn("key", F.lower("prefix")), "key").drop("key")


@query("join_prefix_detect", "files", """SELECT path AS name, prefix FROM files JOIN (VALUES ('src/src1'), ('SRC/src2/en'), ('tests'), ('vendor/src3')) p(prefix)
ON lower(path) = lower(prefix) OR starts_with(lower(path), lower(prefix) || '/') OR starts_with(lower(path), lower(prefix) || '.') OR starts_with(lower(path), lower(prefix) || '-')""")
def join_prefix_detect(spark, sf_dir):
    names = ("src/src1", "SRC/src2/en", "tests", "vendor/src3")
    prefixes = spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("prefix"))
    return prefix_join(V.files(spark, sf_dir).select(F.col("path").alias("name")), F.broadcast(prefixes)).select("name", "prefix")


@query("join_semi_unconfirmed", "findings", "SELECT run, check_id FROM findings f WHERE verdict = 'fail' AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey % 50 = f.path_no AND o.o_orderstatus = 'P')")
def join_semi_unconfirmed(spark, sf_dir):
    """Resolved issues none of whose cited files was touched."""
    touched = V.table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select((F.col("o_orderkey") % 50).cast("int").alias("path_no")).distinct()
    return V.findings(spark, sf_dir).filter("verdict = 'fail'").join(touched, "path_no", "left_anti").select("run", "check_id")


@query("join_anti_unseen_lines", "", """WITH cited AS (SELECT conv_id, unnest(range(0, conv_id % 7 + 2)) AS line FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT conv_id, line::INTEGER AS line FROM cited c WHERE NOT EXISTS (SELECT 1 FROM conversations v WHERE v.conv_id = c.conv_id AND v.turn = c.line)""")
def join_anti_unseen_lines(spark, sf_dir):
    """Cited lines that the session never saw."""
    seen = V.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("line"))
    cited = seen.select("conv_id").distinct().withColumn("line", F.explode(F.sequence(F.lit(0), (F.col("conv_id") % 7 + 1).cast("int"))))
    return cited.join(seen, ["conv_id", "line"], "left_anti")


def ancestors(path: Column) -> Column:
    """The path's folders, from its own up to the root ('')."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


@query("join_ancestor_lockfile", "files", """WITH m AS (SELECT path FROM files WHERE ext = '.py'), l AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir FROM files WHERE ext = '.json')
SELECT path, EXISTS (SELECT 1 FROM l WHERE starts_with(m.path, l.dir || '/')) AS locked FROM m""")
def join_ancestor_lockfile(spark, sf_dir):
    """Manifests with a lockfile in their folder or above."""
    files = V.files(spark, sf_dir)
    manifests = files.filter("ext = '.py'").select("path")
    locks = files.filter("ext = '.json'").select(F.regexp_replace("path", "/[^/]*$", "").alias("dir")).distinct().withColumn("locked", F.lit(True))
    return manifests.withColumn("dir", F.explode(ancestors(F.col("path")))).join(locks, "dir", "left").groupBy("path").agg(F.coalesce(F.bool_or("locked"), F.lit(False)).alias("locked"))


def absence_probes(lines: DataFrame, probes: dict[str, tuple[str, str]], most: int = 10) -> DataFrame:
    """(probe, path, line_no): the first ``most`` hits of each (path regex, line regex) probe."""
    hits = lines.select("path", "line_no", F.explode(F.array_compact(F.array(*(F.when(F.col("path").rlike(p) & F.col("line").rlike(q), F.lit(n)) for n, (p, q) in probes.items())))).alias("probe"))
    order = Window.partitionBy("probe").orderBy("path", "line_no")
    return hits.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most).drop("rn")


@query("join_absence_probe", "lines", """SELECT probe, path, line_no FROM (SELECT probe, path, line_no, row_number() OVER (PARTITION BY probe ORDER BY path, line_no) AS rn FROM lines
JOIN (VALUES ('secret', '^src/', 'token = '), ('license', '.', 'MIT|Apache'), ('none', '^src/', 'zzzzzz')) p(probe, pre, re) ON regexp_matches(path, pre) AND regexp_matches(line, re)) WHERE rn <= 10""")
def join_absence_probe(spark, sf_dir):
    return absence_probes(V.lines(spark, sf_dir), {"secret": ("^src/", "token = "), "license": (".", "MIT|Apache"), "none": ("^src/", "zzzzzz")})
