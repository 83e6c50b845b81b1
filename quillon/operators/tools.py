"""The tables behind the reading tools: folder listings, pages of a file, and facts by kind and path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import exprs as E
from quillon.plans import views as V
from quillon.registry import query

LISTED, PAGE_LINES, PAGE_BYTES, LINE_CHARS = 200, 200, 24 * 1024, 2000


def list_dir(files: DataFrame, folder: str, depth: int) -> DataFrame:
    """(path, files, total): folders (with the files below them) and files down to ``depth`` levels, the first 200 by path; ``files`` is null for a file."""
    prefix = f"{folder}/" if folder else ""
    below = files.filter(F.col("path").startswith(prefix)).select("path", F.split(F.substring("path", F.lit(len(prefix) + 1), F.length("path")), "/").alias("parts"))
    own = below.filter(F.size("parts") <= depth).select("path", F.lit(None).cast("long").alias("files"))
    levels = F.when(F.size("parts") > 1, F.sequence(F.lit(1), F.least(F.size("parts") - 1, F.lit(depth))))
    folders = below.select(F.explode(levels).alias("k"), "parts").select(F.concat(F.lit(prefix), F.array_join(F.slice("parts", 1, F.col("k")), "/")).alias("path"))
    rows = folders.groupBy("path").agg(F.count("*").alias("files")).unionByName(own)
    return rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total")))).orderBy("path").limit(LISTED)


@query("tool_list_dir", "files", f"""WITH b AS (SELECT path, string_split(substr(path, 5), '/') AS parts FROM files WHERE path LIKE 'src/%'),
r AS (SELECT 'src/' || array_to_string(parts[1:k], '/') AS path, count(*) AS files FROM (SELECT parts, unnest(range(1, least(len(parts) - 1, 3) + 1)) AS k FROM b) GROUP BY 1 UNION ALL SELECT path, NULL FROM b WHERE len(parts) <= 3)
SELECT path, files, (SELECT count(*) FROM r) AS total FROM r ORDER BY path LIMIT {LISTED}""")
def tool_list_dir(spark, sf_dir):
    return list_dir(V.files(spark, sf_dir).select("path"), "src", 3)


def read_page(lines: DataFrame, start: Column, end: Column) -> DataFrame:
    """(path, first, last, total, truncated): the lines that a page shows: 200 at most, of 24 KB with numbers in front, the first one always."""
    shown = F.when(F.length("line") > LINE_CHARS, F.concat(F.substring("line", 1, LINE_CHARS), F.lit(" …[line truncated]"))).otherwise(F.col("line"))
    totals = lines.groupBy("path").agg(F.max("line_no").alias("total"))
    asked = lines.join(totals, "path").withColumn("first", F.greatest(F.lit(1), start)).withColumn("wanted", F.least(end, F.col("total")))
    asked = asked.filter((F.col("line_no") >= F.col("first")) & (F.col("line_no") <= F.least(F.col("wanted"), F.col("first") + PAGE_LINES - 1)))
    width = F.greatest(F.lit(4), F.length(F.least(F.col("wanted"), F.col("first") + PAGE_LINES - 1).cast("string")))
    size = F.sum(F.octet_length(shown) + width + 5).over(Window.partitionBy("path").orderBy("line_no"))  # the rule, a space and a line break
    kept = asked.withColumn("size", size).filter((F.col("size") <= PAGE_BYTES) | (F.col("line_no") == F.col("first")))
    return kept.groupBy("path", "first", "total", "wanted").agg(F.max("line_no").alias("last")).select("path", "first", "last", "total", (F.col("last") < F.col("wanted")).alias("truncated"))


@query("tool_read_file", "lines", f"""WITH t AS (SELECT path, max(line_no) AS total FROM lines GROUP BY 1),
a AS (SELECT l.path, line_no, total, least(1000, total) AS wanted, CASE WHEN length(line) > {LINE_CHARS} THEN substr(line, 1, {LINE_CHARS}) || ' …[line truncated]' ELSE line END AS shown FROM lines l JOIN t ON t.path = l.path WHERE line_no >= 2 AND line_no <= least(least(1000, total), 2 + {PAGE_LINES} - 1)),
s AS (SELECT *, sum(octet_length(encode(shown)) + greatest(4, length(least(wanted, {PAGE_LINES + 1})::VARCHAR)) + 5) OVER (PARTITION BY path ORDER BY line_no) AS size FROM a)
SELECT path, 2 AS first, max(line_no) AS last, total, max(line_no) < wanted AS truncated FROM s WHERE size <= {PAGE_BYTES} OR line_no = 2 GROUP BY path, total, wanted""")
def tool_read_file(spark, sf_dir):
    """Lines 2 to 1000 of every file."""
    lines = V.lines(spark, sf_dir).select("path", "line_no", "line")
    return read_page(lines, F.lit(2), F.lit(1000))


def get_facts(facts: DataFrame, kind: str, glob: str, limit: int = 20) -> DataFrame:
    """(fact_id, path, matching): the first facts of a kind whose path fits a glob, by id, and how many there are; between 1 and 100 of them."""
    found = facts.filter((F.col("kind") == kind) & F.col("path").rlike(E.glob_regex(glob)))
    total = found.agg(F.count("*").alias("matching"))
    return found.orderBy("fact_id").limit(max(1, min(100, limit))).crossJoin(F.broadcast(total)).select("fact_id", "path", "matching")


@query("tool_get_facts", "files", """WITH f AS (SELECT doc_id AS fact_id, path FROM files WHERE doc_id % 3 = 1 AND regexp_matches(path, '^src/([^/]+/)*[^/]*\\.py$'))
SELECT fact_id, path, (SELECT count(*) FROM f) AS matching FROM f ORDER BY fact_id LIMIT 100""")
def tool_get_facts(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 3 == 1, "route").otherwise("secret")
    return get_facts(V.files(spark, sf_dir).select(F.col("doc_id").alias("fact_id"), "path", kind.alias("kind")), "route", "src/**/*.py", 500)


def render_facts(facts: DataFrame, budget: int = PAGE_BYTES) -> DataFrame:
    """Facts (group, ord, row) as far as their rows fit the budget in bytes, the first of a group always."""
    size = F.sum(F.octet_length("row") + 1).over(Window.partitionBy("group").orderBy("ord"))
    return facts.withColumn("size", size).withColumn("rn", F.row_number().over(Window.partitionBy("group").orderBy("ord"))).filter((F.col("size") <= budget) | (F.col("rn") == 1)).drop("size", "rn")


@query("tool_render_facts", "", """SELECT grp AS "group", count(*) AS shown FROM (SELECT *, sum(octet_length(encode(text)) + 1) OVER (PARTITION BY grp ORDER BY doc_id) AS size, row_number() OVER (PARTITION BY grp ORDER BY doc_id) AS rn FROM (SELECT doc_id, text, (doc_id % 20)::INTEGER AS grp FROM documents))
WHERE size <= 24576 OR rn = 1 GROUP BY grp""")
def tool_render_facts(spark, sf_dir):
    rows = V.table(spark, sf_dir, "documents").select((F.col("doc_id") % 20).cast("int").alias("group"), F.col("doc_id").alias("ord"), F.col("text").alias("row"))
    return render_facts(rows).groupBy("group").agg(F.count("*").alias("shown"))
