"""Text functions: nouns, Markdown, boundaries, estimates, tokens, paths, hashed vectors and cache keys; all are columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.plans import views as V
from quillon.plans.cases import cases, cases_sql
from quillon.registry import query


def plural(count: Column, noun: Column) -> Column:
    """A count and its noun: y after a consonant becomes ies, anything else gets an s, one stays."""
    many = F.when(noun.rlike("[^aeou]y$"), F.concat(F.regexp_replace(noun, "y$", ""), F.lit("ies"))).otherwise(F.concat(noun, F.lit("s")))
    return F.concat_ws(" ", count.cast("string"), F.when(count == 1, noun).otherwise(many))


_NOUNS = [(0, "dependency", "0 dependencies"), (1, "dependency", "1 dependency"), (2, "key", "2 keys"), (3, "file", "3 files"), (2, "array", "2 arrays"), (5, "query", "5 queries"), (2, "toy", "2 toys"), (2, "guy", "2 guys")]


@query("fn_plural", "", cases_sql(len(_NOUNS), "VARCHAR phrase", [(k, want) for k, (_, _, want) in enumerate(_NOUNS)]))
def fn_plural(spark, sf_dir):
    return cases(spark, sf_dir, [row[:2] for row in _NOUNS], "n long, noun string").select("id", plural(F.col("n"), F.col("noun")).alias("phrase"))


def markdown_text(text: Column) -> Column:
    """One line of Markdown that holds no HTML and is safe in a table cell."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.replace(F.replace(F.replace(F.replace(line, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("|"), F.lit("\\|"))


@query("fn_markdown", "", r"""SELECT page_id, sha256(replace(replace(replace(replace(trim(regexp_replace(html, '\s+', ' ', 'g')), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '|', '\|')) AS line_sha256 FROM pages""")
def fn_markdown(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", F.sha2(markdown_text(F.col("html")), 256).alias("line_sha256"))


def fence(snippet: Column) -> Column:
    """A fence of backticks longer than any run of them in the snippet, three at least."""
    runs = F.transform(F.regexp_extract_all(snippet, F.lit("(`+)"), F.lit(1)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


_FENCES = [("", 3), ("x = 1", 3), ("a `b` c", 3), ("```py\nx\n```", 4), ("`````", 6), ("`` ` ```", 4)]


@query("fn_fence", "", cases_sql(len(_FENCES), "VARCHAR fence", [(k, "`" * n) for k, (_, n) in enumerate(_FENCES)]))
def fn_fence(spark, sf_dir):
    return cases(spark, sf_dir, [(t,) for t, _ in _FENCES], "snippet string").select("id", fence(F.col("snippet")).alias("fence"))


def without(text: Column, token: str) -> Column:
    """``text`` without any copy of the token, also of those that taking out others makes; at most one round for each token's length."""
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.length(text) / len(token)).cast("int")))
    return F.when(F.contains(text, F.lit(token)), F.aggregate(rounds, text, lambda t, _: F.replace(t, F.lit(token), F.lit("")))).otherwise(text)


def data_block(text: Column, source: Column, boundary: str) -> Column:
    """Untrusted text as a delimited block that it cannot close."""
    label = F.replace(F.replace(without(source, boundary), F.lit('"'), F.lit("'")), F.lit("\n"), F.lit(" "))
    return F.concat(F.lit(f'<repo_data boundary="{boundary}" source="'), label, F.lit('">\n'), without(text, boundary), F.lit(f'\n</repo_data boundary="{boundary}">'))


_B = "b-0123456789ab"
_BLOCKS = [("plain", "a.py", "plain", "a.py"), (f"x{_B}y", f'q"{_B}\n', "xy", "q' "), ("b-0123" + _B + "456789ab!", "s", "!", "s"), (_B * 3, _B, "", ""), ("b-01" + "b-0123" + _B + "456789ab" + "23456789ab", "s", "", "s")]


@query("fn_data_block", "", f"""SELECT id, '<repo_data boundary="{_B}" source="' || s || '">' || chr(10) || t || chr(10) || '</repo_data boundary="{_B}">' AS block FROM ({cases_sql(len(_BLOCKS), "VARCHAR t, VARCHAR s", [(k, t, s) for k, (_, _, t, s) in enumerate(_BLOCKS)])})""")
def fn_data_block(spark, sf_dir):
    return cases(spark, sf_dir, [row[:2] for row in _BLOCKS], "t string, s string").select("id", data_block(F.col("t"), F.col("s"), _B).alias("block"))


def token_estimate(text: Column) -> Column:
    """Tokens at three and a half characters each, rounded up; 0 for an empty text."""
    return F.ceil(F.length(text) * 2 / 7).cast("long")


@query("fn_token_estimate", "", "SELECT conv_id, turn, ceil(length(text) * 2 / 7.0)::BIGINT AS tokens FROM conversations")
def fn_token_estimate(spark, sf_dir):
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", token_estimate(F.col("text")).alias("tokens"))


def identifier_words(text: Column) -> Column:
    """Lower-case words, identifiers being split at underscores and at capitals."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z][a-z]+|[A-Z]+(?![a-z])|\d+)"), F.lit(1)), F.lower)


def search_words(text: Column) -> Column:
    """Words of two letters or more, of any script, that a search can ask for; signs of query languages are left out."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(\w{2,})"), F.lit(1))


_WORDS = [
    ("parseHTTPResponse2", "parse,http,response,2", "parseHTTPResponse2"), ("snake_case_name", "snake,case,name", "snake_case_name"), ('a "b" OR cd* NEAR(x, yz)', "or,cd,near,yz", "OR,cd,NEAR,yz"), ("XMLParser", "xml,parser", "XMLParser"),
    ("naïve café", "na,ve,caf", "naïve,café"), ("", "", ""), ("ID", "id", "ID"),
]


@query("fn_words", "", cases_sql(len(_WORDS), "VARCHAR identifier, VARCHAR search", [(k, a, b) for k, (_, a, b) in enumerate(_WORDS)]))
def fn_words(spark, sf_dir):
    rows = cases(spark, sf_dir, [(t,) for t, _, _ in _WORDS], "text string")
    return rows.select("id", F.array_join(identifier_words(F.col("text")), ",").alias("identifier"), F.array_join(search_words(F.col("text")), ",").alias("search"))


def normal_path(path: Column) -> Column:
    """A relative path without dots and empty parts; parts that lead above the root stay."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = lambda done, p: F.when((p == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("")), done), -1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")


def js_target(path: Column, target: Column) -> Column:
    """What an import names: a path below the root without extension or index, or the package of a module."""
    folder = F.regexp_replace(path, "[^/]*$", "")
    own = F.regexp_replace(F.regexp_replace(normal_path(F.concat(folder, target)), r"/index$", ""), r"(\.ts|\.tsx|\.js|\.jsx|\.mjs|\.cjs)$", "")
    package = F.when(target.startswith("@"), F.regexp_extract(target, r"^(@[^/]*(?:/[^/]*)?)", 1)).otherwise(F.element_at(F.split(target, "/"), 1))
    return F.when(target.startswith("."), own).when(target.startswith("@/") | target.startswith("~/"), target).otherwise(package)


JS_IMPORT = r"(?:\bimport\s+(?:[\w*{}\s,$]+?\s+from\s+)?|\bexport\s+[\w*{}\s,$]+?\s+from\s+|\brequire\(\s*|\bimport\(\s*)['\"]([^'\"]+)['\"]"


def js_edges(files: DataFrame) -> DataFrame:
    """import_edge rows (keys, path, from_module, to_module, internal) of JavaScript and TypeScript files (keys, path, text)."""
    keys = [c for c in files.columns if c not in ("path", "text")]
    found = files.select(*keys, "path", F.explode(F.regexp_extract_all("text", F.lit(JS_IMPORT), F.lit(1))).alias("target"))
    internal = F.col("target").startswith(".") | F.col("target").startswith("@/") | F.col("target").startswith("~/")
    edges = found.select(*keys, "path", F.regexp_replace("path", r"\.[^.]*$", "").alias("from_module"), js_target(F.col("path"), F.col("target")).alias("to_module"), internal.alias("internal"))
    return edges.groupBy(*keys, "path", "from_module", "to_module").agg(F.bool_or("internal").alias("internal"))


_JS = [
    ("src/app/main.ts", "import a from './x';\nimport {b,\n c} from \"../lib/index\"\nconst d = require('lodash/fp');\nexport * from '@scope/pkg/deep';\nimport '@/util';\nawait import('./y.js')\nimport a2 from './x.ts'"),
    ("index.js", "import '../../up'\nexport const q = 'import';"),
]
_JS_EDGES = [
    (0, "src/app/main.ts", "src/app/main", "src/app/x", True), (0, "src/app/main.ts", "src/app/main", "src/lib", True), (0, "src/app/main.ts", "src/app/main", "lodash", False), (0, "src/app/main.ts", "src/app/main", "@scope/pkg", False),
    (0, "src/app/main.ts", "src/app/main", "@/util", True), (0, "src/app/main.ts", "src/app/main", "src/app/y", True), (1, "index.js", "index", "../../up", True),
]


@query("fact_js_edges", "", cases_sql(len(_JS), "VARCHAR path, VARCHAR from_module, VARCHAR to_module, BOOLEAN internal", _JS_EDGES))
def fact_js_edges(spark, sf_dir):
    return js_edges(cases(spark, sf_dir, _JS, "path string, text string").drop("case"))


def hashed_vector(words: Column, dims: int = 256) -> Column:
    """Signed counts of hashed words, as a map from bucket to count: the first four bytes of a word's SHA-1 give the bucket, the fifth the sign."""

    def one(word: Column) -> Column:
        digest = F.sha1(word)
        bytes_ = [F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("long") for i in range(5)]
        bucket = (bytes_[0] + bytes_[1] * 256 + bytes_[2] * 65536 + bytes_[3] * 16777216) % dims
        return F.struct(bucket.cast("int").alias("bucket"), F.when(bytes_[4] % 2 == 1, 1).otherwise(-1).alias("sign"))

    return F.transform(words, one)


def hashed_vectors(rows: DataFrame, key: str, text: str, dims: int = 256) -> DataFrame:
    """(key, bucket, value) of the non-zero components of unit length."""
    signed = rows.select(key, F.inline(hashed_vector(identifier_words(F.col(text)), dims)))
    counts = signed.groupBy(key, "bucket").agg(F.sum("sign").alias("n")).filter("n <> 0")
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, key).select(key, "bucket", (F.col("n") / F.col("norm")).alias("value"))


_HASHED_SQL = """WITH w AS (SELECT p_partkey, sha1(lower(unnest(regexp_extract_all(p_name || ' ' || p_brand, '[A-Za-z][a-z]+|\\d+')))) AS h FROM part),
b AS (SELECT p_partkey, (('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT % 256)::INTEGER AS bucket, CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 1 THEN 1 ELSE -1 END AS sign FROM w),
n AS (SELECT p_partkey, bucket, sum(sign) AS n FROM b GROUP BY 1, 2 HAVING sum(sign) <> 0)
SELECT p_partkey, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY p_partkey)))::DOUBLE AS value FROM n"""


@query("idx_hashed_vectors", "", _HASHED_SQL)
def idx_hashed_vectors(spark, sf_dir):
    parts = V.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    return hashed_vectors(parts, "p_partkey", "name")


def vector_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}\0"), text), 256)


def missing_vectors(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """(key, hit): each distinct text's key, and whether its vector is known; only the others need computing."""
    keyed = texts.select(vector_key(model, F.col("text")).alias("key")).distinct()
    return keyed.join(cache.select("key", F.lit(True).alias("hit")).distinct(), "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("idx_embedding_cache", "", "SELECT DISTINCT sha256('fake-hash-256' || chr(0) || p_name) AS key, p_name LIKE 'large%' AS hit FROM part")
def idx_embedding_cache(spark, sf_dir):
    texts = V.table(spark, sf_dir, "part").select(F.col("p_name").alias("text"))
    known = texts.filter(F.col("text").startswith("large")).select(vector_key("fake-hash-256", F.col("text")).alias("key"))
    return missing_vectors(texts, known, "fake-hash-256")


def json_text(value: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def canonical(fields: dict[str, Column]) -> Column:
    """A JSON object of JSON texts by sorted names, with a space after colons and commas."""
    return F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{k}": '), fields[k]) for k in sorted(fields))), F.lit("}"))


def request_key(deployment: Column, prompt_version: Column, content: Column, boundary: str) -> Column:
    """The key of a cached model call: a hash of its inputs, the run's boundary replaced by a name."""
    message = canonical({"content": json_text(F.replace(content, F.lit(boundary), F.lit("BOUNDARY"))), "role": F.lit('"user"')})
    return F.sha2(canonical({"deployment": json_text(deployment), "prompt_version": json_text(prompt_version), "messages": F.concat(F.lit("["), message, F.lit("]"))}), 256)


@query("fn_request_key", "", f"""SELECT conv_id, turn, sha256('{{"deployment": "' || role || '", "messages": [{{"content": ' || to_json('{_B.replace(_B, "BOUNDARY")} ' || text)::VARCHAR || ', "role": "user"}}], "prompt_version": "' || (conv_id % 3) || '"}}') AS key FROM conversations""")
def fn_request_key(spark, sf_dir):
    content = F.concat(F.lit(f"{_B} "), "text")
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", request_key(F.col("role"), (F.col("conv_id") % 3).cast("string"), content, _B).alias("key"))
