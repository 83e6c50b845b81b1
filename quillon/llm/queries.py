"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import language, toxicity
from quillon.llm.bpe import bpe_encode
from quillon.llm.chat import chat_digests, written_chats
from quillon.llm.funnels import MINUTE, Funnel, funnel_report, report_sql
from quillon.llm.imatch import edited_fingerprints
from quillon.llm.jaccard import shingle_components
from quillon.llm.katz import score_documents
from quillon.llm.lexical import ranked_search
from quillon.llm.lines import dedup_lines
from quillon.llm.mixing import mix
from quillon.llm.sampling import in_fold
from quillon.llm.tokenfiles import token_output
from quillon.llm.vectors import embedding_links


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents leave every document."""
    docs = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


_LINES_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
lines AS (
    SELECT rid, doc_id, unnest(string_split(body, chr(10))) AS line,
           generate_subscripts(string_split(body, chr(10)), 1) AS pos
    FROM docs),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
    FROM lines),
frequent AS (
    SELECT line_key FROM keyed WHERE length(line_key) >= 1
    GROUP BY line_key HAVING count(DISTINCT rid) >= 10),
marked AS (
    SELECT k.rid, k.doc_id, k.line, k.pos, f.line_key IS NOT NULL AS bad
    FROM keyed k LEFT JOIN frequent f ON k.line_key = f.line_key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bad), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""

def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as sequence files and read back."""
    return token_output(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=0)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by the word vocabulary."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_encode(docs, _tokenizer("word_bpe_49k.json"), texts_too=False).drop("text")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85."""
    return shingle_components(_table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked by a cosine of 0.95 or more, and their components."""
    return embedding_links(_table(spark, sf_dir, "embeddings"), least=0.95)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs, folds=4, held=2)
    found = language.identify(docs.select("doc_id", "text"), model).drop("text")
    return found.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), folds=5, held=0)
    found = toxicity.score_toxicity(docs, model).drop("text")
    return found.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", "predicted")


#: Target weights of the mix; what isn't named weighs 1.
MIX_WEIGHTS = {"domain": {"src1": 2.0, "src0": 1.5}, "language": {"en": 2.0}, "source": {}}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the mix takes from each domain, language and source, and how often.

    A domain is the first four letters of a source; the budget is four fifths of all words, in two epochs at most.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    taken = mix(docs, F.substring("source", 1, 4), 0.8, MIX_WEIGHTS, max_epochs=2, seed=17)
    return taken.select("doc_id", "lang", "source", F.col("mix_tokens").alias("n_words"), F.col("mix_epochs").alias("epochs"), F.col("mix_target").alias("leaf_target"))


def _split_sql(parent: str, level: str, source: str, out: str) -> str:
    """One level of water filling: {source} has the parent's budget, supply and weight."""
    by = f"PARTITION BY {parent}" if parent else ""
    keep = f"{parent}, {level}" if parent else level
    return f"""
{out}_r AS (
    SELECT *, CASE WHEN weight > 0 THEN supply / weight END AS ratio FROM {source}),
{out}_t AS (
    SELECT *, coalesce(sum(CASE WHEN weight > 0 THEN supply END)
                OVER ({by} ORDER BY ratio ASC NULLS LAST, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS taken,
           sum(weight) OVER ({by} ORDER BY ratio ASC NULLS LAST, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
    FROM {out}_r),
{out}_l AS (
    SELECT *, CASE WHEN weight > 0 AND supply > weight * greatest(budget - taken, 0.0) / rest THEN (budget - taken) / rest END AS own
    FROM {out}_t),
{out}_w AS (
    SELECT *, first_value(own IGNORE NULLS) OVER ({by} ORDER BY ratio ASC NULLS LAST, {level}
                ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS water
    FROM {out}_l),
{out} AS (
    SELECT {keep}, CASE WHEN weight <= 0 THEN 0.0 ELSE least(supply::DOUBLE, coalesce(water * weight, supply::DOUBLE)) END AS budget
    FROM {out}_w)"""


_MIX_SQL = (
    r"""
WITH docs AS (
    SELECT doc_id, lang, source, substr(coalesce(source, ''), 1, 4) AS d, coalesce(lang, '') AS l, coalesce(source, '') AS s,
           len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS n FROM documents),
leaves AS (SELECT d, l, s, sum(n)::BIGINT AS tokens, sum(n)::BIGINT * 2 AS supply FROM docs GROUP BY d, l, s),
top AS (SELECT least(floor((SELECT sum(tokens) FROM leaves) * 0.8)::DOUBLE, sum(supply)::DOUBLE) AS budget FROM leaves),
in_d AS (
    SELECT d, sum(supply)::BIGINT AS supply, CASE d WHEN 'src1' THEN 2.0::DOUBLE WHEN 'src0' THEN 1.5 ELSE 1.0 END AS weight, (SELECT budget FROM top) AS budget
    FROM leaves GROUP BY d),"""
    + _split_sql("", "d", "in_d", "of_d")
    + r""",
in_l AS (
    SELECT x.d, x.l, x.supply, CASE x.l WHEN 'en' THEN 2.0::DOUBLE ELSE 1.0 END AS weight, of_d.budget
    FROM (SELECT d, l, sum(supply)::BIGINT AS supply FROM leaves GROUP BY d, l) x JOIN of_d ON x.d = of_d.d),"""
    + _split_sql("d", "l", "in_l", "of_l")
    + r""",
in_s AS (
    SELECT x.d, x.l, x.s, x.supply, 1.0::DOUBLE AS weight, of_l.budget FROM leaves x JOIN of_l ON x.d = of_l.d AND x.l = of_l.l),"""
    + _split_sql("d, l", "s", "in_s", "of_s")
    + r""",
plan AS (
    SELECT v.d, v.l, v.s, v.tokens, floor(of_s.budget)::BIGINT AS target,
           CASE WHEN v.tokens > 0 THEN least(floor(of_s.budget)::BIGINT // v.tokens, 2) ELSE 0 END AS whole
    FROM leaves v JOIN of_s ON v.d = of_s.d AND v.l = of_s.l AND v.s = of_s.s),
placed AS (
    SELECT docs.*, target, whole, target - whole * tokens AS remains, md5(concat_ws('|', '17', whole, doc_id)) AS ord
    FROM docs JOIN plan ON docs.d = plan.d AND docs.l = plan.l AND docs.s = plan.s),
summed AS (SELECT *, sum(n) OVER (PARTITION BY d, l, s ORDER BY ord) AS upto FROM placed)
SELECT doc_id, lang, source, n AS n_words, (whole + CASE WHEN upto <= remains AND remains > 0 THEN 1 ELSE 0 END)::INTEGER AS epochs, target AS leaf_target
FROM summed WHERE whole + CASE WHEN upto <= remains AND remains > 0 THEN 1 ELSE 0 END > 0
"""
)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under a Katz bigram model, beside an add-one unigram base."""
    return score_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), folds=7, held=2)


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, and how it compares with its edited text's and the next document's."""
    return edited_fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: A conversation beside those of the table; its texts hold control strings of the template.
EXTRA_TURNS = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted and written, and what is read back from the files."""
    return chat_digests(written_chats(_table(spark, sf_dir, "conversations"), extra=EXTRA_TURNS))


_CHAT_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
    UNION ALL SELECT -7, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)),
placed AS (
    SELECT *, row_number() OVER w AS pos,
           coalesce(last_value(CASE WHEN r IN ('system', 'user', 'assistant') THEN r END IGNORE NULLS)
                    OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'start') AS state
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, r, t)),
sized AS (
    SELECT *,
           length(regexp_replace(t, '\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<<ROLE>>|<</ROLE>>|<</END>>', '\0.', 'g')) AS n_text,
           length(regexp_replace(r, '\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<<ROLE>>|<</ROLE>>|<</END>>', '\0.', 'g')) AS n_role,
           CASE WHEN state IN ('start', 'assistant') AND r IN ('system', 'user') THEN 3 ELSE 0 END AS n_lead,
           state || '>' || r NOT IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS bad
    FROM placed)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY pos) FILTER (r = 'assistant'), '')) AS loss_sha256,
       sum(n_lead + n_text + CASE r WHEN 'system' THEN 8 + 11 WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 1 + 5
                                    ELSE 8 + n_role + 9 + 8 END)::BIGINT AS formatted_chars,
       count(*) FILTER (bad) AS n_out_of_order
FROM sized GROUP BY conv_id
"""


#: The funnels of op12; all steps lie within five minutes of the first.
FUNNELS = (
    Funnel("A", ("view", "click", "view", "purchase"), ("error",)),
    Funnel("B", ("signup", "view", "click", "purchase"), ("error",)),
    Funnel("C", ("click", "click", "purchase", "view"), ("signup",)),
)


def op12_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each funnel and client, the attempts that reach each step, and the quarter's wait for it."""
    clicks = _table(spark, sf_dir, "clicks")
    return funnel_report(clicks, FUNNELS, "client_id", "kind", "arrived_at", within=5 * MINUTE, percent=25)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


_SEARCH_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
asked AS (SELECT row_number() OVER () AS iid, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
words AS (
    SELECT rid, doc_id, unnest(regexp_extract_all({fold}, '{term}')) AS term FROM docs),
sized AS (SELECT rid, doc_id, count(*) AS n FROM words GROUP BY rid, doc_id),
corpus AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sized),
tfs AS (SELECT rid, term, count(*) AS tf FROM words GROUP BY rid, term),
weighed AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM tfs, corpus GROUP BY term, n_docs),
wanted AS (
    SELECT iid, term, count(*) AS c FROM (SELECT iid, unnest(regexp_extract_all({fold}, '{term}')) AS term FROM asked)
    GROUP BY iid, term),
scored AS (
    SELECT iid, rid, doc_id,
           sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM wanted JOIN weighed USING (term) JOIN tfs USING (term) JOIN sized USING (rid), corpus GROUP BY iid, rid, doc_id),
ranked AS (
    SELECT *, (row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id ASC NULLS LAST))::INTEGER AS rank
    FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked JOIN asked USING (iid) WHERE rank <= 10
""".replace("{fold}", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')").replace(
    "{term}", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_output": op2_token_output,
    "op3_bpe": op3_bpe,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_lm_score": op9_lm_score,
    "op10_imatch": op10_imatch,
    "op11_chat_format": op11_chat_format,
    "op12_funnels": op12_funnels,
    "op13_ranked_search": op13_ranked_search,
}

ORACLES = {
    "op1_line_dedup": _LINES_SQL,
    "op8_mixing": _MIX_SQL,
    "op11_chat_format": _CHAT_SQL,
    "op12_funnels": report_sql("clicks", FUNNELS, "client_id", "kind", "arrived_at", 5 * MINUTE, 25),
    "op13_ranked_search": _SEARCH_SQL,
}
