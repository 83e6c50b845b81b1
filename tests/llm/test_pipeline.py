"""The pipeline's stages against brute force, each on its own input, and at their edges."""

from __future__ import annotations

import collections
import hashlib
import re

import pytest

P = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

from quillon.llm import language  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en" if k % 3 else "fr", f"src{k % 4}", len(t or "")) for k, (i, t) in enumerate(texts)], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def mixed(spark, texts):
    """Null ids, repeated ids with equal and other texts, near copies, nulls and empties."""
    more = [(None, texts[5]), (None, texts[5]), (None, None), (7, texts[7]), (7, "another text of the same id as before it"), (7, texts[7])]
    return table(spark, [*enumerate(texts), *more])


def test_language_keeps_what_the_model_does_not_reject(spark, mixed):
    model = language.train(mixed)
    kept = [tuple(r) for r in mixed.collect() if not model.predict([r["text"]])[2][0]]
    assert rows_of(STAGES["language"](spark, mixed, "")) == sorted(kept, key=str) and len(kept) > 20


def test_lines_of_many_documents_go(spark, mixed):
    rows = mixed.collect()
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\v\f\r"))
    seen = collections.Counter(k for r in rows for k in {key(x) for x in (r["text"] or "").split("\n")})
    want = []
    for r in rows:
        text = "\n".join(x for x in (r["text"] or "").split("\n") if not (key(x) and seen[key(x)] >= 10))
        want.append((r["doc_id"], text, r["lang"], r["source"], len(text)))
    assert rows_of(STAGES["lines"](spark, mixed, "")) == sorted(want, key=str)


def test_one_row_of_each_group_stays(spark, mixed):
    rows = [tuple(r) for r in mixed.collect()]
    sets = []
    for r in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode().lower())
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                group[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    got = collections.Counter(rows_of(STAGES["near_duplicates"](spark, mixed, "")))
    alone = [rows[i] for i in range(len(rows)) if not sets[i]]
    assert sum(got.values()) == len(alone) + sum(bool(sets[g]) for g in groups)
    for row in alone:
        assert got[row]
    for g, members in groups.items():
        if sets[g]:
            ids = [rows[i][0] for i in members if rows[i][0] is not None]
            kept = [rows[i] for i in set(members) if got[rows[i]]]
            assert kept and all(k[0] == (min(ids) if ids else None) for k in kept) and len(set(kept)) == 1
    assert all(n == 1 for row, n in got.items() if re.search(r"\S", row[1] or ""))


def water(budget, children):
    """Weights and supplies to shares: level by level, by trying every set of children that fill up."""
    left, taken, out = dict(children), budget, {}
    while left:
        total = sum(w for w, _ in left.values())
        full = {k: s for k, (w, s) in left.items() if w == 0 or s <= w * taken / total}
        if not full:
            return out | {k: w * taken / total for k, (w, _) in left.items()}
        for k, s in full.items():
            w, _ = left.pop(k)
            out[k] = s if w else 0.0
            taken -= out[k]
    return out


def test_mix_takes_prefixes_of_seeded_epochs(spark, mixed):
    plain = mixed.dropDuplicates(["doc_id"]).filter("doc_id is not null")
    rows = [tuple(r) for r in plain.collect()]
    words = lambda t: len(re.findall(r"[^ \t-\r]+", t or ""))
    leaves = collections.Counter()
    for _, t, lang, source, _ in rows:
        leaves[source[:4], lang, source] += words(t)
    weights, most = corpus_pipeline.WEIGHTS, corpus_pipeline.MAX_EPOCHS
    up = lambda n: {k: sum(v for l, v in leaves.items() if l[:n] == k) * most for k in {l[:n] for l in leaves}}  # noqa: E731, E741
    budget = min(int(sum(leaves.values()) * corpus_pipeline.BUDGET_SHARE), sum(leaves.values()) * most)
    top = water(budget, {d: (weights["domain"].get(d[0], 1.0), s) for d, s in up(1).items()})
    targets = {}
    for d, of_d in top.items():
        mid = water(of_d, {k: (weights["language"].get(k[1], 1.0), s) for k, s in up(2).items() if k[:1] == d})
        for m, of_m in mid.items():
            targets |= water(of_m, {k: (weights["source"].get(k[2], 1.0), s) for k, s in up(3).items() if k[:2] == m})
    want = collections.Counter()
    for leaf, tokens in leaves.items():
        target = int(targets[leaf] + 1e-9)
        whole = min(target // tokens, most) if tokens else 0
        room = target - whole * tokens
        mine = [r for r in rows if (r[3][:4], r[2], r[3]) == leaf]
        spent = 0
        for r in sorted(mine, key=lambda r: hashlib.md5(f"{corpus_pipeline.SEED}|{whole}|{r[0]}".encode()).hexdigest()):
            spent += words(r[1])
            want[r] += whole + (spent <= room and room > 0)
    assert collections.Counter(tuple(r) for r in STAGES["mix"](spark, plain, "").collect()) == +want


def test_encoding_is_the_library_s(spark, mixed):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = STAGES["encode"](spark, mixed, "").collect()
    assert len(got) == mixed.count()
    for r in got:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["ids"], r["n_tokens"], r["decoded"]) == (ids, len(ids), t.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables_stay_empty(spark, name):
    assert STAGES[name](spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_run_reads_a_table_and_drops_what_it_wrote(spark, mixed, tmp_path):
    mixed.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"ids", "n_tokens", "decoded"} <= set(out.columns) and out.count() > 10


def test_clashing_columns_pass_through_lines_and_mix(spark):
    from pyspark.sql import functions as F

    from quillon.llm import lines, mixing

    names = ["bucket", "mix_domain", "mix_language", "mix_source", "mix_id", "mix_domain_of", "order", "range", "tokens", "quillon_bucket", "shard", "hi"]
    rows = spark.createDataFrame([(i, f"line {i}\nshared", "en", "s", *names) for i in range(12)], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    out = lines.dedup_lines(rows)
    assert [r["text"] for r in out.orderBy("doc_id").collect()] == [f"line {i}" for i in range(12)] and all(r["bucket"] == "bucket" for r in out.collect())
    mixed = mixing.mix(rows, F.lit("d"), 1.0)
    assert mixed.count() == 12 and all(r["mix_id"] == "mix_id" and r["order"] == "order" for r in mixed.collect())
