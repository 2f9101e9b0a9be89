"""The pipeline and the queries of the driver contract on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kerbline.llm import decontam, queries, token_store

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, D).cache()
        out.append((docs, after))
        docs = after
    return out


def test_stages_keep_the_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_language_stage_keeps_clean_documents(stages):
    before, after = stages[0]
    lost = before.join(after, "doc_id", "left_anti").collect()
    assert len(lost) <= 0.01 * before.count()


def test_one_of_each_group_stays(stages):
    before, after = stages[1]

    def shingled(text):
        w = text.encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    sets = {r["doc_id"]: shingled(r["text"]) for r in before.collect()}
    kept = {r["doc_id"] for r in after.collect()}
    similar = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    ids = sorted(sets)
    for i in ids:
        partners = [j for j in ids if j < i and similar(sets[i], sets[j])]
        assert (i in kept) == (not partners)
    assert not any(similar(sets[i], sets[j]) for i in kept for j in kept if i < j)


def test_contaminated_documents_go(stages, spark):
    before, after = stages[2]
    items = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect() for w in [_words(r["text"])] for i in range(max(1, len(w) - 9))}
    dirty = {r["doc_id"] for r in before.collect() for w in [_words(r["text"])] if any(tuple(w[i : i + 10]) in items for i in range(len(w)))}
    assert {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()} == dirty


def _words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_mixture_repeats_whole_documents(stages):
    before, after = stages[3]
    known = {tuple(r) for r in before.collect()}
    assert {tuple(r) for r in after.collect()} <= known and abs(after.count() - before.count()) < 0.35 * before.count()


def test_tokens_of_the_last_stage(stages):
    from tokenizers import Tokenizer

    before, after = stages[4]
    encode = Tokenizer.from_file(token_store.default_tokenizer())
    copies, rows = Counter(), []
    for r in before.collect():
        place = int(hashlib.md5(f"30:{r['doc_id']}:{copies[r['doc_id']]}".encode()).hexdigest()[:15], 16)
        copies[r["doc_id"]] += 1
        rows.append((place, r["doc_id"], r["text"]))
    want, start = [], 0
    for _, key, text in sorted(rows):
        ids = np.array([*encode.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, after.collect())) == sorted(want)
    assert max(copies.values()) > 1


CLASHING = ("_source", "_row", "row", "score", "lang_pred", "copies", "copy", "rate", "shuffle_key", "place", "_dirty", "key", "name", "n", "_said", "component_id", "kept")


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_odd_rows_in_every_stage(stage, spark):
    """Nulls in any column, an empty and a very long text, repeated rows, columns with clashing names, an empty table."""
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = spark.read.parquet(f"{D}/documents.parquet")
    item = spark.read.parquet(f"{D}/benchmark.parquet").orderBy("item_id").first()["text"]
    prose = docs.filter("lang = 'en' AND n_chars BETWEEN 2000 AND 4000").orderBy("doc_id").first()["text"]
    # distinct ids and texts; 905 is a dirty text, 906 and 907 one text
    odd = [(900, None, "en", "s", 0), (901, "", None, None, None), (902, " ".join(f"{prose} {i}" for i in range(150)), None, None, None), (None, prose[::-1], None, None, None), (905, f"{prose[5:900]} {item}", None, "t", 1), (906, prose[50:], "en", "t", 1), (907, prose[50:], "en", "t", 1)]
    more = spark.createDataFrame(odd + odd[:1], docs.schema)
    docs = docs.filter("doc_id < 150").unionByName(more).withColumns({c: F.lit(c) for c in CLASHING})
    out = run(spark, docs, D)
    if stage == "tokenize":
        facts = {r["doc_id"]: r["n_tokens"] for r in out.collect()}
        assert out.count() == docs.count() and facts[900] == facts[901] == 1 and facts[None] > 1 and facts[902] > 20_000
    else:
        assert out.columns == docs.columns and all(out.filter(F.col(c) != c).isEmpty() for c in CLASHING)
        ids = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        if stage == "language_id":
            assert ids[900] == ids[901] == 0 and ids[906] == ids[907] == 1
        elif stage == "near_dedup":
            assert ids[900] == 2 and ids[901] == ids[None] == 1 and ids[906] + ids[907] <= 1 and ids[902] == 1
        elif stage == "decontaminate":
            assert ids[900] == 2 and ids[901] == ids[None] == ids[902] == ids[906] == 1 and not ids[905]
        else:
            assert ids[900] % 2 == 0 and set(ids) <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert run(spark, docs.limit(0), D).count() == 0


def test_oracles_agree(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{D}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, D).toPandas()
        want = con.execute(sql).df()[list(got.columns)]
        assert Counter(map(str, got.itertuples(index=False, name=None))) == Counter(map(str, want.itertuples(index=False, name=None))), name


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 11))


def test_native_plans_have_no_python(spark):
    for df in (decontam.op4(spark, D), queries.queries()["op1_mix_sources"](spark, D)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    assert F
