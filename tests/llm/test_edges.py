"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trackspark.llm import exact, jaccard, language, packing, ppm, quality, queries as Q, substrings, tiling, toxicity, urls

LONG = " ".join(f"word{i % 9000}" for i in range(60_000))
TEXTS = [
    (1, "The cat sat on the mat, and the dog lay by the door."),
    (1, "The cat sat on the mat, and the dog lay by the door."),
    (2, "The cat  sat on the mat, and the dog lay by the door."),
    (3, None),
    (4, ""),
    (5, " \n\t"),
    (6, LONG),
    (None, "a row without an id"),
    (None, None),
    (7, "12 34 ... !"),
]
CLASHING = ("block", "id", "uid", "n", "token", "label", "digest", "score", "predicted", "root", "ids", "texts", "rule", "host", "item", "gone_id", "size", "x")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    rows = rows.withColumns({c: F.lit("clash") for c in CLASHING})
    return rows.withColumn("lang", F.when(F.col("doc_id") < 3, "en")).withColumn("source", F.when(F.col("doc_id") != 1, F.lit("s")))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 0), (2, 0), (6, None), (None, 1)], "doc_id long, label int")


def _language(d, _):
    return language.predict(d, language.fit(d, F.lit(True)))


BENCH = [(1, "the cat sat on the mat and the dog lay by the door"), (None, None), (2, "")]
OPERATORS = {
    "quality": lambda d, l: quality.quality(d, l, F.lit(True)),
    "toxicity": lambda d, l: toxicity.toxicity(d, l, F.lit(True)),
    "substrings": lambda d, l: substrings.dedup_substrings(d),
    "ppm": lambda d, l: ppm.score_documents(d),
    "exact": lambda d, l: exact.exact_dedup(d),
    "jaccard": lambda d, l: jaccard.near_duplicates(d),
    "language": _language,
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_every_row_is_returned(docs, labels, name):
    got = sorted((r.doc_id for r in OPERATORS[name](docs, labels).collect()), key=repr)
    assert got == sorted((i for i, _ in TEXTS), key=repr)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(docs, labels, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).collect() == []


def test_no_labels(docs, labels):
    for op in (quality.quality, toxicity.toxicity):
        assert {r.score for r in op(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}


def test_exact_ties(docs):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(docs).where("doc_id in (1, 2, 3, 4, 5)").collect()}
    assert got == {(1, 2, 3, False), (2, 2, 3, True), (3, 5, 4, False), (4, 5, 4, False), (5, 5, 4, True)}


def test_same_digest_other_bytes(spark):
    rows = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "a a"), (4, "bb")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact.exact_dedup(rows, digest=lambda t: F.lit("same")).collect()}
    assert got == {(1, 3, 2), (3, 3, 2), (2, 2, 2), (4, 2, 2)}


def test_near_duplicate_edges(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect() if r.doc_id is not None}
    assert {i: got[i] for i in (1, 2, 3, 4, 5)} == {1: (9, 1), 2: (9, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5)}
    assert got[6] == (9000, 6) and got[7] == (1, 7)


def test_language_edges(docs):
    got = {(r.doc_id, r.lang_pred) for r in _language(docs, None).collect()}
    assert got == {(1, "en"), (2, "en"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (7, "und"), (None, "en"), (None, "und")}


def test_tiling_edges(spark, docs):
    bench = spark.createDataFrame(BENCH, "item_id long, text string").withColumn("doc_id", F.lit(0))
    assert sorted(r.doc_id for r in tiling.contaminated(docs, bench).collect()) == [1, 1, 2]
    assert tiling.contaminated(docs.limit(0), bench).collect() == []
    assert tiling.contaminated(docs, bench.limit(0)).collect() == []


def test_packing_edges(docs):
    pytest.importorskip("tokenizers")
    got = packing.pack_documents(docs, Q.tokenizer_path())
    whole = got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.count_if(F.col("start") == 0).alias("rows")).collect()
    assert {r.doc_id: r.rows for r in whole} == {None: 2, 1: 2, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1}
    assert {r.doc_id: r.n for r in whole}[3] == 1
    assert packing.pack_documents(docs.limit(0), Q.tokenizer_path()).collect() == []


def test_deficits_carry_over():
    sources, lengths = ["a"] * 30 + ["b"] * 10, [100] * 40
    plan = packing.plan_pack(sources, lengths, {"a": (0.75, 0.0), "b": (0.25, 0.0)}, window=256)
    assert sum(p[2] for p in plan) == 4000
    for end in (4, 8, 12):
        share = sum(p[2] for p in plan if sources[p[0]] == "a" and p[3] < end) / sum(p[2] for p in plan if p[3] < end)
        assert abs(share - 0.75) < 0.1


def test_url_edges(spark):
    pages = spark.createDataFrame([(None, None), (1, ""), (1, "")], "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("host", F.lit("clash"))
    rules = urls.rules_frame(spark, [("block", "org", "/"), ("allow", "org", "/"), ("block", None, "/")])
    assert [(r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, rules).collect()] == [("", "", None, "allow")] * 3
    assert urls.filter_urls(pages, rules.limit(0)).count() == 3
    assert urls.filter_urls(pages.limit(0), rules).collect() == []
    tied = spark.createDataFrame([(1, "x://org/")], "page_id long, url string")
    assert urls.filter_urls(tied, rules).first().verdict == "block"


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_edges(spark, docs, tmp_path, empty):
    pytest.importorskip("tokenizers")
    bench = spark.createDataFrame([(1, None)], "item_id long, text string")
    (docs.limit(0) if empty else docs).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == (set() if empty else {2, 6, None})


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
ROWS = [
    (1, PASSAGE + " a"),
    (7, PASSAGE + " b"),  # a near copy of the first row
    (7, "a text of its own that nothing else in this table is like at all"),
    (None, PASSAGE + " c"),
    (None, "another text of its own that no other row of the table comes near to"),
    (1, PASSAGE + " d"),  # a near copy with the id that stays
    (9, "the very same row twice over in this little table of rows"),
    (9, "the very same row twice over in this little table of rows"),
    (10, None),
    (11, ""),
]


def table(spark, rows):
    made = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    return made.withColumn("lang", F.lit(None).cast("string")).withColumns({c: F.lit("clash") for c in ("key", "row", "nth", "component_id", "id")}).repartition(3)


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_near_duplicates_are_judged_by_row(spark):
    docs = table(spark, ROWS)
    got = stage("near_duplicates")(spark, docs, "")
    assert got.columns == docs.columns
    rows = kept(got)
    assert len([t for _, t in rows if t and t.startswith(PASSAGE)]) == 1 and any(i == 1 and t.startswith(PASSAGE) for i, t in rows if t)
    assert [r for r in rows if not (r[1] or "").startswith(PASSAGE)] == sorted(set(ROWS[2:3] + ROWS[4:5] + ROWS[6:7] + ROWS[8:]), key=repr)
    assert kept(stage("near_duplicates")(spark, docs.limit(0), "")) == []


def test_decontamination_is_judged_by_row(spark, tmp_path):
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, ROWS)
    got = stage("decontamination")(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert kept(got) == sorted((r for r in ROWS if not (r[1] or "").startswith(PASSAGE)), key=repr)


def test_language_stage_without_languages(spark):
    docs = table(spark, ROWS + [(12, "12 34 !")])
    got = stage("language")(spark, docs, "")
    assert got.columns == docs.columns and kept(got) == sorted((r for r in ROWS if r[1]), key=repr)


def test_exact_stage_keeps_columns(spark):
    docs = table(spark, ROWS)
    got = stage("exact_dedup")(spark, docs, "")
    assert got.columns == docs.columns and {t for _, t in kept(got) if t} == {t for _, t in ROWS if t}


def test_a_digest_clash_is_no_match(monkeypatch):
    import numpy as np

    real = tiling._longest
    monkeypatch.setattr(tiling, "_longest", lambda a, b, fa, fb, least: [(0, 0, 3)] if fa[0] else [])
    assert tiling.tile(np.arange(1, 9, dtype=np.uint64), np.arange(2, 10, dtype=np.uint64), 3) == []
    monkeypatch.setattr(tiling, "_longest", real)
