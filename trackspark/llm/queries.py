"""Queries of the operators in this package, and their results as SQL."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from trackspark.llm import exact, jaccard, language, packing, periodic, ppm, quality, secrets, substrings, tiling, toxicity, urls, whitening
from trackspark.llm.shared import held_out, read

URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_quality(spark, sf) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    labels = read(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    out = held_out("doc_id", 4, 2)
    found = quality.quality(docs, labels, ~out)
    return found.select("doc_id", out.alias("held_out"), "score", "predicted")


def op2_urls(spark, sf) -> DataFrame:
    pages = read(spark, sf, "pages").select("page_id", "url")
    return urls.filter_urls(pages, urls.rules_frame(spark, URL_RULES))


def op3_substrings(spark, sf) -> DataFrame:
    found = substrings.dedup_substrings(read(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_toxicity(spark, sf) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    labels = read(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    out = held_out("doc_id", 3, 1)
    found = toxicity.toxicity(docs, labels, ~out)
    return found.select("doc_id", out.alias("held_out"), "score", "predicted")


def op5_ppm(spark, sf) -> DataFrame:
    return ppm.score_documents(read(spark, sf, "documents").select("doc_id", "text"))


def op6_exact_dedup(spark, sf) -> DataFrame:
    return exact.exact_dedup(read(spark, sf, "documents").select("doc_id", "text"))


def op7_tiling(spark, sf) -> DataFrame:
    return tiling.contaminated(read(spark, sf, "documents").select("doc_id", "text"), read(spark, sf, "benchmark"))


def op8_language(spark, sf) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang")
    out = held_out("doc_id", 3, 1)
    found = language.predict(docs, language.fit(docs, ~out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark, sf) -> DataFrame:
    return packing.pack_documents(read(spark, sf, "documents"), tokenizer_path())


def op10_jaccard(spark, sf) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf, "documents").select("doc_id", "text"))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def op11_secrets(spark, sf) -> DataFrame:
    found = secrets.find_secrets(read(spark, sf, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("bigint").alias(f"n_{k}") for k in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op12_whitening(spark, sf) -> DataFrame:
    vectors = read(spark, sf, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    return whitening.by_component(whitening.whiten(vectors, model), model)


def looped(doc_id: int | None, n: int) -> np.ndarray | None:
    """Positions of the words of a document that is made to repeat its end: one document in ten by the crc32 of its id."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or n == 0:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def op13_periodic(spark, sf) -> DataFrame:
    found = periodic.periodic_runs(read(spark, sf, "documents").select("doc_id", "text"), rewrite=looped)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = periodic.strongest(F.col("runs"))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256")
    ).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


QUERIES = (
    op1_quality, op2_urls, op3_substrings, op4_toxicity, op5_ppm, op6_exact_dedup, op7_tiling, op8_language, op9_packing, op10_jaccard,
    op11_secrets, op12_whitening, op13_periodic,
)

ORACLE = {
    "op2_urls": r"""
with parts as (
  select page_id,
         case when url like '%://%' then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages
), split as (
  select page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
  from parts
), rules(verdict, rhost, rpath) as (
  values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), keys as (select distinct host, path from split
), fitted as (
  select k.host, k.path, arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) as rule,
         arg_max(r.verdict, length(r.rhost || r.rpath)) as verdict
  from keys k join rules r
    on (k.host = r.rhost or ends_with(k.host, '.' || r.rhost)) and starts_with(k.path, r.rpath)
  group by k.host, k.path
)
select s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from split s left join fitted f on s.host = f.host and s.path = f.path
""",
    "op6_exact_dedup": r"""
with d as (
  select doc_id, length(coalesce(text, '')) as points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body
  from documents
), h as (select doc_id, points, sha256(body) as text_sha256, body from d
), k as (
  select *, first_value(doc_id) over (partition by body order by points desc, doc_id) as keep_id,
         count(*) over (partition by body) as group_size
  from h
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from k
""",
    "op3_substrings": r"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), starts as (
  select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20
), windows as (
  select doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) as run from starts
), again as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by run order by doc_id, i) as nth from windows) where nth > 1
), gone as (
  select distinct doc_id, unnest(range(i, i + 20)) as i from again
), words as (
  select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d
), kept as (
  select words.doc_id, string_agg(word, ' ' order by words.i) as body, count(*) as n
  from words left join gone on gone.doc_id = words.doc_id and gone.i = words.i where gone.i is null group by words.doc_id
)
select d.doc_id, len(d.w) as n_words, len(d.w) - coalesce(k.n, 0) as n_removed, sha256(coalesce(k.body, '')) as kept_sha256
from d left join kept k on k.doc_id = d.doc_id
""",
    "op10_jaccard": r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                      else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
  from d
), shingles as (select doc_id, len(s) as n, unnest(s) as x from sets
), links as (
  select a.doc_id as a, b.doc_id as b from shingles a join shingles b on a.x = b.x and a.doc_id < b.doc_id
  where 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), ways as (select a, b from links union all select b, a from links
), reached(a, b) as (
  select doc_id, doc_id from d
  union
  select r.a, l.b from reached r join ways l on l.a = r.b
)
select s.doc_id, len(s.s) as n_shingles, min(r.b) as component_id from sets s join reached r on r.a = s.doc_id group by s.doc_id, len(s.s)
""",
}
