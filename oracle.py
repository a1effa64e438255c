"""The result of every query as SQL over the same tables (DuckDB dialect)."""

from __future__ import annotations

_SONGS = "(SELECT count(*) FROM embeddings)"

_PLAYS = f"""
plays AS (
  SELECT user_id, ts, event_id, event_id % {_SONGS} AS song, event_type <> 'signup' AS is_auto
  FROM events)"""

_TRACKS = """
tracks AS (
  SELECT p_partkey AS id,
         '/lib/' || p_brand || '/' || p_name || ' - ' || p_type || ' ' || p_partkey || '.mp3' AS file_path,
         p_retailprice / 7 AS duration,
         CASE WHEN p_size > 25 THEN p_name END AS title, p_brand AS artist, p_type AS album
  FROM part)"""

_PAIRS = """
pairs AS (
  SELECT q.vec_id AS query_id, s.vec_id AS id,
         list_cosine_similarity(q.embedding::DOUBLE[], s.embedding::DOUBLE[]) AS score
  FROM embeddings q JOIN embeddings s ON q.vec_id <> s.vec_id)"""


def _near(k: int) -> str:
    return f"""{_PAIRS},
near AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs)
  WHERE rank <= {k})"""


_STANDARD = """
vals AS (
  SELECT vec_id, UNNEST(range(len(embedding))) AS dim, UNNEST(embedding::DOUBLE[]) AS v FROM embeddings),
stats AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS s FROM vals GROUP BY dim),
std AS (
  SELECT vec_id, dim, CASE WHEN s = 0 THEN 0 ELSE (v - m) / s END AS value
  FROM vals JOIN stats USING (dim))"""

_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _column_stats() -> str:
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *_MEASURES]
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}::DOUBLE), 6) + 0.0 AS mean, "
        f"round(stddev_pop({c}::DOUBLE), 6) + 0.0 AS std FROM lineitem"
        for c in cols
    )


def _feature_weight() -> str:
    named = [
        ("l_quantity", "mfcc_1_mean", 1.2),
        ("l_extendedprice", "chroma_1_mean", 0.8),
        ("l_discount", "tempo", 1.0),
        ("l_tax", "spectral_centroid_mean", 1.0),
    ]
    stats = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, (c, _, _) in enumerate(named))
    cols = ", ".join(
        f"round(({c} - m{i}) / s{i} * {w}, 6) + 0.0 AS {n}" for i, (c, n, w) in enumerate(named)
    )
    return f"WITH st AS (SELECT {stats} FROM lineitem) SELECT l_orderkey, l_linenumber, {cols} FROM lineitem, st"


# Names parsed as a leftmost-first match of the two fixed patterns.
# Fixed values, as in the library's schema: the two name patterns, and the default texts further down.
_P1 = r"(.*?)\s*-\s*(.*?)(?:\s*\(|\s*\[|\s*-\s*\d|$)"
_P2 = r"^(\d+)[\s.-]*(.*?)\s*-\s*(.*?)(?:\s*\(|\s*\[|$)"


def _group(pattern: str, i: int, default: str) -> str:
    return (
        f"CASE WHEN regexp_extract(stem, '{pattern}', {i}, 'i') = '' THEN {default} "
        f"ELSE trim(regexp_extract(stem, '{pattern}', {i}, 'i')) END"
    )


_BASE = r"regexp_extract({p}, '([^/]*)$', 1)"
_STEM = r"regexp_replace({b}, '^(\.*[^.].*)\.[^.]*$', '\1')"


def _base(p: str) -> str:
    return _BASE.format(p=p)


def _stem(p: str) -> str:
    return _STEM.format(b=_base(p))


def _mmss(seconds: str) -> str:
    return f"printf('%d:%02d', (trunc({seconds})::BIGINT // 60), (trunc({seconds})::BIGINT % 60))"


_PERCENT = "round_even({s} * 100, 0)::INT::VARCHAR || '%'"
_BAND = "CASE WHEN {s} > 0.7 THEN 'green' WHEN {s} > 0.5 THEN 'yellow' ELSE 'red' END"

# 64-sample signals in centred frames of 16 samples, hop 8.
_FRAMES = """
sig AS (SELECT vec_id AS track_id, embedding::DOUBLE[] AS y, len(embedding) AS n FROM embeddings),
fr AS (
  SELECT track_id, f, j, f * 8 - 8 + j AS i,
         CASE WHEN f * 8 - 8 + j BETWEEN 0 AND n - 1 THEN y[f * 8 - 8 + j + 1] ELSE 0 END AS x,
         y[least(greatest(f * 8 - 8 + j, 0), n - 1) + 1] AS e
  FROM sig, (SELECT UNNEST(range(16)) AS j), LATERAL (SELECT UNNEST(range(1 + n // 8)) AS f))"""

_SPECTRUM = f"""{_FRAMES},
win AS (SELECT track_id, f, j, x * (0.5 - 0.5 * cos(2 * pi() * j / 16)) AS w FROM fr),
dft AS (
  SELECT track_id, f, k, k * 44100.0 / 16 AS freq,
         sum(w * cos(2 * pi() * j * k / 16)) AS re, sum(w * sin(2 * pi() * j * k / 16)) AS im
  FROM win, (SELECT UNNEST(range(9)) AS k) GROUP BY ALL),
mag AS (SELECT *, sqrt(re * re + im * im) AS s FROM dft),
cen AS (SELECT track_id, f, sum(freq * s) / sum(s) AS c, sum(s) AS total FROM mag GROUP BY ALL)"""


def _stats(name: str, frames: str, value: str, digits: int) -> str:
    return (
        f"SELECT track_id, round(avg({value}), {digits}) + 0.0 AS {name}_mean, "
        f"round(stddev_pop({value}), {digits}) + 0.0 AS {name}_std FROM {frames} GROUP BY track_id"
    )


_MELS, _COEFS = 12, 5
_MFCC = f"""{_SPECTRUM},
pts AS (
  SELECT p, 700 * (pow(10, (lo + (hi - lo) * p / {_MELS + 1}) / 2595) - 1) AS hz
  FROM (SELECT UNNEST(range({_MELS + 2})) AS p),
       (SELECT 2595 * log10(1 + 27.5 / 700) AS lo, 2595 * log10(1 + 16000.0 / 700) AS hi)),
filt AS (
  SELECT a.p AS band, k,
         greatest(0, least((k * 44100.0 / 16 - a.hz) / (b.hz - a.hz), (c.hz - k * 44100.0 / 16) / (c.hz - b.hz)))
           * 2 / (c.hz - a.hz) AS weight
  FROM pts a JOIN pts b ON b.p = a.p + 1 JOIN pts c ON c.p = a.p + 2, (SELECT UNNEST(range(9)) AS k)),
pw AS (SELECT track_id, f, band, sum(s * s * weight) AS p FROM mag JOIN filt USING (k) GROUP BY ALL),
db AS (SELECT track_id, f, band, 10 * log10(greatest(p, 1e-10)) AS db FROM pw),
cut AS (SELECT track_id, f, band, greatest(db, max(db) OVER (PARTITION BY track_id) - 80) AS db FROM db),
coef AS (
  SELECT track_id, f, c,
         sum(db * cos(pi() * c * (2 * band + 1) / (2 * {_MELS})) * sqrt(2.0 / {_MELS})
             * CASE WHEN c = 0 THEN 1 / sqrt(2) ELSE 1 END) AS v
  FROM cut, (SELECT UNNEST(range({_COEFS})) AS c) GROUP BY ALL)
SELECT track_id, """ + ", ".join(
    f"round(avg(v) FILTER (c = {i}), 4) + 0.0 AS mfcc_{i + 1}_mean, "
    f"round(stddev_pop(v) FILTER (c = {i}), 4) + 0.0 AS mfcc_{i + 1}_std"
    for i in range(_COEFS)
) + " FROM coef GROUP BY track_id"

_HISTORY = f"""{_PLAYS},
heard AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM plays),
h50 AS (SELECT * FROM heard WHERE back <= 50)"""

_QUEUE = f"""{_HISTORY}, {_near(45)},
seeds AS (SELECT user_id, song AS seed FROM heard WHERE back = 1),
fresh AS (
  SELECT s.user_id, s.seed, n.id, n.score,
         row_number() OVER (PARTITION BY s.user_id ORDER BY n.rank) AS r
  FROM seeds s JOIN near n ON n.query_id = s.seed
  WHERE NOT EXISTS (SELECT 1 FROM h50 h WHERE h.user_id = s.user_id AND h.song = n.id)),
queue AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r) - 1 AS pos
  FROM fresh WHERE r <= 15 AND id <> seed)"""

_ADVANCES = f"""{_PLAYS},
run AS (
  SELECT *, count(*) FILTER (NOT is_auto) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM plays),
adv AS (
  SELECT *, count(*) FILTER (is_auto) OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS advance FROM run)"""

_TOGGLES = """
toggles AS (
  SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 'auto' ELSE 'loop' END AS kind
  FROM events WHERE event_type IN ('click', 'signup')),
marked AS (
  SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS new
  FROM toggles),
isl AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM marked),
modes AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) % 2 = 1
                 THEN kind ELSE 'none' END AS mode
  FROM isl)"""

#: Documents as 16-bit samples: d has every document, s every sample, numbered from 1.
_PCM = """
d AS (SELECT doc_id, encode(text) AS b, octet_length(encode(text)) // 2 AS n FROM documents),
g AS (SELECT doc_id, n, regexp_extract_all(hex(b), '....') AS w FROM d WHERE n > 0),
v AS (SELECT doc_id, n, UNNEST(w) AS w, UNNEST(range(1, n + 1)) AS i FROM g),
u AS (SELECT doc_id, n, i, ('0x' || w[3:4] || w[1:2])::INT AS u FROM v),
s AS (SELECT doc_id, n, i, (CASE WHEN u >= 32768 THEN u - 65536 ELSE u END)::BIGINT AS x FROM u)"""

ORACLE: dict[str, str] = {
    "column_stats": _column_stats(),
    "feature_standardize": f"WITH {_STANDARD} SELECT vec_id, dim, round(value, 6) + 0.0 AS value FROM std",
    "feature_weight": _feature_weight(),
    "knn_single": f"WITH {_near(5)} SELECT id, rank, round(score, 6) + 0.0 AS similarity_score FROM near WHERE query_id = 0",
    "knn_join": f"WITH {_near(5)} SELECT query_id, id, rank, round(score, 6) + 0.0 AS score FROM near",
    "knn_euclidean": """
WITH pairs AS (
  SELECT q.vec_id AS query_id, s.vec_id AS id,
         1 - list_distance(q.embedding::DOUBLE[], s.embedding::DOUBLE[]) AS score
  FROM embeddings q JOIN embeddings s ON q.vec_id <> s.vec_id)
SELECT query_id, id, rank, round(score, 6) + 0.0 AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs)
WHERE rank <= 5""",
    # A full rotation of centred data changes no cosine, so PCA does not appear here.
    "knn_pca_full": f"""
WITH {_STANDARD},
vecs AS (SELECT vec_id, list(value ORDER BY dim) AS v FROM std GROUP BY vec_id),
pairs AS (
  SELECT q.vec_id AS query_id, s.vec_id AS id, list_cosine_similarity(q.v, s.v) AS score
  FROM vecs q JOIN vecs s ON q.vec_id <> s.vec_id)
SELECT query_id, id, rank, round(score, 6) + 0.0 AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs)
WHERE rank <= 5""",
    "knn_exclude": f"""
WITH {_HISTORY}, {_near(15)},
fresh AS (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r
  FROM near n
  WHERE NOT EXISTS (SELECT 1 FROM h50 h WHERE h.user_id = n.query_id AND h.song = n.id))
SELECT query_id, id, r AS rank, round(score, 6) + 0.0 AS score FROM fresh WHERE r <= 5""",
    "resolve_song": f"""
WITH {_TRACKS},
asked AS (
  SELECT p_partkey AS query_id,
         CASE p_partkey % 5
           WHEN 0 THEN '/lib/' || p_brand || '/' || p_name || ' - ' || p_type || ' ' || p_partkey || '.mp3'
           WHEN 1 THEN '/old/' || p_name || ' - ' || p_type || ' ' || p_partkey || '.mp3'
           WHEN 2 THEN '/x/' || p_name || ' - unheard ' || p_partkey || '.ogg'
           WHEN 3 THEN p_type || ' ' || p_partkey || '.flac'
           ELSE 'nothing ' || p_partkey || '.mp3' END AS song_path
  FROM part),
q AS (
  SELECT *, {_base('song_path')} AS base,
         CASE WHEN contains({_base('song_path')}, ' - ') THEN trim(split_part({_base('song_path')}, ' - ', 1)) END AS part,
         {_stem('song_path')} AS stem
  FROM asked),
hits AS (
  SELECT query_id, t.file_path,
         CASE WHEN t.file_path = song_path THEN 1
              WHEN base <> '' AND ends_with(t.file_path, base) THEN 2
              WHEN part <> '' AND contains(t.file_path, part) THEN 3
              WHEN stem <> '' AND contains(t.file_path, stem) THEN 4 END AS tier
  FROM q, tracks t),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, file_path) AS r FROM hits WHERE tier IS NOT NULL)
  WHERE r = 1)
SELECT q.query_id, q.song_path, b.file_path, b.tier FROM q LEFT JOIN best b USING (query_id)""",
    "incremental_antijoin": """
SELECT doc_id, source, n_chars FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "ingest_counts": """
SELECT count(*) FILTER (event_type NOT IN ('signup', 'error')) AS "new",
       count(*) FILTER (event_type = 'signup') AS skipped,
       count(*) FILTER (event_type = 'error') AS errors
FROM events""",
    "catalog_attrs": rf"""
WITH u AS (SELECT url, {_base('url')} AS base, octet_length(encode(html)) AS length FROM pages)
SELECT url AS file_path, base AS file_name,
       lower(regexp_extract(base, '^.+(\.[^.]+)$', 1)) AS file_extension,
       round(length / 1048576.0, 9) + 0.0 AS file_size_mb,
       {_stem('url')} AS stem, md5(url) AS path_key, substring(md5(url), 1, 12) AS short_key,
       lower(regexp_extract(base, '^.+(\.[^.]+)$', 1)) IN ('.m4a', '.aac', '.mp4') AS transcode
FROM u""",
    "parse_names": rf"""
WITH {_TRACKS},
forms AS (
  SELECT id, CASE id % 3
           WHEN 0 THEN file_path
           WHEN 1 THEN '/n/' || id || ' - ' || {_base('file_path')}
           ELSE {_stem('file_path')} || ' (live) - ' || id || '.mp3' END AS file_path
  FROM tracks),
s AS (SELECT *, {_base('file_path')} AS filename, {_stem('file_path')} AS stem FROM forms),
n AS (SELECT *, regexp_matches(stem, '{_P2}', 'i') AS numbered FROM s)
SELECT id, file_path, filename,
       {_group(_P1, 2, 'stem')} AS title,
       {_group(_P1, 1, "'Unknown Artist'")} AS artist,
       CASE WHEN numbered THEN {_group(_P2, 2, "'Unknown Artist'")} ELSE {_group(_P1, 1, "'Unknown Artist'")} END AS numbered_artist,
       CASE WHEN numbered THEN {_group(_P2, 3, 'stem')} ELSE {_group(_P1, 2, 'stem')} END AS numbered_title,
       CASE WHEN numbered THEN regexp_extract(stem, '{_P2}', 1, 'i') END AS track_num
FROM n""",
    "tag_defaults": """
SELECT d.doc_id, '/docs/' || source || '/' || d.doc_id || '.mp3' AS file_path,
       CASE WHEN l.doc_id IS NULL THEN 'Unknown Title' WHEN quality = 1 THEN 'song ' || d.doc_id
            ELSE d.doc_id || '.mp3' END AS title,
       CASE WHEN toxic = 0 THEN 'clean' ELSE 'Unknown Artist' END AS artist,
       'Unknown Album' AS album
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "format_texts": f"""
SELECT o_orderkey,
       CASE WHEN o_orderstatus = 'F' THEN '--:--' ELSE {_mmss('o_totalprice / 100')} END AS duration,
       CASE WHEN (o_totalprice - 100000) / 100 <= 0 THEN '0:00' ELSE {_mmss('(o_totalprice - 100000) / 100')} END AS clock,
       {_PERCENT.format(s='(o_totalprice / 500000)')} AS percent,
       {_BAND.format(s='(o_totalprice / 300000)')} AS band
FROM orders""",
    "text_cuts": """
SELECT doc_id, substring(text, 1, 50) AS head50, substring(text, 1, 30) AS head30,
       CASE WHEN length(text) > 50 THEN substring(text, 1, 47) || '...' ELSE text END AS cut50,
       CASE WHEN length(text) > 35 THEN substring(text, 1, 35) || '...' ELSE text END AS cut35
FROM documents""",
    "format_report": rf"""
WITH {_TRACKS}, {_near(5)},
shown AS (
  SELECT vec_id AS query_id, 0 AS rank, file_path, duration, NULL AS score
  FROM embeddings JOIN tracks ON id = vec_id
  UNION ALL
  SELECT n.query_id, n.rank, t.file_path, t.duration, n.score
  FROM near n JOIN tracks t ON t.id = n.id WHERE n.query_id IN (SELECT id FROM tracks)),
s AS (SELECT *, {_stem('file_path')} AS stem FROM shown),
p AS (SELECT *, {_group(_P1, 2, 'stem')} AS t, {_group(_P1, 1, "'Unknown Artist'")} AS a FROM s)
SELECT query_id, rank, CASE WHEN rank = 0 THEN t ELSE substring(t, 1, 50) END AS title,
       CASE WHEN rank = 0 THEN a ELSE substring(a, 1, 30) END AS artist,
       {_mmss('duration')} AS duration,
       CASE WHEN rank = 0 THEN '100%' ELSE {_PERCENT.format(s='score')} END AS similarity,
       CASE WHEN rank = 0 THEN 'query' ELSE {_BAND.format(s='score')} END AS band
FROM p""",
    "signal_rms": f"WITH {_FRAMES}, r AS (SELECT track_id, f, sqrt(sum(x * x) / 16) AS v FROM fr GROUP BY ALL) "
    + _stats("rms", "r", "v", 6),
    "signal_zcr": f"""
WITH {_FRAMES},
sg AS (SELECT track_id, f, j, CASE WHEN abs(e) <= 1e-10 THEN false ELSE e < 0 END AS neg FROM fr),
z AS (
  SELECT a.track_id, a.f, count(*) FILTER (a.neg <> b.neg) / 16 AS v
  FROM sg a JOIN sg b ON b.track_id = a.track_id AND b.f = a.f AND b.j = a.j - 1 GROUP BY ALL)
"""
    + _stats("zero_crossing_rate", "z", "v", 6),
    "signal_centroid": f"WITH {_SPECTRUM} " + _stats("spectral_centroid", "cen", "c", 4),
    "signal_bandwidth": f"""
WITH {_SPECTRUM},
bw AS (
  SELECT track_id, f, sqrt(sum(s / total * (freq - c) * (freq - c))) AS v
  FROM mag JOIN cen USING (track_id, f) GROUP BY ALL)
"""
    + _stats("spectral_bandwidth", "bw", "v", 4),
    "signal_mfcc": f"WITH {_MFCC}",
    "pcm_ingest": f"""
WITH {_PCM}
SELECT '/docs/' || doc_id || '.pcm' AS file_path, NULL AS error, n AS n_samples, round(n / 44100, 6) + 0.0 AS duration,
       sum(x)::BIGINT AS total, min(x)::BIGINT AS low, max(x)::BIGINT AS high
FROM s GROUP BY ALL
UNION ALL
SELECT '/docs/' || doc_id || '.pcm', 'empty signal', NULL, NULL, NULL, NULL, NULL FROM d WHERE n = 0""",
    "track_basics": f"""
WITH {_PCM},
e AS (
  SELECT doc_id, n, i, sum(x * x) OVER w AS energy,
         sum(CASE WHEN (x < 0) <> (before < 0) THEN 1 ELSE 0 END) OVER w AS turns
  FROM (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM s)
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
f AS (
  SELECT doc_id, n, greatest(512 * k - 1024, 0) AS a, least(512 * k + 1024, n) - 1 AS b
  FROM (SELECT doc_id, n, UNNEST(range(0, n // 512 + 1)) AS k FROM d WHERE n > 0)
),
m AS (
  SELECT f.doc_id, sqrt((hi.energy - coalesce(lo.energy, 0)) / 2048) / 32768 AS rms, (hi.turns - fst.turns) / 2048 AS zcr
  FROM f JOIN e hi ON hi.doc_id = f.doc_id AND hi.i = f.b + 1
  JOIN e fst ON fst.doc_id = f.doc_id AND fst.i = f.a + 1
  LEFT JOIN e lo ON lo.doc_id = f.doc_id AND lo.i = f.a
),
r AS (
  SELECT doc_id, avg(rms) AS rm, stddev_pop(rms) AS rs, avg(zcr) AS zm, stddev_pop(zcr) AS zs FROM m GROUP BY doc_id
)
SELECT '/docs/' || d.doc_id || '.pcm' AS file_path, d.doc_id || '.pcm' AS file_name, '.pcm' AS file_extension,
       round(octet_length(b) / 1048576, 9) + 0.0 AS file_size_mb, CASE WHEN n = 0 THEN 'empty signal' END AS error,
       CASE WHEN n > 0 THEN round(n / 44100, 6) + 0.0 END AS duration,
       round(rm, 6) + 0.0 AS rms_mean, round(rs, 6) + 0.0 AS rms_std,
       round(zm, 6) + 0.0 AS zero_crossing_rate_mean, round(zs, 6) + 0.0 AS zero_crossing_rate_std,
       CASE WHEN n > 0 THEN 0.0::DOUBLE END AS chroma_12_std, CASE WHEN n > 0 THEN 120.0::DOUBLE END AS tempo,
       CASE WHEN n > 0 THEN 0.0::DOUBLE END AS drone_likelihood
FROM d LEFT JOIN r ON r.doc_id = d.doc_id""",
    "history50": f"WITH {_HISTORY} SELECT user_id, epoch_us(ts) AS ts_us, event_id, song FROM h50",
    "history_rolling": f"""
WITH {_PLAYS}
SELECT user_id, event_id,
       array_to_string(list(song) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), ',') AS history
FROM plays""",
    "previous_track": f"""
WITH {_PLAYS}
SELECT user_id, event_id, song,
       lag(song) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous,
       lag(song, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS third_last
FROM plays""",
    "user_queue": f"""
WITH {_QUEUE}, {_TRACKS}
SELECT user_id, seed, pos, q.id,
       CASE WHEN t.id IS NULL THEN 'Unknown Title' ELSE coalesce(t.title, {_base('t.file_path')}) END AS title,
       round(score, 6) + 0.0 AS score
FROM queue q LEFT JOIN tracks t ON t.id = q.id WHERE pos < 10""",
    "top5": f"WITH {_QUEUE} SELECT user_id, pos, id, round(score, 6) + 0.0 AS score FROM queue WHERE pos < 5",
    "auto_advance": f"""
WITH {_ADVANCES}
SELECT user_id, event_id, is_auto, advance, advance // 6 AS epoch, advance % 6 AS slot,
       advance > 0 AND advance % 6 = 0 AS refresh
FROM adv""",
    "next_from_queue": f"""
WITH {_ADVANCES}, {_near(45)},
seq AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM adv),
builders AS (SELECT * FROM seq WHERE advance % 6 = 0 AND session > 0),
fresh AS (
  SELECT b.user_id, b.session, b.advance // 6 AS epoch, b.song, n.id,
         row_number() OVER (PARTITION BY b.event_id ORDER BY n.rank) AS r
  FROM builders b JOIN near n ON n.query_id = b.song
  WHERE NOT EXISTS (
    SELECT 1 FROM seq h
    WHERE h.user_id = b.user_id AND h.pos BETWEEN b.pos - 49 AND b.pos AND h.song = n.id)),
queue AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, session, epoch ORDER BY r) - 1 AS place,
         count(*) OVER (PARTITION BY user_id, session, epoch) AS n
  FROM (SELECT * FROM fresh WHERE r <= 15 AND id <> song)),
queue10 AS (SELECT *, least(n, 10) AS size FROM queue WHERE place < 10),
sizes AS (
  SELECT b.user_id, b.session, b.advance // 6 AS epoch, coalesce(max(q.size), 0) AS size
  FROM builders b LEFT JOIN queue10 q ON q.user_id = b.user_id AND q.session = b.session AND q.epoch = b.advance // 6
  GROUP BY ALL),
alive AS (
  SELECT *, min(size) OVER (PARTITION BY user_id, session ORDER BY epoch) > 0 AS ok FROM sizes)
SELECT s.user_id, s.event_id, s.advance // 6 AS epoch, s.advance % 6 AS slot, q.id AS next_id
FROM seq s
LEFT JOIN alive a ON a.user_id = s.user_id AND a.session = s.session AND a.epoch = s.advance // 6 AND a.ok
LEFT JOIN queue10 q ON q.user_id = a.user_id AND q.session = a.session AND q.epoch = a.epoch AND q.place = (s.advance % 6) % a.size
WHERE s.is_auto""",
    "playlist_cycle": f"""
WITH {_PLAYS},
w AS (
  SELECT user_id, event_id AS pos, song,
         lead(song) OVER p AS nx, lag(song) OVER p AS pv,
         first_value(song) OVER p AS fs, last_value(song) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ls
  FROM plays WINDOW p AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, pos, song, coalesce(nx, fs) AS next_song, coalesce(pv, ls) AS previous_song FROM w""",
    "playlist_first_steps": f"""
WITH {_PLAYS}
SELECT user_id, arg_min(song, event_id) AS next_song,
       coalesce(list(song ORDER BY event_id DESC)[2], list(song ORDER BY event_id DESC)[1]) AS previous_song
FROM plays GROUP BY user_id""",
    "song_end": """
WITH smp AS (
  SELECT user_id % 20 AS device_id, ts, event_id, user_id AS song,
         event_type IN ('view', 'click', 'purchase') AS busy, event_type <> 'error' AS playing
  FROM events),
runs AS (
  SELECT *, sum(busy::INT) OVER (PARTITION BY device_id ORDER BY ts, event_id) AS run FROM smp),
named AS (
  SELECT *, max(CASE WHEN busy THEN song END) OVER (PARTITION BY device_id, run) AS run_song FROM runs WHERE run > 0),
settled AS (
  SELECT *, row_number() OVER (PARTITION BY device_id, run ORDER BY ts, event_id) AS r
  FROM named WHERE NOT busy AND song IS NOT DISTINCT FROM run_song)
SELECT device_id, epoch_us(ts) AS ts_us, event_id, song FROM settled WHERE r = 1 AND playing""",
    "mode_islands": f"WITH {_TOGGLES} SELECT user_id, event_id, kind, mode FROM modes",
    "mode_at_end": f"""
WITH {_TOGGLES},
e AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'),
j AS (
  SELECT e.user_id, e.event_id, coalesce(m.mode, 'none') AS mode,
         row_number() OVER (PARTITION BY e.event_id ORDER BY m.ts DESC NULLS LAST, m.event_id DESC) AS r
  FROM e LEFT JOIN modes m ON m.user_id = e.user_id AND m.ts <= e.ts)
SELECT user_id, event_id, mode,
       CASE mode WHEN 'loop' THEN 'replay' WHEN 'auto' THEN 'next_in_queue' ELSE 'stop' END AS action
FROM j WHERE r = 1""",
}

# The same results by other routes through the library.
ORACLE |= {
    f"{name}_sliced": ORACLE[name]
    for name in ("history_rolling", "previous_track", "auto_advance", "playlist_cycle", "song_end", "mode_islands")
}
ORACLE["knn_join_cells"] = ORACLE["knn_join"]
ORACLE["knn_approximate"] = "SELECT count(*) AS n_queries, true AS recall_reached FROM embeddings"
# Of two standardised columns with correlation r the components are their sum and difference over sqrt(2), with variances 1 + r and 1 - r.
ORACLE["pca_cut"] = """
WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_quantity + 20 * l_discount AS b FROM lineitem),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, corr(a, b) AS r FROM t)
SELECT l_orderkey, l_linenumber, CASE WHEN (1 + r) / 2 > 0.95 THEN 1 ELSE 2 END::INT AS kept,
       CASE WHEN (1 + r) / 2 > 0.95 THEN round((1 + r) / 2, 6) ELSE 1.0 END AS explained,
       round(((a - ma) / sa + (b - mb) / sb) / sqrt(2), 6) + 0.0 AS value
FROM t, m"""
