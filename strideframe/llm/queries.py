"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm.bpe import encode_documents
from strideframe.llm.licenses import scan_licenses
from strideframe.llm.lines import remove_repeated_lines
from strideframe.llm.media import text_as_audio
from strideframe.llm.packing import pack_documents
from strideframe.llm.pieces import encode_pieces
from strideframe.llm.pii import BASE_KINDS, find_pii
from strideframe.llm.quality import score_quality
from strideframe.llm.runs import periodic_runs
from strideframe.llm.sharding import shard_by_bytes
from strideframe.llm.simhash import near_duplicates
from strideframe.llm.spelling import spelling_variants
from strideframe.llm.topk import top_k


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, bits=4)


def op2_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1, with_ids=False)


def op3_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeated_lines(_table(spark, sf_dir, "documents"), min_words=50, report=True)
    return done.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op4_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op5_wav_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return text_as_audio(_table(spark, sf_dir, "documents"), outputs=outputs)


def op6_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter("vec_id % 50 = 0"), k=5, scale=256.0)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op8_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    out = shard_by_bytes(_table(spark, sf_dir, "documents"), shards=16, keep={"text_crc32": crc})
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    # The span column comes from Python; the optimizer must not run it once for each use.
    found = found.select("doc_id", "spans")
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op10_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "source", "lang", "doc_score", "host_posterior", "path_posterior", "posterior", "keep")


def op11_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op12_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"), min_length=7, min_count=2, times=10, plant=True)


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_table(spark, sf_dir, "documents"), plant=True, outputs=("n_runs", "best", "runs_sha256", "collapsed_sha256"))
    milli = F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period"))
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_simhash_pivot, op2_bounded_packing, op3_line_runs, op4_merge_replay, op5_wav_peaks, op6_histogram_topk, op7_license_scan, op8_histogram_shards, op9_weak_pii, op10_bayes_quality, op11_piece_agenda, op12_spelling_forms, op13_word_runs)
    return {f.__name__: f for f in own}


#: A line goes where a run of lines with 50 or more words around it began earlier elsewhere: every run
#: is the union of the shortest windows from its first line on and up to each of its later lines.
_OP3_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM d),
w AS (SELECT doc_id, ls, pos, len(regexp_extract_all(ls[pos], '[^\x20\x09-\x0D]+')) AS words FROM l),
c AS (SELECT doc_id, ls, pos, words, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM w),
f AS (SELECT a.doc_id, a.pos, min(b.pos) AS last FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.words >= 50 GROUP BY a.doc_id, a.pos),
t AS (SELECT b.doc_id, max(a.pos) AS pos, b.pos AS last FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.words >= 50 GROUP BY b.doc_id, b.pos),
k AS (SELECT doc_id, pos, last FROM f UNION SELECT doc_id, pos, last FROM t),
g AS (SELECT k.doc_id, k.pos, k.last, array_to_string(c.ls[k.pos:k.last], chr(10)) AS run FROM k JOIN c ON c.doc_id = k.doc_id AND c.pos = k.pos),
r AS (SELECT doc_id, pos, last, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS copy FROM g),
x AS (SELECT DISTINCT doc_id, unnest(range(pos, last + 1)) AS pos FROM r WHERE copy > 1),
m AS (SELECT l.doc_id, count(*) AS n_lines, count(x.pos) AS n_removed,
        coalesce(string_agg(l.ls[l.pos], chr(10) ORDER BY l.pos) FILTER (WHERE x.pos IS NULL), '') AS kept
      FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.pos = x.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(m.n_lines, 0) AS n_lines, coalesce(m.n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE md5(m.kept) END AS text_md5
FROM d LEFT JOIN m ON d.doc_id = m.doc_id
"""

_OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.vec, c.vec) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

#: The checksum is taken byte by byte from its table; near words agree where one letter is left out.
_OP12_SQL = r"""
WITH RECURSIVE t AS MATERIALIZED (SELECT list(list_reduce(list_prepend(b::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) ORDER BY b) AS v FROM range(256) AS r(b)),
u AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS c, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s FROM u WHERE length(run) >= 7 GROUP BY doc_id, run),
b AS (SELECT r.*, list_transform(range(strlen(hex(encode(s))) // 2), lambda i: ('0x' || substr(hex(encode(s)), CAST(2 * i + 1 AS INTEGER), 2))::UBIGINT) AS bytes FROM r),
h AS (SELECT run, c, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda a, x: xor(a // 256, t.v[CAST(xor(a % 256, x) AS INTEGER) + 1]))) AS h FROM b, t),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, sum(c)::BIGINT AS n FROM h GROUP BY word),
v AS MATERIALIZED (SELECT word, n FROM w WHERE length(word) >= 7 AND n >= 2),
d AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
m AS (SELECT word, n, i, substr(word, 1, CAST(i AS INTEGER)) || substr(word, CAST(i AS INTEGER) + 2) AS rest FROM d),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM m a JOIN m b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT m.word, v.word, v.n FROM m JOIN v ON m.rest = v.word UNION SELECT v.word, m.word, m.n FROM m JOIN v ON m.rest = v.word),
g AS (SELECT word, count(*) AS n_near, max(near_n) AS most FROM p GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(g.n_near, 0) AS n_near,
  CASE WHEN g.most >= 10 * v.n THEN (SELECT min(p.near) FROM p WHERE p.word = v.word AND p.near_n = g.most) END AS form, CASE WHEN g.most >= 10 * v.n THEN g.most END AS form_n FROM v LEFT JOIN g ON v.word = g.word),
c AS (SELECT word AS first, word, form FROM f UNION ALL SELECT c.first, f.word, f.form FROM c JOIN f ON f.word = c.form)
SELECT f.word, f.form, c.word AS root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.first = f.word AND c.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_runs": _OP3_SQL, "op6_histogram_topk": _OP6_SQL, "op12_spelling_forms": _OP12_SQL}
