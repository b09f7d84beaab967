"""Registered queries of the training-data operators, and their SQL where
SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm.common import read_docs


def op3_pow2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievekit.llm.pow2_packing import pack_digest

    return pack_digest(read_docs(spark, sf_dir))


def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievekit.llm.ordinal_quality import fit, grade_column, score

    docs = read_docs(spark, sf_dir)
    model = fit(docs, read_docs(spark, sf_dir, "labels"), grade_column())
    return score(docs.select("doc_id", "text"), model).drop("text")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievekit.llm.suffix_dedup import dedup_digest

    return dedup_digest(read_docs(spark, sf_dir).select("doc_id", "text"))


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievekit.llm.merkle import with_next

    return with_next(read_docs(spark, sf_dir))


def op10_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievekit.llm.bpe_stream import round_trip

    return round_trip(read_docs(spark, sf_dir).select("doc_id", "text"))


def op1_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievekit.llm.window_dedup import dedup_digest

    return dedup_digest(read_docs(spark, sf_dir).select("doc_id", "text"))


def op2_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievekit.llm.decision_list import fit, judge

    docs = read_docs(spark, sf_dir)
    rules = fit(docs, read_docs(spark, sf_dir, "labels"))
    return judge(docs.select("doc_id", "text"), rules).drop("text")


def op8_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievekit.llm.warc_revisit import resolve_pages

    return resolve_pages(read_docs(spark, sf_dir, "pages"))


def op9_gru_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievekit.llm.gru_langid import fit, held_out, predict

    docs = read_docs(spark, sf_dir)
    net = fit(docs, ~held_out())
    return predict(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievekit.llm.simhash_gray import near_groups

    return near_groups(read_docs(spark, sf_dir))


def op11_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievekit.llm.voronoi_knn import top_k

    return top_k(read_docs(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievekit.llm.conversation_repair import damage, repair, rows_of

    return repair(damage(rows_of(read_docs(spark, sf_dir, "conversations"))))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievekit.llm.merkle_manifest import verify

    return verify(read_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_window_dedup": op1_window_dedup,
    "op2_decision_list": op2_decision_list,
    "op3_pow2_packing": op3_pow2_packing,
    "op4_simhash_gray": op4_simhash_gray,
    "op5_ordinal_quality": op5_ordinal_quality,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_merkle": op7_merkle,
    "op8_warc_revisit": op8_warc_revisit,
    "op9_gru_langid": op9_gru_langid,
    "op10_bpe_stream": op10_bpe_stream,
    "op11_voronoi_knn": op11_voronoi_knn,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_window_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d),
x AS (SELECT doc_id, i, w[i] AS word,
             CASE WHEN i + 34 <= len(w) THEN md5(array_to_string(w[i:i+34], ' ')) END AS h FROM p),
c AS (SELECT h FROM x WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
f AS (SELECT x.doc_id, x.i, x.word, c.h IS NOT NULL AS hit FROM x LEFT JOIN c ON x.h = c.h),
g AS (SELECT doc_id, i, word,
             bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM f),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
             coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id""",
    "op6_suffix_dedup": """
WITH l AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
q AS (SELECT doc_id, n, x, unnest(generate_series(0, (n - 400) // 500)) AS j FROM l WHERE n >= 400),
y AS (SELECT doc_id, n, j, substr(x, 1000 * j + 1, 1798) AS z FROM q),
w AS (SELECT doc_id, j, z, unnest(generate_series(0, least(499, n - 400 - 500 * j))) AS k FROM y),
h AS (SELECT doc_id, 500 * j + k AS i, md5_number(substr(z, 2 * k + 1, 800)) AS h FROM w),
c AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
r AS (SELECT h.doc_id, h.i FROM h JOIN c ON h.h = c.h),
s AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, -1) AS begins FROM r),
t AS (SELECT doc_id, i, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM s),
u AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM t GROUP BY doc_id, span),
v AS (SELECT u.doc_id, a, b, x, coalesce(lag(b) OVER (PARTITION BY u.doc_id ORDER BY a), 0) AS before FROM u JOIN l ON u.doc_id = l.doc_id),
k AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
             string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM v GROUP BY doc_id)
SELECT l.doc_id, l.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN k.doc_id IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM l LEFT JOIN k ON l.doc_id = k.doc_id""",
    "op8_warc_revisit": """
WITH b AS (SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages),
q AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^www\\.', '') AS host,
        regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
        array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^utm_'))), '&') AS kept FROM b),
c AS (SELECT page_id, html, host || path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical,
        TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL 60 SECOND AS made, substr(md5(html), 1, 16) AS tag FROM q),
k AS (SELECT *, ('0x' || substr(md5(page_id::VARCHAR), 1, 8))::BIGINT AS pick FROM c),
resp AS (SELECT page_id * 2 AS record_id, canonical, made AS ts, CASE WHEN pick % 5 = 4 THEN NULL ELSE '"' || tag || '"' END AS etag, 'day ' || (pick % 365) AS lm, strlen(html) AS len FROM k),
rev AS (SELECT page_id, page_id * 2 + 1 AS record_id, canonical, made + (pick % 2592000 - 86400) * INTERVAL 1 SECOND AS ts,
        CASE WHEN pick % 7 = 6 THEN '"changed"' ELSE 'W/"' || tag || '"' END AS etag, 'day ' || (pick % 365) AS lm FROM k),
a AS (SELECT rev.*, (SELECT max({'ts': r.ts, 'id': r.record_id}) FROM resp r WHERE r.canonical = rev.canonical AND (r.ts < rev.ts OR (r.ts = rev.ts AND r.record_id < rev.record_id))) AS top FROM rev),
j AS (SELECT a.*, r.record_id AS rid, r.etag AS retag, r.lm AS rlm, r.len FROM a LEFT JOIN resp r ON r.record_id = a.top.id),
s AS (SELECT *, CASE WHEN rid IS NULL THEN 'no_response' WHEN (retag IS NOT NULL AND regexp_replace(etag, '^W/', '') = retag) OR (retag IS NULL AND lm = rlm) THEN 'resolved' ELSE 'validator_mismatch' END AS status FROM j)
SELECT record_id, canonical, status, CASE WHEN status = 'resolved' THEN rid::VARCHAR END AS response_id,
  concat_ws(chr(10), 'cache-control: no-cache', 'content-length: ' || CASE WHEN status = 'resolved' THEN len ELSE 0 END,
            CASE WHEN status = 'resolved' THEN 'content-type: text/html' END, 'date: ' || page_id, 'etag: ' || etag, 'last-modified: ' || lm) AS headers
FROM s""",
    "op11_voronoi_knn": """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v)::BIGINT AS score FROM v q JOIN v e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op13_merkle_manifest": """
WITH RECURSIVE fields AS (
  SELECT doc_id, lang,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body,
    coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(doc_id::VARCHAR, '')])),
      lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) % 3 = 0 AS hit
  FROM documents),
leaf AS (SELECT doc_id, lang, sha256(head || body) AS h, CASE WHEN hit THEN sha256(head || low) ELSE sha256(head || body) END AS claim FROM fields),
langs AS (SELECT lang, count(*) AS cnt, row_number() OVER (ORDER BY lang IS NOT NULL, encode(coalesce(lang, ''))) - 1 AS t FROM leaf GROUP BY lang),
place AS (SELECT leaf.*, t, cnt, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM leaf JOIN langs ON leaf.lang IS NOT DISTINCT FROM langs.lang),
lv(t, lvl, i, h, cnt) AS (
  SELECT t, 0, i, h, cnt FROM place
  UNION ALL
  SELECT t, lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (cnt + 7) // 8 FROM lv WHERE cnt > 1 GROUP BY t, lvl, i // 8, cnt),
sub AS (SELECT t, h FROM lv WHERE cnt = 1),
tops(lvl, i, h, cnt) AS (
  SELECT 0, t, h, (SELECT count(*) FROM sub) FROM sub
  UNION ALL
  SELECT lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (cnt + 7) // 8 FROM tops WHERE cnt > 1 GROUP BY lvl, i // 8, cnt),
run AS (SELECT t, lvl, i // 8 AS p, list(h ORDER BY i) AS hs FROM lv WHERE cnt > 1 GROUP BY t, lvl, i // 8),
toprun AS (SELECT lvl, i // 8 AS p, list(h ORDER BY i) AS hs FROM tops WHERE cnt > 1 GROUP BY lvl, i // 8),
up(t, i, lvl, k, h, proof) AS (
  SELECT t, i, 0, i, claim, '' FROM place
  UNION ALL
  SELECT up.t, up.i, up.lvl + 1, k // 8,
    sha256(array_to_string(hs[:k % 8], '') || h || array_to_string(hs[k % 8 + 2:], '')),
    proof || array_to_string(hs[:k % 8], '') || array_to_string(hs[k % 8 + 2:], '')
  FROM up JOIN run ON up.t = run.t AND up.lvl = run.lvl AND up.k // 8 = run.p),
done AS (SELECT t, i, max(lvl) AS lvl, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof FROM up GROUP BY t, i),
up2(t, i, lvl, k, h, proof) AS (
  SELECT t, i, 0, t, h, proof FROM done
  UNION ALL
  SELECT up2.t, up2.i, up2.lvl + 1, k // 8,
    sha256(array_to_string(hs[:k % 8], '') || h || array_to_string(hs[k % 8 + 2:], '')),
    proof || array_to_string(hs[:k % 8], '') || array_to_string(hs[k % 8 + 2:], '')
  FROM up2 JOIN toprun ON up2.lvl = toprun.lvl AND up2.k // 8 = toprun.p),
fin AS (SELECT t, i, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof FROM up2 GROUP BY t, i)
SELECT doc_id, place.h AS leaf, sub.h AS subroot, r.h AS root, sha256(fin.proof) AS proof_sha256, fin.h AS folded_root, fin.h = r.h AS verified
FROM place JOIN fin ON place.t = fin.t AND place.i = fin.i JOIN sub ON place.t = sub.t, (SELECT h FROM tops WHERE cnt = 1) r""",
}
