import datetime as dt
import random
import tempfile

import pytest

import corpus_pipeline
from sievekit.llm import warc_revisit
from sievekit.llm.queries import ORACLES, QUERIES

SCHEMA = "record_id long, kind string, url string, ts timestamp, headers map<string,string>, status string"
DAY = dt.datetime(2024, 1, 1)


def brute(rows):
    def lower(h):
        return {k.lower(): v for k, v in (h or {}).items()}

    out = {}
    for r in rows:
        if r[1] != "revisit":
            continue
        early = [x for x in rows if x[1] == "response" and None not in (x[2], x[3], r[2], r[3]) and x[2] == r[2] and (x[3], x[0]) < (r[3], r[0])]
        mine = lower(r[4])
        if not early:
            out[r[0]] = ("no_response", None, mine)
            continue
        x = max(early, key=lambda y: (y[3], y[0]))
        old = lower(x[4])
        if "etag" in mine and "etag" in old:
            good = mine["etag"].removeprefix("W/") == old["etag"].removeprefix("W/")
        else:
            good = mine.get("last-modified", 1) == old.get("last-modified", 2)
        if good:
            out[r[0]] = ("resolved", x[0], old | {k: v for k, v in mine.items() if k not in warc_revisit.KEPT_FIELDS})
        else:
            out[r[0]] = ("validator_mismatch", None, mine)
    return out


@pytest.mark.parametrize("slot_rows", [50_000, 7])
def test_revisits_equal_brute_force(spark, slot_rows):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        kind = rng.choice(["response", "revisit"])
        url = rng.choice(["hot.org/a"] * 6 + ["b.org/x", "c.org/y", None])
        headers = rng.choice([None, {}, {"ETag": rng.choice(['"1"', 'W/"1"', '"2"']), "Content-Length": str(i), "X": str(i)}, {"Last-Modified": rng.choice("ab"), "date": str(i)}])
        rows.append((i, kind, url, rng.choice([None] + [DAY + dt.timedelta(minutes=rng.randint(0, 150))] * 12), headers, "clash"))
    got = warc_revisit.resolve(spark.createDataFrame(rows, SCHEMA), slot_rows).collect()
    assert {r.record_id: (r.status, r.response_id, dict(r.headers)) for r in got} == brute(rows)
    assert warc_revisit.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_url_with_ten_thousand_equal_times(spark):
    tag = {"ETag": '"1"'}
    rows = [(i, "response" if i % 997 == 3 else "revisit", "hot.org/a", DAY, tag, "") for i in range(10_000)]
    rows += [(20_000 + i, k, "cold.org", DAY, tag, "") for i, k in enumerate(["revisit", "response", "revisit"])]
    got = {r.record_id: r.response_id for r in warc_revisit.resolve(spark.createDataFrame(rows, SCHEMA), 100).collect()}
    want, last = {}, None
    for i, kind, *_ in rows[:10_000]:
        if kind == "response":
            last = i
        else:
            want[i] = last
    assert got == want | {20_000: None, 20_002: 20_001}


def test_canonical_urls(spark):
    cases = {
        "HTTP://www.Example.com:80/a/?b=2&utm_source=x&a=1#top": "example.com/a?a=1&b=2",
        "https://example.com/a?a=1&b=2": "example.com/a?a=1&b=2",
        "https://u@example.com:443/": "example.com",
        "example.com?x": "example.com?x",
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    assert {r.url: r.c for r in df.select("url", warc_revisit.canonical_url(df.url).alias("c")).collect()} == cases


def test_equal_header_names_last_wins(spark):
    rows = [(1, "response", "a.org", DAY, {"ETag": "1", "etag": "2"}, ""), (2, "revisit", "a.org", DAY, {"etag": "2"}, "")]
    assert warc_revisit.resolve(spark.createDataFrame(rows, SCHEMA)).first().status == "resolved"


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_stages_keep_columns_and_take_effect(spark, make, odd):
    rng = random.Random(9)
    own = {"en": ["the", "of", "and", "stone", "river", "window"], "fr": ["le", "à", "été", "fenêtre", "rivière"]}
    vocabulary = {k: [w + rng.choice(["", "a", "or", "en"]) + str(n % 7) for w in v for n in range(40)] for k, v in own.items()}
    rows = [(100 + i, " ".join(rng.choice(vocabulary[k]) for _ in range(120)), k) for i in range(60) for k in [("en", "fr")[i % 2]]]
    passage = " ".join(rng.choice(vocabulary["en"]) for _ in range(90))
    rows += [(300 + i, " ".join(rng.choice(vocabulary["en"]) for _ in range(200)) + " " + passage, "en") for i in range(3)]
    rows += [(400, rows[0][1], "en"), (401, "12 34 " * 60, "en")]
    docs = make(rows).unionByName(odd)

    folder = tempfile.mkdtemp(prefix="pipeline-test-")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(100, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, folder)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{folder}/{name}")
        kept = spark.read.parquet(f"{folder}/{name}")
        seen.append(kept.collect())
    ids = [{r.doc_id for r in s} for s in seen]
    assert not ids[0] & {1, 2, 3, 7, 401} and {r[0] for r in rows if r[0] != 401} <= ids[0]
    assert 10 not in ids[1] and {300, 301, 302, 400} <= ids[1]
    assert 400 not in ids[2] and 100 in ids[2] and {300, 301, 302} <= ids[2]
    assert all(passage not in r.text and r.n_chars == len(r.text) for r in seen[3] if 300 <= r.doc_id <= 302)
    final = corpus_pipeline.run(spark, folder).collect()
    want = corpus_pipeline.STAGES[-1][1](spark, kept, folder).collect()
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in final) == sorted((r.doc_id, r.start, r.ids_crc32) for r in want)
    assert {r.doc_id for r in final} == ids[3]
