"""P5: a model trained on the synthetic corpus (G1) scores the demo payload
library; fixed payloads as published with the original demo."""

from pyspark.sql import functions as F

from sievekit.functions.dialect import EXTENDED, FEATURE_COLUMNS
from sievekit.operators.features import add_payload_features
from sievekit.operators.models import DEFAULT_MODELS, build_pipeline, decode_predictions, index_labels
from sievekit.operators.synth import synthetic_corpus

# fixed values: the demo's example payload library (class, payload)
LIBRARY = [
    ("XSS", "<script>alert('XSS')</script>"),
    ("XSS", "<img src=x onerror=alert(document.cookie)>"),
    ("XSS", "<svg onload=alert(1)>"),
    ("XSS", "<body onload=alert('hacked')>"),
    ("SQLi", "1' OR '1'='1'--"),
    ("SQLi", "1 UNION SELECT null,table_name FROM information_schema.tables--"),
    ("SQLi", "admin'--"),
    ("SQLi", "1' AND 1=1--"),
    ("Normal", "What is the weather in Chennai today?"),
    ("Normal", "best budget laptops under 50000"),
    ("Normal", "Hi, I would like to know your business hours."),
    ("Normal", "This product works great and arrived on time."),
]


def test_library_scored_by_synthetic_model(spark):
    corpus = synthetic_corpus(spark.range(400).withColumnRenamed("id", "k"), "k", seed=42)
    feats = add_payload_features(corpus, "payload", EXTENDED)
    idx = index_labels(feats, "label")
    train = idx.transform(feats)
    model = build_pipeline(DEFAULT_MODELS["RandomForest"], list(FEATURE_COLUMNS), train.count(), 3).fit(train)
    lib = spark.createDataFrame(LIBRARY, "expected string, payload string")
    scored = decode_predictions(model.transform(add_payload_features(lib, "payload", EXTENDED)), idx, "predicted")
    rows = scored.select("expected", "predicted").collect()
    assert len(rows) == len(LIBRARY)
    acc = sum(r["expected"] == r["predicted"] for r in rows) / len(rows)
    assert acc >= 0.75, rows
    # every XSS and every normal library payload gets its class. Known miss
    # (observed, kept visible): the long "1 UNION SELECT ... FROM
    # information_schema.tables--" payload reads as prose to a forest trained
    # on the hash-generated corpus and is predicted Normal.
    assert all(r["predicted"] == r["expected"] for r in rows if r["expected"] in ("XSS", "Normal"))


# fixed values: the batch scorer's example library (class, payload)
BASE_LIBRARY = [
    ("XSS", "<script>alert('XSS')</script>"),
    ("XSS", "<img src=x onerror=alert(document.cookie)>"),
    ("XSS", "<svg/onload=alert(1)>"),
    ("XSS", "<body onload=alert('hacked')>"),
    ("XSS", "<a href=\"javascript:alert(1)\">click</a>"),
    ("SQLi", "1' OR '1'='1'--"),
    ("SQLi", "1 UNION SELECT null,table_name FROM information_schema.tables--"),
    ("SQLi", "'; DROP TABLE users;--"),
    ("SQLi", "1' AND SLEEP(5)--"),
    ("SQLi", "admin'--"),
    ("Normal", "What is the weather in Chennai today?"),
    ("Normal", "Select a paint color for the living room"),
    ("Normal", "Hello, my name is Alex and I need help"),
    ("Normal", "email=john@example.com&name=John+Doe"),
]
# fixed values: the exploratory notebook's six demo payloads (class, payload)
NOTEBOOK_PAYLOADS = [
    ("Normal", "Select a paint color for the room."),
    ("SQLi", "1' OR '1'='1'; DROP TABLE users;--"),
    ("XSS", "<script>alert('XSS')</script>"),
    ("XSS", "<img src=x onerror=alert(document.cookie)>"),
    ("Normal", "Hello, how are you today?"),
    ("SQLi", "1 UNION ALL SELECT null,null,table_name FROM information_schema.tables--"),
]


def test_other_libraries_scored_by_synthetic_model(spark):
    corpus = synthetic_corpus(spark.range(400).withColumnRenamed("id", "k"), "k", seed=42)
    feats = add_payload_features(corpus, "payload")
    idx = index_labels(feats, "label")
    train = idx.transform(feats)
    model = build_pipeline(DEFAULT_MODELS["RandomForest"], list(FEATURE_COLUMNS), train.count(), 3).fit(train)
    for library in (BASE_LIBRARY, NOTEBOOK_PAYLOADS):
        lib = spark.createDataFrame(library, "expected string, payload string")
        scored = decode_predictions(model.transform(add_payload_features(lib, "payload")), idx, "predicted")
        rows = scored.select("expected", "payload", "predicted").collect()
        assert len(rows) == len(library)
        assert all(r["predicted"] == "XSS" for r in rows if r["expected"] == "XSS"), rows
        assert sum(r["expected"] == r["predicted"] for r in rows) / len(rows) >= 0.6, rows
