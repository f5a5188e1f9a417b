"""The secret scan against a plain version with regular expressions and recounted entropy."""

from __future__ import annotations

import random

import brute
import pytest
from pyspark.sql import functions as F

from grainwise.llm import secrets

PARTS = (
    "abcdef0123456789", "AKIA", " é🙂\n", "password", "token", "=:\"' ", "Secret", "API_KEY", "ABCDEFGHIJ0123456789",
    "abcxyzABC123+/_.=-", "api key", "0123456789abcdefXYZ",
)

# Secrets beside a word of the allow-list.
HIDDEN = ("examples/v1/Zx81kQ0pLm42VbTr9YcW7dQ4sT6u", "sample_key=Zx81kQ0pLm42VbTr9YcW7dQ4sT6u", "Zx81kQ0pLm42VbTr9YcW7dxxxxx")


def rows():
    rng = random.Random(2)
    out = []
    for i in range(800):
        n = rng.choice([1, 3, 10, 30, 120])
        out.append((i, "".join((rng.choice(a) if rng.random() < 0.6 else a) for a in rng.choices(PARTS, k=n))))
    uuid, hexes = "0f8fad5b-d9cd-469f-a165-70867728950e", "a1b2c3d4e5f60718"
    fixed = [
        None, "", "nothing here", f"id {uuid} end", f"{hexes}{hexes} {hexes[:15]}", "token=abc", "token = 'abcdefgh1234'",
        "é🙂 api_key: Zx81kQ0pLm42VbTr9YcW7d", "EXAMPLEkey81kQ0pLm42VbTr9YcW7d", "AKIAABCDEFGHIJKLMN AKIASHORT",
        "ſecret=abcdefghijklmn toKen=abcdefghijklmn", "a1" * 20_000, " ".join(f"token=abcdefgh12345{i:06d}" for i in range(1500)),
        "token=password=abcdefghijklmnop", "token=password: 'abcdefghijklmnop'",
        *HIDDEN, "examples/v1/aaaaaaaaaaaaaaaaaaaaa1", f"sha512-{'Zx81kQ0pLm42VbTr9YcW7d' * 4}", "Zx81kQ0pLmExampleVbTr9YcW7dQ4",
    ]
    return out + [(10_000 + i, t) for i, t in enumerate(fixed)]


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame(rows(), "doc_id long, text string")
    return made.select("doc_id", "text", F.lit("x").alias("spans"), F.lit(1).alias("found"), F.length("text").cast("long").alias("n_chars"))


def test_scan_equals_brute_force(docs):
    found = {r["doc_id"]: r for r in secrets.scan_secrets(docs).collect()}
    for doc_id, text in rows():
        r = found[doc_id]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) == brute.scanned(text), text and text[:200]
    assert sum(r["n_entropy"] for r in found.values()) > 20


def test_masks(docs):
    found = secrets.mask_secrets(docs)
    assert found.columns == docs.columns and found.schema == docs.schema
    texts = dict(rows())
    for r in found.collect():
        assert r["text"] == brute.masked(texts[r["doc_id"]])
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def test_allow_list_and_classes(spark):
    texts = ["0f8fad5b-d9cd-469f-a165-70867728950e", "sha512-Zx81kQ0pLm42VbTr9YcW7dAa", "aaaaaaaaaaaaaaaaaaaaaaa1", "Zx81kQ0pLm42VbTr9YcW7d", "zx81kq0plm42vbtr9ycw7d"]
    one = spark.createDataFrame([(t,) for t in texts], "t string").select("t", secrets.looks_random(F.col("t")).alias("r"))
    assert [r["r"] for r in one.collect()] == [False, False, False, True, True]


def test_an_allowed_word_does_not_hide_a_secret_beside_it(spark):
    docs = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(HIDDEN)], "doc_id long, text string")
    assert [r["text"] for r in secrets.mask_secrets(docs).orderBy("doc_id").collect()] == [f"see {secrets.MASK} there"] * 3
    kept = ["id 0f8fad5b-d9cd-469f-a165-70867728950e", "sha512-Zx81kQ0pLm42VbTr9YcW7dQ4sT6uZx81kQ0pLm42VbTr9YcW7dQ4sT6u", "Zx81kQ0pLmexampleVbTr9YcW7dQ4"]
    docs = spark.createDataFrame(list(enumerate(kept)), "doc_id long, text string")
    assert [r["text"] for r in secrets.mask_secrets(docs).orderBy("doc_id").collect()] == kept


def test_repeated_rows_missing_ids_and_nothing(spark):
    docs = spark.createDataFrame([(None, "deadbeefdeadbeef"), (1, "x"), (1, "x")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_hex"]) for r in secrets.scan_secrets(docs).collect()) == [(0, 1), (1, 0), (1, 0)]
    assert secrets.scan_secrets(docs.limit(0)).collect() == [] and secrets.mask_secrets(docs.limit(0)).collect() == []


def test_no_python_and_no_shuffle(docs, spark):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (secrets.scan_secrets(real), secrets.mask_secrets(real)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_scan_equals_its_sql(docs, spark, tmp_path):
    """A second derivation, in another engine: the query over a folder of odd texts, and its SQL."""
    import duckdb
    import oracle

    from grainwise.llm import queries

    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert oracle.difference(queries.op6_secret_scan(spark, str(tmp_path)), con, queries.ORACLE_SQL["op6_secret_scan"]) is None
