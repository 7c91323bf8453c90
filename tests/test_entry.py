"""The entry points, and queries against SQL on the smallest tables."""

import math
import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
from tallyspark.plans import catalogue

FOLDER = os.environ.get("TALLY_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def rows_of(rows):
    return sorted(repr(tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r)) for r in rows)


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = rows_of(tuple(r) for r in df.select(*cols).collect())
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert got == rows_of(con.sql(f"select {quoted} from ({catalogue.ORACLE[name]})").fetchall())


def test_pairs_between_08_and_09(spark, tmp_path):
    r = random.Random(3)
    rows = []
    for k in range(40):
        words = [f"w{r.randrange(9000)}" for _ in range(150)]
        rows.append((2 * k, " ".join(words)))
        for i in range(1 + k % 5):
            words[10 + 30 * i] = "x"
        rows.append((2 * k + 1, " ".join(words)))
    bags = [{tuple(t.split()[i : i + 5]) for i in range(146)} for _, t in rows]
    of = {(i, j): len(bags[i] & bags[j]) / len(bags[i] | bags[j]) for j in range(len(rows)) for i in range(j)}
    want = {p for p, s in of.items() if s >= 0.8}
    assert sum(of[p] < 0.9 for p in want) >= 8
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(x) for x in entry.queries()["minhash_pairs_80"](spark, str(tmp_path)).select("a", "b").collect()} == want


def test_links_between_classes_of_copies(spark, tmp_path):
    r = random.Random(5)
    first = [f"w{r.randrange(9000)}" for _ in range(100)]
    near = [*first[:50], "x", *first[51:]]
    texts = [(10 + i, " ".join(first)) for i in range(60)] + [(200 + i, " ".join(near)) for i in range(3)] + [(1, ""), (2, None), (3, "a b"), (4, "a  b"), (5, "c")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(x) for x in entry.queries()["minhash_links"](spark, str(tmp_path)).collect()}
    members = {(10, 10 + i, "member") for i in range(60)} | {(200, 200 + i, "member") for i in range(3)}
    assert got == members | {(10, 200, "link"), (3, 3, "member"), (3, 4, "member"), (5, 5, "member")}
    pairs = {tuple(x) for x in entry.queries()["minhash_pairs_80"](spark, str(tmp_path)).select("a", "b").collect()}
    alike = [d for d, t in texts if d >= 10]
    assert pairs == {(a, b) for a in alike for b in alike if a < b} | {(3, 4)}


@needs_data
def test_entry(spark):
    assert entry.entry(spark).columns == ["event_type", "q", "sign", "bucket"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_window_of_many_users(spark, tmp_path):
    ev = spark.range(30_000).selectExpr("id as event_id", "timestamp_seconds(id % 2 * 3600) as ts", "id div 2 as user_id")
    ev.write.parquet(f"{tmp_path}/events.parquet")
    assert {tuple(x) for x in entry.queries()["sliding_window_distinct"](spark, str(tmp_path)).collect()} == {(0, 15_000), (1, 15_000)}


def test_repeats_far_apart_are_not_forgotten(spark, tmp_path):
    """150,000 users in turn, twice: four filters of a million cells forget most of them on the way."""
    spark.range(300_000).selectExpr("id as event_id", "id % 150000 as user_id").write.parquet(f"{tmp_path}/events.parquet")
    assert tuple(entry.queries()["stable_dedup"](spark, str(tmp_path)).first()) == (300_000, 0, True)
