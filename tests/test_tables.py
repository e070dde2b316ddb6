"""Each query against its SQL on small tables of the same schemas, nulls and repeats among them."""

import datetime
import random

import duckdb
import pytest
import state_cases

from jobs import queries as job_queries  # noqa: F401  they register theirs with the others
from tessera.plans import source_queries, state_queries  # noqa: F401
from tessera.plans.queries import ORACLES, QUERIES

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_nationkey int",
    "supplier": "s_suppkey long, s_name string, s_nationkey int",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderdate timestamp",
    "lineitem": "l_orderkey long, l_suppkey long, l_quantity double, l_returnflag string",
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
}


def rows():
    rng = random.Random(16)
    day = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=k)
    words = ["the", "Licensed", "a|b", "token = 'x'", "c,d;", "***", "7", "me@x.org", "Ünï"]
    text = lambda: rng.choice([None, "", "same\ntext", "".join(rng.choice(words) + rng.choice(" \n .") for _ in range(rng.randint(1, 90)))])
    kinds = ["error", "view", "signup", "click"]
    return {
        "region": [(k, f"R{k}") for k in range(5)],
        "nation": [(k, f"N{k}", k % 5) for k in range(25)],
        "customer": [(k, k % 25) for k in range(30)],
        "supplier": [(k, f"Supplier {k}", (k * 7) % 25) for k in range(12)],
        "part": [(k, f"{rng.choice(['red', 'blue'])} {rng.choice(['widget', 'ring', 'bolt'])}", f"Brand#{k % 4}", rng.choice(["SMALL", "PROMO", "RING"]), k % 40, 900 + k / 10) for k in range(60)],
        "orders": [(k, k % 30, day(rng.randrange(9) * 86400)) for k in range(90)],
        "lineitem": [(rng.randrange(90), rng.randrange(12), float(rng.randrange(50)), rng.choice("ARN")) for _ in range(300)],
        "events": [(k, day(rng.randrange(5000)), rng.randrange(14), rng.choice(kinds), rng.choice([1.0, 150.0]), f'{{"k": {rng.randrange(14)}}}') for k in range(400)],
        "documents": [(k, text(), rng.choice(["en", "de", "fr"]), f"src{k % 13}", 1) for k in range(120)],
        "labels": [(k, 1, rng.randrange(2)) for k in range(0, 120, 3)],
        "pages": [(k, f"http://h{k % 5}.example.com/{rng.choice(['en', 'fr'])}/{rng.randrange(9)}{rng.choice(['', '#top', '?a=b'])}", "".join(f'<a href="/{rng.choice("abcXY")}">x</a>' for _ in range(rng.randint(0, 6)))) for k in range(50)],
        "benchmark": [(k, rng.choice(["same\nitem", f"only {k}"])) for k in range(9)],
        "conversations": [(k // 4, k % 4, rng.choice(["user", "assistant"]), "x" * (k % 7)) for k in range(60)],
    }


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    for name, data in rows().items():
        spark.createDataFrame(data, SCHEMAS[name]).repartition(3).write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.fixture(scope="module")
def duck(folder):
    c = duckdb.connect()
    for name in SCHEMAS:
        c.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    return c


def plain(v):
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, folder, duck, name):
    compare(QUERIES[name](spark, folder), duck.execute(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(state_cases.CASES))
def test_cases(spark, folder, duck, name):
    compare(state_cases.CASES[name](spark, folder), duck.execute(state_cases.EXPECTED[name]))


def compare(df, done):
    got = [{c: plain(v) for c, v in r.asDict().items()} for r in df.collect()]
    names = [d[0] for d in done.description]
    want = [dict(zip(names, map(plain, r), strict=True)) for r in done.fetchall()]
    key = lambda r: str(sorted(r.items()))
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_entry_point_without_the_corpus_subpackage(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(root / "jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "", "PYTHONPATH": ""}, check=True)
    assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]


def test_workers_find_the_package_from_anywhere(tmp_path):
    import os
    import pathlib
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parent.parent
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
import __spark_entry__
from tessera.operators.extract import extracted
from tessera.plans.ship import ship
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
ship(spark)
print(extracted(spark.createDataFrame([("x = 1",)], "source_code string")).select("facts.parse_error").first()[0])
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
    assert out.stdout.strip().endswith("False")
