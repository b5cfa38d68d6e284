"""Queries against their SQL on odd rows."""

import datetime
import random

import duckdb
import pyarrow.parquet as pq

import __spark_entry__ as entry


def both(spark, folder, name: str, **tables):
    """Rows of a query and of its SQL over tables(lists of rows, schema): a file for each list."""
    con = duckdb.connect()
    for table, (lists, schema) in tables.items():
        (folder / f"{table}.parquet").mkdir()
        for k, rows in enumerate(lists):
            pq.write_table(spark.createDataFrame(rows, schema).toArrow(), folder / f"{table}.parquet" / f"part-{k}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = entry.queries()[name](spark, str(folder))
    return sorted(map(tuple, got.collect()), key=repr), sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall(), key=repr)


def test_session_rank_with_equal_seqs(spark, tmp_path):
    """F8: lines of an order may share their number; the table's first one counts."""
    day = datetime.datetime(1998, 1, 1)
    rows = [(k // 4, (k * 37) % 101, 1, 1 + k % 2, float(k % 50), "A" if k % 3 else "R", day) for k in range(400)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate timestamp_ntz"
    got, wanted = both(spark, tmp_path, "session_rank", lineitem=([rows[:40], rows[::-1] * 20], schema))
    assert got == wanted


def test_scrub_emails_of_odd_texts(spark, tmp_path):
    """null and empty texts, chains of addresses, what follows an address."""
    draw = random.Random(9)
    texts = [None, "", "a@b.co", "a@b.co@c.de", "a@b.co_x", "a@b.co%", "@a@b.co", "a@b.co.-", "a@.co", "a@b.c", "é@b.co", "xé a@b.coé", "a@b.co\n", "a@b.co\r\n"]
    texts += ["".join(draw.choice("ab@@.-_%+ é1\n") if draw.random() < 0.7 else "a@b.co" for _ in range(draw.randrange(1, 9))) for _ in range(500)]
    got, wanted = both(spark, tmp_path, "scrub_emails", documents=([list(enumerate(texts))], "doc_id long, text string"))
    assert got == wanted


def test_cases_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """one small file of parts becomes cases in as many tasks as a shuffle has."""
    from revloom.functions import cases

    seen = []
    monkeypatch.setattr(cases, "cases", lambda numbers, make=cases.cases: seen.append(numbers.rdd.getNumPartitions()) or make(numbers))
    got, wanted = both(spark, tmp_path, "detection_recall", part=([[(k,) for k in range(40)]], "p_partkey long"))
    assert got == wanted and seen == [4]


def test_detection_recall_draws_once(spark, tmp_path):
    """the rows are as the SQL's, and no plan below the cases holds their draws again."""
    got, wanted = both(spark, tmp_path, "detection_recall", part=([[(k,) for k in range(30)]], "p_partkey long"))
    assert got == wanted and len(got) == 6
    plan = entry.queries()["detection_recall"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan
