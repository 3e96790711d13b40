"""The query over all templates, against its SQL: lines with holes within tokens have rows too."""

import duckdb

import __spark_entry__

DATA = "/root/testdata/sf0.001"


def test_no_template_is_left_out(spark):
    name = "all_matches"
    got = __spark_entry__.queries()[name](spark, DATA).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).fetchall()
    rounded = lambda rows: sorted((n, t, x, round(c, 9), k) for n, t, x, c, k in rows)
    assert rounded(map(tuple, got)) == rounded(want)
    requests = [r for r in got if r.template_id == "t6"]
    # Without a header (every fifth ten), "Request: " is read as the level, so no such message is left.
    events = con.execute("SELECT count(*) FROM events WHERE event_id % 10 = 5 AND CAST(floor(event_id / 10) AS BIGINT) % 5 <> 4").fetchone()[0]
    assert events and len(requests) == events and all(r.extracted.startswith("GET | /x/") for r in requests)
