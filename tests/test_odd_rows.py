"""Odd rows (repeated, without a key, cut within a reference): queries give what their SQL gives."""

import duckdb
from test_queries import rows

from convena.operators import collect
from convena.plans import record_queries  # noqa: F401 (its queries are registered)
from convena.plans.queries import ORACLE, QUERIES


def same(spark, path, name, **tables):
    """``name`` over ``tables`` (SQL of their rows) as by its SQL; the rows."""
    con = duckdb.connect()
    for table, values in tables.items():
        con.sql(f"COPY ({values}) TO '{path}/{table}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    df, want = QUERIES[name](spark, str(path)), con.sql(ORACLE[name])
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows(want.columns, want.fetchall())
    return got


def test_source_status(spark, tmp_path):
    customer = "SELECT * FROM (VALUES (1::BIGINT, 5.0::DOUBLE), (1, 5.0), (1, -1.0), (2, -1.0), (2, -1.0), (NULL, 1.0), (NULL, 1.0), (3, NULL), (4, 'nan'), (5, -1.0), (6, -1.0)) v(c_custkey, c_acctbal)"
    orders = "SELECT * FROM (VALUES (1::BIGINT, 'F'), (1, 'P'), (3, 'P'), (NULL, 'P'), (4, NULL), (5, NULL), (6, 'O'), (6, NULL)) v(o_custkey, o_orderstatus)"
    assert len(same(spark, tmp_path, "source_status", customer=customer, orders=orders)) == 8


def test_page_text(spark, tmp_path):
    html = ["<h1>A &amp; B &amp</h1><p>x &amp;lt; &nbsp; &quo &copy; &#39;&gt;&am</p>", "<h1>&amp;&amp;amp;&</h1>", ""]
    pages = f"SELECT * FROM (VALUES {', '.join(f'({i}::BIGINT, {chr(39)}{h.replace(chr(39), chr(39) * 2)}{chr(39)})' for i, h in enumerate(html))}, (9, NULL)) v(page_id, html)"
    assert len(same(spark, tmp_path, "page_text", pages=pages)) == 3


def test_feed_candidates(spark, tmp_path):
    orders = "SELECT * FROM (VALUES (1::BIGINT), (2), (2), (2)) v(o_orderkey)"
    assert len(same(spark, tmp_path, "feed_candidates", orders=orders)) == 4
    # Items with plain elements only, and others, read the same.
    items = ['<title>セミナー 1</title><link>/a</link>', '<title a="b"> セミナー\n1</title ><link>/a</link>', '<title><![CDATA[セミナー 1]]></title><link>/a</link>', '<x><title>no</title></x><title>セミナー &#49;</title><link>/a</link>', '<title>セ<b>ミナー</b> 1</title><link>/a</link>', '<x a="1>2">y</x><title>セミナー 1</title><link>/a</link><e/>']
    docs = spark.createDataFrame([(i, "https://x.example/", f"<rss><item>{x}</item></rss>") for i, x in enumerate(items)], "key long, url string, body string")
    got = collect.feed_candidates(docs).select("key", "title_hint", "detail_url").collect()
    assert sorted(map(tuple, got)) == [(i, "セミナー 1", "https://x.example/a") for i in range(len(items))]
