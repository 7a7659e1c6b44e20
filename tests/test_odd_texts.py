"""Registered queries beside their SQL on texts that the given tables hold rarely or never."""

import duckdb

import __spark_entry__ as entry

ODD = [None, "", " ", " : ", "a &copy; b", "R&ampD &amp; &amp;amp; &amp;lt;", "token = &quot", "it&#39;s &#x27;&#x2", "&lt;b&gt; &ltb &gt",
       "a   b", "x\x0by\x1cz", " edge ", ": a \t\r\n\f b :", "&nbsp;", "&"]


def equals_sql(spark, tmp_path, name, table, df):
    df.write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]}) ORDER BY 1").fetchall()
    assert sorted(map(tuple, got.collect())) == want


def test_collapse_html_text_resolves_what_its_sql_lists(spark, tmp_path):
    texts = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    equals_sql(spark, tmp_path, "collapse_html_text", "documents", texts)


def test_page_name_resolves_what_its_sql_lists(spark, tmp_path):
    """Headings are cut at some length, so an entity may have lost its end."""
    pages = [(i, f"https://shop.example.org/{i}", text and f"<!-- ad --><script>var t;</script><h1 class='x'>{text}</h1><p>{text}</p>") for i, text in enumerate(ODD)]
    equals_sql(spark, tmp_path, "page_name", "pages", spark.createDataFrame(pages, "page_id long, url string, html string"))
