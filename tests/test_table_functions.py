import re

import pytest
from pyspark.sql import functions as F
from test_release_pages import STATUS, page

from ledgerloom.sources import pages, release_pages, table_functions


@pytest.fixture(scope="module")
def session(spark):
    table_functions.register(spark)
    return spark


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


HTML = """<a href="/changelog/1">One</a><a href='#x'>n</a><a href="https://o.com/r">T<b>w</b>o &amp; x</a><a href="/changelog/1">again</a><a href="mailto:a@b">m</a>
<a href="sub/three?q=1">Three<script>var a = '</b>';</script></a><a href="//cdn.com/f">F</a><a href="https://s.com/list/p/">self</a><A HREF="UPPER">U</A>"""


def test_known_issues(session):
    made = page(session, STATUS).unionByName(page(session, "<table><tr><th>Status</th></tr><tr><td>x</td></tr></table>")).unionByName(page(session, None))
    got = session.sql("SELECT * FROM known_issues(TABLE({p}))", p=made)
    assert got.columns[:2] == ["page_id", "url"]
    assert rows(got.drop("url")) == rows(release_pages.known_issues(made)) and got.count() == 2


@pytest.mark.parametrize("url", ["https://s.com/list/p", "https://s.com/list/p?x=/y", "https://s.com", "no scheme"])
def test_links(session, url):
    made = page(session, HTML, url)
    got = session.sql("SELECT page_id, nth, link, label FROM page_links(TABLE({p}))", p=made)
    assert rows(got) == rows(pages.links(made, F.lit(True))) and got.count() >= 5
    got = session.sql("SELECT page_id, nth, link, label FROM page_links(TABLE({p}), '/changelog/|/release-notes/|/releases/')", p=made)
    assert rows(got) == rows(pages.links(made, pages.changelog_link()))
    assert session.sql("SELECT * FROM page_links(TABLE({p}))", p=page(session, HTML, None)).count() == 0


def test_tables_keep_the_callers_columns(session):
    made = page(session, STATUS)
    got = session.sql("SELECT page_id, table_no, row_no, header, cells FROM page_tables(TABLE({p}))", p=made)
    assert rows(got) == rows(pages.table_rows(made).select("page_id", "table_no", "row_no", "header", "cells"))
    clash = made.select("html", F.lit(7).alias("owner"), F.lit("x").alias("Cells"))
    assert session.sql("SELECT * FROM page_tables(TABLE({p}))", p=clash).columns == ["owner", "table_no", "row_no", "header", "cells"]
    assert session.sql("SELECT * FROM page_tables(TABLE({p}))", p=made.limit(0)).count() == 0
    with pytest.raises(Exception, match="column html"):
        session.sql("SELECT * FROM page_tables(TABLE({p}))", p=made.drop("html"))


def test_pages_of_orders_are_written_after_the_shuffle(spark, sf_dir):
    """The query's shuffle carries numbers, not rows of HTML."""
    from ledgerloom import registry

    plan = registry.QUERIES["known_issue_function"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    collected = re.search(r"collect_list\((struct\(.*?\)), 0", plan)[1]
    assert "l_suppkey" in collected and "<td>" not in collected
    assert table_functions.plain("a\t<b>b</b>  c\u00a0\n") == "a b c\u00a0"
