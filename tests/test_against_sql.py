"""Queries against their SQL on rows that the small tables do not hold."""
import duckdb
import pytest

from bindings import ORACLES, QUERIES

from test_oracles import shown


def both(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, select in tables.items():
        con.execute(f"copy ({select}) to '{folder}/{table}.parquet'")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    df = QUERIES[name](spark, str(folder))
    cols = sorted(df.columns)
    got = sorted(tuple(map(shown, r)) for r in df.select(*cols).collect())
    result = con.execute(ORACLES[name])
    at = [[d[0] for d in result.description].index(c) for c in cols]
    return got, sorted(tuple(shown(r[i]) for i in at) for r in result.fetchall())


def test_code_of_bounded(spark, tmp_path):
    got, want = both(spark, tmp_path, "code_of", part="""select unnest([1, 98999, 99000, 998999, 999000, 1199999]::bigint[]) as p_partkey, 'hot bolt' as p_name,
      'Brand#12' as p_brand, 7 as p_size""")
    assert got == want
    assert [r[1] for r in sorted(got, key=lambda r: int(r[3]))] == ["CO1001", "CO99999", "CO100000", "CO999999", "null", "null"]


PAGE = """select 1::bigint as page_id, 'https://a.example.com/x' as url,
 '<html><head><title>t</title></head><body><nav><ul><li><a href="/Ab">L</a></li></ul></nav><div class="ad">buy</div><article><h1>Tea &amp; &quot;Rum&quot; ' || {cut} || '</h1><p>x &copy; 1 &amp;lt; 2</p></article></body></html>' as html"""


@pytest.mark.parametrize("cut, left", [("'R&amp'", "R&"), ("'R&am'", "R&am"), ("'R&quot'", 'R"'), ("'R&amp;'", "R&")])
def test_cut_character_reference(spark, tmp_path, cut, left):
    got, want = both(spark, tmp_path, "page_outline", pages=PAGE.format(cut=cut))
    assert got == want and f'Tea & "Rum" {left}' in [r[5] for r in got]
    (tmp_path / "text").mkdir()
    got, want = both(spark, tmp_path / "text", "page_text", pages=PAGE.format(cut=cut))
    assert got == want and f'Tea & "Rum" {left}' in got[0][1].split("\n")


def test_resolve_roots_by_folder_of_another(spark, tmp_path):
    # the folder of customer 5 holds the address of course 59; customers 6 and 12 share a name and so a folder
    got, want = both(spark, tmp_path, "resolve_roots", customer="""select k::bigint as c_custkey, 3 as c_nationkey,
      'Customer#' || case when k = 12 then 6 when k = 16 then 10 when k = 15 then 9 else k end as c_name from (select unnest(range(1, 66)) as k)""")
    assert got == want and len(got) == 65
    assert ("59", "Customer#5", "metadata") in got and ("53", "null", "missing") in got
    assert {r[2] for r in got if r[0] in ("6", "12")} == {"exact"} and {r[2] for r in got if r[0] in ("9", "15")} == {"ambiguous"}
