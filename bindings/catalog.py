"""Catalog matching and past exams."""
from __future__ import annotations

from pyspark.sql import functions as F

from studycorpus.operators import catalog, classify, exams
from studycorpus.plans import scale
from studycorpus.sources import pages

from .base import query, table


# --- fill-down ------------------------------------------------------------------------

@query("fill_down", """with l as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as row_no, l_linenumber,
   case when l_linenumber % 3 <> 1 then '' else l_returnflag end as flag from lineitem)
select l_orderkey, l_linenumber, row_no, coalesce(last_value(nullif(flag, '') ignore nulls) over (partition by l_orderkey order by row_no rows between unbounded preceding and current row), '') as flag from l""")
def fill_down(spark, sf):
    lines = table(spark, sf, "lineitem")
    numbered = scale.numbered(lines, ["l_orderkey"], [F.col(c) for c in (
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")], "row_no")
    rows = numbered.select("l_orderkey", "l_linenumber", "row_no",
                           F.when(F.col("l_linenumber") % 3 != 1, "").otherwise(F.col("l_returnflag")).alias("flag"))
    return catalog.fill_down(rows, ["l_orderkey"], "row_no", ["flag"])


# --- catalog rows from part: the code repeats, names carry a class suffix ---------------

CODE = "case when p_partkey % 11 = 0 then '' else concat('CO', cast(1000 + p_partkey % 300 as string)) end"
NAME = "case when p_partkey % 13 = 0 then '' when p_partkey % 17 = 0 then concat(p_name, ' ', cast(p_partkey as string)) when p_partkey % 2 = 0 then concat(p_name, ' - Lop L0', cast(p_partkey % 4 as string)) else p_name end"
LINK = "concat('https://drive.google.com/drive/u/', cast(p_partkey % 3 as string), '/folders/f', cast(p_partkey % 90 as string), '?x=', cast(p_partkey as string))"


def rows_of(spark, sf, code: str = CODE):
    return table(spark, sf, "part").selectExpr("p_type as tab", "p_partkey as row_no", f"{code} as course_code", f"{NAME} as course_name", "p_brand as lecturer",
                           "p_type as category", f"array(named_struct('url', {LINK}, 'label', p_name)) as material_links")


ROWS_SQL = f"""r0 as (select p_partkey, p_type as tab, p_partkey as row_no, {CODE} as code, {NAME} as course_name, p_brand as lecturer, p_type as category,
  {LINK} as url, p_name as label from part), r1 as (select *, trim(regexp_replace(lower(course_name), ' - lop .*$', '')) as name_key from r0),
rows_ as (select * from r1 where code <> '' or name_key <> '')"""


@query("aggregate_candidates", f"""with {ROWS_SQL} select code, name_key, coalesce(arg_min(course_name, (tab, row_no)) filter (course_name <> ''), '') as course_name,
 count(*) as n_rows, count(distinct lecturer) as n_lecturers, count(distinct category) as n_categories from rows_ group by 1, 2""")
def aggregate_candidates(spark, sf):
    return catalog.aggregate_candidates(rows_of(spark, sf))


@query("candidate_values", f"""with {ROWS_SQL} select distinct code, name_key, 'lecturer' as kind, lecturer as value from rows_
 union all select distinct code, name_key, 'category', category from rows_""")
def candidate_values(spark, sf):
    return catalog.candidate_values(rows_of(spark, sf))


@query("candidate_links", f"""with {ROWS_SQL}, k as (select *, concat('drive-folder:f', p_partkey % 90) as material,
  row_number() over (partition by code, name_key, p_partkey % 90 order by tab, row_no) as rn from rows_)
select code, name_key, tab, row_no, url, label, material from k where rn = 1""")
def candidate_links(spark, sf):
    return catalog.candidate_links(rows_of(spark, sf))


# the catalog knows every second code only, so that names have to decide too
LISTED = "case when p_partkey % 11 = 0 then '' else concat('CO', cast(1000 + p_partkey % 300 * 2 as string)) end"


MATCH_SQL = f"""with {ROWS_SQL}, cat as (select distinct {LISTED} as code, r1.name_key from part join r1 using (p_partkey) where {LISTED} <> '' or r1.name_key <> ''),
 bc as (select code, count(*) as n from cat where code <> '' group by 1), bn as (select name_key, count(*) as n from cat where name_key <> '' group by 1)
select r.p_partkey as course_id, r.code as course_code, r.course_name,
  case when bc.n is not null then 'matched' when r.name_key = '' then 'no_match' when bn.n = 1 then 'matched' when bn.n > 1 then 'ambiguous' else 'no_match' end as status,
  case when bc.n is not null then 'high' when bn.n = 1 then 'medium' else 'low' end as confidence,
  case when bc.n is not null then 'exact course code' when r.name_key = '' then 'no reliable code or name' when bn.n = 1 then 'exact course name' when bn.n > 1 then 'several courses of this name'
    when r.code <> '' then 'code not in the catalog' else 'name not in the catalog' end as reason,
  case when bc.n is not null then 'code' when bn.n is not null then 'name' end as match_on,
  case when bc.n is not null then r.code when bn.n is not null then r.name_key end as match_value, coalesce(bc.n, bn.n, 0) as n_candidates
from r1 r left join bc on bc.code = r.code left join bn on bn.name_key = r.name_key"""


@query("match_catalog", MATCH_SQL)
def match_catalog(spark, sf):
    courses = table(spark, sf, "part", "p_partkey as course_id", f"{CODE} as course_code", f"{NAME} as course_name")
    return catalog.match_catalog(courses, catalog.aggregate_candidates(rows_of(spark, sf, LISTED)))


@query("matched_candidates", f"""with m as ({MATCH_SQL}), {ROWS_SQL.removeprefix('with ')}, cat as (select distinct {LISTED} as code, r1.name_key from part join r1 using (p_partkey) where {LISTED} <> '' or r1.name_key <> '')
select m.course_id, m.status, m.match_on, m.match_value, cat.code, cat.name_key from m join cat on (m.match_on = 'code' and cat.code = m.match_value) or (m.match_on = 'name' and cat.name_key = m.match_value)""")
def matched_candidates(spark, sf):
    candidates = scale.checkpointed(catalog.aggregate_candidates(rows_of(spark, sf, LISTED)))
    courses = table(spark, sf, "part", "p_partkey as course_id", f"{CODE} as course_code", f"{NAME} as course_name")
    out = catalog.matched_candidates(catalog.match_catalog(courses, candidates), candidates)
    return out.select("course_id", "status", "match_on", "match_value", "code", "name_key")


LABEL = "concat('L0', cast(p_size as string), '_', p_name, ' (co', cast(1000 + p_partkey as string), ') ', p_brand)"


@query("code_of", f"""select p_partkey, {LABEL} as name, upper(nullif(regexp_extract({LABEL}, '(?i)(?:^|[^A-Z0-9])([A-Z]{{2,4}}[0-9]{{3,6}})(?:[^A-Z0-9]|$)', 1), '')) as course_code,
 regexp_extract(upper(regexp_replace({LABEL}, '[^A-Za-z0-9]', '', 'g')), '[A-Z]{{1,5}}\\d{{3,5}}') as catalog_code from part""")
def code_of(spark, sf):
    return classify.code_of(table(spark, sf, "part", "p_partkey", f"{LABEL} as name"), "name")


# --- catalog tables: nations are courses, their suppliers the rows of a merged cell -------

CELL = """concat('<tr>', case when rn = 1 then concat('<td rowspan="', n, '">MA', cast(100 + s_nationkey as string), '</td><td rowspan="', n, '">', n_name, '</td>') else '' end,
 '<td>', s_name, '</td><td><a href="https://drive.google.com/drive/folders/s', cast(s_suppkey as string), '">', 'Doc ', cast(s_suppkey as string), '</a></td><td><a href="/v', cast(s_suppkey as string), '#t">Video</a></td></tr>')"""


@query("catalog_from_tables", """select s_suppkey // 200 * 100 + 1 + s_nationkey as tab, concat('MA', 100 + s_nationkey) as course_code, n_name as course_name, s_name as lecturer,
  concat('https://drive.google.com/drive/folders/s', s_suppkey, ' ', 'https://cat.example.edu/v', s_suppkey) as links from supplier join nation on s_nationkey = n_nationkey""")
def catalog_from_tables(spark, sf):
    """One page per nation and 200 suppliers with one table; code and name cells
    span its suppliers."""
    from pyspark.sql import Window as W
    page = ["s_nationkey", "block"]
    rows = (table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .withColumn("block", F.floor(F.col("s_suppkey") / 200))
            .withColumn("rn", F.row_number().over(W.partitionBy(*page).orderBy("s_suppkey")))
            .withColumn("n", F.count("*").over(W.partitionBy(*page))))
    body = rows.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("rn", F.expr(CELL).alias("r")))).alias("t"))
    html = F.concat(F.lit("<table><tr><td colspan='5'>Catalog</td></tr><tr><th>Mã môn</th><th>Tên môn học</th><th>Giảng viên</th><th>Tài liệu</th><th>Video</th></tr>"),
                    F.array_join(F.transform("t", lambda x: x["r"]), ""), F.lit("</table>"))
    out = pages.catalog_from_tables(body.select((F.col("block") * 100 + F.col("s_nationkey") + 1).alias("page_id"), F.lit("https://cat.example.edu/list").alias("url"), html.alias("html")))
    return out.select("tab", "course_code", "course_name", "lecturer",
                      F.array_join(F.transform("material_links", lambda l: l["url"]), " ").alias("links"))


# --- exams: part as a folder tree type -> brand -> part --------------------------------------

WORD = """case when p_size % 10 = 0 then 'Đề thi giữa kỳ HK221' when p_size % 10 = 1 then 'Final exam 2019 - 2020' when p_size % 10 = 2 then 'midterm'
 when p_size % 10 = 3 then 'final' when p_size % 10 = 4 then 'CK 2021' when p_size % 10 = 5 then 'final HK201' when p_size % 10 = 6 then 'giua ki' when p_size % 10 = 7 then 'Checklist'
 when p_size % 10 = 8 then 'Packet GK' else 'notes' end"""
TYPE_OF = {  # (outside context, inside context)
    0: ("midterm", "midterm"), 1: ("final", "final"), 2: ("midterm", "midterm"), 3: (None, "final"), 4: ("final", "final"), 5: ("final", "final"),
    6: (None, "midterm"), 7: (None, "unknown_exam"), 8: ("midterm", "midterm"), 9: (None, "unknown_exam")}
TERMS = {0: ("HK221", "HK221"), 1: ("2019-2020", "2019-2020"), 4: ("2021", "2021"), 5: ("HK201", "HK201")}


def _case(values, ctx: int, key: str = "p_size % 10") -> str:
    quote = lambda v: "null" if v is None else f"'{v}'"
    return f"case {key} " + " ".join(f"when {k} then {quote(v[ctx])}" for k, v in values.items()) + " else {d} end"


TYPE_SQL = f"case when ctx then {_case(TYPE_OF, 1).format(d='null')} else {_case(TYPE_OF, 0).format(d='null')} end"
TERM_SQL = _case(TERMS, 0).format(d="''")


@query("classify_exams", f"""with p as (select p_partkey, p_size, p_partkey % 2 = 0 as ctx, concat({WORD}, '.pdf') as name from part)
select p_partkey, name, ctx, {TYPE_SQL} as exam_type, {TERM_SQL} as term from p""")
def classify_exams(spark, sf):
    return exams.classify_exams(table(spark, sf, "part", "p_partkey", f"concat({WORD}, '.pdf') as name", "p_partkey % 2 = 0 as ctx"), "name", "ctx")


# brand folders: an exam folder, an official one, a plain parent, or something else
BRAND = """case cast(substring(p_brand, 7) as int) % 5 when 0 then concat('Exams ', p_brand) when 1 then concat('Đề thi chính thức ', p_brand) when 2 then concat('Archive ', p_brand)
 when 3 then concat('Demo midterm ', p_brand) else concat('Slides ', p_brand) end"""
FILE = f"concat({WORD}, ' ', cast(p_partkey as string), case when p_partkey % 5 = 0 then '.zip' else '.pdf' end)"


@query("exam_context", f"""with p as (select p_partkey, p_size, p_type, p_brand, cast(substring(p_brand, 7) as int) % 5 as b, {FILE} as name, {BRAND} as folder,
    concat(p_type, '/', p_brand) as fid from part),
 f as (select *, b in (0, 1, 3) as ctx from p where b <> 4),
 k as (select *, case when b = 3 then 'midterm' when ctx then coalesce({TYPE_SQL}, 'unknown_exam') else {TYPE_SQL} end as exam_type from f)
select distinct p_type as root_id, p_type as node_id, 0 as depth, p_type as name, 'enumerated' as state, null as exam_type, '' as term, 'unknown' as exam_variant from p
union all select distinct p_type, fid, 1, folder, case when b = 4 then 'skipped_non_exam_folder' else 'enumerated' end, null, '',
  case when b = 1 then 'official' when b = 3 then 'sample' else 'unknown' end from p
union all select p_type, concat('p', p_partkey), 2, name, case when p_partkey % 5 = 0 then 'unsupported_item' else 'exam' end, exam_type,
  case when {TERM_SQL} <> '' then {TERM_SQL} when p_partkey between 100 and 999 and (ctx or p_partkey between 200 and 209) then cast(p_partkey as varchar)
    when p_partkey between 2000 and 2099 then cast(p_partkey as varchar) else '' end,
  case when b = 1 then 'official' when b = 3 then 'sample' else 'unknown' end from k where exam_type is not null""")
def exam_context(spark, sf):
    return exams.exam_context(part_tree(spark, sf)).drop("path_label")


@query("exam_candidates", f"""with p as (select p_partkey, p_size, p_type, cast(substring(p_brand, 7) as int) % 5 as b, {FILE} as name from part where p_partkey % 5 <> 0),
 f as (select *, b in (0, 1, 3) as ctx from p where b <> 4),
 k as (select *, case when b = 3 then 'midterm' when ctx then coalesce({TYPE_SQL}, 'unknown_exam') else {TYPE_SQL} end as exam_type from f)
select p_type as root_id, concat('p', p_partkey) as node_id, name as original_name, exam_type from k where exam_type is not null""")
def exam_candidates(spark, sf):
    walk = exams.exam_context(part_tree(spark, sf))
    return exams.exam_candidates(walk).select("root_id", "node_id", "original_name", "exam_type")


@query("exam_budget", f"""with p as (select distinct p_type, p_brand, cast(substring(p_brand, 7) as int) % 5 as b, {BRAND} as folder, concat(p_type, '/', p_brand) as fid from part),
 q as (select *, row_number() over (partition by p_type order by case b when 3 then 0 when 2 then 3 else 1 end, fid) as turn from p where b <> 4),
 f as (select p_type, p_brand, p_partkey, p_size, {FILE} as name, cast(substring(p_brand, 7) as int) % 5 in (0, 1, 3) as ctx, cast(substring(p_brand, 7) as int) % 5 as b from part),
 k as (select f.*, case when f.b = 3 then 'midterm' when ctx then coalesce({TYPE_SQL}, 'unknown_exam') else {TYPE_SQL} end as exam_type
   from f join q on f.p_type = q.p_type and f.p_brand = q.p_brand where q.turn <= 5)
select distinct p_type as root_id, p_type as node_id, 0 as depth, 'enumerated' as state from p
union all select p_type, fid, 1, case when turn <= 5 then 'enumerated' else 'node_limit' end from q
union all select p_type, fid, 1, 'skipped_non_exam_folder' from p where b = 4
union all select p_type, concat('p', p_partkey), 2, case when p_partkey % 5 = 0 then 'unsupported_item' else 'exam' end from k where exam_type is not null""")
def exam_budget(spark, sf):
    """Six folders of each root are opened, the root among them."""
    return exams.exam_context(part_tree(spark, sf), max_nodes=6).select("root_id", "node_id", "depth", "state")


def part_tree(spark, sf):
    part = table(spark, sf, "part")
    fid = F.concat("p_type", F.lit("/"), "p_brand")
    roots = part.select(F.col("p_type").alias("root_id"), F.col("p_type").alias("node_id"), F.lit(None).cast("string").alias("parent_id"),
                        F.col("p_type").alias("name"), F.lit(True).alias("is_folder")).distinct()
    folders = part.select(F.col("p_type").alias("root_id"), fid.alias("node_id"), F.col("p_type").alias("parent_id"),
                          F.expr(BRAND).alias("name"), F.lit(True).alias("is_folder")).distinct()
    files = part.select(F.col("p_type").alias("root_id"), F.concat(F.lit("p"), "p_partkey").alias("node_id"), fid.alias("parent_id"),
                        F.expr(FILE).alias("name"), F.lit(False).alias("is_folder"))
    return roots.unionByName(folders).unionByName(files)


ASSETS = ("cast(floor(item_id / 10) as int) as course_id", "cast(item_id as string) as stable_id", "case item_id % 3 when 0 then 'midterm' when 1 then 'final' else 'unknown_exam' end as exam_type",
          "concat('HK', cast(211 + item_id % 9 as string)) as term", "case item_id % 4 when 0 then 'official' when 1 then 'sample' else 'unknown' end as exam_variant",
          "case item_id % 5 when 0 then 'text_extracted' else 'visual_unparsed' end as extraction_status", "length(text) as size")


@query("select_exams", f"""with a as (select item_id, {', '.join(ASSETS)} from benchmark),
 r as (select *, row_number() over (partition by course_id, exam_type order by case exam_variant when 'official' then 0 when 'sample' then 1 else 2 end,
   cast(substring(term, 3) as int) desc, extraction_status <> 'text_extracted', size, stable_id) as rk from a where exam_type <> 'unknown_exam'),
 b as (select * from r where rk <= 2), o as (select *, row_number() over (partition by course_id order by exam_type = 'final', rk) as turn from b),
 p as (select course_id, max(case when turn = 1 then size end) as s1, max(case when turn = 2 then size end) as s2, max(case when turn = 3 then size end) as s3, max(case when turn = 4 then size end) as s4 from o group by 1),
 k1 as (select *, case when s1 <= 500 then s1 else 0 end as u1 from p), k2 as (select *, case when u1 + s2 <= 500 then u1 + s2 else u1 end as u2 from k1),
 k3 as (select *, case when u2 + s3 <= 500 then u2 + s3 else u2 end as u3 from k2), k4 as (select *, case when u3 + s4 <= 500 then u3 + s4 else u3 end as u4 from k3),
 d as (select o.course_id, stable_id, case turn when 1 then u1 > 0 when 2 then u2 > u1 when 3 then u3 > u2 else u4 > u3 end as fits from o join k4 using (course_id))
select a.course_id, a.stable_id, a.exam_type, case when fits then 'kept' when not fits then 'over_budget' else 'over_limit' end as decision from a left join d on a.course_id = d.course_id and a.stable_id = d.stable_id""")
def select_exams(spark, sf):
    return exams.select_exams(table(spark, sf, "benchmark", *ASSETS), budget=500).select("course_id", "stable_id", "exam_type", "decision")


@query("reconcile_exams", """with b as (select cast(floor(item_id / 5) as int) as course_id, item_id, item_id % 2 = 0 as fresh from benchmark)
select course_id, item_id, case when fresh then 'new' else 'prior' end as origin from b where (fresh and course_id % 3 = 0) or (not fresh and course_id % 3 <> 0)""")
def reconcile_exams(spark, sf):
    items = table(spark, sf, "benchmark", "cast(floor(item_id / 5) as int) as course_id", "item_id", "item_id % 2 = 0 as fresh")
    flags = items.select("course_id").distinct().select("course_id", (F.col("course_id") % 3 != 1).alias("complete"),
                                                        F.when(F.col("course_id") % 3 == 2, 1).otherwise(0).alias("failed_downloads"))
    side = lambda fresh, name: items.filter(F.col("fresh") == fresh).select("course_id", "item_id", F.lit(name).alias("origin"))
    return exams.reconcile_exams(side(False, "prior"), side(True, "new"), flags)


STATE = """case when event_type = 'error' and user_id % 3 = 0 then 'permission_denied' when event_type = 'view' and user_id % 7 = 0 then 'node_limit'
 when event_type = 'click' then 'public_enumerated' else 'public_empty' end"""


@query("discovery_report", f"""with s as (select user_id as root_id, {STATE} as state, event_type = 'purchase' and user_id % 2 = 0 as cand from events),
 g as (select root_id, count(*) as events, count(*) filter (cand) as candidates, bool_or(state = 'node_limit') as nl, bool_or(state = 'permission_denied') as pd,
   bool_or(state = 'public_empty') as pe, bool_or(state = 'public_enumerated') as pu from s group by 1)
select root_id, events, candidates, not (nl or pd) as complete, case when nl then 'node_limit' when pd then 'permission_denied' when candidates > 0 then 'completed'
  when pe then 'public_empty' when pu then 'public_enumerated' else 'no_exam_candidates' end as stage from g""")
def discovery_report(spark, sf):
    events = table(spark, sf, "events", "user_id as root_id", f"{STATE} as state", "event_type")
    return exams.discovery_report(events, events.filter("event_type = 'purchase' and root_id % 2 = 0"))


@query("discovery_states", f"select user_id as root_id, {STATE} as state, count(*) as n from events group by all")
def discovery_states(spark, sf):
    return exams.state_counts(table(spark, sf, "events", "user_id as root_id", f"{STATE} as state"))


@query("catalog_report", f"with {ROWS_SQL} select tab, count(*) as parsed_rows, count(distinct nullif(code, '')) as n_codes from r1 group by 1")
def catalog_report(spark, sf):
    return catalog.catalog_report(rows_of(spark, sf))


@query("catalog_codes", f"with {ROWS_SQL} select distinct tab, code from r1 where code <> ''")
def catalog_codes(spark, sf):
    return catalog.catalog_codes(rows_of(spark, sf))
