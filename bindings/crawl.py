"""Crawled pages, sync results, saved courses, names and progress."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from studycorpus.functions import urls as U
from studycorpus.operators import courses, crawl, names
from studycorpus.plans import scale
from studycorpus.sources import manifests, pages
from studycorpus.streaming import progress, throttle

from .base import HOSTS, query, table

SITE = "https://lms.example.edu"


# --- pages ---------------------------------------------------------------------------

# character references end with a semicolon or, as HTML allows for these, without one
UNESCAPED = "{t}"
for _name, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
    UNESCAPED = f"regexp_replace({UNESCAPED}, '&{_name};?', '{_char}', 'g')"


@query("page_text", f"""with a as (select page_id, regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*)', 1),
   '(?s)<(script|style|nav|footer)[^>]*>.*?</(script|style|nav|footer)>|<!--.*?-->', ' ', 'g'), '<[^>]+>', chr(1), 'g') as t from pages),
 b as (select page_id, {UNESCAPED.format(t='t')} as t from a),
 c as (select page_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(x, concat(' ', chr(10)))), lambda x: x <> '') as p from b)
select page_id, regexp_replace(regexp_replace(array_to_string(p, chr(10)), ' {{2,}}', ' ', 'g'), ' *\\n *', chr(10), 'g') as text from c""")
def page_text(spark, sf):
    return pages.page_text(table(spark, sf, "pages", "page_id", "html"))


def linked(spark, sf):
    """The navigation list becomes content; its links become modules and files."""
    html = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        "html", "</?nav>", ""), 'href="/([A-M][^"]*)"', 'href="/mod/page/$1"'), 'href="/([n-z][^"]*)"', 'href="/pluginfile.php/$1.pdf"')
    return table(spark, sf, "pages").select("page_id", "url", html.alias("html"))


LINKS_SQL = """raw as (select page_id, url as base, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) as h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) as l from pages),
 u as (select page_id, base, unnest(range(len(h))) as pos, h, l from raw),
 v as (select page_id, regexp_extract(base, '^(https?://[^/?#]*)', 1) as root, pos, h[pos + 1] as href, l[pos + 1] as label from u),
 w as (select *, case when regexp_matches(href, '^/[A-M]') then concat('/mod/page', href) when regexp_matches(href, '^/[n-z]') then concat('/pluginfile.php', href, '.pdf') else href end as p from v),
 d as (select *, row_number() over (partition by page_id, p order by pos) as rn from w)"""


@query("page_links", f"""with {LINKS_SQL} select page_id, pos, label, concat(root, p) as url,
 case when p like '/pluginfile%' then 'file' when p like '/mod/page/%' then 'deep' else 'other' end as kind from d where rn = 1""")
def page_links(spark, sf):
    return pages.page_links(linked(spark, sf), HOSTS)


@query("follow_links", f"""with {LINKS_SQL} select page_id, pos, label, concat(root, p) as url, case when p like '/pluginfile%' then 'file' else 'deep' end as kind
 from d where rn = 1 and (p like '/pluginfile%' or p like '/mod/page/%')""")
def follow_links(spark, sf):
    return pages.page_links(linked(spark, sf), HOSTS, follow=True)


@query("page_outline", f"""with {LINKS_SQL}, o as (select page_id, label, concat(root, p) as url, case when p like '/pluginfile%' then 'pluginfile' else 'page' end as mod_type,
   row_number() over (partition by page_id order by pos) as activity_order from d where rn = 1 and (p like '/pluginfile%' or p like '/mod/page/%'))
select p.page_id, 0 as section_idx, 'Menu' as section_title, o.activity_order, o.label as activity_name, o.url, o.mod_type from pages p left join o using (page_id)
union all select page_id, 1, trim(regexp_replace({UNESCAPED.format(t="regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}, ' {{2,}}', ' ', 'g')), null, null, null, null from pages""")
def page_outline(spark, sf):
    """The list and the article become the two sections of a course page."""
    html = F.replace(F.replace(F.regexp_replace(F.regexp_replace(
        "html", "<body><nav>|<body>", '<body><div class="course-section" id="s1"><h3>Menu</h3>'), "</nav>|</ul>(?=<!--)", ""),
        F.lit("<div class=\"ad\">"), F.lit('</div><div class="ad">')), F.lit("<article><h1>"), F.lit('<div class="course-section" id="s2"><h2>'))
    html = F.replace(html, F.lit("</h1>"), F.lit("</h2>"))
    html = F.regexp_replace(F.regexp_replace(html, 'href="/([A-M][^"]*)"', 'href="/mod/page/$1"'), 'href="/([n-z][^"]*)"', 'href="/pluginfile.php/$1.pdf"')
    return pages.page_outline(table(spark, sf, "pages").select("page_id", "url", html.alias("html")), HOSTS)


URL = """case page_id % 6 when 0 then concat('https://lms.example.edu/course/view.php?x=1&id=', cast(page_id as string), '&id=9#t')
 when 1 then concat('https://lms.example.edu.evil.com/course/view.php?id=', cast(page_id as string)) when 2 then concat('https://user@lms.example.edu/course/view.php?id=', cast(page_id as string))
 when 3 then concat('HTTP://LMS.EXAMPLE.EDU/a/course/view.php?id=', cast(page_id as string)) when 4 then 'https://lms.example.edu/course/view.php' else url end"""


@query("course_urls", f"""select page_id, {URL} as url, page_id % 6 in (0, 3) as is_course, case page_id % 6 when 0 then concat('https://lms.example.edu/course/view.php?id=', page_id)
  when 3 then concat('http://lms.example.edu/a/course/view.php?id=', page_id) end as canonical from pages""")
def course_urls(spark, sf):
    rows = table(spark, sf, "pages", "page_id", f"{URL} as url").withColumn("is_course", U.is_course("url", HOSTS))
    return rows.withColumn("canonical", F.when(F.col("is_course"), U.canonical_course("url")))


@query("host_filter", """select page_id, url from pages where regexp_matches(url, '^https?://([a-z0-9-]+\\.)*example\\.com([/?#]|$)')""")
def host_filter(spark, sf):
    return table(spark, sf, "pages", "page_id", "url").filter(U.host_allowed("url", ["example.com"], subdomains=True))


# --- reach ---------------------------------------------------------------------------------

@query("reachable", """with s as (select s_suppkey, n_regionkey as r, n_nationkey as n from supplier join nation on s_nationkey = n_nationkey)
select concat('r', r_regionkey) as scope, concat('r', r_regionkey) as node, 0 as depth, 'reached' as state from region
union all select concat('r', n_regionkey), concat('n', n_nationkey), 1, 'reached' from nation
union all select concat('r', r), concat('s', s_suppkey), 2, 'reached' from s
union all select concat('r', n_regionkey), concat('c', c_custkey), 2, 'reached' from customer join nation on c_nationkey = n_nationkey
union all select distinct concat('r', r), concat('p', l_partkey), 3, 'max_depth' from s join lineitem on l_suppkey = s_suppkey""")
def reachable(spark, sf):
    """region -> nation -> supplier and customer -> part, from every region, two steps deep."""
    nation = table(spark, sf, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    edges = (nation
             .unionByName(table(spark, sf, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst")))
             .unionByName(table(spark, sf, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst")))
             .unionByName(table(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()))
    seeds = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node")).withColumn("scope", F.col("node"))
    return crawl.reachable(edges, seeds, max_depth=2)      # the links hold in every region


# --- sync -------------------------------------------------------------------------------------

REMOTE = ("o_custkey % 100 as course_id", "concat('f', cast(o_orderkey as string), case when o_orderkey % 13 = 0 then '.mp4' else '.pdf' end) as path",
          "concat('https://lms.example.edu/pluginfile.php/f', cast(o_orderkey as string), case when o_orderkey % 13 = 0 then '.MP4?x=1' else '.pdf' end) as url",
          "case when o_orderkey % 7 = 0 then null else 4 end as size", "o_orderkey", "o_custkey")


@query("sync_diff", f"""with r as (select {', '.join(REMOTE)} from orders), l as (select l_orderkey, count(*) as n from lineitem group by 1)
select course_id, path, case when o_orderkey % 13 = 0 then 'skipped_video' when n is not null and (size is null or size = n) then 'skipped' else 'download' end as action
from r left join l on l_orderkey = o_orderkey""")
def sync_diff(spark, sf):
    remote = table(spark, sf, "orders", *REMOTE)
    have = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("size"))
    local = have.join(remote.select("course_id", "path", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select("course_id", "path", "size")
    return crawl.sync_diff(remote.drop("o_orderkey", "o_custkey"), local).select("course_id", "path", "action")


SAVED = ("cast(c_custkey as string) as id", "case when c_custkey % 4 = 0 then '' else c_name end as name", "case when c_custkey % 5 = 0 then '' else 'OLD101' end as code",
         "0 as last_sync", "'never' as last_status", "0 as last_downloaded", "0 as last_skipped", "0 as last_errors",
         "case when c_custkey % 2 = 0 then 'p' else '' end as study_pack_path", "'up_to_date' as study_pack_status")


@query("apply_results", """with r as (select o_custkey, max(o_orderkey) as k from orders group by 1), c as (select c_custkey as i, c_custkey % 4 = 0 as nameless, c_name, k from customer left join r on o_custkey = c_custkey)
select cast(i as varchar) as id, case when k is not null and k % 3 = 0 then concat('Course CO', 1000 + k % 1000) when nameless then '' else c_name end as name,
  case when k is not null and k % 3 = 0 then concat('CO', 1000 + k % 1000) when i % 5 <> 0 then 'OLD101' else '' end as code,
  coalesce(k, 0) as last_sync, case when k is null then 'never' when k % 2 = 0 then 'success' else 'partial' end as last_status,
  coalesce(k % 4, 0) as last_downloaded, coalesce(k % 5, 0) as last_skipped, coalesce(k % 2, 0) as last_errors,
  case when i % 2 = 0 then 'p' else '' end as study_pack_path, case when i % 2 = 0 and k % 4 > 0 then 'dirty' else 'up_to_date' end as study_pack_status from c""")
def apply_results(spark, sf):
    results = table(spark, sf, "orders", "cast(o_custkey as string) as course_id", "case when o_orderkey % 2 = 0 then 'success' else 'partial' end as status",
                    "o_orderkey % 4 as downloaded", "o_orderkey % 5 as skipped", "0 as pages_saved", "o_orderkey % 2 as errors",
                    "case when o_orderkey % 3 = 0 then concat('Course CO', cast(1000 + o_orderkey % 1000 as string)) else '' end as name", "o_orderkey as finished_at")
    return courses.apply_results(table(spark, sf, "customer", *SAVED), results)


LOG = ("event_id as seq", "user_id as course_id", """case event_type when 'view' then 'downloaded' when 'click' then 'skipped' when 'signup' then 'page_saved' when 'purchase' then 'skipped_video'
  else case when user_id % 3 = 0 then 'error' else 'skipped' end end as status""",
       "case when event_id % 40 = 0 and user_id % 2 = 0 then 'course' else concat('Week 1 > section:Item ', cast(event_id % 90 as string), ' token=zz') end as context",
       "concat('https://u:p@files.example.com/x', cast(event_id as string), '?token=abc#f') as source",
       "case when event_id % 9 = 0 then '' else concat('HTTP 500 token=abc', cast(event_id as string), ' at https://h.example.com/p?q=1') end as error")


@query("sync_summary", f"""with l as (select {', '.join(LOG)} from events), c as (select course_id, count(*) filter (status = 'downloaded') as downloaded, count(*) filter (status = 'skipped') as skipped,
   count(*) filter (status = 'skipped_video') as skipped_video, count(*) filter (status = 'page_saved') as pages_saved, count(*) filter (status = 'error') as errors,
   bool_or(status = 'error' and context = 'course') as fatal from l group by 1),
 s as (select *, case when fatal then 'error' when errors > 0 then 'partial' when downloaded > 0 then 'success' else 'up_to_date' end as status from c)
select course_id, cast(sum(downloaded) as bigint) as downloaded, cast(sum(skipped) as bigint) as skipped, cast(sum(skipped_video) as bigint) as skipped_video, cast(sum(pages_saved) as bigint) as pages_saved,
  cast(sum(errors) as bigint) as errors, count(*) filter (status <> 'error') as synced_courses, cast(sum(case when status = 'partial' then errors else 0 end) as bigint) as partial_errors,
  count(*) filter (status = 'error') as fatal_course_failures, case when grouping(course_id) = 0 then max(status) else 'batch' end as status from s group by rollup (course_id)""")
def sync_summary(spark, sf):
    return crawl.sync_summary(table(spark, sf, "events", *LOG))


@query("resource_failures", f"""with l as (select {', '.join(LOG)} from events), r as (select *, row_number() over (partition by course_id order by seq) as failure_no from l where status = 'error' and context <> 'course')
select course_id, failure_no, concat('Item ', seq % 90, ' token=[redacted]') as title, concat('https://files.example.com/x', seq) as source,
  case when error = '' then 'Unknown error' else 'HTTP 500 token=[redacted] at https://h.example.com/p' end as reason from r""")
def resource_failures(spark, sf):
    return crawl.resource_failures(table(spark, sf, "events", *LOG))


OUTCOME = ("user_id % 20 as batch_id", "user_id as course_id", "event_type <> 'error' as has_output", "case when event_type = 'signup' then 'x' end as error",
           "case when event_type = 'view' then 1 else 0 end as n_warnings")


@query("batch_outcome", """select user_id % 20 as batch_id, count(*) filter (event_type not in ('error', 'signup')) as succeeded, count(*) filter (event_type in ('error', 'signup')) as failed,
  count(*) filter (event_type = 'view') as with_warnings from events group by 1""")
def batch_outcome(spark, sf):
    return courses.batch_outcome(table(spark, sf, "events", *OUTCOME))


@query("mark_outcome", """with r as (select o_custkey, arg_max(o_orderkey % 3 <> 0, o_orderkey) as ok from orders group by 1)
select cast(c_custkey as varchar) as id, case when ok then 'up_to_date' when not ok and c_custkey % 2 = 0 then 'dirty' else 'missing' end as study_pack_status
from customer left join r on o_custkey = c_custkey""")
def mark_outcome(spark, sf):
    results = table(spark, sf, "orders", "o_orderkey as batch_id", "cast(o_custkey as string) as course_id", "o_orderkey % 3 <> 0 as has_output", "cast(null as string) as error")
    saved = table(spark, sf, "customer", "cast(c_custkey as string) as id", "case when c_custkey % 2 = 0 then 'p' else '' end as study_pack_path", "'missing' as study_pack_status")
    return courses.mark_outcome(saved, results).select("id", "study_pack_status")


# --- saved courses --------------------------------------------------------------------------------

COURSE_ROW = ("cast(c_custkey as string) as id", """case when c_custkey % 10 = 0 then concat('https://other.example.edu/course/view.php?id=', cast(c_custkey as string))
  else concat('https://LMS.example.edu/course/view.php?id=', cast(c_custkey % 1000 as string), '&s=', cast(c_custkey as string)) end as url""",
              "case when c_custkey % 10 = 1 then ' ' else '/data/courses' end as output", "concat('Math (ma', cast(1000 + c_custkey % 500 as string), ') ') as name",
              "case when c_custkey % 3 = 0 then ' ab12 ' else '' end as code", "cast(-(c_custkey % 3) as string) as last_downloaded",
              "case when c_custkey % 4 = 0 then 'many' else '7' end as last_skipped")


@query("read_courses", f"""with c as (select c_custkey, {', '.join(COURSE_ROW)} from customer), v as (select *, row_number() over (partition by c_custkey % 1000 order by c_custkey) as rn from c
   where c_custkey % 10 not in (0, 1))
select id, concat('https://lms.example.edu/course/view.php?id=', c_custkey % 1000) as url, trim(name) as name, case when c_custkey % 3 = 0 then 'AB12' else concat('MA', 1000 + c_custkey % 500) end as code,
  false as selected, 'never' as last_status, 0 as last_downloaded, case when c_custkey % 4 = 0 then 0 else 7 end as last_skipped, 'missing' as study_pack_status from v where rn = 1""")
def read_courses(spark, sf):
    """Written as JSON lines and scanned back."""
    path = f"{scale.shared_folder(spark)}/courses-{uuid.uuid4().hex}"
    table(spark, sf, "customer", *COURSE_ROW).write.json(path)
    return manifests.read_courses(spark, path, HOSTS).select(
        "id", "url", "name", "code", "selected", "last_status", "last_downloaded", "last_skipped", "study_pack_status")


BATCH = ("c_nationkey as batch_id", "c_custkey as pos", """case when c_custkey % 500 = 77 then 'https://evil.example.org/course/view.php?id=1'
  else concat('https://lms.example.edu/course/view.php?id=', cast(c_custkey % 400 as string)) end as url""", "'/data/courses' as output", "c_name as name", "'' as code")


@query("import_courses", f"""with b as (select {', '.join(BATCH)} from customer), bad as (select distinct batch_id from b where url like '%evil%'),
 r as (select *, row_number() over (partition by batch_id, url order by pos) as rn from b where pos % 400 % 10 <> 3)
select batch_id, pos, url, output, name, '' as code, false as selected from r where rn = 1 and batch_id not in (select batch_id from bad)""")
def import_courses(spark, sf):
    batch = table(spark, sf, "customer", *BATCH)
    existing = table(spark, sf, "customer").filter("c_custkey % 400 % 10 = 3").selectExpr(
        "concat('https://lms.example.edu/course/view.php?id=', cast(c_custkey % 400 as string)) as url")
    return courses.import_courses(existing, batch, HOSTS)


@query("sorted_courses", "select cast(c_custkey as varchar) as id, concat('MA', c_nationkey) as code, c_name as name from customer")
def sorted_courses(spark, sf):
    return courses.sorted_courses(table(spark, sf, "customer", "cast(c_custkey as string) as id", "concat('MA', cast(c_nationkey as string)) as code", "c_name as name"))


PARENT = "concat('n', cast(c_nationkey as string), case when c_custkey % 6 = 4 then 'L' else 'M' end)"


@query("resolve_roots", f"""with base as (select c_custkey, c_custkey % 6 as k, {PARENT} as parent, c_name, concat('https://lms.example.edu/course/view.php?id=', c_custkey) as url from customer),
 folders as (select parent, c_name as folder, url, null as name, true as meta from base where k = 0
  union all select parent, concat('x', c_custkey), url, null, true from base where k in (1, 2)
  union all select parent, concat('z', c_custkey), url, null, true from base where k = 2
  union all select parent, concat('y', c_custkey), null, lower(c_name), true from base where k = 3
  union all select parent, c_name, null, null, false from base where k = 4
  union all select parent, c_name, concat(url, '9'), null, true from base where k = 5),
 u as (select parent, url, count(distinct folder) as n, min(folder) as f from folders where url is not null group by all),
 m as (select parent, name, count(distinct folder) as n, min(folder) as f from folders where name is not null group by all),
 own as (select distinct parent, folder, coalesce(url, name) as own from folders where meta),
 plain as (select distinct parent, folder from folders where not meta and parent not in (select parent from folders where meta)),
 r as (select b.*, o1.own is not null or o2.own is not null as exact, coalesce(u.n, 0) + coalesce(m.n, 0) as n, coalesce(u.f, m.f) as f, plain.folder is not null as legacy
  from base b left join u on u.parent = b.parent and u.url = b.url left join m on m.parent = b.parent and m.name = lower(b.c_name)
   left join own o1 on o1.parent = b.parent and o1.folder = b.c_name and o1.own = b.url left join own o2 on o2.parent = b.parent and o2.folder = b.c_name and o2.own = lower(b.c_name)
   left join plain on plain.parent = b.parent and plain.folder = b.c_name)
select cast(c_custkey as varchar) as course_id, case when exact then 'exact' when n = 1 then 'metadata' when n > 1 then 'ambiguous' when legacy then 'legacy' else 'missing' end as resolution,
 case when exact then c_name when n = 1 then f when n = 0 and legacy then c_name end as folder from r""")
def resolve_roots(spark, sf):
    """Folders planted per customer: named, by URL, doubled, by old name, bare, none."""
    base = table(spark, sf, "customer", "c_custkey", f"{PARENT} as parent", "c_name",
                 "concat('https://lms.example.edu/course/view.php?id=', cast(c_custkey as string)) as url")
    k = F.col("c_custkey") % 6
    none = F.lit(None).cast("string")
    folder = lambda when, name, meta, url, root: base.filter(when).select(
        "parent", name.alias("folder"), F.lit(meta).alias("has_metadata"), url.alias("root_course_url"), root.alias("root_course"))
    x = F.concat(F.lit("x"), "c_custkey")
    folders = (folder(k == 0, F.col("c_name"), True, F.concat("url", F.lit("&a=1")), none)
               .unionByName(folder(k.isin(1, 2), x, True, F.col("url"), none))
               .unionByName(folder(k == 2, F.concat(F.lit("z"), "c_custkey"), True, F.col("url"), none))
               .unionByName(folder(k == 3, F.concat(F.lit("y"), "c_custkey"), True, none, F.concat(F.lit(" "), F.upper("c_name"))))
               .unionByName(folder(k == 4, F.col("c_name"), False, none, none))
               .unionByName(folder(k == 5, F.col("c_name"), True, F.concat("url", F.lit("9")), F.col("c_name"))))
    wanted = base.select(F.col("c_custkey").cast("string").alias("course_id"), "parent", "url", F.col("c_name").alias("name"))
    return courses.resolve_roots(wanted, folders).select("course_id", "resolution", "folder")


# --- names --------------------------------------------------------------------------------------------

NAMED = "case when p_partkey % 50 = 0 then concat(p_name, ' (', cast(2 + p_partkey % 7 as string), ').pdf') else concat(p_name, '.pdf') end"


@query("unique_names", f"""with n as (select p_type, p_partkey, {NAMED} as name from part),
 r as (select *, row_number() over (partition by p_type, name order by p_partkey) as k from n),
 used as (select distinct p_type, concat(regexp_extract(name, '^(.*) \\(\\d+\\)(\\.pdf)$', 1), '.pdf') as name, cast(regexp_extract(name, ' \\((\\d+)\\)\\.pdf$', 1) as int) as no from n where regexp_matches(name, ' \\(\\d+\\)\\.pdf$')),
 g as (select p_type, name, max(k) as m from r group by 1, 2),
 f as (select g.p_type, g.name, t.no, row_number() over (partition by g.p_type, g.name order by t.no) + 1 as k from g, lateral (select unnest(range(2, g.m + 60)) as no) t
   where not exists (select 1 from used u where u.p_type = g.p_type and u.name = g.name and u.no = t.no))
select r.p_type, r.p_partkey, r.name, case when r.k = 1 then r.name else concat(regexp_replace(r.name, '\\.pdf$', ''), ' (', f.no, ').pdf') end as unique_name
from r left join f on f.p_type = r.p_type and f.name = r.name and f.k = r.k""")
def unique_names(spark, sf):
    return names.unique_names(table(spark, sf, "part", "p_type", "p_partkey", f"{NAMED} as name"), "p_partkey", "name", ["p_type"])


RIGHT_NAME = "concat('Đề cương ôn tập ', cast(doc_id % 9 as string), '.pdf')"


@query("repair_names", f"""with n as (select doc_id, lang, doc_id % 3 = 0 as broken, {RIGHT_NAME} as name from documents),
 taken as (select lang, name, count(*) as t from n where not broken group by 1, 2),
 r as (select n.doc_id, n.lang, n.name, row_number() over (partition by n.lang, n.name order by cast(doc_id as varchar)) + coalesce(t, 0) as k from n left join taken on taken.lang = n.lang and taken.name = n.name where broken)
select doc_id, lang, case when k = 1 then name else concat(regexp_replace(name, '\\.pdf$', ''), ' (', k, ').pdf') end as new_name from r""")
def repair_names(spark, sf):
    """Every third name was read as Latin-1."""
    rows = table(spark, sf, "documents", "doc_id", "lang", f"""case when doc_id % 3 = 0 then decode(encode({RIGHT_NAME}, 'UTF-8'), 'ISO-8859-1') else {RIGHT_NAME} end as name""")
    return names.repair_names(rows, "doc_id", "name", ["lang"]).drop("name")


# --- progress --------------------------------------------------------------------------------------------

SYNC_EVENT = ("user_id as course_id", "cast(event_id % 10 + 1 as int) as activity_index", "10 as activity_total", "cast(value * 1000 as bigint) as bytes_written", "500000L as bytes_total",
              "event_type = 'purchase' as completed", "event_type = 'signup' and user_id % 3 = 0 as course_complete")
PROGRESS_SQL = """e as (select user_id as course_id, event_id % 10 + 1 as i, cast(trunc(value * 1000) as bigint) as w, event_type = 'purchase' as done, event_type = 'signup' and user_id % 3 = 0 as whole from events),
 f as (select course_id, whole, case when done then i / 10 else least(i / 10, (i - 1 + least(1.0, w / 500000)) / 10) end as x from e),
 p as (select course_id, case when bool_or(whole) then 1.0 else max(least(0.98, x)) end as fraction, bool_or(whole) as complete from f group by 1)"""


@query("progress", f"with {PROGRESS_SQL} select course_id, fraction, complete from p")
def progress_batch(spark, sf):
    return progress.progress(table(spark, sf, "events", *SYNC_EVENT))


@query("progress_overall", f"with {PROGRESS_SQL} select count(*) filter (complete) as completed, count(*) as total, round(sum(fraction) / count(*), 6) as overall from p")
def progress_overall(spark, sf):
    return progress.overall(progress.progress(table(spark, sf, "events", *SYNC_EVENT))).withColumn("overall", F.round("overall", 6))


@query("progress_stream", f"with {PROGRESS_SQL} select course_id, fraction, complete from p")
def progress_stream(spark, sf):
    """The same aggregation as a stream over the table, run to its end."""
    path = f"{scale.shared_folder(spark)}/progress-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").selectExpr(*SYNC_EVENT)
    progress.start(stream, f"{path}/out", f"{path}/checkpoint", available_now=True).awaitTermination()
    return progress.latest(spark, f"{path}/out")


THROTTLE_SQL = """with recursive c as (select user_id, min(ts) as ts, 0 as n from events group by 1
 union all select c.user_id, (select min(e.ts) from events e where e.user_id = c.user_id and e.ts >= c.ts + interval 6 hour), n + 1 from c where c.ts is not null)
select e.user_id, e.ts, min(e.event_id) as event_id from c join events e on e.user_id = c.user_id and e.ts = c.ts where c.n > 0 group by 1, 2"""


@query("throttle", THROTTLE_SQL)
def throttle_query(spark, sf):
    return throttle.throttle_batch(table(spark, sf, "events"), "user_id", "ts", "event_id", 21_600)


@query("throttle_stream", THROTTLE_SQL)
def throttle_stream(spark, sf):
    path = f"{scale.shared_folder(spark)}/throttle-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    throttle.start(stream, f"{path}/out", f"{path}/checkpoint", "user_id", "ts", "event_id", 21_600, ttl_seconds=None, available_now=True).awaitTermination()
    return throttle.passed_events(spark, f"{path}/out")
