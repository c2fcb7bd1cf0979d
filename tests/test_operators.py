"""Small fixtures and brute force for what SQL does not check."""
import heapq
import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from studycorpus.functions import fixed_values as V, text as T, urls as U
from studycorpus.operators import chunking, classify, crawl, dedup, exams, names, refresh, reports, retention, similarity, validate, visual
from studycorpus.plans import corpus, scale
from studycorpus.sources import files, manifests, pages
from studycorpus.streaming import ingest, throttle


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr).first()[0]


# --- chunking against a plain one-text version ------------------------------------

def tidy(text):
    text = text.replace("\xa0", " ").replace("\r\n", "\n").replace("\r", "\n")
    text = "\n".join(re.sub(r"[ \t]+", " ", part).strip() for part in text.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def plain_chunks(text, size, overlap):
    text = tidy(text)
    if len(text) <= size:
        return [text] if text else []
    done, open_ = [], ""
    for p in filter(None, (x.strip() for x in re.split(r"\n\s*\n", text))):
        if len(p) > size:
            done += [open_] if open_ else []
            open_ = ""
            last = max(0, -(-(len(p) - size) // (size - overlap)))
            done += [p[k * (size - overlap):k * (size - overlap) + size] for k in range(last + 1)]
        elif open_ and len(open_) + 2 + len(p) > size:
            done.append(open_)
            tail = open_[-overlap:].strip()
            open_ = f"{tail}\n\n{p}" if tail else p
        else:
            open_ = f"{open_}\n\n{p}" if open_ else p
    return [c.strip() for c in done + [open_] if c.strip()]


def test_chunks_equal_plain_version(spark):
    rng = random.Random(3)
    alphabet = ["a", "bé", " ", "\n", "\n\n", "\t", "xyz", "　", " ", "𝒳"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r["id"]: r["_pieces"] for r in chunking.with_pieces(df, "t", 60, 11).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_chunks(t, 60, 11), repr(t)


def test_chunk_ordinals_run_through_units(spark):
    units = [("c", "s", n, f"page {n}", "word " * (1 + n % 7 * 20)) for n in range(1, 60)]
    df = spark.createDataFrame(units, "course_id string, source_id string, unit_no int, locator string, text string")
    out = chunking.chunk_units(df, 100, 10).orderBy("ordinal").collect()
    expected = [(u[3], p) for u in units for p in plain_chunks(u[4], 100, 10)]
    assert [(r["locator"], r["text"]) for r in out] == expected
    assert [r["chunk_id"] for r in out] == [f"s_c{i:04d}" for i in range(1, len(expected) + 1)]


# --- names, groups, codes ---------------------------------------------------------

@pytest.mark.parametrize("path,chapters,group", [
    ("Ch3_4/a.pdf", [3, 4], "chapter_03_04"), ("Chapter 3-4.pdf", [3, 4], "chapter_03_04"),
    ("Ch 3 & 4/x.pdf", [3, 4], "chapter_03_04"), ("Chapter 1/Ch2 notes.txt", [2], "chapter_02"),
    ("01_Intro/slides.pptx", [], "other"), ("Course Syllabus.pdf", [0], "00_course"),
    ("Textbook/all.pdf", [], "references"), ("Thông tin môn học/a.txt", [0], "00_course"),
    ("Ch1 - 2024/a.pdf", list(range(1, 21)), None), ("Ch0/a.pdf", [], "other")])
def test_groups(spark, path, chapters, group):
    row = classify.assign_group(spark.createDataFrame([(path,)], "path string")).first()
    assert row["chapters"] == chapters
    assert group is None or row["group"] == group


def test_strict_range_refuses_a_year(spark):
    row = classify.assign_group(spark.createDataFrame([("Ch1 - 2024/a.pdf",)], "path string"), strict=True).first()
    assert row["chapters"] == [1]


def test_text_expressions(spark):
    assert one(spark, " Ａ b\tﬁ ", T.norm_compare("v")) == "a b fi"
    assert one(spark, "Đồ án  Môn", T.fold("v")) == "do an mon"
    assert one(spark, "Đồ_án–x", T.fold_section("v")) == "đo an x"
    assert one(spark, "a/b/Content.TXT", T.title_of("v")) == "b"
    assert one(spark, "x/my_file.tar.gz", T.suffix("v")) == ".gz"
    assert one(spark, "x/.bashrc", T.suffix("v")) == ""
    assert one(spark, "Math (co3094) L01", T.course_code("v")) == "CO3094"
    assert one(spark, 'say "hi"\n', T.quoted("v")) == '"say \\"hi\\"\\n"'
    assert one(spark, "con.txt", T.safe_name("v")) == "_con.txt"
    assert one(spark, "a:b?. ", T.safe_name("v")) == "a_b_"


def test_links_resolve(spark):
    cases = {"x.pdf": "http://h.org/a/x.pdf", "/x": "http://h.org/x", "../x": "http://h.org/x", "//o.org/y": "http://o.org/y",
             "?q=1": "http://h.org/a/b?q=1", "https://z.org/p#f": "https://z.org/p#f", "c/../d": "http://h.org/a/d"}
    df = spark.createDataFrame(list(cases.items()), "href string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", U.resolve(F.lit("http://h.org/a/b?z=1"), "href")).collect())


def test_mojibake_name(spark):
    broken = "CHƯƠNG 1.pdf".encode().decode("latin-1")
    df = spark.createDataFrame([(1, broken), (2, "CHƯƠNG 1.pdf"), (3, "ok.pdf")], "id int, name string")
    assert rows(names.repair_names(df, "id"), "id", "new_name") == [(1, "CHƯƠNG 1 (2).pdf")]


# --- skew: one key holds most rows ---------------------------------------------------

def test_numbering_and_salts_on_one_hot_key(spark, monkeypatch):
    monkeypatch.setattr(scale, "HEAVY_MIN_ROWS", 50)
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    out = scale.running(df, ["k"], [F.col("id")], {"total": F.col("id")}).filter("k = 'hot'").orderBy("id").collect()
    total = 0
    for r in out:
        total += r["id"]
        assert r["total"] == total
    counts = df.groupBy("k").agg(F.count("*").alias("n"))
    joined = scale.salted_join(df, counts, ["k"], "n")
    assert joined.count() == 5000 and joined.filter("n is null").isEmpty()
    nulls = df.withColumn("k", F.when(F.col("k") != "hot", F.col("k")))
    assert scale.salted_join(nulls, counts, ["k"], "n").count() == 5000
    assert scale.lookup_join(nulls, counts, ["k"]).filter("n is null").count() == 4000


def test_duplicates_with_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr(scale, "HEAVY_MIN_ROWS", 50)
    body = "the same long text " * 10
    data = [("c", f"p{i:04d}", i % 3, body if i % 3 else f"{i} {body}") for i in range(600)] + [("c", "short", 0, "x"), ("c", "none", 0, "  ")]
    out = dedup.dedup_exact(spark.createDataFrame(data, "course_id string, path string, rank int, body string"))
    by = {r["path"]: r for r in out.collect()}
    copies = [p for p, r in by.items() if r["status"] == "duplicate"]
    assert len(copies) == 399 and by["p0001"]["status"] == "ready" and by["p0002"]["note"] == "Duplicate text of p0001"
    assert by["none"]["status"] == "empty" and by["short"]["status"] == "ready"


# --- similarity and matching -----------------------------------------------------------

def sets_data(n=70, seed=5):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 40)}" for _ in range(12)] for _ in range(8)]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(12)] = f"w{rng.randint(0, 40)}"
        out.append((i, "c", "l" if i % 2 else "r", " ".join(words)))
    return out


def test_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similarity, "ROWS_PER_CELL", 3)
    data = sets_data()
    docs = spark.createDataFrame(data, "id long, course_id string, side string, text string")
    got = rows(similarity.near_duplicate_pairs(docs, "id", "text", "side", "l", "r"), "left_id", "right_id")
    heads = {}
    for i, _, side, text in data:
        heads.setdefault((side, frozenset(text.split())), i)
    want = sorted((a, b) for (s1, x), a in heads.items() for (s2, y), b in heads.items()
                  if s1 == "l" and s2 == "r" and len(x & y) / len(x | y) >= 0.7)
    assert got == want and want


def test_greedy_choice_equals_sequential(spark):
    rng = random.Random(9)
    pairs = sorted({(rng.randint(0, 12), rng.randint(20, 32)) for _ in range(70)})
    data = [("c", a, b, rng.choice([0.7, 0.8, 0.9, 1.0])) for a, b in pairs]
    cost = {i: rng.randint(1, 5) for i in range(40)}
    used, want = set(), []
    for _, a, b, s in sorted(data, key=lambda r: (-r[3], r[1], r[2])):
        if a not in used and b not in used:
            used |= {a, b}
            want.append((a, b) if cost[a] > cost[b] else (b, a))
    got = similarity.pick_representatives(
        spark.createDataFrame(data, "course_id string, left_id long, right_id long, similarity double"),
        spark.createDataFrame([("c", i, c) for i, c in cost.items()], "course_id string, source_id long, cost long"))
    assert rows(got, "source_id", "represented_by") == sorted(want)


def plain_align(left, right, gap, limit):
    """Cheapest cost by plain recursion over prefixes."""
    from functools import cache

    @cache
    def cost(i, j):
        if not i or not j:
            return (i + j) * gap
        return min(cost(i - 1, j - 1) + (left[i - 1] ^ right[j - 1]).bit_count(), cost(i - 1, j) + gap, cost(i, j - 1) + gap)

    return cost(len(left), len(right))


def test_alignment_cases(spark):
    import numpy as np
    rng = random.Random(1)
    h = [rng.getrandbits(64) for _ in range(6)]
    u = lambda v: np.array(v, dtype=np.uint64)
    assert visual._align(u(h), u(h), 12, 8) == ([0] * 6, [], [])
    assert visual._align(u(h), u(h[:2] + h[3:]), 12, 8) == ([0] * 5, [3], [])
    assert visual._align(u(h[1:]), u(h), 12, 8) == ([0] * 5, [], [1])
    changed = h[:3] + [h[3] ^ (2**64 - 1)] + h[4:]
    assert visual._align(u(h), u(changed), 12, 8) == ([0] * 5, [4], [4])
    for _ in range(30):
        a = [rng.getrandbits(6) for _ in range(rng.randint(1, 6))]
        b = [rng.getrandbits(6) for _ in range(rng.randint(1, 6))]
        # at distance limit 64 every diagonal step counts as aligned, so costs add up
        d, x, y = visual._align(u(a), u(b), 3, 64)
        assert sum(d) + 3 * (len(x) + len(y)) == plain_align(tuple(a), tuple(b), 3, 64)


def test_budget_drops_costliest_first(spark):
    kept = spark.createDataFrame([("c", f"s{i}", i * 10, "TEXT_DOMINANT") for i in range(1, 11)],
                                 "course_id string, source_id string, cost long, verdict string")
    total = spark.createDataFrame([("c", 600)], "course_id string, total long")
    assert rows(retention.size_budget(kept, total, 420), "source_id") == [("s10",), ("s9",)]
    assert retention.size_budget(kept, total, 600).isEmpty()


def test_long_chains_are_decided_in_few_steps(spark, monkeypatch):
    """Rising chains, stars and rings beyond the size of a group, against the sequential choice."""
    rng = random.Random(6)
    data = [("chain", f"l{i // 2:04}" if i % 2 == 0 else f"l{i // 2 + 1:04}", f"r{(i + 1) // 2:04}" if i % 2 else f"r{i // 2:04}", 0.7 + i / 10_000) for i in range(800)]
    data += [("star", "hub", f"r{i}", 0.7 + i / 1000) for i in range(50)]
    data += [("mesh", f"l{a}", f"r{b}", rng.choice([0.7, 0.8, 0.9])) for a in range(12) for b in range(12) if rng.random() < 0.6]
    want, used = set(), set()
    for c, a, b, s in sorted(data, key=lambda r: (-r[3], r[1], r[2])):
        if (c, a, "l") not in used and (c, b, "r") not in used:
            used |= {(c, a, "l"), (c, b, "r")}
            want.add((c, b, a))
    tables, write = [], scale.checkpointed
    monkeypatch.setattr(scale, "checkpointed", lambda df: tables.append(1) or write(df))
    costs = spark.createDataFrame(sorted({(c, x, 1) for c, a, b, _ in data for x in (a, b)}), "course_id string, source_id string, cost long")
    got = similarity.pick_representatives(spark.createDataFrame(data, "course_id string, left_id string, right_id string, similarity double"), costs,
                                          rounds=1, group_pairs=5)
    assert {(r.course_id, r.source_id, r.represented_by) for r in got.collect()} == want
    assert len(tables) < 130


def full_alignment(x, y, gap, limit):
    """The whole table, by the definition."""
    n, m = len(x), len(y)
    cost = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            ways = ([cost[i - 1][j - 1] + (x[i - 1] ^ y[j - 1]).bit_count()] if i and j else []) + ([cost[i - 1][j] + gap] if i else []) + ([cost[i][j - 1] + gap] if j else [])
            cost[i][j] = min(ways, default=0)
    i, j, near, left, right = n, m, [], [], []
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (d := (x[i - 1] ^ y[j - 1]).bit_count()):
            if d <= limit:
                near.append(d)
            else:
                left.append(i)
                right.append(j)
            i, j = i - 1, j - 1
        elif i and cost[i][j] == cost[i - 1][j] + gap:
            left.append(i)
            i -= 1
        else:
            right.append(j)
            j -= 1
    return near, sorted(left), sorted(right)


def test_alignment_in_a_band_equals_the_full_table(monkeypatch):
    rng = random.Random(8)
    for band in (0, 1, 16):
        monkeypatch.setattr(visual, "BAND", band)
        for _ in range(150):
            n = rng.randrange(0, 40)
            m = max(0, n + rng.randrange(-1, 2))
            x = [rng.getrandbits(64) for _ in range(n)]
            y = ([v ^ (1 << rng.randrange(64)) for v in x[rng.randrange(4):]] + [rng.getrandbits(64) for _ in range(m)])[:m] if rng.random() < 0.7 else \
                [rng.getrandbits(64) for _ in range(m)]
            near, left, right = visual._align(np.array(x, np.uint64), np.array(y, np.uint64), 12, 8)
            want = full_alignment(x, y, 12, 8)
            assert (near, left, right) == want


# --- exams -----------------------------------------------------------------------------

@pytest.mark.parametrize("label,ctx,kind", [
    ("Checklist.pdf", False, None), ("Packet.pdf", False, None), ("GK_HK221.pdf", False, "midterm"), ("Thi cuối kỳ.pdf", False, "final"),
    ("final HK212.pdf", False, "final"), ("final.pdf", False, None), ("final.pdf", True, "final"), ("notes.pdf", True, "unknown_exam"),
    ("Đề giữa kỳ", False, "midterm"), ("giua ky", False, None)])
def test_exam_labels(spark, label, ctx, kind):
    df = spark.createDataFrame([(label, ctx)], "name string, ctx boolean")
    assert exams.classify_exams(df, "name", "ctx").first()["exam_type"] == kind


def test_deep_tree_inherits(spark):
    nodes = [("r", "r", None, "Course", True), ("r", "a", "r", "Tài liệu", True), ("r", "b", "a", "Đề thi chính thức", True),
             ("r", "c", "b", "HK201", True), ("r", "d", "c", "Cuối kỳ", True), ("r", "f", "d", "bai lam.pdf", False),
             ("r", "x", "r", "Slides", True), ("r", "y", "x", "final exam.pdf", False)]
    out = exams.exam_context(spark.createDataFrame(nodes, "root_id string, node_id string, parent_id string, name string, is_folder boolean"))
    by = {r["node_id"]: r for r in out.collect()}
    assert (by["f"]["exam_type"], by["f"]["term"], by["f"]["exam_variant"]) == ("final", "HK201", "official")
    assert by["x"]["state"] == "skipped_non_exam_folder" and "y" not in by


def tokens_of(label):
    return " " + re.sub("[^a-z0-9]+", " ", " ".join(label.lower().split())).strip() + " "


def says(label, phrases):
    return any(f" {p} " in tokens_of(label) for p in phrases)


def typed(name):
    t = tokens_of(name)
    return says(name, V.MIDTERM_PHRASES) and says(name, V.MIDTERM_SURE) or says(name, V.FINAL_PHRASES) and (
        says(name, V.FINAL_SURE) or " final " in t and " hk" in t)


def best_first(nodes, max_depth, max_nodes):
    """The walk with a priority queue: node -> (state, depth, path label)."""
    children = {}
    for root, node, parent, name, folder in nodes:
        children.setdefault((root, parent), []).append((node, name, folder))
    out = {}
    for root in sorted({n[0] for n in nodes}):
        queue, turn, popped = [], 0, 0
        for node, name, folder in sorted(children.get((root, None), [])):
            heapq.heappush(queue, (0, turn, node, name, folder, 0, "", says(f" {name}", V.EXAM_CONTEXT)))
            turn += 1
        while queue and (max_nodes is None or popped < max_nodes):
            _, _, node, name, folder, depth, path, context = heapq.heappop(queue)
            popped += 1
            if not folder:
                if context or typed(name):
                    out[root, node] = ("exam", depth, path)
                continue
            if max_depth is not None and depth >= max_depth and depth:
                out[root, node] = ("depth_limit", depth, path)
                continue
            out[root, node] = ("enumerated", depth, path)
            if max_depth == 0:
                continue
            below = [(c, n, f, f"{path}/{n}".strip("/")) for c, n, f in children.get((root, node), [])]
            for c, n, f, p in sorted(below, key=lambda b: (not says(f"{b[3]} {b[1]}", V.EXAM_CONTEXT), b[0])):
                inner = context or says(f"{p} {n}", V.EXAM_CONTEXT)
                if not f:
                    if context or typed(f"{p} {n}"):
                        out[root, c] = ("exam", depth + 1, p)
                elif not (inner or any(h in tokens_of(f"{p} {n}") for h in V.PARENT_FOLDER_HINTS)):
                    out[root, c] = ("skipped_non_exam_folder", depth + 1, p)
                else:
                    heapq.heappush(queue, (0 if typed(n) else 1 if inner else 3, turn, c, n, f, depth + 1, p, inner))
                    turn += 1
        for _, _, node, _, _, depth, path, _ in queue:
            out[root, node] = ("node_limit", depth, path)
    return out


NODE_SCHEMA = "root_id string, node_id string, parent_id string, name string, is_folder boolean"


def made_trees(seed):
    rng = random.Random(seed)
    names = ["de thi", "midterm exam", "final exam", "Documents", "semester 1", "archive", "slides", "HK201", "past exams", "tai lieu", "week 2", "mid", "term"]
    nodes = []
    for r in range(12):
        ids = [f"n{i:03}" for i in range(rng.choice([1, 5, 40, 80]))]
        rng.shuffle(ids)
        roots, placed = rng.choice([1, 1, 3]), []
        for i, node in enumerate(ids):
            folder = i == 0 or rng.random() < 0.7
            parent = None if i < roots or not placed else rng.choice(placed[-8:] if rng.random() < 0.5 else placed)
            nodes.append((f"r{r}", node, parent, rng.choice(names) + ("" if folder else ".pdf"), folder))
            if folder:
                placed.append(node)
    return nodes


@pytest.mark.parametrize("max_depth, max_nodes", [(None, None), (3, None), (None, 1), (None, 7), (4, 20), (None, 1000)])
def test_walk_equals_a_priority_queue(spark, max_depth, max_nodes):
    nodes = made_trees(max_nodes or 5)
    nodes += [("ring", "x", "y", "exam", True), ("ring", "y", "x", "exam", True), ("lost", "x", "gone", "exam", True)]
    out = exams.exam_context(spark.createDataFrame(nodes, NODE_SCHEMA), max_depth, max_nodes).collect()
    got = {(r.root_id, r.node_id): (r.state, r.depth, r.path_label) for r in out}
    assert len(got) == len(out)
    assert got == best_first([n for n in nodes if n[0][0] == "r" and n[0] != "ring"], max_depth, max_nodes)


def test_deep_chain_takes_few_rounds(spark, monkeypatch):
    chain = [("r", f"n{i:04}", f"n{i - 1:04}" if i else None, "exam" if i == 3 else "hk", True) for i in range(1000)]
    tables, write = [], scale.checkpointed
    monkeypatch.setattr(scale, "checkpointed", lambda df: tables.append(1) or write(df))
    out = exams.exam_context(spark.createDataFrame(chain, NODE_SCHEMA)).select("node_id", "depth", "state").collect()
    assert sorted(tuple(r) for r in out) == [(f"n{i:04}", i, "enumerated") for i in range(1000)]
    assert len(tables) <= 2 * 11 + 6


def test_several_parents(spark):
    """A folder under two parents is entered by the one that leads to it first, once."""
    nodes = [("r", "r", None, "Course", True), ("r", "a", "r", "archive", True), ("r", "b", "r", "slides", True), ("r", "c", "a", "Documents", True),
             ("r", "x", "b", "final exam", True), ("r", "x", "c", "final exam", True), ("r", "f", "x", "hk1.pdf", False)]
    for limit in (None, 50):
        out = {(r.node_id, r.state, r.depth) for r in exams.exam_context(spark.createDataFrame(nodes, NODE_SCHEMA), max_nodes=limit).collect()}
        assert out == {("r", "enumerated", 0), ("a", "enumerated", 1), ("b", "skipped_non_exam_folder", 1), ("c", "enumerated", 2),
                       ("x", "enumerated", 3), ("f", "exam", 4)}


def test_candidates_of_a_walk(spark):
    walk = spark.createDataFrame([("r", "a", 1, "exam", "x" * 200 + ".pdf"), ("r", "a", 3, "exam", "later.pdf"), ("r", "b", 1, "unsupported_item", "b.bin")],
                                 "root_id string, node_id string, depth int, state string, name string")
    assert [(r.node_id, r.original_name) for r in exams.exam_candidates(walk).collect()] == [("a", "later.pdf")]


# --- pages -------------------------------------------------------------------------------

def test_course_page(spark):
    html = """<html><body><nav><a href="/mod/page/1">no</a></nav><ul>
      <li class="course-section" id="s0"><h3 class="sectionname">Chung <span class="sr-only">hidden</span></h3>
        <div class="activity"><a href="/mod/page/view.php?id=1"><span class="instancename">Intro<span class="accesshide"> Page</span></span></a></div>
        <div class="activity"><a href="/mod/page/view.php?id=1">again</a></div><a href="/other">x</a></li>
      <li class="course-section" id="s1"><h3>Chapter 1 -   Introduction</h3><div class="activity"><a href="/mod/resource/view.php?id=2">R</a></div>
        <div class="activity"><a href="/mod/quiz/view.php?id=3">Q</a></div></li></ul></body></html>"""
    df = spark.createDataFrame([(1, "https://lms.example.edu/course/view.php?id=5", html)], "page_id long, url string, html string")
    got = rows(pages.page_outline(df, ["lms.example.edu"]), "section_idx", "section_title", "activity_order", "activity_name", "mod_type")
    assert got == [(0, "Chung", 1, "Intro", "page"), (1, "Chapter 1 - Introduction", 1, "R", "resource"),
                   (1, "Chapter 1 - Introduction", 2, "Q", "quiz")]
    assert [r["kind"] for r in pages.page_links(df, ["lms.example.edu"]).orderBy("pos").collect()] == ["deep", "other", "deep", "interactive"]
    assert "no" not in pages.page_text(df).first()["text"].split("\n")


def test_catalog_table_with_merged_cells(spark):
    html = """<table><tr><th>Mã môn</th><th>Tên môn học</th><th>Giảng viên</th><th>Tài liệu</th><th>Link</th></tr>
      <tr><td rowspan="2">CO1005</td><td rowspan="2">Intro</td><td>A</td><td><a href="https://x.org/1">m</a></td><td><a href="https://x.org/2">v</a></td></tr>
      <tr><td>B</td><td colspan="2"><a href="https://www.google.com/url?q=https%3A%2F%2Fx.org%2F3">m</a></td></tr>
      <tr><td></td><td></td><td>C</td><td>no link</td><td></td></tr>
      <tr><td></td><td></td><td></td><td><a href="https://x.org/4#z">m</a></td><td></td></tr></table>"""
    df = spark.createDataFrame([(1, "https://x.org/list", html)], "page_id long, url string, html string")
    out = pages.catalog_from_tables(df).withColumn("links", F.array_join(F.transform("material_links", lambda l: l["url"]), " "))
    assert rows(out, "course_code", "course_name", "lecturer", "links") == [
        ("CO1005", "Intro", "A", "https://x.org/1 https://x.org/2"), ("CO1005", "Intro", "B", "https://x.org/3 https://x.org/3"),
        ("CO1005", "Intro", "C", "https://x.org/4")]


# --- files, manifests, streams --------------------------------------------------------------

@pytest.fixture()
def folder(spark):
    import os
    path = f"{scale.shared_folder(spark).removeprefix('file:')}/files-{uuid.uuid4().hex}"
    os.makedirs(f"{path}/c1/Ch 1/.git"), os.makedirs(f"{path}/c2")
    body = "Một đoạn văn bản đủ dài để so sánh. " * 5
    for name, data in {"c1/Ch 1/a+b.txt": body.encode(), "c1/Ch 1/copy.txt": body.encode(), "c1/Ch 1/.git/x.txt": b"x",
                       "c2/old.txt": "Sugar;á".encode("cp1252"), "c2/pack.corpus.zip": b"z", "c2/x.bin": b"\xff\x00"}.items():
        with open(f"{path}/{name}", "wb") as f:
            f.write(data)
    return path


def test_scan_and_decode(spark, folder):
    scan = files.scan_files(spark, folder)
    assert rows(scan, "course_id", "path", "ext") == [
        ("c1", "Ch 1/a+b.txt", ".txt"), ("c1", "Ch 1/copy.txt", ".txt"), ("c2", "old.txt", ".txt"), ("c2", "x.bin", ".bin")]
    assert "content" not in scan._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    texts = files.decode_text(files.scan_files(spark, folder, content=True).filter("ext = '.txt'"))
    assert "Sugar;á" in [r["text"] for r in texts.collect()]


def test_ingest_files_twice(spark, folder):
    base = f"{scale.shared_folder(spark)}/ingest-{uuid.uuid4().hex}"

    def run():
        ingest.start(files.stream_files(spark, folder), f"{base}/out", f"{base}/cp", available_now=True).awaitTermination()
        return ingest.current_corpus(spark, f"{base}/out")

    records, chunks = run()
    assert rows(records, "source_path", "status") == [("Ch 1/a+b.txt", "ready"), ("Ch 1/copy.txt", "duplicate"), ("old.txt", "ready"),
                                                      ("x.bin", "skipped_unsupported")]
    assert chunks.count() == 2
    with open(f"{folder}/c2/new.txt", "w") as f:
        f.write("new file")
    records, chunks = run()
    assert records.count() == 5 and chunks.count() == 3


def test_manifest_policies(spark, folder):
    with open(f"{folder}/m.jsonl", "w") as f:
        f.write('{"a": 1}\n\n{"a": 2\n[1]\n{"a": 3}\n')
    good, errors = manifests.read_manifest(spark, f"{folder}/m.jsonl", "a int")
    assert rows(good, "a") == [(1,), (3,)] and rows(errors, "line_no") == [(3,)]
    assert manifests.read_manifest(spark, f"{folder}/m.jsonl", "a int", "reject_file")[0].isEmpty()


def test_failed_version_keeps_the_old_one(spark):
    path = f"{scale.shared_folder(spark)}/pub-{uuid.uuid4().hex}"
    table = lambda n: spark.createDataFrame([("a", n), ("b", n)], "course_id string, n int")
    bad_b = lambda t: t["t"].filter("course_id = 'b' and n = 2").select("course_id", F.lit("error").alias("severity"))
    manifests.publish_if_valid({"t": table(1)}, path, bad_b)
    manifests.publish_if_valid({"t": table(2)}, path, bad_b)
    assert rows(manifests.read_current(spark, path, "t"), "course_id", "n") == [("a", 2), ("b", 1)]


def test_throttle_batch_on_one_busy_key(spark):
    rng = random.Random(2)
    data = [("hot" if rng.random() < 0.8 else f"k{rng.randint(0, 5)}", rng.randint(0, 4000), i) for i in range(3000)]
    events = spark.createDataFrame(data, "k string, s long, id long").withColumn("ts", F.timestamp_seconds("s"))
    got = rows(throttle.throttle_batch(events, "k", "ts", "id", 7).withColumn("s", F.unix_seconds("ts")), "k", "s", "id")
    want = []
    for k in {d[0] for d in data}:
        mine = sorted((s, i) for key, s, i in data if key == k)
        last = mine[0][0]
        for s, i in mine:
            if s - last >= 7:
                want.append((k, s, i))
                last = s
    assert got == sorted(want)


def throttled(data, gap):
    want = []
    for k in {d[0] for d in data} - {None}:
        mine = sorted((s, i) for key, s, i in data if key == k and s is not None)
        last = mine[0][0] if mine else None
        for s, i in mine:
            if s - last >= gap:
                want.append((k, s, i))
                last = s
    return sorted(want)


def test_throttle_batch_ranges_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(throttle, "ROWS", 100, raising=False)
    tables, write = [], scale.checkpointed
    monkeypatch.setattr(scale, "checkpointed", lambda df: tables.append(write(df)) or tables[-1])
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.8 else f"k{rng.randint(0, 40)}", rng.randint(0, 4000), i) for i in range(4000)]
    data += [(None, 5, -1), (None, 50_000, -2), ("hot", None, -3)]
    events = spark.createDataFrame(data, "k string, s long, id long").withColumn("ts", F.timestamp_seconds("s"))
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch, gap in ((most, 7), (3, 7), (11, 900), (5, 1), (5, 100_000)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = throttle.throttle_batch(events, "k", "ts", "id", gap).withColumn("s", F.unix_seconds("ts"))
            assert rows(got, "k", "s", "id") == throttled(data, gap)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    assert max(r["count"] for r in tables[0].groupBy("_part").count().collect()) <= 300


def test_throttle_stream_goes_on_from_its_clocks(spark, monkeypatch):
    """Triggers of random sizes give what one run over all events gives; a busy resource is cut into ranges."""
    monkeypatch.setattr(throttle, "ROWS", 200)
    monkeypatch.setattr(throttle, "FAN", 3)
    rng = random.Random(4)
    for gap, span in ((7, 4000), (500, 4000), (9000, 4000)):
        data = sorted(("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 9)}", rng.randint(0, span), i) for i in range(3000))
        data.sort(key=lambda r: r[1])
        data += [(None, 1, -1), ("hot", None, -2)]
        path, cuts = f"{scale.shared_folder(spark)}/throttle-{uuid.uuid4().hex}", [0, 1, 1700, 2500, len(data)]
        for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            # events of one time stay in one trigger, as order inside a time decides
            while b < 3000 and data[b][1] == data[b - 1][1]:
                b += 1
            while 0 < a < 3000 and data[a][1] == data[a - 1][1]:
                a += 1
            events = spark.createDataFrame(data[a:b], "k string, s long, id long").withColumn("ts", F.timestamp_seconds("s"))
            for _ in range(1 + n % 2):             # a repeated trigger changes nothing
                throttle.throttle_trigger(events, n, path, "k", "ts", "id", gap, ttl_seconds=None)
        got = rows(throttle.passed_events(spark, path).withColumn("s", F.unix_seconds("ts")), "k", "s", "id")
        assert got == throttled(data, gap)


def test_throttle_forgets_silent_resources(spark):
    path = f"{scale.shared_folder(spark)}/throttle-{uuid.uuid4().hex}"
    for n, data in enumerate(([("a", 0, 0), ("b", 1000, 1)], [("b", 2000, 2)], [("a", 2001, 3), ("a", 2500, 4)])):
        events = spark.createDataFrame(data, "k string, s long, id long").withColumn("ts", F.timestamp_seconds("s"))
        throttle.throttle_trigger(events, n, path, "k", "ts", "id", 10, ttl_seconds=1500)
    # the clock of a was dropped at 2000, so 2001 starts it anew
    assert rows(throttle.passed_events(spark, path), "id") == [(2,), (4,)]


def test_composed_steps_are_the_steps_of_both_ranges():
    rng = random.Random(9)
    for _ in range(500):
        gap = rng.choice([1, 5, 30, 200])
        times = np.array(sorted(rng.randrange(300) for _ in range(rng.randrange(3, 60))), np.int64)
        cut = sorted(rng.sample(range(1, len(times)), 2))
        parts = [times[:cut[0]], times[cut[0]:cut[1]], times[cut[1]:]]
        steps = []
        for k, part in enumerate(parts):
            now = throttle._Steps(int(part[0]), gap, k > 0)
            now.add(part)
            steps.append((now.bounds, now.ends))
        all_ = throttle._composed(throttle._composed(steps[0], steps[1], gap), steps[2], gap)
        also = throttle._composed(steps[0], throttle._composed(steps[1], steps[2], gap), gap)
        passed = throttle._passed(times, int(times[0]), gap)
        want = int(times[passed[-1]]) if passed else int(times[0])
        for f in (all_, also):
            assert int(throttle._stepped(*f, throttle.NEVER, gap)) == want


def test_inventory_of_a_mixed_course(spark):
    paths = ["a.pdf", "b.pptx", "c.docx", "d.xlsx", "e.xlsm", "f.csv", "g.txt", "h.bin", "_meta/stats.json"]
    df = spark.createDataFrame([("c", p, 1) for p in paths], "course_id string, path string, size long")
    row = reports.source_inventory(classify.classify_sources(df)).first()
    assert (row["total_source_files"], row["supported_files"], row["unsupported_files"], row["lecturer_material_candidates"],
            row["metadata_files"]) == (9, 7, 1, 7, 1)


# --- nothing is cut, no step is limited -------------------------------------------

def test_rows_with_line_ends_in_cells(spark):
    import csv
    import io
    text = 'id,"na""me",x\r\n1,"line one\nline two",5" pipe\r\n\r\n2,"a,b"tail,"open\nend'
    want = [(i, " | ".join(f"column {k}: {v.strip()}" for k, v in enumerate(r, 1) if v.strip()))
            for i, r in enumerate(csv.reader(io.StringIO(text.replace("\r\n", "\n"))), 1) if any(r)]
    got = files.csv_units(spark.createDataFrame([("c", "s", text)], "course_id string, source_id string, text string"))
    assert rows(got, "unit_no", "text") == want
    many = spark.range(1).select(F.lit("c").alias("course_id"), F.lit("s").alias("source_id"),
                                 F.array_join(F.transform(F.sequence(F.lit(1), F.lit(50_003)), lambda i: F.concat(i.cast("string"), F.lit(",x"))), "\n").alias("text"))
    assert files.csv_units(many).agg(F.count("*"), F.max("unit_no")).first() == (50_003, 50_003)
    assert files.row_units(spark.range(50_003).withColumn("n", F.col("id") + 1), ["id"], "n").count() == 50_003


def test_redaction_keeps_the_length(spark):
    from studycorpus.operators.redact import redact_text
    for profile in ("log", "crawl", "pipeline", "path"):
        assert one(spark, "word " * 400 + "token=abc", F.length(redact_text("v", profile))) > 2000


def test_deep_graphs_and_long_chains(spark):
    from studycorpus.operators import crawl
    edges = spark.createDataFrame([("s", f"n{i}", f"n{i + 1}") for i in range(12)], "scope string, src string, dst string")
    seeds = spark.createDataFrame([("s", "n0")], "scope string, node string")
    assert crawl.reachable(edges, seeds).count() == 13
    assert crawl.reachable(edges, seeds, max_depth=4).filter("state = 'max_depth'").count() == 1
    chain = [("c", i, i, 0.7 + i / 10_000) for i in range(1200)] + [("c", i, i + 1, 0.7 + i / 10_000 + 0.00005) for i in range(1200)]
    pairs = spark.createDataFrame(chain, "course_id string, left_id long, right_id long, similarity double")
    costs = spark.range(1202).select(F.lit("c").alias("course_id"), F.col("id").alias("source_id"), F.lit(1).alias("cost"))
    want, taken_l, taken_r = [], set(), set()
    for _, a, b, s in sorted(chain, key=lambda p: (-p[3], p[1], p[2])):
        if a not in taken_l and b not in taken_r:
            want.append((b, a))
            taken_l.add(a)
            taken_r.add(b)
    for limit in (200_000, 1):
        if limit == 1:                               # rounds alone, on a short chain
            pairs, want = pairs.filter("left_id < 8"), None
        got = rows(similarity.pick_representatives(pairs, costs, group_pairs=limit), "source_id", "represented_by")
        assert want is None and len(got) == 8 or got == sorted(want)


def test_one_token_in_every_text(spark, monkeypatch):
    monkeypatch.setattr(similarity, "ROWS_PER_CELL", 3)
    texts = [(i, "ab"[i % 2], f"all w{i // 2} x{i // 2}") for i in range(60)]
    docs = spark.createDataFrame(texts, "id long, side string, text string").withColumn("course_id", F.lit("c"))
    got = similarity.near_duplicate_pairs(docs, "id", "text", "side", "a", "b")
    assert rows(got, "left_id", "right_id") == [(i, i + 1) for i in range(0, 60, 2)]


def test_same_ids_in_two_courses(spark):
    pages = spark.createDataFrame([(c, s, p, 7 * p + (c == "b") * (s == "r") * 255) for c in "ab" for s in "lr" for p in range(3)],
                                  "course_id string, source_id string, page_no int, hash long")
    pairs = spark.createDataFrame([("a", "l", "r"), ("b", "l", "r")], "course_id string, left_id string, right_id string")
    assert rows(visual.visual_equivalence(pages, pairs, 0), "course_id", "left_count", "verdict") == [("a", 3, "FULL_EQUIVALENCE"), ("b", 3, "NOT_EQUIVALENT")]
    assert rows(visual.align_pages(pages, pairs), "course_id", "left_pages", "right_pages") == [("a", 3, 3), ("b", 3, 3)]
    features = spark.createDataFrame([("a", "s", 900, 0, 0), ("b", "s", 900, 1, 0)], "course_id string, source_id string, text_chars int, n_images int, n_drawings int")
    assert rows(visual.page_evidence(features), "course_id", "verdict") == [("a", "TEXT_DOMINANT"), ("b", "VISUAL_REQUIRED")]


@pytest.mark.parametrize("href", ["../x", "..", "../..", ".", "./", "a/../b", "/a/../b", "/a/./b/../../c", "../../../../../../x?y=../z", "a/b/c/../../../../d/..", "x#../y", "?q=1", "//h/p"])
def test_links_as_the_standard_says(spark, href):
    from urllib.parse import urljoin
    base = "https://host.example/one/two/three/four/five/page.html"
    got = spark.createDataFrame([(base, href)], "b string, h string").select(U.resolve("b", "h")).first()[0]
    assert got == urljoin(base, href)


def test_content_inside_a_form():
    from studycorpus.functions import html
    page = '<body><form><main><nav><a href="n">no</a></nav><a href="y">yes</a><form><a href="f">f</a></form></main></form></body>'
    assert [link["href"] for link in html.page_links(page)] == ["y"]
    assert html.stored_text(b"<header>h</header><p>a<b>b</b></p><form>f</form>\xff") == "a\nb\n\ufffd"


def test_folding_does_not_cut_a_word(spark):
    assert one(spark, "İstanbul istanbul", T.tokens("v")) == ["i̇stanbul", "istanbul"]


def test_publications_of_one_moment(spark, tmp_path):
    import datetime
    now = datetime.datetime(2024, 1, 1)
    for k in range(4):
        manifests.publish_if_valid({"t": spark.createDataFrame([("c", k)], "course_id string, v int")}, str(tmp_path),
                                   lambda t: t["t"].filter("false").selectExpr("course_id", "'error' as severity"), now=now)
    assert rows(manifests.read_current(spark, str(tmp_path), "t"), "v") == [(3,)]


def test_reach_keeps_links_in_place(spark, monkeypatch):
    """Against a breadth-first search, with hubs; no level moves the links or the visited nodes."""
    rng = random.Random(3)
    monkeypatch.setattr(scale, "HEAVY_MIN_ROWS", 20)
    links = [(s, rng.choice([0, 1, rng.randrange(60)]), rng.randrange(60)) for s in "ab" for _ in range(300)]
    edges = spark.createDataFrame(links, "scope string, src long, dst long")
    seeds = spark.createDataFrame([("a", 0), ("b", 7), ("b", 7)], "scope string, node long")
    closed = spark.createDataFrame([("a", 1)], "scope string, node long")
    want = {}
    for scope, seed in (("a", 0), ("b", 7)):
        level, depth = {seed}, 0
        while level:
            want.update({(scope, n): depth for n in level})
            level = {d for s, n, d in links if s == scope and n in level and (s, n) != ("a", 1) and (s, d) not in want}
            depth += 1
    plans, add = [], scale.Bucketed.add
    monkeypatch.setattr(scale.Bucketed, "add", lambda self, df, deal=False: plans.append(df._jdf.queryExecution().executedPlan().toString()) or add(self, df, deal))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r.scope, r.node): r.depth for r in crawl.reachable(edges, seeds, closed=closed).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == want
    for plan in plans[2:]:
        lines = plan.split("\n")
        scans = [i for i, line in enumerate(lines) if "Bucketed: true" in line]
        # links and the visited nodes of the anti join are read by bucket, with nothing but a sort and filters above
        assert len(scans) >= 2 and plan.count("Exchange hashpartitioning") == 2
    assert not spark.catalog.listTables(pattern="table_*")


def test_visual_originals_may_be_excused(spark):
    """Kept, represented by a known source, or excused by a stored text; each record is judged by its own row."""
    base = ("slide", "ready", [1], "Chapter 1", "chapter_01", 1)
    data = [("kept", "copy/a", None, None, "out/a"), ("lost", "copy/x", None, None, "out/b"), ("same", None, "OMIT_VERIFIED_DUPLICATE", "kept", "out/c"),
            ("same2", None, "OMIT_VERIFIED_DUPLICATE", "unknown", "out/d"), ("text", "copy/y", "MARKDOWN_SUFFICIENT", None, "out/e"),
            ("text2", "copy/z", "OMIT_BINARY_SIZE_BUDGET", None, "out/none"), ("never", None, None, None, "out/f"), ("never", None, None, None, "out/f")]
    records = spark.createDataFrame([("c", i, f"p/{i}", *base[:2], copy, out, decision, other, *base[2:]) for i, copy, decision, other, out in data],
                                    "course_id string, source_id string, source_path string, source_type string, status string, source_copy_path string, "
                                    "output_path string, retention_decision string, represented_by_source_id string, chapters array<int>, title string, `group` string, chapter int")
    chunks = spark.createDataFrame([("c", "kept", "k1", None, "1", "text")], "course_id string, source_id string, chunk_id string, chunk_path string, locator string, text string")
    stored = spark.createDataFrame([("c", p) for p in ("copy/a", *(f"out/{x}" for x in "abcdef"))], "course_id string, path string")
    found = validate.validate_corpus(records, chunks, stored)
    got = sorted(r.subject for r in found.filter("rule = 'copy_not_retained'").collect())
    assert got == ["p/lost", "p/never", "p/never", "p/same2", "p/text2"]
    assert [r.subject for r in found.filter("rule = 'ready_without_output'").collect()] == ["p/text2"]
    assert set(validate.SEVERITY) >= {r.rule for r in found.collect()}


def test_helper_columns_never_clash(spark):
    """Blocks for uneven keys keep columns that are named like their own."""
    names = ["_rn", "_salt", "_salts", "_part", "_v_n", "_t_n", "_o_n", "_k_k", "_b", "_v", "_t", "_o", "_w"]
    df = spark.range(40).select((F.col("id") % 3).alias("k"), F.col("id").alias("i"), *[F.concat(F.lit(f"{n} "), "id").alias(n) for n in names])
    right = df.groupBy("k").agg(F.count("*").alias("heavy"))
    outs = [scale.first_rows(df, ["k"], ["i"], 5), scale.lookup_join(df, right, ["k"]), scale.salted_join(df, right, ["k"], "heavy"),
            scale.running(df, ["k"], [F.col("i")], {"n": F.lit(1)}), scale.bucket_sums(df, ["k"], "i", F.lit(1), "sum", width=4)]
    for out in outs:
        assert set(df.columns) <= set(out.columns)
        for r in out.collect():
            assert all(r[n] == f"{n} {r.i}" for n in names)
    assert {(r.k, r.i, r.n) for r in outs[3].collect()} == {(i % 3, i, i // 3 + 1) for i in range(40)}
    assert {(r.k, r.i, r["sum"]) for r in outs[4].collect()} == {(i % 3, i, i // 3) for i in range(40)}


def texts_moved(df, column):
    """Exchanges of a plan whose rows carry a column."""
    def walk(node):
        children = [node.children().apply(i) for i in range(node.children().size())]
        mine = node.nodeName() == "Exchange" and column in [node.output().apply(i).name() for i in range(node.output().size())]
        return mine + sum(map(walk, children))
    plan = df._jdf.queryExecution().executedPlan()
    return walk(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)


def test_text_stays_put(spark):
    """Chunk counts move no text; rendered documents move it once and the rollup not again."""
    rows_ = [("c", f"Ch{i % 4 + 1}/{i:02}_doc{i}.pdf", 9, f"text of document {i} " * 30) for i in range(40)]
    files = spark.createDataFrame(rows_, "course_id string, path string, size long, body string")
    records = scale.checkpointed(corpus.build_records(files))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = corpus.chunk_counts(records, files)
        assert texts_moved(counts, "body") == 0 and counts.count() == 40
        assert texts_moved(reports.corpus_stats(records, counts), "body") == 0
        assert texts_moved(manifests.render_docs(records, corpus.bodies(files)), "body") == 1
        rollup = manifests.chapter_rollup(records, manifests.stored_docs(records, corpus.bodies(files)))
        assert sum(texts_moved(rollup, c) for c in ("text", "_doc_text")) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    path = f"{scale.shared_folder(spark)}/rollup-{uuid.uuid4().hex}"
    manifests.write_rollup(rollup, path)
    assert rows(spark.read.parquet(path), *rollup.columns) == rows(rollup, *rollup.columns)
    # each file holds its parts in reading order
    files_ = {}
    for r in spark.read.parquet(path).select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("at"), "group", "part_no").orderBy("at").collect():
        files_.setdefault(r.f, []).append((r.group, r.part_no))
    assert all(parts == sorted(parts) for parts in files_.values())


def test_unknown_hashes_on_both_sides_are_reused(spark):
    old = spark.createDataFrame([("c", "a", None), ("c", "b", "1"), ("c", "d", None)], "course_id string, logical_path string, sha256 string")
    new = spark.createDataFrame([("c", "a", None), ("c", "b", None), ("c", "e", None)], "course_id string, logical_path string, sha256 string")
    assert rows(refresh.source_changes(new, old), "logical_path", "change") == [("a", "reused"), ("b", "changed"), ("d", "removed"), ("e", "new")]


def test_ingest_reads_a_base_and_what_came_since(spark, monkeypatch):
    """Batches give the same corpus with and without bases, and read only the slots of their courses."""
    rng = random.Random(12)
    drops = [[(f"c{c}", f"n{rng.randrange(6)}.txt", 5, f"text {rng.randrange(3)} of course {c}".encode()) for c in rng.sample(range(5), 3) for _ in range(2)] for _ in range(3)]
    got = {}
    for compact in (2, 100):
        monkeypatch.setattr(ingest, "COMPACT", compact)
        path = f"{scale.shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
        for number, drop in enumerate(drops):
            batch = spark.createDataFrame(drop, "course_id string, path string, size long, content binary")
            for _ in range(1 + (number == 1)):          # a repeated batch, right where a base was written
                ingest.ingest_batch(batch, number, path)
        records, chunks = ingest.current_corpus(spark, path)
        got[compact] = rows(records, "course_id", "source_path", "status", "text_key"), rows(chunks, "course_id", "chunk_id", "text")
    assert got[2] == got[100]
    ingest.ingest_batch(spark.createDataFrame(drops[0], "course_id string, path string, size long, content binary"), 99, path)      # writes a base up to 99
    later = [("c1", "late.txt", 5, b"late")]
    ingest.ingest_batch(spark.createDataFrame(later, "course_id string, path string, size long, content binary"), 100, path)
    slot = spark.createDataFrame([("c1",)], "course_id string").select(ingest._slot()).first()[0]
    read = ingest._manifest(spark, path, 101, [slot])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in read
    latest = ingest._seen(spark, path, 101, [slot]).filter("course_id = 'c1' and logical_path = 'late.txt'")
    assert [r.batch for r in latest.collect()] == [100]
    assert all(int(re.search("batch=(\\d+)", f)[1]) == 100 for f in _files_of(ingest._manifest(spark, path, 101, [slot])) if "source_manifest" in f)


def _files_of(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
