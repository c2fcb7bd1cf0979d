"""Past exams: labels, inherited folder context, selection and reconciliation."""
from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as V, text as T
from ..plans import scale
from .tree import fold_paths


def token_text(label) -> Column:
    """`` tok tok tok `` form of a folded label: phrases are plain containment."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(T.fold(label), "[^a-z0-9]+", " ")), F.lit(" "))


def has_phrase(tokens: Column, phrases) -> Column:
    return T.any_contains(tokens, [f" {p} " for p in phrases])


def exam_type(tokens: Column, in_context: Column) -> Column:
    midterm = has_phrase(tokens, V.MIDTERM_PHRASES) & (in_context | has_phrase(tokens, V.MIDTERM_SURE))
    term_final = tokens.contains(" final ") & tokens.contains(" hk")
    final = has_phrase(tokens, V.FINAL_PHRASES) & (in_context | has_phrase(tokens, V.FINAL_SURE) | term_final)
    return F.when(midterm, "midterm").when(final, "final").when(in_context, "unknown_exam")


def exam_term(label, tokens: Column, in_context: Column) -> Column:
    years = F.replace(F.regexp_extract(T.fold(label), f"({V.TERM_YEARS})", 1), F.lit(" "), F.lit(""))
    value = F.when(years != "", years).otherwise(F.upper(F.regexp_extract(tokens, V.TERM_TOKEN, 1)))
    return F.when(value.startswith("HK") | value.startswith("20") | in_context, value).otherwise("")


def classify_exams(df: DataFrame, name: str, in_context: str | None = None) -> DataFrame:
    context = F.coalesce(F.col(in_context), F.lit(False)) if in_context else F.lit(False)
    return (df.withColumn("_tokens", token_text(name))
              .withColumn("exam_type", exam_type(F.col("_tokens"), context))
              .withColumn("term", exam_term(name, F.col("_tokens"), context)).drop("_tokens"))


def variant_of(name, inherited: Column) -> Column:
    folded = T.fold(name)
    return (F.when(T.any_contains(folded, V.OFFICIAL_WORDS), "official")
             .when(T.any_contains(folded, V.SAMPLE_WORDS), "sample").otherwise(inherited))


_NODE = ["root_id", "node_id", "parent_id", "name", "is_folder"]


def _label(path_label: str, name: str) -> Column:
    return F.concat_ws(" ", path_label, name)


def _below(path_label: str, name: str) -> Column:
    return F.concat_ws("/", F.nullif(path_label, F.lit("")), F.col(name))


def _one_parent(nodes: DataFrame, max_depth: int | None) -> DataFrame:
    """The rows of trees in which a node has several parents, one parent a folder: the one by which
    it is entered first, at the smallest depth, then by the smallest id. Walked by levels."""
    key = ["root_id", "node_id"]
    roots = nodes.filter(F.col("parent_id").isNull())
    frontier = roots.filter("is_folder").withColumn("path_label", F.lit(""))
    frontier = frontier.withColumn("context", has_phrase(token_text(_label("path_label", "name")), V.EXAM_CONTEXT))
    frontier = scale.checkpointed(frontier.select(*key, "path_label", "context"))
    visited, met_rows = frontier.select(*key), [roots.select(*_NODE, F.lit(0).alias("_level"), F.lit(True).alias("_entered"))]
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        parents = frontier.select("root_id", F.col("node_id").alias("parent_id"), F.col("path_label").alias("_up"), F.col("context").alias("_context"))
        met = nodes.join(parents, ["root_id", "parent_id"]).withColumn("path_label", _below("_up", "name"))
        level = scale.first_rows(met, key, ["parent_id"]).join(visited, key, "left_anti").withColumn("_tokens", token_text(_label("path_label", "name")))
        level = scale.checkpointed(level.withColumn("context", F.col("_context") | has_phrase(F.col("_tokens"), V.EXAM_CONTEXT))
                                        .withColumn("_entered", F.col("is_folder") & (F.col("context") | T.any_contains(F.col("_tokens"), V.PARENT_FOLDER_HINTS))))
        if level.isEmpty():
            break
        met_rows.append(level.select(*_NODE, F.lit(depth).alias("_level"), "_entered"))
        frontier = level.filter("_entered").select(*key, "path_label", "context")
        visited = visited.unionByName(frontier.select(*key))
    met = reduce(DataFrame.unionByName, met_rows)
    folders = scale.first_rows(met.filter("is_folder"), key, [F.col("_entered").desc(), "_level", "parent_id"])
    return folders.select(*_NODE).unionByName(met.filter("not is_folder").select(*_NODE))


def _pop_key(steps: Column) -> Column:
    """Sort key of a best-first walk that takes the least priority first and, of one priority, what
    was found first.

    Priorities are 0 (the name tells an exam type), 1 (exam context) and 3. Whatever a folder of
    priority 3 leads to by smaller ones is taken before the next 3, and likewise for 1, so the walk
    is breadth-first over 3-parts, inside them over 1-parts, inside those over folders. Breadth
    first is the order by (number of steps, the steps), and a step to a part is where it left the
    part before. All numbers have one width, so the keys compare as lists of strings.
    """
    def number(n: Column) -> Column:
        return F.array(F.lpad(n.cast("string"), 9, "0"))

    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("n3"), none.alias("c3"), F.lit(0).alias("n1"), none.alias("c1"), F.lit(0).alias("n0"), none.alias("c0"),
                     F.lit(False).alias("context"))

    def step(s: Column, x: Column) -> Column:
        context = s["context"] | x["context"]
        ends = F.concat(number(s["n0"]), s["c0"], F.array(x["order"]))
        priority = F.when(x["typed"], 0).when(context, 1).otherwise(3)
        zero, one = priority == 0, priority == 1
        return F.struct(
            F.when(priority == 3, s["n3"] + 1).otherwise(s["n3"]).alias("n3"),
            F.when(priority == 3, F.concat(s["c3"], number(s["n1"]), s["c1"], ends)).otherwise(s["c3"]).alias("c3"),
            F.when(zero, s["n1"]).when(one, s["n1"] + 1).otherwise(0).alias("n1"),
            F.when(zero, s["c1"]).when(one, F.concat(s["c1"], ends)).otherwise(none).alias("c1"),
            F.when(zero, s["n0"] + 1).otherwise(0).alias("n0"),
            F.when(zero, F.concat(s["c0"], F.array(x["order"]))).otherwise(none).alias("c0"),
            context.alias("context"))

    return F.aggregate(steps, start, step, lambda s: F.concat(number(s["n3"]), s["c3"], number(s["n1"]), s["c1"], number(s["n0"]), s["c0"]))


def _composed(upper: Column, lower: Column) -> Column:
    """Two stretches of a path as one. ``open`` tells whether all folders of a stretch are entered
    if it is met without exam context, ``open_in`` if it is met with it."""
    return F.struct((upper["context"] | lower["context"]).alias("context"),
                    (upper["open"] & F.when(upper["context"], lower["open_in"]).otherwise(lower["open"])).alias("open"),
                    (upper["open_in"] & lower["open_in"]).alias("open_in"),
                    F.coalesce(lower["variant"], upper["variant"]).alias("variant"), F.concat(upper["steps"], lower["steps"]).alias("steps"))


def exam_context(tree_nodes: DataFrame, max_depth: int | None = None, max_nodes: int | None = None) -> DataFrame:
    """Walk folder trees, inheriting exam context and variant.

    ``tree_nodes``: root_id, node_id, parent_id (null at the root), name, is_folder.
    Result: one row per visited node with ``state``: enumerated, exam,
    unsupported_item, skipped_non_exam_folder, depth_limit or node_limit. Files without an
    exam type give no row. Without ``max_depth`` every folder is entered; with it,
    folders at that depth are reported and not entered. ``max_nodes`` is the budget of a
    root: its folders are opened best-first (names with an exam type, then exam
    context, then the rest; first found, first opened, in the order of context and node id),
    and the folders that wait when the budget is used up are reported with ``node_limit``.

    Labels, context, variant and pruning are composed along the paths by pointer doubling, so a
    deep chain of folders takes as many rounds as the logarithm of its depth. Only trees in
    which a folder has several parents are walked by levels first, to choose one of them.
    """
    key = ["root_id", "node_id"]
    nodes = scale.checkpointed(tree_nodes.select(*_NODE))
    many = nodes.filter("is_folder").groupBy(*key).count().filter("count > 1").select("root_id").distinct()
    tangled = scale.checkpointed(many)
    if not tangled.isEmpty():
        rest = nodes.join(tangled, "root_id", "left_anti")
        nodes = scale.checkpointed(rest.unionByName(_one_parent(nodes.join(tangled, "root_id", "left_semi"), max_depth)))

    folders = nodes.filter("is_folder")
    is_root = F.col("parent_id").isNull()
    named = folders.withColumn("path_label", F.when(is_root, F.lit("")).otherwise(F.col("name")))
    paths = fold_paths(named, "root_id", "node_id", "parent_id", lambda up, down: F.concat_ws("/", F.nullif(up, F.lit("")), down), "path_label", max_depth)
    labelled = folders.join(paths, key).withColumn("_tokens", token_text(_label("path_label", "name")))
    labelled = (labelled.withColumn("_own", has_phrase(F.col("_tokens"), V.EXAM_CONTEXT))
                        .withColumn("_hint", T.any_contains(F.col("_tokens"), V.PARENT_FOLDER_HINTS))
                        .withColumn("_variant", variant_of("name", F.lit(None).cast("string"))))
    typed = exam_type(token_text("name"), F.lit(False)).isNotNull()
    order = F.when(is_root, F.col("node_id").cast("string")).otherwise(F.concat(F.when(F.col("_own"), "0").otherwise("1"), F.col("node_id").cast("string")))
    step = F.struct((typed | is_root).alias("typed"), F.col("_own").alias("context"), order.alias("order"))
    steps = F.array(step) if max_nodes is not None else F.array().cast("array<struct<typed:boolean,context:boolean,order:string>>")
    labelled = scale.checkpointed(labelled.withColumn("value", F.struct(
        F.col("_own").alias("context"), (is_root | F.col("_own") | F.col("_hint")).alias("open"), F.lit(True).alias("open_in"),
        F.col("_variant").alias("variant"), steps.alias("steps"))))
    folded = fold_paths(labelled, "root_id", "node_id", "parent_id", _composed, "value", max_depth)
    met = folded.select(*key, "depth", "value.*").withColumn("variant", F.coalesce("variant", F.lit("unknown")))
    met = scale.checkpointed(labelled.select(*_NODE, "path_label").join(met, key).withColumn(
        "entered", F.col("open") & (F.lit(True) if max_depth is None else F.col("depth") < max_depth)))

    # what is found in the folders that are entered, and the roots
    parents = met.filter("entered").select("root_id", F.col("node_id").alias("parent_id"), F.col("context").alias("folder_context"),
                                           F.col("variant").alias("_inherited"), F.col("path_label").alias("_up"), F.col("depth").alias("_at"))
    below = scale.lookup_join(met.filter(~is_root), parents, ["root_id", "parent_id"], "inner")
    found = below.withColumn("exam_variant", F.when(F.col("open"), F.col("variant")).otherwise(F.col("_inherited"))).unionByName(
        met.filter(is_root).withColumn("exam_variant", F.col("variant")), allowMissingColumns=True)
    limit = F.lit(False) if max_depth is None else F.col("depth") == max_depth
    state = F.when(~F.col("open"), "skipped_non_exam_folder").when(limit & ~is_root, "depth_limit").otherwise("enumerated")
    out_cols = [*key, "depth", "name", "path_label", "state", "exam_type", "term", "exam_variant"]
    folder_rows = found.withColumn("state", state).withColumn("exam_type", F.lit(None).cast("string")).withColumn("term", F.lit(""))

    files = nodes.filter("not is_folder")
    inner = (scale.lookup_join(files.filter(~is_root), parents, ["root_id", "parent_id"], "inner")
                  .withColumn("path_label", _below("_up", "name")).withColumn("depth", F.col("_at") + 1).withColumn("exam_variant", F.col("_inherited")))
    outer = (files.filter(is_root).withColumn("path_label", F.lit("")).withColumn("depth", F.lit(0))
                  .withColumn("folder_context", has_phrase(token_text(_label("path_label", "name")), V.EXAM_CONTEXT))
                  .withColumn("exam_variant", variant_of("name", F.lit("unknown"))))
    columns = [*_NODE, "path_label", "depth", "folder_context", "exam_variant"]
    rows = inner.select(*columns).unionByName(outer.select(*columns)).withColumn("_tokens", token_text(_label("path_label", "name")))
    # a file takes the context of its folder, not of its own name
    inherited = F.col("folder_context")
    rows = (rows.withColumn("exam_type", exam_type(F.col("_tokens"), inherited)).filter(F.col("exam_type").isNotNull())
                .withColumn("state", F.when(T.suffix("name").isin(*V.EXAM_SUFFIXES), "exam").otherwise("unsupported_item"))
                .withColumn("term", exam_term(_label("path_label", "name"), F.col("_tokens"), inherited)))
    if max_nodes is None:
        return folder_rows.select(*out_cols).unionByName(rows.select(*out_cols))

    # the first ``max_nodes`` of each root in the order of the walk; a folder comes behind its parent
    file_step = F.array(F.struct(F.lit(True).alias("typed"), F.lit(False).alias("context"), F.col("node_id").cast("string").alias("order")))
    queue = (found.filter("open").select(*key, _pop_key(F.col("steps")).alias("_key"))
                  .unionByName(files.filter(is_root).select(*key, _pop_key(file_step).alias("_key"))))
    popped = scale.checkpointed(scale.first_rows(queue, ["root_id"], ["_key", "node_id"], max_nodes).select(*key))
    opened = popped.select("root_id", F.col("node_id").alias("parent_id"))

    def reached(df: DataFrame) -> DataFrame:
        return df.filter(~is_root).join(opened, ["root_id", "parent_id"], "left_semi").unionByName(df.filter(is_root))

    taken = popped.withColumn("_popped", F.lit(True))
    folder_rows = reached(folder_rows).join(taken, key, "left").withColumn(
        "state", F.when(F.col("open") & F.col("_popped").isNull(), "node_limit").otherwise(F.col("state")))
    rows = reached(rows).join(taken, key, "left").filter(F.col("_popped").isNotNull() | ~is_root)
    waiting = (files.filter(is_root).join(popped, key, "left_anti").withColumn("depth", F.lit(0)).withColumn("path_label", F.lit(""))
                    .withColumn("state", F.lit("node_limit")).withColumn("exam_type", F.lit(None).cast("string")).withColumn("term", F.lit(""))
                    .withColumn("exam_variant", variant_of("name", F.lit("unknown"))))
    return reduce(DataFrame.unionByName, [t.select(*out_cols) for t in (folder_rows, rows, waiting)])


def exam_candidates(walk: DataFrame) -> DataFrame:
    """Exam files of a walk; the last one of a stable id stays."""
    return scale.first_rows(walk.filter(F.col("state") == "exam").withColumn("original_name", T.safe_name("name", 150)),
                            ["root_id", "node_id"], [F.col("depth").desc()])


def select_exams(assets: DataFrame, budget: int = V.EXAM_BYTES) -> DataFrame:
    """Decision per asset: kept, over_budget or over_limit.

    Two best per type by (variant, newest term, extracted first, smaller), then
    midterms before finals while they fit the byte budget. A pick that does not
    fit is not replaced. At most four rows per course are ever brought together.
    """
    variant = F.when(F.col("exam_variant") == "official", 0).when(F.col("exam_variant") == "sample", 1).otherwise(2)
    newest = -F.coalesce(F.regexp_replace("term", r"\D", "").try_cast("long"), F.lit(0))
    unread = F.when(F.col("extraction_status") == "text_extracted", 0).otherwise(1)
    typed = assets.filter(F.col("exam_type").isin("midterm", "final"))
    best = scale.first_rows(typed, ["course_id", "exam_type"],
                            [variant, newest, unread, F.col("size"), F.col("stable_id")], V.EXAMS_PER_TYPE, "_rank")
    picks = best.groupBy("course_id").agg(F.array_sort(F.collect_list(F.struct(
        F.when(F.col("exam_type") == "midterm", 0).otherwise(1).alias("turn"), F.col("_rank").alias("rank"),
        F.col("stable_id"), F.col("size").cast("long").alias("size")))).alias("picks"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<stable_id:string,fits:boolean>>")
                     .alias("rows"))

    def take(state: Column, p: Column) -> Column:
        fits = (state["used"] + p["size"] <= budget) & (F.size(F.filter(state["rows"], lambda r: r["fits"])) < V.EXAMS_KEPT)
        row = F.struct(p["stable_id"].cast("string").alias("stable_id"), fits.alias("fits"))
        return F.struct((state["used"] + F.when(fits, p["size"]).otherwise(0)).alias("used"),
                        F.concat(state["rows"], F.array(row)).alias("rows"))

    judged = (picks.select("course_id", F.explode(F.aggregate("picks", start, take, lambda s: s["rows"])).alias("r"))
                   .select("course_id", F.col("r.stable_id").alias("stable_id"), F.col("r.fits").alias("_fits")))
    return (assets.join(judged, ["course_id", "stable_id"], "left")
                  .withColumn("decision", F.when(F.col("_fits"), "kept").when(F.col("_fits") == False, "over_budget")  # noqa: E712
                              .otherwise("over_limit")).drop("_fits"))


def reconcile_exams(prior: DataFrame, new: DataFrame, completeness: DataFrame) -> DataFrame:
    """The new set replaces the old one only where discovery was complete and
    every download worked; complete and empty wipes, anything else keeps."""
    done = completeness.select("course_id", (F.col("complete") & (F.col("failed_downloads") == 0)).alias("_done"))
    kept = scale.lookup_join(prior, done, ["course_id"]).filter(~F.coalesce(F.col("_done"), F.lit(False)))
    fresh = scale.lookup_join(new, done, ["course_id"]).filter(F.coalesce(F.col("_done"), F.lit(False)))
    return kept.unionByName(fresh).drop("_done")


def discovery_report(states: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per root: events, completeness and the stage at which the walk stopped.

    ``states``: root_id, state (one row per event). ``candidates``: root_id.
    """
    def order_of(names) -> Column:
        out = F.when(F.col("state") == names[0], 0)
        for i, n in enumerate(names[1:], 1):
            out = out.when(F.col("state") == n, i)
        return out

    def named(index: Column, names, default: str) -> Column:
        return F.coalesce(F.try_element_at(F.array(*map(F.lit, names)), index + 1), F.lit(default))

    per = states.groupBy("root_id").agg(F.count("*").alias("events"), F.min(order_of(V.INCOMPLETE_STATES)).alias("_bad"),
                                        F.min(order_of(V.EMPTY_STAGES)).alias("_empty"))
    found = candidates.groupBy("root_id").agg(F.count("*").alias("candidates"))
    rows = per.join(found, "root_id", "left").na.fill(0, ["candidates"])
    stage = (F.when(F.col("_bad").isNotNull(), named(F.col("_bad"), V.INCOMPLETE_STATES, "partial_discovery"))
              .when(F.col("candidates") == 0, named(F.col("_empty"), V.EMPTY_STAGES, "no_exam_candidates"))
              .otherwise("completed"))
    return rows.select("root_id", "events", "candidates", F.col("_bad").isNull().alias("complete"), stage.alias("stage"))


def state_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("root_id", "state").agg(F.count("*").alias("n"))
