"""Benchmark decontamination by winnowed fingerprints, in DataFrame functions only.

Words are lower-cased (A-Z) and consist of digits, letters and everything beyond ASCII. A window
is ``window`` consecutive words of an item, or all words of an item that has fewer. A word of
a document is hit if it lies in an occurrence of any window.

Winnowing. The fingerprint of a window is the least hash among its k-grams of ``GRAM`` words.
A document keeps a fingerprint where it differs from that of the window before, and once in
``window - GRAM + 1`` windows at least. As equal windows have equal fingerprints, every shared
span of ``window`` words is found. Windows of short items are all kept by the hash of all their words.

Kept fingerprints meet those of the items in the scan stage, and each hit is extended there over
the windows that the kept one stands for, by SHA-256 of their words. So no text is shuffled,
only the rows of hits. The windows of the items are dealt into slices of about ``SLICE`` windows by
their fingerprint; a slice has 60 bytes a window, is broadcast, and takes one pass over the
documents. A benchmark of up to ``SLICE`` windows (2,000 items of 100 words) takes one.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from studycorpus.llm.base import checkpointed, text_of

WINDOW, GRAM = 10, 5
SLICE = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"       # fixed by the definition of words: what separates them


def words_of(text: Column) -> Column:
    """Splitting is many times faster than extracting; the first and last part may be empty."""
    return F.split(F.translate(text, UPPER, LOWER), BETWEEN)


def _without_ends(parts: Column) -> Column:
    first = F.when(F.get(parts, 0) == "", 1).otherwise(0)
    last = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.slice(parts, first + 1, F.size(parts) - first - last)


def _gram(at: Column, k: int) -> Column:
    """Hash of the ``k`` words from place ``at`` (0 is the first) of the column ``h`` of word hashes."""
    return F.xxhash64(*[F.get("h", at + j) for j in range(k)])


def _whole(at: Column, size: Column) -> Column:
    """The window's words as 32 bytes."""
    return F.unhex(F.sha2(F.array_join(F.slice("words", at + 1, size), " "), 256))


def _fingerprinted(rows: DataFrame, window: int) -> DataFrame:
    """Adds ``h`` (word hashes) and ``m`` (fingerprint of each window) to rows with split ``words``.
    Each step is a projection of its own, so that nothing is worked out twice."""
    span = window - GRAM + 1
    rows = rows.withColumn("words", _without_ends(F.col("words"))).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.size("h")
    grams = F.when(n >= window, F.transform(F.sequence(F.lit(0), n - GRAM), lambda i: _gram(i, GRAM))).otherwise(F.array().cast("array<bigint>"))
    least = F.when(n >= window, F.transform(F.sequence(F.lit(0), n - window), lambda i: F.least(*[F.get("g", i + j) for j in range(span)])))
    return rows.withColumn("g", grams).withColumn("m", F.coalesce(least, F.array().cast("array<bigint>"))).drop("g")


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """``(windows, sets)``: the distinct windows ``t`` (words), ``fp``, ``whole``, ``set``, and which
    items a set names: ``set, item``. Windows that occur in the same items share a set."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(text_of(text_col)).alias("words"))
    rows = _fingerprinted(rows, window).filter(F.size("words") > 0).withColumn("t", F.least(F.size("words"), F.lit(window)))
    at = F.col("at")
    short = reduce(lambda other, t: F.when(F.col("t") == t, _gram(at, t)).otherwise(other), range(1, window), F.lit(None).cast("long"))
    each = (rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("t"))))
                .select("item", "t", F.when(F.col("t") == window, F.get("m", at)).otherwise(short).alias("fp"), _whole(at, F.col("t")).alias("whole")))
    each = checkpointed(each.distinct())
    windows = (each.groupBy("t", "fp", "whole")
                   .agg(F.count("*").alias("n"), F.min("item").alias("first"), F.sum(F.xxhash64("item").cast("decimal(38,0)")).alias("sum"))
                   .select("t", "fp", "whole", F.xxhash64("n", "first", "sum").alias("set")))
    windows = checkpointed(windows)
    sets = each.join(windows.select(F.col("whole").alias("w"), "set"), F.col("whole") == F.col("w")).select("set", "item").distinct()
    return windows, checkpointed(sets)


def _hits(docs: DataFrame, windows: DataFrame, window: int, lengths: list[int], header: bool) -> DataFrame:
    """Rows ``key, id, n, s, e, set`` of the occurrences of some windows; with ``header`` also a
    row for each document whose ``s`` is null. ``docs`` has ``key, id, words, h, m``."""
    span = window - GRAM + 1
    at, n = F.col("at"), F.size("words")
    is_header = F.col("at") < 0
    kept = docs.withColumn("at", F.explode(F.sequence(F.lit(-1), F.greatest(n - min([window, *lengths]), F.lit(-1)))))
    fp = F.get("m", at)                                  # null behind the last window
    long_ = F.when((at % span == 0) | (fp != F.get("m", at - 1)), fp)
    if lengths:
        kinds = [F.struct(F.lit(window).alias("t"), long_.alias("fp"))]
        kinds += [F.struct(F.lit(t).alias("t"), F.when(at <= n - t, _gram(at, t)).alias("fp")) for t in lengths]
        none = F.array(F.struct(F.lit(window).alias("t"), F.lit(None).cast("long").alias("fp")))
        kept = kept.withColumn("kind", F.explode(F.when(is_header, none).otherwise(F.array(*kinds)))).select("*", "kind.t", "kind.fp")
    else:
        kept = kept.select("*", F.lit(window).alias("t"), F.when(is_header, F.lit(None)).otherwise(long_).alias("fp"))
    kept = kept.filter(F.col("fp").isNotNull() | (is_header if header else F.lit(False)))
    marks = windows.select(F.col("t").alias("t1"), F.col("fp").alias("fp1")).distinct()
    met = kept.join(F.broadcast(marks), (F.col("t") == F.col("t1")) & (F.col("fp") == F.col("fp1")), "left")
    met = met.filter(is_header | F.col("fp1").isNotNull())
    last = F.when(F.col("t") == window, F.least(at + span - 1, n - window)).otherwise(at)
    each = met.withColumn("s", F.explode(F.sequence(at, F.when(is_header, at).otherwise(last))))
    each = each.select("key", "id", n.cast("long").alias("n"), "s", "t", F.when(F.col("s") >= 0, _whole(F.col("s"), F.col("t"))).alias("whole"))
    full = windows.select(F.col("whole").alias("w"), "set")
    rows = each.join(F.broadcast(full), F.col("whole") == F.col("w"), "left").filter((F.col("s") < 0) | F.col("w").isNotNull())
    return rows.select("key", "id", "n", F.when(F.col("s") >= 0, F.col("s")).alias("s"), (F.col("s") + F.col("t")).alias("e"), "set")


def _covered(spans: Column) -> Column:
    """How many words the spans of a sorted array cover."""
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("reach"))
    return F.aggregate(spans, start, lambda a, x: F.struct(
        (a["words"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["reach"]))).alias("words"), F.greatest(a["reach"], x["e"]).alias("reach")),
        lambda a: a["words"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, slice_rows: int = SLICE) -> DataFrame:
    """Per document ``id_col``, ``n_words``, ``n_hit`` (words in occurrences of windows), ``n_items``
    (items with occurring windows), ``items`` (their ids as sorted strings, joined by commas), ``contaminated``.

    Null and empty texts have no words: such a document is clean, such an item has no window.
    Items may repeat; an item without id counts as one item whose id is the empty string. Each
    row of ``docs`` gives one row, also where ids are null or repeat. Texts that are equal are
    worked on where they stand, and share a result. Other columns are not read.
    """
    if window <= GRAM:
        raise ValueError(f"a window has more than {GRAM} words")
    windows, sets = item_windows(items, item_id, item_text, window)
    lengths = sorted(r[0] for r in windows.select("t").distinct().collect() if r[0] < window)       # fewer than ``window`` numbers
    slices = max(1, -(-windows.count() // slice_rows))
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("key"), words_of(text).alias("words"))
    rows = _fingerprinted(rows, window)
    passes = [_hits(rows, windows.filter(F.pmod(F.xxhash64("fp"), F.lit(slices)) == i), window, lengths, i == 0) for i in range(slices)]
    found = checkpointed(reduce(DataFrame.unionAll, passes))

    spans = found.filter("s is not null")
    hit = spans.select("key", "s", "e").distinct().groupBy("key").agg(_covered(F.array_sort(F.collect_list(F.struct("s", "e")))).alias("n_hit"))
    named = spans.select("key", "set").distinct().join(sets.withColumnRenamed("set", "set1"), F.col("set") == F.col("set1")).select("key", "item").distinct()
    named = named.groupBy("key").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    result = checkpointed(hit.join(named.withColumnRenamed("key", "key1"), F.col("key") == F.col("key1")).select(F.col("key").alias("k"), "n_hit", "n_items", "items"))
    heads = found.filter("s is null").select("key", "id", "n")
    # one row per text on the right; few texts are contaminated, so mostly it is broadcast
    out = heads.join(result, F.col("key") == F.col("k"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_words"), F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long")).alias("n_hit"),
                      F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items", F.lit("")).alias("items"),
                      F.col("k").isNotNull().alias("contaminated"))
