"""What moves: texts are cut, filtered and numbered without travelling more than once."""
import hashlib
import random
import uuid

from pyspark.sql import functions as F

from studycorpus.plans import corpus, extract, scale
from studycorpus.streaming import ingest


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def exchanges(df, *columns):
    """Exchanges of a plan whose rows carry one of the columns."""
    def walk(node):
        names = {node.output().apply(i).name() for i in range(node.output().size())}
        kids = node.children()
        return (node.nodeName() == "Exchange" and bool(names & set(columns))) + sum(walk(kids.apply(i)) for i in range(kids.size()))

    plan = df._jdf.queryExecution().executedPlan()
    return walk(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)


def some_files(spark, n=40):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "\n\n"]
    data = [(f"c{i % 3}", f"Notes/{i}.txt", 9, " ".join(rng.choice(words) for _ in range(rng.choice([0, 5, 60, 3000])))) for i in range(n)]
    return spark.createDataFrame(data, "course_id string, path string, size long, body string")


def test_chunks_without_texts_move_no_text(spark):
    """Same chunks, with a mark in place of the text, and no exchange of bodies or pieces."""
    files = some_files(spark)
    records = corpus.build_records(files)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole, marks = corpus.build_chunks(records, files), corpus.build_chunks(records, files, texts=False)
        assert exchanges(marks, "body", "_pieces", "text") == 0 < exchanges(whole, "body")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    cols = [c for c in whole.columns if c != "text"]
    assert rows(marks, *cols) == rows(whole, *cols)
    assert rows(marks, "chunk_id", "text") == rows(whole.withColumn("text", F.when(F.trim("text") != "", "x").otherwise("")), "chunk_id", "text")


def some_units(spark, files, n=7):
    source = F.concat(F.lit("src_"), F.substring(F.sha1(F.concat("path", F.lit("|lecture_pdf"))), 1, 12)).alias("source_id")
    return files.select("course_id", source, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("unit_no"), "body").select(
        "course_id", "source_id", F.col("unit_no").cast("long").alias("unit_no"), F.concat(F.lit("page "), "unit_no").alias("locator"),
        F.concat(F.lit("unit "), "unit_no", F.lit(" "), "body").alias("text"))


def test_units_move_once(spark):
    """Chunks of sources with and without units: each text is in one exchange, as a body or as pieces."""
    plain = some_files(spark)
    pdf = plain.withColumn("path", F.replace("path", F.lit(".txt"), F.lit(".pdf")))
    units, files = some_units(spark, pdf), plain.unionByName(pdf)
    records = corpus.build_records(files)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chunks = corpus.build_chunks(records, plain, "body", units)
        assert (exchanges(chunks, "body"), exchanges(chunks, "_pieces"), exchanges(chunks, "text")) == (1, 1, 0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    ready = {r.source_id for r in records.filter("status = 'ready'").collect()}
    want = {(r.source_id, r.locator) for r in units.collect() if r.source_id in ready}
    assert {(r.source_id, r.locator) for r in chunks.filter("source_path like '%.pdf'").collect()} == want
    assert chunks.count() == chunks.select("chunk_id").distinct().count()


def test_bytes_that_nothing_reads_stay_behind(spark):
    kinds = ["txt", "html", "csv", "vtt", "url", "pdf", "pptx", "bin"]
    files = spark.createDataFrame([("c", f"Notes/a.{k}", 3, bytearray(b"abc"), None) for k in kinds],
                                  "course_id string, path string, size long, content binary, error string")
    out = extract.needed_bytes(files)
    assert out.columns == files.columns
    assert {r.path.split(".")[1] for r in out.filter("content is null").collect()} == {"pdf", "pptx", "bin"}


def test_a_path_twice_in_a_batch(spark):
    """The later file counts, whatever order the rows come in; a file without bytes is reported."""
    path = f"{scale.shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    data = [("c", "a.txt", 1, b"old text", 10), ("c", "a.txt", 2, b"new text", 20), ("c", "a.txt", 3, b"new text", 20), ("c", "b.txt", 4, None, 5), ("c", "p.pdf", 5, b"%PDF", 1)]
    batch = spark.createDataFrame(data, "course_id string, path string, size long, content binary, at long")
    ingest.ingest_batch(batch.select("course_id", "path", "size", "content", F.timestamp_seconds("at").alias("mtime")), 0, path)
    records, chunks = ingest.current_corpus(spark, path)
    assert rows(records, "source_path", "status") == [("a.txt", "ready"), ("b.txt", "error"), ("p.pdf", "visual_only")]
    assert rows(chunks, "text") == [("new text",)]
    seen = {r.logical_path: r.sha256 for r in spark.read.parquet(f"{path}/source_manifest").collect()}
    assert seen == {"a.txt": hashlib.sha256(b"new text").hexdigest(), "b.txt": None, "p.pdf": hashlib.sha256(b"%PDF").hexdigest()}
