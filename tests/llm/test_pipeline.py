"""The pipeline against a brute-force version of the stages that decide about documents."""
import hashlib
import re
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from studycorpus.llm import quality
from test_duplicates import alike, bag, closed

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.checkpointed(stage(spark, docs, SF))
        assert docs.columns == columns or name == "bpe"
        seen[name] = docs.collect()
    source = spark.read.parquet(f"{SF}/documents.parquet")
    model = corpus_pipeline.quality_model(source, spark.read.parquet(f"{SF}/labels.parquet"))
    good = [d for d in source.collect() if model.network.probability(quality.pooled(d.text or "", model.vectors)[None, :])[0] >= corpus_pipeline.ACCEPT]
    assert Counter(seen["quality"]) == Counter(good)

    groups = {}
    for d in good:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", d.text), []).append(d)
    first = [min(g, key=lambda d: (-len(d.text), d.doc_id)) for g in groups.values()]
    assert Counter(seen["exact_dedup"]) == Counter(first)

    bags = {d.doc_id: bag(d.text) for d in first}
    ids = sorted(bags)
    low = closed([(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if alike(bags[a], bags[b])], ids)
    kept = [d for d in first if low[d.doc_id] == d.doc_id]
    assert Counter(seen["near_dedup"]) == Counter(kept)

    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    texts, mixed = {d.doc_id: d.text for d in kept}, seen["mix"]
    assert all(texts[d.doc_id].startswith(d.text) and d.n_chars == len(d.text) for d in mixed)
    assert max(Counter(d.doc_id for d in mixed).values()) <= 2
    total = sum(words(d.text) for d in kept)
    assert abs(sum(words(d.text) for d in mixed) - 1.5 * total) <= 0.02 * total

    library = Tokenizer.from_file(corpus_pipeline.VOCABULARY)
    want = Counter()
    for d in mixed:
        ids = library.encode(d.text, add_special_tokens=False).ids
        want[(d.doc_id, d.n_chars, tuple(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, tuple(r.ids), r.decoded_sha256) for r in seen["bpe"]) == want
    assert all(r.n_tokens == len(r.ids) for r in seen["bpe"])


def test_run_and_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert np.all([callable(f) for _, f in corpus_pipeline.STAGES])
