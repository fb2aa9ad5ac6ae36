import corpus_pipeline as c
from harrier.llm import decontamination, quality
from test_jaccard_join import brute
from test_token_files import brute as tokens


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model, scale = quality.train_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    z, words = quality.document_logits([r.text for r in rows.values()], model)
    good = {i for i, s, n in zip(rows, quality.sigmoid(z * scale[0] + scale[1]), words) if n and s >= 0.3}
    first = {i for i, _, k in brute([(i, rows[i].text) for i in sorted(good)]) if i == k}
    items = [decontamination.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for i in first if not any(b in decontamination.normal(rows[i].text) for b in items)}
    frames, seen = docs, []
    for _, stage in c.STAGES:
        frames = stage(spark, frames, sf).cache()
        seen.append(frames.collect())
        assert stage is c.tokens or frames.columns == c.COLUMNS
    for want, got in zip((good, first, clean), seen):
        assert sorted(want) == sorted(r.doc_id for r in got)
    assert {r.doc_id for r in seen[3]} == clean and max(sum(r.doc_id == i for r in seen[3]) for i in clean) <= 2
    assert sorted((tuple(r)[:4] for r in seen[4]), key=lambda r: r[1]) == tokens([(r.doc_id, r.text) for r in seen[3]])


def test_awkward_and_empty(awkward, nothing, spark, sf):
    for docs in (awkward.select(c.COLUMNS), nothing):
        for _, stage in c.STAGES:
            docs = stage(spark, docs, sf).cache()
            docs.count()


def test_null_and_repeated_ids(awkward, spark, sf):
    """Quality and contamination are judged by row; of a group, and of an id, one row stays; rows without id stay."""
    docs = awkward.select(c.COLUMNS)
    rows = [tuple(r) for r in docs.collect()]
    kept = [tuple(r) for r in c.keep_one_of_near_duplicates(spark, docs, sf).collect()]
    component = {i: k for i, _, k in brute([(r[0], r[1]) for r in rows])}
    assert sorted(r[0] for r in kept if r[0] is not None) == sorted({i for i, k in component.items() if i is not None and i == k})
    assert [r[1] for r in kept if r[0] is None] == [r[1] for r in rows if r[0] is None]
    one = spark.createDataFrame([(5, "an item of words " * 9), (5, "quite other words stand here"), (None, "an item of words " * 9)], "item_id long, text string")
    items = one.limit(1)
    left = decontamination.uncontaminated(one.withColumnRenamed("item_id", "doc_id"), items).collect()
    assert [(r.doc_id, r.text) for r in left] == [(5, "quite other words stand here")]
    assert decontamination.uncontaminated(docs, items.limit(0)).count() == len(rows)
    model, scale = quality.train_quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    z, n = quality.document_logits([r[1] or "" for r in rows], model)
    good = [r for r, x, k in zip(rows, quality.sigmoid(z * scale[0] + scale[1]), n) if k and x >= quality.THRESHOLD]
    assert sorted(map(repr, map(tuple, quality.keep_good(docs, model, scale).collect()))) == sorted(map(repr, good))
