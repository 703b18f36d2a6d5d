import brute
import corpus_pipeline as pipeline

from slidelake.llm import quality


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "mix sources"]
    out = docs
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, out, sf).persist()
        assert out.columns == docs.columns, name
        kept[name] = {r.doc_id: r for r in out.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = model.scores([r.text.encode() for r in rows.values()]) >= quality.THRESHOLD
    assert set(kept["quality classifier"]) == {i for i, g in zip(rows, good, strict=True) if g}
    before = list(kept["quality classifier"].values())
    texts = brute.line_dedup([(r.source, r.text) for r in before])
    assert {i: r.text for i, r in kept["line dedup"].items()} == {r.doc_id: t for r, t in zip(before, texts, strict=True)}
    near = brute.near_duplicates([(i, r.text) for i, r in kept["line dedup"].items()])
    first = sorted(i for i, _, c in near if i == c)
    roots = brute.similar([kept["line dedup"][i].text for i in first])
    assert set(kept["simhash near-dedup"]) == {i for k, i in enumerate(first) if roots[k] == k}
    bad = brute.leaks([(i, r.text) for i, r in kept["simhash near-dedup"].items()], items)
    assert set(kept["benchmark decontamination"]) == set(kept["simhash near-dedup"]) - {b[0] for b in bad}
    mixed = pipeline.STAGES[-1][1](spark, out, sf).collect()
    assert {r.doc_id for r in mixed} == set(kept["benchmark decontamination"])
    sizes = {}
    for r in kept["benchmark decontamination"].values():
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.words(r.text))
    want = brute.targets(sizes)
    for s in sizes:
        assert sum(r.taken for r in mixed if r.source == s) == int(want[s] + 1e-9)
    assert sorted(map(tuple, pipeline.run(spark, sf).collect())) == sorted(map(tuple, mixed))
