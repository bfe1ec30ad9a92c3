"""Every stage of the pipeline against the operators' own plain rules, stage by stage."""

import corpus_pipeline
from tablewright.llm import contamination, mixing, neardup, toxicity
from tablewright.queries.base import table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_shards"]

    kept = stages["toxicity"](spark, docs, sf)
    assert kept.columns == columns
    g = toxicity.learn(toxicity.labelled(docs, table(spark, sf, "labels")))
    want = sorted(r["doc_id"] for r in docs.collect() if toxicity.score_text(r["text"], g) < 0.5)
    assert sorted(r["doc_id"] for r in kept.collect()) == want and len(want) >= 0.85 * docs.count()

    single = stages["near_duplicates"](spark, kept, sf)
    groups = {r["component_id"] for r in neardup.report(kept).collect()}
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} == groups and single.count() == len(groups)

    clean = stages["decontamination"](spark, single, sf)
    bad = {r["doc_id"] for r in contamination.report(single, table(spark, sf, "benchmark")).collect()}
    assert clean.columns == columns and sorted(r["doc_id"] for r in clean.collect()) == sorted(groups - bad)

    mixed = stages["mixing"](spark, clean, sf)
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.report(clean).collect() if r["size"]}
    times = {}
    for r in mixed.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert mixed.columns == columns and times.keys() >= {i for i, n in taken.items() if n} and all(times.get(i, 0) == n for i, n in taken.items())

    out = stages["token_shards"](spark, mixed, sf)
    assert out.count() == sum(times.values())
    rows = sorted(tuple(r) for r in out.select("start", "n_tokens").collect())
    assert all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:]))


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_on_odd_rows(spark, sf, odd, nothing):
    """Each stage by itself: nulls, empty and long texts, repeated rows, clashing columns; then no rows at all."""
    stages = dict(corpus_pipeline.STAGES)
    rows = odd.count()
    kept = {name: stages[name](spark, odd, sf) for name in stages}
    for name, out in kept.items():
        assert name == "token_shards" or out.columns == odd.columns
    blank = {3, 4, 5, 12, 13}
    assert kept["toxicity"].count() == kept["decontamination"].count() == kept["token_shards"].count() == rows
    single = [r["doc_id"] for r in kept["near_duplicates"].collect()]
    assert len(single) == len(set(single)) and blank & set(single) == {3} and 1 in single and 2 not in single
    mixed = [r["doc_id"] for r in kept["mixing"].collect()]
    assert blank <= set(mixed) and all(mixed.count(i) == 1 for i in blank)
    for name in stages:
        assert stages[name](spark, nothing, sf).count() == 0
