"""Each stage on its own input, and the run, by what they must keep and drop."""

from collections import Counter

import corpus_pipeline as P
from marklake.llm.near_duplicates import near_duplicates, one_of_each

SF = "/root/testdata/sf0.01"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert [n for n, _ in P.STAGES] == ["quality classifier", "toxicity", "near-duplicates", "best-fit packing"]
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in P.STAGES[:-1]:
        out = P.stored(stage(spark, docs, SF), "test-stage")
        assert out.columns == docs.columns
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(set(ids)) == len(ids) and set(ids) <= before
        gone = before - set(ids)
        known = [labels[i] for i in gone if i in labels]
        if name == "quality classifier":
            assert sum(r.quality == 1 for r in known) <= 1 and sum(r.quality == 0 for r in known) >= 50
        if name == "toxicity":
            assert sum(r.toxic == 0 for r in known) <= 1 and sum(r.toxic == 1 for r in known) >= 25
        if name == "near-duplicates":
            kept = {r.doc_id for r in near_duplicates(docs).where("kept").collect()}
            assert set(ids) == kept and gone
        docs, before = out, set(ids)
    packed = P.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == before
    run = Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in P.run(spark, SF).collect())
    assert run == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)


def test_one_row_of_each_group_stays_whatever_repeats(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(5, text), (5, text), (5, text + " more"), (7, text), (None, text), (None, "quite another text of seven words here"), (None, "quite another text of seven words here")]
    rows += [(1, ""), (2, None), (1, ""), (3, "short"), (3, "other")]
    df = spark.createDataFrame([(k, t, i, "h") for i, (k, t) in enumerate(rows)], "doc_id long, text string, k int, text_hash string")
    out = one_of_each(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, (r.text or "")[:13]) for r in out.collect())
    assert got == Counter({(5, "one two three"): 1, (None, "quite another"): 1, (1, ""): 2, (2, ""): 1, (3, "short"): 1, (3, "other"): 1})
    assert one_of_each(df.limit(0)).count() == 0
