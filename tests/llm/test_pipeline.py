"""The corpus pipeline: every stage against what it should do to the rows of the stage before."""

import corpus_pipeline as P
from perfloom.llm import decontaminate

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "near_dedup", "decontaminate", "pack"]
    columns = docs.columns

    good = P.STAGES[0][1](spark, docs, SF).cache()
    assert good.columns == columns
    kept = {r.doc_id for r in good.collect()}
    judged = [(i in kept, q) for i, q in labels.items()]
    assert sum(k == bool(q) for k, q in judged) >= 0.97 * len(judged)

    single = P.STAGES[1][1](spark, good, SF).cache()
    assert single.columns == columns
    texts = {r.doc_id: r.text for r in good.collect()}
    left = {r.doc_id for r in single.collect()}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [t.encode().lower().split()]}
    gone, ids = set(texts) - left, sorted(left)
    for i in gone:  # every removed row resembles one that was there
        assert max(len(shingles[i] & shingles[j]) / len(shingles[i] | shingles[j]) for j in texts if j != i) >= 0.8 - 1e-9
    assert sum(shingles[i] == shingles[j] for n, i in enumerate(ids) for j in ids[:n]) == 0

    clean = P.STAGES[2][1](spark, single, SF).cache()
    assert clean.columns == columns
    bad = {r.id for r in decontaminate.contamination(single, bench).where("size(spans) > 0").collect()}
    assert {r.doc_id for r in clean.collect()} == left - bad and bad

    packed = P.STAGES[3][1](spark, clean, SF).collect()
    assert {r.doc_id for r in packed} == left - bad
    assert {(r.doc_id, r.start, r.length) for r in P.run(spark, SF).collect()} == {(r.doc_id, r.start, r.length) for r in packed}
