"""op1 as registered: what it finds among labelled documents it has not learned from."""

import zlib

from dyadloom.llm import queries

SF = "/root/testdata/sf0.1"


def test_held_out_documents_by_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    labels = spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg({"toxic": "max"}).toDF("doc_id", "toxic")
    scored = queries.op1_toxicity(spark, SF)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = scored.join(docs, "doc_id").join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    unseen = [r for r in rows if r.held_out and r.toxic is not None]
    found = {lang: [r.predicted for r in unseen if r.toxic and r.lang == lang] for lang in {r.lang for r in unseen}}
    hits, flagged = sum(map(sum, found.values())), sum(r.predicted for r in unseen)
    assert hits / sum(map(len, found.values())) >= 0.75 and hits / flagged >= 0.9
    assert sum(found["en"]) / len(found["en"]) >= 0.85
    assert sum(sum(v) for k, v in found.items() if k != "en") / sum(len(v) for k, v in found.items() if k != "en") >= 0.6
