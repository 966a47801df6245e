"""Documents and their passages against a plain Python version."""

from __future__ import annotations

from recallium.operators import chunking as K
from recallium.plans import catalog


def test_documents_and_passages(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()
    toxic = {r.doc_id for r in read("labels") if r.toxic == 1}
    docs = [(r.doc_id, r.text) for r in read("documents") if r.doc_id not in toxic]
    want = [(k, "document", -1, t) for k, t in docs] + [(k, "passage", n, p) for k, t in docs for n, p in enumerate(K.parents(t or ""))]
    got = [tuple(r) for r in catalog.QUERIES["document_memories_all"](spark, sf_dir).select("document_id", "kind", "pos", "content").collect()]
    assert len(want) > len(docs) and sorted(got, key=str) == sorted(want, key=str)
    print("rows", len(got), "documents", len(docs))
