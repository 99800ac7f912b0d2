import corpus_pipeline
from skymatch.llm import quality
from skymatch.llm.common import materialise, table

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, DATA, "documents")
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        was, docs = docs, materialise(stage(spark, docs, DATA), name)
        assert docs.columns == first.columns, name
        ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
        assert ids(docs) <= ids(was)
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in table(spark, DATA, "labels").collect()}
            kept = ids(docs)
            good = [k in kept for k, v in labels.items() if v == 1]
            assert sum(good) >= 0.98 * len(good) and sum(k in kept for k, v in labels.items() if v == 0) <= 1
        elif name in ("line_dedup", "mixing"):
            assert ids(docs) == ids(was)
        elif name == "near_dedup":
            assert docs.count() == len(ids(docs)) < was.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids(docs)
    assert corpus_pipeline.run(spark, DATA).count() == packed.count()
    assert quality.SAMPLE <= 10_000


#: Names that the stages use inside.
TAKEN = ["row", "score", "quality_score", "_text", "dropped", "n_near", "first_doc", "th", "_id", "_th", "n1", "times", "key", "n_tokens", "chances", "col", "queue"]


def test_odd_rows_pass_every_stage(spark, odd):
    taken = [c for c in TAKEN if c not in odd.columns]
    docs = odd.selectExpr("*", *[f"{k} AS {c}" for k, c in enumerate(taken)])
    docs = docs.unionByName(docs.where("doc_id = 6").selectExpr("* EXCEPT (doc_id, text)", "1L AS doc_id", "'quite another text under a known id' AS text").select(*docs.columns))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.limit(0)):
            got = stage(spark, given, DATA)
            assert got.columns == docs.columns, name
            rows = got.collect()
            assert all(tuple(r[c] for c in taken) == tuple(k for k, c in enumerate(taken)) for r in rows)
            assert {(r["doc_id"], r["text"]) for r in rows} <= {(r["doc_id"], r["text"]) for r in docs.collect()} or name == "line_dedup"
        if name == "near_dedup":
            held = sorted(((r["doc_id"] or -1, len(r["text"] or "")) for r in stage(spark, docs, DATA).collect()))
            assert [i for i, _ in held] == [-1, 1, 1, 2, 5]
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, DATA).agg({"length": "sum"}).first()[0] > 0 and last(spark, docs.limit(0), DATA).count() == 0
