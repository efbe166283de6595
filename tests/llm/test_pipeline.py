"""The pipeline against the brute force of each of its stages."""

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cobframe.llm import common, toxicity
from cobframe.llm.queries import PACKING_VOCABULARY, vocabulary
from tests.llm.test_learning import plain_spans
from tests.llm.test_near_duplicates import plain_components


SF = "/root/testdata/sf0.01"


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    named = dict(corpus_pipeline.STAGES)
    assert list(named) == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]

    def rows(frame):
        return {r["doc_id"]: r.asDict() for r in frame.collect()}

    start = rows(docs)
    calm = common.staged(named["toxicity"](spark, docs, SF), "t")
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert calm.columns == columns
    assert set(rows(calm)) == {r["doc_id"] for r in scored.where(F.col("predicted") == 0).collect()}

    assert len(rows(calm)) > 100

    single = common.staged(named["near_duplicates"](spark, calm, SF), "t")
    want = {c for _, _, c in plain_components([(i, r["text"]) for i, r in rows(calm).items()])}
    assert single.columns == columns and set(rows(single)) == want

    clean = common.staged(named["decontamination"](spark, single, SF), "t")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {i for i, r in rows(single).items() if any(t in (r["text"] or "") for t in items)}
    assert clean.columns == columns and set(rows(clean)) == set(rows(single)) - leaked

    blanked = common.staged(named["secrets"](spark, clean, SF), "t")
    assert blanked.columns == columns and set(rows(blanked)) == set(rows(clean))
    for i, r in rows(blanked).items():
        assert not plain_spans(r["text"] or "")
        assert r["n_chars"] == len(r["text"])
        if not plain_spans(start[i]["text"]) and "[SECRET]" not in r["text"]:
            assert r["text"] == start[i]["text"]

    library = Tokenizer.from_file(vocabulary(PACKING_VOCABULARY))
    packed = named["packing"](spark, blanked, SF).collect()
    tokens = {i: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in rows(blanked).items()}
    held = {}
    for r in packed:
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + r["length"]
    assert held == tokens


def test_run_applies_all_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and "sequence_id" in got.columns


def test_awkward_documents_pass_through(spark, tmp_path):
    from tests.llm.helpers import AWKWARD, docs_frame
    docs_frame(spark, AWKWARD).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    docs_frame(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
