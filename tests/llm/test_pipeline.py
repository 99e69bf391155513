"""The registered queries and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rollcall.llm import packing
from rollcall.llm.oracle import ORACLE
from rollcall.llm.queries import QUERIES
from rollcall.llm.rows import table
from tests.llm import brute
from tests.oracle_compare import compare, duck

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_sql(spark, name):
    ok, said = compare(spark, SF, name, duck(SF))
    assert ok, said


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_jaccard_query_against_brute_force(spark):
    got = {r["doc_id"]: r["component_id"] for r in QUERIES["op7_jaccard"](spark, SMALL).collect()}
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").collect()]
    assert got == brute.jaccard_groups(rows)


def test_rules_query_against_brute_force(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op1_quality_rules"](spark, SMALL).collect()}
    for d in table(spark, SMALL, "documents").collect():
        want = brute.base_rules(d["text"])
        assert {k: rows[d["doc_id"]][k] for k in want} == want
    good = table(spark, SMALL, "labels").where("quality = 1").collect()
    kept = [rows[r["doc_id"]] for r in good if not rows[r["doc_id"]]["base_failed"]]
    assert sum(r["kept"] for r in kept) >= 0.98 * len(kept)


def test_pii_query_against_plain_patterns(spark):
    from rollcall.llm import pii
    from tests.llm.test_text import plain_spans

    rows = {r["doc_id"]: r for r in QUERIES["op6_pii"](spark, SF).collect()}
    for d in table(spark, SF, "documents").collect():
        spans = plain_spans(d["text"] or "")
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        got = rows[d["doc_id"]]
        assert got["base_sha256"] == brute.sha(line)
        assert [got[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == i for s in spans) for i in range(4)]
        assert set(line.split(",")) - {""} <= set(got["spans"].split(","))


def test_packing_query_round_trip(spark):
    import tiktoken

    plain = tiktoken.Encoding(
        "plain", pat_str=packing.PATTERN, mergeable_ranks=packing.read_ranks(packing.VOCABULARY), special_tokens={}
    )
    pieces = {}
    for r in QUERIES["op3_packing"](spark, SMALL).collect():
        ids, ends = np.frombuffer(r["input_ids"], "<u2"), r["cu_seqlens"]
        for doc, begin, a, b in zip(r["doc_ids"], r["begins"], ends, ends[1:]):
            pieces.setdefault(doc, []).append((begin, ids[a:b].tolist()))
    for d in table(spark, SMALL, "documents").collect():
        ids = [i for _, part in sorted(pieces[d["doc_id"]]) for i in part]
        assert plain.decode(ids[:-1]) == (d["text"] or "")


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    bench = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    toxic = {r["doc_id"]: r["toxic"] for r in table(spark, SMALL, "labels").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.durable(stage(spark, docs, SMALL), "test-stage")
        seen[name] = (before, docs.collect())
        if name != "packing":
            assert docs.schema.names == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = seen["toxicity"]
    kept = {r["doc_id"] for r in after}
    clean = [r["doc_id"] for r in before if toxic.get(r["doc_id"]) == 0]
    assert sum(d in kept for d in clean) >= 0.98 * len(clean)
    before, after = seen["ngram_jaccard"]
    groups = brute.jaccard_groups([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"] for r in after} == set(groups.values())
    before, after = seen["decontamination"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if not brute.contaminated(r["text"], bench)[1]}
    before, after = seen["mixing"]
    sizes = {}
    for r in before:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.words(r["text"]))
    taken = {}
    for r in after:
        taken[r["source"]] = taken.get(r["source"], 0) + len(brute.words(r["text"]))
    for source, target in brute.mix_targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= 1
    before, after = seen["packing"]
    assert sum(b == 0 for r in after for b in r["begins"]) == len(before)


def test_pipeline_query(spark):
    assert corpus_pipeline.run(spark, SMALL).where(F.size("doc_ids") == 0).count() == 0


def test_stages_on_odd_and_no_documents(spark, repeated_docs, no_docs):
    """Null and empty texts, repeated rows, null ids, no rows at all: no stage crashes, columns stay, clean rows are kept."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for start in (repeated_docs.select(*columns), no_docs.select(*columns)):
        docs, before = start, None
        for name, stage in corpus_pipeline.STAGES:
            before = docs.count()
            docs = corpus_pipeline.durable(stage(spark, docs, SMALL), "test-odd")
            if name != "packing":
                assert docs.columns == columns
                assert docs.count() <= before or name == "mixing"
                assert docs.count() >= before / 3
        ends = docs.select(F.explode("begins").alias("b")).where("b = 0").count()
        assert ends == before
