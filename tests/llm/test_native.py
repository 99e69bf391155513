"""Quality rules, mixing and decontamination against plain-Python models."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rollcall.llm import decontaminate, mixing, quality_rules
from tests.llm import brute
from tests.llm.conftest import as_docs, prose

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def check_rules(docs, trusted):
    marked = docs.withColumn("trusted", F.col("doc_id").isin(trusted))
    ratios = quality_rules.ratio_table(marked, F.col("trusted"), buckets=512)
    got = quality_rules.judge(docs, ratios, buckets=512).collect()
    rows = docs.select("doc_id", "text").collect()
    raw, good = Counter(), Counter()
    for r in rows:
        grams = brute.buckets(r["text"], 512)
        raw.update(grams)
        if r["doc_id"] in trusted:
            good.update(grams)
    scale = sum(good.values()) / max(1, sum(raw.values()))
    ratio = {b: math.log((good[b] + 10) / (raw[b] * scale + 10)) for b in raw}
    want = []
    for r in rows:
        base = brute.base_rules(r["text"])
        grams = brute.buckets(r["text"], 512)
        score = sum(ratio[b] for b in grams) / len(grams) if grams else None
        keep = not base["base_failed"] and (score or 0) >= quality_rules.MIN_SCORE
        want.append((r["doc_id"], *[base[c] for c in BASE], None if score is None else round(score, 9), keep))
    have = [(g["doc_id"], *[g[c] for c in BASE], None if g["score"] is None else round(g["score"], 9), g["kept"]) for g in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_rules(odd_docs):
    check_rules(odd_docs, [6, 7, 14])


def test_rules_on_repeated_rows_and_null_ids(repeated_docs):
    check_rules(repeated_docs, [1, 3])


def test_rules_without_trusted_or_documents(odd_docs, no_docs):
    check_rules(odd_docs, [])
    check_rules(no_docs, [])


def test_ratio_table_tells_junk_from_prose(spark):
    import random

    rng = random.Random(1)
    clean = [(i, prose(rng, 80, 50), "en", "a") for i in range(40)]
    junk = [(100 + i, " ".join(f"w{rng.randrange(50)}$%%" for _ in range(80)), "en", "a") for i in range(10)]
    docs = as_docs(spark, clean + junk)
    ratios = quality_rules.ratio_table(docs, F.col("doc_id") < 20)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, ratios).collect()}
    assert all(kept[i] for i in range(40)) and not any(kept[100 + i] for i in range(10))


def check_mix(docs):
    rows = mixing.mix(docs).collect()
    sizes = Counter()
    for r in docs.select("source", "text").collect():
        sizes[r["source"]] += len(brute.words(r["text"]))
    want = brute.mix_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    for source, members in brute.by(rows, "source").items():
        assert members[0]["source_size"] == sizes[source]
        assert members[0]["target"] == pytest.approx(want[source])
        assert sum(m["taken"] for m in members) == math.floor(members[0]["target"])
        assert all(0 <= m["taken"] <= 2 * m["size"] for m in members)
    assert len(rows) == docs.count()
    return rows


def test_mix(odd_docs, repeated_docs, no_docs):
    assert sorted(check_mix(odd_docs)) == sorted(check_mix(odd_docs.repartition(7)))
    check_mix(repeated_docs)
    check_mix(no_docs)


def test_mix_in_many_slices(odd_docs, monkeypatch):
    whole = sorted(mixing.mix(odd_docs).collect())
    monkeypatch.setattr("rollcall.llm.prefix.SLICE_ROWS", 3)
    assert sorted(mixing.mix(odd_docs).collect()) == whole


def test_mixed_documents_hold_exactly_what_was_taken(odd_docs, repeated_docs, no_docs):
    for docs in (odd_docs, repeated_docs, no_docs):
        out = mixing.mixed_documents(docs)
        assert out.columns == docs.columns
        taken = Counter()
        for r in mixing.mix(docs).collect():
            taken[(r["doc_id"], r["source"])] += r["taken"]
        have, texts = Counter(), brute.by(docs.collect(), "doc_id")
        for r in out.collect():
            have[(r["doc_id"], r["source"])] += len(brute.words(r["text"]))
            assert any((d["text"] or "").startswith(r["text"]) for d in texts[r["doc_id"]])
        assert have == Counter({k: v for k, v in taken.items() if v})


ITEMS = "item_id bigint, text string, size int, window string"


def check_hits(spark, docs, items):
    bench = spark.createDataFrame([(i, t, 1, "w") for i, t in items], ITEMS)
    got = decontaminate.contamination(docs, bench).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        n, hit, found = brute.contaminated(r["text"], items)
        want.append((r["doc_id"], n, hit, tuple(found), hit > 0))
    have = [(g["doc_id"], g["n_words"], g["n_hit"], tuple(g["items"]), g["contaminated"]) for g in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    bad = {r for r in want if r[4]}
    left = decontaminate.remove_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == len(want) - sum(w in bad for w in want)
    return bad


def items_from(rows):
    text = {d: t for d, t, _, _ in rows}
    passage = text[17].split()
    return [
        (1, " ".join(passage[5:40]).upper()),
        (2, " ".join(passage[10:20])),
        (22, " ".join(passage[10:20])),
        (3, "One, two; three"),
        (4, None),
        (5, "...  !!"),
        (None, text[8]),
        (6, "ÉTUDE naïve café"),
        (6, "w1"),
        (7, "nothing of the kind is anywhere in these documents as far as known"),
    ]


def test_contamination(spark, odd_rows, odd_docs, repeated_docs, no_docs, monkeypatch):
    items = items_from(odd_rows)
    assert check_hits(spark, odd_docs, items)
    check_hits(spark, repeated_docs, items[:6])
    check_hits(spark, no_docs, items)
    assert not check_hits(spark, odd_docs, [])


def test_contamination_in_blocks(spark, odd_rows, odd_docs):
    bench = spark.createDataFrame([(i, t, 1, "w") for i, t in items_from(odd_rows)], ITEMS)
    windows = decontaminate.test_windows(bench)
    one = decontaminate.window_hits(odd_docs, windows).collect()
    assert sorted(decontaminate.window_hits(odd_docs, windows, block=7).collect()) == sorted(one)


def test_windows_are_hashed_without_making_their_arrays(spark):
    rows = [([random.Random(n).randrange(-(2**63), 2**63) for _ in range(n)],) for n in (0, 1, 7, 8, 9, 30)]
    hashes = spark.createDataFrame([*rows, ([],)], "h array<bigint>")
    for size in (2, 8):
        made = hashes.select("h", quality_rules._windows(F.col("h"), size).alias("got"))
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "lambdafunction(xxhash64(slice" not in plan
        each = made.select("got", F.posexplode_outer("h").alias("i", "x"), "h").where(f"i + {size} <= size(h)")
        for r in each.select(F.expr(f"got[i] = xxhash64(slice(h, i + 1, {size}))").alias("same")).collect():
            assert r["same"]
        assert made.where(f"size(got) != greatest(size(h) - {size} + 1, 0)").count() == 0
