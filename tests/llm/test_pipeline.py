"""The pipeline's stages on a small table, each against what it says it does, and all of them against plain Python."""

import math
import re
from collections import Counter

import corpus_pipeline as pipeline
import numpy as np
from test_operators import LONG, brute_buckets, brute_components, brute_rules, prose

from tessera.llm import bpe, decontaminate, quality_rules

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(pipeline.STAGES):
        after = stage(spark, before, SF).cache()
        if k < len(pipeline.STAGES) - 1:
            assert after.columns == columns, name
            assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        else:
            assert after.count() == before.count()
        before = after
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = docs.join(labels.where("quality = 1"), "doc_id").count()
    kept = pipeline.quality_stage(spark, docs, SF).join(labels.where("quality = 1"), "doc_id").count()
    assert kept >= 0.9 * good


def test_odd_rows_pass_through(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, None, None, None), (None, text, "en", "s", 1), (3, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    near = pipeline.near_dup_stage(spark, docs, SF).collect()
    assert sorted(r.doc_id or 0 for r in near) == [0, 1, 3]
    lines = {(r.doc_id, r.text) for r in pipeline.line_stage(spark, docs, SF).collect()}
    assert lines == {(1, text), (None, text), (3, None)}
    assert pipeline.decontamination_stage(spark, docs, SF).count() == 5
    assert [r.n_tokens for r in pipeline.bpe_stage(spark, docs, SF).where("doc_id = 3").collect()] == [0]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_repeated_ids_keep_a_fixed_row(spark):
    text, other = (" ".join(f"{c}{k}" for k in range(40)) for c in "wv")
    rows = [(1, text, "en", "s", 1), (1, other, "de", "s", 2), (1, None, "en", "s", 0), (1, other, "de", "r", 2), (2, None, "en", None, 0), (2, None, "en", None, 0), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = [(1, other, "de", "r", 2), (2, None, "en", None, 0), (3, "", "en", "s", 0)]
    assert sorted(tuple(r) for r in pipeline.near_dup_stage(spark, docs, SF).collect()) == want
    assert sorted(tuple(r) for r in pipeline.near_dup_stage(spark, docs.repartition(7, "source"), SF).collect()) == want


def brute_quality(rows, trusted):
    raw, good = Counter(), Counter()
    for i, t in rows:
        raw.update(brute_buckets(t))
        if i in trusted:
            good.update(brute_buckets(t))
    n, m, k = sum(raw.values()), sum(good.values()), quality_rules.SMOOTHING
    out = []
    for i, t in rows:
        base, b = brute_rules(t), brute_buckets(t)
        score = sum(round(quality_rules.SCALE * math.log((good[x] + k) / (raw[x] * m / n + k))) for x in b) / (quality_rules.SCALE * len(b)) if b else 0.0
        if base[0] >= 20 and 100 * base[4] <= 30 * base[0] and score >= quality_rules.MIN_SCORE:
            out.append((i, t))
    return out


def brute_lines(rows):
    """Lines of four or more words that stand in an earlier document, up to words with digits, go; over eight words also where three quarters of the words are equal, place by place."""
    seen, out = {}, []
    lines = sorted({(i, re.sub(r"\S*[0-9@]\S*", "<*>", line)) for i, t in rows if i is not None for line in t.split("\n")}, key=lambda x: x[0])

    def first(line):
        words = line.split()
        near = [i for i, other in lines if other.split() == words or len(words) > 8 and len(other.split()) == len(words) and other.split()[:4] == words[:4] and sum(a == b for a, b in zip(words, other.split())) >= 0.75 * len(words)]
        return min(near)

    for i, t in rows:
        kept = []
        for line in t.split("\n"):
            masked = re.sub(r"\S*[0-9@]\S*", "<*>", line)
            if i is None or len(masked.split()) < 4 or seen.setdefault(masked, first(masked)) == i:
                kept.append(line)
        if len(kept) == len(t.split("\n")) or re.search(r"\S", "\n".join(kept)):
            out.append((i, "\n".join(kept)))
    return out


def brute_near(rows):
    component = brute_components(rows, 5, 80)
    kept = {i for (i, _), c in component.items() if c == i}
    return [(i, t) for i, t in dict(r for r in rows if r[0] is not None).items() if i in kept] + [r for r in rows if r[0] is None]


def brute_leaks(rows, items):
    out = []
    for i, t in rows:
        words = decontaminate.tokens(t)
        has = decontaminate.shingles(words)
        for item in items:
            halves = [decontaminate.shingles(x) for x in decontaminate.parts(decontaminate.tokens(item))]
            if all(len(h & has) >= 0.8 * len(h) for h in halves):
                break
        else:
            out.append((i, t))
    return out


def test_pipeline_against_plain_python(spark, tmp_path):
    """run() on a written table gives the rows that plain versions of the five stages give, one after the other."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(31)
    vocabulary = ["".join(rng.choice(list("abcdefghijklm"), rng.integers(3, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [text(30), text(24)]
    shared, number = text(60), [text(12), text(12)]
    rows = [(k, text(50) + "\n" + text(30) + "\n" + text(7)) for k in range(40)]
    rows += [(100 + k, text(40) + "\n" + shared + "\n" + text(5)) for k in range(4)]
    near = shared.split()
    near[20] = near[40] = "changed"
    rows += [(110, text(30) + "\n" + " ".join(near)), (111, shared), (112, f"{number[0]} {text(30)}\n{text(4)} 17 {number[1]}")]
    rows += [(120 + k, rows[k][1].replace("\n", " ")) for k in range(3)]  # the same words on one line: near-duplicates
    rows += [(130, text(40) + " " + items[0] + " " + text(40)), (131, text(20) + "\n" + items[1] + "\n" + text(20))]
    rows += [(140, "too short"), (141, ""), (142, None), (143, "ab cd ef gh ij kl mn op " * 8), (144, rows[5][1]), (None, text(60)), (150, LONG)]
    trusted = [k for k in range(0, 40, 2)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in trusted] + [(143, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    library = Tokenizer.from_file(bpe.default_tokenizer())

    kept = brute_quality(rows, set(trusted))
    lines = brute_lines(kept)
    once = brute_near(lines)
    clean = brute_leaks(once, items)
    assert len(rows) > len(kept) > len(once) > len(clean) and lines != kept
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == sorted(-1 if i is None else i for i, _ in clean)
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in clean}
    for r in got:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want[r.doc_id] and r.n_tokens == len(want[r.doc_id])
        assert r.decoded == library.decode(want[r.doc_id], skip_special_tokens=False)
