"""Every stage against brute force over its own input, on the smallest tables."""

import base64
import hashlib

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from strandlake.llm import bpe_tree, mixing, quality_cnn, toxicity_fst
from strandlake.llm.common import table
from tests.llm.test_jaccard_join import brute_force

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF, "documents")
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, "no id at all", None, None, 1), (10**6, None, "en", "src0", 0)], docs.schema))
    seen = [docs.collect()]
    for _, stage in cp.STAGES:
        docs = spark.createDataFrame(seen[-1], docs.schema) if seen[-1] else docs.limit(0)
        docs = stage(spark, docs, SF)
        seen.append(docs.collect())
    return seen


def texts(rows):
    return sorted((str(r.doc_id), r.text or "", str(r.source)) for r in rows)


def test_classifiers_drop_what_they_reject(spark, stages):
    labels = table(spark, SF, "labels")
    schema = table(spark, SF, "documents").schema
    score = quality_cnn.fit(spark.createDataFrame(stages[0], schema), labels)
    assert texts(stages[1]) == texts([r for r in stages[0] if score([(r.text or "").encode()])[0] >= quality_cnn.THRESHOLD])
    scorer = toxicity_fst.learn(spark.createDataFrame(stages[1], schema), labels)
    assert texts(stages[2]) == texts([r for r in stages[1] if scorer.score(r.text or "") < toxicity_fst.THRESHOLD])
    assert len(stages[2]) > 0.6 * len(stages[0])


def test_one_of_each_group_stays(stages):
    groups = brute_force([(r.doc_id, r.text) for r in stages[2]], 5, 80)
    wordless = sum(n == 0 for _, n, _ in groups)
    ids = {c for _, n, c in groups if n}
    assert len(stages[3]) == len(ids) + wordless
    assert {r.doc_id for r in stages[3] if (r.text or "").split()} == ids


def test_mix_takes_what_the_targets_say(stages):
    before, after = stages[3], stages[4]
    size = lambda r: len((r.text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ")) - (r.text or " ").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ").count("")
    totals, taken, copies, longest = {}, {}, {}, {}
    for r in before:
        totals[r.source] = totals.get(r.source, 0) + max(0, size(r))
        longest[r.source] = max(longest.get(r.source, 0), size(r))
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + max(0, size(r))
        copies[r.doc_id, r.text] = copies.get((r.doc_id, r.text), 0) + 1
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(totals, key=lambda s: (s is None, s or "")))}
    targets, left, free = {}, 1.5 * sum(totals.values()), dict(weights)
    while True:
        level = left / sum(free.values())
        over = [s for s in free if level * free[s] > 2 * totals[s]]
        if not over:
            break
        for s in over:
            targets[s] = 2 * totals[s]
            left -= targets[s]
            del free[s]
    targets |= {s: level * w for s, w in free.items()}
    for s, target in targets.items():
        assert abs(taken.get(s, 0) - target) <= longest[s] + 1
    assert max(copies.values()) <= 2


def test_encoding(spark, stages):
    with open(bpe_tree.RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    bpe = tiktoken.Encoding("own", pat_str=bpe_tree.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in stages[4]:
        ids = bpe.encode_ordinary(r.text or "")
        want.append((str(r.doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:4]) for r in map(tuple, stages[5])) == sorted(want)


def test_run_and_columns(spark):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_joins"] and out.count() > 100
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == table(spark, SF, "documents").columns
    assert cp.encoded(spark, docs.where(F.lit(True)), SF).count() == 0
