import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from spanwright.llm import mixing, packing, sizes


def test_grouping_keeps_items_and_capacity():
    r = random.Random(2)
    size = np.array([r.randint(1, 60) for _ in range(120)])
    for cap in (60, 100):
        best = packing.evolve(size, cap, 1, [])
        assert sorted(i for _, b in best for i in b) == list(range(120))
        assert all(sum(size[b]) == cap - room and room >= 0 for room, b in best)
        first = packing.best_fit([], list(range(120)), size, cap)
        assert len(best) <= len(first)
        child = packing.crossover(first, best, size, cap, r)
        assert sorted(i for _, b in child for i in b) == list(range(120))
        changed = packing.mutate(child, size, cap, r)
        assert sorted(i for _, b in changed for i in b) == list(range(120))


def test_pack_whole(spark):
    r = random.Random(4)
    docs = spark.createDataFrame([(i, "s", r.choice([0, 3, 40, 77, 130, 900, None])) for i in range(400)], "doc_id bigint, source string, tokens bigint")
    kinds = spark.createDataFrame([("a", 100), ("b", 300), ("bad", None), (None, 5)], "container string, capacity_tokens int")
    out = packing.pack(docs, kinds, shard_items=90).collect()
    for name, cap in (("a", 100), ("b", 300)):
        bins, got = defaultdict(int), defaultdict(int)
        for x in out:
            if x.container == name:
                bins[x.bin_id] += x.tokens
                got[x.doc_id] += x.tokens
        assert max(bins.values()) <= cap
        want = {x.doc_id: x.tokens or 0 for x in docs.collect()}
        assert dict(got) == want
        assert sum(bins.values()) / (len([b for b in bins.values() if b]) * cap) > 0.9
    assert {x.container for x in out} == {"a", "b"}
    assert packing.pack(docs.limit(0), kinds).count() == 0


def test_running_start_is_a_prefix_sum(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("g").alias("g"), (F.col("id") % 7).alias("n"))
    out = sizes.running_start(df, "g", F.xxhash64("doc_id"), "n", 16).withColumn("h", F.xxhash64("doc_id")).orderBy("h").collect()
    total = 0
    for r in out:
        assert r.start == total
        total += r.n


def test_mix_reaches_targets(spark):
    rows = [(i, ("big", "mid", "small")[0 if i < 3000 else 1 if i < 3800 else 2], 50 + i % 60) for i in range(4000)]
    docs = spark.createDataFrame(rows + [(9001, None, 5), (9002, "other", 7), (9003, "big", 0)], "doc_id bigint, source string, tokens bigint")
    want = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 6), ("ghost", 0.0, 1), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    out = mixing.mix(docs, want, block=512)
    uses, slots, parts = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in out.collect():
        slots[r.slot] += r.tokens
        parts[r.doc_id, r.copy_no].append((r.from_token, r.tokens))
    for (doc, _), spans in parts.items():
        # What is drawn of a copy has no gap within, and counts as one use.
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        uses[doc] += 1
    assert set(slots.values()) == {512} and sorted(slots) == list(range(len(slots)))
    limit = {"big": 1, "mid": 2, "small": 6}
    source = {d: s for d, s, _ in rows}
    assert all(n <= limit[source[d]] for d, n in uses.items())
    got = {r.source: r for r in mixing.shares(out, want).collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(got[s].actual_share - share) < 0.02
    assert mixing.mix(docs.limit(0), want).count() == 0


def test_every_stretch_is_near_the_targets(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], 100) for i in range(4000)], "doc_id bigint, source string, tokens bigint")
    want = spark.createDataFrame([("a", 0.25, 1), ("b", 0.75, 1)], "source string, target_share double, max_repeats int")
    plan = mixing.targets_of(docs, want, 200)
    slots = [r.source for r in mixing.schedule(plan).orderBy("slot").collect()]
    for at in range(0, len(slots) - 40, 40):
        assert abs(slots[at : at + 40].count("a") - 10) <= 2
    ranks = mixing.schedule(plan).groupBy("source").agg(F.count_distinct("block").alias("d"), F.max("block").alias("m"), F.count("*").alias("n")).collect()
    assert all(r.d == r.n == r.m + 1 for r in ranks)


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "s", "hello hello"), (2, None, None), (3, "s", ""), (4, "s", "<|endoftext|>")], "doc_id bigint, source string, text string")
    got = {r.doc_id: r.tokens for r in sizes.token_sizes(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1
