"""Documents into containers of fixed capacity by a grouping genetic algorithm on islands.

Items are dealt to shards of bounded size; on each shard several islands evolve populations of groupings. Crossover
injects whole well-filled bins of one parent into the other, removes the bins that now hold duplicates, and best-fits
the displaced documents; each epoch the elite of every island moves to the next. The best island's bins stand; bins
that stay too empty are dissolved, and their items are dealt again with those of other shards.

A document larger than the capacity is cut into full pieces and a rest; no other is split. Empty documents are items
of size 0 and take no room; null sizes count as 0; repeated documents are items of their own only with an id of their
own; an empty table gives no bins. A capacity that is null or below 1 is ignored.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship

ISLANDS, EPOCHS, GENERATIONS, POPULATION, SHARD_ITEMS, FULL = 3, 2, 8, 6, 700, 0.985


def best_fit(bins: list[tuple[int, list[int]]], items: list[int], size: np.ndarray, cap: int) -> list[tuple[int, list[int]]]:
    """Puts items, largest first, each into the fullest bin that still takes it; bins are (room, items)."""
    store = {k: b for k, (_, b) in enumerate(bins)}
    rooms = sorted((r, k) for k, (r, _) in enumerate(bins))
    room = {k: r for r, k in rooms}
    for i in sorted(items, key=lambda i: (-size[i], i)):
        s = int(size[i])
        at = bisect_left(rooms, (s, -1))
        if at < len(rooms):
            r, k = rooms.pop(at)
        else:
            k, r = len(store), cap
            store[k] = []
        store[k] = [*store[k], i]
        room[k] = r - s
        insort(rooms, (r - s, k))
    return [(room[k], b) for k, b in store.items()]


def fitness(bins: list[tuple[int, list[int]]], cap: int) -> float:
    """Mean squared fill, which prefers full bins beside a nearly empty one to evenly filled ones."""
    return sum(((cap - r) / cap) ** 2 for r, _ in bins) / max(1, len(bins))


def crossover(a: list, b: list, size: np.ndarray, cap: int, rnd: random.Random) -> list:
    """A child of a with whole well-filled bins of b."""
    order = sorted(b, key=lambda x: x[0])
    take = [x for x in order[: max(1, len(order) // 2)] if rnd.random() < 0.4] or order[:1]
    inside = {i for _, items in take for i in items}
    kept, displaced = [], []
    for r, items in a:
        if inside.isdisjoint(items):
            kept.append((r, items))
        else:
            displaced += [i for i in items if i not in inside]
    return best_fit(kept + take, displaced, size, cap)


def mutate(a: list, size: np.ndarray, cap: int, rnd: random.Random) -> list:
    """Dissolves the emptiest bins and a few others, and best-fits their items in a shuffled start."""
    order = sorted(a, key=lambda x: -x[0])
    n = max(1, len(order) // 12)
    gone = order[:n] + [order[k] for k in rnd.sample(range(n, len(order)), min(n, len(order) - n))]
    ids = {id(x) for x in gone}
    loose = [i for _, items in gone for i in items]
    rnd.shuffle(loose)
    start: list[tuple[int, list[int]]] = []
    for i in loose[: max(1, len(loose) // 6)]:
        start.append((cap - int(size[i]), [i]))
    done = {i for _, items in start for i in items}
    return best_fit([x for x in a if id(x) not in ids] + start, [i for i in loose if i not in done], size, cap)


def evolve(size: np.ndarray, cap: int, seed: int, guests: list[list], generations: int = GENERATIONS, population: int = POPULATION) -> list:
    """The best grouping found of items that each fit the capacity. guests: groupings to begin with."""
    rnd = random.Random(seed)
    n = len(size)
    pool = [g for g in guests if g]
    pool.append(best_fit([], list(range(n)), size, cap))
    while len(pool) < population:
        pool.append(mutate(pool[-1], size, cap, rnd))
    least = -(-int(size.sum()) // cap)
    for _ in range(generations):
        pool.sort(key=lambda g: (len(g), -fitness(g, cap)))
        pool = pool[:population]
        if len(pool[0]) <= least:
            break
        children = []
        for _ in range(population):
            a, b = rnd.choice(pool[: max(2, population // 2)]), rnd.choice(pool)
            c = crossover(a, b, size, cap, rnd)
            children.append(mutate(c, size, cap, rnd) if rnd.random() < 0.5 else c)
        pool += children
    return min(pool, key=lambda g: (len(g), -fitness(g, cap)))


def _grouping(bins: pd.Series, size: np.ndarray, cap: int) -> list:
    out: dict[int, list[int]] = {}
    for i, b in enumerate(bins):
        out.setdefault(int(b), []).append(i)
    return [(cap - int(size[x].sum()), x) for x in out.values()]


_SOLVED = "container string, capacity int, shard int, island int, doc_id bigint, piece_no int, size bigint, bin int"


def _island(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One epoch of one island: its own grouping and its guest's, if any, are the beginning."""
    container, shard, island = key
    pdf = pdf.sort_values(["role", "doc_id", "piece_no"], kind="stable")
    first = pdf[pdf["role"] == pdf["role"].iloc[0]].reset_index(drop=True)
    size, cap = first["size"].to_numpy(np.int64), int(first["capacity"].iloc[0])
    guests = []
    if first["bin"].iloc[0] >= 0:
        guests = [_grouping(part["bin"], size, cap) for _, part in pdf.groupby("role", sort=True)]
    best = evolve(size, cap, hash((shard * 31 + island) * 7 + len(guests)), guests)
    out = first[["container", "capacity", "shard", "doc_id", "piece_no", "size"]].copy()
    out["island"] = island
    where = np.zeros(len(first), np.int64)
    for k, (_, items) in enumerate(best):
        where[items] = k
    out["bin"] = where
    return out[["container", "capacity", "shard", "island", "doc_id", "piece_no", "size", "bin"]]


def _evolve_level(items: DataFrame, level: int, shard_items: int) -> DataFrame:
    """Best bins of each shard: (container, capacity, level, shard, bin, doc_id, piece_no, size)."""
    shards = F.greatest(F.ceil(F.col("n") / shard_items), F.lit(1))
    counts = items.groupBy("container").agg(F.count(F.lit(1)).alias("n"))
    dealt = items.join(counts, "container").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(level)), shards).cast("int")).drop("n")
    state = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).withColumn("role", F.lit(0)).withColumn("bin", F.lit(-1))
    # A shard is small in bytes but long in work, so tasks are made by the number of shards and not by size.
    groups = int(counts.agg(F.sum(shards)).first()[0] or 1) * ISLANDS
    tasks = min(groups, max(3 * items.sparkSession.sparkContext.defaultParallelism, groups // 50))
    for epoch in range(EPOCHS):
        spread = state.repartition(tasks, "container", "shard", "island")
        solved = materialise(spread.groupBy("container", "shard", "island").applyInPandas(_island, _SOLVED), f"pack-{level}-{epoch}")
        # The elite stays on its island and visits the next one.
        state = solved.withColumn("role", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("island", F.when(F.col("role") == 1, F.pmod(F.col("island") + 1, F.lit(ISLANDS))).otherwise(F.col("island")))
    per_bin = solved.groupBy("container", "capacity", "shard", "island", "bin").agg(F.sum("size").alias("used"))
    rank = per_bin.groupBy("container", "shard", "island").agg(F.count(F.lit(1)).alias("bins"), F.sum((F.col("used") / F.col("capacity")) ** 2).alias("fit"))
    best = rank.groupBy("container", "shard").agg(F.min(F.struct("bins", (-F.col("fit")).alias("f"), "island")).alias("b")).select("container", "shard", F.col("b.island").alias("island"))
    return solved.join(best, ["container", "shard", "island"]).join(per_bin, ["container", "capacity", "shard", "island", "bin"]).select("container", "capacity", F.lit(level).alias("level"), "shard", "bin", "doc_id", "piece_no", "size", "used")


def pack(sizes: DataFrame, containers: DataFrame, shard_items: int = SHARD_ITEMS, levels: int = 2) -> DataFrame:
    """(container, bin_id, doc_id, piece_no, tokens): every document in a bin of each container kind."""
    ship(sizes.sparkSession)
    # The kinds of container are a small table of settings; they travel as one literal array.
    caps = containers.where("capacity_tokens >= 1 AND container IS NOT NULL").groupBy("container").agg(F.min("capacity_tokens").alias("c")).orderBy("container").collect()
    kinds = F.array(*[F.struct(F.lit(r["container"]).alias("container"), F.lit(int(r["c"])).alias("capacity")) for r in caps]) if caps else F.expr("CAST(array() AS array<struct<container:string,capacity:int>>)")
    own = materialise(sizes.select("doc_id", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens")), "sizes")
    each = own.select("doc_id", "tokens", F.inline(kinds))
    whole = F.floor(F.col("tokens") / F.col("capacity")).cast("int")
    rest = F.col("tokens") - whole * F.col("capacity")
    pieces = each.withColumn("whole", whole).withColumn("rest", rest)
    full = pieces.where("whole > 0").select("container", "capacity", "doc_id", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("piece_no"), F.col("capacity").cast("bigint").alias("size"))
    loose = pieces.where("rest > 0 OR whole = 0").select("container", "capacity", "doc_id", F.col("whole").alias("piece_no"), F.col("rest").cast("bigint").alias("size"))
    done = full.select("container", F.concat_ws("-", F.lit("full"), "doc_id", "piece_no").alias("bin_id"), "doc_id", "piece_no", F.col("size").alias("tokens"))
    for level in range(levels):
        # What is dealt again is a small share; each level mixes the items of many shards.
        solved = materialise(_evolve_level(loose, level, shard_items), f"packed-{level}")
        last = level == levels - 1
        good = solved if last else solved.where(F.col("used") >= F.lit(FULL) * F.col("capacity"))
        done = done.unionByName(good.select("container", F.concat_ws("-", "level", "shard", "bin").alias("bin_id"), "doc_id", "piece_no", F.col("size").alias("tokens")))
        loose = solved.where(F.col("used") < F.lit(FULL) * F.col("capacity")).select("container", "capacity", "doc_id", "piece_no", "size")
    return done


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per container kind: bins, tokens, the least number of bins possible, and the share of room used."""
    used = packed.groupBy("container").agg(F.countDistinct("bin_id").alias("bins"), F.sum("tokens").alias("tokens"))
    return used.join(containers.select("container", "capacity_tokens").dropDuplicates(["container"]), "container").select("container", "capacity_tokens", "bins", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_bins"), F.round(F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")), 6).alias("fill"))
