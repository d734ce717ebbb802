"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Token counts of the documents of listed sources are summed by (source, block), where a block is a slice of the hashed
   document ids; the table of blocks is bounded by sources x blocks and is all that the driver sees.
2. Each source's quota is its share of the mix, at most its tokens times its cap. Whole rounds use every document; the
   rest takes blocks in a random order, the last of them in part.
3. A binary tree over the output shards splits the block counts of each node between its halves by exact
   multivariate-hypergeometric draws; each leaf takes that many blocks of each source from the source's random order, so
   shards are disjoint and their mixtures differ only by chance.
4. Documents follow their block to its shards and are shuffled there: each shard is one partition in the order of a hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .encode import count_tokens


def split_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): how many of each source's blocks go to each shard; columns sum to ``counts`` exactly."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    total = int(counts.sum())
    take = total * left // shards + int(rng.random() < (total * left / shards) % 1)
    drawn = rng.multivariate_hypergeometric(counts, min(take, total), method="marginals") if total else np.zeros_like(counts)
    return np.vstack([split_tree(drawn, left, rng), split_tree(counts - drawn, shards - left, rng)])


MODES = ("spread", "hold", "keep")
#: Most shard numbers (4 bytes each) of the plan that goes out as a broadcast.
MOST_PLANNED = 16_000_000


def quotas(wanted: dict[str, tuple[float, int]], have: dict[str, int], total: int, mode: str = "spread") -> dict[str, int]:
    """Tokens to draw of each source; ``wanted`` holds (share, cap).

    A source gives at most its tokens times its cap. ``keep`` leaves the others at their quotas, so the mix falls short of
    ``total``; ``spread`` shares the shortfall out among the others by their shares, as far as their caps allow; ``hold``
    lowers the total until every source that has any tokens holds its share.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    most = {s: have[s] * max(0, cap) for s, (_, cap) in wanted.items()}
    able = {s: share for s, (share, _) in wanted.items() if share > 0 and most[s] > 0}
    if mode == "keep":
        return {s: min(round(total * wanted[s][0]), most[s]) for s in wanted}
    out = dict.fromkeys(wanted, 0)
    if mode == "hold":
        total = min([total, *(most[s] / share * sum(able.values()) for s, share in able.items())])
    left = total
    while able:
        weight = sum(able.values())
        full = [s for s, share in able.items() if left * share / weight >= most[s]]
        if not full or mode == "hold":
            return out | {s: min(most[s], round(left * share / weight)) for s, share in able.items()}
        for s in full:
            out[s] = most[s]
            left -= most[s]
            del able[s]
    return out


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, shards: int = 16, blocks: int = 1024, seed: int = 7, tokenizer: str | None = None, mode: str = "spread") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(draws, shares, options).

    ``draws``: the chosen (shard, place, doc_id, source, repeat_no, n_tokens); each shard is one partition, shuffled.
    ``shares``: each source's reached share. ``options``: what each of the MODES would plan for each source.

    ``total_tokens`` is the size of the mix; by default that of the listed sources' documents. A source that cannot fill
    its quota within its cap gives all it has and is reported with a shortfall. The quota is met to within half a
    document. Sources that are not listed, null sources and documents without tokens are not drawn; listed sources without
    documents are reported with 0. Repeated rows of ``targets`` count once (the largest share holds); a null share counts
    as 0 and a null cap as 1. ``targets`` is a parameter table of bounded size, ``blocks`` at most 65,536 for each source,
    and sources x blocks x repeats at most MOST_PLANNED. For larger corpora raise ``shards`` and ``blocks``.
    """
    spark = documents.sparkSession
    wanted = {r["source"]: (float(r["share"] or 0), int(1 if r["cap"] is None else r["cap"])) for r in targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).collect()}
    if not 0 < blocks <= 65536 or shards < 1:
        raise ValueError("blocks must be 1 to 65536, shards at least 1")
    names = sorted(wanted)
    block = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(blocks)).cast("int").alias("block")
    listed = documents.filter(F.col("source").isin(names)).select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text", block)
    sized = cut(count_tokens(listed, tokenizer).filter("n_tokens > 0"))
    held: dict[str, dict[int, int]] = {s: {} for s in names}
    for r in sized.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")).collect():
        held[r["source"]][r["block"]] = r["n"]
    have = {s: sum(b.values()) for s, b in held.items()}
    total = sum(have.values()) if total_tokens is None else total_tokens
    quota = quotas(wanted, have, total, mode)
    rng = np.random.default_rng(seed)
    # for each source, how often each block is drawn; the last draw of one block may be of a part of its tokens
    times: list[dict[int, int]] = []
    part: dict[tuple[str, int], int] = {}
    for s in names:
        rounds, rest = divmod(quota[s], have[s]) if have[s] else (0, 0)
        own = dict.fromkeys(sorted(held[s]), rounds) if quota[s] else {}
        for b in rng.permutation(sorted(held[s])).tolist() if rest else []:
            own[b] += 1
            if held[s][b] > rest:
                part[s, b] = rest
            rest -= held[s][b]
            if rest <= 0:
                break
        times.append({b: n for b, n in own.items() if n})
    if sum(sum(x.values()) for x in times) > MOST_PLANNED:
        raise ValueError("the plan is too large: lower blocks or max_repeats")
    leaves = split_tree(np.array([sum(x.values()) for x in times], dtype=np.int64), shards, rng)
    placed = []
    for i, own in enumerate(times):
        shard_of = rng.permutation(np.repeat(np.arange(shards), leaves[:, i])).tolist()
        at = 0
        for b, n in own.items():
            placed.append((names[i], b, shard_of[at : at + n], part.get((names[i], b))))
            at += n
    # a row for each block of each source, repeats as a list of shard numbers: bounded by sources, blocks and MOST_PLANNED
    plan = F.broadcast(spark.createDataFrame(placed, "source string, block int, shards array<int>, part bigint"))
    drawn = sized.join(plan, ["source", "block"])
    # the documents of a block that is taken in part: in the order of a hash as far as they come nearest to its quota
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id")
    partial = drawn.filter("part is not null").withColumn("before", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    partial = partial.withColumn("shards", F.when(F.expr("before + n_tokens / 2 <= part"), F.col("shards")).otherwise(F.slice("shards", 1, F.size("shards") - 1))).drop("before")
    each = drawn.filter("part is null").unionByName(partial).select("doc_id", "source", "n_tokens", F.posexplode("shards").alias("repeat_no", "shard"))
    place = F.xxhash64("doc_id", "repeat_no", F.lit(seed + 2)).alias("place")
    loose = each.select("shard", place, "doc_id", "source", "repeat_no", "n_tokens")
    draws = shards_in_order(loose, shards)
    reached = loose.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("draws"), F.count_distinct("doc_id").alias("documents"), F.max("repeat_no").alias("m"))
    goal = spark.createDataFrame([(s, wanted[s][0], wanted[s][1], have[s], round(total * wanted[s][0])) for s in names], "source string, target_share double, max_repeats int, tokens_available bigint, tokens_wanted bigint")
    shares = F.broadcast(goal).join(reached, "source", "left")
    everything = Window.partitionBy()  # one row for each listed source
    tokens = F.coalesce("tokens", F.lit(0))
    shares = shares.select(
        "source", "target_share", "max_repeats", "tokens_available", "tokens_wanted", tokens.alias("tokens"),
        F.coalesce("draws", F.lit(0)).alias("draws"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce(F.col("m") + 1, F.lit(0)).alias("most_repeats"),
        F.coalesce(F.try_divide(tokens, F.sum(tokens).over(everything)), F.lit(0.0)).alias("share"),
        F.greatest(F.col("tokens_wanted") - tokens, F.lit(0)).alias("shortfall"),
    )
    planned = [(m, s, q, q / max(1, sum(x.values()))) for m in MODES for x in [quotas(wanted, have, total, m)] for s, q in x.items()]
    return draws, shares, spark.createDataFrame(planned, "mode string, source string, tokens bigint, share double")


def shards_in_order(draws: DataFrame, shards: int) -> DataFrame:
    """The draws laid out for writing: each shard in a partition of its own, shuffled within it."""
    return draws.repartitionById(shards, F.col("shard")).sortWithinPartitions("place", "doc_id", "repeat_no")
