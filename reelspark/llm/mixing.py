"""Mixing sources to target shares by hash thresholds, without sorting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.session import materialize

#: Bits of the hash per histogram level, and of the whole hash.
LEVEL_BITS, HASH_BITS = 12, 60
#: Documents above this part of their source come last in its order.
LARGE = 0.02
#: Sources with a target that a mix may have: a histogram has sources x 2^LEVEL_BITS rows.
MAX_SOURCES = 1_000


def clean_source(column):
    """A source name as targets write it: trimmed, lower case, with underscores."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[-\s]+", "_")


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = targets.where("source is not null and target_share > 0 and max_repeats > 0").select(clean_source(F.col("source")), "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have a target")
    return {r[0]: (float(r[1]), int(r[2])) for r in rows}


def _reachable(wanted: dict[str, tuple[float, int]], size: dict[str, int]) -> tuple[dict[str, float], int]:
    """Shares among the sources that have tokens, and the largest total that keeps them."""
    there = {s: share for s, (share, _) in wanted.items() if size.get(s, 0) > 0}
    whole = sum(there.values())
    shares = {s: share / whole for s, share in there.items()}
    total = min((wanted[s][1] * size[s] / share for s, share in shares.items()), default=0)
    return shares, int(total)


def mix(docs: DataFrame, targets: DataFrame, budgets: Sequence[float] = (1.0,)) -> DataFrame:
    """Rows (doc_id, source, tokens, budget, uses) of the documents in the mix, uses >= 1.

    ``docs`` has (doc_id, source, tokens). The total is the largest at which every source
    that has tokens reaches its share (shares of sources without tokens go to the others
    in proportion) using each document at most max_repeats times; ``budgets`` are parts of
    that total, and a smaller budget's uses never exceed a larger one's. All documents of
    a source are used floor(budget / size) times, and those whose hash lies below a
    threshold once more. Documents of more than LARGE of their source have hashes above all
    others, so that none of them ends a source short of its budget; without them a budget is
    missed by less than LARGE. The threshold comes from a histogram of tokens by source and
    leading hash bits; only the bucket that holds the boundary is refined by further bits.
    Documents that share a hash value (repeated ids do) are in or out together.

    Null or unknown sources, and null or non-positive sizes, take no part. Source names
    are trimmed, lower-cased, and written with underscores. Repeated rows share a hash and
    are used alike; null ids share one hash. No documents or no targets give no rows.
    """
    wanted = _targets(targets)
    rows = docs.select("doc_id", clean_source(F.col("source")).alias("source"), F.col("tokens").cast("bigint").alias("tokens"))
    rows = rows.where(F.col("source").isin(list(wanted)) & (F.col("tokens") > 0))
    # The top 4 bits are dropped: hashes are non-negative and levels of 12 bits fit evenly. One tells large documents.
    half = 1 << (HASH_BITS - 1)
    rows = materialize(rows.withColumn("h", F.xxhash64("doc_id").bitwiseAND(F.lit(half - 1))))
    size = {r[0]: r[1] for r in rows.groupBy("source").agg(F.sum("tokens")).collect()}
    shares, total = _reachable(wanted, size)
    if size:
        most = F.create_map(*[F.lit(x) for s, n in size.items() for x in (s, LARGE * n)])[F.col("source")]
        rows = rows.withColumn("h", F.col("h") + F.when(F.col("tokens") > most, F.lit(half)).otherwise(F.lit(0)))
    # (source, budget) -> [fixed uses, hash prefix so far, tokens still wanted below the threshold]
    cuts = {}
    for b in budgets:
        for s, share in shares.items():
            want = int(b * total * share)
            cuts[s, b] = [want // size[s], 0, want % size[s]]
    bits, open_cuts = 0, {k for k, v in cuts.items() if v[2] > 0}
    while open_cuts and bits < HASH_BITS:
        prefixes = sorted({(k[0], cuts[k][1]) for k in open_cuts})
        prefix, shift = F.shiftright("h", HASH_BITS - bits), HASH_BITS - bits - LEVEL_BITS
        inside = F.lit(False)
        for s, p in prefixes:
            inside = inside | ((F.col("source") == s) & (prefix == p if bits else F.lit(True)))
        # One row per source, open bucket and value of the next bits.
        found = rows.where(inside).groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()
        levels: dict[tuple[str, int], list] = {}
        for r in sorted(found):
            levels.setdefault((r[0], r[1] >> LEVEL_BITS), []).append((r[1], r[2], r[3]))
        bits += LEVEL_BITS
        for k in sorted(open_cuts):
            _, p, left = cuts[k]
            for bucket, t, n in levels.get((k[0], p), []):
                if t > left:
                    single = n == 1 or bits >= HASH_BITS
                    # A bucket with one document is in if that misses the budget by less.
                    cuts[k][1] = bucket + (single and 2 * left > t)
                    cuts[k][2] = 0 if single else left
                    break
                left -= t
                cuts[k][1], cuts[k][2] = bucket + 1, left
            if cuts[k][2] <= 0 or cuts[k][1] >> LEVEL_BITS != p:
                cuts[k][1] <<= HASH_BITS - bits
                open_cuts.discard(k)
    entries = [
        F.struct(F.lit(s).alias("s"), F.lit(float(b)).alias("budget"), F.lit(v[0]).cast("bigint").alias("fixed"), F.lit(v[1]).cast("bigint").alias("below"))
        for (s, b), v in cuts.items()
    ]
    if not entries:
        return rows.select("doc_id", "source", "tokens", F.lit(None).cast("double").alias("budget"), F.lit(0).cast("bigint").alias("uses")).limit(0)
    chosen = rows.withColumn("c", F.explode(F.filter(F.array(*entries), lambda c: c["s"] == F.col("source"))))
    uses = F.col("c.fixed") + (F.col("h") < F.col("c.below")).cast("bigint")
    return chosen.select("doc_id", "source", "tokens", F.col("c.budget").alias("budget"), uses.alias("uses")).where("uses > 0")


def shares(mixed: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per budget and source of the targets: available and used tokens, wanted and actual share."""
    have = docs.select(clean_source(F.col("source")).alias("source"), "tokens").where("tokens > 0").groupBy("source").agg(
        F.sum("tokens").alias("available_tokens"), F.count(F.lit(1)).alias("available_docs")
    )
    used = mixed.groupBy("budget", "source").agg(
        F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.count(F.lit(1)).alias("used_docs"), F.max("uses").alias("most_uses")
    )
    # One total per budget; the budgets are a parameter.
    totals = used.groupBy("budget").agg(F.sum("used_tokens")).collect()
    per_budget = F.array(*[F.struct(F.lit(b).alias("budget"), F.lit(t).alias("total_tokens")) for b, t in sorted(totals)])
    goals = targets.where("source is not null").select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").join(have, "source", "left")
    if not totals:
        per_budget = F.array(F.struct(F.lit(1.0).alias("budget"), F.lit(None).cast("bigint").alias("total_tokens")))
    out = goals.withColumn("b", F.explode(per_budget)).select("*", "b.*").drop("b")
    out = out.join(used, ["budget", "source"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select(
        "budget", "source", "target_share", "max_repeats", zero("available_docs"), zero("available_tokens"), zero("used_docs"), zero("used_tokens"),
        zero("most_uses"), (F.coalesce("used_tokens", F.lit(0)) / F.col("total_tokens")).alias("actual_share"),
    )
