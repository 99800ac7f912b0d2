"""Sharding by balanced label propagation.

Documents of one group (here: equal texts) are linked to each other. A shard is
a label; linked documents start on shards dealt by a hash and move, round by
round, towards the shard where most of their group is. Moves into a shard are
granted by gain while its quota lasts; the border class of gains is granted by
a hash of the document, so the quota holds without an order over all rows. A
group that is larger than a shard fills one after the other. Documents without
links have no reason to be anywhere and even out the sizes at the end.

Each round is an aggregate by group and shard and a join back, over the linked
documents only. The driver sees sums by shard, shard and class of gain.

The law is `rows`: counts of shards differ by one at most. The last step ranks
the documents of overfull shards, those without links first, and moves exactly
the surplus; slots are numbered within shards. Both use dealt numbering, so no
task holds a shard.

Defined results: a null text has size 1 and is a group with other null texts;
null ids are rows like any other; repeated rows are rows of their own; fewer
rows than shards leave shards empty; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, number_within, small

#: Gains are told apart up to two to this power.
CLASSES = 40


def propagate(nodes: DataFrame, shards: int, room: list[int], rounds: int = 6) -> DataFrame:
    """Move ``nodes(grp, spread, shard, ...)`` towards their groups' shards; ``room``: most linked rows by shard.

    ``spread`` is a hash of the row that deals the border class of a quota.
    """
    spark = nodes.sparkSession
    for turn in range(rounds):
        held = dict(nodes.groupBy("shard").count().collect())
        left = [max(0, room[s] - held.get(s, 0)) for s in range(shards)]
        counts = materialise(nodes.groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n")), "labels")
        open_shards = [s for s in range(shards) if left[s] > 0]
        # the fullest shard of a group attracts the rest; where that has no room, the fullest with room
        rank = F.struct("n", F.xxhash64("grp", "shard").alias("h"))
        top = counts.groupBy("grp").agg(F.max_by("shard", rank).alias("top"), F.max("n").alias("top_n"), F.max_by("shard", F.when(F.col("shard").isin(open_shards), rank)).alias("next"))
        aims = counts.join(top, "grp").withColumn("aim", F.when(F.col("top").isin(open_shards), F.col("top")).otherwise(F.col("next")))
        aims = aims.join(counts.select("grp", F.col("shard").alias("aim"), F.col("n").alias("aim_n")), ["grp", "aim"])
        wants = (F.col("aim") != F.col("shard")) & (F.col("shard") != F.col("top")) & ((F.col("aim_n") > F.col("n")) | ((F.col("aim_n") == F.col("n")) & (F.xxhash64("grp", "aim") > F.xxhash64("grp", "shard"))))
        gain = F.least(F.lit(CLASSES), F.floor(F.log2((F.col("aim_n") - F.col("n") + 1).cast("double")))).cast("int")
        moves = materialise(aims.where(wants).select("grp", "shard", "aim", gain.alias("gain"), "n"), "moves")
        asked = moves.groupBy("aim", "gain").agg(F.sum("n").alias("n")).collect()
        grant = []
        for row in sorted(asked, key=lambda r: (r["aim"], -r["gain"])):
            share = min(1.0, left[row["aim"]] / row["n"]) if row["n"] else 0.0
            left[row["aim"]] -= min(left[row["aim"]], row["n"])
            grant.append((row["aim"], row["gain"], share))
        if not any(share > 0 for *_, share in grant):
            break
        table = F.broadcast(spark.createDataFrame(grant, "aim int, gain int, share double"))  # shards x classes rows
        moves = moves.join(table, ["aim", "gain"]).where("share > 0").select("grp", "shard", "aim", "share")
        drawn = F.pmod(F.xxhash64("spread", F.lit(turn)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        joined = nodes.join(small(moves, moves.count()), ["grp", "shard"], "left")
        nodes = materialise(joined.withColumn("shard", F.when(drawn < F.col("share"), F.col("aim")).otherwise(F.col("shard"))).select(*nodes.columns), "nodes")
    return nodes


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rounds: int = 6) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``; counts of shards differ by one at most."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        docs[id_col].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text_col, F.octet_length(text)).alias("grp"),
    ).withColumn("spread", F.xxhash64("doc_id", "grp", F.lit(3)))
    rows = materialise(rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "grp"), F.lit(shards)).cast("int")), "rows")
    total = rows.count()
    goal = [total // shards + (s < total % shards) for s in range(shards)]
    many = materialise(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp"), "groups")
    n_many = many.count()
    linked = propagate(materialise(rows.join(small(many, n_many), "grp", "left_semi").select(*rows.columns), "nodes"), shards, goal, rounds)
    single = rows.join(small(many, n_many), "grp", "left_anti").select(*rows.columns)
    placed = materialise(linked.withColumn("bound", F.lit(1)).unionByName(single.withColumn("bound", F.lit(0))), "placed")
    held = dict(placed.groupBy("shard").count().collect())
    surplus = [max(0, held.get(s, 0) - goal[s]) for s in range(shards)]
    start, before = [], 0  # the surplus of all shards in one line, cut by what the others lack
    for n in surplus:
        start.append(before)
        before += n
    ends, upto = [], 0
    for s in range(shards):
        upto += max(0, goal[s] - held.get(s, 0))
        ends.append(upto)
    ranked = number_within(placed, "shard", "place", ["spread", "doc_id"], F.col("bound"))
    line = F.get(F.array(*[F.lit(x) for x in start]), "shard") + F.col("place")
    goes = F.col("place") < F.get(F.array(*[F.lit(x) for x in surplus]), "shard")
    to = sum(((line >= e).cast("int") for e in ends), F.lit(0))
    even = ranked.withColumn("shard", F.when(goes, to).otherwise(F.col("shard"))).drop("place")
    return number_within(materialise(even, "even"), "shard", "slot", ["spread", "doc_id"]).select("doc_id", "size", "text_crc32", "shard", "slot")
