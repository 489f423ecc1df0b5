"""Sharding by balanced label propagation.

Linked documents share a hub (here: an equal text); a hub is one row a member, so links grow with the documents and
never with their pairs. Every linked document starts in a shard by hash. In each round, joins count for each document
how many neighbours every shard holds; it wants the best shard, and moves are admitted hub by hub, larger hubs first,
while the target's quota has room. Hubs larger than a quota are first split into parts that fit one: those cuts can't be
avoided. After the rounds, overfull shards send off what is over, and documents without links fill the
shards to their exact quota, dealt by size class so that bytes come out near even too. The law is ``rows``: shard
sizes in rows differ by one at most, whatever the links.

Only tables of a fixed size (shards x priority buckets, shards x size classes) reach the driver. Every rank is taken in
two levels (buckets, then offsets), never in one task per shard.

Rows are named by the digest of their doc_id and text, and true repeats by a number besides, so the result hangs on the rows alone and not on how files
lay them out or in which order.

Edge cases: a null text counts as empty (size 1, crc32 of no bytes) and equals other empty texts; very long texts count
by their whole bytes and enter as a hash; ties of votes are broken by a hash of hub and shard; repeated rows are rows of
their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import core, n_buckets, ranked, written

N_SHARDS = 16
ROUNDS = 4
#: Priority buckets of a target shard: 48 size levels of hubs, each in this many parts.
PARTS = 64


def propagate(links: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """links (rid, hub) -> (rid, shard) for every linked row, by quota-bound label propagation; several hubs a row are fine."""
    k = len(quotas)
    quota = max(1, min(quotas, default=1))
    largest = max(1, quota // 2, int(quota - 3 * quota**0.5))  # parts are cut by hash: leave room for their spread
    # Written first: a join of two plain shuffles can be split where one hub has very many rows.
    sizes = written(links.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "op2-hubs")
    part = F.when(F.col("n") > quota, F.pmod(F.xxhash64("rid"), F.ceil(F.col("n") / largest))).otherwise(0)
    # Parts of an oversize hub start together in neighbouring shards; all others start by hash.
    start = F.when(F.col("n") > quota, F.pmod(F.xxhash64("hub") + F.floor(part * largest / quota), F.lit(k)).cast("int"))
    links = written(links.join(sizes, "hub").select("rid", start.alias("start"), F.xxhash64("hub", part).alias("hub"), F.least(F.col("n"), F.lit(largest)).alias("n")), "op2-links")
    begin = F.coalesce(F.max_by("start", "n"), F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(k)).cast("int"))
    labels = links.groupBy("rid").agg(F.min("hub").alias("unit"), F.max("n").alias("unit_n"), begin.alias("shard"))
    labels = written(labels, "op2-labels")
    for turn in range(rounds):
        placed = links.join(labels.select("rid", "shard"), "rid")
        votes = placed.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("votes"))
        full = [r["shard"] for r in labels.groupBy("shard").count().collect() if r["count"] >= quotas[r["shard"]]]
        open_ = ~F.col("v.shard").isin(full) | (F.col("v.shard") == F.col("own")) if full else F.lit(True)
        own = links.select("rid", "hub").join(labels.select("rid", F.col("shard").alias("own")), "rid")
        score = own.join(votes.alias("v"), "hub").filter(open_).groupBy("rid", "v.shard").agg(F.sum("votes").alias("votes"))
        best = score.join(labels.select("rid", "unit"), "rid").groupBy("rid").agg(F.max_by("shard", F.struct("votes", F.xxhash64("unit", "shard"))).alias("want"))
        level = 47 - F.least(F.lit(47), F.floor(F.log2(F.greatest(F.lit(1), F.col("unit_n")))))
        bucket = (level * PARTS + F.pmod(F.xxhash64("unit"), F.lit(PARTS))).cast("int")
        wish = written(labels.join(best, "rid", "left").withColumn("want", F.coalesce("want", "shard")).withColumn("bucket", bucket), f"op2-wish{turn}")
        stay, come = [0] * k, [[] for _ in range(k)]
        for r in wish.groupBy("want", "bucket", (F.col("want") == F.col("shard")).alias("stays")).count().orderBy("want", "bucket").collect():
            if r["stays"]:
                stay[r["want"]] += r["count"]
            else:
                come[r["want"]].append((r["bucket"], r["count"]))
        admitted, moved = [], 0
        for s in range(k):
            room = quotas[s] - stay[s]
            for b, n in come[s]:
                if n <= room:
                    room -= n
                    moved += n
                    admitted.append((s, b))
        if not moved:
            break
        # At most shards x levels x PARTS rows, whatever the data.
        moves = labels.sparkSession.createDataFrame([(s, b, True) for s, b in admitted], "want int, bucket int, goes boolean")
        moved_to = wish.join(F.broadcast(moves), ["want", "bucket"], "left").withColumn("shard", F.when(F.col("goes"), F.col("want")).otherwise(F.col("shard")))
        labels = written(moved_to.select("rid", "unit", "unit_n", "shard"), f"op2-labels{turn}")
    return labels.select("rid", "shard", "unit_n")


def deal(counts: list[int], room: list[int]) -> list[list[int]]:
    """Integers a[c][s] with row sums ``counts`` and column sums ``room`` (equal totals), each class spread in proportion."""
    total, k = sum(room), len(room)
    given, out, done = [0] * k, [], 0
    for n in counts:
        done += n
        ideal = [done * r / total if total else 0.0 for r in room]
        row = [max(0, int(x) - g) for x, g in zip(ideal, given, strict=True)]
        while sum(row) > n:
            row[max(range(k), key=lambda s: (row[s], -s))] -= 1
        rest = sorted(range(k), key=lambda s: (given[s] + row[s] - ideal[s], s))
        while sum(row) < n:
            for s in rest:
                if sum(row) < n and given[s] + row[s] < room[s]:
                    row[s] += 1
        given = [g + x for g, x in zip(given, row, strict=True)]
        out.append(row)
    return out


def shards(nodes: DataFrame, links: DataFrame, n_shards: int = N_SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """nodes (rid, size, ...) and links (rid, hub) -> nodes plus shard and slot; shard sizes in rows differ by one at most."""
    total = nodes.count()
    quotas = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    buckets = n_buckets(total)
    linked = propagate(links, quotas, rounds)
    placed = nodes.join(linked, "rid", "left")
    # Of an overfull shard's linked rows, those of the smallest hubs give way; the rest of the rows fill up.
    level = F.least(F.lit(47), F.floor(F.log2(F.greatest(F.lit(1), F.coalesce(F.col("unit_n"), F.lit(1)))))).cast("int")
    placed = written(placed.withColumn("level", level), "op2-placed")
    held = placed.filter("shard IS NOT NULL")
    sizes = [[0] * 48 for _ in range(n_shards)]
    for r in held.groupBy("shard", "level").count().collect():
        sizes[r["shard"]][r["level"]] = r["count"]
    keep = []  # per shard: levels above stay whole, of this level so many rows stay
    for s in range(n_shards):
        room, at = quotas[s], 47
        while at >= 0 and sizes[s][at] <= room:
            room -= sizes[s][at]
            at -= 1
        keep.append((at, room))
    if any(at >= 0 for at, _ in keep):
        order = ranked(held, ["shard", "level"], ["rid"], "r", buckets)
        edge = F.array(*(F.lit(at) for at, _ in keep))
        most = F.array(*(F.lit(n) for _, n in keep))
        at, n = F.element_at(edge, F.col("shard") + 1), F.element_at(most, F.col("shard") + 1)
        stays = (F.col("level") > at) | ((F.col("level") == at) & (F.col("r") < n))
        held = order.withColumn("shard", F.when(stays, F.col("shard"))).drop("r")
        placed = written(held.unionByName(placed.filter("shard IS NULL")), "op2-evened")
    room = list(quotas)
    for r in placed.filter("shard IS NOT NULL").groupBy("shard").count().collect():
        room[r["shard"]] -= r["count"]
    loose = placed.filter("shard IS NULL").drop("shard").withColumn("class", F.floor(F.log2(F.greatest(F.lit(1), F.col("size")))).cast("int"))
    found = {r["class"]: r["count"] for r in loose.groupBy("class").count().collect()}
    classes = sorted(found, reverse=True)
    if classes:
        rows = deal([found[c] for c in classes], room)
        bounds = {c: [sum(row[: s + 1]) for s in range(n_shards)] for c, row in zip(classes, rows, strict=True)}
        by_class = F.create_map(*(x for c in classes for x in (F.lit(c), F.array(*(F.lit(b) for b in bounds[c])))))
        loose = ranked(loose, ["class"], ["rid"], "r", buckets)
        loose = loose.withColumn("_bounds", by_class[F.col("class")]).withColumn("shard", F.expr("size(filter(_bounds, b -> b <= r))").cast("int"))
        placed = placed.filter("shard IS NOT NULL").unionByName(loose.drop("class", "r", "_bounds").select(placed.columns))
    placed = written(placed.drop("unit_n", "level"), "op2-shards")
    return ranked(placed, ["shard"], ["rid"], "slot", buckets)


def named_rows(rows: DataFrame) -> DataFrame:
    """rows (doc_id, hub, ...), written, with ``rid``: 16 bytes of a digest of doc_id, hub and the number of the repeat.

    Repeats are numbered within the partitions they were read in, and those counts are added up, so that a row repeated very often isn't one task.
    """
    rows = written(rows.withColumn("_in", F.spark_partition_id()), "op2-rows")
    same = F.expr("r.doc_id <=> s.doc_id AND r.hub = s.hub")
    often = written(rows.groupBy("doc_id", "hub").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"), "op2-often")
    marked = rows.alias("r").join(often.withColumn("_often", F.lit(True)).alias("s"), same, "left").select("r.*", "s._often")
    name = lambda k: F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "hub", k).cast("binary")))
    once = marked.filter("_often IS NULL").withColumn("rid", name(F.lit("0")))
    again = marked.filter("_often IS NOT NULL")
    earlier = Window.partitionBy("doc_id", "hub").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    before = again.groupBy("doc_id", "hub", "_in").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    numbered = again.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "hub", "_in").orderBy("size")))
    numbered = numbered.alias("r").join(before.alias("s"), F.expr("r.doc_id <=> s.doc_id AND r.hub = s.hub AND r._in = s._in")).select("r.*", "s._before")
    numbered = numbered.withColumn("rid", name((F.col("_before") + F.col("_k")).cast("string"))).drop("_k", "_before")
    return written(once.unionByName(numbered).drop("_in", "_often"), "op2-named")


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Per document row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under the law ``rows``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = core(docs, "doc_id", "text").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("hub")
    )
    rows = named_rows(rows)
    out = shards(rows.drop("hub"), rows.select("rid", "hub"), n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


__all__ = ["deal", "propagate", "shard_documents", "shards"]
