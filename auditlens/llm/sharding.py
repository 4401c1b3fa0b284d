"""Shards by balanced label propagation (operator 3, DataFrame functions only).

Documents that share a hub (for the registered query: an equal text) should
share a shard, while every shard holds the same number of rows, to one.  Links
are kept as (document, hub) rows, so a group of n copies is n rows, not n*n/2
edges.

Labels start neutral: rows are dealt evenly by a hash.  In each round hubs count
their members' shards, each linked document asks for the shard with most of its
neighbours (a hash of hub and shard breaks ties, so that members agree), and
moves are granted in balance: pairs and cycles of shards swap, and what is left
swaps with unlinked documents.  Row counts never change, so the law ``rows`` holds
at every step; rounds end when nothing is granted or after ``rounds``.

The rounds leave some groups cut, where quotas were short or a group needs more
room than its neighbours leave.  A repair by falling size lets every group stay
at its label while there is room, and moves the others to the best-fitting shard;
groups that fit nowhere whole fill the gaps.

The driver sees at most shards * shards counts a round, and at the end the numbers
of groups by size and label.  Moves are picked by two-level numbers, so no window
holds a whole shard.  Only a hub with more members than a shard has rows is
split, into whole shards and a rest.  Joins by hub broadcast the hubs with more
than one in ``HOT_PARTS`` of all links, of which there are fewer than that, and deal
out the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm.common import drop, number_rows, slices_for, written

#: A hub is hot with more than this part of all links.
HOT_PARTS = 1000


def _cycle(edges) -> list[tuple[int, int]]:
    """The edges of one cycle; none if there is no cycle."""
    after: dict[int, list[int]] = {}
    for i, j in edges:
        after.setdefault(i, []).append(j)
    done: set[int] = set()

    def walk(path):
        for j in after.get(path[-1], ()):
            if j in path:
                ring = path[path.index(j):] + [j]
                return list(zip(ring[:-1], ring[1:], strict=True))
            if j not in done and (found := walk(path + [j])):
                return found
        done.add(path[-1])
        return []

    return next((found for i in sorted(after) if i not in done and (found := walk([i]))), [])


def _repair(groups: dict[tuple[int, int], int], room: list[int]) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Shards of groups, from their numbers by (size, label): ((size, label, first rank, rank after the last, shard) runs, room left).

    By falling size, groups stay at their label while there is room; the others
    go to the fullest shard that takes them.
    """
    runs, room = [], list(room)
    for size in sorted({k[0] for k in groups}, reverse=True):
        over = {}
        for label in range(len(room)):
            n = groups.get((size, label), 0)
            k = min(n, room[label] // size)
            if k:
                runs.append((size, label, 0, k, label))
                room[label] -= k * size
            if n > k:
                over[label] = (k, n)
        for label, (at, n) in over.items():
            for shard in sorted(range(len(room)), key=lambda x: (room[x], x)):
                k = min(n - at, room[shard] // size)
                if k:
                    runs.append((size, label, at, at + k, shard))
                    room[shard] -= k * size
                    at += k
    return runs, room


def _grants(wants: dict[tuple[int, int], int], free: dict[int, int]) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """(linked moves granted by (from, to), unlinked rows sent back by (from, to))."""
    linked, back, left = {}, {}, dict(free)
    for (i, j), n in sorted(wants.items()):
        linked[i, j] = min(n, wants.get((j, i), 0))
    open_ = {k: n - linked[k] for k, n in sorted(wants.items()) if n > linked[k]}
    while cycle := _cycle(open_):
        k = min(open_[e] for e in cycle)
        for e in cycle:
            linked[e] += k
            open_[e] -= k
            if not open_[e]:
                del open_[e]
    for (i, j), n in sorted(wants.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - linked[i, j], left.get(j, 0))
        if more > 0:
            linked[i, j] += more
            back[j, i] = back.get((j, i), 0) + more
            left[j] -= more
    return {k: v for k, v in linked.items() if v}, back


def _by_hub(rows: DataFrame, hubs: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` (hub, part, hot, ..) with rows of ``hubs`` (hub, part, hot, ..): hot hubs are broadcast."""
    few = F.broadcast(hubs.where("hot").drop("hot"))  # fewer than HOT_PARTS hubs, their parts and shards
    return (rows.where("hot").join(few, ["hub", "part"], how)
            .unionByName(rows.where("NOT hot").join(hubs.where("NOT hot").drop("hot"), ["hub", "part"], how)))


def _parted(links: DataFrame, most: int, slices: int) -> DataFrame:
    """(node, hub, part, hot) of the links of hubs with two members or more; a hub above ``most`` members is cut into parts."""
    sizes = written(links.groupBy("hub").agg(F.count("*").alias("members")).where("members > 1"), "hubs")
    total = sizes.agg(F.sum("members")).first()[0] or 0
    few = F.broadcast(sizes.where(F.col("members") * HOT_PARTS > total))  # fewer than HOT_PARTS rows
    hot = links.join(few, "hub").withColumn("hot", F.lit(True))
    cold = (links.join(few, "hub", "left_anti").join(sizes.where(F.col("members") * HOT_PARTS <= total), "hub").withColumn("hot", F.lit(False)))
    sized = hot.unionByName(cold).select("node", "hub", "members", "hot")
    whole = sized.where(F.col("members") <= most).select("node", "hub", F.lit(0).cast("bigint").alias("part"), "hot")
    cut = (number_rows(sized.where(F.col("members") > most).select("node", "hub", "hot"), ["hub"], F.col("node"), slices, "row")
           .select("node", "hub", F.expr(f"row div {most}").alias("part"), "hot"))
    out = written(whole.unionByName(cut), "links")
    drop(sizes)
    return out


def cut_links(links: DataFrame, state: DataFrame) -> int:
    """Links (of parted hubs) whose node is not in the shard where most of the hub's members are."""
    votes = links.join(state.select("node", "shard"), "node").groupBy("hub", "part", "shard").agg(F.count("*").alias("n"))
    per_hub = votes.groupBy("hub", "part").agg(F.sum("n").alias("all"), F.max("n").alias("most"))
    return per_hub.agg(F.sum(F.col("all") - F.col("most"))).first()[0] or 0


def _round(state: DataFrame, links: DataFrame, slices: int, name: str) -> DataFrame | None:
    """State after one round of asking and granting; None if nothing was granted."""
    spark = state.sparkSession
    own = links.join(state.select("node", "shard"), "node")
    votes = (own.groupBy("hub", "part", "hot", "shard").agg(F.count("*").alias("votes"))
             .withColumn("tie", F.xxhash64("hub", "part", "shard")))
    asked = (_by_hub(links, votes).groupBy("node", "shard").agg(F.sum("votes").alias("votes"), F.max("tie").alias("tie"))
             .groupBy("node").agg(F.max(F.struct("votes", "tie", "shard")).alias("best")).select("node", F.col("best.shard").alias("to")))
    now = written(state.where("linked").join(asked, "node").where("shard <> to").select("node", "shard", "to"), f"{name}-wishes")
    wants = {(r["shard"], r["to"]): r["n"] for r in now.groupBy("shard", "to").agg(F.count("*").alias("n")).collect()}
    free = {r["shard"]: r["n"] for r in state.where("NOT linked").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    linked_moves, back = _grants(wants, free)
    if not linked_moves:
        drop(now)
        return None
    quota = spark.createDataFrame([(i, j, k) for (i, j), k in linked_moves.items()], "shard int, to int, quota long")
    chosen = (number_rows(now, ["shard", "to"], F.col("node"), slices, "row").join(F.broadcast(quota), ["shard", "to"])
              .where("row < quota").select("node", "to"))
    if back:
        ranges, at = [], {}
        for (i, j), k in sorted(back.items()):
            ranges.append((i, j, at.get(i, 0), at.get(i, 0) + k))
            at[i] = at.get(i, 0) + k
        give = spark.createDataFrame(ranges, "shard int, to int, lo long, hi long")
        spare = number_rows(state.where("NOT linked").select("node", "shard"), ["shard"], F.col("node"), slices, "row")
        chosen = chosen.unionByName(spare.join(F.broadcast(give), "shard").where("row >= lo AND row < hi").select("node", "to"))
    nxt = written(state.join(chosen, "node", "left").select("node", F.coalesce("to", "shard").cast("int").alias("shard"), "linked"), name)
    drop(now)
    return nxt


def _repaired(state: DataFrame, links: DataFrame, n: int, n_shards: int, slices: int, name: str) -> DataFrame:
    """State with the groups that are still cut made whole where they fit; a node's first hub is its group."""
    spark = state.sparkSession
    home = written(links.groupBy("node").agg(F.min(F.struct(F.xxhash64("hub", "part").alias("h"), "hub", "part", "hot")).alias("x"))
                   .select("node", "x.hub", "x.part", "x.hot"), f"{name}-home")
    groups = written(home.join(state.select("node", "shard"), "node").groupBy("hub", "part", "hot", "shard").agg(F.count("*").alias("n"))
                     .groupBy("hub", "part", "hot").agg(F.sum("n").alias("size"), F.max(F.struct("n", F.xxhash64("hub", "part", "shard").alias("t"), "shard")).alias("x"))
                     .select("hub", "part", "hot", "size", F.col("x.shard").alias("label")), f"{name}-groups")
    counts = {(r["size"], r["label"]): r["n"] for r in groups.groupBy("size", "label").agg(F.count("*").alias("n")).collect()}
    runs, room = _repair(counts, [n // n_shards + (i < n % n_shards) for i in range(n_shards)])
    runs = spark.createDataFrame(runs, "size long, label int, lo long, hi long, shard int")
    ends = [sum(room[:i]) for i in range(n_shards + 1)]
    gaps = spark.createDataFrame([(ends[i], ends[i + 1], i) for i in range(n_shards)], "lo long, hi long, shard int")
    # as many runs as there are sizes, labels and shards
    placed = (number_rows(groups, ["size", "label"], F.struct("hub", "part"), slices, "row").join(F.broadcast(runs), ["size", "label"])
              .where("row >= lo AND row < hi").select("hub", "part", "hot", "shard"))
    spots = written(state.select("node", "linked").join(_by_hub(home, placed).select("node", "shard"), "node", "left"), f"{name}-spots")
    rest = (number_rows(spots.where("shard IS NULL").drop("shard"), [], F.col("node"), slices, "row")
            .join(F.broadcast(gaps), F.expr("row >= lo AND row < hi")).select("node", "shard", "linked"))
    out = written(spots.where("shard IS NOT NULL").select("node", "shard", "linked").unionByName(rest), name)
    for used in (home, groups, spots):
        drop(used)
    return out


def propagate(nodes: DataFrame, links: DataFrame, n_shards: int, rounds: int = 6, name: str = "shards", trace: list | None = None) -> DataFrame:
    """(node, shard): even shards (row counts at most one apart) with few hub members apart.

    ``nodes`` has a unique ``node``; ``links`` has (node, hub) rows, any number
    per node.  Deterministic for given nodes and links.  ``trace`` takes the
    number of cut links at the start, after each round and after the repair.
    """
    n = nodes.count()
    slices = slices_for(n)
    links = _parted(links, max(1, -(-n // n_shards)), slices)
    linked = links.select("node").distinct().withColumn("linked", F.lit(True))
    start = number_rows(nodes.select("node"), [], F.struct(F.xxhash64("node"), "node"), slices, "row")
    state = written(start.join(linked, "node", "left").select("node", F.expr(f"cast(row * {n_shards} div {max(1, n)} as int)").alias("shard"),
                                                               F.coalesce("linked", F.lit(False)).alias("linked")), name)

    def note():
        if trace is not None:
            trace.append(cut_links(links, state))

    note()
    for _ in range(rounds):
        nxt = _round(state, links, slices, name)
        if nxt is None:
            break
        drop(state)
        state = nxt
        note()
    nxt = _repaired(state, links, n, n_shards, slices, name)
    drop(state)
    state = nxt
    note()
    drop(links)
    return state.select("node", "shard")


def shard_documents(docs: DataFrame, n_shards: int = 16, rounds: int = 6) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every document row; links are equal texts.

    The law is ``rows``: shard sizes differ by at most one row.  Null texts
    count as empty ones (size 1) and equal each other.  Rows are told apart by
    position, so repeated rows and null ids are fine; only doc_id and text are
    read, so further columns of any name do not clash.  Very long texts count by
    their bytes only.  Ties between shards go by a hash.  An empty table gives an empty result.  Slots number each shard from
    0 without gaps.  grown_shard is null: growing moves rows under this law.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    base = written(docs.select(F.monotonically_increasing_id().alias("node"), "doc_id", (F.octet_length(t) + 1).cast("bigint").alias("size"),
                               F.crc32(t).alias("text_crc32"), F.struct(F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(1), t).alias("h2")).alias("hub")), "rows")
    shards = propagate(base, base.select("node", "hub"), n_shards, rounds)
    out = number_rows(base.select("node", "doc_id", "size", "text_crc32").join(shards, "node"), ["shard"], F.col("node"), slices_for(base.count()), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
