"""Sharding, packing, components, numbering, and the pipeline."""

import random
from collections import Counter

import pytest
from helpers import DOCS, contamination, corpus, frame, prose, similar


# -- helpers ----------------------------------------------------------------

def test_numbers_are_gapless(spark):
    from pyspark.sql import functions as F

    from auditlens.llm.common import number_rows
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("g"))
    for slices in (1, 7):
        got = number_rows(df, ["g"], F.col("id"), slices, "n").collect()
        for g in ("hot", "cold"):
            assert sorted(r.n for r in got if r.g == g) == list(range(sum(r.g == g for r in got)))
        assert sorted(r.n for r in number_rows(df, [], F.col("id"), slices, "n").collect()) == list(range(1000))


def test_components(spark):
    from auditlens.llm.common import components
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


# -- 3 sharding -------------------------------------------------------------

def test_shards_are_even_and_groups_meet(spark):
    from auditlens.llm.sharding import shard_documents
    rows = corpus() + [(None, "same"), (407, "same")] + [(1000 + i, f"text {i}") for i in range(300)] + [(2000 + i, f"pair {i % 40}") for i in range(80)]
    got = shard_documents(frame(spark, rows)).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"rows"}
    count = Counter(r.shard for r in got)
    assert max(count.values()) - min(count.values()) <= 1 and set(count) == set(range(16))
    for s in count:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    assert sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 1 for _, t in rows)
    shard = {r.doc_id: r.shard for r in got}
    assert sum(shard[2000 + i] != shard[2040 + i] for i in range(40)) <= 4  # pairs of equal texts


def test_hot_group_keeps_the_law(spark):
    from auditlens.llm.sharding import shard_documents
    got = shard_documents(frame(spark, [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(321)])).collect()
    count = Counter(r.shard for r in got)
    assert len(got) == 321 and max(count.values()) - min(count.values()) <= 1
    assert shard_documents(spark.createDataFrame([], DOCS)).count() == 0
    assert {r.shard for r in shard_documents(frame(spark, [(1, "a"), (2, None)])).collect()} == {0, 1}


@pytest.mark.parametrize("pairs, hot", [(0, 0.05), (0.7, 0), (0.9, 0), (0.4, 1 / 3)])
def test_only_groups_that_must_be_cut_are_cut(spark, pairs, hot):
    from auditlens.llm.sharding import shard_documents
    n = 3200
    texts = ["hot"] * int(hot * n) + [f"pair {i // 2}" for i in range(int(pairs * n))]
    texts += [f"t{i}" for i in range(n - len(texts))]
    got = shard_documents(frame(spark, list(enumerate(texts)))).collect()
    count, where = Counter(r.shard for r in got), {}
    assert len(got) == n and set(count.values()) == {n // 16}
    for r in got:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert len(where.pop("hot", ())) == -(-int(hot * n) * 16 // n)  # as few shards as it needs
    assert all(len(x) == 1 for x in where.values())


def test_grants_go_round_cycles():
    from auditlens.llm.sharding import _grants, _repair
    assert _grants({(0, 1): 5, (1, 2): 3, (2, 0): 4}, {}) == ({(0, 1): 3, (1, 2): 3, (2, 0): 3}, {})
    # by falling size: at the label while there is room, else where it fits best
    assert _repair({(6, 0): 1, (4, 0): 2, (2, 1): 1}, [8, 8]) == ([(6, 0, 0, 1, 0), (4, 0, 0, 2, 1), (2, 1, 0, 1, 0)], [0, 0])
    assert _repair({(4, 1): 2, (2, 0): 1}, [4, 8]) == ([(4, 1, 0, 2, 1), (2, 0, 0, 1, 0)], [2, 0])


def test_growing_the_grant_never_exceeds_supply():
    from auditlens.llm.sharding import _grants
    linked, back = _grants({(0, 1): 5, (1, 0): 2, (2, 1): 4}, {0: 0, 1: 4, 2: 0})
    assert linked == {(0, 1): 5, (1, 0): 2, (2, 1): 1} and back == {(1, 0): 3, (1, 2): 1}


# -- 10 packing -------------------------------------------------------------

@pytest.mark.parametrize("seed", range(5))
def test_plan_places_every_piece_once(seed):
    from auditlens.llm.packing import _cut, plan_bins
    rng = random.Random(seed)
    caps = (16, 32, 64)
    histogram = {rng.randrange(1, 65): rng.randrange(1, 40) for _ in range(30)}
    rows = _cut(*plan_bins(histogram, caps))
    bins = {}
    for length, n in histogram.items():
        for rank in range(n):
            (run,) = [r for r in rows if r[0] == length and r[1] <= rank < r[2]]
            _, lo, _, per, first, offset, capacity = run
            b = bins.setdefault(first + (rank - lo) // per, (capacity, []))
            assert b[0] == capacity
            b[1].append((offset + (rank - lo) % per * length, length))
    assert sorted(bins) == list(range(len(bins)))
    for capacity, pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity and capacity == min(c for c in caps if c >= at)  # downsized to its contents


def test_best_fit_prefers_the_tightest_bin():
    from auditlens.llm.packing import plan_bins
    _, bins = plan_bins({60: 1, 50: 1, 14: 1, 4: 1}, (64,))
    assert sum(n for _, n, _ in bins) == 2  # 60 + 4 and 50 + 14


def test_packed_documents(spark):
    from auditlens.llm.packing import pack_documents
    rows = corpus() + [(None, "no id"), (3, "again")]
    got = pack_documents(frame(spark, rows), capacities=(64, 256)).collect()
    by_bin = {}
    for r in got:
        by_bin.setdefault(r.bin, []).append(r)
    for pieces in by_bin.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.n_tokens
        assert at <= pieces[0].capacity
    assert sorted(r.start for r in got if r.doc_id == 406) == [256 * i for i in range(sum(r.doc_id == 406 for r in got))]
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    assert {r.n_tokens for r in got if r.doc_id in (400, 401)} == {1}
    assert pack_documents(spark.createDataFrame([], DOCS)).count() == 0


# -- pipeline ---------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P
    rng = random.Random(8)
    items = [(i, prose(rng, 20)) for i in range(4)]
    rows = [r for r in corpus() if r[0] not in (406,)] + [(700 + i, f"{prose(rng, 40)} {items[i][1]} {prose(rng, 30)}") for i in range(4)]
    rows += [(800, prose(rng, 60) + " mail me@example.org or 10.1.2.3")]
    path = f"file://{tmp_path}/in"
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in P.STAGES:
        out = f"file://{tmp_path}/{name}"
        stage(spark, docs, path).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == before.columns
    from helpers import base_figures, base_spans
    want = [(i, t) for i, t in rows if (f := base_figures(t))[0] >= 20 and 100 * f[4] <= 30 * f[0]]
    assert set(seen["quality_rules"]) == {i for i, _ in want}
    want = [r for r, (c, _) in zip(want, similar(want), strict=True) if r[0] == c]
    assert set(seen["near_duplicates"]) == {i for i, _ in want}
    hit = contamination(want, items)
    want = [r for k, r in enumerate(want) if not hit[k][1]]
    assert set(seen["decontamination"]) == {i for i, _ in want}
    assert set(seen["personal_data"]) == {i for i, _ in want} == set(seen["packing"])
    assert "[EMAIL]" in seen["personal_data"][800].text and "[IP]" in seen["personal_data"][800].text
    assert all(not base_spans(r.text) and r.n_chars == len(r.text) for r in seen["personal_data"].values())
    assert {r.doc_id for r in P.run(spark, path).collect()} == set(seen["packing"])


def test_queries_are_registered():
    import __spark_entry__ as E
    names = E.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in names} and "pipeline" in names


@pytest.mark.parametrize("parts", [1000, 3])
def test_cut_links_fall_round_by_round(spark, monkeypatch, parts):
    """Neutral start, quota-bound rounds, repair; with hot hubs broadcast and with most hubs dealt out."""
    from pyspark.sql import functions as F

    from auditlens.llm import sharding as S
    monkeypatch.setattr(S, "HOT_PARTS", parts)
    nodes = spark.range(3200).select(F.col("id").alias("node"))
    hub = F.when(F.col("node") < 300, F.lit(-1)).when(F.col("node") < 2400, F.floor(F.col("node") / 3)).otherwise(F.col("node") + 10_000)
    trace = []
    got = S.propagate(nodes, nodes.select("node", hub.cast("bigint").alias("hub")), 16, trace=trace).collect()
    count = Counter(r.shard for r in got)
    assert set(count.values()) == {200}
    assert len(trace) >= 4 and all(a > b for a, b in zip(trace[:3], trace[1:4]))  # the rounds do the work
    assert trace[-2] < 0.35 * trace[0] and trace[-1] <= trace[-2]
    where = {}
    for r in got:
        where.setdefault(-1 if r.node < 300 else r.node // 3 if r.node < 2400 else r.node + 10_000, set()).add(r.shard)
    assert len(where.pop(-1)) == 2 and sum(len(s) > 1 for s in where.values()) <= 2
    again = {r.node: r.shard for r in S.propagate(nodes, nodes.select("node", hub.cast("bigint").alias("hub")), 16).collect()}
    assert again == {r.node: r.shard for r in got}


def test_nodes_with_several_hubs(spark):
    """Rings of documents linked to their neighbours: far fewer links are cut than by the start."""
    from pyspark.sql import functions as F

    from auditlens.llm import sharding as S
    nodes = spark.range(800).select(F.col("id").alias("node"))
    ring = F.floor(F.col("node") / 40) * 100
    at = F.pmod(F.col("node"), F.lit(40))
    links = nodes.select("node", (ring + F.floor(at / 2)).alias("hub")).unionByName(nodes.select("node", (ring + 50 + F.floor(F.pmod(at + 1, F.lit(40)) / 2)).alias("hub")))
    trace = []
    got = S.propagate(nodes, links, 8, trace=trace).collect()
    count = Counter(r.shard for r in got)
    assert set(count.values()) == {100} and trace[-1] < trace[0]


def test_sharding_odd_rows(spark):
    from pyspark.sql import functions as F

    from auditlens.llm.sharding import shard_documents
    rows = [(None, None), (None, ""), (1, "x" * 200_000), (1, "x" * 200_000), (2, "tie"), (3, "tie"), (4, "é😀")] + [(10 + i, f"t{i}") for i in range(40)]
    df = frame(spark, rows).withColumns({c: F.lit("x") for c in ("node", "hub", "part", "hot", "shard", "slot", "law", "row", "linked")})
    got = shard_documents(df).collect()
    count = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(count.values()) - min(count.values()) <= 1
    assert sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 1 for _, t in rows)
    assert len({r.shard for r in got if r.doc_id == 1}) == 1


CLASHES = ("k", "k1", "t1", "t2", "source", "kept", "row", "rows", "node", "word", "w", "at", "own", "unnamed", "id", "hit_doc", "n_tokens", "bin", "piece", "__row")


def test_pipeline_odd_rows(spark, tmp_path):
    """Null ids and columns, equal rows, very long texts, clashing columns: every stage runs and keeps what is clean."""
    from pyspark.sql import functions as F

    import corpus_pipeline as P
    rng = random.Random(31)
    items = [(1, prose(rng, 20)), (2, None), (None, prose(rng, 15)), (3, "")]
    good = [prose(rng, 50, 5000) for _ in range(6)]
    rows = [(None, good[0]), (None, good[1]), (7, good[2]), (7, good[3]), (8, good[4]), (8, good[4]), (9, None), (10, ""), (11, prose(rng, 60_000, 50_000)),
            (12, good[5] + " " + items[0][1]), (None, None), (13, " \n ")]
    path = f"file://{tmp_path}/in"
    extra = {c: F.lit("x") for c in CLASHES if c != "source"}
    docs = frame(spark, rows).withColumn("lang", F.lit(None).cast("string")).withColumns(extra)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").withColumns(extra).write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(7, 1, None), (None, 0, 0), (8, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in P.STAGES:
        before, out = docs, f"file://{tmp_path}/{name}"
        stage(spark, docs, path).write.parquet(out)
        docs = spark.read.parquet(out)
        if name != "packing":
            assert docs.columns == before.columns
            kept[name] = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    clean = [(None, good[0]), (None, good[1]), (7, good[2]), (7, good[3]), (8, good[4]), (11, rows[8][1])]
    assert kept["quality_rules"] == sorted([*clean, (8, good[4]), (12, rows[9][1])], key=repr)
    assert kept["near_duplicates"] == sorted([*clean, (12, rows[9][1])], key=repr)
    assert kept["decontamination"] == kept["personal_data"] == sorted(clean, key=repr)
    packed = docs.collect()
    assert len(packed) > len(clean) and {r.doc_id for r in packed} == {None, 7, 8, 11}


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as P
    path = f"file://{tmp_path}/in"
    spark.createDataFrame([], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert P.run(spark, path).count() == 0


def test_packing_odd_rows(spark):
    """Equal rows, clashing columns, a text longer than the largest bin, ties in length."""
    from pyspark.sql import functions as F

    from auditlens.llm.packing import CAPACITIES, pack_documents
    rows = [(1, "same words here"), (1, "same words here"), (None, None), (None, None), (2, ""), (3, prose(random.Random(1), 9000)), (4, "same words here")]
    df = frame(spark, rows).withColumns({c: F.lit("x") for c in CLASHES if c != "source"})
    got = pack_documents(df).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(i for i, _ in rows)
    used = {}
    for r in sorted(got, key=lambda r: (r.bin, r.offset)):
        assert r.offset >= used.get(r.bin, 0) and r.offset + r.n_tokens <= r.capacity and r.capacity in CAPACITIES
        used[r.bin] = r.offset + r.n_tokens
    long = sorted((r.start, r.n_tokens) for r in got if r.doc_id == 3)
    assert len(long) > 1 and all(a + n == b for (a, n), (b, _) in zip(long[:-1], long[1:], strict=True))
