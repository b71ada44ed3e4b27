"""What must not grow with the tables: sides of joins in the driver, pairs of a block, tiles of a task."""

import pytest

from lorekeeper.plans import queries_ingestion as ingestion

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["s19_edge_upsert"])
def test_write_path_broadcasts_no_table(spark, name):
    found = plan(getattr(ingestion, name)(spark, SF_DIR))
    assert "SortMergeJoin" in found and "BroadcastExchange" not in found


def test_postings_are_not_copied_for_each_query(spark, monkeypatch):
    from lorekeeper.operators import text_index

    docs = spark.createDataFrame([(i, "one two" if i % 3 else "one") for i in range(60)], "id long, text string")
    index, written, write = text_index.build_text_index(docs), [], text_index.materialise
    monkeypatch.setattr(text_index, "materialise", lambda df, name: written.append(df.columns) or write(df, name))
    monkeypatch.setattr(text_index, "SHARD", 7)
    monkeypatch.setattr(text_index, "QUERIES", 9)
    asked = spark.createDataFrame([(q, "one two") for q in range(40)], "query_id long, text string")
    found = text_index.text_search_all(index, asked, 3).collect()
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in found) == [(q, r, i) for q in range(40) for r, i in enumerate((1, 2, 4))]
    assert not any("ids" in columns for columns in written)
    # A reader unpacks 4,096 blocks of 16 bytes an entry at a time.
    assert 4096 * text_index.BLOCK * 16 <= 32 << 20


def test_long_numbers_name_no_video(spark, tmp_path):
    from lorekeeper.plans.queries_surface import n8_video_inputs

    spark.createDataFrame([(i,) for i in (1, 2, 12345, 100001, 100002, 1234567)], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["url"]: r["found"] for r in n8_video_inputs(spark, str(tmp_path)).collect()}
    assert found == {f"https://youtu.be/{x}": x[0] == "x" for x in ("short1", "xxxxxxxxxx2", "short12345", "short100001", "xxxxx100002", "short1234567")}


def test_one_text_query_builds_no_index(spark, monkeypatch):
    from lorekeeper.operators import text_index
    from lorekeeper.plans.queries_search import h1_rank_fusion, h2_hybrid_search, t1_text_top_k

    monkeypatch.setattr(text_index, "build_text_index", lambda *_, **__: pytest.fail("an index for one query"))
    from lorekeeper.plans import queries_search

    monkeypatch.setattr(queries_search, "_INDEXES", {})
    assert [f(spark, SF_DIR).count() > 0 for f in (t1_text_top_k, h1_rank_fusion, h2_hybrid_search)] == [True] * 3


def test_banded_pairs(spark):
    from lorekeeper.operators import ordering
    from lorekeeper.plans.queries_more import j7_blocked_theta_join

    left = [(i, i % 3) for i in range(-30, 40, 7)]
    right = [(i, i % 3) for i in range(-40, 50)]
    a, b = spark.createDataFrame(left, "a long, block int"), spark.createDataFrame(right, "b long, block int")
    for width in (0, 1, 5, 20):
        got = sorted((r["a"], r["b"]) for r in ordering.banded_pairs(a, b, ["block"], "a", "b", width).collect())
        assert got == sorted((x, y) for x, g in left for y, h in right if g == h and abs(x - y) <= width)
    assert "__band" in plan(j7_blocked_theta_join(spark, SF_DIR))


def test_edges_of_walks(spark, monkeypatch):
    """Ids are not written; distinct items and their orders take one shuffle; chunk names need no texts of chunks."""
    from lorekeeper.plans import graph

    made = []
    monkeypatch.setattr(graph, "written_once", lambda _, name, make: made.append(make()) or made[-1])
    walked = graph.walkable_edges(spark, SF_DIR)
    assert "id" not in made[0].columns and "user_id" in made[0].columns
    want = graph.edges(spark, SF_DIR)
    assert sorted(r["id"] for r in walked.collect()) == sorted(r["id"] for r in want.collect())
    texts = plan(graph.nodes(spark, SF_DIR).where("type = 'chunk'").select("id"))
    assert "split(" not in texts
    docs = spark.createDataFrame([(0, None), (1, " \n"), (2, "a"), (3, "a " * 448), (4, "a " * 449), (5, "a " * 900)], "doc_id long, text string")
    places = lambda df: sorted((r["doc_id"], r["chunk_index"]) for r in df.collect())
    assert places(graph.chunk_places(docs)) == places(graph.chunks(docs)) == [(2, 0), (3, 0), (4, 0), (4, 1), (5, 0), (5, 1), (5, 2)]


def test_short_names_meet_only_where_they_are_alike():
    import numpy as np

    from lorekeeper.functions.similarity import indel_ratio
    from lorekeeper.operators import fuzzy

    counts = np.zeros(fuzzy.GRAM_BUCKETS, dtype=np.int64)
    names = [f"v{i * 37:06}" for i in range(300)]
    keys = [set(fuzzy.signature(n, 0.85, counts)) for n in names]
    for i in range(len(names)):
        for j in range(i):
            assert (not keys[i].isdisjoint(keys[j])) == (indel_ratio(names[i], names[j]) >= 0.85)


def test_postings_bound_a_shard(spark, monkeypatch, tmp_path):
    """However many terms are asked for, a task holds about ``ENTRIES`` postings."""
    from lorekeeper.operators import text_index

    docs = spark.createDataFrame([(i, " ".join(f"w{(i + j) % 50}" for j in range(20))) for i in range(200)], "id long, text string")
    asked = spark.createDataFrame([(q, f"w{q} w{q + 1}") for q in range(49)], "query_id long, text string")
    entries = text_index._entries(docs, "id", "text")[1]
    assert entries.count() == 200 * 20
    index, make = text_index.build_text_index(docs), text_index._best_of_shard
    want = sorted(tuple(r) for r in text_index.text_search_all(index, asked, 3).collect())

    def counted(*args):
        run = make(*args)

        def noted(postings, queries):
            with open(f"{tmp_path}/rows", "a") as f:
                f.write(f"{postings.num_rows}\n")
            return run(postings, queries)

        return noted

    monkeypatch.setattr(text_index, "_best_of_shard", counted)
    monkeypatch.setattr(text_index, "ENTRIES", 400, raising=False)
    found = text_index.text_search_all(index, asked, 3)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert max(map(int, (tmp_path / "rows").read_text().split())) < 1600 < 200 * 20
    assert "WindowGroupLimit" in plan(found)


def test_what_a_walk_reaches_is_sent_whole_only_if_it_is_little(spark, monkeypatch):
    """The written ids of a walk pack into a few KB, whatever their number: rows are counted."""
    from lorekeeper.operators import grouping, traversal

    edges = spark.createDataFrame([(f"e{i}", "n0" if i % 2 else f"n{i - 1}", f"n{i}") for i in range(1, 41)], "id string, source_node_id string, target_node_id string")
    nodes = traversal.materialise(spark.createDataFrame([(f"n{i}",) for i in range(60)], "id string"), "nodes")
    seeds = spark.createDataFrame([("n0",)], "id string")
    walk = lambda: traversal.expand_graph(nodes, traversal.materialise(edges, "edges"), seeds, 2)
    little = walk()
    assert "BroadcastExchange" in plan(little[0])
    monkeypatch.setattr(grouping, "FEW", 5, raising=False)
    found = walk()
    assert "BroadcastExchange" not in plan(found[0])
    for a, b in zip(little, found, strict=True):
        assert sorted(r["id"] for r in a.collect()) == sorted(r["id"] for r in b.collect())
    assert {r["id"] for r in found[0].collect()} == {f"n{i}" for i in range(41)}


def test_search_and_expand_builds_no_index(spark, monkeypatch):
    from lorekeeper.operators import text_index
    from lorekeeper.plans import queries_search

    monkeypatch.setattr(text_index, "build_text_index", lambda *_, **__: pytest.fail("an index for one query"))
    monkeypatch.setattr(queries_search, "_INDEXES", {})
    assert queries_search.h3_search_and_expand(spark, SF_DIR).count() > 0


def test_nodes_of_writes_meet_without_the_driver(spark, monkeypatch):
    from lorekeeper.operators import ingestion as stages

    plans, write = [], stages.materialise
    monkeypatch.setattr(stages, "materialise", lambda df, name: plans.append(plan(df)) or write(df, name))
    plans.append(plan(ingestion.d29_apply_writes(spark, SF_DIR)))
    assert len(plans) > 1 and not any("BroadcastExchange" in p for p in plans)


def test_fusion_splits_texts_once(spark):
    """Its text list reads a written row of numbers a text, and no text again."""
    from lorekeeper.plans.queries_search import h1_rank_fusion

    found = plan(h1_rank_fusion(spark, SF_DIR))
    assert "documents.parquet" not in found and "regexp_extract_all" not in found and "n_terms" in found


def test_rows_of_writes_are_derived_once(spark, monkeypatch):
    """All orders are joined with their customers once, however many columns collapse, and matches by equality are found once."""
    from lorekeeper.operators import ingestion as stages
    from lorekeeper.operators import resolution

    plans = {}
    for module in (stages, resolution):
        write = getattr(module, "materialise", stages.materialise)
        monkeypatch.setattr(module, "materialise", lambda df, name, write=write: plans.setdefault(name, plan(df)) and write(df, name), raising=False)
    plans["result"] = plan(ingestion.d29_apply_writes(spark, SF_DIR))
    assert {name: p.count("FileScan parquet [o_orderkey") for name, p in plans.items() if "[o_orderkey" in p} == {"rows": 1}
    assert "equal" in plans
