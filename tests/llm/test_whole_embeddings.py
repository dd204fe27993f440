"""Vectors in more cells than were once listed."""

from litweave.llm import embeddings


def test_vectors_of_many_lengths_are_all_compared(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "MOST_CELLS", 1)
    rows = [(2 * n + k, [1.0] * n + [1.0 + 0.01 * k]) for n in range(1, 71) for k in (0, 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {x["vec_id"]: (x["n_links"], x["component_id"]) for x in got} == {i: (1, i - i % 2) for i, _ in rows}


def test_lengths_of_any_size_link(spark):
    rows = [(1, [1e200, 1.0]), (2, [1e-200, 0.0]), (3, [1e-200, 1e-200]), (4, [3.0, 3.0]), (5, [5e-324, 5e-324]), (6, [1.7e308, 1.7e308]), (7, [0.0, 0.0]), (8, [float("inf"), 1.0]), (9, [float("nan"), 1.0]), (10, [1.0, None]), (11, None), (12, []), (13, [0.0, -1e300])]
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 3), 4: (3, 3), 5: (3, 3), 6: (3, 3)} | {i: (0, i) for i in range(7, 14)}
