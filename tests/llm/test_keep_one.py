"""One row of each near-duplicate group, also where an id stands on several texts."""

from voxlake.llm import simhash


def test_one_id_on_two_texts(spark):
    a, b, c = (" ".join(f"{w}{i * i % 89}" for i in range(120)) for w in ("red", "blue", "green"))
    made = [(1, a, "x"), (1, b, "x"), (2, b, "x"), (3, c, "x"), (3, c, "y"), (3, a, "x"), (4, c, "x")]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    for parts in (1, 3):
        kept = simhash.keep_one(docs.repartition(parts))
        assert kept.columns == docs.columns
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, a), (1, b), (3, c)])
