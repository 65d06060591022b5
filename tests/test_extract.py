from pyspark.sql import functions as F

from memlake.operators.extract import facts
from memlake.operators.porting import export_lines, import_lines


def test_facts(spark):
    texts = [
        "We use marigold ink. Perhaps I use chalk",
        "use copper wire instead of string",
        "I switched from candles to lanterns",
        "The old mill is built with sandstone",
        "we just finished the bell tower",
        "It rained all day",
        "the ferry runs on v2.4 diesel, mostly",
        "I no longer use the north gate because it is slow",
        "Our team prefer rivets over glue",
        None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.id, r.subject, r.relation, r.object, r.is_negation) for r in facts(docs, "id", F.col("text")).collect()}
    assert got == {
        (0, "user", "uses", "marigold ink", False),
        (1, "user", "uses", "string", True),
        (1, "user", "uses", "copper wire", False),
        (2, "user", "uses", "candles", True),
        (2, "user", "uses", "lanterns", False),
        (3, "the old mill", "built_with", "sandstone", False),
        (4, "user", "finished", "the bell tower", False),
        (6, "the ferry", "runs_on", "v2.4 diesel", False),
        (7, "user", "uses", "the north gate", True),
        (8, "user", "prefers", "rivets", False),
    }


def test_round_trip(spark, tmp_path):
    mem = spark.createDataFrame([("a", "belief", 1, 0.5), ("b", "event", 2, None)], "memory_id string, memory_type string, created_at int, confidence double")
    path = str(tmp_path / "lines")
    lines = export_lines(mem).unionByName(spark.createDataFrame([("{broken",)], "value string"))
    lines.coalesce(1).write.text(path)
    good, bad = import_lines(spark, path, mem.schema)
    assert sorted(good.collect()) == sorted(mem.collect()) and [r.value for r in bad.collect()] == ["{broken"]
