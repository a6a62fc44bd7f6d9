from tidemark.llm import simhash


def full_collections(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_confirmed_copies_lets_go_of_what_its_steps_left(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text), (2, text), (3, "other words stand here and nothing is shared")], "doc_id long, text string")
    before = full_collections(spark)
    assert [r.id for r in simhash.confirmed_copies(docs).collect()] == [2]
    assert full_collections(spark) - before >= 10  # a collection after each table it keeps
