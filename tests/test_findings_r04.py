"""Findings of round 4: ties that must not hang on rounding, and disk that must not hang on the driver's garbage."""

from pyspark.sql import functions as F

from panelworks.operators import cross_section as xs
from panelworks.operators import features as fe


def test_equal_sums_of_amounts_tie_whatever_the_order(spark):
    amounts = [round(30_000 + 7919.37 * (i * i % 61) + 0.01 * (i % 7), 2) for i in range(20)]
    orders = [[amounts[i * step % 20] for i in range(20)] for step in (1, 3, 7, 9, 11, 13, 17, 19)]  # the same amounts a name, in other orders
    rows = [(name, pos, float(amount)) for name, order in enumerate(orders) for pos, amount in enumerate(order * 4)]
    dated = spark.createDataFrame(rows, "security_id long, pos int, amount double").withColumn("date", F.date_add(F.lit("1998-01-05").cast("date"), F.col("pos")))
    price = 10 + (F.col("security_id") * 7 + F.col("pos") * F.col("pos")) % 13
    panel = dated.select("*", *(price.cast("double").alias(c) for c in ("open", "high", "low", "close")), F.lit(1.0).alias("volume"), F.lit(True).alias("quote_present"), F.lit(True).alias("data_valid"))
    days = dated.select("date", "pos").distinct()
    found = fe.price_factors(panel, days).where("pos = 79").cache()
    want = sum(round(a * 100) for a in amounts) / 2000
    assert {r.adv20_amount for r in found.collect()} == {want}
    assert {r.adv20_amount for r in xs.ranks(found).collect()} == {(len(orders) + 1) / 2 / len(orders)}


def test_candidates_deal_documents_and_their_blocks_once(spark):
    from panelworks.llm import passages

    words = [f"w{i * 7919 % 1009}" for i in range(900)]
    texts = {1: words[:300], 2: words[300:600], 3: words[600:700] + words[100:180], 4: words[700:800] + words[400:470], None: words[100:180]}
    docs = spark.createDataFrame([(k, " ".join(v), "en") for k, v in texts.items()], "doc_id long, text string, lang string")
    confs = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        found = passages.without_repeats(docs)
        plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
        assert sum("ReusedExchange" in line and "text" in line for line in plan) == 1  # documents: for blocks and for candidates
        assert not any(" Exchange hashpartitioning(doc_id" in line and ", rep" in line for line in plan)  # blocks by doc_id only
        kept = {r.doc_id: r.text.split() for r in found.collect()}
    finally:
        for k in confs:
            spark.conf.unset(k)
    assert kept == texts | {3: words[600:700], 4: words[700:800]}


def test_stored_tables_leave_no_shuffle_files(spark):
    import time

    from panelworks.llm.common import stored

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: disk.getAllFiles().size()
    before = held()
    kept = stored(spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).count(), "counts")
    for _ in range(50):  # executors are told to remove them, but not waited for
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before and kept.count() == 5000
