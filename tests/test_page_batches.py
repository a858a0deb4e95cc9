"""What a task holds of pages at once does not grow with the table."""


def test_pages_are_parsed_in_small_batches(spark):
    from lodestack.functions import html

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        html.small_batches(spark)
        assert int(spark.conf.get(key)) == html.PAGES
        spark.conf.set(key, "5")
        html.small_batches(spark)
        assert spark.conf.get(key) == "5"
    finally:
        spark.conf.set(key, before)
