from pyspark.sql import functions as F

from aerostrata.models.neighbors import _grouped


def test_small_leaves_share_a_search_group(spark):
    """Fifty leaves of four queries and one of 300 make groups of about a hundred."""
    small = spark.range(200).select(F.format_string("q%s", "id").alias("vid"), F.format_string("0.%02d-0", F.floor(F.col("id") / 4)).alias("leaf"))
    large = spark.range(300).select(F.format_string("r%s", "id").alias("vid"), F.lit("0.99-0").alias("leaf"))
    home = small.unionByName(large)
    grouped, groups = _grouped(home, 100)
    sizes = {r["_part"]: r["count"] for r in grouped.groupBy("_part").count().collect()}
    assert groups == 5 and set(sizes) <= set(range(5))
    assert sum(sizes.values()) == 500 and sizes[0] + sizes[1] == 200 and max(sizes.values()) < 160
