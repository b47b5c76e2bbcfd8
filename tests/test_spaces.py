"""White space as Java's regular expressions see it, and what it costs."""

from pyspark.sql import functions as F

from pageloom.functions.text import SPACE, WS


def test_space_class_holds_the_white_space_of_browsers(spark):
    codes = spark.range(0x10000).filter("id < 55296 or id > 57343").select("id", F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    found = {r.id for r in codes.filter(F.regexp_like("c", F.lit(f"^{SPACE}$"))).collect()}
    assert found == set(map(ord, WS))
