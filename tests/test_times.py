from pyspark.sql import functions as F

from diffloom.operators import release


def test_seconds_of_more_than_eleven_digits(spark):
    """The last one is beyond what a time holds, and so is a number beyond a long."""
    rows = spark.createDataFrame([(k,) for k in ("99999999999", "102196955863800003", "102196065900", "253402300800", "9223371950454", "9223371950455", "9" * 30, "0")], "t string")
    got = {r.t: r.utc for r in rows.select("t", release.utc(F.col("t")).alias("utc")).collect()}
    assert got["99999999999"] == "5138-11-16T09:46:39Z"
    assert got["102196065900"] == "5208-06-18T20:05:00Z"
    assert got["253402300800"] == "10000-01-01T00:00:00Z"
    assert got["9223371950454"] == "294247-01-09T04:00:54Z"
    assert got["9223371950455"] is None and got["102196955863800003"] is None and got["9" * 30] is None
    assert got["0"] == "1970-01-01T00:00:00Z"
