"""Relief across lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relief(samples: DataFrame, cells: DataFrame, place) -> DataFrame:
    """Samples (line_id, type, k, x, y, tx, ty) -> line_id, relief: the median drop below crests (rise above toes) within 2 to 8 m on both sides.

    place: adds row and col to points.  Samples off the data, or with nothing on a side, do not count.
    """
    probes = F.explode(F.array(*map(F.lit, (0, *range(2, 9), *range(-8, -1)))))
    p = samples.select("line_id", "type", "k", "x", "y", "tx", "ty", probes.alias("o"))
    p = place(p.select("line_id", "type", "k", "o", (F.col("x") - F.col("ty") * F.col("o")).alias("x"), (F.col("y") + F.col("tx") * F.col("o")).alias("y")))
    z = p.join(cells.select("row", "col", "z").where("z is not null"), ["row", "col"])
    low, high = (f(F.when(F.col("o") != 0, F.col("z"))) for f in (F.min, F.max))
    s = z.groupBy("line_id", "type", "k").agg(F.max(F.when(F.col("o") == 0, F.col("z"))).alias("z0"), low.alias("low"), high.alias("high"), F.count_if(F.col("o") > 0).alias("l"), F.count_if(F.col("o") < 0).alias("r"))
    s = s.where("z0 is not null and l > 0 and r > 0")
    return s.groupBy("line_id").agg(F.median(F.when(F.col("type") == "crest", F.col("z0") - F.col("low")).otherwise(F.col("high") - F.col("z0"))).alias("relief"))
