"""Long count frames over the TPC-like tables: (gene, tx, sample, group, count), absent cells being 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of parts (tx) of brands (gene) by suppliers' nation (sample), nations even or odd."""
    lines, parts, suppliers = (read(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    nation = F.col("s_nationkey")
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
        .groupBy(
            F.col("p_brand").alias("gene"),
            F.col("p_partkey").cast("string").alias("tx"),
            F.concat(F.lit("S"), F.lpad(nation.cast("string"), 2, "0")).alias("sample"),
            F.when(nation % 2 == 0, "even").otherwise("odd").alias("group"),
        )
        .agg(F.sum("l_quantity").cast("double").alias("count"))
    )


def event_pairs(spark: SparkSession, sf_dir: str, bases: int = 15) -> DataFrame:
    """Values of event types (tx) of user classes (gene) on days, early and late days of the month in pairs."""
    day = F.dayofmonth("ts")
    early = day <= 15
    name = F.concat(F.lit("B"), F.lpad(((day - 1) % bases).cast("string"), 2, "0"), F.when(early, "_N").otherwise("_T"))
    return (
        read(spark, sf_dir, "events")
        .groupBy(F.concat(F.lit("u"), (F.col("user_id") % 60).cast("string")).alias("gene"), F.col("event_type").alias("tx"), name.alias("sample"), F.when(early, "N").otherwise("T").alias("group"))
        .agg(F.sum("value").cast("double").alias("count"))
    )


def part_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of brands (tx) of part kinds (gene) by year of shipping, early and late."""
    lines, parts = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    year = F.year("l_shipdate")
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy(
            F.concat("p_type", F.lit("_"), F.col("p_size").cast("string")).alias("gene"),
            F.col("p_brand").alias("tx"),
            F.concat(F.lit("Y"), year.cast("string")).alias("sample"),
            F.when(year <= 1998, "early").otherwise("late").alias("group"),
        )
        .agg(F.sum("l_quantity").cast("double").alias("count"))
    )


def samples_of(counts: DataFrame) -> DataFrame:
    """(sample, group, ord): samples numbered by name."""
    from pyspark.sql import Window

    return counts.select("sample", "group").distinct().withColumn("ord", F.row_number().over(Window.orderBy("sample")))


SQL = {
    "retail": """retail AS (
  SELECT p_brand AS gene, CAST(p_partkey AS VARCHAR) AS tx, 'S' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS sample,
    CASE WHEN s_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS grp, CAST(sum(l_quantity) AS DOUBLE) AS cnt
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3, 4)""",
    "event_pairs": """event_pairs AS (
  SELECT 'u' || CAST(user_id % 60 AS VARCHAR) AS gene, event_type AS tx,
    'B' || lpad(CAST((day(ts) - 1) % 15 AS VARCHAR), 2, '0') || CASE WHEN day(ts) <= 15 THEN '_N' ELSE '_T' END AS sample,
    CASE WHEN day(ts) <= 15 THEN 'N' ELSE 'T' END AS grp, CAST(sum(value) AS DOUBLE) AS cnt FROM events GROUP BY 1, 2, 3, 4)""",
    "part_mix": """part_mix AS (
  SELECT p_type || '_' || CAST(p_size AS VARCHAR) AS gene, p_brand AS tx, 'Y' || CAST(year(l_shipdate) AS VARCHAR) AS sample,
    CASE WHEN year(l_shipdate) <= 1998 THEN 'early' ELSE 'late' END AS grp, CAST(sum(l_quantity) AS DOUBLE) AS cnt
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3, 4)""",
}
SQL["event_pairs_six"] = SQL["event_pairs"].replace("% 15", "% 6").replace("event_pairs AS", "event_pairs_six AS")
SQL["event_pairs_ten"] = SQL["event_pairs"].replace("% 15", "% 10").replace("event_pairs AS", "event_pairs_ten AS")
