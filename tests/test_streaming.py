from varietas.operators.diversity import diversity
from varietas.streaming.windows import start, windowed_counts


def test_finished_windows_equal_the_batch_result(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id) AS ts, concat('g', id % 2) AS g, concat('t', id % 5) AS t, cast(id % 7 + 1 AS double) AS v FROM range(96)")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    got = []
    query = start(windowed_counts(stream, "ts", "g", "t", "v"), lambda df, _: got.extend(map(tuple, df.collect())), checkpoint=f"{tmp_path}/state")
    assert query.awaitTermination(90)
    batch = rows.selectExpr("g AS gene", "t AS tx", "date_format(date_trunc('day', ts), 'yyyy-MM-dd HH:mm:ss') AS sample", "v AS count").groupBy("gene", "tx", "sample").sum("count").withColumnRenamed("sum(count)", "count")
    want = {(r[0], r[1], r[2]): round(r[3], 9) for r in diversity(batch, 2.0, complete=False).collect()}
    found = {(g, s, q): round(v, 9) for g, s, q, v in got}
    assert found and found.items() <= want.items() and len(found) >= len(want) - 2
