from pyspark.sql import functions as F

from corvane.operators.regress import linregr_predict
from corvane.streaming import scored


def test_predictions_on_a_stream(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    stream = spark.readStream.schema(lines.schema).parquet(f"{sf}/lineitem*.parquet")
    q = scored(stream, p=linregr_predict([1.0, 2.0], F.array(F.lit(1.0), "l_quantity"))).writeStream.format("memory").queryName("corvane_temp_scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(p - 1 - 2 * l_quantity) FROM corvane_temp_scored").first()[0] == 0
    assert spark.table("corvane_temp_scored").count() == lines.count()
