"""Names of stations and replicates, and the stores' folder."""

from pyspark.sql import functions as F

from tidelint.functions.labels import replicate_stem, station_label


def test_station_labels(spark):
    rows = [("a/RH 07", "x", "RH07"), ("b", "CENTROIDE 3.csv", "CENTROID3"), (".", "x", "EXPERIMENTO"), (None, "x", "EXPERIMENTO"), ("p/north bay-2", "x", "NORTH_BAY_2")]
    df = spark.createDataFrame(rows, "path string, names string, want string")
    assert [(r.got, r.want) for r in df.select(station_label(F.col("path"), F.col("names")).alias("got"), "want").collect()] == [(w, w) for *_, w in rows]


def test_replicate_stems(spark):
    rows = [("HOBO 12_North.csv", "north"), ("North-hobo2.txt", "north"), ("N_1.csv", "n1"), ("hobo.csv", "")]
    df = spark.createDataFrame(rows, "name string, want string")
    assert all(r.got == r.want for r in df.select(replicate_stem(F.col("name")).alias("got"), "want").collect())
