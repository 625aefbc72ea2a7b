"""python -m wirepost CAPTURES [OUT]: analyse the captures below a folder, write reports, inventories, sessions, findings and servers below another, or reports to the standard output."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import analysis, reports
from .sources import captures, split


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("captures", help="folder with captures, of any name")
    parser.add_argument("out", nargs="?", help="folder for reports and inventories (JSON, a file each), sessions, findings and servers (Parquet); must not exist")
    parser.add_argument("--ranges", action="store_true", help="read each capture in ranges, by many tasks; needed above 2 GB")
    given = parser.parse_args()
    spark = SparkSession.builder.appName("wirepost").getOrCreate()
    frames = split.frames(split.index(spark, given.captures)) if given.ranges else captures.frames(captures.files(spark, given.captures))
    found = analysis.analyse_segments(captures.segments(frames))
    pretty = reports.indented(found.reports.select(F.col("capture").alias("name"), "report"), "report")
    if given.out is None:
        for row in pretty.orderBy("name").toLocalIterator():
            print(row.report, end="")
        spark.stop()
        return
    pretty.write.partitionBy("name").text(f"{given.out}/reports")
    listed = reports.indented(found.inventories.select(F.col("capture").alias("name"), "document"), "document")
    listed.write.partitionBy("name").text(f"{given.out}/inventories")
    found.servers.write.parquet(f"{given.out}/servers")
    found.sessions.drop("client", "leaf", "client_places", "server_places", "client_slices", "server_slices").write.parquet(f"{given.out}/sessions")
    found.findings.write.parquet(f"{given.out}/findings")
    spark.stop()


if __name__ == "__main__":
    main()
