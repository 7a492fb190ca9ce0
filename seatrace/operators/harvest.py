"""The wide table: one row for each ship and hour with all features. Parts are joined on (mmsi, timestamp)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatrace.storage import written

from . import clock, rules, spatial, stays, tracks

KEY = ["mmsi", "timestamp"]


def harvest(reports: DataFrame, *, types: DataFrame, ports: DataFrame, lines: DataFrame, zones: DataFrame, rasters: dict, loiter_m: float = 5e3, neighbor_m: float = 5e3, port_m: float = 10e3, line_deg: float = 0.02, n_nearest: int = 3) -> DataFrame:
    """Features of every ship at every full hour between its reports.

    rasters: name -> (table of row, col, value; rows; columns). zones give fish_rule, lines the pipeline, ports the port.
    The hourly table is interpolated and written once, and all parts read it. The table that parts are joined to stays
    partitioned by the key, so each join shuffles its part alone.
    """
    hourly = clock.on_grid(reports, ["latitude", "longitude", "vessel_type", "length"]).withColumn("vessel_type", F.bround("vessel_type").cast("int"))
    hourly = written(hourly, "harvest-hourly")
    wide = rules.describe(hourly, types, "vessel_type", "type_label").select(*KEY, "latitude", "longitude", "vessel_type", "type_label", "length")
    for name, (table, rows, cols) in rasters.items():
        wide = spatial.raster_lookup(wide, table, rows=rows, cols=cols, name=name)
    moves = tracks.kinematics_by_bin(reports).select("mmsi", F.col("bin").alias("timestamp"), "max_speed_m_sec", "max_ang_vel_deg_sec", "max_delta_sec")
    shape = clock.trajectory_features(reports).select("mmsi", F.col("bin").alias("timestamp"), "path_m", "span_m", "excursion_m", "end2end_m")
    port = spatial.nearest_places(hourly, ports, keys=KEY, n_nearest=1, radius_m=port_m).select(*KEY, F.col("0_place").alias("port"), F.col("0_dist_m").alias("port_m"))
    line = spatial.near_line(hourly, lines, keys=KEY, within_deg=line_deg).select(*KEY, F.col("name").alias("pipeline"))
    zone = spatial.first_polygon(hourly, zones, keys=KEY).select(*KEY, F.col("name").alias("fish_rule"))
    for part in (spatial.neighbors(hourly, n_nearest=n_nearest, radius_m=neighbor_m), stays.loitering(hourly, loiter_m), moves, shape, port, line, zone):
        wide = wide.join(part, KEY, "left")
    return wide
