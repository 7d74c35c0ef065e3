"""Column layouts (as DDL text) of the tables the operators exchange."""

from __future__ import annotations

READINGS = ("sensor string, rn bigint, time timestamp, strain double, temperature double")
SERIES_FILE = ("Time_index string, Time string, Strain string, Temperature string")
RAW_READINGS = (
    "ts timestamp, loop string, line bigint, span string, beam string, coord double, "
    "strain double, temp double, position string"
)
REGIONS = (
    "sensor string, start_rn bigint, end_rn bigint, start_time timestamp, end_time timestamp, length bigint"
)
REQUESTS = ("start string, end string, loop string, position string, col string")
SUPPORTS = ("beam string, support string, coord double")
THRESHOLD = ("mean_error double, std_error double")
SNAPSHOTS = ("snapshot_date date, pos bigint, cluster int")

# Metres from the start of the beam to each support.
SUPPORT_COORDS = {
    "B": {"I": 0.0, "II": 38.76, "III": 80.65, "IV": 122.57, "V": 161.84},
    "C": {"I": 0.0, "II": 40.09, "III": 82.08, "IV": 123.48, "V": 163.26},
    "D": {"I": 0.0, "II": 39.27, "III": 81.17, "IV": 122.78, "V": 162.15},
    "E": {"I": 0.0, "II": 39.37, "III": 81.08, "IV": 122.79, "V": 160.43},
    "F": {"I": 0.0, "II": 38.66, "III": 80.67, "IV": 122.49, "V": 160.94},
}


def supports(spark):
    """The ``supports(beam, support, coord)`` dimension."""
    rows = [(beam, s, c) for beam, places in SUPPORT_COORDS.items() for s, c in places.items()]
    return spark.createDataFrame(rows, SUPPORTS)
