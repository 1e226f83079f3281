"""Schemas of the frames that flow through the package."""

from pyspark.sql import types as T

# Raw text in arrival order: `seq` is unique per device and grows with arrival.
LINES = T.StructType([
    T.StructField("device", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("value", T.StringType(), False),
])

# One stored record; `(device, id)` is its key and `id` its arrival order.
LOGS = T.StructType([
    T.StructField("device", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("session_id", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("pid", T.LongType()),
    T.StructField("tid", T.LongType()),
    T.StructField("message", T.StringType()),
])

# What one ingest run writes: records plus, for a record that a later run went
# on appending to, one further piece with the same id and `continues` set.
PIECES = T.StructType(LOGS.fields + [
    T.StructField("seq", T.LongType()),
    T.StructField("continues", T.BooleanType()),
])

# A run of identical neighbours.
FOLDED = T.StructType([
    T.StructField("device", T.StringType()),
    T.StructField("start_id", T.LongType()),
    T.StructField("end_id", T.LongType()),
    T.StructField("start_time", T.StringType()),
    T.StructField("end_time", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("pid", T.LongType()),
    T.StructField("message", T.StringType()),
    T.StructField("count", T.LongType()),
])

# Where ingest stands, one row per device: newest timestamp, session counter,
# id high-water and the key of the newest record (null: start a new record).
POSITION = T.StructType([
    T.StructField("device", T.StringType()),
    T.StructField("last_ts", T.StringType()),
    T.StructField("session_id", T.LongType()),
    T.StructField("last_id", T.LongType()),
    T.StructField("last_key", T.StructType([
        T.StructField("level", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("pid", T.LongType()),
        T.StructField("tid", T.LongType()),
        T.StructField("ts", T.StringType()),
    ])),
])

# Lines already taken at `last_ts`.
SEEN = T.StructType([
    T.StructField("device", T.StringType()),
    T.StructField("value", T.StringType()),
])

LOG_COLUMNS = LOGS.fieldNames()
