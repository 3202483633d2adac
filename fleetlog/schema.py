"""The log table: one row per log record, partitioned by node."""

from pyspark.sql import types as T

LOG_SCHEMA = T.StructType([
    T.StructField("node", T.StringType(), False, {"comment": "which machine wrote the record"}),
    T.StructField("id", T.LongType(), False, {"comment": "arrival key: grows along the node's file"}),
    T.StructField("level", T.StringType(), True, {"comment": "severity"}),
    T.StructField("tid", T.LongType(), True, {"comment": "writing thread"}),
    T.StructField("puttime", T.TimestampNTZType(), True, {"comment": "clock of the node, no zone"}),
    T.StructField("fileline", T.StringType(), True, {"comment": "tail of the source path, colon, line"}),
    T.StructField("function", T.StringType(), True, {"comment": "head of the function name"}),
    T.StructField("message", T.StringType(), True, {"comment": "text, BEG and END mark calls"}),
])

LOG_COLUMNS = [f.name for f in LOG_SCHEMA.fields]

# Fixed values of the log format.
LEVELS = ("INFO", "DEBUG", "WARNING", "FATAL")
BEGIN_MARK = "BEG"
END_MARK = "END"
# Logged function names are cut to this many characters by the logger.
FUNCTION_WIDTH = 20

# Row order inside a thread: arrival.  Clocks step, the file order does not.
ORDER = "id"
