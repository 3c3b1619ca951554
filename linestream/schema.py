"""Table layouts. Order is always a column (``line_no``, ``frame_seq``, ``z``), never implied."""

from pyspark.sql import types as T

LINES = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("frame_seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("w", T.DoubleType()),
        T.StructField("h", T.DoubleType()),
    ]
)

FRAME = ["session_id", "frame_seq"]
LINE = ["session_id", "frame_seq", "line_no"]
TM_KEY = ["source", "strategy", "target", "text"]

AUTO = "auto"
DEFAULT_SOURCE = "en-US"
LINE_CONFIDENCE = 0.65
LIVE_INTERVAL_S = 0.8
SAVE_DEBOUNCE_MS = 200
INTERACTION_GAP_MS = 150
