"""Schemas of the base tables; readers use them and never infer."""

from pyspark.sql import types as T

ARG = T.StructType([T.StructField("name", T.StringType()), T.StructField("repr", T.StringType()), T.StructField("redacted", T.BooleanType()), T.StructField("truncated", T.BooleanType())])
TRACE_LINE = T.StructType(
    [
        T.StructField("event", T.StringType()), T.StructField("node_id", T.StringType()), T.StructField("ts_ns", T.LongType()),
        T.StructField("thread_id", T.LongType()), T.StructField("frame_depth", T.IntegerType()), T.StructField("metadata", T.StringType()),
        T.StructField("values", T.StructType([T.StructField("args", T.ArrayType(ARG)), T.StructField("ret", T.StringType()), T.StructField("ret_truncated", T.BooleanType())])),
    ]
)
EDGE_BUCKETS = ["import", "call", "inherit", "implements", "cross_language", "other"]
DIFF_ORDER = ["hotter", "new", "gone", "colder", "same", "cold", "touched"]
