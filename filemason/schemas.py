"""Table schemas."""

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("extension", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("modified_at", T.TimestampType()),
    T.StructField("accessed_at", T.TimestampType()),
    T.StructField("parent_dir", T.StringType()),
    T.StructField("file_type", T.StringType()),
])

SCANNED = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("created_at", T.DoubleType()),
    T.StructField("modified_at", T.DoubleType()),
    T.StructField("accessed_at", T.DoubleType()),
    T.StructField("error", T.StringType()),
])

ACTIONS = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("action_type", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("destination", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
])

ANSWER = T.StructType([
    T.StructField("summary", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("topics", T.ArrayType(T.StringType())),
    T.StructField("importance", T.StringType()),
    T.StructField("suggested_folder", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])

FOLDER_ANSWER = T.StructType([
    T.StructField("directories", T.ArrayType(T.StringType())),
    T.StructField("reasoning", T.StringType()),
])

USAGE = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("provider", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
    T.StructField("cost_usd", T.DoubleType()),
    T.StructField("operation", T.StringType()),
])

CACHE = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("expires_at", T.TimestampType()),
])
