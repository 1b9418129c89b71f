"""Table schemas of a tenant."""

from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("document_id", T.StringType(), False),
    T.StructField("original_sha256", T.StringType()),
    T.StructField("preprocessing_step", T.StringType()),
    T.StructField("properties", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("is_candidate", T.BooleanType()),
])
SNIPPET = T.StructType([
    T.StructField("document_id", T.StringType(), False),
    T.StructField("sub_id", T.LongType(), False),
    T.StructField("snippet", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])
INTERACTION = T.StructType([
    T.StructField("document_id", T.StringType(), False),
    T.StructField("sub_id", T.LongType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("time_stamp", T.TimestampType(), False),
])
INTEREST = T.StructType([
    T.StructField("coi_id", T.StringType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("point", T.ArrayType(T.DoubleType())),
    T.StructField("view_count", T.LongType()),
    T.StructField("view_time_ms", T.LongType()),
    T.StructField("last_view", T.TimestampType()),
])
WEIGHTED_TAG = T.StructType([
    T.StructField("user_id", T.StringType(), False),
    T.StructField("tag", T.StringType(), False),
    T.StructField("weight", T.LongType()),
])
USERS = T.StructType([T.StructField("user_id", T.StringType(), False), T.StructField("last_seen", T.TimestampType())])
INDEXED_PROPERTY = T.StructType([T.StructField("name", T.StringType(), False), T.StructField("type", T.StringType(), False)])
#: Columns of an ingestion request; properties are a JSON object.
INGEST = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("properties", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("is_candidate", T.BooleanType()),
    T.StructField("default_is_candidate", T.BooleanType()),
    T.StructField("summarize", T.BooleanType()),
    T.StructField("split", T.BooleanType()),
])
#: A block of the inverted index: the documents of one block that have a term; the empty term has all of them.
POSTINGS = T.StructType([
    T.StructField("block", T.LongType()),
    T.StructField("term", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("max_tf", T.DoubleType()),
    T.StructField("min_dl", T.DoubleType()),
    T.StructField("sum_dl", T.DoubleType()),
    T.StructField("docs", T.ArrayType(T.StructType([T.StructField("document_id", T.StringType()), T.StructField("sub_id", T.LongType()), T.StructField("tf", T.DoubleType()), T.StructField("dl", T.DoubleType())]))),
])
TABLES = {"document": DOCUMENT, "snippet": SNIPPET, "interaction": INTERACTION, "center_of_interest": INTEREST, "weighted_tag": WEIGHTED_TAG, "users": USERS, "postings": POSTINGS, "indexed_property": INDEXED_PROPERTY}
#: The key by which a table is partitioned, and what else it is partitioned by.
KEYS = {"document": "document_id", "snippet": "document_id", "postings": "block", "interaction": "user_id", "center_of_interest": "user_id", "weighted_tag": "user_id", "users": "user_id"}
SUBPARTITIONS = {"document": ["is_candidate"]}
