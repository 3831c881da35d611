"""The chunk table and constants of the retrieval engine."""

from pyspark.sql import types as T

# Fixed values of the engine's behaviour.
CHUNK_BYTES, OVERLAP_BYTES, LOOK_BACK_BYTES, DECAY = 3600, 540, 800, 0.7
EMBED_BATCH, RRF_K, TAG_OVERFETCH, POOL_MIN, POOL_MAX, POOL_FACTOR = 50, 60, 3, 12, 48, 4
EMPTY_FRONTMATTER = '{"tags":[],"aliases":[],"title":null,"date":null}'

CHUNKS = T.StructType([
    T.StructField("chunk_id", T.StringType(), False),
    T.StructField("file_path", T.StringType(), False),
    T.StructField("heading_breadcrumb", T.StringType(), False),
    T.StructField("body", T.StringType(), False),
    T.StructField("line_start", T.LongType(), False),
    T.StructField("line_end", T.LongType(), False),
    T.StructField("frontmatter_json", T.StringType(), True),
    T.StructField("content_hash", T.StringType(), False),
    T.StructField("embedding_model", T.StringType(), False),
    T.StructField("vector", T.ArrayType(T.FloatType(), False), False),
])
CHUNKED = "file_path string, heading_breadcrumb string, heading_level int, body string, line_start long, line_end long, frontmatter_json string, byte_start long, byte_end long"
