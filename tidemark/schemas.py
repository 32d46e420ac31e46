"""Row types shared by the operators."""

from pyspark.sql import types as T

NEWS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("headline", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("url", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("symbols", T.ArrayType(T.StringType())),
        T.StructField("source", T.StringType()),
    ]
)

# metadata that travels from an article to each of its chunks
METADATA = (
    "headline",
    "summary",
    "url",
    "symbols",
    "author",
    "created_at",
    "updated_at",
    "source",
    "full_raw_text",
    "article_id",
)

FEED = (
    "entry array<struct<id:string,title:string,link:array<struct<_type:string,_href:string>>,"
    "category:array<struct<_term:string>>>>"
)
