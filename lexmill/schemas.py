"""The fixed table shapes of the library."""

from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("source_host", T.StringType()), T.StructField("created_at", T.TimestampType()),
])
#: Columns of a query batch; the ones after ``scope`` may be missing.
QUERY = T.StructType([
    T.StructField("qid", T.LongType()), T.StructField("query", T.StringType()), T.StructField("ranking", T.StringType()), T.StructField("scope", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("created_from", T.DateType()), T.StructField("created_to", T.DateType()), T.StructField("phrase", T.BooleanType()),
])
CORPUS_FILE = T.StructType([T.StructField("documents", T.ArrayType(T.StructType(DOCUMENT.fields[:4])))])
JUDGMENT_FILE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("queries", T.ArrayType(T.StructType([T.StructField("query", T.StringType()), T.StructField("relevant_document_ids", T.ArrayType(T.LongType()))]))),
])
SCOPES = ("all", "title", "content")
RANKINGS = ("bm25", "tfidf")
