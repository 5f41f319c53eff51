"""Names, enumerations and declared schemas of the evidence graph."""

from __future__ import annotations

from pyspark.sql import types as T

#: Relationship kinds (fixed values).
KINDS = ("INHERITS", "IMPLEMENTS", "MIXES_IN", "USES", "TESTS", "COVERS", "GENERATES", "IMPORTS", "CALLS", "CONTAINS", "REFERENCES", "DEFINES", "CONFIGURES", "READS", "WRITES", "PRODUCES", "CONSUMES", "DEPLOYS", "HANDLES", "ROUTES_TO", "AUTHORED_BY", "READ_DURING", "CHANGED_BY")

#: Confidence tiers from most to least certain, and the number each stands for (fixed values).
TIERS = {"EXACT_RESOLUTION": 1.0, "SAME_FILE_LEXICAL": 0.75, "CROSS_FILE_HEURISTIC": 0.5, "UNRESOLVED": 0.0}
#: Tier of each way an edge can be resolved (fixed values); any other way is UNRESOLVED.
RESOLUTION = {"compiler": "EXACT_RESOLUTION", "scip": "EXACT_RESOLUTION", "same-file": "SAME_FILE_LEXICAL", "cross-file-heuristic": "CROSS_FILE_HEURISTIC"}
PRECISION = ("COMPILER", "AST", "LEXICAL")

EVIDENCE = T.StructType([T.StructField("path", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("content_hash", T.StringType())])
NODE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("name", T.StringType()),
        T.StructField("qualified_name", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("evidence", T.ArrayType(EVIDENCE)),
    ]
)
EDGE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("tier", T.StringType()),
        T.StructField("resolved", T.BooleanType()),
        T.StructField("specifier", T.StringType()),
        T.StructField("evidence", T.ArrayType(EVIDENCE)),
    ]
)
FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType()), T.StructField("content_hash", T.StringType()), T.StructField("size", T.LongType())])
JOURNAL = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("observed_ms", T.LongType()),
        T.StructField("event_kind", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("rename_to", T.StringType()),
        T.StructField("source_clock", T.LongType()),
        T.StructField("applied", T.IntegerType()),
    ]
)
