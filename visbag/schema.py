"""Schemas of the data model: features, codebook words, histograms, labelled values, envelopes."""

from __future__ import annotations

from pyspark.sql import types as T

_f, _l, _i, _s = T.FloatType(), T.LongType(), T.IntegerType(), T.StringType()

HEADER = ("x", "y", "size", "angle", "response", "octave")
FEATURES = T.StructType([T.StructField("image_id", _l), T.StructField("feature_id", _l), *(T.StructField(c, _f) for c in HEADER), T.StructField("descriptor", T.ArrayType(_f))])
CODEBOOK = T.StructType([T.StructField("word", _i), T.StructField("center", T.ArrayType(_f))])
WORDS = T.StructType([T.StructField("image_id", _l), T.StructField("feature_id", _l), T.StructField("rank", _i), T.StructField("word", _i), T.StructField("weight", _f)])
HISTOGRAM = T.StructType([T.StructField("image_id", _l), T.StructField("word", _i), T.StructField("value", T.DoubleType())])
BASE_TERMS = T.StructType([T.StructField("name", _s), T.StructField("word", _i), T.StructField("value", _f)])
SAMPLES = T.StructType([T.StructField("node", _l), T.StructField("label", _i), T.StructField("val", _f)])
#: A dense vector has null ids; a sparse one has ids and data of its entries.
VECTOR = T.StructType([T.StructField("dimension", _i), T.StructField("ids", T.ArrayType(_i)), T.StructField("data", T.ArrayType(_f))])
VECTOR_FILE = T.StructType([T.StructField("vec_id", _l), T.StructField("vector", VECTOR)])
NODES = T.StructType([
    *(T.StructField(c, _i) for c in ("tree", "node", "left_node", "right_node", "left_word", "right_word", "dim1", "dim2")),
    T.StructField("threshold", _f), T.StructField("deviation", _f), T.StructField("projection", T.ArrayType(_f)),
])

BLOB = T.StructType([T.StructField("dim", T.ArrayType(_l)), T.StructField("data", T.BinaryType())])
#: Empty messages cannot be Parquet columns, so ``fe`` is a presence flag.
CONFIGURATION = T.StructType([
    T.StructField("queue", _s), T.StructField("fe", T.BooleanType()),
    T.StructField("translate", T.StructType([T.StructField("neighborCount", _l)])),
    T.StructField("match", T.StructType([T.StructField("listSize", _l), T.StructField("database", _s)])),
    T.StructField("caffe", T.StructType([T.StructField("resultSize", _l)])),
])
RESULT = T.ArrayType(T.StructType([T.StructField("rank", _i), T.StructField("url", _s), T.StructField("score", _f)]))
ENVELOPE = T.StructType([
    T.StructField("uuid", _s), T.StructField("timestamp", T.DoubleType()), T.StructField("configuration", T.ArrayType(CONFIGURATION)),
    T.StructField("pastConfiguration", T.ArrayType(CONFIGURATION)), T.StructField("errorCode", _l), T.StructField("message", T.ArrayType(_s)),
    T.StructField("returnQueue", _s), T.StructField("image", T.BinaryType()), T.StructField("blob", BLOB), T.StructField("result", RESULT),
])
DEFAULTS = {"neighborCount": 1, "listSize": 100, "database": "", "resultSize": 5}
