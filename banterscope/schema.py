"""Fixed schemas. Input messages stay loosely typed (VARIANT); outputs do not."""

from pyspark.sql import types as T

# The four warehouse columns, all nullable.
WAREHOUSE = T.StructType(
    [
        T.StructField("userid", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)

# What every scorer returns for one text.
SCORE = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("detail", T.MapType(T.StringType(), T.DoubleType())),
    ]
)

SENTENCE = T.StructType(
    [
        T.StructField("start_time", T.StringType()),
        T.StructField("end_time", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("detail", T.MapType(T.StringType(), T.DoubleType())),
    ]
)

# The stored form of a scored message: one row per input message. Those that could not be
# parsed have ``raw`` and nothing else.
SCORED_MESSAGE = T.StructType(
    [
        T.StructField("message_id", T.StringType()),
        T.StructField("userid", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("publish_time", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("callback_url", T.StringType()),
        T.StructField("is_quarantined", T.BooleanType()),
        T.StructField("raw", T.StringType()),
        T.StructField("is_fallback", T.BooleanType()),
        T.StructField("sentences", T.ArrayType(SENTENCE)),
        T.StructField("envelope", T.StringType()),
    ]
)

SEGMENT = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("start_time", T.StringType()),
        T.StructField("end_time", T.StringType()),
    ]
)

# A speech-to-text result file.
STT_RESULT = T.StructType(
    [
        T.StructField(
            "results",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "alternatives",
                            T.ArrayType(T.StructType([T.StructField("transcript", T.StringType())])),
                        ),
                        T.StructField("resultEndTime", T.StringType()),
                        T.StructField("languageCode", T.StringType()),
                    ]
                )
            ),
        )
    ]
)

TRAINING = T.StructType(
    [
        T.StructField("comment_text", T.StringType()),
        T.StructField("target", T.DoubleType()),
    ]
)

FLAG = T.StructType(
    [
        T.StructField("userid", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("window_end", T.TimestampType()),
    ]
)
