"""Questions as a stream: Q1/Q2 over Structured Streaming.

The answer table is computed once from the data table and cut from its
lineage (``checkpoint`` into the cluster's shared ``spark.checkpoint.dir``, or
a persisted copy when none is set), then each micro-batch of questions is
routed per row and broadcast-joined to it. Routing is stateless, so the query
needs no watermark and recovers from its checkpoint location after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfscope.operators import ask

QUESTION_SCHEMA = "question string"


def frozen_answers(df: DataFrame) -> DataFrame:
    """The per-intent answer table, written once to ``spark.checkpoint.dir`` (a handful of rows)."""
    answers = ask.answer_table(df)
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("spark.checkpoint.dir is not set")
    spark.sparkContext.setCheckpointDir(folder)
    return answers.checkpoint(eager=True)


def answer_stream(questions: DataFrame, answers: DataFrame, text_col: str = "question") -> DataFrame:
    """Streaming (or batch) questions -> question, intent, answer."""
    routed = questions.withColumn("intent", ask.intent_of(F.col(text_col)))
    return routed.join(answers, "intent", "left") \
        .select(F.col(text_col).alias("question"), "intent", "answer")


def start(spark: SparkSession, data: DataFrame, source_dir: str, sink_dir: str,
          checkpoint_location: str, fmt: str = "json") -> StreamingQuery:
    """Answer every question file arriving in ``source_dir`` into ``sink_dir``."""
    questions = spark.readStream.schema(QUESTION_SCHEMA).format(fmt).load(source_dir)
    out = answer_stream(questions, frozen_answers(data))
    return (out.writeStream.format(fmt).option("path", sink_dir)
            .option("checkpointLocation", checkpoint_location).outputMode("append").start())
