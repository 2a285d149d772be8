"""Command line: ``spark-submit banterscope/run.py JOB --option value ...``.

``stream`` scores messages and serves all consumers; ``replay`` does the same for a
bounded set of messages; ``train`` makes and, if it is good enough, publishes a scorer;
``transcripts`` and ``short-transcripts`` put recognition results into the drop-zone, once each.
"""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from banterscope.config import PipelineConfig
from banterscope.operators import events, windows
from banterscope.operators.scoring import Scorer, by_path, scorer
from banterscope.plans.training_run import TrainingRun, run_csv
from banterscope.plans.transcripts_run import run_long, run_short
from banterscope.sinks.batch import append_warehouse, write_outbox
from banterscope.sinks.streams import topic
from banterscope.session import CONF
from banterscope.sources import messages, tables
from banterscope.streaming import jobs


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=("stream", "replay", "train", "transcripts", "short-transcripts"))
    parser.add_argument("--root", required=True, help="shared folder for tables and checkpoints")
    parser.add_argument("--messages", help="drop-zone folder with a JSON message per line")
    parser.add_argument("--servers", help="brokers; messages then come from a topic")
    parser.add_argument("--input-topic")
    parser.add_argument("--scored-topic")
    parser.add_argument("--toxic-topic")
    parser.add_argument("--scorer", default="lexicon", help="lexicon, linear, pandas, module:name of your own, or (replay only) sparkml, attributes")
    parser.add_argument("--model", help="folder of a published model, for linear and sparkml")
    parser.add_argument("--responses", help="folder of a Parquet table with text and response, for attributes")
    parser.add_argument("--load", help="module:name of the function that loads the model of pandas")
    parser.add_argument("--scorer-option", action="append", default=[], metavar="NAME=VALUE", help="given to a scorer of your own, as text")
    parser.add_argument("--every", default="5 seconds", help="time between micro-batches")
    parser.add_argument("--files-per-batch", type=int, default=1000, help="bound of a micro-batch, for files (default 1000)")
    parser.add_argument("--offsets-per-batch", type=int, default=1_000_000, help="the same for a topic (default 1000000)")
    parser.add_argument("--comments", help="CSV with comment_text and target")
    parser.add_argument("--model-id")
    parser.add_argument("--results", help="folder of recognition results, a JSON file each")
    parser.add_argument("--sidecars", help="folder of request metadata, a JSON file each")
    parser.add_argument("--translations", help="Parquet table with object_name and pieces, for short transcripts")
    for option in fields(PipelineConfig):
        parser.add_argument(f"--{option.name.replace('_', '-')}", help=f"default {option.default}")
    return parser.parse_args(given)


def options(args: argparse.Namespace) -> PipelineConfig:
    names = [f.name for f in fields(PipelineConfig)]
    return PipelineConfig.from_strings({n: getattr(args, n) for n in names if getattr(args, n) is not None})


def chosen_scorer(spark: SparkSession, args: argparse.Namespace) -> Scorer:
    """The scorer that the command line names, with what it needs."""
    needs = {"attributes": "responses", "pandas": "load", "linear": "model", "sparkml": "model"}
    need = needs.get(args.scorer)
    if need and not getattr(args, need):
        raise ValueError(f"--scorer {args.scorer} needs --{need}")
    own = dict(option.partition("=")[::2] for option in args.scorer_option)
    if args.scorer == "attributes":
        return scorer(args.scorer, responses=spark.read.parquet(args.responses))
    if args.scorer == "pandas":
        path = args.load
        return scorer(args.scorer, load=lambda: by_path(path)())
    return scorer(args.scorer, **({"model": PipelineModel.load(args.model)} if args.model else {}), **own)


def start_stream(spark: SparkSession, args: argparse.Namespace) -> list[StreamingQuery]:
    """Start scoring, then, when its table is there, everything that reads it."""
    cfg, layout, pace = options(args), jobs.Layout(args.root), {"processingTime": args.every}

    if args.servers:
        incoming = messages.topic_stream(spark, args.servers, args.input_topic, maxOffsetsPerTrigger=str(args.offsets_per_batch))
    else:
        incoming = messages.line_stream(spark, args.messages, args.files_per_batch)

    def to(name):
        return topic(args.servers, name, pace) if args.servers and name else None

    scoring = jobs.start_scoring(incoming, chosen_scorer(spark, args), cfg, layout, pace)
    jobs.wait_for_first_batch(scoring)
    bound = args.files_per_batch
    alerts = jobs.start_alerts(spark, cfg, layout, trigger=pace, files_per_batch=bound)
    toxic = to(args.toxic_topic)
    if toxic:
        jobs.wait_for_first_batch(alerts)
    return [
        scoring,
        jobs.start_quarantine(spark, layout, pace, bound),
        jobs.start_without_user(spark, layout, pace, bound),
        jobs.start_scored_topic(spark, layout, sink=to(args.scored_topic), trigger=pace, files_per_batch=bound),
        jobs.start_warehouse(spark, layout, pace, bound),
        jobs.start_outbox(spark, layout, pace, bound),
        alerts,
        *([jobs.start_alert_topic(spark, layout, toxic)] if toxic else []),
    ]


def stream(spark: SparkSession, args: argparse.Namespace) -> None:
    start_stream(spark, args)
    spark.streams.awaitAnyTermination()


def replay(spark: SparkSession, args: argparse.Namespace) -> None:
    cfg, layout = options(args), jobs.Layout(args.root)
    if args.servers:
        given = messages.topic_batch(spark, args.servers, args.input_topic)
    else:
        given = messages.line_batch(spark, args.messages)
    # Into a fresh root: a second replay fails instead of adding everything once more.
    jobs.scored_messages(given, chosen_scorer(spark, args), cfg).write.parquet(layout.table("scored"))
    stored = tables.scored_batch(spark, layout.table("scored"))
    stored.where("is_quarantined").select("message_id", "raw").write.parquet(layout.table("quarantine"))
    scored = stored.where("not is_quarantined")
    events.without_user(scored).select("message_id", "event_time", "envelope").write.parquet(layout.table("without_user"))
    scored.select(F.col("envelope").alias("value")).write.text(layout.table("topic"))
    append_warehouse(events.warehouse_rows(scored), layout.table("warehouse"))
    write_outbox(events.callback_outbox(scored), layout.table("outbox"))
    found = windows.user_window_scores(events.keyed_scores(scored), cfg)
    windows.toxic_flags(found, cfg).write.parquet(layout.table("flags"))


def transcripts(spark: SparkSession, args: argparse.Namespace) -> None:
    layout = jobs.Layout(args.root)
    folders = (args.results, args.sidecars, args.messages, layout.table("transcript_errors"))
    delivered = layout.table("transcripts_delivered")
    if args.job == "transcripts":
        run_long(spark, *folders, delivered)
    else:
        translated = spark.read.parquet(args.translations) if args.translations else None
        run_short(spark, *folders, options(args), delivered, translated)


def main(given: list[str] | None = None) -> None:
    args = arguments(given)
    # A session of its own, so that its settings stay with the job.
    spark = SparkSession.builder.appName(f"banterscope-{args.job}").getOrCreate().newSession()
    for key, value in CONF.items():
        spark.conf.set(key, value)
    if args.job == "train":
        run_csv(spark, args.comments, TrainingRun(args.root, args.model_id))
    else:
        {"stream": stream, "replay": replay, "transcripts": transcripts, "short-transcripts": transcripts}[args.job](spark, args)


if __name__ == "__main__":
    main()
