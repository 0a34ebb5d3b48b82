"""Commands over the same stages: python -m weftline.plans.cli <command>."""

from __future__ import annotations

import argparse
import functools
import importlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.config import Settings, settings
from weftline.operators import classify, memory
from weftline.plans import api
from weftline.session import cut, session
from weftline.sources import crawl
from weftline.sources.files import materialise, records, transcript


def shown(value: object) -> None:
    print(json.dumps(value, indent=2, ensure_ascii=False))


def predict(spark: SparkSession, s: Settings, args: argparse.Namespace) -> None:
    model = classify.load(spark, s.out("models", "tfidf_logreg"))
    shown(api.Service(spark, s).classify(args.text, functools.partial(classify.predict, model)))


def voices_of(spark: SparkSession, s: Settings, lines: DataFrame, refresh: bool = False) -> DataFrame:
    spoken = transcript(spark, s.path(s.paths.transcript_csv))
    return materialise(spark, s.out("persona", "voice.parquet"), lambda: memory.voice(lines, spoken, memory.CARDS), refresh)


def evaluate(spark: SparkSession, s: Settings, args: argparse.Namespace) -> None:
    """How two arms of replies match a character, and what follows from it."""
    lines = api.build(spark, s)["dialogue"]
    centres = memory.centroids(memory.embed(voices_of(spark, s, lines), F.col("line")), "character")
    replies = memory.embed(spark.read.parquet(args.replies), F.col("prompt")).withColumnRenamed("embedding", "prompt_embedding")
    card = next(c for c in memory.CARDS if c.name == args.character)
    scores = cut(memory.reply_scores(memory.embed(replies, F.col("reply")), centres, "character", card.name, card.signature))
    shown({"arms": records(scores.orderBy("arm")), "verdict": records(memory.verdict(scores))})


def chat(spark: SparkSession, s: Settings, args: argparse.Namespace) -> None:
    module, _, name = args.generator.partition(":")
    lines = api.build(spark, s)["dialogue"]
    voices = memory.embed(voices_of(spark, s, lines), F.col("context"))
    scenes = memory.embed(memory.scenes(lines), F.col("text"))
    for event, value in api.speak(api.Service(spark, s), getattr(importlib.import_module(module), name)(), args.character, args.message, [], voices, scenes):
        print(json.dumps([event, value], ensure_ascii=False), flush=True)


def scrape(spark: SparkSession, s: Settings, args: argparse.Namespace) -> None:
    wiki = crawl.Wiki(s.articles.wiki, s.articles.category, cache=s.path("data/cache"))
    print(crawl.crawl(spark, wiki, s.path("data/raw/responses.jsonl"), s.path(s.paths.articles_jsonl), args.limit).count())


#: Commands that need none of the tables of ``build``, or make them on their own.
ALONE = {
    "train": lambda spark, s, args: shown(api.train(spark, s)),
    "cv": lambda spark, s, args: shown(api.cross_validation(spark, s)),
    "predict": predict,
    "evaluate": evaluate,
    "chat": chat,
    "scrape": scrape,
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="weftline")
    parser.add_argument("--config")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("build", "themes", "characters", "memory", "all"):
        commands.add_parser(name).add_argument("--refresh", action="store_true")
    commands.add_parser("score").add_argument("--labels", required=True)
    ties = commands.add_parser("ties")
    ties.add_argument("name")
    ties.add_argument("--arc", default=api.ALL)
    for name in ("train", "cv"):
        commands.add_parser(name)
    commands.add_parser("predict").add_argument("text")
    commands.add_parser("evaluate").add_argument("replies", help="Parquet of arm, prompt_id, prompt, reply")
    commands.choices["evaluate"].add_argument("--character", required=True)
    chat = commands.add_parser("chat")
    chat.add_argument("character")
    chat.add_argument("message")
    chat.add_argument("--generator", required=True, help="module:function that makes a model, see operators.training.Generator")
    scrape = commands.add_parser("scrape")
    scrape.add_argument("--limit", type=int)
    args = parser.parse_args(argv)
    s, spark = settings(args.config), session()
    if args.command in ALONE:
        ALONE[args.command](spark, s, args)
        return
    tables = api.build(spark, s, getattr(args, "refresh", False))
    service = api.Service(spark, s)
    if args.command in ("themes", "all"):
        print(json.dumps(service.themes()["profile"], indent=2))
    if args.command in ("characters", "all"):
        print(json.dumps(service.characters()["ranking"][:15], indent=2, ensure_ascii=False))
    if args.command in ("memory", "all"):
        voices = voices_of(spark, s, tables["dialogue"], getattr(args, "refresh", False))
        voices.groupBy("character", "source").count().orderBy("character", "source").show()
    if args.command == "score":
        print(json.dumps(service.score_themes(tables["dialogue"], args.labels.split(",")), indent=2))
    if args.command == "ties":
        print(json.dumps(service.ties(args.name, args.arc), indent=2, ensure_ascii=False))


if __name__ == "__main__":
    main()
