"""Command line: ask questions of a saved index, or build one. Exit codes: 0 answered, 1 refused or bad data, 2 wrong use."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folio.config import Config, parse_overrides
from folio.operators import corpus as C
from folio.operators import pipeline as P
from folio.operators import retrieval as R
from folio.session import ship
from folio.sources import io

EMBEDDER = "lexical"


def build(spark: SparkSession, corpus: str, index: str, config: Config) -> int:
    """Chunk a corpus of JSON lines, index it and save the index."""
    docs = io.read_jsonl(spark, corpus, io.DOCUMENT, strict=True)
    known = docs.select("doc_id", F.col("year").alias("doc_year"), F.coalesce("stratum", F.lit("none")).alias("doc_stratum"), F.col("title").alias("doc_title")).dropDuplicates(["doc_id"])
    chunks = C.chunk_documents(docs, size=config.chunk_size, overlap=config.chunk_overlap, least=config.min_chunk_chars)
    chunks = chunks.withColumn("chunk_id", F.concat_ws("#", "doc_id", F.col("pos").cast("string"), F.col("index").cast("string"))).join(known, "doc_id")
    text = chunks.select("chunk_id", R.index_text(config.contextual_headers).alias("text"))
    io.save_index(index, chunks, R.postings(text, expand=config.expand_acronyms), EMBEDDER, R.encode_lexical(text, "chunk_id", "text", expand=config.expand_acronyms))
    for w in config.warnings():
        print(f"warning: {w}", file=sys.stderr)
    return 0


def ask(spark: SparkSession, index: str, questions: list[str], config: Config, filters: dict, as_json: bool) -> int:
    """Print an answer for each question; 1 if any is refused."""
    chunks, postings, vectors = io.load_index(spark, index, EMBEDDER)
    asked = spark.createDataFrame([(f"q{i:04d}", q) for i, q in enumerate(questions)], "qid string, question string")
    answers = P.ask(asked, chunks, config, filters, postings=postings, vectors=vectors)
    rows = (P.answers_json(answers).select("qid", F.col("json").alias("line"), F.lit(False).alias("refused")) if as_json else answers.select("qid", F.col("answer").alias("line"), "refused")).orderBy("qid").collect()  # one row a question
    for r in rows:
        print(r.line)
    return int(any(r.refused for r in rows))


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="folio")
    parser.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
    commands = parser.add_subparsers(dest="command", required=True)
    b = commands.add_parser("build")
    b.add_argument("corpus")
    b.add_argument("index")
    a = commands.add_parser("ask")
    a.add_argument("index")
    a.add_argument("questions", nargs="+")
    a.add_argument("--json", action="store_true")
    for name, kind in (("stratum", str), ("section", str), ("contains", str)):
        a.add_argument(f"--{name}", action="append", type=kind, default=[])
    for name in ("year-min", "year-max"):
        a.add_argument(f"--{name}", type=int)
    try:
        given = parser.parse_args(arguments)
    except SystemExit as e:
        return 2 if e.code else 0
    config = Config().merge(parse_overrides(given.set))
    spark = spark or SparkSession.builder.appName("folio").getOrCreate()
    ship(spark)
    try:
        if given.command == "build":
            return build(spark, given.corpus, given.index, config)
        filters = {"strata": given.stratum, "sections": given.section, "contains": given.contains, "year_min": given.year_min, "year_max": given.year_max}
        return ask(spark, given.index, given.questions, config, filters, given.json)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
