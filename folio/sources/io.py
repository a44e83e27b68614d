"""Reading and writing: JSON lines with explicit schemas, inbox folders, and a saved index."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "doc_id string, title string, text string, source string, stratum string, topic string, year int, authors array<string>, venue string, doi string, url string, sections array<struct<pos:int,heading:string,body:string>>, tags array<string>, note string"
GOLDEN = "qid string, question string, category string, stratum string, expected string, note string, gold_doc_ids array<string>, answer_points array<string>, difficulty string, retrieval_challenge string, absent_terms array<string>, must_not_cooccur array<array<string>>"


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of a JSON-lines file; the schema is never inferred. ``strict`` fails on a broken line,
    otherwise its fields are null."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def write_jsonl(df: DataFrame, path: str) -> int:
    """Write and return the number of rows, observed while writing."""
    seen = Observation("rows")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def read_inbox(spark: SparkSession, path: str) -> DataFrame:
    """Text files of a folder as documents; their ids are hashes of their paths."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return files.select(F.concat(F.lit("inbox:"), F.substring(F.sha2("path", 256), 1, 16)).alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("title"), F.col("value").alias("text"))


def audit_sources(plan: DataFrame, fetched: DataFrame, errors: DataFrame) -> DataFrame:
    """name, fetched, error of every planned source, those without rows included."""
    counts = fetched.groupBy("name").agg(F.count("*").alias("fetched"))
    return plan.select("name").distinct().join(counts, "name", "left").join(errors.groupBy("name").agg(F.min("error").alias("error")), "name", "left").select("name", F.coalesce("fetched", F.lit(0)).alias("fetched"), "error")


def load_golden(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A golden set of JSON lines; rows have the keys they need, the others are null."""
    return read_jsonl(spark, path, GOLDEN, strict)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object (or an array of them) that goes over several lines."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """A small table (a manifest, a calibration) as one JSON-lines file; null fields are kept."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def save_index(path: str, chunks: DataFrame, postings: DataFrame, embedder: str, vectors: DataFrame | None = None) -> None:
    """Chunks partitioned by stratum, postings clustered by term, vectors, and a row that says what they were built
    with. Postings hold each chunk's tokens with their counts."""
    chunks.write.mode("overwrite").partitionBy("doc_stratum").parquet(f"{path}/chunks")
    postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    if vectors is not None:
        vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    meta = {"embedder": embedder, "vectors": vectors is not None}
    chunks.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_index(spark: SparkSession, path: str, embedder: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(chunks, postings, vectors); an index of another embedder is refused, a missing one fails to be read."""
    meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    if meta["embedder"] != embedder:
        raise ValueError(f"the index was built with {meta['embedder']}, not {embedder}")
    vectors = spark.read.parquet(f"{path}/vectors") if meta.get("vectors") else None
    chunks = spark.read.parquet(f"{path}/chunks")
    postings = spark.read.parquet(f"{path}/postings")
    postings._folio_path = f"{path}/postings"  # written already
    return chunks, postings, vectors


def save_gate(path: str, gate: DataFrame, threshold: float, embedder: str) -> None:
    """A calibration as one JSON text: the signals, the threshold and the embedder it holds for (a few signals)."""
    stats = {r.signal: {"mean": r["mean"], "std": r["std"], "weight": r["weight"]} for r in gate.collect()}
    text = json.dumps({"stats": stats, "threshold": threshold, "calibrated_for_embedder": embedder})
    gate.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_gate(spark: SparkSession, path: str, embedder: str | None = None, abstain: bool = True) -> tuple[DataFrame, float | None]:
    """(gate, threshold) of a calibration. Without abstention, or if it was made for another embedder, the gate is empty and
    so inactive, and the threshold is None."""
    found = json.loads("\n".join(r.value for r in spark.read.text(path).collect()))
    made_for = found.get("calibrated_for_embedder")
    use = abstain and (embedder is None or made_for is None or made_for == embedder)
    rows = [(k, v.get("mean"), v.get("std"), v.get("weight", 1.0)) for k, v in found.get("stats", {}).items()] if use else []
    return spark.createDataFrame(rows, "signal string, mean double, std double, weight double"), found.get("threshold") if use else None


def verify_snapshot(docs: DataFrame, expected: str) -> tuple[bool, str]:
    """Whether a corpus is the one of a manifest, and its hash."""
    from folio.operators.build import snapshot_hash

    found = snapshot_hash(docs).first().snapshot_hash
    return found == expected, found


def read_plan(text: str) -> list[dict]:
    """A fetch plan from YAML (or JSON) text: ``{stratum: {topic: {query, source, max_docs}}}`` as one flat entry for each
    topic; ``source`` is europepmc and ``max_docs`` 20 unless given, and a bare text is a query."""
    try:
        import yaml

        found = yaml.safe_load(text)
    except ImportError:
        found = json.loads(text)
    plan = []
    for stratum, topics in (found or {}).items():
        for topic, spec in (topics or {}).items():
            spec = {"query": spec} if isinstance(spec, str) else dict(spec or {})
            plan.append({"name": topic, "stratum": stratum, "topic": topic, "query": spec.get("query"), "source": spec.get("source") or "europepmc", "max_docs": int(spec.get("max_docs") or 20)})
    return plan


def plan_table(spark: SparkSession, plan: list[dict]) -> DataFrame:
    """The plan as a table: what a dry run lists."""
    rows = [(p["name"], p.get("stratum"), p.get("query"), p.get("source", "europepmc"), int(p.get("max_docs", 20))) for p in plan]
    return spark.createDataFrame(rows, "name string, stratum string, query string, source string, max_docs int")


def markdown_table(rows: DataFrame, first_left: bool = True, most: int = 1_000) -> str:
    """A small table as markdown; a table of more than ``most`` rows is refused."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")

    def cell(v) -> str:
        return "n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")

    rule = [("---" if i == 0 and first_left else "---:") for i in range(len(rows.columns))]
    return "\n".join("| " + " | ".join(x) + " |" for x in ([*rows.columns], rule, *[[cell(v) for v in r] for r in found]))


def read_inbox_files(spark: SparkSession, path: str) -> DataFrame:
    """All files of a folder as documents: texts as they are, PDF files by pypdf where it is installed. ``error`` tells what
    could not be read; such files have a null text."""

    def run(batches):
        import io as stream

        import pyarrow as pa

        for batch in batches:
            texts, errors = [], []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = error = None
                try:
                    if name.lower().endswith(".pdf"):
                        import pypdf

                        text = "\n\n".join(p.extract_text() or "" for p in pypdf.PdfReader(stream.BytesIO(content)).pages)
                    else:
                        text = content.decode("utf-8")
                except Exception as e:  # a broken file must not end the read
                    error = f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "text", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, text string, error string")
    return files.select(F.concat(F.lit("inbox:"), F.substring(F.sha2("path", 256), 1, 16)).alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("title"), "text", F.lit("inbox").alias("source"), "error")
