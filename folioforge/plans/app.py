"""The application's surface: from files or texts to structured documents, search, answers, topics, reports."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.storage import materialise
from folioforge.functions.text import to_lines
from folioforge.operators import cleaning, report, retrieval, search, structure, topics, validation
from folioforge.sources import documents as sources
from folioforge.sources import reports

#: What is said when an answer cannot be made.
ASK_SOMETHING = "Ask a question about the current report."
PROCESS_FIRST = "Please upload and process a report first."
FAILED = "Unable to generate an AI response from the current report."


@dataclass(frozen=True)
class Processed:
    """The stage tables of a set of documents. All are lazy; write or persist what is used more than once."""

    docs: DataFrame
    cleaned: DataFrame
    audit: DataFrame
    checked: DataFrame
    metrics: DataFrame
    pages: DataFrame


def process_texts(docs: DataFrame) -> Processed:
    """Clean, validate and structure ``docs(doc_id, text)``, all documents in one plan."""
    cleaned, audit = cleaning.clean(to_lines(docs))
    lines = cleaned.select("doc_id", "line_no", F.col("text").alias("raw"))
    return Processed(docs, cleaned, audit, validation.check_lines(lines), validation.metrics(docs, lines), structure.pages(lines))


def process_files(spark: SparkSession, folder: str, extractor: sources.PageTextExtractor) -> Processed:
    """The same from the PDF files of a folder; ``extractor`` reads the pages of one file."""
    pages = sources.extract_pages(sources.scan_files(spark, folder), extractor)
    texts = sources.frame_pages(pages)
    return process_texts(texts.select(sources.file_name(F.col("path")).alias("doc_id"), "text"))


#: The stages of a document, in order, and what is said where one fails.
STAGES = {"ocr": "OCR failed", "cleaning": "Text cleaning failed", "validation": "OCR validation failed", "structure": "Structure extraction failed"}
NO_OUTPUT = {"ocr": "OCR did not create an output file.", "cleaning": "Cleaning did not create an output file."}


class StageFailed(RuntimeError):
    """A stage whose job ended with a fault; ``stage`` names it."""

    def __init__(self, stage: str, cause: Exception):
        super().__init__(f"{STAGES[stage]}: {cause}")
        self.stage = stage


@dataclass(frozen=True)
class Recorded:
    """The stage tables of a recorded run, what came of each document in each stage, and each stage's rows and seconds."""

    done: Processed
    outcomes: DataFrame
    stages: list[tuple[str, int, float]]


def process_recorded(files: DataFrame, extractor: sources.PageTextExtractor) -> Recorded:
    """The stages over ``files(path, content)``, each written before the next begins and recorded.

    outcomes has (doc_id, stage, rows, error, seconds) for each document and stage that it
    reached. A file that cannot be read, or that has no pages, has an error at the stage ocr
    and goes no further; all others end. rows are the pages read, lines cleaned, lines checked
    and pages structured. A document's seconds are those of its file at the stage ocr, else
    those of the whole stage, in which all documents are at work at once. The rows of each
    stage are counted as it is written, by an observation. A document whose cleaning leaves
    no line fails there. If a job itself fails, StageFailed says at which stage.
    """
    stages: list[tuple[str, int, float]] = []

    def ended(stage: str, made: DataFrame) -> DataFrame:
        seen, began = Observation(stage), time.perf_counter()
        try:
            written = materialise(made.observe(seen, F.count(F.lit(1)).alias("rows")), stage)
        except Exception as e:
            raise StageFailed(stage, e) from e
        stages.append((stage, seen.get["rows"], time.perf_counter() - began))
        return written

    def counted(stage: str, some: DataFrame, reached: DataFrame) -> DataFrame:
        found = reached.join(some.groupBy("doc_id").agg(F.count("*").alias("rows")), "doc_id", "left")
        error = F.when(F.col("rows").isNull(), F.lit(f"{STAGES[stage]}: {NO_OUTPUT[stage]}")) if stage in NO_OUTPUT else F.lit(None).cast("string")
        return found.select("doc_id", F.lit(stage).alias("stage"), F.coalesce("rows", F.lit(0)).alias("rows"), error.alias("error"), F.lit(stages[-1][2]).alias("seconds"))

    name = sources.file_name(F.col("path")).alias("doc_id")
    every = files.select(name).distinct()
    pages = ended("ocr", sources.extract_pages(files, extractor).select(name, "page_number", "text", "error", "seconds"))
    by_file = pages.groupBy("doc_id").agg(F.count_if(F.col("page_number") > 0).alias("rows"), F.max(F.when(F.col("page_number") == 0, F.col("error"))).alias("fault"), F.sum("seconds").alias("seconds"))
    fault = F.when(F.col("rows").isNull(), NO_OUTPUT["ocr"]).otherwise(F.col("fault"))
    ocr = every.join(by_file, "doc_id", "left").select("doc_id", F.lit("ocr").alias("stage"), F.coalesce("rows", F.lit(0)).alias("rows"), F.concat(F.lit(f"{STAGES['ocr']}: "), fault).alias("error"), F.coalesce("seconds", F.lit(0.0)).alias("seconds"))
    ocr = materialise(ocr, "outcomes")
    read = ocr.where("error IS NULL").select("doc_id")
    docs = sources.frame_pages(pages.join(read, "doc_id", "left_semi"), "doc_id")
    lines = to_lines(docs)
    cleaned, audit = cleaning.clean(lines)
    cleaned = ended("cleaning", cleaned)
    outcomes = [ocr, counted("cleaning", cleaned, read)]
    whole = outcomes[1].where("error IS NULL").select("doc_id")
    raw = cleaned.select("doc_id", "line_no", F.col("text").alias("raw"))
    checked = ended("validation", validation.check_lines(raw))
    outcomes.append(counted("validation", checked, whole))
    structured = ended("structure", structure.pages(raw))
    outcomes.append(counted("structure", structured, whole))
    done = Processed(docs, cleaned, audit, checked, validation.metrics(docs, raw), structured)
    together = outcomes[0]
    for more in outcomes[1:]:
        together = together.unionByName(more)
    return Recorded(done, together, stages)


def run_search(done: Processed, query: str) -> DataFrame:
    return search.search(done.pages, query)


def run_topics(done: Processed, per_document: bool = False) -> DataFrame:
    parts = topics.corpus(done.pages)
    return topics.topics(parts, "doc_id" if per_document else None)


def run_word_frequencies(done: Processed) -> DataFrame:
    return topics.word_frequencies(done.pages)


def run_validation_reports(done: Processed) -> DataFrame:
    """(doc_id, text): figures and review of each document."""
    return validation.render_report(done.metrics, done.checked)


def run_reports(done: Processed, stamp: str | None = None, language: str = "english") -> DataFrame:
    names = done.docs.select("doc_id", F.col("doc_id").cast("string").alias("name"))
    pages = materialise(done.pages, "pages")  # read three times
    return report.report_lines(structure.document_info(done.docs, pages), report.document_text(pages), report.titles(pages), done.metrics, names, stamp, language)


def save_reports(done: Processed, folder: str, stamp: str | None = None, language: str = "english") -> None:
    """Makes the reports of these documents and stores them; those of other documents and languages stay."""
    reports.write_reports(run_reports(done, stamp, language), folder, language=language)


def dashboard(done: Processed) -> DataFrame:
    """One wide row for each document: counts and validation metrics."""
    info = structure.document_info(done.docs, done.pages)
    return info.join(done.metrics, "doc_id", "left")


def respond(done: Processed | None, question: str, embed: Callable, embed_query: Callable[[str], list[float]], answer: retrieval.AnswerProvider | None) -> str:
    """An answer with sources; ``embed`` maps a text column to a vector column."""
    if not question:
        return ASK_SOMETHING
    if done is None:
        return PROCESS_FIRST
    try:
        chunks = retrieval.split_long(retrieval.page_chunks(done.pages))
        return retrieval.ask(chunks.withColumn("vector", embed(F.col("text"))), question, embed_query, answer)
    except Exception:  # the caller shows a message, whatever the provider's fault
        logging.getLogger(__name__).exception("no answer to a question")
        return FAILED
