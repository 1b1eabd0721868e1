"""Batch calls of injected models, equal prompts asked once, with failures as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptspark.functions import strings as S

SYSTEM_PROMPT = "Answer with a delivery direction of a few words for the script line."


#: Over how many tasks the rows of one prompt are dealt when answers are joined back.
PIECES = 16


def enrich(df: DataFrame, backend: Callable, system: str, prompt: str, tries: int = 2, in_flight: int = 8, per_task: bool = False) -> DataFrame:
    """df with answer and error. backend(system, prompt) is called once per distinct prompt, null too, and all its rows get what it gave.

    A call that still fails after `tries` gives an error and no answer. A task keeps `in_flight` calls going at most, in threads.
    With per_task, backend() is called once a task and gives the function to call: a session, say, that all its calls share.
    """
    asked, copy = (_fresh(df, n) for n in ("asked", "copy"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = backend() if per_task else backend

        def one(text: str | None) -> tuple[str | None, str | None]:
            error = None
            for _ in range(tries):
                try:
                    return call(system, text), None
                except Exception as failed:  # any failure of the injected backend is the prompt's own
                    error = f"{type(failed).__name__}: {failed}"
            return None, error

        with ThreadPoolExecutor(in_flight) as pool:
            for frame in frames:
                got = list(pool.map(one, frame[asked]))
                yield frame.assign(answer=[a for a, _ in got], error=[e for _, e in got])

    prompts = df.select(F.col(prompt).alias(asked)).distinct()
    answers = prompts.mapInPandas(run, f"`{asked}` string, answer string, error string").withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    dealt = df.withColumn(copy, F.pmod(F.xxhash64(*df.columns), F.lit(PIECES)).cast("int"))
    on = [F.col(prompt).eqNullSafe(F.col(asked)), dealt[copy] == answers[copy]]
    # answers grow with the prompts, and Spark can't tell the size of what a Python function returns: never broadcast them
    return dealt.join(answers.hint("merge"), on).select(*(dealt[f"`{c}`"] for c in df.columns), "answer", "error")


def _fresh(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def failure_report(results: DataFrame, by: str = "book_id") -> DataFrame:
    """Per book, from the stored results of direct() or synthesize(): calls, failures, and the commonest error."""
    failed = F.col("error").isNotNull()
    return results.groupBy(by).agg(F.count("*").alias("calls"), F.count_if(failed).alias("failed"), F.mode("error", True).alias("commonest_error"))


def direct(entries: DataFrame, backend: Callable[[str, str], str]) -> DataFrame:
    """entries with prompt, direction (usable or null) and error. Store the result once: a backend need not give the same answer again."""
    asked = entries.withColumn("prompt", S.direction_prompt(F.col("speaker"), F.col("text")))
    answered = enrich(asked, backend, SYSTEM_PROMPT, "prompt")
    return answered.withColumn("direction", S.clean_direction(F.col("answer"), F.col("text"))).drop("answer")


def synthesize(chunks: DataFrame, engine: Callable[[str, str, str], tuple[list[float], int]]) -> DataFrame:
    """(book_id, chunk_idx, speaker, samples, sample_rate, n_samples, error). engine(text, voice, style) gives samples and their rate."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                try:
                    samples, rate = engine(r.text, r.voice, r.style)
                    rows.append((r.book_id, r.chunk_idx, r.speaker, [float(x) for x in samples], rate, len(samples), None))
                except Exception as failed:  # any failure of the injected engine is the row's own
                    rows.append((r.book_id, r.chunk_idx, r.speaker, None, None, None, f"{type(failed).__name__}: {failed}"))
            yield pd.DataFrame(rows, columns=["book_id", "chunk_idx", "speaker", "samples", "sample_rate", "n_samples", "error"]).astype({"sample_rate": "Int32", "n_samples": "Int64"})

    kind = chunks.schema["book_id"].dataType.simpleString()
    return chunks.select("book_id", "chunk_idx", "speaker", "text", "voice", "style").mapInPandas(run, f"book_id {kind}, chunk_idx long, speaker string, samples array<float>, sample_rate int, n_samples long, error string")
