"""The conversion stage: prompts, a pluggable converter, parsed responses and their averages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T

# The marks of a response.
CODE = ("===PYTHON_CODE_START===", "===PYTHON_CODE_END===")
EXPLANATION = ("===EXPLANATION_START===", "===EXPLANATION_END===")
CONFIDENCE, NOTES = "===CONFIDENCE===", "===CONFIDENCE_NOTES==="
DEFAULT_EXPLANATION = "Conversion completed."

SYSTEM = "\n".join([
    "You translate single Java methods to Python that reads as if it had been written in Python.",
    "Keep the behaviour; use only what the context shows and say in the notes what you had to assume.",
    "Answer in exactly this form:", CODE[0], "<the Python code>", CODE[1], EXPLANATION[0], "<what changed and why>",
    EXPLANATION[1], CONFIDENCE, "<a number from 0 to 1>", NOTES, "<doubts, or nothing>"])
DOCUMENT_SYSTEM = "You write short, exact documentation for Python functions that were translated from Java."


def modernize_prompt(source: Column, context: Column, class_name: Column, name: Column, excluded: Column) -> Column:
    """The request for one method: the source first, then what it uses, what had no room, and the task."""
    left_out = F.size(F.coalesce(excluded, F.array().cast("array<string>"))) > 0
    has_context = F.coalesce(context, F.lit("")) != ""
    return F.array_join(F.filter(F.array(
        F.concat(F.lit("## Java method "), class_name, F.lit("#"), name), source,
        F.when(has_context, F.lit("## Code that it uses")), F.when(has_context, context),
        F.when(left_out, F.concat(F.lit("## Used too, but not shown\n"), F.array_join(excluded, "\n"))),
        F.lit("## Task\nWrite this method in Python."),
        F.when(left_out, F.lit("Leave a comment `unseen: <name>` where code that is not shown decides the result.")),
    ), lambda x: x.isNotNull()), "\n\n")


def document_prompt(python_code: Column, java: Column, name: Column) -> Column:
    """The request to document one converted function."""
    return F.array_join(F.array(F.concat(F.lit("## Python function "), name), python_code, F.lit("## Its Java original"),
                                F.coalesce(java, F.lit("")), F.lit("## Task\nWrite the docstring of the Python function.")), "\n\n")


def parse_response(raw: Column) -> Column:
    """Struct (code, explanation, confidence, confidence_notes) of a response.

    Code stands between its marks, else in a python fence, else is the whole response; the confidence is 0.5 where it
    is missing or no number, and lies within 0 and 1.
    """
    raw = F.coalesce(raw, F.lit(""))
    marked = T.between(raw, *CODE)
    fenced = F.regexp_extract(raw, r"(?s)```python\n(.*?)```", 1)
    has_fence = raw.rlike(r"(?s)```python\n.*?```")
    explanation = T.between(raw, *EXPLANATION)
    number = F.regexp_extract(raw, r"===CONFIDENCE===\s*([\d.]+)", 1).try_cast("double")
    return F.struct(
        F.when(marked != "", marked).when(has_fence, T.strip(fenced)).otherwise(T.strip(raw)).alias("code"),
        F.when(explanation != "", explanation).otherwise(DEFAULT_EXPLANATION).alias("explanation"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.5)))).alias("confidence"),
        T.after(raw, NOTES).alias("confidence_notes"))


def stub_converter(prompt: str) -> str:
    """A converter that needs no service: it answers in the agreed form with a placeholder."""
    return f"{CODE[0]}\n# {len(prompt.split())} words asked\npass\n{CODE[1]}\n{CONFIDENCE}\n0.5\n"


def checked_key(key: str | None) -> str:
    """A service key that is neither blank nor a placeholder; checked on the driver before any job runs."""
    if not key or not key.strip() or key.strip().lower().startswith(("your", "<", "changeme")):
        raise ValueError("no service key is set")
    return key


def service(call: Callable[[str, str, str], str], key: str | None, system: str = SYSTEM) -> Callable[[str], str]:
    """A converter that hands the system text, the request and the checked key to ``call``."""
    checked = checked_key(key)
    return lambda prompt: call(system, prompt, checked)


def convert(prompts: DataFrame, converter: Callable[[str], str] = stub_converter, seconds_between: float = 0.0, calls_at_once: int = 4) -> DataFrame:
    """``prompts`` with ``response`` and its parsed ``result``; a failing call gives an error row and never fails the job.

    ``seconds_between`` is the least time between two calls of the whole job: with it, the requests are called by as few
    tasks as ``calls_at_once``, each of which waits that many times as long.  Write the result before going on: a task that is run
    again calls again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        last = 0.0
        for pdf in batches:
            out = []
            for prompt in pdf["prompt"]:
                time.sleep(max(0.0, last + seconds_between - time.monotonic()))
                last = time.monotonic()
                try:
                    out.append((converter(prompt), None))
                except Exception as e:  # noqa: BLE001
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pdf.assign(response=[r for r, _ in out], _error=[e for _, e in out])

    if seconds_between > 0:
        prompts, seconds_between = prompts.repartition(calls_at_once), seconds_between * calls_at_once
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    called = prompts.mapInPandas(run, f"{schema}, response string, _error string")
    failed = F.struct(F.concat(F.lit("# ERROR: "), "_error").alias("code"), F.lit("Conversion failed.").alias("explanation"),
                      F.lit(0.0).alias("confidence"), F.col("_error").alias("confidence_notes"))
    return called.withColumn("result", F.when(F.col("_error").isNotNull(), failed).otherwise(parse_response(F.col("response")))).drop("_error")


def averages(results: DataFrame) -> DataFrame:
    """(project, methods_converted, avg_confidence, total_output_lines) of conversions per project; 0 where empty."""
    return results.groupBy("project").agg(
        F.count(F.lit(1)).alias("methods_converted"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.sum(F.size(T.lines_of(F.col("python_code")))), F.lit(0)).alias("total_output_lines"))
