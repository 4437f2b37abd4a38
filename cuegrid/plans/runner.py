"""Where programs and models plug in: functions over rows, run by the executors. Nothing is called unless asked.

``run`` executes argument lists, ``transcribe`` calls a speech recogniser on media paths. Both return a row for
each input with an error text instead of raising, so that one bad item does not stop a batch. Tests pass their
own callables; there is neither ffmpeg nor a model here.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _call(arguments: list[str]) -> tuple[int, str]:
    done = subprocess.run(arguments, capture_output=True, text=True, check=False)
    return done.returncode, done.stderr[:500]


def run(plans: DataFrame, key: str, argv: str = "argv", call: Callable[[list[str]], tuple[int, str]] = _call) -> DataFrame:
    """(key, exit_code, error) after executing each argument list; error is null where all went well."""
    kind = dict(plans.dtypes)[key]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, arguments in zip(pdf[key], pdf[argv], strict=True):
                try:
                    code, text = call(list(arguments))
                except Exception as e:  # the row says so
                    code, text = -1, f"{type(e).__name__}: {e}"
                rows.append((k, code, text[:500] if code else None))
            yield pd.DataFrame(rows, columns=[key, "exit_code", "error"])

    return plans.select(key, argv).mapInPandas(work, f"{key} {kind}, exit_code int, error string")


def transcribe(media: DataFrame, recognise: Callable[[str], dict], key: str = "media", path: str = "path") -> DataFrame:
    """(media, transcript, error): ``recognise`` returns a transcript object in any layout that
    ``readers.transcript_words`` knows; it is kept as JSON for ``from_json(transcript, readers.TRANSCRIPT)``."""
    import json

    kind = dict(media.dtypes)[key]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, p in zip(pdf[key], pdf[path], strict=True):
                try:
                    rows.append((k, json.dumps(recognise(p), ensure_ascii=False), None))
                except Exception as e:  # the row says so
                    rows.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "transcript", "error"])

    return media.select(key, path).mapInPandas(work, f"{key} {kind}, transcript string, error string")


# The names of backends, and the model of the one that has its own.
WHISPER, OWN_MODEL = ("auto", "whisper"), {"elevenlabs": "scribe_v1"}


def backend_choice(requested: Column, mlx: Column, faster: Column, key: Column) -> Column:
    """struct<backend, error>: the backend of a request, by which there are (booleans) and whether there is a key for
    the one that needs it. A general request takes the first that is there."""
    general = requested.isin(*WHISPER)
    backend = F.when((general | (requested == "mlx")) & mlx, "mlx").when((general | (requested == "faster-whisper")) & faster, "faster-whisper").when((requested == "elevenlabs") & key, "elevenlabs")
    error = F.when(general, "no backend is available").when(requested.isin("mlx", "faster-whisper"), F.concat(requested, F.lit(" is not available"))).when(requested == "elevenlabs", "no key for elevenlabs").otherwise(F.concat(F.lit("unsupported backend: "), F.coalesce(requested, F.lit("none"))))
    return F.struct(backend.alias("backend"), F.when(backend.isNull(), error).alias("error"))


def model_name(backend: Column, model: Column) -> Column:
    """The model that a backend really uses."""
    out = model
    for name, own in OWN_MODEL.items():
        out = F.when(backend == name, own).otherwise(out)
    return out
