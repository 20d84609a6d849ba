"""The exact object path over columns of JSON text or MessagePack: one Arrow pass, no shuffle, whole schemas included recursion."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterator
from functools import cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.plans.ast import DataError
from schemaloom.plans.objects import Single
from schemaloom.sources import msgpack


#: Python frames that a nested value may take, some four for each record within another. A value that needs more, or that
#: the JSON reader finds too deep (some thousands of records), is an error of its row.
MOST_FRAMES = 1 << 16

#: Levels that are tried to learn whether the JSON reader takes as many, and some more, as the trial may start less or more deeply.
TRIED_LEVELS, SURE_LEVELS = 10_000, 10_100

#: Arrays and objects that begin within each other, each as its parent's first. Keys are plain, so that brackets count levels.
KEY, SPACE = r'"[^"\\\x00-\x1f\[\]{}]*+"', r"[ \t\n\r]*+"
DESCENT = re.compile(rf"(?=[\[{{])(?:[\[ \t\n\r]*+(?:\{{{KEY}:)*+(?:\{{{SPACE}{KEY}{SPACE}:{SPACE})*+)*+")


def loads(text: str | bytes) -> Any:
    """JSON, with {"$binary": "HEX"} for bytes; a duplicate key is an error."""

    def pairs(items: list[tuple[str, Any]]) -> Any:
        out: dict[str, Any] = {}
        for k, v in items:
            if k in out:
                raise DataError(f"{k}: Duplicate Key")
            out[k] = v
        return unhexed(out["$binary"]) if out.keys() == {"$binary"} else out

    def read(part: str | bytes) -> Any:
        return json.loads(part, object_pairs_hook=pairs, parse_constant=no_number)

    try:
        if isinstance(text, str) and sinks(text, read):
            raise RecursionError("maximum recursion depth exceeded")
        return read(text)
    except json.JSONDecodeError:
        raise DataError("Invalid data") from None


def openings(text: str) -> int:
    return text.count("[") + text.count("{")


def sinks(text: str, read: Callable[[str], Any]) -> bool:
    """Whether the reader is sure to find the text too deep, before anything else that is wrong with it; sooner than by reading.

    So it is if the reader gets to a descent that is deeper than it can take, and expects a value there.
    """
    start = descent(text)
    if start is None or not ends_early(sys.getrecursionlimit()):
        return False
    try:
        read(text[:start])
    except json.JSONDecodeError as e:
        return e.msg == "Expecting value" and e.pos == start
    except (DataError, RecursionError, ValueError):
        pass
    return False


def descent(text: str) -> int | None:
    """Where the first descent of SURE_LEVELS or more starts. Nothing closes within it, so most texts are passed over in long steps."""
    at = 0
    while at + SURE_LEVELS <= len(text):
        closed = last_closing(text, at, at + SURE_LEVELS)
        if closed < 0:
            end = at + SURE_LEVELS
            while end < len(text) and last_closing(text, end, end + SURE_LEVELS) < 0:
                end += SURE_LEVELS
            closed = end - 1
            if openings(text[at : end + SURE_LEVELS]) >= SURE_LEVELS:
                for m in DESCENT.finditer(text, at):
                    if m.start() > closed:
                        break
                    if m.end() - m.start() >= SURE_LEVELS and openings(m[0]) >= SURE_LEVELS:
                        return m.start()
        at = closed + 1
    return None


def last_closing(text: str, start: int, end: int) -> int:
    return max(text.rfind("]", start, end), text.rfind("}", start, end))


@cache
def ends_early(_: int) -> bool:
    """Whether the JSON reader refuses TRIED_LEVELS, under this limit of frames."""
    for opening in ("[", '{"":'):
        try:
            json.loads(opening * TRIED_LEVELS)
        except RecursionError:
            continue
        except json.JSONDecodeError:
            return False
    return True


def unhexed(digits: Any) -> bytes:
    try:
        return bytes.fromhex(digits)
    except (TypeError, ValueError):
        raise DataError("Invalid data") from None


def no_number(_: str) -> Any:
    """NaN and Infinity aren't JSON."""
    raise DataError("Invalid data")


def plain(x: Any) -> Any:
    if isinstance(x, (bytes, bytearray)):
        return {"$binary": bytes(x).hex().upper()}
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return float(x) if isinstance(x, Single) else x


def dumps(x: Any) -> str:
    return json.dumps(plain(x), ensure_ascii=False, separators=(",", ":"))


def apply(df: DataFrame, column: str, work: Callable[[Any], Any], source: str, sink: str, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (None: all but the column) with ok boolean, error string and value: work's result for each row of the column.

    source, sink: "json" or "msgpack". A null row has a null value and is ok. No value ends the job: what can't be read or
    converted, is nested too deeply or holds NaN is an error of its row.
    """
    keep = [c for c in df.columns if c != column] if keep is None else keep
    read = loads if source == "json" else msgpack.decode
    write: Callable[[Any], Any] = dumps if sink == "json" else msgpack.encode
    kind = pa.string() if sink == "json" else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(MOST_FRAMES, sys.getrecursionlimit()))
        for batch in batches:
            oks, errors, values = [], [], []
            for cell in batch.column("__raw"):
                raw = cell.as_py()
                try:
                    values.append(None if raw is None else write(work(read(raw))))
                    oks.append(True)
                    errors.append(None)
                except (DataError, RecursionError) as e:
                    values.append(None)
                    oks.append(False)
                    errors.append(str(e) if isinstance(e, DataError) else "Nested too deeply")
            made = [pa.array(oks, pa.bool_()), pa.array(errors, pa.string()), pa.array(values, kind)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, names=[*keep, "ok", "error", "value"])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "ok boolean, error string", f"value {'string' if sink == 'json' else 'binary'}"])
    raw = F.col(column).cast("string" if source == "json" else "binary")
    return df.select(*keep, raw.alias("__raw")).mapInArrow(run, schema)
