"""JSON values out of answers: whole, followed by other text, or somewhere within it.

Texts that are JSON as a whole are read by Spark.  The others go to a scanner in Arrow batches.  The scanner looks for
the first place where an object or array begins that is complete.  An attempt notes the
containers that it saw: those that it completed are values themselves, and those that it left open can't be any, so
neither is scanned again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

_SPACE = re.compile(r"[ \t\n\r]*+")
_SCALAR = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*+"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|NaN|-?Infinity')
_ROOTS = {"object": "{", "array": "["}


def complete(text: str, at: int, ended: dict[int, int], dead: set[int]) -> int | None:
    """Where the container that begins at ``at`` ends, or none.  ``ended`` gets the ends of the containers
    completed on the way, ``dead`` the beginnings of those that can't be completed."""
    stack: list[int] = []
    # what may come next: a value, a value or the end of an array, a name, a name or the end of an object, or a separator
    state = "value"
    while True:
        at = _SPACE.match(text, at).end()
        c = text[at] if at < len(text) else ""
        if c in ("}", "]") and stack and state in ("more", f"first{c}") and text[stack[-1]] == ("{" if c == "}" else "["):
            ended[stack.pop()] = at + 1
            if not stack:
                return at + 1
            at, state = at + 1, "more"
        elif state == "more" and c == ",":
            at, state = at + 1, "name" if text[stack[-1]] == "{" else "value"
        elif state in ("name", "first}") and c == '"' and (m := _SCALAR.match(text, at)):
            at = _SPACE.match(text, m.end()).end()
            if text[at : at + 1] != ":":
                break
            at, state = at + 1, "value"
        elif state in ("value", "first]") and c in ("{", "[") and c:
            if at in ended:
                at, state = ended[at], "more"
                continue
            if at in dead:
                break
            stack.append(at)
            at, state = at + 1, "first}" if c == "{" else "first]"
        elif state in ("value", "first]") and stack and (m := _SCALAR.match(text, at)):
            at, state = m.end(), "more"
        else:
            break
    dead.update(stack)
    return None


def _kind(value: object) -> str:
    return "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "scalar"


def _prefix(text: str) -> tuple[bool, object]:
    """A value at the start of ``text``, whatever follows."""
    text = text.lstrip()
    try:
        if text[:1] in ("{", "["):
            end = complete(text, 0, {}, set())
            return (False, None) if end is None else (True, json.loads(text[:end]))
        m = _SCALAR.match(text)
        return (True, json.loads(m[0])) if m else (False, None)
    except (ValueError, RecursionError):
        return False, None


def value_in(text: str, preferred: str | None = None) -> tuple[bool, object]:
    """Whether ``text`` holds a JSON value, and the one of the ``preferred`` root (``object`` or ``array``) that comes first,
    else the first of any.  A value at the very start counts first; line ends within strings are tried as blanks."""
    first: tuple[bool, object] = (False, None)
    for t in [text] + ([text.replace("\n", " ")] if "\n" in text else []):
        got = _prefix(t)
        if got[0]:
            if preferred is None or _kind(got[1]) == preferred:
                return got
            first = first if first[0] else got
        ended: dict[int, int] = {}
        dead: set[int] = set()
        for m in re.finditer(re.escape(_ROOTS[preferred]) if preferred else r"[{\[]", t):
            if m.start() in dead:
                continue
            end = ended.get(m.start()) or complete(t, m.start(), ended, dead)
            if end is not None:
                try:
                    return True, json.loads(t[m.start() : end])
                except (ValueError, RecursionError):
                    continue
    return first


def json_values(df: DataFrame, column: str, preferred: str | None = None, out: str = "value") -> DataFrame:
    """``df`` with ``out``: the JSON value in ``column`` as compact text with sorted names, null where there is none.

    Blocks of reasoning are dropped first.  Nulls stay null.
    """
    names = df.columns
    clean = df.withColumn("text_", T.without_reasoning(F.col(column)))
    parsed = F.try_parse_json("text_")
    kind = F.schema_of_variant(parsed)
    fits = parsed.isNotNull() & (F.lit(True) if preferred is None else kind.startswith("OBJECT" if preferred == "object" else "ARRAY"))
    fits = fits | F.col("text_").isNull()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [value_in(t, preferred) for t in batch.column("text_").to_pylist()]
            texts = [json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) if ok else None for ok, v in found]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string())], names=[*names, out])

    whole = clean.where(fits).select(*names, F.to_json(F.try_parse_json("text_")).alias(out))
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out}` string"
    return whole.unionByName(clean.where(~fits).mapInArrow(scan, schema))
