"""Secret scanning: fixed base patterns plus assignment-aware lexing.

The lexer reads source and configuration syntax (``name = "literal"``, ``name: literal``,
``"name": "literal"``, ``export NAME=literal``, ``name := a + b``, ``setenv(name, literal)``)
into pairs of a target name and the literals that reach it.  Constants propagate: after
``k = "..."`` the assignment ``password = k`` makes k's literal a value of ``password``.
A literal is scored by how sensitive its target names are and how random it looks.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, texts

# Fixed values of the base scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_NAMES = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
# A run that is too short can't hold a long one, so the length may stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "lexed")

Span = tuple[int, int, str]

#: Weights of parts of a target name; a name's sensitivity is the largest of its parts' weights.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "secretkey": 1.0, "privatekey": 1.0, "apikey": 1.0,
    "accesskey": 0.9, "credential": 0.9, "credentials": 0.9, "token": 0.9, "auth": 0.6, "authorization": 0.8, "bearer": 0.8,
    "signingkey": 0.9, "encryptionkey": 0.9, "connectionstring": 0.7, "salt": 0.5, "key": 0.4, "cert": 0.4, "dsn": 0.5,
}
#: Lexed literals count from this score and this length.
THRESHOLD, LEAST_LENGTH = 0.75, 6
#: Literals that stand for a secret: in full, or by how they begin and end.
_PLACEHOLDER = re.compile(r"(?i:x+|\*+|\.+|changeme|none|null|true|false|undefined|example|placeholder)")
_ENCLOSED = (("your-", ""), ("your_", ""), ("your ", ""), ("<", ">"), ("${", "}"), ("{{", "}}"))

_NAME = r"[A-Za-z_$][\w$]*(?:(?:\.|->|::|-)[A-Za-z_$][\w$]*)*"
_STRING = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`\n]*`'
_ATOM = rf"(?:{_STRING}|[A-Za-z0-9_$+/=.\-]+)"
# operator first: the scan stops only at "=" and ":", names are then read backwards
_OPERATOR = re.compile(r"(?:=>|:=|\?=|[:=])(?![=:/])")
# a name, bare or quoted, from its end to its start, however long it and the space after it are
_BACKWARDS = r"[\w$]*[A-Za-z_$](?:(?:\.|>-|::|-)[\w$]*[A-Za-z_$])*"
_NAME_BACK = re.compile(rf"\s*+(?:({_BACKWARDS})|(?:\]\s*+)?[\"']({_BACKWARDS})[\"'])", re.A)
_BLANK = re.compile(r"[ \t]*+")
_VALUE = re.compile(rf"({_ATOM})(?:[ \t]*[+.][ \t]*(?:{_STRING}|{_NAME}))*", re.A)
# names and strings put together; a name is taken whole, as dots may also stand between names
_TOGETHER = re.compile(rf"(?>{_NAME})(?:[ \t]*+[+.][ \t]*+(?>{_STRING}|{_NAME}))*+", re.A)
_PART = re.compile(rf"({_STRING})|({_NAME})", re.A)
_SETTER = re.compile(rf"\b(?:setenv|putenv|set|put|setProperty|define|export|addHeader|setHeader)\s*\(\s*[\"']({_NAME})[\"']\s*,\s*({_STRING}|{_NAME})", re.A)


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, ordered by start, then kind."""
    out: list[Span] = []
    if ASSIGN_NAMES.search(text):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def name_parts(name: str) -> list[str]:
    """Words of a dotted, camel or snake name in lower case, and neighbouring pairs run together."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    words = [w.lower() for w in re.split(r"[^A-Za-z0-9]+", spaced) if w]
    return words + [a + b for a, b in zip(words, words[1:], strict=False)]


def sensitivity(name: str) -> float:
    return max((SENSITIVE.get(w, 0.0) for w in name_parts(name)), default=0.0)


def entropy(counts: Counter, n: int) -> float:
    """Bits a character of a text of ``n`` characters."""
    return -sum(c / n * math.log2(c / n) for c in counts.values() if c) if n else 0.0


def is_placeholder(text: str, start: int, end: int) -> bool:
    if _PLACEHOLDER.fullmatch(text, start, end):
        return True
    head, tail = text[start : min(end, start + 5)].lower(), text[max(start, end - 2) : end]
    return any(head.startswith(a) and tail.endswith(b) and end - start >= len(a) + len(b) for a, b in _ENCLOSED)


def score(name: str, text: str, start: int, end: int, looks: dict[tuple[int, int], tuple[float, bool]]) -> float:
    """Sensitivity of the name plus up to 0.4 for a literal ``text[start:end]`` of many different characters.
    ``looks`` has the entropies that are known already, and whether there is a blank."""
    if end - start < LEAST_LENGTH or is_placeholder(text, start, end):
        return 0.0
    weight = sensitivity(name)
    if not weight:
        return 0.0
    if (start, end) not in looks:
        counts = Counter(text[start:end])
        looks[start, end] = entropy(counts, end - start), " " in counts
    bits, blank = looks[start, end]
    return weight + min(0.4, bits / 10) - (0.3 if blank else 0.0)


def shared_looks(text: str, spans: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[float, bool]]:
    """Entropies of spans that end together, from the shortest on: each adds the characters before the last one's."""
    out, by_end = {}, {}
    for a, b in spans:
        by_end.setdefault(b, []).append(a)
    for b, starts in by_end.items():
        if len(starts) > 1:
            counts, at = Counter(), b
            for a in sorted(starts, reverse=True):
                counts.update(text[a:at])
                out[a, b], at = (entropy(counts, b - a), " " in counts), a
    return out


def assignments(text: str) -> list[tuple[str, list[tuple[int, int] | int]]]:
    """Target names and what is assigned to them: spans of literals, and for each name assigned
    earlier in the same text the place of that assignment in this list."""
    if "=" not in text and ":" not in text and "(" not in text:
        return []
    found: list[tuple[int, str, int, int]] = []
    back, run, run_end, value_end = None, 0, 0, 0
    for m in _OPERATOR.finditer(text):
        at, start = m.start(), _BLANK.match(text, m.end()).end()
        if run <= start < run_end:  # within the unquoted run of the last value, so it ends where that does
            end = value_end
        elif value := _VALUE.match(text, start):
            end = value.end()
            if text[start] not in "\"'`":
                run, run_end, value_end = start, value.end(1), end
        else:
            continue
        back = text[::-1] if back is None else back
        if target := _NAME_BACK.match(back, len(text) - at):
            found.append((at, (target[1] or target[2])[::-1], start, end))
    if "(" in text:
        found += [(m.start(), m[1], m.start(2), m.end(2)) for m in _SETTER.finditer(text)]
    known: dict[str, int] = {}
    out: list[tuple[str, list[tuple[int, int] | int]]] = []
    for _, name, start, end in sorted(found):
        parts: list[tuple[int, int] | int] = []
        if text[start] in "\"'`" or _TOGETHER.fullmatch(text, start, end):
            for p in _PART.finditer(text, start, end):
                if p[1]:
                    parts.append((p.start() + 1, p.end() - 1))
                elif p[2] in known:
                    parts.append(known[p[2]])
        known[name] = len(out)
        out.append((name, parts or [(start, end)]))  # or an unquoted configuration value
    return out


def lexed_spans(text: str) -> list[Span]:
    """Literals whose names and looks score at least THRESHOLD."""
    found = assignments(text)
    weights = {i: w for i, (name, _) in enumerate(found) if (w := sensitivity(name))}
    out, visited = set(), set()
    looks = shared_looks(text, [p for _, parts in found for p in parts if not isinstance(p, int)])
    # most sensitive names first: what one of them reaches can't score more under a later one
    for i in sorted(weights, key=lambda i: -weights[i]):
        name, left = found[i][0], [i]
        while left:
            k = left.pop()
            if k in visited:
                continue
            visited.add(k)
            for part in found[k][1]:
                if isinstance(part, int):
                    left.append(part)
                elif score(name, text, *part, looks) >= THRESHOLD:
                    out.add((*part, "lexed"))
    return sorted(out, key=_order)


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base ones plus lexed literals that none of them covers."""
    base = base_spans(text)
    extra, k, reach = [], 0, 0
    for s in lexed_spans(text):  # both ascend; of the base spans that start no later only the farthest end counts
        while k < len(base) and base[k][0] <= s[0]:
            reach = max(reach, base[k][1])
            k += 1
        if s[1] > reach:
            extra.append(s)
    return base, sorted(base + extra, key=_order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every maximal covered stretch replaced by ``[REDACTED]``."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], "[REDACTED]"]
        at = b
    return "".join([*out, text[at:]])


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_assign, n_access, n_hex, base_sha256, spans`` for every row, without a shuffle.

    Spans are in code points, end exclusive, of whole matches.  Null and empty texts have no span
    (``spans`` is empty and ``base_sha256`` is that of the empty string).  Repeated rows and null
    identifiers pass through; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for text in texts(batch, "body"):
                base, every = scan(text)
                kinds = Counter(s[2] for s in base)
                for col, x in zip(cols, (kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 3 + (pa.string(),) * 2, strict=True))], names=["row_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    out = limit_batches(df).select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("body")).mapInArrow(run, "row_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return out.withColumnRenamed("row_id", id_col)


def redact_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every secret span of its text replaced; null texts stay null, empty ones empty, and all
    other columns, whatever their names, stay as they are.  Repeated rows and rows without an identifier
    are treated like any other; very long texts take time in proportion; an empty table stays empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            new = [None if t is None else redact(t, scan(t)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return limit_batches(df).mapInArrow(run, df.schema)
