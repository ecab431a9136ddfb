"""JSON and credentials inside free text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_MARK = re.compile(r'[{}\[\]"\\]')


def _fenced(text: str, opener: str) -> str | None:
    at = text.find(opener)
    if at < 0:
        return None
    line = text.find("\n", at + len(opener))
    begin = line + 1 if line >= 0 else at + len(opener)
    end = text.find("```", begin)
    return text[begin:end].strip() or None if end >= 0 else None


def _balanced(text: str) -> str | None:
    """The first object or array that closes, counting only its own kind of bracket outside strings."""
    for start in re.finditer(r"[{\[]", text):
        opening, closing = start[0], "}" if start[0] == "{" else "]"
        depth, quoted, skip = 0, False, -1
        for m in _MARK.finditer(text, start.start()):
            c, at = m[0], m.start()
            if at == skip:
                continue
            if c == "\\":
                skip = at + 1 if quoted else skip
            elif c == '"':
                quoted = not quoted
            elif not quoted:
                depth += (c == opening) - (c == closing)
                if c == closing and depth == 0:
                    return text[start.start() : at + 1]
    return None


def first_json(text: str | None) -> str | None:
    """A ```json fence, else a plain fence that starts like JSON, else the first balanced object or array."""
    if text is None:
        return None
    text = text.strip()
    named = _fenced(text, "```json")
    if named:
        return named
    plain = _fenced(text, "```")
    return plain if plain and plain[0] in "{[" else _balanced(text)


@F.pandas_udf(StringType())
def extract_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(first_json)


def parse_json(text: Column | str, schema: str) -> Column:
    """struct<status, value>: ok, no_json_found, or deserialize_error where the JSON does not fit `schema`."""
    found = extract_json(text)
    value = F.from_json(found, schema, {"mode": "PERMISSIVE"})
    bad = F.try_parse_json(found).isNull()
    status = F.when(found.isNull(), "no_json_found").when(bad | value.isNull(), "deserialize_error").otherwise("ok")
    return F.struct(status.alias("status"), F.when(status == "ok", value).alias("value"))


_ANSI_C = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"', "0": "\0", "a": "\a", "b": "\b", "e": "\x1b", "f": "\f", "v": "\v"}


def shell_value(raw: str | None) -> str | None:
    """A dotenv value decoded: $'...' with escapes, '...' as it is, "..." with \\", \\\\, \\$ and \\`, else bare."""
    if raw is None:
        return None
    v = raw.strip()
    if len(v) >= 3 and v.startswith("$'") and v.endswith("'"):
        return re.sub(r"\\(.)", lambda m: _ANSI_C.get(m[1], m[0]), v[2:-1])
    if len(v) >= 2 and v[0] == v[-1] == "'":
        return v[1:-1].replace("'\\''", "'")
    if len(v) >= 2 and v[0] == v[-1] == '"':
        return re.sub(r'\\(["\\$`])', r"\1", v[1:-1])
    return v


@F.pandas_udf(StringType())
def shell_decode(values: pd.Series) -> pd.Series:
    return values.map(shell_value)


@F.pandas_udf(StringType())
def shell_encode(values: pd.Series) -> pd.Series:
    """Bare where safe; quoted, or $'...' where there are control characters."""

    def one(v: str | None) -> str | None:
        if v is None or re.fullmatch(r"[A-Za-z0-9_./:@%+,-]+", v):
            return v
        if any(c in v for c in "\n\r\t"):
            return "$'" + v.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + "'"
        return "'" + v.replace("'", "'\\''") + "'"

    return values.map(one)
