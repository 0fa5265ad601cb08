"""Markdown records: TOML front matter between +++ lines, and a body."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.errors import ConfigError, ValidationError
from recordloom.sources import toml

_H1 = re.compile(r"^# ([^\n\r]+?)[\t ]*\r?$", re.MULTILINE)


def first_h1(body: str) -> str | None:
    m = _H1.search(body)
    return m[1].strip() if m else None


def rewrite_h1(body: str, title: str) -> str:
    m = _H1.search(body)
    return f"{body[: m.start()]}# {title}{body[m.end() :]}" if m else f"# {title}\n\n{body}"


def split(text: str) -> tuple[str, str]:
    """(front matter, body). A text that doesn't open with +++ is all body; later +++ lines belong to the body."""
    text = text.removeprefix("﻿")
    m = re.match(r"\+\+\+[ \t]*\r?\n(.*?)(?:^|(?<=\n))\+\+\+[ \t]*(?:\r?\n|$)", text, re.DOTALL)
    if not m:
        if re.match(r"\+\+\+[ \t]*(\r?\n|$)", text):
            raise ConfigError("front matter is not closed")
        return "", text
    body = text[m.end() :]
    return m[1], body.removeprefix("\r\n").removeprefix("\n")


def parse(text: str, body_field: str = "body", title_field: str | None = None, with_body: bool = True) -> dict[str, Any]:
    """The record of a text; with a title field, its title is the first heading of the body where it has none of its own."""
    front, body = split(text)
    record = toml.parse(front)
    if title_field and title_field not in record and (h1 := first_h1(body)) is not None:
        record[title_field] = h1
    if with_body:
        record[body_field] = body
    return record


def serialize(record: dict[str, Any], body_field: str = "body", title_field: str | None = None) -> str:
    """Front matter and body. With a title field, the title must be the first heading and is left out of the front matter."""
    own = dict(record)
    body = own.pop(body_field, "") or ""
    if title_field:
        h1 = first_h1(body)
        title = own.pop(title_field, None)
        if title is not None and h1 is not None and title != h1:
            raise ValidationError(f"{title_field} {title!r} is not the first heading {h1!r}", issues=[{"path": f"/{title_field}", "code": "title", "message": "differs from the first heading"}])
        if title is not None and h1 is None:
            body = rewrite_h1(body, title)
    front = toml.serialize(own)
    return f"+++\n{front}+++\n\n{body}" if front or body.startswith("+++") else body


def reconcile(old: dict[str, Any], patch: dict[str, Any], body_field: str, title_field: str) -> dict[str, Any]:
    """A patch with title and body made to agree: a new title rewrites the heading, a new body brings its own title."""
    out = dict(patch)
    if body_field in patch and title_field not in patch:
        out[title_field] = first_h1(patch[body_field] or "")
    elif title_field in patch and body_field not in patch and patch[title_field] is not None:
        out[body_field] = rewrite_h1(old.get(body_field) or "", patch[title_field])
    return out


def front_column(text: Column) -> Column:
    """Front matter of each text as TOML, '' without any; only built-in functions, so a body that isn't asked for costs nothing more."""
    bare = F.regexp_replace(text, "^﻿", "")
    return F.regexp_extract(bare, r"(?s)\A\+\+\+[ \t]*\r?\n(.*?)(?<=\n)\+\+\+[ \t]*(?:\r?\n|\z)", 1)


def body_column(text: Column) -> Column:
    """Body of each text."""
    bare = F.regexp_replace(text, "^﻿", "")
    return F.regexp_replace(bare, r"(?s)\A\+\+\+[ \t]*\r?\n(?:.*?(?<=\n))?\+\+\+[ \t]*(?:\r?\n|\z)(?:\r?\n)?", "")
