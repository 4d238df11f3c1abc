"""Sinks for one finished document."""

from __future__ import annotations

from pathlib import Path

#: Names that tools read by themselves (a fixed value): a header goes before the text.
TOOL_FILES = {"agents.md", "claude.md", "gemini.md"}


def write_document(path: str, text: str, header: str = "", replace: bool = False, mark: str = "-new") -> str:
    """Write a document, with the header where the name is a tool's; an existing file stays unless ``replace``, and the name then gets ``mark``. Returns the path written."""
    at = Path(path)
    body = f"{header}\n\n{text}" if at.name.lower() in TOOL_FILES else text
    if at.exists() and not replace:
        at = at.with_name(at.stem + mark + at.suffix)
    at.write_text(body, encoding="utf-8")
    return str(at)
