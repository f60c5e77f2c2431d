"""Identifier checks and statement classification."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import count

from shardloom.errors import EngineError

_PART = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
# Statement prefixes that only read.
READS = ("SELECT", "VALUES", "TABLE", "PRAGMA", "EXPLAIN", "WITH", "SHOW")


#: Quoted text and comments, in which nothing is a keyword, a column or a placeholder.
QUOTED = re.compile(r"'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\"\"|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.DOTALL)


def outside(sql: str, change: Callable[[str], str], quoted: Callable[[str], str] = str) -> str:
    """``sql`` with ``change`` applied to what lies outside quotes and comments, and ``quoted`` to those."""
    out, at = [], 0
    for m in QUOTED.finditer(sql):
        out += [change(sql[at : m.start()]), quoted(m.group())]
        at = m.end()
    return "".join(out) + change(sql[at:])


def quote(name: str) -> str:
    """Backtick-quoted identifier, each dotted part checked."""
    parts = [p.strip() for p in name.strip().split(".")]
    if not all(_PART.match(p) for p in parts):
        raise EngineError(f"Invalid SQL identifier: {name!r}", "INVALID_IDENTIFIER")
    return ".".join(f"`{p}`" for p in parts)


def operation(sql: str) -> str:
    """``read`` or ``write`` by the statement's first word alone (so a leading comment makes a write)."""
    return "read" if sql.strip().upper().startswith(READS) else "write"


def split_statements(script: str) -> list[str]:
    """Statements between semicolons, minding quotes and comments; comment-only ones are dropped."""
    out, now, i, code = [], [], 0, False
    while i < len(script):
        c = script[i]
        if c in "'\"`":
            end = i + 1
            while end < len(script) and (script[end] != c or script[end : end + 2] == c * 2):
                end += 2 if script[end] == c else 1
            now.append(script[i : end + 1])
            i, code = end + 1, True
        elif script.startswith("--", i):
            end = script.find("\n", i)
            i = len(script) if end < 0 else end
        elif script.startswith("/*", i):
            end = script.find("*/", i)
            i = len(script) if end < 0 else end + 2
        elif c == ";":
            if code:
                out.append("".join(now).strip())
            now, code, i = [], False, i + 1
        else:
            now.append(c)
            code = code or not c.isspace()
            i += 1
    if code:
        out.append("".join(now).strip())
    return out


def placeholders(sql: str) -> int:
    """Number of ``?`` outside quotes and comments."""
    return re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", "", sql, flags=re.DOTALL).count("?")


def check_arity(sql: str, args: list | tuple | None) -> None:
    if (want := placeholders(sql)) != (got := len(args or ())):
        raise EngineError(f"{want} placeholders, {got} bindings", "BINDINGS_MISMATCH")


def numbered(sql: str) -> str:
    """``?`` placeholders as $1, $2 and so on, for databases that number them."""
    n = count(1)
    return outside(sql, lambda text: re.sub(r"\?", lambda _: f"${next(n)}", text))
