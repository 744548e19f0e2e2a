"""The read-only statement rule, for one statement and for columns of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Words a read-only statement may not contain, and the texts
# that explain a refusal.
FORBIDDEN_WORDS = (
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "REPLACE",
    "TRUNCATE", "GRANT", "REVOKE", "CALL", "EXEC", "EXECUTE", "LOAD", "INTO",
    "OUTFILE", "DUMPFILE", "HANDLER", "LOCK", "UNLOCK", "SET", "USE", "RENAME",
    "ATTACH", "MERGE", "DELIMITER",
)
EMPTY = "Query text is required."
CHAINED = "Only a single statement is allowed (no ';' chaining)."
COMMENTED = "SQL comments are not allowed."
NOT_SELECT = "Only SELECT or WITH (CTE) queries are allowed."
DISALLOWED = "Disallowed keyword in query: {}."

# What opens a comment, and how a statement must start.
_COMMENT_MARKS = ("--", "/*", "#")
_START = r"^\s*\(*\s*(?:SELECT|WITH)\b"
_FORBIDDEN = rf"\b({'|'.join(FORBIDDEN_WORDS)})\b"
# The characters taken as blank, and those dropped from the end.
_BLANKS = (
    "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_TRAILING = "; \t\r\n"
# Java needs flags to read \b and \s by Unicode as Python does.
_JAVA = "(?iU)"


def check_statement(sql: str | None) -> tuple[str, str | None]:
    """Return the statement to run and, if it is refused, why."""
    body = (sql or "").strip(_BLANKS).rstrip(_TRAILING).strip(_BLANKS)
    if not body:
        return body, EMPTY
    if ";" in body:
        return body, CHAINED
    if any(mark in body for mark in _COMMENT_MARKS):
        return body, COMMENTED
    if not re.search(_START, body, re.IGNORECASE):
        return body, NOT_SELECT
    word = re.search(_FORBIDDEN, body, re.IGNORECASE)
    return body, DISALLOWED.format(word.group(1).upper()) if word else None


def statement_error(sql: Column) -> Column:
    """Why a statement is refused; null when it is accepted."""
    blanks = F.lit(_BLANKS)
    body = F.btrim(F.rtrim(F.btrim(sql, blanks), F.lit(_TRAILING)), blanks)
    commented = F.lit(False)
    for mark in _COMMENT_MARKS:
        commented = commented | F.contains(body, F.lit(mark))
    word = F.upper(F.regexp_extract(body, _JAVA + _FORBIDDEN, 1))
    before, after = DISALLOWED.split("{}")
    return (
        F.when(F.coalesce(body, F.lit("")) == "", F.lit(EMPTY))
        .when(F.contains(body, F.lit(";")), F.lit(CHAINED))
        .when(commented, F.lit(COMMENTED))
        .when(~body.rlike(_JAVA + _START), F.lit(NOT_SELECT))
        .when(word != "", F.concat(F.lit(before), word, F.lit(after)))
    )
