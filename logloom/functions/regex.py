r"""Rule patterns are written in Python's ``re`` dialect; Spark evaluates Java's.

Patterns are compiled with ``re`` on the driver first, so a bad one fails when the rule is built and not
in a running job. What differs between the dialects is rewritten: named groups become numbered ones,
``\Z`` becomes ``\z``, and characters that are special only in Java classes are escaped.
"""

import re

_TOKEN = re.compile(r"\\.|\(\?P<\w+>|\(\?P=\w+\)|\(\?#[^)]*\)|.", re.S)


def java_pattern(pattern: str, ignore_case: bool = True) -> str:
    """The Java form of ``pattern``. Raises ``re.error`` if it is not valid."""
    groups = re.compile(pattern).groupindex
    out, in_class, class_start = [], False, False
    for match in _TOKEN.finditer(pattern):
        token = match.group()
        if in_class:
            if token == "]" and not class_start:
                in_class = False
            elif token in ("[", "&") or (token == "]" and class_start):
                token = "\\" + token
            elif token.startswith("(?P"):
                token = "".join("\\" + c if c in "[&" else c for c in token)
            class_start = class_start and token == "^"
        elif token == "[":
            in_class = class_start = True
        elif token.startswith("(?P<"):
            token = "("
        elif token.startswith("(?P="):
            token = rf"(?:\{groups[token[4:-1]]})"
        elif token.startswith("(?#"):
            token = ""
        elif token == r"\Z":
            token = r"\z"
        out.append(token)
    return ("(?iUd)" if ignore_case else "(?Ud)") + "".join(out)


_REF = re.compile(r"\\g<(\w+)>|\\(\d{1,2})|\\(.)|([$\\])|([^$\\]+)", re.S)
# The escapes that a replacement template knows besides group references.
_CONTROL = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a", "b": "\b"}


def java_replacement(replacement: str, pattern: str) -> str:
    """The Java form of a replacement template: group references and literal ``$`` and backslash."""
    groups = re.compile(pattern).groupindex
    out = []
    for name, number, escaped, special, plain in _REF.findall(replacement):
        if name or number:
            index = int(number or (name if name.isdigit() else groups[name]))
            out.append(f"${index}")
        elif escaped:
            text = _CONTROL.get(escaped, escaped if escaped == "\\" else "\\" + escaped)
            out.append(text.replace("\\", "\\\\").replace("$", "\\$"))
        elif special:
            out.append("\\" + special)
        else:
            # An escaped digit after a reference is a literal in Java.
            if out and out[-1].startswith("$") and plain[0].isdigit():
                plain = "\\" + plain
            out.append(plain)
    return "".join(out)


def literal(term: str) -> str:
    """A pattern that matches ``term`` and nothing else, in any case."""
    return "(?iu)" + "".join(c if c.isalnum() or ord(c) > 127 else f"\\x{{{ord(c):x}}}" for c in term)
