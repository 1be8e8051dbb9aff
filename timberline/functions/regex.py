"""Patterns of the RE2 dialect for Java's regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

_SPACE = r"\t\n\f\r "


@dataclass(frozen=True)
class JavaPattern:
    """text: the Java pattern; names: of its groups, by position ("" for unnamed ones)."""

    text: str
    names: tuple[str, ...]


def to_java(pattern: str) -> JavaPattern:
    """Translates an RE2 pattern; raises ValueError for what RE2 doesn't have or what is malformed.

    Named groups become positional (Java's names allow no underscore); ``.`` and ``$`` know only the newline as a line
    end; ``\\s`` has no vertical tab.
    """
    out, names, i, n, in_class, flags = [], [], 0, len(pattern), False, ""
    while i < n:
        c = pattern[i]
        if c == "\\":
            if i + 1 >= n:
                raise ValueError(f"trailing backslash in {pattern!r}")
            d = pattern[i + 1]
            if d == "s":
                out.append(_SPACE if in_class else f"[{_SPACE}]")
            elif d == "S":
                if in_class:
                    raise ValueError(f"\\S inside a class isn't supported: {pattern!r}")
                out.append(f"[^{_SPACE}]")
            elif d in "CGZkXRKh" or (d.isdigit() and d != "0"):
                raise ValueError(f"\\{d} isn't supported: {pattern!r}")
            else:
                out.append(c + d)
            i += 2
            continue
        if in_class:
            out.append("\\[" if c == "[" and pattern[i : i + 2] != "[:" else "\\&" if c == "&" else c)
            if pattern.startswith("[:", i):
                end = pattern.find(":]", i)
                if end < 0:
                    raise ValueError(f"open class name in {pattern!r}")
                out[-1] = r"\p{" + {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "space": "Space", "punct": "Punct", "xdigit": "XDigit"}[pattern[i + 2 : end]] + "}"
                i = end + 2
                continue
            in_class = c != "]"
            i += 1
            continue
        if c == "[":
            in_class = True
            out.append(c)
            i += 1
            if pattern.startswith("^", i):
                out.append("^")
                i += 1
            if pattern.startswith("]", i):
                out.append("\\]")
                i += 1
            continue
        if c == "(":
            if m := re.compile(r"\(\?P?<([A-Za-z_]\w*)>").match(pattern, i):
                names.append(m[1])
                out.append("(")
                i = m.end()
                continue
            if pattern.startswith("(?", i):
                m = re.compile(r"\(\?([imsU-]*)([:)])").match(pattern, i)
                if not m or "U" in m[1]:
                    raise ValueError(f"group isn't supported at {i}: {pattern!r}")
                flags += m[1].split("-")[0]
                out.append(m[0])
                i = m.end()
                continue
            names.append("")
        if c == "$" and "m" not in flags:
            c = r"\z"
        out.append(c)
        i += 1
    if in_class:
        raise ValueError(f"open class in {pattern!r}")
    text = "(?d)" + "".join(out)
    try:
        re.compile("".join(out).replace(r"\z", r"\Z").replace(r"\p{", r"[{") if r"\p{" not in text else "")
    except re.error as e:
        raise ValueError(f"bad pattern {pattern!r}: {e}") from None
    return JavaPattern(text, tuple(names))


def around_group(pattern: str) -> tuple[str, str, str] | None:
    """A pattern's parts before, inside and after its only capture group.

    None if the group is repeated, or stands beside a top-level alternative. Raises ValueError unless there is one group.
    """
    spans, stack, i, in_class, top_bar = [], [], 0, False, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class = c != "]" or pattern[i - 1] == "["
        elif c == "[":
            in_class = True
        elif c == "(":
            capture = not pattern.startswith("(?", i) or bool(re.compile(r"\(\?P?<[A-Za-z_]").match(pattern, i))
            stack.append((i, capture))
        elif c == ")":
            if not stack:
                raise ValueError(f"unbalanced group in {pattern!r}")
            a, capture = stack.pop()
            if capture:
                spans.append((a, i, len(stack)))
        elif c == "|" and not stack:
            top_bar = True
        i += 1
    if len(spans) != 1:
        raise ValueError(f"a mask needs exactly one group: {pattern!r}")
    a, b, depth = spans[0]
    if depth or top_bar or pattern[b + 1 : b + 2] in tuple("*+?{"):
        return None
    inside = re.sub(r"^\?P?<\w+>", "", pattern[a + 1 : b])
    return pattern[:a], inside, pattern[b + 1 :]
