"""Spark regular expressions that mean what the fixed patterns mean.

The fixed patterns assume Unicode words, digits and blanks, a dot that stops
only at a newline and ``^``/``$`` that know only the newline. Java's defaults
differ in all of these, so the classes are spelled out.
"""

# The one letter beyond the basic plane (it is in \p{L} anyway) makes Java look
# behind by whole characters instead of by halves of such characters.
WORD = r"[a-zA-Z0-9_\p{L}\p{N}" + "\U00010400]"
DIGIT = r"\p{Nd}"
_OTHERS = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK = rf"[ {_OTHERS}]"
NOT_BLANK = rf"[^ {_OTHERS}]"
# Blanks that are not one plain space already.
BLANK_RUN = rf" {BLANK}+|[{_OTHERS}]{BLANK}*"
BLANK_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


def spark_pattern(
    pattern: str, ignore_case: bool = False, multiline: bool = False, dot_all: bool = False
) -> str:
    flags = "d" + "iu" * ignore_case + "m" * multiline + "s" * dot_all
    out, at, boundary_opens = [], 0, True
    while at < len(pattern):
        token = pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
        at += len(token)
        if token == r"\b":
            # Every boundary in use touches a word character on one side.
            out.append(f"(?<!{WORD})" if boundary_opens else f"(?!{WORD})")
            continue
        out.append({r"\w": WORD, r"\d": DIGIT, r"\s": BLANK, r"\S": NOT_BLANK}.get(token, token))
        boundary_opens = token in ("|", "(")
    return f"(?{flags})" + "".join(out)
