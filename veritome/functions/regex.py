"""From advanced POSIX regular expressions to Java's.

There a newline is an ordinary character and ``^`` and ``$`` anchor the whole
string; bracket classes such as ``[[:alpha:]]`` and the word anchors ``\\m \\M \\y``
exist; classes, escapes such as ``\\w`` and ``\\d``, word anchors and case-insensitive
matching cover the letters and digits of all scripts.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from veritome.errors import BAD_REGEX, EvidenceError

# Bracket classes and escapes.
CLASSES = {
    "alpha": r"\p{IsAlphabetic}", "digit": r"\p{IsDigit}", "alnum": r"\p{IsAlphabetic}\p{IsDigit}", "upper": r"\p{IsUppercase}", "lower": r"\p{IsLowercase}",
    "space": r"\s", "blank": r" \t", "punct": r"\p{IsPunctuation}\p{S}", "cntrl": r"\p{Cntrl}", "xdigit": r"0-9A-Fa-f", "print": r"\p{Print}", "graph": r"\p{Graph}", "word": r"\w",
}
ESCAPES = {"m": r"\b(?=\w)", "M": r"\b(?<=\w)", "y": r"\b", "Y": r"\B", "Z": r"\z", "A": r"\A"}


def to_java(pattern: str, case_insensitive: bool = False) -> str:
    # (?U): the predefined classes by their Unicode properties, word boundaries with them.
    out, i, inside = ["(?iu)" if case_insensitive else "", "(?sU)"], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(ESCAPES.get(pattern[i + 1], pattern[i : i + 2]) if not inside else pattern[i : i + 2])
            i += 2
            continue
        if inside and pattern.startswith("[:", i) and (end := pattern.find(":]", i)) > 0:
            name = pattern[i + 2 : end]
            if name not in CLASSES:
                raise EvidenceError(BAD_REGEX, "invalid_regular_expression", f"invalid character class {name}")
            out.append(CLASSES[name])
            i = end + 2
            continue
        if inside and c in "[&":  # Java would nest or intersect classes
            out.append("\\" + c)
        elif c == "[":
            inside = True
            out.append(c)
            if pattern.startswith("^", i + 1):
                out.append("^")
                i += 1
            if pattern.startswith("]", i + 1):
                out.append("\\]")
                i += 1
        elif c == "]" and inside:
            inside = False
            out.append(c)
        elif c == "$" and not inside:
            out.append(r"\z")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def checked(spark: SparkSession, pattern: str, case_insensitive: bool) -> str:
    """The Java pattern, after the JVM has accepted it."""
    java = to_java(pattern, case_insensitive)
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(java)
    except Exception as error:
        raise EvidenceError(BAD_REGEX, "invalid_regular_expression", f"invalid regular expression: {str(error).splitlines()[0]}") from None
    return java
