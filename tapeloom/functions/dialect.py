"""Regular-expression classes with the meaning they have for Unicode strings, spelt out for Java."""

import re

WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
#: For use inside brackets.
SPACES = r"\t-\r\x1c-\x20\x85\p{Z}"
SPACE = f"[{SPACES}]"
EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
#: Letters that fold to i and k but that Java leaves out of A-Z.
EXTRA = r"İK"


def literal(text: str) -> str:
    """A pattern for text itself."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def spelt(pattern: str) -> str:
    """pattern with W, D, S and B between angle brackets replaced by the classes above; <s> stands inside brackets."""
    table = {"<W>": WORD, "<D>": DIGIT, "<S>": SPACE, "<s>": SPACES, "<B>": EDGE, "<x>": EXTRA}
    return re.sub("<[WDSBsx]>", lambda m: table[m[0]], pattern)


def pythonic(pattern: str) -> str:
    """pattern, as spelt() takes it, in Python's own dialect, whose classes mean just that."""
    table = {"<W>": r"\w", "<D>": r"\d", "<S>": r"\s", "<s>": r"\s", "<B>": r"\b", "<x>": ""}
    return re.sub("<[WDSBsx]>", lambda m: table[m[0]], pattern)
