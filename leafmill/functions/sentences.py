"""``functions.text.split_sentences`` for a single text in a Python worker."""

from __future__ import annotations

import re
import unicodedata

from leafmill.functions import text as T

_SPACE = r"[ \t\n\x0b\f\r]"
_SHORT_STOP = re.compile(rf"(?<![\w.])({'|'.join(map(re.escape, T.ABBREVIATIONS))}|[A-HJ-Z])\.(?={_SPACE})")
_INNER_STOP = re.compile(rf"""\.(?=["')\]]*{_SPACE}+([^\W\d_]))""")
_END = re.compile(rf"""([.!?]["')\]]*){_SPACE}+""")
#: A character that stands in no text: the place of a stop that ends no sentence.
_STOP = "\ufffe"


def sentences(text: str) -> list[str]:
    """The sentences that ``functions.text.split_sentences`` finds."""
    held = _SHORT_STOP.sub(rf"\1{_STOP}", text)
    held = _INNER_STOP.sub(lambda m: _STOP if unicodedata.category(m[1]) == "Ll" else ".", held)
    return [s for x in _END.sub(rf"\1{T.END}", held).split(T.END) if (s := x.replace(_STOP, ".").strip())]
