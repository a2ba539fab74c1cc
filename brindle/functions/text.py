"""Text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What full case folding does beyond lower() where the result has letters a-z.
FOLDS = {
    "ß": "ss", "ẞ": "ss", "ŉ": "ʼn", "ſ": "s", "ǰ": "ǰ", "ẖ": "ẖ", "ẗ": "ẗ", "ẘ": "ẘ", "ẙ": "ẙ", "ẚ": "aʾ",
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
}
#: Fixed value: words of letters and digits, joined by . _ or -, or runs of CJK characters.
TOKEN = "[a-z0-9]+(?:[._-][a-z0-9]+)*|[一-鿿]+"
#: Fixed value: where a text may be cut.
BOUNDARY = r"(?s)^.*(?:[。！？.!?]\s*|\s+)"
#: Captions of figures and tables.
FIGURE, TABLE = r"(?i)^(?:fig(?:ure)?\.?\s*[0-9]+|图\s*[0-9]+)", r"(?i)^(?:table\s*[0-9]+|表\s*[0-9]+)"
MISSING_FORMULA = "[公式结果不可用]"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def fold(text: Column) -> Column:
    out = F.lower(text)
    for a, b in FOLDS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(text.rlike("[^\\x00-\\x7F]"), out).otherwise(F.lower(text))


def tokenize(text: Column) -> Column:
    """Folded tokens in order; a CJK run gives its characters, then its pairs of neighbours."""
    n = lambda x: F.length(x)
    chars = lambda x: F.transform(F.sequence(F.lit(1), n(x)), lambda i: x.substr(i, F.lit(1)))
    pairs = lambda x: F.when(n(x) > 1, F.transform(F.sequence(F.lit(1), n(x) - 1), lambda i: x.substr(i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    found = F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))
    cjk = text.rlike("[一-鿿]")
    return F.when(cjk, F.flatten(F.transform(found, lambda x: F.when(x.rlike("^[一-鿿]"), F.concat(chars(x), pairs(x))).otherwise(F.array(x))))).otherwise(found)


#: Fixed value: white space of any kind, as strip() takes it off.
SPACE = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LEADING, _TRAILING = re.compile(f"[{SPACE}]*"), re.compile(f"[{SPACE}]+\\Z")
_CUT = re.compile("(?s).*(?:[。！？.!?][ \\t-\\r]*|[ \\t-\\r]+)")


def split_parts(text: str, limit: int) -> list[str]:
    """What split_text() makes of a text without white space at its ends, for one long text at a time: each part is cut from its own place, the rest is not copied."""
    out, at = [], 0
    while len(text) - at > limit:
        found = _CUT.match(text, at, at + limit + 1)
        end = min(at + limit, found.end() if found and found.end() > at else at + limit)
        part = _TRAILING.sub("", text[at:end])
        if part:
            out.append(part)
        at = _LEADING.match(text, end).end()
    return [*out, text[at:]] if at < len(text) else out


def split_text(text: Column, limit: int) -> Column:
    """Parts of at most `limit` characters, cut behind the last sentence mark or white space in reach, else hard."""
    cut = lambda t: F.least(F.lit(limit), F.coalesce(F.nullif(F.length(F.regexp_extract(F.left(t, F.lit(limit + 1)), BOUNDARY, 0)), F.lit(0)), F.lit(limit)))
    steps = F.sequence(F.lit(1), 2 * F.ceil(F.length(text) / limit).cast("int") + 1)
    put = lambda done, part: F.when(part != "", F.concat(done, F.array(part))).otherwise(done)

    def step(s, _):
        t = s["rest"]
        k = cut(t)
        return F.when(F.length(t) > limit, F.struct(put(s["done"], strip(t.substr(F.lit(1), k))).alias("done"), strip(t.substr(k + 1, F.length(t))).alias("rest"))).otherwise(s)

    folded = F.aggregate(steps, F.struct(F.array().cast("array<string>").alias("done"), text.alias("rest")), step, lambda s: put(s["done"], s["rest"]))
    short = F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))
    return F.when(F.length(text) <= limit, short).otherwise(folded)


def caption_kind(text: Column) -> Column:
    return F.when(text.rlike(FIGURE), "figure").when(text.rlike(TABLE), "table")


def sanitize(text: Column) -> Column:
    """Characters that documents may not hold become U+FFFD."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uD800-\\uDFFF\\uFFFE\\uFFFF]", "�")


def url_encode(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def column_letter(n: Column) -> Column:
    """1 is A, 27 is AA; up to three letters."""
    one = lambda k: F.chr(65 + k)
    m = n - 1
    return F.when(n <= 26, one(m)).when(n <= 702, F.concat(one(F.floor(m / 26) - 1), one(m % 26))).otherwise(
        F.concat(one(F.floor((m - 702) / 676)), one(F.floor((m - 702) / 26) % 26), one(m % 26)))
