"""Questions as they come in: which are taken, and why others are not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import strip
from brindle.operators.ranking import MODES

#: Limits of a request.
CHARACTERS, DOCUMENTS, SECTION = 8000, 100, 200
COLLECTION = r"\A[a-zA-Z0-9_-]{1,64}\z"
CONTENT_TYPES = ("text", "table", "figure")
FIELDS = {"question": "string", "k": "int", "collection": "string", "mode": "string", "document_ids": "array<string>", "page": "int", "section": "string", "content_type": "string"}


def validated(requests: DataFrame, most: int = 20) -> DataFrame:
    """requests with question trimmed, and reason: the first rule that is broken (blank, length, k, collection, mode, documents, page, section, content_type), null if none is. Columns
    of FIELDS that are absent, and nulls in the optional ones (the last four), break no rule; a null question is blank, another null field breaks its own. most: the
    largest k, 20 where users ask, 100 where programs do."""
    has = set(requests.columns)
    c = {name: F.col(name) for name in FIELDS if name in has}
    rules = {
        "blank": ("question", lambda x: strip(F.coalesce(x, F.lit(""))) != ""), "length": ("question", lambda x: F.length(x) <= CHARACTERS), "k": ("k", lambda x: x.between(1, most)),
        "collection": ("collection", lambda x: x.rlike(COLLECTION)), "mode": ("mode", lambda x: x.isin("auto", *MODES)), "documents": ("document_ids", lambda x: x.isNull() | (F.size(x) <= DOCUMENTS)),
        "page": ("page", lambda x: x.isNull() | (x >= 1)), "section": ("section", lambda x: x.isNull() | (F.length(x) <= SECTION)),
        "content_type": ("content_type", lambda x: x.isNull() | x.isin(*CONTENT_TYPES)),
    }
    reason = F.lit(None).cast("string")
    for name, (field, good) in reversed(rules.items()):
        if field in c:
            reason = F.when(~F.coalesce(good(c[field]), F.lit(False)), name).otherwise(reason)
    out = requests.withColumn("reason", reason)
    return out.withColumn("question", strip(F.col("question"))) if "question" in has else out


def split(requests: DataFrame, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """The accepted requests, without a reason, and the rejected ones with theirs."""
    told = validated(requests, most)
    return told.where("reason IS NULL").drop("reason"), told.where("reason IS NOT NULL")
