"""Text column functions: normalising, cutting, time codes, safe cells, fingerprints."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Reaction marks of live chat.
REACTIONS = "ㅋ{2,}|ㅎ{2,}|ㄷㄷ|와{1,}|우와|대박|레전드|미쳤|미친|헐|뭐야|실화|나이스|개웃|웃겨|!{2,}|\\?{2,}"


# whole texts go to Python a hundred rows at a time: an Arrow batch would hold ten thousand of them, and as many results
@F.udf(StringType(), useArrow=False)
def nfkc(text: str | None) -> str | None:
    """Compatibility composition; Spark has no function for it."""
    return None if text is None else unicodedata.normalize("NFKC", text)


def needs_nfkc(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7F]")


def composed(text: Column) -> Column:
    """Text in compatibility composition; only texts that may change are given to Python."""
    return F.coalesce(nfkc(F.when(needs_nfkc(text), text)), text)


@F.udf(StringType(), useArrow=False)
def nfc(text: str | None) -> str | None:
    """Canonical composition."""
    return None if text is None else unicodedata.normalize("NFC", text)


def norm_repeat(text: Column) -> Column:
    """In compatibility composition and lower case, without white space, runs of three or more squeezed to two, first 160."""
    bare = F.regexp_replace(F.lower(composed(text)), r"\s+", "")
    return F.left(F.regexp_replace(bare, r"(.)\1{2,}", "$1$1"), F.lit(160))


def is_reaction(text: Column) -> Column:
    return text.rlike(f"(?i)(?:{REACTIONS})")


#: White space as the patterns of other engines mean it: Unicode's separators and the byte order mark too.
_BLANK = r"[\s\p{Z}\x{FEFF}]"


def clean_text(text: Column, most: int) -> Column:
    """In compatibility composition, control and format marks to space, white space collapsed, trimmed, cut by code points."""
    plain = F.regexp_replace(F.regexp_replace(composed(text), r"[\p{Cc}\p{Cf}]", " "), f"{_BLANK}+", " ")
    return F.trim(F.left(F.trim(plain), F.lit(most)))


def norm_title(title: Column) -> Column:
    """Title in compatibility composition and lower case, without a video file's extension and bracketed id, marks to space."""
    bare = F.regexp_replace(composed(title), rf"(?i)\.(?:mp4|webm|mkv|mov|m4v){_BLANK}*\z", "")
    bare = F.regexp_replace(bare, rf"\[{_BLANK}*[A-Za-z0-9_-]{{11}}{_BLANK}*\]{_BLANK}*\z", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(bare), r"[\p{P}\p{S}]+", " "), f"{_BLANK}+", " "))


def head_tail(text: Column, most: int, mark: str = " … ") -> Column:
    """Two thirds from the head and one third from the tail of longer texts, by code points."""
    room = most - len(mark)
    head = -(-room * 2 // 3)
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(mark), F.right(text, F.lit(room - head))))


def representative(text: Column, most: int, slices: int = 4, mark: str = " … ") -> Column:
    """Evenly spaced slices of longer texts, joined by a mark."""
    width = (most - len(mark) * (slices - 1)) // slices
    last = F.char_length(text) - width
    parts = [F.substring(text, (F.floor(last * i / (slices - 1) + 0.5) + 1).cast("int"), F.lit(width)) for i in range(slices)]
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat_ws(mark, *parts))


def allocate_bytes(lengths: Column, weights: list[int], budget: Column, floor: int) -> Column:
    """Bytes for each of several fields of these lengths: at least floor or its length, and the rest of the budget in
    rounds by weight, until all fields are whole or nothing is left."""

    @F.pandas_udf("array<bigint>")
    def share(sizes: pd.Series, budgets: pd.Series) -> pd.Series:
        return pd.Series([_allocated([int(n) for n in s], weights, int(b), floor) for s, b in zip(sizes, budgets, strict=True)])

    return share(lengths, budget)


def _allocated(sizes: list[int], weights: list[int], budget: int, floor: int) -> list[int]:
    given = [min(n, floor) for n in sizes]
    left = budget - sum(given)
    while left > 0 and any(g < n for g, n in zip(given, sizes, strict=True)):
        active = [k for k, n in enumerate(sizes) if given[k] < n]
        whole, total = left, sum(weights[k] for k in active)
        for k in active:
            more = min(max(1, whole * weights[k] // total), sizes[k] - given[k], left)
            given[k] += more
            left -= more
    return given


def head_tail_bytes(text: Column, most: Column, mark: str = "…") -> Column:
    """Two thirds from the head and one third from the tail of texts of more than most bytes; no character is cut."""

    @F.udf("string", useArrow=False)
    def cut(text: str | None, limit: int) -> str | None:
        return _cut(text, int(limit), mark)

    return F.when(F.octet_length(text) <= most, text).otherwise(cut(F.when(F.octet_length(text) > most, text), most))


def _cut(text: str | None, most: int, mark: str) -> str | None:
    if text is None:
        return None
    raw, room = text.encode(), max(0, most - len(mark.encode()))
    head = -(-room * 2 // 3)
    tail = room - head
    return raw[:head].decode(errors="ignore") + mark + (raw[len(raw) - tail :].decode(errors="ignore") if tail else "")


def timecode(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), (F.floor(s / 60) % 60).cast("long"), (s % 60).cast("long"))


def srt_time(ms: Column) -> Column:
    return F.concat(timecode(ms), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


def sentences(text: Column) -> Column:
    """Stretches up to the marks that end a sentence, or to the end of a line; blank ones are left out."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?\n]+[.!?]*"), 0), lambda s: F.trim(s)), lambda s: s != "")


def csv_safe(text: Column) -> Column:
    """A cell that no spreadsheet reads as a formula."""
    return F.when(text.rlike(r"^[\t\r ]*[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def video_id(text: Column) -> Column:
    """Eleven-character id of a watch, short, embed or live address, or of a bracket in a file name."""
    found = [F.regexp_extract(text, p, 1) for p in (r"[?&]v=([A-Za-z0-9_-]{11})(?:[^A-Za-z0-9_-]|$)", r"youtu\.be/([A-Za-z0-9_-]{11})(?:[^A-Za-z0-9_-]|$)", r"/(?:shorts|embed|live)/([A-Za-z0-9_-]{11})(?:[^A-Za-z0-9_-]|$)", r"\[([A-Za-z0-9_-]{11})\]")]
    return F.coalesce(*(F.when(f != "", f) for f in found))


def terms(text: Column) -> Column:
    """Distinct words of two letters or more, in compatibility composition and lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(composed(text)), r"[^\p{L}\p{N}]+"), lambda w: F.char_length(w) >= 2))


def match_ratio(a: Column, b: Column) -> Column:
    """Share of the first terms that the second have."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def token_overlap(a: Column, b: Column, most: int = 8) -> Column:
    """Lengths of the shared terms, at most 8 each."""
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, w: s + F.least(F.char_length(w), F.lit(most)))


def content_fingerprint(*parts: Column) -> Column:
    """SHA-256 of length-delimited parts."""
    return F.sha2(F.concat_ws("|", *(F.concat(F.char_length(F.coalesce(p, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p, F.lit(""))) for p in parts)), 256)
