"""Names, paths, times, transcripts' words."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The alphabet of source fingerprints; languages that mean "find out"; language codes.
HASH_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ012345"
AUTO_LANGUAGES = ("", "auto", "none", "null")
LANGUAGES = {"english": "en", "german": "de", "french": "fr", "spanish": "es", "italian": "it", "portuguese": "pt", "dutch": "nl", "polish": "pl"}


@F.pandas_udf(StringType())
def _fold_name(names: pd.Series) -> pd.Series:
    return names.map(lambda n: None if n is None else " ".join(unicodedata.normalize("NFKC", n).casefold().split()))


def normalise_name(name: Column) -> Column:
    """NFKC, case folded, white space collapsed; ASCII names never leave the JVM."""
    plain = F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))
    return F.when(name.rlike(r"^[\x00-\x7F]*$"), plain).otherwise(_fold_name(name))


def source_hash(path: Column) -> Column:
    """Six symbols from the low 30 bits of the md5 of a path's stem, low bits first."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(.)\.[^.]*$", "$1")
    low = F.conv(F.right(F.md5(stem.cast("binary")), F.lit(8)), 16, 10).cast("long")
    digit = lambda i: F.substring(F.lit(HASH_ALPHABET), (F.shiftright(low, 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    return F.when(path.isNotNull() & (path != ""), F.concat(*[digit(i) for i in range(6)]))


def filename_hash(path: Column) -> Column:
    """The fingerprint that a snippet's file name begins with; '' for a manual or malformed one."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.when(name.contains("_manual"), "").otherwise(F.coalesce(F.regexp_extract(name, r"^([A-Z0-5]{6})_", 1), F.lit("")))


def source_identity(source_audio: Column, path: Column) -> Column:
    """(identity, derived): the hash of the source if it is known, else the file name's."""
    known = source_hash(source_audio)
    return F.struct(F.coalesce(known, F.nullif(filename_hash(path), F.lit(""))).alias("identity"), known.isNull().alias("derived"))


def parse_time(text: Column) -> Column:
    """Seconds of H:MM:SS.mmm, MM:SS or MM-SS; null for anything else."""
    parts = F.split(F.regexp_replace(F.trim(text), "-", ":"), ":")
    at = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    return F.when(F.size(parts) == 3, at(1) * 3600 + at(2) * 60 + at(3)).when(F.size(parts) == 2, at(1) * 60 + at(2)).when(F.size(parts) == 1, at(1))


def format_time(sec: Column) -> Column:
    """HH:MM:SS.mmm"""
    ms = F.round(F.greatest(sec, F.lit(0.0)) * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def format_hms(sec: Column) -> Column:
    """H:MM:SS, or MM:SS within the first hour"""
    s = F.floor(F.greatest(sec, F.lit(0.0))).cast("long")
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(F.format_string("%02d:%02d", F.floor(s / 60), s % 60))


def tokens(name: Column) -> Column:
    return F.regexp_extract_all(F.lower(name), F.lit(r"([a-z0-9]+)"), F.lit(1))


def tokens_contain(outer: Column, inner: Column) -> Column:
    """Whether one name's tokens are a contiguous part of the other's: 'speaker 1' isn't of 'speaker 10'."""
    pad = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    return (F.size(tokens(inner)) > 0) & pad(tokens(outer)).contains(pad(tokens(inner)))


def is_pending(name: Column, flag: Column) -> Column:
    return F.coalesce(name.startswith("pending_"), F.lit(False)) | F.coalesce(flag, F.lit(False))


def pending_name(origin: Column, label: Column) -> Column:
    """A placeholder for a voice without a name, safe for file systems."""
    safe = F.substring(F.regexp_replace(origin, r"[^A-Za-z0-9]+", "_"), 1, 40)
    return F.concat(F.lit("pending_"), safe, F.lit("_"), F.regexp_replace(label, r"[^A-Za-z0-9]+", ""))


def collapse_doubled(text: Column) -> Column:
    """'the the' -> 'the'"""
    return F.regexp_replace(text, r"(?i)\b(\p{L}+)(?:\s+\1\b)+", "$1")


MARK = "[inaudible]"
_MARKS = re.compile(r"\[inaudible\](?:\s*\[inaudible\])+")
#: The lengths of a unit whose repetition is cut out.
UNIT_LEAST, UNIT_MOST = 4, 120
#: Characters in which a repeat is searched for at a time.
_WINDOW = 8192


def _first_in(c: np.ndarray, most: int) -> tuple[int, int] | None:
    """(start, unit length) of the first stretch of three equal units that begins before `most`; of
    several that begin there the shortest unit.

    Three units from i on are 2u characters that equal those u further on, so that at the first multiple p
    of u from i on all of p .. p + u do: of the multiples few pass the first comparisons.
    """
    best = None
    for u in range(UNIT_LEAST, UNIT_MOST + 1):
        if len(c) < 3 * u:
            break
        p = np.arange(0, min(most + u, len(c) - 2 * u + 1), u)
        for k in (0, u, 1, 2, 3):
            p = p[p + k + u < len(c)] if k else p
            p = p[c[p + k] == c[p + k + u]]
            if not len(p):
                break
        for at in p.tolist():
            if best is not None and at - u >= best[0]:
                break
            if np.array_equal(c[at : at + u], c[at + u : at + 2 * u]):
                same = c[max(0, at - u) : at] == c[max(0, at - u) + u : at + u]
                start = at - (len(same) if same.all() else int(same[::-1].argmin()))
                if len(c) - start >= 3 * u and np.array_equal(c[start : start + 2 * u], c[start + u : start + 3 * u]) and start < most:
                    if best is None or start < best[0]:
                        best = (start, u)
                    break
    return best


def _first_repeat(t: str, since: int) -> tuple[int, int, int] | None:
    """(start, unit length, end) of the first unit that stands three times or more, from `since` on."""
    reach = 3 * UNIT_MOST
    while since < len(t):
        c = np.frombuffer(t[since : since + _WINDOW + reach].encode("utf-32-le", "surrogatepass"), np.uint32)
        found = _first_in(c, _WINDOW)
        if found:
            i, u = since + found[0], found[1]
            unit, end = t[i : i + u], i + 3 * u
            step = unit * max(1, 1024 // u)
            while t.startswith(step, end):
                end += len(step)
            while t.startswith(unit, end):
                end += u
            return i, u, end
        since += _WINDOW
    return None


def cut_repeats(t: str | None) -> str | None:
    """A text with one mark for each unit that is repeated three times or more, copies of it that are cut off
    at either side, and the white space about; marks side by side are one."""
    if t is None or len(t) < 3 * UNIT_LEAST:
        return t
    since, first = 0, True
    while True:
        found = _first_repeat(t, since)
        if found is None:
            return t
        a, u, b = found
        unit = t[a : a + u]
        for k in range(u - 1, UNIT_LEAST - 1, -1):
            if t.endswith(unit[-k:], 0, a):
                a -= k
                break
        for k in range(u - 1, UNIT_LEAST - 1, -1):
            if t.startswith(unit[:k], b):
                b += k
                break
        head = t[:a].rstrip()
        t = f"{head} {MARK} {t[b:].lstrip()}".strip()
        if first:  # marks of the text's own
            t, first = _MARKS.sub(MARK, t), False
        else:
            at = len(head) - len(MARK) if head.endswith(MARK) else t.find(MARK, max(0, len(head) - 1))
            m = _MARKS.match(t, at)
            t = t if m is None else t[:at] + MARK + t[m.end() :]
        # nothing that begins earlier has changed within three units
        since = max(0, min(a, len(head)) - 3 * UNIT_MOST - 2 * len(MARK))


def _may_repeat(texts: list[str]) -> np.ndarray:
    """Which texts hold three equal units side by side: all of them at once, as _first_in looks at one.  A
    unit that would reach over a text's end finds the mark between texts there, or costs a second look."""
    c = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends, hit = np.cumsum([len(t) + 1 for t in texts]), np.zeros(len(texts), bool)
    for u in range(UNIT_LEAST, UNIT_MOST + 1):
        if len(c) < 3 * u:
            break
        p = np.arange(0, len(c) - 2 * u + 1, u)
        for k in (0, u, *range(1, UNIT_LEAST)):
            p = p[p + k + u < len(c)] if k else p
            p = p[c[p + k] == c[p + k + u]]
        found = [at for at in p.tolist() if np.array_equal(c[at : at + u], c[at + u : at + 2 * u])]
        hit[np.searchsorted(ends, found, "right")] = True
    return hit


@F.pandas_udf(StringType())
def _cut_repeats(texts: pd.Series) -> pd.Series:
    known = texts[texts.notna()]
    out, begin = texts.copy(), 0
    size = known.str.len().cumsum().to_numpy()
    while begin < len(known):  # about a megabyte at a time
        end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + (1 << 20), "right")))
        part = known.iloc[begin:end]
        again = part[_may_repeat(part.tolist())]
        out[again.index] = again.map(cut_repeats)
        begin = end
    return out


#: Rows of an Arrow batch of whole texts, which is in memory several times over.
TEXT_ROWS = 500
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def of_whole_texts(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches cut down to TEXT_ROWS rows where they are longer or without limit."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_ROWS)) <= TEXT_ROWS:
        conf.set(_ROWS, str(TEXT_ROWS))
    return df


def clean_text(text: Column) -> Column:
    """Doubled words once; a unit of 4 to 120 characters that repeats three times or more, and cut
    copies about it, as one mark, in Arrow batches (of_whole_texts keeps them small).  Linear in the text, and a search of 8,192 characters
    for each mark."""
    return _cut_repeats(collapse_doubled(text))


def canonical_language(lang: Column) -> Column:
    low = F.lower(F.trim(lang))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(low.isNull() | low.isin(*AUTO_LANGUAGES), None).otherwise(F.coalesce(F.try_element_at(table, low), low))


def logprob_confidence(x: Column) -> Column:
    return F.bround(F.least(F.greatest(F.exp(x), F.lit(0.0)), F.lit(1.0)), 3)


def context_tail(text: Column, n: int = 200) -> Column:
    return F.right(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(n))
