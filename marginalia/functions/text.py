"""Column expressions that several jobs share."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: a token is two or more letters, digits or underscores, of lower-cased text.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


#: Texts that are Python strings at once; the others of a batch stay in Arrow.
SLICE = 64


def _normal(form: str):
    @F.arrow_udf(StringType())
    def composed(text: pa.Array) -> pa.Array:
        part = lambda at: pa.array([None if x is None else unicodedata.normalize(form, x) for x in text.slice(at, SLICE).to_pylist()], pa.string())
        return pa.concat_arrays([part(at) for at in range(0, len(text), SLICE)]) if len(text) else pa.array([], pa.string())

    return composed


nfkc, nfc = _normal("NFKC"), _normal("NFC")


#: Titles that may precede a name.
HONORIFICS = ("dr", "prof", "av", "mr", "mrs", "ms")


def comparable_name(text: Column) -> Column:
    """Composed, in lower case, trimmed, without one title at the front."""
    title = rf"(?i)^(?:{'|'.join(HONORIFICS)})\.?\s+"
    return F.lower(nfc(F.trim(F.regexp_replace(F.trim(text), title, ""))))


def json_field(payload: Column, name: str) -> Column:
    """A field of a JSON object as text; null where the payload doesn't parse or lacks it."""
    return F.when(F.try_parse_json(payload).isNotNull(), F.get_json_object(payload, f"$.{name}"))


def normalized_mention(text: Column, ascii_only: bool = False) -> Column:
    """Trimmed, lower case, single blanks, compatibility-composed; ascii_only skips the composition, which no built-in does."""
    low = F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))
    return low if ascii_only else nfkc(low)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def stable_id(*parts: Column) -> Column:
    """32 hexadecimal digits that depend on the parts alone; null parts count as empty."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def reduced_share(numerator: Column, denominator: Column) -> Column:
    """numerator/denominator in lowest terms as text; null for a zero denominator."""
    start = F.struct(numerator.cast("long").alias("a"), denominator.cast("long").alias("b"))

    def step(state: Column, _: Column) -> Column:
        a, b = state.getField("a"), state.getField("b")
        return F.when(b == 0, state).otherwise(F.struct(b.alias("a"), F.try_mod(a, b).alias("b")))

    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s.getField("a"))
    text = F.concat(F.try_divide(numerator, gcd).cast("long").cast("string"), F.lit("/"), F.try_divide(denominator, gcd).cast("long").cast("string"))
    return F.when(denominator != 0, text)


def embedding_text(title: Column, heading: Column, content: Column) -> Column:
    """Title, heading and passage on lines of their own; absent parts leave no line."""
    blank = lambda c: F.when(F.trim(c) != "", c)
    return F.concat_ws("\n", blank(title), blank(heading), content)


def match_reason(heading: Column, content: Column, text: Column) -> Column:
    """The heading if there is one, else the first sentence that holds the text, else the first; over 160 characters cut with an ellipsis."""
    sentences = F.split(F.trim(content), r"(?<=[.!?])\s+|\n+")
    wanted = F.lower(F.trim(text))
    holds = F.filter(sentences, lambda x: (wanted != "") & F.contains(F.lower(x), wanted))
    said = F.coalesce(F.get(holds, F.lit(0)), F.get(sentences, F.lit(0)))
    short = F.when(F.length(said) <= 160, said).otherwise(F.concat(F.rtrim(F.substring(said, 1, 157)), F.lit("…")))
    return F.coalesce(F.nullif(heading, F.lit("")), short)


def redact_secrets(text: Column) -> Column:
    """key=value and key: value texts of secrets, without their values."""
    return F.regexp_replace(text, r"(?i)\b((?:api[_-]?key|token|secret|password|authorization)\s*[=:]\s*)\S+", "$1[redacted]")


def year_range(text: Column) -> Column:
    """(start, end) years of a text: a range, else one year twice, else nulls."""
    year = r"(1[0-9]{3}|20[0-9]{2})"
    both = rf"\b{year}\s*[-–]\s*{year}\b"
    low, high, one = F.regexp_extract(text, both, 1), F.regexp_extract(text, both, 2), F.regexp_extract(text, rf"\b{year}\b", 1)
    full = lambda c: F.when(c != "", c)
    return F.struct(F.coalesce(full(low), full(one)).alias("start"), F.coalesce(full(high), full(one)).alias("end"))


def id_list(text: Column) -> Column:
    """Ids of a JSON array, else the words of a loose text between brackets, quotes, commas or blanks."""
    return F.coalesce(F.from_json(text, "array<string>"), F.regexp_extract_all(text, F.lit(r"([^\s\[\]'\",]+)"), F.lit(1)))


def folder_parts(path: Column) -> Column:
    """Parts of a relative folder path; null if it has an empty, . or .. part."""
    parts = F.split(F.trim(path), "/")
    return F.when(~F.exists(parts, lambda p: p.isin("", ".", "..")), parts)


def token_counts(text: Column) -> Column:
    """Struct of words, alphabetic tokens and digits."""
    words = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.struct(F.size(words).alias("words"), F.size(F.filter(words, lambda w: w.rlike(r"^\p{L}+$"))).alias("alphabetic"), F.regexp_count(text, F.lit("[0-9]")).alias("digits"))
