"""Hashes, times, titles and small text helpers; built-in functions but for the few that Spark lacks (Arrow-batched)."""

from __future__ import annotations

import hashlib
import hmac

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StringType


def content_hash(title: Column, body: Column) -> Column:
    """The first 16 bytes, in hex, of the SHA-256 of title, a zero byte and body. Nulls are empty."""
    parts = F.concat(F.coalesce(title, F.lit("")).cast("binary"), F.unhex(F.lit("00")), F.coalesce(body, F.lit("")).cast("binary"))
    return F.substring(F.sha2(parts, 256), 1, 32)


def embed_text(title: Column, body: Column, most: int = 400) -> Column:
    """What is embedded: title, a blank line and body, the first `most` code points; a space if there is nothing."""
    title, body = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    text = F.substring(F.when(body == "", title).otherwise(F.concat(title, F.lit("\n\n"), body)), 1, most)
    return F.when(text == "", F.lit(" ")).otherwise(text)


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970, rounded down. Times without zone are taken as the session's (UTC)."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1000).cast("long")


def slack_micros(ts: Column) -> Column:
    """'seconds.fraction' in microseconds: the fraction is filled or cut to six digits; bad or missing times are 0."""
    seconds = F.substring_index(ts, ".", 1).try_cast("long")
    fraction = F.when(ts.contains("."), F.rpad(F.split_part(ts, F.lit("."), F.lit(2)), 6, "0")).otherwise("000000")
    return F.coalesce(seconds * 1_000_000 + F.coalesce(fraction.try_cast("long"), F.lit(0)), F.lit(0))


def jira_time(text: Column) -> Column:
    """'2011-07-19T21:32:10.000+0000' as a timestamp; null if it isn't one."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSZ"))


def iso_time(text: Column) -> Column:
    """An ISO 8601 time as a timestamp; null if it isn't one."""
    return text.try_cast("timestamp")


def query_minute(ts: Column, zone: str = "UTC") -> Column:
    """A time as trackers' query languages write it, to the minute, in their zone."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd HH:mm")


def message_title(text: Column) -> Column:
    """The first line; beyond 90 code points its first 87 and three dots."""
    line = F.substring_index(F.coalesce(text, F.lit("")), "\n", 1)
    return F.when(F.char_length(line) > 90, F.concat(F.substring(line, 1, 87), F.lit("..."))).otherwise(line)


def title_case(s: Column) -> Column:
    """The first letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(s, 1, 1)), s.substr(F.lit(2), F.char_length(s)))


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def duplicates_named(body: Column) -> Column:
    """Numbers that lines 'duplicate of #n' name, in order, as text."""
    return F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?im)^\s*duplicate of\s+#(\d+)\b"), 1)


def number_after_slash(url: Column) -> Column:
    return F.coalesce(F.substring_index(url, "/", -1).try_cast("long"), F.lit(0))


def split_list(text: Column) -> Column:
    """The trimmed, non-empty parts of a comma-separated list."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def is_project_key(key: Column) -> Column:
    return F.coalesce(key.rlike("^[A-Z][A-Z0-9_]+$"), F.lit(False))


def next_link(header: Column) -> Column:
    """The address of rel="next" in a Link header; null if there is none."""
    found = F.regexp_extract(F.coalesce(header, F.lit("")), '<([^>]+)>;[^,]*rel="next"', 1)
    return F.when(found != "", found)


def seeded(*parts: Column | str | int) -> Column:
    """A text to order by that looks random: the MD5 of parts (columns, names of columns, numbers) joined by |."""
    return F.md5(F.concat_ws("|", *[F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


@F.pandas_udf(DecimalType(20, 0))
def fnv1a64(s: pd.Series) -> pd.Series:
    """FNV-1a of the UTF-8 bytes, 64 bits, unsigned. Null: null."""
    import decimal

    # Offset basis and prime of the 64-bit hash.
    basis, prime = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
    raw = [b"" if x is None else x.encode() for x in s]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    data, start = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size
    h = np.full(len(raw), basis)
    # One byte of every text at a time.
    left, step = np.flatnonzero(size > 0), 0
    while len(left):
        h[left] = (h[left] ^ data[start[left] + step].astype(np.uint64)) * prime
        step += 1
        left = left[size[left] > step]
    return pd.Series([None if x is None else decimal.Decimal(v) for x, v in zip(s, h.tolist(), strict=True)], index=s.index, dtype=object)


def signer(secret: str, prefix: str = "sha256="):
    """A function of a binary or text column: prefix and the HMAC-SHA256 in hex, by secret."""

    @F.pandas_udf(StringType())
    def sign(body: pd.Series) -> pd.Series:
        return body.map(lambda b: None if b is None else prefix + hmac.new(secret.encode(), b.encode() if isinstance(b, str) else bytes(b), hashlib.sha256).hexdigest())

    return sign


def github_verified(secret: str, signature: Column, body: Column) -> Column:
    """Whether a delivery's signature is the body's; false without a secret."""
    return F.coalesce(signer(secret)(body) == signature, F.lit(False)) if secret else F.lit(False)


def slack_verified(secret: str, ts: Column, signature: Column, body: Column, now_s: Column, skew_s: int = 300) -> Column:
    """Whether a request's v0 signature is that of its time and body, and the time is within skew_s of now."""
    seconds = ts.try_cast("long")
    fresh = F.coalesce(F.abs(now_s - seconds) <= skew_s, F.lit(False))
    return fresh & F.coalesce(signer(secret, "v0=")(F.concat(F.lit("v0:"), ts, F.lit(":"), body)) == signature, F.lit(False))
