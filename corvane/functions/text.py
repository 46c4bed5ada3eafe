"""Text primitives as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def ngrams(items: Column, n: int) -> Column:
    """All runs of n items, as arrays."""
    count = F.size(items) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.slice(items, i, n))).otherwise(F.array().cast("array<array<string>>"))


def shingle_hashes(w: Column, n: int = 5) -> Column:
    """Sorted distinct hashes of runs of n words; fewer words are one shingle, none give none.

    w is a column of word arrays, materialised before: an expression here would be evaluated once a shingle.
    """
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(*(F.element_at(w, (i + k).cast("int")) for k in range(n))))
    none = F.array().cast("array<bigint>")
    return F.array_sort(F.array_distinct(F.when(F.size(w) >= n, runs).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(none)))


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x0B\x{85}\p{Z}]+", " "))


def word_list(text: Column) -> Column:
    """Words between white space; none for a blank text."""
    s = squeezed(text)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " "))


def estimated_tokens(text: Column, per_word: float = 2.28) -> Column:
    """Tokens by the pooled ratio of tokens to words, rounded up."""
    return F.ceil(F.lit(per_word) * F.size(word_list(text))).cast("int")


def char_grams(s: Column, n: int = 3) -> Column:
    """All n-character substrings of an already squeezed text column; a shorter text is one gram, an empty one none."""
    chars = F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))
    k = F.length(s)
    # characters beside those that follow them, joined; the last n - 1 have none beside them
    ahead = F.zip_with(chars, F.slice(chars, 2, F.greatest(k, F.lit(1))), lambda a, b: F.concat(a, b))
    for j in range(3, n + 1):
        ahead = F.zip_with(ahead, F.slice(chars, j, F.greatest(k, F.lit(1))), lambda a, b: F.concat(a, b))
    return F.when(k >= n, F.slice(ahead if n > 1 else chars, F.lit(1), k - n + 1)).when(k > 0, F.array(s)).otherwise(F.array().cast("array<string>"))


def exact_match(a: Column, b: Column) -> Column:
    return squeezed(a) == squeezed(b)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def unit(seed: Column | int, key: Column) -> Column:
    """The first eight bytes of SHA-256 of 'seed:key' as a number in [0, 1)."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    digest = sha256(F.concat(seed, F.lit(":"), key))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def hex_unit(key: Column, digits: int = 12) -> Column:
    """The first hex digits of SHA-256 of the key over their range."""
    return F.conv(F.substring(sha256(key), 1, digits), 16, 10).cast("long").cast("double") / F.lit(float(16**digits))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Keyed hash, built from two SHA-256 over binary; hex."""
    key = (key if len(key) <= 64 else __import__("hashlib").sha256(key).digest()).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))), 256)


def source_of(doc_id: Column) -> Column:
    """What stands before the first colon."""
    return F.substring_index(doc_id, ":", 1)


def doc_of(chunk_id: Column) -> Column:
    """A chunk id without its last #n."""
    return F.regexp_replace(chunk_id, "#[^#]*$", "")
