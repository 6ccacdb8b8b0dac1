"""The thirty lexical and structural url features, and the metadata struct."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsieve.constants import (
    BRANDS, DEFAULT_TLD_RISK, FEATURE_NAMES, KEYWORDS, SPECIAL_CHARS, TLD_RISK,
)
from urlsieve.functions.basic import CHAR_START, count_any, count_text, round4, safe_ratio
from urlsieve.functions.brands import (
    NO_CANDIDATE, best_brand_code, code_brand, code_distance, host_tokens,
)
from urlsieve.functions.urls import is_ipv4, url_parts

# Characters that count as digits without being decimal digits (super- and
# subscripts, circled digits and the like), as code point ranges.
_OTHER_DIGITS = (
    r"\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}"
    r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}"
    r"\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}"
    r"\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_VOWELS = "aeiou"
_CONSONANTS = "bcdfghjklmnpqrstvwxyz"


def _count_class(c: Column, ascii_chars: str, pattern: str) -> Column:
    """Count a character class; the regex only runs on text beyond ASCII."""
    wide = F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    return F.when(F.octet_length(c) == F.length(c), count_any(c, ascii_chars)).otherwise(wide)


def digit_count(c: Column) -> Column:
    return _count_class(c, "0123456789", rf"[\p{{Nd}}{_OTHER_DIGITS}]")


def uppercase_count(c: Column) -> Column:
    return _count_class(c, _UPPER, r"\p{IsUppercase}")


def shannon_entropy(c: Column) -> Column:
    """Bits per character, 4 decimals; empty text gives 0.

    log2(n) - sum(k * log2(k)) / n over the character counts k. Only repeated
    characters add to the sum: they are the runs of two or more in the sorted text,
    so the cost is that of a sort and not characters times alphabet. Rounding to 12
    decimals first keeps exact ties exact.
    """
    n = F.length(c).cast("double")
    ordered = F.array_join(F.sort_array(F.split(c, "")), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1+"), F.lit(0))
    repeated = F.aggregate(
        F.transform(runs, F.length),
        F.lit(0.0),
        lambda acc, k: acc + k * F.log2(k.cast("double")),
    )
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(
        round4(F.bround(F.log2(n) - repeated / n, 12))
    )


def longest_run(c: Column) -> Column:
    """Length of the longest run of one character, at least 1."""
    runs = F.regexp_extract_all(c, F.lit(r"(?s)(.)\1+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(1))


def trigram_diversity(c: Column) -> Column:
    """Distinct over all character trigrams; a look-ahead finds the overlapping ones.

    It must not start in the middle of a surrogate pair.
    """
    grams = F.regexp_extract_all(c, F.lit(rf"(?s)(?=({CHAR_START}..))"), F.lit(1))
    return F.when(F.length(c) < 3, F.lit(1.0)).otherwise(
        round4(F.size(F.array_distinct(grams)) / (F.length(c) - 2))
    )


def letter_words(c: Column) -> Column:
    """The runs of ASCII letters, one blank apart."""
    return F.btrim(F.regexp_replace(c, "[^a-zA-Z]+", " "), F.lit(" "))


def avg_word_length(words: Column) -> Column:
    """Mean length of the words in the text :func:`letter_words` gives."""
    blanks = count_text(words, " ")
    letters = F.length(words) - blanks
    return F.when(letters > 0, round4(letters / (blanks + 1))).otherwise(F.lit(0.0))


def keyword_count(lowered: Column) -> Column:
    hits = [F.contains(lowered, F.lit(k)).cast("int") for k in KEYWORDS]
    return reduce(lambda a, b: a + b, hits)


def tld_risk(host: Column) -> Column:
    weights = F.create_map(*[F.lit(v) for kv in TLD_RISK.items() for v in kv])
    weight = F.try_element_at(weights, F.substring_index(host, ".", -1))
    return F.when(F.contains(host, F.lit(".")), F.coalesce(weight, F.lit(DEFAULT_TLD_RISK))).otherwise(
        F.lit(DEFAULT_TLD_RISK)
    )


def root_domain(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def brand_elsewhere(lowered: Column, root: Column) -> Column:
    """Some brand occurs in the url while the root domain does not start with it."""
    hits = [F.contains(lowered, F.lit(b)) & ~F.startswith(root, F.lit(b)) for b in BRANDS]
    return reduce(lambda a, b: a | b, hits)


def extract_features(df: DataFrame, url: str = "url", meta: str | None = "meta") -> DataFrame:
    """Add the 30 features as DOUBLE columns and, unless ``meta`` is None, the
    struct (target_brand, is_homoglyph, is_authentic_brand, root_domain).

    Narrow from end to end: nothing is shuffled, joined or sent to Python. Array
    expressions sit in one projection of their own and leave the others in generated
    code.
    """
    c = F.col
    own = [n for n in df.columns if n not in FEATURE_NAMES and n != meta]
    df = url_parts(df.select(*[c(f"`{n}`") for n in own]), url)
    df = df.withColumns(
        {"_lower": F.lower("_u"), "_root": root_domain(c("_host")), "_words": letter_words(c("_u"))}
    )

    def flag(cond: Column) -> Column:
        return cond.cast("double")

    u, host, path = c("_u"), c("_host"), c("_path")
    native = {
        "url_length": F.length(u),
        "hostname_length": F.length(host),
        "path_length": F.length(path),
        "query_length": F.length("_query"),
        "subdomain_count": F.greatest(count_text(host, ".") - 1, F.lit(0)),
        "path_depth": count_text(path, "/"),
        "digit_count": digit_count(u),
        "uppercase_count": uppercase_count(u),
        "special_char_count": count_any(u, SPECIAL_CHARS),
        "dot_count": count_text(u, "."),
        "hyphen_count": count_text(u, "-"),
        "slash_count": count_text(u, "/"),
        "at_count": count_text(u, "@"),
        "question_count": count_text(u, "?"),
        "equal_count": count_text(u, "="),
        "vowel_consonant_ratio": round4(
            count_any(host, _VOWELS) / (count_any(host, _CONSONANTS) + 1)
        ),
        "is_ip_address": flag(is_ipv4(host)),
        "is_punycode": flag(F.contains(host, F.lit("xn--"))),
        "suspicious_keyword_count": keyword_count(c("_lower")),
        "tld_risk_score": tld_risk(host),
        "has_brand_in_subdomain_or_path": flag(brand_elsewhere(c("_lower"), c("_root"))),
        "avg_word_length": avg_word_length(c("_words")),
        "char_trigram_diversity": trigram_diversity(u),
    }
    df = df.withColumns({k: v.cast("double") for k, v in native.items()})
    df = df.withColumns(
        {
            "shannon_entropy": shannon_entropy(u),
            "consecutive_char_repeat_count": longest_run(u).cast("double"),
            "_code": best_brand_code(host_tokens(host)),
        }
    )
    dist, brand = code_distance(c("_code")), code_brand(c("_code"))
    authentic = (
        F.coalesce(dist == 0, F.lit(False))
        & F.startswith(c("_root"), F.coalesce(brand, F.lit("")))
        & (c("tld_risk_score") <= 0.2)
        & (c("is_ip_address") == 0)
        & (c("is_punycode") == 0)
        & (c("has_brand_in_subdomain_or_path") == 0)
    )
    df = df.withColumns(
        {
            "digit_ratio": round4(safe_ratio(c("digit_count"), c("url_length"))),
            "uppercase_ratio": round4(safe_ratio(c("uppercase_count"), c("url_length"))),
            "min_brand_levenshtein_distance": F.coalesce(dist, F.lit(NO_CANDIDATE)).cast("double"),
            "is_homoglyph_brand": flag(F.coalesce(dist.isin(1, 2), F.lit(False))),
            "is_authentic_brand_domain": flag(authentic),
        }
    )
    out = [c(f"`{n}`") for n in own] + [c(n) for n in FEATURE_NAMES]
    if meta is not None:
        out.append(
            F.struct(
                F.when(dist <= 2, brand).otherwise("None").alias("target_brand"),
                (c("is_homoglyph_brand") == 1).alias("is_homoglyph"),
                (c("is_authentic_brand_domain") == 1).alias("is_authentic_brand"),
                c("_root").alias("root_domain"),
            ).alias(meta)
        )
    return df.select(*out)


