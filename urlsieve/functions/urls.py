"""URL normalisation, the split key and the parts the features are read from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsieve.constants import SECOND_LEVEL_SUFFIXES
from urlsieve.functions.basic import as_col, count_text, strip_ws


# One scheme, then one "www." label. Possessive, so a failed match never backtracks.
_PREFIX = r"^(?:[a-z][a-z0-9+.\-]*+://)?(?:www\p{Nd}*+\.)?"


def _bare(base: Column) -> Column:
    return F.rtrim(F.regexp_replace(base, _PREFIX, ""), F.lit("/"))


def normalize_url(url: Column | str) -> Column:
    """Lower case, without one scheme, one leading ``www.`` and trailing slashes.

    A url that would become empty keeps its stripped lower-case form. Not
    idempotent: ``http://http://x`` loses one scheme per call. Over whole tables
    prefer :func:`with_normalized`, which computes each step once.
    """
    base = F.lower(strip_ws(as_col(url)))
    bare = _bare(base)
    return F.when(F.length(bare) > 0, bare).otherwise(base)


def with_normalized(df: DataFrame, url: str = "url", out: str = "url") -> DataFrame:
    """:func:`normalize_url` as staged projections."""
    df = df.withColumn("_base", F.lower(strip_ws(F.col(url))))
    df = df.withColumn("_bare", _bare(F.col("_base")))
    kept = F.when(F.length("_bare") > 0, F.col("_bare")).otherwise(F.col("_base"))
    return df.withColumn(out, kept).drop("_base", "_bare")


def has_path(url: Column | str) -> Column:
    """True when a *normalised* url holds anything after its host."""
    return F.contains(as_col(url), F.lit("/"))


def has_scheme(url: Column | str) -> Column:
    return F.lower(strip_ws(as_col(url))).rlike(r"^https?://")


# The same prefix, left alone where nothing but slashes would remain.
_HOST_PREFIX = r"^(?>(?:[a-z][a-z0-9+.\-]*+://)?)(?>(?:www\p{Nd}*+\.)?)(?=/*+[^/])"


def site_host(url: Column | str) -> Column:
    """The host the split key is read from; empty when the url has none.

    Refers to its input once, so the optimiser may copy it into a filter cheaply.
    """
    host = F.regexp_replace(F.lower(strip_ws(as_col(url))), _HOST_PREFIX, "")
    for cut in "/?#":
        host = F.substring_index(host, cut, 1)
    return F.substring_index(F.substring_index(host, "@", -1), ":", 1)


def _dotted(host: Column) -> Column:
    """The host without empty labels."""
    return F.btrim(F.regexp_replace(host, r"\.{2,}", "."), F.lit("."))


def is_ipv4(host: Column) -> Column:
    """Four labels of one to three digits, none above 255; only hosts that end in a digit are split."""
    last = F.right(host, F.lit(1))
    labels = F.split(host, r"\.")
    small = F.forall(labels, lambda x: x.rlike("^[0-9]{1,3}$") & (F.coalesce(x.try_cast("int"), F.lit(256)) <= 255))
    return F.when((last >= "0") & (last <= "9"), (F.size(labels) == 4) & small).otherwise(False)


def _domain_of(host: Column, dotted: Column) -> Column:
    second = F.substring_index(F.substring_index(dotted, ".", -2), ".", 1)
    return (
        F.when((count_text(dotted, ".") < 2) | is_ipv4(host), host)
        .when(second.isin(SECOND_LEVEL_SUFFIXES), F.substring_index(dotted, ".", -3))
        .otherwise(F.substring_index(dotted, ".", -2))
    )


def registered_domain(url: Column | str) -> Column:
    """Approximate eTLD+1, the key that keeps a site inside one split.

    Normalises once more by definition. Over whole tables prefer :func:`with_group`.
    """
    host = site_host(url)
    return _domain_of(host, _dotted(host))


def with_group(df: DataFrame, url: str = "url", out: str = "group") -> DataFrame:
    """:func:`registered_domain` as staged projections."""
    df = df.withColumn("_site", site_host(url))
    df = df.withColumn("_dotted", _dotted(F.col("_site")))
    domain = _domain_of(F.col("_site"), F.col("_dotted"))
    return df.withColumn(out, domain).drop("_site", "_dotted")


# --- url parts -------------------------------------------------------------

_H16 = "[0-9a-fA-F]{1,4}"
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_TAIL = rf"({_H16}:{_H16}|({_OCTET}\.){{3}}{_OCTET})"
# RFC 3986 grammar of an IPv6 address, by the number of groups left of "::".
_IPV6 = "|".join(
    [rf"({_H16}:){{6}}{_TAIL}", rf"::({_H16}:){{5}}{_TAIL}"]
    + [
        rf"(({_H16}:){{0,{left}}}{_H16})?::({_H16}:){{{right}}}{_TAIL}"
        for left, right in ((0, 4), (1, 3), (2, 2), (3, 1), (4, 0))
    ]
    + [rf"(({_H16}:){{0,5}}{_H16})?::{_H16}", rf"(({_H16}:){{0,6}}{_H16})?::"]
)
_BRACKETED_HOST = rf"^(({_IPV6})(%[^%]+)?|v[0-9a-fA-F]+\..+)$"

# Characters that a compatibility normalisation turns into a url
# delimiter; an authority holding one is rejected by the usual parser.
_DISGUISED_DELIMITERS = (
    "\u2047\u2048\u2049\u2100\u2101\u2105\u2106\u2a74\ufe13\ufe16\ufe55\ufe56\ufe5f\ufe6b"
    "\uff03\uff0f\uff1a\uff1f\uff20"
)


def _inside_brackets(text: Column) -> Column:
    """What stands between the first "[" and the next "]"."""
    after = F.substr(text, F.instr(text, "[") + 1)
    return F.substring_index(after, "]", 1)


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``_u`` (stripped url), ``_host`` (lower case), ``_path`` and ``_query``.

    ``parse_url`` is no use here: it raises on hosts with ``_`` and on blanks. The
    steps are separate projections so that no later one repeats an earlier one.
    """
    c = F.col
    df = df.withColumn("_u", strip_ws(c(url)))
    df = df.withColumn(
        "_rest", F.translate(F.regexp_replace("_u", "^https?://", ""), "\t\r\n", "")
    )
    df = df.withColumn("_nofrag", F.substring_index("_rest", "#", 1))
    df = df.withColumn("_noquery", F.substring_index("_nofrag", "?", 1))
    df = df.withColumn("_auth", F.substring_index("_noquery", "/", 1))
    df = df.withColumns(
        {
            "_hostport": F.substring_index("_auth", "@", -1),
            "_fullpath": F.substr(c("_noquery"), F.length("_auth") + 1),
        }
    )
    opened, closed = (F.contains(c("_auth"), F.lit(b)) for b in "[]")
    # Brackets have to come in pairs and to hold an IPv6 (or IPvFuture) address.
    addressed = opened & closed & _inside_brackets(c("_auth")).rlike(_BRACKETED_HOST)
    unsafe = (F.octet_length("_auth") > F.length("_auth")) & c("_auth").rlike(
        f"[{_DISGUISED_DELIMITERS}]"
    )
    df = df.withColumns(
        {
            "_bad": unsafe | ((opened | closed) & ~addressed),
            "_leaf": F.substring_index("_fullpath", "/", -1),
        }
    )
    host = (
        F.when(c("_bad"), F.substring_index("_u", "/", 1))
        .when(F.contains(c("_hostport"), F.lit("[")), _inside_brackets(c("_hostport")))
        .otherwise(F.substring_index("_hostport", ":", 1))
    )
    # ";params" of the last segment do not belong to the path.
    folder = F.left(c("_fullpath"), F.length("_fullpath") - F.length("_leaf"))
    path = F.concat(folder, F.substring_index("_leaf", ";", 1))
    query = F.substr(c("_nofrag"), F.length("_noquery") + 2)
    df = df.withColumns(
        {
            "_host": F.lower(host),
            "_path": F.when(c("_bad"), F.lit("")).otherwise(path),
            "_query": F.when(c("_bad"), F.lit("")).otherwise(query),
        }
    )
    return df.drop(
        "_rest", "_nofrag", "_noquery", "_auth", "_hostport", "_fullpath",
        "_bad", "_leaf",
    )
