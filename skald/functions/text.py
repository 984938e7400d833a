"""Text functions as Column expressions: folding, tokens, stems, URLs, dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The letters that fold to one ASCII letter, and those that fold to two.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜŸ"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyyaaaaaaceeeeiiiinooooouuuuy"
FOLD_TWO = {"œ": "oe", "Œ": "oe", "æ": "ae", "Æ": "ae", "ß": "ss"}

# English stopwords.
STOPWORDS = ("the", "is", "at", "which", "on", "and", "a", "an", "for", "to", "in", "of", "with", "as", "by", "it", "this", "that", "be", "or", "not")


def _letters(c: Column) -> Column:
    """Letters with signs as ASCII letters."""
    c = F.translate(c, FOLD_FROM, FOLD_TO)
    for letter, two in FOLD_TWO.items():
        c = F.replace(c, F.lit(letter), F.lit(two))
    return c


def fold(c: Column) -> Column:
    """ASCII letters and digits; every other character becomes one space."""
    return F.regexp_replace(_letters(c), "[^a-zA-Z0-9]", " ")


def _lower(c: Column) -> Column:
    """Lower-case. The dotted capital I goes first: lower() would split it in two."""
    return F.lower(F.translate(F.coalesce(c, F.lit("")), "İ", "i"))


def normalize(c: Column) -> Column:
    """Lower-case, then folded."""
    return fold(_lower(c))


def split_words(c: Column) -> Column:
    """Normalised words, empty ones and single letters too: split at once, without a replacement for each character.

    After ``_lower`` and ``_letters`` no capital is left, and a class of two ranges is matched several times faster than one of three."""
    return F.split(_letters(_lower(c)), "[^a-z0-9]+")


def raw_tokens(c: Column) -> Column:
    """Normalised words of two letters or more."""
    return F.filter(split_words(c), lambda t: F.length(t) >= 2)


def index_tokens(c: Column, lang: Column) -> Column:
    """Words as the index keeps them, before stemming: English loses its stopwords."""
    words = raw_tokens(c)
    return F.when(lang == "en", F.filter(words, lambda t: ~t.isin(*STOPWORDS))).otherwise(words)


#: The stemmer's steps. ``!`` marks a finished stem and ``#`` a cut ending; tokens have neither sign.
STEM_STEPS = (
    ("^(.{2,})ies$", "$1y!"), ("^(.+ss)es$", "$1!"), ("^(.{1,3})$", "$1!"),
    ("^(.+)(?<=s|x|z|ch|sh)es$", "$1"), ("^(.{2,}[^s])s$", "$1"),
    ("^(.{3,})ing$", "$1#"), ("^([^#]{3,})ed$", "$1#"), (r"(.)\1#$", "$1"), ("[!#]$", ""),
)


def stem(t: Column) -> Column:
    """Light English stemmer. Every step refers once to the one before it, so that the expression
    stays small wherever the optimizer copies it (a filter pushed below a projection, say)."""
    for pattern, to in STEM_STEPS:
        t = F.regexp_replace(t, pattern, to)
    return t


def stemmed(rows: DataFrame, raw: str, where: Column, to: str) -> DataFrame:
    """``rows`` with ``to``: the stem of ``raw`` where ``where`` holds, else ``raw`` itself.

    For whole tables: endings are cut by plain string functions, a projection a step, so that each
    result is computed once and no regular expression runs; ``stem`` gives the same."""
    ends = lambda c, *endings: reduce(Column.__or__, (F.endswith(c, F.lit(e)) for e in endings))
    cut = lambda c, n: F.substring(c, F.lit(1), F.length(c) - n)
    t, a, s, b = F.col(raw), F.col("_a"), F.col("_s"), F.col("_b")
    rows = rows.withColumn("_a", F.when((F.length(t) > 3) & ends(t, "ses", "xes", "zes", "ches", "shes"), cut(t, 2)).otherwise(t))
    rows = rows.withColumn("_s", F.when((F.length(a) > 3) & ends(a, "s") & ~ends(a, "ss"), cut(a, 1)).otherwise(a))
    rows = rows.withColumn("_b", F.when(ends(s, "ing") & (F.length(s) > 5), cut(s, 3)).when(ends(s, "ed") & (F.length(s) > 4), cut(s, 2)))
    doubled = F.substring(b, -1, 1) == F.substring(b, -2, 1)
    found = F.when(~where | (F.length(t) <= 3), t).when(ends(t, "ies") & (F.length(t) > 4), F.concat(cut(t, 3), F.lit("y"))).when(ends(t, "sses") & (F.length(t) > 4), cut(t, 2)).when(b.isNull(), s).when((F.length(b) > 1) & doubled, cut(b, 1)).otherwise(b)
    return rows.withColumn(to, found).drop("_a", "_s", "_b")


def exploded_tokens(docs: DataFrame, text: str, lang: str = "lang", *keep: str) -> DataFrame:
    """One row per token of ``text``: ``keep``, ``pos`` (after stopwords went) and the stemmed ``token``."""
    rows = docs.select(*keep, F.col(lang).alias("_lang"), F.posexplode(index_tokens(F.col(text), F.col(lang))).alias("pos", "_raw"))
    return stemmed(rows, "_raw", F.coalesce(F.col("_lang") == "en", F.lit(False)), "token").select(*keep, "pos", "token")


def host_of(url: Column) -> Column:
    """Host with its port, without user data; empty for what has none."""
    return F.coalesce(F.regexp_replace(F.try_parse_url(url, F.lit("AUTHORITY")), "^[^@]*@", ""), F.lit(""))


def crawl_host(url: Column) -> Column:
    """The crawler's host: only http, https and schemeless addresses; a best effort for the rest."""
    u = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    naive = F.regexp_replace(F.regexp_replace(F.regexp_replace(u, "^.*?://", ""), "/.*$", ""), "#.*$", "")
    colons = F.length(naive) - F.length(F.replace(naive, F.lit(":"), F.lit("")))
    loose = F.when((colons > 1) & ~naive.contains("]"), "").otherwise(naive)
    host = host_of(u)
    proper = u.rlike("^(?i)(https?:)?//")
    return F.when(u == "", "").when(proper & (host != ""), host).when((scheme != "") & ~scheme.isin("http", "https") & u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:[^0-9]"), "").otherwise(loose)


def normalize_seed(raw: Column) -> Column:
    t = F.trim(raw)
    return F.when(t == "", None).when(F.lower(t).rlike("^https?://"), t).when(t.startswith("//"), F.concat(F.lit("https:"), t)).otherwise(F.concat(F.lit("https://"), t))


def doc_id_of(url: Column) -> Column:
    return F.sha1(url)


def parse_date(s: Column) -> Column:
    """A timestamp from an RFC 3339 instant or a plain date; null for anything else."""
    instant = s.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$")
    return F.when(instant, F.try_to_timestamp(s)).when(s.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_timestamp(s, F.lit("yyyy-MM-dd")))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def leading_int(s: Column) -> Column:
    """Leading digits as an integer: "1.5" is 1, "-1" is 0."""
    return F.coalesce(F.regexp_extract(s, "^[0-9]+", 0).try_cast("int"), F.lit(0))


def split_csv(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, ","), F.trim), lambda x: x != "")


def escape_html(s: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(sign), F.lit(entity))
    return s


def cut_bytes(s: Column, n: int) -> Column:
    """At most ``n`` bytes of UTF-8; a letter that is cut becomes the replacement character."""
    return F.when(F.octet_length(s) > n, F.make_valid_utf8(F.substring(F.encode(s, "UTF-8"), 1, n).cast("string"))).otherwise(s)


def guess_language(text: Column) -> Column:
    """``en`` for texts nearly all of ASCII letters with common English words; else empty."""
    t = F.lower(F.trim(text))
    letters = F.length(F.regexp_replace(t, "[^a-z ]", ""))
    ascii_count = F.length(F.regexp_replace(t, "[^\\x00-\\x7f]", ""))
    common = F.array(*map(F.lit, (" the ", " and ", " of ", " to ")))
    hit = F.exists(common, lambda w: F.contains(t, w))
    return F.when((letters >= 20) & (F.floor(ascii_count * 100 / F.length(t)) > 90) & hit, "en").otherwise("")


def embed_target(url: Column) -> tuple[Column, Column]:
    """Watch address and thumbnail of an embedded player's address; empty where it is none."""
    def after(mark: str) -> Column:
        return F.regexp_extract(url, f"{mark}([^?#&/]*)", 1)

    tube, short = after("/embed/"), after(r"youtu\.be/")
    daily, vimeo = after("/embed/video/"), after("/video/")
    tube = F.when(url.contains("youtube.com") & (tube != ""), tube).when(short != "", short)
    watch = F.when(tube.isNotNull(), F.concat(F.lit("https://www.youtube.com/watch?v="), tube)).when(url.contains("dailymotion.com/embed/video/") & (daily != ""), F.concat(F.lit("https://www.dailymotion.com/video/"), daily)).when(url.contains("player.vimeo.com/video/") & (vimeo != ""), F.concat(F.lit("https://vimeo.com/"), vimeo)).otherwise("")
    return watch, F.when(tube.isNotNull(), F.concat(F.lit("https://i.ytimg.com/vi/"), tube, F.lit("/hqdefault.jpg"))).otherwise("")
