"""Text functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
TERM = r"[\p{L}\p{N}]+"
#: Whole words that split_camel or an underscore parts: all others are capitals, then none. Each word is tried from its
#: first letter alone, else a long text costs by the squares of its words.
PARTED = r"(?<![\p{L}\p{N}_])\p{Lu}*+[\p{L}\p{N}&&[^\p{Lu}]]*+[_\p{Lu}][\p{L}\p{N}_]*+"
#: A capital that split_camel parts from a letter or digit.
INNER_CAPITAL = r"\p{Lu}(?<=[\p{L}\p{N}&&[^\p{Lu}]]\p{Lu})"


def split_camel(text: Column) -> Column:
    """A space before each capital whose predecessor is neither a capital nor a space."""
    return F.regexp_replace(text, r"(?<=[^\p{Lu} ])(?=\p{Lu})", " ")


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def index_terms(text: Column) -> Column:
    """The terms of the text index: lower-case runs of letters and digits; underscores part them."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def spaced_terms(text: Column) -> Column:
    """The terms of a lower-case text in one string: two spaces before, between and after them, so that each has a space
    of its own at either end."""
    return F.concat(F.lit("  "), F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "  ")), F.lit("  "))


def times_in(spaced: Column, needle: str) -> Column:
    """How often spaced_terms() have the needle, overlaps aside."""
    gone = F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(needle), F.lit("")))
    return (gone / len(needle.encode())).cast("int")


def terms_in(spaced: Column) -> Column:
    """The number of terms."""
    return F.when(F.octet_length(spaced) == 4, 0).otherwise(times_in(spaced, "  ") - 1)


def one_line(text: Column) -> Column:
    return F.trim(F.translate(text, "\r\n", "  "))


def aux_tokens(entity_id: Column, text: Column) -> Column:
    """Identifiers of the id and of the first line (200 characters) that fall into several words, split; 24 distinct at most."""
    source = F.concat_ws(" ", entity_id, F.left(F.substring_index(text, "\n", 1), F.lit(200)))
    parted = F.regexp_extract_all(source, F.lit(f"({PARTED})"), F.lit(1))
    pairs = F.transform(parted, lambda w: F.struct(w.alias("w"), F.trim(split_camel(F.translate(w, "_", " "))).alias("s")))
    changed = F.transform(F.filter(pairs, lambda p: (p["s"] != p["w"]) & (p["s"] != "")), lambda p: p["s"])
    split = F.array_join(F.slice(F.array_distinct(changed), 1, 24), " ")
    return F.when(F.contains(source, F.lit("_")) | source.rlike(INNER_CAPITAL), split).otherwise("")  # few texts have any


def is_distinctive(name: Column) -> Column:
    """Long enough and odd enough to be meant when it stands in prose."""
    capitals = F.length(F.regexp_replace(name, r"[^\p{Lu}]", ""))
    return (F.length(name) >= 5) & (name.contains("_") | ((capitals >= 2) & name.rlike(r"\p{Ll}")))


def query_terms(query: str, distinct: bool = True) -> list[str]:
    """The words of a search in order, underscores part them."""
    words = re.findall(r"[^\W_]+", query.lower())
    return list(dict.fromkeys(words)) if distinct else words


def match_expression(query: str, operator: str = "AND", prefix: bool = False) -> str:
    """The search as an expression of quoted words, for people who want to see how it is read; empty if it has none."""
    words = re.findall(r"\w+", query)
    return f" {operator} ".join(f'"{w}"' + "*" * prefix for w in words)


def slug(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(text), r"[ _-]+", "-")
    kept = F.regexp_replace(F.regexp_replace(dashed, r"[^\p{L}\p{N}-]+", ""), "-{2,}", "-")
    trimmed = F.regexp_replace(kept, "^-+|-+$", "")
    return F.when(trimmed == "", "section").otherwise(trimmed)


# The character references that are decoded, in any case and in this order.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&mdash;", "—"), ("&ndash;", "–"))


def decode_entities(text: Column) -> Column:
    return reduce(lambda c, pair: F.regexp_replace(c, f"(?i){pair[0]}", pair[1]), ENTITIES, text)


# What is cut out, and the elements that end a line.
CUT_OUT = (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<!--.*?-->", r"(?is)<head.*?</head>")
LINE_ENDS = r"(?i)<(br|/p|/div|/li|/tr|/section|/article|/header|/footer|/table|/ul|/ol)[^>]*>"


def html_to_text(html: Column) -> Column:
    """Plain text in which headings are marked as in Markdown; scripts, styles, comments and the head are gone."""
    out = html
    for pattern in CUT_OUT:
        out = F.regexp_replace(out, pattern, " ")
    for level in range(1, 7):
        out = F.regexp_replace(F.regexp_replace(out, rf"(?i)<h{level}[^>]*>", "\n" + "#" * level + " "), rf"(?i)</h{level}>", "\n")
    out = F.regexp_replace(out, LINE_ENDS, "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<li[^>]*>", "\n- "), r"<[^>]+>", "")
    return F.regexp_replace(decode_entities(out), r"\n{3,}", "\n\n")


def html_title(html: Column) -> Column:
    return F.trim(decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def severity(edge_type: Column) -> Column:
    from ..schema import SEVERITY

    return F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), lambda k, _: k == edge_type)), F.lit(0)), F.lit(1))


def package_of(tag_value: Column) -> Column:
    """Package that a tag value names: the quotes of Class'path' go, and what follows the first dot; else null."""
    bare = F.regexp_replace(tag_value, r"^[^']*'\"?([^'\"]*)\"?'$", "$1")
    package = F.substring_index(bare, ".", 1)
    return F.when(package.startswith("/Game"), package)


def dimensions(text: Column) -> Column:
    """Struct of width and height from WxH, else null."""
    w, h = (F.regexp_extract(text, r"(?i)^\s*([0-9]+)\s*x\s*([0-9]+)\s*$", g) for g in (1, 2))
    return F.when(w != "", F.struct(w.cast("int").alias("width"), h.cast("int").alias("height")))


def reflection_name(name: Column) -> Column:
    return F.regexp_replace(name, r"^[AUFISTE](?=\p{Lu})", "")


def inner_type(type_name: Column) -> Column:
    """First template argument, else the last identifier."""
    inside = F.regexp_extract(type_name, r"<\s*(?:const\s+)?(?:class\s+|struct\s+)?([A-Za-z_]\w*)", 1)
    return F.when(inside != "", inside).otherwise(F.regexp_extract(type_name, r"([A-Za-z_]\w*)[\s*&]*$", 1))
