"""Text functions as Column expressions: everything here stays inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a frontmatter block, a link and a folded scalar look like. No pattern here repeats a group over lines:
# the JVM matches such groups by recursion, and a long block would exhaust its stack.
FENCED = r"(?s)^---\r?\n(.*?)\r?\n---"
LINK_END, LINK_START = "]]", r"(?s)\[\[([^|]++)(?:\|.++)?$"
FOLDED_MARK = r"[>|][-+0-9]*"
#: The line end before a line that is neither indented nor empty.
NEXT_FIELD = r"\n(?=[^ \t\r\n])"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row. What refers to a column of a projection may be given a copy of its
    expression; the output of a generator is a value."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def tokenize(text: Column) -> Column:
    """Lower-cased runs of characters other than white space and ASCII punctuation."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\p{IsWhite_Space}\p{Punct}]+"), lambda x: x != "")


def index_terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, as a search index has them; terms over 40 bytes are left out."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: (x != "") & (F.octet_length(x) <= 40))


def title_from_path(path: Column) -> Column:
    """The last segment of a path without its trailing ``.md``, however often that is repeated."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(\.md)+$", "")


def filename_text(path: Column) -> Column:
    """A file name as search text: the last segment without ``.md``, with ``-`` and ``_`` as spaces."""
    return F.translate(F.element_at(F.split(F.regexp_replace(path, r"\.md$", ""), "/"), -1), "-_", "  ")


def ellipsis(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def percent(share: Column) -> Column:
    return F.format_string("%d%%", F.round(share * 100).cast("int"))


def hidden(path: Column) -> Column:
    """Whether any component of a relative path starts with a dot."""
    return F.exists(F.split(path, "/"), lambda x: F.startswith(x, F.lit(".")))


def frontmatter(content: Column) -> Column:
    """The text between the fences at the start of a note; null without them."""
    found = F.regexp_extract(content, FENCED, 1)
    return F.when(F.regexp_like(content, F.lit(FENCED)), found)


def body(content: Column) -> Column:
    """A note without its frontmatter."""
    return F.regexp_replace(content, FENCED + r"\r?\n?", "")


def fields(raw: Column, prefix: str, strict_values: bool = True) -> Column:
    """The prefixed ``key: value`` lines of a frontmatter as a map without the prefix; of repeated keys the last counts.

    With ``strict_values`` an empty value stays empty; without, it takes the next line, as ``\\s*`` would.
    """
    gap = r"[ \t]*" if strict_values else r"\s*"
    line = rf"(?m)^{prefix}(\w+):{gap}(.*)$"
    keys, values = F.regexp_extract_all(raw, F.lit(line), 1), F.regexp_extract_all(raw, F.lit(line), 2)
    return _last_wins(keys, values)


def _last_wins(keys: Column, values: Column) -> Column:
    """A map of the pairs; of equal keys the last pair counts. Sorting by key and place keeps many keys from being compared
    each with each."""
    pairs = F.array_sort(F.arrays_zip(keys.alias("key"), F.sequence(F.lit(1), F.size(keys)).alias("place"), values.alias("value")))
    beside = F.arrays_zip(pairs.alias("x"), F.slice(pairs, 2, F.size(keys)).alias("next"))
    last = F.transform(F.filter(beside, lambda p: ~p["x"]["key"].eqNullSafe(p["next"]["key"])), lambda p: F.struct(p["x"]["key"], p["x"]["value"]))
    return F.when(raw_exists(keys), F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>"))


def raw_exists(keys: Column) -> Column:
    return F.coalesce(F.size(keys), F.lit(0)) > 0


def unquote(value: Column) -> Column:
    """A trimmed value without double, then single quotes around it."""
    bare = F.regexp_replace(F.trim(value), '^"+|"+$', "")
    return F.regexp_replace(bare, "^'+|'+$", "")


def is_list(value: Column) -> Column:
    return F.regexp_like(F.trim(value), F.lit(r"^\[.*\]$"))


def list_value(value: Column) -> Column:
    """The items of an inline list ``[a, b]``: trimmed, unquoted, empty ones dropped; a plain value is a list of one."""
    inner = F.regexp_extract(F.trim(value), r"^\[(.*)\]$", 1)
    items = F.filter(F.transform(F.split(inner, ","), unquote), lambda x: x != "")
    return F.when(is_list(value), items).when(unquote(value) != "", F.array(unquote(value))).otherwise(F.array().cast("array<string>"))


def gist(raw: Column, prefix: str) -> Column:
    """The gist of a frontmatter: of a block (``>``, ``|`` or nothing after the colon) the indented lines joined by
    spaces up to the first that isn't indented, else the rest of the line."""
    after = F.get(F.split(raw, rf"(?m)^{prefix}gist:", 2), 1)
    own = F.get(F.split(after, NEXT_FIELD, 2), 0)
    inline = F.trim(F.regexp_extract(own, r"^[ \t]*(.*)", 1))
    lines = F.transform(F.slice(F.split(own, r"\r?\n"), 2, F.char_length(own) + 1), lambda x: F.trim(x))
    folded = F.array_join(F.filter(lines, lambda x: x != ""), " ")
    value = F.when(inline.isin(">", "|", ""), folded).otherwise(unquote(inline))
    return F.when(value != "", value)


def block_count(content: Column) -> Column:
    """How many frontmatter blocks a note seems to have: half its ``---`` lines if the first line is one, else none."""
    fences = F.size(F.filter(F.split(content, r"\r?\n"), lambda x: F.rtrim(x) == "---"))
    return F.when(F.startswith(content, F.lit("---")), F.floor(fences / 2)).otherwise(0).cast("int")


def folded_fields(raw: Column, prefix: str) -> Column:
    """The fields whose value is a folded or literal scalar mark."""
    return F.regexp_extract_all(raw, F.lit(rf"(?m)^{prefix}(\w+):[ \t]*{FOLDED_MARK}[ \t]*$"), 1)


def wikilinks(content: Column) -> Column:
    """The trimmed targets of ``[[target]]`` and ``[[target|label]]``, repeats kept. What stands between a link's end and the
    last ``]`` before it can hold one link, so that unclosed brackets are each looked at once."""
    parts = F.split(content, re.escape(LINK_END))
    ended = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.regexp_extract(F.substring_index(x, "]", -1), LINK_START, 1))
    return F.transform(F.filter(ended, lambda x: x != ""), lambda x: F.trim(x))


def completion_prefix(line: Column) -> Column:
    """What stands after an open ``[[`` at the end of a line, if it is two characters or more: the start of a target."""
    open_end = F.substring_index(F.regexp_replace(line, r"\r?\n\z", ""), "]", -1)
    found = F.get(F.split(open_end, r"\[\[", 2), 1)
    return F.when(F.char_length(found) >= 2, found)


def render_frontmatter(prefix: str, type_: Column, area: Column, gist_: Column, tags: Column, source: Column, today: Column, status: Column | None = None) -> Column:
    """A fenced frontmatter: type, status, area, folded gist with its origin and date, tags and sources; absent ones are left out."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{prefix}{name}: "), value))
    listed = lambda name, value: F.when(F.size(value) > 0, F.concat(F.lit(f"{prefix}{name}: ["), F.array_join(value, ", "), F.lit("]")))
    has_gist = gist_.isNotNull()
    return F.concat_ws(
        "\n", F.lit("---"), line("type", type_), line("status", F.lit("active") if status is None else status), line("area", area),
        F.when(has_gist, F.concat(F.lit(f"{prefix}gist: >\n  "), gist_)), F.when(has_gist, F.lit(f"{prefix}gist_source: ai")),
        F.when(has_gist, F.concat(F.lit(f"{prefix}gist_date: "), F.date_format(today, "yyyy-MM-dd"))), listed("tags", tags), listed("source", source), F.lit("---"),
    )
