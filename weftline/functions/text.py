"""Text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, spelled out, since regular expression dialects differ on it.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same for dialects that write code points as \x{...}.
SPACE_RE2 = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CURLY, STRAIGHT = "’‘“”", "''\"\""


def squeeze(c: Column) -> Column:
    """White space to single spaces, none at the ends."""
    return F.btrim(F.regexp_replace(c, f"{SPACE}+", " "))


def straight_quotes(c: Column) -> Column:
    return F.translate(c, CURLY, STRAIGHT)


def clean_text(c: Column) -> Column:
    """A subtitle's text without override tags, escapes, markup and curly quotes."""
    c = F.regexp_replace(c, r"\{[^}]*\}", "")
    for escape in ("\\N", "\\n", "\\h"):
        c = F.replace(c, F.lit(escape), F.lit(" "))
    return squeeze(straight_quotes(F.regexp_replace(c, r"<[^>]+>", "")))


def clean_line(c: Column) -> Column:
    """A transcript's line without stage directions."""
    return F.btrim(F.regexp_replace(straight_quotes(F.regexp_replace(c, r"\([^)]*\)|\[[^\]]*\]", " ")), f"{SPACE}+", " "), F.lit(" -"))


def lyric_norm(c: Column) -> Column:
    """Lower case, letters a-z, apostrophes and spaces only."""
    return F.btrim(F.regexp_replace(F.lower(c), r"[^a-z' ]", ""))


def spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def word_count(c: Column) -> Column:
    """Runs of anything but white space; 0 of null."""
    squeezed = squeeze(c)
    return F.when(F.coalesce(F.length(squeezed), F.lit(0)) == 0, 0).otherwise(spaces(squeezed) + 1)


def timecode(c: Column) -> Column:
    """h:mm:ss.cc as seconds."""
    parts = F.split(F.btrim(c), ":")
    return parts[0].cast("int") * 3600 + parts[1].cast("int") * 60 + parts[2].cast("double")


def primary_label(classes: Column, labels: list[str]) -> Column:
    """The first of ``labels`` that occurs, in any case, in the joined classes; else null."""
    joined = F.lower(F.array_join(classes, " "))
    out = F.lit(None).cast("string")
    for label in reversed(labels):
        out = F.when(F.contains(joined, F.lit(label.lower())), F.lit(label)).otherwise(out)
    return out


def classes_of(listed: Column, legacy: Column) -> Column:
    """The list of classes where it has any, else the comma-separated legacy string; trimmed, no blanks."""
    tidy = lambda a: F.filter(F.transform(a, lambda x: squeeze(x)), lambda x: x != "")
    return F.when(F.size(listed) > 0, tidy(listed)).otherwise(tidy(F.split(F.coalesce(legacy, F.lit("")), ",")))


def split_list(c: Column, strip_notes: bool = False) -> Column:
    """Comma-separated items without ~qualifiers (and closing notes in brackets), each once, in order."""
    items = F.transform(F.split(c, ","), lambda x: F.regexp_replace(F.btrim(x), r"~[\p{L}\p{N}_]+$", ""))
    if strip_notes:
        items = F.transform(items, lambda x: F.regexp_replace(x, r"\s*\([^)]*\)$", ""))
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def article_url(base: str, title: Column) -> Column:
    """A wiki page's address: spaces become underscores, all but slashes is percent-encoded."""
    encoded = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for wrong, right in (("%2F", "/"), ("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(wrong), F.lit(right))
    return F.concat(F.lit(f"{base}/wiki/"), encoded)


def strip_speaker(reply: Column, names: list[str]) -> Column:
    """A reply without a leading "Name:", for each of the names in turn."""
    out = F.ltrim(reply)
    for name in names:
        out = F.when(F.startswith(out, F.lit(f"{name}:")), F.ltrim(F.substr(out, F.lit(len(name) + 2)))).otherwise(out)
    return out


def message_text(content: Column) -> Column:
    """The text of a message that is a JSON string, an object with text, or a list of such; else the content itself."""
    parts = F.from_json(content, "array<struct<text:string>>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), " ")
    return F.when(F.startswith(F.ltrim(content), F.lit("[")) & parts.isNotNull(), joined).when(F.startswith(F.ltrim(content), F.lit("{")), F.coalesce(F.get_json_object(content, "$.text"), F.lit(""))).otherwise(content)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    length = F.sqrt(dot(a, a))
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(a.cast("array<double>"))
