"""Notes: front matter and a small block grammar to rows, and rows to HTML, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.operators.detect import bound

# Keys of the front matter that a note must have, and the forms of blocks and inline marks.
REQUIRED = ("slug", "title", "date", "summary")
FRONT = r"\A---\n([\s\S]*?)\n---\n?([\s\S]*)\z"
HEADING = r"\A(#{2,3})\s+(.+)\z"
IMAGE = r'\A!\[([^\]]*)\]\((\S+?)(?:\s+"([^"]+)")?\)\z'
LINES = {"blockquote": r">\s?(.+)", "ordered": r"[0-9]+\.\s+(.+)", "bullets": r"[-*]\s+(.+)"}
MARKS = r"`[^`\n]+`|==[^=\n]+==|\*\*[^*\n]+\*\*|\*[^*\n]+\*"


def note_parse(notes: DataFrame) -> DataFrame:
    """``notes(note_id, source)`` to ``note_id, slug, title, date, datetime, summary, problem, blocks``.

    ``problem`` names what makes a note invalid: no front matter, or the first key that it lacks.
    """
    source = F.coalesce("source", F.lit(""))
    front, body = F.regexp_extract(source, FRONT, 1), F.regexp_extract(source, FRONT, 2)

    def meta(key: str) -> Column:
        value = F.trim(F.regexp_extract(front, rf"(?m)(?:.*\n)*^[ \t]*{key}[ \t]*:(.*)$", 1))  # of repeated keys the last counts
        return F.when(value != "", value)

    def block(c: Column) -> Column:
        lines = F.split(c, "\n")


        def cut(p: str) -> Column:
            return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_extract(x, rf"\A{p}\z", 1))), lambda x: x != "")

        cuts = {k: cut(p) for k, p in LINES.items()}
        all_of = {k: F.size(v) == F.size(lines) for k, v in cuts.items()}
        nothing = F.array().cast("array<string>")
        kind = (
            F.when(c.rlike(HEADING), "heading").when(c.rlike(IMAGE), "image").when(all_of["blockquote"], "blockquote").when(all_of["ordered"] | all_of["bullets"], "list").otherwise("paragraph")
        )
        text = F.when(c.rlike(HEADING), F.trim(F.regexp_extract(c, HEADING, 2))).when(c.rlike(IMAGE), F.lit("")).when(all_of["blockquote"], F.array_join(cuts["blockquote"], "\n"))
        text = text.when(all_of["ordered"] | all_of["bullets"], "").otherwise(F.regexp_replace(c, r"\n+", " "))
        other = ~c.rlike(HEADING) & ~c.rlike(IMAGE) & ~all_of["blockquote"]
        items = F.when(other & all_of["ordered"], cuts["ordered"]).when(other & all_of["bullets"], cuts["bullets"]).otherwise(nothing)
        return F.struct(
            kind.alias("type"), F.length(F.regexp_extract(c, HEADING, 1)).alias("level"), (other & all_of["ordered"]).alias("ordered"), text.alias("text"), items.alias("items"),
            F.regexp_extract(c, IMAGE, 1).alias("alt"), F.regexp_extract(c, IMAGE, 2).alias("src"), F.regexp_extract(c, IMAGE, 3).alias("caption"),
        )

    chunks = F.filter(F.transform(F.split(body, r"\n{2,}"), lambda c: F.regexp_replace(c, r"\A\s+|\s+\z", "")), lambda c: c != "")
    problem = F.when(~source.rlike(FRONT), "front matter")
    for key in REQUIRED:
        problem = problem.when(meta(key).isNull(), key)
    return notes.select("note_id", *[meta(k).alias(k) for k in ("slug", "title", "date", "datetime", "summary")], problem.alias("problem"), F.transform(chunks, block).alias("blocks"))


def escaped(v: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        v = F.replace(v, F.lit(char), F.lit(entity))
    return v


def inline(v: Column) -> Column:
    """Escaped text with its marks as elements: code, mark, strong, em."""

    def element(t: Column) -> Column:
        def tagged(tag: str, n: int) -> Column:
            return F.concat(F.lit(f"<{tag}>"), escaped(F.substring(t, F.lit(n + 1), F.length(t) - 2 * n)), F.lit(f"</{tag}>"))

        return F.when(t.startswith("`"), tagged("code", 1)).when(t.startswith("=="), tagged("mark", 2)).when(t.startswith("**"), tagged("strong", 2)).otherwise(tagged("em", 1))

    def joined(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda p: F.concat(escaped(F.coalesce(p["g"], F.lit(""))), F.coalesce(element(p["t"]), F.lit("")))), "")

    pairs = F.zip_with(F.split(v, MARKS, -1), F.regexp_extract_all(v, F.lit(MARKS), F.lit(0)), lambda g, t: F.struct(g.alias("g"), t.alias("t")))
    return bound(pairs, joined)


def note_render(parsed: DataFrame) -> DataFrame:
    """``note_id, html`` of valid notes: one article, without white space between its elements."""

    def listed(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda i: F.concat(F.lit("<li>"), inline(i), F.lit("</li>"))), "")

    def element(b: Column) -> Column:
        level, tag = b["level"].cast("string"), F.when(b["ordered"], "ol").otherwise("ul")
        caption = F.when(b["caption"] != "", F.concat(F.lit("<figcaption>"), escaped(b["caption"]), F.lit("</figcaption>"))).otherwise("")
        image = F.concat(F.lit('<figure class="field-note-figure"><img src="'), escaped(b["src"]), F.lit('" alt="'), escaped(b["alt"]), F.lit('" loading="lazy" />'), caption, F.lit("</figure>"))
        quote = F.array_join(F.transform(F.split(b["text"], "\n"), inline), "<br>")
        return (
            F.when(b["type"] == "heading", F.concat(F.lit("<h"), level, F.lit(">"), escaped(b["text"]), F.lit("</h"), level, F.lit(">"))).when(b["type"] == "image", image)
            .when(b["type"] == "list", F.concat(F.lit("<"), tag, F.lit(">"), listed(b["items"]), F.lit("</"), tag, F.lit(">")))
            .when(b["type"] == "blockquote", F.concat(F.lit("<blockquote>"), quote, F.lit("</blockquote>")))
            .otherwise(F.concat(F.lit("<p>"), inline(b["text"]), F.lit("</p>")))
        )

    body = F.array_join(F.transform("blocks", element), "")
    return parsed.filter("problem is null").select("note_id", F.concat(F.lit('<article class="field-note-article">'), body, F.lit("</article>")).alias("html"))
