"""Sections of a prompt as columns: each is null where it has nothing to say, and `assemble_prompts` leaves it out then."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tone that a declared urgency asks for; an unknown one counts as `media`.
TONES = {"alta": "breve y directo", "media": "institucional", "baja": "extenso, con análisis normativo"}


def _filled(text: Column) -> Column:
    """The text, or null if it is blank."""
    return F.when(F.trim(text) != "", text)


def _some(items: Column) -> Column:
    """The array without nulls, or null if it is empty."""
    return F.when(F.size(F.array_compact(items)) > 0, F.array_compact(items))


def _lines(title: str, *lines: Column) -> Column:
    return F.concat_ws("\n", F.lit(title), *lines)


def comprehension_section(theme: Column, rights: Column, requests: Column, excerpt: Column) -> Column:
    """What a petition is about; null without a theme. Rights and requests are arrays, requests are numbered."""
    numbered = F.array_join(F.transform(_some(requests), lambda r, i: F.concat(F.lit("    "), (i + 1).cast("string"), F.lit(". "), r)), "\n")
    parts = [
        F.concat(F.lit("  Tema: "), theme), F.concat(F.lit("  Derechos: "), F.array_join(_some(rights), ", ")),
        F.concat(F.lit("  Peticiones:\n"), numbered), F.concat(F.lit("  Extracto: "), _filled(excerpt)),
    ]
    return F.when(_filled(theme).isNotNull(), _lines("ANÁLISIS", *parts))


def strategy_section(precedents: Column, urgency: Column) -> Column:
    """What the precedents (array of kind and result; a null element has no comprehension) advise; null without any.

    Favourable ones are counted by kind, in the order in which kinds come first; unfavourable ones give a warning.
    """
    known = _some(precedents)
    kinds = F.transform(F.filter(known, lambda p: p["result"] == "favorable"), lambda p: F.coalesce(_filled(p["kind"]), F.lit("General")))
    counted = F.transform(F.array_distinct(kinds), lambda k: F.concat(F.lit("  - "), k, F.lit(": "), F.size(F.filter(kinds, lambda x: x == k)).cast("string")))
    against = F.size(F.filter(known, lambda p: p["result"] == "desfavorable"))
    tone = F.coalesce(*(F.when(urgency == name, text) for name, text in TONES.items()), F.lit(TONES["media"]))
    lines = [
        F.when(F.size(counted) > 0, F.array_join(counted, "\n")).otherwise(F.lit("  - sin precedentes favorables")),
        F.when(against > 0, F.concat(F.lit("  ALERTA desfavorables: "), against.cast("string"))), F.concat(F.lit("  Tono: "), tone),
    ]
    return F.when(known.isNotNull(), _lines("ESTRATEGIA", *lines))


def titled_section(title: str, items: Column) -> Column:
    """A list of (title, content), such as legal notes or the lawyer's own arguments; null if it is empty."""
    listed = F.transform(_some(items), lambda x: F.concat(F.lit("  - "), F.coalesce(x["title"], F.lit("")), F.lit(": "), F.coalesce(x["content"], F.lit(""))))
    return F.when(_some(items).isNotNull(), _lines(title, F.array_join(listed, "\n")))


def inherited_comprehension(theme: Column, kind: Column, rights: Column) -> Column:
    """What a promoted answer's knowledge rows say of it: what it resolves, its kind, a favourable result and its rights; null without a theme."""
    return F.when(
        _filled(theme).isNotNull(),
        F.struct(theme.alias("resolves"), F.coalesce(_filled(kind), F.lit("General")).alias("kind"), F.lit("favorable").alias("result"), F.coalesce(rights, F.array().cast("array<string>")).alias("rights")),
    )


def comprehension_text(comprehension: Column) -> Column:
    """The text that a comprehension vector is made of."""
    return F.when(comprehension.isNotNull(), F.concat(comprehension["resolves"], F.lit(". "), F.array_join(comprehension["rights"], ". ")))
