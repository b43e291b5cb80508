"""HTML annotations (H0 - H29): an ordered selector list per output key.

A page is one row and stays one row: comments and scripts are blanked, the tags
that can carry an annotation are cut out by one pattern, their attributes are
looked up in literal maps made from the selector list, and per key the first
selector that yields a value decides.  No exchange, no Python, and the HTML never
leaves the scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitestance import config
from sitestance.functions import rows, text

# Unclosed comments and scripts reach to the end of the page.  A title or text area is
# matched first and put back, since nothing in it opens a comment.
_HIDDEN = (
    r"(?is)(<(title|textarea)\b.*?(?:</\2\s*+>|\z))|<(?:!--.*?(?:-->|\z)"
    r"|script\b.*?(?:</script\s*+>|\z)|style\b.*?(?:</style\s*+>|\z))"
)
# A quoted value may hold ">".  Possessive, so long tags cost no stack.
_REST_OF_TAG = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""
# Every tag once, in linear time; which of them count is asked of each on its own.
_TAGS = r"(?is)<[a-z][^\s/<>]*+" + _REST_OF_TAG
_TELLING = (
    r"(?is)^<(?:meta|link|html)[\s/>]|^<a\s.*creativecommons|^<[^\s/<>]++\s.*\b(?:rel|property)\s*+="
)
# A name starts where the character before cannot belong to one.
_ATTRIBUTE = (
    r"""(?s)(?<![^\s"'<>/=])([^\s"'<>/=]++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)"""
)
_READ = ["name", "property", "http-equiv", "rel", "type", "content", "href", "lang"]

ANNOTATION_TYPE = "array<struct<key:string,values:array<string>>>"


def visible(html: Column) -> Column:
    """Page source without comments, scripts and styles."""
    return F.regexp_replace(html, _HIDDEN, "$1")


def _unquoted(value: Column) -> Column:
    quoted = F.startswith(value, F.lit('"')) | F.startswith(value, F.lit("'"))
    return F.when(quoted, value.substr(F.lit(2), F.length(value) - 2)).otherwise(value)


def tags_of(source: Column) -> Column:
    """``array<struct<tag, name, property, ..., lang>>`` in document order.

    The first of repeated attributes counts, as browsers have it.
    """

    def one(tag: Column) -> Column:
        body = F.regexp_replace(tag, r"^<[^\s/>]+", "")
        names = F.regexp_extract_all(body, F.lit(_ATTRIBUTE), F.lit(1))
        values = F.regexp_extract_all(body, F.lit(_ATTRIBUTE), F.lit(2))
        lowered = F.transform(names, F.lower)
        return F.struct(
            F.lower(F.regexp_extract(tag, r"^<([^\s/>]+)", 1)).alias("tag"),
            lowered.alias("names"),
            values.alias("values"),
        )

    def columns(t: Column) -> Column:
        def read(attribute: str) -> Column:
            at = F.array_position(t["names"], F.lit(attribute)).cast("int")
            return F.when(at > 0, _unquoted(t["values"][at - 1]))

        return F.struct(t["tag"].alias("tag"), *[read(a).alias(a) for a in _READ])

    every = F.regexp_extract_all(source, F.lit(_TAGS), F.lit(0))
    found = F.filter(every, lambda tag: tag.rlike(_TELLING))
    return F.transform(F.transform(found, one), columns)


def _shapes(selectors: dict, fold_case: bool) -> dict:
    """(element, attribute, attribute read) -> value -> [(key, rank)]."""
    shapes: dict = {}
    for key, options in selectors.items():
        for rank, (element, attribute, value, out) in enumerate(options):
            if attribute == "text":
                continue
            wanted = value.lower() if fold_case else value
            hits = shapes.setdefault((element, attribute, out), {}).setdefault(wanted, [])
            if key not in [k for k, _ in hits]:
                hits.append((key, rank))
    return shapes


_TARGETS = "array<struct<key:string,rank:int>>"


def _listed(hits: list) -> list[dict]:
    return [{"key": key, "rank": rank} for key, rank in hits]


def _starting(value: Column):
    return lambda s: F.startswith(value, s["start"])


def _valued(value: Column):
    return lambda h: F.struct(
        h["key"].alias("key"), h["rank"].alias("rank"), value.alias("value")
    )


def _hits_of_tag(t: Column, selectors: dict, fold_case: bool) -> Column:
    """``array<struct<key, rank, value>>`` for one tag."""
    none = F.array().cast(_TARGETS)
    parts = []
    for (element, attribute, out), wanted in _shapes(selectors, fold_case).items():
        on_element = F.lit(True) if element == "*" else t["tag"] == element
        if attribute == "present":
            targets = text.constant(_listed(wanted[""]), _TARGETS)
        elif attribute == "prefix":
            starts = [
                {"start": v, **hit} for v, hits in wanted.items() for hit in _listed(hits)
            ]
            targets = F.transform(
                F.filter(
                    text.constant(starts, "array<struct<start:string,key:string,rank:int>>"),
                    _starting(t[out]),
                ),
                lambda s: F.struct(s["key"].alias("key"), s["rank"].alias("rank")),
            )
        else:
            table = text.constant(
                {v: _listed(hits) for v, hits in wanted.items()}, f"map<string,{_TARGETS}>"
            )
            value = F.lower(F.btrim(t[attribute])) if fold_case else t[attribute]
            targets = F.try_element_at(table, value)
        usable = on_element & t[out].isNotNull()
        found = F.when(usable, F.coalesce(targets, none)).otherwise(none)
        parts.append(F.transform(found, _valued(t[out])))
    return F.concat(*parts)


def _text_hits(source: Column, selectors: dict) -> list[Column]:
    """Element text for ``title`` and ``h1``: first element, tags removed."""
    hits = []
    for key, options in selectors.items():
        for rank, (element, attribute, _, _) in enumerate(options):
            if attribute != "text":
                continue
            # The first start decides; if nothing ends it, no later one is ended either.
            whole = rf"(?is)<{element}(?:\s(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)?>(.*?)(</{element}\s*+>|\z)"
            ended = F.regexp_extract(source, whole, 2) != ""
            inner = F.when(ended, F.regexp_extract(source, whole, 1)).otherwise("")
            # Only an element holding plain text keeps its "<" signs.
            bare = inner if element == "title" else F.regexp_replace(inner, r"(?s)<[^<>]*+>", "")
            value = text.squeeze(bare)
            hits.append(
                F.struct(
                    F.lit(key).alias("key"), F.lit(rank).alias("rank"), value.alias("value")
                )
            )
    return hits


def annotate(
    pages: DataFrame,
    html: str = "html",
    selectors: dict | None = None,
    fold_case: bool = True,
) -> DataFrame:
    """Adds ``annotations``: ``array<struct<key, values>>``; the page text is dropped (M7).

    ``fold_case`` compares attribute values in lower case, a superset of the listed
    spellings; without it exactly the listed spellings count, in their order.
    Values that are blank do not count.
    """
    chosen = config.SELECTORS if selectors is None else selectors
    staged = pages.withColumn("_source", visible(F.col(html))).withColumn(
        "_tags", tags_of(F.col("_source"))
    )
    from_tags = F.flatten(F.transform("_tags", lambda t: _hits_of_tag(t, chosen, fold_case)))
    texts = _text_hits(F.col("_source"), chosen)
    hits = F.concat(F.array(*texts), from_tags) if texts else from_tags
    decoded = F.transform(
        hits,
        lambda h: F.struct(
            h["key"].alias("key"),
            h["rank"].alias("rank"),
            text.decode_references(h["value"]).alias("value"),
        ),
    )
    kept = F.filter("_decoded", lambda h: F.btrim(h["value"]) != "")
    found = staged.withColumn("_decoded", decoded).withColumn("_hits", kept)

    def decide(key: Column) -> Column:
        mine = F.filter("_hits", lambda h: h["key"] == key)
        best = F.array_min(F.transform(mine, lambda h: h["rank"]))
        values = F.transform(
            F.filter(mine, lambda h: h["rank"] == best), lambda h: h["value"]
        )
        return F.struct(key.alias("key"), values.alias("values"))

    keys = F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["key"])))
    decided = found.withColumn("annotations", F.transform(keys, decide))
    return decided.drop("_source", "_tags", "_decoded", "_hits", html)


def annotation_rows(annotated: DataFrame, *carry: str) -> DataFrame:
    """Long form: ``(…carry, key, pos, value)``."""
    per_key = rows.inlined(annotated, list(carry), "annotations", "key")
    return rows.numbered(per_key, [*carry, "key"], "values", "pos", "value")


def annotation_keys(annotated: DataFrame, *carry: str) -> DataFrame:
    """One row per page and key, enough for prevalence counts."""
    return rows.exploded(annotated, list(carry), "annotations.key", "key")


def values_of(key: str, annotations: str = "annotations") -> Column:
    """The values of one key, NULL when absent."""
    match = F.filter(annotations, lambda a: a["key"] == key)
    return F.try_element_at(match, F.lit(1))["values"]
