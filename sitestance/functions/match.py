r"""Rule matching: longest pattern wins, allow wins a tie, no match means allowed.

A rule is a literal head and, only when it holds ``*`` or a final ``$``, the literal segments
after it.  Two forms of the same verdict are offered:

* :func:`verdict` judges one path by an :func:`index` of its rule set.  Rules without
  wildcards lie sorted by their heads.  A small set is read through; in a large one the
  path's own beginnings, longest first, are sought by halving.  Wildcard rules that could still
  win are matched by finding their segments one after the other.  No pattern is built or
  compiled.  Used for one path per row.
* :func:`program` folds the rules into a single pattern; the engine keeps the last
  compiled pattern, so this form is used for many paths against one rule set.

Either way a hostile rule such as ``/*a*b*c*d`` costs linear time: every segment takes its
first place, in the pattern by atomic groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Declared shape of an indexed rule set.
WILD_TYPE = "struct<rank:int,deny:int,head:string,rest:string,exact:boolean,middle:array<string>,tail:string>"
INDEX_TYPE = (
    f"struct<literal:array<struct<head:string,deny:int>>,lengths:array<int>,wild:array<{WILD_TYPE}>>"
)
# Literal rules up to which a set is read through.
READ_THROUGH = 48


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\^$.|?*+()\[\]{}])", r"\\$1")


# Octets that are the same with and without their percent-encoding: letters, digits, - . _ ~
_UNRESERVED = r"^%(?:2[DdEe]|3[0-9]|4[1-9A-Fa-f]|5[0-9AaFf]|6[1-9A-Fa-f]|7[0-9AaEe])$"


def normalised(path: Column) -> Column:
    """RFC 9309 §2.2.2: one spelling of a path or pattern.

    Octets outside ASCII are percent-encoded, unreserved ones are decoded, and the hex
    digits of the others are written in capitals.
    """

    def one(piece: Column) -> Column:
        return (
            F.when(piece.rlike(_UNRESERVED), F.unhex(F.substring(piece, 2, 2)).cast("string"))
            .when(piece.rlike(r"^%[0-9A-Fa-f]{2}$"), F.upper(piece))
            .when(piece.rlike(r"^[^\x00-\x7F]"), F.url_encode(piece))
            .otherwise(piece)
        )

    pieces = F.regexp_extract_all(
        path, F.lit(r"%[0-9A-Fa-f]{2}|[^\x00-\x7F]+|[\x00-\x24\x26-\x7F]+|%"), F.lit(0)
    )
    plain = ~path.rlike(r"[^\x00-\x24\x26-\x7F]")
    return F.when(plain, path).otherwise(F.array_join(F.transform(pieces, one), ""))


def compile_rule(written: Column, allow: Column) -> Column:
    """Pattern text to ``(rank, deny, head, rest, exact, middle, tail)``; sorting gives priority order.

    ``rest`` is the pattern after the head, NULL without one; ``middle`` are the segments it
    must hold in turn, ``tail`` is what the path must end with, and ``exact`` says that nothing
    may follow the head.
    """
    return F.element_at(
        F.transform(F.array(normalised(written)), lambda p: _compiled(p, allow)), 1
    )


def _compiled(pattern: Column, allow: Column) -> Column:
    anchored = F.endswith(pattern, F.lit("$"))
    body = F.when(anchored, pattern.substr(F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    parts = F.split(body, r"\*+", -1)
    tail = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    inner = F.when(anchored, F.slice(tail, 1, F.greatest(F.size(tail) - 1, F.lit(0)))).otherwise(tail)
    middle = F.filter(inner, lambda s: s != "")
    steps = F.array_join(
        F.transform(
            middle,
            lambda s: F.concat(F.lit("(?>.*?"), _quoted(s), F.lit(")")),
        ),
        "",
    )
    closing = (
        F.when(anchored & (F.size(parts) > 1), F.concat(F.lit(".*"), _quoted(F.element_at(parts, -1)), F.lit(r"\z")))
        .when(anchored, F.lit(r"\z"))
        .otherwise(F.lit(""))
    )
    rest = F.concat(steps, closing)
    return F.struct(
        (-F.length(pattern)).alias("rank"),
        F.when(allow, 0).otherwise(1).alias("deny"),
        parts[0].alias("head"),
        F.when(rest != "", rest).alias("rest"),
        (anchored & (F.size(parts) == 1)).alias("exact"),
        middle.alias("middle"),
        F.when(anchored & (F.size(parts) > 1), F.element_at(parts, -1)).alias("tail"),
    )


def in_priority_order(rules: Column) -> Column:
    """Compiled rules, the deciding ones first; repeats dropped."""
    return F.array_sort(F.array_distinct(rules))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def index(rules: Column) -> Column:
    """Compiled rules in priority order, made ready for :func:`verdict`."""

    def build(r: Column) -> Column:
        # A rule that ends with an asterisk ranks above its head, so it counts as a wildcard rule.
        def plain(x: Column) -> Column:
            return x["rest"].isNull() & (x["rank"] == -F.length(x["head"]))

        literal = F.filter(r, plain)

        def heads(deny: int) -> Column:
            return F.transform(F.filter(literal, lambda x: x["deny"] == deny), lambda x: x["head"])

        # Of two rules with one head the allowing one counts.
        allowed, denied = F.array_distinct(heads(0)), F.array_except(heads(1), heads(0))

        def named(found: Column, deny: int) -> Column:
            return F.transform(found, lambda h: F.struct(h.alias("head"), F.lit(deny).alias("deny")))

        lengths = F.array_distinct(F.transform(literal, lambda x: F.length(x["head"])))
        return F.struct(
            F.array_sort(F.concat(named(allowed, 0), named(denied, 1))).alias("literal"),
            F.sort_array(lengths, asc=False).alias("lengths"),
            F.filter(r, lambda x: ~plain(x)).alias("wild"),
        )

    return _let(rules, build)


def _fits(path: Column, rule: Column) -> Column:
    """Does a wildcard rule match?  Each segment takes its first place after the one before."""

    def after(at: Column, segment: Column) -> Column:
        return F.nullif(F.position(segment, path, at), F.lit(0)) + F.length(segment)

    end = F.aggregate(rule["middle"], F.length(rule["head"]) + 1, after)
    left = F.length(path) + 1 - F.coalesce(F.length(rule["tail"]), F.lit(0))
    ends = F.endswith(path, F.coalesce(rule["tail"], F.lit("")))
    whole = F.when(rule["exact"], F.length(path) == F.length(rule["head"])).otherwise(
        ends & F.coalesce(end <= left, F.lit(False))
    )
    return F.startswith(path, rule["head"]) & whole


def _sought(path: Column, known: Column) -> Column:
    """The longest literal rule that begins the path, by halving; NULL without one."""
    entries = known["literal"]
    none = F.lit(None).cast("struct<head:string,deny:int>")
    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(entries) + 1)).cast("int"))

    def place(head: Column) -> Column:
        """Of the entries not before ``head`` the first one."""
        def halve(span: Column, _: Column) -> Column:
            middle = F.floor((span["lo"] + span["hi"]) / 2).cast("int")
            below = F.element_at(entries, middle)["head"] < head
            closer = F.when(below, F.struct((middle + 1).alias("lo"), span["hi"].alias("hi"))).otherwise(
                F.struct(span["lo"].alias("lo"), middle.alias("hi"))
            )
            return F.when(span["lo"] < span["hi"], closer).otherwise(span)

        whole = F.struct(F.lit(1).alias("lo"), F.size(entries).alias("hi"))
        return F.aggregate(halvings, whole, halve, lambda span: F.element_at(entries, span["lo"]))

    def longest(found: Column, length: Column) -> Column:
        head = F.left(path, length)
        hit = _let(place(head), lambda e: F.when(e["head"] == head, e))
        return F.when(found.isNotNull() | (length > F.length(path)), found).otherwise(hit)

    return F.aggregate(known["lengths"], none, longest)


def verdict(path: Column, known: Column) -> Column:
    """May ``path``, :func:`normalised`, be read under this :func:`index`?

    ``/robots.txt`` always may.
    """
    read = F.try_element_at(F.filter(known["literal"], lambda e: F.startswith(path, e["head"])), F.lit(-1))
    # In order of heads, the later of two that begin the same path is the longer.
    literal = F.when(F.size(known["literal"]) <= READ_THROUGH, read).otherwise(_sought(path, known))

    def decide(best: Column) -> Column:
        reached = F.coalesce(-F.length(best["head"]), F.lit(1))
        fitting = F.filter(known["wild"], lambda r: (r["rank"] <= reached) & _fits(path, r))
        return _let(
            F.try_element_at(fitting, F.lit(1)),
            lambda w: F.when(w.isNull(), F.coalesce(best["deny"], F.lit(0)))
            .when(w["rank"] < reached, w["deny"])
            .otherwise(F.least(w["deny"], best["deny"])),
        )

    return (path == "/robots.txt") | (_let(literal, decide) == 0)


def program(rules: Column) -> Column:
    """All rules as one pattern that consumes a denied path and nothing of an allowed one."""
    branches = F.transform(
        rules,
        lambda r: F.when(
            r["deny"] == 1,
            F.concat(_quoted(r["head"]), F.coalesce(r["rest"], F.lit("")), F.lit(".*")),
        ).otherwise(
            F.concat(F.lit("(?="), _quoted(r["head"]), F.coalesce(r["rest"], F.lit("")), F.lit(")"))
        ),
    )
    return F.concat(F.lit("(?s)^(?:"), F.array_join(branches, "|"), F.lit(")"))


def passes(path: Column, compiled: Column) -> Column:
    """Verdict of a :func:`program` for one path, :func:`normalised`."""
    return (path == "/robots.txt") | (F.call_function("regexp_extract", path, compiled, F.lit(0)) == "")
