"""Text, code and state functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and the plain letters that they become.
ACCENTED = "ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿÇçÑñ"
PLAIN = "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuYyyCcNn"


def exact_label(c: Column) -> Column:
    """Upper case without accents; everything but letters and digits becomes one space."""
    return F.trim(F.regexp_replace(F.upper(F.translate(c, ACCENTED, PLAIN)), "[^A-Z0-9]+", " "))


def compact_label(c: Column) -> Column:
    """Lower-case letters and digits only, without accents."""
    return F.regexp_replace(F.lower(F.translate(c, ACCENTED, PLAIN)), "[^a-z0-9]+", "")


def code(c: Column, width: int) -> Column:
    """Zero-padded code of ASCII digits; null if it is not one or is too long."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(f"^[0-9]{{1,{width}}}$"), F.lpad(t, width, "0"))


def clean(c: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    t = F.trim(c)
    return F.when(F.length(t) > 0, t)


def localized_integer(c: Column) -> Column:
    """Integer with dots or spaces between thousands, else null."""
    t = F.trim(c)
    ok = t.rlike(r"^[0-9]{1,3}([. ][0-9]{3})*$") | t.rlike(r"^[0-9]+$")
    return F.when(ok, F.regexp_replace(t, "[. ]", "").cast("bigint"))


def localized_percentage(c: Column) -> Column:
    """Percentage with a decimal comma or point and perhaps a sign, 0 to 100, as decimal(9,4), else null."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), r"\s*%$", ""), ",", ".")
    v = F.when(t.rlike(r"^[0-9]{1,3}(\.[0-9]+)?$"), t.cast("decimal(9,4)"))
    return F.when(v.between(0, 100), v)


def unit_id(*parts: Column) -> Column:
    """Parts joined by ":", null unless each is a code of letters and digits."""
    ok = F.lit(True)
    for p in parts:
        ok = ok & p.rlike("^[0-9A-Za-z]+$")
    return F.when(ok, F.concat_ws(":", *parts))


def scope_code_ok(c: Column, widths: dict[str, int], level: Column) -> Column:
    """True if a code is digits of its level's width."""
    width = F.create_map(*[F.lit(x) for kv in widths.items() for x in kv])[level]
    return F.coalesce(c.rlike("^[0-9]+$") & (F.length(c) == width), F.lit(False))


def is_placeholder(c: Column) -> Column:
    """True for labels made up because the source has none."""
    return c.startswith("official-")


def placeholder(kind: str, c: Column) -> Column:
    return F.concat(F.lit(f"official-{kind}-code-"), c)


def csv_safe(c: Column) -> Column:
    """Text that a spreadsheet would read as a formula gets a quote in front."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


# Patterns of personal data.
PERSONAL = {
    "email": r"(?i)[a-z0-9._%+-]+@[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}",
    "phone": r"(\+?[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-]?[0-9]{4}",
    "id_document": r"(?i)\b(cc|c\.c\.|cedula|passport|ssn)[ :#-]*[0-9]{6,10}\b",
}


def personal_findings(c: Column) -> Column:
    """Names of the PERSONAL patterns found in a text, in order."""
    names = [F.when(c.rlike(p), F.lit(n)) for n, p in PERSONAL.items()]
    return F.array_compact(F.array(*names))


def host(c: Column) -> Column:
    """Lower-case host of a URL, null if it has none."""
    return F.lower(F.nullif(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)", 1), F.lit("")))


def https_ok(c: Column, hosts: list[str]) -> Column:
    """True for https URLs of an allowed host."""
    return F.coalesce(c.startswith("https://") & host(c).isin(hosts), F.lit(False))


def urls(c: Column) -> Column:
    """All http(s) URLs written in a text."""
    return F.regexp_extract_all(c, F.lit(r"(https?://[^\s\"'<>\\]+)"), F.lit(1))


def is_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike("^[a-f0-9]{64}$"), F.lit(False))


def zoned_timestamp(c: Column) -> Column:
    """Timestamp of a text that names its zone; null otherwise."""
    return F.when(c.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(c))


def value_state(c: Column) -> Column:
    """State of a published value: unavailable, unknown or observed; null for text that is none of them."""
    t = F.lower(F.trim(c))
    return (
        F.when(c.isNull() | t.isin("", "n/a", "n.a.", "na", "-"), "unavailable")
        .when(t.isin("pendiente", "pending", "unknown", "desconocido"), "unknown")
        .when(localized_integer(c).isNotNull(), "observed")
    )


def zero_sentinel(registered: Column, voters: Column) -> Column:
    """State of a registered count: zero while there are voters is unavailable."""
    return F.when(registered.isNull() | ((registered == 0) & (voters > 0)), "unavailable").otherwise("observed")


def combined(a: str, b: str) -> tuple[Column, Column]:
    """(value, state) of the sum of two stateful metrics: observed if both are, else the worse state."""
    x, y = F.col(f"{a}_status"), F.col(f"{b}_status")
    both = (x == "observed") & (y == "observed")
    worse = F.lit("not_applicable")
    for state in ("unknown", "unavailable"):
        worse = F.when((x == state) | (y == state), state).otherwise(worse)
    return F.when(both, F.col(a) + F.col(b)), F.when(both, "observed").otherwise(worse)


def size_band(n: Column) -> Column:
    return F.when(n <= 2, "1-2").when(n <= 5, "3-5").when(n <= 10, "6-10").when(n <= 20, "11-20").otherwise("21+")


def band(x: Column, cuts: list[float]) -> Column:
    """Half-open bands [a, b) by ascending cuts, as text; the first and last are open."""
    out = F.when(x < cuts[0], f"<{cuts[0]:g}")
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out = out.when((x >= a) & (x < b), f"{a:g}-{b:g}")
    return out.when(x >= cuts[-1], f">={cuts[-1]:g}")


def tier(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 45, "medium").when(score >= 15, "low").otherwise("none")


def ancestors(id_: Column, kind: str = "place") -> Column:
    """Ancestor ids, coarsest first and itself last, of an id "round:kind:a:b:c": all beginnings of its codes."""
    parts = F.split(id_, ":")
    codes = F.slice(parts, 3, F.size(parts) - 2)
    return F.transform(F.sequence(F.lit(1), F.size(codes)), lambda n: F.concat_ws(":", F.element_at(parts, 1), F.lit(kind), F.array_join(F.slice(codes, 1, n), ":")))


def family_id(*parts: Column) -> Column:
    return F.concat_ws("|", *[p.cast("string") for p in parts])


def category_key(party: Column, category: Column) -> Column:
    return F.concat_ws(":", party.cast("string"), category.cast("string"))


def stable(x: Column) -> Column:
    """Rounded to 15 digits after the point."""
    return F.round(x, 15)


def delta(a: Column, b: Column) -> Column:
    """b - a, null if either is."""
    return b - a


def numerator(metric: Column) -> Column:
    """Numerator of a rate metric among columns ballots, registered, votes, valid, blank, null_unmarked."""
    return F.when(metric == "turnout", F.col("ballots")).when(metric == "candidate_share", F.col("votes")).when(metric == "blank", F.col("blank")).when(metric == "null_unmarked", F.col("null_unmarked"))


def denominator(metric: Column) -> Column:
    return F.when(metric == "turnout", F.col("registered")).when(metric.isin("candidate_share", "blank"), F.col("valid")).when(metric == "null_unmarked", F.col("ballots"))


def coverage_ok(expected: Column, retrieved: Column, parsed: Column, missing: Column, ambiguous: Column, excluded: Column) -> Column:
    """Counters of one plan agree: expected splits into retrieved, missing and excluded; parsed and ambiguous are retrieved."""
    return F.coalesce((retrieved + missing + excluded == expected) & (parsed + ambiguous <= retrieved), F.lit(False))


def map_value(values: Column, field: str) -> tuple[Column, Column]:
    """(value, whether the key is there) of a map column."""
    return F.try_element_at(values, F.lit(field)), F.map_contains_key(values, field)


def dated(round_: Column, dates: dict[int, str]) -> Column:
    """Date of a round."""
    return F.create_map(*[x for k, v in dates.items() for x in (F.lit(k), F.to_date(F.lit(v)))])[round_]


def unknown_keys(payload: Column, allowed: list[str]) -> Column:
    """Top-level keys of a JSON object that are not allowed, sorted; null if it is no object."""
    return F.array_sort(F.array_except(F.json_object_keys(payload), F.array(*[F.lit(k) for k in allowed]).cast("array<string>")))


def payload_class(payload: Column, allowed: list[str], required: list[str]) -> Column:
    keys = F.json_object_keys(payload)
    has = F.size(F.array_except(F.array(*[F.lit(k) for k in required]).cast("array<string>"), keys)) == 0
    return F.when(keys.isNull(), "not_an_object").when(~has, "incomplete").when(F.size(unknown_keys(payload, allowed)) > 0, "extended").otherwise("expected")


def metric_object(metrics: dict[str, Column | None]) -> Column:
    """JSON object of metrics in the order given: value and status; a metric that no column gives is unavailable."""
    none = F.lit(None).cast("bigint")
    one = lambda v: F.struct(v.cast("bigint").alias("value"), F.when(v.isNull(), "unavailable").otherwise("observed").alias("status"))
    return F.to_json(F.struct(*[one(none if v is None else v).alias(m) for m, v in metrics.items()]), {"ignoreNullFields": "false"})


def metric_value(raw: Column, metric: str) -> Column:
    """A metric's value in such an object; null if it is null, absent or no integer."""
    return F.get_json_object(raw, f"$['{metric}'].value").try_cast("bigint")


def metric_status(raw: Column, metric: str) -> Column:
    return F.get_json_object(raw, f"$['{metric}'].status")
