"""Raw extraction payloads repaired as VARIANT: parsed once, rebuilt by expressions, without a Python worker.

An object is handled as a map of its fields, a list as an array, and both are written back as VARIANT. Fields are in the order
of their names, so "the first" of several fields of an object that qualify is the first by name. These expressions are
interpreted, so known fields are taken out in one cast (parts) rather than looked up by name, and what is used twice is bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.columns import spare
from folioforge.functions.text import bind, strip

from .repair import DEFAULTS, DROPPED, EVIDENCE, GUESSES, LISTS, NAMES, SKILL_NAMES, TEXT_KEYS
from .timeline import MONTHS

FIELDS, LIST = "map<string,variant>", "array<variant>"
#: Collections that a payload does not keep, flags of a current entry, words for the present. Fixed values.
GONE = ("honorsAwards", "languageProficiencies", "quantifiedAchievements")
FLAGS = ("current", "ongoing", "currentlyWorking")
NUMBERS = "^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"
PRESENT = r"(?iU)\b(?:present|current|now|ongoing|hiện tại)\b"
REPEATED_NULLS = r"(?:null[\s,]*){8}"
ENTITIES = {"experiences": ("jobTitle", "company"), "projects": ("title", "role"), "education": ("institution", "degree")}
_NAMED = r"\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?\s*,?\s*(?:19|20)\d\d\b"
_NUMBERED = r"\b(?:0?[1-9]|1[0-2])\s*[./-]\s*(?:19|20)\d\d\b"
_VIETNAMESE = r"th[áa]ng\s*(?:0?[1-9]|1[0-2])\s*(?:n[ăa]m\s*)?(?:19|20)\d\d"


# ---- single values


def kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def fields(v: Column) -> Column:
    """An object's fields; null for anything else."""
    return F.try_variant_get(v, "$", FIELDS)


def items(v: Column) -> Column:
    """A list's items; null for anything else."""
    return F.try_variant_get(v, "$", LIST)


def told(v: Column) -> Column:
    """A text; null for anything else."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def parts(*names: str) -> str:
    """The type of an object's fields of these names, as they are; one that is not there is null, JSON's null is not."""
    return f"struct<{','.join(f'{n}:variant' for n in dict.fromkeys(names))}>"


def number(v: Column) -> Column:
    """A number as it is; null for anything else, true and false included."""
    return F.when(F.regexp_like(kind(v), F.lit(NUMBERS)), v)


def field(m: Column, name: str) -> Column:
    return F.try_element_at(m, F.lit(name))


def none() -> Column:
    """JSON's null."""
    return F.parse_json(F.lit("null"))


def truly(v: Column) -> Column:
    """True, a number other than 0, a text, list or object that is not empty."""
    some = lambda: F.coalesce(told(v) != "", F.array_size(items(v)) > 0, F.array_size(F.map_keys(fields(v))) > 0, F.try_variant_get(number(v), "$", "double") != 0)
    return F.when(v.isNull(), F.lit(False)).otherwise(F.coalesce(F.when(kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).otherwise(some()), F.lit(False)))


def repaired_date(value: Column, is_end: Column) -> Column:
    """The first day of the month that a loosely written date names; the earliest for starts, the latest for ends.

    Present words of an end give null; text without a year stays as it is; a day is always lost.
    """

    def settled(t: Column) -> Column:
        every = F.regexp_extract_all(t, F.lit(f"(?iU){_NAMED}|{_NUMBERED}|{_VIETNAMESE}"), F.lit(0))
        years = F.regexp_extract_all(t, F.lit(r"(?U)\b(?:19|20)\d\d\b"), F.lit(0))

        def month(x: Column) -> Column:
            named = F.position(F.lower(F.substring(x, 1, 3)), F.lit("".join(MONTHS)))
            digits = F.regexp_extract(x, r"(?U)^\D*(\d{1,2})", 1)
            return F.when(F.regexp_like(x, F.lit(rf"(?iU)^(?:{_NAMED})$")), F.lpad(((named + 2) / 3).cast("int").cast("string"), 2, "0")).otherwise(F.lpad(digits, 2, "0"))

        of = lambda found: F.when(is_end, F.element_at(found, -1)).otherwise(F.element_at(found, 1))
        first = F.regexp_extract(t, r"(?U)\b(0?[1-9]|1[0-2])\b", 1)

        def by_year(y: Column) -> Column:
            month = bind(first, lambda x: F.when(x == "", "01").otherwise(F.lpad(x, 2, "0")))
            return F.when(F.size(y) > 1, F.concat(of(y), F.lit("-01-01"))).when(F.size(y) == 1, F.concat(y[0], F.lit("-"), month, F.lit("-01"))).otherwise(value)

        dated = lambda x: F.concat(F.right(x, F.lit(4)), F.lit("-"), month(x), F.lit("-01"))
        return bind(every, lambda e: F.when(F.size(e) > 0, bind(of(e), dated)).otherwise(bind(years, by_year)))

    plain = F.translate(strip(value), "–—", "--")
    return F.when(value.isNotNull() & ~(is_end & F.regexp_like(value, F.lit(PRESENT))), bind(plain, settled))


def grade(v: Column) -> Column:
    """Fields value and scale of a number, a text like 2.91/4 or an object; null where no number is."""
    named = {"value": ("value", "score", "gpa"), "scale": ("scale", "maxScore", "outOf")}

    def written(n: Column) -> Column:
        return F.when(F.size(n) > 1, F.create_map(F.lit("value"), n[0], F.lit("scale"), n[1])).when(F.size(n) == 1, F.create_map(F.lit("value"), n[0]))

    def of(k: Column) -> Column:
        found = F.transform(F.regexp_extract_all(F.try_variant_get(v, "$", "string"), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double").cast("variant"))
        given = lambda m: F.map_from_entries(_there({n: number(_first(m, names)) for n, names in named.items()}))
        held = F.try_variant_get(v, "$", parts(*named["value"], *named["scale"]))
        return F.when(k == "STRING", bind(found, written)).when(F.regexp_like(k, F.lit(NUMBERS)), F.create_map(F.lit("value"), v)).otherwise(bind(held, lambda m: F.when(m.isNotNull(), given(m))))

    return bind(bind(kind(v), of), lambda g: F.when(F.size(g) > 0, g))


def _first(m: Column, names: tuple[str, ...]) -> Column:
    """The value of the first of `names` that is a field of parts(), whatever it is."""
    return F.coalesce(*(m[n] for n in names))


def _there(new: dict[str, Column]) -> Column:
    """Entries of a map, of those values that there are."""
    return F.filter(F.array(*(F.struct(F.lit(n).alias("key"), c.alias("value")) for n, c in new.items())), lambda e: e["value"].isNotNull())


def _object(v: Column, known: list[str], new: dict[str, Column]) -> Column:
    """The object `v` without its fields in `known`, which all of `new` are, and with those of `new` that there are."""
    rest = F.filter(F.map_entries(fields(v)), lambda e: ~e["key"].isin(known))
    return F.to_variant_object(F.map_from_entries(F.concat(rest, _there(new))))


def one_text(v: Column) -> Column:
    """A text as it is; of an object the first text under a telling name, else its first text; else its JSON; null for null."""

    def first(texts: Column) -> Column:
        return F.get(F.filter(texts, lambda t: t != ""), F.lit(0))

    def of(m: Column) -> Column:
        any_text = first(F.transform(F.map_values(fields(v)), told))
        return F.when(m.isNotNull(), F.coalesce(first(F.array(*(told(m[k]) for k in TEXT_KEYS))), any_text))

    other = F.coalesce(bind(F.try_variant_get(v, "$", parts(*TEXT_KEYS)), of), F.to_json(v))
    return F.coalesce(told(v), F.when(~F.is_variant_null(v), other))


def strings(v: Column) -> Column:
    """A list of texts: a text is one item, nulls are none, anything but a list has none."""
    listed = lambda a: F.filter(F.transform(a, one_text), lambda t: t.isNotNull())
    single = bind(told(v), lambda t: F.when(t.isNotNull(), F.array(t)))
    some = bind(items(v), lambda a: F.when(a.isNotNull(), listed(a)).otherwise(single))
    return F.coalesce(F.when(v.isNotNull(), some), F.array().cast("array<string>"))


def evidence(v: Column) -> Column:
    """References (text, pageNumber, blockId) that name all three."""
    named = parts(*(n for name, others in EVIDENCE.items() for n in (name, *others)))
    every = F.coalesce(F.try_variant_get(v, "$", f"array<{named}>"), F.array(F.try_variant_get(v, "$", named)))
    whole = F.transform(every, lambda m: F.struct(*(_first(m, (n, *others)).alias(n) for n, others in EVIDENCE.items())))
    return F.filter(whole, lambda m: reduce(lambda a, n: a & m[n].isNotNull(), EVIDENCE, F.lit(True)))


# ---- entries


def _dates(r: Column) -> Column:
    """startDate, endDate and isCurrent of an entry's parts, as a struct; null for a field that it does not get."""
    start, end = r["startDate"], r["endDate"]
    yes = F.lit(True).cast("variant")
    says = lambda t: F.coalesce(F.regexp_like(t, F.lit(PRESENT)), F.lit(False))

    def read(t: Column) -> Column:
        flags = [F.when(kind(r[f]) == "BOOLEAN", r[f]).when(says(told(r[f])), yes) for f in reversed(FLAGS)]
        day = lambda v, said, is_end: F.when(said.isNotNull(), F.coalesce(repaired_date(said, F.lit(is_end)).cast("variant"), none())).otherwise(v)
        current = F.coalesce(*flags, F.when(says(t["start"]) | says(t["end"]), yes), r["isCurrent"])
        return F.struct(day(start, t["start"], False).alias("start"), day(end, t["end"], True).alias("end"), current.alias("current"))

    def closed(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), F.when(truly(x["current"]), none()).otherwise(x["end"]).alias("end"), x["current"].alias("current"))

    def settled(x: Column) -> Column:
        a, b = (F.try_variant_get(x[c], "$", "string") for c in ("start", "end"))
        put = lambda s, e: F.struct(s.alias("startDate"), e.alias("endDate"), x["current"].alias("isCurrent"))
        return F.when((b < a) & truly(x["start"]) & truly(x["end"]), put(x["end"], x["start"])).otherwise(put(x["start"], x["end"]))

    texts = F.struct(told(start).alias("start"), told(end).alias("end"))
    return bind(bind(bind(texts, read), closed), settled)


def entity(of: str, v: Column) -> Column:
    """One entry repaired: names, defaults, lists, dates, grades, references. What is no object stays as it is."""
    names, dated = NAMES[of], ("startDate", "endDate", "isCurrent")
    others = [o for every in names.values() for o in every]

    def rebuilt(r: Column) -> Column:
        at = lambda name: _first(r, (name, *names.get(name, ())))
        filled = lambda name, default: bind(at(name), lambda x: F.when(told(x) != "", x).otherwise(default.cast("variant")))
        new = {n: at(n) for n in names} | {n: F.to_variant_object(strings(at(n))) for n in LISTS[of]}
        if of == "experiences":
            words = F.lower(F.concat(F.array_join(strings(r["description"]), " "), F.lit(" "), F.coalesce(told(at("company")), F.lit(""))))
            guess = bind(words, lambda w: reduce(lambda c, g: c.when(F.contains(w, F.lit(g[0])), g[1]), GUESSES[1:-1], F.when(F.contains(w, F.lit(GUESSES[0][0])), GUESSES[0][1])).otherwise(GUESSES[-1][1]))
            new["jobTitle"] = filled("jobTitle", guess)
        else:
            name, default = DEFAULTS[of]
            new[name] = filled(name, F.lit(default))
        if of == "education":
            details = told(r["details"])
            courses = F.when(at("coursework").isNull() & details.isNotNull(), F.array(details)).otherwise(strings(at("coursework")))
            new["coursework"] = F.to_variant_object(courses)
        if of == "projects":
            url = r["url"]
            first = F.try_variant_get(F.get(items(url), F.lit(0)), "$", "string")
            empty = F.is_variant_null(url) | (told(url) == "") | (F.size(items(url)) == 0)
            new["url"] = F.when(F.coalesce(empty, F.lit(False)), url).otherwise(F.when(items(url).isNotNull(), first).otherwise(one_text(url)).cast("variant"))
        new["gpa"] = F.when(r["gpa"].isNotNull(), F.coalesce(F.to_variant_object(grade(r["gpa"])), F.when(items(r["gpa"]).isNotNull(), r["gpa"]), none()))
        new["evidence"] = F.when(r["evidence"].isNotNull(), F.to_variant_object(evidence(r["evidence"])))
        return bind(_dates(r), lambda d: _object(v, [*DROPPED[of], *others, *new, *dated, *FLAGS], new | {n: d[n] for n in dated}))

    held = parts(*names, *others, *LISTS[of], "gpa", "evidence", "url", "details", *dated, *FLAGS)
    return F.coalesce(bind(F.try_variant_get(v, "$", held), lambda r: F.when(r.isNotNull(), rebuilt(r))), v)


def skill(v: Column) -> Column:
    """A label, or an object with a name under one of its names; null for anything else."""

    def named(m: Column) -> Column:
        texts = F.array(told(m["name"]), *(strip(told(m[n])) for n in SKILL_NAMES))
        cited = F.when(m["evidence"].isNotNull(), F.to_variant_object(evidence(m["evidence"])))
        made = lambda name: F.when(name.isNotNull(), _object(v, ["name", "evidence"], {"name": name.cast("variant"), "evidence": cited}))
        return bind(F.get(F.filter(texts, lambda t: t != ""), F.lit(0)), made)

    plain = lambda label: F.when(label != "", F.to_variant_object(F.struct(label.alias("name"), F.array().cast("array<string>").alias("evidence"))))
    held = F.try_variant_get(v, "$", parts("name", *SKILL_NAMES, "evidence"))
    return bind(held, lambda m: F.when(m.isNotNull(), named(m)).otherwise(bind(strip(told(v)), plain)))


def payload(m: Column) -> Column:
    """A payload's fields repaired; collections that are no lists stay as they are."""
    kept = lambda a, then: F.to_variant_object(F.filter(F.transform(a, then), lambda x: x.isNotNull() & ~F.is_variant_null(x)))
    whole = lambda v, then: bind(items(v), lambda a: F.when(a.isNotNull(), kept(a, then)))

    def cited(v: Column) -> Column:
        lists = lambda e: F.map_filter(e, lambda k, x: fields(x).isNotNull() | items(x).isNotNull())
        return F.to_variant_object(F.transform_values(lists(fields(v)), lambda k, x: F.to_variant_object(evidence(x))))

    def fixed(k: Column, v: Column) -> Column:
        every = {n: whole(v, _entity_of(n)) for n in NAMES} | {"skills": whole(v, lambda x: skill(x)), "evidence": cited(v)}
        every |= {n: F.when(items(v).isNotNull(), F.to_variant_object(strings(v))) for n in ("languages", "certifications", "urls")}
        return F.coalesce(reduce(lambda w, n: w.when(k == n, every[n]), every, F), v)

    return F.transform_values(F.map_filter(m, lambda k, _: ~k.isin(*GONE)), fixed)


def _entity_of(n: str):
    return lambda x: entity(n, x)


def unfenced(text: Column) -> Column:
    """A text without the fences at its beginning and end (three backticks, the first with "json" or without) and the blanks around them; most of it no pattern reads."""
    blank, mark = F.lit(" \t\n\x0b\f\r"), F.lit("```")
    before, after = F.substring_index(text, "```", 1), lambda t: F.substring_index(t, "```", -1)
    opened = lambda t: F.btrim(F.when(F.startswith(t, F.lit("json")), F.substring(t, 5, 1 << 30)).otherwise(t), blank)
    head = F.when(F.btrim(before, blank) == "", opened(F.substring(text, F.length(before) + 4, F.length(text)))).otherwise(text)
    tail = lambda t: F.when(F.contains(t, mark) & (F.btrim(after(t), blank) == ""), F.btrim(F.left(t, F.length(t) - F.length(after(t)) - 3), blank)).otherwise(t)
    return F.when(F.contains(text, mark), bind(head, tail)).otherwise(text)


def repair(responses: DataFrame, *, column: str = "response") -> DataFrame:
    """`responses` with repaired (VARIANT) and repair_error: EMPTY, DEGENERATE, INVALID_JSON or NOT_AN_OBJECT.

    Fences go. Row by row, so repeated rows are repaired alike; a row that cannot be read is kept with its error; an
    object that names a field twice is no valid JSON. Columns of `responses` with the new names are an error.
    """
    clash = {"repaired", "repair_error"} & {c.lower() for c in responses.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    raw, held, nulls = spare(responses, "raw", "held", "nulls")
    text = F.col(column)
    often = F.octet_length(F.replace(text, F.lit("null"), F.lit(""))) <= F.octet_length(text) - 32  # a text with fewer nulls cannot repeat them
    rows = responses.withColumn(nulls, often & F.regexp_like(text, F.lit(REPEATED_NULLS)))
    rows = rows.withColumn(raw, F.when(~F.col(nulls), F.try_parse_json(unfenced(text)))).withColumn(held, fields(F.col(raw)))
    error = F.when(text.isNull() | (strip(text) == ""), "EMPTY").when(F.col(nulls), "DEGENERATE").when(F.col(raw).isNull(), "INVALID_JSON").when(F.col(held).isNull(), "NOT_AN_OBJECT")
    fixed = F.when(error.isNull(), F.to_variant_object(payload(F.col(held))))
    return rows.select(*responses.columns, fixed.alias("repaired"), error.alias("repair_error"))


def with_dates(rows: DataFrame, value: str, is_end: str) -> DataFrame:
    """`rows` with repaired: the loosely written date of a column; `is_end` is a boolean column."""
    return rows.withColumn("repaired", repaired_date(F.col(value), F.coalesce(F.col(is_end), F.lit(False))))


def with_grades(rows: DataFrame, value: str) -> DataFrame:
    """`rows` with gpa and scale: the numbers of a loosely written grade; null where there is none."""
    (held,) = spare(rows, "grade")
    out = rows.withColumn(held, grade(F.col(value).cast("variant")))
    return out.select(*rows.columns, *(F.try_variant_get(field(F.col(held), n), "$", "double").alias(c) for n, c in (("value", "gpa"), ("scale", "scale"))))


# ---- what a payload holds


def entries(payloads: DataFrame, of: str, *keep: str, column: str = "repaired") -> DataFrame:
    """(*keep, entry from 0, value): one row for each entry of a collection; payloads without it have none."""
    return payloads.select(*keep, F.posexplode(items(field(fields(F.col(column)), of))).alias("entry", "value"))


def signatures(payload_: Column) -> Column:
    """Opaque marks of a payload's experiences and projects: kind, title, and company or role, whatever their case and blanks."""

    def of(n: str) -> Column:
        said = lambda e, f: strip(F.regexp_replace(F.lower(F.coalesce(e[f], F.lit(""))), r"(?U)\s+", " "))
        form = f"array<struct<{','.join(f'{f}:string' for f in ENTITIES[n])}>>"
        objects = F.filter(F.coalesce(F.try_variant_get(payload_, f"$.{n}", form), F.array().cast(form)), lambda e: e.isNotNull())
        return F.transform(objects, lambda e: F.substring(F.sha2(F.concat_ws("\x1f", F.lit(n), said(e, ENTITIES[n][0]), said(e, ENTITIES[n][1])), 256), 1, 16))

    return F.array_distinct(F.concat(of("experiences"), of("projects")))


def counts(payload_: Column) -> Column:
    """For each collection: entities, entities with references, references."""

    def of(n: str) -> Column:
        listed = F.coalesce(F.try_variant_get(payload_, f"$.{n}", LIST), F.array().cast(LIST))
        kept = F.filter(listed, lambda e: ~F.is_variant_null(e))
        held = F.transform(kept, lambda e: F.coalesce(F.size(evidence(F.try_variant_get(e, "$.evidence", "variant"))), F.lit(0)))
        return bind(held, lambda h: F.struct(F.size(h).alias("entities"), F.size(F.filter(h, lambda n: n > 0)).alias("with_evidence"), F.aggregate(h, F.lit(0), lambda a, n: a + n).alias("references")))

    return F.struct(*(of(n).alias(n) for n in ENTITIES))


def lost(before: Column, after: Column, *, marks: Column | None = None) -> Column:
    """Marks of entries that a first answer named and its correction no longer does; `marks`: signatures(before), if they are known."""
    return F.array_except(signatures(before) if marks is None else marks, signatures(after))
