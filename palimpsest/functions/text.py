"""Scalar text functions as Column expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest import vocabulary as V

DAY = 86400.0


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def stem(t: Column) -> Column:
    """studies -> study, works -> work; short words stay."""
    n = F.length(t)
    ies = (n > 4) & F.endswith(t, F.lit("ies"))
    return F.when(ies, F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y"))).when((n > 3) & F.endswith(t, F.lit("s")), F.substring(t, F.lit(1), n - 1)).otherwise(t)


def stems(text: Column) -> Column:
    return F.transform(tokens(text), stem)


def py_stems(text: str) -> list[str]:
    """stems() of a query on the driver."""
    out = []
    for t in re.findall("[a-z0-9]+", text.lower()):
        if len(t) > 4 and t.endswith("ies"):
            t = t[:-3] + "y"
        elif len(t) > 3 and t.endswith("s"):
            t = t[:-1]
        out.append(t)
    return out


def words(*ws: str) -> Column:
    return F.array(*[F.lit(w) for w in ws]) if ws else F.expr("cast(array() as array<string>)")


def overlap_terms(a: Column, b: Column) -> Column:
    """Distinct stems that both have."""
    return F.array_intersect(stems(a), stems(b))


def has_any(text: Column, marks: tuple[str, ...]) -> Column:
    """Some mark is a substring; a chain of searches that ends at the first hit."""
    return reduce(or_, [F.contains(text, F.lit(m)) for m in marks])


def starts_with_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(or_, [F.startswith(text, F.lit(m)) for m in prefixes])


def mentions_value(query: Column, value: Column) -> Column:
    v = F.lower(F.trim(value))
    s = stems(value)
    return (v != "") & (F.contains(F.lower(query), v) | ((F.size(s) > 0) & (F.size(F.array_except(s, stems(query))) == 0)))


def seconds_of(name: str) -> Column:
    """A timestamp column as epoch seconds; a zoneless one is UTC, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(`{name}` AS TIMESTAMP_NTZ))") / F.lit(1e6)


def utc(t: Column) -> Column:
    """Epoch seconds as a zoneless UTC timestamp."""
    return F.timestamp_add("MICROSECOND", (t * 1e6).cast("long"), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def epoch_date(t: Column) -> Column:
    return F.date_format(utc(t), "yyyy-MM-dd")


def epoch_datetime_east8(t: Column) -> Column:
    return F.date_format(utc(t + 8 * 3600), "yyyy-MM-dd HH:mm:ss")


def date_terms(t: Column) -> Column:
    """'2024-05-03 2024 05 may'."""
    d = utc(t)
    return F.concat_ws(" ", epoch_date(t), F.date_format(d, "yyyy"), F.date_format(d, "MM"), F.element_at(words(*V.MONTHS), F.month(d)))


def recency(delta: Column, tau_days: float) -> Column:
    return F.exp(-F.greatest(delta, F.lit(0.0)) / F.lit(tau_days * DAY)) if tau_days > 0 else F.lit(1.0)


def fact_text(subject: Column, predicate: Column, obj: Column) -> Column:
    return F.trim(F.concat_ws(" ", subject, F.replace(predicate, F.lit("_"), F.lit(" ")), obj))


def normal_predicate(p: Column) -> Column:
    """Lower case with blanks, hyphens and slashes as single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(p)), "[-/]", " "), r"\s+", "_")


def redact_secrets(text: Column) -> Column:
    for shape in V.SECRET_SHAPES:
        text = F.regexp_replace(text, shape, V.REDACTED)
    return F.regexp_replace(text, "(?i)" + V.SECRET_ASSIGNMENT, "$1" + V.REDACTED)


def haystack(predicate: Column, obj: Column, text: Column) -> Column:
    """What the rules of category and sensitivity search; make it a column where both are asked for."""
    return F.lower(F.concat_ws(" ", F.lower(predicate), obj, text))


def category(predicate: Column, obj: Column, text: Column, hay: Column | None = None) -> Column:
    hay = haystack(predicate, obj, text) if hay is None else hay
    out = F.lit(V.OTHER)
    for name, marks in reversed(V.CATEGORIES):
        out = F.when(has_any(hay, marks), F.lit(name)).otherwise(out)
    return out


def sensitive(predicate: Column, obj: Column, text: Column, hay: Column | None = None) -> Column:
    hay = haystack(predicate, obj, text) if hay is None else hay
    return F.lower(predicate).isin(*V.SENSITIVE_PREDICATES) | has_any(hay, V.SENSITIVE_WORDS) | F.rlike(obj, F.lit(r"\b\d{6,}\b"))


def single_valued(predicate: Column) -> Column:
    p = F.lower(predicate)
    return ~(p.isin(*V.MULTI_VALUED) | F.exists(words(*V.MULTI_VALUED), lambda m: F.startswith(p, F.concat(m, F.lit("_")))))


def durable(predicate: Column) -> Column:
    p = F.lower(predicate)
    return p.isin(*V.DURABLE) | F.startswith(p, F.lit("favorite"))


def polarity(predicate: Column) -> Column:
    """like, dislike or null, as conflict resolution sees it."""
    p = F.lower(predicate)
    like = p.isin(*V.LIKE_PREDICATES) | starts_with_any(p, V.LIKE_PREFIXES)
    dislike = p.isin(*V.DISLIKE_PREDICATES) | starts_with_any(p, V.DISLIKE_PREFIXES)
    return F.when(like, "like").when(dislike, "dislike")


def profile_polarity(predicate: Column) -> Column:
    p = F.lower(predicate)
    like = p.isin(*V.PROFILE_LIKE) | starts_with_any(p, V.PROFILE_LIKE_PREFIXES)
    dislike = p.isin(*V.PROFILE_DISLIKE) | starts_with_any(p, V.PROFILE_DISLIKE_PREFIXES)
    return F.when(p.isin(*V.PROFILE_DIET), "diet").when(like, "like").when(dislike, "dislike")


def habit(predicate: Column) -> Column:
    p = F.lower(predicate)
    return p.isin(*V.HABITS) | starts_with_any(p, tuple(h + "_" for h in V.HABITS))


def preference_group(predicate: Column, obj: Column) -> Column:
    p = F.lower(predicate)
    tail = F.when(p.rlike("^favou?rite_"), F.regexp_extract(p, "^[^_]*_(.*)$", 1))
    hay = F.concat_ws(" ", p, F.lower(obj))
    out = F.lit(V.OTHER)
    for name, marks in reversed(V.PREFERENCE_GROUPS):
        out = F.when(has_any(hay, marks), F.lit(name)).otherwise(out)
    for name, marks in reversed(V.PREFERENCE_GROUPS):
        out = F.when(has_any(F.coalesce(tail, F.lit("")), marks), F.lit(name)).otherwise(out)
    return out


def procedural(predicate: Column) -> Column:
    p = F.lower(predicate)
    return p.isin(*V.PROCEDURE_PREDICATES) | starts_with_any(p, V.PROCEDURE_PREFIXES)


def ephemeral(content: Column) -> Column:
    return has_any(F.lower(content), V.EPHEMERAL_MARKS)


def predicate_aliases(predicate: Column) -> Column:
    """Other words for a predicate, or nothing."""
    found = F.lit("")
    for names, more in V.PREDICATE_ALIASES:
        found = F.when(F.lower(predicate).isin(*names), F.lit(more)).otherwise(found)
    return found


def looks_abstaining(answer: Column, more: bool = False) -> Column:
    return has_any(F.lower(answer), V.ABSTENTION_MARKS + (V.MORE_ABSTENTION_MARKS if more else ()))


def asks_count(question: Column) -> Column:
    return has_any(F.lower(question), V.COUNT_QUESTIONS)


def asks_advice(question: Column) -> Column:
    return has_any(F.lower(question), V.ADVICE_QUESTIONS)


def chosen_letter(raw: Column) -> Column:
    """0 to 3 for the first of A to D in a model's reply, in any case; -1 if there is none."""
    letter = F.regexp_extract(F.upper(raw), "[ABCD]", 0)
    return F.when(letter == "", -1).otherwise(F.ascii(letter) - 65)


def says_yes(raw: Column) -> Column:
    """A judge's verdict: it begins with y, or yes stands within its first five characters."""
    v = F.lower(F.trim(raw))
    return F.startswith(v, F.lit("y")) | F.contains(F.left(v, F.lit(5)), F.lit("yes"))


def type_weight(predicate: Column, preference: float = 1.25, identity: float = 1.15) -> Column:
    p = F.lower(predicate)
    return (
        F.when(p.isin(*V.PREFERENCE_PREDICATES) | F.startswith(p, F.lit("favorite")), F.lit(preference))
        .when(p.isin(*V.IDENTITY_PREDICATES), F.lit(identity))
        .otherwise(F.lit(1.0))
    )


def answer_type(query: str) -> str | None:
    """The kind of answer a question asks for; ASCII cues match whole words."""
    q = query.lower()
    for kind, cues in V.ANSWER_CUES.items():
        for c in cues:
            if re.search(rf"\b{re.escape(c)}\b", q) if c.isascii() else c in q:
                return kind
    return None


def of_answer_type(obj: Column, kind: str) -> Column:
    shape = F.rlike(F.lower(obj) if kind == "date" else obj, F.lit(V.ANSWER_SHAPES[kind]))
    return shape & (F.length(F.trim(obj)) <= 40) & ~F.contains(F.trim(obj), F.lit(" ")) if kind == "id" else shape


def tokens_cjk(text: Column) -> Column:
    """One token for each CJK character and each run of letters and digits."""
    cjk = F.size(F.regexp_extract_all(text, F.lit("[一-鿿]"), F.lit(0)))
    rest = F.regexp_replace(text, "[一-鿿]", " ")
    return cjk + F.size(F.regexp_extract_all(rest, F.lit("[A-Za-z0-9]+"), F.lit(0)))


def tokens_by_chars(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4))


def sentences(text: Column) -> Column:
    """Parts ended by . ! ? and blanks, or by line ends; trimmed, none empty."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def best_snippet(text: Column, needle: Column, most: int = 360) -> Column:
    """The first of the sentences that share most stems with the needle, cut to ``most``."""
    q = stems(needle)
    scored = F.transform(sentences(text), lambda s, i: F.struct(F.size(F.array_intersect(stems(s), q)).alias("n"), (-i).alias("i"), s.alias("s")))
    return F.left(F.array_max(scored)["s"], F.lit(most))


def duration_seconds(value: Column) -> Column:
    """'7d', '12h', '30m' or bare seconds; null for anything else."""
    v = F.trim(value)
    unit = F.lower(F.right(v, F.lit(1)))
    factor = F.when(unit == "d", 86400).when(unit == "h", 3600).when(unit == "m", 60)
    body = F.when(factor.isNotNull(), F.left(v, F.length(v) - 1)).otherwise(v)
    return (body.try_cast("double") * F.coalesce(factor, F.lit(1))).cast("long")


def to_epoch(value: Column) -> Column:
    """Seconds from a number (in s, ms, us or ns), ISO text, or a Y-M-D somewhere; null for junk."""
    s = F.trim(value)
    n = s.try_cast("double")
    for _ in range(3):
        n = F.when(n > 1e12, n / 1000).otherwise(n)
    iso = F.unix_micros(F.try_to_timestamp(F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)"), s))) / F.lit(1e6)
    part = lambda i: F.regexp_extract(s, r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})", i).try_cast("int")
    day = F.try_to_date(F.format_string("%04d-%02d-%02d", part(1), part(2), part(3)), "yyyy-MM-dd")
    loose = F.unix_seconds(day.cast("timestamp")).cast("double")
    return F.coalesce(n, iso, loose)


def fingerprint(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *parts))


def outcome_parts(text: Column) -> Column:
    """struct(statement, why) of an outcome's stored text."""
    cut = F.instr(text, " （依据：")
    why = F.trim(F.regexp_replace(F.regexp_replace(F.substring(text, cut + 5, F.length(text)), r"^\s+|\s+$", ""), "）$", ""))
    return F.struct(F.trim(F.when(cut > 0, F.substring(text, F.lit(1), cut - 1)).otherwise(text)).alias("statement"), F.when(cut > 0, why).otherwise(F.lit("")).alias("why"))


def document_kind(head: Column, filename: Column, content_type: Column) -> Column:
    """image, pdf, docx or text, from content type, extension or the first bytes (as hex)."""
    ct, ext = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"(\.[^./\\]*)$", 1))
    image = F.startswith(ct, F.lit("image/")) | ext.isin(".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp") | head.rlike("^(89504E47|FFD8FF)")
    pdf = (ct == "application/pdf") | (ext == ".pdf") | head.rlike("^25504446")
    docx = (ext == ".docx") | F.contains(ct, F.lit("officedocument.wordprocessing"))
    return F.when(image, "image").when(pdf, "pdf").when(docx, "docx").otherwise("text")


def extract_answer(text: Column) -> Column:
    """What stands on the line after the last 'ANSWER:', or the whole."""
    last = F.trim(F.regexp_extract(text, r"(?is)^.*\banswer\s*:\s*([^\n]*)", 1))
    return F.trim(F.when(last != "", last).otherwise(text))


def answer_in_context(context: Column, gold: Column) -> Column:
    """The whole gold answer, or four fifths of its tokens of over three letters, stand in the context."""
    c, g = F.lower(context), F.lower(F.trim(gold))
    toks = F.filter(tokens(gold), lambda t: F.length(t) > 3)
    hits = F.filter(toks, lambda t: F.contains(c, t))
    return (g != "") & (F.contains(c, g) | ((F.size(toks) > 0) & (F.size(hits) / F.size(toks) >= 0.8)))


def display(subject: Column, predicate: Column, obj: Column, text: Column) -> Column:
    """A fact as its user would read it: by template where there is Chinese in it, else its text."""
    p = F.lower(predicate)
    han = F.rlike(F.concat_ws("", subject, obj, text), F.lit("[一-鿿]"))
    shapes = F.create_map(*[F.lit(x) for kv in V.DISPLAY.items() for x in kv])
    tails = F.create_map(*[F.lit(x) for kv in V.FAVOURITES.items() for x in kv])
    tail = F.regexp_extract(p, "^favou?rite_(.*)$", 1)
    body = (
        F.when(F.element_at(shapes, p).isNotNull(), F.replace(F.element_at(shapes, p), F.lit("{o}"), obj))
        .when(tail != "", F.concat(F.lit("最喜欢的"), F.coalesce(F.element_at(tails, tail), tail), F.lit("是 "), obj))
        .when(F.startswith(p, F.lit("likes_")), F.concat(F.lit("喜欢 "), obj))
        .otherwise(F.concat(F.replace(predicate, F.lit("_"), F.lit(" ")), F.lit(" "), obj))
    )
    chinese = F.when(F.lower(subject).isin(*V.DISPLAY_SELF), body).otherwise(F.concat(subject, body))
    return F.when(han, chinese).otherwise(F.coalesce(F.nullif(text, F.lit("")), fact_text(subject, predicate, obj)))
