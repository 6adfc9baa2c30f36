"""Requests, formulas and texts: validation, parsing and grading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.arrays import ELEMENTS, all_or_none

SPECTRAL = ("hsqc", "c_nmr", "h_nmr", "mass_spec")
#: Symbols that a formula may hold beyond the vector's own, fixed values.
MORE_ELEMENTS = "He Li Be Ne Ar Sc Ti Mn Ge Kr Rb Y Zr Nb Tc Rh Pd Ag Cd In Xe Cs Ba La Ce Pr Nd Pm Sm Eu Tb Dy Er Tm Yb Lu Hf Ta Re Os Ir Pt Hg Tl Po At Rn Fr Ra Ac Th Pa U Np Pu".split()
#: Seconds of a rate's periods.
PERIODS = {"second": 1, "minute": 60, "hour": 3600}


def request_error(hsqc: Column, mass_spec: Column, lo: Column, hi: Column) -> Column:
    """What is wrong with a request, null if nothing: triplets and pairs whole, shifts known, signs all or none, bounds in order, some spectrum."""
    groups = (F.size(hsqc) / 3).cast("int")
    shifts = F.exists(F.transform(hsqc, lambda x, i: x.isNull() & (i % 3 != 2)), lambda x: x)
    signs = F.transform(F.sequence(F.lit(0), F.greatest(groups - 1, F.lit(0))), lambda i: hsqc[i * 3 + 2].isNull())
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return (
        F.when(none(hsqc) & none(mass_spec), "no spectrum")
        .when(~none(hsqc) & (F.size(hsqc) % 3 != 0), "hsqc not in triplets")
        .when(~none(hsqc) & shifts, "hsqc shift missing")
        .when(~none(hsqc) & ~all_or_none(signs), "hsqc signs incomplete")
        .when(~none(mass_spec) & (F.size(mass_spec) % 2 != 0), "mass spectrum not in pairs")
        .when(F.coalesce(lo > hi, F.lit(False)), "range reversed")
    )


def bound_error(lo: Column, hi: Column) -> Column:
    """What is wrong with one element's bounds, null if nothing."""
    return F.when(lo.isNull() & hi.isNull(), "needs a min or a max").when(F.coalesce(lo > hi, F.lit(False)), "min exceeds max")


def formula_error(c: str) -> Column:
    """What is wrong with a formula, null if nothing; blank is fine."""
    text = F.trim(F.coalesce(F.col(c), F.lit("")))
    symbols = F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]?)"), F.lit(1))
    unknown = F.array_except(symbols, F.array(*[F.lit(e) for e in [*ELEMENTS, *MORE_ELEMENTS]]))
    return F.when(text == "", None).when(~text.rlike(r"^([A-Z][a-z]?\d*)+$"), "not a formula").when(F.size(unknown) > 0, F.concat(F.lit("unknown element "), F.try_element_at(unknown, F.lit(1))))


def exchangeable(label: str) -> Column:
    """Whether a proton's label names an exchangeable group; blanks and case don't count."""
    return F.upper(F.replace(F.col(label), F.lit(" "), F.lit(""))).rlike("OH|NH|COOH|CO2H")


def rate_spec(c: str) -> Column:
    """'30 per minute' -> struct<hits, seconds>; malformed: null."""
    shape = r"(?i)^\s*(\d+)\s*per\s*(second|minute|hour)\s*$"
    period = F.lower(F.regexp_extract(c, shape, 2))
    seconds = F.create_map(*[F.lit(x) for kv in PERIODS.items() for x in kv])
    return F.when(F.col(c).rlike(shape), F.struct(F.regexp_extract(c, shape, 1).try_cast("int").alias("hits"), F.try_element_at(seconds, period).alias("seconds")))


def paper_kind(c: str) -> Column:
    """Whether a text reports spectra: two mentions of the method and 80 shift-like numbers at least."""
    methods = F.regexp_count(c, F.lit(r"(?i)(\b1\s*H|\b13\s*C|¹\s*H|¹³\s*C)\s*[-–]?\s*NMR"))
    shifts = F.regexp_count(c, F.lit(r"\b\d{1,3}\.\d{1,2}\b"))
    return F.when((methods >= 2) & (shifts >= 80), "spectra").otherwise("no spectra")


def plain_text(html: str) -> Column:
    """Markup stripped, references decoded (once), white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):  # the last one decodes what stands behind it
        bare = F.replace(bare, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def subscripted(c: str) -> Column:
    return F.translate(c, "0123456789", "₀₁₂₃₄₅₆₇₈₉")


def unsubscripted(c) -> Column:
    return F.translate(c, "₀₁₂₃₄₅₆₇₈₉", "0123456789")


def first_link(links: list[tuple[str, Column]]) -> Column:
    """The first template whose id is there, filled in; none: null."""
    return F.coalesce(*[F.when(F.coalesce(i, F.lit("")) != "", F.concat(F.lit(before), i)) for before, i in links])


def guard(mae: Column, limit: float, trust: float, charged: Column) -> Column:
    """Bucket of a fallback decision: null within the limit, else why the row was kept or that it fell back."""
    return F.when(mae > limit, F.when(charged, "kept_charged").when(mae > trust, "kept_mae_gt_trust").otherwise("fell_back"))


def guard_reason(bucket: Column, status: Column, absent: Column, cover: Column, least: float) -> Column:
    """Why a row's spectrum is not used, null if it is."""
    return F.when(bucket == "fell_back", "mae").when(status != "ok", F.concat(F.lit("hsqc_"), status)).when(absent, "absent").when(cover < least, "low_c_coverage")


def card(html: str) -> Column:
    """struct<name, smiles, dois, spectra> of a compound's HTML card: heading, structure, sorted references, kinds of spectra listed."""
    one = lambda pattern: F.nullif(F.trim(F.regexp_extract(html, pattern, 1)), F.lit(""))
    dois = F.transform(F.regexp_extract_all(html, F.lit(r"doi\.org/(10\.\d{4,9}/[^\s\"'<>]+)"), F.lit(1)), lambda d: F.regexp_replace(d, r"[.,;]+$", ""))
    kinds = F.regexp_extract_all(html, F.lit(r"(?i)<li[^>]*>\s*(1H|13C|HSQC|MS)\b"), F.lit(1))
    return F.struct(one(r"(?is)<h[12][^>]*>(.*?)</h[12]>").alias("name"), one(r"(?is)class=.smiles.[^>]*>(.*?)<").alias("smiles"), F.array_sort(F.array_distinct(dois)).alias("dois"), F.array_sort(F.array_distinct(F.transform(kinds, lambda k: F.upper(k)))).alias("spectra"))
