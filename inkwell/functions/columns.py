"""Scalar functions as Column expressions; everything here stays in the JVM.

White space means what Python means by it, which the pattern ``SPACE`` spells out: Unicode white space
and U+001C-U+001F. A value is *falsy* if it is null or the empty string; blanks are not falsy.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.vocab import SKIPPED_SECTIONS_V1, SKIPPED_SECTIONS_V2, minimal_terms

SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
U = "(?U)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scalar(v: Column, name: str) -> Column:
    """A field of a variant as text, if it is a string, number or boolean; else null."""
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    return F.when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), F.try_variant_get(v, f"$.{name}", "string"))


def truthy(c: Column | str) -> Column:
    """The string, or null for the empty one."""
    return F.nullif(col(c).cast("string"), F.lit(""))


def first_truthy(*cols: Column | str) -> Column:
    """The first value that is neither null nor empty; null if there is none."""
    return F.coalesce(*map(truthy, cols))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column | str) -> Column:
    """Runs of white space to one space, ends stripped."""
    return F.trim(F.regexp_replace(col(c), f"{SPACE}+", " "))


def words(c: Column | str) -> Column:
    """The words between white space; an empty array for a null or blank text."""
    return F.array_remove(F.split(F.coalesce(col(c), F.lit("")), f"{SPACE}+"), "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def normalize(c: Column | str, variant: str = "v2") -> Column:
    """Text normalization, entities left as they are (``xmltext.unescape`` before it expands them): v2 collapses white space; v1 also drops numeric
    citations (after collapsing, so that two spaces may remain) and splits glued headings. Null gives ''."""
    flat = F.regexp_replace(F.coalesce(col(c), F.lit("")), f"{SPACE}+", " ")
    if variant == "v2":
        return F.trim(flat)
    flat = F.trim(F.regexp_replace(flat, r"\[[0-9,\-–  ]+\]", ""))
    flat = F.regexp_replace(flat, "^([A-Za-z]+)([A-Z])", "$1 $2")
    return F.regexp_replace(flat, "([.!?])([A-Z]{2,})([A-Z][a-z])", "$1 $2 $3")


def norm_pmcid(c: Column | str) -> Column:
    """Stripped, upper case, without '.TXT', with 'PMC' before bare digits; '' for null and empty."""
    x = F.regexp_replace(F.upper(strip(F.coalesce(col(c).cast("string"), F.lit("")))), r"\.TXT$", "")
    return F.when(x.rlike(f"{U}^\\d+$"), F.concat(F.lit("PMC"), x)).otherwise(x)


def base_id_v1(pmcid: Column | str, pmid: Column | str, ident: Column | str) -> Column:
    tagged = lambda tag, c: F.concat(F.lit(tag), truthy(c))
    return F.coalesce(truthy(pmcid), tagged("PMID_", pmid), tagged("ID_", ident))


def base_id_v2(pmcid: Column | str, ident: Column | str, *content: Column | str) -> Column:
    """Safe file name; a record without any id gets 'unknown_' and a hash of ``content``, the same on every run."""
    unknown = F.concat(F.lit("unknown_"), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in content]), 256), 1, 8)) if content else F.lit("unknown")
    return F.regexp_replace(F.coalesce(truthy(pmcid), truthy(ident), unknown), "[^A-Za-z0-9_.-]+", "_")


def tagged_key(pmcid: Column | str, pmid: Column | str, ident: Column | str) -> Column:
    """Key of the first id there is, tagged by its kind; null if there is none."""
    tag = lambda t, c: F.concat(F.lit(t), truthy(c))
    return F.coalesce(tag("PMCID:", pmcid), tag("PMID:", pmid), tag("ID:", ident))


def clean_issn(c: Column | str) -> Column:
    return F.upper(strip(c))


def year_pilot(*cols: Column | str) -> Column:
    """The first value that is a whole number, white space around it allowed; null if there is none."""
    return F.coalesce(*[strip(col(c).cast("string")).try_cast("int") for c in cols])


def year_full(*cols: Column | str) -> Column:
    """The first run (19|20)dd found in the first value that has one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(col(c).cast("string"), "(19|20)[0-9]{2}", 0), F.lit("")) for c in cols]).cast("int")


def looks_like_html(c: Column | str) -> Column:
    head = F.lower(F.substring(F.regexp_replace(F.coalesce(col(c), F.lit("")), f"^{SPACE}+", ""), 1, 200))
    return head.startswith("<!doctype html") | head.startswith("<html")


def mentions(terms: list[str], *texts: Column | str) -> Column:
    """Does any term occur, as a substring, in the lower-cased texts joined by a space? Null texts are empty.

    Terms that hold another term are left out of the test, which changes no result. Plain searches for
    each term, which end with the first that is found, take a sixth of the time of one pattern of all terms."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(col(t), F.lit("")) for t in texts]))
    found = F.lit(False)
    for term in minimal_terms(terms):
        found = found | hay.contains(term)
    return found


def skipped_section(title: Column | str, variant: str = "v2") -> Column:
    """Is the section left out? v1: exact after dropping all but letters and spaces; v2: any phrase as a substring."""
    low = F.lower(strip(title))
    if variant == "v1":
        return F.regexp_replace(low, f"{U}[^a-z\\s]", "").isin(SKIPPED_SECTIONS_V1)
    found = F.lit(False)
    for phrase in SKIPPED_SECTIONS_V2:
        found = found | low.contains(phrase)
    return found


def guarded_percent(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    """100 part / whole, rounded half up, 0.0 for an empty whole."""
    return F.when(col(whole) > 0, F.round(col(part) * 100.0 / col(whole), digits)).otherwise(F.lit(0.0))


def output_path(root: str, year: Column | str, base: Column | str, suffix: str = ".txt") -> Column:
    """<root>/<year>/<base><suffix>, with 'unknown' for a missing year."""
    return F.concat(F.lit(root.rstrip("/") + "/"), F.coalesce(col(year).cast("string"), F.lit("unknown")), F.lit("/"), col(base), F.lit(suffix))


def shortened(c: Column | str, most: int = 55) -> Column:
    """For display: at most ``most`` characters, the last an ellipsis if some are cut."""
    return F.when(F.length(col(c)) > most, F.concat(F.substring(col(c), 1, most - 1), F.lit("…"))).otherwise(col(c))


def keywords_text(raw: Column | str) -> Column:
    """A keywords field given as JSON text: a string as it is; a list joined by '; ', taking of each
    object the first of term, keyword, kw that is a string. Null for nothing usable."""
    v = F.try_parse_json(col(raw))
    kind = F.schema_of_variant(v)
    as_list = F.try_variant_get(v, "$", "array<variant>")
    is_text = lambda x: F.schema_of_variant(x) == "STRING"
    part = lambda x, k: F.when(F.schema_of_variant(F.try_variant_get(x, f"$.{k}", "variant")) == "STRING", F.try_variant_get(x, f"$.{k}", "string"))
    item = lambda x: F.when(is_text(x), F.try_variant_get(x, "$", "string")).otherwise(F.coalesce(part(x, "term"), part(x, "keyword"), part(x, "kw")))
    joined = F.array_join(F.transform(as_list, item), "; ")
    return F.when(kind == "STRING", F.nullif(F.try_variant_get(v, "$", "string"), F.lit(""))).when(kind.startswith("ARRAY"), F.nullif(joined, F.lit("")))


def metadata_payload(title: Column | str, abstract: Column | str, keywords: Column | str | None = None) -> Column:
    """Title, abstract and 'Keywords: ...' as paragraphs, empty parts left out."""
    part = lambda c: truthy(strip(truthy(c)))
    parts = [part(title), part(abstract)]
    if keywords is not None:
        parts.append(F.concat(F.lit("Keywords: "), part(keywords)))
    return strip(F.concat_ws("\n\n", *parts))


def labelled_payload(title: Column | str, journal: Column | str, year: Column | str, abstract: Column | str, keywords: Column | str | None = None) -> Column:
    """Labelled lines for title, journal and year, abstract, keywords; falsy parts left out."""
    label = lambda name, c: F.concat(F.lit(f"{name}: "), truthy(c))
    where = truthy(F.concat_ws(", ", truthy(journal), col(year).cast("string")))
    parts = [label("Title", title), F.concat(F.lit("Journal / Year: "), where), label("Abstract", abstract)]
    if keywords is not None:
        parts.append(label("Keywords", keywords))
    return strip(F.concat_ws("\n\n", *parts))
