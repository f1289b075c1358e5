"""Normalisers, predicates and keys of names, titles and ids, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of names that carry no identity, generation marks, and words that tell no firm from another (of which firms' names are
# compared without).
PARTICLES = ("de", "del", "della", "van", "von", "der", "den", "da", "di", "la", "le", "st", "saint")
SUFFIXES = {"jr": "jr", "sr": "sr", "ii": "2", "iii": "3", "iv": "4", "v": "5"}
FIRM_STOP = ("and", "the", "of", "at", "law", "offices", "office", "group", "firm", "llp", "llc", "pc", "pa", "lp", "ltd", "co", "pllc", "apc", "associates", "attorneys", "a")


def chain(c: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, c)


def letters(c: Column) -> Column:
    """Letters alone, in lower case."""
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def first_token(c: Column) -> Column:
    return letters(F.element_at(F.split(F.trim(c), r"\s+"), 1))


def tokens(c: Column, least: int = 1, without: tuple[str, ...] = ()) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= least) & ~t.isin(*(without or ("",)))))


def surname_key(c: Column) -> Column:
    """The letters of a surname without particles and generation marks; of the whole if nothing else is left."""
    kept = F.filter(F.split(F.lower(F.trim(c)), "[^a-z]+"), lambda t: ~t.isin(*PARTICLES, *SUFFIXES, ""))
    return F.coalesce(F.nullif(F.array_join(kept, ""), F.lit("")), letters(c))


def generation(c: Column) -> Column:
    """jr, sr, 2, 3, 4 or 5 at the end of a name; empty if there is none."""
    mark = F.regexp_extract(F.lower(c), rf"(?:^|[^a-z0-9_])({'|'.join(SUFFIXES)})\.?\s*$", 1)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv]), F.nullif(mark, F.lit(""))), F.lit(""))


def given_tokens(full: Column, last: Column) -> Column:
    """The tokens of a full name that are neither its surname key nor particles nor generation marks."""
    found = F.transform(F.regexp_extract_all(full, F.lit("([A-Za-z']+)"), F.lit(1)), letters)
    return F.filter(found, lambda x: (x != surname_key(last)) & ~x.isin(*PARTICLES, *SUFFIXES, ""))


def salvaged_first(first: Column, last: Column) -> Column:
    """The first given name, empty where it only repeats the surname."""
    token = F.coalesce(first_token(first), F.lit(""))
    return F.when(token == surname_key(last), "").otherwise(token)


def is_individual(kind: Column, first: Column, last: Column) -> Column:
    """By the stated kind; without one, whether there is any name."""
    said = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    some = (F.trim(F.coalesce(first, F.lit(""))) != "") | (F.trim(F.coalesce(last, F.lit(""))) != "")
    return F.when(said == "firm", False).when(said == "individual", True).otherwise(some)


def reconciled_roles(c: Column) -> Column:
    """Sorted distinct roles, where coordination is another word for management."""
    return F.array_sort(F.array_distinct(F.transform(c, lambda r: F.when(r == "coordination", "management").otherwise(r))))


def firm_name(c: Column) -> Column:
    """Punctuation as spaces, legal forms at the end removed."""
    spaced = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "), r"\s+", " "))
    return F.trim(F.regexp_replace(spaced, r"(?: (?:llp|llc|pc|p c|pllc|pa|p a|inc|co|ltd))++$", ""))


def firm_tokens(c: Column) -> Column:
    """The words of a firm's name that tell it from others: of two letters at least, without those of FIRM_STOP."""
    return tokens(c, 2, FIRM_STOP)


def title(c: Column) -> Column:
    """A file name's title: extension, copy number, docket prefix and underscores removed, camel case split, lower case."""
    return F.lower(F.trim(chain(c, (r"(?i)\.pdf$", ""), (r"\s*\(\d+\)$", ""), ("([a-z])([A-Z])", "$1 $2"), (r"^\d+[-_ ]+", ""), ("_", " "), (r"\s+", " "))))


def group_id(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"^(\d+)", 1), F.lit(""))


def unpadded(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"^0+(\d)", "$1")


def iso_prefix(c: Column) -> Column:
    return F.regexp_extract(c, r"^\s*(\d{4}-\d{2}-\d{2})", 1)


def pair_key(kind: str, a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.lit(kind), F.least(a, b), F.greatest(a, b))


def truthy(c: Column, *words: str) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*(words or ("checked", "true", "1", "yes"))), F.lit(False))


def number(c: Column, default: float | None = None) -> Column:
    out = c.try_cast("double")
    return out if default is None else F.coalesce(out, F.lit(default))


def roles(c: Column, vocabulary: tuple[str, ...]) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[;,]"), lambda x: letters(x))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x.isin(*vocabulary))))


def one_of(c: Column) -> Column:
    """One value of a list: the only one, or the last by letters of several; '' without any. Blanks and nulls don't count."""
    return F.coalesce(F.array_max(F.filter(c, lambda x: F.trim(x) != "")), F.lit(""))


def as_list(c: Column) -> Column:
    """A list from a text that may hold a JSON list; never evaluated as code."""
    return F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))


def first_object(c: Column) -> Column:
    """The first embedded JSON object of a free text, braces included."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def excerpt(c: Column, whole: int = 14_000, head: int = 6_000, middle: int = 4_000, tail: int = 4_000) -> Column:
    """The text, or from a long one its head, the part after it, its middle and its tail."""
    n = F.length(c)
    half = F.floor(n / 2).cast("int") - middle // 2
    return F.when(n <= whole, c).otherwise(F.concat(F.lit("[HEAD] "), F.substring(c, 1, head), F.lit(" [EARLY] "), F.substring(c, head + 1, head), F.lit(" [MIDDLE] "), F.substring(c, half + 1, F.lit(middle)), F.lit(" [TAIL] "), F.right(c, F.lit(tail))))


def earliest_class(c: Column, classes: dict[str, str], default: str) -> Column:
    """The class whose pattern matches first; at the same place the class named first; default without a match."""
    far = 1 << 30
    at = {k: F.when(F.regexp_instr(c, F.lit(p)) == 0, far).otherwise(F.regexp_instr(c, F.lit(p))) for k, p in classes.items()}
    least = F.least(*at.values(), F.lit(far))
    out = F.when(least == far, default)
    for k, place in at.items():
        out = out.when(place == least, k)
    return out


def ascii_fold(c: Column) -> Column:
    """Latin letters without their accents, other characters beyond ASCII removed, spaces collapsed."""
    accented = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
    plain = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
    return F.trim(chain(F.translate(F.replace(c, F.lit("’"), F.lit("'")), accented, plain), (r"[^\x00-\x7F]", ""), (r"\s+", " ")))


# Patterns of docket numbers, of ids in running text (in order of priority), and of titles by what they say.
DOCKETS = (r"(?i)[,_]\s*Doc(?:ket)?\.?\s*#?\s*(\d+)", r"(?i)_\d+(?:md|mc|cv)\d+_(\d+)_")
EXHIBIT = r"Doc\.?\s*#?\s*(\d+)-(\d+)\b"
ID_HINTS = (r"(?is)MDL\s*No\.?\s*(\d{2,6}).{0,80}?Doc\.?\s*(\d{1,5})", r"(?i)\b(\d{2,6})\D+Doc\.?\s*(\d{1,5})\b", r"\b(\d{2,6})[-–](\d{1,5})\b")
ROSTER_WORDS = r"(?i)chair|member|committee|steering|executive|leadership|lead|counsel|liaison|position|recommend|slate|schedule|roster|psc|class"
REPORT_TITLE = r"(?i)special\s*master|spec\.?\s*master|report\s*(?:and\s*)?recomm|recommendation|rule\s*53|\br\s*&\s*r\b"
REAPPOINT_TITLE = r"(?i)re-?appoint|reappointment|renew"
APPOINT_TITLE = r"(?i)appoint|substitut"
FEE_TITLE = r"(?i)\bfees?\b|attn?ys?_?\s*fee|dismissal|settlem\w*.{0,18}(appr|aprvl|approv|app['_]?l|final|prelim)|(appr|aprvl|approv|app['_]?l|final|prelim).{0,18}settlem\w*"


def first_of(c: Column, patterns: tuple[str, ...], group: int = 1) -> Column:
    """The group of the first pattern that matches; null if none does."""
    return F.coalesce(*(F.nullif(F.regexp_extract(c, p, group), F.lit("")) for p in patterns))


def docket_number(name: Column) -> Column:
    """The docket number that a file's name holds, in either convention."""
    return first_of(name, DOCKETS)


def id_hint(c: Column) -> Column:
    """group-docket from running text, both numbers by one pattern; null if none matches."""
    return F.concat_ws("-", first_of(c, ID_HINTS, 1), first_of(c, ID_HINTS, 2))


# Patterns of names of docket lists (the whole name; a part of it), of words by which a court decides, and words that tell no
# firm from another beside those above: general ones, places, and legal forms and abbreviations.
DUMP_WHOLE = r"(?i)^(master\s+)?docket(\s+entries)?(\s*[,(]|\s*$)"
DUMP_PART = r"(?i)^master\s+docket\b|^mdl[-\s]*\d+[-\s]*docket\b|docket\s+summary|docket\s+report|docket\s+sheet|consolidated\s+docket|docket\s+listing"
DISPOSITION = r"(?i)\b(grant(?:s|ed)?|approv(?:e|ed|ing)|so ordered|it is so ordered|allowed|entered|adjudged|decreed)\b"
GENERAL_WORDS = "trial lawyers lawyer legal counsel justice national american consumer center centre complex litigation injury attorney general state states united advocates partners counselors international global us usa"
PLACE_WORDS = (
    "alabama alaska arizona arkansas california colorado connecticut delaware florida georgia hawaii idaho illinois indiana iowa kansas kentucky louisiana maine maryland massachusetts "
    "michigan minnesota mississippi missouri montana nebraska nevada hampshire jersey mexico york carolina dakota ohio oklahoma oregon pennsylvania rhode island tennessee texas utah "
    "vermont virginia washington west wisconsin wyoming new chicago boston angeles francisco diego orleans city county dc"
)
FORM_WORDS = "pllp lpa aplc plc psc chtd lllp llp pc inc corp company corporation br fl ca dc dept division"


def signature_stop() -> tuple[str, ...]:
    """All words that a firm's signature leaves out."""
    return tuple(dict.fromkeys([*FIRM_STOP, *f"{GENERAL_WORDS} {PLACE_WORDS} {FORM_WORDS}".split()]))


def firm_signature(c: Column) -> Column:
    """The sorted tokens of two letters at least that tell a firm from others."""
    return F.array_sort(tokens(c, 2, signature_stop()))


def is_docket_list(name: Column) -> Column:
    """Whether a file is a list of dockets: its title, without extension and leading number, says so and has no #."""
    title_ = F.trim(F.regexp_replace(F.regexp_replace(name, r"(?i)\.pdf$", ""), r"^\s*\d+\s*(?:,\s*|\s+)", ""))
    return F.lower(name).contains("docket") & ~title_.contains("#") & (title_.rlike(DUMP_WHOLE) | title_.rlike(DUMP_PART))
