"""Fuzzy comparisons of names and firms, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import letters

# Given names and their short forms, a group in each line.
NICKNAMES = """
william bill billy will willie
robert bob bobby rob robbie
richard rick dick rich richie
james jim jimmy jamie
john jack johnny jon jonathan
joseph joe joey jos
michael mike micky
christopher chris kit
daniel dan danny
matthew matt
anthony tony
steven stephen steve
edward ed eddie ted ned
thomas tom tommy
charles charlie chuck chas
kenneth ken kenny
ronald ron ronnie
donald don donnie
timothy tim
gregory greg
jeffrey jeff jeffery geoffrey geoff
raymond ray
lawrence larry laurence
gerald jerry gerry gerard jerrold
patrick pat paddy
benjamin ben benny
samuel sam sammy
frederick fred freddy
theodore theo ted
andrew andy drew
nicholas nick
alexander alex sandy alexandra
elizabeth liz beth betsy eliza lizzie
margaret meg peggy maggie marge
katherine kathryn kate katie kathy catherine cathy kay kathleen
susan sue susie suzanne
deborah deb debbie debra
patricia pat patty tricia trish
barbara barb
jennifer jen jenny jenniffer
victoria vicki vicky tori
kimberly kim
pamela pam
cynthia cindy
sandra sandy
rebecca becky
michelle shelly michele
stephanie steph
norman norm
ernest ernie
leonard lenny leo len
maxwell max
willard will
russell russ
bradford brad bradley
douglas doug douglass
vincent vince vinny
eugene gene
harold hal harry
albert al bert
arthur art
walter walt wally
francis frank fran francisco
peter pete
philip phil phillip
dennis denny
stanley stan
howard howie
irving irv
melvin mel
sheldon shelly
solomon sol
seymour sy
hyman hy
abraham abe
isaac ike
"""


def nickname_groups(text: str = NICKNAMES) -> list[list[str]]:
    return [line.split() for line in text.strip().splitlines()]


def groups_of_names(groups: list[list[str]]) -> dict[str, list[int]]:
    """The groups of each name; some names are short for several."""
    out: dict[str, list[int]] = {}
    for k, names in enumerate(groups):
        for n in names:
            out.setdefault(n, []).append(k)
    return out


_GROUPS = groups_of_names(nickname_groups())


def soundex(c: Column) -> Column:
    return F.soundex(letters(c))


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def same_surname(a: Column, b: Column) -> Column:
    """Equal, a prefix of the other with four letters at least, or one edit apart with five letters at least; never if one is empty."""
    some = (F.length(a) > 0) & (F.length(b) > 0)
    long = (F.length(a) >= 4) & (F.length(b) >= 4)
    near = (F.least(F.length(a), F.length(b)) >= 5) & (F.levenshtein(a, b) <= 1)
    return some & ((a == b) | (long & (a.startswith(b) | b.startswith(a))) | near)


def sounds_like(a: Column, b: Column) -> Column:
    """Surnames that are equal, sound alike, or are one edit apart with five letters at least."""
    some = (F.length(a) > 0) & (F.length(b) > 0)
    near = (F.least(F.length(a), F.length(b)) >= 5) & (F.levenshtein(a, b) <= 1)
    return some & ((a == b) | (soundex(a) == soundex(b))) | near


def initial_fits(a: Column, b: Column) -> Column:
    return (F.length(a) == 0) | (F.length(b) == 0) | (F.substring(a, 1, 1) == F.substring(b, 1, 1))


def same_person(last_a: Column, first_a: Column, last_b: Column, first_b: Column, strict: bool = False) -> Column:
    """Surnames and initials that fit, also with first and last name swapped on one side; strict: both names equal."""
    if strict:
        return (last_a == last_b) & (first_a == first_b)
    return (same_surname(last_a, last_b) & initial_fits(first_a, first_b)) | (same_surname(first_a, last_b) & initial_fits(last_a, first_b))


def name_groups(c: Column) -> Column:
    """The numbers of the groups of short forms that a name belongs to."""
    known = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in _GROUPS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(c)), F.array().cast("array<int>"))


def short_forms(a: Column, b: Column) -> Column:
    return F.arrays_overlap(name_groups(a), name_groups(b))


def anagram(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, "")), "")


def one_edit(a: Column, b: Column) -> Column:
    return (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & (F.levenshtein(a, b) <= 1)


def first_relation(a: Column, b: Column, given_a: Column, given_b: Column) -> Column:
    """exact, nick, subset (all given names of one among the other's), initial, edit1 or none, the first that holds."""
    some = (F.length(a) > 0) & (F.length(b) > 0)
    within = (subset(given_a, given_b) | subset(given_b, given_a)) & F.arrays_overlap(given_a, given_b)
    initial = some & ((F.length(a) == 1) | (F.length(b) == 1)) & (F.substring(a, 1, 1) == F.substring(b, 1, 1))
    return F.when(some & (a == b), "exact").when(short_forms(a, b), "nick").when(within, "subset").when(initial, "initial").when(some & one_edit(a, b), "edit1").otherwise("none")


def related_given(a: Column, b: Column) -> Column:
    """Whether two given names may be one: missing, equal, a short form, an initial, a prefix, one edit with the same initial, or an
    anagram two edits apart. An initial decides by itself."""
    missing = (F.length(a) == 0) | (F.length(b) == 0)
    initial = (F.length(a) == 1) | (F.length(b) == 1)
    rest = a.startswith(b) | b.startswith(a) | one_edit(a, b) | (anagram(a) == anagram(b)) & (F.levenshtein(a, b) <= 2)
    return F.when(missing | (a == b) | short_forms(a, b), True).when(initial, F.substring(a, 1, 1) == F.substring(b, 1, 1)).otherwise(rest)


def lists_compatible(a: Column, b: Column) -> Column:
    """A shared token or a related pair among those of two letters at least; also if either has none of these."""
    long_a, long_b = F.filter(a, lambda x: F.length(x) >= 2), F.filter(b, lambda x: F.length(x) >= 2)
    return (F.size(long_a) == 0) | (F.size(long_b) == 0) | F.arrays_overlap(a, b) | F.exists(long_a, lambda x: F.exists(long_b, lambda y: related_given(x, y)))


def same_firm(a: Column, b: Column) -> Column:
    """Token sets of firms: one within the other, half of the union shared, or single tokens one edit apart."""
    single = (F.size(a) == 1) & (F.size(b) == 1) & (F.levenshtein(F.get(a, 0), F.get(b, 0)) <= 1)
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return some & (subset(a, b) | subset(b, a) | (jaccard(a, b) >= 0.5) | single)


def same_firm_careful(a: Column, b: Column) -> Column:
    """Single tokens at most one edit apart; of more tokens at least two shared, and one set within the other or half of the union."""
    some, single = (F.size(a) > 0) & (F.size(b) > 0), (F.size(a) == 1) & (F.size(b) == 1)
    two = F.size(F.array_intersect(a, b)) >= 2
    return some & F.when(single, F.levenshtein(F.get(a, 0), F.get(b, 0)) <= 1).otherwise(two & (subset(a, b) | subset(b, a) | (jaccard(a, b) >= 0.5)))


def pair_level(last_a: Column, first_a: Column, last_b: Column, first_b: Column, relation: Column, shared: Column) -> Column:
    """strong, context or weak evidence that two people are one, null without any. Only equal surnames with an equal first name or a short form
    are strong; everything else needs a shared firm or group, without which it is weak."""
    exact = (F.length(last_a) > 0) & (last_a == last_b)
    near = ~exact & sounds_like(last_a, last_b)
    swapped = ~exact & ~near & sounds_like(first_a, last_b) & sounds_like(first_b, last_a)
    by_context = F.when(shared, "context").otherwise("weak")
    return F.when(swapped, by_context).when(~(exact | near) | (relation == "none"), F.lit(None)).when(exact & relation.isin("exact", "nick"), "strong").otherwise(by_context)
