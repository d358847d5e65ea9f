"""Multi-label classification by tables of phrases, compiled to one regular expression a label.

A phrase is words between blanks: `*` stands for the rest of a word, `a|b` for either word, a word with `?` may be
missing. Phrases are looked for in folded text, at word borders as ASCII knows them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LEFT, RIGHT, WORD, latin_search_text, once


def phrase(p: str) -> str:
    """The regular expression of a phrase."""
    out, words = LEFT, p.split()
    for k, w in enumerate(words):
        optional, last = w.endswith("?"), k == len(words) - 1
        body = "(?:" + "|".join(re.escape(x).replace(r"\*", WORD + "*") for x in w.rstrip("?").split("|")) + ")"
        out += f"(?:{body}\\s+)?" if optional else body if last else f"{body}\\s+"
    return out + (RIGHT if words[-1].endswith("!") else "")


def any_of(phrases: list[str]) -> str:
    return "|".join(phrase(p[:-1]) + RIGHT if p.endswith("!") else phrase(p) for p in phrases)


PROCEDURE_EXCLUSIONS = ["raspored* casova|ispita|kolokvijuma", "kalendar* aktivnosti", "izmen* u kalendar", "linkov* za pristup", "konsultativn* nastav", "realizacij* nastave", "plan* izvodjenja nastave", "kreiranj* sip? naloga", "promocij* novog? program", "rang list", "vrednovanj* kvaliteta nastav"]
PROCEDURES = {
    "overa_semestra": ["over* jesenjeg|prolecnog? semestra"],
    "ispis_sa_fakulteta": ["ispisnic*", "ispis* sa fakulteta"],
    "izbor_predmeta_ili_modula": ["list* izbornih", "bira* modul", "izborn* predmet", "izbor* predmeta|modula"],
    "upis_godine": ["ponovni upis", "uslovi upisa", "rok za upis", "upis* nove|naredne|vise skolske? godine", "upis* samofinansirajucih? studenata!", "#godina"],
    "status_studenta": ["mirovanj*", "produzenj* statusa"],
    "zavrsni_rad": ["master rad", "diplomsk* rad", "zavrsn* rad"],
    "strucna_praksa": ["strucn* praks"],
    "skolarina_ili_uplata": ["uplatnic*", "skolarin*", "naknad* za", "oslobadj* od? placanja"],
    "prijava_ispita": ["prijav* ispita"],
    "obrazac_ili_zahtev": ["zahtev*", "obrasc*", "obrazac!", "dokumentacij*", "prijavn* list"],
}
#: Enrolment in a year, with the year's Roman or Arabic number or neither.
ENROLMENT = f"{LEFT}upis{WORD}*\\s+(?:studenata\\s+)?(?:u\\s+)?(?:iv|i{{1,3}}|[0-9]+)?\\s*godin"
ACTIVITY_EXCLUSIONS = ["isplat* stipendija|studentskih", "isplat* prve rate", "urucen* stipendij", "potpisivanj* ugovora", "#povracaj", "odrzavanj* moodle|platforme|sistema", "dodel* diplom", "obavestenj* za studente", "rezultat* konkursa", "rang list"]
REFUND = f"{LEFT}povracaj{WORD}*\\s+.*skolarin"
ACTIVITIES = {
    "praksa": ["internship!", "praks*"],
    "kurs": ["obuk*", "kurs*"],
    "stipendija": ["stipendiranj*", "stipendij*"],
    "razmena_ili_mobilnost": ["razmen*", "mobilnost*", "erasmus!"],
    "radionica": ["workshop!", "radionic*"],
    "takmicenje_ili_hakaton": ["hakaton*", "hackathon!", "takmicenj*", "competition!", "case study!", "bubble cup!"],
    "kamp": ["kamp*"],
    "predavanje_tribina_ili_konferencija": ["tribin*", "bazar*", "predavanj*", "prezentacij*", "konferencij*", "otvoren* vrata"],
    "studentski_program": ["student experience!", "studentsk* program", "akcelerator* program", "program* za|podrske|unapredjenj"],
    "zaposlenje": ["job!", "posao!", "pozicij*", "zaposlenj*"],
}
SPECIAL = {"#godina": ENROLMENT, "#povracaj": REFUND}


def pattern_of(phrases: list[str]) -> str:
    plain, special = [p for p in phrases if p not in SPECIAL], [SPECIAL[p] for p in phrases if p in SPECIAL]
    return "|".join([any_of(plain), *special] if plain else special)


def labels(folded: Column, table: dict[str, list[str]], exclusions: list[str]) -> Column:
    """The labels whose phrases occur, in the table's order; none if an exclusion does."""

    def found(text: Column) -> Column:
        hits = F.array_compact(F.array(*(F.when(text.rlike(pattern_of(p)), F.lit(k)) for k, p in table.items())))
        return F.when(text.rlike(pattern_of(exclusions)), F.array().cast("array<string>")).otherwise(hits)

    return once(folded, found)


def searchable(title: Column, summary: Column) -> Column:
    return latin_search_text(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit(""))))


def procedures(title: Column, summary: Column) -> Column:
    return labels(searchable(title, summary), PROCEDURES, PROCEDURE_EXCLUSIONS)


def activities(title: Column, summary: Column) -> Column:
    return labels(searchable(title, summary), ACTIVITIES, ACTIVITY_EXCLUSIONS)


def study_levels(source: Column, title: Column, body: Column) -> Column:
    """Levels named in the title or the first 500 characters of the body; else the source's own; else all."""
    folded = latin_search_text(F.concat_ws(" ", title, F.substring(body, 1, 500)))
    named = {"OAS": ["oas!", "osnovn* akademsk"], "MAS": ["mas!", "master* akademsk"], "DAS": ["das!", "doktor* akademsk"]}
    found = F.array_compact(F.array(*(F.when(folded.rlike(any_of(p)), F.lit(k)) for k, p in named.items())))
    own = F.when(source == "mas", "MAS").when(source == "das", "DAS").when(source == "upis-naredne-godine-oas", "OAS").otherwise("SVI")
    return F.when(F.size(found) > 0, found).otherwise(F.array(own))
