"""Word lists and providers for invented values. German company, place and
person words; all lists are fixed values and may be replaced per locale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabshift.functions.draws import SLOTS, digest, pick

SURNAMES = (
    "Albers", "Bauer", "Becker", "Berger", "Böhm", "Brandt", "Dietrich", "Engel", "Fischer",
    "Franke", "Fuchs", "Graf", "Groß", "Haas", "Hahn", "Hartmann", "Heinrich", "Herrmann",
    "Hoffmann", "Huber", "Jung", "Kaiser", "Keller", "Koch", "König", "Krämer", "Kuhn", "Lang",
    "Lehmann", "Lorenz", "Maier", "Martin", "Möller", "Neumann", "Otto", "Peters", "Pohl",
    "Richter", "Roth", "Sauer", "Schäfer", "Schmitt", "Schreiber", "Seidel", "Simon", "Sommer",
    "Stein", "Thomas", "Vogel", "Voigt", "Wagner", "Weber", "Winkler", "Wolf", "Ziegler",
)
FIRST_NAMES = (
    "anna", "ben", "clara", "david", "emil", "franz", "greta", "hanna", "ida", "jonas", "karl",
    "lena", "mara", "nina", "oskar", "paul", "rosa", "selma", "tim", "ute", "vera", "willi",
)
COMPANY_FORMS = ("AG", "GmbH", "GmbH & Co. KG", "KG", "OHG", "e.G.", "e.V.", "Stiftung & Co. KG")
CITIES = (
    "Aachen", "Ahaus", "Altena", "Bamberg", "Bautzen", "Beeskow", "Coburg", "Döbeln", "Eutin",
    "Freising", "Fulda", "Gotha", "Greifswald", "Hameln", "Husum", "Ilmenau", "Jena", "Kassel",
    "Landau", "Lübben", "Meißen", "Minden", "Neuss", "Oschatz", "Passau", "Plauen", "Rostock",
    "Soest", "Stendal", "Templin", "Uelzen", "Verden", "Wismar", "Worms", "Zeitz", "Zwickau",
)
STREET_WORDS = (
    "Ahorn", "Birken", "Brunnen", "Buchen", "Eichen", "Erlen", "Feld", "Garten", "Hafen", "Kirch",
    "Linden", "Markt", "Mühlen", "Nord", "Ost", "Rosen", "Schul", "Sonnen", "Ulmen", "Wiesen",
)
STREET_ENDINGS = ("straße", "weg", "gasse", "allee", "platz", "ring", "ufer")
# fixed values: the least postcode and how many there are from it on
FIRST_POSTCODE, POSTCODES = 1_000, 99_000
VERBS = ("align", "build", "connect", "deliver", "extend", "join", "plan", "refine", "scale", "unify")
ADJECTIVES = (
    "central", "compact", "durable", "flexible", "global", "light", "modular", "open", "robust",
    "simple", "smart", "stable",
)
NOUNS = (
    "channels", "designs", "interfaces", "markets", "models", "networks", "portals", "services",
    "systems", "tools",
)


class Draws:
    """Hands out independent picks for one column; four per digest."""

    def __init__(self, seed: int, column: str, row_id: Column) -> None:
        self.seed, self.column, self.row_id = seed, column, row_id
        self.used = 0

    def hexes(self) -> Column:
        return digest(self.seed, f"{self.column}|{self.used // SLOTS}", self.row_id)

    def pick(self, n: int) -> Column:
        picked = pick(self.hexes(), self.used % SLOTS, n)
        self.used += 1
        return picked

    def word(self, words: tuple[str, ...]) -> Column:
        position = self.pick(len(words)).cast("int") + 1
        return F.element_at(F.array(*[F.lit(w) for w in words]), position)


def company(d: Draws) -> Column:
    return F.concat(d.word(SURNAMES), F.lit(" "), d.word(SURNAMES), F.lit(" "), d.word(COMPANY_FORMS))


def postcode(d: Draws) -> Column:
    return F.format_string("%05d", d.pick(POSTCODES) + FIRST_POSTCODE)


def city(d: Draws) -> Column:
    return d.word(CITIES)


def street_name(d: Draws) -> Column:
    return F.concat(d.word(STREET_WORDS), d.word(STREET_ENDINGS))


def building_number(d: Draws) -> Column:
    return (d.pick(250) + 1).cast("string")


def bs(d: Draws) -> Column:
    return F.concat(d.word(VERBS), F.lit(" "), d.word(ADJECTIVES), F.lit(" "), d.word(NOUNS))


def user_name(d: Draws) -> Column:
    return F.concat(d.word(FIRST_NAMES), F.format_string("%02d", d.pick(100)))


Provider = Callable[[Draws], Column]

PROVIDERS: dict[str, dict[str, Provider]] = {
    "de_DE": {
        "company": company,
        "postcode": postcode,
        "city": city,
        "street_name": street_name,
        "building_number": building_number,
        "bs": bs,
        "user_name": user_name,
    }
}
