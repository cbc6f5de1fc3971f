"""Default rule tables of the address engine.

A gazetteer may carry its own entries, which extend these (``Rules.extended``).  The words below are fixed
values: answers depend on them being exactly these.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# fixed values: other names of communes
COMMUNE_ALIAS = {"den haag": "s gravenhage", "den bosch": "s hertogenbosch", "reggio emilia": "reggio nell emilia"}

# fixed values: short or foreign names of cities, in the order in which they are applied
CITY_ALIAS = {
    "спб": "санкт петербург", "мск": "москва", "екб": "екатеринбург", "нск": "новосибирск", "питер": "санкт петербург",
    "bg": "beograd", "ns": "novi sad", "amsterdam zo": "amsterdam", "moscow": "москва", "saint petersburg": "санкт петербург",
    "st petersburg": "санкт петербург", "rome": "roma", "milan": "milano", "naples": "napoli", "turin": "torino",
    "florence": "firenze", "venice": "venezia", "genoa": "genova", "padua": "padova",
}

# fixed values: abbreviations of two tokens
ABBREV_PAIRS = {"p zza": "piazza", "c so": "corso", "v le": "viale", "пр кт": "проспект", "б р": "бульвар", "пр т": "проспект"}

# fixed values: abbreviations of a first or last word
ABBREV = {
    "r": "rue", "av": "avenue", "avn": "avenue", "bd": "boulevard", "bld": "boulevard", "blvd": "boulevard", "pl": "place",
    "imp": "impasse", "chem": "chemin", "all": "allee", "sq": "square", "rte": "route", "crs": "cours", "fbg": "faubourg",
    "st": "saint", "ste": "sainte", "ln": "laan", "str": "straat", "v": "via", "vle": "viale", "pza": "piazza", "cso": "corso",
    "vic": "vicolo", "ул": "улица", "пр": "проспект", "просп": "проспект", "пер": "переулок", "наб": "набережная", "ш": "шоссе",
    "бул": "бульвар", "пл": "площадь", "кв": "квартал", "мкр": "микрорайон", "мкрн": "микрорайон",
}

# fixed values: capitals
CAPITALS = ("москва", "paris", "roma", "amsterdam", "beograd", "toshkent", "ташкент", "s gravenhage", "санкт петербург")

# fixed values: street types
TYPES_CYRILLIC = (
    "улица", "проспект", "переулок", "набережная", "шоссе", "бульвар", "площадь", "проезд", "аллея", "тупик", "квартал", "микрорайон",
)
TYPES_LATIN = (
    "rue", "avenue", "boulevard", "place", "impasse", "allee", "chemin", "route", "cours", "quai", "passage", "square",
    "via", "viale", "corso", "piazza", "largo", "vicolo", "strada",
)
TYPES_EXTRA = (
    "straat", "laan", "weg", "plein", "gracht", "dijk", "kade", "steeg", "singel", "hof", "ulica", "bulevar", "trg", "put",
    "kochasi", "kocha", "kuchasi", "mavze", "mavzesi", "dahasi", "daha", "prospekti", "piazzale", "salita",
)

# fixed values: leading designators besides street types
AFFIX_EXTRA = ("массив", "massiv", "мкр", "микрорайон", "квартал", "kvartal", "жилой", "residential", "комплекс", "complex", "жк")

# fixed values: noise
NOISE = ("г", "гор", "город", "gorod", "shahri", "sh")
NOISE_AFTER = ("город", "grad", "sh")
REGION_MARKERS = (
    "обл", "область", "области", "край", "края", "респ", "республика", "район", "района", "р н", "tumani", "tuman", "viloyat", "viloyati",
)
COUNTRIES_MID = (
    "france", "francia", "frankrijk", "франция", "italia", "italy", "italie", "италия", "srbija", "serbia", "сербия", "србија",
    "россия", "russia", "рф", "узбекистан", "uzbekistan", "ozbekiston", "nederland", "netherlands", "holland", "нидерланды",
)
COUNTRIES_TAIL = (
    "france", "francia", "франция", "nederland", "netherlands", "holland", "нидерланды", "italia", "italy", "italie", "италия",
    "srbija", "serbia", "сербия", "србија", "россия", "russia", "рф", "федерация", "российская", "uzbekistan", "узбекистан",
    "ozbekiston", "europe", "европа",
)
PLACE_JUNK = (
    "территория", "тер", "муниципальный", "округ", "поселение", "городской", "деревня", "дер", "село", "поселок", "пос", "рп", "пгт",
    "аул", "кишлак",
)
PLACE_PREFIX = (
    "снт", "днп", "тсн", "сдт", "ст", "садовое", "дачное", "некоммерческое", "товарищество", "массив", "микрорайон", "мкр", "квартал",
    "город", "обл", "область", "край", "район",
)
ORDINAL_CITIES = ("paris", "lyon", "marseille")
PLACE_TYPE_STRIP = ("квартал", "kvartal", "mavze", "mavzesi", "даха", "daha", "dahasi", "массив", "massiv", "мкр", "микрорайон")

# fixed values: French numerals, compounds first
NUMERALS = {
    "dix sept": "17", "dix huit": "18", "dix neuf": "19", "vingt cinq": "25", "premier": "1er", "une": "1", "un": "1", "deux": "2",
    "trois": "3", "quatre": "4", "cinq": "5", "six": "6", "sept": "7", "huit": "8", "neuf": "9", "dix": "10", "onze": "11",
    "douze": "12", "treize": "13", "quatorze": "14", "quinze": "15", "seize": "16", "vingt": "20", "trente": "30",
}

# fixed values: house-number designators and their short forms
UNITS = {
    "корпус": "к", "корп": "к", "копр": "к", "корпуса": "к", "кор": "к", "к": "к", "строение": "с", "стр": "с", "строения": "с", "с": "с",
    "владение": "вл", "влад": "вл", "вл": "вл",
}
SAFE_SUFFIXES = ("bis", "ter", "quater", "quinquies", "sexies")

#: Classes of a rules file, by number.
CLASSES = {
    1: "commune_alias", 2: "city_alias", 3: "abbrev_pairs", 4: "capitals", 5: "types_cyrillic", 6: "affix_extra", 7: "noise",
    8: "noise_after", 9: "region_markers", 10: "countries_mid", 11: "countries_tail", 12: "place_junk", 13: "place_prefix",
    14: "ordinal_cities", 15: "place_type_strip", 16: "types_latin", 17: "types_extra",
}


@dataclass(frozen=True)
class Rules:
    commune_alias: dict = field(default_factory=lambda: dict(COMMUNE_ALIAS))
    city_alias: dict = field(default_factory=lambda: dict(CITY_ALIAS))
    abbrev_pairs: dict = field(default_factory=lambda: dict(ABBREV_PAIRS))
    capitals: tuple = CAPITALS
    types_cyrillic: tuple = TYPES_CYRILLIC
    types_latin: tuple = TYPES_LATIN
    types_extra: tuple = TYPES_EXTRA
    affix_extra: tuple = AFFIX_EXTRA
    noise: tuple = NOISE
    noise_after: tuple = NOISE_AFTER
    region_markers: tuple = REGION_MARKERS
    countries_mid: tuple = COUNTRIES_MID
    countries_tail: tuple = COUNTRIES_TAIL
    place_junk: tuple = PLACE_JUNK
    place_prefix: tuple = PLACE_PREFIX
    ordinal_cities: tuple = ORDINAL_CITIES
    place_type_strip: tuple = PLACE_TYPE_STRIP

    def is_type(self, word: str) -> bool:
        return word in self.types_cyrillic or word in self.types_latin or word in self.types_extra

    def is_affix(self, word: str) -> bool:
        return self.is_type(word) or word in self.affix_extra

    def extended(self, rows: list[tuple[int, str, str]]) -> Rules:
        """With more entries (class, key, value), in sorted order; an unknown class is an error and adds nothing."""
        out: dict = {}
        for number, key, value in sorted(rows):
            name = CLASSES.get(number)
            if name is None:
                raise ValueError(f"rules have no class {number}")
            now = out.get(name, getattr(self, name))
            if isinstance(now, dict):
                out[name] = {**now, key: value}
            elif key not in now:
                out[name] = (*now, key)
            else:
                out[name] = now
        return replace(self, **out)


#: Numbers of the classes, by name.
RULES_NUMBERS = {name: number for number, name in CLASSES.items()}
