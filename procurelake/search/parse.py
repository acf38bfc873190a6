"""User queries at plan time: tokens and synonyms (OP-X3 to OP-X5)."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Groups of words that mean the same in a procurement notice, in English, Afrikaans and isiZulu.
SYNONYMS = """
construction konstruksie bou ukwakhiwa building gebou
renovation opknapping restourasie refurbishment upgrade opgradering ukuvuselelwa
maintenance instandhouding onderhoud ukulungiswa repair herstel
road pad umgwaqo roads paaie
bridge brug ibhuloho
housing behuising izindlu house huis
plumbing loodgieterswerk sanitation sanitasie
electrical elektries ugesi electricity elektrisiteit
water amanzi
borehole boorgat umthombo
sewer riool sewerage indle
security sekuriteit veiligheid ezokuphepha guarding bewaking
surveillance toesig cctv camera kamera
cleaning skoonmaak ukuhlanza hygiene higiene
catering spysenierings ukudla food kos
garden tuin landscaping landskap ingadi
supply verskaffing ukuhlinzeka delivery aflewering supplies voorrade
equipment toerusting izinsiza apparatus apparaat
furniture meubels ifenisha
stationery skryfbehoeftes
vehicle voertuig imoto fleet vloot
fuel brandstof uphethiloli diesel petrol
consultant konsultant consulting konsultasie advisory adviesdiens
training opleiding ukuqeqeshwa skills vaardighede
audit oudit ukucwaninga auditing
legal regs ezomthetho attorney prokureur
medical medies ezokwelapha health gesondheid ezempilo
transport vervoer ezokuthutha logistics logistiek
insurance versekering umshwalense
software sagteware
hardware hardeware
network netwerk connectivity konnektiwiteit
tender tenders bid bod itenda rfq rfp rft
quotation kwotasie quote isilinganiso
contract kontrak inkontileka
briefing inligtingsessie clarification opklaring
appointment aanstelling appoint aanstel
panel paneel framework raamwerk
municipality munisipaliteit umasipala municipal munisipale
department departement umnyango
province provinsie isifundazwe provincial provinsiale
"""
#: Words that queries do not search for.
STOPWORDS = frozenset("the of for and a an to in on at by van die en vir 'n".split())


def synonym_index(groups: str = SYNONYMS) -> dict[str, tuple[str, ...]]:
    """word -> all words of its groups, itself included; a word of several groups has their union."""
    index: dict[str, dict[str, None]] = {}
    for line in groups.lower().splitlines():
        words = line.split()
        for word in words:
            index.setdefault(word, {}).update(dict.fromkeys(words))
    return {word: tuple(group) for word, group in index.items()}


@dataclass(frozen=True)
class Term:
    """Alternatives of which one must occur, each a sequence of adjacent words; or, negated, none may."""

    options: tuple[tuple[str, ...], ...]
    negated: bool = False


def clean(text: str) -> list[str]:
    return re.sub(r"[^\w\s'/-]", " ", text).split()


def tokens(query: str | None, either: bool = False) -> list[tuple[str, bool, bool]]:
    """(text, negated, phrase) of quoted phrases and words; a leading minus negates. Noise words go; with ``either`` a bare "or" stays."""
    kept = "".join(c for c in query or "" if c == "\t" or c >= " ")
    out = []
    for minus_q, quoted, minus_w, word in re.findall(r'(-?)"([^"]*)"|(-?)(\S+)', kept):
        if not word:
            words = clean(quoted)
            if words:
                out.append((" ".join(words), minus_q == "-", True))
        elif word.lower() in ("or", "and"):
            if either and word.lower() == "or":
                out.append(("or", False, False))
        else:
            for part in clean(word):
                if part.lower() not in STOPWORDS and any(c.isalnum() for c in part):
                    out.append((part, minus_w == "-", False))
    return out


def parts(word: str) -> tuple[str, ...]:
    """A word with marks in it is a phrase of its parts."""
    return tuple(re.findall(r"\w+", word.lower()))


def expand(query: str | None, index: dict[str, tuple[str, ...]] | None = None) -> list[Term]:
    """The query's terms with synonyms; phrases stay as written. A negation never excludes what another word asks for."""
    index = synonym_index() if index is None else index
    found = tokens(query)
    wanted = {s for text, negated, phrase in found if not negated and not phrase for s in index.get(text.lower(), (text.lower(),))}
    terms = []
    for text, negated, phrase in found:
        word = text.lower()
        options = (word,) if phrase else index.get(word, (word,))
        if negated and not phrase:
            options = tuple(o for o in options if o == word or o not in wanted)
        terms.append(Term(tuple(p for o in options if (p := tuple(x for w in o.split() for x in parts(w)))), negated))
    return [t for t in terms if t.options]


def literal(query: str | None) -> list[list[Term]]:
    """The query as typed, as alternatives of conjunctions: a bare "or" between words separates alternatives."""
    out: list[list[Term]] = [[]]
    joined = False
    for text, negated, phrase in tokens(query, either=True):
        if text == "or" and not phrase:
            joined = bool(out[-1])
            continue
        words = tuple(x for w in text.split() for x in parts(w))
        if not words:
            continue
        term = Term((words,), negated)
        if joined:
            # "or" binds the words next to it more loosely than the words between
            out.append([])
            joined = False
        out[-1].append(term)
    return [c for c in out if c]
