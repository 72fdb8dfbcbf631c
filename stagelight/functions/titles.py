"""Title functions as columns: cleaning, normalising, slugs, variants and classes."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from stagelight.operators.search import folded

#: Programme names before a colon, bar or dash that are no part of a title.
PREFIXES = """
saturday morning picture club; kids club; kids' club; family film club; family film; toddler time; toddler club; big scream; baby club
london premiere; uk premiere; world premiere; europe premiere; european premiere; preview; sneak preview; advance screening; special screening
member screening; members screening; member's screening; members' screening; relaxed screening; dog friendly screening; naturist screening
35mm; 70mm; 70mm imax; imax; 4k restoration; restoration; director's cut; directors cut
cult classic; cult classics; classic; classics; throwback thursday; flashback; film club; cinema club; late night; midnight madness
double bill; double feature; triple bill; marathon; retrospective; q&a; live q&a; with q&a
sing-along; sing along; singalong; quote-along; quote along; quotealong
christmas classic; christmas classics; holiday film; festive film; galentine's day; galentines day; valentine's day; valentines day; valentine's throwback
dochouse; pink palace; classic matinee; silver screen; seniors matinee; seniors' matinee; seniors paid matinee; seniors' paid matinee; seniors free matinee; seniors' free matinee
queer horror night; queer horror nights; varda film club; awards lunch; bar trash; pitchblack playback; phoenix classic; phoenix classics; the liberated film club
surreal sinema; sürreal sinema; never watching movies; drink & dine; drink dine; rbo; rbo encore; roh encore; encore; nt live; met opera
screen cuba presents; shasha movies presents; lafs presents; lost reels; funeral parade presents; queer east presents; girls in film presents; east london doc club
woman with a movie camera preview; beyond; japanese film club; skateboard film club; offbeat folk film festival; rio forever; spare ribs club
parent and baby screening; parents and babies screening; bloody mary film club; cine-real presents; cinereal presents; club room; camp classics presents; better than nothing presents
""".replace("\n", "; ").strip("; ").split("; ")
#: Endings of programme names that any name may stand before.
PRESENTERS = ["film club", "film festival", "film collective", "film society", "films"]
#: Endings in brackets or after a dash.
SUFFIXES = ["35mm", "70mm", "imax", "3d", "4k restoration", "4k remaster", "director's cut", "directors cut", "subtitled", "with subtitles", "q&a", "intro", "live score", "sold out", "extended cut", "final cut", "anniversary", "preview", "sing-along", "relaxed"]
#: Events by pattern, the first that fits being the main one.
EVENTS = [
    ("quiz", r"\bquiz\b"), ("restoration_premiere", r"\brestoration\s+premiere\b"), ("premiere", r"\bpremiere\b"), ("preview", r"\bpreview\b"), ("singalong", r"\bsing[\s-]*a[\s-]*long\b"), ("quote_along", r"\bquote[\s-]*a[\s-]*long\b"),
    ("q_and_a", r"\bq\s*&\s*a\b"), ("intro", r"\bintro(?:duced)?\s+by\b|\+\s*intro\b|\bwith\s+intro\b"), ("discussion", r"\bpanel\s+discussion\b|\+\s*discussion\b"), ("double_bill", r"\bdouble\s+(?:bill|feature)\b|\b2\s+films\b"),
    ("marathon", r"\bmarathon\b"), ("anniversary", r"\b\d+(?:st|nd|rd|th)\s+anniversary\b|\banniversary\s+screening\b"), ("members_only", r"\bmembers[\s']*only\b|\bmembership\s+screening\b"), ("relaxed", r"\brelaxed\s+(?:screening|film|cinema)\b"),
]
#: Formats by pattern, the narrower before the wider.
FORMATS = [
    ("70mm_imax", r"\b70mm\s+imax\b"), ("70mm", r"\b70\s?mm\b"), ("35mm", r"\b35\s?mm\b"), ("imax_laser", r"\bimax\s+(?:with\s+)?laser\b"), ("imax", r"\bimax\b"), ("dolby_cinema", r"\bdolby\s+cinema\b"), ("4dx", r"\b4dx\b"), ("screenx", r"\bscreenx\b"),
    ("dcp_4k", r"\b4k\s+(?:restoration|remaster(?:ed)?)\b|\(4k\)"),
]
#: What else an entry offers, by pattern; subtitles by language.
ACCESS = [("3d", r"\b(?:in\s+)?3d\b|\b3-d\b"), ("relaxed", r"\brelaxed\s+(?:screening|film|cinema|performance)\b"), ("subtitles", r"\bsubtitles?\b|\bsubtitled\b|\bsubt\b|\bcc\b(?!\s*\.)"), ("audio_description", r"\baudio[\s-]+described?\b")]
SUBTITLES = [("fr", "french"), ("de", "german"), ("es", "spanish"), ("it", "italian"), ("en", "english"), ("ja", "japanese")]
#: Entries that are no films, by pattern, and broadcasts and concerts.
NOT_FILMS = ["^(?:quiz|trivia)\\b", "\\bquiz\\s*night\\b", "^cafés?\\s+philo", "^come\\s+and\\s+sing", "^private\\s+hire", "^reading\\s+group", "^baby\\s+comptines", "\\bmusical\\s+bingo\\b", "\\bcomedy\\s+(?:club|night)\\b", "\\bmember\\s+(?:poll|quiz)\\b", "\\bin\\s+conversation\\s+with\\b"]
BROADCASTS = ["national theatre live", "nt live", "met opera live", "met opera encore", "royal opera house", "the royal opera", "roh live", "roh encore", "roh cinema", "royal ballet", "bolshoi ballet", "rbo cinema season", "rbo encore", "rbo cinema", "exhibition on screen"]
CONCERTS = r"\bin\s+concert\b|\b(?:live|concert|tour|performance)\b.*\b(?:anniversary|tribute)\b|\b(?:anniversary|tribute)\b.*\b(?:live|concert|tour|performance)\b"
KEYWORDS = ["quiz", "comedy night", "open mic", "workshop", "karaoke", "market", "book club", "party"]


#: Programme names that the blocklist and the programme's own rule leave out, what a plus may offer, and quotes and dashes with their plain forms.
BLOCKLIST_PREFIXES = ["film club", "doc'n roll x rio", "funeral parade presents", "screen cuba presents", "classic matinee", "lost reels", "classics night", "japanese film club", "tv party, tonight!", "lafs presents", "east london doc club"]
PROGRAMME_PREFIXES = """
relaxed screening; tv preview; preview; member picks; member exclusive; member salon; bfi member poll; uk premiere; uk premiere of 4k restoration; woman with a movie camera preview; funday; 25 and under
the war trilogy; the solidarity trilogy; season introduction talk + world premiere; opening night; closing night; family funday preview; library event; ghibliotheque presents; kinoteka gala screening
milktea presents – uk premiere; galentine's day; reece shearsmith presents; tribute to claudia cardinale
""".replace("\n", "; ").strip("; ").split("; ")
OFFERS = ["intro", "q&a", "extended intro", "pre-recorded intro", "discussion", "panel"]
CURLY, STRAIGHT = "‘’ʼ“”–—", "'''\"\"--"
#: Names of references that stand for one byte each where two or more follow each other.
BYTE_NAMES = """
Atilde Acirc Aring AElig Ccedil Egrave Eacute Euml Iacute Icirc Ntilde Ograve Oacute Ouml Uacute Uuml iexcl cent pound curren yen brvbar sect uml copy ordf laquo not shy reg macr
deg plusmn sup2 sup3 acute micro para middot cedil sup1 ordm raquo frac14 frac12 frac34 iquest
""".split()
#: Names of references and what they stand for.
NAMES = {
    "amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "nbsp": " ", "rsquo": "’", "lsquo": "‘", "hellip": "…", "mdash": "—", "ndash": "–", "frac12": "½", "frac14": "¼", "frac34": "¾",
}


def _rewritten(text: Column, pattern: str, by: Callable[[Column], Column]) -> Column:
    """The text with each match of a pattern that starts with & put through a function; a null from it leaves the match as it is."""
    parts = F.regexp_extract_all(text, F.lit(rf"{pattern}|&[^&]*|[^&]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda part: F.when(part.rlike(f"^(?:{pattern})$"), F.coalesce(by(part), part)).otherwise(part)), "")


def _of_code(digits: Column) -> Column:
    """The character of a code point in hexadecimal digits; null for surrogates and beyond the last one."""
    code = F.lpad(F.upper(F.regexp_replace(digits, "^0+(?=.)", "")), 8, "0")
    fits = (F.length(F.regexp_replace(digits, "^0+(?=.)", "")) <= 6) & (code <= "0010FFFF") & ~code.between("0000D800", "0000DFFF")
    return F.when(fits, F.decode(F.unhex(code), "UTF-32"))


def _mended(run: Column) -> Column:
    """UTF-8 that was written as one reference a byte; null where a name stands for no byte or the bytes are no UTF-8."""
    of_name = F.create_map(*(F.lit(x) for name in BYTE_NAMES for x in (name, f"{name2codepoint[name]:02X}")))
    bytes_ = F.transform(F.regexp_extract_all(run, F.lit("&([A-Za-z0-9]+);"), F.lit(1)), lambda name: F.try_element_at(of_name, name))
    return F.when(~F.exists(bytes_, lambda b: b.isNull()), F.try_validate_utf8(F.unhex(F.array_join(bytes_, "")).cast("string")))


def references_decoded(text: Column) -> Column:
    """Character references resolved in this order: runs of names that spell the bytes of UTF-8, hexadecimal numbers, decimal ones, names. Unknown ones stay."""
    names = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    text = _rewritten(text, "(?:&[A-Za-z0-9]+;){2,}", _mended)
    text = _rewritten(text, "&#[xX][0-9A-Fa-f]+;", lambda r: _of_code(F.regexp_extract(r, "[xX](.*);", 1)))
    text = _rewritten(text, "&#[0-9]+;", lambda r: _of_code(F.hex(F.regexp_extract(r, "#(.*);", 1).try_cast("bigint"))))
    return _rewritten(text, "&[A-Za-z0-9]+;", lambda r: F.try_element_at(names, F.regexp_extract(r, "&(.*);", 1)))


def decoded(text: Column) -> Column:
    """Character references resolved, and UTF-8 read as Latin-1 mended for letters with marks."""
    text = F.when(F.contains(text, F.lit("&")), references_decoded(text)).otherwise(text)
    for found, by in (("Ã©", "é"), ("Ã¨", "è"), ("Ã¼", "ü"), ("Ã¶", "ö"), ("â€™", "’"), ("â€“", "–")):
        text = F.replace(text, F.lit(found), F.lit(by))
    return text


def without_markup(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "<[^>]*>", ""))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _either(words: list[str]) -> str:
    """A pattern of these words, the longest first, with blanks of any width."""
    return "|".join(w.replace("+", r"\+").replace(" ", r"\s+") for w in sorted(words, key=lambda w: (-len(w), w)))


def _programme() -> str:
    """A programme name and what parts it from the title; without a mark only for premieres."""
    return rf"^\s*(?:({_either(PREFIXES)})\s*[:|\-–]\s*|((?:london|uk|world|european?)\s+premiere)\s+|([\w\s&'’-]+\s(?:{_either(PRESENTERS)})\s+presents?)\s*[:|\-–]\s*)"


def prefix_of(title: Column) -> Column:
    """The programme name that a title begins with, or null."""
    found = F.concat(*(F.regexp_extract(F.lower(title), _programme(), i) for i in (1, 2, 3)))
    return F.when(found != "", found)


def cleaned(title: Column) -> Column:
    """Without references, programme name, format and version endings (three times over) and a trailing year."""
    text = squeezed(decoded(title))
    for _ in range(2):  # a programme within a programme
        text = F.regexp_replace(text, "(?i)" + _programme(), "")
    for _ in range(3):
        text = F.regexp_replace(text, rf"(?i)\s*([\(\[]\s*({_either(SUFFIXES)})[^\)\]]*[\)\]]|[-–+|]\s*({_either(SUFFIXES)})\b.*)\s*$", "")
    text = F.regexp_replace(text, r"\s*[\(\[](18|19|20)\d\d[\)\]]\s*$", "")
    return F.trim(text)


def year_in(title: Column) -> Column:
    """A year in brackets at the end, if it can be one."""
    year = F.regexp_extract(title, r"[\(\[]((?:18|19|20)\d\d)[\)\]]\s*$", 1).try_cast("int")
    return F.when(year.between(1880, 2100), year)


def normalised(title: Column) -> Column:
    """Cleaned, small, without marks or a leading article, letters, digits and blanks only."""
    text = F.regexp_replace(folded(cleaned(title)), r"^the\s+", "")
    return squeezed(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", ""))


def normalised_ascii(title: Column) -> Column:
    """The season linker's rule: everything but ASCII word characters and blanks goes, so letters with marks are lost."""
    return squeezed(F.regexp_replace(F.lower(title), r"[^a-z0-9_\s]", ""))


def normalised_before_colon(title: Column) -> Column:
    """The catalogue rule: without brackets and what follows a colon."""
    return squeezed(F.regexp_replace(F.regexp_replace(F.lower(title), r"\([^)]*\)", ""), r":.*$", ""))


def normalised_after_colon(title: Column) -> Column:
    """The ratings rule: what follows a colon, if anything does."""
    after = F.regexp_extract(title, r":\s*(.+)$", 1)
    return squeezed(F.lower(F.when(after != "", after).otherwise(title)))


def normalised_without_articles(title: Column) -> Column:
    """The fallback rule: no leading the, a or an."""
    return squeezed(F.regexp_replace(F.lower(title), r"^(the|an|a)\s+", ""))


def normalised_for_seasons(title: Column) -> Column:
    """The season pipeline's rule: no leading article, ASCII word characters and blanks only."""
    return squeezed(F.regexp_replace(F.regexp_replace(F.lower(title), r"^the\s+", ""), r"[^a-z0-9_\s]", ""))


def normalised_for_cleanup(title: Column) -> Column:
    """The catalogue clean-up's rule: that of the season pipeline, on the cleaned title."""
    return normalised_for_seasons(cleaned(title))


def normalised_for_checks(title: Column) -> Column:
    """The quality check's rule: without article, closing bracket and what follows a colon; straight quotes, plain dashes, and ASCII words with either."""
    text = F.regexp_replace(F.trim(F.lower(title)), r"^the\s+", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\s*\([^)]*\)\s*$", ""), r"\s*:.*$", "")
    return squeezed(F.regexp_replace(F.translate(text, CURLY, STRAIGHT), r"[^a-z0-9_\s'-]", ""))


def normalised_for_blocklist(title: Column) -> Column:
    """The blocklist's rule: without its programme names, an offer behind a plus, a closing bracket and quotes."""
    text = F.regexp_replace(F.trim(F.lower(title)), rf"^(?:{_either(BLOCKLIST_PREFIXES)}):\s*", "")
    text = F.regexp_replace(text, rf"\s*\+\s*(?:{_either(OFFERS)})\s*$", "")
    return F.trim(F.translate(F.regexp_replace(text, r"\s*\([^)]*\)\s*$", ""), "\"“”", ""))


def normalised_in_two_stages(title: Column) -> Column:
    """The programme's rule: first without its programme names, offers, closing bracket and article; then without marks, with signs spelled out."""
    text = F.regexp_replace(F.lower(title), rf"^(?:(?:{_either(PROGRAMME_PREFIXES)}):\s*|\d+(?:st|nd|rd|th) anniversary(?: screening)?:\s*|seniors' (?:free |paid )?matinee:\s*)", "")
    text = F.regexp_replace(text, rf"\s*\+\s*(?:{_either([*OFFERS[:5], 'in conversation'])}).*$", "")
    text = squeezed(F.regexp_replace(F.regexp_replace(text, r"\s*\([^)]*\)\s*$", ""), r"^the\s+", ""))
    return squeezed(F.replace(F.replace(folded(F.translate(text, CURLY, STRAIGHT)), F.lit("½"), F.lit(" 1/2")), F.lit("&"), F.lit("and")))


def normalised_gently(title: Column) -> Column:
    """The gap filler's rule: without marks and article, letters and digits of any script."""
    return squeezed(F.regexp_replace(F.regexp_replace(folded(title), r"^the\s+", ""), r"[^\p{L}\p{N}\s]", ""))


def normalised_exactly(title: Column) -> Column:
    """The exact match's rule: without marks, a blank for every other sign."""
    return squeezed(F.regexp_replace(folded(title), r"[^\p{L}\p{N}\s]", " "))


def without_marks(title: Column) -> Column:
    """The client index's rule: small letters without marks, nothing else; null if empty."""
    return F.nullif(folded(title), F.lit(""))


def letters_only(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), "[^a-z0-9]", "")


def bracketed_english(title: Column) -> Column:
    """The title in brackets, where the one outside has letters beyond ASCII; else null."""
    inner, outer = F.regexp_extract(title, r"\(([A-Za-z0-9 ,.'!?&:-]+)\)\s*$", 1), F.regexp_replace(title, r"\([^)]*\)\s*$", "")
    return F.when((inner != "") & outer.rlike(r"[^\x00-\x7F]"), F.trim(inner))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(folded(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def variants(title: Column) -> Column:
    """Search variants in order, each once: as it is, cleaned, before and after a colon, with and without an article."""
    clean = cleaned(title)
    before = F.trim(F.regexp_replace(clean, r":.*$", ""))
    bare = F.regexp_replace(clean, r"(?i)^(the|an|a)\s+", "")
    return F.filter(F.array_distinct(F.array(F.trim(title), clean, before, F.trim(F.regexp_extract(clean, r":\s*(.+)$", 1)), bare, F.concat(F.lit("The "), bare))), lambda v: v != "")


def events(text: Column) -> Column:
    """Kinds of event that a text tells of, the main one first."""
    return F.array_compact(F.array(*(F.when(F.lower(text).rlike(p), kind) for kind, p in EVENTS)))


def formats(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(F.lower(text).rlike(p), kind) for kind, p in FORMATS)))


def access(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(F.lower(text).rlike(p), kind) for kind, p in ACCESS)))


def subtitle_language(text: Column) -> Column:
    """The first language of subtitles that is named, or null."""
    return F.coalesce(*(F.when(F.lower(text).rlike(rf"\b{name}\s+(?:subtitles|st)\b" if code == "en" else rf"\b{name}\s+subtitles\b"), code) for code, name in SUBTITLES))


def season_in(title: Column) -> Column:
    """The season, series or presenter before a colon, or null."""
    found = F.regexp_extract(title, r"(?i)^([A-Z][^:]{4,80}?\s+(?:Season|Retrospective|Series|Festival|Programme|Strand|presents?))\s*:", 1)
    return F.when(found != "", found)


def content_class(title: Column) -> Column:
    low = F.trim(F.lower(title))
    return F.when(low.rlike("|".join(NOT_FILMS)), "event").when(low.rlike(rf"^(?:{_either(BROADCASTS)})[:\s]|^berliner\s+philharmoniker"), "live_broadcast").when(low.rlike(CONCERTS), "concert").otherwise("film")


def not_a_film(title: Column) -> Column:
    """Why an entry is likely no film: a pattern, a keyword, or null. The cleaned title is asked before the raw one."""
    why = lambda t: F.when(F.lower(t).rlike(r"^(closed|private hire|tbc)\b"), "pattern").when(F.lower(t).rlike(_either(KEYWORDS)), "keyword")
    return F.coalesce(why(cleaned(title)), why(title))


def smart_case(title: Column) -> Column:
    """Titles all in capitals (10 characters, a blank and 4 capitals at least) in title case; words of capitals and digits or dots stay."""
    capitals = F.length(F.regexp_replace(title, "[^A-Z]", ""))
    shouted = (F.length(title) >= 10) & F.contains(title, F.lit(" ")) & (capitals >= 4) & (F.upper(title) == title)
    words = F.transform(F.split(title, " "), lambda w: F.when(w.rlike(r"[0-9.]"), w).otherwise(F.initcap(w)))
    return F.when(shouted, F.array_join(words, " ")).otherwise(title)


def flags(title: Column) -> dict[str, Column]:
    """What is unclean about a title."""
    return {"has_prefix": prefix_of(title).isNotNull(), "has_suffix": F.lower(title).rlike(rf"[\(\[]\s*({_either(SUFFIXES)})"), "has_year": year_in(title).isNotNull(), "not_film": not_a_film(title).isNotNull(), "shouted": smart_case(title) != title}
