"""Problem 10: personal information inside free text.

Method: offset-preserving deobfuscation. Transducers bring a text to a plain form - composed letters,
ordinary spaces, hyphens and digits, no invisible characters, look-alike letters inside Latin words,
digits spelled in a row, at and dot disguises - and keep for every character where it came from.
Identifiers are found in the plain form; their spans go back to the source, which stays as it is.

Given names are a fixed list and those learned over all texts from telling places: after a title or a
lead-in, or where an address in the same text has the name in its local part.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "phone", "id_number", "address", "name")

#: Look-alike letters of other scripts.
LOOKALIKE = dict(zip("аеорсухіјѕԁһАВЕКМНОРСТХІЈЅαονρτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhABEKMHOPCTXIJSaovptABEZHIKMNOPTYX", strict=True))
#: Digits as words.
SPELLED = {w: str(d) for d, ws in enumerate(("zero oh null cero zéro", "one eins ein un une uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve")) for w in ws.split()}
#: Given names.
GIVEN = (
    "Alexander Alice Álvaro Ana Andrea Anna Annika Antoine Begoña Callum Camille Carlos Carmen Chloé Claire Daniel David Declan Desmond Elena Élodie Emma Farah Felix Fernando François Gaspard Greta Hannah Hans Hazel Heike Imogen Íñigo Jan Javier Joaquín John Jonas José Juan Julia Jürgen Laura Lennart Léa Lucas Lucía Luis Lukas Manon "
    "Marcus María Marie Matthias Mathieu Michael Miguel Naomi Nerea Nicolas Océane Olivia Owen Pablo Paul Peter Pierre Priya Rémi Robert Rocío Rohan Sarah Sofía Solène Sophie Svenja Tessa Thibault Thomas Tomás Torben Wiebke William Aïcha Yasmin"
).split()
#: Capitalised words before a comma or a name that are no family names.
NOT_FAMILY = set("gruß grüße saludo hallo hi hello dear thanks regards hola bonjour cordialement merci danke liebe lieber candidate candidat kandidat the a an this our we your you in at on by for and und et y les le la el los das der die sie vous nous this team after before best kind re fw cc to from mr mrs ms dr herr frau mme m sr sra plan section phase grade room".split())
_SEP = r"[ \t]"

_ODD = re.compile(r"[^\x00-\x7f\u00a1-\u024f]")
_COMBINED = re.compile(r"[^\W\d_][\u0300-\u036f]+")
_MARKS, _OTHER_SCRIPTS = re.compile(r"[\u0300-\u036f]"), re.compile(r"[\u0370-\u03ff\u0400-\u04ff]")
_INVISIBLE = re.compile(r"[\u200b-\u200f\u2060\ufeff\u00ad]+")
_NUMBER_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_SPELLED_RUN = re.compile(rf"\b(?:{_NUMBER_WORD})(?:[ \-,]+(?:{_NUMBER_WORD})){{6,}}\b", re.I)


class Plain:
    """A plain form and, for each of its characters and its end, the place in the source."""

    def __init__(self, text: str):
        self.text, self.at = text, None

    def sub(self, pattern: re.Pattern, change) -> None:
        """Replace matches; the characters of a replacement all come from the whole match."""
        out, at, last = [], [], 0
        old = self.at or range(len(self.text) + 1)
        for m in pattern.finditer(self.text):
            new = change(m)
            if new == m.group():
                continue
            a, b = m.span()
            out.append(self.text[last:a])
            at.extend(old[last:a])
            out.append(new)
            n, width = len(new), b - a
            at.extend(old[a + min(width - 1, k * width // max(n, 1))] if k else old[a] for k in range(n))
            last = b
        if out:
            out.append(self.text[last:])
            at.extend(old[last:])
            self.text, self.at = "".join(out), at

    def span(self, a: int, b: int, source: str) -> tuple[int, int]:
        """Source span of the plain span a to b."""
        return (a, b) if self.at is None else (self.at[a], self.at[b])


def plain(text: str) -> Plain:
    """The plain form of a text, but for at and dot disguises, which are read where an address is sought."""
    p = Plain(text)
    if "\xa0" in text or "\xad" in text or _ODD.search(text):
        p.sub(_INVISIBLE, lambda m: "")
        if _MARKS.search(text):
            p.sub(_COMBINED, lambda m: unicodedata.normalize("NFC", m.group()))
        p.sub(re.compile(r"[\u00a0\u2000-\u200a\u202f\u205f\u3000]"), lambda m: " ")
        p.sub(re.compile(r"[\u2010-\u2012\u2212\ufe63\uff0d]"), lambda m: "-")
        p.sub(re.compile(r"[\u2018\u2019\u02bc]"), lambda m: "'")
        p.sub(re.compile(r"[\uff01-\uff5e\u0660-\u0669\u06f0-\u06f9\U0001d7ce-\U0001d7ff]"), lambda m: unicodedata.normalize("NFKC", m.group()) if m.group() not in "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹" else str(unicodedata.digit(m.group())))
        if _OTHER_SCRIPTS.search(p.text):
            p.sub(re.compile(r"(?=\w*[A-Za-z])\w*[\u0370-\u03ff\u0400-\u04ff]\w*"), lambda m: "".join(LOOKALIKE.get(c, c) for c in m.group()))
    # Seven number words in a row: five of them at least stand free of other signs.
    if sum(map(SPELLED.__contains__, p.text.lower().replace("-", " ").replace(",", " ").split())) >= 5:
        p.sub(_SPELLED_RUN, lambda m: "".join(SPELLED[w] for w in re.findall(r"[^\W\d_]+", m.group().lower())))
    return p


_AT_SIGN = re.compile(r"@|[\[({<][ \t]*(?:at|arobase|arroba|ät|klammeraffe|a|@)[ \t]*[\])}>]|(?<=[ \t])(?:at|arobase|arroba)(?=[ \t])", re.I)
_AT = re.compile(r"[ \t]?@[ \t]?|[ \t]*[\[({<][ \t]*(?:at|arobase|arroba|ät|klammeraffe|a|@)[ \t]*[\])}>][ \t]*|[ \t]+(?:at|arobase|arroba)[ \t]+", re.I)
_DOT = r"(?:[ \t]*[\[({<][ \t]*(?:dot|point|punkt|punto|\.)[ \t]*[\])}>][ \t]*|[ \t]+(?:dot|point|punkt|punto)[ \t]+|\.)"
_LOCAL = re.compile(rf"(?<![\w.+%-])[\w+%-]+(?:{_DOT}[\w+%-]+)*$", re.I)
_LOCAL_END = re.compile(r"^[\w.+%-]+$")
_DOMAIN = re.compile(rf"[^\W_](?:[\w-]*[^\W_])?(?:{_DOT}[^\W_](?:[\w-]*[^\W_])?)*{_DOT}[^\W\d_]{{2,}}(?![\w-])", re.I)
_EXT = r"(?:[ \t]?,?[ \t]?(?:ext\.?|extension|x|poste|anexo|durchwahl|dw\.?|apdo)[ \t]?\d{1,6})?"
_PHONE = re.compile(
    rf"(?<![\w.+/#-])(?<!\d[ ,])(?:"
    rf"(?:\+|00)1[ .-]?\(?\d{{3}}\)?[ ./-]?\d{{3}}[ .-]?\d{{4}}"
    rf"|(?:1[ .-])?(?:\(\d{{3}}\)[ ]?|\d{{3}}[ ./-])\d{{3}}[ .-]?\d{{4}}"
    rf"|\(?(?:\+|00)44\)?[ ]?(?:\(0\)[ ]?)?\d{{2,5}}[ -]?\d{{3,4}}[ -]?\d{{3,4}}"
    rf"|07\d{{3}}[ -]?\d{{3}}[ -]?\d{{3}}"
    rf"|\(?(?:\+|00)33\)?[ ]?(?:\(0\)[ ]?)?[1-9](?:[ .-]?\d\d){{4}}"
    rf"|0[1-9](?:[ .-]\d\d){{4}}"
    rf"|\(?(?:\+|00)49\)?[ -]?(?:\(0\)[ ]?)?\(?\d{{2,4}}\)?(?:[ ]?[ /-][ ]?|)\d{{3,8}}(?:[ -]\d{{1,4}})?"
    rf"|\(?0\d{{2,4}}\)?[ ]?[ /-][ ]?\d{{5,8}}(?:[ -]\d{{1,4}})?"
    rf"|\(?(?:\+|00)34\)?[ ]?[6-9]\d\d[ .-]?\d{{3}}[ .-]?\d{{3}}"
    rf"|[67]\d\d(?:[ .-]\d{{3}}[ .-]\d{{3}}|[ .-]\d\d[ .-]\d\d[ .-]\d\d)"
    rf"|\(?\+\d{{1,3}}\)?(?:[ ./-]?\(?\d{{1,5}}\)?){{2,5}}"
    rf"){_EXT}(?![\w]|[.,/-]\d|[ ]?[€$%]| \d{{2,}})",
    re.I,
)
_BARE_PHONE = re.compile(r"(?<!\d)\d{9,11}(?![\w-])")
_BARE_LABEL = re.compile(r"(?i)(?:tel|tél|phone|call|text|mobile?|móvil|portable|voice mail|reach us on|llama al|rufen sie|appelez le|handy|fax)[.:]{0,2}$")
_NOT_PHONE = re.compile(r"(?i)(?:invoice|order no\.?|order|ticket|ref\.?|budget code|coordinates|release|version|pay band|grade|requisition|rechnung|facture|factura|phase|iso)[ \t]*[#:.]?[ \t]*$")
_ID_LABEL = re.compile(
    r"(?i)(?<![\w])(?:social insurance|social security|sécurité sociale|seguridad social|sozialversicherungs?(?:nummer|nr)?|sv-?n(?:umme)?r|s\.?i\.?n|s\.?s\.?n|n\.?a\.?s|n\.?i\.?r|n\.?i\.?f|n\.?i\.?e|d\.?n\.?i|nss|n[°º] de sécu\w*|número fiscal|insurance number|número de seguro social|steuer-?(?:id|nummer|nr|identifikationsnummer)|steuer|idnr|tax(?:payer)?(?: id(?:entification)?)?|numéro fiscal|num[ée]ro d[e']\w*(?: sociale| fiscal)?|nº fiscal|passport|passeport|reisepass|pass|passnummer|pasaporte|travel document|document de voyage|documento(?: de \w+)?|reisedokument|identity(?: card| document)?|identidad|national id(?:entity)?|national insurance|id card|personalausweis|ausweis|carte d'identité|pièce d'identité|titre de séjour|identifiant fiscal|número de \w+)"
    r"(?:nummer|-nr)?\.?(?:[ \t]*(?:card|number|no|num|núm|numéro|número|nummer|nr|n°|nº|n\.º|id|#)\.?)*[ \t]*(?:[:=#]|is|ist|lautet|est|es)?[ \t]*(?=[\dA-Za-z])"
)
_ID_VALUE = re.compile(
    r"(?:\d \d\d \d\d \d\d \d{3} \d{3}(?: \d\d)?|\d{2} \d{6} [A-Za-z] \d{3}|\d{3}[ .-]\d{2}[ .-]\d{4}|\d{2}[ .]\d{3}[ .]\d{3}[ .]\d{3}|\d{3}\.\d{3}\.\d{3}-\d\d|\d{3}[ .-]\d{3}[ .-]\d{3}(?!\d)|\d{3}/\d{4}/\d{4}|\d{2}[./]\d{3}[./]\d{3}[-.]?[A-Za-z0-9]?|[A-Z]{2} \d\d \d\d \d\d [A-Z]|[A-Z]\d{3}[A-Z]\d{4}|[XYZxyz]-?\d{7}-?[A-Za-z]|\d{7,8}-?[A-Za-z]|[A-Za-z]{1,3}[ -]?\d{5,9}[A-Za-z]?|\d{2}[A-Z]{2}\d{5}|\d{8,15}|(?=[A-Z0-9]*\d[A-Z0-9]*\d[A-Z0-9]*\d)[A-Z0-9]{7,14})(?![\w]|-\d)"
)
_FIVE = re.compile(r"\d(?:[ ./-]?[A-Za-z]{0,3}[ ./-]?\d){4}")
_PLACE_END = r"(?![\w-])"
_HOUSE = r"\d{1,5}[A-Za-z]?"
_UNIT = r"(?:,?[ ](?:Apt\.?|Unit|Suite|Flat|Ste\.?|No\.?|#|app\.|apt\.?|bureau|étage|Whg\.?|piso|puerta)[ ]?#?[\w-]{1,5}|,?[ ]#[ ]?\w{1,5}|,?[ ]\d{1,2}\.?[ºª°](?:[ ]?[A-Za-z])?(?![\w])|[ ]//[ ]?\w+)?"
_ADDRESS = [
    re.compile(rf"(?<![\w.,/#-]){_HOUSE}[ ](?:(?:North|South|East|West|[NSEW]\.|Old|New|Upper|Lower|Great|Little)[ ])*(?:[A-Z][a-z']+[ ]){{1,2}}(?:Road|Street|Lane|Avenue|Terrace|Crescent|Court|Way|Boulevard|Drive|Place|Square|Close|Row|Hill|Gardens|Grove|Walk|Mews|Parade|Blvd|Ave|Rd|Ln|Dr|Ct|Cres|Pl|St\.?){_PLACE_END}(?:(?<=St)|{_UNIT})"),
    re.compile(rf"(?<![\w.,/#-])\d{{1,4}}(?:[ ]?(?:bis|ter|quater|[A-D]))?,?[ ](?:rue|avenue|av\.|boulevard|boul\.|bd\.?|chemin|impasse|place|allée|quai|route|square|cours|passage|ruelle)[ ](?:(?:de[ ]la|de[ ]l'|de|du|des|d'|l'|la|le|les)[ ]?)?[A-ZÀ-Ý][\w'-]*(?:[ ](?:(?:de[ ]la|de|du|des|d')[ ]?)?[A-ZÀ-Ý][\w'-]+){{0,2}}{_UNIT}"),
    re.compile(r"(?<![\w-])(?:[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|allee|platz|gasse|ring|damm|ufer|steig|hof|markt)|(?:Am|An der|An den|Im|In der|Auf der|Auf dem|Zum|Zur|Unter den|Hinter der|Alte|Alter|Neue|Große|Kleine)[ ](?:[A-ZÄÖÜ][\wäöüß-]*[ ]?){1,3})[ ]?\d{1,4}(?:[ ]?[a-z](?![\w]))?(?![\w])" + _UNIT),
    re.compile(rf"(?<![\w])(?:Calle|C/|Avda\.?|Avenida|Paseo|Pº|Plaza|Pza\.?|Camino|Ronda|Travesía|Carretera|Ctra\.?|Callejón)[ ](?:(?:de[ ]la|de[ ]los|de[ ]las|del|de|la|el|los|las)[ ])?[A-ZÁÉÍÓÚÑ][\w'-]*(?:[ ](?:(?:de[ ]la|de[ ]los|de[ ]las|del|de|y)[ ])?[A-ZÁÉÍÓÚÑ][\w'-]+){{0,3}},?[ ](?:n\.?º[ ]?|núm\.[ ]?|n°[ ]?|nº[ ]?)?\d{{1,4}}(?:[ ]?(?:bis|[A-D]))?(?![\w]){_UNIT}"),
]
_TYPE_WORD = re.compile(r"(?:Road|Street|Lane|Avenue|Drive|Way|Court|Place|Square|Close|Row|Hill|Walk|Grove)$")
_PART = r"(?:[OD]'|Mc|Mac)?[^\W\d_a-zà-öø-ÿ](?:[a-zà-öø-ÿß]+|[A-ZÀ-ÖØ-Þ']+)"
_FAMILY = rf"{_PART}(?:-{_PART})*"


@lru_cache(maxsize=4)
def _named(learned: tuple[str, ...] = ()) -> re.Pattern:
    """Names with a given name of the list or a learned one."""
    given = "|".join(sorted({re.escape(unicodedata.normalize("NFC", v)) for n in (*GIVEN, *learned) for v in (n, n.upper())}, key=len, reverse=True))
    _G = rf"(?:{given})(?:-(?:{given}))?"
    return re.compile(rf"(?<![\w@.'+-])(?:(?P<f1>{_FAMILY}),[ ](?:{_G})(?:[ ][A-Z]\.)?(?![\w'@-]|\.\w)|(?P<g2>{_G})(?:[ ][A-Z]\.){{0,2}}[ ](?P<f2>{_FAMILY})(?![\w@]|[.]\w))")

_LEAD = r"(?:Interview with|Ask for|Referred by|Thanks again,|Thanks,|Regards,|cc:|Candidate:|Your contact is|Gespräch mit|Entretien avec|Candidature de|Bewerbung von|Gruß,|Grüße,|Un saludo,|Saludos,|Votre contact :|Ansprechperson ist|Tu contacto es|Candidatura de|Entrevista con|After lunch|Cordialement,|Merci,|Contact:|Kontakt:|Contacto:)[ \t]+(?:(?:Mrs?|Ms|Dr|Herr|Frau|Mme|M|Sr|Sra)\.?[ \t]+)?"
_INITIAL = re.compile(rf"(?P<n>[^\W\d_a-zà-öø-ÿ]\.(?:[ ]?[A-Z]\.)?[ ](?P<f>{_FAMILY}))(?![\w@-]|\.\w)")
_BEFORE = re.compile(r"(?:^|[\n\r]|[.!?:>✅📌•] |[-*] )$")
_LEAD_END = re.compile(rf"{_LEAD}$")
_LED = re.compile(rf"{_LEAD}(?P<n>(?P<a>{_FAMILY})(?P<sep>,?[ ])(?:[A-Z]\.[ ])?(?P<b>{_FAMILY}))(?![\w@-]|\.\w)")
_INITIAL_LAST = re.compile(rf"{_LEAD}(?P<n>{_FAMILY},[ ][A-Z]\.)")
_TITLED = re.compile(rf"(?<![\w.])(?:(?:Mrs?|Ms|Mx|Dr|Prof|Herr|Frau|Mme|Mlle|Sra?|Señora?)\.?|M\.)[ ](?:(?:Dr|Prof)\.[ ])?(?P<n>(?P<a>{_FAMILY})(?P<sep>[ ])(?:[A-Z]\.[ ])?(?P<b>{_FAMILY}))(?![\w@-]|\.\w)")
_PAIR = re.compile(rf"(?<![\w@.'+-])(?=(?P<n>(?P<a>{_FAMILY})(?P<sep>,?[ ])(?:[A-Z]\.[ ])?(?P<b>{_FAMILY}))(?![\w@-]|\.\w))")
_FIRM = re.compile(r"[ ](?:[A-Z][\w'-]*[ ])?(?:Staffing|Consulting|Analytics|Systems|Technologies|Engineering|Manufacturing|Logistics|Insurance|Financial|Robotics|Laboratories|Energy|Foods|Media|Health|GmbH|Inc\b|Ltd\b|Corp\b)")


def _emails(t: str):
    for m in _AT_SIGN.finditer(t):
        a, b = m.span()
        one = m.group() == "@"  # a bare sign has one space around it at most
        while a and t[a - 1] in " \t" and (not one or a == m.start()):
            a -= 1
        while b < len(t) and t[b] in " \t" and (not one or b == m.end()):
            b += 1
        d = _DOMAIN.match(t, b)
        if d is None:
            continue
        wide = 120
        while True:  # the window grows until the local part begins well inside it
            start = max(0, a - wide)
            loc = _LOCAL.search(t[start:a])
            if start == 0 or loc is None and not _LOCAL_END.search(t[start:a]) or loc is not None and loc.start() > 40:
                break
            wide *= 4
        if loc is None or not re.search(r"[^\W_]", loc.group()):
            continue
        if m.group().isalpha() and "." in d.group() and not re.search(r"(?i)dot|punkt|punto|point|\.[a-z]", d.group()):
            continue
        yield start + loc.start(), d.end()


def _ids(t: str):
    done = -1
    for near in _FIVE.finditer(t):  # a label and its number stand in one line
        if near.start() < done:
            continue
        begin, done = t.rfind("\n", 0, near.start()) + 1, t.find("\n", near.end())
        done = len(t) if done < 0 else done
        for m in _ID_LABEL.finditer(t, begin, done):
            v = _ID_VALUE.match(t, m.end())
            if v and sum(c.isdigit() for c in v.group()) >= 5:
                yield v.span()


def _phones(t: str):
    for m in _PHONE.finditer(t):
        digits = sum(c.isdigit() for c in re.split(r"(?i)ext|x|poste|durch|dw|anexo", m.group())[0])
        if 9 <= digits <= 15 and not _NOT_PHONE.search(t, max(0, m.start() - 24), m.start()):
            yield m.span()
    for m in _BARE_PHONE.finditer(t):
        label = t[: m.start()] if m.start() < 80 else t[t.rfind("\n", 0, m.start()) + 1 : m.start()]
        label = label.rstrip(" \t")
        if _BARE_LABEL.search(label[-24:]) or label.endswith(":") and _BARE_LABEL.search(label[:-1].rstrip(" \t")[-24:]):
            yield m.span()


def _addresses(t: str):
    for k, p in enumerate(_ADDRESS):
        for m in p.finditer(t):
            if k == 0 and _TYPE_WORD.search(m.group()) and re.match(r"[ ][a-z]", t[m.end() : m.end() + 2]) and not re.search(r"(?:at|to|behind|habite|papers to|Office:|in)[ ]$", t[max(0, m.start() - 12) : m.start()]):
                continue  # `24 Hour Road maps`
            yield m.span()


def _fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if c.isalpha())


def _told(t: str):
    """Names that a title, or the local part of an address in the text, tells: the match, the given name and the family name."""
    for m in _TITLED.finditer(t):
        if not ({m["a"].lower(), m["b"].lower()} & NOT_FAMILY or _FIRM.match(t, m.end("n"))):
            yield m, m["a"], m["b"]
    locals_ = set()
    if _MAY["email"].search(t):
        for a, b in _emails(t):
            parts = re.split(_DOT + "|[_-]", _AT.split(t[a:b], maxsplit=1)[0], flags=re.I)
            if len(parts) == 2 and all(len(_fold(x)) > 1 for x in parts):
                locals_.add(tuple(map(_fold, parts)))
    if locals_ and t.isascii():  # the names must stand outside the address too
        low = t.lower()
        locals_ = {x for x in locals_ if all(low.count(w) > 1 for w in x)}
    if locals_:
        for m in _PAIR.finditer(t):
            a, b = _fold(m["a"]), _fold(m["b"])
            if (a, b) in locals_ or (b, a) in locals_:
                first = "," not in m["sep"] and (a, b) in locals_
                yield m, *((m["a"], m["b"]) if first else (m["b"], m["a"]))


def evidence(text: str | None) -> set[tuple[str, str]]:
    """(given name, family name) of the names in telling places of a text."""
    if not text:
        return set()
    t = plain(text).text
    out = {(g, f) for _, g, f in _told(t)}
    for m in _LED.finditer(t):
        if not ({m["a"].lower(), m["b"].lower()} & NOT_FAMILY or _FIRM.match(t, m.end())):
            out.add((m["b"], m["a"]) if "," in m["sep"] else (m["a"], m["b"]))
    return {(g.title() if g.isupper() else g, f.title() if f.isupper() else f) for g, f in out if "-" not in g and len(g) > 1}


_WORDS = re.compile(r"[^\W\d_]+")


def learn(df: DataFrame, text_col: str = "text") -> tuple[str, ...]:
    """Given names that stand in telling places of the texts with two family names or more, and nowhere in lower case."""

    def told(batches):
        for b in batches:
            pairs = sorted(set().union(*map(evidence, b.column(0).to_pylist())))
            yield pa.record_batch([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], names=["g", "f"])

    seen = df.select(f"`{text_col}`").mapInArrow(told, "g string, f string").groupBy("g").agg(F.countDistinct("f").alias("n")).where("n > 1")
    names = {r["g"] for r in seen.collect()} - set(GIVEN)
    low = {n.lower() for n in names}

    def common(batches):
        for b in batches:
            yield pa.record_batch([pa.array(sorted(low.intersection(*[set().union(*(_WORDS.findall(t) for t in b.column(0).to_pylist() if t))])), pa.string())], names=["w"])

    if not names:
        return ()
    words = {r["w"] for r in df.select(f"`{text_col}`").mapInArrow(common, "w string").distinct().collect()}
    return tuple(sorted(n for n in names if n.lower() not in words))


def _initials(t: str):
    """Initials with a family name where a line or sentence begins, or after a lead-in."""
    at = 0
    while m := _INITIAL.search(t, at):
        before = t[max(0, m.start() - 64) : m.start()]
        if _LEAD_END.search(before) or len(m["f"]) >= 4 and _BEFORE.search(before if before else ""):
            yield m
            at = m.end()
        else:
            at = m.start() + 1


def _names(t: str, learned: tuple[str, ...] = ()):
    named = _named(learned)
    for m in named.finditer(t):
        f = m["f1"] or m["f2"]
        a, b = m.span()
        if m["f1"] and f.lower() in NOT_FAMILY:
            again = named.match(t, a + len(f) + 2)
            if again is None or not again["f2"]:
                continue
            f, (a, b) = again["f2"], again.span()
        if f.lower() in NOT_FAMILY or (m["f2"] and _FIRM.match(t, b)):
            continue
        yield a, b
    for m, _, _ in _told(t):
        yield m.span("n")
    for p in (_INITIAL, _LED, _INITIAL_LAST):
        for m in _initials(t) if p is _INITIAL else p.finditer(t):
            if p is _INITIAL and m["f"].lower() in NOT_FAMILY or _FIRM.match(t, m.end()):
                continue
            if p is _LED and (m["a"].lower() in NOT_FAMILY or m["b"].lower() in NOT_FAMILY):
                continue
            if re.match(r"[ ](?:Road|Street|Lane|Avenue|Crescent|Court|Way|Blvd|Ave|Rd|St)\b", t[m.end() : m.end() + 12]):
                continue
            yield m.span("n")


#: What a text must hold for a kind to be in it at all.
_MAY = {"email": re.compile(r"@|(?i:\bat\b|arobase|arroba|\bät\b|klammeraffe)"), "id_number": re.compile(r"\d{2}"), "phone": re.compile(r"\d{2}"), "address": re.compile(r"\d"), "name": re.compile(r"[A-ZÀ-Þ]")}
_FINDERS = {"email": _emails, "id_number": _ids, "phone": _phones, "address": _addresses, "name": _names}


def find(text: str | None, learned: tuple[str, ...] = ()) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the passages of a text, in its own characters, in order, without overlaps."""
    if not text:
        return []
    p = plain(text)
    t, taken, starts = p.text, [], []
    for kind, finder in _FINDERS.items():
        if not _MAY[kind].search(t):
            continue
        for a, b in finder(t, learned) if kind == "name" else finder(t):
            k = bisect_right(starts, a)  # passages don't overlap, so only the neighbours can
            if b > a and not (k and taken[k - 1][2] > a) and not (k < len(taken) and taken[k][1] < b):
                starts.insert(k, a)
                taken.insert(k, (kind, a, b))
    return sorted(((k, *p.span(a, b, text)) for k, a, b in taken), key=lambda x: x[1:])


def redact_text(text: str | None, learned: tuple[str, ...] = ()) -> str | None:
    if not text:
        return text
    out, last = [], 0
    for kind, a, b in sorted(find(text, learned), key=lambda x: x[1]):
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*out, text[last:]])


def passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, value): each distinct passage of each text, exactly as it stands there.

    Null and empty texts give no rows, repeated rows none beyond the first, null ids stay null. Texts are
    read whole. An empty table gives no rows; other columns are ignored.
    """
    kind, learned = df.schema[id_col].dataType.simpleString(), learn(df, text_col)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                at, kinds, values = [], [], []
                for k, t in enumerate(part.column(1).to_pylist()):
                    for what, v in dict.fromkeys((w, t[a:e]) for w, a, e in find(t, learned)):
                        at.append(k)
                        kinds.append(what)
                        values.append(v)
                yield pa.record_batch([part.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=[id_col, "kind", "value"])

    return df.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, f"`{id_col}` {kind}, kind string, value string").distinct()


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with every passage replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] or [NAME].

    Null stays null, empty stays empty; everything outside the passages is unchanged.
    """
    kind, learned = df.schema[id_col].dataType.simpleString(), learn(df, text_col)

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([redact_text(t, learned) for t in b.column(1).to_pylist()], pa.string())], names=[id_col, text_col])

    return df.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, f"`{id_col}` {kind}, `{text_col}` string")
