"""Template residue, filler, error pages and script notices.

Every text is cut into normalised lines: the lines of the page, and within
them its sentences. Lines are counted by host (the source) over all distinct
texts, so copies of one text make none of its lines recur; lines that recur in
a given share of them are boilerplate and are subtracted from what a document
says. The residual is weighed: a document is excluded when it has an unfilled
template slot, or when at least half of the residual's letters belong to
filler, an error message or a notice that scripts or cookies are needed.

What a line says is read from the kinds of words it combines (a system noun
with a failure, a script noun with a need, a request with a text noun, ...),
not from listed sentences. Lines that are such evidence recur on error pages
as well and are never subtracted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialise
from . import columns as C
from .normalise import repair, spelt

#: Share of the distinct texts of a host in which a line must occur to count as its boilerplate. So the lines
#: subtracted are at most 1,000 times the lines of a text, however large the host is.
RECURRENT_SHARE = 0.001
#: Distinct texts that must hold the line in any case: in a small host a share alone is chance.
RECURRENT = 3
MAIN_SHARE = 0.5
TITLE_WORDS = 5
#: Longer words are not remembered.
LONG_WORD = 64
#: Longest line, in words, that can be an error message as a whole, and a notice about scripts.
MESSAGE_WORDS = 20
NOTICE_WORDS = 24

_MARKS = re.compile("[’‘“”„]")
_BLANKS = re.compile(r"[^\S\n]{2,}|[^\S\n ]")

# ---------------------------------------------------------------- template slots

#: Words between brackets that are sounds in a transcript or editorial remarks, not fields.
ANNOTATIONS = frozenset(
    "latter griner ler fniser musik stoej host hoster suk sukker klap klapper pause utydeligt uforstaaeligt graeder hvisker raab raaber mumler gaber sic red unk stilhed bifald"
    " telefon doer laughter music noise applause inaudible".split()
)
#: Names of HTML elements that may stand without attributes.
TAGS = frozenset(
    "a abbr article aside b body blockquote br button canvas center cite code dd div dl dt em figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i"
    " ins label li main mark nav noscript ol option p pre q s samp script section select small span strike strong style sub summary sup svg table tbody"
    " td template textarea tfoot th thead tr tt u ul var video wbr v c x".split()
)
#: Answers and names that stand between double underscores without being fields.
NO_FIELDS = frozenset("ja nej init main name file all doc version".split())
#: Names of fields that are slots between square brackets.
FIELDS = frozenset(
    "navn fornavn efternavn name firstname lastname dato date titel title sted place adresse address email mail emne subject kilde source firma company by city postnummer land country tekst text"
    " beskrivelse description overskrift heading beloeb amount antal nummer number kapitel chapter afsnit udgave forfatter author afsender sender modtager recipient brugernavn username link url varighed".split()
)

_NAME = r"[a-z_][\w.]*"
_ASK = r"(?:indsaet|insert|udfyld|enter|angiv|skriv|vaelg|your|dit|din|jeres)"
#: Template slots that no prose contains (on folded text).
_SURE_SLOT = re.compile(
    rf"\{{\{{[^{{}}\n]{{1,60}}\}}\}}|\{{%[^{{}}\n]{{1,60}}%\}}|<%[=\-]?[^<>%\n]{{1,60}}%>|[$#]\{{[^{{}}\n]{{1,60}}\}}|%\({_NAME}\)[sd]|%[a-z_]\w+%|%%\w+%%|\$[a-z_]\w+\$|@@\w+@@|\{{\d{{1,2}}\}}"
    rf"|\[\[\s*\w+\s*\]\]|<<\s*[\w.\-]+\s*>>|\[{_ASK}\s[^\[\]\n]{{1,40}}\]|<{_ASK}\s[^<>\n]{{1,40}}>|\[[\w .\-]{{1,40}} (?:mangler|missing|her|here)\]|<[\w .\-]{{1,40}} (?:her|here)>"
)
#: Slots that could be annotations, tags or emphasis; the name decides.
_MAYBE_SLOT = re.compile(rf"\{{\s*({_NAME}(?:-[\w.]+)*)\s*\}}|<\s*([a-z_][\w\-]*)\s*>|__([a-z]\w*?)__|\[\s*([a-z_][\w\-]*)\s*\]")
_SLOT_SIGNS = ("{", "<", "%", "$", "@@", "__", "[")
#: A sentence about slots.
_ABOUT = re.compile(r"pladsholder|placeholder|skabelon|template\b|tegnfoelge|maengde|syntaks|syntax|variab[el]l")
_NAMES_IT = re.compile(r"\W{0,3}(?:kaldes|hedder|betyder|is called|means)\b")
_QUOTES = {'"': '"', "»": "«", "«": "»", "`": "`", "'": "'"}

# ---------------------------------------------------------------- kinds of words

#: Kinds of words, folded; a star stands for any ending.
KINDS: dict[str, str] = {
    "script": "javascript javascripts js script scripts skript skripter cookie cookies",
    "enable": "enable enables enabled activate activated aktiver aktivere aktiverer aktiveret aktivera allow allows accept accepter acceptere accepterer acceptera tillad tillade tillader tillat tillate tillaata unblock godkend godkende",
    "switch": "turn turned switch slaa slaar slaaet slaas paaslaaet",
    "off": "disabled blocked deaktiver* blokeret blokerer frakoblet off fra",
    "need": "require requires required need needs must kraev kraever kraeves krever kraeve noedvendig noedvendigt skal maa maaste behoever have has",
    "without": "uden without uten utan",
    "support": "support supports supported understoett* stoetter stoedjer",
    "web": "browser browseren browsers browserens nettleser nettleseren webblaesare webblaesaren webbläsare webbläsaren side siden page site website webside websiden hjemmeside* app appen tjenesten tjänsten tjaensten funktion funktionen afspilleren indhold* view",
    "it": "it them det dem",
    "since": "siden",
    "system": "side webside* websted* hjemmeside* page pages website site url link linket links adresse adressen address server serveren request requested requests forespoergs* session sessionen forbindelse forbindelsen connection database databasen"
    " tjeneste tjenesten service services system systemet fil filen filer file files indhold indholdet content gateway host proxy network netvaerk* ressource* resource resources optagelse optagelsen udskrift udskriften video videoen document dokumentet"
    " artikel artiklen article sida sidan nettside* nettsiden app appen transcript recording directory konto kontoen account rettighed* permission permissions tilladelse adgang access",
    "able": "find findes finde finnes fundet found hittas hitta vise vises vis vist shown displayed display load loaded loading indlaese indlaeses hente hentes hentet retrieve retrieved reach reached open opened aabne aabnes afspille afspilles play played svarer svare"
    " respond responding exist exists eksisterer virker work works working tilgaengelig tilgaengeligt tilgjengelig available access accessed accessible adgang rettighed* permission tilladelse authorized authorised forbinde connect process processed behandles behandle gennemfoeres such",
    "negation": "ikke not no inte ej cannot",
    "fail": "unavailable utilgaengelig* fjernet flyttet slettet removed moved deleted expired udloebet foraeldet invalid ugyldig ugyldigt ugyldige missing mangler denied naegtet afvist refused reset afbrudt interrupted failed failure fejlede mislyk* timeout timed"
    " overbelastet overloaded broken spaerret blocked opdateres maintenance vedligeholdelse bad",
    "much": "many mange long laenge",
    "too": "too for",
    "error": "error errors fejl feil systemfejl serverfejl fatal",
    "which": "intern internal uventet unexpected ukendt unknown kritisk fatal teknisk technical database server http status application runtime syntax parse php mysql sql uncaught opstod opstaaet occurred sket skete happened beklager sorry",
    "wrong": "galt wrong stykker",
    "went": "noget something went gik gaaet",
    "alone": "forbidden unauthorized unauthorised",
    "logged": "logget logged",
    "out": "ud out ind in",
    "http": "http https error fejl feil status kode code fejlkode",
    "ask": "indsaet skriv erstat tilfoej udfyld insert enter type replace add write put edit rediger klik click",
    "text": "tekst teksten text indhold indholdet content beskrivelse beskrivelsen description overskrift overskriften transskription* noget something afsnit section paragraph",
    "here": "her here",
    "come": "kommer skal goes comes staa",
    "later": "foelger udarbejdelse senere later soon snart opbygning construction tilfoejes added udfyldes",
    "coming": "coming kommer",
    "sample": "sample dummy eksempel proeve placeholder filler fyld",
    "sampletext": "eksempeltekst* dummytekst* fyldtekst* proevetekst* pladsholdertekst* dummytext fillertext placeholdertext",
    "todo": "todo tbd tba fixme udfyldes",
    "fill": "test teste tekst text overskrift broedtekst bla blah dummy placeholder lorem ipsum xxx abc",
    "about": "forklarede forklarer explained ordet word kaldes called hedder betyder means skrev skriver skrives sagde said siger says fejlmeddelelse* message messages citat",
    "retry": "try proev proeva forsoeg foersoek",
    "again": "again igen igjen later senere",
    "contact": "kontakt contact",
    "staff": "administrator administratoren support supporten webmaster kundeservice os us",
    "back": "return back tilbage gaa go",
    "home": "home homepage forside forsiden startside startsiden",
    "reload": "reload refresh genindlaes genindlaese opdater update upgrade",
    "id": "id reference ray fejlkode kode code tidspunkt timestamp",
    "banner": "nginx apache iis cloudflare varnish openresty lighttpd",
    "check": "check checking checks verify verifying tjek tjekker kontrollerer",
    "human": "robot robots human menneske",
    "oops": "oops ups hovsa whoops",
}
BIT = {k: 1 << i for i, k in enumerate([*KINDS, "latin", "common", "mash", "status", "digit", "exception"])}
_EXACT: dict[str, int] = {}
_PREFIX: list[tuple[str, int]] = []
for _kind, _words in KINDS.items():
    for _w in _words.split():
        if _w.endswith("*"):
            _PREFIX.append((_w[:-1], BIT[_kind]))
        else:
            _EXACT[_w] = _EXACT.get(_w, 0) | BIT[_kind]

#: Words of the usual Latin filler text.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi"
    " aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia"
    " deserunt mollit anim id est laborum".split()
)
#: Endings of Latin words; a line of them without common words of the project's languages is Latin.
_LATIN_END = re.compile(r"^(?:et|ac|in|a|ex|ut)$|(?:us|um|is|it|at|ae|am|em|unt|ur|que|ibus|isse|ens|ans|ant|or|as|os|es|ci|ti)$")
_COMMON = frozenset(
    "og er det den der til paa som af med for har ikke han hun vi jeg du man en at i om fra var blev men eller and the of to is was that it with for on as are this be by from or och att som är inte"
    " jag på av ett har med från och som ikke til på jeg har han hun".split()
)
_CODES = frozenset("400 401 403 404 405 408 409 410 418 429 451 500 501 502 503 504 505 511 520 521 522 524".split())
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
_ANY_STATUS = re.compile(r"[45]\d\d|0x[0-9a-f]+")
_WORD = re.compile(r"[^\W_]+(?:'[a-z]+)?")
_LINE_END = re.compile(r"\n|<br\s*/?>|</?(?:div|p)>")
_SENTENCE_END = re.compile(r"(?<=[.!?…])\s+")
_REPEATABLE = re.compile(r"^(?:ja|nej|nah|hey|hej|haha|hov|naa|meget|aldrig|altid|stop|kom|vent|no|yes|la|na)\b")
_RELATIVE = {"som", "which"}
#: Stack traces.
_TRACE = re.compile(
    r"traceback \(most recent call last\):?|file \"[^\"\n]+\", line \d+(?:, in \w+)?|\bat [\w.$<>/]+ ?\([^()\s]+:\d+(?::\d+)?\)|(?:\b[a-z]\w*\.){2,}\w*(?:exception|error)\b"
    r"|\b\w{2,}(?:error|exception): '?[^'\n]{0,40}'?(?=\s|$)|\bin /\S+:\d+|\bon line \d+"
)
_TRACE_SIGNS = ("traceback (", '", line ', "exception", "error: ", "error.", ":0)", " in /", " on line ")
_COLON_DIGIT = re.compile(r":\d+\)")


def _is_mash(w: str) -> bool:
    """A run along a keyboard row or the alphabet, one letter over and over, or such a run repeated."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return False
    if len(set(w)) == 1:
        return True
    for k in range(3, min(len(w), len(_ROWS[-1])) + 1):
        head = w[:k]
        if any(head in r for r in _ROWS) and (head * (len(w) // k + 1))[: len(w)] == w and (len(w) % k == 0 or len(w) > k):
            return True
    return False


@lru_cache(maxsize=1 << 17)
def kinds_of(word: str) -> int:
    """The kinds of a folded word as bits."""
    word = word.replace("é", "e")
    out = _EXACT.get(word, 0)
    for p, bit in _PREFIX:
        if word.startswith(p):
            out |= bit
    if word.endswith("n't"):
        out |= BIT["negation"]
    if word in LATIN:
        out |= BIT["latin"]
    if word in _COMMON:
        out |= BIT["common"]
    if _ANY_STATUS.fullmatch(word):
        out |= BIT["status"]
    if any(c.isdigit() for c in word):
        out |= BIT["digit"]
    elif len(word) > 6 and word.endswith(("error", "exception")):
        out |= BIT["exception"]
    if _is_mash(word):
        out |= BIT["mash"]
    return out


def _kinds(word: str) -> int:
    # words of no language do not fill the cache
    return kinds_of(word) if len(word) <= LONG_WORD else kinds_of.__wrapped__(word)


_B = type("Bits", (), BIT)  # the bits by name
#: Kinds of words that begin a request for text, a sample text or advice.
_STARTERS = _B.ask | _B.todo | _B.sample | _B.sampletext | _B.retry | _B.contact | _B.reload | _B.banner | _B.check | _B.back
#: Without any of these kinds, and without repetition or Latin, a line has no evidence of its own.
_ANCHORS = sum(BIT[k] for k in ("script", "system", "since", "error", "wrong", "alone", "logged", "status", "text", "later", "sample", "sampletext", "todo", "fill", "mash", "exception", "latin"))


def fold(text: str) -> str:
    """Repaired text in lower case with æ, ø, å as ae, oe, aa and runs of blanks made one; line breaks stay."""
    text = spelt(repair(text).lower())
    if not text.isascii():
        text = _MARKS.sub(lambda m: "'" if m[0] in "’‘" else '"', text)
    return _BLANKS.sub(" ", text)


def _quoted(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] stands between a pair of quotation marks."""
    return 0 < a and b < len(text) and _QUOTES.get(text[a - 1]) == text[b]


def has_slot(text: str) -> bool:
    """Whether folded text has an unfilled template slot that is not quoted or explained."""
    if not any(x in text for x in _SLOT_SIGNS):
        return False
    for pattern in (_SURE_SLOT, _MAYBE_SLOT):
        for m in pattern.finditer(text):
            if pattern is _MAYBE_SLOT:
                name = m[1] or m[2] or m[3] or m[4]
                if name in ANNOTATIONS or (m[2] and name in TAGS) or (m[3] and name in NO_FIELDS) or (m[4] and name not in FIELDS) or len(name) < 2:
                    continue
            if _quoted(text, *m.span()) or _NAMES_IT.match(text, m.end()):
                continue
            low = max(text.rfind("\n", 0, m.start()), text.rfind(". ", 0, m.start())) + 1
            high = min(x for x in (text.find("\n", m.end()), text.find(". ", m.end()), len(text)) if x >= 0)
            if _ABOUT.search(text, low, high):
                continue
            return True
    return False


_QUOTATION = re.compile(r'"([^"\n]{3,160})"|»([^»«\n]{3,160})«|`([^`\n]{3,160})`')


def _unquoted(text: str) -> str:
    """Text in which quotations that have words around them on their line are blanked."""
    if '"' not in text and "»" not in text and "`" not in text:
        return text

    def blank(m: re.Match) -> str:
        # three words beside it are enough, so a long line is not read for every quotation in it
        start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end(), m.end() + 400)
        before = text[max(start, m.start() - 400) : m.start()].split()
        after = text[m.end() : end if end >= 0 else m.end() + 400].split()
        return " " * len(m[0]) if len(before) + len(after) >= 3 else m[0]

    return _QUOTATION.sub(blank, text)


def _union(ks: list[int]) -> int:
    m = 0
    for k in ks:
        m |= k
    return m


def _message(ws: list[str], ks: list[int], m: int) -> bool:
    """Whether a line with the kinds ``m`` is a notice or an error message."""
    n = len(ws)
    if n > NOTICE_WORDS:
        return False
    if m & _B.script:
        if m & (_B.enable | _B.off | _B.switch) or (m & _B.web and m & (_B.need | _B.support)) or (m & _B.without and m & _B.negation):
            return True
    if n > MESSAGE_WORDS:
        return False
    if m & _B.exception or (m & _B.alone and n <= 3) or (n == 2 and m & _B.negation and m & _B.able):
        return True
    # elsewhere in a sentence this word means since
    system = m & _B.system or any(w == "siden" and (i == 0 or ks[i - 1] & (_B.status | _B.http | _B.oops)) for i, w in enumerate(ws[:4]))
    fails = m & _B.fail or (m & _B.negation and m & _B.able) or (m & _B.much and any(a & _B.too and b & _B.much for a, b in zip(ks, ks[1:])))
    if _RELATIVE & set(ws) and n >= 9:
        return False  # a sentence about an error
    if system and fails:
        return True
    if m & _B.error and (m & _B.which or (system and n <= 6) or n <= 2):
        return True
    if m & _B.wrong and m & (_B.went | _B.oops) and n <= 9:
        return True
    if m & _B.logged and m & _B.out and n <= 8:
        return True
    if m & _B.status:
        for i, k in enumerate(ks[:4]):
            if k & _B.status and (i == 0 or ks[i - 1] & (_B.http | _B.error)):
                if (n == 1 and ws[0] in _CODES) or i or system or fails or m & (_B.error | _B.oops):
                    return True
    return False


def _segments(ws: list[str], ks: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, times) of the parts of a line that runs several together.

    A part begins at a word that opens a request, a sample text, advice or an
    identifier, and with a phrase that is given several times in a row.
    """
    n = len(ws)
    cuts = {0}
    for i, k in enumerate(ks):
        if k & _STARTERS or (k & _B.here and i + 1 < n and ks[i + 1] & _B.come) or (k & _B.id and not (i and ks[i - 1] & _B.id) and any(x & _B.digit for x in ks[i + 1 : i + 4])):
            cuts.add(i - 1 if i and ws[i - 1] in ("please", "request", "venligst") else i)
    times = {}
    if n >= 4 and len(set(ws)) <= 0.7 * n:
        i = 0
        while i < n:
            best = (1, 1)
            for p in range(1, min(8, (n - i) // 2) + 1):
                r = 1
                while ws[i : i + p] == ws[i + r * p : i + (r + 1) * p]:
                    r += 1
                if r > 1 and r * p > best[0] * best[1]:
                    best = (p, r)
            p, r = best
            if r > 1:
                times[i] = (i + p, r)
                cuts = {c for c in cuts if c <= i or c >= i + p * r} | {i, i + p * r}
                i += p * r
            else:
                i += 1
    order = sorted(c for c in cuts if c < n)
    return [(a, times[a][0], times[a][1]) if a in times else (a, b, 1) for a, b in zip(order, [*order[1:], n])]


def _filler(ws: list[str], ks: list[int], m: int) -> bool:
    """Whether a short line is a request for text, a promise of text, sample text or keyboard noise."""
    n = len(ws)
    if m & _B.mash and sum(1 for k in ks if k & _B.mash) * 2 >= n and (n > 1 or len(ws[0]) > 3):
        return True
    if m & _B.fill and n >= 2 and all(k & (_B.fill | _B.digit) for k in ks):
        return True
    if n > 9:
        return False
    head = ks[0] | (ks[1] if n > 1 else 0)
    if m & _B.text:
        if head & _B.ask and (m & _B.here or n <= 5) and n <= 8:
            return True
        if m & _B.here and (n <= 4 or (ks[0] & _B.here and m & _B.come)):
            return True
        if m & _B.later and n <= 6 or (n <= 3 and {"mangler", "missing"} & set(ws)):
            return True
    if m & _B.later and ((m & _B.web and {"under"} & set(ws) and n <= 7) or (m & _B.coming and n <= 3)):
        return True
    if m & _B.ask and {"denne", "this"} & set(ws) and m & _B.text:
        return True
    if (m & _B.sampletext or (m & _B.sample and m & _B.text)) and n <= 9:
        return True
    return bool(ks[0] & _B.todo and n <= 6)


def _latin(ws: list[str], ks: list[int]) -> bool:
    known = sum(1 for k in ks if k & _B.latin)
    n = len(ws)
    if n >= 2 and known >= 0.7 * n:
        return True
    if n < 6 or sum(1 for k, w in zip(ks, ws) if k & _B.common and not k & _B.latin) > 0:
        return False
    return sum(1 for k, w in zip(ks, ws) if k & _B.latin or _LATIN_END.search(w)) >= 0.75 * n


def _attends(ws: list[str], m: int) -> bool:
    """Advice, identifiers, server names and checks of the visitor that stand beside an error message."""
    n = len(ws)
    return bool(
        (m & _B.retry and m & _B.again) or (m & _B.contact and m & _B.staff) or (m & _B.back and m & _B.home) or (m & _B.reload and (m & (_B.web | _B.system) or n <= 2))
        or (m & _B.id and m & _B.digit and n <= 6) or (m & _B.banner and n <= 10) or (m & _B.oops and n <= 2) or (m & _B.it and m & (_B.switch | _B.enable) and n <= 12)
        or (m & _B.check and m & (_B.web | _B.human))
    )


def _repeated(ws: list[str]) -> int:
    """Letters of the words that stand three times or more in a row."""
    out, i = 0, 0
    while i < len(ws):
        j = i
        while j + 1 < len(ws) and ws[j + 1] == ws[i]:
            j += 1
        if j - i >= 2 and len(ws[i]) >= 3 and not _REPEATABLE.match(ws[i]):
            out += len(ws[i]) * (j - i + 1)
        i = j + 1
    return out


def line_key(ws: list[str]) -> int:
    """64-bit key of a normalised line: its words, every number made one."""
    return xxhash.xxh64_intdigest(" ".join("0" if w.isdigit() else w for w in ws)) - (1 << 63)


def weigh(text: str) -> tuple[bool, int, list[tuple[int, int]], list[int]]:
    """(has a slot, evidence letters, (key, letters) of the content lines, keys of all lines).

    The content lines are left out where there is no evidence.
    """
    t = fold(text)
    slot = has_slot(t)
    evidence = core = 0
    body = t
    if any(x in t for x in _TRACE_SIGNS) or _COLON_DIGIT.search(t):
        for m in _TRACE.finditer(t):
            core += 1
            evidence += sum(map(str.isalpha, m[0]))
        if core:
            body = _TRACE.sub(lambda m: "\n" + " " * max(len(m[0]) - 2, 0) + "\n", t)
    body = _unquoted(body)
    lines: list[tuple[int, int]] = []
    keys: list[int] = []
    waiting: list[tuple[int, int]] = []  # attendants, evidence only beside a message
    first = True
    for page_line in _LINE_END.split(body):
        if not page_line or page_line.isspace():
            continue
        units = _SENTENCE_END.split(page_line)
        for unit in units:
            ws = _WORD.findall(unit)
            if not ws:
                continue
            key = line_key(ws)
            keys.append(key)
            ks = [_kinds(w) for w in ws]
            m = _union(ks)
            letters = sum(map(len, ws))
            n = len(ws)
            found = again = beside = 0
            if m & _B.about:
                pass
            elif m & _ANCHORS or (n == 2 and m & _B.negation) or len(set(ws)) <= 0.5 * n:
                if _message(ws, ks, m) or _filler(ws, ks, m) or (m & _B.latin and _latin(ws, ks)):
                    found = letters
                elif n > 3:
                    for a, b, r in _segments(ws, ks):
                        part, kinds = ws[a:b], ks[a:b]
                        u = _union(kinds)
                        size = r * sum(map(len, part))
                        if _message(part, kinds, u) or _filler(part, kinds, u) or (r > 2 and size >= 9 and not _REPEATABLE.match(part[0])):
                            found += size
                        elif _attends(part, u):
                            beside += size
            elif n >= 6 and not m & _B.common and _latin(ws, ks):
                found = letters
            elif n >= 3:
                found = again = _repeated(ws)
            if found:
                core += 1
                evidence += found
                letters -= found + beside
                evidence += beside
                if letters > 0:
                    lines.append((key if again else 0, letters))
            elif _attends(ws, m):
                waiting.append((key, letters))
            elif first and len(units) == 1 and n <= TITLE_WORDS:
                pass  # a title: neither content nor evidence
            else:
                if n > 3 and m & _STARTERS | m & _B.id:
                    beside = sum(sum(map(len, ws[a:b])) for a, b, _ in _segments(ws, ks) if _attends(ws[a:b], _union(ks[a:b])))
                lines.append((key, letters - beside))
                waiting.append((key, beside))
            first = False
    if not core:
        return slot, 0, [], keys
    return slot, evidence + sum(b for _, b in waiting), lines, keys


def excluded_alone(text: str | None, main_share: float = MAIN_SHARE) -> bool:
    """Whether a text would be excluded by itself, nothing subtracted."""
    if not text:
        return False
    slot, evidence, lines, _ = weigh(text)
    return slot or (evidence > 0 and evidence >= main_share * (evidence + sum(n for _, n in lines)))


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.struct([("line", pa.int64()), ("letters", pa.int64())])
    types = (pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(item), pa.list_(pa.int64()))
    names = ["doc_id", "host", "own", "slot", "evidence", "lines", "keys"]
    for batch in batches:
        cols: list[list] = [[] for _ in names]
        for doc, host, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "host", "text"))):
            slot, evidence, lines, keys = weigh(text)
            own = xxhash.xxh64_intdigest(repr(keys)) - (1 << 63)
            for c, v in zip(cols, (doc, host, own, slot, evidence, [{"line": k, "letters": n} for k, n in lines], sorted(set(keys)))):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def read_documents(documents: DataFrame) -> DataFrame:
    """One pass over the texts: doc_id, host, own (key of the text), slot, evidence, lines (content) and keys (of all lines)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(C.source(F.col("source")), F.lit("")).alias("host"), "text").filter("doc_id is not null and text is not null")
    schema = "doc_id long, host string, own long, slot boolean, evidence long, lines array<struct<line: long, letters: long>>, keys array<long>"
    return docs.mapInArrow(_weigh, schema)


def recurrent_lines(read: DataFrame, wanted: DataFrame, recurrent: int = RECURRENT, share: float = RECURRENT_SHARE) -> DataFrame:
    """host, line of those ``wanted`` lines that at least ``recurrent`` and ``share`` of the distinct texts of their host hold.

    ``wanted`` (host, line) are the lines whose recurrence can matter, so that
    all others stay where they are: the semi-join comes before the shuffle
    wherever its right side is small enough for Spark to broadcast.
    """
    texts = read.select("host", "own").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    rows = read.select("host", "own", F.explode("keys").alias("line")).join(wanted, ["host", "line"], "left_semi").distinct()
    counts = rows.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= recurrent)
    return counts.join(texts, "host").filter(F.col("n") >= share * F.col("texts")).select("host", "line")


def _is_main(content: Column, main_share: float = MAIN_SHARE) -> Column:
    return (F.col("evidence") > 0) & (F.col("evidence") >= main_share * (F.col("evidence") + content))


def weighed(documents: DataFrame, recurrent: int = RECURRENT, share: float = RECURRENT_SHARE, main_share: float = MAIN_SHARE) -> DataFrame:
    """doc_id, host, slot, evidence and content (residual letters) of every document with a slot or any evidence."""
    read = materialise(read_documents(documents), "residue")
    some = read.filter("slot or evidence > 0").select("doc_id", "host", "slot", "evidence", "lines")
    # subtraction can only decide where the content outweighs the evidence
    whole = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["letters"])
    open_ = ~F.col("slot") & ~_is_main(whole, main_share)
    done = some.filter(~open_).select("doc_id", "host", "slot", "evidence", whole.alias("content"))
    rows = some.filter(open_).select("doc_id", "host", "slot", "evidence", F.explode_outer("lines").alias("x")).select("doc_id", "host", "slot", "evidence", "x.line", "x.letters")
    again = recurrent_lines(read, rows.select("host", "line").distinct(), recurrent, share).withColumn("again", F.lit(True))
    own = F.when(F.col("again").isNull(), F.coalesce("letters", F.lit(0))).otherwise(0)
    left = rows.join(again, ["host", "line"], "left").groupBy("doc_id", "host").agg(F.max("slot").alias("slot"), F.max("evidence").alias("evidence"), F.sum(own).alias("content"))
    return done.unionByName(left)


def residual_documents(documents: DataFrame, recurrent: int = RECURRENT, share: float = RECURRENT_SHARE, main_share: float = MAIN_SHARE) -> DataFrame:
    """Documents to exclude: doc_id.

    Null and empty texts, and texts that only mention, quote or explain such
    things, do not count. Texts are read whole; further columns are not read;
    an empty table gives an empty result.
    """
    w = weighed(documents, recurrent, share, main_share)
    return w.filter(F.col("slot") | _is_main(F.col("content"), main_share)).select("doc_id").distinct()


def residue_report(documents: DataFrame) -> DataFrame:
    """Per host: documents, excluded documents with a slot and excluded by evidence."""
    w = weighed(documents)
    main = _is_main(F.col("content"))
    bad = w.groupBy("host").agg(F.sum(F.col("slot").cast("int")).alias("n_slot"), F.sum((main & ~F.col("slot")).cast("int")).alias("n_evidence"))
    per = documents.groupBy(F.coalesce(C.source(F.col("source")), F.lit("")).alias("host")).agg(F.count("*").alias("n_documents"))
    return per.join(bad, "host", "left").fillna(0, ["n_slot", "n_evidence"])
