"""Personal information inside free text: find it and put typed placeholders in its place.

Method: a semi-Markov conditional random field. Whole spans are scored by features of the span and of what stands around it;
dynamic programming over the bounded candidate spans of a line chooses boundaries and types jointly. The weights are trained by
gradient ascent on the log likelihood of labelled lines that training_lines() writes (TRAINING_LINES of them at most), with the
given list of name parts as a noisy lexicon.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINING_LINES, EPOCHS = 4_000, 5
#: Bytes of the list of name parts at most: it is sent to every task. A longer list is refused, none of it is left out.
LEXICON_BYTES = 64 << 20
TYPES = ("name", "email", "phone", "id_number", "address")

# Surnames written with one or two syllables, determiners that begin sentences, kinds of streets, words that announce a value.
SURNAMES = "김 이 박 최 정 강 조 윤 장 임 한 오 서 신 권 황 안 송 류 전 홍 고 문 양 손 배 백 허 유 남 심 노 하 곽 성 차 주 우 구 민 남궁 황보 제갈 선우 독고 사공 서문".split()
GIVEN_SYLLABLES = "가건결경광규금기길나내늘다담도동라란람로린림마민바범별보봄빈빛상새샘서석선설성세소솔송수숙순슬승시아안애연열영예온완용우울원유윤율은의이인재정종주준중지진찬창채철초춘태택하한해향헌혁현형혜호홍화환효훈휘희"
DETERMINERS = "The A An Our Each This That Every These Those Un Une Le La Les Aucun Aucune Chaque Der Die Das Ein Eine Jeder Kein Keine If When No And But Or Please Meeting Topic On In At".split()
# Common given names of several countries that are no ordinary words.
COMMON = (
    "John Mary James Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Daniel Matthew Anthony Margaret Steven Andrew Paul Joshua Kenneth Kevin Brian George "
    "Timothy Ronald Edward Jason Jeffrey Ryan Jacob Nicholas Eric Jonathan Stephen Emily Emma Olivia Sophia Laura Rachel Helen Samantha Katherine Hannah Alice Julia Peter Martin Simon Tom Ben Oliver Harry Hans Klaus Jürgen Wolfgang Stefan "
    "Andreas Sabine Petra Monika Ursula Anna Katharina Heike Jens Uwe Matthias Jean Pierre Michel François Jacques Philippe Nathalie Isabelle Sylvie Catherine Élodie Camille José Carlos Miguel Javier Carmen Lucía Maria María Ana Sofía Giulia "
    "Marco Luca Giovanni Francesca Alessandro Piotr Krzysztof Agnieszka Małgorzata Katarzyna Tomasz Ivan Dmitri Olga Natalia Sven Lars Ingrid Björn Astrid Fatima Mohammed Ahmed Yusuf Priya Rahul"
).split()
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Blvd|Boulevard|Way|Place|Terrace|Square|Close|Crescent|Parkway|Row|Hill"
BEFORE_NAME = r"(?:[Bb]est regards|[Kk]ind regards|[Rr]egards|[Ss]incerely),|\b(?:[Oo]wner|[Cc][Cc]|[Aa]ttendees|[Ff]rom|[Tt]o|[Aa]uthor|[Rr]eviewer|[Cc]ontact):|\bPer\b|\b(?:Dear|Hi|Hello)\b|\b[Dd]eliver(?:ed)? to\b|\bassignee=|\bask for\b|\bspoke with\b"
BEFORE_NAME_KO = r"참석(?:자)?:|담당자:?|작성자:?|인수자:?|수령인:?|보낸사람:|받는사람:|성명:?|이름:|어제"
AFTER_NAME = r"\s+signed the\b|:\s+leave\b|\s+phone=|\s*<\S+|\s*[,|]\s*(?:\+?[\d(０Q]|M\d)|\s+\((?:\(?\+?\d)|,\s+the\b|,\s+\d+ [A-Z]|,\s+P\.O\."
AFTER_NAME_KO = r" ?(?:님|씨|과장|팀장|부장|대리|차장|사원|선임|책임)|에게|께|(?:가|이) \S+ \S+ 맡겼다| 서명| \(\d{4}-|\s*[,|]\s*(?:\+?[\d(０Q]|M\d)| / |\s*<\S+"
NOT_AFTER = r"\s+(?:branch|dam|drawing|period|jar|street|hotel|project)\b|\s+(?:프로젝트|바닥|사진|교체|그림|공원|아파트)"
ABOUT_NUMBER = r"(?:일련번호|시리얼|주문번호|버전|빌드|좌표|[Ss]erial(?: no\.?)?|[Pp]art no\.?|[Oo]rder(?: no\.?)?|[Bb]uild|[Vv]ersion|\bip|uuid = \"|request-id:|checksum|commit|sha256:|port|id=)\s*\S*$"
ABOUT_ID = r"(?:주민등록번호|신분증 번호는?|여권(?:번호)?|본인확인:?|세금 서류|passport or ID|[Pp]assport(?: no\.?)?|ID no\.?|tax id:|[Ss][Ss][Nn]:?)\s*$"
ABOUT_PHONE = r"(?:연락처|전화|휴대폰|긴급 시|또는|통화함\(|[Tt][eé]l(?:e[fp]h?one?|éphone)?\.?:?|[Cc]all|[Rr]ing|[Dd]ial|[Ff]ax:?|[Mm]obile:?|[Mm]obil:?|[Hh]andy:?|[Pp]hone:?|[Rr]uf|[Aa]ppeler|phone=|contact is|님 ?\(|\()\s*(?:me (?:at|on)|us (?:at|on)|at|on|is|an unter|au|le|:)?\s*$"
#: Titles, and words that often stand beside names in running text.
TITLES = "Mr Mrs Ms Miss Dr Prof Sir Herr Herrn Frau Mme Monsieur Madame Mlle Señor Señora Sra".split()
BEFORE_VERB = "met by with asked told saw named called invited thanked emailed phoned interviewed hired mit von par avec chez".split()
AFTER_VERB = r"\s+(?:said|says|called|wrote|met|asked|told|works?|lives?|joined|left|sent|replied|phoned|married|studied|a dit|habite|travaille|hat|wohnt|arbeitet|sagte)\b|, (?:was|is|who|born)\b|['’]s\b"

_AT = r"(?:\s?[@＠]\s?|\s?\(at\)\s?|\s?\[at\]\s?|\s?\{at\}\s?| at (?=[\w-]+ dot )|\s?골뱅이\s?)"
_DOT = r"(?:\.|．|\s?\[dot\]\s?|\s?\(dot\)\s?| dot )"
EMAIL = re.compile(r"(?<![\w.%+*-])[A-Za-z0-9][A-Za-z0-9._%+-]*" + _AT + r"[A-Za-z0-9-]+(?:" + _DOT + r"[A-Za-z0-9-]+)*" + _DOT + r"[A-Za-z]{2,}(?![\w-])")
_WIDE = str.maketrans("０１２３４５６７８９－（）＋　", "0123456789-()+ ")
_D = r"[\d０-９]"
NUMBER = re.compile(r"(?<![\w.+/*○０-９-])(?:[+＋]?\d{1,3}[-. ]?)?(?:[(（]" + _D + r"{2,4}[)）]\s?)?" + _D + r"{2,7}(?:(?: - |[-. －])" + _D + r"{2,7}){0,3}(?![\w*○－]|[-.]\w)|(?<![\w.+/*○-])\+?\d{9,14}(?![\w*○]|[-.]\w)")
PASSPORT = re.compile(r"(?<![\w-])[A-Z]{1,2}\d{7,8}(?![\w-])")
FORMATS = [
    ("phone_kr", re.compile(r"0(?:1[016789]|2|[3-6]\d|70)([-. ]?)\d{3,4}\1\d{4}")),
    ("phone_kr_area", re.compile(r"\(0\d{1,2}\) ?\d{3,4}-\d{4}")),
    ("phone_kr_intl", re.compile(r"\+82[- ]?(?:\(0\))?\d{1,2}[- ]?\d{3,4}[- ]?\d{4}")),
    ("phone_us", re.compile(r"(?:\+?1[-. ]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[-. ])\d{3}[-. ]\d{4}|\+1\d{10}")),
    ("phone_uk", re.compile(r"(?:\+44 ?7\d{3}|07\d{3}) ?\d{6}")),
    ("phone_fr", re.compile(r"0[1-9](?:([ .-])\d{2}\1\d{2}\1\d{2}\1\d{2})")),
    ("phone_area", re.compile(r"0\d{2,4}[ -]\d{3,4}[ -]\d{4}|0\d{2,4}[ -]\d{5,8}")),
    ("phone_intl", re.compile(r"\+\d{1,3}[-. ]?(?:\d{2,5}[-. ]?){2,4}\d{2,4}")),
    ("rrn", re.compile(r"\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?: ?- ?)?[1-8]\d{6}")),
    ("ssn", re.compile(r"\d{3}([- ])\d{2}\1\d{4}")),
]
_PLACE = r"(?:[A-Z][a-zà-ÿ]+(?:[ -][A-Z][a-zà-ÿ]+)?)"
ADDRESS_EN = re.compile(r"(?<![\w-])(?:\d{1,5}[A-Z]? (?:[A-Z][\w’'-]+ ){1,3}(?:(?:St|Ave|Rd|Ln|Dr|Ct|Blvd)\.|(?:" + STREETS + r")\b)|P\. ?O\. Box \d+)(?:,? (?:Apt|Unit|Suite|Ste|Flat|Floor)\.? #?\w+|,? #\w+)?(?:, " + _PLACE + r"(?:,? [A-Z]{2})?(?:,? \d{4,5}(?:-\d{4})?)?)?")
ADDRESS_KO = re.compile(
    r"(?:[(\[]?\d{5}[)\]]? )?(?:[가-힣]{1,6}(?:특별자치시|특별자치도|특별시|광역시|시|도) )?(?:[가-힣]{1,5}시 )?(?:[가-힣]{1,6}[구군] )?(?:[가-힣]{1,6}[읍면] )?"
    r"(?:[가-힣]{1,8}(?:대로|로|길)(?: ?\d+번?길)? ?\d+(?:-\d+)?|[가-힣]{1,6}(?:동|리|가) \d+(?:-\d+)?(?:번지)?)(?:,? ?\d+동)?(?:,? ?\d+호|,? ?\d+층)?(?![\d가-힣]{2})"
)
ADDRESS_DE = re.compile(
    r"(?<![\w-])(?:[A-ZÄÖÜ][a-zäöüß]+(?:-[A-ZÄÖÜ][a-zäöüß]+)*(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|ufer|damm|chaussee)|[A-ZÄÖÜ][a-zäöüß]+(?:er|-[A-ZÄÖÜ][a-zäöüß]+)? (?:Straße|Strasse|Str\.|Weg|Platz|Allee|Ring|Ufer|Damm|Chaussee)) \d{1,4} ?[a-z]?(?!\w)(?:, (?:D-)?\d{5} [A-ZÄÖÜ][a-zäöüß]+(?:[ -](?:am|an der|im|[A-ZÄÖÜ][a-zäöüß]+))*)?"
)
ADDRESS_FR = re.compile(
    r"(?<![\w-])\d{1,4}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|bd|place|chemin|allée|impasse|quai|cours|route|square) (?:(?:de la|de l['’]|de|du|des|d['’]|la|le) ?)?[A-ZÀ-Þ][\wà-ÿ'’-]+(?:[ -][A-ZÀ-Þ][\wà-ÿ'’-]+){0,3}(?:,? \d{5} [A-ZÀ-Þ][\wà-ÿ'’-]+(?:[ -][A-ZÀ-Þ][\wà-ÿ'’-]+)*)?"
)
_HOUSE_DE, _HOUSE_FR = re.compile(r"(?:traße|trasse|tr\.|eg|latz|llee|asse|ing|fer|amm|haussee) \d"), re.compile(r"\d,? (?:bis |ter )?(?:rue|av|bou|bd|pl|ch|al|im|qu|co|ro|sq)")
_UPPER, _SMALL = "A-Z\u00c0-\u00d6\u00d8-\u00de\u0100-\u017f", "a-z\u00df-\u00f6\u00f8-\u00ff\u0100-\u017f"
_LATIN = rf"(?:[{_UPPER}][{_SMALL}]+(?:[-'’][{_UPPER}][{_SMALL}]+)?|[A-Z]['’][{_UPPER}][{_SMALL}]+|[A-Z]{{3,}})"
NAME_EN = re.compile(rf"(?<![\w@.+°-])(?={_LATIN}|[A-Z]\.)(?:{_LATIN} [A-Z]\. {_LATIN}|[A-Z]\. {_LATIN}|{_LATIN}, {_LATIN}|{_LATIN} {_LATIN})(?![\w@-]|\.\w)")
NAME_TITLED = re.compile(rf"\b(?:{'|'.join(TITLES)})\.?\s+({_LATIN})(?![\w@-]|\.\w| [{_UPPER}][{_SMALL}.])")
NAME_AFTER = re.compile(rf"(?:{BEFORE_NAME})\s*")
_LOWER = re.compile(r"(?:[A-Za-z]{2,} [A-Za-z]\. [A-Za-z]{2,}|[A-Za-z]\. [A-Za-z]{2,}|[A-Za-z]{2,},? [A-Za-z]{2,})(?![\w@-]|\.\w)")
_SURNAME = "|".join(sorted(SURNAMES, key=len, reverse=True))
NAME_KO = re.compile(rf"(?<![가-힣\w])(?=({_SURNAME})( ?)([가-힣]{{1,2}}))")
_RIGHT = re.compile(AFTER_NAME), re.compile(AFTER_NAME_KO), re.compile(NOT_AFTER)
_LEFT_EN, _LEFT_KO = re.compile(rf"(?:{BEFORE_NAME})\s*$"), re.compile(rf"(?:{BEFORE_NAME_KO})\s*$")
_START = re.compile(r"(?:^|[.!?]|//|contact|\bid=\d+|\||[.!?]” )[\s#>*\-|/“\"]*$")
_LIST = re.compile(r"(?:[Aa]ttendees|참석):(?:[^.!?]|\b[A-Z]\.){2,60}[;,]\s*$")
_NUMBER_LEFT, _ID_LEFT, _PHONE_LEFT = re.compile(ABOUT_NUMBER), re.compile(ABOUT_ID), re.compile(ABOUT_PHONE)
_DETERMINER, _COMMON = frozenset(DETERMINERS), frozenset(x.lower() for x in COMMON)
_TITLES, _VERB_LEFT, _VERB_RIGHT = frozenset(TITLES), frozenset(BEFORE_VERB), re.compile(AFTER_VERB)
_NAME_WORD = re.compile(rf"[{_UPPER}{_SMALL}]+")

#: What a line must hold for a match of EMAIL, of ADDRESS_KO, of PASSPORT or a format of numbers, of BEFORE_NAME, and for a Korean name with a feature of its surroundings.
_AT_SIGNS = ("@", "＠", "(at)", "[at]", "{at}", " at ", "골뱅이")
_DIGIT, _KO_HOUSE = re.compile(r"\d"), re.compile(r"[로길] ?\d|[동리가] \d")
_SEVEN_DIGITS = re.compile(r"\d(?:\D{0,3}\d){6}")
_BEFORE_PARTS = ("egards,", "incerely,", "wner:", "c:", "C:", "ttendees:", "rom:", "o:", "uthor:", "eviewer:", "ontact:", "Per", "Dear", "Hi", "Hello", "eliver", "assignee=", "ask for", "spoke with")
_CONTEXT_KO = re.compile(rf"(?:{BEFORE_NAME_KO})\s*(?=[{''.join(sorted({x[0] for x in SURNAMES}))}])|(?:[Aa]ttendees|참석):|(?<=[가-힣])(?:{AFTER_NAME_KO})")
_LISTED_LOWER = re.compile(r"(?<![\w@.+-])[a-z]{3,} (?:[a-z]\. )?[a-z]{3,}(?=,(?:\d{3}|QX|M\d)| signed the)")
_AFTER_LOWER = re.compile(r",(?:\d{3}|QX|M\d)| signed the")
#: No format of a number is shorter than this, or has as few digits as these.
SHORTEST_FORMAT, _FEW_DIGITS = 8, frozenset(f"digits{n}" for n in range(7))


@dataclass
class Lexicon:
    given: frozenset = frozenset()
    family: frozenset = frozenset()

    @classmethod
    def of(cls, rows: list[tuple[str, str]]) -> Lexicon:
        return cls(frozenset(t.lower() for t, k in rows if k == "given"), frozenset(t.lower() for t, k in rows if k == "family"))


@dataclass
class Candidate:
    start: int
    end: int
    kind: str
    features: list[str] = field(default_factory=list)


def _beside(text: str, a: int, b: int) -> list[str]:
    """Features of the words on both sides of a name."""
    f = []
    if a and text[a - 1] in " \t":
        word = text[text.rfind(" ", max(0, a - 24), a - 1) + 1 : a - 1] if " " in text[max(0, a - 24) : a - 1] else text[max(0, a - 24) : a - 1]
        if word.rstrip(".") in _TITLES:
            f.append("titled")
        elif word in _VERB_LEFT:
            f.append("verb_before")
    if _VERB_RIGHT.match(text, b, b + 40):
        f.append("verb_after")
    return f


def _name_features(text: str, a: int, b: int, lexicon: Lexicon, korean: bool) -> list[str]:
    span, left, right = text[a:b], text[max(0, a - 80) : a], text[b : b + 40]
    f = ["name", "ko" if korean else "en"]
    announced = bool((_LEFT_KO if korean else _LEFT_EN).search(left))
    if announced:
        f.append("announced")
    if _LIST.search(left):
        f.append("listed")
    if (_RIGHT[1] if korean else _RIGHT[0]).match(right):
        f.append("followed")
    if _RIGHT[2].match(right):
        f.append("not_after")
    if _START.search(left):
        f.append("starts")
    if korean:
        m = re.match(rf"({_SURNAME}) ?", span)
        known = span[m.end() :].lower() in lexicon.given
        f += ["known" if known else "unknown", "spaced" if " " in span else "joined"]
        if m.group(1) in lexicon.family:
            f.append("known_family")
        if re.match(r"[가-힣]{2}", right) and not _RIGHT[1].match(right):
            f.append("goes_on")
        if len(m.group(1)) == 2:
            f.append("long_family")
        if all(c in GIVEN_SYLLABLES for c in span[m.end() :]):
            f.append("syllables")
        f.append("known+context" if known and {"announced", "listed", "followed"} & set(f) else "known-context" if known else "unknown+context" if {"announced", "listed", "followed"} & set(f) else "unknown-context")
    else:
        parts = _NAME_WORD.findall(span)
        known = sum(p.lower() in lexicon.given or p.lower() in lexicon.family for p in parts)
        f += _beside(text, a, b)
        if parts[0].lower() in _COMMON:
            f.append("common")
        if len(parts) == 1:
            f.append("single")
        f += [f"known{min(known, 2)}", "initial" if re.search(r"\b[A-Za-z]\.", span) else "comma" if "," in span else "plain"]
        if span.islower():
            f.append("lower")
        if span.isupper():
            f.append("upper")
        if any(p.capitalize() in _DETERMINER for p in parts):
            f.append("determiner")
        if len([p for p in parts if len(p) > 1]) < len(parts) and len(parts) == 3:
            f.append("three")
        context = {"announced", "listed", "followed"} & set(f)
        f.append(f"known{min(known, 2)}{'+' if context else '-'}context")
        if "announced" in f and "followed" in f:
            f.append("both_sides")
        if re.match(r" [A-Z][a-z]+[ ,;:(<]", right):
            f.append("capital_follows")
    return ["name:" + x for x in f]


def hopeless_forms(weights: dict[str, float]) -> frozenset[str]:
    """Forms of candidates that no other features lift above zero under these weights, so that no segmentation takes them.

    ko and en with a form: names without a listed given name (ko) or listed or common part (en) and without a feature of their
    surroundings but the one verb that is named; a number of digits: numbers of no format.
    """
    w = lambda f: weights.get(f, 0.0)
    lift = lambda prefix, *fs: sum(max(0.0, w(prefix + f)) for f in fs)
    n, bounds = "name:", {}
    for form in ("spaced", "joined"):
        short = w(n + "name") + w(n + "ko") + w(n + "unknown") + w(n + "unknown-context") + w(n + form) + lift(n, "known_family", "goes_on", "starts", "not_after", "syllables")
        bounds |= {f"ko_{form}": short, f"ko_{form}_long": short + w(n + "long_family")}
    for form in ("initial", "comma", "plain"):
        rest = lift(n, "starts", "not_after", "determiner", "capital_follows", *("three",) * (form == "initial")) + max(0.0, w(n + "upper"), w(n + "lower"))
        alone = w(n + "name") + w(n + "en") + w(n + "known0") + w(n + "known0-context") + w(n + form) + rest
        bounds |= {f"en_{form}": alone, f"en_{form}_verb_before": alone + w(n + "verb_before"), f"en_{form}_verb_after": alone + w(n + "verb_after")}
    for digits in range(15):
        bounds[f"digits{digits}"] = max(w(f"{k}:{k}") + w(f"{k}:format_none") + w(f"{k}:digits{digits}") + max(w(f"{k}:about_nothing"), lift(k, *(f":about_{x}" for x in ("number", "id", "phone", "cell")))) for k in ("phone", "id_number"))
    return frozenset(form for form, bound in bounds.items() if bound < -1e-6)


def _formats(plain: str) -> list[str]:
    return [n for n, p in FORMATS if p.fullmatch(plain)] if len(plain) >= SHORTEST_FORMAT else []


def _number_parts(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The number itself; where it has no format, also what has one without its first or last group, which may be another number."""
    plain = text[a:b].translate(_WIDE)
    if b - a <= SHORTEST_FORMAT or " " not in plain or _formats(plain):
        return [(a, b)]
    first, last = plain.find(" "), plain.rfind(" ")
    return [(a, b), *([(a, a + last)] if _formats(plain[:last]) else []), *([(a + first + 1, b)] if _formats(plain[first + 1 :]) else [])]


def candidates(text: str, lexicon: Lexicon, hopeless: frozenset[str] = frozenset()) -> list[Candidate]:
    """Bounded candidate spans of a line, without those of hopeless forms; they may overlap and contradict each other."""
    out: list[Candidate] = []
    add = lambda a, b, kind, f: out.append(Candidate(a, b, kind, f))
    for m in EMAIL.finditer(text) if any(x in text for x in _AT_SIGNS) else ():
        left, right = text[max(0, m.start() - 60) : m.start()], text[m.end() : m.end() + 12]
        f = ["email", "sign" if "@" in m.group() else "obfuscated"]
        if re.search(r"://\S*$", left):
            f.append("in_url")
        if re.match(r":\S", right) or m.group().startswith("git@"):
            f.append("remote")
        if re.search(r"\bmailto:$", left):
            f.append("mailto")
        if re.match(r"[/]\S", right):
            f.append("path_follows")
        add(m.start(), m.end(), "email", ["email:" + x for x in f])
    ascii_only = text.isascii()
    has_digit = bool(_DIGIT.search(text))
    has_seven = has_digit and bool(_SEVEN_DIGITS.search(text))
    numbers = [(m.start(), m.end()) for m in NUMBER.finditer(text)] if has_seven or has_digit and not _FEW_DIGITS <= hopeless else []
    for a, b in [part for whole in numbers for part in _number_parts(text, *whole)]:
        plain = text[a:b].translate(_WIDE)
        digits = f"digits{min(14, sum(c.isdigit() for c in plain))}"
        kinds = _formats(plain)
        if not kinds and digits in hopeless:
            continue
        left = text[max(0, a - 40) : a]
        about = ["number"] * bool(_NUMBER_LEFT.search(left)) + ["id"] * bool(_ID_LEFT.search(left)) + ["phone"] * bool(_PHONE_LEFT.search(left)) + ["cell"] * bool(re.search(r"[,|]\s?$", left))
        for kind in ("phone", "id_number"):
            f = [kind, *(f"format_{k}" for k in kinds or ["none"]), *(f"about_{x}" for x in about or ["bare" if kinds else "nothing"]), digits]
            add(a, b, kind, [f"{kind}:{x}" for x in f])
    for m in PASSPORT.finditer(text) if has_seven else ():
        left = text[max(0, m.start() - 40) : m.start()]
        f = ["passport", *(["about_number"] if _NUMBER_LEFT.search(left) else []), *(["about_id"] if _ID_LEFT.search(left) else []), *(["cell"] if re.search(r"[,|]\s?$", left) else [])]
        add(m.start(), m.end(), "id_number", ["id_number:" + x for x in f])
    for m in ADDRESS_EN.finditer(text) if has_digit else ():
        ends = {m.end()}
        ends |= {m.start() + c.start() for c in re.finditer(r", |(?<=[a-z]) (?=[A-Z])| \d{4,5}$", m.group())}
        for end in ends:
            span = text[m.start() : end]
            last = re.findall(r"[A-Za-z]+", span)[-1] if re.search(r"[A-Za-z]", span) else ""
            if not re.search(rf"\b(?:{STREETS})\b|Box \d", span):
                continue
            f = ["address", "en", "whole" if end == m.end() else "cut", f"parts{span.count(',')}"]
            if last in _DETERMINER:
                f.append("determiner_end")
            if end < m.end() and re.match(r",? ?(?:" + "|".join(DETERMINERS) + r")\b", text[end : end + 12]):
                f.append("before_determiner")
            add(m.start(), end, "address", ["address:" + x for x in f])
    for country, pattern, house in (("de", ADDRESS_DE, _HOUSE_DE), ("fr", ADDRESS_FR, _HOUSE_FR)) if has_digit else ():
        for m in pattern.finditer(text) if house.search(text) else ():
            add(m.start(), m.end(), "address", [f"address:{x}" for x in ("address", country, *(["code"] if re.search(r", (?:D-)?\d{5} |\d{5} [A-ZÀ-Þ]", m.group()) else []))])
    for m in ADDRESS_KO.finditer(text) if has_digit and not ascii_only and _KO_HOUSE.search(text) else ():
        span = m.group()
        f = ["address", "ko"]
        f += ["district"] * bool(re.search(r"[가-힣][구군] ", span)) + ["city"] * bool(re.search(r"(?:시|도) ", span)) + ["code"] * bool(re.match(r"[(\[]?\d{5}", span)) + ["unit"] * bool(re.search(r"\d+(?:호|층)$", span))
        add(m.start(), m.end(), "address", ["address:" + x for x in f])
    seen = set()
    surrounded = not ascii_only and bool(_CONTEXT_KO.search(text))
    for m in NAME_KO.finditer(text) if not ascii_only else ():
        a, b = m.start(), m.start() + len(m.group(1)) + len(m.group(2)) + 2
        form = ("ko_spaced" if m.group(2) else "ko_joined") + "_long" * (len(m.group(1)) == 2)
        if len(m.group(3)) == 2 and (surrounded or form not in hopeless or text[b - 2 : b] in lexicon.given):
            add(a, b, "name", _name_features(text, a, b, lexicon, True))
        for n in (1, 3):  # given names of another length only if they are listed
            if text[b - 2 : b - 2 + n] in lexicon.given and len(text) >= b - 2 + n:
                add(a, b - 2 + n, "name", _name_features(text, a, b - 2 + n, lexicon, True))
    at = 0
    while m := NAME_EN.search(text, at):
        at = m.start() + 1
        seen.add((m.start(), m.end()))
    for m in NAME_TITLED.finditer(text) if any(x in text for x in TITLES) else ():
        seen.add(m.span(1))
    announces = any(x in text for x in _BEFORE_PARTS)
    for t in NAME_AFTER.finditer(text) if announces else ():
        if m := _LOWER.match(text, t.end()):
            seen.add((m.start(), m.end()))
    for t in re.finditer(r";\s+", text) if "ttendees:" in text or "참석:" in text else ():
        if (m := _LOWER.match(text, t.end())) and _LIST.search(text[max(0, t.end() - 80) : t.end()]):
            seen.add((m.start(), m.end()))
    for m in _LISTED_LOWER.finditer(text) if _AFTER_LOWER.search(text) else ():
        seen.add((m.start(), m.end()))
    surrounded = announces or "참석:" in text
    for a, b in sorted(seen):
        if not surrounded and not _RIGHT[0].match(text, b, b + 40):
            span = text[a:b]
            near = _beside(text, a, b)
            form = "en_initial" if re.search(r"\b[A-Za-z]\.", span) else "en_comma" if "," in span else "en_plain"
            form += f"_{near[0]}" if len(near) == 1 else "_both" if near else ""
            if form in hopeless and not any(p.lower() in lexicon.given or p.lower() in lexicon.family or p.lower() in _COMMON for p in _NAME_WORD.findall(span)):
                continue
        add(a, b, "name", _name_features(text, a, b, lexicon, False))
    return out


def _score(c: Candidate, weights: dict[str, float]) -> float:
    get = weights.get
    return sum(get(f, 0.0) for f in c.features)


def best(cands: list[Candidate], scores: list[float]) -> list[Candidate]:
    """The segmentation of highest score: spans that don't overlap, the rest of the line is outside."""
    order = sorted((k for k in range(len(cands)) if scores[k] > 0), key=lambda k: (cands[k].end, cands[k].start))
    ends = [cands[k].end for k in order]
    value, back = [0.0], [(-1, 0)]
    for i, k in enumerate(order):
        before = bisect_right(ends, cands[k].start, 0, i)
        take = value[before] + scores[k]
        value.append(max(value[i], take))
        back.append((k, before) if take > value[i] else (-1, i))
    out, i = [], len(order)
    while i > 0:
        k, before = back[i]
        if k >= 0:
            out.append(cands[k])
        i = before
    return out[::-1]


def _marginals(cands: list[Candidate], scores: list[float]) -> list[float]:
    """Probability of each candidate under the distribution over all segmentations (forward and backward sums)."""
    points = sorted({0, *(c.start for c in cands), *(c.end for c in cands)})
    index = {p: i for i, p in enumerate(points)}
    n = len(points)
    ends, starts = defaultdict(list), defaultdict(list)
    for k, c in enumerate(cands):
        ends[index[c.end]].append(k)
        starts[index[c.start]].append(k)
    add = lambda x: (m := max(x)) + math.log(sum(math.exp(v - m) for v in x))
    forward, backward = [0.0] * n, [0.0] * n
    for i in range(1, n):
        forward[i] = add([forward[i - 1], *(forward[index[cands[k].start]] + scores[k] for k in ends[i])])
    for i in range(n - 2, -1, -1):
        backward[i] = add([backward[i + 1], *(backward[index[cands[k].end]] + scores[k] for k in starts[i])])
    return [math.exp(forward[index[c.start]] + scores[k] + backward[index[c.end]] - forward[-1]) for k, c in enumerate(cands)]


def train(lines: list[tuple[str, list[tuple[str, str]]]], lexicon: Lexicon) -> dict[str, float]:
    """Weights that maximise the likelihood of the labelled lines, by adaptive gradient steps with a small quadratic penalty."""
    weights: dict[str, float] = defaultdict(float)
    squares: dict[str, float] = defaultdict(lambda: 1e-3)
    data = []
    for text, labels in lines[:TRAINING_LINES]:
        gold = {(at, at + len(v), k) for k, v in labels if (at := text.find(v)) >= 0}
        cands = candidates(text, lexicon)
        data.append((cands, [(c.start, c.end, c.kind) in gold for c in cands]))
    for _ in range(EPOCHS):
        for cands, right in data:
            if not cands:
                continue
            expected = _marginals(cands, [_score(c, weights) for c in cands])
            gradient: dict[str, float] = defaultdict(float)
            for c, r, e in zip(cands, right, expected):
                for f in c.features:
                    gradient[f] += r - e
            for f, g in gradient.items():
                g -= 1e-3 * weights[f]
                squares[f] += g * g
                weights[f] += 0.5 * g / math.sqrt(squares[f])
    return dict(weights)


def found(text: str, lexicon: Lexicon, weights: dict[str, float], hopeless: frozenset[str] = frozenset()) -> list[Candidate]:
    """The spans of a line's best segmentation; hopeless, of hopeless_forms(weights), only saves time."""
    cands = candidates(text.removesuffix("\r"), lexicon, hopeless)
    return best(cands, [_score(c, weights) for c in cands])


def training_lines(lexicon_rows: list[tuple[str, str, str]], count: int = TRAINING_LINES, seed: int = 7) -> list[tuple[str, list[tuple[str, str]]]]:
    """Labelled lines (text, [(type, value)]): invented values in the forms people write them, and look-alikes without labels. A third of the name parts are not in the lexicon, and some of its parts stand where they are no names."""
    r = random.Random(seed)
    pick = r.choice
    by = defaultdict(list)
    for token, script, kind in lexicon_rows:
        by[script, kind].append(token)
    for key, extra in ((("latin", "given"), ["Aldous", "Brenna", "Coralie", "Dorian", "Elspeth"]), (("latin", "family"), ["Ashdown", "Birchall", "Carrow", "Dunmore", "Eastleigh"]), (("hangul", "given"), ["도윤", "서연", "하준", "지우", "수아"])):
        by[key] = (by[key] or extra) + extra * max(1, len(by[key]) // 10)
    d = lambda n: "".join(pick("0123456789") for _ in range(n))

    def name_en() -> str:
        g, f, i = pick(by["latin", "given"]), pick(by["latin", "family"]), pick("ABCDEFGHKLMNOPRSTVWZ")
        n = pick([f"{g} {f}"] * 5 + [f"{g} {i}. {f}", f"{i}. {f}", f"{f}, {g}", f"{f} {g}"])
        return pick([n] * 6 + [n.lower(), n.upper()]) if ". " not in n and "," not in n else n

    name_ko = lambda: pick(SURNAMES) + pick(["", "", " "]) + (pick(by["hangul", "given"]) if r.random() < 0.7 else pick(GIVEN_SYLLABLES) + pick(GIVEN_SYLLABLES))
    phone = lambda: pick([f"010-{d(4)}-{d(4)}", f"010 {d(4)} {d(4)}", f"010.{d(4)}.{d(4)}", f"010{d(8)}", f"+82-10-{d(4)}-{d(4)}", f"+82 10 {d(4)} {d(4)}", f"(031) {d(4)}-{d(4)}", f"02-{d(3)}-{d(4)}", f"555-555-{d(4)}", f"555.555.{d(4)}", f"(555) 555-{d(4)}", f"+1 555 555 {d(4)}", f"+1555555{d(4)}", f"+1-555-555-{d(4)}", f"07700 900{d(3)}", f"+44 7700 900{d(3)}", f"+49 170 {d(7)}", f"+33 6 {d(2)} {d(2)} {d(2)} {d(2)}", f"+34 612 {d(3)} {d(3)}", f"010-{d(4)}-{d(4)}".translate(str.maketrans("0123456789-", "０１２３４５６７８９－"))])
    rrn = lambda: f"{d(2)}{pick(['01', '07', '11'])}{pick(['05', '17', '28'])}", lambda: pick("1234") + d(6)
    number = lambda: pick([f"{rrn[0]()}-{rrn[1]()}", f"{rrn[0]()} - {rrn[1]()}", rrn[0]() + rrn[1](), f"9{d(2)}-{d(2)}-{d(4)}", f"9{d(2)} {d(2)} {d(4)}", "M" + d(8), "QX" + d(7)])
    host = lambda: pick(["mail.alder.example", "post.birch.test", "cedar.invalid", "elm.example"])

    def email() -> str:
        user = pick(["lena.fox", "m.kane+list", "rob_hale42", "kim-jiwoo", "jhan", "SUSAN.LEE"])
        return pick([f"{user}@{host()}"] * 5 + [f"{user}＠{host()}", f"{user}(at){host()}", f"{user} @ {host()}", f"{user} [at] {host().replace('.', ' [dot] ')}"])

    city_en = lambda: pick(["Easton", "Port Merrow", "Ravenfield", "Lakeby"])
    unit_en = lambda: pick(["", "", f", Apt {d(1)}", f", Unit {d(2)}B", f" #{d(3)}"])

    def address_en() -> str:
        street = f"{d(4)} {pick(['Alder', 'Birchwood', 'Copperfield', 'Mistral'])} {pick(['Street', 'Lane', 'Court', 'Blvd', 'Drive', 'St.', 'Ave'])}{unit_en()}"
        return pick([street, f"{street}, {city_en()}", f"{street}, {city_en()} {d(5)}", f"P.O. Box {d(4)}, {city_en()}"])

    def address_ko() -> str:
        place = pick(["", "", f"({d(5)}) "]) + pick(["", "한결시 ", "푸른특별시 ", "너른광역시 "])
        place += pick(["가람구 ", "새터구 ", "들꽃구 "])
        place += pick([f"은빛로 {d(3)}", f"햇살길 {d(2)}", f"물안개로 {d(2)}길 {d(2)}", f"두레동 {d(3)}-{d(2)}번지"])
        return place + pick(["", "", f", {d(3)}호", f", {d(2)}층", f" {d(3)}동 {d(4)}호"])

    noun = lambda: pick(["bridge", "ledger", "scanner", "folder"])
    noun_ko = lambda: pick(["보고서", "창고", "지도", "배관"])
    tail = lambda: pick(["", "", " The old valve must be checked.", " Our shelf was moved twice.", " Chaque clé fut notée.", " Der Ordner fehlte."])
    tail_ko = lambda: pick(["", "", " 오래된 창고는 그대로다.", " 정리된 지도를 다시 확인했다."])

    fresh = lambda: pick(["Bar", "Cal", "Den", "Far", "Gil", "Hol", "Ker", "Lan", "Mor", "Nor", "Pel", "Ros", "Sal", "Tor", "Wen", "Śli", "Mü", "Ö", "Gar", "O’D"]) + pick(["ton", "ley", "mann", "son", "ski", "berg", "field", "court", "ing", "eau", "ez", "ini", "cía"])
    place_name = lambda: pick(["Old", "North", "Red", "Silent", "Upper", "Grand", "East", "Blue"]) + " " + pick(["Bridge", "Valve", "Mill", "Harbor", "Ledger", "Station", "Wrench", "Panel"])
    phone_area = lambda: pick([f"020 7946 {d(4)}", f"0161 496 {d(4)}", f"030 {d(6)}", f"089 {d(7)}", f"0151 {d(8)}", f"0{pick('12345')} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{pick('12345')}.{d(2)}.{d(2)}.{d(2)}.{d(2)}"])
    address_de = lambda: f"{pick(['Haupt', 'Garten', 'Linden', 'Müller', 'Berg'])}{pick(['straße', 'weg', 'gasse', 'allee', 'platz'])} {d(2)}" + pick(["", f", {d(5)} {pick(['Neustadt', 'Altenburg', 'Grünau'])}"])
    address_fr = lambda: f"{d(2)} {pick(['rue', 'avenue', 'place', 'boulevard'])} {pick(['de la ', 'du ', 'des ', ''])}{pick(['Gare', 'Moulin', 'Lilas', 'Victor Hugo', 'Pont'])}" + pick(["", f", {d(5)} {pick(['Rennes', 'Lille', 'Belleville'])}"])

    def running() -> tuple[str, list[tuple[str, str]]]:
        """Running text: names with a common or an unheard-of first part, telephone numbers and addresses of other countries, and what only looks like these."""
        c, f, f2, n, p = pick(COMMON), fresh(), fresh(), noun(), phone_area()
        full, a = f"{c} {f}", pick([address_de, address_fr])()
        return pick([
            (f"I {pick(['met', 'saw', 'asked', 'called'])} {full} {pick(['yesterday', 'about the ' + n, 'on Monday'])}.", [("name", full)]), (f"{full} {pick(['called', 'wrote', 'asked', 'said'])} that the {n} is late.", [("name", full)]),
            (f"Written by {full}", [("name", full)]), (f"The {n} was moved by {full} before Monday.", [("name", full)]), (f"{full}, who joined in May, keeps the {n}.", [("name", full)]), (f"The {n} of {full} was moved.", [("name", full)]),
            (f"… {(e := name_en())}{tail()}", [("name", e)]), (f"… {place_name()}{tail()}", []), (f"We thank {full} for the {n}.", [("name", full)]), (f"{full}", [("name", full)]),
            (f"{pick(['Dr.', 'Mr', 'Mrs.', 'Prof.', 'Herr', 'Frau', 'Mme'])} {f2} {f} checked the {n}.", [("name", f"{f2} {f}")]), (f"{pick(['Dr.', 'Mr', 'Ms', 'Herr', 'Frau', 'Madame'])} {f} checked the {n}.", [("name", f)]), (f"Gespräch mit {full} am Montag", [("name", full)]), (f"rendez-vous avec {full} mardi", [("name", full)]),
            (f"{pick(['Tel:', 'Phone:', 'Fax', 'Call me at', 'Telefon', 'Tél.', 'Ring'])} {p}", [("phone", p)]), (f"Reach me on {(q := phone())}", [("phone", q)]), (f"{q}", [("phone", q)]), (f"{n} {p} {n}", []), (f"sheet {p} of the {n}", []), (f"lives at {a}", [("address", a)]), (f"{pick(['Lieferung:', 'livraison :', 'ship to'])} {a}.", [("address", a)]), (f"{a}", [("address", a)]),
            (f"I {pick(['met', 'saw', 'called'])} {place_name()} yesterday.", []), (f"The {n} by {place_name()} is late.", []), (f"{place_name()} said the {n}.", []), (f"with {place_name()}", []), (f"{c} {pick(['Street', 'Hotel', 'Station', 'Project', 'Library', 'Bridge'])} is closed", []), (f"{place_name()}", []), (f"{c} {n}", []), (f"call_{n}({noun()}, {noun()} = {d(3)})".upper(), []), (f"the {n} was moved to the {noun()}, and the {noun()} list, with it".upper(), []), (f"def {n}({noun()}, {noun()}={d(2)}):".upper(), []), (f"from {place_name()}, who", []),
        ])

    def line() -> tuple[str, list[tuple[str, str]]]:
        if r.random() < 0.3:
            return running()
        e, k, m, p, i, a, b = name_en(), name_ko(), email(), phone(), number(), address_en(), address_ko()
        e2, k2 = name_en(), name_ko()
        head = pick(["", "", "", "# ", "- ", "> ", "// contact ", "The old rack was sorted. "])
        lex = pick(by["latin", "given"] + by["latin", "family"])
        forms = [
            (f"Best regards, {e}{tail()}", [("name", e)]), (f"Owner: {e}{tail()}", [("name", e)]), (f"Per {e}: leave the {noun()} alone.", [("name", e)]), (f"Dear {e}, the {noun()} is ready.", [("name", e)]),
            (f"cc: {e} <{m}>{tail()}", [("name", e), ("email", m)]), (f"Attendees: {e}; {e2}{tail()}", [("name", e), ("name", e2)]), (f"Deliver to {e}, {a}.{tail()}", [("name", e), ("address", a)]),
            (f"assignee={e} phone={p}{tail()}", [("name", e), ("phone", p)]), (f"Backup contact is {p}, ask for {e}.{tail()}", [("phone", p), ("name", e)]), (f"spoke with {e} ({p}) about the {noun()}", [("name", e), ("phone", p)]),
            (f"{e} signed the {noun()} form on 2026-02-0{pick('1234567')}.", [("name", e)]), (f"{e},{i},{p},{m}", [("name", e), ("id_number", i), ("phone", p), ("email", m)]), (f"{e},{i},{p},{a}{tail()}", [("name", e), ("id_number", i), ("phone", p), ("address", a)]),
            (f"담당자: {k}{tail_ko()}", [("name", k)]), (f"작성자 {k} (2026-03-1{pick('1234567')}){tail_ko()}", [("name", k)]), (f"{noun_ko()} 인수자 {k} 서명{tail_ko()}", [("name", k)]), (f"참석: {k}, {k2}{tail_ko()}", [("name", k), ("name", k2)]),
            (f"수령인 {k} / {b}{tail_ko()}", [("name", k), ("address", b)]), (f"보낸사람: {k} <{m}>", [("name", k), ("email", m)]), (f"{k}에게 물어볼 것", [("name", k)]), (f"{k} 님({p})께 {noun_ko()} 전달 부탁드립니다.", [("name", k), ("phone", p)]),
            (f"{k} 과장 휴대폰 {p}", [("name", k), ("phone", p)]), (f"{k} 팀장이 {noun_ko()} 자료를 보냈다.", [("name", k)]), (f"어제 {k}가 {noun_ko()} 열쇠를 맡겼다고 한다.", [("name", k)]), (f"| {k} | {p} | {b} |", [("name", k), ("phone", p), ("address", b)]),
            (f"{k},{i},{p},{m}", [("name", k), ("id_number", i), ("phone", p), ("email", m)]), (f"연락처 {p}{tail_ko()}", [("phone", p)]), (f"긴급 시 {p} 또는 {(p2 := phone())}", [("phone", p), ("phone", p2)]), (f"{noun_ko()} 관련 통화함({p}).", [("phone", p)]),
            (f"Call {p} before moving the {noun()}.", [("phone", p)]), (f"tel {p} / {m}{tail()}", [("phone", p), ("email", m)]), (f"회신 {m}, 전화 {p}.", [("email", m), ("phone", p)]), (f"문의는 {m} 로 주세요.", [("email", m)]), (f"Reach me at {m}.", [("email", m)]),
            (f"mailto:{m}", [("email", m)]), (f"passport or ID {i} copied into the {noun()} folder", [("id_number", i)]), (f"tax id: {i}{tail()}", [("id_number", i)]), (f"신분증 번호는 {i} 이고 사본은 {noun_ko()} 폴더에 있다.", [("id_number", i)]), (f"본인확인: {i}{tail_ko()}", [("id_number", i)]),
            (f"주민등록번호 {i} 확인 완료", [("id_number", i)]), (f"visited {a} for the {noun()} check", [("address", a)]), (f"주소: {b}{tail_ko()}", [("address", b)]), (f"사는 곳이 {b} 라고 들었다.", [("address", b)]), (f"{b} 로 {noun_ko()} 배송 예정", [("address", b)]),
        ]
        decoys = [
            f"{lex} branch merged into the {noun()} line", f"{lex} dam drawing, sheet {d(2)}", f"{lex} 프로젝트 {d(2)}차 검토", f"{pick(by['hangul', 'given'])} 사진 {d(2)}장", f"{pick(by['hangul', 'given'])} 바닥 {d(2)}칸 교체", f"Grace period of {d(2)} days applies to the {noun()}.",
            f"{noun_ko()} 일련번호 {d(6)}-{d(4)}-{d(4)}", f"build {d(4)}-{d(2)}-{d(4)} failed", f"part no. {d(3)}-{d(3)}-{d(4)}x", f"version {d(2)}.{d(2)}.{d(4)}-rc{d(2)}", f"ip 10.{d(2)}.{d(2)}.{d(2)} port {d(4)}", f"좌표 {d(2)}.{d(6)}, {d(3)}.{d(6)}", f"주문번호 {d(4)}-{d(4)}-{d(4)}",
            f"git clone git@code.{host()}:team/{noun()}.git", f"git remote add mirror https://bot:tok_{d(8)}@git.{host()}/x.git", f"url = \"postgres://app:{noun()}{d(3)}@db.{host()}:5432/x\"", f"redis://:{noun()}{d(4)}@cache.{host()}:6379/1",
            "# Offline Handover Manifold", "Topic: Silent Wrench Gasket", f"That shelf had been sorted by the Old Mill team. Our {noun()} is late.", f"정리된 {noun_ko()}는 조용한 {noun_ko()} 때문에 이동 중이다.", f"오후 내내 조립라인이 한적했다, 신규 {noun_ko()}는 그대로다.", f"서버 점검이 끝난 뒤 {noun_ko()}를 정리했다.",
            f"담당자: {pick(['미정', '없음', '전원', '관리팀', '조정 중', '이전 담당', '고객센터', '신규 배정', '정비팀'])}", f"참석: {pick(['전원', '임원진', '정비팀 전원', '이상 없음'])}", f"주문 담당자 확인 후 오전에 전달", f"\"Each {noun()} must be moved\" says our Old Rack", f"2026-02-21T22:19:33 DEBUG rack.moved id={d(6)} path=/a/b ms={d(4)}", f"어제 오후에 전달한 {noun_ko()}", f"팀장 승인 후 {noun_ko()}를 정리했습니다.", f"{noun()} version{d(2)} shipped to Port Merrow", f"새로 {d(3)}번 {noun_ko()}를 조정했다. 따로 {d(2)}칸", f"1024 {noun()} rows, 512 Kb",
        ]
        if r.random() < 0.4:
            return head + pick(decoys), []
        text, labels = pick(forms)
        return head + text, labels

    return [line() for _ in range(count)]


def _task(lexicon: Lexicon, weights: dict[str, float]):
    hopeless = hopeless_forms(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kinds, values = [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                for kind, value in {(c.kind, line[c.start : c.end]): 0 for line in (text or "").split("\n") for c in found(line, lexicon, weights, hopeless)}:
                    rows.append(k)
                    kinds.append(kind)
                    values.append(value)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["source_table", "row_id", "pii_type", "found_text"])

    return run


def model(name_parts: DataFrame) -> tuple[Lexicon, dict[str, float]]:
    """Lexicon and trained weights, from name_parts(token, script, position_kind)."""
    rows = name_parts.select("token", "script", "position_kind").where("token is not null").distinct()
    if (size := rows.agg(F.coalesce(F.sum(F.octet_length("token") + 32), F.lit(0))).first()[0]) > LEXICON_BYTES:
        raise ValueError(f"the list of name parts has {size} bytes, more than {LEXICON_BYTES}")
    parts = [tuple(r) for r in rows.orderBy("token", "script", "position_kind").collect()]
    lexicon = Lexicon.of([(t, k) for t, _, k in parts])
    return lexicon, train(training_lines(parts), lexicon)


def personal_spans(df: DataFrame, name_parts: DataFrame) -> DataFrame:
    """(source_table, row_id, pii_type, found_text), distinct, for df(source_table, row_id, text).

    pii_type is name, email, phone, id_number or address; found_text stands so in the text. All lines are scored, one by one: no
    value crosses a line end. Null and empty texts give no rows, repeated rows none of their own.
    """
    lexicon, weights = model(name_parts)
    sent = df.sparkSession.sparkContext.broadcast((lexicon, weights))
    return df.select("source_table", "row_id", "text").mapInArrow(lambda batches: _task(*sent.value)(batches), "source_table string, row_id bigint, pii_type string, found_text string").distinct()


def masked(text: str, lexicon: Lexicon, weights: dict[str, float], hopeless: frozenset[str] = frozenset()) -> str:
    """text with [NAME], [EMAIL], [PHONE], [ID_NUMBER] and [ADDRESS] in place of what was found; every other character stays."""
    out = []
    for line in text.split("\n"):
        at = 0
        for c in found(line, lexicon, weights, hopeless):
            out += [line[at : c.start], f"[{c.kind.upper()}]"]
            at = c.end
        out += [line[at:], "\n"]
    return "".join(out[:-1])


def masked_texts(df: DataFrame, name_parts: DataFrame) -> DataFrame:
    """df(source_table, row_id, text) with typed placeholders in the texts; repeated rows stay repeated, null stays null."""
    sent = df.sparkSession.sparkContext.broadcast(model(name_parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights = sent.value
        hopeless = hopeless_forms(weights)
        for batch in batches:
            texts = [t if t is None else masked(t, lexicon, weights, hopeless) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["source_table", "row_id", "text"])

    return df.select("source_table", "row_id", "text").mapInArrow(run, "source_table string, row_id bigint, text string")
