"""Word lists and patterns of the newspaper desk, stated as they are: they are data, and every operator that uses one takes it as a parameter."""

from __future__ import annotations

import re

# Subjects and the words that hint at them.
SUBJECTS = (
    ("Polity", r"(?i)\b(?:Constitution|Article \d+|Amendment|Parliament|Assembly|judiciary|Supreme Court|High Court|Governor|federalism|Panchayat|municipal|writ|Bill|Act\b)"),
    ("Economy", r"(?i)\b(?:GDP|inflation|repo|fiscal|deficit|budget|tax|GST|MSME|industry|investment|export|import|bank|subsidy|MSP|crore|lakh crore)"),
    ("Geography", r"(?i)\b(?:river|monsoon|rainfall|drought|cyclone|soil|mineral|coast|forest cover|landform|irrigation|canal|dam)"),
    ("Environment", r"(?i)\b(?:pollution|emission|climate|biodiversity|wildlife|conservation|Ramsar|tiger|ecosystem|CPCB|environmental clearance)"),
    ("Science & Technology", r"(?i)\b(?:ISRO|satellite|space|vaccine|AI|artificial intelligence|semiconductor|nuclear|research|DRDO|biotechnology|quantum)"),
    ("Society", r"(?i)\b(?:caste|tribal|women|SC/ST|literacy|education|health|poverty|migration|urbanisation|welfare|reservation)"),
    ("AP History", r"(?i)\b(?:Satavahana|Kakatiya|Vijayanagara|Ikshvaku|Qutb Shahi|Reddi|Telugu literature|inscription|dynasty)"),
    ("Indian History", r"(?i)\b(?:freedom struggle|Gandhi|Nehru|colonial|British rule|revolt|independence movement|Mughal|Maurya)"),
)

# Places and persons that make a story one of Andhra Pradesh.
AREA_TERMS = (
    "andhra", "amaravati", "visakhapatnam", "vizag", "vijayawada", "guntur", "tirupati", "kurnool", "nellore", "kakinada", "rajahmundry", "rajamahendravaram", "anantapur", "kadapa", "srikakulam", "vizianagaram", "eluru", "ongole",
    "machilipatnam", "chittoor", "annamayya", "nandyal", "palnadu", "bapatla", "parvathipuram", "alluri", "anakapalli", "konaseema", "tirumala", "polavaram", "sriharikota", "krishnapatnam", "bhogapuram", "gangavaram",
    "sri city", "rayalaseema", "godavari", "apcnf", "apspdcl", "appsc", "chandrababu", "pawan kalyan", "tdp", "ysrcp", "jana sena",
)

# Official acts that a story may name: weight, pattern, label.
INSTRUMENTS = (
    (3, r"(?i)\b(?:Government Order|G\.?O\.?\s?(?:Ms|Rt)?\.?\s?No|ordinance|gazette notification)\b", "order or notification"),
    (3, r"\b(?:Bill|Act|amendment|Rules? (?:were |was )?notified|Section \d+|Article \d+)\b", "legislation"),
    (3, r"(?i)\b(?:Cabinet|CCEA|Council of Ministers)\b.{0,40}\b(?:approv|clear|decid|nod)", "cabinet decision"),
    (3, r"(?i)\b(?:Supreme Court|High Court)\b.{0,60}\b(?:held|ruled|struck down|directed|stayed|upheld|judgment|verdict)", "judgment"),
    (3, r"(?i)\b(?:appointed|sworn in|takes? charge as|designated as|nominated as)\b", "appointment"),
    (2, r"(?i)\b(?:committee|commission|task force|panel)\b.{0,40}\b(?:constituted|set up|formed|headed by|chaired by|recommend)", "committee"),
    (2, r"(?i)\b(?:report|survey|index|ranking|census|estimates?)\b.{0,30}\b(?:released|published|tabled|submitted)", "report or index"),
    (2, r"(?i)\b(?:scheme|mission|yojana|programme)\b.{0,40}\b(?:launched|approved|extended|outlay|allocat)", "scheme"),
    (2, r"(?i)\b(?:MoU|memorandum of understanding|agreement|treaty|summit|bilateral)\b", "agreement or summit"),
    (2, r"(?i)\b(?:GI tag|geographical indication|Ramsar|biosphere reserve|tiger reserve|UNESCO|World Heritage)\b", "designation"),
    (2, r"(?i)\b(?:budget|allocation|grant|deficit|tariff|GST|repo rate|MSP|subsidy)\b", "fiscal instrument"),
    (1, r"(?i)(?:Rs\.?|₹)\s?[\d,.]+\s*(?:crore|lakh)\b", "a figure"),
    (1, r"(?i)\b\d+(?:\.\d+)?\s*(?:per cent|percent|%)\b", "a percentage"),
)

# Categories of news that are never examined: label, pattern.
VETO = (
    ("local crime", r"(?i)\b(?:robbed|robbery|murder(?:ed)?|stabbed|arrest(?:ed|s)?|booked\b|remand(?:ed)?|absconding|kidnap(?:ped)?|molest|rape[ds]?|smuggl|seiz(?:ed|ure) of (?:ganja|liquor)|drowned|electrocuted|knocked down|road accident|died after|suicide|hooch)\b"),
    ("death or recovery of a body", r"(?i)\bbod(?:y|ies)\b[^.]{0,40}\b(?:retrieved|recovered|found|fished out)\b"),
    ("weather report", r"(?i)\b(?:morning showers|humid weather|light to moderate rain|maximum temperature|minimum temperature|heat wave conditions|brings? relief from)\b"),
    ("personal engagement or commemoration", r"(?i)\b(?:to attend (?:the )?wedding|wedding of|remembered on|birth anniversary|death anniversary|jayanti (?:was |celebrat)|paid (?:floral )?tributes)\b"),
    ("civic complaint", r"(?i)\b(?:pothole|garbage|open drain|sewage overflow|stray dog|power cut|water supply disrupt|encroachment|traffic jam|street light)\b"),
    ("film, TV or celebrity", r"(?i)\b(?:film|movie|cinema|actor|actress|heroine|director's next|box office|teaser|trailer|web series|serial|OTT|audio launch|pre-release)\b"),
    (
        "ceremonial or promotional event",
        r"(?i)\b(?:felicitat|condolence|obituary|passed away|inaugurat(?:ed|ion) of the (?:building|office|showroom)|awareness (?:programme|rally|walk)|blood donation camp|freshers|alumni meet|career guidance|seminar (?:on|was)|valedictory|fashion show|food festival)\b",
    ),
    ("festival logistics", r"(?i)\b(?:darshan|queue (?:line|complex)|laddu|annaprasadam|crowd management|devotees (?:were|are) allowed|special buses (?:were|will be) run|toll|kalyanotsavam)\b"),
    ("listings, weather or filler", r"(?i)\b(?:horoscope|rashi|today's programmes|classifieds|tenders? invited|weather (?:forecast|update)|maximum temperature|letters to the editor)\b"),
)
SPORT_REPORT = r"(?i)\b(?:beat|defeated|thrashed|drew with|won by \d+|innings|wicket|not out|runs off|goal(?:s)? in the|full-time|kick-off|set point|semifinal berth|lost to)\b"
SPORT_EXEMPT = r"(?i)\b(?:Olympic|Commonwealth Games|CWG|Asian Games|World Cup|doping|NADA|WADA|suspended for testing|sports policy|Khelo India|stadium (?:project|funding)|federation (?:election|dispute)|Sports Authority)\b"
SPORT_EVENT = r"(?i)\b(?:tourney|tournament|championship|meet|league)\b"

# Headlines that are dropped before anything else is read.
NOISE = (
    r"\b(vs\.?|beat|beats|thrash|innings|wicket|wickets|goal|goals|century|half-century)\b",
    r"\b(IPL|ODI|T20|Test match|Ranji|Premier League|La Liga|Grand Slam|Olympics medal tally)\b",
    r"\b(box office|trailer|teaser|first look|movie review|film review|web series|OTT release)\b",
    r"\b(horoscope|zodiac|numerology|rashi|panchang)\b",
    r"\b(recipe|skincare|weight loss|beauty tips|fashion)\b",
    r"\b(obituary|passes away|condoles|condolence|mourns|tributes paid)\b",
    r"\b(birthday|anniversary greetings|wishes on)\b",
    r"^\s*(text of|full text of)\b",
    r"\b(interacts with|felicitat|inaugurates the exhibition|addresses the gathering)\b",
    r"\b(subhashitam|shares.*quote|greets the nation|extends greetings|conveys greetings)\b",
    r"\b(pays homage|pays tribute|garlands|floral tributes|remembers)\b",
    r"\b(monthly summary|daily bulletin|media advisory|press conference schedule)\b",
    r"\b(found dead|murder case|arrested for|held for|booked for|robbery|chain snatch)\b",
    r"\b(road accident|dies in|killed in|injured in|drowned|electrocuted)\b",
    r"\b(gold rate|silver rate|petrol price today|share to buy|stocks to watch|multibagger)\b",
    r"\b(viral video|watch:|photos:|in pics|pics:)",
)

# Fixed value: how a contributor's credit ends an opinion piece.
CREDIT = r"(?i)\((?:[A-Z][\w.\- ]+ )?is an? (?:expert|professor|former|senior|independent|researcher)|views expressed are personal|The writer is|is a professor at|is an expert in"

# How a running head begins (paper, folio, date), the cities of its editions, and how a section is named.
HEAD_PREFIX = r"(?i)^(?:THE\s+HINDU\s*)?(?:[A-Z]?\d{1,3}\s+)?(?:(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day,\s+\w+\s+\d{1,2},\s*\d{4}\s*)?"
EDITION_CITY = r"^(?:Vijayawada|Visakhapatnam|Amaravati|Hyderabad|Chennai|Bengaluru|Kochi|Madurai|Coimbatore|Delhi|Mumbai|Kolkata)\b\s*"
SECTION_NAME = r"^[A-Za-z][A-Za-z&/ '’-]*$"
OPINION_SECTION = r"(?i)\b(?:Editorial|Opinion|Comment|Leader\s?page)\b"

# Labels that a page prints over its pieces: genre, name, pattern.
MARKERS = (
    ("letters", "LETTERS TO THE EDITOR", r"\bLETTERS TO THE EDITOR\b"),
    ("archive", "an archive reprint", r"\b(?:A HUNDRED YEARS AGO|FIFTY YEARS AGO|FROM THE ARCHIVES)\b"),
    ("interview", "PARLEY", r"\bPARLEY\b"),
    ("column", "NOTEBOOK", r"\bNOTEBOOK\b"),
)
#: A speaker's turn, the disclaimer under signed opinion, and the disclaimer as a sentence.
TURN = r"(?:^|\s)(?:[A-Z]{2,3}|[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\s?:\s"
PERSONAL_VIEWS = r"(?i)\bviews expressed are (?:personal|those of the)\b"
DISCLAIMER = r"(?i)\s*\bThe views expressed are (?:personal|those of the [^.]{0,60})\.?"
GENRES = {
    "report": "News report", "editorial": "Editorial (unsigned)", "oped": "Op-ed (signed opinion)", "interview": "Interview / debate", "column": "Column", "letters": "Letters to the Editor", "archive": "From the archives",
}
OPINION_GENRES, NON_EVENT_GENRES = ("editorial", "oped", "interview", "column"), ("letters", "archive")

# Names of organisations, schemes and persons: kind, pattern (group 1).
NAMES = {
    "organisation": r"\b((?:[A-Z][A-Za-z&.]*\s+){1,5}(?:Authority|Commission|Corporation|Ministry|Department|Board|Council|Tribunal|Committee|Institute|University|Agency|Bank|Federation|Devasthanams?))\b",
    "scheme": r"\b((?:[A-Z][A-Za-z]*\s+){0,4}(?:Yojana|Mission|Abhiyan|Scheme|Programme|Act|Bill|Code|Policy))\b",
    "person": r"\b(?:Mr\.|Ms\.|Mrs\.|Dr\.|Justice|Minister|Chief Minister|Governor|President)\s+([A-Z][A-Za-z.]*(?:\s+[A-Z][A-Za-z.]*){0,3})",
    "acronym": r"\b([A-Z]{3,7})\b",
}
ACRONYMS_OUT = ("THE", "AND", "FOR", "WITH", "THAT", "THIS", "FROM", "WILL", "SAID", "NOT", "ALL", "NEW", "ONE", "TWO", "PDF", "IST", "AM", "PM", "OCR")

# Common words that a headline's signature leaves out.
SIGNATURE_STOP = tuple(
    "a an the and or but of in on at to for from with by as is are was were be been being this that these those it its his her their our your new says said will would may can could s t after over amid ahead".split()
)

# Terms of a vocabulary that are everywhere and tell nothing.
KEYWORD_STOP = (
    "last", "first", "new", "best", "top", "largest", "highest", "lowest", "longest",
    "oldest", "total", "number", "place", "location", "name", "year", "day", "state",
    "city", "district", "area", "people", "group", "india", "government", "minister",
    "president", "world", "ministry", "party", "days", "website", "platform",
    "programme", "policy", "capital", "council", "defence", "cases", "report",
    "committee", "commission", "chairman", "chairperson", "commissioner",
    "secretary", "officer", "department", "scheme", "project", "meeting",
)

# Signs that a claim may be out of date.
STALE_HINTS = (
    "three capitals", "three-capital", "not yet in force", "yet to be notified", "yet to be implemented", "awaiting notification", "is expected to", "15th finance commission", "fifteenth finance commission", "2021-26", "census 2021",
)

# How a question bank names its formats.
BANK_FORMATS = {
    "direct recall": "direct_recall", "direct recall (multi-select)": "direct_recall", "list-matching": "list_matching", "list matching": "list_matching", "multi-statement correctness": "multi_statement", "multi statement correctness": "multi_statement",
    "assertion–reason": "assertion_reason", "assertion-reason": "assertion_reason", "negative statement": "negative_statement", "negative multi-statement": "negative_statement", "negative recall": "negative_statement", "negative match": "negative_statement",
    "chronological ordering": "chronological", "statement-based": "statement_based", "statement based": "statement_based", "count-based": "count_based", "count based": "count_based",
}

#: A word edge between ASCII word characters and all others, as the patterns mean it, whatever letters the language of the engine counts.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _parts(pattern: str) -> tuple[list[str], str]:
    """The alternatives of ``pattern`` up to its end or to the bracket that closes it, and what follows."""
    depth, in_set, at, out = 0, False, 0, []
    for m in re.finditer(r"\\.|[\[\]()|]", pattern, re.S):
        c = m.group()
        if in_set or c == "[":
            in_set = c != "]"
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                return [*out, pattern[at : m.start()]], pattern[m.end() :]
        elif c == "|" and depth == 0:
            out.append(pattern[at : m.start()])
            at = m.end()
    return [*out, pattern[at:]], ""


def _begins(pattern: str) -> str:
    """The letters that ``pattern`` can begin with; empty if that is not certain."""
    group = re.match(r"\((?:\?:)?(?!\?)", pattern)
    parts, rest = _parts(pattern[group.end() :] if group else pattern)
    if group and (re.match(r"[?*{]", rest) or len(_parts(rest)[0]) > 1) or not group and len(parts) > 1:
        return ""
    return "".join(sorted({p[0] for p in parts})) if all(re.match(r"[A-Za-z](?![?*{])", p) for p in parts) else ""


def edged(pattern: str) -> str:
    """``pattern`` with its word edges spelled out. One that begins with an edge and certain letters asks for those first: most places have none, and that is told at once."""
    flag, rest = re.fullmatch(r"((?:\(\?i\))?)(.*)", pattern, re.S).groups()
    first = _begins(rest[2:]) if rest.startswith(r"\b") else ""
    if first:
        flag, rest = f"{flag}(?=[{first}])(?<![A-Za-z0-9_])", rest[2:]
    return flag + re.sub(r"\\b", lambda _: EDGE, rest)


def any_term(terms: tuple[str, ...]) -> str:
    """A pattern for any of ``terms``, taken literally."""
    return "|".join(re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", t) for t in terms)
